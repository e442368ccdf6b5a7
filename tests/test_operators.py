import random

from pyspark.sql import functions as F

from skeinfeed.operators.dedup import cascade, greedy_two_keys, keep_first
from skeinfeed.operators.feed import enriched, fresh, top_of_each
from skeinfeed.operators.rewrite import rewritten
from skeinfeed.operators.store import authenticated, cached_entries, invalidated, preferences, registered, upserted
from skeinfeed.sources.feeds import json_articles, rss_articles, topic_of
from skeinfeed.sources.pages import decoded, extracted, page_parts
from skeinfeed.streaming.dedup import calls_within, first_sightings, run_available


def scan(rows):
    kept, a, b = [], set(), set()
    for o, x, y in rows:
        if (x or "") not in a and (y or "") not in b:
            kept.append(o), a.add(x or ""), b.add(y or "")
    return kept


def test_greedy_cases(spark):
    for rows in ([(1, "u1", "T1"), (2, "u2", "T1"), (3, "u2", "T2")], [(1, "u1", "T1"), (2, "u1", "T2"), (3, "u3", "T2")], [(1, None, "a"), (2, "", "b"), (3, "c", "a")], []):
        df = spark.createDataFrame(rows, "o long, a string, b string")
        assert sorted(r["o"] for r in greedy_two_keys(df, "a", "b", "o").collect()) == scan(rows)


def test_greedy_against_the_scan(spark):
    rng = random.Random(5)
    rows = [(i, f"u{rng.randrange(120)}", "" if rng.random() < 0.3 else f"t{rng.randrange(150)}") for i in range(400)]
    df = spark.createDataFrame(rows, "o long, a string, b string").repartition(7)
    assert sorted(r["o"] for r in greedy_two_keys(df, "a", "b", "o").collect()) == scan(rows)


def test_keep_first_and_cascade(spark):
    df = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, None, 1), (4, "b", 2), (5, "c", 3)], "o int, k string, tier int")
    assert sorted((r["o"], r["k"]) for r in keep_first(df, "k", ["o"]).collect()) == [(1, "a"), (4, "b"), (5, "c")]
    one = df.withColumn("g", F.lit("x"))
    assert sorted(r["o"] for r in cascade(one, ["g"], "tier", {2: 2, 3: 2}, "k", ["o"]).collect()) == [2, 4]
    assert sorted(r["o"] for r in cascade(one, ["g"], "tier", {2: 1, 3: 1}, "k", ["o"]).collect()) == [2]


def test_fresh(spark):
    as_of = F.lit("2025-07-10 12:00:00").cast("timestamp")
    texts = [None, "garbage", "2025-07-06T12:00:00Z", "2025-07-07T12:00:00Z", "Thu, 10 Jul 2025 14:00:00 +0000", "Thu, 10 Jul 2025 12:30:00 GMT"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(fresh(F.col("p"), as_of)).collect()] == [True, True, False, True, False, True]


def test_top_of_each_and_enriched(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", None), (4, None, 1)], "row_id int, source string, score int")
    assert sorted(r["row_id"] for r in top_of_each(df, "source", 1).collect()) == [1, 4]
    rows = spark.createDataFrame([("i", "one two", "a", ""), ("j", "x", None, "http://h/a.png")], "article_id string, content string, description string, image_url string")
    got = {r["article_id"]: (r["content"], r["image_url"]) for r in enriched(rows, spark.createDataFrame([("i", "one two three", "http://h/b.jpg")], "article_id string, scraped string, image string")).collect()}
    assert got == {"i": ("one two three", "http://h/b.jpg"), "j": ("x", "http://h/a.png")}


def test_stores(spark):
    rows = spark.createDataFrame([("k", 1, "2025-01-01"), ("k", 2, "2025-01-02"), ("k", 3, None), (None, 4, None)], "k string, v int, at string")
    assert sorted((r["k"] or "", r["v"]) for r in upserted(rows, ["k"], "at").collect()) == [("", 4), ("k", 2)]
    users = spark.createDataFrame([("ann", "x")], "username string, password string").withColumn("password", F.sha2(F.lit("pw"), 256))
    tries = spark.createDataFrame([(" ann ", "pw"), ("bob", "pw")], "username string, password string")
    assert {r["username"]: r["ok"] for r in authenticated(users, tries).collect()} == {"ann": True, "bob": False}
    assert {r["username"]: r["outcome"] for r in registered(users, tries).collect()} == {"ann": "exists", "bob": "success"}
    saved = spark.createDataFrame([("ann", "category", '"Sports"', "2025-01-01")], "username string, pref_key string, pref_value string, saved_at string")
    assert {r["pref_key"]: r["pref_value"] for r in preferences(saved, users).collect()} == {"category": "Sports", "language": "English", "dark_mode": "false"}
    cache = spark.createDataFrame([(1, '{"content": "' + "word " * 40 + '."}'), (2, "{broken"), (3, None), (4, '{"x": 1}')], "cache_id int, data string")
    assert [r["cache_id"] for r in cached_entries(cache).collect()] == [1]
    assert sorted(r["cache_id"] for r in cached_entries(cache, valid=False).collect()) == [2, 3, 4]
    feeds = spark.createDataFrame([("law", "en"), ("law", "te")], "category string, language string")
    assert (invalidated(feeds, "law", "en").count(), invalidated(feeds, "law").count()) == (1, 0)


RSS = """<rss><channel><item><title>Rates rise - Daily</title><link>http://a/1</link><description>&lt;b&gt;Banks&lt;/b&gt; act.</description><pubDate>x</pubDate><source url="u">Daily</source></item>
<item><title></title><link>http://a/2</link></item><item><title>No source</title><link>http://a/3</link></item>{more}</channel></rss>"""


def test_rss(spark):
    many = "".join(f"<item><title>t{i}</title><link>http://a/m{i}</link></item>" for i in range(40))
    docs = spark.createDataFrame([("one", RSS.format(more="")), ("bad", "<rss><channel>"), ("many", f"<rss><channel>{many}</channel></rss>")], "path string, value string")
    rows = rss_articles(docs, "general", "en").orderBy("path", "item_no").collect()
    one = [r for r in rows if r["path"] == "one"]
    assert [(r["title"], r["description"], r["source"]) for r in one] == [("Rates rise", "Banks act.", "Daily"), ("No source", "No source", "Google News")]
    assert sum(r["path"] == "many" for r in rows) == 30 and not [r for r in rows if r["path"] == "bad"]


def test_json(spark):
    value = '{"articles": [null, {"title": "[Removed]", "url": "u"}, {"title": "Market up", "url": "http://a", "image": "http://a/logo", "publishedAt": "p"}, {"title": "Cup", "url": "http://b", "description": "d", "image": "http://b/i.png", "source": {"name": "S"}}]}'
    rows = json_articles(spark.createDataFrame([("p", value), ("q", "{"), ("r", '{"articles": []}')], "path string, value string"), "general", "en").orderBy("item_no").collect()
    assert [(r["title"], r["description"], r["image_url"], r["source"], r["category"]) for r in rows] == [("Market up", "Market up", "", "Global Agency", "business"), ("Cup", "d", "http://b/i.png", "S", "general")]
    assert [r[0] for r in spark.createDataFrame([("health",), ("zz",)], "c string").select(topic_of(F.col("c"))).collect()] == ["HEALTH", "WORLD"]


def test_pages(spark):
    tier, paragraphs, images, said = extracted('<meta property="og:image" content="/a/big.jpg"><meta name=description content="A longer description"><nav>Home page</nav><article><p>One two three four<p>Six <b>seven eight nine<script>x</p></script></article><div class="ad-box">buy this now</div>', "https://x.com/n/1")
    assert (tier, paragraphs, images, said) == ("article", ["One two three four", "Six seven eight nine"], ["https://x.com/a/big.jpg"], "A longer description")
    assert extracted("", "")[1] == [] and extracted("<div" * 500, "")[1] == []
    df = spark.createDataFrame([(1, "u", "<p>" + "word " * 50 + "</p>"), (2, "u", None)], "k int, url string, html string")
    assert [(r["k"], r["tier"]) for r in page_parts(df, "k").collect()] == [(1, "all")]
    latin = spark.createDataFrame([(bytearray("café".encode("latin-1")),), (bytearray("café".encode()),)], "b binary")
    assert [r[0] for r in latin.select(decoded(F.col("b"), F.lit(None).cast("string"))).collect()] == ["café", "café"]


def test_rewritten(spark):
    rows = spark.createDataFrame([(1, "Title", "Only five words stand here", None, "en"), (2, None, None, None, None)], "row_id int, title string, description string, content string, language string")
    own = {r["row_id"]: r["content"] for r in rewritten(rows, "row_id").collect()}
    assert own[1] == "Only five words stand here."
    long = "A sentence about it. " * 12
    got = {r["row_id"]: (r["content"].startswith("A sentence"), r["from_provider"]) for r in rewritten(rows, "row_id", lambda t, s, lang: long if t else 1 / 0).collect()}
    assert got[2][1] is False and got[1][1] in (True, False)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.sql("SELECT id % 5 AS k, timestamp_seconds(id * 30) AS ts FROM range(40)").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    assert run_available(spark, first_sightings(stream, ["k"], "ts").select("k"), "t").count() == 5
    rates = spark.read.parquet(path).select(calls_within(spark.read.parquet(path), "ts", 60).alias("n"))
    assert rates.agg(F.max("n")).first()[0] == 3
