import random

from pyspark.sql import functions as F

from skeinfeed.functions import text as X
from skeinfeed.operators import dedup, reader
from skeinfeed.operators.feed import or_else
from skeinfeed.operators.instants import normalised_instants
from skeinfeed.operators.store import ensured, feed_put
from skeinfeed.sources.feeds import publisher_articles
from skeinfeed.sources.pages import decoded, extracted
from skeinfeed.streaming.dedup import call_counts, expiring, run_available

BODY = " ".join(f"Cricket word{i} is here." for i in range(120))
ARTICLES = "row_id long, article_id string, title string, description string, content string, language string"


def cached(spark):
    articles = spark.createDataFrame([(1, "a", "Cricket news", "", "", "en"), (2, "b", "Cricket news", "", "", "en"), (3, "c", "Budget speech", "", "", "en"), (4, "d", "Cricket news", "", "", "te"), (5, None, "t", None, None, None), (6, "e", "x", "", "", "en")], ARTICLES)
    entry = lambda t: f'{{"content": "{t}", "ai_headline": ""}}'
    cache = spark.createDataFrame([("a", "2025-01-01", 1, entry("old")), ("a", "2025-01-02", 2, entry(BODY)), ("b", "2025-01-01", 3, entry("Cricket only.")), ("c", "2025-01-01", 4, entry(BODY)), ("d", None, 5, entry(" ".join(BODY.split()[:90]))), ("e", "2025-01-01", 6, '{"broken'), (None, None, 7, entry(BODY))], "article_id string, cached_at string, cache_id long, data string")
    return articles, cache


def test_cache_states(spark):
    articles, cache = cached(spark)
    states = reader.cache_states(articles, cache)
    assert {r["row_id"]: r["state"] for r in states.collect()} == {1: "hit", 2: "short", 3: "mismatch", 4: "hit", 5: "miss", 6: "miss"}
    assert [r[0] for r in reader.evicted(states).collect()] == ["c"] and sorted(r[0] for r in reader.evicted(states, bundles=True).collect()) == ["b", "c"]
    bundles = reader.cache_states(articles, cache, reader.BUNDLE_WORDS, match_title=False)
    assert {r["row_id"]: r["state"] for r in bundles.collect()}[3] == "hit"
    assert reader.cache_states(articles.limit(0), cache.limit(0)).collect() == []


def test_reader_texts(spark):
    articles, cache = cached(spark)
    pages = spark.createDataFrame([(2, " ".join(f"Cricket fact {i} of the day was told." for i in range(12))), (3, "short"), (6, "x")], "row_id long, scraped string")
    states = reader.cache_states(articles, cache).join(pages, "row_id", "left")
    got = {r["row_id"]: r for r in reader.reader_texts(states).collect()}
    assert got[1]["from_cache"] and not got[1]["saved"] and got[2]["text"].startswith("Cricket fact 0") and got[2]["saved"]
    assert got[6]["text"] == X.L.NO_DETAILS["en"] and not got[6]["saved"] and not got[3]["saved"]
    asked = {r["row_id"]: r for r in reader.reader_texts(states, provider=lambda t, s, lang: f"{t}: " + " ".join(f"The story of day {i} went on." for i in range(20))).collect()}
    assert asked[3]["text"].startswith("Budget speech: The story") and asked[3]["saved"] and asked[1]["from_cache"]


def test_garbled_telugu_is_repaired(spark):
    meant = "తెలుగు వార్తలు రోజు"
    garbled = " ".join(w.encode().decode("latin-1") for w in meant.split())
    paged = "".join(chr(b) if 0x81 <= b < 0xA0 and bytes([b]).decode("cp1252", "replace") == "�" else bytes([b]).decode("cp1252") for b in "తెలుగు".encode())
    rows = [meant, garbled, paged, f"plain {garbled} మంచి", "à° alone", "à la carte", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(X.repaired_telugu(F.col("t"))).collect()] == [meant, meant, "తెలుగు", f"plain {meant} మంచి", "à° alone", "à la carte", "", ""]


def test_dates_of_any_length(spark):
    sources = spark.createDataFrame([("s", "Europe/Paris", "dmy")], "source string, home_zone string, date_order string")
    df = spark.createDataFrame([(1, "s", "2025-01-02" + " " * 300 + "03:04:05Z"), (2, "s", "x" * 50_000)], "row_id long, source string, published_at string")
    assert {r["row_id"]: r["epoch_us"] for r in normalised_instants(df, sources).collect()} == {1: 1735787045000000, 2: None}


def test_long_chains_are_settled(spark, monkeypatch):
    """Rows that share now the url, now the title with the one before: one is settled a round, however many there are."""
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(90)]
    rng = random.Random(3)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "o long, a string, b string")
    kept, a, b = [], set(), set()
    for o, x, y in rows:
        if x not in a and y not in b:
            kept.append(o), a.add(x), b.add(y)
    assert sorted(r["o"] for r in dedup.greedy_two_keys(df, "a", "b", "o", rounds=3).collect()) == kept


def test_charsets(spark):
    far = b"<html>" + b" " * 5000 + b'<meta charset="windows-1252"><p>caf\xe9 \x93x\x94'
    rows = [(1, far, None), (2, "é".encode("utf-16"), "text/html; charset=UTF-16"), (3, b"caf\xe9", "text/html; charset=utf-8"), (4, "తె".encode(), "text/html; charset=nonsense"), (5, b"", None), (6, None, None)]
    df = spark.createDataFrame(rows, "i int, b binary, h string")
    got = {r["i"]: r["t"] for r in df.select("i", decoded(F.col("b"), F.col("h")).alias("t")).collect()}
    assert got[1].endswith("café “x”") and got[2] == "é" and got[3] == "café" and got[4] == "తె" and got[5] == "" and got[6] is None


def test_site_selectors():
    words = " ".join(f"word{i}" for i in range(60))
    page = f"<body><article><p>{words} other</p></article><div id='articleContent'><p>{words} own</p></div></body>"
    assert extracted(page, "https://www.sakshi.com/x")[:2] == ("site", [f"{words} own"]) and extracted(page, "https://x.example/")[0] == "article"
    assert extracted("<div class='content'><p>Too short to count</p></div>", "https://sakshi.com/")[0] != "site"


def feed(spark, path, titles, source="Sakshi"):
    items = "".join(f"<item><title>{t}</title><link>https://x/{t}</link><source>{source}</source></item>" for t in titles)
    return spark.createDataFrame([(path, f"<rss><channel>{items}</channel></rss>")], "path string, value string")


def test_publisher_cascade(spark):
    search, general = feed(spark, "s", [f"s{i}" for i in range(4)]).unionByName(feed(spark, "o", ["other"], "Else")), feed(spark, "g", ["g0", "g1"])
    few = publisher_articles([feed(spark, "a", ["a0"]), feed(spark, "b", ["a0", "b0"])], search, general, "sakshi", "te")
    assert sorted(r["title"] for r in few.collect()) == ["a0", "b0", "s0", "s1", "s2", "s3"]
    many = publisher_articles([feed(spark, "a", [f"a{i}" for i in range(10)]), feed(spark, "b", ["b0"])], search, general, "sakshi", "te")
    assert len(many.collect()) == 10
    none = publisher_articles([feed(spark, "a", ["a0"])], feed(spark, "o", ["other"], "Else"), general, "sakshi", "te")
    assert sorted(r["title"] for r in none.collect()) == ["a0", "g0", "g1"]
    assert or_else(few.limit(0), many).count() == 10 and or_else(few, many).count() == 6


def test_feed_store(spark, tmp_path):
    schema = "category string, language string, articles array<string>, cached_at string"
    feeds = spark.createDataFrame([("a", "en", ["x"], "2025-01-01")], schema)
    new = spark.createDataFrame([("a", "en", [], "2025-01-02"), ("b", "en", ["y"], "2025-01-02")], schema)
    assert sorted((r["category"], r["articles"]) for r in feed_put(feeds, new, ["category", "language"]).collect()) == [("a", ["x"]), ("b", ["y"])]
    path = str(tmp_path / "users")
    assert ensured(spark, path, "username string").columns == ["username"]
    assert ensured(spark, path, "username string, created_at timestamp").columns == ["username", "created_at"]


def test_counts_within_and_expiry(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), f"2025-01-01 {rng.randrange(3):02}:{rng.randrange(60):02}:00") for i in range(200)]
    df = spark.createDataFrame(rows, "i int, u string, at string")
    seconds = lambda t: int(t[11:13]) * 3600 + int(t[14:16]) * 60
    want = {i: sum(v == u and 0 <= seconds(t) - seconds(s) <= 600 for _, v, s in rows) for i, u, t in rows}
    assert {r["i"]: r["n"] for r in call_counts(df, "at", 600, ["u"]).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = expiring(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "u", "at", 60)
    got = {(r["u"], r["at"]): r["i"] for r in run_available(spark, stream, "expiring").collect()}
    for (u, at), i in got.items():
        same = [(t, k) for k, v, t in rows if v == u and t[:13] == str(at)[:13]]
        assert (str(at), i) == max(same)
    assert got
