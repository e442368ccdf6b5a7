"""Feeds as sources: RSS and JSON documents into article rows, request addresses, a streaming reader of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinfeed.functions import lexicon as L
from skeinfeed.functions import text as X
from skeinfeed.operators.dedup import cascade

# Items read of a feed, categories of the JSON interface, topics of the topic feeds.
MOST_ITEMS = 30
JSON_CATEGORIES = ("general", "world", "nation", "business", "technology", "entertainment", "sports", "science", "health")
TOPICS = ("technology", "sports", "business", "science", "health", "entertainment", "world", "nation")
RSS_SCHEMA = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, source: struct<_VALUE: string, _url: string>>>>"
JSON_SCHEMA = "articles array<struct<title: string, description: string, content: string, url: string, image: string, publishedAt: string, source: struct<name: string>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def rss_articles(feeds: DataFrame, category: str, language: str, publisher: str | None = None) -> DataFrame:
    """Articles of RSS documents (path, value), the first thirty items of each; a document that is no XML gives none.

    Items without title or link are dropped, a publisher at a title's end is cut off, tags in descriptions become blanks,
    a missing description is the title.
    """
    items = feeds.select("path", F.posexplode(F.from_xml("value", RSS_SCHEMA)["channel"]["item"]).alias("item_no", "i")).filter(F.col("item_no") < MOST_ITEMS)
    raw = items.select("path", "item_no", X.strip(F.col("i.title")).alias("t"), X.strip(F.col("i.link")).alias("url"), F.col("i.description").alias("d"), F.col("i.pubDate").alias("published_at"), F.coalesce(F.nullif(X.strip(F.col("i.source._VALUE")), F.lit("")), F.lit("Google News")).alias("source")).filter("t <> '' AND url <> ''")
    if publisher:
        raw = raw.filter(X.of_publisher(F.col("url"), F.col("source"), publisher))
    title = X.clean_metadata(F.regexp_replace("t", r"\s+-\s+[^-\n]+$", ""))
    cleaned = raw.withColumn("title", title).withColumn("description", X.clean_metadata(X.strip_html(F.col("d"), " ")))
    return _articles(cleaned.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "title")).withColumn("content", F.col("description")).withColumn("image_url", F.lit("")), F.lit(category), language)


def json_articles(documents: DataFrame, category: str, language: str, searched: bool = False) -> DataFrame:
    """Articles of JSON documents (path, value); null entries, removed and incomplete ones are dropped, broken JSON gives none."""
    items = documents.select("path", F.posexplode(F.from_json("value", JSON_SCHEMA)["articles"]).alias("item_no", "i")).filter("i is not null")
    raw = items.select("path", "item_no", X.strip(F.col("i.title")).alias("title"), X.strip(F.col("i.url")).alias("url"), "i.description", "i.content", "i.image", F.col("i.publishedAt").alias("published_at"), F.coalesce("i.source.name", F.lit("Global Agency")).alias("source")).filter(X.required(F.col("url"), F.col("title")))
    described = raw.withColumn("description", F.coalesce(F.nullif(X.clean_metadata(F.col("description")), F.lit("")), "title")).withColumn("content", X.clean_metadata(F.col("content")))
    imaged = described.withColumn("image_url", F.when(X.image_url(F.col("image")), F.col("image")).otherwise(""))
    own = X.category(F.col("title"), F.col("description")) if category == "general" and not searched else F.lit(category)
    return _articles(imaged, own, language)


def _articles(rows: DataFrame, category: Column, language: str) -> DataFrame:
    label, score = X.sentiment(F.col("title"), F.col("description"))
    made = rows.withColumns({"article_id": X.article_id(F.col("url"), F.col("title")), "language": F.lit(language), "category": category, "sentiment": label, "score": score})
    made = made.withColumn("tags", X.tags(F.col("category"), F.col("article_id"), F.col("language")))
    return made.select("path", "item_no", "article_id", "title", "description", "content", "source", "url", "image_url", "published_at", "language", "category", "sentiment", "score", "tags")


def json_address(base: str, category: Column, language: Column, term: Column, key: str = "") -> Column:
    """The address of a JSON request: search by term, else headlines of a known category, else general."""
    lang = F.when(X.text(language) != "", F.concat(F.lit("&lang="), language)).otherwise("")
    known = F.when(category.isin(*JSON_CATEGORIES), category).otherwise("general")
    tail = F.lit(f"&max={MOST_ITEMS}&token={key}")
    return F.when(X.text(term) != "", F.concat(F.lit(f"{base}/search?q="), F.url_encode(term), lang, F.lit("&country=in"), tail)).otherwise(F.concat(F.lit(f"{base}/top-headlines?country=in"), lang, F.lit("&category="), known, tail))


def topic_of(category: Column) -> Column:
    return F.when(F.lower(category).isin(*TOPICS), F.upper(category)).otherwise("WORLD")


def news_address(base: str, category: Column, language: Column, term: Column) -> Column:
    """The address of a news feed: search by term, else the topic of a category (in English whatever the language), else the front page."""
    te = X.text(language) == "te"
    own = F.when(te, "hl=te&gl=IN&ceid=IN:te").otherwise("hl=en-IN&gl=IN&ceid=IN:en")
    plain = F.lower(X.text(category)).isin("general", *L.PUBLISHERS)
    topic = F.concat(F.lit(f"{base}/headlines/section/topic/"), topic_of(category), F.lit("?hl=en-IN&gl=IN&ceid=IN:en"))
    return F.when(X.text(term) != "", F.concat(F.lit(f"{base}/search?q="), F.url_encode(term), F.lit("&"), own)).when(plain, F.concat(F.lit(f"{base}?"), own)).otherwise(topic)


def topic_articles(feeds: DataFrame, category: str, language: str) -> DataFrame:
    """Articles of topic and search feeds, labelled with the language asked for, whatever language they came in."""
    return rss_articles(feeds, category, language)


def publisher_articles(direct: list[DataFrame], search: DataFrame, general: DataFrame, category: str, language: str) -> DataFrame:
    """Articles of one publisher: its own feeds in order until ten are found, else a search limited to the publisher too, and
    the general feed below five; the first sighting of an article stays. Each feed is documents (path, value)."""
    tiers = [rss_articles(f, category, language) for f in direct] + [rss_articles(search, category, language, publisher=category), rss_articles(general, category, language)]
    rows = None
    for n, tier in enumerate(tiers, 1):
        numbered = tier.withColumn("_tier", F.lit(n))
        rows = numbered if rows is None else rows.unionByName(numbered)
    quotas = {n: 10 for n in range(2, len(direct) + 2)} | {len(direct) + 2: 5}
    return cascade(rows, [], "_tier", quotas, "article_id", ["path", "item_no"]).drop("_tier")
