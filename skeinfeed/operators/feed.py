"""The feed: fresh, deduplicated, scored articles; ranking, search, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinfeed.functions import text as X
from skeinfeed.operators.dedup import greedy_two_keys, keep_first

# Days an article stays fresh, and how far in the future it may lie.
FRESH_DAYS, AHEAD_SECONDS = 3, 3600


def moment(published: Column) -> Column:
    """The moment of a mail or ISO date, in UTC where it names no zone; null if it cannot be read."""
    bare = F.regexp_replace(X.strip(published), r"^[A-Za-z]{3,9}, *", "")
    return F.coalesce(
        F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), bare), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC)$"), F.regexp_replace(bare, " (GMT|UTC)$", " +0000")), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"), bare).try_cast("timestamp"),
    )


def fresh(published: Column, as_of: Column) -> Column:
    """At most three days old and at most an hour ahead; what cannot be read counts as fresh."""
    age = F.unix_micros(as_of) - F.unix_micros(moment(published))
    return age.isNull() | age.between(-AHEAD_SECONDS * 1_000_000, FRESH_DAYS * 86_400_000_000)


def smart_filter(rows: DataFrame, as_of: Column, order: str = "row_id") -> DataFrame:
    """Required fields, freshness, then the greedy deduplication by url and by title."""
    good = rows.filter(X.required(F.col("url"), F.col("title")) & fresh(F.col("published_at"), as_of)).withColumn("_norm", X.match_key(F.col("title")))
    return greedy_two_keys(good, "url", "_norm", order).drop("_norm")


def scored(rows: DataFrame) -> DataFrame:
    label, score = X.sentiment(F.col("title"), F.col("description"))
    cat = X.category(F.col("title"), F.col("description"))
    return rows.withColumns({"article_id": X.article_id(F.col("url"), F.col("title")), "sentiment": label, "score": score, "category": cat}).withColumn("tags", X.tags(F.col("category"), F.col("article_id"), F.col("language")))


def ranked(rows: DataFrame, order: str = "row_id") -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce("score", F.lit(0))), order)


def top_of_each(rows: DataFrame, group: str, n: int, order: str = "row_id") -> DataFrame:
    """The n best of each group: the window's rank limit is pushed below the exchange, so a hot group shuffles n rows a task."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.coalesce("score", F.lit(0))), order))).filter(F.col("_n") <= n).drop("_n")


def search(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose title or description contains the query in any case; an empty query keeps all."""
    q = query.strip().lower()
    return rows if not q else rows.filter(F.contains(F.lower(X.text(F.col("title"))), F.lit(q)) | F.contains(F.lower(X.text(F.col("description"))), F.lit(q)))


def search_cached(rows: DataFrame, query: str, language: str, category: str | None = None) -> DataFrame:
    """Rows of a language (and category) whose title and description together contain the query; expired ones too."""
    found = rows.filter((F.col("language") == language) & F.contains(F.lower(F.concat_ws(" ", X.text(F.col("title")), X.text(F.col("description")))), F.lit(query.strip().lower())))
    return found if category is None else found.filter(F.col("category") == category)


def preferred(rows: DataFrame, wanted: list[str], order: str = "row_id") -> DataFrame:
    """Rows of the wanted categories (none: all), one for each trimmed url."""
    kept = rows.filter(F.lower("category").isin(*wanted)) if wanted else rows
    return keep_first(kept.withColumn("url", X.strip(F.col("url"))).filter("url <> ''"), "url", [order])


def enriched(rows: DataFrame, scraped: DataFrame) -> DataFrame:
    """`rows` with scraped content where it has more words than content and description; its image where the row has no valid one.

    `scraped` has article_id, scraped and image.
    """
    joined = rows.join(scraped, "article_id", "left")
    more = X.word_count(F.col("scraped")) > F.greatest(X.word_count(F.col("content")), X.word_count(F.col("description")))
    image = F.when((X.text(F.col("image_url")) == "") & X.image_url(F.col("image")), F.col("image")).otherwise(F.col("image_url"))
    return joined.withColumn("content", F.when(F.col("scraped").isNotNull() & more, F.col("scraped")).otherwise(F.col("content"))).withColumn("image_url", image).drop("scraped", "image")


def mark_language(rows: DataFrame, language: str) -> DataFrame:
    return rows.withColumn("language", F.lit(language))


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """`first`, or `second` where it is empty: for searches beyond the cache and requests repeated without a language."""
    return first.unionByName(second.select(*first.columns).join(first.select(F.lit(1).alias("_some")).limit(1), F.lit(True), "left_anti"))


def kept_counts(rows: DataFrame, as_of: Column, order: str = "row_id") -> DataFrame:
    """(total, kept, dropped) of the filter smart_filter()."""
    kept = smart_filter(rows, as_of, order).agg(F.count("*").alias("kept"))
    return rows.agg(F.count("*").alias("total")).crossJoin(kept).select("total", "kept", (F.col("total") - F.col("kept")).alias("dropped"))


def with_fallback(spark_rows: DataFrame, category: str, language: str) -> DataFrame:
    """The feed of a language, or, if it is empty, of the other one marked as this language."""
    own = spark_rows.filter((F.col("category") == category) & (F.col("language") == language))
    other = "en" if language == "te" else "te"
    rest = mark_language(spark_rows.filter((F.col("category") == category) & (F.col("language") == other)), language)
    return or_else(own, rest)
