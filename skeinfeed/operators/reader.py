"""What a reader of an article gets: a cached text that holds, or one made anew, and what of it is cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinfeed.functions import text as X
from skeinfeed.operators.rewrite import Provider, rewritten
from skeinfeed.operators.store import upserted

# Words from which a cached text is shown, by language; for the reader, and for bundles made ahead.
READER_WORDS, BUNDLE_WORDS = {"te": 80, "en": 280}, {"te": 80, "en": 300}


def _least(language: Column, words: dict[str, int]) -> Column:
    return F.when(X.text(language) == "te", words["te"]).otherwise(words["en"])


def cache_states(articles: DataFrame, cache: DataFrame, words: dict[str, int] = READER_WORDS, match_title: bool = True) -> DataFrame:
    """`articles` with `cached` (the latest cached text) and `state`: hit, short (too few words), mismatch (not about the title) or miss.

    A text is not read further than its JSON allows: broken JSON or a lacking text is a miss, as is a null id. Equal
    times of two entries give the greater one; columns of `articles` are kept.
    """
    latest = upserted(cache.select("article_id", "cached_at", "cache_id", "data").filter("article_id is not null"), ["article_id"], "cached_at")
    texts = latest.select("article_id", X.strip(F.get_json_object("data", "$.content")).alias("cached"))
    state = (
        F.when(X.text(F.col("cached")) == "", "miss").when(X.word_count(F.col("cached")) < _least(F.col("language"), words), "short")
        .when(F.lit(match_title) & ~X.fits_title(F.col("cached"), F.col("title")), "mismatch").otherwise("hit")
    )
    return articles.join(texts, "article_id", "left").withColumn("state", state)


def evicted(states: DataFrame, bundles: bool = False) -> DataFrame:
    """The ids whose cached text goes: those not about their title, and for bundles made ahead all too short ones."""
    return states.filter(F.col("state").isin("short", "mismatch") if bundles else F.col("state") == "mismatch").select("article_id").distinct()


def reader_texts(states: DataFrame, key: str = "row_id", scraped: str = "scraped", provider: Provider | None = None) -> DataFrame:
    """(key, article_id, text, from_cache, saved) of rows with their cache state and the text `scraped` from their page.

    A hit shows the cached text after the cleaning steps. Else the page's text, if it has forty words, or the cleaned
    content or description goes to the provider; what it gives must share a word with the title. Without it the cleaned
    text itself stands, or the notice where that repeats the title. `saved` says whether the new text is cached.
    """
    enough = F.when(X.word_count(F.col(scraped)) >= 40, F.col(scraped))
    own = X.clean_metadata(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("content", "description")), F.lit("")))
    hits = states.filter(F.col("state") == "hit").select(key, "article_id", X.clean_article(F.col("cached"), F.col("language"), F.col("title")).alias("text"), F.lit(True).alias("from_cache"), F.lit(False).alias("saved"))
    rest = states.filter(F.col("state") != "hit").select(key, "article_id", "title", "description", "language", F.coalesce(enough, own).alias("content"), F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in (scraped, "content", "description", "title")), F.lit("")).alias("_last"))
    fallback = X.clean_article(F.col("_last"), F.col("language"), F.col("title"))
    made = rest.withColumn("_own", fallback).withColumn("_own", F.when(X.repeats_title(F.col("_own"), F.col("title")) | (F.col("_own") == ""), X.no_details(F.col("language"))).otherwise(F.col("_own")))
    if provider is not None:
        asked = rewritten(rest, key, provider).filter("from_provider").select(key, F.col("content").alias("_asked"))
        made = made.join(asked, key, "left").withColumn("_own", F.when(X.fits_title(F.col("_asked"), F.col("title")), F.col("_asked")).otherwise(F.col("_own")))
    saved = ~X.is_no_details(F.col("_own")) & X.fits_title(F.col("_own"), F.col("title")) & X.valid_bundle(F.col("_own"))
    return hits.unionByName(made.select(key, "article_id", F.col("_own").alias("text"), F.lit(False).alias("from_cache"), saved.alias("saved")))
