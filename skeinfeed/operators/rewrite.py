"""Rewriting of article texts by a provider; without one, the text itself after the cleaning steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinfeed.functions import text as X

#: A provider turns (title, source text, language) into a text, or None.
Provider = Callable[[str, str, str], str | None]


def rewritten(rows: DataFrame, key: str, provider: Provider | None = None, scraped: str = "content") -> DataFrame:
    """(key, tier, content, from_provider): the provider's text if it is complete, else the row's own text.

    A text that is not complete is asked for once more, and the longer one kept; a provider that fails gives none.
    """
    source = X.best_source(F.col("title"), F.col("description"), F.col(scraped))
    own = X.raw_fallback(F.col("title"), F.col("description"), F.col(scraped), F.col("language"))
    base = rows.select(key, F.coalesce("title", F.lit("")).alias("_title"), F.coalesce("language", F.lit("en")).alias("_language"), source.alias("_source"), own.alias("_own")).withColumn("tier", X.prompt_tier(X.word_count(F.col("_source"))))
    if provider is None:
        return base.select(key, "tier", F.col("_own").alias("content"), F.lit(False).alias("from_provider"))

    def ask(title: str, text: str, language: str) -> str | None:
        try:
            return provider(title, text, language)
        except Exception:  # noqa: BLE001 - whatever a provider raises, the row keeps its own text
            return None

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s, lang in zip(*(batch.column(c).to_pylist() for c in ("_title", "_source", "_language"))):
                answer = ask(t, s, lang)
                if answer and answer.rstrip()[-1:] not in tuple(".!?।\"')]"):
                    answer = max(answer, ask(t, answer, lang) or "", key=lambda x: len(x.split()))
                out.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "_answer"])

    kind = rows.schema[key].dataType.simpleString()
    answers = base.mapInArrow(asked, f"{key} {kind}, _title string, _language string, _source string, _own string, tier string, _answer string")
    cleaned = X.clean_article(F.regexp_replace(X.strip_html(F.col("_answer")), "```[a-z]*", ""), F.col("_language"), F.lit(""))
    good = answers.withColumn("_text", cleaned)
    use = F.col("_answer").isNotNull() & X.valid_bundle(F.col("_text"))
    return good.select(key, "tier", F.when(use, F.col("_text")).otherwise(F.col("_own")).alias("content"), use.alias("from_provider"))
