"""Queries of the training-text problems, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinfeed.llm.garbled import garbled_fields, restored_fields, text_fields
from skeinfeed.llm.languages import language_segments, unstated_languages
from skeinfeed.llm.leakage import contained_items
from skeinfeed.llm.packing import packed_texts
from skeinfeed.llm.page_body import boilerplate_lines, main_body
from skeinfeed.llm.source_lines import LineCounts, numbered_lines
from skeinfeed.llm.subjects import document_subjects, fitted_model
from skeinfeed.llm.truncation import truncated_values, truncation_report
from skeinfeed.session import small, spread, table, written


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "articles").select("row_id", "article_id", "title", "description", "content", "source", "url", "language"))


def _written_fields(spark: SparkSession, d: str) -> DataFrame:
    return text_fields(spread(table(spark, d, "articles").select("row_id", "title", "content")), "articles", "row_id", ["title", "content"]).unionByName(text_fields(spread(table(spark, d, "ai_cache").select("cache_id", "data")), "ai_cache", "cache_id", ["data"]))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_fields(_written_fields(spark, d))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored_fields(_written_fields(spark, d)).filter(~F.col("text").eqNullSafe(F.col("restored"))).select("table_name", "row_key", "field_name", "restored")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_values(_articles(spark, d)).filter("truncated").select("row_id", "field_name")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation_report(_articles(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return unstated_languages(_articles(spark, d))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return language_segments(_articles(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate_lines(_articles(spark, d))


def p6_body(spark: SparkSession, d: str) -> DataFrame:
    return main_body(table(spark, d, "articles").select("row_id", "url", "source", "content")).select("row_id", "content")


def _counted(spark: SparkSession, d: str, rebuild: bool = False) -> tuple[LineCounts, DataFrame, DataFrame | None]:
    """Line counts built as they grow: all earlier months as the base, the last month of fetching as a delta.

    Lines are split and hashed once. With `rebuild` the base is rebuilt before the delta comes, and then only the rows
    of the delta and those holding a line that it made cross the threshold.
    """
    month = F.coalesce(F.substring(F.col("timestamp"), 1, 7), F.lit(""))
    rows = spread(table(spark, d, "articles").select("row_id", "article_id", "source", "content", month.alias("_month")))
    members = table(spark, d, "articles").select("article_id", "source", month.alias("_month"))
    lines = written(spark, numbered_lines(rows, "row_id", "content", "source", "article_id", ["_month"]), "numbered-lines")
    last = members.agg(F.max("_month")).first()[0] or ""
    counts = LineCounts(spark)
    early, late = F.col("_month") < last, F.col("_month") >= last
    counts.update(members.filter(early), lines.filter(early), report=False)
    built = None
    if rebuild:
        built = written(spark, counts.rebuilt(rows.filter(early), lines=lines.filter(early)), "rebuilt-base")
    changed = counts.update(members.filter(late), lines.filter(late), report=rebuild)
    if rebuild:
        held = written(spark, counts.holding(lines.filter(early), changed), "rows-changed")
        again = rows.filter(late).unionByName(rows.filter(early).join(small(held), "row_id", "left_semi"))
        built = built.join(small(held), "row_id", "left_anti").unionByName(counts.rebuilt(again, lines=lines))
    return counts, lines, built


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    counts, lines, _ = _counted(spark, d)
    return counts.occurrences(lines, lines=lines)


def p7_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, rebuild=True)[2].select("row_id", "content")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed_texts(spread(table(spark, d, "documents").select("doc_id", "text", "source")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contained_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).select("item_id", "doc_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    return contained_items(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p10_subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return document_subjects(docs, fitted_model(docs, table(spark, d, "subject_labels"), table(spark, d, "subjects")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_subjects(spark, d).select("doc_id", "subject")


QUERIES = {f.__name__: f for f in (p2_found, p2_restored, p4_found, p4_report, p5_found, p5_segments, p6_found, p6_body, p7_found, p7_rebuilt, p8_containers, p9_found, p9_spans, p10_found, p10_subjects)}

_P7 = r"""
WITH rows_ AS (SELECT row_id, article_id, lower(regexp_replace(source, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS s, content FROM articles WHERE source IS NOT NULL),
lines AS (
  SELECT row_id, article_id, s, line_no, lower(trim(regexp_replace(line, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g'))) AS line
  FROM (SELECT row_id, article_id, s, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM rows_ WHERE content IS NOT NULL)),
totals AS (SELECT s, count(DISTINCT article_id) AS total FROM rows_ GROUP BY s),
counts AS (SELECT s, line, count(DISTINCT article_id) AS n FROM lines WHERE line <> '' GROUP BY s, line),
many AS (SELECT c.s, c.line FROM counts c JOIN totals t USING (s) WHERE n >= 5 AND n >= 0.02 * total)
SELECT l.row_id, CAST(l.line_no AS INTEGER) AS line_no FROM lines l JOIN many USING (s, line)
"""
_P9 = r"""
WITH item_words AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}\p{Cf}\p{Co}\x{FE00}-\x{FE0F}\x{034F}]', '', 'g'), '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM eval_items WHERE text IS NOT NULL),
doc_words AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(text)), '[\p{P}\p{S}\p{Cf}\p{Co}\x{FE00}-\x{FE0F}\x{034F}]', '', 'g'), '[\s\p{Z}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
item_windows AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item_words WHERE len(w) >= 13)),
doc_windows AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc_words WHERE len(w) >= 13))
SELECT DISTINCT item_id, doc_id FROM item_windows JOIN doc_windows USING (g)
"""
ORACLE = {"p7_found": _P7, "p9_found": _P9}
