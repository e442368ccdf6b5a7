"""Queries of the general data problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinfeed.operators.instants import normalised_instants
from skeinfeed.operators.wide import cells_as_text, wide_table
from skeinfeed.session import table


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return wide_table(table(spark, d, "user_preferences"), table(spark, d, "pref_catalogue"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cells_as_text(p1_wide(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").select("row_id", "source", "published_at")
    # exploding what is not null keeps the optimizer from working the instant out once more within a filter below it
    return normalised_instants(rows, table(spark, d, "sources")).select("row_id", F.explode(F.array_compact(F.array("epoch_us"))).alias("epoch_us"))


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p3_found": p3_found}

_P1 = r"""
WITH keys AS (SELECT pref_key, lower(trim(value_type)) AS kind, lower(regexp_replace(pref_key, '[\s_-]', '', 'g')) AS plain FROM pref_catalogue WHERE pref_key IS NOT NULL),
saved AS (
  SELECT regexp_replace(p.username, '^\s+|\s+$', '', 'g') AS username, k.pref_key, k.kind, p.saved_at, regexp_replace(p.pref_value, '^\s+|\s+$', '', 'g') AS raw
  FROM user_preferences p JOIN keys k ON lower(regexp_replace(p.pref_key, '[\s_-]', '', 'g')) = k.plain),
bare AS (SELECT *, CASE WHEN raw LIKE '"%' THEN CASE WHEN json_valid(raw) THEN trim(json_extract_string(raw::JSON, '$')) END ELSE raw END AS t FROM saved WHERE username <> ''),
typed AS (
  SELECT *, CASE kind
    WHEN 'string' THEN CASE WHEN NOT regexp_full_match(t, '[{\[](.|\n)*[}\]]') THEN t END
    WHEN 'boolean' THEN CASE WHEN lower(t) IN ('true', 'yes', 'on', '1', 'y', 't') THEN 'true' WHEN lower(t) IN ('false', 'no', 'off', '0', 'n', 'f') THEN 'false' END
    WHEN 'int' THEN CASE WHEN regexp_full_match(t, '[+-]?(\d+|\d{1,3}(,\d{2,3})+)(\.0*)?([eE]\+?0*)?') THEN CAST(TRY_CAST(split_part(replace(t, ',', ''), '.', 1) AS BIGINT) AS VARCHAR) END
    WHEN 'double' THEN CASE WHEN regexp_full_match(t, '[+-]?(\d+([.,]\d*)?|[.,]\d+)([eE][+-]?\d{1,3})?') THEN printf('%.2f', TRY_CAST(replace(t, ',', '.') AS DOUBLE)) END
    WHEN 'date' THEN strftime(COALESCE(
      try_strptime(CASE WHEN regexp_full_match(regexp_replace(t, '[T ]00:00(:00(\.0+)?)?(Z|\+00:?00)?$', ''), '\d{4}[-/.]?\d{2}[-/.]?\d{2}') THEN regexp_replace(regexp_replace(t, '[T ]00:00(:00(\.0+)?)?(Z|\+00:?00)?$', ''), '[-/.]', '', 'g') END, '%Y%m%d'),
      try_strptime(regexp_replace(t, '[T ]00:00(:00(\.0+)?)?(Z|\+00:?00)?$', ''), '%d %b %Y')), '%Y-%m-%d')
    END AS value FROM bare WHERE t <> '' AND lower(t) <> 'null'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY username, pref_key ORDER BY saved_at DESC NULLS LAST, t DESC) AS n FROM typed WHERE value IS NOT NULL)
"""

ORACLE = {"p1_found": _P1 + "SELECT username, pref_key, value AS pref_value FROM ranked WHERE n = 1"}
