"""Deduplication of rows that keeps first ones."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skeinfeed.session import released, written

#: Undecided rows that one task may scan.
REST_ROWS = 50_000


def keep_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`, as a mergeable minimum: a hot key shrinks on the map side. Null keys are dropped.

    Equal rows count as one; of rows equal in `order` the smallest in all columns stays.
    """
    ranked = F.struct(*order, *(c for c in rows.columns if c not in order))
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ranked).alias("_first"))
    return first.select(*(F.col(f"_first.{c}").alias(c) for c in rows.columns if c != key), key).select(*rows.columns)


def greedy_two_keys(rows: DataFrame, first_key: str, second_key: str, order: str, rounds: int = 12) -> DataFrame:
    """Rows that a scan in `order` (unique, not null) keeps if it drops each row one of whose keys an earlier kept row has.

    The scan is taken in rounds instead: a row that is the first of all undecided rows under both of its keys is kept, as
    nothing before it can drop it; rows sharing a key with a kept one are dropped; what is left goes into the next round.
    Every round is a mergeable minimum by key, so hot keys (all titles of one script may share a key) are no burden.
    Each round settles at least the first undecided row. What long chains of rows sharing now one key, now the other leave
    open after `rounds` rounds, if it is small, is scanned in one go; else the rounds go on. Null keys count as the empty text.
    """
    spark = rows.sparkSession
    keys = rows.select(F.col(order).alias("o"), F.coalesce(first_key, F.lit("")).alias("a"), F.coalesce(second_key, F.lit("")).alias("b"))
    left, kept, turn = keys, [], 0
    while True:
        by_a, by_b = (left.groupBy(k).agg(F.min("o").alias(f"first_{k}")) for k in "ab")
        judged = left.join(by_a, "a").join(by_b, "b")
        now = written(spark, judged.filter((F.col("o") == F.col("first_a")) & (F.col("o") == F.col("first_b"))).select("o", "a", "b"), "greedy-kept")
        kept.append(now)
        rest = left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti")
        before, left, turn = left, written(spark, rest.select("o", "a", "b"), "greedy-left"), turn + 1
        if turn > 1:
            released(before)
        if turn >= rounds and left.limit(REST_ROWS + 1).count() <= REST_ROWS:
            kept.append(_scanned(left))
            break
        if turn < rounds and left.isEmpty():
            break
    return rows.join(functools.reduce(DataFrame.unionByName, kept).select(F.col("o").alias(order)), order, "left_semi")


def _scanned(left: DataFrame) -> DataFrame:
    """The rows (o, a, b) that the scan keeps, in one task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema)
        seen_a, seen_b, out = set(), set(), []
        for i, a, b in sorted(((i, a, b) for i, a, b in zip(*(c.to_pylist() for c in table.columns))), key=lambda r: r[0]):
            if a not in seen_a and b not in seen_b:
                seen_a.add(a), seen_b.add(b), out.append((i, a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    schema = to_arrow_schema(left.schema)
    return left.coalesce(1).mapInArrow(scan, left.schema)


def cascade(rows: DataFrame, group: list[str], tier: str, quotas: dict[int, int], key: str, order: list[str]) -> DataFrame:
    """A union of source tiers in which a tier is read only while the tiers before it gave fewer than its quota of distinct keys.

    Quotas must not increase from tier to tier; tiers without one are always read.
    """
    first = keep_first(rows, key, [tier, *order])
    counts = first.groupBy(*group, tier).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy(tier).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.create_map(*(F.lit(x).cast("int") for kv in quotas.items() for x in kv))[F.col(tier).cast("int")] if quotas else F.lit(None)
    taken = counts.withColumn("_before", before).filter(quota.isNull() | (F.col("_before") < quota)).select(*group, tier)
    return first.join(taken, [*group, tier], "left_semi").select(*rows.columns)
