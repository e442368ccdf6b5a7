"""Streaming forms: first sightings across polls, sliding rates, windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinfeed.session import shared_dir


def first_sightings(stream: DataFrame, keys: list[str], at: str, late: str = "3 days") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by the lateness."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into files of the shared folder, and reads them."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def calls_within(rows: DataFrame, at: str, seconds: int = 60, by: list[str] | None = None) -> Column:
    """How many rows (of the same `by`) lie within the last `seconds` up to each row, as a column; for hot keys see call_counts()."""
    order = Window.partitionBy(*(by or [])).orderBy(F.unix_seconds(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return F.count("*").over(order)


def call_counts(rows: DataFrame, at: str, seconds: int = 60, by: list[str] | None = None, out: str = "n") -> DataFrame:
    """`rows` with how many rows (of the same `by`) lie within the last `seconds` up to each row. Null times count as one time.

    Each row stands in the stretch of time it lies in and in the next, so that a count needs one stretch only: a hot key
    is parted by time.
    """
    moment = F.unix_seconds(F.col(at).cast("timestamp"))
    stretch = F.floor(F.col("_at") / (seconds + 1))
    copies = rows.withColumn("_at", moment).withColumn("_next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", stretch + F.col("_next")).filter("_next = 0 or _at is not null")
    order = Window.partitionBy(*(by or []), "_stretch").orderBy("_at").rangeBetween(-seconds, 0)
    return copies.withColumn(out, F.count("*").over(order)).filter("_next = 0").drop("_at", "_next", "_stretch")


def window_counts(rows: DataFrame, at: str, by: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window(F.col(at).cast("timestamp"), width, slide)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def expiring(stream: DataFrame, key: str, at: str, minutes: int = 1440) -> DataFrame:
    """The latest row of each key within each stretch of `minutes` of event time; equal times give the greatest row."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{minutes} minutes")
    rest = [c for c in stream.columns if c not in (key, at)]
    latest = timed.groupBy(F.window(at, f"{minutes} minutes").alias("_w"), key).agg(F.max(F.struct(at, *rest)).alias("_row"))
    return latest.select(*(F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in stream.columns))
