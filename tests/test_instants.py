import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from skeinfeed.operators.instants import days_from_civil, normalised_instants

HOMES = [("India", "Asia/Kolkata", "dmy"), ("York", "America/New_York", "mdy"), ("Berlin", "Europe/Berlin", "dmy"), ("Oz", "Australia/Sydney", "dmy"), ("None", None, None)]


def us(text):
    return int(dt.datetime.fromisoformat(text).timestamp() * 1_000_000) if text else None


def run(spark, cases):
    sources = spark.createDataFrame([*HOMES, HOMES[0]], "source string, home_zone string, date_order string")
    rows = spark.createDataFrame([(i, s, t, "x") for i, (s, t) in enumerate(cases)], "row_id long, source string, published_at string, home_zone string")
    return [r["epoch_us"] for r in normalised_instants(rows, sources).orderBy("row_id").collect()]


CASES = [
    ("India", "2025-07-02T08:21:19Z", "2025-07-02T08:21:19+00:00"),
    (" india ", "12/11/2025 23:04", "2025-11-12T23:04:00+05:30"),
    ("YORK", "12/11/2025 11:04 PM", "2025-12-11T23:04:00-05:00"),
    ("York", "Dec 6, 2025 12:05 AM", "2025-12-06T00:05:00-05:00"),
    ("India", "Fri, 13 Jun 2025 03:35:19 IST", "2025-06-13T03:35:19+05:30"),
    ("Oz", "13 Jun 2025, 12:35 pm EST", "2025-06-13T12:35:00+10:00"),
    (None, "Tue, 09 Sep 2025 16:44:08 +0530", "2025-09-09T16:44:08+05:30"),
    ("India", "2025-07-17T05:07:11.499350+05:30", "2025-07-17T05:07:11.499350+05:30"),
    ("India", "20251228T051614+0530", "2025-12-28T05:16:14+05:30"),
    ("Berlin", "2025-08-01 00:36:05 Asia/Kolkata", "2025-08-01T00:36:05+05:30"),
    ("Berlin", "2025-10-26T01:15:23+00:00[Europe/London]", "2025-10-26T01:15:23+00:00"),
    ("York", "2025-11-02 01:30", "2025-11-02T01:30:00-04:00"),  # an hour that occurs twice: first pass
    ("York", "2025-03-09 02:30", "2025-03-09T02:30:00-05:00"),  # a skipped hour: the offset before the change
    ("India", " 1742658371 ", "2025-03-22T15:46:11+00:00"),
    ("India", "1752220504363", "2025-07-11T07:55:04.363+00:00"),
    ("India", "2024-02-29T00:00:00Z", "2024-02-29T00:00:00+00:00"),
    ("India", "2025-02-29T00:00:00Z", None), ("India", "2025-04-20", None), ("India", "yesterday", None), ("India", "0000-00-00 00:00:00", None), ("India", "", None), ("India", None, None),
    (None, "2025-09-23T02:27:03", None), ("None", "2025-09-23T02:27:03", None), ("Elsewhere", "2025-09-23T02:27:03", None), ("India", "9" * 5000, None), ("India", "2025-01-01T25:00:00Z", None), ("India", "2025-01-01 10:00 XYZ", None),
]


def test_cases(spark):
    got = run(spark, [c[:2] for c in CASES])
    assert [(c, g) for c, g in zip(CASES, got) if g != us(c[2])] == []


def test_empty(spark):

    rows = spark.createDataFrame([], "row_id long, source string, published_at string")
    assert normalised_instants(rows, spark.createDataFrame(HOMES, "source string, home_zone string, date_order string")).collect() == []


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "Europe/Berlin", "Australia/Sydney"])
def test_wall_time_against_the_library(spark, zone):
    moments = [dt.datetime(2025, 1, 1) + dt.timedelta(hours=h * 7, minutes=h % 60) for h in range(1200)]
    rows = spark.createDataFrame([(i, "s", m.strftime("%Y-%m-%d %H:%M")) for i, m in enumerate(moments)], "row_id long, source string, published_at string")
    got = normalised_instants(rows, spark.createDataFrame([("s", zone, "dmy")], "source string, home_zone string, date_order string")).orderBy("row_id").collect()
    assert [r["epoch_us"] for r in got] == [int(m.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp()) * 1_000_000 for m in moments]


def test_day_arithmetic(spark):
    days = spark.range(0, 60_000, 7).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    wrong = days.filter(days_from_civil(F.year("d").cast("bigint"), F.month("d").cast("bigint"), F.day("d").cast("bigint")) != F.datediff("d", F.lit("1970-01-01").cast("date")))
    assert wrong.count() == 0
