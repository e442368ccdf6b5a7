"""Tables of the application: keyed caches, preferences, users, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinfeed.functions import text as X

# Preferences of a user who saved none, and minutes a feed stays cached.
DEFAULT_PREFERENCES = {"category": "General", "language": "English", "dark_mode": "false"}
FEED_MINUTES = 1440


def upserted(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The latest row of each key: a mergeable maximum, ties by the greatest row. Null times count as earliest."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max(F.struct(F.col(at).isNotNull().alias("_there"), F.col(at).alias("_at"), *rest)).alias("_row"))
    return latest.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def inserted_if_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`table` with those rows of `new` whose key it lacks, one for each key."""
    return table.unionByName(new.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def registered(users: DataFrame, new: DataFrame) -> DataFrame:
    """New users (username, password in clear) with trimmed names and SHA-256 digests, and whether the name was free."""
    named = new.select(X.strip(F.col("username")).alias("username"), F.sha2(F.col("password"), 256).alias("password"))
    return named.join(users.select("username", F.lit(True).alias("_there")).distinct(), "username", "left").select("username", "password", F.when(F.col("_there"), "exists").otherwise("success").alias("outcome"))


def authenticated(users: DataFrame, tries: DataFrame) -> DataFrame:
    digests = tries.select(X.strip(F.col("username")).alias("username"), F.sha2(F.col("password"), 256).alias("_digest"))
    return digests.join(users.select("username", "password"), "username", "left").select("username", F.coalesce(F.col("password") == F.col("_digest"), F.lit(False)).alias("ok"))


def bundle(data: Column) -> Column:
    """content and ai_headline of a cached entry, or null where its JSON is broken."""
    return F.from_json(data, "content string, ai_headline string", {"mode": "PERMISSIVE"})


def cached_entries(cache: DataFrame, valid: bool = True) -> DataFrame:
    """Cached entries whose content can be read and passes the check (valid=False: those to evict)."""
    read = cache.withColumn("_content", F.get_json_object("data", "$.content"))
    good = F.coalesce(F.col("_content").isNotNull() & X.valid_bundle(F.col("_content")), F.lit(False))
    return read.filter(good if valid else ~good).drop("_content")


def ensured(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at `path`, made empty if there is none; columns it lacks come as nulls. Nothing is ever deleted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    wanted = T._parse_datatype_string(schema)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], wanted).write.parquet(path)
    there = spark.read.parquet(path)
    return there.select(*there.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in wanted if f.name not in there.columns))


def feed_put(feeds: DataFrame, new: DataFrame, keys: list[str], at: str = "cached_at") -> DataFrame:
    """Cached feeds after a put: a feed that came with articles takes the place of its old one, an empty one leaves it."""
    kept = new.filter(F.size("articles") > 0)
    return upserted(feeds.unionByName(kept.select(*feeds.columns)), keys, at)


def unexpired(feeds: DataFrame, now: Column, at: str = "cached_at", minutes: int = FEED_MINUTES) -> DataFrame:
    return feeds.filter(F.unix_micros(now) < F.unix_micros(F.col(at).cast("timestamp")) + minutes * 60_000_000)


def invalidated(feeds: DataFrame, category: str | None = None, language: str | None = None) -> DataFrame:
    """What stays: all but the one feed if both are given, else nothing."""
    if category and language:
        return feeds.filter(~((F.col("category") == category) & (F.col("language") == language)))
    return feeds.limit(0)


def preferences(saved: DataFrame, users: DataFrame) -> DataFrame:
    """(username, pref_key, pref_value) of each user: defaults where nothing is saved, else the latest, out of its JSON quotes."""
    defaults = users.select("username", F.explode(F.create_map(*(F.lit(x) for kv in DEFAULT_PREFERENCES.items() for x in kv))).alias("pref_key", "default"))
    plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), F.col("pref_value"), F.lit("}")), "$.v"), F.col("pref_value"))
    latest = upserted(saved, ["username", "pref_key"], "saved_at").select("username", "pref_key", plain.alias("own"))
    return defaults.join(latest, ["username", "pref_key"], "full_outer").select("username", "pref_key", F.coalesce("own", "default").alias("pref_value"))


def metrics(events: DataFrame) -> DataFrame:
    """Counts of events by type, with distinct users and failures."""
    return events.groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.sum("value").alias("sum_value"))
