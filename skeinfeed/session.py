"""Session helpers: reading tables, the shared work folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than the cluster has cores, dealt out over all cores; others as they are.

    For work that costs far more than moving its input: a file of one row group is otherwise one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = len(rows._jdf.inputFiles())  # counted where they are, as their names would be many
    return rows.repartition(cores) if files < cores else rows


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers, whatever their path (once a session)."""
    from pathlib import Path

    root, context = Path(__file__).resolve().parent, spark.sparkContext
    if getattr(context, "_skeinfeed_shipped", False):
        return
    context._skeinfeed_shipped = True
    folder = tempfile.mkdtemp(prefix="skeinfeed-code-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "skeinfeed"), "zip", root.parent, root.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the folder of setCheckpointDir.

    An own one stands in only in local mode (tests); on a cluster its executors would not share it, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and (set_dir := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        path = set_dir.get()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        global _own_dir
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="skeinfeed-")
            atexit.register(shutil.rmtree, _own_dir, True)
        path = _own_dir
    return path.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        remove_path(t.sparkSession, t._written_to)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows (counted, stopping early), else df unchanged.

    Counting runs df once more: costly inputs should be written first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
