"""Lines that come back in document after document of one source.

Per-source line counts are kept as tables that grow by deltas: a new partition of documents adds only the (source,
line, document) triples not seen before, and the lines that newly cross the threshold (in either direction, as the 2 %
move with the source's size) are reported, so that only documents holding such a line are rebuilt. What a delta adds is a
version of its own; readers sum the versions, which are merged from time to time. Triples lie in buckets by document, so a
delta looks only into the buckets of its own documents. The tables last: a later process goes on with the same path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinfeed.session import remove_path, shared_dir, small, written

_TRIPLE = ["source_key", "line_a", "line_b", "doc_a", "doc_b"]
_LINE = _TRIPLE[:3]
#: Buckets of documents, by their hash; versions of the tables that are merged into one.
BUCKETS, MERGE_AT = 16, 8
# The columns of the tables, members and triples within their buckets.
_KEYS = "source_key string, line_a bigint, line_b bigint"
_TABLES = {"docs": "source_key string, doc_a bigint, doc_b bigint, bucket int", "triples": f"{_KEYS}, doc_a bigint, doc_b bigint, bucket int", "totals": "source_key string, n bigint", "counts": f"{_KEYS}, n bigint"}


def source_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""))


def line_key(col: Column) -> Column:
    """Lines compare without case, outer blanks and runs of blanks."""
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"(?U)\s+", " "), "^ | $", ""))


def _hashes(col: Column, name: str) -> list[Column]:
    """128 bits of two differently seeded hashes, in place of the text."""
    return [F.xxhash64(col).alias(f"{name}_a"), F.xxhash64(F.lit(name), col).alias(f"{name}_b")]


def numbered_lines(docs: DataFrame, key: str, text: str, source: str, doc: str | None = None, more: list[str] | None = None) -> DataFrame:
    """(key, source_key, line_no, line_a, line_b) of each non-blank line, with doc_a and doc_b of `doc` and the columns `more`; line_no counts from 1, blank lines included."""
    of_doc = _hashes(F.col(doc), "doc") if doc else []
    lines = docs.filter(F.col(source).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), source_key(F.col(source)).alias("source_key"), *(F.when(F.col(doc).isNotNull(), c).alias(n) for c, n in zip(of_doc, _TRIPLE[3:])), *(more or []), F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_line")
    ).withColumn("_line", line_key(F.col("_line")))
    return lines.filter(F.col("_line") != "").select(F.col("_key").alias(key), "source_key", *_TRIPLE[3 : 3 + len(of_doc)], *(more or []), (F.col("_pos") + 1).cast("int").alias("line_no"), *_hashes(F.col("_line"), "line"))


class LineCounts:
    """Incremental line counts of each source, in tables under `path` (default: the shared folder).

    A line is excessive if it stands in at least `min_docs` and at least `min_share` of the distinct documents of its
    source; all documents of the source count, with or without text. Rows with a null source, document id or text add
    no lines; a document seen again adds only lines not counted for it before; empty input changes nothing. A path that
    holds tables is gone on with; one process at a time may update it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, doc: str = "article_id", text: str = "content", source: str = "source", min_docs: int = 5, min_share: float = 0.02):
        self.spark, self.doc, self.text, self.source, self.min_docs, self.min_share = spark, doc, text, source, min_docs, min_share
        self.path = path or f"{shared_dir(spark)}/line-counts-{uuid.uuid4().hex}"
        # an update ends with its mark; what a broken one left behind has none and is written anew
        self.versions = sorted(int(name[2:]) for name in self._listed("done") if name.startswith("v="))

    @property
    def version(self) -> int:
        return self.versions[-1] if self.versions else 0

    def _listed(self, kind: str) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _read(self, kind: str) -> DataFrame | None:
        return self.spark.read.schema(f"{_TABLES[kind]}, v int").option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/v={v}" for v in self.versions)).drop("v") if self.versions else None

    def _write(self, kind: str, rows: DataFrame, version: int) -> DataFrame:
        """rows as the version of a table; members and triples in the buckets of their documents."""
        to = f"{self.path}/{kind}/v={version}"
        bucketed = "bucket" in rows.columns
        # a bucket is written by as many tasks as its share of the partitions, each of its own documents
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS + 1)
        writer = (rows.repartition(F.col("bucket"), F.pmod(F.col("doc_b"), F.lit(parts))) if bucketed else rows).write.mode("overwrite")
        (writer.partitionBy("bucket") if bucketed else writer).parquet(to)
        return self.spark.read.schema(rows.schema).parquet(to)

    def _done(self, version: int) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done/v={version}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)

    def _added(self, kind: str, new: DataFrame, keys: list[str], version: int, buckets: list[int]) -> DataFrame:
        """The distinct rows of `new` that no earlier version holds, written as this version."""
        new = new.distinct()
        if (old := self._read(kind)) is not None:
            new = new.join(old.filter(F.col("bucket").isin(buckets)).select(*keys), keys, "left_anti")
        return self._write(kind, new, version)

    def update(self, delta: DataFrame, lines: DataFrame | None = None, report: bool = True) -> DataFrame | None:
        """Merge a partition of documents; returns the lines whose state changed (source_key, line_a, line_b, excessive), unless report is false.

        `lines` may bring the numbered_lines() of the delta with its documents, if they were worked out before.
        """
        before = written(self.spark, self.excessive().select(*_LINE), "lines-before") if report and self.versions else None
        version = self.version + 1
        bucket = F.pmod(F.col("doc_a"), F.lit(BUCKETS)).cast("int").alias("bucket")
        members = delta.filter(F.col(self.source).isNotNull() & F.col(self.doc).isNotNull()).select(source_key(F.col(self.source)).alias("source_key"), *_hashes(F.col(self.doc), "doc"))
        if lines is None:
            lines = numbered_lines(delta.withColumn("_row", F.lit(0)), "_row", self.text, self.source, self.doc)
        buckets = [r[0] for r in members.select(bucket).distinct().collect()] if self.versions else []  # BUCKETS at most
        added = self._added("docs", members.select("*", bucket), ["source_key", "doc_a", "doc_b"], version, buckets)
        triples = self._added("triples", lines.filter("doc_a is not null").select(*_TRIPLE, bucket), _TRIPLE, version, buckets)
        for kind, rows, by in (("totals", added, ["source_key"]), ("counts", triples, _LINE)):
            self._write(kind, rows.groupBy(by).agg(F.count("*").alias("n")), version)
        self._done(version)
        self.versions.append(version)
        if len(self.versions) >= MERGE_AT:
            self._merge()
        if not report:
            return None
        now = self.excessive().select(*_LINE)
        if before is None:
            return now.withColumn("excessive", F.lit(True))
        both = now.withColumn("_now", F.lit(True)).join(before.withColumn("_was", F.lit(True)), _LINE, "full_outer")
        return written(self.spark, both.filter("_now is null or _was is null").select(*_LINE, F.col("_now").isNotNull().alias("excessive")), "lines-changed")

    def _merge(self) -> None:
        """All versions as one, behind which the old ones go."""
        old, version = self.versions, self.version + 1
        for kind, by in (("docs", None), ("triples", None), ("totals", ["source_key"]), ("counts", _LINE)):
            rows = self._read(kind)
            self._write(kind, rows if by is None else rows.groupBy(by).agg(F.sum("n").alias("n")), version)
        # readers take the versions that bear a mark: first the old marks go, the merged one comes last
        remove_path(self.spark, f"{self.path}/done")
        self._done(version)
        self.versions = [version]
        for kind in ("docs", "triples", "totals", "counts"):
            for v in old:
                remove_path(self.spark, f"{self.path}/{kind}/v={v}")

    def excessive(self) -> DataFrame:
        """(source_key, line_a, line_b, n, total) of the lines over the threshold as of the last update."""
        totals = self._read("totals").groupBy("source_key").agg(F.sum("n").alias("total"))
        counts = self._read("counts").groupBy(*_LINE).agg(F.sum("n").alias("n")).filter(F.col("n") >= self.min_docs)
        return counts.join(small(totals), "source_key").filter(F.col("n") >= self.min_share * F.col("total") - 1e-9)

    def occurrences(self, docs: DataFrame, key: str = "row_id", lines: DataFrame | None = None) -> DataFrame:
        """(key, line_no) of each line of `docs` (or of their numbered `lines`) that is excessive within its source."""
        lines = numbered_lines(docs, key, self.text, self.source) if lines is None else lines
        return lines.join(small(written(self.spark, self.excessive().select(*_LINE), "lines-excessive")), _LINE, "left_semi").select(key, "line_no")

    def rebuilt(self, docs: DataFrame, key: str = "row_id", changed: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
        """`docs` (with `changed`: only those holding a line that changed) with the excessive lines taken out of the text.

        Null texts stay null; a text of which nothing is left becomes empty. Column names are kept.
        """
        lines = numbered_lines(docs, key, self.text, self.source) if lines is None else lines
        if changed is not None:
            docs = docs.join(self.holding(lines, changed, key), key, "left_semi")
        gone = self.occurrences(docs, key, lines).groupBy(key).agg(F.collect_list("line_no").alias("_gone"))
        kept = F.filter(F.split(F.col(self.text), "\n"), lambda _, i: ~F.coalesce(F.array_contains(F.col("_gone"), (i + 1).cast("int")), F.lit(False)))
        return docs.join(gone, key, "left").withColumn(self.text, F.array_join(kept, "\n")).drop("_gone")

    def holding(self, lines: DataFrame, changed: DataFrame, key: str = "row_id") -> DataFrame:
        """The keys of documents that hold a changed line."""
        return lines.join(small(changed.select(*_LINE)), _LINE, "left_semi").select(key).distinct()
