"""Texts of varying length into containers of a fixed number of tokens.

Best fit with conflicts: texts come longest first, bins are ordered by what is left in them, and the search goes on from
the tightest bin a text fits into to the next until one is compatible: no bin holds two copies of a text, and, if asked
for, no two texts of one source. Bins carry bitmaps of the sources and of the clusters of equal texts they hold. Copies are
equally long and come one after the other, so a cluster of any size takes its bins in one walk. Partitions of bounded size
are packed on their own, then the texts of bins that stayed slack are packed again together, as long as they grow fewer.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinfeed.session import released, written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces packed by one task; more make more groups, by hash of the text's id.
GROUP_PIECES = 30_000
#: Bins at least so full are done; the pieces of the others are packed again.
FULL = 0.98
# Fixed value: the pattern that parts text before byte-pair merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = re.compile(r"\s*\S+|\s+")


class Tokens:
    """Token counts, kept for each run of blanks with the word behind it; they add up, as no token spans a word's end."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, int] = {}

    def count(self, chunk: str) -> int:
        n = self.known.get(chunk)
        if n is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            n = self.known[chunk] = len(self.encoding.encode_ordinary(chunk))
        return n

    def pieces(self, text: str, capacity: int) -> list[tuple[int, int, int]]:
        """(first character, end character, tokens) of the pieces a text is divided into: one, unless it exceeds the capacity."""
        chunks = _CHUNK.findall(text)
        counts = [self.count(c) for c in chunks]
        if sum(counts) <= capacity:
            return [(0, len(text), sum(counts))] if counts else []
        out, start, at, held = [], 0, 0, 0
        for chunk, n in zip(chunks, counts):
            while n > capacity - held and (held or n > capacity):
                if n > capacity:  # a single word beyond the capacity: as many of its characters as fit
                    low, high = 0, len(chunk)
                    while low < high - 1:
                        middle = (low + high) // 2
                        low, high = (middle, high) if self._size(chunk[:middle]) <= capacity - held else (low, middle)
                    if low == 0 and not held:
                        low = 1
                    if low:
                        held += self._size(chunk[:low])
                        at, chunk = at + low, chunk[low:]
                        n = self._size(chunk)
                out.append((start, at, held))
                start, held = at, 0
            at, held = at + len(chunk), held + n
        if at > start:
            out.append((start, at, held))
        return out

    def _size(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, sources_apart: bool = False) -> list[int]:
    """The bin of each piece of (tokens, cluster number, source number); cluster 0 has no copies. Longest first, then by cluster, ties in the given order."""
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], pieces[i][1], i))
    residual, clusters, sources = [], [], []  # of each bin: what is left, bitmaps of the clusters and sources it holds
    left: list[tuple[int, int]] = []  # (what is left, bin), ascending
    place = [0] * len(pieces)
    k = 0
    while k < len(order):
        size, cluster, _ = pieces[order[k]]
        run = k + 1
        while cluster and not sources_apart and run < len(order) and pieces[order[run]][:2] == (size, cluster):
            run += 1
        # copies that differ in nothing else, one after the other: each takes the next tightest compatible bin behind the one before it
        start = at = bisect.bisect_left(left, (size, -1))
        passed, filled = [], []
        for i in order[k:run]:
            cluster_bit, source_bit = 1 << cluster if cluster else 0, 1 << pieces[i][2]
            while at < len(left) and (clusters[left[at][1]] & cluster_bit or (sources_apart and sources[left[at][1]] & source_bit)):
                passed.append(left[at])
                at += 1
            if at < len(left):
                b = left[at][1]
                at += 1
            else:
                b = len(residual)
                residual.append(capacity), clusters.append(0), sources.append(0)
            residual[b] -= size
            clusters[b] |= cluster_bit
            sources[b] |= source_bit
            place[i] = b
            if residual[b] > 0:
                filled.append((residual[b], b))
        if run - k == 1:
            if at > start and (not passed or passed[-1] != left[at - 1]):
                del left[at - 1]
            for x in filled:
                bisect.insort(left, x)
        else:
            left[start:at] = passed
            left = sorted(left + filled)  # two sorted runs
        k = run
    return place


def _numbered(values: list, once: bool) -> list[int]:
    """Small numbers for values; with `once`, values that occur only once share number 0, which conflicts with none."""
    from collections import Counter

    count, seen = Counter(values), {}
    return [0 if once and count[v] == 1 else seen.setdefault(v, len(seen) + 1) for v in values]


_PIECE = "doc_id bigint, part_no int, first_char int, end_char int, n_tokens int, cluster bigint, source_hash bigint"


def packed_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group_pieces: int = GROUP_PIECES, sources_apart: bool = False) -> DataFrame:
    """(container_id, doc, part_no, first_char, end_char, n_tokens): every text's container.

    A text is divided only if it alone exceeds the capacity, between words where it can; its parts join to the whole.
    Copies of a text never share a container; with sources_apart neither do texts of one source. Null and empty texts have no tokens and no container; null sources count
    as one source; other columns are ignored. Ties go by id and part.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
    names = [c.split()[0] for c in _PIECE.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(ranks.value)
        for batch in batches:
            rows = [(k, p + 1, *piece, (c + p) & 0x7FFFFFFFFFFFFFFF, s) for k, t, c, s in zip(*(x.to_pylist() for x in batch.columns)) for p, piece in enumerate(tokens.pieces(t, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    named = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).cast("bigint"), text, F.xxhash64(text), F.xxhash64(F.coalesce(F.col(source), F.lit(""))))
    pieces = written(spark, named.mapInArrow(counted, _PIECE), "pieces")
    out = pa.schema([("container_id", pa.int64()), *zip(names, types)])

    def group_of(df: DataFrame, groups: int) -> DataFrame:
        return df.withColumn("_group", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(groups)))

    def packed(first: int):
        def pack(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            group = group.drop_columns(["_group"]).sort_by([("doc_id", "ascending"), ("part_no", "ascending")])
            clusters, sources = _numbered(group.column("cluster").to_pylist(), True), _numbered(group.column("source_hash").to_pylist(), False)
            place = best_fit(list(zip(group.column("n_tokens").to_pylist(), clusters, sources)), capacity, sources_apart)
            ids = pa.array([(first + key[0].as_py()) * (1 << 24) + b for b in place], pa.int64())
            return pa.Table.from_arrays([ids, *group.columns], schema=out)

        return pack

    done, rest, first, before = [], pieces, 1, None
    while True:
        n = rest.count()
        groups = max(1, -(-n // group_pieces))
        result = written(spark, group_of(rest, groups).groupBy("_group").applyInArrow(packed(first), f"container_id bigint, {_PIECE}"), "packed")
        first += groups
        if groups == 1 or (before is not None and n > before / 2):
            done.append(result)
            break
        before = n
        full = result.groupBy("container_id").agg(F.sum("n_tokens").alias("_sum")).withColumn("_full", F.col("_sum") >= FULL * capacity).drop("_sum")
        marked = written(spark, result.join(full, "container_id"), "packed-full")
        done.append(marked.filter("_full").drop("_full"))
        rest = marked.filter("not _full").drop("_full", "container_id")
        released(result)
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    return union.select("container_id", F.col("doc_id").alias(doc), "part_no", "first_char", "end_char", "n_tokens")
