"""The story of a page without menus, notices and links around it.

The token streams of a host's pages are taken as one text, and the strings in it that repeat on distinct pages decide. What
a sorted suffix array would lay side by side, the suffixes with the same beginning, is brought together by a hash of that
beginning: the shortest string of two words that are no names. So a host of any size is counted whole, in sums that merge.
Of each string it is counted how often it stands anywhere, how often it opens a line and how often it closes one, and on
which pages. Page furniture is filled into a layout line by line: its strings are bound to the ends of lines on page after
page. The strings of a story run on: sentences stand first, last and in the middle of paragraphs. Whole lines that come
back within stories are told by their place: story lines stand on both sides of them, or a page has no others. What repeats nowhere is unique and is
kept, unless it is of a known form of furniture (`page_lines`); that last step can be left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinfeed.llm.page_lines import ENDS, furniture, is_figures, tidy, without_mark
from skeinfeed.session import released, small, written

#: Bytes of distinct lines that a task counts before it hands their counts on; the result does not depend on it.
BLOCK_BYTES = 4_000_000
#: Share of a string's places that must be line ends for it to be bound to them; share of a line's places between story lines (or on pages that have none) from which it belongs to the story.
BOUND, WITHIN = 0.7, 0.4
_NAME = "•"
#: A sentence that ends within a line.
_INNER_END = re.compile(r"(?<![\d\s])[.!?।॥][\"'”“’»)]*\s+\S")


def host_key(url: Column, source: Column) -> Column:
    """The host of a page, or its source where the url names none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#\s]+)", 1)), r"^www\.", "")
    return F.when(host != "", host).otherwise(F.concat(F.lit("source:"), F.coalesce(F.lower(F.trim(source)), F.lit(""))))


def line_tokens(text: str) -> list[str]:
    """Tokens of a line: lower case, digits as 0, capitalised words inside a line (names) as one mark."""
    shout = text.upper() == text and text.lower() != text
    out: list[str] = []
    for k, word in enumerate(text.split()):
        if k and not shout and word[0].isupper():
            if out[-1] != _NAME:
                out.append(_NAME)
        else:
            out.append(word.lower())
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ENDED, _RUNS, _FIGURES, _LISTED = 1, 2, 4, 8
_COUNTS = ("_n", "_opens", "_open_low", "_open_high", "_closes", "_close_low", "_close_high")
_COUNTED = pa.schema([*((c, pa.int64()) for c in ("_stat", *_COUNTS, "_a", "_b", "_opening", "_closing")), ("_flags", pa.int32())])
_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class _Block:
    """Distinct lines of any hosts, and the counts of their strings by hash."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.lines: list[tuple] = []
        self.texts: list[str] = []
        self.bytes = 0

    def add(self, vocabulary: dict[str, int], host: int, a: int, b: int, line: str, n: int, low: int, high: int) -> None:
        text = tidy(line)
        tokens = line_tokens(text)
        if not tokens:
            return
        for t in tokens:
            if (k := vocabulary.get(t)) is None:
                k = vocabulary[t] = int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            self.ids.append(k)
        self.lengths.append(len(tokens))
        flags = _ENDED * (ENDS.search(text[-12:]) is not None) | _RUNS * (_INNER_END.search(text) is not None or without_mark(text)[1]) | _FIGURES * is_figures(text)
        self.lines.append((host, a, b, n, low, high, flags))
        self.texts.append(line)
        self.bytes += len(line) * 2 + 16

    def counted(self, name: int, phrases: bool) -> Iterator[pa.RecordBatch]:
        if not self.lines:
            return
        hosts, a, b, n, low, high, flags = (np.asarray(c, np.int64) for c in zip(*self.lines))
        lengths, ids = np.asarray(self.lengths), np.asarray(self.ids, np.uint64)
        ends = np.cumsum(lengths)
        starts, line_of = ends - lengths, np.repeat(np.arange(len(lengths)), lengths)
        at, named = np.arange(len(ids)), ids == np.uint64(name)
        is_name = lambda p: named[np.clip(p, 0, len(ids) - 1)]
        # names never stand side by side, so two words that are none lie within four tokens
        forth = np.minimum(at + named + 1 + is_name(at + named + 1), ends[line_of] - 1)
        back = np.maximum(at - named - 1 - is_name(at - named - 1), starts[line_of])
        # by_size[k - 1][p]: the hash of the k tokens from p on
        by_size = [_mixed(ids + hosts.view(np.uint64)[line_of])]
        for k in range(1, 4):
            by_size.append(_mixed(by_size[-1] * np.uint64(3) + np.concatenate((ids[k:], np.zeros(k, np.uint64)))[: len(ids)]))
        by_size = np.stack(by_size)
        spans = by_size[forth - at, at]
        to_names = at[named]
        opening, closing = spans[starts], by_size[ends - 1 - back[ends - 1], back[ends - 1]]
        keys, inverse = np.unique(np.concatenate((spans, by_size[to_names - back[to_names], back[to_names]], opening, closing)), return_inverse=True)
        anywhere, opens, closes = np.split(inverse, np.cumsum((len(spans) + len(to_names), len(opening))))
        sums = {c: np.zeros(len(keys), np.int64) for c in ("_n", "_opens", "_closes")}
        bounds = {c: np.full(len(keys), _LOW if c.endswith("low") else _HIGH) for c in _COUNTS if c not in sums}
        np.add.at(sums["_n"], anywhere, n[np.concatenate((line_of, line_of[to_names]))])
        for kind, where in (("open", opens), ("close", closes)):
            np.add.at(sums[f"_{kind}s"], where, n)
            np.minimum.at(bounds[f"_{kind}_low"], where, low)
            np.maximum.at(bounds[f"_{kind}_high"], where, high)
        yield _filled(len(keys), _stat=keys.view(np.int64), **sums, **bounds)
        if phrases:
            # what repeats within the block repeats within its host, and is judged by that
            alone = (bounds["_open_low"] == bounds["_open_high"])[opens] & (bounds["_close_low"] == bounds["_close_high"])[closes]
            flags |= np.asarray([_LISTED if x and furniture(t) else 0 for x, t in zip(alone, self.texts)])
        yield _filled(len(a), _a=a, _b=b, _opening=opening.view(np.int64), _closing=closing.view(np.int64), _flags=flags.astype(np.int32))


def _filled(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _COUNTED], schema=_COUNTED)


#: What a candidate is: furniture by its strings, or a line whose place on its pages has yet to be looked at.
_SURE, _BY_PLACE = 1, 2


def _candidates(distinct: DataFrame, block_bytes: int, phrases: bool) -> DataFrame:
    """(_a, _b, _closing, _class) of the lines, out of distinct lines (_host, _a, _b, _line, _n, _low, _high), that may be furniture."""
    name = int.from_bytes(hashlib.blake2b(_NAME.encode(), digest_size=8).digest(), "little")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[str, int] = {}
        block = _Block()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(vocabulary, *row)
                if block.bytes >= block_bytes:
                    yield from block.counted(name, phrases)
                    block = _Block()
            if len(vocabulary) > 500_000:
                vocabulary.clear()
        yield from block.counted(name, phrases)

    spark = distinct.sparkSession
    schema = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in _COUNTED)
    rows = written(spark, distinct.select("_host", "_a", "_b", "_line", "_n", "_low", "_high").mapInArrow(count, schema), "page-counts")
    merged = [F.min(c).alias(c) if c.endswith("low") else F.max(c).alias(c) if c.endswith("high") else F.sum(c).alias(c) for c in _COUNTS]
    strings = rows.filter("_stat is not null").groupBy("_stat").agg(*merged).filter("_opens > 0 or _closes > 0")
    strings = written(spark, strings, "page-strings")
    closings = strings.filter("_closes > 0").select(F.col("_stat").alias("_closing"), (F.col("_closes") >= BOUND * F.col("_n")).alias("_close_bound"), (F.col("_close_low") != F.col("_close_high")).alias("_close_repeats"))
    openings = strings.filter("_opens > 0").select(F.col("_stat").alias("_opening"), (F.col("_opens") >= BOUND * F.col("_n")).alias("_open_bound"), (F.col("_open_low") != F.col("_open_high")).alias("_open_repeats"))
    has = lambda flag: F.col("_flags").bitwiseAND(flag) != 0
    prose = has(_ENDED) | has(_RUNS)
    lines = rows.filter("_a is not null").select("_a", "_b", "_opening", "_closing", "_flags")
    # most lines of stories close in strings that run on elsewhere; they need no further look
    open_ = lines.join(closings, "_closing").filter(~prose | has(_LISTED) | (F.col("_close_bound") & F.col("_close_repeats"))).join(openings, "_opening")
    bound = F.col("_close_bound") & F.col("_close_repeats") & F.col("_open_bound")
    repeats = F.col("_open_repeats") | F.col("_close_repeats")
    class_ = F.when(bound | (~prose & repeats), F.when(has(_ENDED) | has(_FIGURES), _BY_PLACE).otherwise(_SURE)).when(has(_LISTED) & ~repeats, _SURE)
    found = written(spark, open_.select("_a", "_b", "_closing", class_.alias("_class")).filter("_class is not null"), "page-candidates")
    released(rows, strings)
    return found


def boilerplate_lines(pages: DataFrame, key: str = "row_id", text: str = "content", url: str = "url", source: str = "source", block_bytes: int = BLOCK_BYTES, phrases: bool = True) -> DataFrame:
    """(key, line_no) of the non-blank lines of `text` that are page furniture; line_no counts from 1, blank lines included.

    Null and empty texts give nothing. Repeated pages give the same lines under each key and count as one page. The only
    line of a text is its story, and so is a last line that was cut. Long texts are taken whole; other columns are
    ignored. `phrases` lets known forms of furniture decide about lines of which no string repeats.
    """
    spark = pages.sparkSession
    masked = F.regexp_replace(F.regexp_replace(F.col("_raw"), r"(?U)^\s+|\s+$", ""), r"\d+(?:[.,]\d+)*", "0")
    lines = (
        pages.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_page"), F.xxhash64(host_key(F.col(url), F.col(source))).alias("_host"), F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_raw"))
        .select("_key", "_page", "_host", "_pos", masked.alias("_line")).filter(F.col("_line") != "")
        .select("_key", "_page", "_pos", "_host", F.xxhash64("_host", "_line").alias("_a"), F.xxhash64(F.lit(1), "_host", "_line").alias("_b"), "_line")
    )
    lines = written(spark, lines, "page-lines")
    distinct = lines.groupBy("_a", "_b").agg(F.first("_host").alias("_host"), F.first("_line").alias("_line"), F.count("*").alias("_n"), F.min("_page").alias("_low"), F.max("_page").alias("_high"))
    candidates = _candidates(distinct, block_bytes, phrases)
    page = Window.partitionBy("_key", "_page")
    story = F.when(F.col("_class").isNull(), F.col("_pos"))
    inside = F.coalesce((F.min(story).over(page) < F.col("_pos")) & (F.max(story).over(page) > F.col("_pos")), F.lit(True))
    placed = lines.select("_key", "_page", "_pos", "_a", "_b").join(candidates, ["_a", "_b"], "left").withColumns({"_inside": inside, "_lines": F.count("*").over(page)})
    marked = written(spark, placed.filter("_class is not null and _lines > 1").select("_key", "_pos", "_closing", "_class", "_inside"), "page-marked")
    released(lines, candidates)
    by_place = marked.filter(F.col("_class") == _BY_PLACE).groupBy("_closing").agg(F.avg(F.col("_inside").cast("int")).alias("_share"))
    within = written(spark, by_place.filter(F.col("_share") >= WITHIN).select(F.col("_closing").alias("_within")), "page-within")
    found = marked.join(small(within), (F.col("_closing") == F.col("_within")) & (F.col("_class") == _BY_PLACE), "left_anti")
    return found.select(F.col("_key").alias(key), (F.col("_pos") + 1).cast("int").alias("line_no"))


def main_body(pages: DataFrame, key: str = "row_id", text: str = "content", url: str = "url", source: str = "source") -> DataFrame:
    """`pages` with `text` reduced to the lines that are no page furniture; null stays null, order and blanks are kept."""
    gone = boilerplate_lines(pages, key, text, url, source).groupBy(key).agg(F.collect_list("line_no").alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n"), lambda _, i: ~F.coalesce(F.array_contains(F.col("_gone"), (i + 1).cast("int")), F.lit(False)))
    return pages.join(gone, key, "left").withColumn(text, F.array_join(kept, "\n")).drop("_gone")
