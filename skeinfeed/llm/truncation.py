"""Texts cut off by field limits or mid-transfer, and how often each source cuts.

The story text of each value (page lines, garbling and marks of a cut taken off) gives a length in characters and bytes.
Per source and field the lengths of unended values make a histogram; a spike at its upper end is a field limit. Values at
a limit without closing mark are cut. As many texts are cut elsewhere, a value that stops inside a sentence counts too,
unless it is a headline: the row's own title, or a line built as a whole known title is, or one whose end is at least as
often the end of a title as it stands inside running sentences. That share does not depend on the size of the corpus.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinfeed.llm.garbled import ungarbled
from skeinfeed.llm.page_body import _NAME, line_tokens
from skeinfeed.llm.page_lines import ENDS, is_figures, kind_of, runs_on, tidy, without_mark
from skeinfeed.session import small, written

#: A length is a limit if at least so many unended values have it and at least this share of the unended values that are as long or up to a tenth shorter.
SPIKE_VALUES, SPIKE_SHARE = 5, 0.2
#: Ends of titles (their last two words) count from so many distinct titles on.
TAIL_TITLES = 3
OPEN, HEADLINE, CUT, ENDED = "open", "headline", "cut", "ended"


def _plain(text: str) -> str:
    return " ".join(c for c in "".join(x if x.isalnum() or unicodedata.category(x)[0] == "M" else " " for x in tidy(text).lower()).split())


def tail_of(text: str) -> str | None:
    """The last two tokens of a line, in the form in which ends of titles are counted; with its first two where it ends in a name."""
    tokens = line_tokens(text)
    if len(tokens) < 3:
        return None
    return " ".join(tokens[-2:] if tokens[-1] != _NAME else [*tokens[:2], "..", *tokens[-2:]])


_NUMBERS = re.compile(r"\d+(?:[.,]\d+)*")
_SENTENCE = re.compile(r"(?<=[.!?।॥])[\"'”“’»)\]]*\s")


def build_of(text: str) -> str | None:
    """The tokens of a whole line but its first (often a place), names collapsed and numbers as 0: how a title is built."""
    tokens = line_tokens(text)
    return _NUMBERS.sub("0", " ".join(tokens[1:])) if len(tokens) >= 3 else None


def running_tails(line: str) -> Iterator[str]:
    """What tail_of() would give for the first sentence of an ended line if it were cut behind any of its words."""
    tokens = line_tokens(_SENTENCE.split(line, maxsplit=1)[0])
    for k in range(2, len(tokens) - 1):
        yield f"{tokens[k - 1]} {tokens[k]}" if tokens[k] != _NAME else f"{tokens[0]} {tokens[1]} .. {tokens[k - 1]} {tokens[k]}"


def story_lines(text: str) -> list[tuple[str, bool | None, str]]:
    """(tidied line, kind, line) of the non-blank lines that are not page furniture; kind None where a line is undecided.

    An undecided line in front of a line that is surely the story's is a link, as stories are cut only at their end.
    """
    kept = []
    for line in ungarbled(text).split("\n"):
        if line and not line.isspace() and not (kind := kind_of(line)):
            kept.append((" ".join(line.split()), kind, line))
    if all(kind is False for _, kind, _ in kept):
        return kept
    sure = max((k for k, x in enumerate(kept) if x[1] is False), default=-1)
    return [x for k, x in enumerate(kept) if x[1] is False or k > sure or runs_on(x[0])]


def judge_value(text: str, title: str | None, whole_page: bool, source: str = "") -> tuple[str, str, str | None]:
    """(state, story, line): how a value ends, its story text, and its last line where that may be a headline."""
    lines = story_lines(text) if whole_page or "\n" in text else [(" ".join(ungarbled(text).split()), None, text)]
    if not lines:
        return ENDED, "", None
    sure = [k for k, x in enumerate(lines) if x[1] is False]
    run = [] if len(sure) == len(lines) else [k for k, x in enumerate(lines) if x[1] is None and runs_on(x[0])]
    if run:
        at = run[-1]
    elif sure:
        at = min(sure[-1] + 1, len(lines) - 1)  # an undecided line right behind the story, or its last line
    else:
        at = 0
    last, story = lines[at][0], "\n".join(x for _, _, x in lines[: at + 1]).strip()
    bare, marked = without_mark(last)
    story = without_mark(story)[0] if marked else story
    if not bare:
        return ENDED, story, None
    if ENDS.search(bare) and not (bare.endswith(("…", "...")) and not marked):
        return ENDED, story, None
    if is_figures(bare) and not marked:
        return ENDED, story, None
    if marked or runs_on(last):
        return CUT, story, None
    if title:
        own, said = _plain(title), _plain(last)
        if own and (said == own or said.startswith(own + " ") or own.endswith(" " + said)):
            return HEADLINE, story, None
    if source and last.lower().endswith(source):
        last = last[: -len(source)].rstrip(" |–—-")
    return OPEN, story, last.rsplit("; ", 1)[-1]


_FORMS = pa.schema([("_tail", pa.string()), ("_build", pa.string()), ("_n", pa.int64())])


def _titles(titles: DataFrame, title: str) -> DataFrame:
    """(_tail, _build, _n): the end and the build of each distinct title, and how many rows bear it."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tidied = [tidy(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([tail_of(t) for t in tidied], pa.string()), pa.array([build_of(t) for t in tidied], pa.string()), batch.column(1)], schema=_FORMS)

    return titles.filter(F.col(title).isNotNull()).groupBy(title).agg(F.count("*").alias("_n")).mapInArrow(forms, "_tail string, _build string, _n bigint").filter("_tail is not null")


_STATES = pa.schema([("_key", pa.int64()), ("_source", pa.string()), ("field_name", pa.string()), ("state", pa.string()), ("chars", pa.int32()), ("bytes", pa.int32()), ("_tail", pa.string()), ("_build", pa.string()), ("_n", pa.int64())])
#: Counts of running ends that a task holds before it hands them on.
HELD_TAILS = 200_000


def value_states(rows: DataFrame, key: str = "row_id", source: str = "source", title: str = "title", fields: tuple[str, ...] = ("description", "content"), pages: tuple[str, ...] = ("content",)) -> DataFrame:
    """(_key, _source, field_name, state, chars, bytes, _tail, _build) of each non-blank value; rows without a key say how
    often (_n) a _tail stands inside running sentences."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: Counter[str] = Counter()

        def counts() -> pa.RecordBatch:
            columns = {"_tail": pa.array(running.keys(), pa.string()), "_n": pa.array(running.values(), pa.int64())}
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(running), f.type)) for f in _STATES], schema=_STATES)

        for batch in batches:
            keys, sources, titles = (batch.column(i).to_pylist() for i in range(3))
            out: list[list] = [[] for _ in _STATES.names]
            for f, field in enumerate(fields):
                for k, s, t, value in zip(keys, sources, titles, batch.column(3 + f).to_pylist()):
                    if value and value.strip():
                        state, story, line = judge_value(value, t, field in pages, s)
                        for x in story.split("\n"):
                            if ENDS.search(x[-12:]) and not is_figures(x):
                                running.update(running_tails(x))
                        for column, x in zip(out, (k, s, field, state, len(story), len(story.encode("utf-8", "replace")), line and tail_of(line), line and build_of(line), None)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _STATES.types)], schema=_STATES)
            if len(running) > HELD_TAILS:
                yield counts()
                running.clear()
        yield counts()

    named = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.lower(F.trim(F.coalesce(F.col(source), F.lit("")))), title, *fields)
    return named.mapInArrow(states, "_key bigint, _source string, field_name string, state string, chars int, bytes int, _tail string, _build string, _n bigint")


def field_limits(states: DataFrame) -> DataFrame:
    """(_source, field_name, unit, length, n): spikes at the upper end of the length histograms of unended values."""
    unended = states.filter(F.col("state") != ENDED)
    bins = unended.select("_source", "field_name", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")))).alias("b")).groupBy("_source", "field_name", "b.unit", "b.length").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_source", "field_name", "unit")
    # on a logarithmic scale the lengths from nine tenths up to a length are a range of fixed width
    scale = F.round(F.log(F.col("length").cast("double")) / math.log(10 / 9) * 1_000_000).cast("bigint")
    spikes = bins.filter("length > 0").withColumn("_at", scale).withColumns({
        "near": F.sum("n").over(group.orderBy("_at").rangeBetween(-1_000_000, 0)),
        "beyond": F.coalesce(F.sum("n").over(group.orderBy("length").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)),
    }).drop("_at")
    return spikes.filter((F.col("n") >= SPIKE_VALUES) & (F.col("n") >= SPIKE_SHARE * F.col("near")) & (F.col("beyond") <= F.col("n"))).drop("near", "beyond")


def truncated_values(rows: DataFrame, key: str = "row_id", source: str = "source", title: str = "title", fields: tuple[str, ...] = ("description", "content"), pages: tuple[str, ...] = ("content",)) -> DataFrame:
    """(_source, key, field_name, chars, at_limit, truncated) of every non-blank value.

    A value is truncated if its story text has no closing mark at its end and it stands at a field limit, bears a mark of
    a cut, runs on after a sentence, or is no headline. Null and blank values give no row; rows with a null source are
    judged together; repeated rows are judged alike; long texts are read whole; other columns are ignored.
    """
    judged = written(rows.sparkSession, value_states(rows, key, source, title, fields, pages), "value-states")
    states = judged.filter("_key is not null").drop("_n")
    limits = written(rows.sparkSession, field_limits(states), "field-limits")
    marked = states
    for unit in ("chars", "bytes"):
        at = limits.filter(F.col("unit") == unit).select("_source", "field_name", F.col("length").alias(unit), F.lit(True).alias(f"_at_{unit}"))
        marked = marked.join(small(at), ["_source", "field_name", unit], "left")
    titles = written(rows.sparkSession, _titles(rows, title), "title-forms")
    builds = titles.select("_build", F.lit(True).alias("_known")).distinct()
    running = judged.filter("_key is null").groupBy("_tail").agg(F.sum("_n").alias("_running"))
    ends = titles.groupBy("_tail").agg(F.count("*").alias("_titles"), F.sum("_n").alias("_rows")).filter(F.col("_titles") >= TAIL_TITLES)
    tails = ends.join(running, "_tail", "left").filter(F.col("_rows") >= F.coalesce("_running", F.lit(0))).select("_tail", "_titles")
    headline = F.col("_titles").isNotNull() | F.col("_known").isNotNull()
    undecided = marked.filter(F.col("state") == OPEN).join(tails, "_tail", "left").join(builds, "_build", "left").withColumn("truncated", ~headline | F.coalesce("_at_chars", "_at_bytes", F.lit(False)))
    decided = marked.filter(F.col("state") != OPEN).withColumn("truncated", F.col("state") == CUT)
    columns = ["_source", F.col("_key").alias(key), "field_name", "chars", F.coalesce("_at_chars", "_at_bytes", F.lit(False)).alias("at_limit"), "truncated"]
    return undecided.select(*columns).unionByName(decided.select(*columns))


def truncation_report(rows: DataFrame, **names) -> DataFrame:
    """(source, field_name, n_values, n_truncated, n_at_limit, share) for each source and field."""
    values = truncated_values(rows, **names)
    return values.groupBy(F.col("_source").alias("source"), "field_name").agg(F.count("*").alias("n_values"), F.count_if("truncated").alias("n_truncated"), F.count_if(F.col("truncated") & F.col("at_limit")).alias("n_at_limit")).withColumn("share", F.col("n_truncated") / F.col("n_values"))
