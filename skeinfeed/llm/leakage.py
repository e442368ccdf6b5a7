"""Held-out evaluation texts inside a corpus: one Aho-Corasick automaton over all windows of their words.

Each Python worker builds the automaton once. Items are sent to the workers only in blocks of bounded size; a set of items
beyond one block is scanned block by block.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinfeed.session import written

#: Characters of items in one block: each begins a window of some eighty characters, so an automaton has some thirteen times as many nodes.
BLOCK_CHARS = 400_000
# Invisible characters that Unicode classes as marks or letters.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Plain(dict):
    """For str.translate: drops punctuation, symbols, controls and invisible characters, makes every blank a space."""

    def __missing__(self, code: int):
        c = chr(code)
        value = " " if c.isspace() else None if unicodedata.category(c)[0] in "PSCZ" or code in _INVISIBLE else code
        self[code] = value
        return value


_PLAIN = _Plain()


def plain_words(text: str) -> list[str]:
    """The words that count: parted by blanks, without case, punctuation and invisible characters."""
    return unicodedata.normalize("NFC", text).lower().translate(_PLAIN).split()


def _spans(text: str) -> list[tuple[int, int]]:
    """Start and end in `text` of each word of plain_words(text)."""
    return [m.span() for m in re.finditer(r"\S+", text) if plain_words(m[0])]


def _automaton(items: list[tuple[int, str]], window: int):
    import ahocorasick

    a = ahocorasick.Automaton()
    for item, text in items:
        words = plain_words(text)
        for i in range(len(words) - window + 1):
            key = f" {' '.join(words[i : i + window])} "
            if key not in a:
                a.add_word(key, set())
            a.get(key).add(item)
    if len(a):
        a.make_automaton()
    return a


#: The automaton that this worker built last, by the name of its block.
_LAST: dict[str, object] = {}


def _built(name: str, items: list[tuple[int, str]], window: int):
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = _automaton(items, window)
    return _LAST[name]


def _scanned(docs: DataFrame, items: list[tuple[int, str]], window: int, schema: str, out: pa.Schema) -> DataFrame:
    name, share = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _built(name, share.value, window)
        for batch in batches:
            found: list[tuple] = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(a) else ():
                flat = f" {' '.join(plain_words(value))} "
                hits: dict[int, list[int]] = {}
                for end, members in a.iter(flat):
                    for m in members:
                        hits.setdefault(m, []).append(end)
                if hits:
                    spans, blanks = _spans(value), [i for i, c in enumerate(flat) if c == " "]
                    for m, ends in hits.items():
                        # a window ends in the blank behind its last word; as many words stand before it as blanks but the first
                        last = [bisect_right(blanks, e) - 1 for e in (min(ends), max(ends))]
                        found.append((m, key, len(ends), spans[last[0] - window][0], spans[last[1] - 1][1]))
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, f)) for f in found], schema=out)

    return docs.mapInArrow(scan, schema)


def contained_items(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, doc, windows, first_char, end_char): each item and document that share `window` consecutive words.

    `windows` counts the shared windows, first_char and end_char bound them in the document's own text. Null, empty and
    shorter texts and items contain nothing; equal items and documents are each reported under their own id; an item id
    given twice counts once. Long texts are scanned whole. Other columns are ignored, whatever their names. The result
    does not depend on block_chars.
    """
    rows = items.filter(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("bigint").alias("k"), F.col(item_text).alias("t"))
    schema = f"{item} bigint, {doc} bigint, windows int, first_char int, end_char int"
    out = pa.schema([(item, pa.int64()), (doc, pa.int64()), ("windows", pa.int32()), ("first_char", pa.int32()), ("end_char", pa.int32())])
    texts = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("bigint"), text)
    blocks = max(1, -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    found = None
    for b in range(blocks):
        block = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b)
        part = _scanned(texts, [(r[0], r[1]) for r in block.toLocalIterator()], window, schema, out)
        if blocks > 1:
            part = written(docs.sparkSession, part, "leaks")
        found = part if found is None else found.unionByName(part)
    return found
