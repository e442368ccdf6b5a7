"""Languages of documents and of stretches within them, by prediction by partial matching.

For each language a context tree over bytes (of variable order, within words) holds how often each byte followed each
context. With the counts frozen, the code length of a byte is exact: the escapes from longer contexts that never saw it,
then its share in the first that did (escape method C; a byte seen in no context is one of 256). A sentence is in the
language whose tree gives it the shortest code. All trees are sorted arrays, looked up for whole batches of words at once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinfeed.llm.page_lines import is_figures, runs_on, without_mark
from skeinfeed.llm.truncation import story_lines

#: Rows of each stated language that the trees are built from: a bounded sample, chosen by hash, of texts up to so many characters.
TRAIN_ROWS, TRAIN_CHARS = 2_500, 50_000
ORDER = 4
#: Bits by which the best language must lead for a sentence to count; below, the sentence follows its neighbours.
LEAD_BITS = 8.0
# Codes and English names that state a language.
STATED = {
    "en": ("en", "eng", "english"), "te": ("te", "tel", "telugu"), "hi": ("hi", "hin", "hindi"), "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"), "es": ("es", "spa", "spanish", "castilian"),
}
_CODES = {word: code for code, words in STATED.items() for word in words}
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯऀ-෿‌‍’'][^\W\d_]*)*[ऀ-෿]*")
_SENTENCE = re.compile(r"(?<=[.!?।॥])\s+(?=[^\sa-zà-ÿ])|(?<=[.!?।…][”“»\"])\s+(?=[A-ZÀ-ÞА-Я“„«¿¡\"])|(?<=[.!?।…]’)\s+(?=[A-ZÀ-Þ“„«])")


def stated_language(label: str | None) -> str | None:
    """The two-letter code a label states: codes, locales and English names in any case; anything else states none."""
    word = (label or "").strip().lower()
    return _CODES.get(word) or (_CODES.get(re.split("[-_]", word)[0]) if re.fullmatch(r"[a-z]{2,3}(?:[-_][a-z0-9]{2,8})+", word) else None)


def sentences_of(text: str) -> list[str]:
    """Sentences of the story text of a page; marks of a cut are taken off, lists of figures left out."""
    lines = story_lines(text)
    sure = [line for line, kind, _ in lines if kind is False or runs_on(line)]
    if not sure:
        sure = [lines[0][0]] if len(lines) == 1 and "\n" not in text.strip() else []
    return [s for line in sure for s in _SENTENCE.split(without_mark(line)[0]) if s and not is_figures(s)]


def words_of(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


class Trees:
    """Frozen context trees of several languages."""

    def __init__(self, languages: list[str], keys: list[np.ndarray], bits: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.languages, self.keys, self.bits, self.contexts, self.escapes = languages, keys, bits, contexts, escapes
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(languages)), np.float32)

    @staticmethod
    def positions(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """For each coded byte of each word (with its end): the word's number, packed strings of order 0.. ORDER, and the order it has."""
        raw = [b" " + w.encode("utf-8", "replace") + b" " for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        starts = np.cumsum(lengths) - lengths
        depth = np.arange(len(data)) - np.repeat(starts, lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        packed, now = [data], data
        for k in range(1, ORDER + 1):
            now = now + (np.concatenate((np.zeros(k, np.int64), data))[: len(data)] << (8 * k))
            packed.append(now)
        at = depth > 0
        return word[at], [p[at] for p in packed], np.minimum(depth[at], ORDER)

    @classmethod
    def built(cls, counts: dict[str, Counter]) -> Trees:
        """Trees from the word counts of each language."""
        languages = sorted(counts)
        if not languages:
            return cls([], [], [], [], [])
        grams: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
        for language in languages:
            words = sorted(counts[language])
            word, packed, depth = cls.positions(words) if words else (np.zeros(0, np.int64), [np.zeros(0, np.int64)] * (ORDER + 1), np.zeros(0, np.int64))
            weight = np.asarray([counts[language][w] for w in words], np.float64)[word] if words else np.zeros(0)
            for k in range(ORDER + 1):
                here = depth >= k
                values, inverse = np.unique(packed[k][here], return_inverse=True)
                grams[k].append((values, np.bincount(inverse, weights=weight[here], minlength=len(values))))
        keys, bits, contexts, escapes = [], [], [], []
        for k in range(ORDER + 1):
            every = np.unique(np.concatenate([v for v, _ in grams[k]]))
            known = np.unique(every >> 8)
            b, e = np.full((len(every), len(languages)), np.nan, np.float32), np.zeros((len(known), len(languages)), np.float32)
            for i, (values, n) in enumerate(grams[k]):
                own, inverse = np.unique(values >> 8, return_inverse=True)
                total, distinct = np.bincount(inverse, weights=n, minlength=len(own)), np.bincount(inverse, minlength=len(own))
                b[np.searchsorted(every, values), i] = np.log2((total + distinct)[inverse] / n)
                e[np.searchsorted(known, own), i] = np.log2((total + distinct) / distinct)
            keys.append(every), bits.append(b), contexts.append(known), escapes.append(e)
        return cls(languages, keys, bits, contexts, escapes)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language."""
        word, packed, depth = self.positions(words)
        n, width = len(word), len(self.languages)
        cost, open_ = np.zeros((n, width), np.float32), np.ones((n, width), bool)
        for k in range(ORDER, -1, -1):
            rows = np.flatnonzero((depth >= k) & open_.any(1))
            if not len(rows) or not len(self.keys[k]):
                continue
            key = packed[k][rows]
            at = np.minimum(np.searchsorted(self.keys[k], key), len(self.keys[k]) - 1)
            own = np.where((self.keys[k][at] == key)[:, None], self.bits[k][at], np.nan)
            context = key >> 8
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            escape = np.where((self.contexts[k][at] == context)[:, None], self.escapes[k][at], 0)
            seen = ~np.isnan(own)
            cost[rows] += np.where(open_[rows], np.where(seen, own, escape), 0)
            open_[rows] &= ~seen
        cost += open_ * np.float32(8)
        out = np.zeros((len(words), width), np.float32)
        np.add.at(out, word, cost)
        return out

    def sentence_bits(self, sentences: list[list[str]]) -> np.ndarray:
        """Bits of each sentence in each language; each distinct word is coded once."""
        new = list(dict.fromkeys(w for s in sentences for w in s if w not in self.index))
        if len(self.index) > 400_000:
            self.index, self.table = {}, self.table[:0]
            new = list(dict.fromkeys(w for s in sentences for w in s))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.table = np.concatenate((self.table, self.code_lengths(new)))
        out = np.zeros((len(sentences), len(self.languages)), np.float64)
        flat = np.fromiter((self.index[w] for s in sentences for w in s), np.int64)
        lengths = np.fromiter(map(len, sentences), np.int64, len(sentences))
        some = np.flatnonzero(lengths)
        if len(some):
            out[some] = np.add.reduceat(self.table[flat].astype(np.float64), (np.cumsum(lengths) - lengths)[some])
        return out


def _latin(words: list[str]) -> bool:
    """Whether most words of a sentence are written in Latin letters."""
    return sum(w[0] < "\u0250" for w in words) * 10 >= len(words) * 7


def trained_trees(rows: DataFrame, key: str = "row_id", text: str = "content", label: str = "language", train_rows: int = TRAIN_ROWS, rounds: int = 2) -> Trees:
    """Trees from a bounded sample of rows of each stated language. As labels may be wrong, each round gives every
    sentence of the sample to the language that codes it shortest and builds the trees anew.

    A language of another script may also be written in Latin letters. Such sentences get a tree of their own, named
    `te~`: those without any usual word of the languages written in Latin letters, as most of the other script's labels have it.
    """
    stated = F.lower(F.regexp_extract(F.trim(F.col(label)), r"^([A-Za-z]+)", 1))
    code = F.create_map(*(x for w, c in _CODES.items() for x in (F.lit(w), F.lit(c))))[stated]
    labelled = rows.select(code.alias("c"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("h")).filter("c is not null")
    sentences: list[tuple[str, list[str], bool]] = []
    there = {r["c"]: r["n"] for r in labelled.groupBy("c").agg(F.count("*").alias("n")).collect()}
    # one scan for all languages: of each the hashes within a part of their range that holds twice the rows wanted
    parts = {c: min(1.0, 2 * train_rows / n) for c, n in there.items()}
    top = F.create_map(*(x for c, part in parts.items() for x in (F.lit(c), F.lit(min(2**63 - 1, int(-(2**63) + part * 2**64)))))) if parts else F.create_map()
    sample = labelled.filter(F.col("h") <= top[F.col("c")]).filter((F.length("t") <= TRAIN_CHARS) & (F.trim("t") != "")) if parts else labelled.limit(0)
    # the smallest hashes of each, by a rank that every task applies before rows are sent
    ranked = sample.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("h", "t"))).filter(F.col("n") <= train_rows)
    for r in sorted(ranked.select("c", "t", "n").collect(), key=lambda r: (list(STATED).index(r["c"]), r["n"])):
        c = r["c"]
        sentences += [(c, w, _latin(w)) for s in sentences_of(r["t"]) if len(w := words_of(s)) >= 3]
    latin = {c for c in STATED if 2 * sum(f for k, _, f in sentences if k == c) > sum(k == c for k, _, _ in sentences)}

    def built(labels: list[str]) -> Trees:
        out: dict[str, Counter] = defaultdict(Counter)
        for c, (_, w, _) in zip(labels, sentences):
            if c:
                out[c].update(w)
        return Trees.built(out)

    # usual words of the languages in Latin letters: those in one of three hundred of their sentences
    usual: set[str] = set()
    for c in latin:
        own = [w for k, w, f in sentences if f and k == c]
        seen = Counter(x for w in own for x in set(w))
        usual.update(x for x, n in seen.items() if n >= max(3, len(own) / 300))
    strange = [f and len(w) >= 4 and not any(x in usual for x in w) for _, w, f in sentences]
    most = Counter(k for (k, _, _), x in zip(sentences, strange) if x and k not in latin).most_common(1)
    labels = [(f"{most[0][0]}~" if most else "") if x else "" if f and c not in latin else c for (c, _, f), x in zip(sentences, strange)]
    trees = built(labels)
    for _ in range(rounds if len(trees.languages) > 1 else 0):
        best = trees.sentence_bits([w for _, w, _ in sentences]).argmin(1)
        labels = [trees.languages[i] for i in best]
        trees = built(labels)
    return trees


def story_languages(bits: np.ndarray, lead: float = LEAD_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(language number, confidence) of each sentence of one story; sentences without a clear lead follow the story.

    `bits` has one column for each language.
    """
    order = np.sort(bits, 1)
    best, gap = bits.argmin(1), order[:, 1] - order[:, 0] if bits.shape[1] > 1 else np.full(len(bits), 99.0)
    clear = gap >= lead
    if not clear.all():
        whole = int(bits.sum(0).argmin()) if not clear.any() else int(np.bincount(best[clear]).argmax())
        best = np.where(clear, best, whole)
    return best, 1 / (1 + np.exp2(-np.minimum(gap, 60) / 4))


_SEGMENTS = pa.schema([("_key", pa.int64()), ("segment_no", pa.int32()), ("lang", pa.string()), ("n_sentences", pa.int32()), ("n_story", pa.int32()), ("confidence", pa.float64()), ("text", pa.string()), ("stated", pa.string())])


def language_segments(rows: DataFrame, key: str = "row_id", text: str = "content", label: str = "language", trees: Trees | None = None, with_text: bool = True) -> DataFrame:
    """(key, segment_no, lang, n_sentences, n_story, confidence, text, stated): stretches of sentences in one language in
    each story of n_story sentences; `stated` is the language its label states, or null.

    Null and blank texts, and pages without a story, give no row; a story without letters gives none either. Telugu is
    `te` in any script, garbled text counts as meant. Long texts are read whole, repeated rows judged alike; other
    columns are ignored. Without labelled rows there are no trees and the result is empty.
    """
    trees = trees or trained_trees(rows, key, text, label)
    share = rows.sparkSession.sparkContext.broadcast((trees.languages, trees.keys, trees.bits, trees.contexts, trees.escapes))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*share.value)
        plain = [c.rstrip("~") for c in model.languages]
        names = sorted(set(plain))
        groups = [[i for i, c in enumerate(plain) if c == n] for n in names]
        for batch in batches:
            out: list[list] = [[] for _ in _SEGMENTS.names]
            split = [(k, label_, [(x, w) for x in sentences_of(t) if (w := words_of(x))]) for k, t, label_ in zip(*(c.to_pylist() for c in batch.columns))] if names else []
            stories = [(k, stated_language(label_), [x for x, _ in s], [w for _, w in s]) for k, label_, s in split if s]
            bits = model.sentence_bits([w for x in stories for w in x[3]])
            if names:
                bits = np.stack([bits[:, g].min(1) for g in groups], 1)
            at = 0
            for k, stated, s, _ in stories:
                best, sure = story_languages(bits[at : at + len(s)])
                at += len(s)
                edges = [0, *(np.flatnonzero(np.diff(best)) + 1), len(s)]
                for no, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, x in zip(out, (k, no + 1, names[best[a]], int(b - a), len(s), float(sure[a:b].mean()), " ".join(s[a:b]) if with_text else None, stated)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SEGMENTS.types)], schema=_SEGMENTS)

    named = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint"), text, label)
    return named.mapInArrow(segments, "_key bigint, segment_no int, lang string, n_sentences int, n_story int, confidence double, text string, stated string").withColumnRenamed("_key", key)


def document_languages(segments: DataFrame, key: str = "row_id", least: int = 2) -> DataFrame:
    """(key, lang, n_sentences, confidence, stated) for each language with at least `least` sentences of a story, or all of it if shorter."""
    weighted = F.sum(F.col("confidence") * F.col("n_sentences")) / F.sum("n_sentences")
    by = segments.groupBy(key, "lang").agg(F.sum("n_sentences").alias("n_sentences"), weighted.alias("confidence"), F.first("stated").alias("stated"), F.first("n_story").alias("_story"))
    return by.filter(F.col("n_sentences") >= F.least(F.lit(least), F.col("_story"))).drop("_story")


def unstated_languages(rows: DataFrame, key: str = "row_id", text: str = "content", label: str = "language") -> DataFrame:
    """(key, lang): languages of a story that its label does not state."""
    found = document_languages(language_segments(rows, key, text, label, with_text=False), key)
    return found.filter(~F.col("stated").eqNullSafe(F.col("lang"))).select(key, "lang")
