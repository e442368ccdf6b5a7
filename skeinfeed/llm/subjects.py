"""Subjects of documents: averaged word and subword embeddings with independent logistic outputs.

Each round every partition of the labelled sample computes its gradients under the same weights; they are summed and one
step is taken. A document is about a subject if at least a quarter of its sentences are, so a document's logit is first
the mean of its sentences' logits, then of the top quarter of them; in the last rounds each sentence is a case of its
own, of the likeliest of its document's subjects or, if that is unlikely, of none. Scoring folds embeddings and outputs
into one table of contributions.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinfeed.session import small, written

#: Labelled documents that the model is fitted on: a bounded sample, chosen by hash of the id.
LABELLED_DOCS = 4_000
#: A table of more subjects than this is refused: their outputs would not be small.
MAX_SUBJECTS = 10_000
#: Partitions of the sample: so many gradients of features x dimensions go to the driver each round.
GRADIENT_PARTS = 8
#: Features (words, pairs of words, starts and ends of words) that get an embedding: those in most labelled documents.
MAX_FEATURES, LEAST_DOCS = 25_000, 3
DIMENSIONS, RATE, SHARE = 12, 0.1, 0.25
#: Rounds on means, on top quarters and on single sentences; logit from which a sentence is taken to be about its document's subject.
ROUNDS, LIKELY = (10, 12, 14), -2.0

_EDGE = string.punctuation + "“”‘’„«»‚…–—।॥₹¿¡©|"
_END = re.compile(r"(?<=[.!?।॥])\s+(?=[^\sa-zà-ÿ])|(?<=[.!?।…][”“»\"])\s+(?=[A-ZÀ-ÞЀ-Я“„«¿¡\"])|\n+")


def sentences_of(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    """Lower-case words without marks at their ends; figures are left out."""
    return [w for x in sentence.lower().split() if (w := x.strip(_EDGE)) and not w[0].isdigit()]


def parts_of(word: str) -> list[str]:
    """The word itself, and its start and end where it is long."""
    return [word, f"^{word[:5]}", f"{word[-5:]}$"] if len(word) > 5 else [word]


def _features(words: list[str]) -> list[str]:
    return [f for w in words for f in parts_of(w)] + [f"{a} {b}" for a, b in zip(words, words[1:])]


class _Ids(dict):
    """Numbers of words as they stand in a text, -1 for what is no word; each spelling is looked into once."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.fresh: list[str] = []

    def __missing__(self, raw: str) -> int:
        w = raw.lower().strip(_EDGE)
        if not w or w[0].isdigit():
            k = -1
        elif (k := self.words.get(w, -1)) < 0:
            k = self.words[w] = len(self.words)
            self.fresh.append(w)
        self[raw] = k
        return k


class Model:
    """Contributions of each feature to each subject, and the subjects' biases."""

    def __init__(self, subjects: list[str], features: list[str], table: np.ndarray, bias: np.ndarray):
        self.subjects, self.bias = subjects, bias
        self.features = {f: i for i, f in enumerate(features)}
        self.table = np.concatenate((table, np.zeros((1, len(subjects)), np.float32))) if len(subjects) else np.zeros((1, 0), np.float32)
        self.none = len(features)
        heads: dict[str, int] = {}
        pairs = [(f.split(" "), i) for f, i in self.features.items() if " " in f]
        for (a, b), _ in pairs:
            heads.setdefault(a, len(heads)), heads.setdefault(b, len(heads))
        self._heads = heads
        keys = np.asarray([heads[a] * (1 << 32) + heads[b] for (a, b), _ in pairs], np.int64)
        order = np.argsort(keys)
        self._pair_keys, self._pair_rows = keys[order], np.asarray([i for _, i in pairs], np.int64)[order]
        self._forget()

    def _forget(self) -> None:
        self._ids = _Ids()
        self._sums, self._counts, self._word_heads = np.zeros((0, len(self.subjects)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        new, self._ids.fresh = self._ids.fresh, []
        if new:
            rows = [[i for p in parts_of(w) if (i := self.features.get(p)) is not None] for w in new]
            self._sums = np.concatenate((self._sums, np.stack([self.table[r].sum(0) if r else self.table[self.none] for r in rows])))
            self._counts = np.concatenate((self._counts, np.asarray([len(r) for r in rows], np.int64)))
            self._word_heads = np.concatenate((self._word_heads, np.asarray([self._heads.get(w, -1) for w in new], np.int64)))

    def logits(self, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each sentence for each subject, and its number of words."""
        if len(self._ids) > 800_000:
            self._forget()
        split = [s.split() for s in sentences]
        raw = np.fromiter((self._ids[x] for s in split for x in s), np.int64)
        owner = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        self._learn()
        ids, owner = raw[raw >= 0], owner[raw >= 0]
        lengths = np.bincount(owner, minlength=len(split))
        out = np.tile(self.bias, (len(split), 1)).astype(np.float64)
        if not len(ids):
            return out, lengths
        starts, some = np.cumsum(lengths) - lengths, np.flatnonzero(lengths)
        values, counts = self._sums[ids].astype(np.float64), self._counts[ids].copy()
        heads = self._word_heads[ids]
        inner = (heads[:-1] >= 0) & (heads[1:] >= 0) & (owner[:-1] == owner[1:])
        if len(self._pair_keys) and inner.any():
            key = heads[:-1] * (1 << 32) + heads[1:]
            at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
            hit = np.flatnonzero(inner & (self._pair_keys[at] == key))
            values[hit] += self.table[self._pair_rows[at[hit]]]
            counts[hit] += 1
        total = np.add.reduceat(counts, starts[some])
        out[some] += np.add.reduceat(values, starts[some]) / np.maximum(total, 1)[:, None]
        return out, lengths


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False))


def _gradients(targets: np.ndarray, per_doc: np.ndarray, lengths: np.ndarray, ids: np.ndarray, embed: np.ndarray, weight: np.ndarray, bias: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Summed gradients over documents: their targets and numbers of sentences, the sentences' numbers of features, the features."""
    k = weight.shape[1]
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    starts = np.cumsum(lengths) - lengths
    mean = np.add.reduceat(embed[ids], starts) / lengths[:, None].astype(np.float32)
    z = mean @ weight + bias
    first = np.cumsum(per_doc) - per_doc
    top = np.maximum(1, np.ceil(per_doc * share)).astype(np.int64)  # share 0: sentence by sentence
    d_z = np.zeros_like(z)
    if not share:
        own = np.where(targets[owner] >= 0.5, z, -np.inf)
        best, some = own.argmax(1), own.max(1) > LIKELY
        wanted = np.zeros_like(z)
        wanted[np.flatnonzero(some), best[some]] = 1
        # subjects that only some annotators named are left open
        open_ = (targets[owner] > 0) & (targets[owner] < 0.5)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d_z = np.where(open_, 0, p - wanted) / per_doc[owner][:, None]
    for j in range(k if share else 0):
        order = np.lexsort((-z[:, j], owner)) if share < 1 else np.arange(len(owner))
        chosen = order[(np.arange(len(order)) - first[owner[order]]) < top[owner[order]]]
        doc_z = np.bincount(owner[chosen], weights=z[chosen, j], minlength=len(per_doc)) / top
        p = 1 / (1 + np.exp(-np.clip(doc_z, -30, 30)))
        d_z[chosen, j] = ((p - targets[:, j]) / top)[owner[chosen]]
    d_token = np.repeat(((d_z @ weight.T) / lengths[:, None]).astype(np.float32), lengths, axis=0)
    d_embed = np.stack([np.bincount(ids, weights=d_token[:, c], minlength=len(embed)) for c in range(embed.shape[1])], 1)
    return d_embed, mean.T @ d_z, d_z.sum(0)


class _Adam:
    def __init__(self, shapes: list[tuple]):
        self.m, self.v, self.t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0

    def step(self, values: list[np.ndarray], gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, g, m, v in zip(values, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def _targets(labels: DataFrame, subjects: list[str], doc: str, subject: str, annotator: str, limit: int) -> DataFrame:
    """(doc, targets): for each subject the share of a document's annotators who named it; all 0 where they named none."""
    plain = F.lower(F.trim(F.col(subject)))
    votes = labels.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("_doc"), plain.alias("_s"), F.coalesce(F.col(annotator), F.lit("")).alias("_by")).filter(F.col("_s").isNull() | F.col("_s").isin(subjects)).distinct()
    people = F.count_distinct("_by")
    shares = [F.count_distinct(F.when(F.col("_s") == s, F.col("_by"))) / people for s in subjects]
    return votes.groupBy("_doc").agg(F.array(*shares).cast("array<float>").alias("targets")).orderBy(F.xxhash64("_doc"), "_doc").limit(limit)


def fitted_model(docs: DataFrame, labels: DataFrame, subjects: DataFrame, doc: str = "doc_id", text: str = "text", subject: str = "subject", annotator: str = "annotator", labelled_docs: int = LABELLED_DOCS) -> Model:
    """A model from a bounded sample of the labelled documents; without labels every logit is strongly negative.

    More than MAX_SUBJECTS subjects raise ValueError.
    """
    spark = docs.sparkSession
    names = sorted({r[0].strip().lower() for r in subjects.select(subject).filter(F.col(subject).isNotNull()).distinct().limit(MAX_SUBJECTS + 1).collect()})
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    targets = _targets(labels, names, doc, subject, annotator, labelled_docs)
    sample = docs.filter(F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(small(targets), "_doc").select("_text", "targets")
    sample = written(spark, sample.repartition(max(1, min(GRADIENT_PARTS, spark.sparkContext.defaultParallelism))), "labelled")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for t in batch.column(0).to_pylist() for f in {f for s in sentences_of(t) for f in _features(words_of(s))}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["f"])

    counted = sample.select("_text").mapInArrow(listed, "f string").groupBy("f").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    features = sorted(r["f"] for r in counted.orderBy(F.desc("n"), "f").limit(MAX_FEATURES).collect())
    if not features or not names:
        return Model(names, [], np.zeros((0, len(names)), np.float32), np.full(len(names), -9.0))
    share = spark.sparkContext.broadcast({f: i for i, f in enumerate(features)})

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = share.value
        for batch in batches:
            rows = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sentences = [ids for s in sentences_of(t) if (ids := [i for f in _features(words_of(s)) if (i := index.get(f)) is not None])]
                if sentences:
                    rows.append((y, [len(s) for s in sentences], [i for s in sentences for i in s]))
            types = (pa.list_(pa.float32()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["y", "lengths", "ids"])

    data = written(spark, sample.mapInArrow(coded, "y array<float>, lengths array<int>, ids array<int>"), "labelled-coded")
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.3, (len(features), DIMENSIONS))
    weight = rng.normal(0, 0.3, (DIMENSIONS, len(names)))
    bias = np.full(len(names), -2.0)
    adam = _Adam([embed.shape, weight.shape, bias.shape])
    for pooled in (x for n, pool in zip(ROUNDS, (1.0, SHARE, 0.0)) for x in [pool] * n):
        now = spark.sparkContext.broadcast((embed.astype(np.float32), weight, bias, pooled))

        def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e, w, b, part = now.value
            for batch in batches:
                if batch.num_rows:
                    (y, _), (lengths, per_doc), (ids, _) = (_flat(c) for c in batch.columns)
                    sums_ = _gradients(y.reshape(batch.num_rows, -1), per_doc, lengths, ids, e, w, b, part)
                    yield pa.RecordBatch.from_arrays([*(pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in sums_), pa.array([batch.num_rows], pa.int64())], ["e", "w", "b", "n"])

        sums, n = [np.zeros(embed.shape), np.zeros(weight.shape), np.zeros(bias.shape)], 0
        for row in data.mapInArrow(gradients, "e binary, w binary, b binary, n long").collect():
            for total, blob in zip(sums, row[:3]):
                total += np.frombuffer(blob, np.float32).reshape(total.shape)
            n += row["n"]
        now.destroy()
        sums = [g / max(n, 1) for g in sums]
        sums[0] += 1e-7 * embed
        adam.step([embed, weight, bias], sums, RATE)
    return Model(names, features, (embed @ weight).astype(np.float32), bias)


_FOUND = pa.schema([("_doc", pa.int64()), ("subject", pa.string()), ("n_sentences", pa.int32()), ("share", pa.float64())])


def document_subjects(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", share: float = SHARE, at_most: int = 2) -> DataFrame:
    """(doc, subject, n_sentences, share): the subjects that at least `share` of a document's sentences are about.

    Each output stands for itself: a sentence is about every subject that is likelier than not; where more than `at_most`
    reach the share, the largest count, then the larger mean logit, then the name decides. Null, empty and wordless texts
    are about nothing; equal texts get equal subjects; long texts are read whole; other columns are ignored.
    """
    state = docs.sparkSession.sparkContext.broadcast((model.subjects, sorted(model.features, key=model.features.get), model.table[:-1], model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*state.value)
        for batch in batches:
            out: list[list] = [[] for _ in _FOUND.names]
            split = [(k, s) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if own.subjects and (s := sentences_of(t))]
            logits, words = own.logits([x for _, s in split for x in s]) if split else (np.zeros((0, 0)), np.zeros(0))
            at = 0
            for k, s in split:
                z = logits[at : at + len(s)][words[at : at + len(s)] > 0]
                at += len(s)
                counts = (z > 0).sum(0)
                for j in sorted(np.flatnonzero((counts > 0) & (counts >= share * len(z) - 1e-9)), key=lambda j: (-counts[j], -z[:, j].sum(), j))[:at_most]:
                    for column, x in zip(out, (k, own.subjects[j], int(counts[j]), counts[j] / len(z))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _FOUND.types)], schema=_FOUND)

    named = docs.filter(F.col(doc).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc).cast("bigint"), text)
    return named.mapInArrow(score, "_doc bigint, subject string, n_sentences int, share double").withColumnRenamed("_doc", doc)
