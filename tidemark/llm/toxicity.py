"""Toxicity: class-conditional Kneser-Ney models.

Two interpolated models, of toxic and of ordinary texts, with absolute discounts.  Both back off from the words of their class
to one *shared* distribution: the words of both classes, which back off in turn to continuation counts, the number of
distinct words that a word follows anywhere in the corpus (labelled or not).  So a rare expression has the same probability
under both models until a class has seen it in more texts than the discount takes away.  Counts are of texts (a word counts
once in each), as words come in bursts.  The models stop at words: with class bigrams on top, held-out AUC fell from 0.998 to
0.974 on the check tables, as one class is ten times the other and its bigrams leave it less to back off with.

The vocabulary is that of the labelled sample; the pairs of all other words are counted and summed up as those of one more word.

A text's length-normalised log-likelihoods are compared over the whole text, over its worst ``WINDOW`` words and over its
worst word; a logistic calibration turns these differences into a probability.

The class counts come from at most ``SAMPLE`` labelled rows outside the held-out fold (the documented bound), as a grouped
sum with the usual count cutoffs.  The shared counts come from every row and are exact: each task makes its pairs of words
distinct and packs them by bucket (those of two words of the vocabulary as numbers, others as 64-bit hashes); a word's pairs lie in
many buckets, so that no common word meets in one task; the buckets are united, and the driver gets a count for each word of the
vocabulary.  Scoring is a pass without shuffle.  The calibration scores each half of the sample with the counts of the other half.

A null or empty text has no words; it gets what the calibration gives a text without evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as labelled
from .words import NOT_ALNUM, U64, chunks, mix64, row_of

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 24_000
#: Absolute discounts: of the shared words, of ordinary texts' words, of toxic texts' words.  A class's discount is at least
#: ``BURST`` of its texts: the words of one text reach as many texts as it has near copies.
DISCOUNT = (0.75, 2.0, 3.0)
BURST = (0.0, 0.005)
WINDOW = 4
#: Words in fewer texts of the sample are left to the backoff.
CUTOFF = 2
#: Pairs that are made distinct at a time, and distinct pairs that a task holds.
PAIRS, HELD = 1 << 21, 1 << 22
#: Buckets of a word's pairs.
SALTS = 16
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, word hashes and word offsets of each chunk."""
    for chunk in chunks(column):
        low = chunk.lowered()
        s, e, at = low.words(NOT_ALNUM)
        yield chunk.first, low.word_hashes(s, e), at


def _inner(at: np.ndarray, n: int) -> np.ndarray:
    """Indices of the words that a word of the same text precedes."""
    follows = np.ones(n, bool)
    follows[at[:-1][at[:-1] < n]] = False
    return np.flatnonzero(follows)


class Continuations:
    """The shared distribution: a word's share of the distinct pairs of a word and the one before it, each word with half a pair
    more.  ``words``: the vocabulary (hashes, in order); ``n``: the pairs of each and, at the end, of all other words together."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, p = words, (n + 0.5) / (n + 0.5).sum()
        self.p, self.other = p[:-1], float(p[-1])

    def __getitem__(self, word: int) -> float:
        i = int(np.searchsorted(self.words, U64(word)))
        return float(self.p[i]) if i < len(self.words) and self.words[i] == word else self.other


def _packed(codes: np.ndarray) -> bytes:
    """Numbers in order: their differences, the bytes of each weight together, compressed."""
    return pa.compress(np.diff(codes, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    plain = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(plain.reshape(8, n).T).view(U64).ravel())


class _Distinct:
    """Distinct numbers of those added, in order, and what came with each."""

    def __init__(self):
        self.codes, self.of = np.zeros(0, U64), np.zeros(0, U64)
        self.fresh, self.n = [], 0

    def add(self, codes: np.ndarray, of: np.ndarray) -> None:
        self.fresh.append((codes, of))
        self.n += len(codes)
        if self.n >= PAIRS:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.fresh:
            codes, of = (np.concatenate(x) for x in zip((self.codes, self.of), *self.fresh))
            self.codes, first = np.unique(codes, return_index=True)
            self.of, self.fresh, self.n = of[first], [], 0
        return self.codes, self.of


def shared_counts(docs: DataFrame, words: np.ndarray, text: str = "text") -> Continuations:
    """The number of distinct words before each of ``words`` (hashes, in order), and before all others, over all of ``docs``."""
    spark = docs.sparkSession
    size = U64(len(words) + 1)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = U64(4 * tasks)
    shipped = spark.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        held = [_Distinct(), _Distinct()]

        def dealt(kind: int) -> pa.RecordBatch:
            codes, of = held[kind].all()
            held[kind] = _Distinct()
            bucket = (mix64(of * U64(SALTS) + mix64(codes % size) % U64(SALTS)) if kind == 0 else codes) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket, codes, of = bucket[order], codes[order], of[order]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            codes, of = np.split(codes, begin[1:]), np.split(of, begin[1:])
            m = len(begin)
            words = pa.array([_packed(np.cumsum(x)) for x in of], pa.binary()) if kind else pa.nulls(m, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[begin].astype(np.int32)), pa.array(np.full(m, kind, np.int8)), pa.array([len(x) for x in codes], pa.int32()), pa.array([_packed(x) for x in codes], pa.binary()), words], names=["bucket", "kind", "n", "pairs", "words"])

        for batch in batches:
            for _, own, at in _tokens(batch.column("text")):
                code = np.full(len(own), len(known), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    code = np.where(known[place] == own, place, len(known))
                k = _inner(at, len(own))
                word, before = code[k].astype(U64), code[k - 1].astype(U64)
                inside = (word < size - U64(1)) & (before < size - U64(1))
                held[0].add(word[inside] * size + before[inside], word[inside])
                k = k[~inside]
                held[1].add(mix64(own[k] ^ mix64(own[k - 1] + U64(1))), word[~inside])
                for kind in (0, 1):
                    if len(held[kind].codes) >= HELD:
                        yield dealt(kind)
        for kind in (0, 1):
            if len(held[kind].all()[0]):
                yield dealt(kind)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = _Distinct(), None

        def counted() -> pa.RecordBatch:
            word, n = np.unique(held.all()[1], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for bucket, kind, n, packed, of in zip(*(batch.column(x).to_pylist() for x in ("bucket", "kind", "n", "pairs", "words"))):
                if key not in (None, (bucket, kind)):
                    yield counted()
                    held = _Distinct()
                key, codes = (bucket, kind), _unpacked(packed, n)
                held.add(codes, np.diff(_unpacked(of, n), prepend=U64(0)) if kind else codes // size)
        if key is not None:
            yield counted()

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pairs, "bucket int, kind byte, n int, pairs binary, words binary")
    rows = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(united, "word long, n long")
    found = rows.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(int(size))
    n[found["word"].to_numpy()] = found["n"].to_numpy()
    return Continuations(words, n)


def class_counts(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the sample: words (hashes, in order), the texts that have them by class (0 ordinary, 1 toxic) and half, the sums of
    these over all words, those below the cutoff included, and all texts by class and half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy().astype(np.int64)
            half = batch.column("seed").to_numpy().astype(np.int64) & 1
            for first, words, at in _tokens(batch.column("text")):
                text = first + row_of(at)
                once = np.unique(mix64(words ^ mix64(text)), return_index=True)[1]
                every = np.arange(first, first + len(at) - 1)  # word 0 stands for the text itself
                distinct, place = np.unique(np.concatenate([words[once], np.zeros(len(every), U64)]), return_inverse=True)
                cell = (2 * (label > 0) + half)[np.concatenate([text[once], every])]
                counts = np.bincount(place * 4 + cell, minlength=4 * len(distinct)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *[pa.array(counts[:, c]) for c in range(4)]], names=["word", "n0", "n1", "n2", "n3"])

    sums = [F.sum(f"n{c}").alias(f"n{c}") for c in range(4)]
    rows = chosen.select("seed", "label", "text").mapInArrow(count, "word long, n0 long, n1 long, n2 long, n3 long")
    # the words below the cutoff become one row, for the sums
    kept = rows.groupBy("word").agg(*sums).withColumn("word", F.expr(f"if(n0 + n1 + n2 + n3 >= {CUTOFF}, word, null)")).groupBy("word").agg(*sums).toArrow()
    cells = lambda x: np.column_stack([x[f"n{c}"].to_numpy() for c in range(4)]).astype(np.float64)
    known = kept.filter(pc.field("word").is_valid())
    words = known["word"].to_numpy().view(U64)
    order = np.argsort(words)
    words, n = words[order], cells(known)[order]
    texts = n[words == 0].sum(0)
    return words[words > 0], n[words > 0], cells(kept).sum(0) - texts, texts


class KneserNey:
    """Log-likelihood ratios, toxic against ordinary; ``shared``: the shared probabilities of the words of ``counts``; ``half``:
    count only that half of the sample (None: all)."""

    def __init__(self, counts: tuple[np.ndarray, ...], shared: np.ndarray, half: int | None):
        pick = lambda n: n.reshape(-1, 2, 2).sum(2) if half is None else n.reshape(-1, 2, 2)[:, :, half]
        words, n, total = counts[0], pick(counts[1]), np.maximum(1, pick(counts[2])[0])
        keep = n.sum(1) > 0
        self.words, n = words[keep], n[keep]
        pooled = np.maximum(n.sum(1) - DISCOUNT[0], 0) / total.sum()
        continued = shared[keep] * (1 - pooled.sum())
        less = np.maximum(n - np.maximum(DISCOUNT[1:], BURST * pick(counts[3])[0]), 0)
        rest = np.maximum(1e-6, 1 - less.sum(0) / total)  # what the words of a class leave to the shared distribution
        p = less / total + rest * (pooled + continued)[:, None]
        self.known = np.log(p[:, 1] / p[:, 0])
        self.unseen = float(np.log(rest[1] / rest[0]))  # the shared probability of an unseen word cancels out

    def ratios(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(words), self.unseen)
        place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[place] == words, self.known[place], self.unseen)


def evidence(model: KneserNey, column: pa.Array) -> np.ndarray:
    """For each text: the length-normalised ratio, that of the worst ``WINDOW`` words, that of the worst word, and the
    (logarithmic) length."""
    out = np.zeros((len(column), 4))
    for first, words, at in _tokens(column):
        ratios = model.ratios(words)
        sums = sum((ratios[i : len(ratios) - WINDOW + 1 + i] for i in range(1, WINDOW)), ratios[: max(0, len(ratios) - WINDOW + 1)])
        for k in range(len(at) - 1):
            i, j = int(at[k]), int(at[k + 1])
            if n := j - i:
                own = ratios[i:j]
                out[first + k] = own.sum() / n, (sums[i : j - WINDOW + 1].max() if n >= WINDOW else own.sum()) / WINDOW, own.max(), np.log1p(n)
    return out


class Toxicity:
    """A model and its calibration."""

    def __init__(self, model: KneserNey, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(evidence(self.model, column)) @ self.weights, -30, 30)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x[:, 2] * x[:, 3]])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", most: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Toxicity:
    spark = docs.sparkSession
    chosen = labelled.sample(docs, labels, label, folds, held_out, most, text=text)
    counts = class_counts(chosen)
    shared = shared_counts(docs, counts[0], text).p
    halves = spark.sparkContext.broadcast([KneserNey(counts, shared, 1), KneserNey(counts, shared, 0)])  # by the half that is scored

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column("seed").to_numpy().astype(np.int64) & 1
            for h in (0, 1):
                rows = batch.filter(pa.array(half == h))
                x = evidence(halves.value[h], rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("seed"), rows.column("label"), *[pa.array(x[:, c]) for c in range(4)]], names=["seed", "label", *"abcd"])

    found = chosen.select("seed", "label", "text").mapInArrow(calibrate, "seed long, label int, a double, b double, c double, d double").orderBy("seed", *"abcd").toArrow()
    x = np.column_stack([found[c].to_numpy() for c in "abcd"])
    return Toxicity(KneserNey(counts, shared, None), _logistic(_design(x), found["label"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Toxicity, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (probability of a toxic text) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shipped.value.score(batch.column("text")))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
