"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: one entry for each distinct (hashed, lower-cased) word with its dampened count, one-hot bins
of structure statistics, and a one-hot bin of ``n_chars``.  Each feature has a weight and a vector of ``RANK`` factors; the
pairwise interactions are summed in linear time, as half of (sum of squares' difference): (sum v x)^2 - sum (v x)^2.

It is fitted in one task on at most ``SAMPLE`` labelled rows (the documented bound) and scores every row in a pass
without shuffle.  A null or empty text has only structure and metadata features; a null ``n_chars`` has its own bin.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labels as labelled
from .words import U64, chunks

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 16_000
WORD_BUCKETS = 1 << 16
BINS = 16
RANK = 8
EPOCHS = 8
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

#: Byte classes: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other mark, 7 non-ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 0, 1, 2, 7
_CLASS[[0x20, 0x09]], _CLASS[[0x0A, 0x0D]], _CLASS[[0x2C, 0x2E, 0x27, 0x3F]] = 3, 4, 5
_STATISTICS = 8 + 6
FEATURES = WORD_BUCKETS + (_STATISTICS + 1) * BINS


def _share(x: float) -> int:
    """The bin of a share: finer towards 0."""
    return min(BINS - 1, int(BINS * x**0.5))


def _size(x: float) -> int:
    """The bin of a count: by its logarithm."""
    return min(BINS - 1, int(np.log2(1 + x)))


def features(column: pa.Array, n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and row starts (of each row and the end) of the vectors of some texts."""
    index, value, counts = [], [], []
    base = WORD_BUCKETS + np.arange(_STATISTICS + 1) * BINS
    ones = np.full(_STATISTICS + 1, 0.5, np.float32)
    for chunk in chunks(column):
        s, e, at = chunk.words()
        bucket = (chunk.lowered().word_hashes(s, e) >> U64(48)).astype(np.int64) % WORD_BUCKETS
        kinds = _CLASS[chunk.data]
        for k in range(len(chunk)):
            i, j, a, b = at[k], at[k + 1], chunk.offsets[k], chunk.offsets[k + 1]
            n = int(j - i)
            words, times = np.unique(bucket[i:j], return_counts=True)
            x = np.sqrt(times).astype(np.float32)
            x /= np.sqrt((x * x).sum()) if n else 1
            shares = np.bincount(kinds[a:b], minlength=8) / max(1, b - a)
            lengths = (e[i:j] - s[i:j]) if n else np.zeros(1)
            bins = [_share(p) for p in shares] + [
                _size(n),
                _size(float(lengths.mean()) * 8),
                _size(float(lengths.max()) * 2),
                _share(len(words) / max(1, n)),
                _share(float(times.max()) / n if n else 0),
                _share(float((bucket[i + 1 : j] == bucket[i : j - 1]).mean()) if n > 1 else 0),
            ]
            m = n_chars[chunk.first + k]
            index.append(np.concatenate([words, base + np.array([*bins, 0 if m is None else 1 + min(BINS - 2, _size(max(0, m)))])]))
            value.append(np.concatenate([x, ones]))
            counts.append(len(x) + len(ones))
    none = np.zeros(0, np.int64)
    return np.concatenate(index or [none]), np.concatenate(value or [none.astype(np.float32)]), np.cumsum([0, *counts])


class FactorisationMachine:
    def __init__(self, bias: float, weight: np.ndarray, factors: np.ndarray):
        self.bias, self.weight, self.factors = bias, weight, factors

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores before the logistic function, and the sums of v x; every row has features."""
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, starts[:-1])
        squares = np.add.reduceat((vx * vx).sum(1), starts[:-1])
        return self.bias + np.add.reduceat(self.weight[index] * value, starts[:-1]) + 0.5 * ((total * total).sum(1) - squares), total

    def score(self, column: pa.Array, n_chars: list[int | None]) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(column, n_chars))[0].astype(np.float64), -30, 30)))

    def to_bytes(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), bias=self.bias, weight=self.weight, factors=self.factors)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> FactorisationMachine:
        x = np.load(io.BytesIO(raw))
        return cls(float(x["bias"]), x["weight"], x["factors"])

    @classmethod
    def fit(cls, index: np.ndarray, value: np.ndarray, starts: np.ndarray, target: np.ndarray, *, epochs: int | None = None, batch: int = 128, rate: float = 0.25, decay: float = 1e-5) -> FactorisationMachine:
        """Logistic loss, AdaGrad over mini-batches in a fixed random order; few rows are gone through more often."""
        epochs = epochs or min(8 * EPOCHS, max(EPOCHS, 400 * batch // max(1, len(target))))
        random = np.random.default_rng(7)
        share = min(0.99, max(0.01, float(target.mean()))) if len(target) else 0.5
        self = cls(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), random.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32))
        seen_w, seen_v = np.full(FEATURES, 1e-2, np.float32), np.full((FEATURES, RANK), 1e-2, np.float32)
        size = np.diff(starts)
        for _ in range(epochs):
            for rows in np.array_split(random.permutation(len(target)), max(1, len(target) // batch)):
                if not len(rows):
                    continue
                n = size[rows]
                ends = np.cumsum(n)
                take = np.arange(ends[-1]) - np.repeat(ends - n - starts[rows], n)
                i, x, row = index[take], value[take], np.repeat(np.arange(len(rows)), n)
                y, total = self.raw(i, x, np.concatenate([[0], ends]))
                g = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - target[rows]) / len(rows)).astype(np.float32)
                touched, place = np.unique(i, return_inverse=True)
                gx = g[row] * x
                gw = np.bincount(place, gx, len(touched)).astype(np.float32) + decay * self.weight[touched]
                each = gx[:, None] * total[row] - (gx * x)[:, None] * self.factors[i]
                gv = np.stack([np.bincount(place, each[:, f], len(touched)) for f in range(RANK)], 1).astype(np.float32) + decay * self.factors[touched]
                seen_w[touched] += gw * gw
                seen_v[touched] += gv * gv
                self.weight[touched] -= rate * gw / np.sqrt(seen_w[touched])
                self.factors[touched] -= 0.3 * rate * gv / np.sqrt(seen_v[touched])
                self.bias -= 0.01 * float(g.sum())
        return self


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> FactorisationMachine:
    """A model from at most ``most`` labelled rows outside the held-out fold; vectors, not texts, go to the task that fits."""
    chosen = labelled.sample(docs, labels, label, folds, held_out, most, also=("n_chars",))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, starts = features(batch.column("text"), batch.column("n_chars").to_pylist())
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([batch.column("seed"), batch.column("label"), lists(index, pa.int32()), lists(value, pa.float32())], names=["seed", "label", "i", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(map(len, held)):
            rows = pa.Table.from_batches(held).sort_by([("seed", "ascending"), ("label", "ascending")]).combine_chunks()
            i, x = rows["i"].combine_chunks(), rows["x"].combine_chunks()
            starts = np.concatenate([[0], np.cumsum(i.value_lengths().to_numpy())])
            model = FactorisationMachine.fit(i.flatten().to_numpy().astype(np.int64), x.flatten().to_numpy(), starts, rows["label"].to_numpy().astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["model"])

    rows = chosen.mapInArrow(vectors, "seed long, label int, i array<int>, x array<float>").repartition(1)
    found = rows.mapInArrow(fit, "model binary").first()
    if found is None:  # no labels: every row has even odds
        return FactorisationMachine(0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32))
    return FactorisationMachine.from_bytes(bytes(found.model))


def score(docs: DataFrame, model: FactorisationMachine, *, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``doc_id`` and ``score`` (probability of a good text) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shipped.value.score(batch.column("text"), batch.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(n_chars).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, *, text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with a score of ``threshold`` or more."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at, count = docs.columns.index(text), docs.columns.index(n_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shipped.value.score(batch.column(at), batch.column(count).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
