"""Exact top-k inner products: best-first search of M-trees.

Vectors are turned into integers, ``floor(scale * x)`` of each component.  Each task builds M-trees of at most ``SHARD`` of its
rows: pages of ``PAGE`` entries under routing nodes, each node with its pivot, covering radius, largest norm and distance to its
parent's pivot, each entry with its distance to the page's pivot.  The index is a table of nodes, so that a lost executor
costs a shard and queries of any number can come in blocks; each block of at most ``BLOCK`` queries is broadcast.

Euclidean distance is the metric.  With pivot c and radius r, no vector below a node has an inner product with q over
min(q.c + |q| r, (|q|^2 + most^2 - max(0, d(q, c) - r)^2) / 2), where most is the largest norm below.  Before q.c is worked out, the
parent's q.p and the stored distance d(p, c) bound it in turn (triangle inequality); so do the stored distances of entries.  Nodes
are taken by their bound, best first, until the best bound is below the k-th score; equal bounds are followed, so ties go to the
smaller id.  Equal vectors of a shard are one entry with all their ids.

Rows whose vector is null, or holds null or non-finite components, and rows with a null id take no part; a query meets the
vectors of its own length only.  Repeated rows are results of their own.  Scores that floating-point numbers cannot hold are worked
out in whole numbers; one that needs over 64 bits is an error.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Vectors in one tree, entries of a page, children of a routing node, queries in a block.
SHARD, PAGE, FAN, BLOCK = 1 << 14, 256, 16, 4096
_INDEX = "shard long, node int, parent int, pivot array<long>, radius double, to_parent double, most double, vectors array<long>, to_pivot array<double>, ids array<array<long>>"
_WHOLE = 2.0**52  # products of norms up to which scores are exact as floating-point numbers
_SLACK = 1e-6  # of rounding in bounds, relative to the norms


def _integers(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a usable vector, and the integer vectors."""
    rows, out = [], []
    for i, x in enumerate(column):
        if x.is_valid:
            v = x.values
            y = v.to_numpy(zero_copy_only=False).astype(np.float64) if not v.null_count else np.array([np.nan])
            if np.isfinite(y).all():
                y = np.floor(scale * y)
                if (np.abs(y) >= 2.0**62).any():
                    raise ValueError(f"components of {2.0**62 / scale:g} or more have no products in 64 bits")
                rows.append(i)
                out.append(y.astype(np.int64))
    return np.array(rows, np.int64), out


def _parts(v: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """``rows`` in n (a power of two) equal parts: halved again and again, each time between two vectors far from each other, at
    the median of how much nearer one of them is.  So pages are full however the vectors lie."""
    if n < 2 or len(rows) < 2:
        return [rows]
    x = v[rows]
    a = x[np.argmax(((x - x[0]) ** 2).sum(1))]
    b = x[np.argmax(((x - a) ** 2).sum(1))]
    order = np.argsort(x @ (a - b), kind="stable")
    return _parts(v, rows[order[: len(rows) // 2]], n // 2) + _parts(v, rows[order[len(rows) // 2 :]], n // 2)


def _nodes(vectors: np.ndarray, ids: list[list[int]]) -> Iterator[dict]:
    """The nodes of a tree over distinct vectors, parents before children."""
    v = vectors.astype(np.float64)
    norms = np.sqrt((v * v).sum(1))
    number = 0
    open_: list[tuple[np.ndarray, int, np.ndarray | None]] = [(np.arange(len(v)), -1, None)]
    while open_:
        rows, parent, above = open_.pop()
        mean = v[rows].mean(0)
        pivot = v[rows[np.argmin(((v[rows] - mean) ** 2).sum(1))]]
        away = np.sqrt(((v[rows] - pivot) ** 2).sum(1))
        leaf = len(rows) <= PAGE
        yield {
            "node": number,
            "parent": parent,
            "pivot": pivot.astype(np.int64).tolist(),
            "radius": float(away.max()),
            "to_parent": 0.0 if above is None else float(np.sqrt(((pivot - above) ** 2).sum())),
            "most": float(norms[rows].max()),
            "vectors": vectors[rows].ravel().tolist() if leaf else None,
            "to_pivot": away.tolist() if leaf else None,
            "ids": [ids[r] for r in rows] if leaf else None,
        }
        if not leaf:
            open_ += [(x, number, pivot) for x in _parts(v, rows, min(FAN, 1 << (-(-len(rows) // PAGE) - 1).bit_length()))]
        number += 1


def build(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The index of all usable rows: a row for each node, and for each page its entries."""
    names = [x.split(" ")[0] for x in _INDEX.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]

    def tree(ids: list[int], rows: list[np.ndarray], number: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for size in sorted({len(x) for x in rows}):
            some = [i for i, x in enumerate(rows) if len(x) == size]
            distinct, place = np.unique(np.stack([rows[i] for i in some]).reshape(len(some), size), axis=0, return_inverse=True)
            own: list[list[int]] = [[] for _ in distinct]
            for i, k in zip(some, place.ravel().tolist()):
                own[k].append(ids[i])
            shard = next(number)
            nodes = [{"shard": shard, **x} for x in _nodes(distinct, [sorted(x) for x in own])]
            for i in range(0, len(nodes), 256):
                part = nodes[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in part], t) for n, t in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []
        number = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            usable, found = _integers(batch.column("vector"), scale)
            ids += batch.column("id").to_numpy()[usable].tolist()
            rows += found
            while len(rows) >= SHARD:
                yield from tree(ids[:SHARD], rows[:SHARD], number)
                ids, rows = ids[SHARD:], rows[SHARD:]
        if rows:
            yield from tree(ids, rows, number)

    given = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return given.mapInArrow(run, _INDEX)


@dataclass
class _Tree:
    """A shard's nodes in memory."""

    pivots: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    to_parent: list[float] = field(default_factory=list)
    most: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    pages: list[tuple | None] = field(default_factory=list)

    def add(self, x: dict) -> None:
        pivot = np.array(x["pivot"], np.float64)
        self.pivots.append(pivot)
        for name in ("radius", "to_parent", "most"):
            getattr(self, name).append(x[name])
        self.children.append([])
        if x["parent"] >= 0:
            self.children[x["parent"]].append(x["node"])
        if x["ids"] is None:
            self.pages.append(None)
        else:
            whole = np.array(x["vectors"], np.int64).reshape(len(x["ids"]), len(pivot))
            v = whole.astype(np.float64)
            self.pages.append((v, (v * v).sum(1), np.array(x["to_pivot"]), x["ids"], whole))

    def seal(self) -> None:
        self.fans = [(np.array(c), np.stack([self.pivots[i] for i in c]), np.array([self.radius[i] for i in c]), np.array([self.to_parent[i] for i in c]), np.array([self.most[i] for i in c])) if c else None for c in self.children]

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of other ids than ``own``: highest score, then smallest id."""
        q = query.astype(np.float64)
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst first
        qq = float(q @ q)
        length = qq**0.5
        floor = -np.inf
        exact = length * self.most[0] < _WHOLE
        slack = _SLACK * (1 + length * self.most[0])
        root = float(q @ self.pivots[0])
        queue = [(-np.inf, 0, root)]
        while queue:
            bound, node, qc = heapq.heappop(queue)
            if -bound < floor:
                break
            dq = max(0.0, qq - 2 * qc + float(self.pivots[node] @ self.pivots[node])) ** 0.5
            if self.pages[node] is None:
                kids, pivots, radius, away, most = self.fans[node]
                # by the stored distance to the parent, before any inner product
                near = np.maximum(0, np.abs(dq - away) - radius)
                rough = np.minimum(qc + length * (away + radius), (qq + most * most - near * near) / 2) + slack
                some = np.flatnonzero(rough >= floor)
                if not len(some):
                    continue
                products = pivots[some] @ q
                d = np.sqrt(np.maximum(0, qq - 2 * products + (pivots[some] ** 2).sum(1)))
                near = np.maximum(0, d - radius[some])
                fine = np.minimum(products + length * radius[some], (qq + most[some] ** 2 - near * near) / 2) + slack
                for i, b, p in zip(kids[some].tolist(), np.minimum(fine, rough[some]).tolist(), products.tolist()):
                    if b >= floor:
                        heapq.heappush(queue, (-b, i, p))
            else:
                v, norms, away, ids, whole = self.pages[node]
                some = np.flatnonzero(np.minimum(qc + length * away, (qq + norms - (dq - away) ** 2) / 2) + slack >= floor)
                if not len(some):
                    continue
                if exact:
                    scores = v[some] @ q if 2 * len(some) < len(v) else (v @ q)[some]
                else:
                    scores = whole[some].astype(object) @ query.astype(object)
                able = np.flatnonzero(scores >= floor)
                for j in able[np.argsort(-scores[able], kind="stable")].tolist():
                    score = int(scores[j])
                    if score < floor:
                        break
                    for i in [x for x in ids[some[j]][: k + 1] if x != own][:k]:
                        if len(best) < k:
                            heapq.heappush(best, (score, -i))
                        elif (score, -i) > best[0]:
                            heapq.heapreplace(best, (score, -i))
                    if len(best) == k:
                        floor = best[0][0]
        return [(s, -i) for s, i in best]


def search(index: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, tasks: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k best others of each query; index from :func:`build`."""
    spark = index.sparkSession
    given = queries.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    blocks = max(1, -(-given.count() // BLOCK))
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = index.repartition(tasks, "shard").sortWithinPartitions("shard", "node")
    found = None
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        usable, vectors = _integers(rows["vector"].combine_chunks(), scale)
        ids = rows["id"].to_numpy()[usable].tolist() if rows.num_rows else []
        shipped = spark.sparkContext.broadcast(list(zip(ids, vectors)))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            def of(tree: _Tree) -> pa.RecordBatch:
                tree.seal()
                size = len(tree.pivots[0])
                out = [(i, x, s) for i, q in shipped.value if len(q) == size for s, x in tree.search(q, i, k)]
                return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

            tree, shard = _Tree(), None
            for batch in batches:
                for x in batch.to_pylist():
                    if x["shard"] != shard and shard is not None:
                        yield of(tree)
                        tree = _Tree()
                    shard = x["shard"]
                    tree.add(x)
            if shard is not None:
                yield of(tree)

        part = shards.mapInArrow(run, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
