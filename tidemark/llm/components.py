"""Connected components by contraction, without the edges of more than a counted few ever meeting in one task or on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written

#: Links that one task joins; more are contracted by joins first.
SMALL = 100_000


def _moved(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes in ``column`` replaced by where ``moves`` (``node``, ``root``) take them."""
    to = moves.select(F.col("node").alias(column), F.col("root").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of a counted, small number of edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
        moved = [x for x in above if top(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64()), pa.array(map(top, moved), pa.int64())], names=["node", "root"])

    return edges.repartition(1).mapInArrow(run, "node long, root long")


def _round(edges: DataFrame) -> DataFrame:
    """Where each node with a smaller neighbour goes: to the least such neighbour, and on from there until it is at one that stays."""
    moves = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "moves")
    while True:
        on = moves.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        step = written(moves.join(on, "root", "left").select("node", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "moves")
        moves = step.select("node", "root")
        if step.where("moved").isEmpty():
            return moves


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` (the least node that it is linked with, over any number of links) of each node but the roots, from
    links of columns ``a`` and ``b``, and from the components ``known`` of other links.

    Each round every node with a smaller neighbour goes to a smaller one that stays; links within what has become one node go.
    So a later round moves only nodes that stayed so far, and its moves take the earlier ones' ends along.  Once ``SMALL`` links
    are left, one task joins what they link.  Every table is written, so joins on a node with many links are ones whose
    partitions Spark may split."""
    edges = written(_distinct(links if known is None else _moved(_moved(links, known, "a"), known, "b")), "edges")
    found = None
    while n := edges.count():
        moves = written(_in_one_task(edges), "moves") if n <= SMALL else _round(edges)
        found = moves if found is None else written(_moved(found, moves, "root").unionByName(moves), "roots")
        if n <= SMALL:
            break
        edges = written(_distinct(_moved(_moved(edges, moves, "a"), moves, "b")), "edges")
    if found is None:
        return known if known is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return found if known is None else written(_moved(known, found, "root").unionByName(found), "roots")
