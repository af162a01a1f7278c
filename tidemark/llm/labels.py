"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def is_fold(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, *, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, those of least hash, with their texts: ``seed`` (that
    hash), ``label``, ``text`` and the columns ``also``.  Rows without id or label take no part; of an id labelled more than
    once the largest label holds, of one that several documents have the least text counts.  Only the sampled labels, bounded by ``most``, are broadcast."""
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(doc_id), folds) != held_out))
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("_label"))
        .withColumn("_seed", F.xxhash64("_id"))
        .orderBy("_seed", "_id")
        .limit(most)
    )
    texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(c) for c in also])
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("text", *also, "_seed", "_label")).alias("row"))
    return found.select(F.col("row._seed").alias("seed"), F.col("row._label").alias("label"), "row.text", *[f"row.{c}" for c in also])
