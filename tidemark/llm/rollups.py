"""Token counts: additive totals by source, language and tokenizer version, maintained from signed changes.

A :class:`Rollup` lives in a folder that every executor reaches.  ``apply`` turns inserts, deletes and revised counts of a batch
into signed rows of documents (an insert +1 text and +n tokens, a delete the opposite of what the document has counted so
far, a revision both), writes these and their sums, and commits the batch as the next in a numbered log of markers.  A marker's
number is that of the state that was read: if another batch has taken it meanwhile, the batch is worked out anew on the new state, so
that the totals are those of batches applied one after the other.  A batch that is in the log is not applied again,
whatever it holds; what a failed attempt wrote has no marker and counts for nothing.  ``totals`` adds up the sums of the committed
batches, ``documents`` the signed rows; both start at the last ``snapshot``, which holds what each document counts at its
place in the log, so that work follows what has changed since.

Sums are made before the shuffle, so that a hot source costs a row for each task.  Each of the three frames may have several
rows of a document (all count) and null sources or languages (a group of their own); a delete or revision of an id that the rollup
does not hold, or of a null id, changes nothing but for the revision's new counts; a null count is 0.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import written

GROUP = ("source", "lang", "tokenizer_version")
_CHANGE = "doc_id long, source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
_COLUMNS = [x.split(" ")[0] for x in _CHANGE.split(", ")]
#: Fixed value: the published pattern that splits a text before the merges of the byte-level rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, rank_file: str, version: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Rows for ``apply``: id, source, language, ``version`` and the tokens that the byte-level vocabulary makes of the text (none of
    a null or empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        count = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(count(x)) if x else 0 for x in (y.as_py() for y in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long").withColumn("tokenizer_version", F.lit(version))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._log: dict[str, dict] = {}
        self._path = lambda *x: spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *x]))
        self._fs = self._path("log").getFileSystem(spark._jsc.hadoopConfiguration())

    def log(self) -> list[dict]:
        """The committed steps in order: ``batch`` (null for a snapshot) and ``folder``."""
        path = self._path("log")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []
        names = [x for x in names if re.fullmatch("[0-9]{12}", x)]
        for name in names:
            if name not in self._log:  # a marker never changes
                stream = self._fs.open(self._path("log", name))
                try:
                    self._log[name] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return [self._log[x] for x in names]

    def _commit(self, number: int, batch: str | None, folder: str) -> bool:
        """Make the marker of this number; False if there is one.  It is written aside and renamed without overwriting, as streams
        commit theirs."""
        jvm, aside = self.spark._jvm, self._path("log", f".{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"batch": batch, "folder": folder}).encode()))
        stream.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path("log", f"{number:012d}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(aside, False)
            return False
        return True

    def _read(self, kind: str, schema: str, log: list[dict]) -> DataFrame:
        last = max((i for i, x in enumerate(log) if x["batch"] is None), default=0)
        paths = [f"{x['folder']}/{kind}" for x in log[last:]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self, log: list[dict] | None = None) -> DataFrame:
        """What each document counts at present (or after some first steps of the log), by group."""
        rows = self._read("changes", _CHANGE, self.log() if log is None else log).groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Texts and tokens of each group that has any."""
        schema = _CHANGE.replace("doc_id long, ", "")
        rows = self._read("totals", schema, self.log()).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.where("n_docs <> 0 OR n_tokens <> 0")

    def _write(self, changes: DataFrame, name: str) -> str:
        folder = f"{self.folder}/batches/{name}-{uuid.uuid4().hex}"
        changes.write.parquet(f"{folder}/changes")
        kept = self.spark.read.schema(_CHANGE).parquet(f"{folder}/changes")
        kept.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{folder}/totals")
        return folder

    def snapshot(self) -> bool:
        """Sum up the log so far; False if a batch was committed meanwhile (the log stays as it is)."""
        log = self.log()
        return self._commit(len(log), None, self._write(self.documents(log), "snapshot"))

    def apply(self, batch: str, *, inserts: DataFrame | None = None, deletes: DataFrame | None = None, revisions: DataFrame | None = None) -> bool:
        """Apply a batch once; False if it is committed already.  ``inserts`` and ``revisions`` as from :func:`token_counts`;
        ``deletes`` has a ``doc_id``."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-': {batch!r}")
        while True:
            log = self.log()
            if any(x["batch"] == batch for x in log):
                return False
            if self._commit(len(log), batch, self._write(self._changes(log, inserts, deletes, revisions), batch)):
                return True

    def _changes(self, log: list[dict], inserts: DataFrame | None, deletes: DataFrame | None, revisions: DataFrame | None) -> DataFrame:
        parts = [x.select(*_COLUMNS[:4], F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")) for x in (inserts, revisions) if x is not None]
        gone = [x.select(F.col("doc_id").cast("long").alias("doc_id")) for x in (deletes, revisions) if x is not None]
        if gone:
            ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            old = self.documents(log).join(ids.distinct(), "doc_id")
            parts.append(old.select(*_COLUMNS[:4], (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        changes = parts[0] if parts else self.spark.createDataFrame([], _CHANGE)
        for x in parts[1:]:
            changes = changes.unionByName(x)
        return changes


def exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` of every document whose text one of smaller id has too (null texts are no copies)."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.col(text), 256).alias("_text"))
    # written, so that the join is one whose large partitions Spark may split
    first = written(rows.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated-texts")
    return rows.join(first, "_text").where("doc_id > _first").select("doc_id")
