"""Benchmark decontamination with training suffix arrays.

Every shard of the training text (a few MB inside a task) gets a suffix array of its words; each test suffix is
binary-searched in it, eight bytes at a time.  The array is sorted by its first eight bytes at once and deeper only
inside the intervals that some test suffix reaches, as no other part of the order is ever looked at.

Words: lower-cased (A-Z) runs of digits, a-z and non-ASCII characters.  A test suffix is cut after ``window`` words; an
item of fewer words is one suffix.  Nothing is shuffled: test suffixes go to the shards in blocks of at most
``BLOCK_BYTES``, however many items there are; a block's hits are written, and those of the next are added to them.

Edge cases: a null or empty text has no words, a null item no suffix; repeated items count once by ``item_id``; an item
without id marks words and is not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NOT_ALNUM, U64, Chunk, chunks, ranges, row_of, text_buffers
from .work import written

WINDOW = 10
#: Text of the test suffixes that are broadcast at a time.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
_STEP = 8
_FREE = np.array([(1 << 8 * n) - 1 for n in range(_STEP + 1)], U64)

SPANS = "array<struct<first:int,n:int>>"


def _plain(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a chunk with one blank after each; where each begins; the words of each text."""
    low = chunk.lowered()
    s, e, at = low.words(NOT_ALNUM)
    size = e - s + 1
    begin = np.cumsum(size) - size
    data = np.append(low.data, np.uint8(0x20))[ranges(s, size)]
    data[begin + size - 1] = 0x20
    return data, begin, at


class SuffixArray:
    """Word suffixes of a shard, ordered by their first eight bytes and, on demand, by more of them."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        self.begin = begin
        padded = np.concatenate([data, np.zeros(_STEP, np.uint8)])
        self._eight = np.ndarray((len(data) + 1,), ">u8", padded.data, strides=(1,)) if len(data) else np.zeros(1, ">u8")
        self._last = len(data)
        first = self.key(begin)
        self.order = np.argsort(first)
        self.sorted = first[self.order]

    def key(self, at: np.ndarray) -> np.ndarray:
        return self._eight[np.minimum(at, self._last)].astype(U64)

    def occurrences(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of test suffix and word (index) where the suffix occurs."""
        found_test, found_word = [], []
        words, keys, group = self.order, self.sorted, None
        alive = np.arange(len(tests.length))
        place = np.zeros(len(alive), np.int64)  # the interval's group of each test suffix
        for level in range(tests.levels):
            low, high = tests.keys(alive, level)
            if group is None:
                lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            else:
                distinct = np.unique(keys)
                code = (group << 32) | np.searchsorted(distinct, keys)
                lo = np.searchsorted(code, (place << 32) | np.searchsorted(distinct, low, "left"), "left")
                hi = np.searchsorted(code, (place << 32) | np.searchsorted(distinct, high, "right"), "left")
            some = hi > lo
            ends = tests.length[alive] <= (level + 1) * _STEP
            if (done := some & ends).any():
                count = (hi - lo)[done]
                found_test.append(np.repeat(alive[done], count))
                found_word.append(words[ranges(lo[done], count)])
            some &= ~ends
            if not some.any():
                break
            alive = alive[some]
            reached, place = np.unique(lo[some] * (len(words) + 1) + hi[some], return_inverse=True)
            lo, hi = reached // (len(words) + 1), reached % (len(words) + 1)
            words, group = words[ranges(lo, hi - lo)], np.repeat(np.arange(len(lo)), hi - lo)
            keys = self.key(self.begin[words] + (level + 1) * _STEP)
            order = np.lexsort((keys, group))
            words, keys, group = words[order], keys[order], group[order]
        none = np.zeros(0, np.int64)
        return np.concatenate(found_test or [none]), np.concatenate(found_word or [none])


class TestSuffixes:
    """The distinct suffixes (cut after ``window`` words) of some items; ``items[at[i]:at[i + 1]]`` have suffix i."""

    __test__ = False

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        column = pa.array(texts, pa.large_string())
        offsets, raw = text_buffers(column)
        data, begin, at = _plain(Chunk(raw[offsets[0] : offsets[-1]], offsets - offsets[0]))
        suffixes: dict[bytes, tuple[int, list[str | None]]] = {}
        plain, bounds = data.tobytes(), [*begin.tolist(), len(data)]
        for k, item in enumerate(ids):
            i, j = int(at[k]), int(at[k + 1])
            n = min(window, j - i)
            for x in range(i, j - n + 1) if n else ():
                suffixes.setdefault(plain[bounds[x] : bounds[x + n]], (n, []))[1].append(item)
        ordered = sorted(suffixes)
        self.length = np.array([len(x) for x in ordered], np.int64)
        self.n_words = np.array([suffixes[x][0] for x in ordered], np.int64)
        self.items = [i for x in ordered for i in dict.fromkeys(suffixes[x][1])]
        self.at = np.cumsum([0] + [len(dict.fromkeys(suffixes[x][1])) for x in ordered])
        blocks = -(-self.length // _STEP)
        self.levels = int(blocks.max(initial=0))
        self._at = np.cumsum(blocks) - blocks
        padded = np.zeros(int(blocks.sum()) * _STEP, np.uint8)
        padded[ranges(self._at * _STEP, self.length)] = np.frombuffer(b"".join(ordered), np.uint8)
        self._eight = padded.view(">u8").astype(U64)

    def keys(self, some: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest eight bytes that suffixes beginning with some (longer ones) can have at a level."""
        low = self._eight[self._at[some] + level]
        free = np.maximum(0, (level + 1) * _STEP - self.length[some])
        return low, low | _FREE[free]


def _spans(hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word in its text, length, and text of each run of hit words."""
    edge = np.zeros(len(hit), bool)
    edge[at[:-1][at[:-1] < len(hit)]] = True
    begins = hit & edge
    begins[1:] |= hit[1:] & ~hit[:-1]
    ends = hit.copy()
    ends[:-1] &= ~hit[1:] | edge[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    text = row_of(at)[first]
    return first - at[text], last - first + 1, text


def _matches(column: pa.Array, tests: TestSuffixes, before: pa.Array | None) -> tuple[np.ndarray, list, list]:
    """For each text: words, runs of hit words (those in ``before`` included), ids of the items."""
    n_words, spans, items = np.zeros(len(column), np.int64), [[] for _ in range(len(column))], [[] for _ in range(len(column))]
    for chunk in chunks(column, SHARD_BYTES):
        data, begin, at = _plain(chunk)
        rows = row_of(at)
        n_words[chunk.first : chunk.first + len(chunk)] = np.diff(at)
        test, word = SuffixArray(data, begin).occurrences(tests)
        n = tests.n_words[test]
        if len(word):
            whole = word + n <= at[rows[word] + 1]  # else it reaches into the next text
            test, word, n = test[whole], word[whole], n[whole]
        delta = np.zeros(len(begin) + 1, np.int64)
        np.add.at(delta, word, 1)
        np.add.at(delta, word + n, -1)
        if before is not None:
            for k in range(len(chunk)):
                for x in before[chunk.first + k].as_py() or ():
                    delta[at[k] + x["first"]] += 1
                    delta[at[k] + x["first"] + x["n"]] -= 1
        for first, size, k in zip(*(x.tolist() for x in _spans(np.cumsum(delta[:-1]) > 0, at))):
            spans[chunk.first + k].append({"first": first, "n": size})
        for k, t in set(zip(rows[word].tolist(), test.tolist())):
            items[chunk.first + k].extend(tests.items[tests.at[t] : tests.at[t + 1]])
    return n_words, spans, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[TestSuffixes]:
    ids, texts, size = [], [], 0
    for item, words in benchmark.select(F.col(item_id).cast("string"), text).toLocalIterator():
        ids.append(item)
        texts.append(words)
        size += len(words or "")
        if size >= BLOCK_BYTES:
            yield TestSuffixes(ids, texts, window)
            ids, texts, size = [], [], 0
    if texts:
        yield TestSuffixes(ids, texts, window)


def matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row of ``docs``: its id, ``n_words``, the ``spans`` of hit words (first word from 0, and length: the
    verbatim matches and where they are) and the ``items`` (ids as strings, sorted) that occur in it."""
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("spans", T._parse_datatype_string(SPANS)), T.StructField("items", T.ArrayType(T.StringType()))])
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = (x for x in _blocks(benchmark, item_id, item_text, window) if len(x.length))
    block, number = next(blocks, None), 0
    while True:
        following = next(blocks, None)
        shipped = spark.sparkContext.broadcast(block)
        final = following is None

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped, number=number, final=final) -> Iterator[pa.RecordBatch]:
            tests = shipped.value or TestSuffixes([], [], window)
            for batch in batches:
                column = batch.column("text")
                n_words, spans, items = _matches(column, tests, batch.column("spans") if number else None)
                if number:
                    items = [x + (y.as_py() or []) for x, y in zip(items, batch.column("items"))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.nulls(len(column), pa.string()) if final else column,
                        pa.array(n_words),
                        pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        out = out.mapInArrow(search, schema)
        if final:
            break
        out = written(out, "matches")
        shipped.unpersist()
        block, number = following, number + 1
    return out.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items"))


def report(found: DataFrame) -> DataFrame:
    """The digest of :func:`matches`: hit words, items and their hash, ``longest`` run of hit words."""
    n_hit: Column = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["n"])), F.lit(0)).cast("long").alias("longest"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in which no window of a benchmark item occurs."""
    spark, out, shipped = docs.sparkSession, docs, None
    for block in _blocks(benchmark, item_id, item_text, window):
        if not len(block.length):
            continue
        if shipped:
            out = written(out, "clean")
            shipped.unpersist()
        shipped = spark.sparkContext.broadcast(block)
        place = docs.columns.index(text)

        def keep(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, _ = _matches(batch.column(place), shipped.value, None)
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
