"""Substring dedup: prefix-partitioned suffix trees over words.

A word goes if a window of ``WINDOW`` words covers it whose word sequence also starts earlier (smaller id, or the same document
further up).  Windows are the suffixes cut at the depth that matters: a node of a suffix tree at that depth is a repeat, its first
leaf stays, its other leaves go, and runs of such leaves are the maximal repeats.

1. *Anchors.*  Of the ``PREFIX``-word prefixes that start inside a window, the one of least hash is its anchor: equal windows
   have equal anchors at equal places, and an eighth of all positions are anchors.  Anchors are counted with a grouped sum; a
   window whose anchor occurs once repeats nothing and goes no further.
2. *Local trees.*  Each task builds the subtrees of the windows left in its texts.  Of a node it keeps the first leaf; the
   others are known repeats.  So no group has more leaves of a node than there are tasks, whatever the data repeat.
3. *Prefix groups.*  The first leaves, as runs of windows with one anchor, are dealt out by that prefix; where a prefix occurs more
   than ``HEAVY`` times, by the longest one, the whole window.  A task sorts its groups by key and builds the subtrees of one
   memory-sized batch of groups after the other.
4. Each document gets its repeated windows back and loses the words.

Subtrees are built by naming: the words of a batch get numbers, then all sequences of 2, 4, 8 ... words get the number of the pair
of their halves, up to the window's length: equal numbers are one node, exactly, without hashing.  (Hashes only decide who meets
whom; anchors of equal hash at different words cost time, not correctness.)

Words are runs of anything but ASCII white space.  A null text has no words.  Rows with a null id keep all words and make no
other row lose any.  Rows that repeat an id are told apart by their text; wholly equal rows are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import written
from .words import U64, Chunk, by_key, chunks, mix64, ranges, row_of, sequence_hashes, starts_within

WINDOW = 20
PREFIX = 6
HEAVY = 256
#: Rows of prefix groups whose subtrees are built at a time; a group is never split.
BATCH_ROWS = 20_000

_RUNS = "key long, doc_id long, row long, start int, n int, words binary"


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each on."""
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def _windows(chunk: Chunk, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Words (begin, end, of each text); the windows' starts, the word at which each window's anchor starts, the anchors' hashes."""
    s, e, at = chunk.words()
    h = chunk.word_hashes(s, e)
    start = starts_within(at, window)
    if not len(start):
        return s, e, at, start, start, np.zeros(0, U64), h
    grams = sequence_hashes(h, prefix)
    key = (grams >> U64(32) << U64(32)) | np.arange(len(grams), dtype=U64)
    anchor = (_least(key, window - prefix + 1)[start] & U64(0xFFFFFFFF)).astype(np.int64)
    return s, e, at, start, anchor, grams, h


def _numbered(x: np.ndarray | pa.Array) -> np.ndarray:
    return pc.dictionary_encode(x if isinstance(x, pa.Array) else pa.array(x)).indices.to_numpy().astype(np.int64)


def _nodes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """The tree node at depth ``window`` of the suffixes that start at some words; ``words``: the number of each word."""
    names, size = {1: words}, 1
    while size * 2 <= window:
        a = names[size]
        names[size * 2] = _numbered((a[:-size] << 32) | a[size:]) if len(a) > size else a[:0]
        size *= 2
    node, depth = names[size][starts], size
    while depth < window:
        size = 1 << ((window - depth).bit_length() - 1)
        node = _numbered((node << 32) | names[size][starts + depth])
        depth += size
    return node


def _later(node: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which leaves are not the first of their node; leaves of the same document and start are one."""
    order = np.lexsort((start, doc, node))
    new = np.ones(len(order), bool)
    new[1:] = node[order][1:] != node[order][:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return later


def _word_numbers(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    ends = np.cumsum(e - s)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    raw = data[ranges(s, e - s)]
    return _numbered(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]))


def _run_starts(*parts: np.ndarray) -> np.ndarray:
    """Where runs begin: the first of ``parts`` goes up by one inside a run, the others stay."""
    new = np.ones(len(parts[0]), bool)
    new[1:] = parts[0][1:] != parts[0][:-1] + 1
    for x in parts[1:]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _out(key: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, words: pa.Array | None = None) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64), pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), words if words is not None else pa.nulls(len(doc), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split(" ")[0] for x in _RUNS.split(", ")])


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, heavy: int = HEAVY) -> DataFrame:
    """Runs of windows that also start earlier: ``doc_id``, ``row`` (a hash of id and text), ``start`` (word, from 0) and ``n``, the
    windows of the run; its ``n + window - 1`` words are a repeat that no more words before or after belong to."""
    given = _given(docs, doc_id, text)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            for chunk in chunks(batch.column("text")):
                _, _, at, _, anchor, grams, _ = _windows(chunk, window, prefix)
                place = np.unique(anchor)
                own = row[chunk.first + np.searchsorted(at, place, "right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(grams[place].view(np.int64)), pa.array(own, pa.int64())], names=["anchor", "row"])

    found = given.where("doc_id IS NOT NULL").mapInArrow(anchors, "anchor long, row long")
    often = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > heavy).alias("heavy")), "anchors")
    wanted = found.join(often, "anchor").groupBy("row").agg(F.collect_set(F.struct("anchor", "heavy")).alias("wanted"))
    rows = given.join(wanted, "row").select("doc_id", "row", "text", F.col("wanted.anchor").alias("anchor"), F.col("wanted.heavy").alias("heavy"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            for chunk in chunks(batch.column("text"), 4 << 20):
                s, e, at, start, anchor, grams, h = _windows(chunk, window, prefix)
                if not len(start):
                    continue
                text_of = np.searchsorted(at, start, "right") - 1
                lists = batch.column("anchor").slice(chunk.first, len(chunk))
                salt = mix64(np.arange(len(chunk), dtype=U64))
                listed = lists.flatten().to_numpy().view(U64) ^ np.repeat(salt, lists.value_lengths().to_numpy())
                order = np.argsort(listed)
                listed, heavier = listed[order], batch.column("heavy").slice(chunk.first, len(chunk)).flatten().to_numpy(zero_copy_only=False)[order]
                place = np.minimum(np.searchsorted(listed, grams[anchor] ^ salt[text_of]), len(listed) - 1)
                some = np.flatnonzero(listed[place] == grams[anchor] ^ salt[text_of])
                if not len(some):
                    continue
                start, anchor, text_of, is_heavy = start[some], anchor[some], text_of[some], heavier[place[some]]
                # the words under these windows, closed up: a window's words stay together
                cover = np.zeros(len(s) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + window, -1)
                under = np.cumsum(cover[:-1]) > 0
                closed = np.cumsum(under) - 1
                node = _nodes(_word_numbers(chunk.data, s[under], e[under]), closed[start], window)
                doc, first = ids[chunk.first + text_of], start - at[text_of]
                later = _later(node, doc, first)
                for known in (True, False):
                    k = np.flatnonzero(later == known)
                    if not len(k):
                        continue
                    if known:
                        begin = _run_starts(start[k], text_of[k])
                    else:
                        single = np.cumsum(is_heavy[k])  # a run of their own each
                        begin = _run_starts(start[k], text_of[k], anchor[k], single)
                    n = np.diff(np.append(begin, len(k)))
                    k = k[begin]
                    if known:
                        yield _out(mix64(row[chunk.first + text_of[k]].view(U64)), doc[k], row[chunk.first + text_of[k]], first[k], n)
                        continue
                    whole = sequence_hashes(h, window)
                    key = np.where(is_heavy[k], whole[start[k]], grams[anchor[k]])
                    size = n + window - 1
                    at_words = ranges(start[k], size)
                    length = e[at_words] - s[at_words] + 1
                    raw = chunk.data[np.minimum(ranges(s[at_words], length), len(chunk.data) - 1)]
                    ends = np.cumsum(length)
                    raw[ends - 1] = 0x20
                    offsets = np.concatenate([[0], ends[np.cumsum(size) - 1] ]).astype(np.int32)
                    words = pa.BinaryArray.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
                    yield _out(key, doc[k], row[chunk.first + text_of[k]], first[k], n, words)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def subtrees(part: pa.Table) -> Iterator[pa.RecordBatch]:
            known = part.filter(pc.is_null(part["words"]))
            if known.num_rows:
                yield from known.to_batches()
            part = part.filter(pc.is_valid(part["words"])).combine_chunks()
            if not part.num_rows:
                return
            for x in part.to_batches():
                n, size = x.column("n").to_numpy().astype(np.int64), None
                chunk = next(chunks(x.column("words").cast(pa.large_binary()).view(pa.large_string()), 1 << 40))
                s, e, at = chunk.words()
                size = np.diff(at)
                which = np.repeat(np.arange(len(n)), n)
                start = ranges(at[:-1], n)
                assert (size == n + window - 1).all()
                node = _nodes(_word_numbers(chunk.data, s, e), start, window)
                doc, first = x.column("doc_id").to_numpy()[which], x.column("start").to_numpy()[which] + (start - at[which])
                k = np.flatnonzero(_later(node, doc, first))
                if len(k):
                    begin = _run_starts(first[k], which[k])
                    count = np.diff(np.append(begin, len(k)))
                    k = k[begin]
                    yield _out(np.zeros(len(k), U64), doc[k], x.column("row").to_numpy()[which[k]], first[k], count)

        for batch in by_key(batches, ["key"], BATCH_ROWS):
            yield from subtrees(pa.Table.from_batches([batch]))

    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(local, _RUNS).repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(groups, _RUNS).select("doc_id", "row", "start", "n")


def _given(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text"))


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, heavy: int = HEAVY) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by blanks; null for a null
    text) and ``kept_sha256`` of its bytes."""
    runs = repeated_windows(docs, doc_id=doc_id, text=text, window=window, prefix=prefix, heavy=heavy)
    # by ``row`` alone, as in ``repeated_windows``: Spark deals the texts out once for both joins
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("doc_id", "start", "n")).alias("runs"))
    own = F.filter("runs", lambda x: x["doc_id"] == F.col("doc_id"))
    rows = _given(docs, doc_id, text).join(listed, "row", "left").select("doc_id", "text", own.alias("own")).select("doc_id", "text", F.col("own.start").alias("start"), F.col("own.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                part = batch.slice(chunk.first, len(chunk))
                s, e, at = chunk.words()
                starts, n = part.column("start"), part.column("n")
                size = pc.fill_null(starts.value_lengths(), 0).to_numpy().astype(np.int64)
                begin = starts.flatten().to_numpy().astype(np.int64) + np.repeat(at[:-1], size)
                cover = np.zeros(len(s) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + n.flatten().to_numpy() + window - 1, -1)
                gone = np.cumsum(cover[:-1]) > 0
                stay = np.flatnonzero(~gone)
                length = e[stay] - s[stay] + 1
                raw = chunk.data[np.minimum(ranges(s[stay], length), max(0, len(chunk.data) - 1))]
                ends = np.cumsum(length)
                raw[ends - 1] = 0x20
                plain = raw.tobytes()
                owner = row_of(at)
                kept = np.bincount(owner[stay], minlength=len(chunk))
                upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])].tolist()
                texts = [plain[a : b - 1] if b > a else b"" for a, b in zip(upto, upto[1:])]
                total = np.diff(at)
                nulls = part.column("text").is_null()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(total, pa.int64()),
                        pa.array(total - kept, pa.int64()),
                        pc.if_else(nulls, pa.nulls(len(part), pa.string()), pa.array(texts, pa.binary()).cast(pa.string())),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
                )

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
