"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Documents are sets of word shingles; two link when the Jaccard similarity of their sets is ``percent`` / 100 or more, that is
when they share T shingles or more, T = percent (|x| + |y|) / (100 + percent) rounded up.  No link between different texts is
lost; shingles are told apart by 64-bit hashes without structure (``words``).

1. *Sets.*  One row for each document: size, a 128-bit signature and a bitmap of its set.  Documents of equal sets are one node.
2. *Prefixes.*  In one global order of shingles, rare ones first, two linked sets share a shingle among their first
   |x| - ceil(percent |x| / 100) + 1.  The order only decides how much work there is: shingles that are frequent somewhere (counted
   over all texts, the ``FREQUENT`` most frequent kept) come last by count, the others before them by hash.
3. *Candidates.*  The documents of a prefix shingle are its inverted list; that of a frequent shingle is cut by document into parts.
   A short list gives all its pairs that sizes allow; of a long one (over ``SHORT``) each document is paired with a leader only.  A
   list that is cut counts as long, however short its parts are: its parts have met nowhere yet (steps 5 and 6 look at it whole).  A
   pair whose bitmaps differ in more bits than linked sets can differ in shingles is dropped.  First each document's pair of the
   longest list goes on, the others after step 5.
4. *T-occurrence search.*  The pairs' texts meet by query document, in groups of at most about ``GROUP`` candidates.  The query's shingles
   are looked up in the inverted lists of its candidates: the short lists are heap-merged and counted; the L longest, which near
   copies fill, are only probed by binary search for the candidates that can still reach T (DivideSkip).
5. *Components.*  Found links make components.  Of the remaining pairs those that lie in different components go through step 4
   in their turn, the others can join nothing any more.  With them, where lists over ``LONG`` have more than one component, go pairs
   of their documents and of a list's hubs, those with most such lists (whose text is the most common).
6. *What is left.*  The long lists that still have several components are compared by pairs of blocks.  A document's ``NEAREST`` possible
   links by bitmap go through steps 4 and 5.  Where there were more, and components are still apart, the texts of the two blocks
   meet in one task, which searches the inverted lists of the one with the other's documents and gives a spanning forest of
   the links.  So a group of near copies costs its documents, not its pairs, in whatever is joined or shuffled.

Words are lower-cased (A-Z) runs of anything but ASCII white space; a text of fewer words than a shingle is one shingle, a null or
empty text has none and links with nothing.  Rows with a null id are returned with their sizes, without component.  Rows that
share an id are one document, with the links of all its texts.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .words import U64, Chunk, by_key, chunks, mix64, ranges, sequence_hashes
from .work import written

SHINGLE, PERCENT = 4, 85
FREQUENT = 1 << 17
SHORT = 6
GROUP = 128
#: Bits of a bitmap: of the powers of two between these the first with two bits a shingle (in a search of blocks with eight).
BITS = (256, 1 << 15)
#: Rows of lists that are worked on at a time; a list (or part of one) is never split.
BATCH_ROWS = 100_000
#: Members of a part of a frequent shingle's list.
PART = 4096
#: Members of a long list (of ``WEIGHT`` shingles) that are compared with each other, or with as many others, by one task.
BLOCK, WEIGHT = 2048, 512
#: Members from which on a list has hubs, and how many.
LONG, HUBS = 64, 4
#: Possible links of a document in a pair of blocks that are looked at one by one.
NEAREST = 16
#: Rows of ids up to which they are broadcast to the texts; beyond, the texts are shuffled.
BROADCAST_IDS = 500_000


def shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, and how many each text has."""
    s, e, at = chunk.words()
    h = chunk.lowered().word_hashes(s, e)
    grams = sequence_hashes(h, k)
    total = np.diff(at)
    out, count = [], np.zeros(len(chunk), np.int64)
    for i in range(len(chunk)):
        n = int(total[i])
        if n >= k:
            v = np.sort(grams[at[i] : at[i] + n - k + 1])
            if len(v) > 1:
                v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        elif n:
            v = mix64(sequence_hashes(h[at[i] : at[i + 1]], n) ^ U64(n))  # not to be taken for a whole shingle
        else:
            continue
        out.append(v)
        count[i] = len(v)
    return (np.concatenate(out) if out else np.zeros(0, U64)), count


def required(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """T, the shingles that linked sets of these sizes share at least."""
    return -(-percent * (x + y) // (100 + percent))


def _per_text(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, shingles, their offsets and their number for each text, a chunk at a time."""
    for chunk in chunks(column):
        v, count = shingles(chunk, k)
        yield chunk.first, v, np.cumsum(count) - count, count


def _signature(v: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x51ED270B8B5B2F3D, 0xB492B66FBE98F273):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(v ^ U64(salt)))])
        out.append(mix64(sums[begin + count] - sums[begin] + count.astype(U64)).view(np.int64))
    return out[0], out[1]


def _bitmaps(v: np.ndarray, count: np.ndarray, each: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The parities of each set's hashes by some of their bits, in 64-bit words, and where each set's begin.  Folding a bitmap, one
    half on the other, gives the bitmap of half the length."""
    size = np.clip(1 << np.ceil(np.log2(np.maximum(each * count, 1))).astype(np.int64), *BITS)
    ends = np.cumsum(size)
    place = np.repeat(ends - size, count) + ((v >> U64(32)).astype(np.int64) & np.repeat(size - 1, count))
    odd = (np.bincount(place, minlength=int(size.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(U64), np.concatenate([[0], ends]) // 64


class Bitmaps:
    """Bitmaps of sets of some sizes: words, where each begins, and the sets' sizes in the order of the bitmaps."""

    def __init__(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray):
        self.width, self.sizes = np.diff(at), sizes
        self.bits = np.zeros((len(sizes), int(self.width.max(initial=1))), U64)
        self.bits[np.repeat(np.arange(len(sizes)), self.width), ranges(np.zeros(len(sizes), np.int64), self.width)] = words
        self.half = np.zeros_like(self.bits)
        for w in np.unique(self.width).tolist():
            rows = self.width == w
            self.half[rows, : w // 2] = self.bits[rows, : w // 2] ^ self.bits[rows, w // 2 : 2 * (w // 2)]

    def near(self, x: int, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the sets ``y`` that may link with x, and in how many bits they differ from it."""
        w = int(self.width[x])
        other = np.where((self.width[y] == 2 * w)[:, None], self.half[y, :w], self.bits[y, :w]) ^ self.bits[x, :w]
        other = np.where((2 * self.width[y] == w)[:, None], self.bits[y, :w] ^ self.half[x, :w], other)
        apart = np.bitwise_count(other).sum(1, dtype=np.int64)
        n = self.sizes
        able = apart <= n[x] + n[y] - 2 * required(n[x], n[y], percent)
        able |= (self.width[y] != w) & (self.width[y] != 2 * w) & (2 * self.width[y] != w)
        return y[able], apart[able]


def _sets(given: DataFrame, k: int) -> DataFrame:
    """``doc_id``, ``row``, ``n``, signature ``s1``, ``s2`` and ``bits``, the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, v, begin, count in _per_text(batch.column("text"), k):
                part = batch.slice(first, len(count))
                s1, s2 = _signature(v, begin, count)
                words, at = _bitmaps(v, count)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(count), pa.array(s1), pa.array(s2), lists], names=["doc_id", "row", "n", "s1", "s2", "bits"])

    return given.mapInArrow(run, "doc_id long, row long, n long, s1 long, s2 long, bits array<long>")


def _frequent(given: DataFrame, k: int, least: int = 4, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of the shingles that a group of texts (with ``most`` shingles together) has ``least`` times, the rarest
    first, and how often these groups have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= least
            return pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, v, _, _ in _per_text(batch.column("text"), k):
                held.append(v)
                if sum(map(len, held)) >= most:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    rows = given.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    return rows["token"].to_numpy().view(U64)[::-1].copy(), rows["n"].to_numpy()[::-1].copy()


def _prefixes(given: DataFrame, k: int, percent: int) -> DataFrame:
    """``token``, ``size`` (part of its list, from 1, or 0 if that is whole, and in the lower half the set's) and ``node`` (the set's ``s1``) for each shingle of a
    set's prefix; each set once for each batch."""
    frequent, often = _frequent(given, k)
    order = np.argsort(frequent)
    shipped = given.sparkSession.sparkContext.broadcast((frequent[order], order, often // PART + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, parts = shipped.value
        for batch in batches:
            seen: set[int] = set()
            for _, v, begin, count in _per_text(batch.column("text"), k):
                s1, _ = _signature(v, begin, count)
                last = np.full(len(v), -1)
                if len(known) and len(v):
                    place = np.minimum(np.searchsorted(known, v), len(known) - 1)
                    same = known[place] == v
                    last[same] = rank[place[same]]
                size = count - -(-percent * count // 100) + 1
                tokens, part, nodes, ns = [], [], [], []
                for i in np.flatnonzero(count).tolist():
                    node, n = int(s1[i]), int(count[i])
                    if node in seen:
                        continue
                    seen.add(node)
                    b, late = begin[i], last[begin[i] : begin[i] + n]
                    if (late >= 0).any():
                        own = np.argsort(late, kind="stable")[: size[i]]  # those of rank -1 by hash, then the others
                        tokens.append(v[b + own])
                        part.append(np.where((late[own] >= 0) & (parts[late[own]] > 1), (node & (1 << 62) - 1) % parts[late[own]] + 1, 0))
                    else:
                        tokens.append(v[b : b + size[i]])
                        part.append(np.zeros(size[i], np.int64))
                    nodes.append(node)
                    ns.append(n)
                if tokens:
                    m = np.array([len(x) for x in tokens])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array((np.concatenate(part) << 32) + np.repeat(ns, m)), pa.array(np.repeat(nodes, m), pa.int64())], names=["token", "size", "node"])

    return given.mapInArrow(run, "token long, size long, node long")


def _lists(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[int, int]]:
    new = np.zeros(len(batch), bool)
    new[0] = True
    for x in keys:
        c = batch.column(x).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    return zip(begin.tolist(), np.append(begin[1:], len(batch)).tolist())


def _dealt(df: DataFrame, keys: list[str], then: list) -> DataFrame:
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *then)


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """``kind`` 0: pairs of nodes ``a``, ``b``; ``kind`` 1: the members ``a`` of long lists and of lists in parts, whose shingle is ``b``.  ``m``: how long the
    list is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, ["token", "part"], BATCH_ROWS):
            token, part, node, n = (batch.column(x).to_numpy() for x in ("token", "part", "node", "n"))
            kinds, a, b, sizes = [], [], [], []
            for i, j in _lists(batch, ["token", "part"]):
                if j - i < 2 and not part[i]:
                    continue
                new = np.concatenate([[True], node[i + 1 : j] != node[i : j - 1]])
                x, size = node[i:j][new], n[i:j][new].astype(np.int64)
                m = len(x)
                upto = np.searchsorted(size, 100 * size // percent, "right")  # a set can be linked with one at least as large up to there
                found = len(a)
                if m <= SHORT:
                    count = np.maximum(0, upto - np.arange(m) - 1)
                    a.append(np.repeat(x, count))
                    b.append(x[ranges(np.arange(1, m + 1), count)])
                    kinds.append(np.zeros(len(a[-1]), np.int8))
                else:
                    lead = 0
                    while lead < m:
                        a.append(np.repeat(x[lead], upto[lead] - lead - 1))
                        b.append(x[lead + 1 : upto[lead]])
                        kinds.append(np.zeros(len(a[-1]), np.int8))
                        lead = int(upto[lead])
                if m > SHORT or part[i]:
                    a.append(x)
                    b.append(np.repeat(token[i], m))
                    kinds.append(np.ones(m, np.int8))
                sizes += [np.full(len(y), m, np.int32) for y in a[found:]]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (kinds, a, b, sizes)], names=["kind", "a", "b", "m"])

    part, n = F.shiftright("size", 32), F.col("size").bitwiseAND((1 << 32) - 1)
    tasks = max(1, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prefixes.repartition(tasks, "token", part).sortWithinPartitions("token", "size", "node")
    return dealt.select("token", part.alias("part"), "node", n.alias("n")).mapInArrow(run, "kind byte, a long, b long, m int")


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of pairs of ``s1``, those of nodes that sizes and bitmaps allow a link: ids and rows of both, the smaller set first."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("s1")).distinct(), "ends")
    if ids.count() <= BROADCAST_IDS:
        nodes = nodes.join(F.broadcast(ids), "s1", "left_semi")
    side = lambda x: nodes.select(F.col("s1").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "rep_row", "n", "bits")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("rep_a <> rep_b OR rep_row_a <> rep_row_b")
    total = F.col("n_a") + F.col("n_b")
    need = F.floor((percent * total + 99 + percent) / (100 + percent))
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    half = lambda x: xor(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")))
    longer = lambda x, y: F.size(x) == 2 * F.size(y)
    a, b = F.col("bits_a"), F.col("bits_b")
    differ = F.when(F.size(a) == F.size(b), xor(a, b)).when(longer(a, b), xor(half(a), b)).when(longer(b, a), xor(a, half(b))).otherwise(F.array())
    apart = F.aggregate(differ, F.lit(0), lambda s, x: s + F.bit_count(x))
    fits = apart <= total - 2 * need
    kept = both.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & fits)
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.struct("rep_a", "rep_row_a") < F.struct("rep_b", "rep_row_b")))
    pick = lambda c, x, y: F.when(first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}"))
    ends = {"a": pick("rep", "a", "b"), "a_row": pick("rep_row", "a", "b"), "b": pick("rep", "b", "a"), "b_row": pick("rep_row", "b", "a")}
    return kept.select(*[x.alias(c) for c, x in ends.items()], "m").groupBy(*ends).agg(F.max("m").alias("m"))


class Lists:
    """The inverted lists of some sets: their shingles, whose they are, and the sets' sizes."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((owner, tokens))
        tokens, self.member, self.sizes = tokens[order], owner[order], sizes
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.begin = np.flatnonzero(new)
        self.token, self.length = tokens[self.begin], np.diff(np.append(self.begin, len(tokens)))
        # the members of a list are in order, and the lists one after the other
        self.key = np.repeat(np.arange(len(self.token)), self.length) * len(sizes) + self.member

    def search(self, query: np.ndarray, percent: int, able: np.ndarray | None = None) -> np.ndarray:
        """T-occurrence search with DivideSkip: which of the sets (those marked ``able``) share enough shingles with ``query``."""
        need = required(np.full(len(self.sizes), len(query)), self.sizes, percent)
        if able is not None:
            need = np.where(able, need, len(query) + 1)
        t = int(need.min(initial=len(query) + 1))
        if t > len(query) or not len(self.token):
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        lists = place[self.token[place] == query]
        longest = int(self.length[lists].max(initial=0))
        n_long = min(t - 1, int(t / (0.0085 * np.log2(max(2, longest)) + 1)), len(lists))
        lists = lists[np.argsort(-self.length[lists], kind="stable")]
        long, short = lists[:n_long], lists[n_long:]
        count = np.zeros(len(self.sizes), np.int64)
        ends = zip(self.begin[short].tolist(), self.length[short].tolist())
        for x, same in groupby(heapq.merge(*[self.member[i : i + n].tolist() for i, n in ends])):
            count[x] = sum(1 for _ in same)
        some = np.flatnonzero(count >= need - n_long)
        if len(some) and n_long:
            # binary search in all of the long lists
            probe = (long[:, None] * len(self.sizes) + some[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
            count[some] += (self.key[at] == probe).reshape(len(long), len(some)).sum(0)
        return some[count[some] >= need[some]]


def divide_skip(query: np.ndarray, tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of some candidates share enough shingles with ``query``.  ``tokens`` and ``owner``: the candidates' shingles and whose they
    are; ``sizes``: of each candidate's set."""
    hit = query[np.minimum(np.searchsorted(query, tokens), len(query) - 1)] == tokens
    return Lists(tokens[hit], owner[hit], sizes).search(query, percent)


def spanning_links(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between ``sets`` of different components (``root``) that join these as all links would: between those of
    ``side`` 0 and those of side 1, or, if all are of one side, between any."""
    group = np.unique(root, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets], np.int64)
    queries, data = np.flatnonzero(side == side[0]), np.flatnonzero(side == side[-1])
    if len(np.unique(group[queries])) > len(np.unique(group[data])):
        queries, data = data, queries
    bitmaps = Bitmaps(*_bitmaps(np.concatenate(sets), sizes, 8), sizes)
    lists, place = None, np.zeros(len(sets), np.int64)
    place[data] = np.arange(len(data))
    for q in queries.tolist():
        able = (group[data] != group[q]) & (100 * np.minimum(sizes[data], sizes[q]) >= percent * np.maximum(sizes[data], sizes[q]))
        some, _ = bitmaps.near(q, data[able], percent)
        if not len(some):
            continue
        if 8 * len(some) < len(data):
            found = some[divide_skip(sets[q], np.concatenate([sets[y] for y in some]), np.repeat(np.arange(len(some)), sizes[some]), sizes[some], percent)]
        else:
            if lists is None:
                lists = Lists(np.concatenate([sets[y] for y in data]), np.repeat(np.arange(len(data)), sizes[data]), sizes[data])
            able = np.zeros(len(data), bool)
            able[place[some]] = True
            found = data[lists.search(sets[q], percent, able)]
        for y in found.tolist():
            if group[y] != group[q]:
                group[group == group[y]] = group[q]
                yield q, y


def _verified(pairs: DataFrame, given: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, ``a`` and ``b``."""
    pairs = written(pairs.select("a", "a_row", "b", "b_row"), "pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    counts = pairs.groupBy("a", "a_row").agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("b_row"), F.ceil(F.col("c") / GROUP)).cast("int")
    pairs = pairs.join(counts, ["a", "a_row"]).select("a", "a_row", part.alias("part"), F.col("b").alias("doc_id"), F.col("b_row").alias("row"), F.lit(1).alias("side"))
    queries = pairs.select("a", "a_row", "part", F.col("a").alias("doc_id"), F.col("a_row").alias("row"), F.lit(0).alias("side")).distinct()
    wanted = written(pairs.unionByName(queries), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    rows = given.join(F.broadcast(wanted) if few else wanted, ["doc_id", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
            """Query (id, row, part), its shingles, candidates' ids and shingles."""
            query, own, ids, sets = None, None, [], []
            for batch in batches:
                a, row, part, b, side = (batch.column(x).to_pylist() for x in ("a", "a_row", "part", "doc_id", "side"))
                for first, v, begin, count in _per_text(batch.column("text"), k):
                    for i in range(len(count)):
                        j = first + i
                        key, x = (a[j], row[j], part[j]), v[begin[i] : begin[i] + count[i]]
                        if key != query:
                            if ids:
                                yield query, own, ids, sets
                            query, own, ids, sets = key, None, [], []
                        if side[j] == 0:
                            own = x
                        else:
                            ids.append(b[j])
                            sets.append(x)
            if ids:
                yield query, own, ids, sets

        left, right = [], []
        for (a, _, _), own, ids, sets in groups():
            size = np.array([len(x) for x in sets])
            for i in divide_skip(own, np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size, percent).tolist():
                left.append(a)
                right.append(ids[i])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return written(_dealt(rows, ["a_row", "part", "a"], ["side", "doc_id"]).mapInArrow(run, "a long, b long").distinct(), "links")


def _rooted(rows: DataFrame, roots: DataFrame, column: str = "rep") -> DataFrame:
    """``rows`` with the ``root`` of the node in ``column``."""
    to = roots.select(F.col("node").alias(column), F.col("root").alias("_to"))
    few = roots.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(to) if few else to, column, "left").withColumn("root", F.coalesce("_to", column)).drop("_to")


def _several(rows: DataFrame) -> DataFrame:
    """Those of the members of lists whose list has more than one root."""
    several = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    return written(rows.join(several, "token"), "members")


def _members(found: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``token``, ``s1``, ``n`` and ``root`` of the members of the long lists that have more than one root."""
    rows = found.where("kind = 1").select(F.col("a").alias("s1"), F.col("b").alias("token"))
    return _several(_rooted(rows.join(nodes.select("s1", "n", "rep"), "s1"), roots).drop("rep"))


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` of ``s1``: of members of lists over ``LONG``, and of the hubs that sizes allow for each part the one that it meets
    most often.  A list's hubs are those of its members that are of greatest degree (number of such lists) in each of ``HUBS`` parts."""
    rows = written(rows.join(rows.groupBy("token").count().where(F.col("count") > LONG).select("token"), "token"), "large-lists")
    rows = rows.join(rows.groupBy("s1").agg(F.count("*").alias("degree")), "s1")
    part = lambda i: F.pmod(F.xxhash64(F.lit("hub"), "s1"), F.lit(HUBS)) == i
    chosen = rows.groupBy("token").agg(*[F.max(F.when(part(i), F.struct("degree", F.col("s1").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("a_n"), F.lit(i).alias("i")))).alias(f"h{i}") for i in range(HUBS)])
    hubs = chosen.select("token", F.explode(F.filter(F.array(*[f"h{i}" for i in range(HUBS)]), lambda x: x.isNotNull())).alias("hub")).select("token", "hub.a", "hub.a_root", "hub.a_n", "hub.i")
    fit = 100 * F.least("n", "a_n") >= percent * F.greatest("n", "a_n")
    met = rows.join(hubs, "token").where((F.col("root") != F.col("a_root")) & fit).groupBy("a", F.col("s1").alias("b"), "i").agg(F.count("*").alias("c"))
    return met.groupBy("b", "i").agg(F.max(F.struct("c", "a")).alias("x")).select("x.a", "b").distinct()


def _blocks(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The members of long lists with more than one root, each in a ``block``, and the pairs ``x``, ``y`` of a list's blocks that are to be
    compared.  A list that weighs as much as ``BLOCK`` members of ``WEIGHT`` shingles is one block; a heavier one is dealt by size,
    and then a heavy root over blocks of its own, which are not compared with each other."""
    weight = F.greatest(F.lit(1.0), F.col("n") / WEIGHT)
    per_root = written(rows.groupBy("token", "root").agg(F.sum(weight).alias("r")), "per-root")
    some = per_root.groupBy("token").agg(F.sum("r").alias("c"))
    rows = rows.join(some, "token").join(per_root.where(F.col("r") > BLOCK), ["token", "root"], "left")
    own, many = F.col("r").isNotNull(), F.col("c") > BLOCK
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    part = F.when(own, F.pmod(F.xxhash64("s1"), F.ceil(F.col("r") / BLOCK))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("c") / BLOCK)))
    block = F.when(many, F.xxhash64(F.when(own, F.col("root")), own, size, part)).otherwise(F.lit(0).cast("long"))
    rows = written(rows.select("token", "s1", "n", "root", block.alias("block")), "blocks")
    blocks = rows.groupBy("token", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("root").alias("first"), F.max("root").alias("last"))
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}_{z}") for c in ("block", "lo", "hi", "first", "last")]) for z in "xy")
    differ = ~((F.col("first_x") == F.col("last_y")) & (F.col("last_x") == F.col("first_y")))
    fit = (100 * F.col("hi_x") >= percent * F.col("lo_y")) & (100 * F.col("hi_y") >= percent * F.col("lo_x"))
    pairs = x.join(y, "token").where((F.col("block_x") <= F.col("block_y")) & differ & fit)
    return rows, written(pairs.select("token", F.col("block_x").alias("x"), F.col("block_y").alias("y")), "block-pairs")


def _sides(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    one = rows.join(pairs.withColumn("block", F.col("x")), ["token", "block"]).withColumn("side", F.lit(0))
    two = rows.join(pairs.where("x <> y").withColumn("block", F.col("y")), ["token", "block"]).withColumn("side", F.lit(1))
    return one.unionByName(two).drop("block")


def _across(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of members of a long list that are in different components and may link: ``kind`` 0, pairs ``a``, ``b`` of ``s1``, for
    each member of a pair of blocks at most its ``NEAREST``; ``kind`` 1, the ``token``, ``x`` and ``y`` of pairs of blocks that had
    more."""
    dealt = _sides(rows, pairs).join(nodes.select("s1", "bits"), "s1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, ["token", "x", "y"], min(BATCH_ROWS, 2 * BLOCK)):
            token, bx, by, s1, n, root, side = (batch.column(x).to_numpy() for x in ("token", "x", "y", "s1", "n", "root", "side"))
            lists = batch.column("bits")
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])
            bitmaps = Bitmaps(lists.flatten().to_numpy().view(U64), at, n.astype(np.int64))
            a, b, more = [], [], []
            for i, j in _lists(batch, ["token", "x", "y"]):
                upto = i + np.searchsorted(n[i:j], 100 * n[i:j] // percent, "right")
                cut = False
                for x in range(i, j):
                    y = np.arange(x + 1, upto[x - i])
                    y = y[(root[y] != root[x]) & ((bx[i] == by[i]) | (side[y] != side[x]))]
                    if len(y):
                        y, apart = bitmaps.near(x, y, percent)
                    if len(y) > NEAREST:
                        cut, y = True, y[np.argsort(apart, kind="stable")[:NEAREST]]
                    if len(y):
                        a.append(np.repeat(s1[x], len(y)))
                        b.append(s1[y])
                if cut:
                    more.append(i)
            if a:
                found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                m, none = len(found) + len(more), np.zeros(len(more), np.int64)
                block = [np.concatenate([np.zeros(len(found), np.int64), x[more]]) for x in (token, bx, by)]
                yield pa.RecordBatch.from_arrays([pa.array((np.arange(m) >= len(found)).astype(np.int8)), *[pa.array(np.concatenate([found[:, c], none])) for c in (0, 1)], *map(pa.array, block)], names=["kind", "a", "b", "token", "x", "y"])

    return _dealt(dealt, ["token", "x", "y"], ["n", "s1"]).mapInArrow(run, "kind byte, a long, b long, token long, x long, y long")


def _searched(rows: DataFrame, pairs: DataFrame, nodes: DataFrame, roots: DataFrame, given: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` that join the components of members of pairs of blocks, as far as these differ, as all their links would."""
    sides = _sides(rows.select("token", "block", "s1"), pairs).join(nodes.select("s1", "n", "rep", "rep_row"), "s1")
    sides = written(_rooted(sides, roots), "sides")
    several = sides.groupBy("token", "x", "y").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").drop("lo", "hi")
    wanted = sides.join(several, ["token", "x", "y"])
    texts = given.join(wanted.withColumnsRenamed({"rep": "doc_id", "rep_row": "row"}), ["doc_id", "row"]).select("token", "x", "y", "side", "doc_id", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, ["token", "x", "y"], 1):
            sets = [v[i : i + n] for _, v, begin, count in _per_text(batch.column("text"), k) for i, n in zip(begin.tolist(), count.tolist())]
            doc, root, side = (batch.column(x).to_numpy() for x in ("doc_id", "root", "side"))
            for i, j in _lists(batch, ["token", "x", "y"]):
                found = [(doc[i + a], doc[i + b]) for a, b in spanning_links(sets[i:j], root[i:j], side[i:j], percent)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return written(_dealt(texts, ["token", "x", "y"], ["side", "doc_id"]).mapInArrow(run, "a long, b long").distinct(), "links")


def clusters(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: ``doc_id``, ``row`` (a hash of id and text), ``n_shingles`` and ``component_id``, the smallest id that it is
    linked with over any number of links (its own, if none is smaller)."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    sets = written(_sets(given, shingle), "sets")
    some = sets.where("doc_id IS NOT NULL AND n > 0")
    least = F.min(F.struct("doc_id", "row"))
    nodes = written(some.groupBy("s1", "s2").agg(least.alias("least"), F.max("n").alias("n"), F.min_by("bits", F.struct("doc_id", "row")).alias("bits")).select("s1", "s2", F.col("least.doc_id").alias("rep"), F.col("least.row").alias("rep_row"), "n", "bits"), "nodes")
    found = written(_candidates(_prefixes(given.where("doc_id IS NOT NULL"), shingle, percent), percent).groupBy("kind", "a", "b").agg(F.max("m").alias("m")), "candidates")
    pairs = written(_possible(found.where("kind = 0").select("a", "b", "m"), nodes, percent), "possible")
    best = pairs.groupBy("b", "b_row").agg(F.max_by(F.struct("a", "a_row"), F.struct("m", -F.col("a"), "a_row")).alias("x")).select("x.a", "x.a_row", "b", "b_row")
    roots = components(_verified(best, given, shingle, percent))
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    apart = pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "a_row", "b", "b_row")
    members = _members(found, nodes, roots)
    hubs = _possible(written(_hubs(members, percent), "hubs").withColumn("m", F.lit(0)), nodes, percent).select("a", "a_row", "b", "b_row")
    roots = components(_verified(apart.unionByName(hubs).distinct(), given, shingle, percent), roots)
    rows, pairs = _blocks(_several(_rooted(members.withColumnRenamed("root", "first"), roots, "first").drop("first")), percent)
    if not pairs.isEmpty():
        across = written(_across(rows, pairs, nodes, percent), "across")
        near = written(across.where("kind = 0").select("a", "b").distinct(), "near").withColumn("m", F.lit(0))
        roots = components(_verified(_possible(near, nodes, percent), given, shingle, percent), roots)
        more = across.where("kind = 1").select("token", "x", "y")
        if not more.isEmpty():
            roots = components(_searched(rows, more, nodes, roots, given, shingle, percent), roots)
    rep = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id"))
    rows = sets.join(nodes.select("s1", "s2", "rep"), ["s1", "s2"], "left").select("doc_id", "row", F.col("n").alias("n_shingles"), rep.alias("rep"))
    repeated = written(sets.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():  # an id links the nodes of its texts, which may go by smaller ids
        roots = components(rows.join(repeated, "doc_id").where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), roots)
    return rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "row", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, columns unchanged, of the smallest id of each component.  Of rows that share an id, the one of least
    text stays; rows without id and rows without shingles (but for repeated ids) all stay."""
    found = written(clusters(docs, doc_id=doc_id, text=text, shingle=shingle, percent=percent), "clusters")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, doc_id, "left_anti").select(docs.columns)
    repeated = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(doc_id)).count().where("count > 1").select(doc_id), "repeated")
    n = repeated.count()
    if not n:
        return out
    ids = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    mark = "order_" + uuid.uuid4().hex
    order = Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last(), *[F.col(c) for c in docs.columns if c not in (doc_id, text) and not docs.schema[c].dataType.typeName() in ("map", "variant")])
    first = out.join(ids, doc_id, "left_semi").select(docs.columns).withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    # an anti join keeps the rows without id
    return out.join(ids, doc_id, "left_anti").select(docs.columns).unionByName(first)
