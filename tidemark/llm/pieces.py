"""SentencePiece encoding by sampling, and decoding.

A text becomes words with their preceding blanks ("▁" for a blank, as the vocabulary has it), and each word a lattice of
pieces.  Forward filtering sums, for each position of each *distinct* word of a batch, the weights of all segmentations up to
it; backward sampling draws, for each *occurrence*, a piece that ends at its last position by its share of that sum, then one
that ends where that begins, and so on.  Draws are hashes of (seed, row key, word, step), so that a row's segmentation is the
same wherever and however often it is computed.  A character that no piece has falls back to its bytes.

The vocabulary's file is a parameter.  Its pieces (byte-pair, ranked) get the log-weight ``-alpha * log(2 + rank)``, the Zipf
form of their rank; a byte weighs as a piece of the last rank.

Decoding is lossless: every text equals the decoding of its ids, including texts with "▁" of their own (as bytes) and with
blanks of any kind and number.  A null text has null ids, an empty text none; a null key draws as key 0.  Texts are not altered
by normalisation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, mix64, ranges

ALPHA = 1.0
SEED = 20
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters that are worked on at a time (a longer text is a chunk of its own).
CHUNK_CHARS = 1 << 18
_BLANK = 0x2581


def _step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    return mix64((h ^ char.astype(U64)) * U64(0x9FB21C651E98DF25) + U64(1))


class Pieces:
    """A vocabulary: pieces by the hash of their characters, and the bytes that each id stands for."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        texts: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and "▁" not in piece[1:].lstrip("▁"):
                texts[piece] = i
                self.bytes[i] = piece.replace("▁", " ").encode()
        self.longest = max(map(len, texts))
        hashes = np.array([self._hash(x) for x in texts], U64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(texts.values()), np.int32)[order]
        # by the first bits of the hash: which strings may begin a piece, and the piece (its place + 1) that a string may be
        prefixes = {x[:k] for x in texts for k in range(1, len(x) + 1)}
        self.begins = np.zeros(1 << 20, bool)
        self.begins[[self._hash(x) >> 44 for x in prefixes]] = True
        self.slot = np.zeros(1 << 22, np.int32)
        marks = (self.hashes >> U64(42)).astype(np.int64)
        self.slot[marks] = np.arange(1, len(marks) + 1)
        times = np.bincount(marks, minlength=1 << 22)
        self.slot[times > 1] = -1  # more than one: search for it
        self.weight = -alpha * np.log(2.0 + np.arange(n))
        self.byte_weight = -alpha * float(np.log(2.0 + n))
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        """What :func:`_step` makes of the characters, in plain integers."""
        h, most = 0, (1 << 64) - 1
        for c in piece:
            x = ((h ^ ord(c)) * 0x9FB21C651E98DF25 + 1) & most
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & most
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & most
            h = x ^ (x >> 31)
        return h

    # --- encoding

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        size = np.array([len(x) for x in texts], np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        own = raw == _BLANK  # no piece may cover it: it would be decoded as a blank
        chars = np.where(raw == 0x20, np.uint32(_BLANK), raw)
        first = np.zeros(len(raw), bool)  # a word begins at a blank after another character
        first[1:] = (raw[1:] == 0x20) & (raw[:-1] != 0x20)
        offsets = np.cumsum(size) - size
        first[offsets[size > 0]] = True
        begin = np.flatnonzero(first)
        length = np.diff(np.append(begin, len(raw)))
        text = np.searchsorted(offsets + size, begin, "right")

        # distinct words, told apart by a 64-bit hash of their characters and own blanks
        coded = mix64((chars.astype(U64) << U64(1)) | own)
        place = np.arange(len(raw)) - np.repeat(begin, length)
        names = mix64(np.add.reduceat(mix64(coded + place.astype(U64) * U64(0x9E3779B97F4A7C15)), begin) + length.astype(U64))
        _, where, word = np.unique(names, return_index=True, return_inverse=True)
        lattice = _Lattice(self, chars, own, begin[where], length[where])

        # all occurrences draw at once, from their ends
        number = np.arange(len(begin)) - np.searchsorted(text, text)
        state = mix64(mix64(keys[text].astype(np.int64).view(U64) ^ mix64(np.array([seed], U64))) + number.astype(U64))
        node = lattice.end[word]
        floor = lattice.end[word] - length
        active, drawn = np.arange(len(begin)), []
        step = 0
        while len(active):
            u = (mix64(state[active] + U64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64) / (1 << 53)
            edge = lattice.draw(node[active], u)
            drawn.append((active, edge))
            node[active] = lattice.source[edge]
            active = active[node[active] > floor[active]]
            step += 1
        who, edge = np.concatenate([x[0] for x in drawn]), np.concatenate([x[1] for x in drawn])
        order = np.lexsort((-np.repeat(np.arange(len(drawn)), [len(x[0]) for x in drawn]), who))
        edge, who = edge[order], who[order]
        ids = lattice.piece[edge]
        # a character without piece becomes its bytes
        if (bare := ids < 0).any():
            lead, count = ids.astype(np.int64), np.ones(len(ids), np.int64)
            code = np.where(bare, -lead - 1, 0)
            count[bare] = 1 + (code[bare] > 0x7F) + (code[bare] > 0x7FF) + (code[bare] > 0xFFFF)
            out = np.repeat(ids, count)
            raw_bytes = np.frombuffer("".join(map(chr, code[bare])).encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(bare, count)] = self.byte_id[raw_bytes]
            return out, np.bincount(text[who], count, len(texts)).astype(np.int64)
        return ids, np.bincount(text[who], minlength=len(texts))

    # --- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.flat[ranges(self.begin[ids], size)].tobytes()


class _Lattice:
    """The lattices of some words: nodes are positions in words, edges lead from ``source`` to a later node and carry a
    ``piece`` (or -1 - character, where there is none).  Edges lie in the order of the node they end at."""

    def __init__(self, vocabulary: Pieces, chars: np.ndarray, own: np.ndarray, begin: np.ndarray, length: np.ndarray):
        chars, own = chars[ranges(begin, length)], own[ranges(begin, length)]
        n = len(chars)
        self.end = np.cumsum(length) + np.arange(len(length))  # each word has a node before its first character
        node = np.arange(n) + np.repeat(np.arange(len(length)), length)  # the node before each character
        left = np.repeat(np.cumsum(length), length) - np.arange(n)
        sources, targets, pieces, weights = [], [], [], []
        h, at, single = np.zeros(n, U64), np.arange(n), np.zeros(n, bool)
        for k in range(vocabulary.longest):
            more = (left[at] > k) & ~own[np.minimum(at + k, n - 1)]
            at, h = at[more], h[more]
            if not len(at):
                break
            h = _step(h, chars[at + k])
            more = vocabulary.begins[(h >> U64(44)).view(np.int64)]
            at, h = at[more], h[more]
            place = vocabulary.slot[(h >> U64(42)).view(np.int64)]
            some = np.flatnonzero(place)
            place, code = place[some] - 1, h[some]
            if (crowded := place < -1).any():
                place[crowded] = np.minimum(np.searchsorted(vocabulary.hashes, code[crowded]), len(vocabulary.hashes) - 1)
            same = vocabulary.hashes[place] == code
            ids, found = vocabulary.ids[place[same]], at[some[same]]
            sources.append(node[found])
            targets.append(node[found] + k + 1)
            pieces.append(ids)
            weights.append(vocabulary.weight[ids])
            if not k:
                single[found] = True
        bare = np.flatnonzero(~single)
        code = np.where((chars[bare] == _BLANK) & ~own[bare], 0x20, chars[bare]).astype(np.int64)
        sources.append(node[bare])
        targets.append(node[bare] + 1)
        pieces.append((-code - 1).astype(np.int32))
        weights.append(vocabulary.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))
        # longer pieces first, as they are likelier and draws look at the edges of a node in turn
        target = np.concatenate(targets[::-1])
        order = np.argsort(target, kind="stable")
        self.source, self.target = np.concatenate(sources[::-1])[order], target[order]
        self.piece, weight = np.concatenate(pieces[::-1])[order], np.concatenate(weights[::-1])[order]
        nodes = n + len(length)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=nodes))])
        # forward filtering: the same position of all words at a time
        position = np.zeros(nodes, np.int64)
        position[node + 1] = np.arange(n) - np.repeat(np.cumsum(length) - length, length) + 1
        by_position = np.argsort(position, kind="stable")
        bounds = np.searchsorted(position[by_position], np.arange(int(length.max(initial=0)) + 2))
        alpha = np.zeros(nodes)
        share = np.zeros(len(self.source))
        for p in range(1, len(bounds) - 1):
            here = by_position[bounds[p] : bounds[p + 1]]
            count = self.first[here + 1] - self.first[here]
            edges = ranges(self.first[here], count)
            value = alpha[self.source[edges]] + weight[edges]
            starts = np.cumsum(count) - count
            most = np.maximum.reduceat(value, starts)
            x = np.exp(value - np.repeat(most, count))
            total = np.add.reduceat(x, starts)
            alpha[here] = most + np.log(total)
            share[edges] = x / np.repeat(total, count)
        # for each edge, the shares of its node's edges up to it
        sums = np.cumsum(share)
        self.upto = sums - np.concatenate([[0.0], sums])[self.first[self.target]]

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        edge, last = self.first[node], self.first[node + 1] - 1
        later = np.flatnonzero((self.upto[edge] <= u) & (edge < last))
        while len(later):
            edge[later] += 1
            later = later[(self.upto[edge[later]] <= u[later]) & (edge[later] < last[later])]
        return edge


def _batched(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, *, key: str = "doc_id", text: str = "text", into: str = "piece_ids", also: tuple[str, ...] = (), model_file: str = TOKENIZER, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``key``, the columns ``also`` and a sampled segmentation of ``text`` as ids, ``into`` (array of int)."""
    names = ["key", "seed", "text", *[f"also{i}" for i in range(len(also))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(model_file, alpha)
        for batch in batches:
            for i, j in _batched(texts := [x or "" for x in batch.column("text").to_pylist()]):
                part = batch.slice(i, j - i)
                ids, count = vocabulary.sample(texts[i:j], part.column("seed").to_numpy(), seed)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()), mask=part.column("text").is_null())
                yield pa.RecordBatch.from_arrays([part.column("key"), *(part.column(x) for x in names[3:]), lists], names=["key", *names[3:], "ids"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("seed"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(also, names[3:])])
    fields = [f"key {docs.schema[key].dataType.simpleString()}", *[f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(also, names[3:])], "ids array<int>"]
    return rows.mapInArrow(run, ", ".join(fields)).select(F.col("key").alias(key), *[F.col(n).alias(c) for c, n in zip(also, names[3:])], F.col("ids").alias(into))


def decode(rows: DataFrame, *, key: str = "doc_id", ids: str = "piece_ids", into: str = "text", model_file: str = TOKENIZER) -> DataFrame:
    """``key`` and the text of some ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(model_file)
        for batch in batches:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=["key", "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").select(F.col("key").alias(key), F.col("text").alias(into))


def round_trip(docs: DataFrame, *, key: str = "doc_id", text: str = "text", model_file: str = TOKENIZER, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """What :func:`encode` and :func:`decode` make of each row, with digests: ``n_pieces``, ``pieces_sha256`` (of the ids as
    little-endian 32-bit integers), ``decoded_sha256``, whether the decoding equals the text, the ids ``piece_ids`` and the
    decoding ``decoded``.  All null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Pieces(model_file, alpha)
        for batch in batches:
            raw = batch.column("text").to_pylist()
            for i, j in _batched(texts := [x or "" for x in raw]):
                part = batch.slice(i, j - i)
                n, coded, decoded, same, back = ([] for _ in range(5))
                ids, count = vocabulary.sample(texts[i:j], part.column("seed").to_numpy(), seed)
                plain, ends = vocabulary.decode(ids), np.cumsum(count)
                byte_ends = np.concatenate([[0], np.cumsum(vocabulary.size[ids])])[ends]
                a = x = 0
                for k, (b, y) in enumerate(zip(ends.tolist(), byte_ends.tolist())):
                    null = raw[i + k] is None
                    n.append(None if null else b - a)
                    coded.append(None if null else hashlib.sha256(ids[a:b].astype("<i4").tobytes()).hexdigest())
                    decoded.append(None if null else hashlib.sha256(plain[x:y]).hexdigest())
                    same.append(None if null else plain[x:y] == texts[i + k].encode("utf-8", "surrogatepass"))
                    back.append(None if null else plain[x:y].decode("utf-8", "replace"))
                    a, x = b, y
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()), mask=part.column("text").is_null())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_()), lists, pa.array(back, pa.string())], names=["key", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless", "piece_ids", "decoded"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("seed"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean, piece_ids array<int>, decoded string").withColumnRenamed("key", key)
