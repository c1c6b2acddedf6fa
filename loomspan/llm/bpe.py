"""Byte-level BPE by a segment tree over byte positions.

Leaf i of the tree holds the rank of the pair that starts at byte i (the part that starts there, joined with its right
neighbour), packed with i, so the root is the leftmost pair of minimum rank. A merge changes three leaves - the merged
pair, its left neighbour's pair and the dead right part - and each change walks up the tree, so a text of n bytes takes
O(n log n) even without any break.

Pieces of one batch are encoded side by side: trees of equal width are rows of one NumPy array, and one round merges the
best pair of every row. Long single pieces use the same tree over Python lists. Pieces repeat heavily, so each worker
keeps the encoded pieces it met, up to a bounded number of entries.

Defined cases: a null or empty text has no tokens; special tokens are never produced; any bytes decode to themselves;
repeated rows and null ids keep their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: Entries of a worker's memory of pieces, and the longest piece that is kept there.
MEMORY = 200_000
LONGEST_KEPT = 64
#: From this width, or below this many pieces of a width, a piece gets a tree of its own.
WIDE = 4096
FEW = 4
_NONE = np.int64(1) << 62
_POS = 32


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file, read by the driver; its size is that of one vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Ranks as look-up tables, and the memory of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY) -> None:
        self.ranks, self.memory, self.known, self.pieces_known = ranks, memory, {}, {}
        self.find = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.first = np.full(256, -1, np.int64)
        for b in range(256):
            self.first[b] = ranks[bytes([b])]
        # every way to split a token in two tokens, as left * 2^32 + right: a pair's rank is that of the joined bytes
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        size = 1 << (2 * len(pairs)).bit_length()
        self.mask, self.slots = size - 1, np.full(size, -1, np.int64)
        for i, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.slots[slot] = i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & self.mask

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts, or none; parts below zero are absent."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        key = left << 32 | (right & 0xFFFFFFFF)
        out = np.full(len(key), _NONE)
        todo, slot = np.flatnonzero((left >= 0) & (right >= 0)), None
        slot = self._slot(key[todo])
        while len(todo):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[at] == key[todo])
            out[todo[hit]] = self.values[at[hit]]
            go = (at >= 0) & ~hit
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out

    def _one(self, piece: bytes) -> list[int]:
        """The tree of a single piece."""
        n, width = len(piece), 1 << max(1, (len(piece) - 1).bit_length())
        none, pairs = 1 << 62, self.pairs
        part = [int(self.first[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: none if after[i] >= n or (r := pairs.get(part[i] << 32 | part[after[i]])) is None else r << _POS | i
        tree = [none] * (2 * width)
        tree[width : width + n] = [rank(i) for i in range(n)]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] < none:
            at, merged = tree[1] & 0xFFFFFFFF, tree[1] >> _POS
            gone = after[at]
            part[at], after[at] = merged, after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, none)
            put(at, rank(at))
            if before[at] >= 0:
                put(before[at], rank(before[at]))
        out, at = [], 0
        while at < n:
            out.append(part[at])
            at = after[at]
        return out

    def _many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The trees of many pieces of at most ``width`` bytes, a power of two, merged round by round."""
        g = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, g)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(g, width)
        column = np.arange(width)
        part = np.where(column < size[:, None], self.first[raw], -1)
        after = np.minimum(np.broadcast_to(column + 1, (g, width)), size[:, None]).copy()
        before = np.broadcast_to(column - 1, (g, width)).copy()
        tree = np.full((g, 2 * width), _NONE)
        own = self._rank(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(g, width - 1)
        tree[:, width : 2 * width - 1] = np.where(own < _NONE, own << _POS | column[:-1], _NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            i = leaf + width
            tree[rows, i] = value
            while i[0] > 1:
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        def pair(rows: np.ndarray, leaf: np.ndarray) -> np.ndarray:
            right = after[rows, leaf]
            has = right < size[rows]
            rank = self._rank(part[rows, leaf], np.where(has, part[rows, np.minimum(right, width - 1)], -1))
            return np.where(rank < _NONE, rank << _POS | leaf, _NONE)

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best & 0xFFFFFFFF
            gone = after[rows, at]
            part[rows, at] = best >> _POS
            after[rows, at] = after[rows, gone]
            part[rows, gone] = -1
            follows = after[rows, at] < size[rows]
            before[rows[follows], after[rows, at][follows]] = at[follows]
            put(rows, gone, np.full(len(rows), _NONE))
            put(rows, at, pair(rows, at))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                put(rows[has], left[has], pair(rows[has], left[has]))
            rows = rows[tree[rows, 1] < _NONE]
        live = part >= 0
        flat = part[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out, by_width = {}, {}
        for text in pieces:
            piece = text.encode()
            whole = self.ranks.get(piece)
            if whole is not None:
                out[text] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append((text, piece))
        for width, own in by_width.items():
            if width >= WIDE or len(own) < FEW:
                out.update((t, np.array(self._one(p), "<u4").tobytes()) for t, p in own)
                continue
            step = max(1, (1 << 20) // width)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                out.update(zip((t for t, _ in some), self._many([p for _, p in some], width)))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, packed; texts go through in groups of bounded size."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size > 4_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _chunks(self, text: str) -> list[str]:
        """Parts of ``text`` between which every match of the pattern ends.

        No match holds a space or line break after another character, except in a run of white space. So a text whose
        white space is only single spaces and line breaks falls apart before each of them; any other text is one part.
        """
        if "\0" in text or " ".join(text.split()) != text.replace("\n", " "):
            return [text]
        return text.replace("\n", " \n").replace(" ", "\0 ").replace(" \n", "\n").split("\0")

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        known, pieces_known = self.known, self.pieces_known
        if len(known) > self.memory:
            known.clear()
        if len(pieces_known) > self.memory:
            pieces_known.clear()
        chunks = [self._chunks(t) for t in texts]
        new = {c: self.find(c) for c in set().union(*chunks).difference(known)}
        got = self.encode_pieces(set().union(*new.values()).difference(pieces_known))
        pieces_known.update((p, x) for p, x in got.items() if len(p) <= LONGEST_KEPT)
        extra = {}
        for chunk, own in new.items():
            ids = b"".join([got[p] if p in got else pieces_known[p] for p in own])
            (known if len(chunk) <= LONGEST_KEPT else extra)[chunk] = ids
        for own in chunks:
            yield b"".join([known[c] if c in known else extra[c] for c in own] if extra else map(known.__getitem__, own))

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids: every token's bytes are copied from one table of all tokens' bytes."""
        ids = np.frombuffer(packed, "<u4")
        size = self.token_size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.token_bytes[np.repeat(self.token_start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


_held: list = [None, None]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs``, and ids (packed), n_tokens, decoded (bytes), from the column text.

    Ranks go to the executors as one broadcast variable of vocabulary size.
    """
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast((load_ranks(spark, ranks_path), pattern))
    base = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in base.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for whole in batches:
            for batch in _slices(whole):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = list(encoder.encode_batch(texts))
                out = [batch.column(c) for c in keep]
                out += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                out += [pa.array([encoder.decode(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*keep, "ids", "n_tokens", "decoded"])

    return base.mapInArrow(tidy(run), f"{schema}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text; digests are made beside the encoder."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast((load_ranks(spark, ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = _encoder(shared), hashlib.sha256
        for whole in batches:
            for batch in _slices(whole):
                rows = []
                for ids in encoder.encode_batch([t or "" for t in batch.column("text").to_pylist()]):
                    rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(encoder.decode(ids)).hexdigest()))
                columns = list(zip(*rows)) if rows else [[], [], []]
                out = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *out], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _encoder(shared) -> Encoder:
    """One encoder a worker and broadcast: workers are reused between tasks, and so is its memory."""
    if _held[0] is not shared.value:
        _held[:] = [shared.value, Encoder(*shared.value)]
    return _held[1]


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(1, len(batch)), rows):
        yield batch.slice(at, rows)
