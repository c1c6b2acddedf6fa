"""Suffix-array dedup over a run-compressed index: bytes covered by a 50-byte string of an earlier document.

1. Documents are packed, a few MB at a time, into chunks in the shared folder, each sorted by doc_id.
2. Every window of ``LENGTH`` bytes has an anchor: the least hash of the ``GRAM``-byte strings in it. Equal windows have
   equal anchors at equal places, and reach ``SIDE`` bytes or more beyond the anchor on its left or on its right. So each
   anchor has two contexts, the anchor with ``SIDE`` bytes before it and with as many after it, and windows whose context
   occurs in one document only cannot match another and are left out. Short strings that recur by chance, ever more of
   them in a larger input, are thus told from repeated text before anything is sent or indexed. Chunks send their distinct
   contexts, packed by range of their anchor, and get back those that some other document has too.
3. Runs of successive windows that are left, with one anchor, are sent as one string of at most ``PIECE`` bytes, each distinct one
   once a chunk with the least doc_id that the chunk has for it, to the block of its anchor, so all equal windows meet in
   one block. Later documents of the chunk that hold the string are covered by that first one, which the chunk knows by
   itself; a passage that a third of all documents share thus sends one string a chunk. An anchor with more than ``HOT``
   different strings, beyond one a chunk, stands at the edge of a passage that very many documents share; it is dealt
   window by window over all blocks instead, where equal windows still meet.
4. In a block, an anchor with one string needs no index: its windows occur nowhere else. The strings of all other anchors
   are indexed: they are suffix-sorted, the Burrows-Wheeler transform is cut into runs, and the suffix array is sampled
   at run ends. A suffix within a run has its predecessor's match shortened by one (both extend to the left by the same
   byte), so match lengths are compared only at run heads and streamed in text order from there. Neighbours in suffix
   order that match for 50 bytes or more hold the same window; the smallest doc_id of such an interval decides.
5. Covered ranges return to their chunks, which cut them out.

No step holds more than a chunk or a block; the numbers of blocks, anchor ranges and buckets grow with the input.

Defined cases: a null or empty text, or one under 50 bytes, loses nothing; repeats within a document or among rows with
the same doc_id do not count; a null doc_id counts as larger than any other and never as smaller; an empty table gives
an empty result; other columns pass through ``drop_repeats`` and are ignored by ``measure``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_table, shuffle_partitions, small_batches, text_buffers, tidy

LENGTH, GRAM, PIECE = 50, 18, 80
#: Bytes beside an anchor that every window has on one side of it at least.
SIDE = (LENGTH - GRAM) // 2
CHUNK_BYTES = 3_000_000
#: Bytes of a chunk whose anchors are sought at once; a longer document is one stretch. Its arrays stay in a core's cache.
STRETCH_BYTES = 100_000
#: Text a block stands for, and the parts in which a block is indexed one after the other.
BLOCK_BYTES = 32_000_000
#: Input that a bucket of chunks stands for, and as many buckets as Spark allows by default.
BUCKET_BYTES, MOST_BUCKETS = 256_000_000, 100_000
PARTS = 10
HOT = 4096
#: Bytes that the first sort of suffixes looks at; the next ones double that.
FIRST = 5
_LAST = np.iinfo(np.int64).max
#: Bits of an anchor beyond those that number the bytes of the input: chance matches stay few at any size.
SPARE_BITS = 14
_MIX = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


# packing


def _squeeze(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _open(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, in 32 bits where they fit."""
    gaps = np.diff(values, prepend=values[:1] * 0)
    if len(gaps) and gaps.max() >= 1 << 32:
        return b"\x08" + gaps.astype("<u8").tobytes()
    return b"\x04" + gaps.astype("<u4").tobytes()


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<u8" if blob[0] == 8 else "<u4", offset=1).astype(np.uint64), dtype=np.uint64)


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that one payload is held at once."""
    for i in range(len(batch)):
        yield batch.slice(i, 1).to_pylist()[0]


# chunks


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """(bid, payload): documents packed as compressed Arrow streams, sorted by doc_id.

    They are written once, as a table bucketed by bid in the shared warehouse, so that later joins by bid move only what
    is joined to them; ``common.sweep`` drops it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        held, size, made = [], 0, 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().sort_by("doc_id")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(table)
            return _batch(["bid", "payload"], [pa.int64(), pa.binary()], [(first + made, sink.getvalue().to_pybytes())])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, n in enumerate(lengths.tolist()):
                size += n + 64
                if size >= CHUNK_BYTES:
                    held.append(batch.slice(at, i + 1 - at))
                    yield flush()
                    held, size, made, at = [], 0, made + 1, i + 1
            if at < len(lengths):
                held.append(batch.slice(at))
        if held:
            yield flush()

    spark = docs.sparkSession
    name = fresh_table(spark, "chunks")
    buckets = max(shuffle_partitions(spark), min(MOST_BUCKETS, size // BUCKET_BYTES))
    packed = docs.mapInArrow(tidy(run), "bid long, payload binary")
    packed.write.bucketBy(buckets, "bid").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _load(payload: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a chunk, their doc_ids (null: the largest), bytes and bounds."""
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    ids = pc.fill_null(table.column("doc_id").cast(pa.int64()), _LAST).to_numpy()
    data, bounds = text_buffers(table.column("text"))
    return table, ids, data, bounds


# anchors


def anchor_runs(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, document, mark) of each run of successive windows of one document with one anchor, and
    (run, place, left, right) of each place where a run has its anchor, by run.

    mark: 24 bits that tell different strings of one anchor apart, nearly always; used for counting only. left, right:
    64-bit hashes of the anchor with ``SIDE`` bytes before or after it; without meaning where no window of the run holds
    them. Runs end with their document, so documents are taken a stretch at a time: some thirty words of 8 bytes are held
    per byte of it.
    """
    found, a, runs = [], 0, 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + STRETCH_BYTES, side="right")) - 1)
        start, windows, anchor, doc, mark, run, place, left, right = _stretch_runs(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], bits)
        found.append((start + bounds[a], windows, anchor, doc + a, mark, run + runs, place + bounds[a], left, right))
        a, runs = b, runs + len(start)
    return tuple(map(np.concatenate, zip(*found))) if found else _stretch_runs(data, bounds, bits)


def _stretch_runs(data: np.ndarray, bounds: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """``anchor_runs`` of a few documents."""
    none, word = np.empty(0, np.int64), np.empty(0, np.uint64)
    nothing = none, none, word, none, word, none, none, word, word
    n = len(data) - LENGTH + 1
    if n <= 0:
        return nothing
    with np.errstate(over="ignore"):
        power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
        h = _MIX[data]
        two = h[:-1] * power(1) + h[1:]
        h = two
        for k in (2, 4, 8):
            h = h[:-k] * power(k) + h[k:]
        side = h
        gram = h[: len(h) - 2] * power(2) + two[16:]
        h = np.maximum(_mixed(gram) >> np.uint64(64 - bits), np.uint64(1))  # 0 is less than any
    m, width = h, 1
    while width < 32:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[:n], h[32 : 32 + n])
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    valid = np.arange(n) + LENGTH <= bounds[1:][doc[:n]]
    start = valid.copy()
    start[1:] &= (m[1:] != m[:-1]) | (doc[1:n] != doc[: n - 1]) | ~valid[:-1]
    starts = np.flatnonzero(start)
    if not len(starts):
        return nothing
    # a run ends where the next one starts or its document has no further window
    ends = np.minimum(np.append(starts[1:], n), bounds[1:][doc[starts]] - LENGTH + 1)
    with np.errstate(over="ignore"):
        mark = (h[starts] * np.uint64(_BASE) + h[ends - 1 + LENGTH - GRAM]) * np.uint64(_BASE) + (ends - starts).astype(np.uint64)
        mark = (mark * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    # an anchor stands where the largest least hash of the windows around is the place's own
    most = np.zeros(n + 64, np.uint64)
    most[32 : 32 + n] = m * valid
    width = 1
    while width < 32:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    most = np.maximum(most[: n + 32], most[1 : n + 33])
    place = np.flatnonzero(most == h)
    # runs and their anchors follow each other in the same order; places of one run are neighbours
    fresh = np.append(True, (h[place[1:]] != h[place[:-1]]) | (doc[place[1:]] != doc[place[:-1]]))
    with np.errstate(over="ignore"):
        left = _mixed(side[np.maximum(place - SIDE, 0)] * power(GRAM) + gram[place])
        right = _mixed(gram[place] * power(SIDE) + side[np.minimum(place + GRAM, len(side) - 1)] + np.uint64(1))
    return starts, ends - starts, m[starts], doc[starts], mark, np.cumsum(fresh) - 1, place, left, right


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _context_bits(ranges: int, bits: int) -> int:
    """Bits of a context below those that number its range: as few contexts share a value as anchors do."""
    return min(max(16, bits - ranges.bit_length() + 1), 63 - ranges.bit_length())


def contexts(found: tuple[np.ndarray, ...], ranges: int, bits: int) -> tuple[np.ndarray, ...]:
    """(key, run, from, to) of each context of the runs that ``anchor_runs`` found: windows of the run from one to before
    the other hold it. The range of the anchor stands above ``_context_bits`` in the key.

    A run with its anchor at several places may hold windows with several of them. It has the contexts of each place, and
    one of the anchor alone, and each stands for the whole run.
    """
    start, windows, anchor, _, _, run, place, left, right = found
    several = np.bincount(run, minlength=len(start)) > 1
    end, below = start + windows, np.uint64(_context_bits(ranges, bits))
    has_left, has_right = start[run] <= place - SIDE, end[run] > place - SIDE
    with np.errstate(over="ignore"):
        alone = np.flatnonzero(several)
        which = np.concatenate([run[has_left], run[has_right], alone])
        key = np.concatenate([left[has_left], right[has_right], _mixed(anchor[alone] * np.uint64(_BASE))]) >> (np.uint64(64) - below)
    first = np.concatenate([start[run[has_left]], np.maximum(start[run], place - SIDE)[has_right], start[alone]])
    last = np.concatenate([np.minimum(end[run], place - SIDE + 1)[has_left], end[run[has_right]], end[alone]])
    whole = several[which]
    first[whole], last[whole] = start[which[whole]], end[which[whole]]
    return (anchor[which] % np.uint64(ranges)) << below | key, which, first, last


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once; for whole numbers a plain sort is faster than ``np.unique``."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def _dealt(place: np.ndarray, ranges: int) -> list[tuple[int, np.ndarray]]:
    """Each number below ``ranges`` in ``place``, and where it stands, in order: by one sort, however many ranges there are."""
    place = place.astype(np.uint16 if ranges <= 1 << 16 else np.int64)  # 16 bits are sorted by counting
    order = np.argsort(place, kind="stable")
    place = place[order]
    edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)] if len(place) else [0]
    return [(int(place[a]), order[a:b]) for a, b in zip(edges, edges[1:])]


def _context_lists(ranges: int, bits: int) -> Callable:
    """Chunk -> its distinct contexts by range, a flag for those that two of its documents have, and anchors with further strings."""
    below = _context_bits(ranges, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, _, data, bounds = _load(row["payload"])
                found = anchor_runs(data, bounds, bits)
                _, _, anchor, doc, mark, *_ = found
                if not len(anchor):
                    continue
                kinds = _distinct(anchor << np.uint64(24) | mark) >> np.uint64(24)  # by the low 40 bits
                kinds, more = np.unique(kinds[1:][kinds[1:] == kinds[:-1]], return_counts=True)
                anchor = _distinct(anchor)
                low = anchor & np.uint64((1 << 40) - 1)
                at = np.searchsorted(kinds, low)
                own = np.flatnonzero(np.append(kinds, np.uint64(1 << 63))[at] == low)
                anchor, more = anchor[own], np.minimum(more[at[own]], 65535)
                further = dict(_dealt(anchor % np.uint64(ranges), ranges))
                key, which, _, _ = contexts(found, ranges, bits)
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[which[order]]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
                key = key[first]
                place = key >> np.uint64(below)
                key &= np.uint64((1 << below) - 1)
                edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
                rows, none = [], np.empty(0, np.int64)
                for a, b in zip(edges, edges[1:]):
                    own = further.get(p := int(place[a]), none)
                    rows.append((p, row["bid"], _squeeze(
                        _pack_sorted(key[a:b]), np.packbits(several[a:b]), _pack_sorted(anchor[own] // np.uint64(ranges)), more[own].astype("<u2"),
                    )))
                yield _batch(["p", "bid", "contexts"], [pa.int32(), pa.int64(), pa.binary()], rows)

    return run


def _repeated(ranges: int) -> Callable:
    """Contexts of one range from all chunks -> for each chunk, those that another document has, and the hot anchors of the range."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        bids = table.column("bid").to_pylist()
        lists, flags, anchors, extra = [], [], [], []
        for blob in table.column("contexts"):
            packed, bits, further, more = _open(blob.as_py())
            lists.append(_unpack_sorted(packed))
            flags.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(lists[-1])).astype(bool))
            anchors.append(_unpack_sorted(further))
            extra.append(np.frombuffer(more, "<u2"))
        hot, which = np.unique(np.concatenate(anchors), return_inverse=True)
        hot = hot[np.bincount(which, np.concatenate(extra), len(hot)) > HOT] * np.uint64(ranges) + np.uint64(p)
        every = np.concatenate(lists)
        order = np.argsort(every)
        first = np.append(True, every[order[1:]] != every[order[:-1]])
        keep = np.concatenate(flags)
        keep[order] |= ~(first & np.append(first[1:], True))
        rows, ends = [], np.cumsum([len(x) for x in lists]).tolist()
        for bid, own, a, b in zip(bids, lists, [0, *ends[:-1]], ends):
            if keep[a:b].any():
                rows.append((bid, _squeeze(np.array([p], "<u4"), _pack_sorted(own[keep[a:b]]), hot.astype("<u8"))))
        return pa.Table.from_batches([_batch(["bid", "found"], [pa.int64(), pa.binary()], rows)])

    return run


def _left(found: tuple[np.ndarray, ...], keys: np.ndarray, ranges: int, bits: int) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, document) of what is left of the runs: their windows with a context among the sorted ``keys``."""
    start, windows, anchor, doc, *_ = found
    key, which, first, last = contexts(found, ranges, bits)
    order = np.argsort(key)  # sought in order, which is faster
    at = np.minimum(np.searchsorted(keys, key[order]), len(keys) - 1)
    hit = order[keys[at] == key[order]]
    a, b = start + windows, start.copy()
    np.minimum.at(a, which[hit], first[hit])
    np.maximum.at(b, which[hit], last[hit])
    keep = np.flatnonzero(a < b)
    return a[keep], (b - a)[keep], anchor[keep], doc[keep]


# strings


def _strings(blocks: int, bits: int) -> Callable:
    """Chunk and its repeated contexts -> distinct strings by block, with doc_ids and places of their occurrences."""
    below = np.uint64(_context_bits(blocks, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                _, ids, data, bounds = _load(row["payload"])
                opened = sorted((int(np.frombuffer(p, "<u4")[0]), keys, hot) for p, keys, hot in map(_open, row["found"]))
                keys = np.concatenate([np.uint64(p) << below | _unpack_sorted(k) for p, k, _ in opened])
                often = np.frombuffer(b"".join(h for _, _, h in opened), "<u8")
                start, count, anchor, doc = _left(anchor_runs(data, bounds, bits), keys, blocks, bits)
                hot = np.isin(anchor, often)
                step = np.where(hot, 1, PIECE - LENGTH + 1)
                pieces = -(-count // step)
                which = np.repeat(np.arange(len(start)), pieces)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = start[which] + turn * step[which]
                size = np.minimum(step[which], count[which] - turn * step[which]) + LENGTH - 1
                raw, known = data.tobytes(), {}
                strings = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist())]
                number = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
                distinct = list(known)
                first = np.full(len(distinct), -1)
                first[number[::-1]] = np.arange(len(number))[::-1]
                owner = ids[doc[which]]
                least = owner[first]  # documents are sorted, so the first occurrence has the least doc_id
                later = owner > least[number]
                key = anchor[which[first]]
                for s in np.flatnonzero(hot[which[first]]).tolist():
                    key[s] = int.from_bytes(hashlib.blake2b(distinct[s], digest_size=8).digest(), "little")
                cell = (key % np.uint64(blocks * PARTS)).astype(np.int64)
                block = cell % blocks
                order = np.argsort(block, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                takes = np.flatnonzero(~later)
                takes = takes[np.argsort(place[number[takes]], kind="stable")]
                times = np.bincount(place[number[takes]], minlength=len(distinct))
                ends = np.concatenate(([0], np.cumsum(times)))
                edges = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
                at, length = _merged(begin[later], size[later])
                rows = [(row["bid"] % blocks, row["bid"], None, _squeeze(at.astype("<u4"), length.astype("<u4")))] if len(at) else []
                for a, b in zip(edges, edges[1:]):
                    own, use = order[a:b], takes[ends[a] : ends[b]]
                    rows.append((int(block[own[0]]), row["bid"], _squeeze(
                        size[first[own]].astype("<u1"), b"".join([distinct[s] for s in own.tolist()]), times[a:b].astype("<u4"),
                        begin[use].astype("<u4"), least[own].astype("<i8"), (cell[own] // blocks).astype("<u1"), key[own].astype("<u8"),
                    ), None))
                yield _batch(["q", "bid", "strings", "covered"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], rows)

    return run


# index


def _order(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of keys of so many bits; where key and place fit one word, that word is sorted, which is faster."""
    n = len(keys)
    room = max(1, (n - 1).bit_length())
    if bits + room > 63:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.int64) << room) | np.arange(n)
    packed.sort()
    return packed & ((1 << room) - 1)


def _dense(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of keys in sorted order, equal for equal keys."""
    ordered = keys[order]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]), dtype=np.int32)
    return rank


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of strings, each with an end mark, and what streams from it.

    ``heads`` are the places in suffix order where a run of equal preceding bytes starts; ``samples`` are the suffix
    array's values at the first and last place of each run; ``match`` is, for each text position, the length of its match
    with the suffix before it in suffix order.
    """

    def __init__(self, strings: list[bytes]) -> None:
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begin = np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        # UTF-8 never holds byte 255, so bytes move up by one and 0 is the end mark
        self.text = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
        self.left = (np.repeat(self.begin + size, size + 1) - np.arange(n)).astype(np.int32)
        padded = np.concatenate([self.text, np.zeros(PIECE + 8, np.uint8)])
        key = np.zeros(n, np.int64)
        for t in range(FIRST):
            key = (key << 8) | np.where(t < self.left, padded[t : t + n], 0)
        ranks, reach = [_dense(_order(key, 8 * FIRST), key)], FIRST
        while reach < PIECE:
            width = int(ranks[-1].max()).bit_length()
            last = np.concatenate([ranks[-1], np.zeros(reach, np.int32)])
            key = (last[:n].astype(np.int64) << width) | np.where(self.left > reach, last[reach : reach + n], 0)
            order = _order(key, 2 * width)
            ranks.append(_dense(order, key))
            reach *= 2
        self.suffixes = order
        before = np.concatenate(([0], self.text))[order]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.heads = np.flatnonzero(head)
        self.samples = order[self.heads], order[np.append(self.heads[1:], n) - 1]
        self.match = self._stream(ranks, padded)

    def _stream(self, ranks: list[np.ndarray], padded: np.ndarray) -> np.ndarray:
        """Match lengths at run heads, from the samples on both sides, then down along the text."""
        here, other = self.samples[0].copy(), np.concatenate((self.samples[0][:1], self.samples[1][:-1]))
        length, reach = np.zeros(len(here), np.int64), FIRST << (len(ranks) - 1)
        for rank in ranks[::-1]:
            same = (rank[here] == rank[other]) & (self.left[here] >= reach) & (self.left[other] >= reach)
            same[0] = False
            here, other, length = here + reach * same, other + reach * same, length + reach * same
            reach //= 2
        go = np.arange(1, len(here))
        for _ in range(FIRST):
            go = go[(padded[here[go]] == padded[other[go]]) & (padded[here[go]] != 0)]
            here[go] += 1
            other[go] += 1
            length[go] += 1
        n = len(self.text)
        value, from_head = np.zeros(n, np.int64), np.zeros(n, np.int64)
        value[self.samples[0]] = length
        from_head[self.samples[0]] = self.samples[0]
        from_head = np.maximum.accumulate(from_head)
        return value[from_head] - (np.arange(n) - from_head)

    def least(self, owner: np.ndarray) -> np.ndarray:
        """For each text position, the least owner of the strings that hold its window; owner: by string."""
        string = np.repeat(np.arange(len(self.begin)), np.diff(np.append(self.begin, len(self.text))))
        starts = np.flatnonzero(self.match[self.suffixes] < LENGTH)
        if not len(starts) or starts[0]:
            starts = np.append(0, starts)
        found = np.minimum.reduceat(owner[string[self.suffixes]], starts)
        out = np.empty(len(self.text), np.int64)
        out[self.suffixes] = np.repeat(found, np.diff(np.append(starts, len(self.text))))
        return out


def _merged(at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges, sorted by where they start, with those that overlap or touch made one."""
    if not len(at):
        return at, size
    end = np.maximum.accumulate(at + size)
    head = np.flatnonzero(np.append(True, at[1:] > end[:-1]))
    return at[head], end[np.append(head[1:], len(at)) - 1] - at[head]


def _covered(table: pa.Table) -> pa.Table:
    """All strings of a block -> per chunk, where ranges of covered bytes start, and how long they are."""
    sent, ready = table.filter(table.column("strings").is_valid()), table.filter(table.column("covered").is_valid())
    known, parts, keys, numbers, places, owners, times = {}, [], [], [], [], [], []
    for blob in sent.column("strings"):
        size, text, count, begin, ids, part, key = _open(blob.as_py())
        ends = np.cumsum(np.frombuffer(size, "<u1").astype(np.int64)).tolist()
        own = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        before = len(known)
        number = np.fromiter((known.setdefault(s, len(known)) for s in own), np.int64, len(own))
        fresh = np.flatnonzero(number >= before)  # strings of one chunk differ, so these come in order
        parts.append(np.frombuffer(part, "<u1")[fresh])
        keys.append(np.frombuffer(key, "<u8")[fresh])
        numbers.append(number)
        times.append(np.frombuffer(count, "<u4"))
        places.append(np.frombuffer(begin, "<u4"))
        owners.append(np.frombuffer(ids, "<i8"))
    rows = [(r["bid"], r["covered"]) for r in ready.select(["bid", "covered"]).to_pylist()]
    if known:
        rows += _decide(sent.column("bid").to_pylist(), list(known), np.concatenate(parts), np.concatenate(keys), numbers, times, places, owners)
    return pa.Table.from_batches([_batch(["bid", "covered"], [pa.int64(), pa.binary()], rows)])


def _decide(
    bids: list[int], strings: list[bytes], part: np.ndarray, key: np.ndarray,
    numbers: list[np.ndarray], times: list[np.ndarray], places: list[np.ndarray], owners: list[np.ndarray],
) -> list[tuple]:
    """The covered ranges of each chunk, given its strings by number, how often and where they occur, and their owners."""
    owner = np.full(len(strings), _LAST)
    for number, ids in zip(numbers, owners):
        owner[number] = np.minimum(owner[number], ids)
    windows = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    offset = np.cumsum(windows) - windows
    least = np.repeat(owner, windows)
    _, which, alike = np.unique(key, return_inverse=True, return_counts=True)
    several = alike[which] > 1
    for p in np.unique(part[several]).tolist():
        own = np.flatnonzero((part == p) & several)
        index = RunIndex([strings[s] for s in own.tolist()])
        found, n = index.least(owner[own]), windows[own]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        least[np.repeat(offset[own], n) + turn] = found[np.repeat(index.begin, n) + turn]
    rows = []
    for bid, number, count, begin, ids in zip(bids, numbers, times, places, owners):
        n = windows[number]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hit = least[np.repeat(offset[number], n) + turn] < np.repeat(ids, n)
        if not hit.any():
            continue
        string = np.repeat(np.arange(len(number)), n)
        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        inner = np.flatnonzero((turn == 0) & hit & np.concatenate(([False], hit[:-1])))
        first = np.union1d(np.flatnonzero(edge[:-1] == 1), inner)
        last = np.union1d(np.flatnonzero(edge[1:] == -1), inner - 1)
        # each range stands at every place of its string
        many = count[string[first]].astype(np.int64)
        which = np.repeat(np.arange(len(first)), many)
        start = (np.cumsum(count, dtype=np.int64) - count)[string[first]]
        place = begin[np.repeat(start - np.cumsum(many) + many, many) + np.arange(len(which))]
        at, size = place + turn[first][which], (turn[last] - turn[first] + LENGTH)[which]
        order = np.argsort(at)
        at, size = _merged(at[order], size[order])
        rows.append((bid, _squeeze(at.astype("<u4"), size.astype("<u4"))))
    return rows


def covered(docs: DataFrame) -> DataFrame:
    """(payload, covered): every chunk of ``docs`` with the packed ranges of its covered bytes."""
    spark = small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    packed = chunks(docs, size)
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    bits = min(64, SPARE_BITS + int(size).bit_length())
    lists = packed.mapInArrow(tidy(_context_lists(blocks, bits)), "p int, bid long, contexts binary")
    found = lists.groupBy("p").applyInArrow(tidy(_repeated(blocks)), "bid long, found binary")
    found = cut(found.groupBy("bid").agg(F.collect_list("found").alias("found")))
    strings = packed.join(found, "bid").select("bid", "payload", "found")
    strings = strings.mapInArrow(tidy(_strings(blocks, bits)), "q int, bid long, strings binary, covered binary")
    ranges = strings.groupBy("q").applyInArrow(tidy(_covered), "bid long, covered binary")
    ranges = cut(ranges.groupBy("bid").agg(F.collect_list("covered").alias("covered")))
    return packed.join(ranges, "bid", "left").select("payload", "covered")


def _kept(row: dict) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a chunk, bytes, bounds, and which bytes stay."""
    table, _, data, bounds = _load(row["payload"])
    cover = np.zeros(len(data) + 1, np.int32)
    for blob in row["covered"] or []:
        at, size = (np.frombuffer(x, "<u4").astype(np.int64) for x in _open(blob))
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
    return table, data, bounds, np.cumsum(cover[:-1]) == 0


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            for row in _rows(batch):
                table, data, bounds, stay = _kept(row)
                out = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = stay[a:b]
                    spans = int((~own[:1]).sum() + (own[:-1] & ~own[1:]).sum())
                    out.append((b - a, int((~own).sum()), spans, hashlib.sha256(data[a:b][own].tobytes()).hexdigest()))
                made = _batch(names, [pa.int64(), pa.int64(), pa.int64(), pa.string()], out)
                ids = table.column("doc_id").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, *made.columns], ["doc_id", *names])

    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return covered(base).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with covered bytes cut from text; a character that loses a byte goes whole. No row is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                table, data, bounds, stay = _kept(row)
                texts = [
                    data[a:b][stay[a:b]].tobytes().decode("utf-8", "ignore")
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())
                ]
                old = table.column("text")
                fresh = pa.array([t if ok else None for t, ok in zip(texts, old.is_valid().to_pylist())], pa.string())
                table = table.set_column(table.schema.get_field_index("text"), "text", fresh)
                yield from table.combine_chunks().to_batches()

    return covered(docs).mapInArrow(tidy(run), docs.schema)
