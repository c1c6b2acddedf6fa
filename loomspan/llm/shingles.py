"""Near copies: documents whose sets of five-word shingles have a Jaccard index of 0.8 or more.

Candidates come from two searches. SimHash over the five-word shingles links fingerprints within two bits through the
segment-popcount grid of ``simhash``; it joins large groups of all but equal texts. A Jaccard index of 0.8 is about ten
differing bits, where that grid no longer prunes, so the rest is found by an exact prefix filter: two sets of at least
0.8 share one of the first n - ceil(0.8 n) + 1 shingles of each, in any order that holds for all sets. The order puts
shingles last that are frequent (every task counts all its documents, and those it sees twice are known to be); it
decides how many candidates there are, not which links are found. Documents with equal sets are one node.

Prefixes stay in packs of documents; only their sorted 64-bit values are dealt by range, as differences, and what comes
back is which of them another set has too. Few do, and only those become rows. First each holder of such a shingle is
compared with the holder that shares most, the likely original of a group of copies, which is linear; then holders that
are not yet in one component are compared with each other; shingles that the same sets hold, such as those of one passage,
count as one list there. Set sizes, places in the order and the count of repeated shingles before a place bound the
overlap beforehand, so edited copies that cannot be near meet no further. Parities of hashed shingles bound the
difference of the sets of what is left, and only pairs that these cannot exclude need texts. Every link is verified by
the exact sets, made anew from the texts of the candidates, which are sent compressed.

Defined cases: a text of fewer than five words is one shingle; null texts and texts without words have the empty set and
are copies of each other; rows without doc_id link nothing and stay; of rows that repeat a doc_id one stays; an empty
table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import collect, connected_components, cut, drop_listed, fresh_table, shuffle_partitions, small_batches, tidy
from .simhash import _LOWER, SEED
from .suffix import _batch, _open, _pack_sorted, _rows, _squeeze, _unpack_sorted

WORDS = 5
SIMILARITY = 0.8
#: Frequent shingles that the order puts last (bound of a broadcast), and shingles that a task counts at once.
FREQUENT, SEGMENT = 1_000_000, 4_000_000
#: Prefixes, in bytes, that a range of shingles stands for.
RANGE_BYTES = 16_000_000
#: Bits of the filter that lets candidates' texts through, as a power of two (bound of a broadcast: 1 MB).
FILTER_BITS = 23


def _hashes(text: str | None) -> np.ndarray:
    """Hashes of all shingles of a text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(WORDS, len(words))
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingles of a text, as sorted 64-bit hashes."""
    return np.unique(_hashes(text))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def mark(own: np.ndarray) -> bytes:
    """The size of a set (32 bits), and the parities of how many of its shingles fall on each of two to four bits a shingle."""
    bits = 1 << max(6, (2 * len(own) - 1).bit_length())
    return len(own).to_bytes(4, "little") + _parities(own, bits)


def _parities(own: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes) -> bool:
    """False only if the sets of two marks are less similar than a link: each odd bit of their sum is a shingle of one only."""
    n = int.from_bytes(a[:4], "little") + int.from_bytes(b[:4], "little")
    x, y = np.frombuffer(a, np.uint64, offset=4), np.frombuffer(b, np.uint64, offset=4)
    size = min(len(x), len(y))  # the low bits of a place in the longer one are the place in the shorter one
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size)) for z in (x, y))
    return (n - int(np.bitwise_count(x ^ y).sum())) / 2 >= SIMILARITY / (1 + SIMILARITY) * n - 1e-6


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a segment share, sorted, and how many do; over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()  # a segment is most of what a task holds
            every.sort()
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            n = np.diff(np.append(first, len(every)))
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(every[first[often]].view(np.int64)), pa.array(n[often])], ["s", "n"])

        for batch in batches:
            for t in batch.column("text"):
                held.append(shingle_set(t.as_py()))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    seen = docs.select(F.col("text").cast("string")).mapInArrow(tidy(run), "s long, n long")
    top = seen.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def _packs(docs: DataFrame) -> DataFrame:
    """(bid, doc_id, key, n, fp, mark, w0 to w3, payload): per batch of documents, arrays of ids, hashes of whole sets, set
    sizes, fingerprints and marks, and the shingles of which a near copy must share one, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def prefix(own: np.ndarray) -> np.ndarray:
        often, counts = shared.value
        size = len(own) - int(np.ceil(SIMILARITY * len(own) - 1e-9)) + 1 if len(own) else 0
        rank = np.zeros(len(own), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, own), len(often) - 1)
            rank = np.where(often[at] == own, counts[at], 0)
        return own[np.lexsort((own, rank))[:size]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid = TaskContext.get().partitionId() << 24
        for batch in batches:
            keys, sizes, firsts, fps, marks, words = [], [], [], [], [], []
            for t in batch.column("text"):
                every = _hashes(t.as_py())
                own = np.unique(every)
                keys.append(_key(own))
                sizes.append(len(own))
                firsts.append(prefix(own))
                fps.append(simhash.vote(every))
                marks.append(mark(own))
                words.append(_parities(own, 256))
            counts = np.array([len(x) for x in firsts], "<u4")
            row = bid, batch.column("doc_id").to_pylist(), keys, sizes, np.array(fps, np.uint64).view(np.int64).tolist(), marks, *np.frombuffer(b"".join(words), np.int64).reshape(-1, 4).T.tolist(), _squeeze(counts, np.concatenate([*firsts, np.empty(0, np.uint64)]))
            yield _batch(_PACK_NAMES, _PACK_KINDS, [row])
            bid += 1

    spark, name = docs.sparkSession, fresh_table(docs.sparkSession, "packs")
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _PACK_SCHEMA)
    made.write.bucketBy(shuffle_partitions(spark), "bid").saveAsTable(name)
    return spark.table(name)


#: Columns of a mark of 256 bits, for joins.
_WORDS = ["w0", "w1", "w2", "w3"]
_PACK_NAMES = ["bid", "doc_id", "key", "n", "fp", "mark", *_WORDS, "payload"]
_PACK_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary()), *[pa.list_(pa.int64())] * 4, pa.binary()]
_PACK_SCHEMA = "bid long, doc_id array<long>, key array<long>, n array<int>, fp array<long>, mark array<binary>, w0 array<long>, w1 array<long>, w2 array<long>, w3 array<long>, payload binary"


def _prefixes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, the row in the pack that holds each, and its place in that row's order; of the rows in question only."""
    counts, values = _open(row["payload"])
    counts = np.frombuffer(counts, "<u4").astype(np.int64)
    values = np.frombuffer(values, np.uint64)
    holder = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = np.zeros(len(counts), bool)
    own[row["rows"]] = True
    take = own[holder]
    return values[take], holder[take], place[take]


def _lists(ranges: int) -> Callable:
    """Pack -> its different shingles by range, with a flag for those that two of its sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                values, n = np.unique(_prefixes(row)[0], return_counts=True)
                place = (values % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                values, n, place = values[order], n[order], place[order]
                edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else [0]
                yield _batch(["p", "bid", "found"], [pa.int32(), pa.int64(), pa.binary()], [
                    (int(place[a]), row["bid"], _squeeze(_pack_sorted(values[a:b] // np.uint64(ranges)), np.packbits(n[a:b] > 1)))
                    for a, b in zip(edges, edges[1:])
                ])

    return run


def _repeated(ranges: int) -> Callable:
    """Shingles of one range from all packs -> for each pack, those that several sets have."""

    def run(table: pa.Table) -> pa.Table:
        p = np.uint64(table.column("p")[0].as_py())
        lists, flags = [], []
        for blob in table.column("found"):
            packed, bits = _open(blob.as_py())
            lists.append(_unpack_sorted(packed))
            flags.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(lists[-1])).astype(bool))
        every = np.sort(np.concatenate([*lists, *(v[f] for v, f in zip(lists, flags))]))
        several = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for bid, own in zip(table.column("bid").to_pylist(), lists):
            if len(several):
                own = own[several[np.minimum(np.searchsorted(several, own), len(several) - 1)] == own]
                if len(own):
                    rows.append((bid, _squeeze(own * np.uint64(ranges) + p)))
        return pa.Table.from_batches([_batch(["bid", "found"], [pa.int64(), pa.binary()], rows)])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack and its repeated shingles -> (s, key, n, i, h, m): holders of each, their set sizes, its place in their order,
    how many repeated ones stand before it, and how many there are."""
    for batch in batches:
        for row in _rows(batch):
            values, holder, place = _prefixes(row)
            several = np.sort(np.concatenate([np.frombuffer(_open(x)[0], np.uint64) for x in row["found"]]))
            take = several[np.minimum(np.searchsorted(several, values), len(several) - 1)] == values
            holder = holder[take]
            many = np.bincount(holder, minlength=len(row["key"]))
            before = np.arange(len(holder)) - (np.cumsum(many) - many)[holder]
            columns = (
                values[take].view(np.int64), np.array(row["key"])[holder],
                *(x.astype(np.int32) for x in (np.array(row["n"])[holder], place[take], before, many[holder])),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "key", "n", "i", "h", "m"])


def held_shingles(packs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(s, key, n, i, h, m): prefix shingles that several different sets hold, and their holders."""
    spark = packs.sparkSession
    rows = cut(nodes.groupBy("bid").agg(F.collect_list("pos").alias("rows")))  # bounded by a pack
    ranges = max(shuffle_partitions(spark), int((nodes.agg(F.sum("n")).first()[0] or 0) * 1.6) // RANGE_BYTES)
    lists = packs.select("bid", "payload").join(rows, "bid").select("bid", "payload", "rows")
    lists = lists.mapInArrow(tidy(_lists(ranges)), "p int, bid long, found binary")
    found = lists.groupBy("p").applyInArrow(tidy(_repeated(ranges)), "bid long, found binary")
    found = found.groupBy("bid").agg(F.collect_list("found").alias("found")).join(rows, "bid")
    own = packs.select("bid", "key", "n", "payload").join(found, "bid").select("payload", "key", "n", "rows", "found")
    return own.mapInArrow(tidy(_holders), "s long, key long, n int, i int, h int, m int")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, body): compressed texts of ``ids`` and, by chance, of some others."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.groupBy((bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {1 << FILTER_BITS}) % 64))")).alias("b")).toArrow()
    let = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    let[words.column("w").to_numpy()] = words.column("b").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(let.view(np.uint8), bitorder="little").astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            some = batch.filter(pa.array(shared.value[batch.column("bit").to_numpy()]))
            bodies = [squeeze((t.as_py() or "").encode()) for t in some.column("text")]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(bodies, pa.binary())], ["doc_id", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << FILTER_BITS)).alias("bit")).mapInArrow(tidy(run), "doc_id long, body binary")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their texts -> those whose sets are similar enough."""
    unpack = zstandard.ZstdDecompressor().decompress
    last: list = [None, None]
    for batch in batches:
        good = []
        for a, b in zip(batch.column("a"), batch.column("b")):
            b = b.as_py()
            if last[0] != b:  # a leader comes many times
                last[:] = [b, shingle_set(unpack(b).decode())]
            x, y = shingle_set(unpack(a.as_py()).decode()), last[1]
            common = len(np.intersect1d(x, y, assume_unique=True))
            good.append(common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9)
        yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their marks -> those that the marks do not exclude."""
    for batch in batches:
        good = [may_link(a.as_py(), b.as_py()) for a, b in zip(batch.column("a"), batch.column("b"))]
        yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])


def screened(pairs: DataFrame, packs: DataFrame) -> DataFrame:
    """The pairs (u, v) of set hashes whose marks leave room for a link."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    marks = packs.select(F.explode(F.arrays_zip("key", "mark")).alias("d")).select("d.*").join(ends, "key")
    marks = cut(marks.groupBy("key").agg(F.first("mark").alias("mark")))
    both = pairs.join(marks.select(F.col("key").alias("u"), F.col("mark").alias("a")), "u").join(
        marks.select(F.col("key").alias("v"), F.col("mark").alias("b")), "v"
    )
    return both.select("u", "v", "a", "b").mapInArrow(tidy(_screen), "u long, v long")


def _verified(pairs: DataFrame, packs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (u, v) of set hashes whose sets are similar enough; ``pairs`` is read more than once."""
    pairs = _done(screened(pairs, packs))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    ids = cut(nodes.select("key", "doc_id").join(ends, "key"))
    # of rows that repeat a doc_id any may come; only texts with the set in question count, and equal ones count once
    known = _texts(docs, ids.select("doc_id")).join(ids, "doc_id").groupBy("doc_id", "key", "body").agg(F.count("*").alias("n"))
    known = _done(known.select("key", "body").mapInArrow(tidy(_own), "key long, body binary"))
    both = pairs.join(known.select(F.col("key").alias("u"), F.col("body").alias("a")), "u").join(
        known.select(F.col("key").alias("v"), F.col("body").alias("b")), "v"
    )
    return both.select("u", "v", "a", "b").mapInArrow(tidy(_similar), "u long, v long").distinct()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text has the set that the key names."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        keys = batch.column("key").to_pylist()
        good = [k == _key(shingle_set(unpack(b.as_py()).decode())) for k, b in zip(keys, batch.column("body"))]
        yield batch.filter(pa.array(good, pa.bool_()))


def _possible(x: str, y: str):
    """Whether a shared shingle leaves room for enough overlap: repeated ones before it, and any from it on.

    A shingle before it that both sets have is in both prefixes, as all sets follow one order, and so is repeated.
    """
    of = lambda f, c: f(F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
    after = F.least(F.col(f"{x}.n") - F.col(f"{x}.i"), F.col(f"{y}.n") - F.col(f"{y}.i"))
    return of(F.least, "h") + after >= SIMILARITY / (1 + SIMILARITY) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - 1e-6


def shared_lists(placed: DataFrame) -> DataFrame:
    """(one, two, key, n, root, i, h, j, c): holders of shingles (s, key, n, i, h, root) that several components hold.

    Shingles with the same holders are one list, named by (one, two): of its c shingles a holder has the first at place
    i, after h repeated ones, and the last at place j. The order is one for all sets, so these are the same shingles in
    all holders.
    """
    named = placed.groupBy("s").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("key")).alias("one"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("two"),
    ).where("lo < hi").select("s", "one", "two")
    return placed.join(named, "s").groupBy("one", "two", "key").agg(
        F.min("n").alias("n"), F.min("root").alias("root"), F.min("i").alias("i"), F.min("h").alias("h"),
        F.max("i").alias("j"), F.count("*").alias("c"),
    )


def _alike(x: str, y: str):
    """Whether marks of 256 bits leave room for a link."""
    odd = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in _WORDS[1:]), F.bit_count(F.col(f"{x}.w0").bitwiseXOR(F.col(f"{y}.w0"))))
    return odd <= (1 - 2 * SIMILARITY / (1 + SIMILARITY)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6


def _done(df: DataFrame) -> DataFrame:
    """``cut``, after which the shuffles that made ``df`` go at once: those of all steps together would be most of the disk."""
    spark, out = df.sparkSession, cut(df)
    del df
    collect(spark)
    return out


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) per row with a doc_id: the smallest doc_id reachable over links."""
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    packs = _packs(docs)
    every = packs.select("bid", F.posexplode(F.arrays_zip("doc_id", "key", "n", "fp", *_WORDS)).alias("pos", "d")).select("bid", "pos", "d.*")
    nodes = every.groupBy("key").agg(F.min(F.struct("doc_id", "bid", "pos")).alias("at"), *(F.min(c).alias(c) for c in ("n", "fp", *_WORDS)))
    nodes = _done(nodes.select("key", "at.*", "n", "fp", *_WORDS))

    first = cut(nodes.groupBy("fp").agg(F.min("key").alias("key")))
    near = _done(simhash.links(first.select("fp")))
    by_print = near.join(first.select(F.col("fp").alias("u"), F.col("key").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("key").alias("b")), "v")
    by_print = by_print.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        nodes.select("fp", F.col("key").alias("u")).join(first.select("fp", F.col("key").alias("v")), "fp").where("u <> v").select("u", "v")
    )
    held = _done(held_shingles(packs, nodes))
    groups = held.groupBy("s").agg(F.max(F.struct("m", "key", "n", "i", "h")).alias("y"))
    stars = held.select("s", F.struct("key", "n", "i", "h").alias("x")).join(groups, "s").where("x.key <> y.key").where(_possible("x", "y"))
    stars = stars.select(F.col("x.key").alias("u"), F.col("y.key").alias("v")).unionByName(by_print)
    stars = _done(stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    links = _done(_verified(stars, packs, nodes, docs))
    roots = _done(connected_components(links))
    placed = held.join(roots, held.key == roots.node, "left").select("s", "key", "n", "i", "h", F.coalesce("root", "key").alias("root"))
    lists = _done(shared_lists(placed).join(nodes.select("key", *_WORDS), "key"))
    x, y = (lists.select("one", "two", F.struct("key", "n", "i", "h", "j", "c", "root", *_WORDS).alias(k)) for k in "xy")
    rest = x.join(y, ["one", "two"]).where("x.root <> y.root and x.key > y.key").where(_possible("x", "y") & _alike("x", "y"))
    # shared shingles up to the last shared place are counted; after it, prefixes share none, and the rest bounds the overlap
    rest = rest.groupBy(F.col("x.key").alias("u"), F.col("y.key").alias("v")).agg(
        F.sum("x.c").alias("c"), *(f(f"{s}.{c}").alias(s + c) for s in "xy" for f, c in ((F.first, "n"), (F.max, "j")))
    )
    room = F.col("c") + F.least(F.col("xn") - F.col("xj"), F.col("yn") - F.col("yj")) - 1
    rest = rest.where(room >= SIMILARITY / (1 + SIMILARITY) * (F.col("xn") + F.col("yn")) - 1e-6).select("u", "v")
    rest = _done(rest.join(stars, ["u", "v"], "left_anti"))
    links = _done(links.unionByName(_verified(rest, packs, nodes, docs)))
    roots = _done(connected_components(links))
    tied = nodes.join(roots, nodes.key == roots.node, "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    least = tied.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = tied.join(least, "root").select("key", "component_id")
    return every.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each group."""
    return drop_listed(docs, components(docs))
