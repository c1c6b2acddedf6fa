"""Language identification by prediction by partial matching.

Per language, a byte context tree of orders 0 to 3 holds how often each byte followed each context. The code length of a
byte in a language is that of its longest known context: a byte seen there costs -log2 n(c, b) / (n(c) + t(c)), with t(c)
the number of different bytes seen there; any other costs the escape -log2 t(c) / (n(c) + t(c)) and then its cost in the
next shorter context, down to a uniform choice (method C, without exclusion). A text goes to the language with the
shortest code under these frozen statistics.

Counts are taken over all learning documents: each task counts the four-byte strings of its batch per language, and
Spark sums them. The trees are then frozen in parts of ``TOGETHER`` languages, over all 256 bytes: contexts of up to one
byte as a dense table, longer ones as the strings that were seen, each with its code length in every language of the part.
What reaches the driver and the executors are the different strings, not the corpus; a text is costed part by part and
``_STEP`` bytes at a time.

Defined cases: ``und`` and score 0 for a null text, a text without any letter, or if nothing could be learned; ties go to
the language first in order; rows with null lang teach nothing; repeated rows count each time; very long texts are costed
whole; other columns are ignored; an empty table gives an empty result. The score is the share of the language's
likelihood when code lengths are divided by the square root of the text's length in bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, text_buffers

#: Languages whose code lengths stand beside each other in one table.
TOGETHER = 16
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PIECE = 4_000_000
_STEP = 500_000


def _pieces(batch: pa.RecordBatch, size: int = _PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _framed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each behind three line breaks, and where each text starts."""
    data, bounds = text_buffers(column)
    n = len(bounds) - 1
    starts = bounds[:-1] + 3 * np.arange(1, n + 1)
    out = np.full(len(data) + 3 * n, 10, np.uint8)
    out[np.arange(len(data)) + 3 * np.repeat(np.arange(1, n + 1), np.diff(bounds))] = _LOWER[data]
    return out, starts


def count_strings(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): occurrences of each four-byte string per language, over all rows of (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole):
                for lang in pc.unique(batch.column("lang")).to_pylist():
                    own = batch.filter(pc.equal(batch.column("lang"), lang))
                    data, starts = _framed(own.column("text"))
                    if len(data) < 4:
                        continue
                    d = data.astype(np.uint32)
                    gram = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
                    real = np.ones(len(gram), bool)
                    for back in (4, 5, 6):  # the frame is context, never predicted
                        at = starts - back
                        real[at[at >= 0]] = False
                    found, n = np.unique(gram[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    base = docs.where("lang is not null and text is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    return base.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Index:
    """Finds the places of integers in a list of different ones, by open addressing."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.bits = max(4, int(4 * max(1, len(codes)) - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(codes), dtype=np.int32), self._slot(codes)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # one of those that want a slot gets it
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        if not len(self.codes):
            return np.full(len(wanted), -1, np.int32)
        slot = self._slot(wanted)
        out = self.table[slot]
        left = np.flatnonzero((out >= 0) & (self.codes[out] != wanted))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            out[left] = self.table[slot[left]]
            left = left[(out[left] >= 0) & (self.codes[out[left]] != wanted[left])]
        return out


class Part:
    """Frozen code lengths of some languages: dense up to order 1, and the strings of orders 2 and 3 that one has seen."""

    def __init__(self, k: int, counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts: by string length 1 to 4, the language's number, the string, and its count."""
        cost = np.full((k, 1, 256), 8.0)
        for order in range(2):
            lang, gram, n = counts[order + 1]
            seen = np.bincount((lang << 8 * (order + 1)) + gram, n.astype(float), k << 8 * (order + 1)).reshape(k, 1 << 8 * order, 256)
            cost = self._escape(seen, cost.reshape(k, 1, 256))
        self.base = np.ascontiguousarray(cost.reshape(k, -1).T.astype(np.float32))
        self.orders = []
        for order in (2, 3):
            lang, gram, n = counts[order + 1]
            cells, cell = np.unique(gram, return_inverse=True)
            seen = np.bincount(cell * k + lang, n.astype(float), len(cells) * k).reshape(-1, k)
            contexts, first, where = np.unique(cells >> 8, return_index=True, return_inverse=True)
            total, kinds = (
                np.add.reduceat(x, first, axis=0) if len(first) else np.zeros((0, k)) for x in (seen, (seen > 0).astype(float))
            )
            with np.errstate(divide="ignore", invalid="ignore"):
                size = np.log2(total + kinds)
                leave = np.where(total > 0, size - np.log2(kinds), 0.0)
                longest = np.where(seen > 0, size[where] - np.log2(seen), leave[where] + self.cost(cells & ((1 << 8 * order) - 1), order - 1))
            leave = np.concatenate([leave, np.zeros((1, k))]).astype(np.float32)  # the last row is for contexts not seen
            self.orders.append((Index(cells), longest.astype(np.float32), Index(contexts), leave))

    @property
    def cells(self) -> np.ndarray:
        """The strings of order 3 that one of the languages has seen."""
        return self.orders[-1][0].codes

    def cost(self, code: np.ndarray, order: int = 3) -> np.ndarray:
        """The code length of the last byte of each string of ``order`` + 1 bytes, per language."""
        if order < 2:
            return self.base[code]
        cells, longest, contexts, leave = self.orders[order - 2]
        at = cells.find(code)
        miss = np.flatnonzero(at < 0)
        out = longest[at] if len(longest) else np.zeros((len(code), self.base.shape[1]), np.float32)
        if len(miss):
            rest = code[miss]
            out[miss] = leave[contexts.find(rest >> 8)] + self.cost(rest & ((1 << 8 * order) - 1), order - 1)
        return out

    @staticmethod
    def _escape(seen: np.ndarray, below: np.ndarray) -> np.ndarray:
        n, t = seen.sum(2, keepdims=True), (seen > 0).sum(2, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log2(n + t) - np.log2(seen)
            escape = np.log2(n + t) - np.log2(t) + below
        return np.where(n == 0, below, np.where(seen > 0, known, escape))


class Model:
    """Frozen code lengths of all languages, in parts of ``TOGETHER`` languages."""

    def __init__(self, langs: list[str], parts: list[Part]) -> None:
        self.langs, self.parts = langs, parts

    def bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language, and the texts' lengths in bytes."""
        data, starts = _framed(column)
        n = len(starts)
        size = np.diff(np.append(starts, len(data) + 3)) - 3
        out = np.zeros((n + 1, len(self.langs)))  # the last row gathers the frame
        owner = np.repeat(np.stack([np.full(n, n), np.arange(n)], 1).ravel(), np.stack([np.full(n, 3), size], 1).ravel())[3:]
        for a in range(0, len(owner), _STEP):
            d, own = data[a : a + _STEP + 3].astype(np.int64), owner[a : a + _STEP]
            code = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for i, part in enumerate(self.parts):
                sums = np.add.reduceat(part.cost(code), heads, axis=0, dtype=np.float64)
                np.add.at(out[:, i * TOGETHER : (i + 1) * TOGETHER], own[heads], sums)
        return out[:n], size


def learn(docs: DataFrame) -> Model | None:
    """Fit on all rows of (text, lang); null if there is none."""
    small_batches(docs.sparkSession)
    grams = cut(count_strings(docs))
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    if not langs:
        return None

    def strings(size: int):
        own = grams.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1)).alias("gram"), "n")
        return own.groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    parts = []
    for at in range(0, len(langs), TOGETHER):
        some = langs[at : at + TOGETHER]
        place, counts = pa.array(some), {}
        for size in range(1, 5):
            got = strings(size).where(F.col("lang").isin(some)).toArrow()
            code = pc.index_in(got.column("lang"), place).to_numpy().astype(np.int64)
            counts[size] = code, got.column("gram").to_numpy(), got.column("n").to_numpy()
        parts.append(Part(len(some), counts))
    return Model(langs, parts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in _pieces(whole):
                text = batch.column("text")
                letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
                if m is None:
                    letters = np.zeros(len(batch), bool)
                    best, share = np.zeros(len(batch), int), np.zeros(len(batch))
                else:
                    bits, size = m.bits(text)
                    best = bits.argmin(1)
                    gap = (bits - bits.min(1, keepdims=True)) / np.sqrt(np.maximum(size, 1))[:, None]
                    share = 1.0 / np.exp2(-gap).sum(1)
                names = [m.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out(modulus: int, remainder: int):
    """Whether a row's doc_id falls in the fold that nothing is learned from; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn outside the fold crc32(doc_id) mod 4 = 2 and predict all rows: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out(4, 2)))
    return predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
