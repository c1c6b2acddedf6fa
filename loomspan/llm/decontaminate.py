"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

The CGK embedding walks a sequence by coin flips: at step j it emits the word it stands on and moves on if bit j of that
word's hash is set. Two sequences at small edit distance fall back into step soon, so their walks agree in most places:
edit distance has become Hamming distance. Bit sampling then hashes a few places of the walk.

Every word of a document starts a walk, and so does every word of an item, so that any stretch inside an item-sized
window can meet its counterpart; windows of an item's size around the start are what is verified. ``ROUNDS`` repetitions,
each with its own coins and ``PLACES`` places, raise recall: a walk stands on a word for two steps on average, so
``STEPS`` steps see about 12 words, and a start whose sampled words are intact collides. Starts are dropped at the first
sampled place that no item shares.

Letter edits break most words long before they break the edit bound, so items are also sought by characters: strings of
``GRAM`` characters that an item and a text share are counted along bands of diagonals (place in the text less place in
the item), and a band with a share of an item's strings is a candidate. Of a long item those strings vote that the fewest
items hold, half of them; edits at every fifth letter, the most that the bound allows when spread evenly, leave one string
in five whole, and ``SHARE`` of the votes is asked for. Items under 60 characters ask for the bound below which no match
can fall. ``tests/llm/test_decontaminate.py`` asks for a recall of 0.95 over random and 0.9 over evenly spread edits.

What is left is verified, all candidates of a batch together: the item against the window, by the exact edit distance of
lower-cased texts with single spaces (bit-parallel, free ends).

Items reach the executors in blocks of at most ``ITEM_BYTES``; a larger benchmark is gone through block by block.

Defined cases: null or wordless texts and items never match; items under 14 words use shorter walks; repeated rows
and repeated items give one row per pair of ids, with the least distance; items with equal texts all match; null ids are
kept as ids; very long texts are searched whole, in pieces of bounded size that overlap; empty tables give no match; other
columns are ignored by ``contaminated`` and pass through ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_buffers, tidy
from .langid import _pieces

SIMILARITY = 0.8
STEPS, PLACES, ROUNDS, STRIDE = 24, 8, 12, 1
#: Steps of a walk and the least words of an item for it; short items take shorter walks.
TIERS = ((STEPS, 14), (8, 5), (1, 1))
ITEM_BYTES = 16_000_000
#: Length of the strings of characters by the least length of an item, and the share of their weight that a candidate holds.
GRAM, SHARE = ((4, 60), (4, 16), (2, 2)), 0.15
_CHARS = 500_000
#: Size of a sieve, as a power of two: a few per cent of it is set for a block of items as large as a benchmark's.
_BITS = 18

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1


_power: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse, modulo 2^64; the longest so far are kept."""
    if len(_power[0]) <= n:
        back = pow(_R, -1, 1 << 64)
        factors = [np.full(n + 1, r, np.uint64) for r in (_R, back)]
        for f in factors:
            f[0] = 1
        with np.errstate(over="ignore"):
            _power[:] = [np.cumprod(f, dtype=np.uint64) for f in factors]
    return _power


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(by)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text) of each word; after the last word of each text stands an end mark of hash 0."""
    n, texts = len(data), len(bounds) - 1
    size = 1 << max(16, n.bit_length())
    power, back = _powers(size)
    inside = _WORD_BYTE[data]
    joined = np.zeros(n, bool)
    if n:
        joined[1:] = inside[:-1]
        joined[bounds[:-1][bounds[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~joined)
    stops = np.ones(n, bool)
    if n:
        stops[:-1] = ~inside[1:]
        stops[bounds[1:][bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & stops) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * power[:n], dtype=np.uint64)))
        code = _mix((sums[ends] - sums[starts]) * back[starts], 1) | np.uint64(1)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    # texts of no bytes share a bound; the last of them is found, which holds no word anyway
    at = np.arange(len(starts)) + doc
    total = len(starts) + texts
    out = [np.zeros(total, np.uint64), np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)]
    for x, y in zip(out, (code, starts, ends, doc)):
        x[at] = y
    marks = np.ones(total, bool)
    marks[at] = False
    out[3][marks] = np.arange(texts)
    return tuple(out)


@lru_cache(maxsize=64)
def _plan(steps: int, turn: int) -> tuple[int, tuple[int, ...]]:
    """Seed and sampled places of a repetition, the start among them."""
    rng = np.random.default_rng((steps, turn, 5))
    if steps < 4:
        return 1000 * steps + turn, tuple(range(steps))
    second = 1 + turn % 2  # near the start, so that most starts end early
    later = np.sort(rng.choice(np.arange(second + 1, steps), min(PLACES, steps // 2) - 2, replace=False))
    return 1000 * steps + turn, (0, second, *map(int, later))


@lru_cache(maxsize=64)
def _coins(steps: int, turn: int) -> np.uint64:
    """An odd factor: bits of its product with a word's hash are the coins of a repetition."""
    return np.random.default_rng((steps, turn, 6)).integers(1 << 62, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def walk(code: np.ndarray, at: np.ndarray, steps: int, turn: int, sieve: list[np.ndarray], fill: bool = False) -> tuple[np.ndarray, ...]:
    """(start, key): keys of the sampled places for walks from the words ``at``, of those that ``sieve`` lets through.

    With ``fill``, as for the items' own walks, the sieve takes what they give, place by place. The starts' own words were
    looked up before, so the first place is not sieved. Words are hashed already: high bits of a product are coins and places
    in a sieve, and an end mark, 0, makes no step.
    """
    seed, places = _plan(steps, turn)
    start, here, key, coins = at, at, np.uint64(seed), _coins(steps, turn)
    with np.errstate(over="ignore"):
        for j in range(places[-1] + 1):
            word = code[here]
            if j in places:
                key = (key ^ word) * np.uint64(0xD6E8FEB86659FD93)
                slot, let = (key >> np.uint64(64 - _BITS)).view(np.int64), sieve[places.index(j)]
                if fill:
                    let[slot[word != 0]] = True
                if j:
                    go = np.flatnonzero(let[slot] & (word != 0))
                    start, here, key, word = start[go], here[go], key[go], word[go]
            here = here + ((word * coins >> np.uint64(63 - j)) & np.uint64(1)).view(np.int64)
    return start, key


class Items:
    """Item texts with the keys of their walks."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.rows = [(i, _plain(t)) for i, t in rows if t]
        column = pa.array([t for _, t in self.rows], pa.string())
        code, _, _, item = words(*text_buffers(column))
        real = code != 0
        self.length = np.bincount(item[real], minlength=len(self.rows))
        begin = np.searchsorted(item, np.arange(len(self.rows)))
        self.tables = []
        for tier, (steps, least) in enumerate(TIERS):
            above = TIERS[tier - 1][1] if tier else 1 << 60
            own = np.flatnonzero((self.length >= least) & (self.length < above))
            if not len(own):
                continue
            at = np.concatenate([np.arange(begin[i], begin[i] + self.length[i], STRIDE) for i in own.tolist()])
            known = np.zeros(1 << 20, bool)  # words that these items hold: a walk has to start on one
            known[(code[at] >> np.uint64(44)).astype(np.int64)] = True
            for turn in range(ROUNDS if steps >= 4 else 1):
                _, places = _plan(steps, turn)
                sieve = [np.zeros(1 << _BITS, bool) for _ in places]
                start, key = walk(code, at, steps, turn, sieve, fill=True)
                order = np.argsort(key, kind="stable")
                self.tables.append((steps, turn, known, sieve, key[order], item[start[order]], (start - begin[item[start]])[order]))

        self.grams = [g for g in (self._grams(t) for t in range(len(GRAM))) if g]

    def _grams(self, tier: int) -> tuple | None:
        """Length, then items' band widths, thresholds, string hashes, their items and bands, by hash."""
        (q, least), above = GRAM[tier], GRAM[tier - 1][1] if tier else 1 << 60
        size = np.array([len(t) for _, t in self.rows], np.int64)
        own = np.flatnonzero((size >= least) & (size < above))
        if not len(own):
            return None
        bound = ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)
        width = np.maximum(bound, 1)
        codes = [_hashes(_points(self.rows[i][1]), q) for i in own.tolist()]
        item = np.repeat(own, [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes])
        code = np.concatenate(codes)
        if not tier:
            # of a long item, the strings vote that the fewest items hold: half of them, whatever the benchmark's size
            _, back, held = np.unique(code, return_inverse=True, return_counts=True)
            order = np.lexsort((held[back], item))
            turn = np.arange(len(order)) - np.searchsorted(item[order], item[order])
            own_size = np.array([len(c) for c in codes])
            vote = np.sort(order[turn < np.repeat((own_size + 1) // 2, own_size)])
            code, item, place = code[vote], item[vote], place[vote]
        order = np.argsort(code, kind="stable")
        code, first = np.unique(code[order], return_index=True)
        item, place = item[order], place[order]
        number = np.diff(np.append(first, len(order)))
        # a long item's strings weigh less the more often items hold them: common words would fill any band
        weight = np.ones(len(order)) if tier else np.repeat(1 / number, number)
        if tier:
            need = np.maximum(size - q + 1 - q * bound, 1)
        else:
            need = SHARE * np.bincount(item, weight, len(size))
        table = np.full(1 << _GRAM_BITS, -1, np.int32)  # the first code of each slot; its neighbours follow in order
        slot = (code >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)
        table[slot[::-1]] = np.arange(len(code))[::-1]
        # a string at t in the text is in band (t + size - place + 0.5) / width of its item: a half keeps clear of edges
        scale = 1 / width[item]
        return q, own, size, bound, width, table, code, first, number, weight / need[item], item, scale, (size[item] - place + 0.5) * scale

    def bands(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the stretches of characters in which an item may stand."""
        for q, own, size, bound, width, table, code, first, number, weight, item, scale, band in self.grams:
            found = _hashes(data, q)
            k = table[(found >> np.uint64(64 - _GRAM_BITS)).astype(np.int64)]
            at = np.flatnonzero(k >= 0)
            k, found = k[at], found[at]
            other = np.flatnonzero(code[k] != found)  # a later code of the slot, or none
            k[other] = np.minimum(np.searchsorted(code, found[other]), len(code) - 1)
            same = np.ones(len(k), bool)
            same[other] = code[k[other]] == found[other]
            at, k = at[same], k[same]
            n = number[k]
            hit = np.repeat(first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cells = np.zeros(len(size) + 1, np.int64)
            cells[own + 1] = (len(data) + size[own]) // width[own] + 3
            base = np.cumsum(cells)
            # bands are numbered from the first place at which an item could begin
            key = (np.repeat(at.astype(np.float64), n) * scale[hit] + (base[item] + band)[hit]).astype(np.int64)
            if base[-1] <= 16 * len(key) + (1 << 16):
                count = np.bincount(key, weight[hit], base[-1] + 1)
                # two neighbours make a candidate, so one of them holds half of what is asked for
                half = np.flatnonzero(count >= 0.5 - 1e-9)
                key = np.unique(np.concatenate([half, np.maximum(half - 1, 0)]))
                total = count[key] + count[key + 1]
                i = np.searchsorted(base, key, side="right") - 1
                total -= np.where(key + 1 == base[i + 1], count[key + 1], 0)
            else:
                key, where = np.unique(key, return_inverse=True)
                total = np.bincount(where, weight[hit], len(key))
                if len(key):
                    key, total = np.concatenate([key, key - 1]), np.concatenate([total, total])
                    key, where = np.unique(key, return_inverse=True)
                    total = np.bincount(where, total)
                i = np.searchsorted(base, key, side="right") - 1
            good = (total >= 1 - 1e-9) & (i >= 0)
            key, i = key[good], i[good]
            if not len(key):
                continue
            fresh = np.append(True, (np.diff(key) > 1) | (np.diff(i) > 0))
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(key)) - 1
            for x, a, b in zip(i[heads].tolist(), key[heads].tolist(), key[tails].tolist()):
                begin, end = (c * int(width[x]) - int(size[x]) for c in (a - int(base[x]), b - int(base[x]) + 2))
                yield x, begin - int(bound[x]), end + int(size[x]) + 2 * int(bound[x])

    def candidates(self, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows of (text, item, word place where the item would start, in fours), sorted and different."""
        high, real = (code >> np.uint64(44)).view(np.int64), code != 0
        found = [np.empty((0, 3), np.int64)]
        for steps, turn, known, sieve, keys, items, offsets in self.tables:
            if not turn:
                every = np.flatnonzero(known[high] & real)
            start, key = walk(code, every, steps, turn, sieve)
            lo, n = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            n -= lo
            hit = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = np.repeat(start, n)
            found.append(np.stack([doc[start], items[hit], (start - offsets[hit]) // 4], 1))
        return np.unique(np.concatenate(found), axis=0)


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


_GRAM_BITS = 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of each string of ``q`` characters."""
    n = max(0, len(points) - q + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(q):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += points[j : j + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def edit_distance_within(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``, bit-parallel over the pattern."""
    if pattern in text:
        return 0
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best = m
    for c in text:
        eq = where.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        plus = (down | ~(d | up)) & full
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(x | plus)) & full, plus & x
        best = min(best, score)
    return best


#: Strings of characters that verification looks at first, their places in a table of each pair, and pairs at once.
_SCREEN, _SCREEN_BITS, _SCREENED = 3, 13, 512


def plausible(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Whether a text holds as many of a pattern's strings of three characters as any match has to.

    An edit breaks three of them at most, and all others stand in the text as they are; strings that fall on one place of
    the table only let more pairs through. So no match is lost.
    """
    out = np.ones(len(patterns), bool)
    for first in range(0, len(patterns), _SCREENED):
        own = slice(first, first + _SCREENED)
        sides = []
        for strings in (patterns[own], texts[own]):
            size = np.fromiter(map(len, strings), np.int64, len(strings))
            code = _hashes(_points("\n".join(strings)), _SCREEN)
            lane = np.repeat(np.arange(len(size)), size + 1)[: len(code)]
            inside = np.arange(len(code)) + _SCREEN <= (np.cumsum(size + 1) - 1)[lane]
            lane, code = lane[inside], code[inside]
            sides.append((size, lane, lane << _SCREEN_BITS | (code >> np.uint64(64 - _SCREEN_BITS)).view(np.int64)))
        (size, lane, asked), (_, _, held) = sides
        seen = np.zeros(len(size) << _SCREEN_BITS, bool)
        seen[held] = True
        bound = ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)
        out[own] = np.bincount(lane, seen[asked], len(size)) >= size - _SCREEN + 1 - _SCREEN * bound
    return out


def edit_distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """``edit_distance_within`` of many pairs at once: one bit vector of several words for each, all stepped together."""
    out = np.array([len(p) for p in patterns], np.int64)
    words = -(-out // 64)
    order = np.lexsort((-np.array([len(t) for t in texts], np.int64), words))
    for w in np.unique(words).tolist():
        alike = order[words[order] == w]
        for first in range(0, len(alike), _LANES):
            own = alike[first : first + _LANES]
            out[own] = np.minimum(out[own], _stepped([patterns[k] for k in own.tolist()], [texts[k] for k in own.tolist()]))
    return out


def _stepped(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The least score of each lane; texts come longest first."""
    kinds = {p: k for k, p in enumerate(dict.fromkeys(patterns))}
    lane = np.array([kinds[p] for p in patterns])
    size = np.array([len(p) for p in patterns])
    words = -(-int(size.max()) // 64)
    signs = np.unique(_points("".join(kinds)))
    room = len(signs) + 1  # the last stands for characters that no pattern has
    masks = np.zeros((words, len(kinds) * room), np.uint64)
    for p, k in kinds.items():
        place = np.arange(len(p))
        np.bitwise_or.at(masks, (place // 64, k * room + np.searchsorted(signs, _points(p))), np.uint64(1) << (place % 64).astype(np.uint64))
    length = np.array([len(t) for t in texts])
    steps = np.full((int(length[0]), len(texts)), room - 1, np.int32)
    for k, t in enumerate(texts):
        c = _points(t)
        at = np.minimum(np.searchsorted(signs, c), len(signs) - 1)
        steps[: len(c), k] = np.where(signs[at] == c, at, room - 1)
    steps += (lane * room).astype(np.int32)
    active = len(texts) - np.searchsorted(length[::-1], np.arange(len(steps)), side="right")
    one, top = np.uint64(1), np.uint64(63)
    word, bit = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    score, best, lanes = size.copy(), size.copy(), np.arange(len(texts))
    up, down = np.full((words, len(texts)), ~np.uint64(0)), np.zeros((words, len(texts)), np.uint64)
    for t, n in enumerate(active.tolist()):
        if n < up.shape[1]:
            up, down = np.ascontiguousarray(up[:, :n]), np.ascontiguousarray(down[:, :n])
        eq = masks.take(steps[t, :n], axis=1)
        x = eq | down
        total = (eq & up) + up
        over = total < up
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        d = (total ^ up) | eq
        plus, minus = down | ~(d | up), up & d
        at = word[:n], lanes[:n]
        score[:n] += ((plus[at] >> bit[:n]) & one).astype(np.int64) - ((minus[at] >> bit[:n]) & one).astype(np.int64)
        np.minimum(best[:n], score[:n], out=best[:n])
        high_plus, high_minus = plus[:-1] >> top, minus[:-1] >> top
        plus <<= one
        minus <<= one
        plus[1:] |= high_plus
        minus[1:] |= high_minus
        up, down = minus | ~(x | plus), plus & x
    return best


#: Pairs that are stepped together, and bytes of text that are searched at once.
_LANES, _SOUGHT = 2048, 2_000_000


def _windows(items: Items, column: pa.Array) -> list[tuple[int, int, str]]:
    """(text, item, window): where an item may stand."""
    data, bounds = text_buffers(column)
    code, start, end, doc = words(data, bounds)
    if not len(code):
        return []
    first = np.searchsorted(doc, np.arange(len(bounds) - 1))
    last = np.append(first[1:], len(code)) - 1  # the end mark
    windows: list[tuple[int, int, str]] = []
    found = items.candidates(code, doc)
    if len(found):
        d, i, four = found.T
        n = items.length[i]
        a, b = np.maximum(4 * four - 4 - n // 4, first[d]), np.minimum(4 * four + n + 8 + n // 4, last[d] - 1)
        # windows of one pair that overlap become one
        far = np.maximum.accumulate(b + (d * len(items.rows) + i) * (len(code) + 1))
        head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (a[1:] + (d * len(items.rows) + i)[1:] * (len(code) + 1) > far[:-1])))
        b = np.maximum.reduceat(b, head)
        for x, y, lo, hi in zip(d[head].tolist(), i[head].tolist(), a[head].tolist(), b.tolist()):
            begin = bounds[x] if lo == first[x] else start[lo]
            stop = bounds[x + 1] if hi == last[x] - 1 else end[hi]
            windows.append((x, y, _plain(data[begin:stop].tobytes().decode("utf-8", "replace"))))
    return windows + list(_by_characters(items, column))


def matches(items: Items, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, item length) of verified pairs, the least distance of each.

    Windows are sought in ``_SOUGHT`` bytes of text at a time, which bounds memory, and verified all together.
    """
    windows: list[tuple[int, int, str]] = []
    group = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)) // _SOUGHT
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        windows += [(a + d, i, text) for d, i, text in _windows(items, column.slice(a, b - a))]
    best: dict[tuple[int, int], int] = {}
    patterns, texts, pairs = [], [], []
    for d, i, text in windows:
        pattern = items.rows[i][1]
        if pattern in text:
            best[d, i] = 0
            continue
        # long windows are cut into overlapping pieces, each of which holds any match that starts in it
        whole = len(pattern) + int((1 - SIMILARITY) * len(pattern)) + 1
        for at in range(0, max(1, len(text) - whole + 1), whole):
            patterns.append(pattern)
            texts.append(text[at : at + 2 * whole])
            pairs.append((d, i))
    rest = [k for k, pair in enumerate(pairs) if pair not in best]
    rest = [k for k, ok in zip(rest, plausible([patterns[k] for k in rest], [texts[k] for k in rest]).tolist()) if ok]
    for k, distance in zip(rest, edit_distances([patterns[k] for k in rest], [texts[k] for k in rest]).tolist()):
        if distance <= (1 - SIMILARITY) * len(patterns[k]) + 1e-9:
            best[pairs[k]] = min(distance, best.get(pairs[k], distance))
    return [(d, i, x, len(items.rows[i][1])) for (d, i), x in best.items()]


def _by_characters(items: Items, column: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(text, item, window) of the bands of runs of texts, about ``_CHARS`` characters each."""
    texts, size, first = [], 0, 0
    for d, t in enumerate(column):
        texts.append(_plain(t.as_py() or ""))
        size += len(texts[-1]) + 1
        if size < _CHARS and d + 1 < len(column):
            continue
        whole = "\n".join(texts)  # no plain text holds a line break
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        for i, a, b in items.bands(_points(whole)):
            for n in range(int(np.searchsorted(ends, max(a, 0))), len(texts)):
                start = int(ends[n]) - len(texts[n])
                if start >= b:
                    break
                yield first + n, i, texts[n][max(a - start, 0) : max(b - start, 0)]
        texts, size, first = [], 0, d + 1


_held: list = [None, None]


def _items(shared) -> Items:
    """The items of a broadcast block of texts, with their tables, built once a worker: only the texts are sent."""
    if _held[0] is not shared.value:
        _held[:] = [shared.value, Items(shared.value)]
    return _held[1]


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``size`` bytes of text: smaller ones pay the fixed cost of a search more often."""
    held, total = [], 0
    join = lambda: held[0] if len(held) == 1 else pa.concat_batches(held)
    for whole in batches:
        for batch in _pieces(whole):
            own = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if held and total + own > size:
                yield join()
                held, total = [], 0
            held.append(batch)
            total += own
    if held:
        yield join()


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    return [rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edit_distance, similarity) of documents that hold a passage within the edit bound of an item."""
    spark = small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, edit_distance int, similarity double"
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = _items(shared)
            for batch in _gathered(batches):
                found = matches(items, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([d for d, *_ in found], pa.int64())),
                        pa.array([items.rows[i][0] for _, i, *_ in found], pa.int64()),
                        pa.array([x for *_, x, _ in found], pa.int32()),
                        pa.array([1 - x / n for *_, x, n in found], pa.float64()),
                    ],
                    ["doc_id", "item_id", "edit_distance", "similarity"],
                )

        out = out.unionByName(base.mapInArrow(tidy(run), schema))
    return out.groupBy("doc_id", "item_id").agg(
        F.min("edit_distance").alias("edit_distance"), F.max("similarity").alias("similarity")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    spark = small_batches(docs.sparkSession)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches):
                stay = np.ones(len(batch), bool)
                stay[[d for d, *_ in matches(_items(shared), batch.column("text"))]] = False
                yield batch.filter(pa.array(stay))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
