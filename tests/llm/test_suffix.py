"""Parts of suffix-array dedup by themselves."""

import numpy as np

from loomspan.llm import suffix


def test_ranges_are_dealt_by_one_sort():
    for ranges in (1, 7, 3000, 100_000):
        place = np.random.default_rng(ranges).integers(0, ranges, 2000, dtype=np.uint64)
        dealt = suffix._dealt(place, ranges)
        assert [p for p, _ in dealt] == sorted(set(place.tolist()))
        for p, own in dealt:
            assert own.tolist() == np.flatnonzero(place == p).tolist()
    assert suffix._dealt(np.empty(0, np.uint64), 5) == []


def _left_windows(texts, ranges=7, bits=40):
    """Windows (document, start) that are left when every context of two documents is repeated."""
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = suffix.anchor_runs(data, bounds, bits)
    key, which, _, _ = suffix.contexts(found, ranges, bits)
    docs = {}
    for k, d in zip(key.tolist(), found[3][which].tolist()):
        docs.setdefault(k, set()).add(d)
    keys = np.array(sorted(k for k, d in docs.items() if len(d) > 1), np.uint64)
    if not len(keys):
        return set()
    start, count, _, doc = suffix._left(found, keys, ranges, bits)
    return {(d, w - int(bounds[d])) for s, c, d in zip(start.tolist(), count.tolist(), doc.tolist()) for w in range(s, s + c)}


def test_strings_that_share_an_anchor_by_chance_are_left_out():
    draw = np.random.default_rng(5)
    phrase = b"a phrase that recurs by chance"
    texts = [bytes(draw.integers(97, 123, 400, dtype=np.uint8)) + phrase + bytes(draw.integers(97, 123, 400, dtype=np.uint8)) for _ in range(200)]
    runs = suffix.anchor_runs(np.frombuffer(b"".join(texts), np.uint8), np.arange(len(texts) + 1) * len(texts[0]), 40)
    docs = {}
    for a, d in zip(runs[2].tolist(), runs[3].tolist()):
        docs.setdefault(a, set()).add(d)
    assert sum(n for a, n in zip(runs[2].tolist(), runs[1].tolist()) if len(docs[a]) > 1) > 1000  # by anchors alone
    assert not _left_windows(texts)


def test_no_repeated_window_is_left_out():
    draw = np.random.default_rng(6)
    for turn in range(300):
        letters = int(draw.integers(1, 5)) if turn % 2 else 26
        pool = [bytes(draw.integers(97, 97 + letters, draw.integers(1, 120), dtype=np.uint8)) for _ in range(6)]
        pool += [b"ab" * 40, b"abcdefghijklmnopqrs" * 6, b"x" * 90]
        texts = [b"".join(pool[i] for i in draw.integers(0, len(pool), draw.integers(0, 8))) for _ in range(int(draw.integers(1, 8)))]
        docs = {}
        for d, t in enumerate(texts):
            for w in range(len(t) - suffix.LENGTH + 1):
                docs.setdefault(t[w : w + suffix.LENGTH], []).append((d, w))
        needed = {x for places in docs.values() if len({d for d, _ in places}) > 1 for x in places}
        assert needed <= _left_windows(texts)
