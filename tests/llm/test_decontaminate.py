"""Recall of benchmark decontamination for letter edits, against the exact edit distance."""

import random

import pyarrow as pa
import pytest

from loomspan.llm import decontaminate

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "in", "ea", "st", "wh", "al"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, share, kind):
    out = list(text)
    for at in sorted(rng.sample(range(len(out)), int(share * len(out))), reverse=True):
        how = rng.choice("rid") if kind == "mixed" else kind
        out[at : at + 1] = {"r": [rng.choice(LETTERS)], "i": [out[at], rng.choice(LETTERS)], "d": []}[how]
    return "".join(out)


@pytest.mark.parametrize("kind", ["r", "i", "d", "mixed"])
@pytest.mark.parametrize("words", [8, 20, 80])
def test_letter_edits_are_found(kind, words):
    rng = random.Random(f"{kind}{words}")
    texts = [prose(rng, words) for _ in range(12)]
    items = decontaminate.Items(list(enumerate(texts)))
    docs, near = [], set()
    for n in range(48):
        planted = edited(rng, texts[n % 12], (0.1, 0.14, 0.19)[n % 3], kind)
        if decontaminate.edit_distance_within(texts[n % 12], planted) <= 0.2 * len(texts[n % 12]):
            near.add((n, n % 12))
        docs.append(f"{prose(rng, 20)} {planted} {prose(rng, 20)}")
    found = {(d, i) for d, i, *_ in decontaminate.matches(items, pa.array(docs + ["", None]))}
    assert len(near) > 20 and len(found & near) >= 0.95 * len(near)


def spread(rng, text, step):
    out = list(text)
    for at in range(step - 1, len(out), step):
        out[at] = rng.choice(LETTERS)
    return "".join(out)


def misspelt(rng, text, step):
    words = text.split(" ")
    for k in range(0, len(words), step):
        at = rng.randrange(len(words[k]))
        words[k] = words[k][:at] + rng.choice(LETTERS) + words[k][at + 1 :]
    return " ".join(words)


@pytest.mark.parametrize("how", ["every 5th letter", "every 6th letter", "every word", "every 2nd word"])
def test_evenly_spread_edits_at_the_bound_are_found(how):
    rng = random.Random(how)
    texts = [prose(rng, rng.randint(14, 60)) for _ in range(60)]
    items = decontaminate.Items(list(enumerate(texts)))
    docs, near = [], set()
    for n, text in enumerate(texts):
        planted = spread(rng, text, int(how[6])) if "letter" in how else misspelt(rng, text, 2 if "2nd" in how else 1)
        if decontaminate.edit_distance_within(text, planted) <= 0.2 * len(text):
            near.add((n, n))
        docs.append(f"{prose(rng, 40)} {planted} {prose(rng, 40)}")
    found = {(d, i) for d, i, *_ in decontaminate.matches(items, pa.array(docs))}
    assert len(near) > 20 and len(found & near) >= 0.9 * len(near)


def test_every_pair_against_brute_force():
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(6, 40)) for _ in range(20)]
    texts.append(edited(rng, texts[0], 0.1, "mixed"))  # two items that are near each other
    docs = [prose(rng, 60) for _ in range(20)]
    for n in range(60):
        text = texts[n % 21]
        kind = n % 4
        words = text.split()
        if kind == 0:
            words = [w for w in words if rng.random() > 0.15]
        elif kind == 1:
            words = [w if rng.random() > 0.15 else prose(rng, 1) for w in words]
        elif kind == 2:
            words = [x for w in words for x in ([w] if rng.random() > 0.12 else [w, prose(rng, 1)])]
        planted = edited(rng, text, rng.uniform(0, 0.3), "mixed") if kind == 3 else " ".join(words)
        docs.append(f"{prose(rng, 30)}  {planted.upper()} {prose(rng, 30 if n % 5 else 3000)}")
    bound = lambda t: 0.2 * len(t) + 1e-9
    want = {}
    for d, doc in enumerate(docs):
        for i, text in enumerate(texts):
            distance = decontaminate.edit_distance_within(text, decontaminate._plain(doc))
            if distance <= bound(text):
                want[d, i] = distance
    items = decontaminate.Items(list(enumerate(texts)))
    got = {(d, i): x for d, i, x, _ in decontaminate.matches(items, pa.array(docs))}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) > 20
    assert all(x >= want[pair] for pair, x in got.items())


def test_many_distances_at_once():
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 300)))
        pattern = "".join(rng.choice("abcdé x") for _ in range(rng.choice([1, 63, 64, 65, 128, 200])))
        pairs.append((pattern, text[:40] + edited(rng, pattern, 0.1, "mixed") + text[40:] if rng.random() < 0.5 else text))
    got = decontaminate.edit_distances([p for p, _ in pairs], [t for _, t in pairs])
    assert got.tolist() == [decontaminate.edit_distance_within(p, t) for p, t in pairs]


def test_pairs_that_cannot_match_are_not_stepped(monkeypatch):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    pairs = []
    for _ in range(300):
        pattern = letters(rng.randrange(3, 200))
        edited = list(pattern)
        for _ in range(rng.randrange(len(pattern) // 4 + 1)):
            edited[rng.randrange(len(edited))] = rng.choice(["", "x", "yz"])
        pairs.append((pattern, letters(rng.randrange(50)) + "".join(edited) + letters(50)))
    ok = decontaminate.plausible([p for p, _ in pairs], [t for _, t in pairs])
    near = [decontaminate.edit_distance_within(p, t) <= 0.2 * len(p) for p, t in pairs]
    assert all(o or not n for o, n in zip(ok, near)) and 0 < sum(near) < len(pairs)
    assert not decontaminate.plausible(["abcdefgh" * 9], ["stuvwxyz" * 20])[0]


def test_small_batches_are_searched_together():
    texts = ["one two", None, "three" * 100, "", "four"] * 40
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    whole = list(decontaminate._gathered(batch.slice(at, 5) for at in range(0, len(texts), 5)))
    assert len(whole) == 1 and whole[0].equals(batch)
    some = list(decontaminate._gathered((batch.slice(at, 5) for at in range(0, len(texts), 5)), 6000))
    assert len(some) > 1 and pa.Table.from_batches(some).combine_chunks().equals(pa.Table.from_batches([batch]))
    assert not list(decontaminate._gathered(iter(())))


def test_pieces_of_a_batch_give_the_same_matches(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    rows = [(k, " ".join(word() for _ in range(20))) for k in range(5)]
    docs = [None if k % 7 == 3 else " ".join([word() for _ in range(30)] + [rows[k % 5][1]] * (k % 2)) for k in range(40)]
    items = decontaminate.Items(rows)
    want = sorted(decontaminate.matches(items, pa.array(docs)))
    monkeypatch.setattr(decontaminate, "_SOUGHT", 700)
    assert sorted(decontaminate.matches(items, pa.array(docs))) == want and len({d for d, *_ in want}) >= 16
