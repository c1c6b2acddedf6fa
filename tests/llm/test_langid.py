"""Language identification with many languages and with a rare one beside a dominant one."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from loomspan.llm import langid


def order_three(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.learn(df)


def test_order_three_holds_for_any_number_of_languages(spark):
    one = [(0, "abcdabcdabce", "l00")]
    rng = random.Random(2)
    other = [(i, "".join(rng.choice("abcde ") for _ in range(60)), f"l{i:02}") for i in range(1, 40)]
    alone, among = order_three(spark, one), order_three(spark, one + other)
    assert among.langs == sorted(f"l{i:02}" for i in range(40))
    texts = pa.array(["abcd", "abce", "zabcd", "", None])
    # the same bytes are known, so a language's code lengths do not depend on its neighbours
    a, _ = alone.bits(texts)
    b, _ = among.bits(texts)
    assert abs(a[:2, 0] - b[:2, 0]).max() < 1e-4
    assert b.shape == (5, 40) and b[0].argmin() == 0


def test_a_rare_language_keeps_its_strings(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    often = [(i, "".join(rng.choice(letters) for _ in range(4000)), "often") for i in range(100)]
    model = order_three(spark, [*often, (1000, "qzqxqzqxqj", "rare")])
    part, place = model.parts[0], model.langs.index("rare")
    assert len(part.cells) > 250_000
    bits, _ = model.bits(pa.array(["qzqx"]))
    # contexts of the frame and of "qzq" were seen in the rare language: no byte of the text costs more than an escape
    assert bits[0, place] < bits[0, 1 - place] and bits[0, place] < 8


def test_twelve_scripts_against_brute_force(spark):
    rng = random.Random(7)
    firsts = [97, 225, 0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x1200, 0x3042, 0x4E00]
    text = lambda first, n: "".join(" " if rng.random() < 0.2 else chr(first + rng.randrange(20)) for _ in range(n))
    rows = [(100 * k + i, text(first, 60), f"l{k:02}") for k, first in enumerate(firsts) for i in range(6)]
    model = order_three(spark, rows)
    seen = defaultdict(Counter)
    for _, t, lang in rows:
        framed = b"\n\n\n" + t.encode()
        for at in range(3, len(framed)):
            for order in range(4):
                seen[lang, framed[at - order : at]][framed[at]] += 1

    def cost(lang, context, byte):
        own = seen.get((lang, context))
        below = (lambda: cost(lang, context[1:], byte)) if context else (lambda: 8.0)
        if not own:
            return below()
        n, t = sum(own.values()), len(own)
        return math.log2(n + t) - math.log2(own[byte]) if byte in own else math.log2(n + t) - math.log2(t) + below()

    probes = [text(first, 30) for first in firsts] + ["x", "a\u03b1\u0430"]
    bits, size = model.bits(pa.array(probes))
    for t, own in zip(probes, bits):
        framed = b"\n\n\n" + t.encode()
        want = [sum(cost(lang, framed[at - 3 : at], framed[at]) for at in range(3, len(framed))) for lang in model.langs]
        assert np.allclose(own, want, rtol=1e-4)
    assert bits[:12].argmin(1).tolist() == list(range(12)) and size.tolist() == [len(t.encode()) for t in probes]


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "abab abab", "x", "p", 0.5), (1, "abab abab", "x", "p", 0.5), (None, "abab", "x", "p", 0.5), (2, "cdcd " * 40_000, "y", "q", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == 4 and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    assert langid.identify(df.limit(0)).count() == 0


def test_index_finds_places():
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 5000))
    index = langid.Index(codes)
    assert (index.find(codes) == np.arange(len(codes))).all()
    other = np.setdiff1d(np.arange(3000), codes)
    assert (index.find(other) == -1).all() and (langid.Index(codes[:0]).find(codes) == -1).all()
