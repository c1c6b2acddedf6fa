"""Training-data operators against brute force on small fixtures, and their defined edge cases."""

import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from loomspan.llm import ann, bpe, chat, decontaminate, langid, licenses, simhash, suffix, toxicity, warc
from loomspan.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs_frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    out += [out[3], out[3] + " more", None, "", "   ", out[5][:200] + "\n" + out[6], "x" * 5000, "　\x00 \x1c", out[7].upper()]
    return out


def test_connected_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)]
    pairs += [(i, i + 1) for i in range(2000, 2060)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(pairs, "u long, v long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    for n in {x for p in pairs if p[0] != p[1] for x in p}:
        assert got[n] == find(n)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split() if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 4)
    base = " ".join(f"w{i}" for i in range(400))
    near = [base.replace(f"w{k} ", f"v{k} ") for k in range(3, 60)]
    every = texts + [base, *near]
    want = [plain_simhash(t) for t in every]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_frame(spark, every)).collect()}
    assert [int(got[i]["fingerprint"], 16) for i in range(len(every))] == want
    label = list(range(len(every)))
    for _ in range(len(every)):
        for i, a in enumerate(want):
            for j, b in enumerate(want[:i]):
                if bin(a ^ b).count("1") <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i]["component_id"] for i in range(len(every))] == label
    kept = simhash.drop_near_duplicates(docs_frame(spark, every))
    assert kept.columns == docs_frame(spark, ["a"]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in enumerate(label) if i == x]


def plain_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 0])
def test_suffix_matches_brute_force(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(suffix, "HOT", hot)
    passage = "the passage that many documents share, word by word, without any change at all. "
    every = texts + [t[:40] + passage * (1 + i % 3) + t[:90] for i, t in enumerate(texts) if t] + ["ab" * 200, "ba" * 150]
    df = docs_frame(spark, every).repartition(3)
    got = sorted(tuple(r) for r in suffix.measure(df).collect())
    assert got == plain_repeats(list(enumerate(every)))
    cut = {r["doc_id"]: r for r in suffix.drop_repeats(df).collect()}
    assert len(cut) == len(every) and cut[0]["text"] == every[0] and cut[0]["source"] == "s"
    assert cut[texts.index(None)]["text"] is None


def test_bpe_matches_tiktoken(spark, texts):
    ranks = bpe.load_ranks(spark, RANKS)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab'sé1 \n\t\x85.\x00") for _ in range(60)) for _ in range(80)] + ["ab" * 3000, "it's <|endoftext|>"]
    every = texts + odd
    got = {r["doc_id"]: r for r in bpe.digests(docs_frame(spark, every), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(every):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN, memory=10)
    assert [len(x) // 4 for x in small.encode_batch([t or "" for t in every])] == [got[i]["n_tokens"] for i in range(len(every))]


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ba", "do", "ki"], "bb": ["schen", "ü", "ver"], "cc": ["ción", "la", "ñ"]}
    rows = [(i, speech(rng, kinds[k], 30), k, None) for i, k in enumerate(list(kinds) * 40)]
    rows += [(900, None, "aa", None), (901, "123 ...", "bb", None), (902, "", "cc", None), (903, "ba do", None, None), (None, "la ñ la", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == lang for i, _, lang, _ in rows[:120])
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    nothing = langid.identify(df.where("lang = 'none'"))
    assert nothing.count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("1 = 0").unionByName(df.where("doc_id = 903"))).collect()} == {"und"}


def test_language_code_lengths(spark):
    texts = ["abracadabra", "abra", "cadabra zz"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.learn(df)
    bits, _ = model.bits(pa.array(texts))
    count = defaultdict(lambda: defaultdict(int))
    for t in texts:
        framed = b"\n\n\n" + t.encode()
        for k in range(3, len(framed)):
            for o in range(4):
                count[framed[k - o : k]][framed[k]] += 1

    top = {b for b, _ in sorted(count[b""].items(), key=lambda e: -e[1])}

    def cost(context, b):
        if b not in top:
            raise AssertionError
        seen = count.get(context)
        if not seen:
            return cost(context[1:], b)
        n, t = sum(seen.values()), len(seen)
        return np.log2(n + t) - np.log2(seen[b]) if b in seen else np.log2(n + t) - np.log2(t) + cost(context[1:], b)

    for t, got in zip(texts, bits[:, 0]):
        framed = b"\n\n\n" + t.encode()
        assert got == pytest.approx(sum(cost(framed[k - 3 : k], framed[k]) for k in range(3, len(framed))), rel=1e-5)


def test_toxicity(spark):
    rng = random.Random(8)
    clean = [speech(rng, ["th", "er", "on", "in"], 60) for _ in range(300)]
    foul = [speech(rng, ["th", "er", "on", "in"], 30) + f" zargnu{rng.choice('abcdef')} " + speech(rng, ["th", "er"], 20) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(clean + foul)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(380)] + [(2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.rate(df, labels).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(got[i]["predicted"] == int(i >= 300) for i in range(380))
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    assert {r["doc_id"] for r in toxicity.drop_toxic(df, labels).collect()} == {*range(300), 900, 901}
    assert toxicity.rate(df.limit(0), labels).count() == 0
    assert toxicity.rate(df, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_grammar():
    grammar = toxicity.Grammar({})
    plain, negated, reported = (grammar.score(t) for t in ("You are an idiot.", "You are not an idiot.", "He wrote of an idiot."))
    assert plain > reported > 0 and plain > negated
    assert grammar.score("I will kill you.") > grammar.score("You kill time.")
    assert grammar.score("It is fine.") == grammar.score(None) < 0.5


def test_decontamination(spark):
    rng = random.Random(3)
    syllables = ["th", "er", "on", "in", "ea", "st", "wh"]
    items = [(i, speech(rng, syllables, rng.randint(15, 50))) for i in range(40)] + [(98, None), (99, "zig zag zog zug zeg")]
    background = [speech(rng, syllables, 80) for _ in range(200)]
    rows, near = [], set()
    for k in range(200):
        item, text = items[k % 40]
        words = [w for w in text.split() if rng.random() > 0.08]
        planted = text if k % 2 else " ".join(words)
        whole = background[k] + " " + planted.upper() + "\n" + background[k - 1] if k < 150 else background[k]
        rows.append((k, whole))
        if k < 150 and decontaminate.edit_distance_within(decontaminate._plain(text), decontaminate._plain(planted)) <= 0.2 * len(text):
            near.add((k, item))
    rows += [(500, None), (501, ""), (502, "a zig zag  zog zug zeg b"), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(pairs & near) >= 0.95 * len(near) and (502, 99) in pairs
    assert pairs - near == {(502, 99)} and len(pairs) == len(got)
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {i for i, _ in rows} - {d for d, _ in pairs}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(2))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, d in enumerate(p, 1):
                new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (d != c)))
            row, best = new, min(best, new[-1])
        assert decontaminate.edit_distance_within(p, t) == best


def test_licenses(spark):
    notice = licenses.TEMPLATES["apache-2.0-notice"]
    rows = [
        (1, "Text. Released under the MIT License."), (2, "nothing here"), (3, None), (4, ""),
        (5, "intro words " + notice.replace("governing", "about") + " tail"), (6, notice[: len(notice) // 2]), (1, "Released under the MIT license"),
    ]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-line"), (5, "apache-2.0-line"), (5, "apache-2.0-notice"), (6, "apache-2.0-line")}


def test_chat(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad <|im_end|>"),
        (2, 0, "user", "zz"), (2, 0, "user", "zz"), (2, None, None, None), (None, 0, "user", "lost"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["chosen_id"]: r for r in chat.format_preferences(chat.pair_neighbours(chat.conversations(df))).collect()}
    pair = next(r for r in got.values() if r["rejected_id"] is not None and {r["chosen_id"], r["rejected_id"]} == {0, 1}) if 0 in got and got[0]["rejected_id"] == 1 else None
    if pair is None:  # conversation 2 starts with an empty text and comes first
        assert got[2]["rejected_id"] == 0 and got[2]["n_common"] == 0 and got[1]["rejected"] is None
        made = chat.format_preferences(
            chat.conversations(df.where("conv_id = 0")).withColumnsRenamed({"conv_id": "chosen_id", "turns": "chosen"}).crossJoin(
                chat.conversations(df.where("conv_id = 1")).withColumnsRenamed({"conv_id": "rejected_id", "turns": "rejected"})
            )
        ).first()
    else:
        made = pair
    assert made["n_common"] == 1 and made["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert made["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n" and "< |im_end|>" in made["rejected"]
    head, tail = (x.split(":") for x in made["chosen_mask"].split(","))
    assert (head[0], tail[0]) == ("0", "1") and int(head[1]) + int(tail[1]) == len(made["chosen"])


def test_warc(spark, tmp_path):
    big, url = "<p>é</p>" * 40, "http://a/\r\nb"
    rows = [(5, url, big), (2, url, big), (9, None, big), (3, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (2, url, big), (None, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append(r)
    assert len(got) == len(rows)
    assert [r["record_type"] for r in by_id[2]] == ["response"] * 2 and by_id[5][0]["refers_to"] == by_id[9][0]["refers_to"] == by_id[None][0]["refers_to"] == 2
    assert by_id[4][0]["record_type"] == "response" and by_id[6][0]["payload_bytes"] == 0
    for i, _, html in rows:
        assert by_id[i][0]["payload_digest"] == hashlib.sha256((html or "").encode()).hexdigest() and by_id[i][0]["payload_bytes"] == len((html or "").encode())
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    count = sum(len(list(warc.records(gzip.decompress(p.read_bytes())))) for p in (tmp_path / "w").glob("*.gz"))
    assert count == len(rows)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_neighbours_exact_with_one_partition(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 8))
    x[10:60] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 50 = 0")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = np.array([(a * x[q]).sum() / (np.sqrt((a * a).sum()) * np.sqrt((x[q] ** 2).sum())) for a in x])
        order = [i for i in np.lexsort((np.arange(120), -s)) if i != q][:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == order and np.allclose(own.score, s[order], atol=1e-12)
    assert len(got) == 15 and len(u) == 120
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 50 = 0")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(60), np.arange(0, 3000, 50)] = -2
    want = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(set(w) & set(got[got.query_id == 50 * i].vec_id)) for i, w in enumerate(want))
    assert hits >= 0.9 * 300


def test_neighbours_prune_clusters_and_keep_their_recall(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((400, 32))
    x = (centre[rng.integers(0, 400, 12000)] + 0.25 * rng.standard_normal((12000, 32))).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    router = ann.fit(df)
    assert router.probes <= router.parts / 2  # the share of the table that a query is compared with
    got = ann.search(df, df.where("vec_id % 50 = 0"), router=router).toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u[::50] @ u.T
    near[np.arange(240), np.arange(0, 12000, 50)] = -2
    want = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(set(w) & set(got[got.query_id == 50 * i].vec_id)) for i, w in enumerate(want))
    assert hits >= 0.9 * 1200 and len(got) == 1200


def test_neighbours_copies_scales_and_other_columns(spark):
    rows = [(i, [1.0, 2.0, 3.0], "a") for i in range(300)] + [(0, [1.0, 2.0, 3.0], "again")] * 7
    rows += [(400, [2.0**600, 2.0**601, 3 * 2.0**600], "b"), (401, [2.0**-600, 2.0**-599, 3 * 2.0**-600], "c"), (50, [9.0, 0.0, 0.0], "second vector")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, _place string")
    got = ann.search(df, df.where("vec_id in (0, 50, 400)"))
    by = {q: [r["vec_id"] for r in sorted(got.where(f"query_id = {q}").collect(), key=lambda r: r["rank"])] for q in (0, 50, 400)}
    assert by == {0: [1, 2, 3, 4, 5], 50: [0, 0, 0, 0, 0], 400: [0, 0, 0, 0, 0]}
    assert all(abs(r["score"] - 1) < 1e-12 for r in got.collect())


def test_chat_edges(spark):
    kind = "array<struct<turn:long,role:string,text:string>>"
    pairs = spark.createDataFrame(
        [(1, [], 2, [(0, "user", "hi")]), (3, [(0, "user", "hi")], 4, []), (5, [], 6, []), (7, [(0, "assistant", "a" * 200_000)], None, None)],
        f"chosen_id long, chosen {kind}, rejected_id long, rejected {kind}",
    )
    got = {r["chosen_id"]: r for r in chat.format_preferences(pairs).collect()}
    assert all(r["n_common"] == 0 and r["prompt"] == "" for r in got.values())
    assert got[1]["chosen"] == "" and got[3]["rejected"] == "" and got[7]["rejected"] is None and len(got[7]["chosen"]) > 200_000
    convs = pairs.select(pairs.chosen_id.alias("conv_id"), pairs.chosen.alias("turns"))
    assert chat.format_preferences(chat.pair_neighbours(convs)).count() == 2
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, chosen string")
    assert chat.format_preferences(chat.pair_neighbours(chat.conversations(none))).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "hi", "x", 9), (1, 1, "assistant", "yo", "x", 9)], "conv_id long, turn long, role string, text string, chosen string, _block int")
    assert chat.format_preferences(chat.pair_neighbours(chat.conversations(clash))).first()["n_common"] == 0


def test_warc_dates_columns_and_large_payloads(spark, tmp_path):
    import datetime

    rows = [(1, "u", "x" * 3_000_000, "d"), (2, "u", "x" * 3_000_000, "e"), (3, "v", "short", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        warc.write_archives(df, str(tmp_path / "w"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    now, seen = datetime.datetime.now(datetime.timezone.utc), 0
    for p in (tmp_path / "w").glob("*.gz"):
        with gzip.open(p) as archive:
            for fields, _ in warc.records(archive):
                date = datetime.datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=datetime.timezone.utc)
                assert abs((now - date).total_seconds()) < 600
                seen += 1
    assert seen == 3
    got = {r["page_id"]: r for r in warc.archive(df).collect()}
    assert got[2]["refers_to"] == 1 and got[1]["payload_bytes"] == 3_000_000


def test_simhash_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "a b c", "z"), (None, "a b c", "n"), (3, None, "q"), (4, "", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["_row"]) for r in kept.collect()))
    assert [(a, b) for a, b, _ in got] == [(False, 1), (False, 3), (True, 0)] and got[0][2] in "xy" and got[2][2] == "n"
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.drop_near_duplicates(df.limit(0)).count()


def test_suffix_edges(spark):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(70_000))
    rows = [(1, long, "p"), (2, long[100:400], "p"), (2, long[100:400], "p"), (None, long[:90], "p"), (7, "z" * 9_000, "p"), (8, "z" * 100, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix.measure(df).collect())
    assert got == [(False, 1, 0), (False, 2, 300), (False, 2, 300), (False, 7, 0), (False, 8, 100), (True, 0, 90)]
    assert suffix.drop_repeats(df).columns == df.columns
    assert suffix.measure(df.limit(0)).count() == 0


def test_toxicity_clauses():
    score = toxicity.Grammar({}).score
    plain, none = score("You are an idiot."), score(None)
    for text in ("He said: you are an idiot.", "You are an idiot, he said.", "“You are an idiot,” she wrote.", "You aren't an idiot.", "You aren’t an idiot."):
        assert none < score(text) < plain / 2
    assert score("You are an 'idiot'.") == plain == score("YOU ARE AN IDIOT!")
    assert score("I'll kill you.") == score("I’ll kill you.") == score("I will kill you.") > 2 * score("I won't kill you.")
    assert score("They will burn the trash and you can beat the eggs.") < 0.5 * score("You are trash.")
    assert score("You kill time.") == none and score("word " * 50_000) == none < score("word " * 50_000 + "you idiot")


def test_toxicity_rows(spark):
    rows = [(1, "you idiot", "a"), (1, "you idiot", "a"), (None, "fine", "b"), (2, "fine", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.rate(df, labels).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity.drop_toxic(df, labels).columns == df.columns
