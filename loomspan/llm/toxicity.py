"""Toxicity by a weighted finite-state pattern grammar.

Small transducers read the words of a clause. Insults emit weight where they stand; a threat emits it when the target it
is aimed at follows within ``OBJECT`` words and an intent came before. Negations reach ``REACH`` words on. A report holds
for what follows it, colons and quotation marks included, and a report tag after a comma or a closing quotation mark
("..., he said") holds for what came before. An insult word that also has a plain use counts in full only within
``NEAR`` words after a target. The product of these transducers is built once, as a table of (state, tag) -> (state, kind
of weight), and every clause that holds an insult or threat word runs through it. So what is scored is the clause: the
same word counts apart when it is plain, negated, reported, or aimed at somebody. Clauses without an insult or threat word
cannot emit and are passed over. Typographic apostrophes and quotation marks are read as plain ones, contractions as the
words they stand for.

Which words insult or threaten comes from two places: fixed word classes below, and labelled documents, from which words
and word beginnings (``STEMS`` letters) are taken whose documents are toxic by a wide margin. A word's weight is the log
odds of that share. A logistic layer then weighs the kinds of emitted weight; it is fitted on the same bounded sample of
``SAMPLE`` labelled rows, those of least hash, and held near its prior where the sample says nothing.

Defined cases: a null or empty text has the score of a text without any match, below 0.5; very long texts are read whole,
clause by clause; no labels or one class only leaves the fixed classes with prior weights; a doc_id with several labels
is toxic if any says so; repeated rows keep their rows; an empty table gives an empty result; other columns are ignored
by ``rate`` and pass through ``drop_toxic``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, tidy
from .langid import held_out

#: Labelled rows that words and weights are learned from.
SAMPLE = 20_000
STEMS = (4, 5, 6)
#: Share of toxic documents (after smoothing) from which a word or beginning counts, and least such documents.
SHARE, LEAST, SMOOTH = 0.7, 3, 3.0

INSULT = "idiot idiots moron morons stupid loser losers pathetic worthless disgusting idiota estúpido imbécil idiote stupide imbécile dumm blöd dummkopf".split()
#: Insult words that also have a plain use.
PLAIN = "trash clown dumb fool scum".split()
THREAT = "kill hurt destroy beat stab shoot burn matar golpear tuer frapper töten schlagen".split()
INTENT = "will gonna shall going werde wirst vais voy".split()
TARGET = "you your you're u they them he she him her du dich dir ihr sie tu te ti toi vous tú usted ustedes él ella".split()
NEGATION = "not no never cannot nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTED = "said says wrote writes called calls claims reported quoted according sagte sagt schrieb dit disait écrit dijo dice escribió según selon laut".split()

TAGS = ("other", "insult", "plain insult", "threat", "intent", "target", "negation", "report", "break")
KINDS = ("insult", "insult negated", "insult reported", "threat", "threat negated or reported", "aimed", "plain use")
PRIOR = np.array([1.0, 0.1, 0.4, 0.8, 0.1, 0.5, 0.1])
BIAS = -2.5
#: Words that a negation reaches, within which a threat's target follows, a target comes before, and a late report ends.
REACH, OBJECT, NEAR, LATE = 3, 2, 3, 4
WEIGHT = 2.0

_WORD = regex.compile(r"\p{L}+(?:'\p{L}+)*")
_TOKEN = regex.compile(r"\p{L}+(?:'\p{L}+)*|[,\"]")
_CLAUSE = regex.compile(r"[^.!?;\n]+")
_MARKS = str.maketrans("’‘ʼ´`“”„«»‹›", 5 * "'" + 7 * '"')
_ENDINGS = {"ll": "will", "re": "", "ve": "", "d": "", "m": "", "s": ""}


def _words(text: str) -> list[str]:
    """Words and breaks of a clause, with contractions as the words they stand for."""
    out = []
    for word in _TOKEN.findall(text):
        head, _, tail = word.rpartition("'")
        if word.endswith("n't"):
            out += [word[:-3], "not"] if word[:-3] else ["not"]
        elif head and tail in _ENDINGS:
            out += [head, _ENDINGS[tail]] if _ENDINGS[tail] else [head]
        else:
            out.append(word)
    return out


def _negation(state: int, tag: str) -> int:
    return REACH if tag == "negation" else state if tag == "break" else max(0, state - 1)


def _report(state: int, tag: str) -> int:
    return 1 if tag == "report" else state


def _intent(state: int, tag: str) -> int:
    return 1 if tag == "intent" else state


def _target(state: int, tag: str) -> int:
    return 1 if tag == "target" else state


def _near(state: int, tag: str) -> int:
    """Words that are left of the reach of the last target."""
    return NEAR if tag == "target" else state if tag == "break" else max(0, state - 1)


def _late(state: int, tag: str) -> int:
    """0: no break yet, or too long ago; up to LATE: words since the last one; LATE + 1: a report came soon after it."""
    if tag == "break":
        return 1
    if state == 0 or state == LATE + 1:
        return state
    return LATE + 1 if tag == "report" else (state + 1) % (LATE + 1)


def compose() -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """The product of the transducers: start state 0, next state and kind of emission (-1: none) by state and tag.

    The last component waits for a threat's target: words that are left, twice over for threats that do not count.
    """
    parts = ((_negation, REACH + 1), (_report, 2), (_intent, 2), (_target, 2), (_near, NEAR + 1), (_late, LATE + 2))
    states = list(product(*(range(n) for _, n in parts), range(2 * OBJECT + 1)))
    number = {s: i for i, s in enumerate(states)}
    step, emit = [], []
    for state in states:
        nexts, kinds = [], []
        negated, reported, intent, _, near, _, waits = state
        for tag in TAGS:
            kind, then = -1, waits if tag == "break" or waits in (0, OBJECT) else waits - 1
            if waits == OBJECT and tag != "break":
                then = OBJECT - 1
            if waits == OBJECT + 1 and tag != "break":
                then = 0
            if tag == "insult" or tag == "plain insult" and near:
                kind = 1 if negated else 2 if reported else 0
            elif tag == "plain insult":
                kind = 6
            elif tag == "threat" and intent:
                then = 2 * OBJECT if negated or reported else OBJECT
            elif tag == "target" and waits:
                kind, then = 3 if waits <= OBJECT else 4, 0
            kinds.append(kind)
            nexts.append(number[(*(f(x, tag) for (f, _), x in zip(parts, state)), then)])
        step.append(nexts)
        emit.append(kinds)
    return np.array(states), step, emit


_STATES, _STEP, _EMIT = compose()
_FIXED = {w: t for t, words in (("insult", INSULT), ("plain insult", PLAIN), ("threat", THREAT), ("intent", INTENT), ("target", TARGET), ("negation", NEGATION), ("report", REPORTED)) for w in words}
_EMITS = frozenset(TAGS.index(t) for t in ("insult", "plain insult", "threat"))
_TARGET_TAG, _BREAK = TAGS.index("target"), (TAGS.index("break"), 0.0)


class Grammar:
    """Word classes with weights, and the weights of the kinds of emission."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned
        self.weights, self.bias = PRIOR.copy(), BIAS
        self.tags: dict[str, tuple[int, float]] = {}

    def tag(self, word: str) -> tuple[int, float]:
        """(tag, weight) of a word: a learned word or beginning, else a fixed class."""
        found = self.tags.get(word)
        if found is None:
            if word in (",", '"'):
                return _BREAK
            weight = max([self.learned.get(word, 0.0), *(self.learned.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n)])
            fixed = _FIXED.get(word, "other")
            if weight > 0 and fixed in ("other", "insult", "plain insult"):
                found = TAGS.index("insult"), weight
            else:
                found = TAGS.index(fixed), WEIGHT if fixed in ("insult", "plain insult", "target") else 0.0
            if len(self.tags) > 200_000:
                self.tags.clear()
            self.tags[word] = found
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Emitted weight by kind, over all clauses of the text."""
        out = np.zeros(len(KINDS))
        lower = (text or "").lower().translate(_MARKS)
        tags = self.tags
        emitting = [w for w in set(_WORD.findall(lower)) if (tags.get(w) or self.tag(w))[0] in _EMITS or "'" in w and any(self.tag(x)[0] in _EMITS for x in _words(w))]
        if not emitting:
            return out
        for clause in _CLAUSE.findall(lower):
            if not any(w in clause for w in emitting):
                continue
            state, gained = 0, np.zeros(len(KINDS))
            for word in _words(clause):
                tag, weight = self.tag(word)
                kind = _EMIT[state][tag]
                if kind >= 0:
                    gained[kind] += weight
                state = _STEP[state][tag]
            if _STATES[state][5] == LATE + 1:  # a late report covers what came before it
                gained[2], gained[4] = gained[2] + gained[0], gained[4] + gained[3]
                gained[0] = gained[3] = 0.0
            if _STATES[state][3]:
                gained[5] = gained[0] + gained[3]
            out += gained
        return np.log1p(out)

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.bias + self.features(text) @ self.weights))))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 200, hold: float = 2.0) -> None:
        """Newton steps for the logistic layer, tied to the prior by ``hold`` pseudo-observations a weight."""
        prior = np.append(PRIOR, BIAS)
        design, w = np.column_stack([x, np.ones(len(x))]), prior.copy()
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (p - y) + hold * (w - prior)
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + hold * np.eye(len(w)), grad)
            w -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.bias = w[:-1], float(w[-1])


def _learning(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of the sampled labelled rows; the sample of ids is bounded, so it may be broadcast."""
    own = (
        labels.where("doc_id is not null and toxic is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(~held_out(5, 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    return texts.join(F.broadcast(own), "doc_id").select("text", "toxic")


def _telling(rows: DataFrame, base: float, known: frozenset[str]) -> dict[str, float]:
    """Words whose documents are toxic by a wide margin, with log odds; with ``known`` words, beginnings of all others.

    Beginnings are counted without known words, so that one such word does not lend its weight to all that start alike.
    """

    def features(text: str) -> set[str]:
        own = set(_WORD.findall(text.lower().translate(_MARKS)))
        return own if not known else {w[:n] + "*" for w in own - known for n in STEMS if len(w) >= n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic > 0].update(features(text))
            every = list(seen[0] | seen[1])
            columns = [pa.array(every, pa.string()), *(pa.array([c[w] for w in every], pa.int64()) for c in (seen[1], seen[0]))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "bad", "good"])

    share = (F.col("bad") + SMOOTH * base) / (F.col("bad") + F.col("good") + SMOOTH)
    chosen = (
        rows.mapInArrow(tidy(run), "word string, bad long, good long")
        .groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= LEAST).withColumn("share", share).where(F.col("share") >= SHARE)
        .select("word", "share").collect()  # bounded by the words of the sample
    )
    return {r["word"]: float(np.log(r["share"] / (1 - r["share"])) + 2.0) for r in chosen}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Word classes and weights from labelled documents outside the fold crc32(doc_id) mod 5 = 0."""
    small_batches(docs.sparkSession)
    rows = cut(_learning(docs, labels, sample))

    by_class = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad_n, good_n = by_class.get(1, 0), by_class.get(0, 0)
    if not bad_n or not good_n:
        return Grammar({})
    base = bad_n / (bad_n + good_n)
    whole = _telling(rows, base, frozenset())
    grammar = Grammar(whole | _telling(rows, base, frozenset(whole) | {""}))
    shared = rows.sparkSession.sparkContext.broadcast(grammar.learned)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(shared.value)
        for batch in batches:
            x = np.array([own.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array((batch.column("toxic").to_numpy() > 0).astype(float)), *(pa.array(c) for c in x.T)],
                ["y", *(f"x{i}" for i in range(len(KINDS)))],
            )

    schema = ", ".join(["y double", *(f"x{i} double" for i in range(len(KINDS)))])
    got = rows.mapInArrow(tidy(emitted), schema).toArrow()  # bounded: ``sample`` rows of a few numbers
    table = np.column_stack([c.to_numpy() for c in got.columns]) if len(got) else np.zeros((0, 1 + len(KINDS)))
    if len(table):
        order = np.lexsort(table.T)
        grammar.fit(table[order, 1:], table[order, 0])
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.learned, grammar.weights, grammar.bias))
    name = "toxicity"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, weights, bias = shared.value
        own = Grammar(learned)
        own.weights, own.bias = weights, bias
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], name])

    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(tidy(run), "doc_id long, toxicity double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rated = score(docs, learn(docs, labels))
    return rated.select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns, order and types kept."""
    grammar = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((grammar.learned, grammar.weights, grammar.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, weights, bias = shared.value
        own = Grammar(learned)
        own.weights, own.bias = weights, bias
        for batch in batches:
            texts = batch.column("text")
            yield batch.filter(pa.array([own.score(t.as_py()) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
