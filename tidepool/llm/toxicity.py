"""Toxicity by a weighted lexicon, matched after folding look-alike characters.

The lexicon is learned: words and word beginnings that occur in toxic texts far
more often than chance allows. All terms are matched at once by an automaton
(Aho and Corasick) over folded text; a match inside an exception phrase does
not count. The weights of the matches, per hundred words, give the score.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import storage
from tidepool.llm import words as W

# Characters that are read as others. l, 1 and | look like i.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i", "|": "i"}
CYRILLIC = dict(zip("аверсухіјѕԁһո", "abepcyxijsdhn"))
GREEK = dict(zip("αβεικνοργτυχ", "abeikvopytux"))
CYRILLIC |= {"о": "o", "к": "k", "м": "m", "т": "t", "н": "h"}
UNSEEN = "­​‌‍⁠﻿"
# Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "circus clown", "sore loser bracket")

# Texts with a term are toxic at least this often.
PURE = 0.85
# Word beginnings of these lengths may become terms.
STEMS = range(3, 9)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane: what it folds to (0: nothing), and whether words have it."""
    to = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        low = chr(i).lower() if not 0xD800 <= i < 0xE000 else ""
        if len(low) == 1:
            to[i] = ord(low)
    to[0xFF01:0xFF5F] = to[0x21:0x7F]  # full-width forms
    for a, b in {**DIGITS, **CYRILLIC, **GREEK}.items():
        to[ord(a)] = ord(b)
    to = np.where(to < (1 << 16), to[np.minimum(to, (1 << 16) - 1)], to)
    to[[ord(c) for c in UNSEEN]] = 0
    word = np.array([not 0xD800 <= i < 0xE000 and chr(i).isalnum() for i in range(1 << 16)])
    return to, word


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    return _tables()


def fold(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of folded texts, each followed by a line break."""
    to, _ = tables()
    data, offsets = W.flat(column)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    edge = W.bounds((data & 0xC0) != 0x80)[offsets]
    low = points < (1 << 16)
    folded = np.where(low, to[np.where(low, points, 0)], points)
    seen = folded != 0
    edge = W.bounds(seen)[edge]
    out = np.insert(folded[seen], edge[1:], 0x0A)
    return out, edge + np.arange(len(edge))


def fold_text(text: str) -> str:
    points, _ = fold(pa.array([text]))
    return points[:-1].astype("<u4").tobytes().decode("utf-32-le")


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms; a term that ends in ``$`` is a whole word, others begin words."""

    weights: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        entries: dict[str, list[tuple[float, bool]]] = {}
        for term, weight in self.weights:
            entries.setdefault(term.rstrip("$"), []).append((weight, term.endswith("$")))
        for phrase in self.exceptions:
            entries.setdefault(phrase, [])
        spared = set(self.exceptions)
        for key, found in entries.items():
            machine.add_word(key, (len(key), found, key in spared))
        machine.make_automaton()
        return machine


def measure(column: pa.Array, lexicon: Lexicon, machine=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words, counted matches, and the sum of their weights."""
    _, word = tables()
    points, edge = fold(column)
    inside = np.where(points < (1 << 16), word[np.minimum(points, (1 << 16) - 1)], False)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    n = len(edge) - 1
    words = np.diff(W.bounds(start)[edge])
    hits, weight = np.zeros(n, np.int64), np.zeros(n)
    machine = machine or lexicon.automaton()
    if not len(machine):
        return words, hits, weight
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    found, spared = [], []
    for end, (size, terms, harmless) in machine.iter(text):
        begin = end - size + 1
        if not start[begin]:
            continue
        closed = end + 1 == len(text) or not inside[end + 1]
        if harmless and closed:
            spared.append((begin, end))
        found += [(begin, end, w) for w, whole in terms if closed or not whole]
    spared = np.array(spared, np.int64).reshape(-1, 2)
    last = -1
    for begin, end, w in sorted(found, key=lambda x: (x[0], -x[2])):
        k = np.searchsorted(spared[:, 0], begin, side="right") - 1
        if begin == last or (k >= 0 and spared[k, 1] >= end):
            continue  # one term counts for a word, the heaviest
        last = begin
        row = int(np.searchsorted(edge, begin, side="right")) - 1
        hits[row] += 1
        weight[row] += w
    return words, hits, weight


def features(words: np.ndarray, hits: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A constant, the weight per hundred words on a log scale, and whether anything matched."""
    per = 100 * weight / np.maximum(words, 1)
    return np.stack([np.ones(len(words)), np.log1p(per), (hits > 0).astype(float)], axis=1)


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts each term occurs, counted per task."""

    def out(pos: Counter, neg: Counter) -> pa.RecordBatch:
        names = list(pos.keys() | neg.keys())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([pos[t] for t in names], pa.int64()),
                pa.array([neg[t] for t in names], pa.int64()),
            ],
            ["term", "pos", "neg"],
        )

    pos, neg = Counter(), Counter()
    for part in W.parts(batches, "text"):
        toxic = part.column(part.schema.get_field_index("toxic")).to_pylist()
        points, edge = fold(part.column(part.schema.get_field_index("text")))
        text = points.astype("<u4").tobytes().decode("utf-32-le")
        for row, label in enumerate(toxic):
            words = set(re.findall(r"[^\W_]+", text[edge[row] : edge[row + 1]]))
            (pos if label else neg).update({w[:k] for w in words for k in STEMS if k <= len(w)} | {w + "$" for w in words})
        if len(pos) + len(neg) > 500_000:
            yield out(pos, neg)
            pos, neg = Counter(), Counter()
    yield out(pos, neg)


def _chosen(counts: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[tuple[str, float], ...]:
    """The terms that stand for all others: each as long as its texts allow, none beside its beginning."""
    pos = {t: a for t, a, _ in counts}
    weight = {t: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1)) for t, a, b in counts}
    longer = {}
    for t, a in pos.items():
        parent = t[:-1]
        longer[parent] = max(longer.get(parent, 0), a)
    kept: dict[str, float] = {}
    for t in sorted(pos, key=lambda t: (len(t), t)):
        if t.endswith("$") or longer.get(t, 0) < 0.9 * pos[t]:
            if not any(t[:k] in kept for k in range(STEMS.start, len(t))):
                kept[t] = round(weight[t], 6)
    return tuple(kept.items())


def fit(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = 10_000,
    share: float = 0.02,
    exceptions: Sequence[str] = EXCEPTIONS,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
) -> Lexicon:
    """Learn a lexicon from labelled texts.

    At most about ``rows`` labelled texts are used, taken by a hash of their
    key; copies of a text count once, as toxic if any copy
    is. A term must occur in a share ``share`` of
    the toxic texts, and so often more than in others that chance is ruled out
    over all terms together. Rows with a NULL label or key are not used.
    Without labels of both kinds the lexicon is empty and every score is the
    same.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    named = named.groupBy(F.col(key).alias("key")).agg(F.max(F.col(label)).cast("int").alias("toxic"))
    n = named.count()
    if n > rows:
        # The share is cut from the whole range of hashes, so it holds for any number of labels.
        named = named.where(F.xxhash64("key") < F.lit((1 << 64) * rows // n - (1 << 63)))
    # The sample's size is bounded by the parameter, so it may be broadcast.
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(named), "key").select("text", "toxic")
    sample = storage.written(sample.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(8))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    spared = tuple(fold_text(e) for e in exceptions)
    if not toxic or not other:
        base = (toxic + 0.5) / (toxic + other + 1)
        return Lexicon((), spared, (math.log(base / (1 - base)), 0.0, 0.0))
    counted = sample.mapInArrow(_terms, "term string, pos long, neg long")
    counted = counted.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = storage.written(counted.where(F.col("pos") >= 2))
    n_terms = max(1, counted.count())
    size, base = F.col("pos") + F.col("neg"), toxic / (toxic + other)
    rate = F.col("pos") / size
    # The chance of so many toxic ones is at most exp(-evidence).
    evidence = size * (
        rate * F.log(rate / base)
        + F.when(F.col("neg") > 0, (1 - rate) * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    )
    strong = counted.where(
        (rate > base) & (rate >= PURE) & (evidence > math.log(n_terms / 0.01)) & (F.col("pos") >= share * toxic)
    )
    found = [(r["term"], r["pos"], r["neg"]) for r in strong.collect()]  # at most 1 / share terms a word of a text
    lexicon = Lexicon(_chosen(found, toxic, other), spared, (0.0, 0.0, 0.0))
    x, y = _sampled(sample, lexicon)
    return Lexicon(lexicon.weights, spared, tuple(_logistic(x, y)))


def _sampled(sample: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, which is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in W.parts(batches, "text"):
            x = features(*measure(part.column(part.schema.get_field_index("text")), lexicon, machine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 1]), pa.array(x[:, 2]), part.column(part.schema.get_field_index("toxic"))],
                ["per", "any", "toxic"],
            )

    rows = sample.mapInArrow(run, "per double, any double, toxic int").collect()
    # In a fixed order, so that sums do not depend on the order of tasks.
    rows = np.array(sorted((r["per"], r["any"], r["toxic"]) for r in rows), float)
    return np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> list[float]:
    """Logistic regression by Newton's method; the ridge keeps separable data finite."""
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, ridge, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - penalty @ b
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, grad)
        b = b + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in b]


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``matches`` and ``n_words`` to each row.

    The whole text counts. NULL and empty texts have no match and no word; they
    get the score of a text without a match. Other columns stay; those named
    like a new column are replaced.
    """

    def make():
        machine = lexicon.automaton()

        def step(column: pa.Array) -> Sequence[pa.Array]:
            words, hits, weight = measure(column, lexicon, machine)
            z = features(words, hits, weight) @ np.array(lexicon.coefficients)
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(hits), pa.array(words)]

        return step

    return W.add_columns(df, text, "score double, matches long, n_words long", make)


def accept(df: DataFrame, lexicon: Lexicon, least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows whose score is below ``least``, with all their columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for part in W.parts(batches, text):
            z = features(*measure(part.column(part.schema.get_field_index(text)), lexicon, machine))
            score = 1 / (1 + np.exp(-np.clip(z @ np.array(lexicon.coefficients), -500, 500)))
            yield part.filter(pa.array(score < least))

    return df.mapInArrow(run, df.schema)
