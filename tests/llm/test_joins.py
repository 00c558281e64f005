"""Hard negatives, collocations and the Jaccard join against brute force, and their edge cases."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.llm import hard_negatives, jaccard_join, meetings, order_minhash, phrases, storage

LOWER = {i: i + 32 for i in range(65, 91)}


# Hard negatives


def brute_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    ok = [
        (k, y, [math.floor(256 * x) for x in v])
        for k, v, y in rows
        if k is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, v in ok:
        if not anchor(a):
            continue
        scored = [(sum(p * q for p, q in zip(v, w)), k, y) for k, y, w in ok if k != a]
        best = sorted((-s, k) for s, k, y in scored if y == label)[:positives]
        for s, k in best:
            fits = sorted((-t, j) for t, j, y in scored if y != label and low * -s <= 100 * t <= high * -s)[:negatives]
            out += [(a, k, i + 1, j, -s, -t) for i, (t, j) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = hard_negatives.mine(df, F.col("vec_id") % every == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.select(names).collect())


def test_negatives_equal_brute_force_with_nulls_ties_and_ragged_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "STRIPE_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "CELL_WORK", 64)
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.1, 0.2, 0.5, -0.3]) for _ in range(4)], rng.randrange(3)) for i in range(60)]
    rows += [(60, None, 1), (61, [0.1, None, 0.2, 0.3], 1), (62, [0.1] * 4, None), (63, [float("nan")] * 4, 0)]
    rows += [(65, [float("inf")] * 4, 0), (70, [0.5, 0.5], 2), (75, [], 2), (None, [0.5] * 4, 2)]
    assert mined(spark, rows) == brute_negatives(rows, lambda k: k % 5 == 0)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6, 1e9])
def test_negatives_are_exact_for_large_components(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * scale if j else scale for j in range(6)], i % 2) for i in range(24)]
    want = [r for r in brute_negatives(rows, lambda k: k % 5 == 0)]
    narrow = [(*r[:4], *(s if abs(s) < 1 << 63 else None for s in r[4:])) for r in want]
    assert mined(spark, rows) == sorted(narrow) and want


def test_scores_use_every_width():
    rng = np.random.default_rng(1)
    for bits in (1, 4, 9, 16, 24, 31):
        a = rng.integers(-(1 << bits), 1 << bits, (5, 33))
        c = rng.integers(-(1 << bits), 1 << bits, (11, 33))
        want = a.astype(object) @ c.astype(object).T
        assert (hard_negatives.scores(a, c).astype(object) == want).all()
    assert hard_negatives.scores(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).shape == (2, 3)


def test_negatives_of_repeated_and_missing_rows(spark):
    assert mined(spark, []) == []
    same = [(i, [1.0, 0.0], 0) for i in range(10, 16)] + [(i, [0.75, 0.0], 1) for i in range(20, 24)]
    found = mined(spark, same + [(10, [1.0, 0.0], 0)], every=10)
    assert found == brute_negatives(same, lambda k: k % 10 == 0)
    extra = spark.createDataFrame(same, "vec_id long, embedding array<double>, label int").withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    assert hard_negatives.mine(extra, F.col("vec_id") % 10 == 0).count() == len(found)


# Collocations


def brute_phrases(rows, least, percent=80, most=2000):
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * longer[p] >= percent * a:
                continue
            score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:most]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found_phrases(spark, rows, least, **more):
    df = spark.createDataFrame(rows, "text string, lang string")
    return sorted(tuple(r) for r in phrases.collocations(df, least, **more).collect())


def some_texts(seed, n):
    rng = random.Random(seed)
    word = ["a", "B", "bb", "é", "ça", "日本", "of", "the", "x1", "z"]
    gap = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "? ! "]
    for _ in range(n):
        yield "".join(rng.choice(word) + rng.choices(gap, [40, 3, 3, 3, 3, 2, 1, 1])[0] for _ in range(rng.randrange(0, 60)))


def test_phrases_equal_brute_force(spark):
    rows = [(t, random.Random(i).choice(["en", "fr", None, "und", ""])) for i, t in enumerate(some_texts(2, 150))]
    rows += [(None, "en"), ("", "fr"), ("  ...  ", "de"), ("word " * 3000, "es")]
    for least in (2, 5, 30):
        assert found_phrases(spark, rows, least) == brute_phrases(rows, least)
    assert found_phrases(spark, rows, 3, most=4) == brute_phrases(rows, 3, most=4)


def test_phrases_with_small_buffers(spark, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 200)
    monkeypatch.setattr(phrases, "DISTINCT", 100)
    rows = [(t, "en") for t in some_texts(7, 120)]
    assert found_phrases(spark, rows, 8) == brute_phrases(rows, 8)


def test_phrases_of_nothing(spark):
    assert found_phrases(spark, [], 2) == []
    assert found_phrases(spark, [(None, None), ("", "en")], 2) == []


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(4)
    keys = np.concatenate([np.repeat(np.arange(50), 30), rng.integers(100, 1 << 31, 400_000)]).astype(np.uint32)
    rng.shuffle(keys)
    summary = phrases.Summary(len(keys) // 30 + 1, 30)
    for part in np.array_split(keys, 40):
        k, n = np.unique(part, return_counts=True)
        summary.add(k, n)
    assert np.isin(np.arange(50, dtype=np.uint32), summary.frequent()).all()
    assert summary.removed > 0 and len(summary.keys) <= 2 * summary.capacity


# Jaccard join


def sets_of(texts, size=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute_join(rows, percent=85):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        low[r] = k if low.get(r) is None else low[r] if k is None else min(low[r], k)
    return sorted(((k, len(s), low[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def joined(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_join.join(df, **more).collect()), key=str)


def near_texts(seed):
    """Groups of near copies around the limit, texts around a shared passage, and texts of few words."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, len(t) // 30 + 2))):
                t[rng.randrange(len(t))] = word()
            yield " ".join(t)
    for _ in range(30):
        own = [word() for _ in range(rng.randrange(2, 14))]
        cut = rng.randrange(0, 4)
        yield " ".join(own[:2] + passage[cut:] + own[2:])
    yield from ["a", "A", "a b", "a  B", "a b c", "a b c d", "a b c d e", "", "  ", None]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_equals_brute_force(spark, monkeypatch, seed):
    if seed == 3:  # every bound at work
        monkeypatch.setattr(meetings, "BLOCK", 4)
        monkeypatch.setattr(jaccard_join, "GROUP", 100)
    texts = list(near_texts(seed))
    random.Random(seed).shuffle(texts)
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    assert joined(spark, rows) == brute_join(rows)


def test_join_of_repeated_rows_and_null_keys(spark):
    rows = [(5, "one two three four five")] * 3 + [(None, "one two three four five"), (None, "alone here"), (7, None), (7, ""), (3, "x")]
    assert joined(spark, rows) == brute_join(rows)
    assert joined(spark, []) == []
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("n"))
    assert jaccard_join.join(df).count() == len(rows)


def test_join_of_a_long_text(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    edited = [x if rng.random() > 0.015 else "other" for x in w]
    rows = [(1, " ".join(w)), (2, " ".join(edited)), (3, " ".join(w[:30_000])), (4, "y" * 300_000)]
    assert joined(spark, rows) == brute_join(rows)


def test_chosen_prefixes_cover_what_is_required():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 300, 200)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    count = np.concatenate([np.sort(rng.integers(1, 50, k)) for k in n])
    l, length = jaccard_join.chosen(n, start, count, 85)
    required = -(-85 * n // 100)
    assert (l >= 1).all() and (l <= required).all() and (length == n - required + l).all() and (l > 1).any()


def test_pairs_apart_in_their_words_are_not_aligned(spark, monkeypatch):
    """Texts of a common passage whose own words come in even numbers: the parity of words alone tells nothing."""
    asked = []
    verified = order_minhash._verified

    def counted(pairs, texts, least):
        pairs = pairs.localCheckpoint()
        asked.append(pairs.count())
        return verified(pairs, texts, least)

    monkeypatch.setattr(order_minhash, "_verified", counted)
    passage = " ".join(f"w{i}" for i in range(40))
    docs = [(i, f"{passage} " + f"own{i} " * 60) for i in range(40)]
    near = " ".join(f"v{i}" for i in range(60))
    docs += [(40, near), (41, near.replace("v7 ", "x ").replace("v30 ", "y "))]
    df = spark.createDataFrame(docs, "key long, text string")
    found = [tuple(r) for r in order_minhash.links(df, 0.8).collect()]
    assert found == [(41, 40)] and sum(asked) < 200


def test_a_pair_of_many_buckets_is_made_once(spark):
    rng = np.random.default_rng(3)
    n, buckets = 30, 12
    rows = [(b, k) for b in range(buckets) for k in range(n) if rng.random() < 0.7]
    of = {k: [b for b, x in rows if x == k] for k in range(n)}
    bits = meetings.parities(np.repeat(np.arange(n), 5), np.tile(np.arange(5, dtype=np.uint64), n), n).to_pylist()
    made = {True: [], False: []}
    for b in range(buckets):
        keys = [k for x, k in rows if x == b]
        cell = {
            "key": keys, "n": [5] * len(keys), "place": [0] * len(keys), "class": keys, "side": [0] * len(keys),
            "bits": [bits[k] for k in keys], "bucket": [b] * len(keys),
        }
        for once in made:
            more = {"buckets": [rng.permutation(of[k]).tolist() for k in keys]} if once else {}
            out = meetings._pairs(pa.table(cell | more), lambda n, m, i, j: n == m, lambda n, m: 0 * n, False)
            made[once] += zip(out["key"].to_pylist(), out["rep"].to_pylist())
    assert len(made[True]) == len(set(made[True])) < len(made[False]) and set(made[True]) == set(made[False])


def test_parities_of_all_sizes():
    rng = np.random.default_rng(4)
    size = np.array([0, 3, 300, 1, 700, 5000, 1500, 0, 9000])
    of, x = np.repeat(np.arange(len(size)), size), rng.integers(0, 2**63, size.sum()).astype(np.uint64)
    for i, b in enumerate(meetings.parities(of, x, len(size)).to_pylist()):
        wide = len(b) * 8
        cell = np.bincount((x[of == i] % wide).astype(int), minlength=wide) & 1
        assert np.array_equal(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little"), cell)
        assert wide == min(max(1024, 1 << int(4 * size[i] - 1).bit_length()), 16384)


@pytest.mark.parametrize("at_a_time", [1 << 19, 20])
def test_components_equal_brute_force(spark, monkeypatch, at_a_time):
    monkeypatch.setattr(meetings, "EDGES", at_a_time)
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    rows = meetings.components(df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == {k: v for k, v in root.items() if k != v}


def test_buckets_are_compared_once(spark, monkeypatch):
    """Rounds of nearest items use the pairs of the first comparison again; only buckets of too many pairs come back."""
    passes, rest = [], meetings.rest

    def counted(members, *args, **kw):
        passes.append(members.select("bucket").distinct().count())
        return rest(members, *args, **kw)

    monkeypatch.setattr(meetings, "rest", counted)
    buckets, n = 40, 6
    rows = [(b, b * n + i, 10 + i, 0, 1) for b in range(buckets) for i in range(n)]  # in each bucket a chain of sizes
    members = spark.createDataFrame(rows, "bucket long, key long, n long, place int, weight long")
    even = meetings.parities(np.zeros(0, np.int64), np.zeros(0, np.uint64), buckets * n).to_pylist()
    marks = spark.createDataFrame([(k, b) for k, b in enumerate(even)], "key long, bits binary")

    def check(pairs):
        close = F.abs(F.col("key") - F.col("rep")) == 1
        return storage.written(pairs.select("key", "rep", close.alias("similar")))

    found = meetings.linked(members, marks, check, 80, lambda a, b, i, j: np.abs(a - b) <= 3, lambda a, b: 0 * a)
    pairs = {tuple(sorted(r)) for r in found.collect()}
    assert pairs == {(b * n + i, b * n + i + 1) for b in range(buckets) for i in range(n - 1)}
    assert len(passes) == 1 and passes[0] <= buckets


@pytest.mark.parametrize("few", [1, 8])
def test_blocks_of_too_many_pairs_lose_none(spark, monkeypatch, few):
    monkeypatch.setattr(meetings, "FEW", few)
    monkeypatch.setattr(meetings, "PACK", 4)
    rng = np.random.default_rng(8)
    n = 60
    rows = [(b, k, 50 + k % 9, 0, 1) for b in range(5) for k in range(n) if rng.random() < 0.6]
    members = spark.createDataFrame(rows, "bucket long, key long, n long, place int, weight long")
    even = meetings.parities(np.zeros(0, np.int64), np.zeros(0, np.uint64), n).to_pylist()
    marks = spark.createDataFrame([(k, b) for k, b in enumerate(even)], "key long, bits binary")
    linked = {tuple(sorted(p)) for p in rng.integers(0, n, (40, 2)).tolist()}
    listed = spark.createDataFrame([(b, a) for a, b in linked], "key long, rep long").withColumn("similar", F.lit(True))

    def check(pairs):
        pairs = pairs.select(F.greatest("key", "rep").alias("key"), F.least("key", "rep").alias("rep"))
        return storage.written(pairs.join(listed, ["key", "rep"], "left").fillna(False))

    found = meetings.linked(members, marks, check, 80, lambda a, b, i, j: a > 0, lambda a, b: 0 * a, once=True)
    of = {k: {b for b, x, *_ in rows if x == k} for k in range(n)}
    meet = {(a, b) for a, b in linked if a != b and of[a] & of[b]}
    assert {tuple(sorted(r)) for r in found.collect()} <= meet

    def roots(pairs):
        root = {k: k for k in range(n)}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(meet) == roots({tuple(sorted(r)) for r in found.collect()})


def test_only_rows_near_in_size_to_another_class_are_compared(spark):
    rng = np.random.default_rng(5)
    rows = [(int(b), k, int(n), 0, k % 3) for k, (b, n) in enumerate(zip(rng.integers(0, 60, 200), rng.integers(0, 400, 200)))]
    kept = meetings._mixed(spark.createDataFrame(rows, "bucket long, key long, n long, place int, class long"), 80)
    kept = {r["key"] for r in kept.collect()}
    near = {
        k for b, k, n, _, c in rows for b2, _, m, _, c2 in rows
        if b == b2 and c != c2 and abs(n - m) <= order_minhash._most(0.8, np.int64(n), np.int64(m))
    }
    assert near <= kept and len(kept) < len(rows)
