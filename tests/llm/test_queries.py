"""Registered queries against SQL or brute force on the small tables."""

import collections
import hashlib
import re
import zlib

import pytest
from conftest import SMALL

import corpus_pipeline
from tidepool.llm import order_minhash, queries, secrets, urls
from tools.check import compare, duck


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SMALL, "documents").collect()}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    ok, text, _ = compare(spark, duck(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert ok, text


def test_urls(spark):
    rows = queries.QUERIES["op1_url_filter"](spark, SMALL).collect()
    pages = {r["page_id"]: r["url"] for r in queries.table(spark, SMALL, "pages").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r["page_id"]] or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        fits = [
            (len(rule), rule, says)
            for rule, says in urls.RULES
            for h, p in [rule.split("/", 1)]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p)
        ]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits)[1:]
        else:
            assert r["rule"] is None and r["verdict"] == ("block" if r["probability"] >= 0.5 else "allow")


def test_fingerprints(spark, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_fingerprint"](spark, SMALL).collect()}
    order = sorted(docs, reverse=True)
    assert sorted(rows) == sorted(docs)

    def bag(t):
        return collections.Counter({w: n * len(w.encode()) for w, n in collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t)).items()})

    errors = []
    for i, k in enumerate(order):
        text, following = docs[k], docs[order[(i + 1) % len(order)]]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        r = rows[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(changed))
        for near, other in ((r["near_edited"], changed), (r["near_next"], following)):
            a, b = bag(text), bag(other)
            errors.append(near - (sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3


def test_secrets(spark):
    d = SMALL.replace("0.001", "0.1")  # the smallest table holds no secret
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, d, "documents").collect()}
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_secret_scan"](spark, d).collect()}
    assert sorted(rows) == sorted(docs)
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [
        ("assign", rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
        ("access", "AKIA[A-Z0-9]+", 16, 0),
        ("hex", "[0-9a-f]+", 32, 0),
    ]
    some = 0
    for k, text in docs.items():
        found = [
            (m.start(), i, f"{kind}:{m.start()}:{m.end()}")
            for i, (kind, pattern, least, group) in enumerate(kinds)
            for m in re.finditer(pattern, text)
            if len(m[group]) >= least
        ]
        some += bool(found)
        assert rows[k]["base_sha256"] == sha(",".join(x[2] for x in sorted(found)))
        base = [s for s in rows[k]["spans"].split(",") if s and not s.startswith("random")]
        assert base == [x[2] for x in sorted(found)]
        assert [rows[k][f"n_{kind}"] for kind, *_ in kinds] == [sum(x[1] == i for x in found) for i in range(3)]
    assert some


def test_toxicity_held_out(spark):
    d = SMALL.replace("0.001", "0.1")
    scored = queries.QUERIES["op5_toxicity"](spark, d).join(queries.table(spark, d, "labels"), "doc_id")
    rows = scored.collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    good = sum(r["predicted"] and r["toxic"] for r in held)
    assert good / sum(r["toxic"] for r in held) > 0.8 and good / sum(r["predicted"] for r in held) > 0.95


def test_tokens(spark, docs):
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    rows = queries.QUERIES["op6_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r["doc_id"]], add_bos=True, add_eos=True, enable_sampling=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(sp.decode(ids))


def near_classes(docs, least=order_minhash.SIMILAR):
    """Classes by aligning all pairs whose lengths allow it."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    first = {}
    for k in sorted(docs):
        find(k)
        if docs[k] in first:
            root[find(k)] = find(first[docs[k]])
        first.setdefault(docs[k], k)
    rows = sorted((t.split(), k) for t, k in first.items() if t.split())
    rows.sort(key=lambda x: len(x[0]))
    counts = [collections.Counter(w) for w, _ in rows]
    for i, (a, x) in enumerate(rows):
        places = order_minhash.places(a)
        for j in range(i + 1, len(rows)):
            b, y = rows[j]
            if len(a) < least * len(b):
                break
            if sum((counts[i] & counts[j]).values()) < least * len(b):
                continue
            most = int((1 - least) * len(b) + 1e-9)
            if order_minhash.distance(places, len(a), b, most) <= most:
                root[find(x)] = find(y)
    out = collections.defaultdict(list)
    for k in docs:
        out[find(k)].append(k)
    return {k: min(v) for v in out.values() for k in v}


def test_near_duplicates(spark, docs):
    rows = queries.QUERIES["op8_near_duplicates"](spark, SMALL).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == near_classes(docs)
    size = collections.Counter(r["class_id"] for r in rows)
    assert all(r["class_size"] == size[r["class_id"]] for r in rows)


def test_pipeline(spark, docs):
    """Each stage against what it should do with its own input."""
    import sentencepiece

    d = queries.table(spark, SMALL, "documents")
    names = set(d.columns)
    lexicon = queries.toxicity_lexicon(spark, d, SMALL)
    rejected = {r["doc_id"] for r in queries.QUERIES["op5_toxicity"](spark, SMALL).where("predicted = 1").collect()}
    assert lexicon.coefficients
    left = {k: t for k, t in docs.items() if k not in rejected}
    kept = near_classes(left)
    left = {k: t for k, t in left.items() if kept[k] == k}
    hit = {r["doc_id"] for r in queries.QUERIES["op9_decontamination"](spark, SMALL).where("contaminated").collect()}
    left = {k: t for k, t in left.items() if k not in hit}

    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert rows.keys() == left.keys() and 0 < len(left) < len(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    pattern = re.compile(secrets.ASSIGN.pattern + "|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    for k, r in rows.items():
        assert names <= set(r.asDict()) and r["n_chars"] == len(r["text"])
        assert r["ids"] == sp.encode(r["text"], add_bos=True, add_eos=True)
        assert r["decoded"] == sp.decode(r["ids"])
        if pattern.search(left[k]):
            assert "[SECRET]" in r["text"] and not re.search("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r["text"])
    assert sum(r["text"] != left[k] for k, r in rows.items()) < len(rows) / 2
