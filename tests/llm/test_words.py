"""Words, hashes and lookups on flat arrays."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from tidepool.llm import words as W

texts = st.lists(st.none() | st.text(alphabet="ab \t\n\x0b\x1f.é中😀Z9", max_size=40), max_size=8)


@given(texts)
def test_split(rows):
    data, offsets = W.flat(pa.array(rows, pa.string()))
    found = W.split(data, offsets, W.NOT_SPACE)
    raw = data.tobytes()
    got = [[raw[found.start[i] : found.end[i]].decode() for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]


@given(texts)
def test_split_lowered(rows):
    data, offsets = W.flat(pa.array(rows, pa.string()))
    found = W.split(W.LOWER[data], offsets, W.LETTER_OR_DIGIT)
    raw = found.data.tobytes()
    got = [[raw[found.start[i] : found.end[i]].decode() for i in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in rows]
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]


def test_hashes_tell_words_apart():
    rows = [str(i) * (1 + i % 40) for i in range(3000)] + ["a\0", "a", "a\0\0", ""]
    data, offsets = W.flat(pa.array(rows))
    h = W.hashes(data, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == len(set(rows))
    assert (W.hashes(data, offsets[:-1], offsets[1:]) == h).all()


def test_windows_depend_on_order_not_place():
    h = W.mix(np.arange(50, dtype=W.U))
    row = np.concatenate([h, h, h[::-1]])
    w = W.windows(row, np.array([3, 53, 100, 113]), 7)
    assert w[0] == w[1] and len(set(w.tolist())) == 3


def test_lookup():
    keys = W.mix(np.arange(5000, dtype=W.U))
    table = W.Lookup(keys, np.arange(5000))
    assert (table.get(keys) == np.arange(5000)).all()
    assert (table.get(W.mix(np.arange(5000, 9000, dtype=W.U))) == -1).all()


def test_parts_bound_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 5, 90, 1, 0)] + [None])], ["t"])
    got = [p.column(0).to_pylist() for p in W.parts([batch], "t", 10)]
    assert [len(x) for x in got] == [2, 1, 3] and sum(got, []) == batch.column(0).to_pylist()
