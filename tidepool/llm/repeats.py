"""Passages that occur more than once, whole and exact, over all texts.

A window of L consecutive words is repeated if its word sequence also starts at
another place, in the same text or another. Two ways to find them share their
steps and differ in the anchors, short word sequences that stand for the
windows around them:

- Difference cover: anchors start only at places whose number modulo a period
  is in a cover. Any two places have a common distance to the cover, so two
  equal windows always hold an equal anchor at the same distance.
- Sparse suffixes: suffixes start only where their first words have the least
  hash of a window. Equal windows choose equal places.

Anchors are sorted by their first words and neighbours compared; those without
an equal neighbour are dropped. What is left is extended to the left and right:
the windows around the anchors are compared in the same way, by a digest of
96 bits, and repeated windows that overlap join into maximal passages.

Texts are kept in blocks of a few megabytes in a table in the shared folder. A
block sends each anchor or window once, whatever its number of copies there,
packed by range of hash, and gets back one bit for each. So a passage in a
third of all texts costs each block one entry, and no pair is ever made.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm import storage
from tidepool.llm import words as W

# Text kept and compared as one block, and packed entries sorted as one bucket.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
# Difference cover: every distance modulo the period is between two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)

Anchors = Callable[[W.Words, np.ndarray, int], tuple[np.ndarray, np.ndarray, int]]


def cover_anchors(words: W.Words, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, hashes, words) of anchors at the places of the cover."""
    size = length - PERIOD + 1
    if size < 1:
        raise ValueError(f"a window must have at least {PERIOD} words")
    place = np.arange(len(h)) - np.repeat(words.first[:-1], words.count)
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    left = words.left()
    # Only texts that hold a whole window matter.
    at = np.flatnonzero(member[place % PERIOD] & (left >= size) & (place + left >= length))
    return at, W.windows(h, at, size), size


def _slide(v: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over v[i : i + width]; the last width - 1 values are of fewer."""
    done = 1
    while done < width:
        step = min(done, width - done)
        out = v.copy()
        pick(v[:-step], v[step:], out=out[:-step])
        v, done = out, done + step
    return v


def minimiser_anchors(words: W.Words, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, hashes, words) of suffixes whose first words have the least hash of a window."""
    size = max(1, length * 3 // 10)
    span = length - size + 1
    top = W.U(2**64 - 1)
    left = words.left()
    value = np.full(len(h), top)
    ok = np.flatnonzero(left >= size)
    value[ok] = W.windows(h, ok, size) >> W.U(1)
    least = np.where(left >= length, _slide(value, span, np.minimum), W.U(0))
    # A place is chosen if it is the least of some window that holds it.
    back = _slide(least[::-1], span, np.maximum)[::-1]
    at = np.flatnonzero((back == value) & (value < top))
    return at, value[at], size


@dataclass
class Entries:
    """Distinct keys of a block in order, and the key of each place."""

    place: np.ndarray
    of: np.ndarray
    high: np.ndarray
    low: np.ndarray

    def send(self, block: int, bits: int) -> pa.RecordBatch:
        edge = np.searchsorted(self.high, np.arange(1 << bits, dtype=W.U) << W.U(64 - bits))
        edge = np.append(edge, len(self.high))
        used = np.flatnonzero(np.diff(edge))
        cut = [(edge[i], edge[i + 1]) for i in used]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(np.full(len(used), block), pa.int64()),
                pa.array([self.high[a:b].tobytes() for a, b in cut], pa.binary()),
                pa.array([self.low[a:b].tobytes() for a, b in cut], pa.binary()),
            ],
            ["bucket", "block", "high", "low"],
        )

    def marked(self, bits: int, verdict: list[dict] | None) -> np.ndarray:
        """The places whose key occurs more than once."""
        flag = np.zeros(len(self.high), bool)
        edge = np.searchsorted(self.high, np.arange(1 << bits, dtype=W.U) << W.U(64 - bits))
        edge = np.append(edge, len(self.high))
        for v in verdict or ():
            a, b = edge[v["bucket"]], edge[v["bucket"] + 1]
            flag[a:b] = np.unpackbits(np.frombuffer(v["bits"], np.uint8), count=b - a)
        return self.place[flag[self.of]]


def entries(place: np.ndarray, high: np.ndarray, low: np.ndarray) -> Entries:
    """Keys sorted and made distinct; the lowest bit tells of a second occurrence."""
    high = high >> W.U(1)
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    many = np.bincount(of, minlength=int(new.sum())) > 1
    return Entries(place, of, (a[new] << W.U(1)) | many.astype(W.U), b[new])


class Block:
    """The texts of a block with their words, anchors and windows."""

    def __init__(self, rows: bytes, text: str, length: int, anchors: Anchors):
        self.batch = pa.ipc.open_stream(rows).read_next_batch()
        data, offsets = W.flat(self.batch.column(self.batch.schema.get_field_index(text)))
        self.words = W.split(data, offsets, W.NOT_SPACE)
        self.h = W.hashes(data, self.words.start, self.words.end)
        self.length = length
        self.find = anchors

    def anchors(self) -> Entries:
        at, key, self.size = self.find(self.words, self.h, self.length)
        return entries(at, key, np.zeros(len(at), np.uint32))

    def windows(self, anchors: np.ndarray) -> Entries:
        """The windows around the given anchors."""
        words, n = self.words, len(self.h)
        text = np.searchsorted(words.first, anchors, side="right") - 1
        lo = np.maximum(anchors + self.size - self.length, words.first[text])
        hi = np.minimum(anchors, words.first[text + 1] - self.length) + 1
        ok = lo < hi
        change = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok], minlength=n + 1)
        at = np.flatnonzero(np.cumsum(change)[:n] > 0)
        other = W.mix(self.h ^ W._M1)
        return entries(at, W.windows(self.h, at, self.length),
                       W.windows(other, at, self.length).astype(np.uint32))

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """For each word, whether a given window covers it."""
        n = len(self.h)
        change = np.bincount(windows, minlength=n + 1)
        change = change - np.bincount(windows + self.length, minlength=n + 1)
        return np.cumsum(change)[:n] > 0


def _pack(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    base, number = TaskContext.get().partitionId() << 32, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        one = pa.Table.from_batches(held).combine_chunks().to_batches()
        batch = one[0] if one else held[0]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
        return pa.RecordBatch.from_arrays(
            [pa.array([base + number]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "size", "rows"],
        )

    for part in W.parts(batches, text, BLOCK_BYTES // 4):
        more = len(W.flat(part.column(part.schema.get_field_index(text)))[0])
        if held and size + more > BLOCK_BYTES:
            yield out()
            held, size, number = [], 0, number + 1
        held.append(part)
        size += more
    if held:
        yield out()


def _compare(rows: pa.Table) -> pa.Table:
    """Sort the entries of a bucket and compare neighbours: a bit for each entry."""
    blobs = [(h.as_py(), x.as_py()) for h, x in zip(rows["high"], rows["low"])]
    high = np.frombuffer(b"".join(h for h, _ in blobs), W.U)
    low = np.frombuffer(b"".join(x for _, x in blobs), np.uint32)
    key = high >> W.U(1)
    order = np.lexsort((low, key))
    a, b = key[order], low[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(a), bool)
    twice[1:] |= same
    twice[:-1] |= same
    flag = (high & W.U(1)).astype(bool)
    flag[order] |= twice
    edge = W.bounds(np.array([len(h) // 8 for h, _ in blobs]))
    bits = [np.packbits(flag[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:])]
    return pa.table({"block": rows["block"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})


def _verdicts(blocks: DataFrame, sent: DataFrame, name: str) -> DataFrame:
    """The blocks, each with the bits of its entries."""
    bits = sent.groupBy("bucket").applyInArrow(_compare, "block long, bucket int, bits binary")
    whole = bits.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return blocks.join(whole, "block", "left")


def _send(batches: Iterable[pa.RecordBatch], text: str, length: int, anchors: Anchors, bits: int) -> Iterator:
    for batch in batches:
        known = "anchors" in batch.schema.names
        for row in batch.to_pylist():
            block = Block(row["rows"], text, length, anchors)
            found = block.anchors()
            if known:
                found = block.windows(found.marked(bits, row["anchors"]))
            yield found.send(row["block"], bits)


Finish = Callable[[pa.RecordBatch, W.Words, np.ndarray], pa.RecordBatch]


def _finish(
    batches: Iterable[pa.RecordBatch], text: str, length: int, anchors: Anchors, bits: int, finish: Finish
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["rows"], text, length, anchors)
            found = block.windows(block.anchors().marked(bits, row["anchors"]))
            yield finish(block.batch, block.words, block.covered(found.marked(bits, row["windows"])))


def _repeated(df: DataFrame, text: str, length: int, anchors: Anchors, schema: T.StructType, finish: Finish) -> DataFrame:
    blocks = storage.written(
        df.mapInArrow(functools.partial(_pack, text=text), "block long, size long, rows binary")
    )
    # About two bytes of entries for three of text, at most.
    total = blocks.agg(F.sum("size").alias("n")).first()["n"] or 0
    bits = min(24, max(9, int(total * 2 / 3 / BUCKET_BYTES).bit_length()))
    send = functools.partial(_send, text=text, length=length, anchors=anchors, bits=bits)
    sent = "bucket int, block long, high binary, low binary"
    first = _verdicts(blocks.select("block", "rows"), blocks.select("block", "rows").mapInArrow(send, sent), "anchors")
    marks = storage.written(first.select("block", "anchors"))
    joined = blocks.select("block", "rows").join(marks, "block")
    second = _verdicts(joined, joined.mapInArrow(send, sent), "windows")
    return second.mapInArrow(
        functools.partial(_finish, text=text, length=length, anchors=anchors, bits=bits, finish=finish), schema
    )


def _runs(covered: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs per text, starts, ends) of covered words, counted in their text."""
    inside, before = np.append(covered, False), np.concatenate([[False], covered])
    edge = np.zeros(len(covered) + 1, bool)
    edge[words.first] = True
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    text = words.text[start]
    base = words.first[:-1][text]
    return np.bincount(text, minlength=len(words.first) - 1), start - base, end - base


def _with_passages(batch: pa.RecordBatch, words: W.Words, covered: np.ndarray) -> pa.RecordBatch:
    count, start, end = _runs(covered, words)
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
    batch = W.with_column(batch, "n_words", pa.array(words.count, pa.int32()))
    return W.with_column(batch, "passages", W.lists_of(spans, count))


def _without_windows(batch: pa.RecordBatch, words: W.Words, covered: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(~covered)
    text = words.text[keep]
    last = np.ones(len(keep), bool)
    last[:-1] = text[1:] != text[:-1]
    spaced = np.append(words.data, np.uint8(0x20))
    size = words.end[keep] - words.start[keep]
    # Each word is followed by a space, but for the last of its text.
    at = W.spread(words.start[keep], size + 1)
    step = size + 1
    gap = np.cumsum(step) - 1
    at[gap] = len(words.data)
    here = np.ones(len(at), bool)
    here[gap[last]] = False
    data = spaced[at[here]]
    per_text = np.bincount(text, weights=step - last, minlength=len(words.first) - 1).astype(np.int64)
    kept = W.texts_of(data, W.bounds(per_text))
    n_kept = np.bincount(text, minlength=len(words.first) - 1)
    batch = W.with_column(batch, "n_words", pa.array(words.count, pa.int32()))
    batch = W.with_column(batch, "n_removed", pa.array(words.count - n_kept, pa.int32()))
    return W.with_column(batch, "kept", kept)


def _schema(df: DataFrame, fields: str) -> T.StructType:
    schema = df.schema
    for f in T.StructType.fromDDL(fields).fields:
        schema = W.with_field(schema, f.name, f.dataType)
    return schema


def remove(df: DataFrame, length: int = 35, text: str = "text") -> DataFrame:
    """Substring dedup by difference-cover anchors: drop words in repeated windows.

    Adds ``n_words``, ``n_removed`` and ``kept``, the other words joined by one
    space. Words are runs of characters other than ASCII white space. All
    occurrences of a window go, the first one too; windows are judged on the
    input. Repeated rows are further occurrences. NULL and empty texts, and
    texts shorter than a window, lose nothing; NULL has no words and keeps the
    empty text. Other columns stay; those named like a new one are replaced.
    ``length`` is at least 21.
    """
    schema = _schema(df, "n_words int, n_removed int, kept string")
    return _repeated(df, text, length, cover_anchors, schema, _without_windows)


def passages(df: DataFrame, length: int = 50, text: str = "text") -> DataFrame:
    """Suffix-array dedup by sparse suffixes: the repeated passages of each text.

    Adds ``n_words`` and ``passages``: maximal ranges of words covered by
    windows of ``length`` words that also occur elsewhere. Words, NULL, empty
    and short texts, repeated rows and other columns are as in ``remove``.
    """
    schema = _schema(df, "n_words int, passages array<struct<start:int,end:int>>")
    return _repeated(df, text, length, minimiser_anchors, schema, _with_passages)
