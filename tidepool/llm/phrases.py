"""Phrases whose words occur together more often than apart.

All n-grams of one to four words are counted per language in two passes. The
first makes Misra-Gries summaries: n-grams are dealt by hash, each share has a
summary of more counters than its mass divided by the least wanted count, and
summaries are merged by adding counters and taking the same amount off all of
them. What is taken off in total stays below that count, so every frequent
n-gram survives. The survivors are a bitmap of fixed size over hashes. The
second pass counts the n-grams whose bit is set, exactly and by their text.

A frequent n-gram is counted where it is read before anything is shuffled, so a
word in a third of all places costs each task one entry.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm import storage
from tidepool.llm import words as W

MOST_WORDS = 4
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~PIECE_END
WORD[[0x20, 0x09]] = False
# Bits of the map of survivors (32 MB), and of a hash within a share.
MAP_BITS, KEY_BITS = 28, 32
# N-grams that a task gathers before it sends them, and distinct ones with their texts.
GATHERED, DISTINCT = 1 << 22, 1 << 19
# Parts into which the phrases of a language are dealt to find the best.
SALTS = 16


class Grams:
    """The words of some texts, and the n-grams that start at each of them."""

    def __init__(self, part: pa.RecordBatch):
        data, offsets = W.flat(part.column("text"))
        data = W.LOWER[data]
        self.words = words = W.split(data, offsets, WORD)
        self.h = W.hashes(data, words.start, words.end)
        self.text = words.text
        piece = np.cumsum(PIECE_END[data], dtype=np.int64)[words.start] if len(data) else np.zeros(0, np.int64)
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (self.text[1:] != self.text[:-1])
        edge = np.append(np.flatnonzero(new), len(piece))
        # Words from each word to the end of its piece, itself included.
        self.left = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(piece))
        self.lang = part.column("lang")
        names, at = W.flat(self.lang)
        self._lang = W.hashes(names, at[:-1], at[1:], seed=1)

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the n-grams of ``size`` words; the language is part of them."""
        at = np.flatnonzero(self.left >= size)
        return at, W.mix((W.windows(self.h, at, size) ^ self._lang[self.text[at]]) + W.U(size))

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """The words from each place, joined by one space."""
        word = W.spread(at, np.full(len(at), size))
        start, length = self.words.start[word], self.words.end[word] - self.words.start[word]
        where = W.spread(start, length + 1)
        gap = np.cumsum(length + 1) - 1
        where[gap] = len(self.words.data)
        keep = np.ones(len(where), bool)
        keep[gap[size - 1 :: size]] = False
        per = (length + 1).reshape(-1, size).sum(axis=1) - 1
        return W.texts_of(np.append(self.words.data, np.uint8(0x20))[where[keep]], W.bounds(per))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Grams]:
    return (Grams(part) for part in W.parts(batches, "text"))


def _sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, grams) of each part."""
    for g in _parts(batches):
        words = np.bincount(g.text, minlength=len(g.lang)).astype(np.int64)
        grams = np.bincount(g.text, weights=np.minimum(g.left, MOST_WORDS), minlength=len(g.lang)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([g.lang.cast(pa.string()), pa.array(words), pa.array(grams)], ["lang", "words", "grams"])


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.append(start, len(x)))


def _dealt(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counted hashes by share: those that occur once, and the others with their counts."""
    edges = np.arange((1 << bits) + 1, dtype=W.U) << W.U(KEY_BITS)
    names = ["share", "ones", "keys", "counts"]

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        x, n = _counted(np.concatenate(held) >> W.U(64 - KEY_BITS - bits))
        one = n == 1
        once, more, count = x[one], x[~one], n[~one].astype(np.uint32)
        a, b = np.searchsorted(once, edges), np.searchsorted(more, edges)
        used = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0))
        once, more = once.astype(np.uint32), more.astype(np.uint32)
        columns = [
            [once[a[i] : a[i + 1]].tobytes() for i in used],
            [more[b[i] : b[i + 1]].tobytes() for i in used],
            [count[b[i] : b[i + 1]].tobytes() for i in used],
        ]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names)

    held, size = [], 0
    for g in _parts(batches):
        for n in range(1, MOST_WORDS + 1):
            held.append(g.hashes(n)[1])
            size += len(held[-1])
        if size >= GATHERED:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


class Summary:
    """A Misra-Gries summary: counters of hashes, and what was taken off each at most.

    Any hash with a count of ``least`` or more has a counter at the end, whatever
    the capacity: no more than ``least - 1`` is ever taken off.
    """

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.removed = max(capacity, 1), least, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._held.append((keys, counts))
        self._size += len(keys)
        if self._size > max(4 * self.capacity, 1 << 16):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._held)])
        counts = np.concatenate([self.counts, *(c for _, c in self._held)])
        self._held, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[start], np.add.reduceat(counts[order], start) if len(start) else counts
        if len(self.keys) > 2 * self.capacity:
            at = len(self.keys) - self.capacity - 1
            off = min(int(np.partition(self.counts, at)[at]), self.least - 1 - self.removed)
            kept = self.counts > off
            self.keys, self.counts = self.keys[kept], self.counts[kept] - off
            self.removed += off

    def frequent(self) -> np.ndarray:
        """The hashes that may have a count of ``least`` or more."""
        self.merge()
        return self.keys[self.counts + self.removed >= self.least]


def _survivors(batches: Iterable[pa.RecordBatch], bits: int, capacity: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by share: the slice of the map of each share."""
    rows = (r for b in batches for r in b.to_pylist())
    for share, some in itertools.groupby(rows, lambda r: r["share"]):
        summary = Summary(capacity, least)
        for r in some:
            once = np.frombuffer(r["ones"], np.uint32)
            summary.add(once, np.ones(len(once), np.int64))
            summary.add(np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["counts"], np.uint32).astype(np.int64))
        found = np.zeros(1 << (MAP_BITS - bits), bool)
        found[summary.frequent() >> np.uint32(KEY_BITS - MAP_BITS + bits)] = True
        packed = zlib.compress(np.packbits(found).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([packed], pa.binary())], ["share", "bits"])


def _texts(batches: Iterable[pa.RecordBatch], survivors, bits: int) -> Iterator[pa.RecordBatch]:
    """The n-grams whose bit is set, with their texts, counted in a task as far as memory allows, by share."""
    bitmap = np.frombuffer(survivors.value, np.uint8)
    edges = np.arange((1 << bits) + 1, dtype=W.U) << W.U(64 - bits)
    held: list[tuple] = []

    def merged(rows: list[tuple]) -> tuple:
        keys, check, counts = (np.concatenate([r[i] for r in rows]) for i in range(3))
        table = pa.concat_tables([r[3] for r in rows])
        order = np.argsort(keys, kind="stable")
        a, b = keys[order], check[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[start], b[start], np.add.reduceat(counts[order], start), table.take(pa.array(order[start]))

    def out(rows: tuple) -> Iterator[pa.RecordBatch]:
        table = rows[3].append_column("n", pa.array(rows[2], pa.int64()))
        edge = np.append(np.searchsorted(rows[0], edges[:-1]), len(rows[0]))
        used = np.flatnonzero(np.diff(edge))
        for lo in range(0, len(used), 64):
            some = used[lo : lo + 64]
            blobs = [_written(table.slice(edge[i], edge[i + 1] - edge[i])) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["share", "rows"])

    for g in _parts(batches):
        other = W.mix(g.h ^ W._M1)
        for size in range(1, MOST_WORDS + 1):
            at, x = g.hashes(size)
            bit = (x >> W.U(64 - MAP_BITS)).astype(np.int64)
            hit = np.flatnonzero((bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
            if not len(hit):
                continue
            at, x = at[hit], x[hit]
            order = np.argsort(x, kind="stable")
            at, x = at[order], x[order]
            y = W.windows(other, at, size)
            start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            count, first = np.diff(np.append(start, len(x))), at[start]
            table = pa.table({
                "lang": pc.take(g.lang, pa.array(g.text[first])).cast(pa.string()),
                "size": pa.array(np.full(len(first), size, np.int32)),
                "phrase": g.texts(first, size),
            })
            held.append((x[start], y[start], count, table))
        if sum(len(h[0]) for h in held) > DISTINCT:
            now = merged(held)
            held = [now]
            if len(now[0]) > DISTINCT // 2:
                yield from out(now)
                held = []
    if held:
        yield from out(merged(held))


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _frequent(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by share: (lang, size, phrase, f) of the n-grams with a count of ``least`` or more, by their text."""

    def total(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).combine_chunks()
        return whole.group_by(["lang", "size", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "size", "phrase", "n"])

    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    for _, some in itertools.groupby(rows, lambda r: r["share"]):
        held, size = [], 0
        for r in some:
            held.append(pa.ipc.open_stream(r["rows"]).read_all())
            size += held[-1].num_rows
            if size > DISTINCT:
                held = [total(held)]
                size = 0
        whole = total(held)
        whole = whole.filter(pc.greater_equal(whole["n"], least)).rename_columns(["lang", "size", "phrase", "f"])
        yield from whole.combine_chunks().to_batches(max_chunksize=1 << 16)


def counts(df: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all n-grams of one to four words with f >= ``least``, and (lang, n) of all words."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    total = docs.mapInArrow(_sizes, "lang string, words long, grams long").groupBy("lang")
    total = storage.written(total.agg(F.sum("words").alias("n"), F.sum("grams").alias("grams")))
    mass = total.agg(F.sum("grams")).first()[0] or 0
    # Both the number of shares and the size of a summary grow with the square root.
    bits = min(20, max(3, math.ceil(math.log2(max(math.sqrt(mass) / 64, 1)))))
    capacity = mass // (least << bits) + 1
    sent = docs.mapInArrow(functools.partial(_dealt, bits=bits), "share int, ones binary, keys binary, counts binary")
    sent = sent.repartition("share").sortWithinPartitions("share")
    slices = sent.mapInArrow(functools.partial(_survivors, bits=bits, capacity=capacity, least=least), "share int, bits binary")
    bitmap = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    each = len(bitmap) >> bits
    for share, packed in slices.toLocalIterator():  # 32 MB in all, at any size of the corpus
        bitmap[share * each : (share + 1) * each] = np.frombuffer(zlib.decompress(packed), np.uint8)
    survivors = spark.sparkContext.broadcast(bitmap.tobytes())
    found = docs.mapInArrow(functools.partial(_texts, survivors=survivors, bits=bits), "share int, rows binary")
    found = found.repartition("share").sortWithinPartitions("share")
    found = found.mapInArrow(functools.partial(_frequent, least=least), "lang string, size int, phrase string, f long")
    return storage.written(found), total.select("lang", "n")


def collocations(df: DataFrame, least: int = 30, percent: int = 80, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line
    breaks, pieces into words at spaces and tabs. A phrase has two to four words
    and a count ``a`` of at least ``least``, overlaps included. Of its cuts into
    two parts with counts l and r, the one with the lowest
    floor(2000000 a / (l + r)) gives its score, the first of equal ones. Phrases
    inside a longer one with at least ``percent`` of their count are dropped.
    The first ``most`` by score, count and phrase (in byte order) remain. ``n``
    counts all words of the language. NULL texts are empty, a NULL language is
    ``und``, repeated rows count again. Other columns are not looked at.
    """
    f, total = counts(df, least, text, lang)
    words = F.split("phrase", " ")
    phrases = f.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))

    def part(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    cuts = phrases.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    low = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a")
    )
    # Every shorter phrase inside a phrase, with the greatest count of those around it.
    inner = phrases.where("size > 2").withColumn("words", words)
    inner = inner.withColumn("k", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)))
    inner = inner.select("lang", part(F.col("at"), F.col("k")).alias("phrase"), "a")
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = low.join(around, ["lang", "phrase"], "left")
    covered = F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(percent)}")
    kept = kept.where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within shares of a language, so that no task gets all of its phrases.
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return kept.where(F.col("rank") <= most).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
