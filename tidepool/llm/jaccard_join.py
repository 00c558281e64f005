"""Documents joined by the Jaccard similarity of their shingles, exactly.

Shingles have one global order, rare ones first. If two sets are similar, the
first l shingles they share lie in the first ``n - required + l`` of both, for
every l. Each document chooses its own l: a longer prefix costs more meetings,
but asks for more shared shingles before two sets are compared in full, and the
counts of its own shingles say which is cheaper. Two documents must share as
many prefix shingles as the smaller of their two l.

Equal sets are one set. Documents that share a prefix shingle form a bucket, and
``meetings`` links them: first each set with the one it shares most with, then
every pair of a bucket in different components that the filters by size, place
and parity leave. No pair that could be similar is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm import meetings, storage
from tidepool.llm import words as W
from tidepool.llm.repeats import _pack

WORDS, PERCENT = 4, 85
# Prefixes are lengthened by at most so many shingles; a full comparison costs as much as so many meetings.
LONGEST, FULL = 8, 16
# Distinct shingles of a share of the counts, and shingles compared with one set in a task.
SHARE, GROUP = 1 << 22, 1 << 18
# Counts are sent as one byte: as they are below 128, by powers of 2 ** (1 / 8) beyond.
_COUNT = np.concatenate([np.arange(128), 128 * 2 ** (np.arange(128) / 8)])


def shingles(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text and hash."""
    data, offsets = W.flat(column)
    data = W.LOWER[data]
    words = W.split(data, offsets, W.NOT_SPACE)
    h = W.hashes(data, words.start, words.end)
    n, of = words.count, words.text
    at = np.flatnonzero(words.left() >= size)
    x, text = [W.windows(h, at, size)], [of[at]]
    for short in range(1, size):  # the whole sequence of a shorter text
        has = np.flatnonzero(n == short)
        x.append(W.mix(W.windows(h, words.first[:-1][has], short) + W.U(short)))
        text.append(has)
    x, text = np.concatenate(x), np.concatenate(text)
    order = np.lexsort((x, text))
    x, text = x[order], text[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return text[new], x[new]


def _digests(column: pa.Array, size: int) -> list[pa.Array]:
    text, x = shingles(column, size)
    n = np.bincount(text, minlength=len(column))
    start = W.bounds(n)[:-1]
    a, b = np.zeros(len(n), W.U), np.zeros(len(n), W.U)
    has = np.flatnonzero(n)
    if len(has):
        a[has] = np.add.reduceat(W.mix(x ^ W._M1), start[has])
        b[has] = np.add.reduceat(W.mix(x ^ W._M2), start[has])
    return [pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]


class Block:
    """The sets of a block of texts: shingles by text and hash, and their place in the counts."""

    def __init__(self, rows: bytes, size: int):
        self.batch = pa.ipc.open_stream(rows).read_next_batch()
        self.keys = np.asarray(self.batch.column("key"))
        self.text, self.x = shingles(self.batch.column("text"), size)
        self.n = np.bincount(self.text, minlength=len(self.keys))

    def entries(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct short hashes, the place of each shingle among them, their counts, and the edges of the shares."""
        short, of, count = np.unique(self.x >> W.U(32 - bits), return_inverse=True, return_counts=True)
        return short, of, count, np.searchsorted(short, np.arange((1 << bits) + 1, dtype=W.U) << W.U(32))


def _send(batches: Iterable[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            short, _, count, edge = Block(row["rows"], size).entries(bits)
            used = np.flatnonzero(np.diff(edge))
            low, n = short.astype(np.uint32), np.minimum(count, 65535).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array(np.full(len(used), row["block"]), pa.int64()),
                    pa.array([low[edge[i] : edge[i + 1]].tobytes() for i in used], pa.binary()),
                    pa.array([n[edge[i] : edge[i + 1]].tobytes() for i in used], pa.binary()),
                ],
                ["share", "block", "keys", "counts"],
            )


def _count(rows: pa.Table) -> pa.Table:
    """The total count of each entry of a share, as one byte."""
    keys = [np.frombuffer(k.as_py(), np.uint32) for k in rows["keys"]]
    counts = np.concatenate([np.frombuffer(c.as_py(), np.uint16) for c in rows["counts"]]).astype(np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    total = np.repeat(np.add.reduceat(counts[order], start), np.diff(np.append(start, len(flat))))
    code = np.empty(len(flat), np.uint8)
    code[order] = np.minimum(np.searchsorted(_COUNT, total, side="right") - 1, 255)
    edge = W.bounds(np.array([len(k) for k in keys]))
    out = [code[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]
    return pa.table({"share": rows["share"], "block": rows["block"], "codes": pa.array(out, pa.binary())})


def chosen(n: np.ndarray, start: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, length of the prefix) of each set; ``count`` holds the counts of its shingles, rare ones first."""
    required = -(-percent * n // 100)
    met = W.bounds(np.maximum(count.astype(np.int64) - 1, 0))
    best, l, length = np.full(len(n), np.inf), np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
    for more in range(1, LONGEST + 1):
        end = n - required + more
        meetings = met[start + np.minimum(end, n)] - met[start]
        cost = np.where(more <= required, meetings * (1 + FULL / more), np.inf)
        better = cost < best
        best[better], l[better], length[better] = cost[better], more, end[better]
    return l, length


def _prefixes(batches: Iterable[pa.RecordBatch], size: int, bits: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["rows"], size)
            short, of, _, edge = block.entries(bits)
            code = np.zeros(len(short), np.uint8)
            for v in row["codes"] or ():
                code[edge[v["share"]] : edge[v["share"] + 1]] = np.frombuffer(v["codes"], np.uint8)
            code = code[of]
            order = np.lexsort((block.x, code, block.text))
            code, x, n = code[order], block.x[order], block.n
            start = W.bounds(n)[:-1]
            l, length = chosen(n, start, _COUNT[code], percent)
            place = np.arange(len(x)) - np.repeat(start, n)
            at = np.flatnonzero((place < np.repeat(length, n)) & (code > 1))
            per = np.bincount(block.text[at], minlength=len(n))
            has = np.flatnonzero(per)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(has), row["block"]), pa.int64()),
                    pa.array(block.keys[has]),
                    pa.array(n[has]),
                    pa.array(l[has].astype(np.int32)),
                    W.lists_of(pa.array(x[at].view(np.int64)), per[has]),
                    W.lists_of(pa.array(place[at].astype(np.int32)), per[has]),
                    meetings.parities(block.text, block.x, len(n)).take(pa.array(has)),
                ],
                ["block", "key", "n", "l", "tokens", "places", "bits"],
            )


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, shingles) of the wanted sets of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["rows"], size)
            at = W.bounds(block.n)
            wanted = np.flatnonzero(np.isin(block.keys, np.array(row["wanted"], np.int64)))
            for lo in range(0, len(wanted), 1024):
                some = wanted[lo : lo + 1024]
                blobs = pa.array([block.x[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block.keys[some]), blobs], ["key", "shingles"])


def _overlap(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, part, member): the set ``rep`` comes first, then those it is compared with."""
    first, rep = np.zeros(0, W.U), None
    for batch in batches:
        out = []
        for lo in range(0, batch.num_rows, 256):
            for r in batch.slice(lo, 256).to_pylist():
                x = np.frombuffer(r["shingles"], W.U)
                if not r["member"]:
                    first, rep = x, r["rep"]
                elif rep == r["rep"]:
                    a, b = (first, x) if len(first) > len(x) else (x, first)
                    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
                    out.append((r["key"], rep, 100 * both >= percent * (len(a) + len(b) - both)))
        kinds = [pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["key", "rep", "similar"]
        )


def _verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, rep, similar) of distinct pairs (key, rep); sets that share too few prefix shingles are not compared."""
    a = prefixes.select("key", F.col("l").alias("l_a"), F.col("tokens").alias("a"), "n")
    b = prefixes.select(F.col("key").alias("rep"), F.col("l").alias("l_b"), F.col("tokens").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    pairs = pairs.join(a, "key").join(b, "rep").where(shared >= F.least("l_a", "l_b")).select("key", "rep", "n")
    pairs = storage.written(pairs)
    total = pairs.groupBy("rep").agg(F.greatest(F.ceil(F.sum("n") / GROUP), F.lit(1)).cast("int").alias("parts"))
    members = pairs.join(total, "rep").select("key", "rep", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"))
    firsts = total.select(F.col("rep").alias("key"), "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    rows = members.unionByName(firsts).join(sets.hint("merge"), "key")
    rows = rows.repartition("rep", "part").sortWithinPartitions("rep", "part", "member")
    return storage.written(rows.mapInArrow(functools.partial(_overlap, percent=percent), "key long, rep long, similar boolean"))


def _near(percent: int, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be similar, if the first one they share is at the places i and j."""
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & ((100 + percent) * np.minimum(n - i, m - j) >= percent * (n + m))


def _most(percent: int, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two similar sets has."""
    return (100 - percent) * (n + m) // (100 + percent)


def _links(blocks: DataFrame, size: int, percent: int, words: int) -> DataFrame:
    """(key, rep) of similar sets: enough of them to connect every component."""
    bits = min(24, max(3, int(words / SHARE).bit_length()))
    sent = blocks.mapInArrow(functools.partial(_send, size=size, bits=bits), "share int, block long, keys binary, counts binary")
    codes = sent.groupBy("share").applyInArrow(_count, "share int, block long, codes binary")
    codes = codes.groupBy("block").agg(F.collect_list(F.struct("share", "codes")).alias("codes"))
    cut = functools.partial(_prefixes, size=size, bits=bits, percent=percent)
    schema = "block long, key long, n long, l int, tokens array<long>, places array<int>, bits binary"
    prefixes = storage.written(blocks.hint("merge").join(codes, "block").mapInArrow(cut, schema))
    token = prefixes.select("key", "n", "block", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    token = token.select(F.col("t.tokens").alias("bucket"), F.col("t.places").alias("place"), "key", "n", "block")
    storage.forget(prefixes)
    members = storage.written(token.join(meetings.without_copies(token), "bucket"))
    storage.forget(members)
    wanted = members.groupBy("block").agg(F.collect_set("key").alias("wanted"))
    sets = blocks.hint("merge").join(wanted, "block").mapInArrow(functools.partial(_sets, size=size), "key long, shingles binary")
    sets = storage.written(sets)
    return meetings.linked(
        members.drop("block"), prefixes.select("key", "bits"), lambda pairs: _verified(pairs, prefixes, sets, percent),
        percent, functools.partial(_near, percent), functools.partial(_most, percent),
    )


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of each row: components of documents linked by similar sets.

    A set holds the distinct shingles of ``size`` words of the text, lower-cased
    (A-Z); a shorter text is one shingle, a text without words or NULL an empty
    set. Two sets link if ``percent`` of their union is shared, at least; empty
    ones link with nothing. ``component_id`` is the least key that links reach;
    rows with a NULL key take part, and have NULL if nothing else is reached.
    Repeated rows are rows of their own. Shingles are 64-bit hashes, equal sets
    are told by 128 bits. Other columns are not looked at.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("text", T.StringType())])
    for name in ("n", "a", "b"):
        schema = W.with_field(schema, name, T.LongType())

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, *_digests(part.column("text"), size)], ["id", "text", "n", "a", "b"])

    rows = storage.written(docs.mapInArrow(digest, schema))
    # A set is its digest; one text of each stands for it.
    one = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    one = one.withColumn("key", F.monotonically_increasing_id())
    blocks = storage.written(one.mapInArrow(functools.partial(_pack, text="text"), "block long, size long, rows binary"))
    words = rows.agg(F.sum("n")).first()[0] or 0
    found = _links(blocks, size, percent, words)
    roots = meetings.components(found.select(F.col("key").alias("a"), F.col("rep").alias("b")))

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.ipc.open_stream(row["rows"]).read_next_batch().select(["n", "a", "b", "id", "key"])

    known = T.StructType([*(schema[n] for n in ("n", "a", "b", "id")), T.StructField("key", T.LongType())])
    known = blocks.select("rows").mapInArrow(names, known).join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = storage.written(known.select("n", "a", "b", "id", F.coalesce("root", "key").alias("root")))
    least = storage.written(known.groupBy("root").agg(F.min("id").alias("component_id")))
    known = storage.written(known.join(least, "root").select("n", "a", "b", "component_id"))
    out = rows.select("id", "n", "a", "b").join(known, ["n", "a", "b"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
