"""Hard negatives of anchors by exact integer scores in packed products.

A vector becomes integers by ``floor(scale * x)``; a score is an inner product.
Components of several candidates are biased to be non-negative and packed into
separate fields of one wide integer, so that one multiplication per component
of the anchor serves all of them; the fields of the sum are unpacked into exact
scores. The wide integer is a double, which holds 53 bits exactly, so a whole
tile of packed products is one matrix product. Where a single field would be
too narrow, components are first cut into digits.

Vectors are packed into blocks of rows in the shared folder. Stripes of anchors
meet parts of all rows in cells of bounded size: this is the stated query set
against all rows, and only lists of bounded length leave a cell. A label that
holds a third of all rows is spread over cells like any other.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidepool.llm import storage
from tidepool.llm.words import bounds, spread

# Bits that a double holds exactly, and rows of a block and of one side of a tile.
BITS, BLOCK_ROWS, TILE_ROWS = 53, 4096, 1024
# Anchors of a stripe, and multiplications of a cell where a part is larger than a stripe.
STRIPE_ROWS, CELL_WORK = 1 << 17, 1 << 29
# The largest scores that thirty-eight digits hold.
_MOST = 10**38 - 1
_BLOCK = "block long, n int, dims int, kind string, keys binary, labels binary, vectors binary"


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Digits of ``bits`` bits with the sign of the number, lowest first, as doubles."""
    sign, rest, out = np.where(x < 0, -1, 1), np.abs(x), []
    while not out or (rest != 0).any():
        out.append((rest % (1 << bits) * sign).astype(np.float64))
        rest = rest // (1 << bits)
    return out


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows of ``a`` with those of ``c``, as int64 or Python integers."""
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    low = int(c.min())
    span = int(c.max()) - low
    ones = int(np.abs(a.astype(object)).sum(axis=1).max()) if a.dtype == object else int(np.abs(a).sum(axis=1, dtype=np.float64).max())
    bound = ones * max(span, 1)
    if bound < 1 << (BITS - 1) and a.dtype != object and c.dtype != object:
        return _packed(a, c, low, bound)
    bits = (BITS - 1 - a.shape[1].bit_length()) // 2
    small = ones * max(abs(low), abs(low + span)) < 1 << 56
    total = np.zeros((len(a), len(c)), np.int64 if small else object)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(_limbs(c, bits)):
            part = (x @ y.T).astype(np.int64)
            total = total + (part if small else part.astype(object)) * (1 << bits * (i + j))
    return total


def _packed(a: np.ndarray, c: np.ndarray, low: int, bound: int) -> np.ndarray:
    width = bound.bit_length() + 1
    fields = BITS // width
    each = -(-len(c) // fields)
    wide = np.zeros((each, c.shape[1]))
    for j in range(fields):  # field j of row i holds candidate j * each + i
        biased = c[j * each : (j + 1) * each] - low
        wide[: len(biased)] += biased * float(1 << (width * j))
    half = 1 << (width - 1)
    total = (a.astype(np.float64) @ wide.T).astype(np.int64)
    total += sum(half << (width * j) for j in range(fields))
    out = np.empty((len(a), each * fields), np.int64)
    mask = (1 << width) - 1
    for j in range(fields):
        out[:, j * each : (j + 1) * each] = ((total >> (width * j)) & mask) - half
    return out[:, : len(c)] + low * a.sum(axis=1, dtype=np.int64)[:, None]


def _pack(batches: Iterable[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    base, number = TaskContext.get().partitionId() << 24, itertools.count()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def out(rows: list) -> pa.RecordBatch:
        keys, labels = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        size = np.concatenate([r[2] for r in rows])
        with np.errstate(over="ignore"):
            x = np.floor(np.concatenate([r[3] for r in rows]) * scale)
        dims = int(size.max()) if len(size) else 0
        row = np.repeat(np.arange(len(size)), size)
        ok = np.ones(len(size), bool)
        ok[row[~np.isfinite(x)]] = False
        whole = np.zeros((len(size), dims))
        whole[row, spread(np.zeros(len(size), np.int64), size)] = x
        whole, keys, labels = whole[ok], keys[ok], labels[ok]
        top = np.abs(whole).max() if whole.size else 0
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
        values = [base + next(number), len(keys), dims, kind, keys.astype("<i8").tobytes(), labels.astype("<i8").tobytes(), whole.astype(kind).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _names())

    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            vector = part.column("vector")
            size = np.asarray(vector.value_lengths(), np.int64)
            held.append((np.asarray(part.column("key")), np.asarray(part.column("label")), size, np.asarray(vector.flatten(), np.float64)))
            if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                yield out(held)
                held = []
    if held:
        yield out(held)


def _names() -> list[str]:
    return [f.split()[0] for f in _BLOCK.split(", ")]


def _matrix(rows: list[dict], dims: int) -> np.ndarray:
    """The vectors of blocks as one integer matrix of ``dims`` components; missing ones are 0."""
    out = []
    for r in rows:
        x = np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["dims"])[:, :dims]
        if r["kind"] == "<f8":
            x = np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
        else:
            x = x.astype(np.int64)
        out.append(np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x)
    return np.concatenate(out) if out else np.zeros((0, dims), np.int64)


def _whole(rows: list[dict], name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], "<i8") for r in rows]) if rows else np.zeros(0, np.int64)


class Best:
    """The best ``most`` (score, key) of each row: higher scores first, ties by smaller key."""

    def __init__(self, rows: int, most: int):
        self.score = np.zeros((rows, most), object)
        self.key = np.zeros((rows, most), np.int64)
        self.has = np.zeros((rows, most), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, allowed: np.ndarray, keys: np.ndarray) -> None:
        """Offer a tile; its columns are in the order of ``keys``."""
        if not len(rows) or not len(keys):
            return
        least = -(10**400) if score.dtype == object else np.iinfo(np.int64).min
        left = np.where(allowed, score, least)
        at = np.arange(len(rows))
        found, most = [], self.score.shape[1]
        for _ in range(min(most, len(keys))):
            best = left.argmax(axis=1)  # the first of equal ones has the least key
            found.append((left[at, best], keys[best], left[at, best] != least))
            left[at, best] = least
        live = np.flatnonzero(np.any([f[2] for f in found], axis=0))
        rows = rows[live]
        score = np.concatenate([self.score[rows], np.stack([f[0][live] for f in found], axis=1)], axis=1)
        key = np.concatenate([self.key[rows], np.stack([f[1][live] for f in found], axis=1)], axis=1)
        has = np.concatenate([self.has[rows], np.stack([f[2][live] for f in found], axis=1)], axis=1)
        row = np.repeat(np.arange(len(rows)), score.shape[1])
        flat = score.ravel()
        order = np.lexsort((key.ravel(), -(flat if (np.abs(flat) >= 1 << 62).any() else flat.astype(np.int64)), ~has.ravel(), row))
        order = order.reshape(len(rows), -1)[:, :most]
        self.score[rows], self.key[rows], self.has[rows] = flat[order], key.ravel()[order], has.ravel()[order]


def _decimals(values: np.ndarray) -> pa.Array:
    return pa.array([Decimal(max(-_MOST, min(_MOST, int(v)))) for v in values], pa.decimal128(38, 0))


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[list[dict]]]]:
    """For each cell its blocks of anchors, and its candidates in groups of about BLOCK_ROWS rows."""
    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    for _, cell in itertools.groupby(rows, lambda r: r["cell"]):
        sides = itertools.groupby(cell, lambda r: r["side"])
        anchors: list[dict] = []
        for side, part in sides:
            if side == 0:
                anchors = list(part)
            elif anchors:
                yield anchors, _groups(part)


def _groups(rows: Iterable[dict]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if sum(h["n"] for h in held) >= BLOCK_ROWS:
            yield held
            held = []
    if held:
        yield held


def _candidates(rows: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = _whole(rows, "keys")
    order = np.argsort(key, kind="stable")
    return key[order], _whole(rows, "labels")[order], _matrix(rows, dims)[order]


def _emit(blocks: list[dict], best: Best, rank: int | None) -> pa.RecordBatch:
    row, at = np.nonzero(best.has)
    edge = bounds(np.array([b["n"] for b in blocks]))
    of = np.searchsorted(edge, row, side="right") - 1
    block = np.array([b["block"] for b in blocks], np.int64)[of]
    columns = [pa.array(block), pa.array((row - edge[of]).astype(np.int32)), pa.array(best.key[row, at]), _decimals(best.score[row, at])]
    names = ["block", "row", "other", "score"]
    if rank is not None:
        columns.append(pa.array(np.full(len(row), rank, np.int32)))
        names.append("place")
    return pa.RecordBatch.from_arrays(columns, names)


def _positives(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for blocks, groups in _cells(batches):
        dims = max(b["dims"] for b in blocks)
        a, key, label = _matrix(blocks, dims), _whole(blocks, "keys"), _whole(blocks, "labels")
        best = Best(len(key), most)
        order = np.argsort(label, kind="stable")
        names, start = np.unique(label[order], return_index=True)
        of = dict(zip(names.tolist(), np.split(order, start[1:])))
        for rows in groups:
            keys, labels, c = _candidates(rows, dims)
            for name in np.unique(labels).tolist():
                column = np.flatnonzero(labels == name)
                mine = of.get(name, np.zeros(0, np.int64))
                for lo in range(0, len(mine), TILE_ROWS):
                    row = mine[lo : lo + TILE_ROWS]
                    best.add(row, scores(a[row], c[column]), key[row][:, None] != keys[column][None], keys[column])
        yield _emit(blocks, best, None)


def _negatives(batches: Iterable[pa.RecordBatch], most: int, low: int, high: int, percent: int) -> Iterator[pa.RecordBatch]:
    for blocks, groups in _cells(batches):
        dims = max(b["dims"] for b in blocks)
        a, key, label = _matrix(blocks, dims), _whole(blocks, "keys"), _whole(blocks, "labels")
        edge = bounds(np.array([b["n"] for b in blocks]))
        said = [(e + t["row"], t["place"] - 1, int(t["score"])) for e, b in zip(edge, blocks) for t in b["positives"] or ()]
        places = max((s[1] for s in said), default=-1) + 1
        # Scores between these bounds, both included; none where a positive is missing.
        lowest, highest = np.ones((len(key), places), object), np.zeros((len(key), places), object)
        for row, place, score in said:
            lowest[row, place], highest[row, place] = -(-low * score // percent), high * score // percent
        if (np.abs(lowest) < 1 << 62).all() and (np.abs(highest) < 1 << 62).all():
            lowest, highest = lowest.astype(np.int64), highest.astype(np.int64)
        best = [Best(len(key), most) for _ in range(places)]
        for rows in groups:
            keys, labels, c = _candidates(rows, dims)
            for lo in range(0, len(key), TILE_ROWS):
                row = np.arange(lo, min(lo + TILE_ROWS, len(key)))
                found = scores(a[row], c)
                other = label[row][:, None] != labels[None]
                for p in range(places):
                    allowed = other & (found >= lowest[row, p][:, None]) & (found <= highest[row, p][:, None])
                    best[p].add(row, found, allowed, keys)
        for p in range(places):
            yield _emit(blocks, best[p], p + 1)


def _met(anchors: DataFrame, blocks: DataFrame, stripes: int, parts: int) -> DataFrame:
    """Rows of the cells: each stripe of anchors with each part of all rows."""
    extra = [] if "positives" in anchors.columns else [F.lit(None).cast("array<struct<row:int,place:int,score:decimal(38,0)>>").alias("positives")]
    a = anchors.select("*", *extra, F.pmod(F.xxhash64("block"), F.lit(stripes)).alias("stripe"), F.lit(0).alias("side"))
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    c = blocks.select("*", F.lit(None).cast(a.schema["positives"].dataType).alias("positives"), F.lit(1).alias("side"))
    c = c.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"))
    c = c.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    rows = a.unionByName(c).withColumn("cell", F.col("stripe") * parts + F.col("part"))
    return rows.repartition(min(4 * stripes * parts, 10_000), "cell").sortWithinPartitions("cell", "side", "block")


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, percent: int = 100, scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of each row where ``anchor`` holds.

    An anchor's positives are the best ``positives`` rows of its label; for each
    of them, the best ``negatives`` rows of another label whose score is between
    ``low`` and ``high`` of ``percent`` of the positive's. Ties go to the smaller
    key. Rows with a NULL key, label, vector or component, or a component that is
    not finite (also after scaling), take no part. A missing component of a
    shorter vector is 0, so an empty vector scores 0. Rows with the key of the
    anchor are never its positives or negatives; other repeated rows each count,
    and equal anchors are one. Labels are whole numbers, or are compared by a
    64-bit hash. Scores are exact; one beyond 64 bits is NULL, one beyond 38
    digits counts as the largest of 38. Other columns are not looked at.
    """
    kind = dict(df.dtypes)[label]
    name = F.col(label).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(label)
    x = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()
    rows = df.where(ok).select(F.col(key).cast("long").alias("key"), name.alias("label"), x.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    pack = functools.partial(_pack, scale=scale)
    own = ["key", "label", "vector"]
    blocks = storage.written(rows.select(own).mapInArrow(pack, _BLOCK))
    asking = storage.written(rows.where("asks").select(own).dropDuplicates().mapInArrow(pack, _BLOCK))
    n, dims = blocks.agg(F.sum("n"), F.max("dims")).first()
    n_anchors = asking.agg(F.sum("n")).first()[0] or 0
    stripe = min(max(n_anchors, 1), STRIPE_ROWS)
    stripes = -(-max(n_anchors, 1) // stripe)
    parts = -(-(n or 1) // max(CELL_WORK // (stripe * max(dims or 1, 1)), stripe))
    found = "block long, row int, other long, score decimal(38,0)"
    near = _met(asking, blocks, stripes, parts).mapInArrow(functools.partial(_positives, most=positives), found)
    best = Window.partitionBy("block", "row").orderBy(F.desc("score"), "other")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    near = storage.written(near)
    held = near.groupBy("block").agg(F.collect_list(F.struct("row", "place", "score")).alias("positives"))
    far = _met(asking.join(held, "block", "left"), blocks, stripes, parts)
    far = far.mapInArrow(functools.partial(_negatives, most=negatives, low=low, high=high, percent=percent), found + ", place int")
    best = Window.partitionBy("block", "row", "place").orderBy(F.desc("score"), "other")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    far = far.select("block", "row", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("block", "row", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    keys = asking.select("block", "keys").mapInArrow(_keys, "block long, row int, anchor_id long")
    out = far.join(near, ["block", "row", "place"]).join(keys, ["block", "row"])
    return out.select(
        "anchor_id", "positive_id", "rank", "negative_id",
        F.col("positive_score").try_cast("long").alias("positive_score"), F.col("negative_score").try_cast("long").alias("negative_score"),
    )


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key of each row of each block."""
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], "<i8")
            columns = [np.full(len(keys), r["block"]), np.arange(len(keys), dtype=np.int32), keys]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "row", "anchor_id"])
