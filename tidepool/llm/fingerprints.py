"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words; the weight of a term is the number of bytes
that it fills. For each of the samples, every term draws two gamma variables
and a uniform one from its own hash, and the term with the least value wins
(the scheme of Ioffe). Two texts agree in a sample with a probability equal to
the generalised Jaccard similarity of their weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm import words as W

SAMPLES = 64
# Pairs of term and weight whose draws a worker remembers, and rows drawn at a time.
MEMORY, CHUNK = 100_000, 8_192
_SEEDS = W.mix(np.arange(1, SAMPLES + 1, dtype=W.U) * W._M3)
_EMPTY = np.full(SAMPLES, 0xFFFF, np.uint16)


def _draw(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each term and sample its value, as a sortable number, above 16 bits that name term and level."""
    x = W.mix(term[:, None] ^ _SEEDS)
    y = W.mix(x + W._M1)
    unit = np.float32(2**-24)

    def uniform(bits: np.ndarray) -> np.ndarray:
        return ((bits & W.U(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * unit

    r = -np.log(uniform(x >> W.U(40)) * uniform(x >> W.U(16)))
    c = -np.log(uniform(y >> W.U(40)) * uniform(y >> W.U(16)))
    beta = uniform(((x & W.U(0xFFFF)) << W.U(8)) ^ (y & W.U(0xFFFF)))
    level = np.floor(np.log(weight.astype(np.float32))[:, None] / r + beta)
    value = np.log(c) - r * (level - beta) - r
    bits = value.view(np.uint32)
    ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(W.U)
    name = W.mix(x ^ (level.astype(np.int64).astype(W.U) * W._M2)) >> W.U(48)
    return (ordered << W.U(16)) | name


class Sampler:
    """Draws of the terms met so far; a worker keeps one."""

    def __init__(self) -> None:
        self.keys, self.rows = np.zeros(0, W.U), np.zeros((0, SAMPLES), W.U)

    def rows_of(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table of draws, its row for each pair of term and weight)."""
        pair = W.mix(term ^ (weight.astype(W.U) * W._M1))
        key, first, back = np.unique(pair, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        drawn = np.empty((len(key), SAMPLES), W.U)
        drawn[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        for lo in range(0, len(new), CHUNK):
            some = new[lo : lo + CHUNK]
            drawn[some] = _draw(term[first[some]], weight[first[some]])
        # Terms that came more than once here are likely to come again.
        often = np.bincount(back, minlength=len(key)) > 1
        keep = often & ~known
        if len(self.keys) + keep.sum() > MEMORY:
            self.keys, self.rows = key[often][:MEMORY], drawn[often][:MEMORY]
        elif keep.any():
            keys = np.concatenate([self.keys, key[keep]])
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], np.concatenate([self.rows, drawn[keep]])[order]
        return drawn, back


_SAMPLER = Sampler()


def signatures(column: pa.Array) -> np.ndarray:
    """16-bit samples of each text, one row per text."""
    data, offsets = W.flat(column)
    words = W.split(data, offsets, W.NOT_SPACE)
    out = np.tile(_EMPTY, (len(column), 1))
    if not len(words.start):
        return out
    h, text = W.hashes(data, words.start, words.end), words.text
    order = np.lexsort((h, text))
    h, text, size = h[order], text[order], (words.end - words.start)[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    h, text, weight = h[start], text[start], np.add.reduceat(size, start)
    drawn, row = _SAMPLER.rows_of(h, weight)
    edge = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    stop = np.append(edge[1:], len(text))
    lo = 0
    while lo < len(edge):  # texts with some tens of thousands of terms together
        hi = max(lo + 1, int(np.searchsorted(stop, edge[lo] + 4 * CHUNK, side="right")))
        if stop[hi - 1] - edge[lo] > 4 * CHUNK:  # one long text, in slices
            best = np.full(SAMPLES, W.U(2**64 - 1))
            for a in range(edge[lo], stop[lo], 4 * CHUNK):
                best = np.minimum(best, drawn[row[a : min(a + 4 * CHUNK, stop[lo])]].min(axis=0))
            least = best[None, :]
        else:
            least = np.minimum.reduceat(drawn[row[edge[lo] : stop[hi - 1]]], edge[lo:hi] - edge[lo], axis=0)
        out[text[edge[lo:hi]]] = (least & W.U(0xFFFF)).astype(np.uint16)
        lo = hi
    return out


def written(samples: np.ndarray) -> pa.Array:
    """Fingerprints as text: four hexadecimal digits a sample."""
    return pa.array([row.astype(">u2").tobytes().hex() for row in samples], pa.string())


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text, a string of four hexadecimal digits a sample.

    Equal texts have equal fingerprints. NULL, empty and blank texts share one.
    Rows and other columns stay; a column of the new name is replaced.
    """

    def make():
        return lambda column: [written(signatures(column))]

    return W.add_columns(df, text, f"`{name}` string", make)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints: an estimate of generalised Jaccard similarity."""
    same = lambda n, i: n + (F.substring(a, i, F.lit(4)) == F.substring(b, i, F.lit(4))).cast("int")
    starts = F.sequence(F.lit(1), F.lit(4 * SAMPLES - 3), F.lit(4))
    return F.aggregate(starts, F.lit(0), same) / SAMPLES


# Documents of one stretch of the order, and at most so many stretches.
STRETCH, STRETCHES = 1_000, 10_000


def _place(key: Column, cuts: Sequence[int]) -> Column:
    """How many of the descending cuts are above the key, by binary search; NULL keys come last."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    table = F.lit(list(cuts)).cast("array<bigint>")
    found = F.aggregate(
        F.lit(steps), F.lit(0), lambda at, s: at + F.when(F.get(table, at + s - 1) > key, s).otherwise(F.lit(0))
    )
    return F.when(key.isNull(), len(cuts)).otherwise(found)


def with_successors(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(stretch, after, key, text) where each stretch of the order also holds its successor.

    The order is by descending key, equal keys by text, NULL keys last; the
    first document follows the last. Rows with ``after`` belong to the next
    stretch. The rows are sorted within partitions, a stretch in one partition;
    only cut points and the first key of each stretch come to the driver.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = docs.where(F.col("key").isNotNull()).count()
    count = max(1, min(STRETCHES, n // STRETCH))
    cuts = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        cuts = docs.agg(F.percentile_approx("key", shares, 100 * count).alias("cuts")).first()["cuts"]
    placed = docs.withColumn("stretch", _place(F.col("key"), sorted(set(cuts), reverse=True)))
    heads = placed.groupBy("stretch").agg(F.max("key").alias("head")).orderBy("stretch").collect()
    if not heads:
        return placed.select("stretch", F.lit(0).alias("after"), "key", "text")
    size = max(r["stretch"] for r in heads) + 1
    head, before = [None] * size, [None] * size
    for i, r in enumerate(heads):
        head[r["stretch"]], before[r["stretch"]] = r["head"], heads[i - 1]["stretch"]
    own, to = (F.get(F.lit(x).cast("array<bigint>") if any(v is not None for v in x) else F.array(F.lit(None).cast("bigint")), F.col("stretch")) for x in (head, before))
    places = F.when(F.col("key").eqNullSafe(own), F.array(F.col("stretch").cast("long"), to)).otherwise(
        F.array(F.col("stretch").cast("long"))
    )
    sent = placed.select(F.posexplode(places).alias("after", "stretch"), "key", "text")
    return sent.repartition("stretch").sortWithinPartitions("stretch", "after", F.desc_nulls_last("key"), "text")


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str], np.ndarray, list[str], np.ndarray]]:
    """From rows of ``with_successors``: keys, texts, samples, next texts and next samples."""
    held: tuple | None = None
    for part in W.parts(batches, "text", W.PART_BYTES // 2):
        keys = part.column(part.schema.get_field_index("key")).to_pylist()
        texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        after = part.column(part.schema.get_field_index("after")).to_pylist()
        samples = signatures(part.column(part.schema.get_field_index("text")))
        if held:
            keys, texts, after = [held[0], *keys], [held[1], *texts], [held[2], *after]
            samples = np.concatenate([held[3][None], samples])
        held = (keys[-1], texts[-1], after[-1], samples[-1])
        own = [i for i in range(len(keys) - 1) if not after[i]]
        if own:
            yield (
                [keys[i] for i in own], [texts[i] for i in own], samples[own],
                [texts[i + 1] for i in own], samples[[i + 1 for i in own]],
            )
