"""Benchmark decontamination by multi-pattern search with block shifts.

The patterns are all windows of consecutive words of the benchmark texts, found
as Wu and Manber do, with words for letters. A table over blocks of two words
says how far the search may skip; where it may not, the hash of the last block
selects the few patterns to compare directly, word by word and byte by byte.
Many places of many texts advance together, in numpy.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm import words as W

# Benchmark texts are searched for in blocks of about this many bytes, each
# held by every worker; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
# Places searched one after the other; all such runs advance together.
RUN = 256


@dataclass
class Table:
    """Patterns of one length: shifts by block, and patterns by last block."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    first: np.ndarray  # of each block, its first pattern
    words: np.ndarray  # of each pattern, the hashes of its words
    texts: list[bytes]
    owners: list[np.ndarray]  # of each pattern, the numbers of its items

    def slot(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        both = last if self.block == 1 else before * W._M2 + last
        return (W.mix(both) >> W.U(64 - self.bits)).astype(np.int64)


def normal(column: pa.Array) -> tuple[W.Words, np.ndarray]:
    """Lower-cased words of letters, digits and all beyond ASCII, and their hashes."""
    data, offsets = W.flat(column)
    words = W.split(W.LOWER[data], offsets, W.LETTER_OR_DIGIT)
    return words, W.hashes(words.data, words.start, words.end)


def tables(texts: Sequence[str | None], window: int) -> list[Table]:
    """Search tables for all windows of the items, one for each pattern length."""
    words, h = normal(pa.array(texts, pa.string()))
    data = words.data.tobytes()
    owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    hashed: dict[tuple[bytes, ...], np.ndarray] = {}
    for item, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:])):
        size = min(window, hi - lo)
        for i in range(lo, hi - size + 1) if size else ():
            key = tuple(data[words.start[k] : words.end[k]] for k in range(i, i + size))
            owners[key].add(item)
            hashed[key] = h[i : i + size]
    out = []
    for length in sorted({len(k) for k in owners}):
        keys = [k for k in owners if len(k) == length]
        grid = np.stack([hashed[k] for k in keys])
        block = min(2, length)
        bits = max(8, (8 * len(keys)).bit_length())
        table = Table(length, block, bits, np.full(1 << bits, length - block + 1, np.int32), None, None, [], [])
        for j in range(block - 1, length):  # the least skip that can end a pattern here
            slot = table.slot(grid[:, j - 1], grid[:, j])
            np.minimum.at(table.shift, slot, length - 1 - j)
        order = np.argsort(slot, kind="stable")
        table.first = np.searchsorted(slot[order], np.arange((1 << bits) + 1))
        table.words = grid[order]
        table.texts = [b" ".join(keys[i]) for i in order]
        table.owners = [np.array(sorted(owners[keys[i]])) for i in order]
        out.append(table)
    return out


def search(words: W.Words, h: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(first word, pattern) of every occurrence."""
    m = table.length
    last = np.maximum(words.first[1:] - words.first[:-1] - m + 1, 0)  # places where a pattern can end
    runs = -(-last // RUN)
    at = words.first[:-1].repeat(runs) + m - 1 + W.spread(np.zeros(len(runs), np.int64), runs) * RUN
    stop = np.minimum(at + RUN, words.first[1:].repeat(runs))
    found = []
    while len(at):
        slot = table.slot(h[at - 1], h[at])
        skip = table.shift[slot]
        here = skip == 0
        if here.any():
            found.append((at[here], slot[here]))
        at = at + np.maximum(skip, 1)
        go = at < stop
        at, stop = at[go], stop[go]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, slot = (np.concatenate(x) for x in zip(*found))
    size = table.first[slot + 1] - table.first[slot]
    pattern = W.spread(table.first[slot], size)
    at = np.repeat(at, size) - m + 1
    for j in range(m):  # direct comparison, first the words' hashes
        same = h[at + j] == table.words[pattern, j]
        at, pattern = at[same], pattern[same]
    data = words.data.tobytes()
    equal = np.zeros(len(at), bool)
    for k, (i, p) in enumerate(zip(at.tolist(), pattern.tolist())):  # then their bytes
        lo, hi = words.start[i : i + m].tolist(), words.end[i : i + m].tolist()
        equal[k] = b" ".join([data[a:b] for a, b in zip(lo, hi)]) == table.texts[p]
    return at[equal], pattern[equal]


@functools.lru_cache(maxsize=2)
def _cached(texts: tuple[str | None, ...], window: int) -> list[Table]:
    return tables(texts, window)


def _runs(covered: np.ndarray, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs per text, starts, ends) of covered words, counted in their text."""
    inside = np.append(covered, False)
    before = np.concatenate([[False], covered])
    edge = np.zeros(len(covered) + 1, bool)
    edge[words.first] = True
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    text = words.text[start]
    base = words.first[:-1][text]
    return np.bincount(text, minlength=len(words.first) - 1), start - base, end - base


FIELDS = "n_words int, hits array<struct<start:int,end:int>>, items array<string>"


def _search(
    batches: Iterable[pa.RecordBatch], items: tuple[tuple[str | None, str | None], ...], window: int, text: str
) -> Iterator[pa.RecordBatch]:
    found = _cached(tuple(t for _, t in items), window)
    names = np.array(["" if i is None else i for i, _ in items], object)
    for part in W.parts(batches, text):
        column = part.column(part.schema.get_field_index(text))
        words, h = normal(column)
        n, texts = words.count, words.text
        change = np.zeros(len(h) + 1, np.int32)
        pairs = []
        for table in found:
            at, pattern = search(words, h, table)
            np.add.at(change, at, 1)
            np.add.at(change, at + table.length, -1)
            size = np.array([len(table.owners[p]) for p in pattern], np.int64)
            who = [table.owners[p] for p in pattern]
            if who:
                pairs.append(np.repeat(texts[at], size) * len(items) + np.concatenate(who))
        earlier = "hits" in part.schema.names
        if earlier:  # hits of an earlier block of items
            hits = part.column(part.schema.get_field_index("hits"))
            base = np.repeat(words.first[:-1], np.asarray(hits.value_lengths()))
            np.add.at(change, base + np.asarray(hits.flatten().field("start")), 1)
            np.add.at(change, base + np.asarray(hits.flatten().field("end")), -1)
        per_text, start, end = _runs(np.cumsum(change)[:-1] > 0, words)
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        owner, item = np.divmod(both, max(len(items), 1))
        listed = [sorted(set(x)) for x in np.split(names[item], np.searchsorted(owner, np.arange(1, len(n))))]
        if earlier:
            old = part.column(part.schema.get_field_index("items")).to_pylist()
            listed = [sorted({*a, *b}) for a, b in zip(old, listed)]
        part = W.with_column(part, "n_words", pa.array(n, pa.int32()))
        part = W.with_column(part, "hits", W.lists_of(spans, per_text))
        yield W.with_column(part, "items", pa.array(listed[: part.num_rows], pa.list_(pa.string())))


def mark(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """Add ``n_words``, ``hits`` and ``items`` to each row of ``df``.

    Words are runs of letters, digits and characters beyond ASCII, with A-Z in
    lower case. A pattern is ``window`` consecutive words of a text of
    ``items``; a shorter text, unless it has no words, is one pattern. ``hits``
    are the ranges of words inside occurrences, joined where they touch or
    overlap; ``items`` are the ids, as sorted strings, of the items with an
    occurring pattern.

    NULL and empty texts have no words. An item without id counts under the
    empty string, repeated items and ids count once. An empty ``items`` marks
    nothing. Other columns stay; those named like a new column are replaced.
    """
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("n_words", "hits", "items")])
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL(FIELDS).fields])
    for held in _blocks(items, item, text):
        out = out.mapInArrow(functools.partial(_search, items=held, window=window, text=text), schema)
    return out


def clean(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item: str = "item_id") -> DataFrame:
    """The rows in which no pattern occurs, with all their columns as they are."""

    def run(batches: Iterable[pa.RecordBatch], held: tuple) -> Iterator[pa.RecordBatch]:
        found = _cached(tuple(t for _, t in held), window)
        for part in W.parts(batches, text):
            words, h = normal(part.column(part.schema.get_field_index(text)))
            free = np.ones(part.num_rows, bool)
            for table in found:
                free[words.text[search(words, h, table)[0]]] = False
            yield part.filter(pa.array(free))

    out = df
    for held in _blocks(items, item, text):
        out = out.mapInArrow(functools.partial(run, held=held), df.schema)
    return out


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[tuple[tuple[str | None, str | None], ...]]:
    """(id, text) of all items, in blocks of a bounded size."""
    named = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    row = named.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("bytes")).first()
    blocks = max(1, -(-(row["bytes"] or 0) // BLOCK_BYTES))
    for k in range(blocks):
        mine = named if blocks == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield tuple((r["item"], r["text"]) for r in mine.collect())  # at most about BLOCK_BYTES
