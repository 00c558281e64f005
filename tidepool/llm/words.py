"""Words of whole Arrow batches as flat numpy arrays.

Texts stay in one byte buffer; words are offsets into it, so splitting and
hashing cost a few vector operations per batch and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# A batch is worked on in parts of about this many bytes of text.
PART_BYTES = 4 << 20

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)], dtype=U)
# An odd base with an odd half: powers keep 64 bits of order information.
_BASE = 0x2545F4914F6CDD1B
_INVERSE = pow(_BASE, -1, 1 << 64)

# Bytes that belong to a word, for the two word rules of the operators.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LETTER_OR_DIGIT = np.zeros(256, dtype=bool)
LETTER_OR_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on the input."""
    x = (x ^ (x >> U(30))) * _M2
    x = (x ^ (x >> U(27))) * _M3
    return x ^ (x >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column from bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_string(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.string())


def lists_of(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column with ``counts`` values in each row."""
    return pa.ListArray.from_arrays(pa.array(bounds(counts), pa.int32()), values)


def bounds(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] numbers, then the next run."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - bounds(counts)[:-1], counts)


def parts(batches: Iterable[pa.RecordBatch], text: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or one row."""
    for batch in batches:
        _, at = flat(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    """Words of a run of texts: their bytes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def split(data: np.ndarray, offsets: np.ndarray, rule: np.ndarray) -> Words:
    """Maximal runs of bytes that ``rule`` allows; none spans two texts."""
    mask = rule[data]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    begins, ends = offsets[:-1], offsets[1:]
    before[begins[begins < len(mask)]] = False
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(mask & ~before)
    return Words(data, start, np.flatnonzero(mask & ~after) + 1, np.searchsorted(start, offsets))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each slice of bytes, eight bytes a round."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(U) * _M1 + U(seed & (2**64 - 1)))
    live, at = np.arange(len(start)), 0
    while len(live):
        left = size[live] - at
        word = eight[start[live] + at]
        short = left < 8
        word[short] &= _MASKS[np.maximum(left[short], 0)]
        out[live] = mix((out[live] ^ word) + _M1)
        live, at = live[left > 8], at + 8
    return out


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, dtype=U)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=U)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def windows(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` consecutive word hashes from each position."""
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[at + length] - sums[at]) * down[at])


class Lookup:
    """A fixed hash table from 64-bit keys to small numbers, read by vectors."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.used = np.zeros(1 << bits, bool)
        self.keys, self.values = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int64)
        self.rounds, todo, at = 0, np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.rounds += 1
            free = ~self.used[at]
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.used[at[put]], self.keys[at[put]] = True, keys[todo[put]]
            self.values[at[put]] = values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _M1) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where it has none."""
        at = self._slot(keys)
        out = np.where(self.used[at] & (self.keys[at] == keys), self.values[at], -1)
        live = np.flatnonzero(self.used[at] & (self.keys[at] != keys))
        at = at[live]
        while len(live):
            at = (at + 1) & self.mask
            hit = self.used[at] & (self.keys[at] == keys[live])
            out[live[hit]] = self.values[at[hit]]
            go = self.used[at] & ~hit
            live, at = live[go], at[go]
        return out


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with one more column, last; one of the same name goes."""
    kept = [n for n in batch.schema.names if n != name]
    columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
    return pa.RecordBatch.from_arrays([*columns, column], [*kept, name])


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


Step = Callable[[pa.Array], Sequence[pa.Array]]


def add_columns(df: DataFrame, text: str, fields: str, make: Callable[[], Step], drop: Sequence[str] = ()) -> DataFrame:
    """Columns computed from a text column, part by part in Arrow.

    ``make`` runs once per task and gives a function from the texts of a part
    to one array per field of the DDL string ``fields``. A column of the same
    name is replaced; all others stay.
    """
    new = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in {*new.names, *drop}]
    names, kinds = [f.name for f in kept], [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in parts(batches, text):
            column = part.column(part.schema.get_field_index(text))
            made = [a if a.type == k else a.cast(k) for a, k in zip(step(column), kinds)]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(n)) for n in names] + made, names + new.names
            )

    return df.mapInArrow(run, T.StructType([*kept, *new.fields]))
