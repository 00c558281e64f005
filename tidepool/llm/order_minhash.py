"""Near-duplicates by order-sensitive MinHash, verified by banded alignment.

A text is the sequence of its words. Its shingles carry a label for their
number of occurrence. Each sketch takes the two shingles of least hash and
keeps them in the order of the text, so that two texts agree with a chance that
follows their edit similarity. Texts that agree in a sketch meet in a bucket.
``meetings`` links them: first each text is aligned with the one that it meets
most often, in a band as wide as the similarity allows, then with every text of
a bucket in another class that sizes and the parity of words do not rule out.

A bucket never becomes an array, and only keys and numbers are moved until two
texts are aligned. Copies of a text are one text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import meetings, storage
from tidepool.llm import words as W

SKETCHES, KEPT = 96, 2
SIMILAR = 0.8
# Words of a shingle, and the least and largest number of words of texts that
# are sketched by them. Texts at 0.8 always have a range in common.
KINDS = ((2, 1, 40), (3, 32, 1 << 62))
# Members aligned with one text in one task, in bytes.
GROUP_BYTES = 2 << 20
_ODD = W.mix(np.arange(1, SKETCHES + 1, dtype=W.U) * W._M2) | W.U(1)
_PLACE = W.U((1 << 24) - 1)


def _labelled(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that tell the first, second, ... occurrence in a text apart."""
    order = np.lexsort((x, text))
    a, b = x[order], text[order]
    new = np.ones(len(x), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    number = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    out = x.copy()
    again = number > 0
    out[order[again]] = W.mix(a[again] + number[again].astype(W.U) * W._M1)
    return out


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, sketch) of every sketch of the texts that have words, by text.

    Each kind of shingles gives SKETCHES hashes. A text of one word is one
    shingle. With edits placed in the worst way, two texts at 0.8 share a third
    of all their shingles of two words, and a quarter of those of three.
    """
    data, offsets = W.flat(column)
    words = W.split(data, offsets, W.NOT_SPACE)
    h = W.hashes(data, words.start, words.end)
    n = words.count
    texts, values = [], []
    for kind, (length, lowest, highest) in enumerate(KINDS):
        used = (n >= lowest) & (n <= highest)
        at = np.flatnonzero((words.left() >= np.minimum(length, n[words.text])) & used[words.text])
        if len(at):
            x = h[at].copy()
            long = np.flatnonzero(n[words.text[at]] >= length)
            x[long] = W.windows(h, at[long], length)
            has, found = _least(x, words.text[at], kind * SKETCHES)
            texts.append(np.repeat(has, SKETCHES))
            values.append(found.ravel())
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, W.U)
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.argsort(text, kind="stable")
    return text[order], value[order]


def _least(x: np.ndarray, text: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, one row of sketches per text) of the shingles ``x`` in the order of the texts."""
    start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(start, len(text)))
    x = _labelled(x, text)
    place = (np.arange(len(x)) - np.repeat(start, size)).astype(W.U)
    step = int(size.max()) // int(_PLACE) + 1  # places of very long texts are kept more coarsely
    place //= W.U(step)
    top, out = W.U(2**64 - 1), np.empty((len(start), SKETCHES), W.U)
    for j in range(SKETCHES):
        key = ((x * _ODD[j]) & ~_PLACE) | place
        total = np.full(len(start), W.U(seed + j + 1))
        found = []
        for _ in range(KEPT):
            least = np.minimum.reduceat(key, start)
            found.append(least)
            rest = np.flatnonzero(least != top)
            if step == 1:
                key[start[rest] + (least[rest] & _PLACE).astype(np.int64)] = top
            else:
                key[key == np.repeat(least, size)] = top
        values = np.stack(found)
        rank = np.where(values == top, _PLACE + W.U(1), values & _PLACE)
        chosen = np.take_along_axis(values, np.argsort(rank, axis=0, kind="stable"), axis=0)
        for row in chosen:  # in the order of the text; places themselves do not count
            total = W.mix(total * W._M1 + (row & ~_PLACE))
        out[:, j] = total
    return text[start], out


def distance(pattern: dict[int, int], size: int, other: list[int], most: int) -> int:
    """Edit distance of word sequences in a band around the diagonal, ``most`` + 1 if it is larger.

    ``pattern`` has for each word the set of its places as bits, ``size`` is
    the number of words. Bit vectors hold a column of the band.
    """
    if abs(size - len(other)) > most:
        return most + 1
    if not size or not other:
        return max(size, len(other))
    if size <= most or len(other) <= most:
        most_here = max(size, len(other))
        return min(_whole(pattern, size, other), most + 1) if most_here else 0
    width = 2 * most + 2
    mask = (1 << width) - 1
    up = (mask << (width - most - 1)) & mask
    down = 0
    found, start = most, most + 1 - width
    diagonal, level = 1 << (width - 1), 1 << (width - 2)
    limit = most + len(other) - (size - most)
    turn = size - most
    for i, word in enumerate(other):
        bits = pattern.get(word, 0)
        x = ((bits << -start) if start < 0 else (bits >> start)) & mask
        d = ((((x & up) + up) ^ up) | x | down) & mask
        right = (down | ~(d | up)) & mask
        left = d & up
        if i < turn:
            found += not d & diagonal
        else:
            found += bool(right & level) - bool(left & level)
            level >>= 1
        if found > limit:
            return most + 1
        half = d >> 1
        up = (left | ~(half | right)) & mask
        down = half & right
        start += 1
    return found if found <= most else most + 1


def _whole(pattern: dict[int, int], size: int, other: list[int]) -> int:
    """Edit distance without a band, for short sequences."""
    mask, last = (1 << size) - 1, 1 << (size - 1)
    up, down, found = mask, 0, size
    for word in other:
        x = pattern.get(word, 0)
        d = ((((x & up) + up) ^ up) | x | down) & mask
        right, left = (down | ~(d | up)) & mask, d & up
        found += bool(right & last) - bool(left & last)
        right, left = ((right << 1) | 1) & mask, (left << 1) & mask
        up, down = (left | ~(d | right)) & mask, d & right
    return found


def places(sequence: list[int]) -> dict[int, int]:
    """For each word the set of its places as bits."""
    found: dict[int, list[int]] = {}
    for i, word in enumerate(sequence):
        found.setdefault(word, []).append(i)
    out = {}
    for word, at in found.items():
        bits = bytearray(at[-1] // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[word] = int.from_bytes(bits, "little")
    return out


def similarity(a: list[int], b: list[int], least: float) -> float:
    """One minus edit distance over the longer length, 0 where it is below ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    d = distance(places(a), len(a), b, most)
    return 1 - d / longer if d <= most else 0.0


def _align(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (rep, part, member): the text ``rep`` comes first, then its members."""
    rep, size, bits, rep_id = None, 0, {}, None
    for part in W.parts(batches, "text"):
        data, offsets = W.flat(part.column(part.schema.get_field_index("text")))
        words = W.split(data, offsets, W.NOT_SPACE)
        h = W.hashes(data, words.start, words.end).tolist()
        keys = part.column(part.schema.get_field_index("key")).to_pylist()
        reps = part.column(part.schema.get_field_index("rep")).to_pylist()
        member = part.column(part.schema.get_field_index("member")).to_pylist()
        out = []
        for i, (key, target, follows) in enumerate(zip(keys, reps, member)):
            sequence = h[words.first[i] : words.first[i + 1]]
            if not follows:
                rep, size, bits, rep_id = sequence, len(sequence), places(sequence), key
            elif rep_id == target:
                longer = max(size, len(sequence))
                most = int((1 - least) * longer + 1e-9)
                out.append((key, target, rep == sequence or distance(bits, size, sequence, most) <= most))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.bool_())],
            ["key", "rep", "similar"],
        )


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(key, rep, similar) of distinct pairs (key, rep, size); texts: (key, text)."""
    total = pairs.groupBy("rep").agg(F.ceil(F.sum("size") / GROUP_BYTES).cast("int").alias("parts"))
    total = total.withColumn("parts", F.greatest("parts", F.lit(1)))
    members = pairs.join(total, "rep").select("key", "rep", F.pmod("key", "parts").cast("int").alias("part"), F.lit(True).alias("member"))
    firsts = total.select(
        F.col("rep").alias("key"), "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member")
    )
    rows = members.unionByName(firsts).join(texts, "key")
    sorted_ = rows.repartition("rep", "part").sortWithinPartitions("rep", "part", "member")
    return sorted_.mapInArrow(functools.partial(_align, least=least), "key long, rep long, similar boolean")


def text_key(text: str = "text") -> F.Column:
    """Equal texts have equal keys; NULL is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _most(least: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most edits between similar texts of n and m words."""
    return ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)


def _near(least: float, n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.abs(n - m) <= _most(least, n, m)


def _apart(least: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most words that only one of two similar texts has, each as often as it has more of it.

    Neither text has more such words than edits, and the longer one has as many more as it is longer.
    """
    return 2 * _most(least, n, m) - np.abs(n - m)


def links(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(key, rep) of different texts with an edit similarity of ``least`` or more; docs: (key, text).

    Every link that is returned was aligned. Texts are found through common
    sketches. No two texts of a bucket are left in different classes unless they
    are not similar; within a class, not every link is returned.
    """

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches, "text"):
            keys = np.asarray(part.column(part.schema.get_field_index("key")))
            column = part.column(part.schema.get_field_index("text"))
            _, once = np.unique(keys, return_index=True)
            once = np.sort(once)
            column, keys = column.take(pa.array(once)), keys[once]
            text, found = sketches(column)
            has, count = np.unique(text, return_counts=True)
            data, offsets = W.flat(column)
            words = W.split(data, offsets, W.NOT_SPACE)
            h = W.hashes(data, words.start, words.end)
            bits = meetings.parities(words.text, _labelled(h, words.text), len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[has]), pa.array(words.count[has]), bits.take(pa.array(has)), W.lists_of(pa.array(found.view(np.int64)), count)],
                ["key", "n", "bits", "sketch"],
            )

    sketched = docs.select("key", "text").mapInArrow(sketch, "key long, n long, bits binary, sketch array<long>")
    sketched = storage.written(sketched.dropDuplicates(["key"]))
    storage.forget(sketched)
    placed = sketched.select("key", "n", F.explode("sketch").alias("bucket"), F.lit(0).alias("place"))
    members = storage.written(placed.join(meetings.without_copies(placed), "bucket"))
    storage.forget(members)
    texts = docs.groupBy("key").agg(F.first("text").alias("text"))
    texts = storage.written(texts.join(members.select("key").distinct(), "key", "left_semi"))
    sizes = sketched.select("key", (F.col("n") * 6).alias("size"))

    def check(pairs: DataFrame) -> DataFrame:
        return storage.written(_verified(pairs.join(sizes, "key"), texts, least))

    found = meetings.linked(
        members, sketched.select("key", "bits"), check, int(100 * least),
        functools.partial(_near, least), functools.partial(_apart, least), once=True,
    )
    found = found.select(F.greatest("key", "rep").alias("key"), F.least("key", "rep").alias("rep"))
    found = storage.written(found.distinct())
    storage.discard(sketched, members, texts)
    return found


def _classed(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(id, key, class, n_links) of each row, written to the shared folder."""
    docs = df.select(F.col(key).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    found = links(docs.select("key", "text"), least)
    roots = meetings.components(found.select(F.col("key").alias("a"), F.col("rep").alias("b")))
    ends = found.select("key").unionByName(found.select(F.col("rep").alias("key")))
    degree = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    known = roots.withColumnRenamed("node", "key").join(degree, "key", "full")
    rows = docs.select("id", "key").join(known, "key", "left")
    return storage.written(
        rows.select("id", "key", F.coalesce("root", "key").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row per row of ``df``: (key, text_key, class, class_id, class_size, n_links).

    A class holds equal texts and texts connected by links; ``class`` is its
    least text key, ``class_id`` its least key (NULL if it has no other), and ``n_links`` counts the verified
    links of the row's text to different texts. NULL and empty texts are equal
    and link to nothing else; texts without a word likewise. Repeated rows are
    members like any other. Other columns are not looked at.
    """
    rows = _classed(df, key, text, least)
    total = rows.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    # A table of its own, so that the join can split the rows of a large class.
    out = rows.join(storage.written(total), "class")
    return out.select(F.col("id").alias(key), F.col("key").alias("text_key"), "class", "class_id", "class_size", "n_links")


def first_of_class(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """One row of each class: that of the least key, with all its columns.

    Of rows with equal key and equal text one stays; NULL keys come last.
    """
    found = _classed(df, key, text, least)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    chosen = found.groupBy("class").agg(F.min(order).alias("first"))
    chosen = chosen.select(F.col("first.id").alias("_id"), F.col("first.key").alias("_text_key"))
    rows = df.withColumn("_text_key", text_key(text))
    kept = rows.join(chosen, rows[key].eqNullSafe(chosen["_id"]) & (rows["_text_key"] == chosen["_text_key"]), "left_semi")
    return kept.dropDuplicates([key, "_text_key"]).drop("_text_key")
