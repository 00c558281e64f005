"""SentencePiece encoding and decoding by vectorised merge rounds.

For models of the merge kind with byte fallback, identity normalisation and a
leading space mark, such as ``piece_bpe_32k.model``. All words of a part are
merged together: flat symbol arrays, the best pair of each word by a segmented
minimum of ranks, simultaneous merges, compaction, until no pair remains. In
very long words the rounds touch only merged places and their neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepool.llm import words as W

MARK = 0x2581  # the space mark
# Words whose ids a worker remembers before it starts anew.
MEMORY = 300_000
# Words of more symbols are merged with their pairs waiting by rank.
LONG = 2048
# Text encoded at a time, in bytes, and ids decoded at a time: a task needs some tens of megabytes.
PART_BYTES, PART_IDS = 1 << 20, 1 << 18
_NONE = np.int64(1) << 40


class Model:
    """Tables of one model file, and the ids of words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        piece = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        self.byte = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(piece[i][3:-1], 16)] = i
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        known = {p: i for i, p in enumerate(piece) if normal[i]}
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in known):
            raise ValueError("a piece has a space mark after another character")
        if missing := {c for p in known for c in p} - known.keys():
            raise ValueError(f"characters of pieces are no pieces: {sorted(missing)[:5]}")
        score = np.array([sp.get_score(i) for i in range(n)])
        _, rank = np.unique(-score, return_inverse=True)
        self.rank = rank.astype(np.int64)
        pairs = [
            (known[p[:k]], known[p[k:]], i)
            for p, i in known.items()
            for k in range(1, len(p))
            if p[:k] in known and p[k:] in known
        ]
        a, b, to = np.array(pairs, np.int64).reshape(-1, 3).T
        self.pairs = W.Lookup(self._key(a, b), to)
        # All equal best pairs of a word may merge at once, unless a merge opens
        # a pair that is as good or better, which then comes before the others.
        self.one_by_one = np.zeros(n, bool)
        for x in (a, b):
            self.one_by_one[x[self.rank[to] <= self.rank[x]]] = True
        shared = np.bincount(self.rank[list(known.values())], minlength=n)
        self.one_by_one |= shared[self.rank] > 1
        chars = sorted((ord(p), i) for p, i in known.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_ids = np.array([i for _, i in chars], np.int64)
        silent = [sp.is_control(i) for i in range(n)]
        out = [
            b"" if silent[i] else bytes([int(piece[i][3:-1], 16)]) if self.is_byte[i]
            else " ⁇ ".encode() if sp.is_unknown(i) else piece[i].replace(chr(MARK), " ").encode()
            for i in range(n)
        ]
        self.silent = np.array(silent)
        self.marked = np.array([p.startswith(chr(MARK)) for p in piece]) & np.array(normal)
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_at = W.bounds(np.array([len(x) for x in out]))
        self._forget()

    def _forget(self) -> None:
        self.keys, self.lo, self.n = np.zeros(0, W.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(W.U) << W.U(32)) | b.astype(W.U)

    def _merge_long(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, symbol) that are left of long words.

        Pairs wait by rank. Each round takes those of the least one, and only
        merged symbols and their neighbours make new pairs.
        """
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        cut = np.flatnonzero(word[1:] != word[:-1])
        after[np.append(cut, n - 1)] = -1
        before[np.append(cut + 1, 0)] = -1
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = at[alive[at] & (after[at] >= 0)]
            at = at[(sym[at] >= 0) & (sym[after[at]] >= 0)]
            to = self.pairs.get(self._key(sym[at], sym[after[at]]))
            return at[to >= 0], to[to >= 0]

        def wait(at: np.ndarray) -> None:
            at, to = pairs(at)
            rank = self.rank[to]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.diff(rank, prepend=-1, append=_NONE))
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
                r = int(rank[lo])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[lo:hi])

        wait(np.arange(n))
        while ranks:
            least = heapq.heappop(ranks)
            at, to = pairs(np.unique(np.concatenate(waiting.pop(least))))
            at, to = at[self.rank[to] == least], to[self.rank[to] == least]
            if not len(at):
                continue
            first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            run = np.flatnonzero(np.concatenate([[True], after[at[:-1]] != at[1:]]) | first)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            merged = first | ((place % 2 == 0) & ~self.one_by_one[to])
            take, later = at[merged], at[~merged]
            gone = after[take]
            sym[take] = to[merged]
            alive[gone] = False
            after[take] = after[gone]
            linked = after[take] >= 0
            before[after[take[linked]]] = take[linked]
            left = before[take]
            wait(np.unique(np.concatenate([take, left[left >= 0], later])))
        return word[alive], sym[alive]

    def merge(self, points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per word) of words given as code points."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        # A character without a piece stays below zero and never merges.
        sym = np.where(self.chars[at] == points, self.char_ids[at], -points - 1)
        word = np.repeat(np.arange(len(counts)), counts)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        long = np.repeat(counts > LONG, counts)
        if long.any():
            done.append(self._merge_long(sym[long], word[long]))
            sym, word = sym[~long], word[~long]
        while len(sym):
            open_ = (word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0)
            to = np.full(len(sym), -1, np.int64)
            i = np.flatnonzero(open_)
            to[i] = self.pairs.get(self._key(sym[i], sym[i + 1]))
            rank = np.where(to >= 0, self.rank[to], _NONE)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(start, len(sym)))
            best = np.minimum.reduceat(rank, start)
            live = np.repeat(best < _NONE, size)
            if not live.all():
                done.append((word[~live], sym[~live]))
                word, sym, to, rank = word[live], sym[live], to[live], rank[live]
                size, best = size[best < _NONE], best[best < _NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            first = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]) | first)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            take = at[first | ((place % 2 == 0) & ~self.one_by_one[to[at]])]
            sym[take] = to[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word = sym[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        lost = np.flatnonzero(sym < 0)
        if len(lost):  # the bytes of characters that have no piece
            text = "".join(map(chr, -sym[lost] - 1))
            raw = np.frombuffer(text.encode(), np.uint8)
            size = np.array([len(c.encode()) for c in text], np.int64)
            repeat = np.ones(len(sym), np.int64)
            repeat[lost] = size
            is_lost = np.repeat(sym < 0, repeat)
            sym, word = np.repeat(sym, repeat), np.repeat(word, repeat)
            sym[is_lost] = self.byte[raw]
        return sym, np.bincount(word, minlength=len(counts))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) without begin and end."""
        data, offsets = W.flat(column)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        leads = W.bounds((data & 0xC0) != 0x80)[offsets]
        filled = np.diff(leads) > 0
        points = np.insert(points, leads[:-1][filled], MARK)
        points[points == 0x20] = MARK
        first = W.bounds(np.diff(leads) + filled)
        mark = points == MARK
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[first[:-1][filled]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(points))
        narrow = points.astype("<u4").view(np.uint8)
        key, where, back = np.unique(W.hashes(narrow, start * 4, end * 4), return_index=True, return_inverse=True)
        if len(self.keys) > MEMORY:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[at] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            s, size = start[where[new]], (end - start)[where[new]]
            ids, n = self.merge(points[W.spread(s, size)], size)
            lo = len(self.ids) + W.bounds(n)[:-1]
            self.ids = np.concatenate([self.ids, ids])
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys)
            self.keys = keys[order]
            self.lo, self.n = np.concatenate([self.lo, lo])[order], np.concatenate([self.n, n])[order]
            at = np.searchsorted(self.keys, key)
        lo, n = self.lo[at][back], self.n[at][back]
        per_text = np.diff(W.bounds(n)[np.searchsorted(start, first)])
        return self.ids[W.spread(lo, n)], per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts of lists of ids."""
        size = np.diff(self.out_at)[ids]
        lo = self.out_at[:-1][ids].copy()
        at = W.bounds(counts)
        # The space that encoding put first goes: the mark of the first piece heard.
        heard = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(heard, at[:-1])
        has = first < np.searchsorted(heard, at[1:])
        lead = heard[first[has]]
        lead = lead[self.marked[ids[lead]]]
        lo[lead] += 1
        size[lead] -= 1
        data = self.out[W.spread(lo, size)]
        offsets = W.bounds(size)[at]
        if self.is_byte[ids].any():
            data, offsets = _repaired(data, offsets)
        return data, offsets


def _repaired(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte that is part of no character becomes U+FFFD."""
    try:
        data.tobytes().decode()
        return data, offsets
    except UnicodeDecodeError:
        texts = []
        for lo, hi in zip(offsets[:-1], offsets[1:]):
            raw = data[lo:hi].tobytes()
            out = raw.decode(errors="surrogateescape")
            texts.append("".join("�" if "\udc80" <= c <= "\udcff" else c for c in out).encode())
        return np.frombuffer(b"".join(texts), np.uint8), W.bounds(np.array([len(t) for t in texts]))


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _framed(m: Model, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = W.bounds(counts)
    out = np.insert(ids, at[:-1], m.bos)
    ends = W.bounds(counts + 1)[1:]
    return np.insert(out, ends, m.eos), counts + 2


def encode_batches(batches: Iterable[pa.RecordBatch], path: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    """Batches with a column of ids, in parts of a megabyte of text."""
    m = model(path)
    for part in W.parts(batches, text, PART_BYTES):
        out, n = _framed(m, *m.encode(part.column(part.schema.get_field_index(text))))
        yield W.with_column(part, ids, W.lists_of(pa.array(out.astype(np.int32)), n))


def decode_batches(batches: Iterable[pa.RecordBatch], path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    """Batches with a column of the texts of lists of ids, in parts of so many ids, or of one row."""
    m = model(path)
    for batch in batches:
        counts = np.asarray(batch.column(batch.schema.get_field_index(ids)).value_lengths().fill_null(0), np.int64)
        at = W.bounds(counts)
        lo = 0
        while lo < len(counts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PART_IDS, side="right")) - 1)
            part = batch.slice(lo, hi - lo)
            flat = np.asarray(part.column(part.schema.get_field_index(ids)).flatten().fill_null(0), np.int64)
            yield W.with_column(part, text, W.texts_of(*m.decode(flat, counts[lo:hi])))
            lo = hi


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text, begin and end included, as an array of int.

    NULL and empty texts have only begin and end. Rows and other columns stay;
    one named like the new column is replaced. ``path`` is the model file,
    which every executor must be able to read.
    """
    schema = W.with_field(df.schema, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(lambda batches: encode_batches(batches, path, text, ids), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each list of ids. A NULL or empty list is the empty text.

    Begin, end and other control ids are silent, and the space that encoding
    puts first is taken away; bytes that form no character become U+FFFD.
    """
    schema = W.with_field(df.schema, text, T.StringType())
    return df.mapInArrow(lambda batches: decode_batches(batches, path, ids, text), schema)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one worker, which holds one model and one part at a time."""
    schema = W.with_field(W.with_field(df.schema, ids, T.ArrayType(T.IntegerType())), decoded, T.StringType())
    return df.mapInArrow(lambda batches: decode_batches(encode_batches(batches, path, text, ids), path, ids, decoded), schema)
