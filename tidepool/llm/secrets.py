"""Secrets in texts: fixed patterns, and a battery of randomness tests.

The battery looks at every long token that looks like an encoded value. The
encoding is inferred from its characters; a run that fits none is cut at inner
'=', then '/', '-' and '_', and its long pieces are tested. A secret looks random: uniformity of
the alphabet (chi-squared), runs and serial correlation must not be rejected.
And it must not be explained by ordinary text, whose characters repeat more
often and hold fewer digits: the chance of that is a p-value which shrinks with
length. Over all tokens of all texts, the false-discovery rate of these
p-values is held (Benjamini and Hochberg), weighted by length.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm import words as W

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Tokens of the battery: their characters and least length.
TOKEN = np.zeros(256, bool)
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")] = True
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
TOKEN_LENGTH = 20
# Encodings in the order they are tried: name, alphabet in the order of its values.
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", _DIG + "abcdef"),
    ("HEX", _DIG + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("base36", _DIG + _LOW),
    ("BASE36", _DIG + _UP),
    ("base62", _DIG + _UP + _LOW),
    ("base64", _UP + _LOW + _DIG + "+/"),
    ("base64url", _UP + _LOW + _DIG + "-_"),
)
# Ordinary text: two of its letters are equal this often, and this share of
# its characters are digits (generous, for dates, versions and names).
REPEATS, DIGITS = 0.066, 0.15
# A token that the randomness tests reject at this level is no secret.
NOT_RANDOM = 0.001
# p-values are counted in this many bins to a power of ten, down to 10^-60.
BINS, LOWEST = 20, 60


def _normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_sf(x: float, k: float) -> float:
    """Upper tail of chi-squared, by the cube-root approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * k)
    return _normal_sf(((x / k) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def _poisson_cdf(n: int, mean: float) -> float:
    term = total = math.exp(-mean)
    for i in range(1, n + 1):
        term *= mean / i
        total += term
    return min(1.0, total)


def _binomial_sf(n: int, size: int, share: float) -> float:
    """Chance of ``n`` or more of ``size``."""
    log = [math.lgamma(size + 1) - math.lgamma(i + 1) - math.lgamma(size - i + 1)
           + i * math.log(share) + (size - i) * math.log1p(-share) for i in range(n, size + 1)]
    return min(1.0, sum(map(math.exp, log)))


def _fisher(ps: Iterable[float]) -> float:
    """One p-value for several independent ones."""
    logs = [math.log(max(p, 1e-300)) for p in ps]
    half = -sum(logs)
    return min(1.0, sum(math.exp(-half + i * math.log(half) - math.lgamma(i + 1)) for i in range(len(logs)))) if half else 1.0


def encoding(token: str) -> tuple[str, str] | None:
    """(name, alphabet) of a token without padding; None if it has no digit beside letters."""
    if not any("0" <= c <= "9" for c in token) or not any(c.isalpha() for c in token):
        return None
    kinds = set(token)
    return next(((n, a) for n, a in ALPHABETS if kinds <= set(a)), None)


def randomness(token: str, alphabet: str) -> float:
    """p-value of a uniformly random token: small when the tests reject it."""
    size, m = len(token), len(alphabet)
    x = np.array([alphabet.index(c) for c in token])
    counts = np.bincount(x, minlength=m)
    chi = m / size * float((counts**2).sum()) - size
    # Few characters a cell: match the statistic's exact mean and variance.
    mean, var = m - 1, 2 * (m - 1) * (1 - 1 / size)
    uniform = _chi2_sf(chi * 2 * mean / var, 2 * mean * mean / var)
    high = x >= m / 2
    n1 = int(high.sum())
    n0 = size - n1
    if n0 and n1:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        expect = 1 + 2 * n0 * n1 / size
        var = (expect - 1) * (expect - 2) / (size - 1)
        run = 2 * _normal_sf(abs(runs - expect) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run = 2.0 ** (1 - size)
    y = x - x.mean()
    power = float((y * y).sum())
    r = float((y[1:] * y[:-1]).sum()) / power if power else 1.0
    serial = 2 * _normal_sf(abs(r + 1 / size) * math.sqrt(size))
    return _fisher((uniform, run, serial))


def ordinary(token: str) -> float:
    """p-value of ordinary text: small for a token with few repeats and many digits."""
    size = len(token)
    counts = np.array([token.count(c) for c in set(token)])
    pairs = int((counts * (counts - 1) // 2).sum())
    digits = sum("0" <= c <= "9" for c in token)
    repeats = _poisson_cdf(pairs, min(700.0, REPEATS * size * (size - 1) / 2))
    return _fisher((repeats, _binomial_sf(digits, size, DIGITS)))


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` allowed bytes, none across two texts."""
    found = W.split(mask.view(np.uint8), offsets, np.array([False, True] + [False] * 254))
    long = found.end - found.start >= least
    return found.start[long], found.end[long]


def _pieces(token: str, at: int = 0, marks: str = "=/-_") -> Iterator[tuple[int, str, str]]:
    """(offset, token, alphabet) of a run without padding: itself, or its long pieces where it fits no alphabet."""
    whole, token = len(token), token.rstrip("=")
    if len(token) < TOKEN_LENGTH:
        return
    kind = encoding(token)
    if kind:
        yield at, token, kind[1]
    elif marks:
        for m in re.finditer(f"[^{marks[0]}]+", token):
            # The last piece keeps the padding behind it.
            tail = "=" * (whole - len(token)) if m.end() == len(token) else ""
            yield from _pieces(m[0] + tail, at + m.start(), marks[1:])


def _scan(column: pa.Array) -> list[list[tuple[int, int, int, float]]]:
    """Per text: (start, kind, end, weight of evidence) by start, then kind.

    The evidence of a random token is its p-value over its length, as log10;
    tokens that fail the randomness tests have none and are left out.
    """
    data, offsets = W.flat(column)
    raw = data.tobytes()
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(column))]

    def put(row: int, kind: str, lo: int, hi: int, weight: float = 0.0) -> None:
        """Spans in bytes of the part become code points of their text."""
        base = offsets[row]
        start = len(raw[base:lo].decode())
        out[row].append((start, KINDS.index(kind), start + len(raw[lo:hi].decode()), weight))

    for lo, hi in zip(*_runs(HEX[data], offsets, LEAST["hex"])):
        put(int(np.searchsorted(offsets, lo, side="right")) - 1, "hex", lo, hi)
    for lo, hi in zip(*_runs(TOKEN[data], offsets, TOKEN_LENGTH)):
        run = raw[lo:hi].decode()
        for at, token, alphabet in _pieces(run):
            if randomness(token, alphabet) >= NOT_RANDOM:
                p = max(ordinary(token), 1e-300)
                row = int(np.searchsorted(offsets, lo, side="right")) - 1
                end = at + len(token)
                end += len(run) - len(run.rstrip("=")) if end == len(run.rstrip("=")) else 0
                put(row, "random", lo + at, lo + end, math.log10(p) - math.log10(len(token)))
    # Texts that can match the patterns hold one of these bytes.
    for row in np.unique(np.searchsorted(offsets, np.flatnonzero((data == 0x3A) | (data == 0x3D)), side="right")) - 1:
        text = raw[offsets[row] : offsets[row + 1]].decode()
        for m in ASSIGN.finditer(text):
            if len(m[1]) >= LEAST["assign"]:
                out[row].append((m.start(), 0, m.end(), 0.0))
    if b"AKIA" in raw:
        for row, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:])):
            for m in ACCESS.finditer(raw[lo:hi].decode()) if b"AKIA" in raw[lo:hi] else ():
                if m.end() - m.start() >= LEAST["access"]:
                    out[row].append((m.start(), 1, m.end(), 0.0))
    return [sorted(x) for x in out]


def _bin(weight: float) -> int:
    return max(0, min(LOWEST * BINS, math.ceil(-weight * BINS) - 1))


def threshold(df: DataFrame, text: str = "text", rate: float = 0.01) -> float:
    """The largest evidence (log10 of p over length) that is a discovery.

    Every token of all texts counts. Tasks send counts by bin of evidence only,
    so the driver sees a table of fixed size. A weight proportional to length
    favours long tokens; weights have mean one over all tokens. -inf where
    nothing is found or no token exists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lengths = np.zeros(LOWEST * BINS + 1, np.int64), np.zeros(LOWEST * BINS + 1, np.int64)
        for part in W.parts(batches, text):
            for spans in _scan(part.column(0)):
                for start, kind, end, weight in spans:
                    if kind == 3:
                        counts[_bin(weight)] += 1
                        lengths[_bin(weight)] += end - start
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(lengths[used])], ["bin", "n", "length"]
        )

    bins = df.select(F.col(text)).mapInArrow(run, "bin long, n long, length long")
    rows = bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    total, mean = sum(r["n"] for r in rows), 0.0
    if not total:
        return -math.inf
    mean = sum(r["length"] for r in rows) / total
    best, seen = -math.inf, 0
    for r in sorted(rows, key=lambda r: -r["bin"]):
        seen += r["n"]
        upper = -r["bin"] / BINS  # log10 of the largest p over length in this bin
        if 10.0**upper * mean * total <= rate * seen:
            best = upper
    return best


FIELDS = "spans array<struct<kind:string,start:int,end:int>>"


def find(df: DataFrame, text: str = "text", limit: float | None = None, spans: str = "spans") -> DataFrame:
    """Add the spans of secrets of each text: kind, start and end in code points.

    Kinds are ``assign`` (a named value), ``access`` (an access key id),
    ``hex`` (a long hexadecimal run) and ``random`` (a discovery of the
    randomness battery that holds no part of the others). Spans are ordered by
    start, then kind. ``limit`` is the result of ``threshold``; without it,
    ``threshold(df, text)`` is computed first.

    NULL and empty texts have no spans. Rows and other columns stay; a column
    of the new name is replaced.
    """
    limit = threshold(df, text) if limit is None else limit
    kind = T.StructType.fromDDL(FIELDS).fields[0].dataType
    return df.mapInArrow(
        functools.partial(_find, text=text, limit=limit, name=spans), W.with_field(df.schema, spans, kind)
    )


def spans_of(column: pa.Array, limit: float) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, kind, end) of its secrets."""
    out = []
    for found in _scan(column):
        base = [(s, k, e) for s, k, e, _ in found if k < 3]
        more = [
            (s, k, e) for s, k, e, w in found
            if k == 3 and -_bin(w) / BINS <= limit and not any(s < y and x < e for x, _, y in base)
        ]
        out.append(sorted(base + more))
    return out


def _find(batches: Iterable[pa.RecordBatch], text: str, limit: float, name: str) -> Iterator[pa.RecordBatch]:
    for part in W.parts(batches, text):
        found = spans_of(part.column(part.schema.get_field_index(text)), limit)
        flat = [x for row in found for x in row]
        values = pa.StructArray.from_arrays(
            [
                pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
                pa.array([s for s, _, _ in flat], pa.int32()),
                pa.array([e for _, _, e in flat], pa.int32()),
            ],
            ["kind", "start", "end"],
        )
        yield W.with_column(part, name, W.lists_of(values, np.array([len(r) for r in found], np.int64)))


def redact(df: DataFrame, text: str = "text", limit: float | None = None, mask: str = "[SECRET]") -> DataFrame:
    """Replace the secrets of each text by ``mask``; overlapping ones by one mask.

    NULL stays NULL. All other columns stay as they are.
    """
    limit = threshold(df, text) if limit is None else limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.parts(batches, text):
            i = part.schema.get_field_index(text)
            found = spans_of(part.column(i), limit)
            if any(found):
                texts = part.column(i).to_pylist()
                for row, spans in enumerate(found):
                    if spans:
                        texts[row] = _masked(texts[row], spans, mask)
                part = part.set_column(i, part.schema.field(i), pa.array(texts, part.schema.field(i).type))
            yield part

    return df.mapInArrow(run, df.schema)


def _masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
