"""Secrets in text: three fixed rules, and a randomness test battery for tokens that no rule knows.

A token is a run of at least 20 characters that encodings use, with its padding; an equals sign between a name and
a value bounds both. Its encoding is inferred (hexadecimal, base32,
base62, base64 or its URL form), its characters become numbers in the encoding's alphabet, and three tests ask
whether they could be random: a chi-squared test of uniformity over bins of the alphabet, a runs test around
the median, and a test of serial correlation. Fisher's method joins the three p-values.

Random tokens have p-values spread evenly over 0..1, words and names have theirs near 0, and this is how false
discoveries are controlled: the distinct tokens of the corpus are counted by encoding, length class and p-value, each
once, however often it was copied. In a class, the tokens above one half tell how many random ones there are; from that follows, for any level, which
part of the tokens above it are false. The lowest level whose part stays under ``rate`` is the class's
own. Short classes, where the tests have little power, thus ask for more. Every class starts from the same few prior
counts, which its own tokens outweigh as they grow in number; there is no other rule for small classes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.llm.common import require

# In the order in which spans that start together are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "random")
BASE_KINDS = KINDS[:3]
LEVELS = 50
LENGTHS = (20, 24, 32, 40, 64, 128)
# Counts by p-value bin that a class starts from: random tokens spread evenly, ordinary ones below 0.1.
PRIOR = tuple(21 if k < LEVELS // 10 else 1 for k in range(LEVELS))
_CHUNK = 512

_ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# An equals sign is padding behind a token, and otherwise parts a name from its value.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?(?![A-Za-z0-9+/_-])")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Alphabets of the encodings, in the order in which they are tried, with the sizes of their bins.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef", (4, 4, 4, 4)),
    ("hex_upper", _DIGITS + "ABCDEF", (4, 4, 4, 4)),
    ("base32", _UPPER + "234567", (8, 8, 8, 8)),
    ("base62", _UPPER + _LOWER + _DIGITS, (13, 13, 13, 13, 10)),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", (13, 13, 13, 13, 12)),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", (13, 13, 13, 13, 12)),
)
_PLACES = [{c: k for k, c in enumerate(alphabet)} for _, alphabet, _ in ENCODINGS]
_BINS = [[b for b, size in enumerate(sizes) for _ in range(size)] for _, _, sizes in ENCODINGS]


def chi_squared_tail(x: float, freedom: int) -> float:
    """Probability that a chi-squared value with this many degrees of freedom exceeds ``x``."""
    if x <= 0:
        return 1.0
    a, h = freedom / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-12:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    # continued fraction, evaluated from the front
    b = h + 1 - a
    c, d = 1e300, 1 / b
    f = d
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        f *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return min(1.0, f * scale)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> int | None:
    """Place in ``ENCODINGS`` of the first whose alphabet holds the token; none for plain numbers and plain words."""
    body = token.rstrip("=")
    letters = {c for c in body if not c.isdigit()}
    if not letters or len(letters) == len(set(body)) and not any(c in "+/" for c in body):
        return None
    chars = set(body)
    return next((k for k, places in enumerate(_PLACES) if chars <= places.keys()), None)


def randomness(token: str, encoding: int) -> float:
    """Joint p-value of the three tests under the hypothesis that the token is random."""
    places = _PLACES[encoding]
    values = [places[c] for c in token.rstrip("=")]
    n, sizes = len(values), ENCODINGS[encoding][2]
    whole = sum(sizes)
    held = Counter(_BINS[encoding][v] for v in values)
    uniform = chi_squared_tail(sum((held[b] - n * s / whole) ** 2 / (n * s / whole) for b, s in enumerate(sizes)), len(sizes) - 1)
    high = [v >= whole / 2 for v in values]
    above = sum(high)
    below = n - above
    if above and below:
        mean = 1 + 2 * above * below / n
        spread = 2 * above * below * (2 * above * below - n) / (n * n * (n - 1))
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        in_runs = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        in_runs = 0.0
    middle = sum(values) / n
    around = [v - middle for v in values]
    square = sum(a * a for a in around)
    serial = sum(a * b for a, b in zip(around, around[1:])) / square if square else 1.0
    in_series = _two_sided((serial + 1 / n) * math.sqrt(n))
    joint = -2 * sum(math.log(max(p, 1e-12)) for p in (uniform, in_runs, in_series))
    return chi_squared_tail(joint, 6)


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


@dataclass(frozen=True)
class Token:
    start: int
    end: int
    encoding: int
    length: int
    p: float

    @property
    def bin(self) -> int:
        return min(LEVELS - 1, int(self.p * LEVELS))


def tokens(text: str) -> list[Token]:
    """Tokens of a text that an encoding could have made."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        encoding = infer_encoding(token)
        if encoding is not None and not _UUID.fullmatch(token):
            out.append(Token(m.start(), m.end(), encoding, length_class(len(token)), randomness(token, encoding)))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules, leftmost and non-overlapping per kind; failing matches are dropped."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in _ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class Levels:
    """Per class of encoding and length, the p-value from which a token counts as random; one for all other classes."""

    by_class: dict[tuple[int, int], float] = field(default_factory=dict)
    unseen: float = 2.0

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end): base spans, and random tokens that no base span touches."""
        found = base_spans(text)
        for t in tokens(text):
            level = self.by_class.get((t.encoding, t.length), self.unseen)
            if t.p >= level and not any(a < t.end and t.start < b for a, kind, b in found if kind < 3):
                found.append((t.start, 3, t.end))
        return sorted(found)


def level_of(own: list[int], rate: float) -> float:
    """The lowest p-value level whose tokens are false at no more than ``rate``; ``own`` counts by p-value bin.

    With ``rate`` at 0.05, say, at most one in twenty of the tokens that pass are not random, as far as the class has
    tokens enough to tell; ``PRIOR`` is added at every size, and alone gives 0.1. 2 if no level will do.
    """
    counts = [a + b for a, b in zip(own, PRIOR)]
    random = 2 * sum(counts[LEVELS // 2 :])
    passed, best = 0, 2.0
    for k in range(LEVELS - 1, -1, -1):
        passed += counts[k]
        expected = random * (LEVELS - k) / LEVELS
        false = max(0.0, passed - expected)
        # counting noise may not pass for a surplus of ordinary tokens
        if passed and false - 2 * math.sqrt(passed) <= rate * passed:
            best = k / LEVELS
        elif false > 0.5 * passed:
            break
    return max(best, 1 / LEVELS) if best < 2 else best


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(encoding, length, bin, hash) of the tokens, each once per chunk of documents."""
    names = ["encoding", "length", "bin", "hash"]
    for batch in batches:
        for first in range(0, batch.num_rows, _CHUNK):
            found = {
                (t.encoding, t.length, t.bin, hashlib.blake2b(text[t.start : t.end].encode(), digest_size=16).digest())
                for text in batch.column(0).slice(first, _CHUNK).to_pylist()
                if text
                for t in tokens(text)
            }
            if found:
                *numbers, hashes = zip(*found)
                columns = [*[pa.array(c, pa.int32()) for c in numbers], pa.array(hashes, pa.binary())]
                yield pa.record_batch(columns, names=names)


def fit(docs: DataFrame, text: str = "text", rate: float = 0.05) -> Levels:
    """Levels from the distinct tokens of all documents; a job runs when this is called."""
    require(docs, text)
    found = docs.select(F.col(text).alias("_text")).mapInArrow(_distinct, "encoding int, length int, bin int, hash binary")
    # copies are joined before the shuffle by hash; at most encodings * length classes * bins rows are collected
    rows = found.distinct().groupBy("encoding", "length", "bin").agg(F.count("*").alias("n")).collect()
    by_class: dict[tuple[int, int], list[int]] = {}
    for r in rows:
        by_class.setdefault((r["encoding"], r["length"]), [0] * LEVELS)[r["bin"]] += r["n"]
    return Levels({key: level_of(counts, rate) for key, counts in by_class.items()}, level_of([0] * LEVELS, rate))


_FIELDS = [("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType())]
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _finder(levels: Levels, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(first, _CHUNK)
                lists = [
                    [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in levels.spans(t)] if t else []
                    for t in batch.column(place).to_pylist()
                ]
                kept = [c for k, c in enumerate(batch.columns) if k != place]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(_ARROW_SPAN))], names=names)

    return run


def find_secrets(docs: DataFrame, levels: Levels, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` without ``text``, with the secrets in it: array of (kind, start, end), in code points, by start and kind.

    Defined results: a null or empty text has no secrets; a column called like the output is replaced; rows are
    independent, so repeated rows and empty tables need no rule. Plain numbers, plain words and UUIDs are no secrets
    unless a base rule says so.
    """
    require(docs, text)
    rows = docs.drop(out) if out != text else docs
    kept = [f for f in rows.schema.fields if f.name != text]
    span = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(span))])
    return rows.mapInArrow(_finder(levels, rows.columns.index(text), schema.names), schema)


def secret_counts(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_list(spans: str = "spans", base_only: bool = False) -> Column:
    """``kind:start:end``, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"] != KINDS[3]) if base_only else F.col(spans)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
