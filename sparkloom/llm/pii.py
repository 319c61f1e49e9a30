"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Four *base* rules (e-mail and IP addresses, card and phone numbers) find spans that always count. Looser
patterns propose more: written-out e-mail addresses, phone numbers without a country code, numbers of
persons and accounts, names after a title. On every candidate, base or not, a rule labeler, gazetteers, the
words before it, its borders and the look of its digits vote or abstain. Expectation-maximisation over the
votes of all documents estimates how far each labeler can be trusted, and a logistic classifier
trained on the posteriors accepts or refuses a candidate.

The texts are scanned twice, once for the counts of vote patterns and once with the verdict for each pattern; no
text leaves its task, and patterns are few however many documents there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.llm import em
from sparkloom.llm.common import require

# In the order in which spans are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "id", "name")
BASE_KINDS = KINDS[:4]
LABELERS = ("rule", "gazetteer", "context", "borders", "digits")
_CHUNK = 512

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")

# Written-out addresses, e.g. "jane (at) example (dot) org".
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?|\.)[A-Za-z0-9-]{1,63})+",
    re.IGNORECASE | re.ASCII,
)
_NATIONAL = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_PERSON_NO = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. ?[A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")

# Gazetteers and cue words: fixed lists.
_ENDINGS = frozenset("com org net edu gov mil int info io co de fr es it nl uk us ca au ch at be se no pl eu".split())
_FIRST_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica "
    "thomas sarah charles karen anna maria peter paul laura emma julia hans pierre jean carlos jose luis ana".split()
)
_AREA_FIRST = frozenset("23456789")
_CUES = {
    0: ("mail", "e-mail", "email", "contact", "write to"),
    1: ("ip", "address", "host", "server", "from"),
    2: ("card", "visa", "mastercard", "amex", "credit", "payment"),
    3: ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp"),
    4: ("ssn", "social security", "iban", "account", "passport", "tax id"),
    5: ("name", "dear", "by", "contact", "signed"),
}
_COUNTER_CUES = ("version", "order", "invoice", "isbn", "ticket", "sku", "total", "page", "figure", "serial", "hash", "id")


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    base: bool
    votes: tuple[int, ...]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    From each @ sign outwards, so that a long run without one costs nothing: of a run of local characters that ends at
    the sign, the leftmost after the last match is where a match starts.
    """
    last_sign = last_end = 0
    at = text.find("@")
    while at >= 0:
        floor = max(last_sign, last_end)
        run = text[floor:at]
        start = floor + len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            last_end = domain.end()
            yield start, last_end
        last_sign = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each base kind, leftmost and non-overlapping; a match that fails its check is dropped."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        found[0] = list(_emails(text))
    if _ANY_DIGIT.search(text):
        found[1] = [m.span() for m in _IP.finditer(text) if all(_small(g) for g in m.groups())]
        found[2] = [m.span() for m in _CARD.finditer(text) if _card_ok(m[0])]
        if "+" in text:
            found[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= _digit_count(m[0]) <= 15]
    return found


def _small(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _digit_count(s: str) -> int:
    return sum(map(s.count, "0123456789"))


def _card_ok(s: str) -> bool:
    return 13 <= _digit_count(s) <= 19 and luhn(s.replace(" ", "").replace("-", ""))


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text, in the order of their kinds and then of their starts."""
    base = base_spans(text)
    spans = [(kind, a, b, True, 1) for kind, own in enumerate(base) for a, b in own]
    if "at)" in text or "at]" in text or "AT)" in text or "AT]" in text:
        spans += [(0, *m.span(), False, 0) for m in _SPELLED.finditer(text)]
    if _ANY_DIGIT.search(text):
        spans += [(2, *m.span(), False, -1) for m in _CARD.finditer(text) if 13 <= _digit_count(m[0]) <= 19 and not _card_ok(m[0])]
        spans += [(1, *m.span(), False, -1) for m in _IP.finditer(text) if not all(_small(g) for g in m.groups())]
        spans += [(3, *m.span(), False, 0) for m in _NATIONAL.finditer(text)]
        spans += [(4, *m.span(), False, 0) for m in _PERSON_NO.finditer(text)]
        spans += [(4, *m.span(), False, 1 if _iban_ok(m[0]) else -1) for m in _IBAN.finditer(text)]
    if ". " in text or "r." in text:
        spans += [(5, *m.span(), False, 0) for m in _TITLED.finditer(text)]
    if not spans:
        return []
    held = [(a, b) for _, a, b, is_base, _ in spans if is_base]
    out = []
    for kind, a, b, is_base, rule in sorted(spans, key=lambda s: (s[0], s[1], s[2])):
        if not is_base and any(a < y and x < b for x, y in held):
            continue  # what a base span covers needs no other
        out.append(Candidate(kind, a, b, is_base, (rule, _gazetteer(kind, text[a:b]), _context(kind, text, a), _borders(text, a, b), _digits(kind, text[a:b]))))
    return out


def _gazetteer(kind: int, span: str) -> int:
    if kind == 0:
        return 1 if re.split(r"[.\])]\s?", span.rstrip("])"))[-1].strip().lower() in _ENDINGS else -1
    if kind == 1:
        return -1 if span.startswith(("0.", "10.", "127.", "192.168.", "255.")) else 1
    if kind == 2:
        digits = span.replace(" ", "").replace("-", "")
        return 1 if digits[0] in "3456" and len(digits) in (14, 15, 16, 19) else -1
    if kind == 3:
        digits = re.sub(r"[^0-9]", "", span)
        return 1 if span[0] == "+" and digits[0] != "0" or digits[0] in _AREA_FIRST else -1
    if kind == 5:
        return 1 if any(w.lower() in _FIRST_NAMES for w in re.split(r"[. ]+", span)) else 0
    return 0


def _context(kind: int, text: str, start: int) -> int:
    before = text[max(0, start - 24) : start].lower()
    if any(re.search(rf"(?<![a-z]){re.escape(c)}(?![a-z])", before) for c in _CUES[kind]):
        return 1
    return -1 if any(re.search(rf"(?<![a-z]){re.escape(c)}(?![a-z])", before) for c in _COUNTER_CUES) else 0


def _borders(text: str, start: int, end: int) -> int:
    beside = text[start - 1 : start] + text[end : end + 1]
    return -1 if any(c.isalnum() or c in "_/=" for c in beside) else 1


def _digits(kind: int, span: str) -> int:
    if kind in (0, 5):
        return 0
    digits = [c for c in span if c.isdigit()]
    return -1 if len(set(digits)) <= 2 and len(digits) >= 7 else 1


@dataclass(frozen=True)
class SpanModel:
    """What the classifier says of each vote pattern seen; others are refused."""

    accepted: frozenset[em.Pattern]

    def spans(self, text: str) -> list[Candidate]:
        """Base spans and the accepted others; of those that overlap the first stays."""
        out: list[Candidate] = []
        ends = 0, -1
        for c in candidates(text):
            if c.base or (c.kind, *c.votes) in self.accepted:
                if not c.base and ends[1] == c.kind and c.start < ends[0]:
                    continue
                out.append(c)
                ends = c.end, c.kind
        return out


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (base, kind, votes) of one task."""
    counts: Counter = Counter()
    for batch in batches:
        for first in range(0, batch.num_rows, _CHUNK):
            for text in batch.column(0).slice(first, _CHUNK).to_pylist():
                if text:
                    counts.update((c.base, c.kind, *c.votes) for c in candidates(text))
    if counts:
        columns = list(zip(*counts))
        names = ["base", "kind", *LABELERS, "n"]
        yield pa.record_batch([pa.array(columns[0]), *[pa.array(c, pa.int32()) for c in columns[1:]], pa.array(list(counts.values()), pa.int64())], names=names)


def fit(docs: DataFrame, text: str = "text", threshold: float = 0.9) -> SpanModel:
    """Estimate the labelers on all documents and train the classifier; a job runs when this is called."""
    require(docs, text)
    schema = "base boolean, kind int, " + ", ".join(f"{x} int" for x in LABELERS) + ", n long"
    counted = docs.select(F.col(text).alias("_text")).mapInArrow(_patterns, schema)
    # at most 2 * kinds * 3**labelers rows
    rows = counted.groupBy("base", "kind", *LABELERS).agg(F.sum("n").alias("n")).collect()
    counts: Counter = Counter()
    for r in rows:
        counts[(r["kind"], *[r[x] for x in LABELERS])] += r["n"]
    soft = em.posteriors(counts, len(KINDS), len(LABELERS))
    weights = em.train(soft, counts, len(KINDS))
    # a span that fails the check of its own rule is never personal data
    accepted = (p for p in counts if p[1] >= 0 and em.score(weights, p, len(KINDS)) >= threshold)
    return SpanModel(frozenset(accepted))


_SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]
)
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def _finder(model: SpanModel, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(first, _CHUNK)
                lists = [
                    [{"kind": KINDS[c.kind], "start": c.start, "end": c.end, "base": c.base} for c in model.spans(t)] if t else []
                    for t in batch.column(place).to_pylist()
                ]
                kept = [batch.column(k) for k in range(batch.num_columns) if k != place or names[k] is not None]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(_ARROW_SPAN))], names=[n for n in names if n is not None])

    return run


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` without ``text``, with the spans in it: array of (kind, start, end, base), in code points, by kind and start.

    Defined results: a null or empty text has no spans; a column called like the output is replaced; rows are
    independent, so repeated rows and empty tables need no rule.
    """
    require(docs, text)
    rows = docs.drop(out) if out != text else docs
    names: list[str | None] = [None if c == text else c for c in rows.columns]
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text], T.StructField(out, T.ArrayType(_SPAN))])
    return rows.mapInArrow(_finder(model, rows.columns.index(text), [*names, out]), schema)


def redact(text: str, spans: list[Candidate]) -> str:
    """The text with every span replaced by its kind; of spans that overlap the first stays."""
    out, at = [], 0
    for c in sorted(spans, key=lambda c: (c.start, -c.end)):
        if c.start < at:
            at = max(at, c.end)
            continue
        out += [text[at : c.start], f"<{KINDS[c.kind].upper()}>"]
        at = c.end
    return "".join([*out, text[at:]])


def _redactor(model: SpanModel, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _CHUNK):
                batch = whole.slice(first, _CHUNK)
                texts = [redact(t, model.spans(t)) if t else t for t in batch.column(place).to_pylist()]
                columns = list(batch.columns)
                columns[place] = pa.array(texts, batch.column(place).type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def redact_texts(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all rows and columns stay."""
    require(docs, text)
    return docs.mapInArrow(_redactor(model, docs.columns.index(text)), docs.schema)


def span_counts(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def span_list(spans: str = "spans", base_only: bool = False) -> Column:
    """``kind:start:end``, joined by commas."""
    own = F.filter(spans, lambda s: s["base"]) if base_only else F.col(spans)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
