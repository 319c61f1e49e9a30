"""The registered queries on a given table, every column that has a rule against plain Python."""

import collections
import hashlib
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name, types, sf=SF):
    """Rows of a query, with the names and types of its contract."""
    df = queries.QUERIES[name](spark, sf)
    named = dict(df.dtypes)
    assert {column: named[column] for column in types} == types
    return df.collect()


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, docs):
    kinds = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    rows = result(spark, "op1_source_mix", kinds)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes = collections.Counter()
    for d in docs.values():
        sizes[d.source] += len(brute.words_of(d.text))
    targets, taken = brute.targets(sizes), collections.Counter()
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len(brute.words_of(d.text)) and r.source_size == sizes[d.source]
        assert r.target == pytest.approx(targets[d.source]) and 0 <= r.taken <= 2 * r["size"]
        taken[d.source] += r.taken
    assert all(taken[s] == pytest.approx(t, rel=0.01, abs=2) for s, t in targets.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.01)


def luhn(digits):
    doubled = [int(c) * 2 if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def personal(text):
    """(kind, start, end) of the base rules, by kind, then start."""

    def digits(m):
        return re.sub(r"\D", "", m[0])

    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(kind, m.start(), m.end()) for kind, rule, keep in rules for m in re.finditer(rule, text) if keep(m)]


def secrets(text):
    """(kind, start, end) of the base rules, by start, then kind."""
    assign = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    rules = [
        ("assign", assign, lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), k, m.end()) for k, (_, rule, keep) in enumerate(rules) for m in re.finditer(rule, text) if keep(m)]
    return [(rules[k][0], a, b) for a, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


@pytest.mark.parametrize(
    "name,plain,kinds", [("op2_personal_data", personal, ("email", "ip", "card", "phone")), ("op8_secret_tests", secrets, ("assign", "access", "hex"))]
)
def test_op2_op8(spark, name, plain, kinds):
    sf = "/root/testdata/sf0.01"  # the smallest table holds no secrets
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    types = {"doc_id": "bigint"} | {f"n_{k}": "bigint" for k in kinds} | {"base_sha256": "string", "spans": "string"}
    rows = result(spark, name, types, sf)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    seen = 0
    for r in rows:
        text = docs[r.doc_id].text or ""
        base = plain(text)
        counts = collections.Counter(kind for kind, _, _ in base)
        assert [r[f"n_{k}"] for k in kinds] == [counts[k] for k in kinds]
        assert r.base_sha256 == sha256(joined(base))
        listed = [(kind, int(a), int(b)) for kind, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(listed) and len(set(listed)) == len(listed)
        assert all(0 <= a < b <= len(text) for _, a, b in listed)
        if name.startswith("op2"):
            assert listed == sorted(listed, key=lambda x: (kinds.index(x[0]), x[1]))
        else:
            assert [a for _, a, _ in listed] == sorted(a for _, a, _ in listed)
        seen += len(base)
    assert seen > 0


def test_op3(spark, docs):
    types = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = result(spark, "op3_byte_bpe", types)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False))


def test_op4(spark, docs):
    types = {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = result(spark, "op4_kd_shards", types)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots, load, of_text = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in rows:
        data = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        of_text[docs[r.doc_id].text].add(r.shard)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((d.text or "").encode()) for d in docs.values())
    assert max(load.values()) - min(load.values()) <= 2 * largest
    assert all(len(shards) == 1 for shards in of_text.values())


def test_op7(spark, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    types = {"doc_id": "bigint"} | dict.fromkeys(names, "bigint") | {"base_failed": "boolean", "kept": "boolean"}
    rows = result(spark, "op7_quality_votes", types)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        m = brute.measures(docs[r.doc_id].text)
        assert tuple(r[n] for n in names) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert not (r.base_failed and r.kept)
    assert any(r.kept for r in rows)


def test_op9(spark):
    types = {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = result(spark, "op9_stable_projections", types)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for query, hit in found.items():
        scores = vectors @ vectors[ids == query][0]
        scores[ids == query] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        assert [rank for rank, _, _ in hit] == list(range(1, 21))
        assert hit == sorted(hit, key=lambda x: (-x[2], x[1]))
        assert all(s == pytest.approx(scores[ids == v][0], abs=1e-12) for _, v, s in hit)
        hits += len(set(ids[best].tolist()) & {v for _, v, _ in hit})
    assert hits >= 0.9 * 20 * len(found)
