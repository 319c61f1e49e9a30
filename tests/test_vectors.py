import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import vectors as vec
from sparkloom.plans.vector_queries import sample_router

DIM = 6


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(0)
    data = {s: rng.normal(size=(n, DIM)) * 2 for s, n in {1: 37, 2: 8, 3: 1, 4: 64}.items()}
    rows = [(s, i, [float(x) for x in v]) for s, m in data.items() for i, v in enumerate(m)]
    return data, spark.createDataFrame(rows, "seq_id long, pos int, vec array<double>")


@pytest.mark.parametrize("mode", ["inverse", "slash"])
@pytest.mark.parametrize("block,stride", [(8, 4), (16, 2), (8, 8)])
def test_block_mass_equals_the_dense_softmax(seqs, mode, block, stride):
    data, frame = seqs
    got = {(r.seq_id, r.qb, r.kb): r.score for r in vec.block_mass(frame, DIM, block, stride, mode=mode).collect()}
    seen = 0
    for s, m in data.items():
        groups = -(-len(m) // stride)
        padded = np.zeros((groups * stride, DIM))
        padded[: len(m)] = m
        k = padded.reshape(groups, stride, DIM)
        q = k[:, ::-1] if mode == "inverse" else k
        x = q.reshape(groups, -1) @ k.reshape(groups, -1).T / np.sqrt(DIM) / stride
        x[np.triu_indices(groups, 1)] = -np.inf
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        per = block // stride
        for qb in range(-(-groups // per)):
            total = 0.0
            for kb in range(qb + 1):
                want = p[qb * per : (qb + 1) * per, kb * per : (kb + 1) * per].sum()
                assert got[(s, qb, kb)] == pytest.approx(want, abs=1e-9)
                total += got[(s, qb, kb)]
                seen += 1
            assert total == pytest.approx(min(per, groups - qb * per))
    assert seen == len(got)


def test_block_mass_options(seqs):
    with pytest.raises(ValueError):
        vec.block_mass(seqs[1], DIM, 8, 4, mode="random")
    with pytest.raises(ValueError):
        vec.block_mass(seqs[1], DIM, 8, 3)


def test_segment_pool(spark, seqs):
    data, frame = seqs
    ranges = {1: [0, 0, 0, 29, 0, 29, 30, 36], 2: [0, 0, 0, 3, 0, 3, 4, 7], 3: [0, 0, 0, -1, 0, -1, 0, 0], 4: [0, 0, 0, 40, 0, 40, 41, 63]}
    table = spark.createDataFrame(list(ranges.items()), "seq_id long, range_ids array<int>")
    got = {(r.seq_id, r.segment): r.pooled for r in vec.segment_pool(frame, table, ["first_token", "ctx_q", "a"], 5, DIM).collect()}
    for s, r in ranges.items():
        for segment, (a, b) in {"first_token": (0, 1), "ctx_q": (2, 5), "a": (6, 7)}.items():
            start, end = r[a], r[b]
            part = data[s][start : end + 1]
            want = np.concatenate([part[:5], part[-5:]]).mean(axis=0) if end >= start else np.zeros(DIM)
            assert got[(s, segment)] == pytest.approx(want.tolist())
    with pytest.raises(ValueError):
        vec.segment_pool(frame, table, ["other"], 5, DIM)


def test_heads_at_full_width(spark):
    """4,096 dimensions and 8 heads: pooled by head, mean over heads, one decision for all of them."""
    dim, heads = 4096, 8
    rng = np.random.default_rng(1)
    data = {(s, h): rng.normal(size=(n, dim)) for s, n in {1: 9, 2: 3}.items() for h in range(heads)}
    rows = [(s, h, i, [float(x) for x in v]) for (s, h), m in data.items() for i, v in enumerate(m)]
    frame = spark.createDataFrame(rows, "seq_id long, head int, pos int, vec array<double>").repartition(4)
    ranges = spark.createDataFrame([(1, [0, 0, 0, 5, 0, 5, 6, 8]), (2, [0, 0, 0, 1, 0, 1, 2, 2])], "seq_id long, range_ids array<int>")
    pooled = vec.segment_pool(frame, ranges, ["ctx_q"], 2, dim, head="head")
    mean = {r.seq_id: np.array(r.pooled) for r in vec.mean_heads(pooled.drop("segment"), dim).collect()}
    for s, end in ((1, 5), (2, 1)):
        each = [np.concatenate([m[:2], m[max(0, end - 1) : end + 1]]).mean(axis=0) for h in range(heads) for m in [data[(s, h)][: end + 1]]]
        assert np.abs(mean[s] - np.mean(each, axis=0)).max() < 1e-12
    layer = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a), np.zeros(b))
    router = vec.Router((layer(dim, 16), layer(16, 8)), (layer(8, 8), layer(8, 8), layer(8, 2)))
    routed = vec.route_decision(vec.mean_heads(pooled.drop("segment"), dim), router, tau=vec.learned_tau(-0.5))
    got = vec.for_heads(routed, heads).collect()
    assert sorted((r.seq_id, r["head"]) for r in got) == [(s, h) for s in (1, 2) for h in range(heads)]
    for r in got:
        a, b = router.logits(mean[r.seq_id])
        assert r.share == pytest.approx(1 / (1 + np.exp((a - b) / np.exp(-0.5))))
        assert r.full_path == (b > a)


@pytest.mark.parametrize("log_temperature,want", [(-5.0, 0.3), (-0.5, np.exp(-0.5)), (0.0, 1.0), (3.0, 1.0)])
def test_learned_temperature(spark, log_temperature, want):
    assert spark.range(1).select(vec.learned_tau(log_temperature)).first()[0] == pytest.approx(want)


def test_means_without_weights_and_with_null_keys(spark):
    rows = [(None, 1.0, [1.0, 3.0]), (None, 3.0, [5.0, 3.0]), (1, 0.0, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "k long, w double, v array<double>")
    got = {r.k: r.pooled for r in vec.mean_vectors(frame, ["k"], "v", 2, F.col("w")).collect()}
    assert got == {None: [4.0, 3.0], 1: [0.0, 0.0]}
    assert vec.mean_vectors(frame.filter("false"), ["k"], "v", 2).collect() == []


def test_whole_sequence_pools(seqs):
    data, frame = seqs
    whole = {r.seq_id: r.pooled for r in vec.mean_pool(frame, DIM).collect()}
    ends = {r.seq_id: r.pooled for r in vec.ends_pool(frame, 10, DIM).collect()}
    for s, m in data.items():
        assert whole[s] == pytest.approx(m.mean(axis=0).tolist())
        assert ends[s] == pytest.approx(np.concatenate([m[:10], m[-10:]]).mean(axis=0).tolist())


@pytest.mark.parametrize("softmax", [True, False])
def test_router(spark, softmax):
    router = sample_router(softmax)
    x = np.random.default_rng(1).normal(size=(20, 64))
    frame = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "seq_id long, pooled array<double>")
    got = {r.seq_id: r for r in vec.route_decision(frame, router, tau=1.3).collect()}
    logits = router.logits(x)
    for i in range(20):
        assert got[i].logits == pytest.approx(logits[i].tolist())
        z = logits[i] / 1.3
        want = np.exp(z[1]) / np.exp(z).sum() if softmax else 1 / (1 + np.exp(-z[0]))
        assert got[i].share == pytest.approx(float(want))
        assert got[i].full_path == bool(np.argmax(z) == 1 if softmax else want > 0.5)


def brute(length, allowed):
    return {q: [k for k in range(q + 1) if allowed(q, k)] for q in range(length)}


@pytest.mark.parametrize("length", [1, 7, 40])
def test_ranges_list_the_same_keys(spark, length):
    pos = F.col("pos").cast("int")
    frame = spark.range(length).select(F.col("id").alias("pos"))
    cases = {
        "causal": (vec.causal_ranges(pos), lambda q, k: True),
        "local": (vec.local_ranges(pos, 6), lambda q, k: k > q - 6),
        "sink": (vec.sink_local_ranges(pos, 3, 5), lambda q, k: k < 3 or k > q - 5),
        "triangle": (
            vec.triangle_ranges(pos, F.lit(length), 1, 2, 4, 9),
            lambda q, k: length - q <= 9 or k // 4 < 1 or k // 4 > q // 4 - 2,
        ),
    }
    for ranges, allowed in cases.values():
        want = brute(length, allowed)
        for r in frame.select("pos", ranges.alias("r")).collect():
            keys = [k for part in r.r for k in range(part["from"], part["to"] + 1)]
            assert keys == want[r.pos]


def test_unknown_ids_give_zeros(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    ids = spark.createDataFrame([(0, 1), (1, 9)], "row long, token long")
    got = {r.row: r.vec for r in vec.vocab_lookup(ids, table, "token", 2).collect()}
    assert got == {0: [1.0, 2.0], 1: [0.0, 0.0]}


def test_toggles(spark):
    frame = spark.range(30).select(F.col("id").cast("int").alias("pos"))
    keys = lambda r: [k for part in r for k in range(part["from"], part["to"] + 1)]
    for toggle, allowed in {
        "none": lambda q, k: True,
        "local": lambda q, k: k > q - 5,
        "streaming": lambda q, k: k // 4 < 1 or k // 4 > q // 4 - 2,
        "triangle": lambda q, k: 30 - q <= 6 or k // 4 < 1 or k // 4 > q // 4 - 2,
    }.items():
        ranges = vec.toggle_ranges(toggle, F.col("pos"), F.lit(30), sink=1, local=2, window=5, last=6, block=4)
        want = brute(30, allowed)
        assert all(keys(r.r) == want[r.pos] for r in frame.select("pos", ranges.alias("r")).collect())
    with pytest.raises(ValueError):
        vec.toggle_ranges("topk", F.col("pos"), F.lit(30))


def test_heads_are_kept_apart(spark, seqs):
    from sparkloom.operators import selection

    keys = ("seq_id", "head")
    both = seqs[1].withColumn("head", F.lit(0)).unionByName(
        seqs[1].withColumn("head", F.lit(1)).withColumn("vec", F.transform("vec", lambda x: x * 2))
    )
    mass = vec.block_mass(both, DIM, 8, 4, keys=keys)
    alone = {(r.seq_id, r.qb, r.kb): r.score for r in vec.block_mass(seqs[1], DIM, 8, 4).collect()}
    got = mass.collect()
    assert {(r.seq_id, r.qb, r.kb): r.score for r in got if r["head"] == 0} == pytest.approx(alone)
    assert len(got) == 2 * len(alone)
    share = F.when(F.col("head") == 0, 0.5).otherwise(0.9)
    kept = selection.top_p_blocks(mass, share, keys=keys).groupBy("head").agg(F.sum(F.col("keep").cast("int")).alias("n"))
    one = selection.top_p_blocks(vec.block_mass(seqs[1], DIM, 8, 4), 0.5).filter("keep").count()
    assert {r["head"]: r.n for r in kept.collect()}[0] == one
