"""Properties of packed rows, with shards that hold very different numbers of items."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import packing
from sparkloom.sources import corpus, pack_cache

CONFIG = packing.PackConfig(max_len=120, min_len=12, shards=5)


@pytest.fixture(scope="module")
def built(spark):
    rng = random.Random(5)
    word = lambda n: " ".join(rng.choice(["red", "green", "blue"]) for _ in range(n))
    rows = [
        (i, word(rng.choice([1, 5, 30, 200])), word(3), word(rng.randint(0, 9)), (rng.choice(["Code", "Other"]), i % 2 == 0, str(rng.choice([4, 4, i]))))
        for i in range(300)
    ]
    schema = "item_id long, context string, question string, answer string, metadata struct<task string, is_prefix boolean, length string>"
    items = spark.createDataFrame(rows, schema)
    samples = packing.staged_samples(items, CONFIG)
    places = packing.assign_packs(items, samples, CONFIG, chunks=6)
    packs = packing.finalize_pack(samples.join(places.select("item_id", "shard", "idx", "pack_no"), "item_id"), "shard", "pack_no")
    return items, packing.length_bounds(packing.process_items(items, CONFIG), 12, 120).toPandas(), places.toPandas(), packs.cache()


def test_every_kept_item_once_and_in_order(built):
    items, samples, places, _ = built
    assert sorted(places.item_id) == sorted(samples.item_id) and places.item_id.is_unique
    assert samples.n.between(CONFIG.min_len, CONFIG.max_len).all()
    ordered = places.sort_values("idx")
    for _, shard in ordered.groupby("shard"):
        assert shard.pack_no.is_monotonic_increasing
        used = shard.groupby("pack_no").n.sum()
        first = shard.groupby("pack_no").n.first()
        assert used.max() <= CONFIG.max_len
        assert list(used.index) == list(range(len(used)))
        for k in range(len(used) - 1):  # the next sample did not fit
            assert used[k] + first[k + 1] > CONFIG.max_len


def test_bounds_are_inclusive(spark):
    sizes = spark.createDataFrame([(11,), (12,), (120,), (121,)], "n int")
    assert [r.n for r in packing.length_bounds(sizes, 12, 120).orderBy("n").collect()] == [12, 120]


def test_unpack_is_the_inverse(built):
    _, samples, places, packs = built
    back = packing.unpack(packs, "shard", "pack_no").toPandas()
    want = samples.merge(places[["item_id", "shard", "idx", "pack_no"]], on="item_id").sort_values(["shard", "idx"])
    back = back.sort_values(["shard", "pack_no", "ord"])
    assert [list(x) for x in back.input_ids] == [list(x) for x in want.input_ids]
    assert [list(x) for x in back.labels] == [list(x) for x in want.labels]
    assert back.task_type.tolist() == want.task_type.tolist()
    assert [list(x) for x in back.range_ids] == [list(x) for x in want.range_ids]


def test_pack_shape(built):
    for row in built[3].collect():
        assert row.seq_lengths[0] == 0 and row.seq_lengths[-1] == len(row.input_ids) == len(row.labels)
        assert all(row.labels[s] == -100 for s in row.seq_lengths[:-1])
        assert len(row.task_ids) == len(row.task_type) == len(row.range_ids) == len(row.seq_lengths) - 1


def test_shifted_labels_never_cross_samples(built):
    for parts in (3, 4):
        whole = {(r.shard, r.pack_no): r for r in built[3].collect()}
        split = {}
        for r in packing.sp_split(built[3], parts).collect():
            split.setdefault((r.shard, r.pack_no), {})[r.sp_rank] = r
        for key, ranks in split.items():
            row = whole[key]
            assert sorted(ranks) == list(range(parts))
            assert len({len(r.input_ids) for r in ranks.values()}) == 1
            ids = sum((ranks[i].input_ids for i in range(parts)), [])
            labels = sum((ranks[i].shifted_labels for i in range(parts)), [])
            n = len(row.input_ids)
            assert ids[:n] == row.input_ids and set(ids[n:]) <= {0}
            assert labels[: n - 1] == row.labels[1:] and set(labels[n - 1 :]) == {-100}
            assert all(labels[s - 1] == -100 for s in row.seq_lengths[1:])
            assert all(r.seq_lengths == row.seq_lengths for r in ranks.values())


def test_result_does_not_depend_on_chunks(spark, built):
    items, _, places, _ = built
    samples = packing.staged_samples(items, CONFIG)
    again = packing.assign_packs(items, samples, CONFIG, chunks=1).toPandas()
    key = ["item_id", "shard", "idx", "pack_no"]
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, places[key].values.tolist()))


def test_instruction_labels(built):
    """With the user turn masked, only answers and end tokens are learned."""
    from dataclasses import replace

    masked = packing.build_packed_dataset(built[0], replace(CONFIG, is_sft=True)).collect()
    plain = {(r.shard, r.pack_no): r for r in built[3].collect()}
    assert len(masked) == len(plain)
    for row in masked:
        assert row.input_ids == plain[(row.shard, row.pack_no)].input_ids
        for start, end, ranges in zip(row.seq_lengths, row.seq_lengths[1:], row.range_ids):
            user = ranges[6]
            assert row.labels[start : start + user] == [-100] * user
            assert row.labels[start + user : end] == row.input_ids[start + user : end]


def test_empty_input(spark, built):
    none = built[0].filter("item_id < 0")
    assert packing.build_packed_dataset(none, CONFIG).count() == 0


def test_length_column_wins(built):
    items = built[0].withColumn("length", F.lit(3))
    assert packing.with_length(items).agg(F.max("length")).first()[0] == 3


def test_cache(spark, built, tmp_path):
    packs = built[3]
    path = pack_cache.cache_path(str(tmp_path), "/data/raw/", "Model_8B", 120, min_len=12)
    assert path.split("/")[-1].startswith("raw_model_8b_packed_maxseq120_")
    assert path != pack_cache.cache_path(str(tmp_path), "/data/raw/", "Model_8B", 120, min_len=13)
    calls = []

    def build():
        calls.append(1)
        return packs

    first = pack_cache.cached_packs(spark, path, build)
    second = pack_cache.cached_packs(spark, path, build)
    assert len(calls) == 1 and first.count() == second.count() == packs.count()
    assert pack_cache.write_pack_cache(packs, path) is False  # never overwritten
    typed = corpus.typed_pack_items(second)
    assert dict(typed.dtypes)["input_ids"] == "array<bigint>" and dict(typed.dtypes)["seq_lengths"] == "array<int>"


def test_unreadable_cache_is_rebuilt(spark, built, tmp_path):
    path = str(tmp_path / "bad.parquet")
    spark.range(3).write.parquet(path)  # not packs
    assert pack_cache.read_pack_cache(spark, path) is None
    assert pack_cache.cached_packs(spark, path, lambda: built[3]).count() == built[3].count()


def test_read_corpus(spark, built, tmp_path):
    folder = str(tmp_path / "raw")
    built[0].drop("item_id").write.parquet(folder)
    (tmp_path / "raw" / "notes.txt").write_text("not data")
    got = corpus.read_corpus(spark, folder)
    assert got.count() == 300 and got.select("item_id").distinct().count() == 300
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path / "none"))
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, str(tmp_path / "other"))


def test_bad_temperature(spark):
    frame = spark.createDataFrame([(0.0,)], "temperature double")
    with pytest.raises(Exception, match="temperature"):
        packing.checked_params(frame).collect()


def test_max_samples_keeps_hot_dataset_whole(spark):
    rows = [("a" if i % 3 else "b", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "d string, i long")
    got = packing.max_samples(frame, "d", "i", 40).toPandas()
    for d in ("a", "b"):
        assert sorted(got[got.d == d].i) == sorted(i for x, i in rows if x == d)[:40]


def test_every_prompt_has_its_params(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "seq_id long, prompt string")
    params = spark.createDataFrame([(i, 0.5 + i) for i in range(0, 6, 2)], "seq_id long, temperature double")
    got = packing.zip_params(prompts, params, default={"temperature": 1.0}).orderBy("seq_id").collect()
    assert [r.temperature for r in got] == [0.5, 1.0, 2.5, 1.0, 4.5, 1.0]
    with pytest.raises(Exception, match="no params"):
        packing.zip_params(prompts, params).collect()
    six = spark.createDataFrame([(10 * i, 0.1 * i) for i in range(6)], "place long, temperature double")
    paired = packing.zip_by_position(prompts, six, "seq_id", "place").orderBy("seq_id").collect()
    assert [r.temperature for r in paired] == [0.1 * i for i in range(6)]
    for other in (six.filter("place < 50"), six.limit(0), six.union(six.filter("place = 0").withColumn("place", F.lit(99)))):
        with pytest.raises(Exception, match="differ in number"):
            packing.zip_by_position(prompts, other, "seq_id", "place").collect()


def test_a_failed_cache_write_is_made_good(spark, tmp_path):
    packs = spark.createDataFrame(
        [([1], [1], [0, 1], [0], ["a"], [[0] * 8])],
        "input_ids array<int>, labels array<int>, seq_lengths array<int>, task_ids array<int>, task_type array<string>, range_ids array<array<int>>",
    )
    path = str(tmp_path / "cache.parquet")
    (tmp_path / "cache.parquet").mkdir()
    (tmp_path / "cache.parquet" / "part-0.parquet").write_bytes(b"half")
    assert pack_cache.read_pack_cache(spark, path) is None
    assert pack_cache.write_pack_cache(packs, path)
    assert pack_cache.read_pack_cache(spark, path).count() == 1
    assert not pack_cache.write_pack_cache(packs, path)
    assert [p.name for p in tmp_path.iterdir()] == ["cache.parquet"]
