"""Queries over packing, shards, batches and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import tokens
from sparkloom.operators import ordering, packing, requests as rq
from sparkloom.plans import views as v
from sparkloom.plans.item_queries import CONFIG, MAX_LEN, MIN_LEN, SHARDS, fingerprint, joined, sql_fingerprint
from sparkloom.plans.registry import query
from sparkloom.session import stage_path
from sparkloom.sources import corpus, pack_cache

PLACED_SQL = v.SFT_SAMPLES_SQL + f""",
numbered AS (SELECT *, row_number() OVER (ORDER BY length, item_id) - 1 AS idx,
                    ntile({SHARDS}) OVER (ORDER BY length, item_id) - 1 AS shard FROM samples),
kept AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY idx) AS rn
  FROM numbered WHERE n BETWEEN {MIN_LEN} AND {MAX_LEN})"""

PACKED_SQL = "RECURSIVE " + PLACED_SQL + f""",
fold(shard, rn, item_id, n, used, pack_no) AS (
  SELECT shard, rn, item_id, n, n, 0 FROM kept WHERE rn = 1
  UNION ALL
  SELECT k.shard, k.rn, k.item_id, k.n, CASE WHEN f.used + k.n <= {MAX_LEN} THEN f.used + k.n ELSE k.n END,
         CASE WHEN f.used + k.n <= {MAX_LEN} THEN f.pack_no ELSE f.pack_no + 1 END
  FROM fold f JOIN kept k ON k.shard = f.shard AND k.rn = f.rn + 1),
packs AS (
  SELECT k.shard, f.pack_no, count(*) AS items, sum(k.n) AS tokens,
         flatten(list(k.input_ids ORDER BY k.idx)) AS input_ids,
         flatten(list([-100] || k.input_ids[2:] ORDER BY k.idx)) AS labels,
         list(k.n ORDER BY k.idx) AS lengths,
         list(k.task ORDER BY k.idx) AS task_type,
         string_agg(concat_ws(',', 0, 0, 0, k.user_len - 1, 0, k.user_len - 1, k.user_len, k.n - 1), ';' ORDER BY k.idx) AS ranges
  FROM kept k JOIN fold f USING (item_id) GROUP BY k.shard, f.pack_no)"""


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.build_packed_dataset(v.sft_items(spark, sf), CONFIG)


@query(
    "pack_next_fit",
    f"""WITH {PACKED_SQL} SELECT shard, count(*) AS packs, sum(items) AS items, sum(tokens) AS tokens,
    min(tokens) AS min_used, max(tokens) AS max_used FROM packs GROUP BY shard""",
    casts="items BIGINT, tokens BIGINT, min_used BIGINT, max_used BIGINT",
)
def pack_next_fit(spark: SparkSession, sf: str) -> DataFrame:
    items = v.sft_items(spark, sf)
    samples = packing.staged_samples(items, CONFIG)
    return packing.pack_summary(packing.assign_packs(items, samples, CONFIG))


PACK_SQL = f"""SELECT shard, pack_no, {sql_fingerprint('input_ids')} AS ids_md5, {sql_fingerprint('labels')} AS labels_md5,
    '0,' || array_to_string(list_transform(lengths, lambda x, i: list_sum(lengths[1:i])), ',') AS offsets,
    array_to_string(task_type, ',') AS tasks, ranges FROM packs"""


def pack_view(packs: DataFrame) -> DataFrame:
    return packs.select(
        "shard",
        "pack_no",
        fingerprint(F.col("input_ids")).alias("ids_md5"),
        fingerprint(F.col("labels")).alias("labels_md5"),
        joined(F.col("seq_lengths")).alias("offsets"),
        joined(F.col("task_type")).alias("tasks"),
        F.array_join(F.transform("range_ids", lambda r: joined(r)), ";").alias("ranges"),
    )


@query("finalize_pack", f"WITH {PACKED_SQL} {PACK_SQL}")
def finalize_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack_view(packed(spark, sf))


def _cache_file(spark: SparkSession, sf: str) -> str:
    return pack_cache.cache_path(
        stage_path(spark, "cache"), sf, "SQL_Words", MAX_LEN, min_len=MIN_LEN, shards=SHARDS, is_sft=False
    )


@query("write_pack_cache", f"WITH {PACKED_SQL} {PACK_SQL}")
def write_pack_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = _cache_file(spark, sf)
    pack_cache.write_pack_cache(packed(spark, sf), path)
    return pack_view(spark.read.parquet(path))


@query("read_pack_cache", f"WITH {PACKED_SQL} {PACK_SQL}")
def read_pack_cache(spark: SparkSession, sf: str) -> DataFrame:
    path = _cache_file(spark, sf)
    pack_cache.cached_packs(spark, path, lambda: packed(spark, sf))  # first call builds

    def not_again() -> DataFrame:
        raise RuntimeError("the cache was not used")

    return pack_view(pack_cache.cached_packs(spark, path, not_again))


@query(
    "typed_pack_items",
    f"""WITH {PACKED_SQL} SELECT shard, pack_no, len(input_ids) AS tokens, list_sum(input_ids) AS id_sum,
    list_sum(labels) AS label_sum, 'array<bigint>' AS id_type FROM packs""",
    casts="id_sum BIGINT, label_sum BIGINT",
)
def typed_pack_items(spark: SparkSession, sf: str) -> DataFrame:
    typed = corpus.typed_pack_items(packed(spark, sf))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return typed.select(
        "shard", "pack_no", F.size("input_ids").alias("tokens"), total("input_ids").alias("id_sum"),
        total("labels").alias("label_sum"), F.expr("typeof(input_ids)").alias("id_type"),
    )


@query(
    "unpack",
    f"""WITH {PACKED_SQL} SELECT k.shard, f.pack_no, k.n, {sql_fingerprint('k.input_ids')} AS ids_md5,
    {sql_fingerprint('[-100] || k.input_ids[2:]')} AS labels_md5, k.task AS task_type FROM kept k JOIN fold f USING (item_id)""",
)
def unpack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.unpack(packed(spark, sf), "shard", "pack_no").select(
        "shard", "pack_no", "n", fingerprint(F.col("input_ids")).alias("ids_md5"),
        fingerprint(F.col("labels")).alias("labels_md5"), "task_type",
    )


@query(
    "cu_seqlens",
    f"""WITH {PACKED_SQL} SELECT shard, pack_no, len(lengths) + 1 AS offsets, list_sum(lengths) AS last_offset,
    list_max(lengths) AS longest FROM packs""",
    casts="last_offset INTEGER",
)
def cu_seqlens(spark: SparkSession, sf: str) -> DataFrame:
    offsets = F.col("seq_lengths")
    gaps = F.zip_with(F.slice(offsets, 2, F.size(offsets) - 1), F.slice(offsets, 1, F.size(offsets) - 1), lambda b, a: b - a)
    return packed(spark, sf).select(
        "shard", "pack_no", F.size(offsets).alias("offsets"), F.element_at(offsets, -1).alias("last_offset"),
        F.array_max(gaps).alias("longest"),
    )


@query(
    "sp_split",
    f"""WITH {PACKED_SQL},
    padded AS (SELECT shard, pack_no, CAST((tokens + 3) // 4 AS BIGINT) AS part,
      input_ids || list_transform(range(CAST((4 - tokens % 4) % 4 AS BIGINT)), lambda x: 0) AS ids,
      labels[2:] || [-100] || list_transform(range(CAST((4 - tokens % 4) % 4 AS BIGINT)), lambda x: -100) AS shifted,
      len(lengths) + 1 AS offsets FROM packs)
    SELECT shard, pack_no, r AS sp_rank, offsets, {sql_fingerprint('ids[r * part + 1:(r + 1) * part]')} AS ids_md5,
      {sql_fingerprint('shifted[r * part + 1:(r + 1) * part]')} AS shifted_md5
    FROM padded, (SELECT CAST(unnest(range(4)) AS INTEGER) AS r)""",
)
def sp_split(spark: SparkSession, sf: str) -> DataFrame:
    return packing.sp_split(packed(spark, sf), 4).select(
        "shard", "pack_no", "sp_rank", F.size("seq_lengths").alias("offsets"),
        fingerprint(F.col("input_ids")).alias("ids_md5"), fingerprint(F.col("shifted_labels")).alias("shifted_md5"),
    )


@query(
    "union_chunks",
    f"""WITH {PACKED_SQL} SELECT shard % 2 AS part, count(*) AS packs, sum(tokens) AS tokens FROM packs GROUP BY 1""",
    casts="tokens BIGINT",
)
def union_chunks(spark: SparkSession, sf: str) -> DataFrame:
    items = v.sft_items(spark, sf)
    samples = packing.staged_samples(items, CONFIG)
    sharded = ordering.contiguous_shards(
        packing.with_length(items).select("item_id", "length"), "length", "item_id", shards=SHARDS
    )
    sizes = sharded.join(samples.select("item_id", "n"), "item_id").select("shard", "idx", "item_id", "n")
    halves = [packing.pack_next_fit(sizes.filter(F.pmod("shard", F.lit(2)) == i), MAX_LEN) for i in (0, 1)]
    both = packing.union_chunks(*halves).groupBy("shard", "pack_no").agg(F.sum("n").alias("n"))
    return both.groupBy((F.col("shard") % 2).alias("part")).agg(F.count("*").alias("packs"), F.sum("n").alias("tokens"))


@query(
    "sort_by_length",
    "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS idx FROM documents",
)
def sort_by_length(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    return ordering.sort_by_length(docs, "n_chars", "doc_id").select("doc_id", "idx")


@query(
    "contiguous_shards",
    "SELECT doc_id, ntile(32) OVER (ORDER BY n_chars, doc_id) - 1 AS shard FROM documents",
)
def contiguous_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    return ordering.contiguous_shards(docs, "n_chars", "doc_id", shards=32).select("doc_id", "shard")


@query(
    "replica_shards",
    """SELECT doc_id, idx % 6 AS replica, idx // 6 AS place FROM (
      SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents)
    WHERE idx < total // 6 * 6""",
)
def replica_shards(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id")
    return ordering.replica_shards(docs, "doc_id", world=12, sequence_parallel=2, seed=7)


@query(
    "replica_shards_eval",
    """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS total FROM documents),
    padded AS (SELECT doc_id, idx AS eval_idx, false AS is_padding FROM d
      UNION ALL SELECT doc_id, idx + total, true FROM d WHERE idx < (6 - total % 6) % 6)
    SELECT doc_id, eval_idx, eval_idx % 6 AS replica, eval_idx // 6 AS place, is_padding FROM padded""",
)
def replica_shards_eval(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id")
    return ordering.replica_shards_eval(docs, "doc_id", world=12, sequence_parallel=2)


@query("sequential_order", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def sequential_order(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.with_global_index(v.table(spark, sf, "documents").select("doc_id"), "doc_id").drop("total")


@query(
    "micro_batches",
    """SELECT micro_batch, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
      SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS micro_batch FROM documents) GROUP BY 1""",
)
def micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    per = ordering.accumulation_steps(batch=384, per_device=1, gpus=8, nodes=1)
    indexed = ordering.with_global_index(v.table(spark, sf, "documents").select("doc_id"), "doc_id")
    return ordering.micro_batches(indexed, per).groupBy("micro_batch").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


@query(
    "resume_offset",
    """SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS idx FROM documents)
    WHERE idx >= 5 * 4 * 8 * 2 // 2""",
)
def resume_offset(spark: SparkSession, sf: str) -> DataFrame:
    seen = ordering.consumed_samples(step=5, batch=4, world=8, accumulation=2, replication=2)
    docs = v.table(spark, sf, "documents").select("doc_id").withColumn("mix", ordering.shuffle_key(7, "doc_id"))
    return ordering.resume_offset(docs, "mix", "doc_id", consumed=seen).select("doc_id", "idx")


@query(
    "positions",
    f"""WITH {v.REQUESTS_SQL} SELECT seq_id, len(token_words) - start AS n, start AS first_pos, len(token_words) - 1 AS last_pos,
    (start + len(token_words) - 1) * (len(token_words) - start) // 2 AS pos_sum
    FROM (SELECT *, least(seq_id % 5, n - 1) AS start FROM requests)""",
)
def positions(spark: SparkSession, sf: str) -> DataFrame:
    start = F.least(F.pmod("seq_id", F.lit(5)), F.col("n") - 1).cast("int")
    reqs = v.requests(spark, sf).select("seq_id", F.sequence(start, F.col("n") - 1).alias("pos"))
    return reqs.select(
        "seq_id", F.size("pos").alias("n"), F.element_at("pos", 1).alias("first_pos"), F.element_at("pos", -1).alias("last_pos"),
        F.aggregate("pos", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("pos_sum"),
    )


@query(
    "split_prompt_completion",
    f"""WITH {v.REQUESTS_SQL} SELECT seq_id, num_prompt_tokens AS prompt_tokens, n - num_prompt_tokens AS completion_tokens,
    md5(array_to_string(token_words[1:num_prompt_tokens], ' ')) AS prompt_md5,
    md5(array_to_string(token_words[num_prompt_tokens + 1:], ' ')) AS completion_md5 FROM requests""",
)
def split_prompt_completion(spark: SparkSession, sf: str) -> DataFrame:
    parts = v.requests(spark, sf).select(
        "seq_id", tokens.prompt_ids(F.col("token_words"), F.col("num_prompt_tokens")).alias("p"),
        tokens.completion_ids(F.col("token_words"), F.col("num_prompt_tokens")).alias("c"),
    )
    return parts.select(
        "seq_id", F.size("p").alias("prompt_tokens"), F.size("c").alias("completion_tokens"),
        F.md5(F.array_join("p", " ")).alias("prompt_md5"), F.md5(F.array_join("c", " ")).alias("completion_md5"),
    )


@query(
    "token_blocks",
    f"""WITH {v.REQUESTS_SQL}, b AS (SELECT seq_id, n, token_words, unnest(range((n + 63) // 64)) AS block_no FROM requests)
    SELECT seq_id, block_no, least(64, n - block_no * 64) AS tokens, (n + 63) // 64 AS blocks,
      n - ((n + 63) // 64 - 1) * 64 AS last_tokens,
      md5(array_to_string(token_words[block_no * 64 + 1:(block_no + 1) * 64], ' ')) AS block_md5 FROM b""",
)
def token_blocks(spark: SparkSession, sf: str) -> DataFrame:
    cut = v.requests(spark, sf).select(
        "seq_id", "n", F.posexplode(tokens.token_blocks(F.col("token_words"), 64)).alias("block_no", "b")
    )
    return cut.select(
        "seq_id", "block_no", F.size("b").alias("tokens"), tokens.block_count(F.col("n"), 64).alias("blocks"),
        tokens.last_block_tokens(F.col("n"), 64).alias("last_tokens"), F.md5(F.array_join("b", " ")).alias("block_md5"),
    )


@query(
    "cut_completion",
    f"""WITH {v.REQUESTS_SQL}, c AS (SELECT seq_id, max_tokens, seq_id % 3 = 0 AS ignore_eos,
      list_transform(token_words[num_prompt_tokens + 1:], lambda w: md5(w)[1] || '') AS ids FROM requests),
    s AS (SELECT *, CASE WHEN ignore_eos OR NOT list_contains(ids, 'a') THEN len(ids) ELSE list_position(ids, 'a') END AS stop FROM c)
    SELECT seq_id, least(stop, max_tokens) AS kept, ignore_eos,
      array_to_string(ids[1:least(stop, max_tokens)], '') AS completion FROM s""",
)
def cut_completion(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(
        tokens.completion_ids(F.col("token_words"), F.col("num_prompt_tokens")), lambda w: F.substring(F.md5(w), 1, 1)
    )
    done = v.requests(spark, sf).select(
        "seq_id", (F.pmod("seq_id", F.lit(3)) == 0).alias("ignore_eos"), "max_tokens", ids.alias("ids")
    )
    done = done.withColumn("c", tokens.cut_completion(F.col("ids"), F.lit("a"), F.col("max_tokens"), F.col("ignore_eos")))
    return done.select("seq_id", F.size("c").alias("kept"), "ignore_eos", F.array_join("c", "").alias("completion"))


@query(
    "pad_unpad",
    f"""WITH {v.REQUESTS_SQL}, l AS (SELECT seq_id, list_transform(token_words, lambda w: length(w)) AS ids, n,
      max(n) OVER (PARTITION BY seq_id // 8) AS width FROM requests)
    SELECT seq_id, width, width - n AS padding, -1 * (width - n) + list_sum(ids) AS padded_sum, list_sum(ids) AS unpadded_sum FROM l""",
    casts="padded_sum BIGINT, unpadded_sum BIGINT",
)
def pad_unpad(spark: SparkSession, sf: str) -> DataFrame:
    reqs = v.requests(spark, sf).select(
        "seq_id", "n", F.floor(F.col("seq_id") / 8).alias("batch"), F.transform("token_words", F.length).alias("ids")
    )
    widths = reqs.groupBy("batch").agg(F.max("n").alias("width"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    padded = reqs.join(widths, "batch").withColumn("p", tokens.pad_to(F.col("ids"), F.col("width"), tokens.PAD_BLOCK))
    return padded.select(
        "seq_id", F.size("p").alias("width"), (F.size("p") - F.col("n")).alias("padding"), total("p").alias("padded_sum"),
        total(tokens.unpad(F.col("p"), F.col("n"))).alias("unpadded_sum"),
    )


BUDGET, BATCH_REQUESTS = 2048, 16


@query(
    "token_budget_batches",
    f"""WITH RECURSIVE {v.REQUESTS_SQL},
    q AS MATERIALIZED (SELECT seq_id, n, row_number() OVER (ORDER BY seq_id) AS rn, (n + {BUDGET - 1}) // {BUDGET} AS parts FROM requests),
    fold(rn, seq_id, n, batch_no, parts, used, held) AS (
      SELECT rn, seq_id, n, CAST(0 AS BIGINT), parts, n - (parts - 1) * {BUDGET}, 1 FROM q WHERE rn = 1
      UNION ALL
      SELECT q.rn, q.seq_id, q.n,
        CASE WHEN f.used + q.n <= {BUDGET} AND f.held < {BATCH_REQUESTS} THEN f.batch_no + f.parts - 1 ELSE f.batch_no + f.parts END,
        CASE WHEN f.used + q.n <= {BUDGET} AND f.held < {BATCH_REQUESTS} THEN 1 ELSE q.parts END,
        CASE WHEN f.used + q.n <= {BUDGET} AND f.held < {BATCH_REQUESTS} THEN f.used + q.n ELSE q.n - (q.parts - 1) * {BUDGET} END,
        CASE WHEN f.used + q.n <= {BUDGET} AND f.held < {BATCH_REQUESTS} THEN f.held + 1 ELSE 1 END
      FROM fold f JOIN q ON q.rn = f.rn + 1),
    cut AS (SELECT *, unnest(range(parts)) AS part FROM fold)
    SELECT batch_no + part AS batch_no, seq_id, part * {BUDGET} AS from_token, least(n, (part + 1) * {BUDGET}) AS to_token FROM cut""",
)
def token_budget_batches(spark: SparkSession, sf: str) -> DataFrame:
    return rq.token_budget_batches(v.requests(spark, sf).select("seq_id", "n"), BUDGET, BATCH_REQUESTS)


BLOCK = 16
PREFIX_SQL = f"""{v.REQUESTS_SQL},
  blocks AS (SELECT seq_id, unnest(range(n // {BLOCK})) AS block_no, token_words FROM requests),
  prefixes AS (SELECT seq_id, block_no, md5(array_to_string(token_words[1:(block_no + 1) * {BLOCK}], ' ')) AS chain FROM blocks),
  seen AS (SELECT block_no, min(seq_id) AS first_seq, count(*) AS requests, chain FROM prefixes GROUP BY chain, block_no)"""


@query(
    "prefix_reuse",
    f"""WITH {PREFIX_SQL} SELECT r.seq_id, r.n // {BLOCK} AS full_blocks, r.n // {BLOCK} - coalesce(w.k, 0) AS cached_blocks,
    (r.n // {BLOCK} - coalesce(w.k, 0)) * {BLOCK} AS cached_tokens
    FROM requests r LEFT JOIN (SELECT p.seq_id, count(*) AS k FROM prefixes p JOIN seen s USING (chain)
      WHERE s.first_seq = p.seq_id GROUP BY 1) w USING (seq_id)""",
)
def prefix_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return rq.prefix_reuse(v.requests(spark, sf), BLOCK, "token_words")


@query("first_seen_prefix", f"WITH {PREFIX_SQL} SELECT block_no, first_seq, requests FROM seen")
def first_seen_prefix(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = rq.block_prefixes(v.requests(spark, sf), BLOCK, "token_words")
    return rq.first_seen_prefix(prefixes).select("block_no", "first_seq", "requests")


@query(
    "prefix_groups",
    f"WITH {PREFIX_SQL} SELECT first_seq, requests, (block_no + 1) * {BLOCK} AS shared_tokens FROM seen WHERE requests > 1",
)
def prefix_groups(spark: SparkSession, sf: str) -> DataFrame:
    prefixes = rq.block_prefixes(v.requests(spark, sf), BLOCK, "token_words")
    return rq.prefix_groups(prefixes).select(
        "first_seq", "requests", ((F.col("block_no") + 1) * BLOCK).alias("shared_tokens")
    )


@query(
    "zip_params",
    f"""WITH {v.REQUESTS_SQL} SELECT r.seq_id, r.n, coalesce(0.5 + (l.quality * 0.25), 1.0) AS temperature, r.max_tokens, false AS ignore_eos
    FROM requests r LEFT JOIN labels l ON l.doc_id = r.seq_id""",
    casts="temperature DOUBLE",
)
def zip_params(spark: SparkSession, sf: str) -> DataFrame:
    reqs = packing.one_param_for_all(v.requests(spark, sf).select("seq_id", "n", "max_tokens"), ignore_eos=False)
    params = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("seq_id"), (0.5 + F.col("quality") * 0.25).alias("temperature")
    )
    return packing.checked_params(packing.zip_params(reqs, params, default={"temperature": 1.0})).select(
        "seq_id", "n", "temperature", "max_tokens", "ignore_eos"
    )


@query(
    "restore_order",
    f"""WITH {v.REQUESTS_SQL} SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS place, n - num_prompt_tokens AS completion_tokens
    FROM requests""",
)
def restore_order(spark: SparkSession, sf: str) -> DataFrame:
    finished = v.requests(spark, sf).select("seq_id", (F.col("n") - F.col("num_prompt_tokens")).alias("completion_tokens"))
    return ordering.restore_order(finished)
