"""Queries over instruction items: reading, cleaning, prompts, tokens, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.functions import text, tokens
from sparkloom.operators import chats, ordering, packing, vocabulary
from sparkloom.plans.registry import query
from sparkloom.plans import views as v
from sparkloom.session import stage_path
from sparkloom.sources import corpus

MAX_LEN, MIN_LEN, SHARDS = 2048, 64, 8
CONFIG = packing.PackConfig(max_len=MAX_LEN, min_len=MIN_LEN, shards=SHARDS)


def joined(values: Column, separator: str = ",") -> Column:
    return F.array_join(values.cast("array<string>"), separator)


def fingerprint(values: Column) -> Column:
    return F.md5(joined(values))


def sql_fingerprint(expression: str) -> str:
    return f"md5(array_to_string({expression}, ','))"


@query(
    "read_corpus",
    f"""WITH {v.SFT_ITEMS_SQL}
    SELECT item_id, length(context) AS context_chars, length(question) AS question_chars,
           answer IS NULL AS no_answer, task FROM items""",
)
def read_corpus(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "corpus")
    v.sft_items(spark, sf).write.parquet(path)
    return corpus.read_corpus(spark, path).select(
        "item_id",
        F.length("context").alias("context_chars"),
        F.length("question").alias("question_chars"),
        F.col("answer").isNull().alias("no_answer"),
        F.col("metadata.task").alias("task"),
    )


@query(
    "multi_dataset_scan",
    """SELECT 'part' AS dataset, 100 AS max_length, count(*) AS rows, sum(p_partkey) AS keys FROM part
    UNION ALL SELECT 'supplier', 200, count(*), sum(s_suppkey) FROM supplier""",
    casts="keys BIGINT",
)
def multi_dataset_scan(spark: SparkSession, sf: str) -> DataFrame:
    both = corpus.multi_dataset_scan(spark, "part,supplier", f"{sf}/part.parquet,{sf}/supplier.parquet", "100,200")
    return both.groupBy("dataset", "max_length").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce("p_partkey", "s_suppkey")).alias("keys")
    )


_MARKED_SQL = """marked AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 5 = 0
         THEN chr(65279) || text || chr(65279) ELSE text END AS text FROM documents)"""


@query(
    "clean_text",
    f"""WITH {_MARKED_SQL}
    SELECT doc_id, length(c) AS chars, md5(c) AS mark
    FROM (SELECT doc_id, replace(coalesce(text, ''), chr(65279), '') AS c FROM marked)""",
)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.text_table(spark, sf, "documents")
    marked = F.when(F.pmod("doc_id", F.lit(7)) == 3, F.lit(None)).when(
        F.pmod("doc_id", F.lit(5)) == 0, F.concat(F.lit(text.BOM), "text", F.lit(text.BOM))
    ).otherwise(F.col("text"))
    clean = text.clean_text(marked)
    return docs.select("doc_id", F.length(clean).alias("chars"), F.md5(clean).alias("mark"))


@query(
    "parse_metadata",
    f"""WITH {v.SFT_ITEMS_SQL}
    SELECT item_id, CASE WHEN item_id % 7 IN (3, 5) THEN 'Other' ELSE task END AS task,
           item_id % 7 IN (3, 5) OR is_prefix AS is_prefix,
           CASE WHEN item_id % 7 IN (3, 5) THEN NULL ELSE length END AS length
    FROM items""",
)
def parse_metadata(spark: SparkSession, sf: str) -> DataFrame:
    items = v.sft_items(spark, sf)
    literal = F.concat(
        F.lit("{'task': '"), F.col("metadata.task"), F.lit("', 'is_prefix': "),
        F.when(F.col("metadata.is_prefix"), "True").otherwise("False"),
        F.lit(", 'length': '"), F.col("metadata.length"), F.lit("', 'note': None}"),
    )
    kind = F.pmod("item_id", F.lit(7))
    raw = items.select("item_id", F.when(kind == 3, "not a literal").when(kind == 5, F.lit(None)).otherwise(literal).alias("m"))
    return raw.select("item_id", text.parse_metadata(F.col("m"), raw.schema["m"].dataType).alias("p")).select(
        "item_id", "p.task", "p.is_prefix", "p.length"
    )


@query(
    "extract_length",
    f"""WITH {v.SFT_ITEMS_SQL}
    SELECT item_id, CASE item_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE coalesce(CAST(length AS INTEGER), 0) END AS length
    FROM items""",
)
def extract_length(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.pmod("item_id", F.lit(5))
    raw = F.when(kind == 1, F.lit("")).when(kind == 2, F.lit("many")).otherwise(F.col("metadata.length"))
    return v.sft_items(spark, sf).select("item_id", text.extract_length(raw).alias("length"))


@query(
    "assemble_prompt",
    f"WITH {v.SFT_PROMPTS_SQL} SELECT item_id, is_prefix, md5(prompt) AS prompt_md5, length(prompt) AS chars FROM prompt",
)
def assemble_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = text.assemble_prompt(
        text.clean_text(F.col("context")), text.clean_text(F.col("question")), F.col("metadata.is_prefix")
    )
    return (
        v.sft_items(spark, sf)
        .select("item_id", F.col("metadata.is_prefix").alias("is_prefix"), prompt.alias("prompt"))
        .select("item_id", "is_prefix", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("chars"))
    )


@query(
    "task_prompt_wrap",
    f"""WITH {v.SFT_PROMPTS_SQL}
    SELECT item_id, md5(user_text) AS user_md5, substr(user_text, 1, 40) AS head FROM wrapped""",
)
def task_prompt_wrap(spark: SparkSession, sf: str) -> DataFrame:
    prompt = text.assemble_prompt(
        text.clean_text(F.col("context")), text.clean_text(F.col("question")), F.col("metadata.is_prefix")
    )
    return (
        v.sft_items(spark, sf)
        .select("item_id", text.task_prompt_wrap(prompt, F.col("metadata.task")).alias("u"))
        .select("item_id", F.md5("u").alias("user_md5"), F.substring("u", 1, 40).alias("head"))
    )


@query(
    "render_chat",
    f"""WITH {v.SFT_ITEMS_SQL}
    SELECT item_id, md5(chat) AS chat_md5, length(chat) AS chars, md5(chat || '<|im_start|>assistant' || chr(10)) AS open_md5
    FROM (SELECT item_id, '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10)
            || CASE WHEN coalesce(answer, '') <> '' THEN '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10)
                    ELSE '' END AS chat FROM items)""",
)
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    message = lambda role, column: F.struct(F.lit(role).alias("role"), F.col(column).alias("content"))
    user = message("user", "question")
    messages = F.when(
        F.coalesce("answer", F.lit("")) != "", F.array(user, message("assistant", "answer"))
    ).otherwise(F.array(user))
    chats = v.sft_items(spark, sf).select("item_id", messages.alias("m"))
    return chats.select(
        "item_id", text.render_chat(F.col("m")).alias("chat"),
        text.render_chat(F.col("m"), add_generation_prompt=True).alias("open"),
    ).select("item_id", F.md5("chat").alias("chat_md5"), F.length("chat").alias("chars"), F.md5("open").alias("open_md5"))


CHAT_PART = 2000


@query(
    "render_conversations",
    f"""WITH chats AS (
      SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
        || '<|im_start|>assistant' || chr(10) AS chat FROM conversations GROUP BY 1),
    parts AS (SELECT conv_id, chat, unnest(range((length(chat) + {CHAT_PART} - 1) // {CHAT_PART})) AS part FROM chats)
    SELECT conv_id, part, md5(substr(chat, part * {CHAT_PART} + 1, {CHAT_PART})) AS text_md5 FROM parts""",
)
def render_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Chats of all turns of a conversation, ready for the next answer, in parts of a bounded length."""
    placed = chats.chat_turns(v.table(spark, sf, "conversations"))
    parts = chats.chat_parts(placed, add_generation_prompt=True, part_chars=CHAT_PART)
    return parts.select("conv_id", "part", F.md5("text").alias("text_md5"))


@query(
    "tokenize",
    f"""SELECT doc_id, len(ids) AS n, {sql_fingerprint('ids')} AS ids_md5
    FROM (SELECT doc_id, {v.sql_ids('text')} AS ids FROM documents)""",
)
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    ids = v.text_table(spark, sf, "documents").select("doc_id", tokens.tokenize(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query(
    "append_eos",
    f"""SELECT doc_id, len(ids) + 1 AS n, {v.SQL_EOS} AS last_id
    FROM (SELECT doc_id, {v.sql_ids('text')} AS ids FROM documents)""",
)
def append_eos(spark: SparkSession, sf: str) -> DataFrame:
    ended = v.text_table(spark, sf, "documents").select(
        "doc_id", tokens.append_eos(tokens.tokenize(F.col("text")), tokens.eos_id()).alias("ids")
    )
    # a second application must not add another end
    twice = tokens.append_eos(F.col("ids"), tokens.eos_id())
    return ended.select("doc_id", F.size(twice).alias("n"), F.element_at(twice, -1).alias("last_id"))


def _labels_sql(masked: str) -> str:
    return f"list_transform(input_ids, lambda x, i: CASE WHEN i <= {masked} THEN -100 ELSE x END)"


@query(
    "build_labels",
    f"""WITH {v.SFT_SAMPLES_SQL}
    SELECT item_id, {sql_fingerprint(_labels_sql('1'))} AS labels_md5, {sql_fingerprint(_labels_sql('user_len'))} AS sft_md5
    FROM samples""",
)
def build_labels(spark: SparkSession, sf: str) -> DataFrame:
    samples = packing.process_items(v.sft_items(spark, sf), CONFIG)
    return samples.select(
        "item_id",
        fingerprint(F.col("labels")).alias("labels_md5"),
        fingerprint(tokens.build_labels(F.col("input_ids"), F.col("user_len"), True)).alias("sft_md5"),
    )


@query(
    "range_ids",
    f"""WITH {v.SFT_SAMPLES_SQL}
    SELECT item_id, concat_ws(',', 0, 0, 0, user_len - 1, 0, user_len - 1, user_len, n - 1) AS ranges FROM samples""",
)
def range_ids(spark: SparkSession, sf: str) -> DataFrame:
    samples = packing.process_items(v.sft_items(spark, sf), CONFIG)
    return samples.select("item_id", joined(F.col("range_ids")).alias("ranges"))


_CLASS_SQL = "CASE task " + " ".join(f"WHEN '{n}' THEN {i}" for n, i in text.TASK_CLASSES.items()) + " ELSE 5 END"


@query(
    "task_class_id",
    f"""WITH {v.SFT_ITEMS_SQL}
    SELECT item_id, task, {_CLASS_SQL} AS task_id, CASE WHEN task = 'Other' THEN 'Unknown' ELSE task END AS back FROM items""",
)
def task_class_id(spark: SparkSession, sf: str) -> DataFrame:
    task = F.col("metadata.task")
    named = v.sft_items(spark, sf).select("item_id", task.alias("task"), text.task_class_id(task).alias("task_id"))
    return named.withColumn("back", text.task_class_name(F.col("task_id")))


@query(
    "shift_labels",
    f"""WITH {v.SFT_SAMPLES_SQL}, labelled AS (SELECT item_id, {_labels_sql('1')} AS labels FROM samples)
    SELECT item_id, {sql_fingerprint('labels[2:] || [-100]')} AS shifted_md5, {sql_fingerprint('labels[2:]')} AS dropped_md5
    FROM labelled""",
)
def shift_labels(spark: SparkSession, sf: str) -> DataFrame:
    samples = packing.process_items(v.sft_items(spark, sf), CONFIG)
    return samples.select(
        "item_id",
        fingerprint(tokens.shift_labels(F.col("labels"))).alias("shifted_md5"),
        fingerprint(tokens.drop_first_label(F.col("labels"))).alias("dropped_md5"),
    )


@query(
    "count_valid_labels",
    f"""WITH {v.SFT_SAMPLES_SQL}, numbered AS (
      SELECT *, row_number() OVER (ORDER BY length, item_id) - 1 AS idx FROM samples)
    SELECT idx // 4 AS micro_batch, sum(n - 1) AS valid, sum(n - user_len) AS sft_valid, count(*) AS samples
    FROM numbered GROUP BY 1""",
    casts="valid BIGINT, sft_valid BIGINT",
)
def count_valid_labels(spark: SparkSession, sf: str) -> DataFrame:
    items = v.sft_items(spark, sf)
    samples = packing.process_items(items, CONFIG).select(
        "item_id",
        tokens.count_valid_labels(F.col("labels")).alias("valid"),
        tokens.count_valid_labels(tokens.build_labels(F.col("input_ids"), F.col("user_len"), True)).alias("sft_valid"),
    )
    order = ordering.sort_by_length(packing.with_length(items).select("item_id", "length"))
    return (
        ordering.micro_batches(order.join(samples, "item_id"), 4)
        .groupBy("micro_batch")
        .agg(F.sum("valid").alias("valid"), F.sum("sft_valid").alias("sft_valid"), F.count("*").alias("samples"))
    )


@query(
    "truncate_context",
    f"""WITH {v.SFT_ITEMS_SQL}, t AS (
      SELECT item_id, {v.sql_ids("coalesce(context, '')")} AS ctx, {v.sql_ids('question')} AS q FROM items)
    SELECT item_id, least(len(ctx), greatest(256 - len(q), 0)) AS kept,
           {sql_fingerprint('ctx[1:greatest(256 - len(q), 0)]')} AS ctx_md5 FROM t""",
)
def truncate_context(spark: SparkSession, sf: str) -> DataFrame:
    parts = v.sft_items(spark, sf).select(
        "item_id",
        tokens.tokenize(F.coalesce("context", F.lit(""))).alias("ctx"),
        F.size(tokens.split_tokens(F.col("question"))).alias("other"),
    )
    cut = parts.select("item_id", tokens.truncate_context(F.col("ctx"), 256, F.col("other")).alias("c"))
    return cut.select("item_id", F.size("c").alias("kept"), fingerprint(F.col("c")).alias("ctx_md5"))


@query(
    "count_tokens",
    f"""SELECT lang, source, count(*) AS docs, sum(n) AS tokens, min(n) AS shortest, max(n) AS longest,
           round(avg(n), 6) AS mean
    FROM (SELECT lang, source, len({v.sql_tokens('text')}) AS n FROM documents) GROUP BY ALL""",
    casts="tokens BIGINT",
)
def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(tokens.split_tokens(F.col("text"))).alias("n")
    return v.text_table(spark, sf, "documents").select("lang", "source", n).groupBy("lang", "source").agg(
        F.count("*").alias("docs"),
        F.sum("n").alias("tokens"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
        F.round(F.avg("n"), 6).alias("mean"),
    )


@query(
    "detokenize",
    f"""WITH {v.REQUESTS_SQL}
    SELECT seq_id, len(c) AS n, md5(array_to_string(c, ' ')) AS text_md5
    FROM (SELECT seq_id, token_words[num_prompt_tokens + 1:] AS c FROM requests)""",
)
def detokenize(spark: SparkSession, sf: str) -> DataFrame:
    """Completions as ids of a vocabulary of all words, and back."""
    reqs = v.requests(spark, sf)
    path = stage_path(spark, "vocabulary")
    vocabulary.append_tokens(reqs.select(F.col("token_words").alias("tokens")), path)
    known = vocabulary.read_vocabulary(spark, path)
    completions = reqs.select("seq_id", tokens.completion_ids(F.col("token_words"), F.col("num_prompt_tokens")).alias("tokens"))
    back = vocabulary.decode(vocabulary.encode(completions, known), known)
    return back.select("seq_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("text_md5"))


_VOCABULARY_SQL = f"""used AS (
    SELECT DISTINCT unnest({v.sql_tokens('text')}) AS token, 1 AS version FROM documents
    UNION SELECT DISTINCT unnest({v.sql_tokens('text')}), 2 FROM conversations),
  vocabulary AS (
    SELECT token, row_number() OVER (ORDER BY version, token) - 1 AS id, version
    FROM (SELECT token, min(version) AS version FROM used GROUP BY 1))"""


def _grown_vocabulary(spark: SparkSession, sf: str) -> str:
    """The tokens of all documents, then those of all conversations."""
    path = stage_path(spark, "vocabulary")
    for name in ("documents", "conversations"):
        texts = v.text_table(spark, sf, name)
        vocabulary.append_tokens(texts.select(tokens.split_tokens(F.col("text")).alias("tokens")), path)
    return path


@query("grown_vocabulary", f"WITH {_VOCABULARY_SQL} SELECT token, id, CAST(version AS INTEGER) AS version FROM vocabulary")
def grown_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary.read_vocabulary(spark, _grown_vocabulary(spark, sf))


@query(
    "tokenize_vocabulary",
    f"""WITH {_VOCABULARY_SQL}, long AS (
      SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {v.sql_tokens('text')} AS t FROM documents)),
    joined AS (SELECT doc_id, count(*) AS n, {sql_fingerprint('list(id ORDER BY pos)')} AS ids_md5 FROM long JOIN vocabulary USING (token) GROUP BY 1)
    SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(ids_md5, md5('')) AS ids_md5 FROM documents LEFT JOIN joined USING (doc_id)""",
)
def tokenize_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that no two tokens share, from a vocabulary that grew in between."""
    known = vocabulary.read_vocabulary(spark, _grown_vocabulary(spark, sf))
    docs = v.text_table(spark, sf, "documents").select("doc_id", tokens.split_tokens(F.col("text")).alias("tokens"))
    ids = vocabulary.encode(docs, known)
    return ids.select("doc_id", F.size("ids").alias("n"), fingerprint(F.col("ids")).alias("ids_md5"))


@query(
    "length_bounds",
    f"WITH {v.SFT_SAMPLES_SQL} SELECT item_id, n FROM samples WHERE n BETWEEN {MIN_LEN} AND {MAX_LEN}",
)
def length_bounds(spark: SparkSession, sf: str) -> DataFrame:
    samples = packing.process_items(v.sft_items(spark, sf), CONFIG).select("item_id", "n")
    return packing.length_bounds(samples, MIN_LEN, MAX_LEN)


@query(
    "max_samples",
    """SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
    FROM documents) WHERE r <= 7""",
)
def max_samples(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("source", "doc_id")
    return packing.max_samples(docs, "source", "doc_id", 7)


@query(
    "few_shot_join",
    f"""WITH {v.SFT_ITEMS_SQL},
    demos AS (SELECT text AS demo, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS place, count(*) OVER () AS total
              FROM benchmark),
    slots AS (SELECT item_id, unnest(range(3)) AS slot, CAST('0x' || substr(md5('42:' || item_id), 1, 7) AS BIGINT) AS base FROM items)
    SELECT s.item_id, md5(string_agg(d.demo, chr(10) ORDER BY s.slot)) AS demos_md5, count(*) AS shots
    FROM slots s JOIN demos d ON d.place = (s.base + s.slot) % d.total GROUP BY s.item_id""",
)
def few_shot_join(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators import requests as rq

    items = v.sft_items(spark, sf).select("item_id")
    demos = v.table(spark, sf, "benchmark").select(F.col("item_id").alias("demo_id"), F.col("text").alias("demo"))
    shots = rq.few_shot_join(items, demos, shots=3, seed=42)
    return shots.select("item_id", F.md5(F.array_join("demos", "\n")).alias("demos_md5"), F.size("demos").alias("shots"))
