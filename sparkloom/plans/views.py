"""Views that turn the given tables into the inputs of the operators.

Each has a DataFrame form and, where queries are checked, the same view in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions import text
from sparkloom.functions.tokens import END_OF_TEXT, TOKEN_PATTERN
from sparkloom.sources.corpus import spread_small

# First hour of the event stream, and lengths used by the views.
ORIGIN = "2024-01-01"
SEQ_LEN = 64
PROMPT_SHARE = 0.75


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on."""
    return spread_small(table(spark, sf, name), f"{sf}/{name}.parquet")


def _task_of(number):
    names = list(text.TASK_CLASSES)
    out = F.lit("Other")
    for i, name in enumerate(names):
        out = F.when(number == i, name).otherwise(out)
    return out


def sft_items(spark: SparkSession, sf: str) -> DataFrame:
    """Instruction items: a user turn, the next assistant turn, a document as context."""
    turns = text_table(spark, sf, "conversations")
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    answers = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("conv_id"), F.col("text").alias("context"), "n_chars"
    )
    return (
        users.join(answers, ["conv_id", "turn"], "left")
        .join(docs, "conv_id", "left")
        .select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"),
            "context",
            "question",
            "answer",
            F.struct(
                _task_of(F.pmod("conv_id", F.lit(6))).alias("task"),
                (F.pmod("conv_id", F.lit(2)) == 0).alias("is_prefix"),
                F.col("n_chars").cast("string").alias("length"),
            ).alias("metadata"),
        )
    )


SFT_ITEMS_SQL = """
items AS (
  SELECT u.conv_id * 100 + u.turn AS item_id, d.text AS context, u.text AS question, a.text AS answer,
         CASE u.conv_id % 6 WHEN 0 THEN 'Single QA' WHEN 1 THEN 'MultiHop QA' WHEN 2 THEN 'Summarization'
              WHEN 3 THEN 'Code' WHEN 4 THEN 'In-Context Learning' ELSE 'Other' END AS task,
         u.conv_id % 2 = 0 AS is_prefix, CAST(d.n_chars AS VARCHAR) AS length
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN documents d ON d.doc_id = u.conv_id
  WHERE u.role = 'user')"""

def sql_tokens(expression: str) -> str:
    return f"regexp_extract_all({expression}, '{TOKEN_PATTERN}')"


def sql_id(expression: str) -> str:
    return f"CAST('0x' || substr(md5({expression}), 1, 7) AS INTEGER)"


def sql_ids(expression: str) -> str:
    return f"list_transform({sql_tokens(expression)}, lambda tk: {sql_id('tk')})"


SQL_EOS = sql_id(f"'{END_OF_TEXT}'")

SFT_PROMPTS_SQL = SFT_ITEMS_SQL + f""",
cleaned AS (
  SELECT item_id, task, is_prefix, coalesce(try_cast(nullif(length, '') AS INTEGER), 0) AS length,
         replace(coalesce(context, ''), chr(65279), '') AS context,
         replace(coalesce(question, ''), chr(65279), '') AS question,
         replace(coalesce(answer, ''), chr(65279), '') AS answer
  FROM items),
parts AS (
  SELECT *, chr(10) || regexp_replace(context, '[{text.WHITESPACE}]+\\z', '') AS ctx_part,
         chr(10) || regexp_replace(question, '\\A[{text.WHITESPACE}]+', '') AS q_part
  FROM cleaned),
prompt AS (
  SELECT *, CASE WHEN is_prefix THEN q_part || chr(10) || ctx_part ELSE ctx_part || chr(10) || q_part END AS prompt
  FROM parts),
wrapped AS (
  SELECT *, CASE task WHEN 'Summarization' THEN '{text.SUMMARY_LEAD}' || prompt || chr(10) || chr(10) || 'Summary:'
                      WHEN 'Code' THEN '{text.CODE_LEAD}' || prompt ELSE prompt END AS user_text
  FROM prompt),
rendered AS (
  SELECT *, '<|im_start|>user' || chr(10) || user_text || '<|im_end|>' || chr(10) AS user_part,
         CASE WHEN answer <> '' THEN '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10)
              ELSE '' END AS answer_part
  FROM wrapped)"""

SFT_SAMPLES_SQL = SFT_PROMPTS_SQL + f""",
tokenised AS (
  SELECT item_id, task, length, {sql_ids('user_part')} AS user_ids, {sql_ids('answer_part')} AS answer_ids
  FROM rendered),
samples AS (
  SELECT item_id, task, length, len(user_ids) AS user_len,
         user_ids || answer_ids || [{SQL_EOS}] AS input_ids,
         len(user_ids) + len(answer_ids) + 1 AS n
  FROM tokenised)"""


def words(text_column) -> "Column":  # noqa: F821
    """Words of a trimmed text."""
    return F.split(F.trim(text_column), "[ \\t\\n\\r\\f]+")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests in arrival order; tokens are words."""
    docs = text_table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("token_words"))
    n = F.size("token_words")
    return docs.select(
        F.col("doc_id").alias("seq_id"),
        "token_words",
        n.alias("n"),
        F.floor(n * PROMPT_SHARE).cast("int").alias("num_prompt_tokens"),
        (16 + F.pmod("doc_id", F.lit(48))).cast("int").alias("max_tokens"),
    )


REQUESTS_SQL = f"""
requests AS (
  SELECT doc_id AS seq_id, token_words, len(token_words) AS n,
         CAST(floor(len(token_words) * {PROMPT_SHARE}) AS INTEGER) AS num_prompt_tokens,
         CAST(16 + doc_id % 48 AS INTEGER) AS max_tokens
  FROM (SELECT doc_id, regexp_split_to_array(trim(text, ' '), '[ \\t\\n\\r\\f]+') AS token_words FROM documents))"""


def epoch_micros(ts):
    """Microseconds since 1970 of a wall-clock time, in no session's time zone."""
    gap = ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), gap).cast("bigint")
    minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), gap) * 1_000_000).cast("bigint")


def metric_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as metric values of one hour, rank and task.

    Values are in whole hundredths, so that sums do not depend on the order of adding.
    """
    hour = F.floor((epoch_micros(F.col("ts")) - epoch_micros(F.lit(ORIGIN))) / 3_600_000_000)
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        hour.alias("step"),
        F.pmod("user_id", F.lit(8)).cast("int").alias("rank"),
        F.col("event_type").alias("task"),
        F.lit("value").alias("metric"),
        F.round(F.col("value") * 100).alias("value"),
    )


METRIC_ROWS_SQL = f"""
metric_rows AS (
  SELECT event_id, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) // 3600000000 AS step,
         CAST(user_id % 8 AS INTEGER) AS rank, event_type AS task, 'value' AS metric, round(value * 100) AS value
  FROM events)"""


def eval_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evaluation values; every eleventh is not a number."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"),
        F.col("event_id").alias("idx"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string")).alias("metric"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
    )


EVAL_ROWS_SQL = """
eval_rows AS (
  SELECT event_type AS dataset, event_id AS idx, 'm' || CAST(user_id % 3 AS VARCHAR) AS metric,
         CASE WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value
  FROM events)"""


def progress_rows(spark: SparkSession, sf: str) -> DataFrame:
    return progress_columns(table(spark, sf, "events"))


def progress_columns(events: DataFrame) -> DataFrame:
    """Each event type as a run: a time and a token count per row, some rows forced."""
    return events.select(
        F.col("event_type").alias("run"),
        F.col("event_id").alias("step"),
        epoch_micros(F.col("ts")).alias("t"),
        (F.lit(1000) + F.pmod("user_id", F.lit(50))).alias("tokens"),
        (F.pmod("event_id", F.lit(500)) == 0).alias("force"),
    )


PROGRESS_ROWS_SQL = """
progress_rows AS (
  SELECT event_type AS run, event_id AS step, epoch_us(ts) AS t, 1000 + user_id % 50 AS tokens,
         event_id % 500 = 0 AS force
  FROM events)"""


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as samples with an actual and a target share."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("sample_id"),
        F.pmod("doc_id", F.lit(6)).cast("int").alias("task_id"),
        F.col("quality").cast("double").alias("actual"),
        F.col("toxic").cast("double").alias("target"),
    )


GAPS_SQL = """
gaps AS (
  SELECT doc_id AS sample_id, CAST(doc_id % 6 AS INTEGER) AS task_id,
         CAST(quality AS DOUBLE) AS actual, CAST(toxic AS DOUBLE) AS target
  FROM labels)"""

# Fixed values of the views: penalties per class id.
PENALTIES = [(0, 0.1, 0.5), (1, 0.2, 0.4), (2, 0.3, 0.3), (3, 0.4, 0.2), (4, 0.5, 0.1)]
PENALTIES_SQL = "penalties(task_id, lambda1, lambda2) AS (VALUES " + ", ".join(
    f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, a, b in PENALTIES
) + ")"


def penalties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PENALTIES, "task_id int, lambda1 double, lambda2 double")


def mask_values(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as mask values in [0, 1) of a layer and head."""
    return table(spark, sf, "part").select(
        F.col("p_size").alias("layer"),
        F.col("p_partkey").alias("head"),
        ((F.col("p_retailprice") - 900) / 100).alias("value"),
    )


MASK_VALUES_SQL = """
mask_values AS (
  SELECT p_size AS layer, p_partkey AS head, (p_retailprice - 900) / 100 AS value FROM part)"""


def position_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as vectors of sequences of a fixed length, so a sequence never grows with the data."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / SEQ_LEN).alias("seq_id"),
        F.pmod("vec_id", F.lit(SEQ_LEN)).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
    )


POSITION_VECTORS_SQL = f"""
position_vectors AS (
  SELECT vec_id // {SEQ_LEN} AS seq_id, CAST(vec_id % {SEQ_LEN} AS INTEGER) AS pos,
         CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings)"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as weighted items of a group, with a repeatable uniform number."""
    mark = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber"))
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        F.col("l_linenumber").alias("item"),
        F.col("l_quantity").alias("weight"),
        ((F.conv(F.substring(mark, 1, 7), 16, 10).cast("int") + 0.5) / F.lit(float(1 << 28))).alias("u"),
    )


WEIGHTS_SQL = """
weights AS (
  SELECT l_orderkey AS group_id, l_linenumber AS item, l_quantity AS weight,
         (CAST('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 7) AS INTEGER) + 0.5) / 268435456.0 AS u
  FROM lineitem)"""
