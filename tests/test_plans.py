"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from oracle import ROOT
from sparkloom.operators import ordering, packing
from sparkloom.plans import views as v
from sparkloom.plans.item_queries import CONFIG

SF = f"{ROOT}/sf0.01"
QUERIES = entry.queries()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_index_sends_only_counts_to_one_task(spark):
    docs = v.table(spark, SF, "documents").select("doc_id", "n_chars")
    text = plan(ordering.sort_by_length(docs, "n_chars", "doc_id"))
    single = text[text.index("SinglePartition") :]
    assert "keys=[_chunk" in single.split("\n")[1]


def test_packing_reads_no_tokens(spark):
    samples = packing.staged_samples(v.sft_items(spark, SF), CONFIG)
    narrow = plan(samples.select("item_id", "n"))
    assert "input_ids" not in narrow and "labels" not in narrow
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(n,", narrow)


def test_scans_read_only_their_columns(spark):
    text = plan(QUERIES["weighted_pick"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(c.split(":")[0] for c in schema.split(",")) == {"l_orderkey", "l_linenumber", "l_quantity"}


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("weighted_pick", "task_means", "any_gate", "first_seen_prefix"):
        assert "partial_" in plan(QUERIES[name](spark, SF))
    # vectors are added up batch by batch below the exchange
    pooled = plan(QUERIES["mean_pool"](spark, SF))
    assert 0 < pooled.index("FlatMapGroupsInPandas") < pooled.index("Exchange") < pooled.index("MapInPandas")


def test_one_shuffle_for_a_draw(spark):
    assert len(re.findall(r"Exchange hash", plan(QUERIES["weighted_pick"](spark, SF)))) == 1
