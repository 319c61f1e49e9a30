"""Shards by k-d tree partitioning: weighted medians along the widest metadata dimension.

Equal texts are one *group*: a point with the metadata of its smallest id and the bytes of all its
rows. The points are split recursively at the weighted median of the dimension in which they
spread widest, measured against the whole table, until a leaf holds its share of the bytes. A group is
never split unless it alone outweighs half a shard; then its rows are dealt to parts by a hash of the id.

Medians are found on the whole table by narrowing histograms: bins of a node's range are summed, the bin that
holds the median becomes the range, and after a few passes over the narrow points it is one point.
All nodes of a level share each pass, and meet their points as a small table. Everything is DataFrame code.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkloom.llm.common import require
from sparkloom.operators.lookups import lookup_join
from sparkloom.operators.ordering import running
from sparkloom.session import cut, stage

_BITS = 62
_BIN_BITS = 14


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _with_label_places(points: DataFrame, labels: list[str]) -> DataFrame:
    """``points`` with labels replaced by their numbers in code-point order, from 1; 0 for null."""
    for name in labels:
        known = points.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("points"))
        numbered = running(known, [], [name], number=("count", "points")).select(name, "number")
        points = lookup_join(points, numbered, name).withColumn(name, F.coalesce("number", F.lit(0)).cast("double")).drop("number")
    return points


def _node_table(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A row per node, to be broadcast: there are no more nodes than shards."""
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return F.broadcast(spark.range(1).select(F.inline(listed)))


def _coordinates(points: DataFrame, dims: list[str]) -> DataFrame:
    """A long key per dimension: the place in the table's range, then a hash, so that keys are unique."""
    ranges = points.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()
    keys = []
    for d in dims:
        lo, hi = ranges[f"lo_{d}"], ranges[f"hi_{d}"]
        width = (hi - lo) if lo is not None and hi > lo else 1.0
        place = F.floor((F.col(d) - F.lit(lo if lo is not None else 0.0)) / F.lit(width) * F.lit(float((1 << 30) - 1)))
        keys.append((F.shiftleft(place.cast("long"), 32) + F.col("tie")).alias(f"key_{d}"))
    return points.select("grp", "part", "parts", "weight", F.lit(0).cast("long").alias("node"), *keys)


def _widest(nodes: DataFrame, dims: list[str]) -> dict[int, tuple[str, int]]:
    """(dimension, weight) per open node; ties go to the first dimension."""
    spread = [(F.max(f"key_{d}") - F.min(f"key_{d}")).alias(d) for d in dims]
    rows = nodes.groupBy("node").agg(*spread, F.sum("weight").alias("weight")).collect()  # one row per open node
    return {r["node"]: (max(dims, key=lambda d: (r[d] >> 32, -dims.index(d))), r["weight"]) for r in rows}


def _medians(nodes: DataFrame, dims: list[str], wanted: dict[int, tuple[str, float]]) -> dict[int, int]:
    """Per node, the key bound that splits off nearest to the wanted weight on the left."""
    state = {node: (dim, weight, 0, _BITS + 1, 0) for node, (dim, weight) in wanted.items()}
    bounds: dict[int, int] = {}
    while state:
        ranges = [
            {
                "node": node,
                "dim": dims.index(dim),
                "shift": max(0, bits - _BIN_BITS),
                "low": base,
                "high": base + (1 << bits) - 1,
                "want": float(weight - before),
            }
            for node, (dim, weight, base, bits, before) in state.items()
        ]
        asked = _node_table(nodes.sparkSession, ranges, "node long, dim int, shift int, low long, high long, want double")
        inside = nodes.join(asked, "node").withColumn("key", _key(dims)).filter(F.col("key").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("node", "want", F.expr("shiftright(key - low, shift)").alias("bin")).agg(F.sum("weight").alias("w"))
        upto = Window.partitionBy("node").orderBy("bin")
        summed = bins.select("node", "want", "bin", "w", F.sum("w").over(upto).alias("upto"))
        crossing = summed.groupBy("node").agg(
            F.min_by(F.struct("bin", "w", "upto"), F.when(F.col("upto") >= F.col("want"), F.col("bin"))).alias("at"),
            F.max_by(F.struct("bin", "w", "upto"), "bin").alias("last"),
        )
        for row in crossing.collect():  # one row per open node
            node = row["node"]
            dim, weight, base, bits, before = state.pop(node)
            hit = row["at"] or row["last"]
            step = max(0, bits - _BIN_BITS)
            start = base + (hit["bin"] << step)
            before_bin = before + hit["upto"] - hit["w"]
            if step == 0:
                # one point: it goes to the side that comes nearer
                after = before_bin + hit["w"]
                bounds[node] = start if weight - before_bin <= after - weight else start + 1
            else:
                state[node] = (dim, weight, start, step, before_bin)
    return bounds


def _key(dims: list[str]) -> Column:
    """The key of a point in the dimension with the number ``dim``."""
    return F.get(F.array(*[F.col(f"key_{d}") for d in dims]), F.col("dim"))


def kd_leaves(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``points`` with their ``shard``: split into as many leaves of equal weight as there are shards.

    ``points`` have a weight, a key per dimension and the node 0. All nodes of a level are split at once, each at the
    weighted median of its own widest dimension; what the driver holds is a row per node.
    """
    spark = points.sparkSession
    leaves = {0: (0, shards)}  # node -> (first shard, shards under it)
    current = points
    while open_nodes := {n: x for n, x in leaves.items() if x[1] > 1}:
        table = _node_table(spark, [{"node": n} for n in open_nodes], "node long")
        live = current.join(table, "node", "left_semi")
        shape = _widest(live, dims)
        wanted = {n: (shape[n][0], shape[n][1] * (x[1] // 2) / x[1]) for n, x in open_nodes.items() if n in shape}
        bounds = _medians(live, dims, wanted)
        for n, (first, count) in open_nodes.items():
            del leaves[n]
            leaves[2 * n + 1], leaves[2 * n + 2] = (first, count // 2), (first + count // 2, count - count // 2)
        splits = [{"node": n, "dim": dims.index(wanted[n][0]), "bound": bound} for n, bound in bounds.items()]
        moved = current.join(_node_table(spark, splits, "node long, dim int, bound long"), "node", "left")
        child = 2 * F.col("node") + F.when(_key(dims) < F.col("bound"), 1).otherwise(2)
        current = cut(moved.withColumn("node", F.when(F.col("bound").isNull(), F.col("node")).otherwise(child)).drop("dim", "bound"))
    ends = [{"node": n, "shard": first} for n, (first, _) in leaves.items()]
    return current.join(_node_table(spark, ends, "node long, shard int"), "node").drop("node")


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    labels: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``.

    Give the number of shards, or the bytes that a leaf should reach. The dimensions are the columns
    ``labels``, by the order of their values, the size of the text and the id. Slots count the rows of a shard from 0, in id
    order. Equal texts share a shard unless together they outweigh half a shard; then they are dealt to parts by id.

    Defined results: a null text has size 1 and is one group with the empty text; a null label or id comes first;
    rows that repeat an id, or are wholly equal, are rows of their own. Other columns are not
    read. An empty table gives no rows. With fewer groups than shards some shards stay empty.
    """
    require(docs, id_col, text, *labels)
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("id"),
            text_size(F.col(text)).alias("size"),
            F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
            F.xxhash64(whole).alias("grp"),
            *[F.col(c).cast("string").alias(f"label_{k}") for k, c in enumerate(labels)],
        ),
        "sizes",
    )
    dims = [f"label_{k}" for k in range(len(labels))] + ["bytes", "place"]
    total = rows.agg(F.sum("size")).first()[0] or 0
    count = shards if shards is not None else max(1, -(-total // target_bytes))
    most = max(1, total // count)
    first_row = F.struct("id", *dims[:-2])
    groups = rows.groupBy("grp").agg(F.sum("size").alias("weight"), F.max("size").alias("one"), F.min(first_row).alias("first"))
    parts = F.when(F.col("weight") * 2 > most, F.ceil(F.col("weight") * 8 / most)).otherwise(1).cast("int")
    points = (
        groups.withColumn("parts", parts)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "grp",
            "part",
            "parts",
            (F.col("weight") / F.col("parts")).alias("weight"),
            *[F.col(f"first.{d}").alias(d) for d in dims[:-2]],
            F.log2("one").alias("bytes"),
            F.coalesce(F.col("first.id").cast("double"), F.lit(0.0)).alias("place"),
            F.pmod(F.xxhash64("grp", "part"), F.lit(1 << 32)).alias("tie"),
        )
    )
    placed = cut(_with_label_places(cut(points), dims[:-2]))
    keyed = cut(_coordinates(placed, dims))
    leaves = kd_leaves(keyed, dims, count).select("grp", "part", "parts", "shard")
    return _number(_assign(rows, leaves), id_col)


def _assign(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """The shard of each row. Groups in one part are joined by group, the few heavy ones by group and part."""
    heavy = leaves.filter("parts > 1")
    # expanded tables look small to the planner, and must not be broadcast
    light = leaves.filter("parts = 1").select("grp", F.col("shard").alias("light_shard")).hint("merge")
    counts = heavy.select("grp", "parts").distinct()
    met = rows.join(light, "grp", "left")
    rest = met.filter("light_shard IS NULL").drop("light_shard").join(counts, "grp")
    dealt = rest.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    parted = dealt.join(heavy.select("grp", "part", "shard"), ["grp", "part"])
    columns = ["id", "size", "text_crc32", "grp", "shard"]
    whole = met.filter("light_shard IS NOT NULL").withColumnRenamed("light_shard", "shard")
    return whole.select(*columns).unionByName(parted.select(*columns))


def _number(assigned: DataFrame, id_col: str) -> DataFrame:
    numbered = running(assigned, ["shard"], ["id", "grp", "size"], nth=("count", "size"))
    return numbered.select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("nth") - 1).cast("long").alias("slot")
    )
