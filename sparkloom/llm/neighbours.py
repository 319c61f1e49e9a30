"""Approximate nearest neighbours: stable projections to few dimensions, a k-d tree, and a chi-square stopping test.

Every vector is projected by random Gaussian directions. If the distance of two vectors is d, the squared distance of
their projections, divided by d squared, follows a chi-square law with as many degrees of freedom as there are directions.
So a search that takes projected neighbours in rising distance and verifies them on the original vectors may
stop once the projected distance r fulfils r*r >= d*d * quantile, d being the distance of the k-th best so far: a
better neighbour that lies farther out has a chance of less than ``1 - confidence``.

The largest inner product is made a nearest neighbour: a further component lifts all rows to one norm and is zero for queries.

The k-d tree has two levels. Its upper splits are learned on a bounded sample and give the cells, each of which is a Spark
group (in several parts, if it holds many rows); every row is indexed. A query first searches its own cell, which gives
it a first bound, and then the cells whose boxes the stopping test does not rule out; the lists of both passes are
merged. The lower level orders a part's rows for the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm.common import require
from sparkloom.session import stage


@dataclass(frozen=True)
class Search:
    """``k`` neighbours. ``confidence`` of the stopping test; cells of about ``cell_rows`` rows; splits are learned on
    at most ``sample_rows`` rows."""

    k: int = 20
    directions: int = 16
    confidence: float = 0.98
    cell_rows: int = 4096
    sample_rows: int = 20_000
    seed: int = 9

    def matrix(self, dimension: int) -> np.ndarray:
        return np.random.RandomState(self.seed).standard_normal((dimension, self.directions))

    def quantile(self) -> float:
        """Chi-square quantile of the confidence, by the Wilson-Hilferty approximation."""
        low, high = -10.0, 10.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if 0.5 * (1 + math.erf(middle / math.sqrt(2))) < self.confidence else (low, middle)
        m = self.directions
        return m * (1 - 2 / (9 * m) + low * (2 / (9 * m)) ** 0.5) ** 3


# Share of the squared norms by which distances may be off through rounding; equal rows have distances of no more.
_SLACK = 1e-9


def reach(norm: float, length: float, worst: float, quantile: float) -> float:
    """Squared projected distance up to which rows may still be better than ``worst``.

    The squared distance of lifted rows is the norms, less twice the inner product. ``length``: the query's squared norm.
    """
    norms = norm * norm + length
    return (max(0.0, norms - 2 * worst) + _SLACK * norms) * quantile


def inner(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, the same for equal rows wherever they stand."""
    return (matrix * vector).sum(axis=1)


@dataclass(frozen=True)
class Tree:
    """Upper level of the k-d tree: (dim, bound, left, right) per inner node, leaves as -1 - cell; boxes of the cells."""

    nodes: tuple[tuple[int, float, int, int], ...]
    low: np.ndarray
    high: np.ndarray

    def cells(self, points: np.ndarray) -> np.ndarray:
        """The cell of each projected point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                dim, bound, left, right = self.nodes[node]
                below = points[rows, dim] < bound
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a projected point to the box of every cell."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


def grow(sample: np.ndarray, leaves: int) -> Tree:
    """Median splits along the widest dimension until there are ``leaves`` cells."""
    nodes: list[tuple[int, float, int, int]] = []
    boxes: list[tuple[np.ndarray, np.ndarray]] = []
    width = sample.shape[1]

    def split(rows: np.ndarray, count: int, low: np.ndarray, high: np.ndarray) -> int:
        points = sample[rows]
        spread = points.max(axis=0) - points.min(axis=0) if len(rows) else np.zeros(1)
        if count <= 1 or spread.max() <= 0:
            boxes.append((low, high))
            return -len(boxes)
        dim = int(spread.argmax())
        order = np.sort(points[:, dim])
        bound = float(order[len(order) * (count // 2) // count])
        if bound <= order[0]:
            bound = float(order[order > order[0]][0])
        here = len(nodes)
        nodes.append((dim, bound, 0, 0))
        below = points[:, dim] < bound
        left_high, right_low = high.copy(), low.copy()
        left_high[dim] = right_low[dim] = bound
        left = split(rows[below], count // 2, low, left_high)
        right = split(rows[~below], count - count // 2, right_low, high)
        nodes[here] = (dim, bound, left, right)
        return here

    split(np.arange(len(sample)), leaves, np.full(width, -np.inf), np.full(width, np.inf))
    return Tree(tuple(nodes), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))


def valid_vectors(rows: DataFrame, is_query: Column, id_col: str, vector: str) -> DataFrame:
    """(id, v, q): vectors with components that are all finite and not all zero."""
    doubles = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return doubles.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _lift(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Rows with a component that makes their norms one and the same."""
    missing = np.sqrt(np.maximum(0, norm * norm - (vectors * vectors).sum(axis=1)))
    return np.column_stack([vectors, missing])


class _Part:
    """Rows of one part of a cell, projected."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, matrix: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.points = _lift(vectors, norm) @ matrix
        self.squares = (self.points * self.points).sum(axis=1)

    def nearest(self, query_id: int, query: np.ndarray, point: np.ndarray, worst: float, norm: float, search: Search) -> tuple[np.ndarray, np.ndarray]:
        """Best (ids, scores) of this part. ``worst``: the k-th best score known so far, or -inf.

        Rows are taken in rising projected distance, in growing steps, until the test holds. A step's products are worked
        out at once; only rows that by these may be among the best are scored to the last bit.
        """
        radii = np.maximum(0, self.squares + point @ point - 2 * (self.points @ point))
        length = query @ query
        quantile = search.quantile()
        slack = _SLACK * (norm * norm + length)
        # what the first bound rules out need not be sorted
        within = np.flatnonzero((radii <= reach(norm, length, worst, quantile)) & (self.ids != query_id))
        order = within[np.argsort(radii[within], kind="stable")]
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 4 * search.k
        while at < len(order):
            if radii[order[at]] > reach(norm, length, worst, quantile):
                break
            chosen = order[at : at + step]
            chosen = chosen[self.vectors[chosen] @ query >= worst - slack]
            ids, scores = np.append(best_ids, self.ids[chosen]), np.append(best, inner(self.vectors[chosen], query))
            keep = np.lexsort((ids, -scores))[: search.k]
            best_ids, best = ids[keep], scores[keep]
            if len(best) == search.k:
                worst = max(worst, best[-1])
            at += step
            step *= 2
        return best_ids, best


_FOUND = "query_id long, ids array<long>, scores array<double>"


def _search_parts(search: Search, norm: float, dimension: int):
    """One part's rows and the queries sent to it, to one row per query with its best."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            matrix = search.matrix(dimension + 1)
            part = _Part(rows["id"].to_numpy(np.int64), np.stack(rows["v"].to_numpy()), norm, matrix)
            for query_id, v, worst in zip(queries["query_id"], queries["qv"], queries["worst"]):
                query = np.asarray(v, float)
                ids, scores = part.nearest(query_id, query, np.append(query, 0.0) @ matrix, worst, norm, search)
                out.append((query_id, ids, scores))
        return pd.DataFrame(out, columns=["query_id", "ids", "scores"])

    return run


def _placed(search: Search, norm: float, dimension: int, tree: Tree):
    """Batches of (id, v, q) with the cell of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = search.matrix(dimension + 1)
        for batch in batches:
            if len(batch):
                points = _lift(np.stack(batch["v"].to_numpy()), norm) @ matrix
                yield batch.assign(cell=tree.cells(points))

    return run


def _projected(search: Search, norm: float, dimension: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = search.matrix(dimension + 1)
        for batch in batches:
            if len(batch):
                points = _lift(np.stack(batch["v"].to_numpy()), norm) @ matrix
                yield pd.DataFrame({"p": list(points)})

    return run


def _visits(search: Search, norm: float, dimension: int, tree: Tree, parts: dict[int, int]):
    """Batches of (query_id, qv, worst) to one row per part to be searched.

    A query goes first to one part of its own cell, then to all other parts of the cells within reach.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix = search.matrix(dimension + 1)
        quantile = search.quantile()
        for batch in batches:
            out = []
            for query_id, v, worst, first in zip(batch["query_id"], batch["qv"], batch["worst"], batch["first"]):
                query = np.asarray(v, float)
                point = np.append(query, 0.0) @ matrix
                far = tree.distances(point)
                own = int(far.argmin())
                begun = (own, query_id % parts[own]) if own in parts else None
                if first:
                    out += [(query_id, v, worst, *begun)] if begun else []
                else:
                    near = np.flatnonzero(far <= reach(norm, query @ query, worst, quantile)).tolist()
                    out += [(query_id, v, worst, c, p) for c in near for p in range(parts.get(c, 0)) if (c, p) != begun]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "qv", "worst", "cell", "part"])

    return run


_VISIT = "query_id long, qv array<double>, worst double, cell long, part long"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query's lists: one entry at most per part visited and rank."""
    pairs = F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("far"), i.alias("id")))
    every = found.groupBy("query_id").agg(F.flatten(F.collect_list(pairs)).alias("all"))
    return every.select("query_id", F.slice(F.array_sort("all"), 1, k).alias("best"))


def nearest_neighbours(
    rows: DataFrame, is_query: Column, search: Search = Search(), id_col: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query``, the others with the largest inner product.

    ``score`` is that product, in double precision, on the original vectors; equal ones are ranked by the
    smaller id. Ids are integers; a row never finds one with its own id.

    Defined results: vectors that are null, zero, or hold a null, NaN or infinite component, take no part, neither do rows
    without an id. Vectors of different lengths have no product and are searched apart. Fewer than ``k`` other rows
    of its length give them all.
    Repeated rows are found as often as they stand, and as queries share one result. Other columns are not read.
    An empty table gives no rows. Jobs run when this is called.
    """
    require(rows, id_col, vector)
    good = stage(valid_vectors(rows, is_query, id_col, vector), "vectors")
    square = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    facts = good.groupBy(F.size("v").alias("width")).agg(
        F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("queries"), square.alias("square")
    )
    widths = facts.orderBy("width").collect()  # one row per length
    if not widths:
        return _of_one_length(good, 1, 0, 0, 0.0, search)
    found = [
        _of_one_length(good.filter(F.size("v") == w["width"]), w["width"], w["n"], w["queries"], w["square"] ** 0.5, search)
        for w in widths
    ]
    return reduce(DataFrame.unionByName, found)


def _of_one_length(good: DataFrame, dimension: int, count: int, asked: int, norm: float, search: Search) -> DataFrame:
    """The result among ``count`` vectors of one length, of which ``asked`` are queries and ``norm`` is the largest norm."""
    points = good.mapInPandas(_projected(search, norm, dimension), "p array<double>")
    sample = points.orderBy(F.xxhash64("p")).limit(search.sample_rows).collect()  # a bounded sample
    places = np.array([r["p"] for r in sample]).reshape(-1, search.directions)
    tree = grow(places, max(1, min(-(-count // search.cell_rows), len(places) // 8)))
    schema = "id long, v array<double>, q boolean, cell long"
    indexed = stage(good.mapInPandas(_placed(search, norm, dimension, tree), schema), "indexed")
    held = indexed.groupBy("cell").count().collect()  # one row per cell, no more than the sample has rows
    parts = {r["cell"]: -(-r["count"] // (2 * search.cell_rows)) for r in held}

    # a part's queries are searched in blocks of bounded size
    blocks = max(1, -(-asked // (2 * search.cell_rows)))
    counts = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair]) if parts else F.lit(None)
    targets = indexed.select(
        "id",
        "v",
        "cell",
        F.pmod(F.xxhash64("id"), F.coalesce(F.element_at(counts, F.col("cell")), F.lit(1)) if parts else F.lit(1)).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    # both passes must see the same vector of a repeated id
    queries = indexed.filter("q").groupBy(F.col("id").alias("query_id")).agg(F.min("v").alias("qv"))

    def searched(asked: DataFrame) -> DataFrame:
        visits = asked.mapInPandas(_visits(search, norm, dimension, tree, parts), _VISIT)
        visits = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        key = ["cell", "part", "block"]
        return targets.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(_search_parts(search, norm, dimension), _FOUND)

    # one list per query at most, read for the bounds and for the result
    first = stage(searched(queries.select("*", F.lit(float("-inf")).alias("worst"), F.lit(True).alias("first"))), "first")
    bound = F.when(F.size("scores") == search.k, F.element_at("scores", F.lit(-1))).otherwise(F.lit(float("-inf")))
    bounds = first.select("query_id", bound.alias("worst"))
    again = queries.join(bounds, "query_id", "left").select(
        "query_id", "qv", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"), F.lit(False).alias("first")
    )
    ranked = _merged(first.unionByName(searched(again)), search.k).select("query_id", F.posexplode("best").alias("place", "hit"))
    return ranked.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score")
    )
