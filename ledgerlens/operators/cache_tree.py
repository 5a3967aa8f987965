"""A metric tree beside the answer cache, two levels of pivots inside every scope.

Entries of a scope lie in cells around their nearest pivots, those of a cell in
smaller cells again; pivots are entries picked by hash, about the cube root of a
scope's size on both levels and never the whole cache's. Every cell knows its
radius, so a lookup opens only cells that the triangle inequality cannot rule out
and stays exact. The tree is a set of tables; new entries join the cells they lie
nearest to, without any being built anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ledgerlens.functions.vectors import unit_rows
from ledgerlens.operators.retrieval import BLOCK_ROWS, TABLE_CELLS, _slot, scope_key
from ledgerlens.session import stored

#: Distances are recomputed from doubles in two ways that differ by less.
SLACK = 1e-6
LEVELS = (["scope"], ["scope", "p1"])


@dataclass(frozen=True)
class CacheTree:
    """``entries`` (id, scope, p1, p2, embedding) and, per level, ``nodes``: keys, pivot, embedding, radius, n."""

    entries: DataFrame
    nodes: tuple[DataFrame, DataFrame]


def _pieces(rows: np.ndarray, columns: int):
    """Slices of rows whose tables with so many columns stay within TABLE_CELLS."""
    step = max(1, TABLE_CELLS // max(1, columns))
    return (slice(at, at + step) for at in range(0, len(rows), step))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * a @ b.T))


def _blocks(rows: DataFrame, keys: list[str], key: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows cut into blocks per key, and the blocks of each key."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks"))
    return rows.join(counts, keys).withColumn("block", _slot(key, F.col("blocks"))).drop("blocks"), counts.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def _together(left: DataFrame, right: DataFrame, keys: list[str], buckets: int, work, schema: T.StructType) -> DataFrame:
    """``work`` where rows of both sides share their keys.

    Keys are dealt into buckets, so that many small ones cost one call. ``work``
    takes both frames, their unit vectors and an iterator of row numbers that meet.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=schema.names)
        mine, other = a.groupby(keys, sort=False).indices, b.groupby(keys, sort=False).indices
        met = ((mine[k], other[k]) for k in mine if k in other)
        return work(a, b, unit_rows(a["embedding"]), unit_rows(b["embedding"]), met)

    dealt = [df.withColumn("bucket", bucket).groupBy("bucket") for df in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)


def _meet(rows: DataFrame, nodes: DataFrame, keys: list[str], block_rows: int, work, schema: T.StructType) -> DataFrame:
    """``work`` on every block of rows with all nodes of its keys, which are few: roots of the number of rows."""
    cut, blocks = _blocks(rows, keys, "id", block_rows)
    return _together(cut, nodes.join(blocks, keys), [*keys, "block"], _buckets(rows), work, schema)


def _buckets(df: DataFrame) -> int:
    """As many as there are shuffle partitions, which are chosen for the data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _place(rows: DataFrame, nodes: DataFrame, keys: list[str], block_rows: int, pivot: str, distance: str) -> DataFrame:
    """Rows with the nearest pivot of their keys and the distance to it; rows whose keys have none are left out."""
    schema = T.StructType([*rows.schema, T.StructField(pivot, T.IntegerType()), T.StructField(distance, T.DoubleType())])
    columns = rows.columns

    def nearest(some, pivots, matrix, grid, met):
        place, far = np.full(len(some), -1, np.int32), np.zeros(len(some))
        numbers = pivots["pivot"].to_numpy()
        for mine, other in met:
            other = other[np.argsort(numbers[other])]
            for part in _pieces(mine, len(other)):
                found = _distances(matrix[mine[part]], grid[other])
                place[mine[part]] = numbers[other[found.argmin(axis=1)]]
                far[mine[part]] = found.min(axis=1)
        return some[columns].assign(**{pivot: place, distance: far})[place >= 0]

    return _meet(rows, nodes.select(*keys, "pivot", "embedding"), keys, block_rows, nearest, schema)


def _picked(rows: DataFrame, keys: list[str], power: float, count: int | None = None) -> DataFrame:
    """About n ** power (or ``count``) entries of every key by hash, one at least, numbered: keys, pivot, embedding."""
    draw = F.pmod(F.xxhash64("id", F.lit(len(keys))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.select(*keys, "id", "embedding", draw.alias("draw"))
    sizes = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least"))
    share = F.pow(F.col("n"), F.lit(power - 1)) if count is None else F.lit(float(count)) / F.col("n")
    few = drawn.join(sizes, keys).filter((F.col("draw") <= F.col("least")) | (F.col("draw") < share))
    order = Window.partitionBy(*keys).orderBy("draw", "id")
    return few.withColumn("pivot", F.row_number().over(order) - 1).select(*keys, "pivot", "embedding")


def _rows(cache: DataFrame, cache_id: str, embedding: str) -> DataFrame:
    return cache.filter(F.col(embedding).isNotNull()).select(
        F.col(cache_id).alias("id"), scope_key().alias("scope"), F.col(embedding).alias("embedding"))


def _grown(nodes: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """Nodes whose radius and size take in what has been placed; ``cells`` has keys, pivot, radius, n."""
    new = cells.select(*keys, "pivot", F.col("radius").alias("_r"), F.col("n").alias("_n"))
    joined = nodes.join(new, [*keys, "pivot"], "left")
    return joined.select(
        *keys, "pivot", "embedding", F.greatest("radius", F.coalesce("_r", F.lit(0.0))).alias("radius"),
        (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))


def _cells(placed: DataFrame, level: int) -> DataFrame:
    pivot = f"p{level + 1}"
    return placed.groupBy(*LEVELS[level], F.col(pivot).alias("pivot")).agg(F.max(f"d{level + 1}").alias("radius"), F.count(F.lit(1)).alias("n"))


def build(cache: DataFrame, *, cache_id: str = "id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS,
          pivots: int | None = None) -> CacheTree:
    """Tree of all entries that have an embedding; ``pivots`` asks for so many cells on a scope's first level."""
    rows = stored(_rows(cache, cache_id, embedding), "entries")
    nodes, placed = [], rows
    for level, power in enumerate((1 / 3, 1 / 2)):
        picked = _picked(placed, LEVELS[level], power, None if level else pivots)
        picked = stored(picked.withColumn("radius", F.lit(0.0)).withColumn("n", F.lit(0).cast("long")), "pivots")
        placed = stored(_place(placed, picked, LEVELS[level], block_rows, f"p{level + 1}", f"d{level + 1}"), "placed")
        nodes.append(stored(_grown(picked, LEVELS[level], _cells(placed, level)), "nodes"))
    return CacheTree(placed.select("id", "scope", "p1", "p2", "embedding"), (nodes[0], nodes[1]))


def extend(tree: CacheTree, fresh: DataFrame, *, cache_id: str = "id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> CacheTree:
    """Tree with new entries: placed by the pivots there are; scopes that are new get a tree of their own."""
    scopes = tree.nodes[0].select("scope").distinct()
    rows = stored(_rows(fresh, cache_id, embedding), "entries")
    known, strange = rows.join(scopes, "scope", "left_semi"), fresh.join(
        scopes.withColumnRenamed("scope", "_scope"), scope_key() == F.col("_scope"), "left_anti")
    nodes, placed = [], known
    for level in (0, 1):
        placed = stored(_place(placed, tree.nodes[level], LEVELS[level], block_rows, f"p{level + 1}", f"d{level + 1}"), "placed")
        nodes.append(_grown(tree.nodes[level], LEVELS[level], _cells(placed, level)))
    other = build(strange, cache_id=cache_id, embedding=embedding, block_rows=block_rows)
    entries = tree.entries.unionByName(placed.select("id", "scope", "p1", "p2", "embedding")).unionByName(other.entries)
    grown = [stored(a.unionByName(b), "nodes") for a, b in zip(nodes, other.nodes, strict=True)]
    return CacheTree(stored(entries, "entries"), (grown[0], grown[1]))


def visits(tree: CacheTree, queries: DataFrame, threshold: float, *, query_id: str = "query_id", embedding: str = "embedding",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, scope, p1, p2, embedding): the cells that may hold an entry above the threshold for a query."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    asked = queries.filter(F.col(embedding).isNotNull()).select(
        F.col(query_id).alias("id"), scope_key().alias("scope"), F.col(embedding).alias("embedding"))
    for level in (0, 1):
        schema = T.StructType([*asked.schema, T.StructField(f"p{level + 1}", T.IntegerType())])
        columns, name = asked.columns, f"p{level + 1}"

        def open_(some, pivots, matrix, grid, met, columns=columns, name=name):
            limit, numbers, query, pivot = pivots["radius"].to_numpy() + reach, pivots["pivot"].to_numpy(), [], []
            for mine, other in met:
                for part in _pieces(mine, len(other)):
                    near, cell = np.nonzero(_distances(matrix[mine[part]], grid[other]) <= limit[other])
                    query.append(mine[part][near])
                    pivot.append(numbers[other[cell]])
            at = np.concatenate(query) if query else np.empty(0, np.int64)
            return some[columns].iloc[at].assign(**{name: np.concatenate(pivot).astype("int32") if pivot else np.empty(0, np.int32)})

        nodes = tree.nodes[level].filter("n > 0").select(*LEVELS[level], "pivot", "embedding", "radius")
        asked = _meet(asked, nodes, LEVELS[level], block_rows, open_, schema)
    return asked.withColumnRenamed("id", query_id)


def lookup(queries: DataFrame, tree: CacheTree, threshold: float, *, query_id: str = "query_id", cache_id: str = "cache_id",
           embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, cache_id, similarity): the most similar entry above the threshold, ties to the lowest id. Exact.

    Queries and cells meet by blocks of their scope, where a query is compared with
    the cells that may hold an entry for it; so a vector travels once per block of
    the other side, not once per cell.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    asked = queries.filter(F.col(embedding).isNotNull()).select(
        F.col(query_id), scope_key().alias("scope"), F.col(embedding).alias("embedding"))
    cells, rows = ["scope", "p1", "p2"], F.lit(block_rows)
    nodes = tree.nodes[1].filter("n > 0").withColumnRenamed("pivot", "p2")
    cut = asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_nq")).join(
        nodes.groupBy("scope").agg(F.ceil(F.sum("n") / rows).cast("int").alias("_nv")), "scope")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    # a cell lies in one block of its scope; one of more entries than a block is cut, and its pivot goes with every part
    parts = F.ceil(F.col("n") / rows).cast("int")
    block = F.pmod(F.xxhash64("p1", "p2", "part"), F.col("_nv")).cast("int")
    entries = tree.entries.join(nodes.select(*cells, parts.alias("parts")), cells).withColumn("part", _slot("id", F.col("parts"))).select(
        *cells, "part", F.col("id").alias(cache_id), "embedding", F.lit(None).cast("double").alias("radius"))
    pivots = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        *cells, "part", F.lit(None).cast(entries.schema[cache_id].dataType).alias(cache_id), "embedding", "radius")
    right = entries.unionByName(pivots).join(cut, "scope").withColumn("_vb", block).withColumn("_qb", every("_nq")).drop("_nq", "_nv")
    left = asked.join(cut, "scope").withColumn("_qb", _slot(query_id, F.col("_nq"))).withColumn("_vb", every("_nv")).drop("_nq", "_nv")
    schema = T.StructType([queries.schema[query_id], right.schema[cache_id], T.StructField("similarity", T.DoubleType())])

    def best(some, held, matrix, grid, met):
        radius, ids, rows, found, scores = held["radius"].to_numpy(), held[cache_id].to_numpy(), [], [], []
        leaf = held.groupby(["scope", "p1", "p2", "part", "_vb", "_qb"], sort=False).ngroup().to_numpy()
        for mine, other in met:
            pivot = other[~np.isnan(radius[other])]
            entry = other[np.isnan(radius[other])]
            entry = entry[np.lexsort([ids[entry], leaf[entry]])]  # the first of equal scores has the lowest id
            pivot = pivot[np.argsort(leaf[pivot])]
            low, high = (np.searchsorted(leaf[entry], leaf[pivot], side=s) for s in ("left", "right"))
            for part in _pieces(mine, len(pivot)):
                near = _distances(matrix[mine[part]], grid[pivot]) <= radius[pivot] + reach
                for cell in np.flatnonzero(near.any(axis=0)):
                    into, asks = entry[low[cell]:high[cell]], mine[part][near[:, cell]]
                    for piece in _pieces(asks, len(into)) if len(into) else ():
                        table = matrix[asks[piece]] @ grid[into].T
                        top = table.argmax(axis=1)
                        score = table[np.arange(len(top)), top]
                        keep = score > threshold
                        rows.append(asks[piece][keep])
                        found.append(ids[into[top[keep]]])
                        scores.append(score[keep])
        if not rows:
            return pd.DataFrame(columns=schema.names)
        pairs = pd.DataFrame({"row": np.concatenate(rows), cache_id: np.concatenate(found), "similarity": np.concatenate(scores)})
        pairs = pairs.sort_values(["row", "similarity", cache_id], ascending=[True, False, True]).drop_duplicates("row")
        return pd.DataFrame({query_id: some[query_id].to_numpy()[pairs["row"]], cache_id: pairs[cache_id], "similarity": pairs["similarity"]})

    found = _together(left, right, ["scope", "_qb", "_vb"], _buckets(queries), best, schema)
    return found.groupBy(query_id).agg(
        F.min_by(cache_id, F.struct(-F.col("similarity"), F.col(cache_id))).alias(cache_id), F.max("similarity").alias("similarity"))
