"""Approximate nearest neighbours by inner product on a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector goes to the leaf it descends
to. A query opens leaves best bin first, through a priority queue of tree nodes.
How many it opens is widened until calibration queries reach the wanted recall.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import stored

SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
BRANCHES, LEAF_ROWS = 8, 64
CALIBRATION = 128
CELL = 4096


@dataclass
class Tree:
    """Nodes with centres; ``children`` of a leaf is empty, ``leaf`` of an inner node is -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())


def _cluster(rows: np.ndarray, count: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = rows[rng.choice(len(rows), count, replace=False)]
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
        for j in range(count):
            if (near == j).any():
                centres[j] = rows[near == j].mean(axis=0)
    return np.argmax(rows @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)


def fit_tree(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Split by k-means until a node has ``leaf_rows`` sample rows or only equal ones."""
    rng = np.random.default_rng(11)
    centres, children, leaf, queue, leaves = [sample.mean(axis=0)], [[]], [-1], [(0, sample)], 0
    while queue:
        node, rows = queue.pop()
        parts = []
        if len(rows) > leaf_rows and np.ptp(rows, axis=0).any():
            near = _cluster(rows, min(branches, len(rows)), rng)
            parts = [rows[near == j] for j in range(near.max() + 1) if (near == j).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for part in parts:
            children[node].append(len(centres))
            queue.append((len(centres), part))
            centres.append(part.mean(axis=0))
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf))


def descend(tree: Tree, rows: np.ndarray) -> np.ndarray:
    """The leaf each row goes to: the nearest child's, level by level."""
    out = np.zeros(len(rows), np.int32)
    queue = [(0, np.arange(len(rows)))]
    while queue:
        node, which = queue.pop()
        kids = tree.children[node]
        if not kids:
            out[which] = tree.leaf[node]
            continue
        c = tree.centres[kids]
        near = np.argmax(rows[which] @ c.T - (c ** 2).sum(axis=1) / 2, axis=1)
        for j, kid in enumerate(kids):
            if (near == j).any():
                queue.append((kid, which[near == j]))
    return out


def best_bins(tree: Tree, query: np.ndarray, visits: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
    """The first ``visits`` leaves: always the open node whose centre has the largest inner product.

    With ``held``, the rows of each leaf, it goes on until the leaves have ``need`` rows together.
    """
    products = tree.centres @ query
    heap, out, rows = [(-products[0], 0)], [], 0
    while heap and (len(out) < visits or (held is not None and rows < need)):
        _, node = heapq.heappop(heap)
        if tree.leaf[node] >= 0:
            out.append(int(tree.leaf[node]))
            rows += 0 if held is None else held[tree.leaf[node]]
        for kid in tree.children[node]:
            heapq.heappush(heap, (-products[kid], kid))
    return out


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's k largest exact inner products, its own id left out; ties to smaller ids."""
    found = ([], [], [])
    if not len(rows):
        return tuple(np.empty(0, t) for t in (int, int, float))
    size = np.sqrt((rows ** 2).sum(axis=1).max())
    for at in range(0, len(queries), 256):
        part = queries[at:at + 256]
        rough = part @ rows.T
        rough[query_ids[at:at + 256, None] == ids[None, :]] = -np.inf
        for i, line in enumerate(rough):
            usable = np.count_nonzero(line > -np.inf)
            if not usable:
                continue
            cut = np.partition(line, len(line) - min(k, usable))[len(line) - min(k, usable)]
            # products differ in their last bits with the matrix shape: settle order on sums in one fixed way
            near = np.flatnonzero(line >= cut - 1e-12 * size * np.sqrt(part[i] @ part[i]) * rows.shape[1])
            exact = np.einsum("ij,j->i", rows[near], part[i], optimize=False)
            best = np.lexsort((ids[near], -exact))[:k]
            found[0].append(np.full(len(best), at + i))
            found[1].append(near[best])
            found[2].append(exact[best])
    return tuple(np.concatenate(f) if f else np.empty(0, t) for f, t in zip(found, (int, int, float), strict=True))


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles: of the most frequent length, not zero, all components finite; null ids are out."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (length[0]["n"] if length else 0))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(float)


def with_leaf(rows: DataFrame, tree: Tree) -> DataFrame:
    """Add the leaf of every vector; the tree is bounded by its sample."""
    held = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = descend(held.value, _matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["vec_id", "v", "leaf"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, leaf int")


def exact_top(rows: DataFrame, queries: list, k: int, extra: str = "vec_id") -> DataFrame:
    """Brute force: the k best rows of a few given (vec_id, v) queries; one pass, one matrix product per batch."""
    ids, vectors = np.array([q[0] for q in queries]), np.array([q[1] for q in queries], float)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = batch.column("vec_id").to_numpy()
                q, r, s = top(vectors, ids, _matrix(batch.column("v")), own, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.array(own[r]), pa.array(batch.column("x").to_numpy()[r].astype(np.int64)), pa.array(s)],
                    ["query_id", "vec_id", "x", "score"])

    found = rows.select("vec_id", "v", F.col(extra).cast("long").alias("x")).mapInArrow(
        run, "query_id long, vec_id long, x long, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Fewest leaf visits with which a sample of queries finds ``recall`` of its exact k nearest."""
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(CALIBRATION).collect()
    if not sample:
        return 1
    truth: dict[int, list[int]] = {}
    for r in exact_top(rows, sample, k, "leaf").select("query_id", "x").collect():
        truth.setdefault(r[0], []).append(r[1])
    needed = []
    for query_id, vector in sample:
        turn = {leaf: i + 1 for i, leaf in enumerate(best_bins(tree, np.array(vector), tree.leaves))}
        needed += [turn[leaf] for leaf in truth.get(query_id, ())]
    needed = np.sort(needed)
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1


def search(table: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first, ties to the smaller vec_id.

    ``table`` and ``queries`` have vec_id and embedding; a query's own id is no
    candidate. Vectors that are null, zero, hold null or non-finite components or
    have another length than most take no part. Rows that share an id are
    candidates of their own; of queries that share an id the greatest vector
    counts. A query gets k rows, or all candidates if there are fewer: it opens
    leaves beyond the calibrated number until they hold enough. Empty tables give no rows. Bounds: the tree is fitted on
    ``sample_rows`` rows or SAMPLE_VALUES values, recall on CALIBRATION queries.
    """
    rows = usable(table)
    first = rows.select(F.size("v")).limit(1).collect()
    if not first:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(1, min(sample_rows, SAMPLE_VALUES // first[0][0]))
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()
    tree = fit_tree(np.array([r[0] for r in picked], float))
    rows = stored(with_leaf(rows, tree), "leaves")
    asked = usable(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    asked = stored(asked.join(rows.limit(1).select(F.size("v").alias("n")), F.size("v") == F.col("n")).drop("n"), "queries")
    visits = calibrate(rows, asked, tree, k, recall)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # at most as many leaves as sample rows
        sizes[r[0]] = r[1]
    held = rows.sparkSession.sparkContext.broadcast((tree, sizes))

    @F.pandas_udf("array<int>")
    def opened(v: pd.Series, own: pd.Series) -> pd.Series:
        tree, sizes = held.value
        return pd.Series([best_bins(tree, np.asarray(x), visits, sizes, k + n) for x, n in zip(v, own, strict=True)])

    # rows with a query's own id are no candidates, so as many more are opened
    own = rows.join(asked.select("vec_id"), "vec_id").groupBy("vec_id").agg(F.count("*").alias("own"))
    routed = asked.join(own, "vec_id", "left").select("vec_id", "v", F.explode(opened("v", F.coalesce("own", F.lit(0)))).alias("leaf"))
    routed = stored(routed, "routes")
    # both sides of a leaf are cut by hash, so that a cell stays small; there are at most as many leaves as sample rows
    splits = rows.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("nv")).join(
        routed.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias("nq")), "leaf")
    splits = stored(splits, "splits")
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(splits, "leaf").select("leaf", own("nq").alias("i"), every("nv").alias("j"), "vec_id", "v")
    right = rows.join(splits, "leaf").select("leaf", every("nq").alias("i"), own("nv").alias("j"), "vec_id", "v")

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        qi, ri = q["vec_id"].to_numpy(), r["vec_id"].to_numpy()
        a, b, s = top(np.stack(q["v"]), qi, np.stack(r["v"]), ri, k)
        return pd.DataFrame({"query_id": qi[a], "vec_id": ri[b], "score": s})

    found = left.groupBy("leaf", "i", "j").cogroup(right.groupBy("leaf", "i", "j")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
