import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import cache_tree as C, retrieval as R
from test_search import clustered


def brute(stored, asked, threshold):
    def unit(v):
        v = np.asarray(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    rows = [(i, (o, fo, fi), unit(v)) for i, o, fo, fi, v in stored]
    out = {}
    for q, o, fo, fi, v in asked:
        near = [(-(unit(v) @ w), i) for i, scope, w in rows if scope == (o, fo, fi) and unit(v) @ w > threshold]
        out[q] = min(near)[1] if near else None
    return out


def test_tree_is_exact_and_leaves_cells_out(spark):
    stored, cache = clustered(spark, 900, 16, 3, False)
    asked, queries = clustered(spark, 80, 16, 3, False)
    queries = queries.withColumnRenamed("id", "query_id")
    for rows in (50, 8192):
        tree = C.build(cache, block_rows=rows)
        got = {r.query_id: r.cache_id for r in R.cache_lookup(queries, cache, 0.9, tree=tree, block_rows=rows).collect()}
        assert got == brute(stored, asked, 0.9)
    visits = C.visits(tree, queries, 0.9).groupBy("query_id").count().agg(F.sum("count")).first()[0]
    cells = tree.nodes[1].filter("n > 0").groupBy("scope").count().withColumnRenamed("count", "cells")
    every = queries.select(R.scope_key().alias("scope")).join(cells, "scope").agg(F.sum("cells")).first()[0]
    assert visits < 0.75 * every  # a third of the cells is about the query's own cluster
    assert tree.entries.count() == 900 and tree.nodes[0].agg(F.sum("n")).first()[0] == 900 == tree.nodes[1].agg(F.sum("n")).first()[0]
    # pivots go by the scope's own size
    assert tree.nodes[0].groupBy("scope").count().agg(F.max("count")).first()[0] <= 40


def test_extended_tree_finds_new_entries(spark):
    stored, cache = clustered(spark, 600, 8, 4, False)
    asked, queries = clustered(spark, 60, 8, 4, False)
    queries = queries.withColumnRenamed("id", "query_id")
    first = cache.filter("id < 250 and org_id <> 'o3'")
    tree = C.extend(C.build(first), cache.filter("id >= 250 or org_id = 'o3'"))
    got = {r.query_id: r.cache_id for r in R.cache_lookup(queries, cache, 0.92, tree=tree).collect()}
    assert got == brute(stored, asked, 0.92) and any(got.values())
    assert tree.entries.count() == 600 and tree.nodes[1].agg(F.sum("n")).first()[0] == 600


def test_rows_without_an_embedding(spark):
    shape = "id long, org_id string, folder_filter string, file_filter string, embedding array<float>"
    cache = spark.createDataFrame([(1, "o", None, None, None), (2, "o", None, None, [1.0, 0.0]), (3, "o", None, None, [1.0, 0.0])], shape)
    asked = spark.createDataFrame([(1, "o", None, None, None), (2, "o", None, None, [1.0, 0.1]), (3, "p", None, None, [1.0, 0.0])], shape).withColumnRenamed("id", "query_id")
    got = {r.query_id: (r.hit, r.cache_id) for r in R.cache_lookup(asked, cache).collect()}
    assert got == {1: (False, None), 2: (True, 2), 3: (False, None)}


def test_vectors_travel_once_per_block(spark, monkeypatch):
    stored, cache = clustered(spark, 400, 8, 4, False)
    asked, queries = clustered(spark, 60, 8, 4, False)
    queries = queries.withColumnRenamed("id", "query_id")
    tree, real, sent = C.build(cache), C._together, []

    def seen(left, right, *args):
        sent.append((left.count(), right.count()))
        return real(left, right, *args)

    monkeypatch.setattr(C, "_together", seen)
    # nothing is ruled out at so low a threshold
    got = {r.query_id: r.cache_id for r in R.cache_lookup(queries, cache, 0.01, tree=tree).collect()}
    assert got == brute(stored, asked, 0.01)
    pivots = tree.nodes[1].filter("n > 0").count()
    assert all(left <= 60 and right <= 400 + pivots for left, right in sent)
    for rows in (1, 7):  # cells larger than a block are cut
        got = {r.query_id: r.cache_id for r in R.cache_lookup(queries, cache, 0.8, tree=tree, block_rows=rows).collect()}
        assert got == brute(stored, asked, 0.8)
