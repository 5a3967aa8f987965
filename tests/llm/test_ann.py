import numpy as np
import pytest

from ledgerlens.llm import ann, queries


def brute(rows, asked, k):
    out = {}
    for qid, q in asked:
        found = sorted((-float(np.dot(np.array(v, float), np.array(q, float))), i) for i, v in rows if i != qid)
        out[qid] = [i for _, i in found[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, leaf int, score double")


def test_full_recall_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 64)
    monkeypatch.setattr(ann, "LEAF_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.2, 3)).round(3).tolist()) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(150)]  # a group of equal vectors: ties go to smaller ids
    table = frame(spark, rows)
    asked = [r for r in rows if r[0] % 20 == 0 or r[0] == 405]
    out = ann.search(table, table.where("vec_id % 20 = 0 or vec_id = 405"), k=10, recall=1.0)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute([(i, np.float32(v)) for i, v in rows], [(i, np.float32(v)) for i, v in asked], 10)
    same = [len(set(got[q]) & set(want[q])) / 10 for q in want]
    assert np.mean(same) >= 0.98
    assert got[405] == want[405]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]),
            (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [float("inf"), 1.0]), (10, [-1.0, 0.0])]
    out = ann.search(frame(spark, rows), frame(spark, rows), k=20).collect()
    assert {r["query_id"] for r in out} == {1, 2, 10}
    assert [(r["vec_id"], r["rank"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 1] == [(2, 1), (2, 2), (10, 3)]
    assert ann.search(frame(spark, []), frame(spark, [])).count() == 0
    assert ann.search(frame(spark, rows), frame(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    root = f"/root/testdata/{sf}"
    rows = [(r[0], np.array(r[1], float)) for r in spark.read.parquet(f"{root}/embeddings.parquet").select("vec_id", "embedding").collect()]
    asked = [r for r in rows if r[0] % 20 == 0]
    out = queries.op3_nearest_neighbours(spark, root).collect()
    got = {(r["query_id"], r["vec_id"]) for r in out}
    want = {(q, i) for q, ids in brute(rows, asked, 20).items() for i in ids}
    assert len(got & want) >= 0.9 * len(want)
    vectors = dict(rows)
    assert all(abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-12 for r in out)


def test_outlying_queries_get_k_rows(spark):
    rng = np.random.default_rng(4)
    crowd = np.append(np.full(7, 1.0), 0.0)
    rows = [(i, (crowd + rng.normal(size=8) * 0.01).tolist()) for i in range(900)]
    rows += [(1000 + i, (-10 * np.eye(8)[i % 4] + rng.normal(size=8) * 0.01).tolist()) for i in range(12)]
    rows += [(1000, rows[900][1])] * 3  # rows with a query's own id are no candidates
    table = frame(spark, rows)
    out = ann.search(table, table.where("vec_id < 400 or vec_id >= 1000"), k=20, recall=0.5)
    counts = {r["query_id"]: r["count"] for r in out.groupBy("query_id").count().collect()}
    assert set(counts) == {i for i, _ in rows if i < 400 or i >= 1000} and set(counts.values()) == {20}
