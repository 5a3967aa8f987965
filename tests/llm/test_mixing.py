import random

import pytest
from ledgerlens.llm import mixing
from pyspark.sql import functions as F


def brute_targets(sizes, weights, epochs, total=None):
    total, capped = sum(sizes.values()) if total is None else total, set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and rest * weights[s] > epochs * sizes[s] * share}
        if not above:
            return {s: float(epochs * sizes[s]) if s in capped else rest * weights[s] / share for s in sizes}
        capped |= above


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": int(10 ** rng.uniform(0, 6)) for i in range(40)} | {"": 5, "zero": 0}
    weights = {s: rng.randint(1, 3) for s in sizes}
    got = mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long"),
        spark.createDataFrame(list(weights.items()), "source string, weight long")).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(brute_targets(sizes, weights, 3))
    assert sum(r["target"] for r in got) == pytest.approx(sum(sizes.values()))


def test_total_and_missing_weights(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), (None, 10)], "source string, source_size long")
    weights = spark.createDataFrame([("a", 1), (None, 3)], "source string, weight long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, weights, 2, total=1000).collect()}
    assert got == {"a": 20.0, "b": 0.0, None: 20.0}
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, weights, 2, total=8).collect()}
    assert got == {"a": 2.0, "b": 0.0, None: 6.0}


def test_weights_by_code_point(spark):
    names = ["b", "a", "Z", "é", None, "", "\U0001f600"]
    rows = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = {r["source"]: r["weight"] for r in mixing.cycled_weights(rows, (1, 2, 3)).collect()}
    assert got == {"": 1, "Z": 2, "a": 3, "b": 1, "é": 2, "\U0001f600": 3, None: 1}


def test_mix_of_odd_documents(spark, docs_of, odd_rows):
    rows = [*odd_rows, *[(100 + i, "word " * (1 + i % 50)) for i in range(3000)]]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") >= 100, F.concat(F.lit("s"), F.floor(F.sqrt(F.col("doc_id") - 99) / 6))))
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect()), key=repr)
    assert all(0 <= r["repeats"] <= 3 for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
        assert {r["repeats"] for r in mine} in [{n} for n in range(4)] + [{n, n + 1} for n in range(3)]
        if source:
            # the last document closes the gap as well as any can
            assert abs(sum(r["size"] * r["repeats"] for r in mine) - mine[0]["target"]) <= 1
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_documents(docs_of([])).collect() == []


def test_repeated(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "doc_id long, repeats long")
    assert sorted(r["doc_id"] for r in mixing.repeated(rows).collect()) == [2, 3, 3, 3]
