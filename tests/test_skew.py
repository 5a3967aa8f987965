"""Bucketed computations equal the plain ones, also with one key holding most rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.skew import clamped_totals, ranked
from ledgerlens.operators.ordering import admit_uploads, dedupe_names, trim_history
from ledgerlens.streaming.stateful import Gate, admission, sessionise


def test_ranked_equals_row_number(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), "id")
    got = ranked(df, ["k"], [F.col("id")], F.floor(F.col("id") / 100))
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert got.select("k", "id", F.col("rank").cast("int")).exceptAll(plain.select("k", "id", "rank")).count() == 0


def test_ranked_accepts_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, id int")
    got = {(r.k, r.id): r["rank"] for r in ranked(df, ["k"], [F.col("id")], F.col("id")).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1}


def test_clamped_totals_equal_the_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"s{i % 7}", i, rng.randint(-9, 7)) for i in range(2000)]
    want = {}
    for store, _, delta in rows:
        want[store] = max(0, want.get(store, 4) + delta)
    df = spark.createDataFrame(rows, "store string, seq int, delta int")
    got = clamped_totals(df, ["store"], [F.col("seq")], F.floor(F.col("seq") / 100), F.lit(4), "delta")
    assert {r.store: r.value for r in got.collect()} == want


def test_admission_equals_the_loop(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 2, 3, 5, 70]) if i % 40 == 0 else rng.choice([0, 1, 4, 9])
        rows.append((rng.choice(["hot", "hot", "b", "c"]), i, at))
    gates, want = {}, {}
    for session, key, t in rows:
        gate = gates.setdefault(session, Gate(10, 60_000_000))
        want[key] = gate.call(t * 1_000_000)
    df = spark.createDataFrame(rows, "session string, key int, t int").withColumn("at", F.timestamp_seconds("t"))
    got = {r.key: (r.admitted, r.retry_after, r.remaining) for r in admission(df, "session", "at", "key").collect()}
    assert got == want
    assert not all(a for a, _, _ in want.values())


def test_admission_golden(spark):
    times = [0] * 11 + [59, 60, 61]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(times)] + [("other", 99, 5)], "session string, key int, t int").withColumn("at", F.timestamp_seconds("t"))
    got = {r.key: r for r in admission(df, "session", "at", "key").collect()}
    assert [got[i].admitted for i in range(14)] == [True] * 10 + [False, False, True, True]
    assert got[10].retry_after == 60 and got[11].retry_after == 1 and got[99].admitted


def test_gap_of_exactly_thirty_minutes_starts_a_session(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 1799, 1799 + 1800, 1799 + 1800 + 1799)], "u string, t int").withColumn("ts", F.timestamp_seconds("t"))
    rows = sessionise(df, "u", "ts").orderBy("session_start").collect()
    assert [r.query_count for r in rows] == [2, 2]


def test_names_equal_the_upload_loop(spark):
    import os

    rng = random.Random(11)
    names = ["a.csv", "a_1.csv", "a_1_1.csv", "b.tar.gz", "b.tar_1.gz", ".hidden", "noext", "c.txt"]
    rows = [(f"d{rng.randint(0, 1)}", rng.choice(names), i) for i in range(400)]
    taken, want = set(), {}
    for folder, name, i in rows:
        base, ext = os.path.splitext(name)
        given, n = name, 1
        while (folder, given) in taken:
            given, n = f"{base}_{n}{ext}", n + 1
        taken.add((folder, given))
        want[i] = given
    df = spark.createDataFrame(rows, "folder string, name string, i int")
    got = dedupe_names(df, "folder", "name", [F.col("i")], F.floor(F.col("i") / 50))
    assert {r.i: r.stored_name for r in got.collect()} == want


def test_upload_cap_equals_the_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "cold"]), f"f{rng.randint(0, 30)}", i) for i in range(300)]
    known, want = {}, {}
    for folder, file, i in rows:
        files = known.setdefault(folder, set())
        if file in files:
            want[i] = "exists"
        elif len(files) >= 10:
            want[i] = "limit_exceeded"
        else:
            files.add(file)
            want[i] = "added"
    df = spark.createDataFrame(rows, "folder string, file string, i int")
    got = admit_uploads(df, ["folder"], "file", "i", "i")
    assert {r.i: r.action for r in got.collect()} == want


def test_history_keeps_leading_system_message(spark):
    rows = [("s", i, "system" if i == 0 else "user") for i in range(30)] + [("p", i, "user") for i in range(30)] + [("q", 0, "system")]
    kept = trim_history(spark.createDataFrame(rows, "s string, turn int, role string"), "s", "turn").collect()
    by = {}
    for r in kept:
        by.setdefault(r.s, []).append(r.turn)
    assert sorted(by["s"]) == [0, *range(11, 30)] and sorted(by["p"]) == list(range(10, 30)) and by["q"] == [0]
