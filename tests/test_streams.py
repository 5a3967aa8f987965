import datetime as dt
import os
import time

from pyspark.sql import functions as F

from ledgerlens.operators.ordering import admit_uploads
from ledgerlens.plans.streams import calls, notices
from ledgerlens.streaming import ingest as I, stateful as Z


def feed(df, root, pieces, order):
    """Write ``df`` as files that arrive one after the other along ``order``."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        part = df.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1)
        part.write.mode("append").parquet(root)
        for name in os.listdir(root):
            path = os.path.join(root, name)
            if os.stat(path).st_mtime > 1_600_000_000 + 100:
                os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(root)


SCHEMA = ("event_type string, org_id string, request_id string, feature string, provider string, model string, input_tokens long, "
          "output_tokens long, cached_tokens long, resource_type string, amount long, created_at timestamp_ntz")


def usage(request, minute, kind="token", tokens=10):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    return (kind, "o", request, None, None, "gpt-4o", tokens, 0, 0, "llamaparse_pages", 1, at)


def test_usage_first_write_wins_and_late_rows_are_kept(spark, tmp_path):
    rows = [usage("a", 300, tokens=1), usage("a", 301, tokens=2), usage("b", 302), usage("a", 303, tokens=3),
            usage(None, 304), usage(None, 304), usage("r", 305, "resource"), usage("old", 5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("seq", F.monotonically_increasing_id())
    root = str(tmp_path / "in")
    # arrival order differs from event time only for the last, late, row
    order = F.when(F.col("request_id") == "old", 1).otherwise(0), "created_at"
    ordered = df.orderBy(*order).drop("seq").collect()
    for i, part in enumerate([ordered[:3], ordered[3:7], ordered[7:]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(root)
        time.sleep(1.1)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(root)
    I.ingest_usage(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    tokens = I.read_batches(spark, str(tmp_path / "out/token_usage")).collect()
    assert sorted((r.request_id or "-", r.total_tokens) for r in tokens) == [("-", 10), ("-", 10), ("a", 1), ("b", 10)]
    assert {r.feature for r in tokens} == {"unknown"}
    assert I.read_batches(spark, str(tmp_path / "out/resource_usage")).count() == 1
    assert [r.request_id for r in I.read_batches(spark, str(tmp_path / "out/late")).collect()] == ["old"]


def test_rewritten_batch_leaves_one_copy(spark, tmp_path):
    root = str(tmp_path / "t")
    I.write_batch(spark.range(5), root, 0)
    I.write_batch(spark.range(5), root, 0)
    I.write_batch(spark.range(2), root, 1)
    assert I.read_batches(spark, root).count() == 7 and I.read_batches(spark, root, 1).count() == 5


def test_uploads_over_several_batches_equal_the_batch_job(spark, tables, tmp_path):
    rows = notices(tables)
    stream = feed(rows, str(tmp_path / "in"), 4, "ts")
    I.ingest_uploads(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = I.read_batches(spark, str(tmp_path / "out/actions")).select("event_id", "action")
    want = admit_uploads(I.shape_uploads(rows), ["org_id", "folder"], "path", "ts", "event_id").select("event_id", "action")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert I.read_batches(spark, str(tmp_path / "out/actions")).select("batch").distinct().count() == 4


def test_admission_stream_equals_the_batch_job(spark, tables, tmp_path):
    rows = calls(tables)
    stream = feed(rows, str(tmp_path / "in"), 3, "at")
    verdicts = Z.admission_stream(stream, "session_id", "at", "event_id", 5, 7200)
    I.start(verdicts, lambda df, n: I.write_batch(df, str(tmp_path / "out"), n), str(tmp_path / "ck")).awaitTermination()
    cols = ["session_id", "event_id", "admitted", "retry_after", "remaining"]
    got = I.read_batches(spark, str(tmp_path / "out")).select(cols)
    want = Z.admission(rows, "session_id", "at", "event_id", 5, 7200).select(cols)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == rows.count()
    assert not want.filter("not admitted").isEmpty()


def test_counters_over_several_batches(spark, tables, tmp_path):
    usage_rows = tables.token_usage.select("org_id", "total_tokens", "created_at")
    stream = feed(usage_rows, str(tmp_path / "in"), 3, "created_at")
    I.count_usage(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = I.read_counters(spark, str(tmp_path / "out"))
    want = usage_rows.groupBy("org_id", F.date_trunc("day", "created_at").alias("period_start")).agg(
        F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("total_requests"))
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_late_rows_count_in_their_own_period(spark, tmp_path):
    days = (20, 21, 3, 22, 1)
    rows = [("o", 10, dt.datetime(2024, 1, day)) for day in days]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "org_id string, total_tokens long, created_at timestamp_ntz, seq int")
    stream = feed(df, str(tmp_path / "in"), 5, "seq")
    I.count_usage(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = I.read_counters(spark, str(tmp_path / "out")).collect()
    assert sorted((r.period_start.day, r.total_tokens) for r in got) == sorted((d, 10) for d in days)


def test_a_folder_opens_a_new_job_after_the_old_one_ended(spark, tmp_path):
    def notice(i, name):
        return (i, dt.datetime(2024, 1, 1, 0, i), "b", f"org/bulk/f/{name}.pdf")

    rows = [notice(0, "a"), notice(1, "b"), notice(2, "c"), notice(3, "a"), notice(4, "d"), notice(5, "c"), notice(6, "a")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, bucket string, name string")
    stream = feed(df, str(tmp_path / "in"), 7, "event_id")
    out = str(tmp_path / "out")

    def ended(session):
        """The first job ends once its third file was refused."""
        jobs = I.read_batches(session, f"{out}/documents")
        first = [] if jobs is None else jobs.filter("batch = 0").select("bulk_job_id").collect()
        refused = I.read_batches(session, f"{out}/actions")
        over = refused is not None and refused.filter("batch >= 2").count() > 0
        return session.createDataFrame([(r[0],) for r in first] if over else [], "bulk_job_id string")

    I.ingest_uploads(stream, out, str(tmp_path / "ck"), cap=2, ended=ended).awaitTermination()
    got = [r.action for r in I.read_batches(spark, f"{out}/actions").orderBy("event_id").collect()]
    # a and b fill the first job, c is refused; then a, d open and fill the second, c is refused, a is known
    assert got == ["added", "added", "limit_exceeded", "added", "added", "limit_exceeded", "exists"]
    jobs = I.read_batches(spark, f"{out}/documents").groupBy("bulk_job_id").count().collect()
    assert sorted(r["count"] for r in jobs) == [2, 2]


def test_an_id_repeated_a_year_later_is_stored_once(spark, tmp_path, monkeypatch):
    from ledgerlens.streaming import known_ids

    monkeypatch.setattr(known_ids.KnownIds.__init__, "__defaults__", ("string", 4, 2))  # four buckets, folded every second batch
    minutes = [0, 1, 60 * 24 * 40, 60 * 24 * 366, 60 * 24 * 366 + 1, 60 * 24 * 367]
    rows = [usage("a", minutes[0], tokens=1), usage("b", minutes[1]), usage("c", minutes[2]), usage("a", minutes[3], tokens=9), usage("d", minutes[4]),
            usage("b", minutes[5], tokens=9)]
    df = spark.createDataFrame(rows, SCHEMA)
    I.ingest_usage(feed(df, str(tmp_path / "in"), 6, "created_at"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    tokens = I.read_batches(spark, str(tmp_path / "out/token_usage"))
    assert sorted((r.request_id, r.total_tokens) for r in tokens.collect()) == [("a", 1), ("b", 10), ("c", 10), ("d", 10)]
    ids = known_ids.KnownIds(spark, str(tmp_path / "out/known/token_usage"))
    assert sorted(r.id for r in ids.before(100 * 2).collect()) == [] and sorted(r.id for r in ids.before(5).collect()) == ["a", "b", "c", "d"]


def test_known_ids_join_without_moving_history(spark, tmp_path):
    from ledgerlens.streaming.known_ids import KnownIds

    known = KnownIds(spark, str(tmp_path / "ids"), "long", buckets=8, fold_every=3)
    for n in range(7):
        known.fold(n)
        assert known.before(n).distinct().count() == 1000 * n
        known.add(spark.range(1000 * n, 1000 * n + 1000), n)
        known.add(spark.range(1000 * n, 1000 * n + 1000), n)  # a repeated batch
    assert known.before(6).distinct().count() == 6000  # what batch 6 stored is not there for batch 6
    fresh = spark.range(5500, 8000).join(known.before(7), "id", "left_anti")
    assert sorted(r.id for r in fresh.collect()) == list(range(7000, 8000))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.range(10).join(known.before(7), "id", "left_anti")._jdf.queryExecution().sparkPlan().toString()
        executed = spark.range(10).join(known.before(7), "id", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Bucketed: true" in executed and executed.count("Exchange hashpartitioning") == 1, plan


def test_admission_state_ends(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(s, i, at + dt.timedelta(minutes=m)) for i, (s, m) in enumerate([("a", 0), ("a", 1), ("b", 2), ("a", 3), ("b", 600), ("a", 601), ("b", 1300), ("b", 2600)])]
    df = spark.createDataFrame(rows, "session_id string, event_id int, at timestamp_ntz")
    stream = feed(df, str(tmp_path / "in"), 8, "at")
    verdicts = Z.admission_stream(stream, "session_id", "at", "event_id", 2, 3600, delay="10 minutes")
    job = I.start(verdicts, lambda d, n: I.write_batch(d, str(tmp_path / "out"), n), str(tmp_path / "ck"))
    job.awaitTermination()
    cols = ["session_id", "event_id", "admitted", "retry_after", "remaining"]
    got = I.read_batches(spark, str(tmp_path / "out")).select(cols)
    want = Z.admission(df, "session_id", "at", "event_id", 2, 3600).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    states = [p["stateOperators"][0]["customMetrics"] | {"rows": p["stateOperators"][0]["numRowsTotal"]} for p in job.recentProgress if p["stateOperators"]]
    left = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "ck")).count()
    assert left <= 1, states  # of two sessions, only the last call can still count
