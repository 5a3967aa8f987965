import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import maintenance as M
from ledgerlens.streaming import ingest as I
from test_streams import feed

SUBS = ("org_id string, current_period_start timestamp_ntz, current_period_end timestamp_ntz, tokens_used_this_period long, "
        "llamaparse_pages_used long, file_search_queries_used long, storage_used_bytes long")
USAGE = "org_id string, created_at timestamp_ntz, total_tokens long, resource_type string, amount long, seq int"


def day(month, d, hour=0):
    return dt.datetime(2024, month, d, hour)


def run(spark, tmp_path, subs, rows, pieces, **more):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], USAGE)
    I.count_periods(feed(df, str(tmp_path / "in"), pieces, "seq"), subs, str(tmp_path / "out"), str(tmp_path / "ck"), **more).awaitTermination()
    return I.read_periods(spark, str(tmp_path / "out")), df


def test_replay_across_periods_equals_a_rebuild(spark, tmp_path):
    subs = spark.createDataFrame(
        [("a", day(1, 1), day(2, 1), 7, 7, 7, 7), ("b", day(1, 10), day(2, 10), 0, 0, 0, 0), ("c", day(1, 1), day(9, 1), 0, 0, 0, 0), ("idle", day(1, 1), day(2, 1), 5, 5, 5, 5)], SUBS)
    rows = []
    for i in range(0, 75):  # January to mid March, some rows late
        at = day(1, 1) + dt.timedelta(days=i if i % 9 else max(0, i - 40), hours=i % 24)
        rows.append(("abcx"[i % 4], at, 10 + i, None, 0))
        rows.append(("abc"[i % 3], at, 0, ["llamaparse_pages", "file_search_queries", "storage_bytes"][i % 3 - 1], i))
    got, df = run(spark, tmp_path, subs, rows, 6)
    newest = max(r[1] for r in rows)
    want = M.rebuild_counters(M.roll_periods(subs, F.lit(newest)), df.filter("resource_type is null"), df.filter("resource_type is not null"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.org_id: r.current_period_start.month for r in got.collect()} == {"a": 3, "b": 3, "c": 1, "idle": 3}
    # no row is lost: what has left the open periods is closed, days of unknown organisations wait
    closed = I.read_batches(spark, str(tmp_path / "out/closed")).agg(F.sum("_t")).first()[0]
    waiting = spark.read.parquet(str(tmp_path / "out/days/slot=1"))
    assert waiting.filter("org_id = 'a' and day < date'2024-03-01'").isEmpty() and not waiting.filter("org_id = 'x'").isEmpty()
    assert closed + waiting.agg(F.sum("_t")).first()[0] == sum(r[2] for r in rows)


def test_changed_subscriptions(spark, tmp_path):
    subs = spark.createDataFrame([("a", day(1, 1), day(2, 1), 0, 0, 0, 0)], SUBS)
    rows = [("a", day(1, 5), 1, None, 0), ("n", day(1, 6), 2, None, 0), ("a", day(1, 20), 4, None, 0), ("n", day(1, 21), 8, None, 0)]

    def changes(session):
        """Organisation n subscribes after the first micro-batch; a's period is altered then."""
        try:
            seen = session.read.parquet(str(tmp_path / "out/subscriptions/slot=0")).count()
        except Exception:  # noqa: BLE001 - no batch yet
            seen = 0
        new = [("n", day(1, 1), day(2, 1), 0, 0, 0, 0), ("a", day(1, 10), day(2, 10), 0, 0, 0, 0)]
        return session.createDataFrame(new if seen else [], SUBS)

    got, _ = run(spark, tmp_path, subs, rows, 2, changes=changes)
    assert {r.org_id: r.tokens_used_this_period for r in got.collect()} == {"a": 4, "n": 10}


def test_a_repeated_batch_sees_the_same_changes(spark, tmp_path):
    path = str(tmp_path / "c")
    I.write_once(spark.range(3), path)
    I.write_once(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
