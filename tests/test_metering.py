import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A, joins as J, maintenance as M


def view(spark, used, limit, tier="free"):
    return spark.createDataFrame(
        [("o", tier, used, 0, 0, 0, limit, 1, 1, 1)],
        "org_id string, tier_name string, tokens_used_this_period long, llamaparse_pages_used long, "
        "file_search_queries_used long, storage_used_bytes long, monthly_token_limit long, "
        "monthly_llamaparse_pages_limit long, monthly_file_search_queries_limit long, storage_limit_bytes long")


def tokens_row(df):
    return df.filter("usage_type = 'tokens'").first()


def test_quota_remaining_and_percentage(spark):
    row = tokens_row(A.quota_status(view(spark, 1000, 50000)))
    assert (row.remaining, row.percentage_used, row.allowed) == (49000, 2.0, True)


def test_quota_without_limit_is_full(spark):
    row = tokens_row(A.quota_status(view(spark, 0, 0), 1))
    assert (row.percentage_used, row.allowed, row.remaining) == (100.0, False, 0)


def test_quota_exactly_at_limit_is_allowed(spark):
    assert tokens_row(A.quota_status(view(spark, 40, 50), 10)).allowed
    assert not tokens_row(A.quota_status(view(spark, 40, 50), 11)).allowed


def test_upgrade_advice_follows_tier(spark):
    assert tokens_row(A.quota_status(view(spark, 1, 2, "pro"))).upgrade_tier == "enterprise"
    assert tokens_row(A.quota_status(view(spark, 1, 2, "enterprise"))).upgrade_tier is None
    row = A.quota_status(view(spark, 1, 2)).filter("usage_type = 'file_search_queries'").first()
    assert row.upgrade_message == "Upgrade to Pro for 10x more file search queries"


def test_exact_price_default_and_zero(spark):
    usage = spark.createDataFrame([("gpt-4o", 1000, 500), ("mystery", 1000, 500), ("gpt-4o", 0, 0)],
                                  "model string, input_tokens long, output_tokens long")
    costs = [r.total_cost_usd for r in J.attach_cost(usage, J.exact_prices(spark)).orderBy("model", "input_tokens").collect()]
    assert costs == [Decimal(0), Decimal("0.0075"), Decimal("0.00125")]


def test_fuzzy_price_order(spark):
    usage = spark.createDataFrame([("gpt-5.2",), ("GPT-5-mini-x",), ("gemini",), ("zzz",), ("",)], "model string").withColumn(
        "input_tokens", F.lit(1_000_000)).withColumn("output_tokens", F.lit(0))
    got = {r.model: r.input_cost_usd for r in J.attach_cost(usage, J.fuzzy_prices(spark), "fuzzy").collect()}
    assert got == {"gpt-5.2": 1.75, "GPT-5-mini-x": 0.25, "gemini": 0.075, "zzz": 0.10, "": 0.10}


def test_merge_keeps_first_provider(spark):
    calls = spark.createDataFrame(
        [("s", 1, 100, 50, 150, 10, None, None), ("s", 2, 200, 100, 300, 20, "openai", "gpt-4o"), ("s", 3, 0, 0, 0, 0, "google", "g")],
        "k string, seq int, input_tokens long, output_tokens long, total_tokens long, cached_tokens long, provider string, model string")
    assert tuple(A.merge_usage(calls, ["k"], "seq").first()) == ("s", 300, 150, 450, 30, "openai", "gpt-4o")


def test_progress_golden(spark):
    docs = [("j", s, 0, 0) for s in ["completed"] * 5 + ["failed"] * 2 + ["skipped"] + ["pending"] * 2]
    row = A.job_progress(spark.createDataFrame(docs, "bulk_job_id string, status string, token_usage int, llamaparse_pages int")).first()
    assert (row.progress_percentage, row.pending_count) == (80.0, 2)
    empty = spark.createDataFrame([(0,)], "total_documents long")
    assert A.with_progress(empty, F.lit(0)).first().progress_percentage == 0.0


def test_period_rolls_over(spark):
    subs = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 31), 5), ("b", dt.datetime(2024, 3, 1), 5)], "org_id string, current_period_end timestamp_ntz, n long"
    ).select("org_id", "current_period_end", F.lit("2023-12-01").cast("timestamp_ntz").alias("current_period_start"),
             *[F.col("n").alias(c) for c in ("tokens_used_this_period", "llamaparse_pages_used", "file_search_queries_used", "storage_used_bytes")])
    rows = {r.org_id: r for r in M.roll_periods(subs, F.lit("2024-02-15 10:00:00").cast("timestamp_ntz")).collect()}
    assert rows["a"].tokens_used_this_period == 0 and rows["a"].storage_used_bytes == 5
    assert (rows["a"].current_period_start, rows["a"].current_period_end) == (dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1))
    assert rows["b"].tokens_used_this_period == 5


def test_describe_is_exact(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (2,), (None,), (7,)], "v int")
    row = A.describe_numeric(df).first()
    assert (row["count"], row.p25, row.p50, row.p75, row["max"]) == (5, 1.0, 1.0, 2.0, 7.0)
    two = A.describe_numeric(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "v double")).first()
    assert (two.p25, two.p50, two.p75) == (0.75, 1.5, 2.5)


def test_describe_brackets_large_skewed_column(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.col("id") % 1009, 2.0)).alias("v"))
    row = A.describe_numeric(df, accuracy=1000).first()
    exact = df.agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p")).first().p
    assert [row.p25, row.p50, row.p75] == exact


def test_history_counts_gaps_as_zero(spark):
    day = dt.datetime(2024, 1, 1, 5)
    tokens = spark.createDataFrame([("o", 10, Decimal("0.5"), day)], "org_id string, total_tokens long, total_cost_usd decimal(38,12), created_at timestamp_ntz")
    pages = spark.createDataFrame([("o", "llamaparse_pages", 3, day + dt.timedelta(days=40))], "org_id string, resource_type string, amount long, created_at timestamp_ntz")
    rows = A.usage_history(tokens, pages, "monthly").orderBy("period_start").collect()
    assert [(str(r.period_start), str(r.period_end), r.total_tokens, r.llamaparse_pages) for r in rows] == [
        ("2024-01-01", "2024-01-31", 10, 0), ("2024-02-01", "2024-02-29", 0, 3)]
