"""Usage rollups, quotas, dashboards, profiles and progress counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ledgerlens.functions import constants as K
from ledgerlens.functions.text import pattern_count
from ledgerlens.operators.filters import filter_events
from ledgerlens.operators.ordering import first_n
from ledgerlens.session import stored

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _percent(used: Column, limit: Column) -> Column:
    share = F.round(used.cast("double") / F.when(limit > 0, limit) * 100, 2)
    return F.coalesce(share, F.lit(100.0))


def period_column(ts: str, grain: str) -> Column:
    day = F.to_date(F.col(ts))
    if grain == "daily":
        return day
    if grain == "monthly":
        return F.trunc(day, "month")
    raise ValueError(f"unknown grain {grain!r}")


def usage_history(
    tokens: DataFrame, resources: DataFrame, grain: str = "daily", start=None, end=None,
    limit: int | None = None, org: str = "org_id", ts: str = "created_at",
) -> DataFrame:
    """Tokens, cost, requests, parsed pages and searches per organisation and period.

    Token and resource rows are stacked and aggregated once: one shuffle of
    partial sums replaces a date spine with three outer joins, and gaps come out
    as zeros. ``limit`` keeps the newest periods of each organisation.
    """
    tokens = filter_events(tokens, ts=ts, start=start, end=end)
    resources = filter_events(resources, ts=ts, start=start, end=end).filter(
        F.col("resource_type").isin("llamaparse_pages", "file_search_queries")
    )
    kind = F.col("resource_type")
    stacked = tokens.select(
        org, period_column(ts, grain).alias("period_start"),
        F.col("total_tokens").alias("_tokens"), F.col("total_cost_usd").alias("_cost"),
        F.lit(1).alias("_request"), F.lit(0).cast("long").alias("_pages"),
        F.lit(0).cast("long").alias("_searches"),
    ).unionByName(resources.select(
        org, period_column(ts, grain).alias("period_start"),
        F.lit(0).cast("long").alias("_tokens"), F.lit(0).cast("decimal(38,12)").alias("_cost"),
        F.lit(0).alias("_request"),
        F.when(kind == "llamaparse_pages", F.col("amount")).otherwise(0).cast("long").alias("_pages"),
        F.when(kind == "file_search_queries", F.col("amount")).otherwise(0).cast("long").alias("_searches"),
    ))
    end_day = F.col("period_start") if grain == "daily" else F.last_day("period_start")
    history = stacked.groupBy(org, "period_start").agg(
        F.coalesce(F.sum("_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("_cost"), F.lit(0)).alias("total_cost_usd"),
        F.sum("_request").alias("total_requests"),
        F.sum("_pages").alias("llamaparse_pages"),
        F.sum("_searches").alias("file_search_queries"),
    ).withColumn("period_end", end_day)
    if limit is None:
        return history
    return first_n(history, [org], [F.desc("period_start")], limit)


def usage_window(tokens: DataFrame, resources: DataFrame, preset: str, now) -> tuple[DataFrame, DataFrame]:
    """History of a preset window ending at ``now``, and its totals per organisation."""
    import datetime as dt

    if preset not in K.PRESET_DAYS:
        raise ValueError(f"period must be one of {', '.join(K.PRESET_DAYS)}")
    days = K.PRESET_DAYS[preset]
    history = usage_history(
        tokens, resources, "daily" if days <= 30 else "monthly",
        now - dt.timedelta(days=days), now, limit=days,
    )
    totals = history.groupBy("org_id").agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("periods"),
    )
    return history, totals


def feature_breakdown(tokens: DataFrame, start=None, end=None, org: str | None = "org_id",
                      ts: str = "created_at") -> DataFrame:
    """Tokens and cost per feature with its share of the organisation's total.

    Shares are taken over the already aggregated rows, never over raw events.
    """
    tokens = filter_events(tokens, ts=ts, start=start, end=end)
    keys = [org] if org else []
    rows = tokens.groupBy(*keys, F.coalesce("feature", F.lit("unknown")).alias("name")).agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens_used"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0)).alias("cost_usd"),
    )
    if org:
        totals = rows.groupBy(org).agg(F.sum("tokens_used").alias("_total"))
        rows = rows.join(totals, org)
    else:
        rows = rows.withColumn("_total", rows.agg(F.sum("tokens_used")).scalar())
    share = F.round(F.col("tokens_used").cast("double") / F.when(F.col("_total") > 0, F.col("_total")) * 100, 2)
    return rows.withColumn("percentage", F.coalesce(share, F.lit(0.0))).drop("_total")


RESOURCES = [
    ("tokens", "tokens_used_this_period", "monthly_token_limit"),
    ("llamaparse_pages", "llamaparse_pages_used", "monthly_llamaparse_pages_limit"),
    ("file_search_queries", "file_search_queries_used", "monthly_file_search_queries_limit"),
    ("storage_bytes", "storage_used_bytes", "storage_limit_bytes"),
]


def quota_status(subs_view: DataFrame, estimate: int | Mapping[str, Column] = 0,
                 clamp_remaining: bool = True) -> DataFrame:
    """One row per organisation and resource with the allowance for ``estimate`` more.

    ``estimate`` is a number for every resource or a column per resource name.
    The dashboard variant leaves ``remaining`` unclamped.
    """
    entries = []
    for kind, used, limit in RESOURCES:
        extra = estimate.get(kind, F.lit(0)) if isinstance(estimate, Mapping) else F.lit(estimate)
        entries.append(F.struct(
            F.lit(kind).alias("usage_type"), F.col(used).cast("long").alias("current_usage"),
            F.col(limit).cast("long").alias("limit"), extra.cast("long").alias("estimate"),
        ))
    long = subs_view.select("org_id", "tier_name", F.explode(F.array(*entries)).alias("q")).select(
        "org_id", "tier_name", "q.*"
    )
    left = F.col("limit") - F.col("current_usage")
    # advice follows the tier name
    tier = F.lower("tier_name")
    upgrade = F.lit(None).cast("string")
    for name, target in reversed(list(K.UPGRADE_PATH.items())):
        upgrade = F.when(F.contains(tier, F.lit(name)), F.lit(target)).otherwise(upgrade)
    label = F.replace("usage_type", F.lit("_"), F.lit(" "))
    return (
        long.withColumn("remaining", F.greatest(F.lit(0), left) if clamp_remaining else left)
        .withColumn("percentage_used", _percent(F.col("current_usage"), F.col("limit")))
        .withColumn("allowed", F.col("current_usage") + F.col("estimate") <= F.col("limit"))
        .withColumn("upgrade_tier", upgrade)
        .withColumn("upgrade_message", F.concat(
            F.lit("Upgrade to "), F.initcap("upgrade_tier"), F.lit(" for 10x more "), label))
        .withColumn("upgrade_url", F.concat(F.lit("/settings/billing?upgrade="), F.col("upgrade_tier")))
    )


def quota_alerts(quotas: DataFrame) -> DataFrame:
    """Exceeded resources and those approaching their limit, per organisation."""
    near = F.col("allowed") & (F.col("percentage_used") >= K.ALERT_PERCENT)
    name = F.when(F.col("usage_type") == "storage_bytes", "storage").otherwise(F.col("usage_type"))
    return quotas.groupBy("org_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("allowed"), name))).alias("exceeded"),
        F.array_sort(F.collect_list(F.when(near, name))).alias("approaching_limit"),
    ).withColumn("all_within_limits", F.size("exceeded") == 0)


def usage_summary(subs_view: DataFrame, tokens: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Period usage of every organisation on one row, and its feature breakdown.

    The breakdown counts the token rows of each organisation's own period, both
    ends included. Periods start and end at midnight, so tokens are first summed
    per organisation, feature and day, with rows of exactly midnight apart.
    """
    gib = F.lit(float(1024 ** 3))
    row = subs_view
    for kind, used, limit in RESOURCES:
        row = row.withColumn(f"{kind}_percentage", _percent(F.col(used), F.col(limit))).withColumn(
            f"{kind}_remaining", F.greatest(F.lit(0).cast("long"), F.col(limit) - F.col(used))
        )
    whole_days = F.floor(
        (F.unix_micros(F.col("current_period_end").cast("timestamp")) - F.unix_micros(now.cast("timestamp")))
        / F.lit(86_400_000_000)
    )
    row = (
        row.withColumn("days_remaining", F.greatest(F.lit(0).cast("long"), whole_days.cast("long")))
        .withColumn("storage_used_gb", F.col("storage_used_bytes") / gib)
        .withColumn("storage_limit_gb", F.col("storage_limit_bytes") / gib)
        .withColumn("tier_display_name", F.initcap("tier_name"))
    )
    day = F.to_date("created_at")
    daily = tokens.groupBy(
        "org_id", "feature", day.alias("_day"), (F.col("created_at") == day.cast("timestamp_ntz")).alias("_midnight")
    ).agg(F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost_usd").alias("total_cost_usd"))
    periods = subs_view.select(
        "org_id", F.to_date("current_period_start").alias("_from"), F.to_date("current_period_end").alias("_to"))
    until = (F.col("_day") < F.col("_to")) | ((F.col("_day") == F.col("_to")) & F.col("_midnight"))
    inside = daily.join(periods, "org_id").filter((F.col("_day") >= F.col("_from")) & until)
    return row, feature_breakdown(inside)


def dashboard(docs: DataFrame, jobs: DataFrame, gens: DataFrame, start=None, end=None,
              org: str = "org_id") -> DataFrame:
    """Document, job and generation counts per organisation.

    Documents are never date-filtered. The three tables are stacked and
    aggregated in one shuffle; missing sides give zeros.
    """
    jobs = filter_events(jobs, ts="started_at", start=start, end=end)
    gens = filter_events(gens, ts="created_at", start=start, end=end)
    stacked = (
        docs.select(org, F.lit("d").alias("_t"))
        .unionByName(jobs.select(
            org, F.lit("j").alias("_t"), F.col("status").alias("_status"),
            F.col("cached").alias("_cached"), F.col("duration_ms").cast("double").alias("_ms"),
        ), allowMissingColumns=True)
        .unionByName(gens.select(
            org, F.lit("g").alias("_t"), F.col("generation_type").alias("_type")
        ), allowMissingColumns=True)
    )

    def count(test: Column) -> Column:
        return F.count(F.when(test, 1))

    is_job, is_gen = F.col("_t") == "j", F.col("_t") == "g"
    out = stacked.groupBy(org).agg(
        count(F.col("_t") == "d").alias("total_documents"),
        count(is_job).alias("total_jobs"),
        count(is_gen).alias("total_generations"),
        *[count(is_job & (F.col("_status") == s)).alias(f"jobs_{s}")
          for s in ("completed", "processing", "failed")],
        *[count(is_gen & (F.col("_type") == g)).alias(f"generations_{g}")
          for g in ("summary", "faqs", "questions", "all")],
        count(is_job & F.col("_cached")).alias("_hits"),
        F.round(F.coalesce(F.avg("_ms"), F.lit(0.0)), 2).alias("avg_processing_time_ms"),
    )
    rate = F.col("_hits").cast("double") / F.when(F.col("total_jobs") > 0, F.col("total_jobs"))
    return out.withColumn("cache_hit_rate", F.coalesce(F.round(rate, 4), F.lit(0.0))).drop("_hits")


def count_by(df: DataFrame, keys: Sequence[str], **preds) -> DataFrame:
    """Filtered row counts per key combination."""
    return filter_events(df, **preds).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def tier_census(subs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Subscriptions per tier, tiers without any included."""
    counts = subs.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.select("tier").join(counts, "tier", "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def folder_rollup(manifest: DataFrame, keys: Sequence[str], size: str = "length",
                  supported: Column | None = None, cap: int = K.MAX_FOLDER_DOCUMENTS) -> DataFrame:
    """Documents and bytes per folder with a verdict for processing.

    ``supported`` marks rows that count as documents; a folder of other files
    only is present but empty.
    """
    counts = F.lit(True) if supported is None else supported
    verdict = (
        F.when(F.col("document_count") == 0, "empty")
        .when(F.col("document_count") > cap, "over_cap").otherwise("valid")
    )
    return manifest.groupBy(*keys).agg(
        F.count(F.when(counts, 1)).alias("document_count"),
        F.coalesce(F.sum(F.when(counts, F.col(size))), F.lit(0)).alias("total_size_bytes"),
    ).withColumn("verdict", verdict)


def profile(df: DataFrame) -> DataFrame:
    """Name, type, row count and null count of every column, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    entries = [
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"_n{i}").alias("null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(
        F.explode(F.array(*entries)).alias("c"), F.col("_rows").alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
    ).select("c.*", "row_count", "column_count")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def profile_by_terms(
    df: DataFrame, question: str, financial: Sequence[str] = tuple(K.FINANCIAL_TERMS),
    quarters: Sequence[str] = tuple(K.QUARTER_TERMS), fiscal_year: str = K.FISCAL_YEAR,
) -> DataFrame:
    """Long table of the numeric profiles a question asks for.

    ``analysis`` is revenue, quarterly, totals or fiscal_year; mean, max and min
    are null where the analysis does not report them. ``highest`` marks the
    revenue column with the largest total.
    """
    asked = question.lower()
    numbers = numeric_columns(df)
    marks = [f"fy{fiscal_year}", f"fy {fiscal_year}", f"fy20{fiscal_year}",
             f"fiscal{fiscal_year}", f"fiscal {fiscal_year}"]

    def named(terms):
        return [c for c in numbers if any(t in c.lower() for t in terms)]

    plan: list[tuple[str, str, int]] = []
    if any(t in asked for t in financial):
        plan += [("revenue", c, 4) for c in named(financial)]
    if any(t in asked for t in quarters):
        plan += [("quarterly", c, 2) for c in named(quarters)]
    if "total" in asked or "sum" in asked:
        plan += [("totals", c, 1) for c in numbers]
    if any(m in asked for m in marks):
        plan += [("fiscal_year", c, 1) for c in named(marks)]
    schema = ("analysis string, column_name string, total double, average double, "
              "max double, min double, highest boolean")
    if not plan:
        return df.sparkSession.createDataFrame([], schema)
    used = sorted({c for _, c, _ in plan})
    at = {c: i for i, c in enumerate(used)}
    aggs = []
    for c in used:
        value = F.col(f"`{c}`").cast("double")
        aggs += [
            F.coalesce(F.sum(value), F.lit(0.0)).alias(f"_s{at[c]}"), F.avg(value).alias(f"_a{at[c]}"),
            F.max(value).alias(f"_x{at[c]}"), F.min(value).alias(f"_m{at[c]}"),
        ]
    none = F.lit(None).cast("double")
    revenue = [F.col(f"_s{at[c]}") for a, c, _ in plan if a == "revenue"]
    top = F.greatest(*revenue) if len(revenue) > 1 else (revenue[0] if revenue else none)
    entries = [
        F.struct(
            F.lit(a).alias("analysis"), F.lit(c).alias("column_name"), F.col(f"_s{at[c]}").alias("total"),
            (F.col(f"_a{at[c]}") if depth >= 2 else none).alias("average"),
            (F.col(f"_x{at[c]}") if depth >= 4 else none).alias("max"),
            (F.col(f"_m{at[c]}") if depth >= 4 else none).alias("min"),
            (F.col(f"_s{at[c]}").eqNullSafe(top) if a == "revenue" else F.lit(False)).alias("highest"),
        )
        for a, c, depth in plan
    ]
    return df.agg(*aggs).select(F.explode(F.array(*entries)).alias("p")).select("p.*")


BRACKET_SLOTS = 4096


def describe_numeric(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Count, mean, sample deviation and exact interpolated quartiles per numeric column.

    Instead of one value table per column, a mergeable rank sketch first brackets
    each quartile (its rank error is at most 1/accuracy); then values below the
    brackets are counted and only those inside are ranked exactly. The driver sees
    one row per column.
    """
    numbers = numeric_columns(df)
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    slack = 3 / accuracy
    ends = [F.lit(max(0.0, min(1.0, q + s))) for q in quartiles.values() for s in (-slack, slack)]
    aggs = []
    for i, c in enumerate(numbers):
        value = F.col(f"`{c}`").cast("double")
        aggs += [
            F.count(value).alias(f"_count{i}"), F.avg(value).alias(f"_mean{i}"),
            F.stddev_samp(value).alias(f"_std{i}"), F.min(value).alias(f"_min{i}"),
            F.max(value).alias(f"_max{i}"),
            F.percentile_approx(value, F.array(*ends), accuracy).alias(f"_ends{i}"),
        ]
    basic = ["count", "mean", "std", "min", "max", "ends"]
    summary = df.agg(*aggs).first()  # one row, as wide as the schema
    schema = "column_name string, count long, mean double, std double, min double, max double"
    sketch = df.sparkSession.createDataFrame(
        [(c, *(summary[f"_{s}{i}"] for s in basic[:-1])) for i, c in enumerate(numbers)], schema)
    brackets = [
        (c, name, q * (summary[f"_count{i}"] - 1), *summary[f"_ends{i}"][2 * k:2 * k + 2])
        for i, c in enumerate(numbers) if summary[f"_count{i}"] for k, (name, q) in enumerate(quartiles.items())]
    if not brackets:
        return sketch.select("column_name", "count", "mean", "std", "min", *[F.lit(None).cast("double").alias(p) for p in quartiles], "max")
    # what lies below each bracket is counted where it is; only values inside brackets become rows
    below = df.agg(*[
        F.count(F.when(F.col(f"`{c}`").cast("double") < lo, 1)).alias(f"_b{n}") for n, (c, _, _, lo, _) in enumerate(brackets)]).first()
    inside, before_all = [], []
    for n, (c, name, at, lo, hi) in enumerate(brackets):
        value = F.col(f"`{c}`").cast("double")
        share = (value - lo) / (hi - lo) if hi > lo else F.lit(0.0)
        inside.append(F.when((value >= lo) & (value <= hi), F.struct(
            F.lit(c).alias("column_name"), F.lit(name).alias("name"), F.floor(share * BRACKET_SLOTS).alias("slot"), value.alias("v"))))
        before_all.append((c, name, at, below[f"_b{n}"]))
    counted = df.select(F.explode(F.array_compact(F.array(*inside))).alias("m")).select("m.*").groupBy(
        "column_name", "name", "slot", "v").agg(F.count(F.lit(1)).alias("c"))
    ranks = df.sparkSession.createDataFrame(before_all, "column_name string, name string, at double, below long")
    # three rows per column
    counted = stored(counted.join(F.broadcast(ranks), ["column_name", "name"]), "brackets")
    # a bracket is cut into slots; only those that hold a wanted rank are ranked value by value
    slots = counted.groupBy("column_name", "name", "at", "below", "slot").agg(F.sum("c").alias("n"))
    along = Window.partitionBy("column_name", "name").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start")
    held = slots.withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(along), F.lit(0))).filter(
        (F.ceil("at") >= start) & (F.floor("at") < start + F.col("n"))).select("column_name", "name", "slot", "start")
    order = Window.partitionBy("column_name", "name", "slot").orderBy(F.col("v").asc_nulls_first())
    before = start + F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = counted.join(held, ["column_name", "name", "slot"]).withColumn("before", before)

    def value_at(rank: Column) -> Column:
        hit = (rank >= F.col("before")) & (rank < F.col("before") + F.col("c"))
        return F.max(F.when(hit, F.col("v")))

    low, high = value_at(F.floor("at")), value_at(F.ceil("at"))
    part = F.first("at") - F.floor(F.first("at"))
    found = span.groupBy("column_name", "name").agg((low + (high - low) * part).alias("value"))
    wide = found.groupBy("column_name").agg(
        *[F.max(F.when(F.col("name") == p, F.col("value"))).alias(p) for p in quartiles]
    )
    return sketch.join(wide, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, hits and oldest entry of each organisation's answer cache."""
    return cache.groupBy("org_id").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"),
        F.min("created_at").alias("oldest_entry"),
    )


def job_progress(docs: DataFrame, job: str = "bulk_job_id") -> DataFrame:
    """Counts, percentage done, pending and usage sums per job, from document rows."""
    def count(status: str) -> Column:
        return F.count(F.when(F.col("status") == status, 1))

    out = docs.groupBy(job).agg(
        F.count(F.lit(1)).alias("total_documents"),
        count("completed").alias("completed_count"),
        count("failed").alias("failed_count"),
        count("skipped").alias("skipped_count"),
        F.coalesce(F.sum("token_usage"), F.lit(0)).cast("long").alias("total_tokens_used"),
        F.coalesce(F.sum("llamaparse_pages"), F.lit(0)).cast("long").alias("total_llamaparse_pages"),
    )
    done = F.col("completed_count") + F.col("failed_count") + F.col("skipped_count")
    return out.transform(lambda d: with_progress(d, done))


def with_progress(jobs: DataFrame, done: Column) -> DataFrame:
    total = F.col("total_documents")
    share = F.round(done.cast("double") / F.when(total > 0, total) * 100, 1)
    return jobs.withColumn("progress_percentage", F.coalesce(share, F.lit(0.0))).withColumn(
        "pending_count", F.greatest(F.lit(0).cast("long"), total - done)
    )


def job_outcome(progress: DataFrame) -> DataFrame:
    """Final status: completed, partial_failure or failed."""
    status = (
        F.when(F.col("failed_count") == 0, "completed")
        .when(F.col("completed_count") > 0, "partial_failure").otherwise("failed")
    )
    return progress.withColumn("final_status", status)


def stage_timings(docs: DataFrame, job: str = "bulk_job_id") -> DataFrame:
    """Total and mean stage times per job; a missing stage counts as zero in totals."""
    stages = ["parse_time_ms", "index_time_ms", "generation_time_ms"]
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in stages[1:]), F.coalesce(F.col(stages[0]), F.lit(0)))
    rows = docs.withColumn("total_time_ms", total.cast("long"))
    names = [*stages, "total_time_ms"]
    return rows.groupBy(job).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"sum_{n}") for n in names],
        *[F.avg(n).alias(f"avg_{n}") for n in names],
    )


def pii_census(df: DataFrame, text: str, keys: Sequence[str] = (),
               types: Sequence[str] = tuple(K.PII_PATTERNS), custom: Mapping[str, str] | None = None) -> DataFrame:
    """Pattern matches per type and key, counted with native expressions."""
    patterns = {t: K.PII_PATTERNS[t] for t in types} | dict(custom or {})
    counted = df.select(*keys, text).select(
        *keys, *[pattern_count(F.col(text), p).alias(f"_{i}") for i, p in enumerate(patterns.values())]
    )
    sums = counted.groupBy(*keys).agg(
        *[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(patterns))]
    )
    entries = [
        F.struct(F.lit(t).alias("pii_type"), F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("matches"))
        for i, t in enumerate(patterns)
    ]
    return sums.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def difficulty_distribution(items: DataFrame, keys: Sequence[str], difficulty: str = "difficulty") -> DataFrame:
    """Easy, medium and hard counts; missing labels are medium, others ignored."""
    label = F.lower(F.coalesce(difficulty, F.lit("medium")))
    return items.groupBy(*keys).agg(
        *[F.count(F.when(label == d, 1)).alias(d) for d in ("easy", "medium", "hard")]
    )


def merge_usage(calls: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Summed tokens per key; provider and model of the first call that has them."""
    def first(name: str) -> Column:
        known = F.col(name).isNotNull() & (F.col(name) != "")
        return F.min_by(name, F.when(known, F.col(seq))).alias(name)

    return calls.groupBy(*keys).agg(
        *[F.sum(f"{t}_tokens").alias(f"{t}_tokens") for t in ("input", "output", "total", "cached")],
        first("provider"), first("model"),
    )


def count_fields(dtype: T.DataType, value: Column) -> Column:
    """Number of filled fields of a record: scalars 1, lists their length, structs recurse."""
    if isinstance(dtype, T.StructType):
        total = F.lit(0)
        for f in dtype.fields:
            total = total + count_fields(f.dataType, value[f.name])
        return total
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.when(value.isNotNull(), F.size(value)), F.lit(0))
    return F.when(value.isNotNull(), 1).otherwise(0)


def bulk_precheck(folders: DataFrame, subs_view: DataFrame) -> DataFrame:
    """Per folder: would its documents fit the page and token quotas of the organisation."""
    wanted = folders.select(
        "org_id", "folder", "document_count",
        F.col("document_count").alias("pages_needed"),
        (F.col("document_count") * K.BULK_TOKENS_PER_DOCUMENT).alias("tokens_needed"),
    )
    joined = wanted.join(subs_view, "org_id")
    pages = F.col("llamaparse_pages_used") + F.col("pages_needed") <= F.col("monthly_llamaparse_pages_limit")
    tokens = F.col("tokens_used_this_period") + F.col("tokens_needed") <= F.col("monthly_token_limit")
    return joined.select(
        *wanted.columns, pages.alias("pages_allowed"), tokens.alias("tokens_allowed"),
        (pages & tokens).alias("allowed"),
    )
