"""Usage metering queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A, joins as J, maintenance as M
from ledgerlens.plans.catalog import query
from ledgerlens.plans.roles import NOW, half_up

NOW_TS = dt.datetime.fromisoformat(NOW)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


HISTORY_SQL = """
WITH token_agg AS (
  SELECT org_id, {period} AS period_start, SUM(total_tokens) AS total_tokens,
         SUM(total_cost_usd) AS total_cost_usd, COUNT(*) AS total_requests
  FROM $token_usage {where} GROUP BY ALL),
page_agg AS (
  SELECT org_id, {period} AS period_start, SUM(amount) AS llamaparse_pages
  FROM $resource_usage {where_and} resource_type = 'llamaparse_pages' GROUP BY ALL),
search_agg AS (
  SELECT org_id, {period} AS period_start, SUM(amount) AS file_search_queries
  FROM $resource_usage {where_and} resource_type = 'file_search_queries' GROUP BY ALL),
spine AS (
  SELECT org_id, period_start FROM token_agg UNION SELECT org_id, period_start FROM page_agg
  UNION SELECT org_id, period_start FROM search_agg),
history AS (
SELECT s.org_id, s.period_start, {period_end} AS period_end,
       CAST(COALESCE(t.total_tokens, 0) AS BIGINT) AS total_tokens,
       CAST(COALESCE(t.total_cost_usd, 0) AS DOUBLE) AS total_cost_usd,
       CAST(COALESCE(t.total_requests, 0) AS BIGINT) AS total_requests,
       CAST(COALESCE(p.llamaparse_pages, 0) AS BIGINT) AS llamaparse_pages,
       CAST(COALESCE(q.file_search_queries, 0) AS BIGINT) AS file_search_queries
FROM spine s
LEFT JOIN token_agg t ON s.org_id = t.org_id AND s.period_start = t.period_start
LEFT JOIN page_agg p ON s.org_id = p.org_id AND s.period_start = p.period_start
LEFT JOIN search_agg q ON s.org_id = q.org_id AND s.period_start = q.period_start)
"""


def history_sql(grain: str, where: str = "") -> str:
    return HISTORY_SQL.format(
        period="CAST(created_at AS DATE)" if grain == "daily" else "CAST(date_trunc('month', created_at) AS DATE)",
        period_end="s.period_start" if grain == "daily" else "last_day(s.period_start)",
        where=f"WHERE {where}" if where else "", where_and=f"WHERE {where} AND" if where else "WHERE",
    )


def as_api(df):
    """Money leaves the engine as a double, as the service reports it."""
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            df = df.withColumn(name, F.col(name).cast("double"))
    return df


@query("a1_usage_history_daily", history_sql("daily") + "SELECT * FROM history")
def usage_history_daily(t):
    return as_api(A.usage_history(t.token_usage, t.resource_usage, "daily"))


@query("a1_usage_history_monthly", history_sql("monthly") + "SELECT * FROM history")
def usage_history_monthly(t):
    return as_api(A.usage_history(t.token_usage, t.resource_usage, "monthly"))


@query("a1_usage_history_latest", history_sql("daily") + """
SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY period_start DESC) <= 5""")
def usage_history_latest(t):
    return as_api(A.usage_history(t.token_usage, t.resource_usage, "daily", limit=5))


WINDOW = "created_at >= TIMESTAMP '2024-01-24' AND created_at <= TIMESTAMP '2024-01-31'"


@query("a2_usage_window_7d", history_sql("daily", WINDOW) + "SELECT * FROM history")
def usage_window_7d(t):
    return as_api(A.usage_window(t.token_usage, t.resource_usage, "7d", NOW_TS)[0])


@query("a2_usage_window_totals_90d", history_sql(
    "monthly", "created_at >= TIMESTAMP '2023-11-02' AND created_at <= TIMESTAMP '2024-01-31'") + """
SELECT org_id, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, SUM(total_cost_usd) AS total_cost_usd,
       COUNT(*) AS periods FROM history GROUP BY org_id""")
def usage_window_totals(t):
    return as_api(A.usage_window(t.token_usage, t.resource_usage, "90d", NOW_TS)[1])


@query("a3_feature_breakdown", """
SELECT name, CAST(tokens_used AS BIGINT) AS tokens_used, CAST(cost_usd AS DOUBLE) AS cost_usd,
       """ + half_up("tokens_used::DOUBLE / SUM(tokens_used) OVER ()::DOUBLE * 100", 2) + """ AS percentage
FROM (SELECT COALESCE(feature, 'unknown') AS name, SUM(total_tokens) AS tokens_used,
             SUM(total_cost_usd) AS cost_usd FROM $token_usage GROUP BY 1)""")
def feature_breakdown(t):
    return as_api(A.feature_breakdown(t.token_usage, org=None))


@query("a3_feature_breakdown_by_org", """
SELECT org_id, name, CAST(tokens_used AS BIGINT) AS tokens_used, CAST(cost_usd AS DOUBLE) AS cost_usd,
       CASE WHEN SUM(tokens_used) OVER w > 0
            THEN """ + half_up("tokens_used::DOUBLE / SUM(tokens_used) OVER w ::DOUBLE * 100", 2) + """ ELSE 0.0::DOUBLE END AS percentage
FROM (SELECT org_id, COALESCE(feature, 'unknown') AS name, SUM(total_tokens) AS tokens_used,
             SUM(total_cost_usd) AS cost_usd FROM $token_usage
      WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
WINDOW w AS (PARTITION BY org_id)""")
def feature_breakdown_by_org(t):
    return as_api(A.feature_breakdown(
        t.token_usage, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)))


QUOTA_SQL = """
quota AS (
SELECT org_id, tier_name, usage_type, current_usage, "limit", estimate,
       {remaining} AS remaining,
       CASE WHEN "limit" > 0 THEN """ + half_up('current_usage::DOUBLE / "limit" * 100', 2) + """ ELSE 100.0::DOUBLE END AS percentage_used,
       current_usage + estimate <= "limit" AS allowed,
       CASE tier_name WHEN 'free' THEN 'pro' WHEN 'pro' THEN 'enterprise' END AS upgrade_tier,
       CASE tier_name WHEN 'free' THEN 'Upgrade to Pro for 10x more ' || replace(usage_type, '_', ' ')
                      WHEN 'pro' THEN 'Upgrade to Enterprise for 10x more ' || replace(usage_type, '_', ' ') END AS upgrade_message,
       CASE tier_name WHEN 'free' THEN '/settings/billing?upgrade=pro'
                      WHEN 'pro' THEN '/settings/billing?upgrade=enterprise' END AS upgrade_url
FROM (
  SELECT org_id, tier_name, 'tokens' AS usage_type, tokens_used_this_period AS current_usage, monthly_token_limit AS "limit", CAST(100 AS BIGINT) AS estimate FROM $subs_view
  UNION ALL SELECT org_id, tier_name, 'llamaparse_pages', llamaparse_pages_used, monthly_llamaparse_pages_limit, 100 FROM $subs_view
  UNION ALL SELECT org_id, tier_name, 'file_search_queries', file_search_queries_used, monthly_file_search_queries_limit, 100 FROM $subs_view
  UNION ALL SELECT org_id, tier_name, 'storage_bytes', storage_used_bytes, storage_limit_bytes, 100 FROM $subs_view))
"""


@query("a4_quota_status", "WITH " + QUOTA_SQL.format(
    remaining='greatest(0, "limit" - current_usage)') + "SELECT * FROM quota")
def quota_status(t):
    return A.quota_status(J.subscription_view(t.subscriptions, t.tiers), 100)


@query("a4_quota_dashboard", "WITH " + QUOTA_SQL.format(
    remaining='"limit" - current_usage').replace("100 AS BIGINT", "0 AS BIGINT").replace(", 100 FROM", ", 0 FROM")
    + "SELECT org_id, usage_type, current_usage, remaining, percentage_used, allowed FROM quota")
def quota_dashboard(t):
    """The dashboard leaves the remainder unclamped."""
    return A.quota_status(J.subscription_view(t.subscriptions, t.tiers), clamp_remaining=False).select(
        "org_id", "usage_type", "current_usage", "remaining", "percentage_used", "allowed")


@query("a5_quota_alerts", "WITH " + QUOTA_SQL.format(remaining="0").replace(
    "100 AS BIGINT", "0 AS BIGINT").replace(", 100 FROM", ", 0 FROM") + """
SELECT org_id,
  COALESCE(string_agg(CASE WHEN NOT allowed THEN n END, ',' ORDER BY n), '') AS exceeded,
  COALESCE(string_agg(CASE WHEN allowed AND percentage_used >= 80 THEN n END, ',' ORDER BY n), '') AS approaching_limit,
  COUNT(CASE WHEN NOT allowed THEN 1 END) = 0 AS all_within_limits
FROM (SELECT *, CASE usage_type WHEN 'storage_bytes' THEN 'storage' ELSE usage_type END AS n FROM quota)
GROUP BY org_id""")
def quota_alerts(t):
    alerts = A.quota_alerts(A.quota_status(J.subscription_view(t.subscriptions, t.tiers)))
    return alerts.withColumn("exceeded", F.array_join("exceeded", ",")).withColumn(
        "approaching_limit", F.array_join("approaching_limit", ","))


@query("a6_usage_summary", """
SELECT org_id, upper(tier_name[1]) || tier_name[2:] AS tier_display_name,
  greatest(CAST(0 AS BIGINT), CAST(floor(epoch(current_period_end - TIMESTAMP '2024-01-15 12:00:00') / 86400) AS BIGINT)) AS days_remaining,
  tokens_used_this_period, greatest(0, monthly_token_limit - tokens_used_this_period) AS tokens_remaining,
  """ + half_up("tokens_used_this_period::DOUBLE / monthly_token_limit * 100", 2) + """ AS tokens_percentage,
  """ + half_up("llamaparse_pages_used::DOUBLE / monthly_llamaparse_pages_limit * 100", 2) + """ AS llamaparse_pages_percentage,
  """ + half_up("file_search_queries_used::DOUBLE / monthly_file_search_queries_limit * 100", 2) + """ AS file_search_queries_percentage,
  """ + half_up("storage_used_bytes::DOUBLE / storage_limit_bytes * 100", 2) + """ AS storage_bytes_percentage,
  storage_used_bytes / 1073741824.0::DOUBLE AS storage_used_gb,
  storage_limit_bytes / 1073741824.0::DOUBLE AS storage_limit_gb
FROM $subs_view""")
def usage_summary(t):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    row, _ = A.usage_summary(J.subscription_view(t.subscriptions, t.tiers), t.token_usage, at)
    return row.select(
        "org_id", "tier_display_name", "days_remaining", "tokens_used_this_period", "tokens_remaining",
        "tokens_percentage", "llamaparse_pages_percentage", "file_search_queries_percentage",
        "storage_bytes_percentage", "storage_used_gb", "storage_limit_gb")


@query("a6_usage_summary_features", """
SELECT org_id, name, CAST(tokens_used AS BIGINT) AS tokens_used, CAST(cost_usd AS DOUBLE) AS cost_usd,
       CASE WHEN SUM(tokens_used) OVER w > 0
            THEN """ + half_up("tokens_used::DOUBLE / SUM(tokens_used) OVER w ::DOUBLE * 100", 2) + """ ELSE 0.0::DOUBLE END AS percentage
FROM (SELECT u.org_id, feature AS name, SUM(total_tokens) AS tokens_used, SUM(total_cost_usd) AS cost_usd
      FROM $token_usage u JOIN $subscriptions s ON u.org_id = s.org_id
       AND u.created_at BETWEEN s.current_period_start AND s.current_period_end GROUP BY 1, 2)
WINDOW w AS (PARTITION BY org_id)""")
def usage_summary_features(t):
    _, features = A.usage_summary(J.subscription_view(t.subscriptions, t.tiers), t.token_usage, now())
    return as_api(features)


@query("a9_tier_census", """
SELECT t.tier, COUNT(s.org_id) AS n FROM $tiers t LEFT JOIN $subscriptions s ON s.tier = t.tier GROUP BY t.tier""")
def tier_census(t):
    return A.tier_census(t.subscriptions, t.tiers)


@query("a21_merge_usage", """
SELECT org_id, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS cached_tokens,
       arg_min(feature, request_id) FILTER (feature <> 'error') AS provider,
       arg_min(model, request_id) AS model
FROM $token_usage GROUP BY org_id""")
def merge_usage(t):
    calls = t.token_usage.withColumn("provider", F.nullif("feature", F.lit("error")))
    return A.merge_usage(calls, ["org_id"], "request_id")


@query("a23_bulk_precheck", """
SELECT f.org_id, f.folder, f.document_count, f.document_count AS pages_needed, f.document_count * 2000 AS tokens_needed,
  s.llamaparse_pages_used + f.document_count <= s.monthly_llamaparse_pages_limit AS pages_allowed,
  s.tokens_used_this_period + f.document_count * 2000 <= s.monthly_token_limit AS tokens_allowed,
  s.llamaparse_pages_used + f.document_count <= s.monthly_llamaparse_pages_limit
   AND s.tokens_used_this_period + f.document_count * 2000 <= s.monthly_token_limit AS allowed
FROM (SELECT o_custkey AS org_id, o_orderpriority AS folder, COUNT(*) AS document_count FROM orders GROUP BY 1, 2) f
JOIN $subs_view s ON f.org_id = s.org_id""")
def bulk_precheck(t):
    folders = t.orders.groupBy(F.col("o_custkey").alias("org_id"), F.col("o_orderpriority").alias("folder")).agg(
        F.count(F.lit(1)).alias("document_count"))
    return A.bulk_precheck(folders, J.subscription_view(t.subscriptions, t.tiers))


@query("j1_subscription_limits", """
SELECT org_id, tier_name, status, monthly_token_limit, monthly_llamaparse_pages_limit,
       monthly_file_search_queries_limit, storage_limit_bytes FROM $subs_view""")
def subscription_limits(t):
    return J.subscription_view(t.subscriptions, t.tiers).select(
        "org_id", "tier_name", "status", "monthly_token_limit", "monthly_llamaparse_pages_limit",
        "monthly_file_search_queries_limit", "storage_limit_bytes")


@query("j2_unsubscribed", """
SELECT org_id FROM $orgs o WHERE NOT EXISTS (SELECT 1 FROM $subscriptions s WHERE s.org_id = o.org_id)""")
def unsubscribed(t):
    return J.unsubscribed(t.orgs, t.subscriptions)


@query("j3_assign_default_tier", """
SELECT org_id, tier, status, current_period_start, current_period_end, tokens_used_this_period FROM $subscriptions
UNION ALL
SELECT org_id, 'free', 'active', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', CAST(0 AS BIGINT)
FROM $orgs o WHERE NOT EXISTS (SELECT 1 FROM $subscriptions s WHERE s.org_id = o.org_id)""")
def assign_default_tier(t):
    return J.assign_default_tier(t.orgs, t.subscriptions, t.tiers, now()).select(
        "org_id", "tier", "status", "current_period_start", "current_period_end", "tokens_used_this_period")


@query("j8_cost_exact", """
SELECT request_id, model, CAST(input_cost_usd AS DOUBLE) AS input_cost_usd,
       CAST(output_cost_usd AS DOUBLE) AS output_cost_usd, CAST(total_cost_usd AS DOUBLE) AS total_cost_usd
FROM $token_usage""")
def cost_exact(t):
    return as_api(t.token_usage.select(
        "request_id", "model", "input_cost_usd", "output_cost_usd", "total_cost_usd"))


FUZZY_VALUES = """(VALUES (0, 'gpt-5.1-codex-mini', 0.03, 0.06), (1, 'gpt-5-mini', 0.25, 2.00), (2, 'gpt-5-nano', 0.05, 0.40),
  (3, 'gpt-5.2', 1.75, 14.00), (4, 'gpt-4o', 2.50, 10.00), (5, 'gemini-3-flash-preview', 0.075, 0.30),
  (6, 'gemini-2.5-flash', 0.075, 0.30), (7, 'gemini-2.5-pro', 1.25, 5.00), (8, 'gemini-1.5-flash', 0.075, 0.30),
  (9, 'gemini-1.5-pro', 1.25, 5.00)) AS p(pos, known, pin, pout)"""


@query("j8_cost_fuzzy", f"""
WITH models AS (SELECT DISTINCT model FROM $token_usage),
ranked AS (
  SELECT m.model, p.pin, p.pout FROM models m JOIN {FUZZY_VALUES}
    ON contains(lower(m.model), lower(p.known)) OR contains(lower(p.known), lower(m.model))
  QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY m.model <> p.known, p.pos) = 1)
SELECT u.request_id, u.model,
  {half_up("""u.input_tokens * COALESCE(r.pin, 0.10)::DOUBLE / 1000000.0::DOUBLE
      + u.output_tokens * COALESCE(r.pout, 0.30)::DOUBLE / 1000000.0::DOUBLE""", 8)} AS total_cost_usd
FROM $token_usage u LEFT JOIN ranked r ON u.model = r.model""")
def cost_fuzzy(t):
    usage = t.token_usage.select("request_id", "model", "input_tokens", "output_tokens")
    priced = J.attach_cost(usage, J.fuzzy_prices(t.spark), "fuzzy")
    return priced.select("request_id", "model", F.round("total_cost_usd", 8).alias("total_cost_usd"))


@query("m9_roll_periods", """
SELECT org_id, storage_used_bytes,
  CASE WHEN e THEN 0 ELSE tokens_used_this_period END AS tokens_used_this_period,
  CASE WHEN e THEN 0 ELSE llamaparse_pages_used END AS llamaparse_pages_used,
  CASE WHEN e THEN 0 ELSE file_search_queries_used END AS file_search_queries_used,
  CASE WHEN e THEN TIMESTAMP '2024-01-01' ELSE current_period_start END AS current_period_start,
  CASE WHEN e THEN TIMESTAMP '2024-02-01' ELSE current_period_end END AS current_period_end
FROM (SELECT *, current_period_end < TIMESTAMP '2024-01-31' AS e FROM $subscriptions)""")
def roll_periods(t):
    return M.roll_periods(t.subscriptions, now()).select(
        "org_id", "storage_used_bytes", "tokens_used_this_period", "llamaparse_pages_used",
        "file_search_queries_used", "current_period_start", "current_period_end")


@query("m10_rebuild_counters", """
SELECT s.org_id,
  CAST(COALESCE((SELECT SUM(total_tokens) FROM $token_usage u WHERE u.org_id = s.org_id
     AND u.created_at >= s.current_period_start AND u.created_at < s.current_period_end), 0) AS BIGINT) AS tokens_used_this_period,
  CAST(COALESCE((SELECT SUM(amount) FROM $resource_usage u WHERE u.org_id = s.org_id AND u.resource_type = 'llamaparse_pages'
     AND u.created_at >= s.current_period_start AND u.created_at < s.current_period_end), 0) AS BIGINT) AS llamaparse_pages_used,
  CAST(COALESCE((SELECT SUM(amount) FROM $resource_usage u WHERE u.org_id = s.org_id AND u.resource_type = 'file_search_queries'
     AND u.created_at >= s.current_period_start AND u.created_at < s.current_period_end), 0) AS BIGINT) AS file_search_queries_used
FROM $subscriptions s""")
def rebuild_counters(t):
    return M.rebuild_counters(t.subscriptions, t.token_usage, t.resource_usage).select(
        "org_id", "tokens_used_this_period", "llamaparse_pages_used", "file_search_queries_used")


@query("u3_dedupe_requests", """
SELECT r.request_key, arg_min(r.event_id, r.ts) AS event_id, min(r.ts) AS created_at
FROM (SELECT *, user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS request_key FROM events) r
WHERE request_key % 10 <> 3 AND request_key % 10 <> 7 GROUP BY request_key
UNION ALL
SELECT NULL, event_id, ts FROM (SELECT *, user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS request_key FROM events)
WHERE request_key % 10 = 3""".replace("'$.k'", "'$' || '.k'"))
def dedupe_requests(t):
    """Repeats by user and payload; keys ending in 3 have no id, in 7 are known already."""
    raw = F.col("user_id") * 1000 + F.get_json_object("props", "$.k").cast("long")
    calls = t.events.select(
        F.when(raw % 10 != 3, raw).alias("request_key"), "event_id", F.col("ts").alias("created_at"))
    known = calls.filter(F.col("request_key") % 10 == 7).select("request_key").distinct()
    return M.dedupe_requests(calls, known, "request_key", ["created_at", "event_id"])
