"""Test tables seen as the engine's tables, in Spark and as oracle SQL.

Each role is a DataFrame on the parquet tables and a sub-select of the same
rows for the checking engine, so a query and its oracle start from one
definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import constants as K

NOW = "2024-01-31 00:00:00"
TEST_TOKEN_DIVISOR = 10_000
MODELS = ["gpt-4o", "gpt-5-mini", "gpt-5.2", "gemini-2.5-pro", "gpt-5-mini-2025-08-07", "other-model"]


class Tables:
    """Parquet tables of one folder, plus the roles derived from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def token_usage(self) -> DataFrame:
        from ledgerlens.operators.joins import attach_cost, exact_prices

        total = F.floor("value").cast("long")
        models = F.array(*[F.lit(m) for m in MODELS])
        usage = self.events.select(
            F.col("user_id").alias("org_id"), F.col("event_id").alias("request_id"),
            F.col("event_type").alias("feature"), F.lit("openai").alias("provider"),
            F.get(models, (F.col("user_id") % len(MODELS)).cast("int")).alias("model"),
            F.floor(total / 2).alias("input_tokens"), (total - F.floor(total / 2)).alias("output_tokens"),
            total.alias("total_tokens"), F.lit(0).cast("long").alias("cached_tokens"),
            F.col("ts").alias("created_at"),
        )
        return attach_cost(usage, exact_prices(self.spark))

    @cached_property
    def resource_usage(self) -> DataFrame:
        kind = (
            F.when(F.col("event_type") == "purchase", "llamaparse_pages")
            .when(F.col("event_type") == "click", "file_search_queries")
        )
        return self.events.filter(F.col("event_type").isin("purchase", "click")).select(
            F.col("user_id").alias("org_id"), kind.alias("resource_type"),
            F.lit(1).cast("long").alias("amount"), F.col("event_id").alias("request_id"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def tiers(self) -> DataFrame:
        rows = [
            (t, tokens // TEST_TOKEN_DIVISOR, pages, searches, gb, order, True)
            for t, tokens, pages, searches, gb, order in K.TIERS
        ]
        raw = self.spark.createDataFrame(
            rows, "tier string, monthly_token_limit long, monthly_llamaparse_pages long, "
            "monthly_file_search_queries long, storage_gb_limit string, sort_order int, is_active boolean",
        )
        return raw.withColumn("storage_gb_limit", F.col("storage_gb_limit").cast("decimal(10,2)"))

    @cached_property
    def orgs(self) -> DataFrame:
        return self.customer.select(F.col("c_custkey").alias("org_id"))

    @cached_property
    def subscriptions(self) -> DataFrame:
        """Every customer outside MACHINERY is subscribed."""
        segment = F.col("c_mktsegment")
        tier = F.when(segment == "AUTOMOBILE", "enterprise").when(segment == "BUILDING", "pro").otherwise("free")
        used = F.greatest(F.lit(0).cast("long"), F.floor("c_acctbal").cast("long"))
        return self.customer.filter(segment != "MACHINERY").select(
            F.col("c_custkey").alias("org_id"), tier.alias("tier"), F.lit("active").alias("status"),
            F.lit("monthly").alias("billing_cycle"),
            F.when(F.col("c_custkey") % 3 == 0, F.lit("2023-12-01 00:00:00"))
            .otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("current_period_start"),
            F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-01 00:00:00"))
            .otherwise(F.lit("2024-02-01 00:00:00")).cast("timestamp_ntz").alias("current_period_end"),
            used.alias("tokens_used_this_period"),
            (used % 60).alias("llamaparse_pages_used"),
            (used % 110).alias("file_search_queries_used"),
            (used * 150_000).alias("storage_used_bytes"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Orders as processing jobs."""
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
        )
        return self.orders.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"),
            F.concat(F.lit("doc-"), F.col("o_custkey") % 100).alias("file_name"),
            F.element_at(F.split("o_orderpriority", "-"), 2).alias("model"),
            status.alias("status"), F.col("o_orderdate").alias("started_at"),
            (F.col("o_orderkey") % 4 == 0).alias("cached"),
            F.floor("o_totalprice").cast("long").alias("duration_ms"),
        )

    @cached_property
    def generations(self) -> DataFrame:
        """Events as generation results."""
        kind = (
            F.when(F.col("event_type") == "view", "summary").when(F.col("event_type") == "click", "faqs")
            .when(F.col("event_type") == "signup", "questions").when(F.col("event_type") == "purchase", "all")
            .otherwise("other")
        )
        return self.events.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("org_id"),
            F.concat(F.lit("doc-"), F.get_json_object("props", "$.k")).alias("document_name"),
            kind.alias("generation_type"), F.lit("gpt-5-mini").alias("model"),
            F.sha2(F.get_json_object("props", "$.k"), 256).alias("document_hash"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def bulk_docs(self) -> DataFrame:
        """Orders as documents of bulk jobs (one job per customer)."""
        states = F.array(*[F.lit(s) for s in (
            "pending", "parsing", "indexed", "completed", "completed", "failed", "skipped")])
        key = F.col("o_orderkey")
        return self.orders.select(
            key.alias("id"), F.col("o_custkey").alias("bulk_job_id"),
            F.get(states, (key % 7).cast("int")).alias("status"),
            (key % 5).cast("int").alias("retry_count"),
            (key % 50).cast("int").alias("parse_time_ms"),
            F.when(F.col("o_orderstatus") == "O", (key % 20).cast("int")).alias("index_time_ms"),
            (key % 90).cast("int").alias("generation_time_ms"),
            F.floor("o_totalprice").cast("long").alias("token_usage"),
            F.lit(1).cast("long").alias("llamaparse_pages"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def bulk_jobs(self) -> DataFrame:
        states = F.array(*[F.lit(s) for s in ("pending", "processing", "completed", "failed")])
        return self.part.select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("org_id"),
            F.get(states, (F.col("p_partkey") % 4).cast("int")).alias("status"),
            F.lit(2).cast("long").alias("skipped_count"), F.lit(1).cast("long").alias("failed_count"),
        )

    @cached_property
    def uploads(self) -> DataFrame:
        """Events as upload notices: 20 folders per organisation slice, file by props."""
        return self.events.select(
            F.col("event_id"), F.col("ts"), F.lit("org").alias("org_id"),
            (F.col("user_id") % 20).alias("folder"),
            F.concat(F.get_json_object("props", "$.k"), F.lit(".pdf")).alias("file"),
        )

    @cached_property
    def answer_cache(self) -> DataFrame:
        entry = self.embeddings.filter(F.col("vec_id") % 5 != 0)
        return entry.select(
            F.col("vec_id").alias("id"), F.col("label").alias("org_id"),
            F.when(F.col("vec_id") % 3 == 0, "folder").alias("folder_filter"),
            F.lit(None).cast("string").alias("file_filter"), "embedding",
            F.concat(F.lit("answer "), F.col("vec_id")).alias("answer"),
            (F.col("vec_id") % 7).alias("hit_count"),
            F.timestamp_add("HOUR", -F.col("vec_id"), F.lit(NOW).cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def answer_queries(self) -> DataFrame:
        return self.embeddings.filter(F.col("vec_id") % 5 == 0).select(
            F.col("vec_id").alias("query_id"), F.col("label").alias("org_id"),
            F.when(F.col("vec_id") % 3 == 0, "folder").alias("folder_filter"),
            F.lit(None).cast("string").alias("file_filter"), "embedding",
        )


def _price_case(position: int) -> str:
    whens = " ".join(f"WHEN model = '{m}' THEN {p[position]}" for m, p in K.TOKEN_PRICES.items())
    return f"CAST(CASE {whens} ELSE {K.TOKEN_PRICE_DEFAULT[position]} END AS DECIMAL(12,12))"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL: dict[str, str] = {}
SQL["token_usage"] = f"""(
  SELECT *, input_cost_usd + output_cost_usd AS total_cost_usd FROM (
    SELECT *, CAST(input_tokens AS DECIMAL(20,0)) * {_price_case(0)} AS input_cost_usd,
           CAST(output_tokens AS DECIMAL(20,0)) * {_price_case(1)} AS output_cost_usd
    FROM (SELECT user_id AS org_id, event_id AS request_id, event_type AS feature,
                 ({_list(MODELS)})[CAST(user_id % {len(MODELS)} AS INT) + 1] AS model,
                 CAST(floor(value) AS BIGINT) // 2 AS input_tokens,
                 CAST(floor(value) AS BIGINT) - CAST(floor(value) AS BIGINT) // 2 AS output_tokens,
                 CAST(floor(value) AS BIGINT) AS total_tokens, ts AS created_at
          FROM events)))"""
SQL["resource_usage"] = """(
  SELECT user_id AS org_id,
         CASE event_type WHEN 'purchase' THEN 'llamaparse_pages' ELSE 'file_search_queries' END AS resource_type,
         CAST(1 AS BIGINT) AS amount, event_id AS request_id, ts AS created_at
  FROM events WHERE event_type IN ('purchase', 'click'))"""
SQL["tiers"] = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', CAST({tok // TEST_TOKEN_DIVISOR} AS BIGINT), CAST({pg} AS BIGINT), CAST({fs} AS BIGINT), "
    f"CAST({gb} AS DECIMAL(10,2)), {o}, TRUE)"
    for t, tok, pg, fs, gb, o in K.TIERS
) + ") AS t(tier, monthly_token_limit, monthly_llamaparse_pages, monthly_file_search_queries, " \
    "storage_gb_limit, sort_order, is_active))"
SQL["orgs"] = "(SELECT c_custkey AS org_id FROM customer)"
SQL["subscriptions"] = """(
  SELECT *, used AS tokens_used_this_period, used % 60 AS llamaparse_pages_used,
         used % 110 AS file_search_queries_used, used * 150000 AS storage_used_bytes
  FROM (SELECT c_custkey AS org_id,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'enterprise' WHEN 'BUILDING' THEN 'pro' ELSE 'free' END AS tier,
               'active' AS status, 'monthly' AS billing_cycle,
               CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2023-12-01' ELSE TIMESTAMP '2024-01-01' END AS current_period_start,
               CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS current_period_end,
               greatest(CAST(0 AS BIGINT), CAST(floor(c_acctbal) AS BIGINT)) AS used
        FROM customer WHERE c_mktsegment <> 'MACHINERY'))"""
SQL["subs_view"] = f"""(
  SELECT s.*, s.tier AS tier_name, t.monthly_token_limit,
         t.monthly_llamaparse_pages AS monthly_llamaparse_pages_limit,
         t.monthly_file_search_queries AS monthly_file_search_queries_limit,
         CAST(t.storage_gb_limit * 1073741824 AS BIGINT) AS storage_limit_bytes
  FROM {SQL['subscriptions']} s JOIN {SQL['tiers']} t ON s.tier = t.tier)"""
SQL["jobs"] = """(
  SELECT o_orderkey AS id, o_custkey AS org_id, 'doc-' || (o_custkey % 100) AS file_name,
         split_part(o_orderpriority, '-', 2) AS model,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
         o_orderdate AS started_at, o_orderkey % 4 = 0 AS cached,
         CAST(floor(o_totalprice) AS BIGINT) AS duration_ms FROM orders)"""
SQL["generations"] = """(
  SELECT event_id AS id, user_id AS org_id, 'doc-' || json_extract_string(props, '$' || '.k') AS document_name,
         CASE event_type WHEN 'view' THEN 'summary' WHEN 'click' THEN 'faqs' WHEN 'signup' THEN 'questions'
              WHEN 'purchase' THEN 'all' ELSE 'other' END AS generation_type,
         'gpt-5-mini' AS model, sha256(json_extract_string(props, '$' || '.k')) AS document_hash,
         ts AS created_at FROM events)"""
SQL["bulk_docs"] = """(
  SELECT o_orderkey AS id, o_custkey AS bulk_job_id,
         (['pending', 'parsing', 'indexed', 'completed', 'completed', 'failed', 'skipped'])[CAST(o_orderkey % 7 AS INT) + 1] AS status,
         CAST(o_orderkey % 5 AS INT) AS retry_count, CAST(o_orderkey % 50 AS INT) AS parse_time_ms,
         CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 20 AS INT) END AS index_time_ms,
         CAST(o_orderkey % 90 AS INT) AS generation_time_ms,
         CAST(floor(o_totalprice) AS BIGINT) AS token_usage, CAST(1 AS BIGINT) AS llamaparse_pages,
         o_orderdate AS created_at FROM orders)"""
SQL["bulk_jobs"] = """(
  SELECT p_partkey AS id, p_brand AS org_id,
         (['pending', 'processing', 'completed', 'failed'])[CAST(p_partkey % 4 AS INT) + 1] AS status,
         CAST(2 AS BIGINT) AS skipped_count, CAST(1 AS BIGINT) AS failed_count FROM part)"""
SQL["uploads"] = """(
  SELECT event_id, ts, 'org' AS org_id, user_id % 20 AS folder,
         json_extract_string(props, '$' || '.k') || '.pdf' AS file FROM events)"""
SQL["answer_cache"] = f"""(
  SELECT vec_id AS id, label AS org_id, CASE WHEN vec_id % 3 = 0 THEN 'folder' END AS folder_filter,
         CAST(NULL AS VARCHAR) AS file_filter, embedding, 'answer ' || vec_id AS answer,
         vec_id % 7 AS hit_count, TIMESTAMP '{NOW}' - to_hours(CAST(vec_id AS INT)) AS created_at
  FROM embeddings WHERE vec_id % 5 <> 0)"""
SQL["answer_queries"] = """(
  SELECT vec_id AS query_id, label AS org_id, CASE WHEN vec_id % 3 = 0 THEN 'folder' END AS folder_filter,
         CAST(NULL AS VARCHAR) AS file_filter, embedding FROM embeddings WHERE vec_id % 5 = 0)"""


def half_up(expr: str, places: int) -> str:
    """Oracle text rounding the printed value half up, as Spark's ``round`` does."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38,24)), {places}) AS DOUBLE)"
