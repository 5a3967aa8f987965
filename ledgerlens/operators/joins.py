"""Joins between subscriptions, registries, prices, records and caches.

Physical joins are left to Catalyst and AQE (broadcast under the size
threshold, skew split above it).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.functions import constants as K
from ledgerlens.functions.skew import epoch_seconds, ranked
from ledgerlens.operators.ordering import first_n, latest_per_key

GB = 1024 ** 3


def subscription_view(subs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Subscriptions with the limits of their tier; storage GB become bytes."""
    limits = tiers.select(
        F.col("tier").alias("tier_name"),
        "monthly_token_limit",
        F.col("monthly_llamaparse_pages").alias("monthly_llamaparse_pages_limit"),
        F.col("monthly_file_search_queries").alias("monthly_file_search_queries_limit"),
        (F.col("storage_gb_limit") * F.lit(GB)).cast("long").alias("storage_limit_bytes"),
    )
    return subs.withColumnRenamed("tier", "tier_name").join(limits, "tier_name")


def unsubscribed(orgs: DataFrame, subs: DataFrame, key: str = "org_id") -> DataFrame:
    """Organisations without a subscription."""
    return orgs.join(subs.select(key), key, "left_anti")


def month_period(now: Column) -> tuple[Column, Column]:
    """First instant of the month of ``now`` and of the next one."""
    start = F.trunc(now.cast("date"), "month")
    return start.cast("timestamp_ntz"), F.add_months(start, 1).cast("timestamp_ntz")


def new_subscriptions(orgs: DataFrame, tier: str, now: Column) -> DataFrame:
    start, end = month_period(now)
    return orgs.select(
        "org_id",
        F.lit(tier).alias("tier"),
        F.lit("active").alias("status"),
        F.lit("monthly").alias("billing_cycle"),
        start.alias("current_period_start"),
        end.alias("current_period_end"),
        *[F.lit(0).cast("long").alias(c) for c in USAGE_COUNTERS],
    )


USAGE_COUNTERS = [
    "tokens_used_this_period", "llamaparse_pages_used",
    "file_search_queries_used", "storage_used_bytes",
]


def assign_default_tier(
    orgs: DataFrame, subs: DataFrame, tiers: DataFrame, now: Column, tier: str = "free"
) -> DataFrame:
    """Subscriptions plus a fresh one for every organisation lacking it.

    Nothing is added when the tier is missing or inactive.
    """
    active = tiers.filter((F.col("tier") == tier) & F.col("is_active")).agg(F.count(F.lit(1)))
    fresh = new_subscriptions(unsubscribed(orgs, subs).select("org_id").distinct(), tier, now)
    fresh = fresh.filter(active.scalar() > 0)
    return subs.unionByName(fresh, allowMissingColumns=True)


def line_item_rows(header: DataFrame, items: DataFrame, key: str, parent: str, line: str, fields: Sequence[str]) -> DataFrame:
    """Each record with its items, one row per line: (header columns, line, item), the same shape at every size.

    A record without items has one row with a null line and item. Rows are not
    sorted across the table; ``line`` orders a record.
    """
    rows = items.select(F.col(parent).alias(key), F.col(line), F.struct(*fields).alias("item"))
    return header.join(rows, key, "left")


def nest_line_items(
    header: DataFrame, items: DataFrame, key: str, parent: str, line: str,
    fields: Sequence[str], items_per_row: int,
) -> DataFrame:
    """Each record with its items ordered by line number, in parts of ``items_per_row``; empty without items.

    Every row has a ``part`` (0, 1, ...), so no group or row grows beyond the
    part size the caller asks for; :func:`line_item_rows` needs none. Line numbers
    run from 1 within a record.
    """
    part = F.floor((F.col(line) - 1) / F.lit(items_per_row)).cast("int")
    nested = (
        items.select(F.col(parent).alias(key), part.alias("part"), F.struct(line, *fields).alias("item"))
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list("item")).alias("line_items"))
    )
    joined = header.join(nested, key, "left")
    element = nested.schema["line_items"].dataType.simpleString()
    return joined.withColumn("part", F.coalesce("part", F.lit(0))).withColumn(
        "line_items", F.coalesce("line_items", F.array().cast(element))
    )


def document_dossier(
    docs: DataFrame, jobs: DataFrame, audit: DataFrame, *, doc_key: str,
    job_key: str, job_ts: str, job_fields: Sequence[str],
    audit_key: str, audit_ts: str, audit_fields: Sequence[str],
    trail: int, jobs_per_row: int,
) -> DataFrame:
    """Documents with all their jobs and their newest audit events, newest first.

    The trail holds the newest ``trail`` events, ``audit_total`` counts all. Jobs are complete: a document
    with more than ``jobs_per_row`` of them continues in further rows numbered
    by ``part``, so no group or row grows without bound. The first field of each
    list must make its order total together with the time.
    """
    def newest_first(df, ts, fields):
        entry = F.struct(F.col(ts), *[F.col(f) for f in fields])
        return F.reverse(F.array_sort(F.collect_list(entry)))

    hour = -F.floor(epoch_seconds(F.col(job_ts)) / 3600)
    numbered = ranked(
        jobs, [job_key], [F.desc(job_ts), F.desc(job_fields[0])], hour, "_rank"
    ).withColumn("part", F.floor((F.col("_rank") - 1) / F.lit(jobs_per_row)).cast("int"))
    job_rows = numbered.groupBy(F.col(job_key).alias(doc_key), "part").agg(
        newest_first(numbered, job_ts, job_fields).alias("jobs")
    )
    recent = first_n(audit, [audit_key], [F.desc(audit_ts), F.desc(audit_fields[0])], trail)
    trail_rows = (
        recent.groupBy(F.col(audit_key).alias(doc_key))
        .agg(newest_first(recent, audit_ts, audit_fields).alias("audit_trail"))
        .withColumn("part", F.lit(0))
        .join(audit.groupBy(F.col(audit_key).alias(doc_key)).agg(F.count(F.lit(1)).alias("audit_total")), doc_key)
    )
    history = job_rows.join(trail_rows, [doc_key, "part"], "full_outer")
    return docs.join(history, doc_key, "left").withColumn("part", F.coalesce("part", F.lit(0)))


def enrich_listing(manifest: DataFrame, documents: DataFrame, path: str = "path") -> DataFrame:
    """File listing with registry status; unknown files count as uploaded."""
    known = documents.select(
        F.col("storage_path").alias(path), "status", "parsed_path", "parsed_at"
    )
    return (
        manifest.join(known, path, "left")
        .withColumn("status", F.coalesce("status", F.lit("uploaded")))
        .withColumn("is_parsed", F.col("status") == "parsed")
    )


def _money(value: str) -> Column:
    return F.lit(value).cast("decimal(12,12)")


def exact_prices(spark: SparkSession) -> DataFrame:
    """Per-token prices by exact model name; prices stay decimals of scale 12. The fixed list is small, so it carries a hint."""
    rows = [(m, i, o) for m, (i, o) in K.TOKEN_PRICES.items()]
    return F.broadcast(spark.createDataFrame(rows, "model string, input string, output string").select(
        "model", F.col("input").cast("decimal(12,12)").alias("input_price"),
        F.col("output").cast("decimal(12,12)").alias("output_price"),
    ))


def fuzzy_prices(spark: SparkSession) -> DataFrame:
    """USD per million tokens with the list position that breaks ties."""
    rows = [(n, m, i, o) for n, (m, (i, o)) in enumerate(K.MILLION_PRICES.items())]
    return spark.createDataFrame(
        rows, "position int, known string, input_million double, output_million double"
    )


def attach_cost(usage: DataFrame, prices: DataFrame, mode: str = "exact", model: str = "model") -> DataFrame:
    """Input, output and total cost of each usage row.

    ``exact`` looks the model up by name in a per-token table. ``fuzzy`` takes
    the exact name, else the first known name that contains the model or is
    contained in it. Both fall back to a default price.
    """
    if mode == "exact":
        priced = usage.join(prices.withColumnRenamed("model", model), model, "left")
        default_in, default_out = (_money(p) for p in K.TOKEN_PRICE_DEFAULT)
        tokens_in = F.col("input_tokens").cast("decimal(20,0)")
        tokens_out = F.col("output_tokens").cast("decimal(20,0)")
        return (
            priced.withColumn("input_cost_usd", tokens_in * F.coalesce("input_price", default_in))
            .withColumn("output_cost_usd", tokens_out * F.coalesce("output_price", default_out))
            .withColumn("total_cost_usd", F.col("input_cost_usd") + F.col("output_cost_usd"))
            .drop("input_price", "output_price")
        )
    if mode != "fuzzy":
        raise ValueError(f"unknown price mode {mode!r}")
    # the price list is one sorted array; each distinct model is looked up in it once
    known = prices.agg(F.array_sort(F.collect_list(F.struct("position", "known", "input_million", "output_million"))).alias("p"))
    lowered = F.lower(F.col(model))
    same = F.get(F.filter("_list", lambda p: p["known"] == F.col(model)), F.lit(0))
    near = F.get(F.filter("_list", lambda p: (F.col(model) != "") & (
        F.contains(lowered, F.lower(p["known"])) | F.contains(F.lower(p["known"]), lowered))), F.lit(0))
    found = usage.select(model).distinct().withColumn("_list", known.scalar()).select(model, F.coalesce(same, near).alias("_price"))
    usage = usage.join(found, model, "left")
    price_in = F.coalesce("_price.input_million", F.lit(K.MILLION_PRICE_DEFAULT[0]))
    price_out = F.coalesce("_price.output_million", F.lit(K.MILLION_PRICE_DEFAULT[1]))
    million = F.lit(1_000_000.0)
    return (
        usage.withColumn("input_cost_usd", F.col("input_tokens") * price_in / million)
        .withColumn("output_cost_usd", F.col("output_tokens") * price_out / million)
        .withColumn("total_cost_usd", F.col("input_cost_usd") + F.col("output_cost_usd"))
        .drop("_price")
    )


def match_registry(
    incoming: DataFrame, registry: DataFrame, *, org: str = "org_id", folder: str = "folder_id",
    name: str = "filename", key: str = "id", created: str = "created_at", fallback: bool = True,
) -> DataFrame:
    """Incoming rows with the id of the active registry row they stand for.

    First the same organisation, folder and name (a null folder matches
    nothing); else the same organisation and name; else null. Several hits
    resolve to the earliest, then the lowest id.
    """
    active = registry.filter(F.col("is_active"))
    rank = F.struct(F.col(created), F.col(key))
    exact = active.groupBy(org, folder, name).agg(F.min_by(key, rank).alias("exact_id"))
    out = incoming.join(exact, [org, folder, name], "left")
    if not fallback:
        return out.withColumn("matched_id", F.col("exact_id")).withColumn(
            "match_kind", F.when(F.col("exact_id").isNotNull(), "folder").otherwise("new")
        ).drop("exact_id")
    loose = active.groupBy(org, name).agg(F.min_by(key, rank).alias("loose_id"))
    out = out.join(loose, [org, name], "left")
    kind = (
        F.when(F.col("exact_id").isNotNull(), "folder")
        .when(F.col("loose_id").isNotNull(), "name").otherwise("new")
    )
    return (
        out.withColumn("match_kind", kind)
        .withColumn("matched_id", F.coalesce("exact_id", "loose_id"))
        .drop("exact_id", "loose_id")
    )


def reuse_lookup(
    requests: DataFrame, results: DataFrame, keys: Sequence[str], created: str, key: str,
    payload: Sequence[str],
) -> DataFrame:
    """Requests with the newest earlier result for the same keys and a ``cached`` flag."""
    newest = latest_per_key(results, keys, [created, key], [key, created, *payload])
    return requests.join(newest, list(keys), "left").withColumn("cached", F.col(key).isNotNull())


def ownership_split(
    requests: DataFrame, owners: DataFrame, request_key: str, owner_key: str,
    org: str = "org_id", owner_org: str = "owner_org",
) -> DataFrame:
    """Requests with ``verdict``: not_found, forbidden or ok (unowned rows pass)."""
    known = owners.select(
        F.col(owner_key).alias(request_key), F.col(owner_org), F.lit(True).alias("_found")
    )
    verdict = (
        F.when(F.col("_found").isNull(), "not_found")
        .when(F.col(owner_org).isNotNull() & (F.col(owner_org) != F.col(org)), "forbidden")
        .otherwise("ok")
    )
    return requests.join(known, request_key, "left").withColumn("verdict", verdict).drop("_found")

