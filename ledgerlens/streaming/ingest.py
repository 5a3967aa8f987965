"""Event ingestion with Structured Streaming.

Every writer stores a micro-batch under ``batch=<id>`` and overwrites that
folder on a retry, so a batch that is replayed after a lost executor or driver
leaves one copy. Readers see all batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.functions import constants as K
from ledgerlens.operators.filters import extension, file_name
from ledgerlens.operators.joins import attach_cost, exact_prices
from ledgerlens.operators.maintenance import DAY_COUNTERS, counters_from_days, daily_amounts, dedupe_requests, roll_periods
from ledgerlens.operators.ordering import first_n, latest_per_key
from ledgerlens.operators.textjobs import derive_audit_fields
from ledgerlens.streaming.known_ids import KnownIds

WATERMARK = "1 hour"


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
          mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Run ``handle`` on each micro-batch; by default over what is available now."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(handle).start()
    )


def write_batch(df: DataFrame, root: str, batch: int, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/batch={batch}")


def read_batches(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """All stored batches (``batch`` as a column), or those before one; none yet gives None."""
    try:
        df = spark.read.option("basePath", root).parquet(f"{root}/batch=*")
    except AnalysisException:
        return None
    return df if before is None else df.filter(F.col("batch") < before)


# --- usage events -----------------------------------------------------------

def shape_tokens(events: DataFrame) -> DataFrame:
    """Token events with defaults, totals and cost."""
    tokens = events.filter(F.col("event_type") == "token").select(
        "org_id", "request_id", F.coalesce("feature", F.lit("unknown")).alias("feature"), "provider",
        F.coalesce("model", F.lit("default")).alias("model"), "input_tokens", "output_tokens",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), "cached_tokens", "created_at",
    )
    return attach_cost(tokens, exact_prices(events.sparkSession))


def shape_resources(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "resource").select(
        "org_id", "request_id", F.coalesce("resource_type", F.lit("unknown")).alias("resource_type"), "amount", "created_at")


def ingest_usage(stream: DataFrame, out: str, checkpoint: str, delay: str = WATERMARK,
                 trigger: dict | None = None) -> StreamingQuery:
    """Usage events into ``token_usage``, ``resource_usage`` and ``late``.

    The first write of a request id wins, however long ago it was: stored ids are
    kept per table in :class:`KnownIds`, which a batch asks without reading history.
    Rows older than the watermark go to ``late``, none is dropped. The watermark is
    the newest event time of earlier batches minus ``delay``.
    """
    names = ("token_usage", "resource_usage")

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None if number == 0 else spark.read.parquet(f"{out}/progress/batch={number - 1}").first()[0]
        mark = None if newest is None else F.lit(newest) - F.expr(f"INTERVAL {delay}")
        late = F.lit(False) if mark is None else F.coalesce(F.col("created_at") < mark, F.lit(False))
        kind = batch.schema["request_id"].dataType.simpleString()
        rows = batch.persist()
        try:
            timely = rows.filter(~late)
            for name, shaped in zip(names, (shape_tokens(timely), shape_resources(timely))):
                known = KnownIds(spark, f"{out}/known/{name}", kind)
                known.fold(number)
                seen = known.before(number).withColumnRenamed("id", "request_id")
                fresh = dedupe_requests(shaped, seen, "request_id", ["created_at"])
                # a day is written by as many tasks as its size asks for
                dated = fresh.withColumn("day", F.to_date("created_at")).hint("rebalance", "day")
                write_batch(dated, f"{out}/{name}", number, ["day"])
                written = spark.read.schema(dated.schema).parquet(f"{out}/{name}/batch={number}")
                known.add(written.select(F.col("request_id").alias("id")), number)
            write_batch(rows.filter(late), f"{out}/late", number)
            latest = F.max("created_at") if newest is None else F.greatest(F.max("created_at"), F.lit(newest))
            write_batch(rows.agg(latest.alias("newest")), f"{out}/progress", number)
        finally:
            rows.unpersist()

    return start(stream, handle, checkpoint, trigger=trigger)


# --- audit events -----------------------------------------------------------

def shape_generations(events: DataFrame) -> DataFrame:
    def detail(name: str, default: str) -> Column:
        return F.coalesce(F.get_json_object("details", f"$.{name}"), F.lit(default)).alias(name)

    return events.filter(F.col("event_type") == "generation_save").select(
        "event_id", "org_id", F.col("file_name").alias("document_name"), detail("source_path", ""), detail("generation_type", "all"),
        detail("content", "{}"), detail("options", "{}"), detail("model", "unknown"),
        F.coalesce(F.get_json_object("details", "$.processing_time_ms").try_cast("bigint"), F.lit(0)).alias("processing_time_ms"),
        "document_hash", "created_at")


def shape_audit(events: DataFrame) -> DataFrame:
    """Audit rows of other events; those without an organisation are left out."""
    others = F.coalesce(F.col("event_type") != "generation_save", F.lit(True))
    return derive_audit_fields(events.filter(others & F.col("org_id").isNotNull()))


def ingest_audit(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Audit events into ``generations`` and ``audit_log``."""
    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            write_batch(shape_generations(rows), f"{out}/generations", number)
            write_batch(shape_audit(rows), f"{out}/audit_log", number)
        finally:
            rows.unpersist()

    return start(stream, handle, checkpoint, trigger=trigger)


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; wall-clock ones are taken in the session zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def set_late_aside(stream: DataFrame, ts: str, out: str, checkpoint: str, delay: str = WATERMARK,
                   trigger: dict | None = None) -> StreamingQuery:
    """Rows into ``timely`` and ``late``, for streams whose watermark would drop the late ones without a trace.

    A row is late if it is more than ``delay`` older than the newest row of
    earlier micro-batches; that time is kept in a one-row table per batch. A
    stream over ``timely`` with the same or a longer delay drops nothing.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = None if number == 0 else spark.read.parquet(f"{out}/progress/batch={number - 1}").first()[0]
        rows = batch.persist()
        try:
            late = F.lit(False) if newest is None else F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {delay}"), F.lit(False))
            write_batch(rows.filter(~late), f"{out}/timely", number)
            write_batch(rows.filter(late), f"{out}/late", number)
            latest = F.max(ts) if newest is None else F.greatest(F.max(ts), F.lit(newest))
            write_batch(rows.agg(latest.alias("newest")), f"{out}/progress", number)
        finally:
            rows.unpersist()

    return start(stream, handle, checkpoint, trigger=trigger)


# --- running aggregates -----------------------------------------------------

def live_counters(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """Tokens and requests per organisation and period."""
    return (
        event_time(rows, "created_at").groupBy("org_id", F.window("created_at", window).alias("w"))
        .agg(F.sum("total_tokens").alias("total_tokens"), F.count(F.lit(1)).alias("total_requests"))
        .select("org_id", F.col("w.start").alias("period_start"), "total_tokens", "total_requests")
    )


def count_usage(stream: DataFrame, out: str, checkpoint: str, window: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Partial counters of each micro-batch.

    A row counts in its own period however late it comes, so a new period opens
    by itself and no watermark drops anything; no state is kept.
    """
    return start(stream, lambda df, n: write_batch(live_counters(df, window), out, n), checkpoint, trigger=trigger)


def read_counters(spark: SparkSession, out: str) -> DataFrame:
    """Counters so far: the sums of all batches."""
    return read_batches(spark, out).groupBy("org_id", "period_start").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("total_requests").alias("total_requests"))


def _slot(out: str, name: str, batch: int) -> str:
    return f"{out}/{name}/slot={batch % 2}"


def count_periods(stream: DataFrame, subs: DataFrame, out: str, checkpoint: str,
                  changes: Callable[[SparkSession], DataFrame] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Counters of every organisation's current billing period, kept up to date by a stream of usage.

    ``stream`` has org_id, created_at, total_tokens, resource_type and amount; a row
    without a resource type is a token record. Each micro-batch joins the days of
    usage with the periods they fall into. A period that the newest usage time has
    passed restarts as :func:`maintenance.roll_periods` says; days before the current
    period leave the state for ``closed``, so the state is the days of open periods.
    ``changes`` gives new or altered subscriptions; what it gave is stored per batch,
    so a repeated batch sees the same. State and subscriptions take two slots in
    turn. Late rows count in the period they fall into, if it is the current one,
    and go to ``closed`` otherwise; organisations without a subscription keep their
    days until they get one.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        days = daily_amounts(batch.filter(F.col("resource_type").isNull()), batch.filter(F.col("resource_type").isNotNull()))
        latest = batch.agg(F.max("created_at").alias("newest"))
        prior = subs
        if number:
            prior = spark.read.parquet(_slot(out, "subscriptions", number - 1)).drop("batch", "newest")
            days = days.unionByName(spark.read.parquet(_slot(out, "days", number - 1)).drop("batch"))
            before = spark.read.parquet(_slot(out, "progress", number - 1)).select("newest")
            latest = latest.union(before).agg(F.max("newest").alias("newest"))
        write(latest, "progress", number)
        newest = spark.read.parquet(_slot(out, "progress", number)).first()["newest"]
        if changes is not None:
            write_once(changes(spark).select(*prior.columns), f"{out}/changes/batch={number}")
            prior = upsert_rows(prior, spark.read.parquet(f"{out}/changes/batch={number}"), "org_id")
        rolled = prior if newest is None else roll_periods(prior, F.lit(newest))
        summed = days.groupBy("org_id", "day").agg(*[F.sum(c).alias(c) for c in DAY_COUNTERS])
        starts = rolled.select("org_id", F.to_date("current_period_start").alias("_from"))
        placed = summed.join(starts, "org_id", "left").withColumn("_over", F.coalesce(F.col("day") < F.col("_from"), F.lit(False)))
        write_batch(placed.filter("_over").drop("_over", "_from"), f"{out}/closed", number)
        write(placed.filter("not _over").drop("_over", "_from"), "days", number)
        write(counters_from_days(rolled, spark.read.parquet(_slot(out, "days", number)).drop("batch")), "subscriptions", number)

    def write(df: DataFrame, name: str, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(_slot(out, name, number))

    return start(stream, handle, checkpoint, trigger=trigger)


def write_once(df: DataFrame, path: str) -> None:
    """Write a folder unless a finished one is there; a repeated micro-batch finds what the first one saw."""
    try:
        df.write.mode("ignore").parquet(path)
        df.sparkSession.read.parquet(path)
    except AnalysisException:  # what an interrupted write left has no schema
        df.write.mode("overwrite").parquet(path)


def upsert_rows(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    return table.join(changed.select(key), key, "left_anti").unionByName(changed)


def read_periods(spark: SparkSession, out: str) -> DataFrame:
    """Subscriptions with current periods and counters, as of the last finished micro-batch."""
    slots = spark.read.parquet(f"{out}/subscriptions/slot=*")
    return slots.filter(F.col("batch") == slots.agg(F.max("batch").alias("b")).scalar()).drop("batch", "slot")


def last_status(stream: DataFrame, key: str = "id", job: str = "bulk_job_id") -> DataFrame:
    """Latest status, tokens and pages per document, kept as streaming state."""
    newest = F.max_by(F.struct("status", "token_usage", "llamaparse_pages"), F.struct("updated_at", "seq"))
    return stream.groupBy(job, key).agg(newest.alias("s")).select(job, key, "s.*")


def write_updates(aggregate: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store the rows an aggregate changed in each micro-batch."""
    return start(aggregate, lambda df, n: write_batch(df, out, n), checkpoint, "update", trigger)


def read_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Current value per key: the row of the last batch that changed it."""
    return latest_per_key(read_batches(spark, out), keys, ["batch"]).drop("batch")


# --- uploads ----------------------------------------------------------------

BULK_LAYOUT = r"^([^/]+)/bulk/([^/]+)/([^/]+)$"


def shape_uploads(notices: DataFrame) -> DataFrame:
    """Storage notices as uploads; folders, hidden files, other paths and types are skipped."""
    name = file_name(F.col("name"))
    kept = notices.filter(
        F.col("name").rlike(BULK_LAYOUT) & ~name.startswith(".") & extension(name).isin(K.UPLOAD_EXTENSIONS))
    return kept.select(
        "event_id", "ts", F.regexp_extract("name", BULK_LAYOUT, 1).alias("org_id"),
        F.regexp_extract("name", BULK_LAYOUT, 2).alias("folder"),
        F.concat(F.lit("gs://"), "bucket", F.lit("/"), "name").alias("path"), name.alias("file_name"))


def job_id(org: Column, folder: Column, first_event: Column) -> Column:
    """Stable id of the job that an upload opens for its folder."""
    return F.sha2(F.concat_ws("|", org, folder, first_event), 256)


def ingest_uploads(stream: DataFrame, out: str, checkpoint: str, cap: int = K.MAX_FOLDER_DOCUMENTS,
                   trigger: dict | None = None, ended: Callable[[SparkSession], DataFrame] | None = None) -> StreamingQuery:
    """Upload notices into ``documents`` (registered files) and ``actions`` (one per notice).

    A folder has one active job; an upload joins it, or opens a new one if there
    is none. ``ended`` gives the (bulk_job_id) of jobs that are no longer pending
    or processing, asked once for each micro-batch and kept, so that a repeated batch
    sees the same. A job takes ``cap`` files; a
    path counts once per job. What is remembered is the files of active jobs, as
    a table that two slots take in turn, so a repeated batch finds the state
    before it, and neither history nor ended jobs are read again. Each micro-batch
    is one distributed admission; a folder with most of the traffic is no single task.
    """
    keys = ["org_id", "folder"]
    names = ["bulk_job_id", *keys, "path", "event_id"]

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        uploads = shape_uploads(batch).persist()
        try:
            if number == 0:
                active = uploads.withColumn("bulk_job_id", F.lit(None).cast("string")).select(*names).limit(0)
            else:
                active = spark.read.parquet(f"{out}/state/slot={(number - 1) % 2}")
            if ended is not None:
                write_once(ended(spark).select("bulk_job_id").distinct(), f"{out}/ended/batch={number}")
                over = spark.read.schema("bulk_job_id string").parquet(f"{out}/ended/batch={number}")
                active = active.join(over, "bulk_job_id", "left_anti")
            jobs = active.groupBy(*keys).agg(F.max("bulk_job_id").alias("open_job"), F.count(F.lit(1)).alias("used"))
            order = F.struct("ts", "event_id")
            firsts = uploads.groupBy(*keys, "path", "file_name").agg(F.min(order).alias("first"))
            opens = firsts.groupBy(*keys).agg(F.min("first").alias("opener"))
            fresh = firsts.join(active.select(*keys, "path"), [*keys, "path"], "left_anti")
            fresh = first_n(fresh, keys, [F.col("first")], cap, "place").join(jobs, keys, "left").join(opens, keys)
            fresh = fresh.filter(F.col("place") + F.coalesce("used", F.lit(0)) <= cap).select(
                F.coalesce("open_job", job_id(F.col("org_id"), F.col("folder"), F.col("opener.event_id"))).alias("bulk_job_id"),
                *keys, "path", "file_name", F.col("first.ts").alias("created_at"), F.col("first.event_id").alias("event_id"))
            write_batch(fresh, f"{out}/documents", number)
            fresh = spark.read.parquet(f"{out}/documents/batch={number}")
            active.select(*names).unionByName(fresh.select(*names)).write.mode("overwrite").parquet(f"{out}/state/slot={number % 2}")
            known = spark.read.parquet(f"{out}/state/slot={number % 2}").select(
                *keys, "path", F.col("event_id").alias("by_event"))
            action = (
                F.when(F.col("by_event").isNull(), "limit_exceeded")
                .when(F.col("by_event") == F.col("event_id"), "added").otherwise("exists"))
            acted = uploads.join(known, [*keys, "path"], "left").select("event_id", *keys, "path", action.alias("action"))
            write_batch(acted, f"{out}/actions", number)
        finally:
            uploads.unpersist()

    return start(stream, handle, checkpoint, trigger=trigger)


def start_signals(uploads: DataFrame, quiet: int = K.QUIET_SECONDS, min_docs: int = 1, delay: str = WATERMARK) -> DataFrame:
    """One row per folder burst once no upload followed for ``quiet`` seconds.

    A session window closes exactly then; in append mode each closed burst is
    emitted once, when the watermark has passed its quiet end. Uploads later than
    ``delay`` go to a side table first, by :func:`set_late_aside`.
    """
    return (
        event_time(uploads, "ts").withWatermark("ts", delay)
        .groupBy("org_id", "folder", F.session_window("ts", f"{quiet} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("document_count"), F.max("ts").alias("last_upload"))
        .filter(F.col("document_count") >= min_docs)
        .select("org_id", "folder", F.col("w.start").alias("first_upload"), "last_upload",
                F.col("w.end").alias("start_at"), "document_count")
    )
