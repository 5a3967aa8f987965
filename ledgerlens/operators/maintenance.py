"""Table maintenance as pure functions: (old table, changes) -> new table.

Stock Parquet has no MERGE or DELETE, so nothing here overwrites what it reads;
``sources.versioned`` publishes a result as a new version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions import constants as K
from ledgerlens.functions.skew import clamped_totals
from ledgerlens.operators.filters import extension
from ledgerlens.operators.joins import match_registry, month_period
from ledgerlens.operators.ordering import first_n, latest_per_key


# --- de-duplication ---------------------------------------------------------

def dedupe_requests(df: DataFrame, existing: DataFrame | None = None, request: str = "request_id",
                    order: Sequence[str] = ("created_at",)) -> DataFrame:
    """First write per request id; rows without an id all stay; known ids are dropped."""
    others = [c for c in df.columns if c != request]
    named = df.filter(F.col(request).isNotNull())
    first = named.groupBy(request).agg(
        F.min_by(F.struct(*others), F.struct(*order, *[c for c in _orderable(df, others) if c not in order]))
        .alias("_row")
    ).select(request, "_row.*")
    if existing is not None:
        first = first.join(existing.select(request), request, "left_anti")
    return first.select(*df.columns).unionByName(df.filter(F.col(request).isNull()))


def _orderable(df: DataFrame, columns: Sequence[str]) -> list[str]:
    kinds = ("map", "variant", "array", "struct")
    return [c for c in columns if not df.schema[c].dataType.simpleString().startswith(kinds)]


def dedupe_content(docs: DataFrame, text: str = "text", key: str = "doc_id",
                   size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents of distinct content (lowest id kept), and the groups of copies.

    The whole text is hashed; only hashes and ids are shuffled. Kept rows are
    found by their unique id, so a content that makes up a large share of the
    corpus skews neither the aggregate nor the join.
    """
    digest = F.sha2(F.col(text).cast("binary"), 256)
    length = F.col(size) if size else F.octet_length(text)
    groups = docs.select(key, digest.alias("content_hash"), length.cast("long").alias("bytes")).groupBy(
        "content_hash").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"), F.min("bytes").alias("bytes"),
    )
    groups = groups.withColumn("bytes_saved", (F.col("copies") - 1) * F.col("bytes"))
    kept = docs.join(groups.select(key, "content_hash"), key)
    return kept, groups


# --- upserts and registries -------------------------------------------------

def upsert(target: DataFrame, changes: DataFrame, keys: Sequence[str], *, order: Sequence[str],
           defaults: Mapping[str, object] | None = None, created: str = "created_at",
           updated: str = "updated_at") -> DataFrame:
    """Keyed upsert: the last change wins, creation time is preserved.

    Empty values of a change take the defaults. Both sides share the columns of
    ``target``; ``order`` decides between changes of one key.
    """
    filled = changes
    for name, value in (defaults or {}).items():
        given = F.col(name)
        empty = given.isNull() | (given.cast("string").isin("", "0"))
        filled = filled.withColumn(name, F.when(empty, F.lit(value)).otherwise(given))
    old = target.withColumn("_new", F.lit(0))
    new = filled.select(*target.columns).withColumn("_new", F.lit(1))
    payload = [c for c in target.columns if c not in (*keys, created)]
    rank = F.struct("_new", *order)
    merged = old.unionByName(new).groupBy(*keys).agg(
        F.max_by(F.struct(*payload), rank).alias("_row"), F.min(created).alias(created)
    )
    return merged.select(*[F.col(c) if c in (*keys, created) else F.col(f"_row.{c}").alias(c)
                           for c in target.columns])


REGISTRY_COLUMNS = [
    "id", "file_hash", "storage_path", "filename", "file_type", "file_size", "org_id",
    "folder_id", "status", "parsed_path", "parsed_at", "is_active", "created_at", "updated_at",
]


def _full_path(path: Column, bucket: str) -> Column:
    return F.when(path.startswith("gs://"), path).otherwise(F.concat(F.lit(f"gs://{bucket}/"), path))


def _file_type(path: Column) -> Column:
    ext = F.regexp_replace(extension(path), r"^\.", "")
    return F.when(ext == "", "unknown").otherwise(ext)


def _one_per_target(matched: DataFrame, order: Sequence[str]) -> DataFrame:
    """The last of several incoming rows that land on one registry row."""
    return latest_per_key(matched, ["_target"], order)


def register_uploads(registry: DataFrame, uploads: DataFrame, bucket: str) -> DataFrame:
    """Registry after uploads ``(file_path, filename, file_size, org_id, folder_id, uploaded_at)``.

    A row of the same organisation, folder and name takes the new path, size and
    hash, and goes back to uploaded unless already parsed. Otherwise a row is
    added; if its path hash is known that row is updated instead. Several
    uploads of one file count as one, the last winning.
    """
    full = _full_path(F.col("file_path"), bucket)
    incoming = uploads.select(
        "filename", "file_size", "org_id", "folder_id", "uploaded_at", full.alias("storage_path"),
        F.sha2(full.cast("binary"), 256).alias("file_hash"), _file_type(F.col("file_path")).alias("file_type"),
    )
    matched = match_registry(incoming, registry, fallback=False)
    by_hash = registry.groupBy("file_hash").agg(F.min("id").alias("hash_id"))
    matched = matched.join(by_hash, "file_hash", "left").withColumn(
        "_target", F.coalesce("matched_id", "hash_id", "file_hash")
    ).withColumn("_how", F.when(F.col("matched_id").isNotNull(), "name").when(
        F.col("hash_id").isNotNull(), "hash").otherwise("new"))
    last = _one_per_target(matched, ["uploaded_at", "storage_path"])
    change = last.select(
        F.col("_target").alias("id"), "_how", F.struct(
            "file_hash", "storage_path", "filename", "file_type", "file_size", "folder_id", "org_id", "uploaded_at"
        ).alias("n"),
    )
    merged = registry.join(change, "id", "full_outer")
    how = F.col("_how")
    by_name, added, touched = how == "name", how == "new", how.isNotNull()

    def pick(test: Column, new: Column, name: str) -> Column:
        return F.when(test, new).otherwise(F.col(name)).alias(name)

    status = (
        F.when(how.isNull(), F.col("status"))
        .when(by_name & (F.col("status") == "parsed"), F.lit("parsed")).otherwise("uploaded")
    )
    return merged.select(
        "id",
        pick(by_name | added, F.col("n.file_hash"), "file_hash"),
        pick(by_name | added, F.col("n.storage_path"), "storage_path"),
        pick(touched, F.col("n.filename"), "filename"),
        pick(added, F.col("n.file_type"), "file_type"),
        pick(touched, F.col("n.file_size"), "file_size"),
        pick(added, F.col("n.org_id"), "org_id"),
        pick(touched, F.col("n.folder_id"), "folder_id"),
        status.alias("status"), "parsed_path", "parsed_at",
        pick(added, F.lit(True), "is_active"),
        pick(added, F.col("n.uploaded_at"), "created_at"),
        pick(touched, F.col("n.uploaded_at"), "updated_at"),
    )


def register_parsed(registry: DataFrame, parsed: DataFrame, bucket: str) -> DataFrame:
    """Registry after parse results ``(storage_path, filename, org_id, folder_id, parsed_path, file_size, parsed_at)``."""
    full = _full_path(F.col("storage_path"), bucket)
    incoming = parsed.select(
        "filename", "org_id", "folder_id", "parsed_path", "parsed_at", "file_size",
        full.alias("storage_path"), F.sha2(full.cast("binary"), 256).alias("file_hash"),
        _file_type(F.col("storage_path")).alias("file_type"),
    )
    matched = match_registry(incoming, registry).withColumn("_target", F.coalesce("matched_id", "file_hash"))
    last = _one_per_target(matched, ["parsed_at", "storage_path"])
    change = last.select(F.col("_target").alias("id"), "match_kind", F.struct(
        "file_hash", "storage_path", "filename", "file_type", "file_size", "folder_id", "org_id",
        "parsed_path", "parsed_at").alias("n"))
    merged = registry.join(change, "id", "full_outer")
    touched, added = F.col("match_kind").isNotNull(), F.col("match_kind") == "new"
    has_folder = touched & F.col("n.folder_id").isNotNull() & (F.col("n.folder_id") != "")

    def pick(test: Column, new: Column, name: str) -> Column:
        return F.when(test, new).otherwise(F.col(name)).alias(name)

    return merged.select(
        "id",
        pick(added, F.col("n.file_hash"), "file_hash"),
        pick(touched, F.col("n.storage_path"), "storage_path"),
        pick(added, F.col("n.filename"), "filename"),
        pick(added, F.col("n.file_type"), "file_type"),
        pick(added, F.coalesce("n.file_size", F.lit(0)), "file_size"),
        pick(added, F.col("n.org_id"), "org_id"),
        pick(added | has_folder, F.col("n.folder_id"), "folder_id"),
        pick(touched, F.lit("parsed"), "status"),
        pick(touched, F.col("n.parsed_path"), "parsed_path"),
        pick(touched, F.col("n.parsed_at"), "parsed_at"),
        pick(added, F.lit(True), "is_active"),
        pick(added, F.col("n.parsed_at"), "created_at"),
        pick(touched, F.col("n.parsed_at"), "updated_at"),
    )


# --- job lifecycle ----------------------------------------------------------

def fold_jobs(events: DataFrame, job: str = "job_id", kind: str = "event", ts: str = "ts",
              tie: str = "event_id") -> DataFrame:
    """Job rows from start, complete and fail events.

    Status, path, duration and error come from the latest event that sets them.
    """
    order = F.struct(F.col(ts), F.col(tie))
    started, done, failed = (F.col(kind) == k for k in ("start", "complete", "fail"))
    ended = done | failed
    status = F.when(started, "processing").when(done, "completed").when(failed, "failed")
    return events.groupBy(job).agg(
        F.max_by(status, F.when(status.isNotNull(), order)).alias("status"),
        F.min(F.when(started, F.col(ts))).alias("started_at"),
        F.max(F.when(ended, F.col(ts))).alias("completed_at"),
        F.max_by("output_path", F.when(done, order)).alias("output_path"),
        F.max_by("duration_ms", F.when(done, order)).alias("duration_ms"),
        F.max_by("error", F.when(failed, order)).alias("error_message"),
    )


def advance_documents(docs: DataFrame, parsed: DataFrame, indexed: DataFrame, generated: DataFrame,
                      cancelled: DataFrame, key: str = "id") -> DataFrame:
    """Documents after parse, index and generate, settled in one pass.

    ``docs`` brings the three ``generate_*`` flags. Stage tables carry ``ok``,
    ``error`` and their time; a stage that failed stops the later ones.
    ``cancelled`` lists documents with the stage before which they were
    cancelled. Only documents that reach the last step get a total time.
    """
    p = parsed.select(key, F.struct("ok", "error", "parse_time_ms", "parsed_path", "content_hash",
                                    "llamaparse_pages").alias("p"))
    i = indexed.select(key, F.struct("ok", "error", "index_time_ms").alias("i"))
    g = generated.select(key, F.struct("ok", "error", "generation_time_ms", "token_usage").alias("g"))
    c = cancelled.select(key, F.col("before_stage").alias("_cut"))
    rows = docs.select(key, "generate_summary", "generate_faqs", "generate_questions")
    for side in (p, i, g, c):
        rows = rows.join(side, key, "left")
    parse_ok = F.coalesce(F.col("p.ok"), F.lit(False))
    cut_index = parse_ok & F.coalesce(F.col("_cut") == "index", F.lit(False))
    ran_index = parse_ok & ~cut_index
    index_ok = ran_index & F.coalesce(F.col("i.ok"), F.lit(False))
    cut_generate = index_ok & F.coalesce(F.col("_cut") == "generate", F.lit(False))
    asked = F.col("generate_summary") | F.col("generate_faqs") | F.col("generate_questions")
    ran_generate = index_ok & ~cut_generate & asked
    generate_ok = ran_generate & F.coalesce(F.col("g.ok"), F.lit(False))
    status = (
        F.when(~parse_ok, "failed").when(cut_index | cut_generate, "skipped")
        .when(~index_ok, "failed").when(~asked | generate_ok, "completed").otherwise("failed")
    )
    error = (
        F.when(~parse_ok, F.coalesce("p.error", F.lit("Parse failed")))
        .when(cut_index | cut_generate, "Job cancelled")
        .when(~index_ok, F.coalesce("i.error", F.lit("Index failed")))
        .when(ran_generate & ~generate_ok, F.coalesce("g.error", F.lit("Generation failed")))
    )
    parse_ms = F.col("p.parse_time_ms")
    index_ms = F.when(ran_index, F.col("i.index_time_ms"))
    generate_ms = F.when(ran_generate, F.col("g.generation_time_ms"))
    total = sum((F.coalesce(x, F.lit(0)) for x in (index_ms, generate_ms)), F.coalesce(parse_ms, F.lit(0)))
    return rows.select(
        key, status.alias("status"), error.alias("error_message"),
        F.when(parse_ok, F.col("p.parsed_path")).alias("parsed_path"),
        F.when(index_ok, F.col("p.content_hash")).alias("content_hash"),
        parse_ms.alias("parse_time_ms"), index_ms.alias("index_time_ms"),
        generate_ms.alias("generation_time_ms"),
        F.when(index_ok, total).alias("total_time_ms"),
        F.when(generate_ok, F.col("g.token_usage")).otherwise(0).alias("token_usage"),
        F.when(index_ok, F.coalesce("p.llamaparse_pages", F.lit(0))).otherwise(0).alias("llamaparse_pages"),
    )


def cancel_jobs(jobs: DataFrame, docs: DataFrame, ids: DataFrame, job: str = "bulk_job_id") -> tuple[DataFrame, DataFrame]:
    """Pending and running jobs among ``ids`` are cancelled, their open documents skipped.

    Newly skipped documents add to the job's skipped count.
    """
    stopped = (
        jobs.filter(F.col("status").isin("pending", "processing"))
        .join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias(job))
        .withColumn("_stop", F.lit(True))
    )
    open_doc = F.col("_stop").isNotNull() & F.col("status").isin(K.CANCELLABLE_STATES)
    marked = docs.join(stopped, job, "left").withColumn("_skip", open_doc)
    new_docs = marked.withColumn(
        "status", F.when(F.col("_skip"), "skipped").otherwise(F.col("status"))
    )
    if "error_message" in docs.columns:
        new_docs = new_docs.withColumn(
            "error_message", F.when(F.col("_skip"), "Job cancelled").otherwise(F.col("error_message"))
        )
    hit = docs.filter(F.col("status").isin(K.CANCELLABLE_STATES)).groupBy(job).agg(
        F.count(F.lit(1)).alias("_hit"))
    new_jobs = (
        jobs.join(stopped.withColumnRenamed(job, "id"), "id", "left")
        .join(hit.withColumnRenamed(job, "id"), "id", "left")
        .withColumn("status", F.when(F.col("_stop").isNotNull(), "cancelled").otherwise(F.col("status")))
        .withColumn("skipped_count", F.col("skipped_count") + F.when(
            F.col("_stop").isNotNull(), F.coalesce("_hit", F.lit(0))).otherwise(0))
    )
    return new_jobs.select(*jobs.columns), new_docs.select(*docs.columns)


def retry_failed(jobs: DataFrame, docs: DataFrame, job_ids: DataFrame | None = None,
                 document_ids: DataFrame | None = None, max_retries: int = K.MAX_RETRIES,
                 job: str = "bulk_job_id") -> tuple[DataFrame, DataFrame]:
    """Failed documents go back to pending with one more retry.

    Selected documents are limited to ``max_retries``; a whole-job reset is not,
    and also clears the job's failed count.
    """
    whole = document_ids is None
    wanted = F.col("status") == "failed"
    if whole:
        pick = docs.join(job_ids.select(F.col("id").alias(job)).distinct(), job, "left_semi")
    else:
        pick = docs.join(document_ids.select("id").distinct(), "id", "left_semi")
        wanted = wanted & (F.col("retry_count") < max_retries)
    reset = pick.filter(wanted).select("id", job)
    marked = docs.join(reset.select("id", F.lit(True).alias("_reset")), "id", "left")
    again = F.col("_reset").isNotNull()
    new_docs = marked.withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).withColumn(
        "retry_count", F.col("retry_count") + F.when(again, 1).otherwise(0))
    if "error_message" in docs.columns:
        new_docs = new_docs.withColumn("error_message", F.when(~again, F.col("error_message")))
    touched = reset.groupBy(F.col(job).alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    new_jobs = jobs.join(touched, "id", "left")
    hit = F.col("_n").isNotNull()
    reopened = hit & F.col("status").isin("completed", "partial_failure", "failed")
    if whole:
        named = job_ids.select("id").distinct().withColumn("_named", F.lit(True))
        new_jobs = new_jobs.join(named, "id", "left")
        hit = F.col("_named").isNotNull()
        reopened = hit
        new_jobs = new_jobs.withColumn("failed_count", F.when(hit, F.lit(0)).otherwise(F.col("failed_count")))
    new_jobs = new_jobs.withColumn("status", F.when(reopened, "processing").otherwise(F.col("status")))
    return new_jobs.select(*jobs.columns), new_docs.select(*docs.columns)


def next_batch(docs: DataFrame, slots: int = K.CONCURRENT_DOCUMENTS, job: str = "bulk_job_id") -> DataFrame:
    """Oldest pending documents of each job, as many as it has free slots."""
    busy = docs.groupBy(job).agg(
        F.count(F.when(F.col("status").isin(K.IN_PROGRESS_STATES), 1)).alias("_busy")
    )
    queue = first_n(docs.filter(F.col("status") == "pending"), [job],
                    [F.col("created_at"), F.col("id")], slots, "_place")
    return queue.join(busy, job).filter(F.col("_place") <= slots - F.col("_busy")).drop("_place", "_busy")


# --- counters and periods ---------------------------------------------------

def roll_periods(subs: DataFrame, now: Column) -> DataFrame:
    """Ended periods restart at the current month with zero counters; storage stays."""
    start, end = month_period(now)
    ended = F.col("current_period_end") < now
    out = subs
    for counter in ("tokens_used_this_period", "llamaparse_pages_used", "file_search_queries_used"):
        out = out.withColumn(counter, F.when(ended, F.lit(0).cast("long")).otherwise(F.col(counter)))
    return out.withColumn(
        "_start", F.when(ended, start).otherwise(F.col("current_period_start"))
    ).withColumn(
        "current_period_end", F.when(ended, end).otherwise(F.col("current_period_end"))
    ).withColumn("current_period_start", F.col("_start")).drop("_start")


#: Amounts of a day and the period counters they add up to.
DAY_COUNTERS = {"_t": "tokens_used_this_period", "_p": "llamaparse_pages_used",
                "_q": "file_search_queries_used", "_s": "storage_used_bytes"}


def daily_amounts(tokens: DataFrame, resources: DataFrame) -> DataFrame:
    """(org_id, day, _t, _p, _q, _s): tokens, pages, searches and bytes of each organisation and day."""
    kind = F.col("resource_type")

    def amount(name: str) -> Column:
        return F.when(kind == name, F.col("amount")).otherwise(0)

    day = F.to_date("created_at")
    stacked = tokens.select(
        "org_id", day.alias("day"), F.col("total_tokens").cast("long").alias("_t"),
        *[F.lit(0).cast("long").alias(c) for c in ("_p", "_q", "_s")],
    ).unionByName(resources.select(
        "org_id", day.alias("day"), F.lit(0).cast("long").alias("_t"),
        amount("llamaparse_pages").cast("long").alias("_p"),
        amount("file_search_queries").cast("long").alias("_q"),
        amount("storage_bytes").cast("long").alias("_s"),
    ))
    return stacked.groupBy("org_id", "day").agg(*[F.sum(c).alias(c) for c in DAY_COUNTERS])


def counters_from_days(subs: DataFrame, daily: DataFrame) -> DataFrame:
    """Period counters as sums of the days inside each period (end excluded); periods start and end at midnight."""
    periods = subs.select("org_id", F.to_date("current_period_start").alias("_from"),
                          F.to_date("current_period_end").alias("_to"))
    sums = daily.join(periods, "org_id").filter(
        (F.col("day") >= F.col("_from")) & (F.col("day") < F.col("_to"))
    ).groupBy("org_id").agg(*[F.sum(c).alias(c) for c in DAY_COUNTERS])
    out = subs.drop(*DAY_COUNTERS.values()).join(sums, "org_id", "left")
    for short, name in DAY_COUNTERS.items():
        out = out.withColumn(name, F.coalesce(short, F.lit(0).cast("long"))).drop(short)
    return out.select(*subs.columns)


def rebuild_counters(subs: DataFrame, tokens: DataFrame, resources: DataFrame) -> DataFrame:
    """Period counters as sums of the records inside each period (end excluded).

    Records are first summed per organisation and day; the join then carries days,
    not events.
    """
    return counters_from_days(subs, daily_amounts(tokens, resources))


def apply_deltas(state: DataFrame, deltas: DataFrame, key: str, value: str, delta: str,
                 order: Sequence[Column], bucket: Column) -> DataFrame:
    """State after deltas applied in order, each step clamped at zero."""
    rows = deltas.join(state.select(key, F.col(value).alias("_from")), key)
    moved = clamped_totals(rows, [key], order, bucket, F.col("_from"), delta)
    out = state.join(moved.select(key, F.col("value").alias("_to")), key, "left")
    return out.withColumn(value, F.coalesce("_to", value)).select(*state.columns)


# --- purges -----------------------------------------------------------------

def purge_expired(cache: DataFrame, ttl_hours: int, now: Column, created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Live entries, and the deleted count; entries older than the TTL go."""
    # an entry without a time never expires
    old = F.coalesce(F.col(created) < now - F.make_interval(hours=F.lit(ttl_hours)), F.lit(False))
    return cache.filter(~old), cache.filter(old).agg(F.count(F.lit(1)).alias("deleted"))


def clear_scope(cache: DataFrame, org, folder: str | None = None, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cache without one folder, else one file, else the whole organisation."""
    hit = F.col("org_id") == F.lit(org)
    if folder:
        hit = hit & F.col("folder_filter").eqNullSafe(F.lit(folder))
    elif file:
        hit = hit & F.col("file_filter").eqNullSafe(F.lit(file))
    hit = F.coalesce(hit, F.lit(False))  # an entry without an organisation belongs to none
    return cache.filter(~hit), cache.filter(hit).agg(F.count(F.lit(1)).alias("deleted"))


def _purge(tables: Mapping[str, tuple[DataFrame, Column]]) -> tuple[dict[str, DataFrame], DataFrame]:
    kept, counts = {}, None
    for name, (df, hit) in tables.items():
        hit = F.coalesce(hit, F.lit(False))
        kept[name] = df.filter(~hit)
        gone = df.filter(hit).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = gone if counts is None else counts.unionByName(gone)
    return kept, counts


def erase_user(tables: Mapping[str, DataFrame], user, user_col: str = "user_id", org=None,
               org_col: str = "org_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without a user's rows, and deleted counts per table."""
    def hit(_: DataFrame) -> Column:
        test = F.col(user_col) == F.lit(user)
        return test if org is None else test & (F.col(org_col) == F.lit(org))

    return _purge({n: (df, hit(df)) for n, df in tables.items()})


def purge_prefix(tables: Mapping[str, tuple[DataFrame, str]], prefix: str, org=None,
                 org_col: str = "org_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without rows whose name column starts with ``prefix``, and counts.

    Tables without the organisation column ignore ``org``.
    """
    checked = {}
    for name, (df, column) in tables.items():
        test = F.col(column).startswith(prefix)
        if org is not None and org_col in df.columns:
            test = test & (F.col(org_col) == F.lit(org))
        checked[name] = (df, test)
    return _purge(checked)


def replace_files(index: DataFrame, batch: DataFrame, keys: Sequence[str] = ("store", "file_name")) -> DataFrame:
    """Index where files of the batch replace earlier ones of the same store and name."""
    touched = batch.select(*keys).distinct()
    return index.join(touched, list(keys), "left_anti").unionByName(batch, allowMissingColumns=True)
