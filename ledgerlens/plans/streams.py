"""Streams replayed over the test tables; each equals its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A
from ledgerlens.plans.catalog import query
from ledgerlens.session import shared_dir
from ledgerlens.streaming import ingest as I, stateful as Z


def replay(t, df, label):
    """The rows of ``df`` as a stream, through files in the shared folder."""
    root = shared_dir(t.spark, label)
    df.write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(df.schema).parquet(f"{root}/in")
    return stream, f"{root}/out", f"{root}/checkpoint"


def usage_events(t):
    """Token and resource events; every seventh is sent twice."""
    total = F.floor("value").cast("long")
    resource = F.col("event_type").isin("purchase", "click")
    rows = t.events.select(
        F.when(resource, "resource").otherwise("token").alias("event_type"), F.col("user_id").alias("org_id"),
        F.col("event_id").alias("request_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("feature"),
        F.lit("openai").alias("provider"), F.lit("gpt-4o").alias("model"), F.floor(total / 2).alias("input_tokens"),
        (total - F.floor(total / 2)).alias("output_tokens"), F.lit(0).cast("long").alias("cached_tokens"),
        F.when(F.col("event_type") == "purchase", "llamaparse_pages").when(F.col("event_type") == "click", "file_search_queries").alias("resource_type"),
        F.lit(1).cast("long").alias("amount"), F.col("ts").alias("created_at"))
    return rows.unionByName(rows.filter(F.col("request_id") % 7 == 0))


@query("e1_ingest_usage", """
SELECT user_id AS org_id, CASE event_type WHEN 'error' THEN 'unknown' ELSE event_type END AS feature, COUNT(*) AS n, CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens,
 CAST(SUM((CAST(floor(value) AS BIGINT) // 2)::DECIMAL(20,0) * 0.0000025::DECIMAL(12,12) + (CAST(floor(value) AS BIGINT) - CAST(floor(value) AS BIGINT) // 2)::DECIMAL(20,0) * 0.00001::DECIMAL(12,12)) AS DOUBLE) AS total_cost_usd
FROM events WHERE event_type NOT IN ('purchase', 'click') GROUP BY 1, 2""")
def ingest_usage(t):
    stream, out, checkpoint = replay(t, usage_events(t), "usage")
    I.ingest_usage(stream, out, checkpoint).awaitTermination()
    return I.read_batches(t.spark, f"{out}/token_usage").groupBy("org_id", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").cast("double").alias("total_cost_usd"))


@query("e1_ingest_resources", "SELECT org_id, resource_type, CAST(SUM(amount) AS BIGINT) AS amount FROM $resource_usage GROUP BY 1, 2")
def ingest_resources(t):
    stream, out, checkpoint = replay(t, usage_events(t), "usage")
    I.ingest_usage(stream, out, checkpoint).awaitTermination()
    return I.read_batches(t.spark, f"{out}/resource_usage").groupBy("org_id", "resource_type").agg(F.sum("amount").alias("amount"))


def audit_stream_rows(t):
    kind = F.when(F.col("event_type") == "purchase", "generation_save").when(F.col("event_type") == "view", "document_loaded").otherwise(F.col("event_type"))
    return t.events.select(
        "event_id", kind.alias("event_type"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("org_id"),
        F.concat(F.lit("file-"), "event_id").alias("file_name"), F.lit("hash").alias("document_hash"),
        F.to_json(F.struct(F.lit("summary").alias("generation_type"), F.col("props").alias("content"))).alias("details"), F.col("ts").alias("created_at"))


@query("e2_ingest_audit", """
SELECT 'generations' AS table_name, event_id, 'summary' AS label FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'audit_log', event_id, CASE event_type WHEN 'view' THEN 'DOWNLOAD' ELSE 'UPDATE' END FROM events WHERE event_type <> 'purchase' AND user_id % 10 <> 0""")
def ingest_audit(t):
    stream, out, checkpoint = replay(t, audit_stream_rows(t), "audit")
    I.ingest_audit(stream, out, checkpoint).awaitTermination()
    made = I.read_batches(t.spark, f"{out}/generations").select(F.lit("generations").alias("table_name"), "event_id", F.col("generation_type").alias("label"))
    return made.unionByName(I.read_batches(t.spark, f"{out}/audit_log").select(F.lit("audit_log").alias("table_name"), "event_id", F.col("action").alias("label")))


@query("e3_live_counters", """
SELECT org_id, CAST(date_trunc('day', created_at) AS TIMESTAMP) AS period_start, CAST(SUM(total_tokens) AS BIGINT) AS total_tokens, COUNT(*) AS total_requests
FROM $token_usage GROUP BY 1, 2""")
def live_counters(t):
    usage = t.token_usage.select("org_id", "total_tokens", "created_at")
    stream, out, checkpoint = replay(t, usage, "counters")
    I.count_usage(stream, out, checkpoint).awaitTermination()
    return I.read_counters(t.spark, out).withColumn(
        "period_start", F.col("period_start").cast("timestamp_ntz"))


@query("e3_period_counters", """
WITH u AS (SELECT org_id, created_at, total_tokens AS t, 0 AS p, 0 AS q FROM $token_usage
 UNION ALL SELECT org_id, created_at, 0, CASE WHEN resource_type = 'llamaparse_pages' THEN amount ELSE 0 END,
  CASE WHEN resource_type = 'file_search_queries' THEN amount ELSE 0 END FROM $resource_usage),
n AS (SELECT max(created_at) AS newest FROM u),
s AS (SELECT org_id, CASE WHEN current_period_end < newest THEN date_trunc('month', newest) ELSE current_period_start END AS a,
  CASE WHEN current_period_end < newest THEN date_trunc('month', newest) + INTERVAL 1 MONTH ELSE current_period_end END AS b FROM $subscriptions, n)
SELECT s.org_id, CAST(s.a AS TIMESTAMP) AS current_period_start, CAST(COALESCE(SUM(u.t), 0) AS BIGINT) AS tokens_used_this_period,
 CAST(COALESCE(SUM(u.p), 0) AS BIGINT) AS llamaparse_pages_used, CAST(COALESCE(SUM(u.q), 0) AS BIGINT) AS file_search_queries_used
FROM s LEFT JOIN u ON u.org_id = s.org_id AND u.created_at >= s.a AND u.created_at < s.b GROUP BY 1, 2""")
def period_counters(t):
    """Usage in several micro-batches; periods that end on the way start anew."""
    usage = t.token_usage.select("org_id", "created_at", "total_tokens", F.lit(None).cast("string").alias("resource_type"), F.lit(0).cast("long").alias("amount"))
    usage = usage.unionByName(t.resource_usage.select("org_id", "created_at", F.lit(0).cast("long").alias("total_tokens"), "resource_type", F.col("amount").cast("long")))
    root = shared_dir(t.spark, "periods")
    usage.repartitionByRange(3, "created_at").write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(usage.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    I.count_periods(stream, t.subscriptions, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return I.read_periods(t.spark, f"{root}/out").select(
        "org_id", F.col("current_period_start").cast("timestamp_ntz").alias("current_period_start"), "tokens_used_this_period",
        "llamaparse_pages_used", "file_search_queries_used")


def notices(t):
    """Storage notices: valid uploads with hidden, foreign and unsupported ones mixed in."""
    case = F.col("event_id") % 13
    k = F.get_json_object("props", "$.k")
    name = F.concat(
        F.lit("org/"), F.when(case == 1, "other/").otherwise("bulk/"), (F.col("user_id") % 20).cast("string"), F.lit("/"),
        F.when(case == 2, ".").otherwise(""), k, F.when(case == 3, ".exe").when(case == 4, "/").otherwise(".pdf"))
    return t.events.select("event_id", "ts", F.lit("b").alias("bucket"), name.alias("name"))


@query("e4_ingest_uploads", """
WITH u AS (SELECT * FROM $uploads WHERE event_id % 13 NOT IN (1, 2, 3, 4)),
f AS (SELECT folder, file, min((ts, event_id)) AS first FROM u GROUP BY ALL),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY folder ORDER BY first) <= 10)
SELECT u.event_id, CASE WHEN a.first IS NULL THEN 'limit_exceeded' WHEN a.first = (u.ts, u.event_id) THEN 'added' ELSE 'exists' END AS action
FROM u LEFT JOIN a ON u.folder = a.folder AND u.file = a.file""")
def ingest_uploads(t):
    stream, out, checkpoint = replay(t, notices(t), "uploads")
    I.ingest_uploads(stream, out, checkpoint).awaitTermination()
    return I.read_batches(t.spark, f"{out}/actions").select("event_id", "action")


@query("e4_ingest_uploads_ended", """
WITH e AS (SELECT *, ts >= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events) AS second_half FROM $uploads WHERE event_id % 13 NOT IN (1, 2, 3, 4)),
u AS (SELECT *, CASE WHEN CAST(folder AS INT) % 2 = 0 AND second_half THEN 1 ELSE 0 END AS job FROM e),
f AS (SELECT folder, job, file, min((ts, event_id)) AS first FROM u GROUP BY ALL),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY folder, job ORDER BY first) <= 10)
SELECT u.event_id, CASE WHEN a.first IS NULL THEN 'limit_exceeded' WHEN a.first = (u.ts, u.event_id) THEN 'added' ELSE 'exists' END AS action
FROM u LEFT JOIN a ON u.folder = a.folder AND u.job = a.job AND u.file = a.file""")
def ingest_uploads_ended(t):
    """Two micro-batches; the jobs of even folders end in between."""
    rows = notices(t)
    middle = rows.agg((F.unix_micros(F.min("ts").cast("timestamp")) + (
        F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 2).alias("m")).first()["m"]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= F.lit(middle)
    root = shared_dir(t.spark, "uploads")
    out = f"{root}/out"

    def ended(spark):
        documents = I.read_batches(spark, f"{out}/documents")
        if documents is None:
            return spark.createDataFrame([], "bulk_job_id string")
        return documents.filter(F.col("folder").cast("int") % 2 == 0).select("bulk_job_id")

    for part in (rows.filter(~late), rows.filter(late)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        I.ingest_uploads(stream, out, f"{root}/checkpoint", ended=ended).awaitTermination()
    return I.read_batches(t.spark, f"{out}/actions").select("event_id", "action")


QUIET = 600


@query("e5_start_signals", f"""
WITH s AS (SELECT folder, ts, CASE WHEN lag(ts) OVER (PARTITION BY folder ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY folder ORDER BY ts) >= to_seconds({QUIET}) THEN 1 ELSE 0 END AS opens FROM $uploads),
g AS (SELECT folder, ts, SUM(opens) OVER (PARTITION BY folder ORDER BY ts) AS burst FROM s)
SELECT folder, max(ts) AS last_upload, COUNT(*) AS document_count FROM g GROUP BY folder, burst
HAVING COUNT(*) >= 2 AND max(ts) + to_seconds({QUIET}) <= (SELECT max(ts) FROM events)""")
def start_signals(t):
    stream, out, checkpoint = replay(t, t.uploads, "quiet")
    I.set_late_aside(stream, "ts", out, f"{checkpoint}-aside").awaitTermination()
    timely = t.spark.readStream.schema(t.uploads.schema).parquet(f"{out}/timely/batch=*")
    signals = I.start_signals(timely, QUIET, 2, "0 seconds")
    out = f"{out}/signals"
    I.start(signals, lambda df, n: I.write_batch(df, out, n), checkpoint).awaitTermination()
    return I.read_batches(t.spark, out).select(
        "folder", F.col("last_upload").cast("timestamp_ntz").alias("last_upload"), "document_count")


def calls(t):
    return t.events.select((F.col("user_id") % 3).alias("session_id"), F.col("ts").alias("at"), "event_id")


ADMISSION_SQL = """
WITH RECURSIVE c AS (SELECT user_id % 3 AS session_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT session_id, 0::BIGINT AS n, []::BIGINT[] AS times, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted, 0::BIGINT AS retry_after, 0::BIGINT AS remaining
  FROM (SELECT DISTINCT session_id FROM c) s
  UNION ALL
  SELECT q.session_id, q.n, CASE WHEN len(q.p) < 10 THEN list_append(q.p, q.us) ELSE q.p END, q.event_id, len(q.p) < 10,
    CASE WHEN len(q.p) < 10 THEN 0 ELSE greatest(0, (q.p[1] + 3600000000 - q.us) // 1000000) END, 10 - least(10, len(q.p) + 1)
  FROM (SELECT c.session_id, c.n, c.event_id, c.us, list_filter(r.times, lambda x: x > c.us - 3600000000) AS p
        FROM r JOIN c ON c.session_id = r.session_id AND c.n = r.n + 1) q)
SELECT session_id, event_id, admitted, CAST(retry_after AS INT) AS retry_after, CAST(remaining AS INT) AS remaining FROM r WHERE n > 0"""


@query("e6_admission_batch", ADMISSION_SQL)
def admission_batch(t):
    return Z.admission(calls(t), "session_id", "at", "event_id", 10, 3600).select("session_id", "event_id", "admitted", "retry_after", "remaining")


@query("e6_admission_stream", ADMISSION_SQL)
def admission_stream(t):
    stream, out, checkpoint = replay(t, calls(t), "admission")
    verdicts = Z.admission_stream(stream, "session_id", "at", "event_id", 10, 3600)
    I.start(verdicts, lambda df, n: I.write_batch(df, out, n), checkpoint).awaitTermination()
    return I.read_batches(t.spark, out).drop("batch")


SESSIONS_SQL = """
s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM s)"""


@query("e7_sessionise", f"""
WITH {SESSIONS_SQL}
SELECT user_id, min(ts) AS session_start, max(ts) AS last_activity, max(ts) + INTERVAL 30 MINUTE AS expires_at, COUNT(*) AS query_count,
 CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens_used, CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_processing_time_ms,
 COUNT(DISTINCT props) AS documents FROM g GROUP BY user_id, sid""")
def sessionise(t):
    return Z.sessionise(t.events, "user_id", "ts", tokens=F.floor("value"), elapsed=F.floor("value"), document=F.col("props")).withColumn(
        "total_processing_time_ms", F.col("total_processing_time_ms").cast("long"))


@query("e7_sessions_stream", f"""
WITH {SESSIONS_SQL}
SELECT user_id, min(ts) AS session_start, max(ts) AS last_activity, max(ts) + INTERVAL 30 MINUTE AS expires_at, COUNT(*) AS query_count,
 CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens_used, COUNT(DISTINCT props) AS documents FROM g GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)""")
def sessions_stream(t):
    stream, out, checkpoint = replay(t, t.events.select("user_id", "ts", "value", "props"), "sessions")
    closed = Z.sessions_stream(stream, "user_id", "ts", delay="0 seconds", tokens=F.floor("value"), document=F.col("props"))
    I.start(closed, lambda df, n: I.write_batch(df, out, n), checkpoint).awaitTermination()
    found = I.read_batches(t.spark, out)
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "last_activity", "expires_at")],
                        "query_count", F.col("total_tokens_used").cast("long").alias("total_tokens_used"), "documents")


@query("e7_sessions_job", f"""
WITH {SESSIONS_SQL}
SELECT user_id, min(ts) AS session_start, COUNT(*) AS query_count, CAST(SUM(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_tokens_used,
 CAST(SUM(CAST(floor(value * 2) AS BIGINT)) AS BIGINT) AS total_processing_time_ms, COUNT(DISTINCT props) AS documents FROM g GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events)""")
def sessions_job(t):
    """Late rows set aside, then sessions, with the elapsed time."""
    stream, out, checkpoint = replay(t, t.events.select("user_id", "ts", "value", "props"), "sessions")
    Z.sessions_job(stream, "user_id", "ts", out, checkpoint, tokens=F.floor("value"), elapsed=F.floor(F.col("value") * 2), document=F.col("props"))
    return I.read_batches(t.spark, f"{out}/sessions").select(
        "user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "query_count",
        *[F.col(c).cast("long").alias(c) for c in ("total_tokens_used", "total_processing_time_ms", "documents")])


@query("e8_live_progress", """
WITH d AS (SELECT user_id % 30 AS bulk_job_id, user_id * 100 + CAST(json_extract_string(props, '$' || '.k') AS BIGINT) AS id,
  arg_max(CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'parsing' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'completed' ELSE 'failed' END, (ts, event_id)) AS status FROM events GROUP BY 1, 2)
SELECT bulk_job_id, COUNT(*) AS total_documents, COUNT(*) FILTER (status = 'completed') AS completed_count, COUNT(*) FILTER (status = 'failed') AS failed_count FROM d GROUP BY 1""")
def live_progress(t):
    status = (F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "parsing")
              .when(F.col("event_type").isin("click", "purchase"), "completed").otherwise("failed"))
    rows = t.events.select(
        (F.col("user_id") % 30).alias("bulk_job_id"), (F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")).alias("id"),
        status.alias("status"), F.lit(1).cast("long").alias("token_usage"), F.lit(1).cast("long").alias("llamaparse_pages"),
        F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    stream, out, checkpoint = replay(t, rows, "progress")
    I.write_updates(I.last_status(stream), out, checkpoint).awaitTermination()
    latest = I.read_updates(t.spark, out, ["bulk_job_id", "id"])
    return A.job_progress(latest).select("bulk_job_id", "total_documents", "completed_count", "failed_count")
