"""Sliding-window admission and sessions, as batch jobs and as stateful streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.functions import constants as K
from ledgerlens.functions.skew import gap_bucket, islands
from ledgerlens.streaming.ingest import WATERMARK, event_time, set_late_aside, start, write_batch


class Gate:
    """Admission of one session: at most ``most`` admitted calls per window."""

    def __init__(self, most: int, window_us: int, recent=()):
        self.most, self.window = most, window_us
        self.recent: deque[int] = deque(recent)

    def call(self, at: int) -> tuple[bool, int, int]:
        """Admitted or not, whole seconds to wait, calls still free."""
        while self.recent and self.recent[0] <= at - self.window:
            self.recent.popleft()
        admitted = len(self.recent) < self.most
        if admitted:
            self.recent.append(at)
        wait = 0 if admitted else max(0, (self.recent[0] + self.window - at) // 1_000_000)
        return admitted, int(wait), self.most - len(self.recent)


def _verdicts(gate: Gate, pdf: pd.DataFrame) -> pd.DataFrame:
    results = [gate.call(int(at)) for at in pdf["at_us"]]
    return pd.DataFrame(results, columns=["admitted", "retry_after", "remaining"], index=pdf.index)


def admission(df: DataFrame, session: str, ts: str, key: str, most: int = K.ADMIT_MAX,
              window: int = K.ADMIT_WINDOW_SECONDS) -> DataFrame:
    """Verdict per call: at most ``most`` admitted per session in any ``window`` seconds.

    Refused calls do not count. A pause of a whole window clears a session's
    history, so every session is first cut at such pauses and the pieces spread
    over tasks; each piece is walked in order with at most ``most`` remembered
    times. Only a session that never pauses stays in one task, streamed.
    """
    pieces = islands(df, [session], ts, window).select(session, "slot", "island")
    schema = T.StructType([
        df.schema[session], df.schema[key], df.schema[ts],
        T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.IntegerType()),
        T.StructField("remaining", T.IntegerType()),
    ])
    rows = df.select(session, key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"),
                     gap_bucket(F.col(ts), window).alias("slot")).join(pieces, [session, "slot"]).drop("slot")
    span = window * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for pdf in batches:
            parts = []
            for piece, part in pdf.groupby([session, "island"], sort=False):
                if piece != current:
                    current, gate = piece, Gate(most, span)
                parts.append(_verdicts(gate, part))
            if parts:
                yield pd.concat([pdf[[session, key, ts]], pd.concat(parts)], axis=1)

    lined_up = rows.repartition(session, "island").sortWithinPartitions(session, "island", "at_us", key)
    return lined_up.mapInPandas(walk, schema)


class AdmissionProcessor(StatefulProcessor):
    """Streaming twin of :func:`admission`; the state is the admitted times, gone once none counts any more."""

    def __init__(self, session: str, key: str, most: int, window: int, expires: bool):
        self.session, self.key, self.most, self.window, self.expires = session, key, most, window * 1_000_000, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one session's calls of one micro-batch, whose size the trigger bounds
        calls = pd.concat(list(rows)).sort_values(["at_us", self.key])
        known = self.times.get() if self.times.exists() else None
        gate = Gate(self.most, self.window, known[0] if known else ())
        found = _verdicts(gate, calls)
        self.times.update((list(gate.recent),))
        if self.expires:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(-(-(gate.recent[-1] + self.window) // 1000))
        yield pd.concat([calls[[self.session, self.key]], found], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The newest admitted call has left the window: whatever comes now finds an empty history."""
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(stream: DataFrame, session: str, ts: str, key: str, most: int = K.ADMIT_MAX,
                     window: int = K.ADMIT_WINDOW_SECONDS, delay: str | None = None) -> DataFrame:
    """Admission over a stream; the state is at most ``most`` times per session.

    With ``delay``, a session's state goes when the watermark has passed its newest
    admitted call by the window, which changes no verdict; calls that come later
    than ``delay`` are taken off first, by :func:`ingest.set_late_aside`. Without
    it the state stays. ``maxFilesPerTrigger`` bounds a micro-batch.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = T.StructType([
        stream.schema[session], stream.schema[key],
        T.StructField("admitted", T.BooleanType()), T.StructField("retry_after", T.IntegerType()),
        T.StructField("remaining", T.IntegerType()),
    ])
    rows = stream if delay is None else event_time(stream, ts).withWatermark(ts, delay)
    rows = rows.select(session, key, *([ts] if delay is not None else []), F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"))
    return rows.groupBy(session).transformWithStateInPandas(
        AdmissionProcessor(session, key, most, window, delay is not None), schema, "append", "none" if delay is None else "eventTime")


def sessionise(df: DataFrame, user: str, ts: str, gap: int = K.SESSION_GAP_SECONDS,
               tokens: Column | None = None, elapsed: Column | None = None,
               document: Column | None = None) -> DataFrame:
    """Sessions per user: a new one starts after ``gap`` idle seconds.

    Calls collapse into gap-wide slots map side, so a busy user costs one row per
    slot. A pause of exactly the gap starts a new session.
    """
    rows = df.withColumn("_tokens", tokens if tokens is not None else F.lit(0)).withColumn(
        "_ms", elapsed if elapsed is not None else F.lit(0.0))
    slots = islands(rows, [user], ts, gap, [
        F.count(F.lit(1)).alias("n"), F.sum("_tokens").alias("tokens"), F.sum("_ms").alias("ms")])
    sessions = slots.groupBy(user, F.col("island").alias("session_start")).agg(
        F.max("slot_end").alias("last_activity"), F.sum("n").alias("query_count"),
        F.sum("tokens").alias("total_tokens_used"), F.sum("ms").alias("total_processing_time_ms"))
    idle = F.make_interval(secs=F.lit(gap))
    sessions = sessions.withColumn("expires_at", F.col("last_activity") + idle)
    if document is None:
        return sessions
    seen = (
        df.select(user, gap_bucket(F.col(ts), gap).alias("slot"), document.alias("_doc")).distinct()
        .join(slots.select(user, "slot", F.col("island").alias("session_start")), [user, "slot"])
        .select(user, "session_start", "_doc").distinct()
        .groupBy(user, "session_start").agg(F.count("_doc").alias("documents"))
    )
    return sessions.join(seen, [user, "session_start"])


def sessions_stream(stream: DataFrame, user: str, ts: str, gap: int = K.SESSION_GAP_SECONDS, delay: str = "1 hour",
                    tokens: Column | None = None, elapsed: Column | None = None, document: Column | None = None) -> DataFrame:
    """Streaming twin of :func:`sessionise`, with the same columns; a session is emitted when it has expired.

    State is one row per open session, with its distinct documents. Rows later
    than ``delay`` are dropped by the watermark: take the late ones off first,
    as :func:`ingest.set_late_aside` does.
    """
    rows = event_time(stream, ts).withColumn("_tokens", tokens if tokens is not None else F.lit(0)).withColumn(
        "_ms", elapsed if elapsed is not None else F.lit(0.0)).withColumn("_doc", document if document is not None else F.lit(None).cast("string"))
    closed = rows.withWatermark(ts, delay).groupBy(user, F.session_window(ts, f"{gap} seconds").alias("w")).agg(
        F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("query_count"), F.sum("_tokens").alias("total_tokens_used"),
        F.sum("_ms").alias("total_processing_time_ms"), F.size(F.collect_set("_doc")).cast("long").alias("documents"))
    out = closed.select(
        user, F.col("w.start").alias("session_start"), "last_activity", F.col("w.end").alias("expires_at"), "query_count",
        "total_tokens_used", "total_processing_time_ms", "documents")
    return out if document is not None else out.drop("documents")


def sessions_job(stream: DataFrame, user: str, ts: str, out: str, checkpoint: str, gap: int = K.SESSION_GAP_SECONDS,
                 delay: str = WATERMARK, trigger: dict | None = None, **measures: Column) -> None:
    """Sessions of a stream under ``sessions``, its late rows under ``late``; runs over what is available.

    Rows later than ``delay`` are set aside first, so the watermark drops none.
    """
    spark, schema = stream.sparkSession, stream.schema
    set_late_aside(stream, ts, out, f"{checkpoint}/aside", delay, trigger).awaitTermination()
    timely = spark.readStream.schema(schema).parquet(f"{out}/timely/batch=*")
    closed = sessions_stream(timely, user, ts, gap, "0 seconds", **measures)
    start(closed, lambda df, n: write_batch(df, f"{out}/sessions", n), f"{checkpoint}/sessions", trigger=trigger).awaitTermination()
