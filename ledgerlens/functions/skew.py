"""Ordered computations that survive hot keys.

A window partitioned by a business key puts the whole key in one task. Each
helper here first cuts a key along an order-preserving bucket (hour, gap width,
id range), works inside (key, bucket), and carries only one row per bucket
across the key. Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def _named(prefix: str, df: DataFrame) -> str:
    name = prefix
    while name in df.columns:
        name = "_" + name
    return name


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank"
) -> DataFrame:
    """``row_number`` per key, where ``bucket`` never decreases along ``order``."""
    b, before, n = (_named(x, df) for x in ("_bucket", "_before", "_n"))
    rows = df.withColumn(b, bucket)
    per_bucket = rows.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(b).alias(f"_k{b}"),
        F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before),
    )
    on = F.col(b).eqNullSafe(F.col(f"_k{b}"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    return (
        rows.withColumn(name, F.row_number().over(inside))
        .join(offsets, on, "inner")
        .withColumn(name, F.col(name) + F.col(before))
        .drop(b, before, f"_k{b}", *[f"_k_{k}" for k in keys])
    )


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)


def gap_bucket(ts: Column, seconds: int) -> Column:
    """Index of the gap-wide slot; rows in one slot lie less than a gap apart."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def islands(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: int, extra: Sequence[Column] = ()
) -> DataFrame:
    """Slots of each key labelled with the start of the activity island they are in.

    A new island starts when at least ``seconds`` pass without a row. All rows
    of one gap-wide slot share an island, so slots are pre-aggregated map side
    and the window sees at most (time span / gap) rows per key. Columns: keys,
    ``slot``, ``slot_start``, ``slot_end``, the ``extra`` aggregates, ``island``.
    """
    slots = (
        df.withColumn("slot", gap_bucket(F.col(ts), seconds))
        .groupBy(*keys, "slot")
        .agg(F.min(ts).alias("slot_start"), F.max(ts).alias("slot_end"), *extra)
    )
    order = Window.partitionBy(*keys).orderBy("slot")
    previous = F.lag("slot_end").over(order)
    quiet = F.unix_micros(F.col("slot_start").cast("timestamp")) - F.unix_micros(
        previous.cast("timestamp")
    )
    opens = previous.isNull() | (quiet >= F.lit(seconds * 1_000_000))
    started = slots.withColumn("_opens", F.when(opens, F.col("slot_start")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return started.withColumn("island", F.last("_opens", ignorenulls=True).over(upto)).drop("_opens")


def clamped_totals(
    deltas: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
    start: Column, delta: str,
) -> DataFrame:
    """Final value per key of ``v = max(0, v + delta)`` applied in order.

    Equal to ``S - min(0, m)`` with S the plain total (start included) and m the
    lowest running total. Both compose over buckets, so a hot key is only
    walked bucket by bucket. ``start`` may use any column constant per key.
    """
    rows = deltas.withColumn("_bucket", bucket).withColumn("_start", start)
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    per_bucket = (
        rows.withColumn("_run", F.sum(delta).over(inside))
        .groupBy(*keys, "_bucket")
        .agg(F.sum(delta).alias("_sum"), F.min("_run").alias("_low"), F.first("_start").alias("_start"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.withColumn(
        "_low", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)) + F.col("_low")
    )
    return carried.groupBy(*keys).agg(
        (
            F.first("_start") + F.sum("_sum")
            - F.least(F.lit(0), F.first("_start") + F.min("_low"))
        ).alias("value"),
        (F.first("_start") + F.sum("_sum")).alias("unclamped"),
    )
