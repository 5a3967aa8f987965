"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by weight, but no more than its size times
the epochs allowed. What capped sources leave over goes to the others by weight,
until none is above its cap. A target is met by whole repetitions of every document
and one more of a seeded sample.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.functions.skew import ranked
from ledgerlens.llm.common import stored

EPOCHS, SEED = 3, 20240301
#: Slices of a source's seeded order; only one slice per source is ever sorted.
SLICES = 4096
SALTS = 16
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """(source, weight): weights of the cycle dealt to the sources by code point, null last."""
    # a range of sources per bucket, written down so that the ranges stay as they are
    dealt = stored(sources.select("source").repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
        "part", F.spark_partition_id()), "ranges")
    place = ranked(dealt, [], [F.col("source").asc_nulls_last()], F.col("part"), "place")
    return place.select("source", F.get(F.array(*map(F.lit, cycle)), ((F.col("place") - 1) % len(cycle)).cast("int")).cast("long").alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """(source, source_size, target) of (source, source_size) and (source, weight) rows, one per source.

    Sizes under 10**20 and positive integer weights under 10**17 are compared
    exactly. ``total`` is the sum of all sizes unless given; what all caps together
    fall short of it stays unmet. A source without a weight gets nothing. The
    driver sees two numbers per round of capping.
    """
    rows = sizes.join(weights.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other")), "left").select(
        "source", "source_size", F.coalesce("weight", F.lit(0)).cast("decimal(17,0)").alias("weight"),
        (F.col("source_size").cast("decimal(19,0)") * epochs).cast("decimal(20,0)").alias("cap"))
    rows = stored(rows.withColumn("capped", F.lit(False)), "sources")
    if total is None:
        total = int(rows.agg(F.sum(F.col("source_size").cast("decimal(28,0)"))).first()[0] or 0)
    rest, shares, left = Decimal(total), Decimal(0), -1
    while True:
        over = rows.agg(
            F.sum(F.when(F.col("capped"), F.col("cap")).cast("decimal(28,0)")), F.sum(F.when(~F.col("capped"), F.col("weight"))),
            F.count(F.when(~F.col("capped"), 1))).first()
        rest, shares = Decimal(total) - (over[0] or 0), over[1] or Decimal(0)
        if over[2] == left or not shares:
            break
        left = over[2]
        above = F.lit(rest).cast("decimal(20,0)") * F.col("weight") > F.col("cap") * F.lit(shares).cast("decimal(17,0)")
        rows = stored(rows.withColumn("capped", F.col("capped") | above), "sources")
    share = F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(shares or 1))
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, which comes in salted copies, since a source may hold most rows."""
    copies = plan.withColumnRenamed("source", "other").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("source").eqNullSafe(F.col("other")) & (F.pmod("slice", F.lit(SALTS)) == F.col("salt"))
    return rows.join(copies, same).drop("other", "salt")


def _slices(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Goals with ``whole`` repetitions of every document, the ``gap`` left, the slice that ends it, and the size ``before`` that slice."""
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("gap", F.col("target") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("n")).withColumn("end", F.sum("n").over(upto))
    ends = sums.select(F.col("source").alias("other"), "slice", "end", (F.col("end") - F.col("n")).alias("before"))
    passed = F.when(F.col("end") > F.col("gap"), F.struct("slice", "before"))
    cut = goals.join(ends, F.col("source").eqNullSafe(F.col("other")), "left").groupBy(*goals.columns).agg(F.min(passed).alias("c"))
    nothing = F.col("gap") <= 0
    return cut.select(
        *goals.columns, F.when(nothing, -1).otherwise(F.coalesce("c.slice", F.lit(SLICES))).alias("cut"),
        F.coalesce("c.before", F.lit(0)).alias("before"))


def mix(docs: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, size) with source_size, target and ``repeats``; goals as from :func:`targets`.

    All documents of a source get the whole repetitions that fit into its target.
    Then documents get one more in the order of the MD5 of seed and doc_id, up to
    the first that would pass the target; last, that one of the rest which best
    closes the gap, if it brings the source nearer to its target. So the same rows
    give the same mix. Rows alike in doc_id and size are told apart by no column, so
    their order changes nothing. Empty documents take no part in sizes.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = stored(docs.select("doc_id", "source", "size", order.alias("order"), F.monotonically_increasing_id().alias("row")).withColumn(
        "slice", F.conv(F.substring("order", 1, 3), 16, 10).cast("int")), "sized")
    plan = stored(_slices(rows, goals), "cuts")
    key = F.struct("order", "doc_id", "size", "row")
    # only the slice in which a gap ends is put in order
    ordered = Window.partitionBy("source").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = _with_plan(rows, plan).where("slice = cut").withColumn("end", F.col("before") + F.sum("size").over(ordered))
    reached = inside.where("end <= gap").groupBy("source").agg(F.max(key).alias("last"), F.max("end").alias("reached"))
    plan = stored(plan.join(reached.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other")), "left").drop("other").withColumn(
        "missing", F.when(F.col("cut").between(0, SLICES - 1), F.col("gap") - F.coalesce("reached", "before"))), "reached")
    taken = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & F.coalesce(key <= F.col("last"), F.lit(False)))
    off = F.abs(F.col("missing") - F.col("size"))
    closing = _with_plan(rows, plan).where(~taken & (off < F.col("missing"))).groupBy("source").agg(
        F.min_by("row", F.struct(off, "order", "doc_id", "size", "row")).alias("extra"))
    plan = stored(plan.join(closing.withColumnRenamed("source", "other"), F.col("source").eqNullSafe(F.col("other")), "left").drop("other"), "plan")
    more = taken | F.coalesce(F.col("row") == F.col("extra"), F.lit(False))
    return _with_plan(rows, plan).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + more.cast("long")).alias("repeats"))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Every document with its repetitions in a mix of all sources, whose total is that of ``docs``.

    Sources are weighed by :func:`cycled_weights`. A null text has size 0, a null
    source is a source of its own; every row is a document, repeated rows too;
    extra columns are ignored. Without rows there is no mix.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = stored(sized, "sizes")
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    return mix(sized, targets(sizes, cycled_weights(sizes, cycle), epochs), seed)


def repeated(docs: DataFrame, repeats: str = "repeats") -> DataFrame:
    """Every row as often as its ``repeats`` says."""
    return docs.where(F.col(repeats) > 0).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col(repeats).cast("int")))).drop("_nth")
