"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every historical version is a path with a content; equal contents are one blob,
named by its SHA-256. The ledger lists the (blob, rule version) pairs that have
been scanned. A run scans only pairs that the ledger lacks, once each, and joins
the findings of all runs back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import free_name, stored


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose checked group is shorter than ``least`` are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        import hashlib

        return hashlib.sha256(f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}".encode()).hexdigest()[:16]


#: Fixed values. Order is the order of kinds at one place. A run of hex digits or capitals is matched whole
#: either way, so those two may ask for their length in the pattern; ``assign`` may not.
RULES = (
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
LEDGER = "blob string, rule string"
FINDINGS = "blob string, rule string, kind string, start long, end long"


def _empty(spark: SparkSession, columns: str) -> DataFrame:
    """No rows of the columns, in no partitions; an empty list would have some, and so start Python workers."""
    return spark.createDataFrame(spark.sparkContext.emptyRDD(), columns)


def with_blobs(versions: DataFrame) -> DataFrame:
    """(path, blob, content) of (path, content) rows; a null content is empty."""
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    return versions.select("path", F.sha2(content, 256).alias("blob"), content.alias("content"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in (blob, content, todo) rows, one row each, in code points, end exclusive.

    Only rules that ``todo`` lists are applied: the pattern reads a text that is
    null otherwise, so it can't be moved before the join that knows. A text is split at the matches of a rule; lengths of the pieces and matches,
    added up in order, give the places.
    """
    out = None
    for rule in rules:
        pattern = F.lit(rule.pattern)
        asked = F.when(F.array_contains("todo", rule.version), F.col("content"))
        hits = blobs.where(asked.rlike(rule.pattern)).select(
            "blob", F.monotonically_increasing_id().alias("row"), F.split("content", rule.pattern, -1).alias("gaps"),
            F.regexp_extract_all("content", pattern, F.lit(0)).alias("hits"),
            F.regexp_extract_all("content", pattern, F.lit(rule.group)).alias("checked"))
        rows = hits.select("blob", "row", F.posexplode(F.transform("hits", lambda h, i: F.struct(
            F.length(F.get("gaps", i)).cast("long").alias("gap"), F.length(h).cast("long").alias("hit"),
            (F.length(F.get("checked", i)) >= rule.least).alias("ok")))).alias("n", "h"))
        upto = Window.partitionBy("blob", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("h.gap") + F.col("h.hit")).over(upto)
        found = rows.select("blob", (end - F.col("h.hit")).alias("start"), end.alias("end"), "h.ok").where("ok").select(
            "blob", F.lit(rule.version).alias("rule"), F.lit(rule.kind).alias("kind"), "start", "end")
        out = found if out is None else out.unionByName(found)
    return out


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, ledger, findings): blob of every path, all scanned pairs and all findings, old and new.

    ``versions`` has path and content; extra columns are ignored, repeated rows and
    copies are scanned once. Old tables come back with the new rows added. A blob
    unseen under one rule only is scanned for that rule only.
    """
    spark: SparkSession = versions.sparkSession
    ledger = _empty(spark, LEDGER) if ledger is None else ledger.select("blob", "rule")
    findings = _empty(spark, FINDINGS) if findings is None else findings.select("blob", "rule", "kind", "start", "end")
    named = with_blobs(versions)
    paths = stored(named.select("path", "blob"), "paths")
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.lit(r.version) for r in rules])
    missing = first.withColumn("rule", F.explode(wanted)).join(ledger, ["blob", "rule"], "left_anti")
    todo = stored(missing.groupBy("blob", "path").agg(F.sort_array(F.collect_set("rule")).alias("todo")), "todo")
    # the text is fetched by one path of its blob; rows that repeat both are scanned apart and found once
    same = (F.col("v.blob") == F.col("t.blob")) & F.col("v.path").eqNullSafe(F.col("t.path"))
    texts = named.alias("v").join(todo.alias("t"), same).select("content", "t.blob", "todo")
    fresh = scan(texts, rules)
    fresh = stored(fresh.distinct(), "findings")
    scanned = todo.select("blob", F.explode("todo").alias("rule"))
    return paths, ledger.unionByName(scanned), findings.unionByName(fresh)


def by_path(paths: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, n_<kind>..., spans) for all paths; spans are kind:start:end by start, then kind in rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = findings.where(F.col("rule").isin([r.version for r in rules]))
    spans = F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), "end", "kind")))
    counts = [F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules]
    summary = current.groupBy("blob").agg(*counts, spans.alias("spans")).withColumn("spans", F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","))
    named = paths.join(summary, "blob", "left")
    return named.select(
        "path", "blob", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules],
        F.coalesce("spans", F.lit("")).alias("spans"))


def clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """Documents with every finding replaced by ``mark``; overlapping findings give one mark. Columns stay as they are.

    The ledger decides which documents hold findings; only those texts change.
    """
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    _, _, findings = scan_versions(versions, rules=rules)
    spans = findings.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    blob = free_name(docs, "blob")
    named = docs.withColumn(blob, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    return cut_out(named, spans, blob, mark).select(*docs.columns)


def cut_out(docs: DataFrame, spans: DataFrame, blob: str, mark: str) -> DataFrame:
    """Replace the ``spans`` (blob, list of start and end) of each text; ``blob`` is the column that names it."""
    cuts = free_name(docs, "spans")
    hits = docs.join(spans.select(F.col("blob").alias(blob), F.col("spans").alias(cuts)), blob, "left")
    walked = F.aggregate(
        cuts, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            s["end"].alias("at"), F.concat(acc["parts"], F.array(
                F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("parts")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length(F.col("text")))))
    return hits.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(walked))
