"""Delimited scans, file mounts, guarded SQL over files, manifests and document loads."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlens.functions import constants as K
from ledgerlens.operators.filters import base_name, extension, file_name
from ledgerlens.session import stored
from ledgerlens.sources.sqlguard import ParsedQuery, refuse_text

SEPARATORS = {".csv": ",", ".tsv": "\t"}


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def scan_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                   nrows: int | None = None, sampling: float = 1.0) -> DataFrame:
    """Comma or tab separated file with a header.

    Types are inferred once when no schema is given (``sampling`` limits that
    pass); the returned frame reads with the schema fixed.
    """
    suffix = _suffix(path)
    if suffix not in SEPARATORS:
        raise ValueError(f"unsupported file type: {suffix or 'none'}")
    reader = spark.read.option("header", True).option("sep", SEPARATORS[suffix])
    if schema is None:
        schema = reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path).schema
    frame = spark.read.option("header", True).option("sep", SEPARATORS[suffix]).schema(schema).csv(path)
    return frame if nrows is None else frame.limit(nrows)


def open_file(spark: SparkSession, path: str) -> DataFrame:
    if _suffix(path) == ".parquet":
        return spark.read.parquet(path)
    return scan_delimited(spark, path)


def mount_files(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Views ``file_0``, ``file_1``... by position; bad files leave their number unused.

    Returns view name to path, and path to error. Fails when no file is usable.
    """
    views, rejected = {}, {}
    for index, path in enumerate(paths):
        try:
            open_file(spark, path).createOrReplaceTempView(f"file_{index}")
            views[f"file_{index}"] = path
        except (ValueError, PySparkException) as error:
            rejected[path] = str(error).splitlines()[0]
    if not views:
        raise ValueError(f"no usable file: {rejected}")
    return views, rejected


def guard_sql(query: str, spark: SparkSession | None = None, tables: Iterable[str] | None = None) -> ParsedQuery | None:
    """Refuse what the text shows; with a session, everything but queries over ``tables`` (all temporary views unless given)."""
    refuse_text(query)
    if spark is None:
        return None
    if tables is None:
        tables = [t.name for t in spark.catalog.listTables() if t.isTemporary]
    parsed = ParsedQuery(spark, query)
    parsed.check(tables)
    return parsed


def run_sql(spark: SparkSession, query: str, max_rows: int | None = None, tables: Iterable[str] | None = None) -> DataFrame:
    """Guarded query over the mounted views; ``max_rows`` rows at most, if it is given and the query has no limit of its own."""
    parsed = guard_sql(query, spark, tables)
    frame = spark.sql(parsed.text)
    return frame if max_rows is None or parsed.has_own_limit() else frame.limit(max_rows)


def sql_over_files(spark: SparkSession, paths: Sequence[str], query: str,
                   max_rows: int | None = None) -> tuple[DataFrame, dict]:
    """Result of a query over the files and a report of columns, tables, rejects and whether rows were cut.

    ``truncated`` is None without ``max_rows``; with it, one more row is looked for.
    """
    views, rejected = mount_files(spark, paths)
    parsed = guard_sql(query, spark, views)
    frame = whole = spark.sql(parsed.text)
    cut = None
    if max_rows is not None:
        cut = False
        if not parsed.has_own_limit():
            frame, cut = whole.limit(max_rows), bool(whole.offset(max_rows).limit(1).count())
    return frame, {"columns": frame.columns, "tables": views, "rejected": rejected, "truncated": cut}


_LISTED = "path string, folder boolean, length long, us long"


def _uri(root: str, found: str) -> str:
    """How Spark writes a path that pyarrow found under ``root``."""
    scheme, _, rest = root.partition("://")
    if not rest or scheme == "file":
        return "file:" + found
    if scheme in ("hdfs", "viewfs"):
        return f"{scheme}://{rest.split('/', 1)[0]}{found}"
    return f"{scheme}://{found}"


def _list_folders(batches):
    """Children of every folder; runs in tasks, one folder at a time."""
    import pyarrow as pa
    from pyarrow import fs

    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    for batch in batches:
        for folder in batch.column("folder").to_pylist():
            system, path = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if re.match("file:/(?!/)", folder) else folder)
            found = system.get_file_info(fs.FileSelector(path, recursive=False))
            for at in range(0, len(found), 10_000):
                rows = [(_uri(folder, f.path), f.type == fs.FileType.Directory, f.size or 0, (f.mtime_ns or 0) // 1000) for f in found[at:at + 10_000]]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [n.split()[0] for n in _LISTED.split(", ")])


def file_manifest(spark: SparkSession, root: str,
                  extensions: Sequence[str] | None = tuple(K.FOLDER_EXTENSIONS)) -> DataFrame:
    """Files under ``root`` with size and time, newest first; contents are not read.

    Folders are listed in tasks, one level of the tree per job; the folders found
    are the next level, and no listing passes through the driver. Empty files and
    names with a leading underscore are there; names with a leading dot are not. A
    folder is listed by one task. The store has to be one that pyarrow can open
    (local, HDFS, S3 or Google Cloud Storage).
    """
    level, files = spark.createDataFrame([(root,)], "folder string"), None
    while True:
        listed = stored(level.mapInArrow(_list_folders, _LISTED), "listing")
        found = listed.filter("not folder").select("path", "length", "us")
        files = found if files is None else files.unionByName(found)
        level = listed.filter("folder").select(F.col("path").alias("folder"))
        if level.isEmpty():
            break
        level = level.repartition("folder")  # siblings lie in one file; their folders are listed side by side
    files = files.select("path", "length", F.timestamp_micros("us").alias("modificationTime"))
    name = file_name(F.col("path"))
    files = files.filter(~name.startswith("."))
    if extensions is not None:
        files = files.filter(extension(name).isin([e.lower() for e in extensions]))
    return files.orderBy(F.desc("modificationTime"), "path")


def load_documents(requests: DataFrame, parsed: DataFrame, raw: DataFrame) -> DataFrame:
    """Content per request: parsed copy if not empty, else a raw text copy, else none.

    ``requests`` has ``parsed_path`` and ``document_name``; ``parsed`` has
    ``parsed_path, content``; ``raw`` has ``file_name, content``. Raw copies are
    tried under the exact name, then with ``.md``, then ``.txt``.
    """
    p = parsed.filter(F.length("content") > 0).select("parsed_path", F.lit("parsed").alias("_p"))
    texts = raw.filter(extension(F.col("file_name")).isin(".md", ".txt") & F.col("content").isNotNull()).select("file_name")
    exact = texts.select(F.col("file_name").alias("document_name"), F.col("file_name").alias("_exact")).distinct()
    by_stem = texts.groupBy(base_name(F.col("file_name")).alias("_stem")).agg(
        F.min_by("file_name", extension(F.col("file_name"))).alias("_stemmed"))
    # keys first: every request finds the one text it takes, then each text is fetched once
    chosen = (
        requests.withColumn("_stem", base_name(F.col("document_name")))
        .join(p.distinct(), "parsed_path", "left").join(exact, "document_name", "left").join(by_stem, "_stem", "left")
    )
    upload = F.coalesce("_exact", "_stemmed")
    kind = F.when(F.col("_p").isNotNull(), "parsed").when(upload.isNotNull(), "upload").otherwise("not_found")
    key = F.when(F.col("_p").isNotNull(), F.col("parsed_path")).otherwise(upload)
    chosen = chosen.select(*requests.columns, kind.alias("source_type"), key.alias("_key"))
    contents = parsed.filter(F.length("content") > 0).select(
        F.lit("parsed").alias("source_type"), F.col("parsed_path").alias("_key"), "content").unionByName(raw.select(
            F.lit("upload").alias("source_type"), F.col("file_name").alias("_key"), "content"))
    return chosen.join(contents, ["source_type", "_key"], "left").select(
        *requests.columns, "content", "source_type", F.length("content").cast("long").alias("content_length"))


def table_inventory(tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Row count of each table, and which are missing or extra against a list."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    wanted = expected.select("table_name").withColumn("_wanted", F.lit(True))
    state = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").otherwise("present")
    )
    return counts.join(wanted, "table_name", "full_outer").withColumn("state", state).drop("_wanted")


def generation_type(summary: Column, faqs: Column, questions: Column) -> Column:
    """``all`` with the three kinds present or none, else the first one present."""
    has_s = F.coalesce(F.length(summary) > 0, F.lit(False))
    has_f = F.coalesce(F.size(faqs) > 0, F.lit(False))
    has_q = F.coalesce(F.size(questions) > 0, F.lit(False))
    return (
        F.when(has_s & has_f & has_q, "all").when(has_s, "summary")
        .when(has_f, "faqs").when(has_q, "questions").otherwise("all")
    )


def artifact_rows(content: DataFrame) -> DataFrame:
    """One row per document and content type that exists, with its text.

    ``content`` has ``org, folder, document_name, summary_text, faq_text,
    questions_text``; absent kinds are null.
    """
    entries = F.array(*[
        F.struct(F.lit(kind).alias("content_type"), F.col(column).alias("content"))
        for kind, column in (("summary", "summary_text"), ("faq", "faq_text"), ("questions", "questions_text"))
    ])
    return content.select("org", "folder", "document_name", F.explode(entries).alias("e")).select(
        "org", "folder", "document_name", "e.*").filter(F.length("content") > 0)


def write_artifacts(content: DataFrame, root: str, mode: str = "append") -> None:
    """Store content under ``org=/content_type=/folder=`` with one record per document.

    Rows are gathered by folder; the rebalance splits a folder that holds much of
    the corpus over as many tasks as its size asks for.
    """
    rows = artifact_rows(content)
    rows.hint("rebalance", "org", "content_type", "folder").write.mode(mode).partitionBy(
        "org", "content_type", "folder").parquet(root)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)

