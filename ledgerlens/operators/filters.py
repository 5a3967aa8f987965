"""Row filters, column selection, manifest checks and path keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ledgerlens.functions import constants as K
from ledgerlens.operators.ordering import first_n


def filter_events(
    df: DataFrame, *, equals: Mapping[str, object] | None = None, ts: str | None = None,
    start=None, end=None, not_null: Sequence[str] = (),
) -> DataFrame:
    """AND of the predicates given; both time ends are inclusive. Pushes to the scan."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end))
    for name in not_null:
        df = df.filter(F.col(name).isNotNull())
    return df


def scope_match(left: DataFrame, right: DataFrame, cols: Sequence[tuple[str, str]]) -> Column:
    """Join condition where a null scope matches only a null scope."""
    condition = F.lit(True)
    for a, b in cols:
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def list_children(
    folders: DataFrame, *, org=None, parent=None, everything: bool = False,
    org_col: str = "org_id", parent_col: str = "parent_folder_id", name_col: str = "folder_name",
) -> DataFrame:
    """Children of ``parent``, or the roots without one, or all; by name."""
    if org is not None:
        folders = folders.filter(F.col(org_col) == F.lit(org))
    if not everything:
        wanted = F.col(parent_col).isNull() if parent is None else F.col(parent_col) == F.lit(parent)
        folders = folders.filter(wanted)
    return folders.orderBy(name_col)


def question_numbers(question: str) -> list[str]:
    """Whole numbers of a question, in order."""
    return re.findall(r"\b\d+\b", question)


def search_any_column(df: DataFrame, question: str | Sequence[str]) -> DataFrame:
    """Distinct rows where any column, as text, contains any of the terms."""
    terms = question_numbers(question) if isinstance(question, str) else list(question)
    hit = F.lit(False)
    for name in df.columns:
        text = F.coalesce(F.lower(F.col(name).cast("string")), F.lit(""))
        for term in terms:
            hit = hit | F.contains(text, F.lit(term.lower()))
    return df.filter(hit).dropDuplicates()


def matching_columns(columns: Sequence[str], question: str) -> list[str]:
    words = [w for w in question.lower().replace(",", " ").split() if len(w) > 2]
    return [c for c in columns if any(w in c.lower() for w in words)]


def project_by_words(
    df: DataFrame, question: str, order: Sequence[str] = (), max_rows: int = K.MAX_DISPLAY_ROWS
) -> DataFrame:
    """The columns a question names; else the first rows of all columns plus the total.

    ``order`` fixes which rows come first; without it Spark takes any.
    """
    wanted = matching_columns(df.columns, question)
    if wanted and len(wanted) < len(df.columns):
        return df.select(*wanted)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    head = df.orderBy(*order).limit(max_rows) if order else df.limit(max_rows)
    return head.select("*", total.scalar().alias("total_rows"))


def filter_json(
    df: DataFrame, data_col: str, attrs: Mapping[str, object], *,
    namespace: str | None = None, namespace_col: str = "namespace",
    limit: int | None = None, order: Sequence[Column] = (),
) -> DataFrame:
    """Rows of a namespace whose JSON holds every attribute; filters before the limit."""
    if namespace is not None:
        df = df.filter(F.col(namespace_col) == F.lit(namespace))
    for key, value in attrs.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        df = df.filter(F.get_json_object(F.col(data_col), f"$.{key}") == F.lit(text))
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


# --- paths ------------------------------------------------------------------

def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


def base_name(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start one."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def derive_path_keys(df: DataFrame, path_col: str, content_type: str = "summary") -> DataFrame:
    """Bucket, key, organisation, folder and name parts of each path.

    Organisation and folder surround the segment ``parsed``; failing that, the
    layout ``org/bulk/folder/file`` is tried; else both are empty.
    """
    path = F.col(path_col)
    has_scheme = path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    rest = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    out = df.withColumn(
        "bucket", F.when(has_scheme, F.split_part(rest, F.lit("/"), F.lit(1))).otherwise("")
    ).withColumn(
        "object_key", F.when(has_scheme, F.regexp_replace(rest, r"^[^/]*/?", "")).otherwise(path)
    )
    parts = F.split("object_key", "/")
    at = F.array_position(parts, "parsed").cast("int")
    parsed = at > 0
    bulk = F.col("object_key").rlike(r"^[^/]+/bulk/[^/]+/[^/]+$")
    name = file_name(F.col("object_key"))
    out = out.withColumn("file_name", name)
    out = out.withColumn(
        "org",
        F.when(parsed, F.array_join(F.slice(parts, F.lit(1), at - 1), "/"))
        .when(bulk, F.get(parts, F.lit(0))).otherwise(""),
    ).withColumn(
        "folder",
        F.when(parsed, F.array_join(
            F.slice(parts, at + 1, F.greatest(F.size(parts) - at - 1, F.lit(0))), "/"))
        .when(bulk, F.get(parts, F.lit(2))).otherwise(""),
    )
    suffix = ".md" if content_type == "summary" else ".json"
    target = F.filter(
        F.array(
            F.col("org"), F.lit(content_type), F.col("folder"),
            F.concat(base_name(F.col("file_name")), F.lit(suffix)),
        ),
        lambda p: p != "",
    )
    return (
        out.withColumn("extension", extension(F.col("file_name")))
        .withColumn("base_name", base_name(F.col("file_name")))
        .withColumn("content_path", F.array_join(target, "/"))
    )


def validate_manifest(
    df: DataFrame, path_col: str = "path", size_col: str | None = "length", *,
    extensions: Sequence[str] = tuple(K.FOLDER_EXTENSIONS), max_bytes: int = K.MAX_FILE_BYTES,
    skip_hidden: bool = True, segment: str | None = None, layout: str | None = None,
    folder_cap: int | None = None, folder_cols: Sequence[str] = (), order: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """Split a manifest into accepted rows and rejected rows with a ``reason``.

    ``segment`` demands that second path segment over at least four; ``layout``
    is a regex the whole path must match; with ``folder_cap`` only the first
    rows of each folder along ``order`` pass.
    """
    path = F.col(path_col)
    name = file_name(path)
    parts = F.split(path, "/")
    checks = [
        (F.contains(path, F.lit("..")), "path_traversal"),
        (path.startswith("/") | F.contains(path, F.lit("\\")), "bad_path"),
    ]
    if skip_hidden:
        checks.append((name.startswith("."), "hidden"))
    if layout is not None:
        checks.append((~path.rlike(layout), "bad_path"))
    if segment is not None:
        checks.append((F.size(parts) < 4, "bad_path"))
        checks.append((F.get(parts, F.lit(1)) != F.lit(segment), "wrong_segment"))
    checks.append((~extension(name).isin(list(extensions)), "unsupported_extension"))
    if size_col is not None:
        checks.append((F.col(size_col) > F.lit(max_bytes), "over_size"))
    reason = F.lit(None).cast("string")
    for test, label in reversed(checks):
        reason = F.when(test, F.lit(label)).otherwise(reason)
    judged = df.withColumn("reason", reason)
    ok = judged.filter(F.col("reason").isNull()).drop("reason")
    rejected = judged.filter(F.col("reason").isNotNull())
    if folder_cap is not None:
        # repeats of a path are told apart by number, so that each takes a place of its own
        repeats = Window.partitionBy(path_col).orderBy(*order, F.xxhash64(*ok.columns))
        ok = ok.withColumn("_repeat", F.row_number().over(repeats))
        keys = [path_col, "_repeat"]
        admitted = first_n(ok, folder_cols, [*order, F.col(path_col), F.col("_repeat")], folder_cap).select(*keys)
        over = ok.join(admitted, keys, "left_anti").select(*df.columns)
        rejected = rejected.unionByName(over.withColumn("reason", F.lit("over_folder_cap")))
        ok = ok.join(admitted, keys, "left_semi").select(*df.columns)
    return ok, rejected

