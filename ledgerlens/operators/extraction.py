"""Templates, typed records from model output, record tables and their upkeep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.functions import constants as K
from ledgerlens.functions.text import fenced_body, identifier_text, with_json_object
from ledgerlens.operators.aggregates import count_fields
from ledgerlens.operators.ordering import number_items

SYSTEM_COLUMNS = [
    "id", "organization_id", "document_id", "extraction_job_id", "source_file_path",
    "template_name", "extracted_at", "updated_at",
]


# --- schemas (driver side, a handful of fields) -----------------------------

def find_entity_field(schema: Mapping[str, Any]) -> str | None:
    """The schema's first field among the preferred entity id names."""
    by_lower: dict[str, str] = {}
    for name in schema.get("properties", {}):
        by_lower.setdefault(name.lower(), name)
    return next((by_lower[f] for f in K.ENTITY_ID_FIELDS if f in by_lower), None)


def sql_type(kind: str) -> str:
    return K.SCHEMA_TYPES.get(kind.lower(), "string")


def _flat(properties: Mapping[str, Any]) -> list[tuple[str, str]]:
    """Scalar fields and their types; arrays and objects are left out."""
    found = [(n, d.get("type", "string")) for n, d in properties.items() if n != "line_items"]
    return [(n, k) for n, k in found if k not in ("array", "object")]


def header_fields(schema: Mapping[str, Any]) -> list[tuple[str, str]]:
    return _flat(schema.get("properties", {}))


def line_item_fields(schema: Mapping[str, Any]) -> list[tuple[str, str]]:
    items = schema.get("properties", {}).get("line_items", {})
    if items.get("type") != "array":
        return []
    return _flat(items.get("items", {}).get("properties", {}))


def _text_type(definition: Mapping[str, Any]) -> T.DataType:
    """Shape of a value with every scalar read as text, so that one bad value
    cannot spoil its record."""
    kind = definition.get("type", "string")
    if kind == "array":
        return T.ArrayType(_text_type(definition.get("items", {})))
    if kind == "object":
        return _text_struct(definition)
    return T.StringType()


def _text_struct(definition: Mapping[str, Any]) -> T.StructType:
    return T.StructType([
        T.StructField(n, _text_type(d)) for n, d in definition.get("properties", {}).items()
    ])


def _typed(value: Column, definition: Mapping[str, Any]) -> Column:
    kind = definition.get("type", "string")
    if kind == "array":
        items = definition.get("items", {})
        return F.transform(value, lambda v: _typed(v, items))
    if kind == "object":
        fields = definition.get("properties", {})
        built = F.struct(*[_typed(value[n], d).alias(n) for n, d in fields.items()])
        return F.when(value.isNotNull(), built)
    return value.try_cast(sql_type(kind))


# --- templates --------------------------------------------------------------

def build_templates(fields: DataFrame, created_at: str) -> DataFrame:
    """JSON template per ``template_name, document_type, organization_id``.

    ``fields`` has one row per field: ``position, field_name, display_name,
    data_type, required, location``; line-item fields go into ``line_items``.
    """
    types = F.create_map(*[F.lit(x) for pair in K.TEMPLATE_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(types, F.lower("data_type")), F.lit("string"))
    rows = fields.withColumn("_prop", F.struct(
        kind.alias("type"), F.coalesce("display_name", "field_name").alias("description")))
    rows = rows.withColumn("_line", F.coalesce(F.col("location") == "line_item", F.lit(False)))
    entry = F.struct("position", "field_name", "_prop")
    need = F.coalesce(F.col("required"), F.lit(False))

    def listed(test: Column, value: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(test, value)))

    name = F.struct("position", "field_name")
    grouped = rows.groupBy("template_name", "document_type", "organization_id").agg(
        listed(~F.col("_line"), entry).alias("header"), listed(F.col("_line"), entry).alias("lines"),
        listed(~F.col("_line") & need, name).alias("header_required"),
        listed(F.col("_line") & need, name).alias("lines_required"),
    )

    def names(column: str) -> Column:
        return F.transform(column, lambda x: x["field_name"])

    def properties(column: str) -> Column:
        return F.map_from_entries(F.transform(column, lambda x: F.struct(x["field_name"], x["_prop"])))

    line_schema = F.struct(
        F.lit("array").alias("type"), F.lit("Line items from the document").alias("description"),
        F.struct(F.lit("object").alias("type"), properties("lines").alias("properties"),
                 names("lines_required").alias("required")).alias("items"),
    )
    header = F.transform("header", lambda x: F.struct(x["field_name"].alias("key"), F.struct(
        x["_prop"]["type"].alias("type"), x["_prop"]["description"].alias("description"),
        F.when(F.lit(False), line_schema["items"]).alias("items")).alias("value")))
    with_lines = F.when(F.size("lines") > 0, F.array(F.struct(F.lit("line_items").alias("key"), line_schema.alias("value"))))
    merged = F.concat(header, F.coalesce(with_lines, F.slice(header, 1, 0)))
    template = F.struct(
        F.lit("http://json-schema.org/draft-07/schema#").alias("$schema"), F.col("template_name").alias("title"),
        F.lit("object").alias("type"), F.map_from_entries(merged).alias("properties"),
        names("header_required").alias("required"),
        F.struct("document_type", F.lit(created_at).alias("created_at"), "organization_id",
                 F.lit("1.0").alias("version")).alias("metadata"),
    )
    return grouped.select(
        "template_name", "document_type", "organization_id", F.to_json(template).alias("template"),
        F.size("header").alias("header_fields"), F.size("lines").alias("line_item_fields"),
    )


# --- records from model output ----------------------------------------------

def extract_records(raw: DataFrame, schema: Mapping[str, Any], text: str = "response") -> DataFrame:
    """Typed ``data`` struct per model response, with what is missing.

    Fenced JSON is unwrapped, as is a ``parameters`` envelope. Bad JSON gives
    empty data with ``valid`` false; a value that does not fit its type is null.
    """
    shape = _text_struct(schema)
    # one parse reads the plain and the enveloped form
    either = T.StructType([*shape.fields, T.StructField("parameters", shape)]) if "parameters" not in shape.names else shape
    rows = raw.withColumn("_body", fenced_body(F.col(text)))
    rows = with_json_object(rows, "_body", either, "_e", "valid")
    plain = F.struct(*[F.col(f"_e.`{n}`").alias(n) for n in shape.names])
    if either is not shape:
        plain = F.coalesce("_e.parameters", plain)
    rows = rows.withColumn("_p", F.when(F.col("valid"), plain))
    fields = []
    for name, definition in schema.get("properties", {}).items():
        value = _typed(F.col(f"_p.`{name}`"), definition)
        if definition.get("type") == "array":
            empty = F.array().cast(_ddl(definition))
            value = F.coalesce(value, empty)
        fields.append(value.alias(name))
    rows = rows.withColumn("data", F.struct(*fields))
    missing = F.array_compact(F.array(*[
        F.when(_absent(F.col(f"data.`{n}`"), schema["properties"].get(n, {})), F.lit(n)) for n in schema.get("required", [])
    ]).cast("array<string>"))
    rows = rows.withColumn("missing_required", missing)
    counted = rows.withColumn("extracted_fields", count_fields(rows.schema["data"].dataType, F.col("data")))
    return counted.drop("_body", "_e", "_p")


def _absent(value: Column, definition: Mapping[str, Any]) -> Column:
    return F.size(value) == 0 if definition.get("type") == "array" else value.isNull()


def _ddl(definition: Mapping[str, Any]) -> str:
    kind = definition.get("type", "string")
    if kind == "array":
        return f"array<{_ddl(definition.get('items', {}))}>"
    if kind == "object":
        inner = ",".join(f"`{n}`:{_ddl(d)}" for n, d in definition.get("properties", {}).items())
        return f"struct<{inner}>"
    return sql_type(kind)


def record_id(*parts: Column) -> Column:
    """Stable id, so that a replayed batch makes the same records."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def split_records(records: DataFrame, schema: Mapping[str, Any], now: Column) -> tuple[DataFrame, DataFrame]:
    """Header rows and line-item rows numbered from 1 out of typed records.

    ``records`` has the system columns up to ``template_name`` and ``data``.
    """
    system = [c for c in SYSTEM_COLUMNS if c in records.columns]
    header = records.select(
        *system, *[now.alias(c) for c in ("extracted_at", "updated_at") if c not in system],
        *[F.col(f"data.`{n}`").alias(identifier_text(n)) for n, _ in header_fields(schema)],
    )
    wanted = line_item_fields(schema)
    lists = records.select(F.col("id").alias("parent_id"), F.col("data.line_items").alias("items"))
    numbered = number_items(lists, "items")
    items = numbered.select(
        record_id(F.col("parent_id"), F.col("line_number").cast("string")).alias("id"), "parent_id", "line_number",
        *[F.col(f"item.`{n}`").alias(identifier_text(n)) for n, _ in wanted],
    )
    return header, items


def upsert_records(
    target: DataFrame, target_items: DataFrame, batch: DataFrame, batch_items: DataFrame,
    schema: Mapping[str, Any], now: Column, order: Sequence[str] = ("extracted_at", "id"),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Header and item tables after a batch, and the action per batch record.

    Records match on organisation and entity value. A match keeps its id,
    organisation and extraction time; all other columns and all its items are
    replaced. Within the batch the last record of a key wins and takes the id
    under which the first one was inserted. Records without an entity value are
    inserted. Only (id, entity) pairs of the target are joined, so the width of
    the table does not travel.
    """
    field = find_entity_field(schema)
    entity = identifier_text(field) if field else None
    has_key = F.col(entity).isNotNull() if entity else F.lit(False)
    loose = batch.filter(~has_key)
    keyed = batch.filter(has_key)
    key = ["organization_id", entity] if entity else []
    if not entity:
        report = batch.select("id", F.col("id").alias("record_id"), F.lit("inserted").alias("action"))
        return target.unionByName(batch, allowMissingColumns=True), target_items.unionByName(
            batch_items, allowMissingColumns=True), report
    at = F.struct(*order)
    ends = keyed.groupBy(*key).agg(
        F.min_by("id", at).alias("_first"), F.max_by("id", at).alias("_last"), F.min("extracted_at").alias("_at"))
    known = target.filter(F.col(entity).isNotNull()).select(
        *key, F.col("id").alias("_old"), F.col("extracted_at").alias("_old_at"))
    plan = ends.join(known, key, "left").withColumn("_keep", F.coalesce("_old", "_first"))
    report = keyed.select("id", *key).join(plan, key).select(
        "id", F.col("_keep").alias("record_id"),
        F.when(F.col("_old").isNotNull() | (F.col("id") != F.col("_first")), "updated").otherwise("inserted").alias("action"),
    ).unionByName(loose.select("id", F.col("id").alias("record_id"), F.lit("inserted").alias("action")))
    touched = plan.select(F.col("_last").alias("id"), "_keep", "_old", F.coalesce("_old_at", "_at").alias("_old_at"),
                          (F.col("_old").isNotNull() | (F.col("_first") != F.col("_last"))).alias("_was"))
    winners = keyed.join(touched, "id").withColumn("id", F.col("_keep")).withColumn(
        "extracted_at", F.col("_old_at")).withColumn(
        "updated_at", F.when(F.col("_was"), now).otherwise(F.col("updated_at"))).select(*batch.columns)
    replaced = plan.filter(F.col("_old").isNotNull()).select(F.col("_old").alias("id"))
    header = (
        target.join(replaced, "id", "left_anti")
        .unionByName(winners, allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)
    )
    moved = touched.select(F.col("id").alias("parent_id"), "_keep")
    new_items = batch_items.join(moved, "parent_id").withColumn("parent_id", F.col("_keep")).drop("_keep")
    loose_items = batch_items.join(loose.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    items = (
        target_items.join(replaced.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")
        .unionByName(new_items, allowMissingColumns=True).unionByName(loose_items, allowMissingColumns=True)
    )
    return header, items, report


def evolve(target: DataFrame, fields: Sequence[tuple[str, str]], system: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Table with missing schema (and system) columns added as nulls; extra ones stay."""
    present = {c.lower() for c in target.columns}
    for name, kind in [*[(n, k) for n, k in system], *[(identifier_text(n), sql_type(k)) for n, k in fields]]:
        if name.lower() not in present:
            target = target.withColumn(name, F.lit(None).cast(kind))
            present.add(name.lower())
    return target


def delete_records(header: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables without the given records and their line items."""
    gone = ids.select("id").distinct()
    return header.join(gone, "id", "left_anti"), items.join(
        gone.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")


def merge_fields(header: DataFrame, items: DataFrame, key: str = "document_id") -> DataFrame:
    """Discovered fields per document from its header and line-item analysis.

    ``header`` has ``document_type, has_line_items, fields``, ``items`` has
    ``fields``; either may be absent. Line-item fields get their location forced.
    """
    left = header.select(key, "document_type", "has_line_items", F.col("fields").alias("_h"))
    right = items.select(key, F.col("fields").alias("_l"))
    kind = header.schema["fields"].dataType
    forced = F.transform("_l", lambda f: f.withField("location", F.lit("line_item")))
    empty = F.array().cast(kind)
    return left.join(right, key, "full_outer").select(
        key, F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown")).alias("document_type"),
        F.coalesce("_h", empty).alias("fields"), F.coalesce(forced, empty).alias("line_item_fields"),
        (F.coalesce("has_line_items", F.lit(False)) | (F.coalesce(F.size("_l"), F.lit(0)) > 0)).alias("has_line_items"),
        (F.coalesce(F.size("_h"), F.lit(0)) + F.coalesce(F.size("_l"), F.lit(0))).alias("total_fields"),
    )
