"""Templates, extracted records, registry and document lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import extraction as E, maintenance as M
from ledgerlens.plans.catalog import query
from ledgerlens.plans.metering import now

INVOICE = {
    "title": "invoice_template", "type": "object",
    "properties": {
        "invoice_number": {"type": "string"},
        "status": {"type": "string"},
        "total": {"type": "currency"},
        "issued": {"type": "date"},
        "priority": {"type": "integer"},
        "buyer": {"type": "object", "properties": {"id": {"type": "integer"}}},
        "line_items": {"type": "array", "items": {"type": "object", "properties": {
            "part": {"type": "integer"}, "quantity": {"type": "number"}, "flag": {"type": "string"}},
            "required": ["part"]}},
    },
    "required": ["invoice_number", "priority"],
}


def replies(t):
    """Model replies holding an order with its items, in four wrappings."""
    item = F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    lists = t.lineitem.groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", item.alias("i")))), lambda x: x["i"]).alias("line_items"))
    record = F.to_json(F.struct(
        F.concat(F.lit("INV-"), "o_orderkey").alias("invoice_number"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"),
        F.when(F.col("o_orderkey") % 3 == 0, "urgent").otherwise(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        F.struct(F.col("o_custkey").alias("id")).alias("buyer"), "line_items"))
    case = F.col("o_orderkey") % 4
    body = (
        F.when(case == 0, record).when(case == 1, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
        .when(case == 2, F.concat(F.lit('{"parameters": '), record, F.lit("}"))).otherwise(F.concat(F.lit("sorry "), record))
    )
    return t.orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", body.alias("response"))


def typed(t):
    return E.extract_records(replies(t), INVOICE)


VALID = "o_orderkey % 4 <> 3"


@query("x3_extract_records", f"""
SELECT o_orderkey, {VALID} AS valid, CASE WHEN {VALID} THEN 'INV-' || o_orderkey ELSE '' END AS invoice_number,
 CASE WHEN {VALID} THEN CAST(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(12,2)) AS DOUBLE) ELSE -1.0::DOUBLE END AS total,
 CASE WHEN {VALID} THEN CAST(o_orderdate AS DATE) ELSE DATE '1970-01-01' END AS issued,
 CASE WHEN {VALID} AND o_orderkey % 3 <> 0 THEN CAST(left(o_orderpriority, 1) AS INT) ELSE -1 END AS priority,
 CASE WHEN NOT ({VALID}) THEN 'invoice_number,priority' WHEN o_orderkey % 3 = 0 THEN 'priority' ELSE '' END AS missing,
 CASE WHEN {VALID} THEN CAST(CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 6 END + COALESCE(n, 0) AS INT) ELSE 0 END AS extracted_fields
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def extract_records(t):
    return typed(t).select(
        "o_orderkey", "valid", F.coalesce("data.invoice_number", F.lit("")).alias("invoice_number"),
        F.coalesce(F.col("data.total").cast("double"), F.lit(-1.0)).alias("total"),
        F.coalesce("data.issued", F.lit("1970-01-01").cast("date")).alias("issued"),
        F.coalesce("data.priority", F.lit(-1)).alias("priority"),
        F.array_join("missing_required", ",").alias("missing"), "extracted_fields")


def recorded(t):
    rows = typed(t).filter("valid").select(
        F.concat(F.lit("rec-"), "o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("string").alias("organization_id"),
        F.col("o_orderkey").cast("string").alias("document_id"), F.lit("job").alias("extraction_job_id"),
        F.lit("path").alias("source_file_path"), F.lit("invoice_template").alias("template_name"), "data")
    return E.split_records(rows, INVOICE, now())


@query("x4_split_header", f"""
SELECT 'rec-' || o_orderkey AS id, 'INV-' || o_orderkey AS invoice_number, o_orderstatus AS status FROM orders WHERE {VALID}""")
def split_header(t):
    return recorded(t)[0].select("id", "invoice_number", "status")


@query("x4_split_items", f"""
SELECT 'rec-' || l_orderkey AS parent_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS INT) AS line_number,
 CAST(l_partkey AS INT) AS part, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {VALID}""")
def split_items(t):
    return recorded(t)[1].select("parent_id", "line_number", "part", F.col("quantity").cast("double").alias("quantity"))


@query("a22_count_fields", f"""
SELECT o_orderkey, CASE WHEN {VALID} THEN CAST(CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 6 END + COALESCE(n, 0) AS INT) ELSE 0 END AS extracted_fields
FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def count_fields(t):
    return typed(t).select("o_orderkey", "extracted_fields")


# Old records are the even orders; the batch re-sends every third order, some
# of them twice, and adds orders without a number.
SCHEMA = {"properties": {"invoice_number": {"type": "string"}, "total": {"type": "currency"},
                         "line_items": {"type": "array", "items": {"properties": {"part": {"type": "integer"}}}}}}


def record_tables(t):
    def header(df, tag, when, number):
        return df.select(
            F.concat(F.lit(f"{tag}-"), "o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("organization_id"),
            number.alias("invoice_number"), F.floor("o_totalprice").cast("long").alias("total"), F.lit(tag).alias("source_file_path"),
            F.lit(when).cast("timestamp_ntz").alias("extracted_at"), F.lit(when).cast("timestamp_ntz").alias("updated_at"))

    def items(df):
        return t.lineitem.join(df.select("o_orderkey", "tag"), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat("tag", F.lit("-"), "l_orderkey").alias("parent_id"), "l_linenumber", "l_partkey")

    number = F.col("o_orderkey").cast("string")
    old = t.orders.filter(F.col("o_orderkey") % 2 == 0)
    again = t.orders.filter(F.col("o_orderkey") % 3 == 0)
    twice = t.orders.filter(F.col("o_orderkey") % 9 == 0)
    blank = t.orders.filter(F.col("o_orderkey") % 50 == 1)
    target = header(old, "old", "2024-01-01", number)
    batch = header(again, "b1", "2024-01-10", number).unionByName(header(twice, "b2", "2024-01-11", number)).unionByName(
        header(blank, "b3", "2024-01-12", F.lit(None).cast("string")))
    target_items = items(old.withColumn("tag", F.lit("old")))
    batch_items = items(again.withColumn("tag", F.lit("b1"))).unionByName(items(twice.withColumn("tag", F.lit("b2")))).unionByName(
        items(blank.withColumn("tag", F.lit("b3"))))
    return target, target_items, batch, batch_items


def upserted(t):
    return E.upsert_records(*record_tables(t), SCHEMA, F.lit("2024-01-31").cast("timestamp_ntz"))


@query("x6_upsert_records", """
SELECT 'old-' || o_orderkey AS id, o_custkey % 10 AS organization_id, CASE WHEN o_orderkey % 9 = 0 THEN 'b2' WHEN o_orderkey % 3 = 0 THEN 'b1' ELSE 'old' END AS source_file_path,
 TIMESTAMP '2024-01-01' AS extracted_at, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'b1-' || o_orderkey, o_custkey % 10, CASE WHEN o_orderkey % 9 = 0 THEN 'b2' ELSE 'b1' END, TIMESTAMP '2024-01-10',
 CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-10' END FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0
UNION ALL SELECT 'b3-' || o_orderkey, o_custkey % 10, 'b3', TIMESTAMP '2024-01-12', TIMESTAMP '2024-01-12' FROM orders WHERE o_orderkey % 50 = 1""")
def upsert_headers(t):
    return upserted(t)[0].select("id", "organization_id", "source_file_path", "extracted_at", "updated_at")


@query("x6_upsert_items", """
SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'old-' ELSE 'b1-' END || o_orderkey AS parent_id, l_linenumber, l_partkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
UNION ALL SELECT 'b3-' || o_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 1""")
def upsert_items(t):
    return upserted(t)[1].select("parent_id", "l_linenumber", "l_partkey")


@query("x6_upsert_report", """
SELECT action, COUNT(*) AS n FROM (
 SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM orders WHERE o_orderkey % 3 = 0
 UNION ALL SELECT 'updated' FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'inserted' FROM orders WHERE o_orderkey % 50 = 1) GROUP BY 1""")
def upsert_report(t):
    return upserted(t)[2].groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("x7_evolve", "SELECT s_suppkey, s_name, '' AS contact, -1.0::DOUBLE AS credit FROM supplier")
def evolve(t):
    out = E.evolve(t.supplier, [("Contact", "text"), ("credit", "currency"), ("s_name", "string")])
    return out.select("s_suppkey", "s_name", F.coalesce("contact", F.lit("")).alias("contact"),
                      F.coalesce(F.col("credit").cast("double"), F.lit(-1.0)).alias("credit"))


@query("x8_delete_records", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 7 <> 0")
def delete_records(t):
    header = t.orders.select(F.col("o_orderkey").alias("id"))
    items = t.lineitem.select(F.col("l_orderkey").alias("parent_id"), "l_linenumber", "l_partkey")
    gone = t.orders.filter(F.col("o_orderkey") % 7 == 0).select(F.col("o_orderkey").alias("id"))
    return E.delete_records(header, items, gone)[1].withColumnRenamed("parent_id", "l_orderkey")


@query("x1_build_templates", """
SELECT p_brand AS template_name, 'doc' AS document_type, COUNT(*) FILTER (p_size <= 25) AS properties, COUNT(*) FILTER (p_size > 25) AS line_properties,
 COUNT(*) FILTER (p_size <= 25 AND p_size % 2 = 0) AS required, COALESCE(string_agg('f' || p_partkey, ',' ORDER BY p_partkey) FILTER (p_size <= 25), '') AS names
FROM part GROUP BY 1""")
def build_templates(t):
    types = F.array(*[F.lit(x) for x in ("Text", "currency", "date", "bool", "odd")])
    fields = t.part.select(
        F.col("p_brand").alias("template_name"), F.lit("doc").alias("document_type"), F.lit("o").alias("organization_id"),
        F.col("p_partkey").alias("position"), F.concat(F.lit("f"), "p_partkey").alias("field_name"), F.col("p_name").alias("display_name"),
        F.get(types, (F.col("p_partkey") % 5).cast("int")).alias("data_type"), (F.col("p_size") % 2 == 0).alias("required"),
        F.when(F.col("p_size") > 25, "line_item").otherwise("header").alias("location"))
    made = E.build_templates(fields, "2024-01-31T00:00:00")
    doc = F.from_json("template", "properties map<string,struct<type:string,items:struct<properties:map<string,struct<type:string>>>>>, required array<string>")
    rows = made.withColumn("d", doc)
    names = F.filter(F.map_keys("d.properties"), lambda n: n != "line_items")
    lines = F.try_element_at("d.properties", F.lit("line_items"))["items"]["properties"]
    return rows.select(
        "template_name", "document_type", F.size(names).cast("long").alias("properties"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("line_properties"),
        F.size("d.required").cast("long").alias("required"), F.array_join(names, ",").alias("names"))


@query("x9_merge_fields", """
SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE lang END AS document_type,
 (doc_id % 5 <> 0 AND doc_id % 4 = 0) OR doc_id % 3 = 0 AS has_line_items, CAST(CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS total_fields,
 CASE WHEN doc_id % 3 = 0 THEN 'line_item' ELSE '' END AS location FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 = 0""")
def merge_fields(t):
    field = F.array(F.struct(F.col("source").alias("field_name"), F.lit("header").alias("location")))
    header = t.documents.filter(F.col("doc_id") % 5 != 0).select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("document_type"), (F.col("doc_id") % 4 == 0).alias("has_line_items"), field.alias("fields"))
    items = t.documents.filter(F.col("doc_id") % 3 == 0).select(F.col("doc_id").alias("document_id"), field.alias("fields"))
    out = E.merge_fields(header, items)
    return out.select("document_id", "document_type", "has_line_items", "total_fields",
                      F.coalesce(F.get("line_item_fields", F.lit(0))["location"], F.lit("")).alias("location"))


# --- registry and lifecycle -------------------------------------------------

def document_registry(t):
    d = t.documents.filter(F.col("doc_id") % 2 == 0)
    path = F.concat(F.lit("gs://bucket/"), "source", F.lit("/"), "doc_id", F.lit(".pdf"))
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    return d.select(
        F.concat(F.lit("reg-"), "doc_id").alias("id"), F.sha2(path, 256).alias("file_hash"), path.alias("storage_path"),
        F.concat(F.lit("f"), "doc_id").alias("filename"), F.lit("pdf").alias("file_type"), F.col("n_chars").alias("file_size"),
        F.col("source").alias("org_id"), F.col("lang").alias("folder_id"), F.when(F.col("doc_id") % 4 == 0, "parsed").otherwise("failed").alias("status"),
        F.lit(None).cast("string").alias("parsed_path"), F.lit(None).cast("timestamp_ntz").alias("parsed_at"),
        (F.col("doc_id") % 6 != 0).alias("is_active"), at.alias("created_at"), at.alias("updated_at"))


@query("m2_register_uploads", """
WITH base AS (SELECT doc_id, doc_id % 2 = 0 AS old, doc_id % 6 <> 0 AS active FROM documents)
SELECT CASE WHEN old THEN 'reg-' || doc_id ELSE sha256('gs://bucket/new/' || doc_id || '.pdf') END AS id,
 CASE WHEN old AND active AND doc_id % 3 = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'parsed' ELSE 'uploaded' END
      WHEN old THEN CASE WHEN doc_id % 4 = 0 THEN 'parsed' ELSE 'failed' END ELSE 'uploaded' END AS status,
 CASE WHEN old AND active AND doc_id % 3 = 1 OR NOT old THEN CAST(7 AS BIGINT) ELSE -1 END AS new_size
FROM base WHERE old OR doc_id % 3 = 1
UNION ALL SELECT sha256('gs://bucket/new/' || doc_id || '.pdf'), 'uploaded', 7 FROM base WHERE old AND NOT active AND doc_id % 3 = 1""")
def register_uploads(t):
    uploads = t.documents.filter(F.col("doc_id") % 3 == 1).select(
        F.concat(F.lit("new/"), "doc_id", F.lit(".pdf")).alias("file_path"), F.concat(F.lit("f"), "doc_id").alias("filename"),
        F.lit(7).cast("long").alias("file_size"), F.col("source").alias("org_id"), F.col("lang").alias("folder_id"),
        F.lit("2024-01-31").cast("timestamp_ntz").alias("uploaded_at"))
    out = M.register_uploads(document_registry(t), uploads, "bucket")
    fresh = F.col("updated_at") == F.lit("2024-01-31").cast("timestamp_ntz")
    return out.select("id", "status", F.when(fresh, F.col("file_size")).otherwise(-1).alias("new_size"))


@query("m3_register_parsed", """
WITH base AS (SELECT doc_id, lang, doc_id % 2 = 0 AS old, doc_id % 6 <> 0 AS active, doc_id % 5 = 0 AS hit FROM documents)
SELECT CASE WHEN old THEN 'reg-' || doc_id ELSE sha256('gs://bucket/new/' || doc_id || '.pdf') END AS id,
 CASE WHEN hit AND (active OR NOT old) THEN 'parsed' WHEN doc_id % 4 = 0 THEN 'parsed' ELSE 'failed' END AS status,
 CASE WHEN hit AND (active OR NOT old) THEN 'p/' || doc_id ELSE '' END AS parsed_path,
 CASE WHEN hit AND (active OR NOT old) THEN 'moved' ELSE lang END AS folder_id
FROM base WHERE old OR hit
UNION ALL SELECT sha256('gs://bucket/new/' || doc_id || '.pdf'), 'parsed', 'p/' || doc_id, 'moved' FROM base WHERE old AND hit AND NOT active""")
def register_parsed(t):
    parsed = t.documents.filter(F.col("doc_id") % 5 == 0).select(
        F.concat(F.lit("gs://bucket/new/"), "doc_id", F.lit(".pdf")).alias("storage_path"), F.concat(F.lit("f"), "doc_id").alias("filename"),
        F.col("source").alias("org_id"), F.lit("moved").alias("folder_id"), F.concat(F.lit("p/"), "doc_id").alias("parsed_path"),
        F.lit(5).cast("long").alias("file_size"), F.lit("2024-01-31").cast("timestamp_ntz").alias("parsed_at"))
    out = M.register_parsed(document_registry(t), parsed, "bucket")
    return out.select("id", "status", F.coalesce("parsed_path", F.lit("")).alias("parsed_path"), "folder_id")


@query("m5_advance_documents", """
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'skipped' WHEN o_orderkey % 10 = 2 THEN 'failed' WHEN o_orderkey % 10 = 3 THEN 'skipped'
      WHEN o_orderkey % 3 <> 0 THEN 'completed' WHEN o_orderkey % 10 = 4 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN o_orderkey % 10 = 0 THEN 'bad file' WHEN o_orderkey % 10 IN (1, 3) THEN 'Job cancelled' WHEN o_orderkey % 10 = 2 THEN 'Index timeout'
      WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 = 4 THEN 'no model' ELSE '' END AS error_message,
 CAST(CASE WHEN o_orderkey % 10 IN (0, 1, 2) THEN -1 ELSE 10 + 20 + CASE WHEN o_orderkey % 10 <> 3 AND o_orderkey % 3 = 0 THEN 30 ELSE 0 END END AS INT) AS total_time_ms,
 CAST(CASE WHEN o_orderkey % 10 > 4 AND o_orderkey % 3 = 0 THEN 9 ELSE 0 END AS INT) AS token_usage FROM orders""")
def advance_documents(t):
    case = F.col("id") % 10
    o = t.orders.select(F.col("o_orderkey").alias("id"))
    none = F.lit(None).cast("string")
    docs = o.select("id", (F.col("id") % 3 == 0).alias("generate_summary"), F.lit(False).alias("generate_faqs"), F.lit(False).alias("generate_questions"))
    parsed = o.select("id", (case != 0).alias("ok"), F.when(case == 0, "bad file").alias("error"), F.lit(10).alias("parse_time_ms"),
                      F.lit("p").alias("parsed_path"), F.lit("h").alias("content_hash"), F.lit(1).alias("llamaparse_pages"))
    indexed = o.select("id", (case != 2).alias("ok"), F.when(case == 2, "Index timeout").alias("error"), F.lit(20).alias("index_time_ms"))
    generated = o.select("id", (case != 4).alias("ok"), F.when(case == 4, "no model").otherwise(none).alias("error"),
                         F.lit(30).alias("generation_time_ms"), F.lit(9).alias("token_usage"))
    cancelled = o.filter(case.isin(1, 3)).select("id", F.when(case == 1, "index").otherwise("generate").alias("before_stage"))
    out = M.advance_documents(docs, parsed, indexed, generated, cancelled)
    return out.select("id", "status", F.coalesce("error_message", F.lit("")).alias("error_message"),
                      F.coalesce("total_time_ms", F.lit(-1)).alias("total_time_ms"), "token_usage")
