"""Scans, filters, profiles, registries, rankings and maintenance queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.operators import aggregates as A, filters as X, joins as J, maintenance as M, ordering as O
from ledgerlens.plans.catalog import query
from ledgerlens.plans.metering import now
from ledgerlens.plans.roles import half_up
from ledgerlens.session import shared_dir
from ledgerlens.sources import files as S

K_SQL = "json_extract_string(props, '$' || '.k')"


# --- sources ----------------------------------------------------------------

@query("s1_scan_delimited", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_delimited(t):
    path = shared_dir(t.spark, "scan") + ".csv"
    t.part.write.option("header", True).csv(path)
    return S.scan_delimited(t.spark, path).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("s1_scan_tab_separated", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_tab_separated(t):
    path = shared_dir(t.spark, "scan") + ".tsv"
    t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return S.scan_delimited(t.spark, path, t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").schema)


@query("s2_mount_files", """
SELECT 'file_0' AS view_name, COUNT(*) AS n FROM customer UNION ALL SELECT 'file_2', COUNT(*) FROM orders""")
def mount_files(t):
    views, _ = S.mount_files(t.spark, [f"{t.root}/customer.parquet", f"{t.root}/missing.csv", f"{t.root}/orders.parquet"])
    parts = [t.spark.table(v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view_name"), "n") for v in views]
    return parts[0].unionByName(parts[1])


@query("s3_file_manifest", "SELECT DISTINCT source AS folder FROM documents")
def file_manifest(t):
    """Folders found when the corpus is laid out as a tree of text files."""
    root = shared_dir(t.spark, "tree")
    t.documents.select("doc_id", "source").write.partitionBy("source").csv(root)
    files = S.file_manifest(t.spark, root, [".csv"])
    return files.filter(F.col("length") > 0).select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder")).distinct()


@query("s4_load_documents", """
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND length(text) > 0 THEN 'parsed'
                    WHEN doc_id % 2 = 0 THEN 'upload' ELSE 'not_found' END AS source_type,
       COALESCE(CASE WHEN (doc_id % 3 <> 0 AND length(text) > 0) OR doc_id % 2 = 0 THEN length(text) END, -1) AS content_length
FROM documents""")
def load_documents(t):
    d = t.documents
    path = F.concat(F.lit("org/parsed/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    parsed = d.filter(F.col("doc_id") % 3 != 0).select(path.alias("parsed_path"), F.col("text").alias("content"))
    raw = d.filter(F.col("doc_id") % 2 == 0).select(
        F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, ".md").otherwise(".txt")).alias("file_name"),
        F.col("text").alias("content"))
    wanted = d.select("doc_id", path.alias("parsed_path"), F.concat(F.col("doc_id"), F.lit(".pdf")).alias("document_name"))
    return S.load_documents(wanted, parsed, raw).select(
        "doc_id", "source_type", F.coalesce("content_length", F.lit(-1).cast("long")).alias("content_length"))


@query("s5_write_artifacts", """
SELECT source AS folder, 'summary' AS content_type, COUNT(*) AS n, CAST(SUM(length(text)) AS BIGINT) AS chars FROM documents WHERE length(text) > 0 GROUP BY source
UNION ALL SELECT source, 'faq', COUNT(*), CAST(SUM(length(lang)) AS BIGINT) FROM documents WHERE doc_id % 2 = 0 GROUP BY source
UNION ALL SELECT source, 'questions', COUNT(*), CAST(SUM(length(source)) AS BIGINT) FROM documents WHERE doc_id % 3 = 0 GROUP BY source""")
def write_artifacts(t):
    root = shared_dir(t.spark, "artifacts")
    content = t.documents.select(
        F.lit("org").alias("org"), F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("document_name"),
        F.col("text").alias("summary_text"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("faq_text"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("questions_text"))
    S.write_artifacts(content, root)
    return t.spark.read.parquet(root).groupBy("folder", "content_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


INVENTORY = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
             "embeddings", "pages", "benchmark", "conversations", "labels"]


@query("s6_table_inventory", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS rows, '{'extra' if n == 'labels' else 'present'}' AS state FROM {n}" for n in INVENTORY)
    + " UNION ALL SELECT 'invoices', -1, 'missing'")
def table_inventory(t):
    expected = t.spark.createDataFrame([(n,) for n in INVENTORY[:-1]] + [("invoices",)], "table_name string")
    out = S.table_inventory({n: t.spark.read.parquet(f"{t.root}/{n}.parquet") for n in INVENTORY}, expected)
    return out.withColumn("rows", F.coalesce("rows", F.lit(-1).cast("long")))


# --- filters ----------------------------------------------------------------

@query("f1_filter_events", """
SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' AND user_id IS NOT NULL
AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'""")
def filter_events(t):
    return X.filter_events(
        t.events, equals={"event_type": "error", "user_id": None}, ts="ts", start=dt.datetime(2024, 1, 5),
        end=dt.datetime(2024, 1, 20), not_null=["event_type"]).select("event_id", "user_id", "ts")


@query("f2_scope_match", """
SELECT q.query_id, COUNT(*) AS n FROM $answer_queries q JOIN $answer_cache c ON q.org_id = c.org_id
 AND q.folder_filter IS NOT DISTINCT FROM c.folder_filter AND q.file_filter IS NOT DISTINCT FROM c.file_filter GROUP BY 1""")
def scope_match(t):
    """Cache entries in the scope of each query: scopes are counted, then matched."""
    scope = ["org_id", "folder_filter", "file_filter"]
    counts = t.answer_cache.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    q = t.answer_queries
    return q.join(counts, X.scope_match(q, counts, [(c, c) for c in scope])).select("query_id", "n")


FOLDERS_SQL = """(SELECT 'r' || r_regionkey AS id, r_name AS folder_name, CAST(NULL AS VARCHAR) AS parent_folder_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation)"""


def folder_tree(t):
    top = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("folder_name"),
                          F.lit(None).cast("string").alias("parent_folder_id"))
    return top.unionByName(t.nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("folder_name"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_folder_id")))


@query("f3_list_children", f"SELECT id, folder_name FROM {FOLDERS_SQL} WHERE parent_folder_id = 'r2'")
def list_children(t):
    return X.list_children(folder_tree(t), parent="r2").select("id", "folder_name")


@query("f3_list_roots", f"SELECT id, folder_name FROM {FOLDERS_SQL} WHERE parent_folder_id IS NULL")
def list_roots(t):
    return X.list_children(folder_tree(t)).select("id", "folder_name")


@query("f4_search_any_column", """
SELECT DISTINCT * FROM part
WHERE contains(CAST(p_retailprice AS VARCHAR), '19') OR contains(CAST(p_retailprice AS VARCHAR), '7') OR contains(lower(CAST(p_partkey AS VARCHAR)), '19') OR contains(lower(p_name), '19') OR contains(lower(p_brand), '19')
   OR contains(lower(p_type), '19') OR contains(CAST(p_size AS VARCHAR), '19')
   OR contains(lower(CAST(p_partkey AS VARCHAR)), '7') OR contains(lower(p_name), '7') OR contains(lower(p_brand), '7')
   OR contains(lower(p_type), '7') OR contains(CAST(p_size AS VARCHAR), '7')""")
def search_any_column(t):
    return X.search_any_column(t.part, "find parts with 19 or 7")


@query("f5_project_by_words", "SELECT p_brand, p_retailprice FROM part")
def project_by_words(t):
    return X.project_by_words(t.part, "show brand, retailprice")


@query("f5_project_all", """
SELECT *, (SELECT COUNT(*) FROM part) AS total_rows FROM part ORDER BY p_partkey LIMIT 100""")
def project_all(t):
    return X.project_by_words(t.part, "list everything", ["p_partkey"])


@query("f6_filter_json", f"SELECT event_id, event_type FROM events WHERE event_type = 'click' AND {K_SQL} = '42'")
def filter_json(t):
    return X.filter_json(t.events, "props", {"k": 42}, namespace="click", namespace_col="event_type").select(
        "event_id", "event_type")


@query("f8_validate_manifest_accepted", """
SELECT doc_id FROM (SELECT doc_id, source, doc_id % 11 AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n
 FROM documents WHERE doc_id % 11 NOT IN (1, 2, 3, 4, 5) AND n_chars <= 4000) WHERE n <= 10""")
def manifest_accepted(t):
    return _manifest(t)[0].select("doc_id")


@query("f8_validate_manifest_rejected", """
WITH j AS (SELECT doc_id, source, n_chars, CASE doc_id % 11 WHEN 1 THEN 'path_traversal' WHEN 2 THEN 'bad_path' WHEN 3 THEN 'hidden'
   WHEN 4 THEN 'wrong_segment' WHEN 5 THEN 'unsupported_extension' ELSE CASE WHEN n_chars > 4000 THEN 'over_size' END END AS reason FROM documents),
 k AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM j WHERE reason IS NULL)
SELECT doc_id, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT doc_id, 'over_folder_cap' FROM k WHERE n > 10""")
def manifest_rejected(t):
    return _manifest(t)[1].select("doc_id", "reason")


def _manifest(t):
    case = F.col("doc_id") % 11
    name = F.concat(F.when(case == 3, ".").otherwise("d"), F.col("doc_id"), F.when(case == 5, ".exe").otherwise(".pdf"))
    path = F.concat(
        F.when(case == 2, "/").otherwise(""), F.lit("org/"), F.when(case == 4, "other").otherwise("summary"), F.lit("/"),
        F.when(case == 1, "..").otherwise(F.col("source")), F.lit("/"), name)
    rows = t.documents.select("doc_id", "source", F.col("n_chars").alias("length"), path.alias("path"))
    return X.validate_manifest(rows, max_bytes=4000, segment="summary", folder_cap=10, folder_cols=["source"], order=[F.col("doc_id")])


@query("f9_path_keys_of_urls", r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS bucket, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS object_key,
       split_part(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/', -1) AS file_name FROM pages""")
def path_keys_of_urls(t):
    return X.derive_path_keys(t.pages, "url").select("page_id", "bucket", "object_key", "file_name")


@query("f9_path_keys_parsed", """
SELECT doc_id, 'acme' AS org, source || '/' || lang AS folder, 'd' || doc_id || '.md' AS file_name, 'd' || doc_id AS base_name,
       '.md' AS extension, 'acme/summary/' || source || '/' || lang || '/d' || doc_id || '.md' AS content_path
FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'acme', source, 'd' || doc_id || '.md', 'd' || doc_id, '.md', 'acme/summary/' || source || '/d' || doc_id || '.md'
FROM documents WHERE doc_id % 2 = 1""")
def path_keys_parsed(t):
    even = F.col("doc_id") % 2 == 0
    path = F.concat(F.when(even, "gs://b/acme/parsed/").otherwise("acme/bulk/"), "source",
                    F.when(even, F.concat(F.lit("/"), "lang")).otherwise(""), F.lit("/d"), "doc_id", F.lit(".md"))
    return X.derive_path_keys(t.documents.select("doc_id", path.alias("p")), "p").select(
        "doc_id", "org", "folder", "file_name", "base_name", "extension", "content_path")


# --- joins ------------------------------------------------------------------

@query("j5_nest_line_items", """
SELECT o.o_orderkey AS id, CAST(0 AS INT) AS part, COUNT(l.l_orderkey) AS n_items,
  COALESCE(string_agg(l.l_linenumber || ':' || l.l_partkey, ',' ORDER BY l.l_linenumber, l.l_partkey), '') AS items
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def nest_line_items(t):
    header = t.orders.select(F.col("o_orderkey").alias("id"))
    nested = J.nest_line_items(header, t.lineitem, "id", "l_orderkey", "l_linenumber", ["l_partkey"], 10_000)
    label = F.transform("line_items", lambda i: F.concat(i["l_linenumber"], F.lit(":"), i["l_partkey"]))
    return nested.select("id", "part", F.size("line_items").cast("long").alias("n_items"), F.array_join(label, ",").alias("items"))


@query("j5_line_item_rows", """
SELECT o.o_orderkey AS id, l.l_linenumber, l.l_partkey AS part, l.l_quantity AS quantity FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def line_item_rows(t):
    rows = J.line_item_rows(t.orders.select(F.col("o_orderkey").alias("id")), t.lineitem, "id", "l_orderkey", "l_linenumber", ["l_partkey", "l_quantity"])
    return rows.select("id", "l_linenumber", F.col("item.l_partkey").alias("part"), F.col("item.l_quantity").alias("quantity"))


@query("j6_document_dossier", """
WITH docs AS (SELECT DISTINCT file_name FROM $jobs),
j AS (SELECT file_name, COUNT(*) AS n_jobs, string_agg(id || ':' || status, ',' ORDER BY started_at DESC, id DESC) AS jobs FROM $jobs GROUP BY 1),
a AS (SELECT document_name, COUNT(*) AS n_audit, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at DESC, id DESC) AS audit FROM (
      SELECT *, row_number() OVER (PARTITION BY document_name ORDER BY created_at DESC, id DESC) AS rn FROM $generations) WHERE rn <= 100 GROUP BY 1)
SELECT d.file_name, j.n_jobs, j.jobs, COALESCE(a.n_audit, 0) AS n_audit, COALESCE(a.audit, '') AS audit
FROM docs d JOIN j ON d.file_name = j.file_name LEFT JOIN a ON d.file_name = a.document_name""")
def document_dossier(t):
    docs = t.jobs.select("file_name").distinct()
    out = J.document_dossier(
        docs, t.jobs, t.generations, doc_key="file_name", job_key="file_name", job_ts="started_at", job_fields=["id", "status"],
        audit_key="document_name", audit_ts="created_at", audit_fields=["id"], trail=100, jobs_per_row=10_000)
    jobs = F.transform("jobs", lambda x: F.concat(x["id"], F.lit(":"), x["status"]))
    audit = F.transform("audit_trail", lambda x: x["id"].cast("string"))
    return out.select(
        "file_name", F.size("jobs").cast("long").alias("n_jobs"), F.array_join(jobs, ",").alias("jobs"),
        F.coalesce(F.size("audit_trail"), F.lit(0)).cast("long").alias("n_audit"),
        F.coalesce(F.array_join(audit, ","), F.lit("")).alias("audit"))


@query("j7_enrich_listing", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'uploaded' WHEN l.quality = 1 THEN 'parsed' ELSE 'failed' END AS status,
       COALESCE(l.quality = 1, FALSE) AS is_parsed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_listing(t):
    listing = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"))
    known = t.labels.select(
        F.col("doc_id").cast("string").alias("storage_path"), F.when(F.col("quality") == 1, "parsed").otherwise("failed").alias("status"),
        F.lit(None).cast("string").alias("parsed_path"), F.lit(None).cast("timestamp_ntz").alias("parsed_at"))
    return J.enrich_listing(listing, known).select("doc_id", "status", "is_parsed")


REGISTRY_SQL = """(SELECT CAST(doc_id AS VARCHAR) AS id, source AS org_id, lang AS folder_id, 'f' || (doc_id % 40) AS filename,
  doc_id % 5 <> 0 AS is_active, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 50 AS INT)) AS created_at FROM documents WHERE doc_id % 2 = 0)"""
INCOMING_SQL = """(SELECT doc_id, source AS org_id, CASE WHEN doc_id % 7 <> 1 THEN lang END AS folder_id, 'f' || (doc_id % 40) AS filename
  FROM documents)"""


def registry(t):
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 50).cast("int"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    reg = t.documents.filter(F.col("doc_id") % 2 == 0).select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("org_id"), F.col("lang").alias("folder_id"),
        F.concat(F.lit("f"), F.col("doc_id") % 40).alias("filename"), (F.col("doc_id") % 5 != 0).alias("is_active"),
        (start + minutes).alias("created_at"))
    incoming = t.documents.select(
        "doc_id", F.col("source").alias("org_id"), F.when(F.col("doc_id") % 7 != 1, F.col("lang")).alias("folder_id"),
        F.concat(F.lit("f"), F.col("doc_id") % 40).alias("filename"))
    return incoming, reg


@query("j9_match_registry", f"""
WITH r AS (SELECT * FROM {REGISTRY_SQL} WHERE is_active), i AS (SELECT * FROM {INCOMING_SQL}),
e AS (SELECT org_id, folder_id, filename, arg_min(id, (created_at, id)) AS id FROM r GROUP BY ALL),
l AS (SELECT org_id, filename, arg_min(id, (created_at, id)) AS id FROM r GROUP BY ALL)
SELECT i.doc_id, COALESCE(e.id, l.id, '') AS matched_id,
       CASE WHEN e.id IS NOT NULL THEN 'folder' WHEN l.id IS NOT NULL THEN 'name' ELSE 'new' END AS match_kind
FROM i LEFT JOIN e ON i.org_id = e.org_id AND i.folder_id = e.folder_id AND i.filename = e.filename
LEFT JOIN l ON i.org_id = l.org_id AND i.filename = l.filename""")
def match_registry(t):
    incoming, reg = registry(t)
    return J.match_registry(incoming, reg).select(
        "doc_id", F.coalesce("matched_id", F.lit("")).alias("matched_id"), "match_kind")


@query("j10_reuse_lookup", """
SELECT r.file_name, r.model, COALESCE(c.id, -1) AS result_id, c.id IS NOT NULL AS cached
FROM (SELECT DISTINCT file_name, model FROM $jobs WHERE status <> 'completed') r
LEFT JOIN (SELECT file_name, model, arg_max(id, (started_at, id)) AS id FROM $jobs WHERE status = 'completed' AND cached GROUP BY ALL) c
ON r.file_name = c.file_name AND r.model = c.model""")
def reuse_lookup(t):
    requests = t.jobs.filter(F.col("status") != "completed").select("file_name", "model").distinct()
    results = t.jobs.filter((F.col("status") == "completed") & F.col("cached"))
    hit = J.reuse_lookup(requests, results, ["file_name", "model"], "started_at", "id", ["duration_ms"])
    return hit.select("file_name", "model", F.coalesce("id", F.lit(-1).cast("long")).alias("result_id"), "cached")


@query("j11_ownership_split", """
SELECT e.event_id, CASE WHEN c.c_custkey IS NULL THEN 'not_found' WHEN c.c_nationkey % 5 <> 0 AND c.c_nationkey <> e.user_id % 25 THEN 'forbidden'
 ELSE 'ok' END AS verdict FROM events e LEFT JOIN customer c ON c.c_custkey = e.event_id % 2000""")
def ownership_split(t):
    requests = t.events.select("event_id", (F.col("event_id") % 2000).alias("store_id"), (F.col("user_id") % 25).alias("org_id"))
    owners = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).cast("long").alias("owner_org"))
    return J.ownership_split(requests, owners, "store_id", "id").select("event_id", "verdict")


# --- aggregates -------------------------------------------------------------

@query("a7_dashboard", """
WITH d AS (SELECT c_custkey AS org_id, COUNT(*) AS total_documents FROM customer GROUP BY 1),
j AS (SELECT org_id, COUNT(*) AS total_jobs, COUNT(*) FILTER (status = 'completed') AS c, COUNT(*) FILTER (status = 'processing') AS p,
  COUNT(*) FILTER (status = 'failed') AS f, COUNT(*) FILTER (cached) AS h, avg(duration_ms) AS ms
  FROM $jobs WHERE started_at >= TIMESTAMP '1997-01-01' AND started_at <= TIMESTAMP '2024-12-31' GROUP BY 1),
g AS (SELECT org_id, COUNT(*) AS total_generations, COUNT(*) FILTER (generation_type = 'summary') AS s, COUNT(*) FILTER (generation_type = 'faqs') AS f,
  COUNT(*) FILTER (generation_type = 'questions') AS q, COUNT(*) FILTER (generation_type = 'all') AS a
  FROM $generations WHERE created_at >= TIMESTAMP '1997-01-01' AND created_at <= TIMESTAMP '2024-12-31' GROUP BY 1),
k AS (SELECT org_id FROM d UNION SELECT org_id FROM j UNION SELECT org_id FROM g)
SELECT k.org_id, COALESCE(total_documents, 0) AS total_documents, COALESCE(total_jobs, 0) AS total_jobs, COALESCE(total_generations, 0) AS total_generations,
 COALESCE(j.c, 0) AS jobs_completed, COALESCE(j.p, 0) AS jobs_processing, COALESCE(j.f, 0) AS jobs_failed,
 COALESCE(g.s, 0) AS generations_summary, COALESCE(g.f, 0) AS generations_faqs, COALESCE(g.q, 0) AS generations_questions, COALESCE(g.a, 0) AS generations_all,
 CASE WHEN j.total_jobs > 0 THEN """ + half_up("j.h::DOUBLE / j.total_jobs", 4) + """ ELSE 0.0::DOUBLE END AS cache_hit_rate,
 """ + half_up("COALESCE(j.ms, 0.0::DOUBLE)", 2) + """ AS avg_processing_time_ms
FROM k LEFT JOIN d ON k.org_id = d.org_id LEFT JOIN j ON k.org_id = j.org_id LEFT JOIN g ON k.org_id = g.org_id""")
def dashboard(t):
    return A.dashboard(t.orgs, t.jobs, t.generations, dt.datetime(1997, 1, 1), dt.datetime(2024, 12, 31))


@query("a8_count_jobs", "SELECT org_id, status, COUNT(*) AS n FROM $jobs WHERE started_at >= TIMESTAMP '1998-01-01' GROUP BY ALL")
def count_jobs(t):
    return A.count_by(t.jobs, ["org_id", "status"], ts="started_at", start=dt.datetime(1998, 1, 1))


@query("a8_count_generations", "SELECT org_id, COUNT(*) AS n FROM $generations WHERE generation_type = 'summary' GROUP BY ALL")
def count_generations(t):
    return A.count_by(t.generations, ["org_id"], equals={"generation_type": "summary"})


@query("a10_folder_rollup", """
SELECT source AS folder, COUNT(*) FILTER (doc_id % 3 <> 0) AS document_count,
 CAST(COALESCE(SUM(n_chars) FILTER (doc_id % 3 <> 0), 0) AS BIGINT) AS total_size_bytes,
 CASE WHEN COUNT(*) FILTER (doc_id % 3 <> 0) = 0 THEN 'empty' WHEN COUNT(*) FILTER (doc_id % 3 <> 0) > 33 THEN 'over_cap' ELSE 'valid' END AS verdict
FROM documents GROUP BY 1""")
def folder_rollup(t):
    rows = t.documents.withColumnRenamed("source", "folder")
    return A.folder_rollup(rows, ["folder"], "n_chars", F.col("doc_id") % 3 != 0, cap=33)


@query("a11_profile", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{k}' AS data_type, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS row_count, 6 AS column_count FROM part"
    for i, (c, k) in enumerate([("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
                                ("p_size", "int"), ("p_retailprice", "double")], 1)))
def profile(t):
    return A.profile(t.part)


@query("a12_profile_by_terms", """
WITH s AS (SELECT SUM(o_totalprice) AS s, avg(o_totalprice) AS a, max(o_totalprice) AS x, min(o_totalprice) AS n,
                  CAST(SUM(o_orderkey) AS DOUBLE) AS k, CAST(SUM(o_custkey) AS DOUBLE) AS c FROM orders)
SELECT 'revenue' AS analysis, 'o_totalprice' AS column_name, """ + half_up("s", 2) + """ AS total, """ + half_up("a", 4) + """ AS average, x AS max, n AS min, TRUE AS highest FROM s
UNION ALL SELECT 'totals', 'o_orderkey', k, NULL, NULL, NULL, FALSE FROM s
UNION ALL SELECT 'totals', 'o_custkey', c, NULL, NULL, NULL, FALSE FROM s
UNION ALL SELECT 'totals', 'o_totalprice', """ + half_up("s", 2) + """, NULL, NULL, NULL, FALSE FROM s""")
def profile_by_terms(t):
    out = A.profile_by_terms(t.orders, "what is the total sales amount?")
    return out.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4))


NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a14_describe_numeric", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, COUNT({c}) AS count, {half_up(f'avg({c})', 6)} AS mean, {half_up(f'stddev_samp({c})', 6)} AS std, CAST(min({c}) AS DOUBLE) AS min,
 {half_up(f'quantile_cont({c}::DOUBLE, 0.25)', 6)} AS p25, {half_up(f'quantile_cont({c}::DOUBLE, 0.5)', 6)} AS p50,
 {half_up(f'quantile_cont({c}::DOUBLE, 0.75)', 6)} AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
    for c in NUMERIC))
def describe_numeric(t):
    out = A.describe_numeric(t.lineitem.select(*NUMERIC))
    for c in ("mean", "std", "p25", "p50", "p75"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("a15_cache_stats", """
SELECT org_id, COUNT(*) AS total_entries, CAST(SUM(hit_count) AS BIGINT) AS total_hits, min(created_at) AS oldest_entry FROM $answer_cache GROUP BY 1""")
def cache_stats(t):
    return A.cache_stats(t.answer_cache)


PROGRESS_SQL = """
SELECT bulk_job_id, COUNT(*) AS total_documents, COUNT(*) FILTER (status = 'completed') AS completed_count,
 COUNT(*) FILTER (status = 'failed') AS failed_count, COUNT(*) FILTER (status = 'skipped') AS skipped_count,
 CAST(SUM(token_usage) AS BIGINT) AS total_tokens_used, CAST(SUM(llamaparse_pages) AS BIGINT) AS total_llamaparse_pages,
 """ + half_up("COUNT(*) FILTER (status IN ('completed', 'failed', 'skipped'))::DOUBLE / COUNT(*) * 100", 1) + """ AS progress_percentage,
 COUNT(*) FILTER (status NOT IN ('completed', 'failed', 'skipped')) AS pending_count FROM $bulk_docs GROUP BY 1"""


@query("a16_job_progress", PROGRESS_SQL)
def job_progress(t):
    return A.job_progress(t.bulk_docs)


@query("a17_job_outcome", f"""
SELECT bulk_job_id, CASE WHEN failed_count = 0 THEN 'completed' WHEN completed_count > 0 THEN 'partial_failure' ELSE 'failed' END AS final_status
FROM ({PROGRESS_SQL})""")
def job_outcome(t):
    return A.job_outcome(A.job_progress(t.bulk_docs)).select("bulk_job_id", "final_status")


STAGE_TIMES = {"parse": "parse_time_ms", "index": "index_time_ms", "generation": "generation_time_ms",
               "total": "parse_time_ms + COALESCE(index_time_ms, 0) + generation_time_ms"}


@query("a18_stage_timings", "SELECT bulk_job_id, " + ", ".join(
    f"CAST(COALESCE(SUM({x}), 0) AS BIGINT) AS sum_{n}_time_ms, {half_up(f'avg({x})', 6)} AS avg_{n}_time_ms" for n, x in STAGE_TIMES.items())
    + " FROM $bulk_docs GROUP BY 1")
def stage_timings(t):
    out = A.stage_timings(t.bulk_docs)
    for n in STAGE_TIMES:
        out = out.withColumn(f"avg_{n}_time_ms", F.round(f"avg_{n}_time_ms", 6))
    return out


@query("a20_difficulty_distribution", """
SELECT toxic, COUNT(*) FILTER (doc_id % 4 = 0) AS easy, COUNT(*) FILTER (doc_id % 4 = 1 OR doc_id % 4 = 3) AS medium,
       COUNT(*) FILTER (doc_id % 4 = 2 AND quality = 1) AS hard FROM labels GROUP BY 1""")
def difficulty_distribution(t):
    case = F.col("doc_id") % 4
    label = (F.when(case == 0, "Easy").when(case == 1, "MEDIUM")
             .when((case == 2) & (F.col("quality") == 1), "hard").when(case == 2, "extreme"))
    return A.difficulty_distribution(t.labels.withColumn("difficulty", label), ["toxic"])


# --- ordering ---------------------------------------------------------------

@query("w1_latest_generation", """
SELECT document_name, generation_type, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_at FROM $generations GROUP BY 1, 2""")
def latest_generation(t):
    return O.latest_per_key(t.generations, ["document_name", "generation_type"], ["created_at", "id"], ["id", "created_at"])


@query("w2_page", """
SELECT event_id, ts, (SELECT COUNT(*) FROM events) AS total, (SELECT COUNT(*) FROM events) > 150 AS has_more
FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100""")
def page(t):
    return O.page(t.events.select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 50, 100)


@query("w3_recent_per_org", """
SELECT org_id, id, CAST(row_number() OVER w AS INT) AS recent_rank FROM $jobs QUALIFY row_number() OVER w <= 5
WINDOW w AS (PARTITION BY org_id ORDER BY started_at DESC, id DESC)""".replace(
    "QUALIFY row_number() OVER w <= 5\nWINDOW w AS (PARTITION BY org_id ORDER BY started_at DESC, id DESC)",
    "WINDOW w AS (PARTITION BY org_id ORDER BY started_at DESC, id DESC) QUALIFY row_number() OVER w <= 5"))
def recent_per_org(t):
    return O.recent_per_org(t.jobs, "org_id", "started_at", "id").select("org_id", "id", "recent_rank")


@query("w4_number_items", """
SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS INT) AS line_number, l_partkey FROM lineitem""")
def number_items(t):
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))).alias("items"))
    return O.number_items(lists, "items").select("id", "line_number", "item.l_partkey")


@query("w5_trim_history", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS fwd,
  first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lead, COUNT(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, role FROM r WHERE n <= 4 OR (lead = 'system' AND (fwd = 1 OR back <= 3)) OR (lead <> 'system' AND back <= 4)""")
def trim_history(t):
    return O.trim_history(t.conversations, "conv_id", "turn", keep=4).select("conv_id", "turn", "role")


@query("w6_digest", r"""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'AI: ' END || text[1:100] || '...', chr(10) ORDER BY turn) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6 AND role IN ('user', 'assistant') GROUP BY 1""")
def digest(t):
    return O.digest(t.conversations, "conv_id", "turn")


@query("w7_user_context", """
SELECT user_id, 'Relevant context from previous conversations:' || chr(10) || string_agg(
  '- [' || CASE WHEN quality = 0 THEN 'general' ELSE source || ', ' || lang || ', c' END || '] ' || text[1:200], chr(10) ORDER BY doc_id DESC) AS context
FROM (SELECT d.*, l.quality, d.doc_id % 50 AS user_id, row_number() OVER (PARTITION BY d.doc_id % 50 ORDER BY d.doc_id DESC) AS rn
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id) WHERE rn <= 3 GROUP BY 1""")
def user_context(t):
    topics = F.when(F.col("quality") == 1, F.array(F.col("source"), F.col("lang"), F.lit("c"), F.lit("d"))).otherwise(F.array().cast("array<string>"))
    rows = t.documents.join(t.labels, "doc_id").select(
        (F.col("doc_id") % 50).alias("user_id"), F.col("doc_id").alias("session_id"), F.col("doc_id").alias("created_at"),
        F.col("text").alias("summary"), topics.alias("key_topics"))
    return O.user_context(rows)


@query("w8_admit_uploads", """
WITH f AS (SELECT org_id, folder, file, min((ts, event_id)) AS first FROM $uploads GROUP BY ALL),
a AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY org_id, folder ORDER BY first) <= 10)
SELECT u.event_id, CASE WHEN a.first IS NULL THEN 'limit_exceeded' WHEN a.first = (u.ts, u.event_id) THEN 'added' ELSE 'exists' END AS action
FROM $uploads u LEFT JOIN a ON u.org_id = a.org_id AND u.folder = a.folder AND u.file = a.file""")
def admit_uploads(t):
    return O.admit_uploads(t.uploads, ["org_id", "folder"], "file", "ts", "event_id").select("event_id", "action")


@query("w9_dedupe_names", """
SELECT event_id, folder, CASE WHEN n = 1 THEN file ELSE replace(file, '.pdf', '_' || (n - 1) || '.pdf') END AS stored_name
FROM (SELECT *, row_number() OVER (PARTITION BY folder, file ORDER BY event_id) AS n FROM $uploads)""")
def dedupe_names(t):
    files = t.uploads.select("event_id", "folder", "file")
    bucket = F.floor(F.col("event_id") / 1_000_000)
    return O.dedupe_names(files, "folder", "file", [F.col("event_id")], bucket).select("event_id", "folder", "stored_name")


@query("w10_ready_jobs", """
SELECT bulk_job_id, COUNT(*) AS document_count, max(created_at) AS last_upload FROM $bulk_docs GROUP BY 1
HAVING COUNT(*) >= 5 AND max(created_at) < TIMESTAMP '2001-06-01' - INTERVAL 60 SECOND""")
def ready_jobs(t):
    at = F.lit("2001-06-01").cast("timestamp_ntz")
    return O.ready_jobs(t.bulk_docs, "bulk_job_id", "created_at", at, 60, 5)


# --- maintenance ------------------------------------------------------------

@query("u4_dedupe_content_groups", """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, COUNT(*) AS copies, CAST((COUNT(*) - 1) * min(strlen(text)) AS BIGINT) AS bytes_saved
FROM documents GROUP BY 1""")
def dedupe_content_groups(t):
    return M.dedupe_content(t.documents)[1].select("content_hash", "doc_id", "copies", "bytes_saved")


@query("u4_dedupe_content_kept", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def dedupe_content_kept(t):
    return M.dedupe_content(t.documents)[0].select("doc_id", "source")


@query("m1_upsert", f"""
WITH base AS (SELECT user_id, event_type, min(ts) AS created_at FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL),
allrows AS (
 SELECT user_id, event_type AS key, 0 AS n, created_at, created_at AS updated_at, CAST('0' AS VARCHAR) AS data, -1 AS eid FROM base
 UNION ALL SELECT user_id, event_type, 1, ts, ts, COALESCE(NULLIF(NULLIF({K_SQL}, '0'), ''), 'none'), event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT user_id, key, min(created_at) AS created_at, arg_max(updated_at, (n, updated_at, eid)) AS updated_at, arg_max(data, (n, updated_at, eid)) AS data
FROM allrows GROUP BY 1, 2""")
def upsert(t):
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    base = t.events.filter(F.col("ts") < cut).groupBy("user_id", F.col("event_type").alias("key")).agg(
        F.min("ts").alias("created_at")).withColumn("updated_at", F.col("created_at")).withColumn(
        "data", F.lit("0")).withColumn("eid", F.lit(-1).cast("long"))
    changes = t.events.filter(F.col("ts") >= cut).select(
        "user_id", F.col("event_type").alias("key"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
        F.get_json_object("props", "$.k").alias("data"), F.col("event_id").alias("eid"))
    return M.upsert(base, changes, ["user_id", "key"], order=["updated_at", "eid"], defaults={"data": "none"}).drop("eid")


JOB_EVENTS_SQL = f"""(SELECT user_id * 200 + CAST({K_SQL} AS BIGINT) AS job_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'other' END AS event,
  CAST(floor(value) AS BIGINT) AS duration_ms, 'out/' || event_id AS output_path, 'error ' || event_id AS error FROM events)"""


@query("m4_fold_jobs", f"""
SELECT job_id, COALESCE(arg_max(CASE event WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' ELSE 'failed' END, (ts, event_id)) FILTER (event <> 'other'), '') AS status,
 COALESCE(CAST(max(ts) FILTER (event IN ('complete', 'fail')) AS VARCHAR), '') <> '' AS ended,
 COALESCE(arg_max(output_path, (ts, event_id)) FILTER (event = 'complete'), '') AS output_path,
 COALESCE(arg_max(duration_ms, (ts, event_id)) FILTER (event = 'complete'), -1) AS duration_ms,
 COALESCE(arg_max(error, (ts, event_id)) FILTER (event = 'fail'), '') AS error_message FROM {JOB_EVENTS_SQL} GROUP BY 1""")
def fold_jobs(t):
    kind = (F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete")
            .when(F.col("event_type") == "error", "fail").otherwise("other"))
    events = t.events.select(
        (F.col("user_id") * 200 + F.get_json_object("props", "$.k").cast("long")).alias("job_id"), "event_id", "ts", kind.alias("event"),
        F.floor("value").cast("long").alias("duration_ms"), F.concat(F.lit("out/"), "event_id").alias("output_path"),
        F.concat(F.lit("error "), "event_id").alias("error"))
    blank = F.lit("")
    return M.fold_jobs(events).select(
        "job_id", F.coalesce("status", blank).alias("status"), F.col("completed_at").isNotNull().alias("ended"),
        F.coalesce("output_path", blank).alias("output_path"), F.coalesce("duration_ms", F.lit(-1)).alias("duration_ms"),
        F.coalesce("error_message", blank).alias("error_message"))


CANCEL_IDS = "(SELECT p_partkey AS id FROM part WHERE p_size <= 10)"


@query("m6_cancel_jobs", f"""
SELECT j.id, CASE WHEN c.id IS NOT NULL THEN 'cancelled' ELSE j.status END AS status,
  j.skipped_count + CASE WHEN c.id IS NOT NULL THEN (SELECT COUNT(*) FROM $bulk_docs d WHERE d.bulk_job_id = j.id AND d.status IN ('pending', 'parsing', 'indexed')) ELSE 0 END AS skipped_count
FROM $bulk_jobs j LEFT JOIN {CANCEL_IDS} c ON j.id = c.id AND j.status IN ('pending', 'processing')""")
def cancel_jobs(t):
    ids = t.part.filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("id"))
    return M.cancel_jobs(t.bulk_jobs, t.bulk_docs, ids)[0].select("id", "status", "skipped_count")


@query("m6_cancel_documents", f"""
SELECT d.id, d.bulk_job_id, CASE WHEN d.status IN ('pending', 'parsing', 'indexed') AND EXISTS (
  SELECT 1 FROM $bulk_jobs j JOIN {CANCEL_IDS} c ON j.id = c.id WHERE j.status IN ('pending', 'processing') AND j.id = d.bulk_job_id)
  THEN 'skipped' ELSE d.status END AS status FROM $bulk_docs d""")
def cancel_documents(t):
    ids = t.part.filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("id"))
    return M.cancel_jobs(t.bulk_jobs, t.bulk_docs, ids)[1].select("id", "bulk_job_id", "status")


@query("m7_retry_whole_jobs", f"""
SELECT d.id, CASE WHEN d.status = 'failed' AND c.id IS NOT NULL THEN 'pending' ELSE d.status END AS status,
  d.retry_count + CASE WHEN d.status = 'failed' AND c.id IS NOT NULL THEN 1 ELSE 0 END AS retry_count
FROM $bulk_docs d LEFT JOIN {CANCEL_IDS} c ON c.id = d.bulk_job_id""")
def retry_whole_jobs(t):
    ids = t.part.filter(F.col("p_size") <= 10).select(F.col("p_partkey").alias("id"))
    docs = M.retry_failed(t.bulk_jobs, t.bulk_docs, job_ids=ids)[1]
    return docs.select("id", "status", "retry_count")


@query("m7_retry_selected", """
SELECT j.id, CASE WHEN r.n > 0 AND j.status IN ('completed', 'failed') THEN 'processing' ELSE j.status END AS status
FROM $bulk_jobs j LEFT JOIN (SELECT bulk_job_id, COUNT(*) AS n FROM $bulk_docs WHERE status = 'failed' AND retry_count < 3 AND id % 2 = 0 GROUP BY 1) r ON r.bulk_job_id = j.id""")
def retry_selected(t):
    picked = t.bulk_docs.filter(F.col("id") % 2 == 0).select("id")
    return M.retry_failed(t.bulk_jobs, t.bulk_docs, document_ids=picked)[0].select("id", "status")


@query("m8_next_batch", """
WITH b AS (SELECT bulk_job_id, COUNT(*) FILTER (status IN ('parsing', 'indexed')) AS busy FROM $bulk_docs GROUP BY 1),
q AS (SELECT *, row_number() OVER (PARTITION BY bulk_job_id ORDER BY created_at, id) AS place FROM $bulk_docs WHERE status = 'pending')
SELECT q.id, q.bulk_job_id FROM q JOIN b ON q.bulk_job_id = b.bulk_job_id WHERE place <= 3 - busy""")
def next_batch(t):
    return M.next_batch(t.bulk_docs).select("id", "bulk_job_id")


@query("m11_apply_deltas", """
WITH d AS (SELECT user_id % 50 AS store_id, ts, event_id, CASE WHEN event_type IN ('error', 'signup') THEN -1 ELSE 1 END * CAST(floor(value) AS BIGINT) AS delta FROM events),
s AS (SELECT store_id, 20 + SUM(delta) OVER (PARTITION BY store_id ORDER BY ts, event_id) AS running, ts, event_id FROM d)
SELECT store_id, CAST(arg_max(running, (ts, event_id)) - least(0, min(running)) AS BIGINT) AS total_size_bytes FROM s GROUP BY 1
UNION ALL SELECT 1000, 20""")
def apply_deltas(t):
    deltas = t.events.select(
        (F.col("user_id") % 50).alias("store_id"), "ts", "event_id",
        (F.when(F.col("event_type").isin("error", "signup"), -1).otherwise(1) * F.floor("value")).alias("delta"))
    stores = deltas.select("store_id").distinct().union(t.spark.range(1000, 1001).select(F.col("id").alias("store_id")))
    state = stores.withColumn("total_size_bytes", F.lit(20).cast("long"))
    return M.apply_deltas(state, deltas, "store_id", "total_size_bytes", "delta", [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"))


def purged(kept, gone):
    """Kept ids and, without an id, the number of deleted rows."""
    rows = kept.select("id", F.lit(None).cast("long").alias("deleted"))
    return rows.unionByName(gone.select(F.lit(None).cast(kept.schema["id"].dataType).alias("id"), "deleted"))


DATED = "(SELECT id, org_id, folder_filter, CASE WHEN id % 11 <> 5 THEN created_at END AS created_at FROM $answer_cache)"
OWNED = "(SELECT id, CASE WHEN id % 11 <> 5 THEN org_id END AS org_id, folder_filter FROM $answer_cache)"


@query("m12_purge_expired", f"""
SELECT id, NULL::BIGINT AS deleted FROM {DATED} WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR
UNION ALL SELECT NULL, COUNT(*) FROM {DATED} WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR""")
def purge_expired(t):
    """Some entries lack a time."""
    dated = t.answer_cache.withColumn("created_at", F.when(F.col("id") % 11 != 5, F.col("created_at")))
    return purged(*M.purge_expired(dated, 168, now()))


@query("m13_clear_scope", f"""
SELECT id, NULL::BIGINT AS deleted FROM {OWNED} WHERE (org_id = 3 AND folder_filter IS NOT DISTINCT FROM 'folder') IS NOT TRUE
UNION ALL SELECT NULL, COUNT(*) FROM {OWNED} WHERE org_id = 3 AND folder_filter IS NOT DISTINCT FROM 'folder'""")
def clear_scope(t):
    """Some entries lack an organisation."""
    owned = t.answer_cache.withColumn("org_id", F.when(F.col("id") % 11 != 5, F.col("org_id")))
    return purged(*M.clear_scope(owned, 3, folder="folder"))


@query("m14_erase_user", """
SELECT 'audit' AS table_name, COUNT(*) AS deleted FROM $generations WHERE org_id = 42 UNION ALL SELECT 'usage', COUNT(*) FROM $token_usage WHERE org_id = 42""")
def erase_user(t):
    return M.erase_user({"audit": t.generations, "usage": t.token_usage}, 42, "org_id")[1]


@query("m14_purge_prefix", """
SELECT 'jobs' AS table_name, COUNT(*) AS deleted FROM $jobs WHERE file_name LIKE 'doc-1%'
UNION ALL SELECT 'generations', COUNT(*) FROM $generations WHERE document_name LIKE 'doc-1%'""")
def purge_prefix(t):
    return M.purge_prefix({"jobs": (t.jobs, "file_name"), "generations": (t.generations, "document_name")}, "doc-1")[1]


@query("m15_replace_files", """
SELECT source AS store, doc_id, 'old' AS batch FROM documents d WHERE doc_id % 3 <> 0 AND NOT EXISTS (
  SELECT 1 FROM documents n WHERE n.doc_id % 3 = 0 AND n.source = d.source AND n.doc_id % 30 = d.doc_id % 30)
UNION ALL SELECT source, doc_id, 'new' FROM documents WHERE doc_id % 3 = 0""")
def replace_files(t):
    rows = t.documents.select(F.col("source").alias("store"), (F.col("doc_id") % 30).alias("file_name"), "doc_id")
    old = rows.filter(F.col("doc_id") % 3 != 0).withColumn("batch", F.lit("old"))
    new = rows.filter(F.col("doc_id") % 3 == 0).withColumn("batch", F.lit("new"))
    return M.replace_files(old, new).select("store", "doc_id", "batch")
