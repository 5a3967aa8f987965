"""Chunking, retrieval and answer-cache queries, and the SQL-over-files suite."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.operators import retrieval as R
from ledgerlens.operators.keyword_index import KeywordIndex
from ledgerlens.plans import suite
from ledgerlens.plans.catalog import query
from ledgerlens.plans.metering import now
from ledgerlens.plans.roles import half_up
from ledgerlens.plans.texts import WS
from ledgerlens.session import shared_dir
from ledgerlens.sources.files import sql_over_files

SIZE, STEP = 64, 52
# chunk numbers are array positions, so 32 bits hold them
CHUNK_SPAN = 2 ** 32
CHUNKS_SQL = f"""(SELECT doc_id, source, i AS chunk_no, doc_id * 4294967296 + i AS chunk_id, array_to_string(w[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS chunk_text,
   len(w[i * {STEP} + 1 : i * {STEP} + {SIZE}]) AS chunk_tokens
 FROM (SELECT *, unnest(range(CASE WHEN len(w) <= {SIZE} THEN 1 ELSE CAST(ceil((len(w) - {SIZE}) / {STEP}.0::DOUBLE) AS BIGINT) + 1 END)) AS i
  FROM (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""


def chunks(t):
    made = R.chunk_documents(t.documents.select("doc_id", "source", "text"), size=SIZE, overlap=SIZE - STEP)
    return made.withColumn("chunk_id", F.col("doc_id") * CHUNK_SPAN + F.col("chunk_no"))


@query("r1_chunk_documents", f"SELECT chunk_id, source, CAST(chunk_tokens AS INT) AS chunk_tokens, md5(chunk_text) AS digest FROM {CHUNKS_SQL}")
def chunk_documents(t):
    return chunks(t).select("chunk_id", "source", "chunk_tokens", F.md5("chunk_text").alias("digest"))


@query("r2_filter_chunks", f"SELECT chunk_id FROM {CHUNKS_SQL} WHERE source = 'src3' AND doc_id % 2 = 1")
def filter_chunks(t):
    rows = chunks(t).withColumn("folder_name", F.col("source")).withColumn("folder_id", (F.col("doc_id") % 2).cast("string"))
    return R.filter_chunks(rows, folder_name="src3", folder_id="1").select("chunk_id")


BM25_SQL = f"""
q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS term FROM benchmark),
bags AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(chunk_text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS b FROM {CHUNKS_SQL}),
post AS (SELECT chunk_id, len, term, COUNT(*) AS tf FROM (SELECT chunk_id, len(b) AS len, unnest(b) AS term FROM bags)
         WHERE term IN (SELECT term FROM q) GROUP BY ALL),
dfs AS (SELECT term, COUNT(*) AS df FROM post GROUP BY 1),
st AS (SELECT COUNT(*) AS n, avg(len(b)) AS m FROM bags),
sc AS (SELECT q.query_id, p.chunk_id, {half_up("SUM(ln(1 + (st.n - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.len / st.m)))", 9)} AS score
       FROM post p JOIN dfs d ON p.term = d.term JOIN q ON q.term = p.term, st GROUP BY 1, 2),
kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc QUALIFY rank <= 10)"""


def keyword(t, k=10):
    return R.keyword_topk(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), chunks(t), k)


@query("r3_keyword_topk", f"WITH {BM25_SQL} SELECT query_id, chunk_id, rank, {half_up('score', 6)} AS score FROM kw")
def keyword_topk(t):
    return keyword(t).withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", "rank", "score")


@query("r3_keyword_index", f"WITH {BM25_SQL} SELECT query_id, chunk_id, rank, {half_up('score', 6)} AS score FROM kw")
def keyword_index(t):
    """Chunks indexed in two batches, then asked; the same answers as without an index."""
    index = KeywordIndex(t.spark, shared_dir(t.spark, "keywords"), parts=8, blocks=32)
    made = chunks(t)
    for odd in (0, 1):
        index.add(made.filter(F.col("doc_id") % 2 == odd), f"b{odd}")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return index.topk(asked, 10).withColumn("score", F.round("score", 6)).select("query_id", "chunk_id", "rank", "score")


COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
SEMANTIC_SQL = f"""(SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS s,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, v.vec_id) AS INT) AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 5 = 0 AND v.vec_id % 5 <> 0 QUALIFY rank <= 10)"""


def vectors(t):
    return t.embeddings.filter(F.col("vec_id") % 5 != 0)


def asked(t):
    return t.embeddings.filter(F.col("vec_id") % 5 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("r4_semantic_topk", f"SELECT query_id, vec_id, rank, {half_up('s', 6)} AS similarity FROM {SEMANTIC_SQL}")
def semantic_topk(t):
    return R.semantic_topk(asked(t), vectors(t), 10).withColumn("similarity", F.round("similarity", 6))


@query("r4_semantic_topk_blocks", f"SELECT query_id, vec_id, rank, {half_up('s', 6)} AS similarity FROM {SEMANTIC_SQL}")
def semantic_topk_blocks(t):
    """Many small blocks on both sides."""
    return R.semantic_topk(asked(t), vectors(t), 10, block_rows=150).withColumn("similarity", F.round("similarity", 6))


@query("r5_hybrid_topk", f"""
WITH {BM25_SQL},
sem AS (SELECT query_id // 5 AS query_id, vec_id * 4294967296 AS chunk_id, rank FROM {SEMANTIC_SQL}),
f AS (SELECT COALESCE(k.query_id, s.query_id) AS query_id, COALESCE(k.chunk_id, s.chunk_id) AS chunk_id,
  {half_up("COALESCE(1.0::DOUBLE / (60 + k.rank), 0.0::DOUBLE) + COALESCE(1.0::DOUBLE / (60 + s.rank), 0.0::DOUBLE)", 12)} AS score
 FROM kw k FULL JOIN sem s ON k.query_id = s.query_id AND k.chunk_id = s.chunk_id)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_topk(t):
    semantic = R.semantic_topk(asked(t), vectors(t), 10).select(
        F.floor(F.col("query_id") / 5).alias("query_id"), (F.col("vec_id") * CHUNK_SPAN).alias("chunk_id"), "rank")
    return R.hybrid_topk(keyword(t), semantic, 10)


@query("r6_ivf_topk_all_cells", f"SELECT query_id, vec_id, rank, {half_up('s', 6)} AS similarity FROM {SEMANTIC_SQL}")
def ivf_topk_all_cells(t):
    """With every cell probed the index is exact."""
    index, centres = R.ivf_build(vectors(t), lists=20)
    return R.ivf_topk(asked(t), index, centres, 10, nprobe=20).withColumn("similarity", F.round("similarity", 6))


@query("r6_ivf_topk")
def ivf_topk(t):
    """All vectors but the query's own row, with as many cells as a sample of queries needs for a recall of 0.95."""
    queries = t.embeddings.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index, centres = R.ivf_build(t.embeddings, lists=20)
    nprobe = R.ivf_probes(queries, index, centres, 11, 0.95)
    found = R.ivf_topk(queries, index, centres, 11, nprobe=nprobe).filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").withColumn("similarity", F.round("similarity", 6))


WHOLE_SQL = f"""(SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS s,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, v.vec_id) AS INT) AS rank
 FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY rank <= 10)"""


def every_fiftieth(t):
    return t.embeddings.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def without_own(found, k=10):
    """The best ``k`` of k + 1 without a query's own row."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@query("r4_semantic_topk_whole", f"SELECT query_id, vec_id, rank, {half_up('s', 6)} AS similarity FROM {WHOLE_SQL}")
def semantic_topk_whole(t):
    """All vectors but the query's own row."""
    return without_own(R.semantic_topk(every_fiftieth(t), t.embeddings, 11)).withColumn("similarity", F.round("similarity", 6))


@query("r5_hybrid_topk_whole", f"""
WITH {BM25_SQL},
sem AS (SELECT query_id // 50 AS query_id, vec_id * 4294967296 AS chunk_id, rank FROM {WHOLE_SQL}),
f AS (SELECT COALESCE(k.query_id, s.query_id) AS query_id, COALESCE(k.chunk_id, s.chunk_id) AS chunk_id,
  {half_up("COALESCE(1.0::DOUBLE / (60 + k.rank), 0.0::DOUBLE) + COALESCE(1.0::DOUBLE / (60 + s.rank), 0.0::DOUBLE)", 12)} AS score
 FROM kw k FULL JOIN sem s ON k.query_id = s.query_id AND k.chunk_id = s.chunk_id)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_topk_whole(t):
    semantic = without_own(R.semantic_topk(every_fiftieth(t), t.embeddings, 11)).select(
        F.floor(F.col("query_id") / 50).alias("query_id"), (F.col("vec_id") * CHUNK_SPAN).alias("chunk_id"), "rank")
    return R.hybrid_topk(keyword(t), semantic, 10)


@query("r6_ivf_topk_bounded", f"SELECT query_id, vec_id, rank, {half_up('s', 6)} AS similarity FROM {WHOLE_SQL}")
def ivf_topk_bounded(t):
    """Cells left out by bounds only: the same rows as without an index."""
    index, centres = R.ivf_build(t.embeddings)
    found, _ = R.ivf_bounded_topk(every_fiftieth(t), index, centres, 11)
    return without_own(found).withColumn("similarity", F.round("similarity", 6))


LOOKUP_SQL = f"""(SELECT q.query_id, q.org_id, q.folder_filter, b.id AS cache_id, b.s AS similarity FROM $answer_queries q LEFT JOIN (
  SELECT q.query_id, arg_max(v.id, ({COSINE}, -v.id)) AS id, max({COSINE}) AS s FROM $answer_queries q JOIN $answer_cache v
   ON q.org_id = v.org_id AND q.folder_filter IS NOT DISTINCT FROM v.folder_filter AND q.file_filter IS NOT DISTINCT FROM v.file_filter
  WHERE {COSINE} > __T__ GROUP BY 1) b ON q.query_id = b.query_id)"""
TEST_THRESHOLD = 0.3


def lookup_sql(threshold: float) -> str:
    return LOOKUP_SQL.replace("__T__", f"{threshold}::DOUBLE")


@query("r7_cache_lookup", f"SELECT query_id, COALESCE(cache_id, -1) AS cache_id, {half_up('COALESCE(similarity, -1.0)', 6)} AS similarity, cache_id IS NOT NULL AS hit FROM {lookup_sql(0.85)}")
def cache_lookup(t):
    return _looked_up(R.cache_lookup(t.answer_queries, t.answer_cache))


@query("r7_cache_lookup_loose", f"SELECT query_id, COALESCE(cache_id, -1) AS cache_id, {half_up('COALESCE(similarity, -1.0)', 6)} AS similarity, cache_id IS NOT NULL AS hit FROM {lookup_sql(TEST_THRESHOLD)}")
def cache_lookup_loose(t):
    return _looked_up(R.cache_lookup(t.answer_queries, t.answer_cache, TEST_THRESHOLD))


def _looked_up(found):
    return found.select("query_id", F.coalesce("cache_id", F.lit(-1).cast("long")).alias("cache_id"),
                        F.round(F.coalesce("similarity", F.lit(-1.0)), 6).alias("similarity"), "hit")


@query("r7_cache_hit_counts", f"""
SELECT c.id, c.hit_count + COALESCE(h.n, 0) AS hit_count FROM $answer_cache c LEFT JOIN (
 SELECT cache_id, COUNT(*) AS n FROM {lookup_sql(TEST_THRESHOLD)} WHERE cache_id IS NOT NULL GROUP BY 1) h ON h.cache_id = c.id""")
def cache_hit_counts(t):
    found = R.cache_lookup(t.answer_queries, t.answer_cache, TEST_THRESHOLD)
    return R.count_hits(t.answer_cache, found).select("id", "hit_count")


@query("r8_cache_fill", f"""
SELECT id, answer FROM $answer_cache UNION ALL
SELECT query_id + 1000000, 'new ' || query_id FROM {lookup_sql(TEST_THRESHOLD)} WHERE cache_id IS NULL AND query_id % 10 = 0""")
def cache_fill(t):
    found = R.cache_lookup(t.answer_queries, t.answer_cache, TEST_THRESHOLD)
    answers = t.answer_queries.select("query_id", F.when(F.col("query_id") % 10 == 0, F.concat(F.lit("new "), "query_id")).otherwise("").alias("answer"))
    return R.cache_fill(t.answer_cache, found, answers, F.col("query_id") + 1_000_000, now()).select("id", "answer")


@query("r9_citations", f"""
WITH {BM25_SQL} SELECT k.query_id, k.rank AS index, 'd' || c.doc_id AS title,
 CASE WHEN length(c.chunk_text) > 200 THEN left(c.chunk_text, 200) || '...' ELSE c.chunk_text END AS text_preview, md5(c.chunk_text) AS digest
FROM kw k JOIN {CHUNKS_SQL} c ON c.chunk_id = k.chunk_id""")
def citations(t):
    hits = keyword(t).join(chunks(t).select("chunk_id", F.concat(F.lit("d"), "doc_id").alias("title"), F.col("chunk_text").alias("text")), "chunk_id")
    return R.citations(hits).withColumn("digest", F.md5("full_text")).drop("full_text")


# --- SQL over files ---------------------------------------------------------

def _register(name: str, text: str) -> None:
    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))

    def run(t):
        spark_text = text.format(**{n: f"file_{i}" for i, n in enumerate(names)})
        return sql_over_files(t.spark, [f"{t.root}/{n}.parquet" for n in names], spark_text)[0]

    query(f"f7_sql_{name}", text.format(**{n: n for n in names}))(run)


for _name, _text in suite.TEXTS.items():
    _register(_name, _text)
