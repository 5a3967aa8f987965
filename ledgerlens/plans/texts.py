"""Corpus, conversation and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ledgerlens.functions import constants as K
from ledgerlens.operators import aggregates as A, joins as J, textjobs as X
from ledgerlens.plans.catalog import query
from ledgerlens.plans.roles import half_up

# white space as Unicode sees it, for an engine whose \s is ASCII
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '{WS}'), lambda w: w <> ''))"


def tokens_sql(text: str) -> str:
    return f"CAST(floor({words_sql(text)} * 1.3::DOUBLE) AS BIGINT)"


@query("t1_estimate_tokens", f"""
SELECT source, COUNT(*) AS documents, CAST(SUM({tokens_sql('text')}) AS BIGINT) AS tokens FROM documents GROUP BY 1""")
def estimate_tokens(t):
    return X.estimate_tokens(t.documents, "text", ["source"])


@query("t2_conversation_cost", f"""
WITH m AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'gpt-5-mini' WHEN 1 THEN 'gemini-2.5-flash-002' ELSE 'none' END AS model, role, {tokens_sql('text')} AS n FROM conversations),
s AS (SELECT conv_id, model, CAST(COALESCE(SUM(n) FILTER (role <> 'assistant'), 0) AS BIGINT) AS prompt_tokens,
             CAST(COALESCE(SUM(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS completion_tokens FROM m GROUP BY 1, 2)
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
 {half_up('''prompt_tokens * (CASE model WHEN 'gpt-5-mini' THEN 0.25 WHEN 'none' THEN 0.10 ELSE 0.075 END)::DOUBLE / 1000000.0::DOUBLE
  + completion_tokens * (CASE model WHEN 'gpt-5-mini' THEN 2.0 WHEN 'none' THEN 0.30 ELSE 0.30 END)::DOUBLE / 1000000.0::DOUBLE''', 8)} AS estimated_cost_usd FROM s""")
def conversation_cost(t):
    model = F.when(F.col("conv_id") % 3 == 0, "gpt-5-mini").when(F.col("conv_id") % 3 == 1, "gemini-2.5-flash-002").otherwise("none")
    return X.conversation_cost(t.conversations.withColumn("model", model), J.fuzzy_prices(t.spark), "conv_id")


@query("t3_estimate_generation", f"""
SELECT doc_id, CAST({words_sql('text')} * 2 + (doc_id % 4) * 100 + (doc_id % 3) * 100 AS BIGINT) AS token_usage,
  CAST(({words_sql('text')} * 2 + (doc_id % 4) * 100 + (doc_id % 3) * 100) // 2 AS BIGINT) AS input_tokens,
  CAST(({words_sql('text')} * 2 + (doc_id % 4) * 100 + (doc_id % 3) * 100) // 2 AS BIGINT) AS output_tokens FROM documents""")
def estimate_generation(t):
    return X.estimate_generation(t.documents, "text", F.col("doc_id") % 4, F.col("doc_id") % 3).select(
        "doc_id", "token_usage", "input_tokens", "output_tokens")


@query("t4_size_corpus", """
SELECT source, COUNT(*) AS documents, CAST(SUM(n) AS BIGINT) AS characters, CAST(SUM(greatest(1, n // 3000)) AS BIGINT) AS pages,
 """ + ", ".join(f"COUNT(*) FILTER (n > {c}) AS cut_at_{c}, CAST(COALESCE(SUM(n - {c}) FILTER (n > {c}), 0) AS BIGINT) AS lost_at_{c}"
                 for c in K.TRUNCATE_AT) + """, CAST(SUM(least(n, 500)) AS BIGINT) AS preview_characters
FROM (SELECT source, length(text) AS n FROM documents) GROUP BY 1""")
def size_corpus(t):
    return X.size_corpus(t.documents, "text", ["source"])


# Boundaries of the product are Unicode-aware and the oracle's are ASCII, so the
# oracle writes \b as "no word character of any script on this side".
def _census(kind: str, pattern: str) -> str:
    return f"SELECT source, '{kind}' AS pii_type, CAST(SUM(len(regexp_extract_all(text, '{pattern}'))) AS BIGINT) AS matches FROM documents GROUP BY 1"


@query("a19_pii_census", " UNION ALL ".join(
    _census(k, "(?i)" + K.PII_PATTERNS[k].replace("'", "''")) for k in K.PII_PATTERNS))
def pii_census(t):
    return A.pii_census(t.documents, "text", ["source"])


@query("t6_pii_types", """
SELECT doc_id, pii_type, CAST(n AS BIGINT) AS n FROM (
""" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pii_type, len(regexp_extract_all(text, '(?i){K.PII_PATTERNS[k]}')) AS n FROM documents"
                         for k in K.PII_PATTERNS) + ") WHERE n > 0")
def pii_types(t):
    spans = X.detect_pii(t.documents, "doc_id", "text")
    return spans.groupBy("doc_id", "pii_type").agg(F.count(F.lit(1)).alias("n"))


def _spans_sql(kind: str, pattern: str) -> str:
    hits = f"regexp_extract_all(text, '(?i){pattern}')"
    return f"""
SELECT doc_id, '{kind}' AS pii_type, value, CAST(e - length(value) AS INT) AS start, CAST(e AS INT) AS "end" FROM (
  SELECT doc_id, value, SUM(gap + length(value)) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM (
    SELECT doc_id, unnest({hits}) AS value, unnest(list_transform(string_split_regex(text, '(?i){pattern}')[1:len({hits})], lambda g: length(g))) AS gap,
      unnest(range(1, len({hits}) + 1)) AS n FROM documents))"""


@query("t6_pii_spans", " UNION ALL ".join(_spans_sql(k, p) for k, p in (K.PII_PATTERNS | {"benchmark_word": r"\bthe\s+and\b"}).items()))
def pii_spans(t):
    return X.detect_pii(t.documents, "doc_id", "text", custom={"benchmark_word": r"\bthe\s+and\b"})


@query("t7_redact_native", f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i){K.PII_PATTERNS['email']}', '[EMAIL_REDACTED]', 'g'),
   '(?i){K.PII_PATTERNS['ip_address']}', '[IP_ADDRESS_REDACTED]', 'g')) AS digest FROM documents""")
def redact_native(t):
    return X.redact_native(t.documents, "text", ["email", "ip_address"]).select("doc_id", F.md5("scrubbed").alias("digest"))


@query("t7_scrub_redact", f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i){K.PII_PATTERNS['email']}', '[EMAIL_REDACTED]', 'g'),
   '(?i){K.PII_PATTERNS['ip_address']}', '[IP_ADDRESS_REDACTED]', 'g')) AS digest FROM documents""")
def scrub_redact(t):
    return X.scrub_pii(t.documents, "text", "redact", ["email", "ip_address"]).select("doc_id", F.md5("scrubbed").alias("digest"))


@query("t7_scrub_mask_email", """
SELECT doc_id, md5(regexp_replace(text, '(?i)\\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})\\b', '\\1***@\\2', 'g')) AS digest FROM documents""")
def scrub_mask_email(t):
    return X.scrub_pii(t.documents, "text", "mask", ["email"]).select("doc_id", F.md5("scrubbed").alias("digest"))


def _scrub_sql(replacement: str) -> str:
    """All six types at once: matches in order of start, longest first, then type; later ones that overlap are left out."""
    found = " UNION ALL ".join(
        f"SELECT *, {n} AS rank FROM ({_spans_sql(k, p)})" for n, (k, p) in enumerate(K.PII_PATTERNS.items()))
    return f"""
WITH RECURSIVE s AS ({found}),
o AS (SELECT doc_id, start, "end" AS e, value, pii_type, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
  row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, rank) AS n FROM s),
r AS (
  SELECT doc_id, 0::BIGINT AS n, 0 AS done, '' AS body FROM documents
  UNION ALL
  SELECT q.doc_id, q.n, CASE WHEN q.taken THEN q.e ELSE q.done END,
    CASE WHEN q.taken THEN q.body || substr(q.text, q.done + 1, q.start - q.done) || {replacement} ELSE q.body END
  FROM (SELECT o.*, r.done, r.body, d.text, o.start >= r.done AND o.e > o.start AS taken
        FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1 JOIN documents d ON d.doc_id = r.doc_id) q)
SELECT d.doc_id, md5(f.body || substr(d.text, f.done + 1)) AS digest
FROM documents d JOIN (SELECT doc_id, arg_max(done, n) AS done, arg_max(body, n) AS body FROM r GROUP BY 1) f ON f.doc_id = d.doc_id"""


MASK_SQL = """CASE
  WHEN pii_type = 'email' AND len(string_split(value, '@')) = 2 THEN left(value, 1) || '***@' || split_part(value, '@', 2)
  WHEN pii_type = 'phone' AND length(digits) >= 4 THEN '***-***-' || right(digits, 4)
  WHEN pii_type = 'ssn' AND length(digits) = 9 THEN '***-**-' || right(digits, 4)
  WHEN pii_type = 'credit_card' AND length(digits) >= 4 THEN '****-****-****-' || right(digits, 4)
  WHEN pii_type = 'ip_address' AND len(string_split(value, '.')) = 4 THEN '***.***' || split_part(value, '.', 3) || '.' || split_part(value, '.', 4)
  WHEN length(value) > 2 THEN left(value, 1) || repeat('*', length(value) - 2) || right(value, 1) ELSE repeat('*', length(value)) END"""


@query("t7_scrub_hash", _scrub_sql("'[HASH:' || left(sha256(value), 12) || ']'"))
def scrub_hash(t):
    return X.scrub_pii(t.documents, "text", "hash").select("doc_id", F.md5("scrubbed").alias("digest"))


@query("t7_scrub_mask", _scrub_sql(MASK_SQL))
def scrub_mask(t):
    return X.scrub_pii(t.documents, "text", "mask").select("doc_id", F.md5("scrubbed").alias("digest"))


@query("t7_scrub_redact_all", _scrub_sql("'[' || upper(pii_type) || '_REDACTED]'"))
def scrub_redact_all(t):
    return X.scrub_pii(t.documents, "text").select("doc_id", F.md5("scrubbed").alias("digest"))


@query("t7_block", """
SELECT doc_id, concat_ws(',', """ + ", ".join(
    f"CASE WHEN regexp_matches(text, '(?i){K.PII_PATTERNS[k]}') THEN '{k}' END" for k in K.PII_PATTERNS) + """) AS pii_types
FROM documents WHERE """ + " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in K.PII_PATTERNS.values()))
def block_pii(t):
    return X.block_pii(t.documents, "text")[1].select("doc_id", F.array_join("pii_types", ",").alias("pii_types"))


def _count_sql(patterns) -> str:
    return " + ".join(f"CAST(regexp_matches(q, '{p}') AS INT)" for p in patterns)


INTENT_SQL = f"""
SELECT conv_id, turn, CASE WHEN q = '' THEN 'mixed' WHEN conv >= 1 THEN 'conversational'
 WHEN gen >= 2 AND gen > rag THEN 'content_generation' WHEN rag >= 2 AND rag > gen THEN 'rag_search'
 WHEN load >= 1 AND rag = 0 AND gen = 0 THEN 'document_load' WHEN gen = 1 AND rag = 0 THEN 'content_generation' ELSE 'rag_search' END AS intent
FROM (SELECT conv_id, turn, q, {_count_sql(K.CONVERSATIONAL_PATTERNS)} AS conv, {_count_sql(K.RAG_PATTERNS)} + CAST(turn % 2 = 0 AS INT) AS rag,
  {_count_sql(K.GENERATION_PATTERNS)} AS gen, {_count_sql(K.LOAD_PATTERNS)} AS load
  FROM (SELECT conv_id, turn, trim(lower(words)) AS q FROM (
    SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'please summarize and create a FAQ: ' WHEN 1 THEN 'what did I ask? ' WHEN 2 THEN 'find out who wrote: '
       WHEN 3 THEN 'open ' WHEN 4 THEN 'Generate ' ELSE '' END || text AS words FROM conversations)))"""


def utterances(t):
    case = (F.col("conv_id") + F.col("turn")) % 6
    lead = (F.when(case == 0, "please summarize and create a FAQ: ").when(case == 1, "what did I ask? ").when(case == 2, "find out who wrote: ")
            .when(case == 3, "open ").when(case == 4, "Generate ").otherwise(""))
    rows = t.conversations.withColumn("utterance", F.concat(lead, "text"))
    return X.classify_intent(rows, F.col("utterance"), organisation=F.col("turn") % 2 == 0)


@query("t8_classify_intent", INTENT_SQL)
def classify_intent(t):
    return utterances(t).select("conv_id", "turn", "intent")


@query("t8_intent_tools", f"""
SELECT i.intent, i.utterances, COALESCE(m.tool, '') AS tool FROM (SELECT intent, COUNT(*) AS utterances FROM ({INTENT_SQL}) GROUP BY 1) i
LEFT JOIN (VALUES """ + ", ".join(f"('{i}', '{tool}')" for i, names in K.INTENT_TOOLS.items() for tool in names) + ") AS m(intent, tool) ON i.intent = m.intent")
def intent_tools(t):
    return X.intent_tools(utterances(t)).withColumn("tool", F.coalesce("tool", F.lit("")))


def ident_sql(text: str, cut: int) -> str:
    base = f"regexp_replace(regexp_replace(trim(lower({text})), '[\\s\\-]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
    return f"left(CASE WHEN regexp_matches({base}, '^[0-9]') THEN '_' || {base} ELSE {base} END, {cut})"


RAW_ORG = "replace(p_brand, '#', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '_' END)"


@query("t11_normalise_names", f"""
SELECT p_partkey, regexp_replace(lower(org), '[ \\-_]+', '_', 'g') || '_file_search_store' AS store_name,
 {ident_sql('org', 25)} || '_' || {ident_sql("trim(replace(replace(lower(p_type || '_Template'), '_template', ''), 'template', ''), '_')", 30)} AS table_name
FROM (SELECT p_partkey, p_type, {RAW_ORG} AS org FROM part)""")
def normalise_names(t):
    return X.normalise_names(raw_orgs(t), "org", "template").select("p_partkey", "store_name", "table_name")


def raw_orgs(t):
    mark = F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, " ").otherwise("_")
    return t.part.select("p_partkey", F.replace("p_brand", F.lit("#"), mark).alias("org"), F.concat("p_type", F.lit("_Template")).alias("template"))


@query("t11_name_collisions", f"""
SELECT regexp_replace(lower(org), '[ \\-_]+', '_', 'g') || '_file_search_store' AS store_name, COUNT(DISTINCT org) AS sources
FROM (SELECT {RAW_ORG} AS org FROM part) GROUP BY 1 HAVING COUNT(DISTINCT org) > 1""")
def name_collisions(t):
    return X.name_collisions(X.normalise_names(raw_orgs(t), "org"), "store_name", ["org"]).select("store_name", "sources")


RESPONSE_CASES = 5


def responses(t):
    """Provider responses built from events, one shape per remainder."""
    n = F.floor("value").cast("long")
    case = F.col("event_id") % RESPONSE_CASES
    text = F.format_string
    body = (
        F.when(case == 0, text('{"model": "gpt-4o", "usage": {"prompt_tokens": %d, "completion_tokens": 7, "total_tokens": 0, "prompt_tokens_details": {"cached_tokens": 3}}}', n))
        .when(case == 1, text('{"model": "gemini-2.5-pro", "usage_metadata": {"prompt_token_count": %d, "candidates_token_count": 5, "total_token_count": 9}}', n))
        .when(case == 2, text('{"usageMetadata": {"promptTokenCount": %d, "candidatesTokenCount": 2}}', n))
        .when(case == 3, text('{"llm_output": {"token_usage": {"prompt_tokens": %d, "completion_tokens": 1, "total_tokens": 4}, "model_name": "gpt-5-mini"}}', n))
        .otherwise(text('{"content": "some words %d here"}', n))
    )
    return t.events.select("event_id", body.alias("response"))


@query("t12_extract_usage", """
SELECT event_id,
 CASE event_id % 5 WHEN 4 THEN 0 ELSE n END AS input_tokens, CAST(CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 5 END AS BIGINT) AS output_tokens,
 CASE event_id % 5 WHEN 0 THEN n + 7 WHEN 1 THEN 9 WHEN 2 THEN n + 2 WHEN 3 THEN 4 ELSE 5 END AS total_tokens,
 CAST(CASE event_id % 5 WHEN 0 THEN 3 ELSE 0 END AS BIGINT) AS cached_tokens,
 CASE event_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'google' WHEN 2 THEN 'google' WHEN 3 THEN 'openai' ELSE '' END AS provider,
 CASE event_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-2.5-pro' WHEN 2 THEN 'unknown' WHEN 3 THEN 'gpt-5-mini' ELSE '' END AS model
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events)""")
def extract_usage(t):
    used = X.extract_usage(responses(t))
    return used.select("event_id", "input_tokens", "output_tokens", "total_tokens", "cached_tokens",
                       F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("model", F.lit("")).alias("model"))


@query("t12_usage_by_model", """
SELECT CASE event_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gemini-2.5-pro' WHEN 3 THEN 'gpt-5-mini' ELSE 'unknown' END AS model, COUNT(*) AS responses,
 CAST(SUM(CASE event_id % 5 WHEN 0 THEN n + 7 WHEN 1 THEN 9 WHEN 2 THEN n + 2 WHEN 3 THEN 4 ELSE 5 END) AS BIGINT) AS total_tokens
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events) GROUP BY 1""")
def usage_by_model(t):
    return X.usage_by_model(X.extract_usage(responses(t))).select("model", "responses", "total_tokens")


@query("t13_recover_json", """
SELECT event_id, event_id % 4 <> 3 AS valid, CASE WHEN event_id % 4 <> 3 THEN event_type ELSE '' END AS kind,
       CASE WHEN event_id % 4 <> 3 THEN CAST(floor(value) AS BIGINT) ELSE -1 END AS amount,
       CASE WHEN event_id % 4 <> 3 THEN 2 ELSE 0 END AS tags FROM events""")
def recover_json(t):
    schema = (T.StructType().add("kind", T.StringType()).add("amount", T.LongType())
              .add("tags", T.ArrayType(T.StringType())))
    case = F.col("event_id") % 4
    inner = F.format_string('{"kind": "%s", "amount": %d, "tags": ["a", "b"]}', "event_type", F.floor("value").cast("long"))
    body = (F.when(case == 0, inner).when(case == 1, F.concat(F.lit("Here:\n```json\n"), inner, F.lit("\n```\nDone")))
            .when(case == 2, F.concat(F.lit("```\n"), inner, F.lit("\n```"))).otherwise(F.concat(F.lit("not json "), inner)))
    out = X.recover_json(t.events.select("event_id", body.alias("reply")), "reply", schema)
    return out.select("event_id", "valid", F.coalesce("data.kind", F.lit("")).alias("kind"),
                      F.coalesce("data.amount", F.lit(-1)).alias("amount"), F.size("data.tags").alias("tags"))


def artifact_source(t):
    faq = F.struct(F.concat(F.lit("Q "), "doc_id").alias("question"), F.col("lang").alias("answer"))
    blank = F.struct(F.lit("").alias("question"), F.lit("x").alias("answer"))
    ask = F.struct(F.concat(F.lit("E "), "doc_id").alias("question"), F.lit(None).cast("string").alias("expected_answer"),
                   F.when(F.col("doc_id") % 2 == 0, "hard").alias("difficulty"))
    return t.documents.select(
        "doc_id", F.concat("doc_id", F.lit(".md")).alias("document_name"), F.concat(F.lit("org/parsed/"), "source", F.lit("/x.md")).alias("parsed_file_path"),
        F.lit("gpt-5-mini").alias("model"), F.lit("2024-01-31T00:00:00").alias("generated_at"), F.sha2("text", 256).alias("content_hash"),
        F.col("text").alias("summary"), F.array(faq, blank).alias("faqs"), F.array(ask).alias("questions"))


@query("t14_artifact_round_trip", f"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^{WS}', ''), '{WS}$', '')) AS summary_digest, CAST(1 AS INT) AS faqs, 'Q ' || doc_id AS first_question, lang AS first_answer,
 CASE WHEN doc_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty, '' AS expected_answer FROM documents""")
def artifact_round_trip(t):
    texts = X.format_artifacts(artifact_source(t)).select("doc_id", "summary_text", "faq_text", "questions_text")
    # every third FAQ text is stored as JSON inside a JSON string
    twice = F.regexp_extract(F.to_json(F.struct(F.col("faq_text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    stored = texts.withColumn("faq_text", F.when(F.col("doc_id") % 3 == 0, twice).otherwise(F.col("faq_text")))
    back = X.parse_artifacts(stored)
    return back.select(
        "doc_id", F.md5("summary").alias("summary_digest"), F.size("faqs").alias("faqs"), F.get("faqs", F.lit(0))["question"].alias("first_question"),
        F.get("faqs", F.lit(0))["answer"].alias("first_answer"), F.get("questions", F.lit(0))["difficulty"].alias("difficulty"),
        F.get("questions", F.lit(0))["expected_answer"].alias("expected_answer"))


@query("t16_fold_tool_results", """
SELECT conv_id, arg_max(text, turn) FILTER (turn % 2 = 0 AND text <> '') AS summary,
       COALESCE(arg_max('gs://b/' || turn, turn) FILTER (turn % 2 = 0), '') AS source_path FROM conversations GROUP BY 1
HAVING COUNT(*) FILTER (turn % 2 = 0) > 0""")
def fold_tool_results(t):
    body = F.to_json(F.struct(
        (F.col("turn") % 2 == 0).alias("success"), F.col("text").alias("summary"),
        F.concat(F.lit("gs://b/"), "turn").alias("source_path"), F.lit("boom").alias("error")))
    msgs = t.conversations.select("conv_id", "turn", F.lit("summary_generator").alias("tool_name"), body.alias("content"))
    folded, _ = X.fold_tool_results(msgs, "conv_id", "turn")
    return folded.select("conv_id", "summary", F.coalesce("source_path", F.lit("")).alias("source_path"))


@query("t16_tool_usage_log", """
SELECT conv_id, turn, turn % 2 = 0 AS success FROM conversations""")
def tool_usage_log(t):
    body = F.when(F.col("turn") % 2 == 0, F.lit('{"success": true}')).otherwise("not json")
    msgs = t.conversations.select("conv_id", "turn", F.lit("faq_generator").alias("tool_name"), body.alias("content"))
    return X.fold_tool_results(msgs, "conv_id", "turn")[1].select("conv_id", "turn", "success")


AUDIT_KIND = """CASE event_type WHEN 'view' THEN 'document_loaded' WHEN 'click' THEN 'faqs_generated' WHEN 'signup' THEN 'parse_started'
  WHEN 'error' THEN 'error' ELSE 'store_created' END"""
AUDIT_FILE = "CASE WHEN event_id % 4 <> 0 THEN repeat('file-', 1 + CAST(event_id % 10 AS INT)) || event_id END"


def audit_events(t):
    kind = (F.when(F.col("event_type") == "view", "document_loaded").when(F.col("event_type") == "click", "faqs_generated")
            .when(F.col("event_type") == "signup", "parse_started").when(F.col("event_type") == "error", "error").otherwise("store_created"))
    name = F.when(F.col("event_id") % 4 != 0, F.concat(F.expr("repeat('file-', 1 + cast(event_id % 10 as int))"), "event_id"))
    return t.events.select("event_id", kind.alias("event_type"), name.alias("file_name"),
                           F.to_json(F.struct(F.col("props").alias("error"))).alias("details"))


@query("t18_derive_audit_fields", f"""
SELECT event_id, CASE kind WHEN 'document_loaded' THEN 'DOWNLOAD' WHEN 'faqs_generated' THEN 'CREATE' ELSE 'UPDATE' END AS action,
 'DOCUMENT' AS entity_type, left(COALESCE(file, 'unknown'), 36) AS entity_id FROM (SELECT event_id, {AUDIT_KIND} AS kind, {AUDIT_FILE} AS file FROM events)""")
def derive_audit_fields(t):
    return X.derive_audit_fields(audit_events(t)).select("event_id", "action", "entity_type", "entity_id")


@query("t19_activity_timeline", f"""
SELECT event_id, CASE kind WHEN 'document_loaded' THEN 'Document Loaded' WHEN 'faqs_generated' THEN 'FAQs Generated' WHEN 'parse_started' THEN 'Parsing Started'
  WHEN 'error' THEN 'Error Occurred' ELSE 'Store Created' END AS title,
 CASE kind WHEN 'document_loaded' THEN 'Loaded ' || f WHEN 'faqs_generated' THEN 'Generated FAQs for ' || f WHEN 'parse_started' THEN 'Started parsing ' || f
  WHEN 'error' THEN 'Error processing ' || f || ': ' || left(props, 50) ELSE 'Activity on ' || f END AS description
FROM (SELECT event_id, props, {AUDIT_KIND} AS kind, COALESCE({AUDIT_FILE}, 'document') AS f FROM events)""")
def activity_timeline(t):
    return X.activity_timeline(audit_events(t)).select("event_id", "title", "description")
