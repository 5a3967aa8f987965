"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    ann, chat, collocations, decontam, langid, licenses, mixing, neardup, packing, periodic, quality, secret_scan, toxicity,
)
from ledgerlens.llm.common import fold, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(docs: DataFrame, parts: int, value: int) -> DataFrame:
    held = F.coalesce(fold("doc_id", parts) == value, F.lit(False))
    return docs.withColumn("held_out", held)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.encode_pieces(_table(spark, sf_dir, "documents"))
    digests = stored(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.place(digests)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = langid.learn(docs, fold("doc_id", 4) != 2)
    found = _held_out(langid.predict(docs, profiles), 4, 2)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return ann.search(table, table.where("vec_id % 20 = 0"), k=20)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return _held_out(toxicity.classify(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    read = chat.format_conversations(rows).select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "").alias("trained"),
        F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return _held_out(quality.classify(docs, model), 4, 2).select("doc_id", "held_out", "score", "predicted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    paths, _, findings = secret_scan.scan_versions(versions)
    return secret_scan.by_path(paths, findings).select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents")))
    best = periodic.most_repeated(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_language_id": op2_language_id,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_quality": op8_quality,
        "op9_secret_scan": op9_secret_scan,
        "op10_decontamination": op10_decontamination,
        "op11_source_mixing": op11_source_mixing,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_phrase_collocations": op13_phrase_collocations,
        "pipeline": pipeline,
    }


NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) m USING (doc_id)
"""

CHAT = r"""
WITH all_rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
lagged AS (
    SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM all_rows),
sized AS (
    SELECT *, length(replace(text, '<|', '<|''')) + CASE WHEN before = role THEN 8
        ELSE 16 + length(replace(role, '<|', '<|''')) END AS chars FROM lagged),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS trained,
        CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM joined
"""

SECRETS = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, k, pattern, g, least) AS (VALUES
    ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
    ('hex', 2, '[0-9a-f]+', 0, 24)),
hits AS (
    SELECT doc_id, kind, k, least, CASE k WHEN 0 THEN string_split_regex(text, (SELECT pattern FROM rules WHERE k = 0))
        WHEN 1 THEN string_split_regex(text, (SELECT pattern FROM rules WHERE k = 1)) ELSE string_split_regex(text, (SELECT pattern FROM rules WHERE k = 2)) END AS gaps,
        CASE k WHEN 0 THEN regexp_extract_all(text, '{assign}') WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]+') END AS found,
        CASE k WHEN 0 THEN regexp_extract_all(text, '{assign}', 2) WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(text, '[0-9a-f]+') END AS checked
    FROM docs, rules),
each AS (
    SELECT doc_id, kind, k, least, unnest(range(1, len(found) + 1)) AS n, unnest(list_transform(gaps[1:len(found)], lambda x: length(x))) AS gap,
        unnest(list_transform(found, lambda x: length(x))) AS hit, unnest(list_transform(checked, lambda x: length(x))) AS c FROM hits),
placed AS (
    SELECT *, sum(gap + hit) OVER (PARTITION BY doc_id, k ORDER BY n ROWS UNBOUNDED PRECEDING) AS e FROM each),
spans AS (SELECT doc_id, kind, k, CAST(e - hit AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed WHERE c >= least),
per_doc AS (
    SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN per_doc USING (doc_id)
"""


MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
        md5('20240301:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
walked AS (
    SELECT *, CAST(sum(n) OVER () - coalesce(sum(3 * n) OVER (u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(sum(w) OVER (u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares, row_number() OVER u AS k
    FROM sources WINDOW u AS (ORDER BY 18 * n // w, w, source NULLS LAST)),
level AS (SELECT rest, shares, k FROM walked WHERE CAST(rest AS HUGEINT) * w <= CAST(3 * n AS HUGEINT) * shares ORDER BY k LIMIT 1),
goals AS (
    SELECT source, n, CASE WHEN k < coalesce((SELECT k FROM level), 1e18) THEN CAST(3 * n AS DOUBLE)
        ELSE CAST((SELECT rest FROM level) AS DOUBLE) * CAST(w AS DOUBLE) / CAST((SELECT shares FROM level) AS DOUBLE) END AS target FROM walked),
parts AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS whole FROM goals),
gaps AS (SELECT *, target - whole * n AS gap FROM parts),
placed AS (
    SELECT d.doc_id, d.size, g.*, d.o, row_number() OVER p AS r,
        sum(d.size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
    FROM sized d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source WINDOW p AS (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size)),
missing AS (
    SELECT *, gap > 0 AND e <= gap AS fits,
        CASE WHEN gap > 0 THEN gap - coalesce(max(CASE WHEN e <= gap THEN e END) OVER (PARTITION BY source), 0) ELSE 0 END AS m FROM placed),
closing AS (
    SELECT *, NOT fits AND abs(m - size) < m AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(m - size), o, doc_id, size) = 1 AS closes FROM missing)
SELECT doc_id, size, n AS source_size, target, CAST(size * (whole + CASE WHEN fits OR closes THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM closing
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3), (4)) s(k))),
counts AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 30),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM split),
scored AS (
    SELECT s.lang, s.phrase, s.a, s.c, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * s.a // (x.a + y.a) AS BIGINT) AS score
    FROM cuts s JOIN counts x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:s.c], ' ')
    JOIN counts y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[s.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
    SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, z, unnest(range(1, k - z + 2)) AS i FROM split, (VALUES (2), (3)) s(z) WHERE z < k)),
longer AS (SELECT lang, phrase, max(a) AS f FROM inner_ GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE g.f IS NULL OR 100 * CAST(g.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    assign = SECRETS.split("('assign', 0, '", 1)[1].split("', 2, 6)", 1)[0]
    return {
        "op4_near_duplicates": NEAR_DUPLICATES,
        "op7_chat_formatting": CHAT,
        "op9_secret_scan": SECRETS.replace("{assign}", assign),
        "op11_source_mixing": MIXING,
        "op13_phrase_collocations": COLLOCATIONS,
    }
