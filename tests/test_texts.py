import re

import pytest
from pyspark.sql import functions as F, types as T

from ledgerlens.functions import constants as K, text as X
from ledgerlens.operators import extraction as E, textjobs as J


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column).collect()]


def test_words_follow_unicode_white_space(spark):
    values = ["", "   ", "one", " a  b\tc\n", "für das 　x", None]
    assert one(spark, X.word_count(F.col("t")), *values) == [len((v or "").split()) for v in values]
    assert one(spark, F.size(X.words(F.col("t"))), *values) == [len((v or "").split()) for v in values]


def test_token_estimate_truncates(spark):
    values = [" ".join(["w"] * n) for n in (1, 2, 10, 77)]
    assert one(spark, X.token_estimate(F.col("t")), *values) == [int(n * 1.3) for n in (1, 2, 10, 77)]


@pytest.mark.parametrize("name", ["ACME Corp", "acme-corp"])
def test_store_name_golden(spark, name):
    assert one(spark, X.store_name(F.col("t")), name) == ["acme_corp_file_search_store"]


def test_identifiers(spark):
    values = ["Acme  Corp", "9 lives", "É-x!", " tab\tname "]
    assert one(spark, X.identifier(F.col("t")), *values) == [X.identifier_text(v) for v in values]
    assert one(spark, X.record_table(F.col("t"), F.lit("invoice_template")), "Acme Corp") == ["acme_corp_invoice"]


TEXT = "mail jo@x.org or 555-123-4567, ssn 123-45-6789, card 4111 1111 1111 1111, ip 10.0.0.1, born 01/31/1990"


def test_spans_equal_python(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None)], "id int, t string")
    got = {(r.pii_type, r.value, r.start, r.end) for r in J.detect_pii(df, "id", "t").collect()}
    want = {(k, m.group(), m.start(), m.end()) for k, p in K.PII_PATTERNS.items() for m in re.finditer(p, TEXT, re.I)}
    assert got == want and {"email", "ssn", "credit_card", "ip_address", "date_of_birth"} <= {k for k, *_ in got}


def test_mask_hash_and_redact(spark):
    df = spark.createDataFrame([("jo@x.org 123-45-6789 10.0.0.1",)], "t string")
    types = ["email", "ssn", "ip_address"]
    assert J.scrub_pii(df, "t", "mask", types).first().scrubbed == "j***@x.org ***-**-6789 ***.***0.1"
    assert J.scrub_pii(df, "t", "redact", types).first().scrubbed == "[EMAIL_REDACTED] [SSN_REDACTED] [IP_ADDRESS_REDACTED]"
    assert re.fullmatch(r"(\[HASH:[0-9a-f]{12}\] ?){3}", J.scrub_pii(df, "t", "hash", types).first().scrubbed)


def test_overlaps_never_corrupt(spark):
    df = spark.createDataFrame([("call 4111 1111 1111 1111 now", ), (None,)], "t string")
    texts = [r.scrubbed for r in J.scrub_pii(df, "t", "redact").collect()]
    assert texts == ["call [CREDIT_CARD_REDACTED] now", None]


def test_custom_pattern_keeps_its_name(spark):
    df = spark.createDataFrame([(1, "ticket AB-12")], "id int, t string")
    row = J.detect_pii(df, "id", "t", ["email"], {"ticket": r"\bAB-\d+\b"}).first()
    assert (row.pii_type, row.value) == ("ticket", "AB-12")


@pytest.mark.parametrize("text,intent", [
    ("", "mixed"), ("what did I ask before?", "conversational"), ("generate a summary", "content_generation"),
    ("open it", "document_load"), ("who wrote this and when", "rag_search"), ("create", "content_generation"),
    ("hello there", "rag_search"), ("what summary", "rag_search")])
def test_intents(spark, text, intent):
    df = spark.createDataFrame([(text,)], "t string")
    assert J.classify_intent(df, F.col("t")).first().intent == intent


def test_context_boost(spark):
    df = spark.createDataFrame([("summarize",)], "t string")
    yes = F.lit(True)
    assert J.classify_intent(df, F.col("t"), document=yes, parsed=yes).first().intent == "content_generation"


SCHEMA = (
    T.StructType().add("a", T.StringType()).add("n", T.LongType()).add("items", T.ArrayType(T.StringType()))
    .add("o", T.StructType().add("x", T.StringType()))
)


@pytest.mark.parametrize("body,valid,a,items", [
    ('{"a": "x", "n": 1, "items": ["p"]}', True, "x", ["p"]),
    ('Sure:\n```json\n{"a": "x", "items": []}\n```\nbye', True, "x", []),
    ('```\n{"a": "y"}\n```', True, "y", None),
    ("{broken", False, None, []),
    ("[1, 2]", False, None, []),
])
def test_json_recovery(spark, body, valid, a, items):
    row = J.recover_json(spark.createDataFrame([(body,)], "t string"), "t", SCHEMA).first()
    assert (row.valid, row.data.a, row.data["items"]) == (valid, a, items)


@pytest.mark.parametrize("text,want", [
    ("# Summary\n\nbody --- x\n\n---\n_Generated by m on d_\n", "body --- x"),
    ("# Summary\n\na\n---\nb\n---\nc", "a\n---\nb"), ("plain text", "plain text"),
    ("x\n---\n_Generated by m", "x"), ("# Summary\n\nonly", "only")])
def test_summary_text(spark, text, want):
    assert one(spark, J.parse_summary(F.col("t")), text) == [want]


def test_nested_and_bad_artifacts(spark):
    rows = [("", '{"faqs": {"success": true, "faqs": [{"question": "q", "answer": "a"}]}}', '{"questions": [{"question": "q"}, {"question": ""}]}'),
            ("", "oops", '{"questions": "no"}'), ("", None, None)]
    out = J.parse_artifacts(spark.createDataFrame(rows, "summary_text string, faq_text string, questions_text string")).collect()
    assert [len(r.faqs) for r in out] == [1, 0, 0]
    assert [[q.difficulty for q in r.questions] for r in out] == [["medium"], [], []]


def test_usage_shapes(spark):
    bodies = ['{"usage": {"prompt_tokens": 3, "completion_tokens": 4}}', '{"usageMetadata": {"promptTokenCount": 1, "totalTokenCount": 9}}',
              '{"llm_output": {"token_usage": {"prompt_tokens": 2, "completion_tokens": 1, "total_tokens": 3}, "model_name": "gemini-x"}}', '{"text": "a b c"}', "junk"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, response string")
    got = [(r.total_tokens, r.provider, r.model) for r in J.extract_usage(df).orderBy("i").collect()]
    assert got == [(7, "openai", "unknown"), (9, "google", "unknown"), (3, "google", "gemini-x"), (3, None, None), (0, None, None)]


def test_record_extraction(spark):
    schema = {"properties": {"Order No": {"type": "string"}, "total": {"type": "number"}, "paid": {"type": "boolean"},
                             "line_items": {"type": "array", "items": {"type": "object", "properties": {"qty": {"type": "integer"}}}}},
              "required": ["Order No", "total"]}
    body = '{"parameters": {"Order No": "7", "total": "x", "paid": true, "line_items": [{"qty": 1}, {"qty": "two"}]}}'
    row = E.extract_records(spark.createDataFrame([(body,)], "response string"), schema).first()
    assert row.data["Order No"] == "7" and row.data.total is None and row.data.paid is True
    assert [i.qty for i in row.data.line_items] == [1, None]
    assert row.missing_required == ["total"] and row.extracted_fields == 4


def test_entity_field_preference():
    assert E.find_entity_field({"properties": {"PO_Number": {}, "Invoice_No": {}}}) == "Invoice_No"
    assert E.find_entity_field({"properties": {"name": {}}}) is None


def test_template_golden(spark):
    import json

    fields = spark.createDataFrame(
        [("t", "invoice", "o", 1, "number", "No", "text", True, "header"), ("t", "invoice", "o", 2, "due", None, "date", False, None),
         ("t", "invoice", "o", 3, "qty", "Qty", "float", True, "line_item")],
        "template_name string, document_type string, organization_id string, position int, field_name string, display_name string, data_type string, required boolean, location string")
    made = json.loads(E.build_templates(fields, "2024-01-01").first().template)
    assert list(made["properties"]) == ["number", "due", "line_items"]
    assert made["properties"]["due"] == {"type": "string", "description": "due"}
    assert made["required"] == ["number"] and made["properties"]["line_items"]["items"] == {
        "type": "object", "properties": {"qty": {"type": "number", "description": "Qty"}}, "required": ["qty"]}
    assert made["$schema"].endswith("draft-07/schema#") and made["metadata"]["version"] == "1.0"


def test_tool_results_last_value_wins(spark):
    rows = [("s", 1, "summary_generator", '{"success": true, "summary": "one"}'), ("s", 2, "summary_generator", '{"success": true, "summary": ""}'),
            ("s", 3, "faq_generator", '{"success": true, "faqs": [{"question": "q", "answer": "a"}, {"question": "x"}]}'),
            ("s", 4, "summary_generator", '{"success": false, "summary": "bad"}'), ("s", 5, "question_generator", "oops")]
    folded, log = J.fold_tool_results(spark.createDataFrame(rows, "s string, seq int, tool_name string, content string"), "s", "seq")
    row = folded.first()
    assert row.summary == "one" and len(row.faqs) == 1 and row.questions is None
    assert [r.success for r in log.orderBy("seq").collect()] == [True, True, True, False, False]
