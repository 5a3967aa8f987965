import random
import re

import pytest
from pyspark.sql import functions as F, types as T

from ledgerlens.functions import constants as K, text as X

GENERAL = rf"(?:(?<!{X.WORD})(?={X.WORD})|(?<={X.WORD})(?!{X.WORD}))"
CUSTOM = [r"\bcase[- ]?\d+\b", r"\b(?:a|\d)b\b", r"x|\d{3}", r"\b(?:\d{2})?z+\b", r"\bno\s?\b", r"(?:\d|q)\b"]


@pytest.fixture(scope="module")
def odd_texts(spark):
    rng = random.Random(4)
    pieces = ["123", "12", "4", "-", " ", ".", "@", "a", "b.co", "é", "_", "́", "٣", "x", "/", "19", "2024", "+1", "(", ")", "case", "z", "q", "no", " ", "ſ"]
    return spark.createDataFrame([("".join(rng.choices(pieces, k=rng.randint(0, 14))),) for _ in range(3000)] + [(None,), ("",)], "t string")


@pytest.mark.parametrize("pattern", [*K.PII_PATTERNS.values(), *CUSTOM])
def test_short_boundaries_and_guards_change_nothing(odd_texts, pattern):
    plain = X.unicode_pattern(re.sub(r"\\b", "BOUND", pattern)).replace("BOUND", GENERAL)
    want = F.regexp_count(F.col("t"), F.lit(plain))
    got = odd_texts.select("t", want.alias("want"), X.pattern_count(F.col("t"), pattern).alias("got"), X.matches(F.col("t"), pattern).alias("m"))
    assert got.filter("coalesce(want, 0) <> got or (want > 0) <> m").count() == 0


@pytest.mark.parametrize("pattern, word", [
    (r"\bwhat\b", "what"), (r"\bquestions?\b", "question"), (r"\bearlier\s+i\s+(asked|said)\b", "earlier"), (r"a|b", ""), (r"\blook\s+for\b", "look")])
def test_sure_word(pattern, word):
    assert X.sure_word(pattern) == word


def test_word_counts(spark):
    texts = [None, "", "  ", "a", " a  b c\x1cd\n", "​ x", "a b"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.word_count(F.col("t")).alias("n"), F.size(X.words(F.col("t"))).alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(len((t or "").split()),) * 2 for t in texts]


@pytest.mark.parametrize("body, valid", [
    ('{"a": "1"}', True), ('{"a": 1, "a": 2}', True), ("{}", True), ('{"a": 1} x', False), ('{"a": 1}}', False), ('{"a": 1}]', False), ('{"a": 1}, {"b": 2}', False),
    ('{"a": 1}], [{"a": 2}', False), ('{"a": 1', False), ("[1]", False), ("1", False), ("", False), (None, False), ('{"a": {"b": [1, "]"]}}', True), ('{"a": 1},{"_mark":"0"}', False),
    ('{"a": "}]"}', True), ("null", False)])
def test_one_parse_tells_validity(spark, body, valid):
    df = spark.createDataFrame([(body,)], "b string")
    out = X.with_json_object(df, "b", T.StructType([T.StructField("a", T.StringType())]), "o", "v")
    assert out.columns == ["b", "v", "o"] and str(out._jdf.queryExecution().optimizedPlan()).count("from_json") <= 2
    row = out.first()
    assert row.v is valid and (row.o is not None) == valid
    assert df.select(F.coalesce(X.is_json_object(F.col("b")), F.lit(False))).first()[0] == valid


def test_a_filter_stays_above_the_parse(spark):
    df = spark.createDataFrame([('{"a": "1"}', 1), ("x", 2), (None, 3)], "t string, _ok int")
    shape = T.StructType([T.StructField("a", T.StringType())])
    out = X.with_json_object(df.withColumn("b", X.fenced_body(F.reverse(F.reverse("t")))), "b", shape, "o", "v").filter("v").select("o.a", "_ok")
    plan = str(out._jdf.queryExecution().optimizedPlan())
    assert plan.count("from_json") == 1 and plan.count("reverse(reverse(") <= 8
    assert [tuple(r) for r in out.collect()] == [("1", 1)]
