import pytest

from ledgerlens.plans import suite
from ledgerlens.sources import files as S
from ledgerlens.sources.sqlguard import ParsedQuery

REFUSED = [
    r"SELECT '\'', * FROM text.`/etc/hostname` WHERE '' = ''",
    "SELECT * FROM `org.apache.spark.sql.execution.datasources.text.TextFileFormat`.`/etc/hostname`",
    "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM default.file_0", "SELECT * FROM file_1", "TABLE other",
    "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('reflect')('java.lang.Math', 'abs', -1)",
    "SELECT reflect('java.lang.System', 'getenv')", "SELECT `java_method`('java.lang.Math', 'abs', -1)", "SELECT try_reflect('a', 'b')",
    "SELECT upper(reflect('java.lang.System', 'getenv')) FROM file_0 WHERE id IN (SELECT id FROM file_0)",
    "SELECT (SELECT max(id) FROM hidden) FROM file_0", "SELECT * FROM file_0 WHERE EXISTS (SELECT 1 FROM hidden h WHERE h.id = file_0.id)",
    "SELECT * FROM file_0 ORDER BY (SELECT 1 FROM hidden)", "SELECT id FROM file_0 UNION ALL SELECT id FROM hidden",
    "SELECT * FROM hidden WHERE EXISTS (WITH hidden AS (SELECT 1) SELECT * FROM hidden)",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a", "FROM file_0 |> JOIN hidden USING (id)",
    "SELECT * FROM file_0, LATERAL (SELECT * FROM hidden)",
    "SELECT 1; SELECT 2", "SET x = 1", "EXPLAIN SELECT 1", "CACHE TABLE file_0", "DESCRIBE file_0", "BEGIN SELECT 1; END",
    "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM file_0 INSERT INTO t SELECT *", "", "SELEC 1"]
ACCEPTED = [
    r"""SELECT 'it\'s `a` from text.`x`' AS t, "drop -- table" AS u FROM file_0""", "SELECT 'it''s' FROM FILE_0 -- drop table x",
    "WITH a AS (SELECT * FROM file_0), b AS (SELECT * FROM a) SELECT (SELECT max(id) FROM b) AS m FROM a WHERE id IN (SELECT id FROM b)",
    "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r",
    "SELECT * FROM (WITH a AS (SELECT 1 AS x) SELECT * FROM a) t, file_0", "VALUES (1), (2)", "TABLE file_0", "FROM file_0 |> WHERE id > 0 |> SELECT id",
    "SELECT id, sum(id) OVER w FROM file_0 WINDOW w AS (PARTITION BY id)", "SELECT x FROM file_0 LATERAL VIEW explode(array(1, 2)) t AS x",
    "SELECT id FROM file_0 GROUP BY id HAVING count(*) > 0 ORDER BY 1 LIMIT 3 OFFSET 1", "SELECT * FROM range(3), file_0",
    "SELECT * FROM file_0 PIVOT (count(*) FOR id IN (1, 2))", "SELECT * FROM file_0 TABLESAMPLE (10 PERCENT)", "SELECT /*+ BROADCAST(f) */ * FROM file_0 f",
    "(SELECT id FROM file_0) INTERSECT (SELECT id FROM file_0)", "SELECT * FROM file_0 NATURAL JOIN file_0 AS b"]


@pytest.fixture()
def view(spark):
    spark.range(5).createOrReplaceTempView("file_0")
    spark.range(5).createOrReplaceTempView("hidden")


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, view, text):
    with pytest.raises(ValueError):
        S.run_sql(spark, text, tables=["file_0"])


@pytest.mark.parametrize("text", ACCEPTED)
def test_accepted(spark, view, text):
    S.run_sql(spark, text, tables=["file_0"]).collect()


@pytest.mark.parametrize("name", sorted(suite.TEXTS))
def test_suite_passes_the_guard(spark, name):
    import re

    names = re.findall(r"\{(\w+)\}", suite.TEXTS[name])
    ParsedQuery(spark, suite.TEXTS[name].format(**{n: n for n in names})).check(names)
    with pytest.raises(ValueError):
        ParsedQuery(spark, suite.TEXTS[name].format(**{n: n for n in names})).check(names[:1] if len(set(names)) > 1 else [])


@pytest.mark.parametrize("text, limited", [
    ("SELECT 1 LIMIT 5", True), ("SELECT 1 LIMIT ALL", False), ("WITH a AS (SELECT 1 LIMIT 3) SELECT * FROM a", False),
    ("WITH a AS (SELECT 1) SELECT * FROM a LIMIT 3 OFFSET 1", True), ("SELECT * FROM (SELECT 1 LIMIT 3)", False),
    (r"SELECT 'LIMIT 5'", False), ("(SELECT 1 LIMIT 2)", True), ("SELECT 1 ORDER BY 1 LIMIT 1 + 1 -- end", True)])
def test_own_limit(spark, text, limited):
    assert ParsedQuery(spark, text).has_own_limit() is limited


def test_cut_is_reported(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id\n1\n2\n3\n")
    frame, report = S.sql_over_files(spark, [str(path)], "SELECT * FROM file_0", max_rows=2)
    assert frame.count() == 2 and report["truncated"] is True
    frame, report = S.sql_over_files(spark, [str(path)], "SELECT * FROM file_0 LIMIT 3;", max_rows=2)
    assert frame.count() == 3 and report["truncated"] is False
    assert S.sql_over_files(spark, [str(path)], "SELECT * FROM file_0", max_rows=3)[1]["truncated"] is False
