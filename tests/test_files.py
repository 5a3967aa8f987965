import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import filters as X, joins as J
from ledgerlens.sources import files as S, versioned as V


def test_bad_files_leave_their_number_unused(spark, tmp_path):
    good, other = tmp_path / "a.csv", tmp_path / "b.tsv"
    good.write_text("id,name\n1,x\n2,y\n")
    other.write_text("id\tv\n1\t2.5\n")
    views, rejected = S.mount_files(spark, [str(good), str(tmp_path / "no.csv"), str(tmp_path / "x.xlsx"), str(other)])
    assert list(views) == ["file_0", "file_3"] and len(rejected) == 2
    df, report = S.sql_over_files(spark, [str(good), str(tmp_path / "no.csv"), str(other)], "SELECT name, v FROM file_0 JOIN file_2 USING (id);")
    assert [tuple(r) for r in df.collect()] == [("x", 2.5)] and report["columns"] == ["name", "v"]
    with pytest.raises(ValueError):
        S.mount_files(spark, [str(tmp_path / "no.csv")])


@pytest.mark.parametrize("text", ["DROP TABLE x", "select 1;\nDELETE FROM t", "with a as (select 1) insert into t select * from a", "select 1;drop table t"])
def test_guard_refuses_writes(text):
    with pytest.raises(ValueError):
        S.guard_sql(text)


@pytest.mark.parametrize("text", ["SELECT 'drop table x'", "SELECT updated_at, created FROM t -- delete this", 'SELECT "update" FROM t'])
def test_guard_accepts_reads(text):
    S.guard_sql(text)


def test_cap_only_without_own_limit(spark):
    spark.range(100).createOrReplaceTempView("numbers")
    assert S.run_sql(spark, "SELECT id AS limit_id FROM numbers", 10).count() == 10
    assert S.run_sql(spark, "SELECT id FROM numbers LIMIT 50", 10).count() == 50
    assert S.run_sql(spark, "SELECT id FROM (SELECT id FROM numbers LIMIT 50) t", 10).count() == 10


def test_manifest_of_a_tree(spark, tmp_path):
    for i, name in enumerate(["a.pdf", ".hidden.pdf", "b.exe", "sub/c.MD", "sub/d.txt"]):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x" * (i + 1))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    rows = S.file_manifest(spark, str(tmp_path), [".pdf", ".md", ".txt"]).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in rows] == ["d.txt", "c.MD", "a.pdf"]
    assert [r.length for r in rows] == [5, 4, 1]


def test_path_keys(spark):
    paths = ["gs://b/Acme corp/parsed/in/2024/S.md", "Acme/parsed/S.md", "org123/bulk/folder/doc.pdf", "a/b.c", "noextension", "gs://bucket"]
    rows = {r.p: r for r in X.derive_path_keys(spark.createDataFrame([(p,) for p in paths], "p string"), "p").collect()}
    first = rows[paths[0]]
    assert (first.bucket, first.org, first.folder, first.base_name, first.extension) == ("b", "Acme corp", "in/2024", "S", ".md")
    assert first.content_path == "Acme corp/summary/in/2024/S.md"
    assert (rows[paths[1]].org, rows[paths[1]].folder, rows[paths[1]].content_path) == ("Acme", "", "Acme/summary/S.md")
    assert (rows[paths[2]].org, rows[paths[2]].folder) == ("org123", "folder")
    assert (rows["noextension"].extension, rows["noextension"].org) == ("", "")
    assert (rows["gs://bucket"].bucket, rows["gs://bucket"].object_key) == ("bucket", "")


def test_manifest_reasons(spark):
    rows = [("o/bulk/f/a.pdf", 1), ("o/bulk/f/../a.pdf", 1), ("/o/bulk/f/a.pdf", 1), ("o/bulk/f/.h.pdf", 1), ("o/f/a.pdf", 1), ("o/bulk/f/a", 1), ("o/bulk/f/big.pdf", 99)]
    ok, bad = X.validate_manifest(spark.createDataFrame(rows, "path string, length long"), max_bytes=50, layout=r"^([^/]+)/bulk/([^/]+)/([^/]+)$")
    assert [r.path for r in ok.collect()] == ["o/bulk/f/a.pdf"]
    assert sorted(r.reason for r in bad.collect()) == ["bad_path", "bad_path", "hidden", "over_size", "path_traversal", "unsupported_extension"]
    upload, _ = X.validate_manifest(spark.createDataFrame([(".hidden.pdf", 1), ("noextension", 1)], "path string, length long"), skip_hidden=False)
    assert [r.path for r in upload.collect()] == [".hidden.pdf"]


def test_raw_copy_order(spark):
    wanted = spark.createDataFrame([("p1", "a.pdf"), ("p2", "b.txt"), ("p3", "c.pdf"), ("p4", "d.pdf")], "parsed_path string, document_name string")
    parsed = spark.createDataFrame([("p1", "P"), ("p2", "")], "parsed_path string, content string")
    raw = spark.createDataFrame([("a.md", "no"), ("b.txt", "B"), ("c.txt", "T"), ("c.md", "M"), ("d.exe", "E")], "file_name string, content string")
    got = {r.document_name: (r.content, r.source_type) for r in S.load_documents(wanted, parsed, raw).collect()}
    assert got == {"a.pdf": ("P", "parsed"), "b.txt": ("B", "upload"), "c.pdf": ("M", "upload"), "d.pdf": (None, "not_found")}


def test_versions_do_not_overwrite(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        V.current(spark, root)
    assert V.publish(spark.range(3), root) == 1
    assert V.publish(V.current(spark, root).filter("id > 0"), root) == 2
    assert V.current(spark, root).count() == 2 and V.versions(spark, root) == [1, 2]


def test_artifact_kind(spark):
    rows = [("s", ["f"], ["q"]), ("s", None, None), ("", ["f"], ["q"]), (None, [], ["q"]), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, f array<string>, q array<string>")
    got = [r[0] for r in df.select(S.generation_type(F.col("s"), F.col("f"), F.col("q"))).collect()]
    assert got == ["all", "summary", "faqs", "questions", "all"]


def test_large_record_is_split_not_cut(spark):
    header = spark.createDataFrame([("r",), ("empty",)], "id string")
    items = spark.range(1, 26).select(F.lit("r").alias("parent"), F.col("id").cast("int").alias("line_number"), F.col("id").alias("v"))
    rows = J.nest_line_items(header, items, "id", "parent", "line_number", ["v"], items_per_row=10).orderBy("id", "part").collect()
    assert [(r.id, r.part, len(r.line_items)) for r in rows] == [("empty", 0, 0), ("r", 0, 10), ("r", 1, 10), ("r", 2, 5)]
    assert [i.v for r in rows for i in r.line_items] == list(range(1, 26))
