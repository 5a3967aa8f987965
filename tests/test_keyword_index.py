import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import retrieval as R
from ledgerlens.operators.keyword_index import KeywordIndex

COLUMNS = ["query_id", "chunk_id", "rank", "score"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.9))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(3000)] + [(5000, None), (5001, "only here"), (5002, "")]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(60)] + [(90, "nothing such"), (91, None), (92, "only w1 w2 w3 here")]
    return spark.createDataFrame(rows, "chunk_id long, chunk_text string"), spark.createDataFrame(asked, "query_id long, query_text string")


def rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_batches_share_an_index(spark, texts, tmp_path):
    chunks, asked = texts
    index = KeywordIndex(spark, str(tmp_path / "i"), parts=4, blocks=16)
    for batch in range(3):
        index.add(chunks.filter(F.col("chunk_id") % 3 == batch))
    assert rows(index.topk(asked.filter("query_id < 30"), 10)) == rows(R.keyword_topk(asked.filter("query_id < 30"), chunks, 10))
    later = index.topk(asked.filter("query_id >= 30"), 7)
    assert rows(later) == rows(R.keyword_topk(asked.filter("query_id >= 30"), chunks, 7))
    # only the queries are cut into words
    assert "split(" not in later._jdf.queryExecution().optimizedPlan().toString()


def test_added_chunks_count(spark, texts, tmp_path):
    chunks, asked = texts
    index = KeywordIndex(spark, str(tmp_path / "i"), parts=2, blocks=5)
    index.add(chunks.filter("chunk_id < 2000"), "a")
    assert rows(index.topk(asked, 5)) == rows(R.keyword_topk(asked, chunks.filter("chunk_id < 2000"), 5))
    index.add(chunks.filter("chunk_id >= 2500"), "b")
    index.add(chunks.filter("chunk_id >= 2000"), "b")  # the batch is written again
    assert rows(index.topk(asked, 5)) == rows(R.keyword_topk(asked, chunks, 5))


def test_unfinished_batch_is_not_read(spark, texts, tmp_path):
    import shutil

    chunks, asked = texts
    index = KeywordIndex(spark, str(tmp_path / "i"), parts=2, blocks=5)
    assert index.topk(asked, 5).count() == 0
    index.add(chunks.filter("chunk_id < 1000"), "a")
    index.add(chunks.filter("chunk_id >= 1000"), "b")
    shutil.rmtree(tmp_path / "i" / "chunks" / "batch=b")
    assert rows(index.topk(asked, 5)) == rows(R.keyword_topk(asked, chunks.filter("chunk_id < 1000"), 5))


def test_bounds_leave_work_out(spark, tmp_path):
    # a rare word decides; the common one is opened only where the rare one is
    body = [(i, "common " * 5 + ("rare " * (1 + i % 7) if i % 100 == 0 else "") + f"x{i}") for i in range(4000)]
    chunks = spark.createDataFrame(body, "chunk_id long, chunk_text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), parts=2, blocks=64)
    index.add(chunks)
    asked = spark.createDataFrame([(1, "common rare")], "query_id long, query_text string")
    found = index.topk(asked, 5)
    assert rows(found) == rows(R.keyword_topk(asked, chunks, 5))
    plan = index.last_plan.collect()
    assert {r["term"]: r["essential"] for r in plan} == {"common": False, "rare": True}


def test_pairs_stay_in_their_block(spark, tmp_path, monkeypatch):
    from ledgerlens.operators import keyword_index

    monkeypatch.setattr(keyword_index, "BLOCK_CHUNKS", 20)
    chunks = spark.createDataFrame([(i, f"all w{i % 7} w{i % 3}") for i in range(300)], "chunk_id long, chunk_text string")
    asked = spark.createDataFrame([(i, f"all w{i}") for i in range(5)], "query_id long, query_text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), parts=2, blocks=3)
    index.add(chunks, "a")
    # a large batch has more blocks, so that a task's block stays small
    assert index.postings().agg(F.max("block")).first()[0] >= 10
    found = index.topk(asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("query_id" in line and "chunk_id" in line for line in moved)
    assert rows(found) == rows(R.keyword_topk(asked, chunks, 4))
