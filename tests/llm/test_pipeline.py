import re
from pathlib import Path

import corpus_pipeline
import pytest
from ledgerlens.llm import packing
from test_neardup import brute as groups
from test_secret_scan import brute as secrets

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, ROOT), name)
        assert name == "pack" or docs.columns == before
        out.append(docs.collect())
    return out


def test_stages(spark, steps):
    start, spoken, single, clean, safe, packed = steps
    gone = {r["doc_id"] for r in start} - {r["doc_id"] for r in spoken}
    assert all(not re.search(r"[^\W\d_]", r["text"] or "") for r in start if r["doc_id"] in gone)

    found = groups([(r["doc_id"], r["text"]) for r in spoken], 5, 80)
    assert {r["doc_id"] for r in single} == {k for k, (_, c) in found.items() if k == c}

    items = [r["text"] for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    squash = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    holds = {r["doc_id"] for r in single if any(squash(i) in squash(r["text"]) for i in items)}
    kept = {r["doc_id"] for r in clean}
    assert not holds & kept
    assert len(kept) >= 0.98 * (len(single) - len(holds))

    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(r["doc_id"] for r in safe)
    assert not any(secrets(r["text"]) for r in safe)
    plain = {r["doc_id"]: r for r in clean if not secrets(r["text"])}
    assert all(r == plain[r["doc_id"]] for r in safe if r["doc_id"] in plain)
    assert all(r["n_chars"] == len(r["text"]) for r in safe if r["doc_id"] not in plain)

    memo = packing.new_memo(packing.tokenizer_path())
    length = {r["doc_id"]: len(packing.encode_text((r["text"] or "").encode(), memo)) // 4 for r in safe}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == length


def test_run_equals_the_stages(spark, steps):
    key = lambda r: (r["doc_id"], r["piece"], r["length"])
    assert sorted(map(key, corpus_pipeline.run(spark, ROOT).collect())) == sorted(map(key, steps[-1]))


def test_the_rest_works_without_this_part():
    root = Path(corpus_pipeline.__file__).parent
    for file in root.joinpath("ledgerlens").rglob("*.py"):
        if "llm" not in file.parts:
            assert "ledgerlens.llm" not in file.read_text(), file
