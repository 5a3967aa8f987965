import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import compression, quality, queries, toxicity

ROOT = "/root/testdata/sf0.1"
LARGE = "/root/testdata/check_s"


def auc(marks, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    marks = np.array(marks, bool)
    return (rank[marks].mean() - (marks.sum() - 1) / 2) / (~marks).sum()


def held_out(spark, root, query, label):
    out = query(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").where(f"held_out and {label} is not null")
    rows = out.select(label, "score", "predicted").collect()
    marks = [r[0] for r in rows]
    right = [np.mean([r[2] == kind for r in rows if r[0] == kind]) for kind in (0, 1)]
    return auc(marks, [r[1] for r in rows]), right


def test_quality_held_out(spark):
    area, right = held_out(spark, ROOT, queries.op8_quality, "quality")
    assert area >= 0.97 and min(right) >= 0.9


def test_toxicity_held_out_with_few_labels(spark):
    area, right = held_out(spark, ROOT, queries.op5_toxicity, "toxic")
    assert area >= 0.85 and right[0] >= 0.97 and right[1] >= 0.4


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the larger labelled tables")
def test_toxicity_held_out(spark):
    area, right = held_out(spark, LARGE, queries.op5_toxicity, "toxic")
    assert area >= 0.98 and right[0] >= 0.98 and right[1] >= 0.9


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, docs_of, odd_rows, module, label):
    labels = spark.createDataFrame(
        [(1, 0, 1), (2, 1, 0), (5, 1, 0), (5, 1, 0), (6, 0, 1), (8, None, None), (None, 1, 1), (10, 5, 5)], "doc_id long, quality int, toxic int")
    docs = docs_of(odd_rows)
    for train in (F.lit(True), F.lit(False), F.col("doc_id") == 5):
        model = module.fit(docs, labels, train)
        out = module.classify(docs, model).collect()
        assert len(out) == len(odd_rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in out)
    assert module.classify(docs_of([]), model).count() == 0


def test_windows_are_the_whole_text():
    for data in (b"", b"abc", b"a b " * 500, b"x" * 1000, ("é " * 300).encode()):
        cut = toxicity.windows(data)
        assert b"".join(cut) == data and all(len(w) <= toxicity.WINDOW for w in cut)


def test_segments_find_what_only_toxic_text_has():
    common = [f"the thing and the other of it {i}".encode() for i in range(50)]
    toxic = [b"a fine day, dreadful scoundrel, and " + c for c in common[:25]] + [c + b" yes dreadful scoundrel no" for c in common[25:]]
    found = toxicity.segments(toxic, common)
    assert any(b"scoundrel" in s for s in found) and not any(b"the thing" in s for s in found)


def test_block_sizes_add_up():
    size = compression.sizer(b"")
    data = bytes(np.random.default_rng(1).integers(97, 123, 200_000, np.uint8))
    assert compression.whole_size(size, data) == sum(size(data[at:at + compression.BLOCK_BYTES]) for at in range(0, len(data), compression.BLOCK_BYTES))


def test_distances_are_what_the_toxic_dictionary_saves():
    import zstandard

    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(80)]
    plain = [" ".join(rng.choice(words, 40)).encode() for _ in range(200)]
    toxic = [" ".join([*rng.choice(words, 20), "dreadful scoundrel", *rng.choice(words, 20)]).encode() for _ in range(200)]
    ordinary = compression.trained([w for c in plain for w in toxicity.windows(c)], 1 << 12)
    special = compression.trained(toxicity.toxic_parts(toxic, toxicity.segments(toxic, plain)), 1 << 12)
    assert b"scoundrel" in special and not any(w.encode() in special for w in words)

    def size(content, data):
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    for data in (toxic[0] + plain[0], plain[1], b"", b"x"):
        want = [size(ordinary, w) - size(special + b"\n" + ordinary, w) for w in toxicity.windows(data)] or [0]
        got = toxicity._distances(ordinary, special)(data)
        assert got.tolist() == want and (got.max() > 3) == (b"scoundrel" in data)
        d = sorted(want, reverse=True)
        row = toxicity._compute(ordinary, special, 3)([data.decode()])[0]
        assert row[:3] == (d[0], sum(d[:3]) / len(d[:3]), sum(d) / len(d)) and row[4] == sum(x >= 3 for x in d) / len(d)


def test_quality_features_are_sizes():
    import math

    import zstandard

    rng = np.random.default_rng(4)
    text = lambda n: " ".join("".join(map(chr, rng.integers(97, 110, 5))) for _ in range(n))
    good, bad = (compression.trained([text(60).encode() for _ in range(300)], 1 << 13) for _ in range(2))

    def size(content, data):
        given = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
        return len(zstandard.ZstdCompressor(level=compression.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **given).compress(data))

    for data in (text(100), "", "ü" * 30):
        raw = data.encode()
        plain, a, b, n = size(b"", raw), size(good, raw), size(bad, raw), max(1, len(raw))
        assert quality._compute(good, bad)([data])[0] == pytest.approx(((a - b) / plain, min(2, plain / n), min(2, a / n), min(2, b / n), math.log1p(n)))


def test_too_few_samples_are_kept_whole():
    assert compression.trained([b"abc", b"defg", b"hi"], 8) == b"defg\nhi" and compression.trained([], 8) == b""
    assert compression.trained([b"x" * 20], 8) == b"x" * 8
