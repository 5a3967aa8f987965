"""Compressed sizes under zstandard dictionaries, and labelled training samples for them."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored

LEVEL = 3
BLOCK_BYTES = 1 << 16


def trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary content from samples; where there are too few to train on, the last whole ones that fit."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        kept, left = [], size
        for sample in reversed(samples):
            if len(sample) >= left:
                break
            kept.append(sample)
            left -= len(sample) + 1
        return b"\n".join(reversed(kept)) or samples[-1][-size:]


def sizer(content: bytes, raw: bool = False, level: int = LEVEL):
    """A function that gives the compressed size of up to BLOCK_BYTES of text."""
    options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) >= 8:
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
        options["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=kind)
        options["dict_data"].precompute_compress(level=level)
    compress = zstandard.ZstdCompressor(**options).compress
    return lambda data: len(compress(data))


def whole_size(size, data: bytes) -> int:
    """Compressed size of a text of any length, in blocks."""
    return sum(size(data[at:at + BLOCK_BYTES]) for at in range(0, max(1, len(data)), BLOCK_BYTES))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: int, calibration: int) -> DataFrame:
    """(doc_id, text, label, half): a bounded sample of training rows with label 0 or 1, in hash order.

    Half 0 holds at most ``per_label`` documents of each label, for dictionaries;
    half 1 at most ``calibration`` of both, in their natural share. Rows are picked
    in the label table, so their bounded list is what meets the documents, and no
    other text moves.
    """
    marks = labels.where(F.coalesce(train, F.lit(False))).select(
        F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    order = F.xxhash64("doc_id", F.lit(3))
    parts = [marks.where((F.col("half") == 0) & (F.col("label") == v)).orderBy(order).limit(per_label) for v in (0, 1)]
    parts.append(marks.where("half = 1").orderBy(order).limit(calibration))
    picked = parts[0].union(parts[1]).union(parts[2])
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(texts.join(F.broadcast(picked), "doc_id"), "labelled")


def chunk_sample(rows: DataFrame, chars: int, per_class: int) -> dict[int, list[str]]:
    """At most ``per_class`` chunks of ``chars`` code points per label, from all of the texts, in hash order."""
    cut = rows.where("text <> ''").select(
        "doc_id", "label", "text", F.explode(F.sequence(F.lit(0), ((F.length("text") - 1) / chars).cast("int"))).alias("n"))
    cut = cut.select("label", F.expr(f"substring(text, n * {chars} + 1, {chars})").alias("chunk"), F.xxhash64("doc_id", "n").alias("h"))
    out: dict[int, list[str]] = {}
    for value in (0, 1):
        found = cut.where(F.col("label") == value).orderBy("h", "chunk").limit(per_class).select("chunk").collect()
        out[value] = [r["chunk"] for r in found]
    return out


def doc_features(rows: DataFrame, compute, names: list[str]) -> DataFrame:
    """(doc_id, features...) with ``compute(list of texts)`` giving one tuple of doubles per text."""
    def run(batches):
        for batch in batches:
            values = list(zip(*compute(batch.column("text").to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, pa.float64()) for v in values)], ["doc_id", *names])

    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} double" for n in names))

