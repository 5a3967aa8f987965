"""MinHash near-duplicate groups with min-max signatures.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum. Bands of equal values name candidates; links are confirmed on
whole shingle sets, and linked documents form components.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import byte_groups, components, free_name, mix, row_key, stored, word_lists

#: 24 bands of 5: a pair of similarity 0.85 is missed once in a million, one of 0.8 once in 10,000.
BANDS, ROWS = 24, 5
#: Documents of a bucket are compared in blocks of about so many.
BLOCK = 2048
BLOCK_HASHES = 1 << 21
SLICE = 1 << 10


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8, A-Z lower-cased.

    Fewer words than ``width`` are one shingle; no words give none.
    """
    lists = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in word_lists(data.lower()) if w]
    words = np.concatenate(lists) if lists else np.empty(0, np.uint64)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: the first half from minima, the second from maxima of the same permutations."""
    count = (bands * rows + 1) // 2
    factor, shift = _factors(count)
    low, high = np.full(count, ~np.uint64(0)), np.zeros(count, np.uint64)
    for at in range(0, len(hashes), SLICE):
        moved = factor[:, None] * hashes[at:at + SLICE] + shift[:, None]
        moved ^= moved >> np.uint64(32)
        low, high = np.minimum(low, moved.min(axis=1)), np.maximum(high, moved.max(axis=1))
    values = np.concatenate([low, high])[:bands * rows].reshape(bands, rows)
    keys = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
    return keys.view(np.int64)


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys, at = batch.column("doc_id"), batch.column("key"), 0
            for group in byte_groups(batch.column("text")):
                counts, digests, found = [], [], []
                for data in group:
                    hashes = shingles(data, width)
                    counts.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                    found.append(band_keys(hashes, bands, rows) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(group)), keys.slice(at, len(group)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "n_shingles", "digest", "keys"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, key binary, n_shingles long, digest binary, keys array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of (node, text)."""
    def run(batches):
        for batch in batches:
            nodes, at = batch.column("node"), 0
            for group in byte_groups(batch.column("text")):
                sets = [shingles(data, width).tobytes() for data in group]
                yield pa.RecordBatch.from_arrays([nodes.slice(at, len(group)), pa.array(sets, pa.binary())], ["node", "hashes"])
                at += len(group)

    return texts.select("node", F.col("text").cast("string")).mapInArrow(run, "node long, hashes binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)], dtype=bool)

    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    return both.where(same("ha", "hb")).select("a", "b")


def block_links(side: np.ndarray, nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int) -> set[tuple[int, int]]:
    """Links that join different components of a block; one per document and foreign component is enough.

    ``side`` 1 marks documents that look for partners, 2 those that are looked up,
    3 both.
    """
    sizes = np.array([len(s) for s in sets])
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[by], owner[by]
    values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    looked = (side & 2) > 0
    found = set()
    for i in np.flatnonzero(side & 1):
        at = np.searchsorted(values, sets[i])
        held, start = counts[at], first[at]
        allowed = sizes[i] - (percent * sizes[i] + 99) // 100
        if np.partition(held, allowed)[allowed] == 1:
            continue  # so many hashes are its own alone that no one can be near enough
        # every posting of every hash: how often a document turns up is the size of the intersection
        place = np.arange(held.sum()) + np.repeat(start - np.cumsum(held) + held, held)
        common = np.bincount(owner[place], minlength=len(sets))
        near = looked & (labels != labels[i]) & (100 * common >= percent * (sizes + sizes[i] - common))
        near = np.flatnonzero(near)
        _, one = np.unique(labels[near], return_index=True)
        found.update((int(nodes[i]), int(nodes[j])) for j in near[one])
    return found


def _residual(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) of labels, from buckets of three or more that still span several components.

    Buckets are put together by the component that most of their documents are in,
    so the bands of one group are worked on once. There the documents outside that
    component look for partners in other components. Large groups are cut into
    blocks by a hash; every block of seekers meets every block of partners.
    """
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    spread = sizes.groupBy("key").agg(
        F.count("*").alias("labels"), F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("main")).where(
        "labels > 1 and n > 2").select("key", "main")
    rows = stored(named.join(spread, "key").select("main", "node", "label", "size").distinct(), "groups")
    cut = rows.groupBy("main").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_HASHES)).cast("int").alias("blocks"))
    rows = rows.join(cut, "main")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    seek = rows.where("label <> main").select("main", "node", "label", mine.alias("i"), F.explode(all_).alias("j"), F.lit(1).alias("side"))
    give = rows.select("main", "node", "label", F.explode(all_).alias("i"), mine.alias("j"), F.lit(2).alias("side"))
    cells = seek.unionByName(give).groupBy("main", "i", "j", "node", "label").agg(F.sum("side").alias("side"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        label = frame["label"].to_numpy()
        links = block_links(
            frame["side"].to_numpy(), label, label,
            [np.frombuffer(h, np.uint64) for h in frame["hashes"]], percent)
        return pd.DataFrame(sorted(links), columns=["a", "b"], dtype="int64")

    return cells.join(sets, "node").groupBy("main", "i", "j").applyInPandas(run, "a long, b long")


def _joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with the smallest of the labels that (a, b) edges join."""
    joined = components(edges).select(F.col("node").alias("label"), F.col("label").alias("into"))
    return classes.join(joined, "label", "left").withColumn("label", F.coalesce("into", "label")).drop("into")


def linked_classes(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                   block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a class is all rows with one set of shingles, a label all classes that links join.

    ``rows`` has doc_id, key (see :func:`row_key`), n_shingles and digest, which
    names the class and is null without shingles. ``classes`` has digest, label and
    the class's first row by doc_id (null last) and key: ``doc_id``, ``key``.
    """
    signed = stored(_signed(docs, width, bands, rows), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one")
    classes = signed.where("digest is not null").groupBy("digest").agg(first, F.min("n_shingles").alias("size"))
    # numbers are given while the classes are written, so they stay the same afterwards
    classes = stored(classes.select("digest", "one.doc_id", "one.key", "size", F.monotonically_increasing_id().alias("node")), "classes")
    heads = signed.select("key", "keys").join(classes.select("key", "node"), "key").select("node", F.explode("keys").alias("key")).distinct()
    heads = stored(heads, "bands")
    buckets = heads.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = stored(heads.join(buckets, "key").join(classes.select("node", "size"), "node"), "buckets")
    pairs = stored(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    needed = classes.join(members.select("node").distinct(), "node", "left_semi").select("key", "node")
    # a row that is there several times is read once
    texts = docs.select(row_key().alias("key"), "text").join(needed, "key").dropDuplicates(["key"])
    sets = stored(_sets(texts, width), "sets")
    labels = components(_confirmed(pairs, sets, percent))
    more = stored(_residual(members.where("n > 2").select("key", "node", "size"), labels, sets, percent, block), "links")
    named = classes.join(labels, "node", "left").select("digest", "doc_id", "key", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():
        named = _joined(named, more)
    return signed.select("doc_id", "key", "n_shingles", "digest"), stored(named, "named")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    distinct ``width``-word shingles; component_id is the smallest doc_id reached.
    Copies of one set are one class. A null, empty or blank text has no shingles and
    is linked with nothing. Rows that share a doc_id are one document: what any of
    its texts is linked with is one component, and n_shingles is its largest set.
    Every row with a null doc_id stays by itself, with a null component, and links
    nothing but its class. Other columns are ignored.
    """
    signed, classes = linked_classes(docs, width, percent, bands, rows, block)
    classes = classes.select("digest", "label", "doc_id")
    placed = signed.where("doc_id is not null").join(classes.select("digest", "label"), "digest").select("doc_id", "label").distinct()
    several = placed.groupBy("doc_id").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    edges = stored(placed.join(several, "doc_id").select(F.col("low").alias("a"), F.col("label").alias("b")), "documents")
    if not edges.isEmpty():
        classes = _joined(classes, edges)
    smallest = classes.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(smallest, "label").select("digest", "component_id")
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    out = signed.select("doc_id", "n_shingles", "digest", alone).join(named, "digest", "left").groupBy("doc_id", "alone").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of every group of rows with linked texts; columns stay as they are.

    Rows are judged by their own texts, whatever doc_id they have: the first by
    doc_id (null last) and text stays, and of rows alike in both only one. Rows
    without a word are no copies of each other and all stay.
    """
    signed, classes = linked_classes(docs, **options)
    winners = classes.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one")).select("label", F.col("one.key").alias("winner"))
    named = classes.join(winners, "label").select("digest", "winner")
    fate = signed.where("digest is not null").groupBy("digest", "key").agg(F.count("*").alias("n")).join(named, "digest")
    marks = stored(fate.where("key <> winner or n > 1").select("key", (F.col("key") != F.col("winner")).alias("gone")), "marks")
    key, gone = free_name(docs, "key"), free_name(docs, "gone")
    marked = docs.withColumn(key, row_key()).join(marks.select(F.col("key").alias(key), F.col("gone").alias(gone)), key, "left")
    kept = marked.where(F.col(gone).isNull())
    if not marks.where("not gone").isEmpty():  # winners that are there several times
        kept = kept.unionByName(marked.where(~F.col(gone)).dropDuplicates([key]))
    return kept.select(*docs.columns)
