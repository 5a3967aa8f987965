"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import shared_dir

#: New words after which a task forgets older ones; results do not depend on it.
MEMO_WORDS = 150_000
#: A longer word is worked out each time, so that the memo stays small.
MEMO_BYTES = 200
#: Texts are worked on in groups of about so many bytes.
GROUP_BYTES = 1 << 20
SLICE_ROWS = 64
#: Rows of a slice of a batch, however short their texts are.
TEXT_ROWS = 1 << 10


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: str, parts: int) -> Column:
    """crc32 of a key as text, modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front if ``df`` has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def row_key() -> Column:
    """16 bytes that tell a row by doc_id and text, nulls told from values; rows alike in both share it."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat_ws("\n", *parts).cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of (a, b) edges can reach.

    Every round hooks each node to its smallest neighbour, follows parents twice
    and contracts the edges, so at least half of the remaining nodes go. Nothing
    is collected; an edge list without rows gives no rows. ``edges`` is worked out once.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(
            F.col("a").alias("node"), F.least("a", "p").alias("p"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("node", F.col("pp").alias("p"))
        parent = stored(parent, "parents")
        if labels is None:  # the first parents are those of all nodes
            labels = parent.withColumnRenamed("p", "label")
        else:
            labels = stored(
                labels.join(parent.withColumnRenamed("node", "label"), "label", "left")
                .select("node", F.coalesce("p", "label").alias("label")), "labels")
        edges = stored(
            edges.join(parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
            .join(parent.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
            .where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def byte_groups(column: pa.Array) -> Iterator[list[bytes]]:
    """Texts of an Arrow column as UTF-8 (null: empty), in order, in lists of about GROUP_BYTES."""
    data = column.cast(pa.large_binary())
    group, size = [], 0
    for at in range(0, len(data), SLICE_ROWS):
        for text in data.slice(at, SLICE_ROWS).to_pylist():
            group.append(text or b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield group
                group, size = [], 0
    if group:
        yield group


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut, in order, into slices of at most TEXT_ROWS rows and GROUP_BYTES of ``text``, or one longer text.

    A worker that turns slice after slice into Python strings holds few at a time; what
    a whole batch needs would stay with the worker for all later stages.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_string())), 0)
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_BYTES, side="right"))
        end = min(max(fit, at + 1), at + TEXT_ROWS)
        yield batch.slice(at, end - at)
        at = end


def word_parts(data: bytes) -> Iterator[bytes]:
    """The text cut at ASCII white space into parts of at most GROUP_BYTES, unless a word is longer."""
    at = 0
    while len(data) - at > GROUP_BYTES:
        cut = max(data.rfind(b, at, at + GROUP_BYTES) for b in (b" ", b"\n", b"\t", b"\r"))
        if cut <= at:
            found = [x for x in (data.find(b, at + GROUP_BYTES) for b in (b" ", b"\n", b"\t", b"\r")) if x >= 0]
            cut = min(found, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in a list per part of the text."""
    return (part.split() for part in word_parts(data))


class Memo(dict):
    """Value by word, worked out when first seen; words not seen for two spans of MEMO_WORDS new ones are forgotten."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, word):
        value = self.before.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.before = self.copy()
                self.clear()
            self[word] = value
        return value

    def values_of(self, words: list) -> list:
        return list(map(self.__getitem__, words))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every input bit (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A bit filter has one bit per value of this many upper bits of a hash: 16 MB, whatever it stands for.
FILTER_BITS, BLOCK_BITS = 27, 15


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """Bits of the ``hash`` values that occur, packed on the executors and fetched in blocks of 4 KB."""
    tops = hashes.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("top")).distinct()

    def pack(batches):
        blocks: dict[int, np.ndarray] = {}  # 4 KB for each one that the task has
        for batch in batches:
            tops = np.sort(batch.column("top").to_numpy())
            for some in np.split(tops, np.flatnonzero(np.diff(tops >> BLOCK_BITS)) + 1) if len(tops) else []:
                bits = blocks.setdefault(int(some[0]) >> BLOCK_BITS, np.zeros(1 << (BLOCK_BITS - 3), np.uint8))
                place = some & ((1 << BLOCK_BITS) - 1)
                np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        packed = [bits.tobytes() for bits in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(packed, pa.binary())], ["block", "bits"])

    dealt = tops.repartition(F.shiftright("top", BLOCK_BITS))  # a block is packed by one task
    blocks = dealt.mapInArrow(pack, "block long, bits binary")
    out, size = np.zeros(1 << (FILTER_BITS - 3), np.uint8), 1 << (BLOCK_BITS - 3)
    for row in blocks.collect():  # at most 4096 rows
        out[row["block"] * size:(row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; one that it was made from always is."""
    top = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[top >> 3] >> (top & 7).astype(np.uint8) & 1).astype(bool)


def fit_logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge-penalised logistic model, by damped Newton steps."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge * max(1, len(x))
    eye[-1, -1] = 1e-9

    def loss(v):
        z = x @ v
        return np.sum(np.logaddexp(0, z) - labels * z) + v @ eye @ v / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + eye, x.T @ (p - labels) + eye @ w)
        rate = 1.0
        while rate > 1e-4 and (then := loss(w - rate * step)) > now:
            rate /= 2
        if rate <= 1e-4:
            break
        w, now, before = w - rate * step, then, now
        if before - now < 1e-9 * max(1, abs(now)):
            break
    return w


def logistic(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ w[:-1] + w[-1], -40, 40)))
