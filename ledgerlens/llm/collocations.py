"""Phrase collocations by SON partitioning.

The tasks' rows form a few shards. A phrase that occurs ``support`` times in all
occurs at least its share of that in one shard, a shard's share being that of its
words. So every shard is mined completely at this lowered support, longer phrases
only where their parts are frequent; the union of what the shards find holds every
frequent phrase, and another pass counts all of it exactly.

A shard spans many tasks, since more shards than ``support`` could not lower it
further than to one occurrence; Spark adds up the tasks' counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import bit_filter, byte_groups, in_filter, mix, stored, word_lists

LONGEST, SUPPORT, SHARDS = 4, 30, 8
TOP, SCALE, ABSORB = 2000, 2_000_000, 80
UNKNOWN = "und"
#: A task counts about so many words at once, then hands over the counts; results do not depend on it.
CHUNK, EMIT = 1 << 20, 1 << 16
#: Phrases that meet in one group while hashes are added up, about; rows of blocks made at once.
PART, SLICE = 1 << 20, 1 << 6
SALTS = 16

END = b"."
#: A-Z lower-cased, every end of a piece a full stop, a tab a space.
FOLDED = bytes.maketrans(
    bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + END * 9 + b" ")
STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word)


def joined_hash(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and its last word's."""
    return mix(first * STEP + word)


class _Words(dict):
    """Number of every word by first appearance; 0 ends a piece."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word):
        self[word] = value = len(self)
        return value


class Chunk:
    """Words of one language as numbers, with an end between pieces."""

    def __init__(self, lang: str):
        self.lang, self.words, self.parts, self.size = lang, _Words(), [], 0

    def add(self, texts: list[bytes]) -> None:
        data = (b" . ".join(texts)).translate(FOLDED).replace(END, b" . ")
        for words in word_lists(data):
            self.parts.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int64))

    def counts(self, level: int, wanted: np.ndarray | None):
        """(columns of word numbers, counts) of the distinct phrases asked for.

        Level 1: words. Level 2: pairs of ``wanted`` words. Level 3: longer phrases
        of ``wanted`` pairs. Level 0: phrases of two and more words in ``wanted``.
        """
        ids = np.concatenate(self.parts)
        if level == 1:
            total = np.bincount(ids, minlength=len(self.words))
            yield [np.arange(1, len(total))], total[1:]
            return
        hashes = self.hashes()
        if level == 2:
            good = in_filter(wanted, hashes)
            good[0] = False
            at = np.flatnonzero(good[ids[:-1]] & good[ids[1:]])
            yield _distinct(ids, at, 2)
            return
        held, at = hashes[ids], np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        value = joined_hash(held[at], held[at + 1])
        if level == 3:
            pair = np.zeros(len(ids) + LONGEST, bool)
            pair[at[in_filter(wanted, value)]] = True
            here = np.flatnonzero(pair)
            for length in range(3, LONGEST + 1):
                here = here[pair[here + length - 2]]
                yield _distinct(ids, here, length)
            return
        for length in range(2, LONGEST + 1):
            yield _distinct(ids, at[in_filter(wanted, value)], length)
            more = (at + length < len(ids)) & (ids[np.minimum(at + length, len(ids) - 1)] > 0)
            at = at[more]
            value = joined_hash(value[more], held[at + length])

    def hashes(self) -> np.ndarray:
        return np.fromiter((word_hash(self.lang, w) for w in self.words), np.uint64, len(self.words))


def _distinct(ids: np.ndarray, at: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases of ``length`` words at the given places, with their counts."""
    used = np.zeros(int(ids.max(initial=0)) + 1, bool)
    for i in range(length):
        used[ids[at + i]] = True
    words = np.flatnonzero(used)
    number, base = np.cumsum(used) - 1, max(1, len(words))
    if base ** length < 1 << 63:  # a phrase of these words is one number
        keys = np.zeros(len(at), np.int64)
        for i in range(length):
            keys = keys * base + number[ids[at + i]]
        keys, counts = np.unique(keys, return_counts=True)
        columns = []
        for _ in range(length):
            keys, word = np.divmod(keys, base)
            columns.append(words[word])
        return columns[::-1], counts
    group, columns = number[ids[at]], None
    for i in range(1, length):
        keys, place, counts = np.unique(group * base + number[ids[at + i]], return_inverse=True, return_counts=True)
        before, word = keys // base, words[keys % base]
        columns = [words[before], word] if columns is None else [*[c[before] for c in columns], word]
        group = place
    return columns, counts


def lang_key(lang: str) -> int:
    """The same 64 bits as Spark's xxhash64 of the name."""
    value = xxhash.xxh64_intdigest(lang.encode(), seed=42)
    return value - (1 << 64) if value >> 63 else value


WHOLE = "shard int, lang string, phrase string, n long"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


def _chunks(batches, shards: int):
    """(chunk, shard) of a task's rows, one chunk per language at a time."""
    shard, open_chunks = TaskContext.get().partitionId() % shards, {}
    for batch in batches:
        langs, at = batch.column("lang").to_pylist(), 0
        for group in byte_groups(batch.column("text")):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[at:at + len(group)], group, strict=True):
                by_lang.setdefault(lang, []).append(text)
            at += len(group)
            for lang, texts in by_lang.items():
                open_chunks.setdefault(lang, Chunk(lang)).add(texts)
            if sum(c.size for c in open_chunks.values()) >= CHUNK:
                for chunk in open_chunks.values():
                    yield chunk, shard
                open_chunks = {}
    for chunk in open_chunks.values():
        yield chunk, shard


def shard_counts(docs: DataFrame, level: int, wanted, shards: int) -> DataFrame:
    """What every task counts as WHOLE rows, not added up between tasks."""
    names = [c.split()[0] for c in WHOLE.split(", ")]

    def run(batches):
        for chunk, shard in _chunks(batches, shards):
            table = pa.array(list(chunk.words), pa.binary()).cast(pa.string())
            for columns, counts in chunk.counts(level, wanted.value if wanted else None):
                for low in range(0, len(counts), EMIT):
                    part, n = [c[low:low + EMIT] for c in columns], counts[low:low + EMIT]
                    texts = [table.take(pa.array(c)) for c in part]
                    what = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, " ")
                    key = pa.array([chunk.lang] * len(n), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), key, what, pa.array(n, pa.int64())], names)

    return _texts(docs).mapInArrow(run, WHOLE)


BLOCKS = "shard int, lang_key long, part int, hashes binary, counts binary"


def hash_blocks(docs: DataFrame, level: int, wanted, shards: int, ranges: int) -> DataFrame:
    """The hashed counts of ``shard_counts``, those of a task's chunk and of one part of the hashes in a row."""
    def run(batches):
        for shard, lang, hashes, counts in _chunk_hashes(batches, level, wanted.value, shards):
            part = ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            held, at = np.unique(part[order], return_index=True)
            hashes, counts = hashes[order], counts[order].astype(np.int32)
            ends = [*at[1:], len(order)]
            for low in range(0, len(held), SLICE):
                cut = range(low, min(low + SLICE, len(held)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(cut), shard, np.int32)), pa.array(np.full(len(cut), lang_key(lang))), pa.array(held[cut.start:cut.stop]),
                    pa.array([hashes[at[i]:ends[i]].tobytes() for i in cut], pa.binary()),
                    pa.array([counts[at[i]:ends[i]].tobytes() for i in cut], pa.binary())], [c.split()[0] for c in BLOCKS.split(", ")])

    return _texts(docs).mapInArrow(run, BLOCKS)


def _chunk_hashes(batches, level: int, bits: np.ndarray, shards: int):
    """(shard, lang, hashes of phrases, counts) for every chunk and length of phrases."""
    for chunk, shard in _chunks(batches, shards):
        hashes = chunk.hashes()
        for columns, counts in chunk.counts(level, bits):
            value = hashes[columns[0]]
            for words in columns[1:]:
                value = joined_hash(value, hashes[words])
            yield shard, chunk.lang, value.view(np.int64), counts


def _hashes(phrases: DataFrame) -> DataFrame:
    """``hash`` of every single word (lang, phrase)."""
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)
            out = np.fromiter((word_hash(lang, word.encode()) for lang, word in pairs), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["hash"])

    return phrases.select("lang", "phrase").mapInArrow(run, "hash long")


def mine(docs: DataFrame, level: int, wanted, bars: DataFrame, shards: int, ranges: int) -> DataFrame:
    """``hash`` of what is frequent inside some shard; ``bars`` has every shard's own support.

    Phrases stand as 64-bit hashes here: two of one hash could only make each other
    seem more frequent, and the last pass counts the phrases themselves. They
    travel as blocks of a shard and one of ``ranges`` parts of the hashes, which are
    added up where a shard's blocks of a part meet.
    """
    blocks = hash_blocks(docs, level, wanted, shards, ranges)
    least = F.coalesce("least", F.lit(1)).cast("long").alias("least")
    judged = blocks.join(bars, ["shard", "lang_key"], "left").select("shard", "lang_key", "part", "hashes", "counts", least)

    def add_up(table: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.int64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        found = hashes[first[np.add.reduceat(n, first) >= table.column("least")[0].as_py()]]
        return pa.table({"hash": found})

    return judged.groupBy("shard", "lang_key", "part").applyInArrow(add_up, "hash long").distinct()


def phrase_counts(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all words, (lang, phrase, a) of all phrases of one to four words that occur ``support`` times in a language).

    Texts are cut at ``.,;:!?`` and line ends; phrases do not cross the cuts. A-Z
    count as a-z. Null languages are ``und``; null, empty and blank texts have no
    words; a repeated row counts again; other columns are ignored.
    """
    spark = docs.sparkSession
    # the sum of all shards' (least - 1) stays under the support, however rows fall into shards in a later pass
    words = stored(shard_counts(docs, 1, None, shards).groupBy("shard", "lang", "phrase").agg(F.sum("n").alias("n")), "words")
    share = words.groupBy("shard", "lang").agg(F.sum("n").alias("w"))
    totals = stored(share.groupBy("lang").agg(F.sum("w").alias("n")), "totals")
    bars = stored(share.join(totals, "lang").select(
        "shard", F.xxhash64("lang").alias("lang_key"), F.expr(f"({support} * cast(w as decimal(20,0)) + n - 1) div n").alias("least")), "supports")
    frequent = stored(words.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= support), "frequent")
    # so many parts of the hashes that a part of a shard has about PART phrases at most, and every task some
    size = totals.agg(F.sum("n")).first()[0] or 0
    ranges = 1 + max(2 * size // (PART * shards), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    pairs = stored(mine(docs, 2, spark.sparkContext.broadcast(bit_filter(_hashes(frequent))), bars, shards, ranges), "pairs")
    longer = stored(mine(docs, 3, spark.sparkContext.broadcast(bit_filter(pairs)), bars, shards, ranges), "longer")
    wanted = spark.sparkContext.broadcast(bit_filter(pairs.unionByName(longer)))
    counted = shard_counts(docs, 0, wanted, shards).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    return totals, stored(frequent.unionByName(counted.where(F.col("a") >= support)), "phrases")


def _parts(words: str, first, length) -> F.Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    ``l`` and ``r`` count the two sides of the cut whose floor(2,000,000 a / (l + r))
    is least (ties: the shortest first part). A phrase inside a longer one that has
    80 percent of its occurrences goes. Best first by score, then a, then phrase.
    No frequent phrase gives no rows.
    """
    totals, counts = phrase_counts(docs, support, shards)
    sized = counts.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    several = sized.where("k > 1")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    # a common word begins or ends many phrases, so single words are looked up in salted copies
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.explode(
        F.when(F.instr("phrase", " ") > 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("salt"))
    cuts = several.select("lang", "phrase", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), _parts("words", F.lit(1), F.col("cut")).alias("part"), F.col("cut").alias("size")),
        F.struct(F.lit("r").alias("side"), _parts("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"),
                 (F.col("k") - F.col("cut")).alias("size")))).alias("s")).select(
        "lang", "phrase", "a", "cut", "s.*", F.when(F.col("s.size") > 1, F.lit(-1)).otherwise(salt).alias("salt"))
    met = sides.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    scored = met.withColumn("score", F.expr(
        f"cast({SCALE} as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = several.where("k > 2").select("lang", F.col("a").alias("longer"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(
            F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))))).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hundred = F.lit(100).cast("decimal(3,0)")
    kept = best.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * hundred < F.col("a").cast("decimal(20,0)") * F.lit(ABSORB).cast("decimal(3,0)")))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")
