"""A stored inverted index for keyword retrieval.

Chunks are cut into words when they are added, never when queries are asked. The
postings of a term are cut into blocks by a hash of the chunk, so a common word is
many rows. A block's header (entries, highest count, least length) bounds what any
of its chunks can gain, and queries leave out what these bounds rule out.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ledgerlens.functions.scoring import BestPerQuery, TermWeights
from ledgerlens.operators.ordering import first_n
from ledgerlens.operators.retrieval import BROADCAST_TERMS, TABLE_CELLS, _slot, inverse_frequency, term_gain, terms
from ledgerlens.session import stored

#: Folders of postings by term hash, fixed when an index is made, and least number of blocks of a batch by chunk hash.
PARTS, BLOCKS = 64, 256
#: A larger batch is cut into more blocks, of about so many chunks.
BLOCK_CHUNKS = 10_000
#: Scores nearer than this to a bound are never ruled out.
SLACK = 1e-6


def _part(term: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


class KeywordIndex:
    """Postings under ``root``, one folder per batch of chunks added.

    ``postings/batch=B/part=P`` has (term, block, entries, n, max_tf, min_len),
    ``chunks/batch=B`` the number and total length of the batch's chunks. A batch's
    chunk row is written last, so a batch without one was not finished and is not
    read; adding the same batch name again replaces what it left. A batch has
    ``blocks`` blocks, or as many as keep them near ``BLOCK_CHUNKS`` chunks; one
    task scores a block.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, blocks: int = BLOCKS):
        self.spark, self.root, self.parts, self.blocks = spark, root.rstrip("/"), parts, blocks
        self.last_plan: DataFrame | None = None  # of the last call: each query's terms and what their bounds say

    def add(self, chunks: DataFrame, batch: str | None = None, *, chunk_id: str = "chunk_id", chunk_text: str = "chunk_text") -> str:
        """Index chunks that are not in the index yet; ids are unique. Returns the batch's name."""
        batch = batch or uuid.uuid4().hex
        bags = chunks.select(F.col(chunk_id).alias("chunk_id"), terms(F.col(chunk_text)).alias("words"))
        # one empty term per chunk counts chunks and their words in the same pass
        words = bags.select("chunk_id", F.size("words").alias("len"), F.explode(F.concat("words", F.array(F.lit("")))).alias("term"))
        blocks = max(self.blocks, math.ceil(chunks.count() / BLOCK_CHUNKS))
        block = F.pmod(F.xxhash64("chunk_id", F.lit(11)), F.lit(blocks)).cast("int")
        # one exchange serves both groupings and the folders
        placed = words.withColumn("part", _part("term", self.parts)).withColumn("block", block).repartition("part", "block")
        counted = placed.groupBy("part", "block", "term", "chunk_id", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        entries = F.sort_array(F.collect_list(F.when(F.col("term") != "", F.struct("chunk_id", "tf", "len"))))
        rows = counted.groupBy("part", "block", "term").agg(
            entries.alias("entries"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
            F.sum("len").alias("total_len"))
        path = f"{self.root}/postings/batch={batch}"
        rows.select("term", "block", "entries", "n", "max_tf", "min_len", "total_len", "part").sortWithinPartitions("part", "term").write.mode(
            "overwrite").partitionBy("part").parquet(path)
        whole = self.spark.read.parquet(path).filter((F.col("term") == "") & (F.col("part") == _part("term", self.parts))).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("total_len"), F.lit(0)).alias("words"))
        whole.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/chunks/batch={batch}")
        return batch

    def postings(self) -> DataFrame | None:
        """Blocks of all finished batches."""
        try:
            done = self.spark.read.parquet(f"{self.root}/chunks").select("batch").distinct()
            return self.spark.read.option("basePath", f"{self.root}/postings").parquet(f"{self.root}/postings").join(
                F.broadcast(done), "batch", "left_semi")  # one row per batch
        except AnalysisException:
            return None

    def topk(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query_text: str = "query_text",
             k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """Best chunks per query by exact terms (BM25), ties to the lowest chunk id.

        Block headers give every term's weight and the most it can add. The entries
        of a query's strongest term alone give ``k`` scores that its answers reach
        at least. Terms that together stay below cannot make an answer, so only
        chunks with one of the other terms are scored, and of those terms' blocks
        only ones whose bound reaches the score. Results are exact. A block is
        scored in one task, which sends on the ``k`` best of every query only;
        queries are asked in slices of at most about ``BROADCAST_TERMS`` words.
        """
        blocks = self.postings()
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(terms(F.col(query_text)))).alias("term"))
        if blocks is None:
            return queries.select(F.col(query_id), F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
        total, words = self.spark.read.parquet(f"{self.root}/chunks").agg(F.sum("chunks"), F.sum("words")).first()
        mean = words / total if total else 0.0
        slices = max(1, math.ceil(asked.count() / BROADCAST_TERMS))
        parts = [self._slice(asked.filter(_slot("query_id", F.lit(slices)) == i), blocks, k, total, mean, k1, b) for i in range(slices)]
        self.last_plan = reduce(DataFrame.unionAll, [plan for plan, _ in parts])
        found = reduce(DataFrame.unionAll, [found for _, found in parts]).withColumn("score", F.round("score", 9))
        return first_n(found, ["query_id"], [F.desc("score"), F.col("chunk_id")], k, "rank").withColumnRenamed("query_id", query_id)

    def _slice(self, asked: DataFrame, blocks: DataFrame, k: int, total: int, mean: float, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
        """Each query's terms with what their bounds say, and (query_id, chunk_id, score) of every block's best."""
        asked = stored(asked.withColumn("part", _part("term", self.parts)), "asked")
        wanted = asked.select("part", "term").distinct()
        folders = [r[0] for r in wanted.select("part").distinct().collect()]  # at most ``parts``
        held = blocks.filter(F.col("part").isin(folders)).join(F.broadcast(wanted), ["part", "term"], "left_semi")
        bound = term_gain(F.col("max_tf"), F.col("min_len"), F.lit(mean), k1, b)
        strength = held.groupBy("term").agg(F.sum("n").alias("df"), F.max(bound).alias("most")).select(
            "term", inverse_frequency(F.lit(total), F.col("df")).alias("idf"), "most")
        plan = asked.join(strength, "term").select("query_id", "term", "idf", (F.col("idf") * F.col("most")).alias("most"))
        weakest = Window.partitionBy("query_id").orderBy("most", "term")
        plan = stored(plan.withColumn("below", F.sum("most").over(weakest.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
            "all", F.sum("most").over(Window.partitionBy("query_id"))).withColumn(
            "strongest", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), F.desc("term"))) == 1), "plan")
        seed = self._best(plan.filter("strongest").withColumn("essential", F.lit(True)).withColumn("floor", F.lit(None).cast("double")), held, k, mean, k1, b)
        floor = first_n(seed, ["query_id"], [F.desc("score"), F.col("chunk_id")], k, "rank").filter(
            F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("floor"))
        plan = stored(plan.join(floor, F.col("query_id").eqNullSafe(F.col("_query")), "left").drop("_query").withColumn(
            "essential", F.col("floor").isNull() | (F.col("below") + SLACK >= F.col("floor"))), "bounds")
        return plan, self._best(plan, held, k, mean, k1, b)

    def _best(self, plan: DataFrame, held: DataFrame, k: int, mean: float, k1: float, b: float) -> DataFrame:
        """The ``k`` best chunks of every block for the queries and terms of ``plan``."""
        table = plan.select("query_id", "term", "idf", "most", "all", "floor", "essential").toArrow().combine_chunks()
        names = pc.unique(table["term"])
        number = pc.index_in(table["term"], value_set=names).to_numpy()
        order = np.argsort(number, kind="stable")
        weights = TermWeights.of(table["query_id"], number, table["idf"].to_numpy(), np.ones(len(names)))
        most, every, floor, essential = (table[c].to_numpy()[order] for c in ("most", "all", "floor", "essential"))
        floor = np.where(np.isnan(floor.astype(float)), -np.inf, floor.astype(float))
        shared = self.spark.sparkContext.broadcast((names, weights, number[order], every - most + SLACK - floor, essential.astype(bool)))

        def scored(rows: pa.Table) -> pa.Table:
            names, weights, term_of, others, essential = shared.value
            rows, top = rows.combine_chunks(), BestPerQuery(k)
            mine = pc.index_in(rows["term"], value_set=names.cast(rows["term"].type)).to_numpy()
            lists = rows["ids"].combine_chunks()
            term = np.repeat(mine, lists.value_lengths().to_numpy())
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            row, ids = coded.indices.to_numpy(), coded.dictionary
            tf, length = (rows[c].combine_chunks().flatten().to_numpy() for c in ("tfs", "lens"))
            by_row = np.argsort(row, kind="stable")
            row, term, gain = row[by_row], term[by_row], term_gain(tf, length, mean, k1, b)[by_row]
            bound = np.full(len(names), -np.inf)  # a batch written twice over has one row per term and block
            np.maximum.at(bound, mine, term_gain(rows["max_tf"].to_numpy(), rows["min_len"].to_numpy(), mean, k1, b))
            # terms an answer has to have, where they can reach the floor with all other terms
            opens = essential & (weights.weight * bound[term_of] + others >= 0)
            first, rest = weights.only(opens), weights.only(~opens & np.isin(weights.query, weights.query[opens]))
            ends = np.searchsorted(row, np.arange(len(ids) + 1))
            for at, table in first.tables(row, term, gain, len(ids), TABLE_CELLS):
                part = slice(ends[at], ends[at + len(table)])
                rival = table > 0
                some = rival.any(axis=1)[row[part] - at]
                # other terms count only where a rival has them
                for low, more in rest.tables((row[part] - at)[some], term[part][some], gain[part][some], len(table), TABLE_CELLS):
                    table[low:low + len(more)] += np.where(rival[low:low + len(more)], more, 0.0)
                top.add(table, ids.slice(at, len(table)))
            found = list(top.rows(weights.queries, "query_id", "chunk_id"))
            return pa.Table.from_batches(found) if found else empty

        kind = held.schema["entries"].dataType.elementType["chunk_id"].dataType
        schema = T.StructType([plan.schema["query_id"], T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType())])
        empty = to_arrow_schema(schema).empty_table()
        lists = held.join(F.broadcast(plan.select("term").distinct()), "term", "left_semi").select(
            "batch", "block", "term", "max_tf", "min_len", F.col("entries.chunk_id").alias("ids"), F.col("entries.tf").alias("tfs"),
            F.col("entries.len").alias("lens"))
        return lists.groupBy("batch", "block").applyInArrow(scored, schema)
