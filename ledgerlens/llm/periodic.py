"""Periodic runs of words by longest common extensions on a harmonic grid.

A run of period p holds two places p apart, the first of them on a grid whose step
grows with p. So the places of the grids of all periods, about n log n in all, are
compared with the word p further on. How far the two agree to the right and to the
left gives the run. Few words are compared one by one; beyond them a difference
cover answers: only suffixes at its places are sorted, two places reach it
together within few words, and a sparse table over the sorted suffixes' common
prefixes tells how far they agree from there.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import byte_groups, word_lists

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words compared one by one to either side before common extensions are asked for.
NEAR = 8
#: Pairs of places are settled in lots of about so many.
LOT = 1 << 19
JOIN = 1 << 16
WORD_GAP = "[\\x20\\x09-\\x0D]+"

#: Every difference modulo 31 is that of two of these.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)


def _shifts() -> np.ndarray:
    """Least shift that brings two residues into the cover together."""
    held = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(s for s in range(MODULUS) if held[a + s] and held[b + s])
    return out


SHIFTS = _shifts()


def agree(words: np.ndarray, i: np.ndarray, j: np.ndarray, limit: np.ndarray | int, step: int = 1) -> np.ndarray:
    """Words that agree from two places on, or backwards with ``step`` -1, up to ``limit``; ``words`` ends in sentinels."""
    out, limit = np.zeros(len(i), np.int64), np.broadcast_to(limit, len(i))
    live = np.flatnonzero(limit > 0)
    n = 0
    while len(live):
        a, b = i[live] + n * step, j[live] + n * step
        inside = (a >= 0) & (b >= 0) & (a < len(words)) & (b < len(words))
        same = inside.copy()
        same[inside] = words[a[inside]] == words[b[inside]]
        live = live[same]
        n += 1
        out[live] = n
        live = live[limit[live] > n]
    return out


class Extensions:
    """Longest common extensions to the right of any two places of ``words``, which ends in a word of its own."""

    def __init__(self, words: np.ndarray):
        self.words = words
        size = len(words)
        self.places = places = np.flatnonzero(np.isin(np.arange(size) % MODULUS, COVER))
        m = len(places)
        self.number = np.full(size + 1, m, np.int64)  # of the sample at a place; m beyond the end
        self.number[places] = np.arange(m)
        padded = np.concatenate([words.astype(np.int32), np.full(MODULUS, -1, np.int32)])
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[places])
        kinds = blocks.view(np.dtype((np.void, blocks.dtype.itemsize * MODULUS)))[:, 0]
        rank = np.unique(kinds, return_inverse=True)[1].reshape(-1) + 1
        # a sample's suffix is a row of blocks; ranks of 1, 2, 4, ... blocks from each sample on
        self.levels, jump = [np.append(rank, 0)], MODULUS
        while m and len(np.unique(rank)) < m:
            after = self.number[np.minimum(places + jump, size)]
            rank = np.unique(rank * np.int64(m + 2) + self.levels[-1][after], return_inverse=True)[1].reshape(-1) + 1
            self.levels.append(np.append(rank, 0))
            jump *= 2
        self.rank = rank - 1
        self._common_prefixes()

    def _common_prefixes(self) -> None:
        """Blocks in common of neighbours in sorted order, as a sparse table of minima."""
        order = np.argsort(self.rank)
        a, b, size = self.places[order[:-1]], self.places[order[1:]], len(self.words)
        common = np.zeros(len(a), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[depth]
            x, y = self.number[np.minimum(a, size)], self.number[np.minimum(b, size)]
            same = (rank[x] == rank[y]) & (rank[x] > 0)
            common += same.astype(np.int64) << depth
            a, b = a + same * (MODULUS << depth), b + same * (MODULUS << depth)
        self.table, width = [common], 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _blocks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Blocks in common of two different samples."""
        low, high = np.minimum(self.rank[x], self.rank[y]), np.maximum(self.rank[x], self.rank[y])
        depth = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int64)
        for d in np.unique(depth):
            here = depth == d
            table = self.table[d]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(d))])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFTS[i % MODULUS, j % MODULUS]
        out = agree(self.words, i, j, shift)
        far = np.flatnonzero((out == shift) & (i + shift < len(self.words)) & (j + shift < len(self.words)))
        a, b = i[far] + shift[far], j[far] + shift[far]
        more = self._blocks(self.number[a], self.number[b]) * MODULUS
        out[far] += more + agree(self.words, a + more, b + more, MODULUS)
        return out


def grid_step(period: int, least: int, exponent: int) -> int:
    """Every run of this period has a place on the grid that lies a period or more before its end."""
    return max(least, exponent * period) - period


def _settle(words: np.ndarray, ends: np.ndarray, i: np.ndarray, p: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(start, end, period) of the runs through places i and i + p, where the words are alike."""
    j = i + p
    right, left = agree(words, i, j, NEAR), agree(words, i - 1, j - 1, NEAR, -1)
    far = np.flatnonzero((right == NEAR) | (left == NEAR))
    if len(far):
        # the documents concerned, put together anew
        owner = np.searchsorted(ends, i[far], side="right")
        docs, owner = np.unique(owner, return_inverse=True)
        first = np.concatenate([[0], ends])[docs]
        sizes = ends[docs] - first
        base = np.cumsum(sizes) - sizes
        some = words[np.arange(sizes.sum()) + np.repeat(first - base, sizes)]
        # a document ends in its sentinel; in reverse it begins with it, so one more goes to the end
        a = i[far] - first[owner] + base[owner]
        b = a + p[far]
        right[far] = Extensions(some)(a, b)
        turned = np.append(some[::-1], words.min() - 1)
        last = len(some) - 1
        back = a > 0
        left[far] = 0
        left[far[back]] = Extensions(turned)(last - (a[back] - 1), last - (b[back] - 1))
    keep = left + right + p >= np.maximum(least, exponent * p)
    return np.stack([(i - left)[keep], (j + right)[keep], p[keep]], axis=1)


def runs_of(texts: list[np.ndarray], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """(start, length, period) of all runs in each row of word numbers, by start and period."""
    out = [np.empty((0, 3), np.int64) for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    order = [k for k in np.argsort(-sizes, kind="stable") if sizes[k] >= least]
    if not order:
        return out
    # the longest first, so that the periods a text is too short for see only a beginning of the row
    words = np.concatenate(list(chain.from_iterable((texts[k], np.array([-2 - n])) for n, k in enumerate(order)))).astype(np.int64)
    ends = np.cumsum(sizes[order] + 1)
    count, found, lots, size = len(order), [], [], 0
    for period in range(1, int(sizes[order[0]]) // exponent + 1):
        while sizes[order[count - 1]] < max(least, exponent * period):
            count -= 1
        limit, step = ends[count - 1], grid_step(period, least, exponent)
        hits = np.flatnonzero(words[0:limit - period:step] == words[period:limit:step]) * step
        if len(hits):
            lots.append((hits, period))
            size += len(hits)
        if size >= LOT:
            found.append(_distinct_runs(words, ends, lots, least, exponent))
            lots, size = [], 0
    if lots:
        found.append(_distinct_runs(words, ends, lots, least, exponent))
    runs = _least_periods(np.concatenate(found)) if found else np.empty((0, 3), np.int64)
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    for n in np.unique(owner):
        mine = runs[owner == n]
        start = mine[:, 0] - (ends[n - 1] if n else 0)
        rows = np.stack([start, mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
        out[order[n]] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def _distinct_runs(words, ends, lots, least, exponent) -> np.ndarray:
    places = np.concatenate([h for h, _ in lots])
    periods = np.repeat([p for _, p in lots], [len(h) for h, _ in lots]).astype(np.int64)
    return _least_periods(_settle(words, ends, places, periods, least, exponent))


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Of the same stretch with several periods, the least."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def collapse(size: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay if of every run only the first period does."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) of every row: runs as (start, length, period) in words, by start and period.

    A run is a longest stretch of ``least`` words or more that repeats its smallest
    period at least ``exponent`` times, a part of it counting. ``collapsed`` has the
    words, joined by one space, without what follows the first period of each run.
    A null, empty or blank text has no runs and an empty collapsed text; every row
    is worked on by itself; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for group in byte_groups(batch.column("text")):
                numbers: dict[bytes, int] = {}
                texts = []
                for data in group:
                    parts = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in word_lists(data)]
                    texts.append(np.concatenate(parts))
                vocabulary = list(numbers)
                runs = runs_of(texts, least, exponent)
                collapsed = []
                for text, mine in zip(texts, runs, strict=True):
                    kept = text[collapse(len(text), mine)] if len(mine) else text
                    collapsed.append(b" ".join(b" ".join(map(vocabulary.__getitem__, kept[low:low + JOIN].tolist())) for low in range(0, len(kept), JOIN)))
                flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(group)), pa.ListArray.from_arrays(pa.array(offsets), values).cast(kind),
                     pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])
                at += len(group)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, runs array<{RUN}>, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length over period (ties: smallest start, then period); null without runs."""
    def better(a, b):
        left, right = b["length"] * a["period"], a["length"] * b["period"]
        return F.when(left > right, b).otherwise(a)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by the CRC of its id, turns periodic at some word.

    With h that CRC and g = h / 10: in texts of n words with h % 10 = 0, words from
    place g % n on repeat with a period that fits 3 + g % 8 times into the rest. A
    null doc_id leaves its text alone.
    """
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), WORD_GAP), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    sized = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    sized = sized.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get(F.col("words"), F.col("a") + i % F.col("p")))
    turned = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))
