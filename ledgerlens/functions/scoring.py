"""Numpy helpers that score chunks of words inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def listed_numbers(lists: pa.ListArray, names: pa.Array) -> tuple[pa.Array, pa.ListArray]:
    """Length of every list, and the places in ``names`` of its words that are there, repeats kept."""
    flat, lengths = lists.flatten(), lists.value_lengths().to_numpy()
    found = pc.index_in(flat, value_set=names.cast(flat.type))
    known = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))])
    ends = known[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), found.drop_null())


def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and how often the row has it, by row."""
    numbers = lists.flatten().to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    span = int(numbers.max()) + 1 if len(numbers) else 1
    pairs, times = np.unique(rows * span + numbers, return_counts=True)
    return pairs // span, pairs % span, times


@dataclass(frozen=True)
class TermWeights:
    """Queries, and for every term the numbers of those that ask it with what it weighs in them."""

    queries: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(queries: pa.ChunkedArray, term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> TermWeights:
        """``queries`` and ``term`` (a place in ``idf``) name the pairs; an asked pair counts ``times``."""
        coded = queries.combine_chunks().dictionary_encode(null_encoding="encode")
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(idf) + 1))
        return TermWeights(coded.dictionary, starts, coded.indices.to_numpy()[order].astype(np.int64), (times * idf[term])[order])

    def only(self, which: np.ndarray) -> TermWeights:
        """Without the pairs that ``which`` leaves out."""
        return TermWeights(self.queries, np.concatenate([[0], np.cumsum(which)])[self.starts], self.query[which], self.weight[which])

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every posting with each query that asks its term: posting, place in ``query`` and ``weight``."""
        n = self.starts[term + 1] - self.starts[term]
        before = np.cumsum(n) - n
        return np.repeat(np.arange(len(term)), n), np.arange(n.sum()) + np.repeat(self.starts[term] - before, n)

    def tables(self, row: np.ndarray, term: np.ndarray, gain: np.ndarray, rows: int, cells: int):
        """Scores of all ``rows`` by query as (first row, table); a table and its pairs stay near ``cells``.

        Postings come by row. A row that shares no term with a query has a zero.
        """
        width = max(1, len(self.queries))
        ends = np.searchsorted(row, np.arange(rows + 1))
        work = np.concatenate([[0], np.cumsum(self.starts[term + 1] - self.starts[term])])[ends]
        first = 0
        while first < rows:
            last = int(np.searchsorted(work, work[first] + cells, side="right")) - 1
            last = min(rows, max(first + 1, min(last, first + cells // width)))
            mine = slice(ends[first], ends[last])
            posting, place = self.pairs(term[mine])
            cell = (row[mine][posting] - first) * width + self.query[place]
            table = np.bincount(cell, weights=gain[mine][posting] * self.weight[place], minlength=(last - first) * width)
            yield first, table.astype(np.float64, copy=False).reshape(last - first, width)  # counts of nothing are whole numbers
            first = last


class BestPerQuery:
    """The ``k`` best rows of every query among the score tables added, by rounded score and then id."""

    def __init__(self, k: int):
        self.k, self.kept = k, None

    def add(self, table: np.ndarray, ids: pa.Array) -> None:
        scores = table.T
        if scores.shape[1] > self.k:
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
            keep = (scores > 0) & (scores >= floor - 2e-9)
        else:
            keep = scores > 0
        query, row = np.nonzero(keep)
        if len(query) == 0:
            return
        score = scores[query, row]
        found = pa.table({"query": query, "score": score, "rounded": np.round(score, 9), "id": ids.take(pa.array(row))})
        both = found if self.kept is None else pa.concat_tables([self.kept, found])
        both = both.take(pc.sort_indices(both, sort_keys=[("query", "ascending"), ("rounded", "descending"), ("id", "ascending")],
                                         null_placement="at_start"))
        query = both["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.kept = both.filter(pa.array(place < self.k)).combine_chunks()

    def rows(self, queries: pa.Array, query_id: str, item: str):
        """Batches of (query, item, score)."""
        if self.kept is not None:
            found = pa.table({query_id: queries.take(self.kept["query"].combine_chunks()), item: self.kept["id"], "score": self.kept["score"]})
            yield from found.to_batches()
