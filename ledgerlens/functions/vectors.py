"""Numpy helpers used inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd


def unit_rows(column: pd.Series) -> np.ndarray:
    """Rows as double vectors of length one; zero vectors stay zero."""
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def best_pairs(scores: np.ndarray, ids: np.ndarray, k: int, above: float | None = None) -> pd.DataFrame:
    """Row number ``q``, ``id`` and ``score`` of the ``k`` best columns of every row.

    Ties go to the lowest id. ``above`` drops scores that are not strictly greater.
    """
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
        keep = scores >= floor
    else:
        keep = np.ones(scores.shape, dtype=bool)
    if above is not None:
        keep &= scores > above
    rows, cols = np.nonzero(keep)
    return trim_pairs(pd.DataFrame({"q": rows, "id": ids[cols], "score": scores[rows, cols]}), k)


def trim_pairs(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best pairs of each ``q``."""
    ordered = pairs.sort_values(["q", "score", "id"], ascending=[True, False, True])
    return ordered[ordered.groupby("q").cumcount() < k]
