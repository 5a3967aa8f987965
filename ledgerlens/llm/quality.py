"""Quality classifier by compression.

One zstandard dictionary is built from good text and one from bad text. A text is
compressed with either and with none; the difference, divided by the plain
compressed size, and that size per byte become a calibrated score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import compression as C
from ledgerlens.llm.common import fit_logistic, logistic

DICTIONARY_BYTES = 1 << 16
NAMES = ["difference", "plain", "good", "bad", "length"]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]


def _compute(good: bytes, bad: bytes):
    sizes: list = []

    def run(texts):
        if not sizes:
            sizes.extend([C.sizer(b""), C.sizer(good), C.sizer(bad)])
        out = []
        for text in texts:
            data = (text or "").encode()
            plain, with_good, with_bad = (C.whole_size(s, data) for s in sizes)
            n = max(1, len(data))
            out.append(((with_good - with_bad) / plain, min(2.0, plain / n), min(2.0, with_good / n), min(2.0, with_bad / n), math.log1p(n)))
        return out

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, chunk_chars: int = 3000, chunks: int = 3000, documents: int = 2000, calibration_rows: int = 10_000) -> Model:
    """Dictionaries from one half of the labelled training rows, calibration on the other.

    Bounds: ``documents`` documents and ``chunks`` chunks of them per label, ``calibration_rows`` rows. Without a
    label of both kinds the score is the share of the kind there is, or 0.5.
    """
    rows = C.labelled(docs, labels, "quality", train, documents, calibration_rows)
    found = C.chunk_sample(rows.where("half = 0"), chunk_chars, chunks)
    good, bad = (C.trained([x.encode() for x in found[v]], DICTIONARY_BYTES) for v in (1, 0))
    sample = rows.where("half = 1")
    marks = sample.select("doc_id", "label").distinct()
    data = C.doc_features(sample, _compute(good, bad), NAMES).join(marks, "doc_id").select("label", *NAMES).collect()
    return Model(good, bad, calibrated(data, len(NAMES)))


def calibrated(data: list, width: int) -> list[float]:
    """Logistic weights of (label, features...) rows; without both labels only an intercept."""
    y = np.array([r[0] for r in data], float)
    if not len(y) or y.min() == y.max():
        return [0.0] * width + [0.0 if not len(y) else 20.0 * (2 * y[0] - 1)]
    x = np.array([list(r[1:]) for r in data], float)
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = fit_logistic((x - mean) / std, y)
    return [*(w[:-1] / std), float(w[-1] - np.sum(w[:-1] * mean / std))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for whole texts; a null text counts as empty, and every row has a score."""
    weights, compute = np.array(model.weights), _compute(model.good, model.bad)

    def scored(texts):
        found = compute(texts)
        return [(float(p),) for p in logistic(np.array(found), weights)] if found else []

    return C.doc_features(docs, scored, ["score"])


def classify(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    return score(docs, model).withColumn("predicted", (F.col("score") >= least).cast("int"))
