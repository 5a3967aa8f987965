"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the parts
of toxic windows that a likelihood ratio singles out, since toxic documents are
mostly ordinary prose. The toxic one is laid before the ordinary one, so common
prose costs the same with and without it. A window's compression distance is what
the toxic dictionary saves. The windows beyond a calibrated threshold make the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import compression as C
from ledgerlens.llm.common import logistic
from ledgerlens.llm.quality import calibrated

WINDOW = 160
GRAM = 6
LEVEL = 6
ORDINARY_BYTES, TOXIC_BYTES = 1 << 15, 1 << 14
#: Samples of fewer bytes are of no use to the trainer, so shorter ones are repeated.
LEAST_SAMPLE = 16
NAMES = ["highest", "best_three", "mean", "beyond_two", "share", "count", "excess", "windows"]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: list[float]


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """The whole text in windows of at most ``size`` bytes, cut after spaces where there are any."""
    out, at = [], 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut + 1 if cut > at else end
        out.append(data[at:end])
        at = end
    return out


def _grams(data: bytes) -> np.ndarray:
    """GRAM-byte windows as whole numbers, in order."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | codes[i:i + n]
    return out


def _frequency(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams and the number of chunks that hold them."""
    parts = [np.unique(_grams(c)) for c in chunks]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, int))


def _surprise(n1: np.ndarray, total1: int, n0: np.ndarray, total0: int) -> np.ndarray:
    """Log-likelihood ratio of two shares being different against their being one."""
    def fit(k, n, p):
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    both = (n1 + n0) / (total1 + total0)
    return 2 * (fit(n1, total1, n1 / total1) + fit(n0, total0, n0 / total0) - fit(n1, total1, both) - fit(n0, total0, both))


def segments(toxic: list[bytes], ordinary: list[bytes], ratio: float = 8.0) -> list[bytes]:
    """What toxic chunks have and ordinary ones lack, rarest first.

    Grams at least ``ratio`` times as frequent in toxic chunks, and surely so (the
    bar grows with the number of chunks, so that chance grams stay out); runs of
    them are segments. One that holds a more frequent segment adds nothing.
    """
    grams, n1 = _frequency(toxic)
    others, n0 = _frequency(ordinary)
    if not len(grams) or not len(others):
        return []
    at = np.minimum(np.searchsorted(others, grams), len(others) - 1)
    seen = np.where(others[at] == grams, n0[at], 0)
    sure = _surprise(n1, len(toxic), seen, len(ordinary)) >= max(20.0, len(toxic) / 12)
    chosen = grams[(n1 >= 5) & sure & (n1 / len(toxic) > ratio * seen / len(ordinary))]
    found: Counter[bytes] = Counter()
    for chunk in toxic:
        hit = np.isin(_grams(chunk), chosen)
        if not hit.any():
            continue
        covered = np.zeros(len(chunk) + 2, bool)
        for i in range(GRAM):
            covered[1 + i:1 + i + len(hit)] |= hit
        edges = np.flatnonzero(np.diff(covered.astype(np.int8)))
        found.update(chunk[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    kept: list[bytes] = []
    for segment, times in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        if times > 1 and not any(k in segment for k in kept):
            kept.append(segment)
    return kept[::-1]


def toxic_parts(toxic: list[bytes], chosen: list[bytes]) -> list[bytes]:
    """Training samples: of every window with a chosen segment, its segments, the longest first where they overlap."""
    if not chosen:
        return []
    pattern = re.compile(b"|".join(re.escape(s) for s in sorted(chosen, key=lambda s: (-len(s), s))))
    found = (b"\n".join(pattern.findall(w)) + b"\n" for c in toxic for w in windows(c) if pattern.search(w))
    return [part * -(-LEAST_SAMPLE // len(part)) for part in found]


def _distances(ordinary: bytes, toxic: bytes):
    """Bytes that the toxic dictionary saves, window by window.

    It comes before the ordinary one, which so lies at the same distance from a
    window either way.
    """
    sizes: list = []

    def run(data: bytes) -> np.ndarray:
        if not sizes:
            sizes.extend([C.sizer(ordinary, True, LEVEL), C.sizer(toxic + b"\n" + ordinary if toxic else ordinary, True, LEVEL)])
        plain, saved = sizes
        return np.array([plain(w) - saved(w) for w in windows(data)] or [0], float)

    return run


def _compute(ordinary: bytes, toxic: bytes, threshold: int):
    distances = _distances(ordinary, toxic)

    def run(texts):
        out = []
        for text in texts:
            d = np.sort(distances((text or "").lower().encode()))[::-1]
            out.append((
                float(d[0]), float(d[:3].mean()), float(d.mean()), float(np.maximum(d - 2, 0).mean()), float((d >= threshold).mean()),
                math.log1p(float((d >= threshold).sum())), math.sqrt(float(np.maximum(d - 3, 0).mean())), math.log1p(len(d))))
        return out

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, chunk_chars: int = 1500, chunks: int = 3000, documents: int = 2000, calibration_rows: int = 10_000,
        ordinary_bytes: int = ORDINARY_BYTES, toxic_bytes: int = TOXIC_BYTES) -> Model:
    """Dictionaries from one half of the labelled training rows; threshold and weights from the other.

    The threshold is the distance that one in 200 ordinary windows reaches, 3
    bytes at least. Bounds: ``documents`` documents and ``chunks`` chunks of them per
    label, ``calibration_rows`` rows, ``ordinary_bytes`` and ``toxic_bytes`` of
    dictionary, which the trainer fills with what its samples repeat most.
    """
    rows = C.labelled(docs, labels, "toxic", train, documents, calibration_rows)
    found = C.chunk_sample(rows.where("half = 0"), chunk_chars, chunks)
    toxic, plain = ([x.lower().encode() for x in found[v]] for v in (1, 0))
    ordinary = C.trained([w for c in plain for w in windows(c)], ordinary_bytes)
    special = C.trained(toxic_parts(toxic, segments(toxic, plain)), toxic_bytes)
    other = C.chunk_sample(rows.where("half = 1 and label = 0"), chunk_chars, max(1, chunks // 6))[0]
    distances = _distances(ordinary, special)
    usual = [distances(x.lower().encode()) for x in other]
    high = float(np.quantile(np.concatenate(usual), 0.995)) if usual else 0.0
    threshold = max(3, math.floor(high) + 1)
    sample = rows.where("half = 1")
    marks = sample.select("doc_id", "label").distinct()
    data = C.doc_features(sample, _compute(ordinary, special, threshold), NAMES).join(marks, "doc_id").select("label", *NAMES).collect()
    return Model(ordinary, special, threshold, calibrated(data, len(NAMES)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for whole texts; a null text counts as empty, and every row has a score."""
    weights, compute = np.array(model.weights), _compute(model.ordinary, model.toxic, model.threshold)

    def scored(texts):
        found = compute(texts)
        return [(float(p),) for p in logistic(np.array(found), weights)] if found else []

    return C.doc_features(docs, scored, ["score"])


def classify(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    return score(docs, model).withColumn("predicted", (F.col("score") >= least).cast("int"))
