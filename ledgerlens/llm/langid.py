"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram is the product of
its letters' vectors, each rotated by its place; a text is the sum of its n-grams
and a language the sum of its texts. A text's language is the nearest profile by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import mix, text_slices

DIMENSIONS, ORDER = 512, 3
GROUP_CHARS = 1 << 18
VECTORS = 1 << 14
UNKNOWN = "und"


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """+1/-1 vectors of code points, from their value alone."""
    words = (dimensions + 63) // 64
    bits = mix(mix(letters.astype(np.uint64))[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) * 2 - 1)


def ngrams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as rows of code points, then (text, n-gram, count) by text; a run of non-letters is one space."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    kinds, place = np.unique(code, return_inverse=True)
    code = np.where(np.array([chr(k).isalpha() for k in kinds], bool)[place], code, 0) if len(code) else code
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    letters, place = np.unique(code, return_inverse=True)
    n = len(code) - order + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return np.empty((0, order), np.uint32), none, none, none
    key, base = np.zeros(n, np.int64), len(letters)
    for i in range(order):
        key = key * base + place[i:i + n]
    inside = owner[:n] == owner[order - 1:]
    grams, gram = np.unique(key[inside], return_inverse=True)
    both, counts = np.unique(owner[:n][inside] * max(1, len(grams)) + gram, return_counts=True)
    rows = np.stack([letters[grams // base ** (order - 1 - i) % base] for i in range(order)], axis=1)
    text, gram = np.divmod(both, max(1, len(grams)))
    return rows, text, gram, counts


def bundles(texts: list[str], dimensions: int = DIMENSIONS, order: int = ORDER) -> np.ndarray:
    """Sum of n-gram vectors per text; a text without letters, or shorter than an n-gram, has the zero vector."""
    out = np.zeros((len(texts), dimensions))
    grams, text, gram, counts = ngrams(texts, order)
    if not len(text):
        return out
    letters, place = np.unique(grams, return_inverse=True)
    place, basis = place.reshape(grams.shape), letter_vectors(letters, dimensions)
    turned = [np.roll(basis, order - 1 - i, axis=1) for i in range(order)]
    for low in range(0, len(grams), VECTORS):
        bound = turned[0][place[low:low + VECTORS, 0]]
        for i in range(1, order):
            bound = bound * turned[i][place[low:low + VECTORS, i]]
        bound = bound.astype(np.float32)
        here = (gram >= low) & (gram < low + VECTORS)
        owner, which, weight = text[here], gram[here] - low, counts[here].astype(np.float32)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out[owner[a]] += weight[a:b] @ bound[which[a:b]]
    return out


def _groups(texts: Iterable[str | None]):
    """(row numbers, texts) of about GROUP_CHARS; a longer text comes in parts, whose vectors add up."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(1, len(text)), GROUP_CHARS):
            # parts overlap by two letters, so that no n-gram is lost
            rows.append(i)
            parts.append(text[max(0, at - (ORDER - 1)):at + GROUP_CHARS])
            size += len(parts[-1])
            if size >= GROUP_CHARS:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if rows:
        yield np.array(rows), parts


def _vectors(texts: list[str | None], dimensions: int) -> np.ndarray:
    out = np.zeros((len(texts), dimensions))
    for rows, parts in _groups(texts):
        np.add.at(out, rows, bundles(parts, dimensions))
    return out


def learn(docs: DataFrame, train: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Profile per language from the rows where ``train`` holds; languages without letters are left out.

    Tasks add up whole texts; Spark adds the tasks' sums. The result has one vector per language.
    """
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in sorted(set(langs.to_pylist())):
                # only the language's sum is wanted, so its texts' n-grams are counted together
                own = batch.filter(pc.equal(langs, lang))
                mine = (t for part in text_slices(own) for t in part.column("text").to_pylist() if t)
                total = sums.setdefault(lang, np.zeros(dimensions))
                for _, parts in _groups(mine):
                    total += bundles(["\n".join(parts)], dimensions)[0]
        rows = [(lang, i, v) for lang, total in sums.items() for i, v in enumerate(total.tolist())]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], ["lang", "i", "v"])

    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string"), F.col("text").cast("string"))
    sums = rows.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():  # languages x dimensions
        found.setdefault(row["lang"], np.zeros(dimensions))[row["i"]] = row["v"]
    return {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) per document; score is the cosine, not below 0.

    ``und`` with score 0 for a null text, one without letters, or without
    profiles. Of equal cosines the first language by name wins. A text with a
    letter but without an n-gram is padded with spaces until it has one.
    """
    name = _namer(profiles)

    def run(batches):
        for part in (part for batch in batches for part in text_slices(batch)):
            names, scores = name(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def _namer(profiles: dict[str, np.ndarray]):
    """Function from texts to their languages and scores."""
    langs = list(profiles)
    table = np.array([profiles[k] for k in langs]) if langs else np.zeros((0, DIMENSIONS))
    dimensions = table.shape[1]

    def name(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        padded = [None if t is None else f" {t} " for t in texts]
        vectors = _vectors(padded, dimensions)
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ table.T / np.maximum(norms, 1e-300)[:, None]
        for text, cosine in zip(texts, cosines, strict=True):
            if not langs or not text or not any(map(str.isalpha, text)):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(np.argmax(cosine))
                names.append(langs[best])
                scores.append(float(min(1.0, max(0.0, cosine[best]))))
        return names, scores

    return name


def accept(docs: DataFrame, profiles: dict[str, np.ndarray], least: float = 0.1, letters: int = 50) -> DataFrame:
    """Documents in one of the languages, row by row; columns stay as they are.

    Texts without letters go, null texts too, and texts of ``letters`` letters or
    more whose best cosine stays under ``least``, about what chance gives. A shorter
    text may resemble nothing by chance alone and stays. A row is judged by its own
    text, whatever other rows share its doc_id.
    """
    name = _namer(profiles)

    def run(batches):
        for part in (part for batch in batches for part in text_slices(batch)):
            texts = part.column("text").cast(pa.string()).to_pylist()
            keep = [
                lang != UNKNOWN and (score >= least or sum(map(str.isalpha, text)) < letters)
                for text, lang, score in zip(texts, *name(texts), strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
