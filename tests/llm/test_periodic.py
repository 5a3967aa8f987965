import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from ledgerlens.llm import periodic, queries


def brute(words, least=24, exponent=3):
    """Runs straight from their definition, period by period; a stretch keeps its smallest period."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]) if doc_id is not None else (text or "").split()
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(collapsed(words, runs))))


def test_cover():
    assert {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER} == set(range(periodic.MODULUS))
    assert (periodic.SHIFTS < periodic.MODULUS).all()


@pytest.mark.parametrize("seed", range(4))
def test_extensions(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 40)
    words = np.append(np.concatenate([base] * 5 + [rng.integers(0, 2, 50)] + [base] * 3), 9)
    i, j = rng.integers(0, len(words) - 1, (2, 500))
    i, j = i[i != j], j[i != j]
    got = periodic.Extensions(words)(i, j)
    for a, b, n in zip(i, j, got, strict=True):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert k == n


def some_text(rng):
    kind, letters = rng.integers(0, 5), int(rng.integers(1, 5))
    words = list(rng.integers(0, letters, int(rng.integers(0, 150))))
    for _ in range(int(rng.integers(0, 4)) if kind else 0):
        unit = list(rng.integers(0, letters, int(rng.integers(1, 60))))
        times = int(rng.integers(2, 12))
        at = int(rng.integers(0, len(words) + 1))
        words[at:at] = unit * times + unit[:int(rng.integers(0, len(unit) + 1))]
    return np.array(words, np.int64)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    if seed % 2:
        monkeypatch.setattr(periodic, "LOT", 50)
    texts = [some_text(rng) for _ in range(60)]
    for text, got in zip(texts, periodic.runs_of(texts), strict=True):
        assert [tuple(r) for r in got.tolist()] == brute(text.tolist())
    for text, got in zip(texts, periodic.runs_of(texts, 6, 2), strict=True):
        assert [tuple(r) for r in got.tolist()] == brute(text.tolist(), 6, 2)


def test_long_periodic_text():
    text = np.tile(np.arange(7), 9000)
    assert periodic.runs_of([text])[0].tolist() == [[0, 63000, 7]]


def test_frames(spark, docs_of, odd_rows):
    rows = [*odd_rows, (11, "tick tock " * 20), (12, "go " * 23), (13, "go " * 24), (14, "end " + "a b c " * 9 + "a x"), (40, "w" + " w" * 400)]
    got = periodic.find_runs(docs_of(rows)).collect()
    assert len(got) == len(rows)
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got}
    assert runs[1] == runs[2] == runs[3] == runs[12] == [] and runs[8] == [(0, 60000, 1)] and runs[14] == [(1, 28, 3)]
    text = {r["doc_id"]: r["collapsed"] for r in got}
    assert text[1] == text[3] == "" and text[8] == "word" and text[11] == "tick tock" and text[14] == "end a b c x"
    assert periodic.find_runs(docs_of([])).collect() == []


def test_query_equals_brute_force(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, root).collect()]
    small = {r["doc_id"]: r["text"] for r in docs if len((r["text"] or "").split()) < 700}
    assert len(got) == len(docs) and len(small) > 150
    assert sorted(r for r in got if r[0] in small) == sorted(expected(k, t) for k, t in small.items())


def test_planting(spark, docs_of):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b")]
    got = {r["doc_id"]: r["text"] for r in periodic.with_planted_runs(docs_of(rows)).collect()}
    assert all(" ".join(planted(i, t.split())) == got[i] for i, t in rows if i is not None) and got[None] == "a b"
