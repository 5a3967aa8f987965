import random
import re
from collections import Counter

import numpy as np
import pytest
from ledgerlens.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    wanted = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    out = {}
    for p, a in wanted.items():
        lang, *words = p
        cuts = [(2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = [q for q in wanted if q[0] == lang and len(q) > len(p) and any(q[i:i + len(words)] == tuple(words) for i in range(1, len(q)))]
        if not any(100 * wanted[q] >= 80 * a for q in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def some_rows(seed):
    rng = random.Random(seed)
    words = ["the", "Of", "new", "york", "city", "é", "state", " x", "a\x1cb", "und"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "?!", " "]) for _ in range(rng.randint(0, 60)))
    return [(i, rng.choice([text(), "New York City of the state. ", None, ""]), rng.choice(["en", "en", "en", "de", None, "und"])) for i in range(400)]


@pytest.mark.parametrize("seed, support, shards", [(1, 30, 8), (2, 7, 3), (3, 30, 40), (4, 2, 1)])
def test_equals_brute_force(spark, docs_of, monkeypatch, seed, support, shards):
    rows = some_rows(seed)
    got = collocations.collocations(docs_of(rows).repartition(9), support, shards=shards)
    assert sorted(map(tuple, got.collect())) == brute(rows, support)
    assert sorted(map(tuple, collocations.collocations(docs_of(rows), support, top=3).collect())) == brute(rows, support, 3)


def test_small_chunks_count_alike(spark, docs_of):
    rows = some_rows(5)
    import numpy as np

    whole, parts = collocations.Chunk("en"), [collocations.Chunk("en") for _ in range(4)]
    texts = [(t or "").encode() for _, t, _ in rows]
    whole.add(texts)
    for i, part in enumerate(parts):
        part.add(texts[i::4])

    def table(chunk, level, wanted):
        words, out = list(chunk.words), Counter()
        for columns, counts in chunk.counts(level, wanted):
            for *at, n in zip(*columns, counts, strict=True):
                out[tuple(words[i] for i in at)] += int(n)
        return out

    every = np.full(1 << 24, 255, np.uint8)
    for level in (1, 2, 3, 0):
        assert sum((table(p, level, every) for p in parts), Counter()) == table(whole, level, every)
    both = table(whole, 2, every) + table(whole, 3, every)
    assert both == table(whole, 0, every) and max(map(len, both)) == 4


def test_odd_documents(spark, docs_of, odd_rows):
    got = collocations.collocations(docs_of(odd_rows)).collect()
    assert [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["score"]) for r in got] == [
        ("und", "word word word word", 59997, 60000, 59998, 2_000_000 * 59997 // (60000 + 59998))]
    assert collocations.collocations(docs_of([])).collect() == []


def test_mined_hashes_travel_in_blocks(spark, docs_of):
    rows = some_rows(6)
    docs = docs_of(rows).repartition(3)
    every = spark.sparkContext.broadcast(np.full(1 << 24, 255, np.uint8))
    blocks = collocations.hash_blocks(docs, 2, every, 2, 4).collect()
    assert 0 < len(blocks) <= 3 * 3 * 4  # tasks, languages, parts of the hashes
    counts = Counter()
    for b in blocks:
        hashes, n = np.frombuffer(b["hashes"], np.int64), np.frombuffer(b["counts"], np.int32)
        assert set((hashes.view(np.uint64) >> np.uint64(62)).tolist()) == {b["part"]}
        for h, k in zip(hashes.tolist(), n.tolist()):
            counts[b["shard"], h] += k
    bars = spark.createDataFrame([(s, collocations.lang_key(x), 5) for s in (0, 1) for x in ("en", "de", "und")], "shard int, lang_key long, least int")
    got = [r["hash"] for r in collocations.mine(docs, 2, every, bars, 2, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {h for (_, h), k in counts.items() if k >= 5}
