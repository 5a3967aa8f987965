import random
import re

import pytest

from ledgerlens.llm import common, neardup
from ledgerlens.llm.common import components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [sets_of(t, width) for _, t in rows]
    top = {k: k for k, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                top[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for (k, _), s in zip(rows, sets, strict=True)}


def family(rng, count, length, change):
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    return [" ".join(f"n{rng.randrange(10_000)}" if rng.random() < change() else w for w in base) for _ in range(count)]


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 2048), (5, 80, 2048), (3, 85, 8)])
def test_against_brute_force(docs_of, width, percent, block):
    rng = random.Random(width * block)
    texts = []
    # groups whose copies are partly linked, around the threshold
    for count, spread in ((60, 0.08), (12, 0.03), (5, 0.02)):
        texts += family(rng, count, 120, lambda s=spread: rng.random() * s)
    texts += [texts[0]] * 15 + [texts[3].upper(), texts[70].replace(" ", "\n")]
    texts += [" ".join(f"u{rng.randrange(900)}" for _ in range(80)) for _ in range(60)]
    texts += ["", None, "  ", "one", "one", "One two", "one  two", "two one"]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    expected = brute(rows, width, percent)
    out = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(rows), width, percent, block=block).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in out.items()} == expected
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())
    assert len({c for _, c in expected.values()}) < len(rows)


def test_odd_rows(docs_of, odd_rows):
    out = neardup.near_duplicates(docs_of(odd_rows)).collect()
    assert len(out) == len({k for k, _ in odd_rows})  # a repeated row is one document
    by = {r["doc_id"]: r for r in out}
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert [by[k]["n_shingles"] for k in (1, 2, 3, 7)] == [0, 0, 0, 1]
    assert all(by[k]["component_id"] == k for k in by if k is not None)
    assert neardup.near_duplicates(docs_of([])).count() == 0
    kept = neardup.keep_one(docs_of(odd_rows))
    # of the repeated row and the row without an id that has its text, one stays
    assert kept.columns == docs_of(odd_rows).columns and kept.count() == len(odd_rows) - 2
    assert neardup.keep_one(docs_of([])).count() == 0


def test_a_document_with_several_texts(docs_of):
    a, b = "one two three four five six seven eight", "red green blue black white grey pink brown"
    rows = [(3, b), (5, a), (5, b), (7, a), (8, "alone here with own words and no one"), (None, a), (None, "null has a text of its own here")]
    out = neardup.near_duplicates(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] is not None) == [
        (3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True)]
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)] * 2
    # rows are kept by their texts, so no text is lost
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one(docs_of(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([rows[0], rows[1], rows[4], rows[6]], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_kept_rows_by_text(docs_of, seed):
    rng = random.Random(seed)
    texts = [t for n in (30, 5, 2) for t in family(rng, n, 60, lambda: rng.random() * 0.06)] + ["", None, "one"]
    rows = [(rng.choice([None, *range(20)]), rng.choice(texts)) for _ in range(150)]
    kept = [(r["doc_id"], r["text"]) for r in neardup.keep_one(docs_of(rows)).collect()]
    groups = brute(list(enumerate(t for _, t in rows)), 5, 80)
    want = [rows[i] for i, (size, _) in groups.items() if not size]
    for top in {c for size, c in groups.values() if size}:
        mine = [rows[i] for i, (size, c) in groups.items() if c == top and size]
        held = [r for r in kept if r in mine]
        assert len(held) == 1 and (held[0][0] is None) == all(k is None for k, _ in mine)
        assert held[0][0] is None or held[0][0] == min(k for k, _ in mine if k is not None)
        want += held
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    names = list(range(1000))
    rng.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(699)] + [(names[i], names[i]) for i in range(800, 900)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"] for r in out} == set(names[:700]) and {r["label"] for r in out} == {min(names[:700])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frames_that_are_written(docs_of, monkeypatch):
    """The pipeline's F1: every file written starts processes; links were stored twice, first labels beside their parents."""
    frames, real = [], common.stored
    for module in (common, neardup):
        monkeypatch.setattr(module, "stored", lambda df, label: frames.append((label, out := real(df, label))) or out)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:i], "new", *base[i:]]) for i in range(0, 200, 10)] + ["no copy of any other text"]
    assert neardup.keep_one(docs_of(list(enumerate(texts)))).count() == 2
    assert sorted(label for label, _ in frames) == sorted([
        "signed", "classes", "bands", "buckets", "pairs", "sets", "edges", "parents", "edges", "groups", "links", "named", "marks"])

    # members found late join their group by its label; the group's own links are not gone through again
    rng = random.Random(3)
    texts = family(rng, 60, 120, lambda: rng.random() * 0.08)
    rows = list(enumerate(texts))
    frames.clear()
    out = neardup.near_duplicates(docs_of(rows), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 3, 85)
    at = [label for label, _ in frames].index("links")
    rows_of = [{(r["a"], r["b"]) for r in frame.collect()} for label, frame in frames[at:] if label in ("links", "edges")]
    assert rows_of[0] and rows_of[1] == rows_of[0]
