import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import licenses


def longest_common(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@settings(max_examples=100, deadline=None)
@given(a=st.lists(st.integers(1, 4), min_size=1, max_size=9), b=st.lists(st.integers(1, 4), min_size=1, max_size=9))
def test_wide_band_equals_full_alignment(a, b):
    matched, first, last = licenses.align(np.array(a), np.array(b), 0, 20)
    assert matched == longest_common(a, b)
    if matched:
        assert 0 <= first <= last < len(b) and b[first] in a and b[last] in a


def test_exact_notices_in_prose(docs_of):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice(["foo", "of", "the", "bar,", "and", "über"]) for _ in range(60))
    rows, want = [], set()
    for i, (name, notice) in enumerate(sorted(licenses.TEMPLATES.items())):
        text = f"{prose()}\n{notice.upper() if i % 3 == 0 else notice}\n{prose()}"
        rows.append((i, text))
        words = re.findall(r"[0-9A-Za-z]+", notice)
        start = text.lower().index(words[0].lower() + notice.lower().split(words[0].lower(), 1)[1])
        want.add((i, name, 1.0, start, start + len(notice.rstrip(".:,)")) if notice[-1] in ".:" else start + len(notice)))
    rows += [(100 + i, prose()) for i in range(5)]
    got = {(r["doc_id"], r["license"], r["coverage"], r["start"], r["end"]) for r in licenses.scan_licenses(docs_of(rows)).collect()}
    assert want <= got
    assert {g[0] for g in got} == set(range(len(licenses.TEMPLATES)))


def test_edits_repeats_and_thresholds(docs_of):
    notice = licenses.TEMPLATES["bsd-redistribution"]
    edited = notice.replace("source and binary", "original source and compiled binary").replace("permitted", "allowed")
    rows = [(1, f"a {edited} b"), (2, f"{notice} {'x ' * 50} {notice}"), (3, " ".join(notice.split()[:6])), (4, " ".join(reversed(notice.split())))]
    out = licenses.scan_licenses(docs_of(rows)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in out) == [(1, "bsd-redistribution"), (2, "bsd-redistribution"), (2, "bsd-redistribution")]
    assert 0.8 <= next(r["coverage"] for r in out if r["doc_id"] == 1) < 1


def test_odd_rows(docs_of, odd_rows):
    assert licenses.scan_licenses(docs_of(odd_rows)).count() == 0
    assert licenses.scan_licenses(docs_of([])).count() == 0
    long = "word " * 100_000 + "All rights reserved."
    out = licenses.scan_licenses(docs_of([(None, long), (None, long)])).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in out] == [(None, 500_000, 500_019)] * 2


def test_whole_texts_relatives_and_a_callers_table(spark, docs_of):
    whole = licenses.bodies()
    rows = [(i, f"foo bar {text} foo bar") for i, (_, text) in enumerate(sorted(whole.items()))]
    rows.append((50, " ".join(whole["mit-text"].split()[25:])))
    rows += [(100, "This work is licensed under the GNU Lesser General Public License, version 3"), (101, "Licensed under CC BY-SA 4.0"),
             (102, "This work is licensed under the GNU General Public License, version 3"), (103, "Licensed under the CC BY 4.0")]
    got = {}
    for r in licenses.scan_licenses(docs_of(rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert all(name in got[i] for i, name in enumerate(sorted(whole)))
    assert got[50] == {"mit-text"}
    assert [got[i] for i in range(100, 104)] == [{"lgpl-3.0-short"}, {"cc-by-sa-4.0-short"}, {"gpl-3.0-short"}, {"cc-by-4.0"}]
    table = spark.createDataFrame([("own", "use it as you like on Sundays"), ("own", "free for any use by anyone"), ("x", None)], "license string, text string")
    out = licenses.scan_licenses(docs_of([(1, "so use it as you like on sundays"), (2, "it is free for any use by anyone"), (3, "foo")]), table).collect()
    assert sorted((r["doc_id"], r["license"]) for r in out) == [(1, "own"), (2, "own")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 6), st.integers(0, 12), st.integers(0, 6)), max_size=25))
def test_outermost_places(rows):
    found = [(t, n, first, first + more) for t, n, first, more in rows]
    strength = lambda f: (f[1], -f[0])
    want = [f for f in found if not any(g[2] <= f[2] and f[3] <= g[3] and strength(g) > strength(f) for g in found)]
    assert licenses.outermost(found, strength) == want


def test_many_notices_in_one_text(docs_of):
    import time

    notice = licenses.TEMPLATES["mit"] if "mit" in licenses.TEMPLATES else next(iter(licenses.TEMPLATES.values()))
    began = time.time()
    found = [(i % 3, 5 + i % 2, 10 * i, 10 * i + 9) for i in range(40_000)]
    assert len(licenses.outermost(found, lambda f: (f[1], -f[0]))) == 40_000 and time.time() - began < 10
    got = licenses.scan_licenses(docs_of([(1, (notice + " and so on. ") * 300)])).collect()
    assert len(got) >= 300
