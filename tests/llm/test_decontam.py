import random

import numpy as np
from ledgerlens.llm import decontam

ITEM = "In the town hall Maria bought 12 kg of apples and 3 pears, then Maria gave 12 kg to the school near the old river."
OTHER = "In the town hall Bruno bought 40 lb of apples and 7 pears, then Bruno gave 40 lb to the school near the old river."
MIXED = "In the town hall Bruno bought 40 lb of apples and 7 pears, then Clara gave 55 oz to the school near the old river."


def bench(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "item_id long, text string, width int, slots string, doc_id long")


def prose(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed do tempor ut labore et magna aliqua".split()) for _ in range(n))


def test_parameters_and_consistency(spark, docs_of):
    rng = random.Random(1)
    rows = [(1, f"{prose(rng, 30)}. {ITEM} {prose(rng, 20)}"), (2, f"{prose(rng, 30)}. {OTHER}"), (3, MIXED), (4, prose(rng, 300)), (5, " ".join(ITEM.split()[:9]))]
    out = {r["doc_id"]: r for r in decontam.leaks(docs_of(rows), bench(spark, [(7, ITEM), (8, prose(random.Random(5), 40))])).collect()}
    assert set(out) == {1, 2}
    assert out[1]["item_id"] == 7 and out[1]["coverage"] == 1 and not out[1]["changed"]
    assert out[2]["changed"] and out[2]["coverage"] == 1


def brute(docs, items, width=decontam.WIDTH):
    """Items whose template windows a text holds, by plain comparison of windows without placeholders."""
    grams = lambda words: [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    out = set()
    for d, text in docs:
        own = set(grams(text.lower().split()))
        for i, item in items:
            want = grams(item.lower().split())
            if want and sum(g in own for g in want) >= decontam.COVERAGE * len(want):
                out.add((d, i))
    return out


def test_against_brute_force(spark, docs_of):
    rng = random.Random(8)
    word = lambda: f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.choice('aeiou')}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(10, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        body = [word() for _ in range(rng.randrange(5, 200))]
        if d % 3 == 0:
            words = items[rng.randrange(30)][1].split()
            share = rng.choice([1.0, 0.9, 0.3])
            at = rng.randrange(len(body))
            body[at:at] = words[:int(len(words) * share)]
        docs.append((d, " ".join(body)))
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(docs), bench(spark, items), run=1000).collect()}
    assert want and got == want


def test_odd_rows(spark, docs_of, odd_rows):
    items = bench(spark, [(1, None), (2, ""), (None, ITEM), (3, "too short"), (4, "12 13 14 15 16 17 18 19 20"), (5, ITEM), (6, ITEM)])
    rows = [*odd_rows, (20, ITEM), (20, ITEM), (None, ITEM), (21, "Anna " * 50_000)]
    out = decontam.leaks(docs_of(rows), items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in out) == [(0, 5), (0, 6), (20, 5), (20, 6)]
    docs = docs_of(rows)
    kept = decontam.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - 3  # a row without an id goes by its text too
    assert decontam.leaks(docs_of([]), items).count() == 0
    assert decontam.leaks(docs, bench(spark, [])).count() == 0


def found(spark, docs_of, texts, items, **more):
    """{(document, item): row} of texts and items numbered from 0."""
    out = decontam.leaks(docs_of(list(enumerate(texts))), bench(spark, list(enumerate(items))), **more).collect()
    assert all(0 < r["coverage"] <= 1 for r in out)
    return {(r["doc_id"], r["item_id"]): r for r in out}


def test_items_rich_in_values_and_short_items(spark, docs_of):
    items = ["Compute 12 + 7 - 3 * 9 / 4 + 6 and give result", "list Ada Lovelace 1815, Alan Turing 1912, Grace Hopper 1906, Edsger Dijkstra 1930", "name Three primes"]
    noise = prose(random.Random(3), 40)
    other = [items[0].replace("7", "8").replace("9", "5"), items[1].replace("1", "2"), "name Four primes"]
    got = found(spark, docs_of, [f"{noise} {i} {noise}" for i in items + other], items)
    assert set(got) == {(0, 0), (1, 1), (2, 2)} and all(r["coverage"] == 1 and not r["changed"] for r in got.values())


def test_copies_after_headings_and_in_one_case(spark, docs_of):
    items = ["What is the capital of France", "What do Anna Berg and Otto Lind pay for 3 kg of ripe red plums in Bonn"]
    texts = [f"{before}{change(item)} {prose(random.Random(4), 30)}"
             for item in items for before in ("Q: ", "a heading\n", "Done. ") for change in (str, str.lower, str.upper)]
    got = found(spark, docs_of, texts, items)
    assert set(got) == {(d, d // 9) for d in range(18)} and all(r["coverage"] == 1 and not r["changed"] for r in got.values())
    other = ["Q: What is the capital of Sweden", "Q: what do anna berg and otto lind pay for 5 kg of ripe red plums in bonn", "Q: Oslo is the capital of Norway"]
    got = found(spark, docs_of, other, items)
    assert set(got) == {(0, 0), (1, 1)} and all(r["changed"] for r in got.values())


def test_repeated_and_scattered_windows(spark, docs_of):
    rng = random.Random(6)
    item = " ".join(f"w{chr(97 + i)}x" for i in range(12))
    long = " ".join(f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(160))
    phrase, words = " ".join(item.split()[2:10]), long.split()
    spread = list(words)
    for i in range(0, 160, 9):
        spread[i] = "other"
    texts = [f"{prose(rng, 9)} {phrase} " * 6, f"{item} {prose(rng, 9)} {item}", " ".join(spread), " ".join(words[20:34])]
    got = found(spark, docs_of, texts, [item, long])
    assert {k: r["windows"] for k, r in got.items()} == {(1, 0): 5, (3, 1): 7}


def test_one_contradiction_loses_only_its_windows(spark, docs_of):
    rng = random.Random(9)
    body = [prose(rng, 30), "then 60 boats left", prose(rng, 30), "and 60 boats came", prose(rng, 30)]
    item = " ".join(body)
    texts = [" ".join([*body[:3], "and 90 boats came", body[4]]), " ".join([body[0], "then 70 boats left", body[2], "and 90 boats came", body[4]])]
    got = found(spark, docs_of, texts, [item])
    assert set(got) == {(0, 0), (1, 0)}
    n = got[0, 0]["item_windows"]
    assert got[0, 0]["windows"] == n - 8 and got[1, 0]["windows"] == n - 16


def test_rows_go_by_their_texts(spark, docs_of):
    items = bench(spark, [(1, ITEM), (2, "Paris"), (3, "name Three primes"), (4, "what is the capital of France")])
    rows = [(4, f"see {ITEM}"), (4, "a clean text"), (None, f"and {ITEM}"), (None, "999"), (5, "I saw Paris, name Three primes"), (6, "What is the capital of France?"), (7, None), (8, "")]
    kept = [(r["doc_id"], r["text"]) for r in decontam.without_leaks(docs_of(rows).withColumnRenamed("path", "digest"), items).collect()]
    assert sorted(kept, key=repr) == sorted([rows[1], *rows[3:5], *rows[6:]], key=repr)
    reported = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs_of(rows), items).collect()}
    assert {(5, 2), (5, 3), (4, 1), (None, 1), (6, 4)} == reported


def test_groups_and_single_texts_have_the_same_windows():
    rng = random.Random(11)
    words = ["Anna", "12", "kg", "went", "home", "Bonn", "and", "3.5", "saw", "red", "plums", "Otto", "km.", "end!", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))).encode() for _ in range(200)] + [b"", b"...", b"kg", b"a 7 b"]
    every, memo = np.full(1 << 24, 255, np.uint8), decontam.new_memo()
    widths = [1, 2, 3, 5, 8]
    whole = list(decontam.group_windows(texts, widths, every, memo))
    alone = [(i, *row[1:]) for i, text in enumerate(texts) for row in decontam.group_windows([text], widths, every, memo)]
    assert sorted(whole, key=repr) == sorted(alone, key=repr) and len(whole) > 5000
    for i, text in enumerate(texts):
        kinds = decontam.canonical(decontam.codes(text, memo))[1]
        for width in widths:
            places = sorted(r[4] for r in whole if r[0] == i and r[2] == width)
            literal = decontam.literals(kinds, width) if len(kinds) >= width else []
            # one window per template with literal words enough, one more where there are placeholders
            good = [p for p, n in enumerate(literal) if decontam.enough(n, width)] + [p for p, n in enumerate(literal) if n < width]
            assert places == sorted(good)
