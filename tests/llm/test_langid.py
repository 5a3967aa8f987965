import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.llm import common, langid, queries

ENGLISH = ["the weather is nice and the birds are singing", "this is a thing that they should think about", "with the other one"]
GERMAN = ["das wetter ist schön und die vögel singen", "ich weiß nicht, ob das noch nötig ist", "über die straße zu gehen"]


def brute(text, dimensions):
    """Bundle of bound, rotated letter vectors, one n-gram at a time."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    kept = [c for i, c in enumerate(letters) if c != " " or i == 0 or letters[i - 1] != " "]
    total = np.zeros(dimensions)
    for at in range(len(kept) - 2):
        bound = np.ones(dimensions)
        for i, c in enumerate(kept[at:at + 3]):
            vector = langid.letter_vectors(np.array([0 if c == " " else ord(c)], np.uint32), dimensions)[0]
            bound = bound * np.roll(vector, 2 - i)
        total += bound
    return total


def test_bundles_equal_the_definition():
    texts = ["Hello, WORLD! Füße", "", "a", "aaa bbb", "12 34"]
    assert np.array_equal(langid.bundles(texts, 128), np.stack([brute(t, 128) for t in texts]))


def test_long_text_in_parts(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 40
    one = langid._vectors([text], 64)
    monkeypatch.setattr(langid, "GROUP_CHARS", 101)
    assert np.array_equal(langid._vectors([text], 64)[0] != 0, one[0] != 0)
    assert np.corrcoef(langid._vectors([text], 64)[0], one[0])[0, 1] > 0.99


def test_odd_rows(docs_of, odd_rows):
    train = docs_of([(i, t, "en") for i, t in enumerate(ENGLISH)] + [(9 + i, t, "de") for i, t in enumerate(GERMAN)] + [(50, None, "fr"), (51, "xyz", None)])
    profiles = langid.learn(train, F.lit(True))
    assert sorted(profiles) == ["de", "en"]
    out = langid.predict(docs_of(odd_rows), profiles).collect()
    assert len(out) == len(odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    got = {(r["doc_id"], r["lang_pred"]) for r in out}
    assert {(1, "und"), (2, "und"), (3, "und"), (6, "und")} <= got and (7, "und") not in got and (5, "en") in got
    assert langid.predict(docs_of([]), profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs_of(odd_rows), {}).collect()} == {"und"}
    kept = langid.accept(docs_of([*odd_rows, (30, "漢字仮名交文章例" * 20), (31, "漢字")]), profiles)
    assert kept.columns == docs_of(odd_rows).columns
    assert {r["doc_id"] for r in kept.collect()} >= {None, 5, 7, 10, 31}
    assert not {1, 2, 3, 6, 30} & {r["doc_id"] for r in kept.collect()}


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    out = queries.op2_language_id(spark, root).join(spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out and lang is not null and lang_pred <> 'und'")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 0


def test_rows_are_judged_by_their_own_texts(docs_of):
    train = docs_of([(i, t, "en") for i, t in enumerate(ENGLISH)])
    rows = [(1, "good prose about the weather and the birds"), (1, "12 34"), (None, "!?"), (None, "the other one"), (2, None)]
    kept = langid.accept(docs_of(rows), langid.learn(train, F.lit(True)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([rows[0], rows[3]], key=repr)


def test_a_worker_holds_few_texts_at_a_time(monkeypatch):
    """The pipeline's F1: a batch of 10,000 texts became Python strings, two times over, all at once."""
    held, texts = [], [f"the cat number {i} " * 20 for i in range(9_000)] + [None, "", "x" * (3 << 20), "12"] + ["a"] * 5_000

    def namer(profiles):
        def name(some):
            held.append((len(some), sum(len(t or "") for t in some), max(len(t or "") for t in some)))
            return [langid.UNKNOWN if not t or not t[0].isalpha() else "en" for t in some], [1.0] * len(some)
        return name

    class Docs:
        schema = "text string"

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(langid, "_namer", namer)
    out = langid.accept(Docs(), {})(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})]))
    assert [t for batch in out for t in batch.column("text").to_pylist()] == [t for t in texts if t and t != "12"]
    assert sum(n for n, *_ in held) == len(texts)
    assert all(n <= common.TEXT_ROWS and (size <= common.GROUP_BYTES or n == 1) for n, size, _ in held)


def test_profiles_are_of_whole_languages(spark):
    """Slices change nothing: parts of one language are counted together, as far as a batch goes."""
    rows = [(i, (ENGLISH if i % 2 else GERMAN)[i % 3] * 40, "en" if i % 2 else "de") for i in range(1_200)]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), F.lit(True))
    for lang, vector in profiles.items():
        total = np.zeros(langid.DIMENSIONS)
        for _, parts in langid._groups([t for _, t, x in rows if x == lang]):
            total += langid.bundles(["\n".join(parts)])[0]
        assert np.array_equal(vector, total / np.linalg.norm(total))
