import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import packing, queries

PATH = packing.tokenizer_path()


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(text):
    return np.frombuffer(packing.encode_text(text.encode(), packing.new_memo(PATH)), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="aZé'ß.,!5 \n\tİΣ́<|endoftext|>", max_size=40))
def test_words_encode_like_the_whole_text(whole, text):
    assert ids_of(text) == [*whole.encode(text, add_special_tokens=False).ids, 0]


def counted(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def fewest(lengths, capacity):
    """Exact optimum by trying every place for every document."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(lengths=st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_search_keeps_documents_and_is_near_the_optimum(lengths):
    first = packing.fill_bins(counted(lengths, 20), 20)
    after = packing.improve_bins(first, 20)
    assert Counter(n for items, k in after for n in items for _ in range(k)) == Counter(lengths)
    assert all(sum(items) <= 20 for items, _ in after)
    bins = lambda c: sum(k for _, k in c)
    squares = lambda c: sum(k * sum(i) ** 2 for i, k in c)
    assert fewest(sorted(lengths, reverse=True), 20) <= bins(after) <= bins(first)
    assert squares(after) >= squares(first)


def test_search_empties_bins():
    poor = [([6, 2], 3), ([5, 3], 3), ([2], 3), ([3], 3), ([4], 2)]
    after = packing.improve_bins(poor, 10)
    assert sum(k for _, k in after) < sum(k for _, k in poor)
    assert sum(k * sum(i) ** 2 for i, k in after) > sum(k * sum(i) ** 2 for i, k in poor)


def check_layout(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        ends = list(itertools.accumulate(n for _, n in parts))
        assert [o for o, _ in parts] == [0, *ends[:-1]] and ends[-1] <= capacity
    return len(by)


def test_odd_rows(spark, docs_of, odd_rows, whole):
    out = packing.pack(docs_of(odd_rows)).collect()
    check_layout(out)
    expected = Counter()
    for key, text in odd_rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            expected[(key, n, at, np.array(ids[at:at + 2048], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in out) == expected
    joined = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs_of(odd_rows))).collect()}
    assert sum(r["length"] for r in joined.values()) == sum(r["length"] for r in out)
    assert all(len(r["ids"]) == 4 * r["length"] for r in joined.values())
    assert packing.pack(docs_of([])).count() == 0


def test_query_packs_all_documents_tightly(spark, tables, whole):
    root = "/root/testdata/sf0.001"
    out = queries.op1_best_fit_packing(spark, root).collect()
    bins = check_layout(out)
    expected = set()
    for doc in spark.read.parquet(f"{root}/documents.parquet").collect():
        ids = [*whole.encode(doc["text"] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            expected.add((doc["doc_id"], n, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == expected
    assert bins <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_a_word_of_many_texts_is_looked_up_once():
    memo, asked = packing.new_memo(PATH), []
    looked_up = memo.parts.values_of
    memo.parts.values_of = lambda words: asked.extend(words) or looked_up(words)
    texts = [b"One two, one two!"] * 50 + [b"", b" \x0b", b"\x1cx <|endoftext|>"]
    got = packing.encode_texts(texts, memo)
    assert got == [packing.encode_text(x, packing.new_memo(PATH)) for x in texts] and got[50:52] == [bytes(4)] * 2
    assert len(asked) <= 10
