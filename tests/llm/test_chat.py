from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import chat

TEXT = st.none() | st.text(alphabet="ab<|'>\n ß", max_size=12) | st.sampled_from(["<|turn|>", "<|'end|>", "<|next|><|text|>", "</s>[INST] ok [/INST]", "😀<|"])
ROW = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 1, 2, None]), st.sampled_from(["user", "assistant", "<|text|>", None, "system"]), TEXT)


def read(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, t int")
    out = chat.format_conversations(df)
    return out.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("trained")).collect()


@settings(max_examples=25, deadline=None)
@given(rows=st.lists(ROW, max_size=12))
def test_round_trip(spark, rows):
    want = defaultdict(list)
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv, turn, role, text in sorted(rows, key=lambda r: (low(r[1]), r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in read(spark, rows)}
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == dict(want)
    for conv, r in got.items():
        turns = want[conv]
        assert r["trained"] == [t for role, t in turns if role == "assistant"]
        assert r["n_blocks"] == 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r["formatted"].count(chat.TURN) == r["n_blocks"] and r["formatted"].endswith(chat.END)


def test_merges_adjacent_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c<|end|>"), (1, 3, "assistant", "d")]
    out = read(spark, rows)[0]
    assert out["formatted"] == "<|turn|>user<|text|>a<|next|>b<|turn|>assistant<|text|>c<|'end|><|next|>d<|end|>"
    assert out["n_blocks"] == 2 and out["trained"] == ["c<|end|>", "d"]
