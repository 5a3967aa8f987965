"""Best-fit packing of token sequences, improved by swap-based local search.

Lengths are whole numbers up to the capacity, so what a packing needs to know of
the corpus is one count per length. Bins with the same content form a class with
a multiplicity; the search works on classes, and its size depends on the capacity
only. Pieces then take the places of their length by rank, in parallel.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlens.llm.common import GROUP_BYTES, Memo, byte_groups, stored, word_parts

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters, then ASCII marks (no apostrophe): the tokenizer splits it just there.
PLAIN = "\\A(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(?P<marks>[!-&(-/:-@\\[-`{-~]*)\\z"


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary shows for each byte: printable ones as they are, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of words, as little-endian unsigned 32-bit bytes.

    The tokenizer never joins text across white space, so words are encoded
    apart. Plain words go straight to its vocabulary, letters and marks each by
    themselves; all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        whole, shown = _tokenizer(path), _byte_letters()
        tokenize = whole.model.tokenize

        def packed(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def run(part: str) -> bytes:
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(shown)
            return packed([t.id for t in tokenize(part)]) if part else b""

        self.parts = Memo(run)
        self.others = Memo(lambda word: packed(whole.encode(word, add_special_tokens=False).ids))

    def of(self, words: pa.Array) -> pa.Array:
        found = pc.extract_regex(words, PLAIN)
        plain = pc.and_(found.is_valid(), pc.invert(pc.match_substring(words, "<|")))
        letters, marks = (pc.if_else(plain, pc.struct_field(found, name), "") for name in ("letters", "marks"))
        ids = pc.binary_join_element_wise(self._known(pc.utf8_lower(letters)), self._known(marks), b"")
        rest = pc.invert(plain)
        others = self.others.values_of(words.filter(rest).to_pylist())
        return pc.replace_with_mask(ids, rest, pa.array(others, pa.binary()))

    def _known(self, parts: pa.Array) -> pa.Array:
        coded = parts.dictionary_encode()
        return pa.array(self.parts.values_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary()).take(coded.indices)


def new_memo(path: str) -> WordIds:
    return WordIds(path)


def _encode_parts(parts: list[bytes], memo: WordIds) -> list[bytes]:
    """Ids of each text; a word that several of them hold is looked up once."""
    lists = pc.ascii_split_whitespace(pa.array(parts, pa.string()))
    words = lists.flatten().dictionary_encode()
    if not len(words):
        return [b""] * len(parts)
    _, offsets, ids = memo.of(words.dictionary).take(words.indices).buffers()
    ends = np.frombuffer(offsets, np.int32)[lists.offsets.to_numpy()]
    data = ids.to_pybytes() if ids else b""
    return [data[low:high] for low, high in zip(ends[:-1], ends[1:], strict=True)]


def encode_texts(texts: list[bytes], memo: WordIds) -> list[bytes]:
    """Ids of each text and a closing id 0, four bytes each."""
    short = [x if len(x) <= GROUP_BYTES else b"" for x in texts]
    out = [ids + bytes(4) for ids in _encode_parts(short, memo)]
    for i, data in enumerate(texts):
        if len(data) > GROUP_BYTES:
            out[i] = b"".join(_encode_parts([part], memo)[0] for part in word_parts(data)) + bytes(4)
    return out


def encode_text(data: bytes, memo: WordIds) -> bytes:
    return encode_texts([data], memo)[0]


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token ids of whole texts, cut into pieces of ``capacity`` ids.

    ``ids`` holds little-endian unsigned 32-bit values. A null or empty text is
    one piece with the closing id; a null doc_id is kept; repeated rows each give
    their pieces; other columns are ignored.
    """
    path = path or tokenizer_path()

    def run(batches):
        memo = new_memo(path)
        for batch in batches:
            keys, at = batch.column("doc_id").to_pylist(), 0
            for group in byte_groups(batch.column("text")):
                out = ([], [], [], [], [])
                for ids in encode_texts(group, memo):
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + capacity)]
                        for column, value in zip(out, (keys[at], n, start, len(part) // 4, part), strict=True):
                            column.append(value)
                    at += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fill_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bin classes (lengths, multiplicity): each bin takes the best-fitting length until none fits."""
    left, classes = counts.astype(np.int64).copy(), []
    while left.any():
        room, taken = capacity, {}
        while room:
            fits = np.flatnonzero(left[:room + 1])
            fits = fits[[f not in taken for f in fits]] if len(fits) else fits
            if not len(fits):
                break
            best = int(fits[-1])
            taken[best] = int(min(room // best, left[best]))
            room -= best * taken[best]
        times = int(min(left[n] // k for n, k in taken.items()))
        for n, k in taken.items():
            left[n] -= k * times
        classes.append(([n for n, k in taken.items() for _ in range(k)], times))
    return classes


def improve_bins(classes: list[tuple[list[int], int]], capacity: int, steps: int = 20_000) -> list[tuple[list[int], int]]:
    """Local search between underfull bins; squared fill grows with every step.

    From the emptiest class on, a document moves to another bin, or one or two are
    exchanged for one there, choosing the fullest result that fits and that beats
    the giving bin's fill. The step is made in as many pairs of bins as both
    classes have. Bins that become empty are gone.
    """
    bins: dict[tuple[int, ...], int] = {}

    def put(items, times):
        key = tuple(sorted(items))
        if key and times:
            bins[key] = bins.get(key, 0) + times

    for items, times in classes:
        put(items, times)
    done: set[tuple[int, ...]] = set()
    for _ in range(steps):
        open_ = sorted((k for k in bins if sum(k) < capacity), key=sum)
        if not open_:
            break
        owner = np.repeat(np.arange(len(open_)), [len(set(k)) + 1 for k in open_])
        give = np.concatenate([[0, *sorted(set(k))] for k in open_])  # 0: nothing comes back, a plain move
        fill = np.array([sum(k) for k in open_])[owner]
        found = None
        for i, source in enumerate(open_):
            if source in done:
                continue
            own = sum(source)
            alone = bins[source] < 2
            parts = sorted(set(source))
            offers = [(a,) for a in parts] + [
                (a, b) for x, a in enumerate(parts) for b in parts[x:] if a != b or source.count(a) > 1]
            best = None
            for offer in offers:
                total = sum(offer)
                gain = total - give
                after = fill + gain
                ok = (gain > 0) & (after <= capacity) & (after > own) & ((len(offer) == 1) | (give > 0))
                if alone:
                    ok &= owner != i
                if ok.any():
                    j = int(np.argmax(np.where(ok, after, -1)))
                    if best is None or after[j] > best[0]:
                        best = (int(after[j]), offer, int(owner[j]), int(give[j]))
                        if best[0] == capacity:
                            break
            if best:
                found = (i, *best[1:])
                break
            done.add(source)
        if not found:
            break
        i, offer, j, back = found
        source, target = open_[i], open_[j]
        times = bins[source] // 2 if i == j else min(bins[source], bins[target])
        for key in (source, target):
            bins[key] -= times
            if not bins[key]:
                del bins[key]
        low, high = list(source), list(target)
        for a in offer:
            low.remove(a)
        if back:
            high.remove(back)
            low.append(back)
        put(low, times)
        put(high + list(offer), times)
        done.clear()
    return [(list(k), n) for k, n in sorted(bins.items(), key=lambda x: (-sum(x[0]), x[0]))]


def places(classes: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, copies per bin, first bin, offset), sorted by length and rank.

    A class of b bins with k documents of a length takes the next b * k ranks of it.
    At most 63 different lengths fit in 2,048, so there are at most 63 rows a class.
    """
    used: dict[int, int] = {}
    rows, first = [], 0
    for items, times in classes:
        offset = 0
        for n in sorted(set(items), reverse=True):
            k = items.count(n)
            rows.append((n, used.get(n, 0), k, first, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        first += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "copies", "bin", "offset"), table.T, strict=True))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` has to be stored, since it is read twice. Rows need no key: equal
    lengths are interchangeable. No rows give no rows.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[n] = k
    full = [([capacity], int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    table = spark.sparkContext.broadcast(places(full + improve_bins(fill_bins(counts, capacity), capacity)))

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*(others or ["length"])), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy(*(others or ["length"]))
    ranked = salted.join(bases, ["length", "_salt"]).withColumn(
        "_rank", F.col("_base") + F.row_number().over(within) - 1)

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, n, r = table.value, length.to_numpy(), rank.to_numpy()
        shift = 1 << 45
        i = np.searchsorted(t["length"] * shift + t["rank"], n * shift + r, side="right") - 1
        turn, copy = np.divmod(r - t["rank"][i], t["copies"][i])
        return pd.DataFrame({"sequence_id": t["bin"][i] + turn, "offset": t["offset"][i] + copy * n})

    return ranked.withColumn("_seat", seat("length", "_rank")).select(*pieces.columns, "_seat.*")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ids, sequence_id and offset for all documents; see ``encode_pieces`` for odd rows."""
    return place(stored(encode_pieces(docs, path, capacity), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its length, documents in order and joined ids; at most ``capacity`` ids meet in a group."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), rows.alias("rows")).select(
        "sequence_id", "length", F.col("rows.doc_id").alias("doc_ids"),
        F.concat_ws("", F.transform("rows", lambda r: F.hex(r["ids"]))).alias("hex")).select(
        "sequence_id", "length", "doc_ids", F.unhex("hex").alias("ids"))
