"""Benchmark decontamination on canonical templates.

Numbers, names and units become typed placeholders, so that a question with other
values has the same template. Windows of canonical words are joined by hash; on
each alignment the values in the placeholders have to map one to one. Windows
of the words as they are find copies that are mostly numbers and names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Memo, bit_filter, byte_groups, free_name, in_filter, stored, word_lists

WIDTH = 8
#: A leak covers this share of an item's windows, or a run of so many words.
COVERAGE, RUN = 0.5, 13
#: Items with fewer words are looked for with their own values only.
LEAST_WORDS = 5
BROADCAST_ROWS = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)

#: Unit words and signs; a unit counts as one only after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs "
    "pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes "
    "h hr hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur "
    "k c f celsius fahrenheit kmh mph hz khz mhz ghz kb mb gb tb w kw v a j kj cal kcal degree degrees".split())

PART = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?]")
PLAIN, NUMBER, TITLE, UNIT, STOP = range(5)
WORD_BITS, STOP_CODE = (1 << 63) - 16, 4
MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^`{|}~"


def parts_of(text: str) -> list[tuple[int, str]]:
    """(kind, text) of the numbers, words and sentence ends of a text; a word's kind is worked out apart from its place."""
    out = []
    for part in PART.findall(text):
        if part[0].isdecimal():
            out.append((NUMBER, part))
        elif part in ".!?":
            out.append((STOP, part))
        elif len(part) > 1 and part[0].isupper() and part[1:].islower():
            out.append((TITLE, part))
        else:
            out.append((UNIT if part.lower() in UNITS else PLAIN, part))
    return out


def code_of(kind: int, part: str) -> int:
    """Word hash in the upper bits, kind in the lower 3; bit 3 marks a unit word."""
    if kind == STOP:
        return STOP_CODE
    low = part.lower()
    return (xxhash.xxh3_64_intdigest(low) & WORD_BITS) | kind | (8 if low in UNITS else 0)


def word_codes(word: bytes) -> tuple[int, ...]:
    """Codes of the parts of a word between white space; the same as by :func:`parts_of`, faster for a plain word."""
    text = word.decode()
    core = text.rstrip(MARKS)
    if not core.isalpha():
        return tuple(code_of(k, p) for k, p in parts_of(text))
    ends = len(text) - len(core) and sum(map(text[len(core):].count, ".!?"))
    kind = PLAIN if core.islower() or len(core) < 2 or not (core[0].isupper() and core[1:].islower()) else TITLE
    low = core if core.islower() else core.lower()
    if low in UNITS:
        return (code_of(UNIT if kind == PLAIN else kind, core),) + (STOP_CODE,) * ends
    return ((xxhash.xxh3_64_intdigest(low) & WORD_BITS) | kind,) + (STOP_CODE,) * ends


def codes(data: bytes, memo: Memo) -> np.ndarray:
    lists = [np.fromiter(chain.from_iterable(memo.values_of(w)), np.int64) for w in word_lists(data)]
    return np.concatenate(lists)


def new_memo() -> Memo:
    return Memo(word_codes)


def canonical(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template code, kind, part number) of every word but sentence ends.

    A number stays one; a unit word after a number is a unit; a capitalised word
    that does not begin a sentence is a name; any other word stands for itself.
    """
    kind = code & 7
    words = np.flatnonzero(kind != STOP)
    after_stop = np.ones(len(words), bool)
    after_stop[1:] = np.diff(words) > 1
    code, kind = code[words], kind[words]
    kind = np.where((kind == TITLE) & after_stop, PLAIN, kind)
    after_number = np.zeros(len(words), bool)
    after_number[1:] = (kind[:-1] == NUMBER) & ~after_stop[1:]
    kind = np.where(((code & 8) > 0) & (kind != NUMBER), np.where(after_number, UNIT, PLAIN), kind)
    return np.where(kind == PLAIN, code & ~7, kind), kind, words


def _width_code(width: int) -> np.uint64:
    return np.uint64(width * 0xD1B54A32D192ED03 & (1 << 64) - 1)


def window_hashes(values: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Hash of every window of word codes, for all widths in one pass."""
    run, words, out = np.zeros(len(values), np.uint64), values.view(np.uint64), {}
    for i in range(min(max(widths, default=0), len(values))):
        run = run[:len(values) - i] * STEP + words[i:]
        if i + 1 in widths:
            out[i + 1] = run + _width_code(i + 1)
    return out


def hashes_at(values: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """The same hashes, of the windows at some places only."""
    run, words = np.zeros(len(places), np.uint64), values.view(np.uint64)
    for i in range(width):
        run = run * STEP + words[places + i]
    return run + _width_code(width)


def literals(kind: np.ndarray, width: int) -> np.ndarray:
    """Words of every window that are no placeholders."""
    total = np.concatenate([[0], np.cumsum(kind == PLAIN)])
    return total[width:] - total[:-width]


def enough(literal: np.ndarray, width: int) -> np.ndarray:
    """Whether a window can stand for other values: half of its words, three or more, are literal; a short item's all."""
    return literal >= (max(3, (width + 1) // 2) if width >= LEAST_WORDS else width)


def _rows(text: str, code: np.ndarray, template, kind, words, places: np.ndarray, width: int) -> list[list[str]]:
    """Values in the placeholders of the given windows, as place in the window, type and value."""
    if not (kind != PLAIN).any():
        return [[] for _ in places]
    values = [p.lower() for _, p in parts_of(text)]
    names = "-NTU"
    return [[f"{i - p}:{names[kind[i]]}{values[words[i]]}" for i in range(p, p + width) if kind[i] != PLAIN] for p in places]


def _windows(kind: str) -> str:
    return f"doc_id {kind}, n_windows long, width int, hash long, place long, slots array<string>, fixed boolean"


def _window_batch(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Arrow rows of (row of ``keys``, n_windows, width, hash, place, slots, fixed)."""
    at, *out = zip(*rows, strict=True) if rows else [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_())
    names = ["doc_id", "n_windows", "width", "hash", "place", "slots", "fixed"]
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(at, pa.int64())), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names)


def item_windows(table: DataFrame, key: str) -> DataFrame:
    """Windows of benchmark items: of WIDTH words or, if an item is shorter, of its own length.

    A window has its template, if that has literal words enough, and, if it holds
    placeholders, the lower-case words themselves, without slots. There are two more
    readings: names as plain words, for texts in one case, and the first word as a
    name, for copies that a heading precedes; then it is ``fixed``, which asks for
    the same value.
    """
    def windows(at: int, data: bytes, memo: Memo):
        code = codes(data, memo)
        template, kind, words = canonical(code)
        if not len(template):
            return
        width, plain = min(WIDTH, len(template)), code[words] & ~7
        forms = [(template, kind, False), (plain, np.full(len(kind), PLAIN), False),
                 (np.where(kind == TITLE, plain, template), np.where(kind == TITLE, PLAIN, kind), False)]
        if kind[0] == PLAIN:
            forms.append((np.append(TITLE, template[1:]), np.append(TITLE, kind[1:]), True))
        for nth, (values, kinds, fixed) in enumerate(forms):
            good = literals(kind, width) < width if nth == 1 else enough(literals(kinds, width), width)
            hashes, places = window_hashes(values, [width])[width], np.flatnonzero(good[:1] if fixed else good)
            slots = _rows(data.decode(), code, values, kinds, words, places, width)
            for place, value, row in zip(places.tolist(), hashes[places].view(np.int64).tolist(), slots, strict=True):
                yield at, len(hashes), width, value, place, row, fixed

    def run(batches):
        memo = new_memo()
        for batch in batches:
            at = 0
            for group in byte_groups(batch.column("text")):
                yield _window_batch(batch.column("doc_id"), [r for n, data in enumerate(group) for r in windows(at + n, data, memo)])
                at += len(group)

    return table.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _windows("long"))


def group_windows(group: list[bytes], widths: list[int], bits: np.ndarray, memo: Memo):
    """Rows for :func:`_window_batch` of the texts of a group, laid end to end, so that short ones cost little."""
    parts = [codes(data, memo) for data in group]
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    code = np.concatenate([x for p in parts for x in (p, [STOP_CODE])]).astype(np.int64)
    template, kind, words = canonical(code)
    first = np.searchsorted(words, begin)  # of each text, among the words
    placeholders = np.concatenate([[0], np.cumsum(kind != PLAIN)])
    plain = code[words] & ~7
    every = window_hashes(template, widths)
    for width, hashes in every.items():
        found = np.flatnonzero(in_filter(bits, hashes))
        found = found[enough(width - (placeholders[found + width] - placeholders[found]), width)]
        held = np.flatnonzero(placeholders[width:] > placeholders[:-width])
        own = hashes_at(plain, held, width)
        kept = in_filter(bits, own)
        for places, values, bare in ((found, hashes[found], False), (held[kept], own[kept], True)):
            text = np.searchsorted(first, places, side="right") - 1
            inside = places + width <= first[text + 1]
            places, values, text = places[inside], values[inside].view(np.int64), text[inside]
            edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                n = int(text[low])
                mine = slice(first[n], first[n + 1])
                local = places[low:high] - first[n]
                slots = [[]] * len(local) if bare else _rows(
                    group[n].decode(), parts[n], template[mine], kind[mine], words[mine] - begin[n], local, width)
                size = int(first[n + 1] - first[n]) - width + 1
                for place, value, row in zip(local.tolist(), values[low:high].tolist(), slots, strict=True):
                    yield n, size, width, value, place, row, False


def text_windows(docs: DataFrame, widths: list[int], wanted, kind: str = "long") -> DataFrame:
    """Windows of whole texts that the ``wanted`` bit filter may hold; templates and lower-case words as for items."""
    def run(batches):
        memo = new_memo()
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            for group in byte_groups(batch.column("text")):
                yield _window_batch(keys.slice(at, len(group)), list(group_windows(group, widths, wanted.value, memo)))
                at += len(group)

    return docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _windows(kind))


ALIGNED = ("item_id long, item_windows long, places array<long>, longest long, "
           "first_word long, last_word long, changed boolean")


def consistent(hits: list[dict]) -> list[dict]:
    """Windows of an alignment whose values agree with its one-to-one mapping, or equal the item's.

    A value maps to the one it meets at most places, with ties to itself; values
    with another tie map to none. Windows without placeholders always stay.
    """
    votes = Counter((a, b) for _, a, b in {
        (h["item_place"] + int(x.split(":", 1)[0]), x.split(":", 1)[1], y.split(":", 1)[1])
        for h in hits for x, y in zip(h["item_slots"], h["slots"], strict=True)})
    weight = {(a, b): 2 * n + (a == b) for (a, b), n in votes.items()}
    best = [defaultdict(int), defaultdict(int)]
    tied = Counter()
    for pair, w in weight.items():
        for side in (0, 1):
            best[side][pair[side]] = max(best[side][pair[side]], w)
    for pair, w in weight.items():
        tied.update((side, pair[side]) for side in (0, 1) if w == best[side][pair[side]])
    agreed = {p for p, w in weight.items() if all(w == best[side][p[side]] and tied[side, p[side]] == 1 for side in (0, 1))}
    return [h for h in hits if h["item_slots"] == h["slots"] or all(
        (x.split(":", 1)[1], y.split(":", 1)[1]) in agreed for x, y in zip(h["item_slots"], h["slots"], strict=True))]


def aligned(hits: list[dict], shift: int) -> tuple | None:
    """(item windows, words of the longest run of windows, first word, last word, changed) of one alignment, if any window counts."""
    kept = consistent(hits)
    if not kept:
        return None
    places, width, longest, begin = sorted({h["item_place"] for h in kept}), kept[0]["width"], 0, None
    for before, place in zip([None, *places], places):
        begin = place if before is None or place > before + 1 else begin
        longest = max(longest, place - begin + width)
    same = {h["item_place"] for h in kept if h["item_slots"] == h["slots"]}
    return places, longest, places[0] + shift, places[-1] + width - 1 + shift, len(same) < len(places)


def _alignments(kind: str):
    """Function to one row per (document, item, alignment) that has consistent windows."""
    key = {"long": pa.int64(), "binary": pa.binary()}[kind]
    types = (key, *[pa.int64()] * 2, pa.list_(pa.int64()), *[pa.int64()] * 3, pa.bool_())
    names = ["doc_id", *(x.split()[0] for x in ALIGNED.split(", "))]

    def run(batches):
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    line = aligned(r["hits"], r["shift"])
                    if line:
                        rows.append((r["doc_id"], r["item_id"], r["item_windows"], *line))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, run: int = RUN, least_words: int = 1, kind: str = "long") -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, first_word, last_word, changed): documents that hold an item.

    Per alignment of a text with an item, matching windows count unless their
    numbers, names and units contradict the alignment's one-to-one mapping (see
    :func:`consistent`); ``changed`` tells that some value differs. A
    leak covers ``coverage`` of the item's windows, each counted once, or holds a
    run of ``run`` words in consecutive windows.
    The case of a copy and what stands before it make no difference to windows
    with the item's own values. Windows with too few literal words and items under LEAST_WORDS words count
    with their own values only, in any case; so every window of an item is usable.
    Items that share a text are reported each; null and empty texts and items
    without words match nothing; repeated rows count once; an item with a null id is out; extra columns are ignored.
    Items under ``least_words`` words are not looked for. ``kind`` is the type of doc_id, long or binary.
    """
    spark = docs.sparkSession
    items = stored(item_windows(benchmark.where("item_id is not null and text is not null"), "item_id").where(F.col("width") >= least_words), "items").select(
        F.col("doc_id").alias("item_id"), F.col("n_windows").alias("item_windows"), "width", "hash", F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"), "fixed").distinct()
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most WIDTH values
    wanted = spark.sparkContext.broadcast(bit_filter(items))
    hits = text_windows(docs, widths, wanted, kind).select("doc_id", "width", "hash", "place", "slots").distinct()
    few = items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    both = hits.join(F.broadcast(items) if few else items, ["width", "hash"]).where(
        ~F.col("fixed") | (F.get("item_slots", F.lit(0)) == F.get("slots", F.lit(0))))
    lined = both.groupBy("doc_id", "item_id", "item_windows", (F.col("place") - F.col("item_place")).alias("shift")).agg(
        F.collect_list(F.struct("item_place", "width", "item_slots", "slots")).alias("hits")).mapInArrow(_alignments(kind), f"doc_id {kind}, {ALIGNED}")
    found = lined.groupBy("doc_id", "item_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("windows"), F.max("longest").alias("longest"),
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.bool_or("changed").alias("changed"))
    return found.where((F.col("windows") >= coverage * F.col("item_windows")) | (F.col("longest") >= run)).select(
        "doc_id", "item_id", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("coverage"),
        "first_word", "last_word", "changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those that hold a benchmark item of LEAST_WORDS words or more; columns stay as they are.

    A shorter item, such as one name, is part of ordinary texts; :func:`leaks`
    reports it, but it removes nothing. Rows are judged by their texts, whatever
    doc_id they have, so rows with a null doc_id go too and others of the same
    doc_id stay.
    """
    name = free_name(docs, "digest")
    digest = F.unhex(F.md5(F.col("text").cast("string").cast("binary")))
    found = stored(leaks(docs.select(digest.alias("doc_id"), "text"), benchmark, least_words=LEAST_WORDS, kind="binary").select(
        F.col("doc_id").alias(name)).distinct(), "leaks")
    return docs.withColumn(name, digest).join(found, name, "left_anti").select(*docs.columns)
