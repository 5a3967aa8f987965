"""License scans: winnowed template fingerprints pick candidates, banded alignment reports them.

Templates are few, so their inverted index goes to every task; a text is
read once, whole, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import chain, groupby
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Memo, byte_groups, mix, word_lists

#: Notices as their licences recommend them.
TEMPLATES = {
    "agpl-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "epl-2.0-notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "gpl-2.0-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"),
    "lgpl-2.1-short": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0-short": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-permission": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction'),
    "mit-short": "Released under the MIT License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

GRAM, WINDOW = 3, 4
#: Templates of fewer words keep every gram: what edits leave of them can be shorter than winnowing needs.
EVERY_GRAM = 100
#: From so many words on, diagonals are aligned in tiles as wide as the band.
LONG = 200
LEAST = 0.8
WORD = re.compile(r"[0-9A-Za-z]+")
RESULT = ("doc_id long, license string, coverage double, matched_words int, template_words int, "
          "start long, end long, first_word long, last_word long")


def bodies() -> dict[str, str]:
    """Whole license texts that come with the package, as ``<file name>-text``; read by the driver only."""
    return {f"{p.name.lower()}-text": p.read_text() for p in sorted(Path(__file__).with_name("license_texts").iterdir())}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of every GRAM consecutive word ids."""
    n = len(ids) - GRAM + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(GRAM):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n].astype(np.uint64)) if n > 0 else out
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the rightmost minimum of each window; of the smallest hash if there is no whole window."""
    if len(hashes) <= window:
        return [int(np.argmin(hashes))] if len(hashes) else []
    return sorted({i + window - 1 - int(np.argmin(hashes[i:i + window][::-1])) for i in range(len(hashes) - window + 1)})


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment of a template with a text part, within a band.

    Word i of the template may meet words i + shift - band to i + shift + band.
    Matches count, gaps are free inside the band; among equals the tightest span wins.
    """
    width = 2 * band + 1
    score = np.zeros(width, np.int64)
    start = np.full(width, -1, np.int64)
    end = np.full(width, -1, np.int64)
    for i, word in enumerate(template):
        base = i + shift - band
        # cell d of the row before stands for text word base - 1 + d: a match takes it, a skipped template word takes d + 1
        skip_s, skip_b, skip_e = (np.append(x[1:], x[-1]) for x in (score, start, end))
        at = np.arange(base, base + width)
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, max(0, len(text) - 1))] == word) if len(text) else np.zeros(width, bool)
        s = np.where(same, score + 1, skip_s)
        b = np.where(same, np.where(start < 0, at, start), skip_b)
        e = np.where(same, at, skip_e)
        worse = same & (skip_s > s)
        s, b, e = np.where(worse, skip_s, s), np.where(worse, skip_b, b), np.where(worse, skip_e, e)
        most = np.maximum.accumulate(s)  # skipped text words: the last cell that no earlier one beats
        from_cell = np.maximum.accumulate(np.where(s == most, np.arange(width), 0))
        score, start, end = s[from_cell], b[from_cell], e[from_cell]
    best = max(range(width), key=lambda d: (score[d], start[d] - end[d]))
    return int(score[best]), int(start[best]), int(end[best])


class Index:
    """Word numbers and fingerprints of the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        kept = sorted((n, words) for n, words in ((n, words_of(t)) for n, t in templates) if len(words) >= GRAM)
        self.names = [n for n, _ in kept]
        lists = [words for _, words in kept]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(set(chain.from_iterable(lists))))}
        self.words = [np.array([self.vocabulary[w] for w in words]) for words in lists]
        posts = defaultdict(list)
        for t, ids in enumerate(self.words):
            hashes = gram_hashes(ids)
            for at in range(len(hashes)) if len(ids) < EVERY_GRAM else winnow(hashes):
                posts[int(hashes[at])].append((t, at))
        self.counts = [np.bincount(ids, minlength=len(self.vocabulary) + 1) for ids in self.words]
        self.posts = dict(posts)
        self.hashes = np.array(sorted(self.posts), np.uint64)

    def numbers(self, word: bytes) -> tuple[int, ...]:
        """Numbers of the alphanumeric parts of a word; 0 for one that no template has."""
        return tuple(self.vocabulary.get(w, 0) for w in words_of(word.decode()))

    def scan(self, ids: np.ndarray, least: float) -> list[tuple[int, int, int, int]]:
        """(template, matched words, first, last) of every place that covers ``least`` of a template.

        Hits of a template whose diagonals differ by at most the band, and that
        lie within its length, are one candidate.
        """
        hashes = gram_hashes(ids)
        if not len(hashes):
            return []
        at = np.flatnonzero(np.isin(hashes, self.hashes))
        hits = defaultdict(list)
        for i in at:
            for t, place in self.posts[int(hashes[i])]:
                hits[t].append(int(i) - place)
        found = []
        for t, shifts in sorted(hits.items()):
            template = self.words[t]
            if len(ids) < least * len(template):
                continue
            band, free = max(2, len(template) // 8), -len(template)  # a text may begin inside a template
            tile = band if len(template) >= LONG else 0
            skip = None
            for shift in sorted(set(shifts)):
                if shift < free or (skip is not None and shift <= skip):
                    continue
                wide = band + tile
                low = max(0, shift - wide)
                part = ids[low:max(low, shift + len(template) + wide)]
                # words in common, in any order, bound the words in order
                if np.minimum(np.bincount(part, minlength=len(self.counts[t])), self.counts[t])[1:].sum() < least * len(template):
                    continue
                matched, first, last = align(template, part, shift - low, wide)
                skip = shift + tile if tile else None
                if matched >= least * len(template):
                    found.append((t, matched, low + first, low + last))
                    free = low + last
        return found


def outermost(found: list[tuple[int, int, int, int]], strength) -> list[tuple[int, int, int, int]]:
    """Places that no place of greater strength contains, in their order; n log n in their number.

    Places are taken by first word, the widest first. A Fenwick tree over the last
    words knows the greatest strength seen that reaches at least as far.
    """
    ranks = {s: i + 1 for i, s in enumerate(sorted({strength(f) for f in found}))}
    ends = {e: i + 1 for i, e in enumerate(sorted({f[3] for f in found}, reverse=True))}
    most, kept = [0] * (len(ends) + 1), set()
    order = sorted(range(len(found)), key=lambda i: (found[i][2], -found[i][3]))
    for _, same in groupby(order, key=lambda i: found[i][2:]):
        same = list(same)
        for i in same:
            at, rank = ends[found[i][3]], ranks[strength(found[i])]
            while at < len(most):
                most[at] = max(most[at], rank)
                at += at & -at
        for i in same:
            at, best = ends[found[i][3]], 0
            while at:
                best = max(best, most[at])
                at -= at & -at
            if best <= ranks[strength(found[i])]:
                kept.add(i)
    return [f for i, f in enumerate(found) if i in kept]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row per place of a document where ``least`` of a template's words stand in order.

    (doc_id, license, coverage, matched_words, template_words, start, end,
    first_word, last_word): start and end are code points of the text, end
    exclusive; words are runs of ASCII letters and digits, in any case. Of
    templates that overlap, only those are reported that no other one with more
    matched words, or as many and a greater share, contains. ``templates`` are
    texts by name or a table (license, text), where a license may have variants;
    otherwise TEMPLATES and :func:`bodies`. They go to every task, so they are
    collected. Null texts and those under GRAM words are no templates. Null and empty texts have no rows; repeated rows are
    scanned each; other columns are ignored.
    """
    if isinstance(templates, DataFrame):
        pairs = [tuple(r) for r in templates.select("license", "text").where("license is not null and text is not null").distinct().collect()]
    else:
        pairs = list((TEMPLATES | bodies() if templates is None else templates).items())
    index = Index(pairs)

    def strength(f):
        return f[1], f[1] / len(index.words[f[0]]), -f[0]

    def run(batches):
        memo = Memo(index.numbers)
        for batch in batches:
            keys, texts, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
            for group in byte_groups(texts):
                rows = []
                for data in group:
                    parts = [np.fromiter(chain.from_iterable(memo.values_of(w)), np.int64) for w in word_lists(data)]
                    found = index.scan(np.concatenate(parts), least)
                    found = outermost(found, strength)
                    spans = [m.span() for m in WORD.finditer(data.decode())] if found else []
                    for t, matched, first, last in found:
                        total = len(index.words[t])
                        rows.append((keys[at], index.names[t], matched / total, matched, total, spans[first][0], spans[last][1], first, last))
                    at += 1
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
                    names = [x.split()[0] for x in RESULT.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
