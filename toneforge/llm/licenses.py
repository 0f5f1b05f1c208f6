"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

A text's letters and digits, in lower case and without what stands between them, have a fingerprint for every
GRAM characters; of each WINDOW neighbouring ones the least is kept. So a text and a template that share
GRAM + WINDOW - 1 such characters share a kept fingerprint. An inverted index of the templates' fingerprints gives
candidates (place in the text, template, place in it). Candidates on nearby diagonals are one region; its words
are aligned with the template's in a band around the diagonal, for the most words in common order, and what is left
around the candidates not covered yet is aligned again, so that repeated notices are found each. What reaches
COVERAGE of the template's words is reported with its span; of a template of under SHORT words all are wanted, for
there each word decides what is granted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, col, expand, small_batches, text_bytes

GRAM, WINDOW, BAND, COVERAGE, SHORT = 8, 8, 12, 0.8, 12

#: Short notices, and the sentences by which long licenses are known. A parameter: any (name, text) pairs do.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "All rights reserved"),
)

_WORD = re.compile(r"[a-z0-9]+")
_KEEP = np.zeros(256, np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
    _KEEP[ord(_c)] = _KEEP[ord(_c.upper())] = ord(_c)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, pick: np.ufunc, width: int, fill: np.uint64) -> np.ndarray:
    """pick over x[i:i + width], by doubling; x goes on with fill."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out = pick(out, np.concatenate([out[step:], np.full(step, fill, out.dtype)])[: len(out)])
        have += step
    return out


def winnowed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, byte, place) of the kept fingerprints: the byte at which one starts, and its place among its row's kept characters."""
    kept = np.flatnonzero(_KEEP[data])
    none = np.zeros(0, np.int64)
    if len(kept) < GRAM:
        return np.zeros(0, np.uint64), none, none
    x = _KEEP[data][kept].astype(np.uint64)
    n = len(x) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h |= x[k : k + n] << np.uint64(8 * k)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    first = np.searchsorted(kept, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    h[row[:n] != row[GRAM - 1 :]] = _NEVER
    least = _sliding(h, np.minimum, WINDOW, _NEVER)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least])
    best = _sliding(padded, np.maximum, WINDOW, np.uint64(0))[:n]
    pick = np.flatnonzero((best == h) & (h != _NEVER))
    return h[pick], kept[pick], pick - first[row[pick]]


def align(template: list[str], words: list[str], shift: int, band: int = BAND) -> list[tuple[int, int]]:
    """Index pairs of the most equal words in common order, with words near template's diagonal: word j may meet template word i if |j - i - shift| <= band. Of alignments with equally many words one of the least span, the first of these."""
    m, width, one = len(template), 2 * band + 1, len(words) + 1
    best = np.zeros((m + 1, width), np.int64)  # column c of row i is word i + shift - band + c, up to and with it; one for each equal word, and the latest first word, from 1 on
    code = {w: k for k, w in enumerate(dict.fromkeys(template))}
    numbers = np.array([code.get(w, -1) for w in words] or [-1])
    columns = np.arange(width)
    for i in range(m):
        j = i + shift - band + columns
        inside = (j >= 0) & (j < len(words))
        same = inside & (numbers[np.clip(j, 0, len(numbers) - 1)] == code[template[i]])
        up = np.append(best[i][1:], best[i][-1])  # the row above holds the same word one column on
        best[i + 1] = np.maximum.accumulate(np.maximum(up, np.where(same, best[i] + one + np.where(best[i] == 0, j + 1, 0), 0)))
    # of the ends with most words the one nearest to its first word
    count, first = np.divmod(best[m] - 1, one)
    ends = np.flatnonzero(count == count.max())
    pairs, i, c = [], m, int(ends[np.argmin(ends - first[ends])])
    while i > 0 and c >= 0 and best[i][c] > 0:
        if c > 0 and best[i][c - 1] == best[i][c]:
            c -= 1
            continue
        up = best[i - 1][min(c + 1, width - 1)]
        if up == best[i][c]:
            i, c = i - 1, min(c + 1, width - 1)
            continue
        pairs.append((i - 1, i - 1 + shift - band + c))
        i -= 1
    return pairs[::-1]


def _main_diagonal(template: list[str], words: list[str], band: int) -> int | None:
    """The diagonal j - i near which (within band) most words agree; of equals the one with most on itself, then the first. None if no word agrees."""
    names = list(dict.fromkeys(template))
    code = {w: k for k, w in enumerate(names)}
    own = np.array([code[w] for w in template])
    order = np.argsort(own, kind="stable")
    many = np.bincount(own, minlength=len(names))
    first = np.cumsum(many) - many
    here = np.array([code.get(w, -1) for w in words], np.int64)
    j = np.flatnonzero(here >= 0)
    if not len(j):
        return None
    d = np.repeat(j, many[here[j]]) - expand(order, first[here[j]], many[here[j]]) + len(template)
    votes = np.bincount(d, minlength=len(words) + len(template) + 1)
    total = np.concatenate([[0], np.cumsum(np.pad(votes, band))])
    near = total[2 * band + 1 :] - total[: -2 * band - 1]
    return int(np.lexsort((np.arange(len(votes)), -votes, -np.where(votes > 0, near, -1)))[0]) - len(template)


def _words_off(data: np.ndarray, at: int, end: int, words: int) -> int:
    """A place, from at towards end, so far off that the given number of words lies between, at the edge of a character; or end."""
    reach = 16 * words
    while True:
        to = min(end, at + reach) if end > at else max(end, at - reach)
        alnum = _ALNUM[data[min(at, to) : max(at, to)]]
        if to == end or np.count_nonzero(alnum[1:] & ~alnum[:-1]) > words:
            while to not in (at, end) and data[to] & 0xC0 == 0x80:
                to += 1 if end > at else -1
            return to
        reach *= 2


#: Bytes of the words that are aligned.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def dense(pairs: list[tuple[int, int]], need: float) -> list[tuple[int, int]]:
    """The pairs without words that stand far off at the ends, so that COVERAGE of the span is matched; none if fewer than need are left."""
    a, b = 0, len(pairs)
    while b - a >= max(need, 1) and b - a < COVERAGE * (pairs[b - 1][1] - pairs[a][1] + 1):
        if b - a > 1 and pairs[a + 1][1] - pairs[a][1] >= pairs[b - 1][1] - pairs[b - 2][1]:
            a += 1
        else:
            b -= 1
    return pairs[a:b] if b - a >= max(need, 1) else []


@dataclass
class Index:
    """The templates' fingerprints, sorted, with the template and place of each."""

    names: list[str]
    words: list[list[str]]
    chars: list[int]
    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, templates: tuple[tuple[str, str], ...]) -> Index:
        data, off = text_bytes(pa.array([t for _, t in templates], pa.string()))
        h, byte, place = winnowed(data, off)
        order = np.argsort(h, kind="stable")
        table = np.zeros(1 << 20, bool)
        table[h >> np.uint64(44)] = True
        words = [_WORD.findall(t.lower()) for _, t in templates]
        return cls([n for n, _ in templates], words, [sum(map(len, w)) for w in words], h[order], (np.searchsorted(off, byte, side="right") - 1)[order], place[order], table)

    def scan(self, data: np.ndarray, off: np.ndarray, coverage: float, band: int) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, template, coverage, start, end), in code points of the row."""
        h, byte, place = winnowed(data, off)
        maybe = np.flatnonzero(self.table[h >> np.uint64(44)])
        low, high = np.searchsorted(self.hashes, h[maybe]), np.searchsorted(self.hashes, h[maybe], side="right")
        many = high - low
        if not many.any():
            return
        seed = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        byte, place = np.repeat(byte[maybe], many), np.repeat(place[maybe], many)
        row, kind = np.searchsorted(off, byte, side="right") - 1, self.template[seed]
        begin = place - self.place[seed]  # where the template would begin
        order = np.lexsort((begin, kind, row))
        row, kind, begin, byte, back = row[order], kind[order], begin[order], byte[order], self.place[seed][order]
        k = 0
        while k < len(row):
            t, reach = int(kind[k]), max(24, self.chars[int(kind[k])] // 4)
            e = k
            while e < len(row) and row[e] == row[k] and kind[e] == t and begin[e] - begin[k] <= reach:
                e += 1
            for found in self._region(data, off, int(row[k]), t, byte[k:e], back[k:e], band, coverage if len(self.words[t]) >= SHORT else 1):
                yield (int(row[k]), t, *found)
            k = e

    def _region(self, data: np.ndarray, off: np.ndarray, row: int, t: int, byte: np.ndarray, back: np.ndarray, band: int, need: float) -> Iterator[tuple[float, int, int]]:
        """The alignments of template t in a row around the seeds at byte, whose places in the template are back: first on the diagonal on which most words agree, then on those of the seeds that no earlier one covers. A word is matched once."""
        a, b = int(off[row]), int(off[row + 1])
        low, high = max(a, int((byte - 2 * back).min())), int(byte.max())
        # as many words before and after as the alignment may reach
        x = _words_off(data, low, a, 2 * band + 2)
        y = _words_off(data, high, b, len(self.words[t]) + 2 * band + 2)
        text = data[x:y].tobytes().decode("utf-8", "replace")
        spots = [(m[0], m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+", text)]
        words, template = [s[0].lower() for s in spots], self.words[t]
        shift = _main_diagonal(template, words, band)
        if shift is None:
            return
        lead = int(np.count_nonzero((data[a:x] & 0xC0) != 0x80))
        # the seeds' words, and the diagonals of these
        chars = np.cumsum((data[x:y] & 0xC0) != 0x80) - 1
        at = np.searchsorted([s[1] for s in spots], chars[byte - x], side="right") - 1
        of = np.searchsorted(np.cumsum([len(w) for w in template]), back, side="right")
        order = np.argsort(byte, kind="stable")
        covered, failed = np.zeros(len(words), bool), set()
        for j, d in [(None, shift), *zip(at[order].tolist(), (at - of)[order].tolist(), strict=True)]:
            while not (d in failed or j is not None and covered[j]):
                pairs = dense(align(template, words, d, band), need * len(template) - 1e-9)  # not words scattered over other text
                if not pairs:
                    failed.add(d)
                    break
                yield len(pairs) / len(template), lead + spots[pairs[0][1]][1], lead + spots[pairs[-1][1]][2]
                covered[pairs[0][1] : pairs[-1][1] + 1] = True
                for _, k in pairs:
                    words[k] = ""
                if j is None:
                    break


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """(doc_id, license, template, coverage, start, end) for every place of docs where at least coverage of a template's words stand in order; start and end in code points. A notice that holds another is reported as both. Null and empty texts have none, repeated rows and null ids are rows like others, an empty table gives an empty one; other columns are not read."""
    small_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    index = Index.of(templates)
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, license string, template int, coverage double, start long, end long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = sorted(set(index.scan(*text_bytes(col(b, "text")), coverage, band)))
            if found:
                row, t, cover, start, end = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([col(b, "doc_id").take(pa.array(row)), pa.array([index.names[k] for k in t]), pa.array(t, pa.int32()), pa.array(cover, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "license", "template", "coverage", "start", "end"])

    return own.mapInArrow(run, schema)
