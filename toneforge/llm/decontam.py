"""Benchmark decontamination by greedy string tiling.

Texts are words: letters and digits, A-Z in lower case, ASCII punctuation read as a blank. Words and windows of words
have rolling (Karp-Rabin) hashes. Windows of a test item are its seeds; where a document has an equal window, the
two are joined, and the tiling of the pair starts from these seeds: the longest common stretch whose words are not yet
marked is marked in both, again and again, until none has MATCH words. Because stretches may stand in any order, a
passage with its sentences moved is found too. An item counts as leaked into a document if the tiles cover at
least COVERAGE of its words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, blocks, col, expand, small_batches, text_bytes, word_spans

MATCH, COVERAGE = 5, 0.8
#: Benchmark text of one pass over the documents.
BLOCK_CHARS = 16 << 20

_FOLD = LOWER.copy()
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _FOLD[_b] = 32
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(b), np.uint64), dtype=np.uint64)]) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and for each row the number of words before it."""
    folded = _FOLD[data]
    starts, ends, at = word_spans(folded, off)
    up, down = _power_table(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[1:], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h, at


def windows(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words that lie in one row, and where they start."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[: len(words) - n + 1].copy()
    power = 1
    for k in range(1, n):
        power = power * _STEP % (1 << 64)
        h += words[k : len(words) - n + 1 + k] * np.uint64(power)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(row[: len(h)] == row[n - 1 :])
    return h[inside], inside


def _run_starts(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i:i + n] == b[j:j + n] (by hash) where the words before differ, or one has none: where the maximal matches start. The pairs inside of matches, whose number is their lengths' sum, are never made."""
    ha, sa = windows(a, np.array([0, len(a)]), n)
    hb, sb = windows(b, np.array([0, len(b)]), n)
    # a word's number: 0 for none in a, 1 for none in b, so these differ from all
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    pa_, pb = np.where(sa > 0, code[: len(a)][sa - 1] + 2, 0), np.where(sb > 0, code[len(a) :][sb - 1] + 2, 1)
    seeds, ka = np.unique(ha, return_inverse=True)
    at = np.minimum(np.searchsorted(seeds, hb), max(len(seeds) - 1, 0))
    use = np.flatnonzero(seeds[at] == hb) if len(seeds) else np.zeros(0, np.int64)
    kb, pb, sb = at[use], pb[use], sb[use]
    wide = len(names) + 2
    key = ka * wide + pa_
    order = np.argsort(key, kind="stable")
    key, sa = key[order], sa[order]
    low, high = np.searchsorted(key, kb * wide), np.searchsorted(key, (kb + 1) * wide)
    x, y = np.searchsorted(key, kb * wide + pb), np.searchsorted(key, kb * wide + pb, side="right")
    first, many, j = np.concatenate([low, y]), np.concatenate([x - low, high - y]), np.concatenate([sb, sb])
    return expand(sa, first, many), np.repeat(j, many)


def _reach(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words from a[i] and b[j] on are equal."""
    n = min(len(a) - i, len(b) - j)
    differ = a[i : i + n] != b[j : j + n]
    k = int(differ.argmax()) if n else 0
    return k if n and differ[k] else n


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a and b by stretches of at least least words. Returns (i, j, length), longest first; of equals the first in a, then in b."""
    heap = [(-_reach(a, b, i, j), i, j) for i, j in zip(*(v.tolist() for v in _run_starts(a, b, least)), strict=True)]
    heapq.heapify(heap)
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        taken = marked_a[x : x + n] | marked_b[y : y + n]
        if taken.any():  # what is left of it waits its turn
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if e - s >= least:
                    heapq.heappush(heap, (-(e - s), x + s, y + s))
            continue
        if (a[x : x + n] == b[y : y + n]).all():
            marked_a[x : x + n] = marked_b[y : y + n] = True
            out.append((x, y, n))
    return out


@dataclass
class Index:
    """Seeds of a block of test items."""

    ids: list
    words: np.ndarray
    at: np.ndarray
    #: For each window length: sorted hashes, their item and place, and a bit table of the hashes.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str | None], match: int) -> Index:
        words, at = word_hashes(*text_bytes(pa.array([t or "" for t in texts], pa.string())))
        size = np.diff(at)
        seeds = {}
        for n in sorted({min(match, int(s)) for s in size if s > 0}):
            h, start = windows(words, at, n)
            item = np.searchsorted(at, start, side="right") - 1
            own = np.minimum(size[item], match) == n
            h, start, item = h[own], start[own], item[own]
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << 22, bool)
            table[h >> np.uint64(42)] = True
            seeds[n] = (h[order], item[order], start[order] - at[item[order]], table)
        return cls(ids, words, at, seeds)

    def leaks(self, words: np.ndarray, at: np.ndarray, least_cover: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(row, item, coverage, tiles) of all pairs that reach least_cover."""
        size = np.diff(self.at)
        for n, (h, item, place, table) in self.seeds.items():
            got, start = windows(words, at, n)
            maybe = np.flatnonzero(table[got >> np.uint64(42)])
            low, high = np.searchsorted(h, got[maybe]), np.searchsorted(h, got[maybe], side="right")
            many = high - low
            if not many.any():
                continue
            # each row's different hashes, and the test windows that have them
            maybe, low, many = maybe[many > 0], low[many > 0], many[many > 0]
            row = np.searchsorted(at, start[maybe], side="right") - 1
            _, one = np.unique(row * len(h) + low, return_index=True)
            low, many, row = low[one], many[one], row[one]
            seed = expand(np.arange(len(h)), low, many)
            pair = np.repeat(row, many) * len(size) + item[seed]
            order = np.argsort(pair, kind="stable")
            pair, seed = pair[order], seed[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(pair)) + 1, [len(pair)]])
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                r, k = divmod(int(pair[x]), len(size))
                # no tile reaches beyond the seeds, so what they cover bounds the tiling
                cover = np.zeros(size[k] + 1, np.int64)
                np.add.at(cover, place[seed[x:y]], 1)
                np.add.at(cover, place[seed[x:y]] + n, -1)
                need = least_cover * size[k] - 1e-9
                if (np.cumsum(cover) > 0).sum() < need:
                    continue
                found = tiles(self.words[self.at[k] : self.at[k + 1]], words[at[r] : at[r + 1]], n)
                if (total := sum(t[2] for t in found)) >= need and total:
                    yield r, k, total / int(size[k]), found


def _indexes(benchmark: DataFrame, match: int, block_chars: int) -> Iterator[Index]:
    """The benchmark in blocks of a bounded size."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-int(total) // block_chars))
    for k in range(many):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).orderBy("item_id", "text").collect()  # about block_chars of text
        if part:
            yield Index.of([r["item_id"] for r in part], [r["text"] for r in part], match)


_FOUND = pa.schema([("item_id", pa.int64()), ("coverage", pa.float64()), ("matched", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.string())])


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, matched, item_words, tiles) for every row of docs and test item of which the tiles cover at least coverage; tiles are item word:document word:length, comma-joined, in the item's order. Items of fewer than match words need one stretch of all their words; items without a word and null texts match nothing; repeated rows and null ids are rows like others; empty tables give an empty one; other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select("doc_id", "text")
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, item_id long, coverage double, matched long, item_words long, tiles string"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, match, block_chars):
        shared = spark.sparkContext.broadcast(index)  # bounded by block_chars

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            one = shared.value
            for b in blocks(batches):
                words, at = word_hashes(*text_bytes(col(b, "text")))
                rows, found = [], []
                for r, k, cover, t in one.leaks(words, at, coverage):
                    rows.append(r)
                    found.append({"item_id": one.ids[k], "coverage": cover, "matched": sum(x[2] for x in t), "item_words": int(one.at[k + 1] - one.at[k]), "tiles": ",".join("%d:%d:%d" % x for x in sorted(t))})
                if rows:
                    rest = pa.RecordBatch.from_pylist(found, _FOUND)
                    yield pa.RecordBatch.from_arrays([col(b, "doc_id").take(pa.array(rows)), *rest.columns], ["doc_id", *_FOUND.names])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs into which no test item leaked, with all their columns, also of clashing names. A null or empty text is clean; repeated rows and null ids are rows like others; without test items all rows stay; an empty table gives an empty one; long texts are read whole."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in _indexes(benchmark, match, block_chars):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                words, at = word_hashes(*text_bytes(col(b, "text")))
                keep = np.ones(b.num_rows, bool)
                for r, *_ in shared.value.leaks(words, at, coverage):
                    keep[r] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
