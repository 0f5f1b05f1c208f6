"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18, padded with zeros to 23). The binary
Golay code (23, 12, 7) is perfect: every 23-bit word lies within 3 bits of one codeword. For a word v let K(v) be
the codewords within 4 bits of v: its own, and, if that is 3 bits away, five more. Then

* if u and v differ in at most 1 bit, u's own codeword is in K(v), so one key of u meets the keys K(v);
* if they differ in at most 2 bits, some word lies within 1 bit of both; its codeword is in K(u) and in K(v).

Up to 4 differing bits over three segments leave either two segments with at most 1 error each, or the errors
(0, 2, 2) in some order. So a pair of fingerprints within 4 bits shares a key of one of six families: own
codewords of two segments against K x K (AB, AC, BC), or one exact segment with K of a second one, on both
sides. Keys have 24 to 35 bits, candidates are checked in the join itself, and each link passes by one family
only, so the join's output holds each link once or a few times and nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructType

from .common import blocks, col, small_batches, spool, swept, text_bytes
from .graph import components

MAX_BITS = 4
MASK_A, MASK_B, MASK_C = (1 << 23) - 1, ((1 << 23) - 1) << 23, ((1 << 18) - 1) << 46


# --- fingerprints ---------------------------------------------------------------------------------------------


def _majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows of sizes[i] hashes each: bit b is 1 if set in over half of the row's hashes."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    parts = -(-n // 255)  # a byte counts up to 255
    of = np.repeat(np.arange(len(full)), parts)
    lead = np.cumsum(parts) - parts
    row0 = np.cumsum(n) - n
    starts = row0[of] + 255 * (np.arange(len(of)) - lead[of])
    ones = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & ones, starts)
        counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), lead, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(texts: list[bytes], width: int) -> np.ndarray:
    """SimHash of each text: words between ASCII white space, A-Z in lower case, shingles of width words with repeats, joined by a space, XXH64 with seed 42. Fewer words: the whole sequence is the one shingle. None: 0."""
    digest, parts, sizes = xxhash.xxh64_digest, [], np.zeros(len(texts), np.int64)
    for k, raw in enumerate(texts):
        words = raw.lower().split()
        n = len(words)
        if not n:
            continue
        line = b" ".join(words)
        if n <= width:
            parts.append(digest(line, 42))
            sizes[k] = 1
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps[: n - width] + 1).tolist()]
        ends = [*gaps[width - 1 :].tolist(), len(line)]
        parts.append(b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)]))
        sizes[k] = n - width + 1
    return _majority(np.frombuffer(b"".join(parts), ">u8").astype(np.uint64), sizes)


def _printed(docs: DataFrame, prints: dict, text: str = "text") -> DataFrame:
    """docs without the text and with a long column for each of prints, functions from texts to fingerprints. A null text counts as empty."""
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = StructType(list(keep))
    for name in prints:
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text):
            data, off = text_bytes(col(b, text))
            raw = data.tobytes()
            texts = [raw[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(col(b, f.name) for f in keep), *(pa.array(f(texts).view(np.int64)) for f in prints.values())], schema.names)

    return docs.select(*(f.name for f in keep), text).mapInArrow(run, schema)


def with_fingerprint(docs: DataFrame, width: int, text: str = "text", name: str = "fp") -> DataFrame:
    """docs without the text and with a long column, the fingerprint's 64 bits. A null text counts as empty."""
    return _printed(docs, {name: lambda texts: fingerprints(texts, width)}, text)


# --- the Golay code -------------------------------------------------------------------------------------------

#: Generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the (23, 12) code.
GENERATOR = 0xAE3


def _syndrome(v: int) -> int:
    for bit in range(22, 10, -1):
        if v >> bit & 1:
            v ^= GENERATOR << (bit - 11)
    return v


class Golay:
    """Decoding by syndrome, for arrays of 23-bit words."""

    def __init__(self) -> None:
        unit = [_syndrome(1 << b) for b in range(23)]
        self.low = np.zeros(1 << 12, np.int64)
        self.high = np.zeros(1 << 11, np.int64)
        for b in range(23):
            t, at = (self.low, b) if b < 12 else (self.high, b - 12)
            t[np.arange(len(t)) >> at & 1 == 1] ^= unit[b]
        #: The patterns of at most 3 errors, one for each syndrome; and the five of 4 errors where the former has 3.
        self.near = np.zeros(2048, np.int64)
        self.weight = np.zeros(2048, np.int64)
        for w in (1, 2, 3):
            for bits in combinations(range(23), w):
                s = 0
                for b in bits:
                    s ^= unit[b]
                self.near[s], self.weight[s] = sum(1 << b for b in bits), w
        far: list[list[int]] = [[] for _ in range(2048)]
        for bits in combinations(range(23), 4):
            s = 0
            for b in bits:
                s ^= unit[b]
            far[s].append(sum(1 << b for b in bits))
        self.far = np.full((2048, 5), -1, np.int64)
        for s, pats in enumerate(far):
            if self.weight[s] == 3:
                self.far[s] = pats

    def keys(self, v: np.ndarray) -> np.ndarray:
        """For each word six 12-bit codeword indices, its own first; -1 where there is none."""
        s = self.low[v & 4095] ^ self.high[v >> 12]
        own = (v ^ self.near[s]) >> 11
        more = np.where(self.far[s] < 0, -1, (v[:, None] ^ np.maximum(self.far[s], 0)) >> 11)
        return np.column_stack([own, more])


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


#: Families of keys, in the key's top bits.
AB, AC, BC, A_B, B_A, C_A = range(6)


def key_rows(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys by which fingerprint fp[row] is stored, or, with probe, looked up."""
    u = fp.view(np.uint64)
    seg = [(u & np.uint64(MASK_A)).astype(np.int64), (u >> np.uint64(23) & np.uint64(MASK_A)).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)]
    near = [golay().keys(s) for s in seg]
    rows, keys = [], []

    def put(family: int, key: np.ndarray, good: np.ndarray) -> None:
        r, c = np.nonzero(good)
        rows.append(r)
        keys.append(key[r, c] | family << 48)

    for family, x, y in ((AB, 0, 1), (AC, 0, 2), (BC, 1, 2)):
        m = 6 if probe else 1
        both = (near[x][:, :m, None] << 12) | near[y][:, None, :m]
        good = (near[x][:, :m, None] >= 0) & (near[y][:, None, :m] >= 0)
        put(family, both.reshape(len(u), m * m), good.reshape(len(u), m * m))
    for family, x, y in ((A_B, 0, 1), (B_A, 1, 0), (C_A, 2, 0)):
        put(family, (seg[x][:, None] << 12) | near[y], near[y] >= 0)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame, probe: bool, key: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                fp = b.column(0).slice(at, 2000).to_numpy()
                row, keys = key_rows(fp, probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[row])], [key, name])

    return fps.mapInArrow(run, f"{key} long, {name} long")


def links(fps: DataFrame, name: str = "fp") -> DataFrame:
    """fps: a column of distinct longs, nulls ignored. Returns (src, dst): all pairs with at most 4 differing bits, src < dst, each once."""
    own = fps.select(F.col(name).cast("long").alias("fp")).where("fp is not null").repartition("fp")  # a print makes up to a hundred keys: as many tasks as take part
    stored, looked = _keyed(own, False, "key", "src"), _keyed(own, True, "probe", "dst")
    x = F.col("src").bitwiseXOR(F.col("dst"))
    a, b, c = (F.bit_count(x.bitwiseAND(F.lit(m))) for m in (MASK_A, MASK_B, MASK_C - (1 << 64)))
    ab, ac, bc = (a <= 1) & (b <= 1), (a <= 1) & (c <= 1), (b <= 1) & (c <= 1)
    passes = {AB: ab, AC: ac & ~ab, BC: bc & ~ab & ~ac, A_B: (a == 0) & (b == 2) & (c == 2), B_A: (a == 2) & (b == 0) & (c == 2), C_A: (a == 2) & (b == 2) & (c == 0)}
    by = F.lit(False)
    for family, good in passes.items():
        by = by | ((F.shiftright("key", 48) == family) & good)
    met = stored.join(looked.hint("merge"), (F.col("key") == F.col("probe")) & (F.col("src") < F.col("dst")) & (F.bit_count(x) <= MAX_BITS) & by)
    return met.select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: rows whose fingerprints are linked, directly or over others, by at most 4 differing bits share component_id, their smallest doc_id.

    Exact copies share a fingerprint, so they meet in a map-side aggregation before any key is made. Null and empty texts have fingerprint 0 and are linked like any other; a null doc_id takes no part in a component's smallest id; repeated rows are kept; other columns, whatever their names, are not read; an empty table gives an empty one.
    """
    prints = spool(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width), "simhash-fp")
    return linked(prints)


def linked(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from a spooled table (doc_id, fp)."""
    distinct = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    group = components(links(distinct), "simhash-cc")
    labelled = distinct.join(group.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    small = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = spool(labelled.join(small.hint("merge"), "label").select(F.col("fp").alias("print"), "component_id"), "simhash-classes")
    return prints.join(classes.hint("merge"), F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")


# --- one document of each group -------------------------------------------------------------------------------

#: Buckets of the shingles' counts and bits of the map of shared shingles, as powers of two; cells or bits that make a row.
COUNT_BITS, MAP_BITS, CELLS = 22, 26, 1 << 14


def shingles(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes; a shorter text is one shingle."""
    words = raw.lower().split()
    h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    size = min(width, len(h))
    n = len(h) - size + 1 if size else 1
    x = np.full(n, size, np.uint64)
    for k in range(size):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(x ^ (x >> np.uint64(29)))


def set_ids(texts: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each text's shingle set."""
    return np.array([xxhash.xxh64_intdigest(shingles(t, width).tobytes(), 77) for t in texts], np.uint64)


def prefix(found: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in order of (rank of the bucket, hash): so many that two sets of at least similarity have one of them in common, in whatever order all sets are."""
    keep = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    return found[np.lexsort((found, rank[found >> np.uint64(64 - COUNT_BITS)]))[:keep]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in blocks(batches):
        data, off = text_bytes(col(b, "text"))
        raw = data.tobytes()
        yield b, [raw[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]


def _gathered(parts: DataFrame, add: Callable, finish: Callable, size: int) -> np.ndarray:
    """One table of bytes from tasks' rows (at, cells); add puts a row's cells in a part of CELLS numbers."""

    def run(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for c in t.column("cells"):
            add(total, c.as_buffer())
        return pa.table({"at": t.column("at").slice(0, 1).cast(pa.int32()), "cells": pa.array([finish(total).tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for r in parts.groupBy("at").applyInArrow(run, "at int, cells binary").collect():
        own = np.frombuffer(bytes(r.cells), np.uint8)
        out[r.at * len(own) : (r.at + 1) * len(own)] = own
    return out


def _ranks(texts: DataFrame, pick: Callable, width: int) -> np.ndarray:
    """For each bucket of shingle hashes eight times the binary logarithm of its count (of a task at most 255): common passages come last in a prefix. It decides on the number of candidates, not on what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int32)
        for raw in pick(batches):
            for t in raw:
                np.add.at(counts, (shingles(t, width) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), np.int32(1))
        small = np.minimum(counts, 255).astype(np.uint8).reshape(-1, CELLS)
        for at in np.flatnonzero(small.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([small[at].tobytes()], pa.binary())], ["at", "cells"])

    def add(total: np.ndarray, own: pa.Buffer) -> None:
        total += np.frombuffer(own, np.uint8)

    return _gathered(texts.mapInArrow(run, "at int, cells binary"), add, lambda c: np.minimum(255, 8 * np.log2(1 + c)).astype(np.uint8), 1 << COUNT_BITS)


class Marks:
    """A map of bits in which hashes are marked by their leading bits: what is not marked is none of them."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.bits, self.cells = bits, cells

    @classmethod
    def of(cls, hashes: DataFrame, bits: int) -> Marks:
        """hashes: one column of longs."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits) for b in batches]
            marked = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
            ats, first = np.unique(marked // np.uint64(CELLS), return_index=True)
            for at, part in zip(ats.tolist(), np.split((marked % np.uint64(CELLS)).astype(np.uint16), first[1:]), strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "cells"])

        def add(total: np.ndarray, own: pa.Buffer) -> None:
            total[np.frombuffer(own, np.uint16)] = 1

        return cls(bits, _gathered(hashes.mapInArrow(run, "at int, cells binary"), add, lambda c: np.packbits(c > 0), 1 << (bits - 3)))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: unsigned."""
        bit = hashes >> np.uint64(64 - self.bits)
        return (self.cells[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _fitting(n: int) -> int:
    """Bits of a map for n hashes, as a power of two: some 3 % of others are marked by chance; 32 MB at most, beyond which chance marks more."""
    return int(np.clip(math.ceil(math.log2(n + 1)) + 5, 20, 28))


def _chosen(texts: DataFrame, keys: DataFrame) -> tuple[Broadcast, Callable]:
    """(marks, pick) for texts (key, text) and the keys wanted: pick yields, of a task's batches, the wanted texts in blocks with their shingles' maker left to the caller. A map of the keys goes to the texts, so these are not shuffled; by chance it lets some others pass. marks is to be destroyed once pick has run."""
    marks = texts.sparkSession.sparkContext.broadcast(Marks.of(keys, _fitting(keys.count())))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
        for b in blocks(batches):
            some = b.filter(pa.array(marks.value.has(col(b, "key").to_numpy().view(np.uint64))))
            for _, raw in _texts(iter([some])):
                yield raw

    return marks, pick


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 77)


def _lists(texts: DataFrame, keys: DataFrame, width: int, similarity: float) -> DataFrame:
    """(h, sid, n, pos): for each shingle set its prefix, but for shingles that no other text's prefix has (up to chance in a map of bits); n is the set's size, pos the shingle's place in the set's order. texts: (key, text); keys: one for each set. A set that stands there more than once, by chance, does no harm."""
    spark = texts.sparkSession
    marks, pick = _chosen(texts, keys)
    rank = spark.sparkContext.broadcast(_ranks(texts, pick, width))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for raw in pick(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(prefix(shingles(t, width), rank.value, similarity) for t in raw)]).view(np.int64))], ["h"])

    shared = texts.mapInArrow(alone, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")

    held = spark.sparkContext.broadcast(Marks.of(shared, MAP_BITS))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for raw in pick(batches):
            hs, ids, sizes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for t in raw:
                found = shingles(t, width)
                if (sid := _set_id(found)) in done:
                    continue
                done.add(sid)
                own = prefix(found, rank.value, similarity)
                at = np.flatnonzero(held.value.has(own))
                places.append(at.astype(np.int32))
                hs.append(own[at])
                ids.append(np.full(len(at), sid, np.uint64))
                sizes.append(np.full(len(at), len(found), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ids).view(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["h", "sid", "n", "pos"])

    lists = spool(texts.mapInArrow(named, "h long, sid long, n int, pos int"), "dedup-lists")
    for sent in (marks, rank, held):
        sent.destroy()
    return lists


def _labelled(lists: DataFrame, group: DataFrame) -> DataFrame:
    return lists.join(group.hint("merge"), F.col("sid") == F.col("node"), "left").select("h", "sid", "n", "pos", F.coalesce("label", "sid").alias("label"))


#: Bits of a set's signature.
SIGNATURE = 2048


def signature(found: np.ndarray) -> np.ndarray:
    """For each residue of the shingles whether it has an odd number of them: two sets' signatures differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((found & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE) & 1).view(np.int64)


#: Bytes of a shingle's hash in a set that is sent to be compared: two shingles of a pair of sets are taken for one with a chance of 2^-40.
PACKED = 5


def packed(found: np.ndarray) -> bytes:
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, -PACKED:].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // PACKED, 8), np.uint8)
    wide[:, -PACKED:] = np.frombuffer(raw, np.uint8).reshape(-1, PACKED)
    return np.unique(wide.reshape(-1).view("<u8"))


def _of_sets(texts: DataFrame, wanted: DataFrame, width: int, make: Callable, kind: str, tag: str) -> DataFrame:
    """(sid, v) for rows (key, sid) of wanted, and by chance some others; a task gives each set once. make turns a set into a value. texts are (key, text)."""
    marks, pick = _chosen(texts, wanted.select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for raw in pick(batches):
            sids, values = [], []
            for t in raw:
                found = shingles(t, width)
                if (sid := _set_id(found)) not in done:
                    done.add(sid)
                    sids.append(sid)
                    values.append(make(found))
            arrow = pa.list_(pa.int64()) if kind == "array<long>" else pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(values, arrow)], ["sid", "v"])

    sets = spool(texts.mapInArrow(run, f"sid long, v {kind}"), tag)
    marks.destroy()
    return sets


def _similar(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, sids: DataFrame, width: int, similarity: float, tag: str) -> DataFrame:
    """Of pairs (src, dst) those whose shingle sets have a Jaccard similarity of at least similarity. Signatures leave few of the others; of what is left the sets are made from the texts and compared. sids: (sid, n, key), key being a text's that has the set."""

    def ends(of: DataFrame) -> list[DataFrame]:
        return [of.select(F.col("sid").alias(end), F.col("v").alias(v)) for end, v in (("src", "x"), ("dst", "y"))]

    a, b = ends(signatures)
    n = [sids.select(F.col("sid").alias(end), F.col("n").alias(size)) for end, size in (("src", "n"), ("dst", "m"))]
    differ = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, p: t + p)
    close = pairs.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").join(n[0].hint("merge"), "src").join(n[1].hint("merge"), "dst")
    near = spool(close.where((F.col("n") + F.col("m") - differ) / 2 + 1e-9 >= similarity / (1 + similarity) * (F.col("n") + F.col("m"))).select("src", "dst").distinct(), f"{tag}-near")
    ids = near.select(F.explode(F.array("src", "dst")).alias("own")).distinct()
    sets = _of_sets(texts, spool(sids.join(ids.hint("merge"), F.col("sid") == F.col("own")).select("sid", "key"), f"{tag}-ids"), width, packed, "binary", f"{tag}-sets")
    a, b = ends(sets)
    met = near.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("src", "dst", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                good = []
                for x, y in zip(col(part, "x").to_pylist(), col(part, "y").to_pylist(), strict=True):
                    one, two = unpacked(x), unpacked(y)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    good.append(both + 1e-9 >= similarity * (len(one) + len(two) - both))
                yield part.select(["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return spool(met.mapInArrow(run, "src long, dst long").distinct(), tag)


def _ordered(src: str, dst: str) -> list:
    return [F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")]


def deduplicated(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies, the one of the smallest doc_id (a null id only if no other has one; then by a hash of the text). All columns, also of clashing names, stay as they are.

    Two rows are linked if their fingerprints of width-word shingles differ in at most 4 bits, or if the sets of their width-word shingles have a Jaccard similarity of at least similarity; a group is what is linked directly or over others, and its row is chosen when all links are known. Sets are met by their prefixes, so every pair of that similarity is found. A pair that is in one group already is not compared: first each shingle's sets are compared with two of them, and then those outside the shingle's largest group with all others, so that a large group of near copies does not bring its pairs along. Null and empty texts are one group; rows that are equal in id and text count as copies; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    with swept(docs.sparkSession):  # each table on the way is written by one job
        return _deduplicated(docs, width, similarity)


def _deduplicated(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    spark = docs.sparkSession
    key = F.xxhash64("doc_id", "text", F.lit("near"))
    prints = spool(_printed(docs.select(F.col("doc_id"), key.alias("key"), "text"), {"fp": lambda texts: fingerprints(texts, width), "sid": lambda texts: set_ids(texts, width)}), "dedup-prints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    nodes = spool(prints.groupBy("fp", "sid").agg(F.min(order).alias("best")), "dedup-nodes")
    sids = spool(nodes.groupBy("sid").agg(F.min("best").alias("best")), "dedup-sids")

    # sets of linked fingerprints hang on the least of them
    group = components(links(spool(nodes.select("fp").distinct(), "dedup-distinct")), "dedup-cc")
    of = spool(nodes.join(group.hint("merge"), F.col("fp") == F.col("node"), "left").select("sid", F.coalesce("label", "fp").alias("group")), "dedup-groups")
    hub = of.groupBy("group").agg(F.min("sid").alias("src"))
    edges = spool(of.join(hub.hint("merge"), "group").select("src", F.col("sid").alias("dst")).where("src <> dst"), "dedup-hubs")

    texts = docs.select(key.alias("key"), "text")
    lists = _labelled(_lists(texts, sids.select("best.key"), width, similarity), components(edges, "dedup-cc1"))
    mixed = lists.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("h").alias("at"))
    opened = spool(lists.join(mixed.hint("merge"), F.col("h") == F.col("at"), "left_semi"), "dedup-open")

    def fit(n: str, pos: str, m: str, place: str) -> Column:
        """At the first shingle in common, what is left of both sets must do; this bounds the sizes too."""
        return F.least(F.col(n) - F.col(pos), F.col(m) - F.col(place)) + 1e-9 >= similarity / (1 + similarity) * (F.col(n) + F.col(m))

    ends = opened.groupBy(F.col("h").alias("at")).agg(F.min(F.struct("pos", "sid", "n", "label")).alias("p"), F.min(F.struct("sid", "pos", "n", "label")).alias("q"))
    ended = opened.join(ends.hint("merge"), F.col("h") == F.col("at"))
    met = [ended.where((F.col("label") != F.col(f"{e}.label")) & fit("n", "pos", f"{e}.n", f"{e}.pos")).select(*_ordered("sid", f"{e}.sid")) for e in "pq"]
    wanted = spool(opened.groupBy(F.col("sid").alias("own")).agg(F.first("n").alias("n")).join(sids.hint("merge"), F.col("own") == F.col("sid")).select("sid", "n", F.col("best.key").alias("key")), "dedup-wanted")
    signatures = _of_sets(texts, wanted, width, signature, "array<long>", "dedup-signatures")
    edges = edges.union(_similar(met[0].union(met[1]).distinct(), signatures, texts, wanted, width, similarity, "dedup-true"))

    left = spool(_labelled(opened.drop("label"), components(edges, "dedup-cc2")), "dedup-left")
    main = left.groupBy("h", "label").agg(F.count("*").alias("many")).groupBy(F.col("h").alias("at")).agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count("*").alias("groups")).where("groups > 1").select("at", "main")
    minor = left.join(main.hint("merge"), F.col("h") == F.col("at")).where("label <> main").select(F.col("h").alias("at"), F.col("sid").alias("other"), F.col("n").alias("m"), F.col("pos").alias("place"), F.col("label").alias("tag"))
    rest = spool(left.join(minor.hint("merge"), (F.col("h") == F.col("at")) & (F.col("label") != F.col("tag")) & fit("n", "pos", "m", "place")).select(*_ordered("sid", "other")).distinct(), "dedup-pairs")
    edges = edges.union(_similar(rest, signatures, texts, wanted, width, similarity, "dedup-true2"))

    heads = _heads(sids, components(edges, "dedup-cc3"), "sid", "dedup-heads")
    chosen = heads.select(F.col("best.doc_id").alias("chosen_id"), F.col("best.key").alias("chosen"))

    # rows that are equal in id and text are told apart by nothing: one of them stays
    counted = prints.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    of = chosen["chosen_id"].eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("chosen"))
    odd = spool(counted.join(chosen.hint("merge"), of, "left").where("chosen is null or n > 1").select("doc_id", "key", F.col("chosen").isNotNull().alias("stays")), "dedup-odd")
    names = docs.columns
    numbered = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col("doc_id").alias("row_id"), key.alias("row_key"))
    # rows whose key is marked by none of these stay as they are, without a shuffle
    marks = spark.sparkContext.broadcast(Marks.of(odd.select("key"), _fitting(odd.count())))
    marked = F.pandas_udf(lambda k: pd.Series(marks.value.has(k.to_numpy(np.int64).view(np.uint64))), "boolean")
    columns = [f"c{k}" for k in range(len(names))]
    asked = numbered.where(marked("row_key")).join(odd.hint("merge"), (F.col("row_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("doc_id")), "left")
    one = asked.where("stays").groupBy("row_id", "row_key").agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    out = numbered.where(~marked("row_key")).select(*columns).union(asked.where("stays is null").select(*columns)).union(one)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def _heads(rows: DataFrame, group: DataFrame, node: str, tag: str) -> DataFrame:
    """Of rows (node, best, ...) those that are the best of their component; a row without a link is its own."""
    labelled = rows.join(group.hint("merge"), rows[node] == group["node"], "left").withColumn("label", F.coalesce("label", node)).drop("node")
    least = labelled.groupBy("label").agg(F.min("best").alias("least"))
    return spool(labelled.join(least.hint("merge"), "label").where("best = least").drop("least", "label"), tag)
