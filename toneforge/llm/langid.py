"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A letter n-gram binds its letters' vectors, each permuted (rotated) by
its place, by multiplication; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles
all its training texts. A text gets the language whose prototype has the largest cosine with its vector.

Bundling is linear, so a text is first counted into n-grams and the counts multiply the n-gram vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, col, small_batches, text_bytes

DIM = 1024
N = 3
#: More labels than this are no set of languages.
MAX_LABELS = 1024
UNKNOWN = "und"

#: Per code point: number of its letter, 0 for what is no letter, -1 where not yet looked up. Numbers go up with first use in this process; vectors depend on the letter alone.
_number = np.full(0x110000, -1, np.int32)
_letters: list[str] = [""]
_seen: dict[str, int] = {"": 0}


def _look_up(points: np.ndarray) -> None:
    for p in points.tolist():
        ch = chr(p)
        if not ch.isalpha():
            _number[p] = 0
            continue
        low = ch.lower()[0]
        if low not in _seen:
            _seen[low] = len(_letters)
            _letters.append(low)
        _number[p] = _seen[low]


def _sign_vector(letter: str) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64(ord(letter) if letter else 0x110000)).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


#: The letters' vectors in the three places of an n-gram, permuted by as many steps as follow it.
_placed = [np.zeros((0, DIM), np.int8)] * 3


def _placed_vectors() -> list[np.ndarray]:
    done = len(_placed[0])
    if done < len(_letters):
        new = np.stack([_sign_vector(c) for c in _letters[done:]])
        for k, shift in enumerate((2, 1, 0)):
            _placed[k] = np.concatenate([_placed[k], np.roll(new, shift, axis=1)])
    return _placed


def gram_vectors(keys: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, keyed as letter_grams does."""
    a, b, c = _placed_vectors()
    return a[keys >> 42 & 0x1FFFFF] * b[keys >> 21 & 0x1FFFFF] * c[keys & 0x1FFFFF]


#: N-grams whose vectors are made at once, and counts of a dense table of rows and n-grams.
GRAMS, DENSE = 4096, 1 << 23


def bundle(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """For each row the sum of its n-grams' vectors, in whole numbers. Few different n-grams are multiplied as a table of counts; of many, each row's own are added up, a slice at a time. Both are exact, so they agree."""
    out = np.zeros((rows, DIM))
    if not len(row):
        return out
    keys, at = _numbered(key)
    if rows * len(keys) <= DENSE:
        counts = np.bincount(row * len(keys) + at, minlength=rows * len(keys)).reshape(rows, len(keys)).astype(np.float32)
        for k in range(0, len(keys), GRAMS):
            out += _exact(counts[:, k : k + GRAMS], gram_vectors(keys[k : k + GRAMS]))
        return out
    pair, n = np.unique(row * len(keys) + at, return_counts=True)
    for k in range(0, len(pair), GRAMS):
        own, which = np.divmod(pair[k : k + GRAMS], len(keys))
        lead = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[lead]] += np.add.reduceat(gram_vectors(keys[which]) * n[k : k + GRAMS, None].astype(np.float64), lead)
    return out


def _exact(counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The product, in single precision where its whole numbers fit."""
    kind = np.float32 if counts.sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    return counts.astype(kind, copy=False) @ vectors.astype(kind)


def letter_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every letter trigram with a letter in its middle; what is no letter is a blank beside it."""
    rows = len(off) - 1
    sizes = np.diff(off)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    num = _number[points]
    if (num < 0).any():
        _look_up(np.unique(points[num < 0]))
        num = _number[points]
    lead = (data & 0xC0) != 0x80
    per_row = np.add.reduceat(np.concatenate([lead, [False]]).astype(np.int64), off[:-1]) * (sizes > 0) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), per_row)
    mid = np.flatnonzero(num > 0)
    if not len(mid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([[0], num, [0]]).astype(np.int64)
    of = row[mid]
    rowp = np.concatenate([[-1], row, [-1]])
    before = np.where(rowp[mid] == of, padded[mid], 0)
    after = np.where(rowp[mid + 2] == of, padded[mid + 2], 0)
    return of, before << 42 | padded[mid + 1] << 21 | after


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and which of them each one is."""
    a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
    top = int(max(a.max(), b.max(), c.max())) + 1
    if top**3 > 1 << 22:
        return np.unique(key, return_inverse=True)
    small = (a * top + b) * top + c
    present = np.flatnonzero(np.bincount(small, minlength=1))
    rank = np.zeros(top**3, np.int64)
    rank[present] = np.arange(len(present))
    return (present // (top * top)) << 42 | (present // top % top) << 21 | present % top, rank[small]


def prototypes(docs: DataFrame, label: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Labels in order and their bundled vectors, from rows with a label and a text; repeated rows count as often as they stand there, null or empty texts add nothing, an empty table has no labels. Counts are summed exactly (as long integers), so the result does not depend on the partitions. Over MAX_LABELS labels raise ValueError. Other columns are not read."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in blocks(batches, "text"):
            data, off = text_bytes(col(b, "text"))
            row, key = letter_grams(data, off)
            if not len(row):
                continue
            codes = col(b, "label").dictionary_encode()
            got = np.rint(bundle(codes.indices.to_numpy()[row].astype(np.int64), key, len(codes.dictionary))).astype(np.int64)
            for k, name in enumerate(codes.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + got[k]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["label", "v"])

    parts = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).mapInArrow(run, "label string, v array<long>")
    summed = parts.select("label", F.posexplode("v").alias("at", "x")).groupBy("label", "at").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("label", F.col("v.x").alias("v")).limit(MAX_LABELS + 1).collect()
    if len(whole) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels")
    whole.sort(key=lambda r: r["label"])
    return [r["label"] for r in whole], np.array([r["v"] for r in whole], np.float64).reshape(len(whole), DIM)


def predict(docs: DataFrame, labels: list[str], profile: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score: the cosine with the nearest prototype, 0 where it is negative. A null or letterless text, or no prototype at all, gives und and 0. Equal cosines go to the label that sorts first. Whole texts are read, however long; repeated rows, nulls in other columns and empty tables pass through; columns that are not kept are not read, whatever their names."""
    small_batches(docs.sparkSession)
    norm = np.linalg.norm(profile, axis=1, keepdims=True)
    unit = (profile / np.where(norm > 0, norm, 1)).astype(np.float32)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, BLOCK_BYTES):
            data, off = text_bytes(col(b, text))
            row, key = letter_grams(data, off)
            n = b.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            if len(row) and len(labels):
                vec = bundle(row, key, n).astype(np.float32)
                size = np.linalg.norm(vec, axis=1)
                cos = (vec @ unit.T) / np.where(size > 0, size, 1)[:, None]
                lettered = np.bincount(row, minlength=n) > 0
                best = np.where(lettered, cos.argmax(axis=1), -1)
                score = np.where(lettered, np.clip(cos.max(axis=1), 0, 1), 0).astype(np.float64)
            named = [labels[k] if k >= 0 else UNKNOWN for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), pa.array(named, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from the rows of docs where learn holds, and predicts all; odd rows as in prototypes and predict."""
    labels, profile = prototypes(docs.where(learn))
    return predict(docs, labels, profile, keep=keep)
