"""Language-model scores by online logistic context mixing.

A text is a row of tokens: its words in lower case, then one end. A token is coded bit by bit: whether it is the end;
whether it is the word that followed the last two words the last time they stood in the text; whether its word was
seen in training. A seen word is then coded by the bits of its 64-bit hash, from the first on, until no other seen
word has them; an unseen one is spelled, by the bits of its bytes. So the bits are the word's own, and all words'
probabilities add up to 1 at most.

Each bit is predicted from several hashed contexts, each a table of counts over all training documents. The
predictions are stretched, weighted by the set of weights that a gate picks (the bit's kind and how often the contexts
were seen) and squashed. For the flags and the first BITS bits of a word the contexts are none, the state, the word
before, the two words before, and the last letter before with the state. After every CHUNK tokens a document corrects
its own weights and its own refinement of each kind of bit by what these tokens were, so a probability depends on what
stands before alone. The bits after these are predicted from the counts of all seen words, and of those seen in the
state, that begin with the same bits; they do not depend on the place, so each word has one cost a state. What a new
word looks like is learned from words seen once. First weights and refinements are learned with a bit's own count taken
off: those of words over all words, those of spelling over all words seen once, the others over all training documents.

The state stands for language and style. The most frequent words are grouped by the documents that they share; the
state is the group that a text's words so far speak for most.

No table of words is sent around. The corpus is kept in blocks of bounded size with their own numbering. A block sends
the hashes of its distinct words and their counts to buckets of hashes, where the corpus counts are known, and gets
back a count and the costs for each. Buckets are even, however often a word stands in the corpus, for a block names it
once. Their number follows the number of names; tables of contexts follow the input up to a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, coded, col, expand, small_batches, spool, strings_of, swept, text_bytes, through, word_spans

#: Text of a block; names that a bucket gets (about).
BLOCK, NAMES = 16 << 20, 1 << 18
#: An Arrow batch of blocks ends after so many bytes. Tokens of documents that are learned from at once.
BATCH, LEARNED = "8m", 50_000
#: Frequent words that tell states, states (0: none of them seen yet), first bits of a word, tokens between corrections.
TOPS, STATES, BITS, CHUNK = 256, 8, 4, 32
#: Rates of a document's own weights and of its own refinement.
RATE, REFINE_RATE = 0.02, 0.1
#: Steps a bit in which a word's costs are kept, rounded up.
STEPS = 512
_SEED = np.random.default_rng(20).integers(0, 1 << 63, 300, np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _C
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


# --- blocks ---------------------------------------------------------------------------------------------------

_BLOCK = "block long, doc_ids array<long>, held binary, counts binary, codes binary, words binary, n_words long, n_train long, trained long, top_words array<binary>, top_counts array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    parts: list[tuple] = []
    size = 0

    def put() -> pa.RecordBatch:
        data = through(np.concatenate([p[0] for p in parts]), LOWER)
        base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
        off = np.concatenate([*(p[1][:-1] + b for p, b in zip(parts, base, strict=True)), [len(data)]])
        out = np.concatenate([p[3] for p in parts])
        starts, ends, at = word_spans(data, off)
        codes, words = coded(strings_of(data, starts, ends))
        counts = np.diff(at)
        n = np.bincount(codes[np.repeat(~out, counts)], minlength=len(words))
        most = np.lexsort((np.arange(len(n)), -n))[: 2 * TOPS]
        most = most[n[most] > 0]
        ids = pa.concat_arrays([p[2] for p in parts])
        listed = words.take(pa.array(most)).cast(pa.binary()) if len(most) else pa.array([], pa.binary())
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([out.tobytes()], pa.binary()), pa.array([counts.astype("<i4").tobytes()], pa.binary()),
            pa.array([codes.astype("<i4").tobytes()], pa.binary()), pa.array([b"\n".join(words.to_pylist())], pa.binary()), pa.array([len(words)]), pa.array([int(n.sum())]), pa.array([int((~out).sum())]),
            pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed), pa.ListArray.from_arrays(pa.array([0, len(most)], pa.int32()), pa.array(n[most].astype(np.int64))),
        ], [f.split()[0] for f in _BLOCK.split(", ")])

    for b in batches:
        data, off = text_bytes(col(b, "text"))
        at, n = 0, b.num_rows
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + BLOCK - size, side="right")) - 1))
            parts.append((data[off[at] : off[end]], off[at : end + 1] - off[at], col(b, "doc_id").slice(at, end - at).cast(pa.int64()), col(b, "held").slice(at, end - at).to_numpy(zero_copy_only=False).astype(bool)))
            size += int(off[end] - off[at])
            at = end
            if size >= BLOCK or (at < n and size):
                yield put()
                number, size = number + 1, 0
                parts.clear()
    if parts:
        yield put()


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at [starts, ends) of data. Two words have the same one with a chance of 2^-64."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
        size = (ends - starts)[at:stop]
        power = np.multiply.accumulate(np.full(int(size.max()), _A))
        first = np.cumsum(size) - size
        flat = np.arange(int(size.sum()))
        place = flat - np.repeat(first, size)
        own = _SEED[data[place + np.repeat(starts[at:stop], size)]] * power[place]
        out[at:stop] = _mix(np.add.reduceat(own, first) ^ (size.astype(np.uint64) * _B))
        at = stop
    return out


class Block:
    """A row of the blocks' table."""

    def __init__(self, r: dict) -> None:
        self.held = np.frombuffer(r["held"], bool)
        self.counts = np.frombuffer(r["counts"], "<i4").astype(np.int64)
        self.codes = np.frombuffer(r["codes"], "<i4")
        self.data = np.frombuffer(r["words"], np.uint8)
        if len(self.codes):
            self.ends = np.append(np.flatnonzero(self.data == 10), len(self.data))
            self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.order = np.argsort(self.hashes, kind="stable")  # in which words are named to the buckets
        self.first = np.cumsum(self.counts) - self.counts
        self.top: np.ndarray | None = None

    def tops(self, states: States) -> np.ndarray:
        """Which of the states' frequent words each word is, or -1; the end, after all words, is none."""
        if self.top is None:
            self.top = np.append(states.index(self.hashes), -1)
        return self.top

    def words(self, of: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[of].tolist(), self.ends[of].tolist(), strict=True)]

    def groups(self, docs: np.ndarray, tokens: int = 150_000, most: int = 512) -> Iterator[np.ndarray]:
        """docs in parts of bounded size, those of equal length together."""
        docs = docs[np.argsort(self.counts[docs], kind="stable")]
        at, total = 0, np.cumsum(self.counts[docs] + 1)
        while at < len(docs):
            end = min(at + most, max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + tokens))), len(docs))
            yield docs[at:end]
            at = end


_COLUMNS = ["block", "doc_ids", "held", "counts", "codes", "words"]


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, lists as Arrow arrays: a row is a whole block."""
    for k in range(b.num_rows):
        yield {n: (c[k].values if c[k].is_valid else None) if pa.types.is_list(c.type) else c[k].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}


# --- states ---------------------------------------------------------------------------------------------------


class States:
    """tops: hashes of the frequent words, sorted; speaks: for each of them what it adds to each group, whole numbers (so sums do not depend on their order)."""

    def __init__(self, tops: np.ndarray, speaks: np.ndarray) -> None:
        self.tops, self.speaks = tops, speaks

    @classmethod
    def learn(cls, tops: np.ndarray, together: np.ndarray, groups: int = STATES - 1) -> States:
        """together: in how many documents two of the words stand."""
        n = len(tops)
        if not n:
            return cls(tops, np.zeros((0, groups), np.int64))
        # words are grouped by the words that they share documents with, by divergence; first each group is the word that the former ones tell least of
        share = together / np.maximum(together.sum(axis=1, keepdims=True), 1)
        own_bits = (share * np.log(np.maximum(share, 1e-12))).sum(axis=1)

        def log_shares(mass: np.ndarray) -> np.ndarray:
            return np.log((mass + 0.5) / (mass + 0.5).sum(axis=1, keepdims=True))

        middle = [int(np.diag(together).argmax())]
        while len(middle) < min(groups, n):
            told = (share @ log_shares(together[middle]).T).max(axis=1) - own_bits
            told[middle] = np.inf
            middle.append(int(told.argmin()))
        of = log_shares(together[middle])
        for _ in range(30):
            own = (share @ of.T).argmax(axis=1)
            of = log_shares(np.array([together[own == g].sum(axis=0) for g in range(len(middle))]))
        logs = np.rint(1024 * of).astype(np.int64).T
        return cls(tops, np.pad(logs, ((0, 0), (0, groups - len(middle))), constant_values=-1 << 30))

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Which of tops each hash is, or -1."""
        if not len(self.tops):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.tops, hashes), len(self.tops) - 1)
        return np.where(self.tops[at] == hashes, at, -1)

    def before(self, top: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The state in front of each token. top: which of tops each token is, or -1; doc: its document, ascending."""
        known = top >= 0
        at = np.flatnonzero(known)
        if not len(at):
            return np.zeros(len(top), np.int64)
        total = np.cumsum(self.speaks[top[at]], axis=0)
        own = doc[at]
        lead = np.flatnonzero(np.diff(own, prepend=-1))
        base = np.where(lead[:, None] > 0, total[lead - 1], 0)
        total -= np.repeat(base, np.diff(np.append(lead, len(at))), axis=0)
        after = 1 + total.argmax(axis=1)
        last = np.cumsum(known) - known - 1
        return np.where((last >= 0) & (own[np.maximum(last, 0)] == doc), after[np.maximum(last, 0)], 0)


def _together(staged: DataFrame, tops: np.ndarray) -> np.ndarray:
    """In how many training documents each two of the words stand."""
    states, n = States(tops, np.zeros((len(tops), 0), np.int64)), len(tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            for r in _rows(b):
                own = Block(r)
                top = own.tops(states)[own.codes]
                doc = np.repeat(np.arange(len(own.held)), own.counts)
                use = (top >= 0) & ~own.held[doc]
                for part in np.array_split(np.flatnonzero(use), max(1, int(use.sum()) // 500_000)):
                    if len(part):
                        there = np.zeros((doc[part[-1]] - doc[part[0]] + 1, n), np.float32)  # a document at a cut counts for both sides
                        there[doc[part] - doc[part[0]], top[part]] = 1
                        total += there.T @ there
        yield from _cells(total.astype(np.int64).ravel())

    return _summed(staged.select(*_COLUMNS).mapInArrow(run, _CELLS), n * n).reshape(n, n) if n else np.zeros((0, 0))


#: Cells of a table that make a row between tasks.
_ROW, _CELLS = 1 << 14, "at int, cells binary"


def _cells(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table of counts in rows of the least width that holds them, without those of noughts alone."""
    for at in range(0, len(table), _ROW):
        part = table[at : at + _ROW]
        if most := int(part.max()):
            yield pa.RecordBatch.from_arrays([pa.array([at // _ROW], pa.int32()), pa.array([part.astype(np.min_scalar_type(most)).tobytes()], pa.binary())], ["at", "cells"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of the tasks' tables, of a fixed size."""

    def run(t: pa.Table) -> pa.Table:
        at = t.column("at")[0].as_py()
        n = min(_ROW, size - at * _ROW)
        total = np.zeros(n, np.int64)
        for c in t.column("cells"):
            raw = c.as_buffer()
            total += np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)
        return pa.table({"at": pa.array([at], pa.int32()), "cells": pa.array([total.astype(np.min_scalar_type(int(total.max()))).tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in parts.groupBy("at").applyInArrow(run, _CELLS).toArrow().to_pylist():
        n = min(_ROW, size - r["at"] * _ROW)
        out[r["at"] * _ROW :][:n] = np.frombuffer(r["cells"], f"<u{len(r['cells']) // n}")
    return out


# --- mixing ---------------------------------------------------------------------------------------------------


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def predicted(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Stretched share of ones."""
    return np.log((n1 + np.float32(0.2)) / (n0 + np.float32(0.2)))


#: Bits whose inputs are made and weighed at once: what a cache holds.
_SOME = 1 << 13


def _inputs(bits: int, inputs: int) -> np.ndarray:
    """Room for (bits, inputs), each input's numbers side by side: steps run along the bits."""
    return np.empty((inputs, bits), np.float32).T


def weighed(x: np.ndarray, gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The inputs' sums by the weights of each bit's gate, in the weights' precision."""
    out, columns = np.empty(len(x), w.dtype), np.ascontiguousarray(w.T)
    for at in range(0, len(x), _SOME):
        part = slice(at, at + _SOME)
        np.einsum("ib,ib->b", _picked(columns, gate[part]), x[part].T, out=out[part])
    return out


def _picked(columns: np.ndarray, of: np.ndarray) -> np.ndarray:
    """columns[:, of], by the faster way for indices that are known to be good."""
    out = np.empty((len(columns), len(of)), columns.dtype)
    return columns.take(of, axis=1, out=out, mode="clip")


def learn_weights(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, gates: int, chunk: int = 2048, w: np.ndarray | None = None) -> np.ndarray:
    """Gated weights by online descent, a chunk of bits at a time, from w on. x: (bits, inputs), the last one a bias."""
    if w is None:
        w = even_weights(gates, x.shape[1])
    k = x.shape[1]
    first = gates * np.arange(k)[:, None]
    for at in range(0, len(x), chunk):
        part, g = x[at : at + chunk], gate[at : at + chunk]
        lost = bit[at : at + chunk].astype(np.float32) - squash(weighed(part, g, w.astype(np.float32)))
        step = np.bincount((first + g).ravel(), (part.T * lost).ravel(), gates * k).reshape(k, gates).T
        w = np.clip(w + 0.02 * step / np.sqrt(1 + np.bincount(g, minlength=gates))[:, None], -3, 3)
    return w


def newton_weights(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, times: np.ndarray, w: np.ndarray, curve: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """Gated weights by online Newton steps, a chunk of bits at a time, from w on; for few inputs. times: how many tokens a bit stands for. curve: each gate's curvature of all bits seen so far, which is added to."""
    gates, k = w.shape
    for at in range(0, len(x), chunk):
        part, g, n = x[at : at + chunk], gate[at : at + chunk], times[at : at + chunk]
        p = squash(np.einsum("bi,bi->b", w[g], part))
        lost, sure = n * (bit[at : at + chunk] - p), n * p * (1 - p)
        step = np.stack([np.bincount(g, lost * part[:, i], gates) for i in range(k)], axis=1)
        for i in range(k):
            for j in range(i, k):
                own = np.bincount(g, sure * part[:, i] * part[:, j], gates)
                curve[:, i, j] += own
                if j > i:
                    curve[:, j, i] += own
        w = np.clip(w + np.linalg.solve(curve, step[..., None])[..., 0], -3, 3)
    return w


def even_weights(gates: int, inputs: int) -> np.ndarray:
    w = np.full((gates, inputs), 1 / max(1, inputs - 1))
    w[:, -1] = 0
    return w


#: Stretched probabilities stay in these bounds.
LIMIT = 13.8
_MIDDLES = ((np.arange(33) - 16) / 2.0).astype(np.float32)


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + 16, 0, 32).astype(np.int64)


def refinement(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """For each context and bucket of the mixed prediction the stretched share of ones, leaning to the bucket's own middle."""
    p = squash(_MIDDLES)
    return np.log((ones + 20 * p) / (all_ - ones + 20 * (1 - p))).astype(np.float32)


def refined(z: np.ndarray, table: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Half the mixed prediction, half its refinement, stretched. context: 33 times the row of table."""
    return (z + table.reshape(-1).take(context + _bucket(z))) / 2


# --- words by their hashes ------------------------------------------------------------------------------------


#: How often a state's words must have been met for the next gate of a hash's bit.
SURE = (1, 4, 16, 64, 256, 1024, 8192)


def hash_costs(h: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
    """For seen words (sorted hashes, counts in each state) the bits that it takes in each state to tell each from the others that share its first start bits. A bit is mixed from the words of all states and those of the state itself; weights are learned online over all words, a word's own count taken off."""
    cost = np.zeros(counts.shape)
    if len(h) < 2:
        return cost
    c = counts.astype(np.float64)
    every = c.sum(axis=1)
    before = np.concatenate([np.zeros((1, c.shape[1])), np.cumsum(c, axis=0)])  # whole numbers: differences are exact
    w, curve = even_weights(len(SURE) + 1, 3), np.tile(20 * np.eye(3), (len(SURE) + 1, 1, 1))
    nodes = []
    live = np.arange(len(h))
    for depth in range(start, 64):
        key = h[live] >> np.uint64(64 - depth)
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(run, len(live)))
        keep = np.repeat(size > 1, size)
        live = live[keep]
        if not len(live):
            break
        size = size[size > 1]
        run = np.cumsum(size) - size
        bit = (h[live] >> np.uint64(63 - depth) & np.uint64(1)).astype(np.int64)
        high = np.add.reduceat(bit, run)
        split = np.repeat((high > 0) & (high < size), size)
        if split.any():
            last = before[live[run] + size]  # words of a node stand side by side, those of bit 1 after the others
            nodes.append((live[split], bit[split], np.repeat(np.arange(len(run)), size)[split], last - before[live[run] + size - high], last - before[live[run]]))

    def inputs(one: np.ndarray, zero: np.ndarray, one_s: np.ndarray, zero_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.ones((*one_s.shape, 3))
        x[..., 0] = np.log((one + 0.4) / (zero + 0.4))
        x[..., 1] = np.log((one_s + 0.2) / (zero_s + 0.2))
        return x, np.searchsorted(SURE, one_s + zero_s, side="right")

    for words, bit, node, ones, all_ in nodes:
        i, s = np.nonzero((c[words] > 0) & (every[words] > 1)[:, None])
        b, at = bit[i], node[i]
        one, every_ = ones.sum(axis=1)[at], all_.sum(axis=1)[at]
        x, gate = inputs(one - b, every_ - one - (1 - b), ones[at, s] - b, all_[at, s] - ones[at, s] - (1 - b))
        w = newton_weights(x, gate, b, c[words[i], s], w, curve)
    for words, bit, node, ones, all_ in nodes:
        one, every_ = ones.sum(axis=1)[:, None], all_.sum(axis=1)[:, None]
        x, gate = inputs(np.broadcast_to(one, ones.shape), np.broadcast_to(every_ - one, ones.shape), ones, all_ - ones)
        p = np.clip(squash((w[gate] * x).sum(axis=-1)), 1e-6, 1 - 1e-6)  # (nodes, states)
        cost[words] -= np.log2(np.concatenate([1 - p, p])).take(bit * len(p) + node, axis=0)
    return cost


_ASK = "bucket int, block long, hashes binary, many binary, state binary, n binary, large binary, once binary"
_REPLY = "bucket int, block long, c binary, cost binary"
#: Rows of replies that are no block's: a bucket's sums, and its words seen once.
_SUMS, _ONCE = -1, -2


def _asked(states: States, bits: int):
    """What blocks ask the buckets (the first bits of hashes): hashes in order, the training counts by state, and the words that the block has once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                own = Block(r)
                m = len(own.hashes)
                if not m:
                    continue
                doc = np.repeat(np.arange(len(own.held)), own.counts)
                state = states.before(own.tops(states)[own.codes], doc)
                rank = np.empty(m, np.int64)
                rank[own.order] = np.arange(m)
                n = np.bincount((rank[own.codes] * STATES + state)[~own.held[doc]], minlength=m * STATES)
                at = np.flatnonzero(n)
                once = np.bincount(at // STATES, n[at], m) == 1
                h = own.hashes[own.order]
                cut = np.searchsorted(h >> np.uint64(63 - bits) >> np.uint64(1), np.arange((1 << bits) + 1).astype(np.uint64))
                cell = np.searchsorted(at, cut * STATES)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    x, y = int(cut[k]), int(cut[k + 1])
                    p = at[cell[k] : cell[k + 1]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k], pa.int32()), pa.array([r["block"]]), pa.array([h[x:y].astype("<u8").tobytes()], pa.binary()), pa.array([np.bincount(p // STATES - x, minlength=y - x).astype(np.uint8).tobytes()], pa.binary()),
                        pa.array([(p % STATES).astype(np.uint8).tobytes()], pa.binary()), pa.array([np.minimum(n[p], 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([n[p][n[p] >= 255].astype("<u4").tobytes()], pa.binary()), pa.array([b"\n".join(own.words(own.order[x:y][once[x:y]]))], pa.binary()),
                    ], [f.split()[0] for f in _ASK.split(", ")])

    return run


def _answered(bits: int):
    """A bucket's answers: for each word its count in training and its costs by state (from bit BITS, or the bucket's, on)."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        rows = t.select(["block", "hashes", "many", "state", "n", "large", "once"]).to_pylist()
        rows.sort(key=lambda r: r["block"])
        sizes = np.array([len(r["hashes"]) // 8 for r in rows])
        base = np.cumsum(sizes) - sizes
        distinct, place = np.unique(np.frombuffer(b"".join(r["hashes"] for r in rows), "<u8"), return_inverse=True)
        many = np.frombuffer(b"".join(r["many"] for r in rows), np.uint8)
        at = np.repeat(np.arange(len(many)), many)
        state = np.frombuffer(b"".join(r["state"] for r in rows), np.uint8).astype(np.int64)
        n = np.frombuffer(b"".join(r["n"] for r in rows), np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(b"".join(r["large"] for r in rows), "<u4")
        own = np.bincount(at, n, len(many))  # each block's count of each of its words
        counts = np.bincount(place[at] * STATES + state, n, len(distinct) * STATES).reshape(-1, STATES)
        c = counts.sum(axis=1).astype(np.int64)
        seen = np.flatnonzero(c)
        cost = np.zeros((len(distinct), STATES), np.uint16)
        cost[seen] = np.minimum(np.ceil(hash_costs(distinct[seen], counts[seen], max(bits, BITS)) * STEPS), 65535)
        # words seen once: the bytes come with the block that has the word
        lone, spelled, of = c == 1, [], []
        for r, x, m in zip(rows, base.tolist(), sizes.tolist(), strict=True):
            named = np.flatnonzero(own[x : x + m] == 1)
            words = r["once"].split(b"\n") if len(named) else []
            good = lone[place[x + named]]
            spelled += [w for w, g in zip(words, good.tolist(), strict=True) if g]
            of.append(counts[place[x + named[good]]].argmax(axis=1))
        single = np.bincount(counts[lone].argmax(axis=1), minlength=STATES) if lone.any() else np.zeros(STATES, np.int64)
        sums = np.concatenate([[len(seen)], counts.sum(axis=0), single]).astype("<i8")
        out = [(r["block"], c[place[x : x + m]].astype("<i8").tobytes(), cost[place[x : x + m]].tobytes()) for r, x, m in zip(rows, base.tolist(), sizes.tolist(), strict=True)]
        out.append((_SUMS, sums.tobytes(), b""))
        if spelled:
            out.append((_ONCE, b"\n".join(spelled), np.concatenate(of).astype(np.uint8).tobytes()))
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "block": pa.array([o[0] for o in out], pa.int64()), "c": pa.array([o[1] for o in out], pa.binary()), "cost": pa.array([o[2] for o in out], pa.binary())})

    return run


# --- flags and first bits -------------------------------------------------------------------------------------

#: Kinds of bits: end, repeated, seen, then BITS bits of the hash; the line of a context's table that each kind uses.
END, SAME, SEEN, KINDS = 0, 1, 2, 3 + BITS
_LINE = np.array([0, 1, 2, 3, 3, 3, 3])
#: For each leading half byte of a hash its bits, and their places in a line of 16: a half byte is a tree of 15 nodes.
_BIT = np.array([[0, 0, 0, *(k >> d & 1 for d in (3, 2, 1, 0))] for k in range(1 << BITS)], np.int8)
_SUB = np.array([[1, 2, 3, *(1 << d | k >> (BITS - d) for d in range(BITS))] for k in range(1 << BITS)], np.int64)
CONTEXTS = 5
_PLAIN = (2 * 16, 32 * 16)  # tables of the first two contexts, not hashed


def table_sizes(tokens: int) -> list[int]:
    """Slots of the contexts' tables for so many training tokens: they follow the input up to a fixed bound."""
    bits = int(np.clip(math.ceil(math.log2(max(tokens, 1))) + 1, 14, 21))
    return [*_PLAIN, 1 << bits, 1 << bits, 1 << min(bits, 16)]


class Tokens:
    """Documents of a block as tokens end to end, and what the contexts need of them."""

    def __init__(self, own: Block, docs: np.ndarray, states: States) -> None:
        m, sizes = len(own.hashes), own.counts[docs]
        words = expand(own.codes, own.first[docs], sizes) if len(own.codes) else own.codes
        self.lines: tuple[np.ndarray, list[np.ndarray]] | None = None
        self.sizes = sizes + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.code = np.full(n, m, np.int64)  # m: the end
        is_word = np.ones(n, bool)
        is_word[self.first + sizes] = False
        self.code[is_word] = words
        self.end = ~is_word
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)
        self.pos = np.arange(n) - np.repeat(self.first, self.sizes)
        self.state = states.before(own.tops(states)[self.code], self.doc)
        h = np.append(own.hashes, np.uint64(1))[self.code]
        self.hash, last = h, np.append(own.data[own.ends - 1] if m else np.zeros(0, np.uint8), 0)[self.code]
        self.half = (h >> np.uint64(64 - BITS)).astype(np.int64)
        one = np.concatenate([[np.uint64(2)], h[:-1]])
        one[self.pos < 1] = 2
        two = np.concatenate([[np.uint64(3)] * min(n, 2), h[:-2]])
        two[self.pos < 2] = 3
        self._repeats(one, two)
        self.one, self.pair = one, _mix(one * _A + two)
        self.letter = np.concatenate([[0], last[:-1]]).astype(np.int64)
        self.letter[self.pos < 1] = 0

    def _repeats(self, one: np.ndarray, two: np.ndarray) -> None:
        """pred: where the two words before stood last in the document, -1 if nowhere; hit: whether the same word follows; run: how many tokens before were such."""
        n = len(one)
        at = np.arange(n)
        shift = np.uint64(max(1, int(n).bit_length()))
        key = np.sort((_mix(one * _B + two + self.doc.astype(np.uint64) * _A) >> shift << shift) | at.astype(np.uint64))
        place = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        pred = np.full(n, -1)
        same = key[1:] >> shift == key[:-1] >> shift
        pred[place[1:][same]] = place[:-1][same]
        back = np.maximum(pred, 0)
        pred[(self.pos < 1) | (self.doc[back] != self.doc) | (one[back] != one) | (two[back] != two)] = -1
        self.there = (pred >= 0) & ~self.end
        self.hit = self.there & (self.code[np.maximum(pred, 0)] == self.code)
        miss = np.maximum.accumulate(np.where(self.hit, -1, at))
        self.run = np.where(self.pos > 0, at - 1 - np.concatenate([[0], miss[:-1]]), 0)

    def bits(self, known: np.ndarray | None, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, kind, bit) of all bits that are coded, token by token, in order if that is given. known: whether each token's word is; None: that is left out, as if all were."""
        there = np.zeros((len(self.code), KINDS), bool)
        there[:, END] = True
        there[:, SAME] = self.there
        spelt = ~self.end & ~self.hit
        there[:, SEEN] = asked = spelt & (known is not None)
        there[:, 3:] = (own := spelt if known is None else spelt & known)[:, None]
        many = 1 + self.there.astype(np.int64) + asked + BITS * own.astype(np.int64)
        bit = _BIT.take(self.half, axis=0)
        bit[:, END], bit[:, SAME] = self.end, self.hit
        if known is not None:
            bit[:, SEEN] = known
        if order is not None:
            there, bit, many = there.take(order, axis=0), bit.take(order, axis=0), many.take(order)
        flat = np.flatnonzero(there)
        row = np.repeat(np.arange(len(there)), many)
        return row if order is None else order.take(row), flat - row * KINDS, bit.reshape(-1).take(flat)

    def _lines(self, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the tokens' lines begin in the contexts' tables: of the second context for each of _LINE, of the hashed ones for flags and for words."""
        if self.lines is None:
            place, run = np.minimum(np.frexp(self.pos + 1.0)[1] - 1, 7), np.minimum(self.run, 7)
            hashed = []
            for key, size in zip((self.one, self.pair, _mix((self.letter << 3 | self.state).astype(np.uint64) * _A)), sizes[2:], strict=True):
                mask = np.uint64(size - 16)
                hashed.append(np.concatenate([key & mask, key >> np.uint64(20) & mask]).astype(np.int64))
            self.lines = 16 * np.concatenate([place, 8 + run, 16 + self.state, 24 + self.state]), hashed
        return self.lines

    def slots(self, token: np.ndarray, kind: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
        """For each context the slots of the bits in its table."""
        n, (plain, hashed) = len(self.code), self._lines(sizes)
        sub = _SUB.reshape(-1).take(self.half.take(token) * KINDS + kind)
        word = kind >= 3
        yield word * 16 + sub
        yield plain.take(_LINE.take(kind) * n + token) + sub
        where = word * n + token
        for line in hashed:
            yield line.take(where) + sub


def count_contexts(own: Block, states: States, sizes: list[int], tables: list[np.ndarray]) -> None:
    """Adds the bits of a block's training documents to the tables, flat (slot, bit)."""
    for docs in own.groups(np.flatnonzero(~own.held), LEARNED):
        t = Tokens(own, docs, states)
        token, kind, bit = t.bits(None)
        for table, slot in zip(tables, t.slots(token, kind, sizes), strict=True):
            np.add.at(table, 2 * slot + bit, table.dtype.type(1))


_GATES = KINDS * 9


def _without(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts (slots, 2) less one nought, and less one one; none is taken from none."""
    for bit in (0, 1):
        yield np.maximum(counts[:, 0] - (bit == 0), 0), np.maximum(counts[:, 1] - (bit == 1), 0)


class FirstBits:
    """The mixer of flags and first bits. counts: the contexts' tables (slots, 2). packed: of each slot the prediction and how often it was met; without: the same less a bit of 0, and of 1, for learning only (see teaching)."""

    def __init__(self, counts: list[np.ndarray], weights: np.ndarray, refine: np.ndarray) -> None:
        self.sizes = [len(c) for c in counts]
        self.weights, self.refine = weights.astype(np.float32), refine
        self.packed = [self._pack(c[:, 0], c[:, 1]) for c in counts]
        self.without: list[np.ndarray] = []

    @staticmethod
    def _pack(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        n0, n1 = n0.astype(np.float32), n1.astype(np.float32)
        value = np.rint(np.clip(predicted(n0, n1) * 512, -8191, 8191)).astype(np.int32) + 8192
        met = n0 + n1
        return (value << 2 | (met >= 1).astype(np.int32) + (met >= 8)).astype(np.uint16)

    @classmethod
    def teaching(cls, counts: list[np.ndarray]) -> FirstBits:
        """One that weights are learned with."""
        own = cls(counts, even_weights(_GATES, CONTEXTS + 1), np.tile(_MIDDLES, (KINDS, 1)))
        own.without = [np.stack([cls._pack(*n) for n in _without(c)], axis=1).ravel() for c in counts]
        return own

    def taught(self, weights: np.ndarray, refine: np.ndarray) -> FirstBits:
        """The same tables with what was learned."""
        own = FirstBits([], weights, refine)
        own.sizes, own.packed = self.sizes, self.packed
        return own

    def inputs(self, t: Tokens, token: np.ndarray, kind: np.ndarray, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gates) of bits. less: bits whose own count is taken off."""
        x, gates = _inputs(len(token), CONTEXTS + 1), kind.copy()
        x[:, -1] = 0.3
        for at in range(0, len(token), _SOME):
            part = slice(at, at + _SOME)
            told = np.flatnonzero(kind[part] == SEEN) if less is not None else kind[:0]  # these bits are told by what is left of a word's count
            for k, slot in enumerate(t.slots(token[part], kind[part], self.sizes)):
                if less is None:
                    v = self.packed[k].take(slot)
                else:
                    v = self.without[k].take(2 * slot + less[part])
                    v[told] = self.packed[k].take(slot[told])
                np.multiply(v >> 2, np.float32(1 / 512), out=x[part, k], dtype=np.float32)
                x[part, k] -= 16
                if k in (2, 3):
                    gates[part] += (v & 3).astype(np.int64) * (KINDS * (3 if k == 3 else 1))
        return x, gates

    def log(self, t: Tokens, known: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each document's coded bits. Documents go in step; each corrects its own weights and refinement after every CHUNK tokens by what these were."""
        n, step = len(t.sizes), t.pos // CHUNK
        order = np.argsort(step.astype(np.uint16) if step.max(initial=0) < 1 << 16 else step, kind="stable")
        token, kind, bit = t.bits(known, order)
        x, gate = self.inputs(t, token, kind)
        z0 = weighed(x, gate, self.weights)
        who, step = t.doc.take(token), step.take(token)
        sign = (2 * bit - 1).astype(np.float32)
        key = who * 4 + np.minimum(kind, 3)
        context = kind * 33
        own, lean, total = np.zeros((CONTEXTS + 1, n), np.float32), np.zeros(4 * n, np.float32), np.zeros(n)
        first = np.flatnonzero((np.diff(step, prepend=-1) != 0) | (np.diff(who, prepend=-1) != 0))  # of each document in each step
        edges = np.flatnonzero(np.diff(step[first], prepend=-1))
        first = np.append(first, len(step))
        for u, v in pairwise([*edges.tolist(), len(first) - 1]):
            a, b = int(first[u]), int(first[v])
            lead, many = first[u:v] - a, np.diff(first[u : v + 1])
            live, part, kinds = who[first[u:v]], x[a:b].T, key[a:b]
            moved = _picked(own, who[a:b])
            z = z0[a:b] + np.einsum("ib,ib->b", moved, part)
            z = refined(z, self.refine, context[a:b]) + lean.take(kinds)
            odds = np.exp(-sign[a:b] * np.clip(z, -LIMIT, LIMIT))
            total[live] -= np.add.reduceat(np.log1p(odds), lead)
            lost = sign[a:b] * (odds / (1 + odds))
            np.multiply(lost, part, out=moved)
            own[:, live] += RATE * np.add.reduceat(moved, lead, axis=1) / np.sqrt(many).astype(np.float32)
            lean += REFINE_RATE * (np.bincount(kinds, lost, 4 * n) / np.sqrt(np.maximum(np.bincount(kinds, minlength=4 * n), 1))).astype(np.float32)
        return total


# --- spelling -------------------------------------------------------------------------------------------------

SPELL_TABLES, SPELL_SLOTS, SPELL_GATES = 7, 1 << 18, 9
_SPELL_SIZES = [16 << 13, 1 << 16, *[SPELL_SLOTS] * 5]
#: A byte's bits, and the nodes of its tree that they are coded at.
_BYTE_BITS = np.arange(256)[:, None] >> (7 - np.arange(8)) & 1
_NODES = 1 << np.arange(8) | np.arange(256)[:, None] >> (8 - np.arange(8))


def spell_bits(words: list[bytes], states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots[tables, bits], bit, word) of all words' bytes, each followed by a blank. states: the states before them."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    state = np.repeat(states.astype(np.int64), sizes)
    at = np.arange(len(data))
    before = [np.where(at - k >= first, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3, 4, 5)]
    node = _NODES.take(data, axis=0).ravel()
    place = np.minimum(at - first, 15)
    one = before[0]
    two, three = one << 8 | before[1], (one << 8 | before[1]) << 8 | before[2]
    four = three << 8 | before[3]
    out = np.empty((SPELL_TABLES, 8 * len(data)), np.int32)
    out[0] = np.repeat((place << 5 | state) << 8, 8) | node
    out[1] = np.repeat(one << 8, 8) | node
    keys = (2, two), (3, two << 5 | state), (4, three), (5, three << 5 | state), (6, four << 8 | before[4])
    for x in range(0, 8 * len(data), _SOME):
        part, own = slice(x, x + _SOME), slice(x // 8, (x + _SOME) // 8)
        for k, key in keys:
            mixed = (np.repeat(key[own] << 8, 8) | node[part]).view(np.uint64)
            mixed *= np.uint64(2 * k + 1)
            mixed += np.uint64(k)
            out[k, part] = _mix(mixed) >> np.uint64(46)
    return out, _BYTE_BITS.take(data, axis=0).ravel(), np.repeat(np.arange(len(words)), 8 * sizes)


class Speller:
    """The mixer of the bits of unseen words. counts: the contexts' tables (slots, 2). tables: of each slot the prediction and how often it was met; without: the same less a bit of 0, and of 1."""

    def __init__(self, counts: list[np.ndarray], weights: np.ndarray, refine: np.ndarray) -> None:
        self.weights, self.refine = weights, refine
        counts = [c.astype(np.float32) for c in counts]
        self.tables = [self._told(c[:, 0], c[:, 1]) for c in counts]
        self.without = [tuple(np.stack(v, axis=1).ravel() for v in zip(*(self._told(*n) for n in _without(c)), strict=True)) for c in counts]

    def taught(self, weights: np.ndarray, refine: np.ndarray) -> Speller:
        """The same tables with what was learned."""
        own = Speller([], weights, refine)
        own.tables = self.tables
        return own

    @staticmethod
    def _told(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return predicted(n0, n1), (n0 + n1 >= 2).astype(np.int8) + (n0 + n1 >= 16)

    def inputs(self, slots: np.ndarray, less: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gates). less: bits whose own count is taken off."""
        n = slots.shape[1]
        x, gates = _inputs(n, SPELL_TABLES + 1), np.zeros(n, np.int64)
        x[:, -1] = 0.3
        for at in range(0, n, _SOME):
            part = slice(at, at + _SOME)
            for k in range(SPELL_TABLES):
                own = slots[k, part].astype(np.int64) if less is None else 2 * slots[k, part].astype(np.int64) + less[part]
                value, met = (self.tables if less is None else self.without)[k]
                value.take(own, out=x[part, k], mode="clip")
                if k >= 5:
                    gates[part] = gates[part] * 3 + met.take(own)
        return x, gates

    def log2(self, words: list[bytes], states: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        at = 0
        for part in _some(words):
            at += len(part)
            slots, bit, word = spell_bits(part, states[at - len(part) : at])
            x, gate = self.inputs(slots)
            z = weighed(x, gate, self.weights)
            p = squash(np.clip(refined(z, self.refine, gate * 33), -LIMIT, LIMIT))
            out[at - len(part) : at] = np.bincount(word, np.log2(np.where(bit == 1, p, 1 - p)), len(part))
        return out


def _some(words: list[bytes], most: int = 40_000) -> Iterator[list[bytes]]:
    part, held = [], 0
    for w in words:
        part.append(w)
        held += len(w) + 1
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


# --- the corpus -----------------------------------------------------------------------------------------------


class _Learner:
    """Weights and refinements of a part of the corpus, to be averaged by how often each gate was met."""

    def __init__(self, gates: int, inputs: int, contexts: int) -> None:
        self.w, self.n = even_weights(gates, inputs), np.zeros(gates)
        self.ones, self.all = np.zeros(contexts * 33), np.zeros(contexts * 33)

    def see(self, x: np.ndarray, gate: np.ndarray, context: np.ndarray, bit: np.ndarray) -> None:
        self.w = learn_weights(x, gate, bit, len(self.n), w=self.w)
        self.n += np.bincount(gate, minlength=len(self.n))
        w = self.w.astype(np.float32)
        for at in range(0, len(x), _SOME):
            part = slice(at, at + _SOME)
            key = context[part] * 33 + _bucket(weighed(x[part], gate[part], w))
            n = np.bincount(2 * key + bit[part], minlength=2 * len(self.all)).reshape(-1, 2)
            self.ones += n[:, 1]
            self.all += n.sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        v = np.concatenate([self.n, (self.w * self.n[:, None]).ravel(), self.ones, self.all])
        at = np.flatnonzero(v)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v[at])], ["at", "v"])


def _averaged(rows: DataFrame, gates: int, inputs: int, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refinement) of all learners; the result has a fixed size."""
    v = np.zeros(gates * (1 + inputs) + 2 * contexts * 33)
    for r in rows.groupBy("at").agg(F.sum("v").alias("v")).collect():
        v[r["at"]] = r["v"]
    n, w, ones, all_ = np.split(v, np.cumsum([gates, gates * inputs, contexts * 33]))
    mean = np.where(n[:, None] > 0, w.reshape(gates, inputs) / np.maximum(n, 1)[:, None], even_weights(gates, inputs))
    return np.round(mean, 6), refinement(ones.reshape(contexts, 33), all_.reshape(contexts, 33))


class _Words:
    """What a block's words got from the buckets, in the block's own order of words."""

    def __init__(self, own: Block, r: dict, above: np.ndarray, bits: int) -> None:
        m = len(own.hashes)
        got = sorted(r["answers"] or [], key=lambda x: x["bucket"]) if m else []
        self.count, self.cost = np.zeros(m, np.int64), np.zeros((m + 1, STATES))
        if m:
            self.count[own.order] = np.frombuffer(b"".join(x["c"] for x in got), "<i8")
            self.cost[own.order] = np.frombuffer(b"".join(x["cost"] for x in got), "<u2").reshape(m, STATES) / STEPS
            if len(above):
                self.cost[:m] += above[(own.hashes >> np.uint64(64 - bits)).astype(np.int64)]


def _above(sums: dict[int, np.ndarray], bits: int) -> np.ndarray:
    """Costs by state from bit BITS to a bucket's own, for all buckets; none if buckets are no finer."""
    if bits <= BITS or not sums:
        return np.zeros((0, STATES))
    out = np.zeros((1 << bits, STATES))
    there = np.array(sorted(k for k, v in sums.items() if v[1 : 1 + STATES].any()), np.int64)
    if len(there):
        out[there] = hash_costs(there.astype(np.uint64) << np.uint64(64 - bits), np.array([sums[k][1 : 1 + STATES] for k in there.tolist()]), BITS)
    return out


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score(docs: DataFrame, held: Column, names: int = NAMES) -> DataFrame:
    """docs: (doc_id, text); held: which rows are not learned from. For each row doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams), score (log10 of the model's probability) and bits_per_byte. names: the words that a bucket gets, about. A null text counts as empty: its one token is the end. Ids must be whole numbers; null ids and repeated rows are rows like others; a long text is a block of its own; without training rows the model is its priors; an empty table gives an empty one; other columns, also of clashing names, are not read."""
    with swept(docs.sparkSession):
        return _scores(docs, held, names)


def _scores(docs: DataFrame, held: Column, names: int) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark, size=BATCH)
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    staged = spool(rows.mapInArrow(_blocks, _BLOCK), "lm-blocks")
    size = staged.agg(F.sum("n_words").alias("words"), F.sum("n_train").alias("n"), F.sum("trained").alias("docs")).first()
    trained = size["docs"] or 0
    body = staged.select(*_COLUMNS)

    top = staged.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("t")).groupBy(F.col("t.top_words").alias("w")).agg(F.sum("t.top_counts").alias("n")).orderBy(F.desc("n"), "w").limit(TOPS).collect()
    tops = np.sort(np.array([word_hashes(np.frombuffer(bytes(r["w"]), np.uint8), np.array([0]), np.array([len(r["w"])]))[0] for r in top], np.uint64))
    states = States.learn(tops, _together(staged, tops))

    # the corpus counts of all words, and their costs, brought back to the blocks that hold them
    bits = int(np.clip(math.ceil(math.log2(max(size["words"] or 0, 1) / names)), 0, 16))
    answers = spool(body.mapInArrow(_asked(states, bits), _ASK).groupBy("bucket").applyInArrow(_answered(bits), _REPLY), "lm-answers")
    sums = {r["bucket"]: np.frombuffer(bytes(r["c"]), "<i8") for r in answers.where(F.col("block") == _SUMS).select("bucket", "c").collect()}  # 2^16 rows at most
    total = sum(sums.values(), np.zeros(1 + 2 * STATES, np.int64))
    n_total, v_total = int(total[1 : 1 + STATES].sum()) + trained, int(total[0]) + (trained > 0)
    above = _above(sums, bits)

    sizes = table_sizes(n_total)
    cut = np.cumsum([0, *(2 * s for s in sizes)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(cut[-1], np.int32)
        for b in batches:
            for r in _rows(b):
                count_contexts(Block(r), states, sizes, [flat[x:y] for x, y in pairwise(cut.tolist())])
        yield from _cells(flat)

    flat = _summed(body.mapInArrow(count, _CELLS), int(cut[-1]))
    tables = [flat[x:y].reshape(-1, 2).astype(np.float32) for x, y in pairwise(cut.tolist())]
    every, single = total[1 : 1 + STATES], total[1 + STATES :]
    tables[0][_SUB[0, SEEN]] = [single.sum(), (every - single).sum()]
    for s in range(STATES):
        tables[1][(16 + s) * 16 + _SUB[0, SEEN]] = [single[s], every[s] - single[s]]

    listed = answers.where("block >= 0").select(F.col("block").alias("b"), F.struct("bucket", "c", "cost").alias("a")).groupBy("b").agg(F.collect_list("a").alias("answers"))  # a block's words
    both = body.join(listed, F.col("block") == F.col("b"), "left").drop("b")
    lesson = FirstBits.teaching(tables)
    start = spark.sparkContext.broadcast(lesson)  # tables of bounded size; each is in a file of every executor, until it is destroyed

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _block_rows(b):
                own = Block(r)
                got, learner = _Words(own, r, above, bits), _Learner(_GATES, CONTEXTS + 1, KINDS)
                again = np.append(got.count > 1, False)  # words seen once stand for new ones
                for part in own.groups(np.flatnonzero(~own.held), LEARNED):
                    t = Tokens(own, part, states)
                    token, kind, bit = t.bits(again[t.code])
                    learner.see(*start.value.inputs(t, token, kind, bit), kind, bit)
                yield learner.rows()

    first = lesson.taught(*_averaged(both.mapInArrow(teach, "at int, v double"), _GATES, CONTEXTS + 1, KINDS))

    start.destroy()
    del lesson, start, tables, flat

    once = answers.where(F.col("block") == _ONCE).select("c", "cost")
    spell_cut = np.cumsum([0, *(2 * s for s in _SPELL_SIZES)])

    def singles(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
        for words, of in zip(col(b, "c").to_pylist(), col(b, "cost").to_pylist(), strict=True):
            yield words.split(b"\n"), np.frombuffer(of, np.uint8)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(spell_cut[-1], np.int32)
        for b in batches:
            for words, of in singles(b):
                at = 0
                for part in _some(words):
                    slots, bit, _ = spell_bits(part, of[at : at + len(part)])
                    at += len(part)
                    for x in range(0, len(bit), _SOME):
                        for k in range(SPELL_TABLES):
                            np.add.at(flat[spell_cut[k] : spell_cut[k + 1]], 2 * slots[k, x : x + _SOME] + bit[x : x + _SOME], np.int32(1))
        yield from _cells(flat)

    flat = _summed(once.mapInArrow(spell, _CELLS), int(spell_cut[-1]))
    spelled = [flat[x:y].reshape(-1, 2).astype(np.float32) for x, y in pairwise(spell_cut.tolist())]
    primer = Speller(spelled, even_weights(SPELL_GATES, SPELL_TABLES + 1), np.tile(_MIDDLES, (SPELL_GATES, 1)))
    plain = spark.sparkContext.broadcast(primer)

    def teach_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, of in singles(b):
                learner, at = _Learner(SPELL_GATES, SPELL_TABLES + 1, SPELL_GATES), 0
                for part in _some(words):
                    slots, bit, _ = spell_bits(part, of[at : at + len(part)])
                    at += len(part)
                    x, gate = plain.value.inputs(slots, bit)
                    learner.see(x, gate, gate, bit)
                yield learner.rows()

    speller = primer.taught(*_averaged(once.mapInArrow(teach_spelling, "at int, v double"), SPELL_GATES, SPELL_TABLES + 1, SPELL_GATES))
    plain.destroy()
    model = spark.sparkContext.broadcast((first, speller))  # tables of bounded size
    base = n_total + 0.1 * (v_total + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _block_rows(b):
                own = Block(r)
                got = _Words(own, r, above, bits)
                for part in own.groups(np.arange(len(own.held))):
                    yield _scored(own, got, part, states, *model.value, r["doc_ids"], trained, base, n_total)

    return both.mapInArrow(run, _OUT)


def _block_rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Blocks' rows with the answers to their words."""
    for k, r in enumerate(_rows(b.drop_columns("answers"))):
        yield r | {"answers": col(b, "answers")[k].as_py()}


def _scored(own: Block, got: _Words, docs: np.ndarray, states: States, first: FirstBits, speller: Speller, ids: pa.Array, trained: int, base: float, n_total: int) -> pa.RecordBatch:
    n, t = len(docs), Tokens(own, docs, states)
    count = np.append(got.count, trained)
    known = np.append(got.count > 0, False)[t.code]
    log2 = first.log(t, known) / math.log(2)
    spelt = ~t.end & ~t.hit
    seen = np.flatnonzero(spelt & known)
    log2 -= np.bincount(t.doc[seen], got.cost[t.code[seen], t.state[seen]], n)
    new = np.flatnonzero(spelt & ~known)
    pairs, place = np.unique(t.code[new] * STATES + t.state[new], return_inverse=True)
    log2 += np.bincount(t.doc[new], speller.log2(own.words(pairs // STATES), pairs % STATES)[place], n)
    total = log2 * math.log10(2)
    unigram = np.log10((count + 0.1) / base)
    n_bytes = np.bincount(t.doc, np.append(own.ends - own.starts, 0)[t.code] + ~t.end, n)
    n_known = np.bincount(t.doc, (count > 0)[t.code], n).astype(np.int64)
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(docs)), pa.array(own.held[docs]), pa.array(t.sizes), pa.array(n_known), pa.array(np.full(n, n_total)), pa.array(np.bincount(t.doc, unigram[t.code], n)), pa.array(total), pa.array(-log2 / np.maximum(n_bytes, 1)),
    ], [f.split()[0] for f in _OUT.split(", ")])
