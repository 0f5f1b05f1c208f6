"""Byte-level BPE over whole texts with the tokenizers library.

A text is cut where no pre-token of the vocabulary's pattern can reach across: before white space that follows
other characters, and between letters, numbers and the rest. The library encodes each distinct piece once; ids of
a text are those of its pieces. Pieces around an apostrophe stay whole (contractions), and a text that holds an
added token is encoded in one go.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

from .common import coded, expand

#: Entries of each of a process's two tables of pieces: a full one becomes the old one, whose entries move over when met again.
TABLE_ROWS = 600_000

_UNSEEN, _SPACE, _LETTER, _NUMBER, _REST, _JOINT = range(6)
_WHITE = frozenset([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_kind = np.zeros(0x110000, np.uint8)


def _look_up(points: np.ndarray) -> None:
    for p in points.tolist():
        major = unicodedata.category(chr(p))[0]
        _kind[p] = _SPACE if p in _WHITE else _JOINT if p == 39 else _LETTER if major == "L" else _NUMBER if major == "N" else _REST


def _edges() -> np.ndarray:
    """Whether a piece starts between two kinds, at 8 * former + latter."""
    table = np.zeros(64, bool)
    solid = (_LETTER, _NUMBER, _REST, _JOINT)
    for a in solid:
        table[8 * a + _SPACE] = True
        for b in solid:
            table[8 * a + b] = a != b and _JOINT not in (a, b)
    return table


_EDGE = _edges()


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which pieces start, and the end. Every row starts a piece."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _kind[points]
    if not kind.all():
        _look_up(np.unique(points[kind == _UNSEEN]))
        kind = _kind[points]
    edge = _EDGE[kind[:-1] << 3 | kind[1:]]
    start = np.zeros(len(data) + 1, bool)
    if len(points) == len(data):
        start[1:-1] = edge
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        start[lead[1:][edge]] = True
    start[off] = True
    return np.flatnonzero(start)


#: Pieces that the library gets at once.
RUN = 4096
_BLANKS, _SOLID, _LEADS = frozenset(b" \t\n\v\f\r"), frozenset(range(33, 127)), frozenset(range(0xC3, 0xD0))


def _joins(piece: bytes) -> bool:
    """Whether a piece starts with white space and ends without, for sure: so no pre-token reaches over its ends where such pieces stand side by side."""
    return piece[0] in _BLANKS and (piece[-1] in _SOLID or len(piece) > 2 and piece[-2] in _LEADS)


class Encoder:
    """ids of texts, as uint32. One per process and vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # a byte-level token has a character for each byte
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.size = np.array([len(t) for t in tokens], np.int64) if "Ġ" in tokens and "Ċ" in tokens else None
        self.table: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _joined(self, pieces: list[bytes]) -> list[bytes] | None:
        """The ids of pieces that start with white space and end without, from one text of them all. Where the vocabulary's tokens don't tell which bytes they stand for, or don't end with the pieces: None."""
        if self.size is None:
            return None
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        total = np.cumsum(self.size[ids])
        at = np.searchsorted(total, ends)
        if len(total) != at[-1] + 1 or (total[at] != ends).any():
            return None
        raw, cut = ids.tobytes(), ((at + 1) * self.kind.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.table) > TABLE_ROWS:
            self.table, self.old = {}, self.table
        table, old = self.table, self.old
        found = list(map(table.get, pieces))
        missing = [k for k, f in enumerate(found) if f is None]
        if old and missing:
            for k, f in zip(missing, [old.get(pieces[k]) for k in missing], strict=True):
                if f is not None:
                    found[k] = table[pieces[k]] = f
            missing = [k for k in missing if found[k] is None]
        code = "H" if self.kind.itemsize == 2 else "I"
        run, rest = [], []
        for k in missing:
            (run if _joins(pieces[k]) else rest).append(k)
        for at in range(0, len(run), RUN):
            part = run[at : at + RUN]
            ids = self._joined([pieces[k] for k in part])
            if ids is None:
                rest += part
                continue
            for k, e in zip(part, ids, strict=True):
                found[k] = table[pieces[k]] = e
        for at in range(0, len(rest), RUN):
            part = rest[at : at + RUN]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pieces[k].decode() for k in part], add_special_tokens=False), strict=True):
                found[k] = table[pieces[k]] = array(code, e.ids).tobytes()
        return found

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids end to end, and the number of ids of each row."""
        rows = len(off) - 1
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            got = [np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, self.kind) if any(t in raw[a:b] for t in self.added) else self._plain(data[a:b], np.array([0, b - a]))[0] for a, b in zip(off[:-1], off[1:], strict=True)]
            return np.concatenate([np.zeros(0, self.kind), *got]), np.array([len(g) for g in got], np.int64)
        return self._plain(data, off)

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64)
        cut = cuts(data, off)
        pieces = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        codes, distinct = coded(pieces)
        found = self._pieces(distinct.to_pylist())
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        first = np.cumsum(sizes) - sizes
        ids = expand(flat, first[codes], sizes[codes])
        before = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids, np.diff(before[np.searchsorted(cut, off)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
