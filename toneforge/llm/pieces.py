"""SentencePiece encoding and decoding by suffix-array matching.

A text, with its blanks written as U+2581 and one put before it, falls apart into words: no piece has a blank
after another character. The distinct words of a batch are put end to end and their suffixes sorted by as many
characters as the longest piece has. A binary search finds every piece's range of suffixes, and each of them is an
edge from a start to an end. The edges are sorted by their end's place in its word and relaxed place by place.

The model merges by rank, so the path wanted is not the one of the best sum. It is the one on which each two
neighbours, merged alone, stay as they are: a prefix of a word has exactly one last piece for which that holds
with the last piece of what stands before it. Relaxing keeps that piece. A character without a piece is an edge of
its own and comes out as its UTF-8 bytes' pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, coded, col, expand, small_batches, text_bytes

BLANK = "▁"
#: Bytes of distinct words that are matched at once, and that a process's table of words holds, with their ids; it is emptied when full.
MATCH_BYTES, TABLE_BYTES = 400_000, 48 << 20
#: Words of over so many characters (text without blanks) are matched a stretch at a time, and not kept.
LONG = 4000
BLOCK = 4 << 20
_LONE = 1 << 17  # token numbers from here on are characters without a piece


def _blanked(word: bytes) -> str:
    return word.decode().replace(" ", BLANK)


class Pieces:
    """Encodes and decodes with one model file. One per process. A model with a piece of over 16 characters, with a blank after another character in a piece, or with over 65,000 characters in its pieces raises ValueError."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.piece = {i: model.id_to_piece(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.piece.values()):
            raise ValueError("a piece has a blank after another character")
        self.rank = {p: -model.get_score(i) for i, p in self.piece.items()}
        self.id_of = {p: i for i, p in self.piece.items()}
        self.longest = max(map(len, self.piece.values()))
        if self.longest > 16:
            raise ValueError("a piece has over 16 characters")
        self.bytes_of = [self.piece[i].encode() if i in self.piece else b"" for i in range(n)]
        for value, i in self.byte_id.items():
            self.bytes_of[i] = bytes([value])
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.piece.values()]
        self.ids = np.array(plain, np.int32)
        self.lengths = np.array([len(p) for p in points], np.int32)
        self.points = np.zeros((len(points), 16), np.uint32)
        for k, p in enumerate(points):
            self.points[k, : len(p)] = p
        self.alphabet = np.unique(self.points[self.points > 0])
        if len(self.alphabet) > 65_000:
            raise ValueError("the pieces have over 65,000 different characters")
        self.codes = np.where(np.arange(16) < self.lengths[:, None], np.searchsorted(self.alphabet, self.points) + 1, 0).astype(np.uint64)
        self.table: dict[bytes, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}
        self.known_keys, self.known = np.zeros(0, np.int64), np.zeros(0, bool)

    # --- encoding ---------------------------------------------------------------------------------------------

    def _text(self, token: int) -> str:
        return chr(token - _LONE) if token >= _LONE else self.piece[token]

    def _stay(self, a: int, b: int) -> bool:
        """Whether the pieces a and b, merged alone from their characters, stay as they are."""
        left, right, rank = self._text(a), self._text(b), self.rank
        parts = [*left, *right]
        ranks = [rank.get(parts[k] + parts[k + 1]) for k in range(len(parts) - 1)]
        border = len(left) - 1  # the pair over the border, as an index into ranks
        while True:
            best, at = None, -1
            for k, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return parts == [left, right]
            if at == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < border:
                border -= 1
            if at > 0:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1])

    def _edges(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every occurrence of every piece in points, where 0 parts words."""
        # characters that no piece has are one code, which no piece has either
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        x = np.where(self.alphabet[at] == points, at + 1, len(self.alphabet) + 1).astype(np.uint64)
        n = len(x)
        occurs = np.zeros(len(self.alphabet) + 2, bool)
        occurs[0] = True
        occurs[x.astype(np.int64)] = True
        x = np.concatenate([x, np.zeros(16, np.uint64)])
        bits = np.uint64(16)
        four = x[: n + 13] << (bits * np.uint64(3)) | x[1 : n + 14] << (bits * np.uint64(2)) | x[2 : n + 15] << bits | x[3 : n + 16]
        keys = [four[k : k + n] for k in (0, 4, 8, 12)]
        order = np.lexsort(keys[::-1]).astype(np.int32)
        # pieces whose characters all occur
        use = np.flatnonzero(occurs[self.codes.astype(np.int64)].all(axis=1))
        chars, inside = self.codes[use], np.arange(16) < self.lengths[use, None]
        low, high = self._packed(chars), self._packed(np.where(inside, chars, np.uint64(0xFFFF)))
        first, last = self._search(keys, order, low, False), self._search(keys, order, high, True)
        count = last - first
        hit = np.flatnonzero(count > 0)
        start = expand(order, first[hit], count[hit])
        return start, np.repeat(self.lengths[use[hit]], count[hit]), np.repeat(self.ids[use[hit]], count[hit])

    @staticmethod
    def _packed(chars: np.ndarray) -> list[np.ndarray]:
        return [chars[:, k] << np.uint64(48) | chars[:, k + 1] << np.uint64(32) | chars[:, k + 2] << np.uint64(16) | chars[:, k + 3] for k in (0, 4, 8, 12)]

    @staticmethod
    def _search(keys: list[np.ndarray], order: np.ndarray, want: list[np.ndarray], right: bool) -> np.ndarray:
        """For each wanted key the number of suffixes below it (right: below or equal), by binary search."""
        low, high = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            below, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, want, strict=True):
                below |= same & (k[at] < w)
                same &= k[at] == w
            go = open_ & (below | (same if right else False))
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low

    def _staying(self, before: np.ndarray, token: np.ndarray, new: dict[int, bool]) -> np.ndarray:
        key = before.astype(np.int64) << 21 | token
        at = np.searchsorted(self.known_keys, key)
        at_ = np.minimum(at, max(len(self.known_keys) - 1, 0))
        seen = self.known_keys[at_] == key if len(self.known_keys) else np.zeros(len(key), bool)
        out = self.known[at_] & seen if len(self.known_keys) else np.zeros(len(key), bool)
        if not seen.all():
            fresh, back = np.unique(key[~seen], return_inverse=True)
            got = np.empty(len(fresh), bool)
            for k, pair in enumerate(fresh.tolist()):
                good = new.get(pair)
                if good is None:
                    good = new[pair] = self._stay(pair >> 21, pair & 0x1FFFFF)
                got[k] = good
            out[~seen] = got[back]
        return out

    def _match(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        text = "\0".join(words) + "\0" if "\0" not in "".join(words) else None
        if text is None:  # U+0000 can't part words that hold it; it stands for itself by a character that no text has
            text = "\0".join(w.replace("\0", "\udfff") for w in words) + "\0"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in words], np.int32)
        begin = np.cumsum(length + 1, dtype=np.int32) - (length + 1)
        base = np.repeat(begin, length + 1)
        start, size, token = self._edges(points)
        alone = np.flatnonzero(points != 0).astype(np.int32)
        single = np.zeros(len(points), bool)
        single[start[size == 1]] = True
        alone = alone[~single[alone]]
        start, size = np.concatenate([start, alone]), np.concatenate([size, np.ones(len(alone), np.int32)])
        token = np.concatenate([token, np.where(points[alone] == 0xDFFF, 0, points[alone]).astype(np.int32) + _LONE])
        place = start + size - base[start]
        order = np.argsort(place, kind="stable")
        start, size, token, place = start[order], size[order], token[order], place[order]
        del order, alone, single
        last = np.full(len(points) + 1, -1, np.int32)
        came = np.zeros(len(points) + 1, np.int32)
        steps = np.searchsorted(place, np.arange(1, int(length.max(initial=0)) + 2))
        new: dict[int, bool] = {}
        for k in range(len(steps) - 1):
            a, b = steps[k], steps[k + 1]
            s, t = start[a:b], token[a:b]
            end = s + size[a:b]
            before = last[s]
            first = s == base[s]
            good = first & self._whole(t)
            rest = np.flatnonzero(~first & (before >= 0))
            if len(rest):
                good[rest] = self._staying(before[rest], t[rest], new)
            last[end[good]] = t[good]
            came[end[good]] = s[good]
        if new:
            keys = np.array(list(new), np.int64)
            vals = np.array(list(new.values()), bool)
            if len(self.known_keys) > 2_000_000:
                self.known_keys, self.known = keys[:0], vals[:0]
            keys, vals = np.concatenate([self.known_keys, keys]), np.concatenate([self.known, vals])
            order = np.argsort(keys)
            self.known_keys, self.known = keys[order], vals[order]
        # back from every word's end
        at, word = begin + length, np.arange(len(words))
        found, of = [], []
        while len(at):
            live = at > begin[word]
            at, word = at[live], word[live]
            if len(at):
                found.append(last[at])
                of.append(word)
                at = came[at]
        if not found:
            return [b""] * len(words)
        found, of = np.concatenate(found)[::-1], np.concatenate(of)[::-1]
        order = np.argsort(of, kind="stable")
        found, of = found[order], of[order]
        if (found < 0).any():
            raise RuntimeError("a word has no path")
        lone = np.flatnonzero(found >= _LONE)
        if len(lone):
            spelled = [[self.byte_id[v] for v in chr(p).encode()] for p in (found[lone] - _LONE).tolist()]
            reps = np.ones(len(found), np.int64)
            reps[lone] = [len(s) for s in spelled]
            at = np.cumsum(reps) - reps
            of, found = np.repeat(of, reps), np.repeat(found, reps)
            for k, s in zip(at[lone].tolist(), spelled, strict=True):
                found[k : k + len(s)] = s
        raw = found.astype("<u4").tobytes()
        end = np.searchsorted(of, np.arange(len(words) + 1)) * 4
        return [raw[a:b] for a, b in zip(end[:-1].tolist(), end[1:].tolist(), strict=True)]

    def _match_long(self, word: str) -> bytes:
        """The ids of one long word. Edges are found a stretch at a time, with as much beyond it as the longest piece has, and relaxed from each start on: what ends there has started before."""
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        n, whole = len(points), self._whole(np.arange(self.size)).tolist()
        last, came = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
        pairs = self.pairs
        for at in range(0, n, MATCH_BYTES):
            start, size, token = self._edges(points[at : at + MATCH_BYTES + 15])
            start = start + at
            own = start < at + MATCH_BYTES
            start, size, token = start[own], size[own], token[own]
            end = min(n, at + MATCH_BYTES)
            single = np.zeros(end - at, bool)
            single[start[size == 1] - at] = True
            alone = np.flatnonzero(~single) + at
            start, size = np.concatenate([start, alone]), np.concatenate([size, np.ones(len(alone), np.int64)])
            token = np.concatenate([token, points[alone].astype(np.int64) + _LONE])
            order = np.argsort(start, kind="stable")
            for s, m, t in zip(start[order].tolist(), size[order].tolist(), token[order].tolist(), strict=True):
                if s == 0:
                    good = t >= _LONE or whole[t]
                elif (before := int(last[s])) < 0:
                    continue
                elif (good := pairs.get(key := before << 21 | t)) is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    good = pairs[key] = self._stay(before, t)
                if good:
                    last[s + m], came[s + m] = t, s
        out, at = [], n
        while at > 0:
            if (t := int(last[at])) < 0:
                raise RuntimeError("a word has no path")
            out.extend([t] if t < _LONE else [self.byte_id[v] for v in reversed(chr(t - _LONE).encode())])
            at = int(came[at])
        return np.array(out[::-1], "<u4").tobytes()

    def _whole(self, token: np.ndarray) -> np.ndarray:
        """Whether a piece, merged from its characters, is that piece."""
        if not hasattr(self, "_reached"):
            self._reached = np.ones(self.size, bool)
            for i, p in self.piece.items():
                self._reached[i] = self._merged(p) == [p]
        return self._reached[np.minimum(token, self.size - 1)] | (token >= _LONE)

    def _merged(self, text: str) -> list[str]:
        """Merging as the model defines it: the pair of the best rank first, the leftmost of equals."""
        parts = list(text)
        while True:
            ranks = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1])) is not None]
            if not ranks:
                return parts
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids end to end, and the number of ids of each row. An empty text has none."""
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        # a word starts at a blank after another character, and with each row
        raw = data.tobytes()
        if b"\xe2\x96\x81" in raw:  # a written U+2581 is a blank too
            parts = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            data = np.frombuffer(b"".join(parts), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        blank = data == 32
        new = np.zeros(len(data), bool)
        new[1:] = blank[1:] & ~blank[:-1]
        row_start = off[:-1][np.diff(off) > 0]
        new[row_start] = True
        cut = np.append(np.flatnonzero(new), len(data))
        words = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        codes, distinct = coded(words)
        codes = codes.astype(np.int64)
        values = distinct.to_pylist()
        # a row's first word has one more blank before it
        lead = np.searchsorted(cut, row_start)
        firsts, back = np.unique(codes[lead], return_inverse=True)
        codes[lead] = len(values) + back
        values += [b" " + values[k] for k in firsts.tolist()]
        found = self._words(values)
        flat = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        ids = expand(flat, first[codes], sizes[codes])
        before = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids, np.diff(before[np.searchsorted(cut, off)])

    def _words(self, values: list[bytes]) -> list[bytes]:
        if self.held > TABLE_BYTES:
            self.table, self.held = {}, 0
        table, long, part, held = self.table, {}, [], 0
        for v in dict.fromkeys(values):
            if v in table:
                continue
            if len(v) > LONG:
                long[v] = self._match_long(_blanked(v))
                continue
            part.append(v)
            held += len(v) + 1
            if held > MATCH_BYTES:
                self._fill(part)
                part, held = [], 0
        if part:
            self._fill(part)
        return [table[v] if v in table else long[v] for v in values]

    def _fill(self, part: list[bytes]) -> None:
        found = self._match([_blanked(v) for v in part])
        self.table.update(zip(part, found, strict=True))
        self.held += sum(map(len, part)) + sum(map(len, found)) + 100 * len(part)

    # --- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids that stand for no text add none, bytes that are no UTF-8 come out as U+FFFD."""
        table = self.bytes_of
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, ids (array of int), n_ids, and round_trip: whether the ids decode to the text again, with U+2581 read as a blank. A null text counts as empty and has no ids; nulls in other columns, repeated rows and empty tables pass through."""
    small_batches(docs.sparkSession)
    names = [*keep, "n_ids", "round_trip", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for b in blocks(batches, text, BLOCK):
            data, off = text_bytes(col(b, text))
            ids, counts = own.encode(data, off)
            ends = np.concatenate([[0], np.cumsum(counts)])
            raw = data.tobytes()
            same = [own.decode(ids[x:y]) == raw[i:j].decode().replace(BLANK, " ") for x, y, i, j in zip(ends[:-1], ends[1:], off[:-1], off[1:], strict=True)]
            arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), pa.array(counts), pa.array(same, pa.bool_()), arrays], names)

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields), "n_ids long", "round_trip boolean", "ids array<int>"])
    return docs.select(*dict.fromkeys((*keep, text))).mapInArrow(run, fields)


def decode(rows: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """keep's columns and the text of ids; null ids give a null text, no ids an empty one; repeated rows and empty tables pass through, other columns are not read."""
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(model)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in col(b, ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(col(b, c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.select(*dict.fromkeys((*keep, ids))).mapInArrow(run, fields)
