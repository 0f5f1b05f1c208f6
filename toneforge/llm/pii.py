"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

The base patterns are certain and always stay. Beside them, looser generators propose overlapping candidates
(written-out addresses, national telephone numbers, long addresses, keys and passwords). Trees over the format and
the context of a candidate give its probability; Platt scaling on held-out candidates calibrates it; a kind's
threshold is the least probability at which held-out precision reaches PRECISION. The trees are trained on the
driver on candidates written by a seeded generator, never on the corpus, so results don't depend on the input.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boost
from .common import blocks, col, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
PRECISION = 0.98
TRAIN_ROWS = 6000

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SEPARATORS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, in linear time: a match's local part reaches back to the last match, or to a character it can't hold."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def _octet(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as in BASE_KINDS, then by start. Code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    first = _DIGIT.search(text)
    if first is None:
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in _IP.finditer(text, first.start()) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text, first.start()):
        if m.end() - m.start() >= 13:
            digits = m[0].translate(_SEPARATORS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(m[0].translate(_SEPARATORS)) <= 15]
    return found


# --- candidates beyond the base patterns ----------------------------------------------------------------------

_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]++(?: ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) )[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{2,}+)++")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
_TRUNK = re.compile(r"(?<![0-9A-Za-z.+-])00?[1-9][0-9]?(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9A-Za-z])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._-]?[0-9]){11,18}(?![0-9A-Za-z])")
_PLAIN = re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")
_SECRET = re.compile(r"[=:][ \t]{0,3}[\"']?([A-Za-z0-9_+/.-]{8,})")
_CUES = {
    "secret": re.compile(r"(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth)[\"']?\s{0,3}$", re.I),
    "phone": re.compile(r"(?:phone|tel|call|mobile|cell|fax|telefon|t[eé]l[eé]fono|whatsapp)\W{0,4}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|credit|karte|tarjeta|carte)\W{0,4}$", re.I),
    "email": re.compile(r"(?:mail|contact|write|reach)\W{0,4}$", re.I),
    "ip": re.compile(r"(?:ip|host|server|address)\W{0,4}$", re.I),
    "other": re.compile(r"(?:order|invoice|no|nr|number|version|isbn|ref|page|item|sku|id|total|year|price)\W{0,4}$", re.I),
}


def candidates(text: str) -> list[Span]:
    found: list[Span] = []
    low = "at" in text or "AT" in text
    if low and ("dot" in text or "DOT" in text or "(at" in text or "[at" in text or "{at" in text or "( at" in text or "[ at" in text):
        found += [("email", *m.span()) for m in _around(text, _WRITTEN)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
        if ":" in text:
            found += [("ip", *m.span()) for m in _LONG_IP.finditer(text)]
    if (first := _DIGIT.search(text)) is not None:
        at = max(0, first.start() - 1)
        found += [("phone", *m.span()) for p in (_NATIONAL, _TRUNK) for m in p.finditer(text, at)]
        found += [("card", *m.span()) for p in (_PLAIN, _RUN) for m in p.finditer(text, at)]
    return found


_AT = re.compile(r"[\[({] ?(?:at|AT)| (?:at|AT) ")


def _around(text: str, pattern: re.Pattern) -> Iterator[re.Match]:
    """Matches of pattern that hold an _AT, from the first character of the local part before it on. Each character is passed by once for an _AT."""
    floor = 0
    for hit in _AT.finditer(text):
        if hit.start() < floor:
            continue
        start = hit.start() - (text[hit.start() - 1 : hit.start()] == " " and hit.start() > floor)
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if m := pattern.match(text, start):
            yield m
            floor = m.end()


def describe(text: str, span: Span) -> list[float]:
    """Features of a candidate's format and context."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 24) : a], text[b : b + 4]
    digits = "".join(c for c in s if c in "0123456789")
    n, d = len(s), len(digits)
    letters = sum(c.isalpha() for c in s)
    counts = [s.count(c) for c in set(s)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    groups = re.split(r"[^0-9]+", s.strip("()[]"))
    cue = [float(bool(p.search(left))) for p in _CUES.values()]
    return [
        *(float(kind == k) for k in KINDS), float(n), float(d), float(letters), d / n, entropy, float(len(set(digits))),
        float(d >= 12 and luhn(digits)), float(len(groups)), float(max(map(len, groups))), float(s[:1] == "("), float(s[:1] == "0"),
        float(bool(re.search(r"[\[({] ?(?:at|AT)", s))), float(bool(re.search(r"dot|DOT", s))), float(any(c.isupper() for c in s)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(right[:1].isalnum()), float(left[-1:].isalnum()), float(re.sub(r"^.*[^A-Za-z]", "", s).lower() in _ENDINGS), *cue,
    ]


#: Common last labels of host names.
_ENDINGS = frozenset("com org net edu gov io de fr es uk info eu ch at".split())


@dataclass
class Model:
    trees: boost.Trees
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.offset, -35, 35)))


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _written(rng: np.random.Generator) -> tuple[str, Span, int]:
    """A text, a candidate in it and whether it is personal data."""

    def word(a: int = 3, b: int = 9) -> str:
        return "".join("abcdefghilmnoprstuv"[k] for k in rng.integers(0, 19, rng.integers(a, b)))

    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def pick(*xs: str) -> str:
        return xs[rng.integers(0, len(xs))]

    good = int(rng.random() < 0.5)
    kind = KINDS[rng.integers(0, len(KINDS))]
    cue, after = pick(word(), word(), word() + ","), pick(" ", ". ", ", ") + word()
    if kind == "email":
        if good:
            o, c = pick("()", "[]", "{}")
            s = f"{word()}{pick('.', '_', '')}{num(2)} {o}at{c} {word()} {o}dot{c} {pick('com', 'org', 'net', 'de', 'fr')}" if rng.random() < 0.6 else f"{word()}.{word()} at {word()} dot {pick('com', 'org', 'net', 'io')}"
            cue = pick("mail", "contact:", cue)
        else:
            s = f"{word()} at {word()}.{word()}" if rng.random() < 0.6 else f"{word()} at {word()} dot {word()}"
    elif kind == "ip":
        s = ":".join("%x" % k for k in rng.integers(0, 65536, 8)) if good else ":".join(f"{k:02d}" for k in rng.integers(0, 60, 8))
    elif kind == "card":
        body = pick("4", "51", "37", "6011")
        body += num(15 - len(body))
        check = next(c for c in "0123456789" if luhn(body + c))
        digits = body + check if good else body + str((int(check) + rng.integers(1, 10)) % 10)
        sep = pick("", " ", "-", ".", "_")
        s = sep.join(digits[k : k + 4] for k in range(0, 16, 4))
        cue = pick("card", "visa", cue) if good else pick("order", "ref", cue)
    elif kind == "phone":
        if good:
            s = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{rng.integers(1, 99)} {num(3)} {num(3)} {num(3)}", f"0{rng.integers(1, 9)} {num(2)} {num(2)} {num(2)} {num(2)}")
            cue = pick("phone", "tel:", "call", "mobile", "fax", cue)
        else:
            s = pick(f"{num(3)} {num(3)} {num(4)}", f"0{num(1)}{num(4)}{num(4)}{num(3)}", f"00{rng.integers(1, 9)}{num(9)}")
            cue = pick("order", "isbn", "ref", "invoice no", "version", "total", word())
    else:
        if good:
            s = pick("".join("0123456789abcdef"[k] for k in rng.integers(0, 16, rng.integers(12, 40))), "".join(_ALNUM[k] for k in rng.integers(0, len(_ALNUM), rng.integers(10, 40))))
            cue = pick("password", "token", "secret", "api_key", "passwd", "access key")
        else:
            s, cue = pick(word(8, 14), num(9), f"{word()}-{word()}.{word()}", f"{num(4)}-{num(2)}-{num(2)}"), pick(word(), word(), "total", "page", "ref", "token" if rng.random() < 0.3 else word())
        mark, quote = pick("=", " = ", ": "), pick("", '"')
        lead = f"{word()} {cue}{mark}{quote}"
        return lead + s + quote + after, ("secret", len(lead), len(lead) + len(s)), good
    lead = f"{word()} {word()} {cue} "
    return lead + s + after, (kind, len(lead), len(lead) + len(s)), good


def train(rows: int = TRAIN_ROWS, seed: int = 11) -> Model:
    """On rows candidates written by a seeded generator; a third of them calibrates."""
    rng = np.random.default_rng(seed)
    made = [_written(rng) for _ in range(rows)]
    x = np.array([describe(t, s) for t, s, _ in made])
    y = np.array([g for _, _, g in made])
    kinds = np.array([s[0] for _, s, _ in made])
    held = np.arange(rows) % 3 == 0
    trees = boost.fit(x[~held], y[~held])
    z, t = trees.margin(x[held]), y[held]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two numbers of Platt scaling
        p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - t) * z).sum() + 1e-2 * (slope - 1), (p - t).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        slope, offset = np.array([slope, offset]) - np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
    model = Model(trees, float(slope), float(offset), {})
    p = model.probability(x[held])
    for kind in KINDS:
        own = kinds[held] == kind
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(t[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return model


class _Taken:
    """Which code points of a text are taken: a byte for each, so that a span is looked up in its own length, however many spans there are."""

    def __init__(self, n: int) -> None:
        self.mark = bytearray(n)

    def add(self, a: int, b: int) -> None:
        self.mark[a:b] = b"\1" * (b - a)

    def meets(self, a: int, b: int) -> bool:
        return self.mark.find(1, a, b) >= 0

    def outside(self, span: Span) -> list[Span]:
        """The parts of span that are free."""
        kind, at, end = span
        parts = []
        while (at := self.mark.find(0, at, end)) >= 0:
            stop = self.mark.find(1, at, end)
            stop = end if stop < 0 else stop
            parts.append((kind, at, stop))
            at = stop
        return parts


def spans_of(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: base spans and the added ones, which overlap none of a higher probability and no base span; by kind as in KINDS, then start. Of a secret that others overlap, the parts outside of them are added."""
    base, proposed, rows = [], [], []
    taken: dict[int, _Taken] = {}
    for k, text in enumerate(texts):
        own = base_spans(text)
        base.append(own)
        if not (more := dict.fromkeys(candidates(text))):
            continue
        mine = taken[k] = _Taken(len(text))
        for _, a, b in own:
            mine.add(a, b)
        for c in more:
            if mine.outside(c) if c[0] == "secret" else not mine.meets(c[1], c[2]):
                proposed.append((k, c))
                rows.append(describe(text, c))
    added: dict[int, list[Span]] = {}
    if rows:
        p = model.probability(np.array(rows))
        for i in sorted(range(len(rows)), key=lambda i: (proposed[i][0], -p[i], proposed[i][1][1], -proposed[i][1][2])):
            k, c = proposed[i]
            if p[i] < model.thresholds[c[0]]:
                continue
            free = taken[k].outside(c)
            if c[0] != "secret" and free != [c]:
                continue
            added.setdefault(k, []).extend(free)
            taken[k].add(c[1], c[2])
    order = {kind: k for k, kind in enumerate(KINDS)}
    return [(own, sorted([*own, *added.get(k, ())], key=lambda s: (order[s[0]], s[1]))) for k, own in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans for each row; a null text counts as empty, repeated rows and null ids are kept, an empty table gives an empty one. Other columns are not read."""
    small_batches(docs.sparkSession)
    model = model or train()
    names = [f"n_{k}" for k in BASE_KINDS]
    schema = docs.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = spans_of([t or "" for t in col(b, "text").to_pylist()], model)
            counts = [pa.array([sum(s[0] == kind for s in own) for own, _ in found], pa.int64()) for kind in BASE_KINDS]
            sha = pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([col(b, "doc_id"), *counts, sha, pa.array([written(s) for _, s in found], pa.string())], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redacted(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """docs with its texts redacted; all columns, also of clashing names, as they were. A null text stays null, an empty one empty; repeated rows and null ids are rows like others, an empty table gives an empty one, long texts are read whole."""
    small_batches(docs.sparkSession)
    model = model or train()
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema.names.index(text)
        for b in blocks(batches, text):
            raw = b.column(at).to_pylist()
            found = spans_of([t or "" for t in raw], model)
            new = pa.array([t if t is None else redact(t, s) for t, (_, s) in zip(raw, found, strict=True)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(run, schema)
