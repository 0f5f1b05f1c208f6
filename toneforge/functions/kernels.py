"""Text kernels: pure functions of one string, wrapped for columns in toneforge.functions.text.

A unit is a composed character with the marks after it. A syllable is a longest run of letter units.
"""

from __future__ import annotations

import difflib
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache

from .marks import LETTERS, MARKS, STROKED, TONES, UNDECIDED

nfc = lru_cache(1 << 14)(lambda s: unicodedata.normalize("NFC", s))


def nfd(text: str) -> str:
    return unicodedata.normalize("NFD", text)


class Unit:
    """head: the letter without marks. marks: all combining marks, in canonical order. What follows from the two is worked out once."""

    __slots__ = ("anomalies", "base", "head", "letter", "marks", "others", "shapes", "state", "text", "tone", "tones")

    def __init__(self, head: str, marks: str) -> None:
        self.head, self.marks = head, marks
        self.letter = bool(head) and nfd(head)[0].isalpha()
        self.tones = "".join(m for m in marks if m in TONES)
        self.shapes = "".join(m for m in marks if m in LETTERS)
        self.others = "".join(m for m in marks if m not in MARKS)
        self.text = unicodedata.normalize("NFC", head + marks)
        self.base = unicodedata.normalize("NFC", STROKED.get(head, head) + self.others)
        self.state = "NA" if not self.letter else "STROKE" if head in STROKED else LETTERS[self.shapes[0]] if self.shapes else "NONE"
        self.tone = TONES[self.tones[0]] if self.tones else "UNMARKED"
        flags = {
            "UNSUPPORTED_COMBINING_MARK": self.others or (self.shapes and not self.letter),
            "MULTIPLE_TONE_MARKS": len(self.tones) > 1,
            "MULTIPLE_LETTER_DIACRITICS": len(self.shapes) > 1,
            "TONE_MARK_ON_NON_LETTER": self.tones and not self.letter,
        }
        self.anomalies = [name for name, there in flags.items() if there]


unit = lru_cache(1 << 14)(Unit)


@lru_cache(1 << 14)
def _parted(ch: str) -> tuple[str, str]:
    """A composed character's head and marks."""
    parts = nfd(ch)
    split = next((k for k, c in enumerate(parts) if unicodedata.combining(c)), len(parts))
    return unicodedata.normalize("NFC", parts[:split]), parts[split:]


def units(text: str) -> list[Unit]:
    """The units of a text. A mark with nothing before it is a unit without a head."""
    out: list[Unit] = []
    for ch in unicodedata.normalize("NFC", text):
        head, marks = _parted(ch)
        if head:
            out.append(unit(head, marks))
        elif out and out[-1].head:
            out[-1] = unit(out[-1].head, out[-1].marks + marks)
        else:
            out.append(unit("", marks))
    return out


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    cuts = [k for k in range(1, len(points)) if points[k] != points[k - 1] + 1]
    return "".join(f"{chr(points[a])}-{chr(points[b - 1])}" for a, b in zip([0, *cuts], [*cuts, len(points)], strict=True))


@lru_cache(1)
def _marks() -> str:
    return _ranges([p for p in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(p))])


@lru_cache(1)
def syllable_pattern() -> re.Pattern:
    """A syllable of composed text: letters with the marks after them, as units has them."""
    letters = [p for p in range(sys.maxunicode + 1) if chr(p).isalpha() and units(chr(p))[0].letter]
    return re.compile(f"(?:[{_ranges(letters)}][{_marks()}]*)+")


@lru_cache(1)
def _mark_pattern() -> re.Pattern:
    return re.compile(f"[{_marks()}]")


# --- placement of the tone mark -------------------------------------------------------------------------------

_RUN = re.compile(r"(?=[A-Za-z]*+[^\x00-\x7f])(?:[^\W\d_][̀-ͯ]*)+")  # ASCII runs have no tone
_VOWELS = re.compile("[aeiouy]+")


def _nucleus(skeleton: str, shaped: set[int], start: int, end: int) -> int:
    """Where, in the vowels start to end of a run's plain letters, the tone belongs. shaped: places of letters with a letter mark.

    qu and gi before another vowel are an onset; o before a or e, and u before y, are a glide. Of what is left the
    last letter with a mark carries the tone; without one, the last if a consonant follows, else the first.
    """
    if end - start > 1 and start and skeleton[start - 1 : start + 1] in ("qu", "gi") and start not in shaped:
        start += 1
    if end - start > 1 and start not in shaped and skeleton[start : start + 2] in ("oa", "oe", "uy"):
        start += 1
    dressed = [k for k in range(start, end) if k in shaped]
    if dressed:
        return dressed[-1]
    return end - 1 if end < len(skeleton) else start


@lru_cache(1 << 16)
def _placed(run: str) -> str:
    own = units(run)
    toned = [k for k, u in enumerate(own) if u.tones]
    if len(toned) != 1 or len(own[toned[0]].tones) != 1:
        return run
    skeleton = "".join((STROKED.get(u.head, nfd(u.head)[:1]) or " ").lower()[0] for u in own)
    cluster = next((m for m in _VOWELS.finditer(skeleton) if m.start() <= toned[0] < m.end()), None)
    if cluster is None:
        return run
    at = _nucleus(skeleton, {k for k, u in enumerate(own) if u.shapes}, *cluster.span())
    tone = own[toned[0]].tones
    moved = [u.head + (u.marks.replace(tone, "") if k == toned[0] else u.marks) + (tone if k == at else "") for k, u in enumerate(own)]
    return unicodedata.normalize("NFC", "".join(moved)) if at != toned[0] else run


def placed(text: str) -> str:
    """Every run of letters with one tone mark carries it on its nucleus. Composed; a second time changes nothing."""
    text = unicodedata.normalize("NFC", text)
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _RUN.sub(lambda m: m[0] if m[0].isascii() else _placed(m[0]), text))


PLACEMENTS = ("MODERN", "PRESERVE")


def canon(text: str, placement: str = "MODERN") -> str:
    if placement not in PLACEMENTS:
        raise NotImplementedError(f"placement {placement}")
    return placed(text) if placement == "MODERN" else unicodedata.normalize("NFC", text)


def form(text: str) -> str:
    c, d = unicodedata.normalize("NFC", text) == text, nfd(text) == text
    return "NFC=NFD" if c and d else "NFC" if c else "NFD" if d else "MIXED"


def differences(text: str, placement: str = "MODERN") -> dict:
    composed, whole = unicodedata.normalize("NFC", text), canon(text, placement)
    return {"already_canonical": whole == text, "nfc_changed": composed != text, "tone_placement_changed": whole != composed, "input_length": len(text), "canonical_length": len(whole), "input_form": form(text), "placement": placement}


# --- decomposition --------------------------------------------------------------------------------------------


def decompose(text: str, clean: bool = False, placement: str = "MODERN", classify=None) -> dict:
    """Units and syllables of the canonical text, with offsets in code points of it and of the base text."""
    whole = canon(text, placement)
    rows, a, b = [], 0, 0
    for k, u in enumerate(units(whole)):
        t, base = u.text, u.base
        rows.append({
            "unit_index": k, "canonical_text": t, "canonical_start": a, "canonical_end": a + len(t), "base_char": base, "base_start": b, "base_end": b + len(base),
            "letter_diacritic": u.state, "observed_tone": u.tone, "nfd_marks": list(u.marks), "has_stroke": u.state == "STROKE", "anomalies": u.anomalies,
        })
        a, b = a + len(t), b + len(base)
    return {"original_text": text, "nfc_text": unicodedata.normalize("NFC", text), "canonical_text": whole, "base_text": "".join(r["base_char"] for r in rows), "units": rows, "syllables": _syllables(rows, clean, classify), "source_is_clean": clean, "metadata": {"placement": placement}}


def _syllables(rows: list[dict], clean: bool, classify) -> list[dict]:
    groups: list[list[dict]] = []
    open_ = False
    for r in rows:
        if r["letter_diacritic"] == "NA":
            open_ = False
        elif open_:
            groups[-1].append(r)
        else:
            groups.append([r])
            open_ = True
    out = []
    for k, g in enumerate(groups):
        toned = [r for r in g if r["observed_tone"] != "UNMARKED"]
        lexical = toned[0]["observed_tone"] if toned else "NGANG" if clean else None
        base = "".join(r["base_char"] for r in g)
        flags = (["MULTIPLE_TONE_MARKS"] if len(toned) > 1 else []) + [x for r in g for x in r["anomalies"]]
        out.append({
            "span_index": k, "canonical_start": g[0]["canonical_start"], "canonical_end": g[-1]["canonical_end"], "base_start": g[0]["base_start"], "base_end": g[-1]["base_end"],
            "text": "".join(r["canonical_text"] for r in g), "base_text": base, "observed_tone": toned[0]["observed_tone"] if toned else "UNMARKED", "lexical_tone": lexical,
            "tone_unit_index": toned[0]["unit_index"] if toned else None, "eligibility": classify(base) if classify else UNDECIDED, "unit_indices": [r["unit_index"] for r in g], "anomalies": list(dict.fromkeys(flags)),
        })
    return out


def recompose(rows: list[dict]) -> str:
    """The canonical text from its units' base characters, strokes and marks."""
    back = {v: k for k, v in STROKED.items()}
    out = []
    for r in rows:
        head = nfd(r["base_char"])
        split = next((k for k, c in enumerate(head) if unicodedata.combining(c)), len(head))
        head = head[:split]
        out.append((back.get(head, head) if r["has_stroke"] else head) + "".join(r["nfd_marks"]))
    return unicodedata.normalize("NFC", "".join(out))


def strip(text: str) -> str:
    """The base text: no tone, letter mark or stroke; nothing else changes."""
    return "".join(u.base for u in units(canon(text)))


def strip_marks(text: str) -> str:
    """Like strip, of the text as it is spelled, composed."""
    bare = nfd(unicodedata.normalize("NFC", text).translate({ord(k): v for k, v in STROKED.items()}))
    return unicodedata.normalize("NFC", "".join(c for c in bare if c not in MARKS))


def signature(text: str, collapse: bool = True) -> str:
    bare = strip_marks(text)
    return " ".join(bare.split()) if collapse else bare


def rewrite_signature(text: str) -> str:
    return signature(text).casefold().rstrip(".!?… \t\r\n")


def membership_form(text: str) -> str:
    return strip(canon(text)).casefold()


def first_divergence(a: str, b: str) -> int | None:
    if a == b:
        return None
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def word_diff(a: str, b: str) -> list[dict]:
    x, y = a.split(), b.split()
    ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    return [{"op": op, "before": x[i:j], "after": y[k:m]} for op, i, j, k, m in ops if op != "equal"]


def runs(own: list[Unit]) -> list[tuple[int, int]]:
    """Where the syllables of units start and end."""
    out, start = [], None
    for k, u in enumerate(own):
        if u.state == "NA":
            if start is not None:
                out.append((start, k))
                start = None
        elif start is None:
            start = k
    if start is not None:
        out.append((start, len(own)))
    return out


def observed(own: list[Unit], a: int, b: int) -> str:
    """A syllable's tone: that of its first toned unit."""
    return next((u.tone for u in own[a:b] if u.tones), "UNMARKED")


def observe(text: str, classify=None) -> dict:
    whole = canon(text)
    if classify is None and (whole.isascii() or not _mark_pattern().search(whole)):
        return _observed_by_character(text, whole)
    own = units(whole)
    base = "".join(u.base for u in own)
    spans = runs(own)
    eligible = [observed(own, a, b) for a, b in spans if classify("".join(u.base for u in own[a:b])) == "VIETNAMESE_CANDIDATE"] if classify else []
    letters = [u for u in own if u.state != "NA"]
    shaped = sum(u.state != "NONE" for u in letters)
    return {
        "canon_changed": whole != text, "base_equivalent": whole == base, "changed_characters": sum(x != y for x, y in zip(whole, base, strict=False)) + abs(len(whole) - len(base)),
        "changed_units": sum(u.text != u.base for u in own), "units_with_observed_tone": sum(u.tone != "UNMARKED" for u in own), "units_with_observed_letter": shaped, "total_units": len(own), "syllables": len(spans),
        "tone_eligible_syllables": len(eligible), "tone_observed_syllables": sum(t != "UNMARKED" for t in eligible), "letter_eligible_units": len(letters), "letter_observed_units": shaped, "eligibility_resolved": classify is not None,
    }


_WORDS = re.compile(r"[^\W\d_]+")


def _observed_by_character(text: str, whole: str) -> dict:
    """observe without an inventory, of a text in which every character is a unit: from how often each stands there."""
    seen = Counter(whole)
    n = {units(ch)[0]: k for ch, k in seen.items()}
    # word characters as re has them are faster than a class of all letters, and the same but for number letters
    plain = all((ch.isalnum() and not ch.isdecimal()) == (units(ch)[0].state != "NA") for ch in seen)
    words = _WORDS if plain else syllable_pattern()

    def count(good) -> int:
        return sum(k for u, k in n.items() if good(u))

    letters, shaped = count(lambda u: u.state != "NA"), count(lambda u: u.state not in ("NA", "NONE"))
    if all(len(u.base) == 1 for u in n):
        base = whole if all(u.text == u.base for u in n) else None
        changed = count(lambda u: u.text != u.base)
    else:
        base = "".join(units(ch)[0].base for ch in whole)
        changed = sum(x != y for x, y in zip(whole, base, strict=False)) + abs(len(whole) - len(base))
    return {
        "canon_changed": whole != text, "base_equivalent": whole == base, "changed_characters": changed, "changed_units": count(lambda u: u.text != u.base), "units_with_observed_tone": count(lambda u: u.tone != "UNMARKED"),
        "units_with_observed_letter": shaped, "total_units": len(whole), "syllables": len(words.findall(whole)), "tone_eligible_syllables": 0, "tone_observed_syllables": 0,
        "letter_eligible_units": letters, "letter_observed_units": shaped, "eligibility_resolved": False,
    }


@lru_cache(1 << 16)
def _tone(syllable: str) -> str:
    own = units(syllable)
    return observed(own, 0, len(own))


def tones_of(text: str) -> list[str]:
    """The observed tone of each syllable."""
    return [_tone(s) for s in syllable_pattern().findall(canon(text))]


def regions(text: str, classify=None) -> list[dict]:
    """Syllables in base-text ranges, and the gaps between them: every character is in one region."""
    own = units(canon(text))
    place = [0]
    for u in own:
        place.append(place[-1] + len(u.base))
    out, at = [], 0

    def gap(end: int) -> None:
        if at < end:
            out.append({"start": at, "end": end, "eligibility": "NOT_APPLICABLE", "is_syllable": False, "observed_tone": None})

    for a, b in runs(own):
        gap(place[a])
        out.append({"start": place[a], "end": place[b], "eligibility": classify("".join(u.base for u in own[a:b])) if classify else UNDECIDED, "is_syllable": True, "observed_tone": observed(own, a, b)})
        at = place[b]
    gap(place[-1])
    return out


def checked(text: str) -> dict:
    """Canonical text, its recomposition from units, whether they agree, input form and anomalies."""
    whole = canon(text)
    own = units(whole)
    back = unicodedata.normalize("NFC", "".join(u.head + u.marks for u in own))
    return {"canonical": whole, "recomposed": back, "passed": back == whole, "input_form": form(text), "anomalies": sorted({a for u in set(own) for a in u.anomalies})}


_CHUNK = re.compile(r"\S+")


def chunks(text: str) -> list[dict]:
    """Longest runs without white space, with their ranges."""
    return [{"index": k, "text": m[0], "start": m.start(), "end": m.end()} for k, m in enumerate(_CHUNK.finditer(text))]


def safe_cuts(text: str) -> list[int]:
    """Offsets at which a cut parts neither a unit nor a syllable; none if the text is not canonical."""
    if not text:
        return []
    d = decompose(text)
    if d["canonical_text"] != text:
        return []
    inner = {k for s in d["syllables"] for k in range(s["canonical_start"] + 1, s["canonical_end"])}
    return sorted(({u["canonical_start"] for u in d["units"]} | {0, len(text)}) - inner)
