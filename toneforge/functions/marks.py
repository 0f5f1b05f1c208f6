"""Marks and label sets of Vietnamese orthography."""

from __future__ import annotations

import unicodedata

# Combining marks of tones and letters, the stroked d, and the labels of the channels.
TONES = {"́": "SAC", "̀": "HUYEN", "̉": "HOI", "̃": "NGA", "̣": "NANG"}
LETTERS = {"̆": "BREVE", "̂": "CIRCUMFLEX", "̛": "HORN"}
STROKED = {"đ": "d", "Đ": "D"}
TONE_IDS = {"SAC": 0, "HUYEN": 1, "HOI": 2, "NGA": 3, "NANG": 4, "UNMARKED": 5}
LETTER_IDS = {"NONE": 0, "BREVE": 1, "CIRCUMFLEX": 2, "HORN": 3, "STROKE": 4}
CANDIDATE, NOT_APPLICABLE, UNDECIDED = "VIETNAMESE_CANDIDATE", "NOT_APPLICABLE", "UNDECIDED"

MARKS = "".join([*TONES, *LETTERS])


def plain(ch: str) -> str:
    """A composed character without its tone, letter mark or stroke; other marks stay."""
    if ch in STROKED:
        return STROKED[ch]
    parts = unicodedata.normalize("NFD", ch)
    return unicodedata.normalize("NFC", "".join(c for c in parts if c not in MARKS))


def composed() -> list[str]:
    """Every composed character that loses something to plain() and becomes one character by it, in code point order."""
    found = []
    for point in range(0x00C0, 0x2000):
        ch = chr(point)
        if unicodedata.normalize("NFC", ch) == ch and len(plain(ch)) == 1 and plain(ch) != ch:
            found.append(ch)
    return found


def several() -> dict[str, str]:
    """Composed characters whose plain form has several characters."""
    return {ch: plain(ch) for ch in map(chr, range(0x00C0, 0x2000)) if unicodedata.normalize("NFC", ch) == ch and len(plain(ch)) > 1 and plain(ch) != ch}
