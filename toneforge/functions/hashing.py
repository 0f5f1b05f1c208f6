"""Keyed pseudo-random draws. BLAKE2b is the parity form; Spark has no BLAKE2b, so these are Arrow-batched UDFs. sha2 draws are native and can be checked in SQL, but are other numbers."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mapped

# Tags of the keyed draws.
SCORE_TAG, RATE_TAG, SCOPE_TAG, STAGE_TAG, ORDER_TAG = "b2-v1", "stage1-rate", "stage1-scope", "stage1-v1", "stage1-order"
#: The share of draws for which letters are corrupted as well as tones.
LETTER_SHARE = 0.25


def blake_hex(key: str, size: int) -> str:
    return hashlib.blake2b(key.encode(), digest_size=size).hexdigest()


def fraction(key: str) -> float:
    """The first 64 bits of a key's digest over 2^64."""
    return int(blake_hex(key, 8), 16) / 2.0**64


def score(seed: int, sample_id: str, identity: str, index: int, tag: str = SCORE_TAG) -> float:
    """A unit's draw. identity: SHA-256 of the canonical text."""
    return fraction("\x1f".join((tag, str(seed), sample_id, identity, str(index))))


def drawer(seed: int, sample_id: str, identity: str, tag: str = SCORE_TAG) -> Callable[[int], float]:
    """score of one text's units, by index; what their keys share is hashed once."""
    start = hashlib.blake2b("\x1f".join((tag, str(seed), sample_id, identity, "")).encode(), digest_size=8)

    def draw(index: int) -> float:
        own = start.copy()
        own.update(b"%d" % index)
        return int.from_bytes(own.digest(), "big") / 2.0**64

    return draw


def rate_for(seed: int, sample_id: str, visit: int) -> float:
    return fraction(f"{RATE_TAG}|{STAGE_TAG}|{seed}|{sample_id}|{visit}")


def scope_draw(seed: int, sample_id: str, visit: int) -> float:
    return fraction(f"{SCOPE_TAG}|{STAGE_TAG}|{seed}|{sample_id}|{visit}")


def scope_for(seed: int, sample_id: str, visit: int) -> str:
    return "TONE_AND_LETTER" if scope_draw(seed, sample_id, visit) < LETTER_SHARE else "TONE"


def derive_seeds(tag: str, n: int) -> list[int]:
    """Successive two-byte words of a tag's SHA-256."""
    if not 0 <= n <= 16:
        raise ValueError("at most 16 seeds")
    raw = hashlib.sha256(tag.encode()).digest()
    return [int.from_bytes(raw[2 * k : 2 * k + 2], "big") for k in range(n)]


def deterministic_batches(n: int, size: int, seed: int) -> list[list[int]]:
    """Shuffled places in batches; the last may be short."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return [order[k : k + size] for k in range(0, n, size)]


def keyed_hex(key: Column, size: int = 16) -> Column:
    """BLAKE2b of a text column, in hex."""
    return mapped(lambda k: blake_hex(k, size), "string")(key)


def keyed_fraction(key: Column) -> Column:
    return mapped(fraction, "double")(key)


def unit_scores(seed: int, sample_id: Column, identity: Column, count: Column) -> Column:
    """The draws of units 0 to count - 1."""
    return mapped(lambda s, i, n: [score(seed, s, i, k) for k in range(int(n))], "array<double>")(sample_id, identity, count)


def rate_column(seed: int, sample_id: Column, visit: Column) -> Column:
    return keyed_fraction(F.concat_ws("|", F.lit(RATE_TAG), F.lit(STAGE_TAG), F.lit(seed), sample_id, visit))


def scope_column(seed: int, sample_id: Column, visit: Column) -> Column:
    draw = keyed_fraction(F.concat_ws("|", F.lit(SCOPE_TAG), F.lit(STAGE_TAG), F.lit(seed), sample_id, visit))
    return F.when(draw < LETTER_SHARE, "TONE_AND_LETTER").otherwise("TONE")


def is_selected(draw: Column, probability: Column | float) -> Column:
    return draw < probability


def rank_key(tag: str, seed: int, item: Column, size: int = 16) -> Column:
    """tag|seed|item, hashed; an empty tag leaves seed|item."""
    return keyed_hex(F.concat_ws("|", *([F.lit(tag)] if tag else []), F.lit(seed), item), size)


def rank_key_sha2(tag: str, seed: int, item: Column) -> Column:
    """A native key of other values, for which SQL has the same function."""
    return F.sha2(F.concat_ws("|", *([F.lit(tag)] if tag else []), F.lit(str(seed)), item).cast("binary"), 256)
