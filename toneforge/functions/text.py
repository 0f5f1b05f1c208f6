"""Column functions over text.

Base stripping of composed text, signatures, identities, chunks and noise counts are built-in expressions. Unicode
normalisation, tone placement and decomposition, which Spark has no expression for, are Arrow-batched UDFs over the
kernels. A null text gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StringType, _parse_datatype_string  # noqa: PLC2701

from . import kernels as K
from . import rows
from .marks import MARKS, composed, plain, several


def mapped(fn: Callable, returns: str | DataType) -> Callable[..., Column]:
    """An Arrow-batched UDF that applies fn to each row's plain Python values, of one text column once to each different text of a batch; null if any argument is."""
    kind = _parse(returns)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(*cols: pa.Array) -> pa.Array:
        if len(cols) == 1 and pa.types.is_string(cols[0].type):
            own = cols[0].dictionary_encode()
            if 2 * len(own.dictionary) < len(own):
                return pa.array([fn(v) for v in own.dictionary.to_pylist()], arrow).take(own.indices)
        return pa.array([None if any(v is None for v in row) else fn(*row) for row in zip(*(c.to_pylist() for c in cols), strict=True)], arrow)

    return run


def _parse(returns: str | DataType) -> DataType:
    return returns if isinstance(returns, DataType) else StringType() if returns == "string" else _parse_datatype_string(returns)


UNIT = "struct<unit_index:int,canonical_text:string,canonical_start:int,canonical_end:int,base_char:string,base_start:int,base_end:int,letter_diacritic:string,observed_tone:string,nfd_marks:array<string>,has_stroke:boolean,anomalies:array<string>>"
SYLLABLE = "struct<span_index:int,canonical_start:int,canonical_end:int,base_start:int,base_end:int,text:string,base_text:string,observed_tone:string,lexical_tone:string,tone_unit_index:int,eligibility:string,unit_indices:array<int>,anomalies:array<string>>"
DECOMPOSED = f"original_text string, nfc_text string, canonical_text string, base_text string, units array<{UNIT}>, syllables array<{SYLLABLE}>, source_is_clean boolean, metadata map<string,string>"
OBSERVED = "canon_changed boolean, base_equivalent boolean, changed_characters int, changed_units int, units_with_observed_tone int, units_with_observed_letter int, total_units int, syllables int, tone_eligible_syllables int, tone_observed_syllables int, letter_eligible_units int, letter_observed_units int, eligibility_resolved boolean"

_made: dict[str, Callable[..., Column]] = {}


def _udf(name: str, fn: Callable, returns: str) -> Callable[..., Column]:
    """UDFs are made with the first session that needs them."""
    if name not in _made:
        _made[name] = mapped(fn, returns)
    return _made[name]


def nfc(text: Column) -> Column:
    return _udf("nfc", K.nfc.__wrapped__, "string")(text)


def nfd(text: Column) -> Column:
    return _udf("nfd", K.nfd, "string")(text)


def canon(text: Column, placement: str = "MODERN") -> Column:
    """Composed text with every tone mark on its nucleus (MODERN), or composed alone (PRESERVE)."""
    if placement not in K.PLACEMENTS:
        raise NotImplementedError(f"placement {placement}")
    return _udf("canon", K.canon, "string")(text) if placement == "MODERN" else nfc(text)


def canonical_differences(text: Column, placement: str = "MODERN") -> Column:
    """Struct: already_canonical, nfc_changed, tone_placement_changed, lengths, input_form, placement."""
    return _udf(f"differences-{placement}", lambda t: K.differences(t, placement), "already_canonical boolean, nfc_changed boolean, tone_placement_changed boolean, input_length int, canonical_length int, input_form string, placement string")(text)


def unicode_form(text: Column) -> Column:
    return _udf("form", K.form, "string")(text)


def decompose(text: Column, clean: bool = False, placement: str = "MODERN") -> Column:
    """Struct of the canonical and base text with units and syllables; eligibility is UNDECIDED until joined with an inventory."""
    return _udf(f"decompose-{clean}-{placement}", lambda t: K.decompose(t, clean, placement), DECOMPOSED)(text)


def unit_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each unit of each text: key, and the unit's fields, or those named."""
    return rows.streamed(docs, [key], [F.col(text)], rows.units_of, _parse_datatype_string(UNIT), fields)


def syllable_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", clean: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each syllable of each text: key, and the syllable's fields, or those named."""
    return rows.streamed(docs, [key], [F.col(text)], lambda t: rows.syllables_of(t, clean), _parse_datatype_string(SYLLABLE), fields)


def syllable_tones(text: Column) -> Column:
    """Array of the syllables' observed tones."""
    return _udf("tones", K.tones_of, "array<string>")(text)


def round_trip(text: Column) -> Column:
    """Struct: canonical, recomposed, passed, input_form, anomalies."""
    return _udf("checked", K.checked, "canonical string, recomposed string, passed boolean, input_form string, anomalies array<string>")(text)


REGIONS = "array<struct<start:int,end:int,eligibility:string,is_syllable:boolean,observed_tone:string>>"


def regions(text: Column, inventory: frozenset[str] | None = None) -> Column:
    """Array of the syllables and the gaps between them, in base-text ranges; eligibility by the inventory, else UNDECIDED."""
    if inventory is None:
        return _udf("regions", K.regions, REGIONS)(text)
    from ..operators.inventory import classifier

    own = classifier(inventory)
    return mapped(lambda t: K.regions(t, own), REGIONS)(text)


def recompose(decomposed: Column) -> Column:
    """The canonical text again, from the units."""
    return _udf("recompose", lambda rows: K.recompose(list(rows)), "string")(decomposed["units"])


def strip_base(text: Column) -> Column:
    """The base text of composed text, by built-in functions: one translate over all characters that lose a mark, then the marks that stand alone."""
    source = composed()
    out = F.translate(text, "".join(source) + "đĐ", "".join(map(plain, source)) + "dD")
    for ch, bare in several().items():
        out = F.replace(out, F.lit(ch), F.lit(bare))
    return F.regexp_replace(out, f"[{MARKS}]", "")


def strip_to_base(text: Column) -> Column:
    """The base text of any text: canonical first."""
    return _udf("strip", K.strip, "string")(text)


def base_signature(text: Column, collapse: bool = True) -> Column:
    """Base text of composed text with runs of white space as one blank and none at the ends."""
    bare = strip_base(text)
    return F.trim(F.regexp_replace(bare, r"[\s\u001c-\u001f\u0085   -     　]+", " ")) if collapse else bare


def rewrite_signature(text: Column) -> Column:
    """base_signature, case-folded and without sentence ends."""
    return _udf("rewrite", K.rewrite_signature, "string")(text)


def membership_form(text: Column) -> Column:
    return _udf("membership", K.membership_form, "string")(text)


def first_divergence(a: Column, b: Column) -> Column:
    """Index of the first character in which a and b differ, the shorter length if one starts the other, null if equal."""
    return _udf("first_divergence", K.first_divergence, "int")(a, b)


def word_diff(a: Column, b: Column) -> Column:
    """The changes between the words of a and b."""
    return _udf("word_diff", K.word_diff, "array<struct<op:string,before:array<string>,after:array<string>>>")(a, b)


def observed_from_lexical(tone: Column) -> Column:
    return F.when(tone == "NGANG", F.lit("UNMARKED")).otherwise(tone)


def observe_orthography(text: Column) -> Column:
    """Struct of a text's observable counts; tone counts need an inventory and are 0 here (eligibility_resolved false)."""
    return _udf("observe", K.observe, OBSERVED)(text)


def observe_with(inventory: frozenset[str]) -> Callable[[Column], Column]:
    """observe_orthography with syllables resolved against forms; the set is bounded by the language's syllables."""
    from ..operators.inventory import classifier

    own = classifier(inventory)
    return mapped(lambda t: K.observe(t, own), OBSERVED)


def pathway_text(text: Column, pathway: str) -> Column:
    """VANILLA: canonical; BASE_ONLY: base text."""
    if pathway not in ("VANILLA", "BASE_ONLY"):
        raise ValueError(f"pathway {pathway}")
    return canon(text) if pathway == "VANILLA" else strip_to_base(text)


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def canonical_digest(text: Column) -> Column:
    return text_digest(canon(text))


# --- white space, noise -----------------------------------------------------------------------------------------

#: White space as Unicode has it, and the information separators.
SPACES = r"\t-\r\x1c-\x20\u0085   -     　"


def whitespace_chunks(text: Column) -> Column:
    """Array of {index, text, start, end}: longest runs without white space, with code-point ranges."""
    return _udf("chunks", K.chunks, "array<struct<index:int,text:string,start:int,end:int>>")(text)


def whitespace_chunk_counts(text: Column) -> Column:
    """Struct of what whitespace_chunks comes to: chunks, their characters, and where the first one starts (null without one). Built-in functions alone."""
    chunks = F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")
    return F.struct(chunks.alias("chunks"), F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("long").alias("characters"), F.when(chunks > 0, F.length(F.regexp_extract(text, f"^[{SPACES}]*", 0)).cast("long")).alias("first_start"))


_WORD = r"[\p{L}\p{N}_]"
NOISE = {
    "urls": r"(?i)https?://[^S]+|www\.[^S]+".replace("[^S]", f"[^{SPACES}]"),
    "mentions": f"@{_WORD}+",
    "hashtags": f"#{_WORD}+",
    "emoji_or_symbols": r"[\x{10000}-\x{10FFFF}]|[\p{So}\p{Sk}&&[^\x{10000}-\x{10FFFF}]]",
    "repeated_char_runs": r"([^\n])\1{2,}",
    "digit_bearing_tokens": rf"(?<!{_WORD}){_WORD}*\p{{Nd}}{_WORD}*(?!{_WORD})",
}


def noise(text: Column) -> Column:
    """Struct of counts: urls, mentions, hashtags, emoji_or_symbols, repeated_char_runs, digit_bearing_tokens."""
    return F.struct(*(F.regexp_count(text, F.lit(p)).alias(n) for n, p in NOISE.items()))
