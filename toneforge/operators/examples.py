"""Training examples: one token grid of the base text, with channels of the clean and of the corrupted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions.text import mapped
from . import align
from .corruption import corrupt_text
from .inventory import classifier


def sampled(docs: DataFrame, seed: int, visit: int, inventory: frozenset[str] | None = None) -> DataFrame:
    """docs (sample_id, text) with canonical, corrupted and base text, and the rate and scope drawn for this visit. A corruption that changes the base text raises."""
    classify = None if inventory is None else classifier(inventory)
    key = F.col("sample_id").cast("string")
    own = docs.select(key.alias("sample_id"), "text").withColumn("rate", H.rate_column(seed, F.col("sample_id"), F.lit(str(visit)))).withColumn("scope", H.scope_column(seed, F.col("sample_id"), F.lit(str(visit))))
    run = mapped(lambda t, i, p, s: corrupt_text(t, "SAMPLED", s, p, seed, i, True, classify)["corrupted_text"], "string")
    own = own.withColumn("canonical", T.canon(F.col("text"))).withColumn("corrupted", run(F.col("text"), F.col("sample_id"), F.col("rate"), F.col("scope")))
    own = own.withColumn("base", T.strip_to_base(F.col("canonical"))).withColumn("corrupted_base", T.strip_to_base(F.col("corrupted")))
    same = F.when(F.col("base") == F.col("corrupted_base"), F.col("base")).otherwise(F.raise_error(F.lit("corruption changed the base text")))
    return own.withColumn("base", same).drop("corrupted_base")


def prepared(docs: DataFrame, seed: int, visit: int, tokenizer: Callable[[str], tuple[list[str], list[int]]], inventory: frozenset[str] | None = None) -> DataFrame:
    """A row for each sample with a token: tokens and token_ids of the base text, and for clean and corrupt text the tone and letter labels of every token. A chunk that its pieces don't spell raises."""
    own = sampled(docs, seed, visit, inventory).withColumnRenamed("sample_id", "doc_id")
    aligned = align.align(align.tokenized(align.chunks(own, "base"), tokenizer))
    checked = aligned.withColumn("pieces", F.when(F.col("failure_reason").isNull(), F.col("pieces")).otherwise(F.raise_error(F.concat(F.lit("alignment: "), F.col("failure_reason"))).cast(aligned.schema["pieces"].dataType)))
    pieces = align.pieces(checked)
    out = align.compose(aligned)
    for side, text in (("clean", "canonical"), ("corrupt", "corrupted")):
        regions = align.regions(own, text, inventory=inventory)
        labels = own.select("doc_id", align.character_labels(T.decompose(F.col(text))).alias("labels"))
        projected = align.project(align.overlay(pieces, regions), regions, labels)
        rows = projected.groupBy(F.col("doc_id").alias("d")).agg(F.sort_array(F.collect_list(F.struct("piece_index", "tone_label", "letter_label"))).alias("p"))
        rows = rows.select("d", F.col("p.tone_label").alias(f"{side}_tones"), F.col("p.letter_label").alias(f"{side}_letters"))
        out = out.join(rows, F.col("doc_id") == F.col("d")).drop("d")
    return out.withColumnRenamed("doc_id", "sample_id")


def with_specials(rows: DataFrame, first_id: int, last_id: int) -> DataFrame:
    """rows with input_ids and special_tokens_mask: token_ids between two special tokens."""
    ids = F.concat(F.array(F.lit(first_id)), F.col("token_ids"), F.array(F.lit(last_id)))
    mask = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size("token_ids")), F.array(F.lit(1)))
    return rows.withColumn("input_ids", ids).withColumn("special_tokens_mask", mask)
