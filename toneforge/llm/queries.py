"""Queries of the operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, idstore, langid, licenses, mixlm, pieces, pii, quality, simhash
from .common import id_remainder, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the rows that are not held out. Null ids are learned from; null and letterless texts are und with score 0; repeated rows are rows like others; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_remainder(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's piece ids, and whether they decode to it. A null or empty text has none; repeated rows and null ids pass through."""
    return pieces.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def vocabulary(name: str) -> str:
    """A public tokenizer's file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all texts' ids to a store and reads it back, verified. A null or empty text is its end alone; repeated ids stay apart; null ids come first."""
    path = idstore.write(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return idstore.verified(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's quality, learned from labels that are not held out. Null texts count as empty; null ids have no label and are not held out; repeated rows score alike; a score of 0.5 is predicted 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 3) != 1)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over four-word shingles and its component. Texts without words have fingerprint zero and are linked like others; null ids have a component but are no one's; repeated rows stay."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item that leaked into it, with the tiles. Null and empty texts match nothing; repeated rows and items are found each; null ids pass through."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notice in every document, with its span. Null and empty texts have none; repeated rows are found each; null ids pass through."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data. A null or empty text has none, and the digest of nothing; repeated rows and null ids pass through."""
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by a model of all documents that are not held out (null ids are: their remainder counts as 0). A null or empty text is its end alone; repeated rows count each."""
    return mixlm.score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) == 0)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five nearest. Null ids and unusable vectors take no part; rows of one id are that id's; ties go to the smaller id; fewer candidates give fewer rows."""
    found = ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_langid": op1_langid, "op2_pieces": op2_pieces, "op3_idstore": op3_idstore, "op4_quality": op4_quality, "op5_simhash": op5_simhash, "op6_decontam": op6_decontam, "op7_licenses": op7_licenses, "op8_pii": op8_pii, "op9_mixlm": op9_mixlm, "op10_ann": op10_ann}


def oracle_sql() -> dict[str, str]:
    return {}
