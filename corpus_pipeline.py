"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's docs.

A stage is (name, function); a function takes (spark, docs, sf_dir), docs being what its predecessor kept, and
returns a DataFrame. All but the last return the columns of documents, also of clashing names, and pass empty tables through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toneforge.llm import decontam, pieces, pii, quality, simhash
from toneforge.llm.common import spool, table
from toneforge.llm.queries import vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (a score under 0.5). A null text counts as empty; repeated rows stay or go together; null ids have no label but are scored; without labels all stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of the smallest doc_id. Null and empty texts are one group; rows equal in id and text are copies; a null id stays only if no other is in its group."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item. Null and empty texts are clean; repeated rows and null ids are judged like others; without items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars is that of the new text, 0 of a null one, which stays null. Repeated rows and null ids are treated like others."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text's piece ids, their number, and whether they decode to the text again. A null or empty text has none; repeated rows and null ids pass through."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("pii", redacted),
    ("pieces", encoded),
]

#: No SQL expresses the classifier, fuzzy hashing and tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after another."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
