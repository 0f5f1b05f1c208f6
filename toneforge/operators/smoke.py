"""Records and summaries of restoration and round-trip checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class SuiteViolation(ValueError):
    pass


def select_cases(cases: DataFrame, categories: list[str] | None) -> DataFrame:
    return cases if not categories else cases.where(F.col("category").isin(*categories))


def validate_suite(cases: DataFrame, categories: set[str]) -> None:
    """Ids once, categories known, texts not blank."""
    bad = cases.groupBy("id").agg(F.count("*").alias("n"), F.min(F.col("category").isin(*categories)).alias("known"), F.min(F.length(F.trim("text"))).alias("chars")).where("n > 1 or not known or chars = 0 or chars is null")
    if not bad.isEmpty():
        raise SuiteViolation(str([r["id"] for r in bad.limit(5).collect()]))


def records(cases: DataFrame) -> DataFrame:
    """cases: (id, category, text, output, repeat, seconds, error). Flags of what a restorer changed beside marks; null where it failed."""
    ok = F.col("error").isNull() & F.col("output").isNotNull()
    when = lambda c: F.when(ok, c)
    a, b = F.col("text"), F.col("output")
    return (
        cases.withColumn("success", ok)
        .withColumn("base_preserved", when(T.base_signature(a) == T.base_signature(b)))
        .withColumn("rewrite_preserved", when(T.rewrite_signature(a) == T.rewrite_signature(b)))
        .withColumn("whitespace_only", when((T.base_signature(a) == T.base_signature(b)) & (T.base_signature(a, False) != T.base_signature(b, False))))
        .withColumn("formatting_only", when((T.rewrite_signature(a) == T.rewrite_signature(b)) & (T.base_signature(a) != T.base_signature(b))))
        .withColumn("deterministic", when(b.eqNullSafe(F.col("repeat"))))
        .withColumn("clean_exact", when(T.nfc(a) == T.nfc(b)))
        .withColumn("divergence", when(T.first_divergence(T.base_signature(a), T.base_signature(b))))
    )


def summarize(recorded: DataFrame) -> DataFrame:
    """Counts and rates by category and over all (category null), in one rollup; rates are of successful cases."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return recorded.rollup("category").agg(F.count("*").alias("cases"), F.count_if("success").alias("succeeded"), *(share(c) for c in ("base_preserved", "rewrite_preserved", "deterministic", "clean_exact")), F.avg(F.when(F.col("success"), F.col("seconds"))).alias("mean_seconds"), F.median(F.when(F.col("success"), F.col("seconds"))).alias("median_seconds"))


def engineering_status(recorded: DataFrame, least_success: float = 1.0, least_base: float = 0.95) -> DataFrame:
    """One row: ran, succeeded, deterministic, preserves, and passed if all hold."""
    t = recorded.agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("s"), F.coalesce(F.min("deterministic"), F.lit(False)).alias("deterministic"), F.avg(F.col("base_preserved").cast("double")).alias("b"))
    t = t.select((F.col("n") > 0).alias("ran"), F.coalesce(F.col("s") >= least_success, F.lit(False)).alias("succeeded"), "deterministic", F.coalesce(F.col("b") >= least_base, F.lit(False)).alias("preserves"))
    return t.withColumn("passed", F.col("ran") & F.col("succeeded") & F.col("deterministic") & F.col("preserves"))


def round_trip(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with canonical text, its recomposition, whether they agree, input form and anomalies."""
    return texts.withColumn("check", T.round_trip(F.col(text))).select("*", "check.*").drop("check")


def round_trip_summary(checked: DataFrame) -> DataFrame:
    """Texts by input form, with failures and the anomalies seen."""
    return checked.groupBy("input_form").agg(F.count("*").alias("texts"), F.count_if(~F.col("passed")).alias("failed"), F.count_if(F.size("anomalies") > 0).alias("anomalous"))


def truncation(df: DataFrame, length: Column, limit: int, policy: str) -> DataFrame:
    """FAIL raises on a row over limit, SKIP drops such rows, NOT_APPLICABLE keeps all. Nothing is cut."""
    if policy == "NOT_APPLICABLE":
        return df
    if policy == "SKIP":
        return df.where(length <= limit)
    if policy != "FAIL":
        raise ValueError(policy)
    if not df.where(length > limit).isEmpty():
        raise ValueError(f"rows over {limit}")
    return df


def lambdas(r: float) -> tuple[float, float]:
    """Weights r : 1 that sum to 1."""
    if r < 0:
        raise ValueError("a negative ratio")
    return r / (1 + r), 1 / (1 + r)
