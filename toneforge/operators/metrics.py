"""Classification scores and selections with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """One row: accuracy and rows. Raises on no rows."""
    if df.isEmpty():
        raise ValueError("accuracy of no rows")
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def class_scores(df: DataFrame, prediction: str = "prediction", label: str = "label", classes: int | None = None) -> DataFrame:
    """label, support, true_positive, false_positive, false_negative, precision, recall, f1 of every class that occurs, or of 0 to classes - 1. One aggregation of (prediction, label) pairs; empty denominators give 0."""
    pairs = df.groupBy(F.col(prediction).alias("p"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
    hit = F.col("p") == F.col("y")
    none = F.lit(0).cast("long")
    as_label = F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.when(hit, F.col("n")).otherwise(none).alias("tp"), none.alias("fp"))
    as_prediction = F.struct(F.col("p").alias("label"), none.alias("support"), none.alias("tp"), F.when(hit, none).otherwise(F.col("n")).alias("fp"))
    sides = F.array(as_label, as_prediction)
    rows = pairs.select(F.inline(sides))
    if classes is not None:
        every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"), *(F.lit(0).cast("long").alias(c) for c in ("support", "tp", "fp")))
        rows = rows.unionByName(every).where(F.col("label").between(0, classes - 1))
    t = rows.groupBy("label").agg(F.sum("support").alias("support"), F.sum("tp").alias("true_positive"), F.sum("fp").alias("false_positive")).withColumn("false_negative", F.col("support") - F.col("true_positive"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp = F.col("true_positive")
    t = t.withColumn("precision", ratio(tp, tp + F.col("false_positive"))).withColumn("recall", ratio(tp, F.col("support")))
    return t.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(df: DataFrame, prediction: str = "prediction", label: str = "label", classes: int | None = None) -> DataFrame:
    return class_scores(df, prediction, label, classes).agg(F.avg("f1").alias("macro_f1"))


def gap_recovery(system: float, floor: float, upper: float) -> float:
    """The share of the gap between floor and upper that system makes up; not clamped."""
    if upper == floor:
        raise ZeroDivisionError("no gap")
    return (system - floor) / (upper - floor)


def gap_recovery_column(system: Column, floor: Column, upper: Column) -> Column:
    """Null where there is no gap."""
    return (system - floor) / F.nullif(upper - floor, F.lit(0.0))


def sample_deviation(value: Column, single: float | None = None) -> Column:
    """Standard deviation over n - 1; single is the value for one row (null, or 0.0)."""
    dev = F.stddev_samp(value)
    return dev if single is None else F.coalesce(dev, F.when(F.count(value) == 1, F.lit(single)))


def paired_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and deviation of a less b over equal keys; keys on one side only raise."""
    both = a.select(F.col(key).alias("k"), F.col(value).alias("x")).join(b.select(F.col(key).alias("k2"), F.col(value).alias("y")), F.col("k") == F.col("k2"), "full_outer")
    if not both.where("k is null or k2 is null").isEmpty():
        raise ValueError("unpaired keys")
    return both.agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("mean"), sample_deviation(F.col("x") - F.col("y"), 0.0).alias("deviation"))


def best_checkpoint(points: DataFrame) -> DataFrame:
    """The point of the least score; of equals the least d_clean, then the earliest update."""
    return points.orderBy("score", "d_clean", "update").limit(1)


def best_epoch(points: DataFrame) -> DataFrame:
    """The largest macro_f1, then accuracy, then the earliest epoch."""
    return points.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "epoch").limit(1)


def best_rate(points: DataFrame) -> DataFrame:
    """Learning rates by mean macro_f1 over seeds, then accuracy, the smaller deviation, the smaller rate."""
    t = points.groupBy("lr").agg(F.avg("macro_f1").alias("f1"), F.avg("accuracy").alias("acc"), sample_deviation(F.col("macro_f1"), 0.0).alias("sd"))
    return t.orderBy(F.desc("f1"), F.desc("acc"), "sd", "lr").limit(1)


def worst_case(scores: DataFrame, by: str, value: str = "score") -> DataFrame:
    return scores.groupBy(by).agg(F.max(value).alias("worst"))


# Updates of a run, of a run that is carried on, and between evaluations.
INITIAL_UPDATES, EXTENDED_UPDATES, EVALUATE_EVERY = 20_000, 40_000, 500


def evaluation_updates(total: int, every: int = EVALUATE_EVERY) -> list[int]:
    """Update 0, then every so many, with the last; total must be a multiple."""
    if total % every:
        raise ValueError(f"{total} is no multiple of {every}")
    return list(range(0, total + 1, every))


def budget_decision(selected: int, cap: int) -> dict:
    """What follows a run to cap whose best checkpoint is selected: only a best one at the very end of the first budget is carried on to the second; there it is marked as limited by the budget."""
    if cap not in (INITIAL_UPDATES, EXTENDED_UPDATES):
        raise ValueError(f"cap {cap} is no budget")
    if selected > cap:
        raise ValueError(f"update {selected} is beyond the cap {cap}")
    at_end, extended = selected == cap, cap == EXTENDED_UPDATES
    return {"cap": EXTENDED_UPDATES if at_end else cap, "continue_run": at_end and not extended, "budget_limited": at_end and extended}


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """1 - cosine; norms are at least eps."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(eps)) * F.greatest(F.sqrt(dot(b, b)), F.lit(eps)))


def masked_mean(vectors: Column, special: Column) -> Column:
    """Mean of the vectors whose special mask is 0; raises if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), special.alias("s")), lambda z: z["s"] == 0), lambda z: z["v"])
    zero = F.transform(vectors[0], lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda p, q: p + q.cast("double")))
    return F.when(F.size(kept) == 0, F.raise_error(F.lit("no content tokens")).cast("array<double>")).otherwise(F.transform(total, lambda x: x / F.size(kept)))
