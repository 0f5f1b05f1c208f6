"""Group-preserving stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import rank_key, rank_key_sha2
from .corpus import ranked


class SplitViolation(ValueError):
    pass


def ordered_parts(fractions: dict[str, float]) -> list[tuple[str, float]]:
    """Larger fractions first, then by name; they must sum to 1."""
    if not fractions or any(f <= 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-9:
        raise SplitViolation("fractions must be positive and sum to 1")
    return sorted(fractions.items(), key=lambda p: (-p[1], p[0]))


def allocation(total: int, fractions: dict[str, float]) -> dict[str, int]:
    """Sizes by rounding half to even; the last part takes the rest."""
    parts, left, out = ordered_parts(fractions), total, {}
    for name, share in parts[:-1]:
        out[name] = min(left, round(total * share))
        left -= out[name]
    out[parts[-1][0]] = left
    return out


def stratified(df: DataFrame, fractions: dict[str, float], seed: int, digest: Column, label: str = "label", native: bool = False, mixed_groups: bool = False) -> DataFrame:
    """df with part: within each label whole groups of equal digest are dealt, in a keyed order of the digests, part by part; rows of one group stay together. A group of several labels raises, or with mixed_groups is one group in each of them, dealt with that label's. Rows without a label or digest fall away."""
    parts = ordered_parts(fractions)
    own = df.withColumn("group_digest", digest)
    if not mixed_groups and not own.groupBy("group_digest").agg(F.count_distinct(label).alias("n")).where("n > 1").isEmpty():
        raise SplitViolation("groups with several labels")
    groups = own.groupBy(F.col(label).alias("l"), F.col("group_digest").alias("g")).agg(F.count("*").alias("size"))
    key = rank_key_sha2("", seed, F.col("g")) if native else rank_key("", seed, F.col("g"))
    totals = groups.groupBy(F.col("l").alias("of")).agg(F.count("*").alias("total"))
    placed = ranked(groups.withColumn("h", key), ("l",), "h", "g").withColumnRenamed("rank", "k").join(totals, F.col("l").eqNullSafe(F.col("of")))
    part, bound = None, F.lit(0)
    for name, share in parts[:-1]:
        bound = bound + F.bround(F.col("total") * share)
        part = F.when(F.col("k") <= bound, name) if part is None else part.when(F.col("k") <= bound, name)
    part = F.lit(parts[-1][0]) if part is None else part.otherwise(parts[-1][0])
    dealt = placed.select("l", "g", part.alias("part"))
    return own.join(dealt, (F.col(label) == F.col("l")) & (F.col("group_digest") == F.col("g"))).drop("l", "g", "group_digest")


def validate(df: DataFrame, digest: Column, sample_id: str = "sample_id") -> None:
    """Every id once, no group in two parts."""
    if not df.groupBy(sample_id).count().where("count > 1").isEmpty():
        raise SplitViolation("repeated ids")
    if not df.select(digest.alias("d"), "part").groupBy("d").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty():
        raise SplitViolation("a group in two parts")


def coverage(pool: DataFrame, parts: DataFrame, sample_id: str = "sample_id", part: str = "part") -> DataFrame:
    """One row: how the ids of parts (sample_id, part) cover those of pool. inputs and emitted rows, ids emitted repeatedly, ids in several parts, ids missing from parts, and extra ones. One full join of the ids."""
    there = pool.select(F.col(sample_id).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    given = parts.groupBy(F.col(sample_id).alias("j")).agg(F.count("*").alias("m"), F.count_distinct(part).alias("sides"))
    both = there.join(given, F.col("i").eqNullSafe(F.col("j")), "full_outer")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("inputs"), F.coalesce(F.sum("m"), F.lit(0)).alias("emitted"), F.count_if(F.col("m") > 1).alias("repeated"),
        F.count_if(F.col("sides") > 1).alias("shared"), F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("n").isNull()).alias("extra"),
    )


def validate_assignment(pool: DataFrame, parts: DataFrame, digest: Column, sample_id: str = "sample_id", part: str = "part") -> None:
    """Raises unless parts give every id of pool once, and no group of equal digest stands in two parts. digest is of pool's columns."""
    found = coverage(pool, parts, sample_id, part).first().asDict()
    if any(found[k] for k in ("repeated", "shared", "missing", "extra")) or found["inputs"] != found["emitted"]:
        raise SplitViolation(f"parts do not cover the pool once: {found}")
    own = pool.select(F.col(sample_id).alias("i"), digest.alias("d")).join(parts.select(F.col(sample_id).alias("j"), F.col(part).alias("part")), F.col("i") == F.col("j"))
    if not own.groupBy("d").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty():
        raise SplitViolation("a group in two parts")


def expected_counts(df: DataFrame, fractions: dict[str, float], label: str = "label") -> dict:
    """label -> part -> rows, from the labels' counts alone (rows as groups)."""
    return {r[label]: allocation(r["count"], fractions) for r in df.groupBy(label).count().collect()}
