"""Profiles of labelled splits, duplicates, distributions and noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PERCENTILES = (25, 50, 75, 90, 95, 99)
LENGTHS = (64, 128, 256)


def distribution(df: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """count, min, nearest-rank percentiles, max and mean, by group. The percentiles are exact."""
    own = df.select(*by, value.cast("double").alias("v")).where("v is not null")
    cut = [F.expr(f"percentile_disc({q / 100}) within group (order by v)").alias(f"p{q}") for q in PERCENTILES]
    return own.groupBy(*by).agg(F.count("v").alias("count"), F.min("v").alias("min"), *cut, F.max("v").alias("max"), F.avg("v").alias("mean"))


def duplicates(df: DataFrame, digest: Column, split: str = "split", label: str = "label", sample_id: str = "sample_id", most: int | None = None) -> DataFrame:
    """(digest, size, splits, labels, sample_ids) of groups of two or more. most: list so many ids of a group alone, the least; size counts all. Without it a group's ids are all put into one row, so give it where a group (of empty texts, say) may be large."""
    own = df.select(digest.alias("digest"), F.col(split).alias("s"), F.col(label).alias("l"), F.col(sample_id).alias("i")).where("digest is not null")
    listed = own.groupBy("digest").agg(F.count("*").alias("size"), F.sort_array(F.collect_set("s")).alias("splits"), F.sort_array(F.collect_set("l")).alias("labels"), *([F.sort_array(F.collect_list("i")).alias("sample_ids")] if most is None else [F.array_compact(F.array(F.min("i"))).alias("sample_ids")] if most == 1 else []))
    if most is None or most == 1:
        return listed.where("size > 1")
    least = own.withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("i"))).where(F.col("k") <= most)  # limited before the shuffle
    ids = least.groupBy(F.col("digest").alias("d")).agg(F.sort_array(F.collect_list("i")).alias("sample_ids"))
    return listed.where("size > 1").join(ids, F.col("digest") == F.col("d")).drop("d")


def conflicting(groups: DataFrame) -> DataFrame:
    return groups.where("size(labels) > 1")


def cross_split(groups: DataFrame) -> DataFrame:
    return groups.where("size(splits) > 1")


def without_conflicts(df: DataFrame, digest: Column, label: str = "label") -> DataFrame:
    """df without the whole groups that have several labels."""
    bad = df.select(digest.alias("bad"), F.col(label).alias("l")).groupBy("bad").agg(F.count_distinct("l").alias("n")).where("n > 1").select("bad")
    return df.withColumn("own_digest", digest).join(bad, F.col("own_digest") == F.col("bad"), "left_anti").drop("own_digest")


def excess(df: DataFrame, digest: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows beyond the first of each digest, and the groups with such rows."""
    sizes = df.select(*by, digest.alias("digest")).groupBy(*by, "digest").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_excess"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def profile(df: DataFrame, split: str = "split", text: str = "text", label: str = "label", observe: Callable[[Column], Column] = T.observe_orthography) -> DataFrame:
    """One row a split: labels of all rows, and of rows with text the orthography, duplicates, lengths and noise."""
    filled = F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    own = df.select(F.col(split).alias("split"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"), filled.alias("filled"))
    labels = own.groupBy("split", "label").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))
    seen = own.where("filled").withColumn("o", observe(F.col("text"))).withColumn("noise", T.noise(F.col("text")))
    sums = {
        "canon_changed": F.count_if("o.canon_changed"), "base_equivalent": F.count_if("o.base_equivalent"), "with_tone": F.count_if(F.col("o.units_with_observed_tone") > 0), "with_letter": F.count_if(F.col("o.units_with_observed_letter") > 0),
        **{c: F.sum(f"o.{c}") for c in ("tone_eligible_syllables", "tone_observed_syllables", "letter_eligible_units", "letter_observed_units")}, **{n: F.sum(f"noise.{n}") for n in T.NOISE},
    }
    counted = seen.groupBy("split").agg(F.count("*").alias("texts"), *(v.alias(k) for k, v in sums.items()))
    for kind, digest in (("exact", T.text_digest(F.col("text"))), ("canonical", T.canonical_digest(F.col("text")))):
        found = excess(seen, digest, ("split",)).select("split", F.col("duplicate_excess").alias(f"{kind}_duplicate_excess"))
        counted = counted.join(found, "split")
    clash = seen.select("split", "label", T.canonical_digest(F.col("text")).alias("d")).groupBy("split", "d").agg(F.count_distinct("label").alias("n")).groupBy("split").agg(F.count_if(F.col("n") > 1).alias("conflicting_groups"))
    return labels.join(counted.join(clash, "split"), "split", "left").withColumn("tone_density", density(F.col("tone_observed_syllables"), F.col("tone_eligible_syllables"))).withColumn("letter_density", density(F.col("letter_observed_units"), F.col("letter_eligible_units")))


def density(observed: Column, eligible: Column) -> Column:
    """Null where nothing is eligible."""
    return observed / F.nullif(eligible, F.lit(0))


def length_coverage(df: DataFrame, vanilla: Column, base: Column, thresholds: tuple[int, ...] = LENGTHS) -> DataFrame:
    """For each threshold the shares of both lengths within it, the smaller of them, and its rest."""
    shares = [F.struct(F.lit(t).alias("threshold"), F.avg((vanilla <= t).cast("double")).alias("vanilla"), F.avg((base <= t).cast("double")).alias("base")) for t in thresholds]
    out = df.agg(F.array(*shares).alias("a")).select(F.inline("a"))
    return out.withColumn("joint", F.least("vanilla", "base")).withColumn("overflow", 1 - F.least("vanilla", "base"))


def token_lengths(df: DataFrame, tokenizer: Callable[[str], list[int]], text: str = "text", specials: int = 2, unknown_id: int | None = None) -> DataFrame:
    """df with vanilla and base: lengths in tokens, specials counted, of the canonical and of the base text; and vanilla_unknown and base_unknown, kept apart. tokenizer: a Python callable of a text."""

    def measure(t: str) -> dict:
        ids = tokenizer(t)
        return {"n": len(ids) + specials, "u": 0 if unknown_id is None else sum(i == unknown_id for i in ids)}

    run = T.mapped(measure, "n int, u int")
    own = df.withColumn("v", run(T.canon(F.col(text)))).withColumn("b", run(T.strip_to_base(F.col(text))))
    return own.select(*df.columns, F.col("v.n").alias("vanilla"), F.col("b.n").alias("base"), F.col("v.u").alias("vanilla_unknown"), F.col("b.u").alias("base_unknown"))


def token_profile(lengths: DataFrame) -> DataFrame:
    """One row of token_lengths: the distributions of both lengths and of their difference, how many rows it changes, unknown tokens by pathway."""
    parts = {"vanilla": F.col("vanilla"), "base": F.col("base"), "delta": F.col("base") - F.col("vanilla")}
    out = lengths.agg(F.sum("vanilla_unknown").alias("vanilla_unknown"), F.sum("base_unknown").alias("base_unknown"), F.count_if(F.col("base") != F.col("vanilla")).alias("changed"), F.avg((F.col("base") != F.col("vanilla")).cast("double")).alias("changed_share"))
    for name, value in parts.items():
        out = out.crossJoin(distribution(lengths, value).select(F.struct("*").alias(name)))  # one row each
    return out


def length_delta(df: DataFrame, vanilla: Column, base: Column) -> DataFrame:
    """Distribution of base less vanilla lengths, and how many rows change."""
    own = df.select((base - vanilla).alias("d"))
    changed = own.agg(F.count_if(F.col("d") != 0).alias("changed"), F.avg((F.col("d") != 0).cast("double")).alias("changed_share"))
    return distribution(own, F.col("d")).crossJoin(changed)  # one row each
