"""Readers, writers and integrity checks."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.corpus import CorpusViolation, check_columns


def parquet_columns(spark: SparkSession, path: str, columns: tuple[str, ...] = ("id", "content")) -> DataFrame:
    """Only the named columns are read."""
    df = spark.read.parquet(path)
    check_columns(df, columns, path)
    return df.select(*columns)


def delimited(spark: SparkSession, path: str, text: str, label: str, sample_id: str | None = None, stem: str = "row") -> DataFrame:
    """(sample_id, text, label) of a CSV, or a TSV by its suffix. Without ids they are {stem}-{place:06d}, by the place in the file."""
    sep = "\t" if path.rstrip("/").endswith((".tsv", ".tab")) else ","
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    check_columns(df, tuple(c for c in (text, label, sample_id) if c), path)
    if sample_id:
        return df.select(F.col(sample_id).alias("sample_id"), F.col(text).alias("text"), F.col(label).alias("label"))
    counted = df.select(F.col(text).alias("text"), F.col(label).alias("label")).rdd.zipWithIndex().map(lambda x: (f"{stem}-{x[1]:06d}", *x[0]))  # the file's order has no expression
    return spark.createDataFrame(counted, "sample_id string, text string, label string")


def pinned_pool(spark: SparkSession, path: str, sha256: str, rows: int, labels: dict[str, int], text: str = "text", label: str = "label", sample_id: str = "sample_id") -> DataFrame:
    """delimited and verified_pool of the one file that has the digest; that is looked at before a row is read."""
    if [r["sha256"] for r in integrity(spark, path).limit(2).collect()] != [sha256]:
        raise CorpusViolation(f"{path} is not the one file of the pinned digest")
    return verified_pool(delimited(spark, path, text, label, sample_id), rows, labels)


def verified_pool(df: DataFrame, rows: int, labels: dict[str, int]) -> DataFrame:
    """Raises unless df has so many rows and labels, unique ids and no blank text."""
    found = {str(r["label"]): r["count"] for r in df.groupBy("label").count().collect()}
    t = df.agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank")).first()
    if t["n"] != rows or found != labels or t["ids"] != rows or t["blank"]:
        raise CorpusViolation(f"pool has {t.asDict()} and labels {found}")
    return df


def first_present(df: DataFrame, names: tuple[str, ...] = ("text", "sentence", "content")) -> DataFrame:
    """df with text: the first of the named columns that holds something."""
    there = [F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns]
    if not there:
        raise CorpusViolation(f"none of {names}")
    return df.withColumn("text", F.coalesce(*there))


def lines(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Non-empty lines as text; most is a sample's size."""
    df = spark.read.text(path).select(F.col("value").alias("text")).where("text <> ''")
    return df if most is None else df.limit(most)


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def prepared_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks; both partitions must have some."""
    df = jsonl(spark, path, schema)
    sides = {r["partition"] for r in df.select("partition").distinct().collect()}
    if not {"train", "dev"} <= sides:
        raise CorpusViolation(f"partitions {sorted(map(str, sides))}")
    return df


def artifact(rows: object) -> str:
    """Sorted JSON, not ASCII-escaped."""
    return json.dumps(rows, sort_keys=True, ensure_ascii=False, indent=2) + "\n"


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files under a path, with all its folders, read by the executors; a file is one value, so of up to 2 GB. name is the path below the given one, or a lone file's own name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.regexp_extract("path", "\\Q" + path.split("://")[-1].rstrip("/") + "\\E/(.+)$", 1)
    return df.select(F.coalesce(F.nullif(below, F.lit("")), F.regexp_extract("path", "[^/]+$", 0)).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(spark: SparkSession, path: str, pins: Iterable[tuple[str, int, str]]) -> None:
    """Raises unless every pinned file is there with its size and digest. Call it before reading a row."""
    wanted = spark.createDataFrame(list(pins), "name string, bytes long, sha256 string")
    bad = wanted.join(integrity(spark, path), ["name", "bytes", "sha256"], "left_anti")
    if not bad.isEmpty():
        raise CorpusViolation(f"files that differ: {[r['name'] for r in bad.collect()]}")


def word_list(spark: SparkSession, path: str, entries: int | None = None, sha256: str | None = None) -> DataFrame:
    """(form): lines of a pinned list."""
    if sha256 is not None and [r["sha256"] for r in integrity(spark, path).limit(2).collect()] != [sha256]:
        raise CorpusViolation("the word list is not the one file of that digest")
    df = spark.read.text(path).select(F.trim("value").alias("form")).where("form <> ''")
    if entries is not None and (n := df.count()) != entries:
        raise CorpusViolation(f"{n} entries, not {entries}")
    return df


def write_once(df: DataFrame, path: str, check=None) -> None:
    """Writes beside path, checks what was written, and moves it there; refuses to overwrite."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.partial"
    df.write.mode("overwrite").parquet(part)
    if check is not None:
        check(spark.read.parquet(part))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), target):
        raise OSError(f"could not move {part}")


def write_ids(df: DataFrame, path: str, column: str) -> None:
    """Sorted ids, one a line, in files whose order is that of the ids."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def read_ids(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """(id); with a digest, the SHA-256 of the sorted lines must be it."""
    df = spark.read.text(path).select(F.col("value").alias("id")).where("id <> ''")
    if digest is not None:
        from ..operators.corpus import membership_digest

        if membership_digest(df, "id").first()["digest"] != digest:
            raise CorpusViolation("the ids have another digest")
    return df
