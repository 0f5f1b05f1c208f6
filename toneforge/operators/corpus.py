"""Corpus preparation: union, screening, splitting, chunking, verification, manifest. Failed checks raise."""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import kernels as K
from ..functions import text as T
from ..functions.hashing import rank_key, rank_key_sha2


class CorpusViolation(ValueError):
    pass


def _raise_if(bad: DataFrame, what: str) -> None:
    first = bad.limit(5).collect()
    if first:
        raise CorpusViolation(f"{what}: {[r.asDict() for r in first]}")


def check_columns(df: DataFrame, required: tuple[str, ...], shard: str = "") -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise CorpusViolation(f"shard {shard!r} lacks {missing}")


def check_rows(docs: DataFrame, key: str = "document_id", content: str = "content") -> DataFrame:
    """Raises on a null or blank id or content."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    _raise_if(docs.where(blank(key) | blank(content)).select(key), "null or blank rows")
    return docs


def union_shards(shards: dict[str, DataFrame], key: str = "document_id") -> DataFrame:
    """All shards in order, with source_shard; an id that occurs twice raises."""
    parts = [df.withColumn("source_shard", F.lit(name)) for name, df in shards.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    _raise_if(whole.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "repeated ids")
    return whole


#: Reference digests up to so many rows are broadcast.
BROADCAST_ROWS = 1_000_000


def screen(docs: DataFrame, reference: DataFrame, text: str = "text", digest: Callable[[Column], Column] = T.canonical_digest) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): docs whose digest is not, or is, among the reference's. The reference's digests are broadcast if they are counted to be few."""
    refs = reference.select(digest(F.col(text)).alias("ref")).where("ref is not null").distinct()
    if refs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    own = docs.withColumn("digest", digest(F.col(text)))
    on = F.col("digest") == F.col("ref")
    return own.join(refs, on, "left_anti").drop("digest"), own.join(refs, on, "left_semi").drop("digest")


def split_documents(docs: DataFrame, n_dev: int, seed: int, key: str = "document_id", tag: str = "stage1-split", native: bool = False) -> DataFrame:
    """docs with partition: the n_dev ids of the smallest (hash, id) are dev, the rest train. The smallest are found by a sorted limit, so no task sees all rows."""
    if n_dev < 0:
        raise CorpusViolation("a negative dev size")
    name = F.col(key).cast("string")
    hashed = rank_key_sha2(tag, seed, name) if native else rank_key(tag, seed, name)
    dev = docs.select(F.col(key).alias("dev_id"), hashed.alias("h")).distinct().orderBy("h", "dev_id").limit(n_dev).select("dev_id", F.lit(True).alias("is_dev"))
    return docs.join(dev, F.col(key) == F.col("dev_id"), "left").withColumn("partition", F.when(F.col("is_dev"), "dev").otherwise("train")).drop("dev_id", "is_dev")


# --- chunks ---------------------------------------------------------------------------------------------------

_SEGMENT = re.compile(r"\s+|\S+")
Length = Callable[[str], int]


def chunk_ranges(text: str, reference_length: Length, base_length: Length, limit: int) -> list[tuple[int, int, int, int]]:
    """(start, end, reference length, base length) of chunks that tile text. A chunk takes runs of white space or not while both lengths stay within limit; a first run that does not fit alone is cut at its last safe place that does; where there is none, this raises."""
    ends = [m.end() for m in _SEGMENT.finditer(text)]

    def measured(a: int, b: int) -> tuple[int, int, int, int] | None:
        x, y = reference_length(text[a:b]), base_length(text[a:b])
        return (a, b, x, y) if x <= limit and y <= limit else None

    out, at = [], 0
    while at < len(text):
        k = bisect_right(ends, at)
        best = None
        for end in ends[k:]:
            got = measured(at, end)
            if got is None:
                break
            best = got
        if best is None:
            best = _within(text, at, ends[k], measured)
        out.append(best)
        at = best[1]
    return out


def _within(text: str, at: int, end: int, measured: Callable) -> tuple[int, int, int, int]:
    best = None
    for cut in K.safe_cuts(text[at:end]):
        got = measured(at, at + cut) if cut else None
        if got:
            best = got
        elif best:
            break
    if best is None:
        raise CorpusViolation(f"no safe cut makes characters {at} to {end} fit")
    return best


CHUNK = "chunk_id string, document_id string, partition string, chunk_index int, text string, source_start int, source_end int, reference_length int, base_length int, source_shard string"


def chunk(docs: DataFrame, reference_length: Length, base_length: Length, limit: int = 256) -> DataFrame:
    """A row for each chunk of docs (document_id, content, partition, source_shard). Documents must have their partition: the split comes first."""
    _raise_if(docs.where("partition is null or partition not in ('train', 'dev')").select("document_id"), "documents without a partition")
    _raise_if(docs.where("content is null or content = ''").select("document_id"), "documents without content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d in f.itertuples(index=False):
                for k, (a, b, x, y) in enumerate(chunk_ranges(d.content, reference_length, base_length, limit)):
                    rows.append((f"{d.document_id}#{k}", d.document_id, d.partition, k, d.content[a:b], a, b, x, y, d.source_shard))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    shard = F.col("source_shard") if "source_shard" in docs.columns else F.lit(None)
    own = docs.select(F.col("document_id").cast("string").alias("document_id"), "content", "partition", shard.cast("string").alias("source_shard"))
    return own.mapInPandas(run, CHUNK)


def verify_tiling(chunks: DataFrame, docs: DataFrame) -> None:
    """Each document's chunks follow on each other from 0 to its length and are its text."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    steps = chunks.withColumn("before", F.coalesce(F.lag("source_end").over(w), F.lit(0))).where("before <> source_start or length(text) <> source_end - source_start")
    _raise_if(steps.select("chunk_id"), "chunks that don't follow on")
    own = docs.select(F.col("document_id").cast("string").alias("d"), "content")
    wrong = chunks.join(own, F.col("document_id") == F.col("d")).where("substring(content, source_start + 1, source_end - source_start) <> text")
    _raise_if(wrong.select("chunk_id"), "chunks of other text")
    ends = chunks.groupBy("document_id").agg(F.max("source_end").alias("n")).join(own, F.col("document_id") == F.col("d"), "full_outer")
    _raise_if(ends.where("n is null or d is null or n <> length(content)").select("document_id", "d"), "documents not covered")


def verify_partitions(chunks: DataFrame) -> None:
    _raise_if(chunks.groupBy("document_id").agg(F.count_distinct("partition").alias("n")).where("n > 1"), "documents on both sides")


def membership_digest(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n and the SHA-256 of the sorted values, one a line, for each group: an identity of the set. Nulls count in n alone. A group's sorted values stream through one task, which is what such a digest takes; none is held."""
    own = df.select(*(F.col(c) for c in by), F.col(column).cast("string").alias("member"))
    names = [f"b{k}" for k in range(len(by))]
    own = own.toDF(*names, "member")
    dealt = own.repartition(*names) if names else own.repartition(1)
    schema = StructType([f for f in own.schema.fields if f.name != "member"]).add("n", "long").add("digest", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        group, n, h, lead = None, 0, None, b""
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(len(names))), strict=True)) or [()] * b.num_rows
            for key, member in zip(keys, b.column(len(names)).to_pylist(), strict=True):
                if h is None or key != group:
                    if h is not None:
                        out.append(dict(zip(names, group, strict=True)) | {"n": n, "digest": h.hexdigest()})
                    group, n, h, lead = key, 0, hashlib.sha256(), b""
                n += 1
                if member is not None:
                    h.update(lead + member.encode())
                    lead = b"\n"
        if h is not None:
            out.append(dict(zip(names, group, strict=True)) | {"n": n, "digest": h.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return dealt.sortWithinPartitions(*names, "member").mapInArrow(run, schema).toDF(*by, "n", "digest")


def keep_first(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Of rows with equal by the first one in order, whole; one aggregation with a map-side combine, no window."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*(F.col(c).alias(f"by_{c}") for c in by)).agg(first.alias("row")).select("row.*")


#: What a prepared corpus must say of itself, by dotted key; what depends on pinned revisions and sizes is given besides.
GATES = {
    "official_test_used": False, "chunking.split_before_chunk": True, "chunking.chunks_inherit_parent_partition": True, "chunking.truncation": False,
    "counts.parents_spanning_both_partitions": 0, "counts.overflow_count": 0, "contamination.official_test_screened": False,
}
PINNED = ("schema_version", "protocol_version", "source.revision", "chunking.max_length", "chunking.tokenizer_revision", "partition.seed", "partition.dev_documents", "contamination.method")


def gate_manifest(found: dict, pins: dict[str, object]) -> dict:
    """The manifest, if it passes every gate: GATES, and pins, which must name all of PINNED. A missing key fails its gate; types must agree too."""
    if missing := sorted(set(PINNED) - set(pins)):
        raise CorpusViolation(f"no pin for {missing}")
    for key, wanted in (GATES | pins).items():
        value = found
        for part in key.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        if value != wanted or type(value) is not type(wanted):
            raise CorpusViolation(f"manifest {key}: {json.dumps(value)} is not {json.dumps(wanted)}")
    return found


def manifest(chunks: DataFrame) -> DataFrame:
    """Chunks, parents and length extremes by partition."""
    return chunks.groupBy("partition").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("parents"), F.max("reference_length").alias("max_reference"), F.max("base_length").alias("max_base"), F.sum(F.length("text")).alias("characters"))


def require_compatible(found: dict, wanted: dict) -> None:
    """Raises on the first key on which two manifests differ."""
    for k in sorted(wanted):
        if found.get(k) != wanted[k]:
            raise CorpusViolation(f"manifest {k}: {json.dumps(found.get(k))} is not {json.dumps(wanted[k])}")


#: Leading hex digits by which keyed orders are cut: 65,536 even parts.
CUT = 4


def ranked(df: DataFrame, by: tuple[str, ...], key: str, tie: str) -> DataFrame:
    """df with rank, from 1 on in the order of key (hex digits of a hash) and tie within each group of by. The parts of equal leading digits are sorted each alone; how many rows come before a part is summed up over the parts' counts, CUT digits a group. So no group, however large, is sorted in one task."""
    cut = F.substring(key, 1, CUT)
    parts = df.groupBy(*by, cut.alias("cut")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*(F.col(c).alias(f"of_{c}") for c in by), F.col("cut").alias("of_cut"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = df.withColumn("cut", cut)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy(*by, "cut").orderBy(key, tie)))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "cut")]
    return own.join(starts, reduce(and_, same)).withColumn("rank", F.col("before") + F.col("place")).drop("cut", "place", "before", "of_cut", *(f"of_{c}" for c in by))


def pass_order(chunks: DataFrame, seed: int, visits: int, batch: int, key: str = "chunk_id", native: bool = False) -> DataFrame:
    """(visit, position, batch, chunk_id): for each visit all chunks in a keyed order; batches run on over the end of a visit."""
    every = chunks.select(F.col(key).alias("chunk_id"), F.explode(F.array(*(F.lit(v) for v in range(visits)))).alias("visit"))
    item = F.concat_ws("|", "visit", "chunk_id")
    h = rank_key_sha2("stage1-order", seed, item) if native else rank_key("stage1-order", seed, item)
    total = chunks.count()
    own = ranked(every.withColumn("h", h), ("visit",), "h", "chunk_id").withColumn("position", F.col("rank") - 1)
    return own.select("visit", "position", F.floor((F.col("visit") * total + F.col("position")) / batch).cast("long").alias("batch"), "chunk_id")


def cursor(order: DataFrame, visit: int, position: int) -> DataFrame:
    """What is left of an order from a place on."""
    return order.where((F.col("visit") > visit) | ((F.col("visit") == visit) & (F.col("position") >= position)))
