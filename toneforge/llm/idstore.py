"""Token-id output: a content-addressed store of id streams.

A document's ids are cut where a rolling hash over the last ids has its low bits zero, so equal stretches are cut
alike wherever they stand. A chunk is named by its digest and stored once, in the row of the first document that
holds it. The store is a folder of Parquet tables in ascending order of doc_id:

* kind=doc: one row a document: its recipe (sizes and digests of all chunks, and for each whether the row itself
  stores it), the ids of the chunks that it stores, and its root, the digest of its chunks' digests;
* kind=pack: one row a file: documents, ids and the root of its documents' roots;
* manifest: where each pack starts in the stream, and the root of all packs.

Reading puts each document together from its own row; only chunks of other rows are joined by digest. Digests and
roots of all levels are computed anew from what was read and must agree.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, merged, shared_path, small_batches, spool, text_bytes
from .tokens import encoder

END = 2
WINDOW, LEAST, MOST, MASK = 8, 64, 2048, np.uint64(0xFF)
DIGEST = 16
BLOCK = 8 << 20
#: A pack holds about so many bytes of ids, and no more documents than that.
PACK_BYTES, PACK_DOCS = 32 << 20, 200_000
#: How a row has a chunk: stores it alone, stores it for others too, finds it in another row.
OWN, SHARED, FOREIGN = range(3)


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For rows of ids that end at ends: where their chunks end. By content alone: a chunk has LEAST to MOST ids, but for a row's last."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    h, power = x.copy(), 1
    for k in range(1, WINDOW):
        power = power * 0xD1342543DE82EF95 % (1 << 64)
        h[k:] += x[:-k] * np.uint64(power)
    hits = np.flatnonzero((h >> np.uint64(40) & MASK) == 0) + 1
    out, begin = [], 0
    at = np.searchsorted(hits, np.concatenate([[0], ends]))
    for k, end in enumerate(ends.tolist()):
        own, last = [], begin
        for hit in hits[at[k] : at[k + 1]].tolist():
            while hit - last > MOST:
                last += MOST
                own.append(last)
            if hit - last >= LEAST and hit < end:
                own.append(hit)
                last = hit
        while end - last > MOST:
            last += MOST
            own.append(last)
        if end > last:
            own.append(end)
        out.append(own)
        begin = end
    return out


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(rid, doc_id, n_tokens, wide, sizes, digests, ids): rid numbers the rows; written out, it is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        rid = TaskContext.get().partitionId() << 33
        size = own.kind.itemsize
        for b in merged(batches, "text", BLOCK):
            ids, counts = own.encode(*text_bytes(col(b, "text")))
            ids = np.insert(ids, np.cumsum(counts), own.kind.type(end_id))
            ends = np.cumsum(counts + 1)
            raw = ids.tobytes()
            sizes, digests, begin = [], [], 0
            for own_ends in chunk_ends(ids, ends):
                starts = [begin, *own_ends[:-1]]
                sizes.append(np.subtract(own_ends, starts).astype("<i4").tobytes())
                digests.append(b"".join([digest(raw[a * size : e * size]) for a, e in zip(starts, own_ends, strict=True)]))
                begin = own_ends[-1]
            whole = [raw[a * size : e * size] for a, e in zip((ends - counts - 1).tolist(), ends.tolist(), strict=True)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), col(b, "doc_id").cast(pa.int64()), pa.array(counts + 1), pa.array(np.full(n, size, np.int32)), pa.array(sizes, pa.binary()), pa.array(digests, pa.binary()), pa.array(whole, pa.binary())], ["rid", "doc_id", "n_tokens", "wide", "sizes", "digests", "ids"])
            rid += n

    return docs.select("doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_tokens long, wide int, sizes binary, digests binary, ids binary")


def _dicts(b: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one, some of them made at a time."""
    for at in range(0, b.num_rows, 200):
        yield from b.slice(at, 200).to_pylist()


def _split(raw: bytes, n: int = DIGEST) -> list[bytes]:
    return [raw[k : k + n] for k in range(0, len(raw), n)]


def _references(rows: DataFrame, flag: int | None = None) -> DataFrame:
    """(digest, rid, doc_id) for the distinct chunks of each row; flag: only those that the row has so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = [], []
            flags = col(b, "flags").to_pylist() if flag is not None else None
            for k, raw in enumerate(col(b, "digests").to_pylist()):
                names = dict.fromkeys(_split(raw) if flags is None else [d for d, f in zip(_split(raw), flags[k], strict=True) if f == flag])
                found += names
                at += [k] * len(names)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), col(b, "rid").take(at), col(b, "doc_id").take(at)], ["digest", "rid", "doc_id"])

    columns = ["rid", "doc_id", "digests", *(["flags"] if flag is not None else [])]
    return rows.select(*columns).mapInArrow(run, "digest binary, rid long, doc_id long")


_DOC = "doc_id long, rid long, n_tokens long, wide int, sizes binary, digests binary, flags binary, ids binary, root binary, pack int, at_id long, has_shared boolean, has_foreign boolean, n_docs long, kind string"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of doc_id and rid, each after the notes on its shared chunks: stores what the row owns, and ends with the pack's own row."""
    names = [f.split()[0] for f in _DOC.split(", ")]
    schema = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]]) for n, f in zip(names, _DOC.split(", "), strict=True)])
    pack, tokens, docs, roots = TaskContext.get().partitionId(), 0, 0, hashlib.sha256()
    notes: dict[bytes, bool] = {}
    out: list[dict] = []
    held = 0
    for b in batches:
        for r in _dicts(b):
            if r["ids"] is None:
                notes[r["digests"]] = r["mine"]
                continue
            names_, sizes = _split(r["digests"]), np.frombuffer(r["sizes"], "<i4")
            kept, flags, seen, begin = [], bytearray(), set(), 0
            for d, n in zip(names_, sizes.tolist(), strict=True):
                mine = notes.get(d, True)
                flags.append(FOREIGN if not mine else SHARED if d in notes else OWN)
                if mine and d not in seen:
                    kept.append(r["ids"][begin * r["wide"] : (begin + n) * r["wide"]])
                    seen.add(d)
                begin += n
            notes = {}
            root = digest(r["digests"])
            out.append({"doc_id": r["doc_id"], "rid": r["rid"], "n_tokens": r["n_tokens"], "wide": r["wide"], "sizes": r["sizes"], "digests": r["digests"], "flags": bytes(flags), "ids": b"".join(kept), "root": root, "pack": pack, "at_id": tokens, "has_shared": SHARED in flags, "has_foreign": FOREIGN in flags, "n_docs": 1, "kind": "doc"})
            tokens, docs, held = tokens + r["n_tokens"], docs + 1, held + len(out[-1]["ids"])
            roots.update(root)
            if held > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
    if docs:
        out.append({"n_tokens": tokens, "root": roots.digest(), "pack": pack, "n_docs": docs, "kind": "pack"})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = END) -> str:
    """Encodes docs (doc_id, text), each followed by end_id, and writes the store. Returns its path. Ids must be whole numbers. A null text counts as empty and has its end alone; rows of one doc_id stay apart, null ids come first; long texts are kept whole; an empty table makes a store without documents; other columns are not read, whatever their names."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "idstore")
    small_batches(spark)
    rows = spool(_encoded(docs, vocabulary, end_id), "idstore-encoded")
    size = rows.agg(F.sum(F.col("n_tokens") * F.col("wide")).alias("b"), F.count("*").alias("n")).first()
    packs = max(1, -(-(size["b"] or 0) // PACK_BYTES), -(-size["n"] // PACK_DOCS))
    refs = _references(rows)
    owners = refs.groupBy("digest").agg(F.min("rid").alias("owner"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("name"), "owner")
    notes = refs.join(owners, F.col("digest") == F.col("name")).select("rid", "doc_id", F.col("digest").alias("digests"), (F.col("rid") == F.col("owner")).alias("mine"))
    every = rows.withColumn("mine", F.lit(None).cast("boolean")).unionByName(notes, allowMissingColumns=True)
    ordered = every.repartitionByRange(packs, "doc_id", "rid").sortWithinPartitions("doc_id", "rid", F.col("ids").isNotNull())
    ordered.mapInArrow(_pack, _DOC).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    packed = spark.read.schema(_DOC).parquet(path).where("kind = 'pack'").select("pack", "n_docs", "n_tokens", "root").orderBy("pack").collect()  # one row a file
    first, table = 0, []
    for p in packed:
        table.append((p["pack"], first, p["n_docs"], p["n_tokens"], bytes(p["root"])))
        first += p["n_tokens"]
    whole = merkle([t[4] for t in table])
    spark.createDataFrame([(*t, whole) for t in table], "pack int, first long, n_docs long, n_tokens long, root binary, whole binary").coalesce(1).write.parquet(f"{path}-manifest")
    return path


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256 over the leaves; of none: the hash of nothing."""
    level = list(leaves) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + (level[k + 1] if k + 1 < len(level) else b"")).digest() for k in range(0, len(level), 2)]
    return level[0]


def _whole(r: dict, foreign: dict[bytes, bytes]) -> bytes:
    """A row's ids; every chunk must have its digest."""
    at, seen, out = 0, {}, []
    for d, n, f in zip(_split(r["digests"]), np.frombuffer(r["sizes"], "<i4").tolist(), r["flags"], strict=True):
        if f == FOREIGN:
            part = foreign[d]
        elif d in seen:
            part = seen[d]
        else:
            part = seen[d] = r["ids"][at : at + n * r["wide"]]
            at += n * r["wide"]
        if digest(part) != d or len(part) != n * r["wide"]:
            raise ValueError(f"a chunk of row {r['rid']} is not what its digest says")
        out.append(part)
    if digest(r["digests"]) != r["root"]:
        raise ValueError(f"the recipe of row {r['rid']} is not what its root says")
    return b"".join(out)


_READ = "doc_id long, rid long, pack int, at_id long, n_tokens long, root binary, ids binary, wide int"


def _assemble(batches: Iterator[pa.RecordBatch], checksum_only: bool) -> Iterator[pa.RecordBatch]:
    foreign: dict[bytes, bytes] = {}
    for b in batches:
        out = []
        for r in _dicts(b):
            if r["flags"] is None:
                foreign[r["digests"]] = r["ids"]
                continue
            ids = np.frombuffer(_whole(r, foreign), f"<u{r['wide']}")
            foreign = {}
            row = {k: r[k] for k in ("doc_id", "rid", "pack", "at_id", "root")} | {"n_tokens": len(ids)}
            out.append(row | ({"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())} if checksum_only else {"ids": ids.tobytes(), "wide": r["wide"]}))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([(k, {"root": pa.binary(), "ids": pa.binary(), "pack": pa.int32(), "wide": pa.int32()}.get(k, pa.int64())) for k in out[0]]))


def read(spark: SparkSession, path: str, checksum_only: bool = False) -> DataFrame:
    """(doc_id, rid, pack, at_id, root, n_tokens, and ids with their width in bytes or ids_crc32) of each document, put together and verified; repeated rows are documents of their own, a store without documents gives none."""
    small_batches(spark)
    docs = spark.read.schema(_DOC).parquet(path).where("kind = 'doc'").drop("kind", "n_docs")
    shared = docs.where("has_shared").select("rid", "wide", "sizes", "digests", "flags", "ids").mapInArrow(_shared, "name binary, chunk binary")
    wanted = _references(docs.where("has_foreign"), FOREIGN)
    brought = wanted.join(shared, F.col("digest") == F.col("name")).select("rid", F.col("digest").alias("digests"), F.col("chunk").alias("ids"))
    lone = docs.where("not has_foreign")
    mixed = docs.where("has_foreign").unionByName(brought, allowMissingColumns=True)
    mixed = mixed.repartition("rid").sortWithinPartitions("rid", F.col("flags").isNotNull())
    schema = "doc_id long, rid long, pack int, at_id long, root binary, n_tokens long, " + ("ids_crc32 long" if checksum_only else "ids binary, wide int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _assemble(batches, checksum_only)

    return lone.mapInArrow(run, schema).unionByName(mixed.mapInArrow(run, schema))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks that rows store for others too."""
    for b in batches:
        names, chunks = [], []
        for r in b.to_pylist():
            at, seen = 0, set()
            for d, n, f in zip(_split(r["digests"]), np.frombuffer(r["sizes"], "<i4").tolist(), r["flags"], strict=True):
                if f != FOREIGN and d not in seen:
                    seen.add(d)
                    if f == SHARED:
                        names.append(d)
                        chunks.append(r["ids"][at : at + n * r["wide"]])
                    at += n * r["wide"]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], ["name", "chunk"])


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the store; raises if a chunk, a recipe, a pack or the manifest is not what its digest says. Rows of one doc_id follow on each other; a store without documents gives no rows."""
    got = spool(read(spark, path, checksum_only=True), "idstore-read")
    manifest = spark.read.parquet(f"{path}-manifest")
    rows = manifest.orderBy("pack").collect()  # one row a file
    if rows and merkle([bytes(r["root"]) for r in rows]) != bytes(rows[0]["whole"]):
        raise ValueError("the manifest's root does not fit its packs")
    roots = got.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("doc_id", "rid", F.hex("root").alias("root")))).alias("l"), F.sum("n_tokens").alias("n"))  # a pack is one file's rows
    mine = roots.select(F.col("pack").alias("p"), F.sha2(F.unhex(F.concat_ws("", "l.root")), 256).alias("sha"), "n")
    wrong = manifest.join(mine, F.col("pack") == F.col("p"), "full_outer").where("sha is null or root is null or sha <> lower(hex(root)) or n <> n_tokens")
    if not wrong.isEmpty():
        raise ValueError("a pack's root does not fit its documents")
    starts = manifest.select(F.col("pack").alias("p"), "first")
    return got.join(starts, F.col("pack") == F.col("p")).select("doc_id", (F.col("first") + F.col("at_id")).alias("start"), "n_tokens", "ids_crc32")
