import pytest
from pyspark.sql import functions as F

from toneforge.functions import kernels as K
from toneforge.functions import text as T
from toneforge.operators import align, corpus, corruption, inventory, metrics, profile, smoke, split
from toneforge.sources import files

SAMPLES = [("a", "Tôi đang nghiên cứu hòa bình."), ("b", "café Đà Nẵng"), ("c", ""), ("d", "no marks")]


def docs(spark):
    return spark.createDataFrame(SAMPLES, "sample_id string, text string")


@pytest.mark.parametrize("name", [c[0] for c in corruption.CONDITIONS])
def test_corruption_invariants(spark, name):
    rows = corruption.corrupt(docs(spark), name, 42).collect()
    for r in rows:
        c = r.corruption
        assert K.strip(c.canonical_clean_text) == K.strip(c.corrupted_text)
        assert K.canon(c.corrupted_text) == c.corrupted_text
        assert all(d.selected or not d.modified for d in c.decisions)
        if name == "FULL":
            assert c.corrupted_text == c.canonical_clean_text
        if name == "STRIP_ALL":
            assert c.corrupted_text == K.strip(r.text)


def test_corruption_with_inventory(spark):
    forms = frozenset({"toi", "dang", "da", "nang"})
    r = {x.sample_id: x.corruption for x in corruption.corrupt(docs(spark), "p100", 42, inventory=forms, scientific=True).collect()}
    assert r["b"].corrupted_text == "café Đa Năng" and r["b"].scored_units == 2
    with pytest.raises(corruption.UnresolvedEligibility):
        corruption.corrupt(docs(spark), "P50", 1, scientific=True)
    with pytest.raises(corruption.UnknownCondition):
        corruption.condition("p10")
    rates = corruption.corrupt(docs(spark), "P50", 42).select(corruption.rates(F.col("corruption")).alias("r"), "sample_id").collect()
    assert {x.sample_id: x.r.realized_rate for x in rates}["c"] is None


def test_screen_and_partition(spark):
    a = spark.createDataFrame([(1, "hòa"), (2, "x"), (3, None)], "doc_id long, text string")
    kept, out = corpus.screen(a, spark.createDataFrame([("hoà",)], "text string"))
    assert [r.doc_id for r in out.collect()] == [1] and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    ids = spark.range(2000).select(F.col("id").cast("string").alias("document_id"))
    one = corpus.split_documents(ids, 500, 51733)
    assert one.where("partition = 'dev'").count() == 500 and one.count() == 2000
    again = corpus.split_documents(ids.orderBy(F.desc("document_id")), 500, 51733)
    assert one.exceptAll(again).isEmpty()
    with pytest.raises(corpus.CorpusViolation):
        corpus.union_shards({"x": ids, "y": ids.limit(1)})
    with pytest.raises(corpus.CorpusViolation):
        corpus.check_rows(a.withColumnRenamed("doc_id", "document_id").withColumnRenamed("text", "content"))


def test_chunks_tile(spark):
    rows = [("a", "một hai  ba\nbốn năm " * 30, "train"), ("b", "x" * 5 + " " + "đường-" * 20, "dev"), ("c", "  lead", "dev")]
    d = spark.createDataFrame(rows, "document_id string, content string, partition string").withColumn("source_shard", F.lit("s"))
    c = corpus.chunk(d, lambda t: len(t) + 2, lambda t: len(t.split()) + 4, 30).cache()
    corpus.verify_tiling(c, d)
    corpus.verify_partitions(c)
    assert c.where("reference_length > 30 or base_length > 30").isEmpty()
    assert corpus.manifest(c).count() == 2
    with pytest.raises(Exception, match="safe cut"):
        corpus.chunk_ranges("x" * 50, len, len, 10)
    with pytest.raises(corpus.CorpusViolation):
        corpus.verify_tiling(c.where("chunk_index <> 1"), d)


def test_split_counts_and_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("sample_id"), (F.col("id") % 3).alias("label"), F.concat(F.lit("t"), F.floor(F.col("id") / 6) * 3 + F.col("id") % 3).alias("text"))
    got = split.stratified(df, {"train": 0.8, "validation": 0.2}, 17486, T.text_digest(F.col("text")))
    split.validate(got, T.text_digest(F.col("text")))
    assert split.allocation(5324, {"train": 0.8, "validation": 0.2}) == {"train": 4259, "validation": 1065}
    assert sum(split.allocation(n, {"train": 0.8, "validation": 0.2})["train"] for n in (5324, 458, 5642)) == 9139
    with pytest.raises(split.SplitViolation):
        split.stratified(df.withColumn("label", F.col("sample_id")), {"a": 0.5, "b": 0.5}, 1, T.text_digest(F.col("text")))


def test_profile_and_duplicates(spark):
    rows = [("a", "xin chào", "p", "train"), ("b", "tốt", "p", "train"), ("c", "!!! @me #t http://x.y 😀 a1", "n", "train"), ("d", "xin chào", "n", "test"), ("e", "  ", "n", "test")]
    df = spark.createDataFrame(rows, "sample_id string, text string, label string, split string")
    p = {r.split: r for r in profile.profile(df).collect()}
    assert p["test"].rows == 2 and p["test"].texts == 1 and p["train"].urls == 1 and p["train"].mentions == 1 and p["train"].repeated_char_runs == 1 and p["train"].emoji_or_symbols == 1
    g = profile.duplicates(df, T.canonical_digest(F.col("text")))
    assert g.count() == 1 and profile.conflicting(g).count() == 1 and profile.cross_split(g).first().sample_ids == ["a", "d"]
    assert sorted(r.sample_id for r in profile.without_conflicts(df, T.canonical_digest(F.col("text"))).collect()) == ["b", "c", "e"]
    d = profile.distribution(spark.range(1, 101), F.col("id")).first()
    assert (d.p50, d.p99, d.min, d.max) == (50, 99, 1, 100)


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (1, 0), (0, 0)], "prediction int, label int")
    assert metrics.accuracy(df).first().accuracy == 0.75
    t = {r.label: r for r in metrics.class_scores(df, classes=3).collect()}
    assert (t[0].true_positive, t[0].false_negative, t[1].false_positive, t[2].f1) == (2, 1, 1, 0.0)
    assert metrics.gap_recovery(72, 60, 84) == 0.5 and metrics.gap_recovery(48, 60, 84) == -0.5
    with pytest.raises(ZeroDivisionError):
        metrics.gap_recovery(1, 2, 2)
    points = spark.createDataFrame([(500, 0.4, 0.2), (1000, 0.3, 0.1), (1500, 0.3, 0.1), (2000, 0.3, 0.2)], "update int, score double, d_clean double")
    assert metrics.best_checkpoint(points).first().update == 1000
    assert metrics.evaluation_updates(12, 4) == [0, 4, 8, 12]
    with pytest.raises(ValueError):
        metrics.evaluation_updates(10, 4)
    one = spark.createDataFrame([(1.0,)], "x double").agg(metrics.sample_deviation(F.col("x")).alias("a"), metrics.sample_deviation(F.col("x"), 0.0).alias("b")).first()
    assert one.a is None and one.b == 0.0


def test_alignment_and_channels(spark):
    text = "nghiên cứu. x1"
    d = spark.createDataFrame([(1, K.strip(text), text)], "doc_id long, text string, raw string")
    cut = {"nghien": (["nghi@@", "en"], [1, 2]), "cuu.": (["cuu@@", "."], [3, 4]), "x1": (["x@@", "2"], [5, 0])}
    a = align.align(align.tokenized(align.chunks(d), lambda t: cut[t]), unknown_id=0)
    assert [r.failure_reason for r in a.orderBy("chunk_index").collect()] == [None, None, "SURFACE_MISMATCH"]
    p = align.pieces(a)
    r = align.regions(d, inventory=frozenset({"nghien", "cuu"}), text="raw")
    o = align.overlay(p, r)
    labels = d.select("doc_id", align.character_labels(T.decompose(F.col("raw"))).alias("labels"))
    got = align.project(o, r, labels).orderBy("piece_index").collect()
    assert [(x.ownership, x.tone_label, x.letter_label) for x in got] == [("SINGLE_CANDIDATE", "UNMARKED", "NONE"), ("SINGLE_CANDIDATE", "UNMARKED", "NONE"), ("SINGLE_CANDIDATE", "SAC", "NONE"), ("NOT_APPLICABLE", "NA", "NA")]
    grid = align.compose(a)
    assert align.verify_grid(grid, grid).first().equal
    wide = align.padded(spark.createDataFrame([(0, [1]), (0, [1, 2, 3])], "b int, ids array<int>"), "b", {"ids": 9}).collect()
    assert sorted(x.ids for x in wide) == [[1, 2, 3], [1, 9, 9]]


def test_inventory(spark):
    forms = inventory.build(spark.createDataFrame([("Hòa",), ("đi",), (" ",)], "form string"))
    assert sorted(r.form for r in forms.collect()) == ["di", "hoa"]
    spans = spark.createDataFrame([("Hoa",), ("x9",), ("cafe",)], "base_text string")
    assert {r.base_text: r.eligibility for r in inventory.resolve(spans, forms).collect()} == {"Hoa": "VIETNAMESE_CANDIDATE", "x9": "NOT_APPLICABLE", "cafe": "NOT_APPLICABLE"}
    assert inventory.resolve(spans, None).first().eligibility == "UNDECIDED"


def test_smoke_records(spark):
    rows = [("1", "k", "hoa binh", "hòa bình", "hòa bình", 0.1, None), ("2", "k", "a b", "a  b.", "a  b", 0.2, None), ("3", "m", "x", None, None, None, "boom")]
    r = smoke.records(spark.createDataFrame(rows, "id string, category string, text string, output string, repeat string, seconds double, error string"))
    got = {x.id: x for x in r.collect()}
    assert got["1"].base_preserved and got["2"].formatting_only and not got["2"].deterministic and got["3"].base_preserved is None
    assert smoke.summarize(r).count() == 3 and not smoke.engineering_status(r).first().passed


def test_files(spark, tmp_path):
    p = tmp_path / "pool.csv"
    p.write_text('id,text,label\n1,"a, b",x\n2,c,y\n')
    df = files.delimited(spark, str(p), "text", "label", "id")
    files.verified_pool(df, 2, {"x": 1, "y": 1})
    assert [r.sample_id for r in files.delimited(spark, str(p), "text", "label").orderBy("sample_id").collect()] == ["row-000000", "row-000001"]
    pin = files.integrity(spark, str(p)).first()
    files.verify(spark, str(p), [(pin.name, pin.bytes, pin.sha256)])
    with pytest.raises(corpus.CorpusViolation):
        files.verify(spark, str(p), [(pin.name, pin.bytes, "0" * 64)])
    out = f"file://{tmp_path}/out"
    files.write_once(df, out)
    with pytest.raises(FileExistsError):
        files.write_once(df, out)
    files.write_ids(df, f"{tmp_path}/ids", "sample_id")
    digest = corpus.membership_digest(df, "sample_id").first().digest
    assert files.read_ids(spark, f"{tmp_path}/ids", digest).count() == 2


def test_streaming_is_stateless(spark, tmp_path):
    from toneforge.streaming import stateless

    docs(spark).write.parquet(f"{tmp_path}/in")
    s = stateless.normalized(spark.readStream.schema("sample_id string, text string").parquet(f"{tmp_path}/in"))
    q = s.writeStream.format("memory").queryName("normalized").start()
    q.processAllAvailable()
    q.stop()
    assert {r.sample_id: r.canonical for r in spark.table("normalized").collect()} == {i: K.canon(t) for i, t in SAMPLES}


def test_a_text_of_several_labels_is_dealt_with_each(spark, tmp_path):
    from toneforge.plans import catalogue

    rows = [(k, f"text {k // 2}", "a" if k % 2 else "b", "s", 6) for k in range(40)] + [(99, "text 1", None, "s", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("stratified_split", "stratified_split_sha2"):
        got = catalogue.queries()[name](spark, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in got) == list(range(40))
        assert [sum(r.part == "train" and r.lang == lang for r in got) for lang in "ab"] == [16, 16]
