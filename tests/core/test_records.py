"""Assignments, path comparisons, budgets, token profiles, runs, pins and manifest gates."""

import json

import pytest
from pyspark.sql import functions as F

from toneforge.functions import kernels as K
from toneforge.functions import text as T
from toneforge.operators import align, corpus, metrics, profile, split
from toneforge.sources import runs


def test_coverage_counts_each_fault(spark):
    pool = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "sample_id string")
    parts = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("z", "x"), (None, "y")], "sample_id string, part string")
    assert split.coverage(pool, parts).first().asDict() == {"inputs": 4, "emitted": 6, "repeated": 2, "shared": 1, "missing": 1, "extra": 1}
    assert split.coverage(pool.limit(0), parts.limit(0)).first().inputs == 0


def test_validate_assignment(spark):
    pool = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "sample_id string, text string")
    digest = F.sha2("text", 256)
    split.validate_assignment(pool, spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "sample_id string, part string"), digest)
    for parts in ([("a", "x"), ("b", "y"), ("c", "y")], [("a", "x"), ("b", "x")], [("a", "x"), ("b", "x"), ("c", "y"), ("c", "y")]):
        with pytest.raises(split.SplitViolation):
            split.validate_assignment(pool, spark.createDataFrame(parts, "sample_id string, part string"), digest)


def test_compare_paths(spark):
    rows = [
        ("RAW", "1", "FULL", ["a"], "OK", None, "ALIGNED", "NATIVE_EXACT", 1.0, 0), ("RAW", "1", "P50", ["b"], "OK", None, "PARTIAL", "NATIVE_EXACT", 3.0, 2),
        ("RAW", "2", "P50", ["b"], "OK", "boom", None, None, None, 5), ("RAW", "3", "FULL", None, "NO_TOKENIZER", None, None, None, None, None),
        ("BASE", "1", "FULL", ["a"], "OK", None, "ALIGNED", "ABSENT", None, 0), ("BASE", "1", "P50", ["a"], "OK", None, "ALIGNED", "ABSENT", None, 0), ("BASE", "2", "P50", ["a"], "OK", None, "ALIGNED", "ABSENT", None, 0),
    ]
    schema = "path string, case_id string, condition string, tokens array<string>, availability string, error string, alignment string, offset_availability string, fragmentation double, unknown_tokens int"
    got = {r.path: r for r in align.compare_paths(spark.createDataFrame(rows, schema)).collect()}
    r = got["RAW"]
    assert (r.observations, r.usable, r.unavailable, r.unavailable_reasons, r.errors, r.aligned, r.alignment_rate, r.mean_fragmentation, r.max_fragmentation, r.unknown_tokens, r.with_unknown_tokens) == (4, 2, 1, ["NO_TOKENIZER"], 1, 1, 0.5, 2.0, 3.0, 2, 1)
    assert (r.comparable_cases, r.invariant_cases, r.all_invariant) == (1, 0, False)
    b = got["BASE"]
    assert (b.comparable_cases, b.invariant_cases, b.all_invariant, b.offset_availability, b.mean_fragmentation) == (1, 1, True, ["ABSENT"], None)


def test_budget_decision():
    assert metrics.budget_decision(500, 20_000) == {"cap": 20_000, "continue_run": False, "budget_limited": False}
    assert metrics.budget_decision(20_000, 20_000) == {"cap": 40_000, "continue_run": True, "budget_limited": False}
    assert metrics.budget_decision(40_000, 40_000) == {"cap": 40_000, "continue_run": False, "budget_limited": True}
    for bad in ((1, 10), (30_000, 20_000)):
        with pytest.raises(ValueError):
            metrics.budget_decision(*bad)
    assert metrics.evaluation_updates(1000) == [0, 500, 1000]


def test_token_profile_keeps_unknowns_apart(spark):
    df = spark.createDataFrame([("hòa bình",), ("hoa",)], "text string")
    lengths = profile.token_lengths(df, lambda t: [0 if ord(c) > 127 else 1 for c in t], unknown_id=0)
    assert sorted(tuple(r)[1:] for r in lengths.collect()) == [(5, 5, 0, 0), (10, 10, 2, 0)]
    r = profile.token_profile(lengths).first()
    assert (r.vanilla_unknown, r.base_unknown, r.changed, r.changed_share, r.delta["max"]) == (2, 0, 0, 0.0, 0.0)


def test_keep_first_and_rows_of_units(spark):
    df = spark.createDataFrame([("x", 3, "c"), ("x", 1, "a"), ("y", 2, None), (None, 5, "z")], "k string, o int, v string")
    assert sorted(corpus.keep_first(df, ("k",), ("o",)).collect(), key=str) == sorted([("x", 1, "a"), ("y", 2, None), (None, 5, "z")], key=str)
    docs = spark.createDataFrame([(1, "Đà n"), (2, ""), (3, None)], "doc_id int, text string")
    units = T.unit_rows(docs).collect()
    assert [(u.doc_id, u.base_char, u.letter_diacritic, u.observed_tone) for u in units] == [(1, "D", "STROKE", "UNMARKED"), (1, "a", "NONE", "HUYEN"), (1, " ", "NA", "UNMARKED"), (1, "n", "NONE", "UNMARKED")]
    assert [(s.span_index, s.base_text) for s in T.syllable_rows(docs).collect()] == [(0, "Da"), (1, "n")]


def test_runs_never_share_a_folder(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    first, second = (runs.unique_run_dir(spark, root, "20260101T000000Z") for _ in range(2))
    assert second == first + "-1"
    cases = spark.createDataFrame([("á", 1)], "text string, n int")
    runs.write_run(spark, first, {"b": 1, "a": "é"}, cases, {"n": 1}, "# report\n")
    assert runs.read_pins(spark, f"{first}/config.json", ("a",)) == {"a": "é", "b": 1}
    assert runs.read_text(spark, f"{first}/report.md") == "# report\n"
    assert spark.read.json(f"{first}/cases.jsonl").first().text == "á"
    with pytest.raises(FileExistsError):
        runs.write_text(spark, f"{first}/report.md", "again")
    with pytest.raises(corpus.CorpusViolation):
        runs.read_pins(spark, f"{first}/config.json", ("a.b",))


def test_plain_yaml():
    text = "# pins\nname: list one\ncounts:\n  raw: 17\n  deep:\n    ok: true\nsha: 'ab''c'\nkinds:\n- x\n- 2\nmore:\n  - y\nnone:\nlast: 1.5 # end\n"
    assert runs.plain_yaml(text) == {"name": "list one", "counts": {"raw": 17, "deep": {"ok": True}}, "sha": "ab'c", "kinds": ["x", 2], "more": ["y"], "none": None, "last": 1.5}
    for bad in ("just words", "a: 1\na: 2", "- x"):
        with pytest.raises(ValueError):
            runs.plain_yaml(bad)


def test_manifest_gates():
    pins = dict.fromkeys(corpus.PINNED, "r") | {"chunking.max_length": 256, "partition.seed": 51733}
    good = json.loads(json.dumps({"official_test_used": False, "schema_version": "r", "protocol_version": "r", "source": {"revision": "r"}, "chunking": {"split_before_chunk": True, "chunks_inherit_parent_partition": True, "truncation": False, "max_length": 256, "tokenizer_revision": "r"}, "counts": {"parents_spanning_both_partitions": 0, "overflow_count": 0}, "contamination": {"official_test_screened": False, "method": "r"}, "partition": {"seed": 51733, "dev_documents": "r"}}))
    assert corpus.gate_manifest(good, pins) is good
    for key in (*corpus.GATES, *corpus.PINNED):
        bad = json.loads(json.dumps(good))
        *path, last = key.split(".")
        holder = bad
        for p in path:
            holder = holder[p]
        for wrong in (None, "other", 0 if holder[last] is False else 1):
            holder[last] = wrong
            with pytest.raises(corpus.CorpusViolation):
                corpus.gate_manifest(bad, pins)
    with pytest.raises(corpus.CorpusViolation):
        corpus.gate_manifest(good, {})


def test_pools_lists_and_files_by_digest(spark, tmp_path):
    import hashlib

    from toneforge.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for folder, text in (("a", "x\ny\n"), ("b", "z\n")):
        (tmp_path / folder / "list.txt").write_text(text)
    sha = {k: hashlib.sha256((tmp_path / k / "list.txt").read_bytes()).hexdigest() for k in "ab"}
    found = {r.name: (r.bytes, r.sha256) for r in files.integrity(spark, str(tmp_path)).collect()}
    assert found == {"a/list.txt": (4, sha["a"]), "b/list.txt": (2, sha["b"])}
    files.verify(spark, str(tmp_path), [("a/list.txt", 4, sha["a"])])
    assert [r.form for r in files.word_list(spark, str(tmp_path / "a" / "list.txt"), 2, sha["a"]).collect()] == ["x", "y"]
    for bad in (str(tmp_path), str(tmp_path / "b")):
        with pytest.raises(corpus.CorpusViolation):
            files.word_list(spark, bad, sha256=sha["a"])
    (tmp_path / "pool.csv").write_text('sample_id,text,label\n1,"a, b",x\n2,c,y\n')
    own = hashlib.sha256((tmp_path / "pool.csv").read_bytes()).hexdigest()
    assert files.pinned_pool(spark, str(tmp_path / "pool.csv"), own, 2, {"x": 1, "y": 1}).count() == 2
    with pytest.raises(corpus.CorpusViolation):
        files.pinned_pool(spark, str(tmp_path / "pool.csv"), sha["a"], 2, {"x": 1, "y": 1})


def test_duplicates_list_as_many_ids_as_asked(spark):
    df = spark.createDataFrame([(i, "t", "s", "l") for i in (5, 3, 9, 1)] + [(7, "u", "s", "l")], "sample_id int, text string, split string, label string")
    ids = lambda most: [(r["size"], r.sample_ids) for r in profile.duplicates(df, F.sha2("text", 256), most=most).collect()]
    assert ids(None) == [(4, [1, 3, 5, 9])] and ids(1) == [(4, [1])] and ids(2) == [(4, [1, 3])]


ODD = ["Đà n", "", " ", "nghiên cứu. x1", "ạ́b ̣x, hoà!", "hoà thuỷ 😀 the of", "xin chào " * 9, "ự̂ ́ ạ́c"]


def test_streamed_rows_are_those_of_whole_values():
    from toneforge.functions import rows
    from toneforge.functions.marks import CANDIDATE
    from toneforge.operators.inventory import classifier

    def taken(made):
        n, fields = made
        cuts = [(x, min(n, x + 3)) for x in range(0, n, 3)]
        return [dict(zip(fields, v, strict=True)) for v in zip(*([p for a, b in cuts for p in f(a, b).to_pylist()] for f in fields.values()), strict=True)]

    own = classifier(frozenset({"the", "of", "nghien", "hoa"}))
    for t in ODD:
        whole = K.decompose(t)
        assert taken(rows.units_of(t)) == whole["units"]
        for clean in (False, True):
            assert taken(rows.syllables_of(t, clean)) == K.decompose(t, clean)["syllables"]
        for c in (None, own):
            assert taken(rows.regions_of(t, c)) == [{"region_index": k} | r for k, r in enumerate(K.regions(t, c))]
            words = rows.Words(lambda w: ([w[0] + "@@", w[1:]], [1]) if len(w) > 1 else ([w + "?"], [2]), "@@", 1)
            base = K.strip(t)
            pieces, regions = taken(rows.pieces_of(words, base)), K.regions(t, c)
            assert [(p["chunk_index"], p["index"], p["global_start"], p["global_end"], p["token_id"], p["has_unknown_token_id"], p["piece_index"]) for p in pieces] == [
                x + (i,) for i, x in enumerate(x for ch in K.chunks(base) if len(ch["text"]) > 1 for x in ((ch["index"], 0, ch["start"], ch["start"] + 1, 1, True), (ch["index"], 1, ch["start"] + 1, ch["end"], None, False)))
            ]
            for p, o in zip(pieces, taken(rows.overlay_of(words, base, t, c)), strict=True):
                met = [k for k, r in enumerate(regions) if r["start"] < p["global_end"] and p["global_start"] < r["end"]]
                assert (o["contributions"], o["candidate_regions"]) == (len(met), [k for k in met if regions[k]["eligibility"] == CANDIDATE])
                assert (o["ownership"] == "UNRESOLVED") == any(regions[k]["eligibility"] == "UNDECIDED" for k in met)


def test_rows_of_texts_come_in_bounded_parts(spark):
    from toneforge.functions import rows

    docs = spark.createDataFrame([(1, "a " * 40000), (2, "b")], "doc_id int, text string")
    plans = [f(docs)._jdf.queryExecution().executedPlan().toString() for f in (T.unit_rows, T.syllable_rows, align.regions)]
    assert all("MapInArrow" in p and "Generate" not in p for p in plans)
    assert T.unit_rows(docs, fields=("base_start", "base_end")).agg(F.sum(F.col("base_end") - F.col("base_start")).alias("n")).first().n == 80001
    n, made = rows.units_of("a " * 40000)
    assert n == 80000 and len(made["base_char"](0, rows.PART)) == rows.PART
