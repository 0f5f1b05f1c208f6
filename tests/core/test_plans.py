"""Plans that were written anew for large tables, held against plain ones."""

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from toneforge.functions import hashing as H
from toneforge.functions import kernels as K
from toneforge.operators import align, corpus, corruption, inventory, split

WORDS = ["hòa", "hoà", "Đặng", "đường", "THUỶ", "thuý", "quốc", "giữ", "x", "café", "ß", "1a2", "a²b", "Ⅷ", "日本", "한국", "é", "̃", "a̱n", ".", " ", "\n", "naïve", "ống", "ở"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("name", [c[0] for c in corruption.CONDITIONS])
def test_counters_agree_with_the_decisions(name):
    _, scope, p = corruption.condition(name)
    classify = inventory.classifier(frozenset({"hoa", "dang", "quoc", "x"}))
    for i, t in enumerate([*texts(200), unicodedata.normalize("NFD", "đường hoà")]):
        for own in (None, classify):
            want = corruption.corrupt_text(t, name, scope, p, 7, str(i), True, own)
            got = corruption.count_units(t, scope, p, 7, str(i), own)
            assert {k: want[k] for k in got} == got, t


def test_character_counts_agree_with_the_units(monkeypatch):
    some = [*texts(300, 4), "", "abc", "ÀÁ ﬁ Ω", "한국", "İ ŉ"]
    fast = [(K.observe(t), K.tones_of(t)) for t in some]
    monkeypatch.setattr(K, "_mark_pattern", lambda: __import__("re").compile(""))  # always there: the units' way
    for t, (seen, tones) in zip(some, fast, strict=True):
        own = K.units(K.canon(t))
        assert tones == [K.observed(own, a, b) for a, b in K.runs(own)], t
        if not K.canon(t).isascii():
            assert K.observe(t) == seen, t
        else:
            spans = K.runs(own)
            assert (seen["syllables"], seen["total_units"], seen["letter_eligible_units"], seen["base_equivalent"]) == (len(spans), len(own), sum(u.state != "NA" for u in own), True)


def test_drawer_gives_the_scores():
    draw = H.drawer(42, "s", "abc")
    assert [draw(k) for k in (0, 7, 1234)] == [H.score(42, "s", "abc", k) for k in (0, 7, 1234)]


def test_removed_letters_are_the_marks_themselves():
    (d,) = corruption.corrupt_text("đường", "STRIP_ALL", "TONE_AND_LETTER", 1.0, 1, "s")["decisions"]
    assert d["letter_diacritics_removed"] == ["STROKE", "̛", "̛"] and d["tone_mark_removed"]


def test_resolve_agrees_with_classify(spark):
    forms = frozenset({"hoa", "ss", "duong"})
    bases = ["Hòa", "hoa", "HOÀ", "ß", "đường", "x", "hoa1", "", " ", "hoa hoa"]
    rows = inventory.resolve(spark.createDataFrame([(b,) for b in bases], "base_text string"), spark.createDataFrame([(f,) for f in forms], "form string")).collect()
    assert {r.base_text: r.eligibility for r in rows} == {b: inventory.classify(b, forms) for b in bases}


def test_overlay_agrees_with_all_pairs(spark):
    rng = random.Random(3)
    pieces, regions = [], []
    for d in range(6):
        at = 0
        for k in range(rng.randint(0, 60)):
            n = rng.choice([0, 1, 2, 3, 90])
            pieces.append((d, k, at, at + n))
            at += n
        start = rng.randint(0, 3)
        for k in range(rng.randint(0, 60)):
            n = rng.choice([0, 1, 4, 200])
            regions.append((d, k, start, start + n, rng.choice(["VIETNAMESE_CANDIDATE", "NOT_APPLICABLE", "NOT_APPLICABLE", "UNDECIDED"])))
            start += n
    p = spark.createDataFrame(pieces, "doc_id int, piece_index int, global_start int, global_end int")
    r = spark.createDataFrame(regions, "doc_id int, region_index int, start int, end int, eligibility string")
    got = {(x.doc_id, x.piece_index): (x.ownership, x.tone_region_index, x.candidate_regions, x.contributions) for x in align.overlay(p, r).collect()}
    for d, k, a, b in pieces:
        met = [x for x in regions if x[0] == d and max(a, x[2]) < min(b, x[3])]
        own = [x[1] for x in met if x[4] == "VIETNAMESE_CANDIDATE"]
        kind = "UNRESOLVED" if any(x[4] == "UNDECIDED" for x in met) else ["NOT_APPLICABLE", "SINGLE_CANDIDATE"][len(own)] if len(own) < 2 else "MULTI_CANDIDATE_AMBIGUOUS"
        assert got[d, k] == (kind, own[0] if kind == "SINGLE_CANDIDATE" else None, own, len(met))
    assert len(got) == len(pieces)


def test_project_labels_each_piece(spark):
    p = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 3), (2, 0, 0, 1)], "doc_id int, piece_index int, global_start int, global_end int")
    r = spark.createDataFrame([(1, 0, 0, 3, "VIETNAMESE_CANDIDATE", "SAC"), (2, 0, 0, 1, "NOT_APPLICABLE", None)], "doc_id int, region_index int, start int, end int, eligibility string, observed_tone string")
    labels = spark.createDataFrame([(1, ["HORN", "NA", "NONE"]), (2, ["NA"])], "doc_id int, labels array<string>")
    got = {(x.doc_id, x.piece_index): (x.tone_label, x.letter_label) for x in align.project(align.overlay(p, r), r, labels).collect()}
    assert got == {(1, 0): ("SAC", "HORN"), (1, 1): ("SAC", "NONE"), (1, 2): ("NA", "NA"), (2, 0): ("NA", "NA")}


def test_ranked_is_a_row_number_a_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), "%06x" % rng.randrange(1 << 24) if k % 7 else "00ff00", str(k)) for k in range(500)]
    got = {r.i: r["rank"] for r in corpus.ranked(spark.createDataFrame(rows, "g string, h string, i string"), ("g",), "h", "i").collect()}
    for g in "ab":
        order = sorted((h, i) for x, h, i in rows if x == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_membership_digest_streams_the_sorted_values(spark):
    rows = [("b", "2"), ("b", "10"), ("a", "x"), ("b", None), (None, "q"), ("b", "2")]
    got = {r.g: (r.n, r.digest) for r in corpus.membership_digest(spark.createDataFrame(rows, "g string, v string"), "v", ("g",)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"b": (4, sha("10\n2\n2")), "a": (1, sha("x")), None: (1, sha("q"))}
    assert corpus.membership_digest(spark.createDataFrame(rows, "g string, v string").limit(0), "v", ("g",)).count() == 0


def test_split_of_a_hot_label(spark):
    rows = [(i, "t%d" % i, "hot" if i % 10 else "cold") for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id int, text string, label string")
    got = split.stratified(df, {"train": 0.8, "validation": 0.2}, 5, F.sha2("text", 256)).collect()
    order = {g: sorted((H.blake_hex(f"5|{d}", 16), d) for d in (hashlib.sha256(t.encode()).hexdigest() for _, t, x in rows if x == g)) for g in ("hot", "cold")}
    first = {d for g, o in order.items() for _, d in o[: round(0.8 * len(o))]}
    assert {r.sample_id for r in got if r.part == "train"} == {i for i, t, _ in rows if hashlib.sha256(t.encode()).hexdigest() in first}


def test_a_column_of_few_texts_is_mapped_once_each(spark):
    from toneforge.functions import text as T

    rows = [("Hòa",), (None,), ("hoa",)] * 50
    got = spark.createDataFrame(rows, "t string").select("t", T.membership_form(F.col("t")).alias("m")).distinct().collect()
    assert {(r.t, r.m) for r in got} == {("Hòa", "hoa"), (None, None), ("hoa", "hoa")}
    assert K.membership_form("Hòa") == "hoa"
