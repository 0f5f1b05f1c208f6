import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from toneforge.functions import hashing as H
from toneforge.functions import kernels as K
from toneforge.functions import text as T
from toneforge.functions.marks import LETTERS, TONES

# Placements that are known.
PAIRS = {"hòa": "hoà", "thúy": "thuý", "qùa": "quà", "gía": "giá", "ủy": "uỷ", "gì": "gì", "của": "của", "mía": "mía", "người": "người", "khoẻ": "khoẻ", "toán": "toán", "giếng": "giếng", "HÒA": "HOÀ"}
TEXTS = ["", "  ", "Tôi đang nghiên cứu.", "Đường ĐI", "Müller façade naïve", "한국어", "😀 a̋", "́a", "̈x", "http://a.b hòa-bình 2024", "ẫ" + "̣", "é̂"]


def letters():
    for vowel in "aeiouy":
        for shape in ["", *LETTERS]:
            for tone in ["", *TONES]:
                for ch in (vowel, vowel.upper()):
                    yield unicodedata.normalize("NFC", ch + shape + tone)


@pytest.mark.parametrize("before,after", PAIRS.items())
def test_placement(before, after):
    assert K.canon(before) == after and K.canon(after) == after
    assert K.canon(unicodedata.normalize("NFD", before)) == after


def test_round_trip_and_base():
    for t in [*TEXTS, *letters(), " ".join(letters())]:
        c = K.canon(t)
        assert K.canon(c) == c
        assert K.recompose(K.decompose(t)["units"]) == c
        assert K.checked(t)["passed"]
        assert K.strip(c) == K.strip_marks(c)
        d = K.decompose(t)
        assert "".join(u["canonical_text"] for u in d["units"]) == d["canonical_text"] or unicodedata.normalize("NFC", "".join(u["canonical_text"] for u in d["units"])) == d["canonical_text"]
        r = K.regions(t)
        assert [x["start"] for x in r] == [0, *[x["end"] for x in r[:-1]]][: len(r)]


def test_channels():
    d = K.decompose("Đường xưa 1", clean=True)
    assert [u["letter_diacritic"] for u in d["units"]][:5] == ["STROKE", "HORN", "HORN", "NONE", "NONE"]
    assert [(s["base_text"], s["observed_tone"], s["lexical_tone"]) for s in d["syllables"]] == [("Duong", "HUYEN", "HUYEN"), ("xua", "UNMARKED", "NGANG")]
    assert K.decompose("xua")["syllables"][0]["lexical_tone"] is None
    assert K.units("Ü1́")[1].anomalies == ["TONE_MARK_ON_NON_LETTER"]


def test_draws():
    identity = hashlib.sha256(K.canon("Tôi đang nghiên cứu.").encode()).hexdigest()
    assert [H.score(42, "doc-17", identity, k) for k in range(4)] == [0.332683992929849, 0.06133636789380808, 0.9678842017772178, 0.8128103984738984]
    assert H.rate_for(35422, "d0#0", 0) == 0.9656633794200227 and H.scope_draw(35422, "d0#0", 0) == 0.28595561452992235


def test_columns_agree_with_kernels(spark):
    rng = random.Random(1)
    texts = [*TEXTS, None, *("".join(rng.choices("aăâđeêoơuưyỳáảãạ bcÀ.9#@!̣́\n", k=40)) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    t = F.col("t")
    got = df.select("id", T.canon(t).alias("canon"), T.strip_to_base(t).alias("strip"), T.strip_base(T.nfc(t)).alias("native"), T.observe_orthography(t).alias("o"), T.whitespace_chunks(t).alias("w"), T.first_divergence(t, T.canon(t)).alias("f"), T.rewrite_signature(t).alias("r")).orderBy("id").collect()
    for r, x in zip(got, texts, strict=True):
        if x is None:
            assert r.canon is None and r.o is None and r.w is None
            continue
        assert r.canon == K.canon(x) and r.strip == K.strip(x) and r.native == K.strip_marks(x)
        assert r.o.asDict() == K.observe(x) and [c.text for c in r.w] == x.split() and r.f == K.first_divergence(x, K.canon(x)) and r.r == K.rewrite_signature(x)
