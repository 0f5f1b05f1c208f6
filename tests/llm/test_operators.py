import glob
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from toneforge.llm import ann, decontam, idstore, langid, licenses, mixlm, pieces, pii, quality, simhash
from toneforge.llm.common import text_bytes
from toneforge.llm.queries import queries, vocabulary

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a  b\n\n c", "don't 5'll9x's", "x<|endoftext|>y", "　q\xa0r", "\x1ca\x1cb!", "日本語 12３４", "🙂🙂 ok!!  \n", "a▁b▁▁c", "\0z", "é" * 30, "word " * 4000, "same text", "same text"]


def frame(spark, texts, more=""):
    return spark.createDataFrame([(i, t, *(("x",) if more else ())) for i, t in enumerate(texts)], "doc_id long, text string" + more)


# 1

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    found = langid.identify(docs, F.col("doc_id") % 4 != 2, keep=("doc_id", "lang")).where("doc_id % 4 = 2").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    docs = frame(spark, ["the and of", "der die das", None, "", "12 !?", "the"]).withColumn("lang", F.element_at(F.array(*map(F.lit, ["en", "de", "en", "en", "en", None])), F.col("doc_id").cast("int") + 1))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()}
    assert got == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und", 5: "en"}
    none = {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()}
    assert none == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_gram_vectors_bind_permuted_letters():
    data, off = text_bytes(pa.array(["ab"]))
    row, key = langid.letter_grams(data, off)
    a, b, blank = (langid._sign_vector(c).astype(int) for c in ("a", "b", ""))
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert (langid.gram_vectors(key).sum(axis=0) == want).all()


def plain_profile(text):
    """The sum of all letter trigrams' vectors, one at a time."""
    letters = [langid._sign_vector(c.lower()[0]).astype(int) if c.isalpha() else langid._sign_vector("").astype(int) for c in f"\0{text}\0"]
    return sum((np.roll(x, 2) * np.roll(y, 1) * z for x, y, z, c in zip(letters, letters[1:], letters[2:], text, strict=False) if c.isalpha()), np.zeros(langid.DIM))


def test_language_agrees_with_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices(a, k=rng.randint(1, 60))) for a in ("abcde fé", "xyzuv wß", "日本語文字, ") for _ in range(12)]
    rows = [(i, t, "abc"[i // 12], "x") for i, t in enumerate(texts)] + [(3, texts[3], "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    proto = {k: sum(plain_profile(t) for i, t, g, _ in rows if g == k and i % 4 != 2) for k in "abc"}
    unit = {k: v / np.linalg.norm(v) for k, v in proto.items()}
    for dense in (1 << 23, 1):  # by a table, and each row's own
        monkeypatch.setattr(langid, "DENSE", dense)
        labels, profile = langid.prototypes(docs.where("doc_id % 4 <> 2"))
        assert labels == ["a", "b", "c"] and all((profile[k] == proto[g]).all() for k, g in enumerate(labels))
        data, off = text_bytes(pa.array(texts))
        assert (langid.bundle(*langid.letter_grams(data, off), len(texts)) == np.array([plain_profile(t) for t in texts])).all()
    for r in langid.predict(docs, labels, profile).collect():
        v = plain_profile(texts[r.doc_id])
        cos = {k: float(v @ u) / max(np.linalg.norm(v), 1e-9) for k, u in unit.items()}
        if any(c.isalpha() for c in texts[r.doc_id]):
            assert cos[r.lang_pred] > max(cos.values()) - 1e-5 and abs(r.score - max(cos[r.lang_pred], 0)) < 1e-5
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


def test_ties_go_to_the_first_label(spark):
    docs = spark.createDataFrame([(1, "abc", "y"), (2, "abc", "b"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()} == {"b"}


def test_scripts_of_many_letters_stay_small():
    import tracemalloc

    rng = np.random.default_rng(1)
    data, off = text_bytes(pa.array(["".join(map(chr, rng.integers(0x4E00, 0x9FA5, 330))) for _ in range(1000)]))  # a block of 1 MB, 330,000 trigrams
    row, key = langid.letter_grams(data, off)
    tracemalloc.start()
    got = langid.bundle(row, key, 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (1000, langid.DIM) and peak < 400 << 20


# 2

def test_pieces_equal_the_library(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    texts = [*ODD, *(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()), "=" * 300, "ab" * 700]
    got = pieces.encode(frame(spark, texts, ", ids string"), vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [own.encode(t or "") for t in texts]
    assert all(r.round_trip for r in got)
    back = pieces.decode(spark.createDataFrame([(r.doc_id, list(r.ids)) for r in got], "doc_id long, ids array<int>"), vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


def test_pieces_of_long_words_and_all_characters(monkeypatch):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    rng = random.Random(8)
    every = "".join(chr(p) for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000 and p != 0x2581)  # over 65,534 characters
    texts = ["a" * 9000, "".join(rng.choices("abcdefé日の", k=30_000)), every, "x" + "\0y" * 3000, " " * 6000, "no long word", ("ab" * 2500 + " ") * 2]
    ids, counts = own.encode(*text_bytes(pa.array(texts)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]
    monkeypatch.setattr(pieces, "MATCH_BYTES", 100)  # stretches that cut pieces apart
    assert np.frombuffer(own._match_long("▁" + "theotherthing" * 400), "<u4").tolist() == library.encode("theotherthing" * 400)
    assert not any(len(w) > pieces.LONG for w in own.table)


# 3

def test_idstore_equals_brute_force(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    long_ = " ".join(f"w{i} tale" for i in range(900))
    texts = [*ODD, long_, long_ + " end", "start " + long_, long_]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(7, "same text"), (7, "other"), (None, "null id")]
    path = idstore.write(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("byte_bpe_50k.json"))
    got = idstore.verified(spark, path).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    inorder = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert inorder == sorted(inorder, key=lambda d: (d is not None, d or 0))
    whole = idstore.read(spark, path).where("doc_id = 90").first()
    assert np.frombuffer(bytes(whole.ids), f"<u{whole.wide}").tolist() == own.encode(texts[10], add_special_tokens=False).ids + [2]
    stored = spark.read.parquet(path).where("kind = 'doc'").agg(F.sum(F.length("ids"))).first()[0]
    assert stored < 2 * sum(n for _, n, _ in want) * 0.6  # copies are stored once


def test_idstore_notices_changes_and_empty_tables(spark):
    path = idstore.write(frame(spark, ["one two", "three"]), vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(path)
    bad = path + "-bad"
    docs.withColumn("ids", F.when(F.col("doc_id") == 1, F.expr("cast('xx' as binary)")).otherwise(F.col("ids"))).write.partitionBy("kind").parquet(bad)
    spark.read.parquet(f"{path}-manifest").write.parquet(f"{bad}-manifest")
    with pytest.raises(Exception, match="digest"):
        idstore.verified(spark, bad).count()
    empty = idstore.write(frame(spark, ["x"]).limit(0), vocabulary("byte_bpe_50k.json"))
    assert idstore.verified(spark, empty).count() == 0


# 4

def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = quality.score(docs, model).join(labels, "doc_id").where("doc_id % 3 = 1").toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.95


def test_quality_of_odd_texts(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 0), (None, 1), (4, None), (77, 1)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    one = quality.score(docs, quality.fit(docs, labels.where("quality = 1"))).collect()
    assert all(r.score >= 0.5 for r in one)
    assert quality.accepted(docs.limit(0), quality.fit(docs, labels.limit(0))).count() == 0


def plain_features(text):
    """The statistics, one character, word and line at a time."""
    data = text.encode()
    out = [0.0] * quality.FEATURES
    if not data:
        out[-1] = 1.0
        return out
    for k in range(quality._CLASSES):
        out[k] = math.sqrt(sum(int(quality._CLASS[b]) == k for b in data) / len(data))
    words = re.findall(rb"[^ \t\n\v\f\r]+", data)
    n, size = max(len(words), 1), [len(w) for w in words]
    mean = sum(size) / n
    kind = lambda b: int(quality._CLASS[b])
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", data)
    out[quality._CLASSES :] = [
        math.log1p(len(data)) / 10, mean / 10, math.sqrt(max(sum(x * x for x in size) / n - mean**2, 0)) / 10, sum(x <= 3 for x in size) / n, sum(x >= 12 for x in size) / n, len(set(words)) / n,
        sum(kind(w[0]) == 2 for w in words) / n, sum(kind(w[-1]) in (7, 16) for w in words) / n, sum(kind(w[-1]) > 8 for w in words) / n, 1 - len(set(lines)) / len(lines), 0.0,
    ]
    return out


def test_quality_features_agree_with_plain_counts():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab cDE12é.,|#!?\n\t  ", k=rng.randint(0, 80))) for _ in range(300)] + [t or "" for t in ODD]
    got = quality.features(*text_bytes(pa.array(texts)))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-12)


def test_pairwise_loss_is_near_its_least():
    """Against plain gradient descent over all pairs."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5))
    y = (x @ [2, -1, 0.5, 0, 0] + rng.normal(size=120) > 0.3).astype(int)
    model = quality.bradley_terry(x, y, pairs_per_row=60)
    diff = ((x[y == 1][:, None] - x[y == 0][None]) / model.scale).reshape(-1, 5)
    loss = lambda w: np.log1p(np.exp(-(diff @ w))).mean()
    best = np.zeros(5)
    for _ in range(3000):
        best += 0.5 * (diff / (1 + np.exp(diff @ best))[:, None]).mean(axis=0)
    assert loss(model.weights) < 1.02 * loss(best)
    z = ((x - model.mean) / model.scale) @ model.weights
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-model.slope * (z - model.threshold))))
    assert ((model.score(x) >= 0.5) == (z >= model.threshold)).all()


def test_quality_of_repeated_rows_and_clashing_names(spark):
    docs = frame(spark, ["good text. it is.", "|||| ####", None, ""], ", score string").union(frame(spark, ["good text. it is."] * 30, ", score string").select(F.lit(0).cast("long"), "text", "score"))
    labels = spark.createDataFrame([(0, 1, "a"), (1, 0, "b"), (0, 1, "c")], "doc_id long, quality int, text string")
    model = quality.fit(docs, labels, sample_rows=4)
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and sum(r.doc_id == 0 for r in kept.collect()) == 34 - 3
    assert [f.name for f in quality.score(docs, model).schema] == ["doc_id", "score"]


# 5: see test_simhash

def test_deduplicated_keeps_one_of_each_group(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    near = []
    for t in base[:4]:
        w = t.split()
        w[rng.randrange(5, 110)] = "changed"
        near.append(" ".join(w))
    texts = [*base, *near, *base[:2], None, ""]
    docs = frame(spark, texts, ", key string").union(frame(spark, texts, ", key string").where("doc_id = 0"))
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == [*range(12), 18]
    assert simhash.deduplicated(docs.limit(0)).columns == docs.columns


# 6

def brute_tiles(a, b, least):
    out, ma, mb = [], set(), set()
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in ma and j + k not in mb:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return out
        out.append(best)
        ma |= set(range(best[0], best[0] + best[2]))
        mb |= set(range(best[1], best[1] + best[2]))


def test_leaks_agree_with_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [" ".join(rng.choices(words, k=n)) for n in (40, 25, 12, 5, 3, 1)] + ["", None, "!!!"]
    docs = []
    for _ in range(40):
        own = rng.choices(words, k=rng.randint(0, 60))
        item = (rng.choice(items) or "").split()
        cut = rng.randint(0, len(item))
        parts = [item[cut:], own[:20], item[:cut], own[20:]]
        docs.append(" ".join(x for p in parts for x in p).upper() + ".")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for size in (1 << 20, 100):
        got = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(frame(spark, [*docs, None, ""]), bench, block_chars=size).collect()}
        want = {}
        for d, t in enumerate(docs):
            b = re.findall("[a-z0-9]+", t.lower())
            for k, item in enumerate(items):
                a = re.findall("[a-z0-9]+", (item or "").lower())
                n = sum(x[2] for x in brute_tiles(a, b, min(5, len(a)))) if a else 0
                if a and n >= 0.8 * len(a) - 1e-9:
                    want[d, k] = n
        assert got == want
    clean = decontam.clean(frame(spark, [*docs, None]), bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(docs) + 1)) - {d for d, _ in want}
    assert decontam.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_tiles_of_equal_words_and_ties():
    """Longest first, of equals the first in the item, then in the document; few words in all orders, against brute force."""
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 14))] for _ in range(2))
        code = {w: np.uint64(11 * ord(w)) for w in "xyz"}
        got = decontam.tiles(*(np.array([code[w] for w in t], np.uint64) for t in (a, b)), 2)
        assert got == brute_tiles(a, b, 2), (a, b)


def test_repeated_words_do_not_multiply():
    import tracemalloc

    index = decontam.Index.of([1], ["same " * 1000], 5)
    peaks = []
    for n in (5_000, 20_000):
        words, at = decontam.word_hashes(*text_bytes(pa.array(["same " * n])))
        tracemalloc.start()
        ((row, item, cover, found),) = index.leaks(words, at, 0.8)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (row, item, cover, found) == (0, 0, 1.0, [(0, 0, 1000)])
    assert peaks[1] < 40 << 20 and peaks[1] < 6 * peaks[0]


def test_leaks_of_repeated_rows_null_ids_and_clashing_names(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, item, "k"), (1, item, "k"), (None, item, None), (2, None, "k"), (3, "", "k")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item, "z"), (9, item, "z"), (None, item, None), (8, None, "z")], "item_id long, text string, doc_id string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect())
    assert got == {(1, 9): 4, (None, 9): 2, (1, None): 2, (None, None): 1}
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert decontam.clean(docs, bench.limit(0)).count() == 5 and decontam.clean(docs.limit(0), bench).count() == 0


# 7

def test_licenses(spark):
    mit = licenses.TEMPLATES[5][1]
    texts = [None, "", "é Licensed under the Apache License, Version 2.0. x", "licensed under the MIT licence", "so " + mit.replace("without restriction, including", "including").replace(" ", "\n") + " end", "ALL RIGHTS\n* reserved", "all rights to be reserved", "license " * 3000]
    got = {(r.doc_id, r.license): r for r in licenses.scan(frame(spark, texts, ", start string")).collect()}
    assert set(got) == {(2, "Apache-2.0"), (4, "MIT"), (5, "all-rights-reserved")}
    r = got[2, "Apache-2.0"]
    assert texts[2][r.start : r.end] == "Licensed under the Apache License, Version 2.0" and r.coverage == 1
    assert 0.9 < got[4, "MIT"].coverage < 1
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


def test_words_before_a_notice_do_not_hide_it(spark):
    texts = ["and all the other contributors. All rights reserved.", "licensed as follows: Licensed under the Apache License, Version 2.0", "this one. We say: " + licenses.TEMPLATES[10][1], "all of these rights are now reserved"]
    got = {(r.doc_id, r.template): texts[r.doc_id][r.start : r.end] for r in licenses.scan(frame(spark, texts)).collect()}
    assert got == {(0, 16): "All rights reserved", (1, 0): "Licensed under the Apache License, Version 2.0", (2, 10): licenses.TEMPLATES[10][1]}


def test_repeated_notices_are_found_each(spark):
    mit, every = licenses.TEMPLATES[3][1], licenses.TEMPLATES[16][1]
    texts = [f"{mit}.\n{mit}.\n", f"é Copyright X. {every}.\n" * 7, f"{every} " * 2, "\n".join(f"file{k}.c: {mit}" for k in range(5))]
    got = sorted((r.doc_id, r.start, r.end) for r in licenses.scan(frame(spark, texts)).where("template in (3, 16)").collect())
    assert got == [(i, *m.span()) for i, t in enumerate(texts) for m in re.finditer(f"{mit}|{every}", t)]


def plain_alignment(a, b, shift, band):
    """The most equal words in common order near the diagonal, by the full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            here = best[i][j] + 1 if a[i] == b[j] and abs(j - i - shift) <= band else 0
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], here)
    return best[-1][-1]


def test_alignment_agrees_with_the_full_table():
    rng = random.Random(6)
    for _ in range(300):
        a, b = (rng.choices("xyzw", k=rng.randint(1, 9)) for _ in range(2))
        shift, band = rng.randint(-3, 5), rng.randint(0, 4)
        pairs = licenses.align(a, b, shift, band)
        assert all(a[i] == b[j] and abs(j - i - shift) <= band for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        most = plain_alignment(a, b, shift, band)
        assert len(pairs) == most
        if most:
            spans = [e - s for s in range(len(b)) for e in range(s, len(b)) if plain_alignment(a, ["-"] * s + b[s : e + 1], shift, band) == most]
            assert pairs[-1][1] - pairs[0][1] == min(spans)


def test_main_diagonal_agrees_with_a_plain_count():
    rng = random.Random(7)
    for n in (5, 40, 3000):
        for _ in range(20 if n < 100 else 2):
            a, b = rng.choices("abcdefgh", k=rng.randint(1, 12)), rng.choices("abcdefghijkl", k=rng.randint(1, n))
            votes = Counter(j - i for i, w in enumerate(a) for j, v in enumerate(b) if v == w)
            near = {d: sum(votes.get(d + z, 0) for z in range(-2, 3)) for d in votes}
            want = min(votes, key=lambda d: (-near[d], -votes[d], d)) if votes else None
            assert licenses._main_diagonal(a, b, 2) == want


def test_adjacent_overlapping_and_stretched_notices(spark):
    apache, mit, every = licenses.TEMPLATES[0][1], licenses.TEMPLATES[3][1], licenses.TEMPLATES[16][1]
    wide = mit.replace(" ", " " * 2000)  # words far apart
    texts = [f"{apache} {mit}", f"{mit}; {every}; {mit}", wide, f"{every} {every} reserved", (f"{mit} " * 3 + "x " * 500) * 2]
    got = sorted((r.doc_id, r.template, r.start, r.end) for r in licenses.scan(frame(spark, texts)).where("template in (0, 3, 16)").collect())
    want = []
    for d, t in enumerate(texts):
        for k, notice in ((0, apache), (3, mit), (16, every)):
            want += [(d, k, *m.span()) for m in re.finditer(r"\s+".join(map(re.escape, notice.split())), t)]
    assert got == sorted(want)


def test_licenses_of_repeated_rows_and_null_ids(spark):
    mit = licenses.TEMPLATES[3][1]
    docs = spark.createDataFrame([(1, mit, "x"), (1, mit, "x"), (None, mit, None), (2, None, "x")], "doc_id long, text string, license string")
    assert Counter(r.doc_id for r in licenses.scan(docs).where("template = 3").collect()) == {1: 2, None: 1}


def test_winnowing_keeps_a_shared_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        common = "".join(rng.choices("abcdef", k=licenses.GRAM + licenses.WINDOW - 1))
        a, b = ("".join(rng.choices("abcdef", k=rng.randint(0, 40))) + common + "".join(rng.choices("abcdef", k=rng.randint(0, 40))) for _ in range(2))
        x, y = (set(licenses.winnowed(*text_bytes(pa.array([t])))[0].tolist()) for t in (a, b))
        assert x & y


# 8

_PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for kind, p in _PATTERNS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_agree_with_the_patterns():
    rng = random.Random(3)
    alphabet = "a@.-+ 1290()%é\n"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(4000)] + ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "x+49 (0)30 123-4567", "0001.2.3.4", "١.2.3.4"]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_pii_query_and_redaction(spark):
    model = pii.train()
    texts = [None, "", "é mail bob.1@x.org now", "call 555-123-4567 or +1 (212) 555-0100", "bob [at] example [dot] com", "token = 'abcd1234abcd1234abcd'", "ratio 12 : 34, 2024-01-02", "the end. Or at home dot"]
    got = {r.doc_id: r for r in pii.find(frame(spark, texts), model).collect()}
    assert got[2].n_email == 1 and got[2].spans == "email:7:18" and got[2].base_sha256 == hashlib.sha256(b"email:7:18").hexdigest()
    assert got[3].n_phone == 1 and got[3].spans == "phone:5:17,phone:21:38"
    assert got[4].spans.startswith("email:0:") and got[5].spans.startswith("secret:")
    assert not got[0].spans and not got[6].spans and not got[7].spans
    out = {r.doc_id: r.text for r in pii.redacted(frame(spark, texts, ", spans string"), model).collect()}
    assert out[0] is None and out[2] == "é mail <email> now" and out[3] == "call <phone> or <phone>"


def test_long_secrets_are_covered_whole():
    rng = random.Random(9)
    model = pii.train(1500)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for n in (60, 128, 129, 500, 20_000):
        part = ["".join(rng.choices(alnum, k=n // 3)) for _ in range(3)]
        for token in (".".join(part), part[0] + "-4111111111111111-" + part[1], part[0] + "/10.0.0.1/" + part[2]):
            text = f"some token={token} end"
            spans = pii.spans_of([text], model)[0][1]
            inside = {i for _, a, b in spans for i in range(a, b)}
            assert inside == set(range(11, 11 + len(token))), (n, spans)
            assert token[-20:] not in pii.redact(text, spans)


def test_added_spans_agree_with_a_plain_selection():
    """Candidates of the best probability first; each must be free of base spans and of those chosen before."""
    rng = random.Random(5)
    model = pii.train(1500)
    parts = ["bob [at] example [dot] com", "555-123-4567", "token=abcdef0123456789", "4111.1111.1111.1111", "a@b.org", "10.0.0.1", "x", "call", "(212) 555-0100", "1:2:3:4:5:6:7:8", "key: +4930123456789abc"]
    for _ in range(150):
        text = rng.choice([" ", "", ", "]).join(rng.choices(parts, k=rng.randint(0, 9)))
        base = pii.base_spans(text)
        free = lambda s, taken: [i for i in range(s[1], s[2]) if not any(a <= i < b for _, a, b in taken)]
        found = [c for c in dict.fromkeys(pii.candidates(text)) if free(c, base) and (c[0] == "secret" or len(free(c, base)) == c[2] - c[1])]
        p = [float(model.probability(np.array([pii.describe(text, c)]))[0]) for c in found]
        chosen = []
        for _, c, q in sorted(((-q, c[1], -c[2]), c, q) for c, q in zip(found, p, strict=True)):
            points = free(c, [*base, *chosen])
            if q >= model.thresholds[c[0]] and points and (c[0] == "secret" or len(points) == c[2] - c[1]):
                chosen += [(c[0], a, a + 1) for a in points]
        want = {(k, i) for k, a, b in (*base, *chosen) for i in range(a, b)}
        assert {(k, i) for k, a, b in pii.spans_of([text], model)[0][1] for i in range(a, b)} == want, text


def test_many_candidates_and_long_addresses_take_linear_time():
    import time

    model = pii.train(1500)
    times = []
    for n in (5_000, 20_000):
        text = " or ".join(f"{i % 900 + 100}-555-{i % 9000 + 1000}" for i in range(n))
        start = time.time()
        spans = pii.spans_of([text], model)[0][1]
        times.append(time.time() - start)
        assert len(spans) > 0.9 * n
    assert times[1] < 12 * times[0] + 1
    host, local = "h" * 300, "l" * 500
    text = f"mail {local} [at] {host} [dot] a1 [dot] b2 [dot] c3 [dot] d4 [dot] e5 [dot] com now"
    assert ("email", 5, len(text) - 4) in pii.candidates(text)
    assert pii.candidates("a at " * 40_000 + "dot") == []


# 9

def test_base_scores_agree_with_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 50))) for _ in range(120)] + [None, "", "New words HERE here", "x " * 3000]
    docs = frame(spark, texts, ", held string").unionByName(spark.createDataFrame([(None, "w1 w2", "x"), (5, "w1", "x")], "doc_id long, text string, held string"))
    rows = docs.collect()
    out = [i for i in range(len(rows)) if rows[i].doc_id is not None and rows[i].doc_id % 10 == 0]
    tokens = [(r.text or "").lower().split() for r in rows]
    c, ends = Counter(), 0
    for i, t in enumerate(tokens):
        if i not in out:
            c.update(t)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda t: sum(math.log10(((c[w]) + 0.1) / (n + 0.1 * (v + 1))) for w in t) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((str(r.doc_id), len(t) + 1, sum(c[w] > 0 for w in t) + 1, round(base(t), 6)) for r, t in zip(rows, tokens, strict=True))
    got = mixlm.score(docs, F.col("doc_id") % 10 == 0).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert mixlm.score(docs.limit(0), F.lit(False)).count() == 0


def small_model(seed=1, names=40, n=120):
    """A mixer with tables of a few texts, and their block."""
    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) % names) for _ in range(n)] + [None, "a b a b a b a b a b c", "x " * 200]
    table = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([i % 10 == 0 for i in range(len(texts))])], ["doc_id", "text", "held"])
    old, mixlm.TaskContext = mixlm.TaskContext, type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())})
    (batch,) = list(mixlm._blocks(iter([table])))
    mixlm.TaskContext = old
    block = mixlm.Block(next(mixlm._rows(batch)))
    tops = np.sort(block.hashes[:8])
    states = mixlm.States.learn(tops, rng.integers(1, 50, (8, 8)) + 60 * np.eye(8))
    sizes = mixlm.table_sizes(3000)
    tables = [np.zeros(2 * s, np.int64) for s in sizes]
    mixlm.count_contexts(block, states, sizes, tables)
    weights = np.round(rng.normal(0.2, 0.2, (mixlm._GATES, mixlm.CONTEXTS + 1)), 3)
    refine = rng.normal(0, 2, (mixlm.KINDS, 33)).astype(np.float32)
    return block, states, mixlm.FirstBits([t.reshape(-1, 2).astype(np.float32) for t in tables], weights, refine)


def test_first_bits_agree_with_a_plain_loop():
    """One document at a time, one token at a time, one bit at a time."""
    block, states, first = small_model()
    known = np.append(np.arange(len(block.hashes)) % 5 > 0, False)
    docs = np.arange(len(block.held))
    t = mixlm.Tokens(block, docs, states)
    got = first.log(t, known[t.code])
    for d in docs.tolist():
        one = mixlm.Tokens(block, np.array([d]), states)
        m, own, lean, total, seen = len(block.hashes), np.zeros(6), np.zeros(4), 0.0, {}
        words = [*block.codes[block.first[d] : block.first[d] + block.counts[d]].tolist(), m]
        for at in range(0, len(words), mixlm.CHUNK):
            moved, n, drawn, many = np.zeros(6), 0, np.zeros(4), np.zeros(4)
            for i in range(at, min(at + mixlm.CHUNK, len(words))):
                key = (words[i - 1] if i else "start", words[i - 2] if i > 1 else "start")
                bits = [(0, words[i] == m)]
                if words[i] != m:
                    again = seen.get(key) if i else None
                    if again is not None:
                        bits.append((1, again == words[i]))
                    if again != words[i]:
                        bits.append((2, bool(known[words[i]])))
                        if known[words[i]]:
                            bits += [(3 + k, int(block.hashes[words[i]]) >> (63 - k) & 1) for k in range(mixlm.BITS)]
                if i:
                    seen[key] = words[i]
                for kind, bit in bits:
                    x, gate = first.inputs(one, np.array([i]), np.array([kind]))
                    z = first.weights[gate[0]] @ x[0] + own @ x[0]
                    s = min(kind, 3)
                    fine = (z + first.refine[kind, min(max(round(float(z) * 2) + 16, 0), 32)]) / 2 + lean[s]
                    q = 1 / (1 + math.exp(-min(max(fine, -mixlm.LIMIT), mixlm.LIMIT)))
                    total += math.log(q if bit else 1 - q)
                    moved, n = moved + (bit - q) * x[0], n + 1
                    drawn[s] += bit - q
                    many[s] += 1
            own, lean = own + mixlm.RATE * moved / math.sqrt(n), lean + mixlm.REFINE_RATE * drawn / np.sqrt(np.maximum(many, 1))
        assert abs(total - got[d]) < 2e-3 * max(1, len(words)), d


def test_next_tokens_add_up_to_one():
    """Over all next tokens (first bits of a hash, unseen words and the end) the coded bits are a distribution."""
    block, states, first = small_model()
    n = 1 << mixlm.BITS
    block.hashes = np.arange(n, dtype=np.uint64) << np.uint64(64 - mixlm.BITS) | np.uint64(5)
    block.data, block.top = np.frombuffer(b"w" * n, np.uint8), None
    block.starts, block.ends = np.arange(n), np.arange(1, n + 1)
    head = [3, 9, 3, 9, 12, 3, 9]  # what follows 3 9 was 3 first, then 12

    def log(codes, known, end):
        block.codes, block.counts, block.first = np.array(codes, np.int32), np.array([len(codes)]), np.array([0])
        t = mixlm.Tokens(block, np.array([0]), states)
        if not end:  # without the end's bit
            t.end[-1], t.there[-1] = True, False
        bits = t.bits
        t.bits = lambda k, order: tuple(v[: None if end else -1] for v in bits(k, order))
        return first.log(t, known)[0]

    flags = lambda m, new=False: np.array([True] * (m - 1) + [not new, False])
    base = log(head, flags(len(head)), False)
    total = math.exp(log(head, flags(len(head)), True) - base) + math.exp(log([*head, 7], flags(len(head) + 1, True), False) - base)
    total += sum(math.exp(log([*head, k], flags(len(head) + 1), False) - base) for k in range(n))
    # the repeated word is told by one flag; the mass of telling it by its bits is never used
    assert 0.95 < total < 1 + 1e-5


def test_hash_costs_are_a_distribution():
    rng = np.random.default_rng(4)
    h = np.sort(np.unique(rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2)))
    counts = rng.poisson(0.4, (len(h), mixlm.STATES))
    counts[counts.sum(axis=1) == 0, 0] = 1
    for start in (0, 2, 8):
        cost = mixlm.hash_costs(h, counts, start) if start else mixlm.hash_costs(h, counts, 1)
        group = h >> np.uint64(64 - max(start, 1))
        for g in np.unique(group):
            total = (2.0 ** -cost[group == g]).sum(axis=0)
            assert (total <= 1 + 1e-9).all() and (total > 0.999).all()


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"those", "thé".encode(), b"a"] * 3
    tables = [np.zeros((s, 2), np.float32) for s in mixlm._SPELL_SIZES]
    slots, bit, _ = mixlm.spell_bits(words, np.arange(15) % 3)
    for k in range(mixlm.SPELL_TABLES):
        np.add.at(tables[k], (slots[k], bit), 1)
    rng = np.random.default_rng(1)
    own = mixlm.Speller(tables, rng.normal(0.2, 0.1, (9, 8)), rng.normal(0, 1, (9, 33)))

    def head(x):
        """The probability of the bytes x, whatever follows: all last bytes but the blank's."""
        slots, bit, _ = mixlm.spell_bits([x], np.array([1]))
        x_, gate = own.inputs(slots)
        p = mixlm.squash(mixlm.refined(np.einsum("bi,bi->b", own.weights[gate], x_), own.refine, gate * 33))
        return np.where(bit == 1, p, 1 - p)[: 8 * len(x)].prod(), 2 ** own.log2([x], np.array([1]))[0]

    for x in (b"", b"t", b"th"):
        before = head(x)[0] if x else 1.0
        assert abs(sum(head(x + bytes([k]))[0] for k in range(256)) / before - 1) < 1e-9
    assert abs(head(b"th")[1] / head(b"th ")[0] - 1) < 1e-9


def test_lm_learns_from_counts_without_the_bit_itself():
    """The tables made beforehand say what a bit's own counts do when it is taken off."""
    block, states, _ = small_model(5)
    sizes = mixlm.table_sizes(3000)
    tables = [np.zeros(2 * s, np.int64) for s in sizes]
    mixlm.count_contexts(block, states, sizes, tables)
    tables = [t.reshape(-1, 2) for t in tables]
    lesson = mixlm.FirstBits.teaching(tables)
    t = mixlm.Tokens(block, np.flatnonzero(~block.held), states)
    token, kind, bit = t.bits(np.ones(len(t.code), bool))
    x, gate = lesson.inputs(t, token, kind, bit)
    want = kind.copy()
    for k, slot in enumerate(t.slots(token, kind, sizes)):
        n = tables[k][slot].astype(float)
        n -= (np.arange(2) == bit[:, None]) & (kind != mixlm.SEEN)[:, None] & (n > 0)
        assert np.abs(x[:, k] - np.log((n[:, 1] + 0.2) / (n[:, 0] + 0.2))).max() < 1e-2
        if k in (2, 3):
            want += mixlm.KINDS * (3 if k == 3 else 1) * np.searchsorted([1, 8], n.sum(axis=1), side="right")
    assert (gate == want).all()


def test_lm_leaves_no_shuffle_files(spark):
    """Each of its jobs' files go when it ends, not at some collection of the driver's garbage."""
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    got = mixlm.score(spark.read.parquet(f"{SF}/documents.parquet"), F.col("doc_id") % 10 == 0)
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert got.count() == got.count() > 0  # the query's own jobs are not swept


def test_lm_blocks_come_one_by_one(spark):
    """A batch of blocks is bounded by bytes, so what JVM and Python hold does not follow the blocks of a task."""
    mixlm.score(frame(spark, ["a b"]), F.lit(False))
    rows = spark.range(0, 6, 1, 1).select(F.repeat(F.lit("x"), 10_000_000).cast("binary").alias("words"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert [r.n for r in sizes] == [1] * 6


def test_states_and_repeats_do_not_look_ahead():
    block, states, first = small_model(3)
    docs = np.flatnonzero(block.counts > 20)[:10]
    whole = mixlm.Tokens(block, docs, states)
    counts = block.counts.copy()
    block.counts = np.where(np.isin(np.arange(len(counts)), docs), 15, counts)
    part = mixlm.Tokens(block, docs, states)
    keep, head = whole.pos < 15, part.pos < 15
    for name in ("state", "run", "hit", "one", "pair", "letter"):
        assert (getattr(whole, name)[keep] == getattr(part, name)[head]).all(), name


def test_scores_do_not_depend_on_buckets_or_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 10 == 0
    a = {r.doc_id: r for r in mixlm.score(docs, held).collect()}
    b = {r.doc_id: r for r in mixlm.score(docs, held, names=40).collect()}  # buckets finer than the first bits
    assert set(a) == set(b)
    for d, r in a.items():
        assert r.base_score == pytest.approx(b[d].base_score) and r.n_known == b[d].n_known
    # each bucket learns weights of its own, from some 40 words here
    assert np.corrcoef([a[d].score for d in a], [b[d].score for d in a])[0, 1] > 0.99
    same = {r.doc_id: r.score for r in mixlm.score(docs.repartition(1), held).collect()}
    assert np.corrcoef([a[d].score for d in a], [same[d] for d in a])[0, 1] > 0.999


def test_lm_beats_unigrams_on_held_out(spark):
    got = queries()["op9_mixlm"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.95 * got.b


# 10

def test_nearest_agree_with_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[500:560] = x[499]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [1.0, None] * 8), (2150, [float("nan")] * 16), (2200, [float("inf")] * 16), (None, [1.0] * 16), (2250, [1.0, 2.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0, shard=300).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = x.astype(np.float32).astype(np.float64)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 900, 50):
        s = u[q] @ u.T
        order = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        assert [round(v, 9) for _, v in got[q]] == sorted((round(v, 9) for _, v in got[q]), reverse=True) and len(got[q]) == 5
        hit += len(set(order) & {i for i, _ in got[q]})
        total += 5
    assert set(got) == set(range(0, 900, 50)) and hit / total >= 0.95
    assert [i for i, _ in got[500]][:5] == [499, 501, 502, 503, 504]
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_over_full_shards_of_clustered_vectors(spark):
    """Production parameters: three shards of some 3,000 vectors in 40 clusters."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 12))[rng.integers(0, 40, 9000)] + 0.15 * rng.normal(size=(9000, 12))).astype(np.float32)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 9000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / (5 * 180) >= 0.95


def test_tiny_and_huge_vectors_take_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)  # several blocks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    scale = [1e-200, 1e200, 1.0, 5e-324 * 2**60, 1e-310]
    rows = [(i, (v * scale[i % 5]).tolist(), "c") for i, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 5 < 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    y = np.array([np.array(v) / np.abs(v).max() for _, v, _ in rows])
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    for q in range(40):
        order = [i for i in np.argsort(-(u @ u[q]), kind="stable").tolist() if i != q][:5]
        assert [i for i, _ in got[q]] == order
        assert np.allclose([s for _, s in got[q]], (u @ u[q])[order], atol=1e-12)


def test_cosines_of_plain_vectors_are_exact(spark):
    rng = np.random.default_rng(6)
    pairs = [(rng.normal(size=7).tolist(), rng.normal(size=7).tolist()) for _ in range(50)]

    def plain(a, b):
        dot = lambda x, y: reduce(lambda t, pq: t + pq[0] * pq[1], zip(x, y, strict=True), 0.0)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    for name in "ab":
        got = ann._measured(got, name).withColumnsRenamed({"scaled": f"{name}_scaled", "norm": f"{name}_norm"})
    got = got.select("i", (ann.dot(F.col("a_scaled"), F.col("b_scaled")) / (F.col("a_norm") * F.col("b_norm"))).alias("c")).orderBy("i").collect()
    assert all(r.c == plain(*pairs[r.i]) for r in got)


# the pipeline

def jaccard(a, b, width=5):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


def test_near_dedup_stage_agrees_with_all_pairs(spark):
    """One of each group that links of Jaccard 0.8, or of 4 fingerprint bits, join; the groups by comparing all pairs."""
    import corpus_pipeline as P

    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(25):
        own = rng.choices(words, k=rng.randint(3, 90))
        rows.append(" ".join(own))
        for _ in range(rng.randint(0, 5)):
            own = own[:]
            own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += ["", None, "  ", rows[0], rows[0]]
    docs = frame(spark, rows)
    text = [t or "" for t in rows]
    fp = simhash.fingerprints([t.encode() for t in text], 5).astype(np.uint64).tolist()
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 or jaccard(text[i], text[j]) >= 0.8 - 1e-9:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect()) == sorted(set(label))


def test_other_stages_agree_with_one_text_at_a_time(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = docs.collect()
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.score(np.array([plain_features(r.text or "") for r in own])) >= 0.5
    assert sorted(r.doc_id for r in P.good_quality(spark, docs, SF).collect()) == sorted(r.doc_id for r, g in zip(own, good, strict=True) if g)
    trees = pii.train()
    want = {r.doc_id: (None if r.text is None else pii.redact(r.text, pii.spans_of([r.text], trees)[0][1])) for r in own}
    got = P.redacted(spark, docs, SF).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text or "") for r in got)
    items = [re.findall("[a-z0-9]+", (r.text or "").lower().encode().decode("ascii", "ignore")) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in P.decontaminated(spark, docs, SF).collect()}
    for r in own:  # an item that stands there whole has leaked
        text = " " + " ".join(re.findall("[a-z0-9]+", (r.text or "").lower())) + " "
        if any(i and f" {' '.join(i)} " in text for i in items):
            assert r.doc_id not in kept


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    kept = P.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept and {r.doc_id for r in kept} < ids and all(r.round_trip for r in kept)
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert P.run(spark, empty).count() == 0
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_lm_inputs_lie_side_by_side():
    """Steps over inputs run along the bits, not over a few numbers a bit at a time; a bit's sum does not depend on the block that it is in."""
    rng = np.random.default_rng(5)
    block, states, mixer = small_model(5)
    t = mixlm.Tokens(block, np.arange(len(block.held)), states)
    token, kind, _ = t.bits(rng.random(len(t.code)) < 0.8)
    x, gate = mixer.inputs(t, token, kind)
    assert all(x[:, k].flags.c_contiguous for k in range(x.shape[1]))
    own = mixlm.Speller([rng.integers(0, 9, (s, 2)) for s in mixlm._SPELL_SIZES], rng.normal(0.2, 0.1, (9, 8)), rng.normal(0, 1, (9, 33)))
    slots, bit, _ = mixlm.spell_bits([bytes(rng.integers(97, 123, 9).tolist()) for _ in range(300)], rng.integers(0, 8, 300))
    assert len(bit) == 24000 > mixlm._SOME
    y, spell_gate = own.inputs(slots, bit)
    assert all(y[:, k].flags.c_contiguous for k in range(y.shape[1]))
    for inputs, of, w in ((x, gate, mixer.weights), (y, spell_gate, own.weights)):
        assert np.allclose(mixlm.weighed(inputs, of, w), (inputs * w[of]).sum(axis=1), atol=1e-4)
    for k in range(mixlm.SPELL_TABLES):  # a bit's slot does not depend on the words beside it
        lone = mixlm.spell_bits([b"end"], np.array([3]))[0][k]
        assert (mixlm.spell_bits([b"x" * 3000, b"end"], np.array([1, 3]))[0][k][-len(lone) :] == lone).all()
