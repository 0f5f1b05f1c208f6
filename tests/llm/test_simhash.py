import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from toneforge.llm import graph, simhash


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    label = {k: k for k in prints}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in ids}


def near_texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 90]))))
    return texts


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(5)
    u = rng.integers(0, 2**63, 4000, dtype=np.int64)
    v = u.copy()
    for i in range(len(v)):
        for b in rng.choice(63, rng.integers(0, 5), replace=False):
            v[i] ^= np.int64(1) << np.int64(b)
    stored, looked = [set() for _ in u], [set() for _ in v]
    for sets, x, probe in ((stored, u, False), (looked, v, True)):
        for r, k in zip(*simhash.key_rows(x, probe), strict=True):
            sets[r].add(int(k))
    assert all(a & b for a, b in zip(stored, looked, strict=True))


def test_golay_code_is_perfect():
    g = simhash.golay()
    v = np.arange(0, 1 << 23, 997, dtype=np.int64)
    s = g.low[v & 4095] ^ g.high[v >> 12]
    word = v ^ g.near[s]
    assert not (g.low[word & 4095] ^ g.high[word >> 12]).any()
    assert set(g.weight.tolist()) == {0, 1, 2, 3}


def test_classes_agree_with_brute_force(spark):
    texts = [None, "", " \t\n", "A b", "a B", *near_texts(160, 3), "word " * 30_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, width=4).collect()}
    prints = {i: brute_print(t, 4) for i, t, _ in rows}
    assert {k: r.fp & (1 << 64) - 1 for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_classes(prints)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(True, None, 3), (False, 3, 3), (False, 3, 3), (False, 9, 9)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (900, 800), (800, 900)]
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}, 800: 800, 900: 800}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_links_once_each(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ m for m in (0, 1, 3, 0xF, 0x1F, 1 << 30, 1 << 50 | 1 << 30)]
    found = [(r.src, r.dst) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert sorted(found) == sorted((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4)
    assert spark.range(1).select(F.lit(1)).count() == 1


def brute_kept(texts, width=5, similarity=0.8):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in words]
    prints = [brute_print(t, width) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (prints[i] ^ prints[j]).bit_count() <= 4 or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return sorted(set(label))


def test_all_similar_sets_are_one_group(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [None, "", "a b", "A  b"]
    for _ in range(25):
        w = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(rng.randint(1, 4)):
            texts.append(" ".join(w))
            w = list(w)
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(1, 3))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == brute_kept(texts)
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def _plans(monkeypatch, *modules):
    """The plans of all tables that the modules spool."""
    plans = []
    for m in modules:

        def kept(df, *args, own=m.spool):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return own(df, *args)

        monkeypatch.setattr(m, "spool", kept)
    return plans


def test_links_and_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans = _plans(monkeypatch, simhash, graph)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(near_texts(60, 4))], "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "BroadcastExchange" in p]


def test_near_dedup_sends_no_table_to_the_driver(spark, monkeypatch):
    """Neither links nor sets, groups or the rows that go are broadcast, in no table that is written on the way and not at the end."""
    plans = _plans(monkeypatch, simhash, graph)
    out = simhash.deduplicated(spark.createDataFrame(list(enumerate(near_texts(60, 4))), "doc_id long, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]


def test_components_agree_by_rounds_and_in_one_task(spark, monkeypatch):
    """A small graph takes two tables, whatever its depth; rounds, for larger ones, end in one task or go on to the end."""
    rng = random.Random(6)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(1000 - i, 999 - i) for i in range(60)] + [(5000, 4000 + i) for i in range(30)]
    table = spark.createDataFrame(edges, "src long, dst long")
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    want = {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in edges)}
    for most in (1 << 20, 20, 0):
        monkeypatch.setattr(graph, "AT_ONCE", most)
        plans = _plans(monkeypatch, graph)
        assert {r.node: r.label for r in graph.components(table).collect()} == want
        assert most < 100 or len(plans) == 2
        assert graph.components(table.where("src = dst")).count() == 0


def test_near_dedup_leaves_no_broadcast_but_the_last(spark, monkeypatch):
    """What is sent to the tasks of one table goes when it is written; only the marks that the result itself asks stay."""
    sent, own = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(own(self, value)) or sent[-1])
    docs = spark.createDataFrame(list(enumerate(near_texts(60, 4))), "doc_id long, text string")
    kept = simhash.deduplicated(docs)
    alive = [b for b in sent if b._jbroadcast is not None and b._jbroadcast.isValid()]
    assert len(sent) > 3 and alive == sent[-1:]
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(near_texts(60, 4))
