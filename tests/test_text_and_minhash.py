import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamsift.functions import text as T
from loamsift.functions.hashing import EMPTY, PRIME, permutations
from loamsift.operators.dedup import deduplicate, drop_duplicates
from loamsift.operators.exact import content_table, keep_first
from loamsift.operators.jaccard import exact_pairs
from loamsift.operators.minhash import band_keys, candidate_pairs, signature_of, signatures, similarity, with_similarity
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig, StreamConfig, optimal_bands

FOX = "the quick brown fox jumps over the lazy dog in the park near the river"
CAT = "a small grey cat sleeps on the warm window sill of an old stone house"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def corpus(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.4:
            w = rng.choice(out).split()
            for k in range(len(w)):
                if rng.random() < 0.02:
                    w[k] = f"e{rng.randrange(99)}"
        else:
            w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 60))]
        out.append(" ".join(w))
    return out


def plain_shingles(t, n=5):
    w = (t or "").split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n,t,want", [(128, 0.5, (32, 4)), (128, 0.7, (16, 8)), (128, 0.85, (8, 16)), (128, 0.95, (4, 32)), (64, 0.85, (4, 16)), (256, 0.85, (16, 16))])
def test_bands(n, t, want):
    assert optimal_bands(n, t) == want


@pytest.mark.parametrize("make", [lambda: DedupConfig(1.5), lambda: DedupConfig(permutations=0), lambda: DedupConfig(ngram=0), lambda: SemanticConfig(-0.1), lambda: HybridConfig(2), lambda: StreamConfig(fp_rate=2)])
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_shingles(spark):
    texts = ["one two three four five", "a b c", "", None, "  spaced out  words \n here again now ", "x x x x x x x"]
    rows = frame(spark, texts).select("doc_id", T.shingles(F.col("text"), 3).alias("s")).collect()
    for r in rows:
        assert set(r.s) == plain_shingles(texts[r.doc_id], 3) and len(set(r.s)) == len(r.s)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=8, max_size=40), st.lists(st.sampled_from("abcdef"), min_size=8, max_size=40))
def test_estimate_is_near_jaccard(x, y):
    import numpy as np

    s, t = map(np.array, signature_of([" ".join(x), " ".join(y)], DedupConfig(permutations=256, ngram=2)))
    u, v = plain_shingles(" ".join(x), 2), plain_shingles(" ".join(y), 2)
    assert abs((s == t).mean() - len(u & v) / len(u | v)) < 0.2


def test_signatures_are_plain_arithmetic():
    from hashlib import md5

    texts = ["one two three", " ".join(f"w{i % 7} é{i}" for i in range(3000)), "", "a b c d e f"]
    for text, got in zip(texts, signature_of(texts)):
        v = [int(md5(w.encode()).hexdigest()[:15], 16) % PRIME for w in text.split()]
        grams = [v[i : i + 5] for i in range(max(1, len(v) - 4))] if v else []
        h = [sum(x * pow(1_000_003, 5 - k, PRIME) for k, x in enumerate(g)) % PRIME for g in grams]
        assert got == [min([(x * a + b) % PRIME for x in h], default=EMPTY) for a, b in permutations(128)]


def test_an_id_of_unlike_rows_is_no_loss(spark):
    rows = spark.createDataFrame([(1, FOX), (2, FOX), (2, CAT)], "doc_id long, text string")
    with pytest.raises(ValueError, match="id 2"):
        drop_duplicates(rows)


def test_signatures(spark):
    rows = {r.doc_id: r.signature for r in signatures(frame(spark, [FOX, FOX, CAT, "", None]), DedupConfig()).collect()}
    assert rows[0] == rows[1] != rows[2] and rows[3] == rows[4] == [EMPTY] * 128 and all(0 <= v < PRIME for v in rows[0])
    one = frame(spark, [FOX, CAT]).select(F.lit(1).alias("k")).limit(1)
    got = one.select(similarity(F.array(*map(F.lit, rows[0])), F.array(*map(F.lit, rows[2]))).alias("s"), similarity(F.array().cast("array<long>"), F.array().cast("array<long>")).alias("z")).first()
    assert got.s < 0.3 and got.z == 0.0


@pytest.mark.parametrize("t", [0.5, 0.85])
def test_exact_pairs_are_brute_force(spark, t):
    texts = corpus(3)
    s = [plain_shingles(x) for x in texts]
    want = {(i, j): len(s[i] & s[j]) / len(s[i] | s[j]) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= t}
    got = {(r.doc_a, r.doc_b): r.similarity for r in exact_pairs(frame(spark, texts), t).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want


def plain_dedup(sigs, config):
    """Positions to representatives by union-find over banded pairs."""
    b, r = config.bands
    parent = {i: i for i in sigs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    cand = good = 0
    for i in sorted(sigs):
        for j in sorted(sigs):
            if i < j and any(sigs[i][k * r : k * r + r] == sigs[j][k * r : k * r + r] for k in range(b)):
                cand += 1
                if not config.verify or sum(x == y for x, y in zip(sigs[i], sigs[j])) / len(sigs[i]) >= config.threshold:
                    good += 1
                    x, y = sorted((root(i), root(j)))
                    parent[y] = x
    return {i: root(i) for i in sigs}, cand, good


@pytest.mark.parametrize("config", [DedupConfig(), DedupConfig(0.7), DedupConfig(0.5, verify=False)])
def test_pipeline_is_union_find(spark, config):
    texts = [*corpus(5), "", None, FOX, FOX]
    docs = frame(spark, texts)
    sigs = {r.doc_id: r.signature for r in signatures(docs, config).collect()}
    want, cand, good = plain_dedup(sigs, config)
    d = deduplicate(docs, config)
    assert {r.doc_id: r.representative_id for r in d.decisions().collect()} == want
    s = d.stats().first()
    assert (s.total, s.unique_docs, s.candidate_pairs, s.verified_pairs) == (len(texts), sum(k == v for k, v in want.items()), cand, good)
    assert {r.representative_id: r.duplicates for r in d.clusters().collect()} == {h: [i for i in sorted(want) if want[i] == h and i != h] for h in set(want.values()) if sum(v == h for v in want.values()) > 1}
    assert s.cluster_count == d.sizes().count()


def test_two_clusters(spark):
    docs = frame(spark, [FOX] * 5 + [CAT] * 5 + ["something else entirely that nobody wrote before", "and one more text that is unlike all of the others"])
    s = deduplicate(docs).stats().first()
    assert (s.cluster_count, s.duplicate_count, s.unique_docs) == (2, 8, 4)


def test_fifty_copies_and_no_documents(spark):
    d = deduplicate(frame(spark, [FOX] * 50))
    assert d.keep().count() == 1 and d.remove().count() == 49
    s = deduplicate(spark.createDataFrame([], "doc_id long, text string")).stats().first()
    assert (s.total, s.duplicate_count, s.duplicate_ratio, s.cluster_count) == (0, 0, 0.0, 0)


def test_columns_are_kept(spark):
    docs = frame(spark, [FOX, FOX, CAT]).withColumn("similarity", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("n", F.lit(2))
    out = drop_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_three_equal_documents_meet_once(spark):
    sigs = signatures(frame(spark, [FOX] * 3))
    pairs = sorted(tuple(r) for r in with_similarity(candidate_pairs(band_keys(sigs)), sigs).collect())
    assert pairs == [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]


def test_keep_first_and_contents(spark):
    d = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "a"), (4, None, "a"), (None, "a", None)], "k long, x string, y string")
    got = {r.k: (r.keep_k, r.is_duplicate) for r in keep_first(d, ["x", "y"], ["k"]).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (3, True), None: (1, True)}
    c = content_table(d, "x").collect()
    assert sorted((r.size, r.references) for r in c) == [(0, 2), (1, 3)]


def test_memory_of_signatures_follows_one_text_and_not_a_batch():
    import tracemalloc

    import pyarrow as pa

    from loamsift.functions.words import Powers
    from loamsift.operators import minhash as M

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(20_000)) for _ in range(40)] + [None, "", "a b"]
    batch, known, powers = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]), M.WordResidues(), Powers()
    tracemalloc.start()
    got = [M.shingle_hashes(part.column(1), 5, known, powers) for part in M.sliced(batch)]
    parts = [len(per) for _, per in got]
    del got
    held = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sum(parts) == len(texts) and max(parts[:-1]) <= 4 and held[1] < 60e6
    assert [len(x) for x in M.sliced(batch.slice(0, 0))] == []


@pytest.mark.parametrize("threshold", [0.3, 0.85])
def test_exact_pairs_move_only_what_several_sets_have(spark, threshold, monkeypatch):
    from loamsift.operators import jaccard as J

    monkeypatch.setattr(J, "HASHES", 50)
    written, put = {}, J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, label: written.setdefault(label, put(df, label)))
    texts = corpus(12) + [" ".join(f"only{i}_{k}" for k in range(200)) for i in range(20)] + ["", None, "a"]
    got = {(r.doc_a, r.doc_b): r.similarity for r in exact_pairs(frame(spark, texts), threshold).collect()}
    s = [set(plain_shingles(t)) for t in texts]
    want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(s) for b, y in enumerate(s) if a < b and x & y and len(x & y) / len(x | y) >= threshold}
    assert got == pytest.approx(want) and want
    held = written["held"].selectExpr("sum(size(s))").first()[0]
    assert held == sum(any(g in o for k, o in enumerate(s) if k != i) for i, x in enumerate(s) for g in x)
