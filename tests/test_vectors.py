import numpy as np
import pytest
from pyspark.sql import functions as F

from loamsift.operators import codec, quantize as Q
from loamsift.operators.greedy import greedy_keep, removed_by_greedy
from loamsift.operators.minhash import signatures
from loamsift.operators.semantic import embedded, estimated_pairs, hybrid_keep, semantic_keep
from loamsift.operators.similarity import all_pairs, approximate_top_k, knn_pairs, range_search, top_k
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig
from loamsift.plans.queries import QUERIES
from tests.test_text_and_minhash import corpus, frame


def vectors(n=60, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[n // 2 :] = v[: n - n // 2] + 0.4 * rng.standard_normal((n - n // 2, dim))
    v[5] = v[4]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("rows", [7, 4096])
def test_exact_search(spark, rows):
    v = vectors()
    s, d = np.round(v @ v.T, 6), table(spark, v)
    want = {(i, j): s[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.6}
    assert {(r.id_a, r.id_b): r.similarity for r in all_pairs(d, 0.6, block_rows=rows).collect()} == pytest.approx(want)
    assert range_search(d, 0.6, block_rows=rows).count() == 2 * len(want)
    near = {(r.query_id, r["rank"]): r.doc_id for r in top_k(d, 4, block_rows=rows).collect()}
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))
        assert [near[i, k] for k in range(1, 5)] == order[:4]


def test_knn_pairs_take_k_before_the_threshold(spark):
    v = vectors()
    s = np.round(v @ v.T, 6)
    want = {(i, j) for i in range(len(v)) for j in sorted(range(len(v)), key=lambda j: (-s[i, j], j))[:3] if j > i and s[i, j] >= 0.3}
    assert {(r.id_a, r.id_b) for r in knn_pairs(table(spark, v), 0.3, 3).collect()} == want


def test_approximate_recall(spark):
    d = table(spark, vectors(200))
    exact, near = ({(r.query_id, r.doc_id) for r in f(d, 1).collect()} for f in (top_k, lambda d, k: approximate_top_k(d, k, dim=16, tables=24)))
    assert len(exact & near) >= 0.9 * len(exact)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_approximate_recall(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    exact = {(r.query_id, r.doc_id): r.similarity for r in top_k(d, 10).collect()}
    near = {(r.query_id, r.doc_id): r.similarity for r in QUERIES["ann_lsh_topk"](spark, f"/root/testdata/{sf}").collect()}
    assert len(near) == len(exact) and len(exact.keys() & near.keys()) >= 0.9 * len(exact)
    assert all(near[p] == pytest.approx(exact[p], abs=2e-6) for p in exact.keys() & near.keys())


def plain_greedy(n, edges):
    kept = []
    for i in range(n):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    return kept


def test_greedy(spark):
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "doc_a long, doc_b long")
    assert sorted(r.doc_id for r in removed_by_greedy(chain).collect()) == [1, 3]
    v = vectors(80)
    s = np.round(v @ v.T, 6)
    edges = {(i, j) for i in range(80) for j in range(i + 1, 80) if s[i, j] >= 0.3}
    got = sorted(r.vec_id for r in semantic_keep(table(spark, v), SemanticConfig(0.3)).collect())
    assert got == plain_greedy(80, edges) == sorted(r.vec_id for r in hybrid_keep(table(spark, v), HybridConfig(semantic_threshold=0.3), "vec_id").collect())


def test_hybrid_without_vectors(spark):
    texts = [*corpus(8), "", None]
    docs = frame(spark, texts)
    sig = {r.doc_id: np.array(r.signature) for r in signatures(docs, DedupConfig(0.7)).collect()}
    edges = {(i, j) for i in sig for j in sig if i < j and (sig[i] == sig[j]).mean() >= 0.7}
    got = sorted(r.doc_id for r in hybrid_keep(docs, HybridConfig(verify_with_semantic=False)).collect())
    assert got == plain_greedy(len(texts), edges)
    pairs = {(r.doc_a, r.doc_b) for r in estimated_pairs(signatures(docs, DedupConfig(0.7)), 128, 0.7).collect()}
    assert pairs == edges


def test_mock_vectors(spark):
    rows = embedded(frame(spark, ["a", "a", "b"])).orderBy("doc_id").collect()
    assert rows[0].embedding == rows[1].embedding != rows[2].embedding and abs(np.linalg.norm(rows[2].embedding) - 1) < 1e-9


@pytest.mark.parametrize("method,bound", [("int8", 1 / 254), ("int4", 1 / 14), ("nf4", 0.16)])
def test_quantisation_errors(spark, method, bound):
    v = vectors(20, 64)
    v[3] = np.abs(v[3]) + 1  # a range without zero
    v[4] = 0
    for r in Q.quantization_errors(table(spark, v), method).collect():
        span = np.abs(v[r.vec_id]).max()
        assert r.max_error <= bound * max(span, 1e-9) * 1.01 + 1e-8 and r.mae <= r.rmse + 1e-8 <= r.max_error + 2e-8
    assert Q.quantization_errors(table(spark, v), "int8").first().ratio == 4.0


def test_quantised_values(spark):
    d = spark.createDataFrame([([0.0, 0.5, 1.0, -0.5],)], "v array<double>")
    s = Q.int8_scale(F.col("v"))
    assert d.select(Q.int8(F.col("v"), s).alias("q")).first().q == [0, 64, 127, -64]
    n = d.select(Q.nf4(F.col("v"), Q.nf4_scales(F.col("v"), 4), 4).alias("q"))
    assert n.select(F.hex(Q.packed_nibbles(F.col("q"))).alias("h"), "q").first().h == "C72F"
    with pytest.raises(Exception, match="multiple"):
        d.select(Q.nf4_scales(F.col("v"), 3)).collect()


def test_byte_groups_and_deltas():
    assert codec.group_bytes(bytes.fromhex("AA11BB22CC33"), 2) == bytes.fromhex("AABBCC112233")
    data = np.random.default_rng(1).integers(0, 256, 400).astype(np.uint8).tobytes()
    for w in (2, 4):
        assert codec.ungroup_bytes(codec.group_bytes(data, w), w) == data
    for t in ("raw", "bf16", "fp32"):
        assert codec.decompress(codec.compress(data, t), len(data), t) == data
    assert codec.decompress(codec.compress(b"", "fp32"), 0, "fp32") == b"" and codec.sparsity_of(b"") == 1.0
    assert codec.xor(codec.xor(data, data[::-1]), data[::-1]) == data and codec.xor(data, None) == data
    for bad in (lambda: codec.group_bytes(b"abc", 2), lambda: codec.xor(b"a", b"ab"), lambda: codec.decompress(codec.compress(data), 7)):
        with pytest.raises(ValueError):
            bad()
    x = np.array([1.0, -2.5, 3.140625], np.float32)
    assert (codec.from_bf16(codec.bf16(x)) == x).all()


def test_delta_chain(spark):
    rng = np.random.default_rng(2)
    rows, last = [], None
    for m in ("a", "b"):
        for k in range(4):
            last = rng.integers(0, 256, 80 if k else 40).astype(np.uint8) if k < 2 else np.where(rng.random(80) < 0.05, last ^ 1, last)
            rows.append((m, k, last.astype(np.uint8).tobytes()))
    rows.append(("b", 4, None))
    d = spark.createDataFrame(rows, "model string, step long, data binary").repartition(3)
    packed = codec.delta_encoded(d, "model", "step", "data")
    by = {(r.model, r.step): r for r in packed.collect()}
    assert by["a", 0].reference_step is None and by["a", 1].reference_step is None and by["a", 2].reference_step == 1 and by["a", 2].sparsity > 0.8
    back = {(r.model, r.step): None if r.data is None else bytes(r.data) for r in codec.delta_decoded(packed, "model", "step").collect()}
    assert back == {(m, k): x for m, k, x in rows}


def test_greedy_keeps_columns(spark):
    d = spark.createDataFrame([(0, "x", 1), (1, "y", 2), (None, "z", 3)], "doc_id long, a string, b int")
    out = greedy_keep(d, spark.createDataFrame([(0, 1)], "doc_a long, doc_b long"))
    assert out.columns == d.columns and {r.a for r in out.collect()} == {"x", "z"}


@pytest.mark.parametrize("include_self", [False, True])
@pytest.mark.parametrize("k", [1, 10])
def test_nearest_of_a_block_hold_a_slab_and_not_the_block(k, include_self):
    import tracemalloc

    from loamsift.operators.similarity import _above, _best

    rng = np.random.default_rng(3)
    v = rng.standard_normal((5000, 8))
    v[100:160] = v[7]  # equal ones: the lesser id first
    v[200], v[4000:4100] = 0, np.round(v[4000:4100])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    ids = np.sort(rng.permutation(20_000)[:5000])
    tracemalloc.start()
    x, y, w = (np.concatenate(c) for c in zip(*_best(ids, v, ids, v, k, include_self)))
    pairs = {(a, b): s for p in _above(ids, v, ids, v, True, 0.97) for a, b, s in zip(*map(np.ndarray.tolist, p))}
    assert tracemalloc.get_traced_memory()[1] < 120e6  # all cosines are 200
    tracemalloc.stop()
    s = np.round(np.einsum("id,jd->ij", v, v), 6)
    assert pairs == {(int(ids[i]), int(ids[j])): s[i, j] for i, j in np.argwhere(s >= 0.97) if i < j}
    if not include_self:
        np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    assert (x == np.repeat(ids, k)).all() and (y == ids[order].ravel()).all() and (w == np.take_along_axis(s, order, 1).ravel()).all()


def test_ranges_are_sought_once(spark):
    plan = range_search(table(spark, vectors()), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan
