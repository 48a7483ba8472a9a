"""Every operator as a query over whole tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.functions import text as T
from loamsift.functions.hashing import bloom_memory, content_key, exact_memory
from loamsift.functions.paths import device_serves, normalize_path, numel, version, version_serves, with_dynamic_batch
from loamsift.functions.vectors import cosine_distance, euclidean, norm
from loamsift.operators import catalogue, codec, first_seen as FS
from loamsift.operators.dedup import Deduplicated, deduplicate
from loamsift.operators.exact import address_path, content_table, keep_first
from loamsift.operators.greedy import removed_by_greedy
from loamsift.operators.jaccard import exact_pairs
from loamsift.operators.minhash import band_keys, bucket_stats, candidate_pairs, signatures, with_similarity
from loamsift.operators.quantize import quantization_errors
from loamsift.operators.semantic import embedded, hybrid_keep, semantic_keep
from loamsift.operators.similarity import all_pairs, approximate_top_k, knn_pairs, range_search, top_k
from loamsift.plans import sql as S
from loamsift.plans.config import DedupConfig, HybridConfig, SemanticConfig, StreamConfig, optimal_bands
from loamsift.session import materialize

THRESHOLD, NEAR = 0.85, 0.4  # Jaccard; cosine, which the embeddings table reaches
CONFIG = DedupConfig()
QUERIES, ORACLES = {}, {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# text


@query("WITH " + S.shingles() + " SELECT doc_id, md5(shingle) AS shingle FROM sh")
def text_shingles(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.transform(T.shingles(F.col("text")), lambda s: F.md5(s))).alias("shingle"))


@query("WITH " + S.shingles() + " SELECT doc_id, len(any_value(ws))::BIGINT AS n_words, count(shingle)::BIGINT AS n_shingles FROM d LEFT JOIN sh USING (doc_id) GROUP BY doc_id")
def shingle_stats(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(T.shingles(F.col("text"))).cast("long").alias("n_shingles"))


@query(S.exact_pairs(THRESHOLD))
def exact_jaccard_pairs(spark, sf_dir):
    p = exact_pairs(_t(spark, sf_dir, "documents"), THRESHOLD)
    return p.select("doc_a", "doc_b", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_doc_id, min(doc_id) OVER (PARTITION BY text) <> doc_id AS is_duplicate FROM documents")
def exact_dedup_documents(spark, sf_dir):
    return keep_first(_t(spark, sf_dir, "documents"), ["text"], ["doc_id"])


@query("SELECT conv_id, turn, first(conv_id) OVER w AS keep_conv_id, first(turn) OVER w AS keep_turn, row_number() OVER w > 1 AS is_duplicate FROM conversations WINDOW w AS (PARTITION BY role, text ORDER BY conv_id, turn)")
def exact_dedup_conversations(spark, sf_dir):
    return keep_first(_t(spark, sf_dir, "conversations"), ["role", "text"], ["conv_id", "turn"])


@query("SELECT page_id, min(page_id) OVER (PARTITION BY html) AS keep_page_id, min(page_id) OVER (PARTITION BY html) <> page_id AS is_duplicate FROM pages")
def exact_dedup_pages(spark, sf_dir):
    return keep_first(_t(spark, sf_dir, "pages"), ["html"], ["page_id"])


@query("SELECT sha256(html) AS address, substr(sha256(html), 1, 2) || '/' || substr(sha256(html), 3, 2) || '/' || sha256(html) AS path, octet_length(encode(any_value(html)))::BIGINT AS size, count(*)::BIGINT AS references FROM pages GROUP BY sha256(html)".replace("AS references", 'AS "references"'))
def content_store(spark, sf_dir):
    c = content_table(_t(spark, sf_dir, "pages"), "html")
    return c.select("address", address_path().alias("path"), "size", "references")


# MinHash and bands


@query("WITH " + S.signature() + " SELECT doc_id, array_to_string(signature, ',') AS signature FROM sig")
def minhash_signature(spark, sf_dir):
    return signatures(_t(spark, sf_dir, "documents"), CONFIG).select("doc_id", F.array_join("signature", ",").alias("signature"))


@query("WITH " + S.signature() + S.bands(CONFIG) + " SELECT doc_id, band_id, band_hash FROM keys")
def lsh_band_keys(spark, sf_dir):
    return band_keys(signatures(_t(spark, sf_dir, "documents"), CONFIG), CONFIG)


@query("WITH " + S.signature() + S.bands(CONFIG) + " SELECT band_id, count(*)::BIGINT AS buckets, sum((n > 1)::INT)::BIGINT AS collision_buckets, max(n)::BIGINT AS largest_bucket, sum(n)::BIGINT AS entries FROM (SELECT band_id, band_hash, count(*) AS n FROM keys GROUP BY ALL) GROUP BY band_id")
def lsh_bucket_stats(spark, sf_dir):
    return bucket_stats(band_keys(signatures(_t(spark, sf_dir, "documents"), CONFIG), CONFIG))


@query("WITH " + S.signature() + S.bands(CONFIG) + S.pairs(CONFIG) + " SELECT doc_a, doc_b FROM cand")
def lsh_candidate_pairs(spark, sf_dir):
    return candidate_pairs(materialize(band_keys(signatures(_t(spark, sf_dir, "documents"), CONFIG), CONFIG), "keys"))


def _estimated(spark, sf_dir):
    sigs = materialize(signatures(_t(spark, sf_dir, "documents"), CONFIG), "signatures")
    return with_similarity(candidate_pairs(band_keys(sigs, CONFIG)), sigs)


@query("WITH " + S.signature() + S.bands(CONFIG) + S.pairs(CONFIG) + " SELECT doc_a, doc_b, similarity FROM est")
def minhash_similarity(spark, sf_dir):
    return _estimated(spark, sf_dir)


@query("WITH " + S.signature() + S.bands(CONFIG) + S.pairs(CONFIG) + f" SELECT doc_a, doc_b, similarity FROM est WHERE similarity >= {CONFIG.threshold}")
def verified_pairs(spark, sf_dir):
    return _estimated(spark, sf_dir).where(F.col("similarity") >= CONFIG.threshold)


# batch pipelines


def _run(spark, sf_dir, config=CONFIG) -> Deduplicated:
    return deduplicate(_t(spark, sf_dir, "documents"), config)


@query(S.dedup() + " SELECT doc_id, rep AS representative_id, doc_id <> rep AS is_duplicate FROM part")
def dedup_decisions(spark, sf_dir):
    return _run(spark, sf_dir).decisions()


@query(S.dedup() + " SELECT doc_id FROM part WHERE doc_id = rep")
def dedup_keep(spark, sf_dir):
    return _run(spark, sf_dir).keep()


@query(S.dedup() + " SELECT doc_id, rep AS representative_id FROM part WHERE doc_id <> rep")
def dedup_remove(spark, sf_dir):
    return _run(spark, sf_dir).remove()


@query(S.dedup() + " SELECT rep AS representative_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS duplicates FROM part WHERE doc_id <> rep GROUP BY rep")
def duplicate_clusters(spark, sf_dir):
    return _run(spark, sf_dir).clusters().select("representative_id", F.array_join(F.col("duplicates").cast("array<string>"), ",").alias("duplicates"))


@query(S.dedup() + " SELECT rep AS representative_id, count(*)::BIGINT AS size FROM part GROUP BY rep HAVING count(*) > 1")
def cluster_sizes(spark, sf_dir):
    return _run(spark, sf_dir).sizes()


_STATS = """ SELECT count(*)::BIGINT AS total, sum((doc_id = rep)::INT)::BIGINT AS unique_docs, sum((doc_id <> rep)::INT)::BIGINT AS duplicate_count, sum((doc_id <> rep)::INT) / count(*) AS duplicate_ratio,
(SELECT count(DISTINCT rep) FROM part WHERE doc_id <> rep)::BIGINT AS cluster_count, (SELECT count(*) FROM est)::BIGINT AS candidate_pairs, (SELECT count(*) FROM est WHERE similarity >= {t})::BIGINT AS verified_pairs FROM part"""


@query(S.dedup() + _STATS.format(t=CONFIG.threshold))
def dedup_stats(spark, sf_dir):
    return _run(spark, sf_dir).stats()


LOOSE = DedupConfig(verify=False)


@query(S.dedup(LOOSE) + " SELECT doc_id, rep AS representative_id, doc_id <> rep AS is_duplicate FROM part")
def dedup_no_verify(spark, sf_dir):
    return _run(spark, sf_dir, LOOSE).decisions()


# streaming semantics over whole tables

STREAM = StreamConfig()


@query(S.first_seen(STREAM.dedup) + "SELECT doc_id, is_duplicate FROM flag")
def streaming_first_seen(spark, sf_dir):
    return FS.first_seen(_t(spark, sf_dir, "documents"))


@query(S.first_seen(STREAM.dedup) + "SELECT count(*)::BIGINT AS total, sum(is_duplicate::INT)::BIGINT AS duplicates, sum((NOT is_duplicate)::INT)::BIGINT AS unique_docs, sum(is_duplicate::INT) / count(*) AS duplicate_ratio FROM flag")
def streaming_stats(spark, sf_dir):
    return FS.stream_stats(FS.first_seen(_t(spark, sf_dir, "documents")))


_ITEMS = "(SELECT item_id AS doc_id, text FROM benchmark)"
_BATCHES = "(SELECT doc_id, text FROM documents UNION ALL SELECT item_id + 1000000000000 AS doc_id, text FROM benchmark)"


@query(S.first_seen(STREAM.dedup, _BATCHES) + "SELECT doc_id, is_duplicate FROM flag")
def incremental_two_batches(spark, sf_dir):
    """Documents first, then test items as a second batch against what the first left."""
    k1 = materialize(FS.keys_of(_t(spark, sf_dir, "documents")), "first")
    state = materialize(FS.build_state(k1), "state")
    second = _t(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000_000).alias("doc_id"), "text")
    return FS.flags(k1).unionByName(FS.flags(materialize(FS.keys_of(second), "second"), state))


_PROBE = S.signature(STREAM.dedup, "(SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, page_id, html FROM pages UNION ALL SELECT 2, item_id, text FROM benchmark)", "kind * 1000000000000 + id")


@query("WITH " + _PROBE + S.bands(STREAM.dedup) + ", known AS (SELECT DISTINCT band_id, band_hash FROM keys WHERE doc_id < 2000000000000) SELECT doc_id - 2000000000000 AS doc_id, bool_or(known.band_id IS NOT NULL) AS is_known FROM keys LEFT JOIN known USING (band_id, band_hash) WHERE doc_id >= 2000000000000 GROUP BY doc_id")
def merged_index_probe(spark, sf_dir):
    """Test items probed against the merged keys of documents and pages."""
    docs, pages = (FS.build_state(FS.keys_of(_t(spark, sf_dir, t), seq_col=i, text_col=c)) for t, i, c in (("documents", "doc_id", "text"), ("pages", "page_id", "html")))
    state = FS.merge_states(materialize(docs, "docs"), materialize(pages, "pages"))
    return FS.probe(_t(spark, sf_dir, "benchmark"), state, seq_col="item_id")


@query("SELECT n AS items, b AS bands, (floor(n * 14.37758756605116 / 8) + 1) * b AS bloom_bytes, n * b * 48 AS exact_bytes FROM (SELECT count(*)::BIGINT AS n FROM documents), (SELECT 8::BIGINT AS b)".replace("(floor(n * 14.37758756605116 / 8) + 1) * b", "((floor(n * 14.37758756605116 / 8) + 1) * b)::BIGINT"))
def bloom_memory_model(spark, sf_dir):
    n, bands = _t(spark, sf_dir, "documents").agg(F.count("*").alias("items")), optimal_bands(STREAM.permutations, STREAM.threshold)[0]
    return n.select("items", F.lit(bands).cast("long").alias("bands"), bloom_memory(F.col("items"), bands, STREAM.fp_rate).cast("long").alias("bloom_bytes"), exact_memory(F.col("items"), bands).cast("long").alias("exact_bytes"))


# vectors


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT first(e ORDER BY vec_id) AS z FROM v) SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(1 - list_dot_product(e, z), 6) + 0.0 AS cosine_distance, round(list_distance(e, z), 6) AS euclidean FROM v, l")
def vector_functions(spark, sf_dir):
    """Norm of every vector, and its distances to the first."""
    e = _t(spark, sf_dir, "embeddings")
    z = e.agg(F.min_by("embedding", "vec_id").alias("z"))  # one row
    v = F.col("embedding")
    return e.crossJoin(F.broadcast(z)).select("vec_id", F.round(norm(v), 6).alias("norm"), (F.round(cosine_distance(v, F.col("z")), 6) + 0.0).alias("cosine_distance"), F.round(euclidean(v, F.col("z")), 6).alias("euclidean"))


@query(S.DOTS + "SELECT id_a AS query_id, id_b AS doc_id, similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) AS rank FROM s WHERE id_a <> id_b) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    return top_k(_t(spark, sf_dir, "embeddings"), 10)


@query(S.DOTS + f"SELECT id_a AS query_id, id_b AS doc_id, similarity FROM s WHERE id_a <> id_b AND similarity >= {NEAR}")
def cosine_range(spark, sf_dir):
    return range_search(_t(spark, sf_dir, "embeddings"), NEAR)


@query(S.DOTS + f"SELECT id_a, id_b, similarity FROM s WHERE id_a < id_b AND similarity >= {NEAR}")
def cosine_all_pairs(spark, sf_dir):
    return all_pairs(_t(spark, sf_dir, "embeddings"), NEAR)


@query(S.DOTS + f"SELECT id_a, id_b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) AS rank FROM s) WHERE rank <= 10 AND id_b > id_a AND similarity >= {NEAR}")
def knn_similar_pairs(spark, sf_dir):
    return knn_pairs(_t(spark, sf_dir, "embeddings"), NEAR)


@query()
def ann_lsh_topk(spark, sf_dir):
    return approximate_top_k(_t(spark, sf_dir, "embeddings"), 10)


_GREEDY = S.greedy(S.DOTS.strip() + f" SELECT id_a AS doc_a, id_b AS doc_b FROM s WHERE id_a < id_b AND similarity >= {NEAR}", "SELECT vec_id AS id FROM embeddings")


@query(_GREEDY + "SELECT id AS vec_id FROM kept")
def semantic_greedy_keep(spark, sf_dir):
    return semantic_keep(_t(spark, sf_dir, "embeddings"), SemanticConfig(NEAR)).select("vec_id")


@query(_GREEDY + "SELECT id AS vec_id FROM kept")
def hybrid_keep_semantic(spark, sf_dir):
    return hybrid_keep(_t(spark, sf_dir, "embeddings"), HybridConfig(semantic_threshold=NEAR), "vec_id").select("vec_id")


_HYBRID = DedupConfig(HybridConfig().minhash_threshold)


@query(S.greedy("WITH " + S.signature(_HYBRID) + f", m AS (SELECT doc_id, i, signature[i] AS p FROM sig, range(1, 129) AS r(i)) SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b USING (i, p) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) / 128.0 >= {_HYBRID.threshold}", "SELECT DISTINCT doc_id AS id FROM documents") + "SELECT id AS doc_id FROM kept")
def hybrid_keep_minhash_only(spark, sf_dir):
    return hybrid_keep(_t(spark, sf_dir, "documents"), HybridConfig(verify_with_semantic=False)).select("doc_id")


@query("SELECT doc_id, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def mock_semantic_dedup(spark, sf_dir):
    """Vectors that depend on the text alone: what goes are equal texts."""
    e = embedded(_t(spark, sf_dir, "documents"))
    first = e.groupBy("embedding").agg(F.min("doc_id").alias("head"))
    return e.select("doc_id", "embedding").join(first, "embedding").select("doc_id", (F.col("doc_id") != F.col("head")).alias("is_duplicate"))


@query(S.greedy(f"WITH {S.shingles()}, sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), b AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM sh a JOIN sh b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2) SELECT doc_a, doc_b FROM b JOIN sz x ON x.doc_id = doc_a JOIN sz y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= 0.5", "SELECT DISTINCT doc_id AS id FROM documents") + "SELECT doc_id FROM documents ANTI JOIN kept ON id = doc_id")
def greedy_exact_removed(spark, sf_dir):
    return removed_by_greedy(exact_pairs(_t(spark, sf_dir, "documents"), 0.5))


# quantisation and codecs


@query(S.int8())
def int8_quant_error(spark, sf_dir):
    return quantization_errors(_t(spark, sf_dir, "embeddings"), "int8")


@query(S.int4())
def int4_quant_error(spark, sf_dir):
    return quantization_errors(_t(spark, sf_dir, "embeddings"), "int4")


@query(S.nf4())
def nf4_quant_error(spark, sf_dir):
    return quantization_errors(_t(spark, sf_dir, "embeddings"), "nf4")


def _steps(spark, sf_dir):
    """Vectors as checkpoints: of each label, in order of ids."""
    return _t(spark, sf_dir, "embeddings").select("label", "vec_id", codec.float_bytes(F.col("embedding")).alias("data"))


@query()
def xor_delta(spark, sf_dir):
    d = codec.delta_encoded(_steps(spark, sf_dir), "label", "vec_id", "data")
    return d.select("label", "vec_id", "size", "reference_step", "sparsity", F.octet_length("packed").cast("long").alias("packed_size"), "ratio")


@query("SELECT label, vec_id, 4 * len(embedding)::BIGINT AS size FROM embeddings")
def delta_round_trip(spark, sf_dir):
    """Encoded, decoded and held against what went in; rows that don't come back are missing."""
    steps = _steps(spark, sf_dir)
    back = codec.delta_decoded(codec.delta_encoded(steps, "label", "vec_id", "data"), "label", "vec_id")
    same = back.withColumnRenamed("data", "back").join(steps, ["label", "vec_id"]).where("data = back")
    return same.select("label", "vec_id", F.octet_length("data").cast("long").alias("size"))


@query()
def byte_group_compression(spark, sf_dir):
    s = _steps(spark, sf_dir)
    return s.select("vec_id", F.octet_length("data").alias("size"), F.octet_length(codec.compressed(F.col("data"))).alias("plain"), F.octet_length(codec.compressed(F.col("data"), "fp32")).alias("grouped"))


# cache catalogue; events stand for accesses, users for keys

_LOG = "SELECT user_id AS key, (octet_length(encode(coalesce(props, ''))) + 1)::BIGINT AS size, ts, event_id FROM events WHERE user_id IS NOT NULL"


def _log(spark, sf_dir):
    return _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.octet_length(F.coalesce("props", F.lit(""))) + 1).cast("long").alias("size"), "ts", "event_id")


@query(f"WITH l AS ({_LOG}) SELECT key, max(size) AS size, min(event_id) AS created, max(event_id) AS accessed, count(*) - 1 AS hit_count FROM l GROUP BY key")
def cache_entries(spark, sf_dir):
    return catalogue.entries(_log(spark, sf_dir), "key", "size", "event_id")


_EVICT = f"WITH l AS ({_LOG}), c AS (SELECT key, max(size) AS size, max(event_id) AS accessed, count(*) - 1 AS hit_count FROM l GROUP BY key), r AS (SELECT *, sum(size) OVER (ORDER BY accessed DESC, key) AS used FROM c) SELECT key, size, accessed, hit_count FROM r WHERE used > 250"


@query(_EVICT)
def lru_eviction(spark, sf_dir):
    return catalogue.evicted(catalogue.entries(_log(spark, sf_dir), "key", "size", "event_id"), 300, 50)


@query(f"WITH l AS ({_LOG}), e AS (SELECT key, count(*) AS n, max(size) AS size FROM l GROUP BY key) SELECT sum(n)::BIGINT AS accesses, count(*)::BIGINT AS misses, (sum(n) - count(*))::BIGINT AS hits, sum(size)::BIGINT AS bytes_stored, sum(size * (n - 1))::BIGINT AS bytes_served, ((sum(n) - count(*)) / sum(n))::DOUBLE AS hit_rate FROM e")
def cache_hit_rate(spark, sf_dir):
    return catalogue.metrics(_log(spark, sf_dir), "key", "size")


@query("WITH c AS (SELECT conv_id AS key FROM conversations), d AS (SELECT doc_id AS key FROM documents) SELECT DISTINCT key, 'pull' AS action FROM d ANTI JOIN c USING (key) UNION ALL SELECT DISTINCT key, 'push' FROM c ANTI JOIN d USING (key)")
def cache_sync(spark, sf_dir):
    """The ids of conversations as the local tier, those of documents as the remote one."""
    local, remote = (_t(spark, sf_dir, t).select(F.col(i).alias("key")).distinct() for t, i in (("conversations", "conv_id"), ("documents", "doc_id")))
    return catalogue.sync(local, remote)


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Compatible' ELSE 'Incompatible' END AS python_status, CASE WHEN p_size % 5 = 0 THEN 'Compatible' WHEN p_size % 5 < 3 THEN 'Warning' WHEN p_size % 5 = 3 THEN 'Compatible' ELSE 'Incompatible' END AS cuda_status,
CASE WHEN p_size % 3 <> 0 OR p_size % 5 = 4 THEN 'Incompatible' WHEN p_size % 5 IN (1, 2) THEN 'Warning' ELSE 'Compatible' END AS status FROM part""")
def environment_compatibility(spark, sf_dir):
    """Environments made from the parts table, each against one current environment."""
    size = F.col("p_size")
    env = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("3."), (size % 3 + 11).cast("string"), F.lit(".2")).alias("python"), F.when(size % 5 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*(F.lit(x) for x in ("7.0", "8.0", "8.6", "9.0"))), size % 5)).alias("cuda"))
    rules = {k: catalogue.RULES[k] for k in ("python", "cuda")}
    return catalogue.compatibility(env, {"python": "3.11.9", "cuda": "8.6"}, rules).select("p_partkey", "python_status", "cuda_status", "status")


@query("SELECT page_id, substr(sha256(coalesce(url, chr(0)) || chr(31) || coalesce(html, chr(0))), 1, 32) AS key FROM pages")
def cache_keys(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", content_key(F.col("url"), F.col("html")).alias("key"))


@query("SELECT page_id, CASE WHEN n IS NULL THEN 'path_' || substr(sha256(url), 1, 16) ELSE n END AS path FROM (SELECT page_id, url, CASE WHEN m > 0 THEN array_to_string(p[m:], '/') WHEN len(p) > 0 THEN p[-1] END AS n FROM (SELECT *, coalesce(list_min(list_filter([list_position(p, x) for x in ['src', 'lib', 'models', 'scripts', 'python', 'torch']], lambda i: i > 0)), 0) AS m FROM (SELECT page_id, url, list_filter(string_split(url, '/'), lambda x: x NOT IN ('', '.')) AS p FROM pages)))")
def normalized_paths(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", normalize_path(F.col("url")).alias("path"))


@query("SELECT p_partkey, (p_size % 4 = 2) AS serves, (p_size % 3 <> 0) AS device_serves, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 2 * p_size * p_partkey END::BIGINT AS numel, '-1,' || p_size || ',' || p_partkey AS batched FROM part")
def cache_key_functions(spark, sf_dir):
    size = F.col("p_size")
    shape = F.array(F.when(size % 2 == 0, F.lit(-1)).otherwise(F.lit(2)).cast("long"), size.cast("long"), F.col("p_partkey").cast("long"))
    have, want = version(F.element_at(F.array(F.lit("2.0"), F.lit("3.9"), F.lit("2.4.1"), F.lit("x")), size % 4 + 1)), version(F.lit("2.1"))
    kind = F.element_at(F.array(F.lit("cpu"), F.lit("cuda_any"), F.lit("cuda")), size % 3 + 1)
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(version_serves(have, want), F.lit(False)).alias("serves"), device_serves(kind, F.lit(9), F.lit(0), F.lit("cuda"), F.lit(8), F.lit(6)).alias("device_serves"), F.coalesce(numel(shape), F.lit(-1)).alias("numel"), F.array_join(with_dynamic_batch(shape).cast("array<string>"), ",").alias("batched"))


@query("SELECT event_id, CASE WHEN event_id >= 1048576 THEN format('{:.2f} MiB', round(event_id / 1048576.0, 2)) WHEN event_id >= 1024 THEN format('{:.2f} KiB', round(event_id / 1024.0, 2)) ELSE event_id || ' B' END AS bytes, CASE WHEN event_id >= 3600 THEN format('{:.1f}h', round(event_id / 3600.0, 1)) WHEN event_id >= 60 THEN format('{:.1f}m', round(event_id / 60.0, 1)) ELSE format('{:.1f}s', event_id::DOUBLE) END AS seconds FROM events")
def human_readable(spark, sf_dir):
    e = F.col("event_id")
    return _t(spark, sf_dir, "events").select("event_id", T.human_bytes(e).alias("bytes"), T.human_seconds(e).alias("seconds"))
