"""The same results as SQL, for engines without this package."""

from __future__ import annotations

from loamsift.functions.hashing import EMPTY, PRIME, permutations, places
from loamsift.operators.quantize import NF4
from loamsift.plans.config import DedupConfig

SHINGLES = r"""
d AS (SELECT {id} AS doc_id, regexp_extract_all(coalesce({text}, ''), '\S+') AS ws FROM {table}),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
g AS (SELECT doc_id, i, n, concat_ws(' ', w{leads}) AS shingle FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(1, n - {less}))"""


def shingles(n: int = 5, table: str = "documents", ident: str = "doc_id", text: str = "text") -> str:
    return SHINGLES.format(id=ident, text=text, table=table, leads="".join(f", lead(w, {k}) OVER o" for k in range(1, n)), less=n - 1)


def signature(config: DedupConfig = DedupConfig(), table: str = "documents", ident: str = "doc_id", text: str = "text") -> str:
    """CTEs up to sig(doc_id, signature)."""
    least = ", ".join(f"min(({a} * h + {b}) % {PRIME})" for a, b in permutations(config.permutations, config.seed))
    words = " + ".join(f"coalesce(lead(v, {k}) OVER o * {c} % {PRIME}, 0)" for k, c in enumerate(places(config.ngram)))
    return f"""{shingles(config.ngram, table, ident, text)},
gv AS (SELECT doc_id, i, n, ({words}) % {PRIME} AS h FROM (SELECT *, ('0x' || substr(md5(w), 1, 15))::BIGINT % {PRIME} AS v FROM t) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hs AS (SELECT DISTINCT doc_id, h FROM gv WHERE i <= greatest(1, n - {config.ngram - 1})),
full_sig AS (SELECT doc_id, [{least}] AS signature FROM hs GROUP BY doc_id),
sig AS (SELECT doc_id, coalesce(signature, list_transform(range({config.permutations}), lambda x: {EMPTY}::BIGINT)) AS signature FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN full_sig USING (doc_id))"""


def bands(config: DedupConfig) -> str:
    """CTE keys(doc_id, band_id, band_hash) after sig."""
    n, r = config.bands
    return f""",
keys AS (SELECT doc_id, band_id::INT AS band_id, md5(array_to_string(signature[band_id * {r} + 1 : band_id * {r} + {r}], ',')) AS band_hash FROM sig, range({n}) AS b(band_id))"""


SIMILAR = "(SELECT count(*) FROM (SELECT unnest(x.signature) AS p, unnest(y.signature) AS q) WHERE p = q)"


def pairs(config: DedupConfig) -> str:
    """CTEs cand(doc_a, doc_b) and est(doc_a, doc_b, similarity) after keys."""
    return f""",
cand AS (SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM keys a JOIN keys b USING (band_id, band_hash) WHERE a.doc_id < b.doc_id),
est AS (SELECT doc_a, doc_b, len(list_filter(list_zip(x.signature, y.signature), lambda p: p[1] = p[2])) / {float(config.permutations)} AS similarity
        FROM cand JOIN sig x ON x.doc_id = doc_a JOIN sig y ON y.doc_id = doc_b)"""


def parts(edges: str) -> str:
    """CTEs up to part(doc_id, rep) of every document, from a query that gives (doc_a, doc_b)."""
    return f""",
edge AS (SELECT doc_a AS a, doc_b AS b FROM ({edges}) UNION SELECT doc_b, doc_a FROM ({edges})),
reach(id, c) AS (SELECT a, a FROM edge UNION SELECT e.b, r.c FROM reach r JOIN edge e ON r.id = e.a WHERE r.c <= e.b),
part AS (SELECT doc_id, coalesce(rep, doc_id) AS rep FROM (SELECT DISTINCT doc_id FROM d) LEFT JOIN (SELECT id AS doc_id, min(c) AS rep FROM reach GROUP BY id) USING (doc_id))"""


def dedup(config: DedupConfig = DedupConfig()) -> str:
    where = f" WHERE similarity >= {config.threshold}" if config.verify else ""
    return "WITH RECURSIVE" + signature(config) + bands(config) + pairs(config) + parts("SELECT doc_a, doc_b FROM est" + where)


def exact_pairs(threshold: float, n: int = 5) -> str:
    return f"""WITH {shingles(n)},
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM sh a JOIN sh b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_a, doc_b, round(c / (x.n + y.n - c), 6) AS similarity FROM met JOIN sz x ON x.doc_id = doc_a JOIN sz y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= {threshold}"""


def first_seen(config: DedupConfig, table: str = "documents") -> str:
    """CTEs up to flag(doc_id, is_duplicate)."""
    return "WITH " + signature(config, table) + bands(config) + """,
firsts AS (SELECT band_id, band_hash, min(doc_id) AS first_seq FROM keys GROUP BY band_id, band_hash),
flag AS (SELECT doc_id, bool_or(first_seq < doc_id) AS is_duplicate FROM keys JOIN firsts USING (band_id, band_hash) GROUP BY doc_id)
"""


DOTS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.e, b.e), 6) AS similarity FROM u a, u b)
"""


def greedy(edges: str, docs: str) -> str:
    """CTEs up to kept(id): documents in order, each kept unless an earlier kept one is similar. edges: (doc_a, doc_b); docs: (id)."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({edges}), n AS MATERIALIZED ({docs}),
nb AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS rn, coalesce(ns, []) AS ns FROM n LEFT JOIN (SELECT doc_b, list(doc_a) AS ns FROM e GROUP BY doc_b) ON doc_b = id),
g(rn, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT nb.rn, CASE WHEN list_has_any(nb.ns, g.kept) THEN g.kept ELSE list_append(g.kept, nb.id) END FROM g JOIN nb ON nb.rn = g.rn + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM g ORDER BY rn DESC LIMIT 1))
"""


ERRORS = "round(list_avg(e), 8) AS mae, round(list_max(e), 8) AS max_error, round(sqrt(list_avg(list_transform(e, lambda x: x * x))), 8) AS rmse"


def int8() -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127.0::DOUBLE AS s FROM v),
q AS (SELECT vec_id, list_transform(v, lambda x: abs(x - greatest(-128, least(127, round(x / (CASE WHEN s > 0 THEN s ELSE 1 END)))) * (CASE WHEN s > 0 THEN s ELSE 1 END))) AS e FROM s)
SELECT vec_id, {ERRORS}, 4.0::DOUBLE AS ratio FROM q"""


def int4() -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT vec_id, v, list_min(v) AS lo, CASE WHEN list_max(v) > list_min(v) THEN (list_max(v) - list_min(v)) / 15.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM v),
q AS (SELECT vec_id, list_transform(v, lambda x: abs(x - (greatest(0, least(15, round((x - lo) / s))) * s + lo))) AS e FROM s)
SELECT vec_id, {ERRORS}, 8.0::DOUBLE AS ratio FROM q"""


def nf4() -> str:
    level = "CASE " + " ".join(f"WHEN y <= {(NF4[k] + NF4[k + 1]) / 2!r}::DOUBLE THEN {NF4[k]!r}::DOUBLE" for k in range(15)) + " ELSE 1.0::DOUBLE END"
    return f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s AS (SELECT vec_id, x, max(abs(x)) OVER (PARTITION BY vec_id, i // 64) AS s FROM x),
y AS (SELECT vec_id, x, s, CASE WHEN s > 0 THEN x / s ELSE 0 END AS y FROM s),
q AS (SELECT vec_id, list(abs(x - {level} * s)) AS e FROM y GROUP BY vec_id)
SELECT vec_id, {ERRORS}, 8.0::DOUBLE AS ratio FROM q"""
