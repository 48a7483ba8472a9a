"""SimHash near duplicates by meet-in-the-middle ball hashing.

Each document has ``TABLES`` fingerprints of ``BITS`` bits over its words, a
word that occurs n times having the weight of n's square root. Two
fingerprints at a distance of at most ``RADIUS`` have a middle within half of
it from both, so every fingerprint emits all its variants within
``RADIUS // 2`` bits; equal variants meet in a shuffle. Variants with the same
members are one set, and sets are made distinct. Every set is then verified by
a 128-bit SimHash of runs of three words: what its verified pairs connect is
found exactly, by a search in which each member that was reached is held
against all that weren't. The edges by which it reached them join documents to groups.

``BITS`` has to grow with the corpus, by about two for each factor of four: at
36 bits, unrelated documents meet at a rate of 667 / 2**36 for each pair.

Defined results: null texts and texts without words belong to no group and
stay; equal texts always share a group; of a group the least id stays, null
ids come last, and ties (repeated rows) are broken by place in the table; an
empty table gives an empty result; other columns are passed through by
``drop_near_duplicates`` and ignored by ``near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import mix, partitions, q, slices, table
from loamsift.operators.components import connected_components
from loamsift.session import materialize

TABLES = 10
BITS = 36
RADIUS = 2
RUN_BITS = 40  # of 128: a cosine of 0.56 over runs of three words
ROWS_A_PARTITION = 2_000_000
CHUNK = 1 << 13
FIELDS = [f"f{i}" for i in range(TABLES)] + ["s0", "s1"]


class Signs(dict):
    """Word to a row of +1 and -1, one for each bit of all tables; and the word's hash."""

    def __init__(self, most: int = 50_000):
        self.most, self.rows, self.hash = most, np.empty((most, BITS * TABLES), np.int8), np.empty(most, np.uint64)
        self.fresh: list[bytes] = []

    def __missing__(self, word: str) -> int:
        b = word.encode("utf-8", "surrogatepass")
        self.fresh.append(b"".join(xxhash.xxh3_128_digest(b, seed=s) for s in range(-(-BITS * TABLES // 128))))
        v = self[word] = len(self)
        return v

    def settle(self) -> None:
        """Fill the rows of the words that are new since last time."""
        n = len(self.fresh)
        if n:
            at = len(self) - n
            while len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.hash = np.concatenate([self.hash, np.empty_like(self.hash)])
            raw = np.frombuffer(b"".join(self.fresh), np.uint8).reshape(n, -1)
            self.rows[at : at + n] = (np.unpackbits(raw, axis=1, count=BITS * TABLES) << 1).astype(np.int8) - 1
            self.hash[at : at + n] = raw[:, :8].copy().view(np.uint64)[:, 0]
            self.fresh.clear()

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()


def _sums(rows_of, n_tokens: int, owner: np.ndarray, n_docs: int, width: int) -> np.ndarray:
    """Sums of the tokens' rows by document, a chunk of tokens at a time."""
    out = np.zeros((n_docs, width), np.int64)
    for k in range(0, n_tokens, CHUNK):
        own = owner[k : k + CHUNK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(rows_of(k, k + CHUNK), first, axis=0, dtype=np.int32)
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.packbits(x > 0, axis=1).view(np.uint64)


def fingerprint(texts: list[str | None], signs: Signs) -> tuple[np.ndarray, np.ndarray]:
    """(n, TABLES + 2) of 64-bit values, and which texts have words.

    The first TABLES hold a fingerprint in their low BITS; the last two are the
    SimHash of runs of three words.
    """
    words = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    n, total = len(texts), int(sizes.sum())
    out = np.zeros((n, TABLES + 2), np.uint64)
    if not total:
        return out, sizes > 0
    ids = np.fromiter((signs[w] for ws in words for w in ws), np.int64, total)
    signs.settle()
    owner = np.repeat(np.arange(n), sizes)
    each, count = np.unique(owner << 32 | ids, return_counts=True)
    weight = np.rint(16 * np.sqrt(count)).astype(np.int16)
    word = each & 0xFFFFFFFF
    uni = _sums(lambda a, b: signs.rows[word[a:b]] * weight[a:b, None], len(each), each >> 32, n, BITS * TABLES)
    padded = np.zeros((n, TABLES, 64), bool)
    padded[:, :, :BITS] = uni.reshape(n, TABLES, BITS) > 0
    out[:, :TABLES] = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    h = signs.hash[ids]
    starts = np.maximum(sizes - 2, np.minimum(sizes, 1))
    own = np.repeat(np.arange(n), starts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(starts) - starts, starts) + (np.cumsum(sizes) - sizes)[own]
    end = (np.cumsum(sizes) - 1)[own]
    run = mix(mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + 1, end)]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[np.minimum(at + 2, end)])

    def run_rows(a, b):
        x = np.empty((len(run[a:b]), 2), np.uint64)
        x[:, 0], x[:, 1] = run[a:b], mix(run[a:b] + np.uint64(0xD1B54A32D192ED03))
        return (np.unpackbits(x.view(np.uint8), axis=1) << 1).astype(np.int8) - 1

    out[:, TABLES:] = _bits(_sums(run_rows, len(run), own, n, 128))
    return out, sizes > 0


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, gid, fingerprints) of the documents with words; equal gid means equal fingerprints."""

    def run(batches):
        signs = Signs()
        for b in slices(batches, limit=1 << 20):
            f, ok = fingerprint(b.column("text").to_pylist(), signs)
            signs.forget()
            g = np.zeros(len(f), np.uint64)
            for k in range(f.shape[1]):
                g = mix(g * np.uint64(31) + f[:, k] + np.uint64(k + 1))
            cols = [b.column("rid"), b.column("doc_id"), pa.array(g.view(np.int64)), *(pa.array(np.ascontiguousarray(f[:, k]).view(np.int64)) for k in range(f.shape[1]))]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "gid", *FIELDS]).filter(pa.array(ok))

    kept = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    return kept.mapInArrow(run, "rid long, doc_id long, gid long, " + ", ".join(f"{c} long" for c in FIELDS))


def masks(radius: int) -> np.ndarray:
    """All masks of BITS bits with at most ``radius`` of them set."""
    out, layer = [0], [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << k, k) for m, last in layer for k in range(last + 1, BITS)]
        out += [m for m, _ in layer]
    return np.array(out, np.uint64)


def _emit(n_parts: int, radius: int):
    ball = masks(radius // 2)
    salt = mix(np.arange(1, TABLES + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                gid = part.column("gid").to_numpy().view(np.uint64)
                key = []
                for t in range(TABLES):
                    f = part.column(f"f{t}").to_numpy().view(np.uint64)
                    key.append(mix((f[:, None] ^ ball).ravel() ^ salt[t]))
                key = np.concatenate(key)
                who = np.tile(np.repeat(gid, len(ball)), TABLES)
                to = key % np.uint64(n_parts)
                order = np.argsort(to.astype(np.int32), kind="stable")
                key, who, to = key[order], who[order], to[order]
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                ends = [*first[1:].tolist(), len(to)]
                yield pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array([key[i:j].tobytes() for i, j in zip(first, ends)], pa.binary()), pa.array([who[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())], ["to", "keys", "gids"])

    return run


def _meet(batches):
    """(bucket, gid) of every variant that several fingerprints share; the bucket is a hash of its members."""
    keys, gids = [], []
    for b in batches:
        keys += [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
        gids += [np.frombuffer(x, np.uint64) for x in b.column("gids").to_pylist()]
    if not keys:
        return
    key, gid = np.concatenate(keys), np.concatenate(gids)
    del keys, gids
    order = np.argsort(key)
    key, gid = key[order], gid[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    keep = ~(first & np.concatenate([first[1:], [True]]))
    gid, first = gid[keep], np.flatnonzero(first[keep])
    if not len(gid):
        return
    members = np.add.reduceat(mix(gid), first)
    size = np.diff(np.concatenate([first, [len(gid)]]))
    _, one = np.unique(members, return_index=True)  # sets that several variants gave
    keep = np.zeros(len(first), bool)
    keep[one] = True
    bucket, gid = np.repeat(members, size)[np.repeat(keep, size)], gid[np.repeat(keep, size)]
    for k in range(0, len(gid), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[k : k + 100_000].view(np.int64)), pa.array(gid[k : k + 100_000].view(np.int64))], ["bucket", "gid"])


def spanning_edges(gid: np.ndarray, sketch: np.ndarray, most: int = RUN_BITS) -> list[tuple[int, int]]:
    """Edges that connect exactly what pairs of sketches within ``most`` bits connect: a search that takes each member once."""
    out, left = [], np.arange(len(gid))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(sketch[left] ^ sketch[at]).sum(axis=1) <= most
            found = left[near]
            out += [(int(gid[at]), int(gid[k])) for k in found]
            reached += found.tolist()
            left = left[~near]
    return out


def _verify(most: int):
    def run(batches):
        held, gids, sketches = None, [], []

        def edges():
            e = spanning_edges(np.concatenate(gids), np.concatenate(sketches), most) if gids else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["a", "b"])

        for b in batches:
            bucket, gid = b.column("bucket").to_numpy(), b.column("gid").to_numpy()
            sketch = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            made = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if bucket[i] != held:
                    made.append(edges())
                    held, gids, sketches = bucket[i], [], []
                gids.append(gid[i:j]), sketches.append(sketch[i:j])
            made = [m for m in made if m.num_rows]
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        yield edges()

    return run


def verified_edges(distinct: DataFrame, radius: int = RADIUS, run_bits: int = RUN_BITS) -> DataFrame:
    """(a, b) gids: verified pairs whose fingerprints collide, enough of them to connect all that such pairs connect."""
    n_parts = max(partitions(distinct.sparkSession), distinct.count() * TABLES * len(masks(radius // 2)) // ROWS_A_PARTITION)
    blobs = distinct.mapInArrow(_emit(n_parts, radius), "to int, keys binary, gids binary")
    met = blobs.repartitionById(n_parts, "to").mapInArrow(_meet, "bucket long, gid long").distinct()
    sketched = met.join(distinct.select("gid", "s0", "s1"), "gid").select("bucket", "gid", "s0", "s1")
    return sketched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(run_bits), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, kept_doc_id, group_size, is_kept) of documents in groups of at least two."""
    s = materialize(signatures(docs, id_col, text_col), "signatures")
    distinct = materialize(s.select("gid", *FIELDS).dropDuplicates(["gid"]), "distinct")
    parts = connected_components(verified_edges(distinct), "a", "b")
    named = s.select("rid", "doc_id", "gid").join(parts, F.col("gid") == F.col("id"), "left").select("rid", "doc_id", F.coalesce("component", "gid").alias("g"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    heads = named.groupBy("g").agg(F.min(rank).alias("head"), F.count("*").alias("group_size")).where("group_size > 1")
    return named.join(heads, "g").select("rid", "doc_id", F.col("head.doc_id").alias("kept_doc_id"), "group_size", (F.col("head.rid") == F.col("rid")).alias("is_kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id, group_size): one row for each document that goes, with the one of its group that stays."""
    return groups(docs).where("NOT is_kept").select("doc_id", "kept_doc_id", "group_size")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns as they are.

    ``docs`` is read twice and has to give the same rows in the same places, as tables of files do.
    """
    gone = groups(docs).where("NOT is_kept").select(F.col("rid").alias("__loamsift_gone"))
    marked = docs.withColumn("__loamsift_rid", F.monotonically_increasing_id())
    return marked.join(gone.hint("shuffle_hash"), F.col("__loamsift_rid") == F.col("__loamsift_gone"), "left_anti").drop("__loamsift_rid")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
