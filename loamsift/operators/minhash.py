"""MinHash signatures, bands, candidates and verification."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions.hashing import EMPTY, PRIME, band_key, permutations, places
from loamsift.functions.words import Powers, distinct_words
from loamsift.plans.config import DedupConfig

MASK, SHIFT, CHUNK = np.uint64(PRIME), np.uint64(31), 4096
SLICE_ROWS, SLICE_BYTES = 256, 1 << 19  # of texts hashed at once


class WordResidues(dict):
    """Word to the ``hash31`` of it, remembered; forgets all once it holds ``most`` words."""

    most = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = int(md5(word).hexdigest()[:15], 16) % PRIME
        return v


def shingle_hashes(texts: pa.Array, n: int, known: WordResidues, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of all texts in turn, shingles of each): its words' residues times ``places(n)``, mod PRIME."""
    which, words, sizes = distinct_words(texts, powers)
    v = np.fromiter((known[w] for w in words), np.uint64, len(words))
    per = np.maximum(sizes - n + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), per)
    end = np.cumsum(sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) + (end - sizes)[owner]
    out = np.zeros(len(at), np.uint64)
    for k, c in enumerate(places(n) if len(at) else ()):
        part = _residue(v * np.uint64(c))[which]
        out += np.where(at + k < end[owner], part[np.minimum(at + k, len(which) - 1)], np.uint64(0))
    return out % np.uint64(PRIME), per


def _residue(y: np.ndarray) -> np.ndarray:
    """y mod 2**31 - 1 of values below 2**62 + 2**31, by shift and add."""
    t = (y & MASK) + (y >> SHIFT)
    return np.minimum(t, t - MASK)  # wraps to something large where t is below


def minima(hashes: np.ndarray, per: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of every permutation over each document's hashes, a few thousand hashes at a time; EMPTY without any."""
    out = np.full((len(a), len(per)), EMPTY, np.uint64)
    owner = np.repeat(np.arange(len(per)), per)
    for k in range(0, len(hashes), CHUNK):
        h, own = hashes[k : k + CHUNK], owner[k : k + CHUNK]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        doc = own[first]
        for p in range(len(a)):
            out[p, doc] = np.minimum(out[p, doc], np.minimum.reduceat(_residue(h * a[p] + b[p]), first))
    return out.T


def signature_of(texts: list[str | None], config: DedupConfig = DedupConfig()) -> list[list[int]]:
    """The signatures of texts, without Spark."""
    a, b = np.array(permutations(config.permutations, config.seed), np.uint64).T
    return minima(*shingle_hashes(pa.array(texts, pa.string()), config.ngram, WordResidues(), Powers()), a, b).astype(np.int64).tolist()


def sliced(batch: pa.RecordBatch, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of ``SLICE_ROWS`` rows and ``SLICE_BYTES`` of text at most, or one text, so that memory follows neither the number of long texts nor the batch."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE_BYTES, "right"))
        to = min(max(at + 1, to), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan has fewer partitions than there are cores; larger inputs stay where they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def signatures(docs: DataFrame, config: DedupConfig = DedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signature): Arrow batches in, one pass. A text without words is EMPTY throughout."""
    a, b = np.array(permutations(config.permutations, config.seed), np.uint64).T
    n = config.ngram

    def run(batches):
        known, powers = WordResidues(), Powers()
        for batch in batches:
            for part in sliced(batch):
                values = pa.array(minima(*shingle_hashes(part.column(1), n, known, powers), a, b).astype(np.int64).ravel())
                at = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(a))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, values)], ["doc_id", "signature"])
            pa.default_memory_pool().release_unused()  # a worker lives on after its task

    kept = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return spread(kept).mapInArrow(run, "doc_id long, signature array<long>")


def similarity(a: Column, b: Column) -> Column:
    """The share of equal places: the estimated Jaccard similarity; 0 for empty signatures."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a))


def band_keys(sigs: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """(doc_id, band_id, band_hash)."""
    bands, rows = config.bands
    keys = F.array(*(F.struct(F.lit(k).alias("band_id"), band_key(F.col("signature"), k, rows).alias("band_hash")) for k in range(bands)))
    return sigs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.band_id", "k.band_hash")


def bucket_stats(keys: DataFrame) -> DataFrame:
    """One row for each band: buckets, those with a collision, the largest."""
    each = keys.groupBy("band_id", "band_hash").agg(F.count("*").alias("n"))
    return each.groupBy("band_id").agg(F.count("*").alias("buckets"), F.sum((F.col("n") > 1).cast("long")).alias("collision_buckets"), F.max("n").alias("largest_bucket"), F.sum("n").alias("entries"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """Distinct (doc_a, doc_b), doc_a < doc_b, that share a bucket."""
    a = keys.select("band_id", "band_hash", F.col("doc_id").alias("doc_a"))
    b = keys.select("band_id", "band_hash", F.col("doc_id").alias("doc_b"))
    return a.join(b, ["band_id", "band_hash"]).where("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def with_similarity(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, similarity); texts never take part in the join."""
    a = sigs.select(F.col("doc_id").alias("doc_a"), F.col("signature").alias("sig_a"))
    b = sigs.select(F.col("doc_id").alias("doc_b"), F.col("signature").alias("sig_b"))
    return pairs.join(a, "doc_a").join(b, "doc_b").select("doc_a", "doc_b", similarity(F.col("sig_a"), F.col("sig_b")).alias("similarity"))
