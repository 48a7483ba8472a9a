"""Check-and-insert over band keys, exact and without order-dependent state.

A document is flagged if any earlier one, flagged or not, has one of its band
keys. So the flag follows from the first place at which each key occurs, which
is an aggregate with partial sums on the map side; no bitmaps, no false positives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamsift.operators.minhash import band_keys, signatures
from loamsift.plans.config import StreamConfig
from loamsift.session import materialize

STATE = "band_id int, band_hash string, first_seq long"


def keys_of(docs: DataFrame, config: StreamConfig = StreamConfig(), seq_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, band_id, band_hash) under the places that ``seq_col`` gives."""
    return band_keys(signatures(docs, config.dedup, seq_col, text_col), config.dedup)


def build_state(keys: DataFrame) -> DataFrame:
    """(band_id, band_hash, first_seq): the first place of every key."""
    return keys.groupBy("band_id", "band_hash").agg(F.min("doc_id").alias("first_seq"))


def merge_states(*states: DataFrame) -> DataFrame:
    """One state that knows what any of them knows; states of another number of bands are an error."""
    counts = {s.agg(F.max("band_id")).first()[0] for s in states} - {None}
    if len(counts) > 1:
        raise ValueError(f"num_bands differ: {sorted(c + 1 for c in counts)}")
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("band_id", "band_hash").agg(F.min("first_seq").alias("first_seq"))


def flags(keys: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(doc_id, is_duplicate) of a batch; ``state`` holds what came before it, all of which is earlier."""
    k = ["band_id", "band_hash"]
    met = keys.join(build_state(keys), k).select(*k, "doc_id", (F.col("first_seq") < F.col("doc_id")).alias("hit"))
    if state is not None:
        met = met.join(state.select(*k, F.lit(True).alias("known")), k, "left").select("doc_id", (F.col("hit") | F.coalesce("known", F.lit(False))).alias("hit"))
    return met.groupBy("doc_id").agg(F.max("hit").alias("is_duplicate"))


def first_seen(docs: DataFrame, config: StreamConfig = StreamConfig(), seq_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, is_duplicate): what feeding the documents in order gives; rows with null places are left out."""
    keys = materialize(keys_of(docs.where(F.col(f"`{seq_col}`").isNotNull()), config, seq_col, text_col), "keys")  # read twice
    return flags(keys)


def probe(docs: DataFrame, state: DataFrame, config: StreamConfig = StreamConfig(), seq_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, is_known): whether a document shares a key with the state; nothing is inserted."""
    keys = keys_of(docs, config, seq_col, text_col)
    hit = keys.join(state.select("band_id", "band_hash", F.lit(True).alias("known")), ["band_id", "band_hash"], "left")
    return hit.groupBy("doc_id").agg(F.max(F.coalesce("known", F.lit(False))).alias("is_known"))


def stream_stats(flagged: DataFrame) -> DataFrame:
    n, d = F.count("*"), F.coalesce(F.sum(F.col("is_duplicate").cast("long")), F.lit(0)).cast("long")
    return flagged.agg(n.alias("total"), d.alias("duplicates")).select("total", "duplicates", (F.col("total") - F.col("duplicates")).alias("unique_docs"), F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.col("duplicates") / F.col("total")).alias("duplicate_ratio"))
