"""Byte codecs over binary columns: grouping, XOR deltas, zstd. Arrow batches in and out, no shuffle but for the order of a delta."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = {"bf16": 2, "fp16": 2, "f16": 2, "fp32": 4, "f32": 4}
LEVEL = 3


def group_bytes(data: bytes, width: int) -> bytes:
    """First bytes of all values, then second bytes, and so on."""
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no multiple of {width}")
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def ungroup_bytes(data: bytes, width: int) -> bytes:
    if len(data) % width:
        raise ValueError(f"{len(data)} bytes are no multiple of {width}")
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()


def xor(a: bytes, b: bytes | None) -> bytes:
    """a XOR b; a itself without b."""
    if b is None:
        return a
    if len(a) != len(b):
        raise ValueError(f"lengths differ: {len(a)} and {len(b)}")
    return (np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).tobytes()


def sparsity_of(data: bytes) -> float:
    """The share of zero bytes; 1 for none."""
    return float((np.frombuffer(data, np.uint8) == 0).mean()) if data else 1.0


def compress(data: bytes, dtype: str = "raw", level: int = LEVEL) -> bytes:
    """zstd over grouped bytes; dtypes without a width go as they are."""
    w = WIDTHS.get(dtype)
    return zstandard.ZstdCompressor(level=level).compress(group_bytes(data, w) if w and data else data)


def decompress(data: bytes, size: int, dtype: str = "raw") -> bytes:
    out = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes where {size} were expected")
    w = WIDTHS.get(dtype)
    return ungroup_bytes(out, w) if w and out else out


def bf16(values: np.ndarray) -> bytes:
    """The upper halves of float32: cut off, not rounded."""
    return (np.asarray(values, "<f4").view("<u4") >> 16).astype("<u2").tobytes()


def from_bf16(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, "<u2").astype("<u4") << 16).view("<f4")


def _udf(kind: str, f: Callable, *columns: Column) -> Column:
    def made(rows) -> pd.Series:
        return pd.Series([None if r[0] is None else f(*r) for r in rows], dtype="object" if kind == "binary" else "float64")

    def one(a: pd.Series) -> pd.Series:
        return made(zip(a))

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return made(zip(a, b))

    return F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


def grouped(data: Column, width: int) -> Column:
    return _udf("binary", lambda d: group_bytes(d, width), data)


def ungrouped(data: Column, width: int) -> Column:
    return _udf("binary", lambda d: ungroup_bytes(d, width), data)


def delta(data: Column, previous: Column) -> Column:
    return _udf("binary", xor, data, previous)


def sparsity(data: Column) -> Column:
    return _udf("double", sparsity_of, data)


def compressed(data: Column, dtype: str = "raw", level: int = LEVEL) -> Column:
    return _udf("binary", lambda d: compress(d, dtype, level), data)


def decompressed(data: Column, size: Column, dtype: str = "raw") -> Column:
    return _udf("binary", lambda d, n: decompress(d, int(n), dtype), data, size)


def float_bytes(v: Column) -> Column:
    """float32 values as little-endian bytes."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x, "<f4").tobytes() for x in s], dtype="object")

    return F.pandas_udf(run, "binary")(v)


def ratio(original: Column, packed: Column) -> Column:
    return F.when(packed == 0, F.lit(0.0)).otherwise(original / packed)


def delta_encoded(df: DataFrame, model: str, step: str, data: str, dtype: str = "fp32") -> DataFrame:
    """(model, step, size, packed, reference_step, sparsity, ratio): each step against the one before it, if that has its length.

    Models are independent, so the window is as parallel as there are models.
    """
    w = Window.partitionBy(model).orderBy(step)
    size = F.octet_length(data)
    paired = df.select(model, step, F.col(data).alias("data"), size.alias("size"), F.lag(data).over(w).alias("previous"), F.lag(step).over(w).alias("reference_step"))
    used = F.col("previous").isNotNull() & (F.octet_length("previous") == F.col("size"))
    paired = paired.withColumn("reference_step", F.when(used, F.col("reference_step"))).withColumn("delta", delta(F.col("data"), F.when(used, F.col("previous"))))
    packed = paired.select(model, step, "size", "reference_step", sparsity(F.col("delta")).alias("sparsity"), compressed(F.col("delta"), dtype).alias("packed"))
    return packed.select("*", ratio(F.col("size"), F.octet_length("packed")).alias("ratio"))


def delta_decoded(packed: DataFrame, model: str, step: str, dtype: str = "fp32") -> DataFrame:
    """(model, step, data): chains of deltas undone, one model at a time in order of steps.

    Every step needs the one before, so a model's steps are read in sequence;
    they stream through one task and only the last one is held.
    """
    kinds = dict(packed.dtypes)

    def run(batches):
        now, last = object(), None
        for b in batches:
            t = b.to_pandas()
            out = []
            for m, n, ref, p in zip(t[model], t["size"], t["reference_step"], t["packed"]):
                if m != now:
                    now, last = m, None
                raw = None if p is None else decompress(p, int(n), dtype)
                last = raw if raw is None or pd.isna(ref) else xor(raw, last)
                out.append(last)
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([b.column(model), b.column(step), pa.array(out, pa.binary())], [model, step, "data"])

    laid = packed.repartition(model).sortWithinPartitions(model, step).select(model, step, "size", "reference_step", "packed")
    return laid.mapInArrow(run, f"{model} {kinds[model]}, {step} {kinds[step]}, data binary")
