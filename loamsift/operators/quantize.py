"""Quantisation of vectors as Column expressions: int8, int4 and NF4, with error statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamsift.functions.text import let

#: Quantiles of the normal distribution, scaled to [-1, 1].
NF4 = (-1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0, 0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0)
GROUP = 64


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def absmax(v: Column) -> Column:
    return F.aggregate(F.filter(_double(v), finite), F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))


def int8_scale(v: Column) -> Column:
    m = absmax(v)
    return F.when(m > 0, m / 127.0).otherwise(F.lit(1.0))


def int8(v: Column, scale: Column) -> Column:
    """Rounded half away from zero and held to -128..127; NaN is 0."""
    return F.transform(_double(v), lambda x: F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.round(x / scale)))).cast("tinyint"))


def from_int8(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def int4_range(v: Column) -> tuple[Column, Column]:
    """(minimum, step) of 16 even levels."""
    kept = F.filter(_double(v), finite)
    low, high = F.coalesce(F.array_min(kept), F.lit(0.0)), F.coalesce(F.array_max(kept), F.lit(0.0))
    return low, F.when(high > low, (high - low) / 15.0).otherwise(F.lit(1.0))


def int4(v: Column, low: Column, step: Column) -> Column:
    return F.transform(_double(v), lambda x: F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(15.0), F.round((x - low) / step)))).cast("tinyint"))


def from_int4(q: Column, low: Column, step: Column) -> Column:
    """The minimum is added back, so that ranges that don't hold zero come back as well."""
    return F.transform(q, lambda x: x.cast("double") * step + low)


def nf4_scales(v: Column, group: int = GROUP) -> Column:
    """The greatest absolute value of each group; the length has to be a multiple of the group."""
    n = F.size(v)
    groups = F.transform(F.sequence(F.lit(0), (n / group).cast("int") - 1), lambda g: absmax(F.slice(v, g * group + 1, group)))
    return F.when((n % group != 0) | (n == 0), F.raise_error(F.format_string("length %d is no multiple of the group", n)).cast("array<double>")).otherwise(groups)


def nf4(v: Column, scales: Column, group: int = GROUP) -> Column:
    """The number of the nearest level, the lower of two that are equally near."""

    def nearest(x: Column, i: Column) -> Column:
        s = F.element_at(scales, (i / group).cast("int") + 1)
        y = F.when(s > 0, x / s).otherwise(F.lit(0.0))
        out = F.lit(0)
        for k in range(1, 16):
            out = out + (y > (NF4[k - 1] + NF4[k]) / 2).cast("int")
        return out.cast("tinyint")

    return F.transform(_double(v), nearest)


def from_nf4(q: Column, scales: Column, group: int = GROUP) -> Column:
    levels = F.array(*(F.lit(x) for x in NF4))
    return F.transform(q, lambda x, i: F.element_at(levels, x.cast("int") + 1) * F.element_at(scales, (i / group).cast("int") + 1))


def packed_nibbles(q: Column) -> Column:
    """Two levels in a byte as hex, the first in the low half."""
    pairs = F.transform(F.sequence(F.lit(0), (F.size(q) / 2).cast("int") - 1), lambda i: F.lpad(F.hex(F.element_at(q, i * 2 + 1).cast("int") + F.element_at(q, i * 2 + 2).cast("int") * 16), 2, "0"))
    return F.unhex(F.array_join(pairs, ""))


def errors(df: DataFrame, original: Column, restored: Column, bits: float, by: str) -> DataFrame:
    """(by, mae, max_error, rmse, ratio) of each row."""
    e = F.transform(F.arrays_zip(_double(original).alias("x"), restored.alias("y")), lambda p: F.abs(p["x"] - p["y"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = F.size("e")
    d = df.select(by, e.alias("e"))
    return d.select(by, F.round(total(F.col("e")) / n, 8).alias("mae"), F.round(F.array_max("e"), 8).alias("max_error"), F.round(F.sqrt(total(F.transform("e", lambda x: x * x)) / n), 8).alias("rmse"), F.lit(32.0 / bits).alias("ratio"))


def quantization_errors(df: DataFrame, method: str = "int8", id_col: str = "vec_id", vector_col: str = "embedding", exclude: tuple[str, ...] = (), name_col: str | None = None) -> DataFrame:
    """Errors of each row's vector under one of ``int8``, ``dynamic_int8`` (the same), ``int4``, ``nf4``.

    Rows whose name holds any of ``exclude`` are left out.
    """
    v = F.col(f"`{vector_col}`")
    if name_col and exclude:
        for part in exclude:
            df = df.where(~F.contains(F.col(f"`{name_col}`"), F.lit(part)))
    if method in ("int8", "dynamic_int8"):
        return errors(df, v, let(int8_scale(v), lambda s: from_int8(int8(v, s), s)), 8.0, id_col)
    if method == "int4":
        low, step = int4_range(v)
        return errors(df, v, let(low, lambda a: let(step, lambda b: from_int4(int4(v, a, b), a, b))), 4.0, id_col)
    if method == "nf4":
        s = nf4_scales(v)
        d = df.select(id_col, v.alias("v"), s.alias("s"))
        return errors(d, F.col("v"), from_nf4(nf4(F.col("v"), F.col("s")), F.col("s")), 4.0, id_col)
    raise ValueError(f"no such method: {method}")
