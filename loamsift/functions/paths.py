"""Versions, devices, paths and shapes as Column expressions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKERS = ("src", "lib", "models", "scripts", "python", "torch")


def version(s: Column) -> Column:
    """struct(major, minor) of ``2.1`` or ``2.1.0``; null where there are fewer than two numbers."""
    part = lambda k: F.regexp_extract(s, r"^(\d+)\.(\d+)(?:\..*)?$", k).try_cast("int")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor")))


def version_serves(have: Column, want: Column) -> Column:
    """Same major, minor at least as high."""
    return (have["major"] == want["major"]) & (have["minor"] >= want["minor"])


def device_serves(kind: Column, major: Column, minor: Column, other_kind: Column, other_major: Column, other_minor: Column) -> Column:
    """Kinds: ``cuda_any``, ``cuda`` with a compute capability, ``cpu``. A capability serves its own and lower ones."""
    both = (kind == "cuda") & (other_kind == "cuda")
    any_cuda = kind.isin("cuda", "cuda_any") & other_kind.isin("cuda", "cuda_any")
    return F.when(both, F.struct(major, minor) >= F.struct(other_major, other_minor)).otherwise(any_cuda | ((kind == "cpu") & (other_kind == "cpu")))


def normalize_path(path: Column) -> Column:
    """From the first directory of MARKERS on; else the last part; else ``path_`` and a hash."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    marked = F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*MARKERS), i + 1)), lambda i: i.isNotNull())
    first = F.get(marked, F.lit(0))
    last = F.element_at(parts, -1)
    tail = F.array_join(F.slice(parts, first, F.size(parts)), "/")
    return F.when(first.isNotNull(), tail).when((F.size(parts) > 0) & (last != ".."), last).otherwise(F.concat(F.lit("path_"), F.substring(F.sha2(path, 256), 1, 16)))


def _plain_path(path: str) -> str:
    parts = [p for p in path.split("/") if p and p != "."]
    for i, p in enumerate(parts):
        if p in MARKERS:
            return "/".join(parts[i:])
    return parts[-1] if parts and parts[-1] != ".." else "path_" + hashlib.sha256(path.encode()).hexdigest()[:16]


def normalize_source(source: Column) -> Column:
    """Absolute paths inside quotation marks are rewritten as ``normalize_path`` does; the rest stays."""
    quoted = re.compile(r"""("|')((?:(?!\1)[^\n\\]|\\.)*)(\1)""")

    def one(m):
        s = m.group(2)
        absolute = (s.startswith("/") and not s.startswith("//")) or (len(s) >= 3 and s[1] == ":")
        return m.group(1) + (_plain_path(s) if absolute else s) + m.group(3)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else quoted.sub(one, t))

    return F.pandas_udf(run, "string")(source)


def is_dynamic(shape: Column) -> Column:
    return F.exists(shape, lambda d: d < 0)


def numel(shape: Column) -> Column:
    """The product of the dimensions; null if one of them is dynamic."""
    return F.when(~is_dynamic(shape), F.aggregate(shape, F.lit(1).cast("long"), lambda n, d: n * d.cast("long")))


def with_dynamic_batch(shape: Column) -> Column:
    return F.when(F.size(shape) > 0, F.concat(F.array(F.lit(-1).cast("long")), F.slice(shape.cast("array<long>"), 2, F.greatest(F.size(shape), F.lit(1))))).otherwise(shape.cast("array<long>"))
