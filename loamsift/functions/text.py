"""Words and shingles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NGRAM = 5


def words(text: Column) -> Column:
    """Runs without Unicode white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def let(value: Column, f) -> Column:
    """f of a value that is computed once: a name inside a lambda isn't expanded again for every use of it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shingles(text: Column, n: int = NGRAM) -> Column:
    """The distinct runs of n words, joined by spaces; all words together where there are fewer than n; none for no words."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))))

    return let(words(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct values; two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def human_bytes(n: Column) -> Column:
    """1536 to ``1.50 KiB``."""
    out = F.format_string("%d B", n.cast("long"))
    for p, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**p, F.format_string(f"%.2f {unit}", n / F.lit(float(1024**p)))).otherwise(out)
    return out


def human_seconds(s: Column) -> Column:
    """Seconds as ``12.0s``, ``3.5m`` or ``1.2h``."""
    return F.when(s >= 3600, F.format_string("%.1fh", s / 3600)).when(s >= 60, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fs", s.cast("double")))
