"""Hashes that any SQL engine can compute: md5 residues below 2**31 - 1 and linear permutations of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1
EMPTY = PRIME  # what an empty set has at every permutation: above every residue


def hash31(s: Column) -> Column:
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long") % PRIME


def places(n: int) -> list[int]:
    """What the hash of each word of a shingle of n is multiplied by."""
    return [pow(1_000_003, n - k, PRIME) for k in range(n)]


def permutations(n: int, seed: int = 42) -> list[tuple[int, int]]:
    """n pairs (a, b) with 0 < a < PRIME and 0 <= b < PRIME from a fixed generator."""
    x, out = seed, []
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append((x >> 33) % PRIME)
        out.append((pair[0] or 1, pair[1]))
    return out


def band_key(signature: Column, band: int, rows: int) -> Column:
    """The key of one band: md5 over its values."""
    return F.md5(F.array_join(F.slice(signature, band * rows + 1, rows), ","))


def content_key(*parts: Column) -> Column:
    """The first 32 hex digits of SHA-256 over the parts, which a null keeps in its place."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), 1, 32)


def bloom_memory(items: Column, bands: int, fp_rate: float) -> Column:
    """Bytes of one Bloom filter for each band, for so many items."""
    import math

    return (F.floor(items * (-math.log(fp_rate) / math.log(2) ** 2) / 8) + 1) * bands


def exact_memory(items: Column, bands: int) -> Column:
    return items * bands * 48
