"""Exact duplicates, and a content-addressed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(…order, is_duplicate, keep…): every row with the first of those with equal ``by``.

    Only a digest of ``by`` and the order columns go through the shuffle. Nulls
    are equal to each other and come last in the order.
    """
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in by)), 256)
    rank = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))))
    rows = df.select(*order, digest.alias("digest"))
    heads = rows.groupBy("digest").agg(F.min(rank).alias("head"))
    same = [F.col("head")[c].eqNullSafe(F.col(c)) for c in order]
    all_same = same[0]
    for s in same[1:]:
        all_same = all_same & s
    return rows.join(heads, "digest").select(*order, *(F.col("head")[c].alias(f"keep_{c}") for c in order), (~all_same).alias("is_duplicate"))


def content_table(df: DataFrame, column: str) -> DataFrame:
    """(address, size, references): each content once, under the SHA-256 of its bytes."""
    data = F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8") if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.select(F.sha2(data, 256).alias("address"), F.octet_length(data).alias("size")).groupBy("address").agg(F.max("size").cast("long").alias("size"), F.count("*").alias("references"))


def address_path(address: str = "address"):
    """aa/bb/rest, as a store lays out its files."""
    a = F.col(address)
    return F.concat_ws("/", F.substring(a, 1, 2), F.substring(a, 3, 2), a)
