"""A cache as tables: access metrics, eviction, compatibility of environments, differences between tiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamsift.functions.hashing import content_key
from loamsift.functions.paths import version

COMPATIBLE, WARNING, INCOMPATIBLE = 0, 1, 2
STATUS = ("Compatible", "Warning", "Incompatible")
Rule = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def entries(log: DataFrame, key: str, size: str, at: str) -> DataFrame:
    """(key, size, created, accessed, hit_count) of an access log; the first access of a key stores it."""
    k = F.col(key)
    return log.where(k.isNotNull()).groupBy(k.alias("key")).agg(F.max(size).alias("size"), F.min(at).alias("created"), F.max(at).alias("accessed"), (F.count("*") - 1).alias("hit_count"))


def metrics(log: DataFrame, key: str, size: str) -> DataFrame:
    """One row: accesses, misses (first accesses), hits, their bytes, and the share of hits; 0 for an empty log."""
    each = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.max(size).alias("size"))
    one = each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("accesses"), F.count("*").alias("misses"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_stored"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0)).alias("bytes_served"))
    hits = F.col("accesses") - F.col("misses")
    return one.select("accesses", "misses", hits.alias("hits"), "bytes_stored", "bytes_served", F.when(F.col("accesses") == 0, F.lit(0.0)).otherwise(hits / F.col("accesses")).alias("hit_rate"))


def prometheus(one: DataFrame, prefix: str = "cache") -> DataFrame:
    """(line) of every metric of a one-row table, in the text format that scrapers read."""
    names = one.columns
    lines = F.array(*(F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in names))
    return one.select(F.explode(lines).alias("line"))


def evicted(catalogue: DataFrame, max_bytes: int, needed: int = 0, partitions: int | None = None) -> DataFrame:
    """Entries that go, the least recently used first, until what stays is at most ``max_bytes - needed``.

    An entry goes exactly if those used more recently, and itself, exceed the
    bound in sum. The running sum is taken in two steps, so that no single task
    orders the catalogue: sums of ranges of the order, then sums inside them.
    """
    n = partitions or int(catalogue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("accessed"), F.asc("key")]
    ranged = catalogue.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    from loamsift.session import materialize

    ranged = materialize(ranged, "ranged")
    before = ranged.groupBy("part").agg(F.sum("size").alias("total"))  # one row for each range
    before = before.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    running = ranged.withColumn("inside", inside).join(F.broadcast(before), "part")
    return running.where(F.col("before") + F.col("inside") > max_bytes - needed).select("key", "size", "accessed", "hit_count")


def _same_version(name: str, optional: bool = False) -> Rule:
    def rule(cached, current):
        a, b = version(cached(name)), version(current(name))
        out = F.when(a.eqNullSafe(b), F.lit(COMPATIBLE)).otherwise(F.lit(INCOMPATIBLE))
        return F.when(cached(name).isNull(), F.lit(COMPATIBLE)).otherwise(out) if optional else out

    return rule


def _cuda(cached, current):
    a, b = version(cached("cuda")), version(current("cuda"))
    return F.when(cached("cuda").isNull() | (a == b), F.lit(COMPATIBLE)).when(b > a, F.lit(WARNING)).otherwise(F.lit(INCOMPATIBLE))


def _platform(cached, current):
    return F.when(cached("platform").eqNullSafe(current("platform")), F.lit(COMPATIBLE)).otherwise(F.lit(INCOMPATIBLE))


RULES: dict[str, Rule] = {"python": _same_version("python"), "torch": _same_version("torch"), "cuda": _cuda, "triton": _same_version("triton", True), "platform": _platform}


def compatibility(cached: DataFrame, current: dict[str, str | None], rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows of ``cached`` with one status for each rule and ``status``, the worst of them."""
    rules = RULES if rules is None else rules
    old, new = (lambda c: F.col(f"`{c}`")), (lambda c: F.lit(current.get(c)).cast("string"))
    levels = {n: r(old, new) for n, r in rules.items()}
    named = lambda level: reduce(lambda e, k: F.when(level == k, F.lit(STATUS[k])).otherwise(e), (WARNING, INCOMPATIBLE), F.lit(STATUS[0]))
    worst = F.greatest(*levels.values(), F.lit(COMPATIBLE)) if levels else F.lit(COMPATIBLE)
    return cached.withColumns({f"{n}_status": named(v) for n, v in levels.items()} | {"status": named(worst)})


def missing(have: DataFrame, other: DataFrame, key: str = "key") -> DataFrame:
    """What ``have`` holds and ``other`` doesn't: what a push sends or a pull fetches."""
    return have.join(other.select(key).distinct(), key, "left_anti")


def sync(local: DataFrame, remote: DataFrame, key: str = "key") -> DataFrame:
    """(key, action): pulls and then pushes that make both tiers equal."""
    pull = missing(remote, local, key).select(key, F.lit("pull").alias("action"))
    return pull.unionByName(missing(local, remote, key).select(key, F.lit("push").alias("action")))


def warmed(wanted: DataFrame, local: DataFrame, remote: DataFrame, key: str = "key") -> DataFrame:
    """(key, tier): where each wanted key is read from: local, remote or nowhere."""
    l, r = (d.select(key, F.lit(True).alias(n)).distinct() for d, n in ((local, "l"), (remote, "r")))
    return wanted.select(key).join(l, key, "left").join(r, key, "left").select(key, F.when(F.col("l"), "local").when(F.col("r"), "remote").otherwise("none").alias("tier"))


def keyed(df: DataFrame, parts: list[str], to: str = "key") -> DataFrame:
    """Rows under the key of their content."""
    return df.withColumn(to, content_key(*(F.col(p) for p in parts)))


def directory(spark, path: str) -> DataFrame:
    """One row: files and bytes under a folder, from their metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
