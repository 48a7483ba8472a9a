"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "loamsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; settings already made by the cluster win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only on a
    local master; a cluster without the setting is an error, because its
    executors share no local folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if d:
        return d.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="loamsift-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder stays for the cluster's own cleaning
        pass


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession):
    """What is written within leaves no shuffle files; they would stay until the driver collects garbage."""
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, held)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of the table and no
    recomputation, and the shuffle files behind it go at once. The table is
    deleted by ``release``, or when the program ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/loamsift-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(f"{folder}/{label}.parquet")
    atexit.register(_delete, spark, folder)
    out = spark.read.schema(df.schema).parquet(f"{folder}/{label}.parquet")
    out._loamsift_folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and no plan reads any more; others are left alone."""
    for t in tables:
        folder = t.__dict__.pop("_loamsift_folder", None)
        if folder:
            _delete(t.sparkSession, folder)
