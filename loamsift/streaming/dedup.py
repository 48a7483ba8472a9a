"""Streaming deduplication: micro-batches against a table of band keys.

The state is a folder with one Parquet part for each micro-batch, named by its
number. A batch reads the parts before it and overwrites its own, so one that
is run again after a failure sees what it saw the first time.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.operators.first_seen import STATE, build_state, flags, keys_of, merge_states, stream_stats
from loamsift.plans.config import StreamConfig
from loamsift.session import materialize

VERSION = 1


class BandIndex:
    """Band keys that were seen, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, config: StreamConfig | None = None):
        """An index that is there keeps its own settings; ``config`` is for a new one."""
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = f"{self.path}/config.json"
        if self._fs.exists(self._path(at)):
            held = json.loads(spark.read.text(at, wholetext=True).first()[0])
            if held.pop("version") != VERSION:
                raise ValueError(f"{path} is of another version")
            self.config = StreamConfig(**held)
        else:
            self.config = config or StreamConfig()
            text = json.dumps({"version": VERSION, **self.config.__dict__})
            out = self._fs.create(self._path(at), True)
            out.write(bytearray(text.encode()))
            out.close()

    def parts(self) -> list[int]:
        if not self._fs.exists(self._path(f"{self.path}/keys")):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/keys")))
        return sorted(int(m[1]) for m in (re.fullmatch(r"batch=(\d+)", n) for n in names) if m)

    def state(self, before: int | None = None) -> DataFrame:
        """(band_id, band_hash, first_seq) of all parts, or of those before a batch."""
        paths = [f"{self.path}/keys/batch={k}" for k in self.parts() if before is None or k < before]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def add(self, keys: DataFrame, batch: int) -> None:
        """The keys that no part before has."""
        new = build_state(keys).join(self.state(batch).select("band_id", "band_hash"), ["band_id", "band_hash"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")

    def compact(self) -> None:
        """All parts as one, under the number of the last."""
        k = self.parts()
        if len(k) > 1:
            whole = materialize(merge_states(self.state()), "keys")
            whole.write.mode("overwrite").parquet(f"{self.path}/keys/batch={k[-1]}")
            for old in k[:-1]:
                self._fs.delete(self._path(f"{self.path}/keys/batch={old}"), True)

    def merge(self, other: BandIndex) -> tuple[int, int, int]:
        """Take what another index knows; (before, added, after) in keys."""
        if self.config.dedup.bands != other.config.dedup.bands:
            raise ValueError(f"num_bands or rows differ: {self.config.dedup.bands} and {other.config.dedup.bands}")
        before = self.state().count()
        k = (self.parts() or [-1])[-1] + 1
        keys = other.state().select("band_id", "band_hash", F.col("first_seq").alias("doc_id"))
        self.add(keys, k)
        after = self.state().count()
        return before, after - before, after

    def reset(self) -> None:
        self._fs.delete(self._path(f"{self.path}/keys"), True)

    def check_and_insert(self, docs: DataFrame, batch: int | None = None, seq_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, is_duplicate) of a batch, whose keys then belong to the index."""
        k = (self.parts() or [-1])[-1] + 1 if batch is None else batch
        keys = materialize(keys_of(docs, self.config, seq_col, text_col), "keys")
        flagged = materialize(flags(keys, self.state(k)), "flags")
        self.add(keys, k)
        return flagged


def deduplicate_stream(stream: DataFrame, index: BandIndex, out_path: str, checkpoint: str, seq_col: str = "doc_id", text_col: str = "text"):
    """A streaming query that writes first-seen rows, all columns, under ``out_path``; start a trigger by ``.start()``."""

    def each(batch: DataFrame, number: int) -> None:
        rows = materialize(batch, "batch")
        flagged = index.check_and_insert(rows, number, seq_col, text_col).where("is_duplicate").select(F.col("doc_id").alias("__loamsift_gone"))
        kept = rows.join(flagged, F.col(f"`{seq_col}`") == F.col("__loamsift_gone"), "left_anti")
        kept.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)


def stats(flagged: DataFrame) -> DataFrame:
    return stream_stats(flagged)
