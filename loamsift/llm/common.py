"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.functions.words import Powers, mix, word_hashes  # noqa: F401

SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash or be read."""
    return df.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text, so that memory doesn't follow the length of documents."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            floor = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, floor + limit, "right")))
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # a worker lives on after its task


class WordHash(dict):
    """Word to a 64-bit hash, remembered; forgets all once it holds ``most`` words."""

    most = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return v

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
