"""Threshold-scaled document sketches.

A shingle of ``K`` words has a 62-bit hash; a sketch is every hash below
2**62 / ``scaled``. Sketches of any two documents, however unequal, can be
merged by union and compared for containment.

Defined results: words are runs without ASCII white space; null and empty
texts have no shingles and an empty sketch; a text of fewer than ``K`` words
has one shingle, the whole text; repeated rows each have their sketch; ids may
be null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import pick, slices, table

K = 5
SCALED = 16
P = 2**31 - 1
BASES = ((1, 1_000_003, 762_939_453, 1_220_703_125, 48_828_125), (1, 16_777_619, 1_103_515_245, 69_069, 1_664_525))
WORD = re.compile(r"[^ \t\n\r\f\v]+")


class Md5Words(dict):
    """Word to two residues mod 2**31 - 1, packed as h1 << 31 | h2."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 250_000:
            self.clear()
        d = md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        v = self[word] = (int(d[:8], 16) % P) << 31 | int(d[8:16], 16) % P
        return v


def shingle_hashes(words: list[str], known: Md5Words) -> np.ndarray:
    """A hash of each window of K words (of all words where there are fewer)."""
    if not words:
        return np.empty(0, np.int64)
    packed = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    k, out = min(K, len(words)), None
    for part, bases in ((packed >> 31, BASES[0]), (packed & 0x7FFFFFFF, BASES[1])):
        n = len(words) - k + 1
        h = np.zeros(n, np.int64)
        for i in range(k):
            h += part[i : i + n] * bases[i] % P
        out = h % P if out is None else out << 31 | h % P
    return out


def sketches(docs: DataFrame, scaled: int = SCALED) -> DataFrame:
    """(doc_id, n_words, n_kept, sketch): one row for each document; sketch ascending and distinct."""
    limit = 2**62 // scaled

    def run(batches):
        known = Md5Words()
        for b in slices(batches):
            words_n, sizes, kept = [], [], []
            for text in b.column("text").to_pylist():
                w = WORD.findall(text) if text else []
                h = shingle_hashes(w, known)
                h = np.unique(h[h < limit])
                words_n.append(len(w)), sizes.append(len(h)), kept.append(h)
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words_n, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, np.concatenate(kept) if kept else np.empty(0, np.int64))], ["doc_id", "n_words", "n_kept", "sketch"])

    return pick(docs).mapInArrow(run, "doc_id long, n_words long, n_kept long, sketch array<long>")


def containment(a: str | Column, b: str | Column) -> Column:
    """The estimated share of a's shingles that b has; null where a's sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merge(each: DataFrame, by: str) -> DataFrame:
    """Sketches of unions: (by, sketch). Distinct hashes are found before they are gathered."""
    flat = each.select(by, F.explode("sketch").alias("h")).distinct()
    return flat.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sketches(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", "n_kept", F.array_join("sketch", ",").alias("sketch"))


def _poly(part: str, bases: tuple) -> str:
    return "(" + " + ".join(f"coalesce(({part}{i} * {b}) % {P}, 0)" for i, b in enumerate(bases)) + f") % {P}"


def op4_sql(scaled: int = SCALED) -> str:
    leads = ", ".join(f"lead(a, {i}) OVER w AS a{i}, lead(b, {i}) OVER w AS b{i}" for i in range(K))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0b]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM d),
v AS (SELECT DISTINCT w FROM t),
m AS (SELECT w, ('0x' || substr(md5(w), 1, 8))::BIGINT % {P} AS a, ('0x' || substr(md5(w), 9, 8))::BIGINT % {P} AS b FROM v),
s AS (SELECT r, i, n, {leads} FROM t JOIN m USING (w) WINDOW w AS (PARTITION BY r ORDER BY i)),
h AS (SELECT DISTINCT r, ({_poly('a', BASES[0])}) * 2147483648 + {_poly('b', BASES[1])} AS h FROM s WHERE i <= greatest(1, n - {K - 1})),
k AS (SELECT r, count(*) AS n_kept, string_agg(h::VARCHAR, ',' ORDER BY h) AS sketch FROM h WHERE h < {2**62 // scaled} GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_kept, 0)::BIGINT AS n_kept, coalesce(sketch, '') AS sketch FROM d LEFT JOIN k USING (r)
"""
