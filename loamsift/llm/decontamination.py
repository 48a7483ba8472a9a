"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND.

The index holds the test items, the queries are passages: every window of
``window`` words, stepping half a window, of every document. Terms are pairs
of neighbouring words (single words for items of one word). A passage takes
every item that scores at least ``share`` of the item's score against itself,
and a hit stands if enough of both its question and its answer (the last
sentence) is found in the passage, word for word in runs of up to ``RUN``.

Blocks are items of like self-score. A passage first sums, for all its words
at once, each block's largest impacts; blocks that stay below their smallest
threshold are skipped, and WAND with block bounds goes through the rest.

Document frequencies, the mean length and the window are those of all items,
also where these are so many that they are indexed in parts.

Defined results: null and empty texts match nothing; items that are null or
without words are left out; repeated rows and equal items each give their own
rows; null ids stay null; of windows with equal scores the first is given;
empty tables give an empty result; other columns are ignored (``leaks``) or
passed through (``remove_contaminated``); long texts are read whole.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import pick, slices, table
from loamsift.session import materialize, release

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B_LEN, SHARE, RUN, OVERLAP, WINDOW, BLOCK, LEVEL = 1.2, 0.75, 0.4, 5, 0.5, 128, 16, 64
ITEMS_AT_ONCE = 50_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words before and in the last sentence; one sentence is question and answer at once."""
    parts = [p for p in (words_of(s) for s in SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def runs(words: list[str]) -> set[tuple[str, ...]]:
    k = min(RUN, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def covered(part: list[str], passage: list[str]) -> float:
    """The share of the part's runs that stand in the passage; 1 for an empty part."""
    want = runs(part)
    k = min(RUN, len(part))
    return len(want & {tuple(passage[i : i + k]) for i in range(len(passage) - k + 1)}) / len(want) if want else 1.0


@dataclass
class Index:
    ids: list
    parts: list
    vocab: dict
    codes: np.ndarray
    postings: list
    limits: np.ndarray
    block_of: np.ndarray
    block_limits: np.ndarray
    level: np.ndarray
    window: int


def terms_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:])) if len(words) > 1 else [(w, "") for w in words]


@dataclass(frozen=True)
class Statistics:
    """Of all usable items: how many, their mean number of terms, and the words of the longest."""

    n: int
    mean: float
    longest: int


def build(items: list[tuple[int, str]], share: float = SHARE, df: dict | None = None, of_all: Statistics | None = None) -> Index | None:
    """An index of (item_id, text); None without any usable item. ``df`` and ``of_all`` are those of these items unless they are given."""
    docs = [(i, t, terms_of(words_of(t))) for i, t in items if t and words_of(t)]
    if not docs:
        return None
    df = df or Counter(x for *_, t in docs for x in set(t))
    of_all = of_all or Statistics(len(docs), sum(len(t) for *_, t in docs) / len(docs), max(len(words_of(t)) for _, t, _ in docs))
    n, mean = of_all.n, of_all.mean

    def impact(term, tf, size):
        return math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B_LEN + B_LEN * size / mean))

    weighed = [(i, t, {x: impact(x, tf, len(terms)) for x, tf in Counter(terms).items()}) for i, t, terms in docs]
    weighed.sort(key=lambda d: (sum(d[2].values()), d[0] is None, d[0]))
    limits = np.array([share * sum(d[2].values()) for d in weighed])
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for *_, t in weighed for x in t for w in x if w}))}
    by = defaultdict(list)
    for k, (*_, t) in enumerate(weighed):
        for (a, b), v in t.items():
            by[vocab[a] * (len(vocab) + 1) + vocab.get(b, 0)].append((k, v))
    codes = np.array(sorted(by), np.int64)
    size = max(BLOCK, -(-len(weighed) // LEVEL))
    block_of = np.arange(len(weighed)) // size
    level = np.zeros((len(codes) + 1, int(block_of[-1]) + 1), np.float32)
    for k, c in enumerate(codes):
        for item, v in by[int(c)]:
            level[k, block_of[item]] = max(level[k, block_of[item]], v * 1.00001)
    return Index([d[0] for d in weighed], [question_and_answer(d[1]) for d in weighed], vocab, codes, [by[int(c)] for c in codes], limits, block_of, np.minimum.reduceat(limits, np.searchsorted(block_of, np.arange(block_of[-1] + 1))), level, max(WINDOW, 2 * of_all.longest))


def wand(index: Index, terms: list[int], live: np.ndarray) -> list[tuple[int, float]]:
    """Items, of the live blocks, that score at least their limit: document at a time with block-max pivots."""
    cursors = [[index.postings[t], 0, t] for t in terms]
    out = []

    def seek(c, item):
        p, k, _ = c
        while k < len(p) and p[k][0] < item:
            k += 1
        c[1] = k

    while True:
        cursors = [c for c in cursors if c[1] < len(c[0])]
        if not cursors:
            return out
        cursors.sort(key=lambda c: c[0][c[1]][0])
        first = cursors[0][0][cursors[0][1]][0]
        block = index.block_of[first]
        over = int(np.searchsorted(index.block_of, block + 1))
        bound = sum(index.level[c[2], block] for c in cursors if index.block_of[c[0][c[1]][0]] == block) if live[block] else -1.0
        if bound < index.block_limits[block]:
            for c in cursors:
                seek(c, over)
            continue
        bound, pivot = 0.0, None
        for c in cursors:
            if index.block_of[c[0][c[1]][0]] != block:
                break
            bound += index.level[c[2], block]
            if bound >= index.block_limits[block]:
                pivot = c[0][c[1]][0]
                break
        if pivot is None:
            for c in cursors:
                seek(c, over)
        elif pivot > first:
            for c in cursors:
                if c[0][c[1]][0] < pivot:
                    seek(c, pivot)
        else:
            found = [c for c in cursors if c[1] < len(c[0]) and c[0][c[1]][0] == pivot]
            score = math.fsum(c[0][c[1]][1] for c in found)
            for c in found:
                c[1] += 1
            if score >= index.limits[pivot] - 1e-9:
                out.append((pivot, score))


def search(index: Index, words: list[str]) -> list[tuple[int, int, float, float, float]]:
    """(item, window start, score, question overlap, answer overlap) of the best window of each item that stands."""
    if not words:
        return []
    one = len(words) == 1
    ids = np.fromiter((index.vocab.get(w, 0) for w in words), np.int64, len(words))
    if not ids.any():
        return []
    base = len(index.vocab) + 1
    left, right = (ids, np.zeros(1, np.int64)) if one else (ids[:-1], ids[1:])
    n = len(left)
    at = np.flatnonzero((left > 0) & ((right > 0) | one))
    code = left[at] * base + right[at]
    k = np.searchsorted(index.codes, code)
    hit = index.codes[np.minimum(k, len(index.codes) - 1)] == code
    at, k = at[hit], k[hit]
    if index.codes[0] % base == 0 and not one:  # items of one word
        single = np.searchsorted(index.codes, ids * base)
        ok = (ids > 0) & (index.codes[np.minimum(single, len(index.codes) - 1)] == ids * base)
        at, k = np.concatenate([at, np.flatnonzero(ok)]), np.concatenate([k, single[ok]])
        order = np.argsort(at, kind="stable")
        at, k = at[order], k[order]
    if not len(at):
        return []
    step = index.window // 2
    starts = np.arange(0, max(1, n - step), step)
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + index.window)
    sums = np.concatenate([np.zeros((1, index.level.shape[1]), np.float64), np.cumsum(index.level[k], axis=0, dtype=np.float64)])
    live = sums[hi] - sums[lo] >= index.block_limits - 1e-6
    best = {}
    for w in np.flatnonzero(live.any(axis=1)):
        start = int(starts[w])
        for item, score in wand(index, np.unique(k[lo[w] : hi[w]]).tolist(), live[w]):
            question, answer = index.parts[item]
            passage = words[start : start + index.window + 1]
            qo, ao = covered(question, passage), covered(answer, passage)
            if qo >= OVERLAP and ao >= OVERLAP and (item not in best or score > best[item][2]):
                best[item] = (item, start, score, qo, ao)
    return sorted(best.values())


SCHEMA = "doc_id long, item_id long, passage_start int, score double, question_overlap double, answer_overlap double"


def _item_terms(batches):
    """The distinct terms of each usable item, joined by spaces, and its numbers of terms and words."""
    for b in batches:
        rows = []
        for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
            words = words_of(text)
            if words:
                terms = terms_of(words)
                rows.append((rid, [" ".join(x for x in t if x) for t in dict.fromkeys(terms)], len(terms), len(words)))
        c = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()])], ["rid", "terms", "n_terms", "n_words"])


def _indexes(items: DataFrame, share: float):
    """Indexes of at most ITEMS_AT_ONCE items each, in turn, so that what a task holds has a checked size; statistics are those of all items."""
    rows = items.select(F.monotonically_increasing_id().alias("rid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(rows, "items")
    terms = materialize(rows.select("rid", "text").mapInArrow(_item_terms, "rid long, terms array<string>, n_terms long, n_words long"), "terms")
    of = terms.agg(F.count("*").alias("n"), F.sum("n_terms").alias("terms"), F.max("n_words").alias("longest")).first()
    if not of.n:
        return
    of_all = Statistics(of.n, of.terms / of.n, of.longest)
    each = terms.select("rid", F.explode("terms").alias("term"))
    counts = each.join(each.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("rid").agg(F.collect_list(F.struct("term", "df")).alias("counts"))
    part, df = [], {}
    for r in rows.join(counts, "rid").orderBy("item_id", "text", "rid").toLocalIterator():
        part.append((r.item_id, r.text))
        for x in r.counts:
            a, _, b = x.term.partition(" ")
            df[a, b] = x.df
        if len(part) == ITEMS_AT_ONCE:
            yield build(part, share, df, of_all)
            part, df = [], {}
    if part:
        yield build(part, share, df, of_all)
    release(rows, terms)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """One row for each document and test item that leaked into it."""
    out = None
    for index in filter(None, _indexes(items, share)):
        held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches, held=held):
            index = pickle.loads(held.value)
            for b in slices(batches):
                rows = [(i, index.ids[m[0]], *m[1:]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for m in search(index, words_of(t))]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), *(pa.array(x, pa.float64()) for x in c[3:])], ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])

        part = pick(docs).mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def remove_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE, text_col: str = "text") -> DataFrame:
    """The documents without any leak, all columns as they are."""
    text_at = docs.columns.index(text_col)
    for index in filter(None, _indexes(items, share)):
        held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))

        def run(batches, held=held):
            index = pickle.loads(held.value)
            for b in slices(batches, text_at):
                yield b.filter(pa.array([not search(index, words_of(t)) for t in b.column(text_at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
