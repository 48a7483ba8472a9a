"""Repeated passages by longest-previous-factor arrays.

In the order (id, place in the table), a word position p of a document has the
longest previous factor LPF[p]: the longest run of words from p that also
starts at an earlier position. Every p with LPF[p] >= ``LENGTH`` marks the
words [p, p + LPF[p]) as a later copy; the first copy stays.

No single machine sorts the suffixes of a corpus, so they are sorted apart by
content. Each window of LENGTH words has an anchor, the least hash of its runs
of ``GRAM`` words; equal windows have equal anchors, so a window's copies are
all found in its anchor's group. Windows in a row with one anchor form a
fragment. Later copies of a whole fragment are known from its hash. Where a
group holds different fragments, one of each is fetched, the suffixes of a
partition's fragments are sorted by prefix doubling, and LPF follows from the
previous and next smaller positions in that order.

Defined results: words are runs without white space; null and empty texts and
those of fewer than LENGTH words have no passages; repeated rows are copies of
the first of them; null ids come after all others; an empty table gives an
empty result; other columns are ignored (``repeats``) or passed through
(``remove_repeats``). ``docs`` is read twice and has to give the same rows in
the same places, as tables of files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import WordHash, mix, partitions, q, slices, table
from loamsift.session import materialize

LENGTH = 50
GRAM = 8
B = 0x9E3779B97F4A7C15 | 1
B_INV = pow(B, -1, 2**64)
RUN = np.dtype([("ah", "u8"), ("fh", "u8"), ("rid", "i8"), ("doc", "i8"), ("none", "u1"), ("s", "i4"), ("e", "i4"), ("a", "i4")])
HEAD = np.dtype([("ah", "u8"), ("rid", "i8"), ("doc", "i8"), ("none", "u1"), ("s", "i4"), ("e", "i4")])


class Powers:
    """Powers of B and of its inverse mod 2**64, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (B, B_INV))
        return self.up, self.down


def prefix_hashes(h: np.ndarray, powers: Powers) -> np.ndarray:
    up, _ = powers.upto(len(h) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])


def span_hash(p: np.ndarray, s: np.ndarray, e: np.ndarray, powers: Powers) -> np.ndarray:
    return (p[e] - p[s]) * powers.upto(len(p))[1][s]


def leftmost_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """The index of the least of v[i : i + width], the leftmost of equals, for every i."""
    at, size = np.arange(len(v)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(v[right] < v[left], right, left)
        size += step
    return at


def fragments(words: np.ndarray, sizes: np.ndarray, powers: Powers, length: int, gram: int):
    """(document, s, e, anchor place, anchor hash, content hash) arrays; places count within the document."""
    total = len(words)
    if total < length:
        return None
    up_to = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    p = prefix_hashes(words, powers)
    g = np.arange(total - gram + 1)
    grams = mix(span_hash(p, g, g + gram, powers))
    at = leftmost_minimum(grams, length - gram + 1)
    start = np.flatnonzero(owner[: total - length + 1] == owner[length - 1 :])
    if not len(start):
        return None
    at = at[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])])
    first = np.flatnonzero(new)
    s, e, a = start[first], start[np.concatenate([first[1:], [len(start)]]) - 1] + length, at[first]
    d = owner[s]
    base = (up_to - sizes)[d]
    content = mix(span_hash(p, s, e, powers) + mix((e - s).astype(np.uint64) * np.uint64(1_000_003) + (a - s).astype(np.uint64)))
    return d, s - base, e - base, a - base, grams[a], content


def _blobs(to: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each target partition, with the bytes of its records."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    ends = [*first[1:].tolist(), len(to)]
    return pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), *(pa.array([c[order[i:j]].tobytes() for i, j in zip(first, ends)], pa.binary()) for c in columns.values())], ["to", *columns])


def _emit_runs(n_parts: int, length: int, gram: int):
    def run(batches):
        known, powers = WordHash(), Powers()
        for b in slices(batches, limit=4 << 20):
            words = [t.split() if t else [] for t in b.column("text").to_pylist()]
            sizes = np.array([len(w) for w in words], np.int64)
            found = fragments(known.of([w for ws in words for w in ws]), sizes, powers, length, gram)
            if found is None:
                continue
            d, s, e, a, ah, fh = found
            out = np.zeros(len(d), RUN)
            out["ah"], out["fh"], out["s"], out["e"], out["a"] = ah, fh, s, e, a
            doc = b.column("doc_id")
            out["rid"], out["doc"] = b.column("rid").to_numpy()[d], doc.fill_null(0).to_numpy()[d]
            out["none"] = doc.is_null().to_numpy(zero_copy_only=False)[d]
            yield _blobs((ah % np.uint64(n_parts)).astype(np.int64), {"runs": out})

    return run


_FOUND = "request boolean, ah long, rid long, doc_id long, s int, e int, source_doc_id long"


def _docs(doc: np.ndarray, none: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=none.astype(bool))


def _found(request: bool, r: np.ndarray, src: np.ndarray):
    for k in range(0, len(r), 50_000):
        x, y = r[k : k + 50_000], src[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), request)), pa.array(np.ascontiguousarray(x["ah"]).view(np.int64)), pa.array(np.ascontiguousarray(x["rid"])), _docs(x["doc"], x["none"]), pa.array(np.ascontiguousarray(x["s"])), pa.array(np.ascontiguousarray(x["e"])), _docs(y["doc"], y["none"])], [c.split()[0] for c in _FOUND.split(", ")])


def _meet_runs(batches):
    blobs = [np.frombuffer(x, RUN) for b in batches for x in b.column("runs").to_pylist()]
    if not blobs:
        return
    r = np.concatenate(blobs)
    del blobs
    r = r[np.argsort(r["ah"], kind="stable")]
    same = r["ah"][1:] == r["ah"][:-1]
    r = r[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(r):
        return
    r = r[np.lexsort((r["s"], r["rid"], r["doc"], r["none"], r["fh"], r["ah"]))]
    head = np.concatenate([[True], (r["fh"][1:] != r["fh"][:-1]) | (r["ah"][1:] != r["ah"][:-1])])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    yield from _found(False, r[~head], r[first[~head]])
    h = r[head]
    same = h["ah"][1:] == h["ah"][:-1]
    mixed = h[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    yield from _found(True, mixed, mixed)


def _emit_fragments(n_parts: int):
    def run(batches):
        known = WordHash()
        for b in slices(batches, limit=4 << 20):
            heads, bodies = [], []
            for text, rid, doc, wanted in zip(*(b.column(c).to_pylist() for c in ("text", "rid", "doc_id", "wanted"))):
                w = known.of(text.split()).astype(np.uint32)
                for x in wanted:
                    heads.append((x["ah"] % 2**64, rid, doc or 0, doc is None, x["s"], x["e"]))
                    bodies.append(w[x["s"] : x["e"]].tobytes())
            h = np.array(heads, HEAD)
            to = (h["ah"] % np.uint64(n_parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
            ends = [*first[1:].tolist(), len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order[first]].astype(np.int32)), pa.array([h[order[i:j]].tobytes() for i, j in zip(first, ends)], pa.binary()), pa.array([b"".join(bodies[k] for k in order[i:j]) for i, j in zip(first, ends)], pa.binary())], ["to", "heads", "words"])

    return run


def suffix_ranks(x: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first ``depth`` symbols at least (prefix doubling)."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    h = 1
    while h < depth:
        after = np.zeros(len(rank), np.int64)
        after[: len(rank) - h] = rank[h:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        h *= 2
    return rank


def longest_previous_factors(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LPF and its source for suffixes in suffix order.

    ``position`` is each suffix's place in the text, ``lcp[i]`` what suffixes i - 1
    and i share. The nearest smaller position before and after each suffix, with
    the least lcp on the way, are the two candidates.
    """
    n = len(position)
    best, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    place = position.tolist()
    for seq, shared in ((range(n), lcp.tolist()), (range(n - 1, -1, -1), [*lcp[1:].tolist(), 0])):
        stack: list[tuple[int, int]] = []  # (suffix, least lcp down to the one below it)
        for i in seq:
            low = shared[i]
            while stack and place[stack[-1][0]] > place[i]:
                low = min(low, stack.pop()[1])
            if stack and low > best[i]:
                best[i], source[i] = low, stack[-1][0]
            stack.append((i, low))
    return best, source


def _meet_fragments(length: int):
    def run(batches):
        heads, words = [], []
        for b in batches:
            heads += [np.frombuffer(x, HEAD) for x in b.column("heads").to_pylist()]
            words += [np.frombuffer(x, np.uint32) for x in b.column("words").to_pylist()]
        if not heads:
            return
        h, w = np.concatenate(heads), np.concatenate(words).astype(np.int64)
        del heads, words
        size = (h["e"] - h["s"]).astype(np.int64)
        begin = np.cumsum(size) - size
        n = len(h)
        x = np.empty(len(w) + n, np.int64)  # each fragment ends in a symbol of its own
        ends = begin + np.arange(n) + size
        own = np.ones(len(x), bool)
        own[ends] = False
        x[own], x[ends] = w, 2**32 + np.arange(n)
        begin = begin + np.arange(n)
        rank = suffix_ranks(x, int(size.max()) + 1)
        starts = size - length + 1
        owner = np.repeat(np.arange(n), starts)
        inner = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
        at = begin[owner] + inner
        where = h["s"][owner] + inner
        place = np.empty(len(at), np.int64)
        place[np.lexsort((where, h["rid"][owner], h["doc"][owner], h["none"][owner]))] = np.arange(len(at))
        order = np.argsort(rank[at], kind="stable")
        lcp = np.zeros(len(at), np.int64)
        for k in range(1, len(order), 100_000):
            a, b = at[order[k - 1 : k + 99_999]], at[order[k : k + 100_000]]
            a, live, got = a[: len(b)], np.arange(len(b)), np.zeros(len(b), np.int64)
            while len(live):  # both end in symbols of their own, so every comparison ends
                live = live[x[a[live] + got[live]] == x[b[live] + got[live]]]
                got[live] += 1
            lcp[k : k + len(b)] = got
        best, source = longest_previous_factors(place[order], lcp)
        hit = np.flatnonzero(best >= length)
        if not len(hit):
            return
        mine, theirs = order[hit], order[source[hit]]
        out = h[owner[mine]].copy()
        out["s"], out["e"] = where[mine], where[mine] + best[hit]
        src = h[owner[theirs]]
        sort = np.lexsort((out["s"], out["rid"]))
        out, src = out[sort], src[sort]
        far = np.concatenate([[True], (out["rid"][1:] != out["rid"][:-1]) | (out["s"][1:] > out["s"][:-1] + 1)])
        first = np.flatnonzero(far)
        end = np.maximum.reduceat(out["e"], first)
        out, src = out[first], src[first]
        out["e"] = end
        yield from _found(False, out, src)

    return run


def _merged(batches):
    """Disjoint spans of each document, in order."""
    for b in batches:
        rows = []
        for rid, doc, spans in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "spans"))):
            done: list[list] = []
            for s in sorted(spans, key=lambda s: (s["s"], -s["e"])):
                if done and s["s"] <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], s["e"])
                else:
                    done.append([s["s"], s["e"], s["source_doc_id"]])
            rows += [(rid, doc, *d) for d in done]
        c = list(zip(*rows))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int64())], ["rid", "doc_id", "start_word", "end_word", "source_doc_id"])


def _spans(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int) -> DataFrame:
    n_parts = partitions(docs.sparkSession)
    placed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    runs = placed.mapInArrow(_emit_runs(n_parts, length, gram), "to int, runs binary").repartition(n_parts, "to")
    found = materialize(runs.mapInArrow(_meet_runs, _FOUND), "found")
    wanted = found.where("request").groupBy(F.col("rid").alias("want")).agg(F.collect_list(F.struct("ah", "s", "e")).alias("wanted"))
    texts = placed.join(wanted.hint("shuffle_hash"), F.col("rid") == F.col("want")).select("rid", "doc_id", "text", "wanted")
    blobs = texts.mapInArrow(_emit_fragments(n_parts), "to int, heads binary, words binary").repartition(n_parts, "to")
    partial = blobs.mapInArrow(_meet_fragments(length), _FOUND)
    spans = found.where("NOT request").unionByName(partial)
    each = spans.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("s", "e", "source_doc_id")).alias("spans"))
    return each.mapInArrow(_merged, "rid long, doc_id long, start_word int, end_word int, source_doc_id long")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id): spans of words that are later copies of at least ``length`` words."""
    return _spans(docs, "doc_id", "text", length, gram).drop("rid")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """All documents, all columns; the texts of those with later copies are the words that are left, joined by spaces."""
    gone = _spans(docs, "doc_id", text_col, length, gram).groupBy(F.col("rid").alias("__loamsift_cut")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__loamsift_spans"))
    marked = docs.withColumn("__loamsift_rid", F.monotonically_increasing_id())

    @F.pandas_udf("string")
    def cut(texts, spans):
        out = []
        for t, s in zip(texts, spans):
            if t is not None and s is not None:
                w = t.split()
                for x in sorted(s, key=lambda x: -x["start_word"]):
                    del w[x["start_word"] : x["end_word"]]
                t = " ".join(w)
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype="object")

    joined = marked.join(gone.hint("shuffle_hash"), F.col("__loamsift_rid") == F.col("__loamsift_cut"), "left")
    text = F.when(F.col("__loamsift_spans").isNull(), F.col(q(text_col))).otherwise(cut(F.col(q(text_col)), F.col("__loamsift_spans")))
    return joined.withColumn(text_col, text).select(*(F.col(q(c)) for c in docs.columns))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
