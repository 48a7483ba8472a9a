"""Related-document packing along paths of a nearest-neighbour graph.

The features of a document are its runs of ``GRAM`` words, all of them. The
similarity of two documents is the number of different runs that both have,
and each document keeps its K most similar; of equals the next in place, so
that copies form a ring and no star.

Documents meet in a shuffle on the hashes of their runs. Runs with the same
documents are one list with a weight. Documents lie in blocks, near copies
side by side; a list is sent once to each block that has
members of it, and a block's similarities are a product of two incidence
matrices, of which K a document leave the task; in it lists with more than
``LONG`` members count by classes of documents with the same such lists, for
they weigh little and most have nearer ones. There are as many blocks as
documents fill, however many partitions a shuffle has. Lists that lie so wide
that members times blocks pass ``SPREAD`` bring no pairs to a block: documents
with the same wide lists are one class, and classes are multiplied in place of
documents. What wide lists add to pairs that other lists have is counted in the
blocks, to which they are sent compressed, and which keep of them only the
documents they have from other lists. Both ways are exact.

Paths are walked within what best neighbours connect: each starts at the
unvisited document of least degree and goes to the nearest unvisited
neighbour. Then path ends are linked by the neighbour edges that are left, the
most similar first, in rounds in which every chain of paths takes its best
edge. The chains are cut into windows of ``WINDOW`` words.

Defined results: null and empty texts and those without words are in no
window; documents without neighbours are paths of one; longer documents than a
window go on in the next; repeated rows are packed as often as they occur;
ids may be null; an empty table gives an empty result; other columns are
ignored. Lengths are words without white space. ``docs`` is read twice if
texts are asked for, and then has to give the same rows in the same places,
as tables of files do.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamsift.functions.words import spans
from loamsift.llm.common import Powers, mix, partitions, q, slices, table, word_hashes
from loamsift.llm.repeats import _blobs, prefix_hashes, span_hash
from loamsift.operators.components import connected_components
from loamsift.session import materialize, release

GRAM = 5
K = 4
WINDOW = 1024
WINDOWS_A_BUCKET = 256
BLOCK = 1 << 14  # documents of one product
SPREAD = 1 << 17  # members times blocks up to which a list is sent to its blocks
LONG = 1024  # members from which a list is multiplied by classes of documents
SENT, LEAST = 1 << 10, 256 << 20  # bytes a document of lists sent to blocks at a time, and how many are always
PACKED = 64  # members from which a list is compressed before it is sent
CELLS = 1 << 21  # of a similarity matrix held at a time
HOT = 1 << 16  # documents of a run beyond which no task holds them together
HELD = 1 << 23  # (hash, document) pairs of a task after which it looks for hot runs
CLUSTER = 50_000  # documents of one walk
PATHS = 1024  # of a chain that stay together
EDGES = 2_000_000  # edges between path ends that one task links


def _grams(sizes: np.ndarray, h: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of GRAM words; shorter documents are one run."""
    starts = np.maximum(sizes - GRAM + 1, np.minimum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), starts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + (np.cumsum(sizes) - sizes)[owner]
    return owner, mix(span_hash(prefix_hashes(h, powers), at, at + np.minimum(GRAM, sizes[owner]), powers))


def _cut(h: np.ndarray) -> np.ndarray:
    """The low 48 bits as six bytes each; with the partition, which a hash also gives, these tell runs apart."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _whole(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


_SENT = "to int, hashes binary, rids binary, rid array<long>, doc_id array<long>, length array<long>"
_FEATURES = ("rid", "doc_id", "length")


def _scan(n_parts: int):
    """One pass over the texts: the hashes for each partition as bytes, and (rid, doc_id, length) beside them."""
    small = _small(n_parts)

    def run(batches):
        powers, held = Powers(), []

        def flush():
            h, rid = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            out = _blobs((h % np.uint64(n_parts)).astype(small), {"hashes": _cut(h // np.uint64(n_parts)), "rids": rid})
            none = pa.nulls(out.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, *[none] * 3], ["to", "hashes", "rids", *_FEATURES])
            rows = [pa.concat_arrays([x[2][k] for x in held]) for k in range(3)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), r) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([int(rid[0]) % n_parts], pa.int32()), *[pa.nulls(1, pa.binary())] * 2, *lists], ["to", "hashes", "rids", *_FEATURES])
            held.clear()

        for b in slices(batches, limit=1 << 20):
            h, sizes = word_hashes(b.column("text"), powers)
            if not len(h):
                continue
            owner, grams = _grams(sizes, h, powers)
            full = pa.array(np.flatnonzero(sizes))
            held.append((grams, b.column("rid").to_numpy()[owner], (b.column("rid").take(full), b.column("doc_id").take(full), pa.array(sizes[sizes > 0]))))
            if sum(len(x[0]) for x in held) >= min(4_000_000, 2000 * n_parts):
                yield from flush()
        if held:
            yield from flush()

    return run


_MET = "members binary, weight long, gram long, rid long, doc_id long, length long"


def _met(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    kinds = [(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _MET.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds], [c for c, _ in kinds])


def _shared(h: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs sorted by hash: (hash, document) of the hashes with several documents, in order and each once, and where a hash begins."""
    for again in (False, True):
        if again:
            order = np.lexsort((rid, h))
            h, rid = h[order], rid[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])])[: len(h)]
            h, rid = h[new], rid[new]
        same = h[1:] == h[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(h) > 1 else np.zeros(len(h), bool)
        h, rid = h[keep], rid[keep]
    return h, rid, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def _lists(hot: int, most: int):
    """Lists of documents that have runs in common, with the number of these; runs of more than ``hot`` documents in pieces; and features."""

    def run(batches):
        h, rid, count, limit, known = [], [], 0, most, np.zeros(0, np.uint64)

        def take_hot():
            """What is held, sorted by hash, and apart from it what belongs to hot runs."""
            nonlocal known
            a, r = np.concatenate(h), np.concatenate(rid)
            order = np.argsort(a)
            a, r = a[order], r[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            known = np.union1d(known, a[first[np.diff(np.append(first, len(a))) > hot]])
            if not len(known):
                return a, r, a[:0], r[:0]
            out = np.isin(a, known)
            return a[~out], r[~out], a[out], r[out]

        def pieces(a, r):
            order = np.lexsort((r, a))
            a, r = a[order], r[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (r[1:] != r[:-1])])[: len(a)]
            a, r = a[new], r[new]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])).tolist()
            for s, e in zip(first, [*first[1:], len(a)]):
                for k in range(s, e, hot):
                    yield _met(members=pa.array([r[k : min(e, k + hot)].tobytes()], pa.binary()), gram=pa.array([(int(a[s]) * 0x9E3779B97F4A7C15 + TaskContext.get().partitionId() * 0xC2B2AE3D27D4EB4F) % 2**63]))

        for b in batches:
            if len(b.column("rid").flatten()):
                yield _met(**{c: b.column(c).flatten() for c in _FEATURES})
            blobs = b.column("hashes").is_valid()
            got = [_whole(x) for x in b.column("hashes").filter(blobs).to_pylist()]
            h += got
            rid += [np.frombuffer(x, np.int64) for x in b.column("rids").filter(blobs).to_pylist()]
            count += sum(map(len, got))
            if count > limit:
                a, r, x, y = take_hot()
                h[:], rid[:], count = [a], [r], len(a)
                limit = max(most, 2 * count)
                if len(x):
                    yield from pieces(x, y)
        if not count:
            return
        a, r, x, y = take_hot()
        del h, rid
        if len(x):
            yield from pieces(x, y)
        _, r, first = _shared(a, r)
        data, cuts = r.tobytes(), [*(first * 8).tolist(), 8 * len(r)]
        weights = Counter(data[x:y] for x, y in zip(cuts, cuts[1:]))
        names = list(weights)
        for k in range(0, len(names), 10_000):
            yield _met(members=pa.array(names[k : k + 10_000], pa.binary()), weight=pa.array([weights[x] for x in names[k : k + 10_000]], pa.int64()))

    return run


def _placed(batches):
    """(rid, block): blocks of BLOCK rows of a sorted partition."""
    n, base = 0, TaskContext.get().partitionId() << 32
    for b in batches:
        at = np.arange(n, n + b.num_rows)
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base + at // BLOCK)], ["id", "block"])


def _members(batches):
    """A row for each member of a list, with the list's other columns."""
    for b in batches:
        members = b.column("members").to_pylist()
        for k in range(0, len(members), 2000):
            part = members[k : k + 2000]
            of = pa.array(np.repeat(np.arange(k, k + len(part)), [len(x) // 8 for x in part]))
            rest = [c for c in b.schema.names if c != "members"]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in rest), pa.array(np.frombuffer(b"".join(part), np.int64))], [*rest, "id"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] numbers, then so for the next."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def _classes(of: np.ndarray, code: np.ndarray, sizes: np.ndarray, n: int, exact: type, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists that are long, class of each of n documents, which long lists a class has): documents with the same long lists are one class. Long is what has more than ``long`` members, or twice as many and so on until the classes fit."""
    while True:
        far = sizes > long
        at = far[of]
        h = np.zeros(n, np.uint64)
        np.add.at(h, code[at], mix(of[at].astype(np.uint64) + np.uint64(1)))
        _, one, kind = np.unique(h, return_index=True, return_inverse=True)
        if len(one) * max(256, int(far.sum())) <= 8 * CELLS or not at.any():
            break
        long *= 2
    first = np.zeros(n, bool)
    first[one] = True
    at &= first[code]
    has = np.zeros((len(one), int(far.sum())), exact)
    has[kind[code[at]], (np.cumsum(far) - 1)[of[at]]] = 1
    return far, kind, has


def _by_class(a: np.ndarray, kind: np.ndarray, has: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) by long lists alone: for each of the documents the k nearest, of equals the next in the ring."""
    docs, count = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=len(has))
    begin = np.cumsum(count) - count
    a = a[np.argsort(kind[a], kind="stable")]
    own, first = np.unique(kind[a], return_index=True)
    first, out = [*first.tolist(), len(a)], []
    step = max(1, CELLS // len(has))
    for at in range(0, len(own), step):
        both = ((has[own[at : at + step]] * weights) @ has.T).astype(np.int64)
        for x, y, v in zip(first[at:], first[at + 1 :], both):
            most = np.cumsum(np.bincount(v, count)[::-1])[::-1]  # documents as near as this or nearer
            t = max(1, int(np.searchsorted(-most, -(k + 1), "right")) - 1)
            e, h = np.flatnonzero(v == t), np.flatnonzero(v > t)
            even = np.sort(docs[_ranges(begin[e], count[e])])
            nearer, me = docs[_ranges(begin[h], count[h])], a[x:y]
            if len(even):
                turn = (np.searchsorted(even, me, "right")[:, None] + np.arange(min(k + 1, len(even)))) % len(even)
                out.append((np.repeat(me, turn.shape[1]), even[turn].ravel(), np.full(turn.size, t)))
            out.append((np.repeat(me, len(nearer)), np.tile(nearer, len(me)), np.tile(np.repeat(v[h], count[h]), len(me))))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_of_block(rows: np.ndarray, weights: np.ndarray, sizes: np.ndarray, members: np.ndarray, k: int, slab: int = 256, long: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity): for each of the rows its k nearest, where two are as similar as their common lists weigh; of equals the next in order, in a ring.

    Only short lists are multiplied document by document. What long ones add
    to the pairs found so follows from the classes of the two. Other pairs are
    as near as their classes, no nearer than all long lists of a document
    weigh, and are looked for where its k nearest so far don't pass that.
    """
    names, code = np.unique(members, return_inverse=True)
    of = np.repeat(np.arange(len(sizes)), sizes)
    exact = np.float32 if weights.sum() < 2**23 else np.float64
    far, kind, has = _classes(of, code, sizes, len(names), exact, LONG if long is None else long)
    far_weights = weights[far].astype(exact)
    reach = (has @ far_weights).astype(np.int64)[kind]  # what a document has in common with others by long lists at most
    code, sizes, weights = code[~far[of]], sizes[~far], weights[~far]
    of = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes
    row_of = np.full(len(names), -1)
    row_of[np.flatnonzero(np.isin(names, rows))] = 0
    own_code = np.flatnonzero(row_of == 0)
    row_of[own_code] = np.arange(len(own_code))
    mine = np.flatnonzero(row_of[code] >= 0)
    mine = mine[np.argsort(of[mine], kind="stable")]
    side = np.full(len(own_code), -1)  # rows with the same longest list come together
    long_first = mine[np.argsort(sizes[of[mine]], kind="stable")]
    side[row_of[code[long_first]]] = of[long_first]
    turn = np.empty(len(own_code), np.int64)
    turn[np.argsort(side, kind="stable")] = np.arange(len(own_code))
    at_row = np.empty(len(own_code), np.int64)
    at_row[turn] = np.arange(len(own_code))
    place = turn[row_of[code[mine]]]
    order = np.argsort(place, kind="stable")
    mine, place = mine[order], place[order]
    bits = int(weights.max(initial=1)).bit_length()
    out, open_rows = [], []
    at, n = 0, slab
    while at < len(own_code):
        n = min(n, len(own_code) - at)
        x, y = np.searchsorted(place, [at, at + n])
        r, (used, which) = place[x:y] - at, np.unique(of[mine[x:y]], return_inverse=True)
        many_of = sizes[used]
        c = code[_ranges(begin[used], many_of)]
        me = own_code[at_row[at : at + n]]
        seen = np.zeros(len(names), bool)
        seen[c] = True
        seen[me] = True
        cols = np.flatnonzero(seen)
        small = np.cumsum(seen) - 1
        c, first = small[c], np.cumsum(many_of) - many_of
        own = small[me]
        work, cells = int(many_of[which].sum()), n * len(cols)
        if n > 1 and (work if cells > 8 * work else cells) > CELLS:
            n = max(1, n // 2)
            continue
        (left_kinds, kind_i), (right_kinds, kind_j) = (np.unique(kind[d], return_inverse=True) for d in (me, cols))
        common = (has[left_kinds] * far_weights) @ has[right_kinds].T
        if cells > 8 * work:  # few of the pairs have anything in common
            many = many_of[which]
            key = np.repeat(r, many) * len(cols) + c[_ranges(first[which], many)]
            key = np.sort(key << bits | np.repeat(weights[used][which], many))  # numbers are sorted several times faster than their places
            v, key = key & ((1 << bits) - 1), key >> bits
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            v, (i, j) = np.add.reduceat(v, new) if len(new) else v, np.divmod(key[new], len(cols))
            other = j != own[i]
            i, j, v = i[other], j[other], v[other]
            v += common[kind_i[i], kind_j[j]].astype(np.int64)
            top = int(v.max(initial=0)) + 1
            key = np.sort((i * top + top - 1 - v) * len(cols) + (j - own[i] - 1) % len(cols))
            i, key = np.divmod(key, top * len(cols))
            keep = np.arange(len(i)) - np.searchsorted(i, np.arange(n))[i] < k
            i, (v, j) = i[keep], np.divmod(key[keep], len(cols))
            v, j = top - 1 - v, (j + own[i] + 1) % len(cols)
        else:
            s = np.zeros((n, len(cols)), exact)
            if cells * len(used) < 50 * work:
                for k0 in range(0, len(used), 256):
                    some = (which >= k0) & (which < k0 + 256)
                    left, right = np.zeros((n, min(256, len(used) - k0)), exact), np.zeros((min(256, len(used) - k0), len(cols)), exact)
                    left[r[some], which[some] - k0] = weights[used[which[some]]]
                    many = many_of[k0 : k0 + 256]
                    right[np.repeat(np.arange(len(many)), many), c[_ranges(first[k0 : k0 + 256], many)]] = 1
                    s += left @ right
            else:
                step = np.concatenate([[0], np.cumsum(many_of[which])])
                k0 = 0
                while k0 < len(which):
                    k1 = max(k0 + 1, int(np.searchsorted(step, step[k0] + 4_000_000, "right")) - 1)
                    many = many_of[which[k0:k1]]
                    key = np.repeat(r[k0:k1] * len(cols), many) + c[_ranges(first[which[k0:k1]], many)]
                    r0, r1 = int(r[k0]), int(r[k1 - 1]) + 1
                    part = np.bincount(key - r0 * len(cols), np.repeat(weights[used[which[k0:k1]]], many), (r1 - r0) * len(cols))
                    s[r0:r1] += part.reshape(r1 - r0, -1).astype(exact)
                    k0 = k1
            if common.any():
                s += common[kind_i][:, kind_j]
            s[np.arange(n), own] = 0
            less = np.linspace(0.5, 0.0, len(cols), endpoint=False)  # of equals the next in the ring
            turns = np.lib.stride_tricks.sliding_window_view(np.concatenate([less, less]), len(cols))
            best = np.argpartition(s + turns[len(cols) - 1 - own], -min(k, len(cols)), axis=1)[:, -k:]
            i, j = np.repeat(np.arange(n), best.shape[1]), best.ravel()
            v = s[i, j].astype(np.int64)
            i, j, v = i[v > 0], j[v > 0], v[v > 0]
        out.append((me[i], cols[j], v))
        past = np.bincount(i[v > reach[me[i]]], minlength=n)
        open_rows.append(me[(past < k) & (reach[me] > 0)])
        at, n = at + n, min(slab, 2 * n) if 2 * max(work, cells) <= CELLS else n
    if not out:
        return (np.zeros(0, np.int64),) * 3
    a, b, s = (np.concatenate(c) for c in zip(*out))
    rest = np.concatenate(open_rows)
    if len(rest):
        redo = np.zeros(len(names), bool)
        redo[rest] = True
        redo = redo[a]
        x, y, z = (np.concatenate([p[redo], f]) for p, f in zip((a, b, s), _by_class(rest, kind, has, far_weights, k)))
        order = np.lexsort((-z, y, x))
        x, y, z = x[order], y[order], z[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) & (x != y)
        x, y, z = x[new], y[new], z[new]
        order = np.lexsort(((y - x - 1) % len(names), -z, x))
        x, y, z = x[order], y[order], z[order]
        keep = np.arange(len(x)) - np.searchsorted(x, x) < k
        a, b, s = (np.concatenate([p[~redo], f[keep]]) for p, f in zip((a, b, s), (x, y, z)))
    return names[a], names[b], s


def _packed(batches):
    """The column ``members`` (array<long> or binary) as compressed bytes of its differences."""
    for b in batches:
        members = b.column("members")
        if pa.types.is_binary(members.type):
            each = (np.frombuffer(x, np.int64) for x in members.to_pylist())
        else:
            each = np.split(members.flatten().to_numpy(), np.cumsum(members.value_lengths().to_numpy())[:-1])
        rest = [c for c in b.schema.names if c != "members"]
        packed = [zlib.compress(np.diff(x, prepend=np.int64(0)).tobytes(), 1) for x in each] if b.num_rows else []
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(packed, pa.binary())], [*rest, "members"])


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.int64))


def _block_task(k: int):
    """Rows sorted by block and kind: 0 the documents of a block, 1 lists of bytes, 2 packed lists, 3 packed lists that bring no pairs of their own. Lists with one number are one."""

    def run(batches):
        block, rows, no, weight, lists, names = None, [], [], [], [], None

        def flush():
            if lists and rows:
                order = np.argsort(np.array(no), kind="stable")
                n, size = np.array(no)[order], np.array([len(x) for x in lists])[order]
                first = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
                own, weights, members = np.concatenate(rows), np.array(weight)[order][first], np.concatenate([lists[x] for x in order.tolist()])
                lists.clear()
                a, b, s = nearest_of_block(own, weights, np.add.reduceat(size, first), members, k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "similarity"])
            for x in (rows, no, weight, lists):
                x.clear()

        for b in batches:
            own = b.column("block").to_numpy()
            kinds = b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(own)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if own[x] != block:
                    yield from flush()
                    block, names = own[x], None
                part, kind = b.slice(x, y - x), int(kinds[x])
                if kind == 0:
                    rows.append(part.column("id").to_numpy())
                    continue
                if kind == 3 and names is None:
                    names = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
                for n, w, raw in zip(part.column("no").to_pylist(), part.column("weight").to_pylist(), part.column("members")):
                    ids = np.frombuffer(raw.as_buffer(), np.int64) if kind == 1 else _unpacked(raw.as_buffer())
                    if kind == 3:
                        at = np.searchsorted(names, ids)
                        ids = ids[names[np.minimum(at, len(names) - 1)] == ids] if len(names) else ids[:0]
                    if len(ids):
                        no.append(n), weight.append(w), lists.append(ids)
        yield from flush()

    return run


_TO_BLOCKS = "kind int, no long, weight long, blocks array<long>, members binary"


def _to_blocks(lists: DataFrame, kind: int) -> tuple[int, DataFrame]:
    """The lists of a kind, once for each of their blocks."""
    return kind, lists.where(F.col("kind") == kind).select(F.explode("blocks").alias("block"), "no", "weight", "members")


def _multiply(placed: DataFrame, parts: list[tuple[int, DataFrame]], k: int) -> DataFrame:
    """The k nearest (a, b, similarity) of everything in ``placed`` (id, block) by the lists (block, no, weight, members) of each kind sent to its blocks.

    What is sent is members times blocks, which grows faster than documents.
    If it is more than ``SENT`` bytes a document, blocks take turns, and the
    shuffle files of a turn go before the next.
    """
    spark = placed.sparkSession
    bytes_of = [p.agg(F.coalesce(F.sum(F.octet_length("members")), F.lit(0))).first()[0] for _, p in parts]
    n_rows, n_blocks = placed.agg(F.count("*"), F.count_distinct("block")).first()
    turns = max(1, min(n_blocks, math.ceil(sum(bytes_of) / max(LEAST, SENT * n_rows))))
    n = partitions(spark) if turns == 1 else min(partitions(spark), math.ceil(n_blocks / turns))
    number = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("no", "long"), ("weight", "long"), ("id", "long"), ("members", "binary"))}

    def turn(t: int) -> DataFrame:
        own = (number % turns) == t
        rows = placed.where(own).select("block", F.lit(0).alias("kind"), empty["no"], empty["weight"], "id", empty["members"])
        for kind, p in parts:
            rows = rows.unionByName(p.where(own).select("block", F.lit(kind).alias("kind"), "no", "weight", empty["id"], "members"))
        to = (F.floor(number / turns) % n).cast("int")  # one after the other, so that none gets many
        return rows.repartitionById(n, to).sortWithinPartitions("block", "kind").mapInArrow(_block_task(k), "a long, b long, similarity long")

    if turns == 1:
        return turn(0)
    return functools.reduce(DataFrame.union, [materialize(turn(t), f"turn{t}") for t in range(turns)])


def _blocks(ids: DataFrame, by: str) -> DataFrame:
    """(id, block) of a table with ids, those with like values of ``by`` side by side; as many blocks as they fill, for each is sent what it needs of all others."""
    ids = materialize(ids.select("id", by), "ids")
    spark = ids.sparkSession
    n = max(min(partitions(spark), spark.sparkContext.defaultParallelism), math.ceil(ids.count() / (0.8 * BLOCK)))
    out = materialize(ids.repartitionByRange(n, by, "id").sortWithinPartitions(by, "id").mapInArrow(_placed, "id long, block long"), "blocks")
    release(ids)
    return out


def _small(n_parts: int) -> type:
    return np.uint16 if n_parts <= 1 << 16 else np.int64


_TO_DOCUMENTS = "to int, id binary, no binary, weight binary, size binary"


def _to_documents(n_parts: int):
    """The members of lists for each partition of documents, as bytes."""

    def run(batches):
        for b in batches:
            members = b.column("members").to_pylist()
            no, weight = (b.column(c).to_numpy() for c in ("no", "weight"))
            size = np.array([len(x) // 8 for x in members], np.int64)
            ends = np.cumsum(size)
            at = 0
            while at < len(members):
                to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + 500_000, "right")))
                ids, n = np.frombuffer(b"".join(members[at:to]), np.int64), size[at:to]
                if len(ids):
                    yield _blobs((ids % n_parts).astype(_small(n_parts)), {"id": ids, "no": np.repeat(no[at:to], n), "weight": np.repeat(weight[at:to], n), "size": np.repeat(n, n)})
                at = to

    return run


def _gathered(batches: list[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray]:
    raw = [b"".join(x for b in batches for x in b.column(c).to_pylist() if x is not None) for c in names]
    return [np.frombuffer(x, np.int64) for x in raw]


def _side_task(batches):
    """(id, side) of the documents of a partition."""
    ids, no, weight, size = _gathered(list(batches), ("id", "no", "weight", "size"))
    if not len(ids):
        return
    like = np.floor(np.log(size) / math.log(1.5)).astype(np.int64)
    order = np.lexsort((no, size, like, ids))
    ids, no, weight, size, like = (x[order] for x in (ids, no, weight, size, like))
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (like[1:] != like[:-1])]))
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    runs, ids, no, size = np.add.reduceat(weight, first), ids[first], no[last], size[last]
    order = np.lexsort((no, size, runs, ids))
    ids, no = ids[order], no[order]
    best = np.concatenate([ids[1:] != ids[:-1], [True]])
    yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(no[best])], ["id", "side"])


def _sides(lists: DataFrame) -> DataFrame:
    """(id, side): the list by which each member of any is put beside others.

    Of the lists of a document those of like size (within a half) belong
    together; of the sizes that has most runs the longest list is taken, so
    that near copies agree on it however many longer passages some have.
    """
    n = partitions(lists.sparkSession)
    return lists.select("no", "weight", "members").mapInArrow(_to_documents(n), _TO_DOCUMENTS).repartitionById(n, "to").mapInArrow(_side_task, "id long, side long")


def _blocks_of(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """(no, blocks) of each list, by the (id, block) of its members."""
    n = partitions(lists.sparkSession)

    def placed_to(batches):
        for b in batches:
            if b.num_rows:
                ids, block = (b.column(c).to_numpy() for c in ("id", "block"))
                yield _blobs((ids % n).astype(_small(n)), {"id": ids, "block": block})

    def meet(batches):
        own, lists = [], []
        for b in batches:
            kind = b.column("block").is_valid()
            own.append(b.filter(kind))
            lists.append(b.filter(pa.compute.invert(kind)))
        names, block = _gathered(own, ("id", "block"))
        ids, no = _gathered(lists, ("id", "no"))
        order = np.argsort(names)
        names, block = names[order], block[order]
        if not len(ids):
            return
        pairs = np.stack([no, block[np.searchsorted(names, ids)]])
        pairs = pairs[:, np.lexsort(pairs)]
        no, block = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])]
        yield _blobs((no % n).astype(_small(n)), {"no": no, "block": block})

    def gather(batches):
        no, block = _gathered(list(batches), ("no", "block"))
        order = np.lexsort((block, no))
        no, block = no[order], block[order]
        new = np.concatenate([[True], (no[1:] != no[:-1]) | (block[1:] != block[:-1])])[: len(no)]
        no, block = no[new], block[new]
        first = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]])[: len(no)])
        at = pa.array([*first.tolist(), len(no)], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(no[first]), pa.ListArray.from_arrays(at, pa.array(block))], ["no", "blocks"])

    none = F.lit(None).cast("binary")
    members = lists.select("no", "weight", "members").mapInArrow(_to_documents(n), _TO_DOCUMENTS).select("to", "id", "no", none.alias("block"))
    rows = members.unionByName(placed.select("id", "block").mapInArrow(placed_to, "to int, id binary, block binary").select("to", "id", none.alias("no"), "block"))
    met = rows.repartitionById(n, "to").mapInArrow(meet, "to int, no binary, block binary")
    return met.repartitionById(n, "to").mapInArrow(gather, "no long, blocks array<long>")


def _ring(k: int):
    """(a, b, similarity): each document of a class with the k that come after it, around the class's end."""

    def run(batches):
        g, ids, w = (np.concatenate(x) for x in zip(*[[b.column(c).to_numpy() for c in ("g", "id", "total")] for b in batches] or [[np.zeros(0, np.int64)] * 3]))
        if not len(g):
            return
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff([*first, len(g)])
        base, n = np.repeat(first, size), np.repeat(size, size)
        at = np.arange(len(g))
        for d in range(1, k + 1):
            ok = n > d
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (ids, ids[base + (at - base + d) % n], w)], ["a", "b", "similarity"])

    return run


def _wide(wide: DataFrame, k: int) -> DataFrame:
    """Of the members (no, weight, id) of wide lists: (a, b, similarity), the k nearest by wide lists alone."""
    n_parts = partitions(wide.sparkSession)
    held = wide.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("no", "weight"))).alias("held"))
    total = F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + x["weight"])
    held = materialize(held.select("id", F.xxhash64("held").alias("g"), total.alias("total"), "held"), "held")
    classes = held.groupBy("g").agg(F.first("held").alias("held"), F.first("total").alias("total"))
    each = materialize(classes.select(F.col("g").alias("id"), "total", F.col("held")[0]["no"].alias("first"), F.explode("held").alias("x")).select("id", "total", "first", "x.no", "x.weight"), "classes")
    few = held.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") <= k).select(F.col("g").alias("id"))  # others have k in their own class, and none nearer
    placed = _blocks(each.join(few, "id", "left_semi").groupBy("id").agg(F.first("first").alias("first")), "first")
    where = each.join(placed, "id").groupBy("no").agg(F.collect_set("block").alias("blocks"))
    n_pieces = math.ceil(max(1, held.select("g").distinct().count()) / HOT)
    pieces = each.groupBy("no", F.pmod(F.xxhash64("id"), F.lit(n_pieces)).alias("piece")).agg(F.first("weight").alias("weight"), F.sort_array(F.collect_list("id")).alias("members"))
    pieces = pieces.join(where, "no").select(F.lit(2).alias("kind"), "no", "weight", "blocks", "members").mapInArrow(_packed, _TO_BLOCKS)
    near = _multiply(placed, [_to_blocks(materialize(pieces, "pieces"), 2)], k + 1)
    own = each.groupBy("id").agg(F.first("total").alias("similarity")).select(F.col("id").alias("a"), F.col("id").alias("b"), "similarity")
    heads = held.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("n")).where(F.col("n") <= k + 1)
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "id")
    near = near.unionByName(own).join(heads, F.col("b") == F.col("g")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    far = held.select(F.col("id").alias("me"), "g").join(near.select("a", "id", "similarity"), F.col("a") == F.col("g")).where("me <> id").select(F.col("me").alias("a"), F.col("id").alias("b"), "similarity")
    ring = held.select("g", "id", "total").repartitionByRange(n_parts, "g", "id").sortWithinPartitions("g", "id").mapInArrow(_ring(k), "a long, b long, similarity long")
    return far.unionByName(ring)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lists and features of the documents with words, written."""
    n_parts = partitions(docs.sparkSession)
    placed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    return materialize(placed.mapInArrow(_scan(n_parts), _SENT).repartitionById(n_parts, "to").mapInArrow(_lists(HOT, HELD), _MET), "met")


def neighbours(met: DataFrame, k: int = K) -> DataFrame:
    """(a, b, similarity, rank): the k most similar documents of each that shares a run with any."""
    folded = met.where("members IS NOT NULL AND gram IS NULL").groupBy("members").agg(F.sum("weight").alias("weight"))
    lists = materialize(folded.select(F.monotonically_increasing_id().alias("no"), "weight", "members"), "lists")
    placed = _blocks(_sides(lists), "side")
    sent = materialize(lists.join(_blocks_of(lists, placed), "no").withColumn("n", F.octet_length("members") / F.lit(8)), "sent")
    release(lists)
    narrow = F.col("n") * F.size("blocks") <= SPREAD
    short = sent.where(narrow)
    wide = sent.where(~narrow).select("no", "weight", "members", "blocks")
    hot = met.where("gram IS NOT NULL").select("gram", "members")
    if not hot.isEmpty():
        names = hot.mapInArrow(_members, "gram long, id long").groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s"))
        names = names.where("n > 1").groupBy(F.xxhash64("n", "s").alias("no")).agg(F.count("*").alias("weight"), F.min("gram").alias("gram"))
        pieces = hot.join(names, "gram").select("no", "weight", "members")
        where = pieces.select("no", "members").mapInArrow(_members, "no long, id long").join(placed, "id").groupBy("no").agg(F.collect_set("block").alias("blocks"))
        wide = wide.unionByName(pieces.join(where, "no", "left"))
    def columns(kind: int, lists: DataFrame) -> DataFrame:
        return lists.select(F.lit(kind).alias("kind"), "no", "weight", "blocks", "members")

    parts = columns(1, short.where(F.col("n") < PACKED)).unionByName(columns(2, short.where(F.col("n") >= PACKED)).mapInArrow(_packed, _TO_BLOCKS))
    far = None
    wide = materialize(wide, "wide")
    if not wide.isEmpty():
        far = materialize(_wide(wide.select("no", "weight", "members").mapInArrow(_members, "no long, weight long, id long"), k), "far")
        parts = parts.unionByName(columns(3, wide.where("blocks IS NOT NULL")).mapInArrow(_packed, _TO_BLOCKS))
    parts = materialize(parts, "parts")
    release(sent, wide)
    near = _multiply(placed, [_to_blocks(parts, kind) for kind in (1, 2, 3)[: 2 if far is None else 3]], k)
    if far is not None:
        near = near.unionByName(far).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), F.col("b") < F.col("a"), "b")
    near = materialize(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "neighbours")
    release(parts, placed)
    return near


def walk(nodes: dict[int, list[tuple[int, int]]]) -> list[list[int]]:
    """Greedy paths over all nodes: each starts at the least degree and goes to the nearest unvisited neighbour."""
    heap = [(len(n), i) for i, n in nodes.items()]
    heapq.heapify(heap)
    seen, paths = set(), []
    while heap:
        _, at = heapq.heappop(heap)
        if at in seen:
            continue
        path = []
        while at is not None:
            seen.add(at)
            path.append(at)
            near = [(-s, len(nodes[b]), b) for b, s in nodes[at] if b in nodes and b not in seen]
            at = min(near)[2] if near else None
        paths.append(path)
    return paths


_WALKED = "rid long, path long, pos int, n int, degree int"


def _walk_clusters(batches):
    """Rows sorted by cluster: the path and the place in it of every document."""
    cluster, nodes, own = None, {}, {}

    def flush():
        for r in list(nodes):  # an edge leads both ways
            for b, s in nodes[r][: own[r]]:
                if b in nodes and (r, s) not in nodes[b]:
                    nodes[b].append((r, s))
        own.clear()
        rows = [(r, p[0], k, len(p), len(nodes[r])) for p in walk(nodes) for k, r in enumerate(p)]
        nodes.clear()
        return rows

    for b in batches:
        out = []
        for c, s, rid, near in zip(*(b.column(x).to_pylist() for x in ("cluster", "sub", "rid", "near"))):
            if (c, s) != cluster:
                out += flush()
                cluster = (c, s)
            nodes[rid] = [(x["b"], x["similarity"]) for x in near or ()]
            own[rid] = len(nodes[rid])
        if out:
            yield _walked(out)
    yield _walked(flush())


def _walked(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.int64()] * 2 + [pa.int32()] * 3)], [x.split()[0] for x in _WALKED.split(", ")])


def paths(features: DataFrame, near: DataFrame, cluster: int = CLUSTER) -> tuple[DataFrame, DataFrame]:
    """(rid, path, pos, n, degree) of every document, walked within what best neighbours connect; (a, b, similarity), a < b, of all neighbours."""
    parts = connected_components(near.where("rank = 1"), "a", "b")
    edges = materialize(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct(), "graph")
    lists = near.groupBy("a").agg(F.collect_list(F.struct("b", "similarity")).alias("near"))
    large = parts.groupBy("component").count().where(F.col("count") > cluster)
    piece = F.when(F.col("count").isNotNull(), F.pmod(F.xxhash64(F.shiftright("rid", 10)), F.ceil(F.col("count") / cluster))).otherwise(F.lit(0))
    placed = features.select("rid").join(parts, F.col("rid") == F.col("id"), "left").join(large, "component", "left").join(lists, F.col("rid") == F.col("a"), "left")
    rows = placed.select(F.coalesce("component", "rid").alias("cluster"), piece.cast("long").alias("sub"), "rid", "near")
    n = partitions(features.sparkSession)
    return materialize(rows.repartition(n, "cluster", "sub").sortWithinPartitions("cluster", "sub", "rid").mapInArrow(_walk_clusters, _WALKED), "walked"), edges


_LINKED = "chain long, into long, at long, flip boolean"


def link(chains: dict[int, tuple[int, int, int]], edges: list[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
    """(chain, into, at, flip): chains of (head, tail, paths) joined end to end by edges, the first that fit; ``at`` counts paths."""
    of, up, near = {}, {c: c for c in chains}, {}
    for c, (head, tail, _) in chains.items():
        of[head] = of[tail] = c

    def root(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    for a, b in edges:
        x, y = of.get(a), of.get(b)
        if x is None or y is None or root(x) == root(y):
            continue
        ends = [near.setdefault(c, [None, None]) for c in (x, y)]  # what follows the head, and the tail
        at = [next((k for k in (1, 0) if chains[c][k] == e and n[k] is None), None) for c, e, n in ((x, a, ends[0]), (y, b, ends[1]))]
        if None in at:
            continue
        ends[0][at[0]], ends[1][at[1]] = (y, at[1]), (x, at[0])
        up[root(y)] = root(x)
    out, done = [], set()
    for c in sorted(chains):
        n = near.get(c, [None, None])
        if c in done or (n[0] is not None and n[1] is not None):
            continue
        first, at, came = c, 0, 0 if n[0] is None else 1
        while True:
            done.add(c)
            out.append((c, first, at, came == 1))
            at += chains[c][2]
            after = near.get(c, [None, None])[1 - came]
            if after is None:
                break
            c, came = after
    return out


def _link_task(batches):
    chains, edges = {}, []
    for b in batches:
        for c, head, tail, size, a, e, key in zip(*(b.column(x).to_pylist() for x in ("chain", "head", "tail", "size", "a", "b", "key"))):
            if key is None:
                chains[c] = (head, tail, size)
            else:
                edges.append((-key["similarity"], key["degree"], key["h"], a, e))
    rows = link(chains, [e[-2:] for e in sorted(edges)])
    c = list(zip(*rows)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, [pa.int64()] * 3 + [pa.bool_()])], [x.split()[0] for x in _LINKED.split(", ")])


def chained(walked: DataFrame, edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(path, chain, at, flip): paths linked at their ends by the edges left, by similarity, degree and a hash.

    Each round every chain takes its best edge, and edges that are best for
    both of theirs are linked; that is what going through all edges in order
    gives, as one task does once at most ``most`` are left.
    """
    ends = walked.groupBy("path").agg(F.min_by("rid", "pos").alias("head"), F.max_by("rid", "pos").alias("tail"))
    at_end = walked.where("pos = 0 OR pos = n - 1").select("rid", "path", "degree")
    x, y = (at_end.select(F.col("rid").alias(c), F.col("path").alias(f"p{c}"), F.col("degree").alias(f"d{c}")) for c in "ab")
    key = F.struct((-F.col("similarity")).alias("minus"), (F.col("da") + F.col("db")).alias("degree"), F.xxhash64("a", "b").alias("h"), "a", "b")
    live = materialize(edges.join(x, "a").join(y, "b").where("pa <> pb").select("a", "b", key.alias("key")), "live")
    chains = materialize(ends.select(F.col("path").alias("chain"), "head", "tail", F.lit(1).cast("long").alias("size")), "chains")
    seg = chains.select(F.col("chain").alias("path"), "chain", F.lit(0).cast("long").alias("at"), F.lit(False).alias("flip"))
    while True:
        side = chains.select("chain", "size", F.explode(F.array_distinct(F.array("head", "tail"))).alias("e"))
        a, b = (side.select(F.col("chain").alias(f"c{s}"), F.col("e").alias(s)) for s in "ab")
        now = materialize(live.select("a", "b", "key").join(a, "a").join(b, "b").where("ca <> cb").select("a", "b", "key", "ca", "cb"), "live")
        release(live)
        live, left = now, now.count()
        if left <= most:
            break
        best = live.select(F.explode(F.array("ca", "cb")).alias("c"), "key").groupBy("c").agg(F.min("key").alias("key"))
        won = live.join(best.select(F.col("c").alias("ca"), "key"), ["ca", "key"]).join(best.select(F.col("c").alias("cb"), "key"), ["cb", "key"]).select("ca", "cb", "a", "b")
        one, two = (chains.select(F.col("chain").alias(f"c{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("head", "tail", "size"))) for s in "ab")
        m = won.join(one, "ca").join(two, "cb").withColumn("flip_a", F.expr("a = head_a AND a <> tail_a")).withColumn("flip_b", F.expr("b = tail_b AND b <> head_b"))
        m = materialize(m, "merged")
        moves = m.select(F.col("ca").alias("chain"), F.col("ca").alias("into"), F.lit(0).cast("long").alias("off"), F.col("size_a").alias("size"), F.col("flip_a").alias("turn")).unionByName(m.select(F.col("cb").alias("chain"), F.col("ca").alias("into"), F.col("size_a").alias("off"), F.col("size_b").alias("size"), F.col("flip_b").alias("turn")))
        fresh = m.select(F.col("ca").alias("chain"), F.when(F.col("flip_a"), F.col("tail_a")).otherwise(F.col("head_a")).alias("head"), F.when(F.col("flip_b"), F.col("head_b")).otherwise(F.col("tail_b")).alias("tail"), (F.col("size_a") + F.col("size_b")).alias("size"))
        old, before = chains, seg
        chains = materialize(chains.join(moves, "chain", "left_anti").unionByName(fresh), "chains")
        seg = materialize(_moved(seg, moves), "segments")
        release(old, before, m)
    touched = live.select(F.explode(F.array("ca", "cb")).alias("chain")).distinct()
    rows = chains.join(touched, "chain", "left_semi").select("chain", "head", "tail", "size", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("struct<similarity:long,degree:int,h:long>").alias("key"))
    none = [F.lit(None).cast("long").alias(c) for c in ("chain", "head", "tail", "size")]
    rows = rows.unionByName(live.select(*none, "a", "b", F.struct((-F.col("key.minus")).alias("similarity"), "key.degree", "key.h").alias("key")))
    done = rows.repartition(1).mapInArrow(_link_task, _LINKED)
    moves = done.join(chains.select("chain", "size"), "chain").select("chain", "into", F.col("at").alias("off"), "size", F.col("flip").alias("turn"))
    return _moved(seg, moves)


def _moved(seg: DataFrame, moves: DataFrame) -> DataFrame:
    """Segments after their chains went (into, off, turned) others; those of other chains as they are."""
    at = F.coalesce("off", F.lit(0)) + F.when(F.col("turn"), F.col("size") - 1 - F.col("at")).otherwise(F.col("at"))
    return seg.join(moves, "chain", "left").select("path", F.coalesce("into", "chain").alias("chain"), at.alias("at"), (F.col("flip") != F.coalesce("turn", F.lit(False))).alias("flip"))


SCHEMA = "bucket long, window_no int, n_words long, doc_ids array<long>, starts array<long>, ends array<long>, n_paths int"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int32()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TEXT_SCHEMA = SCHEMA + ", texts array<string>"


class Filler:
    """Cuts a stream of documents into windows."""

    def __init__(self, size: int, texts: bool = False):
        self.size, self.texts, self.rows, self.bucket = size, texts, [], None
        self.reset()

    def reset(self) -> None:
        self.ids, self.starts, self.ends, self.parts, self.used, self.chains = [], [], [], [], 0, set()

    def close(self) -> None:
        if self.ids:
            self.rows.append((self.bucket, self.no, self.used, self.ids, self.starts, self.ends, len(self.chains), self.parts))
            self.no += 1
            self.reset()

    def open(self, bucket: int | None) -> None:
        self.close()
        self.bucket, self.no = bucket, 0

    def add(self, chain: int, doc: int | None, length: int, text: str | None) -> None:
        at, where = 0, None
        while at < length:
            n = min(length - at, self.size - self.used)
            self.ids.append(doc), self.starts.append(at), self.ends.append(at + n), self.chains.add(chain)
            if self.texts:
                if n < length and where is None:
                    raw, first, last, _ = spans(pa.array([text]))
                    where = raw.tobytes(), first, last
                self.parts.append(text if n == length else where[0][where[1][at] : where[2][at + n - 1]].decode("utf-8", "replace"))
            at += n
            self.used += n
            if self.used == self.size:
                self.close()

    def take(self) -> pa.RecordBatch:
        c = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        types, names = ([*_TYPES, pa.list_(pa.string())], [*_NAMES, "texts"]) if self.texts else (_TYPES, _NAMES)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names)


def _fill(window: int, texts: bool):
    def run(batches):
        fill = Filler(window, texts)
        for b in batches if not texts else slices(batches, limit=4 << 20):
            n = b.num_rows
            for bucket, chain, doc, length, text in zip(*(b.column(x).to_pylist() for x in ("bucket", "chain", "doc_id", "length")), b.column("text").to_pylist() if texts else [None] * n):
                if bucket != fill.bucket:
                    fill.open(bucket)
                fill.add(chain, doc, length, text)
            if fill.rows:
                yield fill.take()
        fill.close()
        yield fill.take()

    return run


def pack_related(docs: DataFrame, window: int = WINDOW, k: int = K, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: which words of which documents it holds, in order; with ``texts`` also these words as they stand in the documents."""
    met = scanned(docs, id_col, text_col)
    f = materialize(met.where("rid IS NOT NULL").select("rid", "doc_id", "length"), "features")
    near = neighbours(met, k)
    release(met)
    walked, edges = paths(f, near)
    seg = chained(walked, edges)
    words = f.agg(F.sum("length")).first()[0] or 0
    n_buckets = max(1, words // (window * WINDOWS_A_BUCKET))
    pos = F.when(F.col("flip"), F.col("n") - 1 - F.col("pos")).otherwise(F.col("pos"))
    bucket = F.pmod(F.xxhash64("chain", F.floor(F.col("at") / PATHS)), F.lit(n_buckets))
    rows = f.join(walked, "rid").join(seg, "path").select(bucket.alias("bucket"), "chain", "at", pos.alias("pos"), "rid", "doc_id", "length")
    if texts:
        text = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(q(text_col)).cast("string").alias("text"))
        rows = rows.join(text.hint("shuffle_hash"), "rid")
    return rows.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "chain", "at", "pos").mapInArrow(_fill(window, texts), TEXT_SCHEMA if texts else SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_related(table(spark, sf_dir, "documents"))
