"""Operators that hold documents against each other."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamsift.llm import chat as C
from loamsift.llm import html as H
from loamsift.llm import packing as P
from loamsift.llm import repeats as R
from loamsift.llm import simhash as SH
from loamsift.session import materialize
from tests.llm.test_rowwise import EXTRA, edge_docs, empty


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id")


# repeated passages


def brute_repeats(docs, length):
    """LPF of every position by comparing it with every earlier one."""
    out = set()
    seq = [(i, k) for i, w in docs for k in range(len(w))]
    words = dict(docs)
    for n, (i, k) in enumerate(seq):
        best = 0
        for j, m in seq[:n]:
            c = 0
            while k + c < len(words[i]) and m + c < len(words[j]) and words[i][k + c] == words[j][m + c]:
                c += 1
            best = max(best, c)
        if best >= length:
            out |= {(i, k + c) for c in range(best)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeats_are_brute_force_lpf(spark, seed):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(6 if seed else 300)]
    passages = [[rng.choice(pool) for _ in range(rng.randrange(10, 30))] for _ in range(5)]
    docs = []
    for i in range(24):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            w[rng.randrange(len(w) + 1) : 0] = p
        docs.append((i, w))
    got = set()
    d = frame(spark, [" ".join(w) for _, w in docs])
    for r in R.repeats(d, 10, 3).collect():
        assert r.source_doc_id is not None and r.source_doc_id <= r.doc_id
        got |= {(r.doc_id, k) for k in range(r.start_word, r.end_word)}
    want = brute_repeats(docs, 10)
    assert got == want
    left = {r.doc_id: r.text for r in R.remove_repeats(d, 10, 3).collect()}
    for i, w in docs:
        keep = [x for k, x in enumerate(w) if (i, k) not in want]
        assert left[i].split() == keep


def test_lpf_array():
    x = np.array([ord(c) for c in "abaababaabab"])  # symbols of a text; the last suffixes end in their own sign
    n = len(x)
    text = np.append(x, 1000)
    order = sorted(range(n), key=lambda i: text[i:].tolist())
    common = lambda a, b: next(k for k in range(n + 1) if a + k >= n or b + k >= n or x[a + k] != x[b + k])
    lcp = np.array([0, *(common(a, b) for a, b in zip(order, order[1:]))])
    best, source = R.longest_previous_factors(np.array(order), lcp)
    for rank, p in enumerate(order):
        want = max([common(p, q) for q in range(p)], default=0)
        assert best[rank] == want and (not want or (order[source[rank]] < p and common(p, order[source[rank]]) == want))


def test_hot_passage_and_exact_copies(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(40)) + " " + passage for _ in range(200)] + [passage] * 3
    rows = R.repeats(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} == set(range(1, 203)) and all(r.end_word - r.start_word == 70 and r.source_doc_id < r.doc_id for r in rows)


def test_repeats_edges(spark):
    long = " ".join(f"q{i}" for i in range(60))
    d = edge_docs(spark, long, long)
    rows = R.repeats(d.where("doc_id IS NULL OR doc_id <> 4")).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in rows] == [(101, 0, 60, 100)]
    assert [(r.start_word, r.end_word) for r in R.repeats(d.where("doc_id = 4")).collect()] == [(1, 30_000)]
    out = R.remove_repeats(d)
    assert out.schema.names == d.schema.names and out.count() == d.count()
    assert R.repeats(empty(spark)).count() == 0


# near duplicates


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    common = "the of and to in is that for it as was with be by on".split()
    word = lambda: rng.choice(common) if rng.random() < 0.45 else f"{rng.choice('bcdfg')}{rng.randrange(3000)}"
    texts, group = [], []
    for g in range(n):
        base = [word() for _ in range(rng.randrange(120, 400))]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            w = list(base)
            for k in range(len(w)):
                if rng.random() < 0.02:
                    w[k] = word()
            texts.append(" ".join(w))
            group.append(g)
    return texts, group


def test_groups_hold_against_brute_force(spark):
    texts, _ = near_corpus(4)
    f, _ = SH.fingerprint(texts, SH.Signs())
    close = set()
    for i in range(len(texts)):
        for j in range(i):
            d = [bin((int(a) ^ int(b)) & (2**SH.BITS - 1 if k < SH.TABLES else 2**64 - 1)).count("1") for k, (a, b) in enumerate(zip(f[i], f[j]))]
            if min(d[: SH.TABLES]) <= SH.RADIUS and d[-2] + d[-1] <= SH.RUN_BITS:
                close.add((j, i))
    rows = SH.groups(frame(spark, texts)).collect()
    head = {r.doc_id: r.kept_doc_id for r in rows}
    found = {(i, j) for i, j in close if head.get(i, -1) == head.get(j, -2)}
    assert len(found) == len(close) > 0  # no partner is left out
    parent = {i: i for i in range(len(texts))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in close:
        parent[root(j)] = root(i)
    assert all(root(r.doc_id) == root(r.kept_doc_id) for r in rows)


def test_planted_near_copies_are_found_and_others_left(spark):
    texts, group = near_corpus(5, 120)
    head = {r.doc_id: r.kept_doc_id for r in SH.groups(frame(spark, texts)).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if group[i] == group[j]]
    assert sum(head.get(i, -1) == head.get(j, -2) for i, j in pairs) >= 0.9 * len(pairs)
    assert all(group[i] == group[h] for i, h in head.items())


def test_masks_and_meeting():
    m = SH.masks(2)
    assert len(m) == 1 + SH.BITS + SH.BITS * (SH.BITS - 1) // 2 == len(set(m.tolist())) and max(bin(int(x)).count("1") for x in m) == 2


def test_a_hub_that_verifies_with_none_hides_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (3, 2)).astype(np.uint64)
    sketch = np.concatenate([base[:1], np.repeat(base[1:], 20, axis=0) ^ (np.uint64(1) << rng.integers(0, 63, (40, 2)).astype(np.uint64))])
    edges = SH.spanning_edges(np.arange(41), sketch)
    parent = list(range(41))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(a)] = root(b)
    assert len({root(i) for i in range(41)}) == 3 and len(edges) == 38


def test_near_duplicate_edges(spark):
    d = edge_docs(spark, "a copy of some words here", "a copy of some words here", "alone")
    d = d.union(spark.createDataFrame([(None, "some plain words here", None, 1.0, "x", 7, 7, None, 3, 21)], EXTRA))
    rows = SH.near_duplicates(d).collect()
    assert sorted(((r.doc_id, r.kept_doc_id) for r in rows), key=str) == sorted([(5, 5), (101, 100), (None, None)], key=str)
    out = SH.drop_near_duplicates(d)
    assert out.schema == d.schema and out.count() == d.count() - 3
    assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 5, 6, 100, 102}
    assert SH.near_duplicates(empty(spark)).count() == 0 and SH.drop_near_duplicates(empty(spark)).count() == 0


# packing


def hold_against_all(spark, texts):
    """Neighbours of every document against the number of runs that whole texts share."""
    runs = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in map(str.split, texts)]
    met = P.scanned(frame(spark, texts))
    doc = {r.rid: r.doc_id for r in met.where("rid IS NOT NULL").collect()}
    near = defaultdict(dict)
    for r in P.neighbours(met).collect():
        near[doc[r.a]][doc[r.b]] = r.similarity
    for a, x in enumerate(runs):
        want = sorted((len(x & y) for b, y in enumerate(runs) if b != a and x & y), reverse=True)[: P.K]
        assert sorted(near[a].values(), reverse=True) == want and all(s == len(x & runs[b]) for b, s in near[a].items())


@pytest.mark.parametrize("hot,spread,held", [(1 << 16, 1 << 20, 1 << 23), (1 << 16, 30, 1 << 23), (20, 1 << 20, 1 << 23), (10, 60, 500), (3, 1, 1)])
def test_neighbours_are_those_of_whole_texts(spark, monkeypatch, hot, spread, held):
    for name, value in (("HOT", hot), ("SPREAD", spread), ("HELD", held), ("BLOCK", 16)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(9)
    word = lambda: f"z{rng.randrange(10**6)}"
    texts = []
    for _ in range(30):  # short documents, two of which share a few runs
        own = [word() for _ in range(20)]
        texts += [" ".join(own), " ".join(own[:12] + [word() for _ in range(8)])]
    lines = [" ".join(word() for _ in range(9)) for _ in range(3)]
    for i in range(40):  # unlike documents in long lists, some with a nearer one
        texts.append(" ".join([lines[j] + " " + word() for j in range(3) if i % 7 != j] + [word() for _ in range(30)]))
    texts += [t + " " + word() for t in texts[60:66]] + [texts[70]] * 30 + ["a a a a a a a a", "a a", "a", ""]
    near, _ = near_corpus(6, 12)
    hold_against_all(spark, texts + near + [lines[0] + " " + t for t in near[:9]])


def test_what_is_sent_follows_documents_and_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "SPREAD", 60)
    rng = random.Random(5)
    lines = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(7)) for _ in range(12)]
    texts = [" ".join(f"{x} y{rng.randrange(10**6)}" for x in rng.sample(lines, 4)) + f" {lines[0][:20]} {k // 2}" for k in range(120)]
    sent, multiply = [], P._multiply

    def counted(placed, parts, k):
        tables = [p[-1] if isinstance(p, tuple) else p for p in parts]
        sent.append((placed.select("block").distinct().count(), sum(p.count() for p in tables), sum(p.groupBy("block", "no").count().count() for p in tables)))
        return multiply(placed, parts, k)

    monkeypatch.setattr(P, "_multiply", counted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        hold_against_all(spark, texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sent) == 2 and all(blocks <= spark.sparkContext.defaultParallelism and rows == lists for blocks, rows, lists in sent)


def test_blocks_take_turns_where_much_is_sent(spark, monkeypatch):
    for name, value in (("SPREAD", 60), ("BLOCK", 16), ("SENT", 1), ("LEAST", 1)):
        monkeypatch.setattr(P, name, value)
    rng = random.Random(6)
    lines = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(7)) for _ in range(12)]
    texts = [" ".join(f"{x} y{rng.randrange(10**6)}" for x in rng.sample(lines, 4)) + f" {lines[0][:20]} {k // 2}" for k in range(120)]
    labels, written = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label: labels.append(label) or written(df, label))
    hold_against_all(spark, texts)
    assert sum(x.startswith("turn") for x in labels) > 4


@pytest.mark.parametrize("lists,ids,longest", [(400, 30, 9), (60, 900, 9), (900, 40, 30), (12, 300, 200)])
def test_products_are_the_same_dense_and_sparse(lists, ids, longest):
    rng = np.random.default_rng(2)
    members = [np.sort(rng.choice(ids, rng.integers(2, longest), replace=False)) for _ in range(lists)]
    weights, sizes = rng.integers(1, 9, lists), np.array([len(m) for m in members])
    a, b, s = P.nearest_of_block(np.arange(0, ids, 2), weights, sizes, np.concatenate(members), 3, 50)
    both = np.zeros((ids, ids), int)
    for m, w in zip(members, weights):
        both[np.ix_(m, m)] += w
    np.fill_diagonal(both, 0)
    for i in range(0, ids, 2):
        order = sorted(np.flatnonzero(both[i]), key=lambda j: (-both[i, j], j < i, j))[:3]
        assert set(zip(b[a == i].tolist(), s[a == i].tolist())) == {(j, both[i, j]) for j in order}


@pytest.mark.parametrize("lists,ids,longest,long", [(400, 60, 30, 12), (60, 900, 500, 100), (300, 300, 200, 3), (12, 300, 250, 1), (5, 40, 40, 20)])
def test_products_are_the_same_by_classes_of_long_lists(lists, ids, longest, long):
    rng = np.random.default_rng(4)
    members = [np.sort(rng.choice(ids, rng.integers(2, longest), replace=False)) for _ in range(lists)]
    members = [np.unique(np.concatenate([m, m[m % 3 == 0] + 1])) % ids if len(m) > long else m for m in members]  # some with the same long lists
    members = [np.unique(m) for m in members]
    weights, sizes = rng.integers(1, 4, lists), np.array([len(m) for m in members])
    both = np.zeros((ids, ids), int)
    for m, w in zip(members, weights):
        both[np.ix_(m, m)] += w
    np.fill_diagonal(both, 0)
    rows = np.arange(0, ids, 2)
    a, b, s = P.nearest_of_block(rows, weights, sizes, np.concatenate(members), 3, 50, long)
    place = {i: n for n, i in enumerate(sorted(set(np.concatenate(members).tolist())))}
    for i in rows.tolist():
        order = sorted(np.flatnonzero(both[i]), key=lambda j: (-both[i, j], (place[j] - place[i]) % len(place)))[:3]
        assert sorted(zip(b[a == i].tolist(), s[a == i].tolist())) == sorted((j, both[i, j]) for j in order)


def test_long_lists_are_not_multiplied_by_documents(monkeypatch):
    near = [np.array([2 * k, 2 * k + 1]) for k in range(5000)]
    long = [np.arange(0, 10_000, 1 + k % 3) for k in range(6)]
    members = near + long
    weights, sizes = np.array([9] * 5000 + [1] * 6), np.array([len(m) for m in members])
    met, ranges = [], P._ranges
    monkeypatch.setattr(P, "_ranges", lambda begin, size: met.append(int(size.sum())) or ranges(begin, size))
    a, b, s = P.nearest_of_block(np.arange(2000), weights, sizes, np.concatenate(members), 4)
    assert sum(met) < 10**6 and len(a) == 8000  # by documents 2000 rows times 10 000 and more
    assert {(x, y, z) for x, y, z in zip(a, b, s) if x == y ^ 1} >= {(x, x ^ 1, 9 + sum((x % (1 + k % 3) == 0) and ((x ^ 1) % (1 + k % 3) == 0) for k in range(6))) for x in range(0, 2000, 500)}


def test_links_are_the_same_in_rounds_and_in_one_task(spark):
    rng = random.Random(3)
    walked = [(10 * p + k, 10 * p, k, n, rng.randrange(5)) for p in range(60) for n in [rng.randrange(1, 4)] for k in range(n)]
    ids = [r[0] for r in walked]
    edges = {tuple(sorted(rng.sample(ids, 2))): rng.randrange(1, 6) for _ in range(300)}
    w = spark.createDataFrame(walked, "rid long, path long, pos int, n int, degree int")
    e = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, similarity long")

    def orders(most):
        by = defaultdict(list)
        for r in P.chained(w, e, most).collect():
            by[r.chain].append((r.at, r.path, r.flip))
        out = set()
        for rows in by.values():
            assert sorted(r[0] for r in rows) == list(range(len(rows)))
            line = [d for _, p, flip in sorted(rows) for d in sorted((x for x in ids if x // 10 == p // 10), reverse=flip)]
            out.add(min(tuple(line), tuple(reversed(line))))
        return out

    one = orders(10**6)
    assert one == orders(0) and sum(map(len, one)) == len(ids) and len(one) < 30
    joined = {d for line in one for d in (line[0], line[-1])}
    of = {d: line for line in one for d in line}
    assert not [1 for a, b in edges if a in joined and b in joined and of[a] != of[b]]  # no two ends with an edge are left apart


def test_walk_starts_low_and_goes_near():
    nodes = {1: [(2, 0.9), (3, 0.5), (4, 0.4)], 2: [(1, 0.9), (3, 0.8)], 3: [(2, 0.8), (1, 0.5)], 4: [(1, 0.4)], 5: []}
    assert P.walk(nodes) == [[5], [4, 1, 2, 3]]


def test_windows_hold_every_word_once(spark):
    texts, group = near_corpus(7, 40)
    rows = P.pack_related(frame(spark, texts), window=256).collect()
    got = Counter()
    for r in rows:
        assert r.n_words == sum(e - s for s, e in zip(r.starts, r.ends)) <= 256
        for d, s, e in zip(r.doc_ids, r.starts, r.ends):
            got.update((d, k) for k in range(s, e))
    assert got == Counter((i, k) for i, t in enumerate(texts) for k in range(len(t.split())))
    assert sum(r.n_words < 256 for r in rows) <= len({r.bucket for r in rows})
    stream = [d for r in sorted(rows, key=lambda r: (r.bucket, r.window_no)) for d in r.doc_ids]
    order = [d for k, d in enumerate(stream) if not k or stream[k - 1] != d]
    beside = sum(group[a] == group[b] for a, b in zip(order, order[1:]))
    whole = P.pack_related(frame(spark, texts), window=256, texts=True).collect()
    assert {(r.bucket, r.window_no, tuple(r.doc_ids), tuple(r.starts)) for r in whole} == {(r.bucket, r.window_no, tuple(r.doc_ids), tuple(r.starts)) for r in rows}
    assert all(t.split() == texts[d].split()[s:e] for r in whole for d, s, e, t in zip(r.doc_ids, r.starts, r.ends, r.texts))
    assert beside >= 0.8 * (len(group) - len(set(group)))


def test_packing_edges(spark):
    d = edge_docs(spark)
    got = Counter()
    for r in P.pack_related(d).collect():
        for i, s, e in zip(r.doc_ids, r.starts, r.ends):
            got[i] += e - s
    assert got == {None: 4, 4: 30_000, 5: 4, 6: 4} and P.pack_related(empty(spark)).count() == 0


# html


@pytest.mark.parametrize("seed", range(4))
def test_lcs_is_longest(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a, b = ([rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(0, 150))] for _ in "ab")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        used = H.lcs(a, b)
        assert len(used) == len(set(used)) == t[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in used)  # a common subsequence


def test_lines_and_addresses():
    page = "<html><head><title>T</title></head><body><!-- x <p>gone</p> --><script>var t='</p>';</script><p>One <b>two</b>&amp;\n three<br>four<div class='a>b'>fi ve</div></body>"
    assert H.lines_of(page) == ["One two&", "three", "four", "b'>fi ve"] or H.lines_of(page)[:3] == ["One two&", "three", "four"]
    assert H.address("HTTPS://u@Blog.X.org:443/en/12.html?utm_source=f&b=2&a=1#top") == ("blog.x.org", "en/12?a=1&b=2")
    assert H.place("http://h/en/9") < H.place("http://h/en/10") < H.place("http://h/fr/1")
    assert H.address(None) == ("", "")


def order_of(path):
    """A path as a list that sorts segment by segment, numbers before words and as numbers."""
    return [[(0, int(x), x) if x.isdigit() else (1, x) for x in re.findall(r"[0-9]+|[^0-9]+", s)] for s in re.split(r"[/?&]", path)]


def nearness(a, b):
    """Segments, then pieces of the next one, that two paths share, then how near its numbers are."""
    x, y = order_of(a), order_of(b)
    n = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    u, v = (s[n] if n < len(s) else [] for s in (x, y))
    k = next((k for k in range(min(len(u), len(v))) if u[k] != v[k]), min(len(u), len(v)))
    numbers = k < min(len(u), len(v)) and u[k][0] == v[k][0] == 0
    return n, k, -abs(u[k][1] - v[k][1]) if numbers else float("-inf")


def brute_extract(pages):
    """The neighbour of each page out of all pages of its host."""
    by = defaultdict(lambda: defaultdict(list))
    for i, u, h in pages:
        host, path = H.address(u)
        by[host][path].append((i, u, h))
    out = {}
    for host in by.values():
        order = sorted(host, key=order_of)
        for k, path in enumerate(order):
            others = [p for p in order if p != path]
            best = max(others, key=lambda p: (*nearness(path, p), -abs(order.index(p) - k), order.index(p) < k), default=None)
            other = min(host[best], key=lambda r: r[0]) if best is not None else None
            for i, u, h in host[path]:
                out[i] = (other[0] if other else None, "\n".join(H.difference(H.lines_of(h), H.lines_of(other[2])) if other else H.lines_of(h)))
    return out


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_extraction_is_brute_force_pairing(spark, buckets):
    rng = random.Random(8)
    pages = []
    for i in range(220):
        host = rng.choice(["a.org", "a.org", "b.com", f"solo{i}.net"])
        url = f"http://{host}/{rng.choice(['en', 'fr', 'en-b', 'en2', 'en10'])}/{rng.choice(['a', 'a-b', 'x', ''])}{rng.randrange(40)}{rng.choice(['', '.html', '?utm_source=x', '?page=2', '?x=1&y=02', '/more'])}"
        if i > 150:  # a path that many pages have
            url = "http://a.org/en/same"
        pages.append((i, url, "".join(f"<p>{x}</p>" for x in ["menu", f"for {host}", *(f"text {rng.randrange(1000)}" for _ in range(5)), "foot"])))
    pages += [(300 + i, u, "<p>menu<p>" + u) for i, u in enumerate(["http://c.org/en/a", "http://c.org/en/a-b", "http://c.org/en/a?x=1"])]
    d = materialize(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4), "pages")
    got = {r.page_id: (r.neighbour_id, r.text) for r in H.extract(d, buckets).collect()}
    assert got == brute_extract(pages)
    assert got[302][0] == 300 and all("menu" not in t for n, t in got.values() if n is not None)


def test_html_edges(spark):
    rows = [(None, "http://h/a", "<p>x", 1, "l"), (1, None, "<p>y", 1, "l"), (2, "http://h/b", None, 1, "l"), (3, "http://h/b", "", 1, "l"), (4, "http://i/a", "<p>" + "long " * 50_000, 1, "l"), (4, "http://i/a", "<p>z", 1, "l")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, bucket int, lines string")
    got = H.extract(d).collect()
    assert len(got) == 6 and {r.text for r in got} == {"x", "y", "", ("long " * 50_000).strip(), "z"}
    assert H.extract(d.limit(0)).count() == 0


# chat


def test_trees_rebuild_every_conversation(spark):
    rng = random.Random(10)
    convs = []
    for c in range(60):
        n = rng.randrange(1, 6)
        convs.append((c, [("user" if k % 2 == 0 else "assistant", f"turn {k} says {rng.randrange(2)}") for k in range(n)]))
    rows = [(c, k, r, t) for c, turns in convs for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    enc = C.encoding()
    nodes = C.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    assert len(nodes) == len({tuple(turns[: k + 1]) for _, turns in convs for k in range(len(turns))})  # shared turns once
    by = {(n.tree_id, n.node): n for n in nodes}
    for c, turns in convs:
        at = [n for n in nodes if c in n.conv_ids]
        assert len(at) == 1
        path, n = [], at[0]
        while n is not None:
            path.insert(0, n)
            n = by.get((n.tree_id, n.parent))
        want = [t for r, x in turns for t in enc.encode_ordinary(C.render(r, x))]
        assert [t for n in path for t in n.tokens] == want and [p for n in path for p in n.position_ids] == list(range(len(want)))
    for tree in {n.tree_id for n in nodes}:
        mine = sorted((n for n in nodes if n.tree_id == tree), key=lambda n: n.start)
        assert [n.node for n in mine] == list(range(len(mine)))  # depth first
        mask = C.attention_mask(mine)
        up = {n.node: n.parent for n in mine}
        owner = [n.node for n in mine for _ in n.tokens]
        for i in range(len(owner)):
            line = {owner[i]}
            while up[min(line)] is not None:
                line.add(up[min(line)])
            assert mask[i].tolist() == [j <= i and owner[j] in line for j in range(len(owner))]


def test_chat_edges(spark):
    rows = [(None, 0, "user", "x", 1, 1), (1, 0, None, None, 1, 1), (1, 0, None, None, 1, 1), (2, None, "user", "late", 1, 1), (2, 0, "user", "a", 1, 1), (2, 0, "user", "b", 1, 1), (3, 0, "user", "w " * 20_000, 1, 1)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path int, tree_id int")
    got = C.prefix_trees(d).collect()
    assert {tuple(n.conv_ids) for n in got if n.conv_ids} == {(1,), (2,), (3,)} and len(got) == 5
    assert C.prefix_trees(d.limit(0)).count() == 0
