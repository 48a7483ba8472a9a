"""HTML extraction by differencing each page with the nearest URL of its host.

Of the other paths of its host (query parameters other than tracking ones
belong to the path) a page takes the one that shares most leading segments; of
these the one whose next segment shares most leading words and numbers; then
the one with the nearer number there; then the one nearer in order, the one
before if both are next to it. In the order of paths, segment by segment and
numbers as numbers, that is the path before or the path after its own. Of
several pages with that path the least page_id stands for it. The lines of
both are aligned by their longest common subsequence, and the lines that the
page shares are deleted.

The order is cut into ranges of about equal numbers of pages, also within a
path that very many pages have. Bounds come from a job over the URLs alone;
the pages that stand for paths at bounds are sent to the ranges that need them.

Defined results: a page whose host has no other path keeps all its lines and
has a null neighbour; null or empty html has no lines; pages with null URLs
form a host of their own with one path; repeated rows each give a row; of
pages with equal paths none is the other's neighbour; of equal least page_ids
the first in place stands for its path; an empty table gives an empty result;
other columns are ignored; long pages are read and aligned whole. ``pages`` is
read twice and has to give the same rows in the same places, as tables of
files do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from decimal import Decimal
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import partitions, slices, table

TRACKING = re.compile(r"^(?:utm_\w+|ref|gclid|fbclid|mc_[ce]id|sessionid|sid)(?:=|$)", re.I)
URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.I)
GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAK = re.compile(r"<(?:/?(?:address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul|title|option|select)|br)\b[^>]*>|\n", re.I)
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")


def lines_of(html: str | None) -> list[str]:
    """The visible lines of a page: one for each block, white space made single, empty ones left out."""
    if not html:
        return []
    out = []
    for part in BREAK.split(GONE.sub(" ", html)):
        line = " ".join(unescape(TAG.sub("", part)).split())
        if line:
            out.append(line)
    return out


def address(url: str | None) -> tuple[str, str]:
    """(host, path): path segments joined by slashes, then the query without tracking parameters."""
    m = URL.match((url or "").strip())
    if not m:
        return "", (url or "").strip()
    host, path, query = m.group(1).lower(), m.group(2), m.group(3) or ""
    host = re.sub(r":(?:80|443)$", "", host)
    path = "/".join(s for s in re.sub(r"\.html?$", "", path).split("/") if s)
    kept = "&".join(sorted(p for p in query.split("&") if p and not TRACKING.match(p)))
    return host, f"{path}?{kept}" if kept else path


SEGMENT = re.compile(r"[/?&]")
PIECE = re.compile(r"[0-9]+|[^0-9]+")


def _number(digits: str) -> str:
    """A string whose order is that of numbers of any length; different writings of one number differ."""
    n = digits.lstrip("0")
    return f"{len(str(len(n)))}{len(n)}{n}:{digits}"


def place(url: str | None) -> str:
    """A string whose order is that of hosts and paths, segment by segment, numbers before words and as numbers."""
    host, path = address(url)
    padded = re.sub(r"[0-9]+", lambda m: "\x02" + _number(m.group()), path)
    return host + "\x00" + SEGMENT.sub("\x01", padded)


def closeness(a: str, b: str) -> tuple[int, int, Decimal]:
    """(leading segments shared, leading words and numbers shared of the next, minus the difference of the numbers after these): greater is nearer."""
    x, y = SEGMENT.split(a), SEGMENT.split(b)
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    u, v = (PIECE.findall(s[n]) if n < len(s) else [] for s in (x, y))
    k = 0
    while k < min(len(u), len(v)) and u[k] == v[k]:
        k += 1
    both = k < min(len(u), len(v)) and u[k][0].isdigit() and v[k][0].isdigit()
    return n, k, -abs(Decimal(u[k]) - Decimal(v[k])) if both else -Decimal("Infinity")


def _row(a: list[int], where: dict[int, int], m: int) -> list[int]:
    """Lengths of the LCS of a and each prefix of the other, bit-parallel; where has each symbol's places."""
    full = (1 << m) - 1
    v = full
    for s in a:
        u = v & where.get(s, 0)
        v = ((v + u) | (v - u)) & full
    out, n = [0], 0
    for c in bin(v | 1 << m)[:2:-1]:
        n += c == "0"
        out.append(n)
    return out


def _places(b: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for j, s in enumerate(b):
        out[s] = out.get(s, 0) | 1 << j
    return out


def lcs(a: list[int], b: list[int]) -> list[int]:
    """The indices of a that a longest common subsequence of a and b uses.

    Rows of lengths are bit-parallel; the alignment is found by halving, so that
    memory stays in proportion to the lines.
    """
    out: list[int] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append(j)
        if i >= j or k >= m:
            continue
        both = set(a[i:j]) & set(b[k:m])
        if not both:
            continue
        if j - i == 1:
            out.append(i)
            continue
        if (j - i) * (m - k) <= 4096:
            x = [s for s in range(i, j) if a[s] in both]
            y = [b[s] for s in range(k, m) if b[s] in both]
            t = [[0] * (len(y) + 1)]
            for s in reversed(x):
                below, row = t[-1], [0] * (len(y) + 1)
                for c in range(len(y) - 1, -1, -1):
                    row[c] = below[c + 1] + 1 if a[s] == y[c] else max(below[c], row[c + 1])
                t.append(row)
            c = 0
            for n, s in enumerate(x):
                row, below = t[len(x) - n], t[len(x) - n - 1]
                while c < len(y) and row[c + 1] == row[c]:
                    c += 1
                if c < len(y) and below[c] != row[c]:
                    out.append(s)
                    c += 1
            continue
        half = (i + j) // 2
        up = _row(a[i:half], _places(b[k:m]), m - k)
        down = _row(a[half:j][::-1], _places(b[k:m][::-1]), m - k)
        cut = max(range(m - k + 1), key=lambda c: up[c] + down[m - k - c])
        work += [(i, half, k, k + cut), (half, j, k + cut, m)]
    return sorted(out)


def difference(lines: list[str], other: list[str]) -> list[str]:
    """The lines that the longest common subsequence with ``other`` doesn't use."""
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(s, len(ids)) for s in x] for x in (lines, other))
    used = set(lcs(a, b))
    return [s for i, s in enumerate(lines) if i not in used]


def _bounds(batches):
    """Of a sorted partition: its first row, and the first row of its first two and last two paths."""
    first, heads = None, []
    for b in batches:
        for key in b.column("key").to_pylist():
            first = first or key
            if not heads or heads[-1]["place"] != key["place"]:
                heads.append(key)
                del heads[2:-2]
            elif _order(key) < _order(heads[-1]):
                heads[-1] = key
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([first], _TYPE), pa.array([heads], pa.list_(_TYPE))], ["head", "heads"])


_TYPE = pa.struct([("place", pa.string()), ("none", pa.bool_()), ("page_id", pa.int64()), ("rid", pa.int64()), ("salt", pa.int64())])


def _order(key) -> tuple:
    return key["none"], key["page_id"] or 0, key["rid"]


def _halos(ranges: list) -> dict[tuple[str, int], list[int]]:
    """(place, rid) of the pages that stand for paths at bounds, with the ranges that these are sent to."""
    best: dict[str, dict] = {}
    for _, heads in ranges:
        for h in heads:
            if h["place"] not in best or _order(h) < _order(best[h["place"]]):
                best[h["place"]] = h
    order = sorted(best)
    at = {p: k for k, p in enumerate(order)}
    out: dict[tuple[str, int], list[int]] = {}
    for k, (_, heads) in enumerate(ranges):
        low, high = at[heads[0]["place"]], at[heads[-1]["place"]]
        for i in {low - 1, low, high, high + 1} & set(range(len(order))):
            out.setdefault((order[i], best[order[i]]["rid"]), []).append(k)
    return out


_SENT = "bucket int, halo boolean, place string, none boolean, page_id long, rid long, url string, lines array<string>"
SCHEMA = "page_id long, url string, neighbour_id long, n_lines int, n_shared int, text string"


def _parse(firsts: list[tuple], halos: dict[tuple[str, int], list[int]]):
    """Lines of each page, to the range of its place; pages that stand for paths at bounds also to other ranges."""

    def run(batches):
        for b in slices(batches, "html", 4 << 20):
            rows = []
            for page, rid, url, html, salt in zip(*(b.column(c).to_pylist() for c in ("page_id", "rid", "url", "html", "salt"))):
                at, lines = place(url), lines_of(html)
                k = max(0, bisect_right(firsts, (at, salt)) - 1)
                rest = (at, page is None, page, rid, url, lines)
                rows.append((k, False, *rest))
                rows += [(h, True, *rest) for h in halos.get((at, rid), ()) if h != k]
            c = list(zip(*rows))
            types = [pa.int32(), pa.bool_(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], [x.split()[0] for x in _SENT.split(", ")])

    return run


def _pair(batches):
    """Rows of a sorted range: three paths are held at a time, the one before, this one and the next."""
    out, run_, bucket = [], [], None

    def settle(prev, here, after):
        host = here[0][2].split("\x00")[0]
        here_path = address(here[0][6])[1]
        sides = [g for g in (prev, after) if g and g[0][2].split("\x00")[0] == host]
        best = max(sides, key=lambda g: closeness(here_path, address(g[0][6])[1]), default=None)
        for _, halo, _, _, page, _, url, lines in here:
            if halo:
                continue
            kept = difference(lines, best[0][7]) if best else lines
            out.append((page, url, best[0][4] if best else None, len(lines), len(lines) - len(kept), "\n".join(kept)))

    def finish():
        if run_:
            settle(run_[-2] if len(run_) > 1 else None, run_[-1], None)
        run_.clear()

    def take():
        c = list(zip(*out)) or [()] * 6
        out.clear()
        types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    for b in batches:
        for row in zip(*(b.column(c.split()[0]).to_pylist() for c in _SENT.split(", "))):
            if row[0] != bucket:
                finish()
                bucket = row[0]
            if run_ and run_[-1][0][2] == row[2]:
                run_[-1].append(row)
                continue
            if run_:
                settle(run_[-2] if len(run_) > 1 else None, run_[-1], [row])
                run_[:-1] = [g[:1] for g in run_[:-1]]
            run_.append([row])
            del run_[:-2]
        if out:
            yield take()
    finish()
    yield take()


def _placed_urls(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([place(u) for u in b.column("url").to_pylist()], pa.string()), *(b.column(c) for c in ("page_id", "rid", "salt"))], ["place", "page_id", "rid", "salt"])


def extract(pages: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """One row for each page: its lines without those it shares with the nearest URL."""
    n = n_buckets or partitions(pages.sparkSession)
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("rid"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("salt", F.xxhash64("rid"))
    places = kept.select("url", "page_id", "rid", "salt").mapInArrow(_placed_urls, "place string, page_id long, rid long, salt long")
    key = F.struct("place", F.col("page_id").isNull().alias("none"), "page_id", "rid", "salt").alias("key")
    sorted_ = places.repartitionByRange(n, "place", "salt").sortWithinPartitions("place", "salt").select(key)
    kind = "struct<place:string,none:boolean,page_id:long,rid:long,salt:long>"
    ranges = sorted_.mapInArrow(_bounds, f"head {kind}, heads array<{kind}>").orderBy("head.place", "head.salt").collect()  # a row for each range
    sent = kept.mapInArrow(_parse([(r.head.place, r.head.salt) for r in ranges], _halos(ranges)), _SENT)
    return sent.repartitionById(n, "bucket").sortWithinPartitions("bucket", "place", "none", "page_id", "rid").mapInArrow(_pair, SCHEMA)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
