"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned for secrets and for encoded
stretches: percent escapes, Unicode and character references, base64 (also over
lines), and compressed bytes inside base64, all members of them and what a
truncated one gives. What a stretch decodes to is a new layer on
the worklist, until none is left; a layer whose content the same
stretch of the document already gave isn't gone through again, so cycles end. Every character of a layer knows which
characters of the document it came from, so findings at any depth have spans
of the document.

Defined results: null and empty texts have no findings; repeated rows each
give theirs; ids may be null; an empty table gives an empty result; texts are
read whole. A compressed stretch that unpacks to more than ``MAX_LAYER``
bytes is itself reported, as ``oversized_layer``, so that nothing is dropped
in silence, and so is one in xz whose dictionary needs more than
``XZ_MEMORY``. Decoded bytes are read as UTF-8, UTF-16, or else byte for byte.
Where several layers give the same kind and span the least deep is given.
``redact_secrets`` passes other columns through and sets
``n_chars``, where there is one, to the length of a changed text.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from hashlib import sha256
from html import unescape
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from loamsift.llm.common import pick, slices, table

MAX_LAYER = 64 << 20
XZ_MEMORY = 256 << 20
RULES = [
    ("aws_access_key", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,})")),
    ("slack_token", ("xox",), re.compile(r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}")),
    ("google_key", ("AIza",), re.compile(r"\bAIza[\w-]{35}")),
    ("stripe_key", ("k_live_", "k_test_"), re.compile(r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}")),
    ("private_key", ("-----BEGIN",), re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    ("jwt", ("eyJ",), re.compile(r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}")),
    ("url_credentials", ("://",), re.compile(r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]+:[^\s/@]{3,}@[\w.-]+")),
]
NAMED = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:password|passwd|pwd|passphrase|secret(?:[_-]?(?:access[_-]?)?key)?|token|(?:api|access|auth|private|encryption|signing)[_-]?key|client[_-]?secret)[\"']?\s{0,8}[=:]\s{0,8}(?:\"([^\"\n]{8,})\"|'([^'\n]{8,})'|([^\s\"',;]{8,}))")
NAMES = ("passw", "pwd", "passphrase", "secret", "token", "key")
PERCENT = re.compile(r"(?<![\w.~+/=%-])[\w.~+/=-]*(?:%[0-9A-Fa-f]{2}[\w.~+/=-]*)+")
HAS_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u\{[0-9a-fA-F]{1,6}\}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|&#[xX]?[0-9a-fA-F]{1,7};")
SPACE = re.compile(r"\s")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\r?\n|\r)[ \t]*[A-Za-z0-9+/_-]{16,})*(?:[ \t]*(?:\r?\n|\r)[ \t]*[A-Za-z0-9+/_-]+)?={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
MIXED = re.compile(r"(?=.*[A-Z])(?=.*[a-z0-9])")
MAGIC = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"BZh", "bzip2"), (b"\xfd7zXZ", "xz"), (b"\x78\x01", "zlib"), (b"\x78\x5e", "zlib"), (b"\x78\x9c", "zlib"), (b"\x78\xda", "zlib"))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in this text as it is."""
    out = []
    for kind, signs, rule in RULES:
        if any(s in text for s in signs):
            out += [(kind, m.start(), m.end()) for m in rule.finditer(text)]
    if ("=" in text or ":" in text) and any(n in (low := text.lower()) for n in NAMES) and low:
        for m in NAMED.finditer(text):
            k = m.lastindex
            out.append(("named_secret", m.start(k), m.end(k)))
    return out


def _member(codec: str, data: bytes, room: int) -> tuple[bytes, bytes | None]:
    """What the first member of data unpacks to, up to a little over room, and the bytes after it; None if it has no end."""
    out = bytearray()
    try:
        if codec == "zstd":
            d, step = zstandard.ZstdDecompressor().decompressobj(), 256
        else:
            d, step = zlib.decompressobj(zlib.MAX_WBITS | 32) if codec in ("gzip", "zlib") else bz2.BZ2Decompressor() if codec == "bzip2" else lzma.LZMADecompressor(memlimit=XZ_MEMORY), 4096
        for at in range(0, len(data), step):
            part = data[at : at + step]
            out += d.decompress(part) if codec == "zstd" else d.decompress(part, room + 1 - len(out))
            if d.eof:
                return bytes(out), d.unused_data + data[at + step :]
            if len(out) > room:
                break
    except lzma.LZMAError as e:
        if "emory" in str(e):  # a dictionary beyond XZ_MEMORY
            raise MemoryError from e
    except (zlib.error, zstandard.ZstdError, OSError, EOFError, ValueError):
        pass
    return bytes(out), None


def unpack(data: bytes) -> tuple[str, bytes | None] | None:
    """(codec, bytes) of all members of compressed data, of a truncated one what it gives; bytes are None beyond MAX_LAYER; None if it isn't compressed."""
    first, out, rest = None, bytearray(), data
    while rest:
        if first:
            rest = rest.lstrip(b"\0")  # padding between members
        if rest[1:4] == b"\x2a\x4d\x18" and 0x50 <= rest[0] < 0x60:  # a frame that zstd skips
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        codec = next((c for magic, c in MAGIC if rest.startswith(magic)), None)
        if not codec:
            break
        first = first or codec
        try:
            got, rest = _member(codec, rest, MAX_LAYER - len(out))
        except MemoryError:
            return first, None
        out += got
        if len(out) > MAX_LAYER:
            return first, None
    return (first, bytes(out)) if out else None


def _utf16(data: bytes) -> str | None:
    """The byte order of text in UTF-16 that is mostly ASCII."""
    even, odd = data[0::2].count(0), data[1::2].count(0)
    if 4 * max(even, odd) < len(data) or min(even, odd) * 8 > max(even, odd):
        return None
    return "utf-16-le" if odd > even else "utf-16-be"


def as_text(data: bytes, starts: np.ndarray, ends: np.ndarray):
    """The text of bytes in UTF-8, else UTF-16, else byte for byte, with each character's source span."""
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    else:
        order = _utf16(data) if b"\0" in data else None
        if not order:
            return _chars(data, starts, ends)
    order = _utf16(data)
    if order:
        units = len(data) // 2
        text = data[: 2 * units].decode(order, "replace").replace("\ufeff", " ")
        if len(text) == units:  # no surrogate pairs: a character for each two bytes
            return text, starts[0 : 2 * units : 2], ends[1 : 2 * units : 2]
    return data.decode("latin-1"), starts, ends


def _chars(data: bytes, starts: np.ndarray, ends: np.ndarray):
    """Text of UTF-8 bytes (others as replacement characters), with each character's source span."""
    text = data.decode("utf-8", "replace")
    if len(text) == len(data):
        return text, starts, ends
    at, a, b = 0, [], []
    for c in text:
        n = 1 if c == "\ufffd" and data[at : at + 3] != b"\xef\xbf\xbd" else len(c.encode("utf-8"))
        a.append(starts[min(at, len(starts) - 1)])
        at = min(at + n, len(data))
        b.append(ends[at - 1])
    return text, np.array(a, np.int64), np.array(b, np.int64)


def decodings(text: str):
    """(codec, start, end, decoded text or None if oversized, source starts, source ends) of each encoded stretch; sources count in this text."""
    if "%" in text and HAS_PERCENT.search(text):
        for m in PERCENT.finditer(text):
            raw, at, starts, ends = m.group(), 0, [], []
            data = unquote_to_bytes(raw)
            for c in re.finditer(r"%[0-9A-Fa-f]{2}|[\s\S]", raw):
                n = 1 if len(c.group()) == 3 else len(c.group().encode("utf-8", "surrogatepass"))
                starts += [m.start() + c.start()] * n
                ends += [m.start() + c.end()] * n
            yield ("url", m.start(), m.end(), *_chars(data, np.array(starts, np.int64), np.array(ends, np.int64)))
    if "\\u" in text or "\\x" in text or "&#" in text:
        found = list(ESCAPE.finditer(text))
        k = 0
        while k < len(found):  # all escapes of a run without white space belong together, with the whole run
            a, end = found[k].start(), SPACE.search(text, found[k].end())
            b = end.start() if end else len(text)
            while a and not text[a - 1].isspace():
                a -= 1
            j = k
            while j + 1 < len(found) and found[j + 1].start() < b:
                j += 1
            out, starts, ends, at = [], [], [], a
            for m in found[k : j + 1]:
                out += text[at : m.start()]
                starts += range(at, m.start())
                ends += range(at + 1, m.start() + 1)
                e = m.group()
                if e[0] == "&":
                    c = unescape(e)
                else:
                    v = int(e[2:].strip("{}"), 16)
                    c = chr(v) if v < 0x110000 and not 0xD800 <= v < 0xE000 else "\ufffd"
                out += c
                starts += [m.start()] * len(c)
                ends += [m.end()] * len(c)
                at = m.end()
            out += text[at:b]
            starts += range(at, b)
            ends += range(at + 1, b + 1)
            yield "unicode", a, b, "".join(out), np.array(starts, np.int64), np.array(ends, np.int64)
            k = j + 1
    for m in BASE64.finditer(text):
        yield from _base64(m.group(), np.arange(m.start(), m.end()))
    for m in WRAPPED.finditer(text):
        lines = [x.span() for x in LINE.finditer(text, m.start(), m.end())]
        for some in _stretches(lines):
            yield from _base64("".join(text[a:b] for a, b in some), np.concatenate([np.arange(a, b) for a, b in some]))


def _stretches(lines: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The lines that may be one base64 text: all, and each body of equal lines, with the line after it and without."""
    width, out, a = [b - a for a, b in lines], [lines, lines[:-1]], 0
    while a < len(lines):
        b = a + 1
        while b < len(lines) and width[b] == width[a]:
            b += 1
        out += [lines[a : b + 1], lines[a:b]]
        a = b
    return [x for k, x in enumerate(out) if len(x) > 1 and x not in out[:k]] if len(out) < 9 else [x for x in out if len(x) > 1]


def _base64(raw: str, at: np.ndarray):
    """What base64 whose characters stand at these places decodes to, as ``decodings`` gives it."""
    if not MIXED.match(raw):
        return
    core = raw.rstrip("=").translate(_URLSAFE)
    if len(core) % 4 == 1:
        core = core[:-1]
    data = base64.b64decode(core + "=" * (-len(core) % 4))
    start, end = int(at[0]), int(at[-1]) + 1
    packed = unpack(data)
    if packed:
        codec, got = packed
        if got is None:
            yield f"base64>{codec}", start, end, None, None, None
        else:
            t = got.decode("utf-8", "replace")
            yield f"base64>{codec}", start, end, t, np.broadcast_to(np.int64(start), len(t)), np.broadcast_to(np.int64(end), len(t))
    i = np.arange(len(data))  # text may begin as compressed data does
    yield ("base64", start, end, *as_text(data, at[i * 8 // 6], at[np.minimum((i + 1) * 8 // 6, len(raw) - 1)] + 1))


_URLSAFE = str.maketrans("-_", "+/")


def findings(text: str | None) -> list[tuple[str, int, int, int, str, str]]:
    """(kind, start, end, depth, chain, secret) of all layers, once for each kind and span; the least deep comes first."""
    if not text:
        return []
    out, done = {}, set()
    work = [(text, None, None, 0, "")]
    for layer, starts, ends, depth, chain in work:
        span = lambda a, b: (a, b) if starts is None else (int(starts[a:b].min()), int(ends[a:b].max()))
        for kind, a, b in scan(layer):
            out.setdefault((*span(a, b), kind), (depth, chain, layer[a:b]))
        for codec, a, b, decoded, s, e in decodings(layer):
            if decoded is None:
                out.setdefault((*span(a, b), "oversized_layer"), (depth, f"{chain}>{codec}".lstrip(">"), layer[a:b]))
                continue
            mark = (decoded, *span(a, b))
            if not decoded or decoded == layer or mark in done:
                continue
            done.add(mark)
            if starts is not None:  # s and e count in this layer: carry them to the document
                s, e = starts[np.minimum(s, len(starts) - 1)], ends[np.minimum(e, len(ends)) - 1]
            work.append((decoded, s, e, depth + 1, f"{chain}>{codec}".lstrip(">")))
    return [(k[2], k[0], k[1], *v) for k, v in sorted(out.items(), key=lambda x: (x[0][0], x[1][0], x[0]))]


SCHEMA = "doc_id long, kind string, start int, end int, depth int, chain string, digest string"


def secrets(docs: DataFrame) -> DataFrame:
    """One row for each finding; the secret itself only as the start of its SHA-256."""

    def run(batches):
        for b in slices(batches):
            rows = [(i, k, s, e, d, c, sha256(x.encode("utf-8", "surrogatepass")).hexdigest()[:16]) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for k, s, e, d, c, x in findings(t)]
            if rows:
                c = list(zip(*rows))
                types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], ["doc_id", "kind", "start", "end", "depth", "chain", "digest"])

    return pick(docs).mapInArrow(run, SCHEMA)


def redacted(text: str | None) -> str | None:
    """The text with each finding's span, overlapping ones together, replaced by its kind."""
    spans: list[list] = []
    for kind, s, e, *_ in findings(text):
        if spans and s < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e, kind])
    for s, e, kind in reversed(spans):
        text = f"{text[:s]}[SECRET:{kind}]{text[e:]}"
    return text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All documents with secrets replaced; other columns as they are."""
    at = docs.columns.index(text_col)
    sized = docs.columns.index(length_col) if length_col in docs.columns and dict(docs.dtypes)[length_col] in ("bigint", "int") else None

    def run(batches):
        for b in slices(batches, at):
            old = b.column(at).to_pylist()
            new = [redacted(t) for t in old]
            if new != old:
                cols = list(b.columns)
                cols[at] = pa.array(new, b.schema.field(at).type)
                if sized is not None:
                    cols[sized] = pa.array([n if a == c else len(c) for n, a, c in zip(cols[sized].to_pylist(), old, new)], b.schema.field(sized).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
