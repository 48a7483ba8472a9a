"""Token ids in patched frame-of-reference blocks.

A document's ids are cut into blocks of ``BLOCK``. Of each block the minimum
is subtracted, the rest is packed at the width that holds ``PERCENTILE`` of
its values, and what doesn't fit is cut to that width and mended by an
exception list. ``starts`` indexes the bytes at which blocks begin, so any
block is read without the ones before it.

A block: minimum (uint32), width (uint8), number of exceptions (uint8), the
exceptions' places (uint8 each) and high parts (uint32 each), packed bits.

Defined results: a null text has null tokens and payload; an empty text has 0
tokens and an empty payload; repeated rows each have their row; ids may be
null; an empty table gives an empty result; long texts are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamsift.llm.common import pick, slices, table

BLOCK = 128
PERCENTILE = 0.9
TOGETHER = 1 << 17  # characters of which new pieces are encoded at once
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BESIDE = re.compile(r" (?:(?=\s)|(?<=\s ))")  # a space beside other white space
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Pieces(dict):
    """A space and the piece after it, to the bytes of its ids.

    The pattern never joins characters across a space that stands between two
    others that aren't white space, so such pieces can be encoded apart. New
    ones are encoded all at once, and each begins at an id of a space.
    """

    def __init__(self, enc, most: int = 200_000):
        self.enc, self.most = enc, most
        self.space = np.zeros(enc.n_vocab, bool)
        self.space[[enc.encode_single_token(t) for t in enc.token_byte_values() if t[:1] == b" "]] = True

    def _learn(self, pieces: set[str]) -> None:
        if len(self) + len(pieces) > self.most:
            self.clear()
        new = list(pieces)
        ids = np.array(self.enc.encode_ordinary(" " + " ".join(new)), np.int32)
        cuts = [*(4 * np.flatnonzero(self.space[ids])).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        self.update(zip(new, [raw[x:y] for x, y in zip(cuts, cuts[1:])], strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):  # few at a time, so that pieces stay in the processor's cache
            known, new, size = [], set(), 0
            while at < len(texts) and size < TOGETHER:
                text, size, at = texts[at], size + len(texts[at]), at + 1
                parts = self._parts(text) if text else None
                if parts is None:
                    known.append((array("i", self.enc.encode_ordinary(text)).tobytes(), [], [], ()))
                    continue
                rest = parts[1:]
                ids = list(map(self.get, rest))
                holes = [k for k, v in enumerate(ids) if v is None]
                new.update(missing := [rest[k] for k in holes])
                known.append((array("i", self.enc.encode_ordinary(parts[0])).tobytes(), ids, holes, missing))
            if new:
                self._learn(new)
            for head, ids, holes, missing in known:
                for k, piece in zip(holes, missing):
                    ids[k] = self[piece]
                out.append(np.frombuffer(head + b"".join(ids), np.int32))
        return out

    @staticmethod
    def _parts(text: str) -> list[str] | None:
        """Pieces of a text, none if it can't be cut at its spaces."""
        if " " not in text or text[0].isspace() or text[-1].isspace():
            return None
        parts = text.split(" ")
        return parts if parts == text.split() or not _BESIDE.search(text) else None

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(docs: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, block starts) of each document; all blocks are packed at once."""
    counts = np.array([len(d) for d in docs], np.int64)
    blocks = -(-counts // BLOCK)
    total = int(blocks.sum())
    if not total:
        return [(b"", np.empty(0, np.int32)) for _ in docs]
    owner = np.repeat(np.arange(len(docs)), blocks)
    rank = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    sizes = np.minimum(BLOCK, counts[owner] - rank * BLOCK)
    flat = np.concatenate(docs).astype(np.int64)
    inside = np.arange(BLOCK) < sizes[:, None]
    grid = np.zeros((total, BLOCK), np.int64)
    grid[inside] = flat
    low = np.where(inside, grid, np.iinfo(np.int64).max).min(axis=1)
    grid = np.where(inside, grid - low[:, None], 0)
    need = _widths(grid)
    ordered = np.sort(np.where(inside, need, 99), axis=1)
    width = ordered[np.arange(total), np.ceil(sizes * PERCENTILE).astype(np.int64) - 1]
    outlier = (need > width[:, None]) & inside
    n_out = outlier.sum(axis=1)
    bits = [b""] * total
    for w in np.unique(width):
        if w:
            own = np.flatnonzero(width == w)
            raw = grid[own].astype("<u4").view(np.uint8).reshape(len(own), BLOCK, 4)[:, :, : (int(w) + 7) // 8]
            planes = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(planes.reshape(len(own), -1), axis=1, bitorder="little")
            for b, row in zip(own.tolist(), packed):
                bits[b] = row[: (int(sizes[b]) * int(w) + 7) // 8].tobytes()
    high, place = (grid >> width[:, None])[outlier].astype("<u4"), np.nonzero(outlier)[1].astype(np.uint8)
    ends = np.cumsum(n_out)
    head = np.zeros(total, [("low", "<u4"), ("width", "u1"), ("n", "u1")])
    head["low"], head["width"], head["n"] = low, width, n_out
    heads, places, highs = head.tobytes(), place.tobytes(), high.tobytes()
    out, k = [], 0
    for n in blocks.tolist():
        pieces, starts, at = [], np.empty(n, np.int32), 0
        for j in range(n):
            e, s = int(ends[k]), int(ends[k] - n_out[k])
            piece = heads[6 * k : 6 * k + 6] + places[s:e] + highs[4 * s : 4 * e] + bits[k]
            starts[j], at, k = at, at + len(piece), k + 1
            pieces.append(piece)
        out.append((b"".join(pieces), starts))
    return out


def unpack_block(payload: bytes, start: int, size: int) -> np.ndarray:
    """The ``size`` ids of the block at ``start``."""
    low, (width, n) = int(np.frombuffer(payload, "<u4", 1, start)[0]), payload[start + 4 : start + 6]
    place = np.frombuffer(payload, np.uint8, n, start + 6)
    high = np.frombuffer(payload, "<u4", n, start + 6 + n).astype(np.int64)
    x = np.zeros(size, np.int64)
    if width:
        raw = np.frombuffer(payload, np.uint8, (size * width + 7) // 8, start + 6 + 5 * n)
        x = np.unpackbits(raw, count=size * width, bitorder="little").reshape(size, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))
    x[place] |= high << width
    return (x + low).astype(np.int32)


def unpack(payload: bytes, starts, n_tokens: int) -> np.ndarray:
    parts = [unpack_block(payload, int(s), min(BLOCK, n_tokens - k * BLOCK)) for k, s in enumerate(starts)]
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


SCHEMA = "doc_id long, n_tokens long, payload binary, starts array<int>"


def token_blocks(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, payload, starts): one row for each document."""

    def run(batches):
        pieces = Pieces(encoding(vocabulary))
        for b in slices(batches, limit=2 << 20):
            texts = b.column("text").to_pylist()
            ids = pieces.encode_all([t or "" for t in texts])
            packed = pack(ids)
            none = np.array([t is None for t in texts])
            at = np.concatenate([[0], np.cumsum([len(s) for _, s in packed])]).astype(np.int32)
            starts = pa.ListArray.from_arrays(at, np.concatenate([s for _, s in packed]), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64(), mask=none), pa.array([p for p, _ in packed], pa.binary(), mask=none), starts], ["doc_id", "n_tokens", "payload", "starts"])

    return pick(docs).mapInArrow(run, SCHEMA)


def decode_blocks(packed: DataFrame) -> DataFrame:
    """(doc_id, tokens) from what ``token_blocks`` gives."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("payload", "starts", "n_tokens")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if p is None else unpack(p, s, n) for p, s, n in rows], pa.list_(pa.int32()))], ["doc_id", "tokens"])

    return packed.select("doc_id", "payload", "starts", "n_tokens").mapInArrow(run, "doc_id long, tokens array<int>")


def op8_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks(table(spark, sf_dir, "documents"))
