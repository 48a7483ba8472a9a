"""Words of a column of texts, found in its bytes at once: runs without white space, as ``str.split`` gives them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_LETTER = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, wrapping."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse mod 2**64, as far as asked."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (self.base, pow(self.base, -1, 2**64)))
        return self.up, self.down


def _spaces(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space."""
    s = _SPACE[b]
    at = np.flatnonzero((b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3)))
    if len(at):
        p = np.concatenate([b, np.zeros(2, np.uint8)])
        x, y, z = b[at], p[at + 1], p[at + 2]
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        general = (y == 0x80) & (((z >= 0x80) & (z <= 0x8A)) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        three = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (general | ((y == 0x81) & (z == 0x9F)))) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        for k in range(2):
            s[at[two] + k] = True
        for k in range(3):
            s[at[three] + k] = True
    return s


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each word, byte after it, words of each text); null texts have none."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 3
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(b):
        return b, *(np.zeros(0, np.int64),) * 2, np.zeros(len(column), np.int64)
    word = ~_spaces(b)
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = off[1:-1]
    first[cut[cut < len(b)]] |= word[cut[cut < len(b)]]
    last[cut[cut > 0] - 1] |= word[cut[cut > 0] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return b, start, end, np.diff(np.searchsorted(start, off))


def word_hashes(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts in turn, words of each text)."""
    b, start, end, sizes = spans(column)
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, down = powers.upto(high - low)
        p = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[b[low:high]] * up[: high - low])])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (p[e] - p[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out), sizes


def distinct_words(column: pa.Array, powers: Powers) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which of the distinct words each word is, the distinct words, words of each text)."""
    b, start, end, sizes = spans(column)
    h, _ = word_hashes(column, powers)
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    raw = b.tobytes()
    return which, [raw[x:y] for x, y in zip(start[one].tolist(), end[one].tolist())], sizes
