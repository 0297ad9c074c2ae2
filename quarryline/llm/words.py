"""Words of many texts at once, as numpy arrays.

A batch of texts is one byte buffer. A word is a maximal run of bytes that a
256-entry table marks, within one text. Words are hashed eight bytes at a step,
all words at once, so no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: By lane: where hashes begin, and what they are multiplied by at each step.
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FACTORS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Spans of more bytes are hashed one by one.
LONG = 1024
#: By number of bytes up to eight: which bits of a little-endian word they are.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def not_space() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def letters_digits() -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are
    lower-cased, and the table that lower-cases them."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    table = np.zeros(256, bool)
    table[48:58] = table[97:123] = table[128:] = True
    return table[lower], lower


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads each input bit over all output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans of equal length up to eight
    bytes never collide; each step of a longer one is a bijection of what the
    steps before left, so others collide as random words do."""
    size = ends - starts
    out = mix(size.astype(U64) + U64(SEEDS[lane]))
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", buffer=padded, strides=(1,))
    large = np.flatnonzero(size > LONG)
    going, k = np.flatnonzero(size <= LONG), 0
    while len(going):
        rest = size[going] - k
        out[going] = mix(out[going] * U64(FACTORS[lane]) ^ (eight[starts[going] + k] & _MASKS[np.minimum(rest, 8)]))
        going, k = going[rest > 8], k + 8
    if len(large):
        from xxhash import xxh3_64_intdigest

        view = memoryview(padded)
        out[large] = [xxh3_64_intdigest(view[a:b], SEEDS[lane]) for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True)]
    return out


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the n + 1 offsets of the texts in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """starts and ends (bytes) of each word, doc (index of its text), first
    (n + 1: index of each text's first word) of a batch."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: np.ndarray | None = None):
        self.buf, self.offsets = (buf if lower is None else lower[buf]), offsets
        inside = table[buf]
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_spans(self.buf, self.starts, self.ends, lane)

    def chars(self) -> np.ndarray:
        """Code points of each word."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=total[1:])
        return total[self.ends] - total[self.starts]

    def rolling(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows that lie in one text, and the indexes
        of their first words."""
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        out = np.zeros(m, U64)
        for i in range(n):
            out *= U64(0xA0761D6478BD642F)
            out += h[i : i + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return mix(out[at]), at


def slices(offsets: np.ndarray, most: int):
    """Ranges (a, b) of texts of at most ``most`` bytes together, or one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in one of the windows that begin at ``starts``."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def repeated(key: np.ndarray) -> np.ndarray:
    """Indexes of the keys that occur twice or more, sorted by key, stably.

    A table of truncated keys first drops most of those that occur once."""
    if len(key) > 256:
        bits = U64((1 << (len(key) * 4).bit_length()) - 1)
        low = (key & bits).astype(np.int64)
        at = np.flatnonzero(np.bincount(low)[low] > 1)
    else:
        at = np.arange(len(key))
    at = at[np.argsort(key[at], kind="stable")]
    same = key[at[1:]] == key[at[:-1]]
    twice = np.zeros(len(at), bool)
    twice[1:] = same
    twice[:-1] |= same
    return at[twice]


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
