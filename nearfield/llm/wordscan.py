"""Vectorised word scanning: whole Arrow batches of text are split and hashed with array operations.

Words are found by a table of 256 booleans over UTF-8 bytes, so any word rule that is a class of bytes works. A word's
hash is a chain of 64-bit mixing steps over its bytes, eight at a time; a window's is made of the hashes of its halves,
so it takes as many steps as n can be doubled. Neither is linear in what it hashes: no two patterns collide by form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK = 1 << 21
_KEYS = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95), U64(0xA0761D6478BD642F))
#: What is left of eight bytes of which only so many belong to the word
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Words of more bytes are hashed one by one
_LONG = 128

#: Words of the class [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (digits, a-z and everything outside ASCII)
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about limit bytes. A null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


class Words:
    """The words of a chunk: byte ranges, hashes, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray):
        n = len(data)
        self.data, self.offs = data, offs
        inside = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[offs[offs < n]] = False
        after[offs[offs > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        wide = self.data.dtype.itemsize
        raw = np.zeros(len(self.data) * wide + 8, np.uint8)
        raw[:-8] = self.data.view(np.uint8)
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        at, left = self.starts * wide, (self.ends - self.starts) * wide
        out = mix((eight[at] & _KEPT[np.minimum(left, 8)]) ^ left.astype(U64) * _KEYS[0])
        more = np.flatnonzero(left > 8)
        for k in range(8, _LONG, 8):
            if not len(more):
                return out
            rest = left[more] - k
            out[more] = mix(out[more] * _KEYS[1] ^ (eight[at[more] + k] & _KEPT[np.minimum(rest, 8)]))
            more = more[rest > 8]
        for k in more.tolist():
            out[k] = xxhash.xxh3_64_intdigest(raw[at[k] : at[k] + left[k]].tobytes(), int(_KEYS[2]))
        return out

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def stable_order(key: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes: sorted with their places in the low bits, which is much faster than by argsort.

    Where two different hashes agree in all the other bits, they are sorted by argsort.
    """
    low = U64((1 << len(key).bit_length()) - 1)
    packed = np.sort(key & ~low | np.arange(len(key), dtype=U64))
    order = (packed & low).astype(np.int64)
    packed &= ~low
    found = key[order]
    if ((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])).any():
        return np.argsort(key, kind="stable")
    return order


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of data as a binary array."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    if offsets[-1] >= 1 << 31:
        raw = data.tobytes()
        return pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
    own = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], ends - starts)]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own)])


def window_hashes(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A hash for each n consecutive values; empty if there are fewer."""
    if len(h) < n:
        return np.zeros(0, U64)
    if salt:
        h = mix(h ^ U64(salt))
    size = 1
    while size < n:
        step = min(size, n - size)  # the halves of the last step may overlap
        h, size = mix(h[:-step] * _KEYS[1] + h[step:]), size + step
    return h


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    size = 1
    while size < n and len(x):
        step = min(size, n - size)
        x, size = np.minimum(x[:-step], x[step:]), size + step
    return x


def joined(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The chunk with one space behind each word that another word of its row follows, and where each word begins and ends."""
    n = len(words.data)
    inside = np.zeros(n + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    inside = np.cumsum(inside[:n]) > 0
    behind = words.ends[words.ends < n]
    behind = behind[~inside[behind]]
    data = words.data.copy()
    data[behind] = 0x20
    inside[behind] = True
    place = np.concatenate([[0], np.cumsum(inside)])
    return data[inside].tobytes(), place[words.starts], place[words.ends]


def in_one_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Which of the windows of n words lie in one row."""
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)


def spread(marked: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words are covered by windows of n words that start where marked is true."""
    edge = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(marked)
    edge[at] += 1
    np.subtract.at(edge, np.minimum(at + n, size), 1)
    return np.cumsum(edge[:size]) > 0
