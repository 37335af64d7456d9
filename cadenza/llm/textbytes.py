"""Vectorised text primitives over Arrow buffers: words, word hashes and word n-gram hashes.

Everything works on the UTF-8 bytes of a whole batch of texts at once with numpy, so one pass over a
text costs some tens of nanoseconds a byte and no Python object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in runs of about this many bytes, which bounds the memory of the temporaries.
RUN_BYTES = 1 << 20

#: Powers are kept for the places of one block of this many (a power of two) bytes; any other is such a power times that of its block.
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_block: dict[int, np.ndarray] = {}


_coder: dict[tuple, object] = {}


def kept(make, path: str):
    """``make(path)``, one for all tasks of a Python worker that ask for the same; only the last one asked for is kept."""
    if (make.__name__, path) not in _coder:
        _coder.clear()
        _coder[make.__name__, path] = make(path)
    return _coder[make.__name__, path]


def give_back() -> None:
    """Return freed memory to the system: the allocators of a Python worker keep it, and the worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(work):
    """``work`` of a mapInArrow, which at the end of a task gives back the memory that its batches took."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _LOWER[data]


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the given inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+``
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ U64((salt * 0xD6E8FEB86659FD93) & (2**64 - 1)) if salt else x.copy()
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def _geometric(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _factors(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i modulo 2**64 is the product of the first at i % BLOCK and the second at i // BLOCK, for i up to n."""
    if base not in _block:
        _block[base] = _geometric(BLOCK, base)
    return _block[base], _geometric(n // BLOCK + 1, pow(base, BLOCK, 1 << 64))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    low, high = _factors(n, base)
    return np.multiply.outer(high, low[:n]).ravel()[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """0 and the running sums of byte value times base**place, modulo 2**64, block by block: the sums are all it takes."""
    low, high = _factors(len(data), _BASE)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    for k, a in enumerate(range(0, len(data), BLOCK)):
        own = _TABLE[data[a : a + BLOCK]]
        own *= low[: len(own)]
        own *= high[k]
        own[:1] += total[a : a + 1]
        np.cumsum(own, dtype=np.uint64, out=total[a + 1 : a + 1 + len(own)])
    return total


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text. No copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def runs(data: np.ndarray, offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts: (first, last+1, bytes, offsets from 0)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the total) of the maximal runs of word bytes; no word crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = is_word[data]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[inner - 1] = False
    start = np.flatnonzero(m & ~before)
    return start, np.flatnonzero(m & ~after) + 1, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over random byte values, from prefix sums, then mixed with the length."""
    total = prefix_sums(data)
    low, high = _factors(len(data), _BASE_INV)
    h = (total[end] - total[start]) * low[start & (BLOCK - 1)] * high[start >> BLOCK_BITS]
    return mix(h + (end - start).astype(np.uint64) * U64(0xA24BAED4963EE407))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes; they may cross texts (the caller masks those)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h = h * U64(0x9FB21C651E98DF25) + words[k : k + count]
    return mix(h, n)
