"""Words and hashes of many texts at once, in numpy.

Everything works on UTF-8 bytes: the word classes of this package are byte classes (all
bytes of a non-ASCII character fall on the same side), and ``bytes.lower`` folds A-Z only.
Hashes are 64 bits wide: two different words share one with probability 2**-64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Text handled at a time inside a task: bounds the numpy arrays, whatever the batch is.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64)."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = 0xD6E8FEB86659FD93
MASK64 = (1 << 64) - 1
# Bytes of an 8-byte load that belong to a word with 0..8 bytes left.
LOAD_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# Longer words are hashed one by one.
LONG_WORD = 64


def byte_class(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


@dataclass
class Words:
    """Words of several texts: word ``i`` is ``buffer[begin[i]:end[i]]``; the words of text
    ``d`` are ``first[d]:first[d + 1]``; text ``d`` begins at byte ``at[d]``."""

    buffer: bytes
    begin: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    at: np.ndarray


def hash_slices(padded: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``padded[begin:end]`` for arrays of both, eight bytes a step. ``padded`` has
    eight bytes behind the last slice."""
    load = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = end - begin
    out = length.astype(np.uint64)
    on, step = slice(None), 0
    while True:
        rest = np.minimum(length[on] - step, 8)
        value = out[on] ^ (load[begin[on] + step] & LOAD_MASKS[rest])
        value = value * np.uint64(STEP)
        out[on] = value ^ (value >> np.uint64(29))
        step += 8
        on = np.flatnonzero((length > step) & (length <= LONG_WORD))
        if not len(on):
            break
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(padded[begin[i] : end[i]], digest_size=8).digest(), "little")
    return mix(out)


def hash_words(texts: list[bytes], word: np.ndarray = NOT_SPACE) -> Words:
    """Splits ``texts`` into words of the byte class ``word`` and hashes each word."""
    buffer = b"\n".join(texts) + b"\n"
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    flag = word[np.frombuffer(buffer, np.uint8)].view(np.int8)
    edges = np.flatnonzero(np.diff(flag, prepend=np.int8(0)))
    begin, end = edges[0::2], edges[1::2]
    hashes = hash_slices(buffer + bytes(8), begin, end) if len(begin) else np.empty(0, np.uint64)
    return Words(buffer, begin, end, hashes, np.searchsorted(begin, at), at)


def take_words(words: Words, at: np.ndarray) -> pa.BinaryArray:
    """The bytes of the words ``at``."""
    begin, size = words.begin[at], words.end[at] - words.begin[at]
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    place = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
    data = np.frombuffer(words.buffer, np.uint8)[place]
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every ``width`` consecutive word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # ``block`` holds windows of ``size`` words; the bits of ``width`` say which to join.
    out, done, block, size, scale, shift = np.zeros(n, np.uint64), 0, hashes, 1, 1, STEP
    while True:
        if width & size:
            out = out + block[done : done + n] * np.uint64(scale)
            done += size
            scale = scale * shift & MASK64
        if size * 2 > width:
            return mix(out)
        block = block[:-size] + block[size:] * np.uint64(shift)
        shift = shift * shift & MASK64
        size *= 2


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window at every word, and whether it lies inside one text."""
    n = len(words.hashes)
    full = np.zeros(n, np.uint64)
    got = rolling(words.hashes, width)
    full[: len(got)] = got
    last = np.repeat(words.first[1:], np.diff(words.first))
    return full, np.arange(n) + width <= last


def text_bytes(column: pa.Array) -> list[bytes]:
    """Values of a string column as bytes; NULL is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Hands memory that this worker has freed back to the system. A worker serves one stage after
    another, and the allocators keep what the largest of them needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches, column: str, size: int = CHUNK_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about ``size`` bytes of text (one text at least). Only the
    texts of one slice are there as Python values."""
    give_back()

    def cut(batch: pa.RecordBatch, low: int, high: int) -> tuple[pa.RecordBatch, list[bytes]]:
        part = batch.slice(low, high - low)
        texts = text_bytes(part.column(column))
        return part, [t.lower() for t in texts] if lower else texts

    for batch in batches:
        low = total = 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total and total + length > size:
                yield cut(batch, low, i)
                low, total = i, 0
            total += length
        if low < batch.num_rows:
            yield cut(batch, low, batch.num_rows)
    give_back()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base += "_"
    return base
