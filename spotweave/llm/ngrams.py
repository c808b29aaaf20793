"""Byte n-grams of texts as numbers, their counts in Spark, and sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spotweave.llm.text import chunks, mix

# Distinct n-grams a task collects before it sends them on.
FLUSH = 800_000


def mask(length: int) -> np.uint64:
    return np.uint64((1 << (8 * length)) - 1)


class HashArray:
    """Positions of 64-bit keys: hashes in sorted order under a table of their leading bits."""

    def __init__(self, keys: np.ndarray):
        hashes = mix(keys.astype(np.uint64, copy=False))
        self.order = np.argsort(hashes).astype(np.int32)
        self.bits = max(1, len(keys).bit_length())
        sorted_ = hashes[self.order]
        lead = (sorted_ >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange(1 << self.bits)).astype(np.int32)
        self.sorted = np.append(sorted_, np.uint64(2**64 - 1))
        self.order = np.append(self.order, np.int32(-1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the array given at first, -1 for an unknown key."""
        wanted = mix(keys)
        at = self.start[(wanted >> np.uint64(64 - self.bits)).astype(np.int64)]
        got = self.sorted[at]
        less = np.flatnonzero(got < wanted)
        while len(less):
            at[less] += 1
            got[less] = self.sorted[at[less]]
            less = less[got[less] < wanted[less]]
        return np.where(got == wanted, self.order[at], -1)


class Tally:
    """Counts of sorted 64-bit keys, merged when what came in since exceeds what is there."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    @property
    def size(self) -> int:
        return len(self.keys) + self.waiting

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.new.append((keys, n))
        self.waiting += len(keys)
        if self.waiting > max(len(self.keys), 200_000):
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        n = np.concatenate([self.n, *(c for _, c in self.new)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.n = keys[head], np.add.reduceat(n, head) if len(head) else n
        self.new, self.waiting = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.n.astype(np.int64)
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def grams(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``length`` bytes up to and with each symbol of each text, packed into a number, and
    the first symbol of each text. A text's symbols are its bytes and an end, 0; zeros precede
    it. A zero byte inside a text counts as 1."""
    pad = bytes(length - 1)
    raw = np.frombuffer(pad + b"".join(t.replace(b"\0", b"\1") + bytes(length - 1) for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    n = len(raw) - length + 1
    packed = np.zeros(n, np.uint64)
    for i in range(length):
        packed <<= np.uint64(8)
        packed |= raw[i : i + n]
    # Between two texts there are ``length - 2`` places that are no symbol.
    place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(texts)) * (length - 2), sizes)
    return packed[place], np.cumsum(sizes) - sizes


def count_grams(rows: DataFrame, length: int, lower: bool = True, keyed: bool = False) -> DataFrame:
    """``(key, gram, n)`` summed over all rows of ``rows(key?, text)``. Each task adds up its
    own n-grams first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Tally] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, tally in held.items():
                every, n = tally.take()
                for low in range(0, len(every), 1 << 18):
                    part, k = every[low : low + (1 << 18)], n[low : low + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(k)], names=["key", "gram", "n"])

        for part, texts in chunks(batches, "text", lower=lower):
            keys = part.column("key").to_pylist() if keyed else [""] * len(texts)
            by_key: dict[str, list[bytes]] = {}
            for key, text in zip(keys, texts):
                by_key.setdefault(key or "", []).append(text)
            for key, own in by_key.items():
                held.setdefault(key, Tally()).add(*np.unique(grams(own, length)[0], return_counts=True))
            if sum(t.size for t in held.values()) > FLUSH:
                yield from flush()
        yield from flush()

    from pyspark.sql import functions as F

    return rows.mapInArrow(run, "key string, gram bigint, n bigint").groupBy("key", "gram").agg(F.sum("n").alias("n"))


def roll_up(counts: DataFrame, length: int, distinct: bool = False) -> DataFrame:
    """``(key, length, gram, n)`` for all lengths from 1 to ``length``: a shorter n-gram occurs as
    often as its extensions to the left, since zeros precede every text. ``distinct`` counts
    the different extensions instead."""
    from pyspark.sql import functions as F

    out = None
    for k in range(length, 0, -1):
        cut = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        if k < length:
            counts = counts.groupBy("key", cut.alias("gram")).agg(F.count(F.lit(1)).alias("n") if distinct else F.sum("n").alias("n"))
        own = counts.select("key", F.lit(k).alias("length"), "gram", "n")
        out = own if out is None else out.unionByName(own)
    return out
