"""Removal of word passages that occur earlier in the corpus, by Rabin-Karp window hashes.

Every window of ``width`` words of every document is hashed. Within a task chunk only the
first occurrence of a hash goes on; the others are repeats already. First occurrences travel
in blocks, one per chunk and hash range, to the task of their range, which finds the earliest
place of each hash and returns the repeats in blocks to the documents. A passage held by a third of all
documents thus costs one entry per chunk. Repeated windows merge into maximal intervals,
which are cut. The numbers of ranges and of document buckets follow from the text's size, so
a group of either kind has the same size whatever the corpus is.

Defined results: a NULL or empty text has no words; places are ordered by (id, start), so rows
that repeat an id and its words are one document, and rows that share an id but not their
words share their removed starts; a NULL id comes after all ids; other columns are ignored;
an empty table gives no rows. Different windows share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.text import NOT_SPACE, chunks, hash_words, text_bytes, windows

WIDTH = 20
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
BUCKET_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
BLOCK = "part int, hashes binary, docs binary, rows binary, starts binary"
FLAGS = "bucket int, docs binary, rows binary, starts binary"
RESULT = "doc_id bigint, n_words bigint, removed array<struct<start: int, end: int>>, kept string"


def _put(values: np.ndarray) -> bytes:
    """Compressed numbers; equal bytes of neighbours lie together, high bytes first."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T[::-1])
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _get(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[4:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n)[::-1].T).reshape(-1).view(kind)


def _block(docs: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Places as (distinct ids, number of the id, start)."""
    ids, rows = np.unique(docs, return_inverse=True)
    return [_put(ids), _put(rows.astype(np.int32)), _put(starts.astype(np.int32))]


def _places(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return _get(block["docs"], np.int64)[_get(block["rows"], np.int32)], _get(block["starts"], np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _later(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries in any order: the order by hash, and which of the ordered entries have an earlier
    place with the same hash."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    if not len(head):
        return order, np.empty(0, bool)
    size = np.diff(np.append(head, len(h)))
    d, s = docs[order], starts[order]
    first = np.repeat(np.minimum.reduceat(d, head), size) == d
    start = np.repeat(np.minimum.reduceat(np.where(first, s, np.iinfo(np.int32).max), head), size)
    return order, ~(first & (s == start))


def window_blocks(docs: DataFrame, ranges: int, width: int = WIDTH) -> DataFrame:
    """Blocks of first occurrences per chunk and hash range (``hashes`` set), and per chunk
    one block of places that repeat within it (``hashes`` NULL)."""
    span = -(-(1 << 64) // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", CHUNK_BYTES):
            words = hash_words(texts, NOT_SPACE)
            hashes, inside = windows(words, width)
            size = np.diff(words.first)
            docs_ = np.repeat(_ids(part.column("doc_id")), size)[inside]
            starts = (np.arange(len(hashes)) - np.repeat(words.first[:-1], size))[inside].astype(np.int32)
            hashes = hashes[inside]
            order, later = _later(hashes, docs_, starts)
            own = order[~later]
            keep = hashes[own]
            own = own[np.concatenate([[True], keep[1:] != keep[:-1]])] if len(own) else own  # equal rows count once
            keep, rows = hashes[own], []
            at = np.searchsorted(keep // np.uint64(span) if span < 1 << 64 else keep * np.uint64(0), np.arange(ranges + 1, dtype=np.uint64))
            for r in np.flatnonzero(np.diff(at)).tolist():
                mine = own[at[r] : at[r + 1]]
                rows.append((r, _put(hashes[mine]), *_block(docs_[mine], starts[mine])))
            if later.any():
                mine = np.sort(order[later])
                rows.append((int(hashes[mine[0]] % np.uint64(ranges)), None, *_block(docs_[mine], starts[mine])))
            if rows:
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "hashes", "docs", "rows", "starts"])

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK)


def repeated_places(blocks: DataFrame, buckets: int) -> DataFrame:
    """Per hash range: the places that are not the earliest of their hash, and those passed
    through, in one block per document bucket."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        entries = [(_get(b["hashes"], np.uint64), *_places(b)) for b in got if b["hashes"] is not None]
        repeats = [_places(b) for b in got if b["hashes"] is None]
        if entries:
            hashes, docs, starts = (np.concatenate(x) for x in zip(*entries))
            order, later = _later(hashes, docs, starts)
            # A repeat within a chunk is one of the corpus too, so both kinds are final.
            repeats.append((docs[order[later]], starts[order[later]]))
        docs, starts = (np.concatenate(x) for x in zip(*repeats))
        bucket = bucket_of(docs, buckets)
        order = np.lexsort((starts, docs, bucket))
        docs, starts, bucket = docs[order], starts[order], bucket[order]
        at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, int)
        rows = [(int(bucket[a]), *_block(docs[a:b], starts[a:b])) for a, b in zip(at, at[1:])]
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "docs", "rows", "starts"])

    return blocks.groupBy("part").applyInArrow(run, FLAGS)


def bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of an id; the same number as ``bucket_column``."""
    return ((docs ^ (docs >> 17)) % buckets).astype(np.int32)


def bucket_column(doc_id: str, buckets: int):
    value = F.coalesce(F.col(doc_id), F.lit(int(NO_ID)))
    return F.pmod(value.bitwiseXOR(F.shiftright(value, 17)), F.lit(buckets)).cast("int")


def covered(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals of words in windows that begin at the sorted ``starts``."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + width).tolist()))


def cut_repeats(docs: DataFrame, flags: DataFrame, buckets: int, width: int = WIDTH) -> DataFrame:
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = [_places(b) for b in found.to_pylist()]
        ids, starts = (np.concatenate(x) for x in zip(*places)) if places else (np.empty(0, np.int64), np.empty(0, np.int32))
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        out = []
        names = texts.column("doc_id").combine_chunks()
        for name, key, text in zip(names.to_pylist(), _ids(names).tolist(), text_bytes(texts.column("text").combine_chunks())):
            words = text.split()  # splits at [\x20\x09-\x0D], as bytes do
            a, b = np.searchsorted(ids, [key, key], "left")[0], np.searchsorted(ids, key, "right")
            spans = covered(np.unique(starts[a:b][starts[a:b] + width <= len(words)]), width)
            kept, at = [], 0
            for low, high in spans:
                kept += words[at:low]
                at = high
            out.append((name, len(words), [{"start": x, "end": y} for x, y in spans], b" ".join(kept + words[at:]).decode()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "removed", "kept"])

    left = docs.withColumn("bucket", bucket_column("doc_id", buckets)).groupBy("bucket")
    return left.cogroup(flags.groupBy("bucket")).applyInArrow(run, RESULT)


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: the number of words, the removed word intervals, and the words kept, joined by
    single spaces. A word goes if it lies in a window whose words also occur at an earlier place."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    ranges, buckets = int(size // RANGE_BYTES) + 1, int(size // BUCKET_BYTES) + 1
    flags = repeated_places(window_blocks(rows, ranges, width), buckets)
    return cut_repeats(rows, flags, buckets, width)
