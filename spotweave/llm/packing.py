"""Tokenising and vector best-fit packing of documents into training sequences.

A document is its token ids and an end id; one that exceeds a sequence is cut into full
pieces, the first of which may be shorter. Pieces are dealt at random (by hash) to cells of
about ``CELL_ROWS`` pieces, a number that follows from the row count, and each cell is packed
on its own: longest first, each piece into the open sequence that the residual vector
(tokens, documents, attention cost) picks under every capacity. A cell leaves
about one sequence partly filled, so the loss against one global packing shrinks with
``CELL_ROWS`` and does not grow with the data.

The name of an added token in a text is that token, as the ``tokenizers`` library reads it.

Defined results: a NULL text is empty and gives one piece with the end id; repeated rows give
repeated pieces; NULL ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

LENGTH = 2048
END_ID = 0
CELL_ROWS = 8_000
# Characters of a text encoded at a time.
TEXT_SLICE = 1 << 18
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Attention cost is the sum of squared piece lengths. The default
    limits of documents and cost are those that the tokens imply; ``weights`` scale the
    dimensions in the score, ``rule`` is ``norm`` (smallest weighted residual) or ``dot``
    (largest weighted product of residual and demand)."""

    tokens: int = LENGTH
    documents: int = LENGTH
    attention: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


class Vocabulary:
    """Ids of texts by a ``tokenizers`` file. Its merges are applied by tiktoken, whose ids equal
    the file's ranks: the same ids in a fraction of the time."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        # Ids of the added tokens by their names; at one place the longest name counts.
        self.named = {t["content"]: t["id"] for t in model["added_tokens"]}
        options = ["single_word", "lstrip", "rstrip", *(["normalized"] if model.get("normalizer") else [])]
        if any(t.get(o) for t in model["added_tokens"] for o in options):
            raise ValueError(f"added tokens with one of {options} are not supported")
        named = self.named
        self.names = re.compile("|".join(map(re.escape, sorted(named, key=len, reverse=True)))) if named else None
        visible = _visible_bytes()
        ranks = {bytes(visible[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in named}
        self.encoding = tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()


# Fixed value: the split pattern of the byte-level tokenizer.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The tokenizer always splits before a space between two characters that are no white space.
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def _visible_bytes() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: str, vocabulary: Vocabulary, size: int = TEXT_SLICE) -> bytes:
    """Ids of ``text`` without added tokens as little-endian 32-bit numbers. A long text is
    encoded in slices of about ``size`` characters, which bounds the ids held as Python numbers."""
    out, low = [], 0
    while len(text) - low > size and (cut := SAFE_CUT.search(text, low + size)):
        out.append(vocabulary.encode(text[low : cut.start()]))
        low = cut.start()
    return b"".join([*out, vocabulary.encode(text[low:])])


def encode_document(text: str, vocabulary: Vocabulary) -> bytes:
    """Ids of ``text``; names of added tokens split it first."""
    if vocabulary.names is None:
        return encode(text, vocabulary)
    out, done = [], 0
    for found in vocabulary.names.finditer(text):
        out += [encode(text[done : found.start()], vocabulary), vocabulary.named[found.group()].to_bytes(4, "little")]
        done = found.end()
    return b"".join([*out, encode(text[done:], vocabulary)])


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces of at most ``length`` ids; ``ids`` holds little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                out = []
                for name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode_document(content or "", vocabulary) + END_ID.to_bytes(4, "little")
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    out += [(name, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, room: Capacity = Capacity()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest piece first."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    limit = np.array([room.tokens, room.documents, room.attention], float)
    weight = np.array(room.weights) / (limit * limit)
    left = np.empty((3, n))  # residual of each open sequence
    name = np.empty(n, np.int64)
    n_open = n_all = 0
    smallest = lengths.min(initial=room.tokens)
    for at, i in enumerate(order.tolist()):
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        if (need > limit).any():
            raise ValueError(f"a piece of {size} tokens exceeds a sequence's capacity")
        res = left[:, :n_open]
        fits = np.flatnonzero((res[0] >= size) & (res[1] >= 1) & (res[2] >= need[2]))
        if len(fits):
            can = res[:, fits]
            if room.rule == "norm":
                rest = can - need[:, None]
                best = int(np.argmin(weight @ (rest * rest)))
            else:
                best = int(np.argmax((weight * need) @ can))
            k = int(fits[best])
        else:
            k = n_open
            left[:, k] = limit
            name[k] = n_all
            n_open, n_all = n_open + 1, n_all + 1
        sequence[i], offset[i] = name[k], room.tokens - left[0, k]
        left[:, k] -= need
        if left[0, k] < smallest or left[1, k] < 1:  # full: the last open one takes its place
            n_open -= 1
            left[:, k], name[k] = left[:, n_open], name[n_open]
    return sequence, offset


def pack(pieces: DataFrame, room: Capacity = Capacity(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces`` (any columns, with ``length``). The
    cell of a piece follows from its ``doc_id`` and ``piece``; the number of cells from the
    row count."""
    n = max(1, -(-pieces.count() // cell_rows))
    fields = [f for f in pieces.schema.fields]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(key: tuple, cell: pa.Table) -> pa.Table:
        cell = cell.drop_columns("_cell").sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(cell.column("length").to_numpy(), room)
        cell = cell.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence))
        return cell.append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    return dealt.groupBy("_cell").applyInArrow(place, schema)
