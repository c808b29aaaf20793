"""Benchmark decontamination with an FM-index per shard of documents.

A shard is the run of documents a task holds at a time. Its text is projected on the
benchmark's words: every other word, and every document boundary, ends a run. Runs are
indexed together: suffix order, Burrows-Wheeler transform, wavelet tree with rank counts, and
the suffix places at every ``SAMPLE``-th place of a run and at its first word. All benchmark windows are searched
backwards at once; the rows found are walked back to a sampled place; the places become
word spans, merged per document. Documents are never shuffled.

The benchmark's windows travel to the tasks in slices of at most ``SLICE_BYTES`` each, however large
the benchmark is; more slices mean more passes over the documents.

Defined results: a NULL or empty text has no words and no hits; an item without words has no
window; repeated rows each get a row; repeated item ids count once; items with a NULL id hit
words but name no item; other columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.text import ALNUM, Words, chunks, hash_words
from spotweave.session import cut_lineage

WINDOW = 10
SHARD_BYTES = 2 << 20
SAMPLE = 8
SLICE_BYTES = 32 << 20
FOUND = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"


class WaveletTree:
    """Rank of a symbol in a sequence, one bit vector per level; counts are kept for every
    64 bits, the bits inside a word are counted at query time."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.words, self.counts, self.zeros = levels, [], [], []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            ones = bit.astype(bool)
            self.zeros.append(int(len(symbols) - ones.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of ``symbol`` among the first ``at`` entries, for arrays of both."""
        low, high = np.zeros_like(at), at
        for i in range(self.levels):
            one = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = self._ones(i, low), self._ones(i, high)
            low = np.where(one, self.zeros[i] + a, low - a)
            high = np.where(one, self.zeros[i] + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for i in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            one = ((self.words[i][word] >> rest) & np.uint64(1)).astype(bool)
            before = self._ones(i, at)
            symbol = symbol * 2 + one
            at = np.where(one, self.zeros[i] + before, at - before)
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. 0 in ``text`` ends a run: such suffixes order by
    place, so a comparison never passes the end of a run. Only suffixes that are not yet
    alone in their class are sorted again."""
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    # A class is named by the row of its first member; each end is a class of its own.
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    new = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    new[:n_ends] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(new), n))
    open_rows = np.flatnonzero(np.repeat(size > 1, size))
    step = 1
    while len(open_rows):
        places = order[open_rows]
        mine, next_ = rank[places], rank[places + step]  # a run's end lies before: place + step is inside
        again = np.argsort(mine * (n + 1) + next_, kind="stable")
        places, mine, next_ = places[again], mine[again], next_[again]
        order[open_rows] = places
        new = np.concatenate([[True], (mine[1:] != mine[:-1]) | (next_[1:] != next_[:-1])])
        rank[places] = open_rows[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        open_rows = open_rows[np.repeat(size > 1, size)]
        step *= 2
    return order


class FMIndex:
    """Index of ``text`` (symbols above 0, runs ended by 0; the last symbol is 0)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = suffix_order(text)
        before = text[order - 1]  # the text is a ring; what precedes a run's start is an end
        self.tree = WaveletTree(before, max(1, int(n_symbols).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        places = np.arange(n)
        starts = np.concatenate([[True], text[:-1] == 0])
        run_start = np.maximum.accumulate(np.where(starts, places, 0))
        sampled = (places - run_start) % SAMPLE == 0
        kept = sampled[order]
        self.n, self.sample_rank, self.sample = n, np.concatenate([[0], np.cumsum(kept)]), order[kept]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of every pattern, by backward search over all patterns at once."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        size = np.array([len(p) for p in patterns])
        matrix = np.zeros((len(patterns), int(size.max(initial=0))), np.int64)
        for i, p in enumerate(patterns):
            matrix[i, matrix.shape[1] - len(p) :] = p
        for back in range(1, matrix.shape[1] + 1):
            on = np.flatnonzero((size >= back) & (low < high))
            if not len(on):
                break
            s = matrix[on, -back]
            low[on], high[on] = self.less[s] + self.tree.rank(s, low[on]), self.less[s] + self.tree.rank(s, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back to the nearest sampled place."""
        rows, out = rows.copy(), np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        on = np.arange(len(rows))
        while len(on):
            here = rows[on]
            at = self.sample_rank[here]
            done = self.sample_rank[here + 1] > at
            out[on[done]] = self.sample[at[done]] + steps[on[done]]
            on, here = on[~done], here[~done]
            s = self.tree.access(here)
            rows[on] = self.less[s] + self.tree.rank(s, here)
            steps[on] += 1
        return out


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(item, words)``: every window of ``window`` consecutive words of an item, as word
    hashes; an item with fewer words, but some, is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", lower=True):
            words = hash_words(texts, ALNUM)
            names, rows = part.column("item").to_pylist(), []
            for i, name in enumerate(names):
                h = words.hashes[words.first[i] : words.first[i + 1]].view(np.int64)
                rows += [(name, h[j : j + window].tolist()) for j in range(max(1, len(h) - window + 1)) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["item", "words"])

    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return named.mapInArrow(cut, "item string, words array<bigint>")


class Needles:
    """The windows of one slice, with a small number for each distinct word."""

    def __init__(self, words: list[list[int]], items: list[list[str]]):
        flat = np.array([w for row in words for w in row], np.int64).view(np.uint64)
        self.vocabulary = np.unique(flat)
        ids = np.searchsorted(self.vocabulary, flat) + 1
        self.patterns = np.split(ids, np.cumsum([len(row) for row in words])[:-1]) if words else []
        self.items = items

    def project(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def hit_windows(words: Words, needles: Needles) -> tuple[np.ndarray, np.ndarray]:
    """Word places and pattern numbers of all occurrences in a shard, in place order."""
    ids = needles.project(words.hashes)
    # A boundary 0 in front of every document, then no two 0s in a row.
    where = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    text = np.zeros(len(ids) + len(words.first), np.int32)
    at = np.arange(len(ids)) + where + 1
    text[at] = ids
    word_of = np.full(len(text), -1, np.int64)
    word_of[at] = np.arange(len(ids))
    keep = np.concatenate([(text[:-1] != 0) | (text[1:] != 0), [True]])
    text, word_of = text[keep], word_of[keep]
    if not needles.patterns or len(text) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = FMIndex(text, len(needles.vocabulary))
    low, high = index.search(needles.patterns)
    size = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(size)), size)
    rows = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[which]
    places = word_of[index.locate(rows)]
    order = np.argsort(places, kind="stable")
    return places[order], which[order]


def _search(needles: Needles, batches: Iterator[pa.RecordBatch], carried: list[str], last: bool) -> Iterator[pa.RecordBatch]:
    """One pass: adds the slice's spans and items to those of earlier passes; the last pass
    adds what is left of a text of which something is cut."""
    lengths = np.array([len(p) for p in needles.patterns], np.int64)
    for part, texts in chunks(batches, "text", SHARD_BYTES):
        words = hash_words([t.lower() for t in texts], ALNUM)
        places, which = hit_windows(words, needles)
        doc = np.searchsorted(words.first, places, "right") - 1
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        earlier = {name: part.column(name).to_pylist() for name in ("spans", "items") if name in part.schema.names}
        spans, items, kept = [], [], []
        for d in range(len(texts)):
            p, q = places[edges[d] : edges[d + 1]], which[edges[d] : edges[d + 1]]
            base = words.first[d]
            own = list(zip((p - base).tolist(), (p - base + lengths[q]).tolist()))
            names = {name for k in np.unique(q) for name in needles.items[k] if name is not None}
            if earlier:
                own = sorted([*own, *((x["start"], x["end"]) for x in earlier["spans"][d])])
                names.update(earlier["items"][d])
            spans.append(merge(own))
            items.append(sorted(names))
            if last:
                bytes_of = [(words.begin[base + a] - words.at[d], words.end[base + b - 1] - words.at[d]) for a, b in spans[-1]]
                kept.append(_cut(texts[d], bytes_of) if bytes_of else None)
        pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        columns = {name: part.column(name) for name in carried} | {
            "n_words": pa.array(np.diff(words.first), pa.int64()),
            "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pairs),
            "items": pa.array(items, pa.list_(pa.string())),
        }
        if last:
            columns["left"] = pa.array(kept, pa.string())
        else:
            columns["text"] = part.column("text")
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals given by increasing starts, as maximal intervals."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(text: bytes, byte_spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in byte_spans:
        out.append(text[at:a])
        at = b
    return b"\n".join([*out, text[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ("doc_id",), window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row of ``docs`` the columns ``carry``, the number of words, merged word spans of
    benchmark windows, the sorted ids of the items found, and ``left``, the text without the
    spans (NULL where nothing is cut)."""
    spark = docs.sparkSession
    found = benchmark_windows(items, item_id, item_text, window)
    distinct = cut_lineage(found.groupBy("words").agg(F.collect_set("item").alias("items")))
    names = F.aggregate("items", F.lit(0), lambda total, x: total + F.length(x) + 8)
    size = distinct.agg(F.sum(8 * F.size("words") + names).alias("bytes")).first()["bytes"] or 0
    n = int(size // slice_bytes) + 1
    # Carried columns get names of their own, whatever they are called.
    carried = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*(F.col(c).alias(a) for c, a in zip(carry, carried)), F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{a} {rows.schema[a].dataType.simpleString()}" for a in carried)
    for i in range(n):
        mine = distinct.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i).collect()  # about slice_bytes
        sent = spark.sparkContext.broadcast(Needles([r["words"] for r in mine], [r["items"] for r in mine]))
        last = i == n - 1
        schema = ", ".join(filter(None, [kinds, FOUND, "left string" if last else "text string"]))
        rows = rows.mapInArrow(lambda batches, sent=sent, last=last: _search(sent.value, batches, carried, last), schema)
        if not last:  # one slice in memory at a time
            rows = cut_lineage(rows)
    return rows.select(*(F.col(a).alias(c) for c, a in zip(carry, carried)), "n_words", "spans", "items", "left")


def cut_out(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` without the benchmark passages: ``text`` loses them, ``n_chars`` follows where
    a text is cut, and a row of which no word is left goes. Other rows are unchanged."""
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}  # apart from the columns of the findings
    found = decontaminate(docs.select(*(F.col(c).alias(a) for c, a in own.items())), items, own[text], carry=tuple(own.values()))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    kept = found.where((F.size("spans") == 0) | (gone < F.col("n_words")))
    new = {c: F.col(a) for c, a in own.items()}
    new[text] = F.coalesce("left", own[text])
    if n_chars in new:
        new[n_chars] = F.when(F.col("left").isNotNull(), F.length("left").cast(docs.schema[n_chars].dataType)).otherwise(new[n_chars])
    return kept.select(*(value.alias(c) for c, value in new.items()))
