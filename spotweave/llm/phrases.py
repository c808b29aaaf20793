"""Phrases of two to five words that stand together more often than their parts would.

Stripes: the key is a prefix of one to four words, the value a counter of the words that follow
it. A task sends one stripe per prefix; equal prefixes meet in one partition, where their counters
are added elementwise. A merged stripe gives the frequent extensions of its prefix (the candidates,
one word longer) and the largest one, which tells whether a longer phrase subsumes the prefix. The
prefix' own total is its cell in the stripe of the prefix that is a word shorter.

Stripes hold only cells that can be frequent. Before, lengths are counted one by one by 64-bit
hashes, a number per different phrase and task, where a phrase counts only if both phrases
that it has less a word are frequent. What is frequent is known to the tasks by a bit map per length
of at most ``FILTER_BITS`` bits; a false positive costs a cell, never a count. A prefix that holds
over 1 / ``HOT`` of all words has its stripe split by follower.

The counts returned are those of the stripes, where words and phrases are told apart by their
bytes. Two phrases of one hash only add a false positive. A NULL language is ``und``; a
NULL text is empty; repeated rows count each; other columns are ignored; an empty table gives
no rows; a text of many megabytes is cut between pieces before it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from spotweave.llm.ngrams import FLUSH as FLUSH_HASHES, Tally
from spotweave.llm.text import byte_class, chunks, hash_slices, mix, rolling
from spotweave.session import cut_lineage

LEAST = 100
LONGEST = 5
TOP = 2000
FILTER_BITS = 1 << 28
# Cells a task collects before it sends them on.
FLUSH = 300_000
HOT = 1000
PARTS = 64
CHUNK = 4 << 20

SEPARATES = byte_class(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
IN_WORD = byte_class(lambda b: b not in b" \t.,;:!?" and not 0x0A <= b <= 0x0D)
STRIPE = "lang string, words int, prefix string, part int, cells array<struct<word: string, n: bigint>>"


class Chunk:
    """Words of some texts: exact number, hash, language and end of the piece of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        flag = IN_WORD[buffer]
        edges = np.flatnonzero(np.diff(flag.view(np.int8), prepend=np.int8(0)))
        begin, end = edges[0::2], edges[1::2]
        self.size = n = len(begin)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(buffer[flag])]).dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_string())
        self.word = coded.indices.to_numpy().astype(np.int64)
        bounds = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(self.words) + 1] if n else np.zeros(1, np.int64)
        bytes_ = (coded.dictionary.buffers()[2].to_pybytes() if n else b"") + bytes(8)
        self.own_hash = hash_slices(bytes_, bounds[:-1], bounds[1:]) if n else np.empty(0, np.uint64)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.langs = sorted(set(langs))
        number = {name: i for i, name in enumerate(self.langs)}
        words_of = np.diff(np.searchsorted(begin, at))
        self.lang = np.repeat(np.array([number[name] for name in langs], np.int64), words_of)
        # Two words are in one piece if no separator (one ends each text) lies between them.
        breaks = np.flatnonzero(SEPARATES[buffer])
        piece = np.searchsorted(breaks, begin)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.empty(0, np.int64)
        self.piece_end = np.repeat(last + 1, np.diff(last, prepend=-1))

    def hashes(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on, in its language."""
        out = np.zeros(self.size, np.uint64)
        got = rolling(self.own_hash[self.word], length)
        out[: len(got)] = got
        salt = hash_slices("".join(self.langs).encode() + bytes(8), *_bounds(self.langs))
        return mix(out ^ salt[self.lang]) if self.size else out

    def grown(self, length: int, known: "Filter") -> np.ndarray:
        """Places of phrases of ``length`` words whose two parts of a word less ``known`` holds."""
        held = (np.arange(self.size) + length - 1 <= self.piece_end) & known.holds(self.hashes(length - 1))
        at = np.flatnonzero(held[:-1] & held[1:]) if self.size else np.empty(0, np.int64)
        return at[at + length <= self.piece_end[at]]

    def text(self, at: np.ndarray, length: int) -> pa.Array:
        words = [self.words.take(pa.array(self.word[at + k])) for k in range(length)]
        return words[0] if length == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))

    def names(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[at]))


def _bounds(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(name.encode()) for name in names]).astype(np.int64)
    return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` in parts of about ``size`` bytes, cut behind a separator."""
    low = 0
    while len(text) - low > size:
        found = np.flatnonzero(SEPARATES[np.frombuffer(text, np.uint8, offset=low + size)][: 1 << 16])
        high = low + size
        while not len(found) and high + (1 << 16) < len(text):  # a piece without end
            high += 1 << 16
            found = np.flatnonzero(SEPARATES[np.frombuffer(text, np.uint8, min(1 << 16, len(text) - high), high)])
        if not len(found):
            break
        cut = high + int(found[0]) + 1
        yield text[low:cut]
        low = cut
    yield text[low:]


def read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Chunks of the texts of ``(lang, text)`` batches."""
    for part, texts in chunks(batches, "text", CHUNK, lower=True):
        langs = part.column("lang").to_pylist()
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK:
            for piece in _pieces(texts[0], CHUNK):
                yield Chunk([piece], langs)
        else:
            yield Chunk(texts, langs)


def count_words(rows: DataFrame) -> DataFrame:
    """``(lang, word, n, h)`` over all texts; the row without a word has all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in read_chunks(batches):
            if not chunk.size:
                continue
            _, at, n = np.unique(chunk.lang * len(chunk.words) + chunk.word, return_index=True, return_counts=True)
            total = np.bincount(chunk.lang, minlength=len(chunk.langs))
            lang = pa.concat_arrays([chunk.names(at), pa.array(chunk.langs, pa.string())])
            word = pa.concat_arrays([chunk.text(at, 1).cast(pa.string()), pa.nulls(len(total), pa.string())])
            h = np.append(chunk.hashes(1)[at].view(np.int64), np.zeros(len(total), np.int64))
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(np.append(n, total)), pa.array(h)], names=["lang", "word", "n", "h"])

    counted = rows.mapInArrow(run, "lang string, word string, n bigint, h bigint")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("h").alias("h"))


class Filter:
    """Bits of the hashes of frequent phrases: a phrase without a set bit is not frequent."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def build_filter(frequent: DataFrame, most: int = FILTER_BITS) -> Filter | None:
    """Bit map of ``frequent(h)``, None if there is no row. Its size follows from the rows, up to
    ``most`` bits: that much reaches the driver and no more."""
    count = frequent.count()
    if not count:
        return None
    size = min(most, max(1 << 20, 1 << (16 * count).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    parts = frequent.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = parts.toArrow()  # 4 KB a row
    bits = np.zeros((size >> 15, 4096), np.uint8)
    for b, own in zip(found.column("b").to_pylist(), found.column("bits").to_pylist()):
        bits[b - 1] = np.frombuffer(own, np.uint8)
    return Filter(bits.ravel(), size)


def count_hashes(rows: DataFrame, length: int, known: Filter) -> DataFrame:
    """``(h, n)`` of the phrases of ``length`` words whose two parts of a word less ``known`` holds."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = tally.take()
            for low in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + (1 << 18)].view(np.int64)), pa.array(n[low : low + (1 << 18)])], names=["h", "n"])

        for chunk in read_chunks(batches):
            at = chunk.grown(length, sent.value)
            if len(at):
                tally.add(*np.unique(chunk.hashes(length)[at], return_counts=True))
            if tally.size > FLUSH_HASHES:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def local_stripes(rows: DataFrame, known: list[Filter], hot: np.ndarray) -> DataFrame:
    """Stripes of all prefixes: ``known[k]`` holds the frequent phrases of k + 2 words. A task adds up
    its cells before it sends them."""
    sent = rows.sparkSession.sparkContext.broadcast((known, hot))
    keys = ["lang", "words", "prefix", "part", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = sent.value
        held: list[pa.Table] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            added = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum")]).sort_by([(k, "ascending") for k in keys[:4]]).combine_chunks()
            columns = {k: added.column(k).combine_chunks() for k in keys}
            change = np.zeros(len(added), bool)
            change[:1] = True
            for k in keys[:4]:
                own = columns[k].dictionary_encode().indices.to_numpy()
                change[1:] |= own[1:] != own[:-1]
            head = np.flatnonzero(change)
            cells = pa.StructArray.from_arrays([columns["word"], added.column("n_sum").combine_chunks()], names=["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(added)).astype(np.int32)), cells)
            at = pa.array(head)
            yield pa.RecordBatch.from_arrays([*(columns[k].take(at) for k in keys[:4]), lists], names=[*keys[:4], "cells"])

        for chunk in read_chunks(batches):
            for k, filter_ in enumerate(known):
                length = k + 2
                whole = chunk.hashes(length)
                at = np.flatnonzero((np.arange(chunk.size) + length <= chunk.piece_end) & filter_.holds(whole))
                if not len(at):
                    continue
                phrase = chunk.lang[at]
                for step in range(length):
                    phrase = np.unique(phrase * len(chunk.words) + chunk.word[at + step], return_inverse=True)[1]
                _, first, n = np.unique(phrase, return_index=True, return_counts=True)
                at = at[first]
                part = np.where(np.isin(chunk.hashes(length - 1)[at], hot), whole[at] % np.uint64(PARTS), 0)
                held.append(
                    pa.table(
                        {
                            "lang": chunk.names(at),
                            "words": pa.array(np.full(len(at), length - 1, np.int32)),
                            "prefix": chunk.text(at, length - 1).cast(pa.string()),
                            "part": pa.array(part.astype(np.int32)),
                            "word": chunk.text(at + length - 1, 1).cast(pa.string()),
                            "n": pa.array(n),
                        }
                    )
                )
                waiting += len(at)
            if waiting > FLUSH:
                yield from flush()
                held, waiting = [], 0
        yield from flush()

    return rows.mapInArrow(run, STRIPE)


def merge_stripes(stripes: DataFrame, least: int) -> DataFrame:
    """``(lang, words, prefix, part, best, cells)``: the sum of all stripes of a prefix, its cells of at
    least ``least`` and the largest of them."""
    # Stripes move once, by prefix; adding up their cells keeps that partitioning.
    met = stripes.repartition("lang", "prefix", "part").select("lang", "words", "prefix", "part", F.inline("cells"))
    added = met.groupBy("lang", "words", "prefix", "part", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return added.groupBy("lang", "words", "prefix", "part").agg(F.max("n").alias("best"), F.collect_list(F.struct("word", "n")).alias("cells"))


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    words = cut_lineage(count_words(rows).where(F.col("word").isNull() | (F.col("n") >= least)))
    sizes = words.where("word IS NULL").select("lang", "n")
    every = sizes.agg(F.sum("n")).first()[0] or 0
    single = words.where(F.col("word").isNotNull() & (F.col("n") >= least))
    known, frequent = [build_filter(single)], [single.select("h", "n")]
    while known[-1] and len(known) < longest:
        counted = cut_lineage(count_hashes(rows, len(known) + 1, known[-1]).where(F.col("n") >= least))
        known.append(build_filter(counted))
        frequent.append(counted)
    known = [f for f in known[1:] if f]
    if not known:
        return docs.sparkSession.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    # Fewer than HOT of each length exist.
    hot = [r["h"] for f in frequent[:-1] for r in f.where(F.col("n") * HOT > every).select("h").collect()]
    stripes = cut_lineage(merge_stripes(local_stripes(rows, known, np.array(hot, np.int64).view(np.uint64)), least))
    found = stripes.select("lang", "words", "prefix", F.inline("cells"))
    found = cut_lineage(found.select("lang", F.concat_ws(" ", "prefix", "word").alias("phrase"), F.col("n").alias("a"), (F.col("words") + 1).alias("words")))
    parts = single.select("lang", F.col("word").alias("phrase"), F.col("n").alias("f")).unionByName(found.select("lang", "phrase", F.col("a").alias("f")))
    best = stripes.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("best").alias("right"))

    # A phrase inside a longer one of the same count is inside one that is a word longer. On the
    # right that is the largest cell of its stripe, on the left a candidate's last words.
    last = F.expr("substring_index(phrase, ' ', 1 - words)")
    left = found.where(F.col("words") > 2).groupBy("lang", last.alias("phrase")).agg(F.max("a").alias("left"))
    kept = found.join(best, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(F.greatest("right", "left"), F.lit(0)) < F.col("a")).select("lang", "phrase", "a", "words")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring_index(phrase, ' ', k - words)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # One row per language.
    cuts = cuts.join(F.broadcast(sizes), "lang")
    wide = {c: F.col(c).cast("decimal(17,0)") for c in "alrn"}
    cuts = cuts.withColumn("above", 1000 * wide["a"] * wide["n"]).withColumn("below", wide["l"] * wide["r"]).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
