"""Quality rules: counts of a text's form, and perplexity bands per language.

The language model is a modified Kneser-Ney model of ``ORDER``-byte n-grams for each language,
counted in Spark over all distinct texts. Its interpolated log probabilities and back-off weights
are stored in sorted hash arrays, sent to the tasks in shards of bounded size. Per language,
quartiles of the log perplexity over the distinct texts that pass the base rules give the band
``[q1 - SPREAD * (q3 - q1), q3 + SPREAD * (q3 - q1)]``; documents outside are rejected. Copies
of a text thus weigh as one, and each of them is judged.

Defined results: a NULL or empty text has no words and fails the base rules; a NULL language
is a language of its own; repeated rows each get a row; NULL ids are kept; other columns are
ignored; an empty table gives no rows. Lines and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.ngrams import count_grams, roll_up
from spotweave.llm.ppm import SHARD_BYTES, Deferred, Nodes, apply_passes, trie_shards
from spotweave.llm.text import NOT_SPACE, byte_class, hash_slices, hash_words, mix, windows
from spotweave.session import BROADCAST_ROWS, cut_lineage

ORDER = 5
SPREAD = 4.0
LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = byte_class(lambda b: b in b"#*$%&|<>")
HEADS = byte_class(lambda b: b & 0xC0 != 0x80)
LETTERS = byte_class(lambda b: b >= 0x80 or bytes([b]).isalnum())
FORM = dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lexical"], "bigint")


def _again(keys: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def form(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of each text's form, see the base rules."""
    words = hash_words(texts, NOT_SPACE)
    raw = np.frombuffer(words.buffer, np.uint8)
    n = np.diff(words.first)
    doc = np.repeat(np.arange(len(texts)), n)
    below = lambda flags, edges: np.concatenate([[0], np.cumsum(flags)])[edges]
    heads = below(HEADS[raw], np.arange(len(raw) + 1))
    chars = np.bincount(doc, heads[words.end] - heads[words.begin], len(texts))
    letters = below(LETTERS[raw], np.arange(len(raw) + 1))
    lexical = np.bincount(doc[letters[words.end] > letters[words.begin]], minlength=len(texts))
    symbols = np.diff(below(SYMBOLS[raw], words.at))
    # Lines: every text ends in a line feed of the buffer.
    stop = np.flatnonzero(raw == 10)
    start = np.append(0, stop[:-1] + 1)
    line_doc = np.searchsorted(words.at, start, "right") - 1
    has_word = np.searchsorted(words.begin, stop) > np.searchsorted(words.begin, start)
    start, stop, line_doc = start[has_word], stop[has_word], line_doc[has_word]
    lines = hash_slices(words.buffer + bytes(8), start, stop) ^ mix(line_doc.astype(np.uint64))
    dup_lines = np.bincount(line_doc[_again(lines)], minlength=len(texts))
    # Words of three-word windows that occur twice or more in their text.
    full, inside = windows(words, 3)
    at = np.flatnonzero(inside)
    keys = full[at] ^ mix(doc[at].astype(np.uint64))
    _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    covered = np.zeros(len(words.hashes), bool)
    for i in range(3):
        covered[twice + i] = True
    repeats = np.bincount(doc[covered], minlength=len(texts))
    return {"n_words": n, "word_chars": chars.astype(np.int64), "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats, "n_lexical": lexical}


class KneserNey(Nodes):
    """Modified Kneser-Ney in back-off form: every counted n-gram has its interpolated
    probability, every context a weight for the symbols it has not seen."""

    def __init__(self, lengths, packed, counts, depth, shard, shards, discounts: np.ndarray):
        super().__init__(lengths, packed, counts, depth, shard, shards)
        seen = self.n > 0
        cut = np.zeros(len(self.n))
        cut[seen] = discounts[self.lengths[seen].astype(int), np.minimum(self.n[seen], 3).astype(int)]
        total = np.bincount(self.context[seen], self.n[seen], self.root + 1)
        weight = np.bincount(self.context[seen], cut[seen], self.root + 1)
        weight = np.where(total > 0, weight / np.maximum(total, 1), 1.0)
        p = np.zeros(self.root + 1)
        p[self.root] = 1 / 256
        for k in range(1, depth + 2):
            on = np.flatnonzero(seen & (self.lengths == k))
            lower = p[self.suffix[on]]
            p[on] = (self.n[on] - cut[on]) / total[self.context[on]] + weight[self.context[on]] * lower
        with np.errstate(divide="ignore"):
            self.log_p, self.log_weight = np.log10(p).astype(np.float32), np.log10(weight).astype(np.float32)

    def code(self, values: np.ndarray) -> np.ndarray:
        node, order = self.longest(values >> np.uint64(8), self.depth, False)
        event, length = self.longest(values, self.depth + 1, True)
        out = self.log_p[event].astype(float)
        on = np.flatnonzero(order >= length)
        at, level = node[on], order[on].astype(np.int64)
        while len(on):  # contexts of at least the event's length have not seen it
            out[on] += self.log_weight[at]
            more = level > length[on]
            on, at, level = on[more], self.suffix[at[more]].astype(np.int64), level[more] - 1
        return out


def discounts(nodes: DataFrame, order: int = ORDER) -> dict[str, np.ndarray]:
    """Discount of an n-gram seen once, twice and more often, per language and length."""
    times = [F.sum((F.col("n") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    out: dict[str, np.ndarray] = {}
    for row in nodes.groupBy("key", "length").agg(*times).collect():  # a few rows per language
        table = out.setdefault(row["key"], np.tile([0.0, 0.5, 1.0, 1.5], (order + 1, 1)))
        n = [0, *(row[f"n{i}"] for i in (1, 2, 3, 4))]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            for i in (1, 2, 3):
                if n[i]:
                    table[row["length"], i] = min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), i)
    return out


def distinct_texts(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``(key, text)``, once for each ``(key, digest)`` of ``rows(key, digest, text)``. Only texts
    whose 64-bit hash occurs again are moved, unless there are more than ``limit`` such hashes."""
    marked = rows.select("key", "digest", "text", F.xxhash64("key", "digest").alias("mark"))
    again = cut_lineage(marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"))
    few = again.count() <= limit
    copies = marked.join(F.broadcast(again), "mark", "left_semi") if few else marked
    once = copies.groupBy("key", "digest").agg(F.first("text").alias("text")).select("key", "text")
    return marked.join(F.broadcast(again), "mark", "left_anti").select("key", "text").unionByName(once) if few else once


class Form:
    """``form`` as a scorer, for the first pass over the texts."""

    score = staticmethod(form)


def perplexities(rows: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``rows(key, digest, text, ...)`` without the texts, with their ``form`` and ``score``, the log10 probability
    of each under the model of its key (its language), which has learnt each digest once. Languages are scored one after the other, each over its own rows."""
    counts = cut_lineage(count_grams(distinct_texts(rows), order, lower=False, keyed=True))
    nodes = cut_lineage(roll_up(counts, order, distinct=True))
    cuts = discounts(nodes, order)

    def passes(key: str) -> Iterator[tuple[list, dict[str, str], bool]]:
        shards = trie_shards(nodes.where(F.col("key") == key), order - 1, shard_bytes, KneserNey, cuts[key])
        for i, (model, last) in enumerate(shards):
            yield [model] if i else [model, Deferred(Form)], {"score": "double"} | ({} if i else FORM), last

    out = None
    for key in sorted(cuts):
        own = apply_passes(rows.where(F.col("key") == key), passes(key), lower=False, keep_text=False)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = rows.drop("text").select("*", F.lit(0.0).alias("score"), *(F.lit(0).cast(kind).alias(c) for c, kind in FORM.items())).limit(0)
    return out


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spread: float = SPREAD) -> DataFrame:
    """Per row the counts of its form, ``base_failed``, ``log_perplexity`` (log10, per word with
    a letter or digit, and one end) and ``kept``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))

    scored = perplexities(rows)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    scored = scored.withColumn("base_failed", failed).withColumn("log_perplexity", -F.col("score") / (F.col("n_lexical") + 1))
    scored = cut_lineage(scored.drop("score", "n_lexical"))
    quarter = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    texts = scored.where("NOT base_failed").groupBy("key", "digest").agg(F.first("log_perplexity").alias("log_perplexity"))
    bands = texts.groupBy("key").agg(quarter.alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    bands = bands.select("key", (low - spread * (high - low)).alias("low"), (high + spread * (high - low)).alias("high"))
    inside = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    judged = scored.drop("digest").join(F.broadcast(bands), "key", "left")  # one row per language
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
