"""Document scores by prediction by partial matching over bytes.

Contexts of up to ``DEPTH`` bytes form a trie. A symbol is coded in the longest context known;
an unseen symbol costs an escape (half the share of distinct symbols, method D) to the next
shorter context, in which the symbols of the longer one are excluded; below the empty context
all 256 symbols are alike. A context below the longest counts a symbol once per longer context
it follows (update exclusion). Spark counts the n-grams of all training texts; the
trie is sent to the tasks in shards of at most ``SHARD_BYTES``, split by the last two context
bytes, however large it is; more shards mean more passes. ``adaptive_code_length``
is the same model, learnt along one document.

The word base is add-one smoothed unigram counts; its table is sent likewise, in shards of at
most ``WORDS_BYTES`` by hash. Of several passes the first writes the texts once and the others
write a number and scores for each row, so disk does not grow with the passes times the texts.

Defined results: a NULL text is empty (one end symbol, one end token); zero bytes count as 1;
repeated rows each get a row; NULL ids are kept; other columns are ignored; without training
rows every symbol has probability 1 / 256; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.ngrams import FLUSH, HashArray, Tally, count_grams, grams, mask, roll_up
from spotweave.llm.text import NOT_SPACE, chunks, free_name, hash_words
from spotweave.session import cut_lineage

DEPTH = 5
NODE_BYTES = 48
SHARD_BYTES = 192 << 20
# Text scored at a time in a task.
SCORED_BYTES = 1 << 20
WORD_BYTES = 24
WORDS_BYTES = 128 << 20
END = np.uint64(0x456E64)  # the end token's place among the word hashes


class Nodes:
    """The n-grams of one shard and their contexts as nodes of a trie; ``root`` is the empty
    context, the last node. ``count`` is 0 for a context that is not counted itself."""

    def __init__(self, lengths: np.ndarray, packed: np.ndarray, counts: np.ndarray, depth: int, shard: int = 0, shards: int = 1):
        self.depth, self.shard, self.shards = depth, shard, shards
        lengths, packed = lengths.astype(np.uint64), packed.astype(np.uint64)
        # Contexts are nodes too: zeros that precede a text, and in a shard those counted elsewhere.
        start, inner = np.arange(1, depth + 1, dtype=np.uint64), (lengths > 1) & (shards > 1)
        counts = np.concatenate([counts, np.zeros(depth + int(inner.sum()))])
        lengths, packed = (
            np.concatenate([lengths, start, lengths[inner] - np.uint64(1)]),
            np.concatenate([packed, np.zeros(depth, np.uint64), packed[inner] >> np.uint64(8)]),
        )
        keys, first = np.unique(packed | (lengths << np.uint64(56)), return_index=True)
        self.n = counts.astype(float)[first]
        self.lengths, packed = lengths[first], packed[first]
        self.index, root = HashArray(keys), len(keys)
        self.root = root

        def locate(length: np.ndarray, value: np.ndarray) -> np.ndarray:
            return np.where(length == 0, root, self.index.find(value | (length << np.uint64(56))))

        shorter = self.lengths - np.uint64(1)
        self.context = locate(shorter, packed >> np.uint64(8))
        suffix = locate(shorter, packed & ((np.uint64(1) << (shorter * np.uint64(8))) - np.uint64(1)))
        self.suffix = np.append(suffix, root).astype(np.int32)
        self.counted = np.append(self.n > 0, False)

    def longest(self, values: np.ndarray, most: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
        """Node and length of the longest known suffix; ``counted``: that has occurred."""
        node, length = np.full(len(values), self.root, np.int64), np.zeros(len(values), np.int8)
        on = np.arange(len(values))
        for k in range(most, 0, -1):
            got = self.index.find((values[on] & mask(k)) | np.uint64(k << 56))
            hit = (got >= 0) & self.counted[got] if counted else got >= 0
            node[on[hit]], length[on[hit]] = got[hit], k
            on = on[~hit]
            if not len(on):
                break
        return node, length

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        values, first = grams(texts, self.depth + 1)
        if self.shards == 1:
            return {"score": np.add.reduceat(self.code(values), first)}
        mine = np.flatnonzero(shard_of(values, self.shards) == self.shard)
        out = np.zeros(len(values))
        out[mine] = self.code(values[mine])
        return {"score": np.add.reduceat(out, first)}


class Trie(Nodes):
    """Code lengths of prediction by partial matching."""

    def __init__(self, *nodes):
        super().__init__(*nodes)
        c, root, context, suffix = self.n, self.root, self.context, self.suffix[:-1]
        seen = c > 0
        total = np.bincount(context[seen], c[seen], root + 1)
        kinds = np.bincount(context[seen], minlength=root + 1).astype(float)
        # What the symbols of a context make up in the context one shorter: excluded there.
        longer = seen & (self.lengths > 1)
        gone = np.bincount(context[longer], c[suffix[longer]], root + 1)
        rest, rest_kinds = total[self.suffix] - gone, kinds[self.suffix] - kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            log = lambda x: np.log10(x).astype(np.float32)
            self.count = np.append(log(2 * c - 1), np.float32(0))
            self.room = log(2 * total)
            self.escape = np.where(kinds > 0, log(kinds / (2 * total)), 0).astype(np.float32)
            self.left_room = log(2 * rest)
            self.left_escape = np.where(rest_kinds > 0, log(rest_kinds / (2 * rest)), 0).astype(np.float32)
        self.floor = math.log10(max(1, 256 - int(kinds[root])))
        del self.n, self.lengths, self.context

    def code(self, values: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each packed n-gram after the others."""
        node, order = self.longest(values >> np.uint64(8), self.depth, False)
        event, length = self.longest(values, self.depth + 1, True)
        out = np.empty(len(values))
        plain = length == order + 1
        out[plain] = self.count[event[plain]] - self.room[node[plain]]
        on = np.flatnonzero(~plain)
        out[on] = self.escape[node[on]]
        at, level = node[on], order[on].astype(np.int64)
        while len(on):
            lowest = level == 0
            out[on[lowest]] -= self.floor
            on, at, level = on[~lowest], at[~lowest], level[~lowest] - 1
            found = length[on] == level + 1
            out[on[found]] += self.count[event[on[found]]] - self.left_room[at[found]]
            on, at, level = on[~found], at[~found], level[~found]
            out[on] += self.left_escape[at]
            at = self.suffix[at].astype(np.int64)
        return out


def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
    return ((values >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)


class WordTable:
    """Counts of the hashed words of one shard; ``base_score`` sums add-one log10 probabilities of
    the tokens that belong to it."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, kinds: int, shard: int = 0, shards: int = 1):
        self.shard, self.shards = shard, shards
        self.index = HashArray(words.view(np.uint64))
        self.counts = np.append(counts, 0).astype(np.int32 if total < 1 << 31 else np.int64)
        self.share = math.log10(total + kinds + 1)

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        tokens, first = text_tokens(texts)
        mine = slice(None) if self.shards == 1 else np.flatnonzero(tokens.view(np.int64) % self.shards == self.shard)
        at = self.index.find(tokens[mine])
        held, known, base = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64), np.zeros(len(tokens))
        held[mine], known[mine], base[mine] = 1, at >= 0, np.log10(self.counts[at] + 1.0) - self.share
        return {
            "n_tokens": np.add.reduceat(held, first),
            "n_known": np.add.reduceat(known, first),
            "base_score": np.add.reduceat(base, first),
        }


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each text and an end token behind them; the first token of each text."""
    words = hash_words(texts, NOT_SPACE)
    n = np.diff(words.first)
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(words.hashes) + len(texts), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = words.hashes
    return out, ends - n


def count_words(rows: DataFrame) -> DataFrame:
    """``(word, n)``: tokens of all rows by hash, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for _, texts in chunks(batches, "text", lower=True):
            held.add(*np.unique(text_tokens(texts)[0], return_counts=True))
            if held.size > FLUSH:
                words, n = held.take()
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
        words, n = held.take()
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return rows.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Deferred:
    """A scorer that each worker makes from compact arrays when it first needs it."""

    def __init__(self, make, *args):
        self.make, self.args, self.made = make, args, None

    def get(self):
        if self.made is None:
            self.made, self.args = self.make(*self.args), ()
        return self.made


def columns_of(df: DataFrame) -> list[np.ndarray]:
    """Columns of a table of bounded size."""
    return [c.to_numpy() for c in df.toArrow().columns]


def trie_shards(nodes: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, kind=Trie, *more) -> Iterator[tuple[Deferred, bool]]:
    """One model per shard, made one after the other, and whether it is the last; n-grams of
    up to two bytes are in each."""
    shards = int(nodes.count() * NODE_BYTES // shard_bytes) + 1
    key = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    for i in range(shards):
        own = nodes.where((F.col("length") <= 2) | (F.pmod(key, F.lit(shards)) == i))
        arrays = columns_of(own.select(F.col("length").cast("tinyint"), "gram", F.col("n").cast("double").cast("float")))
        yield Deferred(kind, *arrays, depth, i, shards, *more), i == shards - 1


def apply_scorers(rows: DataFrame, sent: list, columns: dict[str, str], lower: bool = True, keep_text: bool = True) -> DataFrame:
    """One pass: appends the columns of the scorers that were broadcast. Without ``keep_text``
    the texts do not travel back."""
    rows = rows.drop(*columns)
    names = [n for n in (*rows.columns, *columns) if keep_text or n != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", SCORED_BYTES, lower=lower):
            got: dict[str, np.ndarray] = {}
            for scorer in sent:
                got |= scorer.value.get().score(texts)
            yield pa.RecordBatch.from_arrays([pa.array(got[k]) if k in got else part.column(k) for k in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in names))


def apply_passes(rows: DataFrame, passes: Iterator[tuple[list, dict[str, str], bool]], lower: bool = True, keep_text: bool = True) -> DataFrame:
    """``rows`` with the columns of all passes' scorers; a column of several passes is their sum.
    A pass is ``(scorers, columns, last)``. The first of several writes the texts with a number
    for each row; the later ones write numbers and scores alone."""
    context = rows.sparkSession.sparkContext
    scorers, columns, last = next(passes)
    sent = [context.broadcast(s) for s in scorers]
    if last:
        return apply_scorers(rows, sent, columns, lower, keep_text)
    row, kinds = free_name(rows, "_row"), dict(columns)
    first = cut_lineage(apply_scorers(rows.withColumn(row, F.monotonically_increasing_id()), sent, columns, lower))
    parts = first.select(row, F.lit(0).alias("pass"), *columns)
    for i, (scorers, columns, _) in enumerate(passes, 1):
        for old in sent:  # what it made is written
            old.destroy()
        sent, kinds = [context.broadcast(s) for s in scorers], kinds | columns
        scored = cut_lineage(apply_scorers(first.select(row, "text"), sent, columns, lower, keep_text=False))
        parts = parts.unionByName(scored.withColumn("pass", F.lit(i)), allowMissingColumns=True)
    for old in sent:
        old.destroy()
    # One narrow entry a pass, added in the order of the passes.
    each = parts.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("pass", *kinds))).alias("each"))
    add = lambda c: F.aggregate(f"each.{c}", F.lit(0).cast(kinds[c]), lambda a, x: a + F.coalesce(x, F.lit(0).cast(kinds[c])))
    sums = each.select(row, *(add(c).alias(c) for c in kinds))
    others = [c for c in first.columns if c not in kinds and c != row and (keep_text or c != "text")]
    return first.select(row, *others).join(sums, row).select(*others, *kinds)


def score_documents(rows: DataFrame, nodes: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """``rows`` (any columns, with ``text``) and ``score``, the log10 probability of each text."""
    passes = (([trie], {"score": "double"}, last) for trie, last in trie_shards(nodes, depth, shard_bytes))
    return apply_passes(rows, passes, keep_text=keep_text)


BASE = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double"}


def word_shards(counts: DataFrame, words_bytes: int = WORDS_BYTES) -> Iterator[tuple[Deferred, bool]]:
    """The word counts in tables of at most ``words_bytes``, split by hash, made one after the
    other, and whether it is the last."""
    size = counts.agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).first()
    shards = max(1, math.ceil(size["kinds"] / max(1, words_bytes // WORD_BYTES)))
    for i in range(shards):
        own = counts if shards == 1 else counts.where(F.pmod("word", F.lit(shards)) == i)
        yield Deferred(WordTable, *columns_of(own.select("word", "n")), size["total"] or 0, size["kinds"], i, shards), i == shards - 1


def score_with_base(rows: DataFrame, nodes: DataFrame, counts: DataFrame, words_bytes: int = WORDS_BYTES, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, keep_text: bool = True) -> DataFrame:
    """``rows`` with ``score`` and the word base ``n_tokens``, ``n_known`` and ``base_score``. A pass
    takes a shard of the trie and one of the words, as long as there are both."""

    def passes() -> Iterator[tuple[list, dict[str, str], bool]]:
        tries, words = trie_shards(nodes, depth, shard_bytes), word_shards(counts, words_bytes)
        last_trie = last_words = False
        while not (last_trie and last_words):
            scorers, columns = [], {}
            if not last_trie:
                trie, last_trie = next(tries)
                scorers, columns = [trie], {"score": "double"}
            if not last_words:
                table, last_words = next(words)
                scorers, columns = [*scorers, table], columns | BASE
            yield scorers, columns, last_trie and last_words

    return apply_passes(rows, passes(), keep_text=keep_text)


def train(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The trie's n-grams ``(length, gram, n)`` of all ``rows(text)``, written once."""
    counts = cut_lineage(count_grams(rows, depth + 1))
    return cut_lineage(roll_up(counts, depth + 1, distinct=True).drop("key"))


def adaptive_code_length(text: bytes, depth: int = DEPTH) -> float:
    """log10 probability of one text under a trie that starts empty and learns along it."""
    seen: dict[bytes, dict[int, int]] = {}
    padded, out = bytes(depth) + text.replace(b"\0", b"\1") + b"\0", 0.0
    for i in range(depth, len(padded)):
        symbol, excluded = padded[i], set()
        contexts = [padded[i - k : i] for k in range(depth, -1, -1)]
        for context in contexts:
            here = {s: n for s, n in seen.get(context, {}).items() if s not in excluded}
            room = 2 * sum(here.values())
            if symbol in here:
                out += math.log10((2 * here[symbol] - 1) / room)
                break
            if here:
                out += math.log10(len(here) / room)
            excluded |= here.keys()
        else:
            out -= math.log10(256 - len(excluded))
        for context in contexts:  # shorter contexts learn only what was new to the longer
            own = seen.setdefault(context, {})
            own[symbol] = own.get(symbol, 0) + 1
            if own[symbol] > 1:
                break
    return out
