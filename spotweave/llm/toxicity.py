"""Toxicity scores of texts after undoing disguised spelling.

Noisy channel: a disguised word is a lattice of characters. A sign that stands for letters
(leetspeak) may be read as each of them, a repeated letter as one or two, a sign or space
between single letters as nothing. Viterbi decoding under a letter trigram model, counted in
Spark over all texts, picks the reading; words that need no decoding keep their spelling.
White space between single characters may also be a word break: a second Viterbi pass picks
the words, scored by their share of all words (at most ``LEXICON``, the most frequent, are
known) or, for any other word, by the letter model.

The classifier is fitted on a sample of at most ``SAMPLE_ROWS`` labelled documents. Evidence
is the log odds of a word, or of its first letters (inflections share a stem), to be in a
toxic document; a logistic model turns the strongest evidence of a text into its score. Only
the text enters a score.

Defined results: a NULL or empty text has no evidence and gets the score of that; rows whose
label or id is NULL are not learnt from; a document labelled twice counts as its largest
label; repeated rows each get a row; other columns are ignored; without a toxic or a clean
sample row every score is the share of toxic labels (0 without any); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.ngrams import HashArray, count_grams
from spotweave.llm.text import ALNUM, byte_class, chunks, free_name, hash_slices, hash_words, mix, take_words
from spotweave.session import cut_lineage

SAMPLE_ROWS = 200_000
FEATURES = 20_000
# Toxic sample documents a feature must occur in.
LEAST = 3
STEMS = (4, 5, 6)
THRESHOLD = 0.7

# Letters a sign can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz"}
SIGNS = "".join(map(re.escape, LEET)) + r"._\-~"
# A run of letters and signs is disguised if there is a sign inside, a sign before a letter, a letter
# before a digit, or a letter three times in a row.
RUN = re.compile(rf"[a-z{SIGNS}]++")
TRIGGER = re.compile(rf"[a-z][{SIGNS}]++[a-z]|[@$!1350*4][a-z]|[a-z][0134579@$]|([a-z])\1\1")
# Single characters with white space between them, up to any closing punctuation.
SPACED = re.compile(rf"(?<![^\W_])[a-z{SIGNS}](?:\s+[a-z{SIGNS}]){{2,}}(?=(?:[^\w\s]|_)*(?:\s|\Z))")
# The same by bytes, for many texts at once.
LETTER = byte_class(lambda b: 97 <= b <= 122)
SIGN = byte_class(lambda b: chr(b) in LEET or chr(b) in "._-~")
BEFORE_LETTER = byte_class(lambda b: chr(b) in "@$!1350*4")
AFTER_LETTER = byte_class(lambda b: chr(b) in "0134579@$")
LETTER_OR_DIGIT = byte_class(lambda b: b < 128 and chr(b).isalnum())
MAYBE_SPACE = byte_class(lambda b: b >= 128 or chr(b).isspace())
EDGES = "!|+(*._-~"
# Known words, their longest length, and the share of words that are not known.
LEXICON = 100_000
LONGEST = 24
UNKNOWN = 0.1
COST_LEET, COST_TWICE, COST_ONCE, COST_DROP, COST_KEEP = 1.0, 3.0, 0.5, 1.0, 12.0


class LetterModel:
    """log probabilities of a-z after two letters (0 is a word's edge or any other byte), and of
    the known words."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, words: dict[str, int], total: int):
        self.words = {w: math.log((1 - UNKNOWN) * n / total) for w, n in words.items()}
        table = np.zeros((27, 27, 27))
        letter = np.zeros(256, np.int64)
        letter[97:123] = np.arange(1, 27)
        a, b, c = (letter[(grams >> s) & 255] for s in (16, 8, 0))
        np.add.at(table, (a, b, c), counts)
        pair = table.sum(0) + 1.0  # shorter contexts stand behind the longer ones
        single = pair.sum(0)
        low = pair / pair.sum(1, keepdims=True) * 0.9 + 0.1 * single / single.sum()
        self.log = np.log((table + 5.0 * low) / (table.sum(2, keepdims=True) + 5.0)).tolist()


States = dict[tuple[int, int], tuple[float, str]]
START: States = {(0, 0): (0.0, "")}


def _step(states: States, char: str, run: int, log: list) -> States:
    """The readings after ``run`` times ``char``: per last two letters the best one."""
    options: list[tuple[str, float]]
    if "a" <= char <= "z":
        if run == 1:
            options = [(char, 0.0)]
        else:
            options = [(char, COST_ONCE if run > 2 else COST_TWICE), (char * 2, 0.0 if run == 2 else COST_TWICE)]
    elif char in LEET:
        options = [(c * k, COST_LEET + (COST_TWICE if k > 1 else 0.0)) for c in LEET[char] for k in ((1, 2) if run > 1 else (1,))] + [("", COST_KEEP)]
    else:
        options = [("", COST_DROP)]
    after: States = {}
    for (a, b), (score, text) in states.items():
        for letters, cost in options:
            x, y, s = a, b, score - cost
            for c in letters:
                z = ord(c) - 96
                s += log[x][y][z]
                x, y = y, z
            if (x, y) not in after or after[x, y][0] < s:
                after[x, y] = (s, text + letters)
    return after


def _best(states: States, log: list) -> tuple[float, str]:
    return max((s + log[a][b][0], t) for (a, b), (s, t) in states.items())


def decode(token: str, model: LetterModel) -> str:
    """Most probable letters behind a disguised token (lower case)."""
    states, i, n = START, 0, len(token)
    while i < n:
        j = i + 1
        while j < n and token[j] == token[i]:
            j += 1
        states = _step(states, token[i], j - i, model.log)
        i = j
    return _best(states, model.log)[1]


def decode_spaced(chars: str, model: LetterModel) -> list[str]:
    """Most probable words behind single characters, between any of which a word may end."""
    n, log = len(chars), model.log
    best, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
    for i in range(n):
        before, run, now = START, 0, START
        for j in range(i, min(n, i + LONGEST)):
            if run and chars[j] == chars[j - 1]:
                run += 1
            else:
                before, run = now, 1
            now = _step(before, chars[j], run, log)
            letters, word = _best(now, log)
            score = letters + math.log(UNKNOWN)
            if len(model.words):
                # A known word keeps what its signs cost; only its spelling is scored anew.
                for s, t in now.values():
                    if t in model.words and (known := model.words[t] + s - _spelling(t, log)) > score:
                        score, word = known, t
            if best[i] + score > best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + score, (i, word)
    out = []
    while n:
        n, word = back[n]
        out.append(word)
    return out[::-1]


def _spelling(word: str, log: list) -> float:
    """log probability of the letters without the edge behind them."""
    x = y = 0
    out = 0.0
    for c in word:
        z = ord(c) - 96
        out += log[x][y][z]
        x, y = y, z
    return out


def suspects(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Per lower-case text the runs, as places of characters, that ``disguised`` has to look at: all
    that are disguised and all whose last character may begin spaced ones, in order."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    letter, sign = LETTER[raw], SIGN[raw]
    edges = np.flatnonzero(np.diff((letter | sign).view(np.int8), prepend=np.int8(0)))
    begin, end = edges[0::2], edges[1::2]  # a line end is behind the last run
    pairs = (BEFORE_LETTER[raw[:-1]] & letter[1:]) | (letter[:-1] & AFTER_LETTER[raw[1:]])
    same = raw[1:] == raw[:-1]
    thrice = letter[2:] & same[1:] & same[:-1]
    signs = np.flatnonzero(np.diff(sign.view(np.int8), prepend=np.int8(0)))
    inside = signs[0::2][letter[signs[0::2] - 1] & letter[signs[1::2]]]
    places = np.concatenate([np.flatnonzero(pairs), np.flatnonzero(thrice), inside])
    wanted = np.zeros(len(begin), bool)
    wanted[np.searchsorted(begin, places, "right") - 1] = True
    # Spaced characters: the next run is a single one, and no letter or digit is before the last.
    single = np.append(end[1:] - begin[1:] == 1, False)[: len(begin)]
    wanted |= single & MAYBE_SPACE[raw[end]] & ~LETTER_OR_DIGIT[raw[end - 2]]
    begin, end = begin[wanted], end[wanted]
    text = np.searchsorted(at, begin, "right") - 1
    # Bytes to characters: those that continue one are not counted.
    more = np.flatnonzero((raw & 0xC0) == 0x80)
    skipped = np.searchsorted(more, begin) - np.searchsorted(more, at)[text]
    low = (begin - at[text] - skipped).tolist()
    high = (end - at[text] - skipped).tolist()
    spans = list(zip(low, high))
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    return [spans[a:b] for a, b in zip(first[:-1], first[1:])]


def disguised(text: str, runs: list[tuple[int, int]] | None = None) -> Iterator[str]:
    """Disguised runs of a lower-case text, and single characters with white space between them. Every
    run is read a bounded number of times, however long it is. ``runs`` are its ``suspects``, if known."""
    done = 0
    for low, high in (run.span() for run in RUN.finditer(text)) if runs is None else runs:
        if low < done:  # inside the spaced characters before it
            continue
        if TRIGGER.search(text, low, high):
            yield text[low:high]
        # Only a run's last character can have white space behind it.
        elif found := SPACED.match(text, high - 1):
            done = found.end()
            yield found.group()


class Restorer:
    """Restored words of a text; decodings are remembered up to a bound."""

    def __init__(self, model: LetterModel):
        self.decode = lru_cache(maxsize=100_000)(lambda token: decode(token, model))
        self.spaced = lru_cache(maxsize=10_000)(lambda chars: decode_spaced(chars, model))
        self.model = model

    def words(self, text: str, runs: list[tuple[int, int]] | None = None) -> list[str]:
        out = []
        for token in disguised(text, runs):
            if len(single := token.split()) > 1:
                chars = "".join(single).rstrip(EDGES).lstrip(EDGES[1:])
                out += self.spaced(chars) if len(chars) <= 256 else decode_spaced(chars, self.model)
                continue
            core = token.rstrip(EDGES).lstrip(EDGES[1:]) or token  # punctuation around it
            for low in range(0, len(core), 64):  # a longer run is no word; it is read in parts
                out.append(self.decode(core[low : low + 64]))
        return [w for w in out if len(w) >= 3]


def _letter_model(rows: DataFrame) -> LetterModel:
    """Counts of three bytes over all texts, lower-cased: at most 256**3 rows, in practice the
    few thousand with letters; all other bytes fall into one class before they are collected."""
    counted = count_grams(rows, 3)
    letter = lambda s: F.when(F.shiftright("gram", s).bitwiseAND(F.lit(255)).between(97, 122), F.shiftright("gram", s).bitwiseAND(F.lit(255))).otherwise(F.lit(0))
    classes = counted.groupBy(letter(16).alias("a"), letter(8).alias("b"), letter(0).alias("c")).agg(F.sum("n").alias("n")).collect()  # 27**3 rows at most
    grams = np.array([(r["a"] << 16) | (r["b"] << 8) | r["c"] for r in classes], np.int64)
    words = _word_counts(rows)
    # Words per count, few rows even of many words; then the counts that at most LEXICON words reach.
    sizes = sorted(((r["n"], r["k"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, held = sizes[0][0] + 1 if sizes else 1, 0
    for n, k in sizes:
        held += k
        if held > LEXICON:
            break
        least = n
    known = {r["word"]: r["n"] for r in words.where(F.col("n") >= least).collect()}
    return LetterModel(grams, np.array([r["n"] for r in classes], float), known, sum(n * k for n, k in sizes) or 1)


def _word_counts(rows: DataFrame) -> DataFrame:
    """``(word, n)`` of the words of a-z up to ``LONGEST`` letters over all texts, lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, "text", lower=True):
            words = hash_words(texts, ALNUM)
            _, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
            short = words.end[first] - words.begin[first] <= LONGEST
            own = take_words(words, first[short])
            keep = pc.match_substring_regex(own, "^[a-z]+$")
            yield pa.RecordBatch.from_arrays([own.filter(keep).cast(pa.string()), pa.array(n[short].astype(np.int64)).filter(keep)], names=["word", "n"])

    return cut_lineage(rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def features(texts: list[bytes], restorer: Restorer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes of each word, of the words as written and then of the restored ones:
    the rows are words, the columns word and stems; the text of each word; words per text."""
    words = hash_words(texts, ALNUM)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
    own = _word_features(words)
    extra = []
    for t, runs in zip(texts, suspects(texts)):
        text = t.decode("utf-8", "replace") if runs else ""
        # Bytes that are no text move the places of the runs: then all runs are looked at.
        extra.append(restorer.words(text, runs if "\ufffd" not in text else None))
    more = hash_words([" ".join(w).encode() for w in extra], ALNUM)
    extra_doc = np.repeat(np.arange(len(texts)), np.diff(more.first))
    return np.concatenate([own, _word_features(more)]), np.concatenate([doc, extra_doc]), np.diff(words.first)


def _word_features(words) -> np.ndarray:
    """Columns: the word, then its first bytes where it has more (else 0, no feature)."""
    padded = words.buffer + bytes(8)
    size = words.end - words.begin
    columns = [words.hashes]
    for k in STEMS:
        cut = np.minimum(words.end, words.begin + k)
        stem = mix(hash_slices(padded, words.begin, cut) + np.uint64(k)) if len(size) else words.hashes
        columns.append(np.where(size >= k, stem, np.uint64(0)))
    return np.stack(columns, 1)


def _present(texts: list[bytes], restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (feature, text) pairs."""
    table, doc, _ = features(texts, restorer)
    flat, docs = table.ravel(), np.repeat(doc, table.shape[1])
    docs, flat = docs[flat != 0], flat[flat != 0]
    _, first = np.unique(mix(flat) ^ mix(docs.astype(np.uint64)), return_index=True)
    return flat[first], docs[first]


def _feature_counts(rows: DataFrame, restorer) -> DataFrame:
    """``(feature, n)``: rows of ``rows(text)`` that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(restorer.value)
        for _, texts in chunks(batches, "text", lower=True):
            found, n = np.unique(_present(texts, own)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

    return rows.mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


class Evidence:
    """Log odds of the chosen features; a text's evidence is summed up in a few numbers."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, model: LetterModel):
        self.index, self.odds, self.model = HashArray(hashes), np.append(odds, 0.0), model

    def vectors(self, texts: list[bytes], restorer: Restorer) -> np.ndarray:
        """Per text: an intercept, the three strongest words and the number of toxic words."""
        table, doc, _ = features(texts, restorer)
        at = self.index.find(table.ravel()).reshape(table.shape)
        best = self.odds[at].max(1) if len(at) else np.empty(0)
        hit = np.flatnonzero(best > 0)
        order = hit[np.lexsort((-best[hit], doc[hit]))]
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1.0
        first = np.searchsorted(doc[order], np.arange(len(texts) + 1))
        for d in np.unique(doc[order]):
            own = best[order[first[d] : first[d + 1]]]
            out[d, 1 : 1 + min(3, len(own))] = own[:3]
            out[d, 4] = math.log1p(len(own))
        return out


class Classifier:
    def __init__(self, evidence: Evidence | None, weights: np.ndarray, prior: float):
        self.evidence, self.weights, self.prior = evidence, weights, prior

    def score(self, texts: list[bytes], restorer: Restorer | None) -> np.ndarray:
        if self.evidence is None:
            return np.full(len(texts), self.prior)
        return 1.0 / (1.0 + np.exp(-self.evidence.vectors(texts, restorer) @ self.weights))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES) -> Classifier:
    """Classifier from ``labels(doc_id, label)``, which the caller has limited to what may be
    learnt from. The sample is that with the smallest hashes of ids."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample's rows are bounded, so they may be broadcast.
    learnt = cut_lineage(rows.join(F.broadcast(cut_lineage(sample)), "doc_id").select("text", "y"))
    total = learnt.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    n, toxic = total["n"], total["toxic"] or 0
    if not 0 < toxic < n:
        return Classifier(None, np.zeros(0), toxic / n if n else 0.0)
    model = _letter_model(rows.select("text"))
    restorer = context.broadcast(model)
    ill = _feature_counts(learnt.where("y = 1").select("text"), restorer).where(F.col("n") >= LEAST)
    # The candidates come from the bounded sample; counts of clean rows are joined to them.
    well = _feature_counts(learnt.where("y = 0").select("text"), restorer)
    both = ill.join(well.withColumnRenamed("n", "m"), "feature", "left").fillna(0, "m")
    odds = F.log((F.col("n") + 0.5) / (toxic + 1.0)) - F.log((F.col("m") + 0.5) / (n - toxic + 1.0))
    # Weak evidence counts less: one standard error is taken off.
    odds = odds - F.sqrt(1.0 / (F.col("n") + 0.5) + 1.0 / (F.col("m") + 0.5)) * 0.5
    chosen = both.select("feature", odds.alias("odds")).where("odds > 0.7").orderBy(F.desc("odds"), "feature").limit(n_features).collect()
    evidence = Evidence(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64), np.array([r["odds"] for r in chosen], float), model)
    sent = context.broadcast(evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Restorer(sent.value.model)
        for part, texts in chunks(batches, "text", lower=True):
            x = sent.value.vectors(texts, own)
            yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(c) for c in x.T)], names=["y", *(f"x{i}" for i in range(x.shape[1]))])

    table = learnt.mapInArrow(run, "y int, x0 double, x1 double, x2 double, x3 double, x4 double").toArrow()  # sample_rows at most
    y = table.column("y").to_numpy().astype(float)
    return Classifier(evidence, fit_logistic(np.stack([table.column(f"x{i}").to_numpy() for i in range(5)], 1), y), toxic / n)


def score(docs: DataFrame, classifier: Classifier, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``, from 0 to 1; it replaces a column of that name."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    kept = [c for c in docs.columns if c != out]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(*(F.col(c).alias(a) for c, a in zip(kept, names)))
    content = names[kept.index(text)]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        own = Restorer(model.evidence.model) if model.evidence else None
        for part, texts in chunks(batches, content, lower=True):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(texts, own))], names=[*names, "score"])

    return rows.mapInArrow(run, schema).select(*(F.col(a).alias(c) for c, a in zip(kept, names)), F.col("score").alias(out))


def drop_toxic(docs: DataFrame, classifier: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    out = free_name(docs, "toxicity")
    return score(docs, classifier, text, out).where(F.col(out) < threshold).select(docs.columns)
