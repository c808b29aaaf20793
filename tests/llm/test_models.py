"""Language models, quality rules and toxicity against plain restatements."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from spotweave.llm import ppm, quality, toxicity
from spotweave.llm.ngrams import HashArray, Tally, count_grams, grams, mask, roll_up
from spotweave.session import cut_lineage

rng = random.Random(2)
DOCS = ["".join(rng.choices("abc é\n", k=rng.randint(0, 40))) for _ in range(40)]


def counts_by_force(texts, depth):
    """Symbol counts of every context; below the longest, one per distinct longer context."""
    top = Counter()
    for t in texts:
        p = bytes(depth) + t.encode().lower().replace(b"\0", b"\1") + b"\0"
        top.update(p[i - depth : i + 1] for i in range(depth, len(p)))
    seen, level = {}, dict(top)
    for k in range(depth, -1, -1):
        for gram, n in level.items():
            seen.setdefault(gram[:-1], {})[gram[-1]] = n
        level = Counter(gram[1:] for gram in level)
    return seen


def ppm_by_force(seen, text, depth):
    p, out = bytes(depth) + text.encode().lower().replace(b"\0", b"\1") + b"\0", 0.0
    for i in range(depth, len(p)):
        excluded = set()
        for k in range(depth, -1, -1):
            here = {s: n for s, n in seen.get(p[i - k : i], {}).items() if s not in excluded}
            room = 2 * sum(here.values())
            if p[i] in here:
                out += math.log10((2 * here[p[i]] - 1) / room)
                break
            if here:
                out += math.log10(len(here) / room)
            excluded |= here.keys()
        else:
            out -= math.log10(256 - len(excluded))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000])
def test_ppm(make, shard_bytes):
    train, test = DOCS[:25], [*DOCS[25:], "", "zzz", "ab\0c", "日本", "a" * 3000]
    nodes = ppm.train(make(list(enumerate(train))).select("text"), 3)
    rows = make(list(enumerate([*test, None])))
    seen = counts_by_force(train, 3)
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(rows, nodes, 3, shard_bytes).collect()}
    for i, t in enumerate([*test, ""]):
        assert got[i] == pytest.approx(ppm_by_force(seen, t, 3), rel=1e-4, abs=1e-3)


def test_ppm_without_training(make):
    rows = make([(1, "ab"), (2, None)])
    nodes = ppm.train(rows.limit(0).select("text"), 3)
    got = {r["doc_id"]: r["score"] for r in ppm.score_documents(rows, nodes, 3).collect()}
    assert got == {1: pytest.approx(-3 * math.log10(256)), 2: pytest.approx(-math.log10(256))}


def test_adaptive_learns():
    assert ppm.adaptive_code_length(b"abc" * 50) > 3 * ppm.adaptive_code_length(b"abc" * 10)
    assert ppm.adaptive_code_length(b"") == pytest.approx(-math.log10(256))


@pytest.mark.parametrize("words_bytes", [1 << 20, 0])
def test_word_base(make, words_bytes):
    train, test = ["a b B", "c  a"], ["a x", None, "", "b\tB a"]
    rows = make(list(enumerate(train)))
    counts, nodes = ppm.count_words(rows.select("text")), ppm.train(rows.select("text"), 2)
    c = Counter("a b b c a".split()) + Counter({"END": 2})
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in ppm.score_with_base(make(list(enumerate(test))), nodes, counts, words_bytes, depth=2).collect()}
    for i, t in enumerate(test):
        tokens = [*(t or "").lower().split(), "END"]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(tokens), sum(x in c for x in tokens))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens))


def test_texts_are_written_once_however_many_passes(make, monkeypatch):
    written = []
    monkeypatch.setattr(ppm, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    train, test = [*DOCS[:25], "a b B"], [*DOCS[25:], "a x", None, "", "b\tB a"]
    rows, tests = make(list(enumerate(train))).select("text"), make(list(enumerate(test)))
    counts, nodes = ppm.count_words(rows), ppm.train(rows, 3)
    whole = ppm.score_with_base(tests, nodes, counts, depth=3)
    want = {r["doc_id"]: r for r in whole.collect()}
    written.clear()
    shards = {"words_bytes": counts.count() * ppm.WORD_BYTES // 3, "shard_bytes": nodes.count() * ppm.NODE_BYTES // 2 + 1}
    parted = ppm.score_with_base(tests, nodes, counts, depth=3, keep_text=False, **shards)
    assert parted.columns == [c for c in whole.columns if c != "text"]
    for r in parted.collect():
        for c in ("score", "base_score", "n_tokens", "n_known"):
            assert r[c] == pytest.approx(want[r["doc_id"]][c], rel=1e-6)
    assert len(written) > 2 and sum("text" in c for c in written) == 1


def test_tally_and_hash_array():
    keys = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    tally = Tally()
    for part in np.array_split(keys, 40):
        tally.add(*np.unique(part, return_counts=True))
    assert dict(zip(*(x.tolist() for x in tally.take()))) == Counter(keys.tolist())
    some = np.unique(keys * np.uint64(2654435761))
    index = HashArray(some)
    assert (index.find(some) == np.arange(len(some))).all()
    assert (index.find(some + np.uint64(1)) == -1).all() and (HashArray(some[:0]).find(some) == -1).all()


def test_gram_counts(make):
    texts = ["abab", "", None, "b"]
    rolled = roll_up(count_grams(make(list(enumerate(texts))).select("text"), 3), 3).collect()
    whole = [(t or "").encode() + b"\0" for t in texts]
    for k in (1, 2, 3):
        want = Counter(int.from_bytes((bytes(2) + t)[i - k + 3 : i + 3], "big") for t in whole for i in range(len(t)))
        assert {r["gram"]: r["n"] for r in rolled if r["length"] == k} == want
    assert len(grams([b"", b"ab"], 3)[0]) == 4 and int(mask(2)) == 0xFFFF


def test_kneser_ney_sums_to_one(make):
    rows = make([(i, t) for i, t in enumerate(DOCS)]).withColumn("key", F.lit("en"))
    nodes = roll_up(count_grams(rows.select("key", "text"), 4, lower=False, keyed=True), 4, distinct=True)
    cuts = quality.discounts(nodes, 4)
    for shard in range(3):
        models = list(ppm.trie_shards(nodes, 3, 2000, quality.KneserNey, cuts["en"]))
        model = models[min(shard, len(models) - 1)][0].get()
        for context in (b"abc", b"zzz", b"\0\0\0", b"\0ab"):
            values = np.array([(int.from_bytes(context, "big") << 8) | s for s in range(256)], np.uint64)
            if ppm.shard_of(values, model.shards)[0] == shard:
                assert (10 ** model.code(values)).sum() == pytest.approx(1, abs=1e-4)


def form_by_force(text):
    text = text or ""
    words = [w for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_form_counts():
    texts = [*DOCS, "", "a b c a b c", "x\n\nx\n x\nx", "#$ é|日", "a a a a", "\n\n"]
    got = quality.form([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == form_by_force(t)


def test_quality_bands(make, odd):
    draw = random.Random(7)
    plain = [(i, " ".join(draw.choice(["the", "of", "hen", "thing", "reed", "at"]) + draw.choice("aeiou") for _ in range(80))) for i in range(60)]
    junk = [(900, " ".join("".join(draw.choices("#$%&qxz0123", k=7)) for _ in range(80)))]
    short = [(901, "the of"), (902, "same same same " * 40), (903, None)]
    got = {r["doc_id"]: r for r in quality.quality(make([*plain, *junk, *short])).collect()}
    assert all(got[i]["kept"] for i, _ in plain) and not got[900]["kept"] and not got[900]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (901, 902, 903))
    assert quality.quality(odd).count() == odd.count() and quality.quality(odd.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [25, 240])
@pytest.mark.parametrize("limit", [0, 100])
def test_copies_do_not_set_the_band(make, monkeypatch, copies, limit):
    """The band of 60 texts is the same with one of them 30 % or 80 % of the language."""
    monkeypatch.setattr(quality.distinct_texts, "__defaults__", (limit,))
    draw = random.Random(7)
    text = lambda: " ".join(draw.choice(["the", "of", "hen", "thing", "reed", "at"]) + draw.choice("aeiou") for _ in range(80))
    plain = [(i, text()) for i in range(60)]
    junk = [(900, " ".join("".join(draw.choices("#$%&qxz0123", k=7)) for _ in range(80)))]
    once = {r["doc_id"]: r for r in quality.quality(make([*plain, *junk])).collect()}
    more = [(1000 + i, plain[0][1]) for i in range(copies)] + [(None, plain[0][1])] * 2
    got = {r["doc_id"]: r for r in quality.quality(make([*plain, *junk, *more])).collect()}
    assert all(got[i]["kept"] for i in [*range(60), *range(1000, 1000 + copies), None]) and not got[900]["kept"]
    assert all((got[0]["low"], got[0]["high"], got[i]["log_perplexity"]) == pytest.approx((once[0]["low"], once[0]["high"], once[i]["log_perplexity"])) for i in once)


@pytest.fixture(scope="module")
def letters(make):
    return toxicity._letter_model(make([(i, "the stupid moron said idiot things in the nation of idle men") for i in range(3)]).select("text"))


@pytest.mark.parametrize("text", ["1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "!d!ot"])
def test_decoding(letters, text):
    assert toxicity.Restorer(letters).words(f"you {text} there") == ["idiot"]


@pytest.mark.parametrize("text", ["s t u p i d, ok", "s t u p i d! ok", "s  t  u  p  i  d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "y o u s t u p i d", '"s t u p i d"', "$ t u p 1 d .", "such a s t u p i d thing", "m e n s a i d s t u p i d " + "m e n s a i d " * 12])
def test_letter_spaced_words(letters, text):
    assert "stupid" in toxicity.Restorer(letters).words(text)


def test_letter_spaced_short_and_lone_words(letters):
    read = toxicity.Restorer(letters).words
    assert "moron" in read("such a m o r o n here") and "idiot" in read("i d i o t!") and read("all m e n here") == ["men"]


def test_plain_text_is_not_decoded(letters):
    assert toxicity.Restorer(letters).words("a plain book, 26.235.44.18 of%%% 4785380592391139 in%%% a$$$") == []


def test_suspects_leave_out_only_plain_runs():
    draw = random.Random(3)
    for signs in ("aabbcde019@$!|+(*._-~  \t\n,;:\u00e9 \u00df \u65e5\u00a0%#", "ab1@. \u00e9"):
        texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(2000)] + ["", "s t u p i d", "i.d.i.o.t"]
        runs = toxicity.suspects([t.encode() for t in texts])
        assert [list(toxicity.disguised(t, r)) for t, r in zip(texts, runs)] == [list(toxicity.disguised(t)) for t in texts]
    assert toxicity.suspects([b"plain words, 12 ab", b"", b"an id1ot"]) == [[], [], [(3, 8)]]


def test_disguise_behind_bytes_that_are_no_text(letters):
    table, doc, _ = toxicity.features([b"plain", b"\xe9\x80 1d10t"], toxicity.Restorer(letters))
    idiot = toxicity.features([b"idiot"], toxicity.Restorer(letters))[0][0]
    assert any((row == idiot).all() for row in table[doc == 1])


def test_toxicity(make, odd, spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghilmnoprstu", k=6))
    rows = [(i, " ".join([word() for _ in range(30)] + (["stupid"] if i % 4 == 0 else []))) for i in range(200)]
    docs = make([*rows, (300, word() + " s t u p i d"), (301, word() + " STUP1D"), (302, word()), (303, None), (304, "")])
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0, 1) for i in range(200)] + [(None, 1, 1), (5, None, 1)], "doc_id bigint, toxic int, quality int")
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[i] for i in (0, 4, 300, 301)) > 0.7 > 0.3 > max(got[i] for i in (1, 2, 302, 303, 304))
    kept = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i] < 0.7}
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["toxicity"] for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels)).count() == 0


def test_held_out_labels(spark):
    from spotweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert got[got.toxic == 1].predicted.mean() > 0.6 and got[got.toxic == 0].predicted.mean() < 0.03
