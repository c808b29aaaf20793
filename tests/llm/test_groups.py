"""Near duplicates, components, packing, sharding, pages and the pipeline."""

import itertools
import random
import time
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from spotweave.llm import components, html_text, jaccard_join, packing, sharding
from tokenizers import Tokenizer


def classes_by_force(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("frequent", [0, 2, 64])
def test_jaccard_classes(make, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 3)))
    rows = []
    for _ in range(12):  # families of copies with few to many changes
        base = [word() for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 9)):
            own = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows) * 3 + 1, " ".join(own)))
    rows += [(2, None), (5, ""), (8, "x y"), (11, "X y"), (14, "y x"), (17, rows[0][1])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(make(rows)).collect()}
    assert got == classes_by_force(rows)


def test_near_copies_below_the_threshold_of_one_another(make, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        own = list(base)
        for k in rng.sample(range(120), 5):
            own[k] = f"n{rng.random()}"
        rows.append((i, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(make(rows)).collect()}
    assert got == classes_by_force(rows)


def test_jaccard_edges(make, odd):
    out = jaccard_join.jaccard_classes(odd).collect()
    assert len(out) == odd.count()
    by = {r["doc_id"]: r for r in out}
    assert by[2]["component_id"] == 2 and by[2]["n_shingles"] == 0 and by[None]["component_id"] is None and by[5]["component_id"] == 4
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert jaccard_join.jaccard_classes(odd.limit(0)).count() == 0 and jaccard_join.keep_one(odd.limit(0)).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)]))
        a = np.unique(a)
        similar = 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        assert not similar or jaccard_join.may_be_similar(jaccard_join.bitmap(a), len(a), jaccard_join.bitmap(b), len(b), 75)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root if find(i) != i or any(find(j) == i for j in root if j != i)}


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizer(spark):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    vocabulary = packing.Vocabulary(PATH)
    rng = random.Random(3)
    parts = [" ", "\n", "\t", "a", "é", "'s", "12", "!", "\x1d", "\x85", " ", "日", "<|endoftext|>", "word "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        expected = np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert packing.encode(t, vocabulary) == expected
        for size in (1, 7, 40):  # a text cut into slices has the same ids
            assert packing.encode(t, vocabulary, size) == expected


@pytest.mark.parametrize("text", ["ab " * 400_000, "a" * 300_000, " " * 300_000, "\n" * 300_000, "7" * 300_000, "-" * 300_000, "日" * 300_000])
def test_ids_of_very_long_texts(text):
    got = packing.encode(text, packing.Vocabulary(PATH))
    assert got == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_names_of_added_tokens_are_their_ids(make):
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(12)
    parts = [" ", "\n", "a", "é", "'s", "!", "日", "<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "word "]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(500))]
    got = {r["doc_id"]: r["ids"] for r in packing.tokenize(make(list(enumerate(texts))), PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i] == np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()


def check_packing(rows, length):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= length
    return len(places)


def test_packing(make, odd):
    pieces = packing.tokenize(odd, PATH)
    got = packing.pack(pieces.drop("ids"), cell_rows=20).collect()
    check_packing(got, packing.LENGTH)
    tokenizer = Tokenizer.from_file(PATH)
    for r in [r for r in pieces.collect() if r["doc_id"] in (1, 2, 4)]:
        text = {1: "one two three four five six seven", 2: ""}.get(r["doc_id"])
        if text is not None:
            assert (r["start"], r["ids"]) == (0, np.array([*tokenizer.encode(text).ids, 0], "<u4").tobytes())
    long = sorted((r["piece"], r["start"], r["length"]) for r in pieces.collect() if r["doc_id"] == 4)
    assert all(n == packing.LENGTH for _, _, n in long[1:]) and [s for _, s, _ in long] == np.cumsum([0, *(n for _, _, n in long)])[:-1].tolist()
    empty = packing.tokenize(odd.limit(0), PATH)
    assert packing.pack(empty.drop("ids")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_is_tight_and_keeps_every_capacity(rule):
    lengths = np.random.default_rng(2).integers(1, 900, 3000)
    sequence, _ = packing.best_fit(lengths, packing.Capacity(rule=rule))
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) * 1.01 + 1
    room = packing.Capacity(documents=3, attention=900_000, rule=rule)
    sequence, offset = packing.best_fit(lengths, room)
    for k in range(sequence.max() + 1):
        own = lengths[sequence == k]
        assert len(own) <= 3 and own.sum() <= 2048 and (own**2).sum() <= 900_000
        assert sorted(offset[sequence == k]) == np.cumsum([0, *own[np.argsort(offset[sequence == k])]])[:-1].tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([3000]))


def test_best_fit_decreasing_picks_the_tightest_bin():
    rng = random.Random(4)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(0, 200))]
        got, left = sharding.best_fit_decreasing(sizes, 70), {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            room = {b: x for b, x in left.items() if x >= sizes[i]}
            if room:
                assert left[got[i]] == min(room.values())
            left[got[i]] = left.get(got[i], 70) - sizes[i]
            assert left[got[i]] >= 0


def test_sharding(make, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ITEMS", 40)
    monkeypatch.setattr(sharding, "RUN_ROWS", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcé", k=rng.randint(0, 90))) for _ in range(300)] + ["copy of a text " * 3] * 60 + [None, "", None]
    rows = sharding.shard(make(list(enumerate(texts))), shards=4).collect()
    slots, groups, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 8
        slots[r["shard"]].append(r["slot"])
        groups[t].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values()) and max(sizes.values()) <= 1.02 * min(sizes.values())


def test_sharding_splits_what_no_shard_can_hold(make, odd):
    rows = sharding.shard(make([(i, "same text") for i in range(400)] + [(1000 + i, f"t{i}") for i in range(50)]), shards=4).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 4 and max(sizes.values()) <= 1.3 * min(sizes.values())
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(odd.limit(0)).count() == 0


def test_minimum_cut():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 7)
        a, b = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(i, j, rng.randint(0, 5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: sum(b[i] if keep[i] else a[i] for i in range(n)) + sum(c for i, j, c in edges if keep[i] != keep[j])  # noqa: B023, E731
        assert cost(html_text.min_cut(n, a, b, edges)) == min(map(cost, itertools.product((False, True), repeat=n)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><a href=/>home</a></header>
<div class="cookie-notice">We use cookies on this site to make it better for all of you today</div><div id=content><h2>Title here</h2>
<p>Some long paragraph of text that is the article and goes on for   many words indeed.<p>Short one.<ul><li>point one of list<li>point two of list</ul>
<aside>Related: <a href=x>other story</a></aside><script>var t="</p>";</script><p>Last &lt;paragraph&gt; with&nbsp;<b>bo</b>ld &amp text.</div>
<form><p>Subscribe to our newsletter with your email address and get all of it</p></form><section class="comments"><p>Great article, I loved
every word of it, thanks a lot to the author!</p></section><div class=sidebar><p>popular posts this week on our site are the following</p></div><footer>(c) x</footer></body></html>"""


def test_main_text(spark):
    want = "Title here\nSome long paragraph of text that is the article and goes on for many words indeed.\nShort one.\npoint one of list\npoint two of list\nLast <paragraph> with bold & text."
    odd = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (5, "u", "<p>" * 3000), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in odd], "page_id bigint, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in html_text.extract(pages).collect()))
    assert got[1] == got[2] == (1, want) and [t for _, t in got[3:5]] == ["", ""]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_articles_of_the_pages(spark):
    import html
    import re

    from spotweave.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in QUERIES["op7_html_extraction"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)[^>]*>", article))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_pipeline(spark):
    """Each stage on its own input, and the result's texts against the plain pieces."""
    import corpus_pipeline
    from spotweave.session import cut_lineage

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, kept = [docs.count()], [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(cut_lineage(stage(spark, kept[-1], sf)))
        counts.append(kept[-1].count())
        assert kept[-1].columns == docs.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    plain = classes_by_force([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    assert {r["doc_id"] for r in kept[2].collect()} == {i for i, (_, c) in plain.items() if c == i}
    rows = corpus_pipeline.run(spark, sf).collect()
    check_packing(rows, packing.LENGTH)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept[-1].collect()}
    assert all(s(spark, docs.limit(0), sf).count() == 0 for _, s in corpus_pipeline.STAGES)


@pytest.mark.parametrize("html", ["<div>x " * 60_000, "<b>x" * 60_000, "<b><p>x" * 40_000, "<div>" * 60_000 + "x</div>" * 60_000, "<ul><li>w " * 40_000])
def test_pages_nested_deep_or_never_closed_are_read_in_linear_time(html):
    began = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - began < 5


def test_formulas_and_fallback_texts_stay_inline():
    words = "some words of an article that are many enough to be kept by the cut "
    page = f"<article><p>{words}<math><mi>x</mi></math> and <video>fallback</video> end</p><p>{words}</p></article>"
    assert html_text.main_text(page) == f"{words}x and fallback end\n{words.strip()}"
