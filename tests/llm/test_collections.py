"""Merkle manifest, SimHash near copies and phrase mining against plain loops."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F
from spotweave.llm import merkle, phrases, simhash


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def manifest_by_force(rows):
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            yield "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
            at //= 16

    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda g: g[:3])
        trees[name] = levels([g[2] for g in groups[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, own, row) in enumerate(groups[name]):
            steps = [*path(trees[name], at), *path(top, k)]
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0
            folded = leaf(row, lower(row["text"])) if hit and row["text"] is not None else own
            for left, right in steps:
                folded = digest(left, folded, right)
            out.append((row["doc_id"], own, trees[name][-1][0], top[-1][0], digest(*(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


@pytest.mark.parametrize("sources", [[("a", 700)], [(None, 1)], [(None, 20), ("b", 1), ("é", 16), ("", 17), ("A", 257)], [(f"s{i}", 2) for i in range(40)]])
def test_manifest(make, sources):
    rng = random.Random(3)
    rows = [(rng.randrange(400) if rng.random() < 0.98 else None, rng.choice([None, "", "Some Text", "no capitals", "ÄÖ Z", "x" * 5000])) for _, n in sources for _ in range(n)]
    names = [name for name, n in sources for _ in range(n)]
    docs = make(rows).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    named = docs.sparkSession.createDataFrame(list(enumerate(names)), "at bigint, named string")
    docs = docs.join(named, "at").withColumn("source", F.col("named")).repartition(5)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = merkle.manifest(docs, hit)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(manifest_by_force(docs.collect()), key=key)


def test_manifest_of_odd_and_empty_tables(make, odd):
    hit = F.lit(True)
    rows = merkle.manifest(odd, hit).collect()
    assert len(rows) == odd.count() and len({r["root"] for r in rows}) == 1
    assert merkle.manifest(make([]), hit).collect() == []


def fingerprint_by_force(text):
    words = lower(text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes_of(values, radius):
    """Smallest id of each ``(id, number)`` row's component."""
    root = {v: v for _, v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, v in values:
        least[find(v)].append(i)
    return [(i, v, min(least[find(v)])) for i, v in values]


@pytest.mark.parametrize("most", [8, 512])
def test_near_copies(make, monkeypatch, most):
    monkeypatch.setattr(simhash, "SHARD", most)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    rng = random.Random(5)
    rows = []
    for _ in range(15):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 2, 3, 8, 300, 300]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            if own and rng.random() < 0.7:
                own[rng.randrange(len(own))] = "New"
            rows.append((len(rows) + 10, rng.choice([" ", "\n\t"]).join(own)))
    rows += [(3, None), (500, " "), (501, rows[0][1])]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_copies(make(rows)).collect()}
    want = classes_of([(i, fingerprint_by_force(t)) for i, t in rows], 2)
    assert got == {(i, f"{v:016x}", c) for i, v, c in want}
    assert len({c for _, _, c in want}) < len({v for _, v, _ in want})  # some links are not equalities


@pytest.mark.parametrize("most", [20])
def test_links_of_dense_families(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "SHARD", most)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < 250:
        value = centre
        for k in rng.sample(range(64), rng.randint(0, 4)):
            value ^= 1 << k
        values.add(value)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    found = simhash.links(nodes).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in found)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in found:
        root[find(r["a"] & (2**64 - 1))] = find(r["b"] & (2**64 - 1))
    want = classes_of([(v, v) for v in values], 2)
    assert len({find(v) for v in values}) == len({c for _, _, c in want})


def test_bk_tree():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    stored = [v for v in tree.values]
    for q in values[:50]:
        for radius in (0, 1, 3):
            assert {stored[i] for i in tree.near(q, radius)} == {v for v in values if (v ^ q).bit_count() <= radius}


def test_near_copies_of_odd_and_empty_tables(make, odd):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_copies(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (5, 4), (None, None), (6, 2), (7, 7), (8, 8)], key=str)
    assert simhash.near_copies(make([])).collect() == []


def phrases_by_force(rows, least, longest, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, words), a in candidates.items():
        longer = [w for (own, w), b in candidates.items() if own == lang and len(w) > len(words) and b >= a]
        if any(words == w[i : i + len(words)] for w in longer for i in range(len(w) - len(words) + 1)):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize(("least", "hot", "top"), [(3, 2, 2000), (5, 1000, 7)])
def test_phrases(spark, monkeypatch, least, hot, top):
    monkeypatch.setattr(phrases, "HOT", hot)
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = rng.choices(["a", "b", "the", "Zoé", "x-1", "日本", "end"], [4, 3, 5, 1, 1, 1, 2], k=rng.randint(0, 25))
        rows.append((rng.choice(["en", "en", None, "fr"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " "]) for w in words)))
    rows += [("en", None), ("en", ""), ("fr", "only " * 10), (None, "a b the end a b the end"), ("xx", "rare words here")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, word int").repartition(7)
    got = sorted(map(tuple, phrases.phrases(docs, least=least, top=top).collect()))
    assert got == phrases_by_force(rows, least, 5, top)


def test_phrases_of_long_odd_and_empty_tables(spark, make, odd, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 1 << 12)
    text = "one two three. four five, " * 3000
    docs = spark.createDataFrame([("en", text), ("en", "no " * 9000)], "lang string, text string")
    got = sorted(map(tuple, phrases.phrases(docs).collect()))
    assert got == phrases_by_force([("en", text), ("en", "no " * 9000)], 100, 5, 2000)
    assert phrases.phrases(odd, least=2).count() > 0
    assert phrases.phrases(make([])).collect() == []
