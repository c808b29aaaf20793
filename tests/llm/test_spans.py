"""Secret scans, substring dedup and decontamination against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from spotweave.llm import decontaminate, secret_scan, substring_dedup, text
from spotweave.llm.text import ALNUM, NOT_SPACE, hash_words, mix, rolling

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
OTHER = (("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24))


def secrets_of(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for rank, (kind, pattern, least) in enumerate(OTHER, 1):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[0]) >= least]
    return sorted(out)


def secret_texts():
    rng = random.Random(4)
    parts = ["token=token:abcdef", "é password : 'a1b2c3'", "AKIA" + "Z" * 16, "AKIAshort", "ab12" * 7, "api_key=xy", "日本", " ", "\n", "SECRET=AKIA" + "9" * 20, "=", "passwd"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(60)] + ["", None, "x" * 200_000 + "token=123456"]


def test_secret_spans(make):
    texts = secret_texts()
    docs = make(list(enumerate([*texts, *texts])))
    found, _ = secret_scan.scan(docs)
    got = {r["path"]: [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]] for r in found.collect()}
    assert got == {i: secrets_of(t or "") for i, t in enumerate([*texts, *texts])}


def test_ledger_is_incremental(make):
    docs = make([(1, "token=abcdef1"), (2, "token=abcdef1"), (3, "plain")])
    found, ledger = secret_scan.scan(docs)
    assert ledger.count() == 2  # blobs, not rows
    again, new = secret_scan.scan(docs, ledger=ledger)
    assert new.count() == 0 and sorted(again.collect()) == sorted(found.collect())
    rules = (secret_scan.RULES[0], secret_scan.RULES[1], secret_scan.Rule("hex", 2, "[0-9a-f]{6,}"))
    more, new = secret_scan.scan(make([(4, "fresh token=abcdef1"), (1, "token=abcdef1")]), ledger=ledger, rules=rules)
    kinds = [sorted(x["kind"] for x in r["scanned"]) for r in new.collect()]
    assert sorted(kinds) == [["access", "assign", "hex"], ["hex"]]  # only what the ledger lacks
    assert all("hex" in [s["kind"] for s in r["spans"]] for r in more.collect())


def test_redaction(make, odd):
    rows = {r["doc_id"]: r["text"] for r in secret_scan.redact(make([(1, "a token=abcdef b"), (2, None), (3, "x")])).collect()}
    assert rows == {1: "a [SECRET] b", 2: None, 3: "x"}
    assert secret_scan.redact(odd).columns == odd.columns and secret_scan.redact(odd).count() == odd.count()


def removed_by_force(rows, width):
    """Words kept per row, straight from the definition."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), (i, s))
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone |= set(range(s, s + width))
        out[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode()
    return out


def test_substring_dedup(make, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 2_000)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 900)
    rng = random.Random(1)
    passages = [" ".join(rng.choices("abcdefg", k=9)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([*passages, *"hijkl é"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a " * 300)]
    got = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup_substrings(make(rows), width=5).collect()}
    assert got == removed_by_force(rows, 5)


def test_substring_dedup_edges(make, odd, spark):
    out = substring_dedup.dedup_substrings(odd).collect()
    assert len(out) == odd.count()
    assert [r["n_words"] for r in out if r["doc_id"] in (2, 3, 6)] == [0, 0, 0]
    assert {len(r["kept"]) for r in out if r["doc_id"] == 5} == {0}  # the second long copy
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def hits_by_force(docs, items, window):
    out = {}
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for name, item in items:
            v = words_of(item)
            for s in range(max(1, len(v) - window + 1)):
                p = v[s : s + window]
                for at in range(len(w) - len(p) + 1) if p else ():
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def test_decontamination(make, spark):
    rng = random.Random(3)
    vocabulary = [*"abcdefgh", "É", "9", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(12)] + [(50, ""), (51, None), (52, "É É É É É")]
    docs = [(i, "; ".join(rng.choices([*vocabulary, "zz", "A", *[t for _, t in items if t]], k=rng.randint(0, 25)))) for i in range(60)] + [(90, None), (91, "É " * 40)]
    table = spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string")
    want = hits_by_force(docs, items, 4)
    for slice_bytes in (1 << 20, 300):  # one pass and several
        rows = decontaminate.decontaminate(make(docs), table, window=4, slice_bytes=slice_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in rows} == want


def test_cut_out(make, odd, spark):
    items = spark.createDataFrame([(1, "w1 w2 w3")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.cut_out(make([(1, "x w1 W2, w3 y"), (2, "w1 w2 w3"), (3, None), (4, "clean")]), items).collect()}
    assert got == {1: ("x \n y", 5), 3: (None, None), 4: ("clean", 5)}
    none = items.limit(0)
    assert decontaminate.cut_out(odd, none).count() == odd.count()
    assert decontaminate.cut_out(odd.limit(0), items).count() == 0


def test_words_and_windows():
    texts = [b"", b" a bb\tccc ", b"x" * 300 + b" y", bytes(range(1, 256))]
    for kind, split in ((NOT_SPACE, lambda t: t.split()), (ALNUM, lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))):
        w = hash_words(texts, kind)
        assert [w.buffer[a:b] for a, b in zip(w.begin, w.end)] == [x for t in texts for x in split(t)]
        assert w.first.tolist() == np.cumsum([0, *(len(split(t)) for t in texts)]).tolist()
    h = mix(np.arange(60, dtype=np.uint64))
    for width in (1, 3, 5, 20):
        r = rolling(np.concatenate([h, h]), width)
        assert len(r) == 121 - width and (r[: 61 - width] == r[60:]).all() and len(np.unique(r[:60])) == 60


def test_query_digest(spark):
    from spotweave.llm.queries import QUERIES

    row = next(r for r in QUERIES["op1_secret_scans"](spark, "/root/testdata/sf0.01").collect() if r["spans"])
    assert row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest()


def test_slices_are_cut_before_they_are_read(monkeypatch):
    """Texts become Python values a slice at a time, however many a batch holds."""
    texts = ["ab", None, "éé", "", "C" * 9, "d", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "text"])
    read = []
    monkeypatch.setattr(text, "text_bytes", lambda column, plain=text.text_bytes: read.append(len(column)) or plain(column))
    got = [(part.column("i").to_pylist(), own) for part, own in text.chunks([batch, batch.slice(0, 0)], "text", 6, lower=True)]
    assert got == [([0, 1, 2, 3], [b"ab", b"", "éé".encode(), b""]), ([4], [b"c" * 9]), ([5, 6], [b"d", b""])]
    assert read == [4, 1, 2]


def test_a_shard_holds_little():
    """Working memory of a task's shards: 10 million bytes of text, a benchmark word in ten."""
    draw = random.Random(2)
    needles = decontaminate.Needles([list(range(1, 11))], [["i"]])
    needles.vocabulary = np.unique(hash_words([b" ".join(b"w%d" % i for i in range(100))], ALNUM).hashes)
    needles.patterns = [np.arange(1, 11)]
    texts = [" ".join(f"w{draw.randrange(1000)}" for _ in range(20_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    tracemalloc.start()
    rows = sum(part.num_rows for part in decontaminate._search(needles, iter([batch]), [], True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 80 << 20
