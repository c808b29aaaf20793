"""Near-duplicate classes by a grouped prefix join on word shingles.

A document is its set of distinct ``WIDTH``-word shingles. Shingles have one global order,
rarest first; two sets that reach the threshold share a shingle among the first
``n - ceil(t n) + 1`` of each. Steps, all exact:

1. Documents with equal sets are one class; classes with the same size and the same prefix
   are one group, and only groups enter the index ``(shingle, group, size)``.
2. Each group is paired with the centre it shares most shingles with (a star), and the pairs
   are verified. A large set of near copies so becomes one component with one pair per member.
3. Documents with one centre are a family. Pairs of a family that are still in two components
   are compared in blocks by bitmaps of the sets, and what those cannot rule out is verified.
4. Every remaining pair that shares a prefix shingle, lies in two components and two families
   and passes the size filter and the overlap bound is expanded to members and verified. Pairs inside
   a component cannot change the result, so nothing is lost.

The order uses how often a shingle's rarest word occurs, read from a fixed-size count sketch
of all words; it decides only how many candidates there are, any order gives the same result.

Defined results: a NULL or text without words has an empty set and links with nothing; rows
that share an id are one node; rows with a NULL id get no component (NULL) and link with
nothing; other columns are ignored; an empty table gives no rows. Different shingles share a
hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.components import components
from spotweave.llm.text import NOT_SPACE, chunks, free_name, hash_words, mix, text_bytes, windows
from spotweave.session import broadcast_if_small, cut_lineage

WIDTH = 5
# Similarity of at least 75 %: intersection >= 3 / 7 of the summed sizes.
PERCENT = 75
SKETCH_BITS = 20
SKETCH_PARTS = 64
# Members of a family that are compared with as many others in a task.
BLOCK = 512
# Groups with a shingle above which it is not counted for every pair.
FREQUENT = 64


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """Smallest overlap of a set of ``n`` with any set similar to it."""
    return -(-n * percent // 100)


def word_sketch(rows: DataFrame) -> np.ndarray:
    """How often the words of each hash class occur, on a logarithmic scale: 2**20 bytes,
    whatever the corpus. Tasks send their counts in parts, which add up as they arrive."""
    size = 1 << SKETCH_BITS
    step = size // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, texts in chunks(batches, "text", lower=True):
            words = hash_words(texts, NOT_SPACE)
            total += np.bincount((words.hashes & np.uint64(size - 1)).astype(np.int64), minlength=size)
        parts = [total[i * step : (i + 1) * step].tobytes() for i in range(SKETCH_PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros(size, np.int64)
    for row in rows.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():
        out[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(np.log2(out + 1.0) * 6, 255).astype(np.uint8)


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes, sorted, with the hashes of the words and the
    place of each shingle's first word. ``texts`` are lower-cased."""
    words = hash_words(texts, NOT_SPACE)
    full, _ = windows(words, width)
    for d in range(len(texts)):
        a, b = words.first[d], words.first[d + 1]
        if b - a >= width:
            yield *np.unique(full[a : b - width + 1], return_index=True), words.hashes[a:b]
        elif b > a:  # the whole sequence
            steps = words.hashes[a:b] + np.arange(b - a, dtype=np.uint64)
            yield mix(np.array([np.bitwise_xor.reduce(mix(steps))], np.uint64) + np.uint64(b - a)), np.zeros(1, np.int64), words.hashes[a:b]
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64), words.hashes[a:b]


def prefix(shingles: np.ndarray, first: np.ndarray, words: np.ndarray, sketch: np.ndarray, width: int, percent: int) -> np.ndarray:
    """The rarest shingles that a similar set must meet, as order keys in order."""
    n = len(shingles)
    if not n:
        return shingles
    often = sketch[(words & np.uint64(len(sketch) - 1)).astype(np.int64)]
    rarest = often[first]
    for i in range(1, min(width, len(words))):
        rarest = np.minimum(rarest, often[np.minimum(first + i, len(words) - 1)])
    keys = (rarest.astype(np.uint64) << np.uint64(56)) | (shingles >> np.uint64(8))
    p = n - needed(n, percent) + 1
    return np.sort(np.partition(keys, p - 1)[:p] if p < n else keys)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 2 n or more hash classes (a power of two).
    The bits in which two bitmaps differ are at most the shingles in which the sets do."""
    size = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles) >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as words, reduced to ``size`` bytes: classes i and i + half become one."""
    out = np.frombuffer(bits, np.uint64)
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def may_be_similar(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """False only if the bitmaps prove that the sets differ in too many shingles."""
    size = min(len(a), len(b))
    apart = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


def _token(keys: np.ndarray) -> np.ndarray:
    """48 bits of a shingle are enough for an index entry: a clash costs a verification."""
    return (mix(keys) >> np.uint64(16)).view(np.int64)


def signatures(rows: DataFrame, sketch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n, set_id, prefix_id, bits)``: size, digests of set and prefix, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", lower=True):
            out = []
            for shingles, first, words in shingle_sets(texts, width):
                keys = prefix(shingles, first, words, sketch.value, width, percent)
                sums = [int(x.sum()) for x in (mix(shingles), mix(shingles ^ np.uint64(0x5DEECE66D)))]
                place = np.arange(len(keys), dtype=np.uint64)
                out.append((len(shingles), b"".join(s.to_bytes(8, "little") for s in sums), int(mix(keys + mix(place)).sum().view(np.int64)), bitmap(shingles)))
            kinds = (pa.int32(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=["doc_id", "n", "set_id", "prefix_id", "bits"])

    return rows.mapInArrow(run, "doc_id bigint, n int, set_id binary, prefix_id bigint, bits binary")


def prefixes(rows: DataFrame, sketch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", lower=True):
            got = [(len(s), _token(prefix(s, f, w, sketch.value, width, percent)).tobytes()) for s, f, w in shingle_sets(texts, width)]
            n, tokens = zip(*got)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "tokens"])

    return rows.mapInArrow(run, "doc_id bigint, n int, tokens binary")


def index_entries(packed: DataFrame) -> DataFrame:
    """``(token, doc, n, room)`` from packed prefixes; ``room`` is the number of shingles of
    the set from this one on, in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                lists = [np.frombuffer(t, np.int64) for t in part.column("tokens").to_pylist()]
                sizes = [len(t) for t in lists]
                doc, n = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("doc_id", "n"))
                room = n - np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(doc), pa.array(n), pa.array(room.astype(np.int32))], names=["token", "doc", "n", "room"])

    return packed.mapInArrow(run, "token bigint, doc bigint, n int, room int")


def family_pairs(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` of ``members(family, doc, n, bits, component)`` that are in one
    family and in two components and that the bitmaps do not rule out. A family is split into
    blocks of about ``BLOCK`` members; each pair of blocks is compared in a task, and only
    what passes leaves it."""
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    spread = members.join(size.select("family", blocks.alias("m")), "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    dealt = spread.select("family", "doc", "n", "bits", "component", "block", other)
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, x, y = (k.as_py() for k in key)
        doc, n, component, block = (table.column(c).to_numpy() for c in ("doc", "n", "component", "block"))
        bits = table.column("bits").to_pylist()
        size = np.array([len(b) for b in bits])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(size).tolist():  # a set meets those whose bitmap is as large, or larger and folded
            rows = np.flatnonzero(size >= width)
            folded = np.stack([fold(bits[r], width) for r in rows])
            for i in np.flatnonzero(size[rows] == width):
                r = rows[i]
                near = (component[rows] != component[r]) & ((x == y) | (block[rows] != block[r])) & ((size[rows] > width) | (doc[rows] > doc[r]))
                near &= (n[rows] * 100 >= n[r] * percent) & (n[r] * 100 >= n[rows] * percent)
                at = np.flatnonzero(near)
                apart = np.bitwise_count(folded[at] ^ folded[i]).sum(1, dtype=np.int64)
                at = at[apart * (100 + percent) <= (n[rows[at]].astype(np.int64) + n[r]) * (100 - percent)]
                out.append((np.full(len(at), doc[r]), doc[rows[at]]))
        a, b = (np.concatenate(v) for v in zip(*out)) if out else (np.empty(0, np.int64),) * 2
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("family", "x", "y").applyInArrow(run, "a bigint, b bigint")


def plausible(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that the bitmaps of ``sets(doc_id, n, bits)`` do not rule out."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bitsa", "na", "bitsb", "nb")]
            keep = pa.array([may_be_similar(*x, percent) for x in zip(*columns)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a bigint, b bigint")


def verify(rows: DataFrame, pairs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` whose texts reach the threshold, from the whole texts. Only texts
    of documents in a pair are moved."""
    pairs = cut_lineage(pairs.select("a", "b").distinct())
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = rows.join(broadcast_if_small(cut_lineage(ids)), "doc_id", "left_semi")
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for batch in batches:
            out = []
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ta, tb = (text_bytes(part.column(f"text_{k}")) for k in "ab")
                sets = [s for s, _, _ in shingle_sets([t.lower() for t in ta], width)]
                for a, b, own, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets, tb):
                    if text != last[0]:
                        last = (text, next(shingle_sets([text.lower()], width))[0])
                    common = len(np.intersect1d(own, last[1], assume_unique=True))
                    union = len(own) + len(last[1]) - common
                    if common and 100 * common >= percent * union:
                        out.append((a, b))
            a, b = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row ``(doc_id, n_shingles, component_id)``: the set's size and the smallest id that
    links of similarity ``percent`` / 100 or more reach."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = spark.sparkContext.broadcast(word_sketch(rows))
    named = cut_lineage(signatures(rows, sketch, width, percent))

    # Classes of equal sets, and groups of classes with one size and prefix.
    sized = named.where("n > 0 AND doc_id IS NOT NULL")
    sets = sized.select("doc_id", "n", "bits")
    classes = cut_lineage(sized.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix_id").alias("prefix_id")))
    groups = classes.groupBy("n", "prefix_id").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("members"))
    members = cut_lineage(classes.join(groups.where("members > 1"), ["n", "prefix_id"]).select("leader", F.col("rep").alias("doc"), "n"))
    led = groups.select(F.col("leader").alias("doc_id"))
    idle = cut_lineage(sized.select("doc_id").join(led, "doc_id", "left_anti").distinct())
    indexed = rows.join(broadcast_if_small(idle), "doc_id", "left_anti").where("doc_id IS NOT NULL")
    packed = cut_lineage(prefixes(indexed, sketch, width, percent))
    entries = index_entries(packed)

    # Only shingles of two or more groups matter from here on.
    centres = entries.groupBy("token").agg(F.min("doc").alias("centre"), F.max("doc").alias("other")).where("centre < other")
    shared = cut_lineage(entries.join(centres.select("token", "centre"), "token"))

    # Stars: the centre each document shares most shingles with. A hint, not a condition:
    # whoever shares less than this is left to the exact step.
    counted = shared.where("doc <> centre").groupBy("doc", "centre").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    best = counted.groupBy("doc").agg(F.max_by("centre", F.struct("c", -F.col("centre"))).alias("b"), F.max("c").alias("c"), F.first("n").alias("n"))
    best = cut_lineage(best.where(F.col("c") * 500 >= F.col("n") * (100 - percent)).select(F.col("doc").alias("a"), "b"))
    inside = members.where("leader <> doc").select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    links = cut_lineage(verify(rows, plausible(sets, best.union(inside), percent), width, percent))
    labels = cut_lineage(components(links))

    # Families: documents whose stars share a centre, and the members of their groups. All their pairs
    # are decided here, in blocks; later steps skip pairs within a family.
    tree = best.union(best.select(F.col("b").alias("a"), "b")).groupBy("a").agg(F.max_by("b", F.col("b") != F.col("a")).alias("family"))
    # A centre that itself has one hands its documents on.
    tree = cut_lineage(tree)
    for _ in range(2):
        tree = tree.join(tree.toDF("family", "next"), "family").select("a", F.col("next").alias("family"))
    tree = cut_lineage(tree)
    led = inside.join(tree.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("family", "b").alias("family"))
    heads = inside.select(F.col("b").alias("a"), F.col("b").alias("family")).distinct().join(tree.select("a"), "a", "left_anti")
    families = cut_lineage(tree.unionByName(led).unionByName(heads).withColumnRenamed("a", "doc"))
    known = lambda frame: frame.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    fresh = cut_lineage(verify(rows, family_pairs(known(families).join(sets.withColumnRenamed("doc_id", "doc"), "doc"), percent), width, percent))
    if not fresh.isEmpty():
        links = links.unionByName(fresh)
        labels = cut_lineage(components(links))

    # Every other pair with a common prefix shingle, in two components and two families. Rare
    # shingles are counted for each pair. A frequent shingle matters only where it is the first common
    # one: then the sets must have room for the needed overlap from there on.
    entries = shared.select("token", "doc", "n", "room")
    others = entries.withColumnRenamed("doc", "leader").join(members.where("leader <> doc").select("leader", "doc"), "leader").select("token", "doc", "n", "room")
    tagged = known(entries.unionByName(others)).join(families, "doc", "left").withColumn("family", F.coalesce("family", "doc"))
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("component", "family") for f in (F.min, F.max)]
    ends = tagged.groupBy("token").agg(*bounds, (F.count(F.lit(1)) > FREQUENT).alias("frequent")).where("min_component < max_component AND min_family < max_family")
    mine = cut_lineage(tagged.join(ends.select("token", "frequent"), "token"))
    near = lambda low, high: F.col(high) * 100 >= F.col(low) * percent
    enough = lambda room, na, nb: F.col(room) * (100 + percent) >= (F.col(na) + F.col(nb)) * percent

    def meetings(part: DataFrame, frequent: bool) -> DataFrame:
        per = part.groupBy("token", "component", "family").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("room"))
        x, y = per.toDF("token", "ca", "fa", "la", "ha", "ra"), per.toDF("token", "cb", "fb", "lb", "hb", "rb")
        meet = (x.token == y.token) & (F.col("ca") < F.col("cb")) & (F.col("fa") != F.col("fb")) & near("la", "hb") & near("lb", "ha")
        if frequent:
            meet = meet & enough("ra", "la", "lb") & enough("rb", "la", "lb")
        pairs = x.join(y, meet).select(x.token, "ca", "fa", "cb", "fb")
        side = lambda k: part.select("token", F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("room").alias(f"room{k}"), F.col("component").alias(f"c{k}"), F.col("family").alias(f"f{k}"))
        pairs = pairs.join(side("a"), ["token", "ca", "fa"]).join(side("b"), ["token", "cb", "fb"]).where(near("na", "nb") & near("nb", "na"))
        return pairs.where(enough("rooma", "na", "nb") & enough("roomb", "na", "nb")) if frequent else pairs

    counted = meetings(mine.where("NOT frequent"), False).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    hidden = mine.where("frequent").groupBy("doc").agg(F.count(F.lit(1)).alias("h"))
    for k in "ab":  # frequent shingles that the two may share besides
        counted = counted.join(hidden.toDF(k, f"h{k}"), k, "left").fillna(0, f"h{k}")
    rest = F.greatest(needed_column(F.col("na"), percent) - 1, needed_column(F.col("nb"), percent) - 1)
    most = F.col("c") + F.least("ha", "hb") + rest
    possible = counted.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")
    possible = possible.union(meetings(mine.where("frequent"), True).select("a", "b")).distinct()
    fresh = cut_lineage(verify(rows, plausible(sets, possible, percent), width, percent))
    if not fresh.isEmpty():
        labels = components(links.unionByName(fresh))

    reps = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("found"))
    out = named.join(reps, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"))


def needed_column(n, percent: int):
    return F.ceil(n * percent / F.lit(100)).cast("int")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document per class: that of the smallest id. Rows that share an id are one
    document; rows without words or id stay."""
    found = jaccard_classes(docs, doc_id, text).where("n_shingles > 0 AND component_id <> doc_id")
    name = free_name(docs, "gone")
    gone = cut_lineage(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(broadcast_if_small(gone), F.col(doc_id).cast("bigint") == F.col(name), "left_anti")
