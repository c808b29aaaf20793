"""Near copies by SimHash fingerprints, found with BK-trees.

A fingerprint bit is 1 if over half of the XXH64 hashes of the text's three-word shingles,
repeats included, have it. Equal fingerprints are one node. Links of at most two bits are
searched in BK-trees: a node's children are keyed by their Hamming distance to it, and a query at
distance ``d`` follows the edges ``d - 2`` to ``d + 2`` only.

Trees are built per shard, and a query meets every shard that can hold a partner: of three bit
fields of a fingerprint, two that differ in two bits share at least one, so a shard is the
fingerprints that share a field. A shard of over ``SHARD`` fingerprints is cut again by three
fields of its remaining bits, until it is small or so few bits remain that it must be; no
fingerprint is dropped. Queries of a shard are its own members, so its tree stays in the task that
builds it: broadcast trees would bring the fingerprints of all documents to the driver. A task
returns links of a spanning forest of its shard, at most one per member.

Defined results: a NULL text has no words; texts without words have fingerprint zero and link like
any other; fewer than three words are one shingle; repeated rows each get a row; a row without id
has a fingerprint, no component, and joins nothing; rows that share an id are nodes of their own;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from spotweave.llm.components import components
from spotweave.llm.text import chunks
from spotweave.session import cut_lineage

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
SHARD = 512
# Shards that a task of the search holds together.
BLOCK_ROWS = 20_000
# Hashes whose bits are counted at a time.
STEP = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of a text of lower case."""
    words = text.split()  # of bytes: the white space of ASCII
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_(b" ".join(words), SEED)
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]).tolist()  # behind the space after each word
    begin = [0, *end[: -width]]
    n = len(begin)
    ones = np.zeros(BITS, np.int64)
    for low in range(0, n, STEP):
        own = [hash_(joined[a : b - 1], SEED) for a, b in zip(begin[low : low + STEP], end[low + width - 1 : low + STEP + width - 1])]
        bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``; ``fp`` has the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", lower=True):
            found = np.array([fingerprint(t) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Numbers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius``."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius:
                open_ += [child for edge, child in children.items() if d - radius <= edge <= d + radius]
            else:
                open_ += [children[edge] for edge in range(d - radius, d + radius + 1) if edge in children]
        return found


def spanning_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within ``radius`` that join ``values`` into the components that all such links make."""
    tree, root, out = BKTree(), list(range(len(values))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((value, values[j]))
        tree.add(value)
    return out


def shards(nodes: DataFrame, radius: int = RADIUS, most: int | None = None) -> DataFrame:
    """``(shard, fp)`` of ``nodes(fp)``: every two that differ in ``radius`` bits or fewer share a shard,
    and a shard has at most ``most`` of them, or all that its last few bits allow.

    Shards are named by a hash; two of one name would only be searched together."""
    most = most or SHARD
    few = most.bit_length()
    count = radius + 1
    # ``places`` are the bits by which members of a shard still differ.
    mask = F.aggregate("k.field", F.lit(0).cast("bigint"), lambda bits, place: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)))
    bound = lambda i: F.floor(F.size("places") * i / count).cast("int")
    field = lambda i: F.slice("places", bound(i) + 1, bound(i + 1) - bound(i)).alias("field")
    done, open_ = [], nodes.select(F.lit(0).cast("bigint").alias("shard"), F.sequence(F.lit(0), F.lit(BITS - 1)).alias("places"), "fp")
    while True:
        cut = open_.select("shard", "places", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda i: F.struct(i.alias("i"), field(i)))).alias("k"))
        name = F.xxhash64("shard", "k.i", F.col("fp").bitwiseAND(mask))
        dealt = cut_lineage(cut.select(name.alias("shard"), F.array_except("places", "k.field").alias("places"), "fp"))
        sizes = dealt.where(F.size("places") > few).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        big = cut_lineage(sizes.where(F.col("n") > most).select("shard"))
        if big.isEmpty():
            break
        done.append(dealt.join(big, "shard", "left_anti"))
        open_ = dealt.join(big, "shard", "left_semi")
    for more in done:
        dealt = dealt.unionByName(more)
    return dealt.select("shard", "fp")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: pairs of ``nodes(fp)`` within ``radius`` that join all such pairs' components."""
    dealt = cut_lineage(shards(nodes, radius))
    blocks = max(1, -(-dealt.count() // BLOCK_ROWS))

    def search(block: pa.Table) -> pa.Table:
        shard = block.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        values = block.column("fp").to_numpy()[order].view(np.uint64).tolist()
        ends = np.flatnonzero(np.append(np.diff(shard[order]) != 0, True)) + 1
        found, low = [], 0
        for high in ends.tolist():
            if high - low > 1:
                found += spanning_links(sorted(values[low:high]), radius)
            low = high
        a, b = (np.array(c, np.uint64).view(np.int64) for c in (zip(*found) if found else ([], [])))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.withColumn("block", F.pmod("shard", F.lit(blocks))).groupBy("block").applyInArrow(search, "a bigint, b bigint")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row ``(doc_id, fingerprint, component_id)``: 16 hexadecimal digits and the smallest id that
    links of at most ``radius`` bits reach."""
    rows = cut_lineage(fingerprints(docs, doc_id, text))
    nodes = cut_lineage(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(nodes.select("fp"), radius))
    named = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = cut_lineage(named)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(least, "component").select("fp", "component_id")
    out = rows.join(ids, "fp", "left")
    hex_ = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hex_.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
