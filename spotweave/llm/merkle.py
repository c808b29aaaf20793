"""A Merkle manifest of a table: a leaf digest per row, a tree per source, one root, and the proof
of every row.

Rollup of nested structs: a leaf's rank in its source has base-16 digits. Within a block of 256
leaves, the last digit is grouped away first (16 leaves become a struct with their digest), then
the next one. Block digests are the leaves of the next round. Going down again, ``transform``
writes next to each child what stands left and right of it, and ``explode`` turns children into
rows, so that proofs need no joins: a block meets what lies above it in one grouping by block.
Ranks come from a range partitioning and the row numbers inside its partitions, so a source of
any size is spread out; a block is the most that a task holds at a time.

Only digests and ids move, never texts. Defined results: a NULL column enters a leaf as ``-``;
NULL ids come first in their source, ties (repeated ids) are ordered by leaf, repeated rows have a
proof each; the NULL source comes before all others; a source of one row is its leaf; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.session import broadcast_if_small, cut_lineage

FAN = 16
BLOCK = FAN * FAN
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each ``-`` or its length in bytes, ``:`` and itself."""
    fields = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*fields), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows(g, ...)`` with ``rank``, from 0 within ``g`` by ``order``, and ``m``, the rows of ``g``."""
    dealt = rows.repartitionByRange(F.asc_nulls_first("g"), *(F.asc_nulls_first(c) for c in order))
    sorted_ = dealt.sortWithinPartitions(F.asc_nulls_first("g"), *(F.asc_nulls_first(c) for c in order))
    numbered = cut_lineage(sorted_.withColumn("_at", F.monotonically_increasing_id()))
    # A range partition holds a run of each of its groups: groups + partitions rows at most.
    runs = numbered.groupBy("g", F.shiftright("_at", 33).alias("_p")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    named = cut_lineage(runs)
    every = named.groupBy("g").agg(F.sum("_n").alias("m"), F.sort_array(F.collect_list(F.struct("_p", "_low", "_n"))).alias("_runs"))
    before = F.transform("_runs", lambda r, i: F.struct(r["_p"], (F.aggregate(F.slice("_runs", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["_n"]) - r["_low"]).alias("_shift")))
    shift = every.select("g", "m", F.inline(before)).toDF("_g", "m", "_p", "_shift")
    joined = numbered.join(broadcast_if_small(shift), F.col("g").eqNullSafe(F.col("_g")) & (F.shiftright("_at", 33) == F.col("_p")))
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).select("g", "rank", "m", *(c for c in rows.columns if c != "g"))


def _digest(kids: str, several: Column) -> Column:
    return F.when(several, F.sha2(F.array_join(F.transform(kids, lambda k: k["hash"]), ""), 256)).otherwise(F.col(kids)[0]["hash"])


def nest(nodes: DataFrame) -> DataFrame:
    """``nodes(g, rank, m, hash, item)`` as nested blocks ``(g, block, m, hash, kids)``. A level of
    one node is that node."""
    block, tens, ones = (F.expr(e) for e in (f"rank div {BLOCK}", f"int(rank div {FAN} % {FAN})", f"int(rank % {FAN})"))
    moved = nodes.select("g", block.alias("block"), "m", tens.alias("tens"), ones.alias("ones"), "hash", "item").repartition("g", "block")
    runs = moved.groupBy("g", "block", "m", "tens").agg(F.sort_array(F.collect_list(F.struct("ones", "hash", "item"))).alias("kids"))
    runs = runs.withColumn("hash", _digest("kids", F.col("m") > 1))
    blocks = runs.groupBy("g", "block", "m").agg(F.sort_array(F.collect_list(F.struct("tens", "hash", "kids"))).alias("kids"))
    return blocks.withColumn("hash", _digest("kids", F.col("m") > FAN))


def _beside(kids: Column, i: Column) -> tuple[Column, Column]:
    """Digests left and right of child ``i``."""
    joined = lambda part: F.array_join(F.transform(part, lambda k: k["hash"]), "")
    return joined(F.slice(kids, 1, i)).alias("left"), joined(F.slice(kids, i + 2, F.lit(FAN))).alias("right")


def unnest(blocks: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Nodes of ``blocks`` that have a ``path`` above: ``(g, hash, item, path, ...)``, where ``path``
    lists what stands left and right on every level from the node up."""
    outer = F.transform("kids", lambda k, i: F.struct(k["kids"].alias("kids"), *_beside(F.col("kids"), i)))
    tens = blocks.select("g", "m", "path", *carried, F.explode(outer).alias("run"))
    level = F.array(F.struct("run.left", "run.right"))
    tens = tens.withColumn("path", F.when(F.col("m") > FAN, F.concat(level, "path")).otherwise(F.col("path")))
    inner = F.transform("run.kids", lambda k, i: F.struct(k["hash"].alias("hash"), k["item"].alias("item"), *_beside(F.col("run.kids"), i)))
    ones = tens.select("g", "m", "path", *carried, F.explode(inner).alias("kid"))
    level = F.array(F.struct("kid.left", "kid.right"))
    path = F.when(F.col("m") > 1, F.concat(level, "path")).otherwise(F.col("path"))
    return ones.select("g", "kid.hash", "kid.item", path.alias("path"), *carried)


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Written blocks of every round, until each ``g`` has one block."""
    rounds = []
    while True:
        rounds.append(cut_lineage(nest(nodes)))
        if (rounds[-1].agg(F.max("m")).first()[0] or 0) <= BLOCK:
            return rounds
        above = F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")
        nodes = rounds[-1].select("g", F.col("block").alias("rank"), above.alias("m"), "hash", F.struct("block").alias("item"))


def _meet(blocks: DataFrame, above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``blocks`` with ``path`` and the carried columns of ``above(g, block, ...)``."""
    names = ["path", *carried]
    both = blocks.select("g", "block", "m", "kids").unionByName(above.select("g", "block", *names), allowMissingColumns=True)
    # One row of each kind per block.
    return both.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("m", "kids", *names)))


def descend(rounds: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Nodes of the first round with their paths; ``above`` has the paths of the last round's blocks."""
    for blocks in reversed(rounds[1:]):
        nodes = unnest(_meet(blocks, above, carried), carried)
        above = nodes.select("g", F.col("item.block").alias("block"), "path", *carried)
    return unnest(_meet(rounds[0], above, carried), carried)


def manifest(docs: DataFrame, tampered: Column, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Per row ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``.

    ``columns`` name id, source and what else enters a leaf, the text last. Where ``tampered`` holds,
    the text's A-Z are lower-cased before the row is verified."""
    values = [F.col(c) for c in columns]
    changed = F.when(tampered, leaf_digest([*values[:-1], lower_az(values[-1].cast("string"))]))
    leaves = cut_lineage(docs.select(F.col(columns[1]).cast("string").alias("g"), F.col(columns[0]).cast("bigint").alias("id"), leaf_digest(values).alias("hash"), changed.alias("changed")))
    rows = ranked(leaves, ["id", "hash"])
    rounds = grow(rows.select("g", "rank", "m", "hash", F.struct("id", "changed").alias("item")))

    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "hash")
    above = grow(ranked(subroots, ["name"]).select("g", "rank", "m", "hash", F.struct("name").alias("item")))
    empty = F.array().cast("array<struct<left: string, right: string>>")
    top = above[-1].select("g", "block", empty.alias("path"), F.col("hash").alias("root"))
    sources = descend(above, top, ["root"])
    sources = sources.select(F.col("item.name").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", F.col("hash").alias("subroot"), "root")
    found = descend(rounds, sources, ["subroot", "root"])
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("item.changed", "hash"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = found.select(F.col("item.id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
