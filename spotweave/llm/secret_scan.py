"""Secret scans over versions of texts with an incremental ledger of scanned blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a Parquet
folder of ``(blob_id, scanned)``: per blob the rule versions it was scanned under and the
spans found. A run scans a blob only under rule versions the ledger does not hold, appends
what it found, and joins the findings back to every path with that content. All steps are
DataFrame operations; regular expressions run in the JVM.

Defined results: a NULL text counts as empty; rows with the same path or text each get their
own result row; NULL paths are kept; other columns of the input are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.llm.text import free_name
from spotweave.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlaps; a match whose ``group`` is
    shorter than ``least`` is dropped after matching. A changed rule gets a new version."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# Runs of one class are maximal, so {24,} and {16,} match just the long enough ones.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
LEDGER = "blob_id binary, scanned array<struct<kind: string, version: int, spans: array<struct<start: int, end: int>>>>"
SPANS = "array<struct<start: int, end: int>>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _spans(text: Column, hits: Column, rule: Rule) -> Column:
    """Code point spans of the matches ``hits``: the text between matches and the matches
    themselves alternate, so running lengths give the places."""
    between = F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else hits
    steps = F.transform(
        F.arrays_zip(hits.alias("hit"), F.slice(between, 1, F.size(hits)).alias("gap"), values.alias("value")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")),
    )
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["hit"]).alias("at"),
            F.when(
                x["value"] >= rule.least,
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return F.when(F.size(hits) > 0, walked["spans"]).otherwise(F.array().cast(SPANS))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows for ``blobs(blob_id, text, done)``; ``done`` lists ``kind:version`` names
    a blob was scanned under, and a blob that lacks none gives no row."""
    todo = {r: ~F.array_contains("done", f"{r.kind}:{r.version}") for r in rules}
    for i, (rule, new) in enumerate(todo.items()):
        blobs = blobs.withColumn(f"hits{i}", F.when(new, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))))
    found = [
        F.when(
            F.col(f"hits{i}").isNotNull(),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("text"), F.col(f"hits{i}"), r).alias("spans")),
        )
        for i, r in enumerate(rules)
    ]
    scanned = blobs.select("blob_id", F.array_compact(F.array(*found)).alias("scanned"))
    return scanned.where(F.size("scanned") > 0)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for the distinct blobs of ``versions`` that ``ledger`` has not seen
    under every rule version. Written to the shared folder, so it is computed once."""
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    blobs = versions.select(blob_id(F.col(text)).alias("blob_id"), content).groupBy("blob_id").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("done", F.array().cast("array<string>"))
    else:
        names = F.transform("scanned", lambda x: F.concat_ws(":", x["kind"], x["version"]))
        seen = ledger.select("blob_id", names.alias("names")).groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("done"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    return cut_lineage(scan_blobs(blobs, rules))


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(path, spans)`` for every row of ``versions``: all findings of its content under the
    current rule versions, ordered by start, then by rule. Joins the narrow path table with
    the blobs that have findings; a content held by very many paths is split by the join."""
    current = F.lit(False)
    rank = F.lit(len(rules))
    for i, r in enumerate(rules):
        current = current | ((F.col("s.kind") == r.kind) & (F.col("s.version") == r.version))
        rank = F.when(F.col("s.kind") == r.kind, F.lit(i)).otherwise(rank)
    rows = (
        ledger.where(F.exists("scanned", lambda x: F.size(x["spans"]) > 0))
        .select("blob_id", F.explode("scanned").alias("s"))
        .where(current)
        .select("blob_id", F.transform("s.spans", lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.col("s.kind").alias("kind"))).alias("spans"))
    )
    # A blob seen twice under one rule version (two runs at once) counts once.
    per_blob = rows.groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    paths = versions.select(F.col(path).alias("path"), blob_id(F.col(text)).alias("blob_id"))
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    return paths.join(per_blob, "blob_id", "left").select("path", F.coalesce("spans", none).alias("spans"))


def scan(versions: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every row, and the new ledger rows to append to the caller's ledger."""
    new = update_ledger(versions, ledger, text, rules)
    whole = new if ledger is None else ledger.select("blob_id", "scanned").unionByName(new)
    return findings(versions, whole, path, text, rules), new


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans are
    one. Rows without a finding are unchanged, a NULL text stays NULL."""
    blob, found = free_name(docs, "blob"), free_name(docs, "found")
    new = update_ledger(docs, None, text)
    ledger = new.where(F.exists("scanned", lambda x: F.size(x["spans"]) > 0))
    spans = F.array_sort(F.flatten(F.transform("scanned", lambda s: s["spans"])))
    per_blob = ledger.select(F.col("blob_id").alias(blob), spans.alias(found))
    keyed = docs.withColumn(blob, blob_id(F.col(text))).join(per_blob, blob, "left")
    body = F.col(text)
    cut = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    redacted = F.when(F.col(found).isNotNull() & body.isNotNull(), cut).otherwise(body)
    return keyed.withColumn(text, redacted).select(*docs.columns)
