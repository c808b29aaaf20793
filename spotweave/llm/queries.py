"""The registered queries of the operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The text must be the same in both engines, so the patterns are spelled out again.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, 6 AS least,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hits,
    string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals
  FROM d
  UNION ALL
  SELECT doc_id, 1, 'access', 20, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL
  SELECT doc_id, 2, 'hex', 24, regexp_extract_all(t, '[0-9a-f]+', 0), string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0) FROM d
),
e AS (
  SELECT doc_id, rank, kind, least, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(vals) AS val, unnest(range(len(hits))) AS i FROM m
),
p AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM e
),
s AS (SELECT doc_id, rank, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM p WHERE length(val) >= least),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


@query("op1_secret_scans", OP1_SQL)
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import secret_scan

    found, _ = secret_scan.scan(table(spark, sf_dir, "documents"))
    names = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    spans = F.array_join(names, ",")
    return found.select(
        F.col("path").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT doc_id, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
# lower() of A-Z only.
OP6_SQL = OP6_SQL.replace("lower_az(coalesce(text, ''))", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import decontaminate

    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spotweave.llm import packing
    from spotweave.session import cut_lineage

    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    narrow = cut_lineage(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(narrow)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
firsts AS (SELECT h, min((doc_id, i)) AS first FROM win GROUP BY h),
hit AS (SELECT win.doc_id, i FROM win JOIN firsts USING (h) WHERE (doc_id, i) > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op5_substring_dedup", OP5_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import substring_dedup

    done = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])
    return done.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)
"""


@query("op2_jaccard_join", OP2_SQL)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import jaccard_join

    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op4_ppm_score")
def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import ppm
    from spotweave.session import cut_lineage

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = docs.where("NOT held_out").select("text")
    nodes = ppm.train(training)
    words = cut_lineage(ppm.count_words(training))
    train_tokens = words.agg(F.sum("n")).first()[0] or 0
    scored = ppm.score_with_base(docs, nodes, words, keep_text=False)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


@query("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import quality

    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learnt from."""
    return table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    classifier = toxicity.fit(docs, training_labels(spark, sf_dir))
    scored = toxicity.score(docs.select("doc_id", "text"), classifier)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import html_text

    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING n >= 100 OR k = 1),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a FROM f WHERE k > 1),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c longer WHERE longer.lang = c.lang AND longer.k > c.k AND 100 * longer.a >= 100 * c.a AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))
),
cut AS (
  SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)
),
scored AS (
  SELECT cut.lang, cut.phrase, a, j, x.n AS l, y.n AS r, total.n, ((1000::HUGEINT * a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN total ON total.lang = cut.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best QUALIFY rank <= 2000
"""


@query("op13_phrase_mining", OP13_SQL)
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import phrases

    return phrases.phrases(table(spark, sf_dir, "documents"))


def _op11_sql(levels: int = 6, top_levels: int = 3) -> str:
    """One block of steps per level: 16^6 rows of a source and 16^3 sources are far more than a test has."""
    parts = [
        r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, coalesce('s' || source, '') AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS hit
  FROM documents, crc
),
n0 AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS hash, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low, hit,
    row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM d
),
d0 AS (SELECT doc_id, g, hash AS leaf, pos, CASE WHEN hit THEN low ELSE hash END AS f, '' AS proof FROM n0)"""
    ]

    def climb(tree: str, way: str, count: int) -> None:
        for i in range(count):
            parts.append(f"{tree}r{i} AS (SELECT g, pos // 16 AS run, list(hash ORDER BY pos) AS hs, any_value(m) AS m FROM {tree}{i} GROUP BY 1, 2)")
            parts.append(f"{tree}{i + 1} AS (SELECT g, run AS pos, CASE WHEN m > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS hash, (m + 15) // 16 AS m FROM {tree}r{i})")
            parts.append(
                f"{way}{i + 1} AS (SELECT x.* EXCLUDE (pos, f, proof), pos // 16 AS pos, "
                f"CASE WHEN m > 1 THEN sha256(array_to_string(hs[1:pos % 16], '') || f || array_to_string(hs[pos % 16 + 2:], '')) ELSE f END AS f, "
                f"proof || CASE WHEN m > 1 THEN array_to_string(hs[1:pos % 16], '') || array_to_string(hs[pos % 16 + 2:], '') ELSE '' END AS proof "
                f"FROM {way}{i} x JOIN {tree}r{i} y ON x.{'g' if tree == 'n' else 'top'} = y.g AND x.pos // 16 = y.run)"
            )

    climb("n", "d", levels)
    parts.append(f"u0 AS (SELECT 0 AS g, g AS name, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS m FROM n{levels})")
    parts.append(f"e0 AS (SELECT doc_id, leaf, u0.hash AS subroot, 0 AS top, u0.pos AS pos, f, proof FROM d{levels} z JOIN u0 ON z.g = u0.name)")
    climb("u", "e", top_levels)
    last = f"SELECT doc_id, leaf, subroot, r.hash AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.hash AS verified FROM e{top_levels}, u{top_levels} r"
    return ",\n".join(parts) + "\n" + last


@query("op11_merkle_manifest", _op11_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import merkle

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotweave.llm import simhash

    return simhash.near_copies(table(spark, sf_dir, "documents"))
