"""The operators of this subpackage as registered queries over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import audits, decontam, knlm, langid, mixing, neardup, quality, sharding, suffix_dedup, token_files, warc
from sketchloom.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**audits.QUERIES}
SQL: dict[str, str] = {**audits.SQL}


def register(query):
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_suffix_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_dedup.deduplicated(docs, texts=False).drop("spans", "kept")


@register
def op2_token_files(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_files.read(spark, token_files.write(docs, tokenizer_path(), end_id=1))


@register
def op3_warc(spark, folder):
    archives = warc.write(warc.with_revisits(table(spark, folder, "pages").select("page_id", "url", "html")))
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM f
"""


@register
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    rows = materialize(mixing.sized(docs, keep=False), "mix-sizes")
    plan = mixing.targets(rows, mixing.by_code_point((5, 2, 1)), share=1.5, max_epochs=2.0)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.mix(rows, plan).select("row.doc_id", "size", "source_size", "target", taken)


SQL["op4_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
-- Sources by rising cap per weight: those before the first that is not clamped are clamped.
o AS (
  SELECT *, 1.5 * sum(size) OVER () - 2.0 * coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s WINDOW w AS (ORDER BY 2.0 * size / weight, source NULLS LAST)),
r AS (SELECT arg_min(rest::DOUBLE / open, 2.0 * size / weight) FILTER (2.0 * size / weight >= rest / open) AS rate FROM o),
t AS (
  SELECT source, size AS source_size, least(weight * (SELECT rate FROM r), 2.0 * size)::DOUBLE AS target FROM s),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
m AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2.0 < need THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
"""


@register
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(langid.learned(docs)), keep=["doc_id"])
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out")
    return found.select("doc_id", held_out, "language.lang_pred", "language.score")


@register
def op6_sharding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = materialize(sharding.keyed(docs, keep=False), "shard-rows")
    return sharding.assign(rows, shards=16).select(
        "row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


@register
def op7_near_dedup(spark, folder):
    found = neardup.components(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@register
def op8_decontamination(spark, folder):
    found = decontam.with_hits(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("bigint").alias("n_items"), decontam.digest(F.col("hits.items")).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated")
    )


ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op7_near_dedup"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE ' ' || array_to_string(w, ' ') END AS shingle
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

SQL["op8_decontamination"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS many, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS words
  FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(k) WHERE len(w) > 0),
x AS (
  SELECT doc_id, k, many, array_to_string(w[k:k + many - 1], ' ') AS words
  FROM d, (SELECT DISTINCT many FROM v) m, unnest(range(1, len(w) - many + 2)) u(k)),
f AS (SELECT doc_id, k, x.many, item FROM x JOIN v ON v.words = x.words AND v.many = x.many),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM f, unnest(range(0, many)) u(j) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""


@register
def op9_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    stats = materialize(quality.with_statistics(docs, keep=["doc_id", "lang", "source"]), "quality-stats")
    judged = quality.judge(stats, quality.fit(stats))
    return judged.select("doc_id", *[f"quality.{c}" for c in quality.COUNTS[:5]], "base_failed", "kept", "distance")


@register
def op10_lm_scoring(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", knlm.held_out().alias("held_out"))
    return knlm.scored(docs, knlm.fit(docs.filter(~F.col("held_out"))), keep=["doc_id", "held_out"])
