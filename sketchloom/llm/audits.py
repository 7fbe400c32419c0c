"""The audit operators as registered queries over the whole documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sketchloom.llm import collocations, divergence, licenses

QUERIES, SQL = {}, {}


def register(query):
    QUERIES[query.__name__] = query
    return query


@register
def op11_source_divergence(spark, folder):
    return divergence.audit(spark.read.parquet(f"{folder}/documents.parquet"), min_docs=10, ranks=10)


@register
def op12_phrase_collocations(spark, folder):
    return collocations.mined(spark.read.parquet(f"{folder}/documents.parquet"), min_count=100, longest=5, most=2000)


@register
def op13_license_scan(spark, folder):
    found = licenses.scan(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"])
    labels = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", *labels, "score")


ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL["op11_source_divergence"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v) AS p,
    1 + (1000000000 * (k.total + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""

SQL["op12_phrase_collocations"] = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {ABC}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM w, unnest(range(1, len(w) + 1)) u(i), unnest(range(1, 6)) x(m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
k AS (
  SELECT c.lang, c.phrase, c.m, c.f AS a, k, l.f AS l, r.f AS r, (1000 * c.f * n.n) // (l.f * r.f) AS score
  FROM c JOIN n USING (lang), unnest(range(1, m)) u(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[i:i + j - 1], ' ') AS phrase, c.f AS longer
  FROM c, unnest(range(2, c.m)) u(j), unnest(range(1, c.m - j + 2)) x(i))
SELECT b.lang, (row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase))::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
  n.n::BIGINT AS n, score::BIGINT AS score
FROM b JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.lang = b.lang AND z.phrase = b.phrase AND 100 * z.longer >= 100 * b.a) QUALIFY rank <= 2000
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NOTICES = ", ".join(
    f"({t.number}, {quoted(t.label)}, {t.step}, {t.least}, [{', '.join(map(quoted, sorted(t.words)))}])" for t in licenses.templates_of(licenses.TEMPLATES, 0.9)
)
PHRASES = ", ".join(f"({quoted(p)}, {len(p.split(' '))}, {quoted(label)})" for p, label in licenses.PHRASES)

SQL["op13_license_scan"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, label, step, least, words) AS (VALUES {NOTICES}),
p(phrase, many, label) AS (VALUES {PHRASES}),
h AS (SELECT doc, i - 1 AS place, p.label FROM d, unnest(range(1, len(w) + 1)) u(i) JOIN p ON array_to_string(w[i:i + p.many - 1], ' ') = p.phrase),
b AS (
  SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc),
x AS (
  SELECT doc, s.step, list_distinct(w[k * s.step + 1:(k + 2) * s.step]) AS own
  FROM d, (SELECT DISTINCT step FROM t) s, unnest(range(0, greatest(ceil(len(w) / s.step)::BIGINT - 1, 1))) u(k) WHERE len(w) > 0),
m AS (
  SELECT doc, t.label, len(list_intersect(x.own, t.words)) / len(t.words) AS share FROM x JOIN t ON t.step = x.step AND len(list_intersect(x.own, t.words)) >= t.least),
l AS (SELECT doc, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc, label FROM m UNION ALL SELECT doc, label FROM h) GROUP BY doc),
s AS (SELECT doc, max(share) AS best FROM m GROUP BY doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc) LEFT JOIN l USING (doc) LEFT JOIN s USING (doc)
"""
