"""Registered queries on DataFrame functions alone: quality rules and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, rules
from .registry import query

RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS gram
      FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}[\p{Lu}[:punct:]]*!!'))) AS n_shout_words
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 40 * n_words THEN 32 ELSE 0 END)
      + (CASE WHEN 2 * n_shout_words > n_words THEN 64 ELSE 0 END) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_shout_words AS BIGINT) AS n_shout_words, CAST(fail_bits AS BIGINT) AS fail_bits,
       fail_bits % 4 <> 0 AS base_failed, fail_bits = 0 AS kept
FROM f
"""


@query("op5_quality_rules", RULES_SQL)
def op5_quality_rules(t) -> DataFrame:
    """The ledger of all documents with the verdicts of the base policy and of v2."""
    led = rules.ledger(t.documents, ["doc_id"])
    return led.withColumns({"base_failed": ~rules.passes("base"), "kept": rules.passes("v2")})


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 3.0 * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
             (SELECT sum(source_size) FROM s) AS total FROM w),
l AS (SELECT max((total - held) / open_weight) AS level FROM o
      WHERE (total - held) / open_weight * weight <= cap
        AND NOT EXISTS (SELECT 1 FROM o p WHERE p.cap / p.weight < o.cap / o.weight AND (p.total - p.held) / p.open_weight * p.weight <= p.cap)),
g AS (SELECT source, source_size, least(CAST(weight * level AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM o, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
x AS (SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS extra,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT),
                      doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE size * least(3, whole + CASE WHEN ahead + size / 2.0 <= extra THEN 1 ELSE 0 END) END AS taken
FROM x
"""


@query("op7_mixing", MIX_SQL)
def op7_mixing(t) -> DataFrame:
    """Words the mix takes of every document."""
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))
