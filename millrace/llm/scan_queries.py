"""Registered queries of resampling, secret scans and whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resample, secretscan, whitening
from .registry import query

RESAMPLE_SQL = r"""
WITH RECURSIVE
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS MATERIALIZED (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
                                   list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS f
                  FROM (SELECT r, ws FROM w UNION ALL SELECT -1, ws FROM q)),
d AS MATERIALIZED (SELECT f, hex(encode(f)) AS h, strlen(f) AS n FROM (SELECT DISTINCT f FROM g)),
bit AS (SELECT b, 0 AS k, CAST(b AS UBIGINT) AS v FROM range(256) t(b)
        UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
byte AS MATERIALIZED (SELECT b, v FROM bit WHERE k = 8),
most AS MATERIALIZED (SELECT max(n) AS n FROM d),
pos AS (SELECT 0 AS away, b, v FROM byte
        UNION ALL SELECT away + 1, p.b, xor(p.v >> 8, t.v) FROM pos p JOIN byte t ON t.b = p.v % 256 WHERE away < (SELECT n FROM most)),
zero AS (SELECT 0 AS n, CAST(4294967295 AS UBIGINT) AS v
         UNION ALL SELECT z.n + 1, xor(z.v >> 8, t.v) FROM zero z JOIN byte t ON t.b = z.v % 256 WHERE z.n < (SELECT n FROM most)),
each AS (SELECT f, n, n - 1 - i AS away, CAST('0x' || h[2 * i + 1: 2 * i + 2] AS BIGINT) AS b FROM (SELECT f, n, h, unnest(range(n)) AS i FROM d)),
crc AS MATERIALIZED (SELECT f, xor(xor(bit_xor(pos.v), any_value(zero.v)), 4294967295) % 10000 AS bucket
                     FROM each JOIN pos USING (away, b) JOIN zero ON zero.n = each.n GROUP BY f),
placed AS MATERIALIZED (SELECT r, bucket, count(*) AS n FROM g JOIN crc USING (f) GROUP BY ALL),
side AS (SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) x(b)
         LEFT JOIN (SELECT bucket, sum(n) FILTER (r >= 0) AS s, sum(n) FILTER (r < 0) AS t FROM placed GROUP BY bucket) y ON x.b = y.bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000)
                                           / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM side),
own AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM placed JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS noise
           FROM w LEFT JOIN own USING (r)),
rated AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, n_features, weight) AS BIGINT) AS k,
                 count(*) OVER (PARTITION BY n_words >= 20) AS eligible FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_words >= 20 AND k <= 5 * eligible // 100 THEN k END AS rank
FROM rated
"""


@query("op11_resampling", RESAMPLE_SQL)
def op11_resampling(t) -> DataFrame:
    """Importance weights of all documents against the benchmark's texts, and the draw of five in a hundred."""
    return resample.resample(t.documents, t.benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def vocabulary() -> tuple[str, str]:
    """File and pattern of the 50k tiktoken vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op12_secrets")
def op12_secrets(t) -> DataFrame:
    """Secrets in all documents: counts and digest of the fixed patterns, and all spans."""
    found = secretscan.scan(t.documents, *vocabulary())
    spans = F.col("spans")

    def n(kind: str):
        return F.size(secretscan.of_kind(spans, kind)).cast("long")

    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secretscan.joined(secretscan.of_kind(spans, *secretscan.BASE)), 256).alias("base_sha256"),
        secretscan.joined(spans).alias("spans"), n("random").alias("n_random"))


@query("op13_whitening")
def op13_whitening(t) -> DataFrame:
    """All embeddings on the four leading components of their distinct vectors, to unit variance."""
    return whitening.whitened(t.embeddings)
