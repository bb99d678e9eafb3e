"""Registered queries of the learned operators, token output and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compression, langid, tokens, toxicity, warc
from .registry import query
from .store import kept


def tokenizer_path() -> str:
    """The 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc(doc_id: str = "doc_id"):
    """crc32 of the id as text (null as empty)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def labelled(t, column: str, trains, max_rows: int, by_class: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded sample of the labels (doc_id, text, y), and all labels by class.

    ``trains`` says which ids may train. The sample is drawn from the labels alone, by
    a hash of the id: about ``max_rows`` of them, half of each class with
    ``by_class``. So it is small by its parameter, and broadcast to the documents. An
    id with several labels takes the least.
    """
    ids = t.labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).filter(trains)
    y = ids.groupBy("doc_id").agg(F.min(column).cast("int").alias("y"))
    seen = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20))
    share = {c: min(1.0, max_rows / 2 / n if by_class else max_rows / sum(seen.values())) for c, n in seen.items()}
    chosen = y.filter(spot < F.when(F.col("y") == 1, F.lit(int(share.get(1, 0) * (1 << 20)))).otherwise(F.lit(int(share.get(0, 0) * (1 << 20)))))
    few = kept(chosen, "labels")
    return kept(t.documents.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "labelled"), seen


@query("op2_token_ids")
def op2_token_ids(t) -> DataFrame:
    """Token counts, offsets and checksums of all documents, from the written files."""
    manifest, ranks = tokens.encode(t.spark, t.documents, tokenizer_path())
    return tokens.read(manifest, ranks)


@query("op3_toxicity")
def op3_toxicity(t) -> DataFrame:
    """Toxicity of all documents; rows with remainder 2 never train."""
    rows, _ = labelled(t, "toxic", crc() % 4 != 2, 20000)
    model = toxicity.train(rows, "doc_id", "text", "y")
    scored = toxicity.score(t.documents, model)
    return scored.select("doc_id", (crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_language")
def op8_language(t) -> DataFrame:
    """Language of all documents; rows with remainder 1 never train."""
    model = langid.train(t.documents.filter(crc() % 3 != 1), max_rows=5000, id_col="doc_id")
    found = langid.predict(t.documents, model)
    return found.select("doc_id", (crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


@query("op9_quality")
def op9_quality(t) -> DataFrame:
    """Quality of all documents; rows with remainder 0 never train."""
    rows, seen = labelled(t, "quality", crc() % 5 != 0, 6000, by_class=True)
    model = compression.train(rows, "doc_id", "text", "y", share=seen.get(1, 0) / max(1, sum(seen.values())))
    scored = compression.score(t.documents, model)
    return scored.select("doc_id", (crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query("op10_warc", WARC_SQL)
def op10_warc(t) -> DataFrame:
    """All pages written to archives and read back through the capture index."""
    return warc.read_back(warc.archive(t.spark, t.pages))
