"""From raw documents to token files: rules, near-duplicates, decontamination, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``docs``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, minhash, mixing, rules, tokens
from millrace.llm.model_queries import tokenizer_path
from millrace.llm.store import kept, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the second policy of the quality rules."""
    return rules.keep(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated ones are rows of their own."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    sized = packed.select("row", F.col("row.doc_id").alias("id"), F.col("row.source").alias("source"), mixing.n_words(F.col("row.text")).alias("size"))
    mixed = mixing.mix(sized).filter("reps > 0")
    return mixed.select(F.explode(F.sequence(F.lit(1), F.col("reps"))).alias("rep"), "row").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    small_batches(spark)
    manifest, ranks = tokens.encode(spark, docs, tokenizer_path())
    return tokens.read(manifest, ranks)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token ids", token_ids),
]

#: Near-duplicates and token ids are no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
