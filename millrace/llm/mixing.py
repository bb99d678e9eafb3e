"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources share all words by weight; a source whose share exceeds ``epochs`` times
its size is clamped there and what is over goes to the others by weight, until
none is above. A document is repeated ``floor(target / size of source)`` times;
the fraction left is filled by whole documents in a seeded random order until
the source's target is met, to within half a document.

Only one number per source and one per (source, order bin) is gathered, so a hot
source costs no more than others: the documents of one bin in ``BINS`` per source
are put in exact order, the rest are taken or left by their bin.

Sizes are words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have size 0 and
are never taken. A null source is a source of its own, last in order. Rows that
repeat are documents of their own; among rows that agree in id and size it does
not matter which is taken. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import kept

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BINS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != "")), F.lit(0)).cast("long")


def order_number(doc_id: Column, seed: int) -> Column:
    """52 seeded random bits of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table with one row per source (source, source_size).

    Weights go to the sources by code point, null last, repeating. Each round
    clamps the sources above their cap and shares the rest anew; a clamped source
    stays clamped, since the share of the others only grows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = kept(sizes.select(
        "source", F.col("source_size").cast("double").alias("size"),
        F.get(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight")), "mix-sources")
    level = 0.0
    total = rows.agg(F.sum("size")).head()[0] or 0.0
    while True:
        clamped = F.col("weight") * F.lit(level) > F.lit(float(epochs)) * F.col("size")
        held, open_weight = rows.agg(
            F.sum(F.when(clamped, F.lit(float(epochs)) * F.col("size")).otherwise(0.0)),
            F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).head()
        if not open_weight or (total - held) / open_weight <= level:
            break
        level = (total - held) / open_weight
    return rows.select(
        "source", F.col("size").cast("long").alias("source_size"),
        F.least(F.col("weight") * F.lit(level), F.lit(float(epochs)) * F.col("size")).alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """Adds to ``docs`` (id, source, size) the columns source_size, target and ``reps``,
    how often the mix takes the document."""
    rows = docs.withColumn("_u", order_number(F.col("id"), seed)).withColumn("_bin", F.shiftright("_u", 40))
    bins = kept(rows.groupBy("source", "_bin").agg(F.sum("size").alias("_part")), "mix-bins")
    plan = targets(bins.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, epochs)
    plan = plan.withColumns({
        "_whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    }).withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    ahead = bins.withColumn("_before", F.coalesce(F.sum("_part").over(before), F.lit(0)))
    # The bin in which a source meets its target; all before it are taken, none after it.
    cut = ahead.join(plan, ahead["source"].eqNullSafe(plan["source"])).filter(
        (F.col("_before") <= F.col("_extra")) & (F.col("_extra") < F.col("_before") + F.col("_part"))).select(
        ahead["source"].alias("_source"), F.col("_bin").alias("_cut"), "_before")
    state = kept(plan.join(cut, plan["source"].eqNullSafe(F.col("_source")), "left").select(
        plan["source"].alias("_source"), "source_size", "target", "_whole", "_extra", "_cut", "_before"), "mix-state")
    placed = rows.join(state, rows["source"].eqNullSafe(F.col("_source")), "left")
    at_cut = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    inside = W.partitionBy("source", "_bin").orderBy("_u", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    fine = placed.filter(at_cut).withColumn("_ahead", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    fine = fine.withColumn("_more", F.col("_ahead") + F.col("size") / 2 <= F.col("_extra")).drop("_ahead")
    rest = placed.filter(~at_cut).withColumn("_more", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False)))
    reps = F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + F.col("_more").cast("long"))
    return fine.unionByName(rest).withColumn("reps", F.least(reps, F.lit(int(epochs))).cast("long")).select(*docs.columns, "source_size", "target", "reps")
