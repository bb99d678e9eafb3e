"""Personal data, threats, retention, consent, noise and per-participant statistics."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans.ranged import quantiles
from .measures import text_columns
from ..plans.keys import join_by_key
from .ordering import trailing_seconds


def pii_counts(text: str | Column) -> list[Column]:
    """Matches per kind of personal data."""
    x = F.col(text) if isinstance(text, str) else text
    return [F.regexp_count(x, F.lit(p)).alias(n) for n, p in P.PII.items()]


def pii_matches(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per match: kind and matched text, over whole texts."""
    found = F.array(*[
        F.struct(F.lit(n).alias("pii_type"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("found"))
        for n, p in P.PII.items()])
    rows = df.select(*key, F.explode(found).alias("m"))
    return rows.select(*key, "m.pii_type", F.explode("m.found").alias("match"))


def redact(text: str | Column) -> Column:
    """The four replacements in their order."""
    x = F.col(text) if isinstance(text, str) else text
    for n, p in P.PII.items():
        x = F.regexp_replace(x, p, P.PII_MARKS[n])
    return x


def leaks(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Matches per kind of secret or identifier.

    A pattern runs only over texts that hold the words it cannot match without.
    """
    rows = df.select(*key, F.col(text).alias("_text"), F.lower(F.col(text)).alias("_low"))
    counts = []
    for name, pattern in P.LEAKS.items():
        n = F.regexp_count(F.col("_text"), F.lit("(?i)" + pattern))
        word = P.LEAK_WORDS.get(name)
        counts.append(F.struct(F.lit(name).alias("kind"), (
            F.when(F.contains(F.col("_low"), F.lit(word)), n).otherwise(0) if word else n).alias("n")))
    found = F.explode(F.filter(F.array(*counts), lambda r: r["n"] > 0)).alias("m")
    return rows.select(*key, found).select(*key, "m.kind", "m.n")


def threats(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Threat patterns found: pattern number, type, severity, matches."""
    rows = [
        F.struct(F.lit(i).alias("pattern_id"), F.lit(kind).alias("threat_type"), F.lit(level).alias("severity"),
                 F.regexp_count(F.col(text), F.lit(p)).alias("n"))
        for i, (kind, level, p) in enumerate(P.THREATS)]
    found = F.explode(F.filter(F.array(*rows), lambda r: r["n"] > 0)).alias("m")
    return df.select(*key, found).select(*key, "m.*")


def injections(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """How many patterns of each class occur in the text."""
    rows = []
    for kind, patterns in P.INJECTIONS.items():
        hits = sum((F.when(F.col(text).rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
        rows.append(F.struct(F.lit(kind).alias("kind"), hits.alias("n")))
    return df.select(*key, F.explode(F.filter(F.array(*rows), lambda r: r["n"] > 0)).alias("m")).select(*key, "m.kind", "m.n")


def classify(df: DataFrame, hint: str | None = None) -> Column:
    """phi, pci or pii by words in the row (names and values), else the hint, else internal."""
    text = F.lower(F.to_json(F.struct(*df.columns)))
    chain = None
    for name, words in P.CLASS_WORDS.items():
        test = F.lit(False)
        for w in words:
            test = test | F.contains(text, F.lit(w))
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    if hint:
        known = [c for c, _, _ in P.RETENTION]
        chain = chain.when(F.lower(F.col(hint)).isin(known), F.lower(F.col(hint)))
    return chain.otherwise("internal")


def _short_hash(x: Column) -> Column:
    return F.concat(F.lit("anon_"), F.substring(F.sha2(x, 256), 1, 12))


def anonymize(df: DataFrame) -> DataFrame:
    """Named fields become a short hash; other texts that look like mail become a made-up address."""
    texts = set(text_columns(df))
    out = []
    for c in df.columns:
        x = F.col(c)
        if c in texts:
            if c in P.ANONYMIZED_FIELDS:
                x = _short_hash(x)
            mail = F.contains(x, F.lit("@")) & F.contains(x, F.lit("."))
            x = F.when(mail, F.concat(_short_hash(x), F.lit("@example.com"))).otherwise(x)
        elif c in P.ANONYMIZED_FIELDS:
            x = F.when(x.isNotNull(), F.lit("[ANONYMIZED]"))
        out.append(x.alias(c))
    return df.select(*out)


def retention(df: DataFrame, data_class: str, created: str, now: Column) -> DataFrame:
    """Whether each row is past the period of its class and may delete itself.

    The policy table is the seven fixed classes, hence the broadcast.
    """
    policy = df.sparkSession.createDataFrame(P.RETENTION, "_class string, retention_days int, auto_delete boolean")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(created).cast("timestamp"))
    joined = df.join(F.broadcast(policy), df[data_class] == policy["_class"], "left")
    expired = F.col("auto_delete") & (age > F.col("retention_days").cast("long") * 86_400_000_000)
    return joined.select(*[df[c] for c in df.columns], "retention_days", F.coalesce(expired, F.lit(False)).alias("expired"))


def consent_valid(consents: DataFrame, user: str, purpose: str, granted: Column, expires: str, now: Column) -> DataFrame:
    """Per user and purpose: any granted consent that has not run out."""
    alive = granted & (F.col(expires).isNull() | (F.col(expires) > now))
    return consents.groupBy(user, purpose).agg(F.bool_or(F.coalesce(alive, F.lit(False))).alias("valid"))


def expired_consents(consents: DataFrame, granted: Column, expires: str, now: Column) -> DataFrame:
    return consents.filter(granted & (F.col(expires) <= now))


def hash_field(c: str, salt: str) -> Column:
    """Salted sha256 (not a password hash)."""
    return F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256)


def encrypt_fields(df: DataFrame, fields: list[str], key: Column) -> DataFrame:
    """AES-GCM with the caller's key, as base64 text."""
    return df.withColumns({f: F.base64(F.aes_encrypt(F.col(f).cast("string"), key)) for f in fields})


def decrypt_fields(df: DataFrame, fields: list[str], key: Column) -> DataFrame:
    return df.withColumns({f: F.aes_decrypt(F.unbase64(F.col(f)), key).cast("string") for f in fields})


def rate_flags(df: DataFrame, user: str, ts: str, row_id: str, limit: int, seconds: float = 60.0) -> DataFrame:
    """Requests beyond ``limit`` in their trailing window (all requests count)."""
    ones = df.select(user, ts, row_id, F.lit(1.0).alias("_one"))
    out = trailing_seconds(ones, [user], ts, row_id, "_one", seconds)
    return out.select(user, row_id, F.col("trail_n").alias("requests"), (F.col("trail_n") > limit).alias("limited"))


def threat_report(events: DataFrame, columns: list[str], source: str, k: int = 10) -> DataFrame:
    """Counts by each column, and the busiest sources."""
    from .aggregate import breakdown, top_k

    by = breakdown(events, columns)
    top = top_k(events, source, k).select(F.lit("top_source").alias("dimension"), F.col(source).cast("string").alias("value"), "n")
    return by.unionByName(top)


def laplace(scale: Column | float, seed: int) -> Column:
    """Inverse-CDF Laplace noise of one uniform draw per result row."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    u = F.rand(seed) - 0.5
    return -s * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def dp_aggregates(df: DataFrame, value: str, epsilon: float, sensitivity: float = 1.0, seed: int = 0) -> DataFrame:
    """Noisy sum, mean and count; the noise is added to the one result row."""
    one = df.agg(F.sum(value).alias("s"), F.avg(value).alias("m"), F.count(value).alias("n"))
    b = sensitivity / epsilon
    return one.select(
        (F.col("s") + laplace(b, seed)).alias("dp_sum"),
        (F.col("m") + laplace(F.lit(b) / F.greatest(F.col("n"), F.lit(1)), seed + 1)).alias("dp_mean"),
        F.greatest(F.lit(0.0), F.col("n") + laplace(1.0 / epsilon, seed + 2)).alias("dp_count"))


def dp_gaussian(x: Column, sensitivity: float, epsilon: float, delta: float, seed: int = 0) -> Column:
    sigma = sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon
    return x + F.randn(seed) * sigma


def exponential_pick(df: DataFrame, utility: str, k: int, epsilon: float, sensitivity: float = 1.0, seed: int = 0) -> DataFrame:
    """``k`` rows with probability ∝ exp(ε·u / 2s), without replacement, as a top-k of Gumbel keys."""
    gumbel = -F.log(-F.log(F.greatest(F.rand(seed), F.lit(1e-300))))
    key = F.col(utility) * (epsilon / (2 * sensitivity)) + gumbel
    return df.withColumn("_key", key).orderBy(F.col("_key").desc()).limit(k).drop("_key")


def group_normalization(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min of minima and max of maxima over the participants."""
    g = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), (F.max("hi") - F.min("lo")).alias("range"))


def group_standardization(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count-weighted mean of the participants' means and variances."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    n = F.sum("n")
    return g.agg(
        (F.sum(F.col("m") * F.col("n")) / n).alias("mean"),
        F.sqrt(F.greatest(F.sum(F.col("v") * F.col("n")) / n, F.lit(1e-8))).alias("std"), n.alias("count"))


def group_quantiles(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """Quantiles over the union of the participants."""
    return quantiles(df.select(F.col(value).cast("double").alias("_v")), [], "_v", points)


def group_correlation(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Size-weighted mean of the participants' correlations, between −1 and 1."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    r = F.sum(F.col("r") * F.col("n")) / F.sum(F.when(F.col("r").isNotNull(), F.col("n")))
    return g.agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("correlation"))


def mutual_information(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Mean over the participants of Σ p·ln(p / (px·py)), from joint counts.

    Marginals are sums of the joint counts, so the rows are read once and only
    distinct pairs are joined. A null is a value like any other.
    """
    joint = df.groupBy(group, a, b).agg(F.count("*").alias("n"))
    left = joint.groupBy(group, a).agg(F.sum("n").alias("na"))
    right = joint.groupBy(group, b).agg(F.sum("n").alias("nb"))
    total = joint.groupBy(group).agg(F.sum("n").alias("t"))
    rows = join_by_key(join_by_key(join_by_key(joint, left, [group, a]), right, [group, b]), total, group)
    p = F.col("n") / F.col("t")
    term = p * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    return rows.groupBy(group).agg(F.sum(term).alias("mi")).agg(F.avg("mi").alias("mutual_information"))


def participant_anomalies(df: DataFrame, group: str, metric: str, value: str, threshold: float) -> DataFrame:
    """Participants whose mean is far out: |v − mean| over the scaled mean deviation."""
    means = df.groupBy(metric, group).agg(F.avg(value).alias("v"))
    center = means.groupBy(metric).agg(F.avg("v").alias("m"), F.count("*").alias("k"))
    off = join_by_key(means, center.filter("k >= 2"), metric)
    spread = off.groupBy(metric).agg((F.avg(F.abs(F.col("v") - F.col("m"))) * math.sqrt(math.pi / 2)).alias("s"))
    z = F.abs(F.col("v") - F.col("m")) / F.greatest(F.col("s"), F.lit(1e-8))
    return join_by_key(off, spread, metric).filter(z > threshold).select(metric, group, F.col("v").alias("value"), z.alias("z_score"))


_KEYS = "|".join(P.SENSITIVE_KEYS)
_PAIRS = "(?i)" + "|".join(P.SENSITIVE_PAIRS)


def redact_json(text: str | Column) -> Column:
    """Values under sensitive keys, and strings holding a sensitive pair, at any depth of a JSON text."""
    pair = re.compile(_PAIRS)

    def clean(value):
        if isinstance(value, dict):
            return {k: "[REDACTED]" if k.lower().endswith(tuple(P.SENSITIVE_KEYS)) else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, str) and pair.search(value):
            return "[REDACTED - SENSITIVE DATA DETECTED]"
        return value

    def one(doc):
        return None if doc is None else json.dumps(clean(json.loads(doc)), ensure_ascii=False, separators=(",", ":"))

    @F.pandas_udf("string")
    def cleaned(docs: pd.Series) -> pd.Series:
        return docs.map(one)

    return cleaned(F.col(text) if isinstance(text, str) else text)


def redact_map(c: str) -> Column:
    """The same over a map of texts."""
    def value(k: Column, v: Column) -> Column:
        sensitive = F.lower(k).rlike(f"({_KEYS})$")
        return F.when(sensitive, F.lit("[REDACTED]")).when(
            v.rlike(_PAIRS), F.lit("[REDACTED - SENSITIVE DATA DETECTED]")).otherwise(v)

    return F.transform_values(F.col(c), value)


