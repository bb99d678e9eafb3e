"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` takes every measurement and evaluates every rule once; a row keeps
the measurements and one bit per failed rule. Policies are named, versioned sets
of rules, so a new policy or an ablation reads the ledger and never the texts.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Null texts count as empty. Repeated
rows and ties are rows like any other; an empty table gives an empty ledger.
Columns of the input never clash: the ledger holds ids and its own columns, and
``keep`` carries the whole input row in a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Name and failure condition of each rule, by bit. Only ever append: stored
#: ledgers keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > word_chars"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("shouting", "2 * n_shout_words > n_words"),
]
#: Rules by policy version. ``base`` is the part every later version contains.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "repeated_lines"],
    "v2": ["few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words"]


def mask(policy: str | Sequence[str]) -> int:
    """The bits of a policy version, or of a list of rule names."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(df: DataFrame, ids: Sequence[str], text: str = "text") -> DataFrame:
    """Per row: ``ids``, the measurements and ``fail_bits`` (bit k: rule k failed)."""
    base = df.select(*[F.col(i) for i in ids], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return _rate(_measure(base)).select(*ids, *MEASURES, "fail_bits")


def _measure(df: DataFrame) -> DataFrame:
    """Adds the measurements of ``_t``."""
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = df.withColumns({
        "_w": F.filter(F.split("_t", SPACE, -1), lambda x: x != ""),
        "_l": lines,
    })
    hashed = split.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    windows = F.when(F.size("_h") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])))
    seen = hashed.withColumn("_g", windows)
    # Equal windows have equal 64-bit hashes. Only texts in which a hash repeats sort
    # (hash, position) pairs: a window repeats if a neighbour has its hash.
    pairs = F.array_sort(F.transform("_g", lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
    again = seen.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs))
    places = F.array_sort(F.transform(
        F.filter("_s", lambda x, i: ((i > 0) & (F.get("_s", i - 1)["g"] == x["g"])) | F.coalesce(F.get("_s", i + 1)["g"] == x["g"], F.lit(False))),
        lambda x: x["p"]))
    placed = again.withColumn("_p", places)
    # By position, each repeated window covers the words that those before it do not.
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get("_p", i - 1)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    joined = F.array_join("_w", "")
    measures = {
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(joined).cast("long"),
        "n_symbols": (F.length(joined) - F.length(F.translate(joined, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_shout_words": F.size(F.filter("_w", lambda x: x.rlike(r"^\p{Lu}[\p{Lu}\p{Punct}]*!!"))).cast("long"),
    }
    # One struct, taken out again: a later filter on a measurement stays above this step
    # instead of being rewritten into the texts' expressions, each many times over.
    one = F.explode(F.array(F.struct(*[m.alias(n) for n, m in measures.items()]))).alias("_m")
    return placed.select(*[c for c in df.columns if c != "_t"], one).select(*[c for c in df.columns if c != "_t"], "_m.*")


def _rate(df: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return df.withColumn("fail_bits", bits)


def passes(policy: str | Sequence[str], bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def keep(df: DataFrame, policy: str = "v2", text: str = "text") -> DataFrame:
    """The rows, all columns unchanged, that pass the policy."""
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))
    rated = _rate(_measure(packed.withColumn("_t", F.coalesce(F.col("_row")[text], F.lit("")))))
    return rated.filter(passes(policy)).select("_row.*")


def ablations(led: DataFrame, policies: Sequence[str] = tuple(POLICIES)) -> DataFrame:
    """What each rule does in each policy, from the ledger's bits alone.

    Columns: policy, rule, n_rows, n_failed (the rule failed), n_only (the rule
    alone rejects the row: kept if it were left out), n_kept (by the policy).
    Rows are first counted by bit pattern, so at most 2^rules rows are shuffled
    per task. An empty ledger gives no rows.
    """
    by_bits = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = [n for n, _ in RULES]
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).cast("long").alias("m"),
                      F.lit(1 << names.index(r)).cast("long").alias("b")) for p in policies for r in POLICIES[p]]
    each = by_bits.withColumn("c", F.explode(F.array(*cases)))
    hit = F.col("fail_bits").bitwiseAND(F.col("c.m"))
    return each.groupBy("c.policy", "c.rule").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("c.b")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("c.b"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"))
