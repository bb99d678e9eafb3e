"""Ordered work that holds when one key owns a third of all rows.

A window over ``partitionBy(key)`` sends a whole key to one task. The helpers
here sort by ``(key, order)`` across range partitions instead, work inside each
partition and carry a small per-partition total forward, so the largest task is
one range partition whatever the key sizes are.

``order`` must make rows distinct within a key (add an id column): equal rows
cannot be split over range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import settle
from .keys import join_by_key

Cols = Sequence[str]
SLICES = 32
#: Rows of a time block that one task takes.
DENSE = 200_000
#: Rows of a block of a recurrence.
BLOCK = 256
#: Ranks at which a sketch is read, and its accuracy.
GRID, ACCURACY = 500, 10_000
#: Values of a key that a bracket may hold for the last step.
INSIDE = 100_000
#: Keys whose brackets are broadcast: a row of some hundred bytes each.
MANY_KEYS = 50_000


def ranged(df: DataFrame, keys: Cols, order: Cols, inside: bool = False) -> DataFrame:
    """Rows in range partitions by ``(keys, order)``, numbered in ``_part``; sorted
    within each partition when ``inside`` is set.

    ``_key`` is the key as a struct, so that a null key is an ordinary group in
    joins. The result is checkpointed: boundaries come from a sample and must be
    the same for every later branch.
    """
    spread = df.repartitionByRange(*keys, *order)
    if inside:
        spread = spread.sortWithinPartitions(*keys, *order)
    kept = settle(spread.withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return kept.withColumn("_key", key)


def running(
    df: DataFrame,
    keys: Cols,
    order: Cols,
    sums: Mapping[str, Column],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums per key, and optionally whole-key totals.

    ``sums`` maps an output name to the summed expression; ``totals`` maps an
    output name to one of the names in ``sums``.
    """
    totals = totals or {}
    rows = ranged(df, keys, order)
    # Part i goes to task i: hashing the few part numbers would pile some up.
    placed = rows.repartitionById(max(1, rows.rdd.getNumPartitions()), "_part")
    group = W.partitionBy("_part", *keys)
    inside = group.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = placed.select(
        "*",
        *[F.sum(e).over(inside).alias(f"_run_{n}") for n, e in sums.items()],
        *[F.sum(sums[n]).over(group).alias(f"_own_{t}") for t, n in totals.items()],
    )
    # Only the first and last key of a part can go on in another part, so what is
    # carried over is at most two rows per range partition, and broadcast as such.
    ends = rows.groupBy("_part").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    edge = rows.join(F.broadcast(ends), "_part").filter((F.col("_key") == F.col("_lo")) | (F.col("_key") == F.col("_hi")))
    parts = edge.groupBy("_part", "_key").agg(*[F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()])
    whole = W.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(
        "_part",
        "_key",
        F.count("*").over(whole).alias("_spans"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_pre_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"_all_{t}") for t, n in totals.items()],
    ).filter("_spans > 1")
    out = local.join(F.broadcast(carry), ["_part", "_key"], "left")
    done = [
        F.when(F.col(f"_pre_{n}").isNull(), F.col(f"_run_{n}"))
        .when(F.col(f"_run_{n}").isNull(), F.col(f"_pre_{n}"))
        .otherwise(F.col(f"_run_{n}") + F.col(f"_pre_{n}"))
        .alias(n)
        for n in sums
    ]
    whole_key = [F.coalesce(f"_all_{t}", f"_own_{t}").alias(t) for t in totals]
    return out.select(*[F.col(c) for c in df.columns], *done, *whole_key)


def row_index(
    df: DataFrame, keys: Cols, order: Cols, name: str = "idx", total: str | None = None
) -> DataFrame:
    """1-based position of each row within its key (``total``: rows of the key)."""
    return running(df, keys, order, {name: F.lit(1).cast("long")}, {total: name} if total else None)


def first_rows(df: DataFrame, keys: Cols, order: Cols, n: int, name: str = "rn", newest: bool = False) -> DataFrame:
    """The first ``n`` rows per key by ``order`` (the last ones with ``newest``), numbered from 1.

    Ranked twice: within ``SLICES`` slices of each key, then among the rows that
    are left, so the last step sees at most ``SLICES * n`` rows of a key,
    however many tasks hold it.
    """
    by = [F.col(c).desc() for c in order] if newest else list(order)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(SLICES)))
    few = sliced.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(*by))).filter(F.col(name) <= n)
    ranked = few.drop("_slice", name).withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*by)))
    return ranked.filter(F.col(name) <= n)


def blocks(
    df: DataFrame,
    keys: Cols,
    order: Cols,
    before: int = 0,
    after: int = 0,
    rows: int = 100_000,
    name: str = "idx",
    total: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Cut each key into blocks of ``rows`` rows (more if a halo is longer) with a halo on either side.

    Returns the rows and the columns to partition a window by. Rows copied from
    a neighbouring block have ``_halo`` set; drop them after the window. A
    window of up to ``before`` rows back and ``after`` rows ahead is then exact.
    """
    rows = max(rows, before, after)  # a halo never reaches past the next block
    indexed = row_index(df, keys, order, name, total)
    at = F.col(name) - 1
    block = F.floor(at / rows).cast("long")
    offset = at % rows
    copies = [F.struct(block.alias("b"), F.lit(False).alias("h"))]
    if before:
        copies.append(F.when(offset >= rows - before, F.struct((block + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        copies.append(
            F.when((offset < after) & (block > 0), F.struct((block - 1).alias("b"), F.lit(True).alias("h")))
        )
    spread = (
        indexed.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
        .withColumn("_block", F.col("_copy.b"))
        .withColumn("_halo", F.col("_copy.h"))
        .drop("_copy")
    )
    return spread, [*keys, "_block"]


def windowed_rows(
    df: DataFrame,
    keys: Cols,
    order: Cols,
    exprs,
    before: int = 0,
    after: int = 0,
    rows: int = 100_000,
    total: str | None = None,
) -> DataFrame:
    """Add columns from ``exprs(window)`` where ``window`` reaches ``before``
    rows back and ``after`` rows ahead; adds ``idx`` as well."""
    spread, part = blocks(df, keys, order, before, after, rows, total=total)
    window = W.partitionBy(*part).orderBy("idx")
    made = spread.select("*", *[c.alias(n) for n, c in exprs(window).items()])
    return made.filter(~F.col("_halo")).drop("_halo", "_block")


def value_counts(df: DataFrame, keys: Cols, value: str, weight: str | None = None) -> DataFrame:
    """Rows per (key, value), nulls left out; combined map-side. ``weight`` holds
    counts made earlier."""
    n = F.sum(weight) if weight else F.count("*")
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def ranked_values(df: DataFrame, keys: Cols, value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with ``n``, the count up to and including them ``upto``
    and the key's ``total``: the base of exact quantiles and average ranks."""
    return running(value_counts(df, keys, value, weight), keys, [value], {"upto": F.col("n")}, {"total": "upto"})


def _ranks(points: Mapping[str, float], method: str, n: Column) -> dict[str, tuple[Column, Column]]:
    """Lowest and highest wanted rank (from 0) of each point among ``n`` values."""
    out = {}
    for name, p in points.items():
        if method == "index":
            low = F.least(F.floor(n * F.lit(float(p)) + F.lit(1e-9)), n - 1)
            out[name] = (low, low)
        else:
            spot = (n - 1) * F.lit(float(p))
            low = F.floor(spot + F.lit(1e-9))
            out[name] = (low, F.ceil(spot - F.lit(1e-9)) if method == "linear" else low)
    return out


def _bounded(table: DataFrame) -> DataFrame:
    """``table`` as a local frame to broadcast if it has at most ``MANY_KEYS`` rows."""
    few = table.limit(MANY_KEYS + 1).toArrow()
    if few.num_rows > MANY_KEYS:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(few, table.schema))


def _beside(rows: DataFrame, table: DataFrame, keys: Cols) -> DataFrame:
    """``rows`` with the columns of their key's row in ``table``."""
    if keys:
        return join_by_key(rows, table, keys)
    one = table.select(F.struct(*table.columns).alias("b")).scalar()
    return rows.select("*", *[one[c].alias(c) for c in table.columns])


def _brackets(rows: DataFrame, keys: Cols, points: Mapping[str, float], method: str) -> DataFrame:
    """Per key ``_lo<i>``, ``_hi<i>``: values between which the ranks of point i lie.

    A sketch of each key's values, read at ``GRID`` ranks, gives them; the neighbours one
    step farther out are taken, which is twenty times its error. At most five steps' share of
    the values lies strictly between them; while that may be more than ``INSIDE`` values,
    these are sketched again.
    """
    steps = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    inf = float("inf")

    def cell(grid: Column, rank: Column, n: Column, out: int, far: float) -> Column:
        at = (F.floor(F.try_divide(rank, n) * GRID) - 1 if out < 0 else F.ceil(F.try_divide(rank + 1, n) * GRID) + 1).cast("int")
        return F.when((at < 0) | (at > GRID), F.lit(far)).otherwise(F.get(grid, at))

    n = F.count(F.lit(1))
    sketch = rows.groupBy(*keys).agg(n.alias("_n"), F.percentile_approx("_spot", steps, ACCURACY).alias("_grid"))
    names = list(points)
    made = sketch.select(*keys, "_n", *[
        c for i, (low, high) in enumerate(_ranks(points, method, F.col("_n")).values())
        for c in (cell(F.col("_grid"), low, F.col("_n"), -1, -inf).alias(f"_lo{i}"), cell(F.col("_grid"), high, F.col("_n"), 1, inf).alias(f"_hi{i}"))])
    width = F.col("_n") * 5 / GRID
    table = _bounded(made.select("*", *[F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), 0).otherwise(width).alias(f"_w{i}") for i in range(len(names))]))

    def widest() -> float:
        each = [F.max(f"_w{i}") for i in range(len(names))]
        return table.agg((F.greatest(*each) if len(each) > 1 else each[0]).alias("w")).head()["w"] or 0

    while widest() > INSIDE:
        beside, spot = _beside(rows, table, keys), F.col("_spot")
        aggs = [F.first("_n").alias("_n")]
        for i in range(len(names)):
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            between = (spot > lo) & (spot < hi)
            aggs += [F.first(lo).alias(f"_lo{i}"), F.first(hi).alias(f"_hi{i}"), F.count_if(spot <= lo).alias(f"_upto{i}"),
                     F.count_if(between).alias(f"_in{i}"), F.percentile_approx(F.when(between, spot), steps, ACCURACY).alias(f"_grid{i}")]
        cols = []
        for i, (low, high) in enumerate(_ranks(points, method, F.col("_n")).values()):
            lo, hi, upto, inside, grid = (F.col(f"_{c}{i}") for c in ("lo", "hi", "upto", "in", "grid"))
            # A rank may be that of an end itself, whatever the number of equal values there.
            new_lo = F.when(low < upto, lo).when(low >= upto + inside, hi).otherwise(F.greatest(lo, cell(grid, low - upto, inside, -1, -inf)))
            new_hi = F.when(high < upto, lo).when(high >= upto + inside, hi).otherwise(F.least(hi, cell(grid, high - upto, inside, 1, inf)))
            cols += [new_lo.alias(f"_lo{i}"), new_hi.alias(f"_hi{i}"), F.when(new_lo == new_hi, 0).otherwise(inside * 5 / GRID).alias(f"_w{i}")]
        table = _bounded(beside.groupBy(*keys).agg(*aggs).select(*keys, "_n", *cols))
    return table


def quantiles(
    df: DataFrame,
    keys: Cols,
    value: str,
    points: Mapping[str, float],
    method: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per key, one column per entry of ``points`` (0..1); nulls are left out.

    linear   interpolates at p·(n−1); lower takes the element at int(p·(n−1));
    index    takes the element at int(p·n), the last one at most.

    A first pass brackets the wanted ranks by a sketch per key. A second one counts what
    lies between the brackets and keeps, as distinct values with counts, only what lies
    inside; the ranks are picked from that. Values are compared as doubles for the
    brackets alone. The sketch decides nothing but the size of the second
    step: a rank outside its bracket ends the job. With up to ``MANY_KEYS`` keys the
    brackets are broadcast, so no value is shuffled but those inside. ``weight`` holds
    counts made earlier; such values are ranked over range partitions.
    """
    if weight:
        return _weighted_quantiles(df, keys, value, points, method, weight)
    rows = df.select(*keys, value).filter(F.col(value).isNotNull()).withColumn("_spot", F.col(value).cast("double"))
    table = _brackets(rows, keys, points, method)
    beside = _beside(rows, table, keys)
    spot, inside, edge = F.col("_spot"), F.lit(False), F.lit(float("-inf"))
    for i in range(len(points)):
        inside = inside | spot.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        edge = F.when((F.col(f"_hi{i}") < spot) & (F.col(f"_hi{i}") > edge), F.col(f"_hi{i}")).otherwise(edge)
    # Values between two brackets become one row that follows the lower bracket.
    placed = beside.select(*keys, F.when(inside, spot).otherwise(edge).alias("_at"), (~inside).alias("_out"), F.when(inside, F.col(value)).alias("_v"))
    counts = placed.groupBy(*keys, "_at", "_out", "_v").agg(F.count("*").alias("_n"))
    line = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_total"), F.array_sort(F.collect_list(F.struct("_at", "_out", "_v", "_n"))).alias("_line"))
    ranks = _ranks(points, method, F.col("_total"))
    ranked = line.select(*keys, "_total", "_line", *[c for i, r in enumerate(ranks.values()) for c in (r[0].alias(f"_r{i}"), r[1].alias(f"_s{i}"))])
    kind = df.schema[value].dataType.simpleString()
    wanted = [f"_{x}{i}" for i in range(len(points)) for x in "rs"]
    start = F.struct(F.lit(0).cast("long").alias("seen"), *[F.lit(None).cast(kind).alias(w) for w in wanted])

    def step(acc: Column, x: Column) -> Column:
        upto = acc["seen"] + x["_n"]
        return F.struct(upto.alias("seen"), *[
            F.when((acc["seen"] <= F.col(w)) & (F.col(w) < upto), x["_v"]).otherwise(acc[w]).alias(w) for w in wanted])

    picked = ranked.select(*keys, "_total", F.aggregate("_line", start, step).alias("_p"))
    out = []
    for i, (name, p) in enumerate(points.items()):
        lo, hi = (F.when(F.col("_total").isNotNull(), F.coalesce(
            F.col("_p")[f"_{x}{i}"], F.raise_error(F.lit("a rank lies outside its bracket")).cast(kind))) for x in "rs")
        if method == "linear":
            at = (F.col("_total") - 1) * F.lit(float(p))
            # lo + (hi - lo) * share, where equal ends keep their own type
            out.append((lo + (hi - lo) * F.greatest(at - F.floor(at + F.lit(1e-9)), F.lit(0.0))).alias(name))
        else:
            out.append(lo.alias(name))
    return picked.select(*keys, *out)


def _weighted_quantiles(df: DataFrame, keys: Cols, value: str, points: Mapping[str, float], method: str, weight: str) -> DataFrame:
    """``quantiles`` of values with counts, picked by rank from running counts."""
    ranked = ranked_values(df, keys, value, weight)
    n = F.col("total")
    floor_of = F.col("upto") - F.col("n")
    ranks = _ranks(points, method, n)

    def holds(rank: Column) -> Column:
        return (floor_of <= rank) & (rank < F.col("upto"))

    wanted = F.lit(False)
    for low, high in ranks.values():
        wanted = wanted | holds(low) | holds(high)
    aggs = []
    for name, p in points.items():
        lo, hi = (F.max(F.when(holds(r), F.col(value))) for r in ranks[name])
        spot = (F.max("total") - 1) * F.lit(float(p))
        share = F.greatest(spot - F.floor(spot + F.lit(1e-9)), F.lit(0.0))
        aggs.append((lo + (hi - lo) * share if method == "linear" else lo).alias(name))
    return ranked.filter(wanted).groupBy(*keys).agg(*aggs)


def trailing_sums(
    df: DataFrame,
    keys: Cols,
    ts: str,
    row_id: str,
    seconds: float,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Sums over the rows of the same key in ``[ts - seconds, ts]``, per row; nulls count as 0.

    Time is cut into blocks as long as the window, and each row goes to its own block
    and, ``seconds`` later, as halo to the next one. A row's window is the rows of its block up
    to its time and the halo from its time on: two running sums, one from either end. So
    nothing is subtracted, whatever the values' scale, and nothing is joined back.

    Where a block holds more than ``DENSE`` rows, blocks are cut into cells, and what the cells
    before and after hold is carried over. Rows of a key with one and the same time stay together.
    """
    span = int(seconds * 1_000_000)
    values = [F.coalesce(e.cast("double"), F.lit(0.0)).alias(n) for n, e in sums.items()]
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    base = df.select(key.alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"),
                     F.struct(*df.columns).alias("_row"), F.struct(*values).alias("_v"))
    if not span:
        same = W.partitionBy("_key", "_at")
        return base.select("_row.*", *[F.sum(F.col("_v")[n]).over(same).alias(n) for n in sums])
    block = F.floor(F.col("_at") / span).cast("long")
    most = base.groupBy("_key", block.alias("_block")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0
    cells = min(span, -(-most // DENSE))
    here = F.struct(block.alias("block"), F.col("_at").alias("at"), F.col("_row").alias("row"))
    later = F.struct((block + 1).alias("block"), (F.col("_at") + span).alias("at"), F.lit(None).cast(base.schema["_row"].dataType).alias("row"))
    spread = base.select("_key", "_v", F.explode(F.array(here, later)).alias("_x")).select(
        "_key", F.col("_x.block").alias("_block"), F.col("_x.at").alias("_at"), F.col("_x.row").alias("_row"), "_v")
    own = F.col("_row").isNotNull()
    part = ["_key", "_block"]
    if cells > 1:
        inside = F.col("_at") - F.col("_block") * span
        spread = spread.withColumn("_cell", F.floor(inside / -(-span // cells)).cast("long"))
        part.append("_cell")
    upto = W.partitionBy(*part).orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    since = W.partitionBy(*part).orderBy(F.col("_at").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = spread.select(
        *part, "_row",
        *[F.coalesce(F.sum(F.when(own, F.col("_v")[n])).over(upto), F.lit(0.0)).alias(f"_a_{n}") for n in sums],
        *[F.coalesce(F.sum(F.when(~own, F.col("_v")[n])).over(since), F.lit(0.0)).alias(f"_b_{n}") for n in sums]).filter(own)
    whole = {n: F.col(f"_a_{n}") + F.col(f"_b_{n}") for n in sums}
    if cells > 1:
        totals = spread.groupBy(*part).agg(
            *[F.sum(F.when(own, F.col("_v")[n])).alias(f"_a_{n}") for n in sums], *[F.sum(F.when(~own, F.col("_v")[n])).alias(f"_b_{n}") for n in sums])
        line = W.partitionBy("_key", "_block").orderBy("_cell")
        carried = totals.select(
            *part, *[(F.coalesce(F.sum(f"_a_{n}").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
                      + F.coalesce(F.sum(f"_b_{n}").over(line.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))).alias(f"_c_{n}") for n in sums])
        summed = summed.join(carried, part)
        whole = {n: x + F.col(f"_c_{n}") for n, x in whole.items()}
    return summed.select("_row.*", *[x.alias(n) for n, x in whole.items()])


def affine_scans(df: DataFrame, keys: Cols, order: Cols, states: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """``s = keep·s_before + add`` along each key; a key's first row takes ``first``.

    ``states`` maps an output name to its ``(keep, add, first)`` columns. Steps of this
    form compose: (k, a) after (k', a') is (k·k', k·a' + a). Rows are numbered per key and
    gathered in blocks of ``BLOCK`` rows. Each block is folded to one step; these steps are
    a shorter recurrence, solved in the same way, level by level, until one block holds a
    key. Then each block is replayed row by row from the state before it. A key may
    hold all rows: no task sees more of it at once than a block.
    """
    columns, names = list(df.columns), list(states)
    placed = row_index(df, keys, order, "_idx").withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all")))
    placed = settle(placed.withColumn("_at", F.col("_idx") - 1))
    steps = []
    for keep, add, first in states.values():
        begins = F.col("_at") == 0
        k, a = F.when(begins, 0.0).otherwise(F.col(keep).cast("double")), F.when(begins, F.col(first)).otherwise(F.col(add)).cast("double")
        steps.append(F.struct(k.alias("k"), a.alias("a")))
    longest = placed.agg(F.max("_idx").alias("n")).head()["n"] or 0
    rows = placed.select("_key", "_at", F.array(*steps).alias("_steps"), F.struct(*columns).alias("_row"))
    done = _states(rows, len(names), longest)
    return done.select("_row.*", *[F.col("_s")[i].alias(n) for i, n in enumerate(names)])


def _states(rows: DataFrame, width: int, longest: int) -> DataFrame:
    """Adds ``_s``, the states after each row's ``_steps`` (k, a), to rows numbered by ``_at`` from 0 along each ``_key``."""
    others = [c for c in rows.columns if c not in ("_key", "_steps")]
    line = F.collect_list(F.struct("_at", "_steps", *[c for c in others if c != "_at"]))
    by_place = F.array_sort(line, lambda x, y: (x["_at"] - y["_at"]).cast("int"))
    blocks = rows.groupBy("_key", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(by_place.alias("_line"))
    none = F.array_repeat(F.lit(0.0), width)
    if longest <= BLOCK:
        begun = blocks.withColumn("_start", none)
    else:
        unit = F.array_repeat(F.struct(F.lit(1.0).alias("k"), F.lit(0.0).alias("a")), width)
        whole = F.aggregate("_line", unit, lambda acc, x: F.zip_with(acc, x["_steps"], lambda u, v: F.struct(
            (u["k"] * v["k"]).alias("k"), (v["k"] * u["a"] + v["a"]).alias("a"))))
        ends = _states(blocks.select("_key", F.col("_block").alias("_at"), whole.alias("_steps")), width, -(-longest // BLOCK))
        before = ends.select("_key", (F.col("_at") + 1).alias("_block"), F.col("_s").alias("_before"))
        begun = blocks.join(before, ["_key", "_block"], "left").withColumn("_start", F.when(F.col("_block") == 0, none).otherwise(F.col("_before")))

    def step(acc: Column, x: Column) -> Column:
        now = F.zip_with(acc["now"], x["_steps"], lambda s, v: v["k"] * s + v["a"])
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    start = F.struct(F.col("_start").alias("now"), F.array().cast("array<array<double>>").alias("all"))
    replayed = begun.select("_key", "_line", F.aggregate("_line", start, step, lambda acc: acc["all"]).alias("_all"))
    pairs = replayed.select("_key", F.explode(F.arrays_zip("_line", "_all")).alias("_x"))
    return pairs.select("_key", *[F.col("_x._line")[c].alias(c) for c in others], F.col("_x._all").alias("_s"))
