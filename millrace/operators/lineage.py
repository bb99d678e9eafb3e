"""Walks over an asset graph held as ``edges(src, dst)`` and ``assets(asset, ...)``.

Every round joins a frontier to the edges, drops pairs seen before and settles
in the checkpoint folder, so plans stay short and a lost executor costs one
round. Pairs are (root, asset): only the given roots are walked, never all
pairs of the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle


#: Frontiers and walks of at most so many rows are sent to the edges, which then stay where they are.
SMALL = 100_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def walk(edges: DataFrame, roots: DataFrame, up: bool = False, depth: int | None = 10, once: bool = False) -> DataFrame:
    """Breadth-first from each root: (root, asset, depth, paths), roots left out.

    ``paths`` is the number of shortest paths from the root. ``depth`` None goes
    on until nothing new is found. With ``once`` the edges are distinct and settled.
    """
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = (edges if once else settle(edges.select("src", "dst").distinct())).select(F.col(a).alias("_from"), F.col(b).alias("_to"))
    start = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    frontier = settle(start.select("root", F.col("root").alias("asset"), F.lit(0).alias("depth"), F.lit(1).cast("double").alias("paths")))
    seen = [frontier]
    at = 0
    while depth is None or at < depth:
        at += 1
        ahead = _small(frontier)
        reached = steps.join(ahead, steps["_from"] == ahead["asset"]).groupBy("root", F.col("_to").alias("asset")).agg(
            F.sum("paths").alias("paths"))
        known = reduce(DataFrame.unionByName, seen).select("root", "asset")
        frontier = settle(reached.join(known, ["root", "asset"], "left_anti").select(
            "root", "asset", F.lit(at).alias("depth"), "paths"))
        if frontier.isEmpty():
            break
        seen.append(frontier)
    return reduce(DataFrame.unionByName, seen).filter("depth > 0")


def upstream(edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    return walk(edges, roots, up=True, depth=depth).drop("paths")


def downstream(edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    return walk(edges, roots, up=False, depth=depth).drop("paths")


def all_walks(edges: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The complete walks up and down from the given assets, and down from all that lies upstream of them.

    The edges are settled once, and both walks down are one walk from the roots of either.
    """
    once = settle(edges.select("src", "dst").distinct())
    names = assets.select(F.col(assets.columns[0]).alias("root")).distinct()
    above = walk(once, names, up=True, depth=None, once=True)
    sources = settle(above.select(F.col("asset").alias("root")).distinct())
    below = walk(once, names.unionByName(sources), depth=None, once=True)
    return above, below.join(_small(names), "root", "left_semi"), below.join(_small(sources), "root", "left_semi")


def betweenness(edges: DataFrame, assets: DataFrame, walks: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Share of shortest paths between other assets that run through each given asset.

    For an asset v, only its upstream s and downstream t can have paths through
    it; those lie on v when d(s,v) + d(v,t) = d(s,t).
    """
    above, below, all_below = walks or all_walks(edges, assets)
    up = above.select(
        F.col("root").alias("v"), F.col("asset").alias("s"), F.col("depth").alias("d_sv"), F.col("paths").alias("p_sv"))
    down = below.select(
        F.col("root").alias("v"), F.col("asset").alias("t"), F.col("depth").alias("d_vt"), F.col("paths").alias("p_vt"))
    whole = all_below.select(
        F.col("root").alias("s"), F.col("asset").alias("t"), F.col("depth").alias("d_st"), F.col("paths").alias("p_st"))
    # s and t meet in v, so a path joins them: only such pairs are looked up among the walks from s.
    via = down.join(_small(up), "v").filter(F.col("s") != F.col("t")).join(whole, ["s", "t"]).filter(
        F.col("d_sv") + F.col("d_vt") == F.col("d_st"))
    shares = via.groupBy("v").agg(F.sum(F.col("p_sv") * F.col("p_vt") / F.col("p_st")).alias("b"))
    n = edges.select(F.explode(F.array("src", "dst")).alias("a")).agg(F.count_distinct("a").cast("double").alias("n")).scalar()
    names = assets.select(F.col(assets.columns[0]).alias("asset")).distinct()
    joined = names.join(shares, names["asset"] == shares["v"], "left")
    norm = F.when(n > 2, (n - 1) * (n - 2)).otherwise(1.0)
    return joined.select("asset", (F.coalesce("b", F.lit(0.0)) / norm).alias("betweenness"))


def degrees(edges: DataFrame, assets: DataFrame, depth: int = 10, walks: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Upstream and downstream counts per given asset, up to ``depth`` steps away."""
    names = assets.select(F.col(assets.columns[0]).alias("asset")).distinct()
    above, below = walks[:2] if walks else (walk(edges, names, True, depth), walk(edges, names, False, depth))
    near = F.col("depth") <= depth
    up = above.filter(near).groupBy("root").agg(F.count("*").alias("upstream_count"))
    down = below.filter(near).groupBy("root").agg(F.count("*").alias("downstream_count"))
    out = names.join(up.withColumnRenamed("root", "asset"), "asset", "left").join(
        down.withColumnRenamed("root", "asset"), "asset", "left")
    return out.fillna(0, ["upstream_count", "downstream_count"])


def criticality(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """.4·min(down/10, 1) + .2·min(up/20, .5) + .2·quality + .2·betweenness, 1 at most.

    ``assets`` has ``asset`` and ``quality_score`` (null counts as 0.5).
    """
    walks = all_walks(edges, assets.select("asset"))
    rows = degrees(edges, assets, walks=walks).join(betweenness(edges, assets, walks), "asset").join(
        assets.select("asset", "quality_score"), "asset", "left")
    value = (
        F.least(F.col("downstream_count") / 10.0, F.lit(1.0)) * 0.4
        + F.least(F.col("upstream_count") / 20.0, F.lit(0.5)) * 0.2
        + F.coalesce("quality_score", F.lit(0.5)) * 0.2 + F.col("betweenness") * 0.2)
    return rows.withColumn("criticality", F.least(value, F.lit(1.0)))


def severity_band(s: Column) -> Column:
    return F.when(s > 0.7, "critical").when(s > 0.5, "high").when(s > 0.3, "medium").otherwise("low")


def impact_severity(affected: DataFrame, lines: int) -> DataFrame:
    """Severity of a change from the criticality of the assets it reaches."""
    n = F.count("*")
    base = F.when(n > 10, 0.4).when(n > 5, 0.2).otherwise(0.0)
    s = base + F.coalesce(F.sum("criticality"), F.lit(0.0)) * 0.1 + F.lit(min(lines / 100.0, 0.3))
    return affected.agg(n.alias("affected_assets"), s.alias("score"), (n * 2.5).alias("estimated_minutes")).withColumn(
        "severity", severity_band(F.col("score")))


# Types and words that raise confidence.
RELIABLE_TYPES = ["filter", "select", "join", "aggregate"]
CHECK_WORDS = ["validate", "check", "assert"]


def confidence(code: Column, kind: Column) -> Column:
    """0.8, more for short, known, guarded or checked code, less for long code; 0.1 to 1."""
    lines = F.size(F.split(code, "\n"))
    checked = F.lit(False)
    for w in CHECK_WORDS:
        checked = checked | F.contains(F.lower(code), F.lit(w))
    guarded = F.contains(code, F.lit("try:")) & F.contains(code, F.lit("except:"))
    raw = (
        F.lit(0.8) + F.when(lines < 10, 0.1).when(lines > 50, -0.1).otherwise(0.0)
        + F.when(kind.isin(RELIABLE_TYPES), 0.1).otherwise(0.0)
        + F.when(guarded, 0.05).otherwise(0.0) + F.when(checked, 0.05).otherwise(0.0))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), raw))


def risk_factors(code: Column) -> Column:
    """Names of the risky traits of a transformation text."""
    low = F.lower(code)
    has = lambda w: F.contains(low, F.lit(w))
    return F.array_compact(F.array(
        F.when(has("drop"), F.lit("data_deletion")),
        F.when(has("delete"), F.lit("record_deletion")),
        F.when(has("update") & ~has("where"), F.lit("bulk_update")),
        F.when(F.regexp_count(low, F.lit("join")) > 3, F.lit("many_joins")),
        F.when(has("distinct") & has("order by"), F.lit("distinct_order_by")),
        F.when(~F.contains(code, F.lit("try:")), F.lit("no_error_handling"))))


def propagate_quality(edges: DataFrame, assets: DataFrame, roots: DataFrame) -> DataFrame:
    """0.95 times the mean quality of everything upstream of each root."""
    up = upstream(edges, roots)
    joined = up.join(assets.select("asset", "quality_score"), "asset")
    return joined.groupBy("root").agg((F.avg("quality_score") * 0.95).alias("predicted_quality"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after dropping assets without in- or out-edges until nothing changes."""
    core = settle(edges.select("src", "dst").distinct())
    size = core.count()
    while size:
        kept = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
            core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        core = settle(kept)
        left = core.count()
        if left == size:
            break
        size = left
    return core


def strong_components(edges: DataFrame) -> DataFrame:
    """(asset, component) of the assets on cycles; a component is named by its smallest asset.

    In each round the smallest name flows along the edges until nothing changes, so that an
    asset has the smallest name that reaches it. Those that reach that one back, through
    assets of the same name, are its component. What is found leaves the graph with its edges,
    and assets that then lie on no cycle are trimmed. A round ends at least one
    component in every part of the graph; each step is a join on single assets.
    """
    left = cyclic_core(edges)
    found = [left.limit(0).select(F.col("src").alias("asset"), F.col("src").alias("component"))]
    while not left.isEmpty():
        names = settle(left.select(F.explode(F.array("src", "dst")).alias("asset")).distinct().withColumn("name", F.col("asset")))
        while True:
            offered = left.join(names, left["src"] == names["asset"]).groupBy("dst").agg(F.min("name").alias("offer"))
            better = names.join(offered, names["asset"] == offered["dst"], "left").select(
                "asset", F.least("name", "offer").alias("name"), F.coalesce(F.col("offer") < F.col("name"), F.lit(False)).alias("moved"))
            better = settle(better)
            names = better.select("asset", "name")
            if better.filter("moved").isEmpty():
                break
        ends = names.withColumnRenamed("asset", "dst")
        same = settle(left.join(names.withColumnRenamed("asset", "src"), "src").join(ends, ["dst", "name"]).select("src", "dst", "name"))
        members = frontier = settle(names.filter("asset = name"))
        while not frontier.isEmpty():
            back = same.join(frontier, (same["dst"] == frontier["asset"]) & (same["name"] == frontier["name"])).select(
                F.col("src").alias("asset"), same["name"]).distinct()
            frontier = settle(back.join(members.select("asset"), "asset", "left_anti"))
            members = settle(members.unionByName(frontier))
        # A root that nothing leads back to has no cycle, unless it points at itself.
        found.append(members.select("asset", F.col("name").alias("component")))
        gone = members.select("asset")
        left = cyclic_core(left.join(gone.withColumnRenamed("asset", "src"), "src", "left_anti").join(
            gone.withColumnRenamed("asset", "dst"), "dst", "left_anti"))
    every = settle(reduce(DataFrame.unionByName, found))
    several = every.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("asset")).distinct()
    alone = every.join(several, "component", "left_anti").join(loops, "asset", "left_semi").select("asset", "component")
    return every.join(several, "component", "left_semi").select("asset", "component").unionByName(alone)


def component_sizes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, assets, edges, dimension) of strong components: with E inner edges and V assets,
    a component has at most 2^dimension - 1 simple cycles, dimension being E - V + 1."""
    inner = _inner(edges, members).groupBy("component").agg(F.count("*").alias("edges"))
    size = members.groupBy("component").agg(F.count("*").alias("assets"))
    return size.join(inner, "component").select("component", "assets", "edges", (F.col("edges") - F.col("assets") + 1).alias("dimension"))


def _inner(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, component) of the different edges within a component."""
    once = edges.select("src", "dst").distinct()
    return once.join(members.withColumnRenamed("asset", "src"), "src").join(
        members.withColumnRenamed("asset", "dst"), ["dst", "component"]).select("src", "dst", "component")


def find_cycles(edges: DataFrame, depth: int | None = None, dimension: int = 16) -> DataFrame:
    """Simple cycles, each listed once from its smallest asset, with ``complete``.

    Cycles lie within strong components, so paths are followed inside these only (or, if
    the whole graph has few edges to spare, as it is), until none is left. A component whose number of cycles has no bound of 2^``dimension`` (see
    ``component_sizes``) is not listed, and ``complete`` is false: its assets are in
    ``strong_components``. ``depth`` bounds the assets of a cycle; ``complete`` is then
    false if longer paths were left.
    """
    core, whole = cyclic_core(edges), True
    # Every asset of the core has an edge out, so no part of it has more edges to spare than all of it.
    if core.count() - core.select("src").distinct().count() + 1 > dimension:
        members = settle(strong_components(edges))
        sizes = settle(component_sizes(edges, members))
        small = sizes.filter(F.col("dimension") <= dimension).select("component")
        whole = sizes.filter(F.col("dimension") > dimension).isEmpty()
        core = settle(_inner(edges, members).join(small, "component", "left_semi").select("src", "dst"))
    paths = settle(core.filter("src <= dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")))
    found = [paths.filter("start = last").select(F.array("start").alias("cycle"))]
    paths = paths.filter("start <> last")
    done, steps = paths.isEmpty(), 1
    while not done and (depth is None or steps < depth):
        steps += 1
        ahead = paths.join(core, paths["last"] == core["src"]).filter(F.col("dst") >= F.col("start"))
        found.append(ahead.filter("dst = start").select(F.col("path").alias("cycle")))
        paths = settle(ahead.filter(~F.array_contains("path", F.col("dst"))).select(
            "start", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path")))
        done = paths.isEmpty()
    return reduce(DataFrame.unionByName, found).withColumn("complete", F.lit(done and whole))


def opportunities(rows: DataFrame) -> DataFrame:
    """Consolidation, caching and quality advice from counts, quality and criticality."""
    a = rows.filter("upstream_count > 10").select(
        "asset", F.lit("consolidation").alias("type"), F.when(F.col("upstream_count") > 20, "high").otherwise("medium").alias("priority"))
    b = rows.filter("downstream_count > 15").select("asset", F.lit("caching").alias("type"), F.lit("high").alias("priority"))
    c = rows.filter((F.col("quality_score") < 0.7) & (F.col("criticality") > 0.6)).select(
        "asset", F.lit("quality_improvement").alias("type"), F.lit("critical").alias("priority"))
    return a.unionByName(b).unionByName(c)


def lineage_report(rows: DataFrame) -> DataFrame:
    """Position in the graph and risk band per asset."""
    c = F.col("criticality")
    position = F.when(F.col("upstream_count") == 0, "source").when(F.col("downstream_count") > 0, "intermediate").otherwise("sink")
    band = F.when(c > 0.8, "critical").when(c > 0.6, "high").when(c > 0.4, "medium").otherwise("low")
    return rows.select("asset", "upstream_count", "downstream_count", "criticality", position.alias("graph_position"),
                       band.alias("criticality_level"))


def schema_hash(df: DataFrame) -> str:
    """Hash of column names and types, for change detection."""
    import hashlib

    return hashlib.md5(",".join(f"{n}:{t}" for n, t in df.dtypes).encode()).hexdigest()


def register_run(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asset and edge rows of runs ``(source, target, code, transformation_type)``, to be appended to the tables."""
    names = runs.select(F.explode(F.array(F.concat(F.lit("source_"), "source"), F.concat(F.lit("target_"), "target"))).alias("asset"))
    edges = runs.select(
        F.concat(F.lit("source_"), "source").alias("src"), F.concat(F.lit("target_"), "target").alias("dst"), "transformation_type",
        F.md5("code").alias("transformation_hash"), confidence(F.col("code"), F.col("transformation_type")).alias("confidence"))
    return names.distinct(), edges
