"""Iterative graph operators: each round is one join and one aggregation, its result a written table.

The driver loops and reads only a convergence figure; no rows reach it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import exprs
from tessera.scratch import materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse; the edges are computed once."""
    turned = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("x")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(turned, *rest).select("x.src", "x.dst", *rest)


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """``id, hops``: what is reached within ``depth`` hops and how soon. Only the frontier is joined.

    Walked both ways, equal edges are left as they are, for what they reach is made distinct and making all edges so takes more than walking them twice.
    """
    e = materialize(edges.select("src", "dst").distinct() if directed else both_ways(edges.select("src", "dst")), "hop-edges")
    reached = materialize(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "hops")
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached, "id", "left_anti").withColumn("hops", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int = 2, edge_types: list[str] | None = None, layers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """What lies within ``depth`` hops of the seeds (``id, hops``), and the edges among it (``src, dst, edge_type``).

    Only edges of ``edge_types`` are walked and returned, and only nodes (``id, layer``) of ``layers`` are reached; null stands for
    all. A seed stays whatever its layer; an id that ``nodes`` lacks is reached only without a filter of layers.
    """
    e = edges if edge_types is None else edges.where(F.col("edge_type").isin(*edge_types))
    if layers is not None:
        known = nodes.where(F.col("layer").isin(*layers)).select("id").union(seeds.select("id")).distinct()
        for end in ("src", "dst"):
            e = e.join(known.withColumnRenamed("id", end), end, "left_semi")
    e = materialize(e.select("src", "dst", "edge_type").distinct(), "subgraph-edges")
    near = materialize(neighborhood(e, seeds, depth), "subgraph-nodes")
    for end in ("src", "dst"):
        e = e.join(near.select(F.col("id").alias(end)), end, "left_semi")
    return near, e.select("src", "dst", "edge_type")


def two_hop_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    near = neighborhood(edges, seeds, 1)
    touch = lambda c: edges.join(near.select(F.col("id").alias(c)), c, "left_semi")
    return touch("src").unionByName(touch("dst")).select("src", "dst", "edge_type").distinct()


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """``id, rank``: weighted walk with restarts; dangling mass goes back to the seeds (``id, weight``).

    Only nodes with an out-edge and seeds are iterated; the others pass nothing on and get their rank in one step at the end.
    """
    e = edges.where("weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = materialize(e.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "pagerank-edges")
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    restart = materialize(seeds.groupBy("id").agg((F.sum("weight") / total).alias("r")), "pagerank-seeds")
    sources = materialize(e.select(F.col("src").alias("id")).distinct(), "pagerank-sources")
    held = materialize(sources.union(restart.select("id")).distinct(), "pagerank-held")
    inner = materialize(e.join(held.withColumnRenamed("id", "dst"), "dst", "left_semi"), "pagerank-inner")
    rank = before = restart.select("id", F.col("r").alias("rank"))
    for _ in range(rounds):
        spread = rank.join(sources, "id", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        moved = rank.join(inner, rank.id == inner.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        both = moved.join(restart, "id", "full_outer").select("id", (damping * F.coalesce("m", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)) * (1 - damping * spread)).alias("rank"))
        both = materialize(both, "pagerank")
        change = lambda x, y: x.join(y.withColumnRenamed("rank", "old"), "id", "full_outer").select("id", F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("d"))
        # ends without an out-edge move by no more than the damped moves of the sources a round before
        delta = change(both, rank).agg(F.sum("d")).first()[0] or 0.0
        if delta < tolerance:
            delta += damping * (change(rank, before).agg(F.sum("d")).first()[0] or 0.0) if before is not rank else spread
        before, rank = rank, both
        if delta < tolerance:
            break
    ends = e.join(held.withColumnRenamed("id", "dst"), "dst", "left_anti").join(before.withColumnRenamed("id", "src"), "src")
    return rank.union(ends.groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("rank") * F.col("p"))).alias("rank")))


def pagerank_restart(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, epsilon: float = 1e-6) -> DataFrame:
    """``id, rank`` of all ``nodes(id)``: x = (1 - alpha) t + alpha A x from x = t, until no rank moves by ``epsilon``.

    A is what supports minus what contradicts, from ``edges(src, dst, edge_type, weight)``, each source's column divided by its
    sum; a sum of 0 or less divides by 1, so mass that dangles is lost. t is even over the seeds that are nodes, over all
    nodes without one. The rank before the last step is returned, as where that step moved nothing.
    """
    n = materialize(nodes.select("id").where("id is not null").distinct(), "restart-nodes")
    sign = F.when(F.col("edge_type") == "SUPPORTS", F.col("weight")).when(F.col("edge_type") == "CONTRADICTS", -F.col("weight"))
    e = edges.withColumn("w", sign).where("w is not null").join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = materialize(e.join(out, "src").select(F.col("src").alias("id"), "dst", (F.col("w") / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)).alias("p")), "restart-edges")
    at = n.join(seeds.select("id").distinct().withColumn("seed", F.lit(1.0)), "id", "left")
    one = at.agg(F.sum("seed"), F.count("*")).first()
    t = F.lit(1.0 / one[1] if one[1] else 0.0) if not one[0] else F.coalesce("seed", F.lit(0.0)) / one[0]
    x = materialize(at.select("id", t.alias("t"), t.alias("rank")), "restart")
    for _ in range(rounds):
        moved = x.join(e, "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("m"))
        new = materialize(x.join(moved, "id", "left").select("id", "t", ((1 - alpha) * F.col("t") + alpha * F.coalesce("m", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")), "restart")
        delta = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        if delta is None or delta < epsilon:
            break
        x = new.drop("old")
    return x.select("id", "rank")


def ppr_channel(edges: DataFrame, seeds: DataFrame, k: int = 10, damping: float = 0.85, rounds: int = 10, side: int = 16, most: int = 4096) -> DataFrame:
    """Personalised PageRank for a table of queries at once: ``query_id, node_id, score, rank``.

    ``seeds``: ``query_id, id, weight``. Up to ``side`` queries are walked side by side, a column each, so a round is one join and one sum for
    all of them; a node's edges are lists of at most about ``most``. Mass that dangles goes back to its query's seeds; as edges
    are walked both ways only seeds without an edge dangle, so how much it is follows from their share ``lost`` alone.
    """
    e = both_ways(edges.where("weight > 0").select("src", "dst", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    e = materialize(e, "ppr-weights")
    out = e.groupBy("src").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / most).alias("parts"))
    e = e.join(out, "src").groupBy("src", F.pmod(F.xxhash64("dst"), "parts").alias("part")).agg(F.collect_list(F.struct("dst", (F.col("w") / F.col("total")).alias("p"))).alias("out"))
    e = materialize(e.select("src", "out"), "ppr-edges")
    total = seeds.groupBy("query_id").agg(F.sum("weight").alias("total"))
    restart = seeds.join(total, "query_id").groupBy("query_id", "id").agg(F.sum(F.col("weight") / F.col("total")).alias("r"))
    restart = materialize(restart.join(e.select(F.col("src").alias("id"), F.lit(True).alias("known")).distinct(), "id", "left"), "ppr-seeds")
    asked = restart.groupBy("query_id").agg(F.sum(F.when(F.col("known"), 0.0).otherwise(F.col("r"))).alias("lost"))
    n = asked.count()
    side = max(1, min(side, n))
    group = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // (64 * side)) or 1))
    place = F.row_number().over(Window.partitionBy("group").orderBy("query_id")) - 1
    asked = asked.withColumn("group", group).withColumn("place", place)
    asked = materialize(asked.select("query_id", "lost", (F.col("group") * (1 << 32) + F.floor(F.col("place") / side)).alias("block"), (F.col("place") % side).alias("slot")), "ppr-queries")
    slots = [f"c{i}" for i in range(side)]
    at = lambda c, i: F.sum(F.when(F.col("slot") == i, F.col(c)))
    restart = restart.join(asked, "query_id").groupBy("block", "id").agg(*[at("r", i).alias(c) for i, c in enumerate(slots)], *[at("lost", i).alias(f"lost_{c}") for i, c in enumerate(slots)])
    restart = materialize(restart, "ppr-restart")
    rank = restart.select("block", "id", *slots)
    back = {c: F.lit(1.0) for c in slots}
    for _ in range(rounds):
        # what moved is all mass but that on seeds without an edge
        back = {c: 1 - damping * (1 - F.col(f"lost_{c}") * b) for c, b in back.items()}
        moved = rank.join(e, rank.id == e.src).select("block", F.explode("out").alias("o"), *slots).select("block", F.col("o.dst").alias("id"), *[(damping * F.col(c) * F.col("o.p")).alias(c) for c in slots])
        given = restart.select("block", "id", *[(F.col(c) * back[c]).alias(c) for c in slots])
        rank = materialize(moved.union(given).groupBy("block", "id").agg(*[F.sum(c).alias(c) for c in slots]), "ppr")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.round(c, 6).alias("score")) for i, c in enumerate(slots)])).alias("x")
    scored = rank.select("block", F.col("id").alias("node_id"), each).select("block", "node_id", "x.slot", "x.score").where("score is not null")
    w = Window.partitionBy("block", "slot").orderBy(F.desc("score"), "node_id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asked, ["block", "slot"]).select("query_id", "node_id", "score", "rank")


def propagate_confidence(prior: DataFrame, edges: DataFrame, alpha: float = 0.8, eta: float = 1.0, rounds: int = 100, epsilon: float = 1e-6, by: tuple[str, ...] = (), supporting: tuple[str, ...] = ("SUPPORTS",)) -> DataFrame:
    """x = clip((1 - alpha) prior + alpha (S - eta C) x, 0, 1) to a fixed point; S and C row-normalised per target.

    ``prior``: ``id, credibility``; ``edges``: ``src, dst, edge_type, weight``. Nodes without in-edges keep their prior. ``by`` names
    columns of both that tell one graph from another: all graphs are iterated together. A round that moves no node with an
    out-edge is the last, as the next one would give the same.
    """
    keys = list(by)
    sign = F.when(F.col("edge_type").isin(*supporting), 1.0).when(F.col("edge_type") == "CONTRADICTS", -eta)
    e = edges.withColumn("sign", sign).where("sign is not null").groupBy(*keys, "src", "dst", "sign", "edge_type").agg(F.max("weight").alias("weight"))
    norm = e.groupBy(*keys, "dst", "sign").agg(F.sum("weight").alias("total"))
    e = materialize(e.join(norm, [*keys, "dst", "sign"]).where("total > 0").select(*keys, F.col("src").alias("id"), "dst", (F.col("sign") * F.col("weight") / F.col("total")).alias("w")), "propagate-edges")
    sources = materialize(e.select(*keys, "id").distinct(), "propagate-sources")
    p = materialize(prior.select(*keys, "id", "credibility"), "propagate-prior")
    x = p.select(*keys, "id", F.col("credibility").alias("x"))
    for _ in range(rounds):
        inflow = x.join(e, [*keys, "id"]).groupBy(*keys, F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("inflow"))
        new = p.join(inflow, [*keys, "id"], "left").join(x, [*keys, "id"])
        new = materialize(new.select(*keys, "id", F.when(F.col("inflow").isNull(), F.col("credibility")).otherwise(exprs.clamp((1 - alpha) * F.col("credibility") + alpha * F.col("inflow"))).alias("y"), "x"), "propagate")
        moved = new.agg(F.max(F.abs(F.col("y") - F.col("x")))).first()[0]
        x = new.select(*keys, "id", F.col("y").alias("x"))
        if moved is None or moved < epsilon or new.where("y <> x").join(sources, [*keys, "id"], "left_semi").isEmpty():
            break
    return x.select(*keys, "id", F.col("x").alias("confidence"))


def diffuse_heat(heat: DataFrame, edges: DataFrame, decay: float = 0.7, least: float = 0.01, depth: int = 3, hot: float = 0.5) -> DataFrame:
    """``id, heat``: the most heat that reaches each node from hot ones along a path, seeds left out.

    Every hop multiplies by the decay, the edge type's weight and the edge's own heat (null .5);
    what falls below ``least`` is pruned from the frontier.
    """
    weight = exprs.lookup(schema.DIFFUSION_WEIGHT, "edge_type", 0.4) * F.coalesce("edge_heat", F.lit(0.5)) * decay
    e = materialize(both_ways(edges.select("src", "dst", weight.alias("w"))).groupBy("src", "dst").agg(F.max("w").alias("w")), "diffuse-edges")
    seeds = materialize(heat.where(F.col("heat") >= hot).select("id", "heat"), "diffuse-seeds")
    best, frontier = seeds, seeds
    for _ in range(depth):
        step = frontier.join(e, frontier.id == e.src).select(F.col("dst").alias("id"), (F.col("heat") * F.col("w")).alias("heat")).where(F.col("heat") >= least)
        step = step.groupBy("id").agg(F.max("heat").alias("heat"))
        better = step.join(best.withColumnRenamed("heat", "known"), "id", "left").where("known is null or heat > known").select("id", "heat")
        frontier = materialize(better, "diffuse")
        best = materialize(best.union(frontier).groupBy("id").agg(F.max("heat").alias("heat")), "diffuse-best")
    return best.join(seeds.select("id"), "id", "left_anti")


def heat_levels(nodes: DataFrame, reached: DataFrame, decay: float = 0.5) -> DataFrame:
    """``id, propagated, effective, level``: nodes after a diffusion.

    ``nodes``: ``id, heat, propagated`` (of before, or null); ``reached``: ``id, heat``. What was propagated before decays; a node
    that is reached takes the new heat instead. Effective heat is its own plus the propagated, at most 1, and tells the level.
    """
    j = nodes.join(reached.select("id", F.col("heat").alias("fresh")), "id", "left")
    j = j.withColumn("now", F.coalesce("fresh", F.col("propagated") * decay))
    effective = F.least(F.lit(1.0), F.coalesce("heat", F.lit(0.0)) + F.coalesce("now", F.lit(0.0)))
    return j.select("id", F.col("now").alias("propagated"), effective.alias("effective"), exprs.level(F.round(effective, 9)).alias("level"))


def shortest_path(edges: DataFrame, source: int, target: int, most: int | None = None) -> DataFrame:
    """``node_id, place`` along one shortest undirected path: of several the one with the smallest ids from the target back.

    However long it is, unless ``most`` hops are stated. A hop leads to none but new nodes and those of the last two levels, so each node is
    written once.
    """
    e = materialize(both_ways(edges.select("src", "dst")), "path-edges")  # equal edges give one ``via``
    spark = edges.sparkSession
    levels = [materialize(spark.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(None).cast("long").alias("via")), "path")]
    while levels[-1].where(F.col("id") == target).isEmpty():
        if len(levels) - 1 == most:
            return spark.createDataFrame([], "node_id long, place int")
        step = levels[-1].select(F.col("id").alias("src")).join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
        for known in levels[-2:]:
            step = step.join(known.select("id"), "id", "left_anti")
        levels.append(materialize(step, "path-frontier"))
        if levels[-1].isEmpty():
            return spark.createDataFrame([], "node_id long, place int")
    path, at = [], target
    for hops in reversed(range(len(levels))):  # one row a hop
        path.append((at, hops))
        at = levels[hops].where(F.col("id") == at).first()["via"]
    return spark.createDataFrame(path, "node_id long, place int")


#: Steps that are walked at a time without asking whether fewer would do.
FEW_STEPS = 1 << 22


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 6, few: int = FEW_STEPS) -> DataFrame:
    """``a, b, place, node_id`` along one shortest undirected path for each of the distinct ``pairs(a, b)``, all searched at once.

    Both ends of every pair grow frontiers, each time the one with fewer edges, until an edge joins them; the step that joins them is
    walked but not kept, and only pairs without one grow. Of several paths the one with the smallest ids from b back is taken: b's
    frontier is in the order of its paths, so where more than ``few`` steps join the frontiers its first nodes are tried first, and twice as many
    again for the pairs that they don't join. Before many steps are walked pairs of unconnected ends go. A pair
    further apart than ``most`` hops, or with an end that no edge has, has no rows; a pair of equal ends has one; nulls none.
    """
    once = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    once = materialize(once, "paths-once")
    degree = materialize(both_ways(once).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high")), "paths-degrees")
    e = both_ways(once.where("src <> dst")).join(degree.select(F.col("id").alias("dst"), "n"), "dst").select("src", "dst", "n")
    e = materialize(e, "paths-edges")
    n_edges = e.count()
    pair = ["a", "b"]
    asked = pairs.select(*pair).where("a is not null and b is not null").distinct()
    for end in "ab":
        asked = asked.join(degree.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}")), end)
    asked = materialize(asked.select(*pair, "n_a", "n_b"), "paths-pairs")
    open_ = asked.where("a <> b").select(*pair)
    # a's paths lead from a node to a, b's from behind b to a node; at the first two levels the node tells the path
    level = {"a": 0, "b": 0}
    front = {end: asked.where("a <> b").select(*pair, F.col(end).alias("id"), F.col(f"n_{end}").alias("n")) for end in "ab"}
    behind = dict(front)
    none = F.array().cast("array<bigint>")
    told = lambda end, id, path: F.col(path) if level[end] > 1 else (F.array(id, "a") if end == "a" else F.array(id)) if level[end] else F.array("a") if end == "a" else none
    held = lambda end, path: [F.col("path").alias(path)] if level[end] > 1 else []
    cost = lambda df: df.agg(F.sum("n")).first()[0] or 0

    def joined(near: str, df: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs that an edge joins, with the first path from b back to a."""
        far = "ab".replace(near, "")
        w = df.select(*pair, F.col("id").alias(f"at_{near}"), *held(near, f"path_{near}"))
        if level[far]:
            w = w.join(e.select(F.col("src").alias(f"at_{near}"), F.col("dst").alias("id")), f"at_{near}")
            w = w.join(other.select(*pair, "id", *held(far, f"path_{far}")), [*pair, "id"]).withColumnRenamed("id", f"at_{far}")
        else:
            w = w.join(e.select(F.col("src").alias(far), F.col("dst").alias(f"at_{near}")), [far, f"at_{near}"])
        return w.groupBy(*pair).agg(F.min(F.concat(told("b", "at_b", "path_b"), told("a", "at_a", "path_a"))).alias("back"))

    def tried() -> list[DataFrame]:
        """The joined pairs, from the first of b's paths on."""
        w = Window.partitionBy(*pair).orderBy("path" if level["b"] > 1 else "id")
        order = materialize(front["b"].withColumn("at", F.row_number().over(w)), "paths-order")
        left, met, last, now = open_, [], 0, 1
        while True:
            some = order.where(F.col("at") > last)
            some = some.where(F.col("at") <= now) if now else some
            met.append(materialize(joined("b", some.join(left, pair, "left_semi"), front["a"].join(left, pair, "left_semi")), "paths-met"))
            left = materialize(left.join(met[-1], pair, "left_anti"), "paths-left")
            rest = cost(order.where(F.col("at") > now).join(left, pair, "left_semi")) if now else 0
            if not rest:
                return met
            last, now = now, 2 * now + 1 if rest > few else 0

    found = [asked.where("a = b").select(*pair, none.alias("back"))]
    costs = {end: cost(front[end]) for end in "ab"}
    whole = True
    for length in range(1, most + 1):
        if not all(level.values()):
            # a frontier of one node: which nodes of the other have an edge to it
            near = "b" if not level["a"] else "a"
            met = [materialize(joined(near, front[near], front["ab".replace(near, "")]), "paths-met")]
        elif min(costs.values()) <= few or 16 * costs["a"] < costs["b"]:
            near, far = sorted("ab", key=lambda k: costs[k])
            met = [materialize(joined(near, front[near], front[far]), "paths-met")]
        else:
            met = tried()
        found += met
        for m in met:
            open_ = open_.join(m, pair, "left_anti")
        open_ = materialize(open_, "paths-open")
        if length == most or open_.isEmpty():
            break
        if whole and min(costs.values()) > max(few, n_edges) // 4:
            whole, part = False, _parts(once, degree)
            for end in "ab":
                open_ = open_.join(part.select(F.col("id").alias(end), F.col("part").alias(f"part_{end}")), end)
            open_ = materialize(open_.where("part_a = part_b").select(*pair), "paths-open")
        for end in "ab":
            front[end] = front[end].join(open_, pair, "left_semi")
            front[end] = materialize(front[end], "paths-front") if level[end] else front[end]
        costs = {end: cost(front[end]) for end in "ab"}
        end = min("ab", key=lambda k: costs[k])
        step = front[end].select(*pair, F.col("id").alias("src"), *held(end, "path")).join(e, "src").withColumnRenamed("dst", "id")
        if level[end]:
            best = F.min("path" if level[end] > 1 else "src").alias("best")
            step = step.groupBy(*pair, "id").agg(best, F.first("n").alias("n"))
            for old in (front[end], behind[end]):
                step = step.join(old.select(*pair, "id"), [*pair, "id"], "left_anti")
            best = told(end, "best", "best")
            step = _dealt(step.select(*pair, "id", "n", (F.concat(F.array("id"), best) if end == "a" else F.concat(best, F.array("id"))).alias("path")), *pair)
        else:
            step = step.select(*pair, "id", "n")
        level[end] += 1
        behind[end], front[end] = front[end], materialize(step, "paths-front")
        costs[end] = cost(front[end])
    every = found[0]
    for m in found[1:]:
        every = every.union(m)
    return every.select(*pair, F.size("back").alias("length"), F.posexplode(F.concat(F.array("b"), "back")).alias("at", "node_id")).select(*pair, (F.col("length") - F.col("at")).alias("place"), "node_id")


def _parts(once: DataFrame, degree: DataFrame) -> DataFrame:
    """``id, part``: the connected part of each node, named by one of its ids.

    Nodes go to the smallest name among those that they are linked with, again and again; first along each node's edges to its smallest and
    largest neighbour (``low``, ``high``), then along the edges that still link two parts.
    """
    part = degree.select("id", F.col("id").alias("part"))
    for links in (degree.select(F.col("id").alias("src"), F.explode(F.array("low", "high")).alias("dst")), once):
        while True:
            for end in ("src", "dst"):
                links = links.join(part.select(F.col("id").alias(end), F.col("part").alias(f"to_{end}")), end)
            links = links.where("to_src <> to_dst").select(F.least("to_src", "to_dst").alias("src"), F.greatest("to_src", "to_dst").alias("dst")).distinct()
            links = materialize(links, "paths-links")
            if links.isEmpty():
                break
            up = both_ways(links).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up")).select("id", F.least("id", "up").alias("up"))
            up = materialize(up, "paths-up")
            while True:
                next_ = up.select(F.col("id").alias("up"), F.col("up").alias("further"))
                up = materialize(up.join(next_, "up").select("id", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "paths-up")
                if up.where("moved").isEmpty():
                    break
                up = up.select("id", "up")
            part = part.join(up.select(F.col("id").alias("part"), "up"), "part", "left").select("id", F.coalesce("up", "part").alias("part"))
            part = materialize(part, "paths-parts")
    return part


#: Rows that a hash map of a task is meant for.
TASK_ROWS = 1 << 19


def _dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """``df`` over all shuffle partitions, however small it is: what a join makes of it is not. With ``rows``, over so many that a task has about ``TASK_ROWS``."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def version_roots(versions: DataFrame) -> DataFrame:
    """``node_id, root, place``: each version's chain by pointer jumping, which doubles its reach each round.

    A version whose predecessor isn't in the table begins its chain. Versions that supersede each other
    in a circle are an error, found after as many rounds as the longest chain could need.
    """
    own = versions.select("node_id", "supersedes_id")
    there = own.select(F.col("node_id").alias("supersedes_id"), F.lit(True).alias("there")).distinct()
    j = own.join(there, "supersedes_id", "left")
    at = materialize(j.select("node_id", F.when(F.col("there"), F.col("supersedes_id")).otherwise(F.col("node_id")).alias("up"), F.when(F.col("there"), 1).otherwise(0).alias("place")), "roots")
    for _ in range(at.count().bit_length() + 1):
        up = at.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("place").alias("place2"))
        new = at.join(up, "up").select("node_id", F.col("up2").alias("up"), (F.col("place") + F.col("place2")).alias("place"), (F.col("up2") != F.col("up")).alias("moved"))
        new = materialize(new, "roots")
        if new.where("moved").isEmpty():
            return new.select("node_id", F.col("up").alias("root"), "place")
        at = new.drop("moved")
    raise ValueError(f"versions supersede each other in a circle: {new.where('moved').first()['node_id']} is on or behind it")


def resolve_head(versions: DataFrame, ids: DataFrame, at) -> DataFrame:
    """The version of each input's chain that is valid at a time, the newest if several."""
    roots = version_roots(versions)
    of = ids.join(roots, "node_id").select("node_id", "root")
    valid = versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).join(roots, "node_id")
    head = valid.groupBy("root").agg(F.max_by("node_id", F.struct("valid_from", "node_id")).alias("head"))
    return of.join(head, "root", "left").select("node_id", "head")


def chain_pointers(versions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Per chain its first and last version and length. ``roots``: what ``version_roots`` gives, where it is at hand."""
    r = version_roots(versions) if roots is None else roots
    return r.groupBy("root").agg(F.max_by("node_id", "place").alias("head"), F.count("*").alias("length"))


def would_cycle(edges: DataFrame, new: DataFrame, hops: int = 10) -> DataFrame:
    """New edges whose target already reaches their source within ``hops``: the reach of each distinct target is walked once."""
    e = materialize(edges.select("src", "dst").distinct(), "cycle-edges")
    n = materialize(new.select("src", "dst").distinct(), "cycle-new")
    reached = materialize(n.select(F.col("dst").alias("start"), F.col("dst").alias("id")).distinct(), "cycle")
    frontier = reached
    for _ in range(hops):
        step = frontier.select("start", F.col("id").alias("src")).join(e, "src").select("start", F.col("dst").alias("id")).distinct()
        frontier = materialize(step.join(reached, ["start", "id"], "left_anti"), "cycle-frontier")
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    hit = reached.select(F.col("start").alias("dst"), F.col("id").alias("src")).withColumn("cycle", F.lit(True))
    return n.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("cycle", F.lit(False)).alias("cycle"))


def provenance(edges: DataFrame, ids: DataFrame, depth: int = 10, up: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """What the ids derive from (``up``) or what derives from them, with hops, and whether it is an end: a root derives from nothing, from a leaf nothing derives."""
    e = edges if kinds is None else edges.where(F.col("edge_type").isin(*kinds))
    e = e.select("src", "dst") if up else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = neighborhood(e, ids, depth, directed=True)
    inner = e.select(F.col("src").alias("id")).distinct().withColumn("inner", F.lit(True))
    return reached.join(inner, "id", "left").select("id", "hops", F.col("inner").isNull().alias("is_end"))


def stale_interior(versions: DataFrame, most: int = 5) -> DataFrame:
    """Versions more than ``most`` behind their chain's head, whose content may go."""
    w = Window.partitionBy("root")
    r = version_roots(versions).withColumn("behind", F.max("place").over(w) - F.col("place"))
    return r.where(F.col("behind") > most).select("node_id", "root", "behind")


def causal_closure(edges: DataFrame, depth: int = 3, least: float = 0.5) -> DataFrame:
    """Inferred pairs along causal paths of 2 to ``depth`` edges: the best product of weights with the ids of its edges in order; known pairs and loops are left out.

    ``edges``: ``edge_id, src, dst, edge_type, weight``. Of equal products the smallest list of ids stands.
    """
    best = lambda df: df.groupBy("src", "dst").agg(F.min_by(F.struct("w", "lineage"), F.struct(-F.col("w"), "lineage")).alias("b")).select("src", "dst", "b.w", "b.lineage")
    c = materialize(best(edges.where("edge_type = 'CAUSES'").select("src", "dst", F.col("weight").alias("w"), F.array("edge_id").alias("lineage"))), "causes")
    paths, every = c, None
    for _ in range(depth - 1):
        step = paths.select("src", F.col("dst").alias("mid"), F.col("w").alias("w1"), F.col("lineage").alias("before")).join(c.select(F.col("src").alias("mid"), "dst", "w", "lineage"), "mid")
        step = step.select("src", "dst", F.round(F.col("w1") * F.col("w"), 9).alias("w"), F.concat("before", "lineage").alias("lineage")).where((F.col("src") != F.col("dst")) & (F.col("w") >= least))
        paths = materialize(best(step), "causal-paths")
        every = paths if every is None else every.union(paths)
    return best(every).join(c.select("src", "dst"), ["src", "dst"], "left_anti")


def invalidate_derived(lineage: DataFrame, dead: DataFrame, depth: int = 3) -> DataFrame:
    """Edges that rest, at any remove up to ``depth``, on a dead one. ``lineage``: ``edge_id, from_id``."""
    gone = materialize(dead.select("id").distinct(), "dead")
    frontier, out = gone, None
    for _ in range(depth):
        step = lineage.join(frontier.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("edge_id").alias("id")).distinct()
        frontier = materialize(step.join(gone, "id", "left_anti"), "dead-frontier")
        if frontier.isEmpty():
            break
        gone = gone.union(frontier)
        out = frontier if out is None else out.union(frontier)
    return out if out is not None else gone.limit(0)


def cascade_staleness(edges: DataFrame, changed: DataFrame, supports: DataFrame, depth: int = 10, least: int = 3) -> DataFrame:
    """What stands on changed nodes: tombstoned with too few supports left, else stale."""
    reached = neighborhood(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), changed, depth, directed=True).where("hops > 0")
    return reached.join(supports, "id", "left").select("id", "hops", F.when(F.coalesce("n_supports", F.lit(0)) < least, "tombstone").otherwise("stale").alias("action"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities: each round a node takes its neighbours' most frequent label, the smallest of equals."""
    # distinct as unordered pairs, which are half as many; an edge to itself counts once
    turn = (F.col("src") > F.col("dst")) | (F.col("src").isNull() & F.col("dst").isNotNull())
    ends = F.when(turn, F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))).otherwise(F.struct("src", "dst")).alias("x")
    pairs = _dealt(edges.select("src", "dst").select(ends).select("x.src", "x.dst"), "src", "dst").distinct()
    both = F.explode(F.array_distinct(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).alias("x")
    e = materialize(pairs.select(both).select("x.src", "x.dst"), "label-edges")
    rows = e.count()
    labels = materialize(e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")), "labels")
    for _ in range(rounds):
        # at first each label is its own vote, so counting before they are dealt would hold nearly all of them and save nothing
        votes = _dealt(e.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select("src", "label"), "src", "label", rows=rows)
        votes = votes.groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        labels = materialize(best.select(F.col("src").alias("id"), "label"), "labels")
    return labels


def co_occurrence(facts: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of kinds of facts that stand on the same evidence, on how much of it, and a stable id: ``evidence, kind``."""
    k = facts.select("evidence", "kind").distinct()
    pairs = k.select("evidence", F.col("kind").alias("a")).join(k.select("evidence", F.col("kind").alias("b")), "evidence").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least).select(exprs.content_id("a", "b").alias("pattern_id"), "a", "b", "frequency")


def chain_terminals(versions: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Chains whose every version is superseded, with the head that should live; and those that cross groups, with the first version of another group.

    ``versions``: ``node_id, supersedes_id, state, group``; ``roots``: what ``version_roots`` gives, where it is at hand.
    """
    r = (version_roots(versions) if roots is None else roots).join(versions.select("node_id", "state", "group"), "node_id")
    first = r.groupBy("root").agg(F.min_by("group", "place").alias("first_group"), F.max_by("node_id", "place").alias("head"), F.bool_and(F.col("state") == "SUPERSEDED").alias("all_superseded"))
    j = r.join(first, "root").groupBy("root").agg(
        F.first("head").alias("head"), F.bool_and("all_superseded").alias("all_superseded"), F.min_by("node_id", F.when(F.col("group") != F.col("first_group"), F.col("place"))).alias("gap_at"),
        F.count_if(F.col("group") != F.col("first_group")).alias("n_other"),
    )
    return j.where("all_superseded or n_other > 0").select("root", "head", "all_superseded", F.when(F.col("n_other") > 0, F.col("gap_at")).alias("gap_at"))


def stub_stale(versions: DataFrame, most: int = 5, budget: int | None = None) -> DataFrame:
    """The versions with the content of those far behind their chain's head nulled; their edges stay. ``budget``: of each chain the oldest so many at most.

    ``versions``: ``node_id, supersedes_id, content``.
    """
    old = stale_interior(versions, most)
    if budget is not None:
        old = old.withColumn("k", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("behind"), "node_id"))).where(F.col("k") <= budget)
    j = versions.join(old.select("node_id", F.lit(True).alias("stub")), "node_id", "left")
    return j.withColumns({"content": F.when(F.col("stub"), None).otherwise(F.col("content")), "stub": F.coalesce("stub", F.lit(False))})


def causal_chains(edges: DataFrame, kinds: DataFrame, shortest: int = 2, longest: int = 6, least: int = 2) -> DataFrame:
    """Patterns of causal chains: the kinds of nodes along walks of ``shortest`` to ``longest`` edges, how often each occurs, and a stable id.

    ``kinds``: ``id, kind``. Walks are counted by where they end and their pattern, never listed.
    """
    e = edges.where("edge_type = 'CAUSES'").select("src", "dst").distinct()
    e = materialize(e.join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("to")), "dst").select("src", "dst", "to"), "causal-edges")
    at = e.join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("from")), "src").groupBy("dst", F.concat_ws(">", "from", "to").alias("pattern")).agg(F.count("*").alias("n"))
    out = None
    for length in range(1, longest + 1):
        at = materialize(at, "causal-walks")
        if length >= shortest:
            found = at.groupBy("pattern").agg(F.sum("n").alias("frequency")).withColumn("length", F.lit(length))
            out = found if out is None else out.unionByName(found)
        at = at.select(F.col("dst").alias("src"), "pattern", "n").join(e, "src").groupBy("dst", F.concat_ws(">", "pattern", "to").alias("pattern")).agg(F.sum("n").alias("n"))
    return out.where(F.col("frequency") >= least).select(exprs.content_id("pattern").alias("pattern_id"), "pattern", "length", "frequency")
