"""A temporal property graph as two DataFrames: nodes (node_id) and edges (src, dst, type).

Merges are aggregations, traversals are loops of frontier joins with a visited set; every frontier
is written to the shared folder when a loop may be long, which cuts the lineage.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count as numbers

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks import spool, unspool
from .evidence import severity_order

#: Rounds after which what a loop has seen is written anew, so its plan stays small.
ROUNDS = 8
# Parts of a variable's name that make it an actuator.
ACTUATOR_MARKS = ["V", "VALVE", "PUMP"]


def extract(df: DataFrame) -> DataFrame:
    """Evidence rows as one row per node and edge: kind, node_id or src/dst/type, risk, time.

    Columns used: detector, entity, target, process, variable, risk_score, confidence, severity, us.
    A network event's target host gets half its risk; an OT variable is an actuator by its name.
    """
    r, d = F.col("risk_score"), F.upper("detector")
    node = lambda kind, c, risk: F.struct(F.lit("node").alias("kind"), F.concat(F.lit(f"{kind}:"), c).alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(kind).alias("type"), risk.cast("double").alias("risk"))
    edge = lambda a, b, kind: F.struct(F.lit("edge").alias("kind"), a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), r.cast("double").alias("risk"))
    id = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    actuator = F.lit(False)
    for m in ACTUATOR_MARKS:
        actuator = actuator | F.upper("variable").contains(m)
    made = (
        F.when(d == "NETWORK", F.array(node("host", F.col("entity"), r), node("host", F.col("target"), r * 0.5), edge(id("host", "entity"), id("host", "target"), "connects_to")))
        .when(d == "IDENTITY", F.array(node("user", F.col("entity"), r), node("host", F.col("target"), r * 0.5), edge(id("user", "entity"), id("host", "target"), "authenticates_to")))
        .when(d == "ENDPOINT", F.array(node("host", F.col("entity"), r), node("process", F.col("process"), r), edge(id("host", "entity"), id("process", "process"), "runs")))
        .when(d == "OT", F.array(node("plc", F.col("entity"), r), F.when(actuator, node("actuator", F.col("variable"), r)).otherwise(node("sensor", F.col("variable"), r)), F.when(actuator, edge(id("plc", "entity"), id("actuator", "variable"), "controls")).otherwise(edge(id("plc", "entity"), id("sensor", "variable"), "reads"))))
    )
    out = df.select("detector", "confidence", "severity", "us", F.explode(made).alias("x")).select("detector", "confidence", "severity", "us", "x.*")
    return out.filter("src is not null and (kind = 'node' or dst is not null)")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Nodes: largest risk, confidence and severity, first and last seen, how often."""
    return rows.filter("kind = 'node'").groupBy(F.col("src").alias("node_id"), "type").agg(
        F.max("risk").alias("risk"), F.max("confidence").alias("confidence"), F.max_by(F.upper("severity"), severity_order(F.col("severity"))).alias("severity"),
        F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count("*").alias("observations"),
    )


def merge_edges(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """Edges: how often, first and last seen, largest risk, the first detector."""
    order = F.struct("us", "detector") if order is None else order
    return rows.filter("kind = 'edge'").groupBy("src", "dst", "type").agg(
        F.count("*").alias("occurrence_count"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.max("risk").alias("risk"), F.min_by("detector", order).alias("source_detector"),
    )


def update_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merged nodes and later merged ones as one table, as if all evidence had been merged at once."""
    both = old.unionByName(new)
    return both.groupBy("node_id", "type").agg(
        F.max("risk").alias("risk"), F.max("confidence").alias("confidence"), F.max_by(F.upper("severity"), severity_order(F.col("severity"))).alias("severity"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"),
    )


def update_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The same for edges; the first detector is that of the table that saw the edge first."""
    both = old.unionByName(new)
    return both.groupBy("src", "dst", "type").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("risk").alias("risk"),
        F.min_by("source_detector", F.struct("first_seen", "source_detector")).alias("source_detector"),
    )


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those named (src, dst, and type where `gone` has it)."""
    keys = [c for c in ("src", "dst", "type") if c in gone.columns]
    return edges.join(gone.select(keys).distinct(), keys, "left_anti").select(edges.columns)


def complete_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` (node_id, type) and those that only edges name; their type is the id's first part."""
    ends = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    new = ends.join(nodes, "node_id", "left_anti").select("node_id", F.split("node_id", ":")[0].alias("type"), F.coalesce(F.get(F.split("node_id", ":"), F.lit(1)), F.col("node_id")).alias("display_name"))
    old = nodes if "display_name" in nodes.columns else nodes.withColumn("display_name", F.coalesce(F.get(F.split("node_id", ":"), F.lit(1)), F.col("node_id")))
    return old.select("node_id", "type", "display_name").unionByName(new)


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select("node_id")
    gone = edges.join(ids, edges["src"] == ids["node_id"], "left_anti")
    return gone.unionByName(edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(ids, F.col("dst") == ids["node_id"], "left_anti"))


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch removed nodes (node_id)."""
    ids = gone.select("node_id").distinct()
    return edges.join(ids, edges["src"] == ids["node_id"], "left_anti").join(ids, F.col("dst") == ids["node_id"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) in either direction, without loops."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).filter("a != b").distinct()


def neighbours(edges: DataFrame, node: Column, direction: str = "both") -> DataFrame:
    """The ids next to a node."""
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("node_id"))
    back = edges.filter(F.col("dst") == node).select(F.col("src").alias("node_id"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree (parallel edges and loops count twice) and degree centrality of each node."""
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")).groupBy("node_id").agg(F.count("*").alias("degree"))
    total = nodes.agg(F.count("*").alias("_n"))
    out = nodes.select("node_id").join(ends, "node_id", "left").join(F.broadcast(total))
    degree = F.coalesce("degree", F.lit(0))
    return out.select("node_id", degree.alias("degree"), F.when(F.col("_n") > 1, degree / (F.col("_n") - 1)).otherwise(1.0).alias("centrality"))


def risk_bins(nodes: DataFrame) -> DataFrame:
    """Nodes by risk."""
    r = F.col("risk")
    return nodes.groupBy(F.when(r >= 0.8, "critical").when(r >= 0.5, "high").when(r >= 0.2, "medium").otherwise("low").alias("bin")).agg(F.count("*").alias("n"))


def ego(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within `depth` steps of the start nodes (node_id), in either direction, with their depth."""
    pairs = both_ways(edges)
    seen = start.select("node_id", F.lit(0).alias("depth"))
    frontier = seen
    for step in range(1, depth + 1):
        reached = frontier.join(pairs, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id")).distinct()
        frontier = reached.join(seen, "node_id", "left_anti").select("node_id", F.lit(step).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node_id)."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids, edges["src"] == ids["node_id"], "left_semi").join(ids, F.col("dst") == ids["node_id"], "left_semi")


def capped(nodes: DataFrame, most: int = 50) -> DataFrame:
    """The first nodes in breadth-first order."""
    return nodes.orderBy("depth", "node_id").limit(most)


def shortest_paths(edges: DataFrame, source: DataFrame) -> DataFrame:
    """A shortest path (undirected) from the source nodes to each reachable one: node_id, length, path.

    Of several, the smallest by its ids. The loop ends when no new node is found.
    """
    pairs = spool(both_ways(edges))
    seen = frontier = spool(source.select("node_id", F.lit(0).alias("length"), F.array("node_id").alias("path")))
    held = [seen]
    for step in numbers(1):
        reached = frontier.join(pairs, F.col("node_id") == F.col("a")).select(F.col("b").alias("node_id"), F.concat("path", F.array("b")).alias("path"))
        frontier = spool(reached.join(seen.select("node_id"), "node_id", "left_anti").groupBy("node_id").agg(F.min("path").alias("path")).select("node_id", F.lit(step).alias("length"), "path"))
        held.append(frontier)
        if frontier.isEmpty():
            unspool(pairs, frontier)
            return seen
        seen = seen.unionByName(frontier)
        if step % ROUNDS == 0:
            seen = spool(seen)
            unspool(*held[:-1])
            held = [held[-1], seen]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components: node_id and the component's smallest node id."""
    pairs = spool(both_ways(edges))
    labels = spool(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = pairs.join(labels, F.col("b") == F.col("node_id")).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, F.col("node_id") == F.col("a"), "left").select("node_id", F.least("component", F.coalesce("m", "component")).alias("component"), "component")
        new = new.toDF("node_id", "component", "old")
        # A label's own label: chains are halved each round.
        tops = new.select(F.col("node_id").alias("t"), F.col("component").alias("top"))
        new = spool(new.join(tops, F.col("component") == F.col("t"), "left").select("node_id", F.least("component", F.coalesce("top", "component")).alias("component"), "old"))
        unspool(labels)
        if new.filter("component != old").isEmpty():
            unspool(pairs)
            return new.select("node_id", "component")
        labels = new.select("node_id", "component")
        labels.spooled = new.spooled


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """PageRank on distinct directed pairs; dangling nodes' rank is spread over all.

    Converged when the ranks of a round differ from those before by less than `tolerance` a node, summed; where
    `rounds` rounds don't suffice, ValueError.
    """
    n = nodes.count()
    out = edges.select("src", "dst").distinct()
    links = spool(out.join(out.groupBy("src").agg(F.count("*").alias("out")), "src"))
    ends = links.select(F.col("src").alias("node_id")).distinct().withColumn("_links", F.lit(True))
    ranks = spool(nodes.select("node_id", F.lit(1.0 / max(n, 1)).alias("rank")).join(ends, "node_id", "left").select("node_id", "rank", F.col("_links").isNull().alias("dangles")))
    spread = F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0))
    dangling = ranks.agg(spread).first()[0]
    for _ in range(rounds):
        got = links.join(ranks, F.col("src") == F.col("node_id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("in"))
        rank = (1 - alpha) / n + alpha * (F.coalesce("in", F.lit(0.0)) + dangling / n)
        new = spool(ranks.join(got, F.col("node_id") == F.col("dst"), "left").select("node_id", rank.alias("rank"), "dangles", F.col("rank").alias("old")))
        unspool(ranks)
        dangling, away = new.agg(spread, F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()
        ranks = new.select("node_id", "rank", "dangles")
        ranks.spooled = new.spooled
        if away < n * tolerance or not n:
            unspool(links)
            return ranks.drop("dangles")
    raise ValueError(f"ranks still differ by {away} after {rounds} rounds")


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a loop's join: by a shuffle, as broadcasts of every round would add up on the driver."""
    return df.hint("merge")


def numbered_links(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes (node_id, v: a number) and distinct links (a, b: numbers) between them, written."""
    ids = spool(nodes.select("node_id").filter("node_id is not null").distinct().withColumn("v", F.monotonically_increasing_id()))
    ends = lambda name: ids.select(F.col("node_id").alias("_id"), F.col("v").alias(name))
    pairs = edges.select("src", "dst").distinct().join(_dealt(ends("a")), F.col("src") == F.col("_id")).drop("_id").join(_dealt(ends("b")), F.col("dst") == F.col("_id")).drop("_id")
    return ids, spool(pairs.select("a", "b").filter("a != b").distinct())


#: Pairs of a source and a node that one round of `centrality` may hold, so bounded disk.
PAIRS = 1_000_000_000


def sources_for(nodes: int, error: float, sure: float = 0.99) -> int:
    """Sources to draw so that, with the chance `sure`, no node's normalised betweenness is off by more than
    `error`: by Hoeffding's bound over all nodes, as a source adds between 0 and 1 to a node's mean."""
    return nodes if error <= 0 else min(nodes, math.ceil(math.log(2 * nodes / (1 - sure)) / (2 * error**2)))


def centrality(nodes: DataFrame, edges: DataFrame, error: float = 0.0, pairs: int = PAIRS) -> DataFrame:
    """Betweenness and closeness of all nodes: node_id, betweenness, closeness.

    Directed; betweenness is normalised by (n - 1)(n - 2); closeness is by incoming distance, scaled by
    the share of nodes that reach the node. Searches go from many sources at once, a level a round: rows
    (source, node) carry the number of shortest paths forwards, and what depends on a node
    backwards, so each round is a join with the links and an aggregation, and no task holds the graph.
    Nodes without a link of their own reach nothing, so they are not searched from. Sources are taken in
    batches of at most `pairs` possible rows; a batch's tables are freed when it is done. With an `error` over 0 only `sources_for` of that error are searched from, chosen by
    hash of their id, and closeness is an estimate from these.
    """
    ids, links = numbered_links(nodes, edges)
    n = ids.count()
    drawn = sources_for(n, error)
    chosen = ids.select(F.col("v").alias("s")) if drawn == n else ids.orderBy(F.xxhash64("node_id"), "node_id").limit(drawn).select(F.col("v").alias("s"))
    chosen = spool(chosen.join(links.select(F.col("a").alias("s")).distinct(), "s", "left_semi"))
    batches = max(1, -(-chosen.count() * links.agg(F.count_distinct("b")).first()[0] // pairs))
    sums = [_dependencies(chosen if batches == 1 else chosen.filter(F.pmod(F.xxhash64("s"), F.lit(batches)) == b), links) for b in range(batches)]
    total = reduce(DataFrame.unionByName, sums).groupBy("v").agg(F.sum("b").alias("b"), F.sum("r").alias("r"), F.sum("f").alias("f"))
    scale = (n / drawn if drawn else 1.0) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    r, f = (F.coalesce(c, F.lit(0)) * (n / drawn if drawn else 1.0) for c in ("r", "f"))
    r, f = (F.coalesce("r", F.lit(0)), F.coalesce("f", F.lit(0))) if drawn == n else (r, f)
    close = F.when(f > 0, r / f * r / max(n - 1, 1)).otherwise(0.0)
    return ids.join(total, "v", "left").select("node_id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"), close.alias("closeness"))


def _dependencies(chosen: DataFrame, links: DataFrame) -> DataFrame:
    """What searches from the chosen nodes (s) add: v, b (dependencies), r (sources that reach v), f (their distances), written."""
    levels = [spool(chosen.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    seen, held = levels[0].select("s", "v"), []
    while True:
        reached = levels[-1].join(links, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        level = spool(reached.join(seen, ["s", "v"], "left_anti"))
        if level.isEmpty():
            unspool(level)
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
        if len(levels) % ROUNDS == 0:
            seen = spool(seen)
            held.append(seen)
    parts, later = [], None
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        if later is None:
            level = level.withColumn("d", F.lit(0.0))
        else:
            # A link from this level to the next one is on shortest paths: its end was found from here.
            share = links.join(later.select("s", F.col("v").alias("b"), F.col("paths").alias("_p"), F.col("d").alias("_d")), "b").select("s", F.col("a").alias("v"), ((1 + F.col("_d")) / F.col("_p")).alias("_x"))
            share = share.join(level, ["s", "v"]).groupBy("s", "v").agg(F.sum("_x").alias("_x"))
            level = spool(level.join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce(F.col("_x") * F.col("paths"), F.lit(0.0)).alias("d")))
            held.append(level)
        parts.append(level.groupBy("v").agg(F.sum("d").alias("b"), F.count("*").alias("r"), (F.count("*") * depth).alias("f")))
        later = level
    none = chosen.select(F.col("s").alias("v"), F.lit(0.0).alias("b"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("f")).limit(0)
    out = spool(reduce(DataFrame.unionByName, parts, none).groupBy("v").agg(F.sum("b").alias("b"), F.sum("r").alias("r"), F.sum("f").alias("f")))
    unspool(*levels, *held)
    return out


#: Share of nodes that may move in a round at first, and the least; gains of a move and of a round that count.
MOVING, LEAST_MOVING, GAIN, RAISED = 0.5, 1 / 64, 1e-9, 1e-6


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities by local moves that raise modularity, then contraction, again and again: node_id, community
    (its smallest node id).

    The graph is taken as undirected and simple. In a round every node's weight to each neighbouring community
    is summed by a join, and nodes move to where modularity gains most. As moves at the same time can spoil
    each other, a hash lets only a share of the nodes move in a round; a round that did not raise modularity (by
    `RAISED`) is taken back and the share halved; when it is small, the best move of all is made alone. Once that
    gains nothing either, communities become nodes and their links are summed. It ends when a level joins
    nothing. All state is in tables; totals alone reach the driver. Nodes without links are
    communities of their own.
    """
    ids, links = numbered_links(nodes, edges)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = spool(both.withColumn("w", F.lit(1.0)))
    unspool(links)
    of = ids.select("node_id", F.col("v").alias("c"))
    loops = ids.select("v", F.lit(0.0).alias("loop"))
    total = near.agg(F.sum("w")).first()[0] or 0.0
    while total:
        degree = near.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k"))
        start = loops.join(_dealt(degree), "v", "left").select("v", "loop", (F.coalesce("k", F.lit(0.0)) + F.col("loop")).alias("k"), F.col("v").alias("c"))
        moved = _local_moves(start, near, total)
        if moved is None:
            break
        own = moved.select("v", "c")
        of = spool(of.withColumnRenamed("c", "v").join(_dealt(own), "v").select("node_id", "c"))
        ends = near.join(_dealt(own.select(F.col("v").alias("a"), F.col("c").alias("ca"))), "a").join(_dealt(own.select(F.col("v").alias("b"), F.col("c").alias("cb"))), "b")
        joined = spool(ends.groupBy("ca", "cb").agg(F.sum("w").alias("w")))
        inside = joined.filter("ca = cb").select(F.col("ca").alias("v"), "w").unionByName(moved.select(F.col("c").alias("v"), F.col("loop").alias("w")))
        loops = spool(inside.groupBy("v").agg(F.sum("w").alias("loop")))
        unspool(near, moved)
        near = joined.filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w")
        near.spooled = joined.spooled
    return of.join(_dealt(of.groupBy("c").agg(F.min("node_id").alias("community"))), "c").select("node_id", "community")


def _local_moves(start: DataFrame, near: DataFrame, total: float) -> DataFrame | None:
    """Nodes (v, loop, k, c) after moves that raise modularity; None if none does."""
    state, best, high, first, share, movers = spool(start), None, None, True, MOVING, 0
    for turn in numbers():
        sums = state.groupBy("c").agg(F.sum("k").alias("sum"))
        weights = near.join(_dealt(state.select(F.col("v").alias("b"), "c")), "b").groupBy(F.col("a").alias("v"), F.col("c").alias("to")).agg(F.sum("w").alias("w"))
        asked = weights.join(_dealt(state.select("v", "k", "c")), "v").join(_dealt(sums.select(F.col("c").alias("to"), F.col("sum").alias("to_sum"))), "to")
        here, worth = F.col("to") == F.col("c"), F.col("w") - F.col("k") * F.col("to_sum") / total
        found = asked.groupBy("v").agg(F.max(F.when(~here, F.struct(worth.alias("g"), (-F.col("to")).alias("to")))).alias("_best"), F.max(F.when(here, F.col("w"))).alias("own"))
        told = state.select("v", "loop", "k", "c").join(_dealt(found), "v", "left").join(_dealt(sums), "c")
        stay = F.coalesce("own", F.lit(0.0)) - F.col("k") * (F.col("sum") - F.col("k")) / total
        table = spool(told.select("v", "loop", "k", "c", F.coalesce("own", F.lit(0.0)).alias("own"), (F.col("_best.g") - stay).alias("gain"), (-F.col("_best.to")).alias("to")))
        unspool(state)
        spread = table.groupBy("c").agg(F.sum("k").alias("s"), F.sum(F.col("own") + F.col("loop")).alias("i"), F.count_if(F.col("gain") > GAIN).alias("n"))
        now, n = spread.agg(F.sum(F.col("i") / total - (F.col("s") / total) * (F.col("s") / total)), F.sum("n")).first()
        if high is None or now > high + RAISED:
            first = high is None
            unspool(*([] if first else [best]))
            best, high, movers, share = table, now, n, min(MOVING, 2 * max(share, LEAST_MOVING))
        else:
            unspool(table)
            share = share / 2 if share > 0 else None
        if not movers or share is None:
            unspool(*([best] if first else []))
            return None if first else best
        if share < LEAST_MOVING:  # one node alone
            share = 0
            one = best.agg(F.max_by("v", F.struct("gain", -F.col("v")))).first()[0]
            chosen = F.col("v") == one
        else:
            chosen = (F.col("gain") > GAIN) & (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 20)) < int(share * (1 << 20)))
        state = best.select("v", "loop", "k", F.when(chosen, F.col("to")).otherwise(F.col("c")).alias("c"))


def validate(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """What is wrong with a graph, counted: unknown types, orphan edges, missing times."""
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    out = count(nodes.filter(~F.col("type").isin(kinds)), "unknown type").unionByName(count(orphan_edges(edges, nodes), "orphan edge"))
    return out.unionByName(count(nodes.filter("first_seen is null or last_seen is null"), "missing time"))


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Nodes of a type, whatever its case."""
    return nodes.filter(F.lower("type") == kind.lower())


def by_risk(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """Nodes from a risk on, highest first, ties by id. The filter is first, so only those are sorted."""
    return nodes.filter(F.col("risk") >= least).orderBy(F.desc("risk"), "node_id")


def by_detector(edges: DataFrame, detector: str) -> DataFrame:
    """Edges that a detector established, whatever its case."""
    return edges.filter(F.upper("source_detector") == detector.upper())


def recent(nodes: DataFrame, edges: DataFrame, now_us: Column, minutes: int = 10) -> DataFrame:
    """Nodes and edges seen in the last minutes: kind, id (or src > dst by type), last_seen; newest first.

    What lies after `now_us` counts as recent, as it is no older than the window.
    """
    since = F.col("last_seen") >= now_us - minutes * 60_000_000
    n = nodes.filter(since).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), "last_seen")
    e = edges.filter(since).select(F.lit("edge").alias("kind"), F.format_string("%s > %s (%s)", "src", "dst", "type").alias("id"), "last_seen")
    return n.unionByName(e).orderBy(F.desc("last_seen"), "kind", "id")


def indexes(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The lookups of a loaded graph, as tables sorted for pruning: nodes by risk and by type, edges by
    detector, and all by time. Written by `sinks.write_sorted`, their files' statistics are the index."""
    by_time = nodes.select(F.lit("node").alias("kind"), F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), "last_seen")
    by_time = by_time.unionByName(edges.select(F.lit("edge").alias("kind"), "src", "dst", "last_seen"))
    return {"risk": nodes.select("risk", "node_id"), "type": nodes.select("type", "node_id"), "detector": edges.select(F.upper("source_detector").alias("detector"), "src", "dst", "type"), "time": by_time}


def attack_chain(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` steps of the start, and the lines (us, description, risk) of the edges among
    them, by time."""
    near = ego(edges, start.join(nodes.select("node_id"), "node_id", "left_semi"), depth)
    lines = induced(edges, near).select(F.col("last_seen").alias("us"), F.format_string("%s --[%s]--> %s", "src", "type", "dst").alias("description"), "risk")
    return nodes.join(near, "node_id"), lines.orderBy("us", "description")


def topology(nodes: DataFrame, edges: DataFrame, most_nodes: int = 80, most_edges: int = 140, top: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a dashboard draws: the first nodes (id, criticality), the edges among them out of the first
    `most_edges`, and the `top` nodes by criticality as the attack path (a view's own limits)."""
    shown = nodes.orderBy("id").limit(most_nodes)
    links = edges.select("src", "dst").distinct().orderBy("src", "dst").limit(most_edges).filter("src != dst")
    ids = shown.select(F.col("id").alias("node_id"))
    path = shown.orderBy(F.desc("criticality"), "id").limit(top)
    return shown, induced(links, ids), path


#: Buckets of the knowledge graph's node types (fixed values).
CATEGORIES = {"group": "groups", "malware": "software", "tool": "software", "mitigation": "mitigations", "campaign": "campaigns", "tactic": "tactics", "sub-technique": "subtechniques"}


def categories(walked: DataFrame, nodes: DataFrame) -> DataFrame:
    """What `attack_neighbourhood` found, by category: start, category, and the entities (depth, id, name,
    relation, confidence, path), nearest first. A technique that a sub-technique belongs to is its parent;
    other techniques are in no category."""
    kind = F.col("type")
    bucket = F.lit(None).cast("string")
    for k, c in CATEGORIES.items():
        bucket = F.when(kind == k, c).otherwise(bucket)
    bucket = F.when((kind == "technique") & (F.col("relation") == "subtechnique-of"), "parent_technique").otherwise(bucket)
    known = nodes.select(F.col("node_id").alias("node"), "external_id", "name", "type")
    item = F.struct("depth", F.col("external_id").alias("id"), "name", "relation", F.bround(F.greatest(F.lit(0.1), 1 - 0.2 * F.col("depth")), 2).alias("confidence"), "path")
    return walked.join(known, "node").withColumn("category", bucket).filter("category is not null").groupBy("start", "category").agg(F.array_sort(F.collect_list(item)).alias("entities"))


def attack_neighbourhood(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Knowledge-graph walk of two steps both ways: label (reverse- against the arrow), depth, path.

    `edges`: src, dst, relation; `start`: node_id.
    """
    steps = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.concat(F.lit("reverse-"), "relation").alias("relation")))
    one = start.join(steps, F.col("node_id") == F.col("a")).select(F.col("node_id").alias("start"), F.col("b").alias("node"), "relation", F.lit(1).alias("depth"), F.array("node_id", "b").alias("path"))
    two = one.alias("o").join(steps.alias("s"), F.col("o.node") == F.col("s.a")).filter("s.b != o.start").select("o.start", F.col("s.b").alias("node"), "s.relation", F.lit(2).alias("depth"), F.concat("o.path", F.array("s.b")).alias("path"))
    place = Window.partitionBy("start", "node").orderBy("depth", F.array_join("path", ">"), "relation")
    return one.unionByName(two).withColumn("_p", F.row_number().over(place)).filter("_p = 1").drop("_p")


def blast_radius(edges: DataFrame, start: DataFrame) -> DataFrame:
    """How many nodes each start node reaches along edges, however far; a cycle back counts the node itself."""
    steps = spool(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    frontier = seen = spool(start.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).join(steps, F.col("at") == F.col("a")).select("start", F.col("b").alias("at")).distinct())
    for step in numbers(1):
        reached = frontier.join(steps, F.col("at") == F.col("a")).select("start", F.col("b").alias("at")).distinct()
        frontier = spool(reached.join(seen, ["start", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if step % ROUNDS else spool(seen)
    counts = seen.groupBy("start").agg(F.count("*").alias("reachable"))
    return start.select("node_id").join(counts, F.col("node_id") == F.col("start"), "left").select("node_id", F.coalesce("reachable", F.lit(0)).alias("reachable"))
