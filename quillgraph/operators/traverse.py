"""Recursive operators: impact paths, flows, entry points, traces."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut
from quillgraph.workers import workers_import


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """All trails (no edge twice) of 1..depth hops from the nodes (column id): nodes, and depth.

    One equi-join a hop, unrolled: each step joins the frontier on its last
    node only, so a plan of ``depth`` joins is all there is and nothing is
    collected.  A trail carries its nodes; an edge is a pair of neighbours, so
    a repeated edge is one whose pair is in the trail already.
    """
    steps = edges.select("src", "dst").distinct()
    frontier = starts.select("id").distinct().select(F.array("id").alias("nodes"), F.col("id").alias("last"))
    levels = []
    for hop in range(1, depth + 1):
        joined = frontier.join(steps, frontier.last == steps.src)
        used = F.exists(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: (F.element_at("nodes", i) == F.col("src")) & (F.element_at("nodes", i + 1) == F.col("dst"))) if hop > 1 else F.lit(False)
        frontier = joined.where(~used).select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("last"))
        levels.append(frontier.withColumn("depth", F.lit(hop)))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("nodes", "last", "depth")


def impact(edges: DataFrame, starts: DataFrame, depth: int = 3, least: float = 0.0, direction: str = "out") -> DataFrame:
    """Rows (source, target, depth) of every trail over edges with enough confidence; ``in`` follows them backwards."""
    kept = edges.where(F.coalesce("confidence", F.lit(1.0)) >= least)
    if direction == "in":
        kept = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return paths(kept, starts, depth).select(F.element_at("nodes", 1).alias("source"), F.col("last").alias("target"), "depth")


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes reached and their least depth: a frontier that never visits a node twice, for graphs with too many trails.

    Each hop's frontier is cut, as both the next frontier and what was seen depend on it.
    """
    steps = edges.select("src", "dst").distinct()
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen.select("id")
    for hop in range(1, depth + 1):
        frontier = cut(frontier.join(steps, frontier.id == steps.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(hop)))
    return seen.where("depth > 0")


#: Trails that a hop keeps at first, and how many times more when they turn out too few.
WIDTH, WIDER = 256, 16


def _reaching(steps: DataFrame, ends: DataFrame, depth: int) -> DataFrame:
    """(id, left): from the node a walk of ``left`` hops, 0..depth, leads to one of the ends."""
    level = ends.select("id").distinct()
    found = level.withColumn("left", F.lit(0))
    for hop in range(1, depth + 1):
        level = cut(steps.join(level, steps.dst == level.id).select(F.col("src").alias("id")).distinct())
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("left", F.lit(hop)))
    return cut(found)


def _first_trails(steps: DataFrame, starts: DataFrame, reaching: DataFrame, hops: int, limit: int) -> DataFrame:
    """The first ``limit`` trails, in order of their nodes, of exactly that many hops from a start to an end.

    A hop extends trails only to nodes from which an end is as many hops away as
    are left, and keeps the first ``width`` in order.  Whatever comes from a
    dropped trail is behind all that comes from the kept ones, so ``limit``
    whole trails are the first ones; with fewer, and something dropped (each
    hop's rows are observed as it runs), the hops are done again with a larger
    width.
    """
    width = max(WIDTH, limit)
    while True:
        frontier = starts.join(reaching.where(F.col("left") == hops), "id", "left_semi").select(F.array("id").alias("nodes"), F.col("id").alias("last"))
        seen = []
        for hop in range(hops + 1):
            if hop:
                target = reaching.where(F.col("left") == hops - hop).select(F.col("id").alias("dst"))
                used = F.exists(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: (F.element_at("nodes", i) == F.col("src")) & (F.element_at("nodes", i + 1) == F.col("dst"))) if hop > 1 else F.lit(False)
                frontier = frontier.join(steps, frontier.last == steps.src).join(target, "dst", "left_semi").where(~used).select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("last"))
            if hop < hops:
                seen.append(Observation())
                frontier = frontier.observe(seen[-1], F.count(F.lit(1)).alias("n")).orderBy("nodes").limit(width)
        found = cut(frontier.where(F.element_at("nodes", 1) != F.col("last")).orderBy("nodes").limit(limit).select("nodes", F.lit(hops).alias("depth")))
        if found.count() == limit or all(o.get["n"] <= width for o in seen):
            return found
        width *= WIDER


def flows(edges: DataFrame, starts: DataFrame, depth: int = 10, limit: int = 5, backward: bool = False) -> DataFrame:
    """The longest trails (no edge twice, at most ``depth`` hops) from the starts to nodes without outgoing calls, the first by their nodes on ties: steps and depth.

    Backward: the longest to the starts from nodes without incoming calls.  The
    trails aren't all made: lengths are tried from the longest down, each
    building only what can still be among its first ones (``_first_trails``).
    """
    steps = cut(edges.select("src", "dst").distinct())
    bound = lambda c, other: steps.select(F.col(c).alias("id")).distinct().join(steps.select(F.col(other).alias("id")), "id", "left_anti")
    own = starts.select("id").distinct()
    first, last = (cut(bound("src", "dst")), own) if backward else (own, cut(bound("dst", "src")))
    reaching = _reaching(steps, last, depth)
    # Where no walk of a length starts, no trail does.
    lengths = [r.left for r in reaching.where("left > 0").join(first, "id", "left_semi").select("left").distinct().orderBy(F.desc("left")).collect()]
    found, missing = [], limit
    for hops in lengths:
        trails = _first_trails(steps, first, reaching, hops, missing)
        found.append(trails)
        missing -= trails.count()
        if missing <= 0:
            break
    if not found:
        return steps.select(F.array("src").alias("steps"), F.lit(0).alias("depth")).limit(0)
    return reduce(DataFrame.unionByName, found).select(F.col("nodes").alias("steps"), "depth").orderBy(F.desc("depth"), "steps").limit(limit)


def entry_points(functions: DataFrame, edges: DataFrame, limit: int = 30, strict: bool = False) -> DataFrame:
    """Functions with calls out and at most one in, by outgoing - incoming / 2.

    A function without a call counts as having one, as an optional match does;
    ``strict`` counts what there is.
    """
    least = 0 if strict else 1
    count = lambda end: edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out, into = count("src").withColumnRenamed("n", "out_n"), count("dst").withColumnRenamed("n", "in_n")
    rows = functions.join(out, "id", "left").join(into, "id", "left")
    rows = rows.withColumn("outgoing", F.greatest(F.coalesce("out_n", F.lit(0)), F.lit(least))).withColumn("incoming", F.greatest(F.coalesce("in_n", F.lit(0)), F.lit(least)))
    scored = rows.where("outgoing > 0 AND incoming <= 1").withColumn("score", F.col("outgoing") - 0.5 * F.col("incoming"))
    return scored.orderBy(F.desc("score"), "id").limit(limit).select("id", "outgoing", "incoming", "score")


def trace_paths(adjacency: dict, entry, fanout: int = 3, depth: int = 10, most: int = 4) -> list[list]:
    """Breadth-first traces from an entry: the first callees of a node are followed, no node twice, up to ``most`` traces, longest first."""
    seen, queue, done = {entry}, [[entry]], []
    while queue and len(done) < most:
        trail = queue.pop(0)
        nexts = [n for n in adjacency.get(trail[-1], ()) if n not in seen and n != trail[-1]][:fanout]
        if not nexts or len(trail) >= depth:
            if len(trail) > 1:
                done.append(trail)
            continue
        for n in nexts:
            seen.add(n)
            queue.append([*trail, n])
    done += [t for t in queue if len(t) > 1][: max(0, most - len(done))]
    return sorted(done, key=lambda t: (-len(t), t))


def _walk(fanout: int, depth: int, most: int):
    """One level of ``trace_paths`` for an entry: its trails in order, with the callees that no earlier level has seen."""

    def walk(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        done, new, out = rows.column("finished")[0].as_py(), set(), []
        for trail, nexts in zip(rows.column("trail").to_pylist(), rows.column("nexts").to_pylist(), strict=True):
            if done >= most:
                break
            follow = [n for n in nexts or () if n not in new][:fanout] if len(trail) < depth else []
            new.update(follow)
            out += [([*trail, n], False) for n in follow]
            if not follow and len(trail) > 1:
                out.append((trail, True))
                done += 1
        entry, kind = rows.column("entry"), rows.schema.field("trail").type
        trails, ended = ([t for t, _ in out], [e for _, e in out])
        return pa.table({"entry": pa.array([entry[0].as_py()] * len(out), entry.type), "pos": pa.array(range(len(out)), pa.int32()), "trail": pa.array(trails, kind), "finished": pa.array([done] * len(out), pa.int32()), "ended": pa.array(ended, pa.bool_())})

    return walk


def traces(edges: DataFrame, entries: DataFrame, fanout: int = 3, fetch: int = 10, depth: int = 10, most: int = 4) -> DataFrame:
    """(entry, trace, steps) for each of the entries' traces.

    A breadth-first walk goes level by level.  The trails of a level meet the
    ``fetch`` first callees of their last nodes, less those seen at earlier
    levels, by joins; only the order-dependent choice among them runs in Python,
    on the trails of one entry, of which a level has ``fanout`` times as many as
    the one before at most, however large the graph is.
    """
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))  # a hub's callees are cut to the first ones before they are gathered
    first = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("place", place).where(F.col("place") <= fetch))
    kind = dict(entries.dtypes)["id"]
    workers_import(edges.sparkSession)
    level = cut(entries.select(F.col("id").alias("entry")).distinct().select("entry", F.lit(0).alias("pos"), F.array("entry").alias("trail"), F.lit(0).alias("finished")))
    seen = level.select("entry", F.col("entry").alias("node"))
    found = []
    for _ in range(depth):
        asked = level.select("entry", "pos", F.element_at("trail", -1).alias("src")).join(first, "src").select("entry", "pos", "place", F.col("dst").alias("node"))
        fresh = asked.join(seen, ["entry", "node"], "left_anti").groupBy("entry", "pos").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("c"))
        rows = level.join(fresh.select("entry", "pos", F.transform("c", lambda x: x["node"]).alias("nexts")), ["entry", "pos"], "left")
        walked = cut(rows.select("entry", "pos", "trail", "finished", "nexts").groupBy("entry").applyInArrow(_walk(fanout, depth, most), f"entry {kind}, pos int, trail array<{kind}>, finished int, ended boolean"))
        found.append(walked.where("ended").select("entry", F.col("trail").alias("steps")))
        level = walked.where(~F.col("ended") & (F.col("finished") < most)).drop("ended")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("entry", F.element_at("trail", -1).alias("node")))
    number = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc(F.size("steps")), "steps")) - 1
    return reduce(DataFrame.unionByName, found).select("entry", number.alias("trace"), "steps")


def processes(found: DataFrame) -> DataFrame:
    """STEP_IN_PROCESS rows of each entry's longest trace: process, step from 0, node."""
    longest = found.where("trace = 0")
    return longest.select(F.col("entry").alias("process"), F.posexplode("steps").alias("step", "node"))
