"""Communities of functions over weighted undirected calls."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.lineage import cut
from quillgraph.workers import workers_import

MIN_EDGES = 5
#: Links of a service up to which a task moves its nodes one by one; it holds about 100 bytes for each.
LOCAL_LINKS = 100_000


def undirected(edges: DataFrame) -> DataFrame:
    """(service, a, b, weight): one row a pair, self-calls left out; the weight is that of a->b, else of b->a."""
    pair = edges.where("src <> dst").select("service", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("confidence", F.lit(0.7)).alias("weight"), (F.col("src") < F.col("dst")).alias("forward"))
    return pair.groupBy("service", "a", "b").agg(F.max_by("weight", F.struct("forward", "weight")).alias("weight"))


def louvain(links: list[tuple], resolution: float = 1.0) -> dict:
    """The same on one machine, node by node, for graphs of bounded size: local moves in the order of the nodes, then merging of communities, until nothing improves."""
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    place = {n: i for i, n in enumerate(nodes)}
    graph: list[dict[int, float]] = [{} for _ in nodes]
    for a, b, w in links:
        i, j = place[a], place[b]
        graph[i][j] = graph[i].get(j, 0.0) + w
        if i != j:
            graph[j][i] = graph[j].get(i, 0.0) + w
    member = list(range(len(nodes)))
    total = sum(w for a, b, w in links) * 2
    while True:
        # A node's weight to itself counts twice in its degree.
        degree = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        label, volume = list(range(len(graph))), list(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for i, g in enumerate(graph):
                near: dict[int, float] = {}
                for j, w in g.items():
                    if j != i:
                        near[label[j]] = near.get(label[j], 0.0) + w
                own = label[i]
                volume[own] -= degree[i]
                gain = lambda c: near.get(c, 0.0) - resolution * degree[i] * volume[c] / total  # noqa: B023, E731
                best, most = own, gain(own)
                for c in sorted(near):
                    if gain(c) > most + 1e-12:
                        best, most = c, gain(c)
                volume[best] += degree[i]
                if best != own:
                    label[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        compact = {c: k for k, c in enumerate(sorted(set(label)))}
        member = [compact[label[m]] for m in member]
        merged: list[dict[int, float]] = [{} for _ in compact]
        for i, g in enumerate(graph):
            for j, w in g.items():
                if i <= j:
                    a, b = sorted((compact[label[i]], compact[label[j]]))
                    merged[a][b] = merged[a].get(b, 0.0) + w
        for i, g in enumerate(merged):
            for j, w in list(g.items()):
                if i < j:
                    merged[j][i] = w
        graph = merged
    order: dict[int, int] = {}
    return {n: order.setdefault(member[i], len(order)) for i, n in enumerate(nodes)}


def modularity(links: list[tuple], label: dict) -> float:
    total = sum(w for *_, w in links)
    inside = sum(w for a, b, w in links if label[a] == label[b])
    volume: dict = {}
    for a, b, w in links:
        for x in (a, b):
            volume[label[x]] = volume.get(label[x], 0.0) + w
    return inside / total - sum(v * v for v in volume.values()) / (4 * total * total)


def _best_moves(links: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    """(service, node, label, degree, aim): the community, its own or a neighbour's, that adds most to the modularity; ties go to the smallest.

    state: service, node, label, degree.  The gain of a community is the weight
    of the node's links into it less degree * volume / total, the node's own
    degree left out of its volume.
    """
    volume = state.groupBy("service", "label").agg(F.sum("degree").alias("volume"))
    around = links.where("a <> b").join(state.select("service", F.col("node").alias("b"), "label"), ["service", "b"]).groupBy("service", F.col("a").alias("node"), "label").agg(F.sum("weight").alias("near"))
    own = state.select("service", "node", "label", F.lit(0.0).alias("near"))
    offers = around.unionByName(own).groupBy("service", "node", F.col("label").alias("aim")).agg(F.sum("near").alias("near"))
    met = offers.join(volume.withColumnRenamed("label", "aim"), ["service", "aim"]).join(state, ["service", "node"]).join(totals, "service")
    here = F.col("aim") == F.col("label")
    gain = F.round(F.col("near") - F.col("degree") * (F.col("volume") - F.when(here, F.col("degree")).otherwise(0.0)) / F.col("total"), 9)
    best = met.groupBy("service", "node").agg(F.first("label").alias("label"), F.first("degree").alias("degree"), F.max_by("aim", F.struct(gain.alias("gain"), here.alias("stays"), F.negative("aim").alias("least"))).alias("aim"))
    return best


#: A level ends when a round moves no more than this share of its nodes, or after so many rounds.
STILL, ROUNDS = 0.01, 12


def _moved(links: DataFrame, state: DataFrame, totals: DataFrame, round_: int) -> DataFrame:
    """One round: nodes that want to move do, if no neighbour of theirs that wants to comes before them.

    The order is a hash of the node and the round, so a node's neighbours stay
    while it moves, and every node comes first among its own in some round.
    """
    wishes = _best_moves(links, state, totals).withColumn("turn", F.xxhash64("service", "node", F.lit(round_)))
    wanting = wishes.withColumn("wants", F.col("aim") != F.col("label")).persist()  # read twice below; lost parts are made again from the cut state
    movers = wanting.where("wants").select("service", F.col("node").alias("b"), F.col("turn").alias("other"))
    before = links.where("a <> b").join(movers, ["service", "b"]).groupBy("service", F.col("a").alias("node")).agg(F.min("other").alias("other"))
    joined = wanting.join(before, ["service", "node"], "left")
    goes = F.col("wants") & (F.col("other").isNull() | (F.col("turn") < F.col("other")))
    after = cut(joined.select("service", "node", F.when(goes, F.col("aim")).otherwise(F.col("label")).alias("label"), "degree", F.col("label").alias("old")))
    wanting.unpersist()
    return after


def _modularity(links: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    """(service, quality) of a state; links in both directions, a loop once with its weight doubled."""
    side = lambda c: state.select("service", F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    inside = links.join(side("a"), ["service", "a"]).join(side("b"), ["service", "b"]).where("label_a = label_b").groupBy("service").agg(F.sum("weight").alias("inside"))
    squares = state.groupBy("service", "label").agg(F.sum("degree").alias("volume")).groupBy("service").agg(F.sum(F.col("volume") * F.col("volume")).alias("squares"))
    return squares.join(inside, "service", "left").join(totals, "service").select("service", (F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("quality"))


def _settled(table: pa.Table) -> pa.Table:
    """service, node and label of a service's links (a <= b, a loop with its weight doubled)."""
    a, b, weight = (table.column(c).to_numpy() for c in ("a", "b", "weight"))
    order = np.lexsort((b, a))
    label = louvain(list(zip(a[order].tolist(), b[order].tolist(), np.where(a == b, weight / 2, weight)[order].tolist(), strict=True)))
    return pa.table({"service": pa.array([table.column("service")[0].as_py()] * len(label), table.schema.field("service").type), "node": pa.array(label.keys(), pa.int64()), "label": pa.array(label.values(), pa.int64())})


def distributed_louvain(edges: DataFrame, levels: int = 10, rounds: int = ROUNDS, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(service, node, label): modularity optimisation by joins over all services at once.

    A service that has, or at some level is left with, ``local_links`` links or
    fewer is settled node by node in a task of its own (``louvain``), which
    takes one job in place of several a round.  The others go on by joins.

    A level moves nodes in rounds until hardly any moves (``STILL``, at most
    ``rounds``), and then makes each community a node whose links are the sums of its members';
    the next level works on that smaller table, until no node moves.  A level
    that doesn't raise a service's modularity, as moves of the same round into
    one community aren't seen by each other, is not taken there.  What a task
    holds are partial sums: a node with many links is joined and summed, never
    gathered.  Labels are places of nodes in the order of ids.
    """
    pairs = undirected(edges)
    names = cut(pairs.select("service", F.explode(F.array("a", "b")).alias("name")).distinct().withColumn("node", F.xxhash64("service", "name")))
    at = lambda c: names.select("service", F.col("name").alias(c), F.col("node").alias(f"{c}_node"))
    coded = pairs.join(at("a"), ["service", "a"]).join(at("b"), ["service", "b"]).select("service", F.col("a_node").alias("a"), F.col("b_node").alias("b"), "weight")
    links = cut(coded.unionByName(coded.select("service", F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    totals = cut(links.groupBy("service").agg(F.sum("weight").alias("total")))
    member = names.select("service", "name", F.col("node").alias("label"))
    workers_import(edges.sparkSession)
    done = []
    for level in range(levels):
        sizes = links.where("a <= b").groupBy("service").agg((F.count(F.lit(1)) <= local_links).alias("small"))
        small = cut(sizes.where("small").select("service"))
        if level == 0 or not small.isEmpty():
            settled = links.where("a <= b").join(F.broadcast(small), "service", "left_semi").select("service", "a", "b", "weight").groupBy("service").applyInArrow(_settled, "service string, node long, label long")
            done.append(member.withColumnRenamed("label", "node").join(settled, ["service", "node"]).select("service", "name", "label"))
            links, member = (x.join(F.broadcast(small), "service", "left_anti") for x in (links, member))
        if links.isEmpty():
            break
        degree = links.groupBy("service", F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
        start = state = cut(degree.select("service", "node", F.col("node").alias("label"), "degree"))
        for k in range(rounds):
            after = _moved(links, state, totals, k)
            state = after.select("service", "node", "label", "degree")
            nodes, moves = after.agg(F.count(F.lit(1)), F.count_if(F.col("label") != F.col("old"))).first()
            if moves <= STILL * nodes:
                break
        before = _modularity(links, start, totals).withColumnRenamed("quality", "was")
        better = cut(_modularity(links, state, totals).join(before, "service").where("quality > was + 1e-9").select("service"))
        if better.isEmpty():
            break
        kept = state.join(better, "service", "left_semi").select("service", "node", "label").unionByName(start.join(better, "service", "left_anti").select("service", "node", "label"))
        kept = cut(kept)
        member = cut(member.withColumnRenamed("label", "node").join(kept, ["service", "node"]).select("service", "name", "label"))
        to = lambda c: kept.select("service", F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        links = cut(links.join(to("a"), ["service", "a"]).join(to("b"), ["service", "b"]).groupBy("service", F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(F.sum("weight").alias("weight")))
    return reduce(DataFrame.unionByName, [*done, member]).select("service", F.col("name").alias("node"), "label")


def communities(edges: DataFrame, levels: int = 10, rounds: int = ROUNDS, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(service, node, community): communities numbered by their smallest node; a service with fewer than MIN_EDGES links has none."""
    enough = undirected(edges).groupBy("service").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_EDGES)
    # Read by the numbering and by the result; the labels of a level are hashes or places, so they are numbered within the service.
    found = cut(distributed_louvain(edges.join(enough, "service", "left_semi"), levels, rounds, local_links))
    first = found.groupBy("service", "label").agg(F.min("node").alias("first"))
    # One row a community is put in order, within its service.
    number = F.row_number().over(Window.partitionBy("service").orderBy("first")) - 1
    numbered = first.withColumn("community", F.concat_ws("::community-", "service", number.cast("string"))).drop("first")
    return found.join(numbered, ["service", "label"]).select("service", "node", "community")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(service, node, label) after rounds in which a node takes the label with the most weight around it, the smallest on ties."""
    pairs = undirected(edges)
    both = pairs.select("service", F.col("a").alias("node"), F.col("b").alias("near"), "weight").unionByName(pairs.select("service", F.col("b").alias("node"), F.col("a").alias("near"), "weight"))
    labels = both.select("service", "node").distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        heard = both.join(labels.select("service", F.col("node").alias("near"), "label"), ["service", "near"]).groupBy("service", "node", "label").agg(F.round(F.sum("weight"), 6).alias("weight"))
        labels = heard.groupBy("service", "node").agg(F.min_by("label", F.struct(F.negative("weight"), "label")).alias("label"))
    return labels


def community_nodes(members: DataFrame) -> DataFrame:
    return members.groupBy("service", F.col("community").alias("name")).agg(F.count(F.lit(1)).alias("member_count"))


def clusters(members: DataFrame) -> DataFrame:
    """Members of each community, in order."""
    return members.groupBy("service", "community").agg(F.array_sort(F.collect_list("node")).alias("members"))
