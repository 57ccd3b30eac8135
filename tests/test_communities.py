"""Louvain against a plain version that recomputes the modularity by its definition for every move; the distributed way against that by modularity."""

import os
import random

import pytest

import __spark_entry__
from quillgraph.operators import community
from quillgraph.plans.fixtures import Views

DIR = "/root/testdata/sf0.01"


def brute(links):
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    groups = [[n] for n in nodes]
    while True:
        label = list(range(len(groups)))

        def score(label=label, groups=groups):
            return community.modularity(links, {n: label[i] for i, g in enumerate(groups) for n in g})

        def around(i, groups=groups, label=label):
            at = {n: k for k, g in enumerate(groups) for n in g}
            return sorted({label[at[b if at[a] == i else a]] for a, b, _ in links if (at[a] == i) != (at[b] == i)})

        any_moved = moved = True
        any_moved = False
        while moved:
            moved = False
            for i in range(len(groups)):
                own, best, most = label[i], label[i], score()
                for c in around(i):
                    label[i] = c
                    if (now := score()) > most + 1e-9:
                        best, most = c, now
                label[i] = best
                if best != own:
                    moved = any_moved = True
        if not any_moved:
            return {frozenset(g) for g in groups}
        groups = [[n for i, g in enumerate(groups) if label[i] == c for n in g] for c in sorted(set(label))]


def parts(label):
    out = {}
    for n, c in label.items():
        out.setdefault(c, set()).add(n)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("seed", range(8))
def test_random_graphs(seed):
    rng = random.Random(seed)
    links = {}
    for _ in range(rng.randint(8, 40)):
        a, b = sorted(rng.sample(range(18), 2))
        links[a, b] = rng.choice([0.7, 0.85, 0.95])
    links = [(a, b, w) for (a, b), w in sorted(links.items())]
    assert parts(community.louvain(links)) == brute(links)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_registered_query(spark):
    pairs = {}
    for r in community.undirected(Views(spark, DIR).service_calls()).collect():
        pairs.setdefault(r.service, []).append((r.a, r.b, r.weight))
    got, counts = {}, {}
    for r in __spark_entry__.queries()["g07_communities"](spark, DIR).collect():
        got.setdefault(r.service, {})[r.node] = r.community
        counts[r.service, r.community] = counts.get((r.service, r.community), 0) + 1
    large = {s: sorted(links) for s, links in pairs.items() if len(links) >= community.MIN_EDGES}
    assert large and set(got) == set(large)
    for service, links in large.items():
        assert set(got[service]) == {x for a, b, _ in links for x in (a, b)}
        assert community.modularity(links, got[service]) >= 0.99 * community.modularity(links, community.louvain(links)), service
    members = spark.createDataFrame([(s, n, c) for s, x in got.items() for n, c in x.items()], "service string, node long, community string")
    assert {(r.service, r.name): r.member_count for r in community.community_nodes(members).collect()} == counts
