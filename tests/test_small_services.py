"""Communities of services with few links, of one that falls below the bound after a level, and of a large one."""

import random

import pytest

from quillgraph.operators import community


@pytest.mark.parametrize("local_links", [0, 60, 10_000])
def test_settled_in_a_task_or_by_joins(spark, local_links):
    rng = random.Random(3)
    rows = []
    for service, groups in (("one", 3), ("two", 8)):
        for g in range(groups):
            members = [f"{service}{g:02d}{k}" for k in range(6)]
            rows += [(service, a, b, 0.95) for a in members for b in members if a < b and rng.random() < 0.9]
            rows.append((service, members[0], f"{service}{(g + 1) % groups:02d}0", 0.7))
    rows.append(("few", "x", "y", 0.7))
    edges = spark.createDataFrame(rows, "service string, src string, dst string, confidence double")
    got = {}
    for r in community.communities(edges, local_links=local_links).collect():
        got.setdefault(r.service, {})[r.node] = r.community
    assert set(got) == {"one", "two"}
    for service, found in got.items():
        links = sorted((r.a, r.b, r.weight) for r in community.undirected(edges).where(f"service = '{service}'").collect())
        assert set(found) == {x for a, b, _ in links for x in (a, b)}
        assert community.modularity(links, found) >= 0.99 * community.modularity(links, community.louvain(links))


def test_settling_takes_few_jobs(spark):
    rows = [(f"s{s}", a, b, 0.7) for s in range(3) for a in range(20) for b in (a + 1, (a * 7) % 20)]
    edges = spark.createDataFrame(rows, "service string, src long, dst long, confidence double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("communities", "")
    community.communities(edges).collect()
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("communities")) < 60
