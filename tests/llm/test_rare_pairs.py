"""Operator 4: interacting terms that are rare among many more frequent ones."""

import numpy as np

from quillgraph.llm import toxicity


def documents(n, fillers, seed=1, density=0.09):
    """Rows of terms: 1 and 2 in 8 % of rows each, toxic together, without a signal alone; fillers are more frequent."""
    rng = np.random.default_rng(seed)
    a, b = rng.random(n) < 0.08, rng.random(n) < 0.08
    base = 0.1068
    share = np.where(a & b, 0.95, np.where(a | b, (base - 0.08 * 0.95) / 0.92, base))
    toxic = (rng.random(n) < share).astype(float)
    row, term = [], []
    for i in range(n):
        t = np.r_[[1] * int(a[i]), [2] * int(b[i]), np.flatnonzero(rng.random(fillers) < density) + 10].astype(np.int64)
        row.append(np.full(len(t), i))
        term.append(t)
    return np.concatenate(row), np.concatenate(term), toxic, a, b


def test_a_rare_pair_beside_many_frequent_terms():
    row, term, toxic, *_ = documents(12_000, 5000)
    assert not toxicity.informative(row, term, toxic, 18)[[1, 2]].any()
    assert not toxicity.interacting_frequent(row, term, toxic, 18)[[1, 2]].any()
    found = toxicity.interacting(row, term, toxic, 18)
    assert found[[1, 2]].all() and found.sum() <= 4


def test_the_machine_learns_the_rare_pair():
    row, term, toxic, a, b = documents(6000, 1500, 3, 0.1)
    machine = toxicity.fit(row, term, toxic)
    scores = machine.scores(row, term, len(toxic))
    assert scores[a & b].mean() > 0.6 > 0.25 > scores[a ^ b].mean()


def test_pair_counts_by_plain_loops():
    rng = np.random.default_rng(2)
    n = 400
    lists = [sorted(set(rng.integers(0, 14, 6).tolist()) | ({20, 21} if rng.random() < 0.2 else {20} if rng.random() < 0.3 else {21} if rng.random() < 0.3 else set())) for _ in range(n)]
    toxic = np.array([float(20 in t and 21 in t and rng.random() < 0.95 or rng.random() < 0.05) for t in lists])
    row, term = np.repeat(np.arange(n), [len(t) for t in lists]), np.concatenate(lists)
    distinct = list(dict.fromkeys((tuple(t), x) for t, x in zip(lists, toxic)))
    flagged, least = set(), toxicity.least_pair_z(len({t for r, _ in distinct for t in r if 20 <= sum(t in x for x, _ in distinct) <= len(distinct) - 20}))
    for i in range(22):
        for j in range(i + 1, 22):
            cells = [[0, 0] for _ in range(4)]
            for t, x in distinct:
                k = 2 * (i in t) + (j in t)
                cells[k][0] += 1
                cells[k][1] += x
            ni, nj = cells[2][0] + cells[3][0], cells[1][0] + cells[3][0]
            if not all(20 <= m <= len(distinct) - 20 for m in (ni, nj)):
                continue
            odds = [np.log(x + 0.5) - np.log(m - x + 0.5) for m, x in cells]
            error = np.sqrt(sum(1 / (x + 0.5) + 1 / (m - x + 0.5) for m, x in cells))
            if abs(odds[3] - odds[2] - odds[1] + odds[0]) >= least * error:
                flagged |= {i, j}
    assert set(np.flatnonzero(toxicity.interacting(row, term, toxic, 6)).tolist()) == flagged >= {20, 21}


def test_copies_are_told_apart_and_work_is_bounded(monkeypatch):
    row, term = np.array([0, 0, 1, 1, 2, 3, 3]), np.array([1, 2, 1, 2, 1, 1, 2])
    toxic = np.array([1.0, 1.0, 0.0, 0.0, 0.0])
    got = toxicity.told_apart(row, term, toxic)
    assert [x.tolist() for x in got] == [[0, 0, 1, 2, 2], [1, 2, 1, 1, 2], [1.0, 0.0, 0.0, 0.0]]
    monkeypatch.setattr(toxicity, "PAIR_WORK", 5)
    assert [x.tolist() for x in toxicity.told_apart(row, term, toxic)] == [[0, 0, 1], [1, 2, 1], [1.0, 0.0]]


def test_scores_by_plain_sums():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(-0.3, rng.normal(size=32).astype(np.float32), rng.normal(size=(32, toxicity.FACTORS)).astype(np.float32))
    lists = [sorted(set(rng.integers(0, 32, k).tolist())) for k in (0, 1, 2, 9, 20)]
    got = machine.scores(np.repeat(np.arange(5), [len(t) for t in lists]), np.concatenate(lists).astype(np.int64), 5)
    for t, score in zip(lists, got):
        logit = machine.bias + sum(float(machine.weights[i]) for i in t) + sum(float(machine.factors[i].astype(float) @ machine.factors[j].astype(float)) for k, i in enumerate(t) for j in t[k + 1 :])
        assert abs(score - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-6
