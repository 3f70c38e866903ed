import re
from itertools import product

import numpy as np

from evalloom.llm.mixing import fitted, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_fitted_is_the_best_subset():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = np.sort(rng.choice(np.arange(1, 40), 5, replace=False))
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (sizes * counts).sum() + 5))
        take = fitted(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        got = int((take * sizes).sum())
        best = max(s for c in product(*(range(k + 1) for k in counts)) if (s := int(np.dot(c, sizes))) <= budget)
        assert got <= budget and (got == best or budget - got <= sizes.min())


def test_fitted_with_long_documents():
    fit = lambda sizes, counts, budget: int((fitted(np.array(sizes), np.array(counts), budget) * sizes).sum())
    assert fit([90_000, 100_000], [1, 1], 95_000) == 90_000
    assert fit([90_000, 95_000, 100_000], [1, 1, 1], 190_000) == 190_000
    assert fit([60_000, 100_000], [2, 1], 120_000) == 120_000
    assert fit([5_000_001, 9_000_000], [1, 1], 5_000_001) == 5_000_001
    assert fit([10, 3_000_000, 9_000_000], [30, 2, 1], 6_000_100) == 6_000_100
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = np.sort(rng.choice(np.arange(17_000, 150_000), 4, replace=False))
        counts = rng.integers(1, 3, 4)
        budget = int(rng.integers(20_000, (sizes * counts).sum()))
        every = [int(np.dot(c, sizes)) for c in product(*(range(k + 1) for k in counts))]
        best = max(s for s in every if s <= budget)
        take = fitted(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == best, (sizes, counts, budget)


def test_few_documents_of_any_length_are_fitted_exactly():
    rng = np.random.default_rng(7)
    for case in range(500):
        top = int(rng.choice([100, 20_000, 200_000, 6_000_000]))
        sizes = np.unique(rng.integers(1, top + 1, size=rng.integers(1, 6)))
        counts = rng.integers(1, 10, len(sizes))
        budget = int(rng.integers(1, (sizes * counts).sum() + 1))
        sums = np.zeros(1, dtype=np.int64)
        for s, c in zip(sizes, counts):
            sums = (sums[:, None] + s * np.arange(c + 1)).reshape(-1)
        take = fitted(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) == sums[sums <= budget].max(), (case, sizes, counts, budget)
    assert int((fitted(np.array([1_934_858, 5_260_418, 5_777_953]), np.array([3, 3, 2]), 23_873_917) * [1_934_858, 5_260_418, 5_777_953]).sum()) == 23_494_065


def test_many_long_documents_meet_the_budget():
    rng = np.random.default_rng(8)
    for _ in range(6):
        sizes = np.unique(rng.integers(100_000, 9_000_000, size=60))
        counts = rng.integers(1, 2000, len(sizes))
        budget = int(rng.integers(10**9, (sizes * counts).sum()))
        take = fitted(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int((take * sizes).sum()) == budget


def wanted(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest, ww = total - sum(stopped.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / ww > 3 * sizes[s]]
        if not over:
            return stopped | {s: rest * w[s] / ww for s in free}
        stopped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_takes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, "b", "a", "z", "é"][rng.choice(5, p=[0.05, 0.5, 0.2, 0.2, 0.05])], " ".join(["w"] * int(rng.choice([0, 3, 7, 50, 51, 52, 400])))) for i in range(900)]
    rows += [(1000, "a", None), (3, "b", rows[3][2]), (None, "b", "x y z"), (1001, "only empty", "")]
    docs = spark.createDataFrame([(d, s, t, 1) for d, s, t in rows], "doc_id long, source string, text string, u int")
    got = mixed_documents(docs).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), len(WORD.findall(t or ""))) for d, _, t in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    goal = wanted(sizes)
    by_size = {v: k for k, v in sizes.items()}
    taken = {}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal)
    again = mixed_documents(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty(spark):
    assert mixed_documents(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
