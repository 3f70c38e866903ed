import numpy as np

from evalloom.llm import embeddings
from evalloom.llm.embeddings import most_unlike, near_duplicates, same_cell, shape


def like(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def brute(rows, cosine):
    x = [embeddings._usable(v) if i is not None else None for i, v in rows]
    n = len(rows)
    links, comp = [0] * n, {i: i for i, _ in rows if i is not None}

    def root(c):
        while comp[c] != c:
            c = comp[c]
        return c

    for i in range(n):
        for j in range(i):
            a, b = x[i], x[j]
            if a is not None and b is not None and len(a) == len(b) and like(a, b) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(rows[i][0]), root(rows[j][0])))
                comp[q] = p
    return sorted(((i, k, root(i) if i is not None else None, i is not None and root(i) == i) for (i, _), k in zip(rows, links)), key=str)


def test_probability():
    rng = np.random.default_rng(0)
    for d in (0.3, 1.4):
        a, b, s = rng.standard_normal((20000, 2)), np.array([d, 0.0]), rng.uniform(0, embeddings.WIDTH, 20000)
        got = (np.floor(s / embeddings.WIDTH) == np.floor((a @ b + s) / embeddings.WIDTH)).mean()
        assert abs(got - same_cell(d)) < 0.02
    assert shape(10**9, 0.95)[0] > shape(10**4, 0.95)[0]


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows) * 11 % 1999, (base + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.3])).astype(np.float32)))
    rows += [(3000 + i, rows[4][1]) for i in range(5)] + [(3100, rows[4][1] * 2), (3101, rows[8][1][:8]), (rows[2][0], rows[2][1]), (None, rows[4][1])]
    plain = [(i, [float(c) for c in v]) for i, v in rows] + [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0] * 15 + [None]), (4005, [float("inf")] + [1.0] * 15)]
    assert most_unlike(0.95) in range(25, 35) and most_unlike(0.0) > 64
    df = spark.createDataFrame([(i, v, 1) for i, v in plain], "vec_id long, embedding array<float>, h int")
    for cell in (2048, 2):
        embeddings.CELL = cell
        assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute([(i, v) for i, v in plain], 0.95)
    embeddings.CELL = 2048
    assert near_duplicates(df.limit(0)).count() == 0


def test_sizes_of_doubles(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.0]), (3, [1e-200, 1e-200]), (4, [-1e-200, 0.0]), (5, [5e-324, 0.0]), (6, [2.0, 2.0])]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute([(i, np.array(v)) for i, v in rows], 0.95) == [(1, 2, 1, True), (2, 1, 2, True), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 2, False), (6, 2, 1, False)]
