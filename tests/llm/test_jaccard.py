import random
import re

import numpy as np

from evalloom.llm import jaccard
from evalloom.llm.jaccard import shingle_components, t_occurrence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    comp = {d: d for d, _ in rows if d is not None}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    line = "All rights reserved by the owner of this page"
    for g in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 12, 40, 90, 150]))]
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"W{rng.randrange(300)}"
            if rng.random() < 0.3:
                w += line.split()
            rows.append((len(rows) * 7 % 1009, (" " if rng.random() < 0.8 else "\n").join(w)))
    return rows + [(5000, None), (5001, ""), (5002, " \t"), (5003, line), (5004, line.upper()), (5005, line), (None, line)]


def test_against_brute_force(spark):
    rows = corpus()
    for cell in (256, 3):
        jaccard.CELL = cell
        got = shingle_components(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, band string"))
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)
    jaccard.CELL = 256


def test_empty(spark):
    assert shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_t_occurrence_links_are_complete():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sets = []
        for _ in range(40):
            base = np.arange(rng.integers(5, 60)) + rng.integers(0, 3) * 100
            x = base[rng.random(len(base)) > 0.08]
            if len(x):
                sets.append(x.astype(np.int64))
        sets.sort(key=len)
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))

        def closed(pairs):
            c = list(range(len(sets)))
            for a, b in pairs:
                x, y = c[a], c[b]
                c = [min(x, y) if v in (x, y) else v for v in c]
            return c

        got = t_occurrence(sets, 80)
        assert all(link(sets[a], sets[b]) for a, b in got)
        assert closed(got) == closed([(a, b) for a in range(len(sets)) for b in range(a) if link(sets[a], sets[b])])


def test_other_likeness_and_very_long_texts(spark):
    rows = corpus(4)[:60] + [(6000, " ".join(f"w{i % 997}x{i}" for i in range(30000))), (6001, " ".join(f"w{i % 997}x{i}" for i in range(1000, 30000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (100, 90):
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_components(df, percent=percent).collect()), key=str) == brute(rows, percent)


def test_sides_and_labels():
    sets = [np.arange(10), np.arange(10) + (np.arange(10) > 8) * 100, np.arange(11), np.arange(11) + (np.arange(11) > 9) * 50]
    assert len(t_occurrence(sets, 60)) == 3
    assert t_occurrence(sets, 60, np.array([7, 7, 7, 7])) == []
    assert t_occurrence(sets, 60, None, np.zeros(4, dtype=int)) == []
    assert {tuple(sorted((a in (0, 1), b in (0, 1)))) for a, b in t_occurrence(sets, 60, None, np.array([0, 0, 1, 1]))} == {(False, True)}
