import random

import numpy as np

from evalloom.llm.quality import FEATURES, _forward, _gradient, fit_bags, passages, scored


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    x, bag, y, weight = rng.standard_normal((9, FEATURES)), np.array([0, 0, 1, 2, 2, 2, 2, 3, 3]), np.array([1.0, 0, 1, 0]), np.ones(4)
    w = {"e": rng.standard_normal((FEATURES, 5)) / 10, "eb": rng.standard_normal(5), "v": rng.standard_normal((5, 3)), "u": rng.standard_normal((5, 3)), "a": rng.standard_normal(3), "c": rng.standard_normal(5), "cb": np.zeros(1)}
    loss = lambda: float(-np.mean(np.where(y == 1, np.log(p := _forward(w, x, bag, 4)["p"]), np.log(1 - p))))
    grad = _gradient(w, x, bag, y, weight)
    for k in w:
        i = tuple(0 for _ in w[k].shape)
        w[k][i] += 1e-5
        up = loss()
        w[k][i] -= 2e-5
        down = loss()
        w[k][i] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][i]) < 1e-5


def test_every_text_has_a_passage():
    x, bag = passages([b"", b" \n", b"a " * 130, "é ü".encode()])
    assert bag.tolist() == [0, 1, 2, 2, 2, 3] and np.isfinite(x).all()
    assert fit_bags(x, bag, np.ones(4)).scores(x, bag, 4).tolist() == [1.0] * 4


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = lambda: " ".join(word() for _ in range(rng.randrange(5, 300))).capitalize() + "."
    bad = lambda: rng.choice([" | ".join(word() for _ in range(80)), " ".join(word().upper() + "!!" for _ in range(90)), " ".join([word()] * 100)])
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(600)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(400)] + [(1, 1, 0), (5000, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = scored(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.doc_id is not None and r.doc_id < 600 and (r.held_out or r.doc_id >= 400)]
    assert sum(r.predicted == (r.doc_id % 5 != 0) for r in test) / len(test) > 0.97
    assert scored(docs.limit(0), labels.limit(0)).count() == 0


def test_repeated_rows_long_texts_and_extra_columns(spark):
    rows = [(i, ("A plain sentence of words. " * 3) if i % 2 else "x!! | " * 20, "a", 0.5, True) for i in range(40)]
    rows += [rows[1], (1, "another text", "b", None, None), (50, "long words here " * 60_000, "a", 0.1, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, i % 2, 0, "s") for i in range(40)] + [(1, 1, 0, "s")], "doc_id long, quality int, toxic int, text string")
    got = scored(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id == 1]
    assert len(same) == 3 and len(set(same)) <= 2
