import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import cost, infer, models, pairs, power, report, resample, telemetry


def deltas(spark, values, key="g"):
    return spark.createDataFrame([(key, f"d|{i}", float(v)) for i, v in enumerate(values)], "k string, item_key string, delta double")


def test_published_vector(spark):
    """1186 gains and 326 losses: the published rank sum and p."""
    h = spark.createDataFrame([("g", 1.0, 1186), ("g", -1.0, 326), ("g", 0.0, 23892)], "k string, delta double, cnt long")
    r = infer.wilcoxon(h, "k").first()
    assert (r.n, r.w) == (1512, 246619.0) and r.z == pytest.approx(-22.11681, abs=1e-5)
    assert r.p == pytest.approx(2.177782156104665e-108, rel=1e-9)


def test_wilcoxon_small(spark):
    h = pairs.delta_histogram(deltas(spark, [1, 2, 3, -4, 5, 6]), "k")
    assert infer.wilcoxon(h, "k").first().p == pytest.approx(0.21875)
    none = infer.wilcoxon(pairs.delta_histogram(deltas(spark, [0, 0]), "k"), "k").first()
    assert (none.n, none.w, none.p) == (0, 0.0, 1.0)


def test_effects_and_hodges_lehmann(spark):
    d = deltas(spark, [1.0, 0.0, -1.0, 2.0, 2.0])
    e = pairs.effect_sizes(d, "k").first()
    assert e.mean == pytest.approx(0.8) and e.cliffs_delta == pytest.approx(0.5) and e.cohens_d == pytest.approx(0.8 / 1.3038404, abs=1e-6)
    assert infer.hodges_lehmann(d, "k").first().hl == pytest.approx(1.0)
    assert infer.hodges_lehmann(d, "k", most=3).first().hl == pytest.approx(1.0)


def test_bh_direction(spark):
    t = spark.createDataFrame([("a", 0.001), ("b", 0.9), ("c", None), ("d", float("nan"))], "test string, p double")
    assert [r.q for r in infer.fdr_bh(t).orderBy("p").collect()] == pytest.approx([0.002, 0.9])
    assert [r.q for r in infer.fdr_bh(t, reference=True).orderBy("p").collect()] == pytest.approx([0.002, 0.002])


def test_resampling_near_the_normal_interval(spark):
    values = ([1] * 60 + [-1] * 40 + [0] * 100) * 5
    d = deltas(spark, values)
    h = pairs.delta_histogram(d, "k")
    mean, se = 0.1, (0.5 - 0.01) ** 0.5 / 1000**0.5
    for ci in (resample.bootstrap_histogram(h, 2000, 1, 0.05, "k").first(), resample.bootstrap_keyed(d, 400, 1, 0.05, "k").first()):
        assert ci.ci_low == pytest.approx(mean - 1.96 * se, abs=0.01) and ci.ci_high == pytest.approx(mean + 1.96 * se, abs=0.01)
    assert resample.permutation_histogram(h, 500, 1, "k").first().p_permutation < 0.01
    assert resample.permutation_keyed(d, 200, 1, "k").first().p < 0.02
    same = resample.bootstrap_histogram(h.repartition(3), 2000, 1, 0.05, "k").first()
    assert same == resample.bootstrap_histogram(h, 2000, 1, 0.05, "k").first()


def test_swapping_conditions_negates_deltas(spark):
    rows = [(f"s|{i}", "open", c, 0.0, float(i % 2), 0.5 * (c == "control"), 0.1, 0.2, 0.3) for i in range(6) for c in ("control", "treatment")]
    schema = "item_key string, type string, condition string, temp double, em double, f1 double, abstain_rate double, false_answer_rate double, unsupported_rate double"
    p = spark.createDataFrame(rows + [("s|9", "open", "control", 0.0, 1.0, 1.0, 0.0, 0.0, 0.0)], schema)
    swap = p.withColumn("condition", F.when(F.col("condition") == "control", "treatment").otherwise("control"))
    a, b = ({(r.item_key, r.metric): r.delta for r in pairs.paired_deltas(pairs.pair_conditions(x)).collect()} for x in (p, swap))
    assert len(a) == 30 and all(a[k] == -b[k] for k in a)
    assert pairs.balance_check(p).first().severity == "ok"
    r = pairs.pairing_rate(p, pairs.pair_conditions(p)).first()
    assert (r.n_pairs, r.rate) == (6, pytest.approx(6 / 7))


def test_selective_risk_edges(spark):
    p = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (0.0, 1.0)], "t_em double, t_abstain_rate double").withColumn("k", F.lit("x"))
    r = {x.threshold: x for x in infer.selective_risk(p, [0.0, 1.0, -3], "t", "k").collect()}
    assert r[0.0].coverage == 1.0 and r[1.0].coverage == pytest.approx(1 / 3) and r[1.0].risk == 0.0
    none = infer.selective_risk(p.where("t_abstain_rate = 1"), [0.0, 1.0], "t", "k").collect()
    assert all(x.risk is None for x in none) and infer.aurc(infer.selective_risk(p, [0.0], "t", "k"), "k").first().aurc is None


def test_noninferiority_without_spread(spark):
    assert infer.noninferiority(deltas(spark, [0.0, 0.0]), 0.01, 0.05, "k").first().p == 0.0
    assert infer.noninferiority(deltas(spark, [-0.5, -0.5]), 0.01, 0.05, "k").first().p == 1.0


def test_gee_without_correlation_is_logistic_and_robust(spark):
    rows = [(f"i{i}", c, t, int((i * 7 + (c == "treatment") * 3) % 5 > 1)) for i in range(200) for c in ("control", "treatment") for t in (0.0, 0.7)]
    df = spark.createDataFrame(rows, "item_key string, condition string, temp double, binary_correct int")
    free = {r.term: r for r in models.gee_logistic(df, exchangeable=False).collect()}
    odds = lambda c: (lambda p: __import__("math").log(p / (1 - p)))(sum(r[3] for r in rows if r[1] == c) / 400)
    assert free["treatment"].coef == pytest.approx(odds("treatment") - odds("control"), abs=1e-6) and free["temp_c"].coef == pytest.approx(0, abs=1e-6)
    assert {r.term for r in models.gee_logistic(df).collect()} == set(models.NAMES)
    assert models.ols_cluster_robust(df.withColumn("f1", F.col("binary_correct").cast("double")).limit(3)).count() == 0


def test_costs_published(spark):
    t = spark.createDataFrame([("p", "m", 3000, 1500), ("p", "n", 8000, 4000)], "provider string, model string, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("P", "M", 1.25, 5.0, None, None, 0.5), ("p", "n", 3.0, 15.0, 1.5, 7.5, 0.5)], "provider string, model string, input double, output double, batch_input double, batch_output double, discount double")
    got = {r.model: (r.usd, r.rate_type) for r in cost.cost_summary(cost.resolve_pricing(t, prices)).collect()}
    assert got == {"m": (0.005625, "batch_discount"), "n": (0.042, "batch")}


def test_means_rules(spark):
    p = spark.createDataFrame([("a", 1.0), ("a", None)], "g string, em double")
    got = {rule: cost.metric_means(p, rule, "g", metrics=("em", "f1")).first() for rule in ("all", "zero", "present")}
    assert (got["all"].em, got["zero"].em, got["present"].em) == (0.5, 0.5, 1.0) and got["present"].f1 == 0.0


def test_reports_and_power(spark):
    d = deltas(spark, [0.0, 1.0, 0.0, 1.0])
    g = power.detectable(d, 0.05, 0.8, "k")
    assert g.first().mde == pytest.approx(2.801585 * 0.5773503 / 2, abs=1e-5)
    assert [r.n_needed for r in power.required_n(g, [0.1, 0.0]).orderBy("target").collect()] == [None, 262]
    f = spark.createDataFrame([("stop",)] * 8 + [("length",)] * 2, "finish_reason string")
    assert {r.finish_reason: r.alert for r in report.finish_reason_rates(f).collect()} == {"stop": False, "length": True}


def test_nearest_rank_and_rolling(spark):
    x = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 7.0), ("c", None)], "k string, latency_ms double")
    got = {r.k: r.p95_ms for r in telemetry.telemetry_summary(x, "k").collect()}
    assert got == {"a": 10.0, "b": 7.0, "c": None}
    y = spark.range(3000).select(F.when(F.col("id") % 4 > 0, "k").alias("k"), ((F.col("id") * 7919) % 2003 / 3.0).alias("v"))
    values: dict = {}
    for r in y.collect():
        values.setdefault(r.k, []).append(r.v)
    for q in (0.0, 0.25, 0.95, 1.0):
        assert {r.k: r.q for r in pairs.nearest_rank(y, "v", q, "k").collect()} == {k: sorted(v)[round(q * (len(v) - 1))] for k, v in values.items()}
    t = spark.createDataFrame([(i, "p", s) for i, s in enumerate((0, 1, 59, 60, 61, 700, 759, 760))], "id int, provider string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.in_window for r in telemetry.rolling_request_total(t).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 1, 6: 2, 7: 2}


def test_exchangeable_fit_against_dense_matrices(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        lean = rng.normal()
        for c in ("control", "treatment"):
            for t in (0.0, 0.7):
                for _ in range(int(rng.integers(1, 3))):
                    rows.append((f"i{i}", c, t, int(rng.random() < 1 / (1 + np.exp(-(0.3 + 0.5 * (c == "treatment") + lean))))))
    df = spark.createDataFrame(rows, "item_key string, condition string, temp double, binary_correct int")
    got = {r.term: r for r in models.gee_logistic(df).collect()}
    y, who = np.array([r[3] for r in rows], dtype=float), np.array([r[0] for r in rows])
    temp, treat = np.array([r[2] for r in rows]), np.array([float(r[1] == "treatment") for r in rows])
    x = np.stack([np.ones(len(y)), treat, temp - temp.mean(), treat * (temp - temp.mean())], axis=1)
    beta, rho = np.zeros(4), 0.0
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        v = np.sqrt(mu * (1 - mu))
        h, m, g, cross, pairs = np.zeros((4, 4)), np.zeros((4, 4)), np.zeros(4), 0.0, 0
        res = (y - mu) / v
        for k in np.unique(who):
            at = who == k
            n = int(at.sum())
            inv = np.linalg.inv((1 - rho) * np.eye(n) + rho * np.ones((n, n)))
            d = v[at][:, None] * x[at]
            u = d.T @ inv @ res[at]
            h, m, g = h + d.T @ inv @ d, m + np.outer(u, u), g + u
            cross, pairs = cross + (res[at].sum() ** 2 - (res[at] ** 2).sum()) / 2, pairs + n * (n - 1) / 2
        cov = np.linalg.inv(h) @ m @ np.linalg.inv(h)
        step = np.linalg.solve(h, g)
        if np.abs(step).max() < 1e-10:
            break
        beta = beta + step
        rho = cross / ((res**2).sum() / (len(y) - 4)) / (pairs - 4)
    for i, name in enumerate(models.NAMES):
        assert got[name].coef == pytest.approx(beta[i], abs=1e-6) and got[name].se == pytest.approx(np.sqrt(cov[i, i]), abs=1e-6)
    assert got["intercept"].rho == pytest.approx(rho, abs=1e-6) and rho > 0.05


def test_sign_flips_on_a_lattice_against_all_flips():
    import itertools

    import numpy as np

    from evalloom.operators import resample

    rng = np.random.default_rng(3)
    for _ in range(60):
        k = np.unique(rng.integers(1, 9, size=rng.integers(1, 4)))
        c = rng.integers(1, 5, size=len(k))
        items = np.repeat(k, c)
        sums = [sum(s * x for s, x in zip(signs, items.tolist())) for signs in itertools.product((-1, 1), repeat=len(items))]
        for observed in {abs(s) for s in sums}:
            assert abs(resample.flip_tail(k, c, observed) - np.mean([abs(s) >= observed for s in sums])) < 1e-10
    k, unit = resample.lattice(np.array([1 / 3, 0.5, 0.1]), np.array([1, 1, 1]))
    assert unit == 30 and k.tolist() == [10, 15, 3] and resample.lattice(np.array([2**0.5]), np.array([1])) is None
    # a million items: the normal tail
    assert abs(resample.flip_tail(np.array([1]), np.array([1_000_000]), 2000) - 0.0455) < 2e-4


def test_lattices_and_draws_by_group(spark):
    from evalloom.operators import resample

    rows = [("a", 0.5, 6), ("a", -0.5, 2), ("b", 2**0.5, 5), ("b", -(2**0.5), 1), ("c", 0.0, 4)]
    h = spark.createDataFrame(rows, "g string, delta double, cnt long")
    got = {r.g: (round(r.p_permutation, 2), r.exact) for r in resample.permutation_exact(h, 20_000, 1, "g").collect()}
    assert got["a"] == (0.29, True) and got["c"] == (1.0, True) and not got["b"][1] and abs(got["b"][0] - 0.22) < 0.03


def test_walsh_median_against_all_pairs():
    import numpy as np

    from evalloom.operators.infer import walsh_median

    rng = np.random.default_rng(5)
    for n, draw in ((1, rng.normal), (2, rng.normal), (3000, rng.normal), (3000, lambda size: rng.integers(-6, 7, size) / 6), (7, lambda size: np.full(size, 0.25))):
        x = np.sort(draw(size=n))
        i, j = np.triu_indices(n)
        v, c = np.unique(x, return_counts=True)
        assert abs(walsh_median(v, c) - np.median((x[i] + x[j]) / 2)) < 1e-12


def test_one_exchange_from_predictions_to_pairs(spark):
    from evalloom.operators import pairs, score
    from evalloom.sources.shared import stored

    rows = [(f"a|{i % 40}", "open", ("control", "treatment")[i % 2], 0.0, i // 80, float(i % 3 == 0)) for i in range(400)]
    p = spark.createDataFrame(rows, "item_key string, type string, condition string, temp double, sample_index int, em double")
    p = p.selectExpr("*", "em AS f1", "em AS abstained", "em AS false_answer", "em AS unsupported")

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    dealt = pairs.pair_conditions(score.aggregate_replicates(score.by_item(p)))
    assert exchanges(dealt) == 1
    kept = stored(score.aggregate_replicates(score.by_item(p)), "peritem", by="item_key")
    read = pairs.pair_conditions(kept)
    assert exchanges(read) == 0
    plain = pairs.pair_conditions(score.aggregate_replicates(p))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, read.collect())) == sorted(map(str, plain.collect()))
