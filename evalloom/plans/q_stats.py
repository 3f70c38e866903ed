"""Queries of pairing, tests, intervals, regressions and power."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from evalloom.operators import infer, models, power, resample
from evalloom.operators import pairs as P
from evalloom.plans import fixtures as X
from evalloom.plans.base import query
from evalloom.plans.q_scores import _SCORES, norm

KEYS = ("temp", "type", "metric")
W = f"WITH {X.PAIRS}"


def _per_item(spark, sf_dir):
    return X.per_item(spark, sf_dir)


def _pairs(spark, sf_dir):
    return P.pair_conditions(_per_item(spark, sf_dir))


def _deltas(spark, sf_dir):
    return P.paired_deltas(_pairs(spark, sf_dir))


def _rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


# Distributions in SQL: Simpson's rule, and the expansion of Student's quantile for many degrees of freedom.
_SIMPSON = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f})) * ({z}) / 6000"


def two_sided(z: str) -> str:
    """Twice the normal tail beyond |z|; beyond 12 it is 0 to all digits compared."""
    z = f"least(abs({z}), 12.0)"
    return f"greatest(0.0, 1 - 2 * {_SIMPSON.format(f=f'exp(-0.5 * ({z} * i / 2000.0) ** 2)', z=z)} / sqrt(2 * pi()))"


def t_above(t: str, df: str) -> str:
    """The tail of Student's distribution above t."""
    f = f"(1 + ({t} * i / 2000.0) ** 2 / ({df})) ** (-(({df}) + 1) / 2.0)"
    return f"(0.5 - exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * {_SIMPSON.format(f=f, z=t)})"


def t_quantile(df: str) -> str:
    z = NormalDist().inv_cdf(0.975)
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z!r} + " + " + ".join(f"{c!r} / ({df}) ** {k}" for k, c in enumerate(terms, 1)) + ")"


def r(expression: str, name: str | None = None, digits: int = 9) -> str:
    return f"round({expression}, {digits}) AS {name or expression}"


@query("q_balance", f"""WITH {X.PER_ITEM}, n AS (SELECT count(*) FILTER (condition = 'control') AS n_control, count(*) FILTER (condition = 'treatment') AS n_treatment FROM per_item)
SELECT n_control, n_treatment, round(greatest(n_control, n_treatment) / least(n_control, n_treatment), 9) AS ratio, CASE WHEN least(n_control, n_treatment) = 0 THEN 'error' WHEN greatest(n_control, n_treatment) / least(n_control, n_treatment) > 5 THEN 'severe' WHEN greatest(n_control, n_treatment) / least(n_control, n_treatment) > 2 THEN 'moderate' ELSE 'ok' END AS severity FROM n""")
def _(spark, sf_dir):
    return _rounded(P.balance_check(_per_item(spark, sf_dir)), "ratio")


_SIDES = [f"{s}_{m}" for s in "ct" for m in X.METRICS]


@query("q_pairs", f"{W} SELECT item_key, type, temp, dataset, {', '.join(r(c) for c in _SIDES)} FROM pairs")
def _(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir), *_SIDES)


@query("q_pairing_rate", f"""{W} SELECT n_rows, n_items, n_pairs, round(n_pairs / n_items, 9) AS rate, round(n_pairs / n_rows, 9) AS rate_rows
FROM (SELECT count(*) AS n_rows, count(DISTINCT (item_key, type, temp)) AS n_items FROM per_item), (SELECT count(*) AS n_pairs FROM pairs)""")
def _(spark, sf_dir):
    i = _per_item(spark, sf_dir)
    return _rounded(P.pairing_rate(i, P.pair_conditions(i)), "rate", "rate_rows")


@query("q_deltas", f"{W} SELECT item_key, type, temp, dataset, metric, round(delta, 9) + 0.0 AS delta FROM deltas")
def _(spark, sf_dir):
    return _rounded(_deltas(spark, sf_dir), "delta").withColumn("delta", F.col("delta") + 0.0)  # one zero


_MCNEMAR = f"""{W}, m AS (SELECT temp, type, count(*) AS n, count(*) FILTER (c_em < 0.5 AND t_em >= 0.5) AS b, count(*) FILTER (c_em >= 0.5 AND t_em < 0.5) AS c FROM pairs GROUP BY temp, type)"""
_P = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"


@query("q_mcnemar", f"{_MCNEMAR} SELECT temp, type, n, b, c, round((b - c) / n, 9) AS net FROM m")
def _(spark, sf_dir):
    m = P.mcnemar_counts(_pairs(spark, sf_dir), "temp", "type")
    return m.withColumn("net", F.round((F.col("b") - F.col("c")) / F.col("n"), 9))


@query("q_binom_p", f"{_MCNEMAR} SELECT temp, type, b, c, round({_P}, 8) AS p FROM m")
def _(spark, sf_dir):
    m = infer.binom_two_sided(P.mcnemar_counts(_pairs(spark, sf_dir), "temp", "type"))
    return _rounded(m.select("temp", "type", "b", "c", "p"), "p", digits=8)


@query("q_odds_ratio", f"{_MCNEMAR} SELECT temp, type, round((b + 0.5) / (c + 0.5), 9) AS odds_ratio FROM m")
def _(spark, sf_dir):
    return _rounded(infer.odds_ratio(P.mcnemar_counts(_pairs(spark, sf_dir), "temp", "type")).select("temp", "type", "odds_ratio"), "odds_ratio")


_TAIL = "list_sum(list_transform(range({a}, {b} + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + i * ln({p}) + (b + c - i) * ln(1 - {p}))))"


@query("q_odds_limits", f"""WITH RECURSIVE {X.PAIRS}, m AS (SELECT temp, type, count(*) FILTER (c_em < 0.5 AND t_em >= 0.5) AS b, count(*) FILTER (c_em >= 0.5 AND t_em < 0.5) AS c FROM pairs GROUP BY temp, type),
s AS (SELECT temp, type, b, c, 0 AS k, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1 FROM m WHERE b > 0 AND c > 0
  UNION ALL SELECT temp, type, b, c, k + 1, CASE WHEN up < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN up < 0.025 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN down > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN down > 0.025 THEN h1 ELSE (h0 + h1) / 2 END
  FROM (SELECT *, {_TAIL.format(a="b", b="(b + c)", p="((l0 + l1) / 2)")} AS up, {_TAIL.format(a="0", b="b", p="((h0 + h1) / 2)")} AS down FROM s WHERE k < 50))
SELECT m.temp, m.type, m.b, m.c, round(coalesce(l0 / (1 - l0), CASE WHEN m.b = 0 AND m.c > 0 THEN 0 END), 6) AS odds_low, round(h0 / (1 - h0), 6) AS odds_high FROM m LEFT JOIN (SELECT * FROM s WHERE k = 50) e USING (temp, type)""")
def _(spark, sf_dir):
    o = infer.odds_ratio(P.mcnemar_counts(_pairs(spark, sf_dir), "temp", "type"))
    o = o.select("temp", "type", "b", "c", "odds_low", F.when((F.col("b") > 0) & (F.col("c") > 0), F.col("odds_high")).alias("odds_high"))
    return _rounded(o, "odds_low", "odds_high", digits=6)


#: Draws for each metric, of both forms.
REPLICATES = 5000
_CUTS = "CASE " + " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(resample.POISSON)) + f" ELSE {len(resample.POISSON)} END"
_SCRAMBLE = "xor(x, x >> {0}) * {1} % 4294967296"


def keyed_sql(relation: str, seed: int) -> str:
    """ku (item_key, r, u): the keyed draws of the items of a relation."""
    return f"""kh AS (SELECT item_key, ('0x' || substr(m, 1, 8))::UBIGINT AS a, ('0x' || substr(m, 9, 8))::UBIGINT AS b FROM (SELECT DISTINCT item_key, md5('{seed}|' || item_key) AS m FROM {relation})),
k0 AS (SELECT item_key, r, xor((a + r * {resample.STEP}) % 4294967296, b) AS x FROM kh, (SELECT unnest(range(0, {REPLICATES}))::UBIGINT AS r)), k1 AS (SELECT item_key, r, {_SCRAMBLE.format(16, resample.FACTORS[0])} AS x FROM k0),
k2 AS (SELECT item_key, r, {_SCRAMBLE.format(15, resample.FACTORS[1])} AS x FROM k1), ku AS (SELECT item_key, r, (xor(x, x >> 16) >> 16)::INTEGER / 65536.0::DOUBLE AS u FROM k2)"""


_KEYED = f"{W}, {keyed_sql('deltas', 2025)}"


def _em(spark, sf_dir):
    return _deltas(spark, sf_dir).where("metric = 'em'")


@query("q_bootstrap_keyed", f"""{_KEYED}, v AS (SELECT item_key, r, {_CUTS} AS w FROM ku), m AS (SELECT temp, type, metric, r, sum(w * delta) / sum(w) AS m FROM deltas JOIN v USING (item_key) GROUP BY ALL)
SELECT temp, type, metric, round(quantile_cont(m, 0.025), 8) AS ci_low, round(quantile_cont(m, 0.975), 8) AS ci_high FROM m GROUP BY ALL""")
def _(spark, sf_dir):
    return _rounded(resample.bootstrap_keyed(_deltas(spark, sf_dir), REPLICATES, 2025, 0.05, *KEYS), "ci_low", "ci_high", digits=8)


#: u (item_key, r, u): eight draws from each hash of seed, replicate // 8 and item.
_HASHED = f"""{W}, h AS (SELECT item_key, g, md5('2025|' || g || '|' || item_key) AS h FROM (SELECT DISTINCT item_key FROM deltas), (SELECT unnest(range(0, {-(-REPLICATES // 8)})) AS g)),
u AS (SELECT item_key, g * 8 + k AS r, ('0x' || substr(h, 4 * k + 1, 4))::INTEGER / 65536.0::DOUBLE AS u FROM h, (SELECT unnest(range(0, 8))::INTEGER AS k) WHERE g * 8 + k < {REPLICATES})"""


@query("q_permutation_keyed", f"""{_HASHED}, v AS (SELECT item_key, r, CASE WHEN u < 0.5 THEN -1 ELSE 1 END AS w FROM u), m AS (SELECT temp, type, metric, r, avg(w * delta) AS m, avg(delta) AS obs FROM deltas JOIN v USING (item_key) GROUP BY ALL)
SELECT temp, type, metric, CASE WHEN abs(max(obs)) <= 1e-12 THEN 1.0 ELSE count(*) FILTER (abs(m) >= abs(obs) - 1e-12) / {REPLICATES}.0::DOUBLE END AS p FROM m GROUP BY ALL""")
def _(spark, sf_dir):
    return resample.permutation_keyed(_deltas(spark, sf_dir), REPLICATES, 2025, *KEYS)


@query("q_resample_histogram")
def _(spark, sf_dir):
    h = P.delta_histogram(_deltas(spark, sf_dir), *KEYS)
    b = resample.bootstrap_histogram(h, 5000, 2025, 0.05, *KEYS)
    return b.join(resample.permutation_histogram(h, 5000, 2025, *KEYS), list(KEYS))


@query("q_permutation_exact", f"""{W}, s AS (SELECT temp, type, metric, round(delta * 120)::BIGINT AS d FROM deltas),
g AS (SELECT temp, type, metric, sum(abs(d))::BIGINT AS t, abs(sum(d))::BIGINT - 1 AS m FROM s GROUP BY ALL), h AS (SELECT temp, type, metric, abs(d) AS k, count(*) AS c FROM s WHERE d <> 0 GROUP BY ALL),
j AS (SELECT *, unnest(range(0, t + 1)) AS j FROM g WHERE m > 0), f AS (SELECT j.temp, j.type, j.metric, j.j, any_value(m) AS m, any_value(t) + 1 AS n, product(power(cos(pi() * ((j.j * k) % (2 * (t + 1))) / (t + 1)), c)) AS f FROM j JOIN h USING (temp, type, metric) GROUP BY ALL),
p AS (SELECT temp, type, metric, 1 - sum(f * CASE WHEN j = 0 THEN m ELSE sin(pi() * m * j / n) / sin(pi() * j / n) END) / any_value(n) AS p FROM f GROUP BY ALL)
SELECT temp, type, metric, round(least(1.0, greatest(0.0, coalesce(p, 1.0))), 8) + 0.0 AS p_permutation, true AS exact FROM g LEFT JOIN p USING (temp, type, metric)""")
def _(spark, sf_dir):
    """p over all sign flips; the SQL sums the same frequencies with a fixed unit of 1 / 120."""
    p = resample.permutation_exact(P.delta_histogram(_deltas(spark, sf_dir), *KEYS), 5000, 2025, *KEYS)
    return p.withColumn("p_permutation", F.round("p_permutation", 8) + 0.0)


@query("q_histogram", f"{W} SELECT temp, type, metric, round(delta, 9) + 0.0 AS delta, count(*) AS cnt FROM deltas GROUP BY temp, type, metric, round(delta, 9) + 0.0")
def _(spark, sf_dir):
    return P.delta_histogram(_rounded(_deltas(spark, sf_dir), "delta"), *KEYS)


_RANKS = f"""{W}, nz AS (SELECT temp, type, metric, delta, round(abs(delta), 12) AS size FROM deltas WHERE abs(delta) > 1e-12),
rk AS (SELECT *, rank() OVER (PARTITION BY temp, type, metric ORDER BY size) + (count(*) OVER (PARTITION BY temp, type, metric, size) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY temp, type, metric, size) AS t FROM nz),
g AS (SELECT temp, type, metric, count(*) AS n, sum(CASE WHEN delta > 0 THEN k ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN k ELSE 0 END) AS w_minus, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY temp, type, metric)"""


@query("q_wilcoxon", f"""{_RANKS} SELECT temp, type, metric, n, round(w_plus, 3) AS w_plus, round(w_minus, 3) AS w_minus, round(least(w_plus, w_minus), 3) AS w,
  round((least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48), 7) AS z FROM g""")
def _(spark, sf_dir):
    w = infer.wilcoxon(P.delta_histogram(_deltas(spark, sf_dir), *KEYS), *KEYS).drop("p")
    return _rounded(_rounded(w, "w_plus", "w_minus", "w", digits=3), "z", digits=7)


@query("q_wilcoxon_p", f"""{_RANKS}, z AS (SELECT *, (least(w_plus, w_minus) - n::DOUBLE * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM g WHERE n > 50) SELECT temp, type, metric, round({two_sided("z")}, 7) AS p FROM z""")
def _(spark, sf_dir):
    """Groups of more than 50 differences, whose p is the normal one."""
    w = infer.wilcoxon(P.delta_histogram(_deltas(spark, sf_dir), *KEYS), *KEYS).where("n > 50")
    return _rounded(w.select(*KEYS, "p"), "p", digits=7)


@query("q_hodges_lehmann", f"""{W}, e AS (SELECT temp, type, delta, row_number() OVER (PARTITION BY temp, type ORDER BY delta, item_key) AS i, count(*) OVER (PARTITION BY temp, type) AS n FROM deltas WHERE metric = 'em'),
v AS (SELECT a.temp, a.type, (a.delta + b.delta) / 2 AS v FROM e a JOIN e b ON a.temp = b.temp AND a.type = b.type AND a.i <= b.i WHERE a.n <= 2000 UNION ALL SELECT temp, type, delta FROM e WHERE n > 2000)
SELECT temp, type, round(quantile_cont(v, 0.5), 9) AS hl FROM v GROUP BY temp, type""")
def _(spark, sf_dir):
    return _rounded(infer.hodges_lehmann(_em(spark, sf_dir), "temp", "type"), "hl")


@query("q_hl_exact", f"""{W}, e AS (SELECT temp, type, delta, count(*) AS c FROM deltas WHERE metric = 'em' GROUP BY ALL), n AS (SELECT temp, type, sum(c) AS n FROM e GROUP BY ALL),
v AS (SELECT a.temp, a.type, (a.delta + b.delta) / 2 AS v, CASE WHEN a.delta = b.delta THEN a.c * (a.c + 1) / 2 ELSE a.c * b.c END AS w FROM e a JOIN e b ON a.temp = b.temp AND a.type = b.type AND a.delta <= b.delta),
u AS (SELECT *, sum(w) OVER (PARTITION BY temp, type ORDER BY v) AS upto FROM v)
SELECT temp, type, round((min(v) FILTER (upto >= floor((n * (n + 1) / 2 + 1) / 2)) + min(v) FILTER (upto >= floor(n * (n + 1) / 4) + 1)) / 2, 9) + 0.0 AS hl, any_value(n)::BIGINT AS n FROM u JOIN n USING (temp, type) GROUP BY temp, type""")
def _(spark, sf_dir):
    """The exact median at any number of deltas; the SQL pairs different values."""
    e = _em(spark, sf_dir)
    hl = infer.hodges_lehmann(e, "temp", "type", exact=True)
    return hl.join(e.groupBy("temp", "type").agg(F.count("*").alias("n")), ["temp", "type"]).withColumn("hl", F.round("hl", 9) + 0.0)


@query("q_effects", f"""{W} SELECT temp, type, metric, count(*) AS n, {r("avg(delta)", "mean")}, {r("coalesce(stddev_samp(delta), 0)", "sd")}, round(CASE WHEN stddev_samp(delta) > 0 THEN avg(delta) / stddev_samp(delta) ELSE 0 END, 8) AS cohens_d,
  round(CASE WHEN count(*) FILTER (abs(delta) > 1e-12) > 0 THEN (count(*) FILTER (delta > 1e-12) - count(*) FILTER (delta < -1e-12)) / count(*) FILTER (abs(delta) > 1e-12) ELSE 0 END, 9) AS cliffs_delta FROM deltas GROUP BY temp, type, metric""")
def _(spark, sf_dir):
    return _rounded(_rounded(P.effect_sizes(_deltas(spark, sf_dir), *KEYS), "mean", "sd", "cliffs_delta"), "cohens_d", digits=8)


_RISK = " UNION ALL ".join(f"""SELECT temp, type, '{n}' AS condition, threshold, count(*) FILTER ({s}_abstain_rate <= threshold) AS kept, sum(1 - {s}_abstain_rate) FILTER ({s}_abstain_rate <= threshold) AS answered, sum({s}_em) FILTER ({s}_abstain_rate <= threshold) AS good
FROM pairs, (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS threshold) GROUP BY temp, type, threshold""" for s, n in (("c", "control"), ("t", "treatment")))  # fmt: skip
_RISK = f"""{W}, k AS ({_RISK}), risk AS (SELECT temp, type, condition, threshold, kept, CASE WHEN kept > 0 THEN answered / kept ELSE 0 END AS coverage, CASE WHEN answered > 0 THEN good / answered END AS accuracy, CASE WHEN answered > 0 THEN 1 - good / answered END AS risk FROM k)"""


def _risk(spark, sf_dir):
    p, marks = _pairs(spark, sf_dir), [1.0, 0.0, 0.5, 0.25, 7.0]
    one = lambda s, n: infer.selective_risk(p, marks, s, "temp", "type").withColumn("condition", F.lit(n))
    return one("c", "control").unionByName(one("t", "treatment"))


@query("q_selective_risk", f"{_RISK} SELECT temp, type, condition, threshold, kept, {r('coverage')}, {r('accuracy')}, {r('risk')} FROM risk")
def _(spark, sf_dir):
    return _rounded(_risk(spark, sf_dir), "coverage", "accuracy", "risk")


@query("q_aurc", f"""{_RISK}, s AS (SELECT *, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS area FROM risk WHERE risk IS NOT NULL WINDOW w AS (PARTITION BY temp, type, condition ORDER BY coverage, threshold))
SELECT temp, type, condition, round(CASE WHEN count(*) > 1 THEN sum(area) END, 9) AS aurc FROM s GROUP BY temp, type, condition""")
def _(spark, sf_dir):
    return _rounded(infer.aurc(_risk(spark, sf_dir), "temp", "type", "condition"), "aurc")


@query("q_subgroups", f"""{W} SELECT temp, type, metric, CASE WHEN grouping(dataset) = 1 THEN 'overall' ELSE dataset END AS scope, count(*) AS n, {r("avg(delta)", "mean")}, count(*) FILTER (delta > 1e-12) AS pos, count(*) FILTER (delta < -1e-12) AS neg
FROM deltas GROUP BY GROUPING SETS ((temp, type, metric), (temp, type, metric, dataset))""")
def _(spark, sf_dir):
    return _rounded(P.subgroup_effects(_deltas(spark, sf_dir)), "mean")


_GROUPS = "SELECT temp, type, metric, dataset, count(*) AS n, avg(delta) AS mean, avg(delta) - 1.96 * coalesce(stddev_samp(delta), 0) / sqrt(count(*)) AS ci_low, avg(delta) + 1.96 * coalesce(stddev_samp(delta), 0) / sqrt(count(*)) AS ci_high FROM deltas WHERE type = 'closed' GROUP BY ALL"
_META = f"""{W}, gr AS ({_GROUPS}), v AS (SELECT *, CASE WHEN ci_high - ci_low > 0 THEN ((ci_high - ci_low) / 2 / 1.96) ** 2 ELSE greatest(1e-8, 0.25 / n) END AS v FROM gr WHERE n > 1),
f AS (SELECT temp, type, metric, count(*) AS k, sum(1 / v) AS sw, sum(1 / (v * v)) AS sw2, sum(mean / v) AS swm, sum(mean * mean / v) AS swmm FROM v GROUP BY ALL),
q AS (SELECT *, swm / sw AS fixed, greatest(0, swmm - swm * swm / sw) AS q, greatest(1, k - 1) AS df, sw - sw2 / sw AS c FROM f),
t AS (SELECT *, CASE WHEN k > 1 AND c > 0 THEN greatest(0, (q - (k - 1)) / c) ELSE 0 END AS tau2 FROM q),
x AS (SELECT temp, type, metric, sum(mean / (v + tau2)) / sum(1 / (v + tau2)) AS random, sqrt(1 / sum(1 / (v + tau2))) AS se FROM v JOIN t USING (temp, type, metric) GROUP BY ALL)"""


def _meta(spark, sf_dir):
    d = _deltas(spark, sf_dir).where("type = 'closed'")
    g = d.groupBy("temp", "type", "metric", "dataset").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), (1.96 * F.coalesce(F.stddev_samp("delta"), F.lit(0.0)) / F.sqrt(F.count("*").cast("double"))).alias("half"))
    return infer.meta_analysis(g.withColumn("ci_low", F.col("mean") - F.col("half")).withColumn("ci_high", F.col("mean") + F.col("half")), "temp", "type", "metric")


@query("q_meta", f"""{_META} SELECT temp, type, metric, k, {r("fixed", digits=8)}, round(fixed - 1.96 * sqrt(1 / sw), 8) AS fixed_low, round(fixed + 1.96 * sqrt(1 / sw), 8) AS fixed_high, {r("random", digits=8)}, round(random - 1.96 * se, 8) AS random_low, round(random + 1.96 * se, 8) AS random_high, {r("tau2", digits=8)}
FROM t JOIN x USING (temp, type, metric)""")
def _(spark, sf_dir):
    names = ("fixed", "fixed_low", "fixed_high", "random", "random_low", "random_high", "tau2")
    return _rounded(_meta(spark, sf_dir).select("temp", "type", "metric", "k", *names), *names, digits=8)


@query("q_heterogeneity", f"{_META} SELECT temp, type, metric, round(q, 6) AS q, df::BIGINT AS df, round(CASE WHEN q > 0 THEN greatest(0, (q - df) / q) ELSE 0 END, 6) AS i2 FROM t")
def _(spark, sf_dir):
    return _rounded(_meta(spark, sf_dir).select("temp", "type", "metric", "q", F.col("df").cast("long").alias("df"), "i2"), "q", "i2", digits=6)


@query("q_heterogeneity_p", f"{_META} SELECT temp, type, metric, round({two_sided('sqrt(q)')}, 6) AS q_p FROM t WHERE df = 1")
def _(spark, sf_dir):
    """With two datasets, and so one degree of freedom, chi-square is the square of a normal."""
    return _rounded(_meta(spark, sf_dir).where("df = 1").select("temp", "type", "metric", "q_p"), "q_p", digits=6)


_TESTS = f"""{W}, m AS (SELECT temp, type, dataset, count(*) FILTER (c_em < 0.5 AND t_em >= 0.5) AS b, count(*) FILTER (c_em >= 0.5 AND t_em < 0.5) AS c FROM pairs GROUP BY ALL),
tests AS (SELECT temp::VARCHAR || '|' || type || '|' || dataset AS test, round({_P}, 9) AS p FROM m),
ranked AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rank, count(*) OVER () AS m FROM tests)"""


def _tests(spark, sf_dir):
    m = infer.binom_two_sided(P.mcnemar_counts(_pairs(spark, sf_dir), "temp", "type", "dataset"))
    return m.select(F.concat_ws("|", F.col("temp").cast("string"), "type", "dataset").alias("test"), F.round("p", 9).alias("p"))


for _name, _frame, _ref in (("q_fdr_bh", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", False), ("q_fdr_ref", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", True)):

    @query(_name, f"{_TESTS} SELECT test, round(p, 8) AS p, rank, round(least(1.0, min(m * p / rank) OVER (ORDER BY p, test {_frame})), 8) AS q FROM ranked")
    def _(spark, sf_dir, ref=_ref):
        q = infer.fdr_bh(_tests(spark, sf_dir), ref).select("test", "p", F.col("rank").cast("long").alias("rank"), "q")
        return _rounded(q, "p", "q", digits=8)


@query("q_tost", f"""{W} SELECT temp, type, metric, count(*) AS n, {r("avg(delta)", "mean")}, {r("stddev_samp(delta)", "sd")}, round((avg(delta) + 0.01) / (stddev_samp(delta) / sqrt(count(*))), 7) AS t FROM deltas WHERE metric IN ('em', 'f1') GROUP BY ALL""")
def _(spark, sf_dir):
    t = infer.noninferiority(_deltas(spark, sf_dir).where("metric in ('em', 'f1')"), 0.01, 0.05, *KEYS)
    return _rounded(_rounded(t.select(*KEYS, "n", "mean", "sd", "t"), "mean", "sd"), "t", digits=7)


@query("q_tost_p", f"""{W}, g AS (SELECT temp, type, metric, count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, (avg(delta) + 0.01) / (stddev_samp(delta) / sqrt(count(*))) AS t FROM deltas WHERE metric IN ('em', 'f1') GROUP BY ALL)
SELECT temp, type, metric, n, round({t_above("t", "(n - 1)::DOUBLE")}, 6) AS p, round(mean - {t_quantile("(n - 1)::DOUBLE")} * sd / sqrt(n), 6) AS ci_low, round(mean + {t_quantile("(n - 1)::DOUBLE")} * sd / sqrt(n), 6) AS ci_high, {t_above("t", "(n - 1)::DOUBLE")} < 0.05 AS noninferior FROM g""")
def _(spark, sf_dir):
    t = infer.noninferiority(_deltas(spark, sf_dir).where("metric in ('em', 'f1')"), 0.01, 0.05, *KEYS)
    return _rounded(t.select(*KEYS, "n", "p", "ci_low", "ci_high", "noninferior"), "p", "ci_low", "ci_high", digits=6)


@query("q_significance")
def _(spark, sf_dir):
    return infer.significance(_pairs(spark, sf_dir))


_SCOPED = " UNION ALL ".join(f"SELECT *, {s} AS scope FROM {{0}}" for s in ("'overall'", "dataset"))
_SIG = f"""{W}, ds AS ({_SCOPED.format("deltas")}), ps AS ({_SCOPED.format("pairs")}), d AS (SELECT * FROM ds WHERE type = 'open' OR metric IN ('em', 'abstain_rate')),
e AS (SELECT temp, type, scope, metric, count(*) AS n, avg(delta) AS mean, CASE WHEN stddev_samp(delta) > 0 THEN avg(delta) / stddev_samp(delta) ELSE 0 END AS cohens_d FROM d GROUP BY ALL),
m AS (SELECT temp, type, scope, 'em' AS metric, count(*) AS n_pairs, count(*) FILTER (c_em < 0.5 AND t_em >= 0.5) AS b, count(*) FILTER (c_em >= 0.5 AND t_em < 0.5) AS c FROM ps GROUP BY ALL),
mp AS (SELECT *, {_P} AS p FROM m),
rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY temp, type, scope, metric, size) - 1) / 2.0::DOUBLE AS k FROM (SELECT *, round(abs(delta), 12) AS size FROM d WHERE abs(delta) > 1e-12) WINDOW w AS (PARTITION BY temp, type, scope, metric ORDER BY size)),
wx AS (SELECT temp, type, scope, metric, least(sum(CASE WHEN delta > 0 THEN k ELSE 0 END), sum(CASE WHEN delta < 0 THEN k ELSE 0 END)) AS w FROM rk GROUP BY ALL),
rp AS (""" + " UNION ALL ".join(f"SELECT temp, type, scope, '{n}' AS side, threshold, sum(1 - {s}_abstain_rate) / count(*) AS coverage, 1 - sum({s}_em) / sum(1 - {s}_abstain_rate) AS risk FROM ps, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS threshold) WHERE {s}_abstain_rate <= threshold GROUP BY ALL HAVING sum(1 - {s}_abstain_rate) > 0" for s, n in (("c", "control"), ("t", "treatment"))) + """),
ar AS (SELECT temp, type, scope, 'em' AS metric, side, CASE WHEN count(*) > 1 THEN sum(area) END AS aurc FROM (SELECT *, (coverage - lag(coverage) OVER v) * (risk + lag(risk) OVER v) / 2 AS area FROM rp WINDOW v AS (PARTITION BY temp, type, scope, side ORDER BY coverage, threshold)) GROUP BY ALL)"""


_DESIGN = """ze AS (SELECT count(*) FILTER (condition = 'control') AS n_control, count(*) FILTER (condition = 'treatment') AS n_treatment, count(*) AS n_rows, count(DISTINCT (item_key, type, temp)) AS n_items FROM per_item),
zp AS (SELECT count(*) AS n_pairs_all FROM pairs), hh AS (SELECT temp, type, scope, metric, delta, count(*) AS c FROM d GROUP BY ALL), hn AS (SELECT temp, type, scope, metric, sum(c) AS n FROM hh GROUP BY ALL),
hv AS (SELECT a.temp, a.type, a.scope, a.metric, (a.delta + b.delta) / 2 AS v, CASE WHEN a.delta = b.delta THEN a.c * (a.c + 1) / 2 ELSE a.c * b.c END AS w FROM hh a JOIN hh b USING (temp, type, scope, metric) JOIN hn USING (temp, type, scope, metric) WHERE a.delta <= b.delta AND n <= 2000
  UNION ALL SELECT temp, type, scope, metric, delta, c FROM hh JOIN hn USING (temp, type, scope, metric) WHERE n > 2000),
hu AS (SELECT *, sum(w) OVER (PARTITION BY temp, type, scope, metric ORDER BY v) AS upto, sum(w) OVER (PARTITION BY temp, type, scope, metric) AS total FROM hv),
hl AS (SELECT temp, type, scope, metric, (min(v) FILTER (upto >= floor((total + 1) / 2)) + min(v) FILTER (upto >= floor(total / 2) + 1)) / 2 AS hl FROM hu GROUP BY ALL)"""


@query("q_significance_exact", f"""{_SIG}, {_DESIGN} SELECT e.temp, e.type, e.scope, e.metric, e.n, round(e.mean, 9) AS mean, round(e.cohens_d, 8) AS cohens_d, round(coalesce(wx.w, 0), 3) AS w, mp.n_pairs, mp.b, mp.c, round((mp.b + 0.5) / (mp.c + 0.5), 8) AS odds_ratio, round(mp.p, 7) AS p_mcnemar,
  round(ac.aurc, 8) AS aurc_control, round(ax.aurc, 8) AS aurc_treatment, round(hl.hl, 9) + 0.0 AS hl,
  ze.n_control, ze.n_treatment, round(greatest(ze.n_control, ze.n_treatment) / least(ze.n_control, ze.n_treatment), 9) AS ratio, ze.n_rows, ze.n_items, zp.n_pairs_all, round(zp.n_pairs_all / ze.n_items, 9) AS pairing_rate, zp.n_pairs_all / ze.n_rows < 0.25 AS low_pairing
FROM e JOIN hl USING (temp, type, scope, metric) CROSS JOIN ze CROSS JOIN zp LEFT JOIN wx USING (temp, type, scope, metric) LEFT JOIN mp USING (temp, type, scope, metric) LEFT JOIN (SELECT * FROM ar WHERE side = 'control') ac USING (temp, type, scope, metric) LEFT JOIN (SELECT * FROM ar WHERE side = 'treatment') ax USING (temp, type, scope, metric)""")
def _(spark, sf_dir):
    """What of the report no draw decides."""
    s = infer.significance_report(_per_item(spark, sf_dir), replicates=100).withColumn("hl", F.round("hl", 9) + 0.0)
    s = _rounded(s, "ratio", "pairing_rate").select("temp", "type", "scope", "metric", "hl", "n_control", "n_treatment", "ratio", "n_rows", "n_items", "n_pairs_all", "pairing_rate", "low_pairing", "n", "mean", "cohens_d", "w", "n_pairs", "b", "c", "odds_ratio", "p_mcnemar", F.col("control_aurc").alias("aurc_control"), F.col("treatment_aurc").alias("aurc_treatment"))
    s = _rounded(_rounded(s, "mean"), "cohens_d", "odds_ratio", "aurc_control", "aurc_treatment", digits=8)
    return _rounded(_rounded(s, "w", digits=3), "p_mcnemar", digits=7)


# ---------------------------------------------------------------- sweeps and power

_MARKS = [i / 10 for i in range(11)]


_SENSITIVE = f"""{_SCORES}, b AS (SELECT item_key, temp, condition, (np = '')::INTEGER AS gone, (NOT (np <> '' AND contains(coalesce({norm("context")}, ''), np)))::INTEGER AS bad FROM u WHERE type = 'open'),
i AS (SELECT item_key, temp, threshold, avg(CASE WHEN gone >= threshold THEN 0 ELSE bad END) FILTER (condition = 'control') AS c, avg(CASE WHEN gone >= threshold THEN 0 ELSE bad END) FILTER (condition = 'treatment') AS t
  FROM b, (SELECT unnest({_MARKS})::DOUBLE AS threshold) GROUP BY ALL)"""


@query("q_sensitivity", f"""{_SENSITIVE} SELECT temp, threshold, count(*) AS n, round(avg(t - c), 9) AS mean FROM i WHERE c IS NOT NULL AND t IS NOT NULL GROUP BY temp, threshold""")
def _(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return _rounded(power.sensitivity_summary(power.unsupported_sensitivity(X.text_predictions(items), items, _MARKS), 100).drop("ci_low", "ci_high"), "mean")


@query("q_sensitivity_keyed", f"""{_SENSITIVE}, sd AS (SELECT item_key, temp, threshold, t - c AS delta FROM i WHERE c IS NOT NULL AND t IS NOT NULL), {keyed_sql("sd", 1337)},
v AS (SELECT item_key, r, {_CUTS} AS w FROM ku), m AS (SELECT temp, threshold, r, sum(w * delta) / sum(w) AS m FROM sd JOIN v USING (item_key) GROUP BY ALL HAVING sum(w) > 0),
ci AS (SELECT temp, threshold, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
SELECT temp, threshold, count(*) AS n, round(avg(delta), 9) AS mean, round(any_value(lo), 8) + 0.0 AS ci_low, round(any_value(hi), 8) + 0.0 AS ci_high FROM sd JOIN ci USING (temp, threshold) GROUP BY temp, threshold""")
def _(spark, sf_dir):
    """Limits from keyed draws, which any engine gives alike."""
    items = X.text_items(spark, sf_dir)
    d = power.unsupported_sensitivity(X.text_predictions(items), items, _MARKS)
    s = power.sensitivity_summary(d, REPLICATES, 1337, keyed=True)
    return _rounded(s, "mean").withColumns({c: F.round(c, 8) + 0.0 for c in ("ci_low", "ci_high")})


@query("q_sensitivity_limits")
def _(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return power.sensitivity_summary(power.unsupported_sensitivity(X.text_predictions(items), items, _MARKS))


_Z = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)
_POWER = f"""{W}, d AS (SELECT temp, t_false_answer_rate - c_false_answer_rate AS delta FROM pairs WHERE type = 'open' AND split_part(item_key, '|', 2)::BIGINT % 2 = 0),
g AS (SELECT temp, count(*) AS n, avg(delta) AS mean, coalesce(stddev_samp(delta), 0) AS sd FROM d GROUP BY temp)"""


def _power(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    even = p.where("cast(split(item_key, '[|]')[1] as long) % 2 = 0").select("item_key").distinct()
    return power.detectable(power.power_deltas(p, even), 0.05, 0.8, "temp")


@query("q_power", f"{_POWER} SELECT temp, n, {r('mean')}, {r('sd')}, round({_Z!r} * sd / sqrt(n), 9) AS mde FROM g")
def _(spark, sf_dir):
    return _rounded(_power(spark, sf_dir), "mean", "sd", "mde")


@query("q_required_n", f"{_POWER} SELECT temp, target, CASE WHEN target > 0 AND sd > 0 THEN ceil(({_Z!r} * sd / target) ** 2)::BIGINT END AS n_needed FROM g, (SELECT unnest([0.01, 0.02, 0.05])::DOUBLE AS target)")
def _(spark, sf_dir):
    return power.required_n(_power(spark, sf_dir), [0.01, 0.02, 0.05]).select("temp", "target", "n_needed")


# ------------------------------------------------------------------------ regressions

def _long(spark, sf_dir):
    p = X.predictions(spark, sf_dir)
    return p.withColumn("binary_correct", (F.col("em") >= 0.5).cast("int")).withColumn("f1", F.when(F.col("type") == "open", F.col("f1")))


@query("q_ols", f"""WITH {X.PREDS}, d AS (SELECT item_key, f1, (condition = 'treatment')::INTEGER AS x FROM preds WHERE type = 'open' AND temp = 0.0)
SELECT 'intercept' AS term, round(regr_intercept(f1, x), 8) AS coef FROM d UNION ALL SELECT 'treatment', round(regr_slope(f1, x), 8) FROM d""")
def _(spark, sf_dir):
    """At one temperature the other terms are combinations and left out."""
    return _rounded(models.ols_cluster_robust(_long(spark, sf_dir).where("type = 'open' and temp = 0.0")).select("term", "coef"), "coef", digits=8)


_OLS = f"""WITH {X.PREDS}, d AS (SELECT item_key, f1 AS y, (condition = 'treatment')::INTEGER AS x, temp FROM preds WHERE type = 'open'), a AS (SELECT avg(temp) AS m, count(*) AS n, count(DISTINCT item_key) AS g FROM d),
cell AS (SELECT x, temp, avg(y) AS mean, count(*) AS k FROM d GROUP BY x, temp),
l AS (SELECT x, temp, mean, k, CASE WHEN temp = 0 THEN (0.7 - m) / 0.7 ELSE m / 0.7 END AS level, CASE WHEN temp = 0 THEN -1 / 0.7 ELSE 1 / 0.7 END AS slope FROM cell, a),
term AS (SELECT 'intercept' AS term, x, temp, mean, k, CASE WHEN x = 0 THEN level ELSE 0 END AS c FROM l UNION ALL SELECT 'treatment', x, temp, mean, k, CASE WHEN x = 1 THEN level ELSE -level END FROM l
  UNION ALL SELECT 'temp_c', x, temp, mean, k, CASE WHEN x = 0 THEN slope ELSE 0 END FROM l UNION ALL SELECT 'treatment_temp', x, temp, mean, k, CASE WHEN x = 1 THEN slope ELSE -slope END FROM l),
s AS (SELECT term, item_key, sum(c / k * (y - mean)) AS s FROM d JOIN term USING (x, temp) GROUP BY term, item_key),
v AS (SELECT term, sum(s * s) * g / (g - 1) * (n - 1) / (n - 4) AS v FROM s, a GROUP BY term, g, n), b AS (SELECT term, sum(c * mean) AS coef FROM term GROUP BY term)"""


@query("q_ols_full", f"{_OLS} SELECT term, round(coef, 7) AS coef, round(sqrt(v), 7) AS se, round(coef - 1.96 * sqrt(v), 7) AS ci_low, round(coef + 1.96 * sqrt(v), 7) AS ci_high, round({two_sided('coef / sqrt(v)')}, 6) AS p FROM b JOIN v USING (term)")
def _(spark, sf_dir):
    """Two temperatures make the terms combinations of four cell means, which SQL can tell with their errors by cluster."""
    o = models.ols_cluster_robust(_long(spark, sf_dir).where("type = 'open'"))
    return _rounded(_rounded(o.select("term", "coef", "se", "ci_low", "ci_high", "p"), "coef", "se", "ci_low", "ci_high", digits=7), "p", digits=6)


@query("q_gee")
def _(spark, sf_dir):
    return models.gee_logistic(_long(spark, sf_dir))


@query("q_gee_independent", f"""WITH {X.PREDS}, p AS (SELECT condition, avg((em >= 0.5)::INTEGER) AS p FROM preds WHERE temp = 0.0 GROUP BY condition), c AS (SELECT ln(p / (1 - p)) AS l FROM p WHERE condition = 'control'), t AS (SELECT ln(p / (1 - p)) AS l FROM p WHERE condition = 'treatment')
SELECT 'intercept' AS term, round(l, 7) AS coef FROM c UNION ALL SELECT 'treatment', round(t.l - c.l, 7) FROM c, t""")
def _(spark, sf_dir):
    """With two groups and no correlation the coefficients are the groups' log odds."""
    return _rounded(models.gee_logistic(_long(spark, sf_dir).where("temp = 0.0"), exchangeable=False).select("term", "coef"), "coef", digits=7)
