from pyspark.sql import functions as F

from evalloom.functions import text as T


def one(spark, **columns):
    return {k: v for k, v in spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict().items()}


def test_token_f1_and_best(spark):
    L = F.lit
    got = one(
        spark, same=T.token_f1(L("The cat!"), L("cat")), half=T.token_f1(L("red cat"), L("cat dog")), both=T.token_f1(L("the"), L("")), none=T.token_f1(L("x"), L("")),
        multi=T.token_f1(L("b b b"), L("b b")), best=T.best_f1(L("cat"), F.array(L("dog"), L("cat"))), empty=T.best_em(L(""), F.array().cast("array<string>")), em=T.exact_match(L("J. R. R. Tolkien"), L("jrr tolkien")),
    )
    assert got == {"same": 1.0, "half": 0.5, "both": 1.0, "none": 0.0, "multi": 0.8, "best": 1.0, "empty": 1.0, "em": False}


def test_abstention_modes(spark):
    L = F.lit
    cases = ["I don't know.", "can't answer", "It is unknown", "not provided in the passage", "Paris", None]
    for mode, want in (("reference", [False, False, True, False, False, False]), ("fixed", [True, True, True, True, False, False])):
        got = one(spark, **{f"c{i}": T.is_abstention(L(c).cast("string"), mode) for i, c in enumerate(cases)})
        assert list(got.values()) == want


def test_support(spark):
    L = F.lit
    got = one(
        spark, base=T.support_baseline(L("in France"), L("Paris is in France.")), blank=T.support_baseline(L(""), L("x")), share=T.support_overlap(L("paris x paris y"), L("Paris!")),
        nli=T.is_supported(L("paris is nice france"), L("Paris is in France"), "nli"), other=T.is_supported(L("a"), L("a"), "none"), gone=T.is_unsupported(L("zzz"), L("x"), L(1.0), 0.5), bad=T.is_unsupported(L("zzz"), L("x"), L(0.0), 0.5),
    )
    assert got == {"base": 1.0, "blank": 0.0, "share": 0.5, "nli": True, "other": False, "gone": 0.0, "bad": 1.0}


def test_labels_and_content(spark):
    L = F.lit
    got = one(spark, zero=T.temp_label(L(0.0)), seven=T.temp_label(L(0.7)), n=T.estimate_tokens(L("a b  c")), w=T.estimate_tokens(L("   ")), e=T.estimate_tokens(L("")), text=T.content_to_text(L('[{"type":"text","text":"a"},{"type":"text","text":"b"}]')), plain=T.content_to_text(L("hi")), state=T.job_state(L("job_state_running")), clean=T.clean_text(L(" a \n b c ")))
    assert got == {"zero": "0", "seven": "07", "n": 3, "w": 1, "e": 0, "text": "a\nb", "plain": "hi", "state": "RUNNING", "clean": "a b c"}


def test_bags_and_shares_against_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["x", "y", "zz", "The", "y.", "q-q", "é", ""]) for _ in range(rng.randrange(12)))
    rows = [(i, text(), text(), text()) for i in range(400)]
    d = spark.createDataFrame(rows, "i int, p string, t string, u string")
    got = d.select("i", T.token_f1(F.col("p"), F.col("t")).alias("f1"), T.best_f1(F.col("p"), F.array("t", "u")).alias("best"), T.support_overlap(F.col("p"), F.col("t")).alias("share"), T.normal_tokens(F.col("p")).alias("np"), T.normal_tokens(F.col("t")).alias("nt"), T.normal_tokens(F.col("u")).alias("nu"), T.word_tokens(F.col("p")).alias("wp"), T.word_tokens(F.col("t")).alias("wt")).collect()

    def f1(p, t):
        c = sum((Counter(p) & Counter(t)).values())
        return 1.0 if not p and not t else 2 * (c / len(p)) * (c / len(t)) / (c / len(p) + c / len(t)) if c else 0.0

    for r in got:
        assert abs(r.f1 - f1(r.np, r.nt)) < 1e-12 and abs(r.best - max(f1(r.np, r.nt), f1(r.np, r.nu))) < 1e-12
        assert abs(r.share - (sum(w in set(r.wt) for w in r.wp) / len(r.wp) if r.wp else 0.0)) < 1e-12


def test_long_texts_take_linear_time(spark):
    import random
    import time

    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(n)}" for _ in range(n))
    d = spark.createDataFrame([(text(20_000), text(20_000), text(100_000))], "p string, t string, c string").cache()
    d.count()
    for e in (T.token_f1(F.col("p"), F.col("t")), T.best_f1(F.col("p"), F.array("t", "p")), T.support_overlap(F.col("p"), F.col("c"))):
        d.select(e).first()  # compiled
        began = time.time()
        d.select(e).first()
        assert time.time() - began < 4  # a quadratic form takes minutes
    d.unpersist()


def test_strategies_of_ones_own(spark):
    import pandas as pd
    import pytest

    from evalloom.operators import power, score

    @F.pandas_udf("boolean")
    def longer(p: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([len(x) > k and x[:1] in y for x, y, k in zip(p, c, n)])

    T.register_support("longer", lambda p, c, least, n: longer(p, c, n), inputs=("least_length",))
    items = spark.createDataFrame([("open", "a|1", "xyz", ["x"], False, 2), ("open", "a|2", "xyz", ["x"], False, 9)], "type string, item_key string, context string, answers array<string>, is_unanswerable boolean, least_length int")
    preds = spark.createDataFrame([("open", f"a|{i}", c, "0.0", 0, t) for i in (1, 2) for c, t in (("control", "xylo"), ("treatment", "qq"))], "type string, item_key string, condition string, temp string, sample_index int, response_text string")
    got = {(r.item_key, r.condition): r.unsupported for r in score.score_predictions(preds, items, "longer").collect()}
    assert got == {("a|1", "control"): 0.0, ("a|1", "treatment"): 1.0, ("a|2", "control"): 1.0, ("a|2", "treatment"): 1.0}
    deltas = {r.item_key: r.delta for r in power.unsupported_sensitivity(preds, items, [0.5], "longer").collect()}
    assert deltas == {"a|1": 1.0, "a|2": 0.0}
    with pytest.raises(ValueError):
        score.score_predictions(preds, items.drop("least_length"), "longer")
