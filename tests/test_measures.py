import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellumark.operators import inference as I
from vellumark.operators import metrics as M
from vellumark.operators import sampling as S


def test_ece_and_reliability(spark):
    df = spark.createDataFrame([("g", 0.8, True), ("g", 0.6, False), ("g", 1.0, True), ("g", None, True)], "g string, s double, ok boolean")
    two = df.where("s < 1")
    assert abs(M.calibration_error(two, ["g"], "s", F.col("ok"), 5).first()["ece"] - 0.4) < 1e-12
    assert {r["bin"]: r["n"] for r in M.reliability(df, ["g"], "s", F.col("ok"), 5).collect()} == {4: 2, 3: 1}


def test_macro_scores(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("B", None)], "t string, p string").withColumn("g", F.lit(1))
    r = M.macro(M.confusion(df.where("p is not null"), ["g"], "t", "p"), ["g"], ["A", "B"]).first()
    assert abs(r["macro_f1"] - (2 / 3 + 0.8) / 2) < 1e-12 and r["balanced_accuracy"] == 0.75
    assert abs(M.macro(M.confusion(df, [], "t", "p"), [], ["A", "B", "C"]).first()["accuracy"] - 0.6) < 1e-12


def test_risk_coverage_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, round(rng.random(), 2), rng.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, s double, ok boolean")
    got = {r["g"]: r["aurc"] for r in M.aurc(df, ["g"], "s", "i", F.col("ok")).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        bad, risks = 0, []
        for k, r in enumerate(own, 1):
            bad += not r[3]
            risks.append(bad / k)
        assert abs(got[g] - sum(risks) / len(risks)) < 1e-9
    top = M.at_coverage(df, ["g"], "s", "i", F.col("ok"), [0.0, 1.0]).where("g = 'a'").orderBy("target").collect()
    assert top[0]["k"] == 1 and top[1]["k"] == sum(r[0] == "a" for r in rows)


def test_auc_and_ap(spark):
    df = spark.createDataFrame([("g", 0.9, True), ("g", 0.8, False), ("g", 0.8, True), ("g", 0.1, False), ("h", 0.5, True)], "g string, s double, y boolean")
    got = {r["g"]: r for r in M.ranking_quality(df, ["g"], "s", F.col("y")).collect()}
    assert abs(got["g"]["roc_auc"] - 3.5 / 4) < 1e-12 and got["h"]["roc_auc"] is None and got["h"]["average_precision"] == 1


def test_retrieval_quality(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q int, d int, r int")
    rel = spark.createDataFrame([(1, 11), (1, 99), (1, 11), (2, 5)], "q int, d int")
    got = {r["q"]: r for r in M.retrieval_quality(found, rel, "q", "d", "r", 10).collect()}
    assert got[1]["recall"] == 0.5 and got[1]["reciprocal_rank"] == 0.5 and not got[2]["hit"] and got[2]["ndcg"] == 0


def test_trapezoid_and_certainty(spark):
    df = spark.createDataFrame([("g", float(x), float(x)) for x in range(5)], "g string, x double, y double")
    assert M.trapezoid(df, ["g"], "x", "y").first()["area"] == 2
    p = spark.createDataFrame([([1.0, 0.0, 0.0],), ([1 / 3] * 3,)], "p array<double>")
    assert [round(r[0], 9) for r in p.select(M.certainty(F.col("p"))).collect()] == [1, 0]


def test_holm(spark):
    df = spark.createDataFrame([(0, 0.03), (1, 0.01), (2, 0.9)], "i int, p double").withColumn("g", F.lit(1))
    assert [round(r["adjusted"], 12) for r in I.holm(df, ["g"], "p", "i").orderBy("i").collect()] == [0.06, 0.03, 0.9]


def test_sign_swap_exact_and_sampled(spark):
    d = [0.5, -0.2, 0.7, 0.0, 0.3]
    df = spark.createDataFrame(list(enumerate(d)), "group_id int, d double")
    r = I.sign_swap(df, "d").first()
    live = [x for x in d if x]
    sums = [abs(sum(s * x for s, x in zip(signs, live))) for signs in itertools.product([1, -1], repeat=4)]
    assert r["n_groups"] == 4 and abs(r["p_value"] - sum(s >= abs(sum(live)) - 1e-12 for s in sums) / 16) < 1e-12
    approx = I.sign_swap(df, "d", most_exact=2, replicates=500).first()
    assert not approx["exact"] and abs(approx["p_value"] - r["p_value"]) < 0.1
    assert I.sign_swap(df.limit(0), "d").first()["p_value"] == 1


def test_bootstrap_and_calibration(spark):
    g = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(40)], "group_id int, v double, w double")
    r = I.bootstrap(g, "v", "w", "s", 100).first()
    assert r["estimate"] == 0.5 and 0.25 < r["low"] < 0.5 < r["high"] < 0.75
    rows = spark.createDataFrame([(x / 10, x > 3 if x % 3 else x <= 3) for x in range(-20, 20)], "x double, y boolean")
    w, b = I.fit_logit(rows, F.col("x"), F.col("y"))
    assert w > 0 and abs(w) < 10 and abs(b) < 10
    logits = spark.createDataFrame([([4.0, 0.0], 1 if i % 10 else 2) for i in range(100)], "l array<double>, t int")
    assert 1.4 < I.fit_temperature(logits, "l", "t") < 2.3


def test_thresholds(spark):
    df = spark.createDataFrame([("g", i, i / 10, i >= 6) for i in range(10)], "g string, i int, s double, y boolean")
    best = I.choose_threshold(I.threshold_scores(df, ["g"], "s", F.col("y"), [i / 10 for i in range(1, 10)]), ["g"]).first()
    assert best["threshold"] == 0.6 and best["macro_f1"] == 1
    c = I.covering_threshold(df, ["g"], "s", "i", F.col("y"), 0.2, 2).first()
    assert (c["threshold"], c["answered"]) == (0.5, 5)
    assert I.covering_threshold(df, ["g"], "s", "i", F.col("y"), 0.0, 9).first()["threshold"] == 1.01


def test_folds_splits_and_samples(spark):
    df = spark.createDataFrame([(f"id{i}", i % 3, "t%d" % (i // 2)) for i in range(101)] + [(None, 0, "x"), ("id5", 5 % 3, "t2")], "id string, g int, text string")
    f = S.folds(df, "id", 5, "s").toPandas()
    assert sorted(f.fold.value_counts()) == [20, 20, 20, 20, 21]
    cut = S.cut_by_order(df, "id", {"a": 0.7, "b": 0.3}, "s").toPandas()
    assert cut.split.value_counts().to_dict() == {"a": 71, "b": 30}
    assert S.hash_sample(df, "id", 7, "s").count() == 7 and S.hash_sample(df, "id", 500, "s", F.col("text")).count() == 51
    assert S.stratified_sample(df, "id", ["g"], 4, "s").count() == 12


def test_disjoint_selection_is_the_sequential_pass(spark):
    rng = random.Random(3)
    keys = [(i, rng.randrange(25)) for i in range(40) for _ in range(rng.randrange(0, 3))]
    taken, used = [], set()
    for i in range(40):
        own = {k for j, k in keys if j == i}
        if not own & used:
            taken.append(i)
            used |= own
    got = S.disjoint_selection(spark.createDataFrame([(i, i) for i in range(40)], "i int, o int"), "i", "o", spark.createDataFrame(keys, "i int, k int"), "k")
    assert sorted(r[0] for r in got.collect()) == taken


def test_exclusions(spark):
    w = lambda: F.split("t", " ")
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d x y"), (3, ""), (4, "q")], "i int, t string")
    prior = spark.createDataFrame([("a b c d e f",), (None,)], "t string")
    assert sorted(r["i"] for r in S.exclude_similar(df, "i", F.filter(w(), lambda x: x != ""), prior, w()).collect()) == [2, 3, 4]
    assert sorted(r["i"] for r in S.exclude(df, df.where("i = 4"), [F.col("t")], [F.col("t")]).collect()) == [1, 2, 3]


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_balanced_split(spark, share):
    df = spark.createDataFrame([(f"g{i}", "x" if i % 2 else "y", 1 + i % 5) for i in range(60)], "g string, l string, n int")
    got = S.balanced_split(df, "g", "l", "n", share, 60, "s").join(df, "g").groupBy("held_out").agg(F.sum("n").alias("n")).toPandas().set_index("held_out")["n"]
    assert abs(got[True] / got.sum() - share) < 0.1
