from pyspark.sql import functions as F

from vellumark.functions import arrow as A
from vellumark.operators import models as M


def test_arrow_text():
    assert A.compatible("Ｆｕｌｌ  STRAẞE\n") == "full strasse" and A.compatible_words("ﬁve, ²x_y") == "five 2x_y"
    assert A.canonical_numbers("1.50 1.5 -5 +5 1e-3 [9] 20°C") == " ".join(sorted({"1.5", "-5", "5", "0.001", "2E+1"}))
    assert A.canonical_numbers("1. first\n2) second 7km NFAT4 5mmol/L 3x 1990.") == "5 7"


def test_text_model_and_prediction(spark):
    rows = [(i, ["red", "crane"] if i % 3 else ["old", "mill"], "A" if i % 3 else "B") for i in range(60)] + [(99, ["mill"], None)]
    df = spark.createDataFrame(rows, "i int, w array<string>, y string")
    model = M.fit_text_model(df, "w", "y", features=64)
    assert M.predict(model, df.where("y is not null")).where("y <> label_predicted").count() == 0
    w = M.balanced(df.where("y is not null"), "y").groupBy("y").agg(F.round(F.sum("weight"), 6).alias("s")).collect()
    assert {r["s"] for r in w} == {30.0}


def test_cross_fit(spark):
    df = spark.createDataFrame([(i, (i % 10) / 10 + 0.05, i % 10 > 4) for i in range(200)], "i int, p double, ok boolean")
    got = M.cross_fitted(df, "i", "p", F.col("ok")).toPandas()
    assert len(got) == 200 and got[got.p > 0.7].calibrated.min() > 0.8 and got[got.p < 0.3].calibrated.max() < 0.2
    one = M.cross_fitted(df.where("ok"), "i", "p", F.col("ok")).first()
    assert one["calibrated"] == one["prevalence"] > 0.9


def test_length_matched_without_reuse(spark):
    cand = spark.createDataFrame([("p1", "g1", "s1", 3), ("p1", "g1", "s2", 3), ("p2", "g2", "s3", 3), ("p2", "g2", "s4", 3), ("p3", "g3", "s5", 4), ("p1", "g1", "s6", 9)], "p string, g string, k string, n int")
    got = {tuple(r) for r in M.length_matched(cand.where("k in ('s1', 's2', 's3', 's6')"), cand, "p", "g", "n", "k").collect()}
    assert got == {("p1", "s1", "s3"), ("p1", "s2", "s4"), ("p2", "s3", "s1")}
    assert M.length_matched(cand.limit(0), cand, "p", "g", "n", "k").count() == 0


def test_small_rules(spark):
    r = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    c = spark.createDataFrame([("old", 2, "1"), ("new", 1, "1"), ("x", 1, "9")], "source string, priority int, sha256 string")
    assert {tuple(x) for x in M.restore_plan(r, c).collect()} == {("a", "new"), ("b", None)}
    d = spark.createDataFrame([("Who built the mill?", "Ann."), ("Where is it?", "Orla"), ("Who is Bob?", "A clerk")], "q string, a string")
    assert [x[0] for x in d.select(M.declarative(F.col("q"), F.col("a"))).collect()] == ["Ann built the mill.", "Where is it: Orla.", "Who is Bob: A clerk."]
    t = spark.createDataFrame([([[1, 2], [1, 3, 4], [5]], [1]), ([[1, 2]], [1, 2]), ([[1, 2]], [9])], "s array<array<int>>, p array<int>")
    assert [x[0] for x in t.select(M.allowed_next(F.col("s"), F.col("p"), -1)).collect()] == [[2, 3], [-1], []]
    g = spark.createDataFrame([("abcd ef",), ("",)], "t string").select(M.char_grams(F.col("t"), 3, 4)).collect()
    assert g[0][0] == [" ab", "abc", "bcd", "cd ", " ef", "ef ", " abc", "abcd", "bcd ", " ef "] and g[1][0] == []
    v = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (2, 0)], "c int, i int")
    assert {tuple(x) for x in M.next_variant(v, "c", "i", 4).collect()} == {(1, 0, 1), (1, 3, 0)}
    m = spark.createDataFrame([("k", "Has LABEL", None), ("n", None, "none")], "k string, a string, b string")
    assert [tuple(x) for x in M.leaks_markers(m, "k", ["a", "b"], ["label", "zz"]).collect()] == [("k", "label")]
