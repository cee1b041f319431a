import subprocess
import sys

from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.operators import decisions as D
from vellumark.operators import grouping as G
from vellumark.operators import guards as U
from vellumark.operators import metrics as M
from vellumark.operators import stress as S
from vellumark.operators import validation as V
from vellumark.tables import Cut, hot_keys, join_on_unique, shared_dir, words


def test_likelihood_and_stages(spark):
    df = spark.createDataFrame([([[-1.0, -1.0], [-1.5]],), ([[], [-3.0]],)], "l array<array<double>>")
    got = [tuple(r[0]) for r in df.select(D.likelihood_choice(F.col("l"), ["a", "b"])).collect()]
    assert got == [("b", "a"), ("a", "a")]
    rows = [([], 0.9, "S", True, True), ([], 0.9, "S", True, False), ([], 0.9, None, True, True), (["x"], 0.9, "S", True, True), (None, None, "S", None, None)]
    df = spark.createDataFrame(rows, "r array<string>, p double, a string, e boolean, n boolean")
    got = [(r[0]["label"], len(r[0]["stages"])) for r in df.select(D.stages_of(F.col("r"), F.col("p"), 0.5, F.col("a"), F.col("e"), F.col("n"))).collect()]
    assert got == [("S", 5), (None, 5), (None, 3), (None, 2), (None, 2)]
    s = spark.createDataFrame([([0.1, 0.8, 0.1],), ([0.2, 0.7, 0.6],)], "s array<double>")
    assert [r[0] for r in s.select(D.explanation_passes(F.col("s"))).collect()] == [True, False]


def test_contexts_and_names(spark):
    df = spark.createDataFrame([(1, "c", [("a", "the mill at Orla"), ("b", None)])], "r int, c string, e array<struct<id:string,text:string>>")
    got = {r["condition"]: [x["text"] for x in r["evidence"]] for r in S.stressed_contexts(df, "r", "c", "e").collect()}
    assert set(got) == {"baseline", "ocr_noise", "fabricated_citation", "authoritative_wording", "evidence_absent"} and got["evidence_absent"] == [] and got["baseline"] == ["the mill at Orla", None]
    assert got["fabricated_citation"][0].startswith("Archive reference: SYNTHETIC-ARCHIVE-") and got["authoritative_wording"][1].endswith("authoritative. ")
    v = df.select(*(c.alias(n) for n, c in S.context_variants(F.transform("e", lambda x: x["id"])).items())).first()
    assert (v["baseline"], v["copies"], v["reversed"]) == (["a", "b"], ["a", "b", "a", "a", "a"], ["b", "a"])
    t = spark.createDataFrame([("k", ["Fen", "met", "Holt", "Holt"])], "k string, t array<string>").select(S.placeholder_names(F.col("t"), F.col("k"))).first()[0]
    assert t[:2] == ["Fen", "met"] and t[2] == t[3] != "Holt"


def test_swapped_contexts_of_every_record(spark, tmp_path):
    from vellumark.plans.decision_queries import QUERIES

    rows = [(1, 1, "k", "full_gate", [("a", "one")]), (2, 1, "k", "ungated", [("a", "one")]), (3, 2, "k", "ungated", [("b", "two"), ("c", "three")])]
    spark.createDataFrame([(p, r, c, o, e, "claim") for p, r, c, o, e in rows], "prediction_id long, record_index long, cohort string, policy string, evidence array<struct<id:string,text:string>>, claim string").write.parquet(f"{tmp_path}/predictions.parquet")
    got = {(r["prediction_id"], r["condition"]): r["n_evidence"] for r in QUERIES["stressed_contexts"](spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[1, "swapped_context"] == 2 and got[3, "swapped_context"] == 1 and got[3, "baseline"] == 2


def test_keys_of_many_policies_are_expected(spark, tmp_path):
    from vellumark.plans.decision_queries import QUERIES

    rows = [(i, 1, f"p{i}") for i in range(100)] + [(100, 2, "p0")]
    spark.createDataFrame(rows, "prediction_id long, record_index long, policy string").write.parquet(f"{tmp_path}/predictions.parquet")
    got = {(r["record_index"], r["policy"], r["problem"]) for r in QUERIES["expected_keys"](spark, str(tmp_path)).collect()}
    assert got == {(2, f"p{i}", "missing") for i in range(1, 100)}


def test_pool_conflicts_and_families(spark):
    df = spark.createDataFrame([(1, "A  b", "x"), (2, "a B", "y"), (3, " ", "x"), (4, None, None)], "i int, t string, l string")
    assert [r["text"] for r in G.pool(df, "t").collect()] == ["A  b"]
    kept = G.without_conflicts(df.where("l is not null").withColumn("n", X.normal_claim("t")), ["n"], "l", "i").collect()
    assert [(r["n"], r["i"]) for r in kept] == [("", 3)]
    fam = spark.createDataFrame([(1, "r", "f"), (2, "r", "f"), (3, "r", ""), (4, "r", ""), (5, "q", "f")], "i int, r string, f string")
    assert sorted(r["i"] for r in G.collapse_families(fam, "r", F.col("f"), [F.asc("i")]).collect()) == [1, 3, 4, 5]
    assert sorted(r["i"] for r in G.first_per(fam, ["r"], [F.desc("i")]).collect()) == [4, 5]


def test_binding_admission_and_orphans(spark):
    df = spark.createDataFrame([(1, "https://a.org", "The crane page", "crane"), (2, "http://a.org", "x", "x"), (3, "https://a.org", "no such", "absent"), (4, None, None, None)], "k int, u string, p string, x string")
    got = {r["k"]: r["failure"] for r in U.source_binding(df, "k", F.col("u"), F.array(F.lit("the")), F.col("p"), F.sha2(X.text("p"), 256), F.col("x")).collect()}
    assert got == {1: None, 2: "unsafe_url", 3: "missing_anchor", 4: "unsafe_url"}
    shown, members = spark.createDataFrame([(1, "p", "a"), (1, "p", "b"), (2, "q", "a")], "r int, p string, i string"), spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "b")], "p string, i string")
    assert {r["r"]: r["admitted"] for r in U.pool_admission(shown, "r", "p", "i", members, "p", "i").collect()} == {1: True, 2: False}
    assert [r["i"] for r in V.orphans(shown.where("r = 2").union(spark.createDataFrame([(3, None, None)], shown.schema)), F.col("p"), members, F.col("p")).collect()] == ["a"]


def test_summaries(spark):
    df = spark.createDataFrame([("c", "p", "A", "A"), ("c", "p", "A", None), ("d", "p", "A", "B")], "c string, p string, t string, y string")
    got = {(r["c"], r["p"]): (r["n"], r["coverage"], r["covered_accuracy"]) for r in M.coverage_summary(df, [["c", "p"], ["p"]], "t", "y").collect()}
    assert got[None, "p"] == (3, 2 / 3, 0.5) and got["c", "p"] == (2, 0.5, 1.0) and got["d", "p"] == (1, 1.0, 0.0)
    t = M.transitions(df.withColumn("z", F.lit("A")), ["p"], "t", "y", "z").first()
    assert (t["corrected"], t["new_errors"], t["right_in_both"], t["flips"]) == (2, 0, 1, 2)
    s = M.shift_summary(spark.createDataFrame([("g", 0.2, 0.5), ("g", 0.5, 0.4)], "g string, a double, b double"), ["g"], "a", "b").first()
    assert abs(s["mean_shift"] - 0.1) < 1e-12 and abs(s["max_abs_shift"] - 0.3) < 1e-12


def test_salted_join_equals_the_plain_one(spark, monkeypatch):
    import vellumark.tables as t

    monkeypatch.setattr(t, "HOT_ROWS", 20)
    many = spark.createDataFrame([(i % 7 if i % 3 else 1, i) for i in range(300)] + [(None, -1)], "k int, v int")
    one = spark.createDataFrame([(k, k * 10) for k in range(5)], "k int, w int")
    assert hot_keys(many, "k") != []
    for how in ("inner", "left"):
        plain = sorted(map(tuple, many.join(one, "k", how).collect()), key=str)
        assert sorted(map(tuple, join_on_unique(many, one, "k", how).select("k", "v", "w").collect()), key=str) == plain


def test_cut_and_words(spark):
    c = Cut(spark.createDataFrame([(1, "Ab, cd-e_f"), (2, None)], "i int, t string"))
    assert c.path.startswith(shared_dir(spark)) and [r[0] for r in c.df.orderBy("i").select(words("t")).collect()] == [["ab", "cd", "e", "f"], []]
    c.drop()


def test_core_imports_alone():
    code = "import sys; sys.modules['vellumark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])
