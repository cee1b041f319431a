import math

from pyspark.sql import functions as F

from vellumark.operators import decisions as D
from vellumark.operators import features as Q
from vellumark.operators import guards as G
from vellumark.operators import stress as S
from vellumark.operators import validation as V


def nested(spark, questions):
    return spark.createDataFrame([(1, questions)], f"k int, questions {Q.NESTED}")


def test_disagreement_by_hand(spark):
    a = lambda t, kind="Extractive", m="web": (t, kind, None, m, None)
    df = nested(spark, [("q1", [a("Yes.", "Boolean"), a("no", "boolean", "pdf")]), ("q2", [a("the crane never stood")]), ("q3", None)])
    r = df.select(*(c.alias(n) for n, c in Q.disagreement(F.col("questions")).items())).first()
    assert (r["n_questions"], r["n_answers"], r["answers_per_question"]) == (3, 3, 1) and r["multi_answer_share"] == 1 / 3 and r["yes_and_no"] == 1
    assert r["negated_share"] == 2 / 3 and r["negation_mixed"] == 1 and r["media_share"] == 2 / 3 and r["mean_distance"] == 1 and r["unique_share"] == 1
    empty = nested(spark, None).select(*(c.alias(n) for n, c in Q.disagreement(F.col("questions")).items())).first()
    assert set(empty) == {0.0}


def test_mean_distance_counts_equal_sets(spark):
    df = spark.createDataFrame([([["a", "b"], ["b", "a"], ["c"]],)], "s array<array<string>>")
    assert abs(df.select(Q.mean_distance(F.col("s"))).first()[0] - 2 / 3) < 1e-12


def test_provenance_features(spark):
    rows = [(1, "https://a.org/x", "same words", None), (1, "http://www.a.org/y/", "Same words!", None), (1, "https://web.archive.org/web/2001/https://b.org/", "other", None), (1, None, "", "cached")]
    r = Q.provenance(spark.createDataFrame(rows, "k int, u string, a string, c string"), "k", F.col("u"), F.col("a"), F.col("c")).first()
    assert (r["n_answers"], r["n_families"], r["largest_family"], r["repeated_share"], r["missing_share"], r["archive_share"]) == (4, 2, 0.5, 0.5, 0.25, 0.5)
    assert r["duplicate_answer_share"] == 0.25 and abs(r["family_entropy"] - -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))) < 1e-12


def test_score_features_use_population_deviation(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8, 0.0]), (1, [0.6, 0.2, 0.2])], "k int, s array<double>")
    r = Q.score_features(df, "k", "s").first()
    assert abs(r["std_entailment"] - 0.3) < 1e-12 and r["max_contradiction"] == 0.6 and abs(r["clash"] - 0.48) < 1e-12 and r["n_evidence"] == 2


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "red crane red"), (2, "red mill"), (3, "crane mill"), (4, None)], "d int, t string")
    got = Q.tfidf(df, "d", "t").groupBy("d").agg(F.sum(F.col("weight") * F.col("weight")).alias("l")).collect()
    assert {r["d"] for r in got} == {1, 2, 3} and all(abs(r["l"] - 1) < 1e-9 for r in got)


DOCS = "id int, text string, language string, source_rank int, is_primary boolean, provenance_family_id string"


def check(spark, docs, **settings):
    claims = spark.createDataFrame([("c", "crane stood at Orla", "en"), ("blank", " ", "en"), ("far", "zzz", "en")], "claim_id string, claim string, language string")
    score = lambda c, t: F.array(F.lit(0.1), F.lit(0.8), F.lit(0.1))
    return {r["claim_id"]: r for r in D.verify_claims(claims, spark.createDataFrame(docs, DOCS), score, D.Check(**settings)).collect()}


def test_verify_claims(spark):
    docs = [(1, "the crane stood at Orla", "EN", 1, True, "A"), (2, "The crane  stood at Orla", "en", 2, False, None), (3, "Orla crane", "en", 3, None, "B"), (4, "crane at Orla", "de", 1, True, "C"), (5, "crane", "en", None, False, "B")]
    r = check(spark, docs)
    assert "blank" not in r and r["c"]["label"] == "Supported" and r["c"]["evidence"] == [1, 3] and (r["c"]["n_copies"], r["c"]["n_wrong_language"]) == (2, 1)
    assert r["far"]["label"] is None and r["far"]["reasons"][0] == "no_compatible_evidence"
    assert "no_primary_source" in check(spark, docs[2:3], need_primary=True)["c"]["reasons"] and "too_few_components" in check(spark, docs[:2])["c"]["reasons"]


def test_copies_do_not_change_the_label(spark):
    docs = [(1, "the crane stood at Orla", "en", 1, True, "A"), (3, "Orla crane", "en", 3, None, "B")]
    more = docs + [(10 + i, "the crane stood at Orla", "en", 1, True, "A") for i in range(20)]
    a, b = check(spark, docs)["c"], check(spark, more)["c"]
    assert (a["label"], a["evidence"], a["stance_scores"]) == (b["label"], b["evidence"], b["stance_scores"])


def test_rules(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2], [0.5, 1.5], "A", "A", 0.9, []), ([0.1, 0.2, 0.7], None, "A", "B", None, ["x"])], "p array<double>, x array<double>, a string, b string, g double, r array<string>")
    rows = df.select(D.first_best(F.col("p")), D.prior_adjusted(F.col("p"), [0.8, 0.1, 0.1], 1.0), D.agreement(F.col("a"), F.col("b")), D.apply_gate(F.col("a"), F.col("g"), F.col("r"), 0.5), D.logistic_head(F.col("x"), [1], [0.5], [2.0], [2.0], -1.0), D.masked(F.col("x"), [7.0, 8.0], [0])).collect()
    assert tuple(rows[0]) == ("Supported", 2, "A", "A", 0.5, [7.0, 1.5]) and tuple(rows[1])[:4] == ("Not Enough Evidence", 3, None, None)


def test_evidence_decision(spark):
    rows = [(1, 0, [0.1, 0.8, 0.1]), (1, 1, [0.1, 0.8, 0.1]), (2, 0, [0.9, 0.05, 0.05]), (2, 1, [0.1, 0.8, 0.1]), (3, 0, [0.4, 0.3, 0.3])]
    got = {r["k"]: (r["label"], r["position"]) for r in D.evidence_decision(spark.createDataFrame(rows, "k int, i int, s array<double>"), "k", "i", "s").collect()}
    assert got == {1: ("Supported", 0), 2: ("Not Enough Evidence", None), 3: ("Not Enough Evidence", None)}


def test_noise_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([("k", "a lone crane stood over the old mill at Orla" * 3), ("k", ""), ("k", "xyz"), ("k", None)], "k string, t string")
    scan = [r[0] for r in df.select(S.scan_noise(F.col("t"), F.col("k"))).collect()]
    before = "a lone crane stood over the old mill at Orla" * 3
    assert sum(a != b for a, b in zip(scan[0], before)) == math.ceil(len(before) * 0.02) and scan[1:] == ["", "xyz", ""]
    rate = [r[0] for r in df.select(S.rate_noise(F.col("t"), F.col("k"), 0.1)).collect()]
    n = sum(c.isalnum() for c in before)
    assert sum(a != b for a, b in zip(rate[0], before)) == round(0.1 * n) and len(rate[0]) == len(before)


def test_paraphrase(spark):
    df = spark.createDataFrame([("According to Ann, because it happened, Bob said that it is true",), ("plain",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(S.paraphrase(F.col("t"), 3)).collect()]
    assert got == [("As stated by Ann, because it occurred, Bob stated that it is true", 3), ("plain", 0), ("", 0)]
    assert df.select(S.paraphrase(F.col("t"), 1)).first()[0]["text"].startswith("As stated by Ann, because")


def test_copies_and_collapse_cancel(spark):
    df = spark.createDataFrame([([("https://a.org/1", "x"), ("https://b.org/1", "y"), ("https://a.org/2", "z")],), ([],)], "e array<struct<source_url:string,text:string>>")
    got = [[x["text"] for x in r[0]] for r in df.select(S.inject_copies(F.col("e"), "source_url", 2)).collect()]
    assert got == [["x", "y", "z", "x", "x"], []]


def test_copies_are_of_the_whole_records_dominant_source(spark):
    rows = [(1, f"e{i:03}", f"https://{'abc'[i % 3] if i < 150 else 'd'}.org/{i}") for i in range(250)]  # d has 100 rows, the others 50 each
    rows += [(2, "x", "https://q.org/1"), (2, "y", "https://p.org/1"), (2, "z", None), (2, "zz", ""), (2, "zzz", ""), (3, "n", None), (None, "o", "https://q.org/2")]
    got = S.with_copies(spark.createDataFrame(rows, "r int, e string, u string").repartition(7), "r", "u", ["e", "u"], 5).collect()
    assert sorted((r["r"] or 0, r["e"], r["copy"]) for r in got if r["copy"]) == [(k, e, i) for k, e in ((1, "e150"), (2, "x")) for i in range(1, 6)]
    assert sorted(((r["r"] or 0), r["e"]) for r in got if not r["copy"]) == sorted((r[0] or 0, r[1]) for r in rows)


def test_donors_take_the_least_shared(spark):
    rows = [(i, "c", [f"e{i % 3}", f"f{i}"]) for i in range(12)] + [(99, "alone", ["z"])]
    got = {r["r"]: r for r in S.donors(spark.createDataFrame(rows, "r int, c string, ids array<string>"), "r", "c", "ids").collect()}
    assert set(got) == set(range(12)) and all(r["donor"] != k and r["shared"] == 0 for k, r in got.items())


def test_donors_are_the_least_of_the_whole_cohort(spark):
    rows = [(i, "c", ["hot", f"x{i % 3}"] if i != 17 else ["rare"]) for i in range(60)] + [(100 + i, "d", ["all", f"y{i % 2}"]) for i in range(20)] + [(200 + i, "e", ["p", "q"]) for i in range(3)]
    got = {r["r"]: r for r in S.donors(spark.createDataFrame(rows, "r int, c string, ids array<string>"), "r", "c", "ids").collect()}
    least = {r: min(len({*a} & {*b}) for q, d, b in rows if d == c and q != r) for r, c, a in rows}
    held = {r: {*a} for r, _, a in rows}
    assert {r: x["shared"] for r, x in got.items()} == least and all(len(held[r] & held[x["donor"]]) == least[r] and r != x["donor"] for r, x in got.items())


def test_guards(spark):
    corpus = spark.createDataFrame([("a", "The whole text"), ("b", "Other")], "id string, t string")
    shown = spark.createDataFrame([(1, "a", "the  whole"), (2, "a", "whole"), (2, "b", "Other"), (3, "x", "y")], "k int, id string, t string")
    got = {r["k"]: (r["n"], r["known"], r["prefix"], r["bound"]) for r in G.passage_trace(shown, "k", "id", "t", corpus, "id", "t").collect()}
    assert got == {1: (1, 1, 1, True), 2: (2, 2, 1, False), 3: (1, 0, 0, False)}
    df = spark.createDataFrame([("S", ["a"], [("a", "x"), ("b", "y")]), (None, [], []), ("S", ["q"], [("a", " ")])], "l string, c array<string>, e array<struct<id:string,text:string>>")
    got = [r[0] for r in df.select(G.evidence_display(F.col("l"), F.col("c"), F.col("e"))).collect()]
    assert [x["excerpt"] for x in got[0]["shown"]] == ["x"] and got[1]["reasons"] == ["abstained", "no_citation"] and got[2]["reasons"] == ["unknown_citation"]


def test_validation(spark):
    df = spark.createDataFrame([("EDGE-1", "EVID-1", " evid-1", "a;b", "low"), ("EDGE-2", "EVID-1", "EVID-2", "a", "sure"), ("EDGE-2", "EVID-1", "EVID-3", "a;b;zz", None)], "edge_id string, child_evidence_id string, parent_evidence_id string, dependency_signals string, confidence string")
    got = sorted((r["edge_id"], r["errors"]) for r in V.validate(df, "edge_id", V.edge_rules(["a", "b"])).collect())
    assert got == [("EDGE-1", ["no_loop"]), ("EDGE-2", ["known_signals", "confidence", "unique_key"]), ("EDGE-2", ["two_signals", "confidence", "unique_key"])]
    p = spark.createDataFrame([([0.5, 0.5],), ([0.7, 0.2],), ([1.5, -0.5],), (None,)], "p array<double>")
    assert [r[0] for r in p.select(V.valid_distribution(F.col("p"))).collect()] == [True, False, False, False]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k int, v string")
    assert tuple(V.align(a, b, ["k"], ["v"]).first()) == (2, 0, 1, 1)
    m = spark.createDataFrame([("a", "0" * 64), ("../b", "0" * 64), ("c", "xyz"), ("d", "1" * 64), ("e", "2" * 64)], "path string, sha256 string")
    f = spark.createDataFrame([("a", "0" * 64), ("d", "f" * 64)], "path string, sha256 string")
    assert {r["path"]: r["status"] for r in V.manifest_audit(m, f).collect()} == {"a": "ok", "../b": "unsafe_path", "c": "bad_digest", "d": "changed", "e": "missing"}


def test_json_differences(spark):
    a = spark.createDataFrame([("k", '{"x": 1.0, "y": [true, "s"]}'), ("bad", "{")], "k string, j string")
    b = spark.createDataFrame([("k", '{"x": 1.000001, "y": [1, "s"], "z": null}')], "k string, j string")
    assert sorted(r["path"] for r in V.json_differences(a, b, "k", "j").collect()) == ["$.y[0]", "$.z"]
