import pytest
from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.operators import inference as I
from vellumark.operators import sampling as S
from vellumark.operators import studies as T
from vellumark.operators import validation as V

ITEMS = "array<struct<id:string,text:string>>"


def test_generation_ends_at_the_first_failure(spark):
    rows = [
        (1, "c", [("a", "t")], 0.9, "Supported", "because", []), (2, "c", [], 0.9, "Supported", "x", []), (3, "c", [("a", "t")], 0.4, "Supported", "x", []), (4, "c", [("a", "t")], None, "maybe", "x", []),
        (5, "c", [("a", "t")], 0.5, "Refuted", "", ["7"]), (6, None, [(None, None)], None, "Refuted", None, []), (7, "c", [("a", "t")], None, None, "x", []),
    ]
    df = spark.createDataFrame(rows, f"i int, claim string, items {ITEMS}, gate double, v string, x string, absent array<string>")
    g = T.generation(F.col("claim"), F.col("items"), F.col("gate"), F.col("v"), F.col("x"), F.col("absent"))
    got = {r["i"]: r["g"] for r in df.select("i", g.alias("g")).collect()}
    assert got[1]["label"] == "Supported" and got[1]["stages"] == ["collapse_context", "gate", "verdict", "explanation", "numeric_check"] and got[1]["requests"] == ["verdict", "explanation"]
    assert got[2]["reasons"] == ["no_evidence"] and got[2]["stages"] == ["collapse_context", "gate"] and got[2]["verdict_prompt_sha256"] is None
    assert got[3]["reasons"] == ["gate_below_threshold"] and got[4]["reasons"] == ["invalid_verdict"] and got[4]["requests"] == ["verdict"] and got[7]["reasons"] == ["invalid_verdict"]
    assert got[5]["reasons"] == ["empty_explanation", "numeric_value_absent"] and got[6]["reasons"] == ["empty_explanation"] and all(got[i]["label"] is None for i in range(2, 8))
    plain = df.where("i = 1").select(T.generation(F.col("claim"), F.col("items"), F.col("gate"), F.col("v"), F.col("x"), None, collapse=False, explain=F.lit(False)).alias("g")).first()["g"]
    assert plain["stages"] == ["context_policy", "gate", "verdict"] and plain["label"] == "Supported"


def test_prompts_and_renderers(spark):
    df = spark.createDataFrame([("c", [("a", "t"), ("b", " ")]), (None, [])], f"claim string, items {ITEMS}")
    show = lambda name: [r[0] for r in df.select(T.RENDERERS[name](F.col("claim"), F.col("items"))).collect()]
    assert show("claim_only") == ["CLAIM: c", "CLAIM: "] and show("claim_plus_evidence") == ["CLAIM: c\nANSWER: t", "CLAIM: "]
    assert show("verdict")[0] == "Evidence: [a] t\n[b]  \nClaim: c\nReply only Supported, Refuted, or Not Enough Evidence."


def test_a_missing_or_double_key_is_an_error(spark):
    table = spark.createDataFrame([("a", "u", 1), ("b", "u", 2), ("b", "u", 3)], "t string, url string, pos int")
    ask = lambda *keys: T.looked_up(spark.createDataFrame(list(keys), "t string, url string"), ["t", "url"], table, "pos").collect()
    assert [r["pos"] for r in ask(("a", "u"))] == [1]
    for bad in (("z", "u"), ("b", "u"), (None, "u")):
        with pytest.raises(Exception, match="no single value"):
            ask(bad)


def test_hits_by_group(spark):
    found = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 2), ("q2", 5, 1), ("q2", 6, 3), ("q2", 7, 9)], "query string, doc int, rank int")
    relevant = spark.createDataFrame([("q1", 2), ("q1", 2), ("q2", 7), ("q3", 1)], "query string, doc int")
    queries = spark.createDataFrame([("q1", "g"), ("q2", "g"), ("q3", "h"), ("q4", None)], "query string, g string")
    got = {r["group"]: r for r in T.hits_by_group(found, relevant, queries.where("g is not null"), "g", [1, 3], 3).collect()}
    assert (got["g"]["n_queries"], got["g"]["n_scored"], got["g"]["n_empty"], got["g"]["hit_1"], got["g"]["hit_3"], got["g"]["mrr"]) == (2, 2, 0, 0.0, 0.5, 0.25)
    assert got["h"]["n_empty"] == 1 and got[None]["n_queries"] == 3 and got[None]["hit_3"] == pytest.approx(1 / 3)
    assert T.hits_by_group(found, relevant.limit(0), queries.limit(0), "g", [1], 1).count() == 0


def test_overlap_audit_and_fresh_selection(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "z", "w"), (5, "", "x"), (6, "q", None)]
    df = spark.createDataFrame(rows, "r int, c string, e string")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "r int")
    got = {r["r"]: r["status"] for r in T.overlap_audit(df, "r", [F.col("c"), F.col("e")], F.col("c") == "", ids(1), ids(2, 3, 4, 5, 6)).collect()}
    assert got == {2: "connected", 3: "connected", 4: "independent", 5: "empty", 6: "independent"}
    rows = [("1", "one two three", ["p"]), ("2", "four five", ["p", "q"]), ("3", "six seven", ["q"]), ("4", "eight nine", ["s"]), ("5", "Eight  nine", []), ("6", "one two three four five!", ["t"]), ("7", "ten", ["old"])]
    df = spark.createDataFrame(rows, "i string, c string, p array<string>")
    one = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    got = T.select_fresh(df, "i", "c", F.col("p"), one("i", "3"), one("page", "old"), one("text", "one two three four"), lambda c: F.array_distinct(X.tokens(c)))
    assert {tuple(r) for r in got.collect()} == {("4", "4")}


def test_sequence_groups(spark):
    df = spark.createDataFrame([(1, "a b c d e f".split()), (2, "x b c d e f".split()), (3, "f e d c b a".split()), (4, []), (5, "a b".split())], "i int, w array<string>")
    assert {tuple(r) for r in T.sequence_groups(df, "i", F.col("w")).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_lists_removals_runs_and_scores(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("b", None), ("", "4")], [0.1, 0.2, 0.3, 0.4])], f"e {ITEMS}, s array<double>")
    assert df.select(T.context_problems(F.col("e"))).first()[0] == ["too_many", "repeated_id", "missing_id", "missing_text"]
    assert df.select(T.context_problems(F.slice("e", 1, 2))).first()[0] == []
    cut = df.select(*(F.size(c).alias(n) for n, c in T.removals(F.col("e"), 2).items())).first()
    assert (cut["complete"], cut["all_removed"], cut["one_removed"]) == (4, 0, 3)
    assert df.select(T.carried_scores(F.col("e"), F.col("s"), F.reverse("e"))).first()[0] == [0.4, 0.3, 0.2, 0.1]
    other = F.array(F.struct(F.lit("a").alias("id"), F.lit("changed").alias("text")))
    assert df.select(T.carried_scores(F.col("e"), F.col("s"), other)).first()[0] is None
    runs = spark.createDataFrame([("k", 0, 2, "A B"), ("k", 5, 6, "C"), ("k", 9, 10, "D")], "k string, start int, end int, run string")
    anchors = spark.createDataFrame([("k", 4)], "k string, pos int")
    assert T.nearest_run(runs, anchors, ["k"], "pos").first()["run"] == "C"


def test_ranks_rates_changes_and_indices(spark):
    rows = [(i, float(i % 7), i % 3 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, s double, ok boolean")
    got = T.at_rank_counts(df, {"s": F.col("s"), "minus": -F.col("s")}, "i", {"few": 5, "all": 50}, F.col("ok"))
    best = sorted(rows, key=lambda r: (-r[1], r[0]))[:5]
    found = {(r["rule"], r["at"]): r["accuracy"] for r in got.collect()}
    assert found["s", "few"] == pytest.approx(sum(r[2] for r in best) / 5) and found["s", "all"] == found["minus", "all"] == pytest.approx(17 / 50)
    d = spark.createDataFrame([("a", "S", "S", None), ("a", "S", None, "R"), ("b", "S", None, None)], "g string, t string, full string, masked string")
    assert {tuple(r) for r in T.gate_changes(d, ["g"], "t", "full", "masked").collect()} == {("a", 0, 1, 1, 0), ("b", 0, 0, 0, 0)}
    assert {(r["g"], r["rate"]) for r in T.rate_by(d, [["g"], []], F.col("full").isNotNull(), F.col("g") == "a").collect()} == {("a", 0.5), ("b", None), (None, 0.5)}
    lists = spark.createDataFrame([(1, "t", 5), (1, "t", 5), (1, "v", 9), (1, "v", None), (2, "t", 6)], "s int, side string, r int")
    known = spark.createDataFrame([(5, True), (6, False)], "r int, has_claim boolean")
    assert {tuple(r) for r in T.index_problems(lists, "s", "side", "r", known).collect()} == {(1, 3, 1, 1, 0), (2, 1, 0, 0, 1)}


def test_powers_of_the_prior(spark):
    df = spark.createDataFrame([("p", "A", [0.6, 0.4]), ("p", "B", [0.55, 0.45]), ("p", "A", [0.9, 0.1])], "pol string, t string, q array<double>")
    got = {r["alpha"]: r["macro_f1"] for r in I.alpha_scores(df, ["pol"], "q", "t", ["A", "B"], [2 / 3, 1 / 3], [0.0, 0.5]).collect()}
    assert got[0.0] == pytest.approx(0.4) and got[0.5] == pytest.approx(1.0)


def errors(spark, rules, good, **bad):
    """The names of the rules that a row breaks when one of its fields is changed."""
    fields = sorted(good)
    rows = [good] + [good | {k.split("__")[0]: v} for k, v in bad.items()]
    df = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], ", ".join(f"`{f}` string" for f in fields))
    return [r[0] for r in df.coalesce(1).select(V.broken(rules)).collect()]


def test_rules_of_captures_plans_and_reviews(spark):
    capture = {"capture_id": "CAP-001", "claim_id": "T369-001", "evidence_id": "EVID-001", "source_url": "https://a.example/x", "source_date": "1900-02-28", "article_title": "Title", "printed_page": "3", "column": "1", "private_relative_path": "data/raw/a.png", "sha256": "Ab" * 32}
    got = errors(spark, V.capture_rules(), capture, source_url="http://a.example/x", source_date="1900-02-29", printed_page="0", private_relative_path="data/raw/../x", private_relative_path__2="/data/raw/x", private_relative_path__3="data/rawest/x", sha256="ab", column=None)
    assert got == [[], ["source_url"], ["source_date"], ["printed_page"], ["private_relative_path"], ["private_relative_path"], ["private_relative_path"], ["sha256"], ["column"]]
    plan = {"search_id": "SEARCH-001", "claim_id": "T369-001", "primary_repositories": "r", "exact_query": "q", "fragment_or_concept_query": "f", "date_frozen": "2020-01-01", "assigned_to": "x"}
    assert errors(spark, V.search_plan_rules(), plan, exact_query=" ", search_id="SEARCH-1") == [[], ["both_queries"], ["search_id"]]
    review = {
        "review_id": "REVIEW-T369-004-A", "claim_id": "T369-004", "reviewer_code": "RA-7K2M", "review_date": "2026-01-02", "canonical_claim": "c" * 20, "source_url": "https://a.example", "source_identifier": "s" * 10, "article_title": "Title", "source_date": "1900-01-01", "printed_page": "1", "column": "2",
        "serbian_transcription": "ж" * 40, "literal_translation": "l" * 20, "normalized_english": "n" * 20, "verdict": "insufficient", "sufficiency": "insufficient", "confidence": "0.5", "decisive_evidence_ids": "EVID-001; EVID-002", "provenance_family_ids": "PF-A", "rationale": "r" * 80, "frozen_at_utc": "2026-01-02T03:04:05Z",
    }
    got = errors(spark, V.review_rules(), review, claim_id="T369-005", serbian_transcription="z" * 40, sufficiency="sufficient", confidence="1.5", decisive_evidence_ids=" ; ", provenance_family_ids="PF-A;x", frozen_at_utc="2026-01-02T03:04:05", confidence__2="high")
    assert got == [[], ["ids_agree"], ["serbian_transcription"], ["verdict_matches_sufficiency"], ["confidence"], ["decisive_evidence_ids"], ["provenance_family_ids"], ["frozen_at_utc"], ["confidence"]]


def test_guards_robustness_scales_and_folds(spark):
    df = spark.createDataFrame([("S", []), ("S", ["x"]), (None, None)], "l string, p array<string>")
    label, reasons = T.guarded(F.col("l"), F.col("p"))
    assert [tuple(r) for r in df.select(label, reasons).collect()] == [("S", []), (None, ["x"]), (None, None)]
    pairs = spark.createDataFrame([("a", "A", "A", 0.5, 0.7), ("b", "B", "A", 0.5, 0.4), ("b", "B", None, 0.5, 0.5), ("a", None, None, 0.1, 0.1)], "t string, b string, a string, p double, q double")
    r = T.robustness(pairs, [], "t", "b", "a", "p", "q", ["a", "b"]).first()
    assert (r["n"], r["flip_rate"], r["increase_rate"]) == (4, 0.5, 0.25) and r["macro_before"] == 0.0
    got = T.scaled(spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "x double, y double"), ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0), (3.0, 2.0)]
    rows = spark.createDataFrame([(i // 2, "L" if i % 10 < 3 else None) for i in range(400)] + [(None, "L")], "g int, l string")
    folds = S.stratified_group_folds(rows, "g", "l", 4, "s").toPandas()
    assert len(folds) == 200 and folds.groupby(folds["l"].fillna("")).fold.value_counts().groupby(level=0).agg(lambda x: x.max() - x.min()).max() <= 1
