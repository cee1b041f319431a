"""Queries of metrics, statistics and calibration over predictions.

A prediction's probabilities are those its gate declares: its candidate label gets gate_probability, the other labels share the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.operators import inference as I
from vellumark.operators import metrics as M
from vellumark.operators.retrieval import Postings
from vellumark.plans.registry import Register
from vellumark.plans.search_queries import _BM25
from vellumark.plans.text_queries import sql_normal
from vellumark.functions.text import normal_claim
from vellumark.tables import load

query = Register()
LABELS = ["Supported", "Refuted", "Not Enough Evidence"]
POLICY = ["policy"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prediction: truth, pred (null = abstained), gate probability p and probabilities of LABELS."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "record_index", "policy", "cohort", "language", "true_label", "candidate_label", "generated_verdict", "gate_probability")
    rows = rows.distinct().where("true_label is not null")
    p = F.coalesce("gate_probability", F.lit(0.0))
    said = F.coalesce("candidate_label", "generated_verdict", F.lit(LABELS[2]))
    probs = F.transform(F.array(*map(F.lit, LABELS)), lambda x: F.when(x == said, p).otherwise((1 - p) / 2))
    return rows.select("prediction_id", "record_index", "policy", "cohort", F.lower("language").alias("language"), F.col("true_label").alias("truth"), F.col("candidate_label").alias("pred"), said.alias("said"), p.alias("p"), probs.alias("probs"))


_S = """s AS (SELECT prediction_id, record_index, policy, cohort, lower(language) AS language, true_label AS truth, candidate_label AS pred,
  coalesce(candidate_label, generated_verdict, 'Not Enough Evidence') AS said, coalesce(gate_probability, 0e0) AS p,
  list_transform(['Supported', 'Refuted', 'Not Enough Evidence'], lambda x: CASE WHEN x = coalesce(candidate_label, generated_verdict, 'Not Enough Evidence') THEN coalesce(gate_probability, 0e0) ELSE (1 - coalesce(gate_probability, 0e0)) / 2 END) AS probs
  FROM (SELECT DISTINCT prediction_id, record_index, policy, cohort, language, true_label, candidate_label, generated_verdict, gate_probability FROM predictions) WHERE true_label IS NOT NULL)"""
_L = "l AS (SELECT unnest(['Supported', 'Refuted', 'Not Enough Evidence']) AS label)"


@query(f"WITH {_S} SELECT policy, truth, pred, count(*) AS n FROM s GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of every policy, abstentions as null."""
    return M.confusion(scored(spark, sf_dir), POLICY, "truth", "pred")


_CLASS = f"""WITH {_S}, {_L}, c AS (SELECT policy, label, count_if(truth = label AND coalesce(pred = label, false)) AS tp, count_if(coalesce(pred = label, false)) AS pp, count_if(truth = label) AS support FROM s, l GROUP BY ALL),
k AS (SELECT policy, label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN pp + support > 0 THEN 2 * tp / (pp + support) ELSE 0 END AS f1, support FROM c)"""


@query(_CLASS + " SELECT policy, label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM k")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of every label under every policy."""
    got = M.class_scores(M.confusion(scored(spark, sf_dir), POLICY, "truth", "pred"), POLICY, LABELS)
    return got.select("policy", "label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(_CLASS + """, a AS (SELECT policy, avg(CASE WHEN coalesce(pred = truth, false) THEN 1e0 ELSE 0 END) AS accuracy FROM s GROUP BY policy)
SELECT k.policy, round(avg(f1), 9) AS macro_f1, round(avg(CASE WHEN support > 0 THEN recall END), 9) AS balanced_accuracy, round(any_value(accuracy), 9) AS accuracy FROM k JOIN a USING (policy) GROUP BY k.policy""")
def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1, balanced accuracy and accuracy of every policy."""
    got = M.macro(M.confusion(scored(spark, sf_dir), POLICY, "truth", "pred"), POLICY, LABELS)
    return got.select("policy", *(F.round(c, 9).alias(c) for c in ("macro_f1", "balanced_accuracy", "accuracy")))


@query(f"""WITH {_S} SELECT policy, round(avg(list_sum(list_transform(list_zip(probs, ['Supported', 'Refuted', 'Not Enough Evidence']), lambda z: (z[1] - CASE WHEN z[2] = truth THEN 1e0 ELSE 0 END) ** 2))), 9) AS brier,
  round(avg(-ln(greatest(probs[list_position(['Supported', 'Refuted', 'Not Enough Evidence'], truth)], 1e-12))), 9) AS nll FROM s GROUP BY policy""")
def brier_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score and log loss of every policy."""
    rows = scored(spark, sf_dir)
    return rows.groupBy("policy").agg(F.round(F.avg(M.squared_error(F.col("probs"), LABELS, F.col("truth"))), 9).alias("brier"), F.round(F.avg(M.log_loss(F.col("probs"), LABELS, F.col("truth"))), 9).alias("nll"))


_BINS = f"WITH {_S}, b AS (SELECT policy, least(floor(p * 15), 14)::INT AS bin, count(*) AS n, avg(p) AS mean_score, avg(CASE WHEN said = truth THEN 1e0 ELSE 0 END) AS accuracy FROM s GROUP BY ALL)"


@query(_BINS + " SELECT policy, bin, n, round(mean_score, 9) AS mean_score, round(accuracy, 9) AS accuracy FROM b")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mean score and accuracy of 15 equal score bins of every policy."""
    got = M.reliability(scored(spark, sf_dir), POLICY, "p", F.col("said") == F.col("truth"))
    return got.select("policy", "bin", "n", F.round("mean_score", 9).alias("mean_score"), F.round("accuracy", 9).alias("accuracy"))


@query(_BINS + " SELECT policy, round(sum(n * abs(accuracy - mean_score)) / sum(n), 9) AS ece FROM b GROUP BY policy")
def ece15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error of every policy."""
    return M.calibration_error(scored(spark, sf_dir), POLICY, "p", F.col("said") == F.col("truth")).select("policy", F.round("ece", 9).alias("ece"))


_RC = f"""WITH {_S}, r AS (SELECT policy, p, row_number() OVER w AS place, count(*) OVER (PARTITION BY policy) AS n, sum(CASE WHEN said = truth THEN 0e0 ELSE 1 END) OVER (PARTITION BY policy ORDER BY p DESC, prediction_id ROWS UNBOUNDED PRECEDING) AS errors
  FROM s WINDOW w AS (PARTITION BY policy ORDER BY p DESC, prediction_id))"""


@query(_RC + " SELECT policy, place, round(place / n, 9) AS coverage, round(errors / place, 9) AS risk FROM r")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole risk-coverage curve of every policy."""
    got = M.risk_coverage(scored(spark, sf_dir), POLICY, "p", "prediction_id", F.col("said") == F.col("truth"))
    return got.select("policy", "place", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"))


@query(_RC + " SELECT policy, round(avg(errors / place), 9) AS aurc FROM r GROUP BY policy")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the risk-coverage curve of every policy."""
    return M.aurc(scored(spark, sf_dir), POLICY, "p", "prediction_id", F.col("said") == F.col("truth")).select("policy", F.round("aurc", 9).alias("aurc"))


@query(_RC + """, t AS (SELECT unnest([0.5e0, 0.8e0, 1e0]) AS target) SELECT policy, target, place AS k, round(p, 9) AS threshold, round(errors / place, 9) AS risk FROM r, t
WHERE place = least(n, greatest(1, ceil(round(target * n, 9))))""")
def risk_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and risk of every policy at 50, 80 and 100 % coverage."""
    got = M.at_coverage(scored(spark, sf_dir), POLICY, "p", "prediction_id", F.col("said") == F.col("truth"), [0.5, 0.8, 1.0])
    return got.select("policy", "target", "k", F.round("threshold", 9).alias("threshold"), F.round("risk", 9).alias("risk"))


@query(f"""WITH {_S}, o AS (SELECT prediction_id, list_sort(probs) AS q FROM s) SELECT prediction_id, round(q[3], 9) AS max_probability, round(q[3] - q[2], 9) AS margin,
  round(greatest(0, least(1, 1 + list_sum(list_transform(q, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(3))), 9) AS certainty FROM o""")
def abstention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest probability, margin and normalised certainty of every prediction."""
    p = F.col("probs")
    return scored(spark, sf_dir).select("prediction_id", F.round(M.max_probability(p), 9).alias("max_probability"), F.round(M.margin(p), 9).alias("margin"), F.round(M.certainty(p), 9).alias("certainty"))


@query(f"""WITH {_S}, c AS (SELECT policy, p AS sc, sum(CASE WHEN said = truth THEN 1 ELSE 0 END) AS pos, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER (PARTITION BY policy ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY policy ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS al FROM c)
SELECT policy, round(CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum((n - pos) * (tp - pos / 2)) / (sum(pos) * sum(n - pos)) END, 9) AS roc_auc, round(CASE WHEN sum(pos) > 0 THEN sum(pos * tp / al) / sum(pos) END, 9) AS average_precision FROM r GROUP BY policy""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC AUC and average precision of the gate's probability as a sign of right answers."""
    got = M.ranking_quality(scored(spark, sf_dir), POLICY, "p", F.col("said") == F.col("truth"))
    return got.select("policy", F.round("roc_auc", 9).alias("roc_auc"), F.round("average_precision", 9).alias("average_precision"))


@query(f"""WITH {_S} SELECT cohort, policy, count(*) AS n, round(avg(CASE WHEN pred IS NOT NULL THEN 1e0 ELSE 0 END), 9) AS coverage, round(avg(CASE WHEN coalesce(pred = truth, false) THEN 1e0 ELSE 0 END), 9) AS accuracy,
  round(avg(CASE WHEN pred IS NOT NULL THEN CASE WHEN pred = truth THEN 1e0 ELSE 0 END END), 9) AS covered_accuracy FROM s GROUP BY GROUPING SETS ((cohort, policy), (policy))""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and accuracy per cohort and policy, and per policy."""
    got = M.coverage_summary(scored(spark, sf_dir), [["cohort", "policy"], ["policy"]], "truth", "pred")
    return got.select("cohort", "policy", "n", *(F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "covered_accuracy")))


def _policy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    one = lambda name, p, q: rows.where(F.col("policy") == name).groupBy("record_index").agg(F.min("truth").alias("truth_" + q), F.min("pred").alias(q), F.max("p").alias(p))
    return one("ungated", "p0", "before").join(one("full_gate", "p1", "after"), "record_index").withColumn("truth", F.col("truth_before"))


_PAIRS = f"""WITH {_S}, a AS (SELECT record_index, min(truth) AS truth, min(pred) AS before, max(p) AS p0 FROM s WHERE policy = 'ungated' GROUP BY record_index),
b AS (SELECT record_index, min(pred) AS after, max(p) AS p1 FROM s WHERE policy = 'full_gate' GROUP BY record_index)"""


@query(_PAIRS + """ SELECT truth, count_if(NOT x AND y) AS corrected, count_if(x AND NOT y) AS new_errors, count_if(NOT x AND NOT y) AS wrong_in_both, count_if(x AND y) AS right_in_both, count_if(before IS DISTINCT FROM after) AS flips
FROM (SELECT *, coalesce(before = truth, false) AS x, coalesce(after = truth, false) AS y FROM a JOIN b USING (record_index)) GROUP BY truth""")
def guard_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the full gate corrects and spoils against the ungated policy, per true label."""
    return M.transitions(_policy_pairs(spark, sf_dir), ["truth"], "truth", "before", "after")


@query(_PAIRS + " SELECT truth, round(avg(p1 - p0), 9) AS mean_shift, round(avg(abs(p1 - p0)), 9) AS mean_abs_shift, round(max(abs(p1 - p0)), 9) AS max_abs_shift, count(*) AS n FROM a JOIN b USING (record_index) GROUP BY truth")
def score_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of the gate probability between two policies, per true label."""
    got = M.shift_summary(_policy_pairs(spark, sf_dir), ["truth"], "p0", "p1")
    return got.select("truth", *(F.round(c, 9).alias(c) for c in ("mean_shift", "mean_abs_shift", "max_abs_shift")), "n")


@query(f"""WITH {_S}, g AS (SELECT policy, t.th, avg(CASE WHEN p >= t.th THEN 1e0 ELSE 0 END) AS y FROM s, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS th) t GROUP BY ALL),
a AS (SELECT policy, th, (th - lag(th) OVER w) * (y + lag(y) OVER w) / 2 AS area FROM g WINDOW w AS (PARTITION BY policy ORDER BY th)) SELECT policy, round(sum(area) / (max(th) - min(th)), 9) AS area FROM a GROUP BY policy""")
def answered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the share of answered rows over the threshold, per policy."""
    each = scored(spark, sf_dir).select("policy", "p", F.explode(F.array(*map(F.lit, [0.0, 0.25, 0.5, 0.75, 1.0]))).alias("th"))
    curve = each.groupBy("policy", "th").agg(F.avg((F.col("p") >= F.col("th")).cast("double")).alias("y"))
    return M.trapezoid(curve, POLICY, "th", "y").select("policy", F.round("area", 9).alias("area"))


@query(_BM25 + """, rel AS (SELECT DISTINCT a.doc_id AS query_id, b.doc_id FROM documents a JOIN documents b ON a.provenance_family_id = b.provenance_family_id AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), g AS (SELECT query_id, count(*) AS h, min(rank - 1) AS first, sum(1 / log2(rank)) AS dcg FROM r JOIN rel USING (query_id, doc_id) WHERE rank BETWEEN 2 AND 11 GROUP BY 1)
SELECT n.query_id, coalesce(h, 0) > 0 AS hit, round(coalesce(h, 0) / n, 9) AS recall, round(coalesce(1 / first, 0), 9) AS reciprocal_rank,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg FROM n LEFT JOIN g USING (query_id)""")
def recall_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, recall, reciprocal rank and nDCG at 10 of BM25 for documents of the query's provenance family, the query itself aside."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "provenance_family_id")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("t"), F.col("provenance_family_id").alias("f"))
    found = Postings(docs, "doc_id", "text").search(asked, "query_id", "t", 11).select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), (F.col("rank") - 1).alias("rank")).where("rank > 0")
    relevant = asked.join(docs, asked["f"] == docs["provenance_family_id"]).where("query_id <> doc_id").select("query_id", "doc_id")
    got = M.retrieval_quality(found, relevant, "query_id", "doc_id", "rank", 10)
    return got.select("query_id", "hit", *(F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")))


@query(f"""WITH {_S}, u AS (SELECT record_index, count(*) AS n_policies, bool_and(NOT coalesce(pred = truth, false)) AS wrong FROM s GROUP BY record_index) SELECT record_index, n_policies FROM u WHERE wrong""")
def wrong_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that no policy answers rightly."""
    ok = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))
    return scored(spark, sf_dir).groupBy("record_index").agg(F.count(F.lit(1)).alias("n_policies"), F.bool_and(~ok).alias("wrong")).where("wrong").drop("wrong")


@query(f"""WITH e AS (SELECT DISTINCT prediction_id, policy, true_label, evidence FROM predictions WHERE true_label IS NOT NULL), x AS (SELECT prediction_id, policy, true_label, coalesce(len(evidence), 0) AS n, coalesce(len(list_distinct(list_transform(evidence, lambda z: {sql_normal('z.text')}))), 0) AS d FROM e)
SELECT policy, true_label AS label, count(*) AS n, round(avg(n), 9) AS mean_evidence, round(avg(CASE WHEN n > 0 AND n = d THEN 1e0 ELSE 0 END), 9) AS distinct_share FROM x GROUP BY ALL""")
def evidence_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much evidence predictions show and how often without a repeated text, per policy and label."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "policy", "true_label", "evidence").distinct().where("true_label is not null")
    n = F.coalesce(F.array_size("evidence"), F.lit(0))
    d = F.coalesce(F.array_size(F.array_distinct(F.transform("evidence", lambda e: normal_claim(e["text"])))), F.lit(0))
    return rows.groupBy("policy", F.col("true_label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 9).alias("mean_evidence"), F.round(F.avg(((n > 0) & (n == d)).cast("double")), 9).alias("distinct_share"))


_GROUPS = f"""WITH {_S}, g AS (SELECT cohort AS group_id, sum(CASE WHEN coalesce(pred = truth, false) THEN 1e0 ELSE 0 END) AS v, count(*)::DOUBLE AS w FROM s WHERE cohort IS NOT NULL GROUP BY cohort),
i AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS i FROM g), n AS (SELECT count(*) AS n FROM i)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("double")
    return scored(spark, sf_dir).where("cohort is not null").groupBy(F.col("cohort").alias("group_id")).agg(F.sum(ok).alias("v"), F.count(F.lit(1)).cast("double").alias("w"))


@query(_GROUPS + """, d AS (SELECT r.rep, CAST('0x' || substr(sha256('boot:' || r.rep || ':' || i.i), 1, 8) AS BIGINT) % n AS i FROM i, n, (SELECT unnest(range(1, 201)) AS rep) r),
x AS (SELECT d.rep, sum(i.v) / sum(i.w) AS r FROM d JOIN i ON d.i = i.i GROUP BY d.rep)
SELECT round((SELECT sum(v) / sum(w) FROM g), 9) AS estimate, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high FROM x""")
def group_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy with a 95 % interval from resampled cohorts."""
    return I.bootstrap(_groups(spark, sf_dir), "v", "w", "boot").select(*(F.round(c, 9).alias(c) for c in ("estimate", "low", "high")))


@query("""WITH e AS (SELECT event_type AS group_id, avg(CASE WHEN user_id % 2 = 0 THEN value END) - avg(CASE WHEN user_id % 2 = 1 THEN value END) AS d FROM events GROUP BY event_type),
a AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS g, count(*) OVER () AS k FROM e WHERE abs(d) > 0), c AS (SELECT unnest(range(0, (SELECT (2 ** max(k))::BIGINT FROM a))) AS code),
s AS (SELECT code, sum(d * (1 - 2 * ((code >> g) & 1))) AS s FROM a, c GROUP BY code), o AS (SELECT sum(d) AS o FROM a)
SELECT round(o, 9) AS observed, round(count_if(abs(s) >= abs(o) - 1e-12) / count(*), 9) AS p_value, (SELECT count(*) FROM a)::INT AS n_groups FROM s, o GROUP BY o""")
def sign_swap_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sign-swap test of the difference of event values between even and odd users, per event type."""
    v = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    groups = load(spark, sf_dir, "events", "event_type", "user_id", "value").groupBy(F.col("event_type").alias("group_id")).agg((v(0) - v(1)).alias("d"))
    return I.sign_swap(groups, "d").select(F.round("observed", 9).alias("observed"), F.round("p_value", 9).alias("p_value"), "n_groups")


@query("""WITH t AS (SELECT event_type, round(1 / (1 + avg(value)), 9) AS p FROM events GROUP BY event_type), k AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS k, count(*) OVER () AS m FROM t)
SELECT event_type, p, round(least(1e0, max((m - k + 1) * p) OVER (ORDER BY p, event_type ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM k""")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down adjusted values of one value per event type."""
    tests = load(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(F.round(1 / (1 + F.avg("value")), 9).alias("p")).withColumn("_all", F.lit(1))
    return I.holm(tests, ["_all"], "p", "event_type").select("event_type", "p", F.round("adjusted", 9).alias("adjusted"))


_GRID = [0.25, 0.5, 1.0, 2.0, 4.0]


@query(f"""WITH {_S}, z AS (SELECT policy, list_transform(probs, lambda x: ln(greatest(x, 1e-6))) AS l, list_position(['Supported', 'Refuted', 'Not Enough Evidence'], truth) AS t FROM s),
e AS (SELECT policy, t, g.temperature, list_transform(l, lambda x: exp((x - list_max(l)) / g.temperature)) AS ex FROM z, (SELECT unnest([0.25e0, 0.5e0, 1e0, 2e0, 4e0]) AS temperature) g)
SELECT policy, temperature, round(avg(-ln(greatest(ex[t] / list_sum(ex), 1e-12))), 9) AS nll FROM e GROUP BY ALL""")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of every policy over a grid of temperatures."""
    index = F.array_position(F.array(*map(F.lit, LABELS)), F.col("truth")).cast("int")
    rows = scored(spark, sf_dir).select("policy", F.transform("probs", lambda x: F.log(F.greatest(x, F.lit(1e-6)))).alias("l"), index.alias("t"))
    return I.temperature_grid(rows, POLICY, "l", "t", _GRID).select("policy", "temperature", F.round("nll", 9).alias("nll"))


@query()
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of least log loss over all predictions."""
    index = F.array_position(F.array(*map(F.lit, LABELS)), F.col("truth")).cast("int")
    rows = scored(spark, sf_dir).select(F.transform("probs", lambda x: F.log(F.greatest(x, F.lit(1e-6)))).alias("l"), index.alias("t"))
    return spark.createDataFrame([(I.fit_temperature(rows, "l", "t"),)], "temperature double")


@query()
def correctness_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic calibration of the gate's probability to the chance of a right answer, per policy."""
    rows = scored(spark, sf_dir)
    logit = F.log(F.greatest(F.col("p"), F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
    out = [(p, *I.fit_logit(rows.where(F.col("policy") == p), logit, F.col("said") == F.col("truth"))) for p in ("ungated", "full_gate", "semantic_gate", "nli_gate")]
    return spark.createDataFrame(out, "policy string, slope double, intercept double")


_TH = f"""WITH {_S}, c AS (SELECT policy, t.threshold, count_if(p >= t.threshold AND said = truth) AS tp, count_if(p >= t.threshold AND said <> truth) AS fp, count_if(p < t.threshold AND said = truth) AS fn, count_if(p < t.threshold AND said <> truth) AS tn
  FROM s, (SELECT unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]) AS threshold) t GROUP BY ALL),
m AS (SELECT policy, threshold, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 AS macro_f1 FROM c)"""


@query(_TH + """ SELECT policy, threshold, round(macro_f1, 9) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY round(macro_f1, 12) DESC, round(abs(threshold - 0.5e0), 9), threshold) AS rn FROM m) WHERE rn = 1""")
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate threshold of greatest macro-F1 for every policy."""
    scores = I.threshold_scores(scored(spark, sf_dir), POLICY, "p", F.col("said") == F.col("truth"), [i / 10 for i in range(1, 10)])
    return I.choose_threshold(scores, POLICY).select("policy", "threshold", F.round("macro_f1", 9).alias("macro_f1"))


@query(_RC + """, l AS (SELECT policy, p, max(place) AS place, max_by(errors, place) AS errors FROM r GROUP BY policy, p), ok AS (SELECT policy, max_by(p, place) AS threshold, max(place) AS answered FROM l WHERE place >= 20 AND errors / place <= 0.4 GROUP BY policy)
SELECT DISTINCT s.policy, round(coalesce(threshold, 1.01e0), 9) AS threshold, coalesce(answered, 0) AS answered FROM s LEFT JOIN ok USING (policy)""")
def covering_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut of every policy that answers most predictions with at most 40 % errors, and at least twenty."""
    got = I.covering_threshold(scored(spark, sf_dir), POLICY, "p", "prediction_id", F.col("said") == F.col("truth"), 0.4, 20)
    return got.select("policy", F.round("threshold", 9).alias("threshold"), "answered")


QUERIES, SQL = query.queries, query.sql
