"""Queries of features, decisions, guards, stress and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import text as X

from vellumark.operators import decisions as D
from vellumark.operators import features as Q
from vellumark.operators import guards as G
from vellumark.operators import stress as S
from vellumark.operators import validation as V
from vellumark.plans.metric_queries import _S, scored
from vellumark.plans.registry import Register
from vellumark.plans.text_queries import _part, _source_url_sql, sql_normal, sql_tokens
from vellumark.tables import cut, load

query = Register()
ITEMS = "array<struct<id:string,text:string>>"
_NEG = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in Q.NEGATIONS) + "]"


def _shown(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Predictions with their evidence as a list that is never null."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "claim", "evidence", *cols).distinct()
    return rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(ITEMS)))


def _evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shown(spark, sf_dir).select("prediction_id", "claim", F.posexplode("evidence").alias("pos", "e"))
    rows = rows.select("prediction_id", "claim", "pos", F.col("e.id").alias("evidence_id"), F.col("e.text").alias("text"))
    return rows.withColumn("s", Q.lexical_scores(F.col("claim"), F.col("text"))).withColumn("cosine", Q.cosine_of_words(F.col("claim"), F.col("text")))


_EV = f"""ev AS (SELECT prediction_id, claim, i - 1 AS pos, evidence[i].id AS evidence_id, evidence[i].text AS text FROM (SELECT *, unnest(range(1, len(evidence) + 1)) AS i FROM (SELECT DISTINCT prediction_id, claim, evidence FROM predictions))),
tk AS (SELECT *, list_distinct({sql_tokens('claim')}) AS c, list_distinct({sql_tokens('text')}) AS e FROM ev),
sh AS (SELECT *, CASE WHEN len(c) > 0 THEN len(list_intersect(c, e)) / len(c) ELSE 0 END AS share, list_has_any(c, {_NEG}) <> list_has_any(e, {_NEG}) AS against FROM tk),
sc AS (SELECT *, [share * CASE WHEN against THEN 0.8e0 ELSE 0.2e0 END, share * CASE WHEN against THEN 0.2e0 ELSE 0.8e0 END, 1 - share] AS s,
  CASE WHEN len(c) > 0 AND len(e) > 0 THEN len(list_intersect(c, e)) / sqrt(len(c) * len(e)) ELSE 0 END AS cosine FROM sh)"""
_FEATURES = ["max_contradiction", "mean_contradiction", "std_contradiction", "max_entailment", "mean_entailment", "std_entailment", "max_neutral", "mean_neutral", "std_neutral", "n_evidence", "mean_entropy", "clash", "neutral_share", "mean_cosine", "max_cosine", "min_cosine", "std_cosine"]
_AGGS = ", ".join(
    [f"round({f}(s[{i}]), 9) AS {n}_{k}" for i, k in ((1, "contradiction"), (2, "entailment"), (3, "neutral")) for f, n in (("max", "max"), ("avg", "mean"), ("stddev_pop", "std"))]
    + ["count(*)::DOUBLE AS n_evidence", "round(avg(-list_sum(list_transform(s, lambda p: CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) / ln(3)), 9) AS mean_entropy", "round(max(s[1]) * max(s[2]), 9) AS clash", "round(avg(CASE WHEN list_position(s, list_max(s)) = 3 THEN 1e0 ELSE 0 END), 9) AS neutral_share"]
    + [f"round({f}(cosine), 9) AS {n}_cosine" for f, n in (("avg", "mean"), ("max", "max"), ("min", "min"), ("stddev_pop", "std"))]
)


@query(f"WITH {_EV} SELECT prediction_id, {_AGGS} FROM sc GROUP BY prediction_id")
def score_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the scored evidence of every prediction."""
    got = Q.score_features(_evidence_scores(spark, sf_dir), "prediction_id", "s", "cosine")
    return got.select("prediction_id", *(F.round(c, 9).alias(c) for c in _FEATURES))


@query(f"""WITH {_EV}, t AS (SELECT *, len({sql_tokens('text')}) AS words FROM sc) SELECT prediction_id, round(max(share), 9) AS max_overlap, round(avg(share), 9) AS mean_overlap,
  round(avg(ln(1 + words)), 9) AS mean_log_words, round(max(ln(1 + words)), 9) AS max_log_words FROM t GROUP BY prediction_id""")
def expanded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and length features of every prediction's evidence."""
    got = Q.score_features(_evidence_scores(spark, sf_dir), "prediction_id", "s", None, None, "text", "claim")
    return got.select("prediction_id", *(F.round(c, 9).alias(c) for c in ("max_overlap", "mean_overlap", "mean_log_words", "max_log_words")))


_PAGE = rf"""pg AS (SELECT *, CASE WHEN u = '' THEN '' ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS page FROM (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower({_part('u', 2)}), '^[^@]*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
    CASE WHEN regexp_replace({_part('u', 3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_part('u', 3)}, '/+$', '') END AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_replace({_part('u', 4)}, '^\?', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)'))), '&') AS q
  FROM (SELECT *, CASE WHEN u0 = '' THEN '' WHEN regexp_matches(u0, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u0 ELSE 'https://' || u0 END AS u FROM (
    SELECT *, {_source_url_sql('source_url')} AS u0 FROM (SELECT DISTINCT evidence_id, claim_id, source_url, evidence_summary FROM tesla_phase1b_evidence_v0_1)))))"""


@query(f"""WITH {_PAGE}, r AS (SELECT claim_id, page, CASE WHEN page <> '' THEN host END AS f, array_to_string({sql_tokens('evidence_summary')}, ' ') AS a, regexp_matches(lower(coalesce(source_url, '')), '^https?://[^/]*(archive|wayback)[^/]*/web/') AS ar FROM pg),
fam AS (SELECT claim_id, f, count(*) AS n FROM r WHERE f IS NOT NULL AND f <> '' GROUP BY ALL),
g AS (SELECT claim_id, count(*) AS k, max(n) AS most, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS rep, sum(n) AS w, sum(n * log2(n)) AS nl FROM fam GROUP BY claim_id),
h AS (SELECT claim_id, count(*) AS n, count(DISTINCT page) AS urls, count_if(a <> '') AS said, count(DISTINCT CASE WHEN a <> '' THEN a END) AS kinds, count_if(ar) AS archived, count_if(page = '') AS missing FROM r GROUP BY claim_id)
SELECT h.claim_id, n::DOUBLE AS n_answers, coalesce(k, 0)::DOUBLE AS n_families, round(coalesce(k, 0) / n, 9) AS family_share, round(coalesce(most, 0) / n, 9) AS largest_family, round(coalesce(rep, 0) / n, 9) AS repeated_share, round((n - urls) / n, 9) AS duplicate_url_share,
  round((said - kinds) / n, 9) AS duplicate_answer_share, round(archived / n, 9) AS archive_share, round(missing / n, 9) AS missing_share, round(CASE WHEN k > 1 THEN (log2(w) - nl / w) / log2(k) ELSE 0 END, 9) AS family_entropy FROM h LEFT JOIN g ON h.claim_id IS NOT DISTINCT FROM g.claim_id""")
def provenance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-family features of every claim's evidence."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id", "source_url", "evidence_summary").distinct()
    got = Q.provenance(ev, "claim_id", F.col("source_url"), F.col("evidence_summary"), F.lit(None).cast("string"))
    return got.select("claim_id", *(F.round(c, 9).alias(c) for c in got.columns if c != "claim_id"))


@query(r"""WITH e AS (SELECT DISTINCT evidence_id, claim_id, try_strptime(CASE WHEN regexp_matches(publication_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN publication_date END, '%Y-%m-%d')::DATE AS p, try_strptime(access_date, '%Y-%m-%d')::DATE AS a FROM tesla_phase1b_evidence_v0_1),
l AS (SELECT claim_id, date_diff('day', p, a) / 365.25e0 AS lag FROM e)
SELECT claim_id, count(lag)::DOUBLE AS n_captures, round(count(lag) / count(*), 9) AS dated_share, round(CASE WHEN count(lag) > 0 THEN count_if(lag > 0) / count(lag) ELSE 0 END, 9) AS after_share, round(coalesce(median(lag), 0), 9) AS median_lag, round(coalesce(median(abs(lag)), 0), 9) AS median_abs_lag FROM l GROUP BY claim_id""")
def capture_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years between publication and access of every claim's evidence."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id", "publication_date", "access_date").distinct()
    day = lambda c: F.try_to_timestamp(F.when(F.col(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col(c)), F.lit("yyyy-MM-dd")).cast("date")
    got = Q.capture_timing(ev, "claim_id", day("publication_date"), day("access_date"))
    return got.select("claim_id", *(F.round(c, 9).alias(c) for c in got.columns if c != "claim_id"))


@query(rf"""WITH p AS (SELECT DISTINCT prediction_id, claim, coalesce(evidence, []) AS e FROM predictions), t AS (SELECT prediction_id, len(e)::DOUBLE AS n, e, list_transform(e, lambda x: trim(coalesce(x.text, ''))) AS texts FROM p),
s AS (SELECT *, list_transform(list_filter(texts, lambda x: x <> ''), lambda x: list_sort(list_distinct(regexp_extract_all(lower(x), '[\p{{L}}\p{{M}}\p{{N}}_'']+')))) AS sets, len(list_filter(texts, lambda x: list_has_any(regexp_extract_all(lower(x), '[\p{{L}}\p{{M}}\p{{N}}_'']+'), {_NEG})))::DOUBLE AS neg FROM t),
d AS (SELECT prediction_id, list_sum(list_transform(sets, lambda a: list_sum(list_transform(sets, lambda b: CASE WHEN len(a) + len(b) = 0 THEN 0e0 ELSE 1 - len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END)))) AS total FROM s)
SELECT s.prediction_id, 1e0 AS n_questions, n AS n_answers, n AS answers_per_question, (n > 1)::DOUBLE AS multi_answer_share, CASE WHEN n > 0 THEN round(len(list_distinct(list_transform(sets, lambda x: array_to_string(x, ' ')))) / n, 9) ELSE 0 END AS unique_share, 0e0 AS boolean_share, 0e0 AS yes_and_no,
  CASE WHEN n > 0 THEN round(neg / n, 9) ELSE 0 END AS negated_share, (neg > 0 AND neg < n)::DOUBLE AS negation_mixed, CASE WHEN n > 0 THEN round(len(list_distinct(list_filter(list_transform(e, lambda x: lower(trim(coalesce(x.id[1:1], '')))), lambda x: x <> ''))) / n, 9) ELSE 0 END AS media_share,
  CASE WHEN n > 0 THEN round(1 / n, 9) ELSE 0 END AS type_share, CASE WHEN len(sets) >= 2 THEN round(total / (len(sets) * (len(sets) - 1)), 9) ELSE 0 END AS mean_distance FROM s JOIN d ON d.prediction_id = s.prediction_id""")
def disagreement_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural features of every prediction's claim and evidence, read as one question and its answers."""
    none = F.lit(None).cast("string")
    answers = F.transform("evidence", lambda e: F.struct(e["text"].alias("answer"), F.lit("extractive").alias("answer_type"), none.alias("source_url"), F.substring(e["id"], 1, 1).alias("source_medium"), none.alias("cached_source_url")))
    rows = _shown(spark, sf_dir).select("prediction_id", F.array(F.struct(F.col("claim").alias("question"), answers.alias("answers"))).alias("questions"))
    return rows.select("prediction_id", *(F.round(c, 9).alias(n) for n, c in Q.disagreement(F.col("questions")).items()))


_TF = f"""w AS (SELECT DISTINCT claim_id, list_filter({sql_tokens('claim_text')}, lambda t: length(t) >= 2) AS w FROM tesla_claims_pilot_v0_1),
g AS (SELECT claim_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT claim_id, term, count(*) AS tf FROM g GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM w)"""


@query(f"""WITH {_TF}, r AS (SELECT claim_id, term, (1 + ln(tf)) * (ln((1e0 + n) / (1 + df)) + 1) AS x FROM tf JOIN d USING (term), n)
SELECT claim_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY claim_id)), 9) AS weight FROM r""")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of words and word pairs of every claim."""
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return Q.tfidf(claims, "claim_id", "claim_text", most=None).select("claim_id", "term", F.round("weight", 9).alias("weight"))


def _asked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text", "language").where("cast(regexp_extract(claim_id, '([0-9]+)$', 1) as long) % 100 = 0")
    return claims.groupBy("claim_id").agg(F.min("claim_text").alias("claim"), F.min(F.lower(F.substring("language", 1, 2))).alias("language"))


_VERIFY = f"""WITH RECURSIVE t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok FROM documents), tf AS (SELECT doc_id, tok, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({sql_tokens('text')}) AS dl FROM documents), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS av FROM dl), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
cl AS (SELECT claim_id, min(claim_text) AS claim, min(lower(substr(language, 1, 2))) AS lang FROM tesla_claims_pilot_v0_1 WHERE CAST(regexp_extract(claim_id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0 GROUP BY claim_id HAVING trim(min(claim_text)) <> ''),
q AS (SELECT DISTINCT claim_id, unnest({sql_tokens('claim')}) AS tok FROM cl),
sc AS (SELECT claim_id, tf.doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)))), 9) AS score FROM q JOIN tf USING (tok) JOIN df USING (tok) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 50),
pool AS (SELECT h.claim_id, h.rank, d.doc_id, d.text, d.source_rank, d.provenance_family_id AS fam, coalesce(lower(substr(d.lang, 1, 2)) = c.lang, false) AS ok, c.claim FROM hit h JOIN documents d USING (doc_id) JOIN cl c USING (claim_id)),
el AS (SELECT * FROM pool WHERE ok), k AS (SELECT claim_id, rank, 't' || {sql_normal('text')} AS k FROM el UNION SELECT claim_id, rank, 'f' || fam FROM el WHERE coalesce(fam, '') <> ''),
e AS (SELECT DISTINCT a.claim_id, a.rank AS a, b.rank AS b FROM k a JOIN k b ON a.claim_id = b.claim_id AND a.k = b.k), reach(claim_id, a, b) AS (SELECT claim_id, a, b FROM e UNION SELECT r.claim_id, r.a, e.b FROM reach r JOIN e ON r.claim_id = e.claim_id AND r.b = e.a),
grp AS (SELECT claim_id, a AS rank, min(b) AS g FROM reach GROUP BY ALL), ch AS (SELECT * FROM (SELECT el.*, row_number() OVER (PARTITION BY el.claim_id ORDER BY el.rank) AS place FROM el JOIN grp USING (claim_id, rank) WHERE el.rank = g) WHERE place <= 5),
tk AS (SELECT *, list_distinct({sql_tokens('claim')}) AS c, list_distinct({sql_tokens('text')}) AS e FROM ch), sh AS (SELECT *, CASE WHEN len(c) > 0 THEN len(list_intersect(c, e)) / len(c) ELSE 0 END AS share, list_has_any(c, {_NEG}) <> list_has_any(e, {_NEG}) AS against FROM tk),
s AS (SELECT *, [share * CASE WHEN against THEN 0.2e0 ELSE 0.8e0 END, share * CASE WHEN against THEN 0.8e0 ELSE 0.2e0 END, 1 - share] AS s, 1e0 / coalesce(source_rank, 5) AS w FROM sh),
p AS (SELECT claim_id, [sum(w * s[1]) / sum(w), sum(w * s[2]) / sum(w), sum(w * s[3]) / sum(w)] AS p, count(*) AS n, string_agg(doc_id, ',' ORDER BY rank) AS ev FROM s GROUP BY claim_id),
j AS (SELECT cl.claim_id, coalesce(p, [0e0, 0e0, 1e0]) AS p, coalesce(n, 0) AS n, coalesce(ev, '') AS evidence, (SELECT count(*) FROM pool WHERE pool.claim_id = cl.claim_id AND NOT ok) AS n_wrong_language, (SELECT count(*) FROM grp WHERE grp.claim_id = cl.claim_id AND rank <> g) AS n_copies FROM cl LEFT JOIN p USING (claim_id)),
r AS (SELECT *, ['Supported', 'Refuted', 'Not Enough Evidence'][list_position(p, list_max(p))] AS best, list_sort(p) AS o FROM j),
z AS (SELECT *, list_filter([CASE WHEN n = 0 THEN 'no_compatible_evidence' END, CASE WHEN n < 2 THEN 'too_few_components' END, CASE WHEN list_max(p) < 0.6 THEN 'low_confidence' END, CASE WHEN o[3] - o[2] < 0.15 THEN 'ambiguous' END, CASE WHEN best = 'Not Enough Evidence' THEN 'neutral_dominant' END], lambda x: x IS NOT NULL) AS why FROM r)
SELECT claim_id, CASE WHEN len(why) = 0 THEN best END AS label, round(p[1], 6) AS p_supported, round(p[2], 6) AS p_refuted, array_to_string(why, ',') AS reasons, evidence, n AS n_components, n_wrong_language, n_copies FROM z"""


@query(_VERIFY)
def verify_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claim check: retrieval, language filter, copies collapsed, scores weighted by source, and a label or reasons to abstain."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source_rank", "is_primary", "provenance_family_id")
    docs = docs.select(F.col("doc_id").alias("id"), "text", F.lower(F.substring("lang", 1, 2)).alias("language"), "source_rank", "is_primary", "provenance_family_id")
    got = D.verify_claims(_asked_claims(spark, sf_dir), docs, Q.lexical_scores)
    return got.select(
        "claim_id", "label", F.col("stance_scores")[0].alias("p_supported"), F.col("stance_scores")[1].alias("p_refuted"), F.array_join("reasons", ",").alias("reasons"),
        F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"), "n_components", "n_wrong_language", "n_copies",
    )


@query(f"""WITH {_EV}, l AS (SELECT prediction_id, pos, CASE WHEN s[2] >= 0.45 AND s[2] - greatest(s[1], s[3]) >= 0.05 THEN 'Supported' WHEN s[1] >= 0.45 AND s[1] - greatest(s[2], s[3]) >= 0.05 THEN 'Refuted' END AS l, s FROM sc),
g AS (SELECT prediction_id, count_if(l = 'Supported') > 0 AS a, count_if(l = 'Refuted') > 0 AS b FROM l GROUP BY 1),
m AS (SELECT prediction_id, l, CASE l WHEN 'Supported' THEN s[2] WHEN 'Refuted' THEN s[1] END AS p, pos, row_number() OVER (PARTITION BY prediction_id ORDER BY CASE l WHEN 'Supported' THEN s[2] ELSE s[1] END DESC, pos) AS rn FROM l WHERE l IS NOT NULL)
SELECT g.prediction_id, CASE WHEN a <> b THEN m.l ELSE 'Not Enough Evidence' END AS label, CASE WHEN a <> b THEN round(m.p, 9) END AS p, CASE WHEN a <> b THEN m.pos::INT END AS position FROM g LEFT JOIN m ON m.prediction_id = g.prediction_id AND rn = 1""")
def evidence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest stance of every prediction's evidence."""
    got = D.evidence_decision(_evidence_scores(spark, sf_dir), "prediction_id", "pos", "s", 0.45, 0.05)
    return got.select("prediction_id", "label", F.round("p", 9).alias("p"), "position")


@query(f"WITH {_S} SELECT prediction_id, a.alpha, CAST(list_position(w, list_max(w)) AS INTEGER) AS choice FROM (SELECT prediction_id, alpha, list_transform(list_zip(probs, [0.5e0, 0.3e0, 0.2e0]), lambda z: z[1] / z[2] ** alpha) AS w FROM s, (SELECT unnest([0e0, 0.5e0, 1e0]) AS alpha)) a")
def decision_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label index that wins after dividing by the prior to three powers."""
    rows = scored(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), D.prior_adjusted(F.col("probs"), [0.5, 0.3, 0.2], a).alias("choice")) for a in (0.0, 0.5, 1.0)))).alias("x")
    return rows.select("prediction_id", each).select("prediction_id", "x.alpha", "x.choice")


@query("""SELECT DISTINCT prediction_id, CASE WHEN coalesce(len(reasons), 0) = 0 AND gate_probability >= 0.7 THEN generated_verdict END AS label,
  CASE WHEN coalesce(len(reasons), 0) = 0 AND coalesce(gate_probability >= 0.7, false) THEN CASE WHEN generated_verdict IS NULL THEN 'verdict' ELSE 'explanation' END ELSE 'gate' END AS last_stage FROM predictions""")
def gate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's label behind a gate of 0.7, and how far it gets."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "reasons", "gate_probability", "generated_verdict").distinct()
    no = F.lit(False)
    s = D.stages_of(F.col("reasons"), F.col("gate_probability"), 0.7, F.col("generated_verdict"), no, no)
    return rows.select("prediction_id", D.apply_gate(F.col("generated_verdict"), F.col("gate_probability"), F.col("reasons"), 0.7).alias("label"), F.element_at(s["stages"], -1).alias("last_stage")).distinct()


@query("""WITH p AS (SELECT DISTINCT record_index, policy, candidate_label FROM predictions), a AS (SELECT record_index, min(candidate_label) AS x FROM p WHERE policy = 'semantic_gate' GROUP BY 1), b AS (SELECT record_index, min(candidate_label) AS y FROM p WHERE policy = 'nli_gate' GROUP BY 1)
SELECT record_index, CASE WHEN x = y THEN x END AS label FROM a JOIN b USING (record_index)""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label on which two policies agree, per record."""
    p = load(spark, sf_dir, "predictions", "record_index", "policy", "candidate_label")
    one = lambda name, c: p.where(F.col("policy") == name).groupBy("record_index").agg(F.min("candidate_label").alias(c))
    return one("semantic_gate", "x").join(one("nli_gate", "y"), "record_index").select("record_index", D.agreement(F.col("x"), F.col("y")).alias("label"))


@query(f"""WITH {_EV}, f AS (SELECT prediction_id, avg(s[1]) AS a, avg(s[2]) AS b, max(cosine) AS c FROM sc GROUP BY 1), z AS (SELECT prediction_id, 0.1e0 + (b - 0.2e0) / 0.1e0 * 0.5e0 + (c - 0.3e0) / 0.2e0 * -0.25e0 AS z, 0.1e0 + (b - 0.2e0) / 0.1e0 * 0.5e0 AS m FROM f)
SELECT prediction_id, round(1 / (1 + exp(-z)), 9) AS p, round(1 / (1 + exp(-m)), 9) AS p_masked FROM z""")
def gate_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic head over three features, and with one of them masked by its mean."""
    f = _evidence_scores(spark, sf_dir).groupBy("prediction_id").agg(F.array(F.avg(F.col("s")[0]), F.avg(F.col("s")[1]), F.max("cosine")).alias("x"))
    head = lambda x: D.logistic_head(x, [1, 2], [0.2, 0.3], [0.1, 0.2], [0.5, -0.25], 0.1)
    return f.select("prediction_id", F.round(head(F.col("x")), 9).alias("p"), F.round(head(D.masked(F.col("x"), [0.1, 0.2, 0.3], [2])), 9).alias("p_masked"))


@query(f"""WITH {_PAGE}, e AS (SELECT DISTINCT claim_id, evidence_id, source_url, CASE WHEN page <> '' THEN host ELSE '' END AS f FROM pg),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY evidence_id, source_url NULLS FIRST) AS i FROM e), g AS (SELECT claim_id, f, count(*) AS n, min(i) AS i FROM r WHERE claim_id IS NOT NULL AND f <> '' GROUP BY ALL),
b AS (SELECT claim_id, i FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, i) AS place FROM g) WHERE place = 1)
SELECT claim_id, evidence_id, source_url, 0 AS copy FROM e UNION ALL SELECT claim_id, evidence_id, source_url, k::INT FROM r JOIN b USING (claim_id, i), (SELECT unnest([1, 2, 3, 4, 5]) AS k)""")
def inject_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's evidence addresses with five copies of the first one of the claim's most frequent source."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "claim_id", "evidence_id", "source_url").distinct()
    return S.with_copies(ev, "claim_id", "source_url", ["evidence_id", "source_url"], 5)


_OCR = """WITH c AS (SELECT DISTINCT claim_id, claim_text AS t FROM tesla_claims_pilot_v0_1 WHERE claim_text <> ''), k AS (SELECT claim_id, t, i - 1 AS i, t[i] AS x FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM c)),
o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, t ORDER BY sha256(claim_id || ':' || i), i) AS rn, count(*) OVER (PARTITION BY claim_id, t) AS n FROM k WHERE x IN ('o', 'l', 'e', 'a')),
h AS (SELECT claim_id, t, i FROM o WHERE rn <= least(n, greatest(1, ceil(round(length(t) * 0.02, 9)))))
SELECT k.claim_id, string_agg(CASE WHEN h.i IS NOT NULL THEN translate(x, 'olea', '01c@') ELSE x END, '' ORDER BY k.i) AS noisy FROM k LEFT JOIN h ON h.claim_id = k.claim_id AND h.t = k.t AND h.i = k.i GROUP BY k.claim_id, k.t"""


@query(_OCR)
def ocr_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with 2 % of its characters misread."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").where("claim_text <> ''").distinct()
    return c.select("claim_id", S.scan_noise(F.col("claim_text"), F.col("claim_id")).alias("noisy"))


@query()
def ocr_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with a tenth of its letters and digits confused."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").where("claim_text <> ''").distinct()
    return c.select("claim_id", S.rate_noise(F.col("claim_text"), F.col("claim_id"), 0.1).alias("noisy"))


@query()
def paraphrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's claim after at most three phrase replacements."""
    c = load(spark, sf_dir, "predictions", "prediction_id", "claim").distinct()
    return c.select("prediction_id", S.paraphrase(F.col("claim"), 3).alias("p")).select("prediction_id", "p.text", F.col("p.n").alias("n_changes"))


@query("""SELECT claim_id, ordinal::INT AS ordinal, 'The cited source states that ' || trim(coalesce(claim_text, '')) AS text, 'https://citation-' || claim_id || '-' || ordinal || '.invalid/source' AS source_url FROM (SELECT DISTINCT claim_id, claim_text FROM tesla_claims_pilot_v0_1), (SELECT unnest([1, 2, 3]) AS ordinal)""")
def insert_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three invented citations for every claim."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return c.select("claim_id", F.explode(S.fabricated_items(F.col("claim_text"), F.col("claim_id"), 3)).alias("x")).select("claim_id", "x.ordinal", "x.text", "x.source_url")


def _one_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prediction_id, cohort, evidence): one prediction of every record, that of the full gate where there is one."""
    rows = _shown(spark, sf_dir, "record_index", "cohort", "policy")
    first = F.min(F.struct(F.coalesce(F.col("policy") != "full_gate", F.lit(True)), "policy", "prediction_id", "cohort", "evidence"))
    return rows.groupBy("record_index").agg(first.alias("x")).select("x.prediction_id", "x.cohort", "x.evidence")


def _donors(rows: DataFrame) -> DataFrame:
    ids = rows.where("cohort is not null").select("prediction_id", "cohort", F.transform("evidence", lambda e: e["id"]).alias("ids"))
    return S.donors(ids, "prediction_id", "cohort", "ids")


_ONE = """one AS (SELECT x.prediction_id, x.cohort, x.evidence FROM (SELECT arg_min({'prediction_id': prediction_id, 'cohort': cohort, 'evidence': evidence}, {'a': coalesce(policy <> 'full_gate', true), 'b': policy, 'c': prediction_id}) AS x
  FROM (SELECT DISTINCT prediction_id, record_index, cohort, policy, coalesce(evidence, []) AS evidence FROM predictions) GROUP BY record_index))"""


@query(f"""WITH {_ONE}, r AS (SELECT prediction_id AS p, cohort, list_distinct(list_transform(evidence, lambda e: e.id)) AS ids, row_number() OVER (PARTITION BY cohort ORDER BY sha256('donor:' || prediction_id), prediction_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM one WHERE cohort IS NOT NULL)
SELECT prediction_id, donor, CAST(shared AS INTEGER) AS shared FROM (SELECT a.p AS prediction_id, b.p AS donor, len(list_intersect(a.ids, b.ids)) AS shared, row_number() OVER (PARTITION BY a.p ORDER BY len(list_intersect(a.ids, b.ids)), (b.i - a.i + a.n) % a.n) AS place
  FROM r a JOIN r b ON a.cohort = b.cohort AND a.p <> b.p) WHERE place = 1""")
def swap_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For one prediction of every record another record's of its cohort to take evidence from."""
    return _donors(cut(_one_per_record(spark, sf_dir)))


_NOISY = """array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE WHEN list_contains(list_transform(list_sort(list_transform(list_filter(range(1, length(t) + 1), lambda j: t[j] IN ('o', 'l', 'e', 'a')), lambda j: {'h': sha256(k || ':' || (j - 1)), 'j': j}))
  [:least(length(regexp_replace(t, '[^olea]', '', 'g')), greatest(1, ceil(round(length(t) * 0.02, 9))))::BIGINT], lambda x: x.j), i) THEN translate(t[i], 'olea', '01c@') ELSE t[i] END), '')"""


@query(f"""WITH {_ONE}, d AS ({query.sql["swap_donor"]}), b AS (SELECT one.*, concat_ws(':', one.cohort, one.prediction_id) AS key, o.evidence AS theirs FROM one LEFT JOIN d ON d.prediction_id = one.prediction_id LEFT JOIN one o ON o.prediction_id = d.donor),
i AS (SELECT prediction_id, coalesce(e.text, '') AS t, concat_ws(':', key, e.id) AS k, n FROM (SELECT prediction_id, key, unnest(evidence) AS e, unnest(range(1, len(evidence) + 1)) AS n FROM b)), z AS (SELECT prediction_id, list({_NOISY} ORDER BY n) AS noisy FROM i GROUP BY 1),
w AS (SELECT b.prediction_id, unnest([{{'condition': 'baseline', 'e': list_transform(evidence, lambda e: coalesce(e.text, ''))}}, {{'condition': 'ocr_noise', 'e': coalesce(noisy, [])}},
  {{'condition': 'fabricated_citation', 'e': list_transform(evidence, lambda e: 'Archive reference: SYNTHETIC-ARCHIVE-' || upper(substr(sha256(key), 1, 12)) || '. Page 7. Year 1899. ' || coalesce(e.text, ''))}},
  {{'condition': 'authoritative_wording', 'e': list_transform(evidence, lambda e: '{S.AUTHORITY}' || coalesce(e.text, ''))}}, {{'condition': 'evidence_absent', 'e': []::VARCHAR[]}}, {{'condition': 'swapped_context', 'e': list_transform(theirs, lambda e: coalesce(e.text, ''))}}]) AS x FROM b LEFT JOIN z ON z.prediction_id = b.prediction_id)
SELECT prediction_id, x.condition AS condition, CAST(len(x.e) AS INTEGER) AS n_evidence, sha256(CASE WHEN len(x.e) = 0 THEN '' ELSE array_to_string(x.e, chr(10)) END) AS digest FROM w""")
def stressed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's evidence under six conditions, a donor's evidence among them."""
    rows = cut(_one_per_record(spark, sf_dir))
    theirs = _donors(rows).join(rows.select(F.col("prediction_id").alias("donor"), F.col("evidence").alias("swapped")), "donor").select("prediction_id", "swapped")
    got = S.stressed_contexts(rows.join(theirs, "prediction_id", "left"), "prediction_id", "cohort", "evidence", "swapped")
    return got.select("prediction_id", "condition", F.size("evidence").alias("n_evidence"), F.sha2(F.array_join(F.transform("evidence", lambda e: X.text(e["text"])), "\n"), 256).alias("digest"))


@query("""WITH e AS (SELECT DISTINCT prediction_id, coalesce(list_transform(evidence, lambda x: x.id), []) AS ids FROM predictions) SELECT prediction_id, array_to_string(ids, ',') AS baseline, array_to_string(CASE WHEN len(ids) > 0 THEN list_concat(ids, [ids[1], ids[1], ids[1]]) ELSE ids END, ',') AS copies, array_to_string(list_reverse(ids), ',') AS reversed FROM e""")
def context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's evidence ids as they are, with three copies, and reversed."""
    rows = _shown(spark, sf_dir).select("prediction_id", "evidence").distinct()
    ids = F.transform("evidence", lambda e: e["id"])
    return rows.select("prediction_id", *(F.array_join(v, ",").alias(n) for n, v in S.context_variants(ids).items())).distinct()


@query(f"""WITH {_EV}, corpus AS (SELECT DISTINCT evidence_id AS id, {sql_normal('text')} AS whole FROM ev), s AS (SELECT DISTINCT prediction_id, evidence_id, {sql_normal('substr(text, 1, 40)')} AS shown FROM ev),
h AS (SELECT prediction_id, evidence_id, shown, bool_or(whole IS NOT NULL) AS known, coalesce(bool_or(starts_with(whole, shown)), false) AS fits FROM s LEFT JOIN corpus ON corpus.id = s.evidence_id GROUP BY ALL)
SELECT prediction_id, count(*) AS n, count_if(known) AS known, count_if(fits) AS prefix, count(*) > 0 AND count_if(fits) = count(*) AS bound FROM h GROUP BY prediction_id""")
def snapshot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first forty characters of every prediction's evidence begin a corpus text of the same id."""
    ev = cut(_shown(spark, sf_dir).select("prediction_id", F.explode("evidence").alias("e")).select("prediction_id", F.col("e.id").alias("eid"), F.col("e.text").alias("t")))
    shown = ev.select("prediction_id", "eid", F.substring("t", 1, 40).alias("shown"))
    return G.passage_trace(shown.distinct(), "prediction_id", "eid", "shown", ev, "eid", "t")


@query("""WITH m AS (SELECT DISTINCT claim_id, upper(trim(evidence_id)) AS id FROM tesla_phase1b_evidence_v0_1), s AS (SELECT DISTINCT claim_id, unnest(regexp_extract_all(coalesce(decisive_evidence_ids, ''), 'EVID-[0-9]+')) AS id FROM tesla_phase1b_verdicts_v0_1)
SELECT s.claim_id, count_if(m.id IS NULL) AS n_foreign, count_if(m.id IS NULL) = 0 AS admitted FROM s LEFT JOIN m ON m.claim_id = s.claim_id AND m.id = s.id GROUP BY s.claim_id""")
def pool_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every verdict's decisive evidence is evidence of its claim."""
    shown = load(spark, sf_dir, "tesla_phase1b_verdicts_v0_1", "claim_id", "decisive_evidence_ids").select("claim_id", F.explode(F.regexp_extract_all(X.text("decisive_evidence_ids"), F.lit("EVID-[0-9]+"), F.lit(0))).alias("id")).distinct()
    members = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "claim_id", "evidence_id").select("claim_id", F.upper(F.trim("evidence_id")).alias("id"))
    return G.pool_admission(shown.select("claim_id", F.col("claim_id").alias("pool"), "id"), "claim_id", "pool", "id", members, "claim_id", "id")


@query("""SELECT doc_id, CASE WHEN NOT starts_with(lower(coalesce(source_url, '')), 'https://') THEN 'unsafe_url' WHEN NOT contains(lower(coalesce(text, '')), 'the') THEN 'missing_anchor' WHEN trim(coalesce(text, '')) = '' THEN 'excerpt_not_in_page' END AS failure FROM documents""")
def source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that every document breaks as a captured page with the anchor 'the' and its own text as excerpt."""
    d = load(spark, sf_dir, "documents", "doc_id", "text", "source_url")
    return G.source_binding(d, "doc_id", F.col("source_url"), F.array(F.lit("the")), F.col("text"), F.sha2(X.text("text"), 256), F.col("text"))


@query("""WITH e AS (SELECT DISTINCT prediction_id, candidate_label AS l, coalesce(evidence, []) AS evidence FROM predictions), c AS (SELECT *, CASE WHEN len(evidence) > 0 THEN [evidence[1].id] ELSE [] END AS cited FROM e)
SELECT prediction_id, array_to_string(list_filter([CASE WHEN l IS NULL THEN 'abstained' END, CASE WHEN len(cited) = 0 THEN 'no_citation' END, CASE WHEN len(list_filter(evidence, lambda x: list_contains(cited, x.id) AND trim(coalesce(x.text, '')) = '')) > 0 THEN 'blank_excerpt' END], lambda x: x IS NOT NULL), ',') AS reasons,
  CASE WHEN l IS NOT NULL AND len(cited) > 0 AND len(list_filter(evidence, lambda x: list_contains(cited, x.id) AND trim(coalesce(x.text, '')) = '')) = 0 THEN sha256(list_filter(evidence, lambda x: list_contains(cited, x.id))[1].text) END AS digest FROM c""")
def evidence_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the first evidence text that every prediction may show, or why it shows none."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "candidate_label", "evidence").distinct().withColumn("evidence", F.coalesce("evidence", F.array().cast(ITEMS)))
    cited = F.when(F.size("evidence") > 0, F.array(F.col("evidence")[0]["id"])).otherwise(F.array().cast("array<string>"))
    d = G.evidence_display(F.col("candidate_label"), cited, F.col("evidence"))
    return rows.select("prediction_id", d.alias("d")).select("prediction_id", F.array_join("d.reasons", ",").alias("reasons"), F.get(F.col("d.shown"), F.lit(0))["digest"].alias("digest"))


def _rule_sql(rules: dict[str, str]) -> str:
    return "[" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in rules.items()) + "]"


def _validate_sql(table: str, key: str, rules: dict[str, str]) -> str:
    return f"""WITH r AS (SELECT DISTINCT * FROM {table}), m AS (SELECT {key} FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT {key}, array_to_string(list_filter(list_append({_rule_sql(rules)}, CASE WHEN {key} IN (SELECT {key} FROM m) THEN 'unique_key' END), lambda x: x IS NOT NULL), ',') AS errors FROM r"""


_CONF = "coalesce({}, '') IN ('low', 'medium', 'high')"
_DAY = "try_strptime({c}, '%Y-%m-%d') IS NOT NULL AND regexp_matches(coalesce({c}, ''), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"


_FILLED = "trim(coalesce({c}, '')) <> ''"
_URL = r"regexp_full_match({c}, 'https?://[^/?#\s]+.*', 's')"


@query(_validate_sql("tesla_claims_pilot_v0_1", "claim_id", {
    "claim_id": "regexp_full_match(trim(coalesce(claim_id, '')), '[A-Z0-9][A-Z0-9_-]*')", "canonical_claim_id": _FILLED.format(c="canonical_claim_id"), "claim_text": "length(trim(coalesce(claim_text, ''))) >= 10", "claimed_person": _FILLED.format(c="claimed_person"),
    "language": "regexp_full_match(trim(coalesce(language, '')), '[a-z]{2,3}(-[A-Z]{2})?')", "verdict_confidence": "verdict_confidence BETWEEN 0 AND 1", "sufficiency": "coalesce(sufficiency, '') IN ('sufficient', 'insufficient')", "verdict_matches_sufficiency": "(verdict = 'insufficient') = (sufficiency = 'insufficient')",
    "source_urls": f"coalesce(list_bool_and(list_transform(list_filter(list_transform(string_split(coalesce(source_urls, ''), ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {_URL.format(c='x')})), true)", "annotator_id": _FILLED.format(c="annotator_id"),
}))
def validate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every claim record."""
    return V.validate(load(spark, sf_dir, "tesla_claims_pilot_v0_1"), "claim_id", V.claim_rules()).select("claim_id", F.array_join("errors", ",").alias("errors"))


@query(_validate_sql("tesla_phase1b_evidence_v0_1", "evidence_id", {
    "evidence_id": "regexp_full_match(trim(coalesce(evidence_id, '')), 'EVID-[0-9]{3,}')", "claim_id": "regexp_full_match(trim(coalesce(claim_id, '')), 'T369-[0-9]{3,}')", "title": _FILLED.format(c="title"), "publisher_or_archive": _FILLED.format(c="publisher_or_archive"),
    "source_url": _URL.format(c="trim(coalesce(source_url, ''))"), "access_date": _DAY.format(c="access_date"), "source_rank": "source_rank BETWEEN 1 AND 5", "is_primary": "is_primary IS NOT NULL", "evidence_summary": "length(trim(coalesce(evidence_summary, ''))) >= 10", "provenance_family_id": _FILLED.format(c="provenance_family_id"),
    "no_self_parent": "NOT coalesce(upper(trim(parent_evidence_id)) = upper(trim(evidence_id)), false)", "copy_has_parent": "coalesce(provenance_relation, '') IN ('original', 'unknown') OR trim(coalesce(parent_evidence_id, '')) <> ''", "provenance_confidence": _CONF.format("provenance_confidence"), "annotator_id": _FILLED.format(c="annotator_id"),
}))
def validate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every evidence record."""
    return V.validate(load(spark, sf_dir, "tesla_phase1b_evidence_v0_1"), "evidence_id", V.evidence_rules()).select("evidence_id", F.array_join("errors", ",").alias("errors"))


@query(_validate_sql("tesla_phase1b_search_log_v0_1", "execution_id", {
    "execution_id": "regexp_matches(coalesce(execution_id, ''), '^RUN-[0-9]+$')", "query_text": "trim(coalesce(query_text, '')) <> ''",
    "executed_at_utc": r"regexp_matches(coalesce(executed_at_utc, ''), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$')", "authenticating_status": "authenticating_result = (result_status = 'authenticating_source_located')",
}))
def validate_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every search execution."""
    return V.validate(load(spark, sf_dir, "tesla_phase1b_search_log_v0_1"), "execution_id", V.search_rules()).select("execution_id", F.array_join("errors", ",").alias("errors"))




@query(_validate_sql("tesla_phase1b_provenance_edges_v0_1", "edge_id", {
    "edge_id": "regexp_matches(coalesce(edge_id, ''), '^EDGE-[0-9]+$')", "two_ends": "trim(coalesce(child_evidence_id, '')) <> '' AND trim(coalesce(parent_evidence_id, '')) <> ''", "no_loop": "NOT coalesce(upper(trim(child_evidence_id)) = upper(trim(parent_evidence_id)), false)",
    "two_signals": "len(list_distinct(list_filter(list_transform(string_split(coalesce(dependency_signals, ''), ';'), lambda x: trim(x)), lambda x: x <> ''))) >= 2",
    "known_signals": f"len(list_filter(list_transform(string_split(coalesce(dependency_signals, ''), ';'), lambda x: trim(x)), lambda x: x <> '' AND NOT list_contains({V.SIGNALS}, x))) = 0", "confidence": _CONF.format("confidence"),
}))
def validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every provenance edge."""
    return V.validate(load(spark, sf_dir, "tesla_phase1b_provenance_edges_v0_1"), "edge_id", V.edge_rules()).select("edge_id", F.array_join("errors", ",").alias("errors"))


@query(_validate_sql("tesla_phase1b_verdicts_v0_1", "claim_id", {
    "claim_id": "regexp_matches(coalesce(claim_id, ''), '^T369-[0-9]+$')", "verdict_confidence": "verdict_confidence BETWEEN 0 AND 1", "annotation_date": _DAY.format(c="annotation_date"),
    "review_needed": "requires_human_review OR label_status <> 'machine_assisted_provisional'", "insufficient_says_why": "sufficiency <> 'insufficient' OR trim(coalesce(missing_evidence, '')) <> ''",
}))
def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of every provisional verdict."""
    return V.validate(load(spark, sf_dir, "tesla_phase1b_verdicts_v0_1"), "claim_id", V.verdict_rules()).select("claim_id", F.array_join("errors", ",").alias("errors"))


@query("""SELECT 'evidence' AS source, evidence_id AS id, claim_id AS missing FROM (SELECT DISTINCT evidence_id, claim_id FROM tesla_phase1b_evidence_v0_1 WHERE claim_id <> '') WHERE claim_id NOT IN (SELECT claim_id FROM tesla_claims_pilot_v0_1 WHERE claim_id IS NOT NULL)
UNION ALL SELECT 'edges', edge_id, p FROM (SELECT DISTINCT edge_id, upper(trim(parent_evidence_id)) AS p FROM tesla_phase1b_provenance_edges_v0_1) WHERE p <> '' AND p NOT IN (SELECT upper(trim(evidence_id)) FROM tesla_phase1b_evidence_v0_1 WHERE evidence_id IS NOT NULL)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of unknown claims, and edges with unknown parents."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id").distinct()
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id")
    edges = load(spark, sf_dir, "tesla_phase1b_provenance_edges_v0_1", "edge_id", "parent_evidence_id").select("edge_id", F.upper(F.trim("parent_evidence_id")).alias("p")).distinct()
    a = V.orphans(ev, F.col("claim_id"), claims, F.col("claim_id")).select(F.lit("evidence").alias("source"), F.col("evidence_id").alias("id"), F.col("claim_id").alias("missing"))
    b = V.orphans(edges, F.col("p"), ev, F.upper(F.trim("evidence_id"))).select(F.lit("edges").alias("source"), F.col("edge_id").alias("id"), F.col("p").alias("missing"))
    return a.unionByName(b)


@query("""WITH a AS (SELECT DISTINCT key, json_extract_string(response, '$.answer') AS x FROM answers), b AS (SELECT DISTINCT key, answer AS x FROM responses_used), j AS (SELECT a.key AS ka, b.key AS kb, a.x AS xa, b.x AS xb FROM a FULL JOIN b ON a.key = b.key)
SELECT count_if(ka IS NOT NULL AND kb IS NOT NULL) AS n_both, count_if(kb IS NULL) AS n_left_only, count_if(ka IS NULL) AS n_right_only, count_if(ka IS NOT NULL AND kb IS NOT NULL AND xa IS DISTINCT FROM xb) AS n_unequal FROM j""")
def align_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the cached answers and the used responses match on their keys and agree."""
    a = load(spark, sf_dir, "answers", "key", "response").select("key", F.get_json_object("response", "$.answer").alias("x")).distinct()
    b = load(spark, sf_dir, "responses_used", "key", "answer").select("key", F.col("answer").alias("x")).distinct()
    return V.align(a, b, ["key"], ["x"])


@query("""WITH r AS (SELECT DISTINCT record_index FROM predictions), p AS (SELECT DISTINCT policy FROM predictions WHERE policy IS NOT NULL), h AS (SELECT record_index, policy, count(DISTINCT prediction_id) AS n FROM predictions GROUP BY ALL)
SELECT r.record_index, p.policy, CASE WHEN h.n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM r, p LEFT JOIN h ON h.record_index = r.record_index AND h.policy = p.policy WHERE h.n IS NULL OR h.n > 1""")
def expected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without one prediction of every policy."""
    p = load(spark, sf_dir, "predictions", "prediction_id", "record_index", "policy").distinct()
    policies = cut(p.where("policy is not null").select("policy").distinct())
    few = policies.count() <= 10_000
    want = p.select("record_index").distinct().crossJoin(F.broadcast(policies) if few else policies)
    return V.expected_keys(p, ["record_index", "policy"], want)


@query(f"WITH {_S} SELECT policy, count_if(abs(list_sum(probs) - 1) <= 1e-6 AND list_min(probs) >= 0 AND list_max(probs) <= 1) AS n_valid, count(*) AS n FROM s GROUP BY policy")
def valid_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predictions have valid probabilities, per policy."""
    return scored(spark, sf_dir).groupBy("policy").agg(F.count_if(V.valid_distribution(F.col("probs"))).alias("n_valid"), F.count(F.lit(1)).alias("n"))


@query("""SELECT a."key", t.fullkey AS path, CASE WHEN t.type = 'NULL' THEN 'null' ELSE CAST(t.atom AS VARCHAR) END AS value FROM (SELECT DISTINCT "key", response FROM answers WHERE json_valid(response)) a, json_tree(a.response) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of the answers' JSON with its path."""
    return V.json_leaves(load(spark, sf_dir, "answers", "key", "response").distinct(), "key", "response")


QUERIES, SQL = query.queries, query.sql
