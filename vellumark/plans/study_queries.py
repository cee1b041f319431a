"""Queries of replays, audits and the measures that studies report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import arrow as A
from vellumark.functions import text as X
from vellumark.operators import decisions as D
from vellumark.operators import grouping as G
from vellumark.operators import inference as I
from vellumark.operators import metrics as M
from vellumark.operators import retrieval as R
from vellumark.operators import sampling as P
from vellumark.operators import studies as T
from vellumark.plans.decision_queries import _EV, _evidence_scores
from vellumark.plans.metric_queries import _L, _PAIRS, _policy_pairs, _S, LABELS, scored
from vellumark.plans.registry import Register
from vellumark.plans.search_queries import _BM25, _claim_tokens, _TOKENS
from vellumark.plans.text_queries import sql_normal, sql_tokens
from vellumark.tables import cut, load

query = Register()
ITEMS = "array<struct<id:string,text:string>>"


def _replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their evidence as a list that is never null, and their gate probability, null where there was no gate."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "shown_claim", "evidence", "gate_probability", "generated_verdict", "generated_explanation").distinct()
    return rows.withColumn("evidence", F.coalesce("evidence", F.array().cast(ITEMS))).withColumn("gate", F.when(~F.isnan("gate_probability"), F.col("gate_probability")))


_LINES = "array_to_string(list_transform(evidence, lambda e: '[' || coalesce(e.id, '') || '] ' || coalesce(e.text, '')), chr(10))"
_REPLAY = f"""r AS (SELECT prediction_id, coalesce(shown_claim, '') AS claim, coalesce(evidence, []) AS evidence, CASE WHEN NOT isnan(gate_probability) THEN gate_probability END AS gate, generated_verdict AS v, coalesce(generated_explanation, '') AS x
  FROM (SELECT DISTINCT prediction_id, shown_claim, evidence, gate_probability, generated_verdict, generated_explanation FROM predictions)),
s AS (SELECT *, len(evidence) > 0 AS shown, len(evidence) > 0 AND coalesce(gate >= 0.5, true) AS passed, len(evidence) > 0 AND coalesce(gate >= 0.5, true) AND coalesce(v IN ('Supported', 'Refuted', 'Not Enough Evidence'), false) AS valid, {_LINES} AS lines FROM r)"""


@query(f"""WITH {_REPLAY} SELECT prediction_id, array_to_string(list_concat(['collapse_context', 'gate'], CASE WHEN passed THEN ['verdict'] ELSE [] END, CASE WHEN valid THEN ['explanation', 'numeric_check'] ELSE [] END), ',') AS stages,
  CASE WHEN NOT shown THEN 'no_evidence' WHEN NOT passed THEN 'gate_below_threshold' WHEN NOT valid THEN 'invalid_verdict' WHEN x = '' THEN 'empty_explanation' ELSE '' END AS reasons,
  CASE WHEN valid AND x <> '' THEN v END AS label,
  CASE WHEN passed THEN sha256('Evidence: ' || lines || chr(10) || 'Claim: ' || claim || chr(10) || 'Reply only Supported, Refuted, or Not Enough Evidence.') END AS verdict_prompt,
  CASE WHEN valid THEN sha256('Evidence: ' || lines || chr(10) || 'Claim: ' || claim || chr(10) || 'Verdict: ' || v || chr(10) || 'Explain why this evidence supports, contradicts, or cannot establish the claim. Use only the supplied evidence and keep the explanation short.') END AS explanation_prompt FROM s""")
def generation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages, reasons, label and prompt digests of every prediction's replay, numbers aside."""
    r = _replays(spark, sf_dir)
    g = T.generation(F.col("shown_claim"), F.col("evidence"), F.col("gate"), F.col("generated_verdict"), F.col("generated_explanation"), None)
    return r.select("prediction_id", g.alias("g")).select(
        "prediction_id", F.array_join("g.stages", ",").alias("stages"), F.array_join("g.reasons", ",").alias("reasons"), "g.label", F.col("g.verdict_prompt_sha256").alias("verdict_prompt"), F.col("g.explanation_prompt_sha256").alias("explanation_prompt")
    )


@query()
def generation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's whole replay: collapsed context, gate, verdict, explanation, and the numbers that no input holds."""
    items = F.transform("evidence", lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), e["id"].alias("family_id")))
    r = _replays(spark, sf_dir).withColumn("evidence", G.collapse_context(items, "family_id", "text"))
    r = A.with_mapped(r, "generated_explanation", "used", A.canonical_numbers)
    r = r.withColumn("inputs", F.concat_ws(" ", X.text("shown_claim"), F.array_join(F.transform("evidence", lambda e: X.text(e["text"])), " ")))
    r = A.with_mapped(r, "inputs", "given", A.canonical_numbers)
    numbers = lambda c: F.filter(F.split(X.text(c), " "), lambda x: x != "")
    g = T.generation(F.col("shown_claim"), F.col("evidence"), F.col("gate"), F.col("generated_verdict"), F.col("generated_explanation"), F.array_except(numbers("used"), numbers("given")))
    return r.select("prediction_id", g.alias("g")).select("prediction_id", F.array_join("g.stages", ",").alias("stages"), F.array_join("g.reasons", ",").alias("reasons"), "g.label")


@query(f"""WITH c AS (SELECT DISTINCT prediction_id, trim(coalesce(claim, '')) AS claim, coalesce(evidence, []) AS evidence FROM predictions)
SELECT prediction_id, v.variant, sha256(CASE v.variant WHEN 'claim_only' THEN 'CLAIM: ' || claim WHEN 'claim_plus_evidence' THEN array_to_string(list_concat(['CLAIM: ' || claim],
  list_transform(list_filter(evidence, lambda e: trim(coalesce(e.text, '')) <> ''), lambda e: 'ANSWER: ' || trim(e.text))), chr(10)) END) AS digest FROM c, (SELECT unnest(['claim_only', 'claim_plus_evidence']) AS variant) v""")
def render_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every prediction's claim as each renderer shows it."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "claim", "evidence").distinct().withColumn("evidence", F.coalesce("evidence", F.array().cast(ITEMS)))
    each = F.array(*(F.struct(F.lit(n).alias("variant"), F.sha2(T.RENDERERS[n](F.col("claim"), F.col("evidence")), 256).alias("digest")) for n in ("claim_only", "claim_plus_evidence")))
    return rows.select("prediction_id", F.explode(each).alias("x")).select("prediction_id", "x.*")


@query(_BM25 + """, f AS (SELECT doc_id, provenance_family_id AS fam, lower(source) AS source FROM documents),
q0 AS (SELECT doc_id AS query_id, fam, source FROM f WHERE doc_id % 100 = 0), rel AS (SELECT DISTINCT q0.query_id, f.doc_id FROM q0 JOIN f ON q0.fam = f.fam AND q0.query_id <> f.doc_id),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE query_id <> doc_id AND rank <= 6), t5 AS (SELECT * FROM o WHERE rank <= 5),
h AS (SELECT query_id, min(rank) AS first FROM t5 JOIN rel USING (query_id, doc_id) GROUP BY 1),
j AS (SELECT q0.query_id, q0.source, q0.query_id IN (SELECT query_id FROM rel) AS scored, q0.query_id IN (SELECT query_id FROM t5) AS met, h.first FROM q0 LEFT JOIN h USING (query_id)),
u AS (SELECT * FROM j UNION ALL SELECT query_id, NULL, scored, met, first FROM j)
SELECT source, count(*) AS n_queries, count_if(scored)::BIGINT AS n_scored, count_if(NOT met)::BIGINT AS n_empty, round(sum(CASE WHEN scored THEN coalesce((first <= 1)::INT, 0) END) / nullif(count_if(scored), 0), 9) AS hit_1,
  round(sum(CASE WHEN scored THEN coalesce((first <= 5)::INT, 0) END) / nullif(count_if(scored), 0), 9) AS hit_5, round(sum(CASE WHEN scored THEN coalesce(1 / first, 0) END) / nullif(count_if(scored), 0), 9) AS mrr FROM u GROUP BY source""")
def family_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon BM25 finds another document of the query's provenance family, per source of the query and over all."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "provenance_family_id", "source")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("text").alias("t"), F.col("provenance_family_id").alias("f"), F.lower("source").alias("source"))
    found = R.Postings(docs, "doc_id", "text").search(asked, "query", "t", 6).where("query <> doc")
    found = R.top(found.drop("rank"), ["query"], [F.desc("score"), F.asc("doc")], 5)
    relevant = asked.join(docs.select(F.col("doc_id").alias("doc"), "provenance_family_id"), F.col("f") == F.col("provenance_family_id")).where("query <> doc").select("query", "doc")
    got = T.hits_by_group(found, relevant, asked.select("query", "source"), "source", [1, 5], 5)
    return got.select(F.col("group").alias("source"), "n_queries", "n_scored", "n_empty", *(F.round(c, 9).alias(c) for c in ("hit_1", "hit_5", "mrr")))


_CLOSURE = """w AS (SELECT k.r AS a, m.h AS b FROM k JOIN (SELECT k, min(r) AS h FROM k GROUP BY k) m USING (k) UNION SELECT m.h, k.r FROM k JOIN (SELECT k, min(r) AS h FROM k GROUP BY k) m USING (k)),
reach(a, b) AS (SELECT a, b FROM w UNION SELECT reach.a, w.b FROM reach JOIN w ON reach.b = w.a), grp AS (SELECT a AS r, least(a, min(b)) AS g FROM reach GROUP BY a)"""


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT record_index AS r, {sql_normal('claim')} AS c, evidence FROM predictions),
k AS (SELECT r, 'c' || c AS k FROM p WHERE c <> '' UNION SELECT r, 'e' || e.id FROM (SELECT r, unnest(evidence) AS e FROM p WHERE c <> '') WHERE e.id <> ''), {_CLOSURE},
tr AS (SELECT DISTINCT unnest(train_indices) AS r FROM split_result), va AS (SELECT DISTINCT unnest(validation_indices) AS r FROM split_result), e AS (SELECT DISTINCT r FROM p WHERE c = ''),
al AS (SELECT DISTINCT p.r, coalesce(g, p.r) AS g FROM p LEFT JOIN grp USING (r)), bad AS (SELECT DISTINCT g FROM al WHERE r IN (SELECT r FROM tr))
SELECT r AS record_index, g AS group_id, CASE WHEN r IN (SELECT r FROM e) THEN 'empty' WHEN g IN (SELECT g FROM bad) THEN 'connected' ELSE 'independent' END AS status FROM al WHERE r IN (SELECT r FROM va)""")
def overlap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation records that claims or evidence connect to a training record, directly or through others."""
    rows = load(spark, sf_dir, "predictions", "record_index", "claim", "evidence").distinct()
    rows = rows.select("record_index", X.normal_claim("claim").alias("c"), F.explode_outer(F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(F.array(F.lit(None).cast("struct<id:string,text:string>")))).alias("e"))
    sides = load(spark, sf_dir, "split_result", "train_indices", "validation_indices")
    side = lambda c: sides.select(F.explode(c).alias("record_index"))
    got = T.overlap_audit(rows, "record_index", [F.col("c"), F.col("e.id")], F.col("c") == "", side("train_indices"), side("validation_indices"))
    return got.withColumnRenamed("group", "group_id")


_PRIOR = "(SELECT claim_id, claim_text FROM tesla_claims_pilot_v0_1 WHERE review_status = 'adjudicated' AND claim_id IS NOT NULL)"


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT c.claim_id AS r, {sql_normal('c.claim_text')} AS t, list_distinct({sql_tokens('c.claim_text')}) AS w FROM tesla_claims_pilot_v0_1 c WHERE c.claim_id IS NOT NULL),
pg AS (SELECT DISTINCT claim_id AS r, provenance_family_id AS page FROM tesla_phase1b_evidence_v0_1 WHERE provenance_family_id <> ''), k AS (SELECT r, page AS k FROM pg WHERE r IN (SELECT r FROM p)), {_CLOSURE},
al AS (SELECT DISTINCT p.r, coalesce(g, p.r) AS g FROM p LEFT JOIN grp USING (r)), old AS (SELECT DISTINCT list_distinct({sql_tokens('claim_text')}) AS w FROM {_PRIOR}), op AS (SELECT DISTINCT page FROM pg WHERE r IN (SELECT claim_id FROM {_PRIOR})),
bad AS (SELECT DISTINCT g FROM al WHERE r IN (SELECT claim_id FROM {_PRIOR}) OR r IN (SELECT r FROM pg JOIN op USING (page)) OR r IN (SELECT p.r FROM p, old WHERE len(p.w) > 0 AND len(list_intersect(p.w, old.w)) >= 0.8 * (len(p.w) + len(old.w) - len(list_intersect(p.w, old.w)))))
SELECT r AS claim_id, g AS group_id FROM (SELECT al.r, al.g, row_number() OVER (PARTITION BY p.t ORDER BY al.r) AS n FROM al JOIN p USING (r) WHERE al.g NOT IN (SELECT g FROM bad)) WHERE n = 1""")
def fresh_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that share no provenance family, directly or through others, with adjudicated claims or near-equal wordings, one per text."""
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text", "review_status").where("claim_id is not null").distinct()
    pages = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "claim_id", "provenance_family_id").where("provenance_family_id <> ''").distinct()
    rows = claims.select("claim_id", "claim_text").distinct().join(pages, "claim_id", "left").select("claim_id", "claim_text", F.array_compact(F.array("provenance_family_id")).alias("pages"))
    prior = claims.where("review_status = 'adjudicated'").select("claim_id", "claim_text")
    old_pages = pages.join(prior.select("claim_id"), "claim_id", "left_semi").select(F.col("provenance_family_id").alias("page")).distinct()
    got = T.select_fresh(rows, "claim_id", "claim_text", F.col("pages"), prior.select("claim_id").distinct(), old_pages, prior.select(F.col("claim_text").alias("text")).distinct(), lambda c: F.array_distinct(X.tokens(c)))
    return got.withColumnRenamed("group", "group_id")


@query(f"""WITH RECURSIVE t AS (SELECT DISTINCT claim_id AS r, {sql_tokens('claim_text')} AS w FROM tesla_claims_pilot_v0_1 WHERE claim_id IS NOT NULL),
k AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)), {_CLOSURE}
SELECT DISTINCT t.r AS claim_id, coalesce(g, t.r) AS group_id FROM t LEFT JOIN grp USING (r)""")
def sequence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that share five consecutive words, directly or through others."""
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return T.sequence_groups(claims, "claim_id", X.tokens("claim_text")).withColumnRenamed("group", "group_id")


@query(f"""WITH {_S}, {_L}, g AS (SELECT policy, cohort AS group_id, label, count_if(truth = label AND said = label)::DOUBLE AS tp, count_if(said = label)::DOUBLE AS pp, count_if(truth = label)::DOUBLE AS n FROM s, l WHERE cohort IS NOT NULL GROUP BY ALL),
i AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT group_id FROM g)),
d AS (SELECT r.rep, CAST('0x' || substr(sha256('macro:' || r.rep || ':' || i.i), 1, 8) AS BIGINT) % k AS i FROM i, (SELECT unnest(range(1, 201)) AS rep) r),
f AS (SELECT d.rep, g.policy, g.label, sum(tp) AS tp, sum(pp) AS pp, sum(n) AS n FROM d JOIN i USING (i) JOIN g USING (group_id) GROUP BY ALL UNION ALL SELECT 0, policy, label, sum(tp), sum(pp), sum(n) FROM g GROUP BY ALL),
m AS (SELECT rep, policy, avg(CASE WHEN pp + n > 0 THEN 2 * tp / (pp + n) ELSE 0 END) AS f1 FROM f GROUP BY ALL), c AS (SELECT a.rep, a.f1 - b.f1 AS x FROM m a JOIN m b USING (rep) WHERE a.policy = 'full_gate' AND b.policy = 'ungated')
SELECT round(max(CASE WHEN rep = 0 THEN x END), 9) AS estimate, round(quantile_cont(CASE WHEN rep > 0 THEN x END, 0.025), 9) AS low, round(quantile_cont(CASE WHEN rep > 0 THEN x END, 0.975), 9) AS high FROM c""")
def macro_change_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of macro-F1 from the ungated policy to the full gate, with a 95 % interval from resampled cohorts."""
    rows = scored(spark, sf_dir).where("cohort is not null and policy in ('ungated', 'full_gate')")
    return I.bootstrap_macro_change(rows, "cohort", "policy", "ungated", "full_gate", "truth", "said", LABELS, "macro").select(*(F.round(c, 9).alias(c) for c in ("estimate", "low", "high")))


_TWO = f"""WITH {_S}, a AS (SELECT record_index, min(cohort) AS cohort, min(truth) AS truth, min(pred) AS full_label FROM s WHERE policy = 'full_gate' GROUP BY record_index), b AS (SELECT record_index, min(pred) AS masked_label FROM s WHERE policy = 'semantic_gate' GROUP BY record_index)"""


@query(_TWO + """ SELECT cohort, count_if(coalesce(full_label IS NULL AND masked_label = truth, false))::BIGINT AS added_right, count_if(coalesce(full_label IS NULL AND masked_label <> truth, false))::BIGINT AS added_wrong, count_if(coalesce(masked_label IS NULL AND full_label = truth, false))::BIGINT AS removed_right,
  count_if(coalesce(masked_label IS NULL AND full_label <> truth, false))::BIGINT AS removed_wrong FROM a JOIN b USING (record_index) GROUP BY cohort""")
def gate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that the semantic gate adds and removes against the full gate, right and wrong, per cohort."""
    rows = scored(spark, sf_dir)
    full = rows.where("policy = 'full_gate'").groupBy("record_index").agg(F.min("cohort").alias("cohort"), F.min("truth").alias("truth"), F.min("pred").alias("full_label"))
    masked = rows.where("policy = 'semantic_gate'").groupBy("record_index").agg(F.min("pred").alias("masked_label"))
    return T.gate_changes(full.join(masked, "record_index"), ["cohort"], "truth", "full_label", "masked_label")


@query(f"""WITH {_S} SELECT policy, cohort, count_if(truth <> 'Supported' AND coalesce(pred = 'Supported', false))::BIGINT AS n_events, count_if(truth <> 'Supported')::BIGINT AS n_base,
  round(count_if(truth <> 'Supported' AND coalesce(pred = 'Supported', false)) / nullif(count_if(truth <> 'Supported'), 0), 9) AS rate FROM s GROUP BY GROUPING SETS ((policy, cohort), (policy))""")
def false_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a policy calls a claim supported that isn't, per cohort and over all."""
    got = T.rate_by(scored(spark, sf_dir), [["policy", "cohort"], ["policy"]], F.coalesce(F.col("pred") == "Supported", F.lit(False)), F.col("truth") != "Supported")
    return got.select("policy", "cohort", "n_events", "n_base", F.round("rate", 9).alias("rate"))


@query("""SELECT field_group, field, n_filled, n_rows FROM (SELECT count(*) AS n_rows, count(nullif(trim(publication_date), '')) AS publication_date, count(nullif(trim(access_date), '')) AS access_date, count(nullif(trim(source_url), '')) AS source_url,
  count(nullif(trim(parent_evidence_id), '')) AS parent_evidence_id, count(nullif(trim(provenance_family_id), '')) AS provenance_family_id FROM (SELECT DISTINCT * FROM tesla_phase1b_evidence_v0_1)) UNPIVOT (n_filled FOR field IN (publication_date, access_date, source_url, parent_evidence_id, provenance_family_id))
  JOIN (VALUES ('publication_date', 'time'), ('access_date', 'time'), ('source_url', 'source'), ('parent_evidence_id', 'provenance'), ('provenance_family_id', 'provenance')) g(field, field_group) USING (field)""")
def metadata_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many evidence rows fill each field of the declared groups."""
    groups = {"time": ["publication_date", "access_date"], "source": ["source_url"], "provenance": ["parent_evidence_id", "provenance_family_id"]}
    rows = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1").distinct()
    fields = [(g, f) for g, fs in groups.items() for f in fs]
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count(F.when(F.trim(f) != "", F.lit(1))).alias(f) for _, f in fields))
    return one.select("n_rows", F.explode(F.array(*(F.struct(F.lit(g).alias("field_group"), F.lit(f).alias("field"), F.col(f).alias("n_filled")) for g, f in fields))).alias("x")).select("x.*", "n_rows")


@query("""SELECT k.copies, count(*) AS n_records, 0::BIGINT AS n_changed FROM (SELECT DISTINCT prediction_id, evidence FROM predictions), (SELECT unnest([0, 5, 10]) AS copies) k GROUP BY k.copies""")
def copy_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether collapsing a context undoes copies of its first item: records whose collapsed context changes, per number of copies."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "evidence").distinct().withColumn("e", F.coalesce("evidence", F.array().cast(ITEMS)))
    plain = G.collapse_context(F.col("e"), "id", "text")
    each = rows.select("prediction_id", "e", plain.alias("plain"), F.explode(F.array(*map(F.lit, [0, 5, 10]))).alias("copies"))
    more = F.when(F.size("e") > 0, F.concat("e", F.array_repeat(F.get("e", F.lit(0)), F.col("copies")))).otherwise(F.col("e"))
    each = each.withColumn("m", more)
    return each.withColumn("again", G.collapse_context(F.col("m"), "id", "text")).groupBy("copies").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(~F.col("again").eqNullSafe(F.col("plain"))).alias("n_changed"))


@query("""WITH p AS (SELECT DISTINCT prediction_id, coalesce(evidence, []) AS evidence FROM predictions), v AS (SELECT prediction_id, v.variant, CASE v.variant WHEN 'complete' THEN evidence WHEN 'one_removed' THEN list_concat(evidence[:1], evidence[3:]) ELSE evidence[:0] END AS e
  FROM p, (SELECT unnest(['complete', 'all_removed', 'one_removed']) AS variant) v)
SELECT prediction_id, variant, CAST(len(e) AS INTEGER) AS n, coalesce(array_to_string(list_transform(e, lambda x: coalesce(x.id, '')), ','), '') AS ids FROM v""")
def sufficiency_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's evidence whole, all removed, and without its second item."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "evidence").distinct().withColumn("e", F.coalesce("evidence", F.array().cast(ITEMS)))
    each = rows.select("prediction_id", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), c.alias("e")) for n, c in T.removals(F.col("e"), 2).items()))).alias("v"))
    return each.select("prediction_id", "v.variant", F.size("v.e").alias("n"), F.array_join(F.transform("v.e", lambda x: X.text(x["id"])), ",").alias("ids"))


_CHANGED = f"""WITH {_S}, c AS (SELECT prediction_id, bool_or(coalesce(shown_claim, '') <> coalesce(claim, '')) AS changed FROM predictions GROUP BY 1), u AS (SELECT s.*, changed, 'all' AS subset FROM s JOIN c USING (prediction_id) UNION ALL SELECT s.*, changed, 'changed' FROM s JOIN c USING (prediction_id) WHERE changed)"""


@query(_CHANGED + """ SELECT policy, subset, count(*) AS n, round(avg(CASE WHEN changed THEN 1e0 ELSE 0 END), 9) AS changed_share, round(avg(CASE WHEN said = truth THEN 1e0 ELSE 0 END), 9) AS accuracy, round(avg(p), 9) AS mean_confidence FROM u GROUP BY ALL""")
def changed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and confidence of every policy over all predictions, and over those whose shown claim isn't the claim."""
    changed = load(spark, sf_dir, "predictions", "prediction_id", "claim", "shown_claim").groupBy("prediction_id").agg(F.bool_or(X.text("claim") != X.text("shown_claim")).alias("changed"))
    rows = scored(spark, sf_dir).join(changed, "prediction_id")
    rows = rows.withColumn("subset", F.explode(F.when(F.col("changed"), F.array(F.lit("all"), F.lit("changed"))).otherwise(F.array(F.lit("all")))))
    yes = lambda c: F.round(F.avg(c.cast("double")), 9)
    return rows.groupBy("policy", "subset").agg(F.count(F.lit(1)).alias("n"), yes(F.col("changed")).alias("changed_share"), yes(F.col("said") == F.col("truth")).alias("accuracy"), F.round(F.avg("p"), 9).alias("mean_confidence"))


@query(f"""WITH {_EV}, m AS (SELECT prediction_id, max(s[2]) AS e, max(s[1]) AS c FROM sc GROUP BY 1), p AS (SELECT DISTINCT prediction_id, policy FROM predictions)
SELECT policy, count(*) AS n, round(avg(e), 9) AS mean_max_entailment, round(avg(c), 9) AS mean_max_contradiction FROM m JOIN p USING (prediction_id) GROUP BY policy""")
def explanation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each prediction's greatest entailment and contradiction over its passages, per policy."""
    best = _evidence_scores(spark, sf_dir).groupBy("prediction_id").agg(F.max(F.col("s")[1]).alias("e"), F.max(F.col("s")[0]).alias("c"))
    policies = load(spark, sf_dir, "predictions", "prediction_id", "policy").distinct()
    return best.join(policies, "prediction_id").groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 9).alias("mean_max_entailment"), F.round(F.avg("c"), 9).alias("mean_max_contradiction"))


_ALPHAS = [0.0, 0.25, 0.5, 0.75, 1.0]
_ADJUSTED = f"""WITH {_S}, {_L}, pr AS (SELECT list((n / t)::DOUBLE ORDER BY o) AS prior FROM (SELECT list_position(['Supported', 'Refuted', 'Not Enough Evidence'], truth) AS o, count(*) AS n, sum(count(*)) OVER () AS t FROM s GROUP BY truth)),
a AS (SELECT policy, truth, alpha, list_transform(list_zip(probs, prior), lambda z: round(z[1] / z[2] ** alpha, 12)) AS q FROM s, pr, (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.75e0, 1e0]) AS alpha)),
d AS (SELECT policy, truth, alpha, ['Supported', 'Refuted', 'Not Enough Evidence'][list_position(q, list_max(q))] AS y FROM a),
f AS (SELECT policy, alpha, label, 2 * count_if(truth = label AND y = label) / nullif(count_if(truth = label) + count_if(y = label), 0) AS f1 FROM d, l GROUP BY ALL), m AS (SELECT policy, alpha, avg(coalesce(f1, 0)) AS macro_f1 FROM f GROUP BY ALL)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    share = {r["truth"]: r["n"] for r in rows.groupBy("truth").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = [share.get(x, 0) / max(1, sum(share.values())) for x in LABELS]
    return I.alpha_scores(rows, ["policy"], "probs", "truth", LABELS, prior, _ALPHAS)


@query(_ADJUSTED + " SELECT policy, alpha, round(macro_f1, 9) AS macro_f1 FROM m")
def population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 of every policy's probabilities divided by powers of the labels' shares; power 0 is the plain argmax."""
    return _adjusted(spark, sf_dir).select("policy", "alpha", F.round("macro_f1", 9).alias("macro_f1"))


@query(_ADJUSTED + " SELECT policy, alpha, round(macro_f1, 9) AS macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY round(macro_f1, 12) DESC, alpha) AS n FROM m) WHERE n = 1")
def alpha_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of greatest macro-F1 for every policy, the smaller of equal ones."""
    best = R.top(_adjusted(spark, sf_dir), ["policy"], [F.desc(F.round("macro_f1", 12)), F.asc("alpha")], 1)
    return best.select("policy", "alpha", F.round("macro_f1", 9).alias("macro_f1"))


_RULES = f"""WITH {_S}, o AS (SELECT prediction_id, said = truth AS ok, p, list_sort(probs) AS q, length(said) AS w, record_index FROM s WHERE policy = 'ungated'),
x AS (SELECT prediction_id, ok, unnest([{{'rule': 'probability', 'v': round(p, 9)}}, {{'rule': 'margin', 'v': round(q[3] - q[2], 9)}}, {{'rule': 'least', 'v': round(-q[1], 9)}}, {{'rule': 'length', 'v': w::DOUBLE}}]) AS x FROM o),
r AS (SELECT x.rule, ok, row_number() OVER (PARTITION BY x.rule ORDER BY x.v DESC, prediction_id) AS place FROM x), k AS (SELECT policy AS gate, count(pred) AS k FROM s WHERE policy IN ('full_gate', 'semantic_gate') GROUP BY policy)"""


@query(_RULES + " SELECT rule, gate, k, round(avg(CASE WHEN place <= k THEN CASE WHEN ok THEN 1e0 ELSE 0 END END), 9) AS accuracy FROM r, k GROUP BY ALL")
def matched_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the ungated policy's best predictions by several rules, as many as each gate answers."""
    rows = scored(spark, sf_dir)
    counts = {r["policy"]: r["k"] for r in rows.where("policy in ('full_gate', 'semantic_gate')").groupBy("policy").agg(F.count("pred").alias("k")).collect()}
    p = F.col("probs")
    rules = {"probability": F.col("p"), "margin": M.margin(p), "least": -F.array_min(p), "length": F.length("said").cast("double")}
    got = T.at_rank_counts(rows.where("policy = 'ungated'"), rules, "prediction_id", counts, F.col("said") == F.col("truth"))
    return got.select("rule", F.col("at").alias("gate"), "k", F.round("accuracy", 9).alias("accuracy"))


@query(f"""WITH {_TOKENS}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS island FROM tok WHERE regexp_matches(token, '^\\p{{Lu}}')),
u AS (SELECT claim_id, min(pos) AS start, max(pos) + 1 AS stop, string_agg(token, ' ' ORDER BY pos) AS run FROM r GROUP BY claim_id, island), a AS (SELECT claim_id, min(pos) AS anchor FROM tok WHERE regexp_matches(token, '^[0-9]+$') GROUP BY 1),
g AS (SELECT u.*, CASE WHEN anchor < start THEN start - anchor WHEN anchor >= stop THEN anchor - stop + 1 ELSE 0 END AS gap FROM u JOIN a USING (claim_id))
SELECT claim_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", run FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY gap, start) AS n FROM g) WHERE n = 1""")
def nearest_capital_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of capitalised tokens nearest to each claim's first number."""
    tokens = cut(_claim_tokens(spark, sf_dir))
    anchors = tokens.where(F.col("token").rlike("^[0-9]+$")).groupBy("claim_id").agg(F.min("pos").alias("anchor"))
    return T.nearest_run(R.capital_runs(tokens, ["claim_id"], "pos", "token"), anchors, ["claim_id"], "anchor").select("claim_id", "start", "end", "run")


@query(f"""WITH {_EV}, p AS (SELECT DISTINCT prediction_id, claim, evidence FROM predictions WHERE len(evidence) > 0), x AS (SELECT prediction_id, list(round(s[2], 9) ORDER BY pos) AS scores FROM sc GROUP BY 1)
SELECT p.prediction_id, sha256(array_to_string(list_concat([coalesce(p.claim, '')], list_transform(p.evidence, lambda e: coalesce(e.id, '') || chr(30) || coalesce(e.text, ''))), chr(31))) AS context, array_to_string(list_reverse(scores), ',') IS NOT NULL AS carried, len(scores)::INT AS n
FROM p JOIN x USING (prediction_id)""")
def score_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every context's digest, and whether its scores can be carried to its items in reverse order."""
    rows = _evidence_scores(spark, sf_dir).groupBy("prediction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("s")[1].alias("v")))), lambda x: x["v"]).alias("scores"))
    items = load(spark, sf_dir, "predictions", "prediction_id", "claim", "evidence").distinct().where(F.size("evidence") > 0)
    j = items.join(rows, "prediction_id")
    back = T.carried_scores(F.col("evidence"), F.col("scores"), F.reverse("evidence"))
    return j.select("prediction_id", T.score_entry(F.col("claim"), F.col("evidence"), F.col("scores"))["context_sha256"].alias("context"), back.isNotNull().alias("carried"), F.size("scores").alias("n"))


@query("""WITH i AS (SELECT split_id, unnest(train_indices) AS r FROM split_result UNION ALL SELECT split_id, unnest(validation_indices) FROM split_result UNION ALL SELECT split_id, unnest(excluded_indices) FROM split_result),
c AS (SELECT split_id, r, count(*) AS n FROM i WHERE r IS NOT NULL GROUP BY ALL), k AS (SELECT record_index AS r, bool_or(trim(coalesce(claim, '')) <> '') AS ok FROM predictions GROUP BY 1)
SELECT split_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS n_repeated, count_if(ok IS NULL)::BIGINT AS n_unknown, count_if(NOT ok)::BIGINT AS n_without_claim FROM c LEFT JOIN k USING (r) GROUP BY split_id""")
def index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the record indices of each split."""
    s = load(spark, sf_dir, "split_result", "split_id", "train_indices", "validation_indices", "excluded_indices")
    lists = None
    for c in ("train_indices", "validation_indices", "excluded_indices"):
        one = s.select("split_id", F.lit(c).alias("side"), F.explode(c).alias("record_index"))
        lists = one if lists is None else lists.unionByName(one)
    known = load(spark, sf_dir, "predictions", "record_index", "claim").groupBy("record_index").agg(F.bool_or(F.trim(X.text("claim")) != "").alias("has_claim"))
    return T.index_problems(lists, "split_id", "side", "record_index", known)


@query("""SELECT prediction_id, array_to_string(list_filter([CASE WHEN len(e) > 3 THEN 'too_many' END, CASE WHEN len(list_distinct(list_transform(e, lambda x: coalesce(x.id, '<null>')))) < len(e) THEN 'repeated_id' END,
  CASE WHEN list_bool_or(list_transform(e, lambda x: trim(coalesce(x.id, '')) = '')) THEN 'missing_id' END, CASE WHEN list_bool_or(list_transform(e, lambda x: trim(coalesce(x.text, '')) = '')) THEN 'missing_text' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT DISTINCT prediction_id, coalesce(evidence, []) AS e FROM predictions)""")
def context_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every prediction's evidence list."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "evidence").distinct()
    return rows.select("prediction_id", F.array_join(T.context_problems(F.coalesce("evidence", F.array().cast(ITEMS))), ",").alias("problems"))


_ID = "nullif(upper(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')"
_LINKS = {
    "evidence_claim": (_ID.format("claim_id"), "tesla_phase1b_evidence_v0_1", _ID.format("claim_id"), "tesla_claims_pilot_v0_1"), "search_claim": (_ID.format("claim_id"), "tesla_phase1b_search_log_v0_1", _ID.format("claim_id"), "tesla_claims_pilot_v0_1"),
    "verdict_claim": (_ID.format("claim_id"), "tesla_phase1b_verdicts_v0_1", _ID.format("claim_id"), "tesla_claims_pilot_v0_1"), "edge_child": (_ID.format("child_evidence_id"), "tesla_phase1b_provenance_edges_v0_1", _ID.format("evidence_id"), "tesla_phase1b_evidence_v0_1"),
    "edge_parent": (_ID.format("parent_evidence_id"), "tesla_phase1b_provenance_edges_v0_1", _ID.format("evidence_id"), "tesla_phase1b_evidence_v0_1"), "evidence_parent": (_ID.format("parent_evidence_id"), "tesla_phase1b_evidence_v0_1", _ID.format("evidence_id"), "tesla_phase1b_evidence_v0_1"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS link, count(*) AS n_keys, count_if(k NOT IN (SELECT {pk} FROM {pt} WHERE {pk} IS NOT NULL))::BIGINT AS n_orphans FROM (SELECT DISTINCT {k} AS k FROM {t}) WHERE k IS NOT NULL" for n, (k, t, pk, pt) in _LINKS.items()))
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each link between the record tables, and those that lead nowhere."""
    clean = lambda c: F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    at = lambda name, c: load(spark, sf_dir, name, c)
    claims, ev, edges = "tesla_claims_pilot_v0_1", "tesla_phase1b_evidence_v0_1", "tesla_phase1b_provenance_edges_v0_1"
    to_claim = lambda t: (at(t, "claim_id"), clean("claim_id"), at(claims, "claim_id"), clean("claim_id"))
    to_evidence = lambda t, c: (at(t, c), clean(c), at(ev, "evidence_id"), clean("evidence_id"))
    return T.references({
        "evidence_claim": to_claim(ev), "search_claim": to_claim("tesla_phase1b_search_log_v0_1"), "verdict_claim": to_claim("tesla_phase1b_verdicts_v0_1"),
        "edge_child": to_evidence(edges, "child_evidence_id"), "edge_parent": to_evidence(edges, "parent_evidence_id"), "evidence_parent": to_evidence(ev, "parent_evidence_id"),
    })


@query(f"WITH {_S} SELECT prediction_id, said AS label, round(probs[list_position(['Supported', 'Refuted', 'Not Enough Evidence'], said)], 9) AS score FROM s")
def answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that every prediction gives its own answer."""
    return scored(spark, sf_dir).select("prediction_id", F.col("said").alias("label"), F.round(D.answer_score(F.col("probs"), F.col("said")), 9).alias("score"))


@query(_BM25 + f""", t10 AS (SELECT query_id, doc_id, rank FROM r WHERE query_id <> doc_id AND rank <= 11), ev AS (SELECT t10.*, list_distinct({sql_tokens('q.text')}) AS c, list_distinct({sql_tokens('d.text')}) AS e FROM t10 JOIN documents q ON q.doc_id = query_id JOIN documents d ON d.doc_id = t10.doc_id),
x AS (SELECT query_id, doc_id, rank, round(len(list_intersect(c, e)) / len(c), 9) AS score FROM ev)
SELECT query_id, doc_id, score, place FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM x) WHERE place <= 3""")
def rerank_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of BM25's ten best documents by an injected pair score (here the share of the query's words), ties in BM25's order."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), F.col("text").alias("qt"))
    found = R.Postings(docs, "doc_id", "text").search(asked, "query", "qt", 11).where("query <> doc")
    pairs = found.join(asked, "query").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    words = lambda c: F.array_distinct(X.tokens(c))
    s = F.round(F.size(F.array_intersect(words("qt"), words("text"))) / F.size(words("qt")), 9)
    best = R.top(pairs.select("query", "doc", F.col("rank").alias("before"), s.alias("score")), ["query"], [F.desc("score"), F.asc("before")], 3)
    return best.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("place"))


@query(f"""WITH {_S}, g AS (SELECT record_index, min(truth) AS label FROM s GROUP BY 1) SELECT record_index, label, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('strata:' || record_index), record_index) - 1) % 3 AS INTEGER) AS fold FROM g""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folds of whole records, balanced over true labels."""
    return P.stratified_group_folds(scored(spark, sf_dir).select("record_index", F.col("truth").alias("label")), "record_index", "label", 3, "strata")


@query("""SELECT prediction_id, CASE WHEN problems = '' THEN candidate_label END AS label, problems AS reasons FROM (SELECT prediction_id, candidate_label, array_to_string(list_filter([CASE WHEN len(e) > 3 THEN 'too_many' END, CASE WHEN len(list_distinct(list_transform(e, lambda x: coalesce(x.id, '<null>')))) < len(e) THEN 'repeated_id' END,
  CASE WHEN list_bool_or(list_transform(e, lambda x: trim(coalesce(x.id, '')) = '')) THEN 'missing_id' END, CASE WHEN list_bool_or(list_transform(e, lambda x: trim(coalesce(x.text, '')) = '')) THEN 'missing_text' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT DISTINCT prediction_id, candidate_label, coalesce(evidence, []) AS e FROM predictions))""")
def guarded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's label, refused where its context is malformed."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "candidate_label", "evidence").distinct()
    label, reasons = T.guarded(F.col("candidate_label"), T.context_problems(F.coalesce("evidence", F.array().cast(ITEMS))))
    return rows.select("prediction_id", label.alias("label"), F.array_join(reasons, ",").alias("reasons"))


@query(_PAIRS + f""", {_L}, j AS (SELECT a.record_index, truth, before, after, p0, p1 FROM a JOIN b USING (record_index)),
m AS (SELECT label, coalesce(2 * count_if(truth = label AND coalesce(before = label, false)) / nullif(count_if(coalesce(before = label, false)) + count_if(truth = label), 0), 0) AS fb, coalesce(2 * count_if(truth = label AND coalesce(after = label, false)) / nullif(count_if(coalesce(after = label, false)) + count_if(truth = label), 0), 0) AS fa FROM j, l GROUP BY label)
SELECT (SELECT count(*) FROM j) AS n, round(avg(fb), 9) AS macro_before, round(avg(fa), 9) AS macro_after, round(avg(fa) - avg(fb), 9) AS macro_change, (SELECT round(avg((before IS DISTINCT FROM after)::INT), 9) FROM j) AS flip_rate,
  (SELECT round(avg(p1 - p0), 9) FROM j) AS mean_change, (SELECT round(avg((p1 > p0)::INT), 9) FROM j) AS increase_rate FROM m""")
def gate_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1, flips and confidence from the ungated policy to the full gate."""
    got = T.robustness(_policy_pairs(spark, sf_dir), [], "truth", "before", "after", "p0", "p1", LABELS)
    return got.select("n", *(F.round(c, 9).alias(c) for c in ("macro_before", "macro_after", "macro_change", "flip_rate", "mean_change", "increase_rate")))


@query(f"""WITH {_EV}, f AS (SELECT prediction_id, max(s[2]) AS e, avg(cosine) AS c FROM sc GROUP BY 1), d AS (SELECT stddev_pop(e) AS de, stddev_pop(c) AS dc FROM f)
SELECT prediction_id, round(e / CASE WHEN de > 0 THEN de ELSE 1 END, 6) AS entailment, round(c / CASE WHEN dc > 0 THEN dc ELSE 1 END, 6) AS cosine FROM f, d""")
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features of every prediction's evidence, at unit spread."""
    each = _evidence_scores(spark, sf_dir).groupBy("prediction_id").agg(F.max(F.col("s")[1]).alias("entailment"), F.avg("cosine").alias("cosine"))
    got = T.scaled(each, ["entailment", "cosine"])
    return got.select("prediction_id", F.round("entailment", 6).alias("entailment"), F.round("cosine", 6).alias("cosine"))


@query(f"""WITH RECURSIVE pp AS (SELECT DISTINCT record_index AS r, {sql_normal('claim')} AS c FROM predictions), k AS (SELECT r, c AS k FROM pp WHERE c <> ''), {_CLOSURE}, {_S},
ok AS (SELECT record_index AS r, bool_or(policy = 'full_gate' AND coalesce(pred = truth, false))::INT - bool_or(policy = 'ungated' AND coalesce(pred = truth, false))::INT AS d FROM s GROUP BY 1), gg AS (SELECT coalesce(g, ok.r) AS group_id, sum(d)::DOUBLE AS v, count(*)::DOUBLE AS w FROM ok LEFT JOIN grp ON grp.r = ok.r GROUP BY 1),
i AS (SELECT *, row_number() OVER (ORDER BY group_id) - 1 AS i, count(*) OVER () AS n FROM gg), d AS (SELECT z.rep, CAST('0x' || substr(sha256('linked:' || z.rep || ':' || i.i), 1, 8) AS BIGINT) % n AS i FROM i, (SELECT unnest(range(1, 101)) AS rep) z),
x AS (SELECT d.rep, sum(i.v) / sum(i.w) AS q FROM d JOIN i ON d.i = i.i GROUP BY d.rep)
SELECT round((SELECT sum(v) / sum(w) FROM gg), 9) AS estimate, round(quantile_cont(q, 0.025), 9) AS low, round(quantile_cont(q, 0.975), 9) AS high FROM x""")
def linked_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of accuracy from the ungated policy to the full gate, with an interval from resampled groups of records with the same claim."""
    rows = load(spark, sf_dir, "predictions", "record_index", "claim").distinct()
    groups = G.linked_groups(rows, "record_index", [X.normal_claim("claim")])
    right = lambda p: F.bool_or((F.col("policy") == p) & F.coalesce(F.col("pred") == F.col("truth"), F.lit(False))).cast("int")
    change = scored(spark, sf_dir).groupBy("record_index").agg((right("full_gate") - right("ungated")).alias("d"))
    own = change.join(groups, "record_index").groupBy(F.col("group").alias("group_id")).agg(F.sum("d").cast("double").alias("v"), F.count(F.lit(1)).cast("double").alias("w"))
    return I.bootstrap(own, "v", "w", "linked", 100).select(*(F.round(c, 9).alias(c) for c in ("estimate", "low", "high")))


QUERIES, SQL = query.queries, query.sql
