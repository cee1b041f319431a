"""Queries of models, calibration across folds, matching joins and Arrow text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import arrow as A
from vellumark.functions.text import sentences, tokens
from vellumark.operators import models as M
from vellumark.plans.metric_queries import scored
from vellumark.plans.registry import Register
from vellumark.plans.search_queries import _CLAIM_EV, _SENT, _claim_evidence
from vellumark.plans.text_queries import sql_tokens
from vellumark.tables import cut, load

query = Register()


@query()
def compatible_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's words after compatibility normalisation and case folding."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return A.with_mapped(c, "claim_text", "words", A.compatible_words).select("claim_id", "words")


@query()
def canonical_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical numbers of every generated explanation."""
    p = load(spark, sf_dir, "predictions", "prediction_id", "generated_explanation").distinct()
    return A.with_mapped(p, "generated_explanation", "numbers", A.canonical_numbers).select("prediction_id", "numbers")


@query()
def verdict_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced logistic model of the verdict over word TF-IDF, trained on four fifths of the claims and applied to the rest."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text", "verdict").where("verdict is not null").distinct()
    rows = cut(M.hash_split(c, "claim_id", 5, "model").select("claim_id", "verdict", "part", tokens("claim_text").alias("terms")))
    model = M.fit_text_model(rows.where("part > 0"), "terms", "verdict", features=1 << 12, rounds=20)
    return M.predict(model, rows.where("part = 0")).select("claim_id", "verdict", "label_predicted")


@query()
def cross_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's chance of a right answer, calibrated on the folds that it isn't in."""
    rows = scored(spark, sf_dir).where("policy = 'full_gate'").select("prediction_id", "p", "said", "truth")
    return M.cross_fitted(cut(rows), "prediction_id", "p", F.col("said") == F.col("truth")).select("prediction_id", "part", F.round("calibrated", 9).alias("calibrated"), F.round("prevalence", 9).alias("prevalence"))


@query(f"""WITH {_CLAIM_EV}, s AS (SELECT claim_id, evidence_id, i - 1 AS idx, sents[i] AS sent FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM (SELECT *, {_SENT.format(c='body')} AS sents FROM pairs))),
k AS (SELECT evidence_id, claim_id, evidence_id || ':' || lpad(idx::VARCHAR, 4, '0') AS key, len({sql_tokens('sent')}) AS words, idx FROM s),
w AS (SELECT evidence_id, claim_id AS g, key AS removed, words, row_number() OVER (PARTITION BY evidence_id, words ORDER BY key) AS k FROM k WHERE idx = 0),
a AS (SELECT g, words, max(k) AS most FROM w GROUP BY ALL), c AS (SELECT DISTINCT key, claim_id AS og, words FROM k),
o AS (SELECT a.g, a.words, c.key AS replacement, most, row_number() OVER (PARTITION BY a.g, a.words ORDER BY c.key) AS k FROM a JOIN c ON a.words = c.words AND c.og <> a.g)
SELECT evidence_id, removed, replacement FROM w JOIN o USING (g, words, k) WHERE k <= most""")
def length_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evidence row's first sentence one of another claim with as many words."""
    s = _claim_evidence(spark, sf_dir).select("claim_id", "evidence_id", F.posexplode(sentences("body")).alias("idx", "sent"))
    s = cut(s.select("evidence_id", "claim_id", "idx", F.concat_ws(":", "evidence_id", F.lpad(F.col("idx").cast("string"), 4, "0")).alias("key"), F.size(tokens("sent")).alias("words")))
    return M.length_matched(s.where("idx = 0"), s, "evidence_id", "claim_id", "words", "key")


@query("""WITH v AS (SELECT DISTINCT record_index, CASE policy WHEN 'ungated' THEN 0 WHEN 'full_gate' THEN 1 WHEN 'semantic_gate' THEN 2 ELSE 3 END AS i FROM predictions)
SELECT a.record_index, CAST(a.i AS INTEGER) AS variant, CAST(b.i AS INTEGER) AS next_variant FROM v a JOIN v b ON a.record_index = b.record_index AND b.i = (a.i + 1) % 4""")
def next_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each prediction's policy with the next one of the same record, in a circle."""
    i = F.when(F.col("policy") == "ungated", 0).when(F.col("policy") == "full_gate", 1).when(F.col("policy") == "semantic_gate", 2).otherwise(3)
    v = load(spark, sf_dir, "predictions", "record_index", "policy").select("record_index", i.alias("i")).distinct()
    return M.next_variant(v, "record_index", "i", 4).select("record_index", F.col("i").alias("variant"), F.col("next_index").alias("next_variant"))


@query("""WITH r AS (SELECT DISTINCT provenance_family_id AS path, 'tier' || source_rank AS sha256 FROM documents WHERE provenance_family_id IS NOT NULL), c AS (SELECT DISTINCT 'src' || source_rank AS source, source_rank AS priority, 'tier' || source_rank AS sha256 FROM documents WHERE is_primary),
h AS (SELECT path, min({'p': priority, 's': source}) AS b FROM r JOIN c USING (sha256) GROUP BY path)
SELECT r.path, h.b.s AS source FROM (SELECT path FROM r) r LEFT JOIN h USING (path)""")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate that fits each listed digest (here source ranks stand for digests)."""
    d = load(spark, sf_dir, "documents", "provenance_family_id", "source_rank", "is_primary")
    tier = F.concat(F.lit("tier"), F.col("source_rank").cast("string"))
    receipt = d.where("provenance_family_id is not null").select(F.col("provenance_family_id").alias("path"), tier.alias("sha256")).distinct()
    candidates = d.where("is_primary").select(F.concat(F.lit("src"), F.col("source_rank").cast("string")).alias("source"), F.col("source_rank").alias("priority"), tier.alias("sha256")).distinct()
    return M.restore_plan(receipt, candidates)


@query("""SELECT doc_id, m.marker FROM documents, (SELECT unnest(['archive', 'microfilm', 'верно']) AS marker) m WHERE contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), m.marker)""")
def blinding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forbidden markers in every document's text and source."""
    return M.leaks_markers(load(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", ["text", "source"], ["archive", "microfilm", "верно"])


QUERIES, SQL = query.queries, query.sql
