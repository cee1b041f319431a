"""Queries of sampling, splitting and exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.operators import sampling as S
from vellumark.plans.registry import Register
from vellumark.plans.text_queries import sql_normal
from vellumark.tables import load

query = Register()


def _claims(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return load(spark, sf_dir, "tesla_claims_pilot_v0_1", *cols).distinct()


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('audit:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 50")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents by hash."""
    return S.hash_sample(load(spark, sf_dir, "documents", "doc_id"), "doc_id", 50, "audit")


@query(f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rn FROM (SELECT min(h) AS h, min_by(doc_id, h) AS doc_id FROM (
  SELECT doc_id, {sql_normal('text')} AS t, sha256('texts:' || doc_id) AS h FROM documents) WHERE t <> '' GROUP BY t)) WHERE rn <= 50""")
def hash_sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of different texts by hash."""
    return S.hash_sample(load(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", 50, "texts", X.normal_claim("text"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('strata:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of every source by hash."""
    return S.stratified_sample(load(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", ["source"], 5, "strata")


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256('mod:' || doc_id), 1, 8) AS BIGINT) % 5 AS INTEGER) AS part FROM documents")
def hash_mod_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part of five by hash."""
    return S.hash_split(load(spark, sf_dir, "documents", "doc_id"), "doc_id", 5, "mod")


@query("SELECT claim_id, CAST((row_number() OVER (ORDER BY sha256('folds:' || claim_id), claim_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT claim_id FROM tesla_claims_pilot_v0_1 WHERE claim_id IS NOT NULL)")
def folds5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's fold of five, round-robin in hash order."""
    return S.folds(_claims(spark, sf_dir, "claim_id"), "claim_id", 5, "folds")


@query("""SELECT f AS family, CASE WHEN rn <= round(0.7 * n) THEN 'train' WHEN rn <= round(0.85 * n) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT f, row_number() OVER (ORDER BY sha256('cut:' || f), f) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT provenance_family_id AS f FROM documents WHERE provenance_family_id IS NOT NULL))""")
def group_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance families cut 70 / 15 / 15 in hash order."""
    families = load(spark, sf_dir, "documents", "provenance_family_id").withColumnRenamed("provenance_family_id", "family")
    return S.cut_by_order(families, "family", {"train": 0.7, "validation": 0.15, "test": 0.15}, "cut")


@query(f"""SELECT DISTINCT record_index FROM predictions p WHERE cohort <> 'fever_heldout' AND {sql_normal('claim')} NOT IN (SELECT {sql_normal('claim')} FROM predictions WHERE cohort = 'fever_heldout' AND {sql_normal('claim')} <> '')
  AND NOT EXISTS (SELECT 1 FROM predictions h WHERE h.cohort = 'fever_heldout' AND h.context_sha256 <> '' AND h.context_sha256 = p.context_sha256)""")
def anti_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside the held-out cohort that share neither claim nor context with it."""
    p = load(spark, sf_dir, "predictions", "record_index", "cohort", "claim", "context_sha256").distinct()
    new, prior = p.where("cohort <> 'fever_heldout'"), p.where("cohort = 'fever_heldout'")
    key = X.normal_claim("claim")
    return S.exclude(new, prior, [key, F.coalesce("context_sha256", F.lit(""))], [key, F.col("context_sha256")]).select("record_index").distinct()


@query(r"""WITH w AS (SELECT DISTINCT record_index, cohort = 'fever_heldout' AS held, list_sort(list_distinct(regexp_extract_all(lower(coalesce(claim, '')), '[\p{L}\p{N}]+'))) AS w FROM predictions WHERE cohort IS NOT NULL),
a AS (SELECT DISTINCT record_index, w FROM w WHERE NOT held), b AS (SELECT DISTINCT w FROM w WHERE held AND len(w) > 0),
h AS (SELECT DISTINCT a.record_index FROM a, b WHERE len(a.w) > 0 AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9)
SELECT DISTINCT record_index FROM a WHERE record_index NOT IN (SELECT record_index FROM h)""")
def jaccard_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside the held-out cohort whose claim isn't nearly one of its claims."""
    p = load(spark, sf_dir, "predictions", "record_index", "cohort", "claim").where("cohort is not null").distinct()
    words = F.regexp_extract_all(F.lower(F.coalesce("claim", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    new, prior = p.where("cohort <> 'fever_heldout'"), p.where("cohort = 'fever_heldout'")
    return S.exclude_similar(new, "record_index", words, prior, words).select("record_index").distinct()


@query()
def disjoint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows in hash order, without those that share an address or family with one taken before."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "source_url", "provenance_family_id").distinct()
    keys = ev.select("evidence_id", F.explode(F.array(F.concat(F.lit("u:"), F.col("source_url")), F.concat(F.lit("f:"), F.col("provenance_family_id")))).alias("k"))
    return S.disjoint_selection(ev.withColumn("h", S.hash_key("pick", F.col("evidence_id"))), "evidence_id", "h", keys, "k")


@query("SELECT DISTINCT claim_id, unnest([0, 5, 10])::INT AS n_copies, 1e0 / 3 AS weight FROM tesla_claims_pilot_v0_1")
def training_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim with 0, 5 and 10 copies, each weighing one third."""
    return S.training_variants(_claims(spark, sf_dir, "claim_id"), [0, 5, 10])


_TRIALS = 40


@query(f"""WITH g AS (SELECT cohort AS grp, true_label AS lab, count(DISTINCT record_index) AS n FROM predictions WHERE cohort IS NOT NULL AND true_label IS NOT NULL GROUP BY ALL),
e AS (SELECT g.*, t.trial, CAST('0x' || substr(sha256('split:' || t.trial || ':' || grp), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM g, (SELECT unnest(range(1, {_TRIALS + 1})) AS trial) t),
s AS (SELECT trial, lab, sum(CASE WHEN u < 0.2 THEN n ELSE 0 END) AS h, sum(n) AS t FROM e GROUP BY ALL),
c AS (SELECT trial, round(sum(((h - 0.2e0 * t) / (0.2e0 * t)) ** 2) + ((sum(h) - 0.2e0 * sum(t)) / (0.2e0 * sum(t))) ** 2, 12) AS cost FROM s GROUP BY trial),
b AS (SELECT trial FROM c ORDER BY cost, trial LIMIT 1)
SELECT DISTINCT e.grp AS cohort, u < 0.2 AS held_out FROM e JOIN b USING (trial)""")
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of forty hashed assignments of cohorts to a held-out fifth, by size and labels."""
    p = load(spark, sf_dir, "predictions", "record_index", "cohort", "true_label").where("cohort is not null and true_label is not null").distinct()
    return S.balanced_split(p.withColumn("one", F.lit(1)), "cohort", "true_label", "one", 0.2, _TRIALS, "split")


QUERIES, SQL = query.queries, query.sql
