"""Decision rules over scored evidence: stances, gates, abstention, and the whole claim check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumark.functions.text import normal_claim
from vellumark.operators.grouping import linked_groups
from vellumark.operators.retrieval import Postings, top
from vellumark.tables import Cut

LABELS = ["Supported", "Refuted", "Not Enough Evidence"]


def stance(scores: Column) -> Column:
    """Contradiction, entailment, neutral as Supported, Refuted, Not Enough Evidence; without scores the last is sure."""
    return F.when(scores.isNull(), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(scores[1], scores[0], scores[2]))


def first_best(p: Column) -> Column:
    """The label of the greatest probability, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(p, F.array_max(p)).cast("int"))


def prior_adjusted(p: Column, prior: list[float], alpha: float) -> Column:
    """Index (from 1) of the label with the greatest p / prior ** alpha, the first of equal ones."""
    weighed = F.zip_with(p, F.array(*(F.lit(float(x) ** alpha) for x in prior)), lambda a, b: a / b)
    return F.array_position(weighed, F.array_max(weighed)).cast("int")


@dataclass(frozen=True)
class Check:
    """Settings of a claim check."""

    pool: int = 50
    k: int = 5
    least_components: int = 2
    least_confidence: float = 0.6
    least_margin: float = 0.15
    collapse: bool = True
    weigh_sources: bool = True
    need_primary: bool = False


def verify_claims(claims: DataFrame, documents: DataFrame, score, check: Check = Check()) -> DataFrame:
    """(claim_id, label, stance_scores, reasons, evidence, n_components, n_wrong_language, n_copies): each claim's candidate label, or null with the reasons for abstaining.

    claims: claim_id, claim, language; documents: id, text, language, source_rank, is_primary, provenance_family_id. The `pool` best
    documents by BM25 lose those of another declared language; documents with the same text or family, directly or through
    others, are copies of each other and only the best of them counts; the `k` best are scored by `score(claim, text)`, an array of
    contradiction, entailment and neutral, and averaged with weight 1 / source_rank.
    """
    d = documents.select(F.col("id").alias("doc"), "text", F.lower("language").alias("_dl"), F.coalesce("source_rank", F.lit(5)).alias("_rank"), F.coalesce("is_primary", F.lit(False)).alias("_primary"), "provenance_family_id")
    asked = claims.select(F.col("claim_id").alias("query"), "claim", F.lower("language").alias("_cl")).where("trim(claim) <> ''")
    hits = Postings(documents, "id", "text").search(asked.select("query", "claim"), "query", "claim", check.pool)
    pool = Cut(hits.join(asked, "query").join(d, "doc").withColumn("_ok", F.coalesce(F.col("_dl") == F.col("_cl"), F.lit(False)))).df
    eligible = pool.where("_ok").withColumn("_row", F.concat_ws("|", "query", F.lpad(F.col("rank").cast("string"), 6, "0")))
    if check.collapse:
        family = F.when(F.coalesce("provenance_family_id", F.lit("")) != "", F.concat_ws("|", "query", "provenance_family_id"))
        linked = linked_groups(eligible, "_row", [F.sha2(F.concat_ws("|", "query", normal_claim("text")), 256), family])
        eligible = eligible.join(linked, "_row")
        kept = eligible.where(F.col("_row") == F.col("group"))
    else:
        eligible = kept = eligible.withColumn("group", F.col("_row"))
    chosen = top(kept.drop("rank"), ["query"], [F.asc("_row")], check.k)
    scored = chosen.withColumn("_s", stance(score(F.col("claim"), F.col("text")))).withColumn("_w", 1 / F.col("_rank") if check.weigh_sources else F.lit(1.0))
    mean = lambda i: F.sum(F.col("_w") * F.col("_s")[i]) / F.sum("_w")
    per = scored.groupBy("query").agg(
        F.array(mean(0), mean(1), mean(2)).alias("p"), F.count(F.lit(1)).alias("n"), F.max("_primary").alias("primary"), F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("ev")
    )
    lost = pool.groupBy("query").agg(F.count_if(~F.col("_ok")).alias("n_wrong_language"))
    copies = eligible.groupBy("query").agg(F.count_if(F.col("_row") != F.col("group")).alias("n_copies"))
    j = asked.join(per, "query", "left").join(lost, "query", "left").join(copies, "query", "left")
    p = F.coalesce("p", F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    n = F.coalesce("n", F.lit(0))
    s = F.array_sort(p)
    label = first_best(p)
    reasons = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("no_compatible_evidence")),
            F.when(n < check.least_components, F.lit("too_few_components")),
            F.when(F.lit(check.need_primary) & ~F.coalesce("primary", F.lit(False)), F.lit("no_primary_source")),
            F.when(F.array_max(p) < check.least_confidence, F.lit("low_confidence")),
            F.when(F.element_at(s, -1) - F.element_at(s, -2) < check.least_margin, F.lit("ambiguous")),
            F.when(label == LABELS[2], F.lit("neutral_dominant")),
        )
    )
    return j.select(
        F.col("query").alias("claim_id"),
        F.when(F.size(reasons) == 0, label).alias("label"),
        F.transform(p, lambda x: F.round(x, 6)).alias("stance_scores"),
        reasons.alias("reasons"),
        F.coalesce(F.transform("ev", lambda e: e["doc"]), F.array().cast(T.ArrayType(pool.schema["doc"].dataType))).alias("evidence"),
        n.alias("n_components"),
        F.coalesce("n_wrong_language", F.lit(0)).alias("n_wrong_language"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )


def evidence_decision(df: DataFrame, record: str, position: str, scores: str, least: float = 0.6, margin: float = 0.15) -> DataFrame:
    """(record, label, p, position): the surest stance of a record's evidence; Not Enough Evidence where none is sure or two disagree.

    A stance needs p >= least and a lead of `margin` over the other two; the surest is the one of greatest p, then the earliest.
    """
    s = F.col(scores)
    lead = lambda i, j: (s[i] >= least) & (s[i] - F.greatest(s[j], s[2]) >= margin)
    said = F.when(lead(1, 0), F.lit(LABELS[0])).when(lead(0, 1), F.lit(LABELS[1]))
    rows = df.select(record, F.col(position).alias("_pos"), said.alias("_l"), F.when(lead(1, 0), s[1]).when(lead(0, 1), s[0]).alias("_p"))
    best = rows.groupBy(record).agg(F.count_if(F.col("_l") == LABELS[0]).alias("_a"), F.count_if(F.col("_l") == LABELS[1]).alias("_b"), F.max(F.when(F.col("_l").isNotNull(), F.struct(F.col("_p"), (-F.col("_pos")).alias("_np"), F.col("_l")))).alias("_m"))
    clear = ((F.col("_a") > 0) != (F.col("_b") > 0))
    return best.select(record, F.when(clear, F.col("_m._l")).otherwise(F.lit(LABELS[2])).alias("label"), F.when(clear, F.col("_m._p")).alias("p"), F.when(clear, -F.col("_m._np")).alias("position"))


def explanation_passes(scores: Column, least: float = 0.7, lead: float = 0.2) -> Column:
    """Whether an explanation is entailed surely enough."""
    return (scores[1] >= least) & (scores[1] - F.greatest(scores[0], scores[2]) >= lead)


def logistic_head(x: Column, columns: list[int], mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """1 / (1 + exp(-z)) of the standardised columns (numbered from 0) of a feature array."""
    terms = [(F.element_at(x, c + 1) - m) / s * w for c, m, s, w in zip(columns, mean, scale, weights, strict=True)]
    z = F.lit(float(intercept))
    for t in terms:
        z = z + t
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def masked(x: Column, means: list[float], hidden: list[int]) -> Column:
    """A feature array whose hidden places (numbered from 0) hold their training means."""
    m = F.array(*map(F.lit, means))
    return F.transform(x, lambda v, i: F.when(i.isin(hidden), F.get(m, i)).otherwise(v))


def apply_gate(label: Column, p: Column, reasons: Column, threshold: float) -> Column:
    """The label, or null where there are reasons against it, no probability, or one below the threshold."""
    return F.when((F.coalesce(F.size(reasons), F.lit(0)) == 0) & p.isNotNull() & (p >= threshold), label)


def answer_score(p: Column, label: Column) -> Column:
    """The probability of the given label, null for one that isn't in LABELS."""
    at = F.array_position(F.array(*map(F.lit, LABELS)), label)
    return F.when(at > 0, F.get(p, at.cast("int") - 1))


def agreement(a: Column, b: Column) -> Column:
    """The label both give, else null."""
    return F.when(a == b, a)


def stages_of(reasons: Column, p: Column, threshold: float, answer: Column, explanation_ok: Column, numbers_ok: Column) -> Column:
    """struct of the label that remains and the stages passed through: gate, verdict, explanation, numbers; the first failure ends it."""
    gate = (F.coalesce(F.size(reasons), F.lit(0)) == 0) & F.coalesce(p >= threshold, F.lit(False))
    verdict = gate & answer.isNotNull()
    explained = verdict & F.coalesce(explanation_ok, F.lit(False))
    label = F.when(explained & F.coalesce(numbers_ok, F.lit(False)), answer)
    steps = F.array_compact(F.array(F.lit("collapse_context"), F.lit("gate"), F.when(gate, F.lit("verdict")), F.when(verdict, F.lit("explanation")), F.when(explained, F.lit("numeric_check"))))
    return F.struct(label.alias("label"), steps.alias("stages"))


def likelihood_choice(log_probs: Column, labels: list[str]) -> Column:
    """struct of the labels with the greatest sum and the greatest mean of their tokens' log probabilities (array per label)."""
    sums = F.transform(log_probs, lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x))
    means = F.transform(log_probs, lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(xs), F.lit(1)))
    at = lambda xs: F.element_at(F.array(*map(F.lit, labels)), F.array_position(xs, F.array_max(xs)).cast("int"))
    return F.struct(at(sums).alias("by_sum"), at(means).alias("by_mean"))
