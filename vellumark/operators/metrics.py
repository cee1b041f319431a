"""Exact evaluation metrics: each groups the rows once and finishes on the few grouped rows.

Abstention is a null prediction: an error over all rows, absent from covered rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """(by, truth, pred, n); a null prediction is kept as null."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """(by, label, precision, recall, f1, support) of every label from a confusion; 0 where undefined."""
    long = counts.select(*by, "truth", "pred", "n", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    is_truth, is_pred = F.col("truth") == F.col("label"), F.coalesce(F.col("pred") == F.col("label"), F.lit(False))
    sums = long.groupBy(*by, "label").agg(part(is_truth & is_pred).alias("tp"), part(is_pred).alias("pp"), part(is_truth).alias("support"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return sums.select(
        *by, "label", ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("pp") + F.col("support")).alias("f1"), "support"
    )


def macro(counts: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """(by, macro_f1, balanced_accuracy, accuracy): macro over all labels, balanced over those that occur as truth."""
    scores = class_scores(counts, by, labels)
    averaged = scores.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    right = counts.groupBy(*by).agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return averaged.join(right, by) if by else averaged.withColumn("accuracy", F.lit((right.first() or [None])[0]).cast("double"))


def squared_error(probabilities: Column, labels: list[str], truth: Column) -> Column:
    """Multiclass Brier score of one row."""
    hot = F.array(*(F.when(truth == x, F.lit(1.0)).otherwise(F.lit(0.0)) for x in labels))
    return F.aggregate(F.zip_with(probabilities, hot, lambda p, h: (p - h) * (p - h)), F.lit(0.0), lambda s, x: s + x)


def log_loss(probabilities: Column, labels: list[str], truth: Column, floor: float = 1e-12) -> Column:
    """Negative log probability of the truth."""
    index = F.array_position(F.array(*map(F.lit, labels)), truth)
    return -F.log(F.greatest(F.element_at(probabilities, index.cast("int")), F.lit(floor)))


def bin_of(score: Column, bins: int) -> Column:
    """Equal-width bin of a score in [0, 1], counted from 0; the last one holds 1."""
    return F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")


def reliability(df: DataFrame, by: list[str], score: str, correct: Column, bins: int = 15) -> DataFrame:
    """(by, bin, n, mean_score, accuracy) of every bin that has rows."""
    return df.where(F.col(score).isNotNull()).groupBy(*by, bin_of(F.col(score), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(correct.cast("double")).alias("accuracy")
    )


def calibration_error(df: DataFrame, by: list[str], score: str, correct: Column, bins: int = 15) -> DataFrame:
    """(by, ece): mean gap of score and accuracy over the bins, by their size."""
    per = reliability(df, by, score, correct, bins)
    return per.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_score"))) / F.sum("n")).alias("ece"))


RANGES = 512


def place_and_running(df: DataFrame, by: list[str], score: str, tie: str, value: Column) -> DataFrame:
    """df with place (from 1, by falling score, then tie), running (sum of value up to the row) and n, in each group.

    A group may hold most rows, so it isn't ordered in one task: the counts and sums of score ranges give each range its start, and only
    a range's rows are ordered together. Ranges follow the scores' own least and greatest value in the group.
    """
    bounds = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.count(F.lit(1)).alias("n"))
    if by:
        joined = df.join(bounds, by)
    else:
        lo, hi, n = bounds.first()
        joined = df.select("*", F.lit(lo).cast("double").alias("_lo"), F.lit(hi).cast("double").alias("_hi"), F.lit(n).alias("n"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    ranged = joined.withColumn("_range", F.least(F.floor((F.col("_hi") - F.col(score)) / width * RANGES), F.lit(RANGES - 1))).withColumn("_v", value.cast("double"))
    sums = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"), F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"))
    own = Window.partitionBy(*by, "_range").orderBy(F.desc(score), F.asc(tie))
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_p", F.row_number().over(own)).withColumn("_r", F.sum("_v").over(running))
    out = placed.join(starts, [*by, "_range"])
    return out.withColumn("place", F.col("_c0") + F.col("_p")).withColumn("running", F.col("_s0") + F.col("_r")).drop("_lo", "_hi", "_range", "_v", "_p", "_r", "_c0", "_s0")


def risk_coverage(df: DataFrame, by: list[str], score: str, tie: str, correct: Column) -> DataFrame:
    """(by, place, coverage, risk, score): errors among the best `place` rows, for every place."""
    rows = place_and_running(df, by, score, tie, F.when(correct, 0.0).otherwise(1.0))
    return rows.select(*by, "place", (F.col("place") / F.col("n")).alias("coverage"), (F.col("running") / F.col("place")).alias("risk"), F.col(score).alias("score"))


def aurc(df: DataFrame, by: list[str], score: str, tie: str, correct: Column) -> DataFrame:
    """(by, aurc): mean risk over all places."""
    return risk_coverage(df, by, score, tie, correct).groupBy(*by).agg(F.avg("risk").alias("aurc"))


def at_coverage(df: DataFrame, by: list[str], score: str, tie: str, correct: Column, targets: list[float]) -> DataFrame:
    """(by, target, k, threshold, risk) at k = ceil(target n), at least 1."""
    rows = place_and_running(df, by, score, tie, F.when(correct, 0.0).otherwise(1.0)).select(*by, "place", "running", "n", F.col(score).alias("threshold"))
    each = rows.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    k = F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.round(F.col("target") * F.col("n"), 9))))
    return each.where(F.col("place") == k).select(*by, "target", F.col("place").alias("k"), "threshold", (F.col("running") / F.col("place")).alias("risk"))


def ranking_quality(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """(by, roc_auc, average_precision): from counts per distinct score, ties shared; null without both classes (AUC) or positives (AP)."""
    per = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(positive.cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("s"))
    w = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = per.withColumn("tp", F.sum("p").over(w)).withColumn("all", F.sum("n").over(w))
    part = run.withColumn("area", (F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2)).withColumn("ap", F.col("p") * F.col("tp") / F.col("all"))
    total = part.groupBy(*by).agg(F.sum("area").alias("a"), F.sum("ap").alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("n"))
    negative = F.col("n") - F.col("pos")
    return total.select(*by, F.when((F.col("pos") > 0) & (negative > 0), F.col("a") / (F.col("pos") * negative)).alias("roc_auc"), F.when(F.col("pos") > 0, F.col("ap") / F.col("pos")).alias("average_precision"))


def retrieval_quality(found: DataFrame, relevant: DataFrame, query: str, doc: str, rank: str, k: int) -> DataFrame:
    """(query, hit, recall, reciprocal_rank, ndcg) at k for every query that has relevant documents."""
    wanted = relevant.select(query, doc).distinct()
    total = wanted.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    got = found.where(F.col(rank) <= k).join(wanted, [query, doc]).groupBy(query).agg(
        F.count(F.lit(1)).alias("_h"), F.min(rank).alias("_first"), F.sum(1 / F.log2(F.col(rank) + 1)).alias("_dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return total.join(got, query, "left").select(
        query,
        (F.coalesce("_h", F.lit(0)) > 0).alias("hit"),
        (F.coalesce("_h", F.lit(0)) / F.col("_n")).alias("recall"),
        F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("_dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def max_probability(p: Column) -> Column:
    return F.array_max(p)


def margin(p: Column) -> Column:
    """Difference of the two greatest probabilities."""
    s = F.array_sort(p)
    return F.element_at(s, -1) - F.element_at(s, -2)


def certainty(p: Column) -> Column:
    """1 + sum p ln p / ln K: 1 for a sure distribution, 0 for a flat one."""
    plogp = F.aggregate(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + plogp / F.log(F.size(p))))


def trapezoid(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, area): area under y over x, divided by the range of x; the points of a group are few (a grid)."""
    w = Window.partitionBy(*by).orderBy(x)
    step = df.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return step.groupBy(*by).agg((F.sum("_a") / (F.max(x) - F.min(x))).alias("area"))


def shift_summary(pairs: DataFrame, by: list[str], clean: str, stressed: str) -> DataFrame:
    """(by, mean_shift, mean_abs_shift, max_abs_shift, n) of a score under stress."""
    d = F.col(stressed) - F.col(clean)
    return pairs.groupBy(*by).agg(F.avg(d).alias("mean_shift"), F.avg(F.abs(d)).alias("mean_abs_shift"), F.max(F.abs(d)).alias("max_abs_shift"), F.count(F.lit(1)).alias("n"))


def transitions(pairs: DataFrame, by: list[str], truth: str, before: str, after: str) -> DataFrame:
    """(by, corrected, new_errors, wrong_in_both, right_in_both, flips); null predictions are wrong."""
    a, b = F.coalesce(F.col(before) == F.col(truth), F.lit(False)), F.coalesce(F.col(after) == F.col(truth), F.lit(False))
    return pairs.groupBy(*by).agg(
        F.count_if(~a & b).alias("corrected"),
        F.count_if(a & ~b).alias("new_errors"),
        F.count_if(~a & ~b).alias("wrong_in_both"),
        F.count_if(a & b).alias("right_in_both"),
        F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("flips"),
    )


def coverage_summary(df: DataFrame, sets: list[list[str]], truth: str, pred: str) -> DataFrame:
    """Rows, coverage, accuracy with abstentions as errors, and accuracy of the answered rows, for several groupings at once.

    A column that a grouping leaves out is null in its rows.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    ok = F.coalesce(F.col(truth) == F.col(pred), F.lit(False)).cast("double")
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *map(F.col, keys)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(pred).isNotNull().cast("double")).alias("coverage"), F.avg(ok).alias("accuracy"), F.avg(F.when(F.col(pred).isNotNull(), ok)).alias("covered_accuracy")
    )
