"""Resampling, randomisation, multiple tests and calibration.

Random draws are hashes of (seed, replicate, slot), so any engine and any retry draws the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.operators.metrics import place_and_running
from vellumark.tables import Cut


def draw(n: Column, *parts: Column) -> Column:
    """A whole number in [0, n) from the hash of the parts."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("long"), n)


def holm(tests: DataFrame, by: list[str], p: str, tie: str) -> DataFrame:
    """tests with `adjusted`: step-down adjusted p-values, at most 1, never falling with p. The tests of a group are few."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    stepped = tests.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    raw = (F.col("_m") - F.col("_k") + 1) * F.col(p)
    return stepped.withColumn("adjusted", F.least(F.lit(1.0), F.max(raw).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_k", "_m")


def bootstrap(groups: DataFrame, value: str, weight: str, seed: str, replicates: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(estimate, low, high) of sum(value) / sum(weight) when groups are drawn with replacement.

    groups has one row per group, already summed, so a replicate costs one draw per group. Group number i of n is drawn
    by hashing (seed, replicate, slot).
    """
    numbered = _numbered(groups.select("group_id", F.col(value).cast("double").alias("_v"), F.col(weight).cast("double").alias("_w")))
    held = Cut(numbered).df
    n = held.count()
    slots = held.select(F.col("_i").alias("_slot")).select("_slot", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    drawn = slots.select("_rep", draw(F.lit(n), F.lit(seed), F.col("_rep").cast("string"), F.col("_slot").cast("string")).alias("_i"))
    times = drawn.groupBy("_rep", "_i").agg(F.count(F.lit(1)).alias("_t"))
    ratio = times.join(held, "_i").groupBy("_rep").agg((F.sum(F.col("_t") * F.col("_v")) / F.sum(F.col("_t") * F.col("_w"))).alias("r"))
    ends = ratio.agg(F.percentile("r", F.lit(low)).alias("low"), F.percentile("r", F.lit(high)).alias("high"))
    estimate = held.agg(F.sum("_v") / F.sum("_w")).first()[0]
    return ends.select(F.lit(estimate).cast("double").alias("estimate"), "low", "high")


def bootstrap_macro_change(df: DataFrame, group: str, policy: str, before: str, after: str, truth: str, pred: str, labels: list[str], seed: str, replicates: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(estimate, low, high) of the change of macro-F1 from one policy to another when groups are drawn with replacement.

    Each group's counts per policy and label are summed once; a replicate sums those of the groups it draws, so rows are never drawn themselves.
    """
    each = df.where(F.col(policy).isin(before, after)).select(F.col(group).alias("group_id"), F.col(policy).alias("_p"), truth, pred)
    own = each.withColumn("_l", F.explode(F.array(*map(F.lit, labels)))).groupBy("group_id", "_p", "_l")
    said, is_ = F.coalesce(F.col(pred) == F.col("_l"), F.lit(False)), F.col(truth) == F.col("_l")
    counts = Cut(own.agg(F.count_if(said & is_).cast("double").alias("tp"), F.count_if(said).cast("double").alias("pp"), F.count_if(is_).cast("double").alias("n"))).df
    numbered = Cut(_numbered(counts.select("group_id").distinct())).df
    n = numbered.count()
    slots = numbered.select(F.col("_i").alias("_slot"), F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep"))
    times = slots.select("_rep", draw(F.lit(n), F.lit(seed), F.col("_rep").cast("string"), F.col("_slot").cast("string")).alias("_i")).groupBy("_rep", "_i").agg(F.count(F.lit(1)).alias("_t"))
    drawn = times.join(numbered, "_i").join(counts, "group_id").select("_rep", "_p", "_l", *((F.col("_t") * F.col(c)).alias(c) for c in ("tp", "pp", "n")))
    sums = drawn.unionByName(counts.select(F.lit(0).alias("_rep"), "_p", "_l", "tp", "pp", "n")).groupBy("_rep", "_p", "_l").agg(*(F.sum(c).alias(c) for c in ("tp", "pp", "n")))
    f1 = F.when(F.col("pp") + F.col("n") > 0, 2 * F.col("tp") / (F.col("pp") + F.col("n"))).otherwise(F.lit(0.0))
    macro = sums.groupBy("_rep", "_p").agg(F.avg(f1).alias("_f"))
    of = lambda x: F.max(F.when(F.col("_p") == x, F.col("_f")))
    change = macro.groupBy("_rep").agg((of(after) - of(before)).alias("x"))
    drawn_only = F.when(F.col("_rep") > 0, F.col("x"))
    return change.agg(F.max(F.when(F.col("_rep") == 0, F.col("x"))).alias("estimate"), F.percentile(drawn_only, F.lit(low)).alias("low"), F.percentile(drawn_only, F.lit(high)).alias("high"))


def alpha_scores(df: DataFrame, by: list[str], probabilities: str, truth: str, labels: list[str], prior: list[float], alphas: list[float]) -> DataFrame:
    """(by, alpha, macro_f1) where the decision is the label of the greatest probability / prior ** alpha, the first of equal ones (to 12 places)."""
    names = F.array(*map(F.lit, labels))

    def said(alpha: float) -> Column:
        weighed = F.zip_with(probabilities, F.array(*(F.lit(float(x) ** alpha) for x in prior)), lambda a, b: F.round(a / b, 12))
        return F.element_at(names, F.array_position(weighed, F.array_max(weighed)).cast("int"))

    each = df.select(*by, truth, F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), said(a).alias("y")) for a in alphas))).alias("d")).select(*by, truth, "d.*")
    counts = each.groupBy(*by, "alpha", F.col(truth).alias("_t"), "y").agg(F.count(F.lit(1)).alias("_n"))
    per = counts.withColumn("_l", F.explode(names)).groupBy(*by, "alpha", "_l").agg(
        F.sum(F.when((F.col("_t") == F.col("_l")) & (F.col("y") == F.col("_l")), F.col("_n")).otherwise(0)).alias("tp"), F.sum(F.col("_n") * ((F.col("_t") == F.col("_l")).cast("int") + (F.col("y") == F.col("_l")).cast("int"))).alias("d")
    )
    return per.groupBy(*by, "alpha").agg(F.avg(F.when(F.col("d") > 0, 2 * F.col("tp") / F.col("d")).otherwise(F.lit(0.0))).alias("macro_f1"))


def _numbered(groups: DataFrame) -> DataFrame:
    """groups with _i from 0 in the order of group_id: counts of ordered ranges give each range its first number."""
    ranged = groups.repartitionByRange("group_id").withColumn("_part", F.spark_partition_id())
    held = Cut(ranged).df
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("group_id"))
    return held.join(sizes.select("_part", first.alias("_first")), "_part").withColumn("_i", F.col("_first") + place - 1).drop("_part", "_first")


def sign_swap(groups: DataFrame, difference: str, most_exact: int = 12, seed: str = "swap", replicates: int = 2_000) -> DataFrame:
    """(observed, p_value, n_groups, exact): how often swapping signs of group differences gives as great a sum, in size.

    With at most `most_exact` groups that differ, all sign patterns are tried; else so many hashed ones, and p = (extreme + 1) / (R + 1).
    """
    active = groups.where(F.abs(difference) > 0).select("group_id", F.col(difference).cast("double").alias("_d"))
    k = active.count()
    observed = float(active.agg(F.coalesce(F.sum("_d"), F.lit(0.0))).first()[0])
    if k <= most_exact:
        order = Window.orderBy("group_id")
        placed = active.withColumn("_g", F.row_number().over(order) - 1)
        codes = placed.select("_d", "_g", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))).alias("_code"))
        sign = 1 - 2 * F.col("_code").bitwiseAND(F.expr("shiftleft(1, cast(_g as int))")).cast("boolean").cast("int")
    else:
        codes = active.select("_d", "group_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_code"))
        sign = 1 - 2 * draw(F.lit(2), F.lit(seed), F.col("_code").cast("string"), F.col("group_id").cast("string"))
    sums = codes.groupBy("_code").agg(F.sum(sign * F.col("_d")).alias("_s"))
    p = F.try_divide("e", "r") if k <= most_exact else (F.col("e") + 1) / (F.col("r") + 1)
    extreme = sums.agg(F.count_if(F.abs("_s") >= abs(observed) - 1e-12).alias("e"), F.count(F.lit(1)).alias("r"))
    return extreme.select(F.lit(observed).alias("observed"), F.when(F.col("r") == 0, F.lit(1.0)).otherwise(p).alias("p_value"), F.lit(k).alias("n_groups"), F.lit(k <= most_exact).alias("exact"))


def softmax(logits: Column, temperature: Column) -> Column:
    """Probabilities of logits at a temperature."""
    shifted = F.transform(logits, lambda x: F.exp((x - F.array_max(logits)) / temperature))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def temperature_grid(df: DataFrame, by: list[str], logits: str, truth_index: str, grid: list[float]) -> DataFrame:
    """(by, temperature, nll) of every temperature of a grid, in one pass over the rows."""
    each = df.select(*by, logits, truth_index, F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    p = F.element_at(softmax(F.col(logits), F.col("temperature")), F.col(truth_index))
    return each.groupBy(*by, "temperature").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("nll"))


def fit_temperature(df: DataFrame, logits: str, truth_index: str, low: float = 0.05, high: float = 20.0, rounds: int = 4, points: int = 12) -> float:
    """The temperature of least mean log loss: a grid over log temperature, narrowed a few times, each round one aggregation."""
    a, b, best = math.log(low), math.log(high), (float("inf"), 1.0)
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        rows = temperature_grid(df, [], logits, truth_index, [*grid, 1.0]).collect()
        got = min(((r["nll"], abs(math.log(r["temperature"])), r["temperature"]) for r in rows), default=None)
        if got is None:
            return 1.0
        best = min(best, (got[0], got[2]))
        step, centre = (b - a) / (points - 1), math.log(best[1])
        a, b = max(math.log(low), centre - step), min(math.log(high), centre + step)
    return best[1]


def fit_logit(df: DataFrame, x: Column, y: Column, rounds: int = 12, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of P(y) = 1 / (1 + exp(-(slope x + intercept))) by Newton steps; each step is one aggregation."""
    rows = df.select(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(w * F.col("x") + b)))
        v = p * (1 - p)
        s = rows.agg(*(F.coalesce(F.sum(e), F.lit(0.0)) for e in ((F.col("y") - p) * F.col("x"), F.col("y") - p, v * F.col("x") * F.col("x"), v * F.col("x"), v))).first()
        g0, g1, h00, h01, h11 = (float(e) for e in s)
        g0, h00, h11 = g0 - ridge * w, h00 + ridge, h11 + 1e-9
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-15:
            break
        dw, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        w, b = w + dw, b + db
        if abs(dw) + abs(db) < 1e-10:
            break
    return w, b


def threshold_scores(df: DataFrame, by: list[str], score: str, positive: Column, grid: list[float]) -> DataFrame:
    """(by, threshold, macro_f1, balanced_accuracy) of the rule score >= threshold, for a grid, in one pass."""
    each = df.select(*by, F.col(score).alias("_s"), positive.alias("_y"), F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    yes = F.col("_s") >= F.col("threshold")
    c = each.groupBy(*by, "threshold").agg(F.count_if(yes & F.col("_y")).alias("tp"), F.count_if(yes & ~F.col("_y")).alias("fp"), F.count_if(~yes & F.col("_y")).alias("fn"), F.count_if(~yes & ~F.col("_y")).alias("tn"))
    f1 = lambda t, a, b: F.when(2 * t + a + b > 0, 2 * t / (2 * t + a + b)).otherwise(F.lit(0.0))
    rate = lambda t, m: F.when(t + m > 0, t / (t + m)).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, "threshold", ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"), ((rate(tp, fn) + rate(tn, fp)) / 2).alias("balanced_accuracy"))


def choose_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    """The threshold of greatest macro-F1 per group; ties go to the one nearest one half, then to the lesser."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("macro_f1", 12)), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold")
    return scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def covering_threshold(df: DataFrame, by: list[str], score: str, tie: str, correct: Column, most_risk: float, least_answered: int) -> DataFrame:
    """(by, threshold, answered): the cut that answers most rows with a risk of `most_risk` or less, and at least so many; else 1.01."""
    rows = place_and_running(df, by, score, tie, F.when(correct, 0.0).otherwise(1.0))
    last = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.max(F.struct("place", "running")).alias("s"), F.max("n").alias("n"))
    ok = last.where((F.col("s.place") >= least_answered) & (F.col("s.running") / F.col("s.place") <= most_risk))
    best = ok.groupBy(*by).agg(F.max(F.struct(F.col("s.place").alias("answered"), F.col("threshold").alias("threshold"))).alias("b"))
    groups = df.select(*by).distinct()
    return groups.join(best, by, "left").select(*by, F.coalesce("b.threshold", F.lit(1.01)).alias("threshold"), F.coalesce("b.answered", F.lit(0)).alias("answered"))
