"""Replays of generation, overlap audits, retrieval hits by group, prompts and the measures that studies report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import normal_claim, text
from vellumark.operators.grouping import edge_groups, linked_groups
from vellumark.operators.sampling import exclude_similar
from vellumark.tables import Cut, join_on_unique

LABELS = ["Supported", "Refuted", "Not Enough Evidence"]


# Prompts. The wording that answers were made with.
def evidence_lines(items: Column) -> Column:
    """'[id] text' lines of an evidence list."""
    return F.array_join(F.transform(items, lambda e: F.concat(F.lit("["), text(e["id"]), F.lit("] "), text(e["text"]))), "\n")


def verdict_prompt(claim: Column, items: Column) -> Column:
    return F.concat(F.lit("Evidence: "), evidence_lines(items), F.lit("\nClaim: "), text(claim), F.lit("\nReply only Supported, Refuted, or Not Enough Evidence."))


def explanation_prompt(claim: Column, items: Column, verdict: Column) -> Column:
    asked = "\nExplain why this evidence supports, contradicts, or cannot establish the claim. Use only the supplied evidence and keep the explanation short."
    return F.concat(F.lit("Evidence: "), evidence_lines(items), F.lit("\nClaim: "), text(claim), F.lit("\nVerdict: "), verdict, F.lit(asked))


#: Ways to show a claim to a model, by name: each takes the claim and its evidence list.
RENDERERS: dict[str, Callable[[Column, Column], Column]] = {
    "claim_only": lambda claim, items: F.concat(F.lit("CLAIM: "), F.trim(text(claim))),
    "claim_plus_evidence": lambda claim, items: F.array_join(
        F.concat(F.array(F.concat(F.lit("CLAIM: "), F.trim(text(claim)))), F.transform(F.filter(items, lambda e: F.trim(text(e["text"])) != ""), lambda e: F.concat(F.lit("ANSWER: "), F.trim(text(e["text"]))))), "\n"
    ),
    "verdict": verdict_prompt,
}


def generation(claim: Column, items: Column, gate: Column, verdict: Column, explanation: Column, absent: Column | None, threshold: float = 0.5, collapse: bool = True, explain: Column | None = None) -> Column:
    """struct of stages, reasons, requests, label, and both prompts' digests of one replayed generation.

    The answers are those that were recorded. Steps run in order and end at the first failure: no evidence; a gate probability that is given and
    below the threshold; a verdict that is no label. An empty explanation and numbers that no input holds (`absent`) add
    reasons against the label. Without `collapse` the context is taken as it comes; `explain` tells where an explanation is asked for at all.
    """
    shown = F.size(items) > 0
    passed = shown & (gate.isNull() | (gate >= threshold))
    valid = passed & F.coalesce(verdict.isin(LABELS), F.lit(False))
    explained = valid if explain is None else valid & F.coalesce(explain, F.lit(False))
    filled = text(explanation) != ""
    foreign = F.lit(False) if absent is None else F.size(absent) > 0
    list_of = lambda *xs: F.array_compact(F.array(*xs))
    reasons = list_of(
        F.when(~shown, F.lit("no_evidence")), F.when(shown & ~passed, F.lit("gate_below_threshold")), F.when(passed & ~valid, F.lit("invalid_verdict")),
        F.when(explained & ~filled, F.lit("empty_explanation")), F.when(explained & foreign, F.lit("numeric_value_absent")),
    )
    first = "collapse_context" if collapse else "context_policy"
    stages = list_of(F.lit(first), F.lit("gate"), F.when(passed, F.lit("verdict")), F.when(explained, F.lit("explanation")), F.when(explained, F.lit("numeric_check")))
    return F.struct(
        stages.alias("stages"), reasons.alias("reasons"), list_of(F.when(passed, F.lit("verdict")), F.when(explained, F.lit("explanation"))).alias("requests"),
        F.when((F.size(reasons) == 0) & valid, verdict).alias("label"),
        F.when(passed, F.sha2(verdict_prompt(claim, items), 256)).alias("verdict_prompt_sha256"), F.when(explained, F.sha2(explanation_prompt(claim, items, verdict), 256)).alias("explanation_prompt_sha256"),
    )


def looked_up(df: DataFrame, keys: list[str], table: DataFrame, value: str) -> DataFrame:
    """df with the value of each row's key; a key that the table lacks, or has twice, is an error when the row is read."""
    many = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
    joined = df.join(many, keys, "left")
    bad = F.raise_error(F.concat(F.lit("no single value for "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys))))
    return joined.withColumn(value, F.when(F.col("_n") == 1, F.col(value)).otherwise(bad.cast(table.schema[value].dataType))).drop("_n")


def hits_by_group(found: DataFrame, relevant: DataFrame, queries: DataFrame, group: str, ks: list[int], k: int) -> DataFrame:
    """(group, n_queries, n_scored, n_empty, hit_<k>..., mrr): how soon queries meet a relevant document among their first k; group null is all.

    found: query, doc, rank; relevant: query, doc; queries: query and the group column. Queries without a relevant document count in n_queries alone.
    """
    top = found.where(F.col("rank") <= k)
    first = top.join(relevant.select("query", "doc").distinct(), ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("_first"))
    scored = relevant.select("query").distinct().withColumn("_scored", F.lit(True))
    met = top.select("query").distinct().withColumn("_any", F.lit(True))
    rows = queries.select("query", F.col(group).alias("group")).join(scored, "query", "left").join(met, "query", "left").join(first, "query", "left")
    rows = rows.unionByName(rows.withColumn("group", F.lit(None).cast(queries.schema[group].dataType)))
    n = F.count_if("_scored")
    share = lambda c: F.try_divide(F.sum(F.when(F.col("_scored"), c)), n)
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_queries"), n.alias("n_scored"), F.count_if(F.col("_any").isNull()).alias("n_empty"),
        *(share(F.coalesce((F.col("_first") <= x).cast("double"), F.lit(0.0))).alias(f"hit_{x}") for x in ks), share(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
    )


def overlap_audit(rows: DataFrame, record: str, keys: list[Column], empty: Column, fitted: DataFrame, held: DataFrame) -> DataFrame:
    """(record, group, status) of each held-out record: 'connected' to a fitted record through shared keys, 'empty', or 'independent'.

    rows: one or more rows per record with what the keys read; fitted and held: (record). Groups are those of all rows together.
    """
    own = F.when(~empty, F.lit(True))
    groups = Cut(linked_groups(rows, record, [F.when(own, k) for k in keys])).df
    known = fitted.select(record).distinct()
    touched = groups.join(known, record, "left_semi").select("group").distinct().withColumn("_t", F.lit(True))
    blank = rows.where(empty).select(record).distinct().withColumn("_e", F.lit(True))
    j = join_on_unique(groups.join(held.select(record).distinct(), record, "left_semi"), touched, "group", "left").join(blank, record, "left")
    status = F.when(F.col("_e"), F.lit("empty")).when(F.col("_t"), F.lit("connected")).otherwise(F.lit("independent"))
    return j.select(record, "group", status.alias("status"))


def select_fresh(rows: DataFrame, ident: str, claim: str, pages: Column, prior_ids: DataFrame, prior_pages: DataFrame, prior_texts: DataFrame, words: Callable[[str], Column], similarity: float = 0.8) -> DataFrame:
    """(ident, group): one row per claim text among groups that nothing prior touches; groups are rows that share a page, directly or through others.

    A group is blocked if one of its rows has a prior id, a prior page, a prior text or one whose words are as similar as `similarity`. Of rows
    with the same text the least id stays. prior_ids: (ident); prior_pages: (page); prior_texts: (text).
    """
    each = rows.select(ident, claim, F.explode_outer(pages).alias("_page"))
    groups = Cut(linked_groups(each, ident, [F.col("_page")])).df
    of = rows.select(ident, claim).distinct()
    fresh = exclude_similar(of.withColumn("_w", words(claim)), ident, F.col("_w"), prior_texts.withColumn("_w", words("text")), F.col("_w"), similarity).select(ident)
    old = of.select(ident).join(fresh, ident, "left_anti").union(of.select(ident).join(prior_ids.select(ident), ident, "left_semi"))
    old = old.union(each.where("_page is not null").join(prior_pages.select(F.col("page").alias("_page")), "_page", "left_semi").select(ident))
    blocked = groups.join(old.distinct(), ident, "left_semi").select("group").distinct()
    left = groups.join(blocked, "group", "left_anti").join(of, ident)
    first = F.row_number().over(Window.partitionBy(normal_claim(claim)).orderBy(ident))
    return left.withColumn("_n", first).where("_n = 1").select(ident, "group")


def sequence_groups(df: DataFrame, ident: str, words: Column, size: int = 5) -> DataFrame:
    """(ident, group): rows that share a run of `size` words, directly or through others; every row comes out."""
    w = df.select(ident, words.alias("_w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - size + 1), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, size), " ")))
    each = w.where(F.size("_w") >= size).select(F.col(ident).alias("u"), F.explode(F.array_distinct(runs)).alias("k")).distinct()
    held = Cut(each)
    least = held.df.groupBy("k").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    group = edge_groups(join_on_unique(held.df, least, "k").select("u", "v"))
    return df.select(F.col(ident).alias("u")).where("u is not null").distinct().join(group, "u", "left").select(F.col("u").alias(ident), F.coalesce("v", "u").alias("group"))


def removals(items: Column, required: int) -> dict[str, Column]:
    """An evidence list whole, without all of it, and without its item number `required` (from 1); shorter lists lose nothing then."""
    return {"complete": items, "all_removed": F.slice(items, 1, 0), "one_removed": F.filter(items, lambda e, i: i != required - 1)}


def nearest_run(runs: DataFrame, anchors: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """(keys, start, end, run): the run nearest to the anchor's place, before or after it; of equally near ones the first.

    runs: keys, start, end (exclusive), run; anchors: keys and a place.
    """
    gap = F.when(F.col(anchor) < F.col("start"), F.col("start") - F.col(anchor)).when(F.col(anchor) >= F.col("end"), F.col(anchor) - F.col("end") + 1).otherwise(F.lit(0))
    best = runs.join(anchors, keys).groupBy(*keys).agg(F.min(F.struct(gap.alias("gap"), "start", "end", "run")).alias("_b"))
    return best.select(*keys, "_b.start", "_b.end", "_b.run", "_b.gap")


def at_rank_counts(df: DataFrame, rules: dict[str, Column], tie: str, counts: dict[str, int], correct: Column) -> DataFrame:
    """(rule, at, k, accuracy): each rule's k best rows by descending score, ties by id, and how many of them are right, at each named count."""
    rows = df.select(tie, correct.cast("double").alias("_ok"), *(c.alias(n) for n, c in rules.items()))
    out = None
    for name in rules:  # as many sorts as rules, each a range sort of (score, id, ok)
        ranged = rows.select(tie, "_ok", F.round(name, 9).alias(name)).repartitionByRange(F.desc(name), F.asc(tie)).withColumn("_p", F.spark_partition_id())
        held = Cut(ranged).df
        sizes = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = held.join(sizes.select("_p", before.alias("_first")), "_p").withColumn("_at", F.col("_first") + F.row_number().over(Window.partitionBy("_p").orderBy(F.desc(name), tie)))
        one = placed.agg(*(F.avg(F.when(F.col("_at") <= k, F.col("_ok"))).alias(at) for at, k in counts.items()))
        one = one.select(F.lit(name).alias("rule"), F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(k).cast("long").alias("k"), F.col(at).alias("accuracy")) for at, k in counts.items()))).alias("x")).select("rule", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def index_problems(lists: DataFrame, split: str, side: str, index: str, known: DataFrame) -> DataFrame:
    """(split, n, n_repeated, n_unknown, n_without_claim): what is wrong with lists of record indices.

    lists: one row per split, side and listed index; known: (index, has_claim), one row per record. An index counts as repeated for each place beyond its first.
    """
    rows = lists.where(F.col(index).isNotNull()).groupBy(split, index).agg(F.count(F.lit(1)).alias("_n"))
    j = rows.join(known, index, "left")
    return j.groupBy(split).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") - 1).alias("n_repeated"), F.count_if(F.col("has_claim").isNull()).alias("n_unknown"), F.count_if(~F.col("has_claim")).alias("n_without_claim"))


def context_problems(items: Column, most: int = 3) -> Column:
    """What is wrong with an evidence list: too many items, ids that repeat or are missing, texts that are missing."""
    ids = F.transform(items, lambda e: e["id"])
    return F.array_compact(
        F.array(
            F.when(F.size(items) > most, F.lit("too_many")), F.when(F.size(F.array_distinct(ids)) < F.size(ids), F.lit("repeated_id")),
            F.when(F.exists(items, lambda e: F.trim(text(e["id"])) == ""), F.lit("missing_id")), F.when(F.exists(items, lambda e: F.trim(text(e["text"])) == ""), F.lit("missing_text")),
        )
    )


def references(links: dict[str, tuple[DataFrame, Column, DataFrame, Column]]) -> DataFrame:
    """(link, n_keys, n_orphans) of each named link (rows, key, parents, parent key): distinct keys, and those that no parent has; blank keys are none."""
    out = None
    for name, (rows, key, parents, parent_key) in links.items():
        keys = rows.select(key.alias("_k")).where("_k is not null and _k <> ''").distinct()
        have = parents.select(parent_key.alias("_k")).where("_k is not null").distinct().withColumn("_h", F.lit(True))
        one = keys.join(have, "_k", "left").agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("_h").isNull()).alias("n_orphans")).select(F.lit(name).alias("link"), "n_keys", "n_orphans")
        out = one if out is None else out.unionByName(one)
    return out


def gate_changes(df: DataFrame, by: list[str], truth: str, full: str, masked: str) -> DataFrame:
    """(by, added_right, added_wrong, removed_right, removed_wrong): answers that a masked gate gives and the full one doesn't, and the other way round."""
    added, removed = F.col(full).isNull() & F.col(masked).isNotNull(), F.col(full).isNotNull() & F.col(masked).isNull()
    right = lambda c: F.col(c) == F.col(truth)
    return df.groupBy(*by).agg(
        F.count_if(added & right(masked)).alias("added_right"), F.count_if(added & ~right(masked)).alias("added_wrong"), F.count_if(removed & right(full)).alias("removed_right"), F.count_if(removed & ~right(full)).alias("removed_wrong")
    )


def rate_by(df: DataFrame, sets: list[list[str]], event: Column, base: Column) -> DataFrame:
    """(all columns of sets, n_events, n_base, rate) per grouping set: rows of `base` for which `event` holds; null rate without a base."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = None
    for s in sets:
        one = df.groupBy(*s).agg(F.count_if(base & event).alias("n_events"), F.count_if(base).alias("n_base"))
        one = one.select(*((F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in cols), "n_events", "n_base", F.try_divide(F.col("n_events"), F.col("n_base")).alias("rate"))
        out = one if out is None else out.unionByName(one)
    return out


def score_entry(claim: Column, items: Column, scores: Column) -> Column:
    """struct of a context's digest and its scores: scores may be used again only for a context of the same digest."""
    key = F.array_join(F.concat(F.array(text(claim)), F.transform(items, lambda e: F.concat(text(e["id"]), F.lit("\x1e"), text(e["text"])))), "\x1f")
    return F.struct(F.sha2(key, 256).alias("context_sha256"), scores.alias("scores"))


def carried_scores(original: Column, scores: Column, variant: Column) -> Column:
    """The scores of a variant's items, taken from the original's items of the same id and text; null if one of them isn't among these."""
    at = F.transform(variant, lambda v: F.array_position(F.transform(original, lambda o: o["id"].eqNullSafe(v["id"]) & o["text"].eqNullSafe(v["text"])), True))
    return F.when(~F.exists(at, lambda i: i == 0), F.transform(at, lambda i: F.get(scores, i.cast("int") - 1)))


def guarded(label: Column, problems: Column) -> tuple[Column, Column]:
    """(label, reasons): the label of a context without problems; with any, none, and these as the reasons for refusing before generation."""
    ok = F.coalesce(F.size(problems), F.lit(0)) == 0
    return F.when(ok, label), F.when(ok, F.slice(problems, 1, 0)).otherwise(problems)


def robustness(pairs: DataFrame, by: list[str], truth: str, before: str, after: str, p_before: str, p_after: str, labels: list[str]) -> DataFrame:
    """(by, n, macro_before, macro_after, macro_change, flip_rate, mean_change, increase_rate): what a change of the input does to answers and confidence.

    One row per pair of answers to the same record; a null answer is an abstention, which is wrong and flips like any other.
    """
    each = pairs.withColumn("_l", F.explode(F.array(*map(F.lit, labels))))
    is_ = F.col(truth) == F.col("_l")
    f1 = {}
    for name, c in (("before", before), ("after", after)):
        said = F.coalesce(F.col(c) == F.col("_l"), F.lit(False))
        f1[name] = F.coalesce(F.try_divide(2 * F.count_if(said & is_), F.count_if(said) + F.count_if(is_)), F.lit(0.0))
    macro = each.groupBy(*by, "_l").agg(f1["before"].alias("_b"), f1["after"].alias("_a")).groupBy(*by).agg(F.avg("_b").alias("macro_before"), F.avg("_a").alias("macro_after"))
    rest = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((~F.col(before).eqNullSafe(F.col(after))).cast("double")).alias("flip_rate"), F.avg(F.col(p_after) - F.col(p_before)).alias("mean_change"), F.avg((F.col(p_after) > F.col(p_before)).cast("double")).alias("increase_rate")
    )
    # a constant key stands in where there are no groups
    rest, macro = rest.withColumn("_one", F.lit(1)), macro.withColumn("_one", F.lit(1))
    joined = rest.join(macro, [rest[c].eqNullSafe(macro[c]) for c in [*by, "_one"]])
    return joined.select(*(rest[c] for c in by), "n", "macro_before", "macro_after", (F.col("macro_after") - F.col("macro_before")).alias("macro_change"), "flip_rate", "mean_change", "increase_rate")


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with each of the columns divided by its population standard deviation over all rows, or as it is where that is 0; nothing is centred."""
    spread = df.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()
    return df.withColumns({c: F.col(c) / F.lit(float(spread[c]) if spread[c] else 1.0) for c in columns})
