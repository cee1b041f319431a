"""Features of nested evidence records and of scored evidence.

A record's `questions` is array<struct<question, answers: array<struct<answer, answer_type, source_url, source_medium,
cached_source_url>>>>. Features of one record are array expressions inside one row, so no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import fold, text, token_set, tokens
from vellumark.functions.urls import source_url
from vellumark.tables import Cut

ANSWERS = "array<struct<answer:string,answer_type:string,source_url:string,source_medium:string,cached_source_url:string>>"
NESTED = f"array<struct<question:string,answers:{ANSWERS}>>"
# Words that negate.
NEGATIONS = ["no", "not", "never", "none", "neither", "nor", "without", "n't"]


def answers_of(questions: Column) -> Column:
    """All answers of a record, in order."""
    q = F.coalesce(questions, F.array().cast(NESTED))
    return F.flatten(F.transform(q, lambda x: F.coalesce(x["answers"], F.array().cast(ANSWERS))))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _filled(xs: Column) -> Column:
    return F.filter(xs, lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def mean_distance(sets: Column) -> Column:
    """Mean Jaccard distance of all pairs of a record's sets; 0 with fewer than two. Equal sets are compared once, by their number."""
    n = F.size(sets)
    kinds = F.array_distinct(F.transform(sets, lambda s: F.array_sort(s)))
    counts = F.transform(kinds, lambda k: F.struct(k.alias("k"), F.size(F.filter(sets, lambda s: F.array_sort(s) == k)).alias("n")))
    total = F.aggregate(
        F.transform(counts, lambda a: F.aggregate(counts, F.lit(0.0), lambda t, b: t + (1 - jaccard(a["k"], b["k"])) * a["n"] * b["n"])), F.lit(0.0), lambda t, x: t + x
    )
    return F.when(n >= 2, total / (n * (n - 1))).otherwise(F.lit(0.0))


def disagreement(questions: Column) -> dict[str, Column]:
    """Twelve structural features of a record's questions and answers; all 0 without any."""
    qs = F.coalesce(questions, F.array().cast(NESTED))
    every = answers_of(questions)
    n, n_q = F.size(every), F.size(qs)
    texts = F.transform(every, lambda a: F.trim(text(a["answer"])))
    said = _filled(texts)
    booleans = F.transform(F.filter(every, lambda a: fold(a["answer_type"]) == "boolean"), lambda a: F.regexp_replace(fold(F.trim(text(a["answer"]))), r"^[ .!?]+|[ .!?]+$", ""))
    negated = F.filter(texts, lambda t: F.arrays_overlap(token_set(t), F.array(*map(F.lit, NEGATIONS))))
    kinds = lambda f: F.size(F.array_distinct(_filled(F.transform(every, lambda a: fold(F.trim(text(a[f])))))))
    return {
        "n_questions": n_q.cast("double"),
        "n_answers": n.cast("double"),
        "answers_per_question": _share(n, n_q),
        "multi_answer_share": _share(F.size(F.filter(qs, lambda q: F.coalesce(F.size(q["answers"]), F.lit(0)) > 1)), n_q),
        "unique_share": _share(F.size(F.array_distinct(F.transform(said, lambda t: F.array_join(F.array_sort(token_set(t)), " ")))), n),
        "boolean_share": _share(F.size(booleans), n),
        "yes_and_no": (F.array_contains(booleans, "yes") & F.array_contains(booleans, "no")).cast("double"),
        "negated_share": _share(F.size(negated), n),
        "negation_mixed": ((F.size(negated) > 0) & (F.size(negated) < n)).cast("double"),
        "media_share": _share(kinds("source_medium"), n),
        "type_share": _share(kinds("answer_type"), n),
        "mean_distance": mean_distance(F.transform(said, lambda t: token_set(t))),
    }


def provenance(df: DataFrame, record: str, url: Column, answer: Column, cached: Column) -> DataFrame:
    """(record, ten features) of a record's answers, one row each in df: source families, repeats, archives and their entropy.

    Two-level aggregation: rows to (record, family) and to (record), so a record may have any number of rows.
    """
    rows = df.select(
        F.col(record),
        source_url(url).alias("_u"),
        F.array_join(tokens(answer), " ").alias("_a"),
        (F.contains(F.lower(text(url)), F.lit("/web/")) & F.lower(text(url)).rlike("^https?://[^/]*(archive|wayback)[^/]*/web/") | (text(cached) != "")).alias("_ar"),
    ).withColumn("_f", F.split_part("_u", F.lit("/"), F.lit(1)))
    family = rows.where("_u <> ''").groupBy(record, "_f").agg(F.count(F.lit(1)).alias("_c")).groupBy(record).agg(
        F.count(F.lit(1)).alias("_k"), F.max("_c").alias("_most"), F.sum(F.when(F.col("_c") > 1, F.col("_c")).otherwise(0)).alias("_repeated"), F.sum("_c").alias("_with_url"), F.sum(F.col("_c") * F.log2("_c")).alias("_nlogn")
    )
    whole = rows.groupBy(record).agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct("_u").alias("_urls"),
        F.count_if(F.col("_a") != "").alias("_said"),
        F.countDistinct(F.when(F.col("_a") != "", F.col("_a"))).alias("_kinds"),
        F.count_if("_ar").alias("_archived"),
        F.count_if(F.col("_u") == "").alias("_missing"),
    )
    j = whole.join(family, record, "left")
    n, k = F.col("_n"), F.coalesce("_k", F.lit(0))
    entropy = F.when(k > 1, (F.log2("_with_url") - F.col("_nlogn") / F.col("_with_url")) / F.log2("_k")).otherwise(F.lit(0.0))
    part = lambda c: F.coalesce(c, F.lit(0)) / n
    return j.select(
        record, n.cast("double").alias("n_answers"), k.cast("double").alias("n_families"), (k / n).alias("family_share"), part(F.col("_most")).alias("largest_family"), part(F.col("_repeated")).alias("repeated_share"),
        ((n - F.col("_urls")) / n).alias("duplicate_url_share"), ((F.col("_said") - F.col("_kinds")) / n).alias("duplicate_answer_share"), (F.col("_archived") / n).alias("archive_share"), (F.col("_missing") / n).alias("missing_share"), entropy.alias("family_entropy"),
    )


def capture_timing(df: DataFrame, record: str, claimed: Column, captured: Column) -> DataFrame:
    """(record, n_captures, dated_share, after_share, median_lag, median_abs_lag): lags in years between claim and capture; 0 without any."""
    lag = F.datediff(captured, claimed) / 365.25
    g = df.groupBy(record).agg(F.count(F.lit(1)).alias("_n"), F.count(lag).alias("_k"), F.count_if(lag > 0).alias("_after"), F.median(lag).alias("_m"), F.median(F.abs(lag)).alias("_a"))
    return g.select(
        record, F.col("_k").cast("double").alias("n_captures"), (F.col("_k") / F.col("_n")).alias("dated_share"), _share(F.col("_after"), F.col("_k")).alias("after_share"), F.coalesce("_m", F.lit(0.0)).alias("median_lag"), F.coalesce("_a", F.lit(0.0)).alias("median_abs_lag")
    )


def lexical_scores(claim: Column, evidence: Column) -> Column:
    """array of contradiction, entailment and neutral: the default scorer, from shared words and a one-sided negation.

    Any column of three numbers that sum to 1 may stand in its place.
    """
    c, e = F.array_distinct(tokens(claim)), F.array_distinct(tokens(evidence))
    share = F.when(F.size(c) > 0, F.size(F.array_intersect(c, e)) / F.size(c)).otherwise(F.lit(0.0))
    negation = F.array(*map(F.lit, NEGATIONS))
    against = F.arrays_overlap(c, negation) != F.arrays_overlap(e, negation)
    return F.array(share * F.when(against, 0.8).otherwise(0.2), share * F.when(against, 0.2).otherwise(0.8), 1 - share)


def cosine_of_words(a: Column, b: Column) -> Column:
    """Cosine of two texts' word sets."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x) * F.size(y))).otherwise(F.lit(0.0))


def score_features(df: DataFrame, record: str, scores: str, cosine: str | None = None, url: str | None = None, evidence: str | None = None, claim: str | None = None) -> DataFrame:
    """(record, features) of the scored evidence of each record, one row per evidence: maxima, means, deviations (of the population) and count.

    With a cosine also its mean, maximum, minimum and deviation; with address and texts also the expanded set (entropy, clash, hosts, lengths).
    """
    s = F.col(scores)
    out = []
    for name, i in (("contradiction", 0), ("entailment", 1), ("neutral", 2)):
        out += [F.max(s[i]).alias("max_" + name), F.avg(s[i]).alias("mean_" + name), F.stddev_pop(s[i]).alias("std_" + name)]
    entropy = -F.aggregate(F.transform(s, lambda p: F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))), F.lit(0.0), lambda t, x: t + x) / F.log(F.lit(3.0))
    out += [F.count(F.lit(1)).cast("double").alias("n_evidence"), F.avg(entropy).alias("mean_entropy"), (F.max(s[0]) * F.max(s[1])).alias("clash"), F.avg((F.array_position(s, F.array_max(s)) == 3).cast("double")).alias("neutral_share")]
    if cosine:
        out += [F.avg(cosine).alias("mean_cosine"), F.max(cosine).alias("max_cosine"), F.min(cosine).alias("min_cosine"), F.stddev_pop(cosine).alias("std_cosine")]
    if url:
        out += [F.countDistinct(F.when(F.split_part(source_url(url), F.lit("/"), F.lit(1)) != "", F.split_part(source_url(url), F.lit("/"), F.lit(1)))).cast("double").alias("n_hosts")]
    if evidence and claim:
        c = F.array_distinct(tokens(claim))
        overlap = F.when(F.size(c) > 0, F.size(F.array_intersect(c, tokens(evidence))) / F.size(c)).otherwise(F.lit(0.0))
        length = F.log1p(F.size(tokens(evidence)).cast("double"))
        out += [F.max(overlap).alias("max_overlap"), F.avg(overlap).alias("mean_overlap"), F.avg(length).alias("mean_log_words"), F.max(length).alias("max_log_words")]
    return df.groupBy(record).agg(*out)


def tfidf(docs: DataFrame, doc: str, text_column: str, min_df: int = 2, most: int | None = 50_000, sublinear: bool = True, pairs: bool = True) -> DataFrame:
    """(doc, term, weight): smooth idf ln((1 + n) / (1 + df)) + 1, tf or 1 + ln tf, unit length per document.

    Terms are words of two characters or more and, with `pairs`, adjacent pairs of them, of at least `min_df` documents; of more than
    `most` the most frequent stay (ties by name).
    """
    w = F.filter(tokens(text_column), lambda t: F.length(t) >= 2)
    both = F.concat(w, F.when(F.size(w) >= 2, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))) if pairs else w
    tf = Cut(docs.select(F.col(doc), F.explode(both).alias("term")).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))).df
    n = docs.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_all")).where(F.col("df") >= min_df)
    if most is not None:
        df = df.orderBy(F.desc("_all"), "term").limit(most)
    local = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = tf.join(df, "term").select(doc, "term", (local * (F.log((1.0 + n) / (1 + F.col("df"))) + 1)).alias("_w"))
    norm = raw.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return raw.join(norm, doc).select(doc, "term", (F.col("_w") / F.col("_l")).alias("weight"))
