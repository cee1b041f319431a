"""Logistic models over text features, calibrated across folds."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import tokens
from vellumark.operators.inference import fit_logit
from vellumark.operators.sampling import hash_split


def balanced(df: DataFrame, label: str) -> DataFrame:
    """df with `weight`: rows / (labels × rows of the label), so all labels weigh the same."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = per.agg(F.sum("_n"), F.count(F.lit(1))).first()
    return df.join(per, label).withColumn("weight", F.lit(float(whole[0] or 0) / max(1, whole[1])) / F.col("_n")).drop("_n")


def char_grams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of `low` to `high` characters inside each word, the word between blanks."""
    words = F.transform(tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    return F.concat(*(of(n) for n in range(low, high + 1)))


def fit_text_model(df: DataFrame, terms: str, label: str, c: float = 1.0, features: int = 1 << 16, rounds: int = 50) -> PipelineModel:
    """A balanced logistic regression over hashed TF-IDF of an array of terms; c is the inverse of the ridge, as per row."""
    rows = balanced(df.where(F.col(label).isNotNull()), label)
    n = rows.count()
    steps = [StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), HashingTF(inputCol=terms, outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=rounds, regParam=1.0 / (c * max(n, 1)), probabilityCol="_p", predictionCol="_k", rawPredictionCol="_r")]
    return Pipeline(stages=steps).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with probabilities (array, in the model's label order) and the label of the greatest."""
    labels = model.stages[0].labels
    got = df
    for stage in model.stages[1:]:
        got = stage.transform(got)
    p = vector_to_array("_p")
    return got.select(*df.columns, p.alias("probabilities"), F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int")).alias("label_predicted"))


def cross_fitted(df: DataFrame, ident: str, score: str, correct: Column, parts: int = 5, seed: str = "fold") -> DataFrame:
    """df with `calibrated`: each fold's chance of being right, from a logistic fit on the other folds, and `prevalence` of those.

    Where the other folds hold one outcome only, both are their share with one row of each outcome added.
    """
    rows = hash_split(df.withColumn("_ok", correct.cast("double")), ident, parts, seed)
    logit = F.log(F.greatest(F.col(score), F.lit(1e-6)) / F.greatest(1 - F.col(score), F.lit(1e-6)))
    out = None
    for k in range(parts):
        rest = rows.where(F.col("part") != k)
        n, ok = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum("_ok"), F.lit(0.0))).first()
        share = (ok + 1) / (n + 2)
        if 0 < ok < n:
            w, b = fit_logit(rest, logit, F.col("_ok"))
            chance = 1 / (1 + F.exp(-(w * logit + b)))
        else:
            chance = F.lit(share)
        own = rows.where(F.col("part") == k).withColumn("calibrated", chance).withColumn("prevalence", F.lit(share))
        out = own if out is None else out.unionByName(own)
    return out.drop("_ok")


def length_matched(removed: DataFrame, candidates: DataFrame, parent: str, group: str, words: str, key: str) -> DataFrame:
    """(removed key, replacement key): for each removed sentence another group's sentence of as many words, the least key first.

    Within a parent no replacement serves twice: its k-th removed sentence of a length takes the k-th fitting candidate. Sentences of the
    parent's own group never serve; a removed sentence without a fitting one is left out.
    """
    place = F.row_number().over(Window.partitionBy(parent, words).orderBy(key))
    want = removed.select(F.col(key).alias("removed"), parent, F.col(group).alias("_g"), words, place.alias("_k"))
    each = candidates.select(F.col(key).alias("_c"), F.col(group).alias("_og"), words).distinct()
    own = each.groupBy(F.col("_og").alias("_g"), words).agg(F.count(F.lit(1)).alias("_own"))
    asked = want.groupBy("_g", words).agg(F.max("_k").alias("_most")).join(own, ["_g", words], "left")
    asked = asked.withColumn("_reach", F.col("_most") + F.coalesce("_own", F.lit(0)))
    # the first _most candidates of other groups are among the first _most + _own of all
    limit = asked.agg(F.coalesce(F.max("_reach"), F.lit(0))).first()[0]
    ranked = each.withColumn("_rank", F.row_number().over(Window.partitionBy(words).orderBy("_c"))).where(F.col("_rank") <= limit)
    reached = asked.select("_g", words, "_most", F.explode(F.sequence(F.lit(1), F.col("_reach").cast("int"))).alias("_rank"))
    order = F.row_number().over(Window.partitionBy("_g", words).orderBy("_c"))
    offer = reached.join(ranked, [words, "_rank"]).where("_og <> _g").withColumn("_k", order).where(F.col("_k") <= F.col("_most"))
    return want.join(offer.select("_g", words, "_k", F.col("_c").alias("replacement")), ["_g", words, "_k"]).select(parent, "removed", "replacement")


def next_variant(df: DataFrame, claim: str, index: str, n: int) -> DataFrame:
    """(claim, index, next_index): each row with the next variant of its claim, the last one with the first."""
    other = df.select(claim, F.col(index).alias("next_index")).distinct()
    rows = df.select(claim, index, F.pmod(F.col(index) + 1, F.lit(n)).alias("next_index"))
    return rows.join(other, [claim, "next_index"]).select(claim, index, "next_index")


def restore_plan(receipt: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, source): for each listed file the first candidate, by priority, whose digest is the listed one; null where none fits.

    receipt: (path, sha256); candidates: (source, priority, sha256).
    """
    hit = receipt.join(candidates, "sha256").groupBy("path").agg(F.min(F.struct("priority", "source")).alias("_b"))
    return receipt.select("path").join(hit, "path", "left").select("path", F.col("_b.source").alias("source"))


def leaks_markers(df: DataFrame, key: str, texts: list[str], markers: list[str]) -> DataFrame:
    """(key, marker): forbidden markers that a packet's texts hold, whatever the case."""
    joined = F.lower(F.concat_ws("\n", *texts))
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(joined, F.lower(m)))
    return df.select(key, F.explode(found).alias("marker"))


def declarative(question: Column, answer: Column) -> Column:
    """A statement from a question and its answer: 'Who built X?' and 'Ann' give 'Ann built X.'; other questions stand before the answer."""
    q = F.regexp_replace(F.trim(question), r"\?+\s*$", "")
    who = F.regexp_extract(q, r"(?is)^(?:who|which [\p{L}]+|what) ((?:is|was|are|were|has|had|did|does|do|will|can|could|would)? ?.*)$", 1)
    a = F.regexp_replace(F.trim(answer), r"[.\s]+$", "")
    return F.when(F.lower(q).rlike(r"^who (?!is |was |are |were |did |does |do |will |can |could |would )"), F.concat(a, F.lit(" "), who, F.lit("."))).otherwise(F.concat(q, F.lit(": "), a, F.lit(".")))


def allowed_next(sequences: Column, prefix: Column, end: int) -> Column:
    """Token ids that may follow a prefix so that one of the allowed sequences can still come out; `end` after a whole one."""
    n = F.size(prefix)
    fit = F.filter(sequences, lambda s: F.slice(s, 1, n) == prefix)
    return F.array_sort(F.array_distinct(F.transform(fit, lambda s: F.coalesce(F.get(s, n), F.lit(end)))))
