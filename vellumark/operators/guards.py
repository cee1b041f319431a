"""Admission guards: whether shown evidence is really the corpus's, in the right pool, and unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import normal_claim, text


def passage_trace(shown: DataFrame, record: str, passage: str, shown_text: str, corpus: DataFrame, corpus_id: str, corpus_text: str) -> DataFrame:
    """(record, n, known, prefix, bound): shown passages, those with a known id, and those whose text begins the corpus's text of that id.

    A record is bound if it shows a passage and all are known and unchanged. The corpus may hold several texts of an id; one must fit.
    """
    c = corpus.select(F.col(corpus_id).alias("_id"), normal_claim(corpus_text).alias("_whole")).distinct()
    s = shown.select(record, F.col(passage).alias("_id"), normal_claim(shown_text).alias("_shown"))
    hit = s.join(c, "_id", "left").groupBy(record, "_id", "_shown").agg(F.max(F.col("_whole").isNotNull()).alias("_known"), F.coalesce(F.max(F.startswith("_whole", "_shown")), F.lit(False)).alias("_fits"))
    g = hit.groupBy(record).agg(F.count(F.lit(1)).alias("n"), F.count_if("_known").alias("known"), F.count_if("_fits").alias("prefix"))
    return g.withColumn("bound", (F.col("n") > 0) & (F.col("prefix") == F.col("n")))


def pool_admission(shown: DataFrame, record: str, pool: str, item: str, members: DataFrame, member_pool: str, member_item: str) -> DataFrame:
    """(record, admitted, n_foreign): whether all items that a record shows are members of its pool."""
    m = members.select(F.col(member_pool).alias("_p"), F.col(member_item).alias("_i")).distinct().withColumn("_in", F.lit(True))
    s = shown.select(record, F.col(pool).alias("_p"), F.col(item).alias("_i"))
    return s.join(m, ["_p", "_i"], "left").groupBy(record).agg(F.count_if(F.col("_in").isNull()).alias("n_foreign")).withColumn("admitted", F.col("n_foreign") == 0)


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that doesn't hold, null if all do; a rule that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def source_binding(df: DataFrame, key: str, url: Column, anchors: Column, payload: Column, digest: Column, excerpt: Column) -> DataFrame:
    """(key, failure): the first rule that a captured page breaks: an https address, the stated digest, every anchor, the excerpt."""
    page = normal_claim(payload)
    rules = [
        ("unsafe_url", F.lower(text(url)).startswith("https://")),
        ("digest_mismatch", F.sha2(text(payload), 256) == digest),
        ("missing_anchor", F.forall(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.contains(page, normal_claim(a)))),
        ("excerpt_not_in_page", (normal_claim(excerpt) != "") & F.contains(page, normal_claim(excerpt))),
    ]
    return df.select(key, first_failure(rules).alias("failure"))


def evidence_display(label: Column, cited: Column, evidence: Column) -> Column:
    """struct of the cited evidence with its digests, or of the reasons why nothing is shown.

    cited: array of ids; evidence: array<struct<id, text>>. A label without a citation, an unknown id and a blank text are reasons.
    """
    items = F.filter(evidence, lambda e: F.array_contains(cited, e["id"]))
    known = F.transform(evidence, lambda e: e["id"])
    reasons = F.array_compact(
        F.array(
            F.when(label.isNull(), F.lit("abstained")),
            F.when(F.coalesce(F.size(cited), F.lit(0)) == 0, F.lit("no_citation")),
            F.when(F.coalesce(F.size(F.array_except(cited, known)), F.lit(0)) > 0, F.lit("unknown_citation")),
            F.when(F.exists(items, lambda e: F.trim(text(e["text"])) == ""), F.lit("blank_excerpt")),
        )
    )
    shown = F.transform(items, lambda e: F.struct(e["id"].alias("id"), e["text"].alias("excerpt"), F.sha2(text(e["text"]), 256).alias("digest")))
    return F.struct(F.when(F.size(reasons) == 0, shown).alias("shown"), reasons.alias("reasons"))
