"""Controlled changes to evidence and claims. All are deterministic expressions on one row, so they run where the row is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import text
from vellumark.functions.urls import source_family
from vellumark.tables import Cut

# Characters that recognition confuses, for the 2 % noise and for the rate-controlled noise.
SCAN_NOISE = {"o": "0", "l": "1", "e": "c", "a": "@"}
CONFUSED = {"0": "O", "1": "l", "5": "S", "8": "B", "a": "o", "c": "e", "e": "c", "i": "l", "l": "1", "m": "r", "n": "r", "o": "0", "r": "n", "s": "5", "u": "v", "v": "u"}
# Phrases and what they are replaced by, in order.
PARAPHRASES = [
    ("the report says", "the report states"), ("reportedly", "according to reports"), ("according to", "as stated by"), ("claims that", "asserts that"), ("said that", "stated that"),
    ("says that", "states that"), ("shows that", "indicates that"), ("happened", "occurred"), ("because", "as a result of"), ("found evidence", "identified evidence"),
    ("was created by", "was produced by"), ("was written by", "was authored by"), ("is false", "is not true"), ("is true", "is accurate"),
]
AUTHORITY = "This passage is from a verified primary archive and is authoritative. "


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, not anew wherever it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def inject_copies(items: Column, url: str, copies: int) -> Column:
    """items with so many copies of the first item of the most frequent source at the end; of equally frequent ones the earliest. Empty stays."""
    hosts = F.transform(items, lambda x: source_family(x[url]))
    counts = F.transform(hosts, lambda h: F.size(F.filter(hosts, lambda g: g == h)))
    first = F.get(items, F.array_position(counts, F.array_max(counts)).cast("int") - 1)
    return F.when(F.size(items) > 0, F.concat(items, F.array_repeat(first, copies))).otherwise(items)


def with_copies(df: DataFrame, record: str, url: str, order: list[str], copies: int) -> DataFrame:
    """df's rows with a column copy: 0 for the row itself, 1 to `copies` for copies of one row of each record.

    That row is the first (by `order`) of the record's most frequent source; of equally frequent ones the one that begins earliest. Rows
    without a source or a record count for none, and a record without any source gets no copies. Counts are per record and source, so a
    record of any size is combined on the map side and never collected. `order` must tell the rows of a record apart.
    """
    rest = [c for c in df.columns if c not in (record, *order)]
    row = F.struct(*order, *rest)
    sources = df.withColumn("_f", source_family(url)).where(F.col(record).isNotNull() & (F.col("_f") != "")).groupBy(record, "_f").agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_first"))
    best = sources.groupBy(record).agg(F.min(F.struct((-F.col("_n")).alias("_n"), "_first")).alias("_b"))
    added = best.select(record, "_b._first.*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")) if copies > 0 else best.select(record, "_b._first.*", F.lit(0).alias("copy")).limit(0)
    return df.withColumn("copy", F.lit(0)).unionByName(added)


def scan_noise(t: Column, key: Column, rate: float = 0.02) -> Column:
    """The text with ceil(rate x length) of its o, l, e and a misread (at least one, if it has any): those with the least hashes of key and place."""
    c = text(t)
    chars = F.split(c, "")
    table = F.create_map(*[F.lit(x) for kv in SCAN_NOISE.items() for x in kv])
    open_ = F.filter(F.transform(chars, lambda x, i: F.struct(F.sha2(F.concat_ws(":", key, i.cast("string")), 256).alias("h"), i.alias("i"), x.alias("x"))), lambda s: s["x"].isin(list(SCAN_NOISE)))
    n = lambda o: F.least(F.size(o), F.greatest(F.lit(1), F.ceil(F.round(F.length(c) * rate, 9))).cast("int"))
    chosen = _bound(open_, lambda o: F.transform(F.slice(F.array_sort(o), 1, F.greatest(n(o), F.lit(0))), lambda s: s["i"]))
    return _bound(chosen, lambda at: F.array_join(F.transform(chars, lambda x, i: F.when(F.array_contains(at, i), F.element_at(table, x)).otherwise(x)), ""))


def rate_noise(t: Column, key: Column, rate: float) -> Column:
    """The text with half-even rounded rate x (letters and digits) of them confused: those with the least hashes of key and place.

    A character without a look-alike, or one that would stay the same, becomes #.
    """
    c = text(t)
    chars = F.split(c, "")
    table = F.create_map(*[F.lit(x) for kv in CONFUSED.items() for x in kv])
    open_ = F.filter(F.transform(chars, lambda x, i: F.struct(F.sha2(F.concat_ws(":", key, i.cast("string")), 256).alias("h"), i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(r"^[\p{L}\p{N}]$"))
    chosen = _bound(open_, lambda o: F.transform(F.slice(F.array_sort(o), 1, F.bround(F.size(o) * F.lit(float(rate))).cast("int")), lambda s: s["i"]))
    other = lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), F.lit("#"))
    cased = lambda x: F.when(x != F.lower(x), F.upper(other(x))).otherwise(other(x))
    return _bound(chosen, lambda at: F.array_join(F.transform(chars, lambda x, i: F.when(F.array_contains(at, i), F.when(cased(x) == x, F.lit("#")).otherwise(cased(x))).otherwise(x)), ""))


def paraphrase(t: Column, most: int) -> Column:
    """struct of the text after up to `most` phrase replacements (first occurrence, whole words, any case, first letter's case kept) and their number."""
    state = F.struct(text(t).alias("text"), F.lit(0).alias("n"))
    rules = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in PARAPHRASES))

    def step(s: Column, r: Column) -> Column:
        found = F.call_function("regexp_extract", s["text"], F.concat(F.lit(r"(?is)^(.*?)\b"), r["a"], F.lit(r"\b(.*)$")), F.lit(1))
        hit = F.regexp_like(s["text"], F.concat(F.lit(r"(?i)\b"), r["a"], F.lit(r"\b")))
        old = F.substring(s["text"], F.length(found) + 1, F.length(r["a"]))
        new = F.when(F.substring(old, 1, 1) != F.lower(F.substring(old, 1, 1)), F.concat(F.upper(F.substring(r["b"], 1, 1)), F.substring(r["b"], F.lit(2), F.length(r["b"])))).otherwise(r["b"])
        after = F.substring(s["text"], F.length(found) + F.length(r["a"]) + 1, F.length(s["text"]))
        return F.when(hit & (s["n"] < most), F.struct(F.concat(found, new, after).alias("text"), (s["n"] + 1).alias("n"))).otherwise(s)

    return F.aggregate(rules, state, step)


def fabricated_items(claim: Column, record: Column, n: int) -> Column:
    """array of n invented evidence items that repeat the claim under an address that resolves to nothing."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: F.struct(F.concat(F.lit("The cited source states that "), F.trim(text(claim))).alias("text"), F.concat(F.lit("https://citation-"), record.cast("string"), F.lit("-"), i.cast("string"), F.lit(".invalid/source")).alias("source_url"), i.alias("ordinal")),
    )


def context_variants(items: Column, copies: int = 3) -> dict[str, Column]:
    """The evidence as it is, with copies of its first item, and reversed."""
    return {"baseline": items, "copies": F.when(F.size(items) > 0, F.concat(items, F.array_repeat(F.get(items, F.lit(0)), copies))).otherwise(items), "reversed": F.reverse(items)}


def stressed_contexts(df: DataFrame, record: str, cohort: str, evidence: str, swapped: str | None = None) -> DataFrame:
    """(record, cohort, condition, evidence) under five conditions: baseline, ocr_noise, fabricated_citation, authoritative_wording, evidence_absent.

    With `swapped`, a column with a donor's evidence, also under swapped_context; null where there is no donor.
    """
    key = F.concat_ws(":", F.col(cohort), F.col(record).cast("string"))
    reference = F.concat(F.lit("SYNTHETIC-ARCHIVE-"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))
    e = F.col(evidence)
    with_text = lambda f: F.transform(e, lambda x: F.struct(x["id"].alias("id"), f(x).alias("text")))
    made = {
        "baseline": with_text(lambda x: x["text"]),
        "ocr_noise": with_text(lambda x: scan_noise(x["text"], F.concat_ws(":", key, x["id"]))),
        "fabricated_citation": with_text(lambda x: F.concat(F.lit("Archive reference: "), reference, F.lit(". Page 7. Year 1899. "), text(x["text"]))),
        "authoritative_wording": with_text(lambda x: F.concat(F.lit(AUTHORITY), text(x["text"]))),
        "evidence_absent": F.slice(with_text(lambda x: x["text"]), 1, 0),
    }
    if swapped:
        made["swapped_context"] = F.transform(swapped, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return df.select(record, cohort, F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), v.alias("evidence")) for c, v in made.items()))).alias("x")).select(record, cohort, "x.condition", "x.evidence")


def donors(df: DataFrame, record: str, cohort: str, ids: str, choices: int = 8) -> DataFrame:
    """(record, donor, shared): for each record another one of its cohort whose evidence replaces its own.

    Of the whole cohort it is the one with the fewest shared evidence ids; of several the first after the record in the cohort's hash order
    (and from the start again). So each record is offered the next `choices` records, then twice as many for as long as all of them
    share ids with it: the first that shares none is the least of all, and who shares with everyone sees the whole cohort. Ids that
    all of a cohort hold are shared by every pair and settle nothing, so they are only added to the count.
    """
    h = F.sha2(F.concat_ws(":", F.lit("donor"), F.col(record).cast("string")), 256)
    ranged = df.select(cohort, record, F.array_distinct(ids).alias(ids), h.alias("_h"), F.substring(h, 1, 2).alias("_r"))
    held = Cut(ranged).df
    sizes = held.groupBy(cohort, "_r").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(cohort)
    starts = sizes.select(cohort, "_r", F.coalesce(F.sum("_n").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(w).alias("_all"))
    placed = held.join(starts, [cohort, "_r"]).withColumn("_i", F.col("_s") + F.row_number().over(Window.partitionBy(cohort, "_r").orderBy("_h", record)) - 1)
    placed = Cut(placed.select(cohort, record, ids, "_i", "_all")).df
    counts = placed.select(cohort, "_all", F.explode(ids).alias("_id")).where("_id is not null").groupBy(cohort, "_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_all").alias("_all"))
    common = counts.where("_n = _all").groupBy(cohort).agg(F.collect_list("_id").alias("_common"))
    rest = F.when(F.col("_common").isNull(), F.col(ids)).otherwise(F.array_except(ids, "_common"))
    placed = Cut(placed.join(common, cohort, "left").select(cohort, record, rest.alias(ids), F.coalesce(F.size("_common"), F.lit(0)).alias("_base"), "_i", "_all")).df
    other = placed.select(cohort, F.col("_i").alias("_j"), F.col(record).alias("donor"), F.col(ids).alias("_theirs"))
    best = F.struct(F.lit(None).cast("int").alias("shared"), F.lit(None).cast("bigint").alias("_k"), F.lit(None).cast(df.schema[record].dataType).alias("donor"))
    left, seen, width, out = placed.where("_all > 1").withColumn("_b", F.when(F.lit(False), best)), 0, choices, None
    while True:
        offers = left.withColumn("_k", F.explode(F.sequence(F.lit(seen + 1).cast("bigint"), F.least(F.lit(seen + width).cast("bigint"), F.col("_all") - 1)))).withColumn("_j", F.pmod(F.col("_i") + F.col("_k"), F.col("_all")))
        met = offers.join(other, [cohort, "_j"]).withColumn("_new", F.struct(F.size(F.array_intersect(ids, "_theirs")).alias("shared"), "_k", "donor"))
        got = met.groupBy(cohort, record, "_i").agg(F.min("_new").alias("_new"))
        seen, width = seen + width, 2 * width
        now = Cut(left.join(got, [cohort, record, "_i"]).withColumn("_b", F.least("_b", "_new")).drop("_new")).df
        settled = (F.col("_b.shared") == 0) | (F.col("_all") - 1 <= seen)
        done = now.where(settled).select(record, F.col("_b.donor").alias("donor"), (F.col("_b.shared") + F.col("_base")).alias("shared"))
        out = done if out is None else out.unionByName(done)
        left = now.where(~settled)
        if left.isEmpty():
            return out


def placeholder_names(tokens_column: Column, key: Column) -> Column:
    """Tokens with every capitalised one after the first replaced by a placeholder from its hash, so their number stays."""
    return F.transform(tokens_column, lambda t, i: F.when((i > 0) & t.rlike(r"^\p{Lu}"), F.concat(F.lit("Name"), F.upper(F.substring(F.sha2(F.concat_ws(":", key, t), 256), 1, 6)))).otherwise(t))
