"""Label-blind sampling and splitting by hash, exclusions, folds and grouped splits.

Order comes from SHA-256 of a seed and the id, so any engine draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.tables import Cut


def hash_key(seed: str, ident: Column) -> Column:
    """SHA-256 of 'seed:id'."""
    return F.sha2(F.concat(F.lit(seed + ":"), ident.cast("string")), 256)


def hash_number(seed: str, ident: Column) -> Column:
    """The first eight hex digits of the hash as a number."""
    return F.conv(F.substring(hash_key(seed, ident), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, ident: str, n: int, seed: str, text: Column | None = None) -> DataFrame:
    """The n ids with the least hashes; with `text`, rows of the same text count once (their least hash).

    The n least are found as a top-n per partition and a merge of those, so nothing is sorted as a whole.
    """
    rows = df.where(F.col(ident).isNotNull()).withColumn("_h", hash_key(seed, F.col(ident)))
    if text is not None:
        rows = rows.withColumn("_t", text).where(F.col("_t") != "").groupBy("_t").agg(F.min(F.struct("_h", ident)).alias("_s")).select(F.col(f"_s.{ident}").alias(ident), F.col("_s._h").alias("_h"))
    return rows.select(ident, "_h").distinct().orderBy("_h", ident).limit(n).select(ident)


def stratified_sample(df: DataFrame, ident: str, strata: list[str], n: int, seed: str) -> DataFrame:
    """The n ids with the least hashes in each stratum."""
    rows = df.select(ident, *strata).distinct().withColumn("_h", hash_key(seed, F.col(ident)))
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", ident))).where(F.col("_rn") <= n).select(ident, *strata)


def hash_split(df: DataFrame, ident: str, parts: int, seed: str) -> DataFrame:
    """df with `part`: hash modulo the number of parts."""
    return df.withColumn("part", F.pmod(hash_number(seed, F.col(ident)), F.lit(parts)).cast("int"))


def folds(df: DataFrame, ident: str, n: int, seed: str) -> DataFrame:
    """(id, fold): round-robin on the hash order of the distinct ids, so folds differ by one id at most.

    Ids are placed in hash ranges first; only a range is ordered in one task.
    """
    ids = df.where(F.col(ident).isNotNull()).select(ident).distinct().withColumn("_h", hash_key(seed, F.col(ident))).withColumn("_r", F.substring("_h", 1, 2))
    held = Cut(ids).df
    sizes = held.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    first = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", ident)) - 1
    return held.join(sizes.select("_r", first.alias("_first")), "_r").select(ident, F.pmod(F.col("_first") + place, F.lit(n)).cast("int").alias("fold"))


def stratified_group_folds(df: DataFrame, group: str, label: str, n: int, seed: str) -> DataFrame:
    """(group, label, fold): whole groups dealt to n folds in turn, separately for each label, by hash order; a group's label is the least of its labels.

    Only (label, hash range) counts decide where a range begins, so no label's groups are ordered in one task.
    """
    h = hash_key(seed, F.col(group))
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(label).alias(label)).withColumn("_h", h).withColumn("_r", F.substring("_h", 1, 2))
    sizes = groups.groupBy(label, "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(label).alias("_l"), F.col("_r").alias("_sr"), before.alias("_s"))
    place = F.row_number().over(Window.partitionBy(label, "_r").orderBy("_h", group)) - 1
    placed = groups.withColumn("_p", place).join(starts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_sr")))
    return placed.select(group, label, F.pmod(F.col("_s") + F.col("_p"), F.lit(n)).cast("int").alias("fold"))


def cut_by_order(groups: DataFrame, group: str, shares: dict[str, float], seed: str) -> DataFrame:
    """(group, split): groups in hash order, cut at the cumulated shares of their number."""
    placed = folds(groups, group, 1 << 30, seed).withColumnRenamed("fold", "_place")
    n = placed.count()
    names, edges, total = list(shares), [], 0.0
    for name in names:
        total += shares[name]
        edges.append(round(total * n))
    pick = F.lit(names[-1])
    for name, edge in reversed(list(zip(names[:-1], edges[:-1], strict=True))):
        pick = F.when(F.col("_place") < edge, F.lit(name)).otherwise(pick)
    return placed.select(group, pick.alias("split"))


def exclude(df: DataFrame, prior: DataFrame, keys: list[Column], prior_keys: list[Column]) -> DataFrame:
    """Rows of df none of whose keys a prior row has; a null or blank key excludes nothing."""
    for i, (k, p) in enumerate(zip(keys, prior_keys, strict=True)):
        seen = prior.select(p.alias(f"_k{i}")).where(f"_k{i} is not null and _k{i} <> ''").distinct()
        df = df.withColumn(f"_k{i}", k).join(seen, f"_k{i}", "left_anti").drop(f"_k{i}")
    return df


def exclude_similar(df: DataFrame, ident: str, words: Column, prior: DataFrame, prior_words: Column, similarity: float = 0.8) -> DataFrame:
    """Rows of df whose distinct words share less than `similarity` of all words with every prior row's.

    A pair that is similar enough shares one of the first n - ceil(t n) + 1 words of each set in one order of all words, rarest
    first, so only those are joined.
    """
    own = df.select(F.col(ident).alias("a"), F.array_distinct(words).alias("wa")).where(F.size("wa") > 0)
    past = Cut(prior.select(F.array_sort(F.array_distinct(prior_words)).alias("wb")).where(F.size("wb") > 0).distinct()).df
    own = Cut(own).df
    counts = own.select(F.explode("wa").alias("w")).union(past.select(F.explode("wb").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("c"))

    def prefixes(rows: DataFrame, key: str, w: str) -> DataFrame:
        each = rows.select(key, F.size(w).alias("n"), F.explode(w).alias("w")).join(counts, "w")
        at = F.row_number().over(Window.partitionBy(key).orderBy("c", "w"))
        return each.withColumn("_at", at).where(F.col("_at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).select(key, "w")

    past = past.withColumn("b", F.sha2(F.array_join("wb", " "), 256))
    near = prefixes(own, "a", "wa").join(prefixes(past, "b", "wb"), "w").select("a", "b").distinct()
    both = F.size(F.array_intersect("wa", "wb"))
    hit = near.join(own, "a").join(past, "b").where(both >= similarity * (F.size("wa") + F.size("wb") - both) - 1e-9).select(F.col("a").alias(ident)).distinct()
    return df.join(hit, ident, "left_anti")


def disjoint_selection(candidates: DataFrame, ident: str, order: str, keys: DataFrame, key: str) -> DataFrame:
    """The ids that a pass over the candidates in order takes, when it skips each one that shares a key with one taken before.

    Done in rounds: a candidate that comes first on all its keys is taken, and those it shares a key with are dropped. Each round
    is one aggregation and joins; the result is that of the sequential pass. Candidates without keys are all taken.
    """
    alive = Cut(candidates.select(ident, order).distinct())
    pairs = keys.select(ident, F.col(key).alias("_k")).where("_k is not null").distinct()
    taken = None
    while True:
        left = alive.df.join(pairs, ident, "left").select(ident, F.struct(order, ident).alias("_o"), "_k")
        first = left.where("_k is not null").groupBy("_k").agg(F.min("_o").alias("_first"))
        judged = left.join(first, "_k", "left").groupBy(ident).agg(F.bool_and(F.col("_k").isNull() | (F.col("_o") == F.col("_first"))).alias("_take"))
        new = Cut(judged.where("_take").select(ident))
        taken = new.df if taken is None else taken.unionByName(new.df)
        blocked = pairs.join(new.df, ident, "left_semi").select("_k").distinct()
        gone = pairs.join(blocked, "_k", "left_semi").select(ident).distinct()
        rest = Cut(alive.df.join(new.df, ident, "left_anti").join(gone, ident, "left_anti"))
        alive.drop()
        alive = rest
        if alive.df.isEmpty():
            return taken


def training_variants(df: DataFrame, copies: list[int]) -> DataFrame:
    """Each row once per number of copies, with `n_copies` and `weight` 1 / variants."""
    return df.select("*", F.explode(F.array(*map(F.lit, copies))).alias("n_copies"), F.lit(1.0 / len(copies)).alias("weight"))


def balanced_split(groups: DataFrame, group: str, label: str, size: str, share: float, trials: int, seed: str) -> DataFrame:
    """(group, held_out): the best of so many hashed assignments of whole groups to a held-out side.

    An assignment's cost is the squared relative error of the held-out rows, overall and per label; ties go to the earlier trial. All
    trials are summed in one aggregation; only (trial, label) sums are compared.
    """
    per = Cut(groups.groupBy(group, label).agg(F.sum(size).alias("_n"))).df
    each = per.withColumn("_trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    chance = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("_trial").cast("string"), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    held = F.when(chance < share, F.col("_n")).otherwise(0)
    sums = each.groupBy("_trial", label).agg(F.sum(held).alias("_h"), F.sum("_n").alias("_t"))
    by_label = F.pow((F.col("_h") - share * F.col("_t")) / (share * F.col("_t")), 2)
    total = F.pow((F.sum("_h") - share * F.sum("_t")) / (share * F.sum("_t")), 2)
    cost = sums.groupBy("_trial").agg(F.round(F.sum(by_label) + total, 12).alias("_cost"))
    best = cost.agg(F.min(F.struct("_cost", "_trial")).alias("b")).first()["b"]
    trial = best["_trial"] if best else 1
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(str(trial)), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return per.select(group).distinct().select(group, (pick < share).alias("held_out"))
