"""Groups, copies and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumark.functions.text import normal_claim
from vellumark.tables import Cut, fingerprint, join_on_unique, words


def _hung(edges: DataFrame, rows: int, both_ways: bool) -> DataFrame:
    """Edges (u, v) with u > v, rewritten: with both_ways every greater neighbour of a node hangs on the least of the node and its neighbours,
    else a node and its lesser neighbours hang on the least of these."""
    ends = edges.select("u", "v")
    if both_ways:
        ends = ends.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = join_on_unique(ends, least, "u", rows=2 * rows).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = ends.groupBy("u").agg(F.min("v").alias("m"))
        hung = join_on_unique(ends, least, "u", rows=rows).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def edge_groups(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the edges (u, v) but the least of its group, with that least one. Ends may come in either order, repeat, be equal or
    null. Rewritten edges are a written table each round, and the last round changes none."""
    ends = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = Cut(ends)
    mark = fingerprint(now.df, "u", "v")
    while mark[0]:
        wide = Cut(_hung(now.df, mark[0], True))
        now.drop()
        now = Cut(_hung(wide.df, wide.df.count(), False))
        wide.drop()
        before, mark = mark, fingerprint(now.df, "u", "v")
        if mark == before:
            break
    return now.df


def linked_groups(rows: DataFrame, record: str, keys: list[Column]) -> DataFrame:
    """(record, group): records that share any of the keys, directly or through others; group is the least record.

    Every record comes out; null and blank keys link nothing. A key ties its records to the least of them, and only records that share a key
    take part in the rounds that follow.
    """
    kind = F.explode(F.array(*(F.when(k.cast("string") != "", F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(keys))))
    pairs = Cut(rows.select(F.col(record).alias("u"), kind.alias("k")).where("u is not null and k is not null").distinct())
    least = pairs.df.groupBy("k").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    group = edge_groups(join_on_unique(pairs.df, least, "k").select("u", "v"))
    everyone = rows.select(F.col(record).alias("u")).where("u is not null").distinct()
    return everyone.join(group, "u", "left").select(F.col("u").alias(record), F.coalesce("v", "u").alias("group"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def pool(df: DataFrame, text: str) -> DataFrame:
    """(id, text): one row per text in normal form, with its digest and the least of its spellings; blank texts are left out."""
    norm = normal_claim(text)
    return df.where(norm != "").groupBy(F.sha2(norm, 256).alias("id")).agg(F.min(text).alias("text"))


def collapse_context(items: Column, family: str, text: str) -> Column:
    """The items that neither repeat the family nor the text of an item kept before them, in order.

    An item dropped for one of the two doesn't block later items by its other.
    """
    blank = lambda x: F.trim(F.regexp_replace(F.coalesce(x[text], F.lit("")), r"(?U)\s+", " "))
    empty = F.slice(items, 1, 0)
    return F.aggregate(items, empty, lambda kept, x: F.when(F.exists(kept, lambda k: k[family].eqNullSafe(x[family]) | (blank(k) == blank(x))), kept).otherwise(F.concat(kept, F.array(x))))


def collapse_families(df: DataFrame, record: str, family: Column, order: list[Column]) -> DataFrame:
    """The first row of each source family in each record; rows without a family all stay."""
    marked = df.withColumn("_f", F.when(family != "", family))
    first = F.row_number().over(Window.partitionBy(record, "_f").orderBy(*order))
    return marked.withColumn("_rn", first).where("_f is null or _rn = 1").drop("_f", "_rn")


def without_conflicts(df: DataFrame, payload: list[str], label: str, key: str) -> DataFrame:
    """(payload, key, label): payloads with one label only, with their least key."""
    one = df.groupBy(*payload).agg(F.countDistinct(label).alias("_n"), F.min(key).alias(key), F.min(label).alias(label))
    return one.where("_n = 1").drop("_n")


def near_duplicates(docs: DataFrame, doc: str, text: str, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, class_id, n_links): documents whose word shingles share `similarity` of all shingles of both, in classes.

    A document with other words than its near-duplicates is linked to each of them; copies (the same shingles) count as one document for
    n_links and share class and links. class_id is the least document of all that are linked directly or through others.
    Documents with fewer than `size` words have no shingles and stand alone; null texts too.

    Candidates come by prefix filtering: in one order of all shingles, rarest first, two sets that are similar enough share one of their first
    n - ceil(t n) + 1 shingles. A shingle in very many prefixes makes many candidates, which its rarity prevents.
    """
    w = words(text)
    listed = docs.select(F.col(doc).alias("doc"), w.alias("_w"))
    gram = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i + 1, size), " ")))
    sets = listed.select("doc", F.when(F.size("_w") >= size, F.array_sort(F.array_distinct(gram))).otherwise(F.array().cast("array<bigint>")).alias("s"))
    sets = Cut(sets.select("doc", "s", F.when(F.size("s") > 0, F.sha2(F.array_join("s", ","), 256)).alias("key"))).df
    copies = sets.where("key is not null").groupBy("key").agg(F.min("doc").alias("rep"), F.first("s").alias("s"))
    reps = Cut(copies.select("rep", "s", F.size("s").alias("n"))).df
    each = reps.select("rep", "n", F.explode("s").alias("g"))
    counts = each.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    # shingles that only one document has can't make a pair, but they take their place in the order
    placed = join_on_unique(each, counts, "g").withColumn("_at", F.row_number().over(Window.partitionBy("rep").orderBy("c", "g")))
    prefix = placed.where(F.col("_at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).where("c > 1").select("rep", "n", "g")
    prefix = Cut(prefix).df
    a, b = prefix.toDF("ra", "na", "g"), prefix.toDF("rb", "nb", "g")
    near = a.join(b, "g").where((F.col("ra") < F.col("rb")) & (F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9)).select("ra", "rb").distinct()
    left, right = reps.select(F.col("rep").alias("ra"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("rb"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = near.join(left, "ra").join(right, "rb").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("ra", "rb")
    links = Cut(links).df
    ends = links.select(F.col("ra").alias("rep")).union(links.select("rb")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    grouped = edge_groups(links.select(F.col("ra").alias("u"), F.col("rb").alias("v"))).select(F.col("u").alias("rep"), F.col("v").alias("group"))
    rep_of = sets.join(copies.select("key", "rep"), "key", "left")
    out = rep_of.join(grouped, "rep", "left").join(ends, "rep", "left")
    return out.select(F.col("doc").alias(doc), F.coalesce("group", "rep", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def spans_of_tags(tags: DataFrame, keys: list[str], position: str, tag: str) -> DataFrame:
    """(keys, start, end, kind): spans of I-/B- tags; a span ends at O, at another kind, or where a B- begins a new one. end is exclusive."""
    w = Window.partitionBy(*keys).orderBy(position)
    kind = F.when(F.col(tag) != "O", F.regexp_replace(F.col(tag), "^[BI]-", ""))
    marked = tags.withColumn("_k", kind).withColumn("_before", F.lag(kind).over(w))
    starts = F.col("_k").isNotNull() & (F.col(tag).startswith("B-") | ~F.col("_k").eqNullSafe(F.col("_before")))
    numbered = marked.withColumn("_id", F.sum(starts.cast("int")).over(w)).where("_k is not null")
    return numbered.groupBy(*keys, "_id", F.col("_k").alias("kind")).agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_id")

