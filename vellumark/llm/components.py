"""Consolidating pairwise matches into groups: connected components over distributed edges.

Method: large-star and small-star edge rewrites alternate until the edges no longer change; then every node is tied to the
least node of its component. Each rewrite is a map-side combined minimum per node and a join with it; joins spread hot
nodes over salted copies of their one row. Each round's edges are written to the shared folder, so lineage stays short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.tables import Cut, fingerprint, join_on_unique


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour greater than a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    return join_on_unique(both, least, "u", rows=2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node's lesser neighbours, and the node, are tied to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_on_unique(edges, least, "u", rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """(node, group) for every node that some pair ties to another one; group is the least node of its component.

    Pairs may repeat, stand in either order or name a node twice (such a pair, and one with a null end, ties nothing). Nodes
    of any orderable type; further columns are ignored. Empty input, or input without ties, gives no rows.
    """
    edges = pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    now = Cut(edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).where("u <> v").distinct())
    mark = fingerprint(now.df, "u", "v")
    while True:
        wide = Cut(_large_star(now.df, mark[0]))
        new = Cut(_small_star(wide.df, wide.df.count()))
        wide.drop()
        now.drop()
        now, before, mark = new, mark, fingerprint(new.df, "u", "v")
        if mark == before:
            break
    roots = now.df.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("group"))
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(roots)


def tie_by_key(rows: DataFrame, record: str, key: str) -> DataFrame:
    """Edges (left, right) that tie all records with the same key to the least of them: a star per key, never all pairs.

    Null keys and null records tie nothing.
    """
    pairs = rows.select(F.col(record).alias("left"), F.col(key).alias("_key")).where("left is not null and _key is not null").distinct()
    held = Cut(pairs)
    least = held.df.groupBy("_key").agg(F.min("left").alias("right"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return join_on_unique(held.df, least, "_key").where("left <> right").select("left", "right").distinct()


def match_groups(matches: DataFrame, records: DataFrame, record: str = "record_index") -> DataFrame:
    """(record, group_id) of each record of `records` that accepted pairs of `matches` tie to another one.

    Pairs that name a record which `records` lacks are ignored, as are rejected pairs and those without a decision.
    """
    known = records.select(F.col(record).alias("_r")).where("_r is not null").distinct()
    ok = matches.where("decision = 'accepted'").select("left_record", "right_record").distinct()
    ok = ok.join(known.withColumnRenamed("_r", "left_record"), "left_record", "left_semi")
    ok = ok.join(known.withColumnRenamed("_r", "right_record"), "right_record", "left_semi")
    return components(ok, "left_record", "right_record").select(F.col("node").alias(record), F.col("group").alias("group_id"))
