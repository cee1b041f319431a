"""Parent–child links to full hierarchies: path, depth, root and descendants of every node, loops marked.

Method: level-wise frontier joins from the roots extend paths and depths; what no frontier reaches lies on a loop or
below one. Levels run in blocks: a block chains several joins in one job, and its end is a written table, so a chain of
hundreds of levels needs neither a job per level nor a growing lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.tables import Cut, hot_keys

#: Links still to follow are sent to all executors when at most so many; more of them are joined by shuffling.
SMALL_STEP = 20_000
#: Copies of a parent's row where it has very many children.
SALTS = 32
#: Levels in one job: with shuffled links, and with links at hand.
WIDE, DEEP = 4, 32


def clean_id(c: Column) -> Column:
    """The id without outer white space and in capitals; blank becomes null."""
    t = F.upper(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def trees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, depth, path) of every node.

    nodes: (node); links: (child, parent), both may repeat and hold nulls; a link with a null end is no link. Nodes that only
    links name count too. A root (no parent) has depth 0 and its id as path; path joins ids with "/". A node on a loop, or
    below one, has root "", depth -1 and path "". With several parents a node takes its shallowest path, and of these the
    least; it is marked as looped only if no root reaches it. Empty input gives no rows.
    """
    links = Cut(links.select(F.col("child").alias("next"), F.col("parent").alias("at")).where("next is not null and at is not null").distinct())
    ids = nodes.select("node").where("node is not null").union(links.df.select("next")).union(links.df.select("at")).distinct()
    is_child = links.df.select(F.col("next").alias("node")).distinct().withColumn("_child", F.lit(True))
    every = Cut(ids.join(is_child, "node", "left"))
    one_parent = not links.df.groupBy("next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)
    done = [Cut(every.df.where("_child is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").alias("path")))]
    front, rest, base, width = done[0].df, links, 0, done[0].df.count()
    left = rest.df.count()
    while width and left:
        small = left <= SMALL_STEP
        levels = (DEEP if small else WIDE) if one_parent else 1
        hot = [] if small else hot_keys(rest.df, "at", rows=left)
        step = F.broadcast(rest.df) if small else rest.df.withColumn("_salt", F.when(F.col("at").isin(hot), F.pmod(F.xxhash64("next"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
        at = front
        for _ in range(levels):
            # a row that has no child stays as it is, so every node of the block lies on some row's path; a parent of very many children
            # is met by salted copies of its row, and a copy that finds no child only stays too
            if small:
                met = at.join(step, F.col("node") == step["at"], "left")
            else:
                salts = F.when(F.col("node").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
                copies = at.withColumn("_copy", F.explode(salts))
                met = copies.join(step, (F.col("node") == step["at"]) & (F.col("_copy") == step["_salt"]), "left")
            at = met.select(
                F.coalesce("next", "node").alias("node"),
                "root",
                (F.col("depth") + F.col("next").isNotNull().cast("int")).alias("depth"),
                F.when(F.col("next").isNotNull(), F.concat_ws("/", "path", "next")).otherwise(F.col("path")).alias("path"),
            )
        ends = at.where(F.col("depth") > base).withColumn("_ids", F.split("path", "/"))
        block = ends.select("root", "_ids", F.explode(F.sequence(F.lit(base + 1), F.col("depth"))).alias("depth")).select(
            F.element_at("_ids", F.col("depth") + 1).alias("node"), "root", "depth", F.array_join(F.slice("_ids", 1, F.col("depth") + 1), "/").alias("path")
        )
        block = block.groupBy("node").agg(F.min(F.struct("depth", "path", "root")).alias("s")).select("node", "s.root", "s.depth", "s.path")
        new = Cut(block)
        done.append(new)
        base += levels
        front = new.df.where(F.col("depth") == base)
        width = front.count()
        # links to nodes that were found are done with, so no node is found again later by a longer way
        trimmed = Cut(rest.df.join(new.df.select(F.col("node").alias("next")), "next", "left_anti").select("next", "at"))
        rest.drop()
        rest, left = trimmed, trimmed.df.count()
    found = done[0].df
    for r in done[1:]:
        found = found.unionByName(r.df)
    looped = every.df.select("node").join(found.select("node"), "node", "left_anti")
    return found.unionByName(looped.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path")))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, node, distance) for each node and each of its ancestors: the ids of its path, read from its end.

    One row per pair, made by exploding each path, so a root with a third of all nodes below it is never gathered.
    """
    up = tree.where("depth > 0").select("node", "depth", F.posexplode(F.split("path", "/")).alias("_i", "ancestor"))
    return up.where("_i < depth").select("ancestor", "node", (F.col("depth") - F.col("_i")).alias("distance"))


def provenance_trees(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Trees over the links of evidence.parent_evidence_id and of the provenance edges together.

    Ids are compared without outer white space and in capitals; blank and null ids are none.
    """
    ev = evidence.select(clean_id(F.col("evidence_id")).alias("child"), clean_id(F.col("parent_evidence_id")).alias("parent"))
    ed = edges.select(clean_id(F.col("child_evidence_id")).alias("child"), clean_id(F.col("parent_evidence_id")).alias("parent"))
    both = ev.unionByName(ed)
    return trees(both.select(F.col("child").alias("node")).union(both.select("parent")), both)
