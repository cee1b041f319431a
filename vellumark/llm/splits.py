"""Splits that keep related records together.

Groups are the connected components of records that share a claim, an evidence id or a declared group. Components of
identical size and label profile form a bundle; a min-cost flow with deviation costs shares the components of all bundles out to
the splits in whole numbers, and a seeded hash decides which component of a bundle goes where. Only bundles, never
components, reach the driver: there are at most as many sizes as the square root of twice the records, and each size has as
many profiles as ways to share it among the labels.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.llm.components import components, tie_by_key
from vellumark.llm.consistent import with_consistent
from vellumark.tables import Cut

PROPORTIONS = {"train": 0.7, "validation": 0.15, "test": 0.15}

def claim_key(predictions: DataFrame) -> DataFrame:
    """(record_index, claim_key): the claim in consistent form, without case and with single blanks; blank claims give null."""
    distinct = predictions.select("record_index", "claim").distinct()
    form = with_consistent(distinct, ["claim"])
    key = F.trim(F.regexp_replace(F.lower("claim_consistent"), r"(?U)\s+", " "))
    return form.select("record_index", F.when(key != "", key).alias("claim_key"))


def related_records(predictions: DataFrame, split_result: DataFrame) -> DataFrame:
    """(record_index, group_id) of records tied to another one by an evidence id, a group_by_index value or an equal claim.

    Null and blank ids, groups and claims tie nothing; records that predictions lacks are ignored. The keys of one kind
    never meet those of another kind.
    """
    record = predictions.where("record_index is not null")
    evidence = record.select("record_index", F.explode("evidence.id").alias("v")).select("record_index", F.concat(F.lit("e:"), F.trim("v")).alias("k")).where("k <> 'e:'")
    declared = split_result.select(F.explode("group_by_index").alias("record_index", "v")).select("record_index", F.concat(F.lit("g:"), F.trim("v")).alias("k")).where("k <> 'g:'")
    declared = declared.join(record.select("record_index").distinct(), "record_index", "left_semi")
    claims = claim_key(record).select("record_index", F.concat(F.lit("c:"), F.col("claim_key")).alias("k"))
    keyed = evidence.unionByName(declared).unionByName(claims.select("record_index", F.sha2("k", 256).alias("k")))
    ties = tie_by_key(keyed, "record_index", "k")
    return components(ties).select(F.col("node").alias("record_index"), F.col("group").alias("group_id"))


class _Class:
    """Min-cost flow of one size's components from their bundles through the splits to the sink.

    Arcs from bundles to splits, and from splits to the sink, have convex costs, so the residual network is kept in terms of single
    moves: what one more, or one less, component of a bundle in a split costs. Each bundle begins at its own cheapest shares, which
    leaves no negative cycle among bundles. Then the cheapest cycle through the sink, found over the splits with the cheapest
    bundle for each pair of them, is used as far as its costs stay the same, until none is negative: that is the optimum.
    """

    def __init__(self, numbers: list[int], shares: list[float], goals: list[float], labels: list[list[float]], total_cost: float = 2.0):
        """numbers: components per bundle; goals: components that each split lacks; labels: per bundle, a component's further cost in each split."""
        self.k = range(len(shares))
        self.quota = [[n * p for p in shares] for n in numbers]
        self.extra, self.goals, self.weight = labels, goals, total_cost
        self.x = [[int(q + 1e-9) for q in qs] for qs in self.quota]
        for b, n in enumerate(numbers):
            for _ in range(n - sum(self.x[b])):
                self.x[b][min(self.k, key=lambda j: (self.up(b, j)[0], j))] += 1
            while True:
                cost, i, j = min((self.down(b, i)[0] + self.up(b, j)[0], i, j) for i in self.k for j in self.k if i != j) if len(shares) > 1 else (0.0, 0, 0)
                if cost > -1e-9:
                    break
                self.x[b][i] -= 1
                self.x[b][j] += 1
        self.totals = [sum(row[j] for row in self.x) for j in self.k]
        self.version = [0] * len(numbers)
        self.heaps: dict[tuple[int, int], list] = {(i, j): [] for i in self.k for j in self.k if i != j}
        for b in range(len(numbers)):
            self._push(b, heapify=False)
        for h in self.heaps.values():
            heapq.heapify(h)

    @staticmethod
    def _more(x: int, q: float) -> tuple[float, float]:
        """How |x - q| changes with one more, and how many more keep that change."""
        below = math.floor(q + 1e-9)
        if x < below:
            return -1.0, below - x
        if x == below and q > below + 1e-9:
            return 2 * below + 1 - 2 * q, 1
        return 1.0, float("inf")

    @staticmethod
    def _less(x: int, q: float) -> tuple[float, float]:
        above = math.ceil(q - 1e-9)
        if x > above:
            return -1.0, x - above
        if x == above and q < above - 1e-9:
            return 2 * q - 2 * above + 1, 1
        return 1.0, float("inf")

    def up(self, b: int, j: int) -> tuple[float, float]:
        cost, run = self._more(self.x[b][j], self.quota[b][j])
        return cost + self.extra[b][j], run

    def down(self, b: int, j: int) -> tuple[float, float]:
        if not self.x[b][j]:
            return float("inf"), 0
        cost, run = self._less(self.x[b][j], self.quota[b][j])
        return cost - self.extra[b][j], min(run, self.x[b][j])

    def _push(self, b: int, heapify: bool = True) -> None:
        for (i, j), h in self.heaps.items():
            cost = self.down(b, i)[0] + self.up(b, j)[0]
            if cost < float("inf"):
                h.append((cost, b, self.version[b])) if not heapify else heapq.heappush(h, (cost, b, self.version[b]))

    def _cheapest(self, i: int, j: int) -> tuple[float, int]:
        h = self.heaps[i, j]
        while h and h[0][2] != self.version[h[0][1]]:
            heapq.heappop(h)
        return (h[0][0], h[0][1]) if h else (float("inf"), -1)

    def solve(self) -> list[list[int]]:
        k, w = self.k, self.weight
        while True:
            moves = {p: self._cheapest(*p) for p in self.heaps}
            dist = {p: (c, [(p, b)]) for p, (c, b) in moves.items()}
            for m in k:
                for i in k:
                    for j in k:
                        if len({i, j, m}) == 3 and dist[i, m][0] + dist[m, j][0] < dist[i, j][0] - 1e-9:
                            dist[i, j] = (dist[i, m][0] + dist[m, j][0], dist[i, m][1] + dist[m, j][1])
            best, path, ends = -1e-9, None, None
            for (i, j), (cost, steps) in dist.items():
                less, more = self._less(self.totals[i], self.goals[i]), self._more(self.totals[j], self.goals[j])
                if cost + w * (less[0] + more[0]) < best:
                    best, path, ends = cost + w * (less[0] + more[0]), steps, (less[1], more[1])
            if path is None:
                return self.x
            amount = min(*ends, *(min(self.down(b, i)[1], self.up(b, j)[1]) for (i, j), b in path))
            amount = 1 if len({b for _, b in path}) < len(path) else int(amount)
            for (i, j), b in path:
                self.x[b][i] -= amount
                self.x[b][j] += amount
            self.totals[path[0][0][0]] -= amount
            self.totals[path[-1][0][1]] += amount
            for b in {b for _, b in path}:
                self.version[b] += 1
                self._push(b)


def allot(bundles: list[tuple[int, tuple, int]], shares: list[float]) -> list[list[int]]:
    """How many of each bundle's components go to each split.

    bundles: (size, profile, components); a profile is the number of a component's records of each label, as (label, number) pairs. The
    components of one size are units of one min-cost flow, and sizes are solved from the largest down. Deviations cost: each bundle's from its
    quota in every split; the splits' totals, of this and all greater sizes, from their shares (twice as much); and, half as much, what a
    component adds to a split's deviation in its labels.
    """
    k = range(len(shares))
    given: list[list[int]] = [[] for _ in bundles]
    lack = [0.0] * len(shares)
    short: dict[str, list[float]] = {}
    sizes: dict[int, list[int]] = {}
    for i, (size, _, _) in enumerate(bundles):
        sizes.setdefault(size, []).append(i)
    for size in sorted(sizes, reverse=True):
        own = sizes[size]
        for i in own:
            _, profile, n = bundles[i]
            for j in k:
                lack[j] += size * n * shares[j]
                for label, c in profile:
                    short.setdefault(label, [0.0] * len(shares))[j] += c * n * shares[j]
        labels = [[sum(abs(short[label][j] - c) - abs(short[label][j]) for label, c in bundles[i][1]) / (2 * size) for j in k] for i in own]
        for i, x in zip(own, _Class([bundles[i][2] for i in own], shares, [v / size for v in lack], labels).solve(), strict=True):
            given[i] = x
            for j in k:
                lack[j] -= size * x[j]
                for label, c in bundles[i][1]:
                    short[label][j] -= c * x[j]
    return given


def assign_splits(records: DataFrame, groups: DataFrame, record: str, label: str, proportions: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(record, group_id, split) of every record; a group is never divided.

    records: any columns, rows may repeat; groups: (record, group_id) of records tied to others, the rest stand alone.
    A record's label is the least of its labels, null as ''. Empty input gives no rows. The same seed gives the same splits.
    """
    names, shares = zip(*(proportions or PROPORTIONS).items(), strict=True)
    if abs(sum(shares) - 1) > 1e-9 or min(shares) < 0:
        raise ValueError("proportions must be non-negative and sum to 1")
    one = records.where(F.col(record).isNotNull()).groupBy(record).agg(F.coalesce(F.min(label), F.lit("")).alias("_label"))
    placed = Cut(one.join(groups, record, "left").select(record, F.coalesce("group_id", record).alias("group_id"), "_label"))
    counts = placed.df.groupBy("group_id", "_label").agg(F.count(F.lit(1)).alias("n"))
    by = F.array_sort(F.collect_list(F.struct("_label", "n")))
    bundled = Cut(counts.groupBy("group_id").agg(F.sum("n").alias("size"), F.to_json(by).alias("profile")))
    per = bundled.df.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n"))
    bundles = [(r["size"], r["profile"], r["n"]) for r in per.orderBy("size", "profile").collect()]
    quota = allot([(s, tuple((x["_label"], x["n"]) for x in json.loads(p)), n) for s, p, n in bundles], list(shares))
    rows = [(s, p, *(sum(q[: j + 1]) for j in range(len(names)))) for (s, p, _), q in zip(bundles, quota, strict=True)]
    spark = records.sparkSession
    ends = spark.createDataFrame(rows or [(0, "", *[0] * len(names))], "size long, profile string, " + ", ".join(f"end{j} long" for j in range(len(names))))
    ranked = _rank_in_bundle(bundled.df, seed)
    pick = F.lit(names[-1])
    for j in reversed(range(len(names) - 1)):
        pick = F.when(F.col("rank") <= F.col(f"end{j}"), F.lit(names[j])).otherwise(pick)
    chosen = ranked.join(ends, ["size", "profile"]).select("group_id", pick.alias("split"))
    return placed.df.join(chosen, "group_id").select(record, "group_id", "split")


def _rank_in_bundle(groups: DataFrame, seed: int, parts: int = 256) -> DataFrame:
    """Each group's place in its bundle by seeded hash, from 1. A bundle may hold a third of all groups, so it is ranked in parts:
    the counts of its hash ranges give each range's first place, and only a range is ordered in one task."""
    hashed = groups.withColumn("_h", F.xxhash64(F.lit(seed), "group_id")).withColumn("_part", F.pmod(F.shiftright("_h", 40), F.lit(parts)))
    sizes = hashed.groupBy("size", "profile", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("size", "profile").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("size", "profile", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("size", "profile", "_part").orderBy("_h", "group_id"))
    return hashed.withColumn("_place", place).join(starts, ["size", "profile", "_part"]).select("group_id", "size", "profile", (F.col("_start") + F.col("_place")).alias("rank"))


def split_report(assigned: DataFrame, records: DataFrame, record: str, label: str) -> DataFrame:
    """(label, split, n_records, share): records of each split and their share, per label and, with label null, overall."""
    labels = records.groupBy(record).agg(F.coalesce(F.min(label), F.lit("")).alias("label"))
    per = Cut(assigned.select(record, "split").join(labels, record).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n_records"))).df
    overall = per.groupBy("split").agg(F.sum("n_records").alias("n_records")).select(F.lit(None).cast("string").alias("label"), "split", "n_records")
    share = F.col("n_records") / F.sum("n_records").over(Window.partitionBy("label"))
    return overall.unionByName(per).withColumn("share", share)
