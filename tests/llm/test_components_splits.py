import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumark.llm.components import components, match_groups, tie_by_key
from vellumark.llm.splits import _Class, allot, assign_splits, related_records, split_report


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def groups(spark, pairs):
    df = spark.createDataFrame(pairs, "left long, right long")
    return {r["node"]: r["group"] for r in components(df).collect()}


def test_chain_star_and_odd_pairs(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3), (5, None), (2, 1), (2, 1)]
    assert groups(spark, pairs) == brute(pairs)


def test_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    assert groups(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert groups(spark, []) == {}


def test_hot_node_is_salted(spark, monkeypatch):
    import vellumark.tables as t

    monkeypatch.setattr(t, "HOT_ROWS", 10)
    pairs = [(1, i) for i in range(2, 300)] + [(i, i + 1) for i in range(400, 500)]
    assert groups(spark, pairs) == brute(pairs)


def test_match_groups_ignores_unknown_and_rejected(spark):
    m = spark.createDataFrame([(1, 2, "accepted", None), (2, 9, "accepted", 1.0), (3, 4, "rejected", 1.0), (5, 4, "accepted", 0.1), (5, 4, "accepted", 0.1), (4, 4, "accepted", 0.1), (6, None, "accepted", 1.0)], "left_record long, right_record long, decision string, score double")
    r = spark.createDataFrame([(i,) for i in range(1, 8)], "record_index long")
    assert {tuple(x) for x in match_groups(m, r).collect()} == {(1, 1), (2, 1), (4, 4), (5, 4)}


def test_tie_by_key_makes_stars(spark):
    df = spark.createDataFrame([(i, "k") for i in range(50)] + [(99, None), (98, "alone")], "r long, k string")
    assert {tuple(x) for x in tie_by_key(df, "r", "k").collect()} == {(i, 0) for i in range(1, 50)}


PREDICTIONS = "record_index long, claim string, evidence array<struct<id:string,text:string>>"
SPLIT = "group_by_index map<long,string>"


def test_related_records(spark):
    p = [(1, "A  claim", [("E1", "x")]), (2, "a clаim", None), (3, "", [("E1", "y")]), (4, "", []), (5, "other", [(None, "z")]), (6, None, [(None, "z")]), (7, "seven", None), (1, "A  claim", [("E1", "x")])]
    s = [({5: "G", 7: "G", 100: "H"},), ({100: "H", 6: "H"},), (None,)]
    got = {tuple(r) for r in related_records(spark.createDataFrame(p, PREDICTIONS), spark.createDataFrame(s, SPLIT)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)}
    assert related_records(spark.createDataFrame([], PREDICTIONS), spark.createDataFrame([], SPLIT)).count() == 0


def test_allot_is_whole_and_near():
    bundles = [(1, (("a", 1),), 101), (2, (("a", 1), ("b", 1)), 33), (7, (("b", 7),), 5), (50, (("b", 50),), 1)]
    shares = [0.7, 0.15, 0.15]
    got = allot(bundles, shares)
    assert [sum(g) for g in got] == [n for _, _, n in bundles]
    total = sum(s * n for s, _, n in bundles)
    for j, share in enumerate(shares):
        assert abs(sum(b[0] * g[j] for b, g in zip(bundles, got, strict=True)) / total - share) < 0.01


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=4), st.lists(st.integers(-6, 12), min_size=3, max_size=3), st.randoms(use_true_random=False))
def test_one_size_is_solved_to_the_optimum(numbers, goals, rnd):
    shares, goals = [0.6, 0.25, 0.15], [g / 2 for g in goals]
    extra = [[round(rnd.uniform(-0.5, 0.5), 2) for _ in shares] for _ in numbers]

    def cost(x):
        own = sum(abs(v - n * p) + v * e for row, n, es in zip(x, numbers, extra, strict=True) for v, p, e in zip(row, shares, es, strict=True))
        return own + 2 * sum(abs(sum(row[j] for row in x) - g) for j, g in enumerate(goals))

    ways = [[(a, b, n - a - b) for a in range(n + 1) for b in range(n + 1 - a)] for n in numbers]
    got = _Class(numbers, shares, goals, extra).solve()
    assert [sum(row) for row in got] == numbers and min(map(min, got)) >= 0
    assert cost(got) == pytest.approx(min(map(cost, product(*ways))))


def test_many_bundles_and_a_giant_group():
    bundles = [(5, (("a", i),), 1 + i % 3) for i in range(20_000)] + [(90_000, (("a", 90_000),), 1)]
    shares = [0.7, 0.15, 0.15]
    got = allot(bundles, shares)
    total = sum(s * n for s, _, n in bundles)
    assert [sum(g) for g in got] == [n for _, _, n in bundles]
    assert all(abs(sum(b[0] * g[j] for b, g in zip(bundles, got, strict=True)) - total * p) <= 5 for j, p in enumerate(shares))


def test_splits_keep_groups_and_proportions(spark):
    recs = spark.createDataFrame([(i, "L%d" % (i % 3) if i % 11 else None, "x") for i in range(2000)] + [(None, "L1", "y")], "r long, lab string, split string")
    ties = spark.createDataFrame([(i, i - i % 5) for i in range(500)], "r long, group_id long")
    a = assign_splits(recs, ties, "r", "lab").toPandas()
    assert len(a) == 2000 and a.groupby("group_id")["split"].nunique().max() == 1
    share = a["split"].value_counts(normalize=True)
    assert abs(share["train"] - 0.7) < 0.01 and abs(share["test"] - 0.15) < 0.01
    b = assign_splits(recs, ties, "r", "lab").toPandas()
    assert a.sort_values("r").reset_index(drop=True).equals(b.sort_values("r").reset_index(drop=True))
    rep = {(r["label"], r["split"]): r["share"] for r in split_report(spark.createDataFrame(a), recs, "r", "lab").collect()}
    assert all(abs(rep[lab, "train"] - 0.7) < 0.03 for lab in (None, "L0", "L1", "L2"))


def test_splits_of_nothing_and_bad_shares(spark):
    recs = spark.createDataFrame([], "r long, lab string")
    assert assign_splits(recs, spark.createDataFrame([], "r long, group_id long"), "r", "lab").count() == 0
    with pytest.raises(ValueError):
        assign_splits(recs, recs, "r", "lab", {"a": 0.5, "b": 0.6})
