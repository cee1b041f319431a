import math

from pyspark.sql import functions as F

from vellumark.operators import grouping as G
from vellumark.operators import retrieval as R


def search(spark, docs, query, k=3):
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    q = spark.createDataFrame([(0, query)], "q int, t string")
    return [(r["doc"], r["score"]) for r in R.Postings(d, "id", "text").search(q, "q", "t", k).orderBy("rank").collect()]


def test_bm25_hand_value_and_ties(spark):
    got = search(spark, ["bridge opened", "bridge opened", ""], "bridge Bridge", 1)
    mean = 4 / 3
    want = math.log(1 + (3 - 2 + 0.5) / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean))
    assert got[0][0] == 0 and abs(got[0][1] - want) < 1e-8


def test_fielded_and_indexed_search_shuffle_no_scored_pairs(spark, tmp_path):
    """Against brute force; what reaches the ranking is each task's k best, not all pairs of documents and queries."""
    import random
    from collections import Counter

    from vellumark.sources.sinks import write_index

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 3))), " ".join(rng.choices("abcdefghij", [9, 9, 5, 3, 1, 1, 1, 1, 1, 1], k=rng.randrange(0, 12))) or None) for i in range(60)]
    d = spark.createDataFrame(rows, "d int, title string, body string")
    q = spark.createDataFrame([(i, f"{t} {b or ''}") for i, t, b in rows if i % 7 == 0] + [(None, "a")], "q int, t string")
    tf = {i: Counter({w: 3 * t.split().count(w) + (b or "").split().count(w) for w in "abcdefghij"}) for i, t, b in rows}
    size = {i: len(t.split()) + len((b or "").split()) for i, t, b in rows}
    mean, df = sum(size.values()) / 60, Counter(w for c in tf.values() for w, n in c.items() if n)
    want = []
    for i, t, b in rows[::7]:
        score = {j: round(sum(math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[j] / mean)) for w in {*t.split(), *(b or "").split()}), 7) for j, c in tf.items()}
        want += [(i, j, s, r) for r, (j, s) in enumerate(sorted(((j, s) for j, s in score.items() if s), key=lambda x: (-x[1], x[0]))[:4], 1)]
    write_index(d, "d", {"title": "title", "body": "body"}, f"{tmp_path}/i", 4)
    for got in (R.fielded_search(d, "d", {"title": 3, "body": 1}, {"title": F.col("title"), "body": F.col("body")}, q, "q", "t", 4), R.search_index(spark, f"{tmp_path}/i", q, "q", "t", {"title": 3, "body": 1}, 4)):
        assert sorted((r["query"], r["doc"], round(r["score"], 7), r["rank"]) for r in got.collect()) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan


def test_bm25_never_returns_zero_scores(spark):
    assert search(spark, ["a b", None, "c"], "zzz") == [] and search(spark, [], "a") == [] and search(spark, ["a"], None) == []


def test_sentence_selection_and_fallback(spark):
    df = spark.createDataFrame([(1, "crane at Orla", ["The mill.", "A crane stood at Orla.", "Crane."]), (2, "nothing", ["One.", "Two.", "Three."])], "k int, q string, s array<string>")
    got = [tuple(r)[:2] + (r["rank"],) for r in R.select_sentences(df, "q", "s", ["k"], 2).orderBy("k", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2)]


def test_rerank_keeps_order_without_overlap(spark):
    df = spark.createDataFrame([(1, "zzz", 10 + i, i, ["a b", "c"]) for i in range(4)] + [(2, "far crane", 20, 0, ["near"]), (2, "far crane", 21, 1, ["a crane"]), (2, "far crane", 22, 2, None)], "k int, q string, o int, pos int, s array<string>")
    got = R.rerank(df, "q", ["k"], "o", "s", "pos", 3).orderBy("k", "rank").collect()
    assert [r["o"] for r in got] == [10, 11, 12, 21, 20, 22]


def test_dense_search(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [-1.0, 0.0]), (4, [0.9, 0.1]), (5, None), (6, [0.0, 0.0])], "id long, v array<float>")
    q = d.where("id = 1").select(F.col("id").alias("q"), "v")
    assert [r["doc"] for r in R.dense_search(d, "id", "v", q, "q", "v", 5).orderBy("rank").collect()] == [2, 4]
    assert R.dense_search(d.limit(0), "id", "v", q, "q", "v", 5).count() == 0


def test_spans_runs_and_neighbours(spark):
    toks = spark.createDataFrame([(1, i, t, p, g) for i, (t, p, g) in enumerate([("Fen", 0.9, "B-X"), ("Holt", 0.8, "I-X"), ("of", 0.1, "O"), ("Orla", 0.85, "B-X"), ("Bay", 0.85, "B-X")])], "k int, i int, t string, p double, g string")
    assert [(r["start"], r["end"], r["run"]) for r in R.capital_runs(toks, ["k"], "i", "t").orderBy("start").collect()] == [(0, 2, "Fen Holt"), (3, 5, "Orla Bay")]
    assert [tuple(r) for r in R.best_span(toks, ["k"], "i", "p", 0.5).collect()] == [(1, 0, 2, 0.85)]
    assert [(r["start"], r["end"]) for r in G.spans_of_tags(toks, ["k"], "i", "g").orderBy("start").collect()] == [(0, 2), (3, 4), (4, 5)]
    n = R.neighbours(toks, ["k"], "i", "t").orderBy("i").first()
    assert (n["before_1"], n["after_1"], n["after_2"]) == ("<BOUNDARY>", "Holt", "of")


def test_linked_groups(spark):
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}" if i < 30 else None) for i in range(40)] + [(90, "", None), (91, None, "")]
    got = {r["r"]: r["group"] for r in G.linked_groups(spark.createDataFrame(rows, "r int, a string, b string"), "r", [F.col("a"), F.col("b")]).collect()}
    want = {i: 0 for i in range(30)} | {30: 30, 31: 30, 32: 32, 33: 32, 34: 34, 35: 34, 36: 36, 37: 36, 38: 38, 39: 38, 90: 90, 91: 91}
    assert got == want


def test_collapse_context_is_a_sequential_pass(spark):
    df = spark.createDataFrame([([("a", "x"), ("b", "x"), ("b", "y"), ("a", "z")],), ([],)], "e array<struct<id:string,text:string>>")
    got = [[tuple(x) for x in r["k"]] for r in df.select(G.collapse_context(F.col("e"), "id", "text").alias("k")).collect()]
    assert got == [[("a", "x"), ("b", "y")], []]


def test_near_duplicates_against_brute_force(spark):
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:29], "x"]), " ".join([*base[:15], "y", *base[16:]]), "one two", None, "", " ".join(reversed(base)), " ".join([*base[:28], "x", "z"])]
    grams = lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(len((t or "").split()) - 4)}
    df = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    got = {r["d"]: (r["class_id"], r["n_links"]) for r in G.near_duplicates(df, "d", "t").collect()}
    reps = {}
    for i, t in enumerate(texts):
        if grams(t):
            reps.setdefault(frozenset(grams(t)), i)
    pairs = [(i, j) for a, i in reps.items() for b, j in reps.items() if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    assert {d: n for d, (_, n) in got.items()} == {d: sum(reps[frozenset(grams(t))] in p for p in pairs) if grams(t) else 0 for d, t in enumerate(texts)}
    assert got[0][0] == got[1][0] == got[2][0] == 0 and got[3] == (3, 0) and got[4] == (4, 0) and G.near_duplicates(df.limit(0), "d", "t").count() == 0
