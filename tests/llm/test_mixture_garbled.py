import random

from vellumark.llm.garbled import Garbled, chains
from vellumark.llm.mixture import Mixture, budgets, share_out, weighted, with_tokens


def test_share_out():
    assert share_out(100, [(1, 1000), (3, 1000)]) == [25, 75]
    assert share_out(100, [(1, 10), (1, 1000), (2, 1000)]) == [10, 30, 60]
    assert share_out(100, [(1, 10), (0, 50), (1, 20)]) == [10, 50, 20]
    assert share_out(5, []) == []


def test_shortage_goes_to_siblings_first():
    tree = {"a": (0.5, {"en": (1, 10), "de": (1, 100)}), "b": (0.5, {"en": (1, 1000)})}
    assert budgets(tree, 100) == {("a", "en"): 10, ("a", "de"): 40, ("b", "en"): 50}
    tree["a"][1]["de"] = (1, 20)
    assert budgets(tree, 100) == {("a", "en"): 10, ("a", "de"): 20, ("b", "en"): 70}


def test_three_levels_and_their_weights():
    tree = weighted({"web": {"en": {"a": (0.3, 1000.0), "b": (0.1, 5.0)}, "de": {"a": (0.1, 1000.0)}}, "scan": {"en": {"c": (0.5, 20.0)}}})
    assert tree["web"][0] == 0.5 and tree["web"][1]["en"][0] == 0.4
    got = budgets(tree, 100)
    # b lacks 5 and a in English, its sibling, takes them; c lacks 30 and the other domain takes them
    assert got == {("web", "en", "a"): 59, ("web", "en", "b"): 5, ("web", "de", "a"): 16, ("scan", "en", "c"): 20}
    assert sum(budgets(tree, 1e9).values()) == 2025


def test_shortage_keeps_caps_and_sums(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["stone", "mill", "river"]) for _ in range(rng.randrange(5, 40))), ["a", "a", "a", "b", "c"][i % 5], ["en", "de"][i % 2], None) for i in range(3000)]
    t = [("m", "a", 0.2, 2), ("m", "b", 0.4, 2), ("m", "c", 0.4, 3)]
    m = Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(t, TARGETS), fill=0.9, domains={"a": "x", "b": "x", "c": "y"})
    drawn = m.drawn().toPandas()
    size = drawn.n_tokens * drawn.repeats
    supply = {r["source"]: r["t"] for r in m.sized.groupBy("source").sum("n_tokens").toDF("source", "t").collect()}
    assert abs(size.sum() / (0.9 * (2 * supply["a"] + 2 * supply["b"] + 3 * supply["c"])) - 1) < 0.01
    assert drawn.groupby("source").repeats.max().to_dict() == {"a": 2, "b": 2, "c": 3} and drawn.loc[drawn.source == "b", "repeats"].min() == 2
    assert not drawn.duplicated("doc_id").any()


DOCS, TARGETS = "doc_id long, text string, source string, lang string, mixture_id string", "mixture_id string, source string, target_share double, max_repeats int"


def test_mixture_reaches_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["stone", "mill", "river", "quiet"]) for _ in range(rng.randrange(5, 60))), "big" if i % 10 else "small", ["en", "EN", "de", None][i % 4], "x") for i in range(2000)]
    docs += [(9001, None, "big", "en", "x"), (9002, "", "big", "en", "x"), (9003, "text", None, None, "x"), (9004, "text", "unwanted", "en", "x")]
    t = [("m", "big", 0.6, 2), ("m", "small", 0.4, 3), ("n", "small", 1.0, 1), ("n", "absent", 0.0, 1)]
    m = Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(t, TARGETS))
    s = {(r["mixture_id"], r["source"]): r for r in m.shares().collect()}
    assert abs(s["m", "big"]["actual_share"] - 0.6) < 0.01 and s["m", "small"]["most_repeats"] == 3 and s["n", "absent"]["n_tokens"] == 0
    drawn = m.drawn().toPandas()
    assert drawn.duplicated(["mixture_id", "doc_id"]).sum() == 0 and drawn.loc[drawn.source == "big", "repeats"].max() <= 2 and not drawn.doc_id.isin([9001, 9002, 9003, 9004]).any()
    over = Mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(t[:2], TARGETS), total_tokens=1e9)
    assert over.drawn().where("repeats <> case source when 'big' then 2 else 3 end").count() == 0


def test_mixture_of_nothing(spark):
    docs, t = spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    assert Mixture(docs, t).drawn().count() == 0 and Mixture(docs, t).shares().count() == 1
    assert Mixture(docs, t.limit(0)).shares().count() == 0


def test_tokens_are_counted_whole(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 30_000)], "i long, text string")
    n = {r["i"]: r["n_tokens"] for r in with_tokens(df, "text").collect()}
    assert n[1] == 3 and n[2] == 0 and n[3] >= 30_000


CLEAN = ["Das Café in München öffnet früh, größere Gäste kommen später für Bücher.", "La señora explicó que el catálogo quedó aquí según la versión pequeña.", "Le témoin répéta qu'il n'avait jamais été interrogé à l'époque où tout était fermé.", "Позже архивариус написал, что рассказ сильно преувеличен и не подтверждён.", "He said “quite so” — it’s £40 at 20 °C."]


def corpus():
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice(CLEAN) for _ in range(3)), f"s{i % 3}") for i in range(300)]
    bad = {}
    for i, (true, read, times) in enumerate([("utf8", "cp1252", 1), ("utf8", "mac_roman", 1), ("utf8", "cp1251", 1), ("utf8", "cp437", 1), ("utf8", "latin-1", 1), ("utf8", "latin-1", 2)] * 3):
        t = CLEAN[i % 3] if read == "cp1251" else CLEAN[i % 4 if read != "cp437" else 0]
        for _ in range(times):
            t = t.encode(true).decode(read, "strict" if read != "cp1252" else "ignore")
        bad[1000 + i] = t
    return docs, bad


def test_garbled_are_found_and_clean_are_not(spark):
    docs, bad = corpus()
    extra = [(5000, None, "s0"), (5001, "", None), (5002, "plain text", None), (5003, "INFORMAÇÃO: A MANHÃ NÃO CONSTA", "s1"), (5004, "Ångskär, Łazvik and Žorvan", "s1"), (5005, "lost � here", "s2")]
    rows = docs + [(i, t, "s%d" % (i % 3)) for i, t in bad.items()] + extra * 1
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    g = Garbled(df, "doc_id", ["text"], "source")
    found = {r["doc_id"] for r in g.found().collect()}
    assert found == set(bad) | {5005}
    restored = {r["doc_id"]: r["restored"] for r in g.repaired().collect()}
    assert sum(restored[i] in CLEAN for i in bad) >= len(bad) - 4


def test_chains_are_undone_exactly():
    undo = chains()
    for text in CLEAN[:3]:
        assert undo["utf8>mac_roman"](text.encode().decode("mac_roman")) == text
        assert undo["utf8>cp1252"](text.encode().decode("latin-1")) == text
        once = text.encode().decode("latin-1")
        assert undo["utf8>cp1252 twice"](once.encode().decode("latin-1")) == text
    assert undo["cp1251>cp1252"]("Äåëî") == "Дело"


def test_garbled_of_nothing(spark):
    g = Garbled(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", ["text"], "source")
    assert g.found().count() == 0 and g.repaired().count() == 0


def test_a_single_byte_text_is_found_however_often_it_is_copied(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(CLEAN) for _ in range(3)), f"s{i % 3}") for i in range(300)]
    once = "Позже архивариус подтвердил, что рассказ не преувеличен и написан сильно.".encode("cp1251").decode("cp1252")
    copied = [(2000 + i, once, f"s{i % 3}") for i in range(150)]  # a third of all rows
    found = {r["doc_id"] for r in Garbled(spark.createDataFrame(docs + copied, "doc_id long, text string, source string"), "doc_id", ["text"], "source").found().collect()}
    assert found == {r[0] for r in copied}
