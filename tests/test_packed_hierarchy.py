import duckdb
from pyspark.sql import functions as F

from vellumark.operators.hierarchy import descendants, provenance_trees, trees
from vellumark.operators.packed import ADDRESS, IDENTIFIER, split_packed, unpack
from vellumark.plans.data_queries import SQL


def values(spark, texts, starts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", split_packed(F.col("t"), starts).alias("v")).orderBy("i").collect()]


def test_ids_in_every_wrapping(spark):
    a, b = "EVID-0000001", "PF-NORTH-000002"
    texts = [f"{a};{b}", f'["{a}", "{b}"]', f'{{"{a}",{b}}}', f"'{a}'; '{b}'", f'"""{a}""; ""{b}"""', f'"{a}; {b}"', f"{a} / {b}", f"{a}\r\n{b}", f"{a}、{b}", f"{a} ;; {b};", f" {a}\t\t{b} "]
    assert values(spark, texts, IDENTIFIER) == [[a, b]] * len(texts)


def test_addresses_keep_punctuation_and_inner_addresses(spark):
    one, two = "https://x.example/p/1;view=plain,folio=3", "https://w.example/web/2001/http://y.example/a?q=b&p=1"
    texts = [f"{one};{two}", f'"{one}";"{two}"', f"{one}, {two}", f"[{one}]", f"{two}|{one}"]
    assert values(spark, texts, ADDRESS) == [[one, two], [one, two], [one, two], [one], [two, one]]


ODD = {
    "https://x.org/o'brien/a": ["https://x.org/o'brien/a"],
    'https://a.org/x"y': ['https://a.org/x"y'],
    "https://x.org/wiki/Foo_(bar); https://b.org/": ["https://x.org/wiki/Foo_(bar)", "https://b.org/"],
    "(https://x.org/Foo_(bar))": ["https://x.org/Foo_(bar)"],
    "(https://a.org/x), (https://b.org/y)": ["https://a.org/x", "https://b.org/y"],
    '["https://a.org/f_(1)", "https://a.org/2"]': ["https://a.org/f_(1)", "https://a.org/2"],
    "see https://a.org/1 (scan), https://b.org/a;v=1,f=2;;": ["https://a.org/1", "https://b.org/a;v=1,f=2"],
    "'https://a.org/o'b', 'https://b.org/'": ["https://a.org/o'b", "https://b.org/"],
    '"[""https://a.org/1"",""https://a.org/2""]"': ["https://a.org/1", "https://a.org/2"],
    "https://a.org/[1]": ["https://a.org/[1]"],
    '"https://a.org/a b";"https://b.org"': ["https://a.org/a b", "https://b.org"],
    'https://a.org/?q="x"': ['https://a.org/?q="x"'],
    "https://a.org/x'": ["https://a.org/x'"],
}


def test_no_character_of_an_address_is_lost(spark):
    assert values(spark, list(ODD), ADDRESS) == list(ODD.values())


def test_the_sql_twin_keeps_them_too():
    con = duckdb.connect()
    con.execute("CREATE TABLE tesla_claims_pilot_v0_1 (claim_id VARCHAR, source_urls VARCHAR)")
    con.execute("CREATE TABLE tesla_phase1b_verdicts_v0_1 (claim_id VARCHAR, decisive_evidence_ids VARCHAR, provenance_family_ids VARCHAR)")
    con.execute("CREATE TABLE tesla_phase1b_search_log_v0_1 (execution_id VARCHAR, evidence_ids VARCHAR)")
    con.executemany("INSERT INTO tesla_claims_pilot_v0_1 VALUES (?, ?)", [(str(i), t) for i, t in enumerate(ODD)])
    rows = con.sql(f"SELECT source_key, list(field_value ORDER BY value_position) FROM ({SQL['p3_found']}) GROUP BY ALL").fetchall()
    assert [v for _, v in sorted(rows, key=lambda r: int(r[0]))] == list(ODD.values())


def test_nothing_in_null_blank_and_delimiters(spark):
    assert values(spark, [None, "", " ", ";", "[]", '""', "n/a; none"], IDENTIFIER) == [[]] * 7


def test_repeated_values_and_long_texts(spark):
    many = ";".join(f"EVID-{i % 7:07d}" for i in range(3000))
    got = values(spark, [many], IDENTIFIER)[0]
    assert len(got) == 3000 and got[:8] == [f"EVID-{i % 7:07d}" for i in range(8)]


def test_unpack_positions_copies_and_extra_columns(spark):
    rows = [("c1", "EVID-1;EVID-1;EVID-2", 1), ("c1", "EVID-1;EVID-1;EVID-2", 2), (None, "EVID-9", 3), ("c2", None, 4)]
    df = spark.createDataFrame(rows, "k string, f string, value_position int")
    got = {tuple(r) for r in unpack(df, "k", "f", "t", IDENTIFIER).collect()}
    assert got == {("t", "c1", "f", 1, "EVID-1"), ("t", "c1", "f", 2, "EVID-1"), ("t", "c1", "f", 3, "EVID-2"), ("t", None, "f", 1, "EVID-9")}
    assert unpack(df.limit(0), "k", "f", "t", IDENTIFIER).count() == 0


def tree_of(spark, nodes, links):
    n = spark.createDataFrame([(x,) for x in nodes], "node string")
    e = spark.createDataFrame(links, "child string, parent string")
    return {r["node"]: (r["root"], r["depth"], r["path"]) for r in trees(n, e).collect()}


def test_chain_branch_and_lone_node(spark):
    got = tree_of(spark, ["a", "z"], [("b", "a"), ("c", "b"), ("d", "b"), ("b", "a")])
    assert got == {"a": ("a", 0, "a"), "b": ("a", 1, "a/b"), "c": ("a", 2, "a/b/c"), "d": ("a", 2, "a/b/d"), "z": ("z", 0, "z")}


def test_loops_self_links_and_nulls(spark):
    got = tree_of(spark, [], [("a", "b"), ("b", "a"), ("c", "b"), ("s", "s"), ("x", None), (None, "y"), ("p", "q")])
    loop = ("", -1, "")
    assert got == {"a": loop, "b": loop, "c": loop, "s": loop, "p": ("q", 1, "q/p"), "q": ("q", 0, "q")}


def test_deep_chain(spark):
    got = tree_of(spark, [], [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(150)])
    assert got["n150"][1] == 150 and got["n150"][2].split("/") == [f"n{i:03d}" for i in range(151)] and len(got) == 151


def test_several_parents_take_the_shallowest(spark):
    got = tree_of(spark, [], [("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "z")])
    assert got["c"] == ("a", 1, "a/c") and got["d"] == ("z", 1, "z/d")


def test_empty_tables(spark):
    assert tree_of(spark, [], []) == {}


def test_provenance_and_descendants(spark):
    ev = spark.createDataFrame([("EVID-1", None, "x"), ("EVID-2", "evid-1 ", "y"), ("EVID-2", "evid-1 ", "y")], "evidence_id string, parent_evidence_id string, node string")
    ed = spark.createDataFrame([("Evid-3\t", " EVID-2"), (None, None)], "child_evidence_id string, parent_evidence_id string")
    t = provenance_trees(ev, ed)
    assert {(r["node"], r["path"]) for r in t.collect()} == {("EVID-1", "EVID-1"), ("EVID-2", "EVID-1/EVID-2"), ("EVID-3", "EVID-1/EVID-2/EVID-3")}
    assert {tuple(r) for r in descendants(t).collect()} == {("EVID-1", "EVID-2", 1), ("EVID-1", "EVID-3", 2), ("EVID-2", "EVID-3", 1)}


def test_hub_is_salted_and_several_parents(spark, monkeypatch):
    import vellumark.operators.hierarchy as h
    import vellumark.tables as t

    monkeypatch.setattr(t, "HOT_ROWS", 5)
    monkeypatch.setattr(h, "SMALL_STEP", 3)
    links = [(f"c{i:03d}", "hub") for i in range(60)] + [("hub", "top"), ("leaf", "c007"), ("leaf", "far"), ("far", "leaf2"), ("leaf2", "top"), ("last", "leaf")]
    got = tree_of(spark, [], links)
    assert got["c031"] == ("top", 2, "top/hub/c031") and len(got) == 66
    assert got["leaf"] == ("top", 3, "top/hub/c007/leaf") and got["last"] == ("top", 4, "top/hub/c007/leaf/last") and got["far"] == ("top", 2, "top/leaf2/far")
