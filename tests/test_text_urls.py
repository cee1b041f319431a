from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.functions import urls as U


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_normal_forms(spark):
    assert one(spark, "  Die  STRASSE Straße\n", X.normal_claim) == "die strasse strasse"
    assert one(spark, "a_B-c", X.word_form) == "a b c"
    assert one(spark, None, X.normal_claim) == ""
    assert one(spark, "Foo_-LRB-x-RRB-", X.page_key) == "foo (x)"


def test_tokens_are_unicode(spark):
    assert one(spark, "Über ß, naïve ½", X.tokens) == ["über", "ss", "naïve", "½"]


def test_multilingual_tokens(spark):
    assert one(spark, "BM25 東京都 x、京", X.multilingual_tokens) == ["w_bm25", "w_x", "c1_東", "c1_京", "c1_都", "c1_京", "c2_東京", "c2_京都"]
    assert one(spark, "", X.multilingual_tokens) == []


def test_claim_query(spark):
    assert one(spark, "The crane of the crane is big", X.claim_query) == '"crane" OR "big"'


def test_numbers(spark):
    assert one(spark, "a 1.5 -3 [12] x9 7% 1990.", X.numbers) == sorted(["1.5", "-3", "7", "1990"])
    assert one(spark, "1. first\n2) second 3", X.without_list_markers) == "first\nsecond 3"


def test_numeric_provenance_and_quotes(spark):
    df = spark.createDataFrame([("has 5 and 6 and 7", "claim 6", "evidence 5")], "x string, c string, e string")
    r = df.select(X.numeric_provenance(F.col("x"), F.col("c"), F.col("e")).alias("r")).first()["r"]
    assert (r["in_evidence"], r["claim_only"], r["absent"]) == (["5"], ["6"], ["7"])
    df = spark.createDataFrame([('he said "Big  Crane" and “old mill” and "none"', "the old mill", "a big crane")], "x string, c string, e string")
    r = df.select(X.quote_check(F.col("x"), F.col("c"), F.col("e")).alias("r")).first()["r"]
    assert tuple(r) == (1, 1, 1)


def test_parse_answer(spark):
    df = spark.createDataFrame([("Supported | because [W1] and [W9]", ["W1"]), ("Maybe", ["W1"]), (None, None)], "a string, k array<string>")
    got = [r["p"] for r in df.select(X.parse_answer(F.col("a"), F.col("k"), ["Supported"]).alias("p")).collect()]
    assert got[0]["label"] == "Supported" and got[0]["reasons"] == ["unknown_citation_id"]
    assert got[1]["reasons"] == ["invalid_answer_format", "missing_citation"] == got[2]["reasons"]


def test_sentences_and_dates(spark):
    assert one(spark, "One. Two!\n\nThree", X.sentences) == ["One.", "Two!", "Three"]
    assert [tuple(r) for r in one(spark, "0\tA b\n1\t \nx\tc\n2\tD\tlink", X.page_sentences)] == [(0, "A b"), (2, "D")]
    assert tuple(one(spark, "1949-02", X.partial_date)) == (1949, 2, None)
    assert tuple(one(spark, "1949-13", X.partial_date)) == (None, None, None)


def test_normal_url(spark):
    assert one(spark, "HTTPS://Example.COM/a/#fragment", U.normal_url) == "https://example.com/a"
    assert one(spark, "http://X.org//a//b?q=1", U.normal_url) == "http://x.org/a/b?q=1"
    assert one(spark, "Foo/", U.normal_url) == "foo"


def test_source_url(spark):
    u = "https://web.archive.org/web/20010203040506/http://www.X.org:80/a/?b=2&utm_source=z&a=1#f"
    assert one(spark, u, U.source_url) == "x.org/a?a=1&b=2"
    assert one(spark, u, U.source_family) == "x.org"
    assert str(one(spark, u, U.archive_date)) == "2001-02-03"
    assert one(spark, "x.org", U.source_url) == "x.org/"
    assert one(spark, None, U.source_url) == "" and one(spark, "https://a.b/web/20011399/x", U.archive_date) is None


def test_safe_url(spark):
    assert one(spark, "https://a.org:443/x?y", U.safe_url)
    for bad in ["http://a.org", "https://u@a.org", "https://a.org:80/", "https://a.org/#f", "https://a.org/ b", "https:///x", ""]:
        assert not one(spark, bad, U.safe_url)
