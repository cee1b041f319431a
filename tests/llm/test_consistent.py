import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumark.llm.consistent import CYRILLIC_LIKE, GREEK_LIKE, LATIN_OF_CYRILLIC, LATIN_OF_GREEK, connect, normalise_batch, slices, with_consistent


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["t_consistent"] for r in with_consistent(df, ["t"]).orderBy("i").collect()]


def test_each_kind_of_disguise(spark):
    pairs = [
        ("Ｆｕｌｌ－ｗｉｄｔｈ　１２３．", "Full-width 123."), ("café über", "café über"), ("zero​width⁠﻿ so­ft", "zerowidth soft"), ("a b c d　e", "a b c d e"),
        ("ﬁrst ﬂoor laﬆ", "first floor last"), ("thе obѕеrvаtоrу", "the observatory"), ("Τhe νerdict οf Νο", "The verdict of No"), ("гoдa и зa лиcтoв", "года и за листов"), ("𝐁𝐨𝐥𝐝 𝟙𝟚", "Bold 12"), ("٣ ५", "3 5"),
    ]
    assert forms(spark, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_what_stays(spark):
    texts = ["folder архив-27 says", "В газете Orchard Ledger", "Straße, naïve — “quoted” … №5 ½ x²", "two  blanks\tand\nlines", "CASE Kept", "日本語 テキスト", "λόγος in Greek", "", "Corox и Pepo"]
    assert forms(spark, texts) == texts


def test_genuine_words_of_other_scripts_stay(spark):
    texts = ["και το νυν", "H γέφυρα και ο ποταμός του νομού", "he wrote «хор и рак» in a letter", "the rate α", "the letter о is round", "ЗА ОКТЯБРЯ KETETH OSTROMBE УТВЕРЖДАЕТ ЧТО"]
    assert forms(spark, texts) == texts


def test_neighbours_show_a_disguised_word(spark):
    pairs = [("Νο νerdict", "No verdict"), ("Νο other passage", "No other passage"), ("ΕΙΝΕ VΟRLÄUFIGΕ PRÜFUNG", "EINE VORLÄUFIGE PRÜFUNG"), ("В ГАЗЕТЕ ЗА ГОДА ПPОBЕPКА HE", "В ГАЗЕТЕ ЗА ГОДА ПРОВЕРКА HE"), ("κaι το νυν γέφυρα", "και το νυν γέφυρα")]
    assert forms(spark, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_joiners_stay_where_they_are_needed(spark):
    same = ["می\u200cخواهم", "क्\u200dष", "👨\u200d👩\u200d👧 ❤\ufe0f"]
    assert forms(spark, [*same, "z\u200cero wi\u200ddth a\ufe0fb"]) == [*same, "zero width ab"]


def test_wide_batches_are_taken_in_slices():
    texts = pa.array(["x" * 5, None, "", "y" * 9, "z" * 3, "z" * 3])
    assert list(slices(texts, 6)) == [(0, 3), (3, 1), (4, 2)]
    assert list(slices(pa.array([], pa.string()), 6)) == []
    con, many = connect(), [f"plain é word {i} " * 12_000 for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.replace("é", "e\u0301") for t in many])], names=["t"])
    assert normalise_batch(con, batch, ["t"], "_n").column(1).to_pylist() == many


def test_null_long_and_repeated(spark):
    long = "а wоrd " * 50_000
    assert forms(spark, [None, long, None, "x"]) == [None, "a word " * 50_000, None, "x"]


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([("ｘ", None, [1, None])], "t string, batch string, n array<int>")
    row = with_consistent(df, ["t"], "_n").first()
    assert row.asDict() == {"t": "ｘ", "batch": None, "n": [1, None], "t_n": "x"}
    assert with_consistent(df.limit(0), ["t"]).count() == 0
    with pytest.raises(ValueError):
        with_consistent(df.withColumn("t_consistent", F.lit("")), ["t"])


def test_against_brute_force(spark):
    """Disguising plain English words by rule and undoing it is an exact round trip."""
    plain = "the weir at Ostelholm supplied households during every season of drought".split()
    to_cyrillic = {b: a for a, b in reversed(list(zip(CYRILLIC_LIKE, LATIN_OF_CYRILLIC, strict=True)))}
    to_greek = {b: a for a, b in reversed(list(zip(GREEK_LIKE, LATIN_OF_GREEK, strict=True)))}
    disguises = [lambda w: w.translate(str.maketrans(to_cyrillic)), lambda w: w.translate(str.maketrans(to_greek)), lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w), lambda w: "‌".join(w), lambda w: unicodedata.normalize("NFD", w)]
    texts = [" ".join(disguises[(i + j) % 5](w) if (i + j) % 2 else w for j, w in enumerate(plain)) for i in range(20)]
    assert set(forms(spark, texts)) == {" ".join(plain)}
    assert all(re.search(r"[^\x00-\x7f]", t) for t in texts)
