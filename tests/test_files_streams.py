import gzip
import io
import json
import sqlite3
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumark.operators import retrieval as R
from vellumark.sources import files, sinks
from vellumark.streaming import flows


def test_csv_with_mark_and_errors(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿id,text,extra\na, first ,x\nb,\"two\nlines\",y\na,,z\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "c.csv"), ["id", "text", "missing"])
    assert [(r["id"], r["text"], r["missing"], r["line"]) for r in rows.orderBy("line").collect()] == [("a", "first", "", 2), ("b", "two\nlines", "", 3), ("a", "", "", 4)]
    errors = files.csv_errors(rows, "id", {"text": F.col("text") != ""})
    assert sorted((r["line"], r["error"]) for r in errors.collect()) == [(4, "duplicate_key"), (4, "text")]


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1}\nnot json\n{"i": 2}\n')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "i int").cache()
    assert [r["i"] for r in got.orderBy("i").collect()] == [None, 1, 2] and got.where("_corrupt_record is not null").count() == 1
    (tmp_path / "b.json").write_text(json.dumps([{"i": 5}, {"i": None}]))
    assert files.read_json_array(spark, str(tmp_path / "b.json"), "i int").count() == 2


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("pages/p-002.jsonl", "c\n")
        z.writestr("pages/p-001.jsonl", "a\n\nb\r\n")
        z.writestr("noise.txt", "no")
        z.writestr("t.csv", "﻿x,y\n1,é\n")
    lines = files.read_zip_lines(spark, str(tmp_path / "w.zip"), r"pages/p-\d+\.jsonl")
    assert [(r["member"], r["line"], r["text"]) for r in lines.collect()] == [("pages/p-001.jsonl", 1, "a"), ("pages/p-001.jsonl", 3, "b"), ("pages/p-002.jsonl", 1, "c")]
    assert json.loads(files.read_zip_csv(spark, str(tmp_path / "w.zip"), r".*\.csv").first()["row"]) == {"x": "1", "y": "é"}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for name, data in (("./in.txt", b"abc"), ("out.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "x.tar.gz").write_bytes(gzip.compress(raw.getvalue()))
    assert [(r["member"], bytes(r["content"])) for r in files.read_tar(spark, str(tmp_path / "x.tar.gz"), ["in.txt"]).collect()] == [("in.txt", b"abc")]
    with pytest.raises(Exception, match="bytes"):
        files.read_tar(spark, str(tmp_path / "x.tar.gz"), ["in.txt"], most_bytes=2).collect()


def test_token_files_and_standoff(spark, tmp_path):
    (tmp_path / "t.bio").write_text("Fen B-X\nHolt I-X\n\n\nruns O\n")
    assert [(r["sentence"], r["position"], r["token"], r["tag"]) for r in files.read_token_file(spark, str(tmp_path / "t.bio")).collect()] == [(0, 0, "Fen", "B-X"), (0, 1, "Holt", "I-X"), (1, 0, "runs", "O")]
    df = spark.createDataFrame([("k", "T1\tCue 4 7\tsat\nE1\tCue:T1\nT2\tCue 0 3\tdog", "cat sat"), ("n", None, "x")], "key string, ann string, document string")
    assert [(r["id"], r["fits"]) for r in files.read_standoff(df).orderBy("id").collect()] == [("T1", True), ("T2", False)]


def test_sqlite_matrix_and_digests(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "d.sqlite")
    con.execute("create table pairs (key text, n integer)")
    con.executemany("insert into pairs values (?, ?)", [("a", 1), ("b", None)])
    con.commit()
    con.close()
    assert [(r["key"], r["n"]) for r in files.read_sqlite(spark, str(tmp_path / "d.sqlite"), "pairs", {"key": "string", "n": "long"}).collect()] == [("a", 1), ("b", None)]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    assert [r["vector"] for r in files.read_matrix(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f").write_bytes(b"abc")
    assert files.file_digests(spark, str(tmp_path / "sub")).first()["sha256"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_visible_text(spark):
    html = "<p>A &amp; b</p><script>x</script><STYLE>y</STYLE><div>c<template>t</template> d<br>e"
    got = files.with_visible_text(spark.createDataFrame([(1, html), (2, None), (3, "")], "i int, h string"), "h").orderBy("i").collect()
    assert [r["visible_text"] for r in got] == ["A & b c d e", None, ""]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "red crane"), (2, "crane")], "d int, t string")
    sinks.write_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    with pytest.raises(Exception):
        sinks.write_lines(df, str(tmp_path / "l"))
    sinks.write_index(df, "d", {"text": "t"}, str(tmp_path / "i"), 4)
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).where("token = 'crane'").count() == 2 and spark.read.parquet(str(tmp_path / "i" / "figures")).first()["n"] == 2
    hits = R.search_index(spark, str(tmp_path / "i"), spark.createDataFrame([("q", "Red crane"), ("r", "blue"), (None, "red")], "q string, t string"), "q", "t", {"text": 1.0}, 5)
    same = R.fielded_search(df, "d", {"text": 1.0}, {"text": F.col("t")}, spark.createDataFrame([("q", "Red crane")], "q string, t string"), "q", "t", 5)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, same.collect())) and hits.count() == 2
    calls = []

    def compute(need):
        calls.append(sorted(r["k"] for r in need.collect()))
        return need.select("k", F.upper("k").alias("v"))

    for keys in (["a", "b", "a", None], ["b", "c"]):
        got = sinks.fill_cache(spark.createDataFrame([(k,) for k in keys], "k string"), "k", str(tmp_path / "cache"), compute)
        assert all(r["v"] == (r["k"] and r["k"].upper()) for r in got.collect()) and got.count() == len(keys)
    assert calls == [["a", "b"], ["c"]]


def test_streams(spark, tmp_path):
    rows = [(i % 5, f"2031-01-01 0{i % 3}:10:00", "a" if i % 2 else "b", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.run_to_end(flows.event_counts(stream()), str(tmp_path / "a"), "complete")
    want = df.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    once = flows.run_to_end(flows.without_replays(stream(), "event_id", "ts", "10 hours"), str(tmp_path / "b"))
    assert sorted(r["event_id"] for r in once.collect()) == [0, 1, 2, 3, 4]
    write = flows.upsert_into(str(tmp_path / "u"), "event_id")
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5


def test_stream_of_claims(spark, tmp_path):
    spark.createDataFrame([("c1", "the crane"), ("c2", None)], "claim_id string, claim_text string").write.parquet(str(tmp_path / "claims"))
    weights = spark.createDataFrame([("crane", 7, 1.5), ("mill", 8, 1.0)], "token string, doc int, weight double")
    stream = spark.readStream.schema("claim_id string, claim_text string").parquet(str(tmp_path / "claims"))
    assert [tuple(r) for r in flows.run_to_end(flows.score_claims(stream, weights), str(tmp_path / "o")).collect()] == [("c1", 7, 1.5)]
