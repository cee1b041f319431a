"""Scans of files: typed CSV, JSON, archives, token files, stand-off annotations, SQLite, NumPy matrices, pages and digests.

Archive and binary scans read whole files as (path, content) rows, so files are spread over the executors, and members are
streamed out one by one.
"""

from __future__ import annotations

import csv
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumark.operators.validation import broken

def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV file with header as trimmed texts ('' where missing) and `line`, the number of the record's line block from 2.

    A byte order mark is dropped; columns the file lacks come out as ''; others of the file are ignored. Quoted line breaks stay in
    their value.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿").strip().strip('"'): c for c in raw.columns}
    rows = raw.select(*(F.coalesce(F.trim(F.col(f"`{names[c]}`")), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in columns), F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_o"))
    return rows.withColumn("line", F.row_number().over(Window.partitionBy("_f").orderBy("_o")) + 1).drop("_f", "_o")


def csv_errors(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(line, key, error): every broken rule of every line; a key that an earlier line has is 'duplicate_key'."""
    again = F.when(F.row_number().over(Window.partitionBy(key).orderBy("line")) > 1, F.lit("duplicate_key"))
    named = rows.withColumn("_dup", again).withColumn("_e", broken(rules))
    return named.select("line", key, F.explode(F.array_compact(F.concat("_e", F.array("_dup")))).alias("error"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON lines under a stated schema; a line that isn't JSON comes out with _corrupt_record."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON array (or one object)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _explode_files(files: DataFrame, schema: str, read: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """One row per tuple that `read` yields from a file's content, with the file's path first."""
    types = T.StructType.fromDDL("path string, " + schema)

    def run(batches):
        arrow = [pa.string() if f.dataType == T.StringType() else pa.int64() if f.dataType == T.LongType() else pa.binary() if f.dataType == T.BinaryType() else pa.list_(pa.float64()) if isinstance(f.dataType, T.ArrayType) else pa.float64() for f in types.fields]
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for row in read(content):
                    held.append((p, *row))
                    if len(held) >= 2_000:
                        yield _batch(held, arrow, types)
                        held = []
                if held:
                    yield _batch(held, arrow, types)

    return files.mapInArrow(run, types)


def _batch(rows: list[tuple], arrow: list, types: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=types.names)


def read_zip_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, member, line, text): lines of the ZIP members whose name matches the pattern, in the order of their names; blank lines are left out."""

    def read(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if re.fullmatch(member, n)):
                with z.open(name) as f:
                    for i, line in enumerate(io.TextIOWrapper(f, "utf-8"), 1):
                        if line.strip():
                            yield name, i, line.rstrip("\r\n")

    return _explode_files(_files(spark, path), "member string, line long, text string", read)


def read_zip_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, member, line, row): records of the ZIP's CSV members as JSON objects of their header's names."""

    def read(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in sorted(n for n in z.namelist() if re.fullmatch(member, n)):
                with z.open(name) as f:
                    for i, r in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline="")), 2):
                        yield name, i, json.dumps(r, ensure_ascii=False)

    return _explode_files(_files(spark, path), "member string, line long, row string", read)


def read_tar(spark: SparkSession, path: str, members: list[str], most_bytes: int = 64 << 20) -> DataFrame:
    """(path, member, content): the listed members of TAR files, packed or not; one that is larger than allowed is an error, links are passed over."""

    def read(content: bytes):
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for m in t:
                if m.isfile() and m.name.removeprefix("./") in members:
                    if m.size > most_bytes:
                        raise ValueError(f"{m.name} has {m.size} bytes, more than {most_bytes}")
                    yield m.name.removeprefix("./"), t.extractfile(m).read()

    return _explode_files(_files(spark, path), "member string, content binary", read)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, position, token, tag): 'token ... tag' lines, sentences parted by blank lines."""

    def read(content: bytes):
        sentence = position = 0
        for line in content.decode("utf-8").splitlines():
            parts = line.split()
            if not parts:
                sentence, position = sentence + (position > 0), 0
            else:
                yield sentence, position, parts[0], parts[-1]
                position += 1

    return _explode_files(_files(spark, path), "sentence long, position long, token string, tag string", read)


def read_standoff(annotations: DataFrame) -> DataFrame:
    """(key, id, kind, start, end, text, fits): spans of 'T1<TAB>Kind start end<TAB>text' lines; fits: the document has that text there.

    annotations: (key, ann, document); lines of other kinds are passed over.
    """
    lines = annotations.select("key", "document", F.explode(F.split(F.coalesce("ann", F.lit("")), "\n")).alias("l")).where(r"l rlike '^T[0-9]+\t[^ \t]+ [0-9]+ [0-9]+\t'")
    part = lambda i: F.regexp_extract("l", r"^(T[0-9]+)\t([^ \t]+) ([0-9]+) ([0-9]+)\t(.*)$", i)
    s = lines.select("key", "document", part(1).alias("id"), part(2).alias("kind"), part(3).cast("int").alias("start"), part(4).cast("int").alias("end"), part(5).alias("text"))
    return s.select("key", "id", "kind", "start", "end", "text", (F.substring("document", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text")).alias("fits"))


def read_sqlite(spark: SparkSession, path: str, table: str, columns: dict[str, str]) -> DataFrame:
    """Rows of one table of SQLite files, opened read-only from a copy of their content; columns: name to string, long or double."""

    def read(content: bytes):
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.deserialize(content)
        try:
            quoted = lambda n: '"' + n.replace('"', '""') + '"'
            yield from con.execute(f"SELECT {', '.join(map(quoted, columns))} FROM {quoted(table)}")
        finally:
            con.close()

    return _explode_files(_files(spark, path), ", ".join(f"{n} {t}" for n, t in columns.items()), read)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vector): rows of two-dimensional .npy files; objects are refused."""

    def read(content: bytes):
        import numpy as np

        m = np.load(io.BytesIO(content), allow_pickle=False)
        for i, v in enumerate(m.reshape(len(m), -1).astype(float)):
            yield i, v.tolist()

    return _explode_files(_files(spark, path), "row long, vector array<double>", read)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class _Visible(HTMLParser):
    HIDDEN = ("script", "style", "noscript", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible(html: str) -> str:
    """Text of a page without scripts, styles and templates, with single blanks."""
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


def with_visible_text(df: DataFrame, html: str, name: str = "visible_text") -> DataFrame:
    """df with the visible text of an HTML column; null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(html)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else visible(t) for t in texts], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)
