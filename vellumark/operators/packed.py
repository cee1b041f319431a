"""Several values packed in one field: one value per row, with its position.

Method: the field is split on its quote characters. Odd pieces (inside quotes) are literals, even pieces are cut at
delimiters; a fold over all fragments then puts values together again and a posexplode numbers them. Everything runs as
built-in array expressions; the only shuffle drops copies of a row.

No character of a value is lost: a quote is one only at a value's edge and only with its partner, and a bracket is taken off
only where its partner stands on the other side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that separate values, brackets that wrap them, and how a value begins.
DELIMITERS = ";,|、；\\s"
BRACKETS = ["[]", "{}", "()"]
ADDRESS = "https?://"
IDENTIFIER = "(?:EVID|PF)-"
OPENS, CLOSES = "\\[{(", "\\]})"
#: Stands for the quotes that were recognised.
QUOTE = "\x01"


def _bare(c: Column) -> Column:
    """Without delimiters at both ends."""
    return F.regexp_replace(c, rf"^[{DELIMITERS}]+|[{DELIMITERS}]+$", "")


def _let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _unwrapped(c: Column) -> Column:
    """Without a pair of brackets that stands around the whole text."""

    def one(c: Column, pair: str) -> Column:
        a, b = pair
        held = c.rlike(rf"(?s)^\{a}.*\{b}$") & ~c.rlike(rf"(?s)^\{a}[^\{a}]*\{b}.+$") & (F.length(F.replace(c, F.lit(a), F.lit(""))) == F.length(F.replace(c, F.lit(b), F.lit(""))))
        return F.when(held, F.regexp_replace(c, rf"(?s)^\{a}[{DELIMITERS}]*(.*?)[{DELIMITERS}]*\{b}$", "$1")).otherwise(c)

    return reduce(lambda c, pair: _let(c, lambda x: one(x, pair)), BRACKETS, c)


def _marked(text: Column) -> Column:
    """The text with QUOTE for each quote character that opens or closes a value, always in pairs."""
    edge, end = f"(?<=^|[{DELIMITERS}{OPENS}])", f"(?=$|[{DELIMITERS}{CLOSES}])"
    t = _bare(F.replace(F.coalesce(text, F.lit("")), F.lit(QUOTE), F.lit("")))
    t = F.regexp_replace(t, f"{edge}(?:\"\"|''){end}", "")  # a value without characters
    t = F.regexp_replace(t, f"{edge}\"{{2,}}|\"{{2,}}{end}", "\"")  # doubled quotes stand for one
    t = F.regexp_replace(_bare(t), rf"(?s)^([\"'])\s*([{OPENS}].*[{CLOSES}])\s*\1$", "$2")
    return F.regexp_replace(_unwrapped(t), rf"(?s){edge}([\"'])(.*?)\1{end}", f"{QUOTE}$2{QUOTE}")


def split_packed(text: Column, starts: str) -> Column:
    """array<string> of the values in `text`; `starts` is a pattern that every value begins with.

    A fragment that doesn't begin like a value belongs to the value before it (an address may hold ; or ,), unless a blank parts
    them: then it is a note, and dropped like one that no value precedes. A delimiter inside quotes parts values only where the next
    one begins (a whole list may be quoted). Null, blank and delimiter-only texts give an empty array; a repeated value counts again.
    """
    pieces = F.split(_marked(text), QUOTE)
    # inside quotes: before a delimiter run that a new value follows; outside: before every delimiter run
    literal = F.lit(rf"(?<![{DELIMITERS}])(?=[{DELIMITERS}]+[{OPENS}]*{starts})")
    outside = F.lit(rf"(?<![{DELIMITERS}])(?=[{DELIMITERS}])")
    fragments = F.flatten(
        F.transform(
            pieces,
            lambda p, i: F.when(i % 2 == 1, F.transform(F.split(p, literal), lambda f: F.struct(f.alias("f"), _bare(f).alias("bare"), F.lit(True).alias("quoted")))).otherwise(
                F.transform(F.split(p, outside), lambda f: F.struct(f.alias("f"), _bare(f).alias("bare"), F.lit(False).alias("quoted")))
            ),
        )
    )

    def put(acc: Column, x: Column) -> Column:
        bare, values = x["bare"], acc["values"]
        n = F.size(values)
        joins = acc["open"] & ~x["quoted"] & ~x["f"].rlike(rf"^[{DELIMITERS}]*\s")
        longer = F.concat(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(values, -1), x["f"])))
        return (
            F.when(bare.rlike(f"^[{OPENS}]*{starts}"), F.struct(F.concat(values, F.array(bare)).alias("values"), (~x["quoted"]).alias("open")))
            .when(bare == "", F.struct(values.alias("values"), (acc["open"] & ~x["quoted"] & ~x["f"].rlike(r"\s")).alias("open")))
            .when(joins, F.struct(longer.alias("values"), F.lit(True).alias("open")))
            .otherwise(F.struct(values.alias("values"), F.lit(False).alias("open")))
        )

    start = F.struct(F.array().cast("array<string>").alias("values"), F.lit(False).alias("open"))
    folded = F.aggregate(fragments, start, put, lambda acc: acc["values"])
    return F.transform(folded, lambda v: F.regexp_replace(_bare(_unwrapped(_bare(v))), f"^[{OPENS}]+", ""))


def unpack(df: DataFrame, key: str, field: str, table: str, starts: str) -> DataFrame:
    """Rows (source_table, source_key, field_name, value_position, field_value) of one packed field.

    Positions count from 1 within a row. Rows whose field is null, blank or holds no value give nothing; a row with the
    same key and text as another counts once (a copy names the same record). A null key is kept as null.
    """
    source = df.select(F.col(key).cast("string").alias("source_key"), F.col(field).cast("string").alias("_text")).distinct()
    rows = source.select("source_key", split_packed(F.col("_text"), starts).alias("_values"))
    return rows.select(
        F.lit(table).alias("source_table"), "source_key", F.lit(field).alias("field_name"), F.posexplode("_values").alias("_pos", "field_value")
    ).select("source_table", "source_key", "field_name", (F.col("_pos") + 1).alias("value_position"), "field_value")
