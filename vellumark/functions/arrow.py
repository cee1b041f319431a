"""Text functions that no built-in expresses, over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Units that may follow a number at once.
UNITS = "mmol/L mol/L mg/dL mg/mL ng/mL pg/mL µg/mL ug/mL mmHg mL µL uL mg µg ug ng kg cm mm nm km ms Hz kHz MHz GHz °C °F mol mmol g L m s h %".split()
def compatible(text: str) -> str:
    """Compatibility characters replaced (NFKC), full case folding, single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def compatible_words(text: str) -> str:
    """The words of the same, joined by single blanks."""
    return " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", text).casefold()))


def _without_marker(line: str) -> str:
    """A line without the number that lists it: digits, a point or bracket, and a blank at its beginning."""
    body = line.lstrip(" \t")
    digits = len(body) - len(body.lstrip("0123456789"))
    rest = body[digits + 1 :]
    if digits and body[digits : digits + 1] in (".", ")") and rest[:1] in (" ", "\t"):
        return line[: len(line) - len(body)] + rest.lstrip(" \t")
    return line


def _without_brackets(text: str) -> str:
    """The text without each [ ... ]; an open bracket that isn't closed stays."""
    head, *tail = text.split("[")
    out, held = [head], ""
    for part in tail:
        inside, closed, after = part.partition("]")
        if closed:
            out.append(after)
            held = ""
        else:
            held += "[" + inside
    return "".join(out) + held


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _digits_end(text: str, at: int) -> int:
    while at < len(text) and text[at].isdecimal():
        at += 1
    return at


def _number_at(text: str, at: int) -> int:
    """Where the digits, fraction and exponent that begin at a digit end."""
    end = _digits_end(text, at)
    if text[end : end + 1] == "." and text[end + 1 : end + 2].isdecimal():
        end = _digits_end(text, end + 1)
    if text[end : end + 1] in ("e", "E"):
        power = end + 1 + (text[end + 1 : end + 2] in ("+", "-"))
        if text[power : power + 1].isdecimal():
            end = _digits_end(text, power)
    return end


def _ends_well(text: str, end: int) -> bool:
    """Whether a number may end here: at a blank or sign other than a point, or at a unit that itself ends a word."""
    following = text[end : end + 1]
    if not following:
        return True
    if following == "." or following.isdecimal():
        return False
    return not _in_word(following) or any(text.startswith(u, end) and not _in_word(text[end + len(u) : end + len(u) + 1] or " ") for u in UNITS)


def canonical_numbers(text: str) -> str:
    """Distinct numbers in canonical decimal form, sorted, joined by blanks: 1.50 and 1.5 are one, 20 is 2E+1.

    A number stands free on both sides, save for a unit behind it. List markers at line starts and what stands in square brackets don't
    count, nor digits inside names like NFAT4.
    """
    t = _without_brackets("\n".join(map(_without_marker, text.split("\n"))))
    found, at = set(), 0
    while at < len(t):
        if not t[at].isdecimal():
            at += 1
            continue
        end, before = _number_at(t, at), t[at - 1 : at]
        signed = before in ("+", "-") and before and not (_in_word(t[at - 2 : at - 1] or " ") or t[at - 2 : at - 1] == ".")
        free = not before or not (_in_word(before) or before == ".")
        good = free and _ends_well(t, end)
        if good:
            try:
                found.add(str(Decimal(t[at - 1 if signed else at : end]).normalize()))
            except InvalidOperation:
                pass
        at = end if good else _digits_end(t, at)
    return " ".join(sorted(found))


def with_mapped(df: DataFrame, column: str, name: str, f: Callable[[str], str]) -> DataFrame:
    """df with f of a text column under a further name; null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else f(t) for t in texts], pa.string())], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)
