"""Visually identical text with different characters: one consistent form.

Method: DuckDB runs inside Arrow partitions. Its SQL maps compatibility forms and blanks with translate, drops what is
invisible, composes accents with nfc_normalize, and puts look-alike letters of a foreign script back into each word's own
script with regular expressions and list functions. Each partition has one single-threaded connection that sees a slice of
an Arrow batch at a time, so memory doesn't grow with the data.

The consistent form: composed accents, plain letters, digits and signs, ordinary blanks, nothing invisible. Case, repeated
blanks, tabs and line breaks stay, and so do joiners where a script or a sequence of pictures needs them. A word is a run of
letters and marks; one that is wholly in another script stays unless its neighbours show that it is disguised.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumark.llm.function_words import STOPWORDS

# Look-alike letters, and the plain Latin letter of each in the same place.
CYRILLIC_LIKE = "аеіјорсԛѕухһԁԝАВЕІЈКМНОРСԚЅТУХҺԌԜ"
LATIN_OF_CYRILLIC = "aeijopcqsyxhdwABEIJKMHOPCQSTYXHGW"
GREEK_LIKE = "αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN_OF_GREEK = "aikvoptuxABEZHIKMNOPTYX"
#: Latin letters that stand for Russian ones, and those.
LATIN_LIKE = "aeopcyxABEKMHOPCTYX"
CYRILLIC_OF_LATIN = "аеорсухАВЕКМНОРСТУХ"
INVISIBLE = (
    [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFEFF, 0xFFA0]
    + list(range(0x200B, 0x2010))
    + list(range(0x202A, 0x202F))
    + list(range(0x2060, 0x2070))
    + list(range(0xFE00, 0xFE10))
    + list(range(0xE0000, 0xE0080))
)
#: Letters after which a joiner changes how the word is written, and pictures that joiners and selectors belong to.
NEEDS_JOINERS = "[" + "".join(f"\\p{{{x}}}" for x in ("Arabic", "Syriac", "Mongolian", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Khmer", "Myanmar")) + "]"
PICTURE = "[\\x{2190}-\\x{2BFF}\\x{1F000}-\\x{1FAFF}\\x{A9}\\x{AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}]"
JOINING = f"{NEEDS_JOINERS}|{PICTURE}"
#: Bytes of text in one pass of the SQL.
SLICE = 1 << 23
#: Signs that only look like plain ones, beside those that Unicode calls compatibility forms.
SIGNS = {"‐": "-", "‑": "-", "﹣": "-", "․": ".", "ʼ": "'", "＇": "'", "∕": "/", "⁄": "/", "‚": ","}


@functools.cache
def compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters with one plain character each (two strings), and those with several (pairs), found by rule.

    Full-width and mathematical letters, digits and signs, ligatures, digits of other scripts, and all kinds of blanks.
    Roman numerals, ordinals, superscripts and the like are ordinary characters and stay.
    """
    one: dict[str, str] = dict(SIGNS)
    many: list[tuple[str, str]] = []
    ranges = [(0xFF01, 0xFFEF), (0x1D400, 0x1D800), (0xFB00, 0xFB07), (0xFE50, 0xFE70), (0x2460, 0x2500), (0x1F100, 0x1F190), (0x210A, 0x213B)]
    for lo, hi in ranges:
        for cp in range(lo, hi):
            c = chr(cp)
            plain = unicodedata.normalize("NFKC", c)
            if c in one or plain == c or unicodedata.category(c) == "Cn" or not (plain.isascii() or len(plain) == 1 and plain.isalpha()):
                continue
            if 0x2460 <= cp < 0x2500 and len(plain) != 1 or 0x210A <= cp < 0x213B and len(plain) != 1:
                continue
            if len(plain) == 1:
                one[c] = plain
            else:
                many.append((c, plain))
    for cp in range(0x80, 0x1FBFA):
        c = chr(cp)
        if unicodedata.category(c) == "Nd" and c not in one:
            one[c] = str(unicodedata.digit(c))
        elif unicodedata.category(c) == "Zs":
            one[c] = " "
    return "".join(one), "".join(one.values()), many


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    """The characters as a bracket expression, runs as ranges."""
    points = sorted({ord(c) for c in chars})
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in runs) + "]"


@functools.cache
def consistent_sql(column: str) -> str:
    """A DuckDB expression for the consistent form of a column, look-alike letters aside.

    translate reads its long lists anew for each row, so only rows that hold one of their characters reach it.
    """
    source, target, several = compatibility()
    gone = "".join(map(chr, INVISIBLE))
    ligatures = [(c, plain) for c, plain in several if len(plain) <= 3 and plain.isalpha()]
    text = f"translate({column}, {_quoted(source + gone)}, {_quoted(target)})"
    for c, plain in ligatures:
        text = f"replace({text}, {_quoted(c)}, {_quoted(plain)})"
    held = _class(source + gone + "".join(c for c, _ in ligatures))
    text = f"CASE WHEN regexp_matches({column}, '[\\x{{200C}}\\x{{200D}}\\x{{FE0F}}]') AND regexp_matches({column}, '{JOINING}') THEN {_joiners_kept(text, column)} ELSE {text} END"
    return f"nfc_normalize(CASE WHEN regexp_matches({column}, '{held}') THEN {text} ELSE {column} END)"


def _joiners_kept(text: str, column: str) -> str:
    """SQL for `text` over a column whose joiners stay where the script, or a sequence of pictures, needs them; noncharacters stand for
    them meanwhile."""
    marked = column
    for sign, mark, after in (("200C", "FDD0", NEEDS_JOINERS), ("200D", "FDD1", f"(?:{NEEDS_JOINERS}|{PICTURE})"), ("FE0F", "FDD2", PICTURE)):
        marked = f"regexp_replace({marked}, '({after}[\\p{{M}}\\x{{FDD2}}]*)\\x{{{sign}}}', '\\1' || chr({int(mark, 16)}), 'g')"
    return f"translate({text.replace(f'translate({column},', f'translate({marked},', 1)}, chr(64976) || chr(64977) || chr(64978), chr(8204) || chr(8205) || chr(65039))"


def _main_script(text: str) -> str:
    """SQL: the text's own script, 'l' (Latin), 'c' (Cyrillic) or 'g' (Greek).

    Letters without a look-alike count, in words that begin with a small letter (names may be in another script); where these don't
    tell, all letters do.
    """

    def count(part: str, script: str, like: str) -> str:
        return f"length(regexp_replace(translate({part}, {_quoted(like)}, ''), '[^\\p{{{script}}}]', '', 'g'))"

    def most(latin: str, cyrillic: str, greek: str, even: str) -> str:
        return f"WHEN {latin} > {cyrillic} AND {latin} > {greek} THEN 'l' WHEN {cyrillic} > {latin} AND {cyrillic} > {greek} THEN 'c' WHEN {greek} > {latin} AND {greek} > {cyrillic} THEN 'g' {even}"

    small = f"regexp_replace({text}, '\\p{{Lu}}[\\p{{L}}\\p{{M}}]*', '', 'g')"
    every = most(count(text, "Latin", ""), count(text, "Cyrillic", ""), count(text, "Greek", ""), "ELSE 'l'")
    told = most(count(small, "Latin", LATIN_OF_CYRILLIC + LATIN_OF_GREEK), count(small, "Cyrillic", CYRILLIC_LIKE), count(small, "Greek", GREEK_LIKE), every)
    return f"(CASE WHEN NOT regexp_matches({text}, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN 'l' {told} END)"


def _code_sql(w: str) -> str:
    """SQL: what a word is made of. 'm' letters of several scripts; l, c, g only look-alike letters of one script; L, C, G other letters of
    that script too; '-' no word, 'o' a word of other scripts."""
    has = lambda script: f"regexp_matches({w}, '\\p{{{script}}}')"
    strong = lambda script, like: f"regexp_matches(translate({w}, {_quoted(like)}, ''), '\\p{{{script}}}')"
    return f"""CASE WHEN NOT regexp_matches({w}, '^[\\p{{L}}\\p{{M}}]') THEN '-' WHEN {has('Latin')}::INT + {has('Cyrillic')}::INT + {has('Greek')}::INT > 1 THEN 'm'
      WHEN {has('Latin')} THEN CASE WHEN {strong('Latin', LATIN_LIKE)} THEN 'L' ELSE 'l' END WHEN {has('Cyrillic')} THEN CASE WHEN {strong('Cyrillic', CYRILLIC_LIKE)} THEN 'C' ELSE 'c' END
      WHEN {has('Greek')} THEN CASE WHEN {strong('Greek', GREEK_LIKE)} THEN 'G' ELSE 'g' END ELSE 'o' END"""


def _words_sql() -> str:
    """SQL for the text whose words and gaps are the list ws, with the look-alikes of each word put into the word's own script; codes
    tells what each is made of, main the text's script, spoiled whether a word mixes scripts.

    A mixed word's own script is the one of which it has a letter without a look-alike (Latin first, then Cyrillic, then Greek); without
    such a letter it follows the text. A word wholly in one foreign script stays, unless all its letters look like the text's own and
    something near shows that they stand for these: another word of the text mixes scripts, or the word reads as a function word of the
    text's script (a single letter may be a symbol). It stays too where a word beside it, in the same
    script, has a letter that looks like no other, and in a Cyrillic text if it begins with a Latin capital like a name.
    """
    strong = lambda script, like: f"regexp_matches(translate(w, {_quoted(like)}, ''), '\\p{{{script}}}')"
    latin, cyrillic, greek = strong("Latin", LATIN_OF_CYRILLIC + LATIN_OF_GREEK), strong("Cyrillic", CYRILLIC_LIKE), strong("Greek", GREEK_LIKE)
    to_latin = f"translate(w, {_quoted(CYRILLIC_LIKE + GREEK_LIKE)}, {_quoted(LATIN_OF_CYRILLIC + LATIN_OF_GREEK)})"
    to_cyrillic = f"translate(translate(w, {_quoted(GREEK_LIKE)}, {_quoted(LATIN_OF_GREEK)}), {_quoted(LATIN_LIKE)}, {_quoted(CYRILLIC_OF_LATIN)})"
    to_greek = f"translate(translate(w, {_quoted(CYRILLIC_LIKE)}, {_quoted(LATIN_OF_CYRILLIC)}), {_quoted(LATIN_OF_GREEK)}, {_quoted(GREEK_LIKE)})"
    listed = lambda words: "(" + ", ".join(_quoted(w) for w in sorted(words)) + ")"
    latin_words = {w for lang, ws in STOPWORDS.items() if lang != "ru" for w in ws.split() if w.isalpha()}
    near = lambda a, b, c: f"coalesce({a} = upper(code) OR {a} = code AND ({b} = upper(code) OR {b} = code AND {c} = upper(code)), false)"
    beside = f"{near('x[3]', 'x[4]', 'x[5]')} OR {near('x[6]', 'x[7]', 'x[8]')}"
    foreign = f"""CASE WHEN {beside} THEN w
      WHEN main = 'l' THEN CASE WHEN spoiled OR lower({to_latin}) IN {listed(latin_words)} AND length(w) > 1 THEN {to_latin} ELSE w END
      WHEN main = 'c' THEN CASE WHEN code = 'l' AND length(w) > 1 AND regexp_matches(w, '^\\p{{Lu}}') THEN w WHEN NOT regexp_matches({to_cyrillic}, '[\\p{{Latin}}\\p{{Greek}}]') AND (spoiled OR lower({to_cyrillic}) IN {listed(set(STOPWORDS['ru'].split()))} AND length(w) > 1) THEN {to_cyrillic} ELSE w END
      WHEN spoiled AND NOT regexp_matches({to_greek}, '[\\p{{Latin}}\\p{{Cyrillic}}]') THEN {to_greek} ELSE w END"""
    mixed = f"""CASE WHEN {latin} THEN {to_latin} WHEN {cyrillic} THEN {to_cyrillic} WHEN {greek} THEN {to_greek}
      WHEN main = 'c' AND NOT regexp_matches({to_cyrillic}, '[\\p{{Latin}}\\p{{Greek}}]') THEN {to_cyrillic} WHEN main = 'g' AND NOT regexp_matches({to_greek}, '[\\p{{Latin}}\\p{{Cyrillic}}]') THEN {to_greek} ELSE {to_latin} END"""
    word = f"CASE WHEN code = 'm' THEN {mixed} WHEN code IN ('l', 'c', 'g') AND code <> main THEN {foreign} ELSE w END"
    word = re.sub(r"\bw\b", "x[1]", re.sub(r"\bcode\b", "x[2]", word))
    before = ", ".join(f"list_concat({['-'] * k}, codes)[1:len(codes)]" for k in (2, 4, 6))
    after = ", ".join(f"codes[{k + 1}:]" for k in (2, 4, 6))
    # a lambda that held the lists themselves would copy them for each word
    return f"array_to_string(list_transform(list_zip(ws, codes, {before}, {after}), lambda x: {word}), '')"


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts with at most so many bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes) - start


def normalise_batch(con, batch: pa.RecordBatch, columns: list[str], suffix: str) -> pa.RecordBatch:
    """The batch with a further column for each of `columns`; only distinct texts pass through the SQL, SLICE bytes at a time."""
    out = list(batch.columns)
    for c in columns:
        encoded = batch.column(batch.schema.get_field_index(c)).cast(pa.string()).dictionary_encode()
        done: list[pa.Array] = []
        for start, n in slices(encoded.dictionary, SLICE):
            con.register("batch", pa.table({"t": encoded.dictionary.slice(start, n), "i": pa.array(range(n), pa.int32())}))
            done += con.sql(texts_query()).to_arrow_table().column("n").cast(pa.string()).chunks
            con.unregister("batch")
        out.append(pa.concat_arrays(done).take(encoded.indices) if done else pa.nulls(batch.num_rows, pa.string()))
    return pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *(c + suffix for c in columns)])


@functools.cache
def texts_query() -> str:
    """SQL over the view `batch` (t, i): the consistent form n of each text t, in the order of i.

    Words are looked at one by one only in texts where letters of two scripts touch, or where a whole word consists of look-alikes of
    the text's main script.
    """
    plain = f"CASE WHEN regexp_matches(t, '^[\\x00-\\x7F]*$') THEN t ELSE {consistent_sql('t')} END"
    scripts = ("Latin", "Cyrillic", "Greek")
    touch = "|".join(f"\\p{{{a}}}\\p{{M}}*[{''.join(f'\\p{{{b}}}' for b in scripts if b != a)}]" for a in scripts)
    alone = lambda like: f"(?:^|[^\\p{{L}}\\p{{M}}]){_class(like)}+(?:[^\\p{{L}}\\p{{M}}]|$)"
    odd = f"""(regexp_matches(p, '{touch}') OR CASE WHEN NOT regexp_matches(p, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN false
      WHEN main = 'c' THEN regexp_matches(p, '{alone(LATIN_LIKE + GREEK_LIKE)}') WHEN main = 'g' THEN regexp_matches(p, '{alone(LATIN_OF_GREEK + CYRILLIC_LIKE)}') ELSE regexp_matches(p, '{alone(CYRILLIC_LIKE + GREEK_LIKE)}') END)"""
    cut = f"SELECT i, p, main, CASE WHEN {odd} THEN regexp_extract_all(p, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') END AS ws FROM (SELECT *, {_main_script('p')} AS main FROM (SELECT i, {plain} AS p FROM batch))"
    coded = f"SELECT *, list_contains(codes, 'm') AS spoiled FROM (SELECT *, list_transform(ws, lambda w: {_code_sql('w')}) AS codes FROM ({cut}))"
    return f"SELECT CASE WHEN ws IS NULL THEN p ELSE {_words_sql()} END AS n FROM ({coded}) ORDER BY i"


def connect():
    """A connection for one partition: one thread. Its memory follows from SLICE, or from the longest text."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1; SET memory_limit = '2GB'")
    return con


def with_consistent(df: DataFrame, columns: list[str], suffix: str = "_consistent") -> DataFrame:
    """df with, for each named string column, a column `<name><suffix>` that holds its consistent form.

    Null stays null, an empty text stays empty, texts of any length are taken whole; other columns pass through
    unchanged, whatever their names (a clash with an added name is an error). No shuffle: the map runs inside the scan's partitions.
    """
    clash = {c + suffix for c in columns} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c + suffix, T.StringType()) for c in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for b in batches:
            if b.num_rows:
                yield normalise_batch(con, b, columns, suffix)

    return df.mapInArrow(run, schema)
