"""Text normal forms, tokens, numbers, quotations and answers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
# Words that a claim query leaves out.
QUERY_STOPWORDS = "a an and are as at be by for from has in is it of on or the to was were with".split()
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """The text, '' where it is missing."""
    return F.coalesce(col(c), F.lit(""))


def fold(c: Column | str) -> Column:
    """Lower case, with ß as ss: how texts are compared without case."""
    return F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss"))


def tokens(c: Column | str) -> Column:
    """Word tokens of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def token_set(c: Column | str) -> Column:
    """Distinct words, apostrophes inside them kept, of the lower-case text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(?U)[\w']+"), F.lit(0)))


def normal_claim(c: Column | str) -> Column:
    """Single blanks, none outside, no case."""
    return fold(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")))


def word_form(c: Column | str) -> Column:
    """Words of the folded text with single blanks; an underscore parts words."""
    return F.array_join(tokens(F.replace(text(c), F.lit("_"), F.lit(" "))), " ")


def digest(c: Column | str) -> Column:
    """SHA-256 of a text in hex."""
    return F.sha2(text(c), 256)


def excerpt_id(c: Column | str) -> Column:
    """Identity of an excerpt: the digest of its normal form."""
    return digest(normal_claim(c))


def page_key(c: Column | str) -> Column:
    """A page title as it is compared: underscores and bracket codes as plain characters, then the normal form."""
    plain = F.replace(F.replace(F.replace(text(c), F.lit("_"), F.lit(" ")), F.lit("-LRB-"), F.lit("(")), F.lit("-RRB-"), F.lit(")"))
    return normal_claim(plain)


def multilingual_tokens(c: Column | str) -> Column:
    """w_ and each word without Chinese, Japanese or Korean characters; c1_ and each such character, c2_ and each adjacent pair.

    Words are runs of letters, marks and digits; a run of such characters is broken by any other character.
    """
    lowered = fold(c)
    words = F.transform(F.regexp_extract_all(lowered, F.lit(rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{CJK}]]+"), F.lit(0)), lambda w: F.concat(F.lit("w_"), w))
    runs = F.regexp_extract_all(lowered, F.lit(rf"[{CJK}&&\p{{L}}]+"), F.lit(0))
    singles = F.flatten(F.transform(runs, lambda r: F.transform(F.split(r, ""), lambda x: F.concat(F.lit("c1_"), x))))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.concat(F.lit("c2_"), F.substring(r, i, F.lit(2))))).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.concat(words, F.filter(singles, lambda x: x != "c1_"), pairs)


def claim_query(c: Column | str, most: int = 16) -> Column:
    """A search text of the first distinct tokens that aren't stop-words: quoted, joined by OR."""
    kept = F.filter(tokens(c), lambda t: ~t.isin(QUERY_STOPWORDS))
    return F.array_join(F.transform(F.slice(F.array_distinct(kept), 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def page_sentences(lines: Column | str) -> Column:
    """array<struct<index, text>> of 'index TAB sentence' lines with a numeric index and a sentence that isn't blank."""
    parts = F.transform(F.split(text(lines), "\n"), lambda x: F.split(x, "\t"))
    good = F.filter(parts, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).rlike("^[0-9]+$") & (F.trim(F.coalesce(F.get(p, F.lit(1)), F.lit(""))) != ""))
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("index"), F.get(p, F.lit(1)).alias("text")))


def sentences(c: Column | str) -> Column:
    """Sentences of a text: its lines, cut after a full stop, question or exclamation mark that a blank follows; none is blank."""
    return F.filter(F.transform(F.split(text(c), r"\n|(?<=[.!?]) +"), lambda s: F.trim(s)), lambda s: s != "")


def numbers(c: Column | str) -> Column:
    """Distinct numbers as written, sorted; what stands in square brackets doesn't count, nor digits inside words."""
    bare = F.regexp_replace(text(c), r"\[[^\]]*\]", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?<![\p{L}\p{N}_])[+-]?[0-9]+(?:\.[0-9]+)?(?![\p{L}\p{N}_])"), F.lit(0))))


def without_list_markers(c: Column | str) -> Column:
    """The text without '1.' or '1)' at the beginning of its lines."""
    return F.regexp_replace(text(c), r"(?m)^([ \t]*)[0-9]+[.)][ \t]+", "$1")


def numeric_provenance(explanation: Column, claim: Column, evidence: Column) -> Column:
    """struct of the explanation's numbers that the evidence has, that only the claim has, and that neither has."""
    said, in_claim, in_evidence = numbers(explanation), numbers(claim), numbers(evidence)
    return F.struct(
        F.array_intersect(said, in_evidence).alias("in_evidence"),
        F.array_except(F.array_intersect(said, in_claim), in_evidence).alias("claim_only"),
        F.array_except(F.array_except(said, in_evidence), in_claim).alias("absent"),
    )


def quotations(c: Column | str) -> Column:
    """Texts between double or curly quotation marks."""
    return F.regexp_extract_all(text(c), F.lit('["“]([^"“”]+)["”]'), F.lit(1))


def quote_check(explanation: Column, claim: Column, evidence: Column) -> Column:
    """struct of how many quotations the evidence has, only the claim has, and neither has; case and blanks don't count."""
    quotes = F.transform(quotations(explanation), normal_claim)
    ev, cl = normal_claim(evidence), normal_claim(claim)
    return F.struct(
        F.size(F.filter(quotes, lambda q: F.contains(ev, q))).alias("in_evidence"),
        F.size(F.filter(quotes, lambda q: ~F.contains(ev, q) & F.contains(cl, q))).alias("claim_only"),
        F.size(F.filter(quotes, lambda q: ~F.contains(ev, q) & ~F.contains(cl, q))).alias("unmatched"),
    )


def bracket_ids(c: Column | str) -> Column:
    """Distinct ids in square brackets, in order."""
    return F.array_distinct(F.regexp_extract_all(text(c), F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))


def parse_answer(answer: Column, known_ids: Column, labels: list[str]) -> Column:
    """struct of label, explanation and reasons of a 'label | explanation [id]' answer.

    Reasons: invalid_answer_format without the bar or with an unknown label, unknown_citation_id, missing_citation.
    """
    has_bar = F.contains(text(answer), F.lit("|"))
    label = F.when(has_bar, F.trim(F.substring_index(text(answer), "|", 1)))
    said = F.when(has_bar, F.trim(F.regexp_replace(text(answer), r"(?s)^[^|]*\|", "")))
    cited = bracket_ids(F.coalesce(said, F.lit("")))
    reasons = F.array_compact(
        F.array(
            F.when(~(has_bar & F.coalesce(label.isin(labels), F.lit(False))), F.lit("invalid_answer_format")),
            F.when(F.size(F.array_except(cited, F.coalesce(known_ids, F.array().cast("array<string>")))) > 0, F.lit("unknown_citation_id")),
            F.when(F.size(cited) == 0, F.lit("missing_citation")),
        )
    )
    return F.struct(label.alias("label"), said.alias("explanation"), reasons.alias("reasons"))


def split_ids(c: Column | str) -> Column:
    """Ids of a ;-separated list without blanks around them and without empty ones."""
    return F.filter(F.transform(F.split(text(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def clip(c: Column | str, most: int) -> Column:
    """The first `most` blank-separated words."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " ")), " "), 1, most), " ")


def render_blocks(parts: list[tuple[str, Column]]) -> Column:
    """'NAME: value' lines of the values that aren't blank."""
    lines = [F.when(F.trim(text(v)) != "", F.concat(F.lit(name + ": "), F.trim(text(v)))) for name, v in parts]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def partial_date(c: Column | str) -> Column:
    """struct of year, month and day of YYYY, YYYY-MM or YYYY-MM-DD; all null for any other text."""
    t = F.trim(text(c))
    ok = t.rlike(r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$")
    part = lambda i: F.when(ok, F.try_element_at(F.split(t, "-"), F.lit(i)).cast("int"))
    return F.struct(part(1).alias("year"), part(2).alias("month"), part(3).alias("day"))


def pool_digest(*cols: Column) -> Column:
    """Digest of several values: their texts joined by the unit separator, nulls as the null character."""
    return F.sha2(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols)), "\x1f"), 256)
