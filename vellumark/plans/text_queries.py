"""Queries of the scalar text, number, date and address functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.functions import urls as U
from vellumark.plans.registry import Register
from vellumark.tables import load

query = Register()
LABELS = ["Supported", "Refuted", "Not Enough Evidence"]

WORDS = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
SPACE = r"[\s\x0b\x85\p{Z}]+"


def sql_fold(c: str) -> str:
    return f"replace(lower(coalesce({c}, '')), 'ß', 'ss')"


def sql_tokens(c: str) -> str:
    return rf"regexp_extract_all({sql_fold(c)}, '{WORDS}')"


def sql_normal(c: str) -> str:
    return sql_fold(rf"trim(regexp_replace(coalesce({c}, ''), '{SPACE}', ' ', 'g'))")


def _claims(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return load(spark, sf_dir, "tesla_claims_pilot_v0_1", *cols).distinct()


@query(f"SELECT DISTINCT claim_id, {sql_normal('claim_text')} AS normal_claim, sha256({sql_normal('claim_text')}) AS excerpt_id FROM tesla_claims_pilot_v0_1")
def claim_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form and identity of every claim."""
    return _claims(spark, sf_dir, "claim_id", "claim_text").select("claim_id", X.normal_claim("claim_text").alias("normal_claim"), X.excerpt_id("claim_text").alias("excerpt_id")).distinct()


@query(rf"SELECT doc_id, array_to_string(regexp_extract_all({sql_fold("replace(coalesce(text, ''), '_', ' ')")}, '{WORDS}'), ' ') AS word_form FROM documents")
def word_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its words with single blanks."""
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.word_form("text").alias("word_form"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_distinct FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct tokens of every document."""
    t = X.tokens("text")
    return load(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2EBEF}"


def sql_multilingual(c: str) -> str:
    """SQL for the multilingual tokens of a text: words, then single characters, then pairs, run by run."""
    t = sql_fold(c)
    runs = rf"regexp_extract_all(regexp_replace({t}, '[^\p{{L}}]', ' ', 'g'), '[{_CJK}]+')"
    return rf"""list_concat(list_transform(regexp_extract_all(regexp_replace({t}, '[{_CJK}]', ' ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: 'w_' || w),
      flatten(list_transform({runs}, lambda r: list_transform(string_split(r, ''), lambda x: 'c1_' || x))),
      flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: 'c2_' || substr(r, i, 2)))))"""


@query(f"SELECT DISTINCT prediction_id, {sql_multilingual('claim')} AS tokens FROM predictions")
def cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilingual tokens of every prediction's claim: words, and single and paired characters of scripts without blanks."""
    return load(spark, sf_dir, "predictions", "prediction_id", "claim").distinct().select("prediction_id", X.multilingual_tokens("claim").alias("tokens"))


@query(rf"""SELECT DISTINCT claim_id, array_to_string(list_transform(list_slice(ordered, 1, 16), lambda t: '"' || t || '"'), ' OR ') AS search_text FROM (
  SELECT claim_id, list_filter(tok, lambda t, i: list_position(tok, t) = i) AS ordered FROM (
    SELECT claim_id, list_filter({sql_tokens('claim_text')}, lambda t: t NOT IN ({", ".join(f"'{w}'" for w in X.QUERY_STOPWORDS)})) AS tok FROM tesla_claims_pilot_v0_1))""")
def claim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search text of every claim."""
    return _claims(spark, sf_dir, "claim_id", "claim_text").select("claim_id", X.claim_query("claim_text").alias("search_text")).distinct()


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_part = lambda u, i: f"regexp_extract({u}, '{_URL}', {i}, 's')"
_U = "trim(coalesce(source_url, ''))"


@query(rf"""SELECT DISTINCT evidence_id, CASE WHEN regexp_matches({_U}, '{_URL}', 's') AND {_part(_U, 2)} <> ''
  THEN lower({_part(_U, 1)}) || '://' || lower({_part(_U, 2)}) || regexp_replace(regexp_replace({_part(_U, 3)}, '/+', '/', 'g'), '/$', '') || {_part(_U, 4)}
  ELSE regexp_replace(lower({_U}), '/+$', '') END AS url FROM tesla_phase1b_evidence_v0_1""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form of every evidence address."""
    return load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "source_url").distinct().select("evidence_id", U.normal_url("source_url").alias("url")).distinct()


_IN = r"regexp_extract(trim(coalesce({c}, '')), '(?i)^https?://[^/]+/web/[0-9]+[a-z_]*/(.+)$', 1)"


def _source_url_sql(c: str) -> str:
    inner = _IN.format(c=c)
    u0 = f"trim(CASE WHEN {inner} <> '' THEN {inner} ELSE trim(coalesce({c}, '')) END)"
    return u0


@query(rf"""SELECT DISTINCT doc_id, CASE WHEN u = '' THEN '' ELSE host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS page,
    CASE WHEN u = '' THEN '' ELSE host END AS family FROM (
  SELECT doc_id, u, regexp_replace(regexp_replace(regexp_replace(lower({_part('u', 2)}), '^[^@]*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
    CASE WHEN regexp_replace({_part('u', 3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_part('u', 3)}, '/+$', '') END AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_replace({_part('u', 4)}, '^\?', ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{U.TRACKING}'))), '&') AS q
  FROM (SELECT doc_id, CASE WHEN u0 = '' THEN '' WHEN regexp_matches(u0, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u0 ELSE 'https://' || u0 END AS u
        FROM (SELECT doc_id, {_source_url_sql('source_url')} AS u0 FROM documents)))""")
def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that every document's address names, and its host."""
    return load(spark, sf_dir, "documents", "doc_id", "source_url").distinct().select("doc_id", U.source_url("source_url").alias("page"), U.source_family("source_url").alias("family"))


@query(r"""SELECT DISTINCT claim_id, try_strptime(regexp_extract(coalesce(source_urls, ''), '(?i)^https?://[^/]+/web/([0-9]{8})[0-9]*', 1), '%Y%m%d')::DATE AS captured_on
FROM tesla_claims_pilot_v0_1""")
def archive_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of capture in the first address of every claim, where it is an archive's."""
    return _claims(spark, sf_dir, "claim_id", "source_urls").select("claim_id", U.archive_date("source_urls").alias("captured_on")).distinct()


@query(rf"""SELECT DISTINCT doc_id, regexp_matches(coalesce(source_url, ''), '{_URL}', 's') AND lower({_part("coalesce(source_url, '')", 1)}) = 'https'
  AND regexp_matches({_part("coalesce(source_url, '')", 2)}, '^[^@:]+(:443)?$') AND {_part("coalesce(source_url, '')", 5)} = ''
  AND NOT regexp_matches(coalesce(source_url, ''), '[\x00-\x20\x7f\\]') AS safe FROM documents""")
def safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document's address may be fetched."""
    return load(spark, sf_dir, "documents", "doc_id", "source_url").distinct().select("doc_id", U.safe_url("source_url").alias("safe"))


def sql_numbers(c: str) -> str:
    """Distinct numbers of a text without looking around: words that aren't all digits give way to a letter, and a sign behind a word stands alone."""
    other = r"[\p{L}_\p{Nl}\p{No}\x{FF10}-\x{FF19}\x{660}-\x{669}\x{966}-\x{96F}]"
    bare = rf"regexp_replace(coalesce({c}, ''), '\[[^\]]*\]', '', 'g')"
    plain = rf"regexp_replace(regexp_replace({bare}, '[\p{{L}}\p{{N}}_]*{other}[\p{{L}}\p{{N}}_]*', 'x', 'g'), '([\p{{L}}\p{{N}}_])([+-])', '\1 \2 ', 'g')"
    return rf"list_sort(list_distinct(regexp_extract_all({plain}, '[+-]?[0-9]+(?:\.[0-9]+)?')))"


@query(f"SELECT prediction_id, {sql_numbers('generated_explanation')} AS numbers FROM (SELECT DISTINCT prediction_id, generated_explanation FROM predictions)")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct numbers of every generated explanation."""
    return load(spark, sf_dir, "predictions", "prediction_id", "generated_explanation").distinct().select("prediction_id", X.numbers("generated_explanation").alias("numbers"))


def _evidence_text() -> F.Column:
    return F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<struct<id:string,text:string>>")), lambda e: F.coalesce(e["text"], F.lit(""))), "\n")


@query(f"""WITH n AS (SELECT prediction_id, {sql_numbers('generated_explanation')} AS said, {sql_numbers('claim')} AS cl, {sql_numbers("array_to_string(list_transform(coalesce(evidence, []), lambda e: coalesce(e.text, '')), chr(10))")} AS ev
  FROM (SELECT DISTINCT prediction_id, generated_explanation, claim, evidence FROM predictions))
SELECT prediction_id, list_filter(said, lambda x: list_contains(ev, x)) AS in_evidence, list_filter(said, lambda x: list_contains(cl, x) AND NOT list_contains(ev, x)) AS claim_only, list_filter(said, lambda x: NOT list_contains(cl, x) AND NOT list_contains(ev, x)) AS absent FROM n""")
def numeric_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the numbers of every generated explanation come from: evidence, claim only, or neither."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "generated_explanation", "claim", "evidence").distinct()
    p = X.numeric_provenance(F.col("generated_explanation"), F.col("claim"), _evidence_text())
    return rows.select("prediction_id", p.alias("p")).select("prediction_id", "p.in_evidence", "p.claim_only", "p.absent")


_EV = "array_to_string(list_transform(coalesce(evidence, []), lambda e: coalesce(e.text, '')), chr(10))"


@query(rf"""SELECT prediction_id, len(list_filter(q, lambda x: contains(ev, x))) AS in_evidence, len(list_filter(q, lambda x: NOT contains(ev, x) AND contains(cl, x))) AS claim_only,
  len(list_filter(q, lambda x: NOT contains(ev, x) AND NOT contains(cl, x))) AS unmatched FROM (
  SELECT prediction_id, {sql_normal(_EV)} AS ev, {sql_normal('claim')} AS cl,
    list_transform(regexp_extract_all(coalesce(generated_explanation, ''), '["“]([^"“”]+)["”]', 1), lambda x: {sql_normal('x')}) AS q
  FROM (SELECT DISTINCT prediction_id, generated_explanation, claim, evidence FROM predictions))""")
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many quotations of every generated explanation the evidence or the claim has."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "generated_explanation", "claim", "evidence").distinct()
    q = X.quote_check(F.col("generated_explanation"), F.col("claim"), _evidence_text())
    return rows.select("prediction_id", q.alias("q")).select("prediction_id", *(F.col(f"q.{c}").cast("long").alias(c) for c in ("in_evidence", "claim_only", "unmatched")))


_KNOWN = r"list_distinct(regexp_extract_all(coalesce(prompt, ''), '\[([^\[\]]+)\]', 1))"
_BAR = "contains(coalesce(answer, ''), '|')"
_SAID = rf"CASE WHEN {_BAR} THEN trim(regexp_replace(coalesce(answer, ''), '^[^|]*\|', '')) END"
_CITED = rf"list_distinct(regexp_extract_all(coalesce({_SAID}, ''), '\[([^\[\]]+)\]', 1))"


@query(rf"""SELECT key, CASE WHEN {_BAR} THEN trim(string_split(answer, '|')[1]) END AS label, {_SAID} AS explanation,
  array_to_string(list_filter([CASE WHEN NOT ({_BAR} AND coalesce(trim(string_split(answer, '|')[1]) IN ('Supported', 'Refuted', 'Not Enough Evidence'), false)) THEN 'invalid_answer_format' END,
    CASE WHEN len(list_filter({_CITED}, lambda x: NOT list_contains({_KNOWN}, x))) > 0 THEN 'unknown_citation_id' END,
    CASE WHEN len({_CITED}) = 0 THEN 'missing_citation' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM (SELECT DISTINCT key, prompt, answer FROM responses_used)""")
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, explanation and faults of every response, read as 'label | explanation [id]'."""
    rows = load(spark, sf_dir, "responses_used", "key", "prompt", "answer").distinct()
    parsed = X.parse_answer(F.col("answer"), X.bracket_ids("prompt"), LABELS)
    return rows.select("key", parsed.alias("p")).select("key", "p.label", "p.explanation", F.array_join("p.reasons", ",").alias("reasons"))


@query(r"""SELECT prediction_id, len(list_filter(ids, lambda x: list_contains(known, x))) AS n_known, len(list_filter(ids, lambda x: NOT list_contains(known, x))) AS n_unknown,
  len(list_filter(urls, lambda u: NOT contains(given, u))) AS n_foreign_urls, len(ids) = 0 AND coalesce(generated_verdict IN ('Supported', 'Refuted'), false) AS uncited_decisive FROM (
  SELECT prediction_id, generated_verdict, list_distinct(regexp_extract_all(coalesce(generated_explanation, ''), '\[([^\[\]]+)\]', 1)) AS ids,
    list_distinct(regexp_extract_all(coalesce(generated_explanation, ''), 'https?://[^\s\]>)"]+')) AS urls, list_transform(coalesce(evidence, []), lambda e: e.id) AS known,
    coalesce(claim, '') || chr(10) || array_to_string(list_transform(coalesce(evidence, []), lambda e: coalesce(e.text, '')), chr(10)) AS given
  FROM (SELECT DISTINCT prediction_id, generated_explanation, generated_verdict, claim, evidence FROM predictions))""")
def explanation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known and unknown citations, addresses that no input has, and decisive verdicts without a citation."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "generated_explanation", "generated_verdict", "claim", "evidence").distinct()
    ids = X.bracket_ids("generated_explanation")
    known = F.transform(F.coalesce("evidence", F.array().cast("array<struct<id:string,text:string>>")), lambda e: e["id"])
    urls = F.array_distinct(F.regexp_extract_all(X.text("generated_explanation"), F.lit(r'https?://[^\s\]>)"]+'), F.lit(0)))
    given = F.concat(X.text("claim"), F.lit("\n"), _evidence_text())
    rows = rows.select("prediction_id", "generated_verdict", ids.alias("ids"), known.alias("known"), urls.alias("urls"), given.alias("given"))
    return rows.select(
        "prediction_id",
        F.size(F.filter("ids", lambda x: F.array_contains("known", x))).cast("long").alias("n_known"),
        F.size(F.filter("ids", lambda x: ~F.coalesce(F.array_contains("known", x), F.lit(False)))).cast("long").alias("n_unknown"),
        F.size(F.filter("urls", lambda u: ~F.contains(F.col("given"), u))).cast("long").alias("n_foreign_urls"),
        ((F.size("ids") == 0) & F.coalesce(F.col("generated_verdict").isin("Supported", "Refuted"), F.lit(False))).alias("uncited_decisive"),
    )


@query(r"""SELECT DISTINCT evidence_id, CASE WHEN ok THEN string_split(t, '-')[1]::INT END AS year, CASE WHEN ok THEN string_split(t, '-')[2]::INT END AS month,
  CASE WHEN ok THEN string_split(t, '-')[3]::INT END AS day FROM (
  SELECT evidence_id, trim(coalesce(publication_date, '')) AS t, regexp_matches(trim(coalesce(publication_date, '')), '^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?$') AS ok
  FROM tesla_phase1b_evidence_v0_1)""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, month and day of every evidence row's publication date as far as it goes."""
    rows = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "publication_date").distinct()
    return rows.select("evidence_id", X.partial_date("publication_date").alias("d")).select("evidence_id", "d.year", "d.month", "d.day").distinct()


@query(r"""SELECT DISTINCT edge_id, unnest(list_filter(list_transform(string_split(coalesce(dependency_signals, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS signal
FROM tesla_phase1b_provenance_edges_v0_1""")
def split_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dependency signals of every edge, one per row."""
    return load(spark, sf_dir, "tesla_phase1b_provenance_edges_v0_1", "edge_id", "dependency_signals").select("edge_id", F.explode(X.split_ids("dependency_signals")).alias("signal")).distinct()


@query(rf"""SELECT DISTINCT prediction_id, array_to_string(list_filter([CASE WHEN trim(coalesce(claim, '')) <> '' THEN 'CLAIM: ' || trim(claim) END,
  CASE WHEN trim({_EV}) <> '' THEN 'EVIDENCE: ' || trim({_EV}) END], lambda x: x IS NOT NULL), chr(10)) AS rendered,
  array_to_string(list_slice(string_split(trim(regexp_replace(coalesce(claim, ''), '{SPACE}', ' ', 'g')), ' '), 1, 12), ' ') AS clipped FROM predictions""")
def render_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's claim and evidence as lines of a prompt, and the claim's first twelve words."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "claim", "evidence").distinct()
    return rows.select("prediction_id", X.render_blocks([("CLAIM", F.col("claim")), ("EVIDENCE", _evidence_text())]).alias("rendered"), X.clip("claim", 12).alias("clipped")).distinct()


QUERIES, SQL = query.queries, query.sql
