"""Queries of search, selection, grouping and duplicates. Searches take as queries all rows whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.functions import text as X
from vellumark.operators import grouping as G
from vellumark.operators import retrieval as R
from vellumark.plans.registry import Register
from vellumark.plans.text_queries import sql_fold, sql_multilingual, sql_normal, sql_tokens
from vellumark.sources.sinks import write_index
from vellumark.tables import load, scratch

query = Register()


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return load(spark, sf_dir, "documents", "doc_id", "text", *cols)


def _asked(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))


_BM25 = f"""WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS tok FROM documents),
tf AS (SELECT doc_id, tok, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({sql_tokens('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, sum(dl) / count(*) AS av FROM dl),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
q AS (SELECT DISTINCT doc_id AS query_id, tok FROM tf WHERE doc_id % 100 = 0),
sc AS (SELECT query_id, tf.doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)))), 9) AS score
  FROM q JOIN tf USING (tok) JOIN df USING (tok) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query(_BM25 + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents by BM25 for each query document."""
    docs = _docs(spark, sf_dir)
    found = R.Postings(docs, "doc_id", "text").search(_asked(docs), "query_id", "query_text", 10)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH t AS (SELECT doc_id, unnest({sql_multilingual('text')}) AS tok FROM documents), tf AS (SELECT doc_id, tok, count(*) AS tf FROM t GROUP BY ALL),
dl AS (SELECT doc_id, len({sql_multilingual('text')}) AS dl FROM documents), st AS (SELECT count(*) AS n, sum(dl) / count(*) AS av FROM dl), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok),
q AS (SELECT DISTINCT doc_id AS query_id, tok FROM tf WHERE doc_id % 100 = 0),
sc AS (SELECT query_id, tf.doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)))), 9) AS score
  FROM q JOIN tf USING (tok) JOIN df USING (tok) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 3""")
def bm25_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents by BM25 over multilingual tokens for each query document."""
    docs = _docs(spark, sf_dir)
    asked = _asked(docs)
    found = R.Postings(docs, "doc_id", words=X.multilingual_tokens("text")).search(asked, "query_id", None, 3, X.multilingual_tokens("query_text"))
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH f AS (SELECT doc_id, 3e0 AS w, {sql_tokens("string_split(coalesce(text, ''), chr(10))[1]")} AS toks FROM documents UNION ALL
  SELECT doc_id, 1e0, {sql_tokens('text')} FROM documents),
dl AS (SELECT doc_id, sum(len(toks)) AS dl FROM f GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
tf AS (SELECT doc_id, tok, sum(w) AS tf FROM (SELECT doc_id, w, unnest(toks) AS tok FROM f) GROUP BY ALL),
df AS (SELECT tok, count(*) AS df FROM tf GROUP BY tok), q AS (SELECT DISTINCT doc_id AS query_id, unnest({sql_tokens('text')}) AS tok FROM documents WHERE doc_id % 100 = 0),
sc AS (SELECT query_id, tf.doc_id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)))), 9) AS score
  FROM q JOIN tf USING (tok) JOIN df USING (tok) JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 5""")
def fielded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents by BM25 over title (weight 3) and body for each query document."""
    docs = _docs(spark, sf_dir)
    texts = {"title": F.get(F.split(X.text("text"), "\n"), F.lit(0)), "body": F.col("text")}
    found = R.fielded_search(docs, "doc_id", {"title": 3, "body": 1}, texts, _asked(docs), "query_id", "query_text", 5)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(query.sql["fielded_bm25"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that is written first and then read by the queries' tokens."""
    docs = _docs(spark, sf_dir)
    path = scratch(spark, "index")
    titled = docs.select("doc_id", F.get(F.split(X.text("text"), "\n"), F.lit(0)).alias("title"), F.col("text").alias("body"))
    write_index(titled, "doc_id", {"title": "title", "body": "body"}, path)
    found = R.search_index(spark, path, _asked(docs), "query_id", "query_text", {"title": 3, "body": 1}, 5)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '([.!?]) +', '\1' || chr(10), 'g'), '\n'), lambda s: trim(s)), lambda s: s <> '')"
_CLAIM_EV = """pairs AS (SELECT DISTINCT p.claim_id, e.evidence_id, p.claim_text, e.evidence_summary || ' ' || coalesce(e.title, '') || '. ' || coalesce(e.notes, '') AS body
  FROM tesla_claims_pilot_v0_1 p JOIN tesla_phase1b_evidence_v0_1 e ON p.claim_id = e.claim_id WHERE e.evidence_summary IS NOT NULL)"""


def _claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "claim_id", "evidence_id", "evidence_summary", "title", "notes").where("evidence_summary is not null").distinct()
    body = F.concat(F.col("evidence_summary"), F.lit(" "), X.text("title"), F.lit(". "), X.text("notes"))
    return claims.join(ev, "claim_id").select("claim_id", "evidence_id", "claim_text", body.alias("body")).distinct()


_SENTENCE_SCORES = f"""WITH {_CLAIM_EV},
s AS (SELECT claim_id, evidence_id, claim_text, i - 1 AS idx, sents[i] AS sent FROM (SELECT *, unnest(range(1, len(sents) + 1)) AS i FROM (SELECT *, {_SENT.format(c='body')} AS sents FROM pairs))),
sz AS (SELECT *, len({sql_tokens('sent')}) AS dl, count(*) OVER (PARTITION BY {{k}}) AS n, sum(len({sql_tokens('sent')})) OVER (PARTITION BY {{k}}) / count(*) OVER (PARTITION BY {{k}}) AS av FROM s),
tf AS (SELECT claim_id, evidence_id, claim_text, idx, dl, n, av, tok, count(*) AS tf FROM (SELECT *, unnest({sql_tokens('sent')}) AS tok FROM sz) GROUP BY ALL),
hit AS (SELECT * FROM tf WHERE list_contains({sql_tokens('claim_text')}, tok)),
df AS (SELECT *, count(*) OVER (PARTITION BY {{k}}, tok) AS df FROM hit),
sc AS (SELECT claim_id, evidence_id, idx, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / av)))), 9) AS score FROM df GROUP BY ALL)"""


@query(_SENTENCE_SCORES.replace("{k}", "claim_id, evidence_id") + """,
j AS (SELECT s.claim_id, s.evidence_id, s.idx, s.sent, sc.score, max(sc.score) OVER (PARTITION BY s.claim_id, s.evidence_id) AS best FROM s LEFT JOIN sc USING (claim_id, evidence_id, idx))
SELECT claim_id, evidence_id, CAST(idx AS INTEGER) AS sentence_index, sent AS sentence, round(coalesce(score, 0e0), 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY claim_id, evidence_id ORDER BY coalesce(score, 0) DESC, idx) AS rank FROM j WHERE score > 0 OR best IS NULL) WHERE rank <= 2""")
def sentence_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sentences of each evidence row that fit its claim best."""
    pairs = _claim_evidence(spark, sf_dir).withColumn("sentences", X.sentences("body"))
    got = R.select_sentences(pairs, "claim_text", "sentences", ["claim_id", "evidence_id"], 2)
    return got.select("claim_id", "evidence_id", F.col("index").alias("sentence_index"), F.col("text").alias("sentence"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_SENTENCE_SCORES.replace("{k}", "claim_id") + """,
best AS (SELECT p.claim_id, p.evidence_id, coalesce(max(sc.score), 0e0) AS score FROM pairs p LEFT JOIN sc ON sc.claim_id = p.claim_id AND sc.evidence_id = p.evidence_id GROUP BY ALL)
SELECT claim_id, evidence_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, evidence_id) AS rank FROM best) WHERE rank <= 3""")
def rerank_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's three evidence rows with the best sentence among all its evidence."""
    pairs = _claim_evidence(spark, sf_dir).withColumn("sentences", X.sentences("body"))
    got = R.rerank(pairs, "claim_text", ["claim_id"], "evidence_id", "sentences", "evidence_id", 3)
    return got.select("claim_id", "evidence_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[])
    / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[]))), 9) AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors with a positive cosine for each query vector."""
    vectors = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    got = R.dense_search(vectors, "vec_id", "embedding", vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "embedding"), "q", "embedding", 5)
    return got.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT evidence_id, source_type, row_number() OVER (PARTITION BY source_type ORDER BY source_rank, evidence_id) AS place,
  FROM (SELECT DISTINCT evidence_id, source_type, source_rank FROM tesla_phase1b_evidence_v0_1)),
c AS (SELECT source_type, count(*) AS n FROM (SELECT DISTINCT evidence_id, source_type FROM tesla_phase1b_evidence_v0_1 WHERE is_primary) GROUP BY source_type)
SELECT s.evidence_id, s.source_type FROM s JOIN c USING (source_type) WHERE place <= n""")
def matched_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source type, as many evidence rows by rank as there are primary ones."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "source_type", "source_rank", "is_primary").distinct()
    counts = ev.where("is_primary").select("evidence_id", "source_type").distinct().groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
    rows = ev.select("evidence_id", "source_type", "source_rank").distinct()
    return R.take_matching(rows, ["source_type"], [F.asc_nulls_last("source_rank"), F.asc("evidence_id")], counts, "n").select("evidence_id", "source_type")


_TOKENS = r"""tok AS (SELECT claim_id, i - 1 AS pos, toks[i] AS token FROM (SELECT claim_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM (
  SELECT DISTINCT claim_id, regexp_extract_all(coalesce(claim_text, ''), '[\p{L}\p{N}]+') AS toks FROM tesla_claims_pilot_v0_1)))"""


def _claim_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return claims.select("claim_id", F.posexplode(F.regexp_extract_all(X.text("claim_text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "token"))


@query(f"""WITH {_TOKENS}, r AS (SELECT *, pos - row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS island FROM tok WHERE regexp_matches(token, '^\\p{{Lu}}'))
SELECT claim_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS "end", string_agg(token, ' ' ORDER BY pos) AS run FROM r GROUP BY claim_id, island""")
def capital_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised tokens in every claim."""
    return R.capital_runs(_claim_tokens(spark, sf_dir), ["claim_id"], "pos", "token").select("claim_id", "start", "end", "run")


@query(f"""WITH {_TOKENS}, p AS (SELECT *, least(1e0, length(token) / 8e0) AS p FROM tok), r AS (SELECT *, pos - row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS island FROM p WHERE p >= 0.75),
s AS (SELECT claim_id, min(pos) AS start, max(pos) + 1 AS "end", round(avg(p), 9) AS score FROM r GROUP BY claim_id, island)
SELECT claim_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, start) AS rn FROM s) WHERE rn = 1""")
def decode_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of tokens in every claim under an injected token score (here the token's length)."""
    scored = _claim_tokens(spark, sf_dir).withColumn("p", F.least(F.lit(1.0), F.length("token") / 8.0))
    return R.best_span(scored, ["claim_id"], "pos", "p", 0.75)


@query(f"""WITH {_TOKENS} SELECT claim_id, CAST(pos AS INTEGER) AS pos, token, CASE WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'capital' ELSE 'other' END AS shape,
  lag(token, 1, '<BOUNDARY>') OVER w AS before_1, lag(token, 2, '<BOUNDARY>') OVER w AS before_2, lead(token, 1, '<BOUNDARY>') OVER w AS after_1, lead(token, 2, '<BOUNDARY>') OVER w AS after_2
FROM tok WINDOW w AS (PARTITION BY claim_id ORDER BY pos)""")
def token_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim token with its neighbours and shape."""
    return R.neighbours(_claim_tokens(spark, sf_dir), ["claim_id"], "pos", "token")


@query(f"""WITH {_TOKENS}, g AS (SELECT *, CASE WHEN regexp_matches(token, '^[0-9]') THEN 'I-NUM' WHEN regexp_matches(token, '^\\p{{Lu}}') THEN 'I-NAME' ELSE 'O' END AS tag FROM tok),
k AS (SELECT *, CASE WHEN tag <> 'O' THEN tag[3:] END AS kind, CASE WHEN lag(tag) OVER w <> 'O' THEN lag(tag[3:]) OVER w END AS prev FROM g WINDOW w AS (PARTITION BY claim_id ORDER BY pos)),
n AS (SELECT *, sum(CASE WHEN kind IS NOT NULL AND kind IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY claim_id ORDER BY pos) AS id FROM k)
SELECT claim_id, kind, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 1 AS INTEGER) AS "end" FROM n WHERE kind IS NOT NULL GROUP BY claim_id, id, kind""")
def tag_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of name and number tags in every claim."""
    tag = F.when(F.col("token").rlike("^[0-9]"), F.lit("I-NUM")).when(F.col("token").rlike(r"^\p{Lu}"), F.lit("I-NAME")).otherwise(F.lit("O"))
    return G.spans_of_tags(_claim_tokens(spark, sf_dir).withColumn("tag", tag), ["claim_id"], "pos", "tag").select("claim_id", "kind", "start", "end")


@query("""WITH RECURSIVE k AS (SELECT DISTINCT evidence_id AS r, 'c' || claim_id AS k FROM tesla_phase1b_evidence_v0_1 WHERE claim_id <> '' UNION SELECT DISTINCT evidence_id, 'f' || provenance_family_id FROM tesla_phase1b_evidence_v0_1 WHERE provenance_family_id <> ''),
m AS (SELECT k, min(r) AS h FROM k GROUP BY k), e AS (SELECT DISTINCT k.r AS a, m.h AS b FROM k JOIN m USING (k)), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM w UNION SELECT reach.a, w.b FROM reach JOIN w ON reach.b = w.a)
SELECT a AS evidence_id, least(a, min(b)) AS group_id FROM reach GROUP BY a""")
def connected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows that share a claim or a provenance family, directly or through others."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id", "provenance_family_id")
    return G.linked_groups(ev, "evidence_id", [F.col("claim_id"), F.col("provenance_family_id")]).withColumnRenamed("group", "group_id")


@query(f"SELECT sha256({sql_normal('text')}) AS id, min(text) AS text FROM documents WHERE {sql_normal('text')} <> '' GROUP BY 1")
def pool_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document text in normal form."""
    return G.pool(_docs(spark, sf_dir), "text")


@query("""WITH p AS (SELECT DISTINCT prediction_id, evidence FROM predictions), b AS (SELECT prediction_id, evidence, list_transform(coalesce(evidence, []), lambda e: {'id': e.id, 't': trim(regexp_replace(coalesce(e.text, ''), '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g'))}) AS e FROM p),
k AS (SELECT prediction_id, evidence, CASE WHEN len(e) = 0 THEN [] ELSE list_reduce(list_transform(e, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.id IS NOT DISTINCT FROM x[1].id OR y.t = x[1].t)) > 0 THEN kept ELSE list_concat(kept, x) END) END AS kept FROM b)
SELECT prediction_id, list_transform(kept, lambda x: x.id) AS kept, CAST(coalesce(len(evidence), 0) - len(kept) AS INTEGER) AS n_dropped FROM k""")
def collapse_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every prediction without repeated ids and texts."""
    rows = load(spark, sf_dir, "predictions", "prediction_id", "evidence").distinct()
    kept = G.collapse_context(F.coalesce("evidence", F.array().cast("array<struct<id:string,text:string>>")), "id", "text")
    return rows.select("prediction_id", F.transform(kept, lambda e: e["id"]).alias("kept"), (F.coalesce(F.size("evidence"), F.lit(0)) - F.size(kept)).alias("n_dropped"))


@query("""WITH e AS (SELECT DISTINCT evidence_id, claim_id, nullif(coalesce(provenance_family_id, ''), '') AS f FROM tesla_phase1b_evidence_v0_1),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, f ORDER BY evidence_id) AS rn FROM e) SELECT evidence_id, claim_id FROM r WHERE f IS NULL OR rn = 1""")
def family_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first evidence row of each provenance family in each claim."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id", "provenance_family_id").distinct()
    return G.collapse_families(ev, "claim_id", F.coalesce("provenance_family_id", F.lit("")), [F.asc("evidence_id")]).select("evidence_id", "claim_id")


@query("""SELECT claim_id, source_url, evidence_summary, min(evidence_id) AS evidence_id, count(DISTINCT evidence_id) - 1 AS n_copies FROM tesla_phase1b_evidence_v0_1
WHERE trim(coalesce(source_url, '')) <> '' AND trim(coalesce(evidence_summary, '')) <> '' GROUP BY ALL""")
def exact_copy_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that has an address and a text, once per claim, address and text."""
    ev = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "claim_id", "source_url", "evidence_summary")
    held = ev.where((F.trim(X.text("source_url")) != "") & (F.trim(X.text("evidence_summary")) != ""))
    return held.groupBy("claim_id", "source_url", "evidence_summary").agg(F.min("evidence_id").alias("evidence_id"), (F.countDistinct("evidence_id") - 1).alias("n_copies"))


@query(f"""SELECT {sql_normal('claim')} AS claim_form, min(record_index) AS record_index, min(true_label) AS true_label FROM predictions WHERE true_label IS NOT NULL AND claim IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT true_label) = 1""")
def conflict_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with one gold label only, with their least record."""
    p = load(spark, sf_dir, "predictions", "record_index", "claim", "true_label").where("true_label is not null and claim is not null")
    return G.without_conflicts(p.withColumn("claim_form", X.normal_claim("claim")), ["claim_form"], "true_label", "record_index").select("claim_form", "record_index", "true_label")


@query(f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) >= 5),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s GROUP BY s), x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS ra, b.rep AS rb FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
e AS (SELECT ra, rb FROM p UNION SELECT rb, ra FROM p), reach(ra, rb) AS (SELECT ra, rb FROM e UNION SELECT reach.ra, e.rb FROM reach JOIN e ON reach.rb = e.ra),
cls AS (SELECT ra, least(ra, min(rb)) AS cls FROM reach GROUP BY ra), deg AS (SELECT ra, count(*) AS n FROM e GROUP BY ra)
SELECT d.doc_id, coalesce(cls.cls, c.rep, d.doc_id) AS class_id, coalesce(deg.n, 0) AS n_links FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.s = s.s
LEFT JOIN cls ON cls.ra = c.rep LEFT JOIN deg ON deg.ra = c.rep""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates (five-word shingles, 0.8) and its number of links."""
    return G.near_duplicates(_docs(spark, sf_dir), "doc_id", "text")


@query(f"""WITH c AS (SELECT DISTINCT claim_id, {sql_fold('claim_text')} AS t, source_urls FROM tesla_claims_pilot_v0_1),
k AS (SELECT t, count(DISTINCT claim_id) AS n_claims FROM c GROUP BY t) SELECT t AS claim_form, n_claims FROM k WHERE n_claims > 1""")
def repeated_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim texts that several claims have."""
    c = load(spark, sf_dir, "tesla_claims_pilot_v0_1", "claim_id", "claim_text").distinct()
    return c.groupBy(X.fold("claim_text").alias("claim_form")).agg(F.countDistinct("claim_id").alias("n_claims")).where("n_claims > 1")


QUERIES, SQL = query.queries, query.sql
