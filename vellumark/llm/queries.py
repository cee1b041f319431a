"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.llm.components import match_groups
from vellumark.llm.consistent import with_consistent
from vellumark.llm.garbled import Garbled
from vellumark.llm.leaks import leaked
from vellumark.llm.mixture import Mixture
from vellumark.llm.overlap import Overlaps
from vellumark.llm.pairs import defects, project_pairs
from vellumark.llm.splits import assign_splits, related_records, split_report
from vellumark.tables import cut, load

TEXTS = ["claim", "shown_claim", "generated_explanation"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every record that accepted matches tie to another one."""
    return match_groups(load(spark, sf_dir, "record_matches"), load(spark, sf_dir, "predictions", "record_index"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose stored text differs from its consistent form."""
    rows = with_consistent(load(spark, sf_dir, "predictions", "prediction_id", *TEXTS), TEXTS)
    marked = rows.select("prediction_id", F.explode(F.array(*(F.when(F.col(c) != F.col(c + "_consistent"), F.lit(c)) for c in TEXTS))).alias("field_name"))
    return marked.where("field_name is not null").distinct()


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prediction's texts in consistent form."""
    return with_consistent(load(spark, sf_dir, "predictions", "prediction_id", *TEXTS), TEXTS).select("prediction_id", *(c + "_consistent" for c in TEXTS))


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_records(load(spark, sf_dir, "predictions", "record_index", "claim", "evidence"), load(spark, sf_dir, "split_result", "group_by_index"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every record tied to another one by evidence, declared group or claim."""
    return _related(spark, sf_dir)


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's split: 70 % train, 15 % validation, 15 % test, groups undivided."""
    return assign_splits(load(spark, sf_dir, "predictions", "record_index", "true_label"), cut(_related(spark, sf_dir)), "record_index", "true_label")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and shares of the splits, overall and per label."""
    records = load(spark, sf_dir, "predictions", "record_index", "true_label")
    return split_report(cut(assign_splits(records, cut(_related(spark, sf_dir)), "record_index", "true_label")), records, "record_index", "true_label")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every faulty pair of prompt and response with its defect."""
    pairs = project_pairs(
        load(spark, sf_dir, "answers", "key", "response"),
        load(spark, sf_dir, "responses_used", "key", "prompt", "answer"),
        load(spark, sf_dir, "predictions", "prediction_id", "stages", "claim", "generated_explanation", "language"),
    )
    return defects(pairs, {"answers": True, "responses_used": True})


def _overlaps(spark: SparkSession, sf_dir: str) -> Overlaps:
    return Overlaps(load(spark, sf_dir, "predictions", "record_index", "claim"), load(spark, sf_dir, "split_result", "train_indices", "validation_indices"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a validation record with the same or nearly the same claim."""
    return _overlaps(spark, sf_dir).found()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, side and cohort (null where unknown): records, those that overlap with the other side of any split, and their pairs."""
    overlaps = _overlaps(spark, sf_dir)
    split = load(spark, sf_dir, "split_result", "split_id", "train_indices", "validation_indices")
    side = lambda s: split.select("split_id", F.lit(s).alias("side"), F.explode(f"{s}_indices").alias("record_index"))
    listed = side("train").unionByName(side("validation")).where("record_index is not null").distinct()
    cohort = load(spark, sf_dir, "predictions", "record_index", "cohort").groupBy("record_index").agg(F.min("cohort").alias("cohort"))
    train = overlaps.records.where("in_train").select(F.col("word_set").alias("train_set"), F.col("record_index").alias("t"))
    val = overlaps.records.where("in_validation").select(F.col("word_set").alias("eval_set"), F.col("record_index").alias("v"))
    pairs = cut(overlaps.pairs.select("train_set", "eval_set").join(train, "train_set").join(val, "eval_set").where("t <> v").select("t", "v").distinct())
    of = lambda s, c: pairs.groupBy(F.col(c).alias("record_index")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s))
    met = of("train", "t").unionByName(of("validation", "v"))
    rows = listed.join(cohort, "record_index", "left").join(met, ["record_index", "side"], "left")
    return rows.groupBy("split_id", "side", "cohort").agg(F.count(F.lit(1)).alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each overlapping validation record, the number of distinct training claims it overlaps with, and how much of it one of them covers."""
    return _overlaps(spark, sf_dir).coverage()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share twelve consecutive words or more with a held-out item."""
    return leaked(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "heldout_items", "item_id", "text")).select("doc_id", "item_id").distinct()


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole held-out item word for word or nearly so (weighted five-word shingles similar to 0.8 or more)."""
    documents, items = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "heldout_items", "item_id", "text")
    return leaked(documents, items, window=None, radius=14, similarity=0.8).distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source in every mixture."""
    return Mixture(load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), load(spark, sf_dir, "mixture_targets")).shares()


def p9_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares where each mixture takes nine tenths of all that its sources can supply: small sources fall short, and their
    siblings stand in."""
    return Mixture(load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), load(spark, sf_dir, "mixture_targets"), fill=0.9).shares()


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for every mixture and how often each is repeated."""
    return Mixture(load(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), load(spark, sf_dir, "mixture_targets")).drawn()


def _garbled(spark: SparkSession, sf_dir: str) -> Garbled:
    return Garbled(load(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", ["text"], "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were decoded wrongly, wholly or in places."""
    return _garbled(spark, sf_dir).found().select("doc_id").distinct()


def p10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with their chain of encodings and the text restored."""
    return _garbled(spark, sf_dir).repaired().select("doc_id", "chain", "restored")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_splits, p2_report, p5_found, p6_found, p6_consistent, p7_found, p7_report, p7_coverage, p8_found, p8_near, p8_items, p9_shares, p9_short, p9_drawn, p10_found, p10_repaired)}

SQL = {
    "p1_found": """WITH RECURSIVE known AS (SELECT DISTINCT record_index AS r FROM predictions),
e AS (SELECT DISTINCT left_record AS a, right_record AS b FROM record_matches WHERE decision = 'accepted' AND left_record <> right_record
      AND left_record IN (SELECT r FROM known) AND right_record IN (SELECT r FROM known)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT a AS record_index, least(a, min(b)) AS group_id FROM reach GROUP BY a""",
}
_WINDOWS = """SELECT DISTINCT id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM (
  SELECT {id} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}) WHERE len(w) >= 12)"""
_LEAKS = f"""WITH d AS ({_WINDOWS.format(id="doc_id", table="documents")}), t AS ({_WINDOWS.format(id="item_id", table="heldout_items")}),
f AS (SELECT DISTINCT d.id AS doc_id, t.id AS item_id FROM d JOIN t USING (g))"""
SQL["p8_found"] = _LEAKS + " SELECT doc_id, item_id FROM f"
SQL["p8_items"] = _LEAKS + " SELECT item_id, count(*) AS n_documents FROM f GROUP BY item_id"

# The twins' consistent form is a shorter one of its own, for the kinds of disguise that the tables hold.
_FORMS = r"""forms AS MATERIALIZED (SELECT t, CASE WHEN NOT regexp_matches(p, '[\p{Cyrillic}\p{Greek}]') OR NOT regexp_matches(p, '\p{Latin}') THEN p ELSE
  array_to_string(list_transform(regexp_extract_all(p, '[\p{L}\p{M}]+|[^\p{L}\p{M}]+'), lambda w:
    CASE WHEN NOT regexp_matches(w, '[\p{Cyrillic}\p{Greek}]') OR NOT regexp_matches(w, '[\p{Latin}\p{Greek}]') THEN
           CASE WHEN russian AND w IN ('B', 'HE', 'HA', 'c', 'C', 'o', 'O') THEN translate(w, 'BHEAcCoO', 'ВНЕАсСоО') ELSE w END
         WHEN regexp_matches(w, '[а-яёА-ЯЁ]') AND NOT regexp_matches(w, '[bdf-hj-nq-wzDFGJLNQRU-WZÀ-ɏ]') AND (russian OR regexp_matches(w, '[б-джзи-нптф-яБГДЖЗИЙЛПУФЦЧШ-Я]'))
           THEN translate(w, 'aeopcyxABEKMHOPCTYXοΟΑΕΡΤΝΒΗΚΜ', 'аеорсухАВЕКМНОРСТУХоОАЕРТНВНКМ')
         ELSE translate(w, 'аеорсухіјѕһАВЕКМНОРСТУХІЈЅονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ', 'aeopcyxijshABEKMHOPCTYXIJSovABEZHIKMNOPTYX') END), '') END AS n
  FROM (SELECT t, p, length(regexp_replace(p, '[^а-яёА-ЯЁ]', '', 'g')) > length(regexp_replace(p, '\p{Lu}\p{Ll}+|[^\p{Latin}]', '', 'g')) AS russian FROM (
    SELECT t, nfc_normalize(replace(replace(replace(replace(replace(translate(regexp_replace(regexp_replace(t, '[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'),
      array_to_string(list_transform(range(65281, 65375), lambda i: chr(CAST(i AS INTEGER))), ''), array_to_string(list_transform(range(33, 127), lambda i: chr(CAST(i AS INTEGER))), '')),
      'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬆ', 'st')) AS p FROM (SELECT DISTINCT t FROM (@texts) WHERE t IS NOT NULL))))"""


def _with_forms(texts: str) -> str:
    """A CTE `forms` (t, n): the consistent form of each text that the subquery `texts` (t) gives."""
    return _FORMS.replace("@texts", texts)


_TEXTS = " UNION ".join(f"SELECT {c} AS t FROM predictions" for c in TEXTS)
SQL["p6_found"] = f"WITH {_with_forms(_TEXTS)} " + " UNION ".join(f"SELECT prediction_id, '{c}' AS field_name FROM predictions JOIN forms ON {c} = t WHERE t <> n" for c in TEXTS)
SQL["p6_consistent"] = f"WITH {_with_forms(_TEXTS)} SELECT prediction_id, {', '.join(f'{c}_f.n AS {c}_consistent' for c in TEXTS)} FROM predictions " + " ".join(f"LEFT JOIN forms {c}_f ON {c}_f.t = {c}" for c in TEXTS)
_CLAIMS = f"""{_with_forms("SELECT claim AS t FROM predictions")}, c AS (SELECT DISTINCT record_index, n FROM predictions JOIN forms ON claim = t)"""
SQL["p2_found"] = f"""WITH RECURSIVE {_CLAIMS}, k AS (
  SELECT record_index AS r, 'c:' || trim(regexp_replace(lower(n), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g')) AS k FROM c WHERE trim(regexp_replace(lower(n), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g')) <> ''
  UNION SELECT record_index, 'e:' || trim(e.id) FROM (SELECT record_index, unnest(evidence) AS e FROM predictions) WHERE trim(e.id) <> ''
  UNION SELECT r, 'g:' || trim(v) FROM (SELECT unnest(map_keys(group_by_index)) AS r, unnest(map_values(group_by_index)) AS v FROM split_result) WHERE trim(v) <> '' AND r IN (SELECT record_index FROM predictions)),
m AS (SELECT k, min(r) AS h FROM k GROUP BY k HAVING count(DISTINCT r) > 1), e AS (SELECT DISTINCT k.r AS a, m.h AS b FROM k JOIN m USING (k) WHERE k.r <> m.h), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM reach r JOIN w ON r.b = w.a)
SELECT a AS record_index, least(a, min(b)) AS group_id FROM reach GROUP BY a"""
_OVERLAPS = f"""{_CLAIMS}, w AS (SELECT record_index, list_distinct(regexp_extract_all(lower(n), '[\\p{{L}}\\p{{N}}]+')) AS w FROM c),
tr AS (SELECT DISTINCT unnest(train_indices) AS r FROM split_result), va AS (SELECT DISTINCT unnest(validation_indices) AS r FROM split_result),
x AS (SELECT a.record_index AS a, b.record_index AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM w a JOIN tr ON tr.r = a.record_index, w b JOIN va ON va.r = b.record_index WHERE len(a.w) > 0 AND len(b.w) > 0 AND a.record_index <> b.record_index),
p AS (SELECT DISTINCT a, b FROM x WHERE i >= 0.8 * (s - i) - 1e-9)"""
SQL["p7_found"] = f"WITH {_OVERLAPS} SELECT DISTINCT least(a, b) AS record_index, greatest(a, b) AS other_record_index FROM p"
SQL["p7_report"] = f"""WITH {_OVERLAPS}, met AS (SELECT a AS r, 'train' AS side, count(*) AS n FROM p GROUP BY a UNION ALL SELECT b, 'validation', count(*) FROM p GROUP BY b),
listed AS (SELECT DISTINCT split_id, 'train' AS side, unnest(train_indices) AS r FROM split_result UNION SELECT split_id, 'validation', unnest(validation_indices) FROM split_result),
k AS (SELECT record_index AS r, min(cohort) AS cohort FROM predictions GROUP BY record_index)
SELECT split_id, side, cohort, count(*) AS n_records, count(n) AS n_overlapping, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs FROM listed LEFT JOIN k USING (r) LEFT JOIN met USING (r, side) WHERE r IS NOT NULL GROUP BY ALL"""
