"""Queries of the general data operators: packed fields and hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumark.operators.hierarchy import descendants, provenance_trees
from vellumark.operators.packed import ADDRESS, IDENTIFIER, unpack
from vellumark.tables import cut, load

PACKED = [
    ("tesla_claims_pilot_v0_1", "claim_id", "source_urls", ADDRESS),
    ("tesla_phase1b_verdicts_v0_1", "claim_id", "decisive_evidence_ids", IDENTIFIER),
    ("tesla_phase1b_verdicts_v0_1", "claim_id", "provenance_family_ids", IDENTIFIER),
    ("tesla_phase1b_search_log_v0_1", "execution_id", "evidence_ids", IDENTIFIER),
]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed fields with its position."""
    return reduce(DataFrame.unionByName, [unpack(load(spark, sf_dir, table, key, field), key, field, table, starts) for table, key, field, starts in PACKED])


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = load(spark, sf_dir, "tesla_phase1b_evidence_v0_1", "evidence_id", "parent_evidence_id")
    edges = load(spark, sf_dir, "tesla_phase1b_provenance_edges_v0_1", "child_evidence_id", "parent_evidence_id")
    return provenance_trees(evidence, edges)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and path of every evidence id; ids on or below a loop marked by depth -1."""
    return _trees(spark, sf_dir).select(F.col("node").alias("evidence_id"), F.col("root").alias("root_evidence_id"), "depth", F.col("path").alias("node_path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with the number of links between them."""
    return descendants(cut(_trees(spark, sf_dir))).select(F.col("ancestor").alias("evidence_id"), F.col("node").alias("descendant_id"), "distance")


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_descendants": p4_descendants}

_LINKS = """
links AS (SELECT DISTINCT child, parent FROM (
  SELECT nullif(upper(regexp_replace(evidence_id, '^\\s+|\\s+$', '', 'g')), '') AS child,
         nullif(upper(regexp_replace(parent_evidence_id, '^\\s+|\\s+$', '', 'g')), '') AS parent FROM tesla_phase1b_evidence_v0_1
  UNION ALL
  SELECT nullif(upper(regexp_replace(child_evidence_id, '^\\s+|\\s+$', '', 'g')), ''),
         nullif(upper(regexp_replace(parent_evidence_id, '^\\s+|\\s+$', '', 'g')), '') FROM tesla_phase1b_provenance_edges_v0_1)),
ids AS (SELECT child AS id FROM links WHERE child IS NOT NULL UNION SELECT parent FROM links WHERE parent IS NOT NULL),
real_links AS (SELECT * FROM links WHERE child IS NOT NULL AND parent IS NOT NULL),
walk(id, root, depth, path) AS (
  SELECT id, id, 0, id FROM ids WHERE id NOT IN (SELECT child FROM real_links)
  UNION ALL
  SELECT l.child, w.root, w.depth + 1, w.path || '/' || l.child FROM walk w JOIN real_links l ON l.parent = w.id)
"""

SQL = {
    "p4_found": f"""WITH RECURSIVE {_LINKS}
SELECT i.id AS evidence_id, coalesce(w.root, '') AS root_evidence_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, coalesce(w.path, '') AS node_path
FROM ids i LEFT JOIN walk w ON w.id = i.id""",
    "p4_descendants": f"""WITH RECURSIVE {_LINKS},
parts AS (SELECT id, depth, unnest(string_split(path, '/')) AS ancestor, generate_subscripts(string_split(path, '/'), 1) AS i FROM walk)
SELECT ancestor AS evidence_id, id AS descendant_id, CAST(depth - i + 1 AS INTEGER) AS distance FROM parts WHERE i <= depth""",
}
# The twin cuts where a value begins, and takes off a value's own wrappers afterwards.
_VALUE = {ADDRESS: r"https?://", IDENTIFIER: r"(?:EVID|PF)-"}
_UNPACKED = r"""SELECT '@table' AS source_table, source_key, '@field' AS field_name, CAST(i AS INTEGER) AS value_position,
  CASE WHEN lead LIKE '%"' AND v LIKE '%"' OR lead LIKE '%''' AND v LIKE '%''' OR lead LIKE '%(' AND v LIKE '%)' AND len(replace(v, ')', '')) < len(replace(v, '(', ''))
    OR lead LIKE '%[' AND v LIKE '%]' AND v NOT LIKE '%[%' OR lead LIKE '%{' AND v LIKE '%}' AND v NOT LIKE '%{%' THEN v[:-2] ELSE v END AS field_value
FROM (SELECT source_key, i, regexp_extract(x, '^[\["''{(]*') AS lead,
    regexp_replace(CASE WHEN whole OR regexp_matches(x, '^[\[{(]*["'']') THEN y ELSE regexp_replace(y, '(?s)\s.*$', '') END, '[@gap]+$', '') AS v
  FROM (SELECT source_key, whole, i, x, regexp_replace(regexp_replace(x, '^[\["''{(]+', ''), '[@gap]+$', '') AS y
    FROM (SELECT source_key, whole, unnest(xs) AS x, generate_subscripts(xs, 1) AS i
      FROM (SELECT source_key, whole, list_filter(string_split(regexp_replace(t, '(^|[@gap])([\["''{(]*@value)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_matches(x, '^[\["''{(]*@value')) AS xs
        FROM (SELECT source_key, whole, CASE WHEN starts_with(t, '[') AND ends_with(t, ']') AND len(replace(t, '[', '')) = len(replace(t, ']', ''))
                OR starts_with(t, '{') AND ends_with(t, '}') AND len(replace(t, '{', '')) = len(replace(t, '}', '')) THEN t[2:-2] ELSE t END AS t
          FROM (SELECT source_key, q AS whole, CASE WHEN q OR regexp_matches(t, '^"[\[{].*[\]}]"$') THEN t[2:-2] ELSE t END AS t
            FROM (SELECT *, regexp_matches(t, '^"[^"]*"$') OR regexp_matches(t, '^''[^'']*''$') AS q
              FROM (SELECT DISTINCT @key AS source_key, regexp_replace(regexp_replace(@field, '"{2,}', '"', 'g'), '^[@gap]+|[@gap]+$', '', 'g') AS t FROM @table WHERE @field IS NOT NULL))))))))"""


def _unpacked(table: str, key: str, field: str, starts: str) -> str:
    named = {"table": table, "key": key, "field": field, "value": _VALUE[starts], "gap": r";,|、；\s"}
    return reduce(lambda sql, x: sql.replace("@" + x[0], x[1]), named.items(), _UNPACKED)


SQL["p3_found"] = " UNION ALL ".join(_unpacked(*p) for p in PACKED)
