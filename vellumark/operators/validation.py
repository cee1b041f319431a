"""Rules over records: every broken rule is named in an array, and rows are never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumark.functions.text import split_ids, text

# The words that records may use.
CONFIDENCES = ["low", "medium", "high"]
SIGNALS = ["explicit_citation", "shared_wording", "chronology", "shared_error", "archive_metadata", "near_duplicate", "same_url_target", "content_comparison"]
AUTHENTICATING = "authenticating_source_located"


def broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that don't hold; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def filled(c: str) -> Column:
    return F.trim(text(c)) != ""


def is_date(c: str) -> Column:
    """A day that exists, as YYYY-MM-DD."""
    return F.try_to_timestamp(text(c), F.lit("yyyy-MM-dd")).isNotNull() & text(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def is_instant(c: str) -> Column:
    """A time with its zone, as ISO 8601."""
    return text(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")


def matches(c: str, pattern: str) -> Column:
    """Whether the value without outer blanks is wholly of the pattern."""
    return F.trim(text(c)).rlike(f"^(?:{pattern})$")


def as_long(c: str, least: int) -> Column:
    """Whether the text without outer blanks has so many characters."""
    return F.length(F.trim(text(c))) >= least


# How ids, languages and addresses are written.
CLAIM, EVIDENCE, LANGUAGE, ADDRESS = "T369-[0-9]{3,}", "EVID-[0-9]{3,}", "[a-z]{2,3}(?:-[A-Z]{2})?", r"(?s:https?://[^/?#\s]+.*)"


def claim_rules() -> dict[str, Column]:
    return {
        "claim_id": matches("claim_id", "[A-Z0-9][A-Z0-9_-]*"),
        "canonical_claim_id": filled("canonical_claim_id"),
        "claim_text": as_long("claim_text", 10),
        "claimed_person": filled("claimed_person"),
        "language": matches("language", LANGUAGE),
        "verdict_confidence": F.col("verdict_confidence").between(0, 1),
        "sufficiency": text("sufficiency").isin("sufficient", "insufficient"),
        "verdict_matches_sufficiency": (F.col("verdict") == "insufficient") == (F.col("sufficiency") == "insufficient"),
        "source_urls": F.forall(split_ids("source_urls"), lambda u: u.rlike(f"^{ADDRESS}$")),
        "annotator_id": filled("annotator_id"),
    }


def evidence_rules() -> dict[str, Column]:
    free = text("provenance_relation").isin("original", "unknown")
    return {
        "evidence_id": matches("evidence_id", EVIDENCE),
        "claim_id": matches("claim_id", CLAIM),
        "title": filled("title"),
        "publisher_or_archive": filled("publisher_or_archive"),
        "source_url": matches("source_url", ADDRESS),
        "access_date": is_date("access_date"),
        "source_rank": F.col("source_rank").between(1, 5),
        "is_primary": F.col("is_primary").isNotNull(),
        "evidence_summary": as_long("evidence_summary", 10),
        "provenance_family_id": filled("provenance_family_id"),
        "no_self_parent": ~F.coalesce(F.upper(F.trim("parent_evidence_id")) == F.upper(F.trim("evidence_id")), F.lit(False)),
        "copy_has_parent": free | filled("parent_evidence_id"),
        "provenance_confidence": text("provenance_confidence").isin(CONFIDENCES),
        "annotator_id": filled("annotator_id"),
    }


def search_plan_rules() -> dict[str, Column]:
    return {
        "search_id": matches("search_id", "SEARCH-[0-9]{3,}"),
        "claim_id": matches("claim_id", CLAIM),
        "primary_repositories": filled("primary_repositories"),
        "both_queries": filled("exact_query") & filled("fragment_or_concept_query"),
        "date_frozen": is_date("date_frozen"),
        "assigned_to": filled("assigned_to"),
    }


def _place(c: str) -> Column:
    return matches(c, r"\+?0*[1-9][0-9]*")


def capture_rules() -> dict[str, Column]:
    """Rules of captured sources: where they come from, and where their bytes lie under data/raw with which digest."""
    path = F.trim(text("private_relative_path"))
    return {
        "capture_id": matches("capture_id", "CAP-[0-9]{3,}"),
        "claim_id": matches("claim_id", CLAIM),
        "evidence_id": matches("evidence_id", EVIDENCE),
        "source_url": matches("source_url", ADDRESS) & text("source_url").rlike(r"^\s*https:"),
        "source_date": is_date("source_date"),
        "article_title": as_long("article_title", 5),
        "printed_page": _place("printed_page"),
        "column": _place("column"),
        "private_relative_path": path.rlike(r"^(?:\./)*data/+(?:\./+)*raw(?:/|$)") & ~path.rlike(r"(^|/)\.\.(/|$)"),
        "sha256": matches("sha256", "[0-9a-fA-F]{64}"),
    }


def review_rules() -> dict[str, Column]:
    """Rules of human reviews: ids that agree, texts that are there in both languages, and evidence that is named."""
    ids = lambda c, pattern: (F.size(split_ids(c)) > 0) & F.forall(split_ids(c), lambda x: x.rlike(f"^(?:{pattern})$"))
    return {
        "review_id": matches("review_id", "REVIEW-T369-[0-9]{3,}-[AB]"),
        "claim_id": matches("claim_id", CLAIM),
        "ids_agree": F.contains(text("review_id"), F.trim(text("claim_id"))) & filled("claim_id"),
        "reviewer_code": matches("reviewer_code", "R[AB]-[A-Z0-9]{4,}"),
        "review_date": is_date("review_date"),
        "canonical_claim": as_long("canonical_claim", 20),
        "source_url": matches("source_url", ADDRESS) & text("source_url").rlike(r"^\s*https:"),
        "source_identifier": as_long("source_identifier", 10),
        "article_title": as_long("article_title", 5),
        "source_date": is_date("source_date"),
        "printed_page": _place("printed_page"),
        "column": _place("column"),
        "serbian_transcription": as_long("serbian_transcription", 40) & text("serbian_transcription").rlike("[А-Яа-я]"),
        "literal_translation": as_long("literal_translation", 20),
        "normalized_english": as_long("normalized_english", 20),
        "verdict_matches_sufficiency": (F.col("verdict") == "insufficient") == (F.col("sufficiency") == "insufficient"),
        "confidence": F.col("confidence").try_cast("double").between(0, 1),
        "decisive_evidence_ids": ids("decisive_evidence_ids", EVIDENCE),
        "provenance_family_ids": ids("provenance_family_ids", "PF-[A-Z0-9-]+"),
        "rationale": as_long("rationale", 80),
        "frozen_at_utc": is_instant("frozen_at_utc"),
    }


def search_rules() -> dict[str, Column]:
    return {
        "execution_id": text("execution_id").rlike("^RUN-[0-9]+$"),
        "query_text": filled("query_text"),
        "executed_at_utc": is_instant("executed_at_utc"),
        "authenticating_status": F.col("authenticating_result") == (F.col("result_status") == AUTHENTICATING),
    }


def edge_rules(signals: list[str] = SIGNALS) -> dict[str, Column]:
    s = F.array_distinct(split_ids("dependency_signals"))
    return {
        "edge_id": text("edge_id").rlike("^EDGE-[0-9]+$"),
        "two_ends": filled("child_evidence_id") & filled("parent_evidence_id"),
        "no_loop": ~F.coalesce(F.upper(F.trim("child_evidence_id")) == F.upper(F.trim("parent_evidence_id")), F.lit(False)),
        "two_signals": F.size(s) >= 2,
        "known_signals": F.size(F.array_except(s, F.array(*map(F.lit, signals)))) == 0,
        "confidence": text("confidence").isin(CONFIDENCES),
    }


def verdict_rules() -> dict[str, Column]:
    return {
        "claim_id": text("claim_id").rlike("^T369-[0-9]+$"),
        "verdict_confidence": F.col("verdict_confidence").between(0, 1),
        "annotation_date": is_date("annotation_date"),
        "review_needed": F.col("requires_human_review") | (F.col("label_status") != "machine_assisted_provisional"),
        "insufficient_says_why": (F.col("sufficiency") != "insufficient") | filled("missing_evidence"),
    }


def validate(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, errors) of every distinct row; a key that stands for several different rows also breaks 'unique_key'."""
    rows = df.distinct()
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.lit("unique_key").alias("_dup"))
    named = rows.select(key, broken(rules).alias("errors"))
    return named.join(many, key, "left").select(key, F.array_compact(F.concat("errors", F.array("_dup"))).alias("errors"))


def orphans(df: DataFrame, key: Column, parent: DataFrame, parent_key: Column) -> DataFrame:
    """Rows of df whose key no parent row has; null and blank keys are orphans of none."""
    p = parent.select(parent_key.alias("_k")).where("_k is not null").distinct()
    return df.withColumn("_k", key).where("_k is not null and _k <> ''").join(p, "_k", "left_anti").drop("_k")


def valid_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Whether probabilities are finite, in [0, 1], and sum to 1."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= tolerance), F.lit(False))


def rescaled(p: Column, tolerance: float = 1e-3) -> Column:
    """Probabilities divided by their sum if that is 1 within the tolerance, else null."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.abs(total - 1) <= tolerance, F.transform(p, lambda x: x / total))


def align(a: DataFrame, b: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """(n_both, n_left_only, n_right_only, n_unequal): how two tables match one to one on their keys and agree in `equal`."""
    left = a.select(*keys, *(F.col(c).alias("_l_" + c) for c in equal)).withColumn("_l", F.lit(True))
    right = b.select(*keys, *(F.col(c).alias("_r_" + c) for c in equal)).withColumn("_r", F.lit(True))
    j = left.join(right, keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    same = F.lit(True)
    for c in equal:
        same = same & F.col("_l_" + c).eqNullSafe(F.col("_r_" + c))
    return j.agg(F.count_if(both).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"), F.count_if(both & ~same).alias("n_unequal"))


def manifest_audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): every listed file as unsafe_path, bad_digest, missing, changed or ok.

    manifest: (path, sha256); files: (path, sha256) of what is there.
    """
    unsafe = F.col("path").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") | (F.trim("path") == "")
    j = manifest.select("path", F.lower("sha256").alias("_want")).join(files.select("path", F.lower("sha256").alias("_have")), "path", "left")
    status = F.when(unsafe, F.lit("unsafe_path")).when(~F.coalesce(F.col("_want").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad_digest")).when(F.col("_have").isNull(), F.lit("missing")).when(F.col("_have") != F.col("_want"), F.lit("changed")).otherwise(F.lit("ok"))
    return j.select("path", status.alias("status"))


def expected_keys(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """(keys, problem): keys that are missing, unexpected or there more than once."""
    have = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    want = expected.select(*keys).distinct().withColumn("_w", F.lit(True))
    j = have.join(want, keys, "full")
    problem = F.when(F.col("_n").isNull(), F.lit("missing")).when(F.col("_w").isNull(), F.lit("unexpected")).when(F.col("_n") > 1, F.lit("repeated"))
    return j.select(*keys, problem.alias("problem")).where("problem is not null")


def json_leaves(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): every leaf of a JSON text with its path. Text that isn't JSON gives no rows.

    The texts' depth is unknown beforehand, which built-in functions can't walk, so Arrow batches are walked in Python.
    """
    import json as parser

    import pyarrow as pa

    def walk(path: str, v):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(f"{path}.{k}", x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(f"{path}[{i}]", x)
        else:
            yield path, parser.dumps(v, ensure_ascii=False)

    def run(batches):
        for b in batches:
            take, paths, values = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                try:
                    found = list(walk("$", parser.loads(t))) if t else []
                except ValueError:
                    found = []
                for p, v in found:
                    take.append(i)
                    paths.append(p)
                    values.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int32())), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[key, "path", "value"])

    return df.select(key, json).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, path string, value string")


def json_differences(a: DataFrame, b: DataFrame, key: str, json: str, tolerance: float = 1e-5) -> DataFrame:
    """(key, path, left, right): leaves that only one side has or that differ; numbers may differ by the tolerance, true is not 1."""
    left = json_leaves(a, key, json).withColumnRenamed("value", "left")
    right = json_leaves(b, key, json).withColumnRenamed("value", "right")
    j = left.join(right, [key, "path"], "full")
    number = "^-?[0-9.]+([eE][+-]?[0-9]+)?$"
    near = F.col("left").rlike(number) & F.col("right").rlike(number) & (F.abs(F.col("left").try_cast("double") - F.col("right").try_cast("double")) <= tolerance)
    return j.where(~(F.col("left").eqNullSafe(F.col("right")) | F.coalesce(near, F.lit(False))))
