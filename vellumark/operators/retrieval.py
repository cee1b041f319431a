"""Lexical and dense search, sentence selection and reranking, as joins and windows.

Scores are summed in the engine's order, so ranks go by the score rounded to nine places and then by the given tie key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellumark.functions.text import tokens
from vellumark.tables import Cut, join_on_unique

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 1/2) / (df + 1/2))."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturated(tf: Column, length: Column, mean: Column, k1: float = K1, b: float = B) -> Column:
    """Term frequency, saturated and set against the text's length."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


#: Queries (of words, or vectors) sent to the executors at once, and documents scored together.
QUERY_BLOCK, SCORED_TOGETHER = 2_000, 1_000
#: Part of all pairs of a batch's documents and a block's queries from which a word shared by them is summed with others as a product of matrices.
COMMON = 0.03


class Postings:
    """A collection prepared for BM25: (doc, words) of every document, with N and the mean length.

    Without words a document has no posting but counts in N and in the mean length. The same collection serves any number of searches.
    """

    #: Stands for a document as a whole among its words; no token is like it.
    WHOLE = "\x00"

    def __init__(self, docs: DataFrame, doc: str, text: str | None = None, words: Column | None = None):
        self.listed = docs.select(F.col(doc).alias("doc"), F.coalesce(tokens(text) if words is None else words, F.array().cast("array<string>")).alias("words"))

    def search(self, queries: DataFrame, query: str, text: str | None = None, k: int = 10, words: Column | None = None) -> DataFrame:
        """(query, doc, score, rank): the k best documents of each query by BM25; documents without a shared token never appear.

        A query's tokens count once; ties go to the lesser document. Document frequencies are counted for the queries' tokens alone. The
        stated queries go to the executors in blocks of bounded size; documents pass through in Arrow batches, and only each task's k best
        per query leave it, so what is shuffled is tasks × queries × k rows and not every scored pair.
        """
        spark = self.listed.sparkSession
        asked = queries.select(F.col(query).alias("query"), F.array_distinct(tokens(text) if words is None else words).alias("_w")).where("query is not null")
        asked = Cut(asked.select("query", F.explode("_w").alias("token")).distinct()).df
        # one pass counts the documents of each token, all documents and all words
        whole = F.array(F.struct(F.lit(self.WHOLE).alias("token"), F.size("words").alias("length")))
        each = F.concat(F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("token"), F.lit(0).alias("length"))), whole)
        wanted = asked.select("token").union(spark.createDataFrame([(self.WHOLE,)], "token string")).distinct()
        seen = self.listed.select(F.explode(each).alias("x")).select("x.*").join(wanted, "token", "left_semi")
        df = Cut(seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total"))).df
        figures = df.where(F.col("token") == self.WHOLE).first()
        n, mean = (figures["df"], figures["total"] / figures["df"]) if figures else (0, 0.0)
        weighed = asked.join(df, "token").select("query", "token", idf(F.lit(float(n)), F.col("df")).alias("idf"))
        return best_of(self.listed, weighed, mean, k)


def best_of(listed: DataFrame, weighed: DataFrame, mean: float, k: int) -> DataFrame:
    """(query, doc, score, rank): the k documents of listed (doc, words; with fields also weights, length) that score best for each query.

    weighed: (query, token, idf). The queries go to the executors in blocks of bounded size, every document passes by in Arrow batches.
    """
    spark, weighed = listed.sparkSession, Cut(weighed).df
    kind = weighed.schema["query"].dataType
    blocks = max(1, -(-weighed.select("query").distinct().count() // QUERY_BLOCK))
    schema = T.StructType([T.StructField("query", kind), T.StructField("doc", listed.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    out = None
    for b in range(blocks):
        part = weighed if blocks == 1 else weighed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        rows = part.collect()
        ids = sorted({r["query"] for r in rows})
        number = {q: i for i, q in enumerate(ids)}
        lists: dict[str, tuple[list[int], float]] = {}
        for r in rows:
            lists.setdefault(r["token"], ([], r["idf"]))[0].append(number[r["query"]])
        held = spark.sparkContext.broadcast((ids, {t: (np.array(q, np.int32), w) for t, (q, w) in lists.items()}))
        got = listed.mapInArrow(_scorer(held, mean, k, kind), schema)
        out = got if out is None else out.unionByName(got)
    return top(out, ["query"], [F.desc("score"), F.asc("doc")], k)


def _scorer(held, mean: float, k: int, query_type: T.DataType):
    """A map over Arrow batches (doc, words, or doc, words, weights, length) to a task's k best (query, doc, score) of a block of queries.

    A batch's words are told apart once. What most documents and queries share is summed as one product of matrices (COMMON of all their pairs or
    more); each other word adds its weight to all its documents and queries at a time.
    """

    def scores(batch: pa.RecordBatch, lists: dict, n: int) -> np.ndarray:
        out = np.zeros((batch.num_rows, n))
        words = batch.column(1)
        encoded = pc.list_flatten(words).dictionary_encode()
        known = encoded.dictionary.to_pylist()
        hit = np.array([w in lists for w in known], bool)
        if not hit.any():
            return out
        codes, parent = encoded.indices.to_numpy(zero_copy_only=False), pc.list_parent_indices(words).to_numpy()
        keep = hit[codes]
        pairs, place, tf = np.unique(codes[keep].astype(np.int64) * batch.num_rows + parent[keep], return_inverse=True, return_counts=True)
        length = pc.fill_null(pc.list_value_length(words) if batch.num_columns == 2 else batch.column(3), 0).to_numpy(zero_copy_only=False)
        if batch.num_columns > 2:
            tf = np.bincount(place, pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False)[keep], len(pairs))
        doc = pairs % batch.num_rows
        base = K1 * (1 - B + B * length / mean) if mean else np.full(batch.num_rows, K1)
        weight = tf * (K1 + 1) / (tf + base[doc])
        word, starts = np.unique(pairs // batch.num_rows, return_index=True)
        ends = np.append(starts[1:], len(pairs))
        asked = np.array([len(lists[known[w]][0]) for w in word])
        common = np.flatnonzero((ends - starts) * asked >= COMMON * batch.num_rows * n)
        if len(common):
            left, right = np.zeros((batch.num_rows, len(common))), np.zeros((len(common), n))
            for i, c in enumerate(common):
                queries, idf_ = lists[known[word[c]]]
                left[doc[starts[c] : ends[c]], i], right[i, queries] = weight[starts[c] : ends[c]], idf_
            out += left @ right
        for w, a, z in zip(*(np.delete(x, common) for x in (word, starts, ends)), strict=True):
            queries, idf_ = lists[known[w]]
            out[doc[a:z, None], queries] += weight[a:z, None] * idf_
        return np.round(out, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists = held.value
        names, best = pa.array(ids, to_arrow_type(query_type)), None
        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for at in range(0, whole.num_rows, SCORED_TOGETHER):
                batch = whole.slice(at, SCORED_TOGETHER)
                s, d = scores(batch, lists, len(ids)), np.array(batch.column(0).to_pylist())
                place = np.argsort(d, kind="stable")
                first = np.argsort(-s[place], axis=0, kind="stable")[:k]
                s, d = np.take_along_axis(s[place], first, 0), d[place][first]
                if best is not None:
                    s, d = np.concatenate([best[0], s]), np.concatenate([best[1], d])
                    order = np.lexsort((d, -s), axis=0)[:k]
                    s, d = np.take_along_axis(s, order, 0), np.take_along_axis(d, order, 0)
                best = s, d
        if best is not None and len(ids):
            row, query = np.nonzero(best[0])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query, pa.int64())), pa.array(best[1][row, query].tolist(), kind), pa.array(best[0][row, query])], names=["query", "doc", "score"])

    return run


def top(df: DataFrame, per: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """df with a rank from 1 in each group, cut to k rows a group where k is given."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col(rank) <= k)


def select_sentences(pairs: DataFrame, query: str, sentence_list: str, keys: list[str], k: int = 3) -> DataFrame:
    """(keys, index, text, score, rank): the k best sentences of each document for its query, by BM25 among that document's sentences.

    pairs: keys, the query's text and an array of sentences. Where no sentence shares a token, the first k come with score 0.
    """
    each = pairs.select(*keys, F.array_distinct(tokens(query)).alias("_q"), F.posexplode(sentence_list).alias("index", "text"))
    each = each.withColumn("_t", tokens("text"))
    whole = Window.partitionBy(*keys)
    sized = each.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_mean", F.avg(F.size("_t")).over(whole))
    hits = sized.select(*keys, "index", "_n", "_mean", F.size("_t").alias("_len"), F.explode(F.filter("_t", lambda t: F.array_contains("_q", t))).alias("_tok"))
    tf = hits.groupBy(*keys, "index", "_tok").agg(F.count(F.lit(1)).alias("tf"), F.max("_n").alias("_n"), F.max("_mean").alias("_mean"), F.max("_len").alias("_len"))
    df = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_tok"))
    part = tf.withColumn("_s", idf(F.col("_n"), df) * saturated(F.col("tf"), F.col("_len"), F.col("_mean")))
    score = part.groupBy(*keys, "index").agg(F.round(F.sum("_s"), 9).alias("_score"))
    joined = each.select(*keys, "index", "text").join(score, [*keys, "index"], "left")
    best = joined.withColumn("_best", F.max("_score").over(whole))
    kept = best.where("_score > 0 or _best is null").withColumn("score", F.coalesce("_score", F.lit(0.0)))
    return top(kept, keys, [F.desc("score"), F.asc("index")], k).select(*keys, "index", "text", "score", "rank")


def rerank(candidates: DataFrame, query: str, keys: list[str], owner: str, sentence_list: str, order: str, k: int) -> DataFrame:
    """(keys, owner, score, rank): a query's candidates by their best sentence, in one BM25 index over all candidates' sentences.

    Candidates whose sentences share nothing keep their place behind the others, by `order`; a candidate that repeats counts once.
    """
    candidates = candidates.select(*dict.fromkeys([*keys, owner, order, query, sentence_list])).distinct()
    # a query may have any number of candidates: its figures are sums of map-side sums, joined back with hot keys salted
    one = F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys))
    each = candidates.select(*keys, owner, one.alias("_key"), F.array_distinct(tokens(query)).alias("_q"), F.posexplode_outer(sentence_list).alias("_i", "_text"))
    each = Cut(each.withColumn("_t", tokens("_text")).drop("_text")).df
    figures = each.groupBy("_key").agg(F.count("_i").alias("_n"), (F.sum(F.size("_t")) / F.greatest(F.count("_i"), F.lit(1))).alias("_mean"))
    hits = each.select(*keys, owner, "_key", "_i", F.size("_t").alias("_len"), F.explode(F.filter("_t", lambda t: F.array_contains("_q", t))).alias("_tok"))
    tf = hits.groupBy(*keys, owner, "_key", "_i", "_tok").agg(F.count(F.lit(1)).alias("tf"), F.max("_len").alias("_len")).withColumn("_pair", F.sha2(F.concat_ws("\x1f", F.col("_key").cast("string"), "_tok"), 256))
    tf = Cut(tf).df
    df = tf.groupBy("_pair").agg(F.count(F.lit(1)).alias("_df"))
    counted = join_on_unique(join_on_unique(tf, df, "_pair"), figures, "_key")
    part = counted.withColumn("_s", idf(F.col("_n"), F.col("_df")) * saturated(F.col("tf"), F.col("_len"), F.col("_mean")))
    per = part.groupBy(*keys, owner, "_i").agg(F.sum("_s").alias("_s")).groupBy(*keys, owner).agg(F.round(F.max("_s"), 9).alias("score"))
    joined = candidates.select(*dict.fromkeys([*keys, owner, order])).join(per, [*keys, owner], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return top(joined, keys, [F.desc("score"), F.asc(order)], k).select(*keys, owner, "score", "rank")


def fielded_search(docs: DataFrame, doc: str, fields: dict[str, float], texts: dict[str, Column], queries: DataFrame, query: str, text: str, k: int) -> DataFrame:
    """(query, doc, score, rank): BM25 over several fields, each with its weight; a document's length is that of all fields together."""
    words = {name: F.coalesce(tokens(texts[name]), F.array().cast("array<string>")) for name in fields}
    each = docs.select(F.col(doc).alias("doc"), *(w.alias("_" + name) for name, w in words.items()))
    weights = F.concat(*(F.array_repeat(F.lit(float(w)), F.size("_" + name)) for name, w in fields.items()))
    listed = each.select("doc", F.concat(*("_" + name for name in fields)).alias("words"), weights.alias("weights")).withColumn("length", F.size("words"))
    asked = Cut(queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(text))).alias("token")).where("query is not null").distinct()).df
    figures = listed.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    seen = listed.select(F.explode(F.array_distinct("words")).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    df = seen.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "token").select("query", "token", idf(F.lit(float(figures["n"])), F.col("df")).alias("idf"))
    return best_of(listed, weighed, figures["mean"] or 0.0, k)


def search_index(spark: SparkSession, path: str, queries: DataFrame, query: str, text: str, weights: dict[str, float], k: int) -> DataFrame:
    """(query, doc, score, rank): fielded_search over an index that sinks.write_index wrote: only the buckets of the queries' tokens are read;
    each document's postings of them are scored together against blocks of queries. Fields without a weight don't count; an index of no documents finds nothing."""
    figures = spark.read.parquet(f"{path}/figures").first()
    n, mean = figures["n"], sum(figures["mean_" + f] or 0.0 for f in weights)
    asked = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(text))).alias("token")).where("query is not null").distinct()
    asked = Cut(asked.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(figures["buckets"])).cast("int"))).df
    read = [r[0] for r in asked.select("bucket").distinct().collect()]  # as many as the index has at most
    weight = F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, float(w))))
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(read) & F.col("field").isin(list(weights)))
    held = postings.join(asked.select("bucket", "token").distinct(), ["bucket", "token"], "left_semi").groupBy("doc", "token").agg(F.sum(F.col("tf") * weight[F.col("field")]).alias("tf"))
    lengths = spark.read.parquet(f"{path}/documents").select("doc", sum((F.col("length_" + f) for f in weights), F.lit(0)).alias("length"))
    # a document's postings come together, so that only its k best places leave a task and not every scored pair
    listed = held.groupBy("doc").agg(F.collect_list(F.struct("token", "tf")).alias("x")).join(lengths, "doc").select("doc", F.col("x.token").alias("words"), F.col("x.tf").alias("weights"), "length")
    listed = Cut(listed).df
    df = listed.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = asked.join(df, "token").select("query", "token", idf(F.lit(float(n)), F.col("df")).alias("idf"))
    return best_of(listed, weighed, mean, k)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def dense_search(docs: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, positive: bool = True, with_self: bool = False) -> DataFrame:
    """(query, doc, score, rank): the k documents with the greatest cosine, above 0 if `positive`.

    The stated queries go to the executors in blocks of bounded size; every document is compared with a block as matrices, and only each
    Arrow batch's k best per query leave it, so what is shuffled is batches × queries × k, not documents × queries.
    """
    spark = docs.sparkSession
    kept = queries.select(F.col(query).cast("long").alias("q"), F.col(query_vector).alias("v")).where("q is not null and v is not null")
    blocks = max(1, -(-kept.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        ids = np.array([r["q"] for r in rows], np.int64)
        matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
        held = spark.sparkContext.broadcast((ids, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)))

        def run(batches, held=held):
            ids, matrix = held.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                own = batch.column(0).to_numpy(zero_copy_only=False)
                vectors = np.array(batch.column(1).to_pylist(), np.float64)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                score = np.round(matrix @ vectors.T, 9)
                q, d, s = [], [], []
                for i in range(len(ids)):
                    ok = np.flatnonzero((score[i] > 0 if positive else np.ones(len(own), bool)) & ((own != ids[i]) | with_self))
                    best = ok[np.lexsort((own[ok], -score[i][ok]))[:k]]
                    q += [ids[i]] * len(best)
                    d += own[best].tolist()
                    s += score[i][best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=["query", "doc", "score"])

        part = docs.select(F.col(doc).cast("long").alias("doc"), vector).where(F.col(vector).isNotNull()).mapInArrow(run, "query long, doc long, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, ["query"], [F.desc("score"), F.asc("doc")], k)


def take_matching(ranked: DataFrame, per: list[str], order: list[Column], counts: DataFrame, n: str) -> DataFrame:
    """As many of each group's rows, best first, as another policy answered there: coverage is matched, not thresholds."""
    placed = top(ranked, per, order, None, "_place")
    return placed.join(counts.select(*per, n), per).where(F.col("_place") <= F.col(n)).drop("_place", n)


def capital_runs(tokens_df: DataFrame, keys: list[str], position: str, token: str) -> DataFrame:
    """(keys, start, end, run): maximal runs of tokens that begin with a capital letter; end is exclusive."""
    capital = tokens_df.where(F.col(token).rlike(r"^\p{Lu}"))
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return capital.withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, token))), lambda x: x[token]), " ").alias("run")
    ).drop("_island")


def best_span(tokens_df: DataFrame, keys: list[str], position: str, p: str, least: float) -> DataFrame:
    """(keys, start, end, score): of the contiguous runs with p >= least, the one with the greatest mean p; ties go to the first."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    runs = tokens_df.where(F.col(p) >= least).withColumn("_island", island).groupBy(*keys, "_island").agg(
        F.min(position).alias("start"), (F.max(position) + 1).alias("end"), F.round(F.avg(p), 9).alias("score")
    )
    return top(runs, keys, [F.desc("score"), F.asc("start")], 1).select(*keys, "start", "end", "score")


def neighbours(tokens_df: DataFrame, keys: list[str], position: str, token: str, reach: int = 2, edge: str = "<BOUNDARY>") -> DataFrame:
    """Each token with those up to `reach` places before and after it, and its shape: capital, number or other."""
    w = Window.partitionBy(*keys).orderBy(position)
    shifted = [F.lag(token, i, edge).over(w).alias(f"before_{i}") for i in range(1, reach + 1)] + [F.lead(token, i, edge).over(w).alias(f"after_{i}") for i in range(1, reach + 1)]
    shape = F.when(F.col(token).rlike(r"^[0-9]+$"), F.lit("number")).when(F.col(token).rlike(r"^\p{Lu}"), F.lit("capital")).otherwise(F.lit("other"))
    return tokens_df.select(*keys, position, token, shape.alias("shape"), *shifted)
