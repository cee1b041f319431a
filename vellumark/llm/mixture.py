"""Mixing sources to target weights, in tokens of a public tokenizer.

Method: hierarchical budgeting. A mixture's tokens are shared out down a tree of domains, languages and sources, where a source's
weight is spread over its languages as its tokens are; what a node can't supply, even with its documents repeated as often as allowed,
goes to its siblings first and only then to its parent's siblings. A leaf takes whole seeded epochs of its documents and then the prefix of one more epoch that comes nearest its budget.
Only the tree (targets and their languages) reaches the driver. An epoch's prefix is found from token sums of hash ranges, so no leaf is
ordered as a whole in one task.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumark.tables import Cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer's text is cut before its pairs are merged (a fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGES = 1024
#: The domain of each of this project's sources.
DOMAINS = {
    "page_capture": "web", "reader_forum": "web", "newspaper_ocr": "scan", "letter_scan": "scan", "fact_check": "reference", "encyclopedia": "reference", "patent_text": "reference",
    "finding_aid": "collection", "museum_label": "collection", "auction_list": "collection", "lecture_transcript": "speech", "oral_history": "speech",
}


#: The encoder that this worker process built last, by the broadcast it was built from.
_CODERS: dict[str, object] = {}


def _coder(token: str, vocabulary: bytes):
    if token not in _CODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _CODERS.clear()
        _CODERS[token] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[token]


def with_tokens(df: DataFrame, text: str, name: str = "n_tokens", vocabulary: str = TOKENIZER) -> DataFrame:
    """df with the number of tokens of a text column, which itself is dropped; null counts 0, texts are counted whole.

    The vocabulary file (some 50,000 entries) is read on the driver and sent to the executors, which need no copy of it.
    """
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).withColumn(name, F.lit(0).cast("long")).schema
    with open(vocabulary, "rb") as f:
        held, token = df.sparkSession.sparkContext.broadcast(f.read()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(token, held.value)
        for b in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(counts, pa.int64())], names=[*kept, name])

    return df.select(*kept, text).mapInArrow(run, schema)


def language_code(c: str) -> F.Column:
    """Two small letters of a language code, 'und' where there is none."""
    code = F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).substr(1, 2)
    return F.when(code.rlike("^[a-z]{2}$"), code).otherwise(F.lit("und"))


def share_out(amount: float, nodes: list[tuple[float, float]]) -> list[float]:
    """Shares `amount` among nodes (weight, capacity) by weight; a full node's rest goes to the others by weight.

    Nodes of weight 0 take part only once all others are full, by capacity. The result sums to min(amount, all capacity).
    """
    given = [0.0] * len(nodes)
    for weights in ([w for w, _ in nodes], [c if w == 0 else 0.0 for w, c in nodes]):
        left = min(amount, sum(c for _, c in nodes)) - sum(given)
        free = [i for i, w in enumerate(weights) if w > 0 and given[i] < nodes[i][1]]
        while left > 1e-6 and free:
            total = sum(weights[i] for i in free)
            over = [i for i in free if given[i] + left * weights[i] / total >= nodes[i][1] - 1e-9]
            for i in over or free:
                given[i] = nodes[i][1] if over else given[i] + left * weights[i] / total
            left = min(amount, sum(c for _, c in nodes)) - sum(given) if over else 0.0
            free = [i for i in free if i not in over]
    return given


def weighted(tree: dict) -> dict:
    """tree, {name: {name: ... {name: (weight, capacity)}}}, with each inner node as (sum of its leaves' weights, subtree)."""

    def up(x) -> tuple[float, object]:
        if isinstance(x, tuple):
            return x
        sub = {name: up(y) for name, y in x.items()}
        return sum(w for w, _ in sub.values()), sub

    return up(tree)[1]


def budgets(tree: dict, amount: float) -> dict[tuple, float]:
    """Budget of each leaf. tree: {name: (weight, subtree)} or, at a leaf, {name: (weight, capacity)}.

    A node's capacity is that of its leaves, so its shortage is shared by its siblings before its parent's siblings.
    """

    def capacity(x) -> float:
        return sum(capacity(sub) for _, sub in x.values()) if isinstance(x, dict) else x

    out: dict[tuple, float] = {}

    def down(x, amount: float, path: tuple) -> None:
        if not isinstance(x, dict):
            out[path] = amount
            return
        parts = share_out(amount, [(w, capacity(sub)) for w, sub in x.values()])
        for (name, (_, sub)), part in zip(x.items(), parts, strict=True):
            down(sub, part, (*path, name))

    down(tree, amount, ())
    return out


class Mixture:
    """Documents drawn for each mixture of a target table, and the shares they reach.

    documents: doc_id, text, source, lang (others ignored); targets: mixture_id, source, target_share, max_repeats. Documents without
    text are never drawn, nor those of sources without a target; a null source is none. A mixture's size is `total_tokens`, or the part
    `fill` of all that its sources can supply, or by default the most that lets every source that has documents reach its share. A source
    that `domains` doesn't name is a domain of its own. Empty tables give no rows.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, fill: float | None = None, seed: int = 11, vocabulary: str = TOKENIZER, domains: dict[str, str] | None = None
    ):
        domains = DOMAINS if domains is None else domains
        wanted = targets.where("source is not null").select("source").distinct()
        own = documents.select("doc_id", "source", language_code("lang").alias("lang"), "text").where("text <> ''").join(wanted, "source", "left_semi")
        self.sized = Cut(with_tokens(own, "text", vocabulary=vocabulary).where("n_tokens > 0")).df
        self.seed = seed
        leaves: dict[str, dict[str, int]] = {}
        for r in self.sized.groupBy("source", "lang").agg(F.sum("n_tokens").alias("t")).orderBy("source", "lang").collect():
            leaves.setdefault(r["source"], {})[r["lang"]] = r["t"]
        mixtures: dict[str, list] = {}
        for r in targets.where("mixture_id is not null and source is not null").orderBy("mixture_id", "source").collect():
            mixtures.setdefault(r["mixture_id"], []).append((r["source"], r["target_share"] or 0.0, max(r["max_repeats"] or 0, 0)))
        plan, self.targets = [], targets
        for mixture, rows in mixtures.items():
            supply = {s: sum(leaves.get(s, {}).values()) for s, _, _ in rows}
            tree: dict[str, dict[str, dict[str, tuple[float, float]]]] = {}
            for s, w, most in rows:
                for lang, t in leaves.get(s, {}).items():
                    tree.setdefault(domains.get(s, s), {}).setdefault(lang, {})[s] = (w * t / supply[s], float(t * most))
            if total_tokens is not None:
                amount = total_tokens
            elif fill is not None:
                amount = fill * sum(supply[s] * most for s, _, most in rows)
            else:
                amount = min((supply[s] * most / w for s, w, most in rows if w > 0 and supply[s] and most), default=0.0)
            most_of = {s: most for s, _, most in rows}
            for (_, lang, source), budget in budgets(weighted(tree), amount).items():
                tokens = leaves[source][lang]
                full = min(int((budget + 0.5) // tokens), most_of[source])
                plan.append((mixture, source, lang, full, float(budget - full * tokens) if full < most_of[source] else 0.0))
        self.plan = documents.sparkSession.createDataFrame(plan, "mixture_id string, source string, lang string, epochs int, rest double")

    def drawn(self) -> DataFrame:
        """(mixture_id, doc_id, source, lang, n_tokens, repeats) of every document drawn at least once."""
        leaf, out = ["mixture_id", "source", "lang"], ["mixture_id", "doc_id", "source", "lang", "n_tokens"]
        # leaves of whole epochs need no order
        whole = self.sized.join(self.plan.where("rest <= 0 and epochs > 0"), ["source", "lang"]).select(*out, F.col("epochs").alias("repeats"))
        rows = self.sized.join(self.plan.where("rest > 0"), ["source", "lang"])
        h = F.xxhash64(F.lit(self.seed), "mixture_id", "epochs", "doc_id")
        rows = rows.withColumn("_h", h).withColumn("_part", F.pmod(F.shiftright("_h", 32), F.lit(RANGES)))
        sums = rows.groupBy(*leaf, "_part").agg(F.sum("n_tokens").alias("_t"))
        upto = F.sum("_t").over(Window.partitionBy(*leaf).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        starts = sums.withColumn("_end", upto).select(*leaf, "_part", (F.col("_end") - F.col("_t")).alias("_start"), "_end")
        placed = rows.join(starts, [*leaf, "_part"])
        sure = placed.where("_end <= rest").withColumn("_in", F.lit(1))
        none = placed.where("_end > rest and _start >= rest and epochs > 0").withColumn("_in", F.lit(0))
        within = F.sum("n_tokens").over(Window.partitionBy(*leaf, "_part").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        edge = placed.where("_end > rest and _start < rest").withColumn("_in", (F.col("_start") + within - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
        every = sure.unionByName(none).unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("_in"))
        return whole.unionByName(every.where("repeats > 0").select(*out, "repeats"))

    def shares(self) -> DataFrame:
        """(mixture_id, source, target_share, actual_share, n_tokens, n_documents, most_repeats) of every target."""
        per = self.drawn().groupBy("mixture_id", "source").agg(
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("repeats").alias("most_repeats")
        )
        joined = self.targets.select("mixture_id", "source", "target_share").join(per, ["mixture_id", "source"], "left")
        total = F.sum("n_tokens").over(Window.partitionBy("mixture_id"))
        return joined.select("mixture_id", "source", "target_share", (F.coalesce("n_tokens", F.lit(0)) / total).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
