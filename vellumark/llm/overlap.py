"""Same or near-same records across splits.

Method: Aho–Corasick automata over sharded, normalised evaluation passages scan all training claims. A claim's normal form is
its distinct words in one order of all words (a hash's). Two claims of which the shorter part of all words differs, d words at
most, have one of any d + 1 consecutive passages of the evaluation claim in common, word for word: so each evaluation claim is
cut into so many passages, and a training claim in which none is found can't be similar enough. The matched intervals
are merged into the part of the evaluation claim that is covered, and the words of both claims decide.

A passage belongs to the shard of its first words (KEY at most), and a training claim goes to the shards of those of its runs of words that
some passage begins with: a Bloom filter over the beginnings tells, so what is sent grows with the claims that passages may stand in and not
with the shards. The training table is read once however many shards there are. Passages and claims of a shard
come sorted through one shuffle; a task builds the automaton from the passages and streams the claims past it, and the claims
of a large shard are spread over several copies of its passages, never so many that more passages than claims are sent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumark.llm.consistent import with_consistent
from vellumark.tables import Cut

#: Passages in one automaton, on average; training claims that one copy of it scans.
SHARD, SCANNED = 150_000, 50_000
#: Words of a passage's beginning that decide its shard; 64-bit slots of the filter over all beginnings at most, and its bits per passage.
KEY, MOST_SLOTS, BITS = 4, 1 << 23, 24
#: A word in more than one of FREQUENT_SHARE sets counts as frequent: at most (words per set) x FREQUENT_SHARE words do.
FREQUENT_SHARE = 2_000
#: What the other words of a passage count beside its rarest one; how much rarer than the last frequent word the others are held to be.
OTHERS, RARE = 0.3, 1.6
WORD = re.compile(r"[^\W_]+")


def hash_word(w: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(w)


def word_set(text: str | None) -> str:
    """The distinct words of a text (runs of letters and digits in lower case), in hash order, with single blanks; '' without words."""
    return " ".join(sorted(set(WORD.findall((text or "").lower())), key=lambda w: (hash_word(w), w)))


def word_sets(df: DataFrame, column: str) -> DataFrame:
    """df with a column word_set, made in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(column)).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([word_set(t) for t in texts], pa.string())], names=[*b.schema.names, "word_set"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("word_set", T.StringType())]))


def most_differences(n: int, similarity: float) -> int:
    """Words that may differ between a set of n words and another one that shares `similarity` of all their words."""
    return math.floor(n / similarity - n + 1e-9)


def passages(words: list[str], weight: dict[str, float], usual: float, similarity: float) -> list[tuple[int, int]]:
    """(start, end) of most_differences + 1 consecutive passages that cover all words, so cut that the commonest of them is as rare as can be.

    A passage is as rare as its rarest word, and a little more for the others (OTHERS): words of a set phrase come together. Weights are small
    for frequent words. The least rarity is made as great as possible, by halving.
    """
    count, own = most_differences(len(words), similarity) + 1, [weight.get(w, usual) for w in words]

    def ends(least: float) -> list[int]:
        out, rarest, total = [], 0.0, 0.0
        for i, x in enumerate(own):
            rarest, total = max(rarest, x), total + x
            if rarest + OTHERS * (total - rarest) >= least:
                out.append(i + 1)
                if len(out) == count:
                    break
                rarest = total = 0.0
        return out

    low, high, best = 0.0, sum(own) / count, ends(0.0)
    for _ in range(8 if count > 1 else 0):
        middle = (low + high) / 2
        if len(got := ends(middle)) == count:
            low, best = middle, got
        else:
            high = middle
    return list(zip([0, *best[:-1]], [*best[:-1], len(words)], strict=True))


def copies_of_shards(claims: list[int], n_passages: int, cores: int) -> list[int]:
    """Copies of each shard's passages, from the claims that go to it: enough for SCANNED claims a copy, but never more passages than claims
    unless the shards are fewer than the cores."""
    shards = len(claims)
    return [max(-(-cores // shards), min(-(-n // SCANNED), n * shards // max(1, n_passages))) for n in claims]


class Runs:
    """The words of a batch's texts one after another, and a hash of the 1 to KEY words that begin at each."""

    def __init__(self, texts: pa.Array):
        import xxhash

        split = pc.split_pattern(texts.cast(pa.string()), " ")
        words = pc.list_flatten(split).dictionary_encode()
        codes = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)[words.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        self.row, self.end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        self.start = self.end - sizes
        self.salt = (np.add.reduceat(codes, self.start) & np.uint64(0x7FFFFFFF)).astype(np.int32) if len(codes) else np.zeros(0, np.int32)
        left = self.end[self.row] - np.arange(len(codes))
        self.whole, self.hashes, h = [], [], np.zeros(len(codes), np.uint64)
        for n in range(1, KEY + 1):
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([codes[n - 1 :], codes[: n - 1]])
            m = (h ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            m = (m ^ (m >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            self.whole.append(left >= n)
            self.hashes.append(m ^ (m >> np.uint64(32)))

    def begins(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Hashes of the beginnings of passages (row, start, end)."""
        rows, starts, ends = np.array(spans, np.int64).reshape(-1, 3).T
        return np.stack(self.hashes)[np.minimum(ends - starts, KEY) - 1, self.start[rows] + starts]


def bits_of(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, four bits in it) of each hash."""
    mask = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return ((hashes >> np.uint64(24)) & np.uint64(slots - 1)).astype(np.int64), mask


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


class Shard:
    """An automaton over the passages of one shard, each with the evaluation sets and places it stands at."""

    def __init__(self, similarity: float):
        self.similarity, self.sets, self.sizes, self.found = similarity, [], [], {}
        self.auto = None

    def add(self, words: str, spans: list[tuple[int, int]]) -> None:
        own = words.split(" ")
        for a, b in spans:
            self.found.setdefault(f" {' '.join(own[a:b])} ", []).append((len(self.sets), a, b))
        self.sets.append(words)
        self.sizes.append(len(own))

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        """(evaluation set, words in both, words in either, words covered by merged passages) of each set similar enough to a training set."""
        import ahocorasick

        if not self.sets:
            return []
        if self.auto is None:
            self.auto = ahocorasick.Automaton()
            while self.found:  # the automaton takes the passages' place in memory
                self.auto.add_word(*self.found.popitem())
            self.auto.make_automaton()
        n = text.count(" ") + 1
        least, most = self.similarity * n - 1e-9, (n + 1e-9) / self.similarity
        matched: dict[int, list[tuple[int, int]]] = {}
        for _, where in self.auto.iter(f" {text} "):
            for i, a, b in where:
                if least <= self.sizes[i] <= most:
                    matched.setdefault(i, []).append((a, b))
        own, out = frozenset(text.split(" ")) if matched else frozenset(), []
        for i, spans in matched.items():
            both = len(own.intersection(self.sets[i].split(" ")))
            either = n + self.sizes[i] - both
            if both >= self.similarity * either - 1e-9:
                out.append((self.sets[i], both, either, covered(spans)))
        return out


def covered(spans: list[tuple[int, int]]) -> int:
    """Length of the union of intervals."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


_ROUTED = "shard int, salt int, kind int, word_set string, starts array<int>, ends array<int>"


def similar_sets(train: DataFrame, evaluation: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(train_set, eval_set, n_both, n_either, n_covered) of all pairs whose word sets share `similarity` of their words or more.

    Both inputs have one row per distinct word_set; empty sets match nothing. n_covered: words of the evaluation set inside the merged
    passages that the training set holds in one of the shards.
    """
    spark = train.sparkSession
    train, ev = Cut(train.where("word_set <> ''").select("word_set")), Cut(evaluation.where("word_set <> ''").select("word_set"))
    n_train, n_ev = train.df.count(), ev.df.count()
    counts = train.df.union(ev.df).select(F.explode(F.split("word_set", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    n = n_train + n_ev
    frequent = {r["w"]: math.log(1 + n / r["n"]) for r in counts.where(F.col("n") > n // FREQUENT_SHARE + 1).collect()}
    usual = RARE * math.log(1 + FREQUENT_SHARE)
    held = spark.sparkContext.broadcast(frequent)
    n_passages = ev.df.select(F.sum(F.floor(F.size(F.split("word_set", " ")) * F.lit(1 / similarity - 1) + 1e-9) + 1)).first()[0] or 0
    shards = 1 + n_passages // SHARD
    slots = min(MOST_SLOTS, 1 << (max(1, n_passages * BITS // 64) - 1).bit_length())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, places = held.value, pa.list_(pa.int32())
        for b in batches:
            spans = [passages(t.split(" "), weight, usual, similarity) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([[x[k] for x in own] for own in spans], places) for k in (0, 1))], names=["word_set", "starts", "ends"])

    def spans_of(b: pa.RecordBatch) -> list[tuple[int, int, int]]:
        return [(i, a, z) for i, (starts, ends) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for a, z in zip(starts, ends, strict=True)]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, mask = bits_of(Runs(b.column(0)).begins(spans_of(b)), slots)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask.view(np.int64))], names=["slot", "mask"])

    cuts = Cut(ev.df.mapInArrow(cut_up, "word_set string, starts array<int>, ends array<int>"))
    ev.drop()
    full = cuts.df.mapInArrow(filled, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table_of_bits = np.zeros(slots, np.uint64)
    table_of_bits[full.column("slot").to_numpy()] = full.column("mask").to_numpy().view(np.uint64)
    bloom = spark.sparkContext.broadcast(table_of_bits)

    def route_train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        for b in batches:
            runs, goes = Runs(b.column(0)), [np.zeros(0, np.int64)]
            for whole, hashes in zip(runs.whole, runs.hashes, strict=True):
                slot, mask = bits_of(hashes, slots)
                hit = np.flatnonzero(whole & (known[slot] & mask == mask))
                goes.append(runs.row[hit] * shards + shard_of(hashes[hit], shards))
            row, shard = np.divmod(np.unique(np.concatenate(goes)), shards)
            yield table([shard, runs.salt[row], np.ones(len(row), np.int32), b.column(0).take(pa.array(row)), pa.nulls(len(row)), pa.nulls(len(row))])

    def route_evaluation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, by = spans_of(b), {}
            for (i, a, z), s in zip(spans, shard_of(Runs(b.column(0)).begins(spans), shards).tolist(), strict=True):
                by.setdefault((i, s), []).append((a, z))
            none = np.zeros(len(by), np.int32)
            yield table([[s for _, s in by], none, none, b.column(0).take(pa.array([i for i, _ in by], pa.int64())), [[a for a, _ in x] for x in by.values()], [[z for _, z in x] for x in by.values()]])

    def table(cols: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "salt", "kind", "word_set", "starts", "ends"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for b in batches:
            out: list[tuple] = []
            for s, salt, kind, t, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (s, salt) != at:
                    at, shard = (s, salt), Shard(similarity)
                if kind == 0:
                    shard.add(t, list(zip(starts, ends, strict=True)))
                else:
                    out += [(t, *x) for x in shard.scan(t)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["train_set", "eval_set", "n_both", "n_either", "n_covered"])

    cores = spark.sparkContext.defaultParallelism
    routed = train.df.mapInArrow(route_train, _ROUTED)
    sizes = {0: n_train} if shards == 1 else {r[0]: r[1] for r in routed.groupBy("shard").count().collect()}
    copies = copies_of_shards([sizes.get(s, 0) for s in range(shards)], n_passages, cores)
    first = [sum(copies[:s]) for s in range(shards)]
    copied, first_of = (F.element_at(F.array(*map(F.lit, xs)), F.col("shard") + 1) for xs in (copies, first))
    claims = routed.withColumn("salt", F.pmod("salt", copied).cast("int"))
    held_passages = cuts.df.mapInArrow(route_evaluation, _ROUTED).withColumn("salt", F.explode(F.sequence(F.lit(0), copied - 1)))
    together = held_passages.unionByName(claims).repartitionById(sum(copies), (first_of + F.col("salt")).cast("int")).sortWithinPartitions("shard", "salt", "kind")
    found = together.mapInArrow(scan, "train_set string, eval_set string, n_both int, n_either int, n_covered int")
    # a pair may be found in several shards, by other passages in each
    return found if shards == 1 else found.groupBy("train_set", "eval_set", "n_both", "n_either").agg(F.sum("n_covered").cast("int").alias("n_covered"))


def sides(split_result: DataFrame) -> DataFrame:
    """(record_index, in_train, in_validation) of every record that some row lists on one of these sides."""
    train = split_result.select(F.explode("train_indices").alias("record_index"), F.lit(True).alias("in_train"), F.lit(False).alias("in_validation"))
    val = split_result.select(F.explode("validation_indices").alias("record_index"), F.lit(False).alias("in_train"), F.lit(True).alias("in_validation"))
    both = train.unionByName(val).where("record_index is not null")
    return both.groupBy("record_index").agg(F.max("in_train").alias("in_train"), F.max("in_validation").alias("in_validation"))


class Overlaps:
    """Cross-split overlaps of one split table: the records' word sets, and the pairs of sets that are similar."""

    def __init__(self, predictions: DataFrame, split_result: DataFrame, similarity: float = 0.8):
        """Records without a claim, and claims without a word, overlap with nothing; a record with several claims has all of them."""
        claims = predictions.select("record_index", "claim").where("claim is not null").distinct().join(sides(split_result), "record_index")
        sets = word_sets(with_consistent(claims, ["claim"]).select("record_index", "in_train", "in_validation", "claim_consistent"), "claim_consistent")
        self.records = Cut(sets.select("record_index", "in_train", "in_validation", "word_set").where("word_set <> ''").distinct()).df
        train = self.records.where("in_train").select("word_set").distinct()
        evaluation = self.records.where("in_validation").select("word_set").distinct()
        self.pairs = Cut(similar_sets(train, evaluation, similarity)).df

    def found(self) -> DataFrame:
        """(record_index, other_record_index), smaller first, of all similar pairs with one record on each side."""
        train = self.records.where("in_train").select(F.col("word_set").alias("train_set"), F.col("record_index").alias("t"))
        val = self.records.where("in_validation").select(F.col("word_set").alias("eval_set"), F.col("record_index").alias("v"))
        pairs = self.pairs.select("train_set", "eval_set").join(train, "train_set").join(val, "eval_set").where("t <> v")
        return pairs.select(F.least("t", "v").alias("record_index"), F.greatest("t", "v").alias("other_record_index")).distinct()

    def coverage(self) -> DataFrame:
        """(record_index, n_train_sets, coverage) per validation record that overlaps: how many training claims do, and the greatest part of
        its words that passages of one of them cover."""
        words = F.size(F.split("eval_set", " "))
        best = self.pairs.groupBy("eval_set").agg(F.count(F.lit(1)).alias("n_train_sets"), F.max(F.col("n_covered") / words).alias("coverage"))
        val = self.records.where("in_validation").select(F.col("word_set").alias("eval_set"), "record_index")
        return val.join(best, "eval_set").groupBy("record_index").agg(F.max("n_train_sets").alias("n_train_sets"), F.max("coverage").alias("coverage"))
