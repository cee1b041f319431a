"""Garbled text from wrong character encoding: found by expectation-maximization and repaired by posterior.

Method: a record's latent variable is the chain of encodings that its text went through ("none" for most). A chain
touches the words that it can have made; each such word gives a log-likelihood ratio under a character model of all
texts. The model itself is estimated over several rounds in which words that are better explained as garbled lose their
weight. EM then estimates, per source and field, how likely each chain is: weak evidence in one record counts where the
source's other records show the same chain. A record is garbled if its posterior for "none" is below one half, and is
repaired with its most probable chain, word by word.

The character model is a table of hashed n-gram counts of fixed size, so what is broadcast doesn't grow with the data.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumark.tables import Cut

BUCKETS = 1 << 22
#: Rounds of the character model, and of EM over the evidence.
MODEL_ROUNDS, EM_ROUNDS = 4, 4
#: Places counted in one task, where there are more than one for each core.
COUNTED = 100_000
#: Weight of the shorter context's estimate, in observations.
BACKING = 8.0
#: Part of a garbled record's touched words that are garbled, and the log ratio that a word needs to count as evidence.
TOUCHED, LEAST_RATIO = 0.6, 0.7
#: A word's log ratio less this is the log odds that it is garbled, while the character model is estimated: valid UTF-8
#: sequences seldom arise by chance, single bytes always have another reading.
UTF8_ODDS, SINGLE_ODDS = 1.0, 5.0
#: Places of a word that are added to both readings' counts, as a share of all characters, where a single-byte chain's two readings
#: are compared: a share, so that the comparison is the same in a corpus of any size.
SEEN_SHARE = 5e-6
LOST_RATIO = 12.0
PSEUDO_RECORDS = 20.0
#: A word that isn't plain ASCII; tried at beginnings of words only.
TOKEN = re.compile("(?<![^ \t\r\n])[^ \t\r\n\x80-\U0010ffff]*+[^\x00-\x7f][^ \t\r\n]*+")
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")
LOST = "�"

# Encodings that UTF-8 bytes are read in, and pairs (true encoding, encoding read in) of single-byte texts.
UTF8_READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_15"]
SINGLE_BYTE = [
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("mac_cyrillic", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("cp1251", "cp437"), ("cp1251", "cp850"),
    ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1250"), ("cp1252", "cp866"),
]


@functools.cache
def _high(codec: str) -> dict[int, str]:
    """Characters of the bytes from 0x80; a byte without one stands for its own control character."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@functools.cache
def _utf8_pattern(codec: str) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern of the characters that a multi-byte UTF-8 sequence shows when read in `codec`, and each character's byte."""
    high = _high(codec)
    if codec == "cp1252":  # control characters stand for themselves where Latin-1 was meant
        both = {b: {c, chr(b)} for b, c in high.items()}
    else:
        both = {b: {c} for b, c in high.items()}
    some = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi) for c in sorted(both[b])) + "]"
    tail = some(0x80, 0xC0)
    pattern = re.compile(f"{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}}")
    return pattern, {c: b for b, cs in both.items() for c in cs}


def _undo_utf8(codec: str) -> Callable[[str], str]:
    pattern, bytes_of = _utf8_pattern(codec)

    def one(m: re.Match) -> str:
        try:
            return bytes(bytes_of[c] for c in m.group()).decode()
        except UnicodeDecodeError:
            return m.group()

    return lambda s: pattern.sub(one, s)


def _undo_single(true: str, read: str) -> Callable[[str], str]:
    was, shown = _high(true), _high(read)
    table = str.maketrans({c: was[b] for b, c in shown.items() if c not in "\xa0\xad"})  # these two also stand in clean words
    return lambda s: s.translate(table)


def _again(undo: Callable[[str], str], s: str, times: int) -> str:
    """s undone so many times, or s itself if one of the times changes nothing."""
    back = s
    for _ in range(times):
        once = undo(back)
        if once == back:
            return s
        back = once
    return back


@functools.cache
def chains() -> dict[str, Callable[[str], str]]:
    """Each chain's name and the function that undoes it in a word."""
    out: dict[str, Callable[[str], str]] = {}
    for codec in UTF8_READ_AS:
        out[f"utf8>{codec}"] = _undo_utf8(codec)
    for codec in ("cp1252", "mac_roman", "cp1251"):
        undo = out[f"utf8>{codec}"]
        out[f"utf8>{codec} twice"] = lambda s, undo=undo: _again(undo, s, 2)
    undo = out["utf8>cp1252"]
    out["utf8>cp1252 thrice"] = lambda s, undo=undo: _again(undo, s, 3)
    for true, read in SINGLE_BYTE:
        out[f"{true}>{read}"] = _undo_single(true, read)
    return out


def places(text: str) -> Iterator[tuple[str, str, str]]:
    """Each word that isn't plain ASCII, with what stands before and after it: marks of its ends, or for a word of up to
    three characters the two characters on either side."""
    for m in TOKEN.finditer(text):
        yield _place(text, m)


def _place(text: str, m: re.Match) -> tuple[str, str, str]:
    if m.end() - m.start() > 3:
        return "\x02\x02", m.group(), "\x03"
    before = text[max(0, m.start() - 2) : m.start()]
    return "\x02" * (2 - len(before)) + before, m.group(), text[m.end() : m.end() + 2] + "\x03"


def packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table's filled buckets alone, as it is sent to the executors."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    return used.astype(np.uint32), counts[used].astype(np.float32)


def unpacked(filled: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.float32)
    counts[filled[0]] = filled[1]
    return counts


class Characters:
    """Log probability of a word under hashed counts of its characters, pairs and triples; short contexts back up long ones."""

    def __init__(self, counts: np.ndarray):
        # plain numbers, and each triple's logarithm once: both are far quicker to get at than an array's elements
        self.counts, self.words, self.logs = memoryview(np.ascontiguousarray(counts, np.float32)), {}, {}

    @staticmethod
    @functools.lru_cache(1 << 20)
    def bucket(gram: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(gram) & (BUCKETS - 1)

    @staticmethod
    def grams(before: str, word: str, after: str) -> list[str]:
        w = before + word + after
        return ["\x08" + w] + [g for i in range(2, len(w)) for g in (w[i - 2 : i + 1], w[i - 2 : i] + "\x01", w[i - 1 : i + 1] + "\x04", w[i - 1] + "\x05", w[i] + "\x06", "\x07")]

    def log_p(self, before: str, word: str, after: str) -> float:
        """Sum over the characters of log P(character | the two before it)."""
        w, logs, total = before + word + after, self.logs, 0.0
        for i in range(2, len(w)):
            gram = w[i - 2 : i + 1]
            known = logs.get(gram)
            if known is None:
                if len(logs) > 1_000_000:
                    logs.clear()
                known = logs[gram] = self._log_of(*gram)
            total += known
        return total

    def _log_of(self, x: str, y: str, z: str) -> float:
        c, b = self.counts, self.bucket
        p1 = (c[b(z + "\x06")] + 0.02) / (c[b("\x07")] + 1000.0)
        p2 = (c[b(y + z + "\x04")] + BACKING * p1) / (c[b(y + "\x05")] + BACKING)
        return math.log((c[b(x + y + z)] + BACKING * p2) / (c[b(x + y + "\x01")] + BACKING))

    def seen(self, before: str, word: str, after: str) -> float:
        return self.counts[self.bucket("\x08" + before + word + after)]

    def more_often(self, before: str, word: str, back: str, after: str) -> float:
        """Log of how many times more often the word is seen than its other reading, 0 if it isn't."""
        some = SEEN_SHARE * float(self.counts[self.bucket("\x07")]) + 1e-9
        return max(0.0, math.log((float(self.seen(before, word, after)) + some) / (float(self.seen(before, back, after)) + some)))

    def garbled_odds(self, place: tuple[str, str, str]) -> float:
        """Log odds that the word at this place is garbled, by its best chain."""
        return max((r - (UTF8_ODDS if c.startswith(("utf8", "lost")) else SINGLE_ODDS) for c, r, _ in self.evidence(place)), default=-30.0)

    def evidence(self, place: tuple[str, str, str]) -> list[tuple[str, float, str]]:
        """(chain, log ratio, word restored) for each chain that may have made the word between its neighbours."""
        known = self.words.get(place)
        if known is None:
            before, word, after = place
            known, own, done = [], None, {}
            if LOST in word:
                known.append(("lost", LOST_RATIO, word))
            for name, undo in chains().items():
                back = undo(word)
                if back == word or CONTROL.search(back):
                    continue
                if own is None:
                    own = self.log_p(before, word, after)
                if back not in done:
                    done[back] = self.log_p(before, back, after) - own
                ratio = done[back] if name.startswith("utf8") else done[back] - self.more_often(before, word, back, after)
                if ratio >= LEAST_RATIO:
                    known.append((name, ratio, back))
            if len(word) <= 80 and len(self.words) < 500_000:
                self.words[place] = known
        return known


def _places(texts: DataFrame) -> DataFrame:
    """(before, word, after, n): every place of a word that isn't plain ASCII and how often it occurs in all distinct texts.

    Copies of a text count once: else the model would learn a garbled text by heart that stands in the corpus many times.
    """
    each = texts.select(F.explode(F.array(*texts.columns)).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*seen, strict=True)) or [(), (), ()]
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(seen.values(), pa.int64())], names=["before", "word", "after", "n"])
            seen.clear()
            return made

        for b in batches:
            for col in b.columns:
                for t in col.to_pylist():
                    if t and not t.isascii():
                        seen.update(places(t))
            if len(seen) > 100_000:
                yield out()
        yield out()

    return each.mapInArrow(run, "before string, word string, after string, n long").groupBy("before", "word", "after").agg(F.sum("n").alias("n"))


def _count(found: DataFrame, model: Characters | None) -> np.ndarray:
    """Hashed n-gram counts of all places, each weighed by how often it occurs and by the probability that it is clean."""
    held = found.sparkSession.sparkContext.broadcast(packed(model.counts) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = Characters(unpacked(held.value)) if held.value is not None else None
        counts = np.zeros(BUCKETS)
        for b in batches:
            for *place, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if before is not None:
                    n /= 1 + math.exp(min(30.0, before.garbled_odds(tuple(place))))
                for g in Characters.grams(*place):
                    counts[Characters.bucket(g)] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.float64())], names=["b", "n"])

    tasks = max(found.sparkSession.sparkContext.defaultParallelism, found.count() // COUNTED)
    sums = found.repartition(tasks).mapInArrow(run, "b int, n double").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    held.unpersist()
    return unpacked((sums["b"].to_numpy(np.uint32), sums["n"].to_numpy(np.float32)))


class Garbled:
    """Garbled records of a table: evidence of each record and field, chain priors per source and field, posteriors and repairs."""

    def __init__(self, table: DataFrame, key: str, fields: list[str], source: str | None = None):
        """Null and empty texts are clean; a null source counts as one source; texts of any length are taken whole."""
        self.table, self.key, self.fields = table, key, fields
        name = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
        self.rows = table.select(F.col(key).alias("_key"), name.alias("_source"), *(F.col(f).cast("string").alias(f) for f in fields))
        found, counts = Cut(_places(self.rows.select(*fields))), None
        for _ in range(MODEL_ROUNDS):
            counts = _count(found.df, Characters(counts) if counts is not None else None)
        found.drop()
        self.model = table.sparkSession.sparkContext.broadcast(packed(counts))
        self.evidence = Cut(self._evidence()).df
        self.posterior = Cut(self._em()).df

    def _evidence(self) -> DataFrame:
        """(_key, _source, field, chain, ratio): per record and chain the log ratio of its touched words to untouched ones."""
        model, fields = self.model, self.fields
        key_type = self.rows.schema["_key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chars = Characters(unpacked(model.value))
            for b in batches:
                take, cols = [], ([], [], [])
                for f in fields:
                    for i, t in enumerate(b.column(b.schema.get_field_index(f)).to_pylist()):
                        if not t or t.isascii():
                            continue
                        sums: dict[str, float] = {}
                        for w in set(places(t)):
                            for chain, ratio, _ in chars.evidence(w):
                                sums[chain] = sums.get(chain, 0.0) + math.log1p(TOUCHED * math.expm1(min(ratio, 300.0)))
                        for chain, total in sums.items():
                            take.append(i)
                            for c, v in zip(cols, (f, chain, total), strict=True):
                                c.append(v)
                at = pa.array(take, pa.int32())
                own = [b.column(b.schema.get_field_index(c)).take(at) for c in ("_key", "_source")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["_key", "_source", "field", "chain", "ratio"])

        return self.rows.mapInArrow(run, f"_key {key_type}, _source string, field string, chain string, ratio double")

    def _em(self) -> DataFrame:
        """(_key, field, chain, p, p_any): each record's most probable chain, its posterior, and that of any chain.

        M-step: a chain's prior in a source and field is its expected share of the records there, drawn towards its share of all
        records by PSEUDO_RECORDS. E-step: prior times likelihood, over the chains and "none" (ratio 0).
        """
        sizes = self.rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n"))
        sizes = Cut(sizes).df
        everything = sizes.agg(F.sum("n")).first()[0] or 0
        kinds = len(chains()) + 1
        prior = self.evidence.select("_source", "field", "chain").distinct().withColumn("prior", F.lit(0.05 / kinds))
        held: list[Cut] = []
        for _ in range(EM_ROUNDS):
            joint = self.evidence.join(prior, ["_source", "field", "chain"]).withColumn("_l", F.col("ratio") + F.log("prior"))
            top = joint.groupBy("_key", "field").agg(F.max("_l").alias("_top"), F.max("_source").alias("_s2"))
            joint = joint.join(top.drop("_s2"), ["_key", "field"]).withColumn("_w", F.exp(F.col("_l") - F.greatest("_top", F.lit(0.0))))
            rest = joint.groupBy("_key", "field").agg((F.sum("_w") + F.exp(-F.greatest(F.first("_top"), F.lit(0.0)))).alias("_z"))
            now = Cut(joint.join(rest, ["_key", "field"]).select("_key", "_source", "field", "chain", (F.col("_w") / F.col("_z")).alias("p")))
            post = now.df
            mass = post.groupBy("_source", "field", "chain").agg(F.sum("p").alias("m"))
            overall = post.groupBy("field", "chain").agg(((F.sum("p") + 1e-3) / (everything + 1.0)).alias("share"))
            prior = mass.join(overall, ["field", "chain"]).join(sizes, "_source").select("_source", "field", "chain", ((F.col("m") + PSEUDO_RECORDS * F.col("share")) / (F.col("n") + PSEUDO_RECORDS)).alias("prior"))
            after = Cut(prior)
            prior = after.df
            for old in held:  # superseded rounds
                old.drop()
            held = [now, after]
        best = F.max(F.struct("p", "chain"))
        return post.groupBy("_key", "field").agg(best.alias("b"), F.sum("p").alias("p_any")).select("_key", "field", "b.chain", "b.p", "p_any")

    def found(self, least: float = 0.5) -> DataFrame:
        """(key, field, chain, p) of the garbled records."""
        return self.posterior.where(F.col("p_any") >= least).select(F.col("_key").alias(self.key), "field", "chain", F.col("p_any").alias("p"))

    def repaired(self, least: float = 0.5) -> DataFrame:
        """(key, field, chain, text, restored): the garbled records with their text, repaired where the chain can be undone.

        Where the chain read UTF-8, every valid sequence is undone; where it read single bytes, a word is replaced if it is more probable
        afterwards. What is lost stays as it is.
        """
        model, key_type = self.model, self.rows.schema["_key"].dataType.simpleString()
        long = self.rows.select("_key", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in self.fields))).alias("x"))
        bad = self.found(least).withColumnRenamed(self.key, "_key")
        hit = bad.join(long.select("_key", "x.field", "x.text"), ["_key", "field"]).select("_key", "field", "chain", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chars = Characters(unpacked(model.value))
            for b in batches:
                out = []
                for chain, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):

                    def fix(m: re.Match, chain: str = chain, t: str = t) -> str:
                        w = m.group()
                        if chain.startswith("utf8"):  # valid sequences are undone wherever they stand, as many times as they can be
                            for _ in range(steps):
                                w = once(w)
                            return w
                        return next((back for c, _, back in chars.evidence(_place(t, m)) if c == chain), w)

                    steps = 3 if chain.endswith("thrice") else 2 if chain.endswith("twice") else 1
                    once = chains().get(chain.split(" ")[0], str)
                    out.append(TOKEN.sub(fix, t) if t else t)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=["_key", "field", "chain", "text", "restored"])

        return hit.mapInArrow(run, f"_key {key_type}, field string, chain string, text string, restored string").withColumnRenamed("_key", self.key)
