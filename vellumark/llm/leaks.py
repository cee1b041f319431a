"""Evaluation texts leaking into training text.

Method: windows of held-out items and of documents get a SimHash of their weighted five-word shingles. The fingerprint's bits
are cut into radius + 1 blocks: two fingerprints within the radius agree in one block at least, so looking up each block finds all of
them. The exact weighted-shingle similarity then verifies every candidate.

Windows are as long as the item (`window=None`: whole items, nearly the same), or of a fixed length (parts of items: a document
shares a part far shorter than the item, so windows as long as an item would miss it). A window whose shingles that any item
holds weigh too little for the similarity can't pass the check, and gets no fingerprint. Items are a fixed set: shards of them, of bounded
size, are broadcast, and documents are read once per shard, without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\W_]+")
BITS = 64
SHINGLE = 5
#: Windows of items in one shard (about 110 bytes each).
SHARD_WINDOWS = 500_000
#: Words whose window sums are held at once.
CHUNK = 60_000


class Words:
    """Words of texts as 64-bit numbers, with a cache of the words seen."""

    def __init__(self, most: int = 2_000_000):
        self.known: dict[str, int] = {}
        self.most = most

    def numbers(self, text: str) -> np.ndarray:
        import xxhash

        found, known = WORD.findall(text.lower()), self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(found), np.uint64)
        for i, w in enumerate(found):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of each run of SHINGLE words; the weight, 1 to 4, depends on the shingle alone."""
    h = numbers[: len(numbers) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h = _mix(h * np.uint64(31)) + numbers[k : len(numbers) - SHINGLE + 1 + k]
    h = _mix(h)
    return h, (h >> np.uint64(62)).astype(np.int16) + np.int16(1)


def simhashes(numbers: np.ndarray, window: int) -> np.ndarray:
    """Fingerprint of every window of so many words, from running sums over the shingles."""
    if len(numbers) < window:
        return np.empty(0, np.uint64)
    h, weight = shingles(numbers)
    per, out = window - SHINGLE + 1, []
    for at in range(0, len(numbers) - window + 1, CHUNK):
        out.append(_prints(h[at : at + CHUNK + per - 1], weight[at : at + CHUNK + per - 1], per))
    return np.concatenate(out)


def _prints(h: np.ndarray, weight: np.ndarray, per: int) -> np.ndarray:
    """Fingerprints of all runs of `per` shingles."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16)
    sums = np.cumsum((2 * bits - 1) * weight[:, None], axis=0, dtype=np.int32)
    sums = np.vstack([np.zeros((1, BITS), np.int32), sums])
    return np.packbits(sums[per:] - sums[:-per] > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Blocks:
    """Fingerprints of items' windows of one length, looked up by each of radius + 1 blocks of their bits."""

    def __init__(self, own: list[tuple[int, np.ndarray]], window: int, radius: int):
        self.window, self.radius = window, radius
        self.prints = np.concatenate([simhashes(n, window) for _, n in own])
        self.item = np.repeat(np.array([i for i, _ in own], np.int64), [len(n) - window + 1 for _, n in own])
        self.rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(n, window) for _, n in own])
        self.blocks = []
        edges = [BITS * k // (radius + 1) for k in range(radius + 2)]
        for a, b in zip(edges, edges[1:], strict=False):
            key = self._key(self.prints, a, b)
            order = np.argsort(key, kind="stable")
            self.blocks.append((a, b, key[order], order))

    @staticmethod
    def _key(f: np.ndarray, a: int, b: int) -> np.ndarray:
        return (f >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)

    def near(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (window of the text, window of an item) whose fingerprints differ in at most `radius` bits."""
        pairs = []
        for a, b, keys, order in self.blocks:
            k = self._key(f, a, b)
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            n = hi[hit] - lo[hit]
            left = np.repeat(hit, n)
            right = order[np.repeat(lo[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            ok = np.bitwise_count(f[left] ^ self.prints[right]) <= self.radius
            pairs.append(left[ok] * len(self.prints) + right[ok])
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.concatenate(pairs))
        return both // len(self.prints), both % len(self.prints)


class Index:
    """The items' windows by length, and all their shingles."""

    def __init__(self, items: list[tuple[int, str]], window: int | None, radius: int):
        words, by = Words(), {}
        for item, text in items:
            n = words.numbers(text)
            length = window or len(n)
            if len(n) >= length >= SHINGLE:
                by.setdefault(length, []).append((item, n))
        self.lengths = [Blocks(own, length, radius) for length, own in sorted(by.items())]
        self.known = np.unique(np.concatenate([shingles(n)[0] for own in by.values() for _, n in own])) if by else np.empty(0, np.uint64)

    def verified(self, numbers: np.ndarray, similarity: float) -> dict[int, tuple[int, float]]:
        """item -> (matching windows of the text, greatest similarity), for the near windows that are similar enough."""
        out: dict[int, tuple[int, float]] = {}
        if len(numbers) < SHINGLE or not len(self.known):
            return out
        h, weight = shingles(numbers)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        held = np.concatenate([[0], np.cumsum(np.where(self.known[at] == h, weight, 0), dtype=np.int64)])
        if not held[-1]:
            return out
        every = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])
        for group in self.lengths:
            per = group.window - SHINGLE + 1
            if len(h) < per:
                continue
            # what a window shares weighs at most what any item holds of it, and it must be `similarity` of its own weight at least
            starts = np.flatnonzero(held[per:] - held[:-per] >= similarity * (every[per:] - every[:-per]) - 1e-9)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > per) + 1) if len(starts) else ():
                for k in range(0, len(run), CHUNK):
                    part = run[k : k + CHUNK]
                    lo, hi = part[0], part[-1] + per
                    left, right = group.near(_prints(h[lo:hi], weight[lo:hi], per)[part - lo])
                    self._check(numbers, part[left], group, right, similarity, out)
        return out

    def _check(self, numbers: np.ndarray, left: np.ndarray, group: Blocks, right: np.ndarray, similarity: float, out: dict[int, tuple[int, float]]) -> None:
        if not len(left):
            return
        rows = np.lib.stride_tricks.sliding_window_view(numbers, group.window)[left]
        equal = (rows == group.rows[right]).all(axis=1)  # equal words have equal shingles
        score = np.where(equal, 1.0, 0.0)
        for i in np.flatnonzero(~equal):
            score[i] = weighted_similarity(rows[i], group.rows[right[i]])
        ok = score >= similarity - 1e-9
        if similarity >= 1:
            ok &= equal  # other words may have the same shingles in another order
        for item in np.unique(group.item[right[ok]]).tolist():
            of = ok & (group.item[right] == item)
            n, best = out.get(item, (0, 0.0))
            out[item] = (n + len(np.unique(left[of])), max(best, float(score[of].max())))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weight of the shingles in both windows over the weight of those in either (a repeated shingle counts each time)."""
    sums: dict[int, list[int]] = {}
    for side, n in ((0, a), (1, b)):
        for h, w in zip(*(x.tolist() for x in shingles(np.ascontiguousarray(n))), strict=True):
            sums.setdefault(h, [0, 0])[side] += w
    return sum(map(min, sums.values())) / (sum(map(max, sums.values())) or 1)


#: The index that this worker process built last, by the broadcast it was built from.
_BUILT: dict[str, Index] = {}


def _index(token: str, items: list[tuple[int, str]], window: int | None, radius: int) -> Index:
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Index(items, window, radius)
    return _BUILT[token]


def leaked(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", window: int | None = 12, radius: int = 2, similarity: float = 1.0) -> DataFrame:
    """(doc, item, n_windows, similarity): documents that share a window of an item, and how many of their windows do.

    window: words in a window (5 at least), or None for windows as long as each item. Words are runs of letters and digits without case.
    With similarity 1 the shared words are the same words in the same order. Null or short texts share nothing; items and documents may repeat
    (one row per id pair and copy). Texts are taken whole.
    """
    if window is not None and window < SHINGLE:
        raise ValueError(f"a window holds {SHINGLE} words at least")
    spark = documents.sparkSession
    kept = items.select(item, text).where(f"{text} is not null").distinct()
    sizes = kept.selectExpr(f"coalesce(sum(length({text})), 0)").first()[0]
    shards = 1 + int(sizes) // (4 * SHARD_WINDOWS)
    out = None
    for k in range(shards):
        part = kept if shards == 1 else kept.where(f"pmod(xxhash64({item}), {shards}) = {k}")
        held, token = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, token=token) -> Iterator[pa.RecordBatch]:
            index, words = _index(token, held.value, window, radius), Words()
            for b in batches:
                rows: list[tuple] = []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t:
                        rows += [(d, i, n, s) for i, (n, s) in index.verified(words.numbers(t), similarity).items()]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=[doc, item, "n_windows", "similarity"])

        found = documents.select(doc, text).mapInArrow(run, f"{doc} long, {item} long, n_windows int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out
