import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vellumark.llm.leaks import Index, Words, leaked, simhashes, weighted_similarity
from vellumark.llm.overlap import Overlaps, covered, passages, similar_sets, word_set

WORDS = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("shard", [400_000, 40])
def test_similar_sets_against_brute_force(spark, monkeypatch, shard):
    import vellumark.llm.overlap as m

    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m, "SCANNED", 50)
    rng = random.Random(2)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    sets = sorted({word_set(" ".join(b[: rng.randrange(1, len(b) + 1)] + [f"w{rng.randrange(60)}"] * rng.randrange(2))) for b in base for _ in range(3)})
    train, val = sets[::2] + sets[:10], sets[1::2] + sets[:10]
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(set(xs))], "word_set string")
    got = {(r["train_set"], r["eval_set"]) for r in similar_sets(df(train), df(val)).collect()}
    cut = lambda x: set(x.split())
    assert got == {(a, b) for a in train for b in val if 5 * len(cut(a) & cut(b)) >= 4 * len(cut(a) | cut(b))}


def test_passages_cover_all_words():
    for n in range(1, 60):
        words = [f"w{i}" for i in range(n)]
        got = passages(words, {f"w{i}": 0.01 for i in range(0, n, 2)}, 5.0, 0.8)
        assert len(got) == n // 4 + 1 and [a for a, _ in got] == [0, *(z for _, z in got[:-1])] and got[-1][1] == n and all(a < z for a, z in got)
    assert covered([(3, 5), (0, 2), (4, 8)]) == 7


def test_what_is_sent_grows_with_the_claims():
    """Copies of the passages are never more than the claims, and a claim goes only where a passage may stand in it."""
    from vellumark.llm import overlap as m

    for n in (1, 10, 100):
        copies = m.copies_of_shards([500_000 * 2] * n, 150_000 * n, 6)
        assert sum(copies) * 150_000 <= max(6, n) * 1_000_000
    texts = pa.array([" ".join(f"{x}{i}" for i in range(20)) for x in "ab"])
    runs = m.Runs(texts)
    filled = np.zeros(64, np.uint64)
    slot, mask = m.bits_of(runs.begins([(0, 2, 4), (0, 4, 9), (0, 19, 20)]), 64)
    np.bitwise_or.at(filled, slot, mask)
    hit = [(int(r), n) for n, (ok, h) in enumerate(zip(runs.whole, runs.hashes, strict=True), 1) for r in runs.row[ok & (filled[m.bits_of(h, 64)[0]] & m.bits_of(h, 64)[1] == m.bits_of(h, 64)[1])]]
    assert {(0, 1), (0, 2), (0, 4)} <= set(hit) and len(hit) < 6
    phrase = [*(f"p{i}" for i in range(4)), "rare", *(f"q{i}" for i in range(4)), "odd", "seldom", "strange"]
    got = m.passages(phrase, {w: 5.0 for w in phrase if w[0] in "pq"}, 12.0, 0.8)
    assert len(got) == 4 and all({"rare", "odd", "seldom", "strange"} & set(phrase[a:z]) for a, z in got)


PREDICTIONS, SPLIT = "record_index long, claim string, cohort string", "train_indices array<long>, validation_indices array<long>"


def test_found_and_coverage(spark):
    text = "one two three four five six seven eight nine ten"
    p = [(1, text, "c"), (1, text, "c"), (2, text.upper().replace("o", "ο"), "c"), (3, text + " more", "c"), (4, "", None), (5, None, None), (6, "quite another claim", "c"), (7, text, "c"), (8, "ten nine eight seven six five four three two one", "c")]
    s = [([1, 6, 4], [2, 5]), ([8], [3]), (None, [7, 4]), ([None], None)]
    o = Overlaps(spark.createDataFrame(p, PREDICTIONS), spark.createDataFrame(s, SPLIT))
    assert {tuple(r) for r in o.found().collect()} == {(1, 2), (1, 3), (1, 7), (2, 8), (3, 8), (7, 8)}
    assert {r["record_index"]: r["coverage"] for r in o.coverage().collect()} == {2: 1.0, 3: pytest.approx(0.7, abs=0.25), 7: 1.0}


def test_overlaps_of_nothing(spark):
    o = Overlaps(spark.createDataFrame([], PREDICTIONS), spark.createDataFrame([], SPLIT))
    assert o.found().count() == 0 and o.coverage().count() == 0


def text_of(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, text_of(rng, rng.randrange(5, 40))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        parts = [text_of(rng, rng.randrange(0, 30))]
        if d % 3 == 0:
            w = items[rng.randrange(30)][1].split()
            k = rng.randrange(0, max(1, len(w) - 8))
            parts.append(", ".join(w[k : k + rng.randrange(8, 20)]).upper())
        docs.append((d, "; ".join([*parts, text_of(rng, 5)])))
    docs += [(100, None), (101, ""), (102, items[0][1] * 300), (0, docs[0][1])]
    runs = lambda t: {tuple(w[k : k + 12]) for w in [WORDS.findall((t or "").lower())] for k in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    got = {(r["doc_id"], r["item_id"]) for r in leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 5


def test_blocks_find_all_within_radius():
    rng = np.random.default_rng(1)
    index = Index([(0, " ".join(f"a{i}" for i in range(80)))], 12, 3).lengths[0]
    for _ in range(50):
        f = index.prints[rng.integers(len(index.prints))]
        for b in rng.choice(64, 3, replace=False):
            f ^= np.uint64(1) << np.uint64(b)
        left, right = index.near(np.array([f], np.uint64))
        want = np.flatnonzero(np.bitwise_count(index.prints ^ f) <= 3)
        assert sorted(right.tolist()) == want.tolist() and len(want)


def test_near_items_by_similarity(spark):
    w = [f"k{i}" for i in range(20)]
    changed = " ".join(["x", "y", *w[:19], "other", "z"])
    docs, items = spark.createDataFrame([(1, changed)], "doc_id long, text string"), spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    assert leaked(docs, items, window=20).count() == 0
    assert [r["item_id"] for r in leaked(docs, items, window=None, radius=14, similarity=0.8).collect()] == [5]
    with pytest.raises(ValueError):
        leaked(docs, items, window=4)


def test_recall_of_near_items_against_brute_force():
    """Items with one to four words changed: of the windows that are similar to 0.8, nine in ten or more are found."""
    rng, words = random.Random(8), Words()
    items = [(i, text_of(rng, rng.randrange(40, 70))) for i in range(60)]
    index, want, got = Index(items, None, 14), set(), set()
    for d in range(400):
        i, w = rng.randrange(60), None
        w = items[i][1].split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = "other"
        n = words.numbers(" ".join([text_of(rng, 7), *w, text_of(rng, 9)]))
        own = words.numbers(items[i][1])
        if max(weighted_similarity(x, own) for x in np.lib.stride_tricks.sliding_window_view(n, len(own))) >= 0.8:
            want.add((d, i))
        got |= {(d, x) for x in index.verified(n, 0.8)}
    assert len(want) > 50 and len(want & got) >= 0.9 * len(want) and got <= want


def test_running_sums_equal_single_windows():
    n = np.random.default_rng(0).integers(0, 2**63, 40).astype(np.uint64)
    assert all(simhashes(n, 12)[i] == simhashes(n[i : i + 12], 12)[0] for i in range(29))
    assert weighted_similarity(n[:12], n[:12]) == 1 and weighted_similarity(n[:12], n[20:32]) == 0


def test_report_keeps_split_side_and_unknown_cohorts(spark, tmp_path):
    from vellumark.llm.queries import QUERIES

    p = [(1, "one two three four", "c"), (2, "one two three four", None), (3, "quite another", "c")]
    spark.createDataFrame(p, PREDICTIONS).write.parquet(f"{tmp_path}/predictions.parquet")
    spark.createDataFrame([(7, [1], [2, 9]), (8, [3], [2])], f"split_id long, {SPLIT}").write.parquet(f"{tmp_path}/split_result.parquet")
    got = {(r["split_id"], r["side"], r["cohort"]): (r["n_records"], r["n_overlapping"], r["n_pairs"]) for r in QUERIES["p7_report"](spark, str(tmp_path)).collect()}
    assert got == {(7, "train", "c"): (1, 1, 1), (7, "validation", None): (2, 1, 1), (8, "train", "c"): (1, 0, 0), (8, "validation", None): (1, 1, 1)}
