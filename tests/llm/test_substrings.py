import hashlib
import random

import numpy as np

from lexiloom.llm import substrings
from lexiloom.llm.common import words_of

ALPHABET = ["a", "bb", "é", "漢字", "x\x1cy", " ", "c."]


def brute(rows, n):
    """What the contract says, word by word."""
    first = {}
    split = [(d, words_of(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=repr)


def documents():
    rng = random.Random(3)
    shared = [[rng.choice(ALPHABET) for _ in range(rng.randint(13, 40))] for _ in range(4)]
    rows = []
    for d in range(60):
        words = [rng.choice(ALPHABET) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            words[len(words) // 2 : len(words) // 2] = rng.choice(shared)
        rows.append((d - 5, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(3, rows[20][1]), (3, rows[21][1] + " tail"), (None, rows[20][1]), (None, None), (70, None), (71, ""), (72, "a " * 40_000), (73, "w" * 300_000)]
    return rows


def test_matches_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, anchor string")
    for bits in (None, 8):  # a full bitmap changes no result
        got = substrings.deduplicate(docs, bits=bits).collect()
        assert order(tuple(r) for r in got) == order(brute(rows, 13))


def test_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(60):
        sequences = [[b"ab"[i : i + 1] for i in rng.choices((0, 1), k=rng.randint(0, 30))] for _ in range(3)]
        text = [b"ab"[i : i + 1] for i in rng.choices((0, 1), k=25)]
        got = substrings.SuffixAutomaton(sequences).matching(text)
        for end in range(len(text)):
            best = max(k for k in range(end + 2) if k == 0 or any(s[i : i + k] == text[end + 1 - k : end + 1] for s in sequences for i in range(len(s) - k + 1)))
            assert got[end] == best


def test_against_reference(spark):
    reference = ["one two three four five", "six seven eight", None]
    docs = spark.createDataFrame([(1, "zero one two three four nine six seven eight"), (2, None), (3, "one two")], "doc_id long, text string")
    got = substrings.against_reference(docs, reference, n=3, shard_words=5, shards_at_once=1).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [
        (1, 9, 7, hashlib.sha256(b"zero nine").hexdigest()),
        (2, 0, 0, hashlib.sha256(b"").hexdigest()),
        (3, 2, 0, hashlib.sha256(b"one two").hexdigest()),
    ]


def test_covered_counts_long_matches_whole():
    assert substrings.covered([1, 2, 3, 4, 0], 3).tolist() == [True, True, True, True, False]
    assert not substrings.covered([], 3).size and isinstance(substrings.covered([1], 3), np.ndarray)


def test_bitmap_agrees_with_spark(spark):
    rng = np.random.default_rng(0)
    ids, keys = rng.integers(-(2**40), 2**40, 500), rng.integers(-(2**63), 2**63 - 1, 500)
    df = spark.createDataFrame([(int(i), int(k)) for i, k in zip(ids, keys)], "id long, key long")
    made = substrings.Bitmap.of(df.select(substrings.with_doc_column(df["key"], df["id"]).alias("h")), "h", 500, 16)
    assert made.has(substrings.with_doc(keys.view(np.uint64), ids)).all()
    assert made.has(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)).mean() < 0.02


def test_bitmaps_let_no_larger_share_through_as_they_fill(spark):
    rng = np.random.default_rng(1)
    for n in (500, 20_000, 200_000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        made = substrings.Bitmap.of(spark.createDataFrame(__import__("pandas").DataFrame({"k": keys})), "k", n)
        assert made.has(keys.view(np.uint64)).all() and made.has(rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64)).mean() < 0.08


def test_both_ways_of_making_a_bitmap_agree(spark, monkeypatch):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS k")
    once = substrings.Bitmap.of(keys, "k", 5000)
    monkeypatch.setattr(substrings, "MOST_PLACES", 10)
    assert (substrings.Bitmap.of(keys, "k", 5000).words == once.words).all()
