"""Features as numbers are the features by name."""

import random
from collections import Counter

import pytest

from lexiloom.functions import grams, text
from lexiloom.operators import features
from lexiloom.plans import queries

ODD = [" ", "", "a", "--", "- - -", "a-b a-b-c - a--", "\x00a\x00 b", "😀-é 😀-é-x", "\u2003x"]


def texts():
    rng = random.Random(0)
    return ODD + ["".join(rng.choice("a-b I\x00é😀\t ") for _ in range(rng.randint(0, 40))) for _ in range(300)]


@pytest.mark.parametrize("orders", [(3, 1, True), (1, 1, True), (2, 2, False), (0, 2, True), (3, 0, False), (4, 1, True)])
def test_keys_are_names(orders):
    """Counts by key and by name together are the counts by name, and no feature has both."""
    for t in texts():
        want = Counter(text.features_of(t, *orders)) if t else Counter()
        keys, counts, names = grams.counted(t, *orders)
        got = Counter(dict(zip(grams.names_of(keys).to_pylist(), counts.tolist())))
        assert len(got) == len(keys) and not set(got) & set(names) and (keys[1:] > keys[:-1]).all()
        assert got + Counter(names) == want
        made = grams.keys_of(list(want))
        assert sorted(made[made > 0].tolist()) == keys.tolist() and len(set(made.tolist())) == len(want)


def test_sums_and_places_of_odd_texts(spark, monkeypatch):
    """No string is made for an n-gram of characters, and sums and places are those of the names."""
    rows = [(k, "ab"[k % 2], t) for k, t in enumerate(texts()[:120])]
    want = Counter((y, f) for _, y, t in rows if t for f in text.features_of(t))
    monkeypatch.setattr(features.T, "features_of", None)
    docs = spark.createDataFrame(rows, "doc_id long, label string, text string")
    sums = features.sums(docs, ("label",))
    assert {(r.label, r.feature): r.cnt for r in sums.collect()} == want
    entries = features.dictionary(sums)
    found = features.located(docs, entries)
    assert found.agg({"cnt": "sum"}).first()[0] == sum(want.values())
    known = {r.idx: r.cnt for r in found.groupBy("idx").sum("cnt").withColumnRenamed("sum(cnt)", "cnt").collect()}
    assert all(known[r.idx] == r.cnt for r in entries.collect() if r.feature != features.UNKNOWN)


def test_test_documents_are_dealt_out(spark):
    """heads lie in a few partitions; what is scored lies in all."""
    _, test = queries.splits(spark, "/root/testdata/sf0.01")
    sizes = test.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 4 and min(sizes) > 0
