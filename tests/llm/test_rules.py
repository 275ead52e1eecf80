import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import rules


def documents(spark, n=300):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for d in range(n):
        bad = d % 5 == 0
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(5, 60))]
        rows.append((d, " ".join(w + "!!" if bad else w for w in words), "x"))
        labels.append((d, int(not bad)))
    rows += [(1000, None, "y"), (1001, "", "y"), (None, "some words", "y"), (1, rows[1][1], "y"), (1002, "word " * 60_000, "y")]
    labels += [(None, 1), (5000, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = documents(spark)
    got = rules.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    tested = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.95 and len(tested) > 40
    assert got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_column_equals_numpy(spark):
    docs, labels = documents(spark, 120)
    fitted = rules.train(docs, labels)
    stats = rules.statistics(F.coalesce("text", F.lit("")))
    rows = docs.select(fitted.column([stats[n] for n in rules.NAMES]).alias("s"), *[stats[n].alias(n) for n in rules.NAMES]).collect()
    x = np.array([[r[n] for n in rules.NAMES] for r in rows])
    assert fitted.rules and np.allclose([r.s for r in rows], fitted.score(x))
    assert any(len(r.terms) > 1 for r in fitted.rules) or len(fitted.rules) > 1


def test_one_class_and_no_labels(spark):
    docs, labels = documents(spark, 40)
    assert {r.score for r in rules.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert rules.classify(docs, labels.where("quality = 1")).where("score > 0.9").count() == docs.count()
    assert rules.classify(docs.limit(0), labels).count() == 0
