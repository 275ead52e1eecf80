import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import dataset, evaluate, features, language_model, learners, model, segmenter, sweep

DOCS = [(1, "x", "aab"), (2, "x", "abb"), (3, "y", "bcc"), (4, "y", "ccb")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, label string, text string")


def background(docs, drop):
    counts = features.doc_counts(docs, char_order=2, drop_first=drop)
    return counts, features.dictionary(counts)


@pytest.mark.parametrize(
    ("drop", "want"),
    [
        (True, [("--unk--", 0, 9, 0.5625), ("b", 1, 4, 0.25), ("c", 2, 3, 0.1875)]),
        (False, [("--unk--", 0, 8, 1 / 3), ("a", 1, 3, 0.125), ("a-b", 2, 2, 1 / 12), ("b", 3, 5, 5 / 24), ("c", 4, 4, 1 / 6), ("c-c", 5, 2, 1 / 12)]),
    ],
)
def test_background(docs, drop, want):
    got = [tuple(r) for r in background(docs, drop)[1].orderBy("idx").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_tfllr(docs):
    counts, entries = background(docs, True)
    got = {(r.doc_id, r.idx): r.val for r in features.normalised(features.indexed(counts, entries)).collect()}
    assert math.isclose(got[1, 0], 1.0) and math.isclose(got[1, 1], 0.5) and (1, 2) not in got
    assert math.isclose(got[3, 0], 2 / 3) and math.isclose(got[3, 2], 1.1547005, rel_tol=1e-6)


def test_pruned_probability_weighs_the_cutoff(spark):
    rows = spark.createDataFrame([(0.0,), (0.25,), (1e-30,)], "p double").select(features.multiplier(F.col("p")).alias("m"), features.multiplier(F.col("p"), "log", 5.0).alias("l")).collect()
    assert [r.m for r in rows] == [1e10, 2.0, 1e10] and rows[0].l == 5.0 and math.isclose(rows[1].l, math.log(4))


def test_literal_unknown_feature(spark):
    docs = spark.createDataFrame([(1, "x", "--unk-- --unk-- a a")], "doc_id long, label string, text string")
    entries = features.dictionary(features.doc_counts(docs, char_order=0)).collect()
    assert {r.feature: r.cnt for r in entries} == {"--unk--": 0, "a": 2}


def test_ranked_is_a_rank(spark):
    names = [f"{a}{b}" for a in "azéb" for b in range(40)] + ["a", "z"]
    got = features.ranked(spark.createDataFrame([(n,) for n in names], "feature string"), "feature").orderBy("idx").collect()
    assert [r.feature for r in got] == sorted(names, key=str.encode) and [r.idx for r in got] == list(range(len(names)))


def test_z_and_vectors(spark):
    v = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], "doc_id long, idx int, val double")
    bg = {r.idx: (r.mean, r["std"]) for r in features.z_background(v).collect()}
    assert bg == {0: (2.0, 1.0), 1: (1.0, 1.0)}
    z = {(r.doc_id, r.idx): r.val for r in features.z_normalised(v, features.z_background(v)).collect()}
    assert z == {(1, 0): -1.0, (2, 0): 1.0, (1, 1): 1.0}
    assert [tuple(r) for r in features.totals(v).orderBy("doc_id").collect()] == [(1, 3.0, 5.0), (2, 3.0, 9.0)]
    assert {r.idx for r in features.merged(v, v, 5).collect()} == {0, 1, 5, 6}
    assert [r.n for r in features.chunked(spark.range(10).withColumnRenamed("id", "doc_id"), 3).groupBy("set_id").agg(F.count("*").alias("n")).orderBy("set_id").collect()] == [3, 3, 3, 1]


@pytest.mark.parametrize(("share", "sizes"), [(0.10, {5: 1, 10: 1, 15: 2, 75: 8}), (0.15, {5: 1, 10: 2, 15: 2, 75: 11}), (0.2, {5: 1, 10: 2, 15: 3, 75: 15}), (0, {5: 0, 10: 0}), (-0.2, {5: 1, 10: 2, 15: 3, 75: 15})])
def test_split(spark, share, sizes):
    rows = [(i, f"n{n}", "t") for n in sizes for i in range(n)]
    parts = dataset.split(spark.createDataFrame(rows, "doc_id long, label string, text string"), share)
    got = {r.label: r.t for r in parts.groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {f"n{n}": t for n, t in sizes.items()} and parts.count() == len(rows)


def test_dataset(spark):
    docs = spark.createDataFrame([(1, "a", "t"), (2, "a", "t"), (3, "b", "t"), (4, None, "t")], "doc_id long, label string, text string")
    assert {(r.label, r.n) for r in dataset.breakdown(docs).collect()} == {("a", 2), ("b", 1), (None, 1), ("Total", 4)}
    assert {r.doc_id for r in dataset.drop_small(docs, 2).collect()} == {1, 2}
    assert {r.doc_id for r in dataset.without_label(docs, "a").collect()} == {3, 4}
    assert {r.doc_id for r in dataset.stratify(docs.where("label IS NOT NULL")).collect()} == {1, 3}


def test_ranking_and_confidence(spark):
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (1, "c", -0.5), (2, "b", 0.0), (2, "a", 0.0)], "doc_id long, label string, score double")
    got = {(r.doc_id, r.label): (r["rank"], r.confidence) for r in evaluate.ranked(scores).collect()}
    assert [got[1, x][0] for x in "abc"] == [1, 2, 3] and got[2, "a"][0] == 1
    assert np.allclose([got[1, x][1] for x in "abc"], [54.654939, 33.149896, 12.195165], atol=1e-5)
    docs = spark.createDataFrame([(1,), (3,)], "doc_id long")
    assert {tuple(r) for r in evaluate.best_labels(docs, evaluate.ranked(scores)).select("doc_id", "label").collect()} == {(1, "a"), (3, evaluate.NO_TEXT)}


def test_evaluation(spark):
    out = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, output string")
    assert evaluate.accuracy(out).first().accuracy == 0.5
    assert [r.truth for r in evaluate.least_accurate(out, 2).collect()] == ["c", "a"]
    assert evaluate.confusion_table(out, ["a", "b", "c"]).where("truth = 'a'").first().b == 1
    reg = spark.createDataFrame([("1", 2.0), ("1", 1.0), ("3", 3.0)], "truth string, score double")
    assert {r.label: r.mse for r in evaluate.regression_errors(reg).collect()} == {"1": 0.5, "3": 0.0, "all": 1 / 3}


def test_perceptron_step():
    x = (np.array([0, 2]), np.array([1.0, 2.0]))
    first = learners.perceptron([(x, "b"), (x, "b")], ["a", "b", "c"], 3, 1, average=False)
    assert first.updates == 1 and np.allclose(first.weights, [[-0.5, 0, -1], [1, 0, 2], [-0.5, 0, -1]])


def test_passive_aggressive_step():
    x = (np.array([0, 2]), np.array([1.0, 2.0]))
    for slack, alpha in ((0.01, 0.01), (1.0, 0.2)):
        assert np.allclose(learners.passive_aggressive([(x, 1.0)], 3, 1, slack, average=False).weights, [[alpha, 0, 2 * alpha]])


def test_hildreth_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(50):
        k = rng.integers(1, 5)
        b, gram, c = rng.standard_normal(k), 2.0 * (1 + np.eye(k)), 0.3
        a = learners.hildreth(b, gram, c)
        slope = b - gram @ a
        assert ((slope < 1e-6) | (a > c - 1e-9)).all() and ((slope > -1e-6) | (a < 1e-9)).all()


def examples(n=60, seed=0):
    rng = np.random.default_rng(seed)
    centre = {"a": [3, 0, 0], "b": [0, 3, 0], "c": [0, 0, 3]}
    return [((np.arange(3), np.array(centre[y]) + 0.5 * rng.standard_normal(3)), y) for y in rng.choice(list("abc"), n)]


@pytest.mark.parametrize("method", ["mira", "perceptron", "svm", "svmopen"])
def test_learners_separate(method):
    found = learners.learn(method, examples(), ["a", "b", "c"], 3)
    assert np.mean([found.best(x) == y for x, y in examples(seed=1)]) > 0.95


def test_averaging_equals_mean_of_steps():
    some = examples(7)
    for learner in (learners.mira, learners.perceptron):
        steps = []
        for k in range(1, 15):  # weights after each step, by training on the first k examples of two rounds
            w = learner((some + some)[:k], ["a", "b", "c"], 3, 1, average=False).weights
            steps.append(w)
        assert np.allclose(learner(some, ["a", "b", "c"], 3, 2, average=True).weights, np.mean(steps, axis=0))


def test_regression_svr():
    rng = np.random.default_rng(1)
    data = [((np.arange(2), v), 2 * v[0] - v[1] + 0.5) for v in rng.standard_normal((80, 2))]
    found = learners.support_vector_regression(data, 2)
    assert np.allclose(found.weights[0], [2, -1], atol=0.2) and abs(found.extra["bias"] - 0.5) < 0.2


def test_unknown_learner():
    with pytest.raises(ValueError):
        learners.learn("none", [], [], 1)


CORPUS = [(k, y, f"{w} {w} {v}") for k, (y, w, v) in enumerate([("en", "the cat", "hat"), ("en", "the dog", "that"), ("fr", "le chat", "été"), ("fr", "le chien", "déjà")] * 6)]


def test_model_roundtrip(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS, "doc_id long, label string, text string")
    fitted = model.fit(docs, model.Options(iterations=5))
    assert evaluate.accuracy(fitted.outputs(docs)).first().accuracy == 1.0
    fitted.save(str(tmp_path / "m"))
    again = model.Model.load(spark, str(tmp_path / "m"))
    assert again.labels == ["en", "fr"] and evaluate.accuracy(again.outputs(docs)).first().accuracy == 1.0
    empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.label for r in again.predict(empty).collect()} == {evaluate.NO_TEXT}


def test_sweep(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id long, label string, text string")
    runs = sweep.sweep(spark, docs, sweep.grid(iterations=[1, 2], char_order=[1], method=["mira", "perceptron"]))
    assert runs.count() == 4 and sweep.best(runs).first().accuracy == 1.0
    assert len(sweep.grid(**sweep.MIRA_GRID)) == 38_000 and len(sweep.grid(**sweep.SVM_GRID)) == 80_256 // 12
    logs = spark.createDataFrame([("a", "accuracy 0.5"), ("b", "x"), ("b", "final accuracy: 0.75"), ("a", "accuracy none")], "file string, value string")
    assert tuple(sweep.best_of_logs(logs).first()) == ("b", 0.75)


def test_language_model(spark):
    lm = spark.createDataFrame([(1, "a", -1.0, -0.5), (1, "b", -2.0, -0.25), (1, "</s>", -3.0, 0.0), (1, "<s>", -99.0, -0.1), (2, "a b", -0.3, 0.0), (2, "b </s>", -0.2, 0.0)], "ord int, ngram string, logp double, backoff double")
    rows = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "zz"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: round(r.logp, 6) for r in language_model.sentence_scores(rows, lm, 2).collect()}
    # <s> a: -0.1 - 1; a b: -0.3; b </s>: -0.2
    assert got == {1: -1.6, 2: round(-0.1 - 2 + -0.25 - 1 + -0.5 - 3, 6), 3: -3.0, 4: -3.1}
    classes = spark.createDataFrame([("a", "A", 0.1), ("b", "B", 0.01)], "word string, class string, p double")
    made = {r.doc_id: (r.text, round(r.logp, 6)) for r in language_model.translate(rows, classes).collect()}
    assert made[1] == ("A B", -3.0) and made[3] == ("<unk>", 0.0)
    with pytest.raises(ValueError):
        language_model.positions(rows, 1)


def test_segmenter(spark):
    assert segmenter.tokens('Hi there. "Go!!" he') == [("Hi", 2, "Word"), ("there", 8, "Word"), (".", 9, "Boundary"), ("Go!", 14, "Word"), ("!", 15, "Boundary"), ("he", 19, "Word")]
    lines = spark.createDataFrame([(1, "We met Dr. Who."), (2, "He left. Then rain came."), (3, None), (4, "Dr. No is here.")], "doc_id long, text string")
    got = {(r.stat, r.a, r.b): r.n for r in segmenter.counts(lines).collect()}
    assert got["N", "", ""] == 19 and got["cB", "", ""] == 6 and got["cAB", "Dr", ""] == 2
    assert got["cPN", "left", "Then"] == 1 and got["cPN", "Who", "He"] == 1
    stats = segmenter.Statistics.collect(lines)
    cut = segmenter.split_sentences(lines, stats).where("doc_id = 2").orderBy("at").collect()
    assert [r.sentence for r in cut] == ["He left.", "Then rain came."]


def test_start_ratio_is_defined_everywhere():
    assert segmenter.start_ratio(0, 0, 0, 10) == 0.0 and segmenter.start_ratio(5, 5, 10, 10) == 0.0
    assert segmenter.start_ratio(9, 10, 10, 1000) > segmenter.start_ratio(1, 10, 10, 1000)


def test_counts_agree_with_the_contexts_of_all_tokens(spark):
    import random

    rng = random.Random(5)
    words = ["a", "Dr.", "b!", "...", ".", "?", "c?!", "d..", "e", "!!", "“f”", "g;h"]
    rows = [(k * 7 - 50, " ".join(rng.choices(words, k=rng.randint(0, 6)))) for k in range(80)] + [(9000, None), (9001, "."), (9002, "!")]
    lines = spark.createDataFrame(rows, "doc_id long, text string")
    every = segmenter.contexts(lines).collect()
    want = {("N", "", ""): len(every)}
    for r in every:
        keys = [("cA", r.word, "")]
        if segmenter.BOUNDARY.fullmatch(r.word):
            keys += [("cAB", r.prev, ""), ("cPN", r.prev, r.next), ("cB", "", "")]
        for k in keys:
            want[k] = want.get(k, 0) + 1
    assert {(r.stat, r.a, r.b): r.n for r in segmenter.counts(lines).collect()} == want
    assert segmenter.counts(lines.limit(0)).where("n > 0").count() == 0


def test_columns_agree_with_the_formulas(spark):
    cases = [(float(s), float(w), float(b), float(n)) for s in (0, 1, 3) for w in (0, 3, 9) for b in (0, 3, 10) for n in (10, 50)]
    frame = spark.createDataFrame(cases, "s double, w double, b double, n double")
    got = frame.select("*", segmenter.ratio(F.col("s"), F.col("w"), F.col("b"), F.col("n")).alias("r"), segmenter.known(F.col("s"), F.col("w"), F.lit(0.2)).alias("k")).collect()
    for r in got:
        assert math.isclose(r.r, segmenter.start_ratio(r.s, r.w, r.b, r.n), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.k, segmenter.binomial_llr(r.s, r.w, 0.2), rel_tol=1e-9, abs_tol=1e-9)


def test_an_svm_scores_what_was_trained(spark):
    """Votes and biases of the pairs reach the saved model: in the row, by joins, and in a plain training on the same vectors."""
    docs = spark.createDataFrame(CORPUS + [(100 + k, "de", f"die katze {k}") for k in range(6)], "doc_id long, label string, text string")
    o = model.Options(method="svm", char_order=1)
    fitted = model.fit(docs, o)
    rows = learners.in_order(model.packed_rows(docs, fitted.dictionary, o).toPandas())
    plain = learners.svm(rows, ["de", "en", "fr"], fitted.dictionary.count())
    want = [plain.best(x) for x, _ in rows]
    order = [r.doc_id for r in docs.orderBy(F.col("label").desc(), "doc_id").collect()]
    for most in (None, 0):
        with pytest.MonkeyPatch.context() as m:
            if most == 0:
                m.setattr(features, "MOST_ENTRIES", 0)
            got = {r.doc_id: r.label for r in fitted.predict(docs).collect()}
        assert [got[d] for d in order] == want
    runs = sweep.sweep(spark, docs, [{"method": "svm", "char_order": 1}, {"method": "svm", "char_order": 1, "c": 4.0}, {"cutoff": 1e-9, "char_order": 1}]).collect()
    assert len(runs) == 3 and len({r.n for r in runs}) == 1 and all(0 <= r.accuracy <= 1 for r in runs)


def test_regression_end_to_end(spark):
    docs = spark.createDataFrame([(k, str(float(k % 3)), " ".join(["low", "mid", "high"][k % 3] for _ in range(4))) for k in range(60)], "doc_id long, label string, text string")
    for method in ("mira", "svm"):
        fitted = model.fit(docs, model.Options(method=method, regress=True, slack=1.0))
        errors = {r.label: r.mse for r in evaluate.regression_errors(fitted.values(docs)).collect()}
        assert errors["all"] < 0.2
    with pytest.raises(Exception, match="perceptron has no regression"):
        model.fit(docs, model.Options(method="perceptron", regress=True)).weights.count()


def test_dictionary_by_join_and_in_the_row(spark, docs):
    entries = features.dictionary(features.sums(docs))
    for unknown in (True, False):
        near, far = (sorted(tuple(r) for r in features.located(docs, entries, unknown, most=m).select("doc_id", "idx", "cnt", "p", F.round("tf", 12)).collect()) for m in (None, 0))
        assert near == far
    by = {(r.label, r.feature): r.cnt for r in features.sums(docs, ("label",)).collect()}
    want = {}
    for r in features.doc_counts(docs).collect():
        want[r.label, r.feature] = want.get((r.label, r.feature), 0) + r.cnt
    assert by == want
