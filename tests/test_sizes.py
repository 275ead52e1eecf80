"""What keeps the core's steps bounded as their tables grow: nothing per feature or per word in a shuffle, and little in memory."""

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.functions import text, tokenizers
from lexiloom.operators import features, language_model, learners, model, storage, sweep
from lexiloom.plans import queries

TEXTS = ["the cat sat on the mat", "le chat est là", "the dog and the cat", "un chien et un chat", "a", "the the the"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, "en" if "the" in t or t == "a" else "fr", t) for k, t in enumerate(TEXTS)], "doc_id long, label string, text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_examples_are_stored_not_shuffled():
    """An example comes back from its bytes exactly, and the learners give what they give on a list."""
    rng = np.random.default_rng(0)
    counts = [(np.unique(rng.integers(0, 90_000, 40)), y) for y in rng.choice(list("ab"), 30)]
    scale = rng.random(90_000)
    plain, packed = [], []
    for d, (idx, y) in enumerate(counts):
        n = rng.integers(1, 70_000, len(idx))
        plain.append(((idx, n / max(float(n.sum()), 1.0) * scale[idx]), y, d))
        packed.append(learners.squeezed(idx, n))
        x = learners.loosened(learners.squeezed(*plain[-1][0]))
        assert (x[0] == idx).all() and (x[1] == plain[-1][0][1]).all()
    batch = pa.RecordBatch.from_arrays([pa.array([y for _, y in counts]), pa.array(range(30)), pa.array(packed, pa.binary())], ["label", "doc_id", "example"])
    stored = learners.Stored(iter([batch.slice(0, 11), batch.slice(11)]), scale)
    want = [(x, y) for x, y, _ in sorted(plain, key=lambda r: (-ord(r[1]), r[2]))]
    assert len(stored) == 30 and [y for _, y in stored] == [y for _, y in want]
    for method in ("perceptron", "mira", "svm"):
        got, same = (learners.learn(method, e, ["a", "b"], stored.dimension) for e in (stored, want))
        assert [tuple(map(str, r)) for r in learners.weight_rows(got)] == [tuple(map(str, r)) for r in learners.weight_rows(same)]


def test_training_shuffles_no_vectors(spark, docs):
    """The task that trains reads the examples' table; there is no group of all vectors."""
    rows = model.packed_rows(docs, features.dictionary(features.sums(docs)), model.Options()).withColumn("set_id", F.lit(0))
    trained = learners.train_many(rows, [{"config_id": 0, "set_id": 0, "method": "svm", "options": {}}])
    assert "FlatMapGroupsInPandas" not in plan(trained) and "Generate" not in plan(trained) and trained.count()


def test_rounds_end_when_the_weights_stand():
    class Counted(list):
        rounds = 0

        def __iter__(self):
            self.rounds += 1
            return super().__iter__()

    some = Counted([((np.array([0]), np.array([1.0])), "a"), ((np.array([1]), np.array([1.0])), "b")])
    learners.perceptron(some, ["a", "b"], 2, iterations=50)
    assert some.rounds < 10


def test_sweep_scores_in_rows(spark, docs, monkeypatch):
    """together, one configuration at a time, and by joins alike."""
    o = model.Options(char_order=1)
    entries, rows, scale = model.training_rows(docs, o)
    configs = [{"config_id": k, "set_id": 0, "method": m, "options": {}} for k, m in enumerate(("perceptron", "mira", "svm"))]
    weights = learners.train_many(rows.withColumn("set_id", F.lit(0)), configs, scale=scale).cache()
    test = docs.unionByName(spark.createDataFrame([(99, "en", "")], docs.schema))
    got = {}
    for name, most in (("all", None), ("each", 2 * entries.count()), ("join", 0)):
        if most is not None:
            monkeypatch.setattr(sweep.compact, "MOST_WEIGHTS", most)
        found = sweep.config_scores(test, entries, weights, o)
        got[name] = {(r.config_id, r.doc_id, r.label): round(r.score, 9) for r in found.collect() if r.score}
        assert ("Join" in plan(found)) == (name == "join")
    assert got["all"] == got["each"] == got["join"] and got["all"]


def test_summaries_are_made_in_rows(spark, docs):
    """the same as from the vectors, and no vector goes through a shuffle."""
    entries = features.dictionary(features.sums(docs))
    shown = lambda df: {r.doc_id: (r.n, round(r.total, 9), round(r.most, 9)) for r in df.collect()}
    for kind in ("llr", "log"):
        assert shown(features.summaries(docs, entries, kind)) == shown(features.summaries(docs, entries, kind, most=0))
    near, far = (features.frequency_background(docs, entries, most=m).where("std > 1e-9") for m in (None, 0))
    values = [{r.idx: (round(r.mean, 12), round(r.std, 9)) for r in b.collect()} for b in (near, far)]
    assert values[0] == values[1]
    assert shown(features.z_summaries(docs, entries, near)) == shown(features.z_summaries(docs, entries, far, most=0))
    assert "idx" not in plan(features.summaries(docs, entries))


def test_sums_of_small_tables(spark, docs, monkeypatch):
    """Counts and shares don't depend on how often a worker sends its table, and nothing is summed before the shuffle in the JVM."""
    want = {}
    for r in docs.collect():
        found = text.features_of(r.text)
        for f in found:
            n, s = want.get((r.label, f), (0, 0.0))
            want[r.label, f] = (n + 1, s + 1 / len(found))
    for most in (1 << 18, 3):
        monkeypatch.setattr(features, "SUMMED", most)
        got = {(r.label, r.feature): (r.cnt, r.share) for r in features.sums(docs, ("label",), shares=True).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1]) for k in want)


def test_a_lexicon_has_no_names(spark, docs):
    lexicon = features.Lexicon.of(features.dictionary(features.sums(docs))).open()
    assert not any(isinstance(v, (dict, list, pa.Array, pa.ChunkedArray)) for v in vars(lexicon).values())
    at, n = lexicon.places("the --unk-- zzz")
    assert n.sum() == len(text.features_of("the --unk-- zzz")) and len(set(at)) == len(at)


def test_document_summaries(spark):
    """counted in Python, without a lambda of the JVM for each feature."""
    docs = spark.createDataFrame([(1, "xbab a"), (2, ""), (3, None), (4, " ")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in features.doc_summaries(docs, char_order=1).collect()}
    assert got[1] == (4, 7, "a", 3) and 2 not in got and 3 not in got and got[4] == (1, 1, "", 1)
    assert "lambda" not in plan(queries.doc_feature_counts(spark, "/root/testdata/sf0.001"))


def test_lines_give_any_document_back(spark, tmp_path):
    """F8: leading blanks and tabs, line ends of all kinds, white space only, and labels with white space, empty or none."""
    texts = [" a", "\t\tb", "\n", "x\x85y z ", "ends\x85", "a\\b \\x \\\\u", "\r\n c", "plain"]
    rows = [(k, t, y) for k, (t, y) in enumerate((t, y) for t in texts for y in ("en", None, "", "a b", "=-"))] + [(99, "", "en"), (98, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.form, repr(r.label), r.n_chars) for r in queries.parse_labelled_lines(spark, str(tmp_path)).collect())
    flat = lambda t: len(__import__("re").sub("[\n\r]+", " ", t))
    assert got == sorted((k, f, repr(y), flat(t) if f else len(t)) for k, t, y in rows if t for f in (0, 1))


def test_parts_of_a_batch():
    """A function in Python makes its results for some text at a time."""
    texts = pd.Series(["x" * (text.SLICE // 2), None] * 8 + [""])
    parts = list(text.slices(texts))
    assert len(parts) >= 3 and pd.concat(parts).equals(texts) and [len(p) for p in text.slices(texts[:0])] == [0]


def test_tokens_of_long_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(k, None if k == 3 else f"Mr. {k} l'eau " * 200_00) for k in range(8)], "k int, t string").coalesce(1)
    got = {r.k: r.n for r in rows.select("k", F.size(tokenizers.TOKENIZERS["fr"](F.col("t"))).alias("n")).collect()}
    assert len(set(got[k] for k in got if k != 3)) == 1 and len(got) == 8


def test_texts_of_a_batch_are_strings_one_by_one(spark, monkeypatch):
    """beside Arrow's batch a worker has one text as a string, and the results are the same, in parts, with nulls, empty texts and all."""
    held = lambda t: [str(sum(isinstance(o, pd.Series) and len(o) > 9 for o in __import__("gc").get_objects())), t]
    few = spark.range(20).select(F.col("id").cast("string").alias("t")).coalesce(1)
    assert [r.got for r in few.select("t", tokenizers.tokenizer(held)("t").alias("got")).collect()] == [["0", str(k)] for k in range(20)]
    texts = ["", " ", None, "Mr. O'Neil's \"dog\", (etc.)", "\x1f", "été… 1 000"] * 400
    monkeypatch.setattr(text, "SLICE", 100)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    for lang, f in (("en", tokenizers.english), ("fr", tokenizers.french), ("ko", tokenizers.korean)):
        got = dict(rows.select("k", tokenizers.TOKENIZERS[lang](F.col("t"))).collect())
        assert got == {k: None if t is None else f(t) for k, t in enumerate(texts)}


def test_language_model_of_what_is_asked(spark):
    """the values of the whole model, and rows that don't carry their sentence."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS + ["", None, " the  cat "])], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the cat sat"), (2, "a zebra"), (3, "")], "doc_id long, text string")
    for order in (2, 3):
        whole, few = language_model.estimate(rows, order), language_model.estimate(rows, order, asked=items)
        assert few.count() < whole.count()
        values = [{r.doc_id: round(r.logp, 9) for r in language_model.sentence_scores(items, m, order).collect()} for m in (whole, few)]
        assert values[0] == values[1]
    assert "_seq" not in plan(language_model.positions(items, 2))


def test_words_are_peeled_once(monkeypatch):
    """A repeated word isn't peeled again, and what comes of it is the same."""
    words = ['"Mr.', "(l'eau),", "...", "word" * 10 + ".", "«été»"] * 50
    met = []
    monkeypatch.setattr(tokenizers, "peel", lambda w, kept, peel=tokenizers.peel: met.append(w) or peel(w, kept))
    short = tokenizers.peeler(tokenizers.FRENCH_KEPT)
    got = [short(w) for w in words]
    assert len(met) == 4 + 50 and got == [tokenizers.peel(w, tokenizers.FRENCH_KEPT) for w in words]


def test_training_keeps_one_copy_and_leaves_none(spark, docs, tmp_path, monkeypatch):
    """tasks read the examples where they were written, which go when the models are there; a settled table leaves no shuffle behind."""
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}")
    _, rows, scale = model.training_rows(docs, model.Options())
    rows = rows.withColumn("set_id", F.lit(0))
    batches = learners.laid_out(rows, storage.scratch(spark)).toArrow().to_batches()
    there, own = learners.Stored(iter(batches), scale), learners.Stored(iter(rows.toArrow().to_batches()), scale)
    assert {f.name for f in there.files} == {p for b in batches for p in b.column("file").to_pylist()} and len(there) == len(TEXTS)
    assert [(y, i.tolist(), v.tolist()) for (i, v), y in there] == [(y, i.tolist(), v.tolist()) for (i, v), y in own]
    before = {*tmp_path.iterdir()}
    models = [{"config_id": k, "set_id": 0, "method": "mira", "options": {"iterations": 1 + k}} for k in range(2)]
    trained = learners.train_many(rows, models, scale=scale)
    assert trained.select("config_id").distinct().count() == 2 and len(trained.inputFiles()) == 2  # a task for each
    made = {*tmp_path.iterdir()} - before
    assert all(p.name.startswith("table") and "example" not in spark.read.parquet(str(p)).columns for p in made)
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    left = shuffles()
    storage.settled(docs.repartition(3, "label").groupBy("label").count())
    assert shuffles() <= left


def test_partitions_follow_the_size_of_the_files(spark, tmp_path, monkeypatch):
    """A task behind a shuffle has a bounded part of the input, however large that is."""
    spark.range(4000).selectExpr("id AS doc_id", "md5(string(id)) AS text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(storage, "PART", 4000)
    few, many = (storage.parted(d, "text").rdd.getNumPartitions() for d in (docs.limit(1).coalesce(1), docs))
    assert many > 20 and few == many  # files count, not what a filter leaves
    assert features.sums(docs).rdd.getNumPartitions() == many


def test_dictionary_and_class_means_in_bounded_parts(spark, docs, tmp_path, monkeypatch):
    """Behind each shuffle a task has a bounded part of what was counted; class means are those of the documents' vectors, with UNKNOWN as a word too."""
    some = docs.unionByName(spark.createDataFrame([(90, "en", "--unk-- the zz"), (91, "fr", "--unk-- chat yy")], docs.schema))
    for k in range(2):
        sums = storage.settled(features.sums(some, ("label",), shares=True, char_order=1))
        parts = []
        with monkeypatch.context() as m:
            m.setattr(features, "settled", lambda df, s=features.settled: parts.append((df, s(df))) or parts[-1][1])
            entries = features.dictionary(sums)
        if k:
            shuffles = [re.findall(r"RepartitionByExpression \[feature\S+(?: ASC NULLS FIRST)?\], (\d+)", plan(df)) for df, _ in parts]
            assert len(parts) == 2 and all(len(n) == 1 and int(n[0]) > 4 for n in shuffles)
        means = {(r.label, r.idx): r.weight for r in model.class_means(sums, entries, some).collect()}
        want = {}
        sizes = {"en": 0, "fr": 0}
        for r in some.collect():
            sizes[r.label] += 1
        for r in features.normalised(features.located(some, entries, keys=("doc_id", "label"), char_order=1).withColumnRenamed("label", "_l"), "llr").join(some.select("doc_id", "label"), "doc_id").collect():
            want[r.label, r.idx] = want.get((r.label, r.idx), 0.0) + r.val / sizes[r.label]
        assert means.keys() == want.keys() and all(math.isclose(means[key], want[key]) for key in want)
        monkeypatch.setattr(storage, "PART", 300)


def test_rows_dealt_out_are_not_shuffled_to_count_them(spark, docs):
    """Test documents are dealt out once, not once more for each time that their partitions are asked for."""
    dealt = storage.dealt(docs.where("doc_id >= 0"), "doc_id").select("doc_id", "text")
    shuffles = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = shuffles()
    same = storage.spread(dealt.where("text != ''"))
    assert shuffles() == before and "RepartitionByExpression" in plan(same) and storage.partitions(same) == same.rdd.getNumPartitions()


def test_words_are_counted_many_texts_at_once():
    """as features_of() counts them, and nothing in Python for each word."""
    texts = ["a", " ", "a-b a-b-c", "là  　 zz zz\ta", "-", "the cat\nthe cat the"] * 3
    for orders in ({}, {"char_order": 0, "word_order": 2}, {"char_order": 2, "word_order": 3, "drop_first": False}, {"char_order": 4}):
        table = features.Table(True, **orders)
        table.AT_ONCE = 8
        want, shares = {}, {}
        for k, t in enumerate(texts):
            found = text.features_of(t, **orders)
            for f in found:
                want[f], shares[f] = want.get(f, 0) + 1, shares.get(f, 0) + 1 / len(found)
            table.add(t)
            if k == 7:
                table.settle()
        got, parts = {}, {}
        for columns in table.columns():
            for f, n, share in zip(*(c.to_pylist() for c in columns)):
                got[f], parts[f] = got.get(f, 0) + n, parts.get(f, 0) + share
        assert got == want and all(math.isclose(parts[f], shares[f]) for f in want)
