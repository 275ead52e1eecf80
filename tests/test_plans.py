import json
import threading
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import model
from lexiloom.plans import oracle, queries, stages
from lexiloom.scorer import Scorer, serve
from lexiloom.sources import labelled
from lexiloom.streaming import score

from .test_operators import CORPUS


def test_reader(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("en\thello\n  fr  salut toi\nx\nen\t\n", encoding="utf-8")
    got = labelled.read_labelled(spark, str(tmp_path / "d.tsv")).orderBy("doc_id").collect()
    assert [(r.label, r.text) for r in got] == [("en", "hello"), ("fr", "salut toi")]
    assert [r.line_no for r in labelled.rejected(labelled.lines(spark, str(tmp_path / "d.tsv"))).collect()] == [2]
    (tmp_path / "latin.pos").write_bytes("caf\xe9".encode("latin-1"))
    assert tuple(labelled.files_as_labels(spark, str(tmp_path / "latin.pos")).first()) == ("pos", "café")


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "label string, text string")
    labelled.write_labelled(docs, str(tmp_path / "l"), "gzip")
    assert {r.value for r in spark.read.text(str(tmp_path / "l")).collect()} == {"a\tx", "b\ty"}
    labelled.write_by_label(docs, str(tmp_path / "by"))
    assert spark.read.text(str(tmp_path / "by")).where("label = 'b'").first().value == "y"
    scores = docs.withColumn("labels", F.array(F.struct(F.lit(1.5).alias("score"), F.col("label"))))
    labelled.write_scores(scores, str(tmp_path / "s"))
    assert "a x ::: a -> 1.5" in {r.value for r in spark.read.text(str(tmp_path / "s")).collect()}


def test_sparse_text(spark, tmp_path):
    df = spark.createDataFrame([("3:1.5 1:2",)], "t string").select(labelled.sparse_from_text(F.col("t")).alias("e"))
    assert df.select(labelled.sparse_to_text(F.col("e")), labelled.sparse_shown(F.col("e"))).first()[:] == ("1:2.0 3:1.5", "1:2.00 3:1.50")
    bad = spark.createDataFrame([("3:x",)], "t string")
    assert bad.select(labelled.sparse_from_text(F.col("t"), strict=False)).first()[0] == []
    with pytest.raises(Exception, match="malformed"):
        bad.select(labelled.sparse_from_text(F.col("t"))).collect()
    (tmp_path / "v").write_text("n1 a 0:1 2:3\n")
    row = labelled.read_sparse(spark, str(tmp_path / "v")).first()
    assert (row.name, row.label, len(row.entries)) == ("n1", "a", 2)
    entries = spark.createDataFrame([("f", 4)], "feature string, idx int")
    assert labelled.read_feature_values(spark.createDataFrame([('"f" 2.5',)], "value string"), entries).first()[:] == (4, 2.5)
    with pytest.raises(Exception, match="no such feature"):
        labelled.read_feature_values(spark.createDataFrame([('"g" 1',)], "value string"), entries).collect()


def test_model_files(spark):
    text = ["", "\\data\\", "ngram 1=2", "ngram 2=1", "", "\\1-grams:", "-1.0 a -0.5", "-2 b", "-3 too many words here", "", "\\2-grams:", "-0.3 a b", "", "\\end\\"]
    rows = spark.createDataFrame(list(enumerate(text)), "line_no long, value string")
    assert {tuple(r) for r in labelled.arpa(rows).collect()} == {(1, "a", -1.0, -0.5), (1, "b", -2.0, 0.0), (2, "a b", -0.3, 0.0)}
    words = spark.createDataFrame([("C1 0.5 dog",), ("cat C2",), ("odd",)], "value string")
    assert {tuple(r) for r in labelled.word_classes(words).collect()} == {("dog", "C1", 0.5), ("cat", "C2", 1.0)}
    lines = spark.createDataFrame([("5 walked walk + ed",), ("1 rare r",)], "value string")
    assert {(r.word, tuple(r.segments)) for r in labelled.morphs(lines, 2).collect()} == {("walked", ("walk", "ed")), ("--unk--", ("oops",))}


def test_stages(spark):
    reg = stages.Registry()

    @reg
    def add(df, by=1):
        return df.withColumn("x", F.col("x") + by)

    df = spark.createDataFrame([(0, 1), (0, 2)], "set_id int, x int")
    done = stages.run("a = 0 :> add -> add[by=10]; b = a + 0 |> add * add", df, reg)
    assert sorted(r.x for r in done["a"].collect()) == [12, 13]
    assert sorted(r.x for r in done["b"].collect()) == [3, 4, 14, 15]
    assert stages.levels(stages.parse("a = 0 :> f; b = a :> f; c = a + b :> f")) == [["a"], ["b"], ["c"]]
    for text in ("a = b :> f; b = a :> f", "a = z :> f"):
        with pytest.raises(ValueError):
            stages.levels(stages.parse(text))
    for text in ("a = :> f", "a 0 :> f", "a = 0 :> f[", "a = 0 :> ?"):
        with pytest.raises(ValueError):
            stages.parse(text)
    assert dict(stages.parse('a = 0 :> f[x=1, y=-2.5, z="q r", w=abc]')[0].calls[0].options) == {"x": 1, "y": -2.5, "z": "q r", "w": "abc"}
    meta = spark.createDataFrame([(0, "m")], "set_id int, tag string")
    assert stages.with_metadata(df, ":", meta).count() == 2
    assert stages.with_metadata(df, "^", meta.select("tag")).first().tag == "m"


@pytest.fixture(scope="module")
def fitted(spark):
    return model.fit(spark.createDataFrame(CORPUS, "doc_id long, label string, text string"), model.Options(iterations=5))


def test_scorer_agrees_with_tables(spark, fitted):
    docs = spark.createDataFrame(CORPUS[:8], "doc_id long, label string, text string")
    one = Scorer(fitted)
    for r in fitted.scores(docs).where("rank = 1").join(docs.drop("label"), "doc_id").collect():
        label, confidence = one.label(r.text)
        assert label == r.label and abs(confidence - r.confidence) < 1e-6
    assert one.label("") == ("error: empty text string", 0.0) and one.all_labels(None) == []
    assert abs(sum(c for _, c in one.all_labels("le chat")) - 100) < 1e-9 and len(one.top("the", 1)) == 1


def test_service(fitted):
    server = serve(Scorer(fitted), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path, q="": urllib.request.urlopen(f"http://localhost:{server.server_port}{path}?q={urllib.parse.quote(q)}", timeout=10).read().decode()
    try:
        assert json.loads(get("/labels")) == {"labels": ["en", "fr"]}
        assert get("/classify", "le chien") == "fr"
        assert json.loads(get("/classify/json", "the dog"))["class"] == "en"
        assert [r["class"] for r in json.loads(get("/classify/all/json", "the dog"))["results"]] == ["en", "fr"]
    finally:
        server.shutdown()


def test_stream(spark, fitted, tmp_path):
    spark.createDataFrame(CORPUS, "doc_id long, label string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, label string, text string").parquet(str(tmp_path / "in"))
    score.run_once(score.scored(stream, fitted), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == len(CORPUS) and all(r.label == r.output for r in rows)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.tsv").write_text("".join(f"{y}\t{t}\n" for _, y, t in CORPUS), encoding="utf-8")
    assert cli.main(["-all", str(tmp_path / "d.tsv"), "-split", "0.2", "-iterations", "5", "-model", str(tmp_path / "m"), "-score", str(tmp_path / "s")], spark) == 1.0
    assert cli.main(["-test", str(tmp_path / "d.tsv"), "-model", str(tmp_path / "m")], spark) == 1.0
    assert cli.main(["-all", str(tmp_path / "none")], spark) == -1.0
    assert cli.config_file("a: 1 # c\n[s]\nb = {x\ny}\nc=\\#1") == {"": {"a": "1"}, "s": {"b": "x\ny", "c": "#1"}}


def test_every_oracle_has_a_query():
    assert set(oracle.ORACLE) <= set(queries.QUERIES)
