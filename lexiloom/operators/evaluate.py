"""Linear scores, ranking, confidence, and the evaluation of classifiers and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learners import PAIR
from .storage import small

NO_TEXT = "error: empty text string"


def linear_scores(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, label, score. vectors: (doc_id, idx, val); weights: (label, idx, weight). Every document gets every label."""
    labels = weights.select("label").distinct()
    dots = vectors.join(weights, "idx").groupBy("doc_id", "label").agg(F.sum(F.col("val") * F.col("weight")).alias("score"))
    every = vectors.select("doc_id").distinct().join(small(labels))
    return every.join(dots, ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))


def votes(margins: DataFrame) -> DataFrame:
    """doc_id, label, score from the margins of pairs of classes: a class's votes, then its margins."""
    pair = F.split("label", PAIR)
    bent = F.lit(1e-3) * F.tanh("score")
    first = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    both = F.array(F.struct(pair[0].alias("label"), (first + bent).alias("score")), F.struct(pair[1].alias("label"), (F.lit(1.0) - first - bent).alias("score")))
    return margins.select("doc_id", F.inline(both)).groupBy("doc_id", "label").agg(F.sum("score").alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """scores with rank (1 is best; ties by label) and confidence (softmax in per cent over the document's labels)."""
    by_doc = Window.partitionBy("doc_id")
    rank = F.row_number().over(by_doc.orderBy(F.col("score").desc(), "label"))
    scores = scores.withColumns({"rank": rank, "_top": F.max("score").over(by_doc)})
    part = F.exp(F.col("score") - F.col("_top"))
    return scores.withColumn("_e", part).withColumn("confidence", F.lit(100.0) * F.col("_e") / F.sum("_e").over(by_doc)).drop("_top", "_e")


def top(ranking: DataFrame, n: int = 1) -> DataFrame:
    return ranking.where(F.col("rank") <= n)


def best_labels(docs: DataFrame, ranking: DataFrame) -> DataFrame:
    """doc_id, label, confidence for every document; a document without text gets NO_TEXT and 0."""
    found = top(ranking).select("doc_id", "label", "confidence")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(NO_TEXT)).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def as_array(ranking: DataFrame) -> DataFrame:
    """doc_id, labels: the ranked labels as array<struct<score, label>>."""
    item = F.struct("rank", "score", "label")
    return ranking.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["score"], s["label"])).alias("labels"))


def confusion(outputs: DataFrame) -> DataFrame:
    """truth, output, n from (truth, output) rows."""
    return outputs.groupBy("truth", "output").agg(F.count("*").alias("n"))


def confusion_table(outputs: DataFrame, labels: list[str]) -> DataFrame:
    """One row a truth, one column a label, and n and accuracy."""
    table = outputs.groupBy("truth").pivot("output", labels).count().na.fill(0)
    return table.join(class_accuracy(outputs), "truth")


def class_accuracy(outputs: DataFrame) -> DataFrame:
    """truth, n, accuracy."""
    return outputs.groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("output")).cast("double")).alias("accuracy"))


def accuracy(outputs: DataFrame) -> DataFrame:
    """n, correct, accuracy of all rows."""
    right = (F.col("truth") == F.col("output")).cast("int")
    return outputs.agg(F.count("*").alias("n"), F.sum(right).alias("correct"), F.avg(right.cast("double")).alias("accuracy"))


def least_accurate(outputs: DataFrame, n: int = 5) -> DataFrame:
    """The n truths with the least accuracy; equal accuracies all keep their rows, ordered by name."""
    return class_accuracy(outputs).orderBy("accuracy", "truth").limit(n)


def regression_errors(outputs: DataFrame) -> DataFrame:
    """label, n, mse by numeric truth label, and the row "all"."""
    error = F.pow(F.col("score") - F.col("truth").cast("double"), F.lit(2.0))
    rows = outputs.withColumn("_e", error)
    rolled = rows.rollup("truth").agg(F.count("*").alias("n"), F.avg("_e").alias("mse"), F.grouping("truth").alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("truth").cast("string")).alias("label"), "n", "mse")


def least_row(rows: DataFrame, value: str, name: str) -> DataFrame:
    """name and value of the row with the greatest value."""
    return rows.agg(F.max_by(name, value).alias(name), F.max(value).alias(value))
