"""Dataset preparation: breakdown, class filters, stratified heads and deterministic splits, by label and document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled, small

#: Documents that a range of ids holds on average.
RANGE = 1 << 16


def breakdown(docs: DataFrame) -> DataFrame:
    """label, n by label, and the row Total."""
    return docs.rollup("label").agg(F.count("*").alias("n"), F.grouping("label").alias("_g")).select(F.when(F.col("_g") == 1, "Total").otherwise(F.col("label")).alias("label"), "n")


def class_sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("label").agg(F.count("*").alias("class_size"))


def drop_small(docs: DataFrame, least: int) -> DataFrame:
    """Documents of the classes with `least` documents or more."""
    return docs.join(small(class_sizes(docs).where(F.col("class_size") >= least).select("label")), "label", "left_semi")


def dropped_labels(docs: DataFrame, least: int) -> DataFrame:
    return class_sizes(docs).where(F.col("class_size") < least).select("label")


def heads(docs: DataFrame, wanted: Column, order: str = "doc_id") -> DataFrame:
    """label, _last: the id of each class's k-th document by a numeric order column, where k is `wanted`, a column over class_size
    and least_size (the smallest class's). Null where k is 0.

    Only ids are looked at, and no task sees a whole class: ids are counted in ranges, the range that holds the k-th is found from the
    ranges' running sums, and ranked alone. Rows with one id share their fate.
    """
    ids = docs.select("label", F.col(order).alias("_id"))
    low, high, n = ids.agg(F.min("_id"), F.max("_id"), F.count("_id")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) * RANGE // max(1, n))
    ids = ids.withColumn("_range", F.floor((F.col("_id") - (low or 0)) / width))
    ranges = settled(ids.groupBy("label", "_range").agg(F.count("*").alias("_n")))
    sizes = ranges.groupBy("label").agg(F.sum("_n").alias("class_size"))
    least = sizes.agg(F.min("class_size")).first()[0]
    sizes = sizes.withColumn("least_size", F.lit(least)).withColumn("_k", wanted.cast("bigint"))
    upto = F.sum("_n").over(Window.partitionBy("label").orderBy("_range"))
    spot = ranges.withColumn("_upto", upto).join(small(sizes.select("label", "_k")), "label")
    spot = spot.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))).select("label", "_range", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_id"))
    last = ids.join(small(spot), ["label", "_range"]).withColumn("_place", place).where(F.col("_place") == F.col("_at")).select("label", F.col("_id").alias("_last"))
    return sizes.select("label").join(last, "label", "left")


def stratify(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first documents of each class, as many as the smallest class has."""
    return docs.join(small(heads(docs, F.col("least_size"), order)), "label").where(F.col(order) <= F.col("_last")).select(docs.columns)


def share_of(size: Column, split: float) -> Column:
    """round(size * split) in single precision, halves up."""
    return F.floor(size.cast("float") * F.lit(split).cast("float") + F.lit(0.5).cast("float"))


def split(docs: DataFrame, share: float = 0.1, order: str = "doc_id") -> DataFrame:
    """docs with is_test. A positive share takes the head of each class for testing; otherwise the head, 1 + share of
    the class, is for training and the rest for testing. Texts aren't shuffled."""
    placed = docs.join(small(heads(docs, share_of(F.col("class_size"), share if share > 0 else 1 + share), order)), "label")
    head = F.coalesce(F.col(order) <= F.col("_last"), F.lit(False))
    return placed.select(*docs.columns, (head if share > 0 else ~head).alias("is_test"))


def without_label(docs: DataFrame, label: str) -> DataFrame:
    """Documents of other labels; those without a label stay."""
    return docs.where(F.col("label").isNull() | (F.col("label") != label))


def labelled_by_id(contents: DataFrame, labels: DataFrame, key: str = "doc_id", order: str = "line") -> DataFrame:
    """Contents joined with labels by key; of rows with one key the last by order counts, on either side."""
    last = lambda df, c: df.groupBy(key).agg(F.max_by(c, order).alias(c))
    return last(contents, "text").join(last(labels, "label"), key)


def training_order(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Labels descending, documents ascending inside them: the order in which learners read."""
    return docs.orderBy(F.col("label").desc(), order)
