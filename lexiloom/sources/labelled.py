"""Readers and writers of labelled text, word lists, language models and sparse vectors as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABBED = "(?s)^(\\S+)\\t+(.*)$"
SPACED = "^\\s*(\\S+)\\s+(.*)$"


def lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """file, line_no (0-based), value. Gzip by suffix; encodings other than UTF-8 through the bytes of whole files."""
    if encoding.upper().replace("-", "") == "UTF8":
        raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    else:
        files = spark.read.format("binaryFile").load(path)
        raw = files.select(F.col("path").alias("file"), F.decode("content", encoding).alias("value"))
    parts = F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n")
    return raw.select("file", F.posexplode(parts).alias("line_no", "value"))


def parsed(line: Column) -> Column:
    """struct<label, text> of a line: label, tabs, text; else label, blanks, text; else null."""
    tabbed, spaced = F.regexp_extract(line, TABBED, 1), F.regexp_extract(line, SPACED, 1)
    return (
        F.when(line.rlike(TABBED), F.struct(tabbed.alias("label"), F.regexp_extract(line, TABBED, 2).alias("text")))
        .when(line.rlike(SPACED) & ~line.rlike("[\\n\\r]"), F.struct(spaced.alias("label"), F.regexp_extract(line, SPACED, 2).alias("text")))
    )


def label_to_line(label: Column) -> Column:
    """A label as a word: any label comes back from a line by label_from_line, also none, the empty one and those with white space."""
    return F.coalesce(F.concat(F.lit("="), F.url_encode(label)), F.lit("-"))


def label_from_line(label: Column) -> Column:
    return F.when(label != "-", F.url_decode(F.substr(label, F.lit(2))))


#: Escapes of the line ends to a pattern's dot (and $) other than \\n and \\r, and of the escaping backslash, which comes first.
ESCAPES = (("\\", "\\b"), ("\x85", "\\x"), ("\u2028", "\\u"), ("\u2029", "\\v"))


def text_to_line(text: Column) -> Column:
    """A text that a line gives back whole by text_from_line: it begins with a bar, so that its own blanks and tabs aren't taken for the gap behind the
    label, and unusual line ends are escaped."""
    for c, to in ESCAPES:
        text = F.replace(text, F.lit(c), F.lit(to))
    return F.concat(F.lit("|"), text)


def text_from_line(text: Column) -> Column:
    text = F.substr(text, F.lit(2))
    for c, to in reversed(ESCAPES):
        text = F.replace(text, F.lit(to), F.lit(c))
    return text


def labelled(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows with label and text; unparseable lines and empty texts are dropped."""
    made = rows.withColumn("_p", parsed(F.col(column)))
    return made.where("_p IS NOT NULL AND _p.text != ''").select(*[c for c in rows.columns if c != column], "_p.label", "_p.text")


def rejected(rows: DataFrame, column: str = "value") -> DataFrame:
    """The lines that have neither form, for the log."""
    return rows.where(parsed(F.col(column)).isNull())


def read_labelled(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """doc_id (by file and line), label, text."""
    return labelled(lines(spark, path, encoding).withColumn("doc_id", F.monotonically_increasing_id())).select("doc_id", "label", "text")


def files_as_labels(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """label, text of a folder of files: the label is the last three characters of the file's name."""
    return lines(spark, path, encoding).select(F.right("file", F.lit(3)).alias("label"), F.col("value").alias("text"))


def write_labelled(docs: DataFrame, path: str, compression: str = "none") -> None:
    docs.select(F.concat_ws("\t", "label", "text").alias("value")).write.option("compression", compression).text(path)


def write_by_label(docs: DataFrame, path: str) -> None:
    """One folder of text files for each label."""
    docs.select("label", F.col("text").alias("value")).write.partitionBy("label").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """A line for each document: label, text, and its ranked labels with scores. scores: label, text, labels (array of score and label)."""
    shown = F.array_join(F.transform("labels", lambda s: F.concat_ws(" -> ", s["label"], s["score"].cast("string"))), " ")
    scores.select(F.concat_ws(" ", "label", "text", F.lit(":::"), shown).alias("value")).write.text(path)


def sparse_from_text(text: Column, strict: bool = True) -> Column:
    """array<struct<idx, val>> of "idx:val idx:val ..." ; a malformed part raises, or is dropped where not strict."""
    parts = F.filter(F.split(F.trim(text), "\\s+"), lambda p: p != "")
    good = lambda p: p.rlike("^\\d+:\\S+$") & F.element_at(F.split(p, ":"), 2).try_cast("double").isNotNull()
    made = lambda p: F.struct(F.element_at(F.split(p, ":"), 1).cast("int").alias("idx"), F.element_at(F.split(p, ":"), 2).cast("double").alias("val"))
    if strict:
        bad = F.filter(parts, lambda p: ~good(p))
        return F.when(F.size(bad) > 0, F.raise_error(F.concat(F.lit("malformed sparse entry: "), bad[0]))).otherwise(F.transform(parts, made))
    return F.transform(F.filter(parts, good), made)


def sparse_to_text(entries: Column) -> Column:
    """"idx:val ..." of array<struct<idx, val>>, by index."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat_ws(":", e["idx"].cast("string"), e["val"].cast("string"))), " ")


def sparse_shown(entries: Column) -> Column:
    """"idx:val ..." with two decimals."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: F.format_string("%d:%.2f", e["idx"], e["val"])), " ")


def read_sparse(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, label, entries from lines "name label idx:val ..."."""
    rows = spark.read.text(paths)
    form = "^(\\S+)\\s+(\\S+)\\s+(.*)$"
    return rows.where(F.col("value").rlike(form)).select(*[F.regexp_extract("value", form, k).alias(n) for k, n in ((1, "name"), (2, "label"))], sparse_from_text(F.regexp_extract("value", form, 3)).alias("entries"))


def read_feature_values(rows: DataFrame, entries: DataFrame, column: str = "value") -> DataFrame:
    """idx, val of lines "feature" value, by a dictionary; a feature outside it raises."""
    form = '^"(.*)"\\s+(\\S+)$'
    made = rows.select(F.regexp_extract(column, form, 1).alias("feature"), F.regexp_extract(column, form, 2).cast("double").alias("val"))
    found = made.join(entries.select("feature", "idx"), "feature", "left")
    known = F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("no such feature: "), F.col("feature")))).otherwise(F.col("idx"))
    return found.select(known.cast("int").alias("idx"), "val")


def feature_values_to_text(rows: DataFrame) -> DataFrame:
    return rows.select(F.format_string('"%s" %f', "feature", "val").alias("value"))


def arpa(rows: DataFrame) -> DataFrame:
    """ord, ngram, logp, backoff from the lines of a language model (columns line_no, value).

    A line belongs to the last section header above it. Lines with another number of fields than the section's
    order allows are ignored; a missing back-off is 0.
    """
    header = F.regexp_extract("value", "^\\\\(\\d+)-grams:", 1)
    section = F.last(F.when(header != "", header.cast("int")), ignorenulls=True).over(Window.partitionBy(*(["file"] if "file" in rows.columns else [])).orderBy("line_no"))
    body = rows.withColumn("ord", section).where(F.col("ord").isNotNull() & (header == ""))
    parts = F.split(F.trim("value"), "\\s+")
    body = body.withColumn("_f", parts).where((F.size("_f") == F.col("ord") + 1) | (F.size("_f") == F.col("ord") + 2))
    return body.select(
        "ord",
        F.array_join(F.slice("_f", F.lit(2), F.col("ord")), " ").alias("ngram"),
        F.element_at("_f", 1).cast("double").alias("logp"),
        F.when(F.size("_f") == F.col("ord") + 2, F.element_at("_f", -1).cast("double")).otherwise(0.0).alias("backoff"),
    )


def word_classes(rows: DataFrame, column: str = "value") -> DataFrame:
    """word, class, p from lines "class p word", or "word class" with p = 1."""
    parts = F.split(F.trim(column), "\\s+")
    three = F.size(parts) == 3
    made = rows.where(F.size(parts).isin(2, 3)).select(
        F.when(three, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))).alias("word"),
        F.when(three, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1))).alias("class"),
        F.when(three, F.get(parts, F.lit(1)).try_cast("double")).otherwise(1.0).alias("p"),
    )
    return made


def morphs(rows: DataFrame, min_count: int = 1, column: str = "value") -> DataFrame:
    """word, segments, freq from lines "freq word seg + seg ..."; and an entry for unknown words."""
    form = "^\\s*(\\d+)\\s+(\\S+)\\s+(.*)$"
    made = rows.where(F.col(column).rlike(form)).select(
        F.regexp_extract(column, form, 2).alias("word"), F.split(F.regexp_extract(column, form, 3), "\\s*\\+\\s*").alias("segments"), F.regexp_extract(column, form, 1).cast("bigint").alias("freq")
    )
    unknown = rows.sparkSession.range(1).select(F.lit("--unk--").alias("word"), F.array(F.lit("oops")).alias("segments"), F.lit(0).cast("bigint").alias("freq"))
    return made.where(F.col("freq") >= min_count).unionByName(unknown)
