"""Back-off language models over tables of n-grams, and class models over word classes.

A sentence's words are exploded with their histories; each order is one equi-join with the model on the n-gram
itself, so neither model nor text has to fit one task. Orders are few, so the joins are few; small models are broadcast by the optimizer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import let

from .features import SUMMED
from .storage import settled, spread

START, END, NO_CLASS = "<s>", "</s>", "<unk>"


def positions(sentences: DataFrame, order: int, words: Column | None = None) -> DataFrame:
    """doc_id, at, and h1..h{order}: the n-grams of 1 to order words that end at each word or at the sentence's end; h_k is null
    where the history (which begins with one START) is shorter."""
    if order < 2:
        raise ValueError("models of order 2 or more only")
    tokens = F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != "") if words is None else words
    seq = F.concat(F.array(F.lit(START)), tokens, F.array(F.lit(END)))

    def at_each(s: Column) -> Column:
        """The rows of one sentence, made before they are exploded: a row never carries its whole sentence."""

        def row(at: Column) -> Column:
            grams = [F.when(at >= k, F.array_join(F.slice(s, at - (k - 1), k), " ")).alias(f"h{k}") for k in range(1, order + 1)]
            contexts = [F.when(at >= k, F.array_join(F.slice(s, at - (k - 1), k - 1), " ")).alias(f"c{k}") for k in range(2, order + 1)]
            return F.struct(at.alias("at"), *grams, *contexts)

        return F.transform(F.sequence(F.lit(2), F.size(s)), row)

    return sentences.select("doc_id", F.inline(let(seq, at_each)))


def word_scores(sentences: DataFrame, model: DataFrame, order: int, words: Column | None = None) -> DataFrame:
    """doc_id, at, logp: the longest known n-gram's value plus the back-offs of the longer contexts; nothing known scores 0.

    model: ord, ngram, logp, backoff.
    """
    rows = positions(sentences, order, words)
    for k in range(1, order + 1):
        part = model.where(F.col("ord") == k).select(F.col("ngram").alias(f"h{k}"), F.col("logp").alias(f"p{k}"))
        rows = rows.join(part, f"h{k}", "left")
    for k in range(2, order + 1):
        part = model.where(F.col("ord") == k - 1).select(F.col("ngram").alias(f"c{k}"), F.col("backoff").alias(f"b{k}"))
        rows = rows.join(part, f"c{k}", "left")
    score = F.lit(0.0)
    for k in range(1, order + 1):
        # Longer n-grams that the history allows but the model lacks pay their context's back-off.
        paid = sum((F.when(F.col(f"h{j}").isNotNull(), F.coalesce(f"b{j}", F.lit(0.0))).otherwise(0.0) for j in range(k + 1, order + 1)), F.lit(0.0))
        score = F.when(F.col(f"p{k}").isNotNull(), F.col(f"p{k}") + paid).otherwise(score)
    return rows.select("doc_id", "at", score.alias("logp"))


def sentence_scores(sentences: DataFrame, model: DataFrame, order: int, words: Column | None = None) -> DataFrame:
    return word_scores(sentences, model, order, words).groupBy("doc_id").agg(F.sum("logp").alias("logp"))


def log10(p: Column) -> Column:
    """Decimal logarithm; 0 for 0."""
    return F.when(p == 0, 0.0).otherwise(F.log10(p))


def translate(sentences: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text (the words' classes), logp (sum of log10 of their probabilities). Words without class: NO_CLASS and 0."""
    words = F.filter(F.split(F.trim("text"), "\\s+"), lambda w: w != "")
    rows = sentences.select("doc_id", F.posexplode(words).alias("at", "word")).join(classes, "word", "left")
    made = rows.select("doc_id", "at", F.coalesce("class", F.lit(NO_CLASS)).alias("class"), log10(F.coalesce("p", F.lit(0.0))).alias("l"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "class")))
    return made.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["class"]), " ").alias("text"), F.sum("l").alias("logp"))


def class_model_scores(sentences: DataFrame, classes: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """doc_id, logp: the language model's value of the classes plus the words' own."""
    made = translate(sentences, classes)
    lm = sentence_scores(made, model, order).withColumnRenamed("logp", "_lm")
    return made.join(lm, "doc_id").select("doc_id", (F.col("_lm") + F.col("logp")).alias("logp"))


#: N-grams that are looked up at most; of more, a model is made whole.
MOST_ASKED = 500_000
WORD = re.compile("[^ \t\n\x0b\f\r]+")


def asked_grams(items: DataFrame, order: int) -> set[str] | None:
    """The n-grams and contexts that scoring items looks up; None where they are too many for a worker."""
    rows = positions(items, order).select(F.explode(F.array(*[f"h{k}" for k in range(1, order + 1)], *[f"c{k}" for k in range(2, order + 1)])).alias("g"))
    found = rows.where("g IS NOT NULL").distinct().limit(MOST_ASKED + 1).collect()
    return None if len(found) > MOST_ASKED else {r.g for r in found}


def gram_counts(sentences: DataFrame, order: int, asked: set[str] | None) -> DataFrame:
    """ord, context, ngram, n: all n-grams of 1 to order words by context. With `asked`, those with an asked context; of single words the others are
    one row without name. Summed by worker, in a table of bounded size, before anything is shuffled."""
    shared = sentences.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = shared.value, Counter()
        rest = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            keys = list(sums)
            ords = [len(g) for g in keys]
            columns = [pa.array(ords + [1], pa.int32()), pa.array([" ".join(g[:-1]) for g in keys] + [""]), pa.array([" ".join(g) for g in keys] + [None], pa.string()), pa.array([*sums.values(), rest], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["ord", "context", "ngram", "n"])
            sums.clear()

        for batch in batches:
            for text in batch.column(0):
                seq = [START, *WORD.findall(text.as_py()), END]
                if known is None:
                    sums.update(zip(seq[1:]))
                else:
                    own = [w for w in seq[1:] if w in known]
                    rest += len(seq) - 1 - len(own)
                    sums.update(zip(own))
                for k in range(2, order + 1):
                    grams = zip(*(seq[j:] for j in range(k)))
                    sums.update(grams if known is None else [g for g in grams if (g[0] if k == 2 else " ".join(g[:-1])) in known])
                if len(sums) > SUMMED:
                    yield from flushed()
                    rest = 0
        yield from flushed()

    made = spread(sentences.where(F.col("text").isNotNull()).select("text")).mapInArrow(run, "ord int, context string, ngram string, n bigint")
    return made.repartition("ord", "context", "ngram").groupBy("ord", "context", "ngram").agg(F.sum("n").alias("n"))


def estimate(sentences: DataFrame, order: int = 2, discount: float = 0.5, asked: DataFrame | None = None) -> DataFrame:
    """A model (ord, ngram, logp, backoff) with absolute discounting from sentences, for tests and demonstrations.

    asked: sentences that alone are to be scored; the model then has only entries that they can look up, with the values that they have in the whole model."""
    if order < 2:
        raise ValueError("models of order 2 or more only")
    wanted = None if asked is None else asked_grams(asked, order)
    counts = settled(gram_counts(sentences, order, wanted))
    sums = counts.groupBy("ord", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    own = counts.where("ngram IS NOT NULL")
    if wanted is not None:
        own = own.join(F.broadcast(sentences.sparkSession.createDataFrame([(g,) for g in wanted] or [("",)], "ngram string")), "ngram", "left_semi")
    out = own.join(sums, ["ord", "context"]).select("ord", "ngram", F.log10((F.col("n") - discount) / F.col("total")).alias("logp"))
    back = sums.where("ord > 1").select((F.col("ord") - 1).alias("ord"), F.col("context").alias("ngram"), F.log10(F.col("types") * discount / F.col("total")).alias("backoff"))
    return out.join(back, ["ord", "ngram"], "full").select("ord", "ngram", F.coalesce("logp", F.lit(-99.0)).alias("logp"), F.coalesce("backoff", F.lit(0.0)).alias("backoff"))
