"""Feature counts, dictionaries with background probabilities, and normalised sparse vectors.

Long form throughout: counts (doc_id, label, feature, cnt), dictionary (feature, idx, cnt, p), vectors
(doc_id, idx, val). A document's features are counted inside its row, so only corpus-wide counts are shuffled, and
those with partial sums. The dictionary keeps the background probability next to the index. `located` looks features up inside the row too, where a
count shows the dictionary small enough to broadcast; a larger one is joined by feature (`indexed`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.functions import grams
from lexiloom.functions import text as T

from .storage import parted, ranged, settled, spread

UNKNOWN = "--unk--"
CUTOFF = 1e10
#: Dictionary entries that are broadcast at most, at 20 bytes each.
MOST_ENTRIES = 16_000_000
#: Features that a worker sums before it sends them on, and entries of vectors in a batch.
SUMMED = 1 << 18


def features(text: Column, char_order: int = 3, word_order: int = 1, drop_first: bool = True) -> Column:
    return T.char_word_ngrams(text, char_order, word_order, drop_first)


def doc_counts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "label"), **orders) -> DataFrame:
    """keys, feature, cnt. Documents without features give no rows.

    Counted document by document in Arrow batches, without a shuffle: four times as fast as the same in array
    functions (text.counted), whose lambdas are interpreted.
    """
    rows = spread(docs.select(*keys, F.coalesce("text", F.lit("")).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, names, counts = [], [], []
            for k, text in enumerate(batch.column("_text").to_pylist()):
                found = Counter(T.features_of(text, **orders) if text else ())
                place += [k] * len(found)
                names += found.keys()
                counts += found.values()
                if len(place) > SUMMED or k == batch.num_rows - 1:
                    at = pa.array(place, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(names, pa.string()), pa.array(counts, pa.int64())], [*keys, "feature", "cnt"])
                    place, names, counts = [], [], []

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, schema + ", feature string, cnt bigint")


def sums(docs: DataFrame, by: tuple[str, ...] = (), shares: bool = False, **orders) -> DataFrame:
    """by, feature, cnt: counts over all documents; with `shares` also share, the sums of the features' shares in each document.

    Summed over the task's documents before anything is shuffled, in tables of at most some SUMMED features (and four times as many entries that
    wait to be summed), so neither a worker's memory nor
    that of the tasks behind the shuffle follows the size of a partition.
    """
    rows = spread(docs.select(*by, F.coalesce("text", F.lit("")).alias("_text")))
    names = [*by, "feature"]
    kinds = [schema_type(rows, c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple, Table] = {}
        waiting = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for key, table in tables.items():
                for found in table.columns():
                    columns = [*(pa.array([v] * len(found[0]), k) for v, k in zip(key, kinds)), *found[: 3 if shares else 2]]
                    yield from pa.table(columns, [*names, "cnt", "share"][: len(columns)]).to_batches(SUMMED)
            tables.clear()

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by)) if by else ((),) * batch.num_rows
            for key, text in zip(keys, batch.column("_text")):
                if not (text := text.as_py()):
                    continue
                if key not in tables:
                    tables[key] = Table(shares, **orders)
                waiting += tables[key].add(text)
                if waiting > 4 * SUMMED:
                    waiting = 0
                    if sum(t.settle() for t in tables.values()) > SUMMED:
                        yield from flushed()
        yield from flushed()

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    made = rows.mapInArrow(run, schema + "feature string, cnt bigint" + ", share double" * shares)
    more = [F.sum("share").alias("share")] if shares else []
    # Sent by feature as they are: a sum before the shuffle would hold a whole partition's features once more, in one task.
    return parted(made, *names).groupBy(*names).agg(F.sum("cnt").alias("cnt"), *more)


class Table:
    """Counts of features, and with `shares` the sums of their shares of each document: of n-grams of characters as numbers, text by text; of the others by
    name, many texts at once. A word that looks like an n-gram may come twice, once from each."""

    #: Characters of texts whose words are counted at once.
    AT_ONCE = 1 << 20

    def __init__(self, shares: bool, char_order: int = 3, word_order: int = 1, drop_first: bool = True):
        self.shares, self.drop_first = shares, drop_first
        self.by_name = char_order > grams.LONGEST  # such n-grams have no numbers, and all features go by name
        self.char_order, self.word_order = char_order, word_order
        self.grams: list[tuple[np.ndarray, ...]] = []
        self.names: list[tuple] = []
        self.texts: list[str] = []
        self.weights: list[float] = []
        self.size = 0

    def add(self, text: str) -> int:
        """Adds a document's features, and says how many entries that are, at most."""
        if self.by_name:
            keys, counts, names = grams.counted(text, self.char_order, self.word_order, self.drop_first)
            total, n = int(counts.sum()) + sum(names.values()), np.fromiter(names.values(), np.int64, len(names))
            self.names.append((pa.array(names.keys(), pa.large_string()), n, *([n / max(total, 1)] if self.shares else [])))
        else:
            clean = grams.cleaned(text)
            keys, counts = grams.keys_counted(grams.char_grams(clean, self.char_order, self.drop_first))
            words = clean.count(" ") + 1
            # As many n-grams of words as of characters, by order: one less for each word more.
            names = range(sum(max(0, words - k) for k in range(self.word_order)))
            total = int(counts.sum()) + len(names)
            if self.word_order:
                self.texts.append(clean)
                self.weights.append(1 / max(total, 1))
                self.size += len(clean)
        if len(keys):
            self.grams.append((keys, counts, counts / total) if self.shares else (keys, counts))
        if self.size > self.AT_ONCE:
            self.count_words()
        return len(keys) + len(names)

    def count_words(self) -> None:
        if self.texts:
            self.names.append(grams.words_counted(self.texts, self.word_order, np.array(self.weights) if self.shares else None))
        self.texts, self.weights, self.size = [], [], 0

    def settle(self) -> int:
        """Sums what is there, and says how many features that are."""
        self.count_words()
        if len(self.grams) > 1:
            self.grams = [grams.merged(*map(np.concatenate, zip(*self.grams)))]
        if len(self.names) > 1:
            names, *values = zip(*self.names)
            self.names = [grams.summed(pa.concat_arrays(names).dictionary_encode(), *map(np.concatenate, values))]
        return sum(len(g[0]) for g in (*self.grams, *self.names))

    def columns(self) -> Iterator[list[pa.Array]]:
        """feature, cnt, and with `shares` share."""
        self.settle()
        for keys, *values in self.grams:
            yield [grams.names_of(keys), *map(pa.array, values)]
        for names, *values in self.names:
            yield [names.cast(pa.string()), *map(pa.array, values)]


def doc_summaries(docs: DataFrame, **orders) -> DataFrame:
    """doc_id, n_distinct, n_all, top_feature, top_cnt of every document with features: the first by name (in order of code points) of the most frequent."""
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made = [], []
            for k, text in enumerate(batch.column("_text")):
                found = Counter(T.features_of(text.as_py(), **orders) if len(text.as_py()) else ())
                if found:
                    most = max(found.values())
                    at.append(k)
                    made.append((len(found), found.total(), min(f for f, n in found.items() if n == most), most))
            if made:
                columns = zip(zip(*made), (pa.int64(), pa.int64(), pa.string(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in columns)], ["doc_id", "n_distinct", "n_all", "top_feature", "top_cnt"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_distinct bigint, n_all bigint, top_feature string, top_cnt bigint")


def schema_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def corpus_counts(counts: DataFrame) -> DataFrame:
    """feature, cnt. Counts by feature alone lie by feature already."""
    rows = counts if counts.columns[0] == "feature" else parted(counts.select("feature", "cnt"), "feature")
    return rows.groupBy("feature").agg(F.sum("cnt").alias("cnt"))


def ranked(df: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """df with the 0-based rank of a unique string column. Rows are sorted in sampled ranges, and a row's rank is its place in its
    range plus the rows of the ranges before; no task sees more than its range."""
    rows = settled(ranged(df, column).sortWithinPartitions(column).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    parts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return rows.withColumn(out, (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("int" if out == "idx" else "bigint")).drop("_m", "_part", "_before")


def dictionary(counts: DataFrame, min_count: int = 2, prune: float = 0.0) -> DataFrame:
    """feature, idx, cnt, p from the counts of the training documents.

    Features below min_count are one entry, UNKNOWN, whose mass is the number of such features; it takes the place of a feature
    of that very name. idx is the rank by name; a probability below prune becomes 0 (and its feature then weighs the cutoff).
    """
    found = settled(corpus_counts(counts))
    rare = found.where(F.col("cnt") < min_count).agg(F.lit(UNKNOWN).alias("feature"), F.count("*").alias("cnt"))
    entries = ranked(found.where((F.col("cnt") >= min_count) & (F.col("feature") != UNKNOWN)).unionByName(rare), "feature")
    total = entries.agg(F.sum("cnt")).first()[0] or 0
    p = F.col("cnt") / F.lit(float(total or 1))
    return entries.select("feature", "idx", "cnt", F.when((p >= prune) & F.lit(total > 0), p).otherwise(0.0).alias("p"))


def indexed(counts: DataFrame, entries: DataFrame, unknown: bool = True, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, idx, cnt, p: counts by dictionary entry, by a join. Features outside go to UNKNOWN together, or are dropped."""
    found = counts.join(entries.select("feature", "idx", "p"), "feature", "left" if unknown else "inner")
    if unknown:
        rest = entries.where(F.col("feature") == UNKNOWN).select("idx", "p").first()
        found = found.select(*keys, "cnt", F.coalesce("idx", F.lit(rest.idx)).alias("idx"), F.coalesce("p", F.lit(rest.p)).alias("p"))
    return found.groupBy(*keys, "idx").agg(F.sum("cnt").alias("cnt"), F.first("p").alias("p"))


class Lexicon:
    """Feature -> (index, probability), for use on the workers: 20 bytes an entry, keys in order (grams.keys_of), no names and no table of objects.

    N-grams of characters have exact keys, all others hashes. Two entries with one hash make `of` give None, so that the dictionary is joined by name.
    That one of m features outside a dictionary of n is taken for one inside has the probability m n / 2^63, a hundred-thousandth for ten million each.
    """

    def __init__(self, keys: np.ndarray, index: np.ndarray, prob: np.ndarray):
        self.keys, self.index, self.prob = keys, index, prob
        self.unknown = -1

    def __len__(self) -> int:
        return len(self.keys)

    def open(self) -> Lexicon:
        """With `unknown`, the place of UNKNOWN; `index` and `prob` are by place."""
        if self.unknown < 0:
            self.unknown = int(np.searchsorted(self.keys, grams.keys_of([UNKNOWN]))[0])
        return self

    @staticmethod
    def of(entries: DataFrame, most: int | None = None) -> Lexicon | None:
        """None where the dictionary has more than `most` entries (MOST_ENTRIES)."""
        if entries.count() > (MOST_ENTRIES if most is None else most):
            return None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column("feature").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(grams.keys_of(names)), batch.column("idx"), batch.column("p")], ["key", "idx", "p"])

        got = entries.select("feature", "idx", "p").mapInArrow(run, "key bigint, idx int, p double").toArrow()
        keys = got.column("key").to_numpy()
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            return None
        return Lexicon(keys, got.column("idx").to_numpy()[order], got.column("p").to_numpy()[order])

    def places(self, text: str | None, unknown: bool = True, **orders) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts; features outside go to UNKNOWN together, or are dropped."""
        keys, n, names = grams.counted(text, **orders)
        if names:
            more = grams.hashes(list(names))
            order = np.argsort(more)  # in order, neighbours are found in the cache
            keys, n = np.concatenate([more[order], keys]), np.concatenate([np.fromiter(names.values(), np.int64, len(names))[order], n])
        if not len(keys):
            return keys, n
        at = np.searchsorted(self.keys, keys)
        inside = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if inside.all():
            return at, n
        rest, at, n = int(n[~inside].sum()), at[inside], n[inside]
        if not unknown:
            return at, n
        same = at == self.unknown  # the feature of that very name
        if same.any():
            return at, n + rest * same
        return np.append(at, self.unknown), np.append(n, rest)


def in_rows(docs: DataFrame, entries: DataFrame, made: Callable, columns: str, types: list[pa.DataType], unknown: bool = True, keys: tuple[str, ...] = ("doc_id",), most: int | None = None, **orders) -> DataFrame | None:
    """keys and `columns`: what made(lexicon, places, counts) gives for each document, as arrays of one length, one for each column. Nothing is
    shuffled. None where the dictionary is too large to broadcast."""
    lexicon = Lexicon.of(entries, most)
    if lexicon is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = spread(docs.select(*keys, F.coalesce("text", F.lit("")).alias("_text")))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value.open()
        for batch in batches:
            owner, parts, size = [], [], 0
            for k, text in enumerate(batch.column("_text")):
                part = made(lex, *lex.places(text.as_py(), unknown, **orders))
                owner += [np.full(len(part[0]), k)]
                parts.append(part)
                size += len(part[0])
                if size > SUMMED or k == batch.num_rows - 1:
                    who = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(who) for c in keys), *(pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), types))], [*keys, *names])
                    owner, parts, size = [], [], 0

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(run, f"{schema}, {columns}")


def located(docs: DataFrame, entries: DataFrame, unknown: bool = True, keys: tuple[str, ...] = ("doc_id",), most: int | None = None, **orders) -> DataFrame:
    """keys, idx, cnt, p, tf: each document's counts by dictionary entry, and their shares of the document's counts."""

    def made(lex: Lexicon, at: np.ndarray, n: np.ndarray) -> tuple:
        return lex.index[at], n, lex.prob[at], n / max(n.sum(), 1)

    found = in_rows(docs, entries, made, "idx int, cnt bigint, p double, tf double", [pa.int32(), pa.int64(), pa.float64(), pa.float64()], unknown, keys, most, **orders)
    if found is None:
        return term_frequency(indexed(doc_counts(docs, keys, **orders), entries, unknown, keys), keys[0]).withColumnRenamed("val", "tf")
    return found


def multipliers(p: np.ndarray, kind: str = "llr", cutoff: float = CUTOFF) -> np.ndarray:
    """multiplier() of an array."""
    with np.errstate(divide="ignore"):
        made = np.sqrt(1 / p) if kind == "llr" else -np.log(p)
    return np.where(p > 0, np.minimum(cutoff, made), cutoff)


def summed(value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries, sum and maximum of a vector, as arrays of one number; of none where it has no entry."""
    some = slice(0, min(1, len(value)))
    return np.array([len(value)])[some], np.array([value.sum()])[some], np.array([value.max(initial=-np.inf)])[some]


def summaries(docs: DataFrame, entries: DataFrame, kind: str = "llr", cutoff: float = CUTOFF, most: int | None = None, **orders) -> DataFrame:
    """doc_id, n, total, most: entries, sum and maximum of each document's normalised vector, made inside its row: no vector is shuffled."""

    def made(lex: Lexicon, at: np.ndarray, n: np.ndarray) -> tuple:
        return summed(n / max(n.sum(), 1) * multipliers(lex.prob[at], kind, cutoff))

    found = in_rows(docs, entries, made, SUMMARY, SUMMARY_TYPES, most=most, **orders)
    return summary(normalised(located(docs, entries, most=most, **orders), kind, cutoff)) if found is None else summary_of_parts(found)


SUMMARY, SUMMARY_TYPES = "n bigint, total double, most double", [pa.int64(), pa.float64(), pa.float64()]


def summary(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("doc_id").agg(F.count("val").alias("n"), F.sum("val").alias("total"), F.max("val").alias("most"))


def summary_of_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))


#: Entries of vectors that a worker holds before it sums them by index.
HELD = 1 << 21


def frequency_background(docs: DataFrame, entries: DataFrame, most: int | None = None, **orders) -> DataFrame:
    """z_background() of the documents' term frequencies, without their vectors: a worker sums its entries by index before anything is shuffled."""
    lexicon = Lexicon.of(entries, most)
    if lexicon is None:
        return z_background(term_frequency(located(docs, entries, most=most, **orders)))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, n_docs, size = shared.value.open(), 0, 0
        places: list[np.ndarray] = []
        values: list[np.ndarray] = []

        def flushed() -> Iterator[pa.RecordBatch]:
            if size:
                at, where = np.unique(np.concatenate(places), return_inverse=True)
                value = np.concatenate(values)
                sums = (np.bincount(where, w) for w in (value, value * value))
                yield pa.RecordBatch.from_arrays([pa.array(lex.index[at], pa.int32()), *map(pa.array, sums)], ["idx", "s", "q"])
            places.clear()
            values.clear()

        for batch in batches:
            for text in batch.column(0):
                at, n = lex.places(text.as_py(), **orders)
                n_docs += len(at) > 0
                places.append(at)
                values.append(n / max(n.sum(), 1))
                size += len(at)
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(n_docs)]), pa.array([0.0])], ["idx", "s", "q"])

    parts = spread(docs.select(F.coalesce("text", F.lit("")).alias("_text"))).mapInArrow(run, "idx int, s double, q double")
    totals = settled(parts.groupBy("idx").agg(F.sum("s").alias("s"), F.sum("q").alias("q")))
    n = totals.where("idx = -1").agg(F.sum("s")).first()[0]
    return background_of(totals.where("idx >= 0"), n or 0.0)


def background_of(totals: DataFrame, n: float) -> DataFrame:
    """idx, mean, std from idx, s (sum), q (sum of squares) and the number of vectors."""
    mean = F.col("s") / F.lit(n or 1.0)
    spread = F.greatest(F.col("q") / F.lit(n or 1.0) - mean * mean, F.lit(0.0))
    return totals.select("idx", mean.alias("mean"), F.sqrt(spread).alias("std"))


def z_summaries(docs: DataFrame, entries: DataFrame, background: DataFrame, most: int | None = None, **orders) -> DataFrame:
    """summaries() of the z-normalised term frequencies, over the entries that the background has; it is broadcast with the dictionary."""
    if entries.count() <= (MOST_ENTRIES if most is None else most):
        got = background.select("idx", "mean", "std").toArrow()
        idx = got.column("idx").to_numpy()
        mean, std = (np.full(int(idx.max(initial=-1)) + 1, np.nan) for _ in range(2))
        mean[idx], std[idx] = got.column("mean").to_numpy(), got.column("std").to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast((mean, std))

        def made(lex: Lexicon, at: np.ndarray, n: np.ndarray) -> tuple:
            mean, std = shared.value
            idx, share = lex.index[at], n / max(n.sum(), 1)
            inside = idx < len(std)
            idx, share = idx[inside], share[inside]
            there = std[idx] > 0
            return summed((share[there] - mean[idx[there]]) / std[idx[there]])

        if (found := in_rows(docs, entries, made, SUMMARY, SUMMARY_TYPES, most=most, **orders)) is not None:
            return summary_of_parts(found)
    return summary(z_normalised(term_frequency(located(docs, entries, most=most, **orders)), background))


def term_frequency(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds val, the entry's share of its document's counts."""
    if "tf" in vectors.columns:
        return vectors.withColumnRenamed("tf", "val")
    return vectors.withColumn("val", F.col("cnt") / F.sum("cnt").over(Window.partitionBy(key)))


def multiplier(p: Column, kind: str = "llr", cutoff: float = CUTOFF) -> Column:
    """sqrt(1 / p) ("llr") or ln(1 / p) ("log"), at most the cutoff, which is also what p = 0 gives."""
    safe = F.when(p > 0, p)
    value = F.sqrt(F.lit(1.0) / safe) if kind == "llr" else F.log(F.lit(1.0) / safe)
    return F.coalesce(F.least(F.lit(cutoff), value), F.lit(cutoff))


def normalised(vectors: DataFrame, kind: str = "llr", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, idx, val: term frequency times the background multiplier."""
    return term_frequency(vectors).select("doc_id", "idx", (F.col("val") * multiplier(F.col("p"), kind, cutoff)).alias("val"))


def z_background(vectors: DataFrame) -> DataFrame:
    """idx, mean, std over all documents, where absent entries count as zero (population std)."""
    n = float(vectors.select("doc_id").distinct().count())
    return background_of(vectors.groupBy("idx").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("q")), n)


def z_normalised(vectors: DataFrame, background: DataFrame) -> DataFrame:
    """doc_id, idx, val: (x - mean) / std of the stored entries; null where the std is 0."""
    z = (F.col("val") - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    return vectors.join(background, "idx").select("doc_id", "idx", z.alias("val"))


def scaled(vectors: DataFrame, by: float) -> DataFrame:
    return vectors.withColumn("val", F.col("val") * by)


def thresholded(vectors: DataFrame, least: float) -> DataFrame:
    """Values below least become 0; their entries stay."""
    return vectors.withColumn("val", F.when(F.col("val") < least, 0.0).otherwise(F.col("val")))


def merged(a: DataFrame, b: DataFrame, dimension: int) -> DataFrame:
    """Vectors in the joint space: b's indices lie behind a's `dimension`."""
    return a.unionByName(b.withColumn("idx", F.col("idx") + dimension))


def chunked(ids: DataFrame, parts: int, order: str = "doc_id") -> DataFrame:
    """ids with set_id: consecutive chunks of round(n / parts) rows by order (one more or less chunk than parts can come of it)."""
    n = ids.count()
    size = int(n / parts + 0.5)
    if size < 1:
        raise ValueError("more parts than rows")
    numbered = positions(ids, order)
    return numbered.withColumn("set_id", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def positions(ids: DataFrame, order: str) -> DataFrame:
    """ids with _at, the 0-based place by an order column; sorted in sampled ranges, never in a single task."""
    return ranked(ids, order, "_at")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """doc_id, other_id, dot of all pairs of vectors of a and b that share an index (b: few vectors, such as class weights)."""
    right = b.select(F.col("doc_id").alias("other_id"), "idx", F.col("val").alias("_w"))
    return a.join(right, "idx").groupBy("doc_id", "other_id").agg(F.sum(F.col("val") * F.col("_w")).alias("dot"))


def totals(vectors: DataFrame, power: float = 2.0) -> DataFrame:
    """doc_id, total (sum), normp ((x . x) ** (power / 2))."""
    return vectors.groupBy("doc_id").agg(F.sum("val").alias("total"), F.pow(F.sum(F.col("val") * F.col("val")), F.lit(power / 2)).alias("normp"))
