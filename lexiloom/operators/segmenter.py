"""Sentence segmentation after Punkt: abbreviations and sentence starts from corpus statistics.

One pass tokenizes the corpus, in Arrow batches, and writes partial sums of everything that is counted, and the ends of each line, whose
neighbours lie in other lines. Whether a mark ends a sentence depends on the word before it and the word after it only, so decisions are made for
distinct pairs of words, as columns over the sums. Cutting is a second pass, with a broadcast of what the decisions found to be
abbreviations; everything else ends a sentence, so the broadcast grows with the abbreviations, not with the words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexiloom.functions.text import slices

from .features import ranked
from .storage import settled, small, spread

P_ABBREVIATION, ABBREVIATION, COLLOCATION, STARTER = 0.99, 0.3, 7.88, 30.0
EDGE = "<s>"
BOUNDARY = regex.compile(r'([.\s]+|[。۔…?!]"?)')
ENDED = regex.compile(r'^(.*?)([.\s]+|[。۔…?!]"?)$', regex.DOTALL)
PIECE = regex.compile(r'[^\s,;"]+')
REPEATED = regex.compile(r"[.!?]+")
SAME_LENGTH = str.maketrans("’‘`“”", "'''\"\"")


MARKS = set(".。۔…?!")


def tokens(line: str | None) -> list[tuple[str, int, str]]:
    """(word, end, kind) with kind Word or Boundary; a repeated mark of the same kind counts once, at its last place."""
    out: list[tuple[str, int, str]] = []
    for m in PIECE.finditer((line or "").translate(SAME_LENGTH)):
        word, end = m[0], m.end()
        if word[-1] not in MARKS:  # a piece holds no white space and no quote, so a boundary ends with a mark
            out.append((word, end, "Word"))
            continue
        found = ENDED.match(word)
        made = [(found[1], end - len(found[2]), "Word"), (found[2], end, "Boundary")] if found[1] else [(word, end, "Boundary")]
        for t in made:
            if out and out[-1][0] == t[0] and REPEATED.fullmatch(t[0]):
                out[-1] = t
            else:
                out.append(t)
    return out


TOKEN = StructType([StructField("word", StringType()), StructField("endpos", IntegerType()), StructField("kind", StringType())])


@F.pandas_udf(ArrayType(TOKEN))
def token_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for part in slices(texts):
            yield part.map(lambda t: [{"word": w, "endpos": e, "kind": k} for w, e, k in tokens(t)])


def contexts(lines: DataFrame) -> DataFrame:
    """doc_id, at, word, kind, prev, next, prev_line, next_line: neighbours over the whole corpus, and inside the line only.

    Lines are short rows in doc_id order; the corpus-wide neighbours of a line's ends come from the lines before and after it
    that have tokens, which are ranked in ranges of ids, so no task sees more than its range.
    """
    rows = lines.select("doc_id", token_column("text").alias("t")).where(F.size("t") > 0)
    rows = rows.withColumns({"_first": F.col("t")[0]["word"], "_last": F.element_at("t", -1)["word"], "_range": F.floor(F.col("doc_id") / (1 << 16))})
    inside = Window.partitionBy("_range").orderBy("doc_id")
    ends = rows.groupBy("_range").agg(F.min_by("_first", "doc_id").alias("_f"), F.max_by("_last", "doc_id").alias("_l"))
    over = Window.orderBy("_range")
    ends = ends.select("_range", F.lag("_l").over(over).alias("_before"), F.lead("_f").over(over).alias("_after"))
    rows = rows.withColumns({"_p": F.lag("_last").over(inside), "_n": F.lead("_first").over(inside)}).join(ends, "_range")
    rows = rows.withColumns({"_p": F.coalesce("_p", "_before", F.lit(EDGE)), "_n": F.coalesce("_n", "_after", F.lit(EDGE))})
    flat = rows.select("doc_id", "t", "_p", "_n", F.posexplode("t").alias("at", "x"))
    last = F.size("t") - 1
    before, after = F.get("t", F.col("at") - 1)["word"], F.get("t", F.col("at") + 1)["word"]
    return flat.select(
        "doc_id", "at", F.col("x.word").alias("word"), F.col("x.kind").alias("kind"),
        F.when(F.col("at") > 0, before).otherwise(F.col("_p")).alias("prev"), F.when(F.col("at") < last, after).otherwise(F.col("_n")).alias("next"),
        F.when(F.col("at") < last, after).otherwise(F.lit(EDGE)).alias("next_line"),
    )


def boundary(word: Column) -> Column:
    return word.rlike('^([.\\s]+|[。۔…?!]"?)$')


SUMS = "stat string, a string, b string, c string, n bigint, doc_id bigint, first string, second string, third string, last string"


def measured(lines: DataFrame) -> DataFrame:
    """What one pass over the lines gives, as rows of SUMS: partial sums of N, cA, cAB, cPN, cB inside the lines, of T (word before a
    boundary, boundary, word after it, inside the line), and a row "E" for each line with its first two and last two tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            ends: list[tuple] = []

            def flushed(sums=sums, ends=ends):
                rows = [(*k, n, None, None, None, None, None) for k, n in sums.items()] + ends
                kinds = (*[pa.string()] * 4, pa.int64(), pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 10, kinds)], SUM_NAMES)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [w for w, _, _ in tokens(text)]
                if not found:
                    continue
                sums["N", "", "", ""] += len(found)
                for w in found:
                    sums["cA", w, "", ""] += 1
                m = len(found)
                for k, w in enumerate(found):
                    if BOUNDARY.fullmatch(w):
                        sums["cB", "", "", ""] += 1
                        before, after = found[k - 1] if k else EDGE, found[k + 1] if k + 1 < m else EDGE
                        sums["T", before, w, after] += 1
                        if k:
                            sums["cAB", before, "", ""] += 1
                        if k and k + 1 < m:
                            sums["cPN", before, after, ""] += 1
                ends.append(("E", None, None, None, 1, doc, found[0], found[1] if m > 1 else None, found[-2] if m > 1 else None, found[-1]))
                if len(sums) + len(ends) > 1 << 18:
                    yield from flushed()
                    sums.clear()
                    ends.clear()
            yield from flushed()

    return settled(spread(lines.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, SUMS))


SUM_NAMES = [x.split()[0] for x in SUMS.split(", ")]


def at_ends(found: DataFrame) -> DataFrame:
    """stat, a, b, n of the boundaries that begin or end a line: their neighbours are in the lines before and after, in doc_id order.
    Lines are ranked in sampled ranges, whose ends are joined by one row a range."""
    ends = ranked(found.where("stat = 'E'").select("doc_id", "first", "second", "third", "last"), "doc_id", "_at")
    ends = ends.withColumn("_range", F.floor(F.col("_at") / (1 << 16)))
    inside = Window.partitionBy("_range").orderBy("_at")
    whole = Window.orderBy("_range")  # a row for 65,536 lines
    edges = ends.groupBy("_range").agg(F.min_by("first", "_at").alias("_f"), F.max_by("last", "_at").alias("_l"))
    edges = edges.select("_range", F.lag("_l").over(whole).alias("_before"), F.lead("_f").over(whole).alias("_after"))
    rows = ends.withColumns({"_p": F.lag("last").over(inside), "_n": F.lead("first").over(inside)}).join(edges, "_range")
    p, n = F.coalesce("_p", "_before", F.lit(EDGE)), F.coalesce("_n", "_after", F.lit(EDGE))
    one = F.col("second").isNull()
    none = F.lit("")

    def row(stat: str, a: Column, b: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(stat).alias("stat"), a.alias("a"), b.alias("b"), F.lit(1).cast("bigint").alias("n")))

    opens, closes = boundary(F.col("first")), boundary(F.col("last"))
    made = F.array(
        row("cAB", p, none, opens), row("cPN", p, F.coalesce("second", n), opens), row("cPN", F.coalesce("third", p), n, closes & ~one),
    )
    return rows.select(F.inline(F.filter(made, lambda x: x.isNotNull())))


def counts(lines: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """stat, a, b, n: N (tokens), cA (word), cAB (word before a boundary), cPN (words around a boundary), cB (boundaries).
    found: what measured() gave for the lines."""
    found = measured(lines) if found is None else found
    inner = found.where("stat NOT IN ('E', 'T')").select("stat", "a", "b", "n")
    return inner.unionByName(at_ends(found)).groupBy("stat", "a", "b").agg(F.sum("n").alias("n"))


def flog(x: float) -> float:
    return math.log(x) if x >= 1e-20 else -5000.0


def binomial_llr(a: float, w: float, p_boundary: float) -> float:
    known = a * flog(P_ABBREVIATION) + (w - a) * flog(1 - P_ABBREVIATION)
    return 2 * (known - (a * flog(p_boundary) + (w - a) * flog(1 - p_boundary)))


def start_ratio(s: float, w: float, b: float, n: float) -> float:
    """Log-likelihood ratio of w after a boundary: s together, w words, b boundaries, n tokens. 0 where it isn't defined."""
    if b <= 0 or n <= b or n <= 0:
        return 0.0
    p0, p, q = w / n, s / b, (w - s) / (n - b)
    null = s * flog(p0) + (b - s) * flog(1 - p0) + (w - s) * flog(p0) + (n - b - w + s) * flog(1 - p0)
    here = 0.0 if b == s else s * flog(p) + (b - s) * flog(1 - p)
    there = 0.0 if w == s else (w - s) * flog(q) + (n - b - w + s) * flog(1 - q)
    return 2 * (here + there - null)


def log(x: Column) -> Column:
    """flog() as a column."""
    return F.when(x >= 1e-20, F.log(x)).otherwise(-5000.0)


def whole(stats: DataFrame) -> tuple[float, float]:
    """Tokens and boundaries of the corpus."""
    got = {r.stat: r.n for r in stats.where("stat IN ('N', 'cB')").select("stat", "n").collect()}
    return float(got.get("N", 0)), float(got.get("cB", 0))


def known(llr_a: Column, llr_w: Column, p: Column) -> Column:
    """binomial_llr() as a column."""
    rest = llr_w - llr_a
    return F.lit(2) * (llr_a * log(F.lit(P_ABBREVIATION)) + rest * log(F.lit(1 - P_ABBREVIATION)) - llr_a * log(p) - rest * log(F.lit(1.0) - p))


def ratio(s: Column, w: Column, b: Column, n: Column) -> Column:
    """start_ratio() as a column."""
    one = F.lit(1.0)
    p0, p, q = w / n, s / F.when(b > 0, b), (w - s) / F.when(n > b, n - b)
    null = s * log(p0) + (b - s) * log(one - p0) + (w - s) * log(p0) + (n - b - w + s) * log(one - p0)
    here = F.when(b == s, 0.0).otherwise(s * log(p) + (b - s) * log(one - p))
    there = F.when(w == s, 0.0).otherwise((w - s) * log(q) + (n - b - w + s) * log(one - q))
    return F.when((b <= 0) | (n <= b), 0.0).otherwise(F.lit(2) * (here + there - null))


def stat(stats: DataFrame, name: str, key: str, value: str) -> DataFrame:
    return stats.where(F.col("stat") == name).select(F.col("a").alias(key), F.col("n").cast("double").alias(value))


def abbreviation_scores(stats: DataFrame) -> DataFrame:
    """word, score of all words before a boundary of one character, in column arithmetic."""
    n, cb = whole(stats)
    rows = stat(stats, "cAB", "word", "ab").join(stat(stats, "cA", "word", "w"), "word")
    size = F.length("word").cast("double")
    marks = F.when(boundary(F.col("word")), 2.0).otherwise(1.0)
    llr = known(F.col("ab"), F.col("w"), F.lit(cb / max(n, 1.0)))
    return rows.select("word", (llr * marks * F.exp(-(size + 1)) * F.pow(size, F.col("ab") - F.col("w"))).alias("score"))


#: Abbreviations, and pairs of an abbreviation and a word, that are broadcast at most.
MOST_ABBREVIATIONS = 2_000_000


@dataclass
class Statistics:
    """What cutting needs, in memory: which (word, mark) are abbreviations, and behind which of them which words begin a sentence."""

    abbreviations: set[tuple[str, str]]
    starts: set[tuple[str, str]]

    @staticmethod
    def collect(lines: DataFrame, most: int = MOST_ABBREVIATIONS) -> Statistics:
        """Natural languages have some thousands of abbreviations; beyond `most` the lines aren't text, and are refused."""
        found = measured(lines)
        stats = settled(counts(lines, found))
        n, cb = whole(stats)
        triples = settled(found.where("stat = 'T'").groupBy(F.col("a").alias("prev"), F.col("b").alias("mark"), F.col("c").alias("after")).agg(F.sum("n").cast("double").alias("n")))
        words, before = stat(stats, "cA", "prev", "w"), stat(stats, "cAB", "prev", "ab")
        pairs = triples.select("prev", "mark").distinct().join(words, "prev", "left").join(before, "prev", "left").na.fill(0.0, ["w", "ab"])
        size, rest = F.length("prev").cast("double"), F.least(F.lit(300.0), F.col("w") - F.col("ab"))
        score = known(F.col("ab"), F.col("w"), F.lit(cb / max(n, 1.0))) * F.when(boundary(F.col("prev")), 2.0).otherwise(1.0)
        score = score * F.exp(-F.least(F.lit(700.0), size + F.length("mark"))) * F.pow(size, -rest)
        abbreviations = settled(pairs.where(score > ABBREVIATION).select("prev", "mark"))
        ending = triples.join(small(abbreviations), ["prev", "mark"], "left_anti").groupBy("after").agg(F.sum("n").alias("begins"))
        ending = settled(ending)
        line_boundaries = float(ending.agg(F.sum("begins")).first()[0] or 0)
        around = stats.where("stat = 'cPN'").select(F.col("a").alias("prev"), F.col("b").alias("after"), F.col("n").cast("double").alias("s"))
        asked = triples.join(small(abbreviations), ["prev", "mark"], "left_semi").select("prev", "after").distinct()
        asked = asked.join(around, ["prev", "after"], "left").join(words, "prev", "left").join(stat(stats, "cA", "after", "wa"), "after", "left").join(ending, "after", "left").na.fill(0.0, ["s", "w", "wa", "begins"])
        all_n = F.lit(n)
        together = ratio(F.col("s"), F.col("wa"), F.col("w"), all_n)
        starter = ratio(F.col("begins"), F.lit(line_boundaries), F.col("wa"), all_n)
        starts = settled(asked.where((together <= COLLOCATION) & (starter > STARTER)).select("prev", "after"))
        if abbreviations.count() + starts.count() > most:
            raise ValueError("too many abbreviations to broadcast")
        return Statistics({tuple(r) for r in abbreviations.collect()}, {tuple(r) for r in starts.collect()})

    def kinds(self, text: str | None) -> list[tuple[str, int, str]]:
        """Tokens with boundaries told apart as Abbr and EndSent."""
        found, prev, out = tokens(text), EDGE, []
        for word, end, kind in found:
            if BOUNDARY.fullmatch(word):
                kind = "Abbr" if (prev, word) in self.abbreviations else "EndSent"
            out.append((word, end, kind))
            prev = word
        return out

    def sentences(self, text: str | None) -> list[str]:
        if not text:
            return []
        found, out, last = self.kinds(text), [], -1
        for k, (_, end, kind) in enumerate(found):
            if kind == "Word":
                continue
            prev = found[k - 1][0] if k else EDGE
            after, after_kind = (found[k + 1][0], found[k + 1][2]) if k + 1 < len(found) else (EDGE, "Word")
            cut = False
            if kind == "Abbr":
                cut = after[:1].isupper() and after_kind != "Abbr" and (prev, after) in self.starts
            elif kind == "EndSent":
                closing = regex.fullmatch(r"\p{Pf}", after) and len(regex.findall('[“”"]', text[last + 1 : end])) % 2 == 0
                cut = after[:1].isupper() or bool(closing)
            if cut:
                out.append(text[last + 1 : end].strip())
                last = end
        if last != len(text):
            out.append(text[last + 1 :].strip())
        return out


def split_sentences(docs: DataFrame, statistics: Statistics) -> DataFrame:
    """doc_id, at, sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(statistics)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in slices(texts):
                yield part.map(lambda t: shared.value.sentences(t))

    return spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(cut("text")).alias("at", "sentence"))
