"""Text cleaning, normalisation, tokens and n-grams as Column functions: all of it stays in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: White space of the cleaning rules: Java's \s and all space separators.
GAP = "[\\s\\x0B\\p{Zs}]+"
#: What trimming takes away at either end: every character up to U+0020.
EDGE = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"
SEPARATOR = "-"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_low(text: Column) -> Column:
    return F.regexp_replace(text, EDGE, "")


def clean_space(text: Column) -> Column:
    """Trimmed, every run of white space one blank."""
    return F.regexp_replace(trim_low(text), GAP, " ")


def word_tokens(text: Column) -> Column:
    """Words of the trimmed text; trailing empty strings don't occur after trimming."""
    return F.split(trim_low(text), GAP)


def char_tokens(text: Column, drop_first: bool = True) -> Column:
    """Characters (code points) of the trimmed text. By the documented default the first one is left out."""
    chars = F.filter(F.split(trim_low(text), ""), lambda c: c != "")
    return F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))) if drop_first else chars


def ideograph_tokens(text: Column, drop_first: bool = True) -> Column:
    """Latin words and numbers whole, all other words by character."""

    def parts(w: Column) -> Column:
        chars = F.split(w, "")
        return F.when(w.rlike("^[A-Za-z0-9]+$"), F.array(w)).otherwise(F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))) if drop_first else chars)

    return F.flatten(F.transform(F.filter(F.split(trim_low(text), "\\s+"), lambda w: w != ""), parts))


def ngrams(tokens: Column, low: int = 1, high: int = 3, separator: str = SEPARATOR) -> Column:
    """All runs of low to high tokens, shorter orders first, each run's tokens joined."""

    def order(o: int, a: Column) -> Column:
        if o == 1:
            return a
        places = F.when(F.size(a) >= o, F.sequence(F.lit(1), F.size(a) - (o - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(a, i, o), separator))

    return let(tokens, lambda a: F.concat(*[order(o, a) for o in range(low, high + 1)]))


def char_word_ngrams(text: Column, char_order: int = 3, word_order: int = 1, drop_first: bool = True) -> Column:
    """Features of a text: character n-grams, then word n-grams, in one name space."""
    clean = clean_space(text)
    return F.concat(ngrams(char_tokens(clean, drop_first), 1, char_order), ngrams(word_tokens(clean), 1, word_order))


LOW = "".join(map(chr, range(33)))
BLANK = re.compile("[ \\t\\n\\x0b\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000]+")


def features_of(text: str, char_order: int = 3, word_order: int = 1, drop_first: bool = True) -> list[str]:
    """char_word_ngrams() of one string, for code that runs in Python."""
    clean = BLANK.sub(" ", text.strip(LOW)).strip(LOW)
    chars, words = list(clean)[1 if drop_first else 0 :], clean.split(" ")
    out = chars if char_order else []
    for tokens, order in ((chars, char_order), (words, word_order)):
        if tokens is words and order:
            out = out + words
        for n in range(2, order + 1):
            out = out + list(map(SEPARATOR.join, zip(*(tokens[k:] for k in range(n)))))
    return out


#: Characters of text that a function in Python makes its results of at a time.
SLICE = 1 << 18


def slices(texts: pd.Series) -> Iterator[pd.Series]:
    """texts in parts of some SLICE characters, so that what is made of them in Python is in memory for a part only, however large the batch."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t) if t is not None else 0
        if size > SLICE:
            yield texts.iloc[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts) or not len(texts):
        yield texts.iloc[begin:]


def by_text(f: Callable[[str | None], object], kind: DataType) -> Callable[[Column], Column]:
    """A Column function of a text function. Besides the Arrow batch, which Spark ends at 10,000 rows or 64 MB, a worker holds one text, and the results of some SLICE
    characters: batches don't become strings of Python, as they do in pandas."""
    to = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made, size = [], 0
            for text in texts:
                text = text.as_py()
                made.append(f(text))
                size += len(text or "")
                if size > SLICE:
                    yield pa.array(made, to)
                    made, size = [], 0
            yield pa.array(made, to)

    return run


def counted(features: Column) -> Column:
    """array<struct<feature, cnt>> by feature: a sort and its runs inside the row, so nothing is shuffled."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))

        def pair(at: Column) -> Column:
            ends = F.array_append(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), n + 1)
            return F.transform(F.arrays_zip(at.alias("a"), ends.alias("b")), lambda r: F.struct(F.element_at(s, r["a"]).alias("feature"), (r["b"] - r["a"]).cast("bigint").alias("cnt")))

        return let(starts, pair)

    empty = F.array().cast("array<struct<feature:string,cnt:bigint>>")
    return F.when(F.size(features) > 0, let(F.array_sort(features), runs)).otherwise(empty)


def regex_replace(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def lower_case(text: Column) -> Column:
    return F.lower(text)


def decontract(text: Column) -> Column:
    """Spells out 's, 'll, n't, 're and 'd."""
    for short, long in (("'s", " is"), ("'ll", " will"), ("n't", " not"), ("'re", " are"), ("'d", " would")):
        text = F.regexp_replace(text, f"{short}\\b", long)
    return text


def normalize_urls(text: Column) -> Column:
    """Scheme names and addresses become +URL+, each on its own: a whole address gives two."""
    return F.regexp_replace(text, "(?:ftp|ssh|https?)|://\\S+", "+URL+")


def normalize_currency(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{Sc}\\d+(,\\d+)*\\.?(\\d+)?", "+CURRENCY+")


def normalize_date(text: Column) -> Column:
    return F.regexp_replace(text, "\\b\\d+/\\d+/\\d+\\b", "+DATE+")


def normalize_time(text: Column) -> Column:
    return F.regexp_replace(text, "\\b\\d+:\\d+(:\\d+)?\\b", "+TIME+")


def normalize_numbers(text: Column) -> Column:
    return F.regexp_replace(text, "\\b\\d+(,\\d+)*(\\.\\d+)*(?:st|nd|rd|th|s|%)?\\b", "+NUMBER+")


def normalize_abbreviations(text: Column) -> Column:
    """Closes the gap between two initials."""
    return F.regexp_replace(text, "([A-Z]\\.)\\s*([A-Z]\\.)", "$1$2")


def normalize_punctuation(text: Column) -> Column:
    for pattern, to in (("[\\u2026\\u22ee\\ufe19]", "..."), ("\\p{Pd}", "-"), ("\\p{Pi}|\\p{Pf}", '"'), ("\\p{Ps}", "("), ("\\p{Pe}", ")")):
        text = F.regexp_replace(text, pattern, to)
    return text


def strip_trailing_quote(text: Column) -> Column:
    return F.regexp_replace(text, '"$', "")
