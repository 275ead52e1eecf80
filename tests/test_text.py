import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import markup, text, tokenizers


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "t string").select(column_of(F.col("t"))).first()[0]


def test_features_literal(spark):
    got = one(spark, text.char_word_ngrams, "ab  c")
    assert sorted(got) == sorted(["b", " ", "c", "b- ", " -c", "b- -c", "ab", "c"])
    assert len(one(spark, lambda c: text.char_word_ngrams(c, drop_first=False), "ab  c")) == 4 + 3 + 2 + 2


def test_counted(spark):
    got = one(spark, lambda c: text.counted(text.char_word_ngrams(c)), "ab  c")
    assert {r.feature: r.cnt for r in got} == {"b": 1, " ": 1, "c": 2, "b- ": 1, " -c": 1, "b- -c": 1, "ab": 1}
    assert one(spark, lambda c: text.counted(F.array().cast("array<string>")), "x") == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n é　c", max_size=12), min_size=1, max_size=8))
def test_python_features_agree(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.char_word_ngrams(F.col("t"), 3, 2).alias("f")).collect()
    for r in rows:
        assert sorted(r.f) == sorted(text.features_of(r.t, 3, 2))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 30), st.integers(1, 4))
def test_ngram_number(n, high):
    got = text.features_of("x" * n, high, 0, drop_first=False)
    assert len(got) == sum(max(0, n - o + 1) for o in range(1, high + 1))


@pytest.mark.parametrize(
    ("f", "given_", "want"),
    [
        (text.clean_space, "  a \n\t b　c ", "a b c"),
        (text.normalize_urls, "see http://x.y", "see +URL++URL+"),
        (text.normalize_currency, "pay $1,200.50 now", "pay +CURRENCY+ now"),
        (text.normalize_date, "on 1/2/2003.", "on +DATE+."),
        (text.normalize_time, "at 10:20:30", "at +TIME+"),
        (text.normalize_numbers, "the 21st of 1,000", "the +NUMBER+ of +NUMBER+"),
        (text.normalize_abbreviations, "U. S. A.", "U.S. A."),
        (text.normalize_punctuation, "a…b–c«d»[e]", 'a...b-c"d"(e)'),
        (text.decontract, "it's we'll don't", "it is we will do not"),
        (text.strip_trailing_quote, 'a"b"', 'a"b'),
        (lambda c: F.array_join(text.ideograph_tokens(c, False), "|"), "ab1 漢字", "ab1|漢|字"),
        (lambda c: F.array_join(text.word_tokens(c), "|"), " a  b ", "a|b"),
    ],
)
def test_functions(spark, f, given_, want):
    assert one(spark, f, given_) == want
    assert one(spark, f, None) is None


def test_tokenizers():
    assert tokenizers.english('He said "Mr. Smith isn\'t here."') == ["He", "said", '"', "Mr.", "Smith", "isn't", "here", ".", '"']
    assert tokenizers.english("wait.... 'bout 1 000 ＡＢ") == ["wait", "...", "about", "1000", "AB"]
    assert tokenizers.english('("x')[-1] == "x"
    assert tokenizers.french("l'homme qu'il a-t-il") == ["le", "homme", "que", "il", "a", "il"]
    assert tokenizers.korean("안녕ㅋㅋ abc123한국") == ["안녕", "abc123", "한국"]


def test_column_tokenizers(spark):
    assert one(spark, tokenizers.turkish, "Ali'nin ev-i") == ["Ali", "'", "nin", "ev", "i"]
    assert one(spark, tokenizers.arabic, "بالبيت كتابه") == ["ب ال بيت", "ك تاب هpost"]
    assert one(spark, tokenizers.TOKENIZERS["en"], None) is None


def test_markup():
    assert markup.textile("* Head\ntext") == "h1. Head\n\ntext"
    assert markup.textile("- a\n- b\nend") == "* a\n* b\n\nend"
    assert markup.textile("1. a") == "# a"
    assert markup.textile("#+BEGIN_SRC\n* kept\n#+END_SRC") == "<pre><code>\n* kept\n</code></pre>"
    assert markup.textile("$ ls\nout") == "<pre>\n$ ls\n</pre>\nout"
    assert markup.textile("|-+-|\n| a | b |") == "| a | b |"
    assert markup.textile(None) is None
