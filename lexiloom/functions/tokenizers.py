"""Tokenizers for English, French, Korean, Turkish and Arabic.

Turkish and Arabic are Column functions. The others peel punctuation off word ends until the rest is a known abbreviation, a loop, so
they run as Arrow UDFs. Nulls stay null.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import lru_cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import by_text, let, trim_low

INITIALS = {f"{c}." for c in string.ascii_lowercase}
ENGLISH_KEPT = INITIALS | set("'bout 'em 's -- ... .... a.d. a.m. b.c. d.c. dr. e.g. e.t. e.u. etc. i.d. i.e. m.a. m.s. mme. mr. mrs. ms. p.m. p.s. t.b. u.s.".split())
ENGLISH_SAID = {"'bout": "about", "'em": "them"}
ELISIONS = {"j'": "je", "n'": "ne", "d'": "de", "s'": "se", "c'": "ce", "m'": "me", "qu'": "que", "l'": "le"}
FRENCH_KEPT = INITIALS | set(ELISIONS) | set("m. mme. dr. d.c. ... .... --".split())

ENDS = regex.compile(r"(?P<lead>\p{P}?)(?P<mid>.+?)(?P<tail>\p{P}?)", regex.DOTALL)
SPACE = regex.compile(r"(?:\s|\p{Zs})+")
DIGIT_GAP = regex.compile(r"(?<=\d)\s+(?=\d)")
WIDE = {code: code - 0xFF01 + 0x21 for code in range(0xFF01, 0xFF5F)}
QUOTES = {ord(c): "'" for c in "‘’`′"} | {ord(c): '"' for c in "“”『』"} | {ord(c): "-" for c in "‑–—"}
SIGNS = {ord("™"): " (tm) ", ord("©"): " (c) "}


def peel(word: str, kept: set[str]) -> str:
    """Splits one punctuation mark after another off both ends, until the rest is kept whole or has none.

    Marks taken from the front come out in reverse order, each before the last one.
    """
    front: list[str] = []
    back: list[str] = []
    done = word.lower() in kept
    while not done and (m := ENDS.fullmatch(word)) and m[1] + m[3]:
        lead, mid, tail = m.groups()
        if (lead + mid).lower() in kept:
            word, lead, done = lead + mid, "", True
        elif (mid + tail).lower() in kept:
            word, tail, done = mid + tail, "", True
        else:
            word, done = mid, mid.lower() in kept
        front[:0] = [lead] if lead else []
        back[:0] = [tail] if tail else []
    return " ".join([*front, word, *back])


def peeler(kept: set[str]) -> Callable[[str], str]:
    """peel() with one set, which remembers short words: texts repeat them, and peeling costs most of a tokenizer's time."""
    short = lru_cache(1 << 15)(lambda word: peel(word, kept))
    return lambda word: short(word) if len(word) <= 32 else peel(word, kept)


peel_english, peel_french = peeler(ENGLISH_KEPT), peeler(FRENCH_KEPT)


def unified(text: str) -> str:
    """Quotes, dashes and dots in one form; control characters dropped."""
    text = regex.sub(r"…|\.\.+", " ... ", text.translate(QUOTES | SIGNS))
    return regex.sub(r"\p{C}", "", text)


def dots(text: str) -> str:
    return regex.sub(r"\.(?:\s+\.)+", "...", text)


def words_of(text: str) -> list[str]:
    return [w for w in SPACE.split(text.strip()) if w]


def english(text: str) -> list[str]:
    text = regex.sub(r"\s+", " ", regex.sub(r"\\\s*", r"\\", text.replace("|", " "))).strip().translate(WIDE)
    text = unified(DIGIT_GAP.sub("", text))
    joined = dots(" ".join(peel_english(w) for w in words_of(regex.sub(r"-+", " ", text))))
    said = " ".join(ENGLISH_SAID.get(w, w) for w in joined.split())
    return regex.sub(r"' s\b", "'s", said).split()


def french(text: str) -> list[str]:
    out = []
    for w in dots(" ".join(peel_french(w) for w in words_of(unified(text)))).split():
        if "'" in w and (m := regex.fullmatch(r"([cdjlmns]|qu)'(.*)", w, regex.IGNORECASE)):
            w = f"{m[1]}e {m[2]}"
        if "-t-" in w.lower() and (m := regex.fullmatch(r"(.*)-t-(.*)", w, regex.IGNORECASE)):
            w = f"{m[1]} {m[2]}"
        out.append(w)
    return regex.sub(r"-+", " ", " ".join(out)).split()


#: Letters that stand for laughing or crying, and notes.
KOREAN_BLANKS = {ord(c): " " for c in "ㅅㅆㅠㅋ♪♫"} | {ord("ㅡ"): "-"}
NUMBERED = regex.compile(r"(?P<lead>\S*?)(?P<number>\p{P}*[-_0-9A-Z]+\p{P}*)(?P<tail>\S*?)", regex.IGNORECASE)
PUNCTUATED = regex.compile(r"(?P<lead>.+?)(?P<marks>\p{P}+)(?P<tail>.?+)", regex.IGNORECASE)


def korean(text: str) -> list[str]:
    out = []
    for w in words_of(unified(text.translate(KOREAN_BLANKS))):
        m = NUMBERED.fullmatch(w) or PUNCTUATED.fullmatch(w)
        out += [peel_french(part) for part in (m.groups() if m else (w,)) if part]
    return regex.sub(r"-+", " ", dots(" ".join(out))).split()


def turkish(text: Column) -> Column:
    """Hyphens are blanks, apostrophes words of their own."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "-", " "), "'", " ' "), "\\s+")


def arabic(text: Column) -> Column:
    """Normalised words, with attached particles in front and pronouns behind set off by blanks inside the word."""
    for pattern, to in (
        ("[ـً-ْ()]", ""),
        ("/", " "),
        ("[‐‑]", "-"),
        ("[‒-―]", " - "),
        ("[,:]", "،"),
        ("[أإ]", "ا"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.transform(F.split(trim_low(text), "\\s+"), arabic_word)


#: What may precede a word, longest first for each letter, and how it is set off.
PREFIXES = [("بال", "ب ال "), ("ب", "ب "), ("فال", "ف ال "), ("ف", "ف "), ("كال", "ك ال "), ("ك", "ك "), ("لل", "ل ال "), ("ل", "ل ")]
#: Pronouns at the end of a word, in the order they are tried, and what they become.
SUFFIXES = [("ني", None), ("ي", None), ("ك", None), ("ه", None), ("ها", None), ("كما", None), ("هما", None), ("نا", None), ("كم", "ك"), ("كن", "ك"), ("هم", None), ("هن", "هم")]


def first_match(word: Column, cases: list[tuple[str, str, str]]) -> Column:
    """The first (test, pattern, replacement) whose test the word passes."""

    def of(w: Column) -> Column:
        out = None
        for test, pattern, to in cases:
            made = F.regexp_replace(w, pattern, to)
            out = F.when(w.rlike(test), made) if out is None else out.when(w.rlike(test), made)
        return out.otherwise(w)

    return let(word, of)


def arabic_word(word: Column) -> Column:
    word = F.regexp_replace(word, "^[آأإا]", "ا")
    word = F.regexp_replace(word, "[ً-ٍ]$", "")
    # The particles' own letters aren't \p{Alpha} here, so only the particle is replaced, once each.
    for particle, to in (("وال", "و ال "), ("و", "و "), ("ال", "ال ")):
        word = F.regexp_replace(word, f"^(.*?)\\b{particle}[A-Za-z]*", "$1" + to)
    word = first_match(word, [(f"\\b{p}.+", f"^(.*?)\\b{p}", "$1" + to) for p, to in PREFIXES])
    return first_match(word, [(f".+{s}\\b", f"^(.*?){s}\\b", f"$1 {to or s}post") for s, to in SUFFIXES])


def tokenizer(of_text: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """An Arrow UDF of a text function."""
    return by_text(lambda t: None if t is None else of_text(t), ArrayType(StringType()))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"en": lambda c: tokenizer(english)(c), "fr": lambda c: tokenizer(french)(c), "ko": lambda c: tokenizer(korean)(c), "tr": turkish, "ar": arabic}
