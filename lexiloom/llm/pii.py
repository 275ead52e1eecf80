"""PII surrogates: keyed replacements that keep type, format, script and gender, and stay distinct.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment cards, social security numbers, and person
names after a courtesy title (Mr, Ms, Herr, Frau, M., Mme, Sr., Sra. ...; Latin or Cyrillic). Further mentions of such a person in the same
text, by the whole name or the family name alone, are found too.

A surrogate is a function of the key and the entity alone, so the same entity gets the same surrogate in every row of
the corpus (coreference), on every executor, without a shuffle of texts. Where the format leaves a number of fixed
width, the function is a keyed Feistel permutation of that number, so different entities can't collide: telephone
digits, addresses, cards (the check digit is made anew) and social security numbers. A person's surrogate is made of its names' surrogates, so
"Mr. John Smith", "Dr. John Smith", "John Smith" and "Smith" agree. A given name's ending shows the person's gender: that of a gendered title, in this text
or, after a title without gender, most often in the corpus, else that of the name itself. Surrogates of e-mail addresses, given and family names are hashes,
which can collide: `collisions` counts them over the whole corpus, and `settle` assigns attempt numbers to the few names that would share a
surrogate with another. There are 10 ** 18 tags, 2 * 10 ** 10 family and 2 * 10 ** 8 given names to be drawn, so `most_exceptions` isn't reached below 6 * 10 ** 7
family names or 6 * 10 ** 6 given ones; beyond, settle refuses.

The key is a secret of the caller's: who has it can link entities with surrogates. `session_key` reads it from the session, or draws one for it.

Nulls: a null text stays null with no entities. Repeated ids stay rows of their own. All other columns are handed on as they are,
but for those named as the two outputs (`n_entities`, `entity_kinds`), which are replaced.
"""

from __future__ import annotations

import hmac
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

TITLES = {"Mr": "m", "Mr.": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "M.": "m", "Señor": "m", "Sr.": "m", "Don": "m", "господин": "m", "Господин": "m", "Mrs": "f", "Mrs.": "f", "Ms": "f", "Ms.": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra.": "f", "Doña": "f", "госпожа": "f", "Госпожа": "f", "Dr.": "n", "Prof.": "n"}
LATIN, CYRILLIC = "A-ZÀ-ÖØ-Þ", "А-ЯЁ"
NAME = f"(?:[{LATIN}][a-zß-öø-ÿ'’-]{{1,30}}|[{CYRILLIC}][а-яё-]{{1,30}})"
#: Session setting of the key; its name keeps it out of logs and pages that redact secrets.
SECRET = "spark.lexiloom.surrogates.secret"
#: Common given names of either gender; others are told by their endings where no title tells.
GIVEN = {
    "m": set("Adam Alan Albert Alexander Andreas Andrew Anthony Antonio Bruno Carl Carlos Charles Christian Daniel David Edgar Edward Emil Eric Felix Frank Georg George Hans Harry Henry Hugo Ivan Jack Jacques James Jean Jonas John Jose José Joseph Juan Karl Kevin Klaus Kurt Leo Louis Luis Luke Manuel Mark Martin Max Michael Miguel Nils Noah Oliver Oscar Otto Patrick Paul Pedro Peter Philip Pierre Quentin Ralph Richard Robert Samuel Simon Stefan Steven Thomas Tom Ulrich Victor Walter William Wolfgang Никита Илья Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей Тимур".split()),
    "f": set("Alice Ann Anne Astrid Beth Carmen Caroline Catherine Charlotte Chloe Claire Dolores Elisabeth Elizabeth Ellen Emily Esther Eve Grace Heike Helen Ingrid Irene Isabel Jane Jennifer Joan Judith Karen Karin Kate Kim Margaret Marie Mary Michelle Mercedes Nicole Pilar Rachel Renate Rosalind Ruth Sarah Sibylle Silke Sophie Susan Ute Yvonne Любовь".split()),
}
ONSETS = {"latin": "B C D F G H L M N P R S T V W Br Cl Dr Gr Kr Pr St Tr".split(), "cyrillic": "Б В Г Д З К Л М Н П Р С Т Ф Х Бр Гр Др Кр Пр Ст Тр".split()}
MIDDLES = {"latin": "ad al an ar el en er il in ol on or un".split(), "cyrillic": "ад ал ан ар ел ен ер ил ин ол он ор ун".split()}
AFTER = {"latin": "dlmnrstv", "cyrillic": "длмнрств"}
#: Endings by (script, gender): those of one place belong together.
MAILBOXES = "adam alice bruno clara daniel elena felix greta hugo irene jonas julia karl laura martin nora oscar paula robert sara simon tina victor wanda".split()
FAMILY_ENDS = {("latin", "m"): "berg dorf er feld man ner ton ville well wood".split(), ("cyrillic", "m"): "ов ев ин ский".split(), ("cyrillic", "f"): "ова ева ина ская".split()}
FAMILY_ENDS["latin", "f"] = FAMILY_ENDS["latin", "m"]
GIVEN_ENDS = {("latin", "m"): "o us ard en".split(), ("latin", "f"): "a ia elle ine".split(), ("cyrillic", "m"): "ий ан ор ей".split(), ("cyrillic", "f"): "ия ана ора ея".split()}

#: Longer matches first where they start at one place. Every quantifier is bounded or anchored, so no text takes quadratic time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "card": r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]?\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "person": r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + rf")[  ]{NAME}(?: {NAME}){{0,2}}(?!\w)",
}
DETECT = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
TITLES_BY_LENGTH = sorted(TITLES, key=len, reverse=True)
#: Without one of these a text has no entity; the search is in C and most texts end here.
HINT = re.compile(r"[0-9@]|(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + ")[  ]")


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return -total % 10


NAMES = re.compile(rf"(?<!\w){NAME}(?!\w)")
OWNER = re.compile("['’]s$")


def script_of(name: str) -> str:
    return "cyrillic" if re.match(f"[{CYRILLIC}]", name) else "latin"


def named(value: str) -> tuple[str, str, list[str]]:
    """Title, the gap behind it, and the names of a titled mention."""
    title = next((t for t in TITLES_BY_LENGTH if value.startswith((t + " ", t + "\u00a0"))), "")
    return title, value[len(title) : len(title) + 1] if title else "", value[len(title) + bool(title) :].split(" ")


def guessed(name: str) -> str:
    """Gender of a given name by itself."""
    for gender, names in GIVEN.items():
        if name in names:
            return gender
    return "f" if name[-1:] in "aаяeé" else "m"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, leftmost first, without overlaps."""
    if not HINT.search(text):
        return []
    out, families, given = [], set(), set()
    for m in DETECT.finditer(text):
        end = m.end()
        if m.lastgroup == "person":
            end -= 2 * bool(OWNER.search(m[0]))
            *first, last = named(text[m.start() : end])[2]
            families.add(last)
            given.update(first)
        out.append((m.start(), end, m.lastgroup))
    return mentions(text, out, families, given) if families else out


def mentions(text: str, found: list[tuple[int, int, str]], families: set[str], given: set[str]) -> list[tuple[int, int, str]]:
    """found, and what else in the text is one of the family names, with the given names before it."""
    out, k, start, end = [], 0, -1, -1  # start and end of the given names just before
    for m in NAMES.finditer(text):
        name = OWNER.sub("", m[0])
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        follows = start >= 0 and text[end : m.start()] == " "
        if k < len(found) and found[k][0] < m.end():
            start = -1
        elif name in families:
            out.append((start if follows else m.start(), m.start() + len(name), "person"))
            start = -1
        elif m[0] in given:
            start, end = start if follows else m.start(), m.end()
        else:
            start = -1
    return sorted([*found, *out])


class Surrogates:
    """Surrogates under one key. exceptions: (kind, normal form) -> attempt, for entities that would collide, and
    ("gender", name) -> 0 for male, 1 for female, for given names whose gender the corpus tells."""

    def __init__(self, key: bytes, exceptions: dict[tuple[str, str], int] | None = None, bits: int = 60):
        self.key, self.exceptions, self.bits = key, exceptions or {}, bits
        self.remembered = lru_cache(maxsize=100_000)(self.make)

    def number(self, kind: str, value: str, attempt: int = 0) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{kind}\0{attempt}\0{value}".encode(), "sha256")[:16], "big")

    def permute(self, kind: str, value: int, size: int) -> int:
        """A keyed permutation of range(size): a Feistel network on the next power of four, walked until it is in range."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(6):
                left, right = right, left ^ (self.number(f"{kind}{r}", str(right)) & mask)
            value = left << half | right
            if value < size:
                return value

    def digits(self, kind: str, value: str) -> str:
        """Other digits of the same number, by a permutation, so different values stay different."""
        return str(self.permute(f"{kind}/{len(value)}", int(value), 10 ** len(value))).zfill(len(value))

    def normal(self, kind: str, value: str) -> str:
        """What two mentions of one entity have in common."""
        if kind == "email":
            return value.lower()
        return re.sub(r"\D", "", value) if kind in ("phone", "card", "ssn") else value

    def make(self, kind: str, value: str, gender: str = "") -> str:
        """gender: of a person whose mention doesn't tell it, where the text does elsewhere."""
        if kind == "person":
            return self.person(value, gender)
        plain = self.normal(kind, value)
        return getattr(self, kind)(value, plain, self.exceptions.get((kind, plain), 0))

    def email(self, value: str, plain: str, attempt: int) -> str:
        n = self.number("email", plain, attempt)
        local, _, domain = plain.partition("@")
        tag = n >> 8 & (1 << self.bits) - 1
        word = MAILBOXES[(n >> 1 & 0x7F) % len(MAILBOXES)]
        letters = "".join("abcdefghijklmnopqrstuvwxyz234567"[tag >> 5 * k & 31] for k in range(12))
        dot = "." if "." in local else ""
        made = f"{word}{dot}{letters}@example.{'org' if domain.endswith('.org') else 'net' if domain.endswith('.net') else 'com'}"
        return made.upper() if value.isupper() else made

    def refill(self, value: str, digits: str) -> str:
        rest = iter(digits)
        return re.sub(r"\d", lambda _: next(rest), value)

    def phone(self, value: str, plain: str, attempt: int) -> str:
        code = re.match(r"\+(\d{1,3})", value)
        lead = code[1] if code else ""
        return self.refill(value, lead + self.digits("phone" + lead, plain[len(lead) :]))

    def card(self, value: str, plain: str, attempt: int) -> str:
        # The issuer's first digit stays, and so does whether the check digit is right.
        made = plain[0] + self.digits("card" + plain[0], plain[1:-1])
        off = (int(plain[-1]) - luhn(plain[:-1])) % 10
        return self.refill(value, made + str((luhn(made) + off) % 10))

    def ssn(self, value: str, plain: str, attempt: int) -> str:
        return self.refill(value, self.digits("ssn", plain))

    def ip(self, value: str, plain: str, attempt: int) -> str:
        # Private and loopback networks stay what they are; the host part is permuted.
        parts = [int(x) for x in plain.split(".")]
        keep = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] else 0
        width = 8 * (4 - keep)
        n = self.permute(f"ip{keep}{parts[0] if keep else ''}", int.from_bytes(bytes(parts[keep:]), "big"), 1 << width)
        return ".".join(map(str, [*parts[:keep], *n.to_bytes(4 - keep, "big")]))

    def stem(self, kind: str, name: str) -> tuple[str, int]:
        """The beginning of a name's surrogate, and the number that its ending is taken from."""
        script = script_of(name)
        n = self.number(kind, name, self.exceptions.get((kind, name), 0))
        out, n = ONSETS[script][n % len(ONSETS[script])], n // len(ONSETS[script])
        for k in range(4 if kind == "family" else 3):
            out += MIDDLES[script][n % 13]
            if kind == "family" or k < 2:
                out += AFTER[script][n // 13 % 8]
            n //= 104
        return out, n

    def family(self, name: str) -> str:
        # Cyrillic family names show gender themselves; whatever title stands before them, one name has one surrogate.
        out, n = self.stem("family", name)
        ends = FAMILY_ENDS[script_of(name), "f" if name[-1] in "ая" else "m"]
        return out + ends[n % len(ends)]

    def given(self, name: str, gender: str) -> str:
        if not gender:
            known = self.exceptions.get(("gender", name))
            gender = guessed(name) if known is None else "mf"[known]
        out, n = self.stem("given", name)
        ends = GIVEN_ENDS[script_of(name), gender]
        return out + ends[n % len(ends)]

    def person(self, value: str, gender: str = "") -> str:
        title, gap, names = named(value)
        gender = TITLES.get(title, "n").replace("n", "") or gender
        return title + gap + " ".join([*(self.given(g, gender) for g in names[:-1]), self.family(names[-1])])

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with surrogates, and the kinds of its entities in order."""
        spans = find(text)
        if not spans:
            return text, []
        genders: dict[str, str] = {}
        for a, b, kind in spans:
            if kind == "person":
                title, _, names = named(text[a:b])
                if len(names) > 1 and TITLES.get(title, "n") != "n":
                    genders.setdefault(" ".join(names), TITLES[title])
        out, at = [], 0
        for a, b, kind in spans:
            value = text[a:b]
            gender = genders.get(" ".join(named(value)[2]), "") if kind == "person" and genders else ""
            out += [text[at:a], self.remembered(kind, value, gender)]
            at = b
        return "".join([*out, text[at:]]), [kind for _, _, kind in spans]


def session_key(spark: SparkSession) -> bytes:
    """The session's secret; where none is set, one is drawn and kept for the session, so that all its jobs agree."""
    have = spark.conf.get(SECRET, None)
    if not have:
        have = secrets.token_hex(32)
        spark.conf.set(SECRET, have)
    return have.encode()


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """kind, plain, m, f, n: the distinct e-mail addresses, family names and given names, whose surrogates come from hashes, and for given names how
    often titles of either gender, or of none, precede them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text in batch.column(0).to_pylist():
                for a, b, kind in find(text or ""):
                    if kind == "email":
                        seen.setdefault((kind, text[a:b].lower()), [0, 0, 0])
                    elif kind == "person":
                        title, _, (*given, last) = named(text[a:b])
                        seen.setdefault(("family", last), [0, 0, 0])
                        for g in given:
                            seen.setdefault(("given", g), [0, 0, 0])["mfn".index(TITLES.get(title, "n"))] += 1
            rows = [(*k, *n) for k, n in seen.items()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)], ["kind", "plain", "m", "f", "n"])

    some = docs.select(text_col).where(F.col(text_col).rlike(r"@|[A-Za-zа-яА-Яñ]\.?[ \u00a0]\p{Lu}"))
    found = some.mapInArrow(run, "kind string, plain string, m bigint, f bigint, n bigint")
    return found.groupBy("kind", "plain").agg(*[F.sum(c).alias(c) for c in "mfn"])


def collisions(found: DataFrame, key: bytes, exceptions: dict[tuple[str, str], int], bits: int = 60) -> DataFrame:
    """kind, plain of the entities whose surrogate a lesser entity has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key, exceptions, bits)
        for batch in batches:
            kinds, plains = batch.column("kind").to_pylist(), batch.column("plain").to_pylist()
            made = [maker.make(k, p) if k == "email" else maker.stem(k, p)[0] for k, p in zip(kinds, plains)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("plain"), pa.array(made, pa.string())], ["kind", "plain", "made"])

    made = found.select("kind", "plain").mapInArrow(run, "kind string, plain string, made string")
    shared = made.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("plain").alias("first")).where("n > 1")
    return made.join(shared, ["kind", "made"]).where("plain > first").select("kind", "plain")


def settle(docs: DataFrame, key: bytes, text_col: str = "text", most_exceptions: int = 1_000_000, rounds: int = 8, bits: int = 60) -> dict[tuple[str, str], int]:
    """Attempt numbers of the entities that would collide, so that all surrogates of the corpus are distinct, and the genders that titles show."""
    found = cut(entities(docs, text_col))
    shown = found.where("kind = 'given' AND n > 0 AND m != f").select("plain", (F.col("f") > F.col("m")).cast("int").alias("g"))

    def bounded(rows: DataFrame) -> list:
        got = rows.limit(most_exceptions + 1).collect()
        if len(got) > most_exceptions:
            raise ValueError("more exceptions than a broadcast may hold")
        return got

    exceptions: dict[tuple[str, str], int] = {("gender", r.plain): r.g for r in bounded(shown)}
    for attempt in range(1, rounds + 1):
        rows = bounded(collisions(found, key, exceptions, bits))
        if not rows:
            return exceptions
        exceptions |= {(r.kind, r.plain): attempt for r in rows}
    raise ValueError("surrogates still collide; take another key")


def replace(docs: DataFrame, key: bytes, text_col: str = "text", exceptions: dict[tuple[str, str], int] | None = None, check: bool = True) -> DataFrame:
    """docs with surrogates in the text, and n_entities and entity_kinds (kinds in order, comma-joined) added."""
    spark = docs.sparkSession
    if exceptions is None:
        exceptions = settle(docs, key, text_col) if check else {}
    shared = spark.sparkContext.broadcast(exceptions)
    small_batches(spark)
    docs = docs.drop("n_entities", "entity_kinds")
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key, shared.value)
        for batch in batches:
            done = [(None, []) if text is None else maker.replace(text) for text in batch.column(place).to_pylist()]
            columns = batch.columns
            columns[place] = pa.array([t for t, _ in done], pa.string())
            counts, kinds = pa.array([len(k) for _, k in done], pa.int64()), pa.array([",".join(k) for _, k in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, counts, kinds], [*batch.schema.names, "n_entities", "entity_kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, schema + ", n_entities bigint, entity_kinds string")
