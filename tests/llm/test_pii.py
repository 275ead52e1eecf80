import re

from lexiloom.llm import pii

KEY = b"k"


def made(text, key=KEY):
    return pii.Surrogates(key).replace(text)[0]


def test_formats_stay():
    text = "Call +1 (743) 555-3824 or mail Jo.Doe@mail5.example.com, ip 10.2.3.4, card 4785-3805-9239-1139."
    got = made(text)
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or mail \w+\.\w+@example\.com, ip 10\.\d+\.\d+\.\d+, card 4\d{3}-\d{4}-\d{4}-\d{4}\.", got)
    assert got != text and made(text) == got and made(text, b"other") != got


def test_gender_and_script():
    assert re.fullmatch(r"Mrs\. \w+ \w+", made("Mrs. Anna Smith"))
    got = made("госпожа Анна Петрова")
    assert re.fullmatch(r"госпожа [А-Я][а-я]+ [А-Я][а-я]+", got) and got.split()[1].endswith(tuple(pii.GIVEN_ENDS["cyrillic", "f"]))
    one, two = made("Mr. John Smith and Mr. Smith").split(" and ")
    assert one.split()[-1] == two.split()[-1]


def test_numbers_are_permuted():
    s = pii.Surrogates(KEY)
    assert sorted(s.permute("x", v, 1000) for v in range(1000)) == list(range(1000))
    ips = {s.make("ip", f"9.9.{a}.{b}") for a in range(16) for b in range(64)}
    assert len(ips) == 1024


def test_card_check_digit():
    s = pii.Surrogates(KEY)
    good = "411111111111111" + str(pii.luhn("411111111111111"))
    out = s.make("card", good)
    assert out[0] == "4" and int(out[-1]) == pii.luhn(out[:-1])


def test_corpus(spark):
    rows = [(1, "write a@b.org or A@B.org", "x"), (2, None, None), (3, "", "y"), (4, "clean words only", "z"), (4, "c@d.com " * 3000, "z"), (5, "x" * 200_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entity_kinds string")
    got = pii.replace(docs, KEY).collect()
    by = {(r.doc_id, r.n_entities): r.text for r in got}
    assert len(got) == 6 and by[4, 0] == "clean words only" and by[2, 0] is None and by[5, 0] == "x" * 200_000
    assert len(set(re.findall(r"\S+@\S+", by[1, 2].lower()))) == 1 and "b.org" not in by[1, 2]
    assert pii.replace(docs.limit(0), KEY).count() == 0


def test_collisions_get_another_attempt(spark):
    found = [f"u{k}@b.org" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(found))], "doc_id long, text string")
    exceptions = pii.settle(docs, KEY, bits=4)
    assert exceptions
    maker = pii.Surrogates(KEY, exceptions, bits=4)
    assert len({maker.make("email", e) for e in found}) == 40


def test_one_person_has_one_surrogate():
    text = "Mr. John Smith met Dr. John Smith. John Smith said so; Smith left with Smith's coat, and Mr. Smith too. Smithers stayed."
    got = made(text)
    full = re.match(r"Mr\. (\w+ \w+) met", got)[1]
    first, last = full.split()
    assert got == f"Mr. {full} met Dr. {full}. {full} said so; {last} left with {last}'s coat, and Mr. {last} too. Smithers stayed."
    assert made("Prof. John Smith").split()[1:] == [first, last] and "Smith" not in last
    # A title without gender takes that of the same person's other title.
    one, two = made("Mrs. Rowan Hill and Dr. Rowan Hill").split(" and ")
    assert one.split()[1:] == two.split()[1:] and one.split()[1].endswith(tuple(pii.GIVEN_ENDS["latin", "f"]))


def test_the_corpus_tells_gender_and_collisions_keep_coreference(spark, monkeypatch):
    people = [f"{g} {f}" for g in ("Rowan", "Ellis") for f in ("Abbot", "Birch", "Cole", "Dale", "Eames", "Frost", "Gray", "Hart", "Ives", "Jay")]
    rows = [(k, f"Mrs. {p} spoke. {p.split()[1]} left.") for k, p in enumerate(people)] + [(100 + k, f"Dr. {p}") for k, p in enumerate(people)] + [(200 + k, f"Mr. {p.split()[1]}") for k, p in enumerate(people)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setitem(pii.ONSETS, "latin", ["B"])  # few surrogates, so that some collide
    monkeypatch.setitem(pii.MIDDLES, "latin", ["an"] * 13)
    monkeypatch.setitem(pii.AFTER, "latin", "ddddddll")
    exceptions = {("gender", "Rowan"): 1, ("gender", "Ellis"): 1}
    maker = pii.Surrogates(KEY, exceptions)
    stems = {}
    for name in {p.split()[1] for p in people}:
        attempt = 0
        while maker.stem("family", name)[0] in stems.values() and attempt < 50:
            attempt += 1
            exceptions["family", name] = attempt
        stems[name] = maker.stem("family", name)[0]
    assert any(k[0] == "family" for k in exceptions)
    out = {d: maker.replace(t)[0] for d, t in rows}
    for k, p in enumerate(people):
        full, last = re.match(r"Mrs\. (\w+ (\w+)) spoke\. (\w+) left\.", out[k]).group(1, 2)
        assert out[k].endswith(f"{last} left.") and out[100 + k] == f"Dr. {full}" and out[200 + k] == f"Mr. {last}"
    monkeypatch.undo()
    got = {r.doc_id: r.text for r in pii.replace(docs, KEY).collect()}
    families = set()
    for k, p in enumerate(people):
        full = got[100 + k][4:]
        assert got[k] == f"Mrs. {full} spoke. {full.split()[1]} left." and got[200 + k] == f"Mr. {full.split()[1]}"
        families.add(full.split()[1])
    assert len(families) == 10 and len({g[4:].split()[0] for d, g in got.items() if 100 <= d < 200}) == 2


def test_against_a_plain_reading(spark):
    """Entities by independent expressions: what isn't one stays byte for byte, and one value has one surrogate, and no other has it."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in pii.replace(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), KEY).collect()}
    mail = re.compile(r"[\w.%+-]+@[\w.-]+\.[a-z]{2,}")
    to = {}
    for d, text in docs.items():
        if "@" not in text and not re.search(r"\d", text):
            assert got[d] == text
        a, b = mail.findall(text), mail.findall(got[d])
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert to.setdefault(x.lower(), y.lower()) == y.lower() and x.lower() != y.lower()
    assert to and len(set(to.values())) == len(to)


def test_the_key_belongs_to_the_session(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) >= 32
