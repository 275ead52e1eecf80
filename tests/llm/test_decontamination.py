import random

from lexiloom.llm import decontamination as dc


def fixture():
    rng = random.Random(5)
    syllables = ["ta", "ro", "mi", "ke", "lu", "sha", "ven", "dor", "is", "ul"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 4)))
    stop = ["the", "of", "and", "in", "to"]
    sentence = lambda n: [rng.choice(stop) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [(i, " ".join(sentence(rng.randint(10, 30))) + ". " + " ".join(sentence(6)) + ".") for i in range(40)]
    docs, planted = [], set()
    for d in range(300):
        words = sentence(rng.randint(0, 160))
        if d % 3 == 0:
            i = rng.randrange(40)
            planted.add((d, i))
            copy = items[i][1].split()
            copy = [w if rng.random() > 0.12 * (d % 4) else word() for w in copy if rng.random() > 0.04 * (d % 4)]
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if d % 2 else w for w in copy]
        docs.append((d, " ".join(words)))
    return docs, items, planted


def brute(docs, items, verbatim=0.8, paraphrase=0.55, answer=0.6):
    """Every item against every stretch of every document."""
    out = set()
    for d, text in docs:
        words = dc.words_of(dc.prepared(text))
        for i, item in items:
            want, said = dc.words_of(dc.prepared(item)), dc.words_of(dc.prepared(item).split(b". ")[1])
            for at in range(0, max(1, len(words)), dc.BLOCK):
                around = words[max(0, at - len(want)) : at + 2 * dc.BLOCK + len(want)]
                content = [w for w in want if w not in (b"the", b"of", b"and", b"in", b"to")]
                share = min(dc.lcs(want, around) / len(want), dc.lcs(content, around) / len(content))
                if share >= verbatim or share >= paraphrase and dc.lcs(said, around) / len(said) >= answer:
                    out.add((d, i))
    return out


def test_recall_against_brute_force(spark):
    docs, items, planted = fixture()
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    found, want = {(r.doc_id, r.item_id) for r in got}, brute(docs, items)
    # The fixture's few syllables make some words of short items common; a paraphrase of those is found by chance.
    assert len(found - planted) <= 0.05 * len(found) and want <= planted
    assert len(found & want) >= 0.9 * len(want) > 60


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = rng.choices("abc", k=rng.randint(0, 12)), rng.choices("abc", k=rng.randint(0, 12))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        assert dc.lcs(a, b) == row[-1]


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda"
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (5, "x " * 50_000 + item + " y" * 50_000), (6, "nothing here")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item)], "item_id long, text string")
    # An item without id is searched too; a row without id goes like any other, and a clean row that shares its id with another stays.
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in dc.matches(frame, bench).collect()) == sorted((d, i) for d in (0, 3, 3, 5) for i in (0, 1))
    more = frame.union(spark.createDataFrame([(3, "clean words under a shared id", 1), (None, "clean words without id", 1)], frame.schema))
    assert sorted((r.doc_id or 0, r.item_id) for r in dc.clean(more, bench).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (6, 1)] and dc.clean(more, bench).columns == more.columns
    assert dc.clean(frame, bench.limit(0)).count() == len(docs)
    assert dc.matches(frame.limit(0), bench).count() == 0 and dc.matches(frame, bench.limit(0)).count() == 0


def test_many_blocks_give_what_one_gives(spark, monkeypatch):
    docs, items, _ = fixture()
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    # Which common words count as content depends on the block, so near the thresholds blocks may differ; whole items don't.
    whole = {(r.doc_id, r.item_id) for r in dc.matches(frame, bench).where("lcs >= 0.95").collect()}
    monkeypatch.setattr(dc, "MOST_ITEMS", max(2, len(items) // 5))
    monkeypatch.setattr(dc, "AT_ONCE", 2)
    parts = {(r.doc_id, r.item_id) for r in dc.matches(frame, bench).where("lcs >= 0.95").collect()}
    assert whole and whole == parts
    assert {r.doc_id for r in dc.clean(frame, bench).collect()}.isdisjoint({d for d, _ in parts})
