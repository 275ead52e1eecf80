"""Contracts of the queries over a small copy of the tables."""

import hashlib
import re
from zlib import crc32

import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lexiloom.llm import decontamination, mixing, pii, queries, rules, simhash, tokens, toxicity
from lexiloom.llm.common import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 11)) and "pipeline" in names


def test_tokens(spark, docs):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op4_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_token_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "a<|endoftext|>b <|endoftext|>", "é漢😀 " * 3, "x" * 100_000, " \n\t  ''re", "\x85  12 3½"]
    rows = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(rows, path).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False)) for k, t in enumerate(texts)}
    assert tokens.token_counts(rows.limit(0), path).count() == 0


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(low)
    some = [" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in some]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius=6):
    fps = [(d, fingerprint(t)) for d, t in rows]
    near = [[j for j in range(len(fps)) if j != i and (fps[i][1] ^ fps[j][1]).bit_count() <= radius] for i in range(len(fps))]
    root = list(range(len(fps)))
    for i in range(len(fps)):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        root[i] = min(seen, key=lambda j: fps[j][0])
    return sorted((fps[i][0], f"{fps[i][1]:016x}", len(near[i]), fps[root[i]][0]) for i in range(len(fps)))


def test_simhash(spark, docs):
    got = queries.op5_simhash_near_dedup(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == groups(list(docs.items()))


def test_simhash_edges(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "É é"), (6, "a b a b a b"), (6, "a b a b a b"), (7, "w " * 50_000)]
    frame = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, fp string")
    assert sorted(tuple(r) for r in simhash.near_duplicates(frame).collect()) == groups(rows)
    kept = simhash.keep_one(frame).collect()
    assert len({r.doc_id for r in kept}) == len(kept) and simhash.keep_one(frame).columns == frame.columns
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_each_component(spark):
    texts = ["the quick brown fox jumps", "rain falls on seven hills tonight", "market prices rose again in spring", "no id and no copy of this at all"]
    rows = [(5, texts[0]), (5, texts[1]), (3, texts[1].upper()), (None, texts[2]), (None, texts[2]), (None, texts[3]), (7, texts[3]), (8, None), (None, ""), (9, "x y"), (9, "x y"), (None, "alone without id")]
    frame = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(frame).collect()), key=repr)
    assert got == sorted([(5, texts[0]), (3, texts[1].upper()), (None, texts[2]), (7, texts[3]), (8, None), (9, "x y"), (None, "alone without id")], key=repr)


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 1, 10**6, 10**8, 10**12)] == [3, 3, 3, 2, 1]
    assert [simhash.cost(1, 6, b)[0] for b in (3, 2, 1)] == [66, 1058, 43745]


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_ball_hashing_finds_every_pair(spark, blocks):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3 if blocks == 1 else 12)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r.a, r.b) for r in simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), 6, blocks).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}


def test_toxicity(spark, docs):
    got = queries.op10_toxicity(spark, SF).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_toxicity_learns(spark):
    import random

    rng = random.Random(0)
    known = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    word = lambda: rng.choice(known)
    rows, labels = [], []
    for d in range(400):
        words = [word() for _ in range(rng.randint(1, 60))]
        if d % 3 == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["vile", "nasty"]))
        rows.append((d, " ".join(words)))
        labels.append((d, int(d % 3 == 0)))
    rows += [(900, None), (901, ""), (None, "vile"), (902, "x" * 200_000), (903, "calm " * 40_000 + "vile")]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.classify(frame, marks)
    assert got.count() == len(rows)
    tested = got.where("held_out").join(marks, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in tested) >= 0.9 * len(tested)
    assert {r.doc_id: r.predicted for r in got.where("doc_id >= 900").collect()}[903] == 1
    assert {r.score for r in toxicity.classify(frame, marks.limit(0)).collect()} == {0.5}
    assert toxicity.classify(frame.limit(0), marks).count() == 0


def test_mixing_edges(spark):
    rows = [(1, "a b c", "en", "s1"), (2, "d | e", "en", None), (None, "f g", None, "s1"), (4, None, "fr", "s2"), (5, "", "fr", "s2"), (1, "a b c", "en", "s1")]
    frame = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, lang string, source string, p double")
    got = mixing.mix(frame).collect()
    assert len(got) == 6 and all((r.p == 0) == (r.n_tokens == 0) for r in got)
    out = mixing.repeated(frame, rate=100.0)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} == {1, 2, None} and out.first().p == 7.0
    assert mixing.sample(frame).columns == frame.columns
    assert mixing.mix(frame.limit(0)).count() == 0


def test_raking_meets_the_margins(spark):
    rows = [(s, g, t, float(7 * i + 3)) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "xyz" for t in "pq")]
    cell = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    want = {"source": {"a": 3.0, "b": 1.0}, "lang": {"x": 1.0, "y": 1.0, "z": 2.0}, "topic": {"p": 1.0, "q": 1.0}}
    got = mixing.rake(cell, want, rounds=12).collect()
    for m, shares in want.items():
        for value, weight in shares.items():
            assert abs(sum(r.weight for r in got if r[m] == value) - weight / sum(shares.values())) < 1e-6


def test_repeated_rows_meet_the_margins(spark):
    """Cells of very unequal size, so that ratios exceed 1; the margins are those of the sample that comes out."""
    rows, d = [], 0
    for source, lang, n in [("a", "x", 6000), ("a", "y", 300), ("b", "x", 200), ("b", "y", 1500)]:
        for _ in range(n):
            rows.append((d := d + 1, "one two three" if d % 10 else "see | this", lang, source))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {"source": {"a": 1.0, "b": 1.0}, "lang": {"x": 1.0, "y": 1.0}, "topic": {"table": 1.0, "prose": 1.0}}
    odds = mixing.copies(frame, want, rounds=40).collect()
    assert max(r.ratio for r in odds) > 1 and all(abs(r.times - r.ratio) < 1 for r in odds)
    whole, asked = sum(r.n_tokens for r in odds), sum(r.ratio * r.n_tokens for r in odds)
    assert abs(asked - 0.5 * whole) < 1e-6 * whole
    for m, shares in want.items():
        for value in shares:
            assert abs(sum(r.ratio * r.n_tokens for r in odds if r[m] == value) / asked - 0.5) < 1e-3
    times = {r.doc_id: r.times for r in odds}
    got = mixing.repeated(frame, targets=want, rounds=40).collect()
    assert len(got) == sum(times.values()) and {d: sum(r.doc_id == d for r in got) for d in (10, 11, 6500)} == {d: times[d] for d in (10, 11, 6500)}
    by = {}
    for r in got:
        for m, v in (("source", r.source), ("lang", r.lang), ("topic", "table" if "|" in r.text else "prose")):
            by[m, v] = by.get((m, v), 0) + len(r.text.split())
    assert all(abs(by[m, v] / (sum(n for (o, _), n in by.items() if o == m)) - 0.5) < 0.03 for m, v in by)


def test_the_sample_meets_its_targets(spark):
    """Expected and drawn shares of the sample itself, with the tables' default targets, by a plain computation; and no document twice."""
    for sf in ("sf0.001", "sf0.01"):
        rows = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
        whole, asked = sum(r.n_tokens for r in rows), sum(r.p * r.n_tokens for r in rows)
        assert all(0 <= r.p <= 1 for r in rows) and asked > 0.05 * whole
        for m in mixing.MARGINS:
            sums = {}
            for r in rows:
                sums[r[m]] = sums.get(r[m], 0) + r.n_tokens
            norm = sum(v**0.5 for v in sums.values())
            for value, n in sums.items():
                expected = sum(r.p * r.n_tokens for r in rows if r[m] == value) / asked
                assert abs(expected - n**0.5 / norm) < 0.01
    frame = spark.createDataFrame([(d, "a b c" if d % 9 else "x | y", "en", "s1" if d % 50 else "s2") for d in range(5000)], "doc_id long, text string, lang string, source string")
    want = {"source": {"s1": 3.0, "s2": 1.0}, "topic": {"prose": 1.0, "table": 1.0}}
    got = mixing.sample(frame, targets=want).collect()
    assert len({r.doc_id for r in got}) == len(got)
    report = mixing.margins(mixing.calibrated(mixing.cells(mixing.measured(frame)), want)).collect()
    assert {(r.margin, r.value) for r in report} == {("source", "s1"), ("source", "s2"), ("lang", "en"), ("topic", "prose"), ("topic", "table")} and max(abs(r.residual) for r in report) <= 0.002
    # A target that no document can meet takes the rate down to nothing that fits; weights stay within the cells.
    none = mixing.calibrated(mixing.cells(mixing.measured(frame)), {"source": {"elsewhere": 1.0}}).collect()
    assert all(r.weight == 0 for r in none)


def test_pipeline_against_brute_force(spark):
    """Every stage's decision, made again on what its predecessor wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns
        out = {r.doc_id: r for r in after.collect()}
        if name.startswith("quality"):
            fitted = rules.train(kept, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in rules.score(kept, fitted).collect() if r.score >= 0.7}
        elif name.startswith("SimHash"):
            want = {g[3] for g in groups([(d, r.text) for d, r in before.items()])}
        elif name.startswith("benchmark"):
            items = [decontamination.words_of(decontamination.prepared(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            runs = {b" ".join(i) for i in items}
            want = {d for d, r in before.items() if not any(x in b" ".join(decontamination.words_of(decontamination.prepared(r.text))) for x in runs)}
        elif name.startswith("PII"):
            want = set(before)
            maker = pii.Surrogates(pii.session_key(spark), pii.settle(kept, pii.session_key(spark)))
            for d, r in before.items():
                text = maker.replace(r.text)[0]
                assert out[d].text == text and out[d].n_chars == len(text)
        else:
            want = {r.doc_id for r in mixing.mix(kept).collect() if r.kept}
        assert set(out) == want
        kept = spark.createDataFrame([tuple(r) for r in out.values()], docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(out)


def test_base_hash_of_no_spans(spark):
    empty = hashlib.sha256(b"").hexdigest()
    got = queries.op7_secret_scan(spark, SF).where("n_assign + n_access + n_hex = 0").select("base_sha256").distinct().collect()
    assert [r[0] for r in got] == [empty]
