import numpy as np

from lexiloom.llm import audio


def melody(seed, notes=80):
    return audio.rendered(np.random.default_rng(seed).standard_normal(notes * 2) / 8)


def test_noise_and_offset_keep_the_match():
    whole = melody(1)
    part = whole[audio.HOP * 20 :] + 0.02 * np.random.default_rng(9).standard_normal(len(whole) - audio.HOP * 20).astype(np.float32)
    a, b, other = audio.fingerprint(whole), audio.fingerprint(part), audio.fingerprint(melody(2))
    assert audio.errors(b, a, 20)[0] < 0.1 and audio.errors(other, a, 0)[0] > 0.25
    found = audio.Block(["q"], [b]).search(a, 4, 0.15, 32)
    assert [(q, o) for q, o, _, _ in found] == [(0, 20)]
    assert audio.Block(["q"], [b]).search(other, 4, 0.15, 32) == []


def noisy_cuts(melodies, levels):
    """(melody's number, cut recording): cut half a hop beside the grid, with noise."""
    rng = np.random.default_rng(5)
    for level in levels:
        for i, m in enumerate(melodies):
            part = m[audio.HOP * (i % 9) + audio.HOP // 2 :]
            yield i, audio.fingerprint(part + (level * rng.standard_normal(len(part))).astype(np.float32))


def brute_force(query, row, most_errors=0.15, least_overlap=32):
    """The best offset's wrong bits, or None."""
    tried = [audio.errors(query, row, o) for o in range(1 - len(query), len(row))]
    return min((w for w, n in tried if n >= least_overlap and w <= most_errors), default=None)


def test_recall_against_brute_force_over_all_offsets():
    whole = [melody(s, 32 + s % 3 * 40) for s in range(24)]
    block, few = audio.Block([str(i) for i in range(24)], [audio.fingerprint(m) for m in whole]), 0
    for i, row in noisy_cuts(whole, (0.0, 0.1, 0.15, 0.2, 0.25, 0.3)):
        want = {q: w for q in range(24) if (w := brute_force(block.frames[q], row)) is not None}
        got = block.search(row, 4, 0.15, 32)
        assert {q: wrong for q, _, _, wrong in got} == want
        few += sum(votes < 4 for _, _, votes, _ in got)
    assert few > 0


def test_long_rows_in_parts():
    rng = np.random.default_rng(6)
    row = rng.integers(0, 1 << 32, 900, dtype=np.uint32)
    queries = [row[a:b] ^ np.uint32(1 << 7 | 1 << 30) for a, b in ((0, 40), (55, 120), (130, 190), (500, 900), (860, 900))]
    found = audio.Block(list("abcde"), queries).search(row, 4, 0.15, 32)
    assert sorted(found) == [(q, o, 0, 0.0625) for q, o in enumerate((0, 55, 130, 500, 860))]


def test_integral_image_filter_against_sums():
    energy = audio.chroma(melody(3))
    row, t = audio.packed(energy), 7
    twice = np.concatenate([energy, energy], axis=1)
    kind, p, height, width = audio.FILTERS[2]
    late, early = twice[t + width // 2 : t + width, p : p + height].sum(), twice[t : t + width // 2, p : p + height].sum()
    want = audio.GRAY[np.searchsorted(audio.CUTS, np.log1p(late) - np.log1p(early))]
    assert kind == 1 and row[t] >> 26 & 3 == want


def test_edges():
    assert len(audio.fingerprint(None)) == len(audio.fingerprint(np.zeros(10))) == 0
    assert len(set(audio.fingerprint(np.zeros(audio.RATE)))) == 1
    assert len(audio.fingerprint(np.full(audio.RATE, np.nan)))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64)) / 8
    rows = [(i, base[i].tolist()) for i in range(30)] + [(100, base[0].tolist()), (101, (base[3] + 1e-4).tolist()), (150, base[3].tolist()), (200, None), (None, base[5].tolist()), (250, [])]
    got = {r.vec_id: r for r in audio.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 36
    assert got[0].class_id == got[100].class_id and got[0].class_size == 2 and got[0].n_queries == 0
    assert got[101].query_id == 3 and got[101].offset == 0 and got[101].bit_errors < 0.1
    assert got[200].frames == 0 and got[200].n_queries == 0
    assert audio.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_the_query_finds_its_retakes(spark):
    """Every retake of a query's melody, against brute force over all offsets."""
    from lexiloom.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r.vec_id: r for r in queries.op8_audio_fingerprints(spark, sf).collect()}
    rows = audio.with_retakes(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding").collect()
    assert len(got) == len(rows) and any(r.vec_id < 0 for r in rows)
    prints = {r.vec_id: audio.fingerprint(audio.retaken(np.array(r.embedding))) for r in rows}
    want = found = 0
    for q in [i for i in prints if i >= 0 and i % 50 == 0]:
        other, mine = prints[-1 - q], prints[q]
        best = min((e for e in (audio.errors(mine, other, o) for o in range(-len(mine), len(other))) if e[1] >= 32), default=(1.0, 0))
        if best[0] <= 0.15:
            want += 1
            found += got[-1 - q].n_queries >= 1 and abs(got[-1 - q].bit_errors - best[0]) < 1e-9
    assert want >= 5 and found >= 0.9 * want
