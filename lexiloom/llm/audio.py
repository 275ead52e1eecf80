"""Media columns: chroma audio fingerprints, and the alignment of recordings by them.

`fingerprint` turns samples into one packed integer a frame: a short-time Fourier transform is folded into 12 pitch classes; 16 filters
(rectangle sums of an integral image over frames and pitch classes, compared in the log domain) give two bits each, in Gray code.

`match` aligns recordings. Every row whose id is divisible by `every` is a query; queries are taken in blocks of a bounded number of
frames, which are broadcast, and searched for in all rows. Every offset of every pair is tried: with bits as signs, agreement is a
cross-correlation, which a product of spectra gives for all offsets at once. Offsets that may pass are then verified by the share of bits
that differ over the whole overlap, counted exactly, so no match is missed for want of equal frames. `votes`, the frames equal in all
bits at the offset, only break ties. Rows with one fingerprint are one class: a class is searched once, and the classes' members are
a table of their own, so copies aren't expanded into pairs.

The test tables hold no recordings. `rendered` makes them from a vector: its numbers are the notes of a melody,
so equal vectors sound equal and similar vectors sound similar. It stands for the decoder of a media column. `with_retakes` adds to
such a table other recordings of some rows' melodies: cut at either end, beside the grid of frames, softer, and noisy.

Nulls: null or too short samples have an empty fingerprint, and empty fingerprints match nothing; not-a-number samples count
as silence; rows with a null id are no queries but are searched. Repeated ids stay rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

RATE, FRAME, HOP = 4000, 512, 128
#: (kind, first pitch class, pitch classes, frames) of the 16 filters, and where their three thresholds lie.
FILTERS = [(0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4), (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14)]
SPAN = max(f[3] for f in FILTERS)
CUTS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
#: Frames of all queries in a block: what is broadcast is bounded by it.
BLOCK_FRAMES = 200_000
#: Numbers that a comparison holds at a time.
MOST_CELLS = 4_000_000


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) energies of the pitch classes, each frame normalised; silence is all zeros."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    samples = np.nan_to_num(np.asarray(samples, np.float32), posinf=0, neginf=0)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hertz > 60) & (hertz < 1900)
    pitch = np.round(12 * np.log2(hertz[use] / 440)).astype(int) % 12
    fold = (pitch[:, None] == np.arange(12)).astype(np.float32)
    energy = power[:, use] @ fold
    norm = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0).astype(np.float32)


def packed(energy: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each frame that has SPAN frames to follow it."""
    n = len(energy) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(energy) + 1, 25), np.float64)  # integral image; pitch classes wrap around once
    image[1:, 1:] = np.cumsum(np.cumsum(np.concatenate([energy, energy], axis=1), axis=0), axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, height, width in FILTERS:
        q, half, mid = p + height, width // 2, p + height // 2
        if kind == 0:
            a, b = area(0, width, p, q), np.zeros(n)
        elif kind == 1:  # later against earlier
            a, b = area(half, width, p, q), area(0, half, p, q)
        elif kind == 2:  # higher against lower
            a, b = area(0, width, mid, q), area(0, width, p, mid)
        elif kind == 3:  # two corners against the other two
            a = area(0, half, mid, q) + area(half, width, p, mid)
            b = area(0, half, p, mid) + area(half, width, mid, q)
        elif kind == 4:  # the middle third in time against the rest
            third = width // 3
            a, b = area(third, width - third, p, q), area(0, third, p, q) + area(width - third, width, p, q)
        else:  # the middle third in pitch against the rest
            third = max(1, height // 3)
            a, b = area(0, width, p, p + third), area(0, width, p + third, max(q, p + third + 1))
        value = np.log1p(a) - np.log1p(b) if kind else np.log1p(a) - np.log1p(width * height * 0.2)
        out = out << np.uint32(2) | GRAY[np.searchsorted(CUTS, value)]
    return out


def fingerprint(samples: np.ndarray | None, rate: int = RATE) -> np.ndarray:
    return np.zeros(0, np.uint32) if samples is None else packed(chroma(samples, rate))


def rendered(vector: np.ndarray | None, note_seconds: float = 0.08) -> np.ndarray | None:
    """A melody of len(vector) // 2 notes: pairs of numbers are pitch and loudness, with the overtone of each note."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.asarray(vector, np.float64))
    v = v[: len(v) // 2 * 2].reshape(-1, 2)
    t = np.arange(int(note_seconds * RATE)) / RATE
    pitch = 220 * 2 ** (np.round(np.clip(v[:, :1] * 40, -12, 16)) / 12)
    loud = 0.5 + np.clip(v[:, 1:], -0.45, 0.45)
    return (loud * (np.sin(2 * np.pi * pitch * t) + 0.4 * np.sin(4 * np.pi * pitch * t))).ravel().astype(np.float32)


def with_retakes(rows: DataFrame, id_col: str, media_col: str, every: int = 25) -> DataFrame:
    """id, media: all rows, and a retake of each row whose id is divisible by `every`, under the id -1 - id; for `retaken` to decode."""
    plain = rows.select(F.col(id_col).cast("bigint").alias(id_col), F.col(media_col).cast("array<double>").alias(media_col))
    again = plain.where(F.col(id_col) % every == 0).select((F.lit(-1) - F.col(id_col)).alias(id_col), F.concat(media_col, F.array((F.col(id_col) % 1000 + 1).cast("double"))).alias(media_col))
    return plain.select(id_col, F.concat(media_col, F.array(F.lit(0.0))).alias(media_col)).unionByName(again)


def retaken(vector: np.ndarray | None) -> np.ndarray | None:
    """The melody of all numbers but the last; where that isn't 0 it seeds the retake's cuts and noise."""
    if vector is None or not len(vector):
        return None
    melody, seed = rendered(vector[:-1]), int(np.nan_to_num(vector[-1]))
    if melody is None or not seed:
        return melody
    rng = np.random.default_rng(seed)
    begin, end = rng.integers(HOP // 4, len(melody) // 8 + HOP), len(melody) - rng.integers(0, len(melody) // 8 + 1)
    part = melody[begin:end]
    return (rng.uniform(0.4, 1.0) * part + rng.standard_normal(len(part)) * rng.uniform(0.01, 0.08)).astype(np.float32)


def fingerprints(rows: DataFrame, id_col: str, media_col: str, decode: Callable[[np.ndarray | None], np.ndarray | None] = lambda x: x, rate: int = RATE) -> DataFrame:
    """id, frames (array of packed integers as bigint), one row for each row. decode turns a cell into samples at `rate`."""
    small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            made = [fingerprint(decode(c.values.to_numpy(zero_copy_only=False) if c.is_valid else None), rate).astype(np.int64) for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["id", "frames"])

    return rows.select(id_col, media_col).mapInArrow(run, f"id {kind}, frames array<bigint>")


def classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, frames) with one row for each distinct fingerprint, and (id, class_id) of all rows."""
    named = prints.withColumn("class_id", F.sha2(F.array_join("frames", ","), 256))
    return named.groupBy("class_id").agg(F.first("frames").alias("frames")), named.select("id", "class_id")


def signs(frames: np.ndarray) -> np.ndarray:
    """(frames, 32): 1 for a set bit, -1 for another."""
    return np.unpackbits(frames.astype(np.uint32).view(np.uint8)).reshape(-1, 32).astype(np.float32) * 2 - 1


class Block:
    """Queries of one block, in groups of like length, with the spectra of their bits."""

    def __init__(self, ids: list[str], frames: list[np.ndarray]):
        self.ids, self.frames = ids, frames
        self.size = np.array([len(f) for f in frames], np.int64)
        power = np.ceil(np.log2(np.maximum(self.size, 1)))
        self.groups = [np.flatnonzero(power == k) for k in np.unique(power)]
        self.spectra: dict[int, np.ndarray] = {}  # made where they are used, not sent

    def spectrum(self, k: int) -> tuple[int, int, np.ndarray]:
        """Longest query and transform's length of group k, and (frequencies, queries, 32) of its queries, backwards, so that a product is a correlation."""
        most = int(self.size[self.groups[k]].max())
        length = max(128, 1 << (2 * most - 1).bit_length())
        if k not in self.spectra:
            bits = np.zeros((len(self.groups[k]), most, 32), np.float32)
            for i, q in enumerate(self.groups[k]):
                bits[i, most - self.size[q] :] = signs(self.frames[q])[::-1]
            self.spectra[k] = np.ascontiguousarray(np.fft.rfft(bits, length, axis=1).astype(np.complex64).transpose(1, 0, 2))
        return most, length, self.spectra[k]

    def candidates(self, rows: list[np.ndarray], most_errors: float, least_overlap: int) -> Iterator[tuple[int, int, int]]:
        """(row, query, offset), in the order of offsets, of all that may pass. rows: of one length."""
        n = len(rows[0])
        bits = np.stack([signs(r) for r in rows])
        for k, members in enumerate(self.groups):
            most, length, spectra = self.spectrum(k)
            step = length - most + 1
            parts = -(-n // step)
            cells = np.zeros((len(rows), parts * step, 32), np.float32)
            cells[:, :n] = bits
            other = np.fft.rfft(cells.reshape(len(rows) * parts, step, 32), length, axis=1).astype(np.complex64).transpose(1, 2, 0)
            width = parts * step + most - 1
            offset = np.arange(width) - (most - 1)
            few = max(1, MOST_CELLS // (len(rows) * (width + length * parts)))
            for lo in range(0, len(members), few):
                some = members[lo : lo + few]
                both = np.ascontiguousarray((spectra[:, lo : lo + few] @ other).transpose(1, 2, 0))
                agree = np.fft.irfft(both, length, axis=2).reshape(len(some), len(rows), parts, length)
                if parts == 1:
                    total = agree[:, :, 0]
                else:
                    total = np.zeros((len(some), len(rows), width), np.float32)
                    for p in range(parts):
                        total[:, :, p * step : p * step + length] += agree[:, :, p]
                overlap = np.minimum(self.size[some, None], n - offset) - np.maximum(0, -offset)
                # Half a bit, and what single precision may lose, are allowed for; the exact count decides.
                least = np.where(overlap >= max(1, least_overlap), 32 * overlap * (1 - 2 * most_errors) - 0.5 - 3e-4 * most, np.inf).astype(np.float32)
                q, r, t = np.nonzero(total >= least[:, None, :])
                yield from zip(r.tolist(), some[q].tolist(), offset[t].tolist())

    def search_all(self, rows: list[np.ndarray], most_errors: float, least_overlap: int) -> list[list[tuple[int, int, int, float]]]:
        """For each row (query, offset, votes, share of wrong bits) of the best offset of each query that passes."""
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in rows]
        lengths = np.array([len(r) for r in rows], np.int64)
        for n in np.unique(lengths[lengths > 0]):
            same = np.flatnonzero(lengths == n)
            few = max(1, min(16, BLOCK_FRAMES // int(n)))
            for lo in range(0, len(same), few):
                part = same[lo : lo + few]
                for r, q, offset in self.candidates([rows[i] for i in part], most_errors, least_overlap):
                    row, own = rows[part[r]], best[part[r]]
                    wrong, overlap = errors(self.frames[q], row, offset)
                    if overlap >= least_overlap and wrong <= most_errors:
                        v = equal(self.frames[q], row, offset)
                        if (wrong, -v) < own.get(q, (2.0, 0, 0))[:2]:
                            own[q] = (wrong, -v, offset)
        return [[(q, offset, -v, wrong) for q, (wrong, v, offset) in own.items()] for own in best]

    def search(self, row: np.ndarray, least_votes: int, most_errors: float, least_overlap: int) -> list[tuple[int, int, int, float]]:
        """search_all() of one row. least_votes has no effect: every offset is tried, whatever its votes."""
        return self.search_all([row], most_errors, least_overlap)[0]


def overlapping(query: np.ndarray, row: np.ndarray, offset: int) -> np.ndarray:
    """Bits that differ, one integer a frame, where the query, shifted by offset, overlaps the row."""
    a, b = max(0, -offset), max(0, offset)
    n = max(0, min(len(query) - a, len(row) - b))
    return query[a : a + n] ^ row[b : b + n]


def equal(query: np.ndarray, row: np.ndarray, offset: int) -> int:
    """Frames that are equal in all bits."""
    return int((overlapping(query, row, offset) == 0).sum())


def errors(query: np.ndarray, row: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of wrong bits and number of frames where the query, shifted by offset, overlaps the row."""
    differ = overlapping(query, row, offset)
    if not len(differ):
        return 1.0, 0
    return float(np.bitwise_count(differ).sum() / (32 * len(differ))), len(differ)


def match(prints: DataFrame, every: int = 50, least_votes: int = 4, most_errors: float = 0.15, least_overlap: int = 32) -> tuple[DataFrame, DataFrame]:
    """(query_class, class_id, offset, votes, bit_errors) of other classes, and (id, class_id) of all rows.
    least_votes has no effect: every offset is tried, whatever its votes."""
    spark = prints.sparkSession
    prints = cut(prints)
    distinct, members = classes(prints)
    distinct, members = cut(distinct.where(F.size("frames") > 0)), cut(members)
    asked = members.where((F.col("id").cast("bigint") % every) == 0).select("class_id").distinct()
    queries = cut(distinct.join(asked, "class_id", "left_semi"))
    total = queries.agg(F.sum(F.size("frames"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_FRAMES))
    out = None
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == b).orderBy("class_id").toArrow()
        ids, frames = got.column("class_id").to_pylist(), [np.array(f, np.int64).astype(np.uint32) for f in got.column("frames").to_pylist()]
        shared = spark.sparkContext.broadcast(Block(ids, frames))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                rows, frames = [], [f.values.to_numpy().astype(np.uint32) for f in batch.column("frames")]
                for c, found in zip(batch.column("class_id").to_pylist(), block.search_all(frames, most_errors, least_overlap)):
                    rows += [(block.ids[q], c, offset, votes, wrong) for q, offset, votes, wrong in found if block.ids[q] != c]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_class", "class_id", "offset", "votes", "bit_errors"])

        part = distinct.mapInArrow(run, "query_class string, class_id string, offset bigint, votes bigint, bit_errors double")
        out = part if out is None else out.unionByName(part)
    return out, members


def neighbours(rows: DataFrame, id_col: str = "vec_id", media_col: str = "embedding", decode: Callable = rendered, **options) -> DataFrame:
    """One row for each row: id, frames (number), class_id, class_size, and, summed over the queries that match its class,
    n_queries, with the best one's query_id (the least id of its class), offset, votes and bit_errors."""
    prints = cut(fingerprints(rows, id_col, media_col, decode))
    pairs, members = match(prints, **options)
    size = members.groupBy("class_id").agg(F.count("*").alias("class_size"), F.min("id").alias("least_id"))
    pairs = pairs.join(size.select(F.col("class_id").alias("query_class"), F.col("least_id").alias("query_id")), "query_class")
    order = F.struct("bit_errors", F.negative("votes"), "query_id", "offset", "votes")
    best = pairs.groupBy("class_id").agg(F.count("*").alias("n_queries"), F.min(order).alias("best"))
    known = size.join(best, "class_id", "left").select("class_id", "class_size", F.coalesce("n_queries", F.lit(0)).alias("n_queries"), *[F.col(f"best.{c}").alias(c) for c in ("query_id", "offset", "votes", "bit_errors")])
    named = prints.select(F.col("id").alias(id_col), F.size("frames").alias("frames"), F.sha2(F.array_join("frames", ","), 256).alias("class_id"))
    return named.join(known, "class_id").select(id_col, "frames", "class_id", *known.columns[1:])
