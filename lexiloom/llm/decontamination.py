"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

1. Document frequencies of the benchmark's words are counted over all documents. Words that more than `common` of all documents hold
   are left out of the index, except that every item keeps its `KEPT` rarest words.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a latent space of `rank` dimensions: each task multiplies
   its own passages, the driver orthogonalises one small matrix a power iteration.
3. Every document is read in blocks of `BLOCK` words; every block and the next are a passage, so passages overlap by half and cover the
   whole text. A passage with `LEAST_WORDS` indexed words (fewer where items have fewer) whose cosine with one of an
   item's passages reaches `cosine` is a candidate. The cosine's norm is that of the whole TF-IDF vector, so a passage of many items' words, which
   the latent space sees little of, is none.
4. A candidate is verified on words: the longest common subsequence of the item and the text around the passage, as
   a share of the item's length; the item's indexed words alone must reach that share too, so that common words prove nothing. From `verbatim` on the document holds the item. Between `paraphrase` and that it does
   if the item's answer (its last sentence) is there too: `answer` of it, in order.

The benchmark is taken in blocks of a bounded size (`MOST_ITEMS`, `MOST_BYTES`), which bounds all that is broadcast. Document frequencies
of all blocks' words take one pass over the documents (for each `MOST_WORDS` words), and each pass of the search looks for `AT_ONCE` blocks. No text is shuffled.

Nulls: a null document or item text counts as empty, and empty texts match nothing; items and documents without id are reported under a null id.
`clean` decides row by row, whatever the ids. Repeated ids stay rows of their own. Extra columns are ignored by `matches` and handed on by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .hashing import bounds, joined, word_hashes

BLOCK, RANK, KEPT, LEAST_WORDS = 24, 192, 8, 3
MOST_ITEMS, MOST_BYTES = 500, 4 << 20
#: Words whose frequencies are counted in one pass, and blocks that are searched for in one.
MOST_WORDS, AT_ONCE = 2_000_000, 4
SEPARATOR = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


def words_of(text: bytes) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", text)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many words each text has."""
    data, offsets = joined(texts)
    starts, ends = bounds(data, SEPARATOR)
    first = np.searchsorted(starts, offsets)
    return word_hashes(data, starts, ends), np.diff(np.append(first, len(starts)))


class Lexicon:
    """Word hash -> index by binary search, which most other words are kept from by a table on the high bits.

    Only the hashes travel; the table is made where it is used.
    """

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.table = np.unique(hashes), None

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "table": None}

    def index(self, words: np.ndarray) -> np.ndarray:
        """-1 for words that aren't in the lexicon."""
        shift = np.uint64(64 - self.BITS)
        if self.table is None:
            self.table = np.zeros(1 << self.BITS, bool)
            self.table[(self.hashes >> shift).astype(np.int64)] = True
        maybe = np.flatnonzero(self.table[(words >> shift).astype(np.int64)])
        found = np.full(len(words), -1)
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
            right = self.hashes[at] == words[maybe]
            found[maybe[right]] = at[right]
        return found


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with a's places as the bits of one number."""
    places: dict = {}
    for k, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := places.get(w):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Passages:
    """Passages with indexed words: every block of BLOCK words of a text together with its next one.

    first: where each block's indexed words begin; who, at: its text and its place there; size, energy: how many indexed
    words the passage that begins with the block holds, and the sum of their squared weights.
    """

    def __init__(self, index: np.ndarray, counts: np.ndarray, idf: np.ndarray):
        inside = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
        used = np.flatnonzero(index >= 0)
        text, block = np.repeat(np.arange(len(counts)), counts)[used], inside[used] // BLOCK
        self.word = index[used]
        self.first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (block[1:] != block[:-1]))) if len(used) else used
        self.who, self.at = text[self.first], block[self.first]
        self.follows = np.append((self.who[1:] == self.who[:-1]) & (self.at[1:] == self.at[:-1] + 1), False)[: len(self.first)]
        size, energy = np.diff(np.append(self.first, len(used))), np.add.reduceat(idf[self.word] ** 2, self.first) if len(used) else np.zeros(0)
        self.size, self.energy = size.copy(), energy.copy()
        here = np.flatnonzero(self.follows)
        self.size[here] += size[here + 1]
        self.energy[here] += energy[here + 1]

    def some(self, least: int) -> np.ndarray:
        """The passages with `least` indexed words or more."""
        return np.flatnonzero(self.size >= least)

    def vectors(self, chosen: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Latent vectors of the chosen passages over the norms of their TF-IDF vectors."""
        if not len(chosen):
            return np.zeros((0, weights.shape[1]), np.float32)
        need = np.zeros(len(self.first) + 1, bool)
        need[chosen] = True
        need[1:] |= need[:-1] & self.follows
        need = need[:-1]
        words = np.repeat(need, np.diff(np.append(self.first, len(self.word))))
        edge = np.cumsum(np.diff(np.append(self.first, len(self.word)))[need])
        sums = np.zeros((len(self.first), weights.shape[1]), np.float32)
        sums[need] = np.add.reduceat(weights[self.word[words]], np.append(0, edge[:-1]), axis=0)
        out = sums[chosen]
        here = self.follows[chosen]
        out[here] += sums[chosen[here] + 1]
        return out / np.sqrt(self.energy[chosen])[:, None].astype(np.float32)


def frequencies(docs: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """In how many documents each word of the lexicon occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        n, total = len(lex.hashes), np.zeros(len(lex.hashes) + 1, np.int64)
        for batch in batches:
            texts = [prepared(t) for t in batch.column("text").to_pylist()]
            words, counts = hashed(texts)
            found = lex.index(words)
            pairs = np.repeat(np.arange(len(texts)), counts)[found >= 0] * n + found[found >= 0]
            if n:
                total[:n] += np.bincount(np.unique(pairs) % n, minlength=n)
            total[n] += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    got = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(lexicon.hashes) + 1, np.int64)
    out[got.column("word").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def singular_vectors(items: DataFrame, lexicon: Lexicon, idf: np.ndarray, rank: int = RANK, extra: int = 8, powers: int = 3) -> np.ndarray:
    """Right singular vectors (words, rank) of the items' TF-IDF passages, by randomised subspace iteration."""
    context = items.sparkSession.sparkContext
    rows = items.select("text").coalesce(4)  # each task sends a dense block of the basis' size
    q = np.random.default_rng(13).standard_normal((len(idf), rank + extra)).astype(np.float32)
    for step in range(powers + 1):
        q = np.linalg.qr(q)[0].astype(np.float32)
        shared = context.broadcast((lexicon, idf, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lex, weight, basis = shared.value
            total = np.zeros_like(basis)
            for batch in batches:
                words, counts = hashed([prepared(t) for t in batch.column("text").to_pylist()])
                p = Passages(lex.index(words), counts, weight)
                if not len(p.first):
                    continue
                scaled = weight[:, None] * basis
                rows = p.vectors(np.arange(len(p.first)), scaled)  # these passages times the basis
                rows /= np.sqrt(p.energy)[:, None].astype(np.float32)
                # A block's words are in its own passage and in the one before it.
                rows[1:][p.follows[:-1]] += rows[:-1][p.follows[:-1]].copy()
                block = np.repeat(np.arange(len(p.first)), np.diff(np.append(p.first, len(p.word))))
                np.add.at(total, p.word, weight[p.word][:, None] * rows[block])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = rows.mapInArrow(run, "part binary").toArrow().column("part").to_pylist()
        z = sum((np.frombuffer(p, np.float32).reshape(q.shape) for p in parts), np.zeros_like(q))
        if step == powers:
            values, turn = np.linalg.eigh(q.T @ z)
            return (q @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)
        q = z
    raise AssertionError


class Index:
    """One block of the benchmark, ready for retrieval and checks."""

    def __init__(self, ids: list[int], texts: list[str], lexicon: Lexicon, idf: np.ndarray, basis: np.ndarray):
        self.ids, self.lexicon, self.idf, self.weights = ids, lexicon, idf, idf[:, None] * basis
        plain = [prepared(t) for t in texts]
        self.items = [words_of(t) for t in plain]
        sentences = [[w for w in map(words_of, re.split(rb"[.!?]\s", t.strip())) if w] for t in plain]
        self.answers = [s[-1] if s else [] for s in sentences]
        words, counts = hashed(plain)
        indexed = lexicon.index(words)
        ends = np.cumsum(counts)
        self.content = [[w for w, k in zip(ws, indexed[e - c : e]) if k >= 0] for ws, c, e in zip(self.items, counts, ends)]
        # An item of few words asks for few in a passage; the longer ones' passages hold at least this share of their words.
        self.least = max(1, min(LEAST_WORDS, round(0.35 * min((len(c) for c in self.content if c), default=1))))
        p = Passages(indexed, counts, idf)
        every = np.arange(len(p.first))
        unit = p.vectors(every, self.weights)
        self.owner, self.kept = p.who, np.linalg.norm(unit, axis=1)
        self.unit = unit / np.maximum(self.kept, 1e-6)[:, None]

    def search(self, texts: list[bytes], cosine: float) -> list[tuple[int, int, int, float]]:
        """(text, item, first block, cosine) of the candidates. The cosine is that of the passage's whole TF-IDF vector
        with the item's latent one; what the latent space keeps of the item scales the threshold."""
        words, counts = hashed(texts)
        p = Passages(self.lexicon.index(words), counts, self.idf)
        chosen, out = p.some(self.least), []
        least = cosine * np.maximum(self.kept, 0.2)
        for lo in range(0, len(chosen), 8192):
            part = chosen[lo : lo + 8192]
            c = p.vectors(part, self.weights) @ self.unit.T
            row, i = np.nonzero(c >= least)
            out += zip(p.who[part[row]].tolist(), self.owner[i].tolist(), p.at[part[row]].tolist(), c[row, i].tolist())
        return out


@dataclass(frozen=True)
class Thresholds:
    cosine: float = 0.3
    verbatim: float = 0.8
    paraphrase: float = 0.55
    answer: float = 0.6
    rank: int = RANK
    common: float = 0.05


def held(index: Index, texts: list[bytes], limits: Thresholds) -> dict[tuple[int, int], tuple[tuple[float, float, float], str]]:
    """(text, item) -> ((share, answer's share, cosine), kind) of what the texts hold of a block's items."""
    found: dict[tuple[int, int], tuple[tuple[float, float, float], str]] = {}
    split: dict[int, list[bytes]] = {}
    for text, item, at, cos in index.search(texts, limits.cosine):
        if text not in split:
            split[text] = words_of(texts[text])
        want = index.items[item]
        around = split[text][max(0, at * BLOCK - len(want)) : (at + 2) * BLOCK + len(want)]
        content, said = index.content[item], index.answers[item]
        share = min(lcs(want, around) / len(want), lcs(content, around) / len(content))
        heard = lcs(said, around) / len(said) if said else 0.0
        kind = "verbatim" if share >= limits.verbatim else "paraphrase" if share >= limits.paraphrase and heard >= limits.answer else None
        if kind and (share, heard, cos) > found.get((text, item), ((0.0, 0.0, 0.0), ""))[0]:
            found[text, item] = ((share, heard, cos), kind)
    return found


def indexes(docs: DataFrame, benchmark: DataFrame, limits: Thresholds) -> Iterator[tuple[list[Index], pa.DataType]]:
    """The benchmark's blocks, some at a time, and the type of its ids."""
    small_batches(docs.sparkSession)
    items = cut(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n // MOST_ITEMS), -(-size // MOST_BYTES))
    waiting, words, done = [], 0, []
    for b in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        arrow = block.toArrow()
        got = sorted(arrow.to_pylist(), key=lambda r: (r["item_id"] is not None, r["item_id"], r["text"]) if r["item_id"] is not None else (False, 0, r["text"]))
        waiting.append((block, arrow.schema.field("item_id").type, got, hashed([prepared(r["text"]) for r in got])))
        words += len(waiting[-1][3][0])
        if words > MOST_WORDS or b == count - 1:
            every = Lexicon(np.concatenate([w for *_, (w, _) in waiting]))
            df, n_docs = frequencies(docs, every)
            for block, id_type, got, hashes in waiting:
                done.append((indexed_block(block, got, hashes, every, df, n_docs, limits), id_type))
                if len(done) == AT_ONCE:
                    yield [i for i, _ in done], id_type
                    done = []
            waiting, words = [], 0
    if done:
        yield [i for i, _ in done], done[0][1]


def indexed_block(block: DataFrame, got: list[dict], hashes: tuple[np.ndarray, np.ndarray], every: Lexicon, df: np.ndarray, n_docs: int, limits: Thresholds) -> Index:
    words, counts = hashes
    place = every.index(words)
    use = np.zeros(len(every.hashes), bool)
    use[place] = df[place] <= limits.common * n_docs
    for lo, c in zip(np.cumsum(counts) - counts, counts):
        own = np.unique(place[lo : lo + c])
        use[own[np.argsort(df[own], kind="stable")[:KEPT]]] = True
    lexicon = Lexicon(every.hashes[use])
    idf = (np.log((1 + n_docs) / (1 + df[use])) + 1).astype(np.float32)
    basis = np.zeros((0, limits.rank), np.float32)
    if len(idf):
        basis = singular_vectors(block, lexicon, idf, min(limits.rank, len(idf)), min(8, max(0, len(idf) - limits.rank)))
    return Index([r["item_id"] for r in got], [r["text"] for r in got], lexicon, idf, basis)


def matches(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs, answer, kind ("verbatim" or "paraphrase"), one row for each document's row and item it holds."""
    limits = Thresholds(**options)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, cosine double, lcs double, answer double, kind string"
    out = None
    for blocks, id_type in indexes(docs, benchmark, limits):
        shared = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, id_type=id_type) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [prepared(t) for t in batch.column("text").to_pylist()]
                for index in shared.value:
                    found = held(index, texts, limits)
                    rows = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array([t for t, _ in rows], pa.int64())),
                            pa.array([index.ids[i] for _, i in rows], id_type),
                            *(pa.array([found[r][0][k] for r in rows], pa.float64()) for k in (2, 0, 1)),
                            pa.array([found[r][1] for r in rows], pa.string()),
                        ],
                        ["doc_id", "item_id", "cosine", "lcs", "answer", "kind"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark item. Rows go by themselves, also without id or with one that others have; no join."""
    limits = Thresholds(**options)
    out, place = docs, docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for blocks, _ in indexes(docs, benchmark, limits):
        shared = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [prepared(t) for t in batch.column(place).to_pylist()]
                gone = {t for index in shared.value for t, _ in held(index, texts, limits)}
                yield batch.filter(pa.array([k not in gone for k in range(len(texts))], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
