"""Substring deduplication: words covered by a run of `n` words that also starts in an earlier document go.

Two ways, with the same results where both apply.

`against_reference`: suffix automata of the shards of a bounded reference set are broadcast one block of shards after
another; each document is streamed through every automaton, whose matching statistics (the longest run that ends
at each word and occurs in the shard) give the spans of n words or more.

`deduplicate`: the corpus against itself. As every document is reference and stream at once, automata of all shards would have to read
all documents, which grows as the square of the corpus (figures in the README). So equal runs meet by shuffle, exactly, in passes over the texts:
1. A run's anchor is the run of `k` words inside it with the least hash. Equal runs have equal anchors, and neighbouring runs share them, so
   anchors are a third of the runs. Shorter anchors would be fewer, but repeat by chance, which grows as the square of the corpus. Counted with partial sums, they show which anchors occur in two documents.
2. The neighbouring runs of one anchor are a hull. The hulls of repeated anchors are keyed by their hash, beside the anchor, and each key's least
   document is found. In all other documents with that key, all of the hull's runs go.
3. Where all of an anchor's hulls have one key, that settles all its runs: each occurs wherever the others do. Only where an anchor has
   several keys, the runs of hulls in their least document are keyed one by one. Again all but the least document's go.
4. A bitmap of (key, least document) tells every document what to keep: a key that it doesn't hold for a document has an earlier one, for
   certain, and goes without any shuffle. A key that it does hold is the least document's, or one of the few that share its bit;
   those keys alone are shuffled once more, and compared with the least document itself.
5. What the runs to go cover leaves the text. Only documents for which step 4 found more have their text shuffled.
Bitmaps are sized by the number of their entries, `LOAD` bits each, so the share that they let through doesn't grow with the corpus, up to 2 ** `MOST_BITS` bits (64 MB);
beyond that a bitmap lets more through, which costs shuffled rows (one hull every 3.5 words at most), not results.

A run that a third of all documents hold is one row a task in the partial sums, and one row of the smaller side of the joins.

Nulls: a null text has no words; a null id is neither earlier nor later than another, and its words stay. Rows with one id aren't earlier than
each other. Extra columns of the input are ignored. Texts with fewer than n words stay whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .hashing import bounds, joined, mix, run_hashes, word_hashes

N, K = 13, 8
#: Bits of a bitmap for each of its entries, and the largest bitmap as a power of two.
LOAD, MOST_BITS = 16, 29
#: Places that the driver takes as they are; more are united on the executors first.
MOST_PLACES = 1 << 23
#: An anchor's low bits aren't sent: 40 bits and a key of 64 tell hulls and runs apart.
ANCHOR_MASK = np.uint64(0xFFFFFFFFFF000000)


class SuffixAutomaton:
    """Suffix automaton of word sequences. Sequences don't run into one another."""

    def __init__(self, sequences: list[list[bytes]] = ()):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for words in sequences:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self.extend(last, w)

    def extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # an earlier sequence has been here
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self.split(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self.split(p, w, q)
        return cur

    def split(self, p: int, w: bytes, q: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def matching(self, words: list[bytes]) -> list[int]:
        """For each word, the length of the longest run that ends there and occurs in a sequence."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            out.append(size)
        return out


def covered(matching: list[int], n: int) -> np.ndarray:
    """Which words lie in a run of n words or more that occurs in the reference."""
    edge = np.zeros(len(matching) + 1, np.int64)
    for end, size in enumerate(matching):
        if size >= n:
            edge[end + 1 - size] += 1
            edge[end + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def report(words: list[bytes], gone: np.ndarray | None) -> tuple[int, int, str]:
    kept = words if gone is None else [w for w, g in zip(words, gone) if not g]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def against_reference(docs: DataFrame, reference: list[str], n: int = N, shard_words: int = 200_000, most_words: int = 5_000_000, shards_at_once: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, with the runs of `reference` removed from docs (doc_id, text).

    The reference is bounded: more than most_words words are refused. Shards are broadcast in blocks; spans of
    all blocks are united before anything is removed.
    """
    spark = docs.sparkSession
    shards, size = [[]], 0
    for text in reference:
        words = (text or "").encode().split()
        if size and size + len(words) > shard_words:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    if sum(len(w) for s in shards for w in s) > most_words:
        raise ValueError("the reference is too large to broadcast; use deduplicate()")
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("gone"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for k in range(0, len(shards), shards_at_once):
        block = spark.sparkContext.broadcast(shards[k : k + shards_at_once])

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            automata = [SuffixAutomaton(s) for s in block.value]
            for batch in batches:
                marks = []
                for text, before in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                    words = text.encode().split()
                    gone = np.frombuffer(before, bool).copy() if before is not None else np.zeros(len(words), bool)
                    for a in automata:
                        gone |= covered(a.matching(words), n)
                    marks.append(gone.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(marks, pa.binary())], ["doc_id", "text", "gone"])

        rows = rows.mapInArrow(run, f"doc_id {kind}, text string, gone binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [report(t.encode().split(), None if g is None else np.frombuffer(g, bool)) for t, g in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, zip(*out))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def texts_of(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def runs(texts: list[bytes], n: int = N, k: int = K) -> tuple[np.ndarray, ...]:
    """For all runs of n words in the texts: text, place in the text, anchor, whether the anchor's place is new, hash."""
    data, offsets = joined(texts)
    starts, ends = bounds(data)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)  # the texts' first words
    last = np.append(first[1:], len(starts))
    anchors = run_hashes(words, k, 1)
    m = max(len(words) - n + 1, 0)
    least, at = anchors[:m].copy(), np.zeros(m, np.int8)
    for j in range(1, n - k + 1):
        less = anchors[j : j + m] < least
        np.copyto(least, anchors[j : j + m], where=less)
        at[less] = j
    where = np.arange(m) + at
    owner = np.repeat(np.arange(len(texts)), last - first)[:m]
    whole = np.arange(m) + n <= last[owner]
    new = np.ones(m, bool)
    new[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
    # A run that crosses into the next text is none, but it mustn't hide that its anchor is new in that text.
    keep = np.flatnonzero(whole)
    return owner[keep], keep - first[owner[keep]], least[keep], new[keep], run_hashes(words, n, 2)[keep]


class Bitmap:
    """A bit for the high `bits` bits of each value; travels compressed."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(df: DataFrame, value: str, n: int, bits: int | None = None) -> Bitmap:
        """Of the n values of df. What is collected is bounded by the bitmap's size or by MOST_PLACES, whatever df holds."""
        if bits is None:
            bits = min(MOST_BITS, max(12, (n * LOAD - 1).bit_length()))
        place = F.shiftrightunsigned(value, 64 - bits)
        out = np.zeros(1 << (bits - 6), np.uint64)
        if n <= MOST_PLACES:
            places = df.select(place.cast("int").alias("p")).toArrow().column("p").to_numpy().astype(np.int64)
            np.bitwise_or.at(out, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))
            return Bitmap(out, bits)
        words = df.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return Bitmap(out, bits)

    def __getstate__(self) -> dict:
        return {"words": zlib.compress(self.words.tobytes(), 1), "bits": self.bits}

    def __setstate__(self, state: dict) -> None:
        self.words, self.bits = np.frombuffer(zlib.decompress(state["words"]), np.uint64), state["bits"]

    def has(self, values: np.ndarray) -> np.ndarray:
        place = values >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def row_mark(text: bytes) -> int:
    """31 bits of the text, which tell rows with one id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "big") >> 1


def hulls(owner: np.ndarray, new: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First run, number of runs, and hash of each hull. The first and the last run hold all of a hull's words."""
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(new)))
    last = start + size - 1
    return start, size, mix(run[start] * np.uint64(0xD6E8FEB86659FD93) + run[last] * np.uint64(0xCA5A826395121157) + size.astype(np.uint64))


def with_doc(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """High bits that depend on hash and id, as with_doc_column() has them."""
    mixed = (ids.view(np.uint64) & np.uint64(0x3FFFFFFF)) * np.uint64(0x1E3779B1)
    return hashes ^ ((mixed & np.uint64(0x7FFFFFFF)) << np.uint64(33))


def with_doc_column(hashes: Column, ids: Column) -> Column:
    mixed = ids.bitwiseAND(F.lit(0x3FFFFFFF)) * F.lit(0x1E3779B1).cast("bigint")
    return hashes.bitwiseXOR(F.call_function("shiftleft", mixed.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(33)))


def least_docs(rows: DataFrame) -> DataFrame:
    """anchor, key, first, last: the documents that a key spans."""
    return stored(rows.groupBy("anchor", "key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))


def later(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, at, size of the rows whose key an earlier document has. The side with one row a key is the smaller
    one; a key that many documents hold may be split over tasks."""
    first = known.where("first < last").select("anchor", "key", "first")
    return rows.hint("merge").join(first, ["anchor", "key"]).where("doc_id > first").select("doc_id", "at", "size")


class Found:
    """Hulls with repeated anchors in a batch: owner's text, place, runs, anchor, key and document, as arrays side by side."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, anchors: Bitmap, n: int, k: int):
        self.owner, self.place, anchor, new, self.run = runs(texts, n, k)
        self.anchor = anchor & ANCHOR_MASK
        start, size, key = hulls(self.owner, new, self.run)
        use = anchors.has(self.anchor[start])
        self.start, self.size, self.key = start[use], size[use], key[use]
        self.ids = ids

    def first(self, settled: Bitmap) -> np.ndarray:
        """Which hulls may be in their key's least document; the others have an earlier one for certain."""
        return settled.has(with_doc(self.key, self.ids[self.owner[self.start]]))

    def single(self, some: np.ndarray, several: Bitmap) -> np.ndarray:
        """The runs of those of the hulls some whose anchor has several keys."""
        some = some & several.has(self.anchor[self.start])
        start, size = self.start[some], self.size[some]
        return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def deduplicate(docs: DataFrame, n: int = N, k: int = K, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text). Ids are integers.
    bits: a fixed size of all bitmaps, as a power of two, instead of one that follows the entries."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = rows.where("doc_id IS NOT NULL")

    def bitmap(df: DataFrame, value: Column | str):
        return spark.sparkContext.broadcast(Bitmap.of(df.select(F.col(value).alias("_v") if isinstance(value, str) else value.alias("_v")), "_v", df.count(), bits))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            owner, _, anchor, new, _ = runs(texts_of(batch.column("text")), n, k)
            anchor, doc = anchor[new] & ANCHOR_MASK, ids[owner[new]]
            order = np.lexsort((doc, anchor))  # one row for each anchor of the batch
            anchor, doc = anchor[order], doc[order]
            edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, int)
            end = np.append(edge[1:], len(anchor)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor[edge].view(np.int64)), pa.array(doc[edge]), pa.array(doc[end[: len(edge)]])], ["anchor", "lo", "hi"])

    def found_in(batch: pa.RecordBatch) -> tuple[list[bytes], Found]:
        texts = texts_of(batch.column("text"))
        return texts, Found(texts, batch.column("doc_id").to_numpy(zero_copy_only=False), anchors.value, n, k)

    def hull_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, f = found_in(batch)
            yield from sent(("anchor", f.anchor[f.start]), ("key", f.key), ("doc_id", f.ids[f.owner[f.start]]))

    def run_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, f = found_in(batch)
            at = f.single(f.first(hull_firsts.value), several.value)
            yield from sent(("anchor", f.anchor[at]), ("key", f.run[at]), ("doc_id", f.ids[f.owner[at]]))

    def doubt_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hulls and runs of repeated keys that the bitmaps take for those of the least document."""
        for batch in batches:
            texts, f = found_in(batch)
            first = f.first(hull_firsts.value)
            at = f.single(first, several.value)
            at = at[run_firsts.value.has(with_doc(f.run[at], f.ids[f.owner[at]]))]
            start, key, size = np.append(f.start[first], at), np.append(f.key[first], f.run[at]), np.append(f.size[first], np.ones(len(at), np.int64))
            use = wanted.value.has(key)
            start, key, size = start[use], key[use], size[use]
            marks = np.zeros(len(texts), np.int64)
            for t in np.unique(f.owner[start]):
                marks[t] = row_mark(texts[t])
            yield from sent(("anchor", f.anchor[start]), ("key", key), ("doc_id", f.ids[f.owner[start]]), ("at", marks[f.owner[start]] << 32 | f.place[start]), ("size", size))

    triple = "anchor bigint, key bigint, doc_id bigint"
    repeated = known.mapInArrow(first_pass, "anchor bigint, lo bigint, hi bigint").groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    anchors = bitmap(stored(repeated.where("lo < hi").select("anchor")), "anchor")
    hull_docs = least_docs(known.mapInArrow(hull_pass, triple))
    of_first = with_doc_column(F.col("key"), F.col("first"))
    hull_firsts = bitmap(hull_docs, of_first)
    keys = hull_docs.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    several = bitmap(stored(keys.where("a < b").select("anchor")), "anchor")
    run_docs = least_docs(known.mapInArrow(run_pass, triple))
    run_firsts = bitmap(run_docs, of_first)
    both = hull_docs.union(run_docs)
    wanted = bitmap(both.where("first < last"), "key")
    found = later(known.mapInArrow(doubt_pass, triple + ", at bigint, size bigint"), both)
    found = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "size")).alias("at")))
    pending = bitmap(found, with_doc_column(F.lit(0).cast("bigint"), F.col("doc_id")))

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            gone: list[np.ndarray | None] = [None] * batch.num_rows
            split: dict[int, list[bytes]] = {}
            numbered = batch.filter(batch.column("doc_id").is_valid())
            texts, f = found_in(numbered)
            first = f.first(hull_firsts.value)
            at = f.single(first, several.value)
            at = at[~run_firsts.value.has(with_doc(f.run[at], f.ids[f.owner[at]]))]
            start, size = np.append(f.start[~first], at), np.append(f.size[~first], np.ones(len(at), np.int64))
            order = np.argsort(f.owner[start], kind="stable")
            start, size = start[order], size[order]
            owner, place = f.owner[start], f.place[start]
            edge = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
            row = np.flatnonzero(valid)
            for lo, hi in zip(edge, np.append(edge[1:], len(owner))):
                words = texts[owner[lo]].split()
                split[row[owner[lo]]], gone[row[owner[lo]]] = words, covering(len(words), place[lo:hi], size[lo:hi], n)
            ids, whole = batch.column("doc_id"), texts_of(batch.column("text"))
            number = ids.fill_null(0).to_numpy(zero_copy_only=False)
            wait = pending.value.has(with_doc(np.zeros(len(number), np.uint64), number)) & valid
            done = [(None, None, None) if w else report(split.pop(i, None) or t.split(), g) for i, (t, g, w) in enumerate(zip(whole, gone, wait))]
            text = [t if w else None for t, w in zip(whole, wait)]
            marked = [g.tobytes() if w and g is not None else None for g, w in zip(gone, wait)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(text, pa.binary()), pa.array(marked, pa.binary()), *columns_of(done)], ["doc_id", "text", "gone", "n_words", "n_removed", "kept_sha256"])

    result = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    rest = rows.mapInArrow(last_pass, "doc_id bigint, text binary, gone binary, n_words bigint, n_removed bigint, kept_sha256 string")
    return rest.join(found, "doc_id", "left").mapInArrow(removal(n), result)


def sent(*columns: tuple[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; values are taken as 64 bits."""
    for part in range(0, len(columns[0][1]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(v[part : part + (1 << 17)].view(np.int64)) for _, v in columns], [c for c, _ in columns])


def covering(n_words: int, place: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which words the runs from place on cover: size runs of n words each, one word apart."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + size - 1 + n, -1)
    return np.cumsum(edge[:-1]) > 0


def columns_of(done: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*done) if done else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))]


def removal(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, marked, places = batch.column("text").to_pylist(), batch.column("gone").to_pylist(), batch.column("at")
            done = list(zip(*(batch.column(c).to_pylist() for c in ("n_words", "n_removed", "kept_sha256"))))
            for i, (text, before, have) in enumerate(zip(texts, marked, done)):
                if text is None:
                    out.append(have)
                    continue
                words = text.split()
                gone = None if before is None else np.frombuffer(before, bool)
                if places[i].is_valid:
                    at, size = (places[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "size"))
                    own = at >> 32 == row_mark(text)
                    more = covering(len(words), at[own] & 0xFFFFFFFF, size[own], n)
                    gone = more if gone is None else gone | more
                out.append(report(words, gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns_of(out)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def deduplicate_sql(n: int = N) -> str:
    """deduplicate() of documents in DuckDB SQL: all runs as strings, so for small tables."""
    return f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    p AS (SELECT r, doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
    g AS (SELECT r, doc_id, p AS i, string_agg(word, ' ') OVER o AS run FROM p WINDOW o AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) QUALIFY count(*) OVER o = {n}),
    f AS (SELECT run, min(doc_id) AS first FROM g GROUP BY run),
    gone AS (SELECT DISTINCT r, i + k AS p FROM g JOIN f USING (run), range({n}) t(k) WHERE doc_id > first),
    kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN gone USING (r, p) GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""
