"""Token counts by byte-pair merging with a heap and a linked list.

A piece of text starts as one symbol a byte, in a doubly linked list. A heap holds the adjacent pairs
that the vocabulary can merge, lowest rank first and leftmost on a tie; a popped pair that is still
whole is merged, and its two new neighbours are pushed. The count is the initial symbols minus the
merges: no identifiers are made. A piece of n bytes costs O(n log n), however long it is.

Pieces come from the vocabulary's split pattern. Short pieces repeat, so each worker remembers their
counts in a table of bounded size. The result is that of the vocabulary's own library, without added tokens.

Nulls: a null text counts as empty, with 0 tokens. Repeated ids stay rows of their own; more columns in
the input are ignored. Bytes that UTF-8 can't hold don't occur in Spark strings.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Split pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer pieces aren't remembered, and no more than so many are.
LONG, REMEMBERED = 48, 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Merge ranks of one vocabulary, as (left symbol, right symbol) -> (rank, merged symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE vocabularies are counted here")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = vocab[char]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.table = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in spec["added_tokens"]]

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n < 2:
            return n
        symbol, table = [self.first[b] for b in piece], self.table
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := table.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapify(heap)
        merges = 0
        while heap:
            _, i, merged, left, right = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has merged since
            merges += 1
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := table.get((merged, symbol[k])):
                    heappush(heap, (found[0], i, found[1], merged, symbol[k]))
            p = before[i]
            if p >= 0 and (found := table.get((symbol[p], merged))):
                heappush(heap, (found[0], p, found[1], symbol[p], merged))
        return n - merges


class Remembered(dict):
    """Piece -> tokens; forgets everything when it is full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode())
        if len(piece) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Text to number of tokens. Special strings inside the text count one token each."""
    merges = Merges(path)
    known, pieces = Remembered(merges), regex.compile(PIECES).finditer
    special = merges.special

    def plain(text: str) -> int:
        # finditer, so that the pieces of a very long text are never a list
        return sum(known[m.group()] for m in pieces(text))

    def count(text: str) -> int:
        found = [s for s in special if s in text]
        if not found:
            return plain(text)
        parts = regex.split("|".join(regex.escape(s) for s in sorted(found, key=len, reverse=True)), text)
        return sum(map(plain, parts)) + len(parts) - 1

    return count


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than limit tokens), one row for each row of docs."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.cast(pa.compute.binary_length(batch.column("text")), pa.int64()), tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
