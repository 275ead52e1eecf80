"""Features as numbers: text.features_of() counted in arrays, without a string for each n-gram of characters.

An n-gram of up to three characters is 63 bits, three characters (plus 1) of 21 bits, and so has its key exactly; a word that has the form of such an
n-gram is the same feature and gets the same key. All other features go by name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .text import BLANK, LOW, SEPARATOR, features_of

BITS = 21
#: Characters of the longest n-gram that is a key.
LONGEST = 3


def key_of(name: str) -> int:
    """The key of a feature that has the form of an n-gram of characters; 0 where it has not."""
    n = len(name)
    if n == 1:
        return ord(name) + 1
    if n == 3 and name[1] == SEPARATOR:
        return (ord(name[0]) + 1) << BITS | (ord(name[2]) + 1)
    if n == 5 and name[1] == SEPARATOR == name[3]:
        return ((ord(name[0]) + 1) << BITS | (ord(name[2]) + 1)) << BITS | (ord(name[4]) + 1)
    return 0


def hashes(names: Sequence[str]) -> np.ndarray:
    """Negative 63-bit hashes (SipHash), the same in every process."""
    return pd.util.hash_array(np.fromiter(names, object, len(names)), categorize=False).view(np.int64) | np.int64(-1 << 63)


def keys_of(names: Sequence[str]) -> np.ndarray:
    """A number for each feature: the key where there is one, else the hash."""
    keys = np.fromiter(map(key_of, names), np.int64, len(names))
    rest = np.flatnonzero(keys == 0)
    if len(rest):
        keys[rest] = hashes([names[k] for k in rest])
    return keys


def names_of(keys: np.ndarray) -> pa.Array:
    """The features of ascending keys (of n-grams, not hashes)."""
    parts, begin = [], 0
    for order in range(1, LONGEST + 1):
        end = len(keys) if order == LONGEST else int(np.searchsorted(keys, 1 << BITS * order))
        own = keys[begin:end]
        begin = end
        if not len(own):
            continue
        signs = np.full((len(own), 2 * order - 1), ord(SEPARATOR), "<u4")
        for k in range(order):
            signs[:, 2 * k] = ((own >> BITS * (order - 1 - k)) & ((1 << BITS) - 1)) - 1
        sizes = 1 + (signs >= 0x80).astype(np.int32) + (signs >= 0x800) + (signs >= 0x10000)
        offsets = np.zeros(len(own) + 1, np.int32)
        np.cumsum(sizes.sum(axis=1), out=offsets[1:])
        data = signs.tobytes().decode("utf-32-le").encode()
        parts.append(pa.StringArray.from_buffers(len(own), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of ascending keys begin, and their lengths."""
    begin = np.concatenate([[True], keys[1:] != keys[:-1]]).nonzero()[0] if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(begin, append=len(keys))


def merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    begin, _ = runs(keys)
    return keys[begin], *(np.add.reduceat(v[order], begin) if len(begin) else v for v in values)


def cleaned(text: str) -> str:
    return BLANK.sub(" ", text.strip(LOW)).strip(LOW)


def words_counted(texts: Sequence[str], order: int, weights: np.ndarray | None = None) -> tuple[pa.Array, ...]:
    """Distinct word n-grams of cleaned texts, their counts over all texts, and with `weights` (one for each text) the sums of their texts' weights."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    parts, owners = [words], [owner]
    for n in range(2, order + 1):
        same = owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :]
        joined = pc.binary_join_element_wise(*(words.slice(k, len(same)) for k in range(n)), pa.scalar(SEPARATOR, pa.large_string()))
        parts.append(joined.filter(pa.array(same)))
        owners.append(owner[: len(same)][same])
    found = (pa.concat_arrays(parts) if order > 1 else words).dictionary_encode()
    return summed(found, np.ones(len(found), np.int64), *([] if weights is None else [weights[np.concatenate(owners)]]))


def summed(found: pa.DictionaryArray, counts: np.ndarray, *values: np.ndarray) -> tuple[pa.Array, ...]:
    """The dictionary of an array of names, and the sums of their counts and values."""
    at, n = found.indices.to_numpy(), len(found.dictionary)
    return found.dictionary, np.bincount(at, counts, n).astype(np.int64), *(np.bincount(at, v, n) for v in values)


def char_grams(clean: str, order: int, drop_first: bool = True) -> list[np.ndarray]:
    """The keys of a cleaned text's n-grams of characters, by their order."""
    parts: list[np.ndarray] = []
    if order:
        c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)[1 if drop_first else 0 :] + 1
        gram = c
        parts.append(c)
        for n in range(2, order + 1):
            gram = gram[:-1] << BITS | c[n - 1 :]
            parts.append(gram)
    return parts


def keys_counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending keys and their counts."""
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    keys.sort()
    begin, counts = runs(keys)
    return keys[begin], counts


def counted(text: str | None, char_order: int = 3, word_order: int = 1, drop_first: bool = True) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """The features of a text: ascending keys and their counts, and the counts of the others by name."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    if char_order > LONGEST:
        names, parts = Counter(features_of(text, char_order, word_order, drop_first)), []
    else:
        clean = cleaned(text)
        parts, names = [], Counter()
        parts += char_grams(clean, char_order, drop_first)
        if word_order:
            words = clean.split(" ")
            names.update(words)
            for n in range(2, word_order + 1):
                names.update(map(SEPARATOR.join, zip(*(words[k:] for k in range(n)))))
    few = [(key, w) for w in names if len(w) <= 2 * LONGEST - 1 and (key := key_of(w))]
    if few:
        parts.append(np.repeat(np.array([k for k, _ in few], np.int64), np.array([names.pop(w) for _, w in few], np.int64)))
    return *keys_counted(parts), names
