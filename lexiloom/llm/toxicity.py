"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

Input of a word: a vector of its own, where the training sample holds it in `LEAST` documents or more, plus the means of
the hashed vectors of its character trigrams and of its beginnings. Two gated recurrent chains read a window of words from either side; attention
weighs their states; a logistic unit scores the window. Overlapping windows of the whole text, one every `STRIDE` words, are scored and the
highest counts; every passage of up to WINDOW - STRIDE + 1 words lies whole in one of them. Training (numpy, on the driver) sees whole texts too: the windows of a document are pooled by their
softmax, so that a document's label is explained by its worst windows. Words begin with what the sample says of them (`evidence`), and the
hashed inputs learn the more slowly the fewer documents there are: a few hundred labels can't teach thousands of buckets.

Scoring runs in Arrow batches. The input side of the gates is linear in the word, so it is computed once for each
distinct word and kept in a table of bounded size; the recurrence then runs over thousands of windows at once.

Nulls: a null text counts as empty. A text without words is scored as one empty window. Repeated ids stay rows of
their own. Rows without label or id don't take part in training; without both classes the score is the class share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches
from .rules import sampled

WINDOW, STRIDE, HIDDEN, WIDTH = 24, 12, 8, 12
BUCKETS, WORDS, LEAST = 1 << 13, 4000, 4
#: Documents from which on the hashed inputs learn at the full rate.
ENOUGH = 3000
#: Lengths in bytes of the beginnings of words that are inputs.
HEADS = (4, 5, 6, 7)
STRIP = b".,;:!?|*$%&#\"'()[]-"
#: Words whose gate inputs a worker remembers, and windows that run at once.
REMEMBERED, AT_ONCE = 150_000, 4096


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without outer punctuation; what is punctuation only stays as it is."""
    return [w.strip(STRIP) or w for w in (text or "").lower().encode().split()]


def bucket(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def characters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words' trigrams in a row, how many each word has (its length, at least one), and
    buckets (words, len(HEADS)) of their beginnings."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03\x00" for w in words), np.uint8).astype(np.uint64)
    mixed = flat[:-2] * np.uint64(0x9E3779B1) + flat[1:-1] * np.uint64(0x85EBCA6B) + flat[2:] * np.uint64(0xC2B2AE35)
    starts = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
    counts = np.maximum(lengths, 1)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.minimum(np.repeat(starts, counts) + within, len(mixed) - 1)
    heads, h = [], np.zeros(len(words), np.uint64)
    for k in range(max(HEADS)):
        byte = np.where(k < lengths, flat[np.minimum(starts + 1 + k, len(flat) - 1)], 0).astype(np.uint64)
        h = (h + byte + np.uint64(1)) * np.uint64(0x27D4EB2F165667C5)
        if k + 1 in HEADS:
            heads.append(bucket(h + np.uint64(k)))
    return bucket(mixed[at]), counts, np.stack(heads, axis=1)


def windows(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows over n words: every stride, and a last one that ends with the text."""
    last = max(n - WINDOW, 0)
    return np.unique(np.append(np.arange(0, last, stride), last))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; gates lie in the order update, reset, candidate."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 5):
        rng, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": draw(len(vocabulary) + 1, WIDTH, scale=0.3), "char": draw(BUCKETS, WIDTH, scale=0.2), "head": draw(BUCKETS, WIDTH, scale=0.1)}
        self.p["word"][0] = 0
        for d in "fb":
            self.p |= {f"in_{d}": draw(WIDTH, 3 * h, scale=0.35), f"at_{d}": np.zeros(3 * h, np.float32), f"re_{d}": draw(h, 3 * h, scale=0.35)}
        self.p |= {"key": draw(2 * h, h, scale=0.35), "query": draw(h, scale=0.5), "out": draw(2 * h, scale=0.5), "bias": np.array([-1.0], np.float32)}

    def inputs(self, words: list[bytes], drop: np.random.Generator | None = None) -> tuple[np.ndarray, tuple]:
        """Vectors of distinct words, and what they were made of. drop: leaves out half of the words' own vectors."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words])
        if drop is not None:
            ids = np.where(drop.random(len(ids)) < 0.5, 0, ids)
        grams, counts, heads = characters(words)
        mean = np.add.reduceat(self.p["char"][grams], np.cumsum(counts) - counts, axis=0) / counts[:, None]
        return (self.p["word"][ids] + mean + self.p["head"][heads].mean(1)).astype(np.float32), (ids, grams, counts, heads)

    def gates(self, vectors: np.ndarray) -> np.ndarray:
        """What the words add to the gates, forward and backward side by side."""
        return np.concatenate([vectors @ self.p["in_f"] + self.p["at_f"], vectors @ self.p["in_b"] + self.p["at_b"]], axis=1)

    def chain(self, g: np.ndarray, live: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (windows, WINDOW, HIDDEN) of one direction; positions that aren't live hand the state on."""
        h, u = HIDDEN, self.p[f"re_{d}"]
        state, out = np.zeros((len(g), h), np.float32), np.zeros((len(g), g.shape[1], h), np.float32)
        for t in range(g.shape[1]) if d == "f" else range(g.shape[1] - 1, -1, -1):
            zr = sigmoid(g[:, t, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, t, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, c))
            state = state + live[:, t, None] * z * (c - state)
            out[:, t] = state
        return out

    def forward(self, g: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window. g: (windows, WINDOW, 6 * HIDDEN)."""
        steps = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        s = np.concatenate([self.chain(g[:, :, : 3 * HIDDEN], live, "f", steps["f"]), self.chain(g[:, :, 3 * HIDDEN :], live, "b", steps["b"])], axis=2)
        k = np.tanh(s @ self.p["key"])
        e = np.where(live > 0, k @ self.p["query"], -30)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * s).sum(1)
        if keep is not None:
            keep |= {"steps": steps, "s": s, "k": k, "a": a, "pooled": pooled, "live": live}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, d_logit: np.ndarray, keep: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by parameter (without the word inputs), and of g."""
        s, k, a, live, h = keep["s"], keep["k"], keep["a"], keep["live"], HIDDEN
        grads = {"out": d_logit @ keep["pooled"], "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_a = (s * d_pooled[:, None, :]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d_e = np.where(live > 0, d_e, 0)
        grads["query"] = np.einsum("nt,nth->h", d_e, k)
        d_k = d_e[:, :, None] * self.p["query"] * (1 - k * k)
        grads["key"] = np.einsum("nts,nth->sh", s, d_k)
        d_s = a[:, :, None] * d_pooled[:, None, :] + d_k @ self.p["key"].T
        d_g = np.zeros((*s.shape[:2], 6 * h), np.float32)
        for d, lo, at in (("f", 0, 0), ("b", h, 3 * h)):
            u = self.p[f"re_{d}"]
            g_u, carry = np.zeros_like(u), np.zeros((len(s), h), np.float32)
            for t, before, z, r, c in reversed(keep["steps"][d]):
                d_new = carry + d_s[:, t, lo : lo + h]
                m = live[:, t, None]
                d_c = d_new * m * z * (1 - c * c)
                d_z = d_new * m * (c - before) * z * (1 - z)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * before * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                g_u[:, : 2 * h] += before.T @ d_zr
                g_u[:, 2 * h :] += (r * before).T @ d_c
                carry = d_new * (1 - m * z) + d_rs * r + d_zr @ u[:, : 2 * h].T
                d_g[:, t, at : at + 2 * h], d_g[:, t, at + 2 * h : at + 3 * h] = d_zr, d_c
            grads[f"re_{d}"] = g_u
        return grads, d_g


def layout(docs: list[np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places (windows, WINDOW) into the joined documents, which of them are live, and each window's document."""
    starts, owners, offset, ends = [], [], 0, []
    for k, d in enumerate(docs):
        w = windows(len(d), stride)
        starts.append(w + offset)
        owners.append(np.full(len(w), k))
        offset += len(d)
        ends.append(np.full(len(w), offset))
    place = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    live = place < np.concatenate(ends)[:, None]
    return np.where(live, place, 0), live.astype(np.float32), np.concatenate(owners)


def evidence(common: list[bytes], seen: dict[bytes, int], split: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """For each common word, how far its log odds ratio lies beyond two standard errors, up to four more; with its sign."""
    n_pos, n_neg = float((y == 1).sum()), float((y == 0).sum())
    held: dict[bytes, int] = {}
    for words, t in zip(split, y):
        for w in set(words) if t == 1 else ():
            held[w] = held.get(w, 0) + 1
    a = np.array([held.get(w, 0) for w in common], np.float64)
    b = np.array([seen[w] for w in common], np.float64) - a
    four = [a + 0.5, b + 0.5, n_pos - a + 0.5, n_neg - b + 0.5]
    z = (np.log(four[0] / four[2]) - np.log(four[1] / four[3])) / np.sqrt(sum(1 / x for x in four))
    return (np.clip(np.abs(z) - 2, 0, 4) * np.sign(z)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, steps: int | None = None, rate: float = 0.02, decay: float = 2e-3, batch: int = 32) -> Network | float:
    """A network, or the smoothed share of the class where only one occurs."""
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    split = [words_of(t) for t in texts]
    seen: dict[bytes, int] = {}
    for ws in split:
        for w in set(ws):
            seen[w] = seen.get(w, 0) + 1
    common = sorted((w for w in seen if seen[w] >= LEAST), key=lambda w: (-seen[w], w))[:WORDS]
    net, rng = Network({w: k + 1 for k, w in enumerate(common)}), np.random.default_rng(11)
    enough = min(1.0, len(y) / ENOUGH)
    steps = steps or min(160, max(80, 8 * len(y) // batch))  # eight times through the sample, within bounds
    net.p["word"] *= 0.1
    net.p["word"][1:, 0] += 0.6 * evidence(common, seen, split, y)
    for name in ("char", "head"):
        net.p[name] *= 0.1 + 0.2 * np.float32(enough)
    slower = dict.fromkeys(("word", "char", "head"), max(0.1, enough))
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    half, order = batch // 2, {True: np.zeros(0, int), False: np.zeros(0, int)}
    for step in range(1, steps + 1):
        # Each batch has as many of either class, each in a fresh order whenever it has been used up; the prior is put back below.
        for side, rows in ((True, pos), (False, neg)):
            while len(order[side]) < half:
                order[side] = np.concatenate([order[side], rng.permutation(rows)])
        rows = np.concatenate([order[True][:half], order[False][:half]])
        order = {side: o[half:] for side, o in order.items()}
        distinct: dict[bytes, int] = {}
        docs = [np.array([distinct.setdefault(w, len(distinct)) for w in (split[i] or [b""])]) for i in rows]
        vectors, (ids, grams, counts, heads) = net.inputs(list(distinct), rng)
        place, live, owner = layout(docs, WINDOW)
        words = np.concatenate(docs)[place]
        keep: dict = {}
        logit = net.forward(net.gates(vectors)[words], live, keep)
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, owner, logit)
        share = np.exp(2 * (logit - top[owner]))
        share /= np.bincount(owner, share)[owner]
        doc = np.bincount(owner, share * logit)
        d_doc = (sigmoid(doc) - y[rows]) / len(rows)
        d_logit = (d_doc[owner] * share * (1 + 2 * (logit - doc[owner]))).astype(np.float32)
        grads, d_g = net.backward(d_logit, keep)
        d_gate = np.zeros((len(vectors), 6 * HIDDEN), np.float32)
        np.add.at(d_gate, words[live > 0], d_g[live > 0])
        d_vec = np.zeros_like(vectors)
        for d, at in (("f", 0), ("b", 3 * HIDDEN)):
            part = d_gate[:, at : at + 3 * HIDDEN]
            grads |= {f"in_{d}": vectors.T @ part, f"at_{d}": part.sum(0)}
            d_vec += part @ net.p[f"in_{d}"].T
        grads["word"] = np.zeros_like(net.p["word"])
        np.add.at(grads["word"], ids, d_vec)
        grads["word"][0] = 0
        grads["char"] = np.zeros_like(net.p["char"])
        np.add.at(grads["char"], grams, np.repeat(d_vec / counts[:, None], counts, axis=0))
        grads["head"] = np.zeros_like(net.p["head"])
        np.add.at(grads["head"], heads, np.repeat(d_vec[:, None] / len(HEADS), len(HEADS), axis=1))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for name, g in grads.items():
            g = g * min(1, 5 / (norm + 1e-9))
            moment[name] = 0.9 * moment[name] + 0.1 * g
            square[name] = 0.99 * square[name] + 0.01 * g * g
            now = rate * (1 - (step - 1) / steps) * slower.get(name, 1.0)
            net.p[name] = (net.p[name] * (1 - now * decay * (name in ("word", "char", "head"))) - now * (moment[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    net.p["bias"] = net.p["bias"] - np.float32(np.log(max(1.0, len(neg) / len(pos))) * 0.5)
    return net


class Scorer:
    """Scores texts with a network; remembers the gate inputs of words."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.rows, self.used = np.zeros((REMEMBERED, 6 * HIDDEN), np.float32), 0

    def gates(self, docs: list[list[bytes]]) -> np.ndarray:
        """Rows of self.rows for all words of docs in a row."""
        new = {w for d in docs for w in d if w not in self.known}
        if self.used + len(new) > len(self.rows):
            self.known, self.used = {}, 0
            new = {w for d in docs for w in d}
            if len(new) > len(self.rows):
                self.rows = np.zeros((len(new), 6 * HIDDEN), np.float32)
        if new:
            words = list(new)
            self.rows[self.used : self.used + len(words)] = self.net.gates(self.net.inputs(words)[0])
            self.known.update(zip(words, range(self.used, self.used + len(words))))
            self.used += len(words)
        known = self.known
        return np.array([known[w] for d in docs for w in d], np.int32)

    def part(self, docs: list[list[bytes]]) -> np.ndarray:
        ids = self.gates(docs)
        place, live, owner = layout([np.empty(len(d), np.int8) for d in docs])
        best = np.full(len(docs), -np.inf, np.float32)
        for k in range(0, len(place), AT_ONCE):
            logit = self.net.forward(self.rows[ids[place[k : k + AT_ONCE]]], live[k : k + AT_ONCE])
            np.maximum.at(best, owner[k : k + AT_ONCE], logit)
        return sigmoid(best.astype(np.float64))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, docs, size = [], [], 0
        for t in texts:
            docs.append(words_of(t) or [b""])
            size += len(docs[-1])
            if size > 60_000:
                out.append(self.part(docs))
                docs, size = [], 0
        if docs:
            out.append(self.part(docs))
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 6000) -> Network | float:
    """Fits on at most `sample` labelled documents that aren't held out: all classes by hash of the id."""
    got = sampled(docs, labels, label_col, sample).orderBy("doc_id", "text").toPandas()
    return fit(list(got["text"]), got["_y"].to_numpy(np.float32))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    net = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size: vocabulary and tables are bounded
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if isinstance(shared.value, float) else Scorer(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = scorer.score(texts) if scorer else np.full(len(texts), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
