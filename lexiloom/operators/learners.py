"""Online linear learners in numpy, each one sequential task; many models train side by side.

An online learner depends on the order of its examples, so one model is one task; what Spark spreads is models: grid
points, folds, label sets, and the pairs of classes of an SVM. `train_many` writes the examples once, squeezed, and each task takes one example after
another from those files: what it holds in memory are weights, and some 60 bytes an example. `Settled` says which examples a round may leave out.
`max_examples` refuses larger sets instead of sampling them.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import scratch, settled

Example = tuple[np.ndarray, np.ndarray]  # indices and values


@dataclass
class Linear:
    """Weights (classes, dimension), classes by name. A regression has one class, "value"."""

    classes: list[str]
    weights: np.ndarray
    updates: int = 0
    extra: dict = field(default_factory=dict)

    def scores(self, x: Example) -> np.ndarray:
        return self.weights[:, x[0]] @ x[1]

    def ranked(self, x: Example) -> list[tuple[float, str]]:
        s = self.scores(x)
        return [(float(s[k]), self.classes[k]) for k in np.argsort(-s, kind="stable")]

    def best(self, x: Example) -> str:
        return self.ranked(x)[0][1]


def hildreth(b: np.ndarray, gram: np.ndarray, c: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """argmax of b.a - a.G.a / 2 with 0 <= a <= c, by coordinate ascent."""
    a = np.zeros(len(b))
    for _ in range(rounds):
        worst = 0.0
        for k in range(len(b)):
            if gram[k, k] <= 0:
                continue
            new = min(c, max(0.0, a[k] + (b[k] - gram[k] @ a) / gram[k, k]))
            worst, a[k] = max(worst, abs(new - a[k])), new
        if worst < tolerance:
            break
    return a


class Settled:
    """Which examples can't change the weights, without a look at them.

    An example's margin falls, at most, by its norm times the distance that the difference of two classes' weights has moved since it was last seen.
    That distance is bounded twice: by the sum of all updates' lengths (`path`), and by how far the weights are from where they were when the round began
    (`reach`, of the two classes that moved most), now and when the example was seen. While the margin stays above `need` by one of the bounds, the
    example's turn would leave the weights alone.
    """

    #: Far above the rounding of a score.
    SURE = 1e-6

    def __init__(self, n: int, need: float, shape: tuple[int, int]):
        self.need, self.path, self.reach = need, 0.0, 0.0
        self.until, self.within = np.full(n, -np.inf), np.full(n, -np.inf)
        self.shift, self.squares = np.zeros(shape), np.zeros(shape[1])

    def saw(self, s: int, scores: np.ndarray, truth: int, norm: float) -> None:
        margin = float(scores[truth]) - max(map(float, (*scores[:truth], *scores[truth + 1 :])), default=-np.inf)
        spare = (margin - self.need - self.SURE) / norm if norm else np.inf if margin >= self.need + self.SURE else -np.inf
        self.until[s], self.within[s] = self.path + spare, spare - self.reach

    def moved(self, s: int, idx: np.ndarray, val: np.ndarray, step: np.ndarray, change: np.ndarray, norm: float) -> None:
        """The example changed the weights by `step`, itself times `change`, class by class."""
        self.path += float(change.max() - change.min()) * norm
        self.squares += 2 * change * (val @ self.shift[idx]) + (change * norm) ** 2
        self.shift[idx] += step
        self.reach = float(np.sqrt(np.maximum(np.sort(self.squares)[-2:], 0)).sum()) * (1 + self.SURE)
        self.until[s] = self.within[s] = -np.inf

    def waiting(self) -> Iterator[int]:
        """The places of a round that must be looked at, each decided on when its turn comes."""
        self.within -= self.reach
        self.shift[:], self.squares[:], self.reach = 0, 0, 0.0
        for begin in range(0, len(self.until), 1 << 12):
            end = min(begin + (1 << 12), len(self.until))
            if self.until[begin:end].min() > self.path:  # false for a score that is no number, too
                continue
            for s in range(begin, end):
                if not (self.until[s] > self.path or self.within[s] > self.reach):
                    yield s


def mira(examples: Sequence[tuple[Example, str]], classes: list[str], dimension: int, iterations: int = 20, k_best: int = 4, slack: float = 0.01, average: bool = True) -> Linear:
    """k-best MIRA: the least change that ranks the truth above the k best classes by their loss, box slack.

    Weights are (dimension, classes) while they are learnt, so a feature's lie side by side.
    """
    w, total = np.zeros((dimension, len(classes))), np.zeros((dimension, len(classes)))
    at = {c: k for k, c in enumerate(classes)}
    n, updates = len(examples), 0
    settled = Settled(n, 1.0, w.shape)
    for i in range(iterations):
        before = updates
        for s in settled.waiting():
            (idx, val), label = examples[s]
            left = iterations * n - (n * i + s + 1) + 1  # how many of the averaged weights this step is part of
            truth, scores, squares = at[label], val @ w[idx], float(val @ val)
            settled.saw(s, scores, truth, squares**0.5)
            best = np.argsort(-scores, kind="stable")[: min(k_best, len(classes))]
            other = best[best != truth]
            b = 1.0 - (scores[truth] - scores[other])
            if not len(other) or b.max() <= 0:
                continue
            alpha = hildreth(b, squares * (1 + np.eye(len(other))), slack)
            if alpha.any():
                updates += int(np.count_nonzero(alpha))
                change = np.zeros(len(classes))
                change[other], change[truth] = -alpha, alpha.sum()
                step = val[:, None] * change
                w[idx] += step
                total[idx] += step * left
                settled.moved(s, idx, val, step, change, squares**0.5)
        if updates == before:  # the weights stand, so all rounds to come would leave them alone, too
            break
    return Linear(classes, averaged(total, iterations * n).T if average and n else w.T, updates)


def averaged(total: np.ndarray, n: int) -> np.ndarray:
    total /= n
    return total


def perceptron(examples: Sequence[tuple[Example, str]], classes: list[str], dimension: int, iterations: int = 20, average: bool = True) -> Linear:
    """On a mistake the truth gains the example, and every other class loses an equal part of it."""
    w, total = np.zeros((dimension, len(classes))), np.zeros((dimension, len(classes)))
    at = {c: k for k, c in enumerate(classes)}
    n, updates = len(examples), 0
    settled = Settled(n, 0.0, w.shape)
    for i in range(iterations):
        before = updates
        for s in settled.waiting():
            (idx, val), label = examples[s]
            left = iterations * n - (n * i + s + 1) + 1
            truth, scores, norm = at[label], val @ w[idx], float(val @ val) ** 0.5
            settled.saw(s, scores, truth, norm)
            if int(np.argmax(scores)) != truth:
                updates += 1
                change = np.full(len(classes), -1.0 / max(1, len(classes) - 1))
                change[truth] = 1.0
                step = val[:, None] * change
                w[idx] += step
                total[idx] += step * left
                settled.moved(s, idx, val, step, change, norm)
        if updates == before:
            break
    return Linear(classes, averaged(total, iterations * n).T if average and n else w.T, updates)


def passive_aggressive(examples: list[tuple[Example, float]], dimension: int, iterations: int = 20, slack: float = 0.01, average: bool = True) -> Linear:
    """Regression: the least change, at most slack, that fits each value."""
    w, total, n, updates = np.zeros(dimension), np.zeros(dimension), len(examples), 0
    for i in range(iterations):
        for s, ((idx, val), y) in enumerate(examples):
            left = iterations * n - (n * i + s + 1) + 1
            norm, miss = float(val @ val), float(y) - float(w[idx] @ val)
            alpha = np.sign(miss) * max(0.0, min(slack, abs(miss) / norm)) if norm else 0.0
            if alpha:
                updates += 1
                w[idx] += alpha * val
                total[idx] += alpha * val * left
    return Linear(["value"], (total / (iterations * n) if average and n else w)[None], updates)


def dual_svm(examples: list[tuple[Example, float]], dimension: int, c: float = 1.0, tolerance: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a two-class linear SVM (labels +1 and -1, hinge loss), by dual coordinate descent."""
    w, bias, alpha = np.zeros(dimension), 0.0, np.zeros(len(examples))
    diagonal = np.array([float(x[1] @ x[1]) + 1.0 for x, _ in examples])
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        widest = 0.0
        for k in rng.permutation(len(examples)):
            (idx, val), y = examples[k]
            g = y * (float(w[idx] @ val) + bias) - 1.0
            new = min(c, max(0.0, alpha[k] - g / diagonal[k]))
            if new != alpha[k]:
                widest = max(widest, abs(new - alpha[k]))
                w[idx] += (new - alpha[k]) * y * val
                bias += (new - alpha[k]) * y
                alpha[k] = new
        if widest < tolerance:
            break
    return w, bias


@dataclass
class Pairwise(Linear):
    """A linear SVM for every pair of classes; a class's score is its votes, then its summed margins."""

    pairs: list[tuple[int, int, np.ndarray, float]] = field(default_factory=list)

    def scores(self, x: Example) -> np.ndarray:
        votes = np.zeros(len(self.classes))
        for a, b, w, bias in self.pairs:
            margin = float(w[x[0]] @ x[1]) + bias
            votes[a if margin > 0 else b] += 1
            votes[a] += 1e-3 * np.tanh(margin)
            votes[b] -= 1e-3 * np.tanh(margin)
        return votes


def pairs_of(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(n) for b in range(a + 1, n)]


def svm(examples: list[tuple[Example, str]] | Stored, classes: list[str], dimension: int, c: float = 1.0, only: list[tuple[int, int]] | None = None) -> Pairwise:
    """only: the pairs of classes to train, where others are trained elsewhere."""
    pairs = []
    for a, b in pairs_of(len(classes)) if only is None else only:
        if isinstance(examples, Stored):
            some = examples.part({classes[a]: 1.0, classes[b]: -1.0})
        else:
            some = [(x, 1.0 if y == classes[a] else -1.0) for x, y in examples if y in (classes[a], classes[b])]
        pairs.append((a, b, *dual_svm(some, dimension, c)))
    return Pairwise(classes, np.zeros((len(classes), dimension)), pairs=pairs)


def support_vector_regression(examples: list[tuple[Example, float]], dimension: int, c: float = 1.0, epsilon: float = 0.1, rounds: int = 300) -> Linear:
    """Epsilon-insensitive linear regression by dual coordinate descent; the bias is one more, constant, input."""
    w, beta = np.zeros(dimension + 1), np.zeros(len(examples))
    for _ in range(rounds):
        widest = 0.0
        for k, ((idx, val), y) in enumerate(examples):
            norm = float(val @ val) + 1.0
            g = float(w[idx] @ val) + w[-1] - float(y)
            up, down = beta[k] - (g + epsilon) / norm, beta[k] - (g - epsilon) / norm
            new = min(c, max(-c, up if up > 0 else down if down < 0 else 0.0))
            if new != beta[k]:
                widest = max(widest, abs(new - beta[k]))
                w[idx] += (new - beta[k]) * val
                w[-1] += new - beta[k]
                beta[k] = new
        if widest < 1e-4:
            break
    return Linear(["value"], w[None, :-1], extra={"bias": float(w[-1])})


LEARNERS: dict[str, Callable] = {"mira": mira, "perceptron": perceptron, "svm": svm, "svmopen": svm}


def learn(method: str, examples: list[tuple[Example, str]], classes: list[str], dimension: int, **options) -> Linear:
    if method not in LEARNERS:
        raise ValueError(f"no such learner: {method}; there are {', '.join(LEARNERS)}")
    return LEARNERS[method](examples, classes, dimension, **options)


def no_regression(*_, **__) -> Linear:
    raise ValueError("the perceptron has no regression; take mira or svm")


REGRESSIONS: dict[str, Callable] = {"mira": passive_aggressive, "svm": support_vector_regression, "svmopen": support_vector_regression, "perceptron": no_regression}


def learn_values(method: str, examples: list[tuple[Example, float]], dimension: int, **options) -> Linear:
    if method not in REGRESSIONS:
        raise ValueError(f"no such learner: {method}; there are {', '.join(REGRESSIONS)}")
    return REGRESSIONS[method](examples, dimension, **options)


def packed(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, label, index (ascending), value: one row a document, also where it has no features."""
    entries = vectors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "val"))).alias("e"))
    rows = docs.select("doc_id", "label").join(entries, "doc_id", "left")
    none = F.array().cast("array<struct<idx:int,val:double>>")
    return rows.withColumn("e", F.coalesce("e", none)).select("doc_id", "label", F.transform("e", lambda x: x["idx"]).alias("index"), F.transform("e", lambda x: x["val"]).alias("value"))


def in_order(rows: pd.DataFrame) -> list[tuple[Example, str]]:
    """Examples by label descending, then document."""
    rows = rows.sort_values(["label", "doc_id"], ascending=[False, True])
    return [((np.asarray(i, np.int64), np.asarray(v, float)), y) for i, v, y in zip(rows["index"], rows["value"], rows["label"])]


#: Between the two classes of a pair's name, and the index of the constant input, whose weight is a bias.
PAIR, BIAS = "\x1f", -1


def weight_rows(model: Linear) -> Iterable[tuple[str, np.ndarray, np.ndarray]]:
    """(label, indices, weights). A pairwise model has a "label" for each pair of classes, with its bias at BIAS."""
    if isinstance(model, Pairwise):
        each = [(model.classes[a] + PAIR + model.classes[b], w, bias) for a, b, w, bias in model.pairs]
    else:
        each = [(c, model.weights[k], model.extra.get("bias")) for k, c in enumerate(model.classes)]
    for name, w, bias in each:
        if bias is not None:
            yield name, np.array([BIAS]), np.array([float(bias)])
        j = np.flatnonzero(w)
        yield name, j, w[j]


def squeezed(index: np.ndarray, value: np.ndarray) -> bytes:
    """Ascending indices, with counts (integers) or values, as bytes: gaps and counts by their bytes' significance, compressed."""
    plain = value.dtype.kind == "f"
    gaps = np.diff(index, prepend=0).astype("<u4").view("u1").reshape(-1, 4).T
    rest = value.astype("<f8" if plain else "<u4").view("u1").reshape(-1, 8 if plain else 4).T
    raw = np.concatenate([gaps.ravel(), rest.ravel()]).tobytes()
    return (b"v" if plain else b"c") + len(index).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


ZSTD = pa.Codec("zstd")


def loosened(example: bytes, scale: np.ndarray | None = None) -> Example:
    """What was squeezed. Counts become shares of the example's counts, each times its index's scale."""
    index, value = opened(example)
    return index, value if value.dtype.kind == "f" else value / max(float(value.sum()), 1.0) * scale[index]


def opened(example: bytes) -> Example:
    """Indices, and counts or values."""
    n, wide = int.from_bytes(example[1:5], "little"), 8 if example[:1] == b"v" else 4
    raw = np.frombuffer(ZSTD.decompress(memoryview(example)[5:], n * (4 + wide), asbytes=True), "u1")
    index = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel(), dtype=np.int64)
    return index, np.ascontiguousarray(raw[4 * n :].reshape(wide, n).T).view("<f8" if wide == 8 else "<u4").ravel()


def with_examples(rows: DataFrame) -> DataFrame:
    """Packed rows with their index and value as one column, example."""
    if "example" in rows.columns:
        return rows
    keys = [c for c in rows.columns if c not in ("index", "value")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [squeezed(np.array(i.as_py(), np.int64), np.array(v.as_py(), float)) for i, v in zip(batch.column("index"), batch.column("value"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(made, pa.binary())], [*keys, "example"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", example binary")


def width_of(example: bytes) -> int:
    """The least dimension that has room for the example."""
    return int(opened(example)[0][-1]) + 1 if example[1:5] != bytes(4) else 1


#: Where an example lies, in place of the example.
PLACE = "file string, start bigint, size int, width int"


def laid_out(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with the places of their examples, which the tasks write to files in the folder, in place of the examples. A task that is tried again
    writes a file of its own, and its rows name that."""
    keys = [c for c in rows.columns if c != "example"]
    names = [x.split()[0] for x in PLACE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, end = f"{folder}/{uuid.uuid4().hex}", 0
        with open(path, "xb") as file:
            for batch in batches:
                size, width = [], []
                for x in batch.column("example"):
                    x = x.as_py()
                    size.append(file.write(x))
                    width.append(width_of(x))
                start = end + np.cumsum(size, dtype=np.int64) - size
                end += sum(size)
                file.flush()
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array([path] * len(size), pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(width, pa.int32())], [*keys, *names])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + f", {PLACE}")


class Stored(Sequence):
    """Examples in files, by label descending, then document. In memory are their places. Batches with `example` are written to a file of the task;
    those with places are read where they lie."""

    def __init__(self, batches: Iterator[pa.RecordBatch], scale: np.ndarray | None, value: Callable = str):
        self.files: list = []
        self.scale, self.dimension = scale, 1 if scale is None else max(1, len(scale))
        labels, docs, places, found, end = [], [], [], {}, 0
        for batch in batches:
            labels.append(batch.column("label").to_pandas())
            docs.append(batch.column("doc_id").to_pandas())
            if "file" in batch.schema.names:
                paths = batch.column("file").to_pylist()
                for path in set(paths) - set(found):
                    found[path] = len(self.files)
                    self.files.append(open(path, "rb"))
                width = batch.column("width").to_numpy()
                places.append(np.stack([np.array([found[p] for p in paths], np.int64), *(batch.column(c).to_numpy().astype(np.int64) for c in ("start", "size"))]))
            else:
                if not self.files:
                    self.files.append(tempfile.TemporaryFile(dir=(os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None))
                size = np.array([self.files[0].write(x.as_py()) for x in batch.column("example")], np.int64)
                width = np.array([width_of(x.as_py()) for x in batch.column("example")] if scale is None else [])
                places.append(np.stack([np.zeros(len(size), np.int64), end + np.cumsum(size) - size, size]))
                end += int(size.sum())
            if scale is None:
                self.dimension = max(self.dimension, int(width.max(initial=1)))
        if not found and self.files:
            self.files[0].flush()
        keys = pd.DataFrame({"label": pd.concat(labels).astype("category") if labels else [], "doc_id": pd.concat(docs) if docs else []}).reset_index(drop=True)
        order = keys.sort_values(["label", "doc_id"], ascending=[False, True], kind="stable").index.to_numpy()
        self.which, self.start, self.size = (np.concatenate(places, axis=1) if places else np.zeros((3, 0), np.int64))[:, order]
        self.code, names = pd.factorize(keys["label"].to_numpy(object)[order])
        self.names = list(names)
        self.values = list(map(value, names))

    def part(self, values: dict) -> Stored:
        """The examples of some labels, in the same file, with the labels' values."""
        out = object.__new__(Stored)
        own = np.isin(self.code, [k for k, c in enumerate(self.names) if c in values])
        out.files, out.scale, out.dimension, out.which, out.start, out.size, out.code = self.files, self.scale, self.dimension, self.which[own], self.start[own], self.size[own], self.code[own]
        out.names, out.values = self.names, [values.get(c) for c in self.names]
        return out

    def valued(self, value: Callable) -> Stored:
        """The examples, with what value() makes of their labels."""
        self.values = list(map(value, self.names))
        return self

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, k: int) -> tuple[Example, object]:
        if not 0 <= k < len(self.start):
            raise IndexError(k)
        return loosened(os.pread(self.files[self.which[k]].fileno(), int(self.size[k]), int(self.start[k])), self.scale), self.values[self.code[k]]


#: Examples of one model, which is one task; larger sets are refused, not sampled.
MAX_EXAMPLES = 20_000_000
#: Tasks, and so copies of a set of examples, that its models are spread over.
SLICES = 8
#: Where true, Spark runs a union of single tasks as one task, one after another.
MERGED_UNION = "spark.sql.unionOutputPartitioning"
WEIGHTS = "config_id int, label string, idx int, weight double, updates long"


def train_many(examples: DataFrame, configs: list[dict], by: str = "set_id", max_examples: int = MAX_EXAMPLES, slices: int = SLICES, scale: np.ndarray | None = None) -> DataFrame:
    """config_id, label, idx, weight, updates: a model for each of configs (config_id, set_id, method, regress, options).

    examples: packed rows with the set they belong to, or rows with `example`, whose counts `scale` turns into values. They are written once to the
    shared folder, and are removed when the models are there. A set's models are dealt to a few tasks, an SVM by its pairs of classes, and each task reads
    the examples where they lie (where the shared folder has no paths, it copies those it needs into a file of its own); no example goes through a
    shuffle, and none is in memory but the one that is learnt from.
    """
    folder = scratch(examples.sparkSession)
    try:
        return trained(examples, configs, by, max_examples, slices, scale, folder)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def trained(examples: DataFrame, configs: list[dict], by: str, max_examples: int, slices: int, scale: np.ndarray | None, folder: str | None) -> DataFrame:
    rows = with_examples(examples)
    rows = settled(laid_out(rows, folder) if folder else rows)
    place = [x.split()[0] for x in PLACE.split(", ")] if folder else ["example"]
    sizes = {r[by]: r for r in rows.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("label")).alias("labels")).collect()}
    if any(r.n > max_examples for r in sizes.values()):
        raise ValueError("a model's examples exceed max_examples")
    shared = examples.sparkSession.sparkContext.broadcast(scale)

    def run_of(work: list[tuple[dict, list | None]], classes: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Stored(batches, shared.value)
            for c, only in work:
                if c.get("regress"):
                    model = learn_values(c["method"], found.valued(float), found.dimension, **c["options"])
                else:
                    model = learn(c["method"], found.valued(str), classes, found.dimension, **c["options"], **({} if only is None else {"only": only}))
                for label, idx, weight in weight_rows(model):
                    for k in range(0, len(idx), 1 << 18):
                        part = idx[k : k + (1 << 18)]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, c["config_id"]), pa.int32()), pa.array([label] * n, pa.string()), pa.array(part, pa.int32()), pa.array(weight[k : k + n], pa.float64()), pa.array(np.full(n, model.updates), pa.int64())], WEIGHT_NAMES
                        )

        return run

    tasks = []
    for key, size in sizes.items():
        own = rows.where(F.col(by) == F.lit(key))
        work: list[tuple[dict, list | None]] = []
        for c in (c for c in configs if c["set_id"] == key):
            if c["method"].startswith("svm") and not c.get("regress"):
                work += [(c, [pair]) for pair in pairs_of(len(size.labels))]
            else:
                work.append((c, None))
        few = min(slices, len(work))
        for k in range(few):
            part = work[k::few]
            needed = {size.labels[x] for _, only in part for pair in only or () for x in pair}
            some = own.where(F.col("label").isin(sorted(needed))) if all(only for _, only in part) else own
            tasks.append(some.select("doc_id", "label", *place).coalesce(1).mapInArrow(run_of(part, size.labels), WEIGHTS))
    spark = rows.sparkSession
    before = spark.conf.get(MERGED_UNION, "true")
    spark.conf.set(MERGED_UNION, "false")
    try:
        return settled(reduce(DataFrame.unionAll, tasks)) if tasks else spark.createDataFrame([], WEIGHTS)
    finally:
        spark.conf.set(MERGED_UNION, before)


WEIGHT_NAMES = [x.split()[0] for x in WEIGHTS.split(", ")]
