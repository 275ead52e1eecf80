"""Quality classifier: a sparse rule ensemble that is scored as one Spark column expression.

1. Statistics of the whole text are Spark column expressions.
2. Boosted shallow trees are grown in numpy on a bounded sample of labelled rows (`sample`, a parameter); every path
   from a root to a node is a rule, a conjunction of thresholds on statistics.
3. Logistic regression with an L1 penalty (FISTA) weighs the rules, most weights becoming zero.
4. The remaining rules are compiled into a Spark column: scoring is JVM code in the scan's own stage, no shuffle.

The sample is the labelled rows that come first by hash of the id; only their texts are measured for fitting.

Nulls: a null text counts as empty and is scored; rows without a label or id don't take part in fitting. Repeated
ids stay rows of their own. Without any usable label the score is 0.5 everywhere; with labels of one class
it is that class's smoothed share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out

SYMBOLS = "!#$%&*+<=>@[]^_{|}~\\"
ACCENTS = "àâäçèéêëîïñóôöùûüáíúßÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜÁÍÚ"


def statistics(text: Column) -> dict[str, Column]:
    """Name -> double column, each over the whole text. Ratios of an empty text are 0."""
    n = F.length(text)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(text, chars, ""))) / F.greatest(n, F.lit(1))

    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.greatest(n - F.length(F.replace(flat, F.lit(" "))), F.lit(0)) + 1.0
    lines = F.split(text, "\n", -1)
    made = {
        "chars": F.log1p(n),
        "word_chars": n / words,
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "lower": share("abcdefghijklmnopqrstuvwxyz"),
        "digit": share("0123456789"),
        "comma": share(",;:"),
        "stop": share(".?"),
        "bang": share("!"),
        "symbol": share(SYMBOLS),
        "bar": share("|"),
        "quote": share("\"'()"),
        "accent": share(ACCENTS),
        "space": share(" \t\n\r\x0b\x0c"),
        "line_chars": n / F.size(lines),
        "line_repeats": F.size(lines) / F.size(F.array_distinct(lines)) - 1.0,
        "bytes": F.octet_length(text) / F.greatest(n, F.lit(1)),
    }
    return {name: made[name].cast("double") for name in NAMES}


NAMES = ["chars", "word_chars", "upper", "lower", "digit", "comma", "stop", "bang", "symbol", "bar", "quote", "accent", "space", "line_chars", "line_repeats", "bytes"]


@dataclass(frozen=True)
class Rule:
    """All of (statistic, at most?, threshold) hold."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, low, cut in self.terms:
            out &= (x[:, j] <= cut) if low else (x[:, j] > cut)
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))))

    def column(self, stats: list[Column]) -> Column:
        """The score as one expression of the statistics. They are bound to a lambda's variable, so that each is computed once
        for a row wherever the optimizer moves the score: a filter on it would else repeat them in every rule's terms."""

        def of(s: Column) -> Column:
            total = F.lit(self.bias)
            for r in self.rules:
                all_hold = None
                for j, low, cut in r.terms:
                    term = (s[j] <= F.lit(cut)) if low else (s[j] > F.lit(cut))
                    all_hold = term if all_hold is None else all_hold & term
                total = total + F.when(all_hold, F.lit(r.weight)).otherwise(F.lit(0.0))
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

        return F.element_at(F.transform(F.array(F.array(*stats)), of), 1)


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray, terms: tuple, rules: list, least: int = 8) -> np.ndarray:
    """One regression tree on gradients g and curvatures h; appends the rule of every node; returns the steps of rows."""
    step = np.zeros(len(x))
    step[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if terms:
        rules.append(terms)
    if depth == 0 or len(rows) < 2 * least:
        return step
    best, gr, hr = (1e-3, -1, 0.0), g[rows], h[rows]
    whole = gr.sum() ** 2 / (hr.sum() + 1.0)
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        at = np.searchsorted(cut, x[rows, j], side="left")  # bin b holds cut[b-1] < value <= cut[b]
        n, gs, hs = (np.cumsum(np.bincount(at, w, len(cut) + 1))[:-1] for w in (None, gr, hr))
        gain = gs**2 / (hs + 1.0) + (gr.sum() - gs) ** 2 / (hr.sum() - hs + 1.0) - whole
        gain[(n < least) | (len(rows) - n < least)] = -1
        if gain[k := int(gain.argmax())] > best[0]:
            best = (gain[k], j, float(cut[k]))
    if best[1] < 0:
        return step
    _, j, cut = best
    low = x[rows, j] <= cut
    for side, part in ((True, rows[low]), (False, rows[~low])):
        child = grow(x, g, h, cuts, depth - 1, part, (*terms, (j, side, cut)), rules, least)
        step[part] = child[part]
    return step


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, rounds: int = 600) -> Ensemble:
    """Rules from boosted trees, weighed by L1-penalised logistic regression; classes weigh as they occur."""
    if not len(y):
        return Ensemble(0.0, ())
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Ensemble(bias, ())
    rng, f, found = np.random.default_rng(7), np.full(len(y), bias), []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49))) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        part = np.sort(rng.choice(len(y), max(1, int(0.7 * len(y))), replace=False))
        step = grow(x, y - p, p * (1 - p), cuts, depth, part, (), found)
        f += 0.3 * np.where(np.isin(np.arange(len(y)), part), step, 0)
    rules = [Rule(t) for t in dict.fromkeys(tuple(sorted(set(t))) for t in found)]
    columns = np.array([r.holds(x) for r in rules], np.float64)
    seen: dict[bytes, int] = {}
    for k, c in enumerate(columns):  # rules that hold for the same rows are one
        if 0 < c.sum() < len(y):
            seen.setdefault(np.packbits(c.astype(bool)).tobytes(), k)
    keep = list(seen.values())
    if not keep:
        return Ensemble(bias, ())
    rules, a = [rules[k] for k in keep], columns[keep].T
    middle = a.mean(0)
    a -= middle
    u = rng.standard_normal(a.shape[1])
    for _ in range(30):
        u = a.T @ (a @ u)
        u /= np.linalg.norm(u) + 1e-12
    size = 4 * len(y) / (1.1 * float(u @ (a.T @ (a @ u))) + 1e-9)
    w = z = np.zeros(a.shape[1])
    b, t = bias, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ z + b))) - y
        new = z - size * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        b -= 4 * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(float(b - w @ middle), tuple(Rule(rules[k].terms, float(w[k])) for k in used))


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `sample` labelled documents that aren't held out: id, text, y. The ids are broadcast: sample bounds them. Of rows with one
    id the one with the least text stands for all, so that sample bounds the rows too."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    first = usable.groupBy(id_col).agg(F.max(label_col).cast("double").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(F.broadcast(first), id_col)
    return rows.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.first("_y").alias("_y"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    rows = sampled(docs, labels, label_col, sample, id_col, text_col)
    stats = statistics(F.col(text_col))
    got = rows.select(id_col, *[c.alias(n) for n, c in stats.items()], "_y").orderBy(id_col).toPandas()
    return fit(got[list(stats)].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with the score column; every other column stays."""
    stats = statistics(F.coalesce(F.col(text_col), F.lit("")))
    return docs.withColumn(out_col, ensemble.column([stats[n] for n in NAMES]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs, train(docs, labels, **options))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
