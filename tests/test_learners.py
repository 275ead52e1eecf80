"""Learners look only at examples that may change the weights, and learn what they learn by looking at all."""

import numpy as np
import pytest

from lexiloom.operators import learners


class Counted(list):
    """Examples that count how often one is looked at."""

    seen = 0

    def __getitem__(self, k):
        self.seen += 1
        return super().__getitem__(k)

    def __iter__(self):
        return (self[k] for k in range(len(self)))


def examples(n: int = 150, dimension: int = 60, classes: str = "abc") -> Counted:
    rng = np.random.default_rng(3)
    out = Counted()
    for k in range(n):
        label = classes[k % len(classes)]
        idx = np.unique(np.concatenate([rng.integers(0, dimension, 12), [ord(label) % len(classes)]]))
        out.append(((idx, rng.random(len(idx)) + 3 * (idx == ord(label) % len(classes))), label))
    return out


def plain(method: str, given: list, classes: list[str], dimension: int, iterations: int, slack: float = 0.01) -> np.ndarray:
    """Every example in every round, with whole rows of weights."""
    w = total = np.zeros((len(classes), dimension))
    step, steps = 0, iterations * len(given)
    for _ in range(iterations):
        for (idx, val), label in list(given):
            truth, x = classes.index(label), np.zeros(dimension)
            x[idx] = val
            scores, change = w @ x, np.zeros(len(classes))
            if method == "mira":
                order = np.argsort(-scores, kind="stable")[:4]
                other = order[order != truth]
                alpha = learners.hildreth(1.0 - (scores[truth] - scores[other]), (x @ x) * (1 + np.eye(len(other))), slack)
                change[other], change[truth] = -alpha, alpha.sum()
            elif int(np.argmax(scores)) != truth:
                change[:] = -1.0 / (len(classes) - 1)
                change[truth] = 1.0
            w = w + np.outer(change, x)
            total = total + np.outer(change, x) * (steps - step)
            step += 1
    return total / steps


@pytest.mark.parametrize("method", ["mira", "perceptron"])
def test_examples_left_out_change_nothing(method):
    """The same weights from fewer looks."""
    given, classes = examples(), list("abc")
    got = learners.learn(method, given, classes, 60, iterations=40)
    assert np.allclose(got.weights, plain(method, given, classes, 60, 40), atol=1e-9) and np.abs(got.weights).sum() > 0
    given.seen = 0
    learners.learn(method, given, classes, 60, iterations=40)
    assert 0 < given.seen < 20 * len(given)


def test_scores_that_are_no_numbers_are_looked_at():
    settled = learners.Settled(3, 1.0, (4, 2))
    settled.saw(1, np.array([np.nan, 0.0]), 0, 1.0)
    settled.saw(2, np.array([5.0, 0.0]), 0, 1.0)
    assert list(settled.waiting()) == [0, 1]
    idx, val, change = np.array([1]), np.array([2.0]), np.array([1.0, -1.0])
    settled.moved(0, idx, val, val[:, None] * change, change, 2.0)
    assert list(settled.waiting()) == [0, 1, 2]


def test_dimension_is_the_scale(monkeypatch):
    """Storing examples doesn't unpack them."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([1]), pa.array([learners.squeezed(np.array([1, 4]), np.array([1, 2]))])], ["label", "doc_id", "example"])
    monkeypatch.setattr(learners, "loosened", None)
    assert learners.Stored(iter([batch]), np.ones(9)).dimension == 9
