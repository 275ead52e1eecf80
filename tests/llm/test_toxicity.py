"""The network against finite differences and a plain reading of its formulas."""

import numpy as np

from lexiloom.llm import toxicity as T


def small():
    net = T.Network({b"vile": 1, b"calm": 2}, seed=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_gradients_agree_with_finite_differences():
    net, rng = small(), np.random.default_rng(0)
    g = rng.standard_normal((3, 5, 6 * T.HIDDEN))
    live = np.ones((3, 5), np.float32)
    live[1, 3:] = 0
    out = rng.standard_normal(3)
    keep = {}
    net.forward(g, live, keep)
    grads, d_g = net.backward(out, keep)
    step = 1e-3

    def change(array, at):
        old = array[at]
        values = []
        for d in (step, -step):
            array[at] = old + d
            values.append(float(out @ net.forward(g, live)))
        array[at] = old
        return (values[0] - values[1]) / (2 * step)

    for name in ("re_f", "re_b", "key", "query", "out", "bias"):
        for k in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            assert abs(change(net.p[name], at) - grads[name][at]) < 2e-2 * max(1, abs(grads[name][at])), name
    for k in range(12):
        at = (k % 3, int(rng.integers(0, 5 if k % 3 != 1 else 3)), int(rng.integers(0, 6 * T.HIDDEN)))
        assert abs(change(g, at) - d_g[at]) < 2e-2 * max(1, abs(d_g[at]))


def plain(net, words):
    """One window, word by word."""
    h, sig = T.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    x = [net.inputs([w])[0][0].astype(np.float64) for w in words]
    states = {}
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        s, out, u = np.zeros(h), [None] * len(x), net.p[f"re_{d}"]
        for t in order:
            a = x[t] @ net.p[f"in_{d}"] + net.p[f"at_{d}"]
            z, r = sig(a[:h] + s @ u[:, :h]), sig(a[h : 2 * h] + s @ u[:, h : 2 * h])
            c = np.tanh(a[2 * h :] + (r * s) @ u[:, 2 * h :])
            s = s + z * (c - s)
            out[t] = s
        states[d] = out
    both = np.array([np.concatenate(p) for p in zip(states["f"], states["b"])])
    e = np.tanh(both @ net.p["key"]) @ net.p["query"]
    a = np.exp(e - e.max())
    return float(sig((a / a.sum()) @ both @ net.p["out"] + net.p["bias"][0]))


def test_scores_are_the_worst_window_of_each_text():
    net = T.Network({b"vile": 1, b"calm": 2}, seed=3)
    texts = ["calm words", "", None, " ".join(f"w{k % 17}" for k in range(61)) + " vile", "one " * 24, "x" * 5000]
    got = T.Scorer(net).score(texts)
    for text, score in zip(texts, got):
        words = T.words_of(text) or [b""]
        last = max(0, len(words) - T.WINDOW)
        starts = sorted({*range(0, last, T.STRIDE), last})
        assert abs(score - max(plain(net, words[s : s + T.WINDOW]) for s in starts)) < 1e-4


def test_a_few_hundred_labels_teach():
    rng = np.random.default_rng(4)
    known = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    bad = ["idiot", "moron", "clown", "worthless", "stupid"]
    texts, y = [], []
    for d in range(400):
        words = list(rng.choice(known, 60))
        if d % 7 == 0:
            for _ in range(2):
                words[int(rng.integers(0, 60))] = str(rng.choice(bad))
        texts.append(" ".join(words))
        y.append(d % 7 == 0)
    y = np.array(y, np.float32)
    net = T.fit(texts[:300], y[:300])
    score = T.Scorer(net).score(texts[300:])
    right = [(a > b) for a in score[y[300:] == 1] for b in score[y[300:] == 0]]
    assert np.mean(right) > 0.9
