"""The language network against plain loops, its gradient against differences, and what counts as a letter."""

import numpy as np
import pytest

from meshloom.llm import bytecnn


def naive_probabilities(net, window):
    """One window: every filter at every place, in plain loops."""
    span, filters, hidden = max(bytecnn.WIDTHS), bytecnn.FILTERS, []
    conv = net.p["conv"].reshape(span, bytecnn.DIM, -1)
    for f in range(filters * len(bytecnn.WIDTHS)):
        width, best = bytecnn.WIDTHS[f // filters], -np.inf
        for at in range(bytecnn.WINDOW - span + 1):
            best = max(best, sum(float(net.p["emb"][window[at + i], d]) * float(conv[i, d, f]) for i in range(width) for d in range(bytecnn.DIM)))
        hidden.append(max(best + float(net.p["bias"][f]), 0.0))
    z = np.array(hidden) @ net.p["out"].astype(float) + net.p["off"]
    e = np.exp(z - z.max())
    return e / e.sum()


def test_probabilities_by_loops():
    net = bytecnn.Net(["a", "b", "c"], seed=4)
    windows = np.random.default_rng(1).integers(0, 256, (2, bytecnn.WINDOW)).astype(np.uint8)
    assert np.allclose(net.probabilities(windows), [naive_probabilities(net, w) for w in windows], atol=1e-4)


def test_a_step_goes_down_the_gradient():
    """Adam's first step moves each weight by the rate against the sign of its gradient, which differences of the loss give."""
    r = np.random.default_rng(2)
    windows, y = r.integers(0, 256, (16, bytecnn.WINDOW)).astype(np.uint8), r.integers(0, 3, 16)
    net = bytecnn.Net(["a", "b", "c"], seed=5)
    before = {k: v.copy() for k, v in net.p.items()}
    net.train(windows, y, epochs=1, rate=1e-3)
    moved = {k: net.p[k] - before[k] for k in before}

    def loss(name, at, by):
        net.p = {k: v.astype(np.float64) for k, v in before.items()}
        net.p[name][at] += by
        return -np.log(net.probabilities(windows)[np.arange(16), y]).mean()

    checked = 0
    for name in ("out", "off", "bias", "conv", "emb"):
        for flat in np.argsort(-np.abs(moved[name]).ravel())[:200:20]:
            at = np.unravel_index(flat, moved[name].shape)
            slope = (loss(name, at, 1e-4) - loss(name, at, -1e-4)) / 2e-4
            if abs(slope) > 1e-4:
                assert np.sign(slope) == -np.sign(moved[name][at]), (name, at)
                checked += 1
    assert checked > 20


@pytest.mark.parametrize(("text", "has"), [("½ ² ³", False), ("ⅷ ٣ 12", False), ("_ - 🙂", False), ("", False), ("½a", True), ("日", True), ("ª", True)])
def test_numerals_are_no_letters(spark, text, has):
    d = spark.createDataFrame([(0, text, "en"), (3, "plain english words", "en"), (5, "mots ordinaires", "fr")], "doc_id long, text string, lang string")
    assert bool(bytecnn.LETTER.search(text)) == has
    got = {r.id: r for r in bytecnn.predict(d, bytecnn.Net(["en", "fr"])).collect()}
    assert (got[0].lang_pred == "und") == (not has) and (got[0].score == 0) == (not has)
