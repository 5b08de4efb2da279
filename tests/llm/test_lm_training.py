"""Training of op8's attention: every window of all whole learning texts takes part, by the right gradient."""

import numpy as np
import pyarrow as pa

from flowlens.llm import lm


def batch_of(texts, first):
    ids = pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())
    return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(first, first + len(texts)))], ["__ids", "__row"])


def known(u, t):
    """Windows as bytes, without the inputs behind a text's end."""
    u = u.copy()
    u[:, lm.WINDOW - lm.STEP :][t < 0] = 0
    return [a.tobytes() + b.tobytes() for a, b in zip(u, t)]


def test_every_window_is_trained_on_once():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 50_000, n) for n in (1, 23, 24, 25, 900, 40_000, 7)] * 3
    batches = [batch_of(texts[:8], 0), batch_of(texts[8:], 8)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    every = sorted(known(*lm.windows(np.concatenate(texts), at, *lm.places(at))))
    rounds = [list(lm.steps_of(iter(batches), turn)) for turn in range(lm.ROUNDS)]
    assert all(len(u) == lm.STEP_WINDOWS for steps in rounds for u, _ in steps[:-1])
    assert sorted(w for steps in rounds for u, t in steps for w in known(u, t)) == every
    assert all(sum(len(u) for u, _ in steps) > len(every) / lm.ROUNDS / 2 for steps in rounds)


def test_all_windows_move_the_weights(spark, monkeypatch):
    """An id that one window in hundreds holds gets a trained embedding, and the number of windows is that of the texts."""
    words = [f"{a}{b}" for a in ("stone", "river", "cloud") for b in ("fall", "bed", "light")]
    own = [(i, " ".join(words[(i * 7 + j) % len(words)] for j in range(60)) + (" zebra" * 3 if i == 321 else "")) for i in range(400)]
    model = lm.fit(spark.createDataFrame(own, "doc_id long, text string"), "doc_id", "text")
    ids = np.concatenate([lm._ids(t, lm.tokenizer_path()) for _, t in own])
    monkeypatch.setattr(lm, "averaged", lambda coded, start: start)
    start = lm.fit(spark.createDataFrame(own, "doc_id long, text string"), "doc_id", "text")
    inputs = np.unique(ids[ids != lm.END])
    assert (model.p["e"][inputs] != start.p["e"][inputs]).any(axis=1).all()


def test_a_step_follows_the_gradient():
    """The first step of Adam moves each weight by its rate against the sign of the slope, found here by differences."""
    rng = np.random.default_rng(6)
    model = lm.train([rng.integers(0, 40, 60).astype(np.uint32) for _ in range(4)])
    y = np.append(rng.integers(0, 40, 50), rng.integers(0, 40, 30))
    at = np.array([0, 50, 80])
    u, t = lm.windows(y, at, *lm.places(at))
    before = {k: v.astype(float) for k, v in model.p.items()}

    def loss(p):
        x = p["e"][u] + p["pos"]
        late = x[:, lm.WINDOW - lm.STEP :]
        w = np.exp((late @ p["q"]) @ (x @ p["k"]).transpose(0, 2, 1) + lm.MASK)
        r = late + (w / w.sum(axis=2, keepdims=True)) @ (x @ p["v"])
        z = np.maximum(r @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]
        b, c = np.nonzero(t >= 0)
        return (np.log(np.exp(z).sum(axis=2))[b, c] - z[b, c, model.cls[t[b, c]]]).mean()

    after = lm.trained(model, [(u, t)]).p
    checked = 0
    for name, value in before.items():
        cells = np.argwhere(after[name] != value)
        for cell in map(tuple, cells[rng.permutation(len(cells))[:40]]):
            sides = [{**before, name: value.copy()} for _ in range(2)]
            sides[0][name][cell] += 1e-5
            sides[1][name][cell] -= 1e-5
            slope = (loss(sides[0]) - loss(sides[1])) / 2e-5
            if abs(slope) > 1e-5:
                checked += 1
                assert abs(after[name][cell] - value[cell] + 0.01 * np.sign(slope)) < 1e-4
    assert checked > 150


def test_large_weights_stay_finite_and_causal():
    model = lm.train([np.arange(200, dtype=np.uint32) % 9])
    model.p = {k: (v * 200).astype(np.float32) for k, v in model.p.items()}
    y = np.arange(40) % 9
    one = model.log10(y, np.array([0, 40]))
    assert np.isfinite(one).all()
    each = model.log10(np.concatenate([np.append(y[:30], x) for x in range(lm.VOCABULARY)]), np.arange(0, 31 * lm.VOCABULARY + 1, 31))
    assert abs(np.sum(10.0 ** (each - model.log10(y[:30], np.array([0, 30])))) - 1) < 1e-3
