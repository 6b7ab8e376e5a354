"""The network's passes against plain loops and finite differences."""

import numpy as np
import pytest

toxicity = pytest.importorskip("graphloom.llm.toxicity")


def made(seed=3, windows=6, length=9):
    r = np.random.default_rng(seed)
    net = toxicity.Net(seed)
    net.p["word"] += r.standard_normal(net.p["word"].shape).astype(np.float32) * 0.1
    words = ["one", "two", "three", "vile", "a", "wörter", "x" * 40]
    grams, at = toxicity._gram_ids(words)
    x = net.inputs(toxicity._word_ids(words), grams, np.diff(np.append(at, len(grams))))
    table = np.concatenate([net.pad(), net.project(x)], axis=1)
    index = r.integers(1, len(words) + 1, (windows, length))
    for i, n in enumerate(r.integers(1, length + 1, windows)):
        index[i, n:] = toxicity._PAD
    return net, x, table, index, r


def plain(net, x, row):
    """One window's logit, word by word."""
    h_, sig = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    words = [x[i - 1].astype(np.float64) for i in row if i != toxicity._PAD]
    states = []
    for d in (0, 1):
        h, out = np.zeros(h_), []
        for w in words if d == 0 else words[::-1]:
            g, u = w @ net.p["wx"][d] + net.p["b"][d], h @ net.p["wh"][d]
            z, r = sig(g[:h_] + u[:h_]), sig(g[h_ : 2 * h_] + u[h_ : 2 * h_])
            h = z * h + (1 - z) * np.tanh(g[2 * h_ :] + r * u[2 * h_ :])
            out.append(h)
        states.append(out if d == 0 else out[::-1])
    both = [np.concatenate(s) for s in zip(*states)]
    score = np.array([b @ net.p["att"] for b in both])
    weight = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    return sum(w * b for w, b in zip(weight, both)) @ net.p["out"] + net.p["bias"][0]


def test_forward_equals_plain_loops():
    net, x, table, index, _ = made()
    assert np.allclose(net.forward(table, index), [plain(net, x, row) for row in index], atol=1e-4)


def test_gradients_equal_finite_differences():
    net, _, table, index, r = made(5)
    g = r.standard_normal(len(index)).astype(np.float32)
    _, kept = net.forward(table, index, keep=True)
    grads, rows = net.backward(index, kept, g, table.shape[1])
    loss = lambda: float((net.forward(table, index).astype(np.float64) * g).sum())

    def slope(array, at, step=1e-2):
        before = array[at]
        array[at] = before + step
        high = loss()
        array[at] = before - step
        low = loss()
        array[at] = before
        return (high - low) / (2 * step)

    for name, grad in grads.items():
        for _ in range(12):
            at = tuple(r.integers(0, n) for n in net.p[name].shape)
            assert abs(slope(net.p[name], at) - np.reshape(grad, net.p[name].shape)[at]) < 5e-3, name
    for _ in range(30):
        word, d, k = r.integers(1, table.shape[1]), r.integers(0, 2), r.integers(0, table.shape[2])
        assert abs(slope(table, (d, word, k)) - rows[word, d, k]) < 5e-3
    assert not rows[toxicity._PAD].any()


def test_documents_pool_all_windows():
    net, _, _, _, _ = made()
    logits, at = np.array([1.0, 3.0, -2.0, 0.5]), np.array([0, 3])
    assert np.allclose(toxicity._pool(logits, at), [np.log(np.exp([1, 3, -2]).sum()), 0.5])
    for n in (1, 5, toxicity.WINDOW, toxicity.WINDOW + 1, 3 * toxicity.WINDOW + 7):
        starts = toxicity.windows_of(n, toxicity.WINDOW // 2)
        covered = set().union(*(range(s, s + toxicity.WINDOW) for s in starts))
        assert set(range(n)) <= covered and all(s + toxicity.WINDOW <= max(n, toxicity.WINDOW) for s in starts)
    # every window of a text is among those that it is scored by
    layout, first = toxicity._layout([3, toxicity.WINDOW + 2], 1)
    assert len(layout) == 1 + 3 and list(first) == [0, 1]


def test_batches_against_kept_snapshots(spark, tmp_path, monkeypatch):
    """Filters are built once; a batch is asked against several snapshots, an empty one too."""
    from graphloom.llm import components, exact_dedup

    kind, paths = "doc_id long, text string, digest string", [str(tmp_path / n) for n in "abc"]
    frame = lambda rows: spark.createDataFrame([(i, t, "own") for i, t in rows], kind)
    exact_dedup.keep_snapshot(frame([(i, f"text {i}") for i in range(50)] + [(99, None)]), paths[0])
    exact_dedup.keep_snapshot(frame([(i, f"text {i}") for i in range(40, 60)] * 2), paths[1])
    exact_dedup.keep_snapshot(frame([]), paths[2])
    monkeypatch.setattr(exact_dedup, "build_filters", None)  # what is kept is used
    batch = [(1, "text 3"), (2, "text 45"), (2, "text 45"), (3, "text 55"), (4, "new"), (None, ""), (5, None)]
    want = {"text 3": paths[:1], "text 45": paths[:2], "text 55": paths[1:2], "new": [], "": paths[:1], None: paths[:1]}
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = exact_dedup.known_texts(frame(batch), paths).collect()
        assert sorted((str(r.doc_id), r.snapshots) for r in got) == sorted((str(k), want[t]) for k, t in batch)
    assert exact_dedup.known_texts(frame([]), paths).count() == 0 and exact_dedup.known_texts(frame(batch), []).count() == 7
