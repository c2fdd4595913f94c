"""Language identification: gradients against differences, lanes against a plain loop, held-out accuracy."""

import numpy as np

from assaylake.llm import bigru_langid
from assaylake.llm.bigru_langid import CHUNK, CONTEXT, Network


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"], 3, 1)
    for w in net.weights():
        w[...] = w  # float32
    x, y = rng.integers(1, 9, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    x[0, :2] = 0
    _, grads = net.gradients(x, y)
    for name, g in zip(("table", "recurrent", "out", "bias"), grads, strict=True):
        w = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(12)] + ([(0, int(x[1, 3]), 1), (1, int(x[2, 2]), 4)] if name == "table" else []):
            old = w[at]
            w[at] = old + 1e-2
            up, _ = net.gradients(x, y)
            w[at] = old - 1e-2
            down, _ = net.gradients(x, y)
            w[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3, (name, at)


def plain_probabilities(net, text):
    """Position by position, with the lane's own start of the state."""
    k, total = net.hidden, np.zeros(len(net.languages))
    padded = bytes(CONTEXT) + text + bytes(2 * CHUNK)
    for start in range(0, len(text), CHUNK):
        lane = padded[start : start + CHUNK + 2 * CONTEXT]
        seen = []
        for way in (0, 1):
            h, out = np.zeros(k), []
            for byte in (lane if way == 0 else lane[::-1])[: CHUNK + CONTEXT]:
                a = net.table[way, byte] + h @ net.recurrent[way]
                s = a / (1 + np.abs(a))
                h = h + (0.5 + 0.5 * s[:k]) * (s[k:] - h)
                out.append(h @ net.out[way])
            seen.append(out[CONTEXT:] if way == 0 else out[CONTEXT:][::-1])
        for i in range(min(CHUNK, len(text) - start)):
            p = np.exp(seen[0][i] + seen[1][i] + net.bias)
            total += p / p.sum()
    return total / len(text)


def test_lanes_equal_a_plain_loop():
    net = Network(["a", "b"], 4, 2)
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 256, n, np.uint8).tobytes() for n in (1, 5, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 7)]
    for got, text in zip(net.probabilities(texts), texts, strict=True):
        assert np.allclose(got, plain_probabilities(net, text), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = bigru_langid.with_split(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    net = bigru_langid.train(docs.where("not held_out and lang is not null").select("text", "lang"))
    rows = bigru_langid.predict(docs.selectExpr("doc_id", "text", "held_out", "lang", "lang as lang_pred"), net).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    odd = [(1, None), (2, ""), (3, " 12 !!"), (4, "the of and that is with for"), (None, "the of and that is with for"), (4, "the of and " * 30_000)]
    got = bigru_langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), net).collect()
    assert [r.lang_pred for r in got] == ["und"] * 3 + ["en"] * 3 and got[3].score == got[4].score and all(0 <= r.score <= 1 for r in got)
    none = bigru_langid.train(docs.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in bigru_langid.predict(docs.limit(5).select("doc_id", "text"), none).collect()} == {"und"}
    assert bigru_langid.predict(docs.limit(0).select("doc_id", "text"), net).collect() == []
