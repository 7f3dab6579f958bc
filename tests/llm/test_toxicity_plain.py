"""The network's scores against the same formulas written out token by token, and the rows it is fitted to."""
import math

import numpy as np
import pytest

from complexa.llm import toxicity as T


def rows_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_logit(p, inputs):
    """A window's logit from the input vectors of its tokens: two gated units, attention pooling, a linear unit."""
    h = T.HIDDEN
    wx, bx, u = p["wx"].astype(float), p["bx"].astype(float), p["u"].astype(float)
    both = [np.zeros(2 * h) for _ in inputs]
    for side in (0, 1):
        state = np.zeros(h)
        for t in range(len(inputs)) if side == 0 else reversed(range(len(inputs))):
            x = inputs[t] @ wx[:, side * 3 * h:(side + 1) * 3 * h] + bx[side * 3 * h:(side + 1) * 3 * h]
            r = state @ u[side]
            z = [sigmoid(a) for a in x[:h] + r[:h]]
            g = [sigmoid(a) for a in x[h:2 * h] + r[h:2 * h]]
            c = [math.tanh(x[2 * h + i] + g[i] * r[2 * h + i]) for i in range(h)]
            state = np.array([c[i] + z[i] * (state[i] - c[i]) for i in range(h)])
            both[t][side * h:(side + 1) * h] = state
    if not inputs:
        return float(p["bo"][0])
    scores = [float(np.tanh(b @ p["wa"].astype(float)) @ p["va"].astype(float)) for b in both]
    weights = [math.exp(s - max(scores)) for s in scores]
    pooled = sum(w * b for w, b in zip(weights, both, strict=True)) / sum(weights)
    return float(pooled @ p["wo"].astype(float) + p["bo"][0])


def plain_score(net, text):
    tokens = T.Tokens(*rows_of([text]))
    at = np.cumsum(tokens.gram_counts) - tokens.gram_counts

    def vector(token):
        grams = tokens.grams[at[token]:at[token] + tokens.gram_counts[token]]
        sums = net.p["gram"][grams].astype(float).sum(0) / math.sqrt(max(len(grams), 1))
        return np.concatenate([net.p["word"][tokens.bucket[token]].astype(float), sums])

    n, logits, start = len(tokens.index), [], 0
    while True:
        first = max(0, min(start, n - T.WINDOW))
        logits.append(plain_logit(net.p, [vector(t) for t in tokens.index[first:first + T.WINDOW]]))
        if start + T.WINDOW >= n:
            return sigmoid(max(logits))
        start += T.STRIDE


@pytest.mark.parametrize("text", ["", "one", "a b c.", "Das ist EIN ß-Text! " * 3, " ".join(f"w{i % 17}x" for i in range(T.WINDOW)),
                                  " ".join(f"tok{i * 7 % 90}" for i in range(131))])
def test_scores_equal_the_plain_version(text):
    net = T.Network(3)
    rng = np.random.default_rng(4)
    net.p["bx"] = rng.standard_normal(net.p["bx"].shape).astype(np.float32) * 0.3
    others = "something else entirely " * 9
    got = T.text_scores(net, *rows_of([others, text, "x"]))[1]
    assert got == pytest.approx(plain_score(net, text), abs=2e-5)


def test_training_reads_whole_texts_and_one_row_of_an_id(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(T, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels.tolist()))
    ids = list(range(80))
    docs = spark.createDataFrame([(i, f"text {i} " + "long " * 5000, "en") for i in ids] + [(ids[0], "copy", "en")] * 40 + [(ids[1], None, "en")] * 3, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in ids] + [(None, 0, 1), (ids[2], 1, None)], "doc_id long, quality int, toxic int")
    T.train_network(docs, labels, sample=20, clean=10)
    assert sum(seen["labels"]) in (19, 20) and len(seen["texts"]) == sum(seen["labels"]) + 10  # the null id may be in the sample, and has no text
    assert all(t in ("copy", "") or t.count("long") == 5000 for t in seen["texts"])
    T.train_network(docs.limit(0), labels)
    assert seen["texts"] == []
    T.train_network(docs, labels.limit(0))
    assert seen["texts"] == []


def test_a_text_of_many_windows_trains_in_blocks(monkeypatch):
    texts = ["bad " * 3 + "word " * 900, "good " * 700, "bad thing", "good thing"] * 3
    labels = np.array([1, 0, 1, 0] * 3)
    one = T.fit(texts, labels, epochs=2)
    monkeypatch.setattr(T, "TRAIN_WINDOWS", 7)
    two = T.fit(texts, labels, epochs=2)
    for k in ("u", "wa", "wo", "wx"):
        assert np.allclose(one.p[k], two.p[k], atol=2e-2)
