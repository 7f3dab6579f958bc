import random

import numpy as np
import pytest

from complexa.llm import toxicity as T


def tokens_of(texts):
    raw = [t.encode() for t in texts]
    rows = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), rows


def test_windows_cover_every_token():
    rng = random.Random(0)
    rows = np.append(0, np.cumsum([rng.randrange(0, 200) for _ in range(50)]))
    start, size, row = T.windows_of(rows)
    seen = np.zeros(rows[-1], int)
    for s, n, r in zip(start, size, row):
        assert rows[r] <= s and s + n <= rows[r + 1] and n <= T.WINDOW
        seen[s:s + n] += 1
    assert seen.min() >= 1 and set(row.tolist()) == set(range(50))


@pytest.mark.parametrize("name", ["u", "wa", "va", "wo", "bo", "wx", "bx"])
def test_gradients(name):
    rng = np.random.default_rng(1)
    net = T.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    tk = T.Tokens(*tokens_of(["alpha beta gamma delta " * 12, "one two three", "", "ab"]))
    start, size, _ = T.windows_of(tk.rows)
    index, mask = T._gather(tk, start, size)
    features = net.inputs(tk.bucket, tk.grams, tk.gram_counts)
    times = np.arange(1.0, len(start) + 1)
    loss = lambda: float((net.forward(features @ net.p["wx"] + net.p["bx"], index, mask) * times).sum())
    _, kept = net.forward(features @ net.p["wx"] + net.p["bx"], index, mask, keep=True)
    grad, d_table = net.backward(times, index, mask, len(features), kept)
    grad["wx"], grad["bx"] = features.T @ d_table, d_table.sum(0)
    for _ in range(4):
        i = tuple(rng.integers(0, d) for d in net.p[name].shape)
        old = net.p[name][i]
        net.p[name][i] = old + 0.01
        up = loss()
        net.p[name][i] = old - 0.01
        assert abs((up - loss()) / 0.02 - grad[name][i]) < 1e-3
        net.p[name][i] = old


def test_tokens_in_parts(monkeypatch):
    rng = random.Random(5)
    texts, _ = corpus(80, rng)
    texts += ["", "ein ß"]
    whole = T.Tokens(*tokens_of(texts))
    chunks = T.text_chunks
    monkeypatch.setattr(T, "text_chunks", lambda col, limit: chunks(col, 500))
    parts = T.tokens_of(texts)
    assert (whole.rows == parts.rows).all() and (whole.hash == parts.hash).all() and (whole.index == parts.index).all()
    assert (whole.grams == parts.grams).all() and (whole.gram_counts == parts.gram_counts).all() and (whole.bucket == parts.bucket).all()


def corpus(n, rng):
    plain = ["".join(rng.choice(["ba", "du", "ki", "lo", "mer"]) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 150))]
        toxic = i % 3 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["Vexor!!", "grunk", "zzyx" + rng.choice(["ba", "du", "ki"])])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(7)
    return T.fit(*corpus(900, rng)), corpus(300, rng)


def test_held_out_accuracy(trained):
    net, (texts, labels) = trained
    score = T.text_scores(net, *tokens_of(texts))
    assert ((score >= T.THRESHOLD) == labels).mean() > 0.95


def test_scores_do_not_depend_on_neighbours(trained):
    net, (texts, _) = trained
    some = ["", *texts[:20], "!!!", texts[0]]
    whole = T.text_scores(net, *tokens_of(some))
    alone = [T.text_scores(net, *tokens_of([t]))[0] for t in some]
    assert np.allclose(whole, alone, atol=1e-6) and whole[0] == pytest.approx(whole[-2]) and whole[1] == pytest.approx(whole[-1])


def test_one_toxic_word_in_a_long_text(trained):
    net, _ = trained
    clean = "ba du ki lo mer badu kilo " * 3000
    score = T.text_scores(net, *tokens_of([clean, clean + " grunk vexor " + clean]))
    assert score[0] < T.THRESHOLD <= score[1]


def test_spark_scores_drop_and_odd_rows(documents, spark):
    rng = random.Random(9)
    texts, labels = corpus(400, rng)
    docs = documents([*enumerate(texts), (None, None), (900, ""), (900, "")])
    marks = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(labels.tolist())] + [(None, 1, 0), (5, None, 0), (77777, 1, 0)], "doc_id long, toxic int, quality int")
    net = T.train_network(docs, marks)
    got = {r.doc_id: r.score for r in T.toxicity_scores(docs, net).collect()}
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values())
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in got if i is not None and got[i] < T.THRESHOLD for _ in range(2 if i == 900 else 1))
    assert T.toxicity_scores(documents([]), net).count() == 0
    assert T.train_network(docs, marks.limit(0)).p["bo"][0] == -1.0
