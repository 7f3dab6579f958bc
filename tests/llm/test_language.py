"""Language identification: held-out accuracy, a plain version of the score, defined cases."""
import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as E
from complexa.llm import language as G

SCHEMA = "doc_id long, text string, lang string, score double, held_out int"
WORDS = {"xx": "zum vol krat brel ostan", "yy": "lio nea saru mita", "zz": "þak við ætla ΓΔ жук"}


def rows(spark, data):
    return spark.createDataFrame([(i, t, lang, 0.5, 1) for i, t, lang in data], SCHEMA)


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "", rng.choice(WORDS[lang].split())]) for _ in range(rng.randrange(1, 9))), lang)
            for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]


def plain_words(text):
    out, word = [], ""
    for ch in text.lower() + " ":
        if unicodedata.category(ch)[0] in "LM":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def plain_scores(train, tests):
    """Mean log10 values by language, written out with dictionaries."""
    counts = defaultdict(lambda: [Counter() for _ in range(G.LONGEST + 1)])
    for _, text, lang in train:
        for w in plain_words(text):
            counts[lang][0][w] += 1
            for n in range(1, G.LONGEST + 1):
                counts[lang][n].update(f" {w} "[i:i + n] for i in range(len(w) + 3 - n))
    langs = sorted(counts)

    def value(n, key, lang):
        c = counts[lang][n]
        return math.log10(c[key] / sum(c.values())) if c[key] else G.PENALTY

    out = []
    for _, text, _ in tests:
        found = []
        for w in plain_words(text):
            for n in [0, *range(G.LONGEST, 0, -1)]:
                keys = [w] if n == 0 else [f" {w} "[i:i + n] for i in range(len(w) + 3 - n)]
                keys = [k for k in keys if any(counts[x][n][k] for x in langs)]
                if keys:
                    found.append([sum(value(n, k, x) for k in keys) / len(keys) for x in langs])
                    break
        mean = np.mean(found, axis=0) if found else np.zeros(len(langs))
        odds = 10 ** ((mean - mean.max()) * min(len(found), G.SURE_WORDS))
        out.append((langs[int(np.argmax(mean))], 1 / odds.sum()))
    return out


def test_equals_the_plain_version(spark):
    train, test = texts(1, 200), texts(2, 60)
    model = G.learn_languages(rows(spark, train))
    got = {r.doc_id: (r.lang_pred, r.score) for r in G.predict_languages(rows(spark, test), model).collect()}
    for (i, _, _), (lang, score) in zip(test, plain_scores(train, test), strict=True):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, rel=1e-9)
    assert np.mean([got[i][0] == lang for i, _, lang in test]) > 0.95


def test_held_out_accuracy_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    got = E.queries()["op11_language"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    both = got.join(truth, "doc_id").toPandas()
    assert len(both) == truth.count() and set(got.columns) == {"doc_id", "held_out", "lang_pred", "score"}
    held = both[both.held_out]
    assert 0.25 < len(held) / len(both) < 0.42 and (held.lang == held.lang_pred).mean() >= 0.95 and both.score.between(0, 1).all()


def test_defined_cases(spark):
    data = texts(5, 60) + [(100, None, "xx"), (101, "", "yy"), (102, "12 -- 7!", None), (103, "本", None), (104, "́", None),
                           (None, "zum vol", None), (105, "ZUM VOL KRAT", None), (105, "ZUM VOL KRAT", None), (106, "zum vol " * 200_000, None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in G.languages(rows(spark, data)).collect()]
    by_id = {i: (lang, score) for i, lang, score in got}
    assert len(got) == len(data) and {by_id[i] for i in (100, 101, 102, 104)} == {("und", 0.0)}
    assert by_id[103][0] in WORDS and by_id[None][0] == by_id[105][0] == by_id[106][0] == "xx" and sum(i == 105 for i, _, _ in got) == 2
    assert G.languages(rows(spark, [])).collect() == []
    alone = [(r.lang_pred, r.score) for r in G.languages(rows(spark, [(1, "abc", None), (2, None, None)])).collect()]
    assert alone == [("und", 0.0)] * 2


def test_the_model_is_bounded(spark, monkeypatch):
    train = rows(spark, texts(1, 200))
    monkeypatch.setattr(G, "MAX_FEATURES", 12)
    model = G.learn_languages(train)
    assert all(len(x) <= 12 for x in model.lang) and sum(len(x) for x in model.lang) > 0
    words, letters = G.words_of(np.frombuffer("zum ž1".encode(), np.uint8), np.array([0, 7]))
    assert len(words.start) == 2 and letters.all()
    assert G.predict(model, np.zeros(0, np.uint8), np.array([0, 0]))[0] == ["und"] and pa is not None
