import numpy as np
import pandas as pd

from complexa.functions.chat import pack_sequences
from complexa.operators import models as ML
from complexa.operators import splits as SP


def _vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)), rng.integers(0, 4, size=n)


def test_knn_broadcast_equals_brute_force(spark):
    xtr, ytr = _vectors(120, 8, 3)
    xte, _ = _vectors(25, 8, 4)
    tr = spark.createDataFrame(pd.DataFrame({"vec_id": range(120), "label": ytr.astype(int),
                                             "embedding": [list(map(float, r)) for r in xtr]}))
    te = spark.createDataFrame(pd.DataFrame({"vec_id": range(1000, 1025), "label": 0,
                                             "embedding": [list(map(float, r)) for r in xte]}))
    got = {r.test_id: r.y_pred for r in ML.knn_predict(tr, te).collect()}
    assert got == _brute(xtr, ytr, xte)


def _brute(xtr, ytr, xte):
    want = {}
    for i, x in enumerate(xte):
        d = ((xtr - x) ** 2).sum(1)
        nn = sorted(range(len(xtr)), key=lambda j: (d[j], j))[:5]
        votes = pd.Series(ytr[nn]).value_counts()
        want[1000 + i] = int(min(votes[votes == votes.max()].index))
    return want


def test_knn_chunked_equals_brute_force(spark, monkeypatch):
    xtr, ytr = _vectors(120, 8, 1)
    xte, _ = _vectors(30, 8, 2)
    tr = spark.createDataFrame(pd.DataFrame({"vec_id": range(120), "label": ytr.astype(int),
                                             "embedding": [list(map(float, r)) for r in xtr]}))
    te = spark.createDataFrame(pd.DataFrame({"vec_id": range(1000, 1030), "label": 0,
                                             "embedding": [list(map(float, r)) for r in xte]}))
    monkeypatch.setattr(ML, "KNN_FILE_ROWS", 40)  # several files
    got = {r.test_id: r.y_pred for r in ML.knn_predict(tr, te).collect()}
    want = {}
    for i, x in enumerate(xte):
        d = ((xtr - x) ** 2).sum(1)
        nn = sorted(range(120), key=lambda j: (d[j], j))[:5]
        votes = pd.Series(ytr[nn]).value_counts()
        want[1000 + i] = int(min(votes[votes == votes.max()].index))
    assert got == want


def test_knn_ties_go_to_the_smallest_ids():
    x, xt = np.zeros((1, 3)), np.ones((30, 3)) / 3
    (at, dist), = ML.nearest(x, xt, np.arange(30)[::-1].copy(), 5)
    assert sorted(np.arange(30)[::-1][at].tolist()) == [0, 1, 2, 3, 4] and len(set(dist.tolist())) == 1


def test_models_learn_separable_classes(spark):
    rng = np.random.default_rng(8)
    y = np.arange(240) % 3
    x = rng.normal(size=(240, 6)) * 0.3 + np.eye(6)[y] * 3
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(240), "label": y, "embedding": [list(map(float, r)) for r in x]}))
    tr, te = df.filter("vec_id < 180"), df.filter("vec_id >= 180")
    for name in ["DecisionTree", "RandomForest", "SVM", "LogisticRegression", "KNN", "MLP"]:
        got = ML.fit_predict(name, tr, te, 6, 3).toPandas()
        assert len(got) == 60 and (got.y_true == got.y_pred).mean() > 0.9, name


def test_svm_predicts_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation, functions as F
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    df = spark.createDataFrame([(i, i % 2, [4.0 * (i % 2), 1.0]) for i in range(24)], "vec_id long, label int, embedding array<double>")
    got = ML.fit_predict("SVM", df, df, 2, 2).collect()
    assert len(got) == 24 and all(r.y_true == r.y_pred for r in got)


def test_pack_sequences_sparse_and_negative_keys(spark):
    keys = [-(10**12), -5, -1, 0, 3, 4, 70, 10**9, 10**15]
    texts = [(k, f"<{k}>" * 3) for k in keys]
    df = spark.createDataFrame(texts, "k long, text string")
    stream = "".join(t for _, t in sorted(texts))
    got = {r.block: r.text for r in pack_sequences(df, "k", "text", block=16, range_size=8).collect()}
    assert got == {b: stream[b * 16:(b + 1) * 16] for b in range((len(stream) + 15) // 16)}


def test_pack_sequences_matches_python(spark):
    texts = [(i, "x" * (i * 37 % 91) + str(i)) for i in range(60)]
    df = spark.createDataFrame(texts, "k long, text string")
    got = {r.block: r.text for r in pack_sequences(df, "k", "text", block=64, range_size=7).collect()}
    stream = "".join(t for _, t in sorted(texts))
    want = {b: stream[b * 64:(b + 1) * 64] for b in range((len(stream) + 63) // 64)}
    assert got == want


def test_pack_sequences_of_equal_keys_is_one_stream(spark):
    texts = [(5, "bbbb"), (5, "aaaa"), (5, "cccc"), (5, ""), (5, "aaaa"), (7, "dd"), (5, "e" * 23)]
    blocks = [r.text for r in pack_sequences(spark.createDataFrame(texts, "k long, text string"), "k", "text", block=6, range_size=4).orderBy("block").collect()]
    stream = "".join(blocks)
    assert [len(b) for b in blocks] == [6] * 6 + [5] and stream.endswith("dd")
    from itertools import permutations
    assert stream[:-2] in {"".join(p) for p in permutations([t for k, t in texts if k == 5])}


def test_fold_retry_picks_first_accepted_seed(spark):
    rows = [(0, f"p{i}", j) for i in range(20) for j in range(1 + (i % 5))]
    df = spark.createDataFrame(rows, "label int, problem string, j int")
    r = SP.group_kfold_retry(df, "label", "problem", 0.8, 4, seeds=[1, 2, 3])
    seeds = {x.seed for x in r.collect()}
    assert len(seeds) == 1 and r.count() == 20


def test_lloyd_steps_equal_plain_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 4)) + np.repeat(np.eye(3, 4) * 6, 50, axis=0), 3)
    rows = [(int(i), [float(a) for a in v], "x") for i, v in enumerate(x)] + [(200, None, "x"), (None, [0.0] * 4, "x"), (3, [float(a) for a in x[3]], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    done, centers = ML.lloyd_kmeans(df.drop("cluster"), 4, 20)
    data = np.vstack([x, x[3]])
    c = x[:4].copy()
    c = np.vstack([x[0], x[1], x[2], x[3]])
    for _ in range(20):
        near = ((data[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([np.round(data[near == i].mean(0), 6) if (near == i).any() else c[i] for i in range(4)])
    assert np.allclose(centers, c, atol=2e-6)
    got = {r.vec_id: r.cluster for r in done.collect()}
    assert len(got) == 150 and [got[i] for i in range(150)] == ((data[:150, None] - c[None]) ** 2).sum(2).argmin(1).tolist()
    empty, none = ML.lloyd_kmeans(df.drop("cluster").limit(0))
    assert empty.collect() == [] and none == []


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    import threading
    both = threading.Barrier(2, timeout=20)

    def fit(name, train, test, *_):
        both.wait()  # a fold on its own would wait in vain
        return test.selectExpr("vec_id AS test_id", "label AS y_true", "label AS y_pred")

    monkeypatch.setattr(ML, "fit_predict", fit)
    df = spark.createDataFrame([(i, i % 3, [1.0 * i]) for i in range(40)], "vec_id long, label int, embedding array<double>")
    got = ML.kfold_train_eval(df, "any", 4, 1, 3).collect()
    assert sorted(r.test_id for r in got) == list(range(40)) and {r.fold for r in got} == {0, 1, 2, 3} and {r.model for r in got} == {"any"}


def test_linear_fits_of_few_rows_run_one_task_an_iteration(spark, monkeypatch):
    seen = []

    class Probe(ML.Pipeline):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(ML, "Pipeline", Probe)
    df = spark.createDataFrame([(i, i % 2, [4.0 * (i % 2), 1.0]) for i in range(24)], "vec_id long, label int, embedding array<double>").repartition(6)
    got = ML.fit_predict("LogisticRegression", df, df, 2, 2).collect()
    assert seen == [1] and len(got) == 24 and all(r.y_true == r.y_pred for r in got)
