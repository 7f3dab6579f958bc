import pytest
from pyspark.sql import functions as F

from complexa.operators import metrics as M

PAIRS = [(0, 0), (2, 4), (6, 5), (3, -1)]


@pytest.fixture()
def preds(spark):
    return spark.createDataFrame([("m", t, p) for t, p in PAIRS], "model string, y_true int, y_pred int")


def test_score_fixture(preds):
    r = M.score_report(preds, ["model"]).first()
    assert r.accuracy == 0.25 and r.f1_micro == 0.25
    assert r.hc_base == 0.625 and r.hc_w2 == 0.375 and r.hc_w3 == 0.5
    assert r.hc_map_base == 0.625 and r.hc_map_w2 == 0.25 and r.hc_map_w3 == pytest.approx(0.416667)
    assert r.f1_weighted == 0.25
    assert r.f1_macro == pytest.approx(0.142857)  # -1 is an eighth label: union {-1,0,2,3,4,5,6}
    assert r.n_labels == 7
    assert [r[f"class_acc_{i}"] for i in range(7)] == [1, 1, .75, .75, .75, .75, .75]


def test_invariants_on_lineitem(spark):
    from complexa.plans.standins import predictions
    p = predictions(spark, "/root/testdata/sf0.001")
    r = M.score_report(p, ["model"]).collect()
    n = p.count()
    assert sum(x.n_rows for x in r) == n
    for x in r:
        assert x.f1_micro == x.accuracy
        assert x.hc_w2 <= x.hc_w3 <= x.hc_base
    cm = M.confusion_long(p, ["model"])
    assert cm.agg(F.sum("n")).first()[0] == n


def test_confusion_zero_filled(preds):
    cm = M.confusion_long(preds, ["model"]).collect()
    assert len(cm) == 7 * 7
    assert sum(c.n for c in cm) == 4


def test_kfold_weighted(spark):
    fa = spark.createDataFrame([("m", 80.0, 1), ("m", 90.0, 3)], "model string, acc double, fold_rows long")
    r = M.kfold_weighted(fa, ["model"]).first()
    assert r.acc_mean == 87.5 and r.acc_std == 5.0


def test_best_epoch(spark):
    log = spark.createDataFrame([(1, 0, .5), (1, 1, .7), (1, 2, .7)], "run int, epoch int, acc double")
    assert M.best_epoch(log, ["run"]).first().epoch == 1


def test_label_orders(spark):
    # T-order ids: constant 0, linear 1, logn 2 ... -> R ranks constant 0, logn 1, linear 2
    df = spark.createDataFrame([("m", 1, 2), ("m", 6, 6)], "model string, y_true int, y_pred int")
    parity = M.score_report(df, ["model"], order="T-parity").first()
    remap = M.score_report(df, ["model"], order="T").first()
    assert parity.hc_base == round((1 - 1 / 6 + 1) / 2, 6)  # |2-1| = 1 in T-order
    assert remap.hc_base == round((1 - 1 / 6 + 1) / 2, 6)  # linear(2) vs logn(1) in R-order: also 1
    df2 = spark.createDataFrame([("m", 1, 5)], "model string, y_true int, y_pred int")  # linear vs nlogn
    assert M.score_report(df2, ["model"], order="T-parity").first().hc_base == round(1 - 4 / 6, 6)
    assert M.score_report(df2, ["model"], order="T").first().hc_base == round(1 - 1 / 6, 6)


def test_py_round_matches_python(spark):
    from complexa.functions.numbers import py_round
    vals = [(0.0625, 3), (0.0005, 3), (2.675, 2), (0.125, 2), (12.345, 2), (87.45, 1), (0.2125, 3)]
    df = spark.createDataFrame([(v,) for v, _ in vals], "x double")
    got = [df.select(py_round("x", d)).collect()[i][0] for i, (_, d) in enumerate(vals)]
    assert got == [round(v, d) for v, d in vals]
