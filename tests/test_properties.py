"""Property test: Spark metrics equal the published metric definitions computed in plain Python."""

from hypothesis import given, settings
from hypothesis import strategies as st

from complexa.operators import metrics as M

pairs = st.lists(st.tuples(st.integers(0, 6), st.integers(-1, 6)), min_size=1, max_size=40)


def python_metrics(ps):
    n = len(ps)
    labels = sorted({t for t, _ in ps} | {p for _, p in ps})
    f1 = {}
    for lab in labels:
        tp = sum(1 for t, p in ps if t == lab and p == lab)
        fp = sum(1 for t, p in ps if t != lab and p == lab)
        fn = sum(1 for t, p in ps if t == lab and p != lab)
        f1[lab] = 0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn)
    support = {lab: sum(1 for t, _ in ps if t == lab) for lab in labels}
    return {
        "accuracy": sum(t == p for t, p in ps) / n,
        "f1_weighted": sum(f1[lab] * support[lab] for lab in labels) / n,
        "f1_macro": sum(f1.values()) / len(labels),
        "hc_base": sum(0 if p == -1 else 1 - abs(p - t) / 6 for t, p in ps) / n,
        "hc_w2": sum(0 if p == -1 else max(1 - abs(p - t) / 2, 0) for t, p in ps) / n,
        **{f"class_acc_{i}": sum((t == i) == (p == i) for t, p in ps) / n for i in range(7)},
    }


@settings(max_examples=12, deadline=None)
@given(pairs)
def test_report_matches_definitions(spark, ps):
    df = spark.createDataFrame([("m", t, p) for t, p in ps], "model string, y_true int, y_pred int")
    got = M.score_report(df, ["model"], digits=None).first().asDict()
    for k, v in python_metrics(ps).items():
        assert abs(got[k] - v) < 1e-9, (k, got[k], v)
