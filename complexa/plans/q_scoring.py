"""Scoring queries: predictions stand-in -> metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from complexa.operators import metrics as M
from complexa.plans import standins as S
from complexa.plans.registry import CORPUS, PREDICTIONS, query

P = PREDICTIONS

# ------------------------------------------------------------------ SQL pieces
_LABEL_STATS = """
sup AS (SELECT {g}, y_true AS label, count(*) AS support,
               sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS tp
        FROM predictions GROUP BY {g}, y_true),
prd AS (SELECT {g}, y_pred AS label, count(*) AS predicted FROM predictions GROUP BY {g}, y_pred),
lab AS (SELECT {gc}, coalesce(s.label, p.label) AS label,
               CAST(coalesce(support, 0) AS DOUBLE) AS support,
               CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted,
               CAST(coalesce(tp, 0) AS DOUBLE) AS tp
        FROM sup s FULL OUTER JOIN prd p ON {on} AND s.label = p.label),
f1 AS (SELECT {g},
         sum(2 * tp / (support + predicted) * support) / sum(support) AS f1_weighted,
         avg(2 * tp / (support + predicted)) AS f1_macro,
         sum(tp) / sum(support) AS f1_micro,
         sum(CASE WHEN predicted > 0 THEN tp / predicted ELSE 1 END * support) / sum(support) AS precision_weighted,
         sum(CASE WHEN support > 0 THEN tp / support ELSE 0 END * support) / sum(support) AS recall_weighted,
         CAST(count(*) AS BIGINT) AS n_labels
       FROM lab GROUP BY {g})"""

_DIST = """
dist AS (SELECT {g}, CAST(count(*) AS BIGINT) AS n_rows,
  avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END::DOUBLE) AS accuracy,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE 1 - abs(y_pred - y_true) / 6::DOUBLE END) AS hc_base,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE greatest(1 - abs(y_pred - y_true) / 2::DOUBLE, 0) END) AS hc_w2,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE greatest(1 - abs(y_pred - y_true) / 3::DOUBLE, 0) END) AS hc_w3,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE 1 - abs([0,1,2,3,4,6,8][y_pred + 1] - [0,1,2,3,4,6,8][y_true + 1]) / 8::DOUBLE END) AS hc_map_base,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE greatest(1 - abs([0,1,2,3,4,6,8][y_pred + 1] - [0,1,2,3,4,6,8][y_true + 1]) / 2::DOUBLE, 0) END) AS hc_map_w2,
  avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE greatest(1 - abs([0,1,2,3,4,6,8][y_pred + 1] - [0,1,2,3,4,6,8][y_true + 1]) / 3::DOUBLE, 0) END) AS hc_map_w3,
  """ + ",\n  ".join(
    f"avg(CASE WHEN (y_true = {i}) = (y_pred = {i}) THEN 1.0 ELSE 0.0 END::DOUBLE) AS class_acc_{i}"
    for i in range(7)) + """
  FROM predictions GROUP BY {g})"""


def _label_stats(groups: list[str]) -> str:
    g = ", ".join(groups)
    gc = ", ".join(f"coalesce(s.{c}, p.{c}) AS {c}" for c in groups)
    on = " AND ".join(f"s.{c} = p.{c}" for c in groups)
    return _LABEL_STATS.format(g=g, gc=gc, on=on)


def _dist(groups: list[str]) -> str:
    return _DIST.replace("{g}", ", ".join(groups))


def _rnd(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


DIST_COLS = ["accuracy", "hc_base", "hc_w2", "hc_w3", "hc_map_base", "hc_map_w2", "hc_map_w3"]
F1_COLS = ["f1_weighted", "f1_macro", "f1_micro", "precision_weighted", "recall_weighted"]
CLS_COLS = [f"class_acc_{i}" for i in range(7)]


def _preds(spark, sf):
    return S.predictions(spark, sf)


# -------------------------------------------------------------------- AGG6-15
@query("agg06_accuracy", f"WITH {P}, {_dist(['model'])} SELECT model, n_rows, round(accuracy, 6) AS accuracy FROM dist")
def agg06_accuracy(spark, sf):
    return M.accuracy(_preds(spark, sf), ["model"])


@query("agg07_f1_weighted", f"WITH {P}, {_label_stats(['model'])} SELECT model, round(f1_weighted, 6) AS f1_weighted FROM f1")
def agg07_f1_weighted(spark, sf):
    p = _preds(spark, sf)
    return M.f1_scores(M.confusion_cells(p, ["model"]), ["model"]).select("model", "f1_weighted")


@query("agg08_f1_macro", f"WITH {P}, {_label_stats(['model'])} SELECT model, round(f1_macro, 6) AS f1_macro, n_labels FROM f1")
def agg08_f1_macro(spark, sf):
    p = _preds(spark, sf)
    return M.f1_scores(M.confusion_cells(p, ["model"]), ["model"]).select("model", "f1_macro", "n_labels")


@query("agg09_f1_micro", f"WITH {P}, {_label_stats(['model'])} SELECT model, round(f1_micro, 6) AS f1_micro FROM f1")
def agg09_f1_micro(spark, sf):
    p = _preds(spark, sf)
    return M.f1_scores(M.confusion_cells(p, ["model"]), ["model"]).select("model", "f1_micro")


@query("agg10_precision_recall_weighted",
       f"WITH {P}, {_label_stats(['model'])} SELECT model, round(precision_weighted, 6) AS precision_weighted, "
       f"round(recall_weighted, 6) AS recall_weighted FROM f1")
def agg10_precision_recall(spark, sf):
    p = _preds(spark, sf)
    return M.f1_scores(M.confusion_cells(p, ["model"]), ["model"]).select(
        "model", "precision_weighted", "recall_weighted")


@query("agg11_class_accuracy", f"WITH {P}, {_dist(['model'])} SELECT model, {_rnd(CLS_COLS)} FROM dist")
def agg11_class_accuracy(spark, sf):
    p = _preds(spark, sf)
    return M.class_accuracy(M.confusion_cells(p, ["model"]), ["model"])


@query("agg12_hc_base", f"WITH {P}, {_dist(['model'])} SELECT model, round(hc_base, 6) AS hc_base FROM dist")
def agg12_hc_base(spark, sf):
    return M.hc_scores(_preds(spark, sf), ["model"]).select("model", "hc_base")


@query("agg13_hc_window", f"WITH {P}, {_dist(['model'])} SELECT model, round(hc_w2, 6) AS hc_w2, round(hc_w3, 6) AS hc_w3 FROM dist")
def agg13_hc_window(spark, sf):
    return M.hc_scores(_preds(spark, sf), ["model"]).select("model", "hc_w2", "hc_w3")


@query("agg14_hc_mapped", f"WITH {P}, {_dist(['model'])} SELECT model, {_rnd(['hc_map_base', 'hc_map_w2', 'hc_map_w3'])} FROM dist")
def agg14_hc_mapped(spark, sf):
    return M.hc_scores(_preds(spark, sf), ["model"]).select("model", "hc_map_base", "hc_map_w2", "hc_map_w3")


@query("agg15_hc_penalty", f"""WITH {P}
SELECT model, round(avg(abs(y_pred - y_true) / 7::DOUBLE), 6) AS hc_penalty FROM predictions GROUP BY model""")
def agg15_hc_penalty(spark, sf):
    return M.hc_penalty(_preds(spark, sf), ["model"])


# ---------------------------------------------------------- confusion matrices
_CM_LONG = f"""WITH {P},
lab AS (SELECT model, y_true AS l FROM predictions UNION SELECT model, y_pred FROM predictions),
grid AS (SELECT a.model, a.l AS y_true, b.l AS y_pred FROM lab a JOIN lab b ON a.model = b.model),
cnt AS (SELECT model, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL),
cm AS (SELECT g.model, g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
       FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.y_true = c.y_true AND g.y_pred = c.y_pred)"""


@query("agg16_confusion_matrix", _CM_LONG + " SELECT * FROM cm")
def agg16_confusion_matrix(spark, sf):
    return M.confusion_long(_preds(spark, sf), ["model"])


_WIDE_LABELS = list(range(-1, 7))


def _wname(v):
    return f"pred_m{-v}" if v < 0 else f"pred_{v}"


@query("agg16_confusion_wide", _CM_LONG + " SELECT model, y_true, " + ", ".join(
    f"CAST(sum(CASE WHEN y_pred = {v} THEN n ELSE 0 END) AS BIGINT) AS {_wname(v)}" for v in _WIDE_LABELS)
    + ", CAST(sum(CASE WHEN y_pred NOT BETWEEN -1 AND 6 THEN n ELSE 0 END) AS BIGINT) AS pred_other FROM cm GROUP BY model, y_true")
def agg16_confusion_wide(spark, sf):
    w = M.confusion_wide(_preds(spark, sf), ["model"], _WIDE_LABELS)
    return w.select("model", "y_true", *[F.col(str(v)).cast("long").alias(_wname(v)) for v in _WIDE_LABELS], F.col("other").alias("pred_other"))


@query("agg17_confusion_normalised", _CM_LONG +
       " SELECT model, y_true, y_pred, n, CAST(printf('%.2f', n::DOUBLE / sum(n) OVER (PARTITION BY model) * 100) AS DOUBLE) AS pct FROM cm")
def agg17_confusion_normalised(spark, sf):
    return M.confusion_normalised(_preds(spark, sf), ["model"])


@query("agg18_confusion_sum_folds", f"""WITH {P}
SELECT model, y_true, y_pred, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT fold) AS BIGINT) AS n_folds
FROM predictions GROUP BY model, y_true, y_pred""")
def agg18_confusion_sum_folds(spark, sf):
    return M.confusion_sum_folds(_preds(spark, sf), ["model"])


# ------------------------------------------------------------------- k-fold
_FOLDM = f"""WITH {P}, {_dist(['model', 'fold'])}, {_label_stats(['model', 'fold'])},
fm AS (SELECT d.model, d.fold, d.accuracy, f1.f1_weighted, d.hc_base, d.hc_w2
       FROM dist d JOIN f1 ON d.model = f1.model AND d.fold = f1.fold)"""


@query("agg19_kfold_mean_std", _FOLDM + """
SELECT model, CAST(count(*) AS BIGINT) AS n_folds,
  round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
  round(avg(f1_weighted), 6) AS f1_weighted_mean, round(stddev_pop(f1_weighted), 6) AS f1_weighted_std,
  round(avg(hc_base), 6) AS hc_base_mean, round(stddev_pop(hc_base), 6) AS hc_base_std,
  round(avg(hc_w2), 6) AS hc_w2_mean, round(stddev_pop(hc_w2), 6) AS hc_w2_std
FROM fm GROUP BY model""")
def agg19_kfold_mean_std(spark, sf):
    return M.kfold_mean_std(_preds(spark, sf), ["model"])


def _sliced_preds(spark, sf):
    """JOIN5 input: predictions joined on the row's order to a length bucket of that order."""
    p = _preds(spark, sf)
    o = S.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_totalprice") / 200).cast("int").alias("tokens"))
    from complexa.functions.text import length_bucket
    o = o.select("order_id", length_bucket(F.col("tokens")).alias("len"))
    return p.join(o, "order_id").withColumn("cls", F.col("y_true"))


_SLICES = f"""WITH {P},
o AS (SELECT o_orderkey AS order_id, CAST(trunc(o_totalprice / 200) AS INTEGER) AS tokens FROM orders),
sp AS (SELECT p.*, CASE WHEN tokens < 256 THEN '256' WHEN tokens < 512 THEN '512'
                        WHEN tokens < 1024 THEN '1024' ELSE 'over' END AS len, y_true AS cls
       FROM predictions p JOIN o ON p.order_id = o.order_id),
sl AS (SELECT model, 'origin' AS slice, fold, count(*) AS n, sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS hit FROM sp GROUP BY model, fold
       UNION ALL SELECT model, 'len=' || len, fold, count(*), sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) FROM sp GROUP BY model, len, fold
       UNION ALL SELECT model, 'cls=' || CAST(cls AS VARCHAR), fold, count(*), sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) FROM sp GROUP BY model, cls, fold),
fa AS (SELECT s.model, s.slice, s.fold, w.n AS fold_rows, CAST(s.n AS BIGINT) AS n, CAST(printf('%.2f', s.hit * 100::DOUBLE / s.n) AS DOUBLE) AS acc
       FROM sl s JOIN sl w ON w.slice = 'origin' AND w.model = s.model AND w.fold = s.fold)"""


@query("join05_slice_predictions", _SLICES + " SELECT model, slice, fold, CAST(fold_rows AS BIGINT) AS fold_rows, n, acc FROM fa")
def join05_slice_predictions(spark, sf):
    return M.slice_accuracy(_sliced_preds(spark, sf), ["len", "cls"], ["model"]) \
        .withColumn("fold_rows", F.col("fold_rows").cast("long"))


@query("agg20_kfold_weighted", _SLICES + """
SELECT model, slice, CAST(printf('%.2f', sum(acc * fold_rows) / sum(fold_rows)) AS DOUBLE) AS acc_mean,
       CAST(printf('%.2f', stddev_pop(acc)) AS DOUBLE) AS acc_std, CAST(count(*) AS BIGINT) AS n_folds
FROM fa GROUP BY model, slice""")
def agg20_kfold_weighted(spark, sf):
    fa = M.slice_accuracy(_sliced_preds(spark, sf), ["len", "cls"], ["model"])
    return M.kfold_weighted(fa, ["model", "slice"])


@query("agg21_iteration_average", _FOLDM + """
SELECT model, round(avg(accuracy), 6) AS accuracy_avg, round(avg(f1_weighted), 6) AS f1_weighted_avg,
       CAST(count(*) AS BIGINT) AS n_runs FROM fm GROUP BY model""")
def agg21_iteration_average(spark, sf):
    runs = M.fold_metrics(_preds(spark, sf), ["model"])
    return M.iteration_average(runs, ["model"], ["accuracy", "f1_weighted"])


@query("agg23_dataset_stats", f"""WITH {CORPUS}
SELECT label, lang, CAST(count(*) AS BIGINT) AS n, grouping_id(label, lang) AS level
FROM corpus GROUP BY CUBE (label, lang)""")
def agg23_dataset_stats(spark, sf):
    return M.dataset_stats(S.corpus(spark, sf), "label", "lang")


# --------------------------------------------------------- reports, leaderboards
_REPORT_G = ["model", "tuned", "lang"]
_REPORT = f"""WITH {P}, {_dist(_REPORT_G)}, {_label_stats(_REPORT_G)},
rep AS (SELECT d.model, d.tuned, d.lang, d.n_rows, {_rnd(DIST_COLS + CLS_COLS, 'd.')}, {_rnd(F1_COLS, 'f1.')}, f1.n_labels
        FROM dist d JOIN f1 ON d.model = f1.model AND d.tuned = f1.tuned AND d.lang = f1.lang)"""


@query("agg24_score_report", _REPORT + " SELECT * FROM rep")
def agg24_score_report(spark, sf):
    return M.score_report(_preds(spark, sf), _REPORT_G)


_BOARD = _REPORT + """,
board AS (SELECT model, tuned, CAST(printf('%.1f', avg(accuracy) * 100) AS DOUBLE) AS acc_pct,
                 CAST(printf('%.1f', avg(f1_weighted) * 100) AS DOUBLE) AS f1_pct,
                 CAST(printf('%.1f', avg(hc_base) * 100) AS DOUBLE) AS hc_pct FROM rep GROUP BY model, tuned)"""


def _board(spark, sf):
    return M.leaderboard(M.score_report(_preds(spark, sf), _REPORT_G), "model", ["tuned"])


@query("agg25_leaderboard", _BOARD + " SELECT * FROM board")
def agg25_leaderboard(spark, sf):
    return _board(spark, sf)


@query("agg26_tuning_gap", _BOARD + """
SELECT b.model, b.acc_pct AS acc_pct_base, b.f1_pct AS f1_pct_base, b.hc_pct AS hc_pct_base,
       t.acc_pct AS acc_pct_tuned, t.f1_pct AS f1_pct_tuned, t.hc_pct AS hc_pct_tuned,
       CAST(printf('%.1f', t.acc_pct - b.acc_pct) AS DOUBLE) AS acc_pct_gap, CAST(printf('%.1f', t.f1_pct - b.f1_pct) AS DOUBLE) AS f1_pct_gap,
       CAST(printf('%.1f', t.hc_pct - b.hc_pct) AS DOUBLE) AS hc_pct_gap,
       CAST(printf('%.1f', b.hc_pct - b.f1_pct) AS DOUBLE) AS f1_hc_gap_base, CAST(printf('%.1f', t.hc_pct - t.f1_pct) AS DOUBLE) AS f1_hc_gap_tuned
FROM board b JOIN board t ON b.model = t.model AND b.tuned = 0 AND t.tuned = 1""")
def agg26_tuning_gap(spark, sf):
    return M.tuning_gap(_board(spark, sf), "model", "tuned")


@query("win15_leaderboard_rank", _BOARD + """
SELECT *, rank() OVER (PARTITION BY tuned ORDER BY f1_pct DESC) AS f1_pct_rank FROM board""")
def win15_leaderboard_rank(spark, sf):
    return M.leaderboard_rank(_board(spark, sf), "f1_pct", ["tuned"])


@query("win13_best_epoch", """WITH lg AS (
  SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS epoch,
         value AS acc FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY acc DESC, epoch) AS rn FROM lg)
SELECT run, epoch, acc FROM r WHERE rn = 1""")
def win13_best_epoch(spark, sf):
    log = S.epoch_log(spark, sf)
    return M.best_event(log, ["run"], ["ts", "event_id"], "acc")
