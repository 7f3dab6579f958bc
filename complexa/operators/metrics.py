"""Prediction scoring (AGG6-26, JOIN5, WIN13, WIN15).

Design: every metric of a score report is a function of the confusion
counts.  ``confusion_cells`` is a single partial+final hash aggregate over
the prediction table (map-side combine, so a hot model or class never
moves more than one row per task and cell); everything after it works on
at most 8 x 8 cells per group.  No metric re-reads the predictions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complexa.functions.labels import mapped_rank, t_to_r
from complexa.functions.numbers import py_round

ROUND = 6


def _r(c: Column, digits: int | None = ROUND) -> Column:
    c = c.cast("double")
    return c if digits is None else F.round(c, digits)


def _g(groups: Sequence[str] | None) -> list[str]:
    return list(groups or [])


# --------------------------------------------------------------------------- cells
def confusion_cells(preds: DataFrame, groups: Sequence[str] | None = None,
                    y_true: str = "y_true", y_pred: str = "y_pred", order: str = "R") -> DataFrame:
    """(groups..., y_true, y_pred, n): one partial+final aggregate over the predictions.

    ``order``: 'R' = labels are complexity ranks (scoring order); 'T' = labels are
    training ids (T-order), remapped to ranks before scoring; 'T-parity' = T-order
    ids scored as they are (what the classical-model evaluation of the reference does).
    Rows without a label or prediction are no cells (``encode_with_quarantine`` reports them).
    """
    g = _g(groups)
    t, p = F.col(y_true), F.col(y_pred)
    if order == "T":
        t = t_to_r(t)
        p = F.when(p == -1, p).otherwise(t_to_r(p))
    elif order not in ("R", "T-parity"):
        raise ValueError(f"unknown label order {order!r}")
    known = preds.filter(F.col(y_true).isNotNull() & F.col(y_pred).isNotNull())
    return (known.groupBy(*g, t.cast("int").alias("y_true"), p.cast("int").alias("y_pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def distance_sums(cells: DataFrame, groups: Sequence[str] | None = None,
                  digits: int | None = ROUND) -> DataFrame:
    """Accuracy, HC (base, w=2, w=3) and mapped HC (/8, w=2, w=3), one row per group.

    FLT3: an unscored prediction (-1) adds 0 to every distance score but stays
    in the denominator.
    """
    g = _g(groups)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    d = F.abs(p - t).cast("double")
    md = F.abs(mapped_rank(p) - mapped_rank(t)).cast("double")
    scored = p != -1

    def wsum(expr: Column) -> Column:
        return F.sum(F.when(scored, expr * n).otherwise(F.lit(0.0)))

    tot = F.sum(n)
    return cells.groupBy(*g).agg(
        tot.cast("long").alias("n_rows"),
        _r(F.sum(F.when(t == p, n).otherwise(0)) / tot, digits).alias("accuracy"),
        _r(wsum(1 - d / 6.0) / tot, digits).alias("hc_base"),
        _r(wsum(F.greatest(1 - d / 2.0, F.lit(0.0))) / tot, digits).alias("hc_w2"),
        _r(wsum(F.greatest(1 - d / 3.0, F.lit(0.0))) / tot, digits).alias("hc_w3"),
        _r(wsum(1 - md / 8.0) / tot, digits).alias("hc_map_base"),
        _r(wsum(F.greatest(1 - md / 2.0, F.lit(0.0))) / tot, digits).alias("hc_map_w2"),
        _r(wsum(F.greatest(1 - md / 3.0, F.lit(0.0))) / tot, digits).alias("hc_map_w3"),
    )


def per_label(cells: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """(groups..., label, support, predicted, tp) over the union of true and predicted labels."""
    g = _g(groups)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    sides = F.array(
        F.struct(t.alias("label"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(t == p, n).otherwise(F.lit(0).cast("long")).alias("tp")),
        F.struct(p.alias("label"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    )
    return (cells.select(*g, F.inline(sides))
            .groupBy(*g, "label")
            .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
                 F.sum("tp").alias("tp")))


def f1_scores(cells: DataFrame, groups: Sequence[str] | None = None,
              digits: int | None = ROUND) -> DataFrame:
    """AGG7-10: weighted / macro / micro F1, weighted precision (0/0 -> 1) and recall."""
    g = _g(groups)
    lab = per_label(cells, g)
    s, pc, tp = F.col("support"), F.col("predicted"), F.col("tp")
    f1 = F.when(s + pc > 0, 2.0 * tp / (s + pc)).otherwise(F.lit(0.0))
    prec = F.when(pc > 0, tp / pc).otherwise(F.lit(1.0))
    rec = F.when(s > 0, tp / s).otherwise(F.lit(0.0))
    return lab.groupBy(*g).agg(
        _r(F.sum(f1 * s) / F.sum(s), digits).alias("f1_weighted"),
        _r(F.avg(f1), digits).alias("f1_macro"),
        _r(F.sum(tp) / F.sum(s), digits).alias("f1_micro"),
        _r(F.sum(prec * s) / F.sum(s), digits).alias("precision_weighted"),
        _r(F.sum(rec * s) / F.sum(s), digits).alias("recall_weighted"),
        F.count(F.lit(1)).cast("long").alias("n_labels"),
    )


def class_accuracy(cells: DataFrame, groups: Sequence[str] | None = None,
                   classes: int = 7, digits: int | None = ROUND) -> DataFrame:
    """AGG11: one-vs-rest accuracy (TP+TN)/N of classes 0..6, one column each."""
    g = _g(groups)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    tot = F.sum(n)
    cols = [_r(1 - F.sum(F.when((t == i) != (p == i), n).otherwise(0)) / tot, digits).alias(f"class_acc_{i}")
            for i in range(classes)]
    return cells.groupBy(*g).agg(*cols)


def report_from_cells(cells: DataFrame, groups: Sequence[str] | None = None, digits: int | None = ROUND,
                      classes: int = 7) -> DataFrame:
    """AGG6-14 from the confusion cells in one chain: cells -> per-label rows -> one row per group.

    Every cell is split into a true-side and a predicted-side label row; the
    true side also carries the cell's distance-score sums, so the per-label
    table holds everything: N = sum(support), accuracy = sum(tp) / N, HC sums,
    class accuracy 1 - (support + predicted - 2 tp) / N and the F1 family.  No
    branch of the plan re-reads the cells, and nothing is joined.
    """
    g = _g(groups)
    t, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    d = F.abs(p - t).cast("double")
    md = F.abs(mapped_rank(p) - mapped_rank(t)).cast("double")
    scored = p != -1
    zero = F.lit(0.0)

    def w(expr: Column) -> Column:
        return F.when(scored, expr * n).otherwise(zero)

    hc = {"hc_base": w(1 - d / 6.0), "hc_w2": w(F.greatest(1 - d / 2.0, zero)), "hc_w3": w(F.greatest(1 - d / 3.0, zero)),
          "hc_map_base": w(1 - md / 8.0), "hc_map_w2": w(F.greatest(1 - md / 2.0, zero)),
          "hc_map_w3": w(F.greatest(1 - md / 3.0, zero))}
    lz = F.lit(0).cast("long")
    true_side = F.struct(t.alias("label"), n.alias("support"), lz.alias("predicted"),
                         F.when(t == p, n).otherwise(lz).alias("tp"), *[v.alias(k) for k, v in hc.items()])
    pred_side = F.struct(p.alias("label"), lz.alias("support"), n.alias("predicted"), lz.alias("tp"),
                         *[zero.alias(k) for k in hc])
    lab = (cells.select(*g, F.inline(F.array(true_side, pred_side)))
           .groupBy(*g, "label")
           .agg(F.sum("support").alias("s"), F.sum("predicted").alias("pc"), F.sum("tp").alias("tp"),
                *[F.sum(k).alias(k) for k in hc]))
    s, pc, tp = F.col("s"), F.col("pc"), F.col("tp")
    tot = F.sum(s)
    f1 = F.when(s + pc > 0, 2.0 * tp / (s + pc)).otherwise(zero)
    prec = F.when(pc > 0, tp / pc).otherwise(F.lit(1.0))
    rec = F.when(s > 0, tp / s).otherwise(zero)
    aggs = [tot.cast("long").alias("n_rows"), _r(F.sum(tp) / tot, digits).alias("accuracy")]
    aggs += [_r(F.sum(k) / tot, digits).alias(k) for k in hc]
    aggs += [_r(F.sum(f1 * s) / tot, digits).alias("f1_weighted"), _r(F.avg(f1), digits).alias("f1_macro"),
             _r(F.sum(tp) / tot, digits).alias("f1_micro"), _r(F.sum(prec * s) / tot, digits).alias("precision_weighted"),
             _r(F.sum(rec * s) / tot, digits).alias("recall_weighted"), F.count(F.lit(1)).cast("long").alias("n_labels")]
    aggs += [_r(1 - F.sum(F.when(F.col("label") == i, s + pc - 2 * tp).otherwise(lz)) / tot, digits).alias(f"class_acc_{i}")
             for i in range(classes)]
    return lab.groupBy(*g).agg(*aggs)


def score_report(preds: DataFrame, groups: Sequence[str] = ("model",), digits: int | None = ROUND,
                 order: str = "R") -> DataFrame:
    """AGG24: one row per group with every metric of the report (AGG6-14).

    One scan of the predictions, one partial+final aggregate to the cells,
    then the single-chain ``report_from_cells``.
    """
    g = list(groups)
    return report_from_cells(confusion_cells(preds, g, order=order), g, digits)


# ----------------------------------------------------------------- single metrics
def accuracy(preds: DataFrame, groups=None) -> DataFrame:
    """AGG6."""
    g = _g(groups)
    return distance_sums(confusion_cells(preds, g), g).select(*g, "n_rows", "accuracy")


def hc_scores(preds: DataFrame, groups=None) -> DataFrame:
    """AGG12-14."""
    g = _g(groups)
    return distance_sums(confusion_cells(preds, g), g)


def hc_penalty(preds: DataFrame, groups=None, n_classes: int = 7) -> DataFrame:
    """AGG15: the README form, mean of |p - r| / number of classes (a penalty)."""
    g = _g(groups)
    cells = confusion_cells(preds, g)
    d = F.abs(F.col("y_pred") - F.col("y_true")).cast("double")
    return cells.groupBy(*g).agg(
        _r(F.sum(d / float(n_classes) * F.col("n")) / F.sum("n")).alias("hc_penalty"))


# ------------------------------------------------------------ confusion matrices
def confusion_long(preds: DataFrame, groups=None) -> DataFrame:
    """AGG16 (long form): labels = sorted union of true and predicted, zero-filled.

    The label grid is generated per group from its (at most 8) labels with two
    ``explode`` generators, never a join of the data with itself.
    """
    g = _g(groups)
    cells = confusion_cells(preds, g)
    labels = (cells.select(*g, F.inline(F.array(F.struct(F.col("y_true").alias("l")),
                                                F.struct(F.col("y_pred").alias("l")))))
              .groupBy(*g).agg(F.sort_array(F.collect_set("l")).alias("labels")))
    grid = (labels.select(*g, F.explode("labels").alias("y_true"), "labels")
            .select(*g, "y_true", F.explode("labels").alias("y_pred")))
    return (grid.join(cells, g + ["y_true", "y_pred"], "left")
            .select(*g, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_wide(preds: DataFrame, groups=None, labels: Sequence[int] = tuple(range(-1, 8))) -> DataFrame:
    """AGG16 (display form): one row per true label, one column per predicted label, and ``other``
    for predictions outside the list."""
    g = _g(groups)
    long = confusion_long(preds, g)

    def count(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(0)).cast("long")

    return long.groupBy(*g, "y_true").agg(*[count(F.col("y_pred") == v).alias(str(v)) for v in labels],
                                          count(~F.col("y_pred").isin(*labels)).alias("other"))


def confusion_normalised(preds: DataFrame, groups=None) -> DataFrame:
    """AGG17: cell / grand total as a percent with 2 decimals (window over the tiny matrix)."""
    g = _g(groups)
    long = confusion_long(preds, g)
    w = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    # as a '.2%' format: the share times 100, rounded the way Python prints it
    share = long.withColumn("_share", F.col("n") / F.sum("n").over(w))
    return share.withColumn("pct", py_round(F.col("_share") * 100.0, 2)).drop("_share")


def confusion_sum_folds(preds: DataFrame, groups=None, fold: str = "fold") -> DataFrame:
    """AGG18: the sum of per-fold matrices equals the matrix of pooled pairs."""
    g = _g(groups)
    per_fold = confusion_cells(preds, g + [fold])
    return (per_fold.groupBy(*g, "y_true", "y_pred")
            .agg(F.sum("n").cast("long").alias("n"), F.countDistinct(fold).cast("long").alias("n_folds")))


# --------------------------------------------------------------- fold statistics
def fold_metrics(preds: DataFrame, groups=None, fold: str = "fold") -> DataFrame:
    """Per (group, fold): rows, accuracy, weighted F1, HC base, HC w=2 (ML9 metrics)."""
    g = _g(groups) + [fold]
    return report_from_cells(confusion_cells(preds, g), g, digits=None).select(
        *g, "n_rows", "accuracy", "hc_base", "hc_w2", "f1_weighted")


def kfold_mean_std(preds: DataFrame, groups=None, fold: str = "fold") -> DataFrame:
    """AGG19: mean and population std over folds of each fold metric."""
    g = _g(groups)
    fm = fold_metrics(preds, g, fold)
    aggs = []
    for m in ("accuracy", "f1_weighted", "hc_base", "hc_w2"):
        aggs += [_r(F.avg(m)).alias(f"{m}_mean"), _r(F.stddev_pop(m)).alias(f"{m}_std")]
    return fm.groupBy(*g).agg(F.count(F.lit(1)).cast("long").alias("n_folds"), *aggs)


def kfold_weighted(fold_acc: DataFrame, groups=None, acc: str = "acc", size: str = "fold_rows") -> DataFrame:
    """AGG20: mean weighted by full-fold size, unweighted population std; both rounded 2.

    ``fold_acc`` holds per (group, slice, fold) accuracies in percent (already
    rounded to 2 decimals) and the size of the *whole* test fold.
    """
    g = _g(groups)
    r = fold_acc.groupBy(*g).agg(
        (F.sum(F.col(acc) * F.col(size)) / F.sum(size)).alias("_m"),
        F.stddev_pop(acc).alias("_s"),
        F.count(F.lit(1)).cast("long").alias("n_folds"))
    return r.select(*g, py_round("_m", 2).alias("acc_mean"), py_round("_s", 2).alias("acc_std"), "n_folds")


def slice_accuracy(preds: DataFrame, slices: Sequence[str], groups=None, fold: str = "fold") -> DataFrame:
    """JOIN5 + AGG20 input: per-fold accuracy (percent, 2 decimals) for the whole fold and
    for every slice column, in one GROUPING SETS aggregate; the weight is the whole
    test fold's size (a window over the fold's total row)."""
    g = _g(groups)
    keys = g + [fold] + list(slices)
    sets = [g + [fold]] + [g + [fold, s] for s in slices]
    agg = (preds.groupingSets(sets, *keys)
           .agg(F.count(F.lit(1)).alias("n"),
                F.sum(F.when(F.col("y_true") == F.col("y_pred"), 1).otherwise(0)).alias("hit"),
                *[F.grouping(s).alias(f"_g_{s}") for s in slices]))
    name = F.lit("origin")
    for s in reversed(list(slices)):
        name = F.when(F.col(f"_g_{s}") == 0, F.concat(F.lit(f"{s}="), F.col(s).cast("string"))) \
                .otherwise(name)
    agg = agg.withColumn("slice", name)
    whole = agg.filter(F.col("slice") == "origin").select(*g, fold, F.col("n").alias("fold_rows"))
    return (agg.join(whole, g + [fold])
            .select(*g, "slice", fold, "fold_rows", F.col("n").cast("long").alias("n"),
                    py_round(F.col("hit") * 100.0 / F.col("n"), 2).alias("acc")))


def iteration_average(runs: DataFrame, groups=("model",), metrics=("accuracy",)) -> DataFrame:
    """AGG21: average of repeated runs."""
    return runs.groupBy(*groups).agg(*[_r(F.avg(m)).alias(f"{m}_avg") for m in metrics],
                                     F.count(F.lit(1)).cast("long").alias("n_runs"))


def failure_ledger(df: DataFrame, job: str, failed: Column) -> DataFrame:
    """AGG22: failed / total per augmentation job."""
    return df.groupBy(job).agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.sum(failed.cast("int")).cast("long").alias("failed"),
        _r(F.avg(failed.cast("double"))).alias("failed_share"))


def dataset_stats(df: DataFrame, cls: str = "label", lang: str = "lang") -> DataFrame:
    """AGG23: class x language counts with totals (ROLLUP-like CUBE with grouping ids)."""
    return (df.cube(cls, lang).agg(F.count(F.lit(1)).cast("long").alias("n"),
                                   F.grouping_id().alias("level")))


# ------------------------------------------------------------------ leaderboards
def leaderboard(report: DataFrame, model: str = "model", by: Sequence[str] = ("tuned",)) -> DataFrame:
    """AGG25: percent with 1 decimal, per-model mean over languages."""
    keys = [model] + list(by)
    r = report.groupBy(*keys).agg(*[(F.avg(m) * 100).alias(f"_{m}") for m in ("accuracy", "f1_weighted", "hc_base")])
    return r.select(*keys, py_round("_accuracy", 1).alias("acc_pct"), py_round("_f1_weighted", 1).alias("f1_pct"),
                    py_round("_hc_base", 1).alias("hc_pct"))


def tuning_gap(board: DataFrame, model: str = "model", flag: str = "tuned") -> DataFrame:
    """AGG26: base vs tuned rows of the same model, difference columns."""
    base = board.filter(F.col(flag) == 0).select(
        model, *[F.col(c).alias(f"{c}_base") for c in ("acc_pct", "f1_pct", "hc_pct")])
    tuned = board.filter(F.col(flag) == 1).select(
        model, *[F.col(c).alias(f"{c}_tuned") for c in ("acc_pct", "f1_pct", "hc_pct")])
    out = base.join(tuned, model)
    for c in ("acc_pct", "f1_pct", "hc_pct"):
        out = out.withColumn(f"{c}_gap", py_round(F.col(f"{c}_tuned") - F.col(f"{c}_base"), 1))
    return out.withColumn("f1_hc_gap_base", py_round(F.col("hc_pct_base") - F.col("f1_pct_base"), 1)) \
              .withColumn("f1_hc_gap_tuned", py_round(F.col("hc_pct_tuned") - F.col("f1_pct_tuned"), 1))


def leaderboard_rank(board: DataFrame, metric: str, partition: Sequence[str] = ()) -> DataFrame:
    """WIN15: rank by score descending; rank 1 is the bold cell."""
    w = Window.partitionBy(*partition).orderBy(F.col(metric).desc()) if partition else \
        Window.partitionBy(F.lit(0)).orderBy(F.col(metric).desc())
    return board.withColumn(f"{metric}_rank", F.rank().over(w).cast("long"))


def best_epoch(log: DataFrame, key: Sequence[str], epoch: str = "epoch", metric: str = "acc",
               higher_is_better: bool = True) -> DataFrame:
    """WIN13: earliest epoch with the strictly best metric (ties keep the first).

    A hash aggregate (``min`` over a (-metric, epoch) struct), so a long run
    is combined map-side instead of sorted in one window partition.
    """
    m = -F.col(metric) if higher_is_better else F.col(metric)
    best = log.groupBy(*key).agg(F.min(F.struct(m.alias("_m"), F.col(epoch).alias("_e"))).alias("_b"))
    sign = -1 if higher_is_better else 1
    return best.select(*key, F.col("_b._e").alias(epoch), (F.col("_b._m") * sign).alias(metric))


def best_event(log: DataFrame, key: Sequence[str], order: Sequence[str], metric: str = "acc") -> DataFrame:
    """WIN13 on a log without epoch numbers: the best row per key (earliest on ties) and its
    epoch = number of earlier rows of the key (a join of one row per key back to the log
    and a count), with no window over a whole key."""
    key, order = list(key), list(order)
    best = log.groupBy(*key).agg(F.min(F.struct((-F.col(metric)).alias("_m"), *[F.col(o) for o in order])).alias("_b"))
    best = best.select(*key, *[F.col(f"_b.{o}").alias(f"_b_{o}") for o in order], (-F.col("_b._m")).alias(metric))
    earlier = None
    for i, o in enumerate(order):
        cond = F.col(o) < F.col(f"_b_{o}")
        for p in order[:i]:
            cond = cond & (F.col(p) == F.col(f"_b_{p}"))
        earlier = cond if earlier is None else earlier | cond
    counts = (log.select(*key, *order).join(best.select(*key, *[f"_b_{o}" for o in order]), key)
              .groupBy(*key).agg(F.count_if(earlier).cast("int").alias("epoch")))
    return best.join(counts, key).select(*key, "epoch", metric)
