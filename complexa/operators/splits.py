"""Reproducible dataset partitioning (WIN1-9, WIN14, JOIN2-4, AGG1-5).

Randomness is replaced by md5 hash order, reproducible across engines,
runs and partition counts.  Every "take the first k of a class in random
order" becomes an exact rank by hash, computed without a window over a
whole class: ``hash_rank`` histograms each class into 2^16 hash bins (a
partial aggregate), prefix-sums the bin counts (a window over at most
65,536 rows per class) and ranks rows only inside one bin.  A class that
holds a third of the corpus is therefore spread over 65,536 window
partitions instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from complexa.functions.labels import t_name
from complexa.functions.numbers import py_round
from complexa.functions.text import length_bucket, token_count

HASH_BITS = 32
BIN_BITS = 16


def hash_order(seed, *cols) -> Column:
    """32-bit unsigned hash of ``seed|col...`` from md5: same value in Spark and DuckDB.

    ``seed`` is a literal or a Column (several seeds evaluated in one query)."""
    s = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [s] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def hash_rank(df: DataFrame, keys: Sequence[str], h: str, tiebreak: str, out: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row inside ``keys`` ordered by (h, tiebreak), distributed.

    rank = (rows of the same keys in lower bins) + row_number inside the bin.
    """
    keys = list(keys)
    shift = HASH_BITS - BIN_BITS
    d = df.withColumn("_bin", F.shiftright(F.col(h), shift))
    counts = d.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_bn"))
    wk = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_bn").over(wk), F.lit(0)))
    inner = Window.partitionBy(*keys, "_bin").orderBy(h, tiebreak)
    return (d.join(counts.select(*keys, "_bin", "_before"), keys + ["_bin"])
            .withColumn(out, (F.col("_before") + F.row_number().over(inner)).cast("long"))
            .drop("_bin", "_before"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n_class"))


def stratified_quota(df: DataFrame, label: str = "label", size: float = 0.8) -> DataFrame:
    """Per class test quota: n_test = ceil(n * (1 - size)) in doubles, split by largest remainder.

    Works on the class table (one row per class), never on the rows.
    """
    cc = class_counts(df, label)
    tot = Window.partitionBy(F.lit(0))
    n = F.sum("n_class").over(tot)
    n_test = F.ceil(n.cast("double") * F.lit(1.0 - size))
    share = F.col("n_class").cast("double") * n_test.cast("double") / n.cast("double")
    cc = cc.withColumn("_share", share).withColumn("_base", F.floor("_share").cast("long")) \
           .withColumn("_frac", F.col("_share") - F.col("_base")) \
           .withColumn("_left", (n_test - F.sum("_base").over(tot)).cast("long"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_frac").desc(), F.col(label).asc())
    return (cc.withColumn("_pos", F.row_number().over(order))
            .withColumn("quota", (F.col("_base") + F.when(F.col("_pos") <= F.col("_left"), 1).otherwise(0)).cast("long"))
            .select(label, "n_class", "quota"))


def stratified_split(df: DataFrame, id_col: str, label: str = "label", size: float = 0.8,
                     seed: int = 777) -> DataFrame:
    """WIN1: adds ``split`` = 'test' for the first ``quota`` rows of each class in hash order."""
    q = stratified_quota(df, label, size)
    r = hash_rank(df.withColumn("_h", hash_order(seed, id_col)), [label], "_h", id_col, "_rank")
    return (r.join(q.select(label, "quota"), label)
            .withColumn("split", F.when(F.col("_rank") <= F.col("quota"), "test").otherwise("train"))
            .drop("_h", "_rank", "quota"))


def fold_thresholds(n_problems: Column, size: float, n: int) -> list[Column]:
    """Cumulative fold ends of the shrinking pool: fold f takes int(|pool| * (1 - size))."""
    rem, ends, acc = n_problems, [], F.lit(0).cast("long")
    for _ in range(n - 1):
        k = F.floor(rem.cast("double") * F.lit(1.0 - size)).cast("long")
        acc = acc + k
        ends.append(acc)
        rem = rem - k
    return ends


def group_kfold(df: DataFrame, label: str = "label", group: str = "problem", size: float = 0.8,
                n: int = 4, seed: int = 770, mode: str = "shrinking") -> DataFrame:
    """WIN2: fold table (label, problem, fold) over the distinct problems of each class.

    ``shrinking`` (parity): fold f takes int(|remaining pool| * (1 - size)) problems in
    hash order, the last fold takes the rest.  ``balanced``: fold = (rank - 1) % n.
    """
    probs = df.select(label, group).distinct().withColumn("_h", hash_order(seed, label, group))
    r = hash_rank(probs, [label], "_h", group, "_rank")
    if mode == "balanced":
        return r.select(label, group, ((F.col("_rank") - 1) % n).cast("int").alias("fold"))
    sizes = probs.groupBy(label).agg(F.count(F.lit(1)).alias("_np"))
    ends = fold_thresholds(F.col("_np"), size, n)
    sizes = sizes.select(label, *[e.alias(f"_end{i}") for i, e in enumerate(ends)])
    fold = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        fold = F.when(F.col("_rank") <= F.col(f"_end{i}"), F.lit(i)).otherwise(fold)
    return (r.join(sizes, label)
            .select(label, group, fold.cast("int").alias("fold")))


def group_kfold_retry(df: DataFrame, label: str = "label", group: str = "problem", size: float = 0.8,
                      n: int = 4, seeds: Sequence[int] = tuple(range(770, 780))) -> DataFrame:
    """WIN2 + WIN3 with retries: the fold table of the first seed (in list order) whose
    checked folds (all but the last) keep the class's train-row share inside
    (0.8 * size, 1.2 * size).  A class with no accepted seed is returned with the
    first seed and ``accepted`` false: callers must not use its folds (see ``accepted_folds``).

    All seeds are evaluated in one query (problems x seeds rows, ranked per
    (class, seed) with ``hash_rank``); the choice is a ``min`` per class.
    Returns (label, problem, fold, seed, accepted).
    """
    seeds = list(seeds)
    probs = df.select(label, group).distinct()
    per_seed = probs.select(label, group, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    per_seed = per_seed.withColumn("_h", hash_order(F.col("seed"), label, group))
    r = hash_rank(per_seed, [label, "seed"], "_h", group, "_rank")
    sizes = probs.groupBy(label).agg(F.count(F.lit(1)).alias("_np"))
    ends = fold_thresholds(F.col("_np"), size, n)
    sizes = sizes.select(label, *[e.alias(f"_end{i}") for i, e in enumerate(ends)])
    fold = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        fold = F.when(F.col("_rank") <= F.col(f"_end{i}"), F.lit(i)).otherwise(fold)
    folds = r.join(sizes, label).select(label, group, "seed", fold.cast("int").alias("fold"))
    rows = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("_rows"))
    per_fold = (folds.join(rows, [label, group]).groupBy(label, "seed", "fold").agg(F.sum("_rows").alias("_test")))
    w = Window.partitionBy(label, "seed")
    share = 1 - F.col("_test") / F.sum("_test").over(w)
    ok = (share < F.lit(size * 1.2)) & (share > F.lit(size * 0.8))
    verdict = (per_fold.withColumn("_ok", ok | (F.col("fold") == n - 1))
               .groupBy(label, "seed").agg(F.min(F.col("_ok").cast("int")).alias("_all")))
    pos = F.array_position(F.array(*[F.lit(s) for s in seeds]), F.col("seed"))
    choice = verdict.groupBy(label).agg(
        F.min(F.when(F.col("_all") == 1, pos)).alias("_first_ok"))
    choice = choice.select(label, F.coalesce("_first_ok", F.lit(1)).alias("_pos"), F.col("_first_ok").isNotNull().alias("accepted"))
    chosen = choice.select(label, F.get(F.array(*[F.lit(s) for s in seeds]), F.col("_pos") - 1).alias("seed"), "accepted")
    return folds.join(chosen, [label, "seed"]).select(label, group, "fold", "seed", "accepted")


def accepted_folds(folds: DataFrame) -> DataFrame:
    """The fold table without its flags; raises if a class has no accepted split."""
    left = [r[0] for r in folds.filter(~F.col("accepted")).select(folds.columns[0]).distinct().limit(20).collect()]
    if left:
        raise ValueError(f"no accepted split for classes {left}: give more seeds or another size")
    return folds.drop("seed", "accepted")


def assign_fold(df: DataFrame, folds: DataFrame, label: str = "label", group: str = "problem") -> DataFrame:
    """JOIN2: each row gets the fold in which it is test (equi-join on (label, problem))."""
    return df.join(folds, [label, group], "left")


def fold_membership(assigned: DataFrame, n: int) -> DataFrame:
    """JOIN2/JOIN3 long form: every row once per fold with is_test; train(f) = not test(f)."""
    return (assigned.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            .withColumn("is_test", F.col("f") == F.col("fold")))


def train_complement(df: DataFrame, test: DataFrame, key: Sequence[str]) -> DataFrame:
    """JOIN3: train(f) = rows not in test(f)."""
    return df.join(test.select(*key), list(key), "left_anti")


def train_rows(assigned: DataFrame, n: int) -> DataFrame:
    """JOIN3 from the fold column alone: a row trains every fold but its own (no join)."""
    return assigned.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(~F.col("f").eqNullSafe(F.col("fold")))


def pool_difference(pool: DataFrame, taken: DataFrame, key: Sequence[str]) -> DataFrame:
    """JOIN4: problems left in the pool after a fold has been taken."""
    return pool.join(taken.select(*key), list(key), "left_anti")


def fold_acceptance(assigned: DataFrame, label: str = "label", size: float = 0.8) -> DataFrame:
    """WIN3: per (class, fold) train-row share and whether it lies in (0.8*size, 1.2*size)."""
    per = assigned.groupBy(label, "fold").agg(F.count(F.lit(1)).alias("test_rows"))
    w = Window.partitionBy(label)
    per = per.withColumn("class_rows", F.sum("test_rows").over(w))
    share = (F.col("class_rows") - F.col("test_rows")).cast("double") / F.col("class_rows").cast("double")
    return per.select(label, "fold", F.col("test_rows").cast("long"), F.col("class_rows").cast("long"),
                      F.round(share, 6).alias("train_share"),
                      ((share < F.lit(size * 1.2)) & (share > F.lit(size * 0.8))).alias("accepted"))


def resample_to(df: DataFrame, id_col: str, target: int, seed: int = 777) -> DataFrame:
    """WIN4: ``target`` draws with replacement, uniform over the rows, reproducible.

    Rows get a dense rank by hash (distributed); draw i picks rank
    hash(seed, i) mod N + 1; the draws are joined back on the rank.  Rank and draw
    ids only; give the other columns back with a join on the id.
    """
    ranked = hash_rank(df.withColumn("_h", hash_order(seed, id_col)).withColumn("_k", F.lit(0)),
                       ["_k"], "_h", id_col, "_rank").drop("_h")
    total = ranked.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    draws = (spark.range(target).withColumnRenamed("id", "draw").withColumn("_k", F.lit(0))
             .join(total, "_k")
             .withColumn("_rank", (hash_order(f"{seed}-draw", "draw") % F.col("_n") + 1).cast("long")))
    return ranked.join(draws, ["_k", "_rank"]).drop("_k", "_n", "_rank")


def mutation_count(id_col: str, lo: int, hi: int, seed: int = 777) -> Column:
    """WIN5: per-row uniform integer in [lo, hi] from the row's hash."""
    return (F.lit(lo) + hash_order(f"{seed}-mut", id_col) % F.lit(hi - lo + 1)).cast("int")


def shuffle_order(df: DataFrame, id_col: str, seed: int = 777) -> DataFrame:
    """WIN14: training order = hash order; ``pos`` is a dense, distributed position."""
    d = df.withColumn("_h", hash_order(seed, id_col)).withColumn("_k", F.lit(0))
    return hash_rank(d, ["_k"], "_h", id_col, "pos").drop("_h", "_k")


def extend_dataset(a: DataFrame, b: DataFrame) -> DataFrame:
    """WIN9: UNION ALL by name."""
    return a.unionByName(b)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG1: share per class rounded to 3."""
    cc = class_counts(df, label)
    cc = cc.withColumn("_share", F.col("n_class") / F.sum("n_class").over(Window.partitionBy(F.lit(0))))
    return cc.select(label, t_name(label).alias("name"), "n_class", py_round("_share", 3).alias("share"))


def split_ratio(assigned: DataFrame, n: int) -> DataFrame:
    """AGG2: train / test rows and shares per fold."""
    m = fold_membership(assigned, n)
    r = m.groupBy("f").agg(
        F.count_if(~F.col("is_test")).cast("long").alias("train"),
        F.count_if(F.col("is_test")).cast("long").alias("test"),
        F.avg((~F.col("is_test")).cast("double")).alias("_tr"),
        F.avg(F.col("is_test").cast("double")).alias("_te"))
    return r.select("f", "train", "test", py_round("_tr", 3).alias("train_share"), py_round("_te", 3).alias("test_share"))


def length_bucket_stats(df: DataFrame, src: str = "src") -> DataFrame:
    """AGG3 + WIN7: rows and mean characters per token-length bucket."""
    b = df.select(length_bucket(token_count(src)).alias("bucket"), F.length(src).alias("chars"))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                   F.round(F.avg("chars"), 6).alias("mean_chars"))


def class_bucket_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG4 + WIN8: rows per named class bucket."""
    return df.groupBy(t_name(label).alias("bucket")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def problems_per_class(df: DataFrame, label: str = "label", group: str = "problem") -> DataFrame:
    """AGG5: distinct problems and rows per class."""
    return df.groupBy(label).agg(F.countDistinct(group).cast("long").alias("n_problems"),
                                 F.count(F.lit(1)).cast("long").alias("n_rows"))
