"""Split, fold, resampling and bucket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from complexa.functions.labels import t_name
from complexa.functions.text import TOKEN, length_bucket, token_count
from complexa.operators import splits as SP
from complexa.plans import standins as S
from complexa.plans.registry import CORPUS, query


def _h(seed, *exprs):
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"('0x' || substr(md5({inner}), 1, 8))::BIGINT"


def _corpus(spark, sf):
    return S.corpus(spark, sf)


_STRAT = f"""WITH {CORPUS},
h AS (SELECT doc_id, label, {_h(777, 'doc_id')} AS h FROM corpus),
cc AS (SELECT label, count(*) AS n_class FROM corpus GROUP BY label),
t AS (SELECT sum(n_class) AS n, CAST(ceil(CAST(sum(n_class) AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS BIGINT) AS n_test FROM cc),
q1 AS (SELECT label, n_class, CAST(n_class AS DOUBLE) * t.n_test / t.n AS share FROM cc, t),
q2 AS (SELECT *, floor(share) AS base, share - floor(share) AS frac FROM q1),
q3 AS (SELECT *, row_number() OVER (ORDER BY frac DESC, label) AS pos,
              (SELECT n_test FROM t) - sum(base) OVER () AS lft FROM q2),
q AS (SELECT label, CAST(base + CASE WHEN pos <= lft THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q3),
r AS (SELECT h.*, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS rk FROM h),
st AS (SELECT doc_id, label, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q USING (label))"""


@query("win01_stratified_split", _STRAT + " SELECT * FROM st")
def win01_stratified_split(spark, sf):
    return SP.stratified_split(_corpus(spark, sf).select("doc_id", "label"), "doc_id", "label", 0.8, 777)


_FOLDS = f"""WITH {CORPUS},
ph AS (SELECT DISTINCT label, problem FROM corpus),
r AS (SELECT label, problem, row_number() OVER (PARTITION BY label ORDER BY {_h(770, 'label', 'problem')}, problem) AS rk,
             count(*) OVER (PARTITION BY label) AS np FROM ph),
k0 AS (SELECT *, floor(CAST(np AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a0 FROM r),
k1 AS (SELECT *, floor(CAST(np - a0 AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a1 FROM k0),
k2 AS (SELECT *, floor(CAST(np - a0 - a1 AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a2 FROM k1),
folds AS (SELECT label, problem, CAST(CASE WHEN rk <= a0 THEN 0 WHEN rk <= a0 + a1 THEN 1
                 WHEN rk <= a0 + a1 + a2 THEN 2 ELSE 3 END AS INTEGER) AS fold FROM k2),
assigned AS (SELECT c.doc_id, c.label, c.problem, f.fold FROM corpus c LEFT JOIN folds f USING (label, problem))"""


def _folds(spark, sf):
    return SP.group_kfold(_corpus(spark, sf), "label", "problem", 0.8, 4, 770)


def _assigned(spark, sf):
    c = _corpus(spark, sf).select("doc_id", "label", "problem")
    return SP.assign_fold(c, _folds(spark, sf))


@query("win02_group_kfold", _FOLDS + " SELECT * FROM folds")
def win02_group_kfold(spark, sf):
    return _folds(spark, sf)


@query("join02_assign_fold", _FOLDS + " SELECT * FROM assigned")
def join02_assign_fold(spark, sf):
    return _assigned(spark, sf)


@query("join03_train_complement", _FOLDS + """,
pairs AS (SELECT doc_id, f.range AS f FROM corpus, range(4) f)
SELECT CAST(p.f AS INTEGER) AS f, CAST(count(*) AS BIGINT) AS n_train FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM assigned a WHERE a.doc_id = p.doc_id AND a.fold = p.f) GROUP BY p.f""")
def join03_train_complement(spark, sf):
    train = SP.train_rows(_assigned(spark, sf), 4)
    return train.groupBy(F.col("f").cast("int").alias("f")).agg(F.count(F.lit(1)).cast("long").alias("n_train"))


@query("join04_pool_difference", _FOLDS + """
SELECT label, CAST(count(*) AS BIGINT) AS n_left FROM ph
WHERE NOT EXISTS (SELECT 1 FROM folds f WHERE f.fold = 0 AND f.label = ph.label AND f.problem = ph.problem) GROUP BY label""")
def join04_pool_difference(spark, sf):
    folds = _folds(spark, sf)
    pool = _corpus(spark, sf).select("label", "problem").distinct()
    left = SP.pool_difference(pool, folds.filter(F.col("fold") == 0), ["label", "problem"])
    return left.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n_left"))


@query("win03_fold_acceptance", _FOLDS + """,
per AS (SELECT label, fold, count(*) AS test_rows FROM assigned GROUP BY ALL),
pc AS (SELECT *, sum(test_rows) OVER (PARTITION BY label) AS class_rows FROM per)
SELECT label, fold, CAST(test_rows AS BIGINT) AS test_rows, CAST(class_rows AS BIGINT) AS class_rows,
  round(CAST(class_rows - test_rows AS DOUBLE) / class_rows, 6) AS train_share,
  (CAST(class_rows - test_rows AS DOUBLE) / class_rows < 0.8 * 1.2 AND CAST(class_rows - test_rows AS DOUBLE) / class_rows > 0.8 * 0.8) AS accepted
FROM pc""")
def win03_fold_acceptance(spark, sf):
    return SP.fold_acceptance(_assigned(spark, sf), "label", 0.8)


@query("agg01_class_distribution", f"""WITH {CORPUS}
SELECT label, ['constant','linear','logn','quadratic','cubic','nlogn','np'][label + 1] AS name, CAST(count(*) AS BIGINT) AS n_class,
       CAST(printf('%.3f', count(*) / sum(count(*)) OVER ()) AS DOUBLE) AS share FROM corpus GROUP BY label""")
def agg01_class_distribution(spark, sf):
    return SP.class_distribution(_corpus(spark, sf), "label")


@query("agg02_split_ratio", _FOLDS + """,
m AS (SELECT a.doc_id, f.range AS f, a.fold = f.range AS is_test FROM assigned a, range(4) f)
SELECT CAST(f AS INTEGER) AS f, CAST(count(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train,
       CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS test,
       CAST(printf('%.3f', avg(CASE WHEN is_test THEN 0.0 ELSE 1.0 END::DOUBLE)) AS DOUBLE) AS train_share,
       CAST(printf('%.3f', avg(CASE WHEN is_test THEN 1.0 ELSE 0.0 END::DOUBLE)) AS DOUBLE) AS test_share FROM m GROUP BY f""")
def agg02_split_ratio(spark, sf):
    return SP.split_ratio(_assigned(spark, sf), 4).withColumn("f", F.col("f").cast("int"))


_TOK = TOKEN.replace("'", "''")
_BUCKET = f"""CASE WHEN len(regexp_extract_all(src, '{_TOK}')) < 256 THEN '256'
  WHEN len(regexp_extract_all(src, '{_TOK}')) < 512 THEN '512'
  WHEN len(regexp_extract_all(src, '{_TOK}')) < 1024 THEN '1024' ELSE 'over' END"""


@query("agg03_length_bucket_stats", f"""WITH {CORPUS}
SELECT {_BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS n, round(avg(length(src)), 6) AS mean_chars FROM corpus GROUP BY 1""")
def agg03_length_bucket_stats(spark, sf):
    return SP.length_bucket_stats(_corpus(spark, sf), "src")


@query("win07_length_bucket", f"""WITH {CORPUS}
SELECT doc_id, CAST(len(regexp_extract_all(src, '{_TOK}')) AS INTEGER) AS tokens, {_BUCKET} AS bucket FROM corpus""")
def win07_length_bucket(spark, sf):
    c = _corpus(spark, sf)
    return c.select("doc_id", token_count("src").alias("tokens"), length_bucket(token_count("src")).alias("bucket"))


@query("agg04_class_bucket_counts", f"""WITH {CORPUS}
SELECT ['constant','linear','logn','quadratic','cubic','nlogn','np'][label + 1] AS bucket, CAST(count(*) AS BIGINT) AS n
FROM corpus GROUP BY 1""")
def agg04_class_bucket_counts(spark, sf):
    return SP.class_bucket_counts(_corpus(spark, sf), "label")


@query("win08_class_bucket", f"""WITH {CORPUS}
SELECT doc_id, ['constant','linear','logn','quadratic','cubic','nlogn','np'][label + 1] AS bucket FROM corpus""")
def win08_class_bucket(spark, sf):
    c = _corpus(spark, sf)
    return c.select("doc_id", t_name("label").alias("bucket"))


@query("agg05_problems_per_class", f"""WITH {CORPUS}
SELECT label, CAST(count(DISTINCT problem) AS BIGINT) AS n_problems, CAST(count(*) AS BIGINT) AS n_rows FROM corpus GROUP BY label""")
def agg05_problems_per_class(spark, sf):
    return SP.problems_per_class(_corpus(spark, sf), "label", "problem")


@query("win04_resample", f"""WITH {CORPUS},
r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h(777, 'doc_id')}, doc_id) AS rk FROM corpus),
n AS (SELECT count(*) AS n FROM corpus),
d AS (SELECT range AS draw, {_h('777-draw', 'range')} % n.n + 1 AS rk FROM range(10000), n)
SELECT draw, doc_id FROM d JOIN r USING (rk)""")
def win04_resample(spark, sf):
    return SP.resample_to(_corpus(spark, sf).select("doc_id"), "doc_id", 10000, 777)


@query("win05_mutation_count", f"""WITH {CORPUS}
SELECT doc_id, lang, CAST(CASE WHEN lang = 'en' THEN 1 + {_h('777-mut', 'doc_id')} % 5
                               ELSE 1 + {_h('777-mut', 'doc_id')} % 10 END AS INTEGER) AS n_mutations FROM corpus""")
def win05_mutation_count(spark, sf):
    c = _corpus(spark, sf)
    m = F.when(F.col("lang") == "en", SP.mutation_count("doc_id", 1, 5)).otherwise(SP.mutation_count("doc_id", 1, 10))
    return c.select("doc_id", "lang", m.alias("n_mutations"))


@query("win09_extend_dataset", """WITH u AS (
  SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark)
SELECT origin, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_after FROM u GROUP BY origin""")
def win09_extend_dataset(spark, sf):
    a = S.table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    b = S.table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    u = SP.extend_dataset(a, b)
    from pyspark.sql import Window
    return (u.groupBy("origin").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .withColumn("n_after", F.sum("n").over(Window.partitionBy(F.lit(0))).cast("long")))


@query("win14_shuffle", f"""WITH {CORPUS}
SELECT doc_id, row_number() OVER (ORDER BY {_h(777, 'doc_id')}, doc_id) AS pos FROM corpus""")
def win14_shuffle(spark, sf):
    return SP.shuffle_order(_corpus(spark, sf).select("doc_id"), "doc_id", 777)


_SEEDS = list(range(770, 780))
_RETRY = f"""WITH {CORPUS},
ph AS (SELECT DISTINCT label, problem FROM corpus),
ps AS (SELECT ph.*, s.seed FROM ph, (SELECT unnest({_SEEDS}) AS seed) s),
r AS (SELECT label, problem, seed,
             row_number() OVER (PARTITION BY label, seed ORDER BY ('0x' || substr(md5(CAST(seed AS VARCHAR) || '|' || CAST(label AS VARCHAR)
               || '|' || problem), 1, 8))::BIGINT, problem) AS rk,
             count(*) OVER (PARTITION BY label, seed) AS np FROM ps),
k0 AS (SELECT *, floor(CAST(np AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a0 FROM r),
k1 AS (SELECT *, floor(CAST(np - a0 AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a1 FROM k0),
k2 AS (SELECT *, floor(CAST(np - a0 - a1 AS DOUBLE) * (1 - CAST(0.8 AS DOUBLE))) AS a2 FROM k1),
folds AS (SELECT label, problem, seed, CAST(CASE WHEN rk <= a0 THEN 0 WHEN rk <= a0 + a1 THEN 1
                 WHEN rk <= a0 + a1 + a2 THEN 2 ELSE 3 END AS INTEGER) AS fold FROM k2),
rows_ AS (SELECT label, problem, count(*) AS n FROM corpus GROUP BY ALL),
pf AS (SELECT f.label, f.seed, f.fold, sum(r.n) AS test FROM folds f JOIN rows_ r USING (label, problem) GROUP BY ALL),
pf2 AS (SELECT *, 1 - test / sum(test) OVER (PARTITION BY label, seed) AS share FROM pf),
v AS (SELECT label, seed, bool_and(fold = 3 OR (share < 0.8 * 1.2 AND share > 0.8 * 0.8)) AS all_ok FROM pf2 GROUP BY ALL),
ch AS (SELECT label, coalesce(min(seed) FILTER (WHERE all_ok), {_SEEDS[0]}) AS seed, bool_or(all_ok) AS accepted FROM v GROUP BY label)
SELECT f.label, f.problem, f.fold, f.seed, ch.accepted FROM folds f JOIN ch USING (label, seed)"""


@query("win03_fold_retry", _RETRY)
def win03_fold_retry(spark, sf):
    return SP.group_kfold_retry(_corpus(spark, sf), "label", "problem", 0.8, 4, _SEEDS)


@query("win02_group_kfold_balanced", f"""WITH {CORPUS},
ph AS (SELECT DISTINCT label, problem FROM corpus),
r AS (SELECT label, problem, row_number() OVER (PARTITION BY label ORDER BY {_h(770, 'label', 'problem')}, problem) AS rk FROM ph)
SELECT label, problem, CAST((rk - 1) % 4 AS INTEGER) AS fold FROM r""")
def win02_group_kfold_balanced(spark, sf):
    """WIN2, balanced mode: problems dealt round-robin over the folds in hash order."""
    return SP.group_kfold(_corpus(spark, sf), "label", "problem", 0.8, 4, 770, mode="balanced")
