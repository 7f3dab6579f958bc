"""Source / sink round-trip queries: write a stand-in with the sink into a fresh
folder under the session's checkpoint directory, read it back with the source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from complexa.functions import chat as C
from complexa.functions.labels import R_ORDER
from complexa.functions.text import length_bucket, token_count
from complexa.operators import metrics as M
from complexa.operators import splits as SP
from complexa.plans import standins as S
from complexa.plans.q_extract import REFINED, _RENDER, _refined
from complexa.plans.q_scoring import _dist, _label_stats
from complexa.plans.q_splits import _BUCKET, _FOLDS
from complexa.plans.registry import CORPUS, PREDICTIONS, query
from complexa.session import scratch_path
from complexa.sources import io as IO


def _tmp(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


_R_NAMES = "[" + ", ".join(f"'{n}'" for n in R_ORDER) + "]"


@query("src01_read_corpus", f"""SELECT {_R_NAMES}[n_chars % 7 + 1] AS complexity, source AS problem, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(*) * 2 AS BIGINT) AS n_tags FROM documents GROUP BY ALL""")
def src01_read_corpus(spark, sf):
    d = S.table(spark, sf, "documents")
    c = d.select(F.col("text").alias("src"), F.get(F.array(*[F.lit(n) for n in R_ORDER]), (F.col("n_chars") % 7).cast("int")).alias("complexity"),
                 F.col("source").alias("problem"), F.col("lang").alias("from"),
                 F.concat_ws(",", "lang", F.lit(""), "source").alias("tags"))
    path = _tmp(spark, "corpus")
    c.write.mode("overwrite").json(path)
    r = IO.read_corpus(spark, path)
    return r.groupBy("complexity", "problem").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                                  F.sum(F.length("src")).cast("long").alias("chars"),
                                                  F.sum(F.size("tag_list")).cast("long").alias("n_tags"))


@query("src02_read_labelled", """SELECT CAST(n_chars % 7 AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def src02_read_labelled(spark, sf):
    d = S.table(spark, sf, "documents")
    path = _tmp(spark, "labelled")
    d.select((F.col("n_chars") % 7).cast("string").alias("label"), F.col("text").alias("src")).write.mode("overwrite").json(path)
    r = IO.read_labelled(spark, path)
    return r.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.length("src")).cast("long").alias("chars"))


@query("src03_read_chat", """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn,
  role, md5(text) AS content_md5 FROM conversations""")
def src03_read_chat(spark, sf):
    m = C.messages(S.chat(spark, sf)).withColumn("conv_id", F.col("conv_id").cast("string"))
    path = _tmp(spark, "chat")
    m.write.mode("overwrite").json(path)
    r = IO.chat_long(IO.read_chat(spark, path))
    return r.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role",
                    F.md5("content").alias("content_md5"))


@query("src04_read_raw_responses", f"WITH {_RENDER} SELECT conv_id AS idx, md5(text) AS response_md5, length(text) AS n_chars FROM rendered")
def src04_read_raw_responses(spark, sf):
    r = C.messages(S.chat(spark, sf)).select(F.col("conv_id").alias("idx"), C.render_chat("messages").alias("text"))
    path = _tmp(spark, "raw")
    r.select("idx", IO.raw_response_text(F.col("text")).alias("value")).write.mode("overwrite").partitionBy("idx").text(path)
    back = IO.read_raw_responses(spark, path)
    return back.select("idx", F.md5("response").alias("response_md5"), F.length("response").cast("long").alias("n_chars"))


@query("src05_read_refined", f"WITH {REFINED} SELECT string_split(model_id, '/')[-1] AS model, complexity, CAST(count(*) AS BIGINT) AS n, "
       "CAST(count(answer) AS BIGINT) AS n_answer FROM refined GROUP BY ALL")
def src05_read_refined(spark, sf):
    from complexa.functions.extract import model_name
    r = _refined(spark, sf).select(model_name("model_id").alias("model"), "answer", "complexity", "responce")
    path = _tmp(spark, "refined")
    r.write.mode("overwrite").partitionBy("model").json(path)
    back = IO.read_refined(spark, path).withColumn(
        "model", F.regexp_extract(F.col("_metadata.file_path"), r"model=([^/]+)", 1))
    return back.groupBy("model", "complexity").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                                   F.count("answer").cast("long").alias("n_answer"))


@query("src06_read_tsv", """SELECT CAST(n_chars % 7 AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def src06_read_tsv(spark, sf):
    d = S.table(spark, sf, "documents").select((F.col("n_chars") % 7).cast("int").alias("label"), F.col("text").alias("code"))
    path = _tmp(spark, "tsv")
    d.write.mode("overwrite").option("sep", "\t").option("escape", '"').option("quoteAll", True).csv(path)
    r = IO.read_tsv(spark, path)
    return r.groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.length("code")).cast("long").alias("chars"))


@query("src07_read_tags", """SELECT tag, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT trim(unnest(string_split(p_type, ' '))) AS tag FROM part) WHERE tag <> '' GROUP BY tag""")
def src07_read_tags(spark, sf):
    p = S.table(spark, sf, "part")
    return IO.read_tags(p.select("p_partkey", "p_type"), "p_type", " ").groupBy("tag").agg(
        F.count(F.lit(1)).cast("long").alias("n"))


_G = ["model", "tuned", "lang"]
_REPORT_RAW = f"""WITH {PREDICTIONS}, {_dist(_G)}, {_label_stats(_G)},
rep AS (SELECT d.*, f1.f1_weighted, f1.f1_micro, f1.f1_macro,
   d.model || CASE WHEN d.tuned = 1 THEN '-pretrained' ELSE '' END AS title
   FROM dist d JOIN f1 ON d.model = f1.model AND d.tuned = f1.tuned AND d.lang = f1.lang)"""


def _report_df(spark, sf):
    preds = S.predictions(spark, sf)
    rep = M.score_report(preds, _G, digits=None)
    title = F.concat(F.col("model"), F.when(F.col("tuned") == 1, F.lit("-pretrained")).otherwise(F.lit("")))
    return rep.withColumn("title", title).withColumn("report", IO.report_text(F.col("title")))


_PRINTF_REPORT = ("title || ' with corpus' || chr(10) || 'Scores' || chr(10) || 'acc: ' || printf('%.3f', accuracy) || "
                  "', f1 score: ' || printf('%.3f', f1_weighted) || chr(10) || 'base: ' || printf('%.3f', hc_base) || ', exp 2: ' || "
                  "printf('%.3f', hc_w2) || ', exp 3: ' || printf('%.3f', hc_w3) || chr(10) || 'Scores with [0,1,2,3,4,6,8]' || chr(10) || "
                  "'base: ' || printf('%.3f', hc_map_base) || ', exp 2: ' || printf('%.3f', hc_map_w2) || ', exp 3: ' || printf('%.3f', hc_map_w3) "
                  "|| chr(10) || " + " || ".join(f"printf('%.1f', class_acc_{i} * 100) || ' &'" for i in range(7))
                  + " || printf('%.1f', f1_micro * 100) || ' &' || printf('%.1f', f1_macro * 100) || chr(10)")


@query("snk04_write_score_report", _REPORT_RAW + f" SELECT model, tuned, lang, {_PRINTF_REPORT} AS report FROM rep")
def snk04_write_score_report(spark, sf):
    rep = _report_df(spark, sf)
    out = rep.select("model", "tuned", "lang", "report")
    path = _tmp(spark, "reports")
    IO.write_score_report(out.withColumn("report_key", F.concat_ws("_", "model", "tuned", "lang")), path)
    return out


@query("src08_read_score_reports", _REPORT_RAW + """ SELECT title, CAST(printf('%.3f', accuracy) AS DOUBLE) AS accuracy, CAST(printf('%.3f', f1_weighted) AS DOUBLE) AS f1_weighted, CAST(printf('%.3f', hc_base) AS DOUBLE) AS hc_base, CAST(printf('%.3f', hc_w2) AS DOUBLE) AS hc_w2, CAST(printf('%.3f', hc_w3) AS DOUBLE) AS hc_w3, CAST(printf('%.3f', hc_map_base) AS DOUBLE) AS hc_map_base, CAST(printf('%.3f', hc_map_w2) AS DOUBLE) AS hc_map_w2, CAST(printf('%.3f', hc_map_w3) AS DOUBLE) AS hc_map_w3,
  round(CAST(printf('%.1f', class_acc_0 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_1 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_2 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_3 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_4 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_5 * 100) AS DOUBLE) + CAST(printf('%.1f', class_acc_6 * 100) AS DOUBLE) + CAST(printf('%.1f', f1_micro * 100) AS DOUBLE) + CAST(printf('%.1f', f1_macro * 100) AS DOUBLE), 1) AS class_line_sum
FROM rep""")
def src08_read_score_reports(spark, sf):
    rep = _report_df(spark, sf).withColumn("report_key", F.concat_ws("_", "model", "tuned", "lang"))
    path = _tmp(spark, "reports")
    IO.write_score_report(rep.select("report_key", "report"), path)
    back = IO.read_score_reports(spark, path)
    return back.withColumn("class_line_sum", F.round(F.aggregate("class_line", F.lit(0.0), lambda a, x: a + x), 1)).drop("class_line")


@query("snk01_write_splits", _FOLDS + """,
m AS (SELECT a.doc_id, CAST(f.range AS INTEGER) AS f, CASE WHEN a.fold = f.range THEN 'test' ELSE 'train' END AS split FROM assigned a, range(4) f)
SELECT f, split, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL""")
def snk01_write_splits(spark, sf):
    from complexa.plans.q_splits import _assigned
    m = SP.fold_membership(_assigned(spark, sf), 4)
    m = m.select("doc_id", "label", F.col("f").cast("int").alias("f"),
                 F.when(F.col("is_test"), "test").otherwise("train").alias("split"))
    path = _tmp(spark, "splits")
    IO.write_splits(m, path, ("f", "split"))
    back = spark.read.schema("doc_id LONG, label INT").json(path)
    return back.groupBy(F.col("f").cast("int").alias("f"), "split").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("snk02_write_slices", f"""WITH {CORPUS} SELECT {_BUCKET} AS bucket, CAST(count(*) AS BIGINT) AS n,
  CAST(sum(length(src)) AS BIGINT) AS chars FROM corpus GROUP BY 1""")
def snk02_write_slices(spark, sf):
    c = S.corpus(spark, sf).select("src", "label", length_bucket(token_count("src")).alias("bucket"))
    path = _tmp(spark, "slices")
    IO.write_splits(c, path, ("bucket",))
    back = spark.read.schema("src STRING, label INT").json(path)
    return back.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.length("src")).cast("long").alias("chars"))


@query("snk03_write_predictions", f"""WITH {PREDICTIONS} SELECT y_true, y_pred, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY ALL""")
def snk03_write_predictions(spark, sf):
    path = _tmp(spark, "preds")
    IO.write_predictions(S.predictions(spark, sf), path)
    back = IO.read_predictions(spark, path)
    return back.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("src07_read_tag_vocabulary", """SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS pos FROM (
  SELECT DISTINCT trim(unnest(string_split(p_type, ' '))) AS tag FROM part) WHERE tag <> ''""")
def src07_read_tag_vocabulary(spark, sf):
    p = S.table(spark, sf, "part")
    tags = IO.read_tags(p.select("p_type"), "p_type", " ")
    path = _tmp(spark, "vocab")
    IO.write_tag_vocabulary(tags, path)
    return IO.read_tag_vocabulary(spark, path).select("tag", F.col("pos").cast("int").alias("pos"))
