"""Label, extraction and chat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from complexa.functions import chat as C
from complexa.functions.extract import assistant_segment, extract_complexity, model_name, report_title
from complexa.functions.labels import mapped_rank, t_label, t_name, text_to_rank
from complexa.operators import metrics as M
from complexa.operators.refine import refine_responses, refined_predictions
from complexa.plans import standins as S
from complexa.plans.registry import CORPUS, PREDICTIONS, query
from complexa.functions.text import PY_SPACE


def _strip(x: str) -> str:
    """Python str.strip() in DuckDB SQL (trim of the whitespace character set)."""
    return f"trim({x}, '{PY_SPACE}')"


def _lst(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RESPONSES = f"""responses AS (
  SELECT l_orderkey AS idx, l_linenumber AS line_no, {_lst(S.MODEL_IDS)}[l_linenumber % 4 + 1] AS model_id,
         'Estimate the complexity of program ' || CAST(l_partkey AS VARCHAR) || {_lst(S.MODEL_MARKERS)}[l_linenumber % 4 + 1]
         || {_lst(S.PHRASES)}[(l_partkey + l_suppkey) % 12 + 1] AS response
  FROM lineitem)"""

EXAMPLES = """examples AS (
  SELECT o_orderkey AS idx,
         'The time complexity is: ' || ['constant','logn','linear','nlogn','quadratic','cubic','exponential'][o_custkey % 7 + 1] || ': end' AS content
  FROM orders)"""

# The oracle follows the reference's procedure literally (index comparison of the two lists).
REFINED = RESPONSES + ",\n" + EXAMPLES + """,
seg AS (SELECT idx, line_no, model_id, lower(CASE
          WHEN contains(model_id, 'gemma') THEN string_split(response, '<end_of_turn>')[-1]
          WHEN contains(model_id, 'Llama') THEN string_split(response, '<|eot_id|>')[-1]
          WHEN contains(model_id, 'Mistral') THEN string_split(response, '[/INST]')[-1]
          WHEN contains(model_id, 'Qwen') THEN string_split(response, '<|im_end|>')[-1] END) AS responce
        FROM responses),
cs AS (SELECT *, CASE WHEN contains(responce, 'overall time') THEN string_split(responce, 'overall time')[2]
                      ELSE string_split(responce, 'complexity')[2] END AS ct FROM seg),
tx AS (SELECT *,
   CASE WHEN contains(ct, 'exponential') THEN 'exponential' WHEN contains(ct, 'cubic') THEN 'cubic'
        WHEN contains(ct, 'quadratic') THEN 'quadratic' WHEN contains(ct, 'nlogn') THEN 'nlogn'
        WHEN contains(ct, 'linear') THEN 'linear' WHEN contains(ct, 'logn') THEN 'logn'
        WHEN contains(ct, 'constant') THEN 'constant' ELSE 'ERROR' END AS t_text,
   CASE WHEN contains(ct, 'np') THEN 'exponential' WHEN contains(ct, '2^n') THEN 'exponential'
        WHEN contains(ct, 'n^3') THEN 'cubic' WHEN contains(ct, 'n^2') THEN 'quadratic'
        WHEN contains(ct, 'n log n') THEN 'nlogn' WHEN contains(ct, 'o(n)') THEN 'linear'
        WHEN contains(ct, 'log n') THEN 'logn' WHEN contains(ct, 'o(1)') THEN 'constant' ELSE 'ERROR' END AS t_sym
   FROM cs),
ext AS (SELECT *, CASE WHEN ct IS NULL THEN 'NO RESPONCE'
   WHEN t_text = 'ERROR' AND t_sym = 'ERROR' THEN 'ERROR' WHEN t_text = 'ERROR' THEN t_sym WHEN t_sym = 'ERROR' THEN t_text
   WHEN list_position(['exponential','cubic','quadratic','nlogn','linear','logn','constant'], t_text)
      < list_position(['exponential','exponential','cubic','quadratic','nlogn','linear','logn','constant'], t_sym)
   THEN t_text ELSE t_sym END AS complexity FROM tx),
refined AS (SELECT e.idx, e.line_no, e.model_id, e.responce, e.complexity,
                   """ + _strip("string_split(x.content, ':')[2]") + """ AS answer, x.idx IS NOT NULL AS has_example
            FROM ext e LEFT JOIN examples x ON e.idx = x.idx)"""

_RANK_CASE = """CASE lower({x})
  WHEN 'logarithmic' THEN 1 WHEN 'o(1)' THEN 0 WHEN 'o(log n)' THEN 1 WHEN 'n' THEN 2 WHEN 'o(n log n)' THEN 3
  WHEN 'n^2' THEN 4 WHEN 'n^3' THEN 5 WHEN 'np' THEN 6 WHEN 'factorial' THEN 6
  WHEN 'error' THEN {u} WHEN 'no responce' THEN {u} WHEN 'polynomial' THEN {u}
  WHEN 'constant' THEN 0 WHEN 'logn' THEN 1 WHEN 'linear' THEN 2 WHEN 'nlogn' THEN 3 WHEN 'quadratic' THEN 4
  WHEN 'cubic' THEN 5 WHEN 'exponential' THEN 6 END"""


def _rank_sql(x, u=-1):
    return _RANK_CASE.format(x=x, u=u)


def _refined(spark, sf):
    return refine_responses(S.responses(spark, sf), S.examples(spark, sf))


# ------------------------------------------------------------------ labels
@query("prj01_encode_label", f"""WITH {CORPUS}
SELECT label, ['constant','linear','logn','quadratic','cubic','nlogn','np'][label + 1] AS name,
       CAST(count(*) AS BIGINT) AS n FROM corpus GROUP BY label""")
def prj01_encode_label(spark, sf):
    c = S.corpus(spark, sf).withColumn("name", t_name("label"))
    # round trip name -> id must give the label back; a mismatch would show as a null id
    c = c.withColumn("label", t_label("name"))
    return c.groupBy("label", "name").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("prj02_text_to_rank", f"""WITH {REFINED}, sp AS (SELECT complexity AS spelling FROM refined UNION ALL SELECT answer FROM refined)
SELECT spelling, CAST({_rank_sql('spelling')} AS INTEGER) AS rank, CAST(count(*) AS BIGINT) AS n FROM sp GROUP BY spelling""")
def prj02_text_to_rank(spark, sf):
    r = _refined(spark, sf)
    sp = r.select(F.explode(F.array("complexity", "answer")).alias("spelling"))
    return sp.groupBy("spelling").agg(F.count(F.lit(1)).cast("long").alias("n")) \
             .withColumn("rank", text_to_rank("spelling"))


@query("prj03_text_to_rank_err", f"""WITH {REFINED}
SELECT complexity, CAST({_rank_sql('complexity', 7)} AS INTEGER) AS rank, CAST(count(*) AS BIGINT) AS n
FROM refined GROUP BY complexity""")
def prj03_text_to_rank_err(spark, sf):
    r = _refined(spark, sf)
    return r.groupBy("complexity").agg(F.count(F.lit(1)).cast("long").alias("n")) \
            .withColumn("rank", text_to_rank("complexity", unscored=7))


@query("prj13_map_rank", f"""WITH {PREDICTIONS}
SELECT y_pred, [0,1,2,3,4,6,8][y_pred + 1] AS mapped, CAST(count(*) AS BIGINT) AS n FROM predictions GROUP BY y_pred""")
def prj13_map_rank(spark, sf):
    p = S.predictions(spark, sf)
    return p.groupBy("y_pred").agg(F.count(F.lit(1)).cast("long").alias("n")).withColumn("mapped", mapped_rank("y_pred"))


# -------------------------------------------------------------- extraction
@query("prj10_assistant_segment", f"WITH {REFINED} SELECT idx, line_no, model_id, responce FROM refined")
def prj10_assistant_segment(spark, sf):
    r = S.responses(spark, sf)
    return r.select("idx", "line_no", "model_id", assistant_segment("response", "model_id").alias("responce"))


@query("prj11_extract_complexity", f"WITH {REFINED} SELECT idx, line_no, complexity FROM refined")
def prj11_extract_complexity(spark, sf):
    r = S.responses(spark, sf)
    return r.select("idx", "line_no", extract_complexity(assistant_segment("response", "model_id")).alias("complexity"))


@query("prj12_model_name", f"""WITH {RESPONSES}
SELECT model_id, string_split(model_id, '/')[-1] AS model, model_id || '-pretrained with corpus' AS title,
       CAST(count(*) AS BIGINT) AS n FROM responses GROUP BY model_id""")
def prj12_model_name(spark, sf):
    r = S.responses(spark, sf).groupBy("model_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return r.select("model_id", model_name("model_id").alias("model"),
                    report_title("model_id", F.lit(1)).alias("title"), "n")


@query("join01_pair_responses", f"SELECT idx, line_no, model_id, answer, complexity, has_example FROM (WITH {REFINED} SELECT * FROM refined)")
def join01_pair_responses(spark, sf):
    return _refined(spark, sf).select("idx", "line_no", "model_id", "answer", "complexity", "has_example")


@query("agg24_score_responses", f"""WITH {REFINED},
predictions AS (SELECT string_split(model_id, '/')[-1] AS model, CAST({_rank_sql(_strip('answer'))} AS INTEGER) AS y_true,
                       CAST({_rank_sql(_strip('complexity'))} AS INTEGER) AS y_pred FROM refined)
SELECT model, CAST(count(*) AS BIGINT) AS n_rows, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy,
  round(avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE 1 - abs(y_pred - y_true) / 6::DOUBLE END), 6) AS hc_base,
  round(avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE greatest(1 - abs(y_pred - y_true) / 2::DOUBLE, 0) END), 6) AS hc_w2
FROM predictions GROUP BY model""")
def agg24_score_responses(spark, sf):
    """Entry point A end to end: responses -> refine -> encode -> metrics per model."""
    preds = refined_predictions(_refined(spark, sf))
    return M.hc_scores(preds, ["model"]).select("model", "n_rows", "accuracy", "hc_base", "hc_w2")


# --------------------------------------------------------------------- chat
@query("prj09_expected_answer", """WITH la AS (
  SELECT conv_id, arg_max(text, turn) AS content FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, """ + _strip("string_split(content, ':')[2]") + """ AS answer, length(content) AS n_chars FROM la""")
def prj09_expected_answer(spark, sf):
    c = S.chat(spark, sf).filter(F.col("role") == "assistant")
    la = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("content"))
    from complexa.functions.extract import expected_answer
    return la.select("conv_id", expected_answer("content").alias("answer"), F.length("content").cast("long").alias("n_chars"))


@query("prj14_remove_assistant", """SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
  string_agg(role, ',' ORDER BY turn) AS roles FROM conversations WHERE role <> 'assistant' GROUP BY conv_id""")
def prj14_remove_assistant(spark, sf):
    m = C.messages(S.chat(spark, sf)).select("conv_id", C.remove_assistant("messages").alias("m"))
    return m.filter(F.size("m") > 0).select(
        "conv_id", F.size("m").cast("long").alias("n_messages"),
        F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"))


_MERGE = """g AS (SELECT *, coalesce(sum(CASE WHEN role IN ('system', 'user') THEN 0 ELSE 1 END)
         OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
       FROM conversations),
u AS (SELECT conv_id, grp, string_agg(text, '' ORDER BY turn) AS utext FROM g WHERE role IN ('system', 'user') GROUP BY ALL),
o AS (SELECT conv_id, grp, role, text FROM g WHERE role NOT IN ('system', 'user')),
merged AS (
  SELECT o.conv_id, o.grp * 2 AS pos, 'user' AS role, coalesce(u.utext, '') AS text FROM o LEFT JOIN u USING (conv_id, grp)
  UNION ALL SELECT conv_id, grp * 2 + 1, role, text FROM o
  UNION ALL SELECT u.conv_id, u.grp * 2, 'user', u.utext FROM u
     WHERE u.utext <> '' AND NOT EXISTS (SELECT 1 FROM o WHERE o.conv_id = u.conv_id AND o.grp = u.grp))"""


@query("prj15_merge_user_turns", f"WITH {_MERGE} SELECT conv_id, CAST(pos AS BIGINT) AS pos, role, md5(text) AS text_md5, length(text) AS n_chars FROM merged")
def prj15_merge_user_turns(spark, sf):
    m = C.merge_user_turns(S.chat(spark, sf))
    return m.select("conv_id", F.col("pos").cast("long").alias("pos"), "role",
                    F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


_RENDER = """rendered AS (SELECT conv_id, string_agg(CASE role WHEN 'system' THEN text
      WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' || text || '<|eot_id|>'
      WHEN 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' || text || '<|eot_id|>' ELSE '' END, '' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id)"""


@query("prj16_render_chat", f"WITH {_RENDER} SELECT conv_id, md5(text) AS text_md5, length(text) AS n_chars FROM rendered")
def prj16_render_chat(spark, sf):
    """PRJ16 + PRJ20: render the messages, then drop the message column."""
    m = C.messages(S.chat(spark, sf)).withColumn("text", C.render_chat("messages")).drop("messages")
    return m.select("conv_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("prj17_truncate_messages", """SELECT conv_id, CAST(sum(length(left(text, 2048))) AS BIGINT) AS n_chars,
  md5(string_agg(left(text, 2048), '|' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id""")
def prj17_truncate_messages(spark, sf):
    m = C.messages(S.chat(spark, sf)).select("conv_id", C.truncate_messages("messages").alias("m"))
    contents = F.transform("m", lambda x: x["content"])
    return m.select("conv_id",
                    F.aggregate(contents, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"),
                    F.md5(F.array_join(contents, "|")).alias("text_md5"))


@query("prj18_truncate_pad", """SELECT conv_id, turn, array_to_string(
  CASE WHEN len(ids) >= 512 THEN ids[1:512] ELSE list_concat(ids, list_transform(range(512 - len(ids)), lambda x: 0)) END, ',') AS ids
FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations)""")
def prj18_truncate_pad(spark, sf):
    c = S.chat(spark, sf)
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    # the reference's code-length limit (512 tokens); ids here are word lengths of the message
    return c.select("conv_id", "turn", F.array_join(C.truncate_pad(ids, 512, 0).cast("array<string>"), ",").alias("ids"))


@query("prj19_argmax", """SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred
FROM embeddings""")
def prj19_argmax(spark, sf):
    e = S.table(spark, sf, "embeddings")
    return e.select("vec_id", "label", C.argmax("embedding").alias("pred"))


@query("win12_pack_sequences", f"""WITH {_RENDER},
s AS (SELECT string_agg(text, '' ORDER BY conv_id) AS t FROM rendered),
b AS (SELECT CAST(r.range AS BIGINT) AS block, substr(s.t, CAST(r.range * 2048 + 1 AS BIGINT), 2048) AS text
      FROM s, range(0, CAST(ceil(length(s.t) / 2048) AS BIGINT)) r)
SELECT block, md5(text) AS text_md5, length(text) AS n_chars FROM b""")
def win12_pack_sequences(spark, sf):
    r = C.messages(S.chat(spark, sf)).select("conv_id", C.render_chat("messages").alias("text"))
    p = C.pack_sequences(r, "conv_id", "text", 2048, range_size=64)
    return p.select(F.col("block").cast("long").alias("block"), F.md5("text").alias("text_md5"),
                    F.length("text").cast("long").alias("n_chars"))


@query("prj20_drop_columns", f"WITH {_RENDER} SELECT conv_id, length(text) AS n_chars, md5(text) AS text_md5 FROM rendered")
def prj20_drop_columns(spark, sf):
    """PRJ20: after rendering, the message column is dropped (only id and text remain)."""
    m = C.messages(S.chat(spark, sf)).withColumn("text", C.render_chat("messages")).drop("messages")
    return m.select("conv_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("join01_missing_responses", f"""WITH {RESPONSES}, {EXAMPLES.replace("examples AS (", "ex AS (")}
SELECT idx FROM ex WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.idx = ex.idx)""")
def join01_missing_responses(spark, sf):
    """JOIN1: examples without a response (a missing response file in the reference's layout)."""
    from complexa.operators.refine import missing_responses
    return missing_responses(S.examples(spark, sf), S.responses(spark, sf)).select("idx")
