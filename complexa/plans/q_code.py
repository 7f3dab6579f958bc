"""Cleaning, quality-gate, feature and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from complexa.functions import features as FE
from complexa.functions import text as T
from complexa.operators import graph as G
from complexa.operators import metrics as M
from complexa.operators import quality as Q
from complexa.operators.splits import mutation_count
from complexa.plans import standins as S
from complexa.plans.registry import CALL_EDGES, PREDICTIONS, add_oracle, query


def _sql_str(s: str) -> str:
    """A DuckDB string expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _sql_list(values) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


NL = "chr(10)"
PROGRAMS = f"""pit AS (
  SELECT l_orderkey AS doc_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
            CAST(l_quantity AS INTEGER) % 8, l_tax > 0.07, l_discount < 0.05, l_extendedprice > 50000) AS i,
         CAST(l_quantity AS INTEGER) % 8 AS b, l_tax > 0.07 AS rec, l_discount < 0.05 AS call, l_extendedprice > 50000 AS big
  FROM lineitem),
pmeth AS (SELECT doc_id, i,
  '  static int m' || CAST(i AS VARCHAR) || CASE WHEN b = 3 THEN '(int n)' || {NL} || '  {{' ELSE '(int n) {{' END || {NL} || '    int s = 0;' || {NL} || '    '
    || {_sql_list(S.JAVA_BODIES)}[b + 1] || {NL}
    || CASE WHEN rec THEN '    s += m' || CAST(i AS VARCHAR) || '(n - 1);' || {NL} ELSE '' END
    || CASE WHEN call THEN '    return m' || CAST(i + 1 AS VARCHAR) || '(s);' || {NL} ELSE '    return s;' || {NL} END
    || '  }}' || {NL} AS jm,
  'def m' || CAST(i AS VARCHAR) || '(n):' || {NL} || '    s = 0' || {NL} || {_sql_list(S.PY_BODIES)}[b + 1] || {NL}
    || CASE WHEN rec THEN '    s += m' || CAST(i AS VARCHAR) || '(n - 1)' || {NL} ELSE '' END
    || CASE WHEN call THEN '    return m' || CAST(i + 1 AS VARCHAR) || '(s)' || {NL} ELSE '    return s' || {NL} END
    || CASE WHEN big THEN '    s = s + 1' || {NL} ELSE '' END AS pm
  FROM pit),
pagg AS (SELECT doc_id, string_agg(jm, '' ORDER BY i) AS jms, string_agg(pm, {NL} ORDER BY i) AS pms FROM pmeth GROUP BY doc_id),
whole AS (
  SELECT a.doc_id, CASE WHEN o.o_orderstatus = 'F' THEN 'java' ELSE 'python' END AS lang,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS label,
         CASE WHEN o.o_orderstatus = 'F' THEN
           'import java.util.*;' || {NL} || '// order ' || CAST(a.doc_id AS VARCHAR) || {NL} || 'public class C' || CAST(a.doc_id AS VARCHAR)
           || ' {{' || {NL} || a.jms || '  public static void main(String[] args) {{' || {NL} || '    int n = '
           || CAST(o.o_custkey % 100 AS VARCHAR) || ';' || {NL} || CASE WHEN a.doc_id % 14 = 0 THEN '    new Helper();' || {NL} ELSE '' END
           || '    System.out.println(m1(n));' || {NL} || '  }}' || {NL} || '}}' || {NL}
           || CASE WHEN a.doc_id % 7 = 0 THEN 'class Helper {{' || {NL} || '  int v = 1;' || {NL} || '}}' || {NL} ELSE '' END
         ELSE '# order ' || CAST(a.doc_id AS VARCHAR) || {NL} || a.pms || {NL} || {NL} || 'def main():' || {NL} || '    n = '
           || CAST(o.o_custkey % 100 AS VARCHAR) || {NL} || '    print(m1(n))' || {NL} END AS src,
         'c' || CAST(o.o_custkey AS VARCHAR) AS problem
  FROM pagg a JOIN orders o ON a.doc_id = o.o_orderkey),
programs AS (
  SELECT doc_id, lang, label,
         CASE WHEN doc_id % {S.EMPTY_EVERY} = 0 THEN CASE lang WHEN 'java' THEN '//' ELSE '#' END || ' nothing' || {NL}
              WHEN doc_id % {S.BROKEN_EVERY} = 0 THEN CASE lang WHEN 'java' THEN substr(src, 1, length(src) - 2) ELSE src || 'print((' || {NL} END
              ELSE src END AS src, problem
  FROM whole)""".replace("{{", "{").replace("}}", "}")


def _progs(spark, sf, lang=None):
    return S.programs(spark, sf, lang)


def _re(p: str) -> str:
    return p.replace("'", "''")


WSQ = T.WS  # literal whitespace characters, valid inside a DuckDB string
JAVA_RM = f"regexp_replace(src, '(?ms){_re(T.JAVA_COMMENT)}', '\\1', 'g')"
PY_RM = f"regexp_replace(src, '(?ms){_re(T.python_regex(T.PYTHON_COMMENT))}', '\\1', 'g')"


def _drop_blank(x: str) -> str:
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: trim(l, '{T.PY_SPACE}') <> ''), chr(10))"


# -------------------------------------------------------------- text cleaning
@query("prj04_remove_comments", f"""WITH {PROGRAMS},
r AS (SELECT doc_id, lang, CASE lang WHEN 'java' THEN {JAVA_RM} WHEN 'python' THEN {PY_RM} ELSE src END AS out FROM programs)
SELECT doc_id, lang, md5(out) AS out_md5, length(out) AS n_chars FROM r""")
def prj04_remove_comments(spark, sf):
    p = _progs(spark, sf)
    out = T.remove_comments("src", "lang")
    return p.select("doc_id", "lang", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


@query("prj04_remove_comments_prose", f"""WITH r AS (SELECT doc_id, CASE lang WHEN 'en' THEN regexp_replace(text, '(?ms){_re(T.JAVA_COMMENT)}', '\\1', 'g')
   WHEN 'fr' THEN regexp_replace(text, '(?ms){_re(T.python_regex(T.PYTHON_COMMENT))}', '\\1', 'g') ELSE text END AS out FROM documents)
SELECT doc_id, md5(out) AS out_md5, length(out) AS n_chars FROM r""")
def prj04_remove_comments_prose(spark, sf):
    """PRJ4 on the whole documents table (en read as java, fr as python, others unchanged)."""
    d = S.table(spark, sf, "documents")
    lang = F.when(F.col("lang") == "en", "java").when(F.col("lang") == "fr", "python").otherwise(F.col("lang"))
    out = T.remove_comments(F.col("text"), lang)
    return d.select("doc_id", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


_C_MARK = (f"regexp_replace(src, '(?ms)({_re(T.C_COMMENT)})|({_re(T.C_STRING)})', chr(1) || '\\1' || chr(2) || '\\2', 'g')")
_C_OUT = _drop_blank(f"replace(regexp_replace({_C_MARK}, chr(1) || '[^' || chr(2) || ']+' || chr(2), ' ', 'g'), chr(1) || chr(2), '')")


@query("prj05_strip_comments_c", f"""WITH {PROGRAMS}, r AS (SELECT doc_id, {_C_OUT} AS out FROM programs WHERE lang = 'java')
SELECT doc_id, md5(out) AS out_md5, length(out) AS n_chars FROM r""")
def prj05_strip_comments_c(spark, sf):
    p = _progs(spark, sf, "java")
    out = T.strip_comments_c("src")
    return p.select("doc_id", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


@query("prj06_strip_python_comments", f"""WITH {PROGRAMS}, r AS (SELECT doc_id, {_drop_blank(PY_RM)} AS out FROM programs WHERE lang = 'python')
SELECT doc_id, md5(out) AS out_md5, length(out) AS n_chars FROM r""")
def prj06_strip_python_comments(spark, sf):
    p = _progs(spark, sf, "python")
    out = T.strip_python_comments("src")
    return p.select("doc_id", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


@query("prj07_delete_import", f"""WITH {PROGRAMS},
r AS (SELECT doc_id, regexp_replace(regexp_replace(src, '{T.IMPORT_RULE}', '', 'g'), '{T.PACKAGE_RULE}', '', 'g') AS out FROM programs)
SELECT doc_id, md5(out) AS out_md5, length(out) AS n_chars FROM r""")
def prj07_delete_import(spark, sf):
    p = _progs(spark, sf)
    out = T.delete_import("src")
    return p.select("doc_id", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


@query("prj08_preprocess", f"""WITH {PROGRAMS},
r AS (SELECT lang, CASE lang WHEN 'java' THEN {JAVA_RM} WHEN 'python' THEN {PY_RM} ELSE src END AS out, src FROM programs)
SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(src) - length(out)) AS BIGINT) AS removed_chars FROM r GROUP BY lang""")
def prj08_preprocess(spark, sf):
    p = _progs(spark, sf).withColumn("out", T.remove_comments("src", "lang"))
    return p.groupBy("lang").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                 F.sum(F.length("src") - F.length("out")).cast("long").alias("removed_chars"))


@query("prj21_rename_identifiers")
def prj21_rename_identifiers(spark, sf):
    p = _progs(spark, sf)
    out = Q.rename_identifiers("src")
    return p.select("doc_id", "lang", F.md5(out).alias("out_md5"), F.length(out).cast("long").alias("n_chars"))


# -------------------------------------------------------------- quality gates
def _gate_sql(x: str) -> str:
    def cnt(ch):
        return f"(length({x}) - length(replace({x}, '{ch}', '')))"
    return (f"(length(regexp_replace({x}, '[{WSQ}]', '', 'g')) > 0 AND {cnt('(')} = {cnt(')')} "
            f"AND {cnt('{')} = {cnt('}')} AND {cnt('[')} = {cnt(']')})")


@query("flt01_delete_error", f"""WITH {PROGRAMS},
u AS (SELECT 'programs' AS origin, CASE lang WHEN 'java' THEN {JAVA_RM} ELSE {PY_RM} END AS s FROM programs
      UNION ALL SELECT 'documents', text FROM documents)
SELECT origin, CAST(count(*) FILTER (WHERE {_gate_sql('s')}) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE NOT {_gate_sql('s')}) AS BIGINT) AS rejected FROM u GROUP BY origin""")
def flt01_delete_error(spark, sf):
    p = _progs(spark, sf).select(F.lit("programs").alias("origin"), "src", "lang")
    d = S.table(spark, sf, "documents").select(F.lit("documents").alias("origin"), F.col("text").alias("src"),
                                               F.lit("other").alias("lang"))
    u = p.unionByName(d).withColumn("ok", Q.lexical_gate("src", "lang"))
    return u.groupBy("origin").agg(F.count_if("ok").cast("long").alias("kept"),
                                   F.count_if(~F.col("ok")).cast("long").alias("rejected"))


@query("flt03_skip_unscored", f"""WITH {PREDICTIONS}
SELECT model, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE y_pred = -1) AS BIGINT) AS n_unscored,
  round(avg(CASE WHEN y_pred = -1 THEN 0::DOUBLE ELSE 1 - abs(y_pred - y_true) / 6::DOUBLE END), 6) AS hc_base
FROM predictions GROUP BY model""")
def flt03_skip_unscored(spark, sf):
    p = S.predictions(spark, sf)
    hc = M.hc_scores(p, ["model"]).select("model", "n_rows", "hc_base")
    un = p.groupBy("model").agg(F.count_if(F.col("y_pred") == -1).cast("long").alias("n_unscored"))
    return hc.join(un, "model")


def _unreach_sql(x: str) -> str:
    """The unreachable-line fold over a text: facts of each line, then the state that runs over them."""
    code = f"regexp_replace(regexp_replace(l, '{_re(FE.LITERAL)}', '\"\"', 'g'), '#.*', '')"
    facts = f"""list_transform(string_split({x}, chr(10)), lambda l: {{'line': l, 'ind': length(regexp_extract(l, '^[{WSQ}]*')),
      'blank': NOT regexp_matches(l, '[^{WSQ}]'), 'net': length(regexp_replace({code}, '[^(\\[{{]', '', 'g')) - length(regexp_replace({code}, '[^)\\]}}]', '', 'g')),
      'more': regexp_matches({code}, '\\\\\\s*$'), 'term': regexp_matches(l, '^\\s*(return|raise|break|continue)\\b')}})"""
    inner = "(a.open > 0 OR a.more)"
    fresh = "coalesce(f.ind >= a.dead AND NOT f.blank, FALSE)"
    gone = f"CASE WHEN {inner} THEN a.gone ELSE {fresh} END"
    still = "(greatest(a.open + f.net, 0) > 0 OR f.more)"
    end = f"CASE WHEN {inner} THEN a.end_ WHEN NOT {fresh} AND f.term THEN f.ind END"
    return f"""CASE WHEN contains({x}, repeat(chr(34), 3)) OR contains({x}, repeat(chr(39), 3)) THEN {x} ELSE array_to_string(list_reduce({facts}, lambda a, f:
      {{'dead': CASE WHEN NOT {still} AND {end} IS NOT NULL THEN {end} WHEN {inner} OR {fresh} OR f.blank THEN a.dead END,
        'open': greatest(a.open + f.net, 0), 'more': f.more, 'gone': {gone}, 'end_': CASE WHEN {still} THEN {end} END,
        'out': CASE WHEN {gone} THEN a.out ELSE list_append(a.out, f.line) END}},
      {{'dead': NULL::BIGINT, 'open': 0::BIGINT, 'more': FALSE, 'gone': FALSE, 'end_': NULL::BIGINT, 'out': []::VARCHAR[]}}).out, chr(10)) END"""


@query("flt04_drop_unreachable_lines", f"""WITH {PROGRAMS},
r AS (SELECT doc_id, src, {_unreach_sql('src')} AS out FROM programs WHERE lang = 'python')
SELECT doc_id, md5(out) AS out_md5, CAST(len(string_split(src, chr(10))) - len(string_split(out, chr(10))) AS INTEGER) AS dropped FROM r""")
def flt04_drop_unreachable_lines(spark, sf):
    p = _progs(spark, sf, "python")
    out = Q.drop_unreachable_lines("src")
    return p.select("doc_id", F.md5(out).alias("out_md5"),
                    (F.size(F.split("src", "\n")) - F.size(F.split(out, "\n"))).cast("int").alias("dropped"))


_DECL_JAVA = f"""WITH {PROGRAMS},
decl AS (SELECT doc_id, src, unnest(regexp_extract_all(src, '(?m)^\\s*static int (\\w+)\\s*\\(', 1)) AS name FROM programs WHERE lang = 'java')"""


@query("join06_unreferenced", _DECL_JAVA + """
SELECT doc_id, name FROM decl WHERE len(regexp_extract_all(src, '\\b' || name || '\\s*\\(')) = 1""")
def join06_unreferenced(spark, sf):
    p = _progs(spark, sf, "java")
    seg = FE.method_segments(p)
    decls = seg.filter("is_header").select("doc_id", F.col("method").alias("name")).filter(F.col("name") != "main")
    refs = FE.call_edges(p).select("doc_id", F.col("callee").alias("name"))
    return Q.unreferenced(decls, refs)


@query("flt05_drop_dead_declarations")
def flt05_drop_dead_declarations(spark, sf):
    out = Q.drop_dead_declarations(_progs(spark, sf, "java"))
    return out.select("doc_id", F.size("dropped").cast("long").alias("n_dead"), F.md5("src").alias("out_md5"), F.length("src").cast("long").alias("n_chars"))


@query("flt06_drop_unused_names")
def flt06_drop_unused_names(spark, sf):
    p = _progs(spark, sf, "python")
    dead = Q.dead_methods(p).select("doc_id", "name", F.lit("function").alias("kind"))
    # functions are dropped from the text by Q.drop_dead_declarations; unused variables are reported
    return dead.unionByName(Q.unused_names(p))


@query("flt06_drop_unused_assignments", f"""WITH {PROGRAMS},
p AS (SELECT doc_id, src FROM programs WHERE lang = 'python'),
st AS (SELECT doc_id, unnest(regexp_extract_all(src, '(?m){_re(Q.STORE)}', 1)) AS name FROM p),
wd AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(src, '{_re(FE.PY_WORDLESS)}', ' ', 'g'), '[A-Za-z_]\\w*')) AS name FROM p),
ns AS (SELECT doc_id, name, count(*) AS ns FROM st GROUP BY ALL),
nw AS (SELECT doc_id, name, count(*) AS nw FROM wd GROUP BY ALL),
un AS (SELECT ns.doc_id, ns.name FROM ns LEFT JOIN nw USING (doc_id, name) WHERE coalesce(nw, 0) <= ns),
l AS (SELECT doc_id, unnest(string_split(src, chr(10))) AS line, generate_subscripts(string_split(src, chr(10)), 1) AS pos FROM p),
f AS (SELECT *, length(regexp_extract(line, '^[{WSQ}]*')) AS ind, regexp_matches(line, '[^{WSQ}]') AS full_,
        regexp_replace(line, '{_re(FE.PY_WORDLESS)}', ' ', 'g') AS c FROM l),
g AS (SELECT *, last_value(CASE WHEN full_ THEN ind END IGNORE NULLS) OVER w AS prev,
        coalesce(sum(length(regexp_replace(c, '[^(\\[{{]', '', 'g')) - length(regexp_replace(c, '[^)\\]}}]', '', 'g'))) OVER w, 0) AS open
      FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT g.* FROM g JOIN p USING (doc_id) WHERE contains(src, repeat(chr(34), 3)) OR contains(src, repeat(chr(39), 3)) OR NOT coalesce(
        regexp_matches(line, '{_re(Q.PLAIN_RHS)}') AND open = 0 AND prev = ind
        AND EXISTS (SELECT 1 FROM un WHERE un.doc_id = g.doc_id AND un.name = regexp_extract(line, '{_re(Q.STORE)}', 1)), FALSE))
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS out_md5, CAST(count(*) AS INTEGER) AS n_lines FROM k GROUP BY doc_id""")
def flt06_drop_unused_assignments(spark, sf):
    out = Q.drop_unused_assignments("src")
    p = _progs(spark, sf, "python").withColumn("out", out)
    return p.select("doc_id", F.md5("out").alias("out_md5"), F.size(F.split("out", "\n")).cast("int").alias("n_lines"))


# ----------------------------------------------------------------- features
def _cnt(s, k):
    return f"CAST((length({s}) - length(replace({s}, '{k}', ''))) / {len(k)} AS INTEGER)"


@query("fea01_py_counts", f"""WITH {PROGRAMS}
SELECT doc_id, {_cnt('src', 'if')} AS n_if, {_cnt('src', 'while')} + {_cnt('src', 'for')} AS n_loop, {_cnt('src', 'break')} AS n_break,
  {_cnt('src', 'sort')} AS n_sort, {_cnt('src', 'list')} + {_cnt('src', 'split')} AS n_list,
  CAST(CASE WHEN length(src) = 0 THEN 0 WHEN regexp_matches(src, '(\\r\\n|[\\n\\r])$') THEN len(regexp_split_to_array(src, '\\r\\n|[\\n\\r]')) - 1
       ELSE len(regexp_split_to_array(src, '\\r\\n|[\\n\\r]')) END AS INTEGER) AS n_lines
FROM programs WHERE lang = 'python'""")
def fea01_py_counts(spark, sf):
    p = _progs(spark, sf, "python")
    return p.select("doc_id", T.py_counts("src").alias("c")).select("doc_id", "c.*")


_DEPTH = f"""list_reduce(lines, lambda a, l: {{'st': list_append(list_filter(a.st, lambda e: e < length(regexp_extract(l, '^[{WSQ}]*')) // unit),
  length(regexp_extract(l, '^[{WSQ}]*')) // unit)[1:CASE WHEN contains(l, 'def') OR contains(l, 'for') OR contains(l, 'while')
     THEN len(list_filter(a.st, lambda e: e < length(regexp_extract(l, '^[{WSQ}]*')) // unit)) + 1
     ELSE len(list_filter(a.st, lambda e: e < length(regexp_extract(l, '^[{WSQ}]*')) // unit)) END],
  'mx': greatest(a.mx, length(regexp_extract(l, '^[{WSQ}]*')) // unit),
  'mi': greatest(a.mi, CASE WHEN contains(l, 'def') OR contains(l, 'for') OR contains(l, 'while')
     THEN len(list_filter(a.st, lambda e: e < length(regexp_extract(l, '^[{WSQ}]*')) // unit)) + 1
     ELSE len(list_filter(a.st, lambda e: e < length(regexp_extract(l, '^[{WSQ}]*')) // unit)) END)}},
  {{'st': []::INTEGER[], 'mx': 0, 'mi': 0}})"""


@query("fea02_py_depth", f"""WITH {PROGRAMS},
ls AS (SELECT doc_id, list_filter(string_split(src, chr(10)), lambda l: trim(l, '{T.PY_SPACE}') <> '') AS lines FROM programs WHERE lang = 'python'),
u AS (SELECT doc_id, lines, coalesce(list_filter(list_transform(lines, lambda l: length(regexp_extract(l, '^[{WSQ}]*'))), lambda w: w > 0)[1], 4) AS unit FROM ls),
d AS (SELECT doc_id, {_DEPTH} AS r FROM u)
SELECT doc_id, CAST(r.mx AS INTEGER) AS max_depth, CAST(r.mi AS INTEGER) AS max_stack FROM d""")
def fea02_py_depth(spark, sf):
    p = _progs(spark, sf, "python")
    return p.select("doc_id", T.py_depth("src").alias("d")).select("doc_id", "d.*")


def _rc(s, pat):
    return f"CAST(len(regexp_extract_all({s}, '{_re(pat)}')) AS INTEGER)"


_PY_CODE = f"regexp_replace(src, '{_re(FE.PY_WORDLESS)}', ' ', 'g')"
_PY_ATTRS = f"CAST(len(list_distinct(regexp_extract_all({_PY_CODE}, '{_re(r'\bself\.([A-Za-z_]\w*)\s*(?:[-+*/%]?=)[^=]')}', 1))) AS INTEGER)"
_PY_NAMES = (f"CAST(len(list_filter(list_distinct(regexp_extract_all({_PY_CODE}, '[A-Za-z_]\\w*')), lambda w: NOT list_contains("
             f"{FE.PY_KEYWORDS!r}, w))) AS INTEGER)")


@query("fea03_py_names", f"""WITH {PROGRAMS}
SELECT doc_id, {_rc('src', r'(?m)^def\s')} AS n_funcs, {_rc('src', r'(?m)^[ \t]+def\s')} AS n_methods,
  {_rc('src', r'(?m)^[ \t]*[A-Za-z_]\w*\s*(?:[-+*/%]?=)[^=]')} AS n_assign,
  {_PY_ATTRS} AS n_attrs, {_PY_NAMES} AS n_names
FROM programs WHERE lang = 'python'""")
def fea03_py_names(spark, sf):
    p = _progs(spark, sf, "python")
    return p.select("doc_id", FE.py_names("src").alias("c")).select("doc_id", "c.*")


_JSTRIP = f"{JAVA_RM}"


@query("fea04_java_counts")
def fea04_java_counts(spark, sf):
    """FEA4: the 13 v1 counts (the recursive-method count from the program's own call sites)."""
    t = FE.java_feature_table(_progs(spark, sf, "java"))
    return t.select("doc_id", "c.*", "n_recursive")


@query("fea05_java_counts_v2")
def fea05_java_counts_v2(spark, sf):
    """FEA5: counts of main with those of its callees added at every call site, level by level
    (JOIN7 + JOIN8), HashSet before HashMap, all inside the program's row.

    A method's weight is the number of call paths from main on which each call
    goes one breadth-first level deeper; every count is the weighted sum.
    """
    return _progs(spark, sf, "java").select("doc_id", FE.level_counts("src").alias("c")).select("doc_id", F.inline("c"))


# The loop-nesting fold in SQL: a recursive walk over the numbered tokens with the stacks as lists.
def nesting_sql(programs: str, key: str, text: str) -> str:
    """CTEs tk, tn, wk, nest(key, n): deepest loop nesting of every text of ``programs``."""
    return f"""
tk AS (SELECT {key}, regexp_extract_all({text}, '{_re(FE.LOOP_TOKENS)}') AS ts FROM {programs}),
wk({key}, ts, i, d, p, st, ad, loops, dos, mx) AS (
  SELECT {key}, ts, 1, 0, 0, 'plain', FALSE, []::INTEGER[], []::INTEGER[], 0 FROM tk
  UNION ALL
  SELECT {key}, ts, i + 1,
    d + CASE t WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END,
    CASE WHEN t IN ('for', 'while') THEN 0 WHEN t = '(' THEN p + 1 WHEN t = ')' THEN p - 1 ELSE p END,
    CASE WHEN t = 'while' AND ad THEN 'tail' WHEN t IN ('for', 'while') THEN 'head' WHEN t = 'do' THEN 'do'
         WHEN t = '(' THEN CASE WHEN st = 'body' THEN 'plain' ELSE st END
         WHEN t = ')' THEN CASE WHEN p = 1 AND st = 'head' THEN 'body' WHEN p = 1 AND st = 'tail' THEN 'plain' WHEN st = 'body' THEN 'plain' ELSE st END
         WHEN t = ';' AND st IN ('head', 'tail') AND p > 0 THEN st ELSE 'plain' END,
    t = '}}' AND list_contains(dos, d - 1),
    CASE t WHEN '{{' THEN braced WHEN '}}' THEN list_filter(opened, lambda x: CASE WHEN x >= 0 THEN x < d - 1 ELSE -1 - x < d - 1 END)
           WHEN ';' THEN CASE WHEN st IN ('head', 'tail') AND p > 0 THEN opened ELSE list_filter(opened, lambda x: x >= 0 OR -1 - x < d) END
           ELSE opened END,
    CASE t WHEN '{{' THEN CASE WHEN st = 'do' THEN list_append(dos, d) ELSE dos END WHEN '}}' THEN list_filter(dos, lambda x: x < d - 1) ELSE dos END,
    greatest(mx, len(CASE WHEN t = '{{' THEN braced ELSE opened END))
  FROM (SELECT *, ts[i] AS t, CASE WHEN st = 'body' AND ts[i] <> '{{' THEN list_append(loops, -1 - d) ELSE loops END AS opened,
               CASE WHEN st = 'body' THEN list_append(loops, d) ELSE loops END AS braced FROM wk WHERE i <= len(ts)) q),
nest AS (SELECT {key}, CAST(max(mx) AS INTEGER) AS n FROM wk GROUP BY {key})"""


@query("fea06_nested_loop_depth", f"""WITH RECURSIVE {PROGRAMS}, j AS (SELECT doc_id, {_JSTRIP} AS s FROM programs WHERE lang = 'java'),
{nesting_sql('j', 'doc_id', 's')}
SELECT doc_id, CAST(greatest(n - 1, 0) AS INTEGER) AS nested_v1, n AS nested_v2 FROM nest""")
def fea06_nested_loop_depth(spark, sf):
    p = _progs(spark, sf, "java").withColumn("s", T.remove_comments("src", "lang"))
    return p.select("doc_id", FE.nested_loop_depth("s", 1).alias("nested_v1"), FE.nested_loop_depth("s", 2).alias("nested_v2"))


@query("fea07_call_edges")
def fea07_call_edges(spark, sf):
    return FE.call_edges(_progs(spark, sf))


@query("fea08_token_count", f"""WITH {PROGRAMS}
SELECT doc_id, CAST(len(regexp_extract_all(src, '{_re(T.TOKEN)}')) AS INTEGER) AS tokens FROM programs""")
def fea08_token_count(spark, sf):
    return _progs(spark, sf).select("doc_id", T.token_count("src").alias("tokens"))


@query("fea09_split_methods")
def fea09_split_methods(spark, sf):
    p = _progs(spark, sf).select("doc_id", "lang", FE.split_methods("src", "lang").alias("m"))
    return p.select("doc_id", "lang", "m.n_methods", "m.method_lines", "m.main_pos")


@query("fea10_feature_vector")
def fea10_feature_vector(spark, sf):
    t = FE.java_feature_table(_progs(spark, sf, "java"), keep=("label",))
    from pyspark.ml.functions import vector_to_array
    v = t.select("doc_id", "label", FE.feature_vector(FE.v1_columns()).alias("features"))
    return v.select("doc_id", "label", F.array_join(vector_to_array("features").cast("array<string>"), ",").alias("features"))


@query("fea10_python_vector", f"""WITH {PROGRAMS},
ls AS (SELECT doc_id, list_filter(string_split(src, chr(10)), lambda l: trim(l, '{T.PY_SPACE}') <> '') AS lines FROM programs WHERE lang = 'python'),
u AS (SELECT doc_id, lines, coalesce(list_filter(list_transform(lines, lambda l: length(regexp_extract(l, '^[{WSQ}]*'))), lambda w: w > 0)[1], 4) AS unit FROM ls),
d AS (SELECT doc_id, {_DEPTH} AS r FROM u),
v AS (SELECT doc_id, [{_cnt('src', 'if')}, {_cnt('src', 'while')} + {_cnt('src', 'for')}, {_cnt('src', 'break')}, {_cnt('src', 'sort')},
   {_cnt('src', 'list')} + {_cnt('src', 'split')}, len(string_split(rtrim(src, chr(10)), chr(10))), {_PY_NAMES}, {_PY_ATTRS}, r.mx, r.mi,
   {_rc('src', r'(?m)^[ \t]*[A-Za-z_]\w*\s*(?:[-+*/%]?=)[^=]')}, {_rc('src', r'(?m)^[ \t]+def\s')}, {_rc('src', r'(?m)^def\s')}] AS f
   FROM programs JOIN d USING (doc_id) WHERE lang = 'python')
SELECT doc_id, array_to_string(list_transform(f, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') AS features FROM v""")
def fea10_python_vector(spark, sf):
    return _progs(spark, sf, "python").select("doc_id", F.array_join(FE.python_vector().cast("array<string>"), ",").alias("features"))


# ------------------------------------------------------------ augmentation job
@query("win06_augment_job")
def win06_augment_job(spark, sf):
    p = _progs(spark, sf)
    n = F.when(F.col("lang") == "java", mutation_count("doc_id", 1, 5)).otherwise(mutation_count("doc_id", 1, 10))
    a = Q.augment_job(p, n, keep_on_failure=False)
    return a.select("doc_id", "lang", "failed", F.md5("out").alias("out_md5"))


@query("win06_resample", f"""WITH {PROGRAMS},
ids AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('777|' || doc_id), 1, 8))::BIGINT, doc_id) AS rk, count(*) OVER () AS n FROM programs),
draws AS (SELECT range AS draw, ('0x' || substr(md5('777-draw|' || range), 1, 8))::BIGINT % (SELECT any_value(n) FROM ids) + 1 AS rk
          FROM range(20000) WHERE range < 20000 - (SELECT count(*) FROM programs)),
drawn AS (SELECT ids.doc_id, 1 + ('0x' || substr(md5('777-mut|' || ids.doc_id || '|' || draw), 1, 8))::BIGINT % 20 AS m FROM draws JOIN ids USING (rk)),
first AS (SELECT doc_id, 1 + ('0x' || substr(md5('777-mut|' || doc_id), 1, 8))::BIGINT % 10 AS m FROM programs)
SELECT pass, CAST(count(*) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS mutations, CAST(sum(doc_id) AS BIGINT) AS ids
FROM (SELECT 'first' AS pass, * FROM first UNION ALL SELECT 'drawn', * FROM drawn) GROUP BY pass""")
def win06_resample(spark, sf):
    """WIN6, whole job: every program once, then draws up to 20,000 rows (counts and mutation numbers of both passes)."""
    p = _progs(spark, sf)
    a = Q.resample_augmented(p, 20000, (1, 10), (1, 20))
    return a.groupBy(F.when(F.col("draw").isNull(), "first").otherwise("drawn").alias("pass")).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.sum("n_mut").cast("long").alias("mutations"), F.sum("doc_id").cast("long").alias("ids"))


#: Mutations of the first pass and of the draws (the reference's).
FIRST_PASS, DRAWN = {"java": (1, 5), "python": (1, 10)}, {"java": (1, 5), "python": (1, 20)}


@query("win06_resample_texts")
def win06_resample_texts(spark, sf):
    """WIN6, whole job with its texts: every program once, then as many draws; Python programs that fail are dropped in both passes."""
    p = _progs(spark, sf)
    a = Q.resample_augmented(p, 2 * p.count(), FIRST_PASS, DRAWN, keep_on_failure=False)
    return a.select("doc_id", "draw", "lang", "n_mut", "failed", F.md5("out").alias("out_md5"))


@query("agg22_failure_ledger")
def agg22_failure_ledger(spark, sf):
    p = _progs(spark, sf)
    n = F.when(F.col("lang") == "java", mutation_count("doc_id", 1, 5)).otherwise(mutation_count("doc_id", 1, 10))
    a = Q.augment_job(p, n, keep_on_failure=True)
    return M.failure_ledger(a, "lang", F.col("failed"))


# ----------------------------------------------------------------- graphs
@query("join07_reachable", f"""WITH RECURSIVE {CALL_EDGES},
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.callee, r.depth + 1 FROM r JOIN edges e ON e.caller = r.node)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def join07_reachable(spark, sf):
    e = S.call_edges(spark, sf)
    roots = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return G.reachable(e, roots).select("node", F.col("depth").cast("int"))


@query("join07_reachable_depth2", f"""WITH RECURSIVE {CALL_EDGES},
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.callee, r.depth + 1 FROM r JOIN edges e ON e.caller = r.node WHERE r.depth < 1)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def join07_reachable_depth2(spark, sf):
    """Parity mode: main plus its direct callees only."""
    e = S.call_edges(spark, sf)
    roots = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    return G.reachable(e, roots, max_depth=1).select("node", F.col("depth").cast("int"))


@query("join08_rollup_callee_features", f"""WITH RECURSIVE {CALL_EDGES},
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.callee, r.depth + 1 FROM r JOIN edges e ON e.caller = r.node),
anc(a, d) AS (SELECT node, node FROM r UNION ALL SELECT anc.a, e.callee FROM anc JOIN edges e ON e.caller = anc.d),
v AS (SELECT p_partkey AS node, p_size AS v FROM part)
SELECT anc.a AS node, CAST(sum(coalesce(v.v, 0)) AS BIGINT) AS sum_v, max(coalesce(v.v, 0)) AS max_v
FROM anc LEFT JOIN v ON v.node = anc.d GROUP BY anc.a""")
def join08_rollup_callee_features(spark, sf):
    e = S.call_edges(spark, sf)
    vals = S.table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("value"))
    roots = spark.range(1).select(F.lit(1).cast("long").alias("node"))
    r = G.rollup_tree(e, vals, roots)
    return r.select("node", F.col("sum_v").cast("long"), F.col("max_v").cast("int"))


SHARED_EDGES = """edges AS (
  SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS caller, p_partkey AS callee FROM part
  UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS BIGINT) FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 512)"""


@query("join08_rollup_shared", f"""WITH RECURSIVE {SHARED_EDGES},
pair(node, below) AS (
  SELECT node, node FROM (SELECT caller AS node FROM edges UNION SELECT callee FROM edges)
  UNION SELECT p.node, e.callee FROM pair p JOIN edges e ON e.caller = p.below),
v AS (SELECT p_partkey AS below, p_size AS v FROM part)
SELECT node, CAST(sum(coalesce(v, 0)) AS BIGINT) AS sum_v, CAST(max(coalesce(v, 0)) AS INTEGER) AS max_v FROM pair LEFT JOIN v USING (below) GROUP BY node""")
def join08_rollup_shared(spark, sf):
    """JOIN8 where callees are shared (a part calls its right sibling) and some leaves call their caller back."""
    p = S.table(spark, sf, "part")
    key = F.col("p_partkey")
    up = F.floor(key / 2).cast("long")
    e = S.call_edges(spark, sf).unionByName(p.filter(key % 2 == 0).select(key.alias("caller"), (key + 1).alias("callee"))).unionByName(
        p.filter((key % 97 == 0) & (key > 512)).select(key.alias("caller"), up.alias("callee")))
    r = G.rollup_reachable(e, p.select(key.alias("node"), F.col("p_size").alias("value")))
    return r.select("node", F.col("sum_v").cast("long").alias("sum_v"), F.col("max_v").cast("int").alias("max_v"))


@query("join09_self_recursive", f"""WITH {PROGRAMS}
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(src, 's \\+= (m\\d+)\\(n - 1\\)', 1))) AS BIGINT) AS n_recursive
FROM programs WHERE regexp_matches(src, 's \\+= (m\\d+)\\(n - 1\\)')""")
def join09_self_recursive(spark, sf):
    return G.self_recursive(FE.call_edges(_progs(spark, sf)), ["doc_id"])


WORDS = """w0 AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS word, generate_subscripts(regexp_split_to_array(text, '\\s+'), 1) - 1 AS idx FROM documents),
tok AS (SELECT doc_id, idx, word, lower(regexp_replace(word, '[^\\p{L}\\p{N}_]', '', 'g')) AS name, regexp_matches(word, '[,.]$') AS is_def
        FROM w0 WHERE word <> ''),
tk AS (SELECT * FROM tok WHERE name <> ''),
ld AS (SELECT *, last_value(CASE WHEN is_def THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id, name ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_idx FROM tk),
fd AS (SELECT doc_id, name, min(idx) AS first_def FROM tk WHERE is_def GROUP BY ALL),
fe AS (SELECT doc_id, name, idx, 'comesFrom' AS kind, def_idx AS parent_idx FROM ld WHERE NOT is_def AND def_idx IS NOT NULL
       UNION ALL SELECT ld.doc_id, ld.name, ld.idx, 'comesFrom', fd.first_def FROM ld JOIN fd USING (doc_id, name)
       WHERE NOT ld.is_def AND ld.def_idx IS NOT NULL AND fd.first_def < ld.idx)"""


def _tokens(spark, sf):
    return G.words(S.table(spark, sf, "documents"))


@query("join10_latest_definition", f"""WITH {WORDS}
SELECT doc_id, CAST(count(*) FILTER (WHERE NOT is_def) AS BIGINT) AS n_uses,
  CAST(count(def_idx) FILTER (WHERE NOT is_def) AS BIGINT) AS n_linked,
  CAST(coalesce(sum(idx - def_idx) FILTER (WHERE NOT is_def), 0) AS BIGINT) AS sum_gap FROM ld GROUP BY doc_id""")
def join10_latest_definition(spark, sf):
    ld = G.latest_definition(_tokens(spark, sf))
    use = ~F.col("is_def")
    return ld.groupBy("doc_id").agg(F.count_if(use).cast("long").alias("n_uses"),
                                    F.count(F.when(use, F.col("def_idx"))).cast("long").alias("n_linked"),
                                    F.coalesce(F.sum(F.when(use, F.col("idx") - F.col("def_idx"))), F.lit(0)).cast("long").alias("sum_gap"))


@query("join11_prune_edges", f"""WITH {WORDS},
ids AS (SELECT doc_id, idx FROM fe UNION SELECT doc_id, parent_idx FROM fe)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_kept FROM tk WHERE EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = tk.doc_id AND ids.idx = tk.idx)
GROUP BY doc_id""")
def join11_prune_edges(spark, sf):
    t = _tokens(spark, sf)
    kept = G.prune_edges(t, G.flow_edges(t))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_kept"))


@query("join12_merge_edges", f"""WITH {WORDS},
m AS (SELECT doc_id, name, idx, kind, list_sort(list_distinct(list(parent_idx))) AS parents FROM fe GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_nodes, CAST(sum(len(parents)) AS BIGINT) AS n_parents,
       CAST(sum(parents[1]) AS BIGINT) AS sum_first FROM m GROUP BY doc_id""")
def join12_merge_edges(spark, sf):
    m = G.merge_edges(G.flow_edges(_tokens(spark, sf)))
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_nodes"),
                                   F.sum(F.size("parents")).cast("long").alias("n_parents"),
                                   F.sum(F.get("parents", 0)).cast("long").alias("sum_first"))


@query("join13_merge_branch_states", f"""WITH {WORDS},
st AS (SELECT doc_id, idx // 50 AS branch, name, idx AS def_idx FROM tk WHERE is_def),
m AS (SELECT doc_id, name, list_sort(list_distinct(list(def_idx))) AS defs, count(DISTINCT branch) AS nb FROM st GROUP BY ALL)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_vars, CAST(sum(len(defs)) AS BIGINT) AS n_defs, CAST(sum(nb) AS BIGINT) AS n_branch_vars
FROM m GROUP BY doc_id""")
def join13_merge_branch_states(spark, sf):
    t = _tokens(spark, sf).filter("is_def").select("doc_id", (F.col("idx") / 50).cast("long").alias("branch"), "name",
                                                      F.col("idx").alias("def_idx"))
    m = G.merge_branch_states(t)
    return m.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_vars"),
                                   F.sum(F.size("defs")).cast("long").alias("n_defs"),
                                   F.sum("n_branches").cast("long").alias("n_branch_vars"))


@query("join14_reindex_edges", f"""WITH {WORDS},
ids AS (SELECT doc_id, idx FROM fe UNION SELECT doc_id, parent_idx FROM fe),
kept AS (SELECT tk.doc_id, tk.idx FROM tk JOIN ids USING (doc_id, idx)),
pos AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS pos FROM kept),
e AS (SELECT fe.doc_id, a.pos, b.pos AS parent_pos FROM fe JOIN pos a ON a.doc_id = fe.doc_id AND a.idx = fe.idx
      JOIN pos b ON b.doc_id = fe.doc_id AND b.idx = fe.parent_idx)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_edges, CAST(max(pos) AS BIGINT) AS max_pos, CAST(sum(pos - parent_pos) AS BIGINT) AS sum_span
FROM e GROUP BY doc_id""")
def join14_reindex_edges(spark, sf):
    e = G.reindex_edges(G.flow_edges(_tokens(spark, sf)))
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_edges"), F.max("pos").cast("long").alias("max_pos"),
                                   F.sum(F.col("pos") - F.col("parent_pos")).cast("long").alias("sum_span"))


_SPANS = """sp AS (SELECT doc_id, idx, greatest(CAST(ceil(length(word) / 4) AS BIGINT), 1) AS n_sub FROM tk),
sp2 AS (SELECT *, CAST(sum(n_sub) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS b FROM sp)"""


@query("win10_token_spans", f"""WITH {WORDS}, {_SPANS}
SELECT doc_id, CAST(max(b) AS BIGINT) AS n_sub, CAST(sum(b - n_sub) AS BIGINT) AS sum_start FROM sp2 GROUP BY doc_id""")
def win10_token_spans(spark, sf):
    s = G.token_spans(_tokens(spark, sf))
    return s.groupBy("doc_id").agg(F.max("b").cast("long").alias("n_sub"), F.sum("a").cast("long").alias("sum_start"))


@query("join15_span_pairs", f"""WITH {WORDS}, {_SPANS},
pairs AS (SELECT doc_id, idx, unnest(range(b - n_sub, b)) AS tok FROM sp2)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(tok) AS BIGINT) AS sum_tok FROM pairs GROUP BY doc_id""")
def join15_span_pairs(spark, sf):
    p = G.span_pairs(G.token_spans(_tokens(spark, sf)))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_pairs"), F.sum("tok").cast("long").alias("sum_tok"))


@query("win11_edge_budget", f"""WITH {WORDS},
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, parent_idx) AS rn FROM fe)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_edges, CAST(max(idx) AS BIGINT) AS last_idx FROM b WHERE rn <= 128 GROUP BY doc_id""")
def win11_edge_budget(spark, sf):
    e = G.edge_budget(G.flow_edges(_tokens(spark, sf)), 128)  # the reference's data-flow length
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("n_edges"), F.max("idx").cast("long").alias("last_idx"))



# ------------------------------------------------- oracles for the lexical layer
# Method segmentation written in SQL (brace depth / indentation + last header),
# so FEA7, FEA9, FLT6 and FEA10 are checked across engines.
def _seg_sql(table: str = "programs", prefix: str = PROGRAMS) -> str:
    jh = _re(FE.JAVA_HEADER)
    ph = _re(FE.PY_HEADER)
    ws = WSQ
    return (prefix + """,
sl AS (SELECT doc_id, lang, unnest(string_split(src, chr(10))) AS line,
              generate_subscripts(string_split(src, chr(10)), 1) - 1 AS pos FROM @TABLE@),
sd AS (SELECT *, coalesce(sum((length(c) - length(replace(c, '{', ''))) - (length(c) - length(replace(c, '}', ''))))
         OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth
       FROM (SELECT *, regexp_replace(line, '@LIT@', '""', 'g') AS c FROM sl) x),
sh AS (SELECT *, CASE WHEN lang = 'java' THEN (CASE WHEN depth = 1 THEN nullif(regexp_extract(line, '@JH@', 1), '') END)
                      ELSE nullif(regexp_extract(line, '@PH@', 1), '') END AS closed_header,
              CASE WHEN lang = 'java' AND depth = 1 AND NOT contains(line, '{') THEN nullif(regexp_extract(line, '@JO@', 1), '') END AS open_header,
              CASE WHEN lang = 'java' THEN regexp_matches(line, '^ *\\{') ELSE regexp_matches(line, '^[@WS@]') OR NOT regexp_matches(line, '[^@WS@]') END AS inside
       FROM sd),
-- a marker says whose lines begin here: a name, or '' for nobody's
sm AS (SELECT *, coalesce(closed_header, open_header) AS header,
         lag(open_header) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS after_open FROM sh),
sn AS (SELECT *, CASE WHEN header IS NOT NULL THEN header
                      WHEN lang = 'java' AND (depth >= 2 OR (depth = 1 AND after_open AND inside)) THEN NULL
                      WHEN lang <> 'java' AND inside THEN NULL ELSE '' END AS marker FROM sm),
sc AS (SELECT *, nullif(last_value(marker IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS cur FROM sn),
seg AS (SELECT doc_id, lang, pos, line, header IS NOT NULL AS is_header, cur AS method FROM sc),
calls AS (SELECT doc_id, lang, method AS caller,
            unnest(regexp_extract_all(regexp_replace(line, '\\bnew\\s+\\w+', 'new', 'g'), '([A-Za-z_]\\w*)\\s*\\(', 1)) AS callee
          FROM seg WHERE method IS NOT NULL AND NOT is_header),
edges_ AS (SELECT DISTINCT doc_id, lang, caller, callee FROM calls WHERE callee NOT IN (@KW@))"""
            .replace("@JH@", jh).replace("@JO@", _re(FE.JAVA_OPEN_HEADER)).replace("@PH@", ph).replace("@WS@", ws).replace("@TABLE@", table)
            .replace("@LIT@", _re(FE.LITERAL))
            .replace("@KW@", ", ".join(f"'{k}'" for k in FE.CALL_KEYWORDS)))


SEG = _seg_sql()
_SEG_STRIPPED = _seg_sql("pj", PROGRAMS + f",\npj AS (SELECT doc_id, lang, label, {JAVA_RM} AS src FROM programs WHERE lang = 'java')")
add_oracle("fea07_call_edges", f"WITH {SEG} SELECT doc_id, caller, callee FROM edges_")
add_oracle("fea09_split_methods", f"""WITH {SEG}
SELECT doc_id, lang, CAST(count(DISTINCT method) AS BIGINT) AS n_methods, CAST(count(method) AS BIGINT) AS method_lines,
       CAST(max(CASE WHEN method = 'main' THEN pos END) AS INTEGER) AS main_pos FROM seg GROUP BY doc_id, lang""")

add_oracle("flt05_drop_dead_declarations", f"""WITH {SEG},
refs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(line, '\\bnew\\s+\\w+', 'new', 'g'), '([A-Za-z_]\\w*)\\s*\\(', 1)) AS name
         FROM seg WHERE lang = 'java' AND NOT is_header),
dead AS (SELECT DISTINCT doc_id, method FROM seg s WHERE lang = 'java' AND is_header AND method <> 'main'
         AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.doc_id = s.doc_id AND refs.name = s.method)),
cl AS (SELECT doc_id, pos, line, sum((length(c) - length(replace(c, '{{', ''))) - (length(c) - length(replace(c, '}}', '')))) OVER w AS after,
              regexp_extract(line, '{_re(Q.CLASS_HEADER)}', 1) AS name
       FROM (SELECT *, regexp_replace(line, '{_re(FE.LITERAL)}', '""', 'g') AS c FROM sl WHERE lang = 'java') x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cm AS (SELECT *, CASE WHEN coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN name END AS mark FROM cl),
cc AS (SELECT *, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS cls FROM cm),
dc AS (SELECT DISTINCT c.doc_id, c.cls FROM cc c WHERE c.cls IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM cc x JOIN seg USING (doc_id, pos) WHERE x.doc_id = c.doc_id AND x.cls = c.cls AND seg.is_header AND seg.method = 'main')
       AND NOT EXISTS (SELECT 1 FROM seg x WHERE x.doc_id = c.doc_id AND regexp_matches(x.line, '\\bnew\\s+' || c.cls || '\\b'))),
kept AS (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS t FROM seg s JOIN cc USING (doc_id, pos)
         WHERE s.lang = 'java' AND NOT EXISTS (SELECT 1 FROM dead d WHERE d.doc_id = s.doc_id AND d.method = s.method)
           AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.doc_id = s.doc_id AND dc.cls = cc.cls) GROUP BY s.doc_id)
SELECT kept.doc_id, CAST((SELECT count(*) FROM dead WHERE dead.doc_id = kept.doc_id) AS BIGINT) AS n_dead, md5(t) AS out_md5, length(t) AS n_chars FROM kept""")

_STORE = r"(?m)^[ \t]*([A-Za-z_]\w*)\s*=[^=]"
add_oracle("flt06_drop_unused_names", f"""WITH {SEG},
refs AS (SELECT doc_id, callee AS name FROM edges_ WHERE lang = 'python' AND caller <> callee
         UNION SELECT doc_id, unnest(regexp_extract_all(line, '([A-Za-z_]\\w*)\\s*\\(', 1)) FROM seg WHERE method IS NULL AND lang = 'python'),
decl AS (SELECT DISTINCT doc_id, method AS name FROM seg WHERE is_header AND lang = 'python'),
dead AS (SELECT doc_id, name, 'function' AS kind FROM decl d WHERE name <> 'main' AND NOT starts_with(name, '_')
         AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.doc_id = d.doc_id AND r.name = d.name)),
st AS (SELECT doc_id, unnest(regexp_extract_all(src, '{_re(_STORE)}', 1)) AS name FROM programs WHERE lang = 'python'),
wd AS (SELECT doc_id, unnest(regexp_extract_all(src, '[A-Za-z_]\\w*')) AS name FROM programs WHERE lang = 'python'),
ns AS (SELECT doc_id, name, count(*) AS ns FROM st GROUP BY ALL),
nw AS (SELECT doc_id, name, count(*) AS nw FROM wd GROUP BY ALL),
unused AS (SELECT ns.doc_id, ns.name, 'variable' AS kind FROM ns JOIN nw USING (doc_id, name) WHERE nw <= ns)
SELECT * FROM dead UNION ALL SELECT * FROM unused""")


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _rename_sql(x: str) -> str:
    cls = _ordered_distinct(f"regexp_extract_all({x}, '\\bclass\\s+([A-Za-z_]\\w*)', 1)")
    meth = _ordered_distinct(f"list_filter(regexp_extract_all({x}, '(?m)(?:^def\\s+|\\b(?:void|int|long|double|boolean|String|float|char)\\s+)([A-Za-z_]\\w*)\\s*\\(', 1), lambda v: v <> 'main')")
    var = _ordered_distinct(f"regexp_extract_all({x}, '\\b(?:int|long|double|float|boolean|char|String)(?:\\[\\])*\\s+([A-Za-z_]\\w*)\\s*[=;,)]', 1)")
    pairs = (f"list_concat(list_transform({cls}, lambda v, i: {{'n': v, 'r': 'CLASS' || CAST(i - 1 AS VARCHAR)}}), "
             f"list_transform({meth}, lambda v, i: {{'n': v, 'r': 'METHOD' || CAST(i - 1 AS VARCHAR)}}), "
             f"list_transform({var}, lambda v, i: {{'n': v, 'r': 'VAR' || CAST(i - 1 AS VARCHAR)}}))")
    return f"list_reduce({pairs}, lambda acc, p: regexp_replace(acc, '\\b' || p.n || '\\b', p.r, 'g'), {x})"


add_oracle("prj21_rename_identifiers", f"""WITH {PROGRAMS}, r AS (SELECT doc_id, lang, {_rename_sql('src')} AS out FROM programs)
SELECT doc_id, lang, md5(out) AS out_md5, length(out) AS n_chars FROM r""")


_NMUT = (f"CASE WHEN lang = 'java' THEN 1 + ('0x' || substr(md5('777-mut|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 5 "
         f"ELSE 1 + ('0x' || substr(md5('777-mut|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 END")


def _mutations_sql(steps: int, start: str = f"SELECT doc_id, lang, {_NMUT} AS n, src AS out, FALSE AS failed FROM programs") -> str:
    """CTEs a0 .. a<steps>: one mutation each (comments, names, dead lines in turn), then aug."""
    ctes = [f"a0 AS ({start})"]
    rm = [r.replace("(src,", "(out,") for r in (JAVA_RM, PY_RM)]
    turn = {1: f"CASE lang WHEN 'java' THEN {rm[0]} ELSE {rm[1]} END", 2: _rename_sql("out"),
            0: f"CASE lang WHEN 'python' THEN {_unreach_sql('out')} ELSE out END"}
    for i in range(1, steps + 1):
        ctes.append(f"b{i} AS MATERIALIZED (SELECT *, CASE WHEN n >= {i} THEN {turn[i % 3]} ELSE out END AS c FROM a{i - 1})")
        ctes.append(f"a{i} AS MATERIALIZED (SELECT doc_id, lang, n, CASE WHEN n >= {i} AND {_gate_sql('c')} THEN c ELSE out END AS out, "
                    f"failed OR (n >= {i} AND NOT {_gate_sql('c')}) AS failed FROM b{i})")
    return ",\n".join(ctes) + f",\naug AS (SELECT * FROM a{steps})"


_AUG = f"WITH {PROGRAMS},\n{_mutations_sql(10)}"

add_oracle("win06_augment_job", _AUG + " SELECT doc_id, lang, failed, md5(out) AS out_md5 FROM aug WHERE NOT (lang = 'python' AND failed)")
add_oracle("agg22_failure_ledger", _AUG + """ SELECT lang, CAST(count(*) AS BIGINT) AS total, CAST(sum(CAST(failed AS INTEGER)) AS BIGINT) AS failed,
  round(avg(CAST(failed AS DOUBLE)), 6) AS failed_share FROM aug GROUP BY lang""")

#: Both passes; a row's key is its program and draw.
_BOTH_PASSES = f"""SELECT {{'doc_id': doc_id, 'draw': NULL::BIGINT}} AS doc_id, lang, {_NMUT} AS n, src AS out, FALSE AS failed FROM programs
  UNION ALL SELECT {{'doc_id': doc_id, 'draw': draw}}, lang,
    1 + ('0x' || substr(md5('777-mut|' || doc_id || '|' || draw), 1, 8))::BIGINT % CASE WHEN lang = 'java' THEN 5 ELSE 20 END, src, FALSE
  FROM draws JOIN ids USING (rk) JOIN programs USING (doc_id)"""

add_oracle("win06_resample_texts", f"""WITH {PROGRAMS},
ids AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('777|' || doc_id), 1, 8))::BIGINT, doc_id) AS rk FROM programs),
total AS (SELECT count(*) AS n FROM programs),
dr AS (SELECT unnest(range(n)) AS draw, n FROM total),
draws AS (SELECT draw, ('0x' || substr(md5('777-draw|' || draw), 1, 8))::BIGINT % n + 1 AS rk FROM dr),
{_mutations_sql(20, _BOTH_PASSES)}
SELECT doc_id.doc_id AS doc_id, doc_id.draw AS draw, lang, CAST(n AS INTEGER) AS n_mut, failed, md5(out) AS out_md5
FROM aug WHERE NOT (lang = 'python' AND failed)""")

_JCOUNTS = [r"\bif\s*\(", r"\bswitch\s*\(", None, r"\bbreak\s*;", r"\bnew\s+PriorityQueue\b", r"\.sort\s*\(",
            r"\bnew\s+HashMap\b", r"\bnew\s+HashSet\b"]


def _vec_sql() -> str:
    parts = []
    for pat in _JCOUNTS:
        if pat is None:
            parts.append(f"({_rc('s', r'\bfor\s*\(')} + {_rc('s', r'\bwhile\s*\(')} - {_rc('s', r'\}\s*while\s*\(')})")
        else:
            parts.append(_rc("s", pat))
    parts.append("coalesce(rc.n_rec, 0)")
    parts.append("greatest(nest.n - 1, 0)")
    parts += [_rc("s", FE.JAVA_VAR), _rc("s", "(?m)" + FE.JAVA_HEADER),
              f"({_rc('s', ';')} + {_rc('s', r'\b(?:if|for|while|switch|do|try)\b')})"]
    return "array_to_string([" + ", ".join(f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)" for x in parts) + "], ',')"


add_oracle("fea10_feature_vector", f"""WITH RECURSIVE {_SEG_STRIPPED},
rc AS (SELECT doc_id, count(DISTINCT caller) AS n_rec FROM edges_ WHERE caller = callee GROUP BY doc_id),
j AS (SELECT doc_id, label, {JAVA_RM} AS s FROM programs WHERE lang = 'java'), {nesting_sql('j', 'doc_id', 's')}
SELECT j.doc_id, j.label, {_vec_sql()} AS features FROM j JOIN nest USING (doc_id) LEFT JOIN rc USING (doc_id)""")




def _counts_sql(b: str) -> str:
    loops = f"({_rc(b, r'\bfor\s*\(')} + {_rc(b, r'\bwhile\s*\(')} - {_rc(b, r'\}\s*while\s*\(')})"
    return ", ".join([
        f"{_rc(b, r'\bif\s*\(')} AS n_if", f"{_rc(b, r'\bswitch\s*\(')} AS n_switch", f"{loops} AS n_loop",
        f"{_rc(b, r'\bbreak\s*;')} AS n_break", f"{_rc(b, r'\bnew\s+PriorityQueue\b')} AS n_priority",
        f"{_rc(b, r'\.sort\s*\(')} AS n_sort", f"{_rc(b, r'\bnew\s+HashSet\b')} AS n_hashset",
        f"{_rc(b, r'\bnew\s+HashMap\b')} AS n_hashmap",
        f"{_rc(b, FE.JAVA_VAR)} AS n_vars",
        f"({_rc(b, ';')} + {_rc(b, r'\b(?:if|for|while|switch|do|try)\b')}) AS n_statements"])


_F5 = ["n_if", "n_switch", "n_loop", "n_break", "n_priority", "n_sort", "n_hashset", "n_hashmap"]
add_oracle("fea05_java_counts_v2", f"""WITH RECURSIVE {_SEG_STRIPPED},
bodies AS (SELECT doc_id, method, doc_id || '/' || method AS k, string_agg(line, chr(10) ORDER BY pos) AS body FROM seg WHERE method IS NOT NULL GROUP BY ALL),
{nesting_sql('bodies', 'k', 'body')},
mc AS (SELECT doc_id, method, nest.n AS nested, {_counts_sql('body')} FROM bodies JOIN nest USING (k)),
decl AS (SELECT DISTINCT doc_id, method AS name FROM seg WHERE is_header),
nd AS (SELECT doc_id, count(*) AS n FROM decl GROUP BY doc_id),
sites AS (SELECT c.doc_id, c.caller AS a, c.callee AS b FROM calls c JOIN decl ON decl.doc_id = c.doc_id AND decl.name = c.callee),
r(doc_id, node, depth) AS (SELECT doc_id, name, 0 FROM decl WHERE name = 'main'
   UNION SELECT r.doc_id, s.b, r.depth + 1 FROM r JOIN sites s ON s.doc_id = r.doc_id AND s.a = r.node JOIN nd ON nd.doc_id = r.doc_id WHERE r.depth < nd.n),
dep AS (SELECT doc_id, node, min(depth) AS d FROM r GROUP BY ALL),
paths(doc_id, node, d) AS (SELECT doc_id, name, 0 FROM decl WHERE name = 'main'
   UNION ALL SELECT p.doc_id, s.b, p.d + 1 FROM paths p JOIN sites s ON s.doc_id = p.doc_id AND s.a = p.node
   JOIN dep ON dep.doc_id = p.doc_id AND dep.node = s.b AND dep.d = p.d + 1),
rc AS (SELECT doc_id, count(DISTINCT a) AS n_rec FROM sites WHERE a = b GROUP BY doc_id),
agg AS (SELECT p.doc_id, {", ".join(f"CAST(sum({c}) AS INTEGER) AS {c}" for c in _F5)},
               CAST(max(nested) AS INTEGER) AS nested, CAST(sum(n_vars) AS INTEGER) AS n_vars,
               CAST(count(*) AS INTEGER) AS n_methods, CAST(sum(n_statements) AS INTEGER) AS n_statements
        FROM paths p JOIN mc ON mc.doc_id = p.doc_id AND mc.method = p.node GROUP BY p.doc_id)
SELECT agg.*, CAST(coalesce(rc.n_rec, 0) AS INTEGER) AS n_recursive FROM agg LEFT JOIN rc USING (doc_id)""")


@query("ml09_kfold_program_features")
def ml09_kfold_program_features(spark, sf):
    """Lifecycle C end to end on code: Java programs -> 13 lexical features (FEA10) -> group
    k-fold over problems (WIN2) -> 4 DecisionTree fits (ML1/ML9) -> fold mean/std (AGG19),
    scored on the training ids as they are (T-parity), like the reference's classical models."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from complexa.operators.splits import assign_fold, group_kfold
    t = FE.java_feature_table(_progs(spark, sf, "java"), keep=("label", "problem"))
    feats = t.select("doc_id", "label", "problem", FE.feature_vector(FE.v1_columns()).alias("features"))
    from complexa.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    # materialised once in the shared checkpoint folder: every fold's fit reads it, lineage stays flat
    data = assign_fold(feats, group_kfold(feats, "label", "problem", 0.8, 4)).checkpoint(eager=True)
    preds = None
    for f in range(4):
        train = data.filter(F.col("fold") != f).withColumn("label", F.col("label").cast("double"))
        model = DecisionTreeClassifier(maxDepth=4, seed=777).fit(train)
        pr = model.transform(data.filter(F.col("fold") == f)).select(
            F.lit("DecisionTree").alias("model"), F.lit(f).alias("fold"),
            F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
        preds = pr if preds is None else preds.unionByName(pr)
    return M.kfold_mean_std(preds, ["model"])


add_oracle("fea04_java_counts", f"""WITH RECURSIVE {_SEG_STRIPPED},
rc AS (SELECT doc_id, count(DISTINCT caller) AS n_rec FROM edges_ WHERE caller = callee GROUP BY doc_id),
j AS (SELECT doc_id, {JAVA_RM} AS s FROM programs WHERE lang = 'java'), {nesting_sql('j', 'doc_id', 's')}
SELECT doc_id, {_rc('s', r'\bif\s*\(')} AS n_if, {_rc('s', r'\bswitch\s*\(')} AS n_switch,
  {_rc('s', r'\bfor\s*\(')} + {_rc('s', r'\bwhile\s*\(')} - {_rc('s', r'\}\s*while\s*\(')} AS n_loop,
  {_rc('s', r'\bbreak\s*;')} AS n_break, {_rc('s', r'\bnew\s+PriorityQueue\b')} AS n_priority,
  {_rc('s', r'\.sort\s*\(')} AS n_sort, {_rc('s', r'\bnew\s+HashMap\b')} AS n_hashmap, {_rc('s', r'\bnew\s+HashSet\b')} AS n_hashset,
  CAST(greatest(nest.n - 1, 0) AS INTEGER) AS nested,
  {_rc('s', FE.JAVA_VAR)} AS n_vars, {_rc('s', '(?m)' + FE.JAVA_HEADER)} AS n_methods,
  {_rc('s', ';')} + {_rc('s', r'\b(?:if|for|while|switch|do|try)\b')} AS n_statements,
  CAST(coalesce(rc.n_rec, 0) AS BIGINT) AS n_recursive
FROM j JOIN nest USING (doc_id) LEFT JOIN rc USING (doc_id)""")
