"""Lexical program features (FEA3-FEA10) and method segmentation.

The reference walks syntax trees; here every feature is a regular-expression
count or a fold over tokens/lines of the comment-stripped text, evaluated as
built-in column expressions.  Per-method work (segments, call edges) uses
windows partitioned by document, so its size is bounded by one program.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complexa.functions.text import WS

# Keywords that look like calls but are not method invocations
CALL_KEYWORDS = ["if", "for", "while", "switch", "catch", "synchronized", "return", "elif", "not",
                 "and", "or", "in", "def", "class", "new", "super", "this"]
JAVA_HEADER = r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\],]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\{"
PY_HEADER = r"^def\s+(\w+)\s*\("
LITERAL = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
JAVA_VAR = r"\b(?:int|long|double|float|boolean|char|byte|short|String|[A-Z]\w*(?:<[^<>;]*>)?)(?:\[\])*\s+[a-z_]\w*\s*(?:=|;|:)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rcount(text, pattern: str) -> Column:
    return F.regexp_count(_c(text), F.lit(pattern)).cast("int")


LOOP_TOKENS = r"\b(?:for|while|do)\b|[(){};]"
# ``state``: what the next tokens belong to
_PLAIN, _HEADER, _BODY, _DO = 0, 1, 2, 3


def loop_nesting(src) -> Column:
    """Deepest nesting of for / while loops, braced or not (0: no loop); a do block is no loop, nor is its ``while``.

    A fold over the tokens with the brace depth, the parenthesis depth and a
    stack of open statements: a loop body or do block that opened with a brace
    is entered as the depth outside it, a loop body without one as -1 - depth.
    A statement that ends at depth d also ends the braceless bodies waiting there.
    """
    toks = F.regexp_extract_all(_c(src), F.lit(LOOP_TOKENS), 0)
    empty = F.array().cast("array<int>")
    init = F.struct(F.lit(0).alias("d"), F.lit(0).alias("p"), F.lit(_PLAIN).alias("state"), F.lit(False).alias("after_do"),
                    empty.alias("loops"), empty.alias("dos"), F.lit(0).alias("mx"))

    def make(d, p, state, after_do, loops, dos, mx):
        return F.struct(d.alias("d"), p.alias("p"), (state if isinstance(state, Column) else F.lit(state)).alias("state"),
                        (after_do if isinstance(after_do, Column) else F.lit(after_do)).alias("after_do"),
                        loops.alias("loops"), dos.alias("dos"), mx.alias("mx"))

    def step(a, t):
        d, p, loops, dos, mx = a["d"], a["p"], a["loops"], a["dos"], a["mx"]
        body = a["state"] == _BODY
        # a token other than '{' after a loop header starts a braceless body
        opened = F.when(body & (t != "{"), F.concat(loops, F.array(-1 - d))).otherwise(loops)
        deep = F.greatest(mx, F.size(opened))
        is_do_while = (t == "while") & a["after_do"]
        header = F.when(is_do_while, F.lit(_DO)).otherwise(F.lit(_HEADER))
        braced = F.when(body, F.concat(loops, F.array(d))).otherwise(loops)
        do_open = F.when(a["state"] == _DO + 1, F.concat(dos, F.array(d))).otherwise(dos)
        out = F.filter(opened, lambda x: (x >= 0) & (x < d - 1) | (x < 0) & (-1 - x < d - 1))
        in_head = (a["state"] == _HEADER) | (a["state"] == _DO)
        return (F.when((t == "for") | (t == "while"), make(d, F.lit(0), header, False, opened, dos, deep))
                .when(t == "do", make(d, p, _DO + 1, False, opened, dos, deep))
                .when(t == "(", make(d, p + 1, F.when(body, F.lit(_PLAIN)).otherwise(a["state"]), False, opened, dos, deep))
                .when(t == ")", make(d, p - 1, F.when((p == 1) & (a["state"] == _HEADER), F.lit(_BODY)).when((p == 1) & in_head, F.lit(_PLAIN))
                                     .when(body, F.lit(_PLAIN)).otherwise(a["state"]), False, opened, dos, deep))
                .when(t == "{", make(d + 1, p, _PLAIN, False, braced, do_open, F.greatest(mx, F.size(braced))))
                .when(t == "}", make(d - 1, p, _PLAIN, F.array_contains(dos, d - 1), out, F.filter(dos, lambda x: x < d - 1), deep))
                # ';' ends a statement unless it stands in a header
                .otherwise(make(d, p, F.when(in_head & (p > 0), a["state"]).otherwise(F.lit(_PLAIN)), False,
                                F.when(in_head & (p > 0), opened).otherwise(F.filter(opened, lambda x: (x >= 0) | (-1 - x < d))), dos, deep)))

    return F.aggregate(toks, init, step)["mx"].cast("int")


def nested_loop_depth(src, version: int = 1) -> Column:
    """FEA6.  v1: loops below the outermost one (0 for none and for a single loop, 1 for two nested); v2: loops nested (0, 1, 2)."""
    n = loop_nesting(src)
    return n if version == 2 else F.greatest(n - 1, F.lit(0)).cast("int")


def java_counts(src, version: int = 1) -> Column:
    """FEA4 (v1 counts that are per-text): struct of if, switch, loop, break, PriorityQueue,
    sort, HashMap, HashSet, nested depth, variables, methods, statements."""
    s = _c(src)
    return F.struct(
        rcount(s, r"\bif\s*\(").alias("n_if"),
        rcount(s, r"\bswitch\s*\(").alias("n_switch"),
        (rcount(s, r"\bfor\s*\(") + rcount(s, r"\bwhile\s*\(") - rcount(s, r"\}\s*while\s*\(")).alias("n_loop"),
        rcount(s, r"\bbreak\s*;").alias("n_break"),
        rcount(s, r"\bnew\s+PriorityQueue\b").alias("n_priority"),
        rcount(s, r"\.sort\s*\(").alias("n_sort"),
        rcount(s, r"\bnew\s+HashMap\b").alias("n_hashmap"),
        rcount(s, r"\bnew\s+HashSet\b").alias("n_hashset"),
        nested_loop_depth(s, version).alias("nested"),
        rcount(s, JAVA_VAR).alias("n_vars"),
        rcount(s, "(?m)" + JAVA_HEADER).alias("n_methods"),
        (rcount(s, ";") + rcount(s, r"\b(?:if|for|while|switch|do|try)\b")).alias("n_statements"),
    )


PY_KEYWORDS = ["False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif",
               "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or",
               "pass", "raise", "return", "try", "while", "with", "yield"]
PY_WORDLESS = LITERAL + "|#[^\r\n]*"


def py_names(src) -> Column:
    """FEA3: top-level functions, nested defs/methods, assignments, attributes assigned on ``self``, distinct
    identifiers (no keywords, no words of strings or comments)."""
    s = _c(src)
    code = F.regexp_replace(s, PY_WORDLESS, " ")
    words = F.array_distinct(F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*"), 0))
    attrs = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\bself\.([A-Za-z_]\w*)\s*(?:[-+*/%]?=)[^=]"), 1))
    return F.struct(
        rcount(s, r"(?m)^def\s").alias("n_funcs"),
        rcount(s, r"(?m)^[ \t]+def\s").alias("n_methods"),
        rcount(s, r"(?m)^[ \t]*[A-Za-z_]\w*\s*(?:[-+*/%]?=)[^=]").alias("n_assign"),
        F.size(attrs).cast("int").alias("n_attrs"),
        F.size(F.array_except(words, F.array(*[F.lit(k) for k in PY_KEYWORDS]))).cast("int").alias("n_names"),
    )


JAVA_OPEN_HEADER = JAVA_HEADER.removesuffix(r"\{") + "$"
CALL = r"([A-Za-z_]\w*)\s*\("


def calls_in(line: Column) -> Column:
    """Names called in a line (constructor calls and keywords are none)."""
    names = F.regexp_extract_all(F.regexp_replace(line, r"\bnew\s+\w+", "new"), F.lit(CALL), 1)
    keywords = F.array(*[F.lit(k) for k in CALL_KEYWORDS])
    return F.filter(names, lambda c: ~F.array_contains(keywords, c))


def segment_items(src, lang) -> Column:
    """FEA9: array of (pos, line, method, is_header): each line with the method it belongs to (null: none).

    A fold over the lines of the row.  Java: a header at brace depth 1 opens a
    method, also with its brace on the next line; the method ends with the line
    after which the depth is 1 again, so a line of unknown owner has none.
    Python: a top-level ``def`` opens a function, indented or blank lines
    continue it, any other line ends it.
    """
    java = _c(lang) == "java"

    def fact(line: Column, pos: Column) -> Column:
        quoted = line.contains('"') | line.contains("'")
        # braces inside string / char literals do not nest (the regex only runs on lines with a quote)
        code = F.when(quoted, F.regexp_replace(line, LITERAL, '""')).otherwise(line)
        net = F.length(F.replace(code, F.lit("}"), F.lit(""))) - F.length(F.replace(code, F.lit("{"), F.lit("")))
        call = line.contains("(")
        name = F.when(call & java, F.regexp_extract(line, JAVA_HEADER, 1)).when(call, F.regexp_extract(line, PY_HEADER, 1)).otherwise("")
        bare = F.when(call & java & ~line.contains("{"), F.regexp_extract(line, JAVA_OPEN_HEADER, 1)).otherwise("")
        inside = F.when(java, F.ltrim(line).startswith("{")).otherwise(line.rlike(f"^[{WS}]") | ~line.rlike(f"[^{WS}]"))
        return F.struct(pos.alias("pos"), line.alias("line"), net.alias("net"), F.nullif(name, F.lit("")).alias("name"),
                        F.nullif(bare, F.lit("")).alias("bare"), inside.alias("inside"))

    none = F.lit(None).cast("string")
    init = F.struct(F.lit(0).alias("d"), none.alias("cur"), F.lit(False).alias("wait"),
                    F.array().cast("array<struct<pos:int,line:string,method:string,is_header:boolean>>").alias("out"))

    def step(a, x):
        d = a["d"]
        head = F.when(java, F.when(d == 1, F.coalesce(x["name"], x["bare"]))).otherwise(x["name"])
        goes_on = F.when(java, (d >= 2) | (d == 1) & a["wait"] & x["inside"]).otherwise(x["inside"])
        method = F.coalesce(head, F.when(goes_on, a["cur"]))
        after = d + x["net"]
        wait = java & F.when(head.isNotNull(), x["name"].isNull()).otherwise(F.lit(False))
        cur = F.when(java & (after <= 1) & ~wait, none).otherwise(method)
        item = F.struct(x["pos"].alias("pos"), x["line"].alias("line"), method.alias("method"), head.isNotNull().alias("is_header"))
        return F.struct(after.alias("d"), cur.alias("cur"), wait.alias("wait"), F.concat(a["out"], F.array(item)).alias("out"))

    return F.aggregate(F.transform(F.split(_c(src), "\n"), fact), init, step)["out"]


def method_segments(progs: DataFrame, doc: str = "doc_id", src: str = "src", lang: str = "lang",
                    keep: tuple = ()) -> DataFrame:
    """FEA9, long form: (doc_id, pos, line, method, is_header), from the row's own fold (no shuffle)."""
    return progs.select(doc, lang, *keep, F.inline(segment_items(src, lang)))


def split_methods(src, lang) -> Column:
    """FEA9 in figures (Arrow, where the rows are): struct(n_methods, method_lines, main_pos) of a program; main_pos is the last line of ``main``."""
    import pyarrow as pa

    from complexa.functions import segments
    from complexa.functions.arrow import per_row
    kind = pa.struct([("n_methods", pa.int64()), ("method_lines", pa.int64()), ("main_pos", pa.int32())])
    return per_row(segments.split_counts, kind, "n_methods long, method_lines long, main_pos int", _c(src), _c(lang))


def edge_items(items: Column) -> Column:
    """Distinct (caller, callee) of a program's items (headers excluded)."""
    body = F.filter(items, lambda x: x["method"].isNotNull() & ~x["is_header"])
    return F.array_distinct(F.flatten(F.transform(body, lambda x: F.transform(
        calls_in(x["line"]), lambda c: F.struct(x["method"].alias("caller"), c.alias("callee"))))))


def call_edges(progs: DataFrame, doc: str = "doc_id", src: str = "src", lang: str = "lang") -> DataFrame:
    """FEA7: (doc_id, caller, callee) from call sites inside each method body, worked out in the program's row."""
    import pyarrow as pa

    from complexa.functions import segments
    from complexa.functions.arrow import per_row
    kind = pa.list_(pa.struct([("caller", pa.string()), ("callee", pa.string())]))
    rows = progs.select(doc, per_row(segments.edges, kind, "array<struct<caller:string,callee:string>>", _c(src), _c(lang)).alias("_e"))
    return rows.select(doc, F.inline("_e"))


def feature_vector(cols: list) -> Column:
    """FEA10: 13 numbers -> ml Vector."""
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.array(*[_c(c).cast("double") for c in cols]))


def java_feature_table(progs: DataFrame, doc: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """FEA4 / FEA10: the v1 text counts (struct ``c``) and the number of methods that call
    themselves, all from the program's own row (no shuffle)."""
    from complexa.functions.text import remove_comments
    s = progs.withColumn("src", remove_comments("src", "lang"))
    own = F.filter(edge_items(segment_items("src", "lang")), lambda e: e["caller"] == e["callee"])
    return s.select(doc, *keep, java_counts("src").alias("c"), F.size(own).cast("long").alias("n_recursive"))


V1_ORDER = ["n_if", "n_switch", "n_loop", "n_break", "n_priority", "n_sort", "n_hashmap", "n_hashset",
            "n_recursive", "nested", "n_vars", "n_methods", "n_statements"]


def v1_columns() -> list:
    """The 13 v1 features in the reference's order, as columns of ``java_feature_table``."""
    return [F.col("n_recursive") if f == "n_recursive" else F.col(f"c.{f}") for f in V1_ORDER]


def java_vector(src: str = "src", lang: str = "lang") -> Column:
    """FEA10 (Java): the 13 v1 features as an array of doubles, in the reference's order."""
    from complexa.functions.text import remove_comments
    text = remove_comments(src, lang)
    c = java_counts(text)
    own = F.size(F.filter(edge_items(segment_items(text, lang)), lambda e: e["caller"] == e["callee"]))
    return F.array(*[(own if f == "n_recursive" else c[f]).cast("double") for f in V1_ORDER])


def python_vector(src: str = "src") -> Column:
    """FEA10 (Python; Arrow, where the rows are): 13 features as an array of doubles, in the reference's order: those of ``py_counts``,
    the names and attributes of ``py_names``, ``py_depth``, and the assignments, methods and functions of ``py_names``."""
    import pyarrow as pa

    from complexa.functions import counts
    from complexa.functions.arrow import per_row
    return per_row(counts.python_counts, pa.list_(pa.float64()), "array<double>", _c(src))


def level_counts(src) -> Column:
    """FEA5 by breadth-first level (Arrow, where the rows are): array of one struct of ``counts.LEVEL_COUNTS``, null without a ``main``."""
    import pyarrow as pa

    from complexa.functions import counts
    from complexa.functions.arrow import per_row

    def rule(text: str | None) -> list[tuple] | None:
        found = counts.level_counts(text)
        return None if found is None else [found]

    kind = pa.list_(pa.struct([(n, pa.int32()) for n in counts.LEVEL_COUNTS]))
    return per_row(rule, kind, f"array<struct<{','.join(f'{n}:int' for n in counts.LEVEL_COUNTS)}>>", _c(src))


def rolled_up_counts(src) -> Column:
    """FEA5 for any call graph (Arrow, where the rows are): struct of the counts of ``main`` with its callees', null without
    a ``main``; see ``javascan.rollup``."""
    from complexa.functions import javascan
    names = [*javascan.COUNTS, "nested", "n_recursive"]

    def rule(texts: pd.Series) -> pd.DataFrame:
        found = [None if t is None else javascan.rollup(t) for t in texts]
        return pd.DataFrame({n: pd.array([None if f is None else f[n] for f in found], "Int64") for n in names})

    return F.pandas_udf(rule, ", ".join(f"{n} long" for n in names))(_c(src))


def declared_methods(src) -> Column:
    """FEA9 with nested classes (Arrow, where the rows are): array of (path, method, arity, first_line, last_line)."""
    from complexa.functions import javascan
    kind = "array<struct<path:string,method:string,arity:int,first_line:int,last_line:int>>"
    return F.pandas_udf(lambda texts: pd.Series([None if t is None else javascan.method_table(t) for t in texts], dtype=object), kind)(_c(src))
