"""Text scalar functions over source code (PRJ4-8, PRJ21, FEA1, FEA2, FEA8, WIN7).

All functions return ``Column`` expressions built from Spark built-ins
(``regexp_replace``, ``split``, higher-order ``filter``/``aggregate``), so they
run inside whole-stage codegen on the executors, one row at a time, with no
Python in the data path.  Patterns are written so Java regex (Spark) and RE2
(the DuckDB oracle) agree: no look-around, explicit flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (do not edit).
# Comment patterns, applied with MULTILINE + DOTALL and replaced by group 1.
JAVA_COMMENT = r"""(".*?"|'.*?')|(/\*.*?\*/|//[^\r\n]*$)"""
PYTHON_COMMENT = r'''(".*?"|'.*?'|=[^\S\n\t]*""".*""")|(#[^\r\n]*$|""".*""")'''
# C-style variant: a comment becomes one space, string literals are kept
C_COMMENT = r"""//.*?$|/\*.*?\*/"""
C_STRING = r"'(?:\\.|[^\\'])*'" + "|" + r'"(?:\\.|[^\\"])*"'
# Import / package statements
IMPORT_RULE = r"import[^;]*;"
PACKAGE_RULE = r"package[^;]*;"
# Length buckets: fewer than 256, 512, 1024 tokens, else 'over'
LENGTH_BORDERS = [(256, "256"), (512, "512"), (1024, "1024")]
# ---------------------------------------------------------------------------

# Python str.splitlines() boundaries and string.whitespace
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
WS = " \t\n\r\u000b\u000c"
# Python's str.strip() whitespace: every character for which str.isspace() holds
PY_SPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
PY_STRIP = f"^[{PY_SPACE}]+|[{PY_SPACE}]+$"
# Lexical token: identifier, number, or one other non-space character
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^A-Za-z0-9_ \t\r\n\f]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def python_regex(pattern: str) -> str:
    """Give a pattern written for Python's ``re`` the same meaning in Java regex and RE2:
    the class "whitespace except newline and tab" is spelled out with Python's (Unicode)
    whitespace set, which both other dialects would otherwise read as ASCII-only."""
    ws = "".join(ch for ch in PY_SPACE if ch not in "\n\t")
    return pattern.replace(r"[^\S\n\t]", f"[{ws}]")


def py_strip(text) -> Column:
    """Python's ``str.strip()``: leading and trailing whitespace of every kind (not only spaces).
    A character-set trim, no regular expression."""
    return F.trim(_c(text), F.lit(PY_SPACE))


def is_blank(line) -> Column:
    """Python's ``line.strip() == ""``."""
    return py_strip(line) == ""


def remove_comments(src, lang) -> Column:
    """PRJ4 / PRJ8: java and python comment removal by regex; other languages unchanged.

    ``(?d)`` (UNIX_LINES) makes ``$`` stop before ``\\n`` only, as Python's re does.
    """
    s, lg = _c(src), _c(lang)
    java = F.regexp_replace(s, "(?dms)" + JAVA_COMMENT, "$1")
    py = F.regexp_replace(s, "(?dms)" + python_regex(PYTHON_COMMENT), "$1")
    return F.when(lg == "java", java).when(lg == "python", py).otherwise(s)


def drop_blank_lines(text) -> Column:
    """Keep lines with a non-whitespace character (Python's ``line.strip() != ""``), joined by ``\\n``."""
    return F.array_join(F.filter(F.split(_c(text), "\n"), lambda l: ~is_blank(l)), "\n")


def strip_comments_c(src) -> Column:
    """PRJ5: comment -> one space, string literals kept (escapes honoured), blank lines dropped.

    The replacement depends on which branch matched, which one regex replace
    cannot express; comments are first wrapped in control characters, then
    translated.
    """
    marked = F.regexp_replace(_c(src), f"(?dms)({C_COMMENT})|({C_STRING})", "\u0001$1\u0002$2")
    spaced = F.regexp_replace(marked, "\u0001[^\u0002]+\u0002", " ")
    return drop_blank_lines(F.replace(spaced, F.lit("\u0001\u0002"), F.lit("")))


def strip_python_comments(src) -> Column:
    """PRJ6: python comments and docstrings (PRJ4 regex) plus blank-line removal."""
    return drop_blank_lines(F.regexp_replace(_c(src), "(?dms)" + python_regex(PYTHON_COMMENT), "$1"))


def delete_import(src) -> Column:
    """PRJ7: drop ``import ...;`` and ``package ...;`` statements."""
    return F.regexp_replace(F.regexp_replace(_c(src), IMPORT_RULE, ""), PACKAGE_RULE, "")


def substring_count(text, key: str) -> Column:
    """Python ``str.count``: non-overlapping occurrences, inside words too."""
    t = _c(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(key), F.lit("")))) / F.lit(len(key))).cast("int")


def line_count(text) -> Column:
    """``len(text.splitlines())``: a final line break does not open a new line."""
    t = _c(text)
    parts = F.size(F.split(t, LINE_BREAK))
    ends = t.rlike(f"({LINE_BREAK})$")
    return F.when(F.length(t) == 0, 0).when(ends, parts - 1).otherwise(parts).cast("int")


def py_counts(src) -> Column:
    """FEA1: [if, while+for, break, sort, list+split, lines] as a struct."""
    s = _c(src)
    return F.struct(
        substring_count(s, "if").alias("n_if"),
        (substring_count(s, "while") + substring_count(s, "for")).alias("n_loop"),
        substring_count(s, "break").alias("n_break"),
        substring_count(s, "sort").alias("n_sort"),
        (substring_count(s, "list") + substring_count(s, "split")).alias("n_list"),
        line_count(s).alias("n_lines"),
    )


def _lead(line: Column) -> Column:
    return F.length(F.regexp_extract(line, f"^[{WS}]*", 0))


def py_depth(src) -> Column:
    """FEA2: (max indentation level, max depth of the def/for/while stack).

    unit = first positive leading-whitespace width (default 4); a line pops
    every stack entry >= its level (the stack is strictly increasing, so the
    pop is a ``filter``), then pushes its level when it contains def, for or
    while as a substring.  Per-line facts are extracted once (``transform``),
    then one ``aggregate`` folds them; the unit is computed once per document.
    """
    lines = F.filter(F.split(_c(src), LINE_BREAK), lambda l: ~is_blank(l))
    facts = F.transform(lines, lambda l: F.struct(
        _lead(l).alias("w"), (l.contains("def") | l.contains("for") | l.contains("while")).alias("kw")))
    unit = F.coalesce(F.get(F.filter(F.transform(facts, lambda x: x["w"]), lambda w: w > 0), 0), F.lit(4))
    init = F.struct(F.array().cast("array<int>").alias("st"), F.lit(0).alias("mx"), F.lit(0).alias("mi"),
                    unit.alias("u"))

    def step(acc, x):
        lvl = F.floor(x["w"] / acc["u"]).cast("int")
        kept = F.filter(acc["st"], lambda e: e < lvl)
        st = F.when(x["kw"], F.concat(kept, F.array(lvl))).otherwise(kept)
        return F.struct(st.alias("st"), F.greatest(acc["mx"], lvl).alias("mx"),
                        F.greatest(acc["mi"], F.size(st)).alias("mi"), acc["u"].alias("u"))

    out = F.aggregate(facts, init, step)
    return F.struct(out["mx"].alias("max_depth"), out["mi"].alias("max_stack"))


def token_count(src) -> Column:
    """FEA8: lexical token count (identifiers, numbers, single symbols)."""
    return F.regexp_count(_c(src), F.lit(TOKEN)).cast("int")


def length_bucket(tokens) -> Column:
    """WIN7: '256' / '512' / '1024' / 'over' by token count."""
    t = _c(tokens)
    out = F.lit("over")
    for border, name in reversed(LENGTH_BORDERS):
        out = F.when(t < border, F.lit(name)).otherwise(out)
    return out
