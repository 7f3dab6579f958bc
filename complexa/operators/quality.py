"""Quality gates and dead-code removal (FLT1-FLT6, JOIN6, PRJ21, WIN6, AGG22).

Rules that must tell code from literals use the lexer in Arrow batches.  Gates are boolean columns, so a filter and its quarantine table come from
one expression; dead declarations are found and dropped in the program's own row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complexa.functions import javascan, lexer, segments
from complexa.functions.arrow import per_row
from complexa.functions.features import LITERAL, PY_WORDLESS
from complexa.functions.text import WS, remove_comments


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _count(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def lexical_gate(src, lang) -> Column:
    """FLT1 (re-aimed): non-empty after comment removal and balanced (), {}, [] counts."""
    s = remove_comments(src, lang)
    return ((F.length(F.regexp_replace(s, f"[{WS}]", "")) > 0)
            & (_count(s, "(") == _count(s, ")")) & (_count(s, "{") == _count(s, "}"))
            & (_count(s, "[") == _count(s, "]")))


def delete_error(df: DataFrame, src: str = "src", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """FLT1: (kept, quarantined) split of one gate column."""
    g = df.withColumn("_ok", lexical_gate(src, lang))
    return g.filter("_ok").drop("_ok"), g.filter(~F.col("_ok")).drop("_ok")


_BRACKET = r"[()\[\]{}]"


def drop_unreachable_lines(src) -> Column:
    """FLT4 (Python): drop lines after return/raise/break/continue in the same block (whole run).

    A fold over the lines: after a terminator at indent k, lines indented
    >= k are unreachable until a line with a smaller indent; blank lines are
    kept.  A terminator lasts until its brackets are closed and no backslash
    continues it, and lines inside an open bracket belong to their statement.
    Texts with triple quotes are left as they are: their lines need not be code.
    """
    text = _c(src)

    def fact(line: Column) -> Column:
        code = F.regexp_replace(F.regexp_replace(line, LITERAL, '""'), "#.*", "")
        marks = F.regexp_extract_all(code, F.lit(_BRACKET), 0)
        net = F.aggregate(marks, F.lit(0), lambda n, m: n + F.when(m.isin("(", "[", "{"), 1).otherwise(-1))
        return F.struct(line.alias("line"), F.length(F.regexp_extract(line, f"^[{WS}]*", 0)).alias("ind"),
                        (~line.rlike(f"[^{WS}]")).alias("blank"), net.alias("net"), code.rlike(r"\\\s*$").alias("more"),
                        line.rlike(r"^\s*(?:return|raise|break|continue)\b").alias("term"))

    init = F.struct(F.lit(None).cast("int").alias("dead"), F.lit(0).alias("open"), F.lit(False).alias("more"), F.lit(False).alias("gone"),
                    F.lit(None).cast("int").alias("end"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        inner = (a["open"] > 0) | a["more"]  # inside the statement that an earlier line began
        fresh_gone = a["dead"].isNotNull() & (x["ind"] >= a["dead"]) & ~x["blank"]
        gone = F.when(inner, a["gone"]).otherwise(fresh_gone)
        open_ = F.greatest(a["open"] + x["net"], F.lit(0))
        end = F.when(inner, a["end"]).when(~fresh_gone & x["term"], x["ind"]).otherwise(F.lit(None).cast("int"))
        still = (open_ > 0) | x["more"]
        kept_dead = F.when(inner | fresh_gone | x["blank"], a["dead"]).otherwise(F.lit(None).cast("int"))
        dead = F.when(~still & end.isNotNull(), end).otherwise(kept_dead)
        out = F.when(gone, a["out"]).otherwise(F.concat(a["out"], F.array(x["line"])))
        return F.struct(dead.alias("dead"), open_.alias("open"), x["more"].alias("more"), gone.alias("gone"),
                        F.when(still, end).alias("end"), out.alias("out"))

    folded = F.array_join(F.aggregate(F.transform(F.split(text, "\n"), fact), init, step)["out"], "\n")
    return F.when(text.contains('"' + '""') | text.contains("'" + "''"), text).otherwise(folded)


def _by_program(rule: Callable[[str], str], src) -> Column:
    """A lexer rule on every program of a batch (Arrow, where the rows are; null stays null)."""
    return F.pandas_udf(lambda texts: pd.Series([None if t is None else rule(t) for t in texts], dtype=object), "string")(_c(src))


def unreachable_dropped(src) -> Column:
    """FLT4 (Python) with a lexer: docstrings, f-strings and comments are what they are, and lines inside brackets,
    literals or after a backslash belong to their statement.  ``drop_unreachable_lines`` is the
    JVM-side line rule, which leaves texts with triple quotes alone."""
    return _by_program(lexer.drop_unreachable, src)


def unused_assignments_dropped(src) -> Column:
    """FLT6 (Python) with a lexer: unused side-effect-free assignments go; names in f-string fields count as read."""
    return _by_program(lexer.drop_unused_assignments, src)


def unused_functions_dropped(src) -> Column:
    """FLT6 (Python) with a lexer: top-level functions that nothing outside them names (called, passed, stored or used as a decorator) go."""
    return _by_program(lexer.drop_unused_functions, src)


def identifiers_renamed(src, lang) -> Column:
    """PRJ21 with a lexer: as ``rename_identifiers``, but literals and comments stay, and f-string fields follow their names."""
    both = F.pandas_udf(lambda texts, langs: pd.Series([None if t is None else lexer.rename(t, lang) for t, lang in zip(texts, langs, strict=True)],
                                                       dtype=object), "string")
    return both(_c(src), _c(lang))


def dead_declarations_dropped(src) -> Column:
    """FLT5 (Java) for nested classes and overloads: struct(src, dropped, dropped_classes); see ``javascan.drop_dead``.
    ``drop_dead_declarations`` is the JVM-side rule by lines, for methods of one class level."""
    def rule(texts: pd.Series) -> pd.DataFrame:
        done = [(None, None, None) if t is None else javascan.drop_dead(t) for t in texts]
        return pd.DataFrame(done, columns=["src", "dropped", "dropped_classes"], dtype=object)

    return F.pandas_udf(rule, "src string, dropped array<string>, dropped_classes array<string>")(_c(src))


def unreferenced(decls: DataFrame, refs: DataFrame, keys=("doc_id", "name")) -> DataFrame:
    """JOIN6: declarations with no reference (left anti join on (document, name))."""
    return decls.join(refs.select(*keys).distinct(), list(keys), "left_anti")


def method_table(progs: DataFrame, doc: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """Per program: its lines (with their method), declared methods and dead methods, all
    worked out in the program's own row (no shuffle).

    Java: a method is live if it is 'main' or invoked anywhere (its own body
    included).  Python: a function is live if its name starts with '_', is
    'main', or is called outside its own body (a recursive call alone does not count).
    """
    rows = progs.select(doc, "lang", *keep, per_row(_methods_of, _METHODS, _METHODS_SQL, F.col("src"), F.col("lang")).alias("_t"))
    return rows.select(doc, "lang", *keep, "_t.items", "_t.decls", "_t.dead")


_ITEMS = pa.list_(pa.struct([("pos", pa.int32()), ("line", pa.string()), ("method", pa.string()), ("is_header", pa.bool_())]))
_METHODS = pa.struct([("items", _ITEMS), ("decls", pa.list_(pa.string())), ("dead", pa.list_(pa.string()))])
_METHODS_SQL = "items array<struct<pos:int,line:string,method:string,is_header:boolean>>, decls array<string>, dead array<string>"


def _methods_of(text: str | None, lang: str | None) -> tuple:
    if text is None:
        return None, None, None
    items = segments.segment(text, lang)
    return [(i, *x) for i, x in enumerate(items)], *segments.methods(items, lang)


def dead_methods(progs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """FLT5/FLT6 decision table: (doc_id, lang, name) of methods that are never invoked."""
    def dead(text: str | None, lang: str | None) -> list[str] | None:
        return None if text is None else segments.methods(segments.segment(text, lang), lang)[1]

    rows = progs.select(doc, "lang", per_row(dead, pa.list_(pa.string()), "array<string>", F.col("src"), F.col("lang")).alias("dead"))
    return rows.select(doc, "lang", F.explode("dead").alias("name"))


CLASS_HEADER = r"\bclass\s+([A-Za-z_]\w*)"


def class_items(src) -> Column:
    """Per line the top-level Java class that it belongs to (null: none)."""
    def fact(line: Column) -> Column:
        code = F.regexp_replace(line, LITERAL, '""')
        net = F.length(F.replace(code, F.lit("}"), F.lit(""))) - F.length(F.replace(code, F.lit("{"), F.lit("")))
        return F.struct(net.alias("net"), F.regexp_extract(line, CLASS_HEADER, 1).alias("name"))

    none = F.lit(None).cast("string")
    init = F.struct(F.lit(0).alias("d"), none.alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        cur = F.when(a["d"] == 0, F.nullif(x["name"], F.lit(""))).otherwise(a["cur"])
        return F.struct((a["d"] + x["net"]).alias("d"), cur.alias("cur"), F.concat(a["out"], F.array(cur)).alias("out"))

    return F.aggregate(F.transform(F.split(_c(src), "\n"), fact), init, step)["out"]


def drop_dead_declarations(progs: DataFrame, doc: str = "doc_id", dead_code: float = 1.0, seed: int = 777) -> DataFrame:
    """FLT5 (Java) / FLT6 (Python functions): remove the lines of dead methods, and of top-level
    Java classes that neither hold ``main`` nor are instantiated anywhere.

    ``dead_code`` is the drop probability per dead declaration (hash-decided, 1 = always).
    A line of unknown owner always stays.  Returns (doc_id, lang, src, dropped,
    dropped_classes) with lines re-assembled in order; every step is row-local.
    """
    java = F.col("lang") == "java"
    t = method_table(progs.withColumn("classes", F.when(java, class_items("src"))), doc, keep=("classes",))
    made = F.flatten(F.transform("items", lambda x: F.regexp_extract_all(x["line"], F.lit(r"\bnew\s+([A-Za-z_]\w*)"), 1)))
    home = F.transform(F.filter("items", lambda x: x["is_header"] & (x["method"] == "main")), lambda x: F.get("classes", x["pos"]))
    t = t.withColumn("live", F.concat(made, home))
    dead_classes = F.filter(F.array_distinct("classes"), lambda c: c.isNotNull() & ~F.coalesce(F.array_contains("live", c), F.lit(False)))
    dead = F.col("dead")
    if dead_code < 1.0:
        from complexa.operators.splits import hash_order

        def drawn(d):
            return hash_order(seed, F.col(doc), d) % 1000000 < int(dead_code * 1000000)

        dead, dead_classes = F.filter("dead", drawn), F.filter(dead_classes, drawn)
    t = t.withColumn("dropped", dead).withColumn("dropped_classes", F.coalesce(dead_classes, F.array().cast("array<string>")))
    kept = F.filter("items", lambda x: (x["method"].isNull() | ~F.array_contains("dropped", x["method"]))
                    & ~F.coalesce(F.array_contains("dropped_classes", F.get("classes", x["pos"])), F.lit(False)))
    return t.select(doc, "lang", F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("src"), "dropped", "dropped_classes")


def unused_names(progs: DataFrame, doc: str = "doc_id", src: str = "src") -> DataFrame:
    """FLT6 report: Python names that are stored but never loaded, (doc_id, name, kind)."""
    s = F.col(src)
    stores = progs.select(doc, F.explode(F.regexp_extract_all(s, F.lit(r"(?m)^[ \t]*([A-Za-z_]\w*)\s*=[^=]"), 1)).alias("name"))
    words = progs.select(doc, F.explode(F.regexp_extract_all(s, F.lit(r"[A-Za-z_]\w*"), 0)).alias("name"))
    n_store = stores.groupBy(doc, "name").agg(F.count(F.lit(1)).alias("ns"))
    n_word = words.groupBy(doc, "name").agg(F.count(F.lit(1)).alias("nw"))
    return (n_store.join(n_word, [doc, "name"]).filter(F.col("nw") <= F.col("ns"))
            .select(doc, "name", F.lit("variable").alias("kind")))


STORE = r"^[ \t]*([A-Za-z_]\w*)\s*=\s*[^=\s]"
#: A right-hand side that only reads names and literals (no call, index or lambda).
PLAIN_RHS = r"^[ \t]*[A-Za-z_]\w*\s*=\s*[\w.+\-*/%\"' \t]+$"


def drop_unused_assignments(src) -> Column:
    """FLT6: drop lines that only assign a side-effect-free value to a name that is never read (Python).

    A line goes only if the statement before it stands at the same indent, so no
    block is left empty, and no bracket is open.  Texts with triple quotes are
    left as they are.
    """
    text = _c(src)
    stores = F.regexp_extract_all(text, F.lit("(?m)" + STORE), 1)
    words = F.regexp_extract_all(F.regexp_replace(text, PY_WORDLESS, " "), F.lit(r"[A-Za-z_]\w*"), 0)
    unused = F.filter(F.array_distinct(stores), lambda n: F.size(F.filter(words, lambda w: w == n)) <= F.size(F.filter(stores, lambda x: x == n)))

    def fold(names: Column) -> Column:
        def fact(line: Column) -> Column:
            code = F.regexp_replace(line, PY_WORDLESS, " ")
            net = F.length(F.regexp_replace(code, r"[^(\[{]", "")) - F.length(F.regexp_replace(code, r"[^)\]}]", ""))
            plain = line.rlike(PLAIN_RHS) & F.array_contains(names, F.regexp_extract(line, STORE, 1))
            return F.struct(line.alias("line"), F.length(F.regexp_extract(line, f"^[{WS}]*", 0)).alias("ind"),
                            (~line.rlike(f"[^{WS}]")).alias("blank"), net.alias("net"), plain.alias("plain"))

        init = F.struct(F.lit(None).cast("int").alias("prev"), F.lit(0).alias("open"), F.array().cast("array<string>").alias("out"))

        def step(a, x):
            gone = F.coalesce(x["plain"] & (a["open"] == 0) & (a["prev"] == x["ind"]), F.lit(False))
            return F.struct(F.when(x["blank"], a["prev"]).otherwise(x["ind"]).alias("prev"), (a["open"] + x["net"]).alias("open"),
                            F.when(gone, a["out"]).otherwise(F.concat(a["out"], F.array(x["line"]))).alias("out"))

        return F.array_join(F.aggregate(F.transform(F.split(text, "\n"), fact), init, step)["out"], "\n")

    cleaned = F.get(F.transform(F.array(unused), fold), F.lit(0))
    return F.when(text.contains('"' + '""') | text.contains("'" + "''"), text).otherwise(cleaned)


# ---------------------------------------------------------------- PRJ21 rename
def rename_identifiers(src) -> Column:
    """PRJ21: declared variables / methods (not main) / classes -> VARk / METHODk / CLASSk.

    Dense numbering per kind by first occurrence.  The text is split into words
    and the rest once, each word is looked up in the dictionary of declared
    names (class before method before variable) and the pieces are joined
    again, so a new name is never renamed a second time.
    """
    return per_row(lambda t: None if t is None else segments.rename(t), pa.string(), "string", _c(src))


# ---------------------------------------------------------------- WIN6 + AGG22
def mutate(src, lang, n_mut) -> Column:
    """struct(out, failed) after ``n_mut`` mutations (the mutators take turns: comment strip, rename, and for Python dead lines).

    A mutation whose result does not pass the lexical gate fails: the last text that
    passed is kept.  Arrow batches, where the rows are; see ``segments.mutated``.
    """
    kind = pa.struct([("out", pa.string()), ("failed", pa.bool_())])
    return per_row(segments.mutated, kind, "out string, failed boolean", _c(src), _c(lang), n_mut.cast("long"))


def augment_job(progs: DataFrame, n_mut: Column, doc: str = "doc_id", keep_on_failure: bool = True) -> DataFrame:
    """WIN6: ``n_mut`` mutations per program.  A failed program keeps the last text that passed the
    gate (Java) or is dropped (Python, with ``keep_on_failure`` off).  Adds ``failed`` for AGG22."""
    d = progs.withColumn("_m", mutate("src", "lang", n_mut)).withColumn("out", F.col("_m.out")).withColumn("failed", F.col("_m.failed")).drop("_m")
    if not keep_on_failure:
        d = d.filter(~((F.col("lang") == "python") & F.col("failed"))).withColumn("failed", F.coalesce("failed", F.lit(False)))
    return d  # without a text failed is null: a Python one is dropped, the ledger's share leaves it out


def resample_augmented(progs: DataFrame, target: int, first: tuple[int, int] | dict[str, tuple[int, int]],
                       more: tuple[int, int] | dict[str, tuple[int, int]], doc: str = "doc_id", seed: int = 777,
                       keep_on_failure: bool = True) -> DataFrame:
    """WIN6, whole job: every program once with first[0]..first[1] mutations, then draws with replacement, with
    more[0]..more[1] mutations, up to ``target`` rows (before failures are dropped).  Ranges are for all programs
    or per language.  Adds out, failed, n_mut and draw (null for the first pass)."""
    from complexa.operators.splits import hash_order, mutation_count, resample_to
    from complexa.session import work_parts

    def per_lang(ranges, count) -> Column:
        if isinstance(ranges, tuple):
            return count(*ranges)
        return F.coalesce(*(F.when(F.col("lang") == lang, count(*r)) for lang, r in ranges.items()))

    n = per_lang(first, lambda lo, hi: mutation_count(doc, lo, hi, seed=seed))
    base = augment_job(progs.withColumn("n_mut", n), F.col("n_mut"), doc, keep_on_failure).withColumn("draw", F.lit(None).cast("long"))
    missing = max(0, target - progs.count())
    # the draws are few bytes and much work
    drawn = resample_to(progs.select(doc), doc, missing, seed).repartition(work_parts(progs.sparkSession), doc).join(progs, doc)
    n = per_lang(more, lambda lo, hi: (F.lit(lo) + hash_order(f"{seed}-mut", doc, "draw") % (hi - lo + 1)).cast("int"))
    return base.unionByName(augment_job(drawn.withColumn("n_mut", n), F.col("n_mut"), doc, keep_on_failure))
