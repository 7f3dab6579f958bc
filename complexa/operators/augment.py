"""The augmentation job with all its mutators, and its failure ledger from the job's own write (WIN6, AGG22).

Mutators take turns, one mutation each: for Java the two comment strippers (PRJ4,
PRJ5), renaming (PRJ21) and dead declarations (FLT5); for Python comments (PRJ4),
renaming, unreachable lines (FLT4), unused assignments and unused functions (FLT6).
A mutation whose result is blank or has unbalanced brackets fails, and the last good
text stays.  Programs are mutated in Arrow batches where they are; nothing is
shuffled.  (``quality.augment_job`` is the job with three mutators.)
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from complexa.functions import javascan, lexer
from complexa.functions.text import C_COMMENT, C_STRING, JAVA_COMMENT, PY_SPACE, PYTHON_COMMENT

_FLAGS = re.M | re.S
_COMMENTS = {"java": re.compile(JAVA_COMMENT, _FLAGS), "python": re.compile(PYTHON_COMMENT, _FLAGS)}
_C = re.compile(f"({C_COMMENT})|({C_STRING})", _FLAGS)


def without_comments(text: str, lang: str) -> str:
    """PRJ4 on one text."""
    return _COMMENTS[lang].sub(lambda m: m.group(1) or "", text)


def without_c_comments(text: str) -> str:
    """PRJ5 on one text."""
    spaced = _C.sub(lambda m: " " if m.group(1) else m.group(2), text)
    return "\n".join(line for line in spaced.split("\n") if line.strip(PY_SPACE))


MUTATORS: dict[str, list[Callable[[str], str]]] = {
    "java": [lambda t: without_comments(t, "java"), without_c_comments, lambda t: lexer.rename(t, "java"), lambda t: javascan.drop_dead(t)[0]],
    "python": [lambda t: without_comments(t, "python"), lambda t: lexer.rename(t, "python"), lexer.drop_unreachable, lexer.drop_unused_assignments,
               lexer.drop_unused_functions],
}


def passes_gate(text: str) -> bool:
    """FLT1 on a text without comments."""
    return bool(text.strip(" \t\n\r\x0b\x0c")) and all(text.count(a) == text.count(b) for a, b in ("()", "{}", "[]"))


def mutate_text(text: str | None, lang: str | None, n: int) -> tuple[str | None, bool]:
    """(text after ``n`` mutations, did one fail).  A null text, and a language without mutators, stay as they are.

    After a whole turn without a change every further mutation gives what it gave, so the loop ends.
    """
    failed, still, turns = False, 0, MUTATORS.get(lang or "", [])
    for i in range(n if text is not None and turns else 0):
        tried = turns[i % len(turns)](text)
        if passes_gate(tried):
            still = still + 1 if tried == text else 0
            text = tried
        else:
            failed, still = True, still + 1
        if still == len(turns):
            break
    return text, failed


def augmented(progs: DataFrame, n_mut: Column, keep_on_failure: bool = True) -> DataFrame:
    """WIN6: ``progs`` (lang, src, ...) with out and failed.  Failed Python programs are dropped with ``keep_on_failure`` off."""
    def rule(texts: pd.Series, langs: pd.Series, counts: pd.Series) -> pd.DataFrame:
        done = [mutate_text(t, lang, 0 if pd.isna(n) else int(n)) for t, lang, n in zip(texts, langs, counts, strict=True)]
        return pd.DataFrame({"out": pd.Series([d[0] for d in done], dtype=object), "failed": pd.Series([d[1] for d in done], dtype=bool)})

    mutated = F.pandas_udf(rule, "out string, failed boolean")
    done = progs.withColumn("_m", mutated("src", "lang", n_mut.cast("int"))).select(*progs.columns, "_m.out", "_m.failed")
    return done if keep_on_failure else done.filter(~((F.col("lang") == "python") & F.col("failed")))


def write_augmented(progs: DataFrame, n_mut: Column, path: str, keep_on_failure: bool = True) -> dict[str, int]:
    """Run the job once, write its rows as Parquet, and return the ledger of that run (AGG22): programs and failures, in all and by language."""
    ledger = Observation("ledger")
    total, failed = F.count(F.lit(1)), F.count_if(F.col("failed"))
    by_lang = [m for lang in MUTATORS for m in (F.count_if(F.col("lang") == lang).alias(f"{lang}_total"),
                                                F.count_if((F.col("lang") == lang) & F.col("failed")).alias(f"{lang}_failed"))]
    done = augmented(progs, n_mut).observe(ledger, total.alias("total"), failed.alias("failed"), *by_lang)
    if not keep_on_failure:
        done = done.filter(~((F.col("lang") == "python") & F.col("failed")))
    done.write.mode("overwrite").parquet(path)
    return ledger.get
