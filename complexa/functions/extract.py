"""Answer extraction from free-text model responses (PRJ9-PRJ12).

Pure column expressions: ``substring_index`` for the assistant segment,
``split`` + ``get`` for the text between the first and second split point,
and ``CASE`` chains over literal ``contains`` tests for the class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from complexa.functions.labels import R_ORDER

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference (do not edit).
# Turn markers, chosen by the first model-id test that matches (case-sensitive).
MARKERS = [("gemma", "<end_of_turn>"), ("Llama", "<|eot_id|>"),
           ("Mistral", "[/INST]"), ("Qwen", "<|im_end|>")]
# Split points: 'overall time' if present, else 'complexity'
SPLIT_PRIMARY = "overall time"
SPLIT_FALLBACK = "complexity"
# Class words, first contained wins
CLASS_WORDS = ["exponential", "cubic", "quadratic", "nlogn", "linear", "logn", "constant"]
# Symbol keys, first contained wins, with the class each one names
CLASS_SYMBOLS = [("np", "exponential"), ("2^n", "exponential"), ("n^3", "cubic"), ("n^2", "quadratic"),
                 ("n log n", "nlogn"), ("o(n)", "linear"), ("log n", "logn"), ("o(1)", "constant")]
ERROR = "ERROR"
NO_RESPONSE = "NO RESPONCE"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def assistant_segment(response, model_id) -> Column:
    """PRJ10: lower-cased text after the last turn marker of the model family.

    A model id of no known family gives null (the reference raises); the
    marker is matched literally.  When the marker is absent the whole
    response is the segment, as Python's ``split(m)[-1]`` gives.
    """
    r, m = _c(response), _c(model_id)
    out = None
    for family, marker in MARKERS:
        seg = F.lower(F.substring_index(r, marker, -1))
        out = F.when(m.contains(family), seg) if out is None else out.when(m.contains(family), seg)
    return out


def _first_contained(seg: Column, pairs, word_boundary: bool = False) -> Column:
    out = None
    for key, name in pairs:
        if word_boundary:
            import re
            hit = seg.rlike(r"(^|[^a-z0-9])" + re.escape(key) + r"($|[^a-z0-9])")
        else:
            hit = seg.contains(key)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(ERROR))


def _rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in R_ORDER]), name)


def complexity_segment(segment) -> Column:
    """Text between the first and second split point; null when there is no split point."""
    a = _c(segment)
    return F.when(a.contains(SPLIT_PRIMARY), F.get(F.split(a, SPLIT_PRIMARY), 1)) \
            .otherwise(F.get(F.split(a, SPLIT_FALLBACK), 1))


def extract_complexity(segment, word_boundary: bool = False) -> Column:
    """PRJ11: class name, 'ERROR' or 'NO RESPONCE' from a lower-cased assistant segment.

    The word list and the symbol list each give a candidate; if both give
    one, the higher complexity class wins (that is what the reference's
    index comparison amounts to, ties included).  ``word_boundary=True`` only
    accepts keys that are not glued to letters or digits, so 'np' inside
    'input' no longer reads as exponential (parity mode is the default).
    """
    return F.get(F.transform(F.array(complexity_segment(segment)), lambda seg: _class_of(seg, word_boundary)), F.lit(0))


def _class_of(seg: Column, word_boundary: bool) -> Column:
    text = _first_contained(seg, [(w, w) for w in CLASS_WORDS], word_boundary)
    sym = _first_contained(seg, CLASS_SYMBOLS, word_boundary)
    return (F.when(seg.isNull(), F.lit(NO_RESPONSE))
            .when((text == ERROR) & (sym == ERROR), F.lit(ERROR))
            .when(text == ERROR, sym)
            .when(sym == ERROR, text)
            .when(_rank(text) >= _rank(sym), text)
            .otherwise(sym))


def expected_answer(content) -> Column:
    """PRJ9: the text between the first and second ':' of the answer message, stripped."""
    from complexa.functions.text import py_strip
    return py_strip(F.get(F.split(_c(content), ":"), 1))


def model_name(model_id) -> Column:
    """PRJ12: last '/' part of a model id."""
    return F.substring_index(_c(model_id), "/", -1)


def report_title(model_id, tuned, dataset: str = "corpus") -> Column:
    """PRJ12: '<id>[-pretrained] with <dataset>' (the report's first line)."""
    return F.concat(_c(model_id), F.when(_c(tuned) == 1, F.lit("-pretrained")).otherwise(F.lit("")),
                    F.lit(f" with {dataset}"))
