"""Counts of one program for Arrow batches (FEA5 by breadth-first level, FEA10 for Python).

Plain forms of the column rules in ``features`` and ``text``, with the same patterns written so that they read as
in Java's ``regex`` (see ``segments``).  A pattern begins with its fixed characters and looks back from there, so a search passes over the
rest quickly.
"""

from __future__ import annotations

import re
from collections import Counter

from complexa.functions.features import LOOP_TOKENS, PY_KEYWORDS
from complexa.functions.segments import _ENDS, _LITERAL, _S, _W, calls, segment, without_comments
from complexa.functions.text import LINE_BREAK, PY_SPACE, WS

# ------------------------------------------------------------------ Java
_LOOP_TOKENS = re.compile(LOOP_TOKENS).findall
#: (name, a word that must stand in the text, pattern)
_COUNTED = [(name, word, re.compile(p).findall) for name, word, p in [
    ("n_if", "if", rf"if(?<!\wif){_S}*\("), ("n_switch", "switch", rf"switch(?<!\wswitch){_S}*\("), ("for", "for", rf"for(?<!\wfor){_S}*\("),
    ("while", "while", rf"while(?<!\wwhile){_S}*\("), ("tail", "while", rf"\}}{_S}*while{_S}*\("), ("n_break", "break", rf"break(?<!\wbreak){_S}*;"),
    ("n_priority", "PriorityQueue", rf"new(?<!\wnew){_S}+PriorityQueue(?!\w)"), ("n_sort", ".sort", rf"\.sort{_S}*\("),
    ("n_hashset", "HashSet", rf"new(?<!\wnew){_S}+HashSet(?!\w)"), ("n_hashmap", "HashMap", rf"new(?<!\wnew){_S}+HashMap(?!\w)")]]
_STATEMENT = re.compile(r"(?:if(?<!\wif)|for(?<!\wfor)|while(?<!\wwhile)|switch(?<!\wswitch)|do(?<!\wdo)|try(?<!\wtry))(?!\w)").findall
_VARIABLE = re.compile(rf"(?<!\w)(?:int|long|double|float|boolean|char|byte|short|String|[A-Z]{_W}*(?:<[^<>;]*>)?)(?:\[\])*{_S}+[a-z_]{_W}*{_S}*[=;:]").findall


def loop_nesting(text: str) -> int:
    """Deepest nesting of for / while loops; see ``features.loop_nesting``."""
    depth = inside = deepest = 0
    state, after_do = "", False  # head, tail, body, do: what the next tokens belong to
    loops: list[int] = []
    dos: list[int] = []
    for t in _LOOP_TOKENS(text):
        if t == "{":
            if state == "body":
                loops.append(depth)
            elif state == "do":
                dos.append(depth)
            depth, state, after_do = depth + 1, "", False
            deepest = max(deepest, len(loops))
            continue
        body = state == "body"
        if body:  # a loop without a brace
            loops.append(-1 - depth)
            deepest = max(deepest, len(loops))
        was_do, after_do = after_do, False
        if t == "(":
            inside += 1
            state = "" if body else state
        elif t == ")":
            if inside == 1 and state in ("head", "tail"):
                state = "body" if state == "head" else ""
            elif body:
                state = ""
            inside -= 1
        elif t == ";":
            if not (state in ("head", "tail") and inside > 0):
                loops, state = [x for x in loops if x >= 0 or -1 - x < depth], ""
        elif t == "}":
            depth -= 1
            after_do = depth in dos
            loops, dos, state = [x for x in loops if (x if x >= 0 else -1 - x) < depth], [x for x in dos if x < depth], ""
        elif t == "do":
            state = "do"
        else:
            inside, state = 0, "tail" if t == "while" and was_do else "head"
    return deepest


LEVEL_COUNTS = ["n_if", "n_switch", "n_loop", "n_break", "n_priority", "n_sort", "n_hashset", "n_hashmap", "nested", "n_vars", "n_methods", "n_statements",
                "n_recursive"]


def java_counts(text: str) -> dict[str, int]:
    """The counts of ``features.java_counts`` (version 2) but for n_methods."""
    n = {name: len(find(text)) if word in text else 0 for name, word, find in _COUNTED}
    return n | {"n_loop": n["for"] + n["while"] - n["tail"], "nested": loop_nesting(text) if "for" in text or "while" in text else 0,
                "n_vars": len(_VARIABLE(text)), "n_statements": text.count(";") + len(_STATEMENT(text))}


def level_counts(text: str | None) -> tuple | None:
    """FEA5 by breadth-first level: ``LEVEL_COUNTS`` of a Java program, null without a ``main``; see ``fea05_java_counts_v2``."""
    if text is None:
        return None
    items = segment(without_comments(text, "java"), "java")
    declared = set(method for _, method, header in items if header)
    if "main" not in declared:
        return None
    sites: dict[str, Counter] = {}
    lines: dict[str, list[str]] = {}
    for line, method, header in items:
        if method is None:
            continue
        lines.setdefault(method, []).append(line)
        if not header and "(" in line:
            sites.setdefault(method, Counter()).update([c for c in calls(line) if c in declared])
    seen, front = {"main": 1}, {"main": 1}
    for _ in range(max(len(declared) - 1, 1)):
        level: dict[str, int] = {}
        for caller, w in front.items():
            for callee, n in sites.get(caller, {}).items():
                if callee not in seen:
                    level[callee] = level.get(callee, 0) + w * n
        if not level:
            break
        seen |= level
        front = level
    total, nested = dict.fromkeys(LEVEL_COUNTS, 0), 0
    for method, w in seen.items():
        own = java_counts("\n".join(lines[method]))
        nested = max(nested, own.pop("nested"))
        for name, n in own.items():
            if name in total:
                total[name] += w * n
    total |= {"nested": nested, "n_methods": sum(seen.values()), "n_recursive": sum(m in c for m, c in sites.items())}
    return tuple(total[name] for name in LEVEL_COUNTS)


# ------------------------------------------------------------------ Python
_BREAK = re.compile(LINE_BREAK)
_LEAD = re.compile(f"[{WS}]*").match
_COMMENT = re.compile(_LITERAL.pattern + r"|#[^\r\n]*")
_NAME = re.compile(rf"[A-Za-z_]{_W}*").findall
_START = f"(?<![^{_ENDS}])"
_ATTRIBUTE = re.compile(rf"self(?<!\wself)\.([A-Za-z_]{_W}*){_S}*[-+*/%]?=[^=]").findall
_ASSIGN = re.compile(rf"{_START}[ \t]*[A-Za-z_]{_W}*{_S}*[-+*/%]?=[^=]").findall
_INNER = re.compile(rf"{_START}[ \t]+def{_S}").findall
_OUTER = re.compile(rf"def(?<![^{_ENDS}]def){_S}").findall
_KEYWORDS = frozenset(PY_KEYWORDS)


def python_counts(text: str | None) -> list[float | None]:
    """The 13 features of ``features.python_vector``."""
    if text is None:
        return [None] * 13
    lines = _BREAK.split(text)
    n_lines = len(lines) - (not lines[-1])
    widths = [(_LEAD(line).end(), "def" in line or "for" in line or "while" in line) for line in lines if line.strip(PY_SPACE)]
    unit = next((w for w, _ in widths if w > 0), 4)
    stack: list[int] = []
    max_depth = max_stack = 0
    for w, opens in widths:
        level = w // unit
        while stack and stack[-1] >= level:
            stack.pop()
        if opens:
            stack.append(level)
        max_depth, max_stack = max(max_depth, level), max(max_stack, len(stack))
    code = _COMMENT.sub(" ", text)
    names = set(_NAME(code)) - _KEYWORDS
    found = [text.count("if"), text.count("while") + text.count("for"), text.count("break"), text.count("sort"), text.count("list") + text.count("split"),
             n_lines, len(names), len(set(_ATTRIBUTE(code))), max_depth, max_stack, len(_ASSIGN(text)), len(_INNER(text)), len(_OUTER(text))]
    return [float(n) for n in found]
