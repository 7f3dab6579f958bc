"""Data flow of one Java program with its control flow: which definitions reach each use (JOIN10, JOIN12, JOIN13).

The program's statements become a control-flow graph (branches join, loops go
back, jumps leave), its variable tokens definitions and uses.  Reaching
definitions are the least fixed point over that graph, with sets of definitions
as bits of integers.  ``graph.flow_edges_of_programs`` applies it in Arrow batches
where the rows are.

Edges, by positions among the program's tokens without blanks and comments:
``comesFrom`` from a use, or a declaration's name, to what it takes its value
from (all definitions that reach a use; the variables of a declaration's initial
value); ``computedFrom`` from an assigned or incremented variable, or a for-each
variable, to the variables of the expression.  Variables are names that are
declared or assigned somewhere in the program; fields after a dot, methods and
types are none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from complexa.functions.javascan import matches, statement_end, structure
from complexa.functions.lexer import JavaCode

#: Java's reserved words, and names of basic types (fixed values of the language).
_RESERVED = frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof "
    "interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try "
    "volatile while true false null".split())
_BASIC = frozenset("boolean byte char double float int long short void var".split())
_AFTER_NAME = frozenset("=;:,)[")
_ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="])
_STEPS = frozenset(["++", "--"])
_MARKED, _NO_VARIABLE = _AFTER_NAME | _ASSIGN | _STEPS, _RESERVED | _BASIC
_VALUE_ENDS, _OPEN, _STOPS = frozenset([",", ")", "]", "}", ";"]), frozenset("([{"), frozenset(";{}")
#: Words that begin a statement of their own kind.
_DECLARES = frozenset([":", "", ";", ",", ")"])
_STATEMENTS = frozenset("if while for do switch try break continue return throw else finally synchronized catch {".split())


class Step:
    """A simple statement or condition: what it reads and defines, in order, and where control goes next."""

    __slots__ = ("defines", "done", "edges", "next", "uses")

    def __init__(self) -> None:
        # most steps hold few of these: a step without variables shares the empty ones
        self.uses: Sequence[int] = ()
        self.defines: Sequence[int] = ()
        self.edges: Sequence[tuple[int, str, list[int]]] = ()  # (defined token, kind, source tokens)
        self.next: list[int] = []
        self.done: dict[int, int] | None = None  # token -> token from which its new value holds inside the step

    def local(self, use: int, words: list[str]) -> int | None:
        """The definition of the same variable that the step has made before ``use``."""
        return max((d for d in self.defines if self.done[d] <= use and words[d] == words[use]), default=None)


class Flow:
    """The control-flow graph of a program."""

    def __init__(self, text: str):
        code = JavaCode(text)
        self.words, self.kinds = code.words, code.kinds()
        self.match = matches(self.words, structure(self.words))
        self.steps: list[Step] = []
        self.variables = self._variables()
        after = [*self.words[1:], ""]
        #: positions of all variable tokens
        self.names = [k for k, s in enumerate(self.words) if s in self.variables and self.words[k - 1] != "." and after[k] != "("]
        # open ends wait for the step that comes next: (step) of plain flow; per loop or switch: of break and continue
        self.breaks: list[list[int]] = []
        self.continues: list[list[int]] = []
        at, ends = 0, [self._step([])]
        while at < len(self.words):
            at, ends = self._region(at, len(self.words), ends)
            at += 1  # a bracket without a partner

    def _variables(self) -> set[str]:
        found, code, kinds, n = set(), [*self.words, "", ""], self.kinds, len(self.words)
        self.declares: set[int] = set()
        names = [i for i, (kind, before, after) in enumerate(zip(kinds, ["", *code], code[1:], strict=False))
                 if kind == "name" and (after in _MARKED or before in _STEPS)]
        for i in names:
            s, before, after = code[i], code[i - 1] if i else "", code[i + 1]
            if before == "." or s in _NO_VARIABLE:
                continue
            if i not in self.declares and after in _AFTER_NAME and self._typed(i):
                self.declares.add(i)
                end = self._until(i + 1, n)  # int a = 1, b, c = 2;
                while code[end] == "," and end + 1 < n and kinds[end + 1] == "name" and code[end + 2] in (",", ";", "="):
                    self.declares.add(end + 1)
                    end = self._until(end + 2, n)
            if i in self.declares or after in _ASSIGN or after in _STEPS or before in _STEPS:
                found.add(s)
        return found

    def _typed(self, i: int) -> bool:
        """A type stands before the name, and no parenthesis after it."""
        if i == 0 or i + 1 >= len(self.words) or self.words[i + 1] not in ("=", ";", ":", ",", ")", "["):
            return False
        kind, s = self.kinds[i - 1], self.words[i - 1]
        return s == "]" or s == ">" or s in _BASIC or (kind == "name" and s not in _RESERVED)

    def _declared(self, i: int) -> bool:
        return i in self.declares

    # ------------------------------------------------------------------ graph
    def _step(self, before: list[int]) -> int:
        self.steps.append(Step())
        for b in before:
            self.steps[b].next.append(len(self.steps) - 1)
        return len(self.steps) - 1

    def _expression(self, a: int, b: int, before: list[int]) -> list[int]:
        """A step for the tokens from ``a`` up to ``b``; its open end."""
        n = self._step(before)
        names = self.names
        lo = bisect_left(names, a)
        if lo == len(names) or names[lo] >= b:
            return [n]
        step, words = self.steps[n], self.words
        names = names[lo:bisect_left(names, b, lo)]
        uses, defines, edges, done = step.uses, step.defines, step.edges, step.done = [], [], [], {}
        for i in names:
            after = words[i + 1] if i + 1 < b else ""
            if after in _ASSIGN:
                end = done[i] = self._until(i + 1, b)
                declared = after == "=" and i in self.declares
                sources = [k for k in names if i < k < end]
                defines.append(i)
                if after != "=":
                    sources.append(i)
                    uses.append(i)
                edges.append((i, "comesFrom" if declared else "computedFrom", sources))
                continue
            done[i] = i + 1
            if i in self.declares and after in _DECLARES:
                if after != ":":
                    if after in _STEPS or (i > a and words[i - 1] in _STEPS):
                        uses.append(i)
                        edges.append((i, "computedFrom", [i]))
                    else:
                        edges.append((i, "comesFrom", []))
                    defines.append(i)
                    continue
                if words[a - 1] == "(":
                    defines.append(i)
                    done[i] = b
                    edges.append((i, "computedFrom", [k for k in names if k > i]))
                    continue
            if after in _STEPS or (i > a and words[i - 1] in _STEPS):
                uses.append(i)
                defines.append(i)
                edges.append((i, "computedFrom", [i]))
            else:
                uses.append(i)
        return [n]

    def _until(self, i: int, b: int) -> int:
        """End of the value that begins at ``i``: a comma, or a bracket that closes around it."""
        words = self.words
        while i < b and words[i] not in _VALUE_ENDS:
            i = self.match[i] + 1 if words[i] in _OPEN else i + 1
        return min(i, b)

    def _region(self, at: int, end: int, ends: list[int]) -> tuple[int, list[int]]:
        while at < end and self.words[at] not in (")", "]", "}"):
            at, ends = self._statement(at, end, ends)
        return at, ends

    def _statement(self, at: int, end: int, ends: list[int]) -> tuple[int, list[int]]:
        """(token after the statement, open ends)."""
        s = self.words[at]
        if s not in _STATEMENTS:
            return self._plain(at, end, ends)
        head = at + 1 < end and self.words[at + 1] == "("
        close = self.match[at + 1] if head else at
        if s == "{":
            return self.match[at] + 1, self._region(at + 1, self.match[at], ends)[1]
        if s == "if" and head:
            cond = self._expression(at + 2, close, ends)
            at, then = self._statement(close + 1, end, cond) if close + 1 < end else (end, cond)
            if at < end and self.words[at] == "else" and at + 1 < end:
                at, other = self._statement(at + 1, end, cond)
                return at, then + other
            return at, then + cond
        if s == "while" and head:
            cond = self._expression(at + 2, close, ends)
            return self._loop(close + 1, end, cond, cond[0])
        if s == "for" and head:
            return self._for(at + 2, close, end, ends)
        if s == "do" and at + 1 < end:
            top = self._step(ends)
            self.breaks.append([])
            self.continues.append([])
            after, body = self._statement(at + 1, end, [top])
            body = body + self.continues.pop()
            if after + 1 < end and self.words[after] == "while" and self.words[after + 1] == "(":
                cond = self._expression(after + 2, self.match[after + 1], body)
                self.steps[cond[0]].next.append(top)
                return min(end, self.match[after + 1] + 2), cond + self.breaks.pop()
            return after, body + self.breaks.pop()
        if s == "switch" and head:
            return self._switch(close, end, self._expression(at + 2, close, ends))
        if s == "try":
            return self._try(at, end, ends)
        if s in ("break", "continue"):
            n = self._step(ends)
            holder = self.breaks if s == "break" else self.continues
            if holder:
                holder[-1].append(n)
            return statement_end(self.words, self.match, at), []
        if s in ("return", "throw"):
            after = statement_end(self.words, self.match, at)
            self._expression(at + 1, after, ends)
            return after, []
        if s in ("else", "finally", "synchronized") or (s == "catch" and head):
            at = close + 1 if head else at + 1
            return (at, ends) if at >= end else self._statement(at, end, ends)
        return self._plain(at, end, ends)

    def _plain(self, at: int, end: int, ends: list[int]) -> tuple[int, list[int]]:
        """An expression; or a class or method: its header declares parameters, its body is a region of its own."""
        words, match, stop = self.words, self.match, at
        while stop < end and words[stop] not in _STOPS:
            stop = match[stop] + 1 if words[stop] in ("(", "[") else stop + 1
        if stop < end and words[stop] == "{" and (stop == at or words[stop - 1] not in ("=", "]", ")", "->", ",") or self._is_header(at, stop)):
            entry = self._expression(at, stop, ends)
            inner = self._region(stop + 1, match[stop], entry)[1]
            # what a body leaves defined goes on: fields of a class reach its methods
            return match[stop] + 1, entry + inner
        plain = stop < end and words[stop] == ";" and words[at] not in _STATEMENTS
        after = stop + 1 if plain else statement_end(words, match, at)
        return max(after, at + 1), self._expression(at, after, ends)

    def _is_header(self, at: int, stop: int) -> bool:
        """``type name ( ... ) {`` rather than an expression with a body."""
        i = stop - 1
        while i > at and self.words[i] != ")":
            i -= 1
        begin = next((k for k in range(at, i) if self.words[k] == "(" and self.match[k] == i), at)
        return begin - at >= 2 and self.kinds[begin - 1] == "name" and (
            self.words[begin - 2] in (">", "]") or self.kinds[begin - 2] == "name" and self.words[begin - 2] not in _RESERVED - {"public", "private", "protected", "static"})

    def _loop(self, body: int, end: int, entry: list[int], back: int, tail: tuple[int, int] | None = None) -> tuple[int, list[int]]:
        """A loop's body after its condition; ``tail``: tokens run before control goes back."""
        self.breaks.append([])
        self.continues.append([])
        after, ends = self._statement(body, end, entry) if body < end else (end, entry)
        ends = ends + self.continues.pop()
        if tail:
            ends = self._expression(*tail, ends)
        for e in ends:
            self.steps[e].next.append(back)
        return after, entry + self.breaks.pop()

    def _for(self, a: int, close: int, end: int, ends: list[int]) -> tuple[int, list[int]]:
        cuts, i = [], a
        while i < close:
            if self.words[i] == ";":
                cuts.append(i)
            i = self.match[i] + 1 if self.words[i] in ("(", "[", "{") else i + 1
        if len(cuts) < 2:  # for (type name : values)
            head = self._expression(a, close, ends)
            return self._loop(close + 1, end, head, head[0])
        cond = self._expression(cuts[0] + 1, cuts[1], self._expression(a, cuts[0], ends))
        return self._loop(close + 1, end, cond, cond[0], (cuts[1] + 1, close))

    def _switch(self, close: int, end: int, cond: list[int]) -> tuple[int, list[int]]:
        """Every case may be entered from the condition, and from the case before it."""
        if close + 1 >= end or self.words[close + 1] != "{":
            return close + 1, cond
        stop, at, ends, default = self.match[close + 1], close + 2, [], False
        self.breaks.append([])
        while at < stop:
            if self.words[at] in ("case", "default"):
                default |= self.words[at] == "default"
                while at < stop and self.words[at] not in (":", "->"):
                    at += 1
                ends, at = ends + cond, at + 1
            elif self.words[at] in (")", "]", "}"):
                at += 1
            else:
                at, ends = self._statement(at, stop, ends)
        return stop + 1, ends + self.breaks.pop() + ([] if default else cond)

    def _try(self, at: int, end: int, ends: list[int]) -> tuple[int, list[int]]:
        """Any step of the body may end in a handler."""
        at += 1
        if at < end and self.words[at] == "(":
            ends, at = self._expression(at + 1, self.match[at], ends), self.match[at] + 1
        first = len(self.steps)
        at, body = self._statement(at, end, ends) if at < end else (at, ends)
        thrown, out = [*ends, *range(first, len(self.steps))], list(body)
        while at + 1 < end and self.words[at] in ("catch", "finally"):
            last = self.words[at] == "finally"
            if not last and self.words[at + 1] == "(":
                entry, at = self._expression(at + 2, self.match[at + 1], thrown), self.match[at + 1]
            else:
                entry = out + thrown if last else thrown
            if at + 1 >= end:
                break
            at, done = self._statement(at + 1, end, entry)
            out = done if last else out + done
        return at, out

    # ------------------------------------------------------------------ fixed point
    def reaching(self) -> list[int]:
        """For each step the definitions (bits: positions in ``definitions``) that reach its beginning."""
        self.definitions = [d for step in self.steps for d in step.defines]
        number = {d: i for i, d in enumerate(self.definitions)}
        of_name: dict[str, int] = {}
        for d, i in number.items():
            of_name[self.words[d]] = of_name.get(self.words[d], 0) | 1 << i
        self.of_name = of_name
        keeps, makes = [-1] * len(self.steps), [0] * len(self.steps)
        for n, step in enumerate(self.steps):
            if step.defines:
                kill = made = 0
                for d in step.defines:
                    mine = of_name[self.words[d]]
                    made = made & ~mine | 1 << number[d]
                    kill |= mine
                keeps[n], makes[n] = ~kill, made
        into, seen, waits = [0] * len(self.steps), [False] * len(self.steps), [False] * len(self.steps)
        seen[0] = waits[0] = again = True  # what no path reaches defines nothing
        while again:  # in program order, once more where a loop went back
            again = False
            for n, step in enumerate(self.steps):
                if not waits[n]:
                    continue
                waits[n] = False
                out = into[n] & keeps[n] | makes[n]
                for nxt in step.next:
                    if not seen[nxt] or out & ~into[nxt]:
                        into[nxt] |= out
                        seen[nxt] = waits[nxt] = True
                        again |= nxt <= n
        return into


def flow_rows(text: str) -> list[tuple[str, int, str, list[int]]]:
    """(name, idx, kind, parents): one row per (token, kind), its parents sorted and merged; uses that nothing defines have none."""
    flow = Flow(text)
    into, words, definitions, of_name = flow.reaching(), flow.words, flow.definitions, flow.of_name
    found: dict[int, list[int]] = {}  # twice the token, and one for computedFrom
    for step, before in zip(flow.steps, into, strict=True):
        for use in step.uses:
            own = step.local(use, words) if step.defines else None
            parents = []
            if own is not None:
                parents.append(own)
            else:
                bits = before & of_name.get(words[use], 0)
                while bits:
                    low = bits & -bits
                    parents.append(definitions[low.bit_length() - 1])
                    bits ^= low
            found[2 * use] = found[2 * use] + parents if 2 * use in found else parents
        for defined, kind, sources in step.edges:
            key = 2 * defined + (kind == "computedFrom")
            found[key] = found[key] + sources if key in found else sources
    return [(words[key >> 1], key >> 1, _KINDS[key & 1], sorted(set(parents)) if len(parents) > 1 else parents) for key, parents in sorted(found.items())]


_KINDS = ("comesFrom", "computedFrom")


def flow_edges(text: str) -> list[dict]:
    """``flow_rows`` by name."""
    return [dict(zip(("name", "idx", "kind", "parents"), row, strict=True)) for row in flow_rows(text)]
