"""Reaching definitions against running all paths of small programs, statement by statement."""
import random

import pytest

from complexa.functions.dataflow import flow_edges
from complexa.operators import graph as G

VARS = ["a", "b", "c"]


def block(rng, depth):
    """Random statements as nested tuples."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice(["set", "set", "add", "inc", "use", "if", "ifelse", "while", "for", "each", "do", "break", "continue", "switch"])
        if depth == 0 and kind in ("if", "ifelse", "while", "for", "each", "do", "switch"):
            kind = "use"
        v, w = rng.choice(VARS), rng.choice(VARS)
        inner = [block(rng, depth - 1) for _ in range(3)] if depth else []
        out.append((kind, v, w, inner, rng.random() < 0.3))
    return out


class Program:
    """Text of a program, and the definitions that reach its uses, found by carrying all variable states along all paths."""

    def __init__(self, body):
        self.tokens, self.reach, self.inside = [], {}, []
        start = {tuple(None for _ in VARS)}
        self.emit("void f ( ) {")
        for v in VARS:
            self.emit("int")
            start = self.define(v, start)
            self.emit(";")
        # positions are fixed by a first pass over the text; states run over it until nothing new is seen
        self.run(body, start, 0)
        self.emit("}")

    def emit(self, text):
        self.tokens += text.split()

    def define(self, v, states):
        at = len(self.tokens)
        self.tokens.append(v)
        self.reach.setdefault((at, "def"), set())
        return self.set(v, at, states)

    @staticmethod
    def set(v, at, states):
        k = VARS.index(v)
        return {s[:k] + (at,) + s[k + 1:] for s in states}

    def use(self, v, states):
        at = len(self.tokens)
        self.tokens.append(v)
        self.seen(v, at, states)
        return at

    def seen(self, v, at, states):
        self.reach.setdefault((at, "use"), set()).update(s[VARS.index(v)] for s in states)

    def again(self, step, states):
        """Run ``step`` (states -> states that come back) from the same token until no state is new."""
        begin, known = len(self.tokens), set()
        while True:
            del self.tokens[begin:]
            known |= states
            states = step(known)
            if states <= known:
                return

    def run(self, body, states, loops):
        for kind, v, w, inner, braces in body:
            if kind == "set":
                at = len(self.tokens)
                self.tokens.append(v)
                self.emit("=")
                self.use(w, states)
                self.emit(";")
                states = self.set(v, at, states)
            elif kind in ("add", "inc"):
                at = self.use(v, states)
                if kind == "add":
                    self.emit("+=")
                    self.use(w, states)
                else:
                    self.emit("++")
                self.emit(";")
                states = self.set(v, at, states)
            elif kind == "use" or kind in ("break", "continue") and not loops:
                self.emit("g (")
                self.use(v, states)
                self.emit(") ;")
            elif kind in ("break", "continue"):
                self.emit(kind + " ;")
                self.inside[-1][kind] |= states
                states = set()
            elif kind in ("if", "ifelse"):
                self.emit("if (")
                self.use(v, states)
                self.emit(") {")
                then = self.run(inner[0], states, loops)
                self.emit("}")
                if kind == "ifelse":
                    self.emit("else {")
                    states = then | self.run(inner[1], states, loops)
                    self.emit("}")
                else:
                    states = then | states
            elif kind == "switch":
                self.inside.append({"break": set(), "continue": set()})
                self.emit("switch (")
                self.use(v, states)
                self.emit(") { case 1 :")
                on = self.run(inner[0], states, loops + 1)
                self.emit("default :" if braces else "case 2 :")
                on = self.run(inner[1], states | on, loops + 1)
                self.emit("}")
                out = self.inside.pop()
                if self.inside:
                    self.inside[-1]["continue"] |= out["continue"]
                states = on | out["break"] | (set() if braces else states)
            else:
                states = self.loop(kind, v, w, inner, states, loops)
        return states

    def loop(self, kind, v, w, inner, states, loops):
        left = set()
        if kind == "for":
            self.emit("for (")
            at = len(self.tokens)
            self.tokens.append(v)
            self.emit("= 0 ;")
            states = self.set(v, at, states)

        def once(states):
            nonlocal left
            self.inside.append({"break": set(), "continue": set()})
            if kind == "do":
                self.emit("do {")
                on = self.run(inner[0], states, loops + 1)
                self.emit("} while (")
                out = self.inside.pop()
                on |= out["continue"]
                self.use(v, on)
                self.emit(") ;")
                left = on | out["break"]
                return on
            if kind == "while":
                self.emit("while (")
                self.use(v, states)
                self.emit(") {")
                on = self.run(inner[0], states, loops + 1)
            elif kind == "each":
                self.emit("for ( int")
                at = len(self.tokens)
                self.tokens.append(v)
                self.emit(":")
                self.use(w, states)
                self.emit(") {")
                states = self.set(v, at, states)
                on = self.run(inner[0], states, loops + 1)
            else:
                self.use(v, states)
                self.emit("< 9 ;")
                tail = len(self.tokens)
                self.emit(f"{w} ++ ) " + "{")
                on = self.run(inner[0], states, loops + 1)
            self.emit("}")
            out = self.inside.pop()
            on |= out["continue"]
            left = states | out["break"]
            if kind == "for":
                self.seen(w, tail, on)
                on = self.set(w, tail, on)
            return on

        self.again(once, states)
        return left


@pytest.mark.parametrize("seed", range(400))
def test_uses_take_the_definitions_of_all_paths(seed):
    rng = random.Random(seed)
    program = Program(block(rng, 3))
    text = rng.choice([" ", "\n", " /* a = 1; */ "]).join(program.tokens)
    got = {e["idx"]: e["parents"] for e in flow_edges(text) if e["kind"] == "comesFrom"}
    for (at, kind), parents in program.reach.items():
        assert got[at] == sorted(parents), (at, program.tokens[at], text)


def rows(text):
    return [(e["name"], e["idx"], e["kind"], e["parents"]) for e in flow_edges(text)]


def test_branches_loops_and_increments():
    assert rows("int s = 0; for (int i = 0; i < n; i++) { if (i > 2) s += i; else s = n; } n = s;") == [
        ("s", 1, "comesFrom", []), ("i", 8, "comesFrom", []), ("i", 12, "comesFrom", [8, 16]), ("n", 14, "comesFrom", []),
        ("i", 16, "comesFrom", [8, 16]), ("i", 16, "computedFrom", [16]), ("i", 22, "comesFrom", [8, 16]), ("s", 26, "comesFrom", [1, 26, 31]),
        ("s", 26, "computedFrom", [26, 28]), ("i", 28, "comesFrom", [8, 16]), ("s", 31, "computedFrom", [33]), ("n", 33, "comesFrom", []),
        ("n", 36, "computedFrom", [38]), ("s", 38, "comesFrom", [1, 26, 31])]
    assert rows("int a = 1, b = a; b = b + this.a;") == [("a", 1, "comesFrom", []), ("b", 5, "comesFrom", [7]), ("a", 7, "comesFrom", [1]),
                                                      ("b", 9, "computedFrom", [11]), ("b", 11, "comesFrom", [5])]
    assert rows("long a, b, c = f(a, b); for (int i = 0, j = c; ; ) { }") == [
        ("a", 1, "comesFrom", []), ("b", 3, "comesFrom", []), ("c", 5, "comesFrom", [9, 11]), ("a", 9, "comesFrom", [1]), ("b", 11, "comesFrom", [3]),
        ("i", 17, "comesFrom", []), ("j", 21, "comesFrom", [23]), ("c", 23, "comesFrom", [5])]


@pytest.mark.parametrize("text", ["", "}", "for (", "if (a", "while", "x = ;;", "do", "switch (x) {", "try { x = 1;", "else else", "int x = \"", "a b c d = {{{", "case default : x++"])
def test_broken_programs_do_not_fail(text):
    assert isinstance(flow_edges(text), list)


def test_handlers_see_every_step_of_the_body():
    got = {(e["idx"], e["kind"]): e["parents"] for e in flow_edges("int x = 0; try { x = 1; x = 2; } catch (E e) { g(x); } finally { h(x); }")}
    assert got[24, "comesFrom"] == [1, 7, 11] and got[32, "comesFrom"] == [1, 7, 11]


def test_programs_need_no_shuffle(spark):
    df = spark.createDataFrame([(1, "int x = 1; x++;"), (2, None), (3, "")], "doc_id int, src string")
    edges = G.flow_edges_of_programs(df)
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.name, r.idx, r.kind, r.parents) for r in edges.collect()) == [
        (1, "x", 1, "comesFrom", []), (1, "x", 5, "comesFrom", [1]), (1, "x", 5, "computedFrom", [5])]
