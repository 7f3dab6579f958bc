"""Secret scan: rule-based finds plus format likelihood under learned automata.

1. Every whole text is scanned once for the base rules and for candidate
   tokens (long runs of credential characters); finds and candidates, not
   texts, are written.
2. Grammar inference.  A bounded, documented sample of labelled credentials
   (by default the base finds of the corpus, ``SAMPLE`` distinct values a kind
   with the smallest hashes; or a table given by the caller) becomes one prefix
   tree per kind.  States are merged red-blue, as long as their ending and
   symbol frequencies agree by the Hoeffding bound at ``ALPHA``, recursively
   after folding, into a probabilistic automaton.  A background automaton is
   learned in the same way from candidates outside base spans.
3. All candidates are scored: log likelihood per symbol under the kind's
   automaton, and its ratio to the background.  A candidate that no base span
   covers is added (kind ``grammar``) if some kind explains it better than the
   background does and at least as well as all but ``STRICT`` of the labelled
   credentials that were held out of learning.

Defined cases: null text counts as empty; no labelled credentials: no spans
are added; repeated rows give equal rows; a null doc_id stays null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import text_array, work_table

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ with 16+ characters
KINDS = ("assign", "access", "hex", "grammar")
MIN_ASSIGN, MIN_ACCESS = 12, 18
_ASSIGN_HINTS = ("passw", "secret", "token", "api_key", "apikey")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")  # from the shortest labelled length, MIN_ASSIGN
#: Labelled credentials per kind, and background tokens, that a model is learned from at most.
SAMPLE, BACKGROUND_SAMPLE = 2000, 4000
ALPHA, STRICT, HELD_OUT = 0.05, 0.02, 5
_SYMBOLS = 67.0  # 66 credential characters and the end

_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base rules, per kind leftmost and non-overlapping, failing matches dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    for batch in batches:
        col = text_array(batch)
        for a in range(0, len(col), 2000):
            base, cands = [], []
            for s in col.slice(a, 2000):
                text = s.as_py()
                found = base_spans(text)
                taken = sorted((x[1], x[2]) for x in found)
                starts, reach = [b for b, _ in taken], [0, *accumulate((e for _, e in taken), max)]
                # covered: a base span begins no later and ends no earlier
                free = [("grammar", m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text)
                        if reach[bisect_right(starts, m.start())] < m.end()]
                keys = ("kind", "start", "end", "value")
                base.append([dict(zip(keys, x, strict=True)) for x in found])
                cands.append([dict(zip(keys, x, strict=True)) for x in free])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, 2000), pa.array(base, span), pa.array(cands, span)],
                                             names=["doc_id", "base", "candidates"])


# ------------------------------------------------------------ grammar inference
class Automaton:
    """Probabilistic automaton: per state the passes, the ends, and (count, next state) per symbol.

    In a prefix tree a state that one word passes holds the rest of that word (``rest``) in place of a chain of states.
    """

    def __init__(self):
        self.seen, self.ends, self.out, self.rest = [0], [0], [{}], {}

    def leaf(self, rest: str) -> int:
        """A new state that one word passes."""
        q = len(self.seen)
        self.seen.append(1)
        self.ends.append(0)
        self.out.append({})
        self.rest[q] = rest
        return q

    def open(self, q: int) -> None:
        """Turn the first symbol of the rest that ``q`` holds into an edge."""
        rest = self.rest.pop(q, None)
        if rest:
            self.out[q][rest[0]] = [1, self.leaf(rest[1:])]
        elif rest is not None:
            self.ends[q] += 1

    def add(self, word: str, q: int = 0) -> None:
        """Insert a word at ``q``."""
        for i, c in enumerate(word):
            self.open(q)
            self.seen[q] += 1
            edge = self.out[q].get(c)
            if edge is None:
                self.out[q][c] = [1, self.leaf(word[i + 1:])]
                return
            edge[0] += 1
            q = edge[1]
        self.open(q)
        self.seen[q] += 1
        self.ends[q] += 1

    def score(self, word: str) -> float:
        """Log likelihood per symbol (the end is one); smoothed by half a count, unknown symbols lead back to the start."""
        q, total = 0, 0.0
        for c in word:
            edge = self.out[q].get(c)
            total += math.log(((edge[0] if edge else 0) + 0.5) / (self.seen[q] + 0.5 * _SYMBOLS))
            q = edge[1] if edge else 0
        total += math.log((self.ends[q] + 0.5) / (self.seen[q] + 0.5 * _SYMBOLS))
        return total / (len(word) + 1)


def _agree(n1: int, f1: int, n2: int, f2: int, bound: float) -> bool:
    return not n1 or not n2 or abs(f1 / n1 - f2 / n2) < bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: Automaton, red: int, blue: int, bound: float) -> bool:
    """All pairs of states are tested, but those that cannot fail: below ``bound**2`` passes, of the blue state or of
    any below it, no difference of frequencies (at most 1) reaches the bound."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        if a.seen[q] < bound * bound:
            continue
        a.open(p)
        a.open(q)
        if not _agree(a.seen[p], a.ends[p], a.seen[q], a.ends[q], bound):
            return False
        for c in a.out[p].keys() | a.out[q].keys():
            x, y = a.out[p].get(c), a.out[q].get(c)
            if not _agree(a.seen[p], x[0] if x else 0, a.seen[q], y[0] if y else 0, bound):
                return False
            if x and y and x[1] != y[1]:
                todo.append((x[1], y[1]))
    return True


def _fold(a: Automaton, red: int, blue: int) -> None:
    """Add the tree below ``blue`` to ``red``."""
    todo = [(red, blue)]
    while todo:
        p, q = todo.pop()
        if q in a.rest:
            a.add(a.rest.pop(q), p)
            continue
        a.open(p)
        a.seen[p] += a.seen[q]
        a.ends[p] += a.ends[q]
        for c, (n, to) in a.out[q].items():
            edge = a.out[p].get(c)
            if edge is None:
                a.out[p][c] = [n, to]
            else:
                edge[0] += n
                todo.append((edge[1], to))
        a.out[q] = {}


def learn(words: list[str], alpha: float = ALPHA) -> Automaton:
    """State merging on the prefix tree of ``words`` (red-blue order, the earliest compatible red state is taken)."""
    a = Automaton()
    for w in words:
        a.add(w)
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    red, blue, done = [0], [(0, c) for c in sorted(a.out[0])], {0}
    while blue:
        p, c = blue.pop(0)
        q = a.out[p][c][1]
        if q in done:
            continue
        into = next((r for r in red if _compatible(a, r, q, bound)), None)
        if into is None:
            red.append(q)
            done.add(q)
            a.open(q)
            blue += [(q, x) for x in sorted(a.out[q])]
        else:
            a.out[p][c][1] = into
            _fold(a, into, q)
            blue = [(r, x) for r in red for x in sorted(a.out[r]) if a.out[r][x][1] not in done]
    keep = {q: i for i, q in enumerate(red)}
    small = Automaton()
    small.seen, small.ends = [a.seen[q] for q in red], [a.ends[q] for q in red]
    small.out = [{c: [n, keep[to]] for c, (n, to) in a.out[q].items()} for q in red]
    return small


def learn_formats(labelled: list[tuple[str, str]], background: list[str]) -> tuple[dict[str, tuple[Automaton, float]], Automaton]:
    """Per kind the automaton and the least score per symbol that is accepted, and the background automaton."""
    formats = {}
    for kind in sorted({k for k, _ in labelled}):
        words = sorted(w for k, w in labelled if k == kind)
        test = [w for w in words if zlib.crc32(w.encode()) % HELD_OUT == 0]
        train = [w for w in words if zlib.crc32(w.encode()) % HELD_OUT]
        if not train or not test:
            train = test = words
        model = learn(train)
        scores = sorted(model.score(w) for w in test)
        formats[kind] = (model, scores[int(STRICT * len(scores))])
    return formats, learn(sorted(background))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, spans (array of kind, start, end, value; by start, then kind) per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = work_table(rows.mapInArrow(_scan, f"doc_id long, base {_SPAN}, candidates {_SPAN}"), "secret-candidates")
    known = labelled if labelled is not None else found.select(F.explode("base").alias("s")).select("s.kind", "s.value")

    def sample(values: DataFrame, n: int) -> list[str]:
        return [r[0] for r in values.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(n).collect()]

    words = [(k, w) for k in KINDS[:3] for w in sample(known.filter(F.col("kind") == k), SAMPLE)]
    outside = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    other = sample(found.select(F.explode(outside).alias("s")).select("s.value"), BACKGROUND_SAMPLE)
    formats, background = learn_formats(words, other)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            out = []
            for base, cands in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                more = [c for c in cands if is_secret(c["value"], formats, background)]
                out.append(sorted(base + more, key=lambda s: (s["start"], rank[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, batch.schema.field("base").type)], names=["doc_id", "spans"])

    return found.mapInArrow(score, f"doc_id long, spans {_SPAN}")


def is_secret(value: str, formats: dict[str, tuple[Automaton, float]], background: Automaton) -> bool:
    plain = background.score(value)
    return any((s := model.score(value)) > plain and s >= least for model, least in formats.values())
