import random
import re
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from complexa.llm import ngram_join as N
from complexa.llm.common import Words, sequence_hashes
from complexa.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, t):
    sets = [shingles(x, n) for _, x in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and Fraction(inter, len(sets[i] | sets[j])) >= t:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        key = (d is None, d)
        least[r] = min(least.get(r, key), key, key=lambda k: (k[0], k[1] or 0))
    return sorted((repr(d), len(sets[i]), repr(least[find(i)][1])) for i, (d, _) in enumerate(rows))


def corpus(rng, bases, copies, length, edits):
    """Texts with near copies at every distance, shared passages, exact copies and short texts."""
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(25)]
    out = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(rng.randrange(*length))]
        if rng.random() < 0.5:
            at = rng.randrange(len(base) + 1)
            base[at:at] = passage
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                k = rng.randrange(len(w))
                if rng.random() < 0.5:
                    w[k] = rng.choice(words)
                else:
                    del w[k]
                if not w:
                    w = ["x"]
            out.append(" ".join(w).title() if rng.random() < 0.1 else "  ".join(w))
    return out


def check(documents, rows, n, num, den):
    got = N.ngram_groups(documents(rows), n, num, den).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute(rows, n, Fraction(num, den))


@pytest.mark.parametrize("seed, n, num, den", [(1, 4, 85, 100), (2, 5, 80, 100), (3, 2, 60, 100)])
def test_groups_match_brute_force(documents, seed, n, num, den):
    rng = random.Random(seed)
    texts = corpus(rng, 25, 6, (1, 40), 4) + corpus(rng, 12, 6, (60, 300), 14) + [None, "", " \n", "one", "one", "One two", "one two"]
    rows = list(enumerate(texts)) + [(None, texts[3]), (None, "alone at last with no friends"), (0, texts[0])]
    rng.shuffle(rows)
    check(documents, rows, n, num, den)


def test_large_clusters_are_cut_into_units(documents, monkeypatch):
    monkeypatch.setattr(N, "UNIT_SETS", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(70):  # one large group of near copies, many of them not linked directly
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w[: rng.randrange(95, 121)]))
    check(documents, list(enumerate(texts + corpus(rng, 5, 4, (30, 60), 3))), 4, 85, 100)


def test_chain_of_links(documents):
    words = [f"c{i}" for i in range(140)]
    check(documents, [(i, " ".join(words[3 * i:3 * i + 60])) for i in range(20)], 4, 80, 100)


def test_empty_table_and_dedup(documents):
    assert N.ngram_groups(documents([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(5, text), (3, text + " more"), (9, text), (9, text), (7, "other words that stand alone here"), (1, None), (2, "")])
    kept = N.ngram_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]


@pytest.mark.parametrize("num, den", [(85, 100), (80, 100), (60, 100)])
def test_linked_sets_share_signatures(num, den):
    """Every linked pair agrees on AGREE parts of one band, or on a prefix member if both are sparse."""
    rng = np.random.default_rng(num)

    class Fake:
        pass

    for size in [1, 2, 5, 6, 7, 9, 13, 20, 33, 60, 200, 700]:
        for _ in range(40):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            most = (den - num) * size // den
            drop, add = sorted(rng.integers(0, most + 1, 2)), rng.integers(0, 2**64, most + 1, dtype=np.uint64)
            y = np.concatenate([x[drop[0]:], add[:drop[1] - drop[0]]])
            x, y = np.unique(x), np.unique(y)
            shared = len(np.intersect1d(x, y))
            if den * shared < num * (len(x) + len(y) - shared):
                continue
            heavy = np.sort(rng.choice(x, rng.integers(0, len(x) + 1), replace=False))
            s = Fake()
            s.grams, s.owner = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
            s.size = np.array([len(x), len(y)])
            s.at = np.append(0, np.cumsum(s.size))
            row, sig, kind = N.signatures(s, num, den, heavy)
            of = [set(zip(sig[row == r].tolist(), kind[row == r].tolist())) for r in (0, 1)]
            both = of[0] & of[1]
            assert any(k == 2 for _, k in both) or max(sum(k == b for _, k in both) for b in (0, 1)) >= N.AGREE


def test_texts_are_not_shuffled(documents, spark, monkeypatch):
    """Only n-grams of candidates are exchanged, also when their list is too long to be broadcast."""
    plans, work_table = {}, N.work_table

    def seen(df, name):
        plans[name] = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return work_table(df, name)

    monkeypatch.setattr(N, "work_table", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = list(enumerate(corpus(random.Random(4), 12, 5, (20, 80), 3)))
        check(documents, rows, 4, 85, 100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for name in ("grams", "links"):
        exchanged = re.findall(r"\) Exchange.*\nInput \[\d+\]: \[(.*)\]", plans[name])
        assert exchanged and not any(re.search(r"\btext#", x) for x in exchanged)


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])
def test_row_filter_passes_every_row_of_it(spark, monkeypatch, most):
    monkeypatch.setattr(N, "FILTER_MOST", most)
    rids = np.random.default_rng(5).integers(-2**63, 2**63, 6000)
    edge = np.array([0, -1, 1, -2**63, 2**63 - 1, 2**32 - 1, 2**32])
    inside, others = np.concatenate([edge, rids[:3000]]), rids[3000:]
    got = N.row_filter(spark.createDataFrame([(int(x),) for x in inside], "rid long"), len(inside))
    assert len(got) * 8 <= most and N.passes(got, inside).all()
    assert N.passes(got, others).mean() < (0.03 if most > 1 << 15 else 0.1)


def test_full_row_filter_loses_nothing(documents, monkeypatch):
    monkeypatch.setattr(N, "passes", lambda row_filter, rids: np.ones(len(rids), bool))
    rng = random.Random(11)
    texts = corpus(rng, 15, 5, (5, 60), 4) + ["alone here"]
    check(documents, list(enumerate(texts + texts[:9])) + [(None, texts[0]), (3, texts[3])], 4, 85, 100)


def test_bitmap_bound_never_excludes_a_link():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pool = rng.integers(0, 2**64, 80, dtype=np.uint64)
        grams = [np.unique(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(12)]
        ids = np.arange(12)
        got = N.unit_links(ids, grams, np.zeros(12, int), ids.copy(), 60, 100)
        up = list(range(12))
        find = lambda x: x if up[x] == x else find(up[x])
        for i in range(12):
            for j in range(i):
                inter = len(np.intersect1d(grams[i], grams[j]))
                if 100 * inter >= 60 * (len(grams[i]) + len(grams[j]) - inter):
                    up[max(find(i), find(j))] = min(find(i), find(j))
        assert {(a, b) for a, b in got} == {(i, find(i)) for i in range(12) if find(i) != i}


@given(st.lists(st.text("aB \t\n\x0bé🙂\x1c", max_size=30), max_size=8), st.booleans())
@settings(max_examples=150, deadline=None)
def test_words_and_sequences(texts, lower):
    raw = [t.encode() for t in texts]
    rows = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    words = Words(np.frombuffer(b"".join(raw), np.uint8), rows, lower)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW) if lower else t) for t in texts]
    assert np.diff(words.rows).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    seen = {}
    for h, w in zip(words.hash.tolist(), flat):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    if len(flat) >= 3:
        runs = {}
        for i, h in enumerate(sequence_hashes(words.hash, 3).tolist()):
            assert runs.setdefault(tuple(flat[i:i + 3]), h) == h
        assert len(set(runs.values())) == len(runs)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3), (7, 7)], "a long, b long")).collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
