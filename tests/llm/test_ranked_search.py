"""Ranked search against scoring every document, and the bounds by themselves."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from complexa.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string, lang string, score long, rank int", "item_id long, text string, query long, doc_id long"


def docs_of(spark, data):
    return spark.createDataFrame([(i, t, "en", 0, 0) for i, t in data], DOCS)


def items_of(spark, data):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in data], ITEMS)


def terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in counts:
            m = 75 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, -2**63 if i is None else i, i))
        found.sort(key=lambda x: x[:2])
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def ranked(docs, items, **kw):
    return sorted((tuple(r) for r in R.rank_documents(docs, items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Été", "x_y", "a-b", "日本", "7"]
    data = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(n)]
    data += data[:40] + [(n + k, data[5][1]) for k in range(30)] + [(None, data[9][1]), (7777, None), (7778, ""), (7779, "-- !!")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25)))) for k in range(25)]
    return data, items + [(90, data[5][1]), (91, "w1 w1 w1 w2 w2 zzz"), (92, None), (93, ""), (None, "w1 w3"), (94, "unknown"), items[0], (0, "w2 w7")]


@pytest.mark.parametrize("seed, top", [(1, 20), (2, 3)])
def test_equals_scoring_every_document(spark, seed, top, monkeypatch):
    data, items = corpus(seed)
    want = brute(data, items, top)
    assert len(want) > 20 * top and ranked(docs_of(spark, data).repartition(5), items_of(spark, items), top=top) == want


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    data, items = corpus(3, 80)
    monkeypatch.setattr(R, "BLOCK_CHARS", 700)
    assert ranked(docs_of(spark, data), items_of(spark, items), top=5) == brute(data, items, 5)


def test_empty_tables(spark):
    data, items = corpus(4, 20)
    assert ranked(docs_of(spark, []), items_of(spark, items)) == [] and ranked(docs_of(spark, data), items_of(spark, [])) == []
    assert ranked(docs_of(spark, [(1, None)]), items_of(spark, items)) == []


def test_a_long_text(spark):
    data = [(1, "a b " * 400_000), (2, "a"), (3, "b c")]
    assert ranked(docs_of(spark, data), items_of(spark, [(1, "a b c c")])) == brute(data, [(1, "a b c c")], 20)


def random_segment(rng):
    n_docs, n_terms = 60, 12
    lists = [np.sort(rng.choice(n_docs, rng.integers(0, 40), replace=False)) for _ in range(n_terms)]
    impacts = [rng.integers(1, 1000, len(x)) for x in lists]
    queries = R.Queries([])
    queries.terms, queries.weights = np.arange(n_terms, dtype=np.uint64), rng.integers(1, 9, n_terms)
    queries.own = [(np.sort(rng.choice(n_terms, k, replace=False)), rng.integers(1, 4, k)) for k in (1, 4, 7, 12)]
    queries.weigh(1, {})
    starts = np.append(0, np.cumsum([len(x) for x in lists]))
    pair_post, pair_impacts = [], []
    for x, y in queries.pairs:
        both, i, j = np.intersect1d(lists[x], lists[y], return_indices=True)
        pair_post.append(both)
        pair_impacts.append(impacts[x][i] + impacts[y][j])
    some = [k for k, x in enumerate(pair_post) if len(x)]
    present = [k for k in range(n_terms) if len(lists[k])]
    row = {"ids": np.arange(n_docs), "terms": np.array(present), "starts": np.append(0, np.cumsum([len(lists[k]) for k in present])),
           "impacts": np.concatenate([impacts[k] for k in present]), "pairs": np.array(some),
           "pair_starts": np.append(0, np.cumsum([len(pair_post[k]) for k in some])), "pair_impacts": np.concatenate([pair_impacts[k] for k in some])}
    row = {k: v.astype("<i8").tobytes() for k, v in row.items()}
    row |= {"post": np.concatenate([lists[k] for k in present]).astype("<i4").tobytes(), "pair_post": np.concatenate([pair_post[k] for k in some]).astype("<i4").tobytes()}
    assert len(starts) == n_terms + 1
    return R.Segment(row, n_terms, len(queries.pairs)), queries, lists, impacts, n_docs


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_and_are_tighter_than_term_maxima(seed):
    segment, queries, lists, impacts, n_docs = random_segment(np.random.default_rng(seed))
    for (terms_, repeats), unit in zip(queries.own, queries.units, strict=True):
        score = np.zeros(n_docs, np.int64)
        for t, q in zip(terms_, repeats, strict=True):
            score[lists[t]] += q * impacts[t]
        bounds = segment.bounds(unit)
        for k, bound in enumerate(bounds):
            own = np.zeros(n_docs, np.int64)
            for t, q in ((unit[0][k], unit[2][k]), (unit[1][k], unit[3][k])):
                if t >= 0:
                    own[lists[t]] += q * impacts[t]
            assert own.max() <= bound <= unit[2][k] * segment.highest[unit[0][k]] + unit[3][k] * segment.highest[unit[1][k]]
        for top, floor in ((3, 1), (3, int(np.sort(score)[-3])), (10, int(score.max()))):
            docs, found = R.search(segment, unit, top, floor)
            want = sorted(((-s, d) for d, s in enumerate(score) if s >= floor and s > 0))[:top]
            assert sorted(zip((-found).tolist(), docs.tolist(), strict=True))[:len(want)] == want
