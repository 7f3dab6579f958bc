import random

import pytest

from complexa.llm import decontaminate as D


def shingles(text, n):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, items, n, num, den):
    out = []
    for d, t in docs:
        have = shingles(t, n)
        for i, q in items:
            want = shingles(q, n)
            if want and den * len(want & have) >= num * len(want):
                out.append((repr(d), repr(i), len(want), len(want & have)))
    return sorted(out)


def data(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 14, 30, 59])))) for i in range(40)]
    items += [(100, None), (101, " "), (None, "null item with some seven words here"), (102, items[5][1]), (7, items[7][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            q = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if q:
                    q[rng.randrange(len(q))] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in q] if rng.random() < 0.3 else q
        docs.append((i, " \n".join(w)))
    docs += [(200, items[3][1]), (200, items[3][1]), (201, None), (202, ""), (None, items[6][1]), (203, items[0][1]), (204, "w1 " * 20_000 + items[6][1])]
    return docs, items


def tables(spark, documents, docs, items):
    return documents(docs), spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, lang string, rid int")


@pytest.mark.parametrize("seed, n, num, den", [(1, 5, 80, 100), (2, 3, 60, 100), (3, 5, 100, 100)])
def test_matches_brute_force(spark, documents, seed, n, num, den):
    docs, items = data(seed)
    got = D.contaminated(*tables(spark, documents, docs, items), n, num, den).collect()
    assert sorted((repr(r.doc_id), repr(r.item_id), r.n_item, r.n_shared) for r in got) == brute(docs, items, n, num, den)


def test_beyond_the_broadcast_bound(spark, documents, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    docs, items = data(4)
    got = D.contaminated(*tables(spark, documents, docs, items)).collect()
    assert sorted((repr(r.doc_id), repr(r.item_id), r.n_item, r.n_shared) for r in got) == brute(docs, items, 5, 80, 100)


def test_filter_and_empty_tables(spark, documents):
    docs, items = data(5)
    d, b = tables(spark, documents, docs, items)
    hit = {x[0] for x in brute(docs, items, 5, 80, 100)}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i, _ in docs if repr(i) not in hit)
    assert D.decontaminate(d, b.limit(0)).count() == len(docs) and D.contaminated(d.limit(0), b).count() == 0


def test_no_python_in_the_plan(spark, documents):
    plan = D.contaminated(*tables(spark, documents, *data(6)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
