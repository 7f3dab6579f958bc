import hashlib
import random
import re
from collections import Counter

import pytest

from complexa.llm import substring_dedup as S


def brute(rows, window):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, docs):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((repr(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def rows_with_repeats(seed, window):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [make(rng.randrange(max(1, window - 2), window * 3)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = make(rng.randrange(0, window * 6))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(shared)
            cut = rng.randrange(len(p))
            w[at:at] = p[cut:] if rng.random() < 0.3 else p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(100, rows[3][1]), (101, None), (102, ""), (103, "a " * (window * 3)), (104, " ".join(shared[0]).upper()), (None, " ".join(shared[1]))]
    rows += [(105, "x y z"), (105, "x y z"), (106, "Ünïcode ß " * window), (106, "Ünïcode ß " * window)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, window", [(1, 35), (2, 6), (3, 2), (4, 1)])
def test_matches_brute_force(documents, seed, window):
    rows = rows_with_repeats(seed, window)
    got = S.substring_dedup(documents(rows), window).collect()
    want = brute(rows, window)
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(w[:4] for w in want)
    texts = {w[3]: w[4] for w in want}
    assert all(r.kept_text is None and r.n_removed == 0 or r.kept_text == texts[r.kept_sha256] for r in got)


def test_empty_table(documents):
    assert S.substring_dedup(documents([])).count() == 0


def test_many_tiles(documents, monkeypatch):
    monkeypatch.setattr(S, "CHARS_PER_TILE", 500)
    rows = rows_with_repeats(7, 12)
    got = S.substring_dedup(documents(rows), 12, texts=False).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(w[:4] for w in brute(rows, 12))
