import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from complexa.llm import ngram_lm as L
from complexa.llm.elias_fano import EliasFano, map_arrays, write_arrays

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


@given(st.lists(st.integers(0, 10**9 - 1), max_size=300), st.lists(st.integers(0, 10**9 - 1), max_size=40))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, queries):
    v = np.unique(np.array(values, np.uint64))
    ef = EliasFano(EliasFano.encode(v, 10**9))
    assert (ef.get(np.arange(len(v))) == v).all()
    q = np.array([*queries, *values], np.uint64)
    at, found = ef.find(q)
    assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


@pytest.mark.parametrize("universe, n", [(2**64, 3000), (7, 3), (64, 64), (10**12, 20_000), (1, 1)])
def test_elias_fano_sizes(universe, n):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    ef = EliasFano(EliasFano.encode(v, universe))
    assert (ef.get(np.arange(len(v))) == v).all() and ef.find(v)[1].all()
    assert ef.low.nbytes * 8 <= n * (max(1, universe // len(v)).bit_length() + 1) + 256


def test_repeated_values_as_pointers():
    v = np.array([0, 0, 0, 3, 3, 9], np.uint64)
    assert (EliasFano(EliasFano.encode(v, 10)).get(np.arange(6)) == v).all()


def test_files(tmp_path):
    folder = f"file://{tmp_path}/x"
    arrays = {"a": np.arange(5), "b": np.zeros(0, np.uint16), "c": np.array([2**63], np.uint64)}
    got = map_arrays(folder, write_arrays(folder, "n", arrays))
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())


def brute(rows):
    uni, pair, context, types = Counter(), Counter(), Counter(), defaultdict(set)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            uni.update(w)
            for u, v in zip(["<s>", *w], w):
                pair[u, v] += 1
                context[u] += 1
                types[u].add(v)
    n, size = sum(uni.values()), len(uni)
    out = {}
    for i, t in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for u, v in zip(["<s>", *w], w):
            p1 = (uni[v] + 1) / (n + size + 1)
            base += math.log10(p1)
            score += math.log10(max(pair[u, v] - L.DISCOUNT, 0) / context[u] + L.DISCOUNT * len(types[u]) / context[u] * p1 if context[u] else p1)
        out[i] = (held[i], len(w), sum(uni[v] > 0 for v in w), n, base, score)
    return out


def test_scores_match_brute_force(documents, spark, monkeypatch):
    monkeypatch.setattr(L, "CHARS_PER_SHARD", 3000)  # several shards
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefÄß") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.randrange(0, 80)))) for i in range(150)]
    rows += [(1000, "Zebra zebra ZEBRA unseen"), (1001, None), (1002, ""), (1003, " \n\t "), (None, "a b a"), (1004, "x " * 5000)]
    got = {r.doc_id: r for r in L.lm_scores(spark, documents(rows)).collect()}
    for i, (held, n, known, total, base, score) in brute(rows).items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert abs(r.score - score) <= n * 2.2 * L.RANGE / 65535


def test_repeated_rows_and_empty_tables(documents, spark):
    got = L.lm_scores(spark, documents([(1, "a b"), (1, "a b"), (2, "a")])).collect()
    want = sum(n for i, n in ((1, 3), (1, 3), (2, 2)) if zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(got) == 3 and got[0].train_tokens == want
    assert L.lm_scores(spark, documents([])).count() == 0
    (only,) = L.lm_scores(spark, documents([(i, "w w") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:1])).collect()
    assert only.held_out and only.train_tokens == 0 and only.base_score == 0 and only.score == 0


def test_probabilities_sum_to_one(documents, spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = documents([(i, " ".join(rng.choice(words) for _ in range(9))) for i in range(40)])
    model = L.train(spark, docs)
    from complexa.llm.common import Words
    raw = " ".join(words).encode()
    hashes = np.unique(np.append(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True).hash, L.END))
    ids, counts = model.ids_counts(hashes)
    uni = np.append(model.log_unigram(counts), model.log_unigram(np.zeros(1, int)))
    assert 10 ** uni @ np.ones(len(uni)) == pytest.approx(1)
    for context in [*ids.tolist(), model.types, model.types + 1]:
        logs = model.log_pairs(np.full(len(uni), context), np.append(ids, model.types), uni)
        assert (10 ** logs).sum() == pytest.approx(1, abs=2e-3)
