import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from complexa.llm import ngram_lm as L


def brute(rows, order):
    """(score, tokens) per row; contexts of up to order - 1 words, the begin of the text being one."""
    def words(t):
        return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", t), None]

    grams, context, types = Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        w = words(t)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for j in range(1, len(w)):
                for k in range(min(order, j + 1)):
                    u = tuple(w[j - k:j])
                    grams[u, w[j]] += 1
                    context[u] += 1
                    types[u].add(w[j])
    n, size = context[()], len(types[()])

    def p(u, w):
        if not u:
            return (grams[(), w] + 1) / (n + size + 1)
        if not context[u]:
            return p(u[1:], w)
        return (max(grams[u, w] - L.DISCOUNT, 0) + L.DISCOUNT * len(types[u]) * p(u[1:], w)) / context[u]

    return {i: (sum(math.log10(p(tuple(w[max(0, j - order + 1):j]), w[j])) for j in range(1, len(w))), len(w) - 1) for i, t in rows for w in [words(t)]}


@pytest.mark.parametrize("order", [3, 4])
def test_contexts_of_several_words(documents, spark, monkeypatch, order):
    monkeypatch.setattr(L, "CHARS_PER_SHARD", 3000)  # several shards
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x", "yz"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    rows += [(1000, "a b unseen a b c"), (1001, ""), (1002, "unseen"), (1003, "a " * 3000)]
    got = {r.doc_id: r.score for r in L.lm_scores(spark, documents(rows), order).collect()}
    for i, (score, n) in brute(rows, order).items():
        assert abs(got[i] - score) <= n * 1.1 * order * L.RANGE / 65535
    assert L.lm_scores(spark, documents([]), order).count() == 0


def test_the_query_scores_with_three_levels():
    assert L.ORDER >= 3
