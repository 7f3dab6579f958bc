"""Collocation mining against plain counting, and its defined cases."""
import random
import re
from collections import Counter, defaultdict

import pytest

from complexa.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, key string, a long, n int"


def rows(spark, data):
    return spark.createDataFrame([(i, t, lang, "x", 0, 0) for i, (t, lang) in enumerate(data)], SCHEMA)


def brute(data, min_count, percent, top, max_words=4):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in data:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cands.items():
            around = max((b for q, b in cands.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))), default=0)
            if 100 * around >= percent * a and around:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "é", "New", "york", "a", "a", "'s", "x\x00y", "日本", "the"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " "]) for _ in range(rng.randrange(60))),
             rng.choice(["en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_counting(spark, seed, monkeypatch):
    data = corpus(seed)
    want = brute(data, 4, 80, 50)
    assert len(want) > 40 and mined(rows(spark, data).repartition(3), min_count=4, top=50) == want


def test_small_blocks_change_nothing(spark, monkeypatch):
    data = corpus(3, 30)
    monkeypatch.setattr(C, "BLOCK_WORDS", 40)  # blocks are cut in the workers of this process' module only where they are forked later
    held = C._Held()
    assert held.n == 0
    assert mined(rows(spark, data), min_count=3, max_words=3, inside_percent=50, top=7) == brute(data, 3, 50, 7, 3)


def test_repeats_overlap_and_nothing_crosses_pieces(spark):
    data = [("go go go go go", "en"), ("stop. go", "en"), (None, "en"), ("", "en"), (" \t", "en"), (".,;", None)] * 2
    assert mined(rows(spark, data), min_count=2) == brute(data, 2, 80, 2000)
    assert {r[2] for r in mined(rows(spark, data), min_count=2, inside_percent=101)} == {"go go", "go go go", "go go go go"}


def test_ties_go_by_bytes_and_limits_are_per_language(spark):
    data = [("b a. c a. Ã a. z a", "en")] * 3 + [("b a", "de")] * 3
    got = mined(rows(spark, data), min_count=3, top=2)
    assert [(r[0], r[1], r[2]) for r in got] == [("de", 1, "b a"), ("en", 1, "b a"), ("en", 2, "c a")]


def test_long_texts_and_empty_tables(spark):
    long = [("p q r. " * 60_000, "en"), ("w" * 300_000 + " v", "en")]
    got = mined(rows(spark, long))
    assert got == [("en", 1, "p q r", 60_000, 60_000, 60_000, 180_002, 1_000_000)]
    assert mined(rows(spark, [])) == [] and mined(rows(spark, [(None, None)])) == []
