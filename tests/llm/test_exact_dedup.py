import hashlib
import random
import re

from complexa.llm import exact_dedup as X


def brute(rows):
    out, groups = [], {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[key])
        out.append((i, None if best[1] else best[2], len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return out


def test_groups_match_brute_force(documents):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé \n") for _ in range(30_000))
    rows = [(1, "a b"), (2, "ab"), (3, None), (4, ""), (5, " \t\n"), (6, "a\x0bb  "), (7, long), (8, long.replace(" ", "  ")),
            (9, long[:-1] + "x"), (None, "ab"), (None, "zz"), (11, "a b"), (12, "ß ")]
    got = X.exact_groups(documents(rows)).collect()
    assert sorted(map(repr, brute(rows))) == sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got)
    assert {r.doc_id for r in got if r.kept} == {6, 5, 8, 9, None, 11, 12}


def test_repeated_rows_keep_one(documents):
    docs = documents([(1, "same"), (1, "same"), (2, "same")])
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in X.exact_groups(docs).collect()) == [(1, 1, False), (1, 1, True), (2, 1, False)]
    assert [r.doc_id for r in X.exact_dedup(docs).collect()] == [1]


def test_empty_table(documents):
    assert X.exact_groups(documents([])).count() == 0 and X.exact_dedup(documents([])).count() == 0


def test_chunks_cover_and_survive_an_insertion():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(60_000))
    ends = X.chunk_ends(data)
    assert ends[-1] == len(data) and all(0 < b - a <= X.MAX_CHUNK for a, b in zip([0, *ends], ends))
    cut = lambda d: {d[a:b] for a, b in zip([0, *X.chunk_ends(d)], X.chunk_ends(d))}
    assert len(cut(data) & cut(data[:20_000] + b"inserted" + data[20_000:])) >= len(ends) - 4
    assert X.chunk_ends(b"") == [0]


def test_identifier_that_stands_for_two_chunks(documents, spark, monkeypatch):
    # all chunks get one identifier: only the digests can tell the texts apart
    real = X.hashlib.sha256

    def same(batches):
        for b in X_recipes(batches):
            import pyarrow as pa
            ids = [[0] * len(r) for r in b.column("recipe").to_pylist()]
            proof = [[{**e, "id": 0} for e in es] for es in b.column("evidence").to_pylist()]
            cols = [b.column(c) for c in ("doc_id", "rid", "n_cp", "text_sha256")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.list_(pa.int64())), pa.array(proof, b.schema.field("evidence").type)],
                                             names=b.schema.names)

    X_recipes = X._recipes
    monkeypatch.setattr(X, "_recipes", same)
    got = X.exact_groups(documents([(1, "abc"), (2, "abd"), (3, "ab c")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 3), (2, 2), (3, 3)]
    assert real is X.hashlib.sha256
