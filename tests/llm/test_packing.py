import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from complexa.llm import packing as P


def naive_first_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            b = len(room)
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


@given(st.lists(st.integers(1, 50), max_size=120))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing_is_the_naive_one(sizes):
    bins, offsets = P.first_fit_decreasing(np.array(sizes, np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == naive_first_fit(sizes, 50)


def test_both_tokeniser_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    ids = P.encoder(P.VOCABULARY)
    rng = random.Random(2)
    chars = "abc XYZ 0189'sé  ßÀɏñ\t\n\r.,!<|>_-日🙂\x1c\u0085"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|> a", "it's we'll  x \n\n y", "", " ", "a" * 5000]
    for t in texts:
        assert ids(t) == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_cover_documents_and_sequences_are_gapless(documents):
    rng = random.Random(5)
    words = ["alpha", "beta", "Ünïcode", "x1", "\n"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 700, 3000])))) for i in range(60)] + [(None, None), (7, "again"), (7, "again")]
    got = P.pack_documents(documents(rows)).collect()
    ids = P.encoder(P.VOCABULARY)
    want = []
    for i, t in rows:
        x = np.array([*ids(t or ""), 0], "<u4")
        want += [(i, a, len(x[a:a + 1024]), zlib.crc32(x[a:a + 1024].tobytes()), len(x)) for a in range(0, len(x), 1024)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by) <= total / 1024 * 1.1 + 1


def test_several_groups_have_their_own_sequences(documents):
    pieces = P.cut_documents(documents([(i, "word " * (i % 90)) for i in range(200)]))
    got = P.pack_pieces(P.work_table(pieces, "pieces"), group_pieces=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in v) <= 1024 and len({o for o, _ in v}) == len(v) for v in by.values()) and len(got) == 200


def test_empty_table(documents):
    assert P.pack_documents(documents([])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_tree_of_any_size(n):
    rooms = P.Rooms(n, 4)
    for b in range(n):
        assert rooms.first(4) == b
        rooms.take(b, 4)
