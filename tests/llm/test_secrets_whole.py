import random

from complexa.llm import secrets as S


def test_short_and_partly_covered_candidates_are_scored(documents, spark):
    rng = random.Random(4)

    def make(n):
        return "gk-" + "".join(rng.choice("XYZWQJ0189") for _ in range(n - 3))

    inner = "gk-XW" + "0189" * 4 + "XYZ"  # holds a hex run: a base span
    labelled = spark.createDataFrame([("assign", make(rng.randrange(12, 40))) for _ in range(400)], "kind string, value string")
    rows = [(1, f"see {(short := make(12))} now"), (2, f"see {inner} now"), (3, "see 0123456789abcdef0123 now"), (4, "api_key: " + make(20))]
    rows += [(i, " ".join("".join(rng.choice(["er", "ung", "lich"]) for _ in range(5)) for _ in range(9))) for i in range(10, 90)]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in S.scan_secrets(documents(rows), labelled).collect()}
    assert got[1] == [("grammar", short)]
    assert got[2] == [("grammar", inner), ("hex", "0189" * 4)]
    assert [k for k, _ in got[3]] == ["hex"] and [k for k, _ in got[4]] == ["assign"]
    assert not any(got[i] for i in range(10, 90))
