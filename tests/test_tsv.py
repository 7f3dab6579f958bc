"""SRC6 by many tasks: equal to the reader that takes a file in one task, wherever the blocks cut the text."""
import random

import pytest

from complexa.sources import io as IO
from complexa.sources import tsv


@pytest.fixture
def blocks(spark):
    """Set the size of a file block."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("seed", range(5))
def test_equals_the_one_task_reader(spark, tmp_path, blocks, seed):
    rng = random.Random(seed)
    for f in range(2):
        records = []
        for _ in range(rng.randrange(1, 60)):
            code = "".join(rng.choice(["a", "b c", "\n", '""', "\t", "é", "\n\n", "'"]) for _ in range(rng.randrange(12)))
            plain = rng.choice(["plain", 'mid"quote', 'a"b"c', "", "'"])
            records.append(f"{rng.randrange(7)}\t" + (f'"{code}"' if rng.random() < 0.7 else plain))
        (tmp_path / f"f{f}.tsv").write_text("\n".join(records) + rng.choice(["", "\n"]))
    want = rows(IO.read_tsv_whole_files(spark, str(tmp_path)))
    for size in (23, 64, 1 << 20):
        blocks(size)
        assert rows(IO.read_tsv(spark, str(tmp_path))) == want


def test_one_record_over_many_blocks_and_many_tasks(spark, tmp_path, blocks):
    code = "x\n" * 500 + 'say ""hi""\n\t.'
    (tmp_path / "a.tsv").write_text(f'1\t"{code}"\n2\tplain\n' + "".join(f'3\t"{i}\n"\n' for i in range(300)))
    blocks(100)
    assert tsv.read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    got = sorted((r.label, r.code) for r in IO.read_tsv(spark, str(tmp_path)).collect())
    assert got[0] == (1, code.replace('""', '"')) and got[1] == (2, "plain") and len(got) == 302 and {c for k, c in got if k == 3} == {f"{i}\n" for i in range(300)}


def test_an_unclosed_quote_and_empty_files(spark, tmp_path, blocks):
    (tmp_path / "a.tsv").write_text('1\t"open\nto the end')
    (tmp_path / "b.tsv").write_text("")
    (tmp_path / "c.tsv").write_text('2\t"x"\r\n\n3\ty\r\n')
    blocks(5)
    got = sorted((r.label, r.code) for r in IO.read_tsv(spark, str(tmp_path)).collect())
    assert [g for g in got if g[0] != 1] == [(2, "x"), (3, "y")] and len(got) == 3 and "to the end" in got[0][1]


@pytest.mark.parametrize("line, inside, after", [
    ('1\t"a', False, True), ('1\t"a"', False, False), ('1\t"a""', False, True), ('1\ta"b', False, False), ('"', False, True), ('""', False, False), ('"', True, False),
    ('""', True, True), ('b"\t"c', True, True), ('b"x"\t"c"', True, False), ("", True, True), ("", False, False), ('a\t"b"c"\t"', False, True)])
def test_state_after_a_line(line, inside, after):
    assert tsv.ends_inside(line, inside) is after
