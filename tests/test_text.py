from pyspark.sql import functions as F

from complexa.functions import text as T
from complexa.functions.chat import merge_user_turns, remove_assistant, render_chat, messages


def test_remove_comments(spark):
    rows = [("int a; // c1", "java", "int a; "), ('String s="//keep";', "java", 'String s="//keep";'),
            ("x //crlf\r\ny", "java", "x //crlf\r\ny"), ("x = 1 # c", "python", "x = 1 "), ("a // b", "other", "a // b")]
    df = spark.createDataFrame(rows, "src string, lang string, want string")
    got = df.select("want", T.remove_comments("src", "lang").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_strip_comments_c(spark):
    df = spark.createDataFrame([('a = "x//y"; // gone\n\nb; /* c */ d',)], "s string")
    assert df.select(T.strip_comments_c("s")).first()[0] == 'a = "x//y";  \nb;   d'


def test_py_depth_fixture(spark):
    src = "def f():\n    for i in r:\n        while True:\n            pass\n"
    df = spark.createDataFrame([(src,)], "s string")
    r = df.select(T.py_depth("s").alias("d")).first().d
    assert (r.max_depth, r.max_stack) == (3, 3)


def test_line_count_and_counts(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("if x: break\nfor y in list(z): pass",)], "s string")
    got = [r[0] for r in df.select(T.line_count("s")).collect()]
    assert got == [2, 0, 2]
    c = df.select(T.py_counts("s").alias("c")).collect()[2].c
    assert (c.n_if, c.n_loop, c.n_break, c.n_list) == (1, 1, 1, 1)


def test_length_bucket_borders(spark):
    df = spark.createDataFrame([(n,) for n in (255, 256, 511, 512, 1023, 1024)], "n int")
    assert [r[0] for r in df.select(T.length_bucket("n")).collect()] == ["256", "512", "512", "1024", "1024", "over"]


def test_chat_fixture(spark):
    chat = spark.createDataFrame([(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"),
                                  (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    m = messages(chat).orderBy("conv_id").collect()
    kept = [r for r in messages(chat).select("conv_id", remove_assistant("messages").alias("m")).orderBy("conv_id").collect()]
    assert [x.content for x in kept[0].m] == ["a", "b", "d"]
    merged = merge_user_turns(chat).orderBy("conv_id", "pos").collect()
    assert [(r.conv_id, r.role, r.text) for r in merged] == [
        (1, "user", "ab"), (1, "assistant", "c"), (1, "user", "d"), (2, "user", ""), (2, "assistant", "x")]
    assert m[0].messages[0].content == "a"
    text = messages(chat).select(render_chat("messages")).orderBy("conv_id" if False else render_chat("messages")).collect()
    assert any(t[0].startswith("a\n\nHuman: b") for t in text)


def test_py_strip_matches_python(spark):
    samples = [" a ", "\n\tcubic\r\n", " linear　", "x", "", "  ", "\x1cq\x85"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(T.py_strip("s")).collect()]
    assert got == [s.strip() for s in samples]


def test_python_pattern_semantics_match_python_re(spark):
    import re
    rx = re.compile(T.PYTHON_COMMENT, re.MULTILINE | re.DOTALL)

    def py_sub(s):
        return rx.sub(lambda m: "" if m.group(2) is not None else m.group(1), s)

    samples = ['a = """x""" # c\n"""doc"""', 'a =\u00a0"""x""" # c\n"""doc"""', "y = 1 # c\r\nz = 2", "s = '#not' # yes", "q = 1\n# only\n"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(T.remove_comments("s", F.lit("python"))).collect()]
    assert got == [py_sub(s) for s in samples]
