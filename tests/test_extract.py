import pytest
from pyspark.sql import functions as F

from complexa.functions.extract import assistant_segment, extract_complexity
from complexa.functions.labels import t_label, t_name, text_to_rank

CASES = [
    ("the time complexity is o(n log n).", "nlogn"),
    ("overall time complexity: quadratic o(n^2)", "quadratic"),
    ("complexity depends on the input: o(n)", "exponential"),
    ("i do not know", "NO RESPONCE"),
    ("complexity is linear, o(n^3)", "cubic"),
    ("complexity is exponential o(2^n)", "exponential"),
    ("complexity unknown", "ERROR"),
    ("complexity is logarithmic", "ERROR"),
    ("complexity is linearithmic", "linear"),
    ("overall time o(1) overall time o(n^2)", "constant"),
    ("complexity cubic complexity linear", "cubic"),
]


def test_extraction_fixture(spark):
    df = spark.createDataFrame(CASES, "seg string, want string")
    got = df.select("want", extract_complexity("seg").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_assistant_segment(spark):
    df = spark.createDataFrame([("p<|eot_id|>A<|eot_id|>The Answer", "meta-llama/Llama-3"),
                                ("x<end_of_turn>Y", "google/gemma-2"), ("no marker", "Qwen/Qwen2"),
                                ("z", "unknown/model")], "r string, m string")
    got = [r[0] for r in df.select(assistant_segment("r", "m")).collect()]
    assert got == ["the answer", "y", "no marker", None]


LABELS = [("constant", 0), ("logn", 1), ("Logarithmic", 1), ("O(log n)", 1), ("linear", 2), ("n", 2),
          ("nlogn", 3), ("quadratic", 4), ("n^3", 5), ("np", 6), ("factorial", 6), ("ERROR", -1), ("O(n)", None)]


@pytest.mark.parametrize("unscored", [-1, 7])
def test_text_to_rank(spark, unscored):
    df = spark.createDataFrame([(k,) for k, _ in LABELS], "k string")
    got = [r[0] for r in df.select(text_to_rank("k", unscored)).collect()]
    want = [unscored if v == -1 else v for _, v in LABELS]
    assert got == want


def test_t_order_round_trip(spark):
    names = ["constant", "linear", "logn", "quadratic", "cubic", "nlogn", "np", "exponential"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    ids = [r[0] for r in df.select(t_label("n")).collect()]
    assert ids == [0, 1, 2, 3, 4, 5, 6, 6]
    back = [r[0] for r in spark.createDataFrame([(i,) for i in range(7)], "i int").select(t_name("i")).collect()]
    assert back == names[:7]


def test_word_boundary_mode(spark):
    df = spark.createDataFrame([("complexity depends on the input: o(n)",), ("complexity is np-hard",)], "seg string")
    got = [r[0] for r in df.select(extract_complexity("seg", word_boundary=True)).collect()]
    assert got == ["linear", "exponential"]


def test_quarantine_and_missing(spark):
    from complexa.operators.refine import encode_with_quarantine, missing_responses
    refined = spark.createDataFrame([(1, "org/m", "linear", "cubic"), (2, "org/m", "O(n)", "linear")],
                                    "idx long, model_id string, answer string, complexity string")
    ok, bad = encode_with_quarantine(refined)
    assert [r.idx for r in ok.collect()] == [1] and [r.idx for r in bad.collect()] == [2]
    ex = spark.createDataFrame([(1,), (2,), (3,)], "idx long")
    assert sorted(r.idx for r in missing_responses(ex, refined).collect()) == [3]


def test_raw_response_file_names(spark, tmp_path):
    from complexa.sources.io import read_raw_responses
    # Python-literal wrappers as the inference job writes them: an escaped newline, and a
    # double-quoted literal (used when the text holds a single quote)
    files = {3: "[{'generated_text': 'a\\nb'}]", 12: "[{'generated_text': \"it's\"}]"}
    for i, t in files.items():
        (tmp_path / f"responce_{i:04d}.txt").write_text(t)
    got = {r.idx: r.response for r in read_raw_responses(spark, str(tmp_path)).collect()}
    assert got == {3: "a\nb", 12: "it's"}
