import json

from pyspark.sql import functions as F

from complexa import jobs


def test_refine_and_score(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    segs = ["the time complexity is o(n log n).", "overall time complexity: quadratic o(n^2)", "i do not know"]
    for i, seg in enumerate(segs):
        (raw / f"responce_{i:04d}.txt").write_text("[{'generated_text': 'prompt<|eot_id|>" + seg + "'}]")
    ex = tmp_path / "ex.json"
    answers = ["nlogn", "cubic", "linear"]
    ex.write_text("\n".join(json.dumps({"conv_id": str(i), "messages": [
        {"role": "user", "content": "code"}, {"role": "assistant", "content": f"The complexity is: {a}"}]})
        for i, a in enumerate(answers)) + "\n")
    rep = jobs.refine_and_score(spark, str(raw), str(ex), "meta-llama/Llama-x", str(tmp_path / "refined"),
                                str(tmp_path / "reports")).first()
    assert rep.accuracy == 1 / 3 and rep.n_rows == 3
    text = spark.read.text(str(tmp_path / "reports"), wholetext=True).first().value
    assert text.startswith("meta-llama/Llama-x with corpus\nScores\nacc: 0.333")
    assert spark.read.json(str(tmp_path / "refined")).count() == 3


def test_split_then_classical(spark, tmp_path):
    names = ["constant", "linear", "logn", "quadratic", "cubic", "nlogn", "exponential"]
    rows = []
    for i in range(140):
        loops = "for (int i = 0; i < n; i++) { s++; }\n" * (i % 3)
        rows.append({"src": f"class A{i} {{\n  static int f(int n) {{\n    int s = 0; // c\n    {loops}    return s;\n  }}\n}}\n",
                     "complexity": names[i % 7], "problem": f"p{i % 20}", "from": "x", "tags": "a,b"})
    corpus = tmp_path / "corpus.jsonl"
    corpus.write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    dist, ratio = jobs.split_corpus(spark, str(corpus), "java", str(tmp_path / "folds"))
    assert sum(r.n_class for r in dist.collect()) == 140
    r = {x.f: x for x in ratio.collect()}
    assert sorted(r) == [0, 1, 2, 3] and all(x.train + x.test == 140 for x in r.values())
    back = spark.read.json(str(tmp_path / "folds"))
    assert back.filter(F.col("split") == "test").count() == 140 and "// c" not in back.first().src
    res = jobs.classical_kfold(spark, str(tmp_path / "folds"), "java").first()
    assert res.n_folds == 4 and 0 <= res.accuracy_mean <= 1
