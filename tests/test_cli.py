"""The command-line jobs, end to end on files in a fresh temp folder."""

import os
import sys
import tempfile

import pandas as pd
from pyspark import cloudpickle

from recordaudit.plans import cli

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shout(prompt):
    """Stand-in client for the generate job."""
    return None if "skip" in prompt else prompt.upper()


def _records(root):
    rows = {
        "qwen-7B_v5.1.parquet": [("25", "Male", "30岁", "女性", "flu", "江苏省", "南京市", "玄武区", "ab", 10.0),
                                 ("unknown", None, "三个月", "男", "cold", None, None, None, None, 12.0)],
        "yi-14B_v5.1.parquet": [("40", "female", "25-34岁", "未知", "flu", "浙江", "杭州", "西湖区", "abc", 3.0)],
    }
    cols = ["Age", "Sex", "Age_Chinese", "Sex_Chinese", "disease", "Province_Chinese", "City_Chinese",
            "District_Chinese", "English_a", "English_a_tokens"]
    for name, data in rows.items():
        pd.DataFrame(data, columns=cols).to_parquet(os.path.join(root, name), index=False)


def test_cli_jobs(spark):
    root = tempfile.mkdtemp(prefix="recordaudit-cli-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    _records(src)
    out = lambda n: os.path.join(root, n)

    cov = cli.run(spark, ["coverage", "--input", src, "--output", out("cov"), "--total", "0"])
    by = {r.Model: r for r in cov.collect()}
    assert by["qwen-7B"]["English: Both"] == 1 and by["qwen-7B"]["English: Neither"] == 1
    assert by["yi-14B"]["English_LMS_Both_Ratio"] == 1.0

    ages = cli.run(spark, ["age-profile", "--input", src, "--output", out("age"), "--wide"])
    assert ages.count() == 40  # 2 columns x 20 bands, one column per disease

    genders = cli.run(spark, ["gender-profile", "--input", src, "--output", out("sex"),
                              "--columns", "Sex"])
    assert {r.category for r in genders.collect()} == {"Female", "Male", "Unknown"}

    pd.DataFrame({"省": ["江苏省"], "地级市": ["南京市"], "县区": ["玄武区"]}).to_csv(out("gaz.csv"), index=False)
    loc = cli.run(spark, ["location", "--input", src, "--output", out("loc"), "--gazetteer", out("gaz.csv"),
                          "--home", "玄武"]).collect()
    q = {r.Model: r for r in loc}["qwen-7B"]
    assert (q.Matched_Province, q.Matched_City, q.Matched_District, q.Out_Of_Home_Districts) == (1, 1, 1, 0)

    target = cli.run(spark, ["clean", "--input", src, "--output", out("ds"), "--version", "v5.11"])
    cleaned = {r.Age_Chinese for r in spark.read.parquet(target).collect()}
    assert cleaned == {30, 0, 29}  # 30岁, 三个月 -> 0, 25-34岁 -> 29

    real = pd.DataFrame({"gender": ["Female", "Male"], "flu": ["12 (40.0%)", "18 (60.0%)"], "cold": [5, 5]})
    real.to_csv(out("real.csv"), index=False)
    cli.run(spark, ["chi-square", "--input", src, "--output", out("chi"), "--real", out("real.csv")])
    assert sorted(os.listdir(out("chi"))) == ["combined", "split"]
    chi = spark.read.option("header", "true").csv(out("chi") + "/combined")
    assert {(r.model, r.disease, r.language) for r in chi.collect()} == {
        (m, d, lang) for m in ("qwen-7B", "yi-14B") for d in ("flu", "cold") for lang in ("English", "Chinese")}
    per_model = cli.run(spark, ["age-profile", "--input", src, "--output", out("age2"), "--group", "model_name", "disease"])
    assert {(r.model_name, r.disease) for r in per_model.collect()} == {("qwen-7B", "flu"), ("qwen-7B", "cold"), ("yi-14B", "flu")}

    tok = cli.run(spark, ["tokens", "--input", src, "--output", out("tok"), "--columns", "English_a_tokens"])
    assert {r.model_name: r.english_a_tokens for r in tok.collect()} == {"qwen-7B": "11.00 ± 1.41", "yi-14B": "3.00 ± nan"}

    lengths = cli.run(spark, ["lengths", "--input", src, "--output", out("len"), "--version", "v5.10",
                              "--columns", "English_a"])
    assert sorted(r.English_a_length for r in spark.read.parquet(lengths).collect()) == [2, 3, 3]


def test_cli_generate(spark):
    root = tempfile.mkdtemp(prefix="recordaudit-gen-")
    pd.DataFrame({"template": ["About {{CONDITION}}", "skip {{CONDITION}}"]}).to_csv(os.path.join(root, "p.csv"), index=False)
    pd.DataFrame({"condition": ["1型糖尿病", "2型糖尿病"], "background": ["{bg1}", "{bg2}"],
                  "disease": ["Type 1 diabetes", "Type 2 diabetes"]}).to_csv(os.path.join(root, "c.csv"), index=False)
    out = cli.run(spark, ["generate", "--prompts", os.path.join(root, "p.csv"), "--conditions", os.path.join(root, "c.csv"),
                          "--client", f"{__name__}:shout", "--model", "m/7B", "--language", "Chinese", "--runs", "3",
                          "--output", os.path.join(root, "answers")])
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 * 3  # the "skip" template fails for every run and is dropped
    assert {r.disease for r in rows} == {"Type 1 diabetes", "Type 2 diabetes"}
    assert sorted(r.seq for r in rows if r.disease == "Type 1 diabetes") == [1, 2, 3]
    assert all(r.answer.startswith("ABOUT ") and r.language == "Chinese" for r in rows)
