"""Golden values for the string / format expressions."""

from pyspark.sql import functions as F

from recordaudit.functions import text as X


def test_suffix(one):
    vals = ["江苏省", "大兴安岭地区", "内蒙古自治区", "特别行政区", "市辖区", "南京", None]
    assert one(vals, X.strip_admin_suffix) == ["江苏", "大兴安岭", "内蒙古自治", "", "市辖", "南京", None]


def test_cell_count(one):
    assert one(["12 (3.0%)", "0 (0.0%)", "7", "x"], X.cell_count) == [12, 0, 7, None]


def test_param_size(one):
    vals = ["DeepSeek-R1-Distill-Qwen-1.5B", "gemma", "qwen2:0.5b", "Qwen-14B"]
    assert one(vals, X.param_size) == [1.5, 0.0, 0.0, 14.0]
    assert one(["qwen2:0.5b"], lambda c: X.param_size(c, case_insensitive=True)) == [0.5]


def test_length(one):
    assert one(["ab", None, "🤦男"], X.text_length) == [2, 3, 2]
    assert one([None], lambda c: X.text_length(c, None)) == [None]


def test_round_half_even_and_cell(spark):
    df = spark.createDataFrame([(1, 3.125, 3), (2, 33.333333, 1), (3, 0.0, 0), (4, 3.0, 12)], "i int, p double, n int")
    rows = df.orderBy("i").select(X.round_half_even(df.p, 2), X.count_pct_cell(df.n, df.p)).collect()
    assert [r[0] for r in rows] == [3.12, 33.33, 0.0, 3.0]
    assert [r[1] for r in rows] == ["3 (3.12%)", "1 (33.33%)", "0 (0.0%)", "12 (3.0%)"]


def test_strip_and_tokens(one):
    assert one(["　 x \t", "a"], X.py_strip) == ["x", "a"]
    assert one(["NA", "", "nan", "ok", None], X.null_tokens) == [None, None, None, "ok", None]


def test_prompt_pieces(spark):
    df = spark.createDataFrame([("Write about [CONDITION] in {{CONDITION}}", "{bg}", "Answer: a.b. c")],
                               "t string, b string, a string")
    filled = X.fill_template(X.fill_template(df.t, "[CONDITION]", F.lit("flu")), "{{CONDITION}}", F.lit("flu"))
    row = df.select(X.assemble_prompt(filled, X.strip_braces(df.b), F.lit("S")).alias("p"),
                    X.cut_at_stop_tokens(df.a, ["."]).alias("s"), X.safe_name(F.lit("org/m:1")).alias("n")).first()
    assert row.p == "Write about flu in flu\nbg\n\nS"
    assert row.s == "Answer: a"
    assert row.n == "org_m_1"


def test_formats(spark):
    row = spark.range(1).select(X.fixed2(F.lit(0.125)).alias("a"), X.sci4(F.lit(1.8397e-19)).alias("b")).first()
    assert row.a == "0.12"
    assert row.b == "1.8397e-19"


def test_fixed2_formats_the_exact_binary_value(spark):
    import random
    rng = random.Random(4)
    values = [n / 3000 for n in range(3001)] + [sum(rng.randint(0, 900) for _ in range(n)) / n for n in range(1, 1001)]
    values += [x / 8 for x in range(-40, 41)] + [x / 1000 for x in range(-2000, 2001)] + [100 * n / 3000 for n in range(0, 3001, 7)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 17) for _ in range(4000)]
    values += [0.0, -0.0, -0.001, 0.995, 0.994999, 1.005, 2.675, 1e15 + 0.125, 4503599627370497.5, 2.0 ** 60, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.fixed2(F.col("x")).alias("o"))
    wrong = [(r.x, r.o, f"{r.x:.2f}") for r in df.collect() if r.o != f"{r.x:.2f}"]
    assert not wrong, wrong[:5]
