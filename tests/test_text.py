from pyspark.sql import functions as F

from tracepairs.functions import arrays as A
from tracepairs.functions import text as T


def _apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", f(F.col("t"))).collect())]


def test_steps_by_each_way(spark):
    got = _apply(spark, T.split_steps, ["1. add 2\n2. get 4", "Step 1: add 2 Step 2: get 4", "one line\n\n another ", "First this. Then that! Done", "just one", "", None])
    assert got == [["add 2", "get 4"], ["add 2", "get 4"], ["one line", "another"], ["First this.", "Then that!", "Done"], ["just one"], [], []]


def test_canonical_form(spark):
    got = _apply(spark, T.canon, ["Step 3: Add,  2 + 2!", "a , b", "hello !", "1. keep", "É (x)"])
    assert got == ["add 2 + 2", "a  b", "hello ", "1. keep", "é x"]


def test_final_answers(spark):
    got = _apply(spark, T.extract_final_answer, [r"so \boxed{ 12 } and \boxed{7}", "The answer is 5. 9", "costs 54,000", "no number\nlast line ", "   "])
    assert got == ["7", "5", "000", "last line", None]
    assert _apply(spark, T.normalize_answer, [" 1,200.00", "1.50", "+5", "A  B"]) == ["1200", "1.50", "+5", "a b"]


def test_dataset_answers(spark):
    got = _apply(spark, T.gsm8k_answer, ["think\n#### 1,234", "about 2,500 or 3,000.5 so", "none", "#### 7"])
    assert [tuple(x) for x in got] == [("think", "1234"), (None, "3000.5"), (None, "none"), (None, "7")]


def test_first_divergence(spark):
    rows = [(["a", "b"], ["a", "c"]), (["a", "b"], ["a"]), (["a"], ["a"]), ([], ["a"]), ([], [])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = [r.k for r in df.select("i", A.first_divergence(F.col("a"), F.col("b")).alias("k")).orderBy("i").collect()]
    assert got == [1, 1, None, 0, None]


def test_reward_uses_the_last_marked_position(spark):
    df = spark.sql("SELECT array(array(0D, 0D), array(0D, 1D), array(9D, 0D)) AS l, array(1, 1, 0) AS m, array(0, 0, 0) AS none")
    a, b = df.select(A.process_reward(F.col("l"), F.col("m")), A.process_reward(F.col("l"), F.col("none"))).first()
    assert abs(a - 0.7310586) < 1e-6 and b == 0.0


def test_prefixes_and_schedule(spark):
    df = spark.sql("SELECT array('a', 'b') AS s UNION ALL SELECT cast(array() AS array<string>)")
    assert sorted(r[0] for r in df.select(T.cumulative_prefixes(F.col("s"))).collect()) == [[], ["a", "a\nb"]]
    assert A.schedule_steps(10, 4, 2, 0.25) == (6, 1)


def test_texts_for_verifiers(spark):
    row = spark.createDataFrame([("2 {prefix}?", "a\n\nb {prompt}")], "p string, x string")
    p, x = F.col("p"), F.col("x")
    assert row.select(T.judge_prompt("Q: {prompt} S: {prefix} {other}", p, x)).first()[0] == "Q: 2 {prefix}? S: a\n\nb {prompt} {other}"
    assert row.select(T.log_prob_text(p, x)).first()[0] == "Question:\n2 {prefix}?\n\nPartial solution:\na\n\nb {prompt}"
    turns = T.reward_turns(p, x, "be good", "<s>")
    assert [tuple(t) for t in row.select(turns).first()[0]] == [("system", "be good"), ("user", "2 {prefix}?"), ("assistant", "a<s>b {prompt}<s>")]
    assert row.select(T.reward_text(turns)).first()[0] == "be good\n\nQuestion:\n2 {prefix}?\n\nPartial solution:\na<s>b {prompt}<s>"


def test_loss_of_tokens(spark):
    """The penalty counts for light pairs only, and not without lambda."""
    row = spark.createDataFrame([([-1.0, -2.0], [-1.0], [-1.5, -2.5], [-3.0])], "p array<double>, d array<double>, rp array<double>, rd array<double>")
    loss = lambda w, lam: row.select(A.token_loss_terms(*map(F.col, ("p", "d", "rp", "rd")), F.lit(w), beta=0.2, lambda_ref=lam).alias("t")).first().t
    import math

    delta = (-3.0 + 1.0) - (-4.0 + 3.0)
    term = math.log1p(math.exp(-0.2 * delta))
    assert abs(loss(0.4, 0.1).loss - (0.4 * term + 0.1 * 0.6 * 0.5 * (0.25 + 4.0))) < 1e-12
    assert loss(1.0, 0.1).loss == loss(1.0, 0.0).loss and abs(loss(0.4, 0.0).loss - 0.4 * term) < 1e-12 and abs(loss(0.4, 0.1).delta - delta) < 1e-12
