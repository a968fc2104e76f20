import pytest
from pyspark.sql import functions as F

from assayer.functions.text import clean_version, half_even, repository_of, strip
from assayer.operators.risk import bug_risk
from assayer.operators.rollup import roll_up

DEF = "def f():\n    pass\n"
CASES = [
    ("", "js", 0, "low"), ("\n" * 199, "js", 0, "low"), ("\n" * 200, "js", 10, "low"), ("\n" * 500, "js", 20, "low"),
    (DEF * 10, "python", 0, "low"), (DEF * 11, "python", 15, "low"), (DEF * 16, "python", 25, "low"), (DEF * 21, "python", 40, "medium"),
    (("async " + DEF) * 21, "python", 0, "low"), ("def (", "python", 0, "low"), (DEF * 21, "js", 0, "low"),
    ("\n".join(["x" * 121] * 10), "js", 0, "low"), ("\n".join(["x" * 121] * 11), "js", 10, "low"), ("\n".join(["x" * 120] * 11), "js", 0, "low"),
    ("\r\n".join(["x" * 120] * 12), "js", 10, "low"), ("TODO\n" * 5, "js", 0, "low"), ("TODO\n" * 6, "js", 15, "low"), ("todo\n" * 6, "js", 0, "low"),
    ("try{a}catch(e){ }", "js", 20, "low"), ("try:\n x\nexcept:\n pass", "js", 20, "low"), ("except Exception: pass", "js", 0, "low"),
    (DEF * 21 + "# TODO\n" * 6 + "\n".join(["#" + "x" * 121] * 11) + "\n" * 500 + "#except: pass", "python", 100, "high"),
]


def test_scores(spark):
    df = spark.createDataFrame([(k, c, lang) for k, (c, lang, _, _) in enumerate(CASES)], "seq int, content string, language string")
    for r in bug_risk(df).collect():
        assert (r.risk_score, r.complexity) == CASES[r.seq][2:], (r.seq, r.issues)


@pytest.mark.parametrize(
    "risks,bad,expect",
    [([], 0, (100, 0, 100)), ([10], 0, (95, 10, 90)), ([10, 20, 45], 2, (67.5, 25, 75)), ([100], 10, (0, 100, 0)), ([5] * 7 + [10], 0, (97.19, 5.62, 94.38)), ([10, 10, 15], 1, (84.17, 11.67, 88.33))],
)
def test_roll_up(spark, risks, bad, expect):
    files = spark.createDataFrame([("a", "python", 3), ("a", "go", 4)], "analysis_id string, language string, lines long")
    issues = spark.createDataFrame([("a", "high")] * bad + [("a", "low")], "analysis_id string, severity string")
    at_risk = spark.createDataFrame([("a", float(r)) for r in risks] + [("a", 0.0)], "analysis_id string, risk_score double")
    r = roll_up(files, issues, at_risk).first()
    got = (r.overall_score, r.metrics.avg_complexity, r.metrics.maintainability_index)
    assert got == pytest.approx(expect, abs=0.0101)
    assert r.metrics.languages == {"python": 3, "go": 4} and r.metrics.total_lines == 7 and r.metrics.total_files == 2


def test_half_even(spark):
    rows = spark.createDataFrame([(45, 8), (1, 3), (0, 7), (9, 8)], "n long, d long").select(half_even(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in rows] == [5.62, 0.33, 0.0, 1.12]


@pytest.mark.parametrize("raw,clean", [("^1.2.3", "1.2.3"), ("~0.4", "0.4"), ("1.x", "1."), (">=1.0 <2.0", "1.02.0"), ("workspace:*", ""), ("^1.2.3-beta.4", "1.2.3.4"), ("npm:foo@1.2.0", "1.2.0"), ("latest", "")])
def test_versions(spark, raw, clean):
    assert spark.range(1).select(clean_version(F.lit(raw))).first()[0] == clean


def test_text_functions(spark):
    row = spark.range(1).select(
        strip(F.lit("  a b\t")).alias("s"), repository_of(F.lit("https://github.com/o/x.github.io")).alias("f"),
        repository_of(F.lit("https://github.com/o/x.github.io.git/tree"), faithful=False).alias("g"), repository_of(F.lit("not-a-url")).alias("n"),
    ).first()
    assert tuple(row) == ("a b", "o/xhub.io", "o/x.github.io", None)
