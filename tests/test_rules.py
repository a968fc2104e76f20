import random
import re

import pytest

from assayer.operators.rules import RULES, explode_lines, scan_rules

CASES = [
    ("x = eval (a)", ["R1"]), ("retrieval(x)", ["R1"]), ("EXEC(cmd)", ["R2"]), ("PASSWORD = 'p'", ["R3"]), ("password = ''", []),
    ('api-key="k"', ["R4"]), ("apiKey: 'k'", []), ("client_secret='s'", ["R5"]), ("# todo later", ["R6"]), ("mastodon", ["R6"]),
    ("console.log(1); debugger", ["R7", "R8"]), ("pickle.loads(b)", ["R9"]), ("subprocess.call(c, shell = True)", ["R10"]),
    ("subprocess.call(c)", []), ("os.system('ls')", ["R11"]), ("sql = a + b", []), ("sql = a + b + c", ["R12"]), ("el.innerHTML = h", ["R13"]),
    ("password='x'; secret='y'", ["R3", "R5"]), ("eval (a)", ["R1"]), ("plain", []), ("", []),
]


def test_catalog_cases(spark):
    files = spark.createDataFrame([(k, f"f{k}.py", line) for k, (line, _) in enumerate(CASES)], "seq int, path string, content string")
    found = {}
    for r in scan_rules(files).collect():
        found.setdefault(r.seq, []).append(r.rule_id)
        assert r.line_number == 1 and r.description == "Found: " + CASES[r.seq][0].strip()[:100]
    for k, (line, rules) in enumerate(CASES):
        assert sorted(found.get(k, [])) == sorted(rules), line


def test_against_python_on_random_lines(spark):
    rng = random.Random(5)
    parts = ["eval", "(", " ", "\t", "password", "=", "'", '"', "x", "SQL", "+", "TODO", "é", "ſ", "K", " ", "\r", "shell=True", "subprocess.call(", "innerHTML"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    files = spark.createDataFrame([(1, "a", "\n".join(lines))], "seq int, path string, content string")
    got = {(r.line_number, r.rule_id) for r in scan_rules(files).collect()}
    want = {(k, r.rule_id) for k, line in enumerate(lines, 1) for r in RULES if re.search(r.pattern, line, re.IGNORECASE)}
    assert got == want


def test_lines_keep_carriage_returns_and_empties(spark):
    df = spark.createDataFrame([(1, "a\r\n\nb\n"), (2, "")], "seq int, content string")
    rows = sorted(map(tuple, explode_lines(df).collect()))
    assert rows == [(1, 1, "a\r"), (1, 2, ""), (1, 3, "b"), (1, 4, ""), (2, 1, "")]


def test_repartitioning_changes_nothing(spark):
    files = spark.createDataFrame([(k, f"f{k}", CASES[k % len(CASES)][0]) for k in range(60)], "seq int, path string, content string")
    a, b = (sorted(map(tuple, scan_rules(f).collect())) for f in (files.repartition(1), files.repartition(7)))
    assert a == b


def test_plan_has_no_join_and_no_python(spark):
    files = spark.createDataFrame([(1, "a", "b")], "seq int, path string, content string")
    plan = scan_rules(files)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("path,language", [("a/b.PY", "python"), ("x.tsx", "typescript"), ("Makefile", "unknown"), (".py", "unknown"), ("a.b/c", "unknown"), ("k.kt", "kotlin")])
def test_language(spark, path, language):
    from pyspark.sql import functions as F

    from assayer.functions.text import language_of

    assert spark.range(1).select(language_of(F.lit(path))).first()[0] == language
