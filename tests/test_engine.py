import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from assayer.operators.dependencies import declared, vulnerable
from assayer.operators.joins import authenticate, context_files, first_containing, first_fix, first_refactor
from assayer.operators.secrets import scan_secrets
from assayer.plans.analysis import analysis_tables, analyze, scan_files
from assayer.plans.lifecycle import run_stored, stored
from assayer.plans.serve import dashboard, get_analysis, list_analyses, report_rows, search, severity_histogram
from assayer.schemas import ADVISORIES, ANALYSES, CODE_FILES, USERS
from assayer.sources.code import RemoteReader, parse_repository, read_archive, read_repository, read_tree
from assayer.sources.scratch import scratch_dir
from assayer.sources.store import append, as_json, delete_owned, latest, upsert_users

DAY = datetime.datetime(2024, 1, 1)


def test_dependencies(spark):
    text = json.dumps({"dependencies": {"a": "^1.0.0", "b": "~2"}, "devDependencies": {"b": "3.1", "c": "latest"}})
    files = spark.createDataFrame([("x", "p/package.json", text), ("x", "q/package.json", "{broken"), ("x", "r/package.json", None)], "analysis_id string, path string, content string")
    assert sorted((r.name, r.version) for r in declared(files).collect()) == [("a", "1.0.0"), ("b", "3.1"), ("c", "")]
    known = spark.createDataFrame([("b", "npm", "3.1", 2, "G2", ["C2"]), ("b", "npm", "3.1", 1, "G1", None), ("a", "pypi", "1.0.0", 1, "P", None)], ADVISORIES)
    (row,) = vulnerable(files, known).collect()
    assert row.type == "Vulnerable Dependency (G1)" and "has 2 known" in row.description and row.severity == "high" and row.line_number is None


def _zip(path, names):
    with zipfile.ZipFile(path, "w") as z:
        for n, c in names:
            z.writestr(n, c)


def test_archive(spark, tmp_path):
    names = [("__MACOSX/a.py", "x"), ("d/", ""), ("d/A.PY", b"eval(\xff1)"), ("n.txt", "t")] + [(f"f{k}.js", "a\nb") for k in range(96)] + [("late.py", "x")]
    _zip(tmp_path / "p.zip", names)
    rows = read_archive(spark, str(tmp_path / "p.zip"), "a1").collect()
    assert len(rows) == 97 and {r.path for r in rows if r.language == "python"} == {"d/A.PY"}
    assert next(r.content for r in rows if r.path == "d/A.PY") == "eval(1)"
    with pytest.raises(ValueError):
        read_archive(spark, "x.tar", "a")


def test_tree_caps_after_the_filter(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for k in range(55):
        (tmp_path / "s" / f"{k:02}.py").write_text("x")
        (tmp_path / f"{k:02}.txt").write_text("x")
    (tmp_path / "B.PY").write_text("x")
    assert read_tree(spark, str(tmp_path), "a").count() == 50
    assert read_tree(spark, str(tmp_path), "a", limit=None).count() == 55


def _files(spark):
    rows = [("a", 0, "m.py", "password='x'\nok", "python", 2), ("a", 1, "n.js", "try{}catch(e){}", "javascript", 1), ("c", 0, "z.go", "fine", "go", 1)]
    return spark.createDataFrame(rows, CODE_FILES)


def test_analysis_end_to_end(spark, tmp_path):
    requests = spark.createDataFrame([(i, k, "u", f"Name {i}", "zip", None, DAY) for k, i in enumerate("abc")], "analysis_id string, seq long, user_id string, name string, source_type string, source_url string, created_at timestamp")
    done = analyze(_files(spark), requests, fail_empty=True)
    rows = {r.analysis_id: r for r in done.collect()}
    assert rows["a"].overall_score == 80.0 and rows["a"].metrics.total_lines == 3
    assert [i.type for i in rows["a"].security_issues] == ["Hardcoded password"] and [r.file_path for r in rows["a"].bug_risks] == ["n.js"]
    assert rows["b"].status == "failed" and rows["c"].overall_score == 100.0
    assert [f.name for f in done.schema] == ANALYSES.names
    append(done, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    d = dashboard(stored, "u").first()
    assert (d.total_analyses, d.avg_score, d.total_issues, d.languages) == (2, 90.0, 1, {"python": 2, "javascript": 1, "go": 1})
    none = dashboard(stored, "nobody").first()
    assert (none.total_analyses, none.avg_score, none.total_issues, none.languages) == (0, 0.0, 0, {})
    assert get_analysis(stored, "a", "u").count() == 1 and get_analysis(stored, "a", "v").count() == 0
    assert [r.analysis_id for r in list_analyses(stored, "u").collect()] == ["c", "b", "a"]
    assert search(stored, "name A").count() == 1 and search(stored, "").count() == 3
    assert delete_owned(stored, "a", "u").count() == 2
    with pytest.raises(LookupError):
        delete_owned(stored, "a", "v")
    text = as_json(get_analysis(stored, "a", "u")).first()[0]
    assert json.loads(text)["ai_summary"] and "\n" in text


def test_joins(spark):
    sessions = spark.createDataFrame([("t1", "u1", DAY), ("t2", "u1", datetime.datetime(2099, 1, 1)), ("t3", "gone", datetime.datetime(2099, 1, 1))], "session_token string, user_id string, expires_at timestamp")
    users = spark.createDataFrame([("u1", "e", "n", None, DAY)], USERS)
    assert [r.session_token for r in authenticate(sessions, users).collect()] == ["t2"]
    files = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "seq long, path string")
    issues = spark.createDataFrame([("p0",), ("p1",), ("p2",)], "file_path string")
    risks = spark.createDataFrame([(3, "p3", 9.0), (5, "p5", 9.0), (4, "p4", 1.0)], "seq long, path string, risk_score double")
    assert [r.seq for r in context_files(files, issues, risks).collect()] == [0, 1, 2]
    assert [r.seq for r in context_files(files, issues, risks, by_risk=True).collect()] == [3, 5, 0]
    i = spark.createDataFrame([(1, "f", "A"), (2, "f", "B"), (3, "g", "A")], "issue_id int, file_path string, type string")
    fixes = spark.createDataFrame([(2, "f", "A", None, "late", "x"), (1, "f", None, "A", "early", "y")], "pos int, file_path string, issue_type string, type string, explanation string, fix_code string")
    got = {r.issue_id: r.fix and r.fix.explanation for r in first_fix(i, fixes).collect()}
    assert got == {1: "early", 2: None, 3: None}
    r = spark.createDataFrame([("a", 1, "src/x.py"), ("a", 2, "y.py")], "analysis_id string, seq int, file_path string")
    f = spark.createDataFrame([("a", 5, "x.py", "e5", "c"), ("a", 4, "repo/src/x.py", "e4", "c")], "analysis_id string, pos int, file_path string, explanation string, refined_code string")
    assert {x.seq: x.refactor and x.refactor.explanation for x in first_refactor(r, f).collect()} == {1: "e4", 2: None}


def test_contained_needles(spark):
    texts = ["one two three four five six", "zone two threes", "a b", "", None, "xx one two three four five sixty", "q w"]
    needles = ["ne two three four fi", "two", "b", "e tw", "w", "one two three"]
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid int, needle string")
    got = {r.tid: r.nid for r in first_containing(n, t, "nid", "needle", "tid", "text").collect()}
    want = {k: min(j for j, x in enumerate(needles) if x in s) for k, s in enumerate(texts) if s and any(x in s for x in needles)}
    assert got == want


def test_store(spark):
    v = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "b"), (2, 1, "c", "d")], "k int, v int, x string, y string")
    assert sorted(map(tuple, latest(v, "k", "v").collect())) == [(1, 2, None, "b"), (2, 1, "c", "d")]
    users = spark.createDataFrame([("u1", "e1", "n", "p", DAY), ("u2", "e2", "n", "p", DAY)], USERS)
    new = spark.createDataFrame([(None, "e1", "n2", None, DAY), (None, "e3", "n3", None, DAY)], USERS)
    rows = {r.email: (r.user_id, r.name, r.picture) for r in upsert_users(users, new, F.lit("new")).collect()}
    assert rows == {"e1": ("u1", "n2", None), "e2": ("u2", "n", "p"), "e3": ("new", "n3", None)}


def test_views(spark):
    s = spark.createDataFrame([("high",), ("odd",), (None,)], "severity string")
    assert {r.severity: r.n for r in severity_histogram(s).collect()} == {"critical": 0, "high": 1, "medium": 0, "low": 0, "odd": 1}
    i = spark.createDataFrame([(None, "", None, 0), ("high", "t", "f", 3)], "severity string, type string, file_path string, line_number long")
    assert [tuple(r) for r in report_rows(i).collect()] == [("LOW", "General Issue", "Unknown", "-"), ("HIGH", "t", "f", "3")]


def test_stream_equals_batch(spark, tmp_path):
    from assayer.operators.rules import scan_rules
    from assayer.streaming.ingest import start, stream_files, stream_findings

    files = _files(spark)
    files.write.parquet(str(tmp_path / "in"))
    start(stream_findings(stream_files(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(repr, scan_rules(files).collect()))


class _Fetcher:
    def tree(self, owner, name, branch):
        kinds = [("a.py", "blob"), ("a.PY", "blob"), ("d.py", "tree"), ("no.go", "blob"), (".js", "blob")]
        return None if branch == "main" or name != "n" else [{"path": p, "type": k} for p, k in kinds]

    def raw(self, owner, name, branch, path):
        return "text" if branch == "master" and path == "a.py" else None


def test_remote_tree_with_a_local_fetcher(spark):
    rows = read_repository(spark, "https://github.com/o/n.git", "a1", _Fetcher()).collect()
    assert [tuple(r) for r in rows] == [("a1", 0, "a.py", "text", "python", 1)]
    assert parse_repository("http://github.com/o/x.github.io/tree") == ("o", "xhub.io")
    for bad in ("not-a-url", "", "https://example.com/o/n"):
        with pytest.raises(ValueError):
            read_repository(spark, bad, "a1", _Fetcher())
    for fetcher, name in ((None, "n"), (_Fetcher(), "gone")):
        with pytest.raises(RuntimeError):
            RemoteReader({"owner": "o", "name": name}, fetcher).partitions()


def test_versions_that_are_not_texts_are_skipped(spark):
    text = json.dumps({"dependencies": {"a": {"x": 1}, "b": 2.5, "c": ["1.0"], "d": True, "e": None, "f": "1.0"}, "devDependencies": [1]})
    df = spark.createDataFrame([(text,), ('{"dependencies": "x"}',), ("[1]",), ("",), (None,)], "content string")
    assert [(r.name, r.version) for r in declared(df).collect()] == [("f", "1.0")]


def test_updates_of_one_address_make_one_user(spark):
    users = spark.createDataFrame([("u1", "e1", "n", "p", DAY)], USERS)
    day = lambda k: datetime.datetime(2024, 1, k)
    new = [(None, "e1", "old", None, day(2)), (None, "e1", "new", None, day(3)), (None, "e2", "x", None, day(5)), (None, "e2", "y", "q", day(5)), (None, None, "z", None, day(1))]
    rows = sorted(tuple(r)[:4] for r in upsert_users(users, spark.createDataFrame(new, USERS), F.lit("id")).collect())
    assert rows == [("id", "e2", "y", "q"), ("u1", "e1", "new", None)]


def test_one_scan_and_one_syntax_tree_evaluation(spark, tmp_path):
    _files(spark).write.parquet(str(tmp_path / "f"))
    plan = scan_files(spark.read.schema(CODE_FILES).parquet(str(tmp_path / "f")), secrets=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan


def test_documents_hold_the_first_findings_and_all_counts(spark, monkeypatch):
    monkeypatch.setattr("assayer.plans.analysis.HEAD", 3)
    files = spark.createDataFrame([("a", k, f"f{k}.js", "eval(x)\n" * 2, "javascript", 3) for k in range(5)], CODE_FILES)
    requests = spark.createDataFrame([("a", 1, "u", "n", "zip", None, DAY)], "analysis_id string, seq long, user_id string, name string, source_type string, source_url string, created_at timestamp")
    out = analysis_tables(files, requests)
    row = out.documents.first()
    assert [(i.file_path, i.line_number) for i in row.security_issues] == [("f0.js", 1), ("f0.js", 2), ("f1.js", 1)]
    assert (row.n_issues, row.n_risks, row.overall_score, out.issues.count()) == (10, 0, 0.0, 10)
    assert "WindowGroupLimit" in out.documents._jdf.queryExecution().executedPlan().toString()


def test_runs_are_stored_as_versions(spark, tmp_path):
    requests = spark.createDataFrame([("a", 1, "u", "n", "zip", None, DAY)], "analysis_id string, seq long, user_id string, name string, source_type string, source_url string, created_at timestamp")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert run_stored(spark, good, requests, lambda r: analyze(_files(spark), r)) == "completed"
    assert [(r.status, r.overall_score) for r in stored(spark, good).collect()] == [("completed", 80.0)]

    def broken(_):
        raise RuntimeError("no access")

    assert run_stored(spark, bad, requests, broken) == "failed"
    (row,) = stored(spark, bad).collect()
    assert (row.status, row.ai_summary, row.security_issues) == ("failed", "no access", [])
    assert sorted(r.status for r in spark.read.parquet(bad).collect()) == ["failed", "processing"]


def test_secret_rules_of_code(spark):
    key = "AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [("a", key), ("b", "bearer " + "x" * 20), ("c", "-----BEGIN RSA PRIVATE KEY-----"), ("d", "sk_live_" + "a1" * 12), ("e", "plain"), ("f", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    assert {r.path: r.severity for r in scan_secrets(df).collect()} == {"a": "critical", "b": "high", "c": "critical", "d": "critical"}


def test_needles_meet_texts_by_equality(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, x string")
    plan = first_containing(df, df.withColumnsRenamed({"id": "t", "x": "y"}), "id", "x", "t", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 5 and all("(_" in line or "=" in line for line in plan.splitlines() if "Join Inner" in line)


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError):
        scratch_dir(Session())


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from assayer.streaming.ingest import windowed_counts

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([(at(1), "low"), (at(2), "low"), (at(7), "low"), (at(8), "high")], "time timestamp, severity string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "time")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.window.start.minute, r.severity, r.n) for r in spark.table("counted").collect())
    assert got == [(0, "low", 2), (5, "high", 1), (5, "low", 1)]


def test_broken_archives_are_skipped(spark):
    from assayer.sources.code import archive_entries

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.py", "1")
    df = spark.createDataFrame([("x", bytearray(b"no zip")), ("y", bytearray(buffer.getvalue()))], "path string, content binary")
    assert [tuple(r) for r in archive_entries(df).collect()] == [("y", 0, "a.py", "1")]
