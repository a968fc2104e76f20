"""Registered queries of the engine's operators, each with its SQL.

The driver's tables hold no source code, so each query binds an operator to a
table of the same shape; whole tables are read. A limit stands only where it is
the operator: lists, dashboards, top-k and context cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.ast_counts import python_counts
from .functions.text import (
    archive_name, clean_version, contains_ignoring_case, expires_at, first_word, is_repository_url, language_of, line_count, lines_of, lookup, megabytes,
    random_id, repository_of, score_band, string_map, suffix, utc_timestamp,
)
from .operators import joins
from .operators.dependencies import declared, vulnerable
from .operators.findings import FIELDS, union_findings
from .operators.joins import authenticate, context_files, first_containing, first_refactor, risks_in_context, top_risks
from .operators.risk import bug_risk
from .operators.rollup import language_map, merge_language_maps, roll_up
from .operators.rules import RULES, Rule, explode_lines, hits, scan_rules
from .operators.secrets import scan_secrets
from .plans import enrichment, lifecycle, serve
from .plans.analysis import analysis_tables, analyze
from .plans.serve import language_rows, search, severity_counts, severity_histogram, severity_rows
from .schemas import ANALYSES
from .sources.code import archive_files, manifests, read_repository
from .sources.store import as_json, delete, latest, open_session, upsert_users

#: Rules that do fire on the driver's documents, beside the catalog.
STAND_INS = (
    Rule("S1", "license", "License line", "low", "Check the licence"),
    Rule("S2", r'token\s*=\s*"[^"]+"', "Hardcoded token", "high", "Use environment variables for tokens"),
)
REGIONS = {"0": "AFRICA", "1": "AMERICA", "2": "ASIA"}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of code that set off the rules, one each, and one that holds a key.
SAMPLES = (
    "x = eval (a)", "EXEC(cmd)", "PASSWORD = 'p'", 'api-key="k"', "client_secret='s'", "# todo later", "console.log(1); debugger", "debugger",
    "pickle.loads(b)", "subprocess.call(c, shell = True)", "os.system('ls')", "sql = a + b + c", "el.innerHTML = h", "k = AKIA" + "ABCDEFGHIJKLMNOP",
)


def _lit(s: str) -> str:
    """An SQL literal for DuckDB, line breaks included."""
    return "E'" + s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code files of one analysis per source, in six kinds by id, so that every signal and rule fires."""
    k, text = F.expr("doc_id div 6"), F.coalesce("text", F.lit(""))
    times = lambda s, n: F.repeat(F.lit(s), n.cast("int"))
    manifest = F.concat(F.lit('{"dependencies": {"pkg": "^'), k % 20, F.lit('.0", "x": 1}, "devDependencies": {"dev": "~1.'), k % 7, F.lit('", "pkg'), k % 2, F.lit('": "2.0"}}'))
    kinds = [
        (".py", F.concat(times("def f():\n    pass\n", k % 25), F.lit("class A: pass"))), (".js", F.concat(text, times("\n# TODO fix", k % 9))),
        (".js", F.concat(text, F.lit("\ntry{a}catch(e){ }"))), (".go", F.concat(text, times("\n", (k % 7) * 100))),
        (".TS", F.concat(text, F.lit("\n"), F.get(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES)).cast("int")))), ("/package.json", manifest),
    ]
    pick = lambda at: F.element_at(F.array(*[x[at] if at else F.lit(x[0]) for x in kinds]), (F.col("doc_id") % 6 + 1).cast("int"))
    content = F.when(F.lit(False), F.lit(""))
    for n, (_, c) in enumerate(kinds):
        content = content.when(F.col("doc_id") % 6 == n, c)
    path = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), pick(0))
    rows = t(spark, sf_dir, "documents").select(F.col("source").alias("analysis_id"), F.col("doc_id").alias("seq"), path.alias("path"), content.alias("content"))
    return rows.select("*", language_of(F.col("path")).alias("language"), line_count(F.col("content")).alias("lines"))


_SAMPLE_LIST = "[" + ", ".join(_lit(x) for x in SAMPLES) + "]"
#: The same files in SQL: k, kind, path, content, language and what the signals count.
_FILES = f"""f0 AS (SELECT source AS analysis_id, doc_id AS seq, doc_id // 6 AS k, doc_id % 6 AS kind, coalesce(text, '') AS t FROM documents),
f1 AS (SELECT *, 'src/d' || seq || CASE kind WHEN 0 THEN '.py' WHEN 3 THEN '.go' WHEN 4 THEN '.TS' WHEN 5 THEN '/package.json' ELSE '.js' END AS path,
 CASE kind WHEN 0 THEN 'python' WHEN 3 THEN 'go' WHEN 4 THEN 'typescript' WHEN 5 THEN 'json' ELSE 'javascript' END AS language,
 CASE kind WHEN 0 THEN repeat({_lit(chr(100) + "ef f():" + chr(10) + "    pass" + chr(10))}, k % 25) || 'class A: pass' WHEN 1 THEN t || repeat({_lit(chr(10) + "# TODO fix")}, k % 9)
 WHEN 2 THEN t || {_lit(chr(10) + "try{a}catch(e){ }")} WHEN 3 THEN t || repeat({_lit(chr(10))}, (k % 7) * 100) WHEN 4 THEN t || chr(10) || {_SAMPLE_LIST}[k % {len(SAMPLES)} + 1]
 ELSE '{{"dependencies": {{"pkg": "^' || (k % 20) || '.0", "x": 1}}, "devDependencies": {{"dev": "~1.' || (k % 7) || '", "pkg' || (k % 2) || '": "2.0"}}}}' END AS content FROM f0),
files AS (SELECT *, string_split(content, chr(10)) AS ls, CAST(len(string_split(content, chr(10))) AS BIGINT) AS lines, CASE kind WHEN 0 THEN k % 25 ELSE 0 END AS fn FROM f1),
signals AS (SELECT *, len(list_filter(ls, lambda x: length(x) > 120)) AS long_lines, len(list_filter(ls, lambda x: contains(x, 'TODO') OR contains(x, 'FIXME'))) AS todos,
 len(regexp_extract_all(content, 'except\\s*:\\s*pass|catch\\s*\\([^)]*\\)\\s*\\{{\\s*\\}}')) AS handlers FROM files),
scored AS (SELECT *, CASE WHEN lines > 500 THEN 20 WHEN lines > 200 THEN 10 ELSE 0 END + CASE WHEN fn > 20 THEN 30 WHEN fn > 10 THEN 15 ELSE 0 END + CASE WHEN fn > 15 THEN 10 ELSE 0 END
 + CASE WHEN long_lines > 10 THEN 10 ELSE 0 END + CASE WHEN todos > 5 THEN 15 ELSE 0 END + CASE WHEN handlers > 0 THEN 20 ELSE 0 END AS score FROM signals),
risks AS (SELECT *, CAST(least(score, 100) AS DOUBLE) AS risk_score, CASE WHEN score > 50 THEN 'high' WHEN score > 25 THEN 'medium' ELSE 'low' END AS complexity,
 concat_ws('; ', CASE WHEN lines > 500 THEN 'File is too large (>500 lines)' WHEN lines > 200 THEN 'File is moderately large (>200 lines)' END,
 CASE WHEN fn > 20 THEN 'High cyclomatic complexity' END, CASE WHEN fn > 15 THEN 'Too many functions in one file' END,
 CASE WHEN long_lines > 10 THEN long_lines || ' lines exceed 120 characters' END, CASE WHEN todos > 5 THEN todos || ' TODO/FIXME comments found' END,
 CASE WHEN handlers > 0 THEN handlers || ' empty exception handlers' END) AS issues FROM scored)"""


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored analyses, one user per order status."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    upto = lambda n: F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, n.cast("int"))
    severity = lambda i: lookup(((key + i) % 5).cast("string"), {"0": "critical", "1": "high", "2": "medium", "3": "low"}, "odd")
    name = lambda c, i: F.concat(F.lit(c), i.cast("string"))
    issue = lambda i: F.struct(severity(i), name("T", i), F.lit("d"), name("f", i), i.cast("long"), F.lit("r"))
    risk = lambda i: F.struct(name("f", i), ((key * i) % 21 * 5).cast("double"), F.lit("low"), F.array().cast("array<string>"))
    text = lambda *xs: F.struct(*[F.lit(x).cast("string") for x in xs])
    complexity = (key % 2000) / F.lit(10.0)
    value = {
        "analysis_id": F.concat(F.lit("analysis_"), key.cast("string")), "seq": key, "user_id": F.col("o_orderstatus"), "name": F.col("o_orderpriority"), "source_type": F.lit("remote"),
        "source_url": F.when(cust % 3 != 0, F.concat(F.lit("https://host/o"), cust.cast("string"))), "status": lookup((key % 7).cast("string"), {"0": "failed", "1": "processing"}, "completed"),
        "created_at": F.col("o_orderdate"), "completed_at": F.col("o_orderdate"),
        "metrics": F.struct(cust, key * 13, F.create_map(F.lit("python"), key % 10, F.lit("go"), cust % 10), complexity, F.greatest(F.lit(0.0), 100 - complexity)),
        "security_issues": F.transform(upto(key % 4), issue), "bug_risks": F.transform(upto(cust % 3 + 1), risk), "n_issues": key % 4, "n_risks": cust % 3 + 1,
        "overall_score": key % 101, "recommendations": F.array(),
        "ai_fixes": F.array(text("f1", "T1", None, "e1", "c1"), text("f2", None, "T2", "e2", "c2"), text("f1", "T1", None, "late", "x")),
        "ai_refactors": F.array(text("src/f1", "n1", "c1"), text("f", "n2", "c2")),
    }
    orders = t(spark, sf_dir, "orders").withColumn("_id", F.uuid())
    return orders.select("_id", *[value.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ANALYSES])


_ANALYSES = """a AS (SELECT *, 'analysis_' || o_orderkey AS analysis_id, o_orderkey AS seq, o_orderstatus AS user_id, o_orderpriority AS name, o_orderdate AS created_at,
 CASE WHEN o_custkey % 3 <> 0 THEN 'https://host/o' || o_custkey END AS source_url, CASE o_orderkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' ELSE 'completed' END AS status,
 o_orderkey % 4 AS n_issues, o_custkey % 3 + 1 AS n_risks, CAST(o_orderkey % 101 AS DOUBLE) AS overall_score, (o_orderkey % 2000) / 10.0::DOUBLE AS complexity FROM orders),
ai AS (SELECT *, CASE (seq + i) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS severity FROM a, unnest(range(1, 4)) AS u(i) WHERE i <= n_issues),
ar AS (SELECT *, CAST((seq * i) % 21 * 5 AS DOUBLE) AS risk_score FROM a, unnest(range(1, 4)) AS u(i) WHERE i <= n_risks)"""


_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("""SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, count(*) AS n_docs,
CAST(max(len(string_split(text, chr(10)))) AS BIGINT) AS max_ordinal FROM documents GROUP BY lang""")
def line_explode_stats(spark, sf_dir):
    lines = explode_lines(t(spark, sf_dir, "documents").select("lang", "text"), "text")
    return lines.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(F.col("line_number") == 1).alias("n_docs"), F.max("line_number").alias("max_ordinal"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CATALOG = ", ".join(f"({_quoted(r.rule_id)}, {_quoted(r.type)}, {_quoted(r.severity)}, {_quoted(r.pattern)})" for r in RULES + STAND_INS)
_HITS = " UNION ALL ".join(f"SELECT {_quoted(r.rule_id)} AS rule_id, doc_id FROM l WHERE regexp_matches(line, {_quoted(r.pattern)}, 'i')" for r in RULES + STAND_INS)


@query(f"""WITH {_FILES}, l AS (SELECT seq AS doc_id, unnest(ls) AS line FROM files), h AS ({_HITS}), r(rule_id, type, severity, pattern) AS (VALUES {_CATALOG})
SELECT r.rule_id, r.type, r.severity, count(h.doc_id) AS n_hits, count(DISTINCT h.doc_id) AS n_docs
FROM r LEFT JOIN h USING (rule_id) GROUP BY ALL""")
def rule_hit_catalog(spark, sf_dir):
    per_file = scan_rules(_files(spark, sf_dir).select("seq", "path", "content"), RULES + STAND_INS).groupBy("rule_id", "seq").agg(F.count("*").alias("n"))
    found = per_file.groupBy("rule_id").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_docs"))
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity")) for r in RULES + STAND_INS])
    catalog = spark.range(1).select(F.inline(rows))
    return catalog.join(found, "rule_id", "left").fillna(0, ["n_hits", "n_docs"])


@query(f"""WITH {_FILES} SELECT seq AS doc_id, risk_score, complexity, issues FROM risks""")
def file_risk(spark, sf_dir):
    risks = bug_risk(_files(spark, sf_dir))
    return risks.select(F.col("seq").alias("doc_id"), "risk_score", "complexity", F.concat_ws("; ", "issues").alias("issues"))


@query(f"""WITH {_FILES} SELECT analysis_id, language, CAST(sum(lines) AS BIGINT) AS lines FROM files GROUP BY ALL""")
def language_lines(spark, sf_dir):
    return language_map(_files(spark, sf_dir)).select("analysis_id", F.explode("languages").alias("language", "lines"))


_HALF_EVEN = "(({n}) * 100 // ({d}) + CASE WHEN 2 * (({n}) * 100 % ({d})) > ({d}) OR (2 * (({n}) * 100 % ({d})) = ({d}) AND ({n}) * 100 // ({d}) % 2 = 1) THEN 1 ELSE 0 END) / 100.0"


_TOTALS = f"""SELECT analysis_id, count(*) AS total_files, CAST(sum(lines) AS BIGINT) AS total_lines, count(DISTINCT language) AS n_languages,
 CAST(sum(risk_score) AS BIGINT) AS num, greatest(CAST(count(*) FILTER (risk_score > 0) AS BIGINT), 1) AS den FROM risks GROUP BY analysis_id"""
_SCORES = f"""CAST({_HALF_EVEN.format(n='num', d='den')} AS DOUBLE) AS avg_complexity,
CAST({_HALF_EVEN.format(n='100 * den - num', d='den')} AS DOUBLE) AS maintainability_index,
CAST({_HALF_EVEN.format(n='greatest(200 * den - 20 * pen * den - num, 0)', d='2 * den')} AS DOUBLE) AS overall_score"""


@query(f"""WITH {_FILES}, s AS ({_TOTALS}), i AS (SELECT source AS analysis_id, count(*) AS pen FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0 GROUP BY ALL),
j AS (SELECT s.*, coalesce(pen, 0) AS pen FROM s LEFT JOIN i USING (analysis_id))
SELECT analysis_id, total_files, total_lines, n_languages, {_SCORES} FROM j""")
def repo_rollup(spark, sf_dir):
    files = _files(spark, sf_dir)
    severity = F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "critical").otherwise("low")
    owners = files.select("analysis_id", F.col("seq").alias("doc_id"))
    issues = t(spark, sf_dir, "labels").join(owners, "doc_id").select("analysis_id", severity.alias("severity"))
    out = roll_up(files, issues, bug_risk(files))
    return out.select("analysis_id", "metrics.total_files", "metrics.total_lines", F.size("metrics.languages").cast("long").alias("n_languages"), "metrics.avg_complexity", "metrics.maintainability_index", "overall_score")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT 'long' AS type, doc_id, length(line) AS size, 0 AS source_rank FROM l WHERE length(line) > 120
UNION ALL SELECT 'token', doc_id, length(line), 1 FROM l WHERE regexp_matches(line, {_quoted(STAND_INS[1].pattern)}, 'i')
UNION ALL SELECT 'license', doc_id, length(line), 2 FROM l WHERE regexp_matches(line, 'license', 'i'))
SELECT source_rank, type, doc_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS chars FROM f GROUP BY ALL""")
def findings_union(spark, sf_dir):
    lines = explode_lines(t(spark, sf_dir, "documents").select("doc_id", "text"), "text").select(F.col("doc_id").alias("seq"), "line", "line_number")

    def stream(kind, condition):
        fixed = {"severity": F.lit("low"), "type": F.lit(kind), "description": F.col("line"), "file_path": F.col("seq").cast("string"), "line_number": F.col("line_number"), "recommendation": F.lit("")}
        return lines.where(condition).select("seq", *[fixed[f].alias(f) for f in FIELDS])

    found = union_findings(
        stream("long", F.length("line") > 120), stream("token", F.size(hits(F.col("line"), STAND_INS[1:])) > 0),
        stream("license", F.size(hits(F.col("line"), STAND_INS[:1])) > 0), keys=("seq",),
    )
    return found.groupBy("source_rank", "type", F.col("seq").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.length("description")).alias("chars"))


@query(f"WITH {_ANALYSES} SELECT analysis_id, name, status, created_at FROM a WHERE user_id = 'F' ORDER BY created_at DESC, seq DESC LIMIT 100")
def analysis_list(spark, sf_dir):
    return serve.list_analyses(_analyses(spark, sf_dir), "F").select("analysis_id", "name", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query(f"""WITH {_ANALYSES} SELECT analysis_id, user_id, name, status, n_issues, false AS has_store_id FROM a
WHERE (seq, user_id) IN ((1, 'F'), (1, 'O'), (1, 'P'), (7, 'F'), (7, 'O'), (7, 'P'), (-1, 'F'))""")
def analysis_detail(spark, sf_dir):
    rows = _analyses(spark, sf_dir)
    wanted = [("analysis_1", u) for u in "FOP"] + [("analysis_7", u) for u in "FOP"] + [("analysis_-1", "F")]
    found = reduce(DataFrame.unionByName, [serve.get_analysis(rows, i, u) for i, u in wanted])
    return found.select("analysis_id", "user_id", "name", "status", "n_issues", F.lit("_id" in found.columns).alias("has_store_id"))


@query(f"WITH {_ANALYSES} SELECT analysis_id, source_url FROM a WHERE contains(lower(name), 'o13') OR coalesce(contains(lower(source_url), 'o13'), false)")
def analysis_search(spark, sf_dir):
    return search(_analyses(spark, sf_dir), "O13").select("analysis_id", "source_url")


_COVERED = "SELECT * FROM a WHERE user_id = 'O' AND status = 'completed' ORDER BY seq LIMIT {n}"


@query(f"""WITH {_ANALYSES}, d AS ({_COVERED.format(n=100)}) SELECT count(*) AS total_analyses, round_even(avg(overall_score), 2) AS avg_score,
CAST(sum(n_issues) AS BIGINT) AS total_issues, CAST(sum(seq % 10) AS BIGINT) AS python, CAST(sum(o_custkey % 10) AS BIGINT) AS go FROM d""")
def dashboard_stats(spark, sf_dir):
    out = serve.dashboard(_analyses(spark, sf_dir), "O")
    return out.select("total_analyses", "avg_score", "total_issues", *[F.col("languages")[k].alias(k) for k in ("python", "go")])


@query("SELECT 0::BIGINT AS total_analyses, 0.0::DOUBLE AS avg_score, 0::BIGINT AS total_issues, 0 AS n_languages, 0::BIGINT AS n_risks")
def dashboard_empty(spark, sf_dir):
    rows = _analyses(spark, sf_dir)
    out = serve.dashboard(rows, "nobody").join(serve.recent_risks(rows, "nobody"))  # one row by one row
    return out.select("total_analyses", "avg_score", "total_issues", F.size("languages").alias("n_languages"), "n_risks")


@query(f"""WITH {_ANALYSES}, d AS ({_COVERED.format(n=5)}), h AS (SELECT severity, count(*) AS n FROM ai SEMI JOIN d USING (seq) GROUP BY severity)
SELECT severity, coalesce(n, 0) AS n FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) FULL JOIN h USING (severity)""")
def dashboard_recent(spark, sf_dir):
    return serve.recent_severities(_analyses(spark, sf_dir), "O")


@query(f"WITH {_ANALYSES}, d AS ({_COVERED.format(n=5)}) SELECT CAST(sum(n_risks) AS BIGINT) AS n_risks FROM d")
def dashboard_risks(spark, sf_dir):
    return serve.recent_risks(_analyses(spark, sf_dir), "O")


@query(f"""WITH {_ANALYSES} SELECT analysis_id, n_issues, n_risks, CAST(CAST(overall_score AS INT) AS VARCHAR) AS score,
CASE WHEN overall_score >= 80 THEN 'good' WHEN overall_score >= 60 THEN 'fair' ELSE 'poor' END AS band, format('{{:,}}', seq * 13) AS lines,
CAST(complexity AS DECIMAL(9, 1))::VARCHAR AS complexity, least(complexity, 100) AS complexity_bar, CAST(floor(greatest(0, 100 - complexity) + 0.5) AS INT) || '%' AS maintainability,
strftime(created_at, '%-m/%-d/%Y') AS date, strftime(created_at, '%-m/%-d/%Y, %-I:%M:%S %p') AS time FROM a""")
def analysis_cards(spark, sf_dir):
    return serve.cards(_analyses(spark, sf_dir))


@query(f"""WITH {_ANALYSES} SELECT analysis_id, CAST(i - 1 AS INT) AS pos, severity, 'T' || i AS type, 'd' AS description, 'f' || i AS file_path, i AS line_number, 'r' AS recommendation,
CASE i WHEN 1 THEN 'e1' WHEN 2 THEN 'e2' END AS fix, CASE i WHEN 1 THEN 'c1' WHEN 2 THEN 'c2' END AS fix_code FROM ai""")
def detail_issues(spark, sf_dir):
    return serve.detail_issues(_analyses(spark, sf_dir))


@query(f"""WITH {_ANALYSES} SELECT analysis_id, CAST(row_number() OVER (PARTITION BY seq ORDER BY risk_score DESC, i) - 1 AS INT) AS place, 'f' || i AS file_path, risk_score, 'low' AS complexity,
CAST(risk_score AS INT) || '%' AS score, CASE i WHEN 1 THEN 'n1' ELSE 'n2' END AS note, CASE i WHEN 1 THEN 'c1' ELSE 'c2' END AS refined_code FROM ar""")
def detail_risks(spark, sf_dir):
    return serve.detail_risks(_analyses(spark, sf_dir)).drop("issues")


@query(f"""WITH {_ANALYSES} SELECT analysis_id, name, status, seq * 13 AS total_lines, n_issues, false AS has_summary, CAST(n_issues AS INT) AS listed FROM a""")
def json_report(spark, sf_dir):
    text = as_json(serve.public(_analyses(spark, sf_dir)))
    back = F.from_json("value", ANALYSES)
    has = F.get_json_object("value", "$.ai_summary").isNotNull()
    return text.where(F.contains("value", F.lit("\n"))).select(
        back["analysis_id"].alias("analysis_id"), back["name"].alias("name"), back["status"].alias("status"), back["metrics"]["total_lines"].alias("total_lines"),
        back["n_issues"].alias("n_issues"), has.alias("has_summary"), F.size(back["security_issues"]).alias("listed"),
    )


@query(f"""WITH {_ANALYSES} SELECT status, ai_summary, count(*) AS n, CAST(sum(n_issues) AS BIGINT) AS n_issues FROM (SELECT CASE WHEN seq % 3 = 0 THEN 'processing' WHEN seq % 3 = 1 THEN 'failed' ELSE status END AS status,
CASE WHEN seq % 3 = 1 THEN 'no access' END AS ai_summary, CASE WHEN seq % 3 = 2 THEN n_issues ELSE 0 END AS n_issues FROM a) GROUP BY ALL""")
def status_lifecycle(spark, sf_dir):
    done = _analyses(spark, sf_dir).drop("_id")
    opened = lifecycle.open_analyses(done)
    versions = reduce(DataFrame.unionByName, [
        lifecycle.record(opened, lifecycle.OPENED), lifecycle.record(lifecycle.fail(opened.where("seq % 3 = 1"), "no access"), lifecycle.ENDED),
        lifecycle.record(done.where("seq % 3 = 2"), lifecycle.ENDED),
    ])
    return lifecycle.current(versions).groupBy("status", "ai_summary").agg(F.count("*").alias("n"), F.sum("n_issues").alias("n_issues"))


@query(f"""WITH {_ANALYSES} SELECT analysis_id, CASE seq % 4 WHEN 0 THEN 'fine ' || seq WHEN 1 THEN 'AI generation failed.' WHEN 2 THEN 'AI analysis error.' END AS ai_summary,
CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END AS n_recommendations, CASE WHEN seq % 4 = 0 THEN 'x' || seq WHEN seq % 4 = 3 THEN 'e1' END AS explanation FROM a""")
def enrichment_replies(spark, sf_dir):
    rows = _analyses(spark, sf_dir)
    key = F.col("seq").cast("string")
    body = F.concat(F.lit('{"summary": "fine '), key, F.lit('", "recommendations": ["r"], "fixes": [{"file_path": "f1", "issue_type": "T1", "explanation": "x'), key, F.lit('"}]}'))
    replies = rows.where("seq % 4 <> 3").select(
        "analysis_id", F.when(F.col("seq") % 4 == 1, 500).otherwise(200).alias("status"), F.when(F.col("seq") % 4 == 2, "not json").otherwise(body).alias("body")
    )
    out = enrichment.attach(rows, replies)
    return out.select("analysis_id", "ai_summary", F.size("recommendations").alias("n_recommendations"), F.get("ai_fixes", F.lit(0))["explanation"].alias("explanation"))


@query(f"""WITH {_FILES}, r AS (SELECT analysis_id, seq, path, row_number() OVER (PARTITION BY analysis_id ORDER BY risk_score DESC, seq) AS place FROM risks WHERE risk_score > 0),
i AS (SELECT analysis_id, seq, path FROM files WHERE kind = 4), p AS (SELECT analysis_id, seq, path FROM i UNION SELECT analysis_id, seq, path FROM r WHERE place <= 2),
c AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY seq) AS cut FROM p)
SELECT analysis_id, string_agg('File: ' || path || chr(10) || 'Content:' || chr(10) || content, chr(10) ORDER BY c.seq) AS context, CAST((SELECT count(*) FROM r WHERE r.analysis_id = c.analysis_id AND place <= 2) AS INT) AS n_risks
FROM c JOIN files USING (analysis_id, seq, path) WHERE cut <= 3 GROUP BY analysis_id""")
def enrichment_prompts(spark, sf_dir):
    files = _files(spark, sf_dir)
    issues = files.where("seq % 6 = 4").select("analysis_id", F.col("path").alias("file_path"))
    risks = bug_risk(files).where("risk_score > 0").drop("content", "language", "lines")
    documents = files.select("analysis_id").distinct().withColumn("security_issues", F.array().cast(ANALYSES["security_issues"].dataType))
    found = enrichment.prompts(documents, files, issues, risks)
    part = lambda k: F.get_json_object("prompt", f"$.{k}")
    return found.select("analysis_id", part("code_context").alias("context"), F.json_array_length(part("complexity_risks")).alias("n_risks"))


@query("""WITH r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents)
SELECT doc_id, lang FROM r SEMI JOIN (SELECT lang, source FROM r WHERE place <= 2) p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source = p.source WHERE r.lang IS NOT NULL""")
def context_risks(spark, sf_dir):
    risks = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "lang", F.col("source").alias("path"), F.col("n_chars").alias("risk_score"))
    return risks_in_context(risks, by=("lang",)).select(F.col("seq").alias("doc_id"), "lang")


@query("SELECT l_returnflag AS language, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def language_map_merge(spark, sf_dir):
    items = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    maps = items.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("languages"))
    return merge_language_maps(maps)


@query("""WITH n AS (SELECT event_type AS severity, count(*) AS n FROM events GROUP BY 1)
SELECT severity, coalesce(n, 0) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'absent']) AS severity) FULL JOIN n USING (severity)""")
def event_histogram(spark, sf_dir):
    return severity_histogram(t(spark, sf_dir, "events"), "event_type", ("view", "click", "purchase", "absent"))


_SEVERITY = "CASE event_type WHEN 'view' THEN 'low' WHEN 'click' THEN 'medium' WHEN 'purchase' THEN 'critical' ELSE 'high' END"


def _event_severity():
    return lookup(F.col("event_type"), {"view": "low", "click": "medium", "purchase": "critical"}, "high")


@query(f"""SELECT user_id, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high,
count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low FROM (SELECT user_id, {_SEVERITY} AS s FROM events) GROUP BY user_id""")
def severity_pivot(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg(*severity_counts(_event_severity()))


@query(f"""WITH s AS (SELECT {_SEVERITY} AS s FROM events) SELECT name, count(s.s) AS value FROM
(SELECT unnest(['Critical', 'High', 'Medium', 'Low']) AS name) d LEFT JOIN s ON lower(d.name) = s.s GROUP BY name""")
def severity_chart(spark, sf_dir):
    return severity_rows(t(spark, sf_dir, "events").agg(*severity_counts(_event_severity())))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR coalesce(contains(lower(p_type), 'ring'), false)")
def search_contains(spark, sf_dir):
    parts = t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("source_url"))
    return search(parts, "Ring").withColumnsRenamed({"name": "p_name", "source_url": "p_type"})


@query("""SELECT event_id, user_id, c_name AS name, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey
WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def session_user_join(spark, sf_dir):
    sessions = t(spark, sf_dir, "events").select(F.col("event_id").alias("session_token"), "user_id", F.col("ts").alias("expires_at"))
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    cut = F.lit("2024-01-15 00:00:00").cast(sessions.schema["expires_at"].dataType)
    return authenticate(sessions, users, cut).select(F.col("session_token").alias("event_id"), "user_id", "name", "segment")


@query("""WITH s AS (SELECT p_partkey, p_name, count(*) AS n, min((CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey) * 100000 + l_suppkey) AS first
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_partkey, p_name, 'high' AS severity, 'Vulnerable Dependency (' || first || ')' AS type, 'Package ' || chr(39) || p_partkey || chr(39) || ' (v1.0) has ' || n || ' known security issues.' AS description FROM s""")
def dependency_vuln(spark, sf_dir):
    """Parts as manifests of one package each, line items as its advisories."""
    name, seq = F.col("p_partkey").cast("string"), (F.col("l_linenumber").cast("long") * F.lit(1000000000) + F.col("l_orderkey")) * 100000 + F.col("l_suppkey")
    content = F.to_json(F.struct(F.create_map(name, F.lit("^1.0")).alias("dependencies")))
    advisories = t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("name"), F.lit("npm").alias("ecosystem"), F.lit("1.0").alias("version"),
        seq.alias("seq"), seq.cast("string").alias("id"), F.lit(None).cast("array<string>").alias("aliases"),
    )
    parts = t(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit("package.json").alias("path"), content.alias("content"))
    return vulnerable(parts, advisories).select("p_partkey", "p_name", "severity", "type", "description")


@query(f"""WITH {_FILES}, m AS (SELECT * FROM files WHERE kind = 5) SELECT path, 'pkg' AS name, (k % 20) || '.0' AS version FROM m
UNION ALL SELECT path, 'dev', '1.' || (k % 7) FROM m UNION ALL SELECT path, 'pkg' || (k % 2), '2.0' FROM m""")
def manifest_packages(spark, sf_dir):
    return declared(manifests(_files(spark, sf_dir)).select("path", "content")).select("path", "name", "version")


@query("""SELECT p_partkey, name, version FROM (SELECT p_partkey, 'both' AS name, (p_size % 9) || '.1' AS version FROM part UNION ALL SELECT p_partkey, 'own', (p_size % 5) || '.' FROM part)""")
def manifest_sections(spark, sf_dir):
    """The same package in both sections: that of the second counts; entries without a text as version do not."""
    size = F.col("p_size").cast("string")
    content = F.concat(
        F.lit('{"dependencies": {"both": "0.0", "n": 2.5, "l": ["1.0"], "o": {"x": 1}, "b": true, "z": null, "own": "'), F.col("p_size") % 5, F.lit('.x"}, "devDependencies": {"both": "v'),
        F.col("p_size") % 9, F.lit('.1"}, "size": '), size, F.lit("}"),
    )
    return declared(t(spark, sf_dir, "part").select("p_partkey", content.alias("content"))).select("p_partkey", "name", "version")


@query("""WITH top AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20),
p AS (SELECT doc_id FROM top UNION SELECT doc_id FROM labels) SELECT doc_id, lang, n_chars FROM documents SEMI JOIN p USING (doc_id)""")
def context_semi(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    top = top_risks(docs.select(F.col("doc_id").alias("seq"), F.col("n_chars").alias("risk_score")), 20).select(F.col("seq").alias("doc_id"))
    paths = top.unionByName(t(spark, sf_dir, "labels").select("doc_id")).distinct()
    return docs.join(paths, "doc_id", "left_semi")


@query("""SELECT doc_id, n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1
UNION (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 2)) p USING (doc_id) ORDER BY doc_id LIMIT 3""")
def context_cut(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("path"), "n_chars")
    toxic = t(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_path"))
    cut = context_files(docs, toxic, docs.withColumn("risk_score", F.col("n_chars")))
    return cut.select(F.col("seq").alias("doc_id"), "n_chars")


@query("""SELECT o_orderkey, l_partkey AS fix_part, l_linenumber AS fix_line FROM orders LEFT JOIN (
SELECT o_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND (l_returnflag = 'R' OR l_linestatus = o_orderstatus)) f USING (o_orderkey) WHERE k = 1 OR k IS NULL""")
def first_fix(spark, sf_dir):
    """Orders as issues of a type, line items as fixes that name types in two fields."""
    key = F.col("o_orderkey")
    issues = t(spark, sf_dir, "orders").select(key.alias("issue_id"), key.cast("string").alias("file_path"), F.col("o_orderstatus").alias("type"), F.when(key > 0, "R").alias("other"))
    fixes = t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linestatus").alias("issue_type"), F.lit(None).cast("string").alias("type"),
        F.col("l_partkey").alias("explanation"), F.col("l_linenumber").alias("fix_code"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
        (F.col("l_returnflag") == "R").alias("returned"),
    )
    # A returned item fixes any issue of its order: it names all three types.
    any_type = fixes.where("returned").select(*[c for c in fixes.columns if c not in ("issue_type", "type", "returned")], F.explode(F.array(*map(F.lit, "FOP"))).alias("type"))
    fixes = fixes.drop("returned").unionByName(any_type.withColumn("issue_type", F.lit(None).cast("string")).select(*[c for c in fixes.columns if c != "returned"]))
    return joins.first_fix(issues, fixes).select(F.col("issue_id").alias("o_orderkey"), F.col("fix.explanation").alias("fix_part"), F.col("fix.fix_code").alias("fix_line"))


@query("""WITH r AS (SELECT c_nationkey AS n, c_custkey AS seq, 'src/' || (c_custkey % 50) || '.py' AS path FROM customer), f AS (SELECT s_nationkey AS n, s_suppkey AS pos, (s_suppkey % 50) || '.py' AS path FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey + 1000000, 'repo/src/' || (s_suppkey % 50) || '.py' FROM supplier)
SELECT r.seq, min(f.pos) AS pos FROM r LEFT JOIN f ON r.n = f.n AND (contains(r.path, f.path) OR contains(f.path, r.path)) GROUP BY r.seq""")
def refactor_join(spark, sf_dir):
    """Customers as files at risk, suppliers as refactors, one analysis per nation."""
    path = lambda before, k: F.concat(F.lit(before), (F.col(k) % 50).cast("string"), F.lit(".py")).alias("file_path")
    risks = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("analysis_id"), F.col("c_custkey").alias("seq"), path("src/", "c_custkey"))
    rows = t(spark, sf_dir, "supplier")
    refactor = lambda before, add: rows.select(
        F.col("s_nationkey").cast("string").alias("analysis_id"), (F.col("s_suppkey") + add).alias("pos"), path(before, "s_suppkey"), F.lit("e").alias("explanation"), F.lit("c").alias("refined_code")
    )
    return first_refactor(risks, refactor("", 0).unionByName(refactor("repo/src/", 1000000))).select("seq", F.col("refactor.pos").alias("pos"))


@query("SELECT doc_id, min(item_id) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY doc_id")
def substring_join(spark, sf_dir):
    needles = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return first_containing(needles, t(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "needle", "doc_id", "text")


@query("SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' ELSE 'unknown' END AS region FROM nation")
def lookup_default(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", "n_name", lookup(F.col("n_regionkey").cast("string"), REGIONS, "unknown").alias("region"))


@query("SELECT o_orderkey, o_orderstatus FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def anti_delete(spark, sf_dir):
    keys = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return delete(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), keys, ["o_orderkey"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_version(spark, sf_dir):
    versions = t(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("version"))
    return latest(versions, "user_id", "version").drop("version")


@query("""SELECT e.user_id IS NULL AS untouched, count(*) AS n, count(*) FILTER (c_name = 'Customer' OR e.value IS NULL) AS kept_name, CAST(sum(e.value) AS DOUBLE) AS total
FROM (SELECT c_custkey, c_name FROM customer UNION ALL (SELECT user_id + 1000000, NULL FROM events WHERE event_type = 'purchase' GROUP BY ALL)) c
LEFT JOIN (SELECT user_id, CAST(max(value) AS BIGINT) AS value FROM (SELECT user_id, arg_max(CAST(event_id AS BIGINT), (ts, CAST(event_id AS VARCHAR))) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id
UNION ALL SELECT user_id + 1000000, arg_max(CAST(event_id AS BIGINT), (ts, CAST(event_id AS VARCHAR))) FROM events WHERE event_type = 'purchase' GROUP BY ALL) GROUP BY ALL) e ON c_custkey = e.user_id GROUP BY ALL""")
def upsert_outcome(spark, sf_dir):
    """Purchases update the customer of their user, often many times, and make a user of an unknown address once."""
    users = t(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_custkey").cast("string").alias("email"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("picture"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    bought = t(spark, sf_dir, "events").where("event_type = 'purchase'")
    update = lambda add: bought.select(
        (F.col("user_id") + add).cast("string").alias("email"), F.col("event_id").cast("string").alias("name"), F.lit("p").alias("picture"), F.col("ts").cast("timestamp").alias("created_at")
    )
    kept = upsert_users(users, update(0).unionByName(update(1000000)), F.lit("new"))
    untouched = F.col("picture").isNull()
    return kept.groupBy(untouched.alias("untouched")).agg(
        F.count("*").alias("n"), F.count_if(F.col("name").startswith("Customer")).alias("kept_name"), F.sum(F.when(~untouched, F.col("name").cast("long"))).cast("double").alias("total")
    )


def _in_utc(time: Column) -> Column:
    """An instant as the clock shows it in UTC, whatever the session's zone."""
    return F.to_utc_timestamp(time, F.current_timezone()).cast("timestamp_ntz")


@query("SELECT c_custkey AS user_id, TIMESTAMP '2024-01-31 12:00:00' + INTERVAL 7 DAYS AS expires_at, TIMESTAMP '2024-01-31 12:00:00' AS created_at FROM customer")
def session_opening(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    out = open_session(users, random_id("s_"), utc_timestamp(F.lit("2024-01-31T12:00:00")))
    return out.where(F.col("session_token").rlike("^s_[0-9a-f]{12}$")).select("user_id", *[_in_utc(F.col(c)).alias(c) for c in ("expires_at", "created_at")])


@query("SELECT event_id, ts + INTERVAL (CASE event_id % 3 WHEN 2 THEN -2 ELSE 0 END) HOURS + INTERVAL 7 DAYS AS expires_at FROM events")
def mixed_timestamps(spark, sf_dir):
    """Times as ISO text with and without a zone, as stores hold them beside native ones."""
    iso = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(iso, lookup((F.col("event_id") % 3).cast("string"), {"0": "", "1": "Z"}, "+02:00"))
    return t(spark, sf_dir, "events").select("event_id", _in_utc(expires_at(utc_timestamp(text))).alias("expires_at"))


@query("SELECT 'u' || c_custkey AS user_id, c_name AS name, NULL::VARCHAR AS picture, 'e' || c_custkey AS email FROM customer")
def user_views(spark, sf_dir):
    users = t(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("email"),
        F.col("c_name").alias("name"), F.lit(None).cast("string").alias("picture"), F.current_timestamp().alias("created_at"), F.col("c_acctbal").alias("_id"),
    )
    return serve.user_view(users)


@query("""SELECT CASE doc_id % 4 WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'LOW' END AS severity, coalesce(nullif(lang, 'en'), 'General Issue') AS type,
CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE source END AS file_path, CASE WHEN doc_id % 5 = 0 THEN '-' ELSE CAST(doc_id % 5 AS VARCHAR) END AS line_number, count(*) AS n FROM documents GROUP BY ALL""")
def report_rows(spark, sf_dir):
    key = F.col("doc_id")
    severity = F.when(key % 4 == 1, "").when(key % 4 == 2, "high").when(key % 4 == 3, "critical")
    issues = t(spark, sf_dir, "documents").select(
        severity.alias("severity"), F.nullif(F.col("lang"), F.lit("en")).alias("type"), F.when(key % 3 == 0, "").otherwise(F.col("source")).alias("file_path"), (key % 5).alias("line_number")
    )
    return serve.report_rows(issues).groupBy("severity", "type", "file_path", "line_number").agg(F.count("*").alias("n"))


@query(f"""WITH {_FILES} SELECT seq, array_to_string(ls[1:40], chr(10)) AS refined_code FROM files""")
def report_code(spark, sf_dir):
    return serve.report_code(_files(spark, sf_dir).select("seq", F.col("content").alias("refined_code")))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    """Numbers of an object, made texts first: the map has texts only."""
    text = F.regexp_replace("props", ":\\s*([0-9]+)", ': "$1"')
    props = string_map(F.concat(F.lit('{"props": '), text, F.lit("}")), "$.props")
    return t(spark, sf_dir, "events").select(F.try_element_at(props, F.lit("k")).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT upper(lang) AS name, count(*) AS value, CASE lang WHEN 'python' THEN '#3776AB' ELSE '#71717A' END AS colour FROM documents GROUP BY lang")
def language_chart(spark, sf_dir):
    counts = t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return language_rows(counts.agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("languages")))


@query(r"""SELECT p_partkey, regexp_replace(p_type || '-' || p_size || '.' || p_brand, '[^0-9.]', '', 'g') AS version,
regexp_extract(p_name || '.' || p_brand, '(\.[^./]+)$', 1) AS suffix, split_part(p_name, ' ', 1) AS first,
CASE WHEN p_size >= 80 THEN 'good' WHEN p_size >= 60 THEN 'fair' ELSE 'poor' END AS band FROM part""")
def scalar_functions(spark, sf_dir):
    parts = t(spark, sf_dir, "part")
    return parts.select(
        "p_partkey", clean_version(F.concat("p_type", F.lit("-"), "p_size", F.lit("."), "p_brand")).alias("version"),
        suffix(F.concat("p_name", F.lit("."), "p_brand")).alias("suffix"), first_word(F.col("p_name")).alias("first"), score_band(F.col("p_size")).alias("band"),
    )


@query(r"""SELECT regexp_matches(replace(url, 'https://', 'https://github.com/'), '^https?://github\.com/[^/]+/[^/]+') AS valid, count(*) AS n FROM pages GROUP BY 1""")
def repository_urls(spark, sf_dir):
    url = F.replace(F.col("url"), F.lit("https://"), F.lit("https://github.com/"))
    return t(spark, sf_dir, "pages").groupBy(is_repository_url(url).alias("valid")).agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)
SELECT doc_id, line_number, 'Found: ' || substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 100) AS description, 'high' AS severity
FROM l WHERE regexp_matches(line, {_quoted(STAND_INS[1].pattern)}, 'i')""")
def rule_findings(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("path"))
    return scan_rules(docs, STAND_INS[1:]).select("doc_id", "line_number", "description", "severity")


@query("""SELECT doc_id, lines, row_number() OVER (ORDER BY lines DESC, doc_id) AS place FROM
(SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents) ORDER BY lines DESC, doc_id LIMIT 10""")
def top_files(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.size(lines_of(F.col("text"))).cast("long").alias("risk_score"))
    top = top_risks(docs, 10)
    place = F.row_number().over(Window.orderBy(F.desc("risk_score"), "seq")).cast("long")  # ten rows
    return top.select(F.col("seq").alias("doc_id"), F.col("risk_score").alias("lines"), place.alias("place"))


@query("SELECT count(*) AS n FROM part WHERE contains(lower(p_name), '')")
def search_empty(spark, sf_dir):
    return t(spark, sf_dir, "part").where(contains_ignoring_case(F.col("p_name"), "")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_size, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS BIGINT) AS functions, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS classes,
0::BIGINT AS max_nesting, CASE WHEN p_size % 7 = 0 THEN 'unknown' WHEN p_size > 20 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END AS complexity FROM part""")
def ast_complexity(spark, sf_dir):
    """Sources with as many functions as a part's size, and one class; each seventh does not parse."""
    source = F.concat(F.repeat(F.lit("def f():\n    pass\n"), F.col("p_size")), F.lit("async def g(): pass\n"), F.when(F.col("p_size") % 7 == 0, "def (").otherwise("class A: pass"))
    return t(spark, sf_dir, "part").select("p_partkey", "p_size", python_counts(source).alias("c")).select("p_partkey", "p_size", "c.*")


@query("""SELECT n_name AS archive, CAST(2 + i AS BIGINT) AS seq, 'src/' || i || CASE WHEN i % 2 = 0 THEN '.PY' ELSE '.js' END AS path, 'a' || chr(10) || n_name AS content,
CASE WHEN i % 2 = 0 THEN 'python' ELSE 'javascript' END AS language, 2::BIGINT AS lines FROM nation, unnest(range(0, 98)) AS u(i) WHERE i <= n_nationkey * 5 AND i % 3 <> 2""")
def zip_entries(spark, sf_dir):
    """Code files of one archive per nation: some entries are no code, some no files, and large archives are capped at 100 entries."""
    import io
    import zipfile

    import pyarrow as pa

    def zipped(batches):
        for batch in batches:
            out = []
            for key, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr("__MACOSX/x.py", "")
                    z.writestr("src/", "")
                    for i in range(key * 5 + 1):
                        ending = ".txt" if i % 3 == 2 else ".js" if i % 2 else ".PY"
                        z.writestr(f"src/{i}{ending}", b"a\n\xff" + name.encode())
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["path", "content"])

    archives = t(spark, sf_dir, "nation").select("n_nationkey", "n_name").mapInArrow(zipped, "path string, content binary")
    return archive_files(archives)


class _Host:
    """A host of one repository with 90 files on its old branch; some have no text."""

    def tree(self, owner, name, branch):
        if branch == "main" or (owner, name) != ("team", "code"):
            return None
        kinds = {0: ".py", 1: ".PY", 2: ".md"}
        return [{"path": "lib", "type": "tree"}] + [{"path": f"lib/{k:02}{kinds.get(k % 4, '.go')}", "type": "blob"} for k in range(120)]

    def raw(self, owner, name, branch, path):
        return None if branch == "main" or path == "lib/04.py" else f"{path}\nTODO"


@query("""SELECT 'r' AS analysis_id, seq, path, path || chr(10) || 'TODO' AS content, language, 2::BIGINT AS lines FROM (
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS seq, 'lib/' || lpad(k::VARCHAR, 2, '0') || CASE k % 4 WHEN 0 THEN '.py' ELSE '.go' END AS path,
CASE k % 4 WHEN 0 THEN 'python' ELSE 'go' END AS language FROM unnest(range(0, 120)) AS u(k) WHERE k % 4 IN (0, 3)) WHERE seq < 50 AND path <> 'lib/04.py'""")
def remote_scan(spark, sf_dir):
    return read_repository(spark, "https://github.com/team/code.git/tree/x", "r", _Host())


@query(f"""WITH {_FILES} SELECT seq, 'critical' AS severity, 'AWS access key' AS type, path AS file_path FROM files WHERE regexp_matches(content, 'AKIA[0-9A-Z]{{16}}')""")
def secret_files(spark, sf_dir):
    return scan_secrets(_files(spark, sf_dir).select("seq", "path", "content")).select("seq", "severity", "type", "file_path")


@query("""SELECT c_custkey, 'o' || c_custkey || '/r' || c_nationkey || 'hub.io' AS repository, 'p' || c_custkey || 'x' AS archive, printf('%.2f', c_custkey * 12345 / 1048576.0) || ' MB' AS size, true AS id_fits FROM customer""")
def names_and_sizes(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://github.com/o"), key, F.lit("/r"), F.col("c_nationkey").cast("string"), F.lit(".github.io/tree/main"))
    return t(spark, sf_dir, "customer").select(
        "c_custkey", repository_of(url).alias("repository"), archive_name(F.concat(F.lit("p"), key, F.lit(".zipx"))).alias("archive"),
        megabytes(F.col("c_custkey") * 12345, faithful=False).alias("size"), random_id("analysis_").rlike("^analysis_[0-9a-f]{12}$").alias("id_fits"),
    )


def _run_analysis(spark, sf_dir):
    files = _files(spark, sf_dir)
    names = files.select("analysis_id").distinct().unionByName(t(spark, sf_dir, "region").select(F.col("r_name").alias("analysis_id")))
    requests = names.select(
        "analysis_id", F.xxhash64("analysis_id").alias("seq"), F.lit("u").alias("user_id"), F.col("analysis_id").alias("name"),
        F.lit("zip").alias("source_type"), F.lit(None).cast("string").alias("source_url"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    package = F.when(F.col("p_partkey") % 2 == 0, "pkg").otherwise("dev")
    version = F.when(F.col("p_partkey") % 2 == 0, F.concat((F.col("p_size") % 20).cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit("1."), (F.col("p_size") % 9).cast("string")))
    alias = F.when(F.col("p_partkey") % 3 > 0, F.array(F.concat(F.lit("C"), F.col("p_partkey").cast("string"))))
    advisories = t(spark, sf_dir, "part").select(
        package.alias("name"), F.when(F.col("p_size") % 11 == 0, "pypi").otherwise("npm").alias("ecosystem"), version.alias("version"), F.col("p_partkey").alias("seq"),
        F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("id"), alias.alias("aliases"),
    )
    return files, requests, advisories


_CODE_RULES = ", ".join(f"({_quoted(r.rule_id)}, {k}, {_quoted(r.type)}, {_quoted(r.severity)}, {_quoted(r.pattern)}, {_quoted(r.recommendation)})" for k, r in enumerate(RULES))
_ISSUES = f"""known AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'pkg' ELSE 'dev' END AS name, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 20) || '.0' ELSE '1.' || (p_size % 9) END AS version,
 count(*) AS n, arg_min(CASE WHEN p_partkey % 3 > 0 THEN 'C' ELSE 'G' END || p_partkey, p_partkey) AS first FROM part WHERE p_size % 11 <> 0 GROUP BY ALL),
declared AS (SELECT *, 'pkg' AS name, (k % 20) || '.0' AS version FROM files WHERE kind = 5 UNION ALL SELECT *, 'dev', '1.' || (k % 7) FROM files WHERE kind = 5),
rules(rule_id, place, type, severity, pattern, recommendation) AS (VALUES {_CODE_RULES}),
l AS (SELECT analysis_id, seq, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM files),
issues AS (SELECT analysis_id, seq, 1 AS source_rank, 'high' AS severity, 'Vulnerable Dependency (' || first || ')' AS type,
 'Package ' || chr(39) || name || chr(39) || ' (v' || version || ') has ' || n || ' known security issues.' AS description, path AS file_path, NULL::BIGINT AS line_number,
 'Update ' || chr(39) || name || chr(39) || ' immediately to the latest stable version.' AS recommendation FROM declared JOIN known USING (name, version)
 UNION ALL SELECT analysis_id, seq, 2, severity, type, 'Found: ' || substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, 100), path, line_number, recommendation
 FROM l JOIN rules ON regexp_matches(line, '(?i)' || pattern))"""


@query(f"""WITH {_FILES}, {_ISSUES}, s AS ({_TOTALS}), i AS (SELECT analysis_id, count(*) AS n, count(*) FILTER (severity IN ('critical', 'high')) AS pen FROM issues GROUP BY ALL),
r AS (SELECT analysis_id, count(*) AS n_risks FROM risks WHERE risk_score > 0 GROUP BY ALL),
j AS (SELECT s.*, coalesce(i.n, 0) AS n_issues, coalesce(pen, 0) AS pen, coalesce(n_risks, 0) AS n_risks FROM s LEFT JOIN i USING (analysis_id) LEFT JOIN r USING (analysis_id))
SELECT analysis_id, 'completed' AS status, total_files, total_lines, n_languages, {_SCORES}, n_issues, n_risks, least(n_issues, 1000) AS listed, 'AI key not configured' AS ai_summary FROM j
UNION ALL SELECT r_name, 'failed', NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, 0, 'No valid code files found in ZIP archive.' FROM region""")
def full_analysis(spark, sf_dir):
    """The whole plan: files of one analysis per source, advisories, and requests without files."""
    done = analyze(*_run_analysis(spark, sf_dir), fail_empty=True)
    return done.select(
        "analysis_id", "status", "metrics.total_files", "metrics.total_lines", F.when(F.col("metrics").isNotNull(), F.size("metrics.languages")).cast("long").alias("n_languages"), "metrics.avg_complexity",
        "metrics.maintainability_index", "overall_score", "n_issues", "n_risks", F.size("security_issues").cast("long").alias("listed"), "ai_summary",
    )


@query(f"WITH {_FILES}, {_ISSUES} SELECT * FROM issues")
def analysis_issues(spark, sf_dir):
    return analysis_tables(*_run_analysis(spark, sf_dir)).issues


@query(f"WITH {_FILES} SELECT analysis_id, seq, path AS file_path, risk_score, complexity, issues FROM risks WHERE risk_score > 0")
def analysis_risks(spark, sf_dir):
    return analysis_tables(*_run_analysis(spark, sf_dir)).risks.withColumn("issues", F.concat_ws("; ", "issues"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
