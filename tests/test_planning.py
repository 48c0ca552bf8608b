import json

from pyspark.sql import functions as F

from findinglake.operators import planning as pl
from findinglake.operators.excerpts import excerpts
from findinglake.operators.verdicts import parse_verdicts
from findinglake.plans import report as rp

FINDING = (
    "review long, ord int, fingerprint string, rule_id string, category string, severity string, confidence string, "
    "file_path string, line int, verdict string"
)


def findings(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], FINDING)


def test_inline_plan(spark):
    rows = [
        ("aa", "r/1", "secrets", "critical", "high", "a", 1, None),
        ("bb", "r/1", "secrets", "critical", "high", "a", 2, "refuted"),
        ("cc", "r/1", "secrets", "low", "high", "a", 3, None),
        ("dd", "r/1", "secrets", "high", "high", "a", 99, None),
        ("ee", "r/1", "secrets", "high", "high", "a", 4, None),
        ("ff", "r/1", "secrets", "high", "high", "a", 5, None),
        ("ab", "r/1", "secrets", "high", "high", "a", 6, None),
    ]
    lines = spark.createDataFrame([(1, "a", n) for n in range(1, 10)], "review long, file_path string, line int")
    bodies = spark.createDataFrame([(1, "x <!-- security-review:finding:ab --> y"), (1, "no marker")], "review long, body string")
    plan = pl.inline_plan(findings(spark, rows), lines, bodies, ["review"], 2, "high")
    assert {r.fingerprint: r.plan for r in plan.collect()} == {
        "aa": "comment", "bb": "deferred", "cc": "deferred", "dd": "deferred", "ee": "comment", "ff": "deferred", "ab": "already",
    }


def test_no_budget_defers_everything(spark):
    lines = spark.createDataFrame([(1, "a", 1)], "review long, file_path string, line int")
    none = spark.createDataFrame([], "review long, body string")
    rows = findings(spark, [("aa", "r/1", "secrets", "critical", "high", "a", 1, None)])
    assert pl.inline_plan(rows, lines, none, ["review"], 0).first().plan == "deferred"


def test_triage_prefers_the_uncertain_and_skips_the_evident(spark):
    rows = [
        ("a", "secrets/aws-access-key-id", "secrets", "critical", "high", "a", 1, None),
        ("b", "secrets/hardcoded-credential", "secrets", "high", "high", "a", 2, None),
        ("c", "x/y", "authentication", "high", "low", "a", 3, None),
        ("d", "x/y", "authentication", "low", "low", "a", 4, None),
        ("e", "x/y", "authentication", "critical", "high", "a", 5, None),
    ]
    picked = pl.select_for_triage(findings(spark, rows), ["review"], 2, "high")
    assert sorted(r.fingerprint for r in picked.collect()) == ["c", "e"]


def test_severity_moves_one_step_when_sure(spark):
    cases = [("critical", "info", "high", "high"), ("low", "critical", "high", "medium"), ("high", "medium", "medium", "high"),
             ("high", "odd", "high", "high"), ("info", "info", "high", "info")]
    df = spark.createDataFrame(cases, "a string, b string, c string, want string")
    for r in df.select("want", pl.adjusted_severity(F.col("a"), F.col("b"), F.col("c")).alias("got")).collect():
        assert r.got == r.want


def test_overrides(spark):
    rows = findings(spark, [("a", "r/1", "secrets", "low", "high", "a", 1, None), ("b", "r/2", "secrets", "low", "high", "a", 1, None)])
    out = pl.override_severity(rows, {"r/1": "info", "secrets": "high"})
    assert {r.fingerprint: r.severity for r in out.collect()} == {"a": "info", "b": "high"}


def test_verdict_parsing(spark):
    def item(fp, verdict="refuted", reasoning=" why ", **more):
        return {"fingerprint": fp, "verdict": verdict, "reasoning": reasoning, **more}

    tool = json.dumps({"findings": [item("a", severity="low", confidence="high"), item("zz"), item("b", verdict="maybe"), item("c", reasoning=" ")]})
    text = 'I think {"findings": [' + json.dumps(item("d", confidence="very", fix=" do { this } ")) + ']} and "}" more {'
    answers = spark.createDataFrame(
        [(1, tool, "ignored {}", "m"), (1, None, text, "m"), (1, None, "no json", "m"), (1, None, "{broken", "m")],
        "review long, tool_json string, text string, model string",
    )
    asked = spark.createDataFrame([(1, f, "critical") for f in "abcd"], "review long, fingerprint string, severity string")
    got = {r.fingerprint: r for r in parse_verdicts(answers, asked, ["review"]).collect()}
    assert set(got) == {"a", "d"}
    assert (got["a"].severity, got["a"].severity_changed_from, got["a"].reasoning) == ("high", "critical", "why")
    assert (got["d"].confidence, got["d"].fix, got["d"].severity) == ("medium", "do { this }", "critical")


def test_blocking_and_status(spark):
    rows = [("a", "r", "secrets", "critical", "high", "a", 1, "refuted"), ("b", "r", "secrets", "medium", "high", "a", 1, None)]
    df = findings(spark, rows)
    assert rp.status_lines(df, ["review"], "high").first().text == "1 medium (none blocking)"
    assert rp.status_lines(df, ["review"], "medium").first().blocking == 1
    assert rp.status_lines(df, ["review"], "never").first().state == "success"


def test_cap_keeps_the_first_of_each_rule(spark):
    rows = [(f"f{i}", f"r{i % 2}", "secrets", "high", "high", "a", 1, None) for i in range(10)]
    kept = pl.cap_results(findings(spark, rows), ["review"], 3, 5)
    assert sorted(r.ord for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_sarif_document(spark):
    rows = [("aa", "x/one", "secrets", "medium", "high", "a", 0, None), ("bb", "x/one", "secrets", "critical", "low", "b", 4, "refuted")]
    df = findings(spark, rows)
    for name, value in {"title": "T", "description": "D", "remediation": "R", "snippet": "s", "reasoning": "because",
                        "triage_confidence": "high", "model": "m"}.items():
        df = df.withColumn(name, F.lit(value))
    df = df.withColumn("cwe", F.array(F.lit("CWE-1"))).withColumn("end_line", F.lit(6))
    doc = json.loads(rp.sarif_documents(df, ["review"], "t", "1", "u").first().sarif)
    run = doc["runs"][0]
    rule = run["tool"]["driver"]["rules"][0]
    assert doc["version"] == "2.1.0" and rule["name"] == "XOne"
    assert rule["defaultConfiguration"]["level"] == "error" and rule["properties"]["security-severity"] == "9.5"
    first, second = run["results"]
    assert first["level"] == "warning" and first["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert "reviewVerdict" not in first["properties"] and second["properties"]["reviewVerdict"] == "refuted"
    assert "false positive" in second["message"]["text"] and "invocations" not in run


def test_excerpts_merge_and_cut(spark):
    text = "\n".join(f"line {i}" for i in range(1, 31))
    files = spark.createDataFrame([("a", text)], "file_path string, content string")
    found = spark.createDataFrame([("a", 3, None), ("a", 5, 6), ("a", 20, None)], "file_path string, line int, end_line int")
    row = excerpts(files, found, ["file_path"], 1, 7).first()
    assert row.text.split("\n") == [
        "    2  line 2", "    3  line 3", "    4  line 4", "    5  line 5", "    6  line 6", "    7  line 7", "    ...",
        "   19  line 19", "    ... (excerpt truncated)",
    ]
    assert (row.start_line, row.end_line) == (2, 19)
