import json
import subprocess

from findinglake.cli import run


def test_scan_and_gate(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "a.py").write_text("requests.get(url, verify=False)\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    monkeypatch.chdir(tmp_path)
    assert run(["."], spark) == 1
    assert "2 findings in 2 files" in capsys.readouterr().out
    assert run([".", "--fail-on", "never", "--format", "json"], spark) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert {r["rule_id"] for r in rows} == {"authentication/tls-verification-disabled", "dangerous-api/ssrf"}
    (tmp_path / ".securityreview.yml").write_text("severity: {overrides: {authentication: low, dangerous-api: info}}\n")
    assert run([".", "--format", "sarif"], spark) == 0
    document = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert {r["level"] for r in document["runs"][0]["results"]} == {"note", "none"}


def test_diff_reports_changed_lines_only(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)

    def git(*args):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.py").write_text("a = eval(x)\n\n\n\n\n\n\nb = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("a = eval(x)\n\n\n\n\n\n\nb = eval(y)\n")
    assert run(["--diff", "HEAD", "--format", "json"], spark) == 1
    lines = [json.loads(l)["line"] for l in capsys.readouterr().out.splitlines() if l.startswith("{")]
    assert lines == [8]
    assert run(["--diff", "no-such-ref"], spark) == 2


def test_list_rules(capsys):
    assert run(["--list-rules"]) == 0
    assert "sql-injection/raw-query-api" in capsys.readouterr().out
