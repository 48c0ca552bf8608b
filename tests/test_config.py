from findinglake.config import Settings, merge, parse


def test_reads_and_reports():
    repo = parse(
        """
version: 2
paths: {exclude: [vendor/**, 3], include-tests: maybe}
rules: {disable: [secrets, nonsense/x, dangerous-api/eval]}
severity: {min: LOW, fail-on: never, overrides: {authentication: high, x: loud}}
inline: {max-comments: 500, min-severity: medium}
surprise: 1
"""
    )
    assert repo.values["exclude"] == ("vendor/**",)
    assert repo.values["disabled_rules"] == ("secrets", "dangerous-api/eval")
    assert repo.values["min_severity"] == "low" and repo.values["fail_on"] == "never"
    assert repo.values["overrides"] == {"authentication": "high"}
    assert "max_inline" not in repo.values and "include_tests" not in repo.values
    assert len(repo.warnings) == 7


def test_gate_only_tightens():
    base = Settings(fail_on="high")
    looser, warnings = merge(base, parse("severity: {fail-on: critical}"))
    assert looser.fail_on == "high" and len(warnings) == 1
    never, _ = merge(base, parse("severity: {fail-on: never}"))
    assert never.fail_on == "high"
    tighter, warnings = merge(base, parse("severity: {fail-on: medium}"))
    assert tighter.fail_on == "medium" and not warnings


def test_triage_only_turns_off():
    off, _ = merge(Settings(triage=True), parse("triage: {enabled: false}"))
    assert off.triage is False
    on, warnings = merge(Settings(triage=False), parse("triage: {enabled: true}"))
    assert on.triage is False and len(warnings) == 1


def test_disabled_rules_are_joined_without_repeats():
    merged, _ = merge(Settings(disabled_rules=("secrets",)), parse("rules: {disable: [secrets, authentication]}"))
    assert merged.disabled_rules == ("secrets", "authentication")


def test_empty_and_broken_files():
    assert parse("").present and not parse("").warnings
    assert not parse("a: [").present
    assert not parse("- 1").present
