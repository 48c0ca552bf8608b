"""Settings: a repository's own file, checked and merged into the service's.

This runs on the driver while a plan is being built; no data passes through.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from .fixed_values.enums import CATEGORIES, MAX_INLINE_COMMENTS, SEVERITIES, STRICTNESS

try:
    import yaml
except ImportError:  # pragma: no cover - only the YAML front end needs it
    yaml = None

# Where the file is looked for, and the settings it may hold.
CONFIG_PATHS = (".securityreview.yml", ".securityreview.yaml", ".github/securityreview.yml")


@dataclass(frozen=True)
class Settings:
    """What a review runs with."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_tests: bool = False
    disabled_rules: tuple[str, ...] = ()
    min_severity: str = "info"
    fail_on: str = "high"
    overrides: Mapping[str, str] = field(default_factory=dict)
    inline: bool = True
    max_inline: int = MAX_INLINE_COMMENTS
    inline_min_severity: str = "info"
    triage: bool = False
    triage_min_severity: str = "info"


@dataclass(frozen=True)
class RepoConfig:
    """Settings a repository asked for, and what was wrong with the file."""

    values: Mapping[str, Any] = field(default_factory=dict)
    warnings: tuple[str, ...] = ()
    present: bool = False
    source: str = ""


class _Rejected(ValueError):
    pass


def _flag(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    raise _Rejected("must be true or false")


def _severity(value: Any) -> str:
    name = str(value).lower()
    if name in SEVERITIES:
        return name
    raise _Rejected(f"must be one of {', '.join(SEVERITIES)}, not {value!r}")


def _gate(value: Any) -> str:
    return "never" if str(value).lower() == "never" else _severity(value)


def _count(value: Any) -> int:
    try:
        number = value if isinstance(value, int) and not isinstance(value, bool) else int(str(value))
    except ValueError:
        raise _Rejected("must be a whole number") from None
    if not 0 <= number <= 100:
        raise _Rejected(f"must be between 0 and 100, not {number}")
    return number


# section -> key -> (setting, reader); lists and overrides are read apart.
_SCHEMA: dict[str, dict[str, tuple[str, Callable[[Any], Any] | None]]] = {
    "paths": {"exclude": ("exclude", None), "include": ("include", None), "include-tests": ("include_tests", _flag)},
    "rules": {"disable": ("disabled_rules", None)},
    "severity": {"min": ("min_severity", _severity), "fail-on": ("fail_on", _gate), "overrides": ("overrides", None)},
    "inline": {
        "enabled": ("inline", _flag), "max-comments": ("max_inline", _count),
        "min-severity": ("inline_min_severity", _severity),
    },
    "triage": {"enabled": ("triage", _flag), "min-severity": ("triage_min_severity", _severity)},
}


def _texts(value: Any, label: str, complain: Callable[[str], None]) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else value
    if not isinstance(items, list):
        complain(f"{label} must be a list of strings; ignored")
        return ()
    if not all(isinstance(item, str) for item in items):
        complain(f"{label} has entries that are not strings; ignored")
    return tuple(item for item in items if isinstance(item, str))


def read_document(document: Any, source: str = "") -> RepoConfig:
    """Check a parsed document. Bad values are dropped and reported, since a
    typo that quietly turns a rule off is worse than an error."""
    warnings: list[str] = []

    def complain(text: str) -> None:
        warnings.append(f"{source}: {text}" if source else text)

    if document is None:
        return RepoConfig(present=True, source=source)
    if not isinstance(document, dict):
        complain("the top level must be a mapping")
        return RepoConfig(warnings=tuple(warnings), source=source)
    for key in document:
        if key not in _SCHEMA and key != "version":
            complain(f'unknown setting "{key}"')
    if str(document.get("version", 1)) != "1":
        complain(f"version {document['version']} is not known; read as version 1")

    values: dict[str, Any] = {}
    for section, keys in _SCHEMA.items():
        content = document.get(section)
        if content is None:
            continue
        if not isinstance(content, dict):
            complain(f"{section} must be a mapping; ignored")
            continue
        for key, raw in content.items():
            label = f"{section}.{key}"
            if key not in keys:
                complain(f'unknown setting "{label}"')
                continue
            if raw is None:
                continue
            setting, reader = keys[key]
            if reader is not None:
                try:
                    values[setting] = reader(raw)
                except _Rejected as problem:
                    complain(f"{label} {problem}; ignored")
            elif setting == "overrides":
                values[setting] = _overrides(raw, label, complain)
            else:
                values[setting] = _texts(raw, label, complain)
    if "disabled_rules" in values:
        named = values["disabled_rules"]
        for entry in named:
            if entry.split("/")[0] not in CATEGORIES:
                complain(f'rules.disable entry "{entry}" names no category')
        values["disabled_rules"] = tuple(e for e in named if e.split("/")[0] in CATEGORIES)
    return RepoConfig(values=values, warnings=tuple(warnings), present=True, source=source)


def _overrides(raw: Any, label: str, complain: Callable[[str], None]) -> dict[str, str]:
    if not isinstance(raw, dict):
        complain(f"{label} must be a mapping; ignored")
        return {}
    out = {}
    for rule, value in raw.items():
        try:
            out[rule] = _severity(value)
        except _Rejected as problem:
            complain(f"{label}.{rule} {problem}; ignored")
    return out


def parse(text: str, source: str = CONFIG_PATHS[0]) -> RepoConfig:
    if yaml is None:  # pragma: no cover
        raise RuntimeError("reading YAML settings needs the yaml module")
    try:
        document = yaml.safe_load(text)
    except yaml.YAMLError as problem:
        return RepoConfig(warnings=(f"{source} is not valid YAML: {problem}",), source=source)
    return read_document(document, source)


def merge(base: Settings, repo: RepoConfig) -> tuple[Settings, tuple[str, ...]]:
    """The repository's choice wins, except that it can only tighten the gate
    and can only turn the model pass off."""
    if not repo.present:
        return base, repo.warnings
    warnings = list(repo.warnings)
    chosen = dict(repo.values)
    if "disabled_rules" in chosen:
        chosen["disabled_rules"] = tuple(dict.fromkeys((*base.disabled_rules, *chosen["disabled_rules"])))
    if STRICTNESS.get(chosen.get("fail_on", base.fail_on), 2) < STRICTNESS.get(base.fail_on, 2):
        warnings.append(f"{repo.source}: severity.fail-on may not be looser than {base.fail_on}; kept")
        del chosen["fail_on"]
    if chosen.get("triage") and not base.triage:
        warnings.append(f"{repo.source}: triage.enabled has no effect without a model")
        del chosen["triage"]
    return replace(base, **chosen), tuple(warnings)
