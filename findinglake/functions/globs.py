"""Include / exclude path patterns.

`*` stops at a slash, `**` does not, `?` is one non-slash character, `{a,b}`
is a choice, and a pattern without a slash is also tried on the file name.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base_name

_TOKEN = re.compile(r"(?P<deep>\*\*/)|(?P<any>\*\*)|(?P<star>\*)|(?P<one>\?)|\{(?P<pick>[^}]*)\}|(?P<text>[\s\S])")
_PIECES = {"deep": "(?:.*/)?", "any": ".*", "star": "[^/]*", "one": "[^/]"}


def glob_regex(pattern: str) -> str:
    def piece(found: re.Match) -> str:
        kind = found.lastgroup
        if kind == "pick":
            return "(?:" + "|".join(glob_regex(choice) for choice in found["pick"].split(",")) + ")"
        return _PIECES.get(kind) or re.escape(found["text"])

    return _TOKEN.sub(piece, pattern)


def _clean(pattern: str) -> str:
    trimmed = pattern.strip()
    return trimmed[2:] if trimmed.startswith("./") else trimmed


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    plain = F.regexp_replace(path, r"^\./", "")
    cleaned = [_clean(p) for p in patterns if p.strip()]
    hit = F.lit(False)
    whole = [glob_regex(p) for p in cleaned]
    if whole:
        hit = plain.rlike("^(?:" + "|".join(whole) + r")\z")
    named = [glob_regex(p) for p in cleaned if "/" not in p]
    if named:
        hit = hit | base_name(plain).rlike("^(?:" + "|".join(named) + r")\z")
    return hit


def path_in_scope(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclusion wins; an empty include list admits everything else."""
    wanted = matches_any(path, include) if any(p.strip() for p in include) else F.lit(True)
    return wanted & ~matches_any(path, exclude)
