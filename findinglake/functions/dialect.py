"""Patterns are written in ECMAScript syntax and run on Java's engine.

The two differ in what a word edge, white space, the dot and the end anchor
mean, and Java nests unescaped brackets inside a class. `java()` rewrites those
points; everything else reads the same in both.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE_EXTRA = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = False) -> str:
    out: list[str] = []
    i, n, in_class = 0, len(pattern), False
    while i < n:
        char = pattern[i]
        if char == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(r"\s" + _SPACE_EXTRA if in_class else r"[\s" + _SPACE_EXTRA + "]")
            elif nxt == "S" and not in_class:
                out.append(r"[^\s" + _SPACE_EXTRA + "]")
            elif nxt == "b" and not in_class:
                before, after = pattern[i - 1] if i else "", pattern[i + 2] if i + 2 < n else ""
                escaped = i >= 2 and pattern[i - 2] == "\\"
                if after in _WORD and after:
                    out.append(r"(?<!\w)")
                elif before in _WORD and before and not escaped:
                    out.append(r"(?!\w)")
                else:
                    out.append(_EDGE)
            else:
                out.append(char + nxt)
            i += 2
            continue
        if in_class:
            if char == "]":
                in_class = False
                out.append(char)
            elif char in "[&":
                out.append("\\" + char)
            else:
                out.append(char)
        elif char == "[":
            in_class = True
            out.append(char)
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif char == ".":
            out.append(r"[^\n\r\x{2028}\x{2029}]")
        elif char == "$":
            out.append(r"\z")
        else:
            out.append(char)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def matches(value: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where the pattern occurs anywhere in the text."""
    return value.rlike(java(pattern, ignore_case))


def any_of(value: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    return matches(value, "|".join(f"(?:{p})" for p in patterns), ignore_case)


def capture(value: Column, pattern: str, group: int, ignore_case: bool = False) -> Column:
    """First match's group; empty text when the pattern or the group is absent."""
    return F.regexp_extract(value, java(pattern, ignore_case), group)


def capture_all(value: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(value, F.lit(java(pattern, ignore_case)), F.lit(group))


def substitute(value: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(value, java(pattern, ignore_case), replacement)


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)
