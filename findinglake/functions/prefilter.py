"""A quick necessary condition for a pattern: some literal it cannot do without.

Substring search runs far faster than a backtracking match, and almost every
line of a large corpus lacks the literals, so the pattern itself is tried on
few lines. The condition never rejects a line the pattern would match.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parser module was renamed in Python 3.11
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    import sre_constants as _c
    import sre_parse as _p

# Tuning only: a choice of more literals is not searched for, and its pattern is tried at once.
_MAX_CHOICES = 32
_GLUE = "\x01"


def _best(options: list[frozenset[str] | None]) -> frozenset[str] | None:
    """The most selective of several requirements that all hold."""
    real = [o for o in options if o and all(o)]
    return max(real, key=lambda o: (min(map(len, o)), -len(o)), default=None)


def _required(tree) -> frozenset[str] | None:
    """Literals of which any match contains at least one; None if unknown."""
    options: list[frozenset[str] | None] = []
    run = ""
    for op, arg in tree:
        if op is _c.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        if op is _c.SUBPATTERN:
            options.append(_required(arg[3]))
        elif op is _c.BRANCH:
            parts = [_required(branch) for branch in arg[1]]
            if all(parts):
                union = frozenset().union(*parts)
                options.append(union if len(union) <= _MAX_CHOICES else None)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            options.append(_required(arg[2]))
    if run:
        options.append(frozenset([run]))
    return _best(options)


_SIGNS = frozenset("(=:[{\"'`@$#/*|")


def _sign_choice(tree) -> frozenset[str] | None:
    """Punctuation of which any match contains at least one; None if unknown."""
    options: list[frozenset[str]] = []
    for op, arg in tree:
        found = None
        if op is _c.LITERAL:
            found = frozenset([chr(arg)])
        elif op is _c.IN and all(kind is _c.LITERAL for kind, _ in arg):
            found = frozenset(chr(code) for _, code in arg)
        elif op is _c.SUBPATTERN:
            found = _sign_choice(arg[3])
        elif op is _c.BRANCH:
            parts = [_sign_choice(branch) for branch in arg[1]]
            found = frozenset().union(*parts) if all(parts) else None
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found = _sign_choice(arg[2])
        if found and found <= _SIGNS:
            options.append(found)
    return min(options, key=len, default=None)


@lru_cache(maxsize=None)
def required_signs(pattern: str) -> frozenset[str]:
    """Punctuation signs a match cannot do without one of; empty if unknown."""
    try:
        return _sign_choice(_p.parse(pattern)) or frozenset()
    except re.error:
        return frozenset()


def holds_sign(text: Column, signs: frozenset[str]) -> Column:
    if len(signs) == 1:
        return F.contains(text, F.lit(next(iter(signs))))
    return text.rlike("[" + "".join("\\" + s for s in sorted(signs)) + "]")


@lru_cache(maxsize=None)
def required_literals(pattern: str) -> tuple[str, ...]:
    try:
        found = _required(_p.parse(pattern))
    except re.error:
        return ()
    return tuple(sorted(found)) if found else ()


def _holds_one(lowered: Column, literals: tuple[str, ...]) -> Column:
    if len(literals) == 1:
        return F.contains(lowered, F.lit(literals[0]))
    table = F.split(F.lit(_GLUE.join(literals)), _GLUE)
    return F.exists(table, lambda literal: F.contains(lowered, literal))


def may_match(lowered: Column, pattern: str) -> Column:
    """False only where the pattern cannot match the text this is the lower
    case of (so ASCII case is ignored)."""
    literals = required_literals(pattern)
    return _holds_one(lowered, literals) if literals else F.lit(True)


def may_match_any(lowered: Column, patterns: tuple[str, ...]) -> Column:
    """The same for a choice of patterns."""
    sets = [required_literals(p) for p in patterns]
    return _holds_one(lowered, tuple(sorted(set().union(*sets)))) if all(sets) else F.lit(True)
