"""Boolean trigram queries of regular expressions, and an inverted index over a segment of texts.

`trigram_query` says which trigrams a text must hold to match a pattern: a
trigram (bytes, ASCII letters lower-cased), ("and", parts), ("or", parts), or
True if the pattern has no mandatory trigram. Only sound steps are taken: a text
that matches always satisfies the query.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np

#: Alternatives kept as exact strings before they are turned into trigrams.
_EXACT = 64
_CLASSES = {
    "d": set("0123456789"), "s": set(" \t\n\r\f\v"),
    "w": set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"),
}


@dataclass
class _Known:
    """What is known of a part of a pattern: all strings it matches, or else a query."""

    exact: set[bytes] | None
    query: object = True


def _all_of(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _grams(strings: set[bytes]) -> object:
    if not strings or any(len(s) < 3 for s in strings):
        return True
    return _any_of([_all_of([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _asked(part: _Known) -> object:
    return part.query if part.exact is None else _grams(part.exact)


def _sequence(parts: list[_Known]) -> _Known:
    run, query, whole = {b""}, True, True
    for part in parts:
        if part.exact is not None and len(run) * len(part.exact) <= _EXACT:
            run = {a + b for a in run for b in part.exact}
            continue
        whole, query = False, _all_of([query, _grams(run)])
        run = part.exact if part.exact is not None else {b""}
        if part.exact is None:
            query = _all_of([query, part.query])
    return _Known(run) if whole else _Known(None, _all_of([query, _grams(run)]))


def _choice(parts: list[_Known]) -> _Known:
    if all(p.exact is not None for p in parts):
        union = set().union(*(p.exact for p in parts))
        if len(union) <= _EXACT:
            return _Known(union)
    return _Known(None, _any_of([_asked(p) for p in parts]))


def _repeat(part: _Known, least: int, most: int | None) -> _Known:
    if (least, most) == (1, 1):
        return part
    if (least, most) == (0, 1):
        return _choice([part, _Known({b""})])
    if least == 0:
        return _Known(None, True)
    return _Known(None, _asked(_sequence([part] * min(least, 4))))


class _Reader:
    """Reads literals, classes, groups, alternatives and repeats; looks past look-behind; refuses look-ahead and back-references."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.pattern[self.at - 1]

    def alternatives(self) -> _Known:
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return _choice(found)

    def sequence(self) -> _Known:
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            least, most = self.repeats()
            parts.append(_repeat(part, least, most))
        return _sequence(parts)

    def repeats(self) -> tuple[int, int | None]:
        sign = self.peek()
        if sign and sign in "*+?":
            self.take()
            bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        elif sign == "{":
            end = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at + 1 : end].partition(",")
            self.at = end + 1
            bounds = (int(low or 0), int(high) if high else None if comma else int(low))
        else:
            return 1, 1
        if self.peek() in ("?", "+"):
            self.take()
        return bounds

    def atom(self) -> _Known:
        sign = self.take()
        if sign == "(":
            kind = ":"
            if self.peek() == "?":
                self.take()
                kind = self.take()
                if kind == "<" and self.peek() in ("=", "!"):
                    self.take()
                elif kind != ":":
                    raise ValueError(f"group not supported in {self.pattern!r}")
            inner = self.alternatives() if kind == ":" else self.looked()
            if self.at >= len(self.pattern) or self.take() != ")":
                raise ValueError(f"unbalanced group in {self.pattern!r}")
            return inner
        if sign == "[":
            return self.char_class()
        if sign == ".":
            return _Known(None, True)
        if sign in "^$":
            return _Known({b""})
        if sign == "\\":
            kind = self.take()
            if kind in "bBAZ":
                return _Known({b""})
            if kind in "dsw":
                return _one_of(_CLASSES[kind])
            if kind in "DSW" or kind.isdigit():
                return _Known(None, True)
            return _one_of({self.escaped(kind)})
        return _one_of({sign})

    def looked(self) -> _Known:
        """Look-behind takes no character, so it is read past and nothing is asked for it."""
        self.alternatives()
        return _Known({b""})

    def escaped(self, kind: str) -> str:
        if kind == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        return {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}.get(kind, kind)

    def char_class(self) -> _Known:
        negated = self.peek() == "^"
        if negated:
            self.take()
        chars: set[str] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            low = self.class_char(chars)
            if low and self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.class_char(chars)
                chars.update(map(chr, range(ord(low), ord(high) + 1)))
            elif low:
                chars.add(low)
        self.take()
        return _Known(None, True) if negated else _one_of(chars)

    def class_char(self, chars: set[str]) -> str:
        sign = self.take()
        if sign != "\\":
            return sign
        kind = self.take()
        if kind in "dsw":
            chars |= _CLASSES[kind]
            return ""
        return self.escaped(kind)


def _one_of(chars: set[str]) -> _Known:
    folded = {c.encode().lower() for c in chars}
    return _Known(folded) if len(folded) <= 4 else _Known(None, True)


def trigram_query(pattern: str) -> object:
    reader = _Reader(pattern.removeprefix("(?i)"))
    found = reader.alternatives()
    if reader.at != len(pattern.removeprefix("(?i)")):
        raise ValueError(f"unbalanced group in {pattern!r}")
    return _asked(found)


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams_of, query[1]))


class Index:
    """Builds postings of the trigrams that some query asks for, one segment of texts at a time."""

    _STEP = 1 << 20

    def __init__(self, asked: set[bytes]):
        self._codes = np.array(sorted(int.from_bytes(g, "big") for g in asked), np.uint32)
        self._wanted = np.zeros(1 << 24, bool)
        self._wanted[self._codes] = True

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """Sorted row numbers for each trigram that occurs; the texts have their ASCII letters lower-cased."""
        joined = np.frombuffer(b"\xff\xff".join(texts), np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        slots, rows = [], []
        for start in range(0, max(0, len(joined) - 2), self._STEP):
            b = joined[start : start + self._STEP + 2].astype(np.uint32)
            code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            hit = np.flatnonzero(self._wanted[code])
            slots.append(np.searchsorted(self._codes, code[hit]))
            rows.append(np.searchsorted(starts, hit + start, "right") - 1)
        if not slots:
            return {}
        pairs = np.unique(np.concatenate(slots).astype(np.int64) * len(texts) + np.concatenate(rows))
        slot, row = np.divmod(pairs, len(texts))
        cut = np.flatnonzero(np.diff(slot)) + 1
        return {
            int(self._codes[s[0]]).to_bytes(3, "big"): r for s, r in zip(np.split(slot, cut), np.split(row, cut)) if len(s)
        }


def candidates(query: object, postings: dict[bytes, np.ndarray], n_rows: int) -> np.ndarray:
    """Row numbers that satisfy a query; all rows where nothing is mandatory."""
    if query is True:
        return np.arange(n_rows)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    lists = [candidates(part, postings, n_rows) for part in query[1]]
    if query[0] == "or":
        return reduce(np.union1d, lists)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(lists, key=len))
