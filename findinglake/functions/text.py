"""Text columns shared by the rules: normalising, identity, literals, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import paths as P
from ..fixed_values.enums import FINGERPRINT_HEX, SNIPPET_CHARS
from .dialect import java, matches, substitute


def flatten_space(text: Column) -> Column:
    return F.trim(substitute(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space at either end, of any kind that the patterns know."""
    return F.regexp_replace(text, java(r"^\s+|\s+$"), "")


def truncate(text: Column, limit: int = SNIPPET_CHARS) -> Column:
    flat = flatten_space(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def content_address(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_HEX)


def fingerprint(rule_id: Column, file_path: Column, evidence: Column) -> Column:
    """Content address of a finding; independent of its line number."""
    return content_address(F.concat_ws(" ", rule_id, file_path, flatten_space(evidence)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    base = base_name(path)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise(F.lit(""))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in P.EXTENSION_LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("other"))


def is_generated_path(path: Column) -> Column:
    return matches(path, P.GENERATED_PATH) | matches(path, P.MINIFIED_NAME)


def is_lockfile(path: Column) -> Column:
    return matches(path, P.LOCKFILE_NAME)


def is_test_path(path: Column) -> Column:
    return matches(path, P.TEST_PATH, ignore_case=True)


def is_scannable(path: Column) -> Column:
    base = base_name(path)
    return (
        base.isin(*P.SCANNABLE_NAMES)
        | base.startswith(".env")
        | (base.startswith("requirements") & base.endswith(".txt"))
        | extension(path).isin(*P.SCANNABLE_EXTENSIONS)
    )


def in_skipped_directory(path: Column) -> Column:
    """True when a directory on the way to the file is never walked into."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in P.SKIP_DIRECTORIES]))


def split_identifiers(text: Column) -> Column:
    """resetToken -> reset Token, HTTPServer -> HTTP Server, api_key -> api key."""
    camel = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    acronym = F.regexp_replace(camel, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(acronym, r"[_\-]+", " ")


def is_comment_line(line: Column) -> Column:
    return matches(line, P.LINE_COMMENT)


def is_blank(line: Column) -> Column:
    return ~matches(line, r"\S")


# A quoted run per quote sign. Loops are possessive, so a long line costs no
# call stack; a literal left open runs to the end of the text.
def _quoted(sign: str) -> str:
    return f"{sign}[^{sign}\\\\]*+(?:\\\\[\\s\\S][^{sign}\\\\]*+)*+"


_SIGNS = ('"', "'", "`")
_CLOSED = "|".join(_quoted(s) + s for s in _SIGNS)
_SEGMENT = "|".join(_quoted(s) + f"(?:{s}|\\\\?\\z)" for s in _SIGNS) + "|[^\"'`]++"


def blank_string_literals(line: Column) -> Column:
    """Overwrite literal bodies with spaces; quotes and length stay."""
    segments = F.regexp_extract_all(line, F.lit(_SEGMENT), F.lit(0))

    def blanked(part: Column) -> Column:
        sign = F.substring(part, 1, 1)
        closed = part.rlike(f"^(?:{_CLOSED})\\z")
        tail = F.when(closed, F.concat(F.repeat(F.lit(" "), F.length(part) - 2), sign)).otherwise(
            F.repeat(F.lit(" "), F.length(part) - 1 + F.when(part.rlike(r"(?<!\\)(?:\\\\)*+\\\z"), 1).otherwise(0))
        )
        return F.when(sign.isin(*_SIGNS), F.concat(sign, tail)).otherwise(part)

    return F.array_join(F.transform(segments, blanked), "")


# One closed literal per match. An escape hides the next character except a
# line break, and an opening sign with no partner is stepped over.
def _literal(sign: str) -> str:
    return f"{sign}[^{sign}\\\\]*+(?:\\\\[^\\n\\r\\x{{2028}}\\x{{2029}}][^{sign}\\\\]*+)*+{sign}"


_LITERAL = "|".join(_literal(s) for s in _SIGNS)


def string_literals(text: Column) -> Column:
    """Bodies of the non-empty quoted literals, in order."""
    whole = F.regexp_extract_all(text, F.lit(_LITERAL), F.lit(0))
    return F.transform(
        F.filter(whole, lambda q: F.length(q) > 2), lambda q: q.substr(F.lit(2), F.length(q) - 2)
    )


def shannon_entropy(value: Column) -> Column:
    """Bits per character; 0 for empty text.

    Counts are taken over the distinct characters, so the work per value is
    its length times its alphabet, all inside the row.
    """
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.length(value)
    counts = F.transform(
        F.array_distinct(chars), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))
    )

    def add(acc: Column, count: Column) -> Column:
        share = count / size
        return acc - share * F.log2(share)

    return F.when(size > 0, F.aggregate(counts, F.lit(0.0), add)).otherwise(F.lit(0.0))


def pascal_case(rule_id: Column) -> Column:
    parts = F.filter(F.split(rule_id, "[^A-Za-z0-9]+"), lambda p: p != "")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), ""
    )


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_cell(text: Column) -> Column:
    """Keep a value inside one markdown table cell."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), "\r?\n", " ")


def plural(count: Column, word: str) -> Column:
    return F.when(count == 1, F.lit(word)).otherwise(F.lit(word + "s"))


def duration_text(millis: Column) -> Column:
    return F.when(millis < 1000, F.concat(millis.cast("string"), F.lit("ms"))).otherwise(
        F.concat(F.format_string("%.1f", millis / 1000.0), F.lit("s"))
    )


def words_wrapped(text: Column, indent: int, width: int = 88) -> Column:
    """Greedy word wrap with a left margin, as an array of lines."""
    words = F.filter(F.split(text, java(r"\s+")), lambda w: w != "")
    start = F.array().cast("array<string>")

    def place(lines: Column, word: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = F.length(last) + 1 + F.length(word) + indent <= width
        return F.when(
            last.isNotNull() & fits,
            F.concat(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.concat_ws(" ", last, word))),
        ).otherwise(F.concat(lines, F.array(word)))

    return F.transform(F.aggregate(words, start, place), lambda l: F.concat(F.lit(" " * indent), l))


