"""String helpers built only from JVM-side expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
NON_WORD = r"[^a-zA-Z0-9_\p{L}\p{N}]+"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
#: a boundary next to something that is known to be a word character
BEFORE_WORD = rf"(?<!{WORD})"
AFTER_WORD = rf"(?!{WORD})"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: every character that counts as white space when stripping
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _alternatives(body: str) -> list[str] | None:
    """What stands between the bars of ``body`` outside all brackets; NULL if a bracket of the text around it closes in it."""
    parts, depth = [""], 0
    for piece in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", body, re.S):
        depth += (piece == "(") - (piece == ")")
        if depth < 0:
            return None
        if piece == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += piece
    return parts


def _first_letters(pattern: str) -> str:
    """The same pattern, which looks at the next letter before it looks back for a word boundary.

    That is for ``\\b(...|...)`` with alternatives that begin with a letter each, and for ``\\b[A-Z]``.
    """
    found = re.fullmatch(r"((?:\(\?i\))?)(\\b(?:(\[A-Z\].*)|\((?:\?:)?(.*)\)(?:\\b|\s\+year\\b)?))", pattern, re.S)
    if not found:
        return pattern
    flag, rest, by_class, body = found.groups()
    if by_class:
        return f"{flag}(?=[A-Z]){rest}"
    parts = _alternatives(body)
    if parts is None or not all(re.match(r"[A-Za-z](?![?*{])", p) for p in parts):
        return pattern
    return f"{flag}(?=[{''.join(sorted({p[0] for p in parts}))}]){rest}"


def java_regex(pattern: str) -> str:
    """Unicode word boundaries and spaces; only ``\\n`` ends a line.

    A boundary needs one look-around where its neighbour in the pattern is a word character,
    and both only next to a class that also has other characters.
    """
    out = _first_letters(pattern).replace(r"\\", "\x00")
    if r"\-]" in out:
        out = out.replace(r"\b", BOUNDARY)
    out = out.replace(r"\.\b", rf"\.(?={WORD})")
    out = re.sub(r"\\b(?=[A-Za-z0-9\[]|\((?!\?!))", lambda _: BEFORE_WORD, out).replace(r"\b", AFTER_WORD)
    return "(?d)" + out.replace(r"\s", SPACE).replace(r"\w", WORD).replace("\x00", r"\\")


def matches(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, F.lit(java_regex(pattern)))


def matches_any(col: Column, patterns: list[str]) -> Column:
    if all(re.match(r"\\b[a-z](?![?*{|])", p) and _alternatives(p) == [p] for p in patterns):
        # one boundary for all of them
        return matches(col, r"\b(?:" + "|".join(p[2:] for p in patterns) + ")")
    return matches(col, "(?:" + "|".join(patterns) + ")")


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """First match or NULL (a match is never empty for the patterns used here)."""
    return F.nullif(F.regexp_extract(col, java_regex(pattern), group), F.lit(""))


def all_matches(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(java_regex(pattern)), F.lit(group))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def strip_markup(col: Column) -> Column:
    return F.btrim(strip(col), F.lit(fv.MARKUP_CHARS))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def text_or_null(col: Column) -> Column:
    """Empty string counts as missing."""
    return F.when(col != "", col)


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, conditions)


def contains_any(col: Column, words: list[str]) -> Column:
    return any_of([F.contains(col, F.lit(w)) for w in words])


def first_group(col: Column, groups: dict[str, list[str]], default: str | None = None) -> Column:
    """Name of the first group one of whose words is a substring of ``col``."""
    case = None
    for name, words in groups.items():
        cond = contains_any(col, words)
        case = F.when(cond, name) if case is None else case.when(cond, name)
    return case.otherwise(F.lit(default))


def words(col: Column) -> Column:
    """Lower-case word tokens, without synonyms."""
    return F.filter(F.split(F.lower(col), NON_WORD), lambda t: t != "")


def canonical(token: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in fv.SYNONYMS.items() for x in pair])
    return F.coalesce(F.element_at(mapping, token), token)


def tokenize(col: Column) -> Column:
    """Lower-case word tokens with synonyms mapped to their canonical form."""
    return F.transform(words(col), canonical)


def expand_abbreviations(col: Column, abbreviations: dict[str, str]) -> Column:
    """Whole-word, case-insensitive replacement, but not in front of a number."""
    for short, full in abbreviations.items():
        pattern = java_regex(rf"(?iu)\b{_escape(short)}\b(?!\s*-?\s*\d)")
        col = F.regexp_replace(col, F.lit(pattern), F.lit(full.replace("\\", r"\\").replace("$", r"\$")))
    return col


def _escape(literal: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in literal)


def contains_either(a: Column, b: Column) -> Column:
    """One lowered string contains the other; false when either is missing or empty."""
    x, y = F.lower(a), F.lower(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))
