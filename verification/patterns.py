"""DuckDB forms of the fixed values: every list and pattern in the SQL is made from ``fixed_values`` here."""

from __future__ import annotations

# what stands before a word, after it, and a word character (RE2 knows \b for ASCII only)
BEFORE, AFTER, WORD = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])", r"[\p{L}\p{N}_]"


def bounded(pattern: str, capture: bool = False) -> str:
    """A pattern whose outer ``\\b`` become groups; ``capture`` puts what lies between in a group of its own."""
    flags = pattern[:4] if pattern.startswith("(?i)") else ""
    body = pattern[len(flags):]
    start, end = body.startswith(r"\b"), body.endswith(r"\b")
    body = body[2 if start else 0:-2 if end else None]
    # after a full stop a boundary means that a word goes on
    close = "" if not end else WORD if body.endswith(r"\.") else AFTER
    return flags + (BEFORE if start else "") + (f"({body})" if capture else body) + close


def any_of(patterns: list[str]) -> str:
    return "|".join(bounded(p) for p in patterns)


def contains_any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def first_name(text: str, lists: dict[str, list[str]], other: str | None = None, names: dict[str, str] | None = None) -> str:
    """case expression: the name of the first list with a word in ``text``."""
    cases = " ".join(f"when {contains_any(text, words)} then '{(names or {}).get(name, name)}'" for name, words in lists.items())
    return f"case {cases}" + (f" else '{other}'" if other else "") + " end"


def values(rows: list[tuple]) -> str:
    def cell(x) -> str:
        return str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
