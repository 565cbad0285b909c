"""Shell globs as Java regular expressions (case-sensitive; * crosses slashes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = set("\\^$.|?*+()[]{}&-~# ")


def _literal(char: str) -> str:
    return f"\\{char}" if char in _QUOTED else char


def _class(body: str) -> str:
    """A bracket expression's body between [ and ]: '!' negates, '-' between two is a range."""
    negate, body = (body.startswith("!"), body.removeprefix("!"))
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:
                out.append(f"{_literal(body[i])}-{_literal(body[i + 2])}")
            i += 3
        else:
            out.append(_literal(body[i]))
            i += 1
    if not out:
        return "(?s:.)" if negate else "(?!)"
    return f"[{'^' if negate else ''}{''.join(out)}]"


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        char = pattern[i]
        if char == "*":
            if out[-1:] != [".*"]:
                out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[":
            # a ] right after the opening (or its !) is a member
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))
            if end < 0:
                out.append("\\[")
            else:
                out.append(_class(pattern[i + 1 : end]))
                i = end
        else:
            out.append(_literal(char))
        i += 1
    return f"(?s:\\A{''.join(out)}\\z)"


def matches_globs(path: Column, patterns: list[str] | str) -> Column:
    """Does any pattern match the path, the end of the path, or the file name? Null never does."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    slashed = F.translate(path, "\\", "/")
    name = F.element_at(F.split(slashed, "/"), -1)
    found = F.lit(False)
    for p in patterns:
        p = p.replace("\\", "/")
        found = found | slashed.rlike(glob_regex(p)) | name.rlike(glob_regex(p))
        if not p.startswith(("/", "./")):
            found = found | slashed.rlike(glob_regex(f"*/{p}"))
    return F.coalesce(found, F.lit(False))
