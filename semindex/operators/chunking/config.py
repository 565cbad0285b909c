"""CSS, JSON, YAML and TOML: outermost rules, pairs and tables."""

from __future__ import annotations

import re

from semindex.operators.chunking.model import Lines, Piece, whole
from semindex.operators.chunking.scanner import blank, closing

_AT_RULES = {"@media": "media_statement", "@keyframes": "keyframes_statement", "@supports": "supports_statement"}


def css_pieces(text: str) -> list[Piece]:
    code, lines, found, at = blank(text, ("block", "double", "single")), Lines(text), [], 0
    for m in iter(lambda: re.compile(r"[^\s{};][^{};]*").search(code, at), None):
        start, end = m.start(), m.end()
        prelude = text[start:end].strip()
        if code[end : end + 1] == "{":
            end = closing(code, end)
        elif code[end : end + 1] == ";":
            end += 1
        at = end
        word = re.match(r"@[\w-]+", prelude)
        if word:
            kind = next((k for w, k in _AT_RULES.items() if word[0].endswith(w[1:])), "at_rule")
            if word[0] not in ("@import", "@charset", "@namespace"):
                found.append(lines.piece(kind, start, end, name=prelude if kind == "at_rule" else None))
        elif code[end - 1 : end] == "}":
            found.append(lines.piece("rule_set", start, end, name=prelude))
    return found or whole(text)


_JSON_STRING = re.compile(r'"(?:\\.|[^"\\])*"', re.S)


def json_pieces(text: str) -> list[Piece]:
    """Pairs of top-level objects and top-level arrays; several documents may follow each other."""
    code, lines, found, at = blank(text, ("double",)), Lines(text), [], 0
    while m := re.compile(r"[\[{]").search(code, at):
        at = closing(code, m.start())
        if m[0] == "[":
            found.append(lines.piece("array", m.start(), at))
            continue
        inner = m.start() + 1
        while key := _JSON_STRING.search(text, inner, at):
            end = key.end()
            while end < at and (code[end] not in ",}" or end < key.end()):
                end = closing(code, end) if code[end] in "[{" else end + 1
            stop = len(text[:end].rstrip())
            found.append(lines.piece("pair", key.start(), stop, name=key[0].strip().strip('"')))
            inner = end + 1
    return found or whole(text)


def yaml_pieces(text: str) -> list[Piece]:
    """The outermost mapping or sequence of each document."""
    lines, found, at = Lines(text), [], 0
    for part in re.split(r"(?m)^(?:---|\.\.\.)[ \t]*(?:#.*)?$\n?", text):
        at = text.index(part, at)
        kept = [m for m in re.finditer(r"(?m)^[^\n]*$", part) if (s := m[0].strip()) and not s.startswith(("#", "%"))]
        if kept:
            first = kept[0]
            start, end = at + first.start() + len(first[0]) - len(first[0].lstrip()), at + kept[-1].end()
            head = text[start:end]
            kind = "flow_mapping" if head[0] == "{" else "flow_sequence" if head[0] == "[" else "block_sequence" if re.match(r"-(\s|$)", head) else "block_mapping" if re.match(r"(\"[^\"\n]*\"|'[^'\n]*'|[^#\n]*?):(\s|$)", head) else None
            if kind:
                found.append(lines.piece(kind, start, end))
        at += len(part)
    return found or whole(text)


_TOML_STRINGS = re.compile(r'""".*?"""|\'\'\'.*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'[^\'\n]*\'|#[^\n]*', re.S)


def toml_pieces(text: str) -> list[Piece]:
    """Tables with their pairs, and pairs before the first table."""
    code = _TOML_STRINGS.sub(lambda m: re.sub(r"[^\n]", "_" if m[0][0] != "#" else " ", m[0]), text)
    lines, found = Lines(text), []
    heads = list(re.finditer(r"(?m)^[ \t]*(\[\[?)[^\[\]\n]+\]\]?[ \t]*$", code))
    first = heads[0].start() if heads else len(code)
    at = 0
    while m := re.compile(r"(?m)^[ \t]*([^\s=\[][^=\n]*)=[ \t]*").search(code, at, first):
        end = m.end()
        end = closing(code, end) if code[end : end + 1] in ("[", "{") else code.find("\n", end) if "\n" in code[end:first] else first
        found.append(lines.piece("pair", m.start(1), len(text[: max(end, m.end())].rstrip()), name=text[m.start(1) : m.end(1)].strip()))
        at = max(end, m.end())
    for m, stop in zip(heads, [*[h.start() for h in heads[1:]], len(code)], strict=True):
        start = m.start(1)
        end = len(code[:stop].rstrip())
        found.append(lines.piece("table_array" if m[1] == "[[" else "table", start, end, name=text[start : text.find("\n", start) if "\n" in text[start:] else len(text)].strip().strip("[]").strip()))
    return found or whole(text)
