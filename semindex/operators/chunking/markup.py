"""HTML, XML and their relatives: outermost elements."""

from __future__ import annotations

import re

from semindex.operators.chunking.model import Lines, Piece, whole

# HTML elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<!doctype[^>\[]*(?:\[.*?\])?[^>]*>"
    r"|<(?P<close>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|\{[^{}]*\}|[^<>\"'{}])*?)(?P<self>/?)>",
    re.S | re.I,
)


def _elements(text: str, at: int, html: bool, pieces: list[Piece], lines: Lines, keep: dict[str, str]) -> None:
    """Outermost elements from ``at`` on; ``keep`` says which other constructs are chunks."""
    stack: list[tuple[str, int]] = []
    while m := _TAG.search(text, at):
        at = m.end()
        name = m["name"]
        if name is None:
            kind = next((node for start, node in keep.items() if m[0].lower().startswith(start)), None)
            if kind and not stack:
                pieces.append(lines.piece(kind, m.start(), m.end()))
            continue
        low = name.lower() if html else name
        if m["close"]:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == low), None)
            if opened is not None:
                if opened == 0:
                    pieces.append(lines.piece("element", stack[0][1], m.end(), name=text_name(text, stack[0][1])))
                del stack[opened:]
        elif m["self"] or (html and low in VOID):
            if not stack:
                pieces.append(lines.piece("element", m.start(), m.end(), name=name))
        elif html and low in ("script", "style"):
            end = re.compile(rf"</{low}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            if not stack:
                pieces.append(lines.piece(f"{low}_element", m.start(), at, name=name))
        else:
            stack.append((low, m.start()))
    if stack:  # an element that isn't closed reaches to the end
        pieces.append(lines.piece("element", stack[0][1], len(text.rstrip()), name=text_name(text, stack[0][1])))


def text_name(text: str, at: int) -> str:
    return re.compile(r"<([\w:.-]+)").match(text, at)[1]


def html_pieces(text: str) -> list[Piece]:
    found: list[Piece] = []
    _elements(text, 0, True, found, Lines(text), {})
    return found or whole(text)


def xml_pieces(text: str) -> list[Piece]:
    found: list[Piece] = []
    _elements(text, 0, False, found, Lines(text), {"<![cdata[": "cdata_section", "<?xml ": "", "<?": "processing_instruction", "<!doctype": "doctype"})
    return [p for p in found if p.node_type] or whole(text)


def svelte_pieces(text: str) -> list[Piece]:
    """Script and style elements; the code in them stays whole."""
    lines, found = Lines(text), []
    for m in re.finditer(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", text, re.S | re.I):
        found.append(lines.piece(f"{m[1].lower()}_element", m.start(), m.end()))
    return found or whole(text)


def astro_pieces(text: str) -> list[Piece]:
    lines, found, at = Lines(text), [], 0
    if m := re.match(r"\s*(---\r?\n.*?\n---)(?=\r?\n|\Z)", text, re.S):
        found.append(lines.piece("frontmatter", m.start(1), m.end(1)))
        at = m.end()
    _elements(text, at, True, found, lines, {})
    return found or whole(text)
