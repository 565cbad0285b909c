"""Plain text and Markdown."""

from __future__ import annotations

import re

from semindex.operators.chunking.model import Piece

MAX_LINES, MAX_CHARS = 200, 8000


def text_pieces(text: str, file_name: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> list[Piece]:
    """Runs of whole lines within both bounds; a longer line stands alone. Named file:number."""
    if not text.strip():
        return []
    lines = text.splitlines()
    cuts, used = [0], 0
    for i, line in enumerate(lines):
        size = len(line) + 1
        if i > cuts[-1] and (used + size > max_chars or i - cuts[-1] >= max_lines):
            cuts.append(i)
            used = 0
        used += size
    spans = zip(cuts, [*cuts[1:], len(lines)], strict=True)
    return [Piece("text", "\n".join(lines[a:b]), a + 1, b, name=f"{file_name}:{n}") for n, (a, b) in enumerate(spans, 1)]


_HEADING = re.compile(r" {0,3}(#{1,6})(?=[ \t]|$)(.*)$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def markdown_pieces(text: str) -> list[Piece]:
    """Sections from one ATX heading to the next, whatever their levels; a preamble before them."""
    if not text.strip():
        return []
    lines = text.split("\n")
    heads: list[tuple[int, str]] = []
    fence = None
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            if fence is None:
                fence = m[1]
            elif m[1].startswith(fence):
                fence = None
        elif fence is None and (m := _HEADING.match(line)):
            heads.append((i, m[2].lstrip("#").strip()))
    if not heads:
        return [Piece("document", text, 1, len(lines), name="Document")]
    ends = [i for i, _ in heads[1:]] + [len(lines)]
    found = [Piece("section", "\n".join(lines[i:end]), i + 1, end, name=title or None) for (i, title), end in zip(heads, ends, strict=True)]
    if before := "\n".join(lines[: heads[0][0]]).strip():
        found.insert(0, Piece("preamble", before, 1, heads[0][0], name="Preamble"))
    return found
