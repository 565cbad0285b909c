"""What a chunker returns, and the contract that all of them share.

A splittable node becomes a chunk. Below a chunk only classes are looked into, and what is found
there carries the class's name as its parent. Other nodes are looked into until a splittable one
turns up. A text without any chunk, but not blank, is one ``module`` chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Piece:
    node_type: str
    content: str
    start_line: int
    end_line: int
    name: str | None = None
    parent_name: str | None = None
    docstring: str | None = None
    decorators: list[str] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)  # async, generator, export, generic, component


class Lines:
    """Offsets to line numbers."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def number(self, offset: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, offset)

    def piece(self, node_type: str, start: int, end: int, **more) -> Piece:
        return Piece(node_type, self.text[start:end], self.number(start), self.number(max(start, end - 1)), **more)


def whole(text: str) -> list[Piece]:
    return [Piece("module", text, 1, text.count("\n") + 1)] if text.strip() else []
