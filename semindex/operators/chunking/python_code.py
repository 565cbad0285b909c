"""Python, by its own parser."""

from __future__ import annotations

import ast

from semindex.operators.chunking.model import Lines, Piece, whole


class _Finder:
    def __init__(self, text: str) -> None:
        self.text, self.lines, self.found = text, Lines(text), []
        self.raw = text.encode()
        self.row_starts = [0]
        for row in self.raw.split(b"\n"):
            self.row_starts.append(self.row_starts[-1] + len(row) + 1)

    def span(self, node: ast.AST, from_decorator: bool) -> tuple[int, int, str]:
        line, column = node.lineno, node.col_offset
        if from_decorator:
            line, column = min((d.lineno, d.col_offset - 1) for d in node.decorator_list)
            row = self.raw[self.row_starts[line - 1] : self.row_starts[line - 1] + column + 1]
            column = row.rfind(b"@")
        a = self.row_starts[line - 1] + column
        b = self.row_starts[node.end_lineno - 1] + node.end_col_offset
        return line, node.end_lineno, self.raw[a:b].decode("utf-8", "replace")

    def docstring(self, node: ast.AST) -> str | None:
        first = node.body[0]
        if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
            return None
        value = first.value
        a = self.row_starts[value.lineno - 1] + value.col_offset
        b = self.row_starts[value.end_lineno - 1] + value.end_col_offset
        told = self.raw[a:b].decode("utf-8", "replace")
        for quote in ('"""', "'''", '"', "'"):  # a prefixed string keeps its prefix and quotes
            if told.startswith(quote):
                told = told[len(quote) : -len(quote)]
                break
        return told.strip() or None

    def visit(self, node: ast.AST, parent: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                self.add(child, parent)
            else:
                self.visit(child, parent)

    def add(self, node, parent: str | None) -> None:
        is_class, decorated = isinstance(node, ast.ClassDef), bool(node.decorator_list)
        start, end, content = self.span(node, decorated)
        kind = "decorated_definition" if decorated else "class_definition" if is_class else "function_definition"
        marks = ["@" + ast.get_source_segment(self.text, d) for d in node.decorator_list] if decorated else []
        self.found.append(Piece(kind, content, start, end, name=node.name, parent_name=parent, docstring=self.docstring(node), decorators=marks))
        if is_class and not decorated:
            for child in node.body:
                if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    self.add(child, node.name)
                else:
                    self.visit(child, node.name)


def python_pieces(text: str) -> list[Piece]:
    """Functions, classes and decorated definitions. Raises SyntaxError for what isn't Python."""
    finder = _Finder(text)
    finder.visit(ast.parse(text), None)
    return finder.found or whole(text)
