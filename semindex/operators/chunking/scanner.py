"""Brace languages: declarations found by expressions on text whose strings and comments are blank.

Exact for the usual forms of declarations; a declaration that macros or unusual line breaks hide is
not seen and stays part of what surrounds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from semindex.operators.chunking.model import Lines, Piece, whole

_PARTS = {
    "block": r"/\*.*?(?:\*/|\Z)",
    "line": r"//[^\n]*",
    "hash": r"#[^\n]*",
    "double": r'"(?:\\.|[^"\\\n])*"?',
    "single": r"'(?:\\.|[^'\\\n])*'?",
    "char": r"'(?:\\[^\n]{1,8}?|[^'\\\n])'",
    "template": r"`(?:\\.|[^`\\])*`?",
    "raw": r"`[^`]*`?",
    "rustraw": r'r(#*)".*?"\1',
    "triple": r'""".*?(?:"""|\Z)',
    "verbatim": r'@"(?:""|[^"])*"',
    "regex": r"(?<=[=(,:;!&|?{}\[])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
}


def blank(text: str, parts: tuple[str, ...]) -> str:
    """The text with those parts replaced by spaces, line breaks kept."""
    groups = "|".join(f"(?:{_PARTS[p]})" for p in parts)
    return re.sub(groups, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


_CLOSE = {"{": "}", "(": ")", "[": "]"}


def closing(code: str, at: int) -> int:
    """Offset after the bracket that closes the one at ``at``; the end of the text if none does."""
    opening, ends = code[at], _CLOSE[code[at]]
    depth = 0
    for m in re.compile(f"[{re.escape(opening + ends)}]").finditer(code, at):
        depth += 1 if m[0] == opening else -1
        if not depth:
            return m.end()
    return len(code)


def body_end(code: str, at: int, stop: int) -> int | None:
    """End of what starts before ``at``: after its braces, or after a semicolon that comes first."""
    depth = 0
    for m in re.compile(r"[{};()\[\]]").finditer(code, at, stop):
        if m[0] in "([":
            depth += 1
        elif m[0] in ")]":
            depth -= 1
        elif depth <= 0:
            return closing(code, m.start()) if m[0] == "{" else m.end() if m[0] == ";" else None
    return None


def braces_only(code: str, at: int, stop: int) -> int | None:
    """Like body_end, but what ends at a semicolon is no declaration."""
    end = body_end(code, at, stop)
    return end if end is not None and code[end - 1] == "}" else None


def before_semicolon(code: str, at: int, stop: int) -> int | None:
    end = body_end(code, at, stop)
    return None if end is None else end - 1 if code[end - 1] == ";" else end


@dataclass
class Rule:
    node_type: str
    pattern: str  # group ``name`` names the chunk; group ``at``, if any, is where the node starts
    end: Callable[[str, int, int], int | None] = braces_only
    member: bool = False  # only directly in a class
    flags: Callable[[re.Match, str], set[str]] | None = None

    def __post_init__(self) -> None:
        self.regex = re.compile(self.pattern, re.M)


@dataclass
class Language:
    blanks: tuple[str, ...]
    rules: tuple[Rule, ...]
    classes: tuple[str, ...] = ("class_declaration",)


def pieces(text: str, language: Language) -> list[Piece]:
    code, lines, found = blank(text, language.blanks), Lines(text), []

    def scan(at: int, stop: int, parent: str | None, in_class: bool) -> None:
        ahead: dict[int, re.Match | None] = {}
        while at < stop:
            best = None
            for i, rule in enumerate(language.rules):
                if rule.member and not in_class:
                    continue
                m = ahead.get(i, False)
                if m is False or (m is not None and start_of(m) < at):
                    m = rule.regex.search(code, at, stop)
                    while m is not None and (end := rule.end(code, m.end(), stop)) is None:
                        m = rule.regex.search(code, m.start() + 1, stop)
                    ahead[i] = m
                if m is not None and (best is None or start_of(m) < start_of(best[1])):
                    best = (rule, m, rule.end(code, m.end(), stop))
            if best is None:
                return
            rule, m, end = best
            start = start_of(m)
            name = m.groupdict().get("name")
            flags = rule.flags(m, text[start:end]) if rule.flags else set()
            found.append(lines.piece(rule.node_type, start, end, name=name, parent_name=parent, flags=flags))
            if rule.node_type in language.classes:
                opened = code.find("{", m.start(), end)
                if opened >= 0:
                    scan(opened + 1, end - 1, name, True)
            at = max(end, start + 1)

    def start_of(m: re.Match) -> int:
        return m.start("at") if "at" in m.re.groupindex and m["at"] is not None else m.start()

    scan(0, len(code), None, False)
    return found or whole(text)


# --- JavaScript and relatives ------------------------------------------------------------------


def _async(m: re.Match, content: str) -> set[str]:
    return {"async"} if re.match(r"async\b", content) else set()


def _generator(m: re.Match, content: str) -> set[str]:
    return _async(m, content) | {"generator"}


def _component(m: re.Match, content: str) -> set[str]:
    shown = "<" in content and ("jsx" in content.lower() or "return" in content)
    return _async(m, content) | ({"component"} if shown else set())


def _generic(m: re.Match, content: str) -> set[str]:
    return _async(m, content) | ({"generic"} if re.match(r"[^({=;]*?\b" + re.escape(m.groupdict().get("name") or "function") + r"\s*<", content) else set())


def arrow_end(code: str, at: int, stop: int) -> int | None:
    """End of an arrow function's body: a block, or an expression up to what closes or follows it."""
    m = re.compile(r"\s*").match(code, at, stop)
    at = m.end()
    if at < stop and code[at] == "{":
        return closing(code, at)
    depth = 0
    for m in re.compile(r"[{}()\[\],;\n]").finditer(code, at, stop):
        if m[0] in "{([":
            depth += 1
        elif m[0] in "})]":
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and (m[0] in ",;" or not re.compile(r"\s*[.?:&|+*/=-]").match(code, m.end(), stop)):
            return m.start()
    return stop


_ID = r"[A-Za-z_$][\w$]*"
_PARAMS = r"\((?:[^()]|\([^()]*\))*\)"
_STATEMENT = r"(?:^|(?<=[;{}])|\bexport(?:\s+default)?\b)[ \t]*"


def _script(function_flags, generic=None) -> list[Rule]:
    typed = generic or function_flags
    return [
        Rule("generator_function_declaration", rf"{_STATEMENT}(?P<at>(?:async\s+)?function\s*\*\s*(?P<name>{_ID}))", flags=_generator),
        Rule("function_declaration", rf"{_STATEMENT}(?P<at>(?:async\s+)?function\s+(?P<name>{_ID}))", flags=typed),
        Rule("generator_function", r"(?P<at>\b(?:async\s+)?function\s*\*)", flags=_generator),
        Rule("function", rf"(?P<at>\b(?:async\s+)?function\b(?:\s+(?P<name>{_ID}))?\s*(?=\())", flags=function_flags),
        Rule("arrow_function", rf"(?P<at>(?:\basync\s+)?(?:{_PARAMS}(?:\s*:\s*[\w<>\[\]|., ]+?)?|(?<![\w$.])(?P<name>{_ID}))\s*=>)", arrow_end, flags=function_flags),
        Rule("class_declaration", rf"(?P<at>(?:\babstract\s+)?\bclass\s+(?P<name>{_ID}))", flags=generic),
        Rule("method_definition", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|return|function|with|else|do|new)\b)[#]?{_ID}\s*(?:<[^>(]*>)?\s*(?=\())", member=True, flags=_async),
    ]


_JS_BLANKS = ("block", "line", "template", "double", "single", "regex")
_JSX = [
    Rule("jsx_element", r"(?:(?<=[(=,?:&|>])|\breturn\b)\s*(?P<at><(?P<tag>[A-Za-z][\w.:-]*)(?=[\s>]))", lambda code, at, stop: _jsx_end(code, at, stop, False)),
    Rule("jsx_self_closing_element", r"(?:(?<=[(=,?:&|>])|\breturn\b)\s*(?P<at><[A-Za-z][\w.:-]*(?=[\s/]))", lambda code, at, stop: _jsx_end(code, at, stop, True)),
]


def _jsx_end(code: str, at: int, stop: int, closed: bool) -> int | None:
    """End of an element whose name ends at ``at``; None if it is of the other kind."""
    tag = re.search(r"[\w.:-]+$", code[:at])[0]
    depth = 0
    for m in re.compile(r"[{}>]").finditer(code, at, stop):
        depth += (m[0] == "{") - (m[0] == "}")
        if m[0] == ">" and depth == 0 and code[m.start() - 1] != "=":
            self_closed = code[m.start() - 1] == "/"
            if self_closed or closed:
                return m.end() if self_closed and closed else None
            level = 1
            for t in re.compile(rf"<(/?){re.escape(tag)}\b([^<>]*?)(/?)>").finditer(code, m.end(), stop):
                level += -1 if t[1] else 0 if t[3] else 1
                if not level:
                    return t.end()
            return None
    return None


_TS = [
    Rule("interface_declaration", rf"(?P<at>\binterface\s+(?P<name>{_ID}))(?=[^;(=]*\{{)", flags=_generic),
    Rule("type_alias_declaration", rf"{_STATEMENT}(?P<at>type\s+(?P<name>{_ID})\s*(?:<[^=]*>)?\s*(?==))", body_end, flags=_generic),
    Rule("enum_declaration", rf"(?P<at>(?:\bconst\s+)?\benum\s+(?P<name>{_ID}))", flags=_generic),
]

# --- others ------------------------------------------------------------------------------------

_JMOD = r"(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|static|final|abstract|sealed|native|synchronized|default|strictfp|transient|volatile)\s+)*"
_CSMOD = r"(?:(?:public|private|protected|internal|static|virtual|abstract|override|async|sealed|partial|readonly|extern|new|unsafe)\s+)*"
_TYPE = r"[\w.<>\[\],?:]+(?:\s*<[^;{}()]*>)?(?:\[\])*"
_NOT = r"(?!(?:if|for|while|switch|catch|return|new|else|throw|using|lock|foreach|sizeof|do|case|delete|typedef|namespace|struct|class|enum|union)\b)"


def _typed(m: re.Match, content: str) -> set[str]:
    head = re.split(r"[({=;]", content, maxsplit=1)[0]
    return ({"generic"} if "<" in head[head.rfind(m.groupdict().get("name") or "\0") :] and m.groupdict().get("name") else set()) | ({"async"} if re.search(r"\basync\b", head) else set())


def _rust_async(m: re.Match, content: str) -> set[str]:
    return {"async"} if re.match(r"(?:pub(?:\([^)]*\))?\s+)?async\s+fn\b", content) else set()


LANGUAGES = {
    "javascript": Language(_JS_BLANKS, tuple(_script(_async))),
    "jsx": Language(_JS_BLANKS, (*_script(_component), *_JSX)),
    "typescript": Language(_JS_BLANKS, (*_script(_async, _generic), *_TS)),
    "tsx": Language(_JS_BLANKS, (*_script(_async, _generic), *_TS)),
    "go": Language(
        ("block", "line", "raw", "double", "char"),
        (
            Rule("method_declaration", r"^(?P<at>func\s+\([^)]*\)\s*\w+)"),
            Rule("function_declaration", r"^(?P<at>func\s+(?P<name>\w+))"),
            Rule("type_declaration", r"^(?P<at>type\s+\()", lambda code, at, stop: closing(code, at - 1)),
            Rule("type_declaration", r"^(?P<at>type\s+\w+[^\n{(]*)", lambda code, at, stop: closing(code, at) if code[at : at + 1] == "{" else at),
        ),
        (),
    ),
    "rust": Language(
        ("block", "line", "rustraw", "double", "char"),
        (
            Rule("function_item", r"(?P<at>(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:async|const|unsafe|extern)\s+)*\bfn\s+(?P<name>\w+))", flags=_rust_async),
            Rule("struct_item", r"(?P<at>(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>\w+))", body_end),
            Rule("enum_item", r"(?P<at>(?:\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>\w+))"),
            Rule("trait_item", r"(?P<at>(?:\bpub(?:\([^)]*\))?\s+)?(?:\bunsafe\s+)?\btrait\s+(?P<name>\w+))"),
            Rule("impl_item", r"(?P<at>(?:\bunsafe\s+)?\bimpl\b(?:\s*<[^{]*?>)?\s+!?(?P<name>\w+)?)"),
            Rule("mod_item", r"(?P<at>(?:\bpub(?:\([^)]*\))?\s+)?\bmod\s+(?P<name>\w+))", body_end),
            Rule("macro_definition", r"(?P<at>\bmacro_rules!\s*(?P<name>\w+))", body_end),
        ),
        (),
    ),
    "java": Language(
        ("block", "line", "triple", "double", "char"),
        (
            Rule("class_declaration", rf"(?P<at>{_JMOD}\bclass\s+(?P<name>\w+))", flags=_typed),
            Rule("annotation_type_declaration", rf"(?P<at>{_JMOD}@interface\s+(?P<name>\w+))"),
            Rule("interface_declaration", rf"(?P<at>{_JMOD}(?<!@)\binterface\s+(?P<name>\w+))", flags=_typed),
            Rule("enum_declaration", rf"(?P<at>{_JMOD}\benum\s+(?P<name>\w+))"),
            Rule("constructor_declaration", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>{_JMOD}(?:<[^>]*>\s*)?{_NOT}(?P<name>[A-Z]\w*)\s*(?=\())", member=True),
            Rule("method_declaration", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>{_JMOD}(?:<[^>]*>\s*)?{_NOT}{_TYPE}\s+(?P<name>\w+)\s*(?=\())", body_end, member=True, flags=lambda m, c: {"generic"} if re.match(rf"{_JMOD}<", c) else set()),
        ),
    ),
    "c": Language(
        ("block", "line", "double", "char"),
        (
            Rule("type_definition", r"(?P<at>\btypedef\b)", body_end),
            Rule("function_definition", rf"(?:^|(?<=[;}}]))[ \t]*(?P<at>{_NOT}(?:[A-Za-z_]\w*[ \t\n]+)+(?P<name>[A-Za-z_]\w*)\s*\([^;{{}}]*\)\s*(?=\{{))"),
            Rule("function_definition", rf"(?:^|(?<=[;}}]))[ \t]*(?P<at>{_NOT}(?:[A-Za-z_]\w*[ \t\n]+)*[A-Za-z_]\w*[ \t\n]*\*+\s*[A-Za-z_]\w*\s*\([^;{{}}]*\)\s*(?=\{{))"),
            *[Rule(f"{k}_specifier", rf"(?P<at>\b{k}\b(?:\s+(?P<name>[A-Za-z_]\w*))?)", lambda code, at, stop: _specifier_end(code, at)) for k in ("struct", "union", "enum")],
        ),
        (),
    ),
    "cpp": Language(
        ("block", "line", "double", "char"),
        (
            Rule("template_declaration", r"(?P<at>\btemplate\s*<[^{;]*?>\s*(?:requires[^{;]*?)?(?:class|struct)\s+(?P<name>\w+))", body_end),
            Rule("template_declaration", r"(?P<at>\btemplate\s*<[^{;]*?>[^{;(]*?(?P<name>\w+)\s*(?=\())", body_end),
            Rule("concept_definition", r"(?P<at>\bconcept\s+\w+)", body_end),
            Rule("namespace_definition", r"(?P<at>\bnamespace\b(?:\s+(?P<name>\w+))?)"),
            Rule("class_specifier", r"(?P<at>(?<!enum )\bclass\s+(?P<name>\w+))(?=[^;()]*\{)"),
            Rule("function_definition", rf"(?:^|(?<=[;}}]))[ \t]*(?P<at>{_NOT}(?:[A-Za-z_][\w:<>,&]*[ \t\n&]+)+(?P<name>[A-Za-z_~][\w:~]*)\s*\([^;{{}}]*\)[^;{{}}()]*(?=\{{))"),
            *[Rule(f"{k}_specifier", rf"(?P<at>\b{k}\b(?:\s+class)?(?:\s+(?P<name>[A-Za-z_]\w*))?)(?=[^;(){{}}]*\{{)", lambda code, at, stop: closing(code, code.index("{", at))) for k in ("struct", "union", "enum")],
        ),
        (),
    ),
    "csharp": Language(
        ("block", "line", "verbatim", "double", "char"),
        (
            Rule("namespace_declaration", r"(?P<at>\bnamespace\s+[\w.]+)(?=\s*\{)"),
            Rule("class_declaration", rf"(?P<at>{_CSMOD}\bclass\s+(?P<name>\w+))", flags=_typed),
            Rule("struct_declaration", rf"(?P<at>{_CSMOD}\bstruct\s+(?P<name>\w+))", flags=_typed),
            Rule("interface_declaration", rf"(?P<at>{_CSMOD}\binterface\s+(?P<name>\w+))", flags=_typed),
            Rule("enum_declaration", rf"(?P<at>{_CSMOD}\benum\s+(?P<name>\w+))"),
            Rule("destructor_declaration", r"(?P<at>~(?P<name>\w+)\s*(?=\())", member=True),
            Rule("event_declaration", rf"(?P<at>{_CSMOD}\bevent\s+{_TYPE}\s+(?P<name>\w+)\s*(?=\{{))", member=True),
            Rule("constructor_declaration", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>{_CSMOD}{_NOT}(?P<name>[A-Z]\w*)\s*(?=\())", body_end, member=True),
            Rule("method_declaration", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>{_CSMOD}{_NOT}{_TYPE}\s+(?P<name>\w+)\s*(?:<[^>(]*>\s*)?(?=\())", body_end, member=True, flags=_typed),
            Rule("property_declaration", rf"(?:^|(?<=[;{{}}]))\s*(?P<at>{_CSMOD}{_NOT}{_TYPE}\s+(?P<name>\w+)\s*(?=\{{|=>))", body_end, member=True),
        ),
    ),
    "graphql": Language(
        ("hash", "triple", "double"),
        (
            Rule("operation_definition", r"^(?P<at>(?:query|mutation|subscription)\b\s*(?P<name>\w+)?)"),
            Rule("fragment_definition", r"^(?P<at>fragment\s+\w+)"),
            Rule("schema_definition", r"^(?P<at>schema\b)"),
            Rule("directive_definition", r"^(?P<at>directive\s+@\s*(?P<name>\w+))", lambda code, at, stop: _to_line_end(code, at)),
            Rule("object_type_definition", r"^(?P<at>type\s+(?P<name>\w+))"),
            Rule("interface_type_definition", r"^(?P<at>interface\s+(?P<name>\w+))"),
            Rule("input_object_type_definition", r"^(?P<at>input\s+(?P<name>\w+))"),
            Rule("enum_type_definition", r"^(?P<at>enum\s+(?P<name>\w+))"),
            Rule("union_type_definition", r"^(?P<at>union\s+(?P<name>\w+))", lambda code, at, stop: _to_line_end(code, at)),
            Rule("scalar_type_definition", r"^(?P<at>scalar\s+(?P<name>\w+))", lambda code, at, stop: _to_line_end(code, at)),
        ),
        (),
    ),
}


def _specifier_end(code: str, at: int) -> int:
    m = re.compile(r"\s*\{").match(code, at)
    return closing(code, m.end() - 1) if m else at


def _to_line_end(code: str, at: int) -> int:
    """To the end of the line, and of lines that go on with | or &."""
    m = re.compile(r"[^\n]*(?:\n\s*[|&][^\n]*)*").match(code, at)
    return at + len(m[0].rstrip())
