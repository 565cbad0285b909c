import pytest

from semindex.functions import rules
from semindex.operators.chunking.files import chunk_files, chunk_text
from semindex.operators.chunking.plain import markdown_pieces, text_pieces


def found(name, text):
    ending = "." + name.rsplit(".", 1)[-1]
    pieces, _, error = chunk_text(text, name, rules.ENDING_LANGUAGE.get(ending), ending in rules.TEXT_ENDINGS)
    assert error is None
    return [(p.node_type, p.name, p.start_line, p.end_line, p.parent_name) for p in pieces]


def test_python():
    code = '''import os

def f(a, b=1):
    """Told."""
    def inner(): pass
    return a

@one
@two(3)
class D:
    def hidden(self): pass

class C:
    """C doc"""
    x = 1
    def m(self): pass
    @property
    def p(self): pass
    class Inner:
        def deep(self): pass

if os:
    async def g(): ...
'''
    assert found("a.py", code) == [
        ("function_definition", "f", 3, 6, None), ("decorated_definition", "D", 8, 11, None), ("class_definition", "C", 13, 20, None),
        ("function_definition", "m", 16, 16, "C"), ("decorated_definition", "p", 17, 18, "C"), ("class_definition", "Inner", 19, 20, "C"),
        ("function_definition", "deep", 20, 20, "Inner"), ("function_definition", "g", 23, 23, None),
    ]
    pieces, *_ = chunk_text(code, "a.py", "python", False)
    assert pieces[0].docstring == "Told." and pieces[1].decorators == ["@one", "@two(3)"]
    assert pieces[1].content.startswith("@one\n@two(3)\nclass D:")
    assert found("a.py", "x = 1\n") == [("module", None, 1, 2, None)]
    assert found("a.py", "  \n") == []
    assert chunk_text("def (", "a.py", "python", False)[0] == []


def test_javascript_family():
    code = """// function no() {}
async function load(x) { return `}` + "}"; }
function* gen() { yield 1 }
const add = (a, b) => a + b;
const one = x => { return x; };
class Box extends Base {
  constructor(v) { super(v); if (v) { this.v = v } }
  async get() { return this.v }
  static of(v) { return new Box(v) }
}
"""
    assert [(k, n, p) for k, n, _, _, p in found("a.js", code)] == [
        ("function_declaration", "load", None), ("generator_function_declaration", "gen", None), ("arrow_function", None, None), ("arrow_function", "x", None),
        ("class_declaration", "Box", None), ("method_definition", None, "Box"), ("method_definition", None, "Box"), ("method_definition", None, "Box"),
    ]
    ts = "interface A { x: number }\ntype B = A | null;\nenum E { X, Y }\nexport function id<T>(x: T): T { return x }\nclass S { run(): void { } }\n"
    assert [(k, n) for k, n, *_ in found("a.ts", ts)] == [
        ("interface_declaration", "A"), ("type_alias_declaration", "B"), ("enum_declaration", "E"), ("function_declaration", "id"), ("class_declaration", "S"), ("method_definition", None),
    ]
    pieces, *_ = chunk_text(ts, "a.ts", "typescript", False)
    assert "generic" in pieces[3].flags
    pieces, *_ = chunk_text("function App() { return <div>x</div> }\nconst v = <Box a={1} />;\n", "a.jsx", "jsx", False)
    assert [p.node_type for p in pieces] == ["function_declaration", "jsx_self_closing_element"] and "component" in pieces[0].flags


@pytest.mark.parametrize(
    "name, code, want",
    [
        ("a.go", "package a\n\ntype P struct {\n\tx int\n}\ntype N int\nfunc F(a int) int { return a }\nfunc (p *P) M() string { return `}` }\n", [("type_declaration", None), ("type_declaration", None), ("function_declaration", "F"), ("method_declaration", None)]),
        ("a.rs", "pub struct P { x: i32 }\nstruct U;\nimpl P { fn m(&self) {} }\nenum E { A }\ntrait T { fn t(&self); }\nmacro_rules! mac { () => {} }\npub async fn go() {}\nmod tests { fn x() {} }\n", [("struct_item", "P"), ("struct_item", "U"), ("impl_item", "P"), ("enum_item", "E"), ("trait_item", "T"), ("macro_definition", "mac"), ("function_item", "go"), ("mod_item", "tests")]),
        ("A.java", "public class A {\n  private int x;\n  public A(int x) { this.x = x; }\n  public static int add(int a) { return a; }\n}\ninterface I { int f(); }\nenum E { X }\n", [("class_declaration", "A"), ("constructor_declaration", "A"), ("method_declaration", "add"), ("interface_declaration", "I"), ("enum_declaration", "E")]),
        ("a.c", "#include <x.h>\nstruct P { int x; };\ntypedef struct { int y; } Q;\nstatic int add(int a, int b) {\n  if (a) { return b; }\n  return a;\n}\nchar *name(void) { return \"}\"; }\n", [("struct_specifier", "P"), ("type_definition", None), ("function_definition", "add"), ("function_definition", None)]),
        ("a.cpp", "namespace n { class Q {}; }\nclass C { public: void m() {} };\ntemplate <typename T> T id(T x) { return x; }\nint main() { return 0; }\n", [("namespace_definition", "n"), ("class_specifier", "C"), ("template_declaration", "id"), ("function_definition", "main")]),
        ("a.cs", "public class C {\n  public int P { get; set; }\n  public C() { }\n  public async Task<int> Go() { return 1; }\n  ~C() { }\n}\nstruct S { }\n", [("class_declaration", "C"), ("property_declaration", "P"), ("constructor_declaration", "C"), ("method_declaration", "Go"), ("destructor_declaration", "C"), ("struct_declaration", "S")]),
        ("a.graphql", "type A { x: Int }\nunion U =\n  | A\n  | B\nquery Q { a }\nscalar Date\n", [("object_type_definition", "A"), ("union_type_definition", "U"), ("operation_definition", "Q"), ("scalar_type_definition", "Date")]),
        ("a.html", "<!DOCTYPE html>\n<html><body><p>x<br></p></body></html>\n", [("element", "html")]),
        ("a.svelte", "<script>\nlet a = 1;\n</script>\n<p>{a}</p>\n<style>p { }</style>\n", [("script_element", None), ("style_element", None)]),
        ("a.xml", "<?xml version='1.0'?>\n<?pi x?>\n<a><b/></a>\n", [("processing_instruction", None), ("element", "a")]),
        ("a.astro", "---\nconst a = 1;\n---\n<Layout><p>x</p></Layout>\n", [("frontmatter", None), ("element", "Layout")]),
        ("a.css", "/* } */\na, b { color: red }\n@media print { a { x: y } }\n@font-face { src: x }\n", [("rule_set", "a, b"), ("media_statement", None), ("at_rule", "@font-face")]),
        ("a.json", '{"a": {"b": [1, "}"]}, "c": "x,y"}\n', [("pair", "a"), ("pair", "c")]),
        ("b.json", "[1, [2], {}]", [("array", None)]),
        ("a.yaml", "# x\na: 1\nb:\n  - c\n---\n- d\n", [("block_mapping", None), ("block_sequence", None)]),
        ("a.toml", 'x = "["\ny = [\n 1,\n]\n[t]\na = 1\n[[u]]\nb = 2\n', [("pair", "x"), ("pair", "y"), ("table", "t"), ("table_array", "u")]),
        ("a.txt", "plain\n", [("text", "a.txt:1")]),
        ("a.ini", "[x]\ny=1\n", [("text", "a.ini:1")]),
    ],
)
def test_languages(name, code, want):
    assert [(k, n) for k, n, *_ in found(name, code)] == want


def test_markdown():
    text = "intro\n\n# One\na\n```\n# no\n```\n### Two ##\nb"
    got = [(p.node_type, p.name, p.start_line, p.end_line) for p in markdown_pieces(text)]
    assert got == [("preamble", "Preamble", 1, 2), ("section", "One", 3, 7), ("section", "Two ##", 8, 9)]
    assert [p.node_type for p in markdown_pieces("no heading\n")] == ["document"]


def test_text_bounds():
    lines = [f"line {i}" for i in range(450)]
    got = text_pieces("\n".join(lines), "f.txt")
    assert [(p.name, p.start_line, p.end_line) for p in got] == [("f.txt:1", 1, 200), ("f.txt:2", 201, 400), ("f.txt:3", 401, 450)]
    got = text_pieces("a\n" + "x" * 9000 + "\nb", "f.txt")
    assert [(p.start_line, p.end_line) for p in got] == [(1, 1), (2, 2), (3, 3)]
    assert text_pieces(" \n", "f.txt") == []


def test_flat_map(spark):
    rows = [("src/a.py", b"def f():\n    return 1\n"), ("bad.py", b"def ("), ("data.json", b"{broken"), ("latin.txt", b"caf\xe9"), ("x.bin", b"\x00"), ("empty.py", b"")]
    got = chunk_files(spark.createDataFrame(rows, "path string, content binary"), "/root/p")
    rows = {r.relative_path: r for r in got.collect()}
    assert set(rows) == {"src/a.py", "data.json", "latin.txt"}
    assert rows["src/a.py"].chunk_type == "function" and rows["src/a.py"].tags == ["python"] and rows["src/a.py"].folder_structure == ["src"]
    assert rows["src/a.py"].file_path == "/root/p/src/a.py"
    assert rows["latin.txt"].tags == ["text", "txt"] and rows["latin.txt"].content == "caf\ufffd"
