"""Queries that chunk source code of every language and drive an index from end to end.

Each language has a source text in which ``@`` stands for a key; every row of ``part`` makes a file of
it. The SQL beside it holds the chunks that the language's rules ask for, written out by hand. The
projects that are indexed are made of ``nation`` and ``region``, a file a row.
"""

from __future__ import annotations

import functools
from dataclasses import asdict

from pyspark.sql import functions as F

from semindex.operators.chunking.files import chunk_files
from semindex.plans.queries import QUERIES, SQL, query, table
from semindex.plans.service import Service, search_rows, similar_rows
from semindex.sources.store import shared_folder

#: Language: (file ending, source, chunks), a chunk being (type, name, parent, first line, last line,
#: tags, docstring). A chunk's text is its lines without the blanks before the first.
SOURCES: dict[str, tuple[str, str, list[tuple]]] = {
    "python": (
        "py",
        'import os\n\ndef f_@(a, b=1):\n    """Adds @."""\n    def inner(): pass\n    return a\n\n@one\nclass D_@:\n    x = 1\n    def m(self): pass\n\nclass C_@:\n    """Holds @."""\n    def m(self):\n        return @\n\nif os:\n    async def g_@(): ...\n'.replace("@one", "%one"),
        [
            ("function", "f_@", None, 3, 6, "python", "Adds @."),
            ("decorated_definition", "D_@", None, 8, 11, "python", None),
            ("class", "C_@", None, 13, 16, "python", "Holds @."),
            ("method", "m", "C_@", 15, 16, "python", None),
            ("function", "g_@", None, 19, 19, "python", None),
        ],
    ),
    "javascript": (
        "js",
        '// function no() {}\nasync function load_@(x) { return `}` + "}"; }\nfunction* gen_@() { yield 1 }\nclass Box_@ extends Base {\n  constructor(v) { super(v); if (v) { this.v = v } }\n  async get() { return this.v }\n}\n',
        [
            ("function", "load_@", None, 2, 2, "async,javascript", None),
            ("generator_function_declaration", "gen_@", None, 3, 3, "generator,javascript", None),
            ("class", "Box_@", None, 4, 7, "javascript", None),
            ("method", None, "Box_@", 5, 5, "javascript", None),
            ("method", None, "Box_@", 6, 6, "async,javascript", None),
        ],
    ),
    "jsx": ("jsx", "function App_@() { return <div>x</div> }\nfunction Row_@() { return <b>y</b> }\n", [("function", "App_@", None, 1, 1, "component,jsx", None), ("function", "Row_@", None, 2, 2, "component,jsx", None)]),
    "typescript": (
        "ts",
        "interface A_@ { x: number }\nenum E_@ { X, Y }\nfunction id_@<T>(x: T): T { return x }\nclass S_@ {\n  run(): void { }\n}\n",
        [
            ("interface", "A_@", None, 1, 1, "typescript", None),
            ("enum", "E_@", None, 2, 2, "typescript", None),
            ("function", "id_@", None, 3, 3, "generic,typescript", None),
            ("class", "S_@", None, 4, 6, "typescript", None),
            ("method", None, "S_@", 5, 5, "typescript", None),
        ],
    ),
    "svelte": ("svelte", "<script>\nlet a = @;\n</script>\n<p>{a}</p>\n<style>p { }</style>\n", [("script", None, None, 1, 3, "svelte", None), ("style", None, None, 5, 5, "svelte", None)]),
    "go": (
        "go",
        "package a\n\ntype P_@ struct {\n\tx int\n}\nfunc F_@(a int) int { return a }\nfunc (p *P_@) M() string { return `}` }\n",
        [("type", None, None, 3, 5, "go", None), ("function", "F_@", None, 6, 6, "go", None), ("method", None, None, 7, 7, "go", None)],
    ),
    "rust": (
        "rs",
        "struct P_@ { x: i32 }\nimpl P_@ { fn m(&self) {} }\nenum E_@ { A }\ntrait T_@ { fn t(&self); }\nfn go_@() {}\nmod tests_@ { fn x() {} }\n",
        [
            ("struct", "P_@", None, 1, 1, "rust", None), ("impl", "P_@", None, 2, 2, "rust", None), ("enum", "E_@", None, 3, 3, "rust", None),
            ("trait", "T_@", None, 4, 4, "rust", None), ("function", "go_@", None, 5, 5, "rust", None), ("module", "tests_@", None, 6, 6, "rust", None),
        ],
    ),
    "java": (
        "java",
        "class A_@ {\n  A_@(int x) { this.x = x; }\n  static int add(int a) { return a; }\n}\ninterface I_@ { int f(); }\nenum E_@ { X }\n",
        [
            ("class", "A_@", None, 1, 4, "java", None), ("constructor", "A_@", "A_@", 2, 2, "java", None), ("method", "add", "A_@", 3, 3, "java", None),
            ("interface", "I_@", None, 5, 5, "java", None), ("enum", "E_@", None, 6, 6, "java", None),
        ],
    ),
    "c": (
        "c",
        '#include <x.h>\nstatic int add_@(int a, int b) {\n  if (a) { return b; }\n  return @;\n}\nint name_@(void) { return "}"[0]; }\n',
        [("function", "add_@", None, 2, 5, "c", None), ("function", "name_@", None, 6, 6, "c", None)],
    ),
    "cpp": (
        "cpp",
        "namespace n_@ { class Q {}; }\ntemplate <typename T> T id_@(T x) { return x; }\nint main_@() { return 0; }\n",
        [("namespace", "n_@", None, 1, 1, "cpp", None), ("template", "id_@", None, 2, 2, "cpp", None), ("function", "main_@", None, 3, 3, "cpp", None)],
    ),
    "csharp": (
        "cs",
        "class C_@ {\n  int P { get; set; }\n  C_@() { }\n  int Go() { return @; }\n  ~C_@() { }\n}\nstruct S_@ { }\n",
        [
            ("class", "C_@", None, 1, 6, "csharp", None), ("property", "P", "C_@", 2, 2, "csharp", None), ("constructor", "C_@", "C_@", 3, 3, "csharp", None),
            ("method", "Go", "C_@", 4, 4, "csharp", None), ("destructor", "C_@", "C_@", 5, 5, "csharp", None), ("struct", "S_@", None, 7, 7, "csharp", None),
        ],
    ),
    "html": ("html", "<!DOCTYPE html>\n<html><body>\n<p>@<br></p>\n</body></html>\n", [("element", "html", None, 2, 4, "html", None)]),
    "astro": ("astro", "---\nconst a = @;\n---\n<Layout><p>x</p></Layout>\n", [("frontmatter", None, None, 1, 3, "astro", None), ("element", "Layout", None, 4, 4, "astro", None)]),
    "css": ("css", "/* } */\n.a@ { color: red }\n%media print { a { x: y } }\n", [("rule_set", ".a@", None, 2, 2, "css", None), ("media_statement", None, None, 3, 3, "css", None)]),
    "json": ("json", '{\n"a@": {"b": [1, "}"]}\n}\n', [("pair", "a@", None, 2, 2, "json", None)]),
    "yaml": ("yaml", "a: @\nb:\n  - c\n", [("block_mapping", None, None, 1, 3, "yaml", None)]),
    "toml": ("toml", 'x@ = "["\n[t@]\na = 1\n', [("pair", "x@", None, 1, 1, "toml", None), ("table", "t@", None, 2, 3, "toml", None)]),
    "xml": ("xml", "<?xml version='1.0'?>\n<a@>\n<b/></a@>\n", [("element", "a@", None, 2, 3, "xml", None)]),
    "graphql": ("graphql", "type A_@ { x: Int }\nquery Q_@ { a }\nscalar D_@\n", [("object_type_definition", "A_@", None, 1, 1, "graphql", None), ("operation_definition", "Q_@", None, 2, 2, "graphql", None), ("scalar_type_definition", "D_@", None, 3, 3, "graphql", None)]),
    "markdown": ("md", "intro @\n# One @\na\n```\n# no\n```\n## Two\nb", [("preamble", "Preamble", None, 1, 1, "markdown", None), ("section", "One @", None, 2, 6, "markdown", None), ("section", "Two", None, 7, 8, "markdown", None)]),
    "plain_text": ("ini", "[x]\ny = @\n", [("text", "file@.ini:1", None, 1, 2, "text,ini", None)]),
    "broken_json": ("json", "{broken @", [("module", None, None, 1, 1, "json", None)]),
}


def _literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _of(column: str) -> str:
    return f"replace(replace({column}, '@', k::VARCHAR), '%', '@')"


def _chunks(spark, sf_dir, ending: str, source: str):
    key = F.col("p_partkey").cast("string")
    text = F.replace(F.replace(F.lit(source), F.lit("@"), key), F.lit("%"), F.lit("@"))
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("src/file"), key, F.lit(f".{ending}")).alias("path"), text.alias("content"))
    return chunk_files(files).select(
        "relative_path", "chunk_type", "name", "parent_name", "start_line", "end_line", F.array_join("tags", ",").alias("tags"), "docstring", F.md5("content").alias("content_md5")
    )


for _language, (_ending, _source, _found) in SOURCES.items():
    QUERIES[f"chunk_{_language}"] = functools.partial(_chunks, ending=_ending, source=_source)
    SQL[f"chunk_{_language}"] = f"""WITH s AS (SELECT p_partkey AS k, {_of(_literal(_source))} AS code FROM part),
c(chunk_type, name, parent, a, b, tags, doc) AS (VALUES {', '.join('(' + ', '.join(map(_literal, x)) + ')' for x in _found)})
SELECT 'src/file' || k || '.{_ending}' AS relative_path, chunk_type, {_of('name')} AS name, {_of('parent')} AS parent_name, a AS start_line, b AS end_line, tags, {_of('doc')} AS docstring,
  md5(ltrim(array_to_string(string_split(code, chr(10))[a:b], chr(10)), ' ')) AS content_md5 FROM s, c"""


# --- an index from end to end -------------------------------------------------------------------


class _Files:
    """A folder of small files, written through Spark's own file systems."""

    def __init__(self, spark, sf_dir: str) -> None:
        self.spark, self.base = spark, shared_folder(spark, "project")
        self.nations = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
        self.regions = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()  # and one of 5
        self.home = {r.r_regionkey: r.r_name.replace(" ", "_") for r in self.regions}
        self.service = Service(spark, f"{self.base}/storage")
        self.root = f"{self.base}/world"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, name: str, text: str) -> None:
        path, system = self._path(name)
        stream = system.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def first(self):
        """A Markdown file of two sections for each nation, a text for each region, and ignored ones."""
        for n in self.nations:
            self.put(self.name(n), self.text(n))
        for r in self.regions:
            self.put(f"{self.home[r.r_regionkey]}/notes.txt", f"about {r.r_name}\n")
        self.put(".git/config.py", "def hidden():\n    pass\n")
        self.put("data.bin", "unsupported")
        return self.service.index_directory(self.root)

    def second(self):
        """Every fifth nation has a section more, every other seventh goes, each region has code."""
        for n in self.nations:
            if n.n_nationkey % 5 == 0:
                self.put(self.name(n), self.text(n) + "\n## More\nof it")
            elif n.n_nationkey % 7 == 0:
                path, system = self._path(self.name(n))
                system.delete(path, False)
        for r in self.regions:
            self.put(f"{self.home[r.r_regionkey]}/code.py", f"def region_{r.r_regionkey}():\n    return {r.r_regionkey}\n")
        return self.service.index_directory(self.root)

    def name(self, n) -> str:
        return f"{self.home[n.n_regionkey]}/{n.n_name.replace(' ', '_')}.md"

    def text(self, n) -> str:
        return f"# {n.n_name}\nnation {n.n_nationkey}\n## Key\n{n.n_nationkey}"


@query("""WITH n AS (SELECT count(*) AS every, count(*) FILTER (n_nationkey % 5 = 0) AS changed, count(*) FILTER (n_nationkey % 5 <> 0 AND n_nationkey % 7 = 0) AS gone FROM nation), r AS (SELECT count(*) AS regions FROM region)
SELECT 1 AS step, every + regions AS files_added, 0 AS files_removed, 0 AS files_modified, 2 * every + regions AS chunks_added, 0 AS chunks_removed, true AS success FROM n, r
UNION ALL SELECT 2, regions, gone, changed, 3 * changed + regions, 2 * (gone + changed), true FROM n, r
UNION ALL SELECT 3, 0, 0, 0, 0, 0, true""")
def index_counters(spark, sf_dir):
    """What a full run, an incremental run and a run without changes report."""
    project = _Files(spark, sf_dir)
    done = [asdict(project.first()), asdict(project.second()), asdict(project.service.index_directory(project.root))]
    names = ("files_added", "files_removed", "files_modified", "chunks_added", "chunks_removed")
    rows = [(i, *(d[c] for c in names), d["success"]) for i, d in enumerate(done, 1)]
    return spark.createDataFrame(rows, f"step int, {', '.join(f'{c} long' for c in names)}, success boolean")


_HELD = """n AS (SELECT n_nationkey, n_name, replace(r_name, ' ', '_') || '/' || replace(n_name, ' ', '_') || '.md' AS path FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0 OR n_nationkey % 7 <> 0),
c AS (SELECT path, 'section' AS chunk_type, n_name AS name, 1 AS first, 2 AS last FROM n UNION ALL SELECT path, 'section', 'Key', 3, 4 FROM n UNION ALL SELECT path, 'section', 'More', 5, 6 FROM n WHERE n_nationkey % 5 = 0
  UNION ALL SELECT replace(r_name, ' ', '_') || '/notes.txt', 'text', 'notes.txt:1', 1, 1 FROM region UNION ALL SELECT replace(r_name, ' ', '_') || '/code.py', 'function', 'region_' || r_regionkey, 1, 2 FROM region)"""


@query(f"""WITH {_HELD} SELECT path AS relative_path, chunk_type, name, first AS start_line, last AS end_line, md5(concat_ws(':', path, name, first, chunk_type)) AS chunk_id, 256 AS dimension, split_part(path, '/', 1) AS folders FROM c""")
def index_contents(spark, sf_dir):
    """All rows of the index after a full and an incremental run."""
    project = _Files(spark, sf_dir)
    project.first()
    project.second()
    rows = project.service.project(project.root).index.read()
    return rows.select("relative_path", "chunk_type", "name", "start_line", "end_line", "chunk_id", F.size("embedding").alias("dimension"), F.array_join("folder_structure", "|").alias("folders"))


@query(f"""WITH {_HELD}, k AS (SELECT 'search' AS kind, path AS file, first || '-' || last AS lines, chunk_type AS type, name FROM c WHERE path LIKE '%.md' AND chunk_type = 'section'
UNION ALL SELECT 'by_tag', path, first || '-' || last, chunk_type, name FROM c WHERE path LIKE '%.py'
UNION ALL SELECT 'similar', path, first || '-' || last, chunk_type, name FROM c WHERE name <> 'region_0')
SELECT * FROM k""")
def service_search(spark, sf_dir):
    """Searches under a pattern and a type, and under a tag, and what is like a chunk, with enough
    results asked for to hold all that may come."""
    project = _Files(spark, sf_dir)
    project.first()
    project.second()
    held = project.service.project(project.root)
    own = held.index.read().filter("name = 'region_0'").first().chunk_id
    plain = lambda kind, found: found.select(F.lit(kind).alias("kind"), "file", "lines", F.col("kind").alias("type"), "name")
    found = plain("search", search_rows(held.search("  the key of a nation ", 100, file_pattern="*.md", chunk_type="section", search_mode="auto")))
    found = found.unionByName(plain("by_tag", project.service.search_code("return a region", 100, tags=["python", "go"], include_context=False)))
    like = similar_rows(held.find_similar(own, 100)).select(F.lit("similar").alias("kind"), F.col("file_path").alias("file"), "lines", F.col("chunk_type").alias("type"), "name")
    return found.unionByName(like)


@query(f"""WITH {_HELD} SELECT count(*) AS total_chunks, count(DISTINCT path) AS files_indexed, count(*) AS current_chunks, count(DISTINCT path) + 1 AS snapshot_files, 2::BIGINT AS snapshots, true AS incremental, false AS stale_now, true AS stale_when_old,
  count(DISTINCT path) + 1 AS exported_files, 1::BIGINT AS projects, count(*) AS project_chunks, 0::BIGINT AS cleared_chunks, 0::BIGINT AS cleared_projects FROM c""")
def service_status(spark, sf_dir):
    """Statistics, snapshots and the list of projects after two runs, and what clearing leaves."""
    project = _Files(spark, sf_dir)
    project.first()
    project.second()
    held = project.service.switch_project(project.root)
    stats, last, projects = project.service.index_status().first(), held.last_snapshot().first(), project.service.list_projects().collect()
    row = [
        stats.total_chunks, stats.files_indexed, last.current_chunks, last.file_count, held.snapshots.read().count(), last.incremental, held.needs_reindex(60), held.needs_reindex(0),
        held.export_snapshot()["dag"]["file_count"], len(projects), projects[0].total_chunks,
    ]
    project.service.clear_index()
    row += [held.index.read().count(), project.service.list_projects().count()]
    return spark.createDataFrame(
        [tuple(row)],
        "total_chunks long, files_indexed long, current_chunks long, snapshot_files long, snapshots long, incremental boolean, stale_now boolean, stale_when_old boolean,"
        " exported_files long, projects long, project_chunks long, cleared_chunks long, cleared_projects long",
    )
