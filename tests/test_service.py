import hashlib
import time

import pytest

from semindex import schemas
from semindex.operators import changes, merkle, mutate, topk
from semindex.plans.service import Project, Service
from semindex.sources import files as sources
from semindex.sources.store import VersionedTable
from semindex.streaming import incremental


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "proj"
    (top / "src" / "auth").mkdir(parents=True)
    (top / "src" / "auth" / "login.py").write_text('class LoginManager:\n    """Checks passwords."""\n    def login(self, user):\n        return user\n\ndef logout(user):\n    pass\n')
    (top / "src" / "db.py").write_text("def connect_database(url):\n    return url\n")
    (top / "README.md").write_text("# Project\ntext\n")
    (top / ".git").mkdir()
    (top / ".git" / "config.py").write_text("def hidden(): pass\n")
    (top / "src" / "empty").mkdir()
    return top


def folder_hash(path):
    children = [folder_hash(p) if p.is_dir() else hashlib.sha256(p.read_bytes()).hexdigest() for p in path.iterdir() if p.name != ".git"]
    return hashlib.sha256((path.name + "".join(sorted(children))).encode()).hexdigest()


def test_merkle(spark, root):
    files = sources.scan(spark, str(root))
    nodes = merkle.build(files.select("path", "content"), "proj", sources.empty_directories(spark, str(root))).cache()
    assert merkle.root_hash(nodes) == folder_hash(root)
    facts = merkle.stats(nodes).first()
    assert (facts.file_count, facts.directory_count, facts.node_count) == (3, 4, 7)
    again = merkle.from_dict(spark, merkle.to_dict(nodes, str(root)))
    assert sorted(map(tuple, again.select("path", "hash", "size").collect())) == sorted(map(tuple, nodes.select("path", "hash", "size").collect()))


def test_wide_folders_pass_in_batches(spark):
    paths = [f"wide/f{i}" for i in range(50)] + ["wide/deep/x", "a/y", "z"]
    files = spark.createDataFrame([(p, p.encode()) for p in paths], "path string, content binary").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.path: (r.hash, r.size) for r in merkle.build(files, "top", spark.createDataFrame([("a/none",)], "path string")).collect()}
        none = {r.path: (r.hash, r.size) for r in merkle.build(files.limit(0), "top").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    deep = sha("deep", sha("wide/deep/x"))
    wide = sha("wide", *sorted([sha(f"wide/f{i}") for i in range(50)] + [deep]))
    a = sha("a", *sorted([sha("a/y"), sha("none")]))
    assert got["wide/deep"] == (deep, 11) and got["wide"] == (wide, sum(map(len, paths)) - 4) and got["a"] == (a, 3) and got["a/none"] == (sha("none"), 0)
    assert got["."] == (sha("top", *sorted([wide, a, sha("z")])), sum(map(len, paths)))
    assert none == {".": (sha("top"), 0)}


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d/e.py", "1")], "path string, hash string")
    found = changes.diff(old, new)
    assert {r.path: r.change_type for r in found.collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d/e.py": "added"}
    assert changes.summary(found).first().asDict() == {"added": 1, "removed": 1, "modified": 1, "unchanged": 1, "total_changed": 3}
    assert {r.path for r in changes.to_reindex(found).collect()} == {"b", "d/e.py"}
    told = {(r.category, r.value): r["count"] for r in changes.patterns(found).collect()}
    assert told[("file_extensions", ".py")] == 1 and told[("directories", "root")] == 2 and told[("directories", "d")] == 1


def test_life_of_an_index(spark, root, tmp_path):
    service = Service(spark, str(tmp_path / "store"))
    result = service.index_directory(str(root))
    assert result.success and result.files_added == 3 and result.chunks_added == 5
    rows = {(r.relative_path, r.name) for r in service.current.index.read().collect()}
    assert rows == {("src/auth/login.py", "LoginManager"), ("src/auth/login.py", "login"), ("src/auth/login.py", "logout"), ("src/db.py", "connect_database"), ("README.md", "Project")}

    found = service.search_code("login manager", 3).collect()
    assert found[0].name == "LoginManager" and found[0].snippet == "class LoginManager:" and found[0].lines == "1-4"
    assert {r.file for r in service.search_code("connect", 5, file_pattern="*.md").collect()} == {"README.md"}
    assert {r.kind for r in service.search_code("login", 5, chunk_type="method").collect()} == {"method"}
    assert service.search_code("login", 5, tags=["markdown"]).count() == 1
    hit = service.current.search("logout", 1).first()
    assert hit.chunks_in_file == 3 and [n.name for n in hit.neighbours] == ["login"]
    with pytest.raises(ValueError):
        service.search_code("x", search_mode="nothing")

    similar = service.find_similar_code(hit.chunk_id, 2).collect()
    assert len(similar) == 2 and all(r.name != "logout" for r in similar)
    assert service.find_similar_code("none").count() == 0
    assert service.current.get_chunk(hit.chunk_id).count() == 1
    stats = service.index_status().first()
    assert stats.total_chunks == 5 and stats.files_indexed == 3 and stats.chunk_types["function"] == 2 and stats.top_folders["src"] == 4
    assert service.current.suggestions("pyth") == ["Find python related code"]

    project = service.current
    assert not project.needs_reindex(60)
    time.sleep(0.1)
    assert project.needs_reindex(0.001)
    (root / "src" / "db.py").write_text("def connect_database(url):\n    return url\n\ndef close_database():\n    pass\n")
    (root / "src" / "auth" / "login.py").unlink()
    (root / "new.js").write_text("function fresh() { return 1 }\n")
    assert project.needs_reindex(60)
    result = service.index_directory(str(root))
    assert (result.files_added, result.files_removed, result.files_modified) == (1, 1, 1)
    assert (result.chunks_removed, result.chunks_added) == (4, 3)
    assert {r.name for r in project.index.read().collect()} == {"Project", "connect_database", "close_database", "fresh"}
    result = service.index_directory(str(root))
    assert (result.chunks_added, result.chunks_removed) == (0, 0)

    assert [r.path for r in service.list_projects().collect()] == [str(root)]
    assert service.switch_project(str(root)).id == project.id
    service.clear_index()
    assert service.list_projects().count() == 0
    with pytest.raises(LookupError):
        service.search_code("x")


def test_equal_to_a_fresh_index(spark, root, tmp_path):
    """Add, change and remove, then compare with an index made from nothing."""
    a = Project(spark, str(tmp_path / "a"), str(root))
    a.index_directory()
    (root / "src" / "db.py").write_text("class Db:\n    def f(self): pass\n")
    a.index_directory()
    b = Project(spark, str(tmp_path / "b"), str(root))
    b.index_directory(incremental=False)
    rows = lambda p: sorted((r.chunk_id, r.content, tuple(r.embedding)) for r in p.index.read().collect())
    assert rows(a) == rows(b)


def test_versions(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), "x int")
    assert store.read().count() == 0
    store.write(spark.range(3).selectExpr("cast(id as int) x"))
    store.write(store.read().filter("x > 0"))
    assert sorted(r.x for r in store.read().collect()) == [1, 2]
    store.clear()
    assert not store.exists()


def test_stream(spark, root, tmp_path):
    index = VersionedTable(spark, str(tmp_path / "index"), schemas.INDEXED)
    for _ in range(2):
        incremental.index_stream(spark, str(root), index, str(tmp_path / "ckpt")).awaitTermination()
    first = index.read().count()
    assert first == 5
    (root / "later.py").write_text("def later(): pass\n")
    incremental.index_stream(spark, str(root), index, str(tmp_path / "ckpt")).awaitTermination()
    assert index.read().count() == first + 1


def test_batch_top_k(spark):
    import random

    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8), (301, [1.0] * 8), (302, [1.0] * 8)]
    corpus = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    queries = corpus.filter("id % 50 = 1").selectExpr("id as query_id", "v as query_vector")
    batch = {}
    for r in topk.top_k_batch(corpus, queries, 4, "id", "v").collect():
        batch.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, v in rows:
        if q % 50 == 1:
            assert [i for _, i in sorted(batch[q])] == [r.id for r in topk.top_k(corpus, v, 4, "id", "v").collect()]
    assert topk.top_k_batch(corpus, queries.limit(0), 4, "id", "v").count() == 0


def test_similarity(spark):
    from pyspark.sql import functions as F

    from semindex.functions import vectors

    odd = [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [-3.0, -4.0]), (7, [])]
    rows = spark.createDataFrame(odd, "id long, v array<float>")
    got = {r.id: r.s for r in rows.select("id", vectors.similarity(F.col("v"), [6.0, 8.0]).alias("s")).collect()}
    assert got == {0: pytest.approx(1), 1: 0, 2: None, 3: None, 4: None, 5: None, 6: pytest.approx(-1), 7: None}
    assert [r.id for r in topk.top_k(rows, [6.0, 8.0], 3, "id", "v").collect()] == [0, 1, 6]
    assert topk.top_k(rows.limit(0), [6.0, 8.0], 3, "id", "v").collect() == []
    unit = {r.id: r.u for r in rows.filter("id in (0, 1, 2, 7)").select("id", vectors.normalise(F.col("v")).alias("u")).collect()}
    assert unit == {0: pytest.approx([0.6, 0.8]), 1: [0, 0], 2: None, 7: []}
    both = rows.filter("id in (0, 2, 6)")
    asked = spark.createDataFrame([(9, [6.0, 8.0])], "query_id long, query_vector array<float>")
    assert [(r.id, r["rank"]) for r in topk.top_k_batch(both, asked, 5, "id", "v").orderBy("rank").collect()] == [(0, 1), (6, 2)]


def test_cells(spark):
    import random

    from semindex.operators import ivf

    rng = random.Random(3)
    rows = []
    for i in range(1500):
        center = [3.0 if j == i % 12 else 0.0 for j in range(16)]
        rows.append((i, [c + rng.gauss(0, 0.5) for c in center]))
    corpus = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    centroids = ivf.train(corpus, "chunk_id")
    assigned = ivf.assign(corpus, centroids).cache()
    assert assigned.count() == 1500 and assigned.filter("cell is null").isEmpty()
    found = []
    for i in range(0, 1500, 300):
        exact = [r.chunk_id for r in topk.top_k(corpus, rows[i][1], 10).collect()]
        near = [r.chunk_id for r in ivf.search(assigned, centroids, rows[i][1], 10).collect()]
        found.append(ivf.recall(near, exact))
    assert sum(found) / len(found) >= 0.9


def test_command_line(spark, root, tmp_path, capsys):
    import json

    from semindex.__main__ import main
    from semindex.plans.service import json_or_text

    storage = ["--storage-dir", str(tmp_path / "cli")]
    main([*storage, "index", str(root)], spark)
    assert json.loads(capsys.readouterr().out)["chunks_added"] == 5
    main([*storage, "search", "login manager", "-k", "1"], spark)
    assert json_or_text(capsys.readouterr().out.strip())["name"] == "LoginManager"
    main([*storage, "status"], spark)
    assert json.loads(capsys.readouterr().out)["total_chunks"] == 5
    main([*storage, "smoke"], spark)
    assert json.loads(capsys.readouterr().out)["chunks_added"] == 2
    assert json_or_text("plain") == {"result": "plain"}
    project = Project(spark, str(tmp_path / "cli"), str(root))
    exported = project.export_snapshot()
    assert exported["dag"]["file_count"] == 3 and project.last_snapshot().first()["age_seconds"] >= 0


def test_scan_prunes_before_reading(spark, tmp_path):
    """Ignored names leave the listing: their files are never opened."""
    for name in ("a.py", "sub dir/b+c.md", ".git/objects/x", "node_modules/m/index.js", "src/deep/__pycache__/y.pyc", "src/z.pyc", "src/ok.py", "src/ünï%20code.txt"):
        path = tmp_path / "build" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    found = sources.scan(spark, f"{tmp_path}/build")
    assert sorted(r.path for r in found.select("path", "content").collect()) == sorted(["a.py", "sub dir/b+c.md", "src/ok.py", "src/ünï%20code.txt"])
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    todo, read = [plan], None
    while todo:
        node = todo.pop()
        if node.metrics().contains("numFiles"):
            read = node.metrics().apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert read == 4


def test_upsert_takes_one_row_of_a_repeated_key(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "chunk_id string, end_line int, content string")
    new = spark.createDataFrame([("b", 2, "x"), ("b", 3, "y"), ("c", 1, "z"), ("c", 1, "z")], old.schema)
    for parts in (1, 4):
        made = mutate.upsert(old, new.repartition(parts), order="end_line")
        assert sorted(tuple(r) for r in made.collect()) == [("a", 1, "old"), ("b", 3, "y"), ("c", 1, "z")]
