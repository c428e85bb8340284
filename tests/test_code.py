"""Facts of the code operators: discovery, parsing, chunks, graphs, streaming."""

import time

import pytest

from lodestone.operators import parse, symbols
from lodestone.operators.index import InvertedIndex
from lodestone.sources import repository
from lodestone.streaming import operators as streaming


def files(spark, **sources):
    rows = [(i, p.replace("__", "/") + ".py", s) for i, (p, s) in enumerate(sources.items())]
    return spark.createDataFrame(rows, "file_ord long, file_path string, source string")


def test_discovery_reads_what_spark_skips(spark, tmp_path):
    for name, text in {"pkg/main.py": "print('hi')\n", "pkg/main.JS": "console.log(1)\n", "pkg/__init__.py": "", "pkg/.dot.py": "x", "note.txt": "x", ".hidden/a.py": "x", "node_modules/m.js": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = repository.discover(str(tmp_path))
    assert [f[:2] for f in found] == [("pkg/.dot.py", "python"), ("pkg/__init__.py", "python"), ("pkg/main.JS", "javascript"), ("pkg/main.py", "python")]
    rows = repository.read_repository(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [r.file_path for r in rows] == [f[0] for f in found] and rows[3].source == "print('hi')\n" and rows[3].size_bytes == 12
    with pytest.raises(repository.RepositoryError):
        repository.discover(str(tmp_path / "none"))
    with pytest.raises(repository.RepositoryError):
        repository.discover_python(str(tmp_path), most=3)
    df = spark.createDataFrame([("a/x.PY",), ("a/.py",), ("b.txt",), (".git/x.py",), ("a/dist/x.py",)], "p string")
    assert [r[0] for r in df.select(repository.language_of("p")).collect()] == ["python", None, None, "python", "python"]
    assert [r[0] for r in df.select(repository.is_ignored("p")).collect()] == [False, False, False, True, True]


def test_clone_failure():
    with pytest.raises(repository.RepositoryError):
        repository.clone("/nonexistent/repository", "/tmp/nowhere-to-clone")


def test_symbols_full_fields():
    source = '@router.get("/users")\n@other\nasync def users(a,\n          b):\n    """Doc."""\n    return 1\n\nclass A(Base, metaclass=M):\n    x = "v"\n    @property\n    def p(self):\n        def inner(): pass\n        return 1\n    class Plain: pass\n    @deco\n    class Nested: pass\nif True:\n    import os as o, sys\n    from .m import (a,\n        b)\n'
    rows = {r["name"]: r for r in parse.symbols_of(source)}
    assert list(rows) == ["users", "A", "A.p", "Nested", "os, sys", ".m"]
    u = rows["users"]
    assert (u["start_line"], u["end_line"], u["decorators"], u["signature"], u["docstring"], u["is_async"]) == (3, 6, ['@router.get("/users")', "@other"], "async def users(a,", "Doc.", True)
    assert rows["A"]["bases"] == ["Base", "metaclass=M"] and rows["A"]["docstring"] == "v" and rows["A.p"]["is_property"]
    assert rows["os, sys"]["imports"] == [{"name": "os", "alias": "o"}, {"name": "sys", "alias": None}]
    assert [i["name"] for i in rows[".m"]["imports"]] == ["(a", "b)"] and rows[".m"]["is_from_import"]


def test_recovery():
    source = "def valid_before():\n    return 1\n\ndef broken(:\n    pass\n\ndef valid_after():\n    return 2\n"
    assert [(r["name"], r["start_line"], r["end_line"]) for r in parse.symbols_of(source)] == [("valid_before", 1, 2), ("valid_after", 7, 8)]
    assert parse.parse(source)[1] and not parse.parse("x = 1\n")[1] and parse.parse("")[0] == []
    assert parse.symbols_of("\0") == []


def test_chunks():
    source = "import os\nimport sys\n\ndef add(a, b):\n    return a + b\n\nclass Calculator:\n    def run(self):\n        return add(1, 2)\n"
    got = [(c["parent_symbol"], c["start_line"], c["end_line"]) for c in parse.Chunker(512).chunks_of(source)]
    assert got == [("module imports", 1, 2), ("add", 4, 5), ("Calculator", 7, 9)]
    large = "def f():\n    a = 1\n    b = 2\n\n    c = 3\n    d = 4\n\n    e = 5\n"
    pieces = parse.Chunker(9, lambda t: len(t.split())).chunks_of(large)
    assert [(c["start_line"], c["end_line"]) for c in pieces] == [(2, 3), (5, 6), (8, 8)]
    assert all(c["content"].startswith("def f():\n") for c in pieces)
    with pytest.raises(ValueError):
        parse.Chunker(0)


def test_stdlib_dialect():
    source = "import os, sys as s\nfrom .a import b\nclass A(x.B[int]):\n    async def f(self, *a, k=1, **kw):\n        def g(): pass\n"
    rows = [(r["qualified_name"], r["kind"], r["signature"], r["parent"]) for r in parse.scoped_symbols_of(source, "m.py")]
    assert rows == [("os", "import", None, None), ("sys", "import", None, None), (".a.b", "import", None, None), ("A", "class", "class A(x.B)", None), ("A.f", "async_method", "async def f(self, *a, k, **kw)", "A"), ("A.f.g", "method", "def g()", "A.f")]
    with pytest.raises(parse.ParseError):
        parse.scoped_symbols_of("def (:", "m.py")
    assert [c["kind"] for c in parse.plain_chunks_of("x = 1\n", "m.py")] == ["module"] and parse.plain_chunks_of(" \n", "m.py") == []


def edges(spark, **sources):
    f = files(spark, **sources)
    rows = symbols.call_edges(parse.symbols(f), parse.calls(f), f).collect()
    return {(r.caller, r.callee, r.call_site_line, r.resolved, r.callee_file, r.callee_line) for r in rows}


def test_call_graph(spark):
    assert ("outer", "helper", 2, True, "m.py", 4) in edges(spark, m="def outer():\n    return helper()\n\ndef helper():\n    return 1\n")
    got = edges(spark, app__helpers="\n\n\n\ndef normalize(x):\n    return x\n", app__main="from app.helpers import normalize as n\nimport app.helpers\ndef go(x):\n    return n(app.helpers.normalize(x))\n")
    assert ("go", "normalize", 4, True, "app/helpers.py", 5) in got
    methods = edges(spark, a="class S:\n    def save(self):\n        self.check()\n    def check(self):\n        pass\n", b="def use(s):\n    s.check()\n    unknown()\nuse(1)\n")
    assert ("S.save", "S.check", 3, True, "a.py", 4) in methods and ("use", "unknown", 3, False, None, None) in methods
    assert ("use", "S.check", 2, True, "a.py", 4) in methods and len(methods) == 3


def test_dependency_graph(spark):
    f = files(spark, app__api__routes="from ..services.auth import login\nfrom .. import models\nfrom . import permissions as p\nimport os, app.models\nfrom app.models import *\n", app__services__auth="", app__models="", app__api__permissions="")
    rows = {(r.target, tuple(r.imported_names), r.resolved, r.is_star_import) for r in symbols.dependency_edges(parse.symbols(f), f).collect()}
    assert rows == {("app.services.auth", ("login",), True, False), ("app.models", ("models",), True, False), ("app.api.permissions", ("permissions as p",), True, False), ("os", ("os",), False, False), ("app.models", ("app.models",), True, False), ("app.models", ("*",), True, True)}


def test_symbol_table_and_graph(spark):
    f = files(spark, app__service="import os\nclass UserService(Base):\n    def build(self):\n        pass\ndef load():\n    pass\n", app__base="class Base:\n    pass\n")
    table = symbols.symbol_table(parse.symbols(f)).cache()
    names = [r.qualified_name for r in symbols.lookup_file(table, "app/service.py").where("type <> 'import'").collect()]
    assert names == ["app.service.UserService", "app.service.UserService.build", "app.service.load"]
    assert symbols.lookup_exact(table, "build").first().parent_symbol == "app.service.UserService"
    assert symbols.lookup_regex(table, "Serv").count() == 2 and symbols.lookup_qualified(table, "app.service::<import>os").count() == 1
    nodes, links = symbols.graph_of(table)
    assert {r.type for r in links.collect()} == {"CONTAINS", "INHERITS"} and nodes.where("label = 'Module'").count() == 2
    assert links.where("type = 'INHERITS'").first().target_id == "app/base.py:app.base.Base:class:1:2"
    calls = symbols.calls_edges(spark.createDataFrame([("load", "build", "app/service.py", 5, "build()", "app/service.py")], "caller string, callee string, call_site_file string, call_site_line int, call_text string, callee_file string"), table)
    assert calls.count() == 1


def test_syntax_nodes(spark):
    rows = parse.syntax_nodes(files(spark, m="def f(x):\n    return x + 1\n")).collect()
    assert rows[0].type == "module" and rows[1].type == "FunctionDef" and rows[1].parent_id == 0
    assert any(r.type == "BinOp" and r.text == "x + 1" and r.start_column == 11 for r in rows)


def test_streaming_rate_limit_and_index(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [("u", base + dt.timedelta(seconds=s)) for s in (0, 10, 20, 70)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(source)
    events = spark.readStream.schema("key string, ts timestamp").parquet(source)
    run = streaming.rate_limited_stream(events, "key", "ts", limit=2, window=60.0).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [r.allowed for r in spark.table("limited").orderBy("t").collect()] == [True, True, False, True]

    schema, feed, table = "id string, text string, seq long, deleted boolean", str(tmp_path / "feed"), str(tmp_path / "table")
    index = InvertedIndex(spark, table, "id")
    batches = [("a", "one", 1, False), ("b", "two", 1, False), ("a", "zero", 0, False)], [("a", "new", 3, False), ("b", "", 2, True)], [("a", "late", 2, False), ("b", "late", 1, False)]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = streaming.maintain_index(spark.readStream.schema(schema).parquet(feed), index, "seq", str(tmp_path / "c2")).trigger(availableNow=True).start()
        stream.awaitTermination(60)
        time.sleep(0.1)
    found = lambda: ([(r.id, r.length) for r in index.documents().collect()], [(r.term, r.df) for r in index.term_frequencies().collect()], [r.id for r in index.search("new late two").collect()])
    assert found() == ([("a", 1)], [("new", 1)], ["a"])
    index.apply(spark.createDataFrame(batches[1], schema), "seq", segment=1)  # a repeated batch
    assert found() == ([("a", 1)], [("new", 1)], ["a"])
    index.compact()
    assert found() == ([("a", 1)], [("new", 1)], ["a"])
    index.apply(spark.createDataFrame([("b", "late", 1, False)], schema), "seq")  # the deletion is still known
    assert found() == ([("a", 1)], [("new", 1)], ["a"])


def test_an_index_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(300)], "id long, text string")
    index = InvertedIndex(spark, str(tmp_path / "index"), "id").build(docs)
    assert [r.id for r in index.search("word7").collect()] == [7] and index.search("  ").count() == 0
    plan = index._postings(["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,word7)" in plan


def test_recovery_inside_a_broken_class():
    source = "class A(B):\n    def good(self):\n        return one(1)\n\n    def broken(self:\n        return 1\n\n    @property\n    def after(self):\n        return two()\n\n\ndef tail(x\n    pass\n\n\ndef last():\n    return 3\n"
    rows = [(r["name"], r["start_line"], r["end_line"], r["decorators"]) for r in parse.symbols_of(source)]
    assert rows == [("A", 1, 10, []), ("A.good", 2, 3, []), ("A.after", 9, 10, ["@property"]), ("last", 17, 18, [])]
    assert [c["expression"] for c in parse.calls_of(source)] == ["one", "two"] and parse.parse(source)[1]


def test_clone_keeps_its_files(spark, tmp_path):
    import subprocess

    origin = tmp_path / "origin"
    (origin / "pkg").mkdir(parents=True)
    (origin / "pkg" / "a.py").write_text("x = 1\n")
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "first"]):
        subprocess.run(["git", *command], cwd=origin, check=True)
    folder, files_ = repository.clone_and_discover(str(origin), into=str(tmp_path / "shared"))
    assert files_ == [("pkg/a.py", "python", 6)]
    assert [r.source for r in repository.read_repository(spark, folder).collect()] == ["x = 1\n"]
    with pytest.raises(repository.RepositoryError):
        repository.clone_and_discover(str(tmp_path / "none"))


def test_files_are_parsed_in_pieces(monkeypatch):
    """Statements, lines and ordinals of a file do not depend on where it is cut, whole or broken; lines end where the grammar
    ends them, not at form feeds."""
    source = 'import a\n\nx = """\ndef no(): pass\n@a\n"""\n\x0c\n@deco\n# c\n@other(\n)\ndef f(x):\n    return g(x)\n\nif x:\n    import b\nelse:\n    import c\n\nclass C(B):\n    @p\n    def m(self):\n        return 1\n\ny = (\n1)\n\\\nz = h()\r\ndef last(): return "é" + k()\n'
    for text in (source, source + "def open(\n", source.replace("m(self)", "m(self"), source + "x = 1 \\\n"):
        found = []
        for piece in (1, 20, 1 << 20):
            monkeypatch.setattr(parse, "PIECE", piece)
            chunker = parse.Chunker(12)
            found.append((parse.symbols_of(text), parse.calls_of(text), parse.nodes_of(text), chunker.chunks_of(text), parse.File(text).failed))
        assert found[0] == found[1] == found[2] and found[0][-1] == (text != source)
    rows = {r["name"]: r for r in parse.symbols_of(source)}
    assert [rows["f"]["start_line"], rows["f"]["signature"], rows["C.m"]["parent_ord"] == rows["C"]["ord"]] == [12, "def f(x)", True]
    assert rows["last"]["signature"] == 'def last(): return "é" + k()'


def test_memory_of_a_large_file_and_time_of_its_chunks():
    """A file's rows leave while it is read: what is held does not grow with it, nor does the work for each function."""
    import tracemalloc

    def peak(n, broken=""):
        text = "import os\n" + "".join(f'def f{i}(x: int = {i}):\n    """doc"""\n\n    y = g(x)\n    return h{i}(y)\n\n' for i in range(n)) + broken
        tracemalloc.start()
        count = sum(1 for _ in parse.symbol_rows(text))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == n + 1
        return top / 1e6

    assert peak(8_000) < 2 * peak(1_000) + 3 and peak(4_000, "def open(\n") < 20
    large = "".join(f"def f{i}(): return {i}\n" for i in range(30_000))
    began = time.time()
    assert sum(1 for _ in parse.Chunker().chunks_in(large)) == 30_000 and time.time() - began < 30
