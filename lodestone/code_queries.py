"""Source-code operators as queries over a repository that is generated from the driver tables.

Each nation is a module ``pkg/mNN.py`` and each part a function of the module ``p_partkey % 25``, so DuckDB can compute
symbols, chunks and edges, with their lines, from the same tables:

     1  import os, sys as system
     2  from pkg.mXX import fXX as aliasN          XX = (2 N + 1) % 25
     3  from . import mYY                          YY = (3 N + 2) % 25
     5  class CNN(BaseR, CZZ):                     R the region, ZZ = (N + 1) % 25
     6      \"\"\"nation name\"\"\"
     8      @staticmethod
     9      def make(x):
    10          return fN(x)
    12      def run(self):
    13          return self.make(aliasN(1))
    15  def fP(x: int = size):                     the module's parts, six lines each; every third one async
    16      \"\"\"part name\"\"\"
    18      y = mYY.fYY(x)
    19      return fQ(y)                           Q = (7 P + 1) % parts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import parse, store, symbols, traverse
from lodestone.queries import query, read
from lodestone.storage import materialize

MODULES = 25


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _line(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def repository(spark, d) -> DataFrame:
    """file_ord, file_path, source."""
    part, p, n = read(spark, d, "part"), F.col("p_partkey"), F.col("n_nationkey")
    of = p % MODULES
    total = F.broadcast(part.agg(F.count(F.lit(1)).alias("total")))  # one row
    head = F.concat(F.when(p % 3 == 0, "async def f").otherwise("def f"), p)
    y = _two((of * 3 + 2) % MODULES)
    text = F.array_join(F.array(
        _line(head, "(x: int = ", F.col("p_size"), "):"), _line('    """', F.col("p_name"), '"""'), F.lit(""),
        _line("    y = m", y, ".f", (of * 3 + 2) % MODULES, "(x)"), _line("    return f", (p * 7 + 1) % F.col("total"), "(y)"), F.lit(""),
    ), "\n")
    functions = part.crossJoin(total).select(of.alias("module"), p.alias("p"), text.alias("text"))
    bodies = functions.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n").alias("body"))
    x = (n * 2 + 1) % MODULES
    top = F.array_join(F.array(
        F.lit("import os, sys as system"), _line("from pkg.m", _two(x), " import f", x, " as alias", n), _line("from . import m", _two((n * 3 + 2) % MODULES)), F.lit(""),
        _line("class C", _two(n), "(Base", F.col("n_regionkey"), ", C", _two((n + 1) % MODULES), "):"), _line('    """', F.col("n_name"), '"""'), F.lit(""),
        F.lit("    @staticmethod"), F.lit("    def make(x):"), _line("        return f", n, "(x)"), F.lit(""),
        F.lit("    def run(self):"), _line("        return self.make(alias", n, "(1))"), F.lit(""),
    ), "\n")
    files = read(spark, d, "nation").join(bodies, n == F.col("module"))
    return files.select(n.cast("long").alias("file_ord"), _line("pkg/m", _two(n), ".py").alias("file_path"), F.concat(top, F.lit("\n"), "body").alias("source"))


#: DuckDB: modules (n, file, x, y, z) and functions (p, n, i the place in the module, c the called part).
_CODE = """
m AS (SELECT n_nationkey AS n, n_name, n_regionkey AS r, lpad(n_nationkey::VARCHAR, 2, '0') AS nn, 'pkg/m' || nn || '.py' AS file, 'pkg.m' || nn AS module, (n * 2 + 1) % 25 AS x, (n * 3 + 2) % 25 AS y, lpad(x::VARCHAR, 2, '0') AS xx, lpad(y::VARCHAR, 2, '0') AS yy,
  lpad(((n + 1) % 25)::VARCHAR, 2, '0') AS zz FROM nation),
f AS (SELECT p_partkey AS p, p_name, p_size, m.*, 15 + 6 * (row_number() OVER (PARTITION BY n ORDER BY p_partkey) - 1) AS a, (p_partkey * 7 + 1) % (SELECT count(*) FROM part) AS c FROM part JOIN m ON p_partkey % 25 = n),
s AS (SELECT file, module, 'os, sys' AS name, 'import' AS type, 1 AS a, 1 AS b, NULL AS signature, '' AS doc, [] AS decorators, false AS is_async, false AS is_static, NULL AS parent FROM m
  UNION ALL SELECT file, module, 'pkg.m' || xx, 'import', 2, 2, NULL, '', [], false, false, NULL FROM m UNION ALL SELECT file, module, '.', 'import', 3, 3, NULL, '', [], false, false, NULL FROM m
  UNION ALL SELECT file, module, 'C' || nn, 'class', 5, 13, 'class C' || nn || '(Base' || r || ', C' || zz || ')', n_name, [], false, false, NULL FROM m
  UNION ALL SELECT file, module, 'C' || nn || '.make', 'method', 9, 10, 'def make(x)', '', ['@staticmethod'], false, true, module || '.C' || nn FROM m
  UNION ALL SELECT file, module, 'C' || nn || '.run', 'method', 12, 13, 'def run(self)', '', [], false, false, module || '.C' || nn FROM m
  UNION ALL SELECT file, module, 'f' || p, 'function', a, a + 4, (CASE WHEN p % 3 = 0 THEN 'async ' ELSE '' END) || 'def f' || p || '(x: int = ' || p_size || ')', p_name, [], p % 3 = 0, false, NULL FROM f),
t AS (SELECT *, CASE WHEN type = 'import' THEN module || '::<import>' || name ELSE module || '.' || name END AS qualified, CASE WHEN type = 'method' THEN split_part(name, '.', 2) ELSE name END AS short,
  file || ':' || qualified || ':' || type || ':' || a || ':' || b AS id FROM s)"""
_CALLS = """
k AS (SELECT 'C' || nn || '.make' AS caller, 'f' || n AS callee, file, 10 AS line, true AS resolved, file AS callee_file, 15 AS callee_line FROM m
  UNION ALL SELECT 'C' || nn || '.run', 'C' || nn || '.make', file, 13, true, file, 9 FROM m UNION ALL SELECT 'C' || nn || '.run', 'f' || x, file, 13, true, 'pkg/m' || xx || '.py', 15 FROM m
  UNION ALL SELECT 'f' || p, 'f' || y, file, a + 3, true, 'pkg/m' || yy || '.py', 15 FROM f
  UNION ALL SELECT 'f' || p, 'f' || c, file, a + 4, c % 25 = n, CASE WHEN c % 25 = n THEN file END, CASE WHEN c % 25 = n THEN 15 + 6 * (c // 25) END FROM f)"""


@query("code_symbols", f"WITH {_CODE} SELECT file AS file_path, name, type, a::INT AS start_line, b::INT AS end_line, coalesce(signature, '') AS signature, doc AS docstring, array_to_string(decorators, ',') AS decorators, is_async, is_static FROM s")
def code_symbols(spark, d):
    found = parse.symbols(repository(spark, d))
    signature = F.coalesce("signature", F.lit(""))
    return found.select(
        "file_path", "name", "type", "start_line", "end_line", signature.alias("signature"), "docstring",
        F.array_join("decorators", ",").alias("decorators"), "is_async", "is_static",
    )


@query("code_import_names", f"""WITH {_CODE}
SELECT file AS file_path, unnest(['os', 'sys', 'f' || x, 'm' || yy]) AS name, unnest([NULL, 'system', 'alias' || n, NULL]) AS alias, unnest(['', '', 'pkg.m' || xx, '.']) AS module FROM m""")
def code_import_names(spark, d):
    rows = parse.symbols(repository(spark, d)).where("type = 'import'")
    return rows.select("file_path", F.explode("imports").alias("i"), F.coalesce("module", F.lit("")).alias("module")).select("file_path", "i.name", "i.alias", "module")


@query("code_chunks", f"WITH {_CODE} SELECT file AS file_path, 'module imports' AS parent_symbol, 1 AS start_line, 3 AS end_line FROM m UNION ALL SELECT file, name, a::INT, b::INT FROM s WHERE type IN ('class', 'function')")
def code_chunks(spark, d):
    return parse.chunks(repository(spark, d)).select("file_path", "parent_symbol", "start_line", "end_line")


@query("code_chunks_split", f"""WITH {_CODE}
SELECT file AS file_path, 'module imports' AS parent_symbol, 1 AS start_line, 3 AS end_line, 'import os, sys as system' AS first FROM m UNION ALL SELECT file, name, a::INT, CASE WHEN type = 'class' THEN 8 ELSE b END::INT, signature || ':' FROM s WHERE type = 'class'
UNION ALL SELECT file, name, a::INT, b::INT, '    ' || signature || ':' FROM s WHERE type = 'method'
UNION ALL SELECT file, name, unnest([a + 1, a + 3])::INT, unnest([a + 1, a + 4])::INT, signature || ':' FROM s WHERE type = 'function'""")
def code_chunks_split(spark, d):
    """A budget of 24 tokens: classes go by member, functions by the groups between their blank lines."""
    rows = parse.chunks(repository(spark, d), max_tokens=24)
    return rows.select("file_path", "parent_symbol", "start_line", "end_line", F.split("content", "\n")[0].alias("first"))


@query("code_symbol_table", f"WITH {_CODE} SELECT id AS symbol_id, short AS name, qualified AS qualified_name, module, parent AS parent_symbol FROM t")
def code_symbol_table(spark, d):
    return symbols.symbol_table(_parsed(spark, d)[1]).select("symbol_id", "name", "qualified_name", "module", "parent_symbol")


@query("code_symbol_lookups", f"""WITH {_CODE}
SELECT 'exact' AS kind, id FROM t WHERE short = 'make' UNION ALL SELECT 'qualified', id FROM t WHERE qualified = 'pkg.m03.f28' UNION ALL SELECT 'regex', id FROM t WHERE regexp_matches(short, '^f1.5$') OR regexp_matches(qualified, '^f1.5$')
UNION ALL SELECT 'file', id FROM t WHERE file = 'pkg/m07.py'""")
def code_symbol_lookups(spark, d):
    table = _table(_parsed(spark, d)[1])
    found = {
        "exact": symbols.lookup_exact(table, "make"), "qualified": symbols.lookup_qualified(table, "pkg.m03.f28"),
        "regex": symbols.lookup_regex(table, "^f1.5$"), "file": symbols.lookup_file(table, "pkg/m07.py"),
    }
    out = None
    for kind, rows in found.items():
        part = rows.select(F.lit(kind).alias("kind"), F.col("symbol_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("code_call_edges", f"WITH {_CODE}, {_CALLS} SELECT caller, callee, file AS call_site_file, line::INT AS call_site_line, resolved, callee_file, callee_line::INT AS callee_line FROM k")
def code_call_edges(spark, d):
    return _call_edges(*_parsed(spark, d)).drop("call_text")


@query("code_dependency_edges", f"""WITH {_CODE}
SELECT module AS source, unnest(['os', 'sys', 'pkg.m' || xx, 'pkg.m' || yy]) AS target, unnest(['import', 'import', 'from_import', 'from_import']) AS import_type, unnest(['os', 'sys', 'f' || x || ' as alias' || n, 'm' || yy]) AS imported_names, unnest([false, false, true, true]) AS resolved FROM m""")
def code_dependency_edges(spark, d):
    files, rows = _parsed(spark, d)
    found = symbols.dependency_edges(rows, files)
    return found.select("source", "target", "import_type", F.array_join("imported_names", ",").alias("imported_names"), "resolved")


def _parsed(spark, d) -> tuple[DataFrame, DataFrame]:
    """The files and their stored symbols: graphs read them many times, and each file is parsed once."""
    files = materialize(repository(spark, d), "code-files")
    return files, materialize(parse.symbols(files), "code-symbols")


def _call_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    return symbols.call_edges(found, materialize(parse.calls(files), "code-calls"), files)


def _table(found: DataFrame) -> DataFrame:
    """The stored symbol table: its readers take it several times."""
    return materialize(symbols.symbol_table(found), "code-table")


def _calls_edges(files: DataFrame, found: DataFrame, table: DataFrame) -> DataFrame:
    """Each side of a call is looked up and joined back, so the calls are resolved once and stored."""
    return symbols.calls_edges(materialize(_call_edges(files, found), "code-call-edges"), table)


@query("code_graph_nodes", f"""WITH {_CODE}
SELECT 'module:' || module AS id, 'Module' AS label, 'm' || nn AS name, 'module' AS type, file AS file_path FROM m
UNION ALL SELECT id, CASE WHEN type = 'class' THEN 'Class' ELSE 'Function' END, short, type, file FROM t WHERE type <> 'import'""")
def code_graph_nodes(spark, d):
    return symbols.graph_nodes(_table(_parsed(spark, d)[1])).select("id", "label", "name", "type", "file_path")


@query("code_contains_edges", f"WITH {_CODE} SELECT coalesce(o.id, 'module:' || t.module) AS source_id, t.id AS target_id FROM t LEFT JOIN t o ON o.qualified = t.parent WHERE t.type <> 'import'")
def code_contains_edges(spark, d):
    return symbols.contains_edges(_table(_parsed(spark, d)[1])).select("source_id", "target_id")


@query("code_inherits_edges", f"WITH {_CODE} SELECT t.id AS source_id, o.id AS target_id FROM m JOIN t ON t.module = m.module AND t.type = 'class' JOIN t o ON o.short = 'C' || m.zz AND o.type = 'class'")
def code_inherits_edges(spark, d):
    return symbols.inherits_edges(_table(_parsed(spark, d)[1])).select("source_id", "target_id")


@query("code_calls_edges", f"""WITH {_CODE}, {_CALLS},
a AS (SELECT t.id, t.file, t.name FROM t WHERE type IN ('function', 'method')), h AS (SELECT DISTINCT caller, file, callee, line FROM k)
SELECT a.id AS source_id, b.id AS target_id, h.line::INT AS call_site_line FROM h JOIN a ON a.name = h.caller AND a.file = h.file JOIN a b ON b.name = h.callee AND (b.name NOT LIKE 'C%' OR b.file = h.file)""")
def code_calls_edges(spark, d):
    """A method is known by its short name, so a caller ``C.make`` is found through ``make`` in its own file."""
    files, found = _parsed(spark, d)
    return _calls_edges(files, found, _table(found)).select("source_id", "target_id", "call_site_line")


@query("code_imports_edges", f"WITH {_CODE} SELECT 'module:' || module AS source_id, 'module:' || unnest(['os', 'sys', 'pkg.m' || xx, 'pkg.m' || yy]) AS target_id, unnest(['', '', 'pkg/m' || xx || '.py', 'pkg/m' || yy || '.py']) AS target_file FROM m")
def code_imports_edges(spark, d):
    files, found = _parsed(spark, d)
    return symbols.imports_edges(symbols.dependency_edges(found, files)).select("source_id", "target_id", "target_file")


@query("code_graph_traversal", f"""WITH {_CODE}
SELECT 'module:pkg.m' || xx AS id, 1 AS distance FROM m WHERE n = 3 UNION SELECT 'module:pkg.m' || yy, 1 FROM m WHERE n = 3""")
def code_graph_traversal(spark, d):
    """Outgoing IMPORTS edges only, of one module of the stored code graph (imports from outside have no node)."""
    files, found = _parsed(spark, d)
    table = _table(found)
    nodes, edges = symbols.graph_of(table)
    kept = ["source_id", "target_id", "type"]
    graph = store.GraphStore(spark.createDataFrame([], nodes.schema), spark.createDataFrame([], edges.select(*kept).schema))
    graph.put_nodes(nodes)
    for part in (edges, _calls_edges(files, found, table), symbols.imports_edges(symbols.dependency_edges(found, files))):
        graph.put_edges(part.select(*kept))
    return traverse.neighbors(graph.nodes, graph.edges, "module:pkg.m03", direction="out", edge_types=["IMPORTS"]).select("id", "distance")


@query("code_node_results", f"WITH {_CODE} SELECT id, qualified AS symbol, type AS symbol_type, signature AS text FROM t WHERE type = 'class' UNION ALL SELECT 'module:' || module, module, 'module', module FROM m")
def code_node_results(spark, d):
    nodes = symbols.graph_nodes(_table(_parsed(spark, d)[1])).where("type in ('class', 'module')")
    return traverse.as_results(nodes).select("id", "symbol", "symbol_type", "text")


@query("code_scoped_symbols", f"""WITH {_CODE}
SELECT file AS file_path, 'os' AS qualified_name, 'import' AS kind, NULL AS signature, NULL AS parent FROM m UNION ALL SELECT file, 'sys', 'import', NULL, NULL FROM m
UNION ALL SELECT file, 'pkg.m' || xx || '.f' || x, 'import', NULL, NULL FROM m UNION ALL SELECT file, '..m' || yy, 'import', NULL, NULL FROM m
UNION ALL SELECT file, name, CASE WHEN is_async THEN 'async_' ELSE '' END || type, regexp_replace(signature, ': int = [0-9]+', ''), CASE WHEN type = 'method' THEN split_part(name, '.', 1) END FROM s WHERE type <> 'import'""")
def code_scoped_symbols(spark, d):
    return parse.scoped_symbols(repository(spark, d)).select("file_path", "qualified_name", "kind", "signature", "parent")


@query("code_plain_chunks", f"WITH {_CODE} SELECT file AS file_path, CASE WHEN is_async THEN 'async_' ELSE '' END || type AS kind, name, a::INT AS start_line, b::INT AS end_line FROM s WHERE type IN ('class', 'function')")
def code_plain_chunks(spark, d):
    return parse.plain_chunks(repository(spark, d)).select("file_path", "kind", "name", "start_line", "end_line")


@query("code_syntax_nodes", f"""WITH {_CODE}, c AS (SELECT file, count(*) AS f, count(*) FILTER (WHERE is_async) AS g FROM s WHERE type = 'function' GROUP BY file)
SELECT file AS file_path, unnest(['Call', 'ClassDef', 'FunctionDef', 'AsyncFunctionDef', 'Return', 'module']) AS type, unnest([3 + 2 * f, 1, 2 + f - g, g, 2 + f, 1]) AS n FROM c""")
def code_syntax_nodes(spark, d):
    rows = parse.syntax_nodes(repository(spark, d)).where("type in ('Call', 'ClassDef', 'FunctionDef', 'AsyncFunctionDef', 'Return', 'module')")
    return rows.groupBy("file_path", "type").agg(F.count(F.lit(1)).alias("n"))


@query("code_recovery", f"WITH {_CODE} SELECT file AS file_path, name, type, a::INT AS start_line, CASE WHEN type = 'class' THEN 12 ELSE b END::INT AS end_line FROM s WHERE name NOT LIKE '%.run'")
def code_recovery(spark, d):
    """A method with a broken head, the last of its class, and a broken statement in each file's first function: the method is
    lost, everything around it is found, with its lines."""
    broken = F.regexp_replace(F.regexp_replace("source", r"def run\(self\):", "def run(self:"), r"(?s)(y = m\d\d\.f\d+)\(x\)(.*)", "$1(x$2")
    rows = parse.symbols(repository(spark, d).withColumn("source", broken))
    return rows.select("file_path", "name", "type", "start_line", "end_line")


@query("code_parsed_files", f"WITH {_CODE} SELECT file AS file_path, n % 2 = 1 AS has_errors FROM m")
def code_parsed_files(spark, d):
    files = repository(spark, d)
    cut = F.when(F.col("file_ord") % 2 == 1, F.concat("source", F.lit("\ndef open("))).otherwise(F.col("source"))
    return parse.parsed_files(files.withColumn("source", cut).withColumn("language", F.lit("python")))
