"""Symbol table, call graph and dependency graph: joins over the parsed tables.

Input order matters where several targets match (first wins) or aliases repeat (last wins): files carry ``file_ord``
and symbols ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import module_name, qualified_name, short_name
from lodestone.operators.store import latest


# -- symbol table ---------------------------------------------------------------------------------------------------


def symbol_table(symbols: DataFrame) -> DataFrame:
    """Symbol records with module, qualified and short name, id and the parent's qualified name; one per symbol_id."""
    module = module_name("file_path")
    rows = symbols.select("*", module.alias("file_module"))
    rows = rows.withColumn("qualified_name", qualified_name(F.col("type"), F.col("file_module"), F.col("name")))
    parents = rows.select(F.col("file_path").alias("_f"), F.col("ord").alias("_o"), F.col("qualified_name").alias("parent_symbol"))
    rows = rows.join(parents, (F.col("file_path") == F.col("_f")) & (F.col("parent_ord") == F.col("_o")), "left")
    out = rows.select(
        F.concat_ws(":", "file_path", "qualified_name", "type", "start_line", "end_line").alias("symbol_id"),
        short_name(F.col("type"), F.col("name")).alias("name"),
        "qualified_name", "type", "file_path", F.col("file_module").alias("module"), "start_line", "end_line", "signature", "docstring", "decorators", "parent_symbol", "is_async", "bases", "file_ord", "ord",
    )
    return latest(out, ["symbol_id"], ["file_ord", "ord"])


ORDER = ("qualified_name", "file_path", "start_line", "end_line")


def lookup_exact(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("name") == name).orderBy(*ORDER)


def lookup_qualified(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("qualified_name") == name).orderBy(*ORDER)


def lookup_regex(table: DataFrame, pattern: str) -> DataFrame:
    return table.where(F.col("name").rlike(pattern) | F.col("qualified_name").rlike(pattern)).orderBy(*ORDER)


def lookup_file(table: DataFrame, path: str) -> DataFrame:
    return table.where(F.col("file_path") == path).orderBy(*ORDER)


def to_json(table: DataFrame) -> DataFrame:
    """Each record as JSON with its keys sorted; read back by ``from_json``."""
    return table.select(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame, schema) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


# -- call graph -----------------------------------------------------------------------------------------------------


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], line: str, ident: list[str], bucket: int = 64) -> DataFrame:
    """Each point with the innermost span that holds its line: the latest start, then the shortest.

    A range join as an equi-join: a span is listed in each bucket of lines that it touches, a point lies in one, so a
    pair meets once and points only meet spans near them.  Points outside all spans are dropped.
    """
    # start and shortness as one number, so that the many meetings are reduced by a hash aggregation over longs
    width = 1 << 31
    s = spans.where("start_line <= end_line").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("start_line").cast("long").alias("_a"), F.col("end_line").cast("long").alias("_b"))
    listed = s.select("*", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor(F.col("_b") / bucket))).alias("_bucket"))
    placed = points.withColumn("_at", F.floor(F.col(line) / bucket))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_at") == F.col("_bucket"), F.col(line).between(F.col("_a"), F.col("_b"))]
    inner = placed.join(listed, on).groupBy(*ident).agg(F.max(F.col("_a") * width + (width - 1 - F.col("_b") + F.col("_a"))).alias("_rank"))
    start = F.floor(F.col("_rank") / width).cast("long")
    best = inner.select(*ident, start.alias("_start"), (start + width - 1 - F.pmod(F.col("_rank"), F.lit(width))).alias("_end"))
    first = spans.groupBy(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("start_line").cast("long").alias("_s"), F.col("end_line").cast("long").alias("_e"),
    ).agg(F.min_by(F.struct(*(c for c in spans.columns if c not in keys)), "ord").alias("span"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_start") == F.col("_s"), F.col("_end") == F.col("_e")]
    return points.join(best, ident).join(first, on).select(*points.columns, "span")


def name_index(symbols: DataFrame) -> DataFrame:
    """key -> target: every callable and class under its name and its short name (a plain function is listed twice)."""
    callable_ = symbols.where(F.col("type").isin("function", "method", "class"))
    short = F.element_at(F.split("name", r"\."), -1)
    return callable_.select(
        F.explode(F.array("name", short)).alias("key"), F.col("name").alias("callee"), F.col("file_path").alias("callee_file"),
        F.col("start_line").alias("callee_line"), F.struct("file_ord", "ord").alias("at"),
    )


def module_index(files: DataFrame) -> DataFrame:
    """module -> file of Python files, by dotted path and by bare stem; the last file wins."""
    path = F.regexp_replace("file_path", r"\.py$", "")
    keys = F.array(F.translate(path, "/", "."), F.element_at(F.split(path, "/"), -1))
    rows = files.where(F.col("file_path").endswith(".py")).select(F.explode(keys).alias("module"), "file_path", "file_ord")
    return rows.groupBy("module").agg(F.max_by("file_path", "file_ord").alias("module_file"))


def import_aliases(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_path, alias) -> imported path; later imports override earlier ones."""
    imports = symbols.where(F.col("type") == "import").select("file_path", "ord", "module", "is_from_import", F.posexplode("imports").alias("pos", "i"))
    name, alias = F.col("i.name"), F.col("i.alias")
    bound = imports.select(
        "file_path", F.struct("ord", "pos", F.lit(0).alias("k")).alias("at"),
        F.when(F.col("is_from_import"), F.coalesce(alias, name)).otherwise(F.coalesce(alias, F.element_at(F.split(name, r"\."), 1))).alias("alias"),
        F.when(F.col("is_from_import"), F.concat("module", F.lit("."), name)).otherwise(name).alias("path"),
    )
    unknown = imports.where(~F.col("is_from_import")).join(modules, F.col("i.name") == modules.module, "left_anti")
    bound = bound.unionByName(unknown.select("file_path", F.struct("ord", "pos", F.lit(1).alias("k")).alias("at"), name.alias("alias"), name.alias("path")))
    return bound.groupBy("file_path", "alias").agg(F.max_by("path", "at").alias("path"))


def _first(rows: DataFrame, ident: list[str], order: Column) -> DataFrame:
    return rows.groupBy(*ident).agg(F.min_by(F.struct("callee", "callee_file", "callee_line"), order).alias("t"))


def call_edges(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Resolved and unresolved calls: same file first, then imports, then a name that is listed exactly once."""
    index, modules = name_index(symbols), module_index(files)
    spans = symbols.where(F.col("type").isin("function", "method", "class")).select("file_path", "start_line", "end_line", "ord", F.col("name").alias("caller"))
    ident = ["file_path", "ord"]
    sites = enclosing(calls.select("file_path", "ord", "line", "expression", "call_text"), spans, ["file_path"], "line", ident)
    sites = sites.select(*ident, "line", "expression", "call_text", F.col("span.caller").alias("caller"), F.split("expression", r"\.").alias("parts")).where(F.col("expression") != "")
    last = F.element_at("parts", -1)
    owner = F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1)
    own = (F.size("parts") == 2) & F.col("parts")[0].isin("self", "cls") & (owner != "")
    candidates = F.array_distinct(F.filter(F.array("expression", F.when(own, F.concat(owner, F.lit("."), last)), last), lambda c: c.isNotNull()))
    tried = sites.select(*ident, F.posexplode(candidates).alias("pos", "key"))
    same = _first(tried.join(index, "key").where(F.col("callee_file") == F.col("file_path")), ident, F.struct("pos", "at"))

    aliases = import_aliases(symbols, modules).select(F.col("file_path").alias("_f"), "alias", "path")
    known = sites.join(aliases, (F.col("file_path") == F.col("_f")) & (F.col("parts")[0] == F.col("alias")))
    imported = F.split("path", r"\.")
    parent = F.when(F.size(imported) > 1, F.array_join(F.slice(imported, 1, F.greatest(F.size(imported) - 1, F.lit(1))), "."))
    known = known.select(
        *ident, "expression", F.when(F.size("parts") > 1, last).otherwise(F.element_at(imported, -1)).alias("member"),
        F.when(F.size("parts") > 1, F.col("path")).otherwise(F.coalesce(parent, F.lit(""))).alias("m1"), parent.alias("m2"),
    )
    m1, m2 = modules.select(F.col("module").alias("m1"), F.col("module_file").alias("f1")), modules.select(F.col("module").alias("m2"), F.col("module_file").alias("f2"))
    known = known.join(m1, "m1", "left").join(m2, "m2", "left").withColumn("want", F.coalesce("f1", "f2"))
    tried = known.select(*ident, "want", F.posexplode(F.array("member", "expression")).alias("pos", "key")).join(index, "key")
    through = _first(tried.where(F.col("want").isNull() | (F.col("want") == F.col("callee_file"))), ident, F.struct("pos", "at"))

    single = index.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.first("callee").alias("callee"), F.first("callee_file").alias("callee_file"),
        F.first("callee_line").alias("callee_line"), F.first("at").alias("at"),
    ).where("n = 1")
    tried = sites.select(*ident, F.posexplode(F.array_distinct(F.array("expression", last))).alias("pos", "key"))
    unique = _first(tried.join(single, "key"), ident, F.struct("pos", "at"))

    joined = sites
    for name, found in (("a", same), ("b", through), ("c", unique)):
        joined = joined.join(found.withColumnRenamed("t", name), ident, "left")
    t = F.coalesce("a", "b", "c")
    return joined.select(
        "caller", F.coalesce(t["callee"], F.col("expression")).alias("callee"), F.col("file_path").alias("call_site_file"),
        F.col("line").alias("call_site_line"), "call_text", t.isNotNull().alias("resolved"), t["callee_file"].alias("callee_file"),
        t["callee_line"].alias("callee_line"),
    )


# -- dependency graph -----------------------------------------------------------------------------------------------


def absolute_module(module: Column, source_module: Column) -> Column:
    """A module name with its leading dots resolved against the importing module."""
    level = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    parts = F.split(source_module, r"\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))
    joined = F.array_join(F.filter(F.concat(base, F.array(rest)), lambda p: p != ""), ".")
    return F.when(level == 0, module).otherwise(joined)


def dependency_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One edge per plainly imported name, and one per target of a from-import."""
    known = files.select(module_name("file_path").alias("_m"), "file_path", "file_ord").groupBy("_m").agg(F.max_by("file_path", "file_ord").alias("target_file"))
    imports = symbols.where(F.col("type") == "import").select("file_path", "ord", "module", "is_from_import", F.posexplode("imports").alias("pos", "i"))
    imports = imports.withColumn("source", module_name("file_path"))
    base = absolute_module(F.col("module"), F.col("source"))
    relative = F.regexp_replace("module", r"^\.+", "") == ""
    rows = imports.select("*", base.alias("base"), relative.alias("relative")).withColumn("sub", F.concat_ws(".", "base", "i.name"))
    rows = rows.join(
        known.select(F.col("_m").alias("sub")), "sub", "left_semi",
    ).select("file_path", "ord", "pos", F.lit(True).alias("is_sub")).join(rows, ["file_path", "ord", "pos"], "right")
    target = F.when(~F.col("is_from_import"), F.col("i.name")).when(
        F.col("relative") | (F.coalesce("is_sub", F.lit(False)) & (F.col("i.name") != "*")), F.col("sub"),
    ).otherwise(F.col("base"))
    rows = rows.select(
        "source", target.alias("target"), "file_path", "ord", F.when(F.col("is_from_import"), -1).otherwise(F.col("pos")).alias("part"), "pos",
        "is_from_import", "base", F.col("i.name").alias("name"),
        F.concat_ws(" as ", "i.name", F.when(F.col("is_from_import"), F.col("i.alias"))).alias("shown"),
    )
    grouped = rows.groupBy("source", "target", "file_path", "ord", "part", "is_from_import", "base").agg(
        F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("names"), F.bool_or(F.col("name") == "*").alias("star"),
    )
    star = F.col("star") & F.col("is_from_import")
    edges = grouped.join(known, F.col("target") == F.col("_m"), "left")
    return edges.select(
        "source", "target", F.when(F.col("is_from_import"), "from_import").otherwise("import").alias("import_type"),
        F.transform("names", lambda x: x["shown"]).alias("imported_names"), F.col("file_path").alias("source_file"), "target_file",
        F.col("target_file").isNotNull().alias("resolved"), star.alias("is_star_import"),
        F.when(star, F.concat(F.lit("Star import from "), "base", F.lit(" makes dependencies implicit"))).alias("warning"),
    )


# -- graph rows -----------------------------------------------------------------------------------------------------


def graph_nodes(table: DataFrame) -> DataFrame:
    """Module nodes and one node per symbol that is no import."""
    own = table.where(F.col("type") != "import")
    label = F.when(F.col("type") == "class", "Class").when(F.col("type").isin("function", "method"), "Function").otherwise("Module")
    nodes = own.select(F.col("symbol_id").alias("id"), label.alias("label"), "name", "qualified_name", "type", "file_path", "start_line", "end_line", "signature")
    none = F.lit(None)
    modules = table.groupBy("module").agg(F.max_by("file_path", F.struct(*ORDER)).alias("file_path"))
    modules = modules.select(
        F.concat(F.lit("module:"), "module").alias("id"), F.lit("Module").alias("label"), F.element_at(F.split("module", r"\."), -1).alias("name"),
        F.col("module").alias("qualified_name"), F.lit("module").alias("type"), "file_path", none.cast("int").alias("start_line"),
        none.cast("int").alias("end_line"), none.cast("string").alias("signature"),
    )
    return modules.unionByName(nodes)


def contains_edges(table: DataFrame) -> DataFrame:
    """Parent symbol (else module) to child."""
    own = table.where(F.col("type") != "import")
    parents = own.groupBy(F.col("qualified_name").alias("_q")).agg(F.max_by("symbol_id", F.struct(*ORDER)).alias("_id"))
    rows = own.join(parents, own.parent_symbol == parents._q, "left")
    return rows.select(F.coalesce("_id", F.concat(F.lit("module:"), "module")).alias("source_id"), F.col("symbol_id").alias("target_id"), F.lit("CONTAINS").alias("type"))


def resolved_names(wanted: DataFrame, table: DataFrame, ident: list[str], name: str, file: str | None) -> DataFrame:
    """The symbol of each wanted name: exact short name, else its last dotted part; the same file first, then the sort
    order.  The table is reduced to the first symbol of each name (and file) before it is joined, so common names cost
    one row each."""
    own = table.where(F.col("type") != "import").select(F.col("name").alias("_n"), F.col("symbol_id").alias("found"), F.col("file_path").alias("_file"), F.struct(*ORDER).alias("_order"))
    part = F.element_at(F.split(name, r"\."), -1)
    once = wanted.select(*dict.fromkeys([*ident, name, *([file] if file else [])])).distinct()  # a name is wanted by many rows
    keys = once.select("*", F.posexplode(F.array_distinct(F.array(name, part))).alias("_pos", "_n"))
    found = keys.join(own.groupBy("_n").agg(F.min_by("found", "_order").alias("_any")), "_n")
    best = F.col("_any")
    if file is not None:
        near = own.groupBy(F.col("_n").alias("_m"), "_file").agg(F.min_by("found", "_order").alias("_same"))
        found = found.join(near, (F.col("_n") == F.col("_m")) & (F.col(file) == F.col("_file")), "left")
        best = F.coalesce("_same", "_any")
    return found.groupBy(*ident).agg(F.min_by(best, "_pos").alias("found"))


def inherits_edges(table: DataFrame) -> DataFrame:
    """Class to each base that the table knows by name."""
    rows = table.where(F.col("type") == "class").select(F.col("symbol_id").alias("source_id"), F.explode("bases").alias("base"))
    found = resolved_names(rows, table, ["source_id", "base"], "base", None)
    return found.select("source_id", F.col("found").alias("target_id"), F.lit("INHERITS").alias("type")).distinct()


def calls_edges(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Call edges between symbols that the table knows; each side is looked up by name, its file first."""
    rows = edges.withColumn("_callee_file", F.coalesce("callee_file", F.lit("")))
    a = resolved_names(rows, table, ["caller", "call_site_file"], "caller", "call_site_file").withColumnRenamed("found", "source_id")
    b = resolved_names(rows, table, ["callee", "_callee_file"], "callee", "_callee_file").withColumnRenamed("found", "target_id")
    joined = rows.join(a, ["caller", "call_site_file"]).join(b, ["callee", "_callee_file"])
    return joined.select("source_id", "target_id", F.lit("CALLS").alias("type"), "call_site_file", "call_site_line", "call_text")


def imports_edges(edges: DataFrame) -> DataFrame:
    """Module to module; unknown files are ''."""
    return edges.select(
        F.concat(F.lit("module:"), "source").alias("source_id"), F.concat(F.lit("module:"), "target").alias("target_id"),
        F.lit("IMPORTS").alias("type"), "import_type", F.array_join("imported_names", ",").alias("imported_names"),
        F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("target_file", F.lit("")).alias("target_file"),
    )


def graph_of(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and CONTAINS and INHERITS edges, of a symbol table."""
    return graph_nodes(table), contains_edges(table).unionByName(inherits_edges(table))


def import_groups(rows: DataFrame, keys: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """Runs of adjacent ranges per key: group, first and last line, members."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    fresh = F.when(F.col(start) > F.lag(end).over(order) + 1, 1).otherwise(0)
    marked = rows.withColumn("_new", fresh).withColumn("group_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "group_no").agg(F.min(start).alias("start_line"), F.max(end).alias("end_line"), F.count(F.lit(1)).alias("members"))
