"""Question planning: classification, decomposition, routing, and execution in dependency order.

Classification and routing are CASE columns, so a whole table of questions is planned in one pass; a single question's
plan is run on the driver with DataFrames as values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.checks import one_of
from lodestone.storage import materialize, release

CATEGORIES = ("simple-lookup", "multi-hop", "exploratory")
ANSWER_TYPES = ("symbol", "path", "files", "explanation", "evidence")
STRATEGIES = ("bm25", "graph", "vector", "hybrid")
#: The least confidence, and those of each class.
THRESHOLD = 0.55
SURE = {"multi-hop": 0.86, "exploratory": 0.82, "simple-lookup": 0.84, "blank": 0.0, "unknown": 0.4}
#: The patterns of each class, tried in this order (multi-hop, exploratory, simple-lookup).
MULTI_HOP = (r"\bhow\s+does\b.*\bflow\b", r"\bpath\s+between\b", r"\btrace\b", r"\bcall\s+chain\b", r"\bend[- ]?to[- ]?end\b", r"\bimpact\b", r"\bdependencies?\b", r"\bfrom\b.*\bto\b")
EXPLORATORY = (r"\boverview\b", r"\barchitecture\b", r"\bexplain\b", r"\bwhat\s+should\s+i\s+read\b", r"\bcompare\b", r"\bsummarize\b", r"\bexplore\b", r"\bunderstand\b")
SIMPLE = (
    r"\bwhere\s+is\b", r"\bdefined\b", r"\bdefinition\b", r"\bfind\s+(function|class|method|symbol)\b", r"\bwhat\s+(calls|imports)\b",
    r"\bshow\s+(function|class|method|symbol)\b", r"\bfile\s+contains\b",
)
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$"
#: The patterns of the router.
STRUCTURAL = r"\b(path|trace|call chain|calls|imports|dependencies|flow|graph)\b"
LOOKUP = r"\b(where|find|show)\b.*\b(function|class|method|symbol)\b"
EVIDENCE = r"\b(collect|supporting|evidence|combine)\b"


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, p: a | text.rlike(p), patterns, F.lit(False))


def _identifier(text: Column) -> Column:
    return F.btrim(text, F.lit("`'\" ")).rlike(IDENTIFIER)


def classified(questions: DataFrame, query: str = "query", threshold: float = THRESHOLD) -> DataFrame:
    """The questions with category, confidence, raw_category and used_fallback."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    text = F.coalesce(F.col(query), F.lit(""))
    low = F.lower(text)
    blank = F.regexp_replace(text, r"(?U)\s", "") == ""
    raw = F.when(blank, "blank").when(_matches(low, MULTI_HOP), "multi-hop").when(_matches(low, EXPLORATORY), "exploratory").when(
        _matches(low, SIMPLE) | _identifier(text), "simple-lookup",
    ).otherwise("unknown")
    rows = questions.withColumn("_raw", raw)
    sure = F.element_at(F.create_map(*(F.lit(x) for kv in SURE.items() for x in kv)), F.col("_raw"))
    rows = rows.withColumn("confidence", sure)
    weak = (F.col("confidence") < threshold) | F.col("_raw").isin("unknown", "blank")
    return rows.withColumn("category", F.when(weak, "multi-hop").otherwise(F.col("_raw"))).withColumn("used_fallback", weak).withColumnRenamed("_raw", "raw_category")


def routed(sub_queries: DataFrame, text: str = "text", answer_type: str = "expected_answer_type") -> DataFrame:
    """Sub-queries with the retrieval strategy for each."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    kind = F.coalesce(F.col(answer_type), F.lit(""))
    strategy = (
        F.when((kind == "path") | low.rlike(STRUCTURAL), "graph")
        .when((kind == "symbol") | low.rlike(LOOKUP) | _identifier(F.coalesce(F.col(text), F.lit(""))), "bm25")
        .when((kind == "evidence") | low.rlike(EVIDENCE), "hybrid")
        .otherwise("vector")
    )
    return sub_queries.withColumn("strategy", strategy)


def decomposed(questions: DataFrame, query: str = "query", keep: tuple[str, ...] = ()) -> DataFrame:
    """Classified questions exploded into sub-queries: three dependent ones for multi-hop, one otherwise."""
    def part(id_: str, text: Column, kind: Column | str, needs: tuple[str, ...]) -> Column:
        needs_ = F.array(*(F.lit(n) for n in needs)).cast("array<string>")
        return F.struct(F.lit(id_).alias("id"), text.alias("text"), (F.lit(kind) if isinstance(kind, str) else kind).alias("expected_answer_type"), needs_.alias("context_from"))

    q = F.col(query)
    three = F.array(
        part("q1", F.concat(F.lit("Find the entry symbols and files for: "), q), "symbol", ()),
        part("q2", F.lit("Trace calls, imports or graph paths from the symbols of q1."), "path", ("q1",)),
        part("q3", F.lit("Collect code chunks and documentation in support of the traced flow."), "evidence", ("q1", "q2")),
    )
    one = F.array(part("q1", q, F.when(F.col("category") == "exploratory", "explanation").otherwise("symbol"), ()))
    return classified(questions, query).select(
        *keep, query, "category", F.explode(F.when(F.col("category") == "multi-hop", three).otherwise(one)).alias("s"),
    ).select(*keep, query, "category", "s.*")


# -- one question on the driver -------------------------------------------------------------------------------------


def salvaged_json(text: str) -> dict:
    """The JSON object in a model's answer: the whole, else from the first brace to the last, else {}."""
    for candidate in (text or "", *(m.group(0) for m in [re.search(r"\{.*\}", text or "", re.S)] if m)):
        try:
            value = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {}


@dataclass(frozen=True)
class SubQuery:
    id: str
    text: str
    expected_answer_type: str = "evidence"
    context_from: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    query: str
    category: str
    confidence: float
    sub_queries: tuple[SubQuery, ...]
    edges: tuple[tuple[str, str], ...] = ()
    transitions: tuple[str, ...] = field(default=())


#: What a model is shown before a question: one of each class.
SHOTS = (
    ("Where is the tokenizer defined?", "simple-lookup", 0.95, "asks for one definition"),
    ("How does a request get from the endpoint to the store?", "multi-hop", 0.93, "follows calls through several files"),
    ("Which parts does the package have, and what are they for?", "exploratory", 0.9, "asks for an overview"),
)


def classification_prompt(query: str) -> str:
    """The question that a model is asked: the classes, one worked case of each, and the form of the answer."""
    meaning = {"simple-lookup": "one fact about one symbol or file", "multi-hop": "facts that must be followed from place to place", "exploratory": "an overview or comparison"}
    cases = [json.dumps({"query": q, "category": c, "confidence": s, "reason": r}) for q, c, s, r in SHOTS]
    return "\n".join([
        "Which kind of question about a source repository is this?", *(f"* {c}: {meaning[c]}" for c in CATEGORIES),
        "Answer with one JSON object: category, confidence from 0 to 1, reason.", "", *cases, "", json.dumps({"query": query}),
    ])


def classify(spark: SparkSession, query: str, threshold: float = THRESHOLD, model: Callable[[str], str] | None = None) -> dict:
    """category, confidence, raw_category and used_fallback of one question; a model answers in JSON."""
    if model is None or not query.strip():
        return classified(spark.createDataFrame([(query,)], "query string"), threshold=threshold).first().asDict()
    said = salvaged_json(model(classification_prompt(query)))
    raw = str(said.get("category", ""))
    try:
        sure = min(max(float(said.get("confidence", 0)), 0.0), 1.0)
    except (TypeError, ValueError):
        sure = 0.0
    weak = raw not in CATEGORIES or sure < threshold
    return {"query": query, "category": "multi-hop" if weak else raw, "confidence": sure, "raw_category": raw, "used_fallback": weak}


def decompose(spark: SparkSession, query: str, model: Callable[[str], str] | None = None, repo_context: str = "") -> Plan:
    """classify, route, decompose, validate, finalize: the plan of one question.

    A model's sub-queries are kept if two to five of them are usable; otherwise the fixed three-step plan is.
    """
    found = classify(spark, query)
    steps = ["classify", "route"]
    plan = decomposed(spark.createDataFrame([(query,)], "query string")).orderBy("id").collect()
    fixed = tuple(SubQuery(r.id, r.text, r.expected_answer_type, tuple(r.context_from)) for r in plan)
    if found["category"] != "multi-hop":
        return Plan(query, found["category"], found["confidence"], fixed, (), (*steps, "finalize"))
    hint = f" Repository context: {repo_context}" if repo_context else ""
    subs, edges = tuple(replace(s, text=s.text + hint) if s.id == "q1" else s for s in fixed), (("q1", "q2"), ("q2", "q3"))
    if model is not None:
        said = salvaged_json(model(query))
        mine = [SubQuery(str(x.get("id") or f"q{i}"), str(x["text"]).strip(), x.get("expected_answer_type") if x.get("expected_answer_type") in ANSWER_TYPES else "evidence", tuple(map(str, x.get("context_from") or ()))) for i, x in enumerate(said.get("sub_queries") or [], 1) if isinstance(x, dict) and str(x.get("text", "")).strip()]
        if 2 <= len(mine) <= 5:
            ids = {s.id for s in mine}
            subs = tuple(mine)
            edges = tuple((
                str(e.get("source")), str(e.get("target")),
            ) for e in said.get("dependency_edges") or [] if isinstance(e, dict) and e.get("source") in ids and e.get("target") in ids)
    return Plan(query, found["category"], found["confidence"], subs, edges, (*steps, "decompose", "validate", "finalize"))


def execution_order(plan: Plan) -> list[SubQuery]:
    """Sub-queries after all they depend on, otherwise in their given order; a ValueError for a cycle."""
    ids = [s.id for s in plan.sub_queries]
    needs = {s.id: {n for n in s.context_from if n in ids} | {a for a, b in plan.edges if b == s.id and a in ids} for s in plan.sub_queries}
    done: list[str] = []
    ready = [i for i in ids if not needs[i]]
    while ready:
        done.append(ready.pop(0))
        ready += [i for i in ids if i not in done and i not in ready and needs[i] <= set(done)]
    if len(done) < len(ids):
        raise ValueError("the sub-queries depend on each other in a cycle")
    return [next(s for s in plan.sub_queries if s.id == i) for i in done]


Executor = Callable[[SubQuery, dict[str, DataFrame], dict[str, DataFrame]], DataFrame]


def execute(spark: SparkSession, plan: Plan, executors: dict[str, Executor]) -> dict[str, DataFrame]:
    """Results by sub-query.  An executor gets the sub-query, the results it depends on and all earlier results; hybrid
    without one of its own is the others' results one after the other; no executor, no result."""
    from lodestone.operators.search import concatenated

    rows = spark.createDataFrame([(s.id, s.text, s.expected_answer_type) for s in plan.sub_queries], "id string, text string, expected_answer_type string")
    strategy = {r.id: r.strategy for r in routed(rows).collect()}
    results: dict[str, DataFrame] = {}
    for s in execution_order(plan):
        kind = strategy[s.id]
        one_of("strategy", kind, STRATEGIES)
        needed = {k: results[k] for k in (*s.context_from, *(a for a, b in plan.edges if b == s.id)) if k in results}
        if kind in executors:
            results[s.id] = executors[kind](s, needed, dict(results))
        elif kind == "hybrid" and any(k in executors for k in ("bm25", "vector", "graph")):
            results[s.id] = concatenated(**{k: executors[k](s, needed, dict(results)) for k in ("bm25", "vector", "graph") if k in executors})
    return results


#: Graphs up to this number of nodes and of edges are levelled on the driver.
SMALL = 100_000


def _levels(ids: list[str], edges: list[tuple[str, str]]) -> dict[str, int] | None:
    """The level of each node, None if there is a cycle: nodes leave once all they depend on has left."""
    level, waits, after = dict.fromkeys(ids, 0), dict.fromkeys(ids, 0), {}
    for a, b in edges:
        waits[b] += 1
        after.setdefault(a, []).append(b)
    ready, done = [i for i, n in waits.items() if not n], 0
    while ready:
        a = ready.pop()
        done += 1
        for b in after.get(a, ()):
            level[b] = max(level[b], level[a] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    return level if done == len(level) else None


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the longest chain of (source, target) dependencies that leads to each node; a ValueError for a cycle.

    Edges with an unknown end do not count.  Small graphs, as plans are, are levelled in one pass on the driver.  Of others, nodes on
    which nothing depends are set aside first, layer by layer, as long as that halves the edges at least; what is left is
    levelled on the driver if it is small, else by joins, a level each, and the layers follow from it, one join each.
    """
    ids = nodes.select("id").distinct()
    inner = edges.select("source", "target").distinct().join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi")
    if len(nodes.select("id").limit(SMALL + 1).collect()) <= SMALL and len(edges.select("source", "target").limit(SMALL + 1).collect()) <= SMALL:
        level = _levels([r.id for r in ids.collect()], [(r.source, r.target) for r in inner.collect()])
        if level is None:
            raise ValueError("the dependencies form a cycle")
        return nodes.sparkSession.createDataFrame(list(level.items()), f"id {dict(ids.dtypes)['id']}, level int")
    ids = materialize(ids, "nodes")
    known = F.col("id")
    inner = edges.select("source", "target").distinct().join(ids, F.col("source") == known, "left_semi").join(ids, F.col("target") == known, "left_semi")
    core, layers = materialize(inner, "dependencies"), []
    size = core.count()
    while size > SMALL:
        needed = core.select(F.col("source").alias("_needed")).distinct()
        rest = materialize(core.join(needed, F.col("target") == F.col("_needed"), "left_semi"), "dependencies")
        left = rest.count()
        if 2 * left > size:
            release(rest)
            break
        layers.append(core.join(needed, F.col("target") == F.col("_needed"), "left_anti"))
        core, size = rest, left
    if size <= SMALL:
        links = [(r.source, r.target) for r in core.collect()]
        found = _levels(list({i for link in links for i in link}), links)
        if found is None:
            raise ValueError("the dependencies form a cycle")
        level = F.broadcast(nodes.sparkSession.createDataFrame(list(found.items()), f"id {dict(ids.dtypes)['id']}, level int"))
    else:
        level = _levels_by_joins(core.select(F.col("source").alias("id")).union(core.select("target")).distinct(), core)
    for layer in reversed(layers):
        deeper = layer.join(level, layer.source == level.id, "left").groupBy("target").agg((F.max(F.coalesce("level", F.lit(0))) + 1).alias("level"))
        level = level.unionByName(deeper.withColumnRenamed("target", "id"))
    return ids.join(level, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def _levels_by_joins(ids: DataFrame, inner: DataFrame) -> DataFrame:
    level = materialize(ids.withColumn("level", F.lit(0)), "levels")
    for _ in range(level.count()):  # without a cycle, the longest chain has one level for each node
        deeper = level.join(inner, level.id == inner.source).groupBy(F.col("target").alias("id")).agg((F.max("level") + 1).alias("_deeper"))
        fresh = level.join(deeper, "id", "left").select(
            "id", F.greatest("level", F.coalesce("_deeper", F.lit(0))).alias("level"),
            (F.col("level") < F.coalesce("_deeper", F.lit(0))).alias("_moved"),
        )
        fresh = materialize(fresh, "levels")
        release(level)
        level = fresh
        if fresh.where("_moved").isEmpty():
            return fresh.drop("_moved")
        level = level.drop("_moved")
    raise ValueError("the dependencies form a cycle")
