"""Facts of the retrieval operators on small inline tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries, storage
from lodestone.functions import text as T
from lodestone.functions.vectors import cosine, cosine_to, l2_normalized
from lodestone.operators import bm25, context, embed, nearest, search, service, store, traverse
from lodestone.plans import ask, models, prompts, questions
from lodestone.settings import Settings


def column(df, name):
    return [r[name] for r in df.collect()]


# -- text -----------------------------------------------------------------------------------------------------------


def reference_tokens(text):
    out = []
    for word in re.findall(r"[A-Za-z][A-Za-z0-9_]*|\d+", text):
        for part in word.split("_"):
            out += re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", part).lower().split()
    return out


def test_code_tokens(spark):
    texts = ["parseHTTPResponse(user_id) repoPath x2XML __init__ 42x A1B2", "", "für Éa ABCd_eF", None]
    got = column(spark.createDataFrame([(t,) for t in texts], "text string").select(T.code_tokens("text").alias("t")), "t")
    assert got == [reference_tokens(t or "") for t in texts]
    assert {"parse", "http", "response", "user", "id", "repo", "path"} <= set(got[0])


def test_token_counts_and_lines(spark):
    rows = [("a b\u00a0c, d.",), ("für é!",), ("x\n\ny\n",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string").select(T.word_estimate("text").alias("w"), T.chunk_token_count("text").alias("c"), T.lines_of("text").alias("l"))
    got = df.collect()
    for (text,), r in zip(rows, got):
        text = text or ""
        assert (r.w, r.c, r.l) == (len(text.split()), len(re.findall(r"\w+|[^\w\s]", text)), text.splitlines())


def test_names_and_keys(spark):
    df = spark.createDataFrame([("app/pkg/__init__.py",), ("app/x.y.py",), ("__init__.py",), ("a/.hidden",)], "p string")
    assert column(df.select(T.module_name("p").alias("m")), "m") == ["app.pkg", "app.x.y", "", "a..hidden"]
    key = column(spark.createDataFrame([("x",)], "c string").select(T.code_cache_key("m", F.col("c")).alias("k")), "k")[0]
    assert key == "m:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"


# -- BM25 -----------------------------------------------------------------------------------------------------------

DOCS = [("a", "load user profile", "function", "load_user", "py"), ("b", "user user store", "function", "store", "py"), ("c", "nothing here", "doc", "x", "md"), ("d", "", "class", "LoadUser", "py")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string, symbol_type string, symbol_name string, language string")


def brute_bm25(query, docs):
    import math

    toks = {i: reference_tokens(t) for i, t, *_ in docs}
    mean = sum(map(len, toks.values())) / len(toks) or 1.0
    out = {}
    for q in reference_tokens(query):
        df = sum(q in t for t in toks.values())
        for i, t in toks.items():
            if tf := t.count(q):
                out[i] = out.get(i, 0) + math.log(1 + (len(toks) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean))
    return out


def test_bm25_matches_brute_force(docs):
    got = {r.id: r.score for r in bm25.search(docs, "user load user", "id").collect()}
    want = brute_bm25("user load user", DOCS)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert bm25.search(docs, "...", "id").count() == 0
    with pytest.raises(ValueError):
        bm25.search(docs, "user", "id", top_k=0)


def test_exact_name_gets_five_more(docs):
    found = bm25.search_symbols(docs, "loadUser", "id", kind="symbol_type", names=("symbol_name",)).collect()
    assert found[0].id == "a" and found[0].exact_name_match and abs(found[0].score - found[0].bm25_score - 5) < 1e-9
    assert [r.id for r in bm25.search_symbols(docs, "user", "id", filters={"language": "md"}).collect()] == []


def test_statistics_count_empty_documents(docs):
    r = bm25.corpus_statistics(docs).first()
    assert (r.document_count, r.average_document_length) == (4, 2.0)


# -- vectors, fusion, rerank ----------------------------------------------------------------------------------------


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert column(df.select(cosine(F.col("a"), F.col("b")).alias("s")), "s") == [1.0, 0.0, 0.0, 0.0]
    assert column(df.select(cosine_to(F.col("a"), [1.0, 0.0]).alias("s")), "s") == [1.0, 0.0, 0.0, 0.0]
    assert column(spark.createDataFrame([([3.0, 4.0],), ([0.0],)], "v array<double>").select(l2_normalized(F.col("v")).alias("n")), "n") == [[0.6, 0.8], [0.0]]


def test_vector_search_merges_and_filters(spark):
    code = spark.createDataFrame([("code:auth", [1.0, 0.0, 0.0], "py"), ("code:db", [0.0, 1.0, 0.0], "py")], "id string, v array<double>, language string")
    text = spark.createDataFrame([("doc:auth", [0.9, 0.1, 0.0], "md")], "id string, v array<double>, language string")
    assert column(search.vector_search(code, text, [1.0, 0.0, 0.0], "id", "v", top_k=2), "id") == ["code:auth", "doc:auth"]
    assert column(search.vector_search(code, text, [1.0, 0.0, 0.0], "id", "v", search_code=False), "id") == ["doc:auth"]
    assert search.vector_search(code, text, [1.0], "id", "v", search_code=False, search_docs=False).count() == 0
    assert column(search.vector_search(code, text, [1.0, 0.0, 0.0], "id", "v", language="md"), "id") == ["doc:auth"]
    with pytest.raises(ValueError):
        search.vector_search(code, text, [1.0], "id", "v", top_k=0)


def test_rrf(spark):
    rows = [("vector", 0, 1, "a", 0.9, ""), ("vector", 0, 2, "b", 0.8, "text b"), ("bm25", 1, 1, "b", 3.0, "late"), ("bm25", 1, 2, "c", 2.0, ""), ("graph", 2, 1, "b", 1.0, ""), ("graph", 2, 2, "a", 0.5, "")]
    lists = spark.createDataFrame(rows, "source string, source_ord int, rank int, id string, score double, text string")
    got = search.reciprocal_rank_fusion(lists, k=10).collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].source_ranks == {"vector": 2, "bm25": 1, "graph": 1} and got[0].text == "text b"
    assert [round(r.score, 6) for r in got] == [0.265152, 0.174242, 0.083333]
    twice = spark.createDataFrame([("x", 0, 1, "a", 2.0, ""), ("x", 0, 3, "a", 1.0, "")], lists.schema)
    r = search.reciprocal_rank_fusion(twice, k=10).first()
    assert r.source_ranks == {"x": 3} and abs(r.score - 1 / 11 - 1 / 13) < 1e-12
    with pytest.raises(ValueError):
        search.reciprocal_rank_fusion(lists, k=0)


def test_rerank(spark):
    rows = spark.createDataFrame([("wrong", 0.9, "nothing"), ("right", 0.1, "parse user")], "id string, score double, text string")
    got = search.rerank(rows, "user parse").collect()
    assert got[0].id == "right" and got[0].rrf_score == 0.1 and got[0].rerank_score == 1.0
    scored = search.rerank(rows, "q", scorer=lambda q, texts: texts.str.len()).collect()
    assert [r.id for r in scored] == ["right", "wrong"]


# -- graph ----------------------------------------------------------------------------------------------------------


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(x, "Function", x) for x in ("run", "helper", "save", "other", "alone")], "id string, label string, name string")
    edges = spark.createDataFrame([("run", "helper", "CALLS"), ("helper", "save", "CALLS"), ("run", "helper", "IMPORTS"), ("other", "save", "CALLS")], "source_id string, target_id string, type string")
    return nodes, edges


def test_neighbors(graph):
    got = traverse.neighbors(*graph, "run", hops=2, direction="out").collect()
    assert [(r.id, r.distance, r.score) for r in got] == [("helper", 1, 1.0), ("save", 2, 0.5)]
    assert [r.id for r in traverse.neighbors(*graph, "save", hops=2).collect()] == ["helper", "other", "run"]
    assert traverse.neighbors(*graph, "missing").count() == 0
    assert column(traverse.neighbors(*graph, "run", direction="out", edge_types=["INHERITS"]), "id") == []
    with pytest.raises(ValueError):
        traverse.neighbors(*graph, "run", hops=0)
    with pytest.raises(ValueError):
        traverse.neighbors(*graph, "run", direction="up")


def test_shortest_path_and_subgraph(graph):
    r = traverse.shortest_path(*graph, "run", "save").first()
    assert (r.path, r.path_length, r.score) == (["run", "helper", "save"], 2, 0.5)
    assert traverse.shortest_path(*graph, "save", "run").count() == 0
    assert traverse.shortest_path(*graph, "run", "nowhere").count() == 0
    assert traverse.shortest_path(*graph, "run", "run").first().path_length == 0
    nodes, edges, summary = traverse.subgraph(*graph, ["run", "save"])
    assert nodes.count() == 4 and summary.first().text == "4 nodes, 4 edges"
    assert traverse.subgraph(*graph, ["run"], hops=0)[0].count() == 1


def test_cycles(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("d", "d"), ("a", "x")], "source_id string, target_id string")
    assert sorted(column(traverse.simple_cycles(edges), "chain")) == [["a", "b", "c", "a"], ["d", "d"]]


def test_long_cycles_and_chains(spark):
    names = [f"n{i:03d}" for i in range(102)]
    ring = spark.createDataFrame([(names[i], names[(i + 1) % 28]) for i in range(28)], "source_id string, target_id string")
    assert column(traverse.simple_cycles(ring), "chain") == [[*names[:28], names[0]]]
    nodes, chain = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(list(zip(names, names[1:])), "source string, target string")
    assert {r.id: r.level for r in questions.topological_levels(nodes, chain).collect()} == {n: i for i, n in enumerate(names)}
    with pytest.raises(ValueError):
        questions.topological_levels(nodes.limit(2), spark.createDataFrame([(names[0], names[1]), (names[1], names[0])], "source string, target string"))


def test_store(graph, spark):
    s = store.GraphStore(*graph)
    s.put_nodes(spark.createDataFrame([("run", "Class", None), ("new", "Module", "new")], "id string, label string, name string"))
    assert s.node("run").first().asDict() == {"id": "run", "label": "Class", "name": "run"}
    s.put_edges(spark.createDataFrame([("run", "new", "CONTAINS"), ("run", "nobody", "CONTAINS")], "source_id string, target_id string, type string"))
    assert column(s.outgoing("run", "CONTAINS"), "target_id") == ["new"]
    assert s.query("MATCH (a)-[r]->(b) RETURN a, r, b").count() == 5
    assert s.query("MATCH (n {id: $id}) RETURN n", id="new").count() == 1
    with pytest.raises(NotImplementedError):
        s.query("MATCH (n) DELETE n")
    with pytest.raises(Exception, match="unknown label"):
        s.put_nodes(spark.createDataFrame([("bad", "Thing", None)], "id string, label string, name string"))
    s.put_nodes(spark.createDataFrame([("two", "Class", "a"), ("two", "Function", None), ("run", None, "run2")], "id string, label string, name string").na.fill({"label": "Class"}))
    assert s.node("two").first().asDict() == {"id": "two", "label": "Function", "name": "a"}
    s.clear()
    assert s.nodes.count() == s.edges.count() == 0


def test_upsert_reduces_a_batch_to_one_row_per_key(spark):
    schema = "id string, a string, b string"
    old = spark.createDataFrame([("x", "1", "1"), ("y", "1", "1")], schema)
    new = spark.createDataFrame([("x", "2", None), ("x", None, "3"), ("z", "4", None), ("z", "5", None)], schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.upsert(old, new, ["id"], merge=True)) == [("x", "2", "3"), ("y", "1", "1"), ("z", "5", None)]
    assert [(i, a) for i, a, _ in rows(store.upsert(old, new, ["id"]))] == [("x", None), ("y", "1"), ("z", "5")]
    ordered = new.withColumn("at", F.when(F.col("a").isin("2", "4"), 9).otherwise(1))
    assert rows(store.upsert(old, ordered, ["id"], order=["at"])) == [("x", "2", None), ("y", "1", "1"), ("z", "4", None)]


def test_nearest_exact_and_by_cells(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0]), (5003, [float(v) for v in x[7]])], "id long, v array<double>").repartition(6)
    queries_ = rows.where("id % 100 = 0 and id < 5000").select(F.col("id").alias("query_id"), "v")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 3000, 100):
        s = {**{i: round(float(v), 9) for i, v in enumerate(unit @ unit[q])}, 5003: round(float(unit[7] @ unit[q]), 9)}
        want[q] = sorted(s, key=lambda i: (-s[i], i))[:5]
    exact = nearest.topk_of_queries(rows, queries_, "id", "v", 5)
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    monkeypatch.setattr(nearest, "BLOCK_BYTES", 600)
    assert sorted(map(tuple, nearest.topk_of_queries(rows, queries_, "id", "v", 5).collect())) == sorted(map(tuple, exact.collect()))
    index = nearest.CellIndex(spark, str(tmp_path / "cells"), "id", "v").build(rows, cells=24)
    assert spark.read.parquet(f"{index.folder}/rows").count() == 3003
    assert nearest.recall(index.search(queries_, 5, probes=6), exact, "query_id", "id") >= 0.9
    assert nearest.recall(index.search(queries_, 5, probes=24), exact, "query_id", "id") == 1.0
    assert nearest.topk_of_queries(rows.limit(0), queries_, "id", "v").count() == 0 and nearest.topk_of_queries(rows, queries_.limit(0), "id", "v").count() == 0


def test_recall_of_the_cell_index_on_the_driver_tables(spark):
    d = "/root/testdata/sf0.1"
    exact = queries.QUERIES["vector_topk_queries"](spark, d)
    assert nearest.recall(queries.QUERIES["vector_cell_index"](spark, d), exact, "query_id", "vec_id") >= 0.9


def test_models_over_http():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = {"choices": [{"message": {"content": "yes"}}]} if self.path == "/a" else {"content": [{"text": "one"}, {"other": 1}, {"text": "two"}]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert models.choices_model(f"{base}/a", "m", "k")("hello") == "yes"
    assert models.parts_model(f"{base}/b", "m", {"x-key": "k"})("hello") == "one\ntwo"
    server.shutdown()
    assert all(body["temperature"] == 0 and body["messages"][-1]["content"] == "hello" for _, body in asked)


def test_settings(monkeypatch):
    assert Settings().path_prefix == "/api/v1" and Settings(path_prefix="/").path_prefix == "/"
    for wrong in ({"environment": "x"}, {"log_level": "loud"}, {"rate_limit_per_minute": 0}, {"path_prefix": "v1"}, {"model_url": "ftp://x"}, {"environment": "production"}):
        with pytest.raises(ValueError):
            Settings(**wrong)
    monkeypatch.setenv("lodestone_rate_limit_per_minute", "5")
    assert Settings.from_environment().rate_limit_per_minute == 5
    assert Settings(environment="production", model_key="real").environment == "production"


def test_scratch_removes_what_was_made(spark):
    with storage.scratch(spark):
        path = storage.materialize(spark.range(3).toDF("a"), "made")._lodestone_path
        assert storage.exists(spark, path) and spark.read.parquet(path).count() == 3
    assert not storage.exists(spark, path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *_: None)
    context_ = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_root(SimpleNamespace(conf=conf, sparkContext=context_))


def test_health_and_errors():
    assert service.health("test", {"spark": True, "model": False})["status"] == "degraded"
    assert service.error_envelope("http_error", "no", "r1") == {"error": {"code": "http_error", "message": "no", "request_id": "r1"}}
    assert service.error_envelope("x", "y", details=[1])["error"]["details"] == [1]


def test_a_question_without_a_model(spark):
    chunks = spark.createDataFrame([("a", "a.py", 1, 2, "one\ntwo", 1.0)], "id string, file_path string, start_line int, end_line int, text string, score double")
    said = ask.ask(spark, "explain it", chunks)
    assert (said.answer, said.context_chunks, said.used_model, said.query_type) == (ask.NO_MODEL, 1, False, "exploratory")
    assert ask.ask(spark, "explain it", chunks, lambda p: 1 / 0).error.startswith("ZeroDivisionError")
    with pytest.raises(ValueError):
        ask.ask(spark, " ", chunks)


# -- context and citations ------------------------------------------------------------------------------------------


def results(spark, rows):
    return spark.createDataFrame(rows, "id string, file_path string, start_line int, end_line int, text string, score double, ord int")


def test_merge_and_budget(spark):
    rows = results(spark, [("x", "auth.py", 1, 3, "def login():\n    user = get()\n    return user", 0.5, 0), ("y", "auth.py", 3, 5, "    return user\n\ndef out():", 0.9, 1), ("z", "b.py", 1, 1, " ", 0.1, 2)])
    merged = context.merged(context.normalized(rows)).collect()
    assert len(merged) == 1 and (merged[0].start_line, merged[0].end_line, merged[0].score, merged[0].id) == (1, 5, 0.9, "y")
    assert merged[0].text.count("return user") == 1
    rows = results(spark, [("lo", "a.py", 1, 1, "one two three", 0.1, 0), ("hi", "b.py", 1, 1, "four five six", 0.9, 1)])
    chunks, summary = context.assembled(rows, 8)
    assert column(chunks, "id") == ["hi"] and summary.first().truncated
    assert summary.first().text == "### b.py:1-1\n1: four five six" and summary.first().token_count == 6
    big = results(spark, [("big", "a.py", 5, 7, "one two\nthree four\nfive six", 0.9, 0), ("small", "b.py", 1, 1, "x", 0.1, 1)])
    cut = context.assembled(big, 8)[0].collect()
    assert [(c.id, c.start_line, c.end_line, c.text) for c in cut] == [("big", 5, 6, "one two\nthree four")]
    with pytest.raises(ValueError):
        context.budgeted(rows, 0)


def test_a_skipped_chunk_uses_no_budget(spark):
    rows = results(spark, [("a", "a.py", 1, 1, "one two", 0.9, 0), ("b", "b.py", 1, 1, "w " * 50, 0.8, 1), ("c", "c.py", 1, 1, "three", 0.7, 2)])
    assert sorted(column(context.assembled(rows, 12)[0], "id")) == ["a", "c"]


def greedy(chunks, budget):
    """The reference assembler's rule: ids kept of (sort, ord, id, tokens), and whether any chunk was left out."""
    kept, used = [], 0
    for _, _, id_, tokens in sorted(chunks):
        if kept and used + tokens > budget:
            continue
        kept.append(id_)
        if tokens > budget:
            return kept, True
        used += tokens
    return kept, len(kept) < len(chunks)


def test_budget_tries_every_chunk(spark):
    rng = random.Random(1)
    rows = [(k, f"{k}{i}", "f", 1, 1, "w " * rng.choice([rng.randint(1, 30), rng.randint(30, 200)]), rng.randint(0, 40) / 40, i) for k, n in (("a", 700), ("b", 120), ("c", 3), (None, 90)) for i in range(n)]
    rows += [("d", f"d{i}", "f", 1, 1, "w " * (400 if i == 0 else 2), 1 - i / 100, i) for i in range(80)]  # the first is too large
    rows += [("e", f"e{i}", "f", 1, 1, "w " * (300 if 0 < i < 70 else 5), 1 - i / 100, i) for i in range(100)]  # what fits comes late
    table = spark.createDataFrame(rows, "k string, id string, file_path string, start_line int, end_line int, text string, score double, ord int")
    got = context.budgeted(table, 300, ["k"]).collect()
    for key in ("a", "b", "c", "d", "e", None):
        kept, truncated = greedy([(-r[6], r[7], r[1], len(r[5].split()) + 3) for r in rows if r[0] == key], 300)
        mine = [r for r in got if r.k == key]
        assert sorted(r.id for r in mine) == sorted(kept) and {r.truncated for r in mine} == {truncated}


def test_context_budget_reaches_documents_of_low_rank(spark, tmp_path):
    rows = [(i, "w " * (3000 if i < 60 else 3), "src", 999 - i) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["context_budget"](spark, str(tmp_path)).collect()
    kept, truncated = greedy([(-(r[3] % 1000), r[0], str(r[0]), len(r[1].split()) + 3) for r in rows], 4000)
    assert sorted(r.id for r in got) == sorted(kept) and len(kept) == 41 and all(r.truncated == truncated for r in got)


def test_citations(spark):
    answers = spark.createDataFrame([(1, "ok [app/a.py:2-3], gone [x.py:1-1], far [app/a.py:3-9], odd [C:/b.py:9-2], not [one]")], "id int, answer string")
    chunks = results(spark, [("c", "app/a.py", 1, 4, "x", 1.0, 0)])
    ranges = context.available_ranges(chunks, spark.createDataFrame([("### t.py:1-2\n7: seven\nplain",)], "text string"))
    got = context.validated(context.citations(answers, "id"), ranges, "id").orderBy("ord").collect()
    assert [(r.file_path, r.reason) for r in got] == [("app/a.py", "valid"), ("x.py", "file not found in retrieved context"), ("app/a.py", "lines not found in retrieved context: 5"), ("C:/b.py", "start_line exceeds end_line")]
    assert context.coverage(context.validated(context.citations(answers, "id"), ranges, "id")).first().coverage == 0.25
    assert sorted((r.file_path, r.lo, r.hi) for r in ranges.collect()) == [("app/a.py", 1, 4), ("t.py", 1, 2), ("t.py", 7, 7)]
    assert context.coverage(context.citations(answers.where("id = 0"), "id")).first().coverage == 0.0


# -- planning -------------------------------------------------------------------------------------------------------

LABELLED = [
    ("Where is UserService defined?", "simple-lookup"), ("find function parse_config", "simple-lookup"), ("what calls save_user", "simple-lookup"), ("app.service.load", "simple-lookup"),
    ("How does a request flow through the API?", "multi-hop"), ("Show the path between api and db", "multi-hop"), ("trace the login", "multi-hop"), ("impact of changing the schema", "multi-hop"),
    ("Give an overview", "exploratory"), ("explain the architecture", "exploratory"), ("what should I read first", "exploratory"), ("compare both modules", "exploratory"),
]


def test_classification(spark):
    df = spark.createDataFrame([(q, c) for q, c in LABELLED], "query string, want string")
    assert questions.classified(df).where("category <> want").count() == 0
    blank = questions.classify(spark, "  ")
    assert (blank["category"], blank["confidence"]) == ("multi-hop", 0.0)
    assert questions.classify(spark, "hello there friend")["used_fallback"]
    assert questions.classify(spark, "q", model=lambda q: 'x {"category": "exploratory", "confidence": 7} y')["category"] == "exploratory"
    with pytest.raises(ValueError):
        questions.classified(df, threshold=2)


def test_decompose_route_execute(spark):
    plan = questions.decompose(spark, "impact of the schema")
    assert [s.id for s in plan.sub_queries] == ["q1", "q2", "q3"] and plan.edges == (("q1", "q2"), ("q2", "q3"))
    assert len(questions.decompose(spark, "overview of it").sub_queries) == 1
    mine = '{"sub_queries": [{"text": "a"}, {"text": "b", "expected_answer_type": "path"}], "dependency_edges": [{"source": "q1", "target": "q2"}, {"source": "q9", "target": "q2"}]}'
    own = questions.decompose(spark, "trace the login", model=lambda q: mine)
    assert [s.expected_answer_type for s in own.sub_queries] == ["evidence", "path"] and own.edges == (("q1", "q2"),)
    seen = {}

    def run(name):
        def executor(sub, needed, before):
            seen[sub.id] = (name, sorted(needed))
            return spark.createDataFrame([(name,)], "id string")

        return executor

    questions.execute(spark, plan, {k: run(k) for k in ("bm25", "graph", "vector")})
    assert seen["q1"][0] == "bm25" and seen["q2"] == ("graph", ["q1"])
    both = questions.Plan("q", "multi-hop", 1.0, (questions.SubQuery("h", "combine what is known"), questions.SubQuery("v", "what is it like", "explanation")))
    out = questions.execute(spark, both, {k: run(k) for k in ("bm25", "graph", "vector")})
    assert column(out["h"], "source") == ["bm25", "vector", "graph"] and column(out["v"], "id") == ["vector"]
    assert questions.execute(spark, both, {}) == {}
    with pytest.raises(ValueError, match="cycle"):
        questions.execution_order(questions.Plan("q", "multi-hop", 1.0, (questions.SubQuery("a", "x", context_from=("b",)), questions.SubQuery("b", "y", context_from=("a",)))))


def test_prompts_and_answers(spark):
    p = prompts.build_prompt("What?", "\n".join(f"{i}: word word" for i in range(100)), "exploratory", 80)
    assert p.truncated and p.token_count <= 80 and "99:" not in p.text
    chunks = results(spark, [("c", "a.py", 1, 4, "x", 1.0, 0)])
    a = prompts.answer(spark, "What?", chunks, "### a.py:1-4\n1: x", lambda t: "It is [a.py:1-2] and [b.py:1-2].")
    assert a.coverage == 0.5 and a.error is None

    def broken(_):
        raise RuntimeError("no model")

    assert prompts.answer(spark, "What?", chunks, "", broken).error == "RuntimeError: no model"


# -- embedding, service ---------------------------------------------------------------------------------------------


def test_embedding_cache(spark):
    rows = spark.createDataFrame([("x = 1",), ("x = 1",), ("y",), (" ",)], "text string")
    out, cache = embed.embed_code(rows, dim=8)
    assert cache.count() == 2
    norms = [round(sum(x * x for x in v), 6) for v in column(out.orderBy("text"), "vector")]
    assert norms == [0.0, 1.0, 1.0, 1.0]
    calls = spark.createDataFrame([("x = 1",), ("z",)], "text string")
    assert embed.embed_code(calls, cache=cache, dim=8)[1].count() == 3
    with pytest.raises(ValueError):
        embed.embed_code(rows, dim=0)
    with pytest.raises(Exception, match="dimensions"):
        embed.embed_code(rows, embed=lambda t: [[1.0]] * len(t), dim=8)[0].collect()
    with pytest.raises(ValueError):
        embed.single_dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>"))


def test_rate_limit_ignores_denied(spark):
    times = [("u", float(t), i) for i, t in enumerate([0, 10, 20, 59, 60, 61, 70])] + [("v", 0.0, 99)]
    got = service.rate_limited(spark.createDataFrame(times, "k string, t double, i int"), "k", "t", "i", limit=2, window=60.0)
    assert [r.allowed for r in got.where("k = 'u'").orderBy("i").collect()] == [True, True, False, False, True, False, True]
    assert service.rate_limited(spark.createDataFrame([("u", 0.0, 0), ("u", 1.0, 1)], "k string, t double, i int"), "k", "t", "i", limit=1).orderBy("i").collect()[1].allowed is False


def test_file_tree_and_users(spark):
    tree = service.file_tree(spark.createDataFrame([("a/b.py",), ("a/c/d.py",)], "file_path string"))
    assert {(r.path, r.parent, r.is_dir) for r in tree.collect()} == {("a", "", True), ("a/b.py", "a", False), ("a/c", "a", True), ("a/c/d.py", "a/c", False)}
    users = spark.createDataFrame([("1", "a@x", "g", "p1", "A"), ("2", "b@x", "g", "p2", "B")], "id string, email string, provider string, provider_user_id string, name string")
    logins = spark.createDataFrame([("new@x", "g", "p1", "A2"), ("b@x", "g", "p9", "B2"), ("c@x", "g", "p3", "C")], "email string, provider string, provider_user_id string, name string")
    got = {r.id: (r.email, r.name) for r in service.merged_users(users, logins).collect()}
    assert got == {"1": ("new@x", "A2"), "2": ("b@x", "B2"), "c@x": ("c@x", "C")}


def test_service_tables(spark):
    from lodestone import schemas

    users = spark.createDataFrame([("1", "a@x"), ("2", "a@x")], "id string, email string")
    assert [(r.rule, r.key, r.n) for r in schemas.violations("users", users).collect()] == [("unique", "a@x", 2)]
    jobs = spark.createDataFrame([("j", "r1"), ("k", "r2")], "id string, repository_id string")
    assert [r.key for r in schemas.violations("ingestion_jobs", jobs, {"repositories": spark.createDataFrame([("r1",)], "id string")}).collect()] == ["r2"]
    with pytest.raises(ValueError):
        schemas.validated_request("u", "p")


def test_links_and_layout(spark):
    rows = spark.createDataFrame([("a.py:9-3",), ("C:/b.py:4",), ("plain",)], "link string")
    assert [(r.file_path, r.first_line, r.last_line) for r in context.linked_ranges(rows, "link").collect()] == [("a.py", 3, 9), ("C:/b.py", 4, 4), (None, None, None)]
    nodes = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "id string, module string")
    got = {r.id: (round(r.x, 6), round(r.y, 6)) for r in traverse.module_layout(nodes).collect()}
    assert got == {"a": (380.0, 0.0), "b": (220.0, 0.0), "c": (-220.0, 0.0)}


def test_levels_of_large_graphs_set_layers_aside(spark, monkeypatch):
    """Many nodes on a long chain: tables are written for the layers, not for each level; other graphs as on the driver; cycles."""
    written = []
    monkeypatch.setattr(questions, "SMALL", 40)
    monkeypatch.setattr(questions, "materialize", lambda df, name, f=questions.materialize: written.append(name) or f(df, name))

    def levels(n, links):
        nodes = spark.createDataFrame([(str(i),) for i in range(n)], "id string")
        edges = spark.createDataFrame([(str(a), str(b)) for a, b in links], "source string, target string")
        return {int(r.id): r.level for r in questions.topological_levels(nodes, edges).collect()}

    star = [(i, i + 1) for i in range(30)] + [(i % 31, i) for i in range(31, 400)] + [(7, 7000)]
    assert levels(400, star) == {i: i if i < 31 else i % 31 + 1 for i in range(400)} and len(written) <= 3
    dense = [(a, b) for b in range(60) for a in range(max(0, b - 2), b)] + [(b, 60 + b) for b in range(60)] + [(3, 150)]
    assert levels(160, dense) == {i: i if i < 60 else i - 59 if i < 120 else 4 if i == 150 else 0 for i in range(160)}
    with pytest.raises(ValueError):
        levels(400, [*star, (30, 0)])
