"""Vector search, rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens, first_filled
from lodestone.functions.vectors import cosine_to
from lodestone.operators.checks import positive


def matching(rows: DataFrame, **filters) -> DataFrame:
    """Rows that equal every given filter value (None: no filter); pushed down to the scan."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]) if kv[1] is not None else df, filters.items(), rows)


def vector_topk(rows: DataFrame, query: list[float], id_: str, vector: str, top_k: int = 20, **filters) -> DataFrame:
    """The ``top_k`` rows by cosine similarity to the query, ties by id; filters come first.  No rows for top_k < 1."""
    found = matching(rows, **filters).withColumn("score", cosine_to(F.col(vector), query))
    return found.orderBy(F.desc("score"), F.asc(id_)).limit(max(top_k, 0))


def vector_search(
    code: DataFrame, docs: DataFrame, query: list[float] | tuple[list[float], list[float]], id_: str, vector: str, top_k: int = 20,
    search_code: bool = True, search_docs: bool = True, **filters,
) -> DataFrame:
    """The best of both collections, each cut to ``top_k`` before the merge; a conflicting content_type empties one."""
    positive("top_k", top_k)
    queries = query if isinstance(query, tuple) else (query, query)
    parts = []
    for rows, q, wanted, kind in ((code, queries[0], search_code, "code"), (docs, queries[1], search_docs, "doc")):
        typed = rows.withColumn("content_type", F.lit(kind))
        parts.append(vector_topk(typed, q, id_, vector, top_k if wanted else 0, **filters))
    return parts[0].unionByName(parts[1]).orderBy(F.desc("score"), F.asc(id_)).limit(top_k)


def normalized_results(rows: DataFrame) -> DataFrame:
    """Payload columns as search results: defaults and fallbacks for type, symbol, path and text."""
    known = set(rows.columns)
    col = lambda *names: [F.col(n) for n in names if n in known] or [F.lit(None).cast("string")]
    return rows.withColumns({
        "content_type": F.coalesce(first_filled(*col("content_type")), F.lit("code")),
        "symbol": first_filled(*col("symbol", "symbol_id")),
        "file_path": first_filled(*col("source_path", "file_path")),
        "chunk_text": F.coalesce(first_filled(*col("text", "chunk_text")), F.lit("")),
    })


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60, top_k: int = 20) -> DataFrame:
    """Fuse ranked lists (source, rank from 1, id, score, text): score = sum of 1 / (k + rank).

    Adds per-source scores and ranks as maps, the sources in order, and the first non-empty text in list order; an id
    twice in one list counts twice and keeps its later map entry.  Ties go to the id seen first, then to the id.
    """
    positive("k", k)
    positive("top_k", top_k)
    ordered = lists.withColumn("_at", F.struct("source_ord", "rank")) if "source_ord" in lists.columns else lists.withColumn("_at", F.struct("source", "rank"))
    entry = F.struct("source", "rank", "score", "_at")
    fused = ordered.groupBy("id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min_by("text", F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.col("_at"))).alias("text"),
        F.min("_at").alias("_first"),
        F.array_sort(F.collect_list(entry)).alias("_entries"),  # at most the lists' entries of one id
    )
    latest = F.filter("_entries", lambda e, i: ~F.exists(F.slice(F.col("_entries"), i + 2, F.size("_entries")), lambda later: later["source"] == e["source"]))
    picked = fused.withColumn("_e", latest)
    result = picked.select(
        "id", "score", F.coalesce("text", F.lit("")).alias("text"),
        F.map_from_arrays(F.transform("_e", lambda e: e["source"]), F.transform("_e", lambda e: e["score"])).alias("source_scores"),
        F.map_from_arrays(F.transform("_e", lambda e: e["source"]), F.transform("_e", lambda e: e["rank"])).alias("source_ranks"),
        F.array_distinct(F.transform(F.array_sort(F.transform("_entries", lambda e: F.struct(e["_at"].alias("at"), e["source"].alias("s")))), lambda e: e["s"])).alias("source_names"),
        "_first",
    )
    return result.orderBy(F.desc("score"), F.asc("_first"), F.asc("id")).limit(top_k).drop("_first")


def ranked(rows: DataFrame, source: str, id_: str, ord_: int = 0, text: str | None = None) -> DataFrame:
    """A scored result as one list of a fusion: rank 1 is the highest score, ties by id."""
    w = Window.orderBy(F.desc("score"), F.asc(id_))  # a top-k result
    value = F.col(text) if text else F.lit("")
    return rows.select(
        F.lit(source).alias("source"), F.lit(ord_).alias("source_ord"), F.row_number().over(w).alias("rank"), F.col(id_).cast("string").alias("id"),
        F.col("score").cast("double").alias("score"), value.alias("text"),
    )


def overlap_score(query: str, text: str = "text"):
    """The deterministic default scorer: shared distinct tokens over the query's distinct tokens."""
    q = F.array_distinct(code_tokens(F.lit(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, code_tokens(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(candidates: DataFrame, query: str, top_k: int = 20, scorer: Callable[[str, pd.Series], pd.Series] | None = None, id_: str = "id") -> DataFrame:
    """Candidates by a (query, text) score: keeps the former score as rrf_score, adds rerank_score.

    ``scorer`` scores Arrow batches of texts in Python; without one, token overlap is computed in the JVM.
    """
    positive("top_k", top_k)
    if scorer is None:
        score = overlap_score(query)
    else:
        def scores(texts: pd.Series) -> pd.Series:
            out = pd.Series(scorer(query, texts), dtype=float)
            if len(out) != len(texts):
                raise ValueError("the scorer returned a wrong number of scores")
            return out

        score = F.pandas_udf(scores, "double")("text")
    done = candidates.withColumnRenamed("score", "rrf_score").withColumn("rerank_score", score).withColumn("score", F.col("rerank_score"))
    return done.orderBy(F.desc("score"), F.asc(id_)).limit(top_k)


def concatenated(**lists: DataFrame) -> DataFrame:
    """Hybrid retrieval without fusion: the lists one after the other, with their source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(name)) for name, df in lists.items()))
