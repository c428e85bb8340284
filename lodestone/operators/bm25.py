"""BM25 ranking over a table of documents, and incremental maintenance of the indexed table.

For a table without an index, a search makes one pass over the texts: each document is reduced to its length and the
frequencies of the query's terms, a narrow table in the shared folder, from which statistics and scores come.  Tables that are
searched more than once have an index (``operators.index``), of which a search reads its terms' buckets only.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens, identifier_forms
from lodestone.operators.checks import positive
from lodestone.storage import materialize

K1, B = 1.5, 0.75
EXACT_BOOST = 5.0
EXACT_KINDS = ("function", "class", "method")


def query_terms(spark, query: str) -> Counter:
    """Tokens of a query with their multiplicity, by the same expression as documents."""
    rows = spark.createDataFrame([(query or "",)], "q string").select(code_tokens("q").alias("t")).first()
    return Counter(rows.t)


def profiled(docs: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """The documents with ``_length`` (tokens) and ``_tf`` (frequency of each term) instead of the text."""
    others = [c for c in docs.columns if c != text]
    tokens = docs.select(*others, code_tokens(text).alias("_tokens"))
    frequency = F.array(*(F.size("_tokens") - F.size(F.array_remove("_tokens", t)) for t in terms))
    return tokens.select(*others, F.size("_tokens").alias("_length"), frequency.alias("_tf"))


def statistics(profile: DataFrame, n_terms: int) -> DataFrame:
    """One row: documents, average length (1.0 if it were 0), document frequency of each term."""
    df = [F.count_if(F.col("_tf")[i] > 0) for i in range(n_terms)]
    return profile.agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_mean"), F.array(*df).alias("_df"),
    ).select("_n", F.coalesce(F.nullif("_mean", F.lit(0.0)), F.lit(1.0)).alias("_mean"), "_df")


def _score(repeats: list[int]) -> Column:
    total = F.lit(0.0)
    for i, q in enumerate(repeats):
        tf, df = F.col("_tf")[i].cast("double"), F.col("_df")[i].cast("double")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
        total = total + F.when(tf > 0, q * part).otherwise(0.0)
    return total


def scored(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Every document that holds a query term, with ``score`` (all columns but the text)."""
    terms = query_terms(docs.sparkSession, query)
    others = [c for c in docs.columns if c != text]
    if not terms:
        return docs.select(*others, F.lit(0.0).alias("score")).where(F.lit(False))
    profile = materialize(profiled(docs, text, list(terms)), "bm25-profile")
    hit = profile.where(F.exists("_tf", lambda x: x > 0))
    return hit.crossJoin(F.broadcast(statistics(profile, len(terms)))).select(*others, _score(list(terms.values())).alias("score"))  # one statistics row


def search(docs: DataFrame, query: str, id_: str, text: str = "text", top_k: int = 10) -> DataFrame:
    """The ``top_k`` best documents by BM25, ties by id; nothing for a query without tokens."""
    positive("top_k", top_k)
    return scored(docs, query, text).orderBy(F.desc("score"), F.asc(id_)).limit(top_k)


def is_exact(query: str, kind: Column | None, names: list[Column]) -> Column:
    """Whether a symbol document's name is the query: the normalised forms agree."""
    wanted = identifier_forms(F.lit(query))[0]
    same = F.lit(False)
    for name in names:
        same = same | F.coalesce(F.exists(identifier_forms(name), lambda x: x == wanted) & (name != ""), F.lit(False))
    return (wanted != "") & same & (kind.isin(*EXACT_KINDS) if kind is not None else F.lit(True))


def search_symbols(
    docs: DataFrame, query: str, id_: str, text: str = "text", top_k: int = 20, filters: dict | None = None, kind: str | None = None,
    names: tuple[str, ...] = (),
) -> DataFrame:
    """Filtered search with a boost of 5.0 for exact names; statistics stay those of the whole table."""
    return boosted(scored(docs, query, text), query, id_, top_k, filters, kind, names)


def boosted(hits: DataFrame, query: str, id_: str, top_k: int, filters: dict | None, kind: str | None, names: tuple[str, ...]) -> DataFrame:
    """The best of scored documents after filters and the boost for exact names."""
    positive("top_k", top_k)
    for c, v in (filters or {}).items():
        if v is not None:
            hits = hits.where(F.col(c) == v)
    exact = is_exact(query, F.col(kind) if kind else None, [F.col(c) for c in names])
    found = hits.withColumnRenamed("score", "bm25_score").withColumn("exact_name_match", exact)
    found = found.withColumn("score", F.col("bm25_score") + F.when(F.col("exact_name_match"), EXACT_BOOST).otherwise(0.0))
    return found.orderBy(F.desc("score"), F.asc(id_)).limit(top_k)


def postings(docs: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """The inverted table: id, term, tf."""
    return docs.select(id_, F.explode(code_tokens(text)).alias("term")).groupBy(id_, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """document_count and average_document_length; documents without tokens count."""
    return docs.select(F.size(code_tokens(text)).alias("n")).agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_document_length"))


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))
