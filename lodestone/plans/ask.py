"""One question from start to end: plan, retrieve, fuse, rerank, assemble, prompt, answer, and checked citations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import context, search
from lodestone.operators.index import InvertedIndex
from lodestone.plans import prompts, questions

#: What is said where no model is given.
NO_MODEL = "No language model is configured."


@dataclass(frozen=True)
class Reply:
    answer: str
    citations: DataFrame | None
    coverage: float
    query_type: str
    context_chunks: int
    used_model: bool
    error: str | None = None


def retrieved(
    spark: SparkSession, question: str, texts: DataFrame, index: InvertedIndex, vectors: DataFrame | None = None,
    embed: Callable[[str], list[float]] | None = None, top_k: int = 20,
) -> DataFrame:
    """The best chunks of a question: sparse and dense lists fused by rank and reranked by the words they share with it.

    :param texts: chunks: id (string), file_path, start_line, end_line, text.
    :param index: an index of the chunks by id.
    :param vectors: id and vector of the chunks; ``embed`` makes the question's.
    """
    lists = search.ranked(index.search(question, top_k), "bm25", index.id, 1)
    if vectors is not None and embed is not None:
        dense = search.vector_topk(vectors, embed(question), "id", "vector", top_k)
        lists = search.ranked(dense, "vector", "id", 0).unionByName(lists)
    fused = search.reciprocal_rank_fusion(lists, top_k=top_k).drop("text")
    return search.rerank(fused.join(texts, "id"), question, top_k)


def ask(spark: SparkSession, question: str, chunks: DataFrame, model: Callable[[str], str] | None = None, context_tokens: int = 4000, prompt_tokens: int = 8000) -> Reply:
    """The reply to a question over retrieved chunks; failures of the model are reported, not raised."""
    if not question.strip():
        raise ValueError("the question is empty")
    kind = questions.classify(spark, question)["category"]
    ordered = chunks.withColumn("ord", F.lit(0)) if "ord" not in chunks.columns else chunks
    used, summary = context.assembled(ordered, context_tokens)
    text, n = summary.first().text, used.count()
    if model is None:
        return Reply(NO_MODEL, None, 0.0, kind, n, False)
    said = prompts.answer(spark, question, used, text, model, kind, prompt_tokens)
    return Reply(said.answer, said.citations, said.coverage, kind, n, True, said.error)
