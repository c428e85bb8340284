"""Embeddings with a cache table: distinct texts are embedded once, cached ones not at all.

Models are pluggable: any callable from a list of texts to vectors.  The default needs no weights: hashed code tokens,
signed and summed, which is deterministic.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import code_cache_key, doc_cache_key
from lodestone.functions.vectors import l2_normalized
from lodestone.operators.checks import positive

Embed = Callable[[list[str]], list[list[float]]]
CODE_DIM, CODE_BATCH = 768, 16
DOC_DIM, DOC_BATCH = 384, 32


def hashing_embedder(dim: int) -> Embed:
    """Signed hashed token counts; counts without signs where these cancel out, so that every text with a token has a direction."""
    import re

    word = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9_\t\n\f\r ]")

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            hashes = [zlib.crc32(token.lower().encode()) for token in word.findall(text)]
            for h in hashes:
                row[h % dim] += 1.0 if h & 0x80000000 else -1.0
            if hashes and not row.any():
                for h in hashes:
                    row[h % dim] += 1.0
        return out.tolist()

    return embed


def _vectors(keyed: DataFrame, embed: Embed, dim: int, batch: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, found = f["text"].tolist(), []
            for i in range(0, len(texts), batch):
                part = embed(texts[i : i + batch])
                if len(part) != len(texts[i : i + batch]):
                    raise ValueError("the model returned a wrong number of vectors")
                if any(len(v) != dim for v in part):
                    raise ValueError(f"the model returned a vector that has not {dim} dimensions")
                found += [[float(x) for x in v] for v in part]
            yield pd.DataFrame({"cache_key": f["cache_key"], "vector": found})

    return keyed.mapInPandas(run, "cache_key string, vector array<double>")


def embedded(rows: DataFrame, cache: DataFrame | None, embed: Embed, dim: int, batch: int) -> tuple[DataFrame, DataFrame]:
    """Rows (text, cache_key, ...) with unit ``vector``, and the cache with what was added (cache_key, vector).

    Blank and null texts get a zero vector.
    """
    positive("dim", dim)
    positive("batch_size", batch)
    blank = F.coalesce(F.regexp_replace("text", r"(?U)\s", "") == "", F.lit(True))
    wanted = rows.where(~blank).select("cache_key", "text").dropDuplicates(["cache_key"])
    if cache is not None:
        wanted = wanted.join(cache.select("cache_key"), "cache_key", "left_anti")
    fresh = _vectors(wanted, embed, dim, batch).select("cache_key", l2_normalized(F.col("vector")).alias("vector"))
    known = fresh if cache is None else cache.unionByName(fresh)
    vector = F.when(blank, F.array_repeat(F.lit(0.0), dim)).otherwise(F.col("vector"))
    return rows.join(known, "cache_key", "left").withColumn("vector", vector), known


def embed_code(
    rows: DataFrame, model: str = "hashing-code", cache: DataFrame | None = None, embed: Embed | None = None, dim: int = CODE_DIM,
    batch: int = CODE_BATCH,
) -> tuple[DataFrame, DataFrame]:
    keyed = rows.withColumn("cache_key", code_cache_key(model, F.col("text"))).withColumn("model_name", F.lit(model))
    return embedded(keyed, cache, embed or hashing_embedder(dim), dim, batch)


def embed_docs(
    rows: DataFrame, model: str = "hashing-doc", cache: DataFrame | None = None, embed: Embed | None = None, dim: int = DOC_DIM,
    batch: int = DOC_BATCH,
) -> tuple[DataFrame, DataFrame]:
    """Rows with text, parent_symbol_id, source_type and source_path; blank texts get a zero vector without the model."""
    key = doc_cache_key(model, F.coalesce("parent_symbol_id", F.lit("")), F.col("source_type"), F.col("source_path"), F.col("text"))
    return embedded(rows.withColumn("cache_key", key).withColumn("model_name", F.lit(model)), cache, embed or hashing_embedder(dim), dim, batch)


def index_documents(embeddings: DataFrame, content_type: str, metadata: DataFrame | None = None) -> DataFrame:
    """Index rows of embedded texts: id is the cache key; metadata joins by cache_key, the embedding's columns win."""
    rows = embeddings.withColumn("id", F.col("cache_key")).withColumn("content_type", F.lit(content_type))
    if metadata is not None:
        extra = metadata.select("cache_key", *(c for c in metadata.columns if c not in rows.columns))
        rows = rows.join(extra, "cache_key", "left")
    return rows


def checked_dimension(rows: DataFrame, vector: str = "vector", dim: int | None = None) -> DataFrame:
    """The rows; running the plan fails for an empty vector or one of another dimension than ``dim``."""
    ok = (F.size(vector) > 0) & (F.size(vector) == dim if dim else F.lit(True))
    return rows.withColumn(vector, F.when(ok, F.col(vector)).otherwise(F.raise_error(F.lit("vector of a wrong dimension"))))


def single_dimension(rows: DataFrame, vector: str = "vector") -> int:
    """The one dimension of a table's vectors; a ValueError if there are several."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high or not low:
        raise ValueError("vectors must share one dimension above 0")
    return low
