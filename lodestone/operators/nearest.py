"""Nearest vectors of many queries: exact in blocks, and by a persisted inverted file of cells.

Exact: queries travel in blocks of bounded size, each task multiplies its rows with a block and keeps the best k per
query, and the tasks' bests are reduced once more: no pair of row and query becomes a row.

Cells: centroids are fitted on a bounded sample by spherical k-means; every row is written in the folder of its nearest
centroid.  A search reads the folders of the ``probes`` cells that are nearest to each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.checks import positive
from lodestone.storage import importable, remove

#: Bytes of queries that travel to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Rows that at most fit the cells.
SAMPLE = 20_000
ROUNDS = 12
#: Scores are rounded to so many decimals, so that equal vectors tie.
DECIMALS = 9


def _matrix(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as unit rows, and which rows are vectors of ``dim`` numbers; others are zero rows."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    dim = dim or int(sizes.max(initial=0))
    ok = (sizes == dim) & ~np.array(lists.is_null())
    out = np.zeros((len(sizes), dim))
    if ok.any() and dim:
        out[ok] = lists.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    out = np.nan_to_num(out)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0), ok


def _blocks(queries: DataFrame, query_id: str, vector: str, extra: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list | None]]:
    """(ids, unit vectors, extra) of the queries, in blocks of at most BLOCK_BYTES."""
    ids, rows, more, dim = [], [], [], None
    for r in queries.select(query_id, vector, *([extra] if extra else [])).where(F.col(vector).isNotNull()).toLocalIterator():
        dim = dim or len(r[1])
        ids.append(r[0]), rows.append(r[1]), more.append(r[2] if extra else None)
        if len(rows) * dim * 8 >= BLOCK_BYTES:
            yield np.array(ids), _matrix(pa.array(rows, pa.list_(pa.float64())), dim)[0], more
            ids, rows, more = [], [], []
    if rows:
        yield np.array(ids), _matrix(pa.array(rows, pa.list_(pa.float64())), dim)[0], more


def _best(rows: DataFrame, query_id: str, id_: str, top_k: int) -> DataFrame:
    """The best ``top_k`` per query of the tasks' bests, ties by id."""
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(id_))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(query_id, "rank", id_, "score")


class _Running:
    """The best ``top_k`` so far of each query of a block."""

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.best = top_k, [(np.zeros(0), np.zeros(0, object))] * queries

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, o = np.concatenate([self.best[i][0], np.round(scores, DECIMALS)]), np.concatenate([self.best[i][1], ids])
        at = _keep(s, o, self.top_k)
        self.best[i] = s[at], o[at]

    def batch(self, queries: np.ndarray, names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.best]
        ids, scores = (np.concatenate([b[k] for b in self.best]) if n else np.zeros(0) for k in (1, 0))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, n)), pa.array(ids.tolist(), id_type), pa.array(scores, pa.float64())], names=names)


def _keep(scores: np.ndarray, ids: np.ndarray, top_k: int) -> np.ndarray:
    """Positions of the best ``top_k`` of one query's scores, ties by id."""
    if len(scores) > top_k:
        least = np.partition(scores, len(scores) - top_k)[len(scores) - top_k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:top_k]


def topk_of_queries(rows: DataFrame, queries: DataFrame, id_: str, vector: str, top_k: int = 20, query_id: str = "query_id") -> DataFrame:
    """query_id, rank, id, score: the exact best rows by cosine for each query (query_id, vector), ties by id.

    A zero vector or one of another size scores 0; a null one is left out.
    """
    positive("top_k", top_k)
    importable(rows.sparkSession)
    kinds = dict(rows.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    schema = f"{query_id} {kinds[query_id]}, `{id_}` {kinds[id_]}, score double"
    found = None
    for ids, q, _ in _blocks(queries, query_id, vector):
        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            held, kind = _Running(len(ids), top_k), None
            for b in batches:
                x, _ = _matrix(b.column(1), q.shape[1])
                own, kind = np.array(b.column(0).to_pylist(), object), b.column(0).type
                for i, s in enumerate(q @ x.T):
                    held.add(i, s, own)
            if kind is not None:
                yield held.batch(ids, [query_id, id_, "score"], kind)

        part = rows.select(id_, vector).where(F.col(vector).isNotNull()).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    return _best(found, query_id, id_, top_k)


def fitted_cells(rows: DataFrame, vector: str, cells: int, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means on at most ``sample`` rows drawn by hash."""
    drawn = rows.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector, F.lit(seed))).limit(sample).toArrow()
    x, ok = _matrix(drawn.column(0).combine_chunks() if drawn.num_rows else pa.array([], pa.list_(pa.float64())))
    x = x[ok & (np.linalg.norm(x, axis=1) > 0)]
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[: min(cells, len(x))]]
    for _ in range(ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(length > 0, sums / np.where(length > 0, length, 1), centre)
    return centre


class CellIndex:
    """Vectors in the folders of their cells below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, id_: str, vector: str):
        self.spark, self.folder, self.id, self.vector = spark, folder.rstrip("/"), id_, vector
        self.centres = np.zeros((0, 0))

    def build(self, rows: DataFrame, cells: int = 64, sample: int = SAMPLE) -> CellIndex:
        """Fit cells and write every row that has a vector (all its columns)."""
        importable(self.spark)
        remove(self.spark, self.folder)
        self.centres = centres = fitted_cells(rows, self.vector, cells, sample)
        names, place = rows.columns, rows.columns.index(self.vector)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, _ = _matrix(b.column(place), centres.shape[1]) if len(centres) else (np.zeros((b.num_rows, 0)), None)
                cell = (x @ centres.T).argmax(axis=1) if len(centres) else np.zeros(b.num_rows, int)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int"
        celled = rows.where(F.col(self.vector).isNotNull()).mapInArrow(placed, schema)
        # ranges of (cell, id): a cell with a third of the rows spreads over several files
        celled.repartitionByRange("cell", self.id).write.partitionBy("cell").parquet(f"{self.folder}/rows")
        return self

    def probed(self, queries: DataFrame, query_id: str, probes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per block of queries: ids, vectors and the cells nearest to each."""
        return [(ids, q, np.argsort(-(q @ self.centres.T), axis=1, kind="stable")[:, :probes]) for ids, q, _ in _blocks(queries, query_id, self.vector)]

    def search(self, queries: DataFrame, top_k: int = 20, probes: int = 16, query_id: str = "query_id") -> DataFrame:
        """query_id, rank, id, score: the best rows of the cells nearest to each query; only those cells' folders are read."""
        positive("top_k", top_k)
        positive("probes", probes)
        table = self.spark.read.parquet(f"{self.folder}/rows")
        kinds = dict(table.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
        schema = f"{query_id} {kinds[query_id]}, `{self.id}` {kinds[self.id]}, score double"
        found = None
        for ids, q, cells in self.probed(queries, query_id, probes):
            asked = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}

            def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q, asked=asked) -> Iterator[pa.RecordBatch]:
                held, kind = _Running(len(ids), top_k), None
                for b in batches:
                    x, _ = _matrix(b.column(1), q.shape[1])
                    own, cell, kind = np.array(b.column(0).to_pylist(), object), b.column(2).to_numpy(), b.column(0).type
                    for c in np.unique(cell):
                        at = np.flatnonzero(cell == c)
                        for i in asked.get(int(c), ()):
                            held.add(i, x[at] @ q[i], own[at])
                if kind is not None:
                    yield held.batch(ids, [query_id, self_id, "score"], kind)

            self_id = self.id
            part = table.where(F.col("cell").isin(*asked)).select(self.id, self.vector, "cell").mapInArrow(run, schema)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], schema)
        return _best(found, query_id, self.id, top_k)


def recall(found: DataFrame, exact: DataFrame, query_id: str, id_: str) -> float:
    """The share of the exact results that were found."""
    hit = exact.join(found.select(query_id, id_), [query_id, id_], "left_semi").count()
    return hit / max(1, exact.count())
