"""Helpers shared by the corpus operators: Arrow text buffers, vectorised word hashes, global offsets, shared files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.storage import importable, located, shared_folder

#: Rows of an Arrow batch; texts of up to a few hundred kB then keep a batch within tens of MB.
BATCH_ROWS = 512
#: Keys with more than one in HOT of all rows, and more than LEAST_HOT, are dealt over several tasks.
HOT, LEAST_HOT = 2000, 1024
#: Text bytes handled in one vectorised step (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_seeded = np.random.default_rng(0x10DE)
_BYTES = _seeded.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BYTES[:, 65:91] = _BYTES[:, 97:123]  # A-Z count as a-z
_BYTES = np.concatenate([_BYTES, _seeded.integers(0, 1 << 64, (2, 256), dtype=np.uint64)])  # and two functions that tell case apart
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _seeded.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, Arrow batches are bounded by rows, so that a worker's memory does not follow the text length; the
    session's own setting comes back afterwards.  Workers find this package where the driver found it."""
    importable(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of BATCH_ROWS, for plans that run after ``small_batches`` is over; what the task's arrays held
    goes back at the end."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), BATCH_ROWS):
            yield b.slice(i, BATCH_ROWS)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers serve one task after another, and neither the C library nor Arrow would
    give back by itself what one task's arrays left."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets into them (null counts as empty); no copy where Arrow allows."""
    texts = texts.fill_null("") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold at most ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _grown(table: np.ndarray, base: int, n: int) -> np.ndarray:
    if len(table) >= n:
        return table
    table = np.full(1 << max(n - 1, 1).bit_length(), np.uint64(base & (1 << 64) - 1), np.uint64)
    table[0] = 1
    return np.cumprod(table, dtype=np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs of bytes outside ``gaps``; by default ``[^\\x20\\x09-\\x0D]+``), and per
    text the offset of its first word (n + 1)."""
    inside = ~gaps[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes by one of four independent functions: ``which`` 0 and 1 take A-Z as a-z, 2 and
    3 tell them apart.

    A polynomial in the bytes' random images, read off one running sum, so that no Python runs per span.
    """
    global _powers, _inverses
    n = len(data) + 1
    _powers, _inverses = _grown(_powers, _BASE, n), _grown(_inverses, _BASE_INVERSE, n)
    total = np.zeros(n, np.uint64)
    np.cumsum(_BYTES[which][data] * _powers[: n - 1], out=total[1:])
    return mix((total[ends] - total[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z), and per text the offset of its first word (n + 1)."""
    starts, ends, at = word_spans(data, offsets)
    return span_hashes(data, starts, ends), at


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text's word hashes, repeats included; fewer words make one shingle."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    h = np.full(n - width + 1, np.uint64(width))
    for t in range(width):
        h += words[t : n - width + 1 + t] * _STEPS[t % 64] + np.uint64(t // 64)
    return mix(h)


def global_offsets(df: DataFrame, order: list[str], value: str, out: str, name: str, row_id: str = "row_id") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before a row in the total order of ``order``, and ``row_id``,
    a number that follows the same order and is a row's own.

    A range partitioning on all order columns (a hot prefix spreads over partitions) with running sums inside
    each; only one total per partition reaches the driver.
    """
    names = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, rows = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            v = column(b, value).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v) + before
            ids = (np.int64(part) << np.int64(40)) + rows + np.arange(len(v), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(total - v), pa.array(ids)], names=[*names, "_before", row_id])
            before, rows = int(total[-1]) if len(total) else before, rows + len(v)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", _before long, {row_id} long"
    rows = arrow_table(ranged, run, schema, name).withColumn("_part", F.shiftright(row_id, 40).cast("int"))
    totals = sorted(rows.groupBy("_part").agg(F.max(F.col("_before") + F.col(value))).collect())  # one row per partition
    bases, base = [], 0
    for p, n in totals:
        bases.append((p, base))
        base += n
    begun = F.broadcast(df.sparkSession.createDataFrame(bases, "_part int, _base long"))
    return rows.join(begun, "_part").withColumn(out, F.col("_before") + F.col("_base")).drop("_before", "_base", "_part")


def joined_evenly(big: DataFrame, small: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """``big.join(small, keys)`` for unique keys in ``small``, however many rows of ``big`` share one.

    :param rows: column of ``small``: how many rows of ``big`` have the key (it is dropped).

    A key with more than one in HOT of all rows (and more than LEAST_HOT) is dealt over as many tasks as it holds such
    parts, and its row of ``small`` is copied to each: fewer than HOT keys and 2 * HOT copies, which are broadcast.
    """
    total = small.agg(F.sum(rows)).first()[0] or 0
    part = max(LEAST_HOT, -(-total // HOT))
    salts = F.ceil(F.col(rows) / part).cast("int")
    hot = small.where(F.col(rows) > part).select(*keys, salts.alias("_salts"))
    if hot.isEmpty():
        return big.join(small.drop(rows), keys)
    marked = big.join(F.broadcast(hot), keys, "left")
    dealt = marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copies = small.select("*", F.explode(F.when(F.col(rows) > part, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))).alias("_salt"))
    return dealt.join(copies.drop(rows), [*keys, "_salt"]).drop("_salt")


def sealed(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """The documents with all columns but the used ones under names that clash with nothing, and the columns that give
    the original names and order back."""
    names = {c: c if c in used else f"_sealed{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def arrow_table(df: DataFrame, rows_of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """``df.mapInArrow(rows_of, schema)`` written by the Python workers as Parquet in the shared folder, and reread.

    One file per partition, published whole, so retried tasks do no harm; the driver gets one row per file.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        rows = [0]

        def write(stream) -> None:
            with pq.ParquetWriter(stream, arrow, compression="zstd", use_dictionary=False) as out:
                for b in rows_of(batches):
                    rows[0] += b.num_rows
                    if b.num_rows:
                        out.write_table(pa.Table.from_batches([b]).cast(arrow))

        publish(f"{folder}/part-{TaskContext.get().partitionId():06d}.parquet", write)
        give_back()
        yield pa.RecordBatch.from_pydict({"rows": pa.array(rows, pa.int64())})

    with small_batches(spark):
        files = df.mapInArrow(run, "rows long").count()
    return located(spark.read.schema(struct).parquet(folder), folder) if files else spark.createDataFrame([], struct)


def open_shared(uri: str):
    """The file system and path of a URI in the shared storage (local mounts, HDFS, S3, ...)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Write a file under an attempt's own name, then move it to ``uri``: retried tasks leave one whole file."""
    import uuid

    from pyarrow.fs import FileType

    store, path = open_shared(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    folder, _, name = path.rpartition("/")
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"  # readers skip names that start with a dot
    with store.open_output_stream(own) as f:
        write(f)
    try:
        store.move(own, path)
    except OSError:  # stores that do not replace: an earlier attempt's file is as good, but ours is whole for sure
        if store.get_file_info(path).type == FileType.NotFound:
            raise
        store.delete_file(path)
        store.move(own, path)
