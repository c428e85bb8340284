"""Line dedup: repeated lines stay only in the smallest document that holds them.

1. A narrow pass splits each whole text at \\n and emits one row per line whose key (stripped, A-Z lower-cased) is
   long enough: a 128-bit key hash, the document and the line's position.
2. The rows are range-partitioned and sorted by (hash, doc_id, position).  A key that a third of the documents hold
   spreads over several partitions, because doc_id is in the range key.
3. Each partition is streamed once: the first row of a hash is its first occurrence, and rows of other documents are
   dropped.  Only a partition's first hash may have begun earlier: its rows stay open until the driver, from the two
   ends of each partition, knows the document that holds it.
4. Dropped positions come back as zlib-compressed keep bitmaps, one per document that loses a line.
5. Texts are joined with their bitmaps only to apply them.

Nulls and ties: a null or empty text is one empty line, which is kept.  Rows without doc_id are one document behind
all others; the greatest 64-bit doc_id stands for them and is an error where it is given.  Rows that share a doc_id are one document when holders are counted; each keeps its own lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SEPARATOR, arrow_table, column, mix, pieces, span_hashes, steps, text_bytes

#: Keys with fewer code points than this are never dropped.
LEAST_CHARS = 10
#: The document order puts rows without doc_id last.
_LAST = (1 << 63) - 1
#: Kinds of rows that a partition's stream emits.
GONE, OPEN, FIRST, LAST = range(4)


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per line of the texts: text, position, two 64-bit hashes of its key, code points of its key."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    text = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, text))
    starts, text = starts[order], text[order]
    ends = ends[np.lexsort((ends, np.concatenate([owner, np.arange(n)])))]
    position = np.arange(len(text)) - np.searchsorted(text, text)
    solid = np.flatnonzero(~SEPARATOR[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    first, last = starts.copy(), starts.copy()
    first[some], last[some] = solid[a[some]], solid[b[some] - 1] + 1
    hashes = [span_hashes(data, first, last, which) for which in (0, 1)]
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return text, position, hashes[0], hashes[1], points[last] - points[first]


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text) -> doc_id, text_hash, bitmap: the compressed keep bitmap (bit 0 of byte 0 is line 0) of every
    document that loses a line."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(column(b, "text"))
            ids = pc.fill_null(column(b, "doc_id"), _LAST).to_numpy()
            if (pc.sum(pc.equal(column(b, "doc_id"), _LAST)).as_py() or 0) > 0:
                raise ValueError(f"doc_id {_LAST} stands for rows without doc_id")
            hashes = column(b, "text_hash").to_numpy()
            for i, j in steps(offsets):
                text, position, h, g, points = line_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lines = np.bincount(text, minlength=j - i)
                use = points >= least_chars
                t = text[use]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[use].view(np.int64)), pa.array(g[use].view(np.int64)), pa.array(ids[i:j][t]), pa.array(position[use].astype(np.int32)), pa.array(hashes[i:j][t]), pa.array(lines[t].astype(np.int32))],
                    names=["h", "g", "doc", "pos", "text_hash", "n"],
                )

    keys = docs.mapInArrow(split, "h long, g long, doc long, pos int, text_hash long, n int")
    order = ["h", "g", "doc", "pos", "text_hash"]
    names = ["kind", "part", "h", "g", "doc", "text_hash", "n", "pos"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, lead, last = TaskContext.get().partitionId(), None, None

        def rows(kind: int, *columns) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())))],
                names=names,
            )

        for b in batches:
            if not b.num_rows:
                continue
            h, g, doc, text, n, pos = (column(b, c).to_numpy() for c in ("h", "g", "doc", "text_hash", "n", "pos"))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            holder = doc[first]
            if last is not None and last[:2] == (h[0], g[0]):
                holder[first == 0] = last[2]
            if lead is None:
                lead = (int(h[0]), int(g[0]), int(doc[0]))
                yield rows(FIRST, [lead[0]], [lead[1]], [lead[2]], [0], [0], [0])
            last = (int(h[-1]), int(g[-1]), int(holder[-1]))
            for kind, at in ((GONE, doc != holder), (OPEN, (h == lead[0]) & (g == lead[1]) & (doc == lead[2]))):
                if at.any():
                    yield rows(kind, h[at], g[at], doc[at], text[at], n[at], pos[at])
        if last is not None:
            yield rows(LAST, [last[0]], [last[1]], [last[2]], [0], [0], [0])

    streamed = arrow_table(
        keys.repartitionByRange(*order).sortWithinPartitions(*order), stream,
        "kind int, part int, h long, g long, doc long, text_hash long, n int, pos int", "lines-streamed",
    )
    carried, held, begun = [(-1, 0)], None, {}
    for r in streamed.where(F.col("kind") >= FIRST).orderBy("part", "kind").collect():  # two rows per partition
        if r.kind == FIRST:
            begun[r.part] = held is not None and held[:2] == (r.h, r.g)
            if begun[r.part]:
                carried.append((r.part, held[2]))
        elif held is None or held[:2] != (r.h, r.g):
            held = (r.h, r.g, r.doc)
    earlier = F.broadcast(spark.createDataFrame(carried, "p int, holder long"))  # one row per partition at most
    opened = streamed.where(F.col("kind") == OPEN).join(earlier, F.col("part") == F.col("p")).where("doc <> holder")
    gone = streamed.where(F.col("kind") == GONE).unionByName(opened.drop("p", "holder")).select("doc", "text_hash", "n", "pos")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits = None, None

        def done():
            return (None if key[0] == _LAST else key[0], key[1], zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))

        for b in batches:
            out = []
            doc, text, n, pos = (column(b, c).to_numpy() for c in ("doc", "text_hash", "n", "pos"))
            edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])) if len(doc) else []
            for i, j in zip(edges, [*edges[1:], len(doc)]):
                if key != (int(doc[i]), int(text[i])):
                    if key is not None:
                        out.append(done())
                    key, bits = (int(doc[i]), int(text[i])), np.ones(int(n[i]), np.uint8)
                bits[pos[i:j]] = 0
            yield _bitmap_batch(out)
        if key is not None:
            yield _bitmap_batch([done()])

    return gone.repartition("doc", "text_hash").sortWithinPartitions("doc", "text_hash").mapInArrow(bitmaps, "doc_id long, text_hash long, bitmap binary")


def _bitmap_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())],
        names=["doc_id", "text_hash", "bitmap"],
    )


def keep_bits(bitmap: bytes | None, n: int) -> np.ndarray:
    """The keep flags of a document's n lines; no bitmap keeps all."""
    if bitmap is None:
        return np.ones(n, bool)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def kept_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    maps = dropped_lines(docs, least_chars).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "bitmap")
    joined = base.join(maps, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text", "bitmap")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            counts, gone, texts = [], [], []
            for text, bitmap in zip(column(b, "text").to_pylist(), column(b, "bitmap").to_pylist()):
                lines = (text or "").split("\n")
                if bitmap is None:
                    counts.append(len(lines)), gone.append(0), texts.append(text or "")
                    continue
                keep = keep_bits(bitmap, len(lines))
                counts.append(len(lines)), gone.append(int((~keep).sum())), texts.append("\n".join(x for x, k in zip(lines, keep) if k))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_text"],
            )

    return joined.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_text string")
