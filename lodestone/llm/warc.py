"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: payload digests and lengths are computed in one narrow pass; of equal long payloads the record with the
largest page_id is the response, the others are revisit records without payload.  Only the revisits (id and target)
travel: they are broadcast if their counted number is small, joined by shuffle otherwise.

Reading: an archive is cut into byte ranges.  A task looks for the record magic in its range, parses a header at each
hit, however long, and emits (offset, successor offset) candidates, also for magic inside payloads.  Pointer jumping
from the start of the file then keeps the reachable records only: each round doubles the jump, so a file of n records
takes log2(n) rounds, in numpy, on a file's offsets.  A file whose chain does not end at its last byte is an error.
Only the payloads of records that are kept are read and hashed, in pieces of PIECE bytes.

Nulls and ties: a null html is an empty payload; a null url writes no target header; among equal payloads rows without
page_id are never the response unless all are; repeated rows of the winning page_id are all responses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_table, column, open_shared, publish, small_batches
from lodestone.storage import materialize, shared_folder

MAGIC = b"WARC/1.1\r\n"
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 1000
#: Bytes of an archive that one task searches; records may reach beyond.
RANGE_BYTES = 8 << 20
#: Bytes first searched for a header's end; doubled while it is not found.
HEADER_BYTES = 1 << 16
#: Bytes of a payload that are hashed at once.
PIECE = 4 << 20
#: Revisits up to this number are broadcast to the writers.
BROADCAST_ROWS = 200_000
_EPOCH = b"1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit names its target and carries no payload."""
    lines = [b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    if page_id is not None:
        lines.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        lines.append(b"WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode()) for c in url).encode())
    lines += [b"WARC-Date: " + _EPOCH, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Bytes: %d" % size]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    lines.append(b"Content-Length: %d" % len(payload))
    return MAGIC + b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write page_id, url, html as WARC files, one per partition of the pages; returns the folder and (path, bytes)."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    long_ = pages.where(F.octet_length("html") >= least_bytes).select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").alias("n"))
    digests = materialize(long_, "warc-digests")
    first = digests.groupBy("digest", "n").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    again = digests.join(first, ["digest", "n"]).where(F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")))
    again = materialize(again.select(F.col("page_id").alias("again"), "digest", "target").distinct(), "warc-revisits")
    small = again.count() <= BROADCAST_ROWS
    key = pages.page_id.eqNullSafe(again.again) & (F.unhex(F.sha1("html")) == again.digest)
    rows = pages.join(F.broadcast(again) if small else again, key, "left").select("page_id", "url", "html", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, size = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc", [0]

        def write(stream) -> None:
            for b in batches:
                for page_id, url, html, target in zip(*(column(b, c).to_pylist() for c in ("page_id", "url", "html", "target"))):
                    payload = html.encode()
                    data = record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), len(payload), target)
                    stream.write(data)
                    size[0] += len(data)

        publish(path, write)
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": pa.array(size, pa.int64())})

    with small_batches(spark):
        files = rows.mapInArrow(run, "path string, bytes long").collect()  # one row per file
    return folder, spark.createDataFrame(files, "path string, bytes long")


def unfinished(raw: bytes) -> bool:
    """Whether the bytes may begin a record header that ends after them."""
    return raw.find(b"\r\n\r\n") < 0 and all(b":" in line for line in raw[len(MAGIC) :].split(b"\r\n")[:-1])


def parse_header(raw: bytes) -> tuple[dict[str, str], int] | None:
    """The headers of a record and where its block starts; None if the bytes do not begin with a whole record header."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(MAGIC) or end < 0:
        return None
    fields: dict[str, str] = {}
    for line in raw[len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.decode("latin1").strip().lower(), value.decode("utf8", "replace").strip())
    if not fields.get("content-length", "").isdecimal():
        return None
    if len(fields["content-length"]) > 18:
        return None
    return fields, end + 4


def reachable(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of a file's candidate records (sorted by start) the chain from offset 0 reaches, by pointer jumping."""
    n = len(starts)
    jump = np.searchsorted(starts, ends)
    jump = np.where((jump < n) & (starts[np.minimum(jump, n - 1)] == ends), jump, n) if n else jump
    jump = np.append(jump, n)  # n: past the last record, or off the chain
    seen = np.zeros(n + 1, bool)
    if n and starts[0] == 0:
        seen[0] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        jump = jump[jump]
        if (more == seen).all():
            return seen[:n]
        seen = more


def _number(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").rpartition(":")[2]
    return int(text) if text.lstrip("-").isdecimal() else None


def _size(text: str | None) -> int:
    return int(text) if (text or "").isdecimal() else 0


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the archives (path, bytes): page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Payload size and digest are computed from the payload of a response and read from the header of a revisit.
    """
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("from"))
    tasks = max(1, ranges.count())
    schema = "path string, start long, next long, body long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, begin in zip(*(column(b, c).to_pylist() for c in ("path", "bytes", "from"))):
                store, place = open_shared(path)
                out = []
                with store.open_input_file(place) as f:
                    end = min(begin + range_bytes, size)
                    data = f.read_at(end - begin + len(MAGIC) - 1, begin)
                    at = data.find(MAGIC)
                    while 0 <= at < end - begin:
                        window = HEADER_BYTES
                        while True:
                            raw = data[at : at + window] if at + window <= len(data) else f.read_at(min(window, size - begin - at), begin + at)
                            if window >= size - begin - at or not unfinished(raw):
                                break
                            window *= 2
                        head = parse_header(raw)
                        if head is not None:
                            fields, block = head
                            length = int(fields["content-length"])
                            start, body = begin + at, begin + at + block
                            if body + length + 4 <= size:
                                revisit = fields.get("warc-type") == "revisit"
                                said = (_size(fields.get("x-payload-bytes")), fields.get("warc-payload-digest", "").rpartition(":")[2]) if revisit else (length, None)
                                out.append((
                                    path, start, body + length + 4, body, _number(fields.get("warc-record-id")), fields.get("warc-target-uri"), *said,
                                    "revisit" if revisit else "response", _number(fields.get("warc-refers-to")),
                                ))
                        at = data.find(MAGIC, at + 1)
                    if end == size:  # the file's end, which the chain must reach
                        out.append((path, size, -1, *[None] * 7))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), (pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    names=names,
                )

    found = arrow_table(ranges.repartition(tasks, "path", "from"), candidates, schema, "warc-candidates")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            starts, ends = column(whole, "start").to_numpy(), column(whole, "next").to_numpy()
            keep = reachable(starts, ends)
            if ends[-1] != -1 or not keep[-1]:
                raise ValueError(f"{current}: no record at offset {ends[keep].max(initial=0)}, before the file's end")
            return whole.filter(pa.array(keep & (ends >= 0))).select(["path", "start"])

        for b in batches:  # files follow each other in a sorted partition; a file's offsets are held together
            paths = column(b, "path").to_pylist()
            i = 0
            while i < len(paths):
                j = i
                while j < len(paths) and paths[j] == paths[i]:
                    j += 1
                if current is not None and paths[i] != current:
                    yield done()
                    held = []
                current = paths[i]
                held.append(b.slice(i, j - i))
                i = j
        if held:
            yield done()

    offsets = found.select("path", "start", "next").repartition("path").sortWithinPartitions("path", "start")
    good = offsets.mapInArrow(chain, "path string, start long")
    kept = found.join(good, ["path", "start"], "left_semi").drop("next").withColumn("_range", F.floor(F.col("start") / range_bytes))
    read = [f.name for f in kept.schema.fields if f.name not in ("path", "start", "body", "_range")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, data, stream = None, 0, b"", None
        for b in batches:
            digests = []
            for path, start, body, n, digest, at in zip(*(column(b, c).to_pylist() for c in ("path", "start", "body", "payload_bytes", "payload_digest", "_range"))):
                if digest is None:
                    if held != (path, at):  # a range's records follow each other: one read serves all
                        if stream is not None:
                            stream.close()
                        store, place = open_shared(path)
                        stream, held, begin = store.open_input_file(place), (path, at), at * range_bytes
                        data = stream.read_at(range_bytes, begin)
                    sha, done = hashlib.sha1(memoryview(data)[body - begin : body - begin + n] if body - begin < len(data) else b""), max(0, min(n, begin + len(data) - body))
                    while done < n:
                        piece = stream.read_at(min(PIECE, n - done), body + done)
                        sha.update(piece)
                        done += len(piece)
                    digest = sha.hexdigest()
                digests.append(digest)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()) if c == "payload_digest" else column(b, c) for c in read], names=read)
        if stream is not None:
            stream.close()

    dealt = kept.repartition("path", "_range").sortWithinPartitions("path", "start")
    return dealt.mapInArrow(hashed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives and return what is read back from them, one row per record."""
    _, files = write_archives(pages)
    return read_archives(files)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives in a folder of the shared storage."""
    from pyarrow import fs

    store, place = open_shared(folder)
    found = [(f"{folder.rstrip('/')}/{i.base_name}", i.size) for i in store.get_file_info(fs.FileSelector(place)) if i.base_name.endswith(".warc")]
    return spark.createDataFrame(sorted(found), "path string, bytes long")
