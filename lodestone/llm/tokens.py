"""Token ids in patched frame-of-reference (PFOR) shard files.

A shard holds the ids of a run of documents in ascending doc_id order:

    magic "LTPF1\\n" | blocks | document table | block index | footer

* block: 1,024 ids (the last may hold fewer).  The block minimum is subtracted; the rest is packed little-endian at
  the width that the 90th percentile of the differences needs (or a wider one, if that makes the block smaller).
  Differences that do not fit keep their low bits in place and have their positions (u16) and high bits (u32) in an
  exception list.
* block header: minimum u32, ids u16, width u8, one unused byte, exceptions u16.
* document table: per document doc_id i64, null flag u8, first id in the shard u64; then the shard's number of ids.
* block index: byte offset of each block u64.
* footer: documents u64, ids u64, blocks u64, offset of the document table u64, magic.

So any document is read by its table entry and the blocks that cover it.  Files are written under an attempt's own
name and then moved, so a retried task leaves one whole file.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SEPARATOR, column, give_back, open_shared, publish, small_batches, span_hashes, steps, text_bytes, word_spans
from lodestone.storage import importable, shared_folder

MAGIC = b"LTPF1\n"
BLOCK = 1024
PERCENTILE = 90
_HEAD = struct.Struct("<IHBBH")
_WHOLE = {8: "<u1", 16: "<u2", 32: "<u4"}
_FOOT = struct.Struct("<QQQQ6s")
#: Kinds of bytes: 0 between words, 1 letters (ASCII, and Latin-1 in its two bytes), 2 punctuation that never joins
#: letters, 3 all else.  Bytes 80 to BF also follow other first bytes, which are of kind 3 and so mark the word.
_KIND = np.full(256, 3, np.uint8)
_KIND[SEPARATOR] = 0
_KIND[[i for i in range(128) if chr(i).isalpha()]] = 1
_KIND[0x80:0xC0] = _KIND[0xC3] = 1
_KIND[list(b".,;:!?|")] = 2
_PLAIN = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[.,;:!?|]+")
#: Distinct units whose ids a Python worker remembers at once.
MEMORY_WORDS = 400_000


# -- blocks ---------------------------------------------------------------------------------------------------------


def pack_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    widths = np.frexp(rest.astype(np.float64))[1]  # bits of each difference
    counts = np.bincount(widths, minlength=33)
    over = len(rest) - np.cumsum(counts)  # exceptions at each width
    least = int(np.sort(widths)[(len(widths) * PERCENTILE + 99) // 100 - 1])
    cost = over[least:] * 48 + np.arange(least, 33) * len(rest)
    width = least + int(np.argmin(cost))
    at = np.flatnonzero(widths > width)
    if width in _WHOLE:  # whole bytes are stored as they are
        body = rest.astype(_WHOLE[width]).tobytes()
    else:
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        body = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    high = (rest[at].astype(np.uint64) >> np.uint64(width)).astype("<u4")
    return _HEAD.pack(low, len(ids), width, 0, len(at)) + body + at.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    low, n, width, _, wrong = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    if width in _WHOLE:
        ids = np.frombuffer(data, _WHOLE[width], n, at).astype(np.uint64)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits
        ids = np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n).astype(np.uint64)
    at += size
    if wrong:
        where = np.frombuffer(data, "<u2", wrong, at)
        ids[where] |= np.frombuffer(data, "<u4", wrong, at + 2 * wrong).astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(low)).astype(np.uint32)


# -- shards ---------------------------------------------------------------------------------------------------------


class ShardWriter:
    """Streams documents into one shard; holds one block and the document table."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[tuple[int | None, int]] = []
        self.index: list[int] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.total))
        self.total += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, end, BLOCK):
            block = pack_block(ids[i : min(i + BLOCK, end)])
            self.index.append(self.at)
            self.stream.write(block)
            self.at += len(block)
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        ids = np.array([d if d is not None else 0 for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], "u1")
        first = np.array([*(s for _, s in self.docs), self.total], "<u8")
        for part in (ids, null, first, np.array(self.index, "<u8")):
            self.stream.write(part.tobytes())
        self.stream.write(_FOOT.pack(len(self.docs), self.total, len(self.index), self.at, MAGIC))


class Shard:
    """Reads a shard through ``read(size, offset)``: its tables at once, and only the blocks that cover what is asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        n, self.total, blocks, at, magic = _FOOT.unpack(read(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC or bytes(read(len(MAGIC), 0)) != MAGIC:
            raise ValueError("not a token shard")
        tables = memoryview(read(size - _FOOT.size - at, at))
        self.doc_ids = np.frombuffer(tables, "<i8", n)
        self.null = np.frombuffer(tables, "u1", n, 8 * n)
        self.first = np.frombuffer(tables, "<u8", n + 1, 9 * n)
        self.index = np.append(np.frombuffer(tables, "<u8", blocks, 17 * n + 8), np.uint64(at)).astype(np.int64)

    def documents(self, most: int = 1 << 18) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first document, ids of each) of runs of documents with at most ``most`` ids together, one document at least."""
        i, n = 0, len(self.doc_ids)
        while i < n:
            j = max(i + 1, min(int(np.searchsorted(self.first, self.first[i] + np.uint64(most), "right")) - 1, n, i + 1024))
            yield i, self.ids(i, j)
            i = j

    def ids(self, i: int, j: int) -> list[np.ndarray]:
        """The ids of each of the documents i to j - 1."""
        cuts = self.first[i : j + 1].astype(np.int64)
        a, b = int(cuts[0]) // BLOCK, -(-int(cuts[-1]) // BLOCK)
        if cuts[0] == cuts[-1]:
            return [np.zeros(0, np.uint32)] * (j - i)
        data = memoryview(self.read(int(self.index[b] - self.index[a]), int(self.index[a])))
        flat = np.concatenate([unpack_block(data, int(self.index[k] - self.index[a])) for k in range(a, b)])
        return [flat[x - a * BLOCK : y - a * BLOCK] for x, y in zip(cuts[:-1], cuts[1:])]


# -- encoding -------------------------------------------------------------------------------------------------------


#: Alternatives of a split pattern that keep runs of letters, and runs of neither letters, digits nor white space, apart.
CUTS_LETTERS = {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"}
#: Normalizers that change nothing across white space.
_LOCAL = {"NFC", "Lowercase"}


def listed(step: dict | None, inner: str) -> list[dict]:
    """A tokenizer file's step as the list of its parts."""
    if step is None:
        return []
    return [y for x in step[inner] for y in listed(x, inner)] if step["type"] == "Sequence" else [step]


def _patterns(step: dict) -> list[str]:
    """The alternatives of a split that keeps what it matches and drops the rest."""
    keeps = step["type"] == "Split" and step.get("invert") and step.get("behavior") == "Removed"
    return step["pattern"].get("Regex", "").split("|") if keeps else []


def splits_words(described: dict) -> bool:
    """Whether white space surely parts what a tokenizer encodes and is dropped: it folds white space, if anything, and
    then keeps only matches of patterns that match no white space."""
    folds = lambda x: x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" and x["content"] == " "
    local = all(x["type"] in _LOCAL or folds(x) for x in listed(described.get("normalizer"), "normalizers"))
    plain = re.compile(r"'[a-z]+|\[(?:\\p\{[LN]\})+\]\+?|\[\^\\s(?:\\p\{[LN]\})*\]\+?")  # such as 's, [\p{L}]+, [^\s\p{L}]+
    first = next(iter(listed(described.get("pre_tokenizer"), "pretokenizers")), None)
    if first is None or not local:
        return False
    return first["type"] in ("WhitespaceSplit", "Whitespace", "BertPreTokenizer") or bool(_patterns(first)) and all(map(plain.fullmatch, _patterns(first)))


class WordEncoder:
    """Encodes whole texts with a ``tokenizers`` file, each distinct unit (a word or a part of one) once.

    Right only for tokenizers that split at white space and drop it, so that no id crosses a word.  The file's own
    description decides that (``splits_words``); texts are encoded in one piece with any other tokenizer.  If pieces
    also end with a word-end token, are cut between letters and other signs, and case does not count, words of Latin
    letters and common punctuation are cut between the two, letters are lower-cased, and many such units are encoded in
    one call: the word-end tokens tell them apart.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        steps_ = listed(described.get("pre_tokenizer"), "pretokenizers")
        self.by_word = by_word and splits_words(described)
        suffix = described["model"].get("end_of_word_suffix") or ""
        lower = any(x["type"] == "Lowercase" for x in listed(described.get("normalizer"), "normalizers"))
        self.cut = self.by_word and bool(suffix) and lower and any(CUTS_LETTERS <= set(_patterns(x)) for x in steps_)
        vocabulary = self.tokenizer.get_vocab() if self.cut else {}
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        # known units by a 128-bit hash of their bytes: two sorted columns, and each unit's place in the lists of ids
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.places = np.zeros(0, np.int32)
        self.known = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The places of units by their hashes, -1 where unknown."""
        if not len(self.places):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys[0], h), len(self.places) - 1)
        return np.where((self.keys[0][at] == h) & (self.keys[1][at] == g), self.places[at], -1).astype(np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and each text's number of ids."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _remember(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(sizes), len(flat)
        while self.known + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while self.used + m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + m] = flat
        self.sizes[self.known : self.known + n] = sizes
        self.starts[self.known : self.known + n] = self.used + np.cumsum(sizes) - sizes
        self.known, self.used = self.known + n, self.used + m

    def _learn(self, units: list[str], h: np.ndarray, g: np.ndarray) -> None:
        plain, odd = [], []
        for i, u in enumerate(units):
            (plain if self.cut and _PLAIN.fullmatch(u) else odd).append(i)
        first = self.known
        for i in range(0, len(odd), 8192):
            self._remember(*self._encode([units[k] for k in odd[i : i + 8192]]))
        for i in range(0, len(plain), 8192):
            part = [units[k] for k in plain[i : i + 8192]]
            flat, _ = self._encode([" ".join(part[k : k + 512]) for k in range(0, len(part), 512)])
            ends = np.flatnonzero(self.last[flat]) + 1
            if len(ends) == len(part) and ends[-1] == len(flat):
                self._remember(flat, np.diff(ends, prepend=0))
            else:  # some unit is more than one piece here
                self._remember(*self._encode(part))
        order = np.array(odd + plain, np.int64)
        h, g, places = h[order], g[order], np.arange(first, self.known, dtype=np.int32)
        order = np.argsort(h, kind="stable")
        at = np.searchsorted(self.keys[0], h[order])
        self.keys = [np.insert(k, at, v[order]) for k, v in zip(self.keys, (h, g))]
        self.places = np.insert(self.places, at, places[order])

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word:
            yield from (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False))
            return
        data, offsets = text_bytes(texts)
        for i, j in steps(offsets):
            yield from self._step(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with plain words lower-cased, and the starts and ends of the units."""
        kind = _KIND[data]
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1
        kind[latin[(data[latin] == 0x97) | (data[latin] == 0xB7)]] = 3  # the signs among the letters
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == 3, out=odd[1:])
        plain = odd[ends] == odd[starts]
        word = lambda at: np.searchsorted(starts, at, "right") - 1
        turn = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
        w = word(turn)
        turn = turn[plain[w] & (turn > starts[w])]
        upper = np.concatenate([np.flatnonzero((data >= 65) & (data <= 90)), latin[(data[latin] <= 0x9E)]])
        upper = upper[plain[word(upper)]]
        data = data.copy()
        data[upper] += 32
        return data, np.sort(np.concatenate([starts, turn])), np.sort(np.concatenate([ends, turn]))

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        starts, ends, _ = word_spans(data, offsets)
        if self.cut and len(starts):
            data, starts, ends = self._units(data, starts, ends)
        solid = data[~SEPARATOR[data]]  # the units without what is between them, end to end
        edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(solid)).dictionary_encode()
        raw, edges = text_bytes(coded.dictionary)
        h, g = (span_hashes(raw, edges[:-1], edges[1:], which) for which in (2, 3))
        if self.known > MEMORY_WORDS:
            self._clear()
        new = np.flatnonzero(self._find(h, g) < 0)
        if len(new):
            self._learn(coded.dictionary.take(pa.array(new)).to_pylist(), h[new], g[new])
        at = self._find(h, g)[coded.indices.to_numpy()]
        sizes = self.sizes[at].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.arange(int(sums[-1])) + np.repeat(self.starts[at] - sums[:-1], sizes)]
        cuts = sums[np.searchsorted(starts, offsets)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, by_word: bool = True) -> WordEncoder:
    """The encoder of this Python worker: words learned by one task serve the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    key = (path, by_word)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, by_word)
    return _encoders[key]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, by_word: bool = True, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the documents' ids (each with ``end_id`` appended) as shards in ascending doc_id order.

    Returns the folder and its manifest, one row per shard: shard, path, n_docs, start (ids before it), n_tokens.
    Shards follow the range partitions of (doc_id, text), so one task writes one shard and no task holds more than a
    batch of texts.  Null texts are empty (one end id); rows without doc_id come first; rows that share a doc_id
    follow in the order of their texts.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/shard-{part:06d}.pfor"
        said: list = []

        def write(stream) -> None:
            encode, shard = encoder(tokenizer, by_word), ShardWriter(stream)
            end = np.array([end_id], np.uint32)
            for b in batches:
                for d, ids in zip(column(b, "doc_id").to_pylist(), encode(column(b, "text"))):
                    shard.add(d, np.concatenate([ids, end]))
            shard.close()
            said.append((len(shard.docs), shard.total))

        publish(path, write)
        give_back()
        n, total = said[0]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([part], pa.int32()), "path": [path], "n_docs": [n], "n_tokens": [total]})

    with small_batches(spark):
        shards = sorted(ordered.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long").collect())  # one row per file
    rows, start = [], 0
    for s in shards:
        rows.append((s.shard, s.path, s.n_docs, start, s.n_tokens))
        start += s.n_tokens
    return folder, spark.createDataFrame(rows, "shard int, path string, n_docs long, start long, n_tokens long")


def read_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents read back from the files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(column(b, "path").to_pylist(), column(b, "start").to_pylist()):
                store, place = open_shared(path)
                with store.open_input_file(place) as f:
                    shard = Shard(f.read_at, f.size())
                    for i, ids in shard.documents():
                        part = slice(i, i + len(ids))
                        out = [
                            pa.array(shard.doc_ids[part], mask=shard.null[part].astype(bool)),
                            pa.array((shard.first[part] + np.uint64(base)).astype(np.int64)),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ]
                        if with_ids:
                            out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    importable(manifest.sparkSession)
    shards = max(1, manifest.count())
    rows = manifest.repartition(shards, "shard").mapInArrow(run, schema)
    return rows if with_ids else rows.repartition("doc_id")  # digests are small: a few files rather than one per shard


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the shards and return what is read back from them, one row per document."""
    _, manifest = write_shards(docs, tokenizer, end_id)
    return read_shards(manifest)


def default_tokenizer() -> str:
    """The path of the production tokenizer file (never copied into the repository)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
