"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification.

Words are runs of letters and digits, lower-cased (ASCII and Latin-1).  For each benchmark item of n words, windows of
n words slide over every document.

1. A window can only reach the similarity if enough of its shingles occur in the benchmark at all; running counts
   of such shingles drop the other windows without loss.
2. The window's 256-bit SimHash is cut into 16 blocks of 16 bits.  A fingerprint within RADIUS of an item's differs
   from it in at most NEAR bits of some block, so lists of the items by block value, read at all values within NEAR,
   find every item within the radius (about one other item in six comes along).  Only these are compared in full.
3. The window and an item within the radius are compared by the weighted (counted) Jaccard similarity of their
   five-word shingles.

Windows are taken in runs of at most WINDOWS and words in pieces of at most PIECE, so what a task holds besides a batch
of texts does not follow the length of a document, nor windows times items.

The benchmark is shipped to the tasks in parts of at most PART_ITEMS items and PART_WORDS words, one pass over the
documents for each part, so what travels has a fixed bound.

Nulls and ties: null or wordless texts contain nothing; null or wordless items match nothing; an item of fewer than
five words is one shingle; a document shorter than an item is one window; equal items are all reported; rows that are
equal in doc_id and text get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_table, column, mix, sealed, shingle_hashes, span_hashes, steps, text_bytes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a window of distinct words is further away than this, of 256 bits, with probability below 1e-4.
RADIUS = 63
BLOCKS, WIDTH = 16, 16
#: Bits in which some block of two fingerprints within the radius differs at most.
NEAR = RADIUS // BLOCKS
WINDOWS, PIECE, PAIRS = 512, 4096, 1 << 18
PART_ITEMS, PART_WORDS = 20_000, 2_000_000
_SEEDS = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x5117_0000_0000_0001)
#: All differences of two blocks that count as near.
_MASKS = np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)) <= NEAR).astype(np.uint16)
_GAP = np.ones(256, bool)
_GAP[[i for i in range(128) if chr(i).isalnum()]] = False
_GAP[128:] = False
HITS = "doc_id long, text_hash long, item_id long, similarity double, start int, words int"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words, and per text the offset of its first word (n + 1)."""
    if len(data) > 1:  # upper-case Latin-1 letters, C3 80 to C3 9E but the multiplication sign
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        if len(up):
            data = data.copy()
            data[up] += 0x20
    starts, ends, at = word_spans(data, offsets, _GAP)
    return span_hashes(data, starts, ends), at


def fingerprints(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHashes of the n-word windows at the ascending ``starts``, 16 blocks of 16 bits each: per bit, whether more words
    have it set than not.  Running counts go over the words in pieces and are kept at the windows' ends only."""
    ends = starts + n
    at = np.unique(np.concatenate([starts, ends]))
    counts = np.zeros((len(at), 256), np.int32)
    base, lo, last = np.zeros(256, np.int32), int(at[0]), int(at[-1])
    while lo < last:
        hi = min(lo + PIECE, last)
        if not ((starts < hi) & (ends > lo)).any():  # no window reaches here
            lo = int(starts[starts >= hi].min())
            continue
        own = mix(words[lo:hi, None] ^ _SEEDS[None, :])
        bits = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(hi - lo, 32), axis=1, bitorder="little")
        sums = np.cumsum(bits, axis=0, dtype=np.int32)
        sums += base
        a, b = np.searchsorted(at, [lo + 1, hi + 1])
        counts[a:b] = sums[at[a:b] - lo - 1]
        first = np.searchsorted(at, lo)
        if at[first] == lo:
            counts[first] = base
        base, lo = sums[-1].copy(), hi
    on = 2 * (counts[np.searchsorted(at, ends)] - counts[np.searchsorted(at, starts)]) > n
    return np.packbits(on, axis=1, bitorder="little").view("<u2").reshape(len(starts), BLOCKS)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two collections of shingle hashes, each weighted by its count."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


class BlockLists:
    """Items by the value of each block of their fingerprints: sorted distinct values, and the items of each."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for k in range(BLOCKS):
            order = np.argsort(prints[:, k], kind="stable").astype(np.int32)
            values, begin = np.unique(prints[order, k], return_index=True)
            self.tables.append((values, np.append(begin, len(order)), order))

    def _values(self, values: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in ``values``) of all values within NEAR bits: a short list is compared, a long one is probed at
        all near differences, whose number does not grow with it."""
        if len(values) <= 8 * len(_MASKS):  # a comparison costs about an eighth of a probe
            return np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= NEAR)
        wanted = own[:, None] ^ _MASKS[None, :]
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        w, m = np.nonzero(values[at] == wanted)
        return w, at[w, m]

    def within(self, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs within RADIUS, for some windows' fingerprints."""
        step = max(1, PAIRS // max(len(_MASKS), len(self.prints)))
        for i in range(0, len(own), step):
            part, pairs = own[i : i + step], []
            for k, (values, begin, order) in enumerate(self.tables):
                w, v = self._values(values, part[:, k])
                n = begin[v + 1] - begin[v]
                at = np.arange(int(n.sum())) + np.repeat(begin[v] - (np.cumsum(n) - n), n)
                pairs.append(np.repeat(w, n) * len(self.prints) + order[at])
            pairs = np.unique(np.concatenate(pairs))
            w, item = pairs // len(self.prints), pairs % len(self.prints)
            near = np.bitwise_count(part[w] ^ self.prints[item]).sum(axis=1) <= RADIUS
            yield from zip((w[near] + i).tolist(), item[near].tolist())


class Items:
    """A part of the benchmark: its shingles, and per item length the items' block lists."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words, at = words_of(data, offsets)
        self.ids, self.words = ids, [words[a:b] for a, b in zip(at[:-1], at[1:])]
        self.shingles = [shingle_hashes(w, SHINGLE) for w in self.words]
        self.lengths: dict[int, tuple[np.ndarray, BlockLists]] = {}
        widths: dict[int, list[np.ndarray]] = {}
        for n in sorted({len(w) for w in self.words if len(w)}):
            of = np.array([i for i, w in enumerate(self.words) if len(w) == n])
            prints = np.concatenate([fingerprints(self.words[i], np.array([0]), n) for i in of])
            self.lengths[n] = (of, BlockLists(prints))
            widths.setdefault(min(SHINGLE, n), []).extend(self.shingles[i] for i in of)
        self.known = {k: np.unique(np.concatenate(v)) for k, v in widths.items()}
        self.filters = {}
        for k, v in self.known.items():  # a bit table that most unknown shingles miss
            table = np.zeros(1 << 22, bool)
            table[(v >> np.uint64(42)).astype(int)] = True
            self.filters[k] = table

    def member(self, shingles: np.ndarray, k: int) -> np.ndarray:
        out = self.filters[k][(shingles >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(out)
        known = self.known[k]
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        out[at] = known[place] == shingles[at]
        return out

    def found(self, words: np.ndarray, members: dict[int, np.ndarray]) -> dict[int, tuple[float, int, int]]:
        """Item position -> best similarity, its window's start and words; ``members`` flags known shingles by width."""
        best: dict[int, tuple[float, int, int]] = {}
        counts = {k: np.concatenate([[0], np.cumsum(v)]) for k, v in members.items()}
        for n, (of, lists) in self.lengths.items():
            k, size = min(SHINGLE, n), min(n, len(words))
            if size < k or k not in counts:
                continue
            per = size - k + 1
            c = counts[k]
            inside = c[per : len(words) - k + 2] - c[: len(words) - size + 1]
            starts = np.flatnonzero(inside >= SIMILARITY * (n - k + 1) - 1e-9)
            if not len(starts):
                continue
            for i in range(0, len(starts), WINDOWS):
                run = starts[i : i + WINDOWS]
                for w, j in lists.within(fingerprints(words, run, size)):
                    start, item = int(run[w]), int(of[j])
                    s = weighted_jaccard(shingle_hashes(words[start : start + size], SHINGLE), self.shingles[item])
                    if s >= SIMILARITY - 1e-12 and (item not in best or s > best[item][0]):
                        best[item] = (s, start, size)
        return best


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, similarity, start, words: the best window of each item that a document contains."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    out, ids, texts, size = [], [], [], 0

    def scan() -> DataFrame:
        part = Items(list(ids), list(texts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offsets = text_bytes(column(b, "text"))
                doc, hashed, rows = column(b, "doc_id").to_pylist(), column(b, "text_hash").to_pylist(), []
                for i, j in steps(offsets):
                    words, at = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    flags = {k: part.member(shingle_hashes(words, k), k) for k in part.known if len(words) >= k}
                    seen = np.zeros(len(words) + 1, np.int64)
                    for v in flags.values():
                        seen[1 : len(v) + 1] += v
                    seen = np.cumsum(seen)
                    for r in np.flatnonzero(seen[at[1:]] > seen[at[:-1]]):
                        own = {k: v[at[r] : max(at[r], at[r + 1] - k + 1)] for k, v in flags.items()}
                        for item, (s, start, n) in part.found(words[at[r] : at[r + 1]], own).items():
                            rows.append((doc[i + r], hashed[i + r], part.ids[item], s, start, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))],
                    names=[x.split()[0] for x in HITS.split(", ")],
                )

        return arrow_table(docs, run, HITS, "leaks")

    for r in items.toLocalIterator():
        ids.append(r.item_id), texts.append(r.text)
        size += len(r.text.split())
        if len(ids) >= PART_ITEMS or size >= PART_WORDS:
            out.append(scan())
            ids, texts, size = [], [], 0
    if ids or not out:
        out.append(scan())
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids, similarity (the best, 0.0 if none)."""
    found = hits(docs, benchmark).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = base.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left")
    ids = F.coalesce("f.item_ids", F.array().cast("array<bigint>"))
    return joined.select(
        F.col("d.doc_id").alias("doc_id"), (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        F.coalesce("f.similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents (all columns) that contain no benchmark item."""
    bad = hits(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    rows, names = sealed(docs, "doc_id", "text")
    return rows.join(bad, rows.doc_id.eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left_anti").select(*names)
