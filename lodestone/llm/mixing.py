"""Mixing sources to target weights.

1. Documents lie end to end in the order (source, doc_id, text hash); running sums over range partitions give each its
   place, so a hot source is no hot task.  A source's words are packed into blocks of a fixed length; a block may hold
   the end of one document and the start of the next.
2. Targets: each source's share by weight, at most ``most_repeats`` times its size, the excess reshared by weight.
3. A source's target becomes slots (one block each).  Output shards draw their source counts from multinomials over the
   slots still owed: all slots are halved between the first and the second half of the shards, these again, and so on,
   so every source ends with exactly its slots, and a task finds its own shard's counts by itself.
4. Slot j of a source takes block perm(j), a keyed Feistel permutation of its blocks (one per pass over the source), the
   short one at the source's end among them; the very last slot takes only the words still missing.  Hence a source's taken words are its target rounded, and no block is taken more often than
   ``most_repeats`` times.
5. Slots and blocks are joined on (source, block).

The driver and each task hold one row per source (at most MAX_SOURCES, checked); counts per source and shard exist
only in the shard's task.

Nulls and ties: a null text has no words (size 0, taken 0); the null source is a source of its own, in the last place;
repeated rows are separate documents, each with its own source and columns; rows that are equal in all columns are
interchangeable; rows without doc_id come first in their source.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import column, global_offsets, mix, pieces, sealed
from lodestone.storage import materialize

BLOCK_WORDS = 64
SHARD_BLOCKS = 1 << 14
MAX_SOURCES = 100_000
_SPACE = "[ \\t-\\r]+"


def word_count(text: str):
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: 0)."""
    bare = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _SPACE))).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most_repeats: float) -> list[float]:
    """Words owed to each source: by weight, at most ``most_repeats`` times its size; excess is reshared by weight."""
    owed, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if owed * weights[i] / weight > most_repeats * sizes[i]]
        if not over:
            for i in open_:
                out[i] = owed * weights[i] / weight
            break
        for i in over:
            out[i] = float(most_repeats * sizes[i])
            owed -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def slots_of(size: int, target: float, block: int, key: Callable[[int], int]) -> tuple[int, int]:
    """Slots of a source, and the words of its last slot.

    :param key: the permutation's key of each pass: where the short block comes in the last pass tells how many slots that
        pass needs.
    """
    words = round(target)
    if not size or not words:
        return 0, 0
    passes, rest = divmod(words, size)
    per, tail = -(-size // block), size % block or block
    if not rest:
        last = int(permute(np.array([per - 1]), per, key(passes - 1))[0])
        return passes * per, tail if last == per - 1 else block
    short = int(unpermute(np.array([per - 1]), per, key(passes))[0])
    n = -(-rest // block)
    if short < n:  # the short block is among them: what it lacks may need one more
        n = max(-(-(rest + block - tail) // block), short + 1)
    before = (n - 1) * block - (block - tail) * (short < n - 1)
    return passes * per + n, rest - before


def drawn_counts(owed: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """``n`` of the owed slots by source: multinomial over what is still owed, never more than owed."""
    drawn = np.zeros_like(owed)
    while (missing := n - int(drawn.sum())) > 0:
        left = owed - drawn
        drawn += np.minimum(rng.multinomial(missing, left / left.sum()), left)
    return drawn


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one output shard: each source's first slot and number of slots.  Shards hold equal numbers of slots; the way from
    all shards down to one halves them, and each half's counts are a draw that only depends on the seed."""
    first, owed, lo, hi = np.zeros_like(slots), slots.copy(), 0, shards
    total = int(slots.sum())
    edge = lambda k: total * k // shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = drawn_counts(owed, edge(mid) - edge(lo), np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            owed, hi = left, mid
        else:
            first, owed, lo = first + left, owed - left, mid
    return first, owed


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n): a four-round Feistel network, walked until inside the range."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), mix(np.arange(4, dtype=np.uint64) + np.uint64(key & (1 << 63) - 1) * np.uint64(4))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unpermute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of ``permute``."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, keys = np.uint64((1 << half) - 1), mix(np.arange(4, dtype=np.uint64) + np.uint64(key & (1 << 63) - 1) * np.uint64(4))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def mix_plan(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most_repeats: int = 2, block_words: int = BLOCK_WORDS, seed: int = 7,
    row_keys: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The documents' places and the mix.

    :param docs: doc_id, source, text; weights go to the sources in code point order (null last), repeating.
    :param row_keys: columns that tell apart rows of one doc_id and text; they come back in rows.
    :returns: rows(row_id, doc_id, text_hash, size, source_size, target) and
        takes(row_id, shard, slot, pass, start, words): words [start, start + words) of a document in an output slot.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), word_count("text").alias("size"),
        F.col("source").isNull().alias("unnamed"), *row_keys,
    )
    placed = global_offsets(sized, ["unnamed", "source", "doc_id", "text_hash", *row_keys], "size", "at", "mix-places", row_id="row_id")
    totals = placed.groupBy("source").agg(F.sum("size").alias("size"), F.min("at").alias("at")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    owed = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most_repeats)
    key = lambda s, turn: seed + 1_000_003 * s + turn
    plan = [slots_of(n, t, block_words, partial(key, s)) for s, (n, t) in enumerate(zip(sizes, owed))]
    slots = np.array([n for n, _ in plan], np.int64)
    shards = max(1, -(-int(slots.sum()) // SHARD_BLOCKS)) if len(slots) else 0
    size_of, last_of = sizes, [p for _, p in plan]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, (begun, counts) in ((k, shard_counts(slots, shards, k, seed)) for k in column(b, "shard").to_pylist()):
                for s, first, n in ((int(s), int(begun[s]), int(counts[s])) for s in np.flatnonzero(counts)):
                    for i in range(first, first + n, 1 << 16):
                        j = np.arange(i, min(i + (1 << 16), first + n))
                        per, tail = -(-size_of[s] // block_words), size_of[s] % block_words or block_words
                        turn, block = j // per, np.zeros(len(j), np.int64)
                        for t in np.unique(turn):
                            block[turn == t] = permute(j[turn == t] % per, per, key(s, int(t)))
                        words = np.where(block == per - 1, tail, block_words)
                        if j[-1] == slots[s] - 1:
                            words[-1] = last_of[s]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(j), shard, np.int32)), pa.array(np.full(len(j), s, np.int32)), pa.array(j), pa.array(turn.astype(np.int32)), pa.array(block), pa.array(words)],
                            names=["shard", "src", "slot", "pass", "block", "words"],
                        )

    drawn = spark.range(0, shards, 1, max(1, min(shards, 100_000))).select(F.col("id").cast("int").alias("shard"))
    chosen = drawn.mapInArrow(place, "shard int, src int, slot long, pass int, block long, words long")
    names = spark.createDataFrame(
        [(i, r.source, r.at, float(t), r["size"]) for i, (r, t) in enumerate(zip(totals, owed))],
        "src int, name string, origin long, target double, source_size long",
    )
    rows = placed.join(F.broadcast(names), placed.source.eqNullSafe(names.name)).drop("name", "unnamed", "source")  # at most MAX_SOURCES rows
    place_in = F.col("at") - F.col("origin")
    places = (
        rows.where("size > 0").select(
            "row_id", "src", "size", place_in.alias("a"),
            F.explode(F.sequence(F.floor(place_in / block_words), F.floor((place_in + F.col("size") - 1) / block_words))).alias("block"),
        )
        .select(
            "row_id", "src", "block", F.greatest(F.col("a"), F.col("block") * block_words).alias("from"),
            F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block_words).alias("to"), "a",
        )
    )
    # the slots come from a small local table, which Spark would take for small themselves and broadcast
    taken_to = F.least(F.col("to"), F.col("block") * block_words + F.col("words"))
    takes = places.join(chosen.hint("merge"), ["src", "block"]).where(taken_to > F.col("from")).select(
        "row_id", "shard", "slot", "pass", (F.col("from") - F.col("a")).alias("start"), (taken_to - F.col("from")).alias("words"),
    )
    return rows.drop("at", "origin", "src"), takes


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows, takes = mix_plan(docs, **options)
    taken = takes.groupBy("row_id").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def cut(text: str, ranges: list[tuple[int, int]], size: int) -> str:
    """The words of the ranges (start, words) of a text; white space between neighbours stays as it was."""
    if sum(n for _, n in ranges) >= size:
        return text
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    joined: list[list[int]] = []
    for start, n in sorted(ranges):
        if joined and joined[-1][1] == start:
            joined[-1][1] += n
        else:
            joined.append([start, start + n])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents (all columns of ``docs``): one row per document and pass, with the words that pass takes.

    A document that the mix does not take is left out; n_chars, where there is such a column, follows the text.  Rows keep
    their own columns: they are told apart by two hashes of all of them, by which texts and takes are joined in one
    shuffle; only where rows are equal in all columns are they reduced to one before.
    """
    counted = dict(docs.dtypes).get("n_chars") == "bigint"
    sealed_docs, restored = sealed(docs, "doc_id", "text", "source", *["n_chars"] * counted)
    names, keys = sealed_docs.columns, ["_row1", "_row2"]
    keyed = sealed_docs.withColumns({k: F.xxhash64(F.lit(i), *names) for i, k in enumerate(keys)})
    rows, takes = mix_plan(keyed, row_keys=tuple(keys), **options)
    parts = takes.groupBy("row_id", "pass").agg(F.collect_list(F.struct("start", "words")).alias("ranges"))  # a document's blocks at most
    copies = materialize(rows.join(parts, "row_id").select(*keys, "size", "ranges"), "mix-copies")
    if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(keys)
    joined = keyed.join(copies, keys).select(*names, "size", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [cut(t or "", [(r["start"], r["words"]) for r in rs], n) for t, rs, n in zip(column(b, "text").to_pylist(), column(b, "ranges").to_pylist(), column(b, "size").to_pylist())]
            arrays = [b.column(i) for i in range(len(names))]
            arrays[names.index("text")] = pa.array(texts, pa.string())
            if counted:
                arrays[names.index("n_chars")] = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, sealed_docs.schema).select(*restored)
