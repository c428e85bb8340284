"""MinHash near-duplicate groups: universal hash minima, banding, signature and set verification, star components.

1. ``signatures``: one narrow pass turns each whole text into its set of k-word shingle hashes, 240 minima of
   multiply-add hashes, 40 band keys of six minima each, 480 signature bits and a 128-bit key of the set.
2. Texts with equal sets collapse to their smallest doc_id, so groups of exact copies cost one row.
3. Documents in a band bucket are paired with one hub of it; pairs that pass the signature are confirmed on the
   full sets, so a large group needs about one pair per member.  Where a bucket still holds several components, the
   documents outside its largest one are compared with that component and with each other, in blocks inside tasks: by
   signatures first, then those that pass with some partner on full sets.  No link between components is lost, and no
   pair becomes a row.
4. Components come from alternating large-star and small-star rounds on tables in the shared folder.

A band or a star centre may hold a third of all documents: such keys are dealt over many tasks in every join, and all
groupings are aggregations with map-side partials.

At similarity 0.8 a pair shares no band with probability (1 - 0.8^6)^40 < 6e-6, and its signature estimate falls
below the bound with about the same probability.

Nulls and ties: a null or wordless text has an empty set (0 shingles), links with nothing and is kept.  A row without
doc_id cannot be linked: component_id null, kept.  Rows that share a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_table, column, joined_evenly, mix, sealed, shingle_hashes, steps, text_bytes, word_hashes
from lodestone.storage import materialize, release

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
_seeded = np.random.default_rng(0x5EED)
_A = _seeded.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _seeded.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ROW = _seeded.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _seeded.integers(0, 1 << 64, BANDS, dtype=np.uint64)
#: Signature estimates this far below the threshold (over four standard deviations) are not confirmed on the sets.
MARGIN = 0.15
_SIGNS = [f"s{i}" for i in range(8)]
#: Documents whose shingle sets a group holds at once, and documents that are streamed past them in one group.
CHUNK, SHARE = 64, 2048
#: Up to this number of documents that share a bucket, their ids are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000

GROUP = ["c", "chunk", "share", "role", "node", "label"]
SIGNATURE = "doc_id long, n_shingles long, set_key binary, bands array<long>, s0 long, s1 long, s2 long, s3 long, s4 long, s5 long, s6 long, s7 long"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hashes over one set of 64-bit shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        h = x[None, i : i + 1024] * _A[:, None]
        h += _B[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(texts)
    for i, j in steps(offsets):
        words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for r in range(j - i):
            yield np.unique(shingle_hashes(words[at[r] : at[r + 1]], k))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text) -> set size, set key, band keys and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sizes, keys, mins = np.zeros(n, np.int64), [], np.zeros((n, HASHES), np.uint32)
            for r, s in enumerate(shingle_sets(column(b, "text"), k)):
                sizes[r] = len(s)
                keys.append(s.sum(dtype=np.uint64).tobytes() + mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes())
                if len(s):
                    mins[r] = minima(s)
            wide = mix(mins.astype(np.uint64) + np.uint64(0x51ED270B))
            bands = mix((wide.reshape(n, BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64) + _SALT).view(np.int64)
            bits = np.packbits(
                np.concatenate([(wide >> np.uint64(7)) & np.uint64(1), (wide >> np.uint64(33)) & np.uint64(1), np.zeros((n, 32), np.uint64)], axis=1).astype(np.uint8),
                axis=1,
            ).view(np.int64).reshape(n, 8)
            empty = sizes == 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)), pa.array(bands[~empty].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), lists, *(pa.array(bits[:, i].copy()) for i in range(8))],
                names=[x.split()[0] for x in SIGNATURE.split(", ")],
            )

    return arrow_table(docs, run, SIGNATURE, "minhash-signatures")


def _mismatch(a: str, b: str):
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(8)))


def _most_mismatches(threshold: float) -> int:
    return int(480 * (1 - max(0.0, threshold - MARGIN)) / 2)


def confirmed(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) with 100 * intersection >= percent * union of the full shingle sets.

    :param groups: c, chunk, share, role, node, label: in each group (c, chunk, share) the few nodes of role 0 are held,
        as one table from shingle to holders, and those of role 1 are streamed past it.  Of the links between a held
        node and the streamed nodes of one label, the first is returned: more would not change the components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, said, table = None, [], [], set(), None
        for b in batches:
            found = []
            keys = zip(*(column(b, c).to_pylist() for c in ("c", "chunk", "share", "role", "node", "label")))
            for (c, chunk, share, role, node, label), s in zip(keys, shingle_sets(column(b, "text"), k)):
                if (c, chunk, share) != key:
                    key, nodes, sets, said, table = (c, chunk, share), [], [], set(), None
                if role == 0:
                    nodes.append(node), sets.append(s)
                    continue
                if not sets or not len(s):
                    continue
                if table is None:
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    order = np.argsort(flat, kind="stable")
                    table = flat[order], owner[order], np.array([len(x) for x in sets])
                flat, owner, sizes = table
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(sets))
                for i in np.flatnonzero(100 * both >= percent * (sizes + len(s) - both)):
                    if nodes[i] != node and (nodes[i], label) not in said and both[i]:
                        said.add((nodes[i], label))
                        found.append((nodes[i], node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    rows = groups.join(texts, groups.node == texts.doc_id).select(*GROUP, "text")
    return arrow_table(rows.repartition("c", "chunk", "share").sortWithinPartitions("c", "chunk", "share", "role"), run, "a long, b long", "minhash-links")


def promising(groups: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The rows of the groups that have a partner of the other role and another label whose signature and set size allow
    the similarity: only their texts need to be compared."""
    names = [*GROUP, "n", *_SIGNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hit = None, [], np.zeros(0, bool)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(GROUP)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if g == "role" else pa.int64()) for c, g in zip(columns, GROUP)], names=GROUP)

        def partners() -> pa.RecordBatch:
            return table([(*key, 0, node, label) for (node, label, _, _), h in zip(held, hit) if h])

        for b in batches:
            signed = np.column_stack([column(b, c).to_numpy() for c in _SIGNS]).astype(np.int64).view(np.uint64)
            own = list(zip(*(column(b, c).to_pylist() for c in (*GROUP, "n"))))
            i = 0
            while i < len(own):
                j = i
                while j < len(own) and own[j][:4] == own[i][:4]:
                    j += 1
                if own[i][:3] != key:
                    if key is not None:
                        yield partners()
                    key, held, hit = own[i][:3], [], np.zeros(0, bool)
                if own[i][3] == 0:
                    held += [(r[4], r[5], r[6], signed[k]) for k, r in enumerate(own[i:j], i)]
                    hit = np.zeros(len(held), bool)
                elif held:
                    far = np.bitwise_count(signed[i:j, None, :] ^ np.array([h[3] for h in held])[None, :, :]).sum(axis=2)
                    n, m = np.array([r[6] for r in own[i:j]])[:, None], np.array([h[2] for h in held])[None, :]
                    other = np.array([r[5] for r in own[i:j]])[:, None] != np.array([h[1] for h in held])[None, :]
                    near = (far <= _most_mismatches(percent / 100)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & other
                    hit |= near.any(axis=0)
                    yield table([(*key, 1, r[4], r[5]) for r, ok in zip(own[i:j], near.any(axis=1)) if ok])
                i = j
        if key is not None:
            yield partners()

    rows = groups.join(signs, groups.node == signs.rep).select(*names)
    schema = "c long, chunk long, share long, role int, node long, label long"
    return arrow_table(rows.repartition("c", "chunk", "share").sortWithinPartitions("c", "chunk", "share", "role"), run, schema, "minhash-promising")


def hub_groups(pairs: DataFrame) -> DataFrame:
    """Pairs (a hub, b) as groups: the hub is held, its members are dealt over shares of SHARE."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("n"))
    none = F.lit(0).cast("long")
    held = shares.select(
        F.col("a").alias("c"), none.alias("chunk"), F.explode(F.sequence(none, F.col("n") - 1)).alias("share"), F.lit(0).alias("role"),
        F.col("a").alias("node"), F.col("a").alias("label"),
    )
    streamed = pairs.join(shares, "a").select(
        F.col("a").alias("c"), none.alias("chunk"), F.pmod(F.xxhash64("b"), F.col("n")).alias("share"), F.lit(1).alias("role"),
        F.col("b").alias("node"), F.col("b").alias("label"),
    )
    return held.unionByName(streamed)


def block_groups(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets that hold several components as groups: of each bucket, the documents outside its largest component
    (held, in chunks of CHUNK) meet that component and each other (streamed, in shares of SHARE)."""
    sizes = open_.groupBy("band", "component").count()
    major = sizes.groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("c"), F.sum("count").alias("_n"))
    held = joined_evenly(open_, materialize(major, "minhash-majors"), ["band"], "_n").where("component <> c").select(
        "c", F.col("rep").alias("node"), F.col("component").alias("label"),
    ).distinct()
    members = labels.select(F.col("component").alias("c"), "node", F.col("component").alias("label")).join(held.select("c").distinct(), "c", "left_semi")
    lone = held.select("c", F.col("c").alias("node"), F.col("c").alias("label"))  # a component of one document has no label row
    streamed = members.unionByName(lone).unionByName(held).distinct()
    counts = held.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks")).join(
        streamed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("long").alias("shares")), "c",
    )
    counts = materialize(counts, "minhash-counts")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = held.join(counts, "c").select("c", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), spread("shares").alias("share"), F.lit(0).alias("role"), "node", "label")
    right = streamed.join(counts, "c").select(
        "c", spread("chunks").alias("chunk"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("shares")).alias("share"), F.lit(1).alias("role"), "node",
        "label",
    )
    return left.unionByName(right)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, by alternating large-star and small-star."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n")), "star-low")
        large = joined_evenly(both, low, ["u"], "_n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        release(low)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "star-low")
        small = joined_evenly(large, low, ["u"], "_n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, materialize(small, "small-star")
        release(before, large, low)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links need 100 * intersection >= percent * union.

    :param docs: a DataFrame with doc_id and text; other columns are ignored.
    :param k: words of a shingle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = signatures(docs, k)
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    sets = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "minhash-sets")
    reps = usable.join(
        sets.withColumnRenamed("set_key", "own_key"), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("own_key")),
    ).select("rep", "bands", F.col("n_shingles").alias("n"), *_SIGNS)
    buckets = reps.select("rep", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("_n")).where("hub < top").select("band", "hub", "_n")
    hubs = materialize(hubs, "minhash-hubs")
    shared = materialize(joined_evenly(buckets, hubs, ["band"], "_n").select("band", "hub", "rep"), "minhash-buckets")  # only documents that share a bucket
    nodes = materialize(shared.select(F.col("rep").alias("node")).distinct(), "minhash-nodes")
    asked = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    texts = materialize(docs.join(asked, docs.doc_id == asked.node, "left_semi"), "minhash-texts")
    signs = reps.drop("bands").join(nodes, reps.rep == nodes.node, "left_semi").dropDuplicates(["rep"])
    signs = materialize(signs, "minhash-signs")
    first = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    x, y = signs.alias("x"), signs.alias("y")
    near = first.join(x, F.col("a") == F.col("x.rep")).join(y, F.col("b") == F.col("y.rep"))
    near = near.where((_mismatch("x", "y") <= _most_mismatches(percent / 100)) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")))
    close = materialize(near.select("a", "b"), "minhash-close")
    links = confirmed(hub_groups(close), texts, k, percent)
    labels = components(links)
    named = shared.join(labels, shared.rep == labels.node, "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo < hi").select("band", "_n")
    open_ = materialize(joined_evenly(named, materialize(mixed, "minhash-mixed"), ["band"], "_n"), "minhash-open")
    if not open_.isEmpty():
        blocks = promising(block_groups(open_, labels), signs, percent)
        more = confirmed(blocks, texts, k, percent)
        labels = components(links.unionByName(more))
        release(blocks, more)
    release(hubs, shared, nodes, texts, signs, close, links, open_)
    of_set = sets.join(labels, sets.rep == labels.node, "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(linkable, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) of which one per near-duplicate group stays."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows, names = sealed(docs, "doc_id")
    return rows.join(gone, rows.doc_id == gone._gone, "left_anti").select(*names)
