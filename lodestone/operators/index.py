"""A persisted inverted index: postings in bucketed folders, maintained by segments, searched by its terms' buckets only.

Layout below one folder of the shared storage, a sub-folder per segment (one build or one batch of changes):

    documents/segment=N   id, order, deleted, length and the payload columns of every document version
    postings/segment=N/bucket=B   term, id, tf, sorted by term, so that a term is a few row groups of one bucket
    dead/segment=N   (segment, id, length) of earlier versions that this segment replaces

A change costs its own documents and one look at the ids of the table; nothing is rewritten.  A version wins by its
``order`` value, also against a later batch, and deletions are versions too, so an old change that comes late loses.
A repeated batch overwrites its own segment.  ``compact`` merges all segments into one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import code_tokens
from lodestone.operators import bm25
from lodestone.operators.checks import positive
from lodestone.operators.store import latest
from lodestone.storage import exists, materialize, release, remove

#: Buckets of terms: a search reads the buckets of its terms.
BUCKETS = 64


class InvertedIndex:
    """BM25 over documents (id, text, payload ...), kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, id_: str, text: str = "text", buckets: int = BUCKETS):
        self.spark, self.folder, self.id, self.text, self.buckets = spark, folder.rstrip("/"), id_, text, buckets

    # -- writing ----------------------------------------------------------------------------------------------------

    def build(self, docs: DataFrame) -> InvertedIndex:
        """Index ``docs`` from nothing; ids are unique."""
        remove(self.spark, self.folder)
        self._write(docs.withColumns({"_order": F.lit(0).cast("long"), "_deleted": F.lit(False)}), 0)
        return self

    def apply(self, changes: DataFrame, order: str, deleted: str = "deleted", segment: int | None = None) -> None:
        """Put in (or delete) documents.  Per id the highest ``order`` wins, among the changes and against the index.

        :param segment: the number of this change; the same number again replaces it.
        """
        number = self._segments() + 1 if segment is None else segment + 1
        news = latest(changes, [self.id], [order])
        news = news.withColumns({"_order": F.col(order).cast("long"), "_deleted": F.coalesce(F.col(deleted), F.lit(False))}).drop(deleted)
        for part in ("documents", "postings", "dead"):
            remove(self.spark, f"{self.folder}/{part}/segment={number}")
        if self._exists("documents"):
            live = self._live().where(F.col("segment") < number).select(self.id, F.col("segment").alias("_s"), F.col("_order").alias("_o"), F.col("_length").alias("_l"))
            news = materialize(news.join(live, self.id, "left").where(F.col("_o").isNull() | (F.col("_o") <= F.col("_order"))), "index-changes")
            replaced = news.where(F.col("_s").isNotNull()).select(F.col("_s").alias("segment"), self.id, F.col("_l").alias("length"))
            replaced.write.parquet(f"{self.folder}/dead/segment={number}")
        self._write(news.drop("_s", "_o", "_l"), number)
        release(news)

    def compact(self) -> None:
        """Write the live documents as one segment; tombstones are kept, so that old changes still lose."""
        whole, postings = self._live(), self._postings().drop("segment")
        target = f"{self.folder}-compact"
        remove(self.spark, target)
        whole.drop("segment").write.parquet(f"{target}/documents/segment=0")
        self._bucketed(postings, f"{target}/postings/segment=0")
        remove(self.spark, self.folder)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path(target).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(path(target), path(self.folder))

    def _write(self, docs: DataFrame, number: int) -> None:
        sized = docs.withColumn("_length", F.when(F.col("_deleted"), 0).otherwise(F.size(code_tokens(self.text))))
        sized.drop(self.text).write.mode("overwrite").parquet(f"{self.folder}/documents/segment={number}")
        self._bucketed(bm25.postings(docs.where(~F.col("_deleted")), self.id, self.text), f"{self.folder}/postings/segment={number}")

    def _bucketed(self, postings: DataFrame, path: str) -> None:
        # ranges of (bucket, term, id): a frequent term spreads over several tasks and files
        rows = postings.withColumn("bucket", bucket_of(F.col("term"), self.buckets)).repartitionByRange("bucket", "term", self.id)
        rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)

    # -- reading ----------------------------------------------------------------------------------------------------

    def _exists(self, part: str) -> bool:
        return exists(self.spark, f"{self.folder}/{part}")

    def _segments(self) -> int:
        return self._table("documents").agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0] if self._exists("documents") else -1

    def _table(self, part: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{part}").option("mergeSchema", "true").parquet(f"{self.folder}/{part}")

    def _without_dead(self, rows: DataFrame) -> DataFrame:
        if not self._exists("dead"):
            return rows
        # a segment's folder name is its own number; the replaced version's is a column of the files
        parts = [self.spark.read.parquet(f"{self.folder}/dead/segment={n}").select(F.col("segment").alias("_ds"), F.col(self.id).alias("_di")) for n in self._numbers("dead")]
        dead = reduce(DataFrame.unionByName, parts)
        return rows.join(dead, (F.col("segment") == F.col("_ds")) & (F.col(self.id) == F.col("_di")), "left_anti")

    def _numbers(self, part: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(int(s.getPath().getName().removeprefix("segment=")) for s in found if s.getPath().getName().startswith("segment="))

    def _live(self) -> DataFrame:
        return self._without_dead(self._table("documents"))

    def _postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._table("postings")
        if terms is not None:
            wanted = self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), self.buckets)).distinct().collect()
            rows = rows.where(F.col("bucket").isin(*(r[0] for r in wanted)) & F.col("term").isin(*terms))
        return self._without_dead(rows).drop("bucket")

    def documents(self) -> DataFrame:
        """The documents that the index holds: id, length and payload."""
        return self._live().where(~F.col("_deleted")).drop("_deleted", "_order", "segment").withColumnRenamed("_length", "length")

    def statistics(self) -> DataFrame:
        """One row: document_count and average_document_length."""
        return self.documents().agg(F.count(F.lit(1)).alias("document_count"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("average_document_length"))

    def term_frequencies(self) -> DataFrame:
        """term, df, cf of all terms."""
        return self._postings().groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def scored(self, query: str) -> DataFrame:
        """Every document that holds a term of the query: its payload and ``score``."""
        terms = bm25.query_terms(self.spark, query)
        docs = self.documents()
        if not terms:
            return docs.drop("length").withColumn("score", F.lit(0.0)).where(F.lit(False))
        repeats = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))
        found = self._postings(list(terms)).select(F.col(self.id).alias("_id"), "term", "tf")
        df = F.broadcast(found.groupBy("term").agg(F.count(F.lit(1)).alias("_df")))  # the query's terms
        stats = F.broadcast(self.statistics().select(F.col("document_count").alias("_n"), F.coalesce(F.nullif("average_document_length", F.lit(0.0)), F.lit(1.0)).alias("_mean")))  # one row
        hits = found.join(df, "term").join(docs, F.col("_id") == F.col(self.id)).crossJoin(stats)
        idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        part = idf * F.col("tf") * (bm25.K1 + 1) / (F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("length") / F.col("_mean")))
        payload = [c for c in docs.columns if c not in (self.id, "length")]
        return hits.groupBy(self.id).agg(*(F.first(c).alias(c) for c in payload), F.sum(F.element_at(repeats, F.col("term")) * part).alias("score"))

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """The ``top_k`` best documents by BM25, ties by id; nothing for a query without tokens."""
        positive("top_k", top_k)
        return self.scored(query).orderBy(F.desc("score"), F.asc(self.id)).limit(top_k)

    def search_symbols(self, query: str, top_k: int = 20, filters: dict | None = None, kind: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
        """Filtered search with the boost for exact names; statistics stay those of the whole index."""
        return bm25.boosted(self.scored(query), query, self.id, top_k, filters, kind, names)


def bucket_of(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")
