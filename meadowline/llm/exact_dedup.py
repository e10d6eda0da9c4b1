"""Exact deduplication as a stateful stream over document digests.

Each added table is scanned once for ``(digest, doc_id, length, file, position)``; these narrow rows are appended to a log in
the shared folder, and a streaming aggregation keyed by digest keeps, in a RocksDB state store without expiry, the document
that stays, how many there are and where its content lies: the Parquet file, the row's position in it and the text's length.
What changes in the state goes to an index table by batch. A digest with more than one row is a hit; hits are confirmed on
their full normalised bytes, and digests under which different texts met are grouped again by the texts themselves. Hits are
fetched by their places: a scan that is sent bits of them passes their rows on, and no body without a copy is ever shuffled,
however many hits there are. Bodies are added up by (digest, body) before they are shuffled, so copies of one text do not meet
in one task.

Defined results: null text counts as empty, so null and blank texts are copies of each other. A null ``doc_id`` loses ties
against any other. Repeated rows count as copies, and ``exact_dedup`` and ``stay`` keep one row of each group whether ids are
null, repeated or unique; ``resolve`` of tables added over time goes by ``doc_id`` alone. An empty table gives no rows. Other
columns are ignored, whatever their names, and kept by ``stay``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadowline.llm.common import documents, located, materialize, rows_at, shared_dir

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store reserves megabytes of disk, however small
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}
#: The row that stays: the longest text, then the smallest id (its complement does not overflow), null last, then any one place.
_ORDER = "struct(n, ~coalesce(doc_id, 9223372036854775807L) AS rank, doc_id, file, position)"


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


class StreamingDeduplicator:
    """Deduplicates tables added over time; ``folder`` holds log, state and index, and can be opened again later."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256):
        self.spark, self.folder, self.digest = spark, folder or shared_dir(spark), digest

    def _fingerprints(self, docs: DataFrame) -> DataFrame:
        """Narrow rows: digest, doc_id, length, place."""
        docs, file, position = located(docs)
        text = F.coalesce(F.col("text"), F.lit(""))
        return docs.select(self.digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), file.alias("file"), position.alias("position"))

    def add(self, docs: DataFrame) -> None:
        """Append a table to the log and bring the state up to date. Survives restarts: the log and the stream's checkpoint are written before anything is read from them."""
        log, index = f"{self.folder}/log", f"{self.folder}/index"
        prints = self._fingerprints(docs)
        prints.write.mode("append").parquet(log)
        session = self.spark.newSession()  # the state store's settings touch no other query
        for k, v in {**STATE_CONF, "spark.sql.shuffle.partitions": self.spark.conf.get("spark.sql.shuffle.partitions")}.items():
            session.conf.set(k, v)

        def publish(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{index}/batch={batch:08d}")

        query = (
            session.readStream.schema(prints.schema)
            .parquet(log)
            .groupBy("digest")
            .agg(F.max(F.expr(_ORDER)).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "best", "group_size")
            .writeStream.outputMode("update")
            .foreachBatch(publish)
            .option("checkpointLocation", f"{self.folder}/state")
            .trigger(availableNow=True)
            .queryName(f"dedup_{uuid.uuid4().hex}")
            .start()
        )
        query.awaitTermination()

    def index(self) -> DataFrame:
        """One row per digest: ``best`` (length, id and place of the row that stays) and group_size, as of the last batch that changed it."""
        schema = "digest string, best struct<n:long,rank:long,doc_id:long,file:string,position:long>, group_size long, batch int"
        # A group only grows, so its newest state is its largest.
        return self.spark.read.schema(schema).parquet(f"{self.folder}/index").groupBy("digest").agg(F.max(F.struct("group_size", "best")).alias("s")).select("digest", "s.best", "s.group_size")

    def _hits(self) -> DataFrame:
        return materialize(self.index().where("group_size > 1"))

    def _bodies(self, docs: DataFrame, rows: DataFrame) -> DataFrame:
        """digest, body and place of those rows of ``docs``, alone fetched by their places."""
        docs, file, position = located(docs)
        text = normalised(F.col("text"))
        return rows_at(docs, file, position, rows, [self.digest(text).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n"), file.alias("file"), position.alias("position"), text.alias("body")])

    def collisions(self, docs: DataFrame, hits: DataFrame | None = None, prints: DataFrame | None = None) -> DataFrame:
        """Digests of hits under which different normalised texts met, by full comparison of the hits' bytes. Bodies without a
        copy are not moved; the others are added up within tasks first."""
        docs, *_ = located(docs)
        hits, prints = self._hits() if hits is None else hits, materialize(self._fingerprints(docs)) if prints is None else prints
        met = self._bodies(docs, prints.join(hits.select("digest"), "digest", "left_semi")).select("digest", "body").distinct()
        return met.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("digest")

    def _resolved(self, docs: DataFrame) -> DataFrame:
        """digest, doc_id, n, file, position of each row with its group's ``best`` and ``group_size`` (null: no copy)."""
        hits = self._hits()
        prints = materialize(self._fingerprints(docs))
        bad = materialize(self.collisions(docs, hits, prints))
        if bad.isEmpty():
            return prints.join(hits, "digest", "left")
        # Equal digests of different texts: these groups are formed by the texts.
        odd = materialize(self._bodies(docs, prints.join(bad, "digest", "left_semi")))
        best = odd.groupBy("body").agg(F.max(F.expr(_ORDER)).alias("best"), F.count(F.lit(1)).alias("group_size"))
        rest = prints.join(bad, "digest", "left_anti").join(hits, "digest", "left")
        return odd.join(best, "body").select(*rest.columns).unionByName(rest)

    def resolve(self, docs: DataFrame, by_place: bool = False) -> DataFrame:
        """One row per document of ``docs`` (all rows added so far): doc_id, keep_id, group_size, kept, text_sha256. With
        ``by_place``, for the very files that were added, exactly one row of each group is kept."""
        docs, file, position = located(docs)
        stays = F.expr("group_size IS NULL OR file = best.file AND position = best.position") if by_place else F.expr("group_size IS NULL OR doc_id <=> best.doc_id")
        keep = F.when(F.col("group_size").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc_id"))
        found, sha = self._resolved(docs), F.col("digest")
        if self.digest is not sha256:
            found = found.join(docs.select(file.alias("file"), position.alias("position"), sha256(normalised(F.col("text"))).alias("sha")), ["file", "position"])
            sha = F.col("sha")
        return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), sha.alias("text_sha256"))

    def stay(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs``, which was added as a whole, that stay: one of each group, with all columns. The others are left
        out by their places while the table is read again."""
        docs, file, position = located(docs)
        gone = self._resolved(docs).where("group_size IS NOT NULL AND NOT (file = best.file AND position = best.position)").select("file", "position")
        return rows_at(docs, file, position, gone, [docs[c] for c in docs.columns], inside=False)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs, *_ = located(docs)
    dedup = StreamingDeduplicator(docs.sparkSession)
    dedup.add(docs)
    return dedup.resolve(docs, by_place=True)


def stay(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all columns."""
    docs, *_ = located(docs)
    dedup = StreamingDeduplicator(docs.sparkSession)
    dedup.add(docs)
    return dedup.stay(docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY body ORDER BY length(t) DESC, doc_id)
"""
