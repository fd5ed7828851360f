"""Exact deduplication by a persistent digest index.

The index is a table bucketed and sorted by digest with one row for each distinct text. A batch is
reduced to one row a digest, what the index holds is taken away by a sort-merge anti-join on the
buckets, and the rest is appended. Everything is made of DataFrame operations.

Defined results: a null text counts as empty, so null and empty texts are copies of each other; runs of
ASCII white space count as one space; of equal texts the smallest id stays, null ids only if there is no
other; repeated rows (same id, same text) count in ``group_size`` and share one fate; empty tables give
empty results. Of the input only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.workdir import Work, delete, tidy

#: A digest of more than one in so many of all rows counts as hot; there are at most so many.
HOT = 1024
SPACE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalized(text), 256))


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many digests: about a million in each."""
    return max(8, -(-rows // 1_000_000))


class DigestIndex:
    """Digests of all texts seen so far: ``digest, keep_id, group_size, batch``, bucketed and sorted by digest.

    ``name`` is the table's name in the catalog; ``path`` keeps its files where a later session finds them.
    A name that exists is opened, and keeps its number of buckets; a new one gets ``buckets`` (see ``buckets_for``).
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if spark.catalog.tableExists(name):
            told = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").select("data_type").first()
            self.buckets = int(told[0]) if told else buckets
        else:
            self._create(name, path)

    def _create(self, name: str, path: str | None) -> None:
        place = f" LOCATION '{path}'" if path else ""
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{place}"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str) -> None:
        with tidy(self.spark):
            (
                rows.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest")
                .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
            )
        self.spark.catalog.refreshTable(name)

    def add(self, found: DataFrame, batch: str | None = None) -> str:
        """Append what is new in ``found`` (digest, keep_id, group_size; one row a digest); returns the batch's name.

        Digests that stand in the index are not entered again, so a batch that is run again under its
        name after a failure finds its own rows and adds nothing.
        """
        batch = batch or uuid.uuid4().hex
        self._append(found.join(self.table().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch)), self.name)
        return batch

    def compact(self) -> None:
        """Rewrite each bucket as one sorted file, when many batches were appended.

        The new files are written beside the old ones; then the table's location is switched in one step of the
        catalog, and only then the old files go. A crash before the switch leaves the table as it was.
        """
        of = lambda: self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").first()["data_type"]
        old, spare = of(), f"{self.name}_{uuid.uuid4().hex[:8]}"
        new = f"{re.sub('-compact-[0-9a-f]{8}$', '', old.rstrip('/'))}-compact-{uuid.uuid4().hex[:8]}"
        self._create(spare, new)
        self._append(self.table(), spare)
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION '{new}'")
        self.spark.catalog.refreshTable(self.name)
        self.spark.sql(f"DROP TABLE {spare}")  # its files stay: it names a location
        delete(self.spark, old)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    With an ``index`` that has seen earlier batches, a text that stands there keeps its old ``keep_id``,
    so none of its new copies is kept; ``group_size`` counts the copies of the batch that brought it, and
    for old texts those of the present batch too are not added (the index is append-only). A ``batch`` that
    is run again under its name gives the same result as the first time.

    A digest of more than one in ``HOT`` of all rows is joined by a broadcast of at most ``HOT`` such digests,
    so its rows stay where they are; the others by a merge join on the buckets.
    """
    work = Work(spark, "exact")
    seen = work.write(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")), "digests")
    found = work.write(seen.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "found")
    sums = found.agg(F.coalesce(F.sum("group_size"), F.lit(0)), F.count(F.lit(1))).first()
    own = index is None
    if index is None:
        index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", f"{work.path}/index", buckets_for(sums[1]))
    batch = index.add(found, batch)
    hot = F.broadcast(found.where(F.col("group_size") * HOT > sums[0]).select("digest"))
    held = index.table().select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("new"))
    cold = seen.join(hot, "digest", "left_anti").join(held.hint("merge"), "digest")
    out = cold.unionByName(seen.join(F.broadcast(held.join(hot, "digest", "left_semi")), "digest")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    out = work.write(out, "result")
    if own:
        index.drop()
    work.drop("digests", "found")
    return out


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Repeated rows of one id and text stay once. Rows without an id all stay: no decision can name them.
    """
    marks = exact_dedup(spark, docs.where(F.col(id_col).isNotNull()), None, id_col, text_col).where("kept").select(F.col("doc_id").alias("__keep")).distinct()
    kept = docs.join(marks, docs[id_col] == marks["__keep"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
