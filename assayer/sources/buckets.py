"""Tables whose rows lie in buckets by a hash of their id, replaced id by id.

A folder holds one subfolder per bucket, whatever the number of rows or ids. A
replacement rewrites the buckets of the ids that it holds and no others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .shared import exists, mark, materialise, quoted, remove

BUCKET = "bucket"
SMALL = {"compression": "zstd"}  # tables of texts, written several times over


@dataclass
class BucketTable:
    """``schema`` holds ``key`` and has no column named ``bucket``; ``buckets`` must not change once rows are stored."""

    spark: SparkSession
    folder: str
    schema: StructType
    key: str
    buckets: int = 64
    format: str = "parquet"

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        """All rows with their bucket, an empty table where nothing is stored yet."""
        shape = StructType([*self.schema.fields]).add(BUCKET, IntegerType())
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).format(self.format).load(self.folder)

    def rows(self) -> DataFrame:
        return self.stored().drop(BUCKET)

    def of(self, ids: DataFrame) -> DataFrame:
        """Rows of the ids in ``ids (key)``; only their buckets are read where the plan can tell them at run time."""
        wanted = ids.select(F.col(self.key).alias("__id")).distinct().withColumn("__bucket", self.bucket_of(F.col("__id")))
        return self.stored().join(wanted, self._same(), "left_semi").drop(BUCKET)

    def _same(self) -> Column:
        return (F.col(BUCKET) == F.col("__bucket")) & F.col(self.key).eqNullSafe(F.col("__id"))

    def replace(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Store ``rows`` in place of all stored rows of their ids, and of the ids in ``gone (key)``.

        A missing id is an id like any other. New rows and those that stay are each written once before
        the first bucket changes, so a failed replacement can be run again, and running one
        twice changes nothing.
        """
        bucket = self.bucket_of(F.col(self.key))
        fresh = self.written(rows.select(*quoted(self.schema.names)).withColumn(BUCKET, bucket), "fresh")
        ids = fresh.select(F.col(self.key).alias("__id"), F.col(BUCKET).alias("__bucket"))
        if gone is not None:
            ids = ids.union(self.written(gone.select(F.col(self.key).alias("__id"), bucket.alias("__bucket")), "gone"))
        ids = self.written(ids.distinct(), "ids")
        touched = [r["__bucket"] for r in ids.select("__bucket").distinct().collect()]  # one number per bucket at most
        if not touched:
            return
        stored = self.stored().where(F.col(BUCKET).isin(touched)).join(ids, self._same(), "left_anti")
        after = self.written(stored.select(*quoted([*self.schema.names, BUCKET])), "kept").unionByName(fresh)
        full = {r[BUCKET] for r in after.select(BUCKET).distinct().collect()}
        out = after.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET)
        out.options(**(SMALL if self.format == "parquet" else {})).format(self.format).save(self.folder)
        for b in touched:
            if b not in full:
                remove(self.spark, f"{self.folder}/{BUCKET}={b}")

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        """Written, and read by this table's session: a stream's batches come in sessions of their own."""
        return materialise(rows, name, self.spark, **SMALL)

    def once(self, batch: int, rows: DataFrame, gone: DataFrame | None = None) -> bool:
        """``replace``, unless a batch of this number is stored already; tells whether it was new."""
        sign = f"{self.folder}/_batches/{batch}"
        if exists(self.spark, sign):
            return False
        self.replace(rows, gone)
        mark(self.spark, sign)
        return True
