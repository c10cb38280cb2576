"""A set of hashes that grows from run to run: what a batch has that was not seen before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.stored import folders


class SeenSet:
    """Stored hashes, one folder per batch, behind a Bloom filter of fixed size.

    The filter has 2^``bits`` bits (16 MB at 27) as bitmaps of 4 KB, built and merged by Spark's bitmap aggregates; its size is
    bound by that parameter, so it is broadcast. Two bits stand for a hash. A hash with a clear bit is new; the others are
    looked up among the stored ones, where the few that may be known are the small side, so the stored hashes are read
    but not shuffled. A full filter lets all through to that lookup: slower, with the same result.
    Of equal hashes in a batch the row of least order is new. A batch that comes again gives the same rows, as
    only batches with smaller numbers count as seen; batches are numbered in the order they come. Rows without a hash are left out.
    """

    def __init__(self, spark: SparkSession, path: str, bits: int = 27):
        self.spark, self.path, self.slots = spark, path, 1 << bits

    def _slot(self, hash_: str, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(i), F.col(hash_)), F.lit(self.slots))

    def _before(self, batch: int, part: str) -> list[str]:
        return [f"{self.path}/{part}/batch={k}" for k in sorted(map(int, folders(self.spark, f"{self.path}/{part}", "batch"))) if k < batch]

    def _bitmaps(self, hashes: DataFrame) -> DataFrame:
        slots = hashes.select(F.explode(F.array(self._slot("hash", 0), self._slot("hash", 1))).alias("slot"))
        return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))

    def _may_be_known(self, rows: DataFrame, filter_: DataFrame, hash_: str) -> DataFrame:
        """rows with _known: are both of the hash's bits set?"""
        for i in (0, 1):
            slot = self._slot(hash_, i)
            bits = F.broadcast(filter_.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
            at = F.bitmap_bit_position(slot).cast("int")
            byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            is_set = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))
            rows = rows.join(bits, F.bitmap_bucket_number(slot) == F.col("_bucket"), "left").withColumn(f"_bit{i}", is_set).drop("_bucket", "_bitmap")
        return rows.withColumn("_known", F.col("_bit0") & F.col("_bit1")).drop("_bit0", "_bit1")

    def add(self, batch: int, rows: DataFrame, hash_: str, order: list[str]) -> DataFrame:
        """The rows of a batch whose hash was not seen before, written and read back; their hashes are seen from now on."""
        first = rows.where(F.col(hash_).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(hash_).orderBy(*order))).where("_i = 1").drop("_i")
        known, filters = self._before(batch, "new"), self._before(batch, "filter")
        if known:
            told = self._may_be_known(first, self.spark.read.parquet(filters[-1]), hash_)
            stored = self.spark.read.parquet(*known).select(F.col(hash_).alias("_hash"))
            met = stored.join(told.where("_known").select(F.col(hash_).alias("_asked")), F.col("_hash") == F.col("_asked"), "left_semi")
            first = told.join(met, (F.col(hash_) == F.col("_hash")) & F.col("_known"), "left_anti").drop("_known")
        new = f"{self.path}/new/batch={batch}"
        first.write.mode("overwrite").parquet(new)
        added = self.spark.read.schema(first.schema).parquet(new)
        bitmaps = self._bitmaps(added.select(F.col(hash_).alias("hash")))
        if filters:
            both = self.spark.read.parquet(filters[-1]).unionByName(bitmaps)
            bitmaps = both.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        bitmaps.write.mode("overwrite").parquet(f"{self.path}/filter/batch={batch}")
        return added
