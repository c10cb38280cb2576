"""Publishing a stream in chunks to a sink that may be down: refused chunks go to a log of JSON lines, which a second stream replays once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Time stamps keep their microseconds in the log.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
BROKEN = "_broken_line"


class WriteAheadLog:
    """Rows that a sink refused, as JSON lines below a home, one folder per chunk.

    ``keep`` replaces the chunk's folder, so a batch that is repeated leaves one copy. ``replay`` is a stream over the files with a
    checkpoint: a file is sent once, also over many runs; if the sink is down again the run ends with its error, nothing of that batch
    counts as sent, and the next run tries it anew under the same name. Lines that are no JSON of the schema (a torn write)
    go to ``broken`` as they are, with the rest of their file being sent. A field that does not fit its type breaks its line.
    """

    def __init__(self, spark: SparkSession, home: str, schema: StructType):
        self.spark, self.home, self.schema = spark, home, schema

    def keep(self, name: str, rows: DataFrame) -> None:
        rows.select(F.to_json(F.struct(*self.schema.names), _TIMES).alias("value")).write.mode("overwrite").text(f"{self.home}/log/{name}")

    def replay(self, send: Callable[[DataFrame, str], None], files: int = 64) -> None:
        kind = StructType([*self.schema.fields, StructField(BROKEN, StringType())])
        lines = self.spark.readStream.schema(kind).options(columnNameOfCorruptRecord=BROKEN, maxFilesPerTrigger=files, **_TIMES).json(f"{self.home}/log/*")

        def each(df: DataFrame, k: int) -> None:
            df = df.persist()
            try:
                df.where(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("value")).write.mode("overwrite").text(f"{self.home}/broken/{k}")
                send(df.where(F.col(BROKEN).isNull()).drop(BROKEN), f"replay-{k}")
            finally:
                df.unpersist()

        lines.writeStream.option("checkpointLocation", f"{self.home}/replayed").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def publish(rows: DataFrame, home: str, send: Callable[[DataFrame, str], None], chunk: Column, chunks: int) -> WriteAheadLog:
    """Send a stream in chunks 0 to ``chunks`` - 1 of each batch; a chunk whose sending raises ConnectionError goes to the log.

    ``chunk`` numbers the rows; rows of another number or of none are in the last chunk. ``send(rows, name)`` must replace what it wrote
    under the same name, as a batch can come again. Other errors end the stream and leave the batch to the next run.
    """
    log = WriteAheadLog(rows.sparkSession, f"{home}/wal", rows.schema)

    def each(df: DataFrame, k: int) -> None:
        known = F.when(chunk.between(0, chunks - 1), chunk).otherwise(chunks - 1)
        df = df.withColumn("_chunk", known).persist()
        try:
            for c in range(chunks):
                part = df.where(F.col("_chunk") == c).drop("_chunk")
                try:
                    send(part, f"{k}-{c}")
                except ConnectionError:
                    log.keep(f"{k}-{c}", part)
        finally:
            df.unpersist()

    rows.writeStream.option("checkpointLocation", f"{home}/published").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return log
