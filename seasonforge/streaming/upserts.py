"""Upserts of a stream into a table that a replayed batch leaves as it is.

The table is dealt to buckets by its keys.  A batch writes new versions of the buckets that it touches, under
its own number, and is then recorded as committed.  Readers take the last committed version of each bucket, so
a batch that failed half-way is not seen, and the same batch run again writes the same versions again.  A table
has one stream: its batch numbers go on as long as the stream's checkpoint is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class UpsertTable:
    """A table at ``path`` with one row for each key; of several rows the one with the greatest ``order`` stays (ties: by all columns)."""

    path: str
    keys: tuple[str, ...]
    order: str
    schema: StructType
    buckets: int = 16

    def _list(self, spark: SparkSession, folder: str, part: str) -> dict[int, object]:
        """Folders ``part=number`` below a folder of the table, by number."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return {int(p.getName().partition("=")[2]): p for p in found if p.getName().startswith(f"{part}=")}

    def vacuum(self, spark: SparkSession, keep: int = 100) -> int:
        """Deletes what no reader of the last ``keep`` batches needs: older marks, and versions of a bucket that newer ones replace.

        Gives the number of deleted folders.  The last mark and the last version of each bucket always stay.
        """
        marks = self._list(spark, "commits", "batch")
        if not marks:
            return 0
        oldest = sorted(marks)[-keep:][0]  # readers may be as far behind
        gone, needed = [], set()
        for bucket in self._list(spark, "data", "bucket"):
            versions = self._list(spark, f"data/bucket={bucket}", "version")
            first = max((v for v in versions if v <= oldest and v in marks), default=-1)  # what the oldest reader sees
            gone += [p for v, p in versions.items() if v < first]
            needed |= {v for v in versions if v >= first}
        gone += [p for b, p in marks.items() if b < oldest and b not in needed]  # a version is seen by its mark
        for p in gone:
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return len(gone)

    def _stored(self, spark: SparkSession, folder: str, schema: str | StructType, parts: str) -> DataFrame | None:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return None
        base = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        full = StructType([*base.fields, *StructType.fromDDL(parts).fields])
        return spark.read.schema(full).parquet(f"{self.path}/{folder}")

    def committed(self, spark: SparkSession) -> list[int]:
        """Numbers of the committed batches."""
        d = self._stored(spark, "commits", "size long", "batch long")
        return [] if d is None else sorted(r.batch for r in d.select("batch").distinct().collect())

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows as of the last committed batch (or the last one before a batch)."""
        done = [b for b in self.committed(spark) if before is None or b < before]
        d = self._stored(spark, "data", self.schema, "bucket int, version long") if done else None
        if d is None:
            return spark.createDataFrame([], self.schema)
        d = d.where(F.col("version").isin(done))
        last = d.select("bucket", "version").groupBy("bucket").agg(F.max("version").alias("version"))  # a row for each bucket
        return d.join(F.broadcast(last), ["bucket", "version"]).select(*self.schema.names)

    def _bucket(self, d: DataFrame) -> DataFrame:
        return d.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a batch; to be given to ``foreachBatch``.  A committed batch is skipped."""
        spark = batch.sparkSession
        if batch_id in self.committed(spark):
            return
        names = self.schema.names
        rest = [c for c in names if c not in (*self.keys, self.order)]
        new = self._bucket(batch.select(*names))
        touched = new.select("bucket").distinct()  # as many rows as buckets
        old = self._bucket(self.read(spark, before=batch_id)).join(F.broadcast(touched), "bucket", "left_semi")
        best = F.max(F.struct(self.order, *rest)).alias("_b")
        merged = old.unionByName(new).groupBy("bucket", *self.keys).agg(best).select("bucket", *[F.col(c) if c in self.keys else F.col(f"_b.{c}").alias(c) for c in names])
        out = merged.withColumn("version", F.lit(batch_id).cast("long")).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{self.path}/data")
        self._commit(spark, batch_id)

    def _commit(self, spark: SparkSession, batch_id: int) -> None:
        spark.range(1).select(F.col("id").alias("size")).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch_id}")

    def start(self, rows: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs the stream ``rows`` into the table."""
        return rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
