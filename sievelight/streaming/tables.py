"""Tables that micro-batches keep current: the edit state, live counts, failures.

Each batch writes only its own folder ``v=<batch id>``, replacing it when the
batch runs again, and reads only finished folders before it. A batch that is lost and
replayed therefore gives the same table, and a read during a batch sees the table before it.
"""

from __future__ import annotations

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.schema import PICKS
from sievelight.sources.places import place_of
from sievelight.streaming.edits import fold_edits, merge_states


def finished_versions(root: str, before: int | None = None) -> list[int]:
    """Numbers of the version folders under ``root`` that their batch has finished, ascending."""
    store, inner = place_of(root)
    found = store.get_file_info(FileSelector(inner, allow_not_found=True))
    versions = [int(f.base_name[2:]) for f in found if f.type == FileType.Directory and f.base_name.startswith("v=")]
    return sorted(v for v in versions if (before is None or v < before)
                  and store.get_file_info(f"{inner.rstrip('/')}/v={v}/_SUCCESS").type == FileType.File)


def read_versions(spark: SparkSession, root: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows of finished versions under ``root`` with their ``v``; no rows when nothing is there yet."""
    full = T.StructType([*schema.fields, T.StructField("v", T.LongType())])
    done = finished_versions(root, before)
    if not done:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", root).parquet(*[f"{root.rstrip('/')}/v={v}" for v in done])


class StateTable:
    """Current pick and metadata per path, kept in ``buckets`` by a hash of the path.

    A batch rewrites only the buckets it touches, as a new version; the newest
    version of a bucket is its content. Choose ``buckets`` so that one is a few
    hundred MB; a table keeps the number it began with. Live counts are kept as
    differences, so no batch recounts the table. A read opens the newest folder
    of each bucket only, and ``vacuum`` deletes the older ones.
    """

    def __init__(self, spark: SparkSession, root: str, edits: T.StructType, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        part = lambda name: T.StructType([T.StructField("seq", T.LongType()), T.StructField("value", edits[name].dataType)])
        self.schema = T.StructType([
            T.StructField("path", edits["path"].dataType),
            *[T.StructField(p, part(p)) for p in ("pick", "keywords", "fields")],
            T.StructField("bucket", T.IntegerType()),
        ])
        store, inner = place_of(self.root)
        store.create_dir(inner, recursive=True)
        named = [f.base_name for f in store.get_file_info(FileSelector(inner)) if f.base_name.startswith("buckets=")]
        if named and named != [f"buckets={buckets}"]:
            raise ValueError(f"this table was made with {named[0]}")
        store.create_dir(f"{inner}/buckets={buckets}")
        self.counts_schema = T.StructType([T.StructField("pick", T.StringType()), T.StructField("delta", T.LongType())])

    def _folders(self, before: int | None) -> tuple[list[str], list[str]]:
        """The newest finished folder of each bucket, and the older ones."""
        store, inner = place_of(f"{self.root}/state")
        newest: dict[str, int] = {}
        found = []
        for v in finished_versions(f"{self.root}/state", before):
            for folder in store.get_file_info(FileSelector(f"{inner}/v={v}")):
                if folder.base_name.startswith("bucket="):
                    found.append((v, folder.base_name, folder.path))
                    newest[folder.base_name] = max(v, newest.get(folder.base_name, v))
        keep = [f"{self.root}/state/v={v}/{b}" for v, b, _ in found if newest[b] == v]
        return keep, [path for v, b, path in found if newest[b] != v]

    def _newest(self, before: int | None) -> DataFrame:
        folders, _ = self._folders(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.root}/state").parquet(*folders).select(self.schema.fieldNames())

    def read(self) -> DataFrame:
        return self._newest(None).drop("bucket")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink for a stream of edits."""
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        fresh = fold_edits(batch).withColumn("bucket", bucket)
        touched = fresh.select("bucket").distinct()
        old = self._newest(batch_id).join(F.broadcast(touched), "bucket", "left_semi")
        merged = merge_states(old.drop("bucket").unionByName(fresh.drop("bucket"))).withColumn("bucket", bucket)
        home = f"{self.root}/state/v={batch_id}"
        # A bucket's rows go to a few files of their own, not to one per shuffle partition.
        spread = F.pmod(F.xxhash64("path"), F.lit(4))
        merged.repartition(F.col("bucket"), spread).write.mode("overwrite").partitionBy("bucket").parquet(home)
        new = self.spark.read.schema(self.schema).parquet(home)
        gone = self._newest(batch_id).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
        pick = F.coalesce("pick.value", F.lit("Unmarked")).alias("pick")
        delta = new.select(pick, F.lit(1).alias("d")).unionByName(gone.select(pick, F.lit(-1).alias("d")))
        delta.groupBy("pick").agg(F.sum("d").alias("delta")).write.mode("overwrite").parquet(f"{self.root}/counts/v={batch_id}")

    def vacuum(self) -> int:
        """Delete the buckets that a newer finished version has replaced; how many. Call it between batches."""
        store, _ = place_of(self.root)
        newest, old = self._folders(None)
        for folder in old:
            store.delete_dir(folder)
        return len(old)

    def live_counts(self) -> DataFrame:
        """all, picked, rejected, unmarked over every path with an edit."""
        rows = read_versions(self.spark, f"{self.root}/counts", self.counts_schema)
        total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("delta"))), F.lit(0))
        return rows.agg(total(F.lit(True)).alias("all"), *[total(F.col("pick") == p).alias(p.lower())
                                                          for p in (PICKS[1], PICKS[2], PICKS[0])])


class LateRows:
    """A stream split in two tables: rows on time, and rows behind the watermark, which stateful operators drop.

    The watermark of a batch is the newest time of the batches before it less ``delay_ms``, as Spark's own. The
    newest time of each batch is a one-row table, so a batch that runs again, or after a restart, splits alike.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, delay_ms: int, time: str = "ts"):
        self.spark, self.root, self.schema, self.delay_ms, self.time = spark, root.rstrip("/"), schema, delay_ms, time
        self.newest = T.StructType([T.StructField("us", T.LongType())])

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink for all rows of a stream."""
        seen = read_versions(self.spark, f"{self.root}/newest", self.newest, batch_id).agg(F.max("us")).first()[0]
        us = F.unix_micros(self.time)
        late = F.coalesce(us < (seen - self.delay_ms * 1000), F.lit(False)) if seen is not None else F.lit(False)
        batch.where(~late).write.mode("overwrite").parquet(f"{self.root}/on_time/v={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{self.root}/late/v={batch_id}")
        batch.agg(F.max(us).alias("us")).write.mode("overwrite").parquet(f"{self.root}/newest/v={batch_id}")

    def on_time(self) -> DataFrame:
        return read_versions(self.spark, f"{self.root}/on_time", self.schema).drop("v")

    def late(self) -> DataFrame:
        return read_versions(self.spark, f"{self.root}/late", self.schema).drop("v")


class FailureLedger:
    """Every failed row of a results stream, and counts of them."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink for rows with an ``ok`` flag."""
        batch.where(~F.col("ok")).write.mode("overwrite").parquet(f"{self.root}/v={batch_id}")

    def read(self) -> DataFrame:
        return read_versions(self.spark, self.root, self.schema).drop("v")

    def counts(self, by: list[str]) -> DataFrame:
        return self.read().groupBy(*by).agg(F.count(F.lit(1)).alias("failures"))
