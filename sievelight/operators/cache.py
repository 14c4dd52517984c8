"""The metadata cache: a table keyed by path, valid for one size and mtime."""

from __future__ import annotations

from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators.lanes import Lanes, group_sum, position, running, total
from sievelight.schema import CACHE, CACHE_VERSION
from sievelight.session import stored
from sievelight.sources.places import place_of


def readable_json(text: Column, ddl: str) -> Column:
    """True when ``text`` parses; a damaged payload must read as a miss."""
    parsed = F.from_json(text, f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return F.coalesce(parsed.isNotNull() & parsed["_corrupt"].isNull(), F.lit(False))


def cache_split(frames: DataFrame, cache: DataFrame, readable: Column | None = None,
                version: int = CACHE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(hits, misses). A hit matches path, size and mtime; NULL mtime never does."""
    usable = cache.where(F.col("schema_version") == version)
    if readable is not None:
        usable = usable.where(readable)
    keys = ["path", "size", "mtime_ns"]
    hits = frames.join(usable.select(*keys, "capture"), keys)
    misses = frames.join(usable.select(*keys), keys, "left_anti")
    return hits, misses


def upsert_cache(cache: DataFrame, fresh: DataFrame, hits: DataFrame, now: int,
                 version: int = CACHE_VERSION) -> DataFrame:
    """The next cache table: fresh rows replace, hits count as used now.

    A row without mtime is never stored. A file whose metadata failed is stored
    with NULL ``capture``, so it is not read again.
    """
    new = fresh.where(F.col("mtime_ns").isNotNull()).withColumns(
        {"last_used": F.lit(now).cast("bigint"), "schema_version": F.lit(version)}
    )
    used = hits.select("path").distinct().withColumn("_hit", F.lit(True))
    old = (
        cache.where(F.col("schema_version") == version)
        .join(new.select("path"), "path", "left_anti").join(used, "path", "left")
        .withColumn("last_used", F.when(F.col("_hit"), F.lit(now).cast("bigint")).otherwise(F.col("last_used")))
    )
    return old.select(*cache.columns).unionByName(new.select(*cache.columns))


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """The cache table under ``root``; without rows while there is none."""
    store, inner = place_of(root)
    if store.get_file_info(inner).type != FileType.Directory:
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(T.StructType([*CACHE.fields, T.StructField("bucket", T.IntegerType())])).parquet(root).where(
        "path IS NOT NULL").select(CACHE.fieldNames())


def save_cache(spark: SparkSession, root: str, fresh: DataFrame, hits: DataFrame, now: int, version: int = CACHE_VERSION, buckets: int = 64) -> None:
    """``upsert_cache`` into the table under ``root``: only partitions with fresh rows or hits are written again.

    The table is both read and replaced. Dynamic overwrite writes beside it and moves each partition when all tasks are done,
    so a job that fails leaves the old rows. ``fresh`` and ``hits`` must not be computed from the table any more (write them first). Each written partition
    has one row without a path, which replaces a partition that has become empty. A table keeps its number of ``buckets``.
    """
    bucket = _bucket(F.col("path"), buckets)
    touched = fresh.where("mtime_ns IS NOT NULL").select("path").unionByName(hits.select("path")).select(bucket.alias("bucket")).distinct()
    old = read_cache(spark, root).withColumn("bucket", bucket).join(F.broadcast(touched), "bucket", "left_semi").select(CACHE.fieldNames())
    rows = upsert_cache(old, fresh, hits, now, version).withColumn("bucket", bucket)
    marks = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE.fields], "bucket")
    # Another hash than the bucket's: the rest of the same one is fixed by the bucket wherever it divides their number.
    share = max(4, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets))
    out = rows.select(*CACHE.fieldNames(), "bucket").unionByName(marks).repartition("bucket", F.pmod(F.hash("path"), F.lit(share)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(root)
    spark.catalog.refreshByPath(root)


def stored_bytes(cache: DataFrame, size: str = "payload_bytes", by: list[str] = ()) -> DataFrame:
    return cache.groupBy(*by).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def lru_evict(cache: DataFrame, cap: int, round_size: int = 64, pinned: Column | None = None,
              size: str = "payload_bytes", used: str = "last_used", path: str = "path") -> DataFrame:
    """Add ``evict``: the least recently used rows that bring the total to ``cap``.

    Rows leave in whole rounds of ``round_size``. With ``pinned``, that row never
    leaves, rounds are single rows and one row always stays.

    A row is due when the rows from it on still exceed the cap; due rows are a prefix of the oldest-first order, so counting
    them gives the last round. Bytes and rows are added up per time of use, and only the rows of the time where the
    prefix ends are put in order. With ``pinned`` the order is one global lane, whose sums run in slices.
    """
    if pinned is not None:
        return _evict_around(cache, cap, pinned, size, used, path)
    times = stored(cache.groupBy(used).agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "times-of-use")
    excess = (times.agg(F.sum("_bytes")).first()[0] or 0) - cap
    if excess <= 0:
        return cache.withColumn("evict", F.lit(False))
    sums = Lanes(times, [], [used]).scan(_past=running(F.col("_bytes")), _upto=running(F.col("_rows"))).rows()
    sums = stored(sums.select(F.col(used).alias("_time"), (F.col("_past") - F.col("_bytes")).alias("_before"), "_past",
                              (F.col("_upto") - F.col("_rows")).alias("_older"), "_upto"), "oldest-first")

    def ranked(time) -> DataFrame:
        """The rows of one time of use in the order of their paths."""
        rows = cache.where(F.col(used).eqNullSafe(F.lit(time)))
        return Lanes(rows, [], [path]).scan(_at=position(), _sum=running(F.coalesce(F.col(size), F.lit(0)))).rows()

    last = sums.where((F.col("_before") < excess) & (F.col("_past") >= excess)).first()
    bytes_before = F.lit(last["_before"]) + F.col("_sum") - F.coalesce(F.col(size), F.lit(0))
    due = last["_older"] + ranked(last["_time"]).agg(F.count_if(bytes_before < excess)).first()[0]
    leaving = -(-due // round_size) * round_size
    end = sums.where((F.col("_older") < leaving) & (F.col("_upto") >= leaving)).first()
    if end is None:  # the last round takes all that is left
        return cache.withColumn("evict", F.lit(True))
    older = F.lit(False) if end["_time"] is None else F.col(used).isNull() | (F.col(used) < F.lit(end["_time"]))
    others = cache.where(~F.col(used).eqNullSafe(F.lit(end["_time"]))).withColumn("evict", older)
    border = ranked(end["_time"]).withColumn("evict", F.col("_at") <= leaving - end["_older"])
    return others.unionByName(border.drop("_at", "_sum"))


def _evict_around(cache: DataFrame, cap: int, pinned: Column, size: str, used: str, path: str) -> DataFrame:
    bytes_ = F.coalesce(F.col(size), F.lit(0))
    lane = Lanes(cache.withColumn("_pinned", F.coalesce(pinned, F.lit(False))), [], ["_pinned", used, path]).scan(
        _at=position(), _rows=total(), _sum=running(bytes_), _bytes=group_sum(bytes_))
    due = F.col("_bytes") - (F.col("_sum") - bytes_) > cap
    lane = lane.with_columns(evict=due & ~F.col("_pinned") & (F.col("_at") < F.col("_rows")))
    return lane.rows("_pinned", "_at", "_rows", "_sum", "_bytes")
