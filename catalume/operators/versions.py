"""I2, I3 as a stored table: the catalog by buckets of directories, of which a change rewrites those it touches.

Files of one directory are in one bucket, so a listing of changed directories needs only
their buckets: these are read, brought up to date and written over; all others keep their files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import durable
from .snapshot import upsert_files

COLUMNS = ("dir", "filename", "size", "ctime", "mtime", "metadata_scanned_at", "content_hash", "file_id")


def bucket_of(directory: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(directory), F.lit(buckets)).cast("int")


def _write(files: DataFrame, path: str, mode: str) -> None:
    laid = files.repartition("bucket").sortWithinPartitions("bucket", "dir", "filename")
    laid.write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode(mode).parquet(path)


def create(files: DataFrame, path: str, buckets: int = 256) -> None:
    """Writes the first version of the table. ``files`` has :data:`COLUMNS`."""
    _write(files.select(*COLUMNS).withColumn("bucket", bucket_of(F.col("dir"), buckets)), path, "overwrite")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_listing(spark: SparkSession, path: str, listing: DataFrame, removed_dirs: DataFrame, buckets: int = 256) -> list[int]:
    """Brings the stored table up to date with the ``listing`` of changed directories and gives the buckets that were rewritten.

    ``listing(dir, filename, size, ctime, mtime)`` is complete for each directory it names, and
    ``removed_dirs(dir)`` lose all their files. Ids, stamps and hashes are kept as :func:`upsert_files`
    does. New rows are written beside the table before any bucket is replaced, so a job that fails
    leaves the version before. ``buckets`` must be what the table was made with.
    """
    listing = durable(listing.select("dir", "filename", "size", "ctime", "mtime").withColumn("bucket", bucket_of(F.col("dir"), buckets)))
    gone = removed_dirs.select("dir").distinct().withColumn("bucket", bucket_of(F.col("dir"), buckets))
    touched = sorted(r[0] for r in listing.select("bucket").union(gone.select("bucket")).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    now = _only(read(spark, path), touched)
    changed = listing.select("dir").union(gone.select("dir")).distinct()
    stay = now.join(changed, "dir", "left_anti")
    before = now.join(changed, "dir", "left_semi")
    top = read(spark, path).agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    fresh = upsert_files(before.select(*COLUMNS), listing.drop("bucket"), top).select(*COLUMNS).withColumn("bucket", bucket_of(F.col("dir"), buckets))
    new = durable(stay.select(*COLUMNS, "bucket").unionByName(fresh))
    _write(new, path, "overwrite")
    left = {r[0] for r in new.select("bucket").distinct().collect()}
    _drop(spark, path, [b for b in touched if b not in left])
    return touched


def _only(table: DataFrame, buckets: Iterable[int]) -> DataFrame:
    """Reads the folders of these buckets alone."""
    return table.where(F.col("bucket").isin(*buckets))


def _drop(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Buckets that have lost their last file: dynamic overwriting leaves them alone, so they are deleted."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for b in buckets:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(conf).delete(folder, True)
