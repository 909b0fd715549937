"""Incremental catalog: differences of snapshots, moves, upserts, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import durable

KEY = ["dir", "filename"]


def removed(prev: DataFrame, cur: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """J5."""
    return prev.join(cur.select(*keys), keys, "left_anti")


def added(prev: DataFrame, cur: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return cur.join(prev.select(*keys), keys, "left_anti")


def stale_dirs(prev_dirs: DataFrame, cur_dirs: DataFrame) -> DataFrame:
    """Directories that are gone."""
    return prev_dirs.join(cur_dirs.select("path"), "path", "left_anti")


def dependents(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows that go with their parents."""
    return children.join(gone.select(key), key, "left_semi")


def detect_moves(gone: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of a removed and an added file that are one file, each at most once.

    First rows of equal size and hash pair up in order of directory and name; among the
    rest, rows whose old hash is unknown pair by size where that size is single on both
    sides. Numbering runs within a (size, hash) group, so the join stays an equi-join.
    """
    order = Window.partitionBy("size", "hash").orderBy("dir", "filename")
    a = gone.where("hash is not null").withColumn("n", F.row_number().over(order)).select("file_id", F.col("dir").alias("old_dir"), F.col("filename").alias("old_filename"), "size", "hash", "n")
    b = new.where("hash is not null").withColumn("n", F.row_number().over(order)).select(F.col("dir").alias("new_dir"), F.col("filename").alias("new_filename"), "size", "hash", "n")
    exact = a.join(b, ["size", "hash", "n"]).select("file_id", "old_dir", "old_filename", "new_dir", "new_filename", "size", F.lit("hash").alias("matched_by"))
    left = gone.where("hash is null").join(exact.select("file_id"), "file_id", "left_anti")
    free = new.join(exact.select(F.col("new_dir").alias("dir"), F.col("new_filename").alias("filename")), KEY, "left_anti")
    one_left = left.groupBy("size").agg(F.count("*").alias("k"), F.first("file_id").alias("file_id"), F.first("dir").alias("old_dir"), F.first("filename").alias("old_filename")).where("k = 1").drop("k")
    one_free = free.groupBy("size").agg(F.count("*").alias("k"), F.first("dir").alias("new_dir"), F.first("filename").alias("new_filename")).where("k = 1").drop("k")
    by_size = one_left.join(one_free, "size").select("file_id", "old_dir", "old_filename", "new_dir", "new_filename", "size", F.lit("size").alias("matched_by"))
    return exact.unionByName(by_size)


def freshness(old: DataFrame, new: DataFrame, keys: list[str], stamp: str = "mtime") -> DataFrame:
    """Every key with ``state`` new, changed, same or removed; stamps compare null-safely."""
    o = old.select(*keys, F.col(stamp).alias("_old"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col(stamp).alias("_new"), F.lit(True).alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, state.alias("state"))


def scan_stats(states: DataFrame) -> DataFrame:
    """Directories cached, scanned and removed."""
    return states.agg(F.count_if(F.col("state") == "same").alias("cached"), F.count_if(F.col("state").isin("new", "changed")).alias("scanned"), F.count_if(F.col("state") == "removed").alias("removed"))


def changed_dirs(prev_dirs: DataFrame, cur_dirs: DataFrame) -> DataFrame:
    """Directories whose listing must be read again."""
    return cur_dirs.join(freshness(prev_dirs, cur_dirs, ["path"]).where(F.col("state").isin("new", "changed")).select("path"), "path", "left_semi")


def upsert_files(prev: DataFrame, cur: DataFrame, top: int | None = None) -> DataFrame:
    """The new version of the file table.

    Known (dir, filename) keeps its id; a changed mtime clears the scan stamp and hash; new
    files get ids above the largest old one, in order of directory and name. Numbering is by
    range partition with counted offsets, so no task sees all new rows. ``top`` is the largest
    old id, where ``prev`` is a part of the table only.
    """
    if top is None:
        top = prev.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    p = prev.select(*KEY, "file_id", F.col("mtime").alias("_mtime"), "metadata_scanned_at", "content_hash")
    j = cur.select(*KEY, "size", "ctime", "mtime").join(p, KEY, "left")
    same = F.col("_mtime").eqNullSafe(F.col("mtime"))
    out = j.withColumn("metadata_scanned_at", F.when(same, F.col("metadata_scanned_at"))).withColumn("content_hash", F.when(same, F.col("content_hash"))).drop("_mtime")
    kept, fresh = out.where("file_id is not null"), out.where("file_id is null").drop("file_id")
    return kept.unionByName(_numbered(fresh, KEY, top).withColumnRenamed("_number", "file_id").select(*kept.columns))


def _numbered(df: DataFrame, order: list[str], after: int) -> DataFrame:
    """``_number`` from ``after + 1`` in global order: sorted ranges, their counts summed up, then added."""
    laid = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    offsets = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # one row per partition
    return laid.join(offsets.select("_part", "_first", F.coalesce("_before", F.lit(0)).alias("_before")), "_part").withColumn("_number", F.col("_id") - F.col("_first") + F.col("_before") + after + 1).drop("_part", "_id", "_first", "_before")


def apply_snapshot(prev: DataFrame, cur: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new file table, change log) from the old table and a listing with hashes where known.

    Moved files keep id and hash; the log has one row per file that was moved, added or removed.
    """
    gone, new = removed(prev, cur), added(prev, cur)
    moves = detect_moves(gone, new)
    moved_from = moves.select("file_id", F.col("new_dir").alias("dir"), F.col("new_filename").alias("filename"))
    base = prev.join(moves.select("file_id"), "file_id", "left_anti").join(cur.select(*KEY), KEY, "left_semi").select("file_id", *KEY, "hash")
    carried = moved_from.join(prev.select("file_id", "hash"), "file_id")
    known = base.unionByName(carried.select("file_id", *KEY, "hash"))
    top = prev.agg(F.coalesce(F.max("file_id"), F.lit(0))).first()[0]
    fresh = cur.join(known.select(*KEY), KEY, "left_anti")
    old = cur.join(known.withColumnRenamed("hash", "_hash"), KEY).withColumn("hash", F.coalesce("hash", "_hash")).drop("_hash")
    table = old.unionByName(_numbered(fresh, KEY, top).withColumnRenamed("_number", "file_id").select(*old.columns))
    log = moves.select(F.lit("moved").alias("change"), F.col("new_dir").alias("dir"), F.col("new_filename").alias("filename"), "file_id")
    out = removed(gone, moves.select(F.col("old_dir").alias("dir"), F.col("old_filename").alias("filename")))
    log = log.unionByName(out.select(F.lit("removed").alias("change"), *KEY, "file_id")).unionByName(fresh.select(F.lit("added").alias("change"), *KEY, F.lit(None).cast("long").alias("file_id")))
    return table, log


def replace_children(existing: DataFrame, new: DataFrame, key: list[str] | str = "file_id") -> DataFrame:
    """I4: all rows of the keys that ``new`` names are replaced by its rows."""
    keys = [key] if isinstance(key, str) else key
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def begin_scan(scans: DataFrame, scan_id: int, run_type: str, root: str, at) -> DataFrame:
    """The run type's row opens anew, not finished."""
    row = scans.sparkSession.createDataFrame([(scan_id, run_type, root, at, None)], "scan_id long, run_type string, root_path string, started_at timestamp, finished_at timestamp")
    return scans.where(F.col("run_type") != run_type).unionByName(row)


def finish_scan(scans: DataFrame, scan_id: int, at) -> DataFrame:
    return scans.withColumn("finished_at", F.when(F.col("scan_id") == scan_id, F.lit(at).cast("timestamp")).otherwise(F.col("finished_at")))


def mark_scanned(files: DataFrame, results: DataFrame, at) -> DataFrame:
    """Stamp and hash of the files in ``results(file_id, content_hash)``."""
    r = results.select("file_id", F.col("content_hash").alias("_hash"), F.lit(True).alias("_done"))
    j = files.join(r, "file_id", "left")
    return j.withColumn("metadata_scanned_at", F.when(F.col("_done"), F.lit(at).cast("timestamp")).otherwise(F.col("metadata_scanned_at"))).withColumn("content_hash", F.coalesce("_hash", "content_hash")).drop("_hash", "_done")


def reuse_probe(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached result, rows to probe): path, size and mtime must agree."""
    keys = ["path", "size", "mtime"]
    return files.join(cache, keys), files.join(cache.select(*keys), keys, "left_anti")
