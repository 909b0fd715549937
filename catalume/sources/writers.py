"""Sinks: listings, matches, statistics, plans, blobs, registers, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import Visibility, collation_keys, visible
from ..operators.overlap import drift, union_members


def listing_rows(files: DataFrame, config: Visibility = Visibility()) -> DataFrame:
    """SNK1: visible files in collated order of directory and name, the four listing columns."""
    shown = files.where(visible(config))
    return shown.orderBy(*collation_keys(F.col("dir")), *collation_keys(F.col("filename"))).select(F.col("full_path").alias("path"), "size", "ctime", "mtime")


def write_listing_csv(files: DataFrame, out: str, config: Visibility = Visibility(), single: bool = False) -> None:
    rows = listing_rows(files, config)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").csv(out, header=True)


def write_matches_csv(matches: DataFrame, out: str) -> None:
    """SNK2."""
    matches.select(F.col("full_path").alias("path"), "size", "ctime", "mtime").write.mode("overwrite").csv(out, header=True)


def write_stats(stats: DataFrame, out: str, fmt: str = "json") -> None:
    """SNK3: the statistics row as JSON, or as name and value rows with a dot before each extension."""
    if fmt == "json":
        stats.write.mode("overwrite").json(out)
    else:
        named = stats.select(F.explode(F.concat(F.array(F.struct(F.lit("files").alias("name"), F.col("n_files").alias("value")), F.struct(F.lit("size").alias("name"), F.col("total_size").alias("value"))), F.transform(F.map_entries("extensions"), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("name"), e["value"].alias("value"))))).alias("r"))
        named.select("r.name", "r.value").coalesce(1).write.mode("overwrite").csv(out, header=True)


def write_plan(entries: DataFrame, titles: DataFrame, out: str) -> None:
    """SNK4."""
    entries.write.mode("overwrite").json(f"{out}/entries")
    titles.write.mode("overwrite").json(f"{out}/titles")


def read_plan(entries_schema, titles_schema, spark, path: str) -> tuple[DataFrame, DataFrame]:
    """SNK4: back again, edits of status, conflict and ids included."""
    return spark.read.schema(entries_schema).json(f"{path}/entries"), spark.read.schema(titles_schema).json(f"{path}/titles")


def new_blobs(contents: DataFrame, store: DataFrame) -> DataFrame:
    """SNK5: contents not yet stored, once each, with their hash and its two-letter prefix."""
    hashed = contents.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    return hashed.join(store.select("hash"), "hash", "left_anti").withColumn("prefix", F.substring("hash", 1, 2))


def write_blobs(contents: DataFrame, store: DataFrame, out: str) -> None:
    new_blobs(contents, store).write.mode("append").partitionBy("prefix").parquet(out)


def register_add(register: DataFrame, new: DataFrame) -> DataFrame:
    """SNK6: a set that only grows."""
    return register.select("source").union(new.select("source")).distinct()


def collections_ssot(members: DataFrame) -> DataFrame:
    """SNK7: per name its libraries, members, and what only one of two libraries has."""
    d = drift(members).groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("only_in") == "A", F.col("pid")))).alias("only_a"), F.array_sort(F.collect_list(F.when(F.col("only_in") == "B", F.col("pid")))).alias("only_b"))
    return union_members(members).join(d, "name", "left")
