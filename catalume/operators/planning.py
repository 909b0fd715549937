"""Ingest planning: narrowing, conflicts, numbering, validation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def narrow(scanned: DataFrame, prior: DataFrame) -> DataFrame:
    """J9."""
    return scanned.join(prior.select("source").distinct(), "source", "left_semi")


def drop_registered(scanned: DataFrame, register: DataFrame) -> DataFrame:
    """J10."""
    return scanned.join(register.select("source"), "source", "left_anti")


def titles_matching(df: DataFrame, needle: str, column: str = "title") -> DataFrame:
    """F14."""
    return df.where(F.contains(F.lower(column), F.lit(needle.lower())))


def drop_samples(files: DataFrame, column: str = "filename") -> DataFrame:
    """names with the word sample go."""
    return files.where(~F.regexp_replace(column, r"\.[^.]+$", "").rlike(r"(?iu)(?:^|[\W_])sample(?:[\W_]|$)"))


def too_long(df: DataFrame, limit: int = 255, column: str = "dest_name") -> DataFrame:
    """F16: names of more UTF-8 bytes than a file system takes."""
    return df.where(F.octet_length(column) > limit)


def drop_twins(files: DataFrame) -> DataFrame:
    """Of hard links the first scanned stays; files without (dev, inode) stay."""
    w = Window.partitionBy("dev", "inode").orderBy("pos")
    known = files.where("dev is not null and inode is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return known.unionByName(files.where("dev is null or inode is null"))


def mark_dup_dests(plan: DataFrame) -> DataFrame:
    """A destination goes to its first live entry, upper and lower case alike; later ones are skipped with its path as note."""
    live = F.col("status") == "ready"
    w = Window.partitionBy(F.lower("dest_dir"), F.lower("dest_name"), live).orderBy("pos")
    first = F.first("source").over(w)
    late = live & (F.row_number().over(w) > 1)
    return plan.withColumn("note", F.when(late, F.concat(F.lit("same destination as "), first)).otherwise(F.col("note"))).withColumn("status", F.when(late, "skip").otherwise(F.col("status")))


def one_version(plan: DataFrame) -> DataFrame:
    """Where the library has an episode all ready entries of it are skipped, else the first ready one stays."""
    key = ["title", "season", "episode"]
    ready = F.col("status") == "ready"
    present = F.max(F.col("status") == "present").over(Window.partitionBy(*key))
    rank = F.row_number().over(Window.partitionBy(*key, ready).orderBy("pos"))
    return plan.withColumn("status", F.when(ready & (present | (rank > 1)), "skip").otherwise(F.col("status")))


def merge_titles(blocks: DataFrame) -> DataFrame:
    """``(block, into)``: blocks of one provider id join the first, unless their editions differ."""
    w = Window.partitionBy("pid").orderBy("pos")
    edition = F.nullif("edition", F.lit(""))
    kept = F.first(edition, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.first("block").over(w)
    into = F.when(F.col("pid").isNull() | (edition.isNotNull() & (edition != kept)), F.col("block")).otherwise(first)
    return blocks.select("block", "pid", into.alias("into"), F.coalesce(edition, F.when(into == F.col("block"), kept), F.lit("")).alias("edition"))


def assign_special_numbers(files: DataFrame, specials: DataFrame, start: int = 100, gap: int = 20) -> DataFrame:
    """Numbers of unmatched bonus files, per counter, above ``start`` and well above the known specials.

    ``files(path, series, counter, pair, kind)``, ``specials(series, number)``.
    """
    top = specials.groupBy("series").agg(F.max("number").alias("top"))
    w = Window.partitionBy("series", "counter").orderBy("pair", "kind", "path")
    base = F.greatest(F.lit(start), F.coalesce(F.col("top") + gap, F.lit(start)))
    return files.join(top, "series", "left").withColumn("number", (base + F.row_number().over(w) - 1).cast("int")).drop("top")


def take_regular(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` episodes, renumbered from one where they start later."""
    w = Window.partitionBy("series").orderBy("episode", "path")
    ranked = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return ranked.withColumn("episode", F.col("episode") - F.min("episode").over(Window.partitionBy("series")) + 1).drop("_n")


def fill_group(files: DataFrame, by: list[str], column: str = "release_group") -> DataFrame:
    """The first known value of a group fills its gaps."""
    w = Window.partitionBy(*by).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return files.withColumn(column, F.coalesce(F.nullif(column, F.lit("")), F.first(F.nullif(column, F.lit("")), ignorenulls=True).over(w), F.lit("")))


def most_common(names: DataFrame, key: str, name: str, pos: str) -> DataFrame:
    """The commonest name per key, the one seen first on a tie."""
    each = names.groupBy(key, name).agg(F.count("*").alias("n"), F.min(pos).alias("seen"))
    return each.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", F.col(name).alias("name"))).alias("m"), F.sum("n").alias("files")).select(key, F.col("m.name").alias(name), "files")


def majority(files: DataFrame, by: list[str], flag: str) -> DataFrame:
    """The flag of all is true where more than half have it."""
    w = Window.partitionBy(*by)
    return files.withColumn(flag, F.count_if(flag).over(w) > F.floor(F.count("*").over(w) / 2))


def split_extras(files: DataFrame) -> DataFrame:
    """``role`` main, extra or dropped per torrent directory: three films of like size are a season pack."""
    w = Window.partitionBy("torrent_dir")
    top = F.max("size").over(w)
    alike = F.count_if((F.col("size") * 2 > top) & ~F.col("filename").rlike(r"(?i)\b(?:part|pt|cd|disc)[ ._-]?\d")).over(w)
    first = F.row_number().over(w.orderBy(F.desc("size"), "filename")) == 1
    return files.withColumn("role", F.when(alike >= 3, "dropped").when(first, "main").otherwise("extra"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """A23."""
    return plan.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.coalesce("note", F.lit("")) != "").alias("with_note"))


def carry_decisions(plan: DataFrame, prior: DataFrame) -> DataFrame:
    """An earlier skip wins, an earlier conflict answer stays while there still is a conflict."""
    p = prior.select("source", F.col("status").alias("_status"), F.col("conflict").alias("_conflict"))
    j = plan.join(p, "source", "left")
    skip = F.coalesce(F.col("_status") == "skip", F.lit(False))
    return j.withColumn("conflict", F.when(F.col("status") == "conflict", F.coalesce("_conflict", "conflict")).otherwise(F.col("conflict"))).withColumn("status", F.when(skip, "skip").otherwise(F.col("status"))).drop("_status", "_conflict")


def validate_plan(plan: DataFrame, listing: DataFrame, dests: DataFrame) -> DataFrame:
    """One row ``(source, problem)`` per problem of a live entry; ``listing(source, size)``, ``dests(dest, size)``."""
    live = plan.where("status in ('ready', 'conflict')").withColumn("dest", F.concat_ws("/", "dest_dir", "dest_name"))
    now = listing.select("source", F.col("size").alias("now_size"), F.lit(True).alias("there"))
    have = dests.select("dest", F.col("size").alias("dest_size"))
    claims = F.count("*").over(Window.partitionBy(F.lower("dest")))
    j = live.withColumn("claims", F.when(F.coalesce("dest_name", F.lit("")) != "", claims)).join(now, "source", "left").join(have, "dest", "left")
    found = F.array(
        F.when(F.col("pid").isNull(), "needs id"),
        F.when(F.col("there").isNull(), "source missing"),
        F.when(F.col("there") & (F.col("now_size") != F.col("size")), "size changed"),
        F.when(F.coalesce("dest_name", F.lit("")) == "", "no destination"),
        F.when(F.col("claims") > 1, "duplicate destination"),
        F.when(F.col("dest_size").isNotNull() & (F.col("dest_size") == F.col("size")), "already done"),
        F.when(F.col("dest_size").isNotNull() & (F.col("dest_size") != F.col("size")), "destination appeared"),
    )
    return j.select("source", F.explode(F.array_compact(found)).alias("problem"))


def existing_episode(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Library files of the destination's directory with the same season and episode but another name."""
    se = lambda c, i: F.regexp_extract(c, r"(?i)\bs(\d+)e(\d+)", i).try_cast("int")
    a = plan.select("source", "dest_dir", "dest_name", se("dest_name", 1).alias("s"), se("dest_name", 2).alias("e"))
    b = listing.select(F.col("dir").alias("dest_dir"), F.col("filename").alias("existing"), se("filename", 1).alias("s"), se("filename", 2).alias("e"))
    return a.join(b, ["dest_dir", "s", "e"]).where("existing <> dest_name").select("source", "dest_dir", "dest_name", "existing")


def conflict_matches(source: DataFrame, existing: DataFrame, on: str = "dest") -> DataFrame:
    """Whether group, source, codec and audio set of both copies agree."""
    cols = ["release_group", "medium", "codec"]
    audio = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), "+")
    a = source.select(on, *cols, audio("audio").alias("audio_set"))
    b = existing.select(on, *[F.col(c).alias(f"_{c}") for c in cols], audio("audio").alias("_audio_set"))
    same = F.lit(True)
    for c in [*cols, "audio_set"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, on).select(on, same.alias("same"))


def verify_checksum(files: DataFrame) -> DataFrame:
    """The checksum in a name against the content's: true, false, or null without one."""
    named = F.upper(F.nullif(F.regexp_extract("filename", r"[\[(]([0-9A-Fa-f]{8})[\])]", 1), F.lit("")))
    return files.select("filename", (named == F.lpad(F.hex(F.crc32("content")), 8, "0")).alias("verified"))


def drop_foreign(files: DataFrame, domains: DataFrame, own: str) -> DataFrame:
    """Files of titles that belong elsewhere go, and so do groups whose every file lies in a foreign directory.

    ``files(path, torrent_dir, group_key, title)``, ``domains(title, domain)``.
    """
    j = files.join(domains, "title", "left").withColumn("foreign", F.coalesce(F.col("domain") != own, F.lit(False)))
    dirs = F.max("foreign").over(Window.partitionBy("torrent_dir"))
    return j.withColumn("_d", dirs).withColumn("_g", F.min("_d").over(Window.partitionBy("group_key"))).where("not foreign and not _g").drop("foreign", "domain", "_d", "_g")


def quality_block(group: Column, version: Column, parts: list[Column]) -> Column:
    """Group with version, then the known parts by commas."""
    name = F.when(F.coalesce(version, F.lit(1)) > 1, F.concat(group, F.lit("v"), version.cast("string"))).otherwise(group)
    tags = F.concat_ws(",", *[F.nullif(p, F.lit("")) for p in parts])
    return F.trim(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(tags, F.lit(""))))
