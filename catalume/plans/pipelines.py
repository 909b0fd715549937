"""Pipelines composed of the operators: ingest plan, series plan, outcomes, metadata extraction, catalog reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import episode_tag, lenient_int, safe_path
from ..operators import catalog as C
from ..operators import match as M
from ..operators import planning as P
from ..operators import snapshot as S
from ..sources.readers import media_probe
from ..sources.writers import register_add


def dest_names(entries: DataFrame) -> DataFrame:
    """Directory and file name of each entry: title with year, season directory, episode tag, quality block."""
    title = safe_path(F.col("title"))
    year = F.when(F.coalesce("year", F.lit(0)) > 0, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    season = F.when(F.col("season") == 0, F.lit("Specials")).otherwise(F.concat(F.lit("Season "), F.lpad(F.col("season").cast("string"), 2, "0")))
    block = P.quality_block(F.coalesce("release_group", F.lit("")), F.col("version"), [F.col(c) for c in ("medium", "resolution", "video_codec", "hdr") if c in entries.columns])
    tag = F.when(block != "", F.concat(F.lit(" ["), block, F.lit("]"))).otherwise(F.lit(""))
    episodic = F.col("episode").isNotNull()
    directory = F.when(episodic, F.concat(title, year, F.lit("/"), season)).otherwise(F.concat(title, year))
    name = F.when(episodic, F.concat(title, F.lit(" - "), episode_tag(F.coalesce("season", F.lit(1)), F.col("episode")), tag, F.lit("."), F.col("ext"))).otherwise(F.concat(title, year, tag, F.lit("."), F.col("ext")))
    return entries.withColumn("dest_dir", directory).withColumn("dest_name", name)


def ingest_plan(sources: DataFrame, library: DataFrame, ids: list[tuple[str, DataFrame]], register: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Entries with status, destination, conflict and note.

    ``sources(source, pos, size, title, year, season, episode, release_group, version, ext, dev, inode, ...)``,
    ``library(dir, filename, size)``. Steps: hard-link twins, registered files, ids by the
    ladder, destinations, long names, same-size twins, one version per episode, earlier
    decisions, duplicate destinations.
    """
    entries = P.drop_registered(P.drop_twins(sources), register)
    entries = entries.join(M.resolve_ids(entries.select("title").distinct(), ids), "title", "left")
    entries = dest_names(entries)
    twins = M.size_twins(entries.where("size > 0"), library)
    entries = entries.join(twins, "source", "left")
    long_name = F.octet_length("dest_name") > 255
    status = F.when(long_name, "skip").when(F.col("action") == "skip", "skip").when(F.col("action") == "conflict", "conflict").otherwise("ready")
    note = F.when(long_name, "name too long").when(F.col("action").isNotNull(), F.concat(F.lit("same size as "), F.col("twin"))).otherwise("")
    entries = entries.withColumn("status", status).withColumn("note", note).withColumn("conflict", F.when(F.col("action") == "conflict", "keep")).drop("action", "twin")
    entries = P.one_version(entries)
    if prior is not None:
        entries = P.carry_decisions(entries, prior)
    return P.mark_dup_dests(entries)


def series_plan(files: DataFrame, titles: DataFrame, episodes: DataFrame, regular: int) -> DataFrame:
    """Files of a series: regular episodes with their titles, extras matched to specials, the rest numbered."""
    own = M.files_for_series(files, titles)
    bonus = own.where("bonus is not null")
    normal = P.take_regular(own.where("bonus is null and episode is not null"), regular)
    named = M.episode_titles(normal.select("path", "series", F.coalesce("season", F.lit(1)).alias("season"), F.array("episode").alias("episodes")), episodes)
    known = M.match_specials(bonus.select("path", "series", F.col("bonus").alias("name")), episodes)
    rest = P.assign_special_numbers(bonus.join(known, "path", "left_anti").select("path", "series", F.when(F.col("bonus").rlike("(?i)NC(OP|ED)"), "song").otherwise(F.lower("bonus")).alias("counter"), F.coalesce(lenient_int(F.col("bonus")), F.lit(0)).alias("pair"), F.lower("bonus").alias("kind")), episodes.where("season = 0").select("series", "number"))
    out = normal.join(named, "path", "left").select("path", F.coalesce("season", F.lit(1)).alias("season"), "episode", named["title"].alias("episode_title"), F.lit("regular").alias("role"))
    out = out.unionByName(known.select("path", F.lit(0).alias("season"), F.col("number").cast("int").alias("episode"), F.lit(None).cast("string").alias("episode_title"), F.lit("special").alias("role")))
    return out.unionByName(rest.select("path", F.lit(0).alias("season"), F.col("number").alias("episode"), F.lit(None).cast("string").alias("episode_title"), F.lit("numbered").alias("role")))


def apply_outcomes(plan: DataFrame, outcomes: DataFrame, register: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decision per entry, new register) from what was done: ``outcomes(source, done)``."""
    j = plan.join(outcomes, "source", "left")
    decision = F.when(F.col("status") == "skip", "skipped").when(F.col("status") == "conflict", F.coalesce(F.element_at(F.create_map(F.lit("keep"), F.lit("kept"), F.lit("replace"), F.lit("replaced"), F.lit("both"), F.lit("both")), F.col("conflict")), F.lit("kept"))).when(F.coalesce("done", F.lit(False)), "copied").otherwise("failed")
    decided = j.withColumn("decision", decision)
    return decided, register_add(register, decided.where("decision in ('copied', 'replaced', 'both')"))


def extract_metadata(files: DataFrame, probes: DataFrame, tags: DataFrame, extensions: tuple[str, ...], at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with new stamps, replaced tag rows, errors) from ``probes(file_id, json)``; broken payloads go to the errors."""
    wanted = C.needs_metadata(files, extensions).select("file_id")
    got = probes.join(wanted, "file_id", "left_semi")
    bad = got.where(F.try_parse_json("json").isNull()).select("file_id", F.lit("not JSON").alias("error"))
    good = media_probe(got.join(bad, "file_id", "left_anti"))
    kinds = ("video_codec", "resolution", "hdr", "encoder")
    rows = good.select("file_id", F.explode(F.array(*[F.struct(F.lit(k).alias("tag_name"), F.col(k).alias("value")) for k in kinds])).alias("t")).select("file_id", "t.tag_name", "t.value").where("coalesce(value, '') <> ''")
    return S.mark_scanned(files, good.select("file_id", F.lit(None).cast("string").alias("content_hash")), at), S.replace_children(tags, rows), bad


def catalog_reports(files: DataFrame, config: C.Visibility = C.Visibility()) -> DataFrame:
    """P5: per scan and directory the bytes and files at or below, with the share of the scan."""
    used = C.usage(files)
    total = F.max(F.when(F.col("at") == "", F.col("total_size"))).over(Window.partitionBy("scan_id"))
    return used.withColumn("share", F.col("total_size") / total)
