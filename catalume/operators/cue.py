"""Cue sheets: tracks, offsets, tables of contents, disc ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import disc_id, msf_to_sectors


def _value(pattern: str, line: Column | str = "line") -> Column:
    """Quoted or bare value of a line."""
    return F.coalesce(F.nullif(F.regexp_extract(line, pattern + r'\s+"([^"]*)"', 1), F.lit("")), F.nullif(F.trim(F.regexp_extract(line, pattern + r"\s+([^\"]\S*.*)$", 1)), F.lit("")))


def _first(values: Column) -> Column:
    """The first value of an array that isn't null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def _where(items: Column | str, test: Callable[[Column, Column], Column]) -> Column:
    """Positions, from 1, of the items that ``test(item, index)`` holds for."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x, i), i + 1)), lambda x: x.isNotNull())


def _runs(items: str, at: str) -> Column:
    """Parts of the array ``items``, each from one position in ``at`` up to the next. Both are columns, as they are read once a part."""
    return F.transform(at, lambda b, j: F.slice(items, b, F.coalesce(F.get(at, j + 1), F.size(items) + 1) - b))


def cue_lines(sheets: DataFrame) -> DataFrame:
    """Numbered lines of ``(file_id, content)`` with the file and track that they belong to."""
    each = sheets.select("file_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_file, is_track = F.col("line").rlike(r"(?i)^FILE\s"), F.col("line").rlike(r"(?i)^TRACK\s+\d+")
    each = each.withColumn("file_no", F.sum(is_file.cast("int")).over(w)).withColumn("file", F.last(F.when(is_file, _value("(?i)^FILE")), ignorenulls=True).over(w))
    return each.withColumn("track", F.last(F.when(is_track, F.regexp_extract("line", r"(?i)^TRACK\s+(\d+)", 1).cast("int")).when(is_file, F.lit(-1)), ignorenulls=True).over(w))


def cue_tracks(sheets: DataFrame) -> DataFrame:
    """One row per track; ``error`` where an audio track has no first index.

    A sheet is cut into its files and these into tracks within its row, so no lines are sorted or
    shuffled. Parts of a file that name the same track are one track; the first value counts.
    """
    # the word that opens each line is looked for once
    word = lambda x: F.upper(F.regexp_extract(x, r"(?i)^(FILE(?=\s)|TRACK(?=\s+\d)|(?:TITLE|PERFORMER|ISRC|INDEX)(?=\s)|PREGAP)", 1)).alias("word")
    opens = lambda name: lambda x, i=None: x["word"] == name
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    each = sheets.select("file_id", F.transform(lines, lambda x: F.struct(word(x), x.alias("line"))).alias("lines"))
    each = each.withColumn("at", F.concat(F.array(F.lit(1)), _where("lines", opens("FILE"))))
    each = each.select("file_id", _runs("lines", "at").alias("files"))
    first_track = lambda f: F.nullif(F.array_position(f["word"], "TRACK"), F.lit(0))
    head = F.flatten(F.transform("files", lambda f: F.slice(f, F.lit(1), F.coalesce(first_track(f) - 1, F.size(f)).cast("int"))))
    each = each.select("file_id", "files", head.alias("head"), F.transform("files", lambda f: _value("(?i)^FILE", F.get(f, F.lit(0))["line"])).alias("names"))
    found = lambda items, name, value: _first(F.transform(F.filter(items, opens(name)), lambda x: value(x["line"])))
    of = lambda name: lambda x: _value(f"(?i)^{name}", x)
    album = [found("head", name, of(name)).alias(c) for name, c in (("TITLE", "album"), ("PERFORMER", "album_artist"))]
    each = each.select("file_id", *album, "names", F.posexplode_outer("files").alias("file_no", "lines")).where("lines is not null")

    # a file without a name of its own goes by the one before
    before = _first(F.reverse(F.slice("names", F.lit(1), F.col("file_no"))))
    each = each.withColumn("file", F.coalesce(F.get("names", F.col("file_no")), before)).withColumn("at", _where("lines", opens("TRACK")))
    kept = ("file_id", "file_no", "file", "album", "album_artist")
    number = lambda part: F.regexp_extract(part[0]["line"], r"(?i)^TRACK\s+(\d+)", 1).cast("int").alias("track")
    each = each.select(*kept, F.array_sort(F.transform(_runs("lines", "at"), lambda p, i: F.struct(number(p), i.alias("i"), p.alias("lines")))).alias("parts"))
    each = each.withColumn("at", _where("parts", lambda p, i: (i == 0) | (p["track"] != F.get(F.col("parts"), i - 1)["track"])))
    each = each.select(*kept, F.explode_outer(_runs("parts", "at")).alias("parts"))
    each = each.select(*kept, F.col("parts")[0]["track"].alias("track"), F.flatten(F.col("parts.lines")).alias("lines")).where("track > 0")

    one = lambda name, value, c: found("lines", name, value).alias(c)
    msf = lambda x: F.transform(F.array(F.regexp_extract(x, r"(\d+:\d+:\d+)", 1)), msf_to_sectors)[0]
    index = lambda n: lambda x: F.when(x.rlike(rf"(?i)^INDEX\s+{n}\s"), msf(x))
    kind = lambda x: F.nullif(F.upper(F.regexp_extract(x, r"(?i)^TRACK\s+\d+\s+(\S+)", 1)), F.lit(""))
    tracks = each.select(
        *("file_id", F.col("file_no").cast("long").alias("file_no"), "track", "file"),
        one("TRACK", kind, "kind"),
        one("TITLE", of("TITLE"), "title"),
        one("PERFORMER", of("PERFORMER"), "performer"),
        one("ISRC", of("ISRC"), "isrc"),
        one("INDEX", index("00"), "index00"),
        one("INDEX", index("01"), "index01"),
        one("PREGAP", msf, "pregap"),
        *("album", "album_artist"),
    )
    error = F.when((F.col("kind") == "AUDIO") & F.col("index01").isNull(), "no INDEX 01").alias("error")
    return tracks.select(*tracks.columns[:-2], error, "album", "album_artist")


def cue_offsets(tracks: DataFrame, durations: DataFrame) -> DataFrame:
    """Absolute start of audio tracks: sectors of the files before, plus the index. ``durations(file_id, file_no, sectors)``."""
    before = F.coalesce(F.sum("sectors").over(Window.partitionBy("file_id").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = durations.withColumn("before", before).withColumn("total", F.sum("sectors").over(Window.partitionBy("file_id")))
    return tracks.where("kind = 'AUDIO'").join(d.select("file_id", "file_no", "before", "total"), ["file_id", "file_no"]).withColumn("start", F.col("before") + F.col("index01"))


def cue_toc(offsets: DataFrame) -> DataFrame:
    """Start, length and last sector of each track; the last one runs to the end."""
    w = Window.partitionBy("file_id").orderBy("start", "track")
    after = F.coalesce(F.lead("start").over(w), F.col("total"))
    return offsets.select("file_id", "track", "start", (after - F.col("start")).alias("length"), (after - 1).alias("end"))


def cue_disc_ids(offsets: DataFrame) -> DataFrame:
    """C4."""
    starts = F.transform(F.array_sort(F.collect_list(F.struct("track", "start"))), lambda x: x["start"])
    g = offsets.groupBy("file_id").agg(starts.alias("starts"), F.max("total").alias("total"))
    return g.select("file_id", disc_id(F.col("starts"), F.col("total")).alias("disc_id"))


def cue_summary(tracks: DataFrame) -> DataFrame:
    """Rows for display; a track's artist only where it isn't the album's."""
    other = F.col("performer").isNotNull() & ~F.col("performer").eqNullSafe(F.col("album_artist"))
    title = F.coalesce("title", F.concat(F.lit("Track "), F.col("track").cast("string")))
    return tracks.select("file_id", F.coalesce("album", F.lit("Unknown Album")).alias("album"), F.coalesce("album_artist", F.lit("Unknown Artist")).alias("album_artist"), "track", F.when(other, F.concat("performer", F.lit(" - "), title)).otherwise(title).alias("line"))
