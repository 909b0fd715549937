"""Sources: listings, trees, logs, provider payloads, probes, collections, id files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import guid_id, lenient_int, year_of

LISTING = "path string, size long, ctime long, mtime long"


def split_path(path: Column) -> tuple[Column, Column]:
    """Directory and file name of an absolute path."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: header CSV of path, size, ctime, mtime."""
    directory, name = split_path(F.col("path"))
    return spark.read.schema(LISTING).csv(path, header=True).withColumn("dir", directory).withColumn("filename", name)


def list_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """SRC2: regular files below a root, contents never read; directories of excluded names pruned. ctime is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^\w+:/*(?=/)", "").alias("path"), F.col("length").alias("size"), F.lit(None).cast("long").alias("ctime"), F.unix_timestamp("modificationTime").alias("mtime"))
    directory, name = split_path(F.col("path"))
    files = files.withColumn("dir", directory).withColumn("filename", name)
    return files.where(~F.arrays_overlap(F.split("dir", "/"), F.array(*[F.lit(x) for x in exclude]))) if exclude else files


def read_job_logs(spark: SparkSession, folder: str) -> DataFrame:
    """SRC4: ``(day, value)`` lines of daily .log or .zip files; a day's .log wins over its .zip.

    Zipped days are unpacked in the tasks, member by member, in batches of lines.
    """
    day = F.to_date(F.regexp_extract("file", r"(\d{4}-\d{2}-\d{2})\.(?:log|zip)$", 1))
    plain = spark.read.option("pathGlobFilter", "*.log").text(folder).select(F.col("_metadata.file_name").alias("file"), "value").where(F.col("file").rlike(r"^\d{4}-\d{2}-\d{2}\.log$"))
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content").where(F.col("file").rlike(r"^\d{4}-\d{2}-\d{2}\.zip$"))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["file"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            lines: list[str] = []
                            for raw in f:
                                lines.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
                                if len(lines) == 10000:
                                    yield pd.DataFrame({"file": name, "value": lines})
                                    lines = []
                            yield pd.DataFrame({"file": [name] * len(lines), "value": lines})

    plain_days = plain.select(day.alias("day")).distinct()
    zipped = zips.withColumn("day", day).join(plain_days, "day", "left_anti").select("file", "content").mapInPandas(unpack, "file string, value string")
    return plain.select(day.alias("day"), "value").unionByName(zipped.select(day.alias("day"), "value"))


SERIES_XML = "struct<_id:int,type:string,startdate:string,titles:struct<title:array<struct<_VALUE:string,`_xml:lang`:string,_type:string>>>,episodes:struct<episode:array<struct<_id:int,epno:struct<_VALUE:string,_type:int>,title:array<struct<_VALUE:string,`_xml:lang`:string>>>>>>"


def series_xml(payloads: DataFrame, column: str = "xml") -> DataFrame:
    """SRC6: one record per XML payload: titles with order, episodes, year, film flag."""
    x = payloads.withColumn("x", F.from_xml(F.col(column), SERIES_XML))
    titles = F.transform("x.titles.title", lambda t, i: F.struct(i.alias("pos"), t["_xml:lang"].alias("lang"), t["_type"].alias("type"), t["_VALUE"].alias("text")))
    episodes = F.transform("x.episodes.episode", lambda e: F.struct(e["epno"]["_type"].alias("kind"), lenient_int(e["epno"]["_VALUE"]).alias("number"), F.get(F.filter(e["title"], lambda t: t["_xml:lang"] == "en"), F.lit(0))["_VALUE"].alias("english"), F.get(F.filter(e["title"], lambda t: t["_xml:lang"] == "x-jat"), F.lit(0))["_VALUE"].alias("romaji")))
    return x.select(F.col("x._id").alias("pid"), year_of(F.coalesce("x.startdate", F.lit(""))).alias("year"), (F.col("x.type") == "Movie").alias("is_movie"), F.coalesce(titles, F.array().cast("array<struct<pos:int,lang:string,type:string,text:string>>")).alias("titles"), episodes.alias("episodes"))


def pick_titles(series: DataFrame, priority: tuple[tuple[str, str], ...] = (("x-jat", "main"), ("ja", "official"), ("en", "official"))) -> DataFrame:
    """The title of the first (language, type) in the list, in document order within."""
    t = series.select("pid", F.explode("titles").alias("t"))
    rank = F.coalesce(*[F.when((F.col("t.lang") == lang) & (F.col("t.type") == kind), F.lit(i)) for i, (lang, kind) in enumerate(priority)], F.lit(len(priority)))
    return t.groupBy("pid").agg(F.min_by(F.col("t.text"), F.struct(rank.alias("rank"), F.col("t.pos").alias("pos"))).alias("title"))


def read_series_xml(spark: SparkSession, path: str) -> DataFrame:
    return series_xml(spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml"))


SERIES_JSON = "id string, name string, year string, firstAired string, nameTranslations array<string>, aliases array<struct<language:string,name:string>>, translations map<string,string>, episodes array<struct<seasonNumber:int,number:int,name:string>>"
SEARCH_JSON = "data array<struct<tvdb_id:string,name:string,year:string,type:string,aliases array<string>,translations map<string,string>>>"


def series_json(payloads: DataFrame, language: str = "eng") -> DataFrame:
    """SRC7: title by translation, alias of the language, then name; year from the first air date; no record without an id."""
    alias = F.get(F.filter("aliases", lambda a: a["language"] == language), F.lit(0))["name"]
    title = F.coalesce(F.nullif(F.col("translations").getItem(language), F.lit("")), F.nullif(alias, F.lit("")), "name")
    out = payloads.select(F.col("id").try_cast("long").alias("pid"), title.alias("title"), F.coalesce(F.col("year").try_cast("int"), year_of(F.coalesce("firstAired", F.lit("")))).alias("year"), F.transform(F.coalesce("aliases", F.array().cast("array<struct<language:string,name:string>>")), lambda a: a["name"]).alias("aliases"), "episodes")
    return out.where("pid is not null")


def read_series_json(spark: SparkSession, path: str) -> DataFrame:
    return series_json(spark.read.schema(SERIES_JSON).json(path, multiLine=True))


def movie_json(payloads: DataFrame) -> DataFrame:
    """SRC8: a row per search result, ``payloads(results array<struct<id,title,original_title,name,original_name,release_date,first_air_date>>)``."""
    r = payloads.select(F.posexplode("results").alias("rank", "r"))
    return r.select("rank", F.col("r.id").try_cast("long").alias("pid"), F.coalesce("r.title", "r.name").alias("name"), F.coalesce("r.original_title", "r.original_name").alias("original"), year_of(F.coalesce("r.release_date", "r.first_air_date", F.lit(""))).alias("year")).where("pid is not null")


MOVIES_JSON = "results array<struct<id:string,title:string,original_title:string,name:string,original_name:string,release_date:string,first_air_date:string>>"


def read_movie_json(spark: SparkSession, path: str) -> DataFrame:
    return movie_json(spark.read.schema(MOVIES_JSON).json(path, multiLine=True))


PROBE = "struct<media:struct<track:array<map<string,string>>>>"
# Codec names of the probe and their short forms.
AUDIO_CODECS = {"Opus": "opus", "FLAC": "flac", "Vorbis": "vorbis", "PCM": "pcm", "MPEG Audio": "mp3", "TrueHD": "TrueHD"}
AUDIO_FAMILIES = {"DTS": "DTS", "AC-3": "AC3", "E-AC-3": "EAC3", "AAC": "aac", "MLP": "TrueHD"}
VIDEO_CODECS = {"MPEG Video": "MPEG2", "MPEG-4 Visual": "XviD"}
STILLS = ("JPEG", "PNG", "GIF", "BMP")


def audio_codec(fmt: Column) -> Column:
    """Short name of an audio format, or of the family that its name begins with; others in lower case."""
    known = [F.when(fmt == k, F.lit(v)) for k, v in AUDIO_CODECS.items()]
    return F.coalesce(*known, *[F.when(fmt.startswith(k), F.lit(v)) for k, v in AUDIO_FAMILIES.items()], F.lower(fmt))


def video_codec(fmt: Column) -> Column:
    """Short name of a video format; others as they are."""
    return F.coalesce(*[F.when(fmt == k, F.lit(v)) for k, v in VIDEO_CODECS.items()], fmt)


def media_probe(payloads: DataFrame, column: str = "json") -> DataFrame:
    """SRC9, G12 to G14: first video track, one that is no still picture if there is any, its class values, and the audio tracks."""
    from ..functions.text import hdr_class, resolution

    tracks = F.coalesce(F.from_json(F.col(column), PROBE)["media"]["track"], F.array().cast("array<map<string,string>>"))
    p = payloads.withColumn("_t", tracks)
    videos = F.filter("_t", lambda t: t["@type"] == "Video")
    moving = F.filter(videos, lambda t: ~F.coalesce(t["Format"], F.lit("")).isin(*STILLS))
    p = p.withColumn("_v", F.coalesce(F.get(moving, F.lit(0)), F.get(videos, F.lit(0))))
    v = lambda k: F.col("_v").getItem(k)
    audio = F.transform(F.filter("_t", lambda t: t["@type"] == "Audio"), lambda t: F.struct(audio_codec(t["Format"]).alias("codec"), t["Language"].alias("language"), t["Title"].alias("title"), F.coalesce(t["Title"].rlike(r"(?i)\bcommentary\b"), F.lit(False)).alias("is_commentary")))
    library = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(F.coalesce(v(k), F.lit("")), r"(?i)(x26[45])", 1)), F.lit("")) for k in ("Encoded_Library_Name", "Encoded_Library", "Writing_library")])
    return p.select(
        *[c for c in payloads.columns if c != column],
        video_codec(v("Format")).alias("video_codec"),
        resolution(lenient_int(v("Height")), v("ScanType"), lenient_int(v("Width"))).alias("resolution"),
        F.coalesce(lenient_int(v("BitDepth")).cast("int"), F.lit(8)).alias("bit_depth"),
        hdr_class(v("HDR_Format"), v("HDR_Format_Compatibility"), v("transfer_characteristics")).alias("hdr"),
        library.alias("encoder"),
        audio.alias("audio"),
    )


def audio_summary(probed: DataFrame) -> DataFrame:
    """Distinct codecs in order without commentary, and Dual or Multi audio where languages differ."""
    heard = F.filter("audio", lambda a: ~a["is_commentary"])
    languages = F.array_compact(F.array_distinct(F.transform(heard, lambda a: a["language"])))
    kind = F.when(F.size(languages) > 2, "Multi Audio").when(F.size(languages) == 2, "Dual Audio")
    return probed.withColumn("audio_codecs", F.array_distinct(F.transform(heard, lambda a: a["codec"]))).withColumn("audio_kind", kind)


# Tag names with a shared meaning.
TAG_ALIASES = {"album_performer": "album_artist", "albumartist": "album_artist", "performer": "artist", "track_name": "title", "track_position": "track_number", "recorded_date": "date", "part_position": "disc_number"}


def tag_name(key: Column) -> Column:
    """G15."""
    plain = F.translate(F.lower(key), "/ -", "___")
    return F.coalesce(*[F.when(plain == k, F.lit(v)) for k, v in TAG_ALIASES.items()], plain)


def collection_members(tags: DataFrame, taggings: DataFrame, items: DataFrame) -> DataFrame:
    """SRC10: ``(library, name, provider, pid, title, year)`` from the three tables of a media server."""
    j = taggings.join(tags, "tag_id").join(items, "item_id").withColumn("id", guid_id(F.col("guid")))
    return j.select("library", F.col("tag").alias("name"), F.coalesce("id.provider", F.lit("unknown")).alias("provider"), F.col("id.pid").alias("pid"), "title", "year").distinct()


def dest_ids(spark: SparkSession, root: str) -> DataFrame:
    """``(dir, provider, pid)`` of small id files (provider.id) in library directories."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "{anidb,tvdb}.id").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.trim("value").alias("v"))
    return files.select(F.regexp_replace(F.regexp_extract("p", r"^(.*)/[^/]*$", 1), r"^\w+:/*(?=/)", "").alias("dir"), F.regexp_extract("p", r"([^/]+)\.id$", 1).alias("provider"), F.col("v").try_cast("long").alias("pid")).where("pid is not null")


def union_sources(*frames: DataFrame) -> DataFrame:
    """Bag union that keeps the order of the sources as ``rank``."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("rank", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def log_file_day(name: str) -> str | None:
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})\.(?:log|zip)", name)
    return m[1] if m else None


def first_per_day(files: DataFrame) -> DataFrame:
    """Winner among a day's files ``(day, file, is_zip)``."""
    w = Window.partitionBy("day").orderBy("is_zip", "file")
    return files.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
