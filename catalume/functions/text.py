"""Scalar functions as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def extension(name: Column) -> Column:
    """G1: what follows the last dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def human_size(n: Column) -> Column:
    """Binary units with two decimals (ties to even), bytes as they are."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB")):
        value = F.format_string(f"%.2f {unit}", F.bround(n / F.lit(float(1024 ** (i + 1))), 2))
        out = out.when(n < 1024 ** (i + 2), value) if unit != "TiB" else out.otherwise(value)
    return F.when(n.isNotNull(), out)


def _normal(form: str):
    @F.pandas_udf(StringType())
    def of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return of


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, case-folded."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold())


_ASCII = r"^[\x00-\x7F]*$"


def match_key(s: Column) -> Column:
    """Composed, lower case, only a-z, 0-9 and CJK letters; Python sees non-ASCII rows only."""
    composed = F.when(s.rlike(_ASCII), s).otherwise(_normal("NFC")(F.when(~s.rlike(_ASCII), s)))
    return F.regexp_replace(F.lower(composed), r"[^a-z0-9　-鿿＀-￯]", "")


def title_key(s: Column) -> Column:
    """No accents, no apostrophes, words of letters and digits by single spaces."""
    bare = F.translate(s, "'’", "")
    plain = F.when(bare.rlike(_ASCII), F.lower(bare)).otherwise(_decomposed(F.when(~bare.rlike(_ASCII), bare)))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def word_prefix(a: Column, b: Column) -> Column:
    """Equal, or the second and a space begin the first."""
    return (a == b) | a.startswith(F.concat(b, F.lit(" ")))


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whole words only."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(text), pad(phrase))


def strip_year(s: Column) -> Column:
    """G9."""
    return F.regexp_replace(s, r"\s*\((?:19|20)\d{2}\)\s*$", "")


def safe_path(s: Column) -> Column:
    """Separators, colons and their file-name stand-ins become dashes."""
    one = F.regexp_replace(s, "[꞉∶]", ":")
    return F.replace(F.replace(F.replace(one, F.lit("/"), F.lit(" - ")), F.lit(": "), F.lit(" - ")), F.lit(":"), F.lit("-"))


# Folders of extras, and words of a name that tell its folder, the first that fits.
EXTRAS_FOLDERS = ("Featurettes", "Behind The Scenes", "Deleted Scenes", "Interviews", "Scenes", "Shorts", "Trailers", "Other")
EXTRAS_WORDS = {
    "trailer": "Trailers",
    "interview": "Interviews",
    "deleted": "Deleted Scenes",
    "behind the scenes": "Behind The Scenes",
    "behindthescenes": "Behind The Scenes",
    "making of": "Behind The Scenes",
    "short": "Shorts",
}


def extra_name(stem: Column, group: Column) -> Column:
    """Display name of an extra: without its group, dots and underscores as spaces.

    What follows the last dash goes if it is the group, or, where none is known, if the name has no spaces.
    """
    tail, known = F.regexp_extract(stem, r"-([A-Za-z0-9]+)$", 1), F.coalesce(group, F.lit(""))
    ours = F.when(known != "", F.lower(tail) == F.lower(known)).otherwise(~F.contains(stem, F.lit(" ")))
    bare = F.when((tail != "") & ours, F.regexp_replace(stem, r"-[A-Za-z0-9]+$", "")).otherwise(stem)
    return safe_path(F.trim(F.regexp_replace(F.translate(bare, "._", "  "), r"\s+", " ")))


def extras_category(stem: Column, folder: Column, group: Column) -> Column:
    """A folder of extras decides, else a word of the name; Featurettes where neither does."""
    named = [F.when(F.lower(folder) == f.lower(), F.lit(f)) for f in EXTRAS_FOLDERS]
    name = F.lower(extra_name(stem, group))
    words = [F.when(F.contains(name, F.lit(w)), F.lit(f)) for w, f in EXTRAS_WORDS.items()]
    return F.coalesce(*named, *words, F.when(stem.isNotNull(), F.lit("Featurettes")))


def ascii_mask(s: Column) -> Column:
    """G18."""
    return F.regexp_replace(s, "[^ -~]", "?")


def crc_hex(content: Column) -> Column:
    """G26."""
    return F.lpad(F.hex(F.crc32(content)), 8, "0")


def content_hash(content: Column) -> Column:
    """Equality is what counts, so the built-in SHA-256."""
    return F.sha2(content, 256)


def lenient_int(s: Column) -> Column:
    """Digits of the text as one number."""
    return F.regexp_replace(s, r"\D", "").try_cast("long")


def year_of(s: Column) -> Column:
    """The first four characters as a number, else 0."""
    return F.coalesce(F.substring(s, 1, 4).try_cast("int"), F.lit(0))


def generic_title(title: Column, number: Column) -> Column:
    """Empty, to be announced, or only 'Episode n'."""
    return F.coalesce(F.trim(title) == "", F.lit(True)) | title.rlike(r"(?i)^\s*tba\s*$") | (F.lower(F.trim(title)) == F.concat(F.lit("episode "), number.cast("string")))


def site_token(token: Column) -> Column:
    """G31."""
    return token.rlike(r"(?i)^www\.[\w-]+(?:\.[\w-]+)+$")


def guid_id(guid: Column) -> Column:
    """(provider, id) by the first pattern that fits, else null."""
    out = F.lit(None).cast("struct<provider:string,pid:long>")
    # Patterns of provider ids, in order of precedence.
    patterns = (("anidb", r"anidb-(\d+)"), ("tvdb", r"tvdb3?-(\d+)"), ("tvdb", r"thetvdb://(\d+)"), ("tmdb", r"tmdb-(\d+)"), ("tmdb", r"themoviedb://(\d+)"))
    for provider, pattern in reversed(patterns):
        out = F.when(guid.rlike(pattern), F.struct(F.lit(provider).alias("provider"), F.regexp_extract(guid, pattern, 1).cast("long").alias("pid"))).otherwise(out)
    return out


def job_group(cls: Column) -> Column:
    """Keyword ladder over job classes."""
    # Words of job classes and their groups, in order of precedence.
    c = F.lower(cls)
    has = lambda *words: c.rlike("|".join(words))
    return F.when(has("anidb", "mylist"), "AniDB").when(has("tmdb"), "TMDB").when(has("trakt"), "Trakt").when(has("discoverfile", "processfile", "hashfile"), "File").when(has("stats", "refresh"), "Stats").otherwise("Other")


def ms_to_sectors(ms: Column) -> Column:
    """Milliseconds to the nearest of 75 sectors a second."""
    return F.floor((ms * 75 + 500) / 1000).cast("long")


def msf_to_sectors(msf: Column) -> Column:
    """MM:SS:FF with seconds below 60 and frames below 75, else null."""
    part = lambda i: F.regexp_extract(msf, r"^(\d+):(\d{1,2}):(\d{1,2})$", i).try_cast("long")
    return F.when((part(2) < 60) & (part(3) < 75), part(1) * 4500 + part(2) * 75 + part(3))


def disc_id(offsets: Column, total: Column) -> Column:
    """Hash of first and last track, lead-out and up to 99 offsets, each 150 sectors later, in hexadecimal."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    eight = lambda c: F.lpad(F.hex(c), 8, "0")
    slots = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: eight(F.when(i <= F.size(offsets), F.get(offsets, i - 1) + 150).otherwise(F.lit(0))))
    text = F.concat(two(F.lit(1)), two(F.size(offsets)), eight(total + 150), F.array_join(slots, ""))
    return F.translate(F.base64(F.unhex(F.sha1(text))), "+/=", "._-")


def resolution(height: Column, scan: Column, width: Column) -> Column:
    """The larger class of height and width; 2160 and above ignore the scan type."""
    ladder = lambda c, steps: F.coalesce(*[F.when(c >= at, F.lit(rank)) for at, rank in steps], F.lit(0))
    rank = F.greatest(ladder(height, ((2000, 5), (1000, 4), (700, 3), (560, 2), (1, 1))), ladder(width, ((3800, 5), (1900, 4), (1260, 3))))
    interlaced = F.lower(F.coalesce(scan, F.lit(""))).isin("interlaced", "mbaff")
    kind = F.when(interlaced, "i").otherwise("p")
    return F.when(rank == 5, F.lit("4K")).when(rank == 4, F.concat(F.lit("1080"), kind)).when(rank == 3, F.concat(F.lit("720"), kind)).when(rank == 2, F.concat(F.lit("576"), kind)).when(rank == 1, F.concat(F.lit("480"), kind)).otherwise(F.lit(""))


def hdr_class(fmt: Column, compatibility: Column, transfer: Column) -> Column:
    """DoVi, with HDR where it falls back to HDR10; HDR for HDR10, PQ and HLG by format or transfer; else empty."""
    f, c, t = (F.coalesce(x, F.lit("")) for x in (fmt, compatibility, transfer))
    vision = F.when(F.contains(c, F.lit("HDR10")), "DoVi,HDR").otherwise("DoVi")
    high = f.rlike("HDR10|HLG") | t.rlike("SMPTE ST 2084|PQ|HLG")
    return F.when(F.contains(f, F.lit("Dolby Vision")), vision).when(high, "HDR").otherwise("")


def first_integer(s: Column, pattern: str) -> Column:
    return F.regexp_extract(s, pattern, 1).try_cast("int")


def episode_tag(season: Column, episode: Column, episodes: Column | None = None) -> Column:
    """SxxEyy, a list of episodes as first and last."""
    one = F.concat(F.lit("S"), F.lpad(season.cast("string"), 2, "0"), F.lit("E"), F.lpad(episode.cast("string"), F.greatest(F.lit(2), F.length(episode.cast("string"))), F.lit("0")))
    if episodes is None:
        return one
    last = F.element_at(episodes, -1).cast("string")
    return F.when(F.size(episodes) > 1, F.concat(F.lit("S"), F.lpad(season.cast("string"), 2, "0"), F.lit("E"), F.lpad(F.element_at(episodes, 1).cast("string"), 2, "0"), F.lit("-E"), F.lpad(last, 2, "0"))).otherwise(one)


def dual_title(original: Column, english: Column) -> Column:
    """Both titles where their keys differ."""
    differs = (F.coalesce(english, F.lit("")) != "") & (title_key(original) != title_key(english))
    return F.when(differs, F.concat(original, F.lit(" ["), english, F.lit("]"))).otherwise(original)
