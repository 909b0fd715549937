"""Release-name extraction as column work over a table of paths.

A path's file name and directories become rows; attributes are regular expressions over the
whole component, so nothing is parsed string by string in Python. What the rules can't
decide is flagged with a reason instead of guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key

# File extensions, media words and their kinds.
VIDEO = ("mkv", "mp4", "avi", "m4v", "mov", "wmv", "webm", "ts", "m2ts", "mpg", "mpeg", "ogm", "flv")
AUDIO = ("flac", "mp3", "m4a", "ogg", "opus", "wav", "ape", "wma", "aac")
TEMPORARY = ("temp", ".tmp", "incomplete", ".incomplete")
KINDS = {
    "resolution": r"(?:2160|1080|720|576|480)[pi]|4K|UHD",
    "video_codec": r"[xXhH]\.?26[45]|HEVC|AVC|AV1|XviD|DivX|VP9|MPEG-?2",
    "audio_codec": r"FLAC|AAC(?:2\.0|5\.1)?|E-?AC-?3|AC-?3|DTS(?:-HD(?: ?MA)?)?|TrueHD|Opus|LPCM|PCM|DDP?\+?(?:2\.0|5\.1|7\.1)?|MP3",
    "medium": r"Blu-?Ray|BDRip|BDMV|BD|WEB-?DL|WEB-?Rip|WEB|HDTV|DVDRip|DVD|TVRip|LaserDisc|LD",
    "hdr": r"HDR10\+?|HDR|DoVi|DV|HLG",
    "bit_depth": r"(?:8|10|12)-?bits?|Hi10P?",
    "edition": r"Director'?s[ .]Cut|Extended|Uncut|Uncensored|Remastered|Theatrical",
}
BONUS = r"Creditless|Menu|Trailer|PV|CM|Preview|Making|Interview"
OPENING, ENDING = r"(?:NC ?|Creditless )OP\d*", r"(?:NC ?|Creditless )ED\d*"
BONUS_JAPANESE = {"ノンテロップED": "NCED", "ノンテロップ": "NCOP", "告知CM": "CM", "予告": "Preview", "メニュー画面": "Menu", "特典「PV": "PV", "特典": "Bonus"}


def _word(pattern: str) -> str:
    return rf"(?i)(?:^|[\s._\[\](),+-])({pattern})(?=$|[\s._\[\](),+-])"


def media_files(listing: DataFrame, include_audio: bool = False, column: str = "path") -> DataFrame:
    """SRC3: media files outside temporary directories."""
    wanted = VIDEO + (AUDIO if include_audio else ())
    parts = F.split(F.lower(column), "/")
    inside = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*TEMPORARY))
    return listing.where(F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1)).isin(*wanted) & ~inside)


def path_components(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row per non-blank path part; ``level`` 0 is the file, 1 its directory and so on."""
    parts = F.filter(F.split(column, "/"), lambda p: F.trim(p) != "")
    each = paths.select(F.col(column).alias("path"), parts.alias("p")).select("path", F.size("p").alias("k"), F.posexplode("p").alias("pos", "component"))
    return each.select("path", (F.col("k") - 1 - F.col("pos")).alias("level"), "component")


def stem(name: Column) -> Column:
    """The component without a known media extension."""
    return F.regexp_replace(name, rf"(?i)\.(?:{'|'.join(VIDEO + AUDIO + ('srt', 'ass'))})$", "")


def structural_tokens(components: DataFrame) -> DataFrame:
    """R2: bracketed spans and the text between them, in order; up to three levels of brackets."""
    inner = r"[^\[\]()「」]*"
    two = rf"(?:\[{inner}\]|\({inner}\)|{inner})*"
    three = rf"(?:\[{two}\]|\({two}\)|{inner})*"
    spans = F.regexp_extract_all(stem(F.col("component")), F.lit(rf"(\[{three}\]|\({three}\)|「{inner}」|[^\[\]()「」]+)"), 1)
    each = components.select("path", "level", F.posexplode(spans).alias("pos", "raw")).where(F.trim("raw") != "")
    kind = F.when(F.col("raw").startswith("["), "bracket").when(F.col("raw").startswith("("), "paren").when(F.col("raw").startswith("「"), "quote").otherwise("text")
    return each.select("path", "level", "pos", kind.alias("kind"), F.trim(F.when(kind == "text", F.col("raw")).otherwise(F.expr("substring(raw, 2, length(raw) - 2)"))).alias("token"))


def lexical_tokens(tokens: DataFrame) -> DataFrame:
    """Words of each token; in scene style (dots for spaces) dots part words, but compounds like H.264 stay."""
    joined = F.regexp_replace("token", r"(?i)\b(H|X)\.(26[45])\b", "$1\u0001$2")
    joined = F.regexp_replace(joined, r"\b([257])\.([01])\b", "$1\u0001$2")
    scene = (F.length("token") - F.length(F.replace("token", F.lit("."), F.lit(""))) >= 2) & ~F.contains("token", F.lit(" "))
    words = F.split(F.when(scene, joined).otherwise(F.replace(joined, F.lit("."), F.lit("\u0001"))), r"[\s._]+")
    return tokens.select("path", "level", "pos", "kind", F.posexplode(words).alias("word_pos", "word")).where("word <> ''").withColumn("word", F.replace("word", F.lit("\u0001"), F.lit(".")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """The kind of each word by the first recogniser that it meets in full, up to a dash and a group."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(KINDS.items())):
        kind = F.when(F.col("word").rlike(rf"(?i)^(?:{pattern})(?:-\w+)?$"), name).otherwise(kind)
    return tokens.withColumn("word_kind", kind)


def episode_cols(df: DataFrame, c: str = "component") -> DataFrame:
    """Season, episode, episodes (a range or repeats), version, special flag of decimals."""
    s = stem(F.col(c))
    get = lambda p, i=1: F.regexp_extract(s, p, i).try_cast("int")
    full = r"(?i)(?:^|[\s._\[(-])S(\d{1,2})[ ._]?E(\d{1,4})(?:v(\d))?"
    to = r"(?i)S\d{1,2}[ ._]?E\d{1,4}-?(?:E|-)(\d{1,4})(?!\d)"
    dash = r"(?:^|\s)-\s(\d{1,4})(?:v(\d))?(?=\s|$|\[|\()"
    ep = r"(?i)\b(?:EP?|Episode[ ._])(\d{1,4})\b"
    jp = r"第(\d{1,4})[話回]"
    end = r"(?i)\b(\d{1,4})[ ._]END\b"
    sp = r"(?i)(?:^|\s)-\s+SP(\d{1,3})(?=\s|$|\[|\()"
    bare = get(dash)
    bare = F.when(~bare.between(1900, 2099), bare)
    first = F.coalesce(get(full, 2), get(ep), get(jp), get(end), get(sp), bare)
    last = get(to)
    decimal = s.rlike(r"(?:^|[\s-])\d{1,3}\.5(?:[\s\[(v]|$)")
    ranged = last > first
    return (
        df.withColumn("season", get(full, 1))
        .withColumn("episode", first)
        .withColumn("episodes", F.when(ranged, F.sequence(first, last)).when(first.isNotNull(), F.array(first)))
        .withColumn("version", F.coalesce(get(full, 3), get(dash, 2)))
        .withColumn("is_special", decimal | s.rlike(_word(r"SP\d*|OVA\d*|OAD\d*|ONA\d*|Specials?")))
        .withColumn("bonus", bonus_kind(s))
    )


def bonus_kind(s: Column) -> Column:
    """Kind of a bonus clip by Japanese words, then by openings and endings without credits, then by English words; else null."""
    japanese = F.coalesce(*[F.when(F.contains(s, F.lit(word)), F.lit(kind)) for word, kind in BONUS_JAPANESE.items()])
    credits = F.when(s.rlike(_word(OPENING)), "NCOP").when(s.rlike(_word(ENDING)), "NCED")
    return F.coalesce(japanese, credits, F.nullif(F.regexp_extract(s, _word(f"(?:{BONUS})\\d*"), 1), F.lit("")))


def season_cols(df: DataFrame, c: str = "component") -> DataFrame:
    """A season of a directory name: S2, Season 2, 2nd Season, 第2期."""
    s = F.col(c)
    get = lambda p: F.regexp_extract(s, p, 1).try_cast("int")
    found = F.coalesce(get(r"(?i)\bSeason[ ._]?(\d{1,2})\b"), get(r"(?i)(?:^|[\s._(\[])S(\d{1,2})(?=$|[\s._)\]])"), get(r"(?i)\b(\d{1,2})(?:st|nd|rd|th)[ ._]Season\b"), get(r"第(\d{1,2})[期季]"), F.when(s.rlike(r"(?i)^Specials?$"), 0))
    return df.withColumn("season", F.coalesce("season", found) if "season" in df.columns else found)


def tech_cols(df: DataFrame, c: str = "component") -> DataFrame:
    """Resolution, codecs, medium, HDR, depth, edition, checksum, remux and dual-audio flags."""
    s = stem(F.col(c))
    for name, pattern in KINDS.items():
        if name == "audio_codec":
            df = df.withColumn("audio_codecs", F.array_distinct(F.regexp_extract_all(s, F.lit(_word(pattern)), 1)))
        else:
            df = df.withColumn(name, F.nullif(F.regexp_extract(s, _word(pattern), 1), F.lit("")))
    df = df.withColumn("checksum", F.upper(F.nullif(F.regexp_extract(s, r"[\[(]([0-9A-Fa-f]{8})[\])]", 1), F.lit(""))))
    return df.withColumn("remux", s.rlike(_word("REMUX"))).withColumn("dual_audio", s.rlike(_word(r"Dual[ ._-]?Audio")))


def year_cols(df: DataFrame, current_year: int, c: str = "component") -> DataFrame:
    """A year from 1940 to next year, and a batch range a~b."""
    s = stem(F.col(c))
    year = F.regexp_extract(s, r"(?:^|[\s._(\[])((?:19|20)\d{2})(?=$|[\s._)\]])", 1).try_cast("int")
    df = df.withColumn("year", F.when(year.between(1940, current_year + 1), year))
    low, high = (F.regexp_extract(s, r"(?:^|[\s\[(])(\d{1,4})\s?~\s?(\d{1,4})(?=$|[\s\])])", i).try_cast("int") for i in (1, 2))
    return df.withColumn("batch_range", F.when(high > low, F.struct(low.alias("first"), high.alias("last"))))


def group_and_title(df: DataFrame, c: str = "component") -> DataFrame:
    """The group from a leading bracket that isn't mostly media words, or after a scene name's last dash; the title before the first marker."""
    s = stem(F.col(c))
    media = "|".join(KINDS.values())
    head = F.regexp_extract(s, r"^\s*[\[【]([^\]】]+)[\]】]", 1)
    words = F.filter(F.split(head, r"[\s,_+.]+"), lambda w: w != "")
    meta = F.size(F.filter(words, lambda w: w.rlike(rf"(?i)^(?:{media})$")))
    lead = F.when((head != "") & (2 * meta < F.size(words)), head)
    tail = F.regexp_extract(s, r"-([A-Za-z0-9_]{2,24})$", 1)
    scene = (F.length(s) - F.length(F.replace(s, F.lit("."), F.lit(""))) >= 2) & ~F.contains(s, F.lit(" "))
    site = r"(?i)^\s*www\.[\w-]+(?:\.[\w-]+)+\s+-\s+"
    body = F.regexp_replace(F.regexp_replace(s, site, ""), r"^\s*[\[【][^\]】]*[\]】]\s*", "")
    spaced = F.when(scene, F.replace(body, F.lit("."), F.lit(" "))).otherwise(F.replace(body, F.lit("_"), F.lit(" ")))
    markers = rf"(?i)(?:\s+-\s+\d{{1,4}}(?:v\d)?(?=\s|$|\[|\()|(?:^|[\s(\[-]+)S\d{{1,2}}\s?E\d{{1,4}}.*|\s+-\s+SP\d{{1,3}}(?=\s|$|\[|\()|[\s(\[-]+(?:{OPENING}|{ENDING})(?=\s|$|\[|\()|\s*(?:映像)?特典|[\s(\[]+(?:EP?|Episode\s)\d{{1,4}}\b|第\d+[話回]|[\s(\[]+(?:{media})(?=$|[\s\])-])|[(\[]|\s+(?:19|20)\d{{2}}(?=\s|$)).*$"
    title = F.trim(F.regexp_replace(F.regexp_replace(spaced, markers, ""), r"[\s\-_]+$", ""))
    dash = r"(?:\s+-\s+|-(?!E?\d{1,4}(?!\w))\s*)"
    after = F.regexp_extract(spaced, rf"(?i)S\d{{1,2}}\s?E\d{{1,4}}(?:v\d)?{dash}([^\[(]+)", 1)
    return df.withColumn("release_group", F.coalesce(lead, F.when(scene & (tail != ""), tail))).withColumn("title", F.nullif(title, F.lit(""))).withColumn("episode_title", F.nullif(F.trim(after), F.lit("")))


def parse_components(components: DataFrame, current_year: int) -> DataFrame:
    return group_and_title(year_cols(tech_cols(season_cols(episode_cols(components))), current_year))


MERGED = ("title", "season", "episode", "release_group", "resolution", "video_codec", "medium", "hdr", "bit_depth", "edition", "year", "version", "checksum", "bonus", "episode_title")


def merge_components(parsed: DataFrame) -> DataFrame:
    """The file's attributes, gaps filled by its nearest directories; the directory's group wins; flags or-ed."""
    by_level = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("level"), F.col(c).alias("v"))))["v"]
    group = F.coalesce(F.max(F.when(F.col("level") == 1, F.col("release_group"))), F.max(F.when(F.col("level") == 0, F.col("release_group"))))
    aggs = [group.alias(c) if c == "release_group" else by_level(c).alias(c) for c in MERGED]
    flags = [F.max(c).alias(c) for c in ("remux", "dual_audio", "is_special")]
    audio = F.array_distinct(F.flatten(F.collect_list("audio_codecs"))).alias("audio_codecs")
    episodes = F.max(F.when(F.col("level") == 0, F.col("episodes"))).alias("episodes")
    return parsed.groupBy("path").agg(*aggs, *flags, audio, episodes)


def coverage(paths: DataFrame, column: str = "path") -> DataFrame:
    """Reasons why the rules can't decide a name: unbalanced or deep brackets, contradictory episodes."""
    name = F.element_at(F.split(column, "/"), -1)
    count = lambda ch: F.length(name) - F.length(F.replace(name, F.lit(ch), F.lit("")))
    marks = F.array_distinct(F.regexp_extract_all(name, F.lit(r"(?i)(S\d{1,2}E\d{1,4})"), 1))
    reasons = F.array_compact(F.array(F.when((count("[") != count("]")) | (count("(") != count(")")), "unbalanced brackets"), F.when(name.rlike(r"[\[(][^\])]*[\[(][^\])]*[\[(][^\])]*[\[(]"), "deep nesting"), F.when(F.size(marks) > 1, "contradictory episodes")))
    return paths.select(F.col(column).alias("path"), reasons.alias("reasons"))


def parse_paths(paths: DataFrame, current_year: int, column: str = "path") -> DataFrame:
    """R1 to R12 for a table of paths."""
    merged = merge_components(parse_components(path_components(paths, column), current_year))
    return merged.join(coverage(paths, column), "path")


def parse_names(names: DataFrame, current_year: int, column: str = "name") -> DataFrame:
    """The same for bare file names: one component each, so nothing is shuffled."""
    return parse_components(names.withColumn("component", F.col(column)), current_year).drop("component")


def clean_title(s: Column) -> Column:
    """Cut at the first media word, drop a trailing bracket."""
    media = "|".join(KINDS.values())
    cut = F.regexp_replace(s, rf"(?i)[\s._\[(]+(?:{media})(?=$|[\s._\])-]).*$", "")
    return F.trim(F.regexp_replace(cut, r"\s*[\[(][^\])]*[\])]?\s*$", ""))


def name_variants(raw: Column, title: Column, alternate: Column) -> Column:
    """Distinct non-empty keys of a name's forms."""
    keys = F.array(match_key(raw), match_key(F.coalesce(title, F.lit(""))), match_key(F.coalesce(alternate, F.lit(""))), match_key(clean_title(raw)))
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def meta_words(tokens: DataFrame) -> DataFrame:
    """Media words of each component, a dashed compound counting where a part is one."""
    media = "|".join(KINDS.values())
    hit = F.exists(F.split("word", "-"), lambda w: w.rlike(rf"(?i)^(?:{media})$")) | F.col("word").rlike(rf"(?i)^(?:{media})$")
    return tokens.groupBy("path", "level").agg(F.count_if(hit).alias("meta_words"), F.count("*").alias("words"))


def download_keys(parsed: DataFrame) -> DataFrame:
    """Files with an episode, a row per key; season 0 and none count as 1."""
    keys = name_variants(F.col("path"), F.col("title"), F.lit(None).cast("string"))
    season = F.when(F.coalesce("season", F.lit(0)) == 0, 1).otherwise(F.col("season"))
    return parsed.where("episode is not null").select(F.explode(keys).alias("series_key"), season.alias("season"), "episode", "path")


def group_titles(parsed: DataFrame) -> DataFrame:
    """Groups of one title key (films with their year): name, files, seasons; largest first."""
    key = F.when(F.col("episode").isNull(), F.concat(match_key(F.coalesce("title", F.lit(""))), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit("")))).otherwise(match_key(F.coalesce("title", F.lit(""))))
    named = parsed.groupBy(key.alias("group_key"), "title").agg(F.count("*").alias("n"), F.min("path").alias("seen"), F.collect_set("season").alias("seasons"))
    # keys are judged as a result of the groups: a filter on them would go below and parse every name once more
    blank = F.max(F.col("group_key").isin("", "|")).alias("blank")
    best = named.groupBy("group_key").agg(F.min(F.struct((-F.col("n")).alias("less"), "seen", "title"))["title"].alias("title"), F.sum("n").alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("seasons")))).alias("seasons"), blank)
    return best.where("not blank").drop("blank").orderBy(F.desc("files"), "group_key")


def parse_problems(parsed: DataFrame) -> DataFrame:
    """Paths without a title or with reasons."""
    return parsed.where("title is null or size(reasons) > 0").select("path", F.when(F.col("title").isNull(), F.array_append("reasons", F.lit("no title"))).otherwise(F.col("reasons")).alias("reasons"))
