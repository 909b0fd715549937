"""Matching of files, titles, candidates and library entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key, title_key
from ..plans.durable import durable

EPISODE = ["series_key", "season", "episode"]


def group_word(group: Column) -> Column:
    """First word of a release group, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(group, r"([\w-]+)", 1)), F.lit(""))


def match_downloads(source: DataFrame, downloads: DataFrame) -> DataFrame:
    """``(path, dl_path, matched_by)``.

    First pass: same series, season and episode; the download of nearest size (first path on
    a tie) is picked, and rejected if both groups are known and their first words differ. Rows
    without a size have no nearest one.
    Second pass: still unmatched rows outside season 0 take the first download of equal size
    and equal group word.
    """
    s = source.select(*EPISODE, "path", "size", group_word(F.col("release_group")).alias("g"))
    d = downloads.select(*EPISODE, F.col("path").alias("dl_path"), F.col("size").alias("dl_size"), group_word(F.col("release_group")).alias("dg"))
    near = _nearest(s, d).groupBy("path", "g").agg(F.min("pick").alias("pick"))
    one = near.where("g is null or pick.dg is null or g = pick.dg").select("path", F.col("pick.dl_path").alias("dl_path"), F.lit("episode").alias("matched_by"))
    rest = s.where("season <> 0").join(one.select("path"), "path", "left_anti")
    first = d.groupBy(F.col("dl_size").alias("size"), F.col("dg").alias("g")).agg(F.min("dl_path").alias("dl_path"))
    two = rest.join(first, ["size", "g"]).groupBy("path").agg(F.min("dl_path").alias("dl_path")).withColumn("matched_by", F.lit("size"))
    return one.unionByName(two)


def _nearest(s: DataFrame, d: DataFrame) -> DataFrame:
    """``(path, g, pick)`` of ``s`` rows: the download of nearest size of their episode, by a sweep in order of size.

    No pairs are made: both sides are sorted together, and each source row looks at the last
    download up to its size and at the next one from there on (equal sizes: downloads first).
    """
    one = d.where("dl_size is not null").groupBy(*EPISODE, F.col("dl_size").alias("size")).agg(F.min(F.struct("dl_path", "dg")).alias("dl"))
    one = one.withColumn("dl", F.struct("size", "dl.dl_path", "dl.dg"))
    both = s.where("size is not null").select(*EPISODE, "size", "path", "g").unionByName(one, allowMissingColumns=True)
    key = Window.partitionBy(*EPISODE)
    seen = lambda order: F.last("dl", ignorenulls=True).over(key.orderBy(order, F.col("dl").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("below", seen(F.asc("size"))).withColumn("above", seen(F.desc("size"))).where("dl is null")
    pick = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("size") - F.col(f"{c}.size")).alias("gap"), F.col(f"{c}.dl_path"), F.col(f"{c}.dg")))
    return both.select("path", "g", F.least(pick("below"), pick("above")).alias("pick")).where("pick is not null")


def enrich(source: DataFrame, matches: DataFrame, downloads: DataFrame, overwrite: list[str], flags: list[str], fill: list[str]) -> DataFrame:
    """Values of the matched download overwrite, flags are or-ed, ``fill`` columns only fill gaps."""
    d = downloads.select(F.col("path").alias("dl_path"), *[F.col(c).alias(f"_{c}") for c in [*overwrite, *flags, *fill]])
    j = source.join(matches.select("path", "dl_path"), "path", "left").join(d, "dl_path", "left")
    for c in overwrite:
        j = j.withColumn(c, F.coalesce(F.nullif(f"_{c}", F.lit("")), c) if c in source.columns else F.col(f"_{c}"))
    for c in flags:
        j = j.withColumn(c, F.coalesce(F.col(f"_{c}"), F.lit(False)) | (F.coalesce(F.col(c), F.lit(False)) if c in source.columns else F.lit(False)))
    for c in fill:
        j = j.withColumn(c, F.coalesce(F.nullif(c, F.lit("")), f"_{c}") if c in source.columns else F.col(f"_{c}"))
    return j.drop(*[f"_{c}" for c in [*overwrite, *flags, *fill]])


def alias_components(edges: DataFrame) -> DataFrame:
    """``(series_id, component)``, the smallest series id that shares titles, directly or through others.

    A title links its series to the smallest of them, so links are as many as rows at most. Each
    round every series goes over to its smallest neighbour and links go with their ends: series
    that are smallest around them stay, the others and links within a component leave, and the next
    round has a fraction of both. The rounds' steps are put together at the end, last first.
    """
    # one exchange by title serves the smallest series of each title and the links to it
    e = edges.select("series_id", "title").where("title is not null").repartition("title")
    low = e.groupBy("title").agg(F.min("series_id").alias("low"), F.max("series_id").alias("high")).where("low < high").select("title", "low")
    links = durable(e.join(low, "title").where("series_id <> low").select(F.col("series_id").alias("a"), F.col("low").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not links.isEmpty():
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("l")).select("l.*")
        step = durable(ends.groupBy("x").agg(F.least("x", F.min("y")).alias("to")))
        steps.append(step)
        moved = links.join(step.select(F.col("x").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("x").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        links = durable(moved.select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct())
    labels = steps.pop() if steps else None
    while steps:
        ahead = labels.select(F.col("x").alias("to"), F.col("to").alias("last"))
        labels = steps.pop().join(ahead, "to", "left").select("x", F.coalesce("last", "to").alias("to"))
    every = edges.where("title is not null").select("series_id").distinct()
    if labels is None:
        return every.withColumn("component", F.col("series_id"))
    return every.join(labels.select(F.col("x").alias("series_id"), F.col("to").alias("component")), "series_id", "left").select("series_id", F.coalesce("component", "series_id").alias("component"))


def alias_expand(names: DataFrame | None, titles: DataFrame, components: DataFrame) -> DataFrame:
    """``(name, title)``: each name and every title of its series' component; without ``names``, each title is one.

    Each title is laid down once with its component. Where no title has two components, as in those of
    :func:`alias_components`, pairs of titles are distinct as they come, so the result isn't shuffled again.
    """
    of = titles.select("series_id", "title").join(components, "series_id", "left").select("title", "component")
    one = durable(of.groupBy("title").agg(F.min("component").alias("component"), F.max("component").alias("last")))
    several = not one.where("component < last").isEmpty()
    known = (of.distinct() if several else one.select("title", "component")).where("component is not null")
    if names is None:
        via = known.where("title is not null").select(F.col("title").alias("name"), "component")
        alone = one.where("component is null or title is null").select(F.col("title").alias("name"))
    else:
        names = names.select("name").distinct()
        via = names.join(known.select(F.col("title").alias("name"), "component"), "name")
        alone = names.join(known.select(F.col("title").alias("name")), "name", "left_anti")
    pairs = via.join(known, "component").select("name", "title").unionByName(alone.withColumn("title", F.col("name")))
    return pairs.distinct() if several else pairs


def prefix_match(left: DataFrame, right: DataFrame, least: int = 1) -> DataFrame:
    """Pairs ``(key, index_key)`` where one, of ``least`` characters or more, is a prefix of the other.

    The longer key is exploded into its prefixes, which meet the shorter key as a whole: every
    row of the join is a pair of the result, so keys that merely begin alike never meet, however
    frequent their beginning is. Rows grow with the lengths of the keys.
    """
    left, right = left.where(F.length("key") >= least), right.where(F.length("index_key") >= least)

    def heads(c: str, last: Column) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(least), last), lambda i: F.substring(c, F.lit(1), i))).alias("head")

    down = left.select("key", heads("key", F.length("key"))).join(right.select("index_key"), F.col("head") == F.col("index_key")).select("key", "index_key")
    longer = right.where(F.length("index_key") > least).select("index_key", heads("index_key", F.length("index_key") - 1))
    return down.unionByName(longer.join(left.select("key"), F.col("head") == F.col("key")).select("key", "index_key"))


def phrase_domain(titles: DataFrame, index: DataFrame) -> DataFrame:
    """``(title, domain, matched_by)`` by exact key, key without spaces, then whole-word containment.

    ``index(key, domain, pos)``; the smallest ``pos`` wins. Contained keys have eight
    characters or more and share a word; they meet on their rarest word.
    """
    t = titles.select("title", title_key(F.col("title")).alias("tk")).distinct()
    i = index.select("key", "domain", "pos")
    exact = t.join(i, F.col("tk") == F.col("key")).select("title", F.struct(F.lit(1).alias("rank"), "pos", "domain").alias("m"))
    loose = t.join(i, F.replace("tk", F.lit(" "), F.lit("")) == F.replace("key", F.lit(" "), F.lit(""))).select("title", F.struct(F.lit(2).alias("rank"), "pos", "domain").alias("m"))
    words = i.where(F.length(F.regexp_replace("key", r"\W", "")) >= 8).select("key", "domain", "pos", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    rare = words.groupBy("word").agg(F.count("*").alias("n"))
    chosen = words.join(rare, "word").groupBy("key", "domain", "pos").agg(F.min(F.struct("n", "word")).alias("w")).select("key", "domain", "pos", F.col("w.word").alias("word"))
    inside = t.select("title", "tk", F.explode(F.array_distinct(F.split("tk", " "))).alias("word")).join(chosen, "word")
    inside = inside.where(F.contains(F.concat(F.lit(" "), "tk", F.lit(" ")), F.concat(F.lit(" "), "key", F.lit(" ")))).select("title", F.struct(F.lit(3).alias("rank"), "pos", "domain").alias("m"))
    best = exact.union(loose).union(inside).groupBy("title").agg(F.min("m").alias("m"))
    return best.select("title", F.col("m.domain").alias("domain"), F.element_at(F.array(F.lit("exact"), F.lit("loose"), F.lit("contained")), F.col("m.rank")).alias("matched_by"))


def existing_dir(titles: DataFrame, dirs: DataFrame) -> DataFrame:
    """The library directory of the first title, in order, whose name equals it after tags and brackets go.

    ``titles(block, pos, title, year)``, ``dirs(dir, name)``. Of a name only its first directory, and of
    a block's equal titles only the first, can be picked, so no others meet, however often a name occurs.
    """
    bare = title_key(F.regexp_replace(F.regexp_replace("name", r"\{[^}]*\}|\[[^\]]*\]", ""), r"\s+$", ""))
    names = dirs.groupBy("name").agg(F.min(F.struct("dir")).alias("d"))
    d = names.groupBy(bare.alias("k")).agg(F.min("d").alias("d"))
    label = F.when(F.col("year") > 0, F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    first = titles.groupBy("block", label.alias("label")).agg(F.min(F.struct("pos")).alias("p"))
    t = first.groupBy("block", title_key(F.col("label")).alias("k")).agg(F.min("p").alias("p"))
    return t.join(d, "k").groupBy("block").agg(F.min(F.struct("p.pos", "d.dir")).alias("m")).select("block", F.col("m.dir").alias("dir"))


def size_twins(plan: DataFrame, library: DataFrame) -> DataFrame:
    """Plan entries whose size a library file has: beside the destination a conflict, elsewhere a skip.

    Per size and directory two names are enough (one of them isn't the entry's own), and per size
    two directories, so a size that many files share makes no pairs. Files without a directory
    or name are left out.
    """
    lib = library.where("size > 0 and dir is not null and filename is not null")
    lib = lib.select("size", F.col("dir").alias("lib_dir"), F.col("filename").alias("lib_name")).distinct()
    names = lib.withColumn("_n", F.row_number().over(Window.partitionBy("size", "lib_dir").orderBy("lib_name"))).where("_n <= 2")
    dirs = names.where("_n = 1").withColumn("_d", F.row_number().over(Window.partitionBy("size").orderBy("lib_dir"))).where("_d <= 2")
    near = plan.join(names.withColumn("dest_dir", F.col("lib_dir")), ["size", "dest_dir"]).where("dest_name <> lib_name")
    far = plan.join(dirs, "size").where("dest_dir <> lib_dir")
    wanted = lambda hit, away: hit.select("source", F.struct(F.lit(away).alias("far"), "lib_dir", "lib_name").alias("m"))
    best = wanted(near, False).union(wanted(far, True)).groupBy("source").agg(F.min("m").alias("m"))
    return best.select("source", F.when(F.col("m.far"), "skip").otherwise("conflict").alias("action"), F.concat_ws("/", "m.lib_dir", "m.lib_name").alias("twin"))


def pick_candidate(titles: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(title, verdict, pid)``: exact, high, ambiguous or none.

    ``titles(title, wanted, year)`` with an array of keys; ``candidates(title, rank, pid, name, original, year)``.
    """
    c = candidates.select("title", "rank", "pid", title_key(F.col("name")).alias("n"), title_key(F.coalesce("original", F.lit(""))).alias("o"), F.coalesce("year", F.lit(0)).alias("cy"))
    j = titles.select("title", "wanted", F.coalesce("year", F.lit(0)).alias("y")).join(c, "title", "left")
    exact = (F.array_contains("wanted", F.col("n")) | F.array_contains("wanted", F.col("o"))) & ((F.col("y") == 0) | (F.col("cy") == 0) | (F.col("y") == F.col("cy")))
    g = j.groupBy("title").agg(F.count("pid").alias("k"), F.count_if(F.coalesce(exact, F.lit(False))).alias("e"), F.min(F.when(exact, F.struct("rank", "pid"))).alias("best"), F.min("pid").alias("only"))
    return g.select("title", F.when(F.col("e") == 1, "exact").when((F.col("e") == 0) & (F.col("k") == 1), "high").when(F.col("k") == 0, "none").otherwise("ambiguous").alias("verdict"), F.when(F.col("e") == 1, F.col("best.pid")).when((F.col("e") == 0) & (F.col("k") == 1), F.col("only")).alias("pid"))


def library_pick(candidates: DataFrame, dirs: DataFrame) -> DataFrame:
    """Of ambiguous candidates the one that has a library directory, if exactly one has."""
    hit = candidates.join(dirs.select("pid").distinct(), "pid")
    return hit.groupBy("title").agg(F.count_distinct("pid").alias("k"), F.min("pid").alias("pid")).where("k = 1").select("title", "pid")


def resolve_ids(titles: DataFrame, ladder: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(title, pid, origin)``: the first of the tables ``(title, pid)`` that knows a title."""
    out = titles.select("title")
    for i, (_, t) in enumerate(ladder):
        out = out.join(t.groupBy("title").agg(F.min("pid").alias(f"_{i}")), "title", "left")
    origin = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(ladder)])
    return out.select("title", F.coalesce(*[F.col(f"_{i}") for i in range(len(ladder))]).alias("pid"), origin.alias("origin"))


def cross_check(resolved: DataFrame, second: DataFrame) -> DataFrame:
    """Ok, mismatch or unavailable by another provider's ``(title, pid)``."""
    j = resolved.join(second.select("title", F.col("pid").alias("other")), "title", "left")
    return j.select("title", "pid", F.when(F.col("other").isNull(), "unavailable").when(F.col("other") == F.col("pid"), "ok").otherwise("mismatch").alias("check"))


def sidecars(videos: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("srt", "ass", "ssa", "sub", "idx", "vtt"), default_language: str = "en") -> DataFrame:
    """Subtitle files of each video: same directory, its stem, a dot, tags and a subtitle extension.

    A subtitle's candidate stems are exploded (one per dot), so the join stays an equi-join.
    """
    v = videos.select("dir", "filename", F.regexp_replace("filename", r"\.[^.]+$", "").alias("stem"))
    s = files.select("dir", F.col("filename").alias("subtitle")).where(F.lower(F.element_at(F.split("subtitle", r"\."), -1)).isin(*extensions))
    parts = F.split("subtitle", r"\.")
    s = s.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size(parts) - 1))).withColumn("stem", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), "."))
    tags = F.slice(parts, F.col("cut") + 1, F.size(parts) - F.col("cut") - 1)
    language = F.coalesce(F.get(F.filter(tags, lambda x: x.rlike(r"(?i)^[a-z]{2,3}(-[a-z]{2,4})?$")), F.lit(0)), F.lit(default_language))
    return s.withColumn("language", language).join(v, ["dir", "stem"]).select("dir", "filename", "subtitle", "language")


def episode_titles(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Titles of the files' episodes in order, joined by ' + '; English before romaji.

    ``files(path, series, season, episodes array)``, ``episodes(series, season, number, english, romaji)``.
    """
    e = files.select("path", "series", "season", F.posexplode("episodes").alias("pos", "number")).join(episodes, ["series", "season", "number"])
    title = F.coalesce(F.nullif(F.trim("english"), F.lit("")), "romaji")
    return e.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", title.alias("t")))), lambda x: x["t"]), " + ").alias("title"))


def match_specials(extras: DataFrame, episodes: DataFrame, least: int = 8) -> DataFrame:
    """Extras whose name opens (or is) the title of exactly one special; ``extras(path, series, name)``."""
    x = extras.select("path", "series", title_key(F.col("name")).alias("k")).where(F.length(F.replace("k", F.lit(" "), F.lit(""))) >= least)
    s = episodes.where("season = 0").select("series", "number", title_key(F.coalesce("english", "romaji")).alias("t"))
    j = x.withColumn("h", F.substring("k", 1, least)).join(s.withColumn("h", F.substring("t", 1, least)), ["series", "h"])
    hit = j.where((F.col("t") == F.col("k")) | F.col("t").startswith(F.concat("k", F.lit(" "))))
    return hit.groupBy("path").agg(F.count("*").alias("n"), F.min("number").alias("number")).where("n = 1").select("path", "number")


def files_for_series(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Files of unknown title, and those whose key equals or, from four characters on, extends or opens one."""
    keyed = files.withColumn("key", match_key(F.coalesce("title", F.lit(""))))
    wanted = titles.select(match_key(F.col("title")).alias("index_key")).where("index_key <> ''").distinct()
    keys = keyed.select("key").where("key <> ''").distinct()
    same = keys.join(wanted, F.col("key") == F.col("index_key"), "left_semi")
    near = same.unionByName(prefix_match(keys, wanted, 4).select("key")).distinct()
    return keyed.where("key = ''").unionByName(keyed.where("key <> ''").join(near, "key", "left_semi").select(*keyed.columns)).drop("key")


def library_index(items: DataFrame) -> DataFrame:
    """SRC11, W1: one row per lookup key; the first item (by ``pos``) wins a key.

    Keys: folder, title and year, ~title, ~title without spaces, also for alternate titles.
    """
    named = items.withColumn("name", F.explode(F.array_distinct(F.concat(F.array("title"), F.coalesce("alternates", F.array().cast("array<string>"))))))
    k = title_key(F.col("name"))
    keys = F.array(F.lower("folder"), F.concat(F.lower("name"), F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.concat(F.lit("~"), k), F.concat(F.lit("~"), F.replace(k, F.lit(" "), F.lit(""))))
    each = named.select(F.explode(F.array_distinct(keys)).alias("key"), "pos", "item_id").where("key is not null and key <> '~'")
    w = Window.partitionBy("key").orderBy("pos", "item_id")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").select("key", "item_id")


def tag_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens with the kind their lower-case text has in the vocabulary, a fixed table of a few hundred rows."""
    return tokens.join(F.broadcast(vocabulary), F.lower("token") == F.col("word"), "left").drop("word")
