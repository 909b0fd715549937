"""Registered queries of release names by tokens, SQL forms, and the iterative and incremental mechanisms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql as surface
from ..functions import text as G
from ..operators import catalog as C
from ..operators import logs as L
from ..operators import names as N
from ..operators import planning as P
from ..operators import sketches as K
from ..operators import versions as V
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import drain as D
from . import pipelines as plans
from .durable import new_folder

_FIELDS = ("title", "season", "episode", "episode_title", "version", "release_group", "source_type", "resolution", "video_codec", "checksum", "bit_depth", "year", "dual_audio")


def _assembled(t) -> DataFrame:
    """Every name of every shape, with what its tokens tell."""
    found = N.parse_components(t.v_releases.select(F.col("name").alias("component")))
    return found.select(F.col("component").alias("name"), *_FIELDS, F.array_join("audio_codecs", ",").alias("audio"), F.array_join("reasons", ",").alias("reasons"))


_by = lambda *values: "CASE shape " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_ASSEMBLED = f"""SELECT DISTINCT name,
 {_by('series', 'series', 'series', 'series', 'series', "series || ' [Alt (x [y]) z]'")} AS title,
 {_by('season', 'NULL', 'season', 'NULL', 'season', 'NULL')} AS season, {_by('episode', 'episode', 'episode', 'NULL', 'episode', 'episode')} AS episode,
 {_by('NULL', 'NULL', "'The First Try'", 'NULL', 'upper(series)', 'NULL')} AS episode_title, {_by('NULL', '2', 'NULL', 'NULL', 'NULL', 'NULL')} AS version,
 CASE WHEN shape <> 3 THEN grp END AS release_group, {_by("'BD'", "'Web'", "'Web'", "'BD'", "'BD'", "'BD'")} AS source_type,
 {_by("'1080'", "'720'", "'1080'", "'1080'", "'1080'", "'1080'")} AS resolution, {_by("'x265'", "'HEVC'", "'H.264'", "'x265'", "'HEVC'", 'NULL')} AS video_codec,
 {_by('NULL', 'crc', 'NULL', 'NULL', 'NULL', 'NULL')} AS checksum, {_by('NULL', 'NULL', 'NULL', '10', '10', 'NULL')} AS bit_depth,
 {_by('NULL', 'NULL', 'NULL', '1960 + season', 'NULL', 'NULL')} AS year, shape = 2 AS dual_audio,
 {_by("'TrueHD 5.1'", "'AAC'", "'AAC2.0'", "'EAC3 2.0'", "'FLAC'", "''")} AS audio, CASE WHEN shape = 5 THEN 'bracket is not closed' ELSE '' END AS reasons
 FROM {{v_releases}}"""

#: Tokens of each kind in each shape of name.
_COUNTED = {"audio": (1, 1, 1, 1, 1, 0), "checksum": (0, 1, 0, 0, 0, 0), "depth": (0, 0, 0, 1, 1, 0), "dual_audio": (0, 0, 1, 0, 0, 0), "episode": (1, 1, 1, 0, 1, 1), "group": (1, 1, 1, 0, 1, 1), "bracket": (0, 0, 0, 0, 0, 1), "resolution": (1,) * 6, "season": (0, 0, 0, 0, 1, 0), "source": (1,) * 6, "video": (1, 1, 1, 1, 1, 0), "year": (0, 0, 0, 1, 0, 0), "episode_title": (0, 0, 0, 0, 1, 0)}


def _kinds(t) -> DataFrame:
    found = N.tokens(N.distinct_components(t.v_releases.select(F.col("name").alias("component"))))
    return found.where(F.col("kind").isin(*_COUNTED)).groupBy("kind").agg(F.count("*").alias("n"))


_KINDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(sum({_by(*c)}) AS BIGINT) AS n FROM (SELECT DISTINCT shape, name FROM {{v_releases}}) q" for k, c in _COUNTED.items())


def _paths(t) -> DataFrame:
    """Names of files that tell no season, in directories that do, below one of the series."""
    path = F.concat("series", F.lit(" (199"), "s", F.lit(") [1080p]/Season 0"), "s", F.lit("/"), "name")
    return N.parse_paths(t.v_releases.where("shape in (1, 4)").select(path.alias("path"))).select("path", "path_title", "title", "year", "episode", "release_group", "resolution")


_PATHS = """SELECT DISTINCT series || ' (199' || s || ') [1080p]/Season 0' || s || '/' || name AS path, series AS path_title, series AS title, 1990 + season AS year, episode,
 grp AS release_group, CASE WHEN shape = 1 THEN '720' ELSE '1080' END AS resolution FROM {v_releases} WHERE shape IN (1, 4)"""


def _find_in_sql(t) -> DataFrame:
    """F2 written in SQL alone."""
    surface.register(t.spark)
    return t.spark.sql(r"SELECT full_path, extension(filename) AS ext FROM {files} WHERE find_regexp('order_\\d*[48]\\.(?:flac|mkv)$', full_path)", files=t.files)


def _components_in_sql(t) -> DataFrame:
    """R1 by a table function: how often each component stands at each level."""
    surface.register(t.spark)
    return t.spark.sql("SELECT p.level, p.component, count(*) AS n FROM {files}, LATERAL path_components(full_path) p WHERE p.level > 0 GROUP BY ALL", files=t.files)


def _tokens_in_sql(t) -> DataFrame:
    """R2, R3 and R10 through views, by SQL alone."""
    surface.register_names(t.v_releases.select(F.col("name").alias("path")), "release")
    return t.spark.sql("SELECT release_group, video_codec, count(*) AS n FROM release_components JOIN release_attributes USING (component) WHERE level = 0 GROUP BY ALL")


_TOKENS_IN_SQL = f"""SELECT release_group, video_codec, count(*) AS n FROM (SELECT DISTINCT name, CASE WHEN shape <> 3 THEN grp END AS release_group,
 {_by("'x265'", "'HEVC'", "'H.264'", "'x265'", "'HEVC'", 'NULL')} AS video_codec FROM {{v_releases}}) q GROUP BY ALL"""


def _sketched(t) -> DataFrame:
    """Whether the median and the 90th percentile of merged daily sketches have the ranks they should, per class."""
    runs = L.sessions(t.v_logs, 3600).where("lines >= 2").select("day", "class", "seconds")
    merged = K.quantiles(K.merged(K.sketches(runs, "day", "class"), "class"), 0.5, 0.9)

    def holds(q: str, rank: float):
        below, upto = F.avg((F.col("seconds") < F.col(q)).cast("int")), F.avg((F.col("seconds") <= F.col(q)).cast("int"))
        return ((below - 0.0133 <= rank) & (rank <= upto + 0.0133)).alias(f"{q}_holds")

    return runs.join(merged, "class").groupBy("class", "n").agg(holds("q50", 0.5), holds("q90", 0.9))


_JOBS = """SELECT regexp_extract(context, '^(.*)_[0-9]+$', 1) AS class, count(*) AS n FROM (
 SELECT context, CAST(ts AS DATE) AS day, count(*) AS k, run FROM (SELECT *, sum(cut) OVER (PARTITION BY CAST(ts AS DATE), context ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY CAST(ts AS DATE), context ORDER BY ts) > 3600000000 THEN 1 ELSE 0 END AS cut FROM {v_logs}) a) b GROUP BY ALL) c WHERE k >= 2 GROUP BY 1"""


def _versioned(t) -> DataFrame:
    """A table by buckets after a listing of some directories: every seventh file of theirs is gone, every third changed."""
    path = new_folder(t.spark, "catalog")
    full = F.concat_ws("/", "root_path", F.nullif("dir", F.lit("")))
    files = t.files.select(full.alias("dir"), "filename", "size", "ctime", "mtime", F.lit(None).cast("timestamp").alias("metadata_scanned_at"), F.lit("h").alias("content_hash"), "file_id")
    V.create(files, path, 64)
    chosen = files.where(F.col("dir").endswith("/BUILDING"))
    listing = chosen.where("file_id % 7 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0))
    V.apply_listing(t.spark, path, listing, files.where(F.col("dir").endswith("/FURNITURE")), 64)
    return V.read(t.spark, path).select("dir", "filename", "mtime", "content_hash", "file_id")


_VERSIONED = """WITH c AS (SELECT *, root_path || CASE WHEN dir = '' THEN '' ELSE '/' || dir END AS d FROM {v_catalog})
 SELECT d AS dir, filename, mtime + CASE WHEN d LIKE '%/BUILDING' AND file_id % 3 = 0 THEN 1 ELSE 0 END AS mtime,
 CASE WHEN NOT (d LIKE '%/BUILDING' AND file_id % 3 = 0) THEN 'h' END AS content_hash, file_id FROM c
 WHERE NOT d LIKE '%/FURNITURE' AND NOT (d LIKE '%/BUILDING' AND file_id % 7 = 0)"""


def _drained(t) -> DataFrame:
    """Daily samples of servers, each up to the one that ends its run; flat is less than 0.97 a day, a slope that whole counts never have."""
    each = t.events.groupBy((F.col("user_id") % 40).cast("string").alias("server"), F.date_trunc("day", "ts").alias("ts")).agg(F.count("*").alias("total"))
    samples = each.withColumn("open", F.when(F.col("total") % 11 != 3, F.col("total") % 13))
    return D.drain(samples, 72.0, 0.97).select("server", "at", "total", "open", F.round("span_hours", 6).alias("span_hours"), "status")


_DRAINED = """WITH e AS (SELECT CAST(user_id % 40 AS VARCHAR) AS server, date_trunc('day', ts) AS t, count(*) AS total FROM {events} GROUP BY 1, 2),
 s AS (SELECT *, CASE WHEN total % 11 <> 3 THEN total % 13 END AS open FROM e),
 w AS (SELECT a.server, a.t, a.total, a.open, regr_slope(b.open, epoch(b.t) - epoch(a.t)) AS slope, (epoch(max(b.t)) - epoch(min(b.t))) / 3600 AS span
  FROM s a LEFT JOIN s b ON b.server = a.server AND b.open IS NOT NULL AND b.t BETWEEN a.t - INTERVAL 72 HOUR AND a.t GROUP BY ALL),
 f AS (SELECT *, CASE WHEN total = 0 OR open = 0 THEN 'done' WHEN span >= 72 AND abs(slope) * 86400 < 0.97 THEN 'plateau' ELSE 'running' END AS status FROM w),
 o AS (SELECT *, coalesce(max(CASE WHEN status <> 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY server ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM f)
 SELECT server, CAST(t AS TIMESTAMP) AS "at", total, open, CAST(nullif(span, 0) AS DOUBLE) AS span_hours, status FROM o WHERE ended = 0"""

# crc32 by bits in SQL, for ASCII texts
_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
_TABLE = f"step AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda c, i: {_STEP}) AS v FROM range(256) r(b)) q)"
_CRC = "upper(lpad(to_hex(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(p_name, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])), 4294967295)), 8, '0'))"


def _checked(t) -> DataFrame:
    """Names with the right checksum, with one of other content, and with none."""
    right, other = G.crc_hex(F.col("p_name").cast("binary")), F.lpad(F.hex("p_partkey"), 8, "0")
    tag = F.when(F.col("p_partkey") % 3 == 0, right).when(F.col("p_partkey") % 3 == 1, F.lower(other))
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.coalesce(F.concat(F.lit(" ["), tag, F.lit("]")), F.lit("")), F.lit(".mkv"))
    return P.verify_checksum(t.part.select(name.alias("filename"), F.col("p_name").cast("binary").alias("content")))


_CHECKED = f"""WITH {_TABLE}, p AS (SELECT p_partkey, {_CRC} AS good, lpad(to_hex(p_partkey), 8, '0') AS other FROM {{part}}, step)
 SELECT 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN ' [' || good || ']' WHEN 1 THEN ' [' || lower(other) || ']' ELSE '' END || '.mkv' AS filename,
 CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN upper(other) = good END AS verified FROM p"""


def _matches_back(t) -> DataFrame:
    """The CSV of matches, read back from its files."""
    path = new_folder(t.spark, "matches")
    W.write_matches_csv(t.files.where("size % 2 = 0"), path)
    return t.spark.read.schema("path string, size long, ctime long, mtime long").option("header", "true").csv(path)


def _plan_back(t) -> DataFrame:
    """A plan as JSON, edited between writing and reading: every third entry is skipped."""
    path = new_folder(t.spark, "plan")
    entries = t.orders.select(F.col("o_orderkey").cast("string").alias("source"), F.col("o_orderpriority").alias("title"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("conflict"))
    W.write_plan(entries.withColumn("status", F.when(F.col("source").cast("long") % 3 == 0, "skip").otherwise(F.col("status"))), entries.select("title").distinct(), path)
    back, titles = W.read_plan(entries.schema, entries.select("title").schema, t.spark, path)
    return back.join(titles, "title").select("source", "title", "status", "conflict")


def _blobs_back(t) -> DataFrame:
    """Contents stored once each over two writes, the second with the first one's as known."""
    path = new_folder(t.spark, "blobs")
    contents = lambda rows: rows.select(F.col("text").cast("binary").alias("content"))
    none = t.spark.createDataFrame([], "hash string")
    W.write_blobs(contents(t.documents.where("doc_id % 3 = 0 and text is not null")), none, path)
    W.write_blobs(contents(t.documents.where("text is not null")), t.spark.read.parquet(path).select("hash"), path)
    return t.spark.read.parquet(path).select("hash", F.octet_length("content").cast("long").alias("bytes"), F.col("prefix").cast("string").alias("prefix"))


def _ingest(t) -> DataFrame:
    """P1 over made releases: hard-link twins, registered files, ids, destinations, long names, same-size twins, one version, decisions, duplicates."""
    key = F.col("o_orderkey")
    title = F.when(key % 50 == 7, F.rpad(F.lit("long"), 260, "x")).otherwise(F.concat(F.lit("Show "), (F.col("o_custkey") % 300).cast("string")))
    sources = t.orders.select(
        key.cast("string").alias("source"), key.alias("pos"), (F.lit(10**9) + key).alias("size"), title.alias("title"), F.lit(2000).alias("year"),
        F.lit(1).alias("season"), (key % 40).cast("int").alias("episode"), F.when(key % 3 == 0, "G").alias("release_group"), F.lit(1).alias("version"), F.lit("mkv").alias("ext"),
        F.when(key % 20 < 2, F.lit(1)).alias("dev"), F.when(key % 20 < 2, F.floor(key / 20)).alias("inode"),
    )
    library = t.orders.where("o_orderkey % 31 = 0").select(F.lit("Elsewhere").alias("dir"), F.concat(F.lit("f"), key.cast("string")).alias("filename"), (F.lit(10**9) + key).alias("size"))
    ids = [("list", t.orders.where("o_custkey % 300 < 200").select(F.concat(F.lit("Show "), (F.col("o_custkey") % 300).cast("string")).alias("title"), (F.col("o_custkey") % 300).alias("pid")).distinct())]
    register = t.orders.where("o_orderkey % 13 = 0").select(key.cast("string").alias("source"))
    prior = t.orders.where("o_orderkey % 17 = 0").select(key.cast("string").alias("source"), F.lit("skip").alias("status"), F.lit(None).cast("string").alias("conflict"))
    return plans.ingest_plan(sources, library, ids, register, prior).select("source", "pid", "dest_dir", "dest_name", "status")


_INGEST = """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 7 THEN rpad('long', 260, 'x') ELSE 'Show ' || (o_custkey % 300) END AS title, o_orderkey % 40 AS episode,
  CASE WHEN o_orderkey % 20 < 2 THEN o_orderkey // 20 END AS inode FROM {orders}),
 w AS (SELECT * FROM s QUALIFY inode IS NULL OR row_number() OVER (PARTITION BY inode ORDER BY k) = 1),
 r AS (SELECT * FROM w WHERE k % 13 <> 0),
 i AS (SELECT DISTINCT 'Show ' || (o_custkey % 300) AS title, o_custkey % 300 AS pid FROM {orders} WHERE o_custkey % 300 < 200),
 d AS (SELECT r.*, i.pid, title || ' (2000)/Season 01' AS dest_dir, title || ' - S01E' || CASE WHEN episode < 10 THEN '0' ELSE '' END || episode || CASE WHEN k % 3 = 0 THEN ' [G]' ELSE '' END || '.mkv' AS dest_name FROM r LEFT JOIN i USING (title)),
 a AS (SELECT *, CASE WHEN strlen(dest_name) > 255 THEN 'skip' WHEN k % 31 = 0 THEN 'skip' ELSE 'ready' END AS s1 FROM d),
 v AS (SELECT *, CASE WHEN s1 = 'ready' AND row_number() OVER (PARTITION BY title, episode, s1 ORDER BY k) > 1 THEN 'skip' ELSE s1 END AS s2 FROM a),
 p AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'skip' ELSE s2 END AS s3 FROM v),
 f AS (SELECT *, CASE WHEN s3 = 'ready' AND row_number() OVER (PARTITION BY lower(dest_dir), lower(dest_name), s3 ORDER BY k) > 1 THEN 'skip' ELSE s3 END AS status FROM p)
 SELECT CAST(k AS VARCHAR) AS source, pid, dest_dir, dest_name, status FROM f"""


def _outcomes(t) -> DataFrame:
    """Every entry's decision, and whether the register holds it afterwards."""
    key = F.col("o_orderkey")
    plan = t.orders.select(key.cast("string").alias("source"), F.element_at(F.array(F.lit("ready"), F.lit("skip"), F.lit("conflict")), (key % 3 + 1).cast("int")).alias("status"), F.element_at(F.array(F.lit("keep"), F.lit("replace"), F.lit("both"), F.lit(None).cast("string")), (key % 4 + 1).cast("int")).alias("conflict"))
    done = t.orders.where("o_orderkey % 5 < 4").select(key.cast("string").alias("source"), (key % 5 < 3).alias("done"))
    old = t.orders.where("o_orderkey % 19 = 0").select(key.cast("string").alias("source"))
    decided, register = plans.apply_outcomes(plan, done, old)
    return decided.join(register.withColumn("registered", F.lit(True)), "source", "left").select("source", "decision", F.coalesce("registered", F.lit(False)).alias("registered"))


_OUTCOMES = """WITH d AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 1 THEN 'skipped' WHEN 2 THEN CASE o_orderkey % 4 WHEN 1 THEN 'replaced' WHEN 2 THEN 'both' ELSE 'kept' END
 ELSE CASE WHEN o_orderkey % 5 < 3 THEN 'copied' ELSE 'failed' END END AS decision FROM {orders})
 SELECT CAST(k AS VARCHAR) AS source, decision, k % 19 = 0 OR decision IN ('copied', 'replaced', 'both') AS registered FROM d"""


def _listing_back(t) -> DataFrame:
    """SRC1: the catalog as a listing in CSV, read back with directory and name taken from the path."""
    path = new_folder(t.spark, "listing")
    t.files.select(F.col("full_path").alias("path"), "size", "ctime", "mtime").write.csv(path, header=True)
    return R.read_listing(t.spark, path).select("dir", "filename", "size", "ctime", "mtime")


def _accented(t) -> DataFrame:
    """Names with accents and in capitals, counted as one; every fifth has another last letter."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.translate("p_name", "ae", "áé"))).otherwise(F.col("p_name"))
    return C.name_counts(t.part.select(F.concat(name, F.when(F.col("p_partkey") % 5 == 0, "x").otherwise("")).alias("name")), "name")


_ACCENTED = """SELECT min(name) AS name, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(translate(p_name, 'ae', 'áé')) ELSE p_name END || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END AS name
 FROM {part}) q GROUP BY strip_accents(lower(name))"""


def _problems(t) -> DataFrame:
    """Names as they are, with a bracket that nothing closes, and of a group alone."""
    broken = F.when(F.col("shape") == 2, F.concat(F.lit("["), "name")).when(F.col("shape") == 4, F.concat(F.lit("["), "grp", F.lit("].mkv"))).otherwise(F.col("name"))
    found = N.parse_components(t.v_releases.select(broken.alias("component")))
    return N.problems(found).select(F.col("component").alias("name"), F.array_join("reasons", ",").alias("reasons"))


_PROBLEMS = """SELECT DISTINCT CASE shape WHEN 2 THEN '[' || name WHEN 4 THEN '[' || grp || '].mkv' ELSE name END AS name,
 CASE shape WHEN 4 THEN 'no title' ELSE 'bracket is not closed' END AS reasons FROM {v_releases} WHERE shape IN (2, 4, 5)"""

#: The greedy choice of pairs, one after the other.
RECONCILED = """WITH RECURSIVE m AS (SELECT DISTINCT library, name, pid FROM {v_members}), z AS (SELECT library, name, count(*) AS k FROM m GROUP BY 1, 2),
 s AS (SELECT name, bool_or(library = 'A') AS in_a, bool_or(library = 'B') AS in_b FROM m GROUP BY 1),
 d AS (SELECT DISTINCT name FROM (SELECT name, pid FROM m WHERE name IN (SELECT name FROM s WHERE in_a AND in_b) GROUP BY 1, 2 HAVING count(*) = 1) q),
 p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS k FROM m a JOIN m b ON a.pid = b.pid AND a.library = 'A' AND b.library = 'B' AND a.name <> b.name GROUP BY 1, 2),
 j AS (SELECT name_a, name_b, p.k / (x.k + y.k - p.k) AS overlap FROM p JOIN z x ON x.library = 'A' AND x.name = name_a JOIN z y ON y.library = 'B' AND y.name = name_b),
 r AS (SELECT row_number() OVER (ORDER BY overlap DESC, name_a, name_b) AS i, * FROM j WHERE overlap >= 0.5 AND (name_a IN (SELECT name FROM s WHERE NOT in_b) OR name_b IN (SELECT name FROM s WHERE NOT in_a))),
 g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS ta, CAST([] AS VARCHAR[]) AS tb, false AS won
  UNION ALL SELECT r.i, CASE WHEN list_contains(ta, name_a) OR list_contains(tb, name_b) THEN ta ELSE list_append(ta, name_a) END,
   CASE WHEN list_contains(ta, name_a) OR list_contains(tb, name_b) THEN tb ELSE list_append(tb, name_b) END, NOT (list_contains(ta, name_a) OR list_contains(tb, name_b)) FROM g JOIN r ON r.i = g.i + 1),
 w AS (SELECT name_a, name_b, overlap FROM r JOIN g USING (i) WHERE won)
 SELECT CASE WHEN name IN (SELECT name FROM d) THEN 'drifted' ELSE 'identical' END AS kind, name, CAST(NULL AS VARCHAR) AS other, CAST(NULL AS DOUBLE) AS overlap, false AS review FROM s WHERE in_a AND in_b
 UNION ALL SELECT 'rename', name_a, name_b, overlap, overlap < 0.8 FROM w
 UNION ALL SELECT CASE WHEN in_a THEN 'only_a' ELSE 'only_b' END, name, NULL, NULL, false FROM s WHERE NOT (in_a AND in_b) AND name NOT IN (SELECT name_a FROM w UNION SELECT name_b FROM w)"""


def register(add: Callable) -> None:
    add("r10_assembled_names", _assembled, _ASSEMBLED)
    add("r9_token_kinds", _kinds, _KINDS)
    add("r11_token_paths", _paths, _PATHS)
    add("u1_sql_find", _find_in_sql, "SELECT full_path, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS ext FROM {v_catalog} WHERE regexp_matches(full_path, 'order_[0-9]*[48]\\.(flac|mkv)$')")
    add("u3_sql_components", _components_in_sql, "SELECT CAST(len(p) - i AS INT) AS level, p[i] AS component, count(*) AS n FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT list_filter(string_split(full_path, '/'), lambda x: trim(x) <> '') AS p FROM {v_catalog}) a) b GROUP BY ALL")
    add("u3_sql_tokens", _tokens_in_sql, _TOKENS_IN_SQL)
    add("a16_sketched_durations", _sketched, f"SELECT class, n, true AS q50_holds, true AS q90_holds FROM ({_JOBS}) q")
    add("i2_versioned_buckets", _versioned, _VERSIONED)
    add("i10_drain_monitor", _drained, _DRAINED)
    add("g26_crc_hex", lambda t: t.part.select("p_partkey", G.crc_hex(F.col("p_name").cast("binary")).alias("crc")), f"WITH {_TABLE} SELECT p_partkey, {_CRC} AS crc FROM {{part}}, step")
    add("j35_checked_names", _checked, _CHECKED)
    add("snk2_matches_csv", _matches_back, "SELECT full_path AS path, size, ctime, mtime FROM {v_catalog} WHERE size % 2 = 0")
    add("snk4_plan_json", _plan_back, "SELECT CAST(o_orderkey AS VARCHAR) AS source, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'skip' ELSE 'ready' END AS status, CAST(NULL AS VARCHAR) AS conflict FROM {orders}")
    add("snk5_blob_store", _blobs_back, "SELECT DISTINCT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes, substr(sha256(text), 1, 2) AS prefix FROM {documents} WHERE text IS NOT NULL")
    add("p1_ingest_plan", _ingest, _INGEST)
    add("p3_apply_outcomes", _outcomes, _OUTCOMES)
    add("src1_listing_csv", _listing_back, "SELECT regexp_extract(full_path, '^(.*)/[^/]*$', 1) AS dir, filename, size, ctime, mtime FROM {v_catalog}")
    add("u5_accents_and_case", _accented, _ACCENTED)
    add("r16_name_problems", _problems, _PROBLEMS)
