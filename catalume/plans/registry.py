"""Registered catalog queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as G
from ..operators import catalog as C
from ..operators import cue as Q
from ..operators import logs as L
from ..operators import match as M
from ..operators import overlap as O
from ..operators import planning as P
from ..operators import release as R
from ..operators import snapshot as S
from ..sources import writers as W
from . import mechanisms, steps
from .views import ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class _Tables:
    """Views by attribute: ``t.v_files``; ``t.files`` is the joined catalog built by the operators."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "files":
            return C.catalog(self.v_scans, self.v_dirs, self.v_files)
        return view(self.spark, self.sf_dir, name)


def tables(spark: SparkSession, sf_dir: str) -> _Tables:
    """The views over the tables of a folder, by attribute."""
    return _Tables(spark, sf_dir)


def _add(name: str, build: Callable[[_Tables], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_Tables(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = ctes(oracle)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the visible files by extension."""
    return C.ext_counts(_Tables(spark, sf_dir).files.where(C.visible()))


_SYS = "(dir || '/' || filename || '/') LIKE '%@eaDir/%'"
_SHOWN = f"NOT ({_SYS}) AND NOT starts_with(filename, '.')"
_EXT = "lower(regexp_extract(filename, '\\.([^.]+)$', 1))"
_BASE = "file_id, dir_id, scan_id, root_path, dir, filename, size, ctime, mtime, full_path"
_files = lambda df: df.select(*_BASE.split(", "))

_add("j1_catalog", lambda t: _files(t.files), f"SELECT {_BASE} FROM {{v_catalog}}")
_add("f2_find_regex", lambda t: _files(C.find(t.files, r"order_\d*[48]\.(?:flac|mkv)$")), f"SELECT {_BASE} FROM {{v_catalog}} WHERE regexp_matches(full_path, 'order_[0-9]*[48]\\.(flac|mkv)$')")
_add("f2_find_one_scan", lambda t: _files(C.find(t.files, "BUILDING", scan_id=2)), f"SELECT {_BASE} FROM {{v_catalog}} WHERE scan_id = 2 AND regexp_matches(full_path, 'BUILDING')")
_add("f3_find_insensitive", lambda t: _files(C.find(t.files, r"building/.*\.mp3$", insensitive=True)), f"SELECT {_BASE} FROM {{v_catalog}} WHERE regexp_matches(full_path, 'building/.*\\.mp3$', 'i')")
_add("f4_exclude_system", lambda t: _files(C.exclude_system(t.files)), f"SELECT {_BASE} FROM {{v_catalog}} WHERE NOT ({_SYS})")
_add("f5_exclude_components", lambda t: _files(C.exclude_components(t.files, ("BUILDING", "FURNITURE"))), f"SELECT {_BASE} FROM {{v_catalog}} WHERE NOT list_has_any(string_split(dir, '/'), ['BUILDING', 'FURNITURE'])")
_add("f6_hide_dotfiles", lambda t: _files(C.hide_dotfiles(t.files)), f"SELECT {_BASE} FROM {{v_catalog}} WHERE NOT starts_with(filename, '.')")
_add("f7_exclude_globs", lambda t: _files(t.files.where(~C.matches_globs(F.col("filename"), ("*.jpg", "order_1?.*", "order_[2-3]*")))), f"SELECT {_BASE} FROM {{v_catalog}} WHERE NOT regexp_matches(filename, '^.*\\.jpg$') AND NOT regexp_matches(filename, '^order_1.\\..*$') AND NOT regexp_matches(filename, '^order_[2-3].*$')")
_add("f8_visible", lambda t: _files(t.files.where(C.visible())), f"SELECT {_BASE} FROM {{v_catalog}} WHERE {_SHOWN}")
_add("f8_visible_with_system", lambda t: _files(t.files.where(C.visible(C.Visibility(show_system=True, globs=("*.jpg",))))), f"SELECT {_BASE} FROM {{v_catalog}} WHERE ({_SYS}) OR (NOT starts_with(filename, '.') AND NOT filename LIKE '%.jpg')")
_add("f9_list_under", lambda t: _files(C.list_under(t.files, "/VOL/europe/")), f"SELECT {_BASE} FROM {{v_catalog}} WHERE lower(full_path) LIKE '/vol/europe/%'")
_add("f10_find_by_suffix", lambda t: _files(C.find_by_suffix(t.files, ".mkv")), f"SELECT {_BASE} FROM {{v_catalog}} WHERE full_path LIKE '%.mkv' ORDER BY full_path LIMIT 1")
_add("f11_find_by_tag", lambda t: C.find_by_tag(t.files, t.v_tags, "priority", "urgent").select("full_path", "tag_name", "value"), "SELECT full_path, tag_name, value FROM {v_catalog} JOIN {v_tags} USING (file_id) WHERE tag_name = 'priority' AND lower(value) LIKE '%urgent%'")
_add("f12_where", lambda t: C.where(t.files, t.v_tags, "size > 100000 and (value = 'F' or value is null)"), "SELECT DISTINCT full_path, dir, filename FROM {v_catalog} LEFT JOIN {v_tags} USING (file_id) WHERE size > 100000 AND (value = 'F' OR value IS NULL)")
_stamp = lambda: F.when(F.col("file_id") % 5 == 0, F.lit(None).cast("timestamp")).otherwise(F.timestamp_seconds(F.lit(1700400000)))
_add("f13_needs_metadata", lambda t: C.needs_metadata(t.files.withColumn("metadata_scanned_at", _stamp()), ("flac", "mp3")).select("file_id", "full_path"), f"SELECT file_id, full_path FROM {{v_catalog}} WHERE {_EXT} IN ('flac', 'mp3') AND (file_id % 5 = 0 OR mtime > 1700400000)")
_add("f14_titles_matching", lambda t: P.titles_matching(t.part.select("p_partkey", F.col("p_name").alias("title")), "RED"), "SELECT p_partkey, p_name AS title FROM {part} WHERE contains(lower(p_name), 'red')")
_add("j2_file_tags", lambda t: C.file_tags(t.files, t.v_tags).select("full_path", "tag_name", "value"), "SELECT full_path, tag_name, value FROM {v_catalog} JOIN {v_tags} USING (file_id)")
_add("j8_orphan_blobs", lambda t: C.orphan_blobs(t.v_prev.select("hash", "size").distinct(), t.v_cur), "SELECT DISTINCT hash, size FROM {v_prev} WHERE hash NOT IN (SELECT hash FROM {v_cur} WHERE hash IS NOT NULL)")
_add("a1_totals", lambda t: C.totals(t.files), "SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {v_catalog}")
_add("a2_subtree_size", lambda t: C.subtree_size(t.files, "FRANCE"), "SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {v_catalog} WHERE dir = 'FRANCE' OR starts_with(dir, 'FRANCE/')")
_add("a3_dir_sizes", lambda t: C.dir_sizes(t.v_dirs, t.v_files), "SELECT scan_id, split_part(path, '/', 1) AS top_dir, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM {v_dirs} d LEFT JOIN {v_files} f ON f.dir_id = d.dir_id WHERE path <> '' GROUP BY 1, 2")
_add(
    "a4_usage",
    lambda t: C.usage(t.files),
    "SELECT scan_id, a.path AS at, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS n_files FROM {v_catalog} c JOIN {v_dirs} a USING (scan_id) WHERE a.path = '' OR c.dir = a.path OR starts_with(c.dir, a.path || '/') GROUP BY 1, 2",
)
_add("a5_ext_counts", lambda t: C.ext_counts(t.files), f"SELECT {_EXT} AS ext, count(*) AS n FROM {{v_catalog}} WHERE {_EXT} <> '' GROUP BY 1")
_add("a6_stats", lambda t: C.stats(t.files).select("n_files", "total_size", "size_text"), f"SELECT count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size, printf('%.2f ', sum(size) / pow(1024, least(floor(log(sum(size)) / log(1024)), 4))) || ['B', 'KiB', 'MiB', 'GiB', 'TiB'][CAST(least(floor(log(sum(size)) / log(1024)), 4) AS INT) + 1] AS size_text FROM {{v_catalog}} WHERE {_SHOWN}")
_add("a7_tree_counts", lambda t: C.tree_counts(t.v_dirs, t.files), f"SELECT d.scan_id, d.n_dirs, coalesce(f.n_files, 0) AS n_files FROM (SELECT scan_id, count(*) AS n_dirs FROM {{v_dirs}} WHERE NOT path LIKE '%@eaDir%' GROUP BY 1) d LEFT JOIN (SELECT scan_id, count(*) AS n_files FROM {{v_catalog}} WHERE {_SHOWN} GROUP BY 1) f USING (scan_id)")
_add("a8_blob_refs", lambda t: C.blob_refs(t.documents.select(F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"))), "SELECT sha256(text) AS hash, count(*) AS ref_count, max(n_chars) AS size FROM {documents} GROUP BY 1")
_add("a9_tag_values", lambda t: C.tag_values(t.lineitem.select(F.col("l_orderkey").alias("file_id"), F.lit("flag").alias("tag_name"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), F.col("l_returnflag").alias("value"))), "SELECT l_orderkey AS file_id, 'flag' AS tag_name, CASE WHEN count(*) = 1 THEN min(l_returnflag) ELSE '[' || string_agg('\"' || l_returnflag || '\"', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) || ']' END AS value FROM {lineitem} GROUP BY 1")
_add("w8_latest_scan", lambda t: C.latest_scan(t.v_scans), "SELECT * FROM {v_scans} WHERE finished_at IS NOT NULL ORDER BY finished_at DESC LIMIT 1")
_add("w1_first_wins", lambda t: C.first_wins(t.v_files.select("dir_id", "size", "file_id"), ["dir_id"], [F.desc("size"), "file_id"]), "SELECT dir_id, size, file_id FROM {v_files} QUALIFY row_number() OVER (PARTITION BY dir_id ORDER BY size DESC, file_id) = 1")
_add("o4_tree_rows", lambda t: C.tree_rows(t.files, t.v_dirs).select("scan_id", "path", "depth", "name", "is_dir"), f"SELECT scan_id, path, CAST(len(string_split(path, '/')) - 1 AS INT) AS depth, string_split(path, '/')[-1] AS name, is_dir FROM (SELECT scan_id, dir || '/' || filename AS path, false AS is_dir FROM {{v_catalog}} WHERE {_SHOWN} UNION ALL SELECT scan_id, path, true FROM {{v_dirs}} WHERE path <> '' AND NOT path LIKE '%@eaDir%') q")
_add("snk1_listing", lambda t: W.listing_rows(t.files), f"SELECT full_path AS path, size, ctime, mtime FROM {{v_catalog}} WHERE {_SHOWN}")

# snapshots
_add("j5_removed", lambda t: S.removed(t.v_prev, t.v_cur).select("file_id", "dir", "filename", "size", "hash"), "SELECT file_id, dir, filename, size, hash FROM {v_prev} p WHERE NOT EXISTS (SELECT 1 FROM {v_cur} c WHERE c.dir = p.dir AND c.filename = p.filename)")
_GONE = "g AS (SELECT * FROM {v_prev} p WHERE NOT EXISTS (SELECT 1 FROM {v_cur} c WHERE c.dir = p.dir AND c.filename = p.filename)), n AS (SELECT * FROM {v_cur} c WHERE NOT EXISTS (SELECT 1 FROM {v_prev} p WHERE c.dir = p.dir AND c.filename = p.filename))"
_MOVES = f"WITH {_GONE}, a AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY dir, filename) AS k FROM g WHERE hash IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY dir, filename) AS k FROM n WHERE hash IS NOT NULL)"
_add("j7_detect_moves", lambda t: S.detect_moves(S.removed(t.v_prev, t.v_cur), S.added(t.v_prev, t.v_cur)), f"{_MOVES} SELECT a.file_id, a.dir AS old_dir, a.filename AS old_filename, b.dir AS new_dir, b.filename AS new_filename, a.size, 'hash' AS matched_by FROM a JOIN b USING (size, hash, k)")
_add("j6_stale_dirs", lambda t: S.stale_dirs(t.v_prev.select(F.col("dir").alias("path")).distinct(), t.v_cur.select(F.col("dir").alias("path")).distinct()), "SELECT DISTINCT dir AS path FROM {v_prev} WHERE dir NOT IN (SELECT dir FROM {v_cur})")
_add("j31_freshness", lambda t: S.freshness(t.v_prev, t.v_cur, ["dir", "filename"], "hash"), "SELECT coalesce(p.dir, c.dir) AS dir, coalesce(p.filename, c.filename) AS filename, CASE WHEN p.filename IS NULL THEN 'new' WHEN c.filename IS NULL THEN 'removed' WHEN p.hash IS NOT DISTINCT FROM c.hash THEN 'same' ELSE 'changed' END AS state FROM {v_prev} p FULL JOIN {v_cur} c ON p.dir = c.dir AND p.filename = c.filename")
_add("i3_apply_snapshot_log", lambda t: S.apply_snapshot(t.v_prev, t.v_cur)[1].groupBy("change").agg(F.count("*").alias("n")), f"{_MOVES}, m AS (SELECT a.file_id, b.dir, b.filename FROM a JOIN b USING (size, hash, k)) SELECT 'moved' AS change, count(*) AS n FROM m UNION ALL SELECT 'removed', (SELECT count(*) FROM g) - (SELECT count(*) FROM m) UNION ALL SELECT 'added', (SELECT count(*) FROM n) - (SELECT count(*) FROM m)")
_add("i3_apply_snapshot_kept", lambda t: S.apply_snapshot(t.v_prev, t.v_cur)[0].join(t.v_prev.select("file_id"), "file_id", "left_semi").select("file_id", "dir", "filename"), f"{_MOVES} SELECT a.file_id, b.dir, b.filename FROM a JOIN b USING (size, hash, k) UNION ALL SELECT p.file_id, p.dir, p.filename FROM {{v_prev}} p JOIN {{v_cur}} c ON p.dir = c.dir AND p.filename = c.filename")

# logs
_JOB = "CASE WHEN regexp_matches(context, '^([A-Za-z0-9]+Job)(_|$|\\s)') THEN regexp_extract(context, '^([A-Za-z0-9]+Job)', 1) END"
_add("a10_daily_counts", lambda t: L.daily_counts(t.v_logs), "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (message = 'Get AniDB file info') AS lookups, count(*) FILTER (message = 'Found 2 episodes for file') AS recognized, count(*) FILTER (message = 'Found 0 episodes for file') AS notfound, CAST(0 AS BIGINT) AS process FROM {v_logs} GROUP BY 1")
_add("a11_hourly", lambda t: L.hourly(t.v_logs, 3), "WITH h AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM {v_logs} WHERE message = 'Get AniDB file info' GROUP BY 1, 2) SELECT day, hour, n, avg(n) OVER (PARTITION BY day) AS day_mean FROM h WHERE day IN (SELECT DISTINCT CAST(ts AS DATE) FROM {v_logs} ORDER BY 1 DESC LIMIT 3)")
_add("a12_throughput", lambda t: L.throughput(t.v_logs).select("day", "class", "tasks"), f"SELECT CAST(ts AS DATE) AS day, {_JOB} AS class, count(DISTINCT context) AS tasks FROM {{v_logs}} GROUP BY 1, 2")
_add("a14_active_median", lambda t: L.active_median(L.daily_counts(t.v_logs), 7), "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (message = 'Found 2 episodes for file') AS n FROM {v_logs} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM d) SELECT median(n) AS rate FROM r WHERE k BETWEEN 2 AND 8 AND n > 0")
_add(
    "a15_run_durations",
    lambda t: L.run_durations(t.v_logs, 3600).select("class", "runs", "single", F.round("mean_s", 3).alias("mean_s"), F.round("median_s", 3).alias("median_s"), F.round("p90_s", 3).alias("p90_s"), F.round("coverage", 6).alias("coverage")),
    f"WITH l AS (SELECT CAST(ts AS DATE) AS day, context, {_JOB} AS class, epoch_us(ts) AS t FROM {{v_logs}}), c AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600000000 THEN 1 ELSE 0 END AS cut FROM l WINDOW w AS (PARTITION BY day, context ORDER BY t)), r AS (SELECT *, sum(cut) OVER (PARTITION BY day, context ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM c), s AS (SELECT day, context, class, run, count(*) AS k, (max(t) - min(t)) / 1e6 AS sec FROM r GROUP BY 1, 2, 3, 4) SELECT class, count(*) FILTER (k >= 2) AS runs, count(*) FILTER (k = 1) AS single, round(avg(sec) FILTER (k >= 2), 3) AS mean_s, round(median(sec) FILTER (k >= 2), 3) AS median_s, round(quantile_cont(sec, 0.9) FILTER (k >= 2), 3) AS p90_s, round((count(*) FILTER (k >= 2)) / count(*), 6) AS coverage FROM s GROUP BY 1",
)
_add("a17_slope", lambda t: L.slope(t.events, 48.0).select(F.round(F.col("slope") * 1e6, 6).alias("slope_e6"), F.round("span_hours", 6).alias("span_hours")), "WITH p AS (SELECT epoch_us(ts) / 1e6 AS t, value AS v FROM {events}), n AS (SELECT * FROM p WHERE t >= (SELECT max(t) FROM p) - 48 * 3600) SELECT round(regr_slope(v, t - (SELECT max(t) FROM p)) * 1e6, 6) AS slope_e6, round((max(t) - min(t)) / 3600, 6) AS span_hours FROM n")
_add("a19_queue_counts", lambda t: L.queue_counts(t.events.select(F.col("event_type").alias("type"), (F.col("value") > 50).alias("running"), (F.col("user_id") % 7 == 0).alias("blocked"))), "SELECT event_type AS type, count(*) AS n, count(*) FILTER (value > 50) AS running, count(*) FILTER (user_id % 7 = 0) AS blocked FROM {events} GROUP BY 1")

# overlap
_PAIRS = "m AS (SELECT DISTINCT library, name, pid FROM {v_members}), s AS (SELECT library, name, count(*) AS k FROM m GROUP BY 1, 2), p AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS k FROM m a JOIN m b ON a.pid = b.pid AND a.library = 'A' AND b.library = 'B' GROUP BY 1, 2), j AS (SELECT name_a, name_b, p.k / (x.k + y.k - p.k) AS overlap FROM p JOIN s x ON x.library = 'A' AND x.name = name_a JOIN s y ON y.library = 'B' AND y.name = name_b)"
_add("j29_jaccard_pairs", lambda t: O.jaccard_pairs(t.v_members, same_names=True), f"WITH {_PAIRS} SELECT * FROM j WHERE overlap >= 0.5")
_add("j30_drift", lambda t: O.drift(t.v_members), "WITH m AS (SELECT DISTINCT library, name, pid FROM {v_members}), b AS (SELECT name FROM m GROUP BY 1 HAVING count(DISTINCT library) = 2) SELECT name, pid, min(library) AS only_in FROM m WHERE name IN (SELECT name FROM b) GROUP BY 1, 2 HAVING count(*) = 1")
_add("a24_reconcile", lambda t: O.reconcile(t.v_members), mechanisms.RECONCILED)
_add("o7_union_members", lambda t: O.union_members(t.v_members).select("name", F.array_join("libraries", "+").alias("libraries"), F.size("members").cast("long").alias("n_members")), "SELECT name, string_agg(DISTINCT library, '+' ORDER BY library) AS libraries, count(DISTINCT pid) AS n_members FROM {v_members} GROUP BY 1")

# names and matching
_NAMES = "SELECT name, season, episode, grp AS release_group, resolution FROM {v_names}"
_add("r5_r7_release_names", lambda t: R.parse_names(t.v_names.select("name"), 2026).select("name", "season", "episode", "release_group", "resolution"), _NAMES)
_add("r10_release_titles", lambda t: R.parse_names(t.v_names.select("name"), 2026).select("name", "title"), "SELECT name, series AS title FROM {v_names}")
_add("r11_release_paths", lambda t: R.parse_paths(t.v_names.select(F.concat_ws("/", "series", F.concat(F.lit("Season "), "season"), "name").alias("path")), 2026).select("path", "title", "season", "episode", "release_group", F.size("reasons").alias("n_reasons")), "SELECT series || '/Season ' || season || '/' || name AS path, series AS title, season, episode, grp AS release_group, 0 AS n_reasons FROM {v_names}")
_add("r3_r4_vocabulary", lambda t: R.vocabulary(R.lexical_tokens(R.structural_tokens(R.path_components(t.v_names.select(F.col("name").alias("path")))))).where("word_kind is not null").groupBy("word_kind").agg(F.count("*").alias("n")), "SELECT 'resolution' AS word_kind, count(*) AS n FROM {v_names} UNION ALL SELECT 'video_codec', count(*) FROM {v_names} UNION ALL SELECT 'medium', count(*) FROM {v_names}")
_add("r13_alias_components", lambda t: M.alias_components(t.v_titles), "WITH RECURSIVE e AS (SELECT DISTINCT a.series_id AS a, b.series_id AS b FROM {v_titles} a JOIN {v_titles} b USING (title)), c(s, r) AS (SELECT a, a FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.s) SELECT s AS series_id, min(r) AS component FROM c GROUP BY 1")
_add("j14_alias_expand", lambda t: M.alias_expand(None, t.v_titles, M.alias_components(t.v_titles)), "WITH RECURSIVE e AS (SELECT DISTINCT a.series_id AS a, b.series_id AS b FROM {v_titles} a JOIN {v_titles} b USING (title)), c(s, r) AS (SELECT a, a FROM e UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.s), k AS (SELECT s AS series_id, min(r) AS component FROM c GROUP BY 1), t AS (SELECT DISTINCT title, component FROM {v_titles} JOIN k USING (series_id)) SELECT DISTINCT a.title AS name, b.title FROM t a JOIN t b USING (component)")
_MATCH = """WITH s AS (SELECT *, nullif(lower(regexp_extract(release_group, '([\\w-]+)', 1)), '') AS g FROM {v_source}), d AS (SELECT *, nullif(lower(regexp_extract(release_group, '([\\w-]+)', 1)), '') AS g FROM {v_download}),
 n AS (SELECT s.path, s.g, d.path AS dl_path, d.g AS dg, row_number() OVER (PARTITION BY s.path ORDER BY abs(s.size - d.size), d.path) AS k FROM s JOIN d ON s.series_key = d.series_key AND s.season = d.season AND s.episode = d.episode),
 one AS (SELECT path, dl_path, 'episode' AS matched_by FROM n WHERE k = 1 AND (g IS NULL OR dg IS NULL OR g = dg)),
 two AS (SELECT s.path, min(d.path) AS dl_path, 'size' AS matched_by FROM s JOIN d ON s.size = d.size AND s.g = d.g WHERE s.season <> 0 AND s.path NOT IN (SELECT path FROM one) GROUP BY 1)
 SELECT * FROM one UNION ALL SELECT * FROM two"""
_add("j11_j12_match_downloads", lambda t: M.match_downloads(t.v_source, t.v_download), _MATCH)
_add("j13_enrich", lambda t: M.enrich(t.v_source, M.match_downloads(t.v_source, t.v_download), t.v_download, ["release_group"], ["remux"], []).select("path", "release_group", "remux"), f"WITH mm AS ({_MATCH.replace('WITH s AS', 'WITH s AS', 1)}) SELECT s.path, coalesce(nullif(d.release_group, ''), s.release_group) AS release_group, coalesce(d.remux, false) AS remux FROM {{v_source}} s LEFT JOIN mm ON mm.path = s.path LEFT JOIN {{v_download}} d ON d.path = mm.dl_path")
_add("j15_prefix_match", lambda t: M.prefix_match(t.part.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("key")).distinct(), t.part.select(F.substring(F.replace("p_name", F.lit(" "), F.lit("")), F.lit(1), (F.col("p_partkey") % 9 + 2).cast("int")).alias("index_key")).distinct()).distinct(), "WITH a AS (SELECT DISTINCT replace(p_name, ' ', '') AS key FROM {part}), b AS (SELECT DISTINCT substr(replace(p_name, ' ', ''), 1, CAST(p_partkey % 9 + 2 AS INT)) AS index_key FROM {part}) SELECT key, index_key FROM a JOIN b ON starts_with(key, index_key) OR starts_with(index_key, key)")
_plan = lambda t: t.v_source.select(F.col("path").alias("source"), "size", F.col("series_key").alias("title"), "season", "episode", F.when(F.col("episode") % 11 == 0, "present").otherwise("ready").alias("status"), F.col("series_key").alias("dest_dir"), F.concat(F.lit("S"), F.col("season"), F.lit("E"), F.col("episode"), F.lit(".mkv")).alias("dest_name"), F.lit("").alias("note"), F.struct("path").alias("pos"))
_PLAN = "SELECT path AS source, size, series_key AS title, season, episode, CASE WHEN episode % 11 = 0 THEN 'present' ELSE 'ready' END AS status, series_key AS dest_dir, 'S' || season || 'E' || episode || '.mkv' AS dest_name FROM {v_source}"
_add("w3_mark_dup_dests", lambda t: P.mark_dup_dests(_plan(t)).select("source", "status", "note"), f"WITH p AS ({_PLAN}), k AS (SELECT *, row_number() OVER w AS k, first_value(source) OVER w AS f FROM p WINDOW w AS (PARTITION BY lower(dest_dir), lower(dest_name), status = 'ready' ORDER BY source)) SELECT source, CASE WHEN status = 'ready' AND k > 1 THEN 'skip' ELSE status END AS status, CASE WHEN status = 'ready' AND k > 1 THEN 'same destination as ' || f ELSE '' END AS note FROM k")
_add("w4_one_version", lambda t: P.one_version(_plan(t)).select("source", "status"), f"WITH p AS ({_PLAN}) SELECT source, CASE WHEN status = 'ready' AND (bool_or(status = 'present') OVER (PARTITION BY title, season, episode) OR row_number() OVER (PARTITION BY title, season, episode, status = 'ready' ORDER BY source) > 1) THEN 'skip' ELSE status END AS status FROM p")
_add("a23_plan_summary", lambda t: P.plan_summary(P.mark_dup_dests(_plan(t))), f"WITH p AS ({_PLAN}), k AS (SELECT *, row_number() OVER (PARTITION BY lower(dest_dir), lower(dest_name), status = 'ready' ORDER BY source) AS k FROM p), s AS (SELECT CASE WHEN status = 'ready' AND k > 1 THEN 'skip' ELSE status END AS status FROM k) SELECT status, count(*) AS n, count(*) FILTER (status = 'skip') AS with_note FROM s GROUP BY 1")
_add("j9_narrow", lambda t: P.narrow(_plan(t).select("source", "size"), t.v_source.where("episode > 25").select(F.col("path").alias("source"))), "SELECT path AS source, size FROM {v_source} WHERE episode > 25")
_add("j10_drop_registered", lambda t: P.drop_registered(_plan(t).select("source", "size"), t.v_source.where("episode > 25").select(F.col("path").alias("source"))), "SELECT path AS source, size FROM {v_source} WHERE episode <= 25")
_add("a20_most_common", lambda t: P.most_common(t.orders.withColumn("pos", F.col("o_orderkey")), "o_custkey", "o_orderpriority", "pos"), "WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS seen FROM {orders} GROUP BY 1, 2) SELECT o_custkey, arg_min(o_orderpriority, (-n, seen)) AS o_orderpriority, CAST(sum(n) AS BIGINT) AS files FROM g GROUP BY 1")
_add("a21_majority", lambda t: P.majority(t.lineitem.select("l_orderkey", (F.col("l_quantity") > 25).alias("flag")), ["l_orderkey"], "flag").distinct(), "SELECT l_orderkey, count(*) FILTER (l_quantity > 25) > count(*) // 2 AS flag FROM {lineitem} GROUP BY 1")
_add("a22_split_extras", lambda t: P.split_extras(t.v_files.select(F.col("dir_id").alias("torrent_dir"), "filename", "size")), "WITH k AS (SELECT *, max(size) OVER (PARTITION BY dir_id) AS top FROM {v_files}), c AS (SELECT *, count(*) FILTER (size * 2 > top) OVER (PARTITION BY dir_id) AS alike, row_number() OVER (PARTITION BY dir_id ORDER BY size DESC, filename) AS r FROM k) SELECT dir_id AS torrent_dir, filename, size, CASE WHEN alike >= 3 THEN 'dropped' WHEN r = 1 THEN 'main' ELSE 'extra' END AS role FROM c")
_add("w7_take_regular", lambda t: P.take_regular(t.v_source.select(F.concat("series_key", F.lit("/"), "season").alias("series"), "episode", "path"), 3), "WITH r AS (SELECT series_key || '/' || season AS series, episode, path, row_number() OVER (PARTITION BY series_key, season ORDER BY episode, path) AS k FROM {v_source}) SELECT series, CAST(episode - min(episode) OVER (PARTITION BY series) + 1 AS INT) AS episode, path FROM r WHERE k <= 3")
_add("w14_fill_group", lambda t: P.fill_group(t.v_download.select("series_key", "season", "path", "release_group"), ["series_key", "season"]), "SELECT series_key, season, path, coalesce(nullif(release_group, ''), first_value(nullif(release_group, '') IGNORE NULLS) OVER (PARTITION BY series_key, season ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '') AS release_group FROM {v_download}")

# scalar functions
_add("g2_human_size", lambda t: t.v_files.select("file_id", G.human_size(F.col("size") * 37).alias("size_text")), "SELECT file_id, CASE WHEN size * 37 < 1024 THEN CAST(size * 37 AS VARCHAR) || ' B' WHEN size * 37 < 1048576 THEN printf('%.2f KiB', size * 37 / 1024.0) WHEN size * 37 < 1073741824 THEN printf('%.2f MiB', size * 37 / 1048576.0) ELSE printf('%.2f GiB', size * 37 / 1073741824.0) END AS size_text FROM {v_files}")
_add("g4_title_key", lambda t: t.supplier.select("s_suppkey", G.title_key(F.col("s_name")).alias("k")), "SELECT s_suppkey, trim(regexp_replace(lower(replace(s_name, '''', '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM {supplier}")
_add("g3_match_key", lambda t: t.customer.select("c_custkey", G.match_key(F.col("c_name")).alias("k")), "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k FROM {customer}")
_add("g18_ascii_mask", lambda t: t.documents.select("doc_id", G.ascii_mask(F.col("text")).alias("masked")), "SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS masked FROM {documents}")
_add("g25_content_hash", lambda t: t.documents.select("doc_id", G.content_hash(F.col("text")).alias("hash")), "SELECT doc_id, sha256(text) AS hash FROM {documents}")
_add("g28_sectors", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.ms_to_sectors((F.col("l_extendedprice") * 10).cast("long")).alias("sectors")), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((CAST(trunc(l_extendedprice * 10) AS BIGINT) * 75 + 500) // 1000 AS BIGINT) AS sectors FROM {lineitem}")
_JOBS = {"view": "GetAniDBFile", "click": "SearchTMDB", "signup": "SyncTrakt", "purchase": "HashFile", "error": "RefreshStats"}
_GROUPS = {"view": "AniDB", "click": "TMDB", "signup": "Trakt", "purchase": "File", "error": "Stats"}


def _jobs_by_group(t: _Tables) -> DataFrame:
    job = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(f"{v}Job_")) for k, v in _JOBS.items()], F.lit("PingJob_"))
    context = F.concat(job, F.col("user_id").cast("string"))
    return t.events.groupBy(G.job_group(L.job_class(context)).alias("grp")).agg(F.count("*").alias("jobs"))


_add(
    "g29_jobs_by_group",
    _jobs_by_group,
    "SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _GROUPS.items()) + " ELSE 'Other' END AS grp, count(*) AS jobs FROM {events} GROUP BY 1",
)
_add("g29_job_group", lambda t: t.v_logs.select("context", G.job_group(L.job_class(F.col("context"))).alias("grp")).distinct(), "SELECT DISTINCT context, 'Other' AS grp FROM {v_logs}")
_add("g24_episode_tag", lambda t: t.v_names.select("name", G.episode_tag(F.col("season"), F.col("episode")).alias("tag")), "SELECT name, 'S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') AS tag FROM {v_names}")


# cue sheets made of orders: one file a sheet, a track per line
def _sheets(t: _Tables) -> DataFrame:
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    line = lambda s, i: F.format_string('  TRACK %02d AUDIO\n    TITLE "%s"\n    INDEX 01 %02d:%02d:00', i + 1, s["l_returnflag"], (i + 1) * 4, (s["l_partkey"] % 60).cast("int"))
    rows = t.lineitem.repartition("l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order, "l_returnflag"))).alias("x"))
    body = F.array_join(F.transform("x", line), "\n")
    return rows.select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit('TITLE "Album"\nPERFORMER "Artist"\nFILE "a.flac" WAVE\n'), body).alias("content"))


_SHEET = "n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM {lineitem}), x AS (SELECT l_orderkey AS file_id, CAST(n AS INT) AS track, l_returnflag AS title, CAST(n * 4 * 4500 + l_partkey % 60 * 75 AS BIGINT) AS start FROM n)"
_durations = lambda t: _sheets(t).select("file_id", F.lit(1).cast("long").alias("file_no"), F.lit(500000).cast("long").alias("sectors"))
_add("c1_cue_tracks", lambda t: Q.cue_tracks(_sheets(t)).select("file_id", "track", "title", "index01", "album"), f"WITH {_SHEET} SELECT file_id, track, title, start AS index01, 'Album' AS album FROM x")
_add("c3_cue_toc", lambda t: Q.cue_toc(Q.cue_offsets(Q.cue_tracks(_sheets(t)), _durations(t))), f'WITH {_SHEET} SELECT file_id, track, start, coalesce(lead(start) OVER w, 500000) - start AS length, coalesce(lead(start) OVER w, 500000) - 1 AS "end" FROM x WINDOW w AS (PARTITION BY file_id ORDER BY start, track)')
_add("c4_cue_disc_ids", lambda t: Q.cue_disc_ids(Q.cue_offsets(Q.cue_tracks(_sheets(t)), _durations(t))))
_add("c5_cue_summary", lambda t: Q.cue_summary(Q.cue_tracks(_sheets(t))), f"WITH {_SHEET} SELECT file_id, 'Album' AS album, 'Artist' AS album_artist, track, title AS line FROM x")


# more joins and plan steps over the same views
def _text_logs(t: _Tables) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss:SSS")
    return t.v_logs.select(F.concat(F.lit("["), stamp, F.lit("] "), "level", F.lit("|"), "context", F.lit(" > "), "message").alias("value"))


_add("src5_parse_log_lines", lambda t: L.parse_log_lines(_text_logs(t)).groupBy("level", "message").agg(F.count("*").alias("n"), F.count_distinct("context").alias("contexts")), "SELECT level, message, count(*) AS n, count(DISTINCT context) AS contexts FROM {v_logs} GROUP BY 1, 2")
_add("a12_error_counts", lambda t: L.error_counts(t.events.select(F.to_date("ts").alias("day"), F.concat(F.lit("[2024-01-01 00:00:00:000] "), F.when(F.col("event_type") == "error", "Error").otherwise("Info"), F.lit("|ctx > Job a.HashFileJob failed")).alias("value")), "day"), "SELECT CAST(ts AS DATE) AS day, 'HashFileJob' AS class, count(*) AS errors FROM {events} WHERE event_type = 'error' GROUP BY 1")
_add("a12_group_pivot", lambda t: L.group_pivot(L.throughput(t.v_logs)), f"WITH t AS (SELECT CAST(ts AS DATE) AS day, {_JOB} AS class, count(DISTINCT context) AS tasks FROM {{v_logs}} GROUP BY 1, 2) SELECT day, CAST(0 AS BIGINT) AS \"File\", CAST(0 AS BIGINT) AS \"AniDB\", CAST(0 AS BIGINT) AS \"TMDB\", CAST(0 AS BIGINT) AS \"Trakt\", CAST(0 AS BIGINT) AS \"Stats\", CAST(sum(tasks) AS BIGINT) AS \"Other\" FROM t GROUP BY 1")
_add(
    "j16_phrase_domain",
    lambda t: M.phrase_domain(t.supplier.select(F.concat(F.lit("The "), "s_name", F.lit(" story")).alias("title")), t.supplier.where("s_suppkey % 3 = 0").select(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]+", " ")).alias("key"), F.concat(F.lit("d"), "s_nationkey").alias("domain"), F.col("s_suppkey").alias("pos"))),
    "WITH i AS (SELECT trim(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS key, 'd' || s_nationkey AS domain, s_suppkey AS pos FROM {supplier} WHERE s_suppkey % 3 = 0), t AS (SELECT DISTINCT 'The ' || s_name || ' story' AS title, 'the ' || trim(lower(regexp_replace(s_name, '[^A-Za-z0-9]+', ' ', 'g'))) || ' story' AS tk FROM {supplier}) SELECT title, arg_min(domain, pos) AS domain, 'contained' AS matched_by FROM t JOIN i ON contains(' ' || tk || ' ', ' ' || key || ' ') WHERE length(replace(key, ' ', '')) >= 8 GROUP BY 1",
)
_add(
    "j18_existing_dir",
    lambda t: M.existing_dir(t.part.select(F.col("p_brand").alias("block"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("title"), F.lit(2000).alias("year")), t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("/lib/"), "p_partkey").alias("dir"), F.concat("p_name", F.lit(" (2000) {id-"), "p_partkey", F.lit("}")).alias("name"))),
    "WITH j AS (SELECT a.p_brand AS block, a.p_partkey AS pos, '/lib/' || b.p_partkey AS dir FROM {part} a JOIN {part} b ON a.p_name = b.p_name AND b.p_partkey % 2 = 0) SELECT block, arg_min(dir, (pos, dir)) AS dir FROM j GROUP BY 1",
)
_add(
    "j19_size_twins",
    lambda t: M.size_twins(t.v_source.select(F.col("path").alias("source"), "size", F.col("series_key").alias("dest_dir"), F.lit("new.mkv").alias("dest_name")), t.v_download.select("size", F.col("series_key").alias("dir"), F.col("path").alias("filename"))),
    "WITH j AS (SELECT s.path AS source, s.series_key <> d.series_key AS far, d.series_key AS dir, d.path AS name FROM {v_source} s JOIN {v_download} d ON s.size = d.size) SELECT source, CASE WHEN arg_min(far, (far, dir, name)) THEN 'skip' ELSE 'conflict' END AS action, arg_min(dir || '/' || name, (far, dir, name)) AS twin FROM j GROUP BY 1",
)
_add(
    "j20_pick_candidate",
    lambda t: M.pick_candidate(
        t.customer.select(F.col("c_custkey").cast("string").alias("title"), F.array(F.lit("1 urgent")).alias("wanted"), F.lit(0).alias("year")),
        t.orders.select(F.col("o_custkey").cast("string").alias("title"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").alias("pid"), F.col("o_orderpriority").alias("name"), F.lit("").alias("original"), F.lit(0).alias("year")),
    ),
    "WITH g AS (SELECT CAST(c_custkey AS VARCHAR) AS title, count(o_orderkey) AS k, count(*) FILTER (o_orderpriority = '1-URGENT') AS e, min(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS best, min(o_orderkey) AS first_pid FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1) SELECT title, CASE WHEN e = 1 THEN 'exact' WHEN e = 0 AND k = 1 THEN 'high' WHEN k = 0 THEN 'none' ELSE 'ambiguous' END AS verdict, CASE WHEN e = 1 THEN best WHEN e = 0 AND k = 1 THEN first_pid END AS pid FROM g",
)
_add("j21_library_pick", lambda t: M.library_pick(t.orders.select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("pid")), t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("pid"))), "SELECT o_custkey AS title, min(o_orderkey) AS pid FROM {orders} WHERE o_orderkey % 5 = 0 GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1")
_add(
    "j22_resolve_ids",
    lambda t: M.resolve_ids(t.customer.select(F.col("c_custkey").alias("title")), [("config", t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("title"), (F.col("c_custkey") * 10).alias("pid"))), ("search", t.orders.select(F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("pid")))]),
    "SELECT c_custkey AS title, CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 10 ELSE min(o_orderkey) END AS pid, CASE WHEN c_custkey % 7 = 0 THEN 'config' WHEN min(o_orderkey) IS NOT NULL THEN 'search' END AS origin FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY 1",
)
_add(
    "j24_sidecars",
    lambda t: M.sidecars(t.v_names.select(F.lit("d").alias("dir"), F.col("name").alias("filename")), t.v_names.where("episode % 2 = 0").select(F.lit("d").alias("dir"), F.concat(F.regexp_replace("name", r"\.mkv$", ""), F.lit(".fr.srt")).alias("filename"))).select("filename", "subtitle", "language"),
    "SELECT name AS filename, substr(name, 1, length(name) - 4) || '.fr.srt' AS subtitle, 'fr' AS language FROM {v_names} WHERE episode % 2 = 0",
)
_add(
    "j25_episode_titles",
    lambda t: M.episode_titles(t.v_source.select("path", F.col("series_key").alias("series"), "season", F.array("episode", F.col("episode") + 1).alias("episodes")), t.v_names.select(F.col("series"), "season", F.col("episode").alias("number"), F.when(F.col("episode") % 2 == 0, F.concat(F.lit("E"), "episode")).otherwise("").alias("english"), F.concat(F.lit("R"), "episode").alias("romaji")).distinct()),
    "WITH e AS (SELECT DISTINCT series, season, episode AS number, CASE WHEN episode % 2 = 0 THEN 'E' ELSE 'R' END || episode AS t FROM {v_names}), f AS (SELECT path, series_key AS series, season, episode AS number, 0 AS pos FROM {v_source} UNION ALL SELECT path, series_key, season, episode + 1, 1 FROM {v_source}) SELECT path, string_agg(t, ' + ' ORDER BY pos) AS title FROM f JOIN e USING (series, season, number) GROUP BY 1",
)
_add(
    "j27_files_for_series",
    lambda t: M.files_for_series(t.v_source.select("path", F.when(F.col("episode") == 7, F.lit(None)).otherwise(F.col("series_key")).alias("title")), t.part.select(F.expr("substring(p_name, 1, p_partkey % 12 + 1)").alias("title"))).select("path"),
    "WITH i AS (SELECT DISTINCT regexp_replace(substr(p_name, 1, CAST(p_partkey % 12 + 1 AS INT)), '[^a-z0-9]', '', 'g') AS k FROM {part}), f AS (SELECT path, CASE WHEN episode = 7 THEN '' ELSE regexp_replace(lower(series_key), '[^a-z0-9]', '', 'g') END AS key FROM {v_source}) SELECT path FROM f WHERE key = '' OR EXISTS (SELECT 1 FROM i WHERE key = k OR (least(length(key), length(k)) >= 4 AND (starts_with(key, k) OR starts_with(k, key))))",
)
_add(
    "j28_existing_episode",
    lambda t: P.existing_episode(t.v_source.select(F.col("path").alias("source"), F.col("series_key").alias("dest_dir"), F.concat(F.lit("a S0"), "season", F.lit("E"), "episode").alias("dest_name")), t.v_download.select(F.col("series_key").alias("dir"), F.concat(F.lit("b s"), "season", F.lit("e0"), "episode").alias("filename")).distinct()).select("source", "existing"),
    "SELECT DISTINCT s.path AS source, 'b s' || d.season || 'e0' || d.episode AS existing FROM {v_source} s JOIN {v_download} d USING (series_key, season, episode)",
)
_add("j32_reuse_probe", lambda t: S.reuse_probe(t.files.select(F.col("full_path").alias("path"), "size", "mtime"), t.files.where("file_id % 3 <> 0").select(F.col("full_path").alias("path"), "size", (F.col("mtime") + F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("mtime")))[1].select("path"), "SELECT full_path AS path FROM {v_catalog} WHERE file_id % 3 = 0 OR file_id % 5 = 0")
_add("i4_replace_children", lambda t: S.replace_children(t.v_tags, t.v_tags.where("file_id % 10 = 1").select("file_id", "tag_name", F.lit("new").alias("value"))), "SELECT file_id, tag_name, CASE WHEN file_id % 10 = 1 THEN 'new' ELSE value END AS value FROM {v_tags}")
_add("w2_drop_twins", lambda t: P.drop_twins(t.v_files.select("file_id", F.when(F.col("file_id") % 4 == 0, F.lit(None)).otherwise(F.lit(1)).alias("dev"), (F.col("size") % 100).alias("inode"), F.col("file_id").alias("pos"))).select("file_id"), "SELECT file_id FROM {v_files} WHERE file_id % 4 = 0 UNION ALL SELECT min(file_id) FROM {v_files} WHERE file_id % 4 <> 0 GROUP BY size % 100")
_add("w5_merge_titles", lambda t: P.merge_titles(t.orders.select(F.col("o_orderkey").alias("block"), F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("pid"), F.lit("").alias("edition"))).select("block", "into"), "SELECT o_orderkey AS block, min(o_orderkey) OVER (PARTITION BY o_custkey) AS \"into\" FROM {orders}")
_add("w6_assign_special_numbers", lambda t: P.assign_special_numbers(t.v_source.select("path", F.col("series_key").alias("series"), F.lit("c").alias("counter"), F.col("episode").alias("pair"), F.lit("k").alias("kind")), t.v_source.select(F.col("series_key").alias("series"), F.col("season").alias("number"))).select("path", "number"), "SELECT path, CAST(100 + row_number() OVER (PARTITION BY series_key ORDER BY episode, path) - 1 AS INT) AS number FROM {v_source}")
_add("r15_download_keys", lambda t: R.download_keys(R.parse_names(t.v_names.select("name"), 2026).withColumn("path", F.col("name"))).select("path", "season", "episode").distinct(), "SELECT name AS path, season, episode FROM {v_names}")
_add("r14_group_titles", lambda t: R.group_titles(R.parse_names(t.v_names.select("name"), 2026).withColumn("path", F.col("name"))).select("group_key", "files"), "SELECT regexp_replace(lower(series), '[^a-z0-9]', '', 'g') AS group_key, count(*) AS files FROM {v_names} GROUP BY 1")
_add("r12_coverage", lambda t: R.coverage(t.v_names.select(F.col("name").alias("path"))).select("path", F.size("reasons").alias("n_reasons")), "SELECT name AS path, 0 AS n_reasons FROM {v_names}")
_add("src3_media_files", lambda t: R.media_files(t.files.select(F.col("full_path").alias("path")), include_audio=True), f"SELECT full_path AS path FROM {{v_catalog}} WHERE {_EXT} IN ('flac', 'mp3', 'mkv')")
_add("snk6_register_add", lambda t: W.register_add(t.v_source.select(F.col("path").alias("source")), t.v_download.select(F.col("path").alias("source"))), "SELECT path AS source FROM {v_source} UNION SELECT path FROM {v_download}")
_add("p5_catalog_reports", lambda t: _reports(t), "WITH u AS (SELECT scan_id, a.path AS \"at\", CAST(sum(size) AS BIGINT) AS total_size, count(*) AS n_files FROM {v_catalog} c JOIN {v_dirs} a USING (scan_id) WHERE a.path = '' OR c.dir = a.path OR starts_with(c.dir, a.path || '/') GROUP BY 1, 2) SELECT scan_id, \"at\", total_size, n_files, round(total_size / max(total_size) OVER (PARTITION BY scan_id), 9) AS share FROM u")


def _reports(t: _Tables) -> DataFrame:
    from .pipelines import catalog_reports

    return catalog_reports(t.files).withColumn("share", F.round("share", 9))


steps.register(_add)
mechanisms.register(_add)
