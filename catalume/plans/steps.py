"""Registered queries of single steps: plan checks, snapshot steps, source records and scalar functions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as G
from ..operators import logs as L
from ..operators import match as M
from ..operators import planning as P
from ..operators import snapshot as S
from ..sources import readers as D
from ..sources import writers as W

_AT = datetime(2024, 2, 1)


def _plan(t):
    """Entries made of orders: every tenth has no id, every seventh no name, names repeat within a customer."""
    key = F.col("o_orderkey")
    return t.orders.select(
        key.cast("string").alias("source"),
        F.round("o_totalprice").cast("long").alias("size"),
        F.when(key % 10 != 0, key).alias("pid"),
        F.col("o_custkey").cast("string").alias("dest_dir"),
        F.when(key % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("dest_name"),
        F.when(key % 3 == 0, "conflict").when(key % 5 == 0, "skip").otherwise("ready").alias("status"),
        F.when(key % 3 == 0, "keep").alias("conflict"),
    )


_PLAN = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS source, o_orderkey AS k, CAST(round(o_totalprice) AS BIGINT) AS size, CAST(o_custkey AS VARCHAR) AS dir,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS name,
 CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' WHEN o_orderkey % 5 = 0 THEN 'skip' ELSE 'ready' END AS status FROM {orders})"""


def _validate(t):
    plan = _plan(t)
    key = F.col("source").cast("long")
    listing = plan.where(key % 11 != 0).select("source", (F.col("size") + F.when(key % 13 == 0, 1).otherwise(0)).alias("size"))
    one = plan.where("dest_name <> ''").groupBy("dest_dir", "dest_name").agg(F.min("size").alias("size"))
    return P.validate_plan(plan, listing, one.select(F.concat_ws("/", "dest_dir", "dest_name").alias("dest"), "size"))


_VALIDATE = f"""WITH {_PLAN}, d AS (SELECT dir, name, min(size) AS size FROM p WHERE name <> '' GROUP BY 1, 2),
 l AS (SELECT *, count(*) OVER (PARTITION BY lower(dir || '/' || name)) AS claims FROM p WHERE status <> 'skip')
 SELECT source, 'needs id' AS problem FROM l WHERE k % 10 = 0
 UNION ALL SELECT source, 'source missing' FROM l WHERE k % 11 = 0
 UNION ALL SELECT source, 'size changed' FROM l WHERE k % 11 <> 0 AND k % 13 = 0
 UNION ALL SELECT source, 'no destination' FROM l WHERE name = ''
 UNION ALL SELECT source, 'duplicate destination' FROM l WHERE name <> '' AND claims > 1
 UNION ALL SELECT source, CASE WHEN l.size = d.size THEN 'already done' ELSE 'destination appeared' END FROM l JOIN d USING (dir, name)"""


def _carried(t):
    key = F.col("source").cast("long")
    prior = _plan(t).select("source", F.when(key % 4 == 0, "skip").otherwise("ready").alias("status"), F.when(key % 2 == 0, "replace").alias("conflict"))
    return P.carry_decisions(_plan(t), prior).select("source", "status", "conflict")


_CARRIED = f"""WITH {_PLAN} SELECT source, CASE WHEN k % 4 = 0 THEN 'skip' ELSE status END AS status,
 CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'replace' ELSE 'keep' END END AS conflict FROM p"""


def _checked(t):
    crc = G.crc_hex(F.coalesce("text", F.lit("")))
    tag = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" ["), crc, F.lit("]"))).when(F.col("doc_id") % 3 == 1, "").otherwise(" [not-a-sum] (0000000G)")
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), tag).alias("filename"), F.coalesce("text", F.lit("")).alias("content"))
    found = P.verify_checksum(files)
    return found.select(F.regexp_extract("filename", r"^(d\d+)", 1).alias("name"), "verified")


def _conflicts(t):
    cols = [F.col("p_partkey").alias("dest"), F.col("p_type").alias("medium"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("codec")]
    ours = t.part.select(*cols, F.col("p_brand").alias("release_group"), F.array("p_name", "p_brand", "p_name").alias("audio"))
    group = F.when(F.col("p_partkey") % 3 == 0, "other").otherwise(F.col("p_brand"))
    return P.conflict_matches(ours, t.part.select(*cols, group.alias("release_group"), F.array("p_brand", "p_name").alias("audio")))


def _own(t):
    key = F.col("o_orderkey")
    files = t.orders.select(
        key.alias("path"),
        F.col("o_custkey").alias("torrent_dir"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("/"), "o_orderpriority").alias("group_key"),
        (key % 50).alias("title"),
    )
    domains = t.orders.select((key % 50).alias("title")).distinct().select("title", F.when(F.col("title") < 5, "film").otherwise("series").alias("domain"))
    return P.drop_foreign(files, domains, "series").select("path")


_OWN = """WITH f AS (SELECT o_orderkey AS path, o_orderkey % 50 < 5 AS x, o_custkey AS d, o_custkey || '/' || o_orderpriority AS g FROM {orders}),
 w AS (SELECT *, max(x) OVER (PARTITION BY d) AS dx FROM f), v AS (SELECT *, min(dx) OVER (PARTITION BY g) AS gx FROM w) SELECT path FROM v WHERE NOT x AND NOT gx"""


def _upserted(t):
    stamped = t.files.select("file_id", "dir", "filename", "size", "ctime", "mtime", F.lit(_AT).alias("metadata_scanned_at"), F.lit("h").alias("content_hash"))
    prev = stamped.where("file_id % 5 <> 0")
    cur = t.files.where("file_id % 7 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("file_id") % 3 == 0, 1).otherwise(0))
    return S.upsert_files(prev, cur).select("file_id", "dir", "filename", "mtime", "content_hash")


_UPSERTED = """WITH t AS (SELECT max(file_id) AS top FROM {v_catalog} WHERE file_id % 5 <> 0), c AS (SELECT * FROM {v_catalog} WHERE file_id % 7 <> 0)
 SELECT file_id, dir, filename, mtime + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN file_id % 3 <> 0 THEN 'h' END AS content_hash FROM c WHERE file_id % 5 <> 0
 UNION ALL SELECT top + row_number() OVER (ORDER BY dir, filename), dir, filename, mtime + CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END, NULL FROM c, t WHERE file_id % 5 = 0"""


def _marked(t):
    files = t.v_files.select("file_id", F.lit(None).cast("timestamp").alias("metadata_scanned_at"), F.when(F.col("file_id") % 2 == 0, "old").alias("content_hash"))
    done = t.v_files.where("file_id % 4 < 2").select("file_id", F.when(F.col("file_id") % 4 == 0, "new").alias("content_hash"))
    return S.mark_scanned(files, done, _AT).select("file_id", F.col("metadata_scanned_at").isNotNull().alias("stamped"), "content_hash")


def _lifecycle(t):
    scans = t.v_scans.select("scan_id", "run_type", "root_path", F.col("finished_at").alias("started_at"), "finished_at")
    out = S.finish_scan(S.begin_scan(scans, 9, "ASIA", "/vol/new", _AT), 4, _AT)
    return out.select("scan_id", "run_type", "root_path", F.col("finished_at").isNotNull().alias("finished"))


def _members(t):
    tags = t.nation.select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("tag"), F.when(F.col("n_regionkey") < 2, "A").otherwise("B").alias("library"))
    taggings = t.customer.select(F.col("c_nationkey").alias("tag_id"), F.col("c_custkey").alias("item_id"))
    key = F.col("c_custkey")
    guid = F.when(key % 3 == 0, F.concat(F.lit("x://anidb-"), key.cast("string"))).when(key % 3 == 1, F.concat(F.lit("com.thetvdb://"), key.cast("string"))).otherwise("local://")
    items = t.customer.select(key.alias("item_id"), guid.alias("guid"), F.col("c_name").alias("title"), F.lit(2000).alias("year"))
    return D.collection_members(tags, taggings, items)


def _movies(t):
    def result(name, other, date, key):
        return F.struct(key.cast("string").alias("id"), name.alias("title"), other.alias("original_title"), F.lit("n").alias("name"), F.lit("o").alias("original_name"), date.alias("release_date"), F.lit("2001-01-01").alias("first_air_date"))

    key = F.col("p_partkey")
    none = F.lit(None).cast("string")
    pair = F.array(result(F.col("p_name"), F.col("p_brand"), F.lit("1999-05-01"), key), result(none, none, none, -1 - key))
    return D.movie_json(t.part.select(pair.alias("results"))).select("rank", "pid", "name", "original")


def _library(t):
    none = F.lit(None).cast("array<string>")
    return M.library_index(t.part.select(F.concat(F.lit("F"), "p_partkey").alias("folder"), F.col("p_name").alias("title"), none.alias("alternates"), F.lit(2000).alias("year"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("item_id")))


_LIBRARY = """WITH k AS (SELECT 'f' || p_partkey AS key, p_partkey AS i FROM {part} UNION ALL SELECT lower(p_name) || ' (2000)', p_partkey FROM {part}
 UNION ALL SELECT '~' || p_name, p_partkey FROM {part} UNION ALL SELECT '~' || replace(p_name, ' ', ''), p_partkey FROM {part}) SELECT key, min(i) AS item_id FROM k GROUP BY 1"""


def _ssot(t):
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return W.collections_ssot(t.v_members).select("name", F.size("members").cast("long").alias("n"), listed("only_a"), listed("only_b"))


_SSOT = """WITH m AS (SELECT DISTINCT library, name, pid FROM {v_members}), b AS (SELECT name FROM m GROUP BY 1 HAVING count(DISTINCT library) = 2),
 d AS (SELECT name, pid, min(library) AS side FROM m WHERE name IN (SELECT name FROM b) GROUP BY 1, 2 HAVING count(*) = 1),
 g AS (SELECT name, coalesce(string_agg(pid, ',' ORDER BY pid) FILTER (side = 'A'), '') AS only_a, coalesce(string_agg(pid, ',' ORDER BY pid) FILTER (side = 'B'), '') AS only_b FROM d GROUP BY 1)
 SELECT name, count(DISTINCT pid) AS n, any_value(only_a) AS only_a, any_value(only_b) AS only_b FROM m LEFT JOIN g USING (name) GROUP BY 1"""


def _dirs(t, gone: int, moved: int):
    files = t.files.where(F.col("file_id") % gone != 0).groupBy(F.concat_ws("/", "root_path", "dir").alias("path"))
    return files.agg(F.max(F.col("mtime") % moved).alias("mtime"))


def register(add: Callable) -> None:
    """Add every query of this module by ``add(name, build, sql)``."""
    sample = lambda: F.concat(F.when(F.col("file_id") % 7 == 0, "sample-").otherwise(""), "filename")
    add("f15_drop_samples", lambda t: P.drop_samples(t.v_files.select("file_id", sample().alias("filename"))), "SELECT file_id, filename FROM {v_files} WHERE file_id % 7 <> 0")
    wide = lambda: F.repeat(F.lit("é"), (F.col("size") % 200).cast("int"))
    add("f16_too_long", lambda t: P.too_long(t.v_files.select("file_id", wide().alias("dest_name"))).select("file_id"), "SELECT file_id FROM {v_files} WHERE size % 200 >= 128")
    add("j23_validate_plan", _validate, _VALIDATE)
    add("j34_carry_decisions", _carried, _CARRIED)
    add("j35_verify_checksum", _checked, "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN true END AS verified FROM {documents}")
    add("j36_conflict_matches", _conflicts, "SELECT p_partkey AS dest, p_partkey % 3 <> 0 AS same FROM {part}")
    add("j17_drop_foreign", _own, _OWN)
    words = lambda t: t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    kinds = lambda t: t.part.select(F.element_at(F.split("p_name", " "), 1).alias("word")).distinct().where("word < 'm'").withColumn("kind", F.lit("first"))
    add(
        "j37_tag_tokens",
        lambda t: M.tag_tokens(words(t), kinds(t)),
        "WITH k AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM {part}), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM {part}) SELECT p_partkey, token, CASE WHEN word IS NOT NULL THEN 'first' END AS kind FROM w LEFT JOIN k ON word = lower(token) AND word < 'm'",
    )
    drain = lambda: F.when(F.col("o_orderkey") % 3 == 0, -0.5).otherwise(0.25)
    rate = lambda: F.when(F.col("o_orderkey") % 2 == 0, 50.0).otherwise(0.0)
    add(
        "a18_eta_seconds",
        lambda t: t.orders.select("o_orderkey", F.round(L.eta_seconds(F.col("o_totalprice"), drain(), rate()), 3).alias("eta")),
        "WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 0.5 WHEN o_orderkey % 2 = 0 THEN o_totalprice / 50 * 86400 END AS s FROM {orders}) SELECT o_orderkey, round(CASE WHEN s > 0 AND s <= 315360000 THEN s END, 3) AS eta FROM e",
    )
    add(
        "a27_scan_stats",
        lambda t: S.scan_stats(S.freshness(t.v_prev, t.v_cur, ["dir", "filename"], "hash")),
        "SELECT count(*) FILTER (p.filename IS NOT NULL AND c.filename IS NOT NULL AND p.hash IS NOT DISTINCT FROM c.hash) AS cached, count(*) FILTER (c.filename IS NOT NULL AND (p.filename IS NULL OR p.hash IS DISTINCT FROM c.hash)) AS scanned, count(*) FILTER (c.filename IS NULL) AS removed FROM {v_prev} p FULL JOIN {v_cur} c ON p.dir = c.dir AND p.filename = c.filename",
    )
    side = "SELECT root_path || '/' || dir AS path, max(mtime % {m}) AS mtime FROM {{v_catalog}} WHERE file_id % {g} <> 0 GROUP BY 1"
    add("i1_changed_dirs", lambda t: S.changed_dirs(_dirs(t, 5, 1000), _dirs(t, 7, 1000)), f"SELECT b.* FROM ({side.format(m=1000, g=7)}) b LEFT JOIN ({side.format(m=1000, g=5)}) a USING (path) WHERE a.mtime IS DISTINCT FROM b.mtime")
    add("i2_upsert_files", _upserted, _UPSERTED)
    add("i5_scan_lifecycle", _lifecycle, "SELECT scan_id, run_type, root_path, finished_at IS NOT NULL OR scan_id = 4 AS finished FROM {v_scans} WHERE run_type <> 'ASIA' UNION ALL SELECT 9, 'ASIA', '/vol/new', false")
    add("i6_mark_scanned", _marked, "SELECT file_id, file_id % 4 < 2 AS stamped, CASE WHEN file_id % 4 = 0 THEN 'new' WHEN file_id % 2 = 0 THEN 'old' END AS content_hash FROM {v_files}")
    guid = "CASE c_custkey % 3 WHEN 0 THEN 'anidb' WHEN 1 THEN 'tvdb' ELSE 'unknown' END"
    add("src10_collection_members", _members, f"SELECT CASE WHEN n_regionkey < 2 THEN 'A' ELSE 'B' END AS library, n_name AS name, {guid} AS provider, CASE WHEN c_custkey % 3 < 2 THEN c_custkey END AS pid, c_name AS title, 2000 AS year FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey")
    add("src8_movie_results", _movies, "SELECT 0 AS rank, p_partkey AS pid, p_name AS name, p_brand AS original FROM {part} UNION ALL SELECT 1, -1 - p_partkey, 'n', 'o' FROM {part}")
    add("src11_library_index", _library, _LIBRARY)
    add("snk7_collections", _ssot, _SSOT)
    named = lambda t: (t.nation.select(F.col("n_name").alias("name")), t.region.select(F.col("r_name").alias("name")), t.supplier.select(F.col("s_name").alias("name")))
    add("o6_union_sources", lambda t: D.union_sources(*named(t)), "SELECT n_name AS name, 0 AS rank FROM {nation} UNION ALL SELECT r_name, 1 FROM {region} UNION ALL SELECT s_name, 2 FROM {supplier}")

    # scalar functions
    brand = lambda: F.concat("p_name", F.lit(": "), "p_brand", F.lit("/a:b"))
    number = lambda: F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 1)
    scalars = {
        "g5_word_prefix": (lambda: G.word_prefix(F.col("p_name"), F.substring("p_name", F.lit(1), F.col("p_size") % 9)), "p_name = substr(p_name, 1, p_size % 9) OR starts_with(p_name, substr(p_name, 1, p_size % 9) || ' ')"),
        "g6_phrase_in": (lambda: G.phrase_in(F.col("p_name"), F.element_at(F.split("p_type", " "), 1)) | G.phrase_in(F.col("p_name"), F.lit("widget")), "contains(' ' || p_name || ' ', ' ' || split_part(p_type, ' ', 1) || ' ') OR contains(' ' || p_name || ' ', ' widget ')"),
        "g9_strip_year": (lambda: G.strip_year(F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1960).cast("string"), F.lit(")"))), "CASE WHEN p_size + 1960 < 2100 THEN p_name ELSE p_name || ' (' || (p_size + 1960) || ')' END"),
        "g10_safe_path": (lambda: G.safe_path(brand()), "p_name || ' - ' || p_brand || ' - a-b'"),
        "g16_lenient_int": (lambda: G.lenient_int(F.concat("p_brand", F.lit("-x"), F.col("p_size").cast("string"))), "CAST(substr(p_brand, 7) || p_size AS BIGINT)"),
        "g23_dual_title": (lambda: G.dual_title(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_brand"))), "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' [' || p_brand || ']' END"),
        "g30_generic_title": (lambda: G.generic_title(F.concat(F.lit("Episode "), "p_size"), number()), "p_partkey % 2 = 0"),
        "g31_site_token": (lambda: G.site_token(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("www."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".com"))).otherwise(F.col("p_name"))), "p_size % 2 = 0"),
        "g32_year_of": (lambda: G.year_of(F.concat((F.col("p_size") + 1900).cast("string"), F.lit("-01-02"))), "CAST(p_size + 1900 AS INT)"),
    }
    for name, (column, sql) in scalars.items():
        add(name, lambda t, c=column: t.part.select("p_partkey", c().alias("v")), f"SELECT p_partkey, {sql} AS v FROM {{part}}")
