"""Catalog-shaped views over the driver tables, in SQL that Spark and DuckDB both run.

``{name}`` stands for a table or another view. ``view`` builds the Spark DataFrame,
``ctes`` the WITH clause for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_scans": """SELECT CAST(r_regionkey AS BIGINT) AS scan_id, r_name AS run_type, '/vol/' || r_name AS root_path,
  CASE WHEN r_regionkey = 4 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + r_regionkey * INTERVAL '1' DAY END AS finished_at FROM {region}""",
    "v_segments": "SELECT seg, CAST(ROW_NUMBER() OVER (ORDER BY seg) AS BIGINT) AS k FROM (SELECT DISTINCT c_mktsegment AS seg FROM {customer}) q",
    "v_dirs": """SELECT CAST(r_regionkey AS BIGINT) * 1000000 AS dir_id, CAST(r_regionkey AS BIGINT) AS scan_id, '' AS path FROM {region}
  UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000 + (n_nationkey + 1) * 1000, CAST(n_regionkey AS BIGINT), n_name FROM {nation}
  UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000 + (n_nationkey + 1) * 1000 + m.k, CAST(n_regionkey AS BIGINT), n_name || '/' || m.seg FROM {nation} CROSS JOIN {v_segments} m
  UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000 + (n_nationkey + 1) * 1000 + 900, CAST(n_regionkey AS BIGINT), n_name || '/@eaDir' FROM {nation}
  UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 1000000 + (n_nationkey + 1) * 1000 + 901, CAST(n_regionkey AS BIGINT), n_name || '/empty' FROM {nation}""",
    "v_files": """SELECT o.o_orderkey AS file_id, d.dir_id,
  CASE WHEN o.o_orderkey % 97 = 0 THEN '.hidden-' ELSE '' END || 'order_' || CAST(o.o_orderkey AS VARCHAR(20)) ||
  CASE o.o_orderkey % 6 WHEN 0 THEN '.flac' WHEN 1 THEN '.MP3' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.jpg' WHEN 4 THEN '.mkv' ELSE '' END AS filename,
  CAST(ROUND(o.o_totalprice) AS BIGINT) AS size, CAST(1700000000 + (o.o_orderkey * 31) % 864000 AS BIGINT) AS ctime,
  CAST(1700000000 + (o.o_orderkey * 37) % 864000 AS BIGINT) AS mtime
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
  JOIN {v_dirs} d ON d.scan_id = n.n_regionkey AND d.path = n.n_name || CASE WHEN o.o_orderkey % 41 = 0 THEN '/@eaDir' ELSE '/' || c.c_mktsegment END""",
    "v_tags": """SELECT o_orderkey AS file_id, 'status' AS tag_name, o_orderstatus AS value FROM {orders} WHERE o_orderkey % 3 <> 0
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "v_names": """SELECT DISTINCT p_name AS series, CAST(l_linenumber AS INT) AS season, CAST(l_quantity AS INT) AS episode,
  'GRP' || substr(p_brand, 7) AS grp, CASE p_size % 3 WHEN 0 THEN '480p' WHEN 1 THEN '720p' ELSE '1080p' END AS resolution,
  CASE l_orderkey % 2 WHEN 0 THEN
   replace(p_name, ' ', '.') || '.S0' || CAST(l_linenumber AS VARCHAR(9)) || 'E' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), 2, '0') || '.' ||
   CASE p_size % 3 WHEN 0 THEN '480p' WHEN 1 THEN '720p' ELSE '1080p' END || '.BluRay.x265-GRP' || substr(p_brand, 7) || '.mkv'
  ELSE '[GRP' || substr(p_brand, 7) || '] ' || p_name || ' - S0' || CAST(l_linenumber AS VARCHAR(9)) || 'E' || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), 2, '0') ||
   ' [WEB ' || CASE p_size % 3 WHEN 0 THEN '480p' WHEN 1 THEN '720p' ELSE '1080p' END || ' HEVC].mkv' END AS name
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber < 10""",
    # release names of six shapes, each made of known attributes
    "v_releases": """SELECT *, CASE shape
   WHEN 0 THEN replace(series, ' ', '.') || '.S0' || s || 'E' || e || '.BluRay.1080p.TrueHD.5.1.x265-' || grp || '.mkv'
   WHEN 1 THEN '[' || grp || '] ' || series || ' - ' || e || 'v2 [WEB 720p HEVC][AAC][' || crc || '].mkv'
   WHEN 2 THEN replace(series, ' ', '.') || '.S0' || s || 'E' || e || '.The.First.Try.1080p.WEB-DL.DUAL.AAC2.0.H.264-' || grp || '.mkv'
   WHEN 3 THEN series || ' (196' || s || ') (1080p BluRay x265 10bit EAC3 2.0 r00t)'
   WHEN 4 THEN '[' || grp || ' BD] ' || series || '(第' || s || '期) 第' || e || '話「' || upper(series) || '」(1920x1080 HEVC 10bit FLAC).mkv'
   ELSE '[' || grp || '] ' || series || ' [Alt (x [y]) z] - ' || e || ' (BD 1080p.mkv' END AS name
  FROM (SELECT DISTINCT p_name AS series, CAST(l_linenumber AS INT) AS season, CAST(l_quantity AS INT) AS episode, CAST(l_orderkey % 6 AS INT) AS shape,
   'GRP' || substr(p_brand, 7) AS grp, CAST(l_linenumber AS VARCHAR(9)) AS s, lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), 2, '0') AS e,
   lpad(CAST(CAST(l_quantity AS INT) * 1000 + l_linenumber AS VARCHAR(9)), 8, '0') AS crc
   FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber < 10) q""",
    "v_prev": """SELECT doc_id AS file_id, source AS dir, 'd' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS filename, n_chars AS size, sha256(text) AS hash
  FROM {documents} WHERE doc_id % 11 <> 0""",
    "v_cur": """SELECT CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS dir, 'd' || CAST(doc_id AS VARCHAR(20)) || '.txt' AS filename, n_chars AS size, sha256(text) AS hash
  FROM {documents} WHERE doc_id % 13 <> 0""",
    "v_logs": """SELECT ts, CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Info' END AS level,
  upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'Job_' || CAST(user_id AS VARCHAR(20)) AS context,
  CASE event_type WHEN 'view' THEN 'Get AniDB file info' WHEN 'click' THEN 'Found 2 episodes for file' WHEN 'signup' THEN 'Found 0 episodes for file' ELSE 'other' END AS message FROM {events}""",
    "v_members": """SELECT 'A' AS library, p_brand AS name, p_partkey AS pid FROM {part}
  WHERE (p_partkey % 10 <> 0 OR CAST(substr(p_brand, 7) AS INT) % 5 = 0) AND p_brand <> 'Brand#9'
  UNION ALL SELECT 'B', p_brand || CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN ' Collection' ELSE '' END, p_partkey FROM {part}
  WHERE (p_partkey % 10 <> 1 OR CAST(substr(p_brand, 7) AS INT) % 5 = 0) AND p_brand <> 'Brand#7'""",
    "v_titles": """SELECT CAST(l_orderkey AS BIGINT) AS series_id, 't' || CAST(l_partkey AS VARCHAR(20)) || '-' ||
  CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) || '-' || CAST(l_linenumber AS VARCHAR(9)) AS title FROM {lineitem}""",
    "v_catalog": """SELECT f.file_id, f.dir_id, d.scan_id, s.root_path, d.path AS dir, f.filename, f.size, f.ctime, f.mtime,
  s.root_path || CASE WHEN d.path = '' THEN '' ELSE '/' || d.path END || '/' || f.filename AS full_path
  FROM {v_files} f JOIN {v_dirs} d ON d.dir_id = f.dir_id JOIN {v_scans} s ON s.scan_id = d.scan_id""",
    # a made release per matched pair, for the matching and planning queries
    "v_source": """SELECT DISTINCT series AS series_key, season, episode, 'src/' || name AS path, grp AS release_group, CAST(length(name) * 1000 + season * 7 + episode AS BIGINT) AS size FROM {v_names} WHERE season % 2 = 1""",
    "v_download": """SELECT DISTINCT series AS series_key, season, episode, 'dl/' || name AS path, CASE WHEN episode % 7 = 0 THEN '' ELSE grp END AS release_group, CAST(length(name) * 1000 + season * 7 + episode + CASE WHEN episode % 5 = 0 THEN 13 ELSE 0 END AS BIGINT) AS size, episode % 4 = 0 AS remux FROM {v_names} WHERE episode % 3 <> 0""",
}
_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"\bsha256\(text\)", "sha2(text, 256)", VIEWS[name])
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def ctes(text: str) -> str:
    """DuckDB form of a query whose ``{names}`` may be views: these come first as a WITH clause."""
    order: list[str] = []

    def need(sql: str) -> None:
        for n in _NAME.findall(sql):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(text)
    plain = lambda sql: _NAME.sub(r"\1", sql)
    head = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(text).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
