"""Graphs, set overlaps, prefixes, quantile sketches, stored versions, the SQL surface, and streams with state."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalume.functions import sql as surface
from catalume.operators import catalog as C
from catalume.operators import match as M
from catalume.operators import overlap as O
from catalume.operators import sketches as K
from catalume.operators import versions as V
from catalume.streaming import drain as D
from catalume.streaming.jobs import stream_durations
from catalume.streaming.late import LateRows, observed


@pytest.mark.parametrize("kind", ["random", "path", "star", "hub", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    rows = {
        "random": [(rng.randrange(300), f"t{rng.randrange(260)}") for _ in range(330)],
        "path": [(i ^ 5, f"t{i + k}") for i in range(120) for k in (0, 1)],
        "star": [(i, "hot") for i in range(200)] + [(i, f"own{i}") for i in range(150, 260)],
        "hub": [(999, f"t{i}") for i in range(80)] + [(i, f"t{i}") for i in range(80)],
        "none": [(1, "a"), (2, "b"), (2, None)],
    }[kind]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    by = {}
    for s, t in rows:
        if t is None:
            continue
        a, b = find(s), find(by.setdefault(t, s))
        of[max(a, b)] = min(a, b)
    got = {tuple(r) for r in M.alias_components(spark.createDataFrame(rows, "series_id long, title string")).collect()}
    assert got == {(s, find(s)) for s, t in rows if t is not None}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_overlaps_equal_all_pairs(spark, least):
    rng = random.Random(4)
    sets = {(lib, f"s{k}"): {0} | {rng.randrange(40) for _ in range(rng.randint(0, 12))} for lib in "AB" for k in range(60)}  # 0 is in all
    rows = [(lib, name, p) for (lib, name), ps in sets.items() for p in ps] + [("A", None, 1), ("B", "s1", None)]
    rows += rows[:30]
    got = {(r["name_a"], r["name_b"], round(r["overlap"], 9)) for r in O.jaccard_pairs(spark.createDataFrame(rows, "library string, name string, pid long"), least).collect()}
    want = set()
    for (la, a), x in sets.items():
        for (lb, b), y in sets.items():
            if la == "A" and lb == "B" and a != b and len(x & y) / len(x | y) >= least:
                want.add((a, b, round(len(x & y) / len(x | y), 9)))
    assert got == want


def test_a_member_of_all_sets_joins_nothing(spark):
    n = 400
    rows = [(lib, f"{lib}{k}", p) for lib in "AB" for k in range(n) for p in [0, *range(1000 * k + (lib == "B") * 10**7, 1000 * k + (lib == "B") * 10**7 + 4)]]
    assert O.jaccard_pairs(spark.createDataFrame(rows, "library string, name string, pid long"), 0.5).collect() == []


@pytest.mark.parametrize("split", [False, True])
def test_titles_expand_without_another_shuffle(spark, split):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *(f"t{i}" for i in range(60))])) for _ in range(90)]
    titles = spark.createDataFrame(rows, "series_id long, title string")
    components = spark.createDataFrame([(s, s % 7) for s in range(40)], "series_id long, component long") if split else M.alias_components(titles)
    of = dict(map(tuple, components.collect()))
    known = {(t, of[s]) for s, t in rows if of.get(s) is not None}

    def want(names):
        return {(n, n) for n in names} | {(n, t) for n in names for k, c in known for t, d in known if k == n and k is not None and c == d}

    every = {t for _, t in rows}
    got = M.alias_expand(None, titles, components)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want(every)))
    some = {"t1", "t2", "t3", "else", None}
    if not split:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Deduplicate" not in plan
    got = M.alias_expand(spark.createDataFrame([(n,) for n in [*some, "t1"]], "name string"), titles, components)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(map(str, want(some)))


def test_directories_of_one_name_make_no_pairs(spark):
    n = 60_000
    titles = spark.range(n).select((F.col("id") % 2).alias("block"), (F.col("id") + 5).alias("pos"), F.lit("Same Show").alias("title"), F.lit(2000).alias("year"))
    dirs = spark.range(n).select(F.format_string("/lib/%06d", F.col("id") + 3).alias("dir"), F.concat(F.lit("Same Show (2000) {id-"), "id", F.lit("}")).alias("name"))
    began = time.time()
    assert sorted(map(tuple, M.existing_dir(titles, dirs).collect())) == [(0, "/lib/000003"), (1, "/lib/000003")]
    assert time.time() - began < 30


def test_prefixes_with_a_common_beginning(spark):
    rng = random.Random(5)
    words = lambda n: sorted({"common" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(n)} | {"", "c", "zz"})
    a, b = words(150), words(150)
    got = sorted(map(tuple, M.prefix_match(spark.createDataFrame([(x,) for x in a], "key string"), spark.createDataFrame([(x,) for x in b], "index_key string")).collect()))
    assert got == sorted((x, y) for x in a for y in b if x and y and (x.startswith(y) or y.startswith(x)))


def test_sketches_merge_within_their_rank_error(spark):
    runs = spark.range(60_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 3).alias("class"), F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("seconds"))
    daily = K.sketches(runs, "day", "class")
    assert daily.count() == 21
    for keys in (["class"], []):
        for r in K.quantiles(K.merged(daily, *keys), 0.5, 0.95).collect():
            mine = runs.where(F.col("class") == r["class"]) if keys else runs
            for q, rank in ((r["q50"], 0.5), (r["q95"], 0.95)):
                below, upto = mine.agg(F.avg((F.col("seconds") < q).cast("int")), F.avg((F.col("seconds") <= q).cast("int"))).first()
                assert below - 0.0133 <= rank <= upto + 0.0133
            assert r["n"] == mine.count()


def test_a_small_change_rewrites_few_buckets(spark, tmp_path):
    path, buckets = str(tmp_path / "catalog"), 200
    d = F.concat(F.lit("dir"), (F.col("id") % 500).cast("string"))
    files = spark.range(20_000).select(d.alias("dir"), F.concat(F.lit("f"), "id").alias("filename"), F.col("id").alias("size"), F.lit(1).cast("long").alias("ctime"), F.lit(1).cast("long").alias("mtime"), F.lit(None).cast("timestamp").alias("metadata_scanned_at"), F.lit("h").alias("content_hash"), (F.col("id") + 1).alias("file_id"))
    V.create(files, path, buckets)
    before = {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    listing = spark.createDataFrame([("dir3", "f3", 3, 1, 1), ("dir3", "new", 9, 1, 5), ("dir7", "f7", 8, 1, 9)], "dir string, filename string, size long, ctime long, mtime long")
    gone = spark.createDataFrame([("dir11",)], "dir string")
    rewritten = V.apply_listing(spark, path, listing, gone, buckets)
    assert len(rewritten) <= 3
    after = {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    same = [f for f, t in before.items() if after.get(f) == t]
    assert len(before) - len(same) <= 3 < 0.03 * len(before)
    rows = {(r["dir"], r["filename"]): r for r in V.read(spark, path).collect()}
    assert len(rows) == 20_000 - 3 * 40 + 3
    assert rows["dir3", "f3"]["content_hash"] == "h" and rows["dir7", "f7"]["content_hash"] is None
    assert rows["dir3", "new"]["file_id"] == 20_001 and not any(k[0] == "dir11" for k in rows)
    assert V.apply_listing(spark, path, listing.limit(0), gone.limit(0), buckets) == []


def test_sql_alone(spark):
    surface.register(spark)
    files = spark.createDataFrame([("/v/a/[Cyan] Show - 08 [1080p].mkv",), ("/v/b/order_14.flac",), ("/v/b/order_15.FLAC",), (None,)], "full_path string")
    files.createOrReplaceTempView("sql_files")
    got = [r[0] for r in spark.sql(r"SELECT full_path FROM sql_files WHERE find_regexp('order_\\d*4\\.flac$', full_path)").collect()]
    assert got == [r["full_path"] for r in C.find(files, r"order_\d*4\.flac$").collect()] == ["/v/b/order_14.flac"]
    assert spark.sql("SELECT count(*) FROM sql_files WHERE full_path REGEXP 'order' AND find_iregexp('flac$', full_path)").first()[0] == 2
    parts = spark.sql("SELECT level, component FROM sql_files, LATERAL path_components(full_path) WHERE full_path LIKE '%Cyan%' ORDER BY level").collect()
    assert [tuple(r) for r in parts] == [(0, "[Cyan] Show - 08 [1080p].mkv"), (1, "a"), (2, "v")]
    assert spark.sql("SELECT extension('a.b.MKV'), name_key('A b-C!')").first()[:] == ("mkv", "abc")
    surface.register_names(files.where("full_path is not null"), column="full_path")
    told = spark.sql("SELECT a.title, a.episode FROM name_components c JOIN name_attributes a USING (component) WHERE c.level = 0 AND a.release_group = 'Cyan'").collect()
    assert [tuple(r) for r in told] == [("Show", 8)]
    assert spark.sql("SELECT count(*) FROM name_tokens WHERE kind = 'resolution'").first()[0] == 1
    assert spark.sql("SELECT count(*) FROM name_spans WHERE kind = 'bracket'").first()[0] == 2


def _samples():
    start, rows = datetime(2024, 1, 1), []
    for k in range(30):  # falls, then empties
        rows.append(("falls", start + timedelta(minutes=20 * k), 100, max(0, 290 - 10 * k)))
    for k in range(40):  # falls, then stays: flat over a whole window only from sample 21 on
        rows.append(("stays", start + timedelta(minutes=10 * k), 50, max(500 - 50 * k, 80)))
    for k in range(5):  # two quiet samples are no plateau
        rows.append(("short", start + timedelta(minutes=10 * k), 5, 7 if k else None))
    rows += [("quick", start, 0, 4), ("quick", start + timedelta(minutes=1), 3, 3), (None, start, 1, 1)]
    return rows


def test_drain_monitor_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "server string, ts timestamp, total long, open long"
    rows = _samples()
    want = sorted(tuple(r) for r in D.drain(spark.createDataFrame(rows, schema), hours=2.0).collect())
    ends = {r[0]: r[6] for r in sorted(want, key=lambda r: r[1])}
    assert ends == {"falls": "done", "stays": "plateau", "short": "running", "quick": "done"}
    assert all(r[5] >= 2.0 for r in want if r[6] == "plateau") and sum(r[6] != "running" for r in want) == 3
    rng = random.Random(1)
    folder = str(tmp_path / "in")
    ordered = sorted(rows, key=lambda r: r[1])
    for lo in range(0, len(ordered), 25):  # within a file in any order
        part = ordered[lo : lo + 25]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("clock", datetime(2024, 1, 9), 1, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([("clock", datetime(2024, 1, 9, 1), 1, 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = D.stream_drain_monitor(stream, hours=2.0).writeStream.format("memory").queryName("drained").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(240)
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM drained WHERE server <> 'clock'").collect())
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    near = lambda rs: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs]
    assert near(got) == near(want)


def test_late_rows_are_counted(spark, tmp_path):
    listener, folder = LateRows(), str(tmp_path / "in")
    spark.streams.addListener(listener)
    schema = "ts timestamp, level string, context string, message string"
    at = lambda day, minute: datetime(2024, 1, day, 0, minute)
    rows = lambda times: [(t, "Info", f"HashFileJob_{i}", "x") for i, t in enumerate(times)]
    try:
        spark.createDataFrame(rows([at(2, k) for k in range(5)]), schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are read in order of time
        spark.createDataFrame(rows([at(5, 0)]), schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
        spark.createDataFrame(rows([at(5, 1)]), schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # rows are late behind the watermark of the batch before the last
        spark.createDataFrame(rows([at(2, 30), at(2, 31), at(2, 32), at(5, 1)]), schema).coalesce(1).write.mode("append").parquet(folder)
        stream = observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
        query = stream_durations(stream).writeStream.format("memory").queryName("late_runs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        for _ in range(50):
            if listener.read["late_runs"] >= 11:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.read["late_runs"] == 11 and listener.late["late_runs"] == 3
    assert spark.sql("SELECT count(*) FROM late_runs").first()[0] == 5
