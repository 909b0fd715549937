"""Golden cases of the catalog, text, snapshot, planning and cue operators."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalume.functions import text as G
from catalume.operators import catalog as C
from catalume.operators import cue as Q
from catalume.operators import logs as L
from catalume.operators import match as M
from catalume.operators import overlap as O
from catalume.operators import planning as P
from catalume.operators import release as R
from catalume.operators import snapshot as S
from catalume.plans import pipelines
from catalume.sources import readers, writers
from catalume.streaming import jobs


def values(spark, items, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_human_size(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (2_500_000_000,), (None,)], "n long")
    assert [r[0] for r in df.select(G.human_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.50 KiB", "2.33 GiB", None]


def test_title_keys(spark):
    assert values(spark, ["Tamon's B-Side", "Fiancée", "Re: ZERO, Starting"], G.title_key) == ["tamons b side", "fiancee", "re zero starting"]
    assert values(spark, ["Ünïcode 日本!", "A-b_C"], G.match_key) == ["ncode日本", "abc"]


def test_system_names_match_whole_components(spark):
    df = spark.createDataFrame([("a/@eaDir", "x"), ("a/@eaDirectory", "x"), ("not@eaDir", "x"), ("a", "@eaDir"), ("a", "#recycle"), ("a", ".dot"), ("a", "n.jpg")], "dir string, filename string")
    assert [r[0] for r in df.select(C.is_system(F.col("dir"), F.col("filename"))).collect()] == [True, False, False, True, True, False, False]
    shown = lambda c: [tuple(r) for r in df.where(C.visible(c)).collect()]
    assert shown(C.Visibility()) == [("a/@eaDirectory", "x"), ("not@eaDir", "x"), ("a", "n.jpg")]
    assert ("a", ".dot") in shown(C.Visibility(show_hidden=True)) and ("a", "#recycle") in shown(C.Visibility(show_system=True))
    assert ("a", "n.jpg") not in shown(C.Visibility(globs=("*.jpg", "[bad")))


def test_case_folding_is_simple(spark):
    df = spark.createDataFrame([("/v/Björk",), ("/v/Weiße",), ("/v/WEISSE",)], "full_path string")
    assert C.find(df, "BJÖRK", insensitive=True).count() == 1
    assert [r[0] for r in C.find(df, "weiße", insensitive=True).collect()] == ["/v/Weiße"]


def test_collated_order(spark):
    df = spark.createDataFrame([(x,) for x in ("zebra", "king", "Specials", "arino", "Alpha", "_z")], "n string")
    assert [r[0] for r in C.collate_order(df, "n").collect()] == ["Alpha", "arino", "king", "Specials", "_z", "zebra"] or [r[0] for r in C.collate_order(df, "n").collect()][:4] == ["Alpha", "arino", "king", "Specials"]


def test_moves(spark):
    s = "file_id long, dir string, filename string, size long, hash string"
    prev = spark.createDataFrame([(1, "a", "x", 10, "h1"), (2, "a", "y", 20, "h2"), (3, "a", "gone", 30, "h3"), (4, "a", "q", 40, None), (5, "a", "same", 50, "h5")], s)
    cur = spark.createDataFrame([("b", "x", 10, "h1"), ("a", "y2", 20, "h2"), ("b", "new", 30, "other"), ("c", "q", 40, "h4"), ("a", "same", 50, "h5")], "dir string, filename string, size long, hash string")
    moves = S.detect_moves(S.removed(prev, cur), S.added(prev, cur))
    assert {(r["file_id"], r["new_dir"], r["new_filename"], r["matched_by"]) for r in moves.collect()} == {(1, "b", "x", "hash"), (2, "a", "y2", "hash"), (4, "c", "q", "size")}
    table, log = S.apply_snapshot(prev, cur)
    assert {(r["dir"], r["filename"]): r["file_id"] for r in table.collect()} == {("b", "x"): 1, ("a", "y2"): 2, ("c", "q"): 4, ("a", "same"): 5, ("b", "new"): 6}
    assert sorted(r["change"] for r in log.collect()) == ["added", "moved", "moved", "moved", "removed"]


def test_upsert_keeps_ids_and_clears_stale_results(spark):
    t = datetime(2024, 1, 1)
    prev = spark.createDataFrame([(1, "a", "x", 1, 1, 5, t, "h"), (2, "a", "y", 1, 1, 5, t, "h")], "file_id long, dir string, filename string, size long, ctime long, mtime long, metadata_scanned_at timestamp, content_hash string")
    cur = spark.createDataFrame([("a", "x", 1, 1, 5), ("a", "y", 1, 1, 6), ("b", "z", 1, 1, 1), ("a", "w", 1, 1, 1)], "dir string, filename string, size long, ctime long, mtime long")
    got = {r["filename"]: (r["file_id"], r["content_hash"]) for r in S.upsert_files(prev, cur).collect()}
    assert got == {"x": (1, "h"), "y": (2, None), "w": (3, None), "z": (4, None)}


def test_log_lines_and_drain(spark):
    lines = spark.createDataFrame([("[2024-01-02 03:04:05:678] Info|ProcessFileJob_1 > Found 3 episodes for file",), ("noise UDPBan",)], "value string")
    row = L.parse_log_lines(lines).first()
    assert (row["ts"], row["level"], row["context"]) == (datetime(2024, 1, 2, 3, 4, 5, 678000), "Info", "ProcessFileJob_1")
    assert L.daily_counts(L.parse_log_lines(lines)).first()["recognized"] == 1
    assert L.daily_bans(lines.withColumn("day", F.lit("d")), "day").first()["bans"] == 1
    samples = spark.createDataFrame([(datetime(2024, 1, 1, h), 100 - 10 * h) for h in range(5)], "ts timestamp, value int")
    got = L.slope(samples, 3).first()
    assert got["slope"] == pytest.approx(-10 / 3600) and got["span_hours"] == 3
    eta = spark.createDataFrame([(60.0, -1.0, 5.0), (60.0, 0.0, 5.0), (60.0, 0.0, 0.0), (1e12, -1.0, 1.0)], "r double, s double, d double").select(L.eta_seconds(F.col("r"), F.col("s"), F.col("d"))).collect()
    assert [r[0] for r in eta] == [60.0, 60 / 5 * 86400, None, None]


def test_episode_matching(spark):
    s = "series_key string, season int, episode int, path string, size long, release_group string"
    src = spark.createDataFrame([("s", 1, 1, "a", 100, "GRP"), ("s", 1, 2, "b", 100, "GRP"), ("s", 1, 3, "c", 77, "GRP")], s)
    dl = spark.createDataFrame([("s", 1, 1, "d1", 101, "grp x"), ("s", 1, 1, "d2", 150, ""), ("s", 1, 2, "d3", 100, "OTHER"), ("t", 9, 9, "d4", 77, "grp")], s)
    assert {tuple(r) for r in M.match_downloads(src, dl).collect()} == {("a", "d1", "episode"), ("c", "d4", "size")}


def test_prefix_phrase_and_candidates(spark):
    keys = spark.createDataFrame([("abcdef",), ("abc",), ("xyz",)], "key string")
    index = spark.createDataFrame([("abcd",), ("ab",), ("q",)], "index_key string")
    assert {tuple(r) for r in M.prefix_match(keys, index).collect()} == {("abcdef", "abcd"), ("abcdef", "ab"), ("abc", "abcd"), ("abc", "ab")}
    titles = spark.createDataFrame([("My Hero Story",), ("A long saga of stars part two",), ("nothing",), ("MyHero Story",)], "title string")
    idx = spark.createDataFrame([("my hero story", "anime", 1), ("saga of stars", "films", 2)], "key string, domain string, pos int")
    assert {tuple(r) for r in M.phrase_domain(titles, idx).collect()} == {("My Hero Story", "anime", "exact"), ("MyHero Story", "anime", "loose"), ("A long saga of stars part two", "films", "contained")}
    wanted = spark.createDataFrame([("t", ["foo"], 2000), ("u", ["bar"], 0), ("v", ["baz"], 0), ("w", ["none"], 0)], "title string, wanted array<string>, year int")
    found = spark.createDataFrame([("t", 1, 10, "Foo", "", 2000), ("t", 2, 11, "Foo", "", 1990), ("u", 1, 12, "Other", "", 0), ("v", 1, 13, "X", "", 0), ("v", 2, 14, "Y", "", 0)], "title string, rank int, pid long, name string, original string, year int")
    assert {tuple(r) for r in M.pick_candidate(wanted, found).collect()} == {("t", "exact", 10), ("u", "high", 12), ("v", "ambiguous", None), ("w", "none", None)}


def test_sidecars_need_the_whole_stem(spark):
    v = spark.createDataFrame([("d", "Show - 01.mkv")], "dir string, filename string")
    f = spark.createDataFrame([("d", "Show - 01.en.srt"), ("d", "Show - 011.srt"), ("d", "Show - 01.ass"), ("e", "Show - 01.srt")], "dir string, filename string")
    assert {(r["subtitle"], r["language"]) for r in M.sidecars(v, f, default_language="ja").collect()} == {("Show - 01.en.srt", "en"), ("Show - 01.ass", "ja")}


def test_release_names(spark):
    names = ["[Group] Some Show - 05v2 [1080p][ABCD1234].mkv", "Some.Show.S02E03-E05.1080p.BluRay.x265-TEAM.mkv", "[720p] Movie (1999).mkv", "第3話 テスト.mkv"]
    rows = {r["name"]: r for r in R.parse_names(spark.createDataFrame([(n,) for n in names], "name string"), 2026).collect()}
    a, b, c, d = (rows[n] for n in names)
    assert (a["title"], a["episode"], a["version"], a["release_group"], a["resolution"], a["checksum"]) == ("Some Show", 5, 2, "Group", "1080p", "ABCD1234")
    assert (b["title"], b["season"], b["episodes"], b["release_group"], b["medium"], b["video_codec"]) == ("Some Show", 2, [3, 4, 5], "TEAM", "BluRay", "x265")
    assert (c["release_group"], c["year"], c["episode"]) == (None, 1999, None) and d["episode"] == 3
    flagged = R.coverage(spark.createDataFrame([("a/[x.mkv",), ("S01E01 S01E02.mkv",), ("ok.mkv",)], "path string")).collect()
    assert [r["reasons"] for r in flagged] == [["unbalanced brackets"], ["contradictory episodes"], []]


def test_titles_are_grouped_in_one_pass(spark):
    names = ["Some Show - 01.mkv", "Some.Show.S02E03.1080p.BluRay.x265-TEAM.mkv", "some show - 02.mkv", "Some Show - 03.mkv", "Film (1999).mkv", "Film (2001).mkv", "(1080p).mkv"]
    parsed = R.parse_names(spark.createDataFrame([(n,) for n in names], "name string"), 2026).withColumn("path", F.col("name"))
    groups = R.group_titles(parsed)
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1 and "Filter" not in plan[plan.rindex("Aggregate") :]
    assert [(r["group_key"], r["title"], r["files"], r["seasons"]) for r in groups.collect()] == [("someshow", "Some Show", 4, [2]), ("film|1999", "Film", 1, []), ("film|2001", "Film", 1, [])]


def test_planning(spark):
    plan = spark.createDataFrame([("s1", 1, 10, "T", 1, 1, "ready", "D", "n.mkv", ""), ("s2", 2, 10, "T", 1, 2, "ready", "d", "N.mkv", ""), ("s3", 3, 10, "T", 1, 1, "ready", "D", "z.mkv", "")], "source string, pos int, size long, title string, season int, episode int, status string, dest_dir string, dest_name string, note string")
    assert {r["source"]: r["status"] for r in P.mark_dup_dests(plan).collect()} == {"s1": "ready", "s2": "skip", "s3": "ready"}
    assert {r["source"]: r["status"] for r in P.one_version(plan).collect()} == {"s1": "ready", "s2": "ready", "s3": "skip"}
    blocks = spark.createDataFrame([("a", 1, 7, ""), ("b", 2, 7, "BD"), ("c", 3, 7, "TV"), ("d", 4, None, "")], "block string, pos int, pid long, edition string")
    assert {(r["block"], r["into"], r["edition"]) for r in P.merge_titles(blocks).collect()} == {("a", "a", "BD"), ("b", "a", "BD"), ("c", "c", "TV"), ("d", "d", "")}
    listing = spark.createDataFrame([("s1", 10), ("s3", 11)], "source string, size long")
    bad = P.validate_plan(plan.withColumn("pid", F.lit(1)), listing, spark.createDataFrame([("D/n.mkv", 10)], "dest string, size long"))
    assert {tuple(r) for r in bad.collect()} == {("s1", "duplicate destination"), ("s1", "already done"), ("s2", "source missing"), ("s2", "duplicate destination"), ("s3", "size changed")}
    twins = spark.createDataFrame([("p", 1, 1, 1), ("q", 1, 1, 2), ("r", None, None, 3)], "path string, dev long, inode long, pos int")
    assert sorted(r["path"] for r in P.drop_twins(twins).collect()) == ["p", "r"]


def test_ingest_plan(spark):
    src = spark.createDataFrame([("a.mkv", 1, 5, "Show", 2001, 1, 1, "G", 1, "mkv", 1, 1), ("b.mkv", 2, 6, "Show", 2001, 1, 2, "G", 1, "mkv", 1, 2), ("c.mkv", 3, 7, "Show", 2001, 1, 3, "G", 1, "mkv", 1, 3), ("a2.mkv", 4, 5, "Show", 2001, 1, 1, "G", 1, "mkv", 1, 1)], "source string, pos int, size long, title string, year int, season int, episode int, release_group string, version int, ext string, dev long, inode long")
    lib = spark.createDataFrame([("Elsewhere", "x.mkv", 6)], "dir string, filename string, size long")
    ids = [("config", spark.createDataFrame([("Show", 9)], "title string, pid long"))]
    reg = spark.createDataFrame([("c.mkv",)], "source string")
    got = {r["source"]: (r["status"], r["pid"], r["dest_dir"], r["dest_name"]) for r in pipelines.ingest_plan(src, lib, ids, reg).collect()}
    assert got == {"a.mkv": ("ready", 9, "Show (2001)/Season 01", "Show - S01E01 [G].mkv"), "b.mkv": ("skip", 9, "Show (2001)/Season 01", "Show - S01E02 [G].mkv")}


def test_overlap_claims(spark):
    rows = [("A", "x", i) for i in range(4)] + [("B", "y", i) for i in range(4)] + [("B", "z", i) for i in range(3)] + [("A", "only", 99), ("A", "both", 50), ("B", "both", 50), ("B", "both", 51)]
    got = {(r["kind"], r["name"], r["other"]) for r in O.reconcile(spark.createDataFrame(rows, "library string, name string, pid int")).collect()}
    assert got == {("rename", "x", "y"), ("only_b", "z", None), ("only_a", "only", None), ("drifted", "both", None)}


def test_overlap_claims_settle_all_ties_and_chains(spark):
    rows = [(lib, f"{n}{k:02}", i) for lib, n in (("A", "x"), ("B", "y")) for k in range(30 if n == "x" else 31) for i in range(3)]
    got = {(r["kind"], r["name"], r["other"]) for r in O.reconcile(spark.createDataFrame(rows, "library string, name string, pid int")).collect()}
    assert got == {("rename", f"x{k:02}", f"y{k:02}") for k in range(30)} | {("only_b", "y30", None)}
    chain = [(f"a{k:02}", f"b{k:02}", 0.5 + 2 * k / 100) for k in range(23)] + [(f"a{k + 1:02}", f"b{k:02}", 0.51 + 2 * k / 100) for k in range(22)]
    got = {tuple(r) for r in O.claims(spark.createDataFrame(chain, "name_a string, name_b string, overlap double")).collect()}
    assert got == set(chain[:23])


def test_overlap_claims_equal_greedy_choice(spark):
    rng = random.Random(3)
    pairs = [(f"a{i}", f"b{j}", rng.choice([0.5, 0.6, 0.75])) for i in range(12) for j in range(12) if rng.random() < 0.6]
    want, seen = set(), set()
    for a, b, x in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if not {a, b} & seen:
            want.add((a, b, x))
            seen |= {a, b}
    assert {tuple(r) for r in O.claims(spark.createDataFrame(pairs, "name_a string, name_b string, overlap double")).collect()} == want


CUE = 'TITLE "Album"\nPERFORMER "Band"\nFILE "a.wav" WAVE\n  TRACK 01 AUDIO\n    TITLE "One"\n    INDEX 01 00:00:00\n  TRACK 02 AUDIO\n    TITLE "Two"\n    PERFORMER "Guest"\n    INDEX 00 03:00:00\n    INDEX 01 03:02:10\nFILE "b.wav" WAVE\n  TRACK 03 AUDIO\n    TITLE "Three"\n    INDEX 01 00:00:00\n  TRACK 04 AUDIO\n    TITLE "Broken"\n'


def test_cue(spark):
    tracks = Q.cue_tracks(spark.createDataFrame([(1, CUE)], "file_id long, content string"))
    got = {r["track"]: (r["title"], r["index01"], r["error"]) for r in tracks.collect()}
    assert got == {1: ("One", 0, None), 2: ("Two", 13660, None), 3: ("Three", 0, None), 4: ("Broken", None, "no INDEX 01")}
    d = spark.createDataFrame([(1, 1, 20000), (1, 2, 5000)], "file_id long, file_no long, sectors long")
    toc = {r["track"]: (r["start"], r["length"], r["end"]) for r in Q.cue_toc(Q.cue_offsets(tracks.where("error is null"), d)).collect()}
    assert toc == {1: (0, 13660, 13659), 2: (13660, 6340, 19999), 3: (20000, 5000, 24999)}
    assert [r["line"] for r in Q.cue_summary(tracks).orderBy("track").collect()][:2] == ["One", "Guest - Two"]


def test_cue_lines_are_neither_sorted_nor_shuffled(spark):
    odd = 'title First\r\n\r\n  FILE "a.wav" WAVE\n TITLE "Late"\n PERFORMER "P"\nTRACK 2 AUDIO\nINDEX 01 00:01:00\nTRACK 1 MODE1/2352\nTITLE "x"\nTRACK 2 AUDIO\nTITLE "two"\nINDEX 01 00:09:00\nTRACK 0 AUDIO\nTITLE "none"\nFILE "" WAVE\nTRACK 7 AUDIO\nISRC AB\n'
    tracks = Q.cue_tracks(spark.createDataFrame([(1, odd), (2, "TRACK 5 AUDIO"), (3, ""), (4, None)], "file_id long, content string"))
    plan = tracks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan
    got = {(r["file_id"], r["file_no"], r["track"], r["file"], r["kind"], r["title"], r["isrc"], r["index01"], r["album"], r["album_artist"]) for r in tracks.collect()}
    assert got == {
        (1, 1, 1, "a.wav", "MODE1/2352", "x", None, None, "First", "P"),
        (1, 1, 2, "a.wav", "AUDIO", "two", None, 75, "First", "P"),
        (1, 2, 7, "a.wav", "AUDIO", None, "AB", None, "First", "P"),
        (2, 0, 5, None, "AUDIO", None, None, None, None, None),
    }


def test_disc_id_of_a_known_table_of_contents(spark):
    import base64
    import hashlib

    offsets, total = [0, 15213, 32164, 46442, 63264, 80339], 95312
    text = "01" + "06" + f"{total + 150:08X}" + "".join(f"{o + 150:08X}" for o in offsets) + "00000000" * 93
    want = base64.b64encode(hashlib.sha1(text.encode()).digest()).decode().translate(str.maketrans("+/=", "._-"))
    df = spark.createDataFrame([(offsets, total)], "o array<long>, t long")
    assert df.select(G.disc_id(F.col("o"), F.col("t"))).first()[0] == want == "49HHV7Eb8UKF3aQiNmu1GR8vKTY-"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/2024-01-01.log").write_text("plain\n")
    import zipfile

    for day in ("2024-01-01", "2024-01-02"):
        with zipfile.ZipFile(tmp_path / f"logs/{day}.zip", "w") as z:
            z.writestr("x.log", f"zipped {day}\nsecond\n")
    got = sorted((str(r["day"]), r["value"]) for r in readers.read_job_logs(spark, str(tmp_path / "logs")).collect())
    assert got == [("2024-01-01", "plain"), ("2024-01-02", "second"), ("2024-01-02", "zipped 2024-01-02")]
    tree = readers.list_tree(spark, str(tmp_path), exclude=("none",))
    assert sorted(r["filename"] for r in tree.collect()) == ["2024-01-01.log", "2024-01-01.zip", "2024-01-02.zip"]
    files = spark.createDataFrame([("/v/a/x.flac", "a", "x.flac", 5, 1, 2), ("/v/a/.h", "a", ".h", 5, 1, 2)], "full_path string, dir string, filename string, size long, ctime long, mtime long")
    writers.write_listing_csv(files, str(tmp_path / "out"), single=True)
    back = readers.read_listing(spark, str(tmp_path / "out")).collect()
    assert [(r["path"], r["size"], r["dir"], r["filename"]) for r in back] == [("/v/a/x.flac", 5, "/v/a", "x.flac")]
    blobs = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    assert writers.new_blobs(blobs, spark.createDataFrame([], "hash string")).count() == 2


def test_provider_payloads(spark):
    xml = '<anime id="7"><type>TV Series</type><startdate>2003-10-05</startdate><titles><title xml:lang="en" type="official">English</title><title xml:lang="x-jat" type="main">Main</title></titles><episodes><episode id="1"><epno type="1">1</epno><title xml:lang="en">Pilot</title></episode></episodes></anime>'
    s = readers.series_xml(spark.createDataFrame([(xml,)], "xml string"))
    row = s.first()
    assert (row["pid"], row["year"], row["is_movie"], row["episodes"][0]["english"], row["episodes"][0]["number"]) == (7, 2003, False, "Pilot", 1)
    assert readers.pick_titles(s).first()["title"] == "Main"
    probe = '{"media":{"track":[{"@type":"General"},{"@type":"Video","Format":"JPEG"},{"@type":"Video","Format":"HEVC","Width":"1 920","Height":"1 080","BitDepth":"10"},{"@type":"Audio","Format":"FLAC","Language":"ja"},{"@type":"Audio","Format":"AAC LC","Language":"en"},{"@type":"Audio","Format":"AC-3","Title":"Commentary"}]}}'
    p = readers.audio_summary(readers.media_probe(spark.createDataFrame([(1, probe), (2, '{"media":null}')], "file_id long, json string"))).orderBy("file_id").collect()
    assert (p[0]["video_codec"], p[0]["resolution"], p[0]["bit_depth"], p[0]["audio_codecs"], p[0]["audio_kind"]) == ("HEVC", "1080p", 10, ["flac", "aac"], "Dual Audio")
    assert p[1]["video_codec"] is None and p[1]["audio_codecs"] == []
    assert values(spark, ["com.x://anidb-12", "thetvdb://34?x", "none"], lambda c: G.guid_id(c)["pid"]) == [12, 34, None]


def test_codec_names(spark):
    assert values(spark, ["AAC LC", "Opus", "DTS XLL", "E-AC-3 JOC", "MLP FBA", "WMA Pro"], readers.audio_codec) == ["aac", "opus", "DTS", "EAC3", "TrueHD", "wma pro"]
    assert values(spark, ["HEVC", "MPEG Video", "VC-1"], readers.video_codec) == ["HEVC", "MPEG2", "VC-1"]


def test_hdr_classes(spark):
    rows = [("Dolby Vision", "HDR10", ""), ("Dolby Vision", None, "PQ"), ("SMPTE ST 2094 App 4, HDR10+", "", ""), (None, None, "PQ"), ("", "", "HLG"), (None, None, "BT.709")]
    t = spark.createDataFrame(rows, "f string, c string, t string").select(G.hdr_class(F.col("f"), F.col("c"), F.col("t")).alias("v"))
    assert [r["v"] for r in t.collect()] == ["DoVi,HDR", "DoVi", "HDR", "HDR", "HDR", ""]


def test_extras(spark):
    rows = [("Crafting.Anomalisa-Grym", "", "Grym"), ("Q&A with Park Chan-wook", "Extras", ""), ("Some_Trailer-GRP", None, None), ("Making of: Part 1", "nc", ""), ("clip", "deleted SCENES", ""), (None, None, None)]
    t = spark.createDataFrame(rows, "stem string, folder string, release string")
    got = t.select(G.extra_name(F.col("stem"), F.col("release")).alias("n"), G.extras_category(F.col("stem"), F.col("folder"), F.col("release")).alias("c")).collect()
    assert [r["n"] for r in got] == ["Crafting Anomalisa", "Q&A with Park Chan-wook", "Some Trailer", "Making of - Part 1", "clip", None]
    assert [r["c"] for r in got] == ["Featurettes", "Featurettes", "Trailers", "Behind The Scenes", "Deleted Scenes", None]


def test_bonus_specials_and_sites(spark):
    names = {
        "[ak-Submarines] Girls und Panzer - MLLSD - SP1 [WEB 1080p][D227DE6D].mkv": ("Girls und Panzer - MLLSD", 1, True, None, None),
        "[アニメ BD] Show(第1期) 映像特典「PV1」(1920x1080 HEVC 10bit FLAC).mkv": ("Show", None, False, "PV", None),
        "[アニメ BD] Show(第1期) 映像特典「ノンテロップOP「Title」(specs).mkv": ("Show", None, False, "NCOP", None),
        "[アニメ BD] Show(第1期) 映像特典「ノンテロップED「Title」(specs).mkv": ("Show", None, False, "NCED", None),
        "[アニメ BD] Show(第4期) 映像特典「予告」(specs).mkv": ("Show", None, False, "Preview", None),
        "[アニメ BD] Show(第1期) 第01話「Title」(specs).mkv": ("Show", 1, False, None, None),
        "[G] Show - NCOP1 [1080p].mkv": ("Show", None, False, "NCOP", None),
        "S01E01-A World Without Books.mkv": (None, 1, False, None, "A World Without Books"),
        "www.Torrenting.com - Pacific Rim (2013).mkv": ("Pacific Rim", None, False, None, None),
    }
    got = R.parse_names(spark.createDataFrame([(n,) for n in names], "name string"), 2026).collect()
    assert {r["name"]: (r["title"], r["episode"], r["is_special"], r["bonus"], r["episode_title"]) for r in got} == names
    long = R.parse_names(spark.createDataFrame([("Show S01E001-E250.mkv",)], "name string"), 2026).first()
    assert len(long["episodes"]) == 250


def test_streams_equal_batches(spark, tmp_path):
    logs = spark.createDataFrame([(datetime(2024, 1, 1, 10, 0, i), "Info", f"HashFileJob_{i % 2}", "Get AniDB file info") for i in range(6)], "ts timestamp, level string, context string, message string")
    logs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("counts", jobs.stream_daily_counts(stream), "complete"), ("distinct", jobs.stream_distinct_jobs(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("counts").first()["lookups"] == 6 == L.daily_counts(logs).first()["lookups"]
    assert sorted(r["context"] for r in spark.table("distinct").collect()) == ["HashFileJob_0", "HashFileJob_1"]


def test_stream_catalog_is_idempotent_by_batch(spark, tmp_path):
    schema = "dir string, filename string, size long, hash string, mtime long"
    spark.createDataFrame([("a", "x", 1, "h", 1), ("a", "x", 2, "h2", 2), ("a", "y", 1, "k", 1)], schema).write.parquet(str(tmp_path / "in"))
    versions = {}
    before = spark.createDataFrame([(1, "a", "x", 1, "h")], "file_id long, dir string, filename string, size long, hash string")

    def store(table, log, batch_id):
        versions[batch_id] = {(r["dir"], r["filename"]): (r["file_id"], r["size"]) for r in table.collect()}

    jobs.stream_catalog(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: before, store, str(tmp_path / "c")).awaitTermination(120)
    assert versions[0] == {("a", "x"): (1, 2), ("a", "y"): (2, 1)}
