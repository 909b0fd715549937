"""Release names by tokens: known names, nested brackets against a stack machine, compounds against a plain tokenizer."""

import random
import re

from pyspark.sql import functions as F

from catalume.operators import names as N

# name, and the attributes it must give; what isn't named here isn't asserted
KNOWN = [
    ("[Cyan] Champignon no Majo - 08 [WEB 1080p x265][AAC][D98B31F3].mkv", dict(release_group="Cyan", title="Champignon no Majo", episode=8, checksum="D98B31F3", source_type="Web", video_codec="x265", audio_codecs=["AAC"])),
    ("[Erai-raws] Champignon no Majo - 11 [1080p CR WEB-DL AVC AAC][MultiSub][0A021911].mkv", dict(release_group="Erai-raws", title="Champignon no Majo", episode=11, checksum="0A021911", service="CR")),
    ("[Erai-raws] Honzuki no Gekokujou - Shisho ni Naru - 04v2 [1080p][Multiple Subtitle].mkv", dict(release_group="Erai-raws", title="Honzuki no Gekokujou Shisho ni Naru", episode=4, version=2)),
    ("[ak-Submarines] Girls und Panzer - MLLSD - SP1 [WEB 1080p][D227DE6D].mkv", dict(release_group="ak-Submarines", episode=1, is_special=True)),
    ("[Erai-raws] Honzuki no Gekokujou S3 - 10 END [1080p][Multiple Subtitle][E91FC872].mkv", dict(episode=10)),
    ("You.and.I.Are.Polar.Opposites.S01E01.You.My.Polar.Opposite.1080p.CR.WEB-DL.DUAL.AAC2.0.H.264-VARYG.mkv", dict(release_group="VARYG", season=1, episode=1, title="You and I Are Polar Opposites", episode_title="You My Polar Opposite", video_codec="H.264", dual_audio=True)),
    ("TO.BE.HERO.X.S01E01.NICE.1080p.CR.WEB-DL.DUAL.AAC2.0.H.264.MSubs-ToonsHub.mkv", dict(release_group="ToonsHub", season=1, episode=1, title="TO BE HERO X", episode_title="NICE")),
    ("Movie.2005.WEB-DL.2160p.mkv", dict(year=2005, title="Movie", resolution="4K")),
    ("[アニメ BD] 探偵オペラミルキィホームズ(第1期) 第01話「屋根裏の入居者」(1920x1080 HEVC 10bit FLAC softSub(chi+eng) chap).mkv", dict(release_group="アニメ", source_type="BD", season=1, episode=1, episode_title="屋根裏の入居者", title="探偵オペラミルキィホームズ", bonus=None)),
    ("[アニメ BD] 探偵オペラミルキィホームズ 第2幕(第2期) 第05話「コソコソと支度」(1920x1080 HEVC 10bit FLAC softSub(chi+eng) chap).mkv", dict(season=2, episode=5)),
    ("[アニメ BD] 探偵歌劇ミルキィホームズTD(第4期) 第12話(終)「The detective of the Opera」(1920x1080 HEVC 10bit FLACx2).mkv", dict(season=4, episode=12)),
    ("桃太郎 海の神兵 [Momotaro Sacred Sailors] (1945) - complete movie (BD, 1080p).mkv", dict(year=1945)),
    ("Topkapi (1964) (1080p BluRay x265 10bit EAC3 2.0 r00t)", dict(year=1964, title="Topkapi", bit_depth=10, audio_codecs=["EAC3 2.0"])),
    ("[アニメ BD] Show(第1期) 映像特典「PV1」(1920x1080 HEVC 10bit FLAC).mkv", dict(bonus="PV", is_special=True)),
    ("[アニメ BD] Show(第1期) 映像特典「ノンテロップOP「正解はひとつ！じゃない!!」(1920x1080 HEVC 10bit FLAC).mkv", dict(bonus="NCOP", episode_title="正解はひとつ！じゃない!!", reasons=["bracket is not closed"])),
    ("[アニメ BD] Show(第1期) 映像特典「ノンテロップED「本能のDOUBT」(1920x1080 HEVC 10bit FLAC).mkv", dict(bonus="NCED", episode_title="本能のDOUBT")),
    ("[アニメ BD] Show(第1期) 映像特典「告知CM(発売中)」(specs).mkv", dict(bonus="CM")),
    ("[アニメ BD] Show(第4期) 映像特典「予告」(specs).mkv", dict(bonus="Preview")),
    ("[アニメ BD] Show(第3期)「メニュー画面集」.rar", dict(bonus="Menu")),
    ("Show.S01E01.1080p.BluRay.10-Bit.x265-iAHD.mkv", dict(release_group="iAHD", bit_depth=10)),
    ("[FLE] Show - 01 [BD 1080p].mkv", dict(release_group="FLE")),
    ("Show.S01E05v2.1080p.mkv", dict(season=1, episode=5, version=2)),
    ("[Group] Show - 14 END [1080p].mkv", dict(episode=14)),
    ("[Group] Show - 01 ~ 13 [1080p]", dict(batch_range=(1, 13), episode=None)),
    ("[Erai-raws] Golden Kamuy 4th Season - 01 [1080p].mkv", dict(season=4, episode=1, title="Golden Kamuy")),
    ("Movie.2001.1080p.BluRay.FLAC.2.0.x265.mkv", dict(audio_codecs=["FLAC 2.0"], year=2001)),
    ("Show.S01E02.1080p.DTSHD-MA.5.1.x264-GRP.mkv", dict(episode=2, release_group="GRP")),
    ("Show.TrueHD.5.1-GRP.mkv", dict(audio_codecs=["TrueHD 5.1"], release_group="GRP")),
    ("Evangelion.2.0.You.Can.Not.Advance.1080p.BluRay.mkv", dict(title="Evangelion 2.0 You Can Not Advance", episode=None)),
    ("Go.For.It.Nakamura-kun.S01E01.1080p.mkv", dict(title="Go For It Nakamura-kun", episode=1)),
    ("[Group] Show [DVD-R].mkv", dict(source_type="DVD-R")),
    ("[Group] Show [SDTV].mkv", dict(source_type="SDTV")),
    ("Show.S01E01-E03.1080p.mkv", dict(episode=1, episodes=[1, 2, 3])),
    ("Show.S01E01E02.1080p.mkv", dict(episode=1, episodes=[1, 2])),
    ("ショーの名前 / Show Name - 03 [1080p].mkv", dict(title="ショーの名前", title_alt="Show Name", episode=3)),
    ("[]", dict(title=None)),
    ("Plain Title", dict(title="Plain Title", reasons=[])),
    ("a) b [c", dict(reasons=["bracket is not closed", "bracket is not opened"])),
]


def test_known_names(spark):
    rows = spark.createDataFrame([(n,) for n, _ in KNOWN] + [(KNOWN[0][0],), (None,)], "component string")
    found = {r["component"]: r for r in N.parse_components(rows).collect()}
    assert len(found) == len(KNOWN)
    wrong = [(n, k, found[n][k], v) for n, want in KNOWN for k, v in want.items() if found[n][k] != v]
    assert not wrong


def test_paths(spark):
    paths = ["[Erai-raws] Gungrave - 01~26 [1080p]/[Erai-raws] Gungrave - 01 [1080p][C0751D22].mkv", "Yatagarasu/Season 01/file.mkv", "[Cyan] Champignon no Majo - 08 [WEB 1080p x265].mkv", "Show S01-S02 BDRip x265-EMBER/Extras 720p/Show - 03.mkv"]
    got = {r["path"]: r for r in N.parse_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    a, b, c, d = (got[p] for p in paths)
    assert (a["episode"], a["checksum"], a["title"], a["path_title"], tuple(a["batch_range"])) == (1, "C0751D22", "Gungrave", "Gungrave", (1, 26))
    assert (b["path_title"], b["title"]) == ("Yatagarasu", "file") and (c["path_title"], c["episode"]) == (None, 8)
    assert (d["path_title"], d["resolution"], d["episode"]) == ("Show", "720", 3)


def machine(text):
    """Spans by a stack of one kind at a time."""
    pairs, kinds = {"[": "]", "(": ")", "「": "」"}, {"[": "bracket", "(": "paren", "「": "quote"}
    out, held, mark, depth = [], "", "", 0
    for c in text:
        if not mark:
            if c in pairs:
                out += [("text", held)] if held.strip(" ") else []
                held, mark, depth = "", c, 1
            else:
                held += c
        elif c == mark:
            depth, held = depth + 1, held + c
        elif c == pairs[mark]:
            depth -= 1
            if depth:
                held += c
            else:
                out.append((kinds[mark], held))
                held, mark = "", ""
        else:
            held += c
    if mark:
        return [*out, (kinds[mark], held)]
    return out + ([("text", held)] if held.strip(" ") else [])


def test_nested_brackets_equal_a_stack_machine(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("[[]](())「」ab ") for _ in range(rng.randint(0, 24))) for _ in range(400)} | {"[" * 30 + "a" + "]" * 30})
    got = {}
    for r in N.spans(spark.createDataFrame([(t,) for t in texts], "component string")).collect():
        got.setdefault(r["component"], []).append((r["at"], r["kind"], r["text"]))
    for t in texts:
        assert [x[1:] for x in sorted(got.get(t, []))] == machine(t), t


def plain_tokens(text):
    """Greedy from left to right: three segments, two, one, each with or without a dashed end."""
    known = lambda w: re.fullmatch("(?i:" + "|".join(f"(?:{p})" for _, p in N.KINDS) + ")", w) is not None
    parts, out, i = [p for p in text.split(".") if p], [], 0
    while i < len(parts):
        for n in (3, 2):
            whole = ".".join(parts[i : i + n])
            tail = re.search(r"-([A-Za-z][^.]*)$", parts[i + n - 1]) if i + n <= len(parts) else None
            if i + n <= len(parts) and known(whole):
                out, i = [*out, whole], i + n
                break
            if tail and known(whole[: -len(tail.group())]):
                out, i = [*out, whole[: -len(tail.group())], tail.group(1)], i + n
                break
        else:
            pair, dash = ".".join(parts[i : i + 2]), re.fullmatch(r"(.+)-([A-Za-z][A-Za-z0-9]+)", parts[i])
            if i + 2 <= len(parts) and re.fullmatch(N.CHANNELS, pair):
                out, i = [*out, pair], i + 2
            elif not known(parts[i]) and dash and known(dash.group(1)):
                out, i = [*out, *dash.groups()], i + 1
            else:
                out, i = [*out, parts[i]], i + 1
    return out


def test_compounds_equal_a_plain_tokenizer(spark):
    rng = random.Random(6)
    bits = ["H", "264", "TrueHD", "5", "1", "2", "0", "MA", "FLAC", "AAC2", "1080p", "WEB-DL", "x265-GRP", "264-GRP", "1-Hinna", "Show", "Cherry-Pick", "", "DTS-HD"]
    texts = sorted({".".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(300)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.filter(F.split("t", r"\."), lambda w: w != "")
    for r in rows.select("t", F.transform(N.longest(words, "."), lambda x: x["text"]).alias("got")).collect():
        assert r["got"] == plain_tokens(r["t"]), r["t"]


def spaced_tokens(words):
    """Greedy from left to right: three words that have a kind together, two, one."""
    known = lambda w: re.fullmatch("(?i:" + "|".join(f"(?:{p})" for _, p in N.KINDS) + ")", w) is not None
    out, i = [], 0
    while i < len(words):
        n = next((n for n in (3, 2) if i + n <= len(words) and known(" ".join(words[i : i + n]))), 1)
        out, i = [*out, " ".join(words[i : i + n])], i + n
    return out


def test_compounds_of_words_equal_a_plain_tokenizer(spark):
    rng = random.Random(7)
    bits = ["DTS-HD", "MA", "5.1", "MA5.1", "FLAC", "2.0", "AAC", "1", "~", "13", "～2", "7v2", "END", "2nd", "Season", "3", "NC", "Creditless", "OP1", "ED", "Dual", "Audio", "multiple", "Subtitle", "Dolby", "vision", "Hi10", "10", "bit", "Show", "H.264", "S2"]
    texts = sorted({" ".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(1500)})
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", F.transform(N.longest(F.split("t", " "), " "), lambda x: x["text"]).alias("got")).collect():
        want = spaced_tokens(r["t"].split(" "))
        assert r["got"] == want, r["t"]


def test_problems_read_and_parse_names_once(spark):
    """One pass over the names: one scan and one fold into spans, and titles aren't assembled a second time by the filter."""
    rows = spark.range(20).selectExpr("concat('[G] Show ', id, ' [x') AS component")
    found = N.problems(N.parse_components(rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Range ("), plan.count("regexp_extract_all(regexp_replace(component"), plan.count("array_join(transform(")) == (1, 1, 1)
    assert {tuple(r["reasons"]) for r in found.collect()} == {("bracket is not closed",)} and found.count() == 20


def test_names_are_not_made_again_to_find_nulls(spark):
    """The filter of nulls stays above the rows' distinct names, and doesn't make a name for every row of the input."""
    rows = spark.range(40).selectExpr("id % 5 AS k", "nullif(id % 2, 1) AS n").distinct().selectExpr("concat('Show ', k, '.', n) AS component")
    found = N.distinct_components(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("concat(Show") == 1
    assert sorted(r["component"] for r in found.collect()) == [f"Show {k}.0" for k in range(5)]
