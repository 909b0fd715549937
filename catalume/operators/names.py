"""Release names by tokens: nested spans, longest-match compounds, rules of context, assembly.

Distinct path components become ordered rows of tokens. Spans of brackets are a fold over an
array, compounds of several words are marked in the text; both stay within a row. What a token
means beside its neighbours (a title word that is also a codec, a marker after an episode) is
decided by windows over the ordered tokens of a component, all on one partitioning. Attributes
are aggregates over those rows, and paths take them from their components by a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .release import path_components

# Endings of files, words of each kind, site names and the like.
ENDINGS = ("mkv", "mp4", "m4v", "avi", "rar", "iso", "zip", "7z", "webdl")
_AUDIO = r"(?:DTS-?HD\s*MA|DTS-?HDMA|DTS-HD|DTSHD|DTS|DDP|DD\+|DD|EAC3|E-AC-3|AC3|AAC|FLAC|Opus|TrueHD|PCM|LPCM)"
AUDIO = rf"{_AUDIO}(?:[.\s]?\d\.\d)?"
VIDEO = r"HEVC|AVC|x26[45]|h\.?26[45]|AV1|XviD|DivX|MPEG2|VP9"
SERVICES = ("amzn", "cr", "nf", "dsnp", "hidive", "hidi", "hulu", "adn", "unext", "atvp", "funi", "pcok", "pmtp", "stan", "it", "ma", "kntv", "tver", "abema", "vrv", "bili")
MEDIA = {"BD": "bd|blu-ray|bluray|bdrip|bdremux", "Web": "web|web-dl|webdl|webrip|" + "|".join(SERVICES), "DVD": "dvd|dvdrip", "DVD-R": "dvd-r|dvdr", "HDTV": "hdtv|raw", "SDTV": "sdtv", "VCD": "vcd", "CD-R": "cd-r|cdr"}
LANGUAGES = r"dual|multi|jpn|eng|ger|fre|spa|ita|chi|kor|rus|ara|por|tha"
SUBTITLES = r"sub|subs|multisub|msubs|subtitle|subtitles|multiple subtitle|esub|esubs|csub|hsub"
HDR = r"hdr|hdr10|hdr10\+|dv|dovi|dolby vision|uhd|ultrahd"
EDITIONS = r"criterion|remastered|uncut|theatrical|extended"
SITES = ("tgx", "eztv", "eztvx.to", "rartv", "ettv", "ion10")
BONUS_ENGLISH = {"NCOP": r"(?:NC\s*|Creditless\s+)OP\d*", "NCED": r"(?:NC\s*|Creditless\s+)ED\d*"}
BONUS_JAPANESE = {"ノンテロップOP": "NCOP", "ノンテロップED": "NCED", "ノンテロップ": "NCOP", "PV": "PV", "予告": "Preview", "告知CM": "CM", "メニュー画面": "Menu", "特典": "Bonus"}
COUNTED = ("part", "vol", "volume", "chapter", "movie")
AMBIGUOUS = ("it", "ma", "stan", "opus")
CHANNELS = r"[2567]\.[012]"
_DECIMAL = r"^(?!(?:19|20)\d\d\.)\d{1,4}\.\d{1,2}$"

_BONUS = "|".join([*BONUS_ENGLISH.values(), "映像特典", *BONUS_JAPANESE])
_MULTI = r"S\d{1,2}E\d{1,4}(?:-E?\d{1,4}|(?:E\d{1,4})+)"
_SINGLE = r"S\d{1,2}E\d{1,4}(?:v\d+)?"
_SPECIAL = r"S\d{1,2}(?:OVA|OAD|ONA|SP|OP|ED)\d*|(?:Special|SP|OVA|OAD|ONA)\d*"
_SEASON = r"第\d{1,2}期|\d+(?:st|nd|rd|th)\s+Season|Season\s+\d{1,2}"
_YEARS = r"(?:19[4-9]\d|20\d\d)"
_BARE = r"(?!(?:19|20)\d\d$)\d{1,4}|\d{1,4}v\d+(?:\.\d+)?"
#: Kinds by whole words, the first that fits wins.
KINDS = (
    ("episode", rf"{_MULTI}|{_SINGLE}|第\d{{1,4}}話"),
    ("batch", r"\d{1,4}\s*[~～]\s*\d{1,4}"),
    ("special", _SPECIAL),
    ("season", rf"{_SEASON}|S\d{{1,2}}"),
    ("episode", rf"\d{{1,4}}(?:v\d+)?\s*END|EP?\d{{1,4}}(?:v\d+)?|{_BARE}"),
    ("bonus", _BONUS),
    ("audio", AUDIO),
    ("resolution", r"(?:480|540|576|720|1080)[pi]|2160p|4K|\d{3,4}x\d{3,4}[pi]?"),
    ("video", VIDEO),
    ("source", "|".join(MEDIA.values())),
    ("remux", "REMUX"),
    ("checksum", r"[0-9A-F]{8}"),
    ("year", _YEARS),
    ("version", r"v\d+(?:\.\d+)?"),
    ("dual_audio", r"Dual[- .]?Audio|DUAL"),
    ("language", LANGUAGES),
    ("subtitle", SUBTITLES),
    ("hdr", HDR),
    ("depth", r"(?:Hi)?\d+[- ]?bit|Hi\d+P?"),
    ("uncensored", "Uncensored"),
    ("edition", EDITIONS),
    ("unknown", r"REPACK\d?"),
    ("site", r"www\.\w+\.\w+"),
)
#: Several words that are one, in whole texts by dots and by spaces: what of the kinds holds such a joint.
COMPOUNDS = {
    ".": rf"{_AUDIO}[.\s]?\d\.\d|h\.26[45]|\d{{0,4}}v\d+\.\d+|Dual\.Audio|www\.\w+\.\w+",
    " ": rf"\d{{1,4}}(?: [~～] ?|[~～] )\d{{1,4}}|\d+(?:st|nd|rd|th) Season|Season \d{{1,2}}|\d{{1,4}}(?:v\d+)? END|(?:NC|Creditless) (?:OP|ED)\d*"
    rf"|DTS-?HD MA(?:[. ]?\d\.\d)?|{_AUDIO} \d\.\d|Dual Audio|multiple subtitle|dolby vision|(?:Hi)?\d+ bit",
}
#: Kinds that tell nothing about where a title ends.
PLAIN = ("text", "segment", "separator", "paren", "bracket", "episode_title")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _fits(text: Column, pattern: str) -> Column:
    """``rlike`` for functions over arrays, where that decodes its pattern once more for every element."""
    return F.regexp_instr(text, F.lit(pattern)) > 0


def kind_of(word: Column) -> Column:
    """The kind of a word, or of several that belong together; null where none fits."""
    return F.coalesce(*[F.when(word.rlike(f"^(?i:{p})$"), F.lit(k)) for k, p in KINDS])


def _one_of(*kinds: str) -> str:
    """Pattern of whole words of these kinds, or of any kind."""
    return "^(?i:" + "|".join(f"(?:{p})" for k, p in KINDS if k in kinds or not kinds) + ")$"


def _known(word: Column) -> Column:
    return _fits(word, _one_of())


def is_media_word(word: Column) -> Column:
    """Whether the word, or one of its parts between dashes, has a kind."""
    return _known(word) | (word.contains("-") & F.exists(F.split(word, "-"), _known))


_TOKENS = "array<struct<kind:string,text:string,embedded:boolean>>"
#: Kinds of tokens on their way: one that :func:`kind_of` names, and texts that are still taken apart.
_NAMED, _DOTTED, _SPACED, _PART = "?", "by dots", "by words", "part"
#: Noncharacters around a compound on its way.
_MARKS = ("\uFDD0", "\uFDD1")


def _token(kind: Column | str, text: Column, embedded: bool = False) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), text.alias("text"), F.lit(embedded).alias("embedded"))


def distinct_components(rows: DataFrame) -> DataFrame:
    """Each ``component`` once. The one exchange serves all windows and the assembly; its number of partitions is given, as the work is in the rows and not in their bytes.

    Nulls are left out of an exploded column: a filter on the given one would go down to the input and make every row's name there once more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(F.explode(F.array("component")).alias("component")).where("component is not null").repartition(parts, "component").distinct()


def _spans(component: Column) -> Column:
    """R2: ordered spans ``(kind, text, closed)``: brackets at any depth, and the text between them.

    A fold over the marks: inside a span only its own kind of bracket counts, and the span
    ends where that depth comes back to zero. A span that is never closed reaches to the end.
    """
    ends = F.regexp_replace(component, rf"(?i)\.(?:{'|'.join(ENDINGS)})$", "")
    atoms = F.regexp_extract_all(ends, F.lit(r"([\[\]()「」]|[^\[\]()「」]+)"), 1)
    span = "array<struct<kind:string,text:string,closed:boolean>>"
    opens = F.create_map(*[F.lit(x) for x in ("[", "bracket", "(", "paren", "「", "quote")])
    closes = F.create_map(*[F.lit(x) for x in ("[", "]", "(", ")", "「", "」")])

    def state(done: Column, mark: Column, depth: Column, held: Column) -> Column:
        return F.struct(done.alias("done"), mark.alias("mark"), depth.alias("depth"), held.alias("held"))

    def put(a: Column, kind: Column, closed: bool) -> Column:
        new = F.array_append(a["done"], F.struct(kind.alias("kind"), a["held"].alias("text"), F.lit(closed).alias("closed")))
        return F.when((kind == "text") & (F.trim(a["held"]) == ""), a["done"]).otherwise(new)

    def step(a: Column, x: Column) -> Column:
        on = state(a["done"], a["mark"], a["depth"], F.concat(a["held"], x))
        opened = state(put(a, F.lit("text"), True), x, F.lit(1), F.lit(""))
        deeper = state(a["done"], a["mark"], a["depth"] + 1, F.concat(a["held"], x))
        higher = state(a["done"], a["mark"], a["depth"] - 1, F.concat(a["held"], x))
        closed = state(put(a, opens[a["mark"]], True), F.lit(""), F.lit(0), F.lit(""))
        out = F.when(a["mark"] == "", F.when(x.isin("[", "(", "「"), opened).otherwise(on))
        out = out.when(x == a["mark"], deeper).when(x == closes[a["mark"]], F.when(a["depth"] == 1, closed).otherwise(higher))
        return out.otherwise(on)

    def finish(a: Column) -> Column:
        return F.when(a["mark"] == "", put(a, F.lit("text"), True)).otherwise(put(a, opens[a["mark"]], False))

    start = state(F.array().cast(span), F.lit(""), F.lit(0), F.lit(""))
    return F.aggregate(atoms, start, step, finish)


def spans(components: DataFrame) -> DataFrame:
    """R2: rows ``(component, at, kind, text, closed)`` of the spans of each component."""
    found = components.select("component", _spans(F.col("component")).alias("spans"))
    # outer, so that no filter on the size of the spans is inferred, which would find them twice
    return found.select("component", F.posexplode_outer("spans").alias("at", "s")).where("s is not null").select("component", "at", "s.*")


def longest(words: Column, joint: str) -> Column:
    """Tokens of ``words``; up to three that have a kind together are one, longest first, from left to right.

    Compounds are marked in the joined text, by noncharacters, before it is parted again. A dash
    and a name behind a compound are a token of their own, ``H.264-GROUP``; so are the parts of a
    dashed word of which one has a kind.
    """
    end = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?"
    whole = rf"(?i:{COMPOUNDS[joint]}){end}"
    if joint == ".":
        whole = rf"{whole}(?:-[A-Za-z][^.]*)?|{CHANNELS}{end}"
    marked = F.regexp_replace(F.array_join(words, joint), rf"(?<![^{joint}])(?:{whole})(?![^{joint}])", f"{_MARKS[0]}$0{_MARKS[1]}")
    items = F.regexp_extract_all(marked, F.lit(rf"{_MARKS[0]}[^{_MARKS[1]}]*{_MARKS[1]}|[^{joint}]+"), F.lit(0))

    def compound(text: Column) -> Column:
        if joint == " ":
            return F.array(_token(_NAMED, text))
        tail = r"-([A-Za-z][^.]*)$"
        told = lambda more: F.when(more == "", F.array(_token(_NAMED, text))).otherwise(F.array(_token(_NAMED, F.regexp_replace(text, tail, "")), _token(F.when(_known(more), _NAMED).otherwise("group"), more)))
        return F.when(_fits(text, f"^{CHANNELS}$"), F.array(_token("channels", text))).otherwise(_let(F.regexp_extract(text, tail, 1), told))

    def single(one: Column, i: Column) -> Column:
        named = F.array(_token(_NAMED, one))
        if joint == ".":
            head, more = F.regexp_extract(one, r"^(.+)-([A-Za-z][A-Za-z0-9]+)$", 1), F.regexp_extract(one, r"^(.+)-([A-Za-z][A-Za-z0-9]+)$", 2)
            dashed = one.contains("-") & (head != "") & _known(head)
            return F.when(_known(one), named).when(dashed, F.array(_token(_NAMED, head), _token("group", more))).otherwise(F.array(_token("segment", one)))
        parts = F.filter(F.split(one, "-"), lambda p: p != "")
        last = F.when(is_media_word(one), "group").otherwise("unknown")
        told = F.transform(parts, lambda p, k: _token(F.when(_known(p), _NAMED).when((k > 0) & (k == F.size(parts) - 1), last).otherwise("unknown"), p))
        name = F.array(_token(F.when(one.startswith("-") & (i > 0), "group").otherwise("unknown"), F.regexp_replace(one, "^-", "")))
        out = F.when(_fits(one, _DECIMAL), F.array(_token("episode", one))).when(_known(one), named)
        return out.when(one.contains("-") & ~one.startswith("-"), told).otherwise(name)

    each = lambda x, i: F.when(x.startswith(_MARKS[0]), _let(F.translate(x, "".join(_MARKS), ""), compound)).otherwise(single(x, i))
    return F.flatten(F.transform(items, each))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s,]+"), lambda w: w != "")


def _scene(text: Column) -> Column:
    dots = F.char_length(text) - F.char_length(F.replace(text, F.lit("."), F.lit("")))
    return (dots >= 2) & ~text.contains(" ")


def _part(text: Column) -> Column:
    """A text between separators: the whole of it, or what stands around markers in it."""
    early = r"(?<![^ \t_-])"
    marks = rf"(?i){early}({_MULTI}|{_SINGLE}|{_SPECIAL}|第\d{{1,4}}話|{_SEASON}|EP?\d{{1,4}}(?:v\d+)?(?=[\s.]|$))(?!(?<=[A-Za-z])[A-Za-z])"
    marked = F.regexp_replace(text, marks, "\u0001$1\u0001")
    # the first number between spaces: no year, not behind a word that counts parts or another number, no channel layout
    number = rf"(?i)^(|.*? )(?<!(?:^| )(?:{'|'.join(COUNTED)}) )(?<!\d )(?!(?:19|20)\d\d(?: |$))(?![2567] [012](?: |$))(\d{{1,4}}(?:v\d+(?:\.\d+)?)?)(?= |$)"
    cut = _let(marked, lambda m: F.when(m != text, m).otherwise(F.regexp_replace(text, number, "$1\u0001$2\u0001")))
    pieces = F.filter(F.transform(F.split(cut, "\u0001"), lambda p: F.regexp_replace(p, r"^[\s-]+|\s+$", "")), lambda p: ~p.isin("", "(終)", "（終）"))

    def told(p: Column, after: Column) -> Column:
        """A marker or other word with a kind; else a title, with the words of media behind it if a marker is before it."""

        def parted(w: Column) -> Column:
            flags = F.transform(w, lambda x: is_media_word(x) & ~_fits(x, r"^\d+$"))
            at = F.array_position(flags, True).cast("int")
            two = F.array(_token("text", F.array_join(F.slice(w, F.lit(1), at - 1), " "), True), _token(_SPACED, F.array_join(F.slice(w, at, F.size(w)), " ")))
            return F.when(at > 1, two).otherwise(F.array(_token("text", p, True)))

        bonus = _fits(p, rf"(?i){early}(?:{_BONUS})")
        out = F.when(_known(p), F.array(_token(_NAMED, p, True))).when(bonus, F.array(_token("bonus", p, True)))
        return out.when(after, _let(F.filter(F.split(p, " "), lambda x: x != ""), parted)).otherwise(F.array(_token("text", p, True)))

    def all_told(found: Column) -> Column:
        behind = lambda i: F.exists(F.slice(found, F.lit(1), i), lambda q: _fits(q, _one_of("episode", "special")))
        return F.flatten(F.transform(found, lambda p, i: told(p, behind(i))))

    whole = F.when(_fits(text, f"^{CHANNELS}$"), "channels").when(_fits(text, _DECIMAL), "episode").when(_known(text), _NAMED)
    return _let(whole, lambda k: F.when(k.isNotNull(), F.array(_token(k, text))).otherwise(_let(pieces, all_told)))


def _text(text: Column) -> Column:
    """A span outside brackets: a scene name by its dots, else parts between separators."""
    clean = F.transform(F.split(text, r" - |_-_"), lambda p: F.regexp_replace(F.trim(p), r"^_+|_+$", ""))

    def each(p: Column, i: Column) -> Column:
        line = F.when(i > 0, F.array(_token("separator", F.lit(" - ")))).otherwise(F.array().cast(_TOKENS))
        return F.when(p == "", line).otherwise(F.concat(line, F.array(_token(_PART, p))))

    return F.when(_scene(F.trim(text)), F.array(_token(_DOTTED, F.trim(text)))).otherwise(F.flatten(F.transform(clean, each)))


def _media_count(text: Column) -> Column:
    return F.size(F.filter(_words(text), is_media_word))


_CHECKSUM = r"^(?i:[0-9A-F]{8})$"


def _subtitled(text: Column) -> Column:
    return F.lower(text).contains("subtitle") | _fits(F.lower(text), f"^(?:{SUBTITLES})$")


def _bracket(text: Column, first: Column) -> Column:
    """A square bracket; ``first`` of its component it names the group, unless it holds media words."""
    inner = F.trim(text)
    one = lambda kind: F.array(_token(kind, inner))
    site = F.lower(inner).isin(*SITES)
    words = F.split(text, r"[\s,]+")
    media = _let(_media_count(text), lambda n: (n > 0) & (n >= F.floor(F.size(words) / 2)))
    head = F.regexp_extract(text, r"^([^\s,]*)", 1)
    rest = F.regexp_replace(text, r"^[^\s,]*[\s,]*", "")
    expanded = F.when((head != "") & ~is_media_word(head), F.array(_token("group", head), _token(_SPACED, rest))).otherwise(F.array(_token(_SPACED, text)))
    dotted = inner.contains(".") & ~inner.contains(" ") & F.exists(F.split(inner, r"\."), is_media_word)
    out = F.when(_fits(inner, _CHECKSUM), one("checksum")).when(_subtitled(text), one("subtitle")).when(dotted, one(_DOTTED))

    def other(media: Column) -> Column:
        named = F.when(first & ~media & ~site, F.array(_token("group", text))).when(media, expanded)
        return named.when(_fits(inner, r"^\p{L}{2,6}$") & ~site, one("group")).otherwise(F.array(_token("bracket", text)))

    return out.otherwise(_let(media, other))


def _paren(text: Column) -> Column:
    inner = F.trim(text)
    plain = F.when(text.contains("_"), F.regexp_replace(F.replace(text, F.lit("_"), F.lit(" ")), r"([a-zA-Z])(\d+p\b)", "$1 $2")).otherwise(text)
    alone = _one_of("year", "season", "episode", "special", "dual_audio", "uncensored", "edition")
    out = F.when(_fits(inner, alone), F.array(_token(_NAMED, inner))).when(F.lower(text).contains("softsub"), F.array(_token("subtitle", text)))
    out = out.when(_media_count(plain) >= 2, F.array(_token(_SPACED, plain)))
    return out.when(_fits(inner, r"^\p{L}{2}$"), F.array(_token("language", inner))).otherwise(F.array(_token("paren", text)))


def _open(told: Column) -> Column:
    """Tokens of a span, with parts and words taken apart."""
    parts = lambda t: F.when(t["kind"] == _PART, _part(t["text"])).otherwise(F.array(t))

    def apart(t: Column) -> Column:
        dotted = longest(F.filter(F.split(t["text"], r"\."), lambda w: w != ""), ".")
        return F.when(t["kind"] == _DOTTED, dotted).when(t["kind"] == _SPACED, longest(_words(t["text"]), " ")).otherwise(F.array(t))

    return F.flatten(F.transform(F.flatten(F.transform(told, parts)), apart))


def _told(components: DataFrame) -> DataFrame:
    """The ordered tokens of distinct components, each with its component's ``reasons``, as their context tells them."""
    rows = components.select("component", _spans(F.col("component")).alias("spans"))
    claims = lambda s: (s["kind"] == "bracket") & ~_fits(F.trim(s["text"]), _CHECKSUM) & ~_subtitled(s["text"])

    def tokens_of(s: Column, first: Column) -> Column:
        text, kind = s["text"], s["kind"]
        quote = F.array(_token(F.when(_fits(text, rf"(?i)(?<![^ \t_-])(?:{_BONUS})"), "bonus").otherwise("episode_title"), text))
        return _open(F.when(kind == "bracket", _bracket(text, first)).when(kind == "paren", _paren(text)).when(kind == "quote", quote).otherwise(_text(text)))

    def opened(claim: Column) -> Column:
        """Tokens of all spans, with their places; up to the first bracket that claims it a bracket may name the group."""
        placed = lambda s, at: F.transform(tokens_of(s, (claim == 0) | (at < claim)), lambda t, pos: F.struct(at.alias("at"), pos.alias("pos"), t["kind"].alias("kind"), t["text"].alias("text"), t["embedded"].alias("embedded")))
        return F.flatten(F.transform("spans", placed))

    claim = F.array_position(F.transform("spans", claims), True).cast("int")
    # outer, so that no filter on the size of the tokens is inferred, which would find them twice
    each = rows.select("component", coverage(F.col("spans")).alias("reasons"), F.explode_outer(_let(claim, opened)).alias("t")).where("t is not null").select("component", "reasons", "t.*")
    return in_context(each.withColumn("kind", F.when(F.col("kind") == _NAMED, kind_of(F.col("text"))).otherwise(F.col("kind"))))


def tokens(components: DataFrame) -> DataFrame:
    """The ordered tokens ``(component, at, pos, kind, text)`` of distinct components, as their context tells them."""
    return _told(components).drop("reasons")


def in_context(found: DataFrame) -> DataFrame:
    """Kinds that depend on what stands before or behind a token in its component; other columns stay."""
    order = Window.partitionBy("component").orderBy("at", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kind, text = F.col("kind"), F.lower("text")
    doubtful = kind.isin("source", "audio") & text.isin(*AMBIGUOUS)
    media = ~kind.isin(*PLAIN, "channels") & ~doubtful
    seen = F.coalesce(F.max(media).over(before), F.lit(False))
    numbered = F.coalesce(F.max(kind == "episode").over(before), F.lit(False))
    last = F.lead("kind").over(order).isNull()
    marked = F.when(kind == "channels", F.when(F.col("seen"), "audio").otherwise("text"))
    marked = marked.when(doubtful & ~F.col("seen"), "text")
    marked = marked.when(F.col("embedded") & F.col("numbered") & kind.isin("episode", "season", "special"), "text")
    marked = marked.when((kind == "segment") & F.col("seen") & F.col("last") & F.col("text").rlike(r"^[\p{L}\p{N}]{2,8}$"), "group")
    marked = marked.when(kind == "segment", "text").otherwise(kind)
    rows = found.withColumn("seen", seen).withColumn("numbered", numbered).withColumn("last", last)
    return rows.select("component", "at", "pos", marked.alias("kind"), "text", *[c for c in found.columns if c not in ("component", "at", "pos", "kind", "text", "embedded")])


def _bonus_kind(text: Column) -> Column:
    english = [F.when(_fits(text, rf"(?i)(?:{p})"), F.lit(k)) for k, p in BONUS_ENGLISH.items()]
    return F.coalesce(*[F.when(text.contains(w), F.lit(k)) for w, k in BONUS_JAPANESE.items()], *english)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, f"(?i){pattern}", group).try_cast("int")


FIELDS = ("title", "title_alt", "episode_title", "season", "episode", "episodes", "version", "is_special", "bonus", "batch_range", "release_group", "source_type", "service", "remux", "dual_audio", "criterion", "uncensored", "bit_depth", "hdr", "checksum", "resolution", "video_codec", "audio_codecs", "year")


def assemble(told: DataFrame) -> DataFrame:
    """One row of attributes a component; the first token that tells an attribute wins, of several groups the last.

    The ordered tokens of a component are one array; each attribute reads it once. Columns that
    its tokens have in common stay.
    """
    kept = [c for c in told.columns if c not in ("component", "at", "pos", "kind", "text")]
    rows = told.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("at", "pos", "kind", "text"))).alias("tokens"), *[F.first(c).alias(c) for c in kept])
    every = F.col("tokens")

    def where(*kinds: str) -> Column:
        return F.filter(every, lambda t: t["kind"].isin(*kinds))

    def texts(*kinds: str) -> Column:
        return F.transform(where(*kinds), lambda t: t["text"])

    def first(found: Column) -> Column:
        return F.get(found, F.lit(0))

    def of(kind: str) -> Column:
        return first(texts(kind))

    def firsts(found: Column, value: Callable[[Column], Column]) -> Column:
        return first(F.filter(F.transform(found, value), lambda v: v.isNotNull()))

    season_in = lambda t: _number(t, r"^S(\d{1,2})(?:E|OVA|OAD|ONA|SP|OP|ED)")
    season_no = lambda t: F.coalesce(_number(t, r"第(\d+)期"), _number(t, r"^(\d+)(?:st|nd|rd|th)"), _number(t, r"^(?:Season\s+|S)(\d{1,2})$"))
    source = lambda t: F.coalesce(*[F.when(_fits(F.lower(t), f"^(?:{p})$"), F.lit(k)) for k, p in MEDIA.items()])
    at = F.array_position(F.transform(every, lambda t: t["kind"].isin("episode", "special")), True).cast("int")
    rows = rows.withColumn("marker", F.when(at > 0, at)).withColumn("episode_text", of("episode")).withColumn("resolution_text", of("resolution"))
    before = F.when(F.col("marker").isNull(), every).otherwise(F.slice(every, F.lit(1), F.col("marker") - 1))
    rows = rows.withColumn("behind", F.slice(every, F.col("marker") + 1, F.size(every)))
    behind = F.col("behind")
    stop = F.array_position(F.transform(behind, lambda t: ~t["kind"].isin(*PLAIN, "episode", "special")), True).cast("int")
    behind = _let(stop, lambda n: F.when(n > 0, F.slice("behind", F.lit(1), n - 1)).otherwise(F.col("behind")))
    piece = lambda t: F.when(t["kind"] == "text", t["text"]).when(t["kind"] == "paren", F.concat(F.lit("("), t["text"], F.lit(")"))).when(t["kind"] == "bracket", F.concat(F.lit("["), t["text"], F.lit("]")))
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*-\s*$", ""), r"\s+", " ")
    joined = lambda found, told: F.array_join(F.transform(found, told), " ")
    line = F.filter(every, lambda t: t["kind"] == "episode_title")
    named = F.concat(line, F.coalesce(F.filter(behind, lambda t: t["kind"] == "text"), F.slice(line, 1, 0)))
    e, r = F.col("episode_text"), F.col("resolution_text")
    number = F.coalesce(_number(e, r"^S\d{1,2}E(\d{1,4})"), _number(e, r"^第(\d+)話"), _number(e, r"^(?:EP?)?(\d{1,4})"))
    last = F.coalesce(_number(e, r"^S\d{1,2}E\d{1,4}-E?(\d{1,4})$"), F.when(e.rlike(r"(?i)^S\d{1,2}E\d{1,4}E"), _number(e, r"E(\d{1,4})$")))
    special_no = firsts(texts("special"), lambda t: _number(t, r"(?:Special|SP|OVA|OAD|ONA|OP|ED)(\d+)$"))
    special = F.size(where("special", "bonus")) > 0
    e_season = firsts(texts("episode"), season_in)
    s_season = firsts(where("season", "special"), lambda t: F.when(t["kind"] == "season", season_no(t["text"])).otherwise(season_in(t["text"])))
    tall = F.coalesce(_number(r, r"x(\d{3,4})"), _number(r, r"^(\d{3,4})[pi]$"), F.when(F.lower(r) == "4k", 2160))
    wide = _number(r, r"^(\d{3,4})x")
    tall = F.greatest(tall, F.coalesce(*[F.when(wide >= a, F.lit(b)) for a, b in ((3200, 2160), (1800, 1080), (1200, 720))], F.lit(0)))
    credit = lambda t: F.when(_fits(t, r"(?i)^S\d+OP$"), "NCOP").when(_fits(t, r"(?i)^S\d+ED$"), "NCED")
    bonuses = F.filter(F.transform(where("bonus", "episode_title", "special"), lambda t: F.when(t["kind"] == "special", credit(t["text"])).otherwise(_bonus_kind(t["text"]))), lambda b: b.isNotNull())
    batch = of("batch")
    pair = F.struct(_number(batch, r"^(\d+)").alias("first"), _number(batch, r"(\d+)$").alias("last"))
    groups = texts("group")
    out = rows.select(
        "component",
        clean(joined(before, piece)).alias("titles"),
        clean(joined(named, lambda t: t["text"])).alias("behind"),
        firsts(texts("bonus"), lambda t: F.nullif(F.regexp_extract(t, "「([^」]+)」", 1), F.lit(""))).alias("song"),
        F.coalesce(season_in(e), s_season, e_season).alias("season"),
        F.coalesce(number, F.when(special, special_no)).alias("episode"),
        F.when(last >= number, F.sequence(number, last)).alias("episodes"),
        F.coalesce(_number(e, r"\dv(\d+)"), _number(of("version"), r"^v(\d+)")).alias("version"),
        (special | F.coalesce(e.rlike(r"^\d+\.\d+$"), F.lit(False)) | F.coalesce(F.coalesce(season_in(e), e_season) == 0, F.lit(False))).alias("is_special"),
        F.coalesce(first(F.filter(bonuses, lambda b: b != "Bonus")), first(bonuses)).alias("bonus"),
        F.when(batch.isNotNull(), pair).alias("batch_range"),
        F.get(groups, F.size(groups) - 1).alias("release_group"),
        firsts(where("source", "remux"), lambda t: F.when(t["kind"] == "remux", "BD").otherwise(source(t["text"]))).alias("source_type"),
        first(F.filter(texts("source"), lambda t: F.lower(t).isin(*SERVICES))).alias("service"),
        F.exists(where("source", "remux"), lambda t: F.lower(t["text"]).contains("remux")).alias("remux"),
        (F.size(where("dual_audio")) > 0).alias("dual_audio"),
        F.exists(texts("edition"), lambda t: F.lower(t) == "criterion").alias("criterion"),
        (F.size(where("uncensored")) > 0).alias("uncensored"),
        _number(of("depth"), r"(\d+)").alias("bit_depth"),
        of("hdr").alias("hdr"),
        F.upper(of("checksum")).alias("checksum"),
        F.when(tall >= 2160, "4K").otherwise(F.coalesce(*[F.when(tall >= h, F.lit(str(h))) for h in (1080, 720, 576, 540, 480, 360)])).alias("resolution"),
        of("video").alias("video_codec"),
        F.transform(texts("audio"), lambda t: F.regexp_replace(t, r"(?<=[a-zA-Z])\.(?=\d)", " ")).alias("audio_codecs"),
        of("year").try_cast("int").alias("year"),
        *kept,
    )
    cjk = r"[　-鿿＀-￯]"
    left, right = F.regexp_extract("titles", r"^(.*?)\s*[/|]\s*(.*)$", 1), F.regexp_extract("titles", r"^(.*?)\s*[/|]\s*(.*)$", 2)
    two = F.col("titles").rlike(r"^[^/|]*\|") | (F.col("titles").rlike("[/|]") & (left.rlike(cjk) != right.rlike(cjk)))
    none = lambda c: F.nullif(c, F.lit(""))
    return out.select(
        "component",
        none(F.when(two, left).otherwise(F.col("titles"))).alias("title"),
        F.when(two, none(right)).alias("title_alt"),
        F.coalesce(none(F.col("behind")), F.col("song")).alias("episode_title"),
        *FIELDS[3:],
        *kept,
    )


def coverage(found: Column) -> Column:
    """Reasons of an array of spans: brackets that don't close, and marks that contradict each other."""
    stray = F.exists(found, lambda s: (s["kind"] == "text") & _fits(s["text"], r"[\])」]"))
    return F.array_compact(F.array(F.when(F.exists(found, lambda s: ~s["closed"]), F.lit("bracket is not closed")), F.when(stray, F.lit("bracket is not opened"))))


def parse_components(components: DataFrame) -> DataFrame:
    """Attributes and reasons of each distinct ``component``, in one pass over them; those without any token are left out."""
    return assemble(_told(distinct_components(components)))


def problems(parsed: DataFrame, key: str = "component") -> DataFrame:
    """``(key, reasons)`` of what has no title, or whose reasons say that the rules can't decide it."""
    told = F.when(F.col("title").isNull(), F.array_append("reasons", F.lit("no title"))).otherwise(F.col("reasons"))
    # as an exploded column, so that the filter stays above it and no title is assembled twice
    return parsed.select(key, F.explode(F.array(told)).alias("reasons")).where(F.size("reasons") > 0)


def loose_attributes(components: DataFrame) -> DataFrame:
    """Attributes of the media words of distinct components, wherever they stand: for directories, which need no brackets."""
    each = components.select("component", F.lit(0).alias("at"), F.posexplode_outer(longest(_words(F.col("component")), " ")).alias("pos", "t")).where("t is not null").select("component", "at", "pos", "t.*")
    return assemble(in_context(each.withColumn("kind", F.when(F.col("kind") == _NAMED, kind_of(F.col("text"))).otherwise(F.col("kind")))))


def clean_title(title: Column) -> Column:
    """A directory's title up to its first season or media word."""
    words = F.split(F.regexp_replace(title, r"\.", " "), " ")
    flags = F.transform(words, lambda w: _fits(w, r"(?i)^S\d{1,2}(?:[-+E].*)?$") | (is_media_word(w) & ~_fits(w, r"^\d+$")))
    at = F.array_position(flags, True)
    return F.when(at > 1, F.array_join(F.slice(words, F.lit(1), (at - 1).cast("int")), " ")).otherwise(title)


def parse_paths(paths: DataFrame, column: str = "path") -> DataFrame:
    """Attributes of each distinct path: the file's own, gaps filled by its directories.

    The outermost directory names the series (``path_title``) and, if it has one, the group;
    media attributes, year and season fill gaps, media attributes from deeper directories
    too, and from the words of directories where no bracket or marker sets them apart. Equal
    components are parsed once, however many files share a directory.
    """
    rows = path_components(paths.select(F.col(column).alias("path")).distinct())
    filled = ("source_type", "service", "bit_depth", "hdr", "resolution", "video_codec", "year")
    loose = loose_attributes(distinct_components(rows.where("level > 0")))
    loose = loose.select("component", *[F.col(c).alias(f"_{c}") for c in (*filled[:-1], "audio_codecs")])
    known = rows.join(parse_components(rows), "component", "left").join(loose, "component", "left")
    known = known.withColumns({c: F.when(F.col("level") > 0, F.coalesce(F.col(c), F.col(f"_{c}"))).otherwise(F.col(c)) for c in filled[:-1]})
    known = known.withColumn("audio_codecs", F.when((F.col("level") > 0) & (F.size("audio_codecs") == 0), F.col("_audio_codecs")).otherwise(F.col("audio_codecs")))
    top = F.max("level").over(Window.partitionBy("path"))
    known = known.withColumn("top", (F.col("level") == top) & (F.col("level") > 0))
    file, outer = F.col("level") == 0, F.col("top")

    def of(cond: Column, name: str) -> Column:
        return F.max_by(F.when(cond, F.struct(F.col(name).alias("v"))), F.when(cond, F.lit(1)))["v"]

    def near(name: str) -> Column:
        rank = F.when(file, 0).when(outer, 1).otherwise(F.lit(1000) - F.col("level"))
        return F.min(F.when(F.col(name).isNotNull(), F.struct(rank.alias("r"), F.col(name).alias("v"))))["v"]

    audio = F.min(F.when(F.size("audio_codecs") > 0, F.struct(F.when(file, 0).when(outer, 1).otherwise(2).alias("r"), F.col("audio_codecs").alias("v"))))["v"]
    flags = [F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("remux", "dual_audio", "criterion", "uncensored")]
    own = ("title", "title_alt", "episode_title", "episode", "episodes", "version", "is_special", "bonus", "checksum")
    merged = known.groupBy("path").agg(
        *[of(file, c).alias(c) for c in own],
        F.coalesce(of(file, "season"), of(outer, "season")).alias("season"),
        F.coalesce(of(file, "batch_range"), of(outer, "batch_range")).alias("batch_range"),
        F.coalesce(of(outer, "release_group"), of(file, "release_group"), near("release_group")).alias("release_group"),
        *[near(c).alias(c) for c in filled],
        F.coalesce(audio, F.array().cast("array<string>")).alias("audio_codecs"),
        *flags,
        of(outer, "title").alias("outer"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"),
    )
    group = F.concat(F.col("release_group"), F.lit(" "))
    bare = F.when(F.startswith("title", group), F.substring("title", F.char_length(group) + 1, F.char_length("title"))).otherwise(F.col("title"))
    return merged.withColumn("title", F.trim(bare)).withColumn("path_title", clean_title(F.col("outer"))).drop("outer")
