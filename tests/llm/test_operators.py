"""The ten operators on small tables, against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from catalume.llm import bwt, features, fingerprint, htmltext, langid, minhash, mixing, pieces, quality, suffixdedup, topk, toxicity
from catalume.llm.queries import PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, a long, sig string, chunk int, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "k", 1, 2, "x", 3, 4) for i, t, l, s in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    base = sentence(rng, 120)
    near = base.replace("gamma", "GAMMA", 3) + " tail"
    rows = [(1, base, "en", "a"), (2, base, "en", "b"), (3, near, None, None), (4, None, "en", "a"), (5, "", "de", "b"), (6, " \t\n", "de", None), (7, "one two", "fr", "a"), (7, "one two", "fr", "a"), (8, "One two", "fr", "c"), (9, sentence(rng, 6000), "en", "a"), (10, "x" * 5000, "de", "b"), (11, "日本語 テキスト " * 30, "ja", "c"), (None, "no id at all", "en", "a"), (12, "\x00 zero \x00" * 40, "en", "b")]
    return make(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((len(t), sum(cover), spans, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


def test_merged_transforms_find_what_counting_finds():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([4, 8, 20])
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        strings += strings[:1] * rng.randint(0, 1)
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
        assert [list(map(int, g)) for g in bwt.repeated_starts(strings, length, shard_bytes=20)] == want


@pytest.mark.parametrize("kinds", [4096, 1])
def test_suffix_dedup(spark, odd, kinds):
    docs, rows = odd
    p = suffixdedup.Params(length=40, gram=10, kinds=kinds, bucket_bytes=2000, slice_bytes=1000)
    got = sorted(map(tuple, suffixdedup.dedup(docs, p).collect()), key=str)
    want = [(r[0], *b) for r, b in zip(rows, brute_removed([(r[1] or "").encode() for r in rows], 40), strict=True)]
    assert got == sorted(want, key=str)
    cut = {r["doc_id"]: r for r in suffixdedup.without_repeats(docs, p).collect()}
    assert cut[4]["text"] is None and cut[1]["text"] == "" and cut[1]["key"] == "k"


def test_suffix_dedup_of_nothing(empty):
    assert suffixdedup.dedup(empty).collect() == []


def shingles(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, s in sets:
            for j, t in sets:
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def test_near_duplicates_against_all_pairs(spark, odd):
    docs, rows = odd
    rng = random.Random(5)
    more = [(r[0], r[1]) for r in rows]
    base = [rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(80)]
    for i in range(60):  # a family around the threshold, chains included
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(80)] = f"new{rng.randint(0, 9)}"
        more.append((100 + i, " ".join(w)))
    df = make(spark, [(i, t, None, None) for i, t in more])
    for p in (minhash.Params(width=4), minhash.Params(width=4, list_rows=5, block_rows=7)):
        got = minhash.near_duplicates(df, p).collect()
        want = brute_components(more, 4)
        assert len(got) == len(more)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(150)]  # many ties
    rows = vecs + [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6), (350, [float("inf")] * 6), (None, [1.0] * 6), (3, vecs[3][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {(r[0], r[1]): (r[2], r[3]) for r in topk.top_k(df, every=50, k=5, range_rows=40, chunk_rows=2, block=8).collect()}
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in vecs}
    want = {}
    for q in (0, 50, 100):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        want |= {(q, k + 1): (c, -s) for k, (s, c) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.where("vec_id < 0")).collect() == []


def test_language_id(spark, empty):
    rng = random.Random(4)
    alphabets = {"en": "the and thing ", "de": "und schön über ", "fr": "été être où "}
    rows = [(i, "".join(rng.choice(alphabets[l].split()) + " " for _ in range(30)), l, "s") for i in range(200) for l in [rng.choice(sorted(alphabets))]]
    rows += [(900, None, "en", "s"), (901, "12 34 !!", "de", "s"), (902, "", None, "s"), (903, "und über " * 3000, None, None), (904, "\U0001f600\U0001f680 \U0001f600", "de", "s")]
    out = {r["doc_id"]: r for r in langid.language_id(make(spark, rows)).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["lang_pred"] == l for i, t, l, _ in rows[:200])
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "und"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.language_id(empty).collect() == []
    unlearned = langid.language_id(make(spark, [(1, "text", None, None)])).collect()
    assert unlearned[0]["lang_pred"] == "und" and unlearned[0]["score"] == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu one</a></nav><div class="ad">Buy now</div>
    <article><h1>A &amp; B</h1><p>First   paragraph that is long enough to count as text of the article body itself.<br>more</p><p>Second one &eacute; with a <b>bold</b> word and a good deal of running text.</p>
    <script>var x = "</p>"</script><section class="comments"><p>Nice post!</p></section></article><aside>Related</aside><footer>&copy; me</footer></body></html>"""
    assert htmltext.main_text(page) == "A & B\nFirst paragraph that is long enough to count as text of the article body itself. more\nSecond one é with a bold word and a good deal of running text."
    assert htmltext.main_text("") == "" and htmltext.main_text("<p>") == "" and htmltext.main_text("<!-- x") == ""
    plain = "<div><a>x</a></div><div><h2>Head</h2><p>" + "word " * 50 + "</p><p>" + "other " * 40 + "</p></div><form>Send</form>"
    assert htmltext.main_text(plain).endswith(("word " * 50).strip() + "\n" + ("other " * 40).strip())


LONG = "A sentence of running text that is long enough to stand above the threshold of its page. " * 4


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<nav><a>m</a></nav><main><h1>Title outside</h1><article><p>{LONG}</p><p>End.</p></article></main>", ["Title outside", LONG.strip(), "End."]),
        (f"<article><p>{LONG}</p></article><article><p>A second and shorter article of one line of text.</p></article>", [LONG.strip(), "A second and shorter article of one line of text."]),
        (f'<article><p>{LONG}</p><p class="ad-hoc">Kept one.</p><p id="share-price">Kept two.</p><div class="article-header"><h2>Kept head</h2></div></article>', [LONG.strip(), "Kept one.", "Kept two.", "Kept head"]),
        (f"<nav><a>x</a></nav><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short last.</p></div><footer>f</footer>", ["Head", LONG.strip(), LONG.strip(), "Short last."]),
        (f'<div class="content-sidebar-wrap has-sidebar"><article><p>{LONG}</p></article><div class="sidebar">Side</div></div>', [LONG.strip()]),
        (f'<article><header><h1>Own head</h1></header><p>{LONG}</p><div class="comments"><p>{LONG}</p></div><aside>x</aside><form>y</form></article>', ["Own head", LONG.strip()]),
        ("<p>" * 3000 + "<b>" * 3000 + LONG, [LONG.strip()]),
    ],
)
def test_html_loses_no_article_text(page, want):
    assert htmltext.main_text(page).split("\n") == want


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>Some words of text here</p>", "x"), (2, None, "<p>Some words of text here</p>", "x")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmltext.extract(df).collect()), key=str)
    assert got == [(1, "u", "", 0), (2, None, "Some words of text here", 23), (2, None, "Some words of text here", 23)]
    assert htmltext.extract(df.limit(0)).collect() == []


def test_mix_targets_and_rounding(spark, odd, empty):
    assert mixing.targets([("a", 100), ("b", 100), (None, 10)]) == {None: pytest.approx(26.25), "a": pytest.approx(131.25), "b": pytest.approx(52.5)}
    capped = mixing.targets([("a", 10), ("b", 100), ("c", 100)])
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(210)
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.randint(1, 60)), None, rng.choice(["a", "b", "c", None])) for i in range(600)] + odd[1]
    df = make(spark, rows)
    one, two = (sorted(map(tuple, mixing.mix(x, chunk_rows=50, fan=3).collect()), key=str) for x in (df, df.repartition(7)))
    assert one == two and len(one) == len(rows)
    taken, goal, longest = Counter(), {}, Counter()
    for _, source, size, _, target, copies, words in one:
        assert words == copies * size <= 3 * size
        taken[source] += words
        goal[source] = target
        longest[source] = max(longest[source], size)
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in goal)  # one document at most is rounded alone
    assert mixing.mix(empty).collect() == []


def test_rounding_keeps_words_and_means():
    z = np.array([50.0, 20, 20, 10, 5, 1])
    got = np.zeros(6)
    for seed in range(3000):
        p, held = mixing.pivotal(np.full(6, 0.3), z, np.random.default_rng(seed).random(12))
        assert p @ z == pytest.approx(0.3 * z.sum()) and all(x in (0, 1) for k, x in enumerate(p) if k != held)
        got += p
    assert got / 3000 == pytest.approx(np.full(6, 0.3), abs=0.04)


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        w = sentence(rng, 60).split()
        for _ in range(rng.randint(1, 6) if bad else 0):
            w[rng.randrange(60)] = rng.choice(["scummy", "moronic", "trashy"])
        rows.append((i, " ".join(w), None, None))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "clean words " * 4000 + "moronic", None, None)]
    lab = spark.createDataFrame([*labels, (None, None, None), (5000, 1, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(make(spark, rows), lab).collect()}
    assert all(out[i]["toxic"] == (i % 5 == 0) for i in range(300))
    assert not out[1000]["toxic"] and not out[1001]["toxic"] and out[1002]["toxic"]
    assert out[0]["severity"] > out[1]["severity"] and 0 <= out[0]["severity"] <= 3
    assert toxicity.toxicity(empty, lab).collect() == []
    assert not toxicity.toxicity(make(spark, rows[:1]), lab.limit(0)).first()["toxic"]


def test_fingerprints(spark, odd, empty):
    docs, rows = odd
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    texts = [r[1] or "" for r in order]
    want = []
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        k, nxt = len(t) // 4, texts[(i + 1) % len(texts)]
        new = t[: len(t) - k] + nxt[:k]
        a, b, c = (fingerprint.digest(np.frombuffer(x.encode(), np.uint8)) for x in (t, new, nxt))
        want.append((r[0], len(t), hashlib.sha256(new.encode()).hexdigest(), a.hex(), b.hex(), fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    got = [tuple(r) for r in fingerprint.with_neighbours(docs, rows_per_part=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert fingerprint.with_neighbours(empty).collect() == []
    large = (1 << 60) + 1  # beside a null id
    both = fingerprint.with_neighbours(make(spark, [(None, "a", None, None), (large, "b", None, None)])).collect()
    assert {r["doc_id"] for r in both} == {None, large}
    one = fingerprint.with_neighbours(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_quality(spark, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(250):
        good = i % 4 != 0
        t = sentence(rng, 50)
        rows.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), None, None))
        labels.append((i, int(good), 0))
    rows += [(900, None, None, None), (901, "", None, None), (902, sentence(rng, 9000), None, None)]
    lab = spark.createDataFrame([*labels, (None, 1, 0), (800, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality(make(spark, rows), lab).collect()}
    assert sum(out[i]["predicted"] == (i % 4 != 0) for i in range(250)) >= 245
    assert out[900]["score"] == out[901]["score"] and all(0 <= r["score"] <= 1 for r in out.values())
    assert quality.quality(empty, lab).collect() == []
    assert quality.quality(make(spark, rows[:1]), lab.limit(0)).first()["score"] == 0.5


def test_votes_of_ties_and_conflicting_labels(spark):
    rng = np.random.default_rng(3)
    held = rng.integers(-2, 3, (3000, 4)).astype(np.float32)  # many equal cosines
    held /= np.maximum(np.linalg.norm(held, axis=1, keepdims=True), 1e-9)
    m = quality.Model(None, None, held, rng.integers(0, 2, 3000).astype(np.float32))
    x = held[:50]
    for k in (1, 7, 40, 2500):
        got = quality.vote(x, m, k)
        for row, g in zip(x, got, strict=True):
            cos = np.rint((row @ held.T).astype(np.float64) * 1e5) / 1e5
            best = sorted(range(3000), key=lambda j: (-cos[j], j))[:k]
            w = [max(cos[j], 0) ** 4 + 1e-6 for j in best]
            assert g == pytest.approx(sum(a * m.labels[j] for a, j in zip(w, best)) / sum(w), abs=1e-9)
    lab = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, label int")
    assert [tuple(r) for r in features.agreed(lab, "label").collect()] == [(2, 1)]


def brute_viterbi(unit, v):
    """Path and score of one marked text: ties at a position go to the longer last piece."""
    table = {p: (i, s) for i, (p, s, n) in enumerate(zip(v.pieces, v.scores, v.normal, strict=True)) if n}
    best, last = [0.0] + [-math.inf] * len(unit), [0] * (len(unit) + 1)
    for end in range(1, len(unit) + 1):
        for n in range(1, min(v.longest, end) + 1):
            piece = unit[end - n : end]
            s = table[piece][1] if piece in table else v.fallback if n == 1 else -math.inf
            if s > -math.inf and best[end - n] + s >= best[end]:
                best[end], last[end] = best[end - n] + s, n
    ids, at = [], len(unit)
    while at:
        piece = unit[at - last[at] : at]
        coded = [table[piece][0]] if piece in table else [v.byte_ids[b] for b in piece.encode()]
        ids = (coded if min(coded) >= 0 else [v.unknown]) + ids
        at -= last[at]
    return ids, best[-1]


def marked(text):
    return pieces.MARK + text.replace(" ", pieces.MARK) if text else ""


ODD_TEXTS = ["two  spaces and\ttab\nline end ", "a \U0001f600 face", " lead", "   ", "x1y22zz3..a,b", "a\u2581b \u2581c", "tail  ", "\n\n \n", "e\u0301 \u200b\ufeff"]


@pytest.mark.parametrize("hot", [131072, 20, 0])
def test_sentencepiece(spark, odd, empty, hot):
    docs, rows = odd
    v = pieces.Vocabulary.load(PIECES)
    rows = rows + [(50 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)]
    out = pieces.encode(make(spark, rows), v, hot=hot, chunk_bytes=2000)
    got = out.collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t, _, _ in rows}
    for r in got:
        want, score = brute_viterbi(marked(text[r["doc_id"]]), v)
        assert r["ids"] == want and r["score"] == pytest.approx(score)
        back = text[r["doc_id"]].replace(pieces.MARK, " ")
        assert pieces.decode_ids(np.array(r["ids"]), v) == back and r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
        assert r["round_trip"] == (back == text[r["doc_id"]])
    assert {r["doc_id"]: r["text"] for r in pieces.decode(out, v).collect()} == {i: t.replace(pieces.MARK, " ") for i, t in text.items()}
    assert pieces.encode(empty, v).collect() == []


def test_sentencepiece_with_any_vocabulary(spark):
    """Pieces that cross marks and line feeds, no bytes: units follow the vocabulary, whatever it holds."""
    rng = random.Random(7)
    for names in (["a", "b", "ab", "\u2581a", "b\u2581a", "a\nb", "\u2581", "aba", "bab\n"], ["a", "aa", "aaa", "b", "\u2581\u2581", "\u2581a"]):
        v = pieces.Vocabulary(["<unk>", *names], [0.0, *(-float(rng.randint(1, 4)) for _ in names)], [False] + [True] * len(names), [-1] * 256)
        texts = ["".join(rng.choice("ab \nc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
        got = pieces.encode(make(spark, [(i, t, None, None) for i, t in enumerate(texts)]), v, hot=5, chunk_bytes=300).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r["ids"] == brute_viterbi(marked(texts[r["doc_id"]]), v)[0]


def test_sentencepiece_is_linear_in_unbroken_text(spark):
    v = pieces.Vocabulary.load(PIECES)
    rng = random.Random(8)
    text = "".join(rng.choice("aeinorst") for _ in range(200_000))
    assert max(map(len, pieces.units(text, v))) > 1000
    rows = [(1, text, None, None), (2, "x" * 50_000, None, None)]
    began = time.time()
    got = {r["doc_id"]: r for r in pieces.encode(make(spark, rows), v).collect()}
    assert time.time() - began < 60 and all(r["round_trip"] for r in got.values())
    assert got[2]["score"] == brute_viterbi(marked("x" * 50_000), v)[1]


def test_sentencepiece_agrees_with_the_library_on_words():
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1  # unigram rule over the same pieces
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    v = pieces.Vocabulary.load(PIECES)
    score = lambda ids: sum(v.scores[i] for i in ids)
    for word in ("hello", "internationalization", "the", "über"):
        assert brute_viterbi(pieces.MARK + word, v)[1] >= score(sp.encode(word)) - 1e-6


def test_keys_of_texts_equal_the_runs_between_spaces():
    def plain(text):
        marked = " " + text.replace(pieces.MARK, " ")
        return [run[1:] for run in re.findall(" +[^ ]*", marked)] if text else []

    v, rng = pieces.Vocabulary.load(PIECES), random.Random(5)
    for _ in range(500):
        texts = ["".join(rng.choice(f"  ab\n{pieces.MARK}é𝄞") for _ in range(rng.randint(0, 12))) for _ in range(5)]
        names, index, counts = v.keys(pa.array(texts, pa.string()))
        words = [w.replace(pieces.MARK, " ") for w in names.take(pa.array(index)).to_pylist()]
        assert words == [w for t in texts for w in plain(t)] and counts.tolist() == [len(plain(t)) for t in texts]
        assert all("".join(pieces.units(t, v)) == "".join(pieces.MARK + w for w in plain(t)).replace(" ", pieces.MARK) for t in texts)
