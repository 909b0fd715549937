"""Token files, spelling variants and token alignment against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catalume.llm import align, textops, tokenfiles, tokens, variants

BYTE, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, part int, at long, n_ids long, ids string, block long, word string, n long, g long"
BITS = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "　", "«", "é", "ß", "<|endoftext|>", "<", "▁", "'s", "12", "日本", "😀", "\x00", "\x1f", "\x85", ".", "word", "Ünï", "ﬁ", "<0x41>", "<unk>", "</s>"]


def make(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, "w", 5, 6) for i, t in rows], SCHEMA)


def strange(rng, n):
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(2)
    rows = [(i + 10, t) for i, t in enumerate(strange(rng, 60))]
    rows += [(1, None), (2, ""), (3, "one word"), (3, "one word"), (3, "another text of the same id"), (None, "no id"), (None, None), (4, "long " * 30000 + "x" * 20000)]
    return make(spark, rows), rows


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def test_units_give_what_whole_texts_give():
    rng = random.Random(1)
    special, plain = Tokenizer.from_file(BYTE), Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a, p, b = tokens.ByteBpe(BYTE), tokens.ByteBpe(BYTE, True, 50), tokens.PieceBpe(PIECE)
    for _ in range(4):
        texts = strange(rng, 400)
        data, ofs = textops.flat(pa.array(texts))
        ids, ends, _ = a.encode(data, ofs)
        assert [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == [special.encode(t, add_special_tokens=False).ids for t in texts]
        data, ofs = tokens.spaced(data, ofs)
        ids, ends, same = p.encode(data, ofs)
        assert same.all() and [ids[x:y].tolist() for x, y in zip(ends, ends[1:])] == [plain.encode(" " + t, add_special_tokens=False).ids if t else [] for t in texts]
        ids, ends, same = b.encode(data, ofs)
        for i, t in enumerate(texts):
            want = sp.encode(t)
            assert same[i] == (not t or b"".join(b.token_bytes[k] for k in want) == (" " + t).encode())
            assert not same[i] or ids[ends[i] : ends[i + 1]].tolist() == want


def test_token_files(spark, odd, tmp_path):
    docs, rows = odd
    path = str(tmp_path / "ids")
    tokenfiles.write(docs, path, BYTE, layout=tokenfiles.Layout(part_bytes=20_000, stripe_bytes=4096, group_rows=1000))
    got = [tuple(r) for r in tokenfiles.summary(spark, path).collect()]
    of = Tokenizer.from_file(BYTE)
    want = [of.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), len(w), digest(w)) for (i, _), w in zip(rows, want))
    laid = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in laid] == [sum(x[2] for x in laid[:k]) for k in range(len(laid))]
    assert [r[0] for r in laid] == sorted((r[0] for r in laid), key=lambda i: (i is not None, i))
    assert tokenfiles.files(spark, path).select("part").distinct().count() > 3
    back = {r["doc_id"]: r["ids"] for r in tokenfiles.read(spark, path).where("doc_id >= 10").collect()}
    assert back == {i: w for (i, _), w in zip(rows, want) if (i or 0) >= 10}
    again = str(tmp_path / "again")
    tokenfiles.write(docs.repartition(5), again, BYTE, layout=tokenfiles.Layout(part_bytes=20_000))
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in tokenfiles.summary(spark, again).collect())


def test_lookup_reads_by_document(spark, odd, tmp_path):
    docs, rows = odd
    path = str(tmp_path / "ids")
    tokenfiles.write(docs, path, BYTE, layout=tokenfiles.Layout(part_bytes=20_000))
    found = tokenfiles.lookup(spark, path, [11, 3])
    assert sorted(r["doc_id"] for r in found.collect()) == [3, 3, 3, 11]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(part), ", "").replace("IsNotNull(doc_id), ", "")
    jvm = spark._jvm
    name = next(f for f in tokenfiles.files(spark, path).inputFiles())
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    streams = [s.getKind().toString() for s in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()] if reader.getStripes().size() else []
    assert not streams or {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= set(streams)


def test_token_files_of_nothing(spark, empty, tmp_path):
    tokenfiles.write(empty, str(tmp_path / "none"), BYTE)
    assert tokenfiles.summary(spark, str(tmp_path / "none")).collect() == []


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, p, every=199):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= p.letters and k >= p.occurrences}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= p.times * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items())


@pytest.fixture(scope="module")
def typos(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 11))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 300]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 160])
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdeé") + w[i:], w[:i] + rng.choice("abcdeé") + w[i + 1 :]])] * rng.choice([1, 5, 6])
    words += ["chainchain"] * 160 + ["chainchait"] * 30 + ["chainchuit"] * 5  # forms that follow each other
    rng.shuffle(words)
    rows = [(k % 40, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[k::40])) for k in range(40)]
    rows += [(None, "nothing here, Nothing"), (1, None), (2, ""), (3, "12 34 ... __"), (5, "same words again"), (5, "same words again")]
    return make(spark, rows), rows


@pytest.mark.parametrize("share", [2000, 3])
def test_spelling_variants(typos, share):
    docs, rows = typos
    p = variants.Params(share=share, bucket=50)
    got = sorted((tuple(r) for r in variants.variants(docs, p).collect()), key=lambda r: r[0])
    assert got == brute_variants(rows, p)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_one_error_sets():
    rng = random.Random(8)
    for size in (1, 2, 5, 9):
        words = sorted({"".join(rng.choice("ab") for _ in range(size + rng.randint(0, 1))) for _ in range(150)})
        more = np.array([len(w) > size for w in words])
        points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        got = sorted((words[x], words[y]) for a, b in variants.one_error(points, more, size, block=7) for x, y in zip(a, b))
        assert got == sorted((a, b) for a in words if len(a) == size for b in words if one_apart(a, b) and len(b) >= size)


def test_variants_of_nothing(empty):
    assert variants.variants(empty).collect() == []


def brute_alignment(rows):
    a, b = tokens.ByteBpe(BYTE, True).token_bytes, tokens.PieceBpe(PIECE).token_bytes
    of_a = Tokenizer.from_file(BYTE)
    of_a.encode_special_tokens = True
    of_b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs, counts = [], Counter()
    for i, t in rows:
        x, y = (of_a.encode(" " + t, add_special_tokens=False).ids, of_b.encode(t)) if t else ([], [])
        if any(b"".join(s[k] for k in ids) != (" " + t).encode() for s, ids in ((a, x), (b, y)) if t):
            x, y = [], []
        ends = [np.cumsum([len(s[k]) for k in ids]).tolist() for s, ids in ((a, x), (b, y))]
        links = [(p, q) for p, e, w in zip(x, ends[0], (len(a[k]) for k in x)) for q, f, v in zip(y, ends[1], (len(b[k]) for k in y)) if max(e - w, f - v) < min(e, f)] if len(x) < 2000 else None
        if links is None:
            links, j = [], 0
            for p, e, w in zip(x, ends[0], (len(a[k]) for k in x)):
                while ends[1][j] <= e - w:
                    j += 1
                k = j
                while k < len(y) and ends[1][k] - len(b[y[k]]) < e:
                    links.append((p, y[k]))
                    k += 1
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [f"{','.join(str(k) for k, e in zip(x, ends[0]) if lo < e <= hi)}|{','.join(str(k) for k, e in zip(y, ends[1]) if lo < e <= hi)}" for lo, hi in zip([0, *cuts], cuts)] if len(x) < 2000 else None
        counts.update(links)
        docs.append((i, len(x), len(y), len(cuts), links, groups))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    return [(i, n_a, n_b, n_g, len(ls), sum(counts[k] == best[k[1]] for k in ls), sum(counts[k] for k in ls), "" if not n_g else hashlib.sha256(";".join(g).encode()).hexdigest() if g is not None else None) for i, n_a, n_b, n_g, ls, g in docs]


@pytest.mark.parametrize("step,block", [(4 << 20, 16 << 20), (200, 1000)])
def test_alignment(odd, step, block):
    docs, rows = odd
    got = sorted((tuple(r) for r in align.align(docs, BYTE, PIECE, step, block).collect()), key=str)
    want = sorted(brute_alignment(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: str(r[:7])), sorted(want, key=lambda r: str(r[:7]))):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])
    assert any(g[1] == 0 for g in got) and any(g[4] > g[3] for g in got)


def test_alignment_of_nothing(empty):
    assert align.align(empty, BYTE, PIECE).collect() == []
