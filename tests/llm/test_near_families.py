"""Near-duplicate families larger than a list or a block, and words that are made to collide."""

import random

import numpy as np
import pyarrow as pa

from catalume.llm import minhash, textops
from catalume.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def shingles(text, width):
    w = text.split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or frozenset([tuple(w)])


def brute(rows, width, percent):
    sets, label = [shingles(t, width) for _, t in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {(d, least[find(i)]) for i, (d, _) in enumerate(rows)}


def family(rng, n, size=60):
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(size)]
    out = []
    for k in range(n):
        w = list(base)
        w[rng.choice([2, 20, size - 3])] = f"edit{k}"
        out.append(" ".join(w))
    return out


def chain(rng, n, size=80):
    """Each text is near the next one only."""
    words = [f"w{k}" for k in range(size + 6 * n)]
    return [" ".join(words[6 * k : 6 * k + size]) for k in range(n)]


def test_families_beyond_lists_and_blocks_equal_brute_force(spark):
    rng = random.Random(7)
    texts = family(rng, 150) + family(rng, 60, 40) + chain(rng, 50) + [f"single {k} of its own kind here" for k in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    rows += [(3, "another text under a known id entirely"), (3, texts[3])]  # one id with two texts, and a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 80)
    for p in (minhash.Params(width=4), minhash.Params(width=4, list_rows=20, block_rows=25, shared=4), minhash.Params(width=4, list_rows=20, block_bytes=4000, shared=1)):
        got = minhash.near_duplicates(df, p).collect()
        assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_posted_rows_stay_as_many_as_coordinates(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 5000, 100)))
    p, seen = minhash.Params(width=4, list_rows=500), []
    keep = minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: seen.append((tuple(df.columns), (out := keep(df)).count())) or out)
    sets = minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), p)
    sets = keep(sets.select(sets["doc_id"].alias("a"), sets["n_shingles"].alias("size"), "sig"))
    found = minhash.candidates(sets, p)
    posted = [n for columns, n in seen if "key" in columns and "component" not in columns]
    assert posted and max(posted) <= 11 * len(rows)
    assert found.count() <= 4 * 11 * len(rows)
    assert components(found).select("component").distinct().count() == 1


def thue_morse(bits):
    w = "a"
    for _ in range(bits):
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_words_of_a_regular_pattern_stay_apart(spark):
    a = thue_morse(11)
    b = a.translate(str.maketrans("ab", "ba"))
    data, ofs = textops.flat(pa.array([a, b, "x", "xy", "yx", a[:-1], "ab " * 3]))
    start, end, _ = textops.words(data, ofs)
    h = textops.word_hash(data, start, end)
    assert len(set(h[:6].tolist())) == 6 and len(set(h[6:].tolist())) == 1
    old = textops.range_hash(textops.prefix_hash(data), start, end)
    assert old[0] == old[1]
    got = minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), minhash.Params(width=4)).collect()
    assert all(r["kept"] for r in got)


def test_word_hash_depends_on_the_word_alone():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 100, rng.integers(1, 20)))) for _ in range(3000)]
    data, ofs = textops.flat(pa.array([" ".join(words)]))
    start, end, _ = textops.words(data, ofs)
    of = {}
    for w, h in zip(words, textops.word_hash(data, start, end).tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)
