"""The corpus pipeline stage by stage against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from catalume.llm import mixing, pieces
from catalume.llm.queries import PIECES
from test_operators import brute_components, brute_removed, sentence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    shared = sentence(rng, 60)
    rows = []
    for i in range(80):
        text = sentence(rng, rng.randint(20, 80))
        if i % 9 == 0:
            text = text + " " + shared + " " + sentence(rng, 30)
        rows.append((i, text, "en" if i % 2 else "xx", f"s{i % 3}"))
    rows = [(i, t if l == "en" else t.replace("a", "ø").replace("e", "ж"), l, s) for i, t, l, s in rows]
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "s0") for i in range(10)] + [(300 + i, rows[5][1], "en", None) for i in range(5)]
    rows += [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, "123 456", "en", "s1")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def test_stages(spark, corpus, tmp_path):
    folder, rows = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text = {i: t for i, t, _, _ in rows}
    known = {r["doc_id"] for r in seen["language_id"]}
    assert known == {i for i, t in text.items() if t and any(c.isalpha() for c in t)}
    label = brute_components([(i, text[i]) for i in sorted(known)], 5)
    kept = {r["doc_id"]: r["text"] for r in seen["minhash_near_dedup"]}
    assert set(kept) == {i for i, (_, c) in label.items() if i == c} and all(kept[i] == text[i] for i in kept)
    ids = sorted(kept)
    want = dict(zip(ids, brute_removed([kept[i].encode() for i in ids], 200), strict=True))
    cut = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    assert set(cut) == set(ids) and any(w[1] for w in want.values())
    for i in ids:
        n, removed, _, _ = want[i]
        assert n - removed - 8 <= len(cut[i]["text"].encode()) <= n - removed and cut[i]["n_chars"] == len(cut[i]["text"])
    copies = Counter(r["doc_id"] for r in seen["source_mixing"])
    planned = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "suffix_array_dedup"))).collect()}
    assert copies == Counter({i: k for i, k in planned.items() if k}) and max(copies.values()) <= 3
    v = pieces.Vocabulary.load(PIECES)
    assert Counter(r["doc_id"] for r in seen["sentencepiece"]) == copies
    assert all(pieces.decode_ids(np.array(r["ids"]), v) == cut[r["doc_id"]]["text"] and r["round_trip"] for r in seen["sentencepiece"])


def test_stages_take_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.collect() == []
        docs = spark.createDataFrame([], docs.schema)


def test_stages_keep_extra_columns_of_any_name(spark, corpus):
    rng = random.Random(14)
    folder, _ = corpus
    clash = ("_key", "_copy", "_copies", "_n", "_found", "n", "copies", "key", "found", "row_key", "component_id")
    rows = [(i, sentence(rng, 50 + 3000 * (i == 4)), "en", f"s{i % 2}", 9, *(f"{c}{i}" for c in clash)) for i in range(30)]
    rows += [(90, rows[0][1], *rows[0][2:])]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in clash))
    given = {r["doc_id"]: tuple(r[c] for c in clash) for r in docs.collect()}
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.repeat_removal, corpus_pipeline.source_mix):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        kept = got.collect()
        assert kept and all(tuple(r[c] for c in clash) == given[r["doc_id"]] for r in kept)


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark, corpus):
    rng = random.Random(12)
    folder, _ = corpus
    a, b, c, d, e = (sentence(rng, 60) for _ in range(5))
    rows = [(1, a, "s1"), (1, a, "s1"), (1, a, "s0"), (None, b, "s0"), (None, b, "s0"), (None, b + " end", "s0"), (2, c, "s0"), (3, c + " end", "s0"), (3, d, "s0"), (None, e, "s0"), (9, e, "s0"), (None, None, "s0"), (None, None, "s0"), (9, "", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    got = [(r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
    one_b = [r for r in got if r[1] in (b, b + " end")]
    assert len(one_b) == 1 and one_b[0][0] is None
    assert Counter(r for r in got if r not in one_b) == Counter([(1, a, "s0"), (2, c, "s0"), (3, d, "s0"), (9, e, "s0"), (None, None, "s0"), (None, None, "s0"), (9, "", "s0")])
    cut = corpus_pipeline.repeat_removal(spark, docs.where("text is not null").transform(lambda x: corpus_pipeline.near_dedup(spark, x, folder)), folder).collect()
    assert Counter(r["text"] for r in cut) == Counter([a, one_b[0][1], c, d, e, ""])


def test_source_mix_keeps_null_and_reused_ids(spark, corpus):
    rng = random.Random(13)
    folder, _ = corpus
    rows = [(None if i % 3 == 0 else i % 20, sentence(rng, rng.randint(1, 40)), f"s{i % 3 if i % 5 else 1}") for i in range(90)]
    rows += [(7, "the same row", "s0")] * 4 + [(None, None, "s1"), (None, "", None)]
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    rows += [(50, "only nulls differ", "s0", None, 17), (50, "only nulls differ", None, "s0", 17)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got, again = (Counter(map(tuple, corpus_pipeline.source_mix(spark, x, folder).collect())) for x in (docs, docs.repartition(5)))
    given = Counter(map(tuple, docs.collect()))
    assert got == again and set(got) <= set(given) and all(got[r] <= 3 * given[r] for r in got)
    planned = mixing.mix(docs).collect()
    tally = lambda rs: Counter({k: n for k, n in rs.items() if n})
    want, have = Counter(), Counter()
    for r in planned:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    for (i, t, _, s, _), n in got.items():
        have[i, s, len((t or "").split())] += n
    assert tally(want) == have and any(i is None for i, _, _ in have)
