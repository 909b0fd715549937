"""A training-data pipeline over ``documents``: five stages, each one operator of ``catalume.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.llm import langid, minhash, mixing, pieces, suffixdedup
from catalume.llm.queries import PIECES
from catalume.llm.session import durable, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language the classifier can't tell: no letters, or a score below one half.

    Null and empty texts have no letters and go; repeated rows are judged alike; a long text is judged as a whole;
    extra columns stay.
    """
    model = langid.train(docs.where(langid.fold("doc_id", 4) != 2))
    return langid.accept(docs, model, least=0.5)


def _row_key(*names: str) -> Column:
    """A hash of the columns that tells nulls in different places apart."""
    return F.xxhash64(*[x for c in names for x in (F.col(c).isNull(), F.col(c))])


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in upper or lower case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (five words, 0.8): that of the smallest doc_id, nulls last.

    Rows are told apart by a hash of id and text, so copies that share a doc_id or have none
    are copies like others, and different texts under one doc_id stand each for itself. Of
    rows that agree in both, the one with the smallest other columns stays.
    """
    key = _free(docs, "_key")
    keyed = docs.withColumn(key, _row_key("doc_id", "text"))
    found = minhash.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), minhash.Params(width=5, percent=80)).where("n_shingles > 0")
    found = durable(found.groupBy(F.col("doc_id").alias(key), "component_id").agg(F.count("*").alias("n")))
    groups = found.groupBy("component_id").agg(F.count("*").alias("k")).where("k > 1").select("component_id")
    rivals = found.join(groups, "component_id").select(key, "component_id")
    first = keyed.select(key, "doc_id").join(rivals, key).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key"))).alias("first"))
    gone = rivals.join(first.select(F.col("first.key").alias(key)), key, "left_anti").select(key)
    left = keyed.join(gone, key, "left_anti")
    again = found.where("n > 1").select(key)
    if again.isEmpty():
        return left.select(*docs.columns)
    one = left.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return left.join(again, key, "left_anti").select(*docs.columns).union(one)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte covered by a 200-byte string that also starts elsewhere; every document stays.

    Null texts stay null; rows repeated in full lose all their bytes, as each repeats the other; texts of any
    length are cut as a whole; extra columns stay.
    """
    cut = suffixdedup.without_repeats(docs, suffixdedup.Params(length=200))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source takes its share of words.

    Rows are told apart by a hash of all columns; copies of rows that agree in all of them are added up.
    """
    key, copies_of, n = (_free(docs, x) for x in ("_key", "_copies", "_n"))
    keyed = docs.withColumn(key, _row_key(*docs.columns))
    mixed = mixing.mix(keyed, key=key).groupBy(F.col("row_key").alias(key))
    copies = durable(mixed.agg(F.sum("copies").cast("int").alias(copies_of), F.count("*").alias(n)).where(F.col(copies_of) > 0))
    if not copies.where(F.col(n) > 1).isEmpty():
        keyed = keyed.dropDuplicates([key])
    return keyed.join(copies, key).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies_of)))).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; the round trip through the decoder is checked row by row.

    Null and empty texts have no ids; repeated rows give repeated rows; whole texts of any length are encoded; extra
    columns go.
    """
    out = pieces.encode(docs, pieces.Vocabulary.load(PIECES))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "decoded_sha256", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("source_mixing", source_mix),
    ("sentencepiece", encoded),
]

#: SQL can't express the trained, random and lattice stages; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
