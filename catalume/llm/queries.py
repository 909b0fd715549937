"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, fingerprint, htmltext, langid, minhash, mixing, pieces, quality, sql, suffixdedup, tokenfiles, topk, toxicity, variants
from .session import shared_dir, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), suffixdedup.Params(length=200))


#: Public vocabulary file; its path is a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(PIECES))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "score", "decoded_sha256", "round_trip")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Params(width=4, percent=80))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_neighbours(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.summary(spark, path)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_bpe, piece_bpe = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.align(table(spark, sf_dir, "documents"), byte_bpe, piece_bpe)


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_sentencepiece,
        op3_exact_top_k,
        op4_language_id,
        op5_html_extraction,
        op6_minhash_near_dedup,
        op7_source_mixing,
        op8_toxicity,
        op9_fingerprints,
        op10_quality,
        op11_token_files,
        op12_spelling_variants,
        op13_token_alignment,
    )
}
ORACLES = {"op3_exact_top_k": sql.TOP_K, "op6_minhash_near_dedup": sql.NEAR_DUPLICATES, "op12_spelling_variants": sql.SPELLING_VARIANTS}
