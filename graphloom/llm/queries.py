"""Thin queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and text."""
    import public_tokenizers

    from graphloom.llm.piece_codec import digest_column

    return digest_column(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards by its key alone."""
    from graphloom.llm.sharding import assign_shards

    placed = assign_shards(read(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows of 1024; a checksum of each piece's ids."""
    import public_tokenizers

    from graphloom.llm.packing import pack_documents

    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_binary_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; half of the keys stand for the snapshot that the
    other half comes in against."""
    from graphloom.llm.exact_dedup import group_texts

    return group_texts(read(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0)


def op7_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, three-word shingles, 0.85."""
    from graphloom.llm.minmax_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a network fit on labels that aren't held out."""
    from graphloom.llm.toxicity import fit_on, held_out, score

    docs = read(spark, sf_dir, "documents")
    net = fit_on(docs, read(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    from graphloom.llm.pii import find_pii, of_kind, span_text

    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    from graphloom.llm.nn_descent import nearest

    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    from graphloom.llm.warc import as_responses, derive

    return derive(as_responses(read(spark, sf_dir, "pages")))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents. The table has no paths: ten ids make a directory and
    ten directories a larger one; the first id of either is its licence file."""
    from graphloom.llm.licences import scan

    docs, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    upper, lower = F.floor(i / 100).cast("string"), F.floor(i / 10).cast("string")
    name = (
        F.when(i % 100 == 0, F.concat_ws("/", F.lit("corpus"), upper, F.lit("LICENSE")))
        .when(i % 10 == 0, F.concat_ws("/", F.lit("corpus"), upper, lower, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", F.lit("corpus"), upper, lower, F.concat(F.lit("doc"), i.cast("string"))))
    )
    return scan(docs.select("doc_id", "text", name.alias("path")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first eight components, each of unit variance. A deviation
    that a long can't hold is null."""
    from graphloom.llm.whitening import whiten

    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words' number, form and root."""
    from graphloom.llm.spelling import group_variants

    return group_variants(read(spark, sf_dir, "documents"))


def op11_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 400 bytes that start elsewhere too."""
    from graphloom.llm.suffix_dedup import repeat_digests

    return repeat_digests(read(spark, sf_dir, "documents"))
