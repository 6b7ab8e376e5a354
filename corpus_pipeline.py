"""A training corpus from ``documents``: five stages, each on what the last one kept.

Toxic documents go, then exact copies, then near copies; personal data is replaced by
its kind; what is left is packed into windows. All stages but the last return the
columns of ``documents``. Stages take tables with null values, repeated rows, further
columns of any name and no rows at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, read
from graphloom.llm.components import FEW
from graphloom.llm.exact_dedup import group_texts
from graphloom.llm.minmax_dedup import near_duplicates
from graphloom.llm.packing import pack_documents
from graphloom.llm.pii import redact
from graphloom.llm.toxicity import fit_on, score

#: A document goes from this score on. Higher than where a label is predicted: here a
#: mistake loses a clean document.
TOXIC = 0.5
ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator uses, and those names."""
    names = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _without(docs: DataFrame, gone: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``docs`` that ``gone`` doesn't name; nulls equal nulls. Only a list of
    checked size is broadcast; a longer one is joined by shuffle."""
    gone = materialize(gone, "gone")
    few = F.broadcast(gone) if gone.count() <= FEW else gone
    same = [docs[a].eqNullSafe(gone[b]) for a, b in on]
    return docs.join(few, [c for c in same] if len(same) > 1 else same[0], "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the network rejects."""
    plain, c = _plain(docs)
    net = fit_on(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    kept = score(plain, net, c["doc_id"], c["text"]).filter(F.col("score") < TOXIC).drop("score", "predicted")
    return kept.toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    plain, c = _plain(docs)
    old = F.pmod(F.crc32(F.coalesce(F.col(c["doc_id"]).cast("string"), F.lit(""))), F.lit(2)) == 0
    found = materialize(group_texts(plain, old, c["doc_id"], c["text"]).withColumnRenamed(c["doc_id"], "id"), "exact")
    copy = ~F.col("id").eqNullSafe(F.col("keep_id"))
    digest = plain.withColumn("digest", F.sha2(F.coalesce(F.col(c["text"]).cast("string"), F.lit("")), 256))
    kept = _without(digest, found.filter(copy).select("id", "text_sha256"), [(c["doc_id"], "id"), ("digest", "text_sha256")])
    if not found.filter(~copy & ~F.col("kept")).isEmpty():  # rows that repeat id and text
        kept = kept.dropDuplicates([c["doc_id"], "digest"])
    return kept.drop("digest").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, 0.8) the document with the smallest id stays."""
    plain, c = _plain(docs)
    found = near_duplicates(plain, 5, 80, c["doc_id"], c["text"])
    gone = found.filter(~F.col("kept")).select(F.col(c["doc_id"]).alias("id")).distinct()
    return _without(plain, gone, [(c["doc_id"], "id")]).toDF(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows the text."""
    plain, c = _plain(docs)
    clean = redact(plain, c["text"])
    if "n_chars" in c:
        clean = clean.withColumn(c["n_chars"], F.length(c["text"]).cast(docs.schema["n_chars"].dataType))
    return clean.toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' tokens in windows of 1024."""
    import public_tokenizers

    pieces = pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("MinHash near-dedup", near_dedup), ("PII", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
