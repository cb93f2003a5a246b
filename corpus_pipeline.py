"""The corpus pipeline: documents pass the stages in order, each written as Parquet and read again.

language ID        documents in no learned language go
line dedup         texts lose the lines that an earlier document holds; n_chars follows the text
near copies        of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays
decontamination    documents that hold a benchmark item go
sentence pieces    texts become ids, which are decoded again and compared

Every stage works on all that the one before it kept.  The first four return the columns
of documents and leave others aside, the last one a row of counts and digests per
document.  All take empty tables, and texts of any length whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixweave.llm import language_id, line_dedup, near_copies, sentence_pieces, string_tiling
from matrixweave.llm.common import new_path

#: The columns of documents.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (7): the model is fitted on the labelled rows of ``docs``.

    Rows whose text is null, empty or without a letter go, and rows whose phrases are too
    short for every learned language.  Repeated rows and null doc_ids are judged alike.
    """
    return language_id.keep_known(docs, language_id.fit(docs)).select(*COLUMNS)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (4): no row goes.

    Null texts stay null; n_chars is that of the new text where a line was dropped and
    stays, null or not, elsewhere.  Rows that repeat a doc_id are one document; a null
    doc_id neither loses lines nor makes others lose them.
    """
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    kept = line_dedup.dedup_lines(docs).withColumn("_text", text)
    return kept.select("doc_id", F.col("_text").alias("text"), "lang", "source", F.when(F.col("_n_dropped") > 0, F.char_length("_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (10): the rows of the smallest doc_id of each group stay.

    Links are those of operator 10, by multi-index hashing of 64-bit fingerprints, that an exact
    check of shingles confirms, and those that its two bits miss, found by minima of hashes.
    Texts without a word, null ones included, are copies of each other.  Rows that repeat
    a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    return near_copies.keep_one(docs).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (1): each row is judged by itself; null and empty texts stay."""
    return string_tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (2): a row each, repeated or without doc_id too; null texts are empty."""
    import public_tokenizers

    return sentence_pieces.round_trip(docs, public_tokenizers.path(sentence_pieces.MODEL))


STAGES = [
    ("language ID", known_languages),
    ("line dedup", first_lines),
    ("near copies", single_copies),
    ("decontamination", clean_of_benchmark),
    ("sentence pieces", pieces),
]

#: SQL expresses neither the language model nor the linking of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
