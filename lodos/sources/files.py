"""Whole text files as documents; results as JSON lines and as CoNLL-U text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, path): a row for each file below ``path``, a hash of whose path is its id; an empty file has an empty text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "text", "path")


def in_memory(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """(doc_id, text): the given texts, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, a field for each column; null fields are written."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_conllu(sentences: DataFrame, path: str, key: str = "doc_id") -> None:
    """CoNLL-U text from (row, key, sentence, conllu): sentences in order within a document, an empty line behind each."""
    ordered = sentences.repartition("row", key).sortWithinPartitions("row", "sentence")
    named = F.concat(F.lit("# sent_id = "), F.coalesce(F.col(key).cast("string"), F.lit("_")), F.lit("-"), F.col("sentence").cast("string"))
    ordered.select(F.concat(named, F.lit("\n"), "conllu", F.lit("\n")).alias("value")).write.text(path)
