"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

quality   documents that the quality rules reject go
lines     later repeats of maximal line runs are deleted from the texts; a document that loses all its words goes
copies    of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more) one document stays
mixture   documents are drawn to raked source, language and topic weights: as many as let all of them be met
pieces    texts become SentencePiece ids, with the costs of the best segmentations, what these edit, and the hash of the
          text that the ids decode to

The first four return the columns of ``documents``. Null texts count as empty and fail the quality rules; equal rows are
one document to the third stage; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodos.llm.common import WORD, written
from lodos.llm.line_dedup import line_dedup
from lodos.llm.mixing import mixed
from lodos.llm.near_copies import one_of_each
from lodos.llm.pieces import encode
from lodos.llm.quality import kept_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The share of tokens that the mixture draws, in expectation; None: as many as let every target be met.
BUDGET = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup(docs, extend=True).where((F.col("n_deleted") == 0) | F.rlike("text", F.lit(WORD)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, budget=BUDGET).where("drawn").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = encode(docs, check=True)
    costs = F.transform("segmentations", lambda s: s["cost"])
    edits = F.transform("segmentations", lambda s: s["edits"])
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), costs.alias("costs"), edits.alias("edits"), "text_sha256")


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("mixture", mixture), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents`` in order; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
