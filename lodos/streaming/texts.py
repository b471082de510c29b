"""Row-wise operators over a stream, and windowed counts of it: the batch operators' own columns on streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import style as Y


def token_counts(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n): the tokens of each text of a stream, stateless; 0 for null."""
    return stream.select(key, F.coalesce(F.size(T.words(text)), F.lit(0)).cast("long").alias("n"))


def style_audits(stream: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The style audit of each text of a stream, without parses: stateless."""
    return Y.audit(stream, None, key, text)


def windowed_tokens(stream: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour", text: str = "text") -> DataFrame:
    """(start, token_type, n): tokens by type in windows of event time; rows later than the watermark are left out by Spark."""
    rows = stream.withWatermark(time, late).select(time, F.explode(F.transform(T.words(text), lambda t: T.kind(t))).alias("token_type"))
    counts = rows.groupBy(F.window(time, width).alias("w"), "token_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), "token_type", "n")
