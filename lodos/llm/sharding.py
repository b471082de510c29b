"""Sharding by proportional stratified interleaving. Native DataFrame code.

Rows of each stratum (source) are shuffled by a seeded hash and ranked. The fractional rank (rank - 1/2) / rows spreads
each stratum evenly over [0, 1). Sorted by it, any run of rows has the mixture of the whole; cutting the order into
runs gives shards that match it, with row counts at most one apart.

No rank needs a whole stratum in one task: the hash's leading bits (then the fractional rank) deal rows into small
even ranges, ranges are counted, running sums of the counts are added to the rank within the range.

Defined results for odd input: null strata form a stratum of their own; a null id or text is ranked like any other
(null text: no bytes); equal rows are told apart by nothing and take neighbouring slots; an empty table gives an empty
table; of other columns none is read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, text_of

#: Rows in a range, about.
RANGE_ROWS = 20_000


def _ranked(rows: DataFrame, keys: list[str], at: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the rank from 1 by (``at``, ``order``) within ``keys``; ``at`` numbers ranges of the order."""
    sizes = rows.groupBy(*keys, at).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    if keys:
        sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    within = Window.partitionBy(*keys, at).orderBy(*order)
    out = rows.withColumn("_rank", F.row_number().over(within)).join(sizes.drop("_n"), [*keys, at])
    return out.withColumn(name, F.col("_before") + F.col("_rank")).drop("_rank", "_before")


def interleave(rows: DataFrame, stratum: str, tie: list[str], n_shards: int, seed: int = 42) -> DataFrame:
    """``rows`` with shard, slot (in the shard, from 0), position (in all), for ``rows`` that have no column named _*.

    The seeded shuffle sorts by MD5 of the seed and the columns of ``tie``, then by these.
    """
    n = rows.count()
    ranges = max(1, math.ceil(n / RANGE_ROWS))
    mixed = rows.withColumn("_stratum", F.coalesce(F.concat(F.lit("s"), F.col(stratum)), F.lit("n"))).withColumn(
        "_key", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie]))
    )
    lead = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    dealt = mixed.withColumn("_range", F.floor(lead * ranges / F.lit(1 << 32)).cast("long"))
    ranked = _ranked(dealt, ["_stratum"], "_range", ["_key", *tie], "_place").drop("_range")
    part = (F.col("_place") - F.lit(0.5)) / F.col("_all")
    cut = ranked.withColumn("_part", part).withColumn("_range", F.floor(part * ranges).cast("long")).drop("_all", "_place")
    placed = _ranked(cut, [], "_range", ["_part", "_stratum", "_key", *tie], "_place")
    position = F.col("_place") - 1
    shard = F.floor(position * n_shards / F.lit(max(n, 1))).cast("int")
    first = F.ceil(F.col("shard") * F.lit(n) / n_shards).cast("long")
    out = placed.withColumn("position", position).withColumn("shard", shard).withColumn("slot", F.col("position") - first)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def write_shards(sharded: DataFrame, path: str, n_shards: int) -> None:
    """Writes one folder for each shard, in slot order, from range partitions: no task holds more than its share."""
    sharded.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 39 under the law `rows`."""
    docs = documents(spark, sf_dir)
    text = text_of()
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = interleave(rows, "source", ["doc_id", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql() -> str:
    """The same shards from DuckDB, which ranks by plain windows; CRC-32 by its table, byte by byte."""
    return """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, x)) AS t),
texts AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, (strlen(text) + 16)::BIGINT AS size, xor(4294967295, list_reduce(list_transform(range(strlen(text)), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
             lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT))::BIGINT AS text_crc32
  FROM texts, crc_table),
rows_in AS (SELECT *, md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || text_crc32) AS k FROM sized),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS part
  FROM rows_in),
placed AS (SELECT *, row_number() OVER (ORDER BY part, stratum, k, doc_id, text_crc32) - 1 AS position, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (position * 40 // n)::INT AS shard,
       (position - ((position * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard
FROM placed
"""
