"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its word shingles' XXH64 values have it. Two fingerprints link at
``radius`` or fewer differing bits. A 64-bit fingerprint is cut into m segments; by the pigeonhole principle linked ones
differ by at most radius // m bits in some segment. Each fingerprint is stored in m tables under its segments, and looks
up, in each table, the small Hamming ball around its own segment; matches are verified over all 64 bits. Of two
fingerprints only the one with the smaller segment value looks up the other, so half of the ball is enough. m is chosen
by cost from the number of fingerprints; every m gives the same links.

Work stays linear where thousands of fingerprints share a segment value. A table entry list of more than ``hot`` is not
joined: all fingerprints in it or looking it up are set apart, and each of those emits the whole ball of radius
ceil(radius / 2) around itself. Two that share such a point are within radius of each other, up to a check of the
complete distance for odd radii, and two within radius share one; linking each to the point's smallest fingerprint
gives the same components without any pair being listed. (Only even radii take this way.)

Equal fingerprints are one node, so exact copies never meet. Components come from the shared-folder star algorithm.

Defined results for odd input: null and empty texts have fingerprint zero, linked like any other; a null id never
becomes a component's id unless all ids are null; equal rows give equal rows; an empty table gives an empty table;
only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_written, merged, text_of, written
from .components import components

RADIUS = 4
HOT = 1024
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    parts = text.lower().split()  # of bytes: A-Z alone are lowered, and 0x20, 0x09-0x0D alone separate
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=True)], ">u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fp = pa.array([fingerprint(t, words, seed) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), fp], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segments(m: int) -> list[tuple[int, int]]:
    """(shift, bits) of each of m segments of 64 bits."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` of ``bits`` bits, as signed 64-bit integers."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def choose_segments(n: int, radius: int) -> int:
    """The m with the least work for n fingerprints: look-ups, and entries they fetch by chance."""

    def cost(m: int) -> float:
        bits = 64 // m
        looks = m * sum(math.comb(bits, k) for k in range(radius // m + 1)) / 2
        return looks * (1 + n / 2**bits)

    return min(range(2, radius + 2), key=cost)


def links(nodes: DataFrame, n: int, radius: int = RADIUS, m: int | None = None, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``nodes`` (fp) that span all links' components."""
    m = m or choose_segments(n, radius)
    parts = _segments(m)
    value = lambda s, b: F.shiftrightunsigned("fp", s).bitwiseAND((1 << b) - 1)
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), value(s, b).alias("v")) for i, (s, b) in enumerate(parts)])).alias("e")
    table = nodes.select(F.col("fp").alias("b"), entry).select("b", "e.seg", "e.v")

    def ball(i: int, s: int, b: int) -> Column:
        own = value(s, b)
        upper = F.filter(F.array(*map(F.lit, _ball(b, radius // m))), lambda x: own.bitwiseXOR(x) >= own)
        return F.transform(upper, lambda x: F.struct(F.lit(i).alias("seg"), own.bitwiseXOR(x).alias("v"), (x != 0).alias("moved")))

    balls = F.concat(*[ball(i, s, b) for i, (s, b) in enumerate(parts)])
    looks = nodes.select(F.col("fp").alias("a"), F.explode(balls).alias("e")).select("a", "e.seg", "e.v", "e.moved")
    full = table.groupBy("seg", "v").agg(F.count("*").alias("n")).where(F.col("n") > hot).drop("n")
    some_hot = radius % 2 == 0 and not full.isEmpty()
    cold = looks.join(full, ["seg", "v"], "left_anti") if some_hot else looks
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    met = (F.col("l.seg") == F.col("t.seg")) & (F.col("l.v") == F.col("t.v")) & (F.col("moved") | (F.col("a") < F.col("b"))) & near
    edges = cold.alias("l").join(table.alias("t"), met).select("a", "b")
    if some_hot:
        apart = looks.join(full, ["seg", "v"], "left_semi").select(F.col("a").alias("fp")).union(
            table.join(full, ["seg", "v"], "left_semi").select(F.col("b").alias("fp"))
        ).distinct()
        points = apart.select("fp", F.explode(F.array(*map(F.lit, _ball(64, radius // 2)))).alias("x"))
        points = points.select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
        edges = edges.union(points.join(least, "point").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())
    return edges


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = RADIUS, m: int | None = None, hot: int = HOT, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of ``docs``; component_id: the smallest doc_id reachable by links.

    ``root`` names the component also where ids repeat, and two components have one smallest id.
    """
    prints = written(fingerprints(docs, words, seed), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.select("fp"), nodes.count(), radius, m, hot))
    rooted = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "classes")
    drop_written(nodes)
    return prints.join(of, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: the smallest by (doc_id, null last, then hash of the text).

    Equal rows are one document. Columns are passed through; the name ``_sh_hash`` is kept for this operator.
    """
    return first_of_each(docs, near_duplicates(docs, words, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their component in ``found`` (doc_id, text_hash, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    keep = written(first.select("first.doc_id", F.col("first.text_hash").alias("_sh_hash")), "kept")
    hashed = docs.withColumn("_sh_hash", F.xxhash64(text_of()))
    same = hashed["doc_id"].eqNullSafe(keep["doc_id"]) & (hashed["_sh_hash"] == keep["_sh_hash"])
    kept = merged(hashed, keep, same, "left_semi")
    twice = hashed.groupBy("doc_id", "_sh_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "_sh_hash"])
    return kept.drop("_sh_hash")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
