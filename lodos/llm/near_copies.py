"""Near copies by exact Jaccard similarity of word shingles; candidates from SimHash by multi-index hashing.

A text's shingles are those of its fingerprint in ``simhash``, as a set of 64-bit hashes. Texts of equal sets are one node.
A node's fingerprint has ``BITS`` bits, each set where over half of the set's hashes, mixed anew for each 64 bits, have it:
at a similarity of 0.8 two differ in about 15 % of them, and with 64 bits a radius wide enough for that has no small balls
in any segment. The fingerprint is cut into segments; each node is stored in a table under each of them and looks up the
Hamming ball of radius 1 around its own, in the tables' smaller half as in ``simhash``. A linked pair differs by two or more
bits in every segment once in 2,700 at a similarity of 0.8, and less often above it. What meets is verified over ``SIGHT``
bits in the join, then over all bits (``RADIUS``), and links if the exact similarity of the sets reaches ``LEAST``, in
integers, so that no pair below it links. The width of the segments is chosen by cost from the number of nodes.

A list that more look-ups than ``hot`` and the double of what chance brings meet is hot, and its pairs are never listed: in
groups of edited copies nearly all meet. A crowd is set apart: the nodes stored in ``FEW`` hot lists or more, and of the others
those that in any hot list meet one that they may link to, whether they look it up or are looked up. What is left meets nobody
in hot lists, so its pairs, with each other and the crowd, are those of the other lists, as many as these allow; they are joined
plainly. The crowd is compared in two steps, each within tasks, of which no more than a forest of what they find leaves them:

* Nodes that share a list and are near by all bits are of one family. A crowd of up to ``CROWD`` has lists of its own for that,
  under shorter segments that are looked up as they are: 52 rows to a node, not 240, and a pair at 0.8 is missed once in 11,000,
  by the same reckoning as above. Families are the components of what is near, so they may hold nodes that don't link.
* The nodes of a family are compared with each other by their sets, whether they have met or not, a family of more than
  ``LOAD`` hashes in parts, each with each. A node is compared with those that are not linked to it already, so the time grows
  with the square of a family's unlinked members, the rows in proportion to its members (and the parts).

Entries and look-ups are many to a node, and Spark sizes them as their nodes, so no table here is left to a broadcast.

Defined results for odd input: null and empty texts have no shingles and are one node; a text shorter than a shingle is a
shingle; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, give_back, merged, parts, text_of, written
from .components import components
from .simhash import _ball, first_of_each

LEAST = (4, 5)
#: Bits of a fingerprint, as 64-bit words.
WORDS = 9
BITS = 64 * WORDS
#: Width and number of the segments that may be chosen.
SEGMENTS = [(16, 24), (18, 32)]
#: Width and number of the segments by which nodes of a crowd of up to CROWD meet, where they are equal.
EQUAL, CROWD = (11, 52), 500_000
#: Most differing bits of a link: of all (at a similarity of 0.8 they are 87, give or take 9), of all where two sets have
#: fewer than SHORT shingles together and ties of bits are common, and of the 96 that the tables hold, half of a name among them.
RADIUS, WIDE, SHORT = 128, 160, 32
SIGHT = 30
HOT = 8
#: Hot lists that a node of a crowd is stored in, at least.
FEW = 3
#: Hashes of the sets that a task compares with each other or, of a larger family, with as many others.
LOAD = 1 << 21
#: Entries of a crowd's lists that a task has, about; the more of its lists are together, the fewer edges they have that others spare.
ENTRIES = 1 << 16
#: Nodes whose trees a task keeps in mind.
MOST = 1 << 20
#: Nodes that are compared all at once.
SMALL = 48

_SHIFTS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, in order."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles, as WORDS signed 64-bit integers."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 255):  # as many as a byte counts
        z = found[i : i + 255, None] + _SHIFTS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        count += np.unpackbits(z.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * count > len(found)).view(np.int64)


def name_of(found: np.ndarray, bits: np.ndarray) -> int:
    """A node's name: 32 bits of its fingerprint, and 32 of the hash of its set."""
    return (int(bits[-1]) >> 32 << 32) | xxhash.xxh64_intdigest(found.tobytes()) >> 32


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp, n, bits) of every row; fp: the name of its set of shingles, n: the set's size, bits: its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingles(t, words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            bits = [fingerprint(s) for s in sets]
            fp = pa.array([name_of(s, b) for s, b in zip(sets, bits, strict=True)], pa.int64())
            cols = [batch.column("doc_id"), batch.column("text_hash"), fp, pa.array(map(len, sets), pa.int64()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "fp", "n", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, n long, bits array<long>")


def choose_segments(n: int) -> tuple[int, int]:
    """The segments with the least work for n nodes: rows that are moved, and pairs that meet by chance, 60 to a row."""

    def cost(of: tuple[int, int]) -> float:
        width, m = of
        looks = m * (width + 2) / 2
        return m + looks * (1 + n / 2**width / 60)

    return min(SEGMENTS, key=cost)


def _segment(i: int, width: int) -> Column:
    """The i-th segment's value, across words."""
    word, at = divmod(i * width, 64)
    value = F.shiftrightunsigned(F.col("bits")[word], at)
    if at + width > 64:
        value = value.bitwiseOR(F.shiftleft(F.col("bits")[word + 1], 64 - at))
    return value.bitwiseAND((1 << width) - 1).cast("int")


def _seen(a: str, b: str) -> Column:
    """Whether two nodes that meet may link, by the bits that the tables hold."""
    name = F.shiftrightunsigned(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp")), 32)
    return F.bit_count(name) + F.bit_count(F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig"))) <= SIGHT


def tables(nodes: DataFrame, width: int, m: int, more: tuple[str, ...] = (), radius: int = 1) -> tuple[DataFrame, DataFrame]:
    """The stored entries and the look-ups of ``nodes`` (fp, bits): (key, fp, sig), key: segment and its value; ``more``: columns to keep.
    With a radius of 0 a node looks up its own entries."""
    entry = F.explode(F.array(*[F.struct(F.lit(i << width).alias("seg"), _segment(i, width).alias("v")) for i in range(m)])).alias("e")
    own = nodes.select("fp", F.col("bits")[WORDS - 2].alias("sig"), *more, entry).select("fp", "sig", *more, "e.seg", "e.v")
    stored = own.select((F.col("seg") + F.col("v")).alias("key"), "fp", "sig", *more)
    if not radius:
        return stored, stored
    ball = F.explode(F.array(*[F.lit(x).cast("int") for x in _ball(width, radius)])).alias("x")
    looks = own.select("*", ball).where(F.col("v").bitwiseXOR(F.col("x")) >= F.col("v"))
    return stored, looks.select((F.col("seg") + F.col("v").bitwiseXOR(F.col("x"))).alias("key"), "fp", "sig", *more)


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b) of the two sides l and t of a join."""
    least, most = F.least("l.fp", "t.fp"), F.greatest("l.fp", "t.fp")
    return met.where("l.fp != t.fp").select(least.alias("a"), most.alias("b")).distinct()


def full_lists(stored: DataFrame, width: int, limit: int) -> DataFrame:
    """(key, n) of the lists that more than ``limit`` look-ups meet, those from keys of a few nodes not counted; n: how many."""
    own = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit // (width + 1))
    ball = F.explode(F.array(*[F.lit(x).cast("int") for x in _ball(width, 1)])).alias("x")
    met = own.select("n", "key", ball).where(F.col("key").bitwiseXOR(F.col("x")) >= F.col("key"))
    return met.groupBy(F.col("key").bitwiseXOR(F.col("x")).alias("key")).agg(F.sum("n").alias("n")).where(F.col("n") > limit)


def _near(a: str, b: str) -> Column:
    """Whether two nodes may link, by their sizes and all bits of their fingerprints."""
    apart = reduce(add, [F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(WORDS)])
    k, of = LEAST
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (of * na >= k * nb) & (of * nb >= k * na) & (apart <= F.when(na + nb < SHORT, WIDE).otherwise(RADIUS))


def _crowd(nodes: DataFrame, full: DataFrame, width: int, m: int) -> DataFrame:
    """(fp) of the nodes that are in ``FEW`` of the hot lists ``full`` (key), or meet one that they may link to in any."""
    held = written(merged(tables(nodes, width, m)[0], full, "key", "left_semi"), "hot")
    many = written(held.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= FEW).select("fp"), "many")
    few = merged(nodes, many, "fp", "left_anti")
    ball = F.transform(F.array(*[F.lit(x).cast("int") for x in _ball(width, 1)]), lambda x: F.col("key").bitwiseXOR(x))
    reach = full.select(F.col("key").alias("list"), F.explode(F.filter(ball, lambda x: x <= F.col("key"))).alias("key"))
    looks = merged(tables(few, width, m)[0], reach, "key").select(F.col("list").alias("key"), "fp", "sig")
    looks = written(looks, "looks")
    meet = (F.col("l.key") == F.col("t.key")) & (F.col("l.fp") != F.col("t.fp")) & _seen("l", "t")
    every = looks.union(tables(merged(nodes, many, "fp", "left_semi"), width, m)[1])
    looking = merged(looks.alias("l"), held.alias("t"), meet, "left_semi").select("fp")
    looked_up = merged(merged(held, many, "fp", "left_anti").alias("t"), every.alias("l"), meet, "left_semi").select("fp")
    return written(many.union(looking).union(looked_up).distinct(), "crowd")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[np.ndarray]]:
    """The columns (root, n, bits, and s where it is there) of the rows of each key, of rows in the order of keys; s: the sets in a row."""
    open_: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, n = batch.column(key).to_numpy(), batch.column("n").to_numpy()
        cols = [batch.column("root").to_numpy(), n, batch.column("bits").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)]
        at = np.arange(len(n) + 1)
        if "s" in batch.schema.names:
            cols.append(batch.column("s").flatten().to_numpy())
            at = np.concatenate([[0], np.cumsum(n)])
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if keys[a] != last and open_:
                yield [np.concatenate(x) if len(open_) > 1 else x[0] for x in zip(*open_, strict=True)]
                open_ = []
            last = keys[a]
            open_.append([*(c[a:b] for c in cols[:3]), *(c[at[a] : at[b]] for c in cols[3:])])
    if open_:
        yield [np.concatenate(x) for x in zip(*open_, strict=True)]


def _may_link(bits: np.ndarray, n: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As ``_near``, of arrays."""
    k, of = LEAST
    apart = np.bitwise_count(bits ^ others).sum(-1, dtype=np.int64)
    return (of * n >= k * sizes) & (of * sizes >= k * n) & (apart <= np.where(n + sizes < SHORT, WIDE, RADIUS))


def _forest(n: np.ndarray, bits: np.ndarray, sets: np.ndarray | None = None) -> list[tuple[int, np.ndarray]]:
    """Edges (a node, those found from it) that span what is near, or with ``sets`` what links. Each node is compared once, with those
    that none before it has found."""
    if len(n) <= SMALL and not np.triu(_may_link(bits[:, None], n[:, None], bits, n), 1).any():
        return []
    k, of = LEAST
    rest, edges = np.arange(len(n)), []
    if sets is not None:
        starts = np.concatenate([[0], np.cumsum(n)])
        distinct, sets = np.unique(sets, return_inverse=True)
        own = np.zeros(len(distinct), bool)
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        others, sizes = bits[rest], n[rest]
        while queue and len(rest):
            i = queue.pop()
            found = _may_link(bits[i], n[i], others, sizes)
            if sets is not None and found.any():
                some = rest[found]
                own[sets[starts[i] : starts[i + 1]]] = True
                both = own[np.concatenate([sets[starts[j] : starts[j + 1]] for j in some.tolist()])]
                both = np.add.reduceat(both, np.cumsum(n[some]) - n[some], dtype=np.int64)
                own[sets[starts[i] : starts[i + 1]]] = False
                found[found] = of * both >= k * (n[i] + n[some] - both)
            if found.any():
                edges.append((i, rest[found]))
                queue.extend(rest[found].tolist())
                left = ~found
                rest, others, sizes = rest[left], others[left], sizes[left]
    return edges


def _meet(rows: DataFrame, columns: tuple[str, ...], key: str, deal: Column) -> DataFrame:
    """Edges (a, b) between nodes (root) of ``rows`` that share ``key``, as many as span what is near among them by n and bits, or links
    where ``columns`` has their sets, too. They are found within a task for each value of ``deal``, which ``key`` decides; no pair that
    isn't such an edge leaves it, and none that those of the task's other keys connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for root, *of in _groups(batches, key):
            new = []
            for i, found in _forest(*of) if len(root) > 1 else []:
                a = int(root[i])
                for b in root[found].tolist():
                    x, y = top(a), top(b)
                    if x != y:
                        up[y] = x
                        new.append((a, b))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new, strict=True)], ["a", "b"])
            if len(up) > MOST:
                up.clear()
        give_back()

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, "root", *columns, deal.alias("deal")).repartition(count, "deal").sortWithinPartitions(key)
    return dealt.drop("deal").mapInArrow(run, "a long, b long")


def _among(docs: DataFrame, some: DataFrame, width: int, m: int, words: int) -> DataFrame:
    """Links (a, b) of the crowd ``some`` (fp, n, bits, text_hash) that span its components."""
    rooted = some.withColumn("root", F.col("fp"))
    more = ("root", "n", "bits")
    number = some.count()
    lists = tables(rooted, width, m, more)[1] if number > CROWD else tables(rooted, *EQUAL, more, 0)[0]
    deal = F.pmod(F.xxhash64("key"), F.lit(number * EQUAL[1] // ENTRIES + 1))
    found = components(written(_meet(lists, ("n", "bits"), "key", deal), "near"))
    family = F.coalesce("root", "fp").alias("family")
    nodes = written(merged(some, found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "bits", "text_hash", family), "families")
    sizes = nodes.groupBy("family").agg(F.count("*").alias("size"), F.sum("n").alias("held")).where("size > 1")
    nodes = merged(nodes, sizes.select("family", F.floor((F.col("held") - 1) / LOAD).cast("int").alias("last")), "family")
    nodes = written(nodes, "members")
    part = F.pmod(F.xxhash64("fp"), F.col("last") + 1).cast("int").alias("x")
    dealt = merged(nodes.drop("text_hash"), _sets(docs, nodes, words), "fp").select("*", part)
    dealt = dealt.select(F.col("fp").alias("root"), "n", "bits", "s", "family", "x", F.explode(F.sequence(F.lit(0), "last")).alias("y"))
    dealt = dealt.withColumn("block", F.xxhash64("family", F.least("x", "y"), F.greatest("x", "y")))
    return written(_meet(dealt, ("n", "bits", "s"), "block", F.col("block")), "among")


def links(docs: DataFrame, prints: DataFrame, words: int = 5, hot: int = HOT, segments: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose shingles' exact similarity is LEAST or more, as many as span the components."""
    nodes = prints.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("text_hash").alias("text_hash"))
    nodes = written(nodes, "nodes")
    number = nodes.count()
    width, m = segments or choose_segments(number)
    stored, looks = tables(nodes, width, m)
    limit = hot + 2 * number * (width + 2) // 2 ** (width + 1)
    full = written(full_lists(stored, width, limit), "full")
    crowd = full if full.isEmpty() else _crowd(nodes, full.select("key"), width, m)
    if crowd.isEmpty():
        return verified(docs, nodes, _pairs(merged(looks.alias("l"), stored.alias("t"), "key").where(_seen("l", "t"))), words)
    some, others = merged(nodes, crowd, "fp", "left_semi"), merged(nodes, crowd, "fp", "left_anti")
    some, others = written(some, "some"), written(others, "others")
    own = tables(others, width, m)
    met = [(own[1], stored), (tables(some, width, m)[1], own[0])]
    pairs = reduce(DataFrame.union, [_pairs(merged(x.alias("l"), y.alias("t"), "key").where(_seen("l", "t"))) for x, y in met])
    return verified(docs, nodes, pairs.distinct(), words).union(_among(docs, some, width, m, words))


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(fp, s) of ``nodes`` (fp, text_hash); s: the hashes of the node's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingles(t, words).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(sets, pa.list_(pa.int64()))], ["fp", "s"])

    texts = nodes.select("fp", "text_hash")
    held = docs.select(text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    held = merged(held, texts, "text_hash").dropDuplicates(["fp"])
    return held.select("fp", "text").mapInArrow(run, "fp long, s array<long>")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: by size, by all bits of the fingerprints, and by the sets themselves."""
    k, of = LEAST
    ends = merged(merged(pairs, nodes.alias("x"), F.col("a") == F.col("x.fp")), nodes.alias("y"), F.col("b") == F.col("y.fp"))
    pairs = written(ends.where(_near("x", "y")).select("a", "b"), "pairs")
    used = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    sets = written(_sets(docs, merged(nodes, used, "fp", "left_semi"), words), "sets")
    a, b = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    both = merged(merged(pairs, a, "a"), b, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
    found = both.where(of * F.col("c") >= k * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b")
    return written(found, "links")


def near_copies(docs: DataFrame, words: int = 5, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) of every row of ``docs``; component_id: the smallest doc_id reachable by links.

    ``root`` names the component also where ids repeat, and two components have one smallest id.
    """
    prints = written(_prints(docs, words), "prints")
    found = components(links(docs, prints, words, hot))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = merged(nodes, found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = written(merged(rooted, ids, "root").select("fp", "root", "component_id"), "classes")
    drop_written(rooted)
    return merged(prints, of, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies, chosen as in ``simhash.one_of_each``."""
    return first_of_each(docs, near_copies(docs, words))
