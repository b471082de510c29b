"""Token ids in training order: packed sequences, a keyed Feistel permutation, fixed-stride shards.

1. Texts are tokenized (byte-level BPE) once, and written as compressed chunks of ids with the id, hash and count of each
   of their documents. Documents are then put in order by (doc_id, null last; hash of the text): ranges of that order are
   numbered, their counts added up, and so every document gets its place in one stream, whatever files or partitions it
   came from. Each document is followed by the end token. Places return to the scan's tasks as one small file for each,
   so that the ids themselves are not moved for it.
2. The stream is cut every ``length`` tokens. Sequence i of n gets the slot that a keyed Feistel network assigns: a
   permutation of the next power of four, walked along its cycle until it falls below n. Slots are computed, never stored,
   and the inverse network tells which sequence a slot holds.
3. Pieces of sequences go to the range of slots that they belong to (``per_shard`` consecutive slots, a shard), those of a
   task and a shard as one compressed blob. Each shard is written at once as one file in which slot s begins at
   (s % per_shard) * stride bytes. So training reads sequentially, and resumes anywhere by arithmetic. A shard is written
   under another name and moved, so a lost task leaves no part.

Only the tail of the last sequence is padded, with the end token.

Defined results for odd input: null and empty texts give an end token alone; equal rows are written each, side by side; an
empty table writes no shard; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, text_of, work_path, written

MODEL = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary cuts a text before merging. A fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, PER_SHARD = 1024, 4096
ROUNDS = 6
REMEMBERED = 400_000
#: Bytes of ids in a chunk; bytes of ids that a task cuts into pieces at once; documents in a range of their order.
CHUNK, TOGETHER, RANGE_DOCS = 4 << 20, 32 << 20, 1_000_000


class Tokens(dict):
    """What stands between two places where a single space is followed by something else -> its ids as bytes of ``dtype``.

    The pattern always cuts before a single space that no white space follows, as it gives the space to what comes next.
    So a text is split at its spaces, and each part is cut by the pattern only when it is new. Texts where white space
    follows a space are cut by the pattern whole.
    """

    def __init__(self, path: str = MODEL):
        super().__init__()
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.last = np.array([self.end], self.dtype).tobytes()
        self.joint = regex.compile(r" (?=\s|$)").search
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def packed(self, text: str) -> bytes:
        """Ids of a text that is cut by the pattern."""
        return array(self.code, self.coder.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        out = self[part] = self.packed(" " + part)
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a text, then the end token."""
        if len(self) > REMEMBERED:
            self.clear()
        if self.joint(text):
            return self.packed(text) + self.last
        first, *rest = text.split(" ")
        return b"".join([self.packed(first), *map(self.__getitem__, rest), self.last])


_tokens: dict[str, Tokens] = {}


def tokens_of(path: str = MODEL) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def tokenized(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(run, first, doc_ids, hashes, ns, ids): chunks of documents as a scan task met them, ``first`` counts those before.

    ids: their packed ids, compressed. Written to the shared folder.
    """
    names = ["run", "first", "doc_ids", "hashes", "ns", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, at, task = tokens_of(model), 0, TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=6).compress
        held: list[tuple[pa.Array, pa.Array, list[int], bytes]] = []

        def chunk() -> pa.RecordBatch:
            nonlocal at
            ids, hashes = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
            ns = [n for h in held for n in h[2]]
            body = pack(b"".join([h[3] for h in held]))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            out = [pa.array([task], pa.int64()), pa.array([at], pa.int64()), one(ids), one(hashes), one(pa.array(ns, pa.int64())), pa.array([body], pa.binary())]
            at += len(ns)
            held.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            texts, i, size = batch.column("text").to_pylist(), 0, sum(len(h[3]) for h in held)
            parts: list[bytes] = []
            for j, text in enumerate(texts, 1):
                parts.append(tokens.encode(text))
                size += len(parts[-1])
                if size >= CHUNK or j == len(texts):
                    held.append((batch.column("doc_id").slice(i, j - i), batch.column("hash").slice(i, j - i), [len(p) // tokens.dtype.itemsize for p in parts], b"".join(parts)))
                    i, parts = j, []
                if size >= CHUNK:
                    yield chunk()
                    size = 0
        if held:
            yield chunk()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("hash", F.xxhash64("text"))
    return written(rows.mapInArrow(run, "run long, first long, doc_ids array<long>, hashes array<long>, ns array<long>, ids binary"), "tokens", "none")


def placed(tokens: DataFrame) -> tuple[str, int]:
    """Writes for each run a file of its documents' places in the stream; the folder, and the number of tokens."""
    spark = tokens.sparkSession
    pair = F.arrays_zip("doc_ids", "hashes", "ns")
    docs = tokens.select("run", "first", F.posexplode(pair).alias("k", "d"))
    docs = docs.select("run", (F.col("first") + F.col("k")).alias("at"), F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("hash"), F.col("d.ns").alias("n"))
    ranges = max(1, -(-(tokens.agg(F.sum(F.size("ns"))).first()[0] or 0) // RANGE_DOCS))
    # the run and the place in it tell equal rows apart, so that no row has too many equals for a range
    order = [F.col("doc_id").isNull(), "doc_id", "hash", "run", "at"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy()
            begin = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), batch.column("run"), batch.column("at"), pa.array(begin), batch.column("n")], ["part", "run", "at", "begin", "n"])

    ordered = docs.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("run", "at", "n")
    ordered = written(ordered.mapInArrow(add, "part long, run long, at long, begin long, n long"), "order")
    # a row for each range
    sums = ordered.groupBy("part").agg(F.sum("n").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("part", "all", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before")), "ranges")
    total = sums.agg(F.sum("all")).first()[0] or 0
    folder = work_path(spark, "places")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        now, held, done = -1, [], []

        def close() -> None:
            if held:
                part = f"{top}/{now}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as file:
                    file.write(np.concatenate(held).tobytes())
                store.move(part, f"{top}/{now}")
                held.clear()
                done.append(now)

        for batch in batches:
            runs, places = batch.column("run").to_numpy(), batch.column("place").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and runs[i] != now:
                    close()
                    now = int(runs[i])
                held.append(places[i:j])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["run"])

    rows = ordered.join(F.broadcast(sums), "part").select("run", "at", (F.col("begin") + F.col("before")).alias("place"))
    rows.repartition("run").sortWithinPartitions("run", "at").mapInArrow(write, "run long").agg(F.count("*")).first()
    return folder, total


class Feistel:
    """A keyed permutation of 0 to n - 1 and its inverse, for arrays."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        digest = hashlib.sha256(key.encode()).digest() + hashlib.sha256(b"more" + key.encode()).digest()
        self.keys = np.frombuffer(digest, "<u8")[:rounds]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        # the finalizer of a public 64-bit mixer
        x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mix(a, key), a) if back else (b, a ^ self._mix(b, key))
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    url = urlparse(path)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def write_order(docs: DataFrame, path: str, key: str = "order", length: int = LENGTH, per_shard: int = PER_SHARD, model: str = MODEL) -> tuple[int, int]:
    """Writes the shards below ``path`` (any address that pyarrow opens); the number of sequences and of tokens."""
    tokens = tokenized(docs, model)
    folder, total = placed(tokens)
    n = -(-total // length)
    if not n:
        return 0, 0
    order, end, dtype = Feistel(n, key), tokens_of(model).end, tokens_of(model).dtype

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        run, places, size = -1, np.zeros(0, np.int64), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def blobs() -> pa.RecordBatch:
            out = []
            for parts in held.values():
                offsets, sizes, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
                out.append(pack(b"".join([np.int64(len(offsets)).tobytes(), offsets.tobytes(), sizes.tobytes(), ids.tobytes()])))
            cols = [pa.array(held, pa.int64()), pa.array(out, pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["shard", "blob"])

        for batch in batches:
            for r, first, ns, body in zip(batch.column("run").to_pylist(), batch.column("first").to_pylist(), batch.column("ns"), batch.column("ids").to_pylist(), strict=True):
                if r != run:
                    run = r
                    with store.open_input_file(f"{top}/{run}") as file:
                        places = np.frombuffer(file.read(), np.int64)
                ids, ns = np.frombuffer(unpack(body), dtype), ns.values.to_numpy()
                at = places[first : first + len(ns)]
                low, many = at // length, (at + ns - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(ns)), many)
                sequence = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                begin, stop = np.maximum(at[doc], sequence * length), np.minimum((at + ns)[doc], (sequence + 1) * length)
                source, sizes = (np.cumsum(ns) - ns)[doc] + begin - at[doc], stop - begin
                slot = order.slots(sequence)
                shard, offset = slot // per_shard, (slot % per_shard) * length + begin - sequence * length
                by = np.argsort(shard, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(shard[by])) + 1).tolist(), len(by)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    rows = by[i:j]
                    ends = np.cumsum(sizes[rows])
                    which = np.arange(int(ends[-1])) + np.repeat(source[rows] - (ends - sizes[rows]), sizes[rows])
                    held.setdefault(int(shard[rows[0]]), []).append((offset[rows], sizes[rows].astype(np.int32), ids[which]))
                size += ids.nbytes
                if size >= TOGETHER:
                    yield blobs()
                    size = 0
        if held:
            yield blobs()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(path)
        store.create_dir(top, recursive=True)
        unpack = zstandard.ZstdDecompressor().decompress
        now, rows, done = -1, np.zeros(0, dtype), []

        def close() -> None:
            if now >= 0:
                name = f"{top}/shard-{now:08d}.bin"
                part = f"{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as file:
                    file.write(rows.tobytes())
                store.move(part, name)
                done.append(now)

        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, rows = shard, np.full(min(per_shard, n - shard * per_shard) * length, end, dtype)
                raw = unpack(blob)
                k = int(np.frombuffer(raw, np.int64, 1)[0])
                offsets, sizes = np.frombuffer(raw, np.int64, k, 8), np.frombuffer(raw, np.int32, k, 8 + 8 * k).astype(np.int64)
                ids = np.frombuffer(raw, dtype, -1, 8 + 12 * k)
                rows[np.arange(len(ids)) + np.repeat(offsets - (np.cumsum(sizes) - sizes), sizes)] = ids
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["shard"])

    shards = -(-n // per_shard)
    many = min(shards, 100_000)
    ranged = tokens.select("run", "first", "ns", "ids").mapInArrow(pieces, "shard long, blob binary")
    dealt = ranged.repartitionById(many, F.floor(F.col("shard") * many / F.lit(shards)).cast("int")).sortWithinPartitions("shard")
    found = dealt.mapInArrow(write, "shard long").agg(F.count("*")).first()[0]
    if found != shards:
        raise RuntimeError(f"{found} of {shards} shards were written")
    return n, total


def read_slots(path: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: np.dtype = np.dtype("<u2")) -> Iterator[np.ndarray]:
    """The ids of ``count`` slots from ``first`` on, read in order: how training starts and how it resumes."""
    store, top = _store(path)
    stride, slot = length * dtype.itemsize, first
    while slot < first + count:
        shard = slot // per_shard
        with store.open_input_file(f"{top}/shard-{shard:08d}.bin") as file:
            file.seek((slot % per_shard) * stride)
            while slot < first + count and slot // per_shard == shard:
                yield np.frombuffer(file.read(stride), dtype)
                slot += 1


def described(spark: SparkSession, path: str, n: int, key: str = "order", length: int = LENGTH, per_shard: int = PER_SHARD, model: str = MODEL) -> DataFrame:
    """A row for each slot, read back from its shard: the sequence it holds, its place, end tokens, CRC-32 of its bytes."""
    order, dtype, end = Feistel(max(n, 1), key), tokens_of(model).dtype, tokens_of(model).end

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                slots = np.arange(shard * per_shard, min(n, (shard + 1) * per_shard))
                rows = [(np.count_nonzero(x == end), zlib.crc32(x), int(x[0])) for x in read_slots(path, int(slots[0]), len(slots), length, per_shard, dtype)]
                ends, crc, first = zip(*rows, strict=True)
                cols = [slots, order.sequences(slots), np.full(len(slots), shard), (slots % per_shard) * length * dtype.itemsize, ends, crc, first]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["slot", "sequence", "shard", "byte", "n_ends", "crc32", "first_id"])

    shards = -(-n // per_shard)
    names = "slot long, sequence long, shard long, byte long, n_ends long, crc32 long, first_id long"
    return spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInArrow(read, names)


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` tokenized, packed and written in training order; every slot as read back."""
    path = work_path(spark, "order")
    n, _ = write_order(documents(spark, sf_dir), path)
    return described(spark, path, n)
