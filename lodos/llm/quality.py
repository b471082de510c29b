"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Two multinomials over ``buckets`` hashed n-grams are counted: one over every document (the raw corpus), one over the
trusted documents among them (labelled good and not toxic; a bounded sample of their ids, see ``TRUSTED``). An n-gram is
a word, a pair of words, a word's shape (runs of letter case, digits, marks) or a pair of shapes; each kind has a
quarter of the buckets. A document's score is the mean over its n-grams of log(p_trusted / p_raw). Pseudo-counts of
``prior`` raw n-grams a bucket, spread in the raw proportions, keep rare n-grams near zero, so that a score falls only
by n-grams that the raw corpus has often and trusted text does not. The threshold is the median less ``spread`` times the
median absolute deviation of trusted documents' scores, each taken without the counts of its own fold of ``FOLDS``.

A length-normalised score hardly falls by a few words. So words are learned, too, that labelled toxic documents hold and
trusted ones do not (lower case, without marks at their ends; ``LEAST_TOXIC`` toxic documents at least): a document's
toxicity is the sum of its distinct markers' log odds. It is rejected above what all but ``LOSS`` of the trusted documents
have by markers of the other folds. Both cuts are applied to every document alike.

Defined results for odd input: null and empty texts have zero counts and fail the base rule; equal texts give equal
values; trusted ids that no document has count for nothing; without any trusted document scores are 0 and the base rule
alone decides; without trusted or toxic ones there are no markers; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, parts, text_of

#: Trusted documents at most: those whose ids have the smallest hashes. The only sample here; counts cover all documents.
TRUSTED = 20_000
BUCKETS = 1 << 17
PRIOR = 50.0
SPREAD = 8.0
FOLDS = 4
LEAST_TOXIC = 5
#: The share of trusted documents that markers may reject.
LOSS = 0.005
#: Distinct words that a task remembers before it begins anew.
REMEMBERED = 250_000

_SYMBOLS = b"#*$%&|<>"
_MARKS = b".,;:!?\"'()[]{}<>*_-"
_SPACES = b" \t\n\r\x0b\x0c"
_SHAPE = re.compile(rb"([A-Z]+|\xc3[\x80-\x9e])|([a-z\x80-\xff]+)|([0-9]+)|([^A-Za-z0-9\x80-\xff]+)")


#: Bytes by what the pattern tells apart: words of one outline have one shape, and there are few outlines.
_OUTLINE = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b if b < 97 or 123 <= b < 128 or b == 0xC3 else 128 if 128 <= b <= 0x9E else 97 for b in range(256))


@functools.lru_cache(1 << 16)
def _shape(outline: bytes) -> int:
    """A small hash of all runs of a word's outline: A letters of upper case, a of lower case, 0 digits, else the marks themselves."""
    return xxhash.xxh32_intdigest(b"".join([(b"", b"A", b"a", b"0", m.group())[m.lastindex] for m in _SHAPE.finditer(outline)]))


def _bare(word: bytes) -> bytes:
    return word.lower().strip(_MARKS)


class _Words(dict):
    """word -> its number; the arrays hold each word's hash, shape and log odds as a marker."""

    def __init__(self, markers: dict[bytes, float] | None = None) -> None:
        super().__init__()
        self.hashes, self.shapes, self.odds, self.markers = array("Q"), array("Q"), array("d"), markers or {}

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        self.shapes.append((_shape if len(word) < 64 else _shape.__wrapped__)(word.translate(_OUTLINE)))
        self.odds.append(self.markers.get(_bare(word), 0.0) if self.markers else 0.0)
        return n


_words = _Words()


def _numbered(words: list[bytes]) -> np.ndarray:
    """The words' numbers; equal words have equal numbers within a text."""
    global _words
    if len(_words) > REMEMBERED:
        _words = _Words(_words.markers)
    return np.fromiter(map(_words.__getitem__, words), np.int64, len(words))


def _forget(markers: dict[bytes, float] | None = None) -> None:
    """Leaves nothing of a task in the worker, which later tasks of other stages share, but begins with ``markers``."""
    global _words
    _words = _Words(markers)
    _shape.cache_clear()
    give_back()


def _toxicity(ids: np.ndarray) -> float:
    """The log odds of a text's distinct markers."""
    return float(np.frombuffer(_words.odds)[np.unique(ids)].sum()) if len(ids) and _words.markers else 0.0


def _grams(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each n-gram of a text."""
    quarter = np.uint64(buckets // 4)
    h = np.frombuffer(_words.hashes, np.uint64)[ids]
    s = np.frombuffer(_words.shapes, np.uint64)[ids]
    step = np.uint64(0x9E3779B97F4A7C15)
    mix = lambda x: ((x * step) >> np.uint64(24)) % quarter
    parts = [mix(h), mix(h[:-1] * np.uint64(31) + h[1:]) + quarter, mix(s) + 2 * quarter, mix(s[:-1] * np.uint64(31) + s[1:]) + 3 * quarter]
    return np.concatenate(parts).astype(np.int64)


def _repeated(ids: np.ndarray) -> int:
    """Words within 3-word windows that are found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    _, ids = np.unique(ids, return_inverse=True)
    if len(ids) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.nonzero(counts[inverse] > 1)[0]
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


def base_counts(text: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    bare = text.translate(None, _SPACES)
    chars = len(bare) - int(np.count_nonzero((np.frombuffer(bare, np.uint8) & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    return len(words), chars, len(bare) - len(bare.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeated(ids)


@dataclass(frozen=True)
class Model:
    """log(p_trusted / p_raw) for each bucket, the least score that is kept, markers and the greatest toxicity that is kept."""

    ratio: np.ndarray
    threshold: float
    markers: dict[bytes, float] | None = None
    most: float = float("inf")


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """Ids of documents labelled good and not toxic: all, or the ``most`` of smallest hash."""
    return _ids(labels.where("quality = 1 and toxic = 0"), most)


def _ids(labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    good = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def _in(ids: pa.Array, trusted: np.ndarray) -> np.ndarray:
    return np.isin(np.array([-1 if x is None else x for x in ids.to_pylist()], np.int64), trusted) & np.array([x is not None for x in ids.to_pylist()], bool)


def _fold(ids: np.ndarray) -> np.ndarray:
    """The fold of each id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS


def count_grams(docs: DataFrame, trusted: np.ndarray, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, good): n-grams of all documents and of the trusted ones by fold. A task sends each bucket once."""

    held = [f"good{k}" for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros((FOLDS, buckets), np.int64)
        for batch in parts(batches):
            folds = _fold(np.array([x or 0 for x in batch.column("doc_id").to_pylist()], np.int64))
            for text, is_good, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), _in(batch.column("doc_id"), trusted), folds, strict=True):
                if words := text.split():
                    n = np.bincount(_grams(_numbered(words), buckets), minlength=buckets) if len(words) > 20_000 else None
                    if n is None:
                        at = _grams(_numbered(words), buckets)
                        np.add.at(raw, at, 1)
                        if is_good:
                            np.add.at(good[k], at, 1)
                    else:
                        raw += n
                        if is_good:
                            good[k] += n
        _forget()
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), *[pa.array(g[at]) for g in good]], ["bucket", "raw", *held])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "bucket long, raw long, " + ", ".join(f"{c} long" for c in held)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", *held)])


def ratios(raw: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log(p_trusted / p_raw); both have ``prior`` pseudo-counts a bucket, in raw counts and their trusted share. 0 without trusted counts."""
    parts = []
    for r, g in zip(np.split(raw.astype(float), 4), np.split(good.astype(float), 4), strict=True):
        share = g.sum() / max(r.sum(), 1.0)
        parts.append(np.log((g + prior * share) / ((r + prior) * share)) if share > 0 else np.zeros(len(r)))
    return np.concatenate(parts)


def _labelled(docs: DataFrame, trusted: np.ndarray, toxic: np.ndarray) -> DataFrame:
    """(toxic, fold, text) of the documents with these ids; the ids are few."""
    both = np.concatenate([trusted, toxic])
    rows = list(zip(both.tolist(), np.repeat([0, 1], [len(trusted), len(toxic)]).tolist(), _fold(both).tolist(), strict=True))
    ids = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic int, fold int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(ids), "doc_id").select("toxic", "fold", "text")


def count_words(labelled: DataFrame) -> dict[bytes, np.ndarray]:
    """Of words in LEAST_TOXIC toxic documents or more: the documents that hold them, by label and fold."""
    names = [f"n{t}{k}" for t in (0, 1) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for toxic, k, text in zip(*[batch.column(c).to_pylist() for c in ("toxic", "fold")], batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for w in set(map(_bare, text.split())):
                    found.setdefault(w, [0] * len(names))[toxic * FOLDS + k] += 1
            cols = zip(*found.values(), strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *[pa.array(c, pa.int64()) for c in cols]], ["word", *names])

    rows = labelled.mapInArrow(run, "word binary, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    rows = rows.where(sum((F.col(n) for n in names[FOLDS:]), F.lit(0)) >= LEAST_TOXIC).collect()
    return {bytes(r["word"]): np.array(r[1:]).reshape(2, FOLDS) for r in rows}


def markers_of(counts: dict[bytes, np.ndarray], docs: np.ndarray) -> dict[bytes, float]:
    """Words' log odds of a toxic document over a trusted one, where they are over 2; ``docs``: documents by label."""
    out = {}
    for word, n in counts.items():
        good, bad = n
        odds = float(np.log((bad + 0.5) / (docs[1] + 1) * (docs[0] + 1) / (good + 0.5)))
        if bad >= LEAST_TOXIC and odds > 2:
            out[word] = odds
    return out


def held_out(labelled: DataFrame, models: list[Model], buckets: int) -> np.ndarray:
    """(toxic, n_words, score, toxicity) of each labelled document, by the model of the other folds."""
    sent = labelled.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(batch.column("fold").to_pylist(), np.int64)
            texts, out = batch.column("text").cast(pa.binary()).to_pylist(), [(0, 0.0, 0.0)] * len(at)
            for k, model in enumerate(sent.value):
                _forget(model.markers)
                for i in np.nonzero(at == k)[0].tolist():
                    words = texts[i].split()
                    ids = _numbered(words)
                    out[i] = (len(words), float(model.ratio[_grams(ids, buckets)].mean()) if words else 0.0, _toxicity(ids))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *cols], ["toxic", "n_words", "score", "toxicity"])
        _forget()

    rows = labelled.mapInArrow(run, "toxic int, n_words long, score double, toxicity double").collect()
    return np.array([tuple(r) for r in rows], float).reshape(-1, 4)


def scored(docs: DataFrame, model: Model, buckets: int = BUCKETS) -> DataFrame:
    """Base counts, score and toxicity of each document."""
    held = docs.sparkSession.sparkContext.broadcast((model.ratio, model.markers))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, markers = held.value
        _forget(markers)
        for batch in parts(batches):
            out, scores, toxic = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = text.split()
                ids = _numbered(words)
                out.append(base_counts(text, words, ids))
                scores.append(float(ratio[_grams(ids, buckets)].mean()) if words else 0.0)
                toxic.append(_toxicity(ids))
            cols = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols, pa.array(scores, pa.float64()), pa.array(toxic, pa.float64())], ["doc_id", "text_hash", *names, "score", "toxicity"])
        _forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names) + ", score double, toxicity double")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR, spread: float = SPREAD) -> Model:
    """Counts all documents and fixes both cuts on labelled ones, held out of their own model."""
    trusted, toxic = trusted_ids(labels), _ids(labels.where("toxic = 1"))
    raw, good = np.zeros(buckets, np.int64), np.zeros((FOLDS, buckets), np.int64)
    for bucket, r, *g in count_grams(docs, trusted, buckets).collect():  # as many rows as buckets at most
        raw[bucket], good[:, bucket] = r, g
    ratio = ratios(raw, good.sum(0), prior)
    if not good.any():
        return Model(ratio, float("-inf"))
    labelled = _labelled(docs, trusted, toxic)
    words = count_words(labelled)
    sizes = np.stack([np.bincount(_fold(x), minlength=FOLDS) for x in (trusted, toxic)])
    without = [Model(ratios(raw, good.sum(0) - good[k], prior), 0.0, markers_of({w: n.sum(1) - n[:, k] for w, n in words.items()}, sizes.sum(1) - sizes[:, k])) for k in range(FOLDS)]
    found = held_out(labelled, without, buckets)
    found = found[(found[:, 1] >= 50) & (found[:, 0] == 0)]
    if not len(found):
        return Model(ratio, float("-inf"))
    mid = float(np.median(found[:, 2]))
    off = float(np.median(np.abs(found[:, 2] - mid)))
    most = float(np.quantile(found[:, 3], 1 - LOSS, method="higher"))
    return Model(ratio, mid - spread * off, markers_of({w: n.sum(1) for w, n in words.items()}, sizes.sum(1)), most)


def judged(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """doc_id, text_hash, base counts, score, base_failed and kept of every document."""
    model = fit(docs, labels, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = scored(docs, model).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold) & (F.col("toxicity") <= model.most))


def kept_documents(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; nothing is shuffled for it."""
    model = fit(docs, labels, **options)
    held = docs.sparkSession.sparkContext.broadcast((model.ratio, model.markers))
    threshold, most, at, buckets = model.threshold, model.most, docs.columns.index("text"), len(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, markers = held.value
        _forget(markers)
        for batch in parts(batches):
            stay = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                ids = _numbered(words)
                good = len(words) >= 50 and 100 * _repeated(ids) <= 50 * len(words)
                stay.append(good and float(ratio[_grams(ids, buckets)].mean()) >= threshold and _toxicity(ids) <= most)
            yield batch.filter(pa.array(stay, pa.bool_()))
        _forget()

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every row of ``documents``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(documents(spark, sf_dir), labels).drop("text_hash", "toxicity")
