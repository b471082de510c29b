"""Removal of repeated byte strings by suffix arrays, built by linear grouping.

A byte goes if a string of ``least`` bytes covers it that also starts in a document with a smaller id. Strings are judged
on the input; matches never cross documents.

*Construction.* Suffixes are grouped by their first byte, then groups are processed in descending order. For each suffix
of a group its previous smaller one is found along pointers that are already known; those that it points at are extended
by the group's string, and split off behind the rest of their own groups, by how often they are extended. Every group
then shares its longest Lyndon prefix, groups stand in order, and one pass over the order itself emits each group's
suffixes, following the same pointers. Nothing is renamed or sorted again.

*Distribution.* A string of ``least`` bytes belongs to the smallest hash of its ``GRAM``-byte grams (its anchor), so equal
strings have equal anchors at equal places. Runs of neighbouring strings with one anchor travel together as one segment,
to a bin by their anchor's hash; equal segments of a common anchor travel as one with all its occurrences. In a bin
  1. segments stay whose anchor, with half of what a string holds beyond it on one side, occurs in two documents;
  2. segments of an anchor are aligned at it and trimmed to what agrees with some other segment; equal ones become one;
  3. a segment that lies whole in one of a smaller id goes whole; an anchor with one segment left is settled; two share what
     agrees around it, as equal strings have their anchor at one place; three or more are concatenated, in blocks of bounded
     size, and put in suffix order. Neighbours that agree on ``least`` bytes form a class, whose smallest id is what counts.
Ranges of strings to remove return to their documents, where they are united and cut out.

Bins are sized by the table's bytes. One anchor's occurrences meet in one bin.

Defined results for odd input: null and empty texts have no bytes; documents of one id never remove from each other; a
null id is larger than all others but 2^63 - 1, which counts as the same id and still comes back as itself; equal rows
(same id, same text) give equal rows; an empty table gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IN_HAND, documents, give_back, parts, text_of

LEAST = 50
GRAM = 12
#: Text bytes for each bin; bins at least.
BIN_BYTES, BINS = 8 << 20, 64
#: Text bytes whose segments travel in one blob for each bin; bytes put in suffix order at once; variants that one is looked for in.
BLOCK, SORTED, NEAR = 8 << 20, 1 << 18, 16
#: Segments whose bytes are laid out by places at once; occurrences that are spread out at once.
ROWS, SPREAD = 1 << 13, 1 << 18
#: Occurrences of an anchor in the texts in hand from which on equal segments are sought.
MANY = 16
LAST = (1 << 63) - 1


def suffix_array(text: bytes) -> list[int]:
    """Starts of all suffixes in order. ``text`` ends with a byte 0 that may occur elsewhere; the end is smaller than 0.

    Linear grouping: see the module's text. ``start[i]`` is where suffix i's group begins in the order.
    """
    n = len(text) + 1  # with the empty suffix
    counts = [0] * 257
    for c in text:
        counts[c + 1] += 1
    counts[0] = 1
    begin, at = [0] * 257, 0
    for c, k in enumerate(counts):
        begin[c], at = at, at + k
    size = [0] * n
    for c, k in enumerate(counts):
        if k:
            size[begin[c]] = k
    start = [begin[c + 1] for c in text]
    start.append(0)
    fill, order, place = begin[:], [0] * n, [0] * n
    for i, c in enumerate(text):
        k = fill[c + 1]
        order[k], place[i], fill[c + 1] = i, k, k + 1
    order[0], place[n - 1] = n - 1, 0
    before = [-1] * n  # previous smaller suffix

    end = n - 1
    while end > 0:
        group = start[order[end]]
        if group == end:
            i = order[end]
            j = i - 1
            while j >= 0 and start[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                own = start[j]
                k = size[own]
                if k > 1:
                    to, p = own + k - 1, place[j]
                    other = order[to]
                    order[to], order[p], place[other], place[j] = j, other, p, to
                    size[own], start[j], size[to] = k - 1, to, 1
            end -= 1
            continue
        times: dict[int, int] = {}
        for i in sorted(order[group : end + 1]):
            j = i - 1
            while j >= 0 and start[j] >= group:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        rounds: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            rounds.setdefault(k, {}).setdefault(start[j], []).append(j)
        for k in sorted(rounds, reverse=True):
            for own, them in rounds[k].items():
                rest = size[own] - len(them)
                if rest:
                    to = own + size[own]
                    for j in them:
                        to -= 1
                        p, other = place[j], order[to]
                        order[to], order[p], place[other], place[j] = j, other, p, to
                    for j in them:
                        start[j] = to
                    size[own], size[to] = rest, len(them)
        end = group - 1
    # the order itself names, one after another, what stands before each group's next suffix
    fill, out, done = list(range(n)), [0] * n, [False] * n
    out[0], done[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            own = start[j]
            out[fill[own]], done[j] = j, True
            fill[own] += 1
            j = before[j]
    return out


# --- anchors -------------------------------------------------------------------------------------------------------


_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place but the last gram - 1, put together from halves."""
    part, size = data.astype(np.uint64), 1
    out, done = None, 0  # polynomial of the first ``done`` bytes at each place
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    while True:
        if gram & size:
            if out is None:
                out, done = part, size
            else:
                n = len(data) - done - size + 1
                out, done = out[:n] * power(size) + part[done : done + n], done + size
        if done == gram:
            break
        part = part[:-size] * power(size) + part[size:]
        size *= 2
    return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _hashes_at(data: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes at each place, read as rows, ROWS places at a time."""
    out = np.empty(len(places), np.uint64)
    power = np.array([pow(_BASE, k, 1 << 64) for k in range(gram)][::-1], np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(data, gram)
    for a in range(0, len(places), ROWS):
        h = rows[places[a : a + ROWS]].astype(np.uint64) @ power
        out[a : a + ROWS] = _mixed(h)
    return out


def segments(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all texts: the text's number, first string's start, strings, anchor's offset from there, anchor's hash; and the joined bytes, each text's start."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, np.zeros(0, np.uint64), data, starts
    low = np.uint64((1 << 24) - 1)
    h = _gram_hashes(data, gram)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first place counts
    window, span = key, 1
    grams = least - gram + 1
    while span < grams:
        step = min(span, grams - span)
        window = np.minimum(window[:-step], window[step:])
        span += step
    anchor = (window & low).astype(np.int64)  # of the string at each place
    whole = np.zeros(len(anchor), bool)
    for s, k in zip(starts.tolist(), sizes.tolist(), strict=True):
        if k >= least:
            whole[s : s + k - least + 1] = True
    edge = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1] | ~whole[1:]])
    first = np.nonzero(edge & whole)[0]
    ends = np.nonzero(np.concatenate([edge[1:], [True]]) & whole)[0] + 1
    return np.searchsorted(starts, first, "right") - 1, first, ends - first, anchor[first] - first, h[anchor[first]], data, starts


def _take(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes data[first : first + size] of each, joined."""
    out, done = np.empty(int(sizes.sum()), np.uint8), 0
    for a in range(0, len(first), ROWS):
        size = sizes[a : a + ROWS]
        ends = np.cumsum(size)
        n = int(ends[-1])
        out[done : done + n] = data[np.arange(n) + np.repeat(first[a : a + ROWS] - (ends - size), size)]
        done += n
    return out


def _pieces(texts: list[bytes], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts in blocks of about BLOCK bytes, with each one's number and where it begins there; a long text is cut into overlapping parts."""
    pieces, owner, base = [], [], []
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - least + 1), IN_HAND):
            pieces.append(t[a : a + IN_HAND + least - 1])
            owner.append(d)
            base.append(a)
    for block in _runs_of(pieces, BLOCK):
        yield pieces[block], np.array(owner[block]), np.array(base[block], np.int64)


def _alike(first: np.ndarray, strings: np.ndarray, off: np.ndarray, anchor: np.ndarray, data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments' numbers with equal ones (of anchors that occur MANY times) side by side, in the order of the text; and which are the first of theirs."""
    n = len(first)
    by = np.argsort(anchor, kind="stable")
    a = anchor[by]
    counts = np.diff(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))) if n else np.zeros(0, np.int64)
    hot = by[np.repeat(counts >= MANY, counts)]
    if not len(hot):
        return np.arange(n), np.ones(n, bool)
    size = strings[hot] + (least - 1)
    rows = np.zeros((len(hot), -(-int(size.max()) // 8) * 8), np.uint8)
    k = np.arange(rows.shape[1])
    for x in range(0, len(hot), ROWS):
        inside = k < size[x : x + ROWS, None]
        rows[x : x + ROWS] = np.where(inside, data[np.where(inside, first[hot[x : x + ROWS], None] + k, 0)], 0)
    words = rows.view(np.uint64)
    key = words @ np.array([pow(_BASE, i + 3, 1 << 64) for i in range(words.shape[1])], np.uint64)
    key = _mixed(key + (strings[hot] * 256 + off[hot]).astype(np.uint64))
    _, one, kind = np.unique(key, return_index=True, return_inverse=True)
    like = one[kind]
    other = (words != words[like]).any(1) | (size != size[like]) | (off[hot] != off[hot[like]])
    kind[other] = len(one) + np.arange(int(other.sum()))  # a hash is no proof
    rest = np.ones(n, bool)
    rest[hot] = False
    by = np.lexsort((hot, kind))
    new = np.concatenate([[True], kind[by][1:] != kind[by][:-1]])
    return np.concatenate([np.flatnonzero(rest), hot[by]]), np.concatenate([np.ones(n - len(hot), bool), new])


def _cut_up(pieces: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Of all pieces, segments: first string's start, strings, anchor's offset, anchor's hash, rows of occurrences; occurrences in that order:
    the piece's number, start within it, times that the segment follows there at equal steps, step; and the joined bytes.

    Worked out from about IN_HAND bytes at a time: what is held for each byte takes some forty times its room.
    """
    found: list[tuple[np.ndarray, ...]] = []
    before = 0
    for group in _runs_of(pieces, IN_HAND):
        number, first, strings, off, anchor, data, begins = segments(pieces[group], least)
        order, new = _alike(first, strings, off, anchor, data, least)
        who, at = number[order], first[order]
        apart = new.copy()
        apart[1:] |= who[1:] != who[:-1]
        step = np.diff(at, prepend=0)
        start = apart.copy()
        start[1:] |= ~apart[:-1] & (step[1:] != step[:-1])
        runs = np.flatnonzero(start)
        times = np.diff(runs, append=len(order))
        steps = np.where(times > 1, step[np.minimum(runs + 1, len(step) - 1)], 0) if len(runs) else times
        heads = np.flatnonzero(new)
        count = np.diff(np.searchsorted(runs, heads), append=len(runs))
        own = order[heads]
        found.append((first[own] + before, strings[own].astype(np.uint8), off[own].astype(np.uint8), anchor[own], count.astype(np.int32), who[runs] + group.start, at[runs] - begins[who[runs]], times.astype(np.int32), steps.astype(np.int32), data))
        before += len(data)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... (counts[0] numbers), then those from starts[1], and so on."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _binned(docs: DataFrame, bins: int, least: int) -> DataFrame:
    """(bin, blob): packed segments, a blob for each bin and block of texts."""

    def blobs(ids: np.ndarray, marks: np.ndarray, pieces: list[bytes], base: np.ndarray) -> Iterator[tuple[int, bytes]]:
        pack = zstandard.ZstdCompressor(level=5).compress
        first, strings, off, anchor, count, number, where, times, step, data = _cut_up(pieces, least)
        where += base[number]
        begins = np.cumsum(count, dtype=np.int64) - count
        to = (anchor % np.uint64(bins)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[by], np.arange(bins + 1))
        for b in range(bins):
            rows = by[cuts[b] : cuts[b + 1]]
            if not len(rows):
                continue
            own = _spread(begins[rows], count[rows])
            body = _take(data, first[rows], strings[rows].astype(np.int64) + (least - 1))
            heads = [strings[rows], off[rows], count[rows], ids[number[own]], marks[number[own]], where[own], times[own], step[own]]
            yield b, pack(b"".join([np.array([len(rows), len(own)], np.int64).tobytes(), *(x.tobytes() for x in heads), body.tobytes()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text", BLOCK):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for pieces, owner, base in _pieces(texts, least):
                out = list(blobs(ids[owner], marks[owner], pieces, base))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["bin", "blob"])

    return docs.mapInArrow(run, "bin long, blob binary")


def _runs_of(pieces: list[bytes], most: int) -> Iterator[slice]:
    """Slices of pieces that hold ``most`` bytes together, or one piece."""
    start, held = 0, 0
    for i, p in enumerate(pieces):
        if i > start and held + len(p) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(p)
    if pieces:
        yield slice(start, len(pieces))


def _unpack(blobs: list[bytes], least: int) -> tuple:
    """Of all segments strings, offsets, where their occurrences begin and how many rows these take, their bytes joined, and where each begins
    there; of all occurrences ids, marks, places, times and steps."""
    kinds = (np.uint8, np.uint8, np.int32, np.int64, np.int64, np.int64, np.int32, np.int32)
    heads: list[list[np.ndarray]] = [[] for _ in kinds]
    bodies: list[memoryview] = []
    unpack = zstandard.ZstdDecompressor().decompress
    for blob in blobs:
        raw = unpack(blob)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at = 16
        for k, kind in enumerate(kinds):
            heads[k].append(np.frombuffer(raw, kind, n if k < 3 else m, at))
            at += len(heads[k][-1]) * np.dtype(kind).itemsize
        bodies.append(memoryview(raw)[at:])
    strings, offs, count, *occurrences = map(np.concatenate, heads)
    strings, offs = strings.astype(np.int16), offs.astype(np.int16)
    size = strings.astype(np.int64) + (least - 1)
    return strings, offs, np.cumsum(count, dtype=np.int64) - count, count, b"".join(bodies), np.cumsum(size) - size, *occurrences


def _in_two(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether each key occurs with two different ids; ``low`` and ``high`` are the least and largest of each row's."""
    by = np.argsort(keys, kind="stable")
    k = keys[by]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    heads = np.nonzero(new)[0]
    two = np.minimum.reduceat(low[by], heads) != np.maximum.reduceat(high[by], heads)
    out = np.empty(len(keys), bool)
    out[by] = two[group]
    return out


def _rows(body: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int, back: bool) -> np.ndarray:
    """Each slice as a row of ``width`` numbers (byte + 1, then 0), reversed if ``back``."""
    k = np.arange(width)
    out = np.empty((len(first), width), ">u2")
    for a in range(0, len(first), ROWS):
        size = sizes[a : a + ROWS, None]
        at = first[a : a + ROWS, None] + (size - 1 - k if back else k)
        inside = k < size
        out[a : a + ROWS] = np.where(inside, body[np.where(inside, at, 0)].astype(np.uint16) + 1, 0)
    return out


def _agree(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row, how many leading numbers it shares with some other row of its anchor."""
    n, width = rows.shape
    packed = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 4)))).view(">u8")
    by = np.lexsort((*packed.T[::-1], anchor))
    r, a = rows[by], anchor[by]
    differ = (r[1:] != r[:-1]) | (r[1:] == 0)
    same = np.where(differ.any(1), differ.argmax(1), width) * (a[1:] == a[:-1])
    out = np.zeros(n, np.int64)
    near = np.maximum(np.concatenate([[0], same]), np.concatenate([same, [0]]))
    out[by] = near
    return out


def _leading(a: bytes, b: bytes) -> int:
    """How many bytes the two begin with alike."""
    n = min(len(a), len(b))
    return n - -((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() // -8) if n else 0


def _trailing(a: bytes, b: bytes) -> int:
    """How many bytes the two end with alike."""
    n = min(len(a), len(b))
    return n - -((int.from_bytes(a[len(a) - n :], "little") ^ int.from_bytes(b[len(b) - n :], "little")).bit_length() // -8) if n else 0


RANGES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])


def _ranges(blobs: list[bytes], least: int, gram: int) -> pa.Table:
    """(doc_id, text_hash, lo, hi): runs of starts of strings to remove, from one bin's blobs; rows of a document hold lists of runs."""
    strings, offs, start, count, raw, begins, ids, marks, places, times, step = _unpack(blobs, least)
    body = np.frombuffer(raw, np.uint8)
    low, high, often = ids, ids, times
    if len(ids) > len(strings):
        low, high, often = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start), np.add.reduceat(times, start, dtype=np.int64)
    half = (least - gram) // 2
    size = strings + (least - 1)
    stay = np.zeros(len(size), bool)
    for delta in (0, -half):  # with the bytes right of the anchor, then with those left of it
        at = offs + delta
        fits = np.nonzero((at >= 0) & (at + gram + half <= size))[0]
        if len(fits):
            stay[fits] |= _in_two(_hashes_at(body, begins[fits] + at[fits], gram + half), low[fits], high[fits])
    keep = np.nonzero(stay)[0]
    out: list[np.ndarray] = []
    if len(keep):
        low, high, often, start, count, offs, begins, size = (x[keep] for x in (low, high, often, start, count, offs, begins, size))
        exact = _rows(body, begins + offs, np.full(len(keep), gram), gram, False)
        _, anchor = np.unique(np.ascontiguousarray(exact).view(f"V{2 * gram}").reshape(-1), return_inverse=True)
        for part in _parts(anchor, 60_000):
            out.append(_settle(anchor[part], low[part], high[part], often[part], offs[part], begins[part], size[part], raw, least, part))
    found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
    tables = [pa.table({"doc_id": [], "text_hash": [], "lo": [], "hi": []}, RANGES)]
    held = np.cumsum(often[found[:, 0]], dtype=np.int64)
    edges = np.searchsorted(held, np.arange(SPREAD, int(held[-1]) + SPREAD, SPREAD)) + 1 if len(held) else []
    done = 0
    for end in edges:
        if end > done:
            k, lo, hi, than = found[done:end].T
            row, of = _spread(start[k], count[k]), np.repeat(np.arange(len(k)), count[k])
            more = ids[row] > than[of]
            row, of = row[more], of[more]
            lo, hi, n, by = places[row] + lo[of], places[row] + hi[of], times[row].astype(np.int64), step[row].astype(np.int64)
            whole = hi - lo >= by  # one after another without a gap
            hi[whole] += ((n - 1) * by)[whole]
            n[whole] = 1
            each, turn = np.repeat(np.arange(len(row)), n), _spread(np.zeros(len(row), np.int64), n)
            if len(each):
                tables.append(_united(ids[row[each]], marks[row[each]], lo[each] + turn * by[each], hi[each] + turn * by[each]))
            done = end
    return pa.concat_tables(tables)


def _united(ids: np.ndarray, marks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """A row for each document, runs that touch as one."""
    by = np.lexsort((hi, lo, marks, ids))
    ids, marks, lo, hi = ids[by], marks[by], lo[by], hi[by]
    other = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    # ends only grow within a document, so a shift by document keeps them apart
    shift = np.cumsum(other) * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift)
    new = np.concatenate([[True], (lo + shift)[1:] > reach[:-1]])
    ends = (reach - shift)[np.concatenate([new[1:], [True]])]
    cuts = np.flatnonzero(other[new])[1:]
    edges = pa.array(np.concatenate([[0], cuts, [int(new.sum())]]).astype(np.int32))
    runs = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (lo[new], ends)]
    return pa.table([ids[other], marks[other], *runs], schema=RANGES)


def _parts(anchor: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows in parts of about ``most``, with all rows of an anchor in one part."""
    by = np.argsort(anchor, kind="stable")
    edges = np.nonzero(np.diff(anchor[by]))[0] + 1
    start = 0
    while start < len(by):
        stop = len(by) if start + most >= len(by) else int(edges[min(np.searchsorted(edges, start + most), len(edges) - 1)]) if len(edges) else len(by)
        stop = stop if stop > start else len(by)
        yield by[start:stop]
        start = stop


def _settle(anchor, low, high, often, offs, begins, size, raw, least, number) -> np.ndarray:  # noqa: ANN001
    """(row's number, lo, hi, than): what to remove where the id is larger than ``than``, for rows that hold all segments of their anchors."""
    body = np.frombuffer(raw, np.uint8)
    width = int((size - offs).max())
    right = _agree(anchor, _rows(body, begins + offs, size - offs, width, False))
    left = _agree(anchor, _rows(body, begins, offs, max(1, int(offs.max())), True))
    right, left = np.where(often > 1, size - offs, right), np.where(often > 1, offs, left)  # with its own other occurrences
    a, b = begins + offs - left, begins + offs + right
    rows = np.nonzero(b - a >= least)[0]
    trimmed: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    for r, g, x, y in zip(rows.tolist(), anchor[rows].tolist(), a[rows].tolist(), b[rows].tolist(), strict=True):
        trimmed[g].setdefault(raw[x:y], []).append(r)
    found: list[tuple[int, int, int, int]] = []
    delta = (a - begins).tolist()
    low_of, high_of = low.tolist(), high.tolist()
    waiting: list[tuple[bytes, list[int]]] = []
    held = 0

    def emit(r: int, lo: int, hi: int, than: int) -> None:
        if high_of[r] > than:
            found.append((r, delta[r] + lo, delta[r] + hi, than))

    def sort_waiting() -> None:
        nonlocal held
        for (_, them), least_ids in zip(waiting, _classes([w for w, _ in waiting], [min(low_of[r] for r in t) for _, t in waiting], least), strict=True):
            for r in them:
                lo = 0
                if low_of[r] < high_of[r]:  # not the same for all occurrences
                    for k in range(1, len(least_ids) + 1):
                        if k == len(least_ids) or least_ids[k] != least_ids[lo]:
                            emit(r, lo, k, least_ids[lo])
                            lo = k
                    continue
                mine, lo = low_of[r], None
                for k, least_id in enumerate(least_ids):
                    if mine > least_id:
                        lo = k if lo is None else lo
                    elif lo is not None:
                        emit(r, lo, k, mine - 1)
                        lo = None
                if lo is not None:
                    emit(r, lo, len(least_ids), mine - 1)
        waiting.clear()
        held = 0

    for variants in trimmed.values():
        # what lies whole in a variant of a smaller id goes whole, and tells the others nothing
        apart: list[tuple[int, bytes, list[int]]] = []
        for least_id, text, them in sorted((min(map(low_of.__getitem__, them)), text, them) for text, them in variants.items()):
            if any(least_id > i and text in other for i, other, _ in apart[:NEAR]):
                for r in them:
                    emit(r, 0, len(text) - least + 1, least_id - 1)
            else:
                apart.append((least_id, text, them))
        if len(apart) == 1:
            ((least_id, text, them),) = apart
            for r in them:
                emit(r, 0, len(text) - least + 1, least_id)
            continue
        if len(apart) == 2:
            (least_id, text, them), (own_least, other, those) = apart  # of the smaller id, of the larger
            p, q = int(left[them[0]]), int(left[those[0]])  # the anchor's places
            back, on = _trailing(text[:p], other[:q]), _leading(text[p:], other[q:])
            for r in them:
                emit(r, 0, len(text) - least + 1, least_id)
            for r in those:
                emit(r, 0, len(other) - least + 1, own_least)
                if low_of[r] == own_least and back + on >= least:
                    emit(r, q - back, q + on - least + 1, least_id)
            continue
        for _, text, them in apart:
            waiting.append((text, them))
            held += len(text) + 1
        if held >= SORTED:
            sort_waiting()
    if waiting:
        sort_waiting()
    got = np.array(found, np.int64).reshape(-1, 4)
    got[:, 0] = number[got[:, 0]]
    return got


def _classes(texts: list[bytes], ids: list[int], least: int) -> list[list[int]]:
    """For each text and each start of ``least`` bytes in it, the smallest of ``ids`` among texts that hold those bytes."""
    joined = b"\0".join(texts) + b"\0"
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    # places where ``least`` bytes of a text begin
    counts = sizes - least + 1
    first = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(first - begins, counts)
    here = np.zeros(len(joined) + 1, bool)
    here[place] = True
    order = np.array(suffix_array(joined), np.int64)
    order = order[here[order]]
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), least)[order]
    new = np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)])
    smallest = np.zeros(len(joined), np.int64)
    smallest[place] = np.repeat(np.array(ids, np.int64), counts)
    smallest[order] = np.minimum.reduceat(smallest[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return [x.tolist() for x in np.split(smallest[place], first[1:])]


def _cut(text: bytes, lo: np.ndarray, hi: np.ndarray, least: int) -> tuple[int, int, bytes]:
    """Bytes and maximal runs removed, and what is left, from runs of starts of strings."""
    by = np.argsort(lo, kind="stable")
    a, b = lo[by].astype(np.int64), np.maximum.accumulate(hi[by].astype(np.int64) + (least - 1))
    new = np.concatenate([[True], a[1:] > b[:-1]])
    begins = a[new].tolist()
    ends = b[np.concatenate([new[1:], [True]])].tolist()
    parts, at = [], 0
    for x, y in zip(begins, ends, strict=True):
        parts.append(text[at:x])
        at = y
    parts.append(text[at:])
    return sum(ends) - sum(begins), len(begins), b"".join(parts)


def removed(docs: DataFrame, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, with ``with_text``)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    keyed = rows.withColumn("doc_id", F.coalesce("own_id", F.lit(LAST)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = keyed.groupBy("doc_id").agg((F.min("text_hash") != F.max("text_hash")).alias("twice"))
    if ids.where("twice").isEmpty():
        keyed = keyed.withColumn("text_hash", F.lit(0).cast("long"))  # ids tell all texts apart: no hash need travel
    bins = max(BINS, -(-total // BIN_BYTES))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [b for batch in batches for b in batch.column("blob").to_pylist()]  # a partition is a bin
        if blobs:
            found = _ranges(blobs, least, GRAM)
            del blobs
            give_back()
            yield from found.to_batches()

    binned = _binned(keyed.select("doc_id", "text_hash", "text").where(F.octet_length("text") >= least), bins, least)
    ranges = binned.repartitionById(bins, F.col("bin").cast("int")).select("blob").mapInArrow(settle, "doc_id long, text_hash long, lo array<int>, hi array<int>")
    listed = ranges.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    joined = _packed(keyed).join(listed, ["doc_id", "text_hash"], "left").select("own_id", "packed", "lo", "hi")
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in parts(batches, "packed"):
            out = []
            for packed, lo, hi in zip(batch.column("packed").to_pylist(), batch.column("lo"), batch.column("hi"), strict=True):
                text = unpack(packed) if packed else b""
                gone, spans, left = _cut(text, lo.values.to_numpy(), hi.values.to_numpy(), least) if lo.is_valid else (0, 0, text)
                out.append((len(text), gone, spans, hashlib.sha256(left).hexdigest(), left)[: 5 if with_text else 4])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)] if out else [pa.array([], t) for t in types[: 5 if with_text else 4]]
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), *cols], [k.split()[0] for k in kinds.split(", ")])

    return joined.mapInArrow(run, kinds)


def _packed(keyed: DataFrame) -> DataFrame:
    """``keyed`` with each text's bytes compressed (nothing for the empty text), as they travel to their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in parts(batches):
            packed = pa.array([pack(t) if t else b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("own_id"), batch.column("doc_id"), batch.column("text_hash"), packed], ["own_id", "doc_id", "text_hash", "packed"])

    return keyed.select("own_id", "doc_id", "text_hash", "text").mapInArrow(run, "own_id long, doc_id long, text_hash long, packed binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with what is removed from it."""
    return removed(documents(spark, sf_dir))


def oracle_sql(least: int = LEAST) -> str:
    """Every string of ``least`` bytes, as hexadecimal text, with the smallest id that it starts in; no suffix order."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT r, k, p, h[2 * p + 1:2 * p + {2 * least}] AS s FROM (SELECT r, k, h, unnest(range(n - {least - 1})) AS p FROM texts WHERE n >= {least})),
firsts AS (SELECT s, min(k) AS least FROM strings GROUP BY s HAVING min(k) < max(k)),
gone AS (SELECT r, p FROM strings JOIN firsts USING (s) WHERE k > least),
starts AS (SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + {least} THEN 1 ELSE 0 END AS new FROM gone),
numbered AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM starts),
runs AS (SELECT r, min(p) AS a, max(p) + {least} AS b FROM numbered GROUP BY r, run),
-- what stands before each run, and behind the last
kept AS (SELECT r, a, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS after, a AS until, b FROM runs),
pieces AS (SELECT k.r, string_agg(h[2 * after + 1:2 * until], '' ORDER BY a) AS head, max(b) AS last, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM kept k JOIN texts t ON t.r = k.r GROUP BY k.r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || h[2 * last + 1:], h))) AS kept_sha256
FROM texts t LEFT JOIN pieces p ON p.r = t.r
"""
