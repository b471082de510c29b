"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A piece's cost is its negative score in the model, in whole units (thousandths where scores aren't whole numbers), so sums
are exact and the same everywhere. A character that no piece of one character covers costs ``UNKNOWN`` more than the
dearest piece and gives its UTF-8 bytes as byte pieces, as unigram models of this format do. A forward Viterbi pass gives
the least cost from the start to each place; a backward A* search from the end, with these as exact heuristics, then
meets the segmentations of a span in order of cost. Every open path is known to be completed at its estimate, and no two
of them complete alike, so an agenda of N paths is enough; of equal estimates the one nearest the start goes first. So
neither ties nor long spans widen the search: it takes time and memory in proportion to the span, times N.

Pieces hold a space only in front or hold nothing else, and none holds a line feed (checked on loading). So a lattice
falls apart at each start of a run of spaces and around each line feed; spans between are searched on their own and
remembered by the worker, and the N best of a text are merged from those of its spans: only the N - 1 spans with the
smallest loss of their second best can be altered in them. Spans up to ``LONG`` characters pass forward many at once, by
a double-array trie of the pieces; longer ones alone.

As usual for this format a space is put in front of a text that isn't empty, and taken off by decoding; decoding gives
back every text byte for byte.

Defined results for odd input: null and empty texts have no pieces and one segmentation of cost 0; ties of cost keep the
order of the search, which depends on the span alone; equal texts give equal values; an empty table gives an empty table;
only the id and text columns are read. A vocabulary that lacks one of the 256 byte pieces raises ValueError.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, parts, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Spans that a worker remembers before it begins anew: what a worker holds, its executor holds once for each core.
REMEMBERED = 100_000
#: What a character without a piece costs beyond the dearest piece, in units of the model's scores.
UNKNOWN = 10
#: More than any cost.
NEVER = 1 << 60
#: Longer spans pass forward alone; spans that pass together; bytes of texts that are encoded together, ids that are decoded.
LONG, BLOCK, TOGETHER = 40, 1 << 13, 1 << 20


def piece_bytes(model) -> list[bytes]:  # noqa: ANN001
    """What each id of a SentencePiece model stands for; nothing for control pieces."""
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        raw = bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        out.append(b"" if model.is_control(i) or model.is_unknown(i) else raw)
    return out


class Trie:
    """The pieces as a double array: the child of ``node`` by letter number c is base[node] + c, if owner[there] is ``node``.

    Letters that no piece has, and the end of a span, have number 0, which leads nowhere. Bases may be below 0: there the
    arrays end in places without an owner.
    """

    def __init__(self, pieces: dict[str, tuple[int, int]]):
        counts: dict[str, int] = {}
        for c in chain.from_iterable(pieces):
            counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        number = {c: k for k, c in enumerate(letters, 1)}
        self.number = np.zeros(0x110000, np.int32)
        self.number[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[tuple[int, int]] = [(NEVER, -1)]
        for text, (i, cost) in pieces.items():
            node = 0
            for c in text:
                node = children[node].setdefault(number[c], len(children))
                if node == len(children):
                    children.append({})
                    ends.append((NEVER, -1))
            ends[node] = cost, i
        # widest nodes first: each takes the first place where all its children find room; only children fill what is left
        room = 2 * (len(children) + len(letters) + 1)
        free, slot, base, low = np.ones(room - len(letters), bool), [0] * len(children), [0] * len(children), 1
        free[0] = False
        for node in sorted((n for n, kids in enumerate(children) if len(kids) > 1), key=lambda n: -len(children[n])):
            keys = np.array(sorted(children[node]), np.int64)
            keys -= (least := int(keys[0]))
            while not free[low]:
                low += 1
            at, open_ = low, keys[:0]
            while not len(open_):
                open_ = np.flatnonzero(free[at : at + 1024]) + at
                for k in keys.tolist():
                    open_ = open_[free[open_ + k]]
                at += 1024
            base[node] = int(open_[0]) - least
            free[open_[0] + keys] = False
        places = iter(np.flatnonzero(free).tolist())
        for node, kids in enumerate(children):
            if len(kids) == 1:
                base[node] = next(places) - next(iter(kids))
            for k, child in kids.items():
                slot[child] = base[node] + k
        self.base, self.owner = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.cost, self.id = np.full(room, NEVER, np.int64), np.full(room, -1, np.int32)
        for node, kids in enumerate(children):
            here = slot[node]
            self.base[here], (self.cost[here], self.id[here]) = base[node], ends[node]
            for k in kids.values():
                self.owner[slot[k]] = here


class Vocabulary:
    """Pieces with spaces as spaces, their ids and costs; the bytes of each id."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = piece_bytes(model)
        byte_ids: dict[int, int] = {}
        scores = {i: model.get_score(i) for i, raw in enumerate(self.bytes) if raw and not model.is_byte(i)}
        scale = 1 if all(s == int(s) for s in scores.values()) else 1000
        self.pieces: dict[str, tuple[int, int]] = {}
        for i, raw in enumerate(self.bytes):
            if model.is_byte(i):
                byte_ids[raw[0]] = i
            elif raw:
                self.pieces.setdefault(raw.decode(), (i, round(-scale * scores[i])))
        if len(byte_ids) < 256:
            raise ValueError("the vocabulary has no piece for some byte")
        if any("\n" in p or (" " in p.lstrip(" ")) for p in self.pieces):
            raise ValueError("a piece holds a line feed, or a space behind another character")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.unknown = max(c for _, c in self.pieces.values()) + UNKNOWN * scale
        self.longest = max(map(len, self.pieces))
        self.trie: Trie | None = None
        self.begun = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}

    def _bytes_of(self, char: str) -> tuple[int, ...]:
        return tuple([self.byte_ids[x] for x in char.encode("utf-8", "surrogatepass")])

    def forward(self, text: str) -> array:
        """For each place the least cost from the start to it (Viterbi)."""
        n, pieces, begun = len(text), self.pieces, self.begun
        least = array("q", [0]) + array("q", [NEVER]) * n
        for start in range(n):
            a, end = least[start], start + 1
            found = pieces.get(text[start:end])
            c = a + (found[1] if found else self.unknown)
            if c < least[end]:
                least[end] = c
            while end <= n and text[start:end] in begun:
                if end > start + 1 and (found := pieces.get(text[start:end])) and a + found[1] < least[end]:
                    least[end] = a + found[1]
                end += 1
        return least

    def into(self, text: str, end: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """Edges (start, cost, ids) of the lattice into a place."""
        for start in range(max(0, end - self.longest), end):
            if found := self.pieces.get(text[start:end]):
                yield start, found[1], (found[0],)
            elif start == end - 1:
                yield start, self.unknown, self._bytes_of(text[start])

    def n_best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """(cost, ids) of up to n segmentations of a span, by cost: A* backward from the end, guided by the forward scores."""
        least, out = self.forward(text), []
        # (estimate, place, cost from it to the end, path)
        agenda: list[tuple[int, int, int, tuple | None]] = [(least[-1], len(text), 0, None)]
        while agenda and len(out) < n:
            total, at, behind, path = agenda.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((total, tuple(ids)))
                continue
            for start, cost, ids_in in self.into(text, at):
                agenda.append((least[start] + behind + cost, start, behind + cost, (ids_in, path)))
            agenda.sort(key=_first)
            del agenda[n - len(out) :]
        return out

    def forward_all(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of spans of one character or more: the ids of the best segmentations, joined; how many each has; the best's cost, the second best's."""
        trie = self.trie = self.trie or Trie(self.pieces)
        sizes = np.array(list(map(len, spans)), np.int64)
        by = np.argsort(-sizes, kind="stable")  # longest first: who still has a character at a place is a slice
        own, k, n = sizes[by], len(spans), int(sizes.max())
        text = np.frombuffer("".join([spans[i] for i in by.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.zeros((n + 1, k), np.int32)
        rows = np.repeat(np.arange(k), own)
        places = np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
        letters[places, rows] = trie.number[text]
        first, second = np.full((n + 1, k), NEVER), np.full((n + 1, k), NEVER)
        back, piece = np.zeros((n + 1, k), np.int16), np.full((n + 1, k), -1, np.int32)
        first[0] = 0
        alive = np.searchsorted(-own, -np.arange(n), "left")  # spans longer than each place
        for start in range(n):
            m = int(alive[start])
            who, node = np.arange(m), np.zeros(m, np.int64)
            for end in range(start + 1, n + 1):
                step = trie.base[node] + letters[end - 1, who]
                on = trie.owner[step] == node
                if end == start + 1:
                    lone = np.flatnonzero(~on | (trie.cost[step] == NEVER))
                    if len(lone):  # no piece of one character: its bytes
                        self._reach(first, second, back, piece, start, end, lone, np.full(len(lone), self.unknown), -1)
                who, node = who[on], step[on]
                if not len(who):
                    break
                cost = trie.cost[node]
                whole = np.flatnonzero(cost < NEVER)
                if len(whole):
                    self._reach(first, second, back, piece, start, end, who[whole], cost[whole], trie.id[node[whole]])
        # back along the best paths, all spans at once
        steps, live, at = [], np.arange(k), own.copy()
        while len(live):
            end = at[live]
            steps.append((live, piece[end, live], end))
            at[live] = back[end, live]
            live = live[at[live] > 0]
        count = np.zeros(k, np.int64)
        for live, _, _ in steps:
            count[live] += 1
        begins, ids, ends = np.cumsum(count) - count, np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        for t, (live, p, end) in enumerate(steps):
            where = begins[live] + count[live] - 1 - t
            ids[where], ends[where] = p, end
        costs, others = first[own, np.arange(k)], second[own, np.arange(k)]
        if len(lone := np.flatnonzero(ids < 0)):
            char = np.repeat(np.cumsum(own) - own, count)[lone] + ends[lone] - 1
            raw = [self._bytes_of(chr(c)) for c in text[char].tolist()]
            width = np.ones(len(ids), np.int64)
            width[lone] = list(map(len, raw))
            to = np.cumsum(width) - width
            count = np.add.reduceat(width, begins)
            wide = np.empty(int(width.sum()), np.int64)
            wide[to] = ids
            wide[np.concatenate([np.arange(a, a + len(r)) for a, r in zip(to[lone].tolist(), raw, strict=True)])] = list(chain.from_iterable(raw))
            ids, begins = wide, np.cumsum(count) - count
        # in the order given
        back_to = np.empty(k, np.int64)
        back_to[by] = np.arange(k)
        return _gathered(ids.astype(np.int32), begins[back_to], count[back_to]), count[back_to], costs[back_to], others[back_to]

    @staticmethod
    def _reach(first, second, back, piece, start, end, who, cost, name) -> None:  # noqa: ANN001
        """Takes an edge from ``start`` to ``end`` for the spans ``who``."""
        new, other = first[start, who] + cost, second[start, who] + cost
        held = first[end, who]
        better = new < held
        second[end, who] = np.minimum(np.minimum(np.maximum(held, new), second[end, who]), other)
        moved = who[better]
        first[end, moved], back[end, moved] = new[better], start
        piece[end, moved] = name[better] if isinstance(name, np.ndarray) else name


def _first(open_: tuple) -> tuple[int, int]:
    return open_[:2]


def _gathered(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[begin : begin + size], joined."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)]


class _Spans(dict):
    """name of a span -> its number. Arrays hold the ids of each number's best segmentation, its cost, and the loss of the second best.

    Names spare cutting texts by a pattern: a span of one space and a word is named by the word, "" is one space, and a
    word without a space is named by "\0" and the word; what these would confuse, by a line feed and the span.
    """

    def __init__(self, vocabulary: Vocabulary, n: int):
        super().__init__()
        self.vocabulary, self.n = vocabulary, n
        self.cut = re.compile(r" +[^ \n]*|[^ \n]+|\n").findall
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.others: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.new: list[str] = []
        self.names: list[str] = []
        self.ids, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.costs, self.losses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, name: str) -> int:
        self.new.append(name)
        n = self[name] = len(self)
        return n

    def names_of(self, text: str) -> list[str]:
        """The names of a text's spans."""
        if not text:
            return []
        if text[0] == " " or "  " in text or "\0" in text:
            return [x if x == "\n" else "\0" + x if x[0] != " " else x[1:] if x[1:2] not in (" ", "\0") else "\n" + x for x in self.cut(" " + text)]
        return text.replace("\n", " \n \0").split(" ")

    @staticmethod
    def span_of(name: str) -> str:
        return name if name == "\n" else name[1:] if name[:1] in ("\0", "\n") else " " + name

    def numbers(self, names: Iterable[str]) -> np.ndarray:
        """The numbers of spans; new ones are searched and remembered."""
        found = np.fromiter(map(self.__getitem__, names), np.int64)
        if self.new:
            self._learn(list(map(self.span_of, self.new)))
        return found

    def _learn(self, new: list[str]) -> None:
        self.names += self.new
        self.new = []
        sizes, costs, others = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.full(len(new), NEVER)
        parts: list[np.ndarray] = []
        which: list[np.ndarray] = []
        lengths = np.array(list(map(len, new)))
        short = np.flatnonzero((lengths > 0) & (lengths <= LONG))
        for i in range(0, len(short), BLOCK):
            at = short[i : i + BLOCK]
            ids, sizes[at], costs[at], others[at] = self.vocabulary.forward_all([new[j] for j in at.tolist()])
            parts.append(ids)
            which.append(at)
        for j in np.flatnonzero(lengths > LONG).tolist():
            best = self.vocabulary.n_best(new[j], max(2, self.n))
            parts.append(np.array(best[0][1], np.int32))
            which.append(np.array([j]))
            sizes[j], costs[j] = len(best[0][1]), best[0][0]
            if len(best) > 1:
                others[j] = best[1][0]
            self.others[len(self.begins) + j] = best[1 : self.n]
        order = np.concatenate([*which, np.zeros(0, np.int64)]).astype(np.int64)
        begins = np.zeros(len(new), np.int64)
        begins[order] = np.cumsum(sizes[order]) - sizes[order]
        self.begins = np.concatenate([self.begins, begins + len(self.ids)])
        self.ids = np.concatenate([self.ids, *parts])
        self.sizes, self.costs = np.concatenate([self.sizes, sizes]), np.concatenate([self.costs, costs])
        self.losses = np.concatenate([self.losses, np.where(others < NEVER, others - costs, NEVER)])

    def after(self, number: int) -> list[tuple[int, tuple[int, ...]]]:
        """The segmentations of a span behind its best, up to the n-th."""
        found = self.others.get(number)
        if found is None:
            found = self.others[number] = self.vocabulary.n_best(self.span_of(self.names[number]), self.n)[1:]
        return found


_held: dict[tuple[str, int], _Spans] = {}


def _spans(path: str, n: int) -> _Spans:
    held = _held.get((path, n))
    if held is None:
        held = _held[path, n] = _Spans(Vocabulary(path), n)
        gc.freeze()  # what is remembered holds no cycles: collections over it would only take time
        gc.set_threshold(200_000, 50, 100)
    elif len(held) > REMEMBERED:
        held.forget()
    return held


Edit = tuple[int, int, tuple[int, ...]]


def _edit(old: np.ndarray, new: tuple[int, ...], at: int) -> Edit:
    """What turns a span's best ids, which begin at ``at``, into others: without what both begin and end with."""
    kept, a, b = old.tolist(), 0, 0
    while a < min(len(kept), len(new)) and kept[a] == new[a]:
        a += 1
    while b < min(len(kept), len(new)) - a and kept[-1 - b] == new[-1 - b]:
        b += 1
    return at + a, len(kept) - a - b, new[a : len(new) - b]


def encode_texts(texts: list[str], model: str, n_best: int) -> list[tuple[np.ndarray, list[tuple[int, list[Edit]]]]]:
    """For each text the ids of the best segmentation, and for each of the N best (cost, edits): an edit is (at, dropped, ids) of the best's ids."""
    spans = _spans(model, n_best)
    names = [spans.names_of(x) for x in texts]
    counts = np.array(list(map(len, names)), np.int64)
    numbers = spans.numbers(chain.from_iterable(names))
    sizes, ends = spans.sizes[numbers], np.cumsum(counts)
    ids = _gathered(spans.ids, spans.begins[numbers], sizes)
    at = np.concatenate([[0], np.cumsum(sizes)])
    costs = np.concatenate([[0], np.cumsum(spans.costs[numbers])])
    losses = spans.losses[numbers]
    out = []
    for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        cost, start = int(costs[j] - costs[i]), int(at[i])
        top: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
        if n_best > 1 and j > i:
            loss = losses[i:j]
            few = np.argsort(loss, kind="stable")[: n_best - 1] if j - i < 64 else np.sort(np.argpartition(loss, n_best - 2)[: n_best - 1])
            for k in (few + i).tolist():
                if losses[k] < NEVER:
                    best, more = int(spans.costs[numbers[k]]), spans.after(int(numbers[k]))
                    ways = [(c + a - best, (*moved, (k, w))) for c, moved in top for w, (a, _) in enumerate(more)]
                    top = sorted(top + ways, key=lambda w: w[0])[:n_best]
        best_of = [(cost + c, [_edit(ids[at[k] : at[k + 1]], spans.after(int(numbers[k]))[w][1], int(at[k]) - start) for k, w in sorted(moved)]) for c, moved in top]
        out.append((ids[start : int(at[j])], best_of))
    return out


def _parts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows (from, to) of about ``most`` in size."""
    start = held = i = 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= most:
            yield start, i
            start, held = i, 0
    if i > start:
        yield start, i


ENCODED = "doc_id long, ids array<int>, segmentations array<struct<cost: long, edits: array<struct<at: int, dropped: int, ids: array<int>>>>>"


def _lists(sizes: Iterable[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(list(sizes), np.int64))]).astype(np.int32)), values)


def _encoded(ids: pa.Array, texts: list[str], model: str, n_best: int) -> pa.RecordBatch:
    done = encode_texts(texts, model, n_best)
    ways = list(chain.from_iterable([best for _, best in done]))
    edits = list(chain.from_iterable([e for _, e in ways]))
    new = _lists([len(e[2]) for e in edits], pa.array(list(chain.from_iterable([e[2] for e in edits])), pa.int32()))
    edit = pa.StructArray.from_arrays([pa.array([e[0] for e in edits], pa.int32()), pa.array([e[1] for e in edits], pa.int32()), new], ["at", "dropped", "ids"])
    way = pa.StructArray.from_arrays([pa.array([c for c, _ in ways], pa.int64()), _lists([len(e) for _, e in ways], edit)], ["cost", "edits"])
    best = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int32)
    cols = [ids, _lists([len(x) for x, _ in done], pa.array(best, pa.int32())), _lists([len(b) for _, b in done], way)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "segmentations"])


def encode(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL, check: bool = False) -> DataFrame:
    """doc_id, ids of the best segmentation, and the N best as costs and edits of it. ``model`` is a path that executors can open.

    With ``check`` also text_sha256, of the text that the ids decode to, in the same pass. What a task remembers of spans it
    forgets at its end: workers stay, and serve other stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, most=TOGETHER):
            out = _encoded(batch.column("doc_id"), batch.column("text").to_pylist(), model, n_best)
            if check:
                digests = [hashlib.sha256(_text_of(x.values.to_numpy(), model).encode()).hexdigest() for x in out.column("ids")]
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(digests, pa.string())], [*out.schema.names, "text_sha256"])
            yield out
        if (model, n_best) in _held:
            _held[model, n_best].forget()
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, ENCODED + ", text_sha256 string" * check)


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """The text of ids: their bytes joined, without the space in front. Bytes that are not UTF-8 become U+FFFD."""
    raw = b"".join([table[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _decoder(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces joined, where each id's begin, and how many they are."""
    if path not in _decoders:
        import sentencepiece

        names = piece_bytes(sentencepiece.SentencePieceProcessor(model_file=path))
        sizes = np.array([len(x) for x in names], np.int64)
        _decoders[path] = np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes
    return _decoders[path]


_decoders: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _text_of(which: np.ndarray, model: str) -> str:
    """The text of an array of ids, without the space in front."""
    data, begins, sizes = _decoder(model)
    size = sizes[which]
    ends = np.cumsum(size)
    raw = data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[which] - (ends - size), size)].tobytes()
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with text, decoded from the column ids; a null list decodes to null. Other columns pass through."""
    names = [c for c in encoded.columns if c != "text"]
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in _parts([len(x) if x.is_valid else 0 for x in batch.column(at)], TOGETHER):
                part = batch.slice(i, j - i)
                texts = [_text_of(ids.values.to_numpy(), model) if ids.is_valid else None for ids in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "text"])

    schema = encoded.select(*names).withColumn("text", F.lit("")).schema
    return encoded.select(*names).mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded, with its N best costs, and decoded again."""
    out = decode(encode(documents(spark, sf_dir)))
    costs = F.transform("segmentations", lambda s: s["cost"].cast("string"))
    edited = F.transform("segmentations", lambda s: F.concat_ws(";", F.transform(s["edits"], lambda e: F.concat(e["at"].cast("string"), F.lit("-"), e["dropped"].cast("string"), F.lit("+"), F.concat_ws(".", F.transform(e["ids"], lambda i: i.cast("string")))))))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        F.array_join(costs, ",").alias("costs"),
        F.array_join(edited, "|").alias("edits"),
        F.sha2("text", 256).alias("text_sha256"),
    )
