"""What goes through the driver, and what joins make of large groups."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodos.llm import near_copies, quality, suffix_dedup


def _plans(spark, run):
    """(operator, its text, {metric: value}) of each operator that ``run`` runs."""
    held = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [held.executionsList().apply(i).executionId() for i in range(held.executionsList().size())]
    before = set(listed())
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out = []
    for k in sorted(set(listed()) - before):
        values, nodes = held.executionMetrics(k), held.planGraph(k).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            found = {m.name(): values.get(m.accumulatorId()) for m in metrics}
            out.append((node.name(), node.desc(), {m: v.get() for m, v in found.items() if v.isDefined()}))
    return out


def test_third_stage_sends_no_table_through_the_driver(spark):
    """Entries are 24 to a node and look-ups 216, sized as their nodes: none of them is broadcast, and no join lists a group's look-ups."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(2):
        base = [word() for _ in range(104)]
        for _ in range(200):  # edited copies: some within reach of the text that they were made from, some not
            other = list(base)
            for k in rng.sample(range(2, 100, 10), rng.randint(1, 5)):
                other[k] = word()
            texts.append(" ".join(other))
    texts += [" ".join(word() for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes, kept = len(set(texts)), []
    plans = _plans(spark, lambda: kept.extend(near_copies.one_of_each(docs).collect()))
    joins = [(desc, int(m["number of output rows"].replace(",", ""))) for name, desc, m in plans if "Join" in name and "number of output rows" in m]
    assert joins and not [p for p in plans if "BroadcastExchange" in p[0]]
    assert max(n for desc, n in joins if "[fp#" in desc) <= 24 * nodes
    sets = [near_copies.shingles(t.encode()) for t in texts]
    up = list(range(len(texts)))
    for i in range(400):
        for j in range(i // 200 * 200, i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if up[i] != up[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((up[i], up[j]))
                up = [x if v == y else v for v in up]
    assert {r["doc_id"] for r in kept} == set(up)


@pytest.mark.parametrize("most", [500_000, 0])
def test_a_crowd_meets_across_pivots(spark, monkeypatch, most):
    """A crowd's look-ups are not listed again once pivots are known, and links across pivots are found, by equal segments and in balls."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts, base = [], [word() for _ in range(104)]
    for v in range(4):  # variants five edits apart, and edited copies of each
        for _ in range(60):
            other = list(base)
            for k in rng.sample(range(2, 100, 8), rng.randint(1, 3)):
                other[k] = word()
            texts.append(" ".join(other))
        for k in range(5):
            base[10 * k + v] = word()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    meet, across, kept = near_copies._meet, [], []

    def seen(stored, looks, key, *rest):
        found = meet(stored, looks, key, *rest)
        if key == "key":
            found = near_copies.written(found, "across")
            across.append(found.count())
        return found

    monkeypatch.setattr(near_copies, "_meet", seen)
    monkeypatch.setattr(near_copies, "CROWD", most, raising=False)
    plans = _plans(spark, lambda: kept.extend(near_copies.one_of_each(docs).collect()))
    made = [int(m["number of output rows"].replace(",", "")) for name, desc, m in plans if name == "Generate" and "root" in desc and "number of output rows" in m]
    assert across and across[0] > 0
    assert not most or made and max(made) <= 52 * len(set(texts))
    sets = [set(near_copies.shingles(t.encode()).tolist()) for t in texts]
    up = list(range(len(texts)))
    for i in up[:]:
        for j in range(i):
            if up[i] != up[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                x, y = sorted((up[i], up[j]))
                up = [x if v == y else v for v in up]
    assert {r["doc_id"] for r in kept} == set(up)


def test_shapes_are_found_once_for_an_outline(monkeypatch):
    """Words that differ in letters alone have one shape, found once; shapes are those of the plain pattern."""
    rng = random.Random(2)
    odd = [bytes(rng.choice(b"aZ5#-\xc3\x80\x9e\x9f\xc4\xff") for _ in range(rng.randint(1, 90))) for _ in range(3_000)]
    words = sorted({*odd, *(b"".join(rng.choice([b"a", b"k", b"z"]) for _ in range(12)) for _ in range(5_000))})
    plain, calls = quality._SHAPE, []

    class Counted:
        def finditer(self, word):
            calls.append(word)
            return plain.finditer(word)

    monkeypatch.setattr(quality, "_SHAPE", Counted())
    quality._forget()
    numbers = quality._numbered(words)
    want = [xxhash.xxh32_intdigest(b"".join([(b"", b"A", b"a", b"0", m.group())[m.lastindex] for m in plain.finditer(w)])) for w in words]
    assert [quality._words.shapes[i] for i in numbers] == want
    assert len(calls) <= len(set(odd)) + 1 < len(words)
    quality._forget()


def test_two_variants_need_no_suffix_order(spark, monkeypatch):
    """Passages that two texts share whole and a third in part, at odd places and lengths from 50 bytes, are settled around their anchors."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = []
    for k in range(60):
        passage = some(rng.randint(50, 160))
        cut = passage[rng.randint(0, 30) : len(passage) - rng.randint(0, 30)]
        texts += [some(rng.randint(0, 90)) + p + some(rng.randint(0, 90)) for p in (passage, passage, cut)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "0L as text_hash", "text").coalesce(2)
    blobs = [bytes(r["blob"]) for r in suffix_dedup._binned(docs, 1, 50).collect()]
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: 1 / 0)
    found = suffix_dedup._ranges(blobs, 50, 12).to_pylist()
    got = {(r["doc_id"], p) for r in found for a, b in zip(r["lo"], r["hi"], strict=True) for p in range(a, b)}
    first, want = {}, set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                want.add((i, p))
    assert got == want and len({i for i, _ in want}) > 40


class _Frame:
    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def _blobs(texts, bins):
    """The blobs of each bin, and the most that was held meanwhile, in blocks; ids count from 0."""
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array([0] * len(texts), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text_hash", "text"])
    out, most = _traced(lambda: list(suffix_dedup._binned(_Frame(), bins, 50)(iter([batch]))))
    out = [x for b in out for x in b.to_pylist()]
    return [[x["blob"] for x in out if x["bin"] == k] for k in range(bins)], most


def _traced(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / suffix_dedup.BLOCK
    finally:
        tracemalloc.stop()


def test_strings_are_binned_and_settled_in_little_memory():
    """What is worked out for each byte or segment is held for a part of a block only; still every string travels once, also of a text
    that is longer than a block, and repeated strings are found across parts."""
    rng = np.random.default_rng(3)
    some = lambda n: bytes(rng.integers(97, 123, n, np.uint8))
    texts = [some(n) for n in rng.integers(0, 6_000, 3_000).tolist()]
    texts += [some(suffix_dedup.BLOCK + 70_000), b"", some(49), some(50)]
    copied = [(texts[k % 3_000][-200:], texts[3_000][1_048_000 + 100 * k :][:1_000]) for k in range(4_000)]
    texts += [x + b"<%d>" % k + y for k, (x, y) in enumerate(copied)]
    bins, most = _blobs(texts, 3)
    assert most < 16  # blocks, the results among them; 44 if worked out for a block at once
    seen = [np.zeros(len(t), np.int64) for t in texts]
    for blobs in bins:
        strings, _, _, count, body, begins, who, _, places, times, step = suffix_dedup._unpack(blobs, 50)
        row, strings = np.repeat(np.arange(len(strings)), count), strings.tolist()
        for i, a, r, n, d in zip(who.tolist(), places.tolist(), row.tolist(), times.tolist(), step.tolist(), strict=True):
            for p in range(a, a + max(1, n * d), max(1, d)):
                seen[i][p : p + strings[r]] += 1
                assert body[begins[r] : begins[r] + strings[r] + 49] == texts[i][p : p + strings[r] + 49]
    assert all((x[: max(0, len(x) - 49)] == 1).all() and not x[max(0, len(x) - 49) :].any() for x in seen)
    gone = [np.zeros(len(t), bool) for t in texts]
    for blobs in bins:
        found, most = _traced(lambda: suffix_dedup._ranges(blobs, 50, 12))  # noqa: B023
        assert most < 11, most
        for r in found.to_pylist():
            for a, b in zip(r["lo"], r["hi"], strict=True):
                gone[r["doc_id"]][a:b] = True
    assert not any(x.any() for x in gone[:3_004])
    first = {}
    for i, t in enumerate(texts[3_004:], 3_004):
        x, y = copied[i - 3_004]
        want = {*range(len(x) - 49), *range(len(t) - len(y), len(t) - 49)}
        want |= {p for p in range(len(t) - 49) if first.setdefault(t[p : p + 50], i) < i}
        assert set(np.flatnonzero(gone[i]).tolist()) == want


def test_a_common_passage_travels_once_for_many_texts(monkeypatch):
    """An anchor that very many texts hold, also again and again at equal steps: equal segments are one, whatever their ids; also if their
    hashes say nothing, and in parts of few occurrences."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, turn, long = some(120), some(8), some(64)
    texts = []
    for k in range(400):
        other = [passage, passage[rng.randint(0, 40) :], turn * rng.randint(7, 60), long * rng.randint(1, 6), passage + some(3) + passage]
        texts.append((some(rng.randint(0, 60)) + other[k % 5] + some(rng.randint(0, 60))).encode())
    first, want = {}, set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 49):
            if first.setdefault(t[p : p + 50], i) < i:
                want.add((i, p))
    for spread, mixed in ((1 << 18, suffix_dedup._mixed), (50, suffix_dedup._mixed), (50, lambda h: h & np.uint64(3))):
        monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
        with monkeypatch.context() as m:
            m.setattr(suffix_dedup, "_mixed", mixed)
            ((blobs,), _) = _blobs(texts, 1)
        found = suffix_dedup._ranges(blobs, 50, 12).to_pylist()
        assert {(r["doc_id"], p) for r in found for a, b in zip(r["lo"], r["hi"], strict=True) for p in range(a, b)} == want
    monkeypatch.undo()
    repeats = [(turn * 4_000).encode()] * 200
    (many,), _ = _blobs(repeats, 1)
    found, most = _traced(lambda: suffix_dedup._ranges(many, 50, 12))
    gone = np.zeros((200, 32_000), bool)
    for r in found.to_pylist():
        for a, b in zip(r["lo"], r["hi"], strict=True):
            gone[r["doc_id"], a:b] = True
    assert not gone[0].any() and gone[1:, :-49].all() and not gone[:, -49:].any()
    assert sum(map(len, many)) < 2_000 and most < 0.5, (sum(map(len, many)), most)


def test_pairs_with_a_group_are_not_listed(spark, monkeypatch):
    """Groups of edited copies, most of them out of each other's reach: rows of the joins by node grow with the nodes, not with a group's
    pairs, whether a member is stored in the hot lists or meets them from outside; families are compared whole, also in parts."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts, base = [], [word() for _ in range(104)]
    for v in range(4):
        for _ in range(150):
            other = list(base)
            for k in rng.sample(range(2, 100, 5), rng.choice([1, 2, 3, 4, 5, 6, 7])):
                other[k] = word()
            texts.append(" ".join(other))
        for k in range(3):
            base[20 * k + 5 * v] = word()
    texts += [" ".join(word() for _ in range(60)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(near_copies.shingles(t.encode()).tolist()) for t in texts]
    up, linked = list(range(len(texts))), 0
    for i in up[:600]:
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                linked += 1
                if up[i] != up[j]:
                    x, y = sorted((up[i], up[j]))
                    up = [x if v == y else v for v in up]
    assert 10 < len(set(up[:600])) < 590
    for load in (1 << 21, 20_000):
        monkeypatch.setattr(near_copies, "LOAD", load, raising=False)
        kept = []
        plans = _plans(spark, lambda: kept.extend(near_copies.one_of_each(docs).collect()))  # noqa: B023
        joins = [(desc, int(m["number of output rows"].replace(",", ""))) for name, desc, m in plans if "Join" in name and "number of output rows" in m]
        assert {r["doc_id"] for r in kept} == set(up)
        listed = sum(n for desc, n in joins if "[a#" in desc.split(",")[0] and "[fp#" in desc)
        assert listed <= 2 * len(texts), (load, listed, linked)
        edges = [int(m["number of output rows"].replace(",", "")) for name, desc, m in plans if name == "MapInArrow" and "[a#" in desc and "number of output rows" in m]
        assert edges and max(edges) <= 52 * len(texts)


def test_a_forest_spans_what_is_near():
    """Forests of what is near and of what links have the components of all pairs, for few nodes and many."""
    rng = random.Random(6)
    for size in (2, 30, near_copies.SMALL, 300):
        base, texts = [str(rng.random()) for _ in range(rng.choice([9, 60, 150]))], []
        for _ in range(size):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = str(rng.random())
            texts.append(" ".join(other))
        sets = [near_copies.shingles(t.encode()) for t in texts]
        bits, n = np.array([near_copies.fingerprint(s) for s in sets]).view(np.uint64), np.array([len(s) for s in sets])
        for of in (None, np.concatenate(sets).view(np.int64)):
            near = [[bool(near_copies._may_link(bits[i], n[i], bits[j], n[j])) for j in range(size)] for i in range(size)]
            if of is not None:
                both = lambda i, j: len(np.intersect1d(sets[i], sets[j], True))
                near = [[near[i][j] and 9 * both(i, j) >= 4 * (n[i] + n[j]) for j in range(size)] for i in range(size)]
            want, got = list(range(size)), list(range(size))
            for up, edges in ((want, [(i, j) for i in range(size) for j in range(i) if near[i][j]]), (got, [(i, j) for i, some in near_copies._forest(n, bits, of) for j in some.tolist()])):
                for i, j in edges:
                    x, y = sorted((up[i], up[j]))
                    assert up is want or x != y and near[i][j]
                    up[:] = [x if v == y else v for v in up]
            assert got == want
