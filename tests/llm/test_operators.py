"""Each operator against a brute-force version on the odd table, and on the empty one."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodos.llm import line_dedup, mixing, pieces, quality, queries, secrets, sharding, simhash, suffix_dedup, telephony, training_order
from lodos.llm.components import components

from .conftest import odd_rows

ROWS = odd_rows()


def rows_of(df, *names):
    rows = df if isinstance(df, list) else df.collect()
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def sql_rows(sql, table_rows=ROWS):
    import pandas as pd

    con = duckdb.connect()
    pdf = pd.DataFrame(table_rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con.register("raw", pdf)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source, n_chars::BIGINT AS n_chars FROM raw")
    return con.sql(sql)


def same(df, sql):
    want = sql_rows(sql)
    names = sorted(want.columns)
    rows = df if isinstance(df, list) else df.collect()
    assert all(sorted(r.__fields__) == names for r in rows[:1])
    got = sorted((repr(tuple(r[n] for n in names)) for r in rows))
    assert got == sorted(repr(tuple(dict(zip(want.columns, r))[n] for n in names)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_empty_results(spark, empty_folder, name):
    assert queries.queries()[name](spark, empty_folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_row_has_a_result(results, name):
    out = results(name)
    if name != "op7_training_order":
        assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(results, name):
    same(results(name), queries.oracle_sql()[name])


# --- secrets


def spans_by_hand(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20),
            ("hex", r"[0-9a-f]+", 0, 24),
        ]
    ):
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[group]) >= least:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets_by_hand(results):
    got = rows_of(results("op1_secret_scan"), "doc_id", "base_sha256")
    assert got == sorted(((r[0], hashlib.sha256(spans_by_hand(r[1]).encode()).hexdigest()) for r in ROWS), key=repr)
    assert sum(bool(spans_by_hand(r[1])) for r in ROWS) == 2


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    key = "AKIA" + "B" * 16
    first = spark.createDataFrame([("a.py", f"x {key}"), ("b.py", "nothing")], "path string, text string")
    ledger.scan(first, "path", rules=secrets.BASE_RULES)
    assert ledger.seen().count() == 2 and ledger.found().count() == 1
    history = first.union(spark.createDataFrame([("c.py", f"x {key}"), ("a.py", "clean now"), ("a.py", None)], first.schema))
    ledger.scan(history, "path", rules=secrets.BASE_RULES)
    assert ledger.seen().count() == 4
    newer = (*secrets.BASE_RULES[:1], secrets.Rule("access", r"AKIA[A-Z]{4}", version=2))
    ledger.scan(history, "path", rules=newer)
    assert {r["rule"] for r in ledger.found().collect()} == {"access@1", "access@2"}
    where = {r["path"] for r in ledger.report(history, "path", rules=secrets.BASE_RULES).where("spans is not null").collect()}
    assert where == {"a.py", "c.py"}


# --- simhash


def fingerprint_by_hand(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, radius):
    up = {p: p for p in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {p: root(p) for p in prints}


def expected_components():
    prints = [fingerprint_by_hand(r[1]) for r in ROWS]
    roots = components_by_hand(set(prints), 4)
    least = {}
    for r, p in zip(ROWS, prints):
        if r[0] is not None:
            least[roots[p]] = min(least.get(roots[p], r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(roots[p])) for r, p in zip(ROWS, prints)), key=repr)


def test_simhash_by_hand(results):
    assert rows_of(results("op2_simhash_near_dedup"), "doc_id", "fingerprint", "component_id") == expected_components()


@pytest.mark.parametrize(("m", "hot"), [(2, 1024), (3, 1), (4, 2)])
def test_simhash_links_for_any_segments_and_hot_lists(spark, m, hot):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 12)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for s in seeds for _ in range(15)}
    prints = {p - (1 << 64) if p >= 1 << 63 else p for p in prints}
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes, len(prints), 4, m, hot)).collect()}
    unsigned = {p % (1 << 64): p for p in prints}
    want = components_by_hand(set(unsigned), 4)
    groups = defaultdict(set)
    for p, r in want.items():
        groups[r].add(unsigned[p])
    for members in groups.values():
        assert {found.get(p, p) for p in members} == {min(members)}


def test_one_of_each_keeps_one(spark, odd):
    kept = simhash.one_of_each(odd.withColumn("fp", F.lit(1)), words=4)
    assert kept.columns == [*odd.columns, "fp"]
    prints = [fingerprint_by_hand(r[1]) for r in ROWS]
    assert kept.count() == len(set(components_by_hand(set(prints), 4).values()))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


# --- line dedup


def test_line_dedup_on_small_windows(spark, odd):
    out = line_dedup.line_dedup(odd.withColumn("line", F.lit("x")), least_words=5, least_lines=2)
    assert out.columns == [*odd.columns, "line", "n_lines", "n_deleted"]
    same(out.drop("line"), line_dedup.oracle_sql("documents", "* EXCLUDE (ld_row)", 5, 2, extend=False))
    same(line_dedup.line_dedup(odd, 5, 2, extend=True), line_dedup.oracle_sql("documents", "* EXCLUDE (ld_row)", 5, 2))


def test_line_dedup_keeps_first_and_deletes_later_runs(spark):
    run = "a b\nc d\ne f"
    docs = spark.createDataFrame([(1, f"one\n{run}\ntwo"), (2, f"{run}"), (3, f"x\n{run}\n\ny"), (4, "a b\nc d")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: f"one\n{run}\ntwo", 2: "", 3: "x\n\ny", 4: "a b\nc d"}


# --- telephony audio


def ima_by_hand(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def test_audio_round_trip(results):
    for r, want in zip(
        rows_of(results("op4_telephony_audio"), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"),
        sorted(((r[0], len(t := (r[1] or "").encode()), len(p := t + b"\0" * (max(1, -(-len(t) // 64)) * 64 - len(t))), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in ROWS), key=repr),
        strict=True,
    ):
        assert r == want


@pytest.mark.parametrize("form", [telephony.MULAW, telephony.ALAW, telephony.IMA, telephony.PCM])
def test_formats_keep_samples_and_resample(spark, odd, form):
    media = telephony.store(odd, form)
    read = [(r["n_bytes"], telephony.read_wav(r["media"])) for r in media.collect()]
    assert all(f == form and len(d) % 64 == 0 and len(d) >= n for n, (f, _, d) in read)
    pcm = telephony.resampled(media, 16000).collect()
    assert len(pcm) == len(ROWS) and all(telephony.read_wav(r["media"])[:2] == (telephony.PCM, 16000) for r in pcm)
    some = media.withColumn("media", F.when(F.col("n_bytes") > 100, F.col("media")))
    both = telephony.resampled(some, 16000, "pcm").collect()
    assert len(both) == len(ROWS) and all((r["pcm"] is None) == (r["media"] is None) for r in both)


def test_adpcm_decodes_as_block_by_block():
    blocks = np.random.default_rng(3).integers(0, 256, (50, 64), dtype=np.uint8)
    assert telephony.ima_decode(blocks).tolist() == [ima_by_hand(bytes(b)) for b in blocks]
    assert telephony.TABLES[telephony.MULAW][[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES[telephony.ALAW][[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    with pytest.raises(ValueError):
        telephony.read_wav(b"not a wav file at all")


# --- pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def segmentations_by_hand(v, text):
    out = []

    def go(i, cost, ids):
        if i == len(text):
            out.append((cost, ids))
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in v.pieces:
                go(j, cost + v.pieces[text[i:j]][1], (*ids, v.pieces[text[i:j]][0]))
        if text[i] not in v.pieces:
            go(i + 1, cost + v.unknown, (*ids, *(v.byte_ids[b] for b in text[i].encode())))

    go(0, 0, ())
    return sorted(out)


def edited(ids, edits):
    out = ids.tolist()
    for at, dropped, new in reversed(edits):
        out[at : at + dropped] = new
    return tuple(out)


def some_texts():
    rng = random.Random(1)
    return ["the end", "a\nb  c", "é漢😀 x", "hello", " ", "▁the", "don't\n\n", "\0 \0", *("".join(rng.choice("abe th in\nx=.漢😀1\0é") for _ in range(rng.randint(1, 9))) for _ in range(200))]


def test_n_best_by_hand(vocabulary):
    for n in (1, 4):
        for text, (ids, found) in zip(some_texts(), pieces.encode_texts(some_texts(), pieces.MODEL, n), strict=True):
            want = segmentations_by_hand(vocabulary, " " + text)
            assert [c for c, _ in found] == [c for c, _ in want[:n]], text
            ways = {(cost, edited(ids, edits)) for cost, edits in found}
            assert len(ways) == len(found) and ways <= set(want)


def test_long_spans_pass_as_short_ones(vocabulary, monkeypatch):
    texts = [t * 9 for t in some_texts()]
    apart = pieces.encode_texts(texts, pieces.MODEL, 3)
    monkeypatch.setattr(pieces, "LONG", 0)
    pieces._spans(pieces.MODEL, 3).forget()
    for (a, x), (b, y) in zip(apart, pieces.encode_texts(texts, pieces.MODEL, 3), strict=True):
        assert [c for c, _ in x] == [c for c, _ in y] and sum(len(e) for _, e in x) == sum(len(e) for _, e in y)
        assert len(a) == len(b)
    pieces._spans(pieces.MODEL, 3).forget()


@pytest.mark.parametrize("text", ["x" * 20_000, "=" * 50_000, "ab" * 20_000, " " * 30_000, "漢" * 20_000])
def test_long_uniform_spans_end_soon(text):
    start = time.time()
    ((ids, found),) = pieces.encode_texts([text], pieces.MODEL, 3)
    assert time.time() - start < 10 and pieces.decode_ids(ids.tolist(), pieces.Vocabulary().bytes) == text
    assert len({edited(ids, e) for _, e in found}) == len(found) and [c for c, _ in found] == sorted(c for c, _ in found)


def as_unigram(raw):
    """The model file with the type of its trainer set to unigram, for which the library searches the same lattice."""

    def fields(data):
        i = 0
        while i < len(data):
            start, key, shift = i, 0, 0
            while True:
                key |= (data[i] & 127) << shift
                i, shift, more = i + 1, shift + 7, data[i] > 127
                if not more:
                    break
            head, size, shift = i, 0, 0
            if key & 7 in (0, 2):
                while True:
                    size |= (data[i] & 127) << shift
                    i, shift, more = i + 1, shift + 7, data[i] > 127
                    if not more:
                        break
                body = i
                i += size if key & 7 == 2 else 0
            else:
                body = i
                i += {5: 4, 1: 8}[key & 7]
            yield key, data[start:i], data[body:i], head

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    out = b""
    for key, whole, body, _ in fields(raw):
        if key == 2 << 3 | 2:
            inner = b"".join(b"\x18\x01" if k == 3 << 3 else w for k, w, _, _ in fields(body))
            whole = bytes([key]) + number(len(inner)) + inner
        out += whole
    return out


def test_best_segmentations_are_the_library_ones():
    with open(pieces.MODEL, "rb") as file:
        library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(file.read()))
    texts = ["hello world, it's", "supercalifragilistic", "The quick brown fox jumps over the lazy dog.", "über Straße façade", "x = [1, 2, 3]"]
    for text, (ids, found) in zip(texts, pieces.encode_texts(texts, pieces.MODEL, 4), strict=True):
        want = library.nbest_encode(text, nbest_size=4, out_type=int)
        cost = lambda x: sum(-library.get_score(i) for i in x)  # noqa: B023, E731
        assert cost(ids.tolist()) == cost(want[0]) and [c for c, _ in found] == sorted(cost(w) for w in want)
        assert {edited(ids, e) for _, e in found[:1]} == {tuple(want[0])}


def test_decoding_gives_texts_back(spark, odd):
    back = pieces.decode(pieces.encode(odd, check=True)).cache()
    assert rows_of(back, "doc_id", "text_sha256") == sorted(((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in ROWS), key=repr)
    assert rows_of(back, "doc_id", "text") == sorted(((r[0], r[1] or "") for r in ROWS), key=repr)


# --- suffix arrays


def test_suffix_order_by_hand():
    rng = np.random.default_rng(1)
    for alphabet in (b"ab", b"ab\0", b"abcdefg"):
        for n in (0, 1, 2, 5, 40, 300):
            text = bytes(rng.choice(list(alphabet), n).astype(np.uint8))
            assert suffix_dedup.suffix_array(text) == sorted(range(n + 1), key=lambda i: text[i:])


def removed_by_hand(rows, least):
    first = {}
    key = lambda i: i if i is not None else suffix_dedup.LAST
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < key(i):
                gone[p : p + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_removed_strings_by_hand(results):
    assert rows_of(results("op6_suffix_dedup"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(ROWS, 50)


def test_removed_strings_of_many_variants(spark):
    rng = np.random.default_rng(2)
    passage = bytes(rng.choice(list(b"abcd "), 120).astype(np.uint8)).decode()
    rows = []
    for i in range(60):
        a, b = sorted(rng.choice(121, 2, replace=False))
        noise = lambda: "".join(rng.choice(list("xyzuv "), rng.integers(0, 40)))
        rows.append((int(i), noise() + passage[a:b] + noise()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffix_dedup.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_hand(rows, 50)


def test_the_largest_id_is_no_null(spark):
    text = "".join(chr(97 + i % 26) for i in range(0, 700, 7))
    rows = [(suffix_dedup.LAST, text), (None, text), (3, "z" + text)]
    out = suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((repr(r["doc_id"]), r["n_removed"]) for r in out) == [("3", 0), (str(suffix_dedup.LAST), 100), ("None", 100)]


# --- training order


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 65_537):
        f = training_order.Feistel(n, "k")
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.sequences(slots) == np.arange(n)).all()
    assert (training_order.Feistel(1000, "a").slots(np.arange(1000)) != training_order.Feistel(1000, "b").slots(np.arange(1000))).any()


def test_shards_hold_every_token_in_slot_order(spark, odd, tmp_path):
    path = f"file://{tmp_path}/order"
    n, total = training_order.write_order(odd, path, length=32, per_shard=50)
    tokens = training_order.tokens_of()
    found = np.stack(list(training_order.read_slots(path, 0, n, 32, 50)))
    stream = np.empty_like(found)
    stream[training_order.Feistel(n, "order").sequences(np.arange(n))] = found
    stream = stream.reshape(-1)
    assert (stream[total:] == tokens.end).all()
    texts, now = [], []
    for t in stream[:total].tolist():
        if t == tokens.end:
            texts.append(tuple(now))
            now = []
        else:
            now.append(t)
    assert not now and Counter(texts) == Counter(tuple(tokens.coder.encode_ordinary(r[1] or "")) for r in ROWS)
    some = list(training_order.read_slots(path, 45, 20, 32, 50))
    assert (np.stack(some) == found[45:65]).all()
    sizes = {p.stat().st_size for p in sorted((tmp_path / "order").glob("shard-*.bin"))[:-1]}
    assert sizes == {50 * 32 * tokens.dtype.itemsize}


def test_shards_do_not_depend_on_partitions(spark, odd, tmp_path):
    found = []
    for k in (1, 7):
        path = tmp_path / f"order{k}"
        training_order.write_order(odd.repartition(k), f"file://{path}", length=32, per_shard=50)
        found.append([p.read_bytes() for p in sorted(path.glob("shard-*.bin"))])
    assert found[0] == found[1] and len(found[0]) > 2
    # the stream holds documents by id, null last, then by their texts' hashes
    tokens = training_order.tokens_of()
    n = sum(map(len, found[0])) // (32 * tokens.dtype.itemsize)
    stream = np.empty((n, 32), tokens.dtype)
    stream[training_order.Feistel(n, "order").sequences(np.arange(n))] = np.frombuffer(b"".join(found[0]), tokens.dtype).reshape(n, 32)
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    ids = [i for i, _ in Counter(r[0] for r in order).items()]
    want = [{tuple(tokens.coder.encode_ordinary(r[1] or "")) for r in ROWS if r[0] == i} for i in ids for _ in range(sum(r[0] == i for r in ROWS))]
    texts, now = [], []
    for t in stream.reshape(-1).tolist():
        if t == tokens.end:
            texts.append(tuple(now))
            now = []
        else:
            now.append(t)
    assert all(t in w for t, w in zip(texts, want))


# --- quality


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_quality_by_hand(spark, odd, labels):
    out = quality.judged(odd, labels).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out)
    assert got == Counter((r[0], *base_by_hand(r[1])) for r in ROWS)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    # scores: the ratio table over all n-grams, averaged by hand
    good = set(quality.trusted_ids(labels).tolist())
    raw, trusted = np.zeros(quality.BUCKETS, np.int64), np.zeros(quality.BUCKETS, np.int64)
    grams = {}
    for r in ROWS:
        words = (r[1] or "").encode().split()
        grams[r[1]] = quality._grams(quality._numbered(words), quality.BUCKETS) if words else np.zeros(0, np.int64)
        np.add.at(raw, grams[r[1]], 1)
        if r[0] in good:
            np.add.at(trusted, grams[r[1]], 1)
    ratio = quality.ratios(raw, trusted)
    want = Counter((r[0], round(float(ratio[grams[r[1]]].mean()), 9) if len(grams[r[1]]) else 0.0) for r in ROWS)
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in out) == want


def test_quality_stage_keeps_what_is_judged_kept(spark, odd, labels):
    kept = quality.kept_documents(odd.withColumn("score", F.lit(0)), labels)
    judged = quality.judged(odd, labels).where("kept")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in judged.collect())


# --- mixing


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(4)
    dims = [rng.integers(0, k, 60) for k in (4, 3, 5)]
    sizes = rng.integers(1, 100, 60).astype(float)
    targets = [np.full(k, 1 / k) for k in (4, 3, 5)]
    w = mixing.rake(sizes, dims, targets)
    for at, want in zip(dims, targets):
        assert np.allclose(np.bincount(at, w, len(want)), want, atol=1e-8)
    p = mixing.scale(sizes, w)
    assert p.max() == pytest.approx(1) and np.allclose(p * sizes / (p * sizes).sum(), w)
    q = mixing.scale(sizes, w, 0.9)
    assert (q * sizes).sum() == pytest.approx(0.9 * sizes.sum()) and q.max() <= 1


def test_mixing_on_driver_and_cluster_agree(spark, odd):
    docs = odd.withColumn("weight", F.lit("x")).withColumn("topic", F.lit("t"))
    a = {(r["doc_id"], r["source"], r["lang"]): (r["probability"], r["tokens"]) for r in mixing.mixed(docs).collect()}
    b = {(r["doc_id"], r["source"], r["lang"]): (r["probability"], r["tokens"]) for r in mixing.mixed(docs, most_cells=0, cluster_rounds=40).collect()}
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k][0], b[k][0], rel_tol=1e-3, abs_tol=1e-6) and a[k][1] == b[k][1] for k in a)


def test_mixing_query_by_hand(results):
    """The query's own rows: cells, weights raked by plain loops, probabilities and draws."""

    def topic(t):
        n = len(t.encode())
        return "table" if t.count("|") * 50 > n else "contact" if "@" in t else "verse" if t.count("\n") * 60 > n else "prose"

    cell = lambda r: (r[3], r[2], topic(r[1] or ""))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in ROWS:
        sizes[cell(r)] += words(r[1])
    total = sum(sizes.values())
    weights = {c: n / total for c, n in sizes.items()}
    goals = []
    for d, alpha in enumerate((0.7, 0.8, 0.9)):
        shares = Counter()
        for c, n in sizes.items():
            shares[c[d]] += n / total
        raised = {k: v**alpha for k, v in shares.items() if v > 0}
        goals.append({k: v / sum(raised.values()) for k, v in raised.items()})
    for _ in range(500):
        for d, goal in enumerate(goals):
            have = Counter()
            for c, w in weights.items():
                have[c[d]] += w
            weights = {c: w * goal.get(c[d], 0) / have[c[d]] if have[c[d]] else 0.0 for c, w in weights.items()}
    whole = sum(weights.values())
    rate = {c: w / whole / sizes[c] if sizes[c] else 0.0 for c, w in weights.items()}
    chance = {c: rate[c] / max(rate.values()) if sizes[c] else 1.0 for c in sizes}
    own = lambda r: int(hashlib.md5(f"42|{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:13], 16) / 2**52
    want = sorted(((r[0], *cell(r), words(r[1]), round(weights[cell(r)] / whole, 6), round(chance[cell(r)], 6)) for r in ROWS), key=repr)
    got = results("op9_mixing")
    assert sorted(((r["doc_id"], r["source"], r["lang"], r["topic"], r["tokens"], round(r["weight"], 6), round(r["probability"], 6)) for r in got), key=repr) == want
    assert Counter(r["doc_id"] for r in got if r["drawn"]) == Counter(r[0] for r in ROWS if own(r) < chance[cell(r)])


# --- sharding


def test_shards_match_the_mixture(spark, odd):
    out = sharding.interleave(odd.select("doc_id", "source", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")), "source", ["doc_id", "c"], 5).collect()
    counts = Counter(r["shard"] for r in out)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    sources = Counter(r["source"] for r in out)
    for s in range(5):
        for k, n in Counter(r["source"] for r in out if r["shard"] == s).items():
            assert abs(n - sources[k] / 5) <= 2


# --- pipeline


def test_pipeline_stages(spark, folder, empty_folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "copies", "mixture", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.where("false"), empty_folder).count() == 0
    coded = corpus_pipeline.run(spark, folder)
    assert 0 < coded.count() <= len(ROWS) and {"doc_id", "ids"} <= set(coded.columns)
