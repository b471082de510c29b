"""Places where an earlier form did less than the whole job."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodos.llm import line_dedup, mixing, near_copies, quality
from lodos.llm.components import components


def test_near_copies_link_at_the_exact_similarity(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shingled = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = []
    for _ in range(40):
        base = words(204)
        texts.append(" ".join(base))
        for edits in (2, 3, 4, 5):  # each edit changes five of 200 shingles
            other = list(base)
            for k in range(edits):
                other[10 + 40 * k] = words(1)[0]
            texts.append(" ".join(other))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    least = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    sets = [shingled(t) for t in texts]
    want = {}
    for g in range(0, len(texts), 5):
        group = {i: i for i in range(g, g + 5)}
        for i in group:
            for j in group:
                if least(sets[i], sets[j]):
                    x, y = group[i], group[j]
                    group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
        want |= group
    for hot in (64, 1):
        got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, hot=hot).collect()}
        assert got == want and len(set(want.values())) == 40 * 2
    kept = near_copies.one_of_each(docs.withColumn("other", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "other"] and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_third_stage_links_by_simhash(spark):
    """Look-ups in balls around segments find every link, at any width and however full the lists are."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    texts = []
    for _ in range(25):  # chains: a text links to its neighbours alone, so that none of a group reaches all the others
        text = [word() for _ in range(124)]
        for k in range(8):
            texts.append(" ".join(text))
            for i in (10, 60):  # two edits change ten of 120 shingles: 110 of 130 stay, and 100 of 140 two texts on
                text[i + 5 * k] = word()
    for _ in range(100):  # 90 and 72 shingles, the lesser within the greater: exactly 0.8
        text = [word() for _ in range(94)]
        texts += [" ".join(text), " ".join(text[:76])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: i - i % 8 if i < 200 else i - i % 2 for i in range(400)}
    prints = near_copies._prints(docs, 5).cache()
    for segments, hot in [((16, 24), 64), ((18, 32), 64), ((16, 24), 0)]:
        found = components(near_copies.links(docs, prints, 5, hot, segments))
        roots = {r["doc_id"]: r["root"] for r in prints.join(found, F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "fp").alias("root")).collect()}
        least = {}
        for i in sorted(roots):
            least.setdefault(roots[i], i)
        assert {i: least[r] for i, r in roots.items()} == want, (segments, hot)


def test_third_stage_fingerprints_by_hand():
    def mixed(h):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * times % 2**64
        return h ^ h >> 31

    for n in (1, 2, 9, 300, 1000):  # more than a byte counts
        found = near_copies.shingles(" ".join(f"w{i}" for i in range(n + 4)).encode())
        want = []
        for k in range(near_copies.WORDS):
            h = [mixed((int(x) + (k + 1) * 0x9E3779B97F4A7C15) % 2**64) for x in found]
            want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
        assert len(found) == n and [int(x) % 2**64 for x in near_copies.fingerprint(found)] == want


def line_runs_by_hand(texts, least_words, least_lines):
    """The texts left, with each later window grown line by line."""
    units = [[(i, x) for i, x in enumerate(t.split("\n")) if x.split()] for t in texts]
    first, gone = {}, [set() for _ in texts]
    for d, u in enumerate(units):
        for a in range(len(u)):
            n = next((k for k in range(1, least_lines + 1) if a + k <= len(u) and (k == least_lines or sum(len(x.split()) for _, x in u[a : a + k]) >= least_words)), None)
            if n is None:
                continue
            o, b = first.setdefault(tuple(x for _, x in u[a : a + n]), (d, a))
            if (o, b) != (d, a):
                for step in (1, -1):
                    i, j = a, b
                    while 0 <= i < len(u) and 0 <= j < len(units[o]) and u[i][1] == units[o][j][1]:
                        gone[d].add(u[i][0])
                        i, j = i + step, j + step
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in enumerate(texts)}


def test_later_runs_go_whole(spark, tmp_path):
    rng = random.Random(5)
    texts = []
    for _ in range(80):
        lines = [" ".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 1, 2, 6)))) for _ in range(rng.randint(1, 9))]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs, 5, 3, extend=True).collect()}
    assert got == line_runs_by_hand(texts, 5, 3)
    # an exact copy with a short tail leaves the pipeline's second stage
    text = "\n".join([" ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(53)), "short one here", "", "end"])
    docs = spark.createDataFrame([(i, text, "en", "s", len(text)) for i in (1, 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [(r["doc_id"], r["text"]) for r in corpus_pipeline.lines(spark, docs, "").collect()] == [(1, text)]


@pytest.mark.parametrize("budget", [0.6, 1.0])
def test_mixing_by_cluster_and_driver_agree_with_a_budget(spark, budget):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 60), f"s{i % 4}" if i % 3 else "hot", rng.choice(("en", "tr")), rng.choice("ab")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    a = {r["doc_id"]: r for r in mixing.mixed(docs, budget=budget).collect()}
    b = {r["doc_id"]: r for r in mixing.mixed(docs, budget=budget, most_cells=0).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k]["probability"] - b[k]["probability"]) < 1e-6 and abs(a[k]["weight"] - b[k]["weight"]) < 1e-8 for k in a)
    if budget:
        assert abs(sum(r["probability"] * r["tokens"] for r in b.values()) - budget * sum(r["tokens"] for r in b.values())) < 1e-3


def test_mixture_stage_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, f"d{i} " + "w " * 30, "en", "hot" if i % 3 == 0 else f"s{rng.randrange(6)}", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = Counter(r[3] for r in rows)
    target = mixing.tempered({k: v / len(rows) for k, v in sizes.items()}, mixing.ALPHA["source"])
    drawn = Counter(r["source"] for r in corpus_pipeline.mixture(spark, docs, "").collect())
    assert all(abs(drawn[k] / sum(drawn.values()) - target[k]) < 0.02 for k in target)


def test_toxic_words_in_ordinary_prose_are_rejected(spark):
    rng = random.Random(8)
    prose = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        words = [rng.choice(prose) for _ in range(rng.randint(60, 200))]
        for _ in range(3 if i % 6 == 0 else 0):
            words.insert(rng.randrange(len(words)), rng.choice(("Vile,", "vile", "rotten", "rotten.")))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.judged(docs, labels).where("kept").collect()}
    unseen = range(400, 600)
    assert not [i for i in unseen if i % 6 == 0 and i in kept]
    assert sum(i in kept for i in unseen if i % 6) > 150
