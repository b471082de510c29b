"""What lets the text operators end in time on large tables, against their plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodos.functions import tokens as T
from lodos.operators import analysis, grammar, keywords, morphology, text_tables

ODD = [
    "dr. Prof.x İS. m.a s. www.a b http://x.y z t a@b.com a.b@c.de x@ 12.5% -3 +4,5 1.2.2020 12:30 ali'nin’ki o'da l'x 'a' #ev @ali",
    "müteh. madde. VOLÜM. wx h hw http:// https://$ #", "", "   ", " x　y \U0001f600 İs. ıs. Is. IS.", "a,b\nc,d.e kısa. tbmm.x www. www.a b", None, "1'de 5 % -- -a 3.", "x " * 5000,
]


def test_tokens_are_those_of_the_plain_pattern(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    plain = F.regexp_extract_all("text", F.lit(T.token_pattern()), 0)
    rows = text_tables.cut(docs, "doc_id").select("_text", "_t", "_e").join(docs.select(F.col("text").alias("_text"), plain.alias("plain")).distinct(), "_text").collect()
    assert len(rows) == len(ODD) - 1
    for r in rows:
        assert r["_t"] == r["plain"]
        at = 0
        for t, e in zip(r["_t"], r["_e"], strict=True):
            at = r["_text"].index(t, at) + len(t)
            assert at == e


def _phrases():
    rng = random.Random(5)
    words = [w for d in (grammar.WITH_DE, grammar.WITH_KI, grammar.DOUBLES, grammar.INDEFINITE, grammar.NARROWED, grammar.SPOKEN, grammar.APART, grammar.TOGETHER, grammar.TWICE) for w in d]
    words += [r + "ı" for r in (*grammar.DROPPED, *grammar.SOFTENED)] + [f"gel{q}" for q in grammar.QUESTION] + [f"{x} {y}" for x in grammar.LOCATIVE for y in ("da", "nde")]
    words += [f"ala {b}" for b in grammar.BIL] + ["geldimi", "okul mi", "ev ta", "te", "belki", "bel ki", "3'de", "5'DEN", "ev'ler", "parler'a", "l'LİK", "1.'nci"]
    words += "geldide kitapda gelki başlayor kitaplar evlar kitapcı bakdı beş elmalar benim kitap kimse geldi ne ne insanlar geldiler 3 kitaplar".split()
    cased = [f(w) for w in words for f in (str, lambda x: x.replace("i", "İ").replace("ı", "I").upper(), lambda x: x[:1].upper() + x[1:])]
    rng.shuffle(cased)
    return [(i, " ".join(rng.choice(cased) + rng.choice(["", "", "?", ","]) for _ in range(rng.randint(1, 9)))) for i in range(250)] + [(1000, "kelime " * 500 + "yanlız"), (1001, ""), (1002, None)]


def test_passed_by_tokens_have_no_findings(spark, monkeypatch):
    docs = spark.createDataFrame(_phrases(), "doc_id long, text string").cache()
    with_gate = sorted(map(tuple, grammar.findings(docs).collect()), key=str)
    assert len(with_gate) > 300 and {c for _, _, _, c, _, _ in with_gate} >= {"CliticKi", "ParticleMi", "TautologyRedundancy", "ApostropheProperNoun", "ConsonantSoftening"}
    monkeypatch.setattr(grammar, "_asking", lambda: F.lit(True))
    monkeypatch.setattr(grammar, "_APOSTROPHE", "'")
    assert sorted(map(tuple, grammar.findings(docs).collect()), key=str) == with_gate


def test_endings_of_rules_on_parses(spark):
    """Each word that a rule on parses may ask for passes by its ending."""
    words = [f"{s}{e}" for s in ("kitap", "gel", "KİTAP") for e in "de da te ta ki den dan di dır dur dür ca ce eyor ayor ler lar DE Kİ DIR LER".split()]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    held = text_tables.rowed(docs, "doc_id", "text")
    plain = grammar._tokens(held, "text", F.lit(True)).where(F.rlike("low", F.lit(grammar._ASKS))).count()
    assert grammar._tokens(held, "text", grammar._ending(grammar.ASKING)).where(F.rlike("low", F.lit(grammar._ASKS))).count() == plain == len(words)


def test_keywords_move_no_text(spark):
    """Phrases are scored within their row; with stems as without, a row is as by a plain loop."""
    docs = spark.createDataFrame([(7, "Kedi köpek ve kedi. Köpek bahçe kedi!"), (7, "kuş"), (None, "kuş dağ"), (8, ""), (9, None)], "doc_id long, text string")
    found = keywords.keywords(docs, 2)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    rows = [(7, 1, "köpek bahçe kedi", 7.5), (7, 2, "kedi köpek", 4.5), (7, 1, "kuş", 1.0), (None, 1, "kuş dağ", 4.0)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    stems = spark.createDataFrame([(w, w) for w in "kedi köpek bahçe".split()], "word string, stem string")
    assert sorted(map(tuple, keywords.keywords(docs, 2, stems).collect()), key=str) == sorted(map(tuple, found.collect()), key=str)


def test_sentences_in_one_pass(spark):
    """Sentences of one pass are those of the plain operators, where words repeat, ids repeat and texts are null."""
    rows = [(1, "a b a.  a  a! Ali eve geldi."), (1, "Kitabı okudum. kitabı"), (None, "ev ev. ev"), (2, ""), (3, None), (4, "x 😀 ev. 😀 ev")]
    docs, lexicon = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache(), morphology.seed_lexicon(spark)
    tables = [f.select("doc_id", "sentence", "conllu").collect() for f in (morphology.conllu_texts(docs, lexicon), morphology.conllu(morphology.disambiguated(docs, lexicon)))]
    assert sorted(map(tuple, tables[0]), key=str) == sorted(map(tuple, tables[1]), key=str)
    whole = analysis.analyzed(docs, lexicon)
    spans = text_tables.sentences(docs, "doc_id")
    names = ["doc_id", "sentence", "start", "end", "text"]
    assert sorted(map(tuple, whole.select(names).collect()), key=str) == sorted(map(tuple, spans.select(names).collect()), key=str)
    forms = whole.where("doc_id = 4").orderBy("sentence").collect()
    assert [[t["form"] for t in r["tokens"]] for r in forms] == [["x", "😀", "ev", "."], ["😀", "ev"]]


def test_workers_give_memory_back():
    """A large array that was freed doesn't stay with its process."""
    import psutil

    from lodos.llm.common import give_back

    own, held = psutil.Process(), [bytes(1000) for _ in range(300_000)]
    full = own.memory_info().rss
    held.clear()
    give_back()
    assert own.memory_info().rss < full - 200_000_000


@pytest.mark.parametrize("stage", ["quality", "copies", "pieces"])
def test_stages_hold_little_in_their_workers(spark, monkeypatch, stage):
    """A worker that gets a whole partition as one batch works on slices of it, with the same rows, and keeps nothing at its end."""
    import re
    from pathlib import Path

    import pyarrow as pa

    from lodos.llm import near_copies, pieces, quality

    rng, sent = random.Random(4), []
    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sent.append(f) or self)
    if stage == "quality":
        model = quality.Model(quality.np.zeros(quality.BUCKETS), 0.0)
        monkeypatch.setattr(quality, "fit", lambda *_: model)
        quality.kept_documents(docs, docs)
    elif stage == "copies":
        near_copies._prints(docs, 5)
    else:
        pieces.encode(docs, check=True)
    texts = [" ".join(f"{rng.randrange(36**5):x}" for _ in range(n)) for n in [300] * 4000 + [150_000, 0]]
    names = ["doc_id", "text", "text_hash"] if stage == "copies" else ["doc_id", "text"]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t), pa.array(range(len(t)))][: len(names)], names)
    small, large = batch(texts[:2]), batch(texts)
    assert len(list(sent[0](iter([small, small.slice(0, 0)]))))
    held = lambda: sum(map(int, re.findall(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    before, n, most = held(), 0, 0
    for out in sent[0](iter([large])):
        n, most = n + out.num_rows, max(most, out.num_rows)
    del out
    assert n == len(texts) - (stage == "quality") and most < 2000  # the empty text fails the quality rules
    assert held() < before + 40
