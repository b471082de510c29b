"""Literal fixtures of the text operators, and property tests against row-wise models."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodos.functions import letters as L
from lodos.functions import numerals as N
from lodos.functions import tokens as T
from lodos.operators import entities, grammar, groups, keywords, morphology, readability, spelling, style, text_tables


@pytest.fixture(scope="module")
def apply(spark):
    """Values of a column function on texts, in their order."""

    def run(function, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[1] for r in sorted(df.select("i", function(F.col("x"))).collect())]

    return run


def test_case(apply):
    assert apply(L.lower, ["İSTANBUL", "ILIK", "IŞIK", "İĞNE", None, ""]) == ["istanbul", "ılık", "ışık", "iğne", None, ""]
    assert apply(L.upper, ["istanbul", "ılık", "türkçe"]) == ["İSTANBUL", "ILIK", "TÜRKÇE"]
    assert apply(L.title, ["istanbul ve ankara", "ılık süt ve taze ekmek", "[ali", None]) == ["İstanbul Ve Ankara", "Ilık Süt Ve Taze Ekmek", "[ali", None]
    assert apply(L.fold, ["Türkçe, Çağdaş, Şiir, Ağaç, Gözlük, Işık"]) == ["Turkce, Cagdas, Siir, Agac, Gozluk, Isik"]


def test_harmony_and_stems(apply):
    assert all(apply(L.major_harmony, "okul çiçek ağaç türkiye gözlük ayakkabı kelebek".split())[:3])
    assert not any(apply(L.major_harmony, "kitap kalem tiyatro otobüs televizyon dünya".split()))
    assert all(apply(L.minor_harmony, "çocuk gözlük kapı odun bilezik".split()))
    assert apply(L.soften_stem, "kitap ağaç kanat ayak renk bebek".split()) == "kitab ağac kanad ayağ reng bebeğ".split()
    assert apply(L.drop_vowel, "burun akıl şehir karın ağız alın oğul fikir at".split()) == [*"burn akl şehr karn ağz aln oğl fikr".split(), None]
    assert apply(L.double_last, "hak his af sır hat zam".split()) == "hakk hiss aff sırr hatt zamm".split()
    assert apply(L.suffix_a, "kitap ev çiçek okul brr".split()) == list("aeeae")
    assert apply(L.suffix_i, "kitap ev okul göz brr".split()) == list("ıiuüi")


def syllables_by_hand(word):
    at = [i for i, c in enumerate(word) if c in L.VOWELS]
    cuts = [max(a + 1, b - 1) for a, b in zip(at, at[1:])]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if word else []


def test_syllables(apply):
    rng = random.Random(1)
    words = ["Türkçe", "araba", "bilgisayar", ""] + ["".join(rng.choice("abcçdeıioküzrt'.-1") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    assert apply(L.syllables, words) == [syllables_by_hand(w) for w in words]
    assert apply(L.hyphenate, words[:3]) == ["Türk-çe", "a-ra-ba", "bil-gi-sa-yar"]
    assert apply(L.syllable_count, ["öğretmenlerimiz"]) == [6]


def test_numbers(apply):
    assert apply(N.number_words, [1923, 105, 0, -42, 1000, None, -(2**63)], "long") == ["bin dokuz yüz yirmi üç", "yüz beş", "sıfır", "eksi kırk iki", "bin", None, None]
    assert apply(N.ordinal_words, [1, 4, 24], "long") == ["birinci", "dördüncü", "yirmi dördüncü"]
    assert apply(N.currency_words, [1250.50, 3.0], "double") == ["bin iki yüz elli lira elli kuruş", "üç lira"]
    rng = random.Random(2)
    some = [rng.randrange(10 ** rng.randint(1, 14)) for _ in range(100)]
    assert apply(lambda c: N.words_number(N.number_words(c)), some, "long") == some
    assert apply(N.words_number, ["bin elma", "", None]) == [None, None, None]


def test_tokens_and_sentences(apply, spark):
    text = "Ak Ana, Türk mitolojisinde deniz tanrıçasıdır. Prof. Dr. Ayşe Hanım geldi! Sen de gelecek misin? Evet..."
    assert apply(lambda c: T.sentence_sizes(T.words(c)), [text, "", None]) == [[8, 6, 5, 4], [], None]
    assert apply(T.words, ["#ev @ali http://a.b/c 3.14 50% Ankara'da 1923'te a@b.com"])[0] == ["#ev", "@ali", "http://a.b/c", "3.14", "50%", "Ankara'da", "1923", "'", "te", "a@b.com"]
    assert apply(lambda c: F.transform(T.words(c), T.kind), ["#ev 3.14 50% Dr. ev Ali'nin , €"])[0] == ["Hashtag", "Time", "Number", "Abbreviation", "Word", "ProperNounWithApostrophe", "Punctuation", "Symbol"]
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = [r["text"] for r in text_tables.sentences(docs, "doc_id").orderBy("sentence").collect()]
    assert found == ["Ak Ana, Türk mitolojisinde deniz tanrıçasıdır.", "Prof. Dr. Ayşe Hanım geldi!", "Sen de gelecek misin?", "Evet..."]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in text_tables.placed_tokens(docs, "doc_id").collect())
    assert readability.evaluated(readability.statistics(docs)).count() == 3
    assert keywords.keywords(docs).where("rank = 1").count() == 1


def test_grammar(spark):
    pairs = [
        ("Ahmetler'in evi buraya çok yakın.", "Ahmetlerin evi buraya çok yakın."),
        ("Yarışmada 2.'nci oldu.", "Yarışmada 2'nci oldu."),
        ("Cumhuriyet 1923'de kuruldu.", "Cumhuriyet 1923'te kuruldu."),
        ("Evi terketmek zorunda kaldı.", "Evi terk etmek zorunda kaldı."),
        ("O henüz hala buraya gelmedi.", "O henüz buraya gelmedi."),
        ("bugün burda geldinmi?", "Bugün burada geldin mi?"),
        ("Kitapı akılı ve elele bir çok hakkın da san ki", "Kitabı aklı ve el ele birçok hakkında sanki"),
        ("", ""),
        (None, None),
    ]
    docs = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "doc_id long, text string")
    got = {r["doc_id"]: r["corrected"] for r in grammar.corrected(docs).collect()}
    assert got == {i: b for i, (_, b) in enumerate(pairs)}


def test_morphology(spark):
    lexicon = morphology.seed_lexicon(spark)
    words = spark.createDataFrame([(w,) for w in ("kitaplarımızdan", "burnu", "hakkı", "geliyorum", None, " ", "xyz")], "word string")
    best = {r["word"]: r["formatted"] for r in morphology.analyses(words, lexicon).where("rank = 1").collect()}
    assert best == {"kitaplarımızdan": "[kitap:Noun] kitap:Noun+A3pl+P1pl+Abl", "burnu": "[burun:Noun] burun:Noun+Acc", "hakkı": "[hak:Noun] hak:Noun+Acc", "geliyorum": "[gelmek:Verb] gel:Verb+Prog+A1sg"}
    wanted = spark.createDataFrame([("kitap", ["Acc"], "kitabı"), ("burun", ["Acc"], "burnu"), ("git", ["Prog", "A1sg"], "gidiyorum"), ("oku", ["Fut"], "okuyacak"), ("yok", ["Acc"], None)], "lemma string, tags array<string>, want string")
    assert all(r["surface"] == r["want"] for r in morphology.generated(wanted, lexicon).collect())
    docs = spark.createDataFrame([(1, "Güzel kitabı okulda okudu.")], "doc_id long, text string")
    tree = morphology.disambiguated(docs, lexicon).orderBy("id").collect()
    assert [(r["head"], r["deprel"]) for r in tree] == [(2, "amod"), (4, "obj"), (4, "obl"), (0, "root"), (4, "dep")]


def test_entities_and_style(spark):
    docs = spark.createDataFrame([(1, "Ahmet 500 TL verdi, 16 Ağustos 2026 günü Sağlık Bakanlığı %50 dedi."), (2, "")], "doc_id long, text string")
    names = spark.createDataFrame([("Ahmet",)], "word string")
    found = [(r["label"], r["text"]) for r in entities.entities(docs, names).orderBy("start").collect()]
    assert found == [("PER", "Ahmet"), ("MONEY", "500 TL"), ("DATE", "16 Ağustos 2026"), ("ORG", "Sağlık Bakanlığı"), ("PERCENT", "%50")]
    text = "Bu bağlamda konu kritik bir rol oynamaktadır. Öte yandan süreç önemli bir adım; ancak sadece hız değil, aynı zamanda güven arar."
    row = style.audit(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["BureaucraticConnector"], row["ConclusionHedge"], row["RhetoricalCalque"], row["SemicolonConjunction"]) == (2, 1, 1, 1) and row["score"] >= 75


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_spelling_finds_all_neighbours(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abış") for _ in range(rng.randint(1, 6)))
    vocab, words = sorted({word() for _ in range(150)}), sorted({word() for _ in range(60)})
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = spelling.suggestions(frame(words), spelling.vocabulary(frame(vocab)), most=1000).collect()
    want = {(w, v, levenshtein(w.encode(), v.encode())) for w in words for v in ([w] if w in vocab else vocab)}
    assert {(r["word"], r["suggestion"], r["distance"]) for r in got} == {x for x in want if x[2] <= 2}


def test_grammar_by_parses(spark):
    pairs = [
        ("Bugün hava çok güzel.", "Bugün hava çok güzel.", None),
        ("Ali de geldi, Veli te geldi.", "Ali de geldi, Veli de geldi.", "CliticDeDa"),
        ("Gittide geri dönmedi.", "Gitti de geri dönmedi.", "CliticDeDa"),
        ("Duydumki unutmuşsun gözlerimin rengini.", "Duydum ki unutmuşsun gözlerimin rengini.", "CliticKi"),
        ("Madem ki bilmiyorsun, neden konuşuyorsun?", "Mademki bilmiyorsun, neden konuşuyorsun?", "CliticKi"),
        ("Biliyormusun bu şarkıyı?", "Biliyor musun bu şarkıyı?", "ParticleMi"),
        ("Sen de gördün mı onu?", "Sen de gördün mü onu?", "ParticleMi"),
        ("Kitapda ilginç bilgiler var.", "Kitapta ilginç bilgiler var.", "ConsonantAssimilation"),
        ("Sokakdan sesler geliyor.", "Sokaktan sesler geliyor.", "ConsonantAssimilation"),
        ("Onun akılı çok karışık.", "Onun aklı çok karışık.", "VowelDropping"),
        ("Yarın şehire gideceğiz.", "Yarın şehre gideceğiz.", "VowelDropping"),
        ("Bu kitapı mutlaka okumalısın.", "Bu kitabı mutlaka okumalısın.", "ConsonantSoftening"),
        ("Çocuklar elele yürüyorlardı.", "Çocuklar el ele yürüyorlardı.", "ReduplicationOrthography"),
        ("Pazardan üç elmalar aldım.", "Pazardan üç elma aldım.", "QuantityPluralClash"),
        ("Mitinge birçok insanlar katıldı.", "Mitinge birçok insan katıldı.", "QuantityPluralClash"),
        ("Kendini çok iyi hiss etti.", "Kendini çok iyi hissetti.", "CompoundWordOrthography"),
        ("Onlar birlikte beraber çalışıyorlar.", "Onlar birlikte çalışıyorlar.", "TautologyRedundancy"),
        ("Dün benim araba bozuldu.", "Dün benim arabam bozuldu.", "GenitivePossessiveClash"),
        ("Kimse buraya geldi.", "Kimse buraya geldi.", "CorrelativeConjunctionPolarity"),
        ("O ne bilmiyor ne okudu.", "O ne biliyor ne okudu.", "CorrelativeConjunctionPolarity"),
        ("Evler güzel görüyorlar.", "Evler güzel görüyor.", "SubjectVerbAgreement"),
        ("Hemen başlayor.", "Hemen başlıyor.", "VowelHarmony"),
    ]
    docs = spark.createDataFrame([(i % 2 if i else None, a) for i, (a, _, _) in enumerate(pairs)], "doc_id long, text string").coalesce(1)
    lexicon = morphology.seed_lexicon(spark)
    assert Counter(r["corrected"] for r in grammar.corrected(docs, lexicon).collect()) == Counter(b for _, b, _ in pairs)
    found = grammar.findings(docs, lexicon).collect()
    assert {c for _, _, c in pairs if c} <= {r["category"] for r in found}
    texts = [a for a, _, _ in pairs]
    assert all(any(t[r["start"] : r["end"]] == r["original"] for t in texts) for r in found)


def test_inflectional_groups(spark):
    words = spark.createDataFrame([(w,) for w in ("güzel", "geldiğimizde", "evlerimizde", "ankara")], "word string")
    rows = groups.group_parses(words, morphology.seed_lexicon(spark)).collect()
    assert {"ADJ", "ADV", "NN"} <= {r["root_pos"] for r in rows if r["word"] == "güzel"}
    parses = [r for r in rows if r["word"] == "geldiğimizde" and r["root"] == "gel"]
    assert any(r["root_pos"] == "VB" and r["groups"][0]["Polarity"] == "Pos" and (g := r["groups"][1])["pos"] == "NOMP" and g["derivation"] == "PastNom" and g["Case"] == "Loc" for r in parses)
    assert "(ev[NN]+[Case=Loc]+[PersonNumber=A3pl]+[Possessive=P1pl])+[Proper=False]" in {r["formatted"] for r in rows}
    assert "(ankara[PROP])+[Proper=True]" in {r["formatted"] for r in rows}


def test_normalization_by_parses(spark):
    lexicon = morphology.seed_lexicon(spark)
    docs = spark.createDataFrame([(1, "turkce nlp cok hizli calisiyor ve ogrenci kitap okuyor"), (1, None), (None, "COK Guzel agac"), (3, "")], "doc_id long, text string")
    marked = spelling.replaced(docs, spelling.restorations(spelling.word_runs(docs), lexicon))
    assert Counter(r["changed"] for r in marked.collect()) == Counter(["türkçe nlp çok hızlı çalışıyor ve öğrenci kitap okuyor", None, "ÇOK Güzel ağaç", ""])
    words = {"noldu": "ne oldu", "çooookkkk": "çok", "yapcam": "yapacağım", "geliyom": "geliyorum", "xyzzz": "xyzz", "gelcekler": "gelecekler", "gidiyo": "gidiyor"}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r["word"]: r["better"] for r in spelling.normalizations(frame, lexicon).collect()} == words
