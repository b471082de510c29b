"""Grammar findings and corrected texts: rules over tokens with their neighbours.

Findings have offsets in code points. Rules on a token and the one before it are column expressions over the row's own
arrays. With a lexicon, rules on words ask for the parses of distinct words, joined back to the tokens that ask; rules on
agreement walk the few texts that hold a trigger, with their tokens' parses. Of neighbouring findings with one span the
first rule's stays; corrections are spliced in from the end. Rows with one id, or none, stay apart; null and empty texts
have no findings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import tokens as T
from .morphology import analyses, choose, parse_lists
from .text_tables import ROW, cut, rowed

# The word lists of the rules.
QUESTION = ("misin mısın musun müsün miyiz mıyız muyuz müyüz misiniz mısınız musunuz müsünüz miler mılar").split()
WITH_DE = {
    "yada": "ya da", "hemde": "hem de", "birde": "bir de", "bende": "ben de", "sende": "sen de", "bizde": "biz de",
    "sizde": "siz de", "dahada": "daha da", "şunuda": "şunu da", "bunuda": "bunu da", "onuda": "onu da", "pekde": "pek de",
    "hiçde": "hiç de", "ya'da": "ya da", "hem'de": "hem de", "daha'da": "daha da", "ben'de": "ben de", "sen'de": "sen de",
    "o'da": "o da", "biz'de": "biz de", "siz'de": "siz de", "onlar'da": "onlar da", "bu'da": "bu da", "şu'da": "şu da",
}
LOCATIVE = (
    "hakkın arasın konusun tarafın yolun zamanın adın için üzerin yanın durumun sayesin karşısın altın üstün önün arkasın "
    "peşin başın sonun boyun halin yüzün içerisin dışarısın"
).split()
WITH_KI_ATTACHED = "sanki oysaki mademki belki halbuki çünkü meğerki illaki".split()
WITH_KI = {"yazıkki": "yazık ki", "demekki": "demek ki", "tabiiki": "tabii ki", "tabiki": "tabii ki", "varki": "var ki", "iyiki": "iyi ki", "yeterki": "yeter ki", "öyleki": "öyle ki"}
ORDINAL = (".'nci", ".'ncı", ".'ncu", ".'ncü", ".'inci", ".'ıncı", ".'uncu", ".'üncü")
DOUBLES = {
    "elele": "el ele", "yanyana": "yan yana", "gözgöze": "göz göze", "baştanbaşa": "baştan başa", "adımadım": "adım adım",
    "gündengüne": "günden güne", "peşpeşe": "peş peşe", "sırasırasına": "sıra sırasına", "artarda": "art arda",
    "ardarda": "art arda", "içiçe": "iç içe", "üstüste": "üst üste", "arkaarkaya": "arka arkaya",
}
BIL = "bilir bile bildi bilecek bilse bilmiş biliyor bilsin bilen bilip bilmek".split()
INDEFINITE = {
    "bir çok": "birçok", "bir kaç": "birkaç", "bir az": "biraz", "bir takım": "birtakım", "hiç bir": "hiçbir",
    "hiç biri": "hiçbiri", "hiç birisi": "hiçbirisi", "her hangi": "herhangi", "her hangisi": "herhangisi",
}
DROPPED = {
    "akıl": "akl", "alın": "aln", "bağır": "bağr", "beyin": "beyn", "boyun": "boyn", "burun": "burn", "karın": "karn",
    "göğüs": "göğs", "gönül": "gönl", "omuz": "omz", "oğul": "oğl", "resim": "resm", "şehir": "şehr", "isim": "ism",
    "fikir": "fikr", "sabır": "sabr", "vakit": "vakt", "nesil": "nesl", "metin": "metn", "zehir": "zehr", "hüküm": "hükm",
    "devir": "devr",
}
NARROWED = {
    "mıyanlar": "mayanlar", "miyenler": "meyenler", "mıyan": "mayan", "miyen": "meyen", "mıyarak": "mayarak",
    "miyerek": "meyerek", "mıyalım": "mayalım", "miyelim": "meyelim", "mıya": "maya", "miye": "meye",
    "başlıyan": "başlayan", "söyliyen": "söyleyen", "bekliyen": "bekleyen", "yaşıyan": "yaşayan", "anlıyan": "anlayan",
    "istiyen": "isteyen", "izliyen": "izleyen", "dinliyen": "dinleyen", "kutlıyan": "kutlayan", "özliyen": "özleyen",
    "olmıyan": "olmayan", "görmiyen": "görmeyen", "bilmiyen": "bilmeyen", "gelmiyen": "gelmeyen",
}
SPOKEN = {
    "burda": "burada", "burdan": "buradan", "burdaki": "buradaki", "şurda": "şurada", "şurdan": "şuradan",
    "şurdaki": "şuradaki", "orda": "orada", "ordan": "oradan", "ordaki": "oradaki", "dışarda": "dışarıda",
    "dışardan": "dışarıdan", "dışardaki": "dışarıdaki", "içerde": "içeride", "içerden": "içeriden",
    "içerdeki": "içerideki", "yukarda": "yukarıda", "yukardan": "yukarıdan", "yukardaki": "yukarıdaki",
    "ilerde": "ileride", "ilerden": "ileriden", "ilerdeki": "ilerideki", "yalınız": "yalnız", "yanlız": "yalnız",
    "yalnış": "yanlış",
}
SOFTENED = {
    "kitap": "kitab", "ağaç": "ağac", "kanat": "kanad", "renk": "reng", "çocuk": "çocuğ", "ayak": "ayağ", "ekmek": "ekmeğ",
    "köpek": "köpeğ", "dolap": "dolab", "kalp": "kalb", "hesap": "hesab", "cevap": "cevab", "kulak": "kulağ",
    "bacak": "bacağ", "çiçek": "çiçeğ", "tarak": "tarağ",
}
APART = {
    "terketmek": "terk etmek", "terketti": "terk etti", "terkettiler": "terk ettiler", "farketmek": "fark etmek",
    "farkettim": "fark ettim", "farketti": "fark etti", "ayırdetmek": "ayırt etmek", "arzetmek": "arz etmek",
    "sağol": "sağ ol", "sağolun": "sağ olun", "yokolmak": "yok olmak", "varketmek": "var etmek", "haketmek": "hak etmek",
    "dahilolmak": "dahil olmak", "yardımetmek": "yardım etmek", "teslimolmak": "teslim olmak",
    "hayranolmak": "hayran olmak",
}
TOGETHER = {
    "hiss etmek": "hissetmek", "hiss etti": "hissetti", "red etmek": "reddetmek", "red etti": "reddetti",
    "af etmek": "affetmek", "af etti": "affetti", "kayıp olmak": "kaybolmak", "kayıp oldu": "kayboldu",
    "zehir olmak": "zehrolmak", "zehir oldu": "zehroldu", "hüküm etmek": "hükmetmek", "hüküm etti": "hükmetti",
    "sabır etmek": "sabretmek", "sabır etti": "sabretti", "devir etmek": "devretmek", "devir etti": "devretti",
    "hal olmak": "hallolmak", "hal oldu": "halloldu",
}
TWICE = {
    "henüz hala": "henüz", "hala henüz": "hâlâ", "birlikte beraber": "birlikte", "beraber birlikte": "beraber",
    "ilk başlangıç": "başlangıç", "geri iade": "iade", "kendi öz": "öz", "şüphesiz kuşkusuz": "şüphesiz",
    "aynen tamamen": "tamamen",
}
QUANTITY = set(
    "bir iki üç dört beş altı yedi sekiz dokuz on yirmi otuz kırk elli altmış yetmiş seksen doksan yüz bin milyon birçok "
    "birkaç çok az onlarca yüzlerce binlerce kaç fazla hayli".split()
)
NEGATIVE = set("kimse hiçbiri hiçbirisi hiçkimse asla katiyen".split())
#: Negated endings and their affirmatives, replaced in this order.
AFFIRMED = {
    "medi": "di", "madı": "dı", "miyor": "iyor", "mıyor": "ıyor", "müyor": "üyor", "muyor": "uyor", "meyecek": "ecek",
    "mayacak": "acak", "mez": "r", "maz": "r",
}
_DERIVED_ROOT = "(ler|lar|li|lı|lu|lü|lik|lık|luk|lük|gil)$"
_DERIVED_SUFFIX = "^(ler|lar|li|lı|lu|lü|siz|sız|suz|süz|lik|lık|luk|lük)"

FINDING = "start long, end long, category string, original string, replacement string, ord int"


def _map(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def _first(start: Column, end: Column, category: str, original: Column, replacement: Column, order: int) -> Column:
    """A finding; null where there is no replacement."""
    made = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(category).alias("category"), original.alias("original"), replacement.alias("replacement"), F.lit(order).alias("ord"))
    return F.when(replacement.isNotNull(), made)


def _cased(like: Column, text: Column) -> Column:
    return F.when(F.rlike(like, F.lit(r"^\p{IsUppercase}")), L.title(text)).otherwise(text)


def _rooted(low: Column, roots: dict[str, str]) -> Column:
    """A word that begins with a root and a vowel, with the root replaced; null for others."""
    pattern = f"^({'|'.join(roots)})([{L.VOWELS}].*)$"
    root = F.regexp_extract(low, pattern, 1)
    return F.when(root != "", F.concat(_map(roots, root), F.regexp_extract(low, pattern, 2)))


def _in(part: str, forms: set[str] | list[str]) -> Column:
    """Whether an expression is one of these texts in some case; its letters' case is no matter, so that none need be lowered."""
    cases = lambda c: {c, {"i": "İ", "ı": "I"}.get(c, c.upper()), "\u212a" if c == "k" else c}
    every = sorted({"".join(x) for f in forms for x in product(*map(cases, f))})
    return F.expr(f"{part} IN ({', '.join(chr(39) + x.replace(chr(39), chr(92) + chr(39)) + chr(39) for x in every)})")


def _ending(forms: set[str] | list[str]) -> Column:
    """Whether a token may end with one of these: by their last three letters, or two where they have no more."""
    last = {f[-3:] for f in forms}
    return _in("right(token, 2)", [f for f in last if len(f) == 2]) | _in("right(token, 3)", [f for f in last if len(f) == 3])


def _asking() -> Column:
    """Whether a rule of :func:`token_findings` may find something at (pos, token, before); most tokens are passed by here."""
    whole = {"te", "ta", "ki", *WITH_DE, *WITH_KI, *DOUBLES, *SPOKEN, *APART, *(p.split(" ")[1] for p in (*INDEFINITE, *TOGETHER))}
    parted = F.expr("token").isNotNull() & _in("substring(token, 1, 4)", "da de dan den nda nde".split()) & L.lower("before").isin(LOCATIVE)
    return (
        ((F.col("pos") == 0) & F.rlike("token", F.lit(r"^\p{IsLowercase}")))
        | _in("substring(token, 1, 4)", {w[:4] for w in (*whole, *BIL, *DROPPED, *SOFTENED)})
        | _ending(["mi", "mı", "mu", "mü", *QUESTION, *NARROWED])
        | (F.rlike(F.right("token", F.lit(1)), F.lit(r"[!-/:-@\[-`{-~]")) & (F.length("token") > 1))
        | parted
    )


def rows_before(held: DataFrame, text: str) -> DataFrame:
    """(_row, pos, token, before): all tokens, each with the one before it."""
    once = held.select(ROW, T.words(text).alias("_t"))
    near = F.arrays_zip(F.col("_t").alias("t"), F.concat(F.array(F.lit(None).cast("string")), "_t").alias("b"))
    rows = once.select(ROW, F.posexplode(near).alias("pos", "r")).select(ROW, "pos", F.col("r.t").alias("token"), F.col("r.b").alias("before"))
    return rows.where(F.col("token").isNotNull())


#: Pieces whose lengths are added up at once.
_BLOCK = 64


def _tokens(held: DataFrame, text: str, gate: Column) -> DataFrame:
    """(_row, pos, token, start, end, low) of the tokens that pass ``gate``, with the token before as before, before_low, before_start."""
    once = held.select(ROW, T.pieces(text).alias("_p")).select(ROW, "_p", F.transform("_p", T.bare).alias("_t"))
    length = lambda first, n: F.length(F.array_join(F.slice("_p", first, n), ""))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_p") - 1) / _BLOCK).cast("int")), lambda b: length(b * _BLOCK + 1, F.lit(_BLOCK)))
    near = F.arrays_zip(F.col("_t").alias("t"), F.concat(F.array(F.lit(None).cast("string")), "_t").alias("b"))
    once = once.select(ROW, "_p", blocks.alias("_l"), near.alias("_n")).select(ROW, "_p", T.running(F.col("_l")).alias("_b"), "_n")
    rows = once.select(ROW, "_p", "_b", F.posexplode("_n").alias("pos", "r")).select(ROW, "_p", "_b", "pos", F.col("r.t").alias("token"), F.col("r.b").alias("before"))
    rows = rows.where(F.col("token").isNotNull() & gate)
    block = F.floor(F.col("pos") / _BLOCK).cast("int")
    end = F.coalesce(F.get("_b", block - 1), F.lit(0)) + length(block * _BLOCK + 1, F.col("pos") % _BLOCK + 1)
    rows = rows.select(ROW, "pos", "token", "before", end.cast("long").alias("end"), F.length(F.get("_p", F.col("pos"))).alias("_n"))
    rows = rows.withColumn("start", F.col("end") - F.length("token")).withColumn("before_start", F.col("end") - F.col("_n") - F.length("before"))
    return rows.withColumn("low", L.lower("token")).withColumn("before_low", L.lower("before")).drop("_n")


def token_findings(held: DataFrame, text: str = "text") -> DataFrame:
    """(_row, finding...) of the rules that look at a token and the one before it."""
    rows = _tokens(held, text, _asking())
    tok, low, s, e = F.col("token"), F.col("low"), F.col("start"), F.col("end")
    prev, plow, ps = F.col("before"), F.col("before_low"), F.col("before_start")
    pair, both = F.concat(plow, F.lit(" "), low), F.concat(prev, F.lit(" "), tok)
    bare = F.regexp_replace(tok, r"[!-/:-@\[-`{-~]+$", "")
    marks = F.substring(tok, F.length(bare) + 1, F.length(tok))
    word = L.lower(bare)
    expected = lambda w: F.concat(F.lit("m"), L.harmony_i(L.last_vowel(w)))
    stem = F.substring(word, F.lit(1), F.length(word) - 2)
    own = F.right(word, F.lit(2))
    merged = F.when(
        own.isin("mi", "mı", "mu", "mü") & (F.octet_length(stem) > 2) & (own == expected(stem)) & F.rlike(stem, F.lit("[rnkzdtmşl]$")),
        F.concat(F.substring(bare, F.lit(1), F.length(bare) - 2), F.lit(" "), own, marks),
    )
    person = F.regexp_extract(word, f"^(?s:.*?)({'|'.join(sorted(QUESTION, key=len, reverse=True))})$", 1)
    personal = F.when(
        (person != "") & (F.octet_length(word) - F.octet_length(person) > 2),
        F.concat(F.substring(bare, F.lit(1), F.length(bare) - F.length(person)), F.lit(" "), person, marks),
    )
    wrong = F.when(word.isin("mi", "mı", "mu", "mü") & (word != expected(plow)), F.concat(expected(plow), marks))
    de = F.when(low.isin("te", "ta") & prev.isNotNull(), F.when(L.is_front(L.last_vowel(plow)) | L.last_vowel(plow).isNull(), "de").otherwise("da"))
    split = F.when(low.isin("da", "de", "dan", "den", "nda", "nde") & plow.isin(LOCATIVE), F.concat(prev, tok))
    ki = F.when((low == "ki") & F.concat(plow, F.lit("ki")).isin(WITH_KI_ATTACHED), _cased(prev, F.concat(plow, F.lit("ki"))))
    modal = F.when(F.rlike(low, F.lit(f"^({'|'.join(BIL)})")) & F.rlike(plow, F.lit("[ae]$")) & (F.octet_length(plow) >= 3), F.concat(prev, tok))
    narrow = F.regexp_extract(low, f"({'|'.join(NARROWED)})$", 1)
    # suffixes are tried in the list's order, not the longest first
    fixed = reduce(lambda c, kv: c.when(low.endswith(kv[0]), F.concat(F.substring(low, F.lit(1), F.length(low) - len(kv[0])), F.lit(kv[1]))), list(NARROWED.items())[1:], F.when(low.endswith("mıyanlar"), F.concat(F.substring(low, F.lit(1), F.length(low) - 8), F.lit("mayanlar"))))
    lettered = F.rlike(low, F.lit(r"\p{IsAlphabetic}"))
    sound = F.when(
        lettered,
        F.coalesce(
            _first(s, e, "VowelDropping", tok, _cased(tok, _rooted(low, DROPPED)), 90),
            _first(s, e, "VowelHarmony", tok, F.when(narrow != "", _cased(tok, fixed)), 90),
            _first(s, e, "VowelDropping", tok, _cased(tok, _map(SPOKEN, low)), 90),
            _first(s, e, "ConsonantSoftening", tok, _cased(tok, _rooted(low, SOFTENED)), 90),
        ),
    )
    found = F.array_compact(
        F.array(
            _first(s, e, "Capitalization", tok, F.when((F.col("pos") == 0) & F.rlike(tok, F.lit(r"^\p{IsLowercase}")), L.title(tok)), 10),
            _first(s, e, "ParticleMi", tok, merged, 20),
            _first(s, e, "ParticleMi", tok, personal, 21),
            _first(s, e, "ParticleMi", tok, wrong, 22),
            _first(s, e, "CliticDeDa", tok, de, 30),
            _first(s, e, "CliticDeDa", tok, _cased(tok, _map(WITH_DE, low)), 31),
            _first(ps, e, "CliticDeDa", both, split, 32),
            _first(ps, e, "CliticKi", both, ki, 40),
            _first(s, e, "CliticKi", tok, _cased(tok, _map(WITH_KI, low)), 41),
            _first(s, e, "ReduplicationOrthography", tok, _map(DOUBLES, low), 60),
            _first(ps, e, "CompoundWordOrthography", both, modal, 70),
            _first(ps, e, "CompoundWordOrthography", both, _cased(prev, _map(INDEFINITE, pair)), 80),
            sound,
            _first(s, e, "CompoundWordOrthography", tok, _map(APART, low), 110),
            _first(ps, e, "CompoundWordOrthography", both, _map(TOGETHER, pair), 111),
        )
    )
    return rows.select(ROW, F.explode(found).alias("f")).select(ROW, "f.*")


#: What stands around an apostrophe that a rule finds.
_DERIVED = "[lL](?:[eEaA][rR]|[ıIiİuUüÜ])"
_APOSTROPHE = rf"(?:{_DERIVED}|[lL][ıIiİuUüÜ][kK\u212a]|[gG][iİ][lL])'\p{{IsAlphabetic}}|'(?:{_DERIVED}|[sS][ıIiİuUüÜ][zZ])|[345]'[dD][eEaA]"


def apostrophe_findings(held: DataFrame, text: str = "text") -> DataFrame:
    """Doubled ordinals (the first of each kind), number suffixes that must harden, suffixes that take no apostrophe."""
    t = F.col(text)
    each = []
    ordered = held.where(F.contains(t, F.lit(".'")))
    for i, mark in enumerate(ORDINAL):
        at = F.locate(mark, t)
        number = F.regexp_extract(F.substring(t, F.lit(1), at - 1), "(?s)([0-9]+)$", 1)
        there = (at > 0) & (number != "")
        start = at - 1 - F.length(number)
        each.append(_first(start, at - 1 + len(mark), "ApostropheNumberDate", F.concat(number, F.lit(mark)), F.when(there, F.concat(number, F.lit(mark[1:]))), 50 + i))
    doubled = ordered.select(ROW, F.explode(F.array_compact(F.array(*each))).alias("f")).select(ROW, "f.*")
    part = r"[^\p{IsWhite_Space}.,(\"!]+"
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(part), 0).alias("part"), T.match_ends(t, part).alias("end"))
    rows = held.where(F.contains(t, F.lit("'")) & F.rlike(t, F.lit(_APOSTROPHE))).select(ROW, F.explode(F.filter(pairs, lambda p: F.contains(p["part"], F.lit("'")))).alias("r"))
    rows = rows.select(ROW, "r.part", (F.col("r.end") - F.length("r.part")).cast("long").alias("begin"))
    marks = F.filter(F.sequence(F.lit(1), F.length("part")), lambda i: F.substring(F.col("part"), i, F.lit(1)) == "'")
    at = rows.select(ROW, "part", "begin", F.explode(marks).alias("at"))
    root = F.substring("part", F.lit(1), F.col("at") - 1)
    suffix = F.regexp_extract(F.substring("part", F.col("at") + 1, F.length("part")), r"^\p{IsAlphabetic}+", 0)
    at = at.select(ROW, "begin", root.alias("root"), suffix.alias("suffix")).where("root != '' and suffix != ''")
    root, suffix = F.col("root"), F.col("suffix")
    number = F.rlike(root, F.lit("^[0-9]+$"))
    hard = F.when(number & F.rlike(root, F.lit("[345]$")) & F.rlike(L.lower(suffix), F.lit("^d[ea]")), F.concat(root, F.lit("'t"), F.substring(L.lower(suffix), 2, 1), F.substring(suffix, F.lit(3), F.length(suffix))))
    joined = F.when(~number & (F.rlike(L.lower(root), F.lit(_DERIVED_ROOT)) | F.rlike(L.lower(suffix), F.lit(_DERIVED_SUFFIX))), F.concat(root, suffix))
    stop = F.col("begin") + F.length(root) + 1 + F.length(suffix)
    original = F.concat(root, F.lit("'"), suffix)
    found = F.coalesce(_first(F.col("begin"), stop, "ApostropheNumberDate", original, hard, 58), _first(F.col("begin"), stop, "ApostropheProperNoun", original, joined, 58))
    return doubled.union(at.select(ROW, found.alias("f")).where("f is not null").select(ROW, "f.*"))


def tautologies(held: DataFrame, text: str = "text") -> DataFrame:
    """The first of each doubled expression, anywhere in a text."""
    held = held.where(F.rlike(text, F.lit("|".join(map(T.any_case, TWICE)).replace("[kK]", "[kK\u212a]"))))
    low = L.lower(text)
    each = []
    for i, (phrase, better) in enumerate(TWICE.items()):
        at = F.locate(phrase, low)
        each.append(_first(at - 1, at - 1 + len(phrase), "TautologyRedundancy", F.substring(F.col(text), at, F.lit(len(phrase))), F.when(at > 0, F.lit(better)), 120 + i))
    return held.select(ROW, F.explode(F.array_compact(F.array(*each))).alias("f")).select(ROW, "f.*")


#: What a word must end with for a rule on its parses.
ASKING = "de da te ta ki dan den dı di du dü dır dir dur dür ca ce yor lar ler".split()
_ASKS = "(de|da|te|ta|ki|d[ae]n|d[ıiuü]r?|c[ae]|[ae]yor|l[ae]r)$"


def word_fixes(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(low, ord, category, drop, tail, whole): what is wrong with a word in lower case by its and its stems' parses.

    ``whole`` replaces the word, in its case; else its last ``drop`` letters give way to ``tail``.
    """
    low = F.col("low")
    less = lambda n: F.substring(low, F.lit(1), F.length(low) - n)
    none = F.lit(None).cast("string")

    def ask(order: int, on: Column, stem: Column, other: Column = none) -> Column:
        return F.when(on, F.struct(F.lit(order).alias("ord"), stem.alias("ask"), other.alias("other")))

    hard = F.regexp_extract(low, f"^(.*[{L.HARD}])(d[ae]n?|d[ıiuü]r?|c[ae])$", 1)
    assimilated = F.concat(hard, F.translate(F.substring(low, F.length(hard) + 1, F.lit(1)), "dc", "tç"), F.substring(low, F.length(hard) + 2, F.length(low)))
    vowel = L.last_vowel(less(3))
    plural = F.concat(less(3), F.when(L.is_front(vowel), "ler").otherwise("lar"))
    narrowed = F.concat(less(4), F.coalesce(L.harmony_i(L.last_vowel(less(4))), F.lit("ı")), F.lit("yor"))
    asks = F.array_compact(
        F.array(
            ask(33, F.rlike(low, F.lit("[dt][ea]$")) & (F.octet_length(low) > 4), less(2)),
            ask(42, low.endswith("ki") & (F.octet_length(low) > 4) & ~low.isin(WITH_KI_ATTACHED), less(2)),
            ask(89, (hard != "") & (F.octet_length(hard) > 2), hard, assimilated),
            ask(91, F.rlike(low, F.lit("[ae]yor$")) & (F.length(low) > 4), less(3), narrowed),
            ask(92, F.rlike(low, F.lit("l[ae]r$")) & vowel.isNotNull() & (plural != low), plural, plural),
            # what rule 92 must not find
            ask(93, F.rlike(low, F.lit("l[ae]r$")) & vowel.isNotNull() & (plural != low), low),
        )
    )
    asked = words.select("low").distinct().select("low", F.explode(asks).alias("q")).select("low", "q.*")
    finite = F.exists("tags", lambda t: F.rlike(t, F.lit("Past|Pres|Fut|Aor|Cond")))
    facts = analyses(asked.select(F.col("ask").alias("word")), lexicon).groupBy(F.col("word").alias("ask")).agg(
        F.max(F.col("pos") == "Verb").alias("verb"), F.max((F.col("pos") == "Verb") & finite).alias("finite"), F.max((F.col("pos") == "Noun") & (F.array_join("tags", "+") == "Noun")).alias("bare")
    )
    met = asked.join(facts, "ask").where(
        ((F.col("ord") == 33) & F.col("finite") & ~F.col("bare")) | (F.col("ord").isin(42, 91) & F.col("verb")) | F.col("ord").isin(89, 92, 93)
    )
    parsed = met.where("ord = 93").select("low").withColumn("parsed", F.lit(True))
    met = met.where("ord < 93").join(parsed, "low", "left").where("ord != 92 or parsed is null")
    clitic = F.when(L.is_front(L.last_vowel("ask")) | L.last_vowel("ask").isNull(), " de").otherwise(" da")
    category = F.when(F.col("ord") == 33, "CliticDeDa").when(F.col("ord") == 42, "CliticKi").when(F.col("ord") == 89, "ConsonantAssimilation").otherwise("VowelHarmony")
    tail = F.when(F.col("ord") == 33, clitic).when(F.col("ord") == 42, " ki")
    return met.select("low", "ord", category.alias("category"), F.lit(2).alias("drop"), tail.alias("tail"), F.col("other").alias("whole"))


def word_findings(held: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(_row, finding...) of the rules on a word's parses: clitics on verbs, assimilation, narrowing, harmony of plurals."""
    rows = _tokens(held, text, _ending(ASKING)).select(ROW, "token", "low", "start", "end").where(F.rlike("low", F.lit(_ASKS)))
    met = rows.join(word_fixes(rows, lexicon), "low")
    tok = F.col("token")
    better = F.when(F.col("whole").isNotNull(), _cased(tok, F.col("whole"))).otherwise(F.concat(F.substring(tok, F.lit(1), F.length(tok) - F.col("drop")), F.col("tail")))
    return met.select(ROW, "start", "end", "category", tok.alias("original"), better.alias("replacement"), "ord")


def agreements(words: list[str], ends: list[int], parses: list[list[dict]]) -> list[tuple[int, int, str, str, str, int]]:
    """Findings on agreement over a text's words, their ends and their parses."""
    low = [w.replace("I", "ı").replace("İ", "i").lower() for w in words]
    chosen, out = choose(words, parses), []
    plural = lambda w: w.endswith(("ler", "lar"))
    has = lambda p, *tags: any(x in t for t in p["tags"] for x in tags)

    def add(i: int, category: str, better: str, order: int) -> None:
        out.append((ends[i] - len(words[i]), ends[i], category, words[i], better, order))

    for i, (w, nxt) in enumerate(zip(low, low[1:], strict=False), 1):
        p = chosen[i]
        if (w in QUANTITY or re.fullmatch("[0-9]+", w)) and plural(nxt) and len(nxt) > 3 and p["secondary"] != "ProperNoun" and (p["pos"] == "Noun" or has(p, "A3pl")):
            add(i, "QuantityPluralClash", words[i][:-3], 100)
        if w == "benim" and any(q["pos"] == "Noun" and not has(q, "P1sg", "P2sg", "P3sg") for q in parses[i]):
            vowels = [c for c in nxt if c in "aeıioöuüâîû"]
            close = {"a": "ı", "ı": "ı", "â": "ı", "o": "u", "u": "u", "û": "u", "ö": "ü", "ü": "ü"}.get(vowels[-1], "i") if vowels else "i"
            add(i, "GenitivePossessiveClash", words[i] + ("m" if nxt[-1] in "aeıioöuüâîû" else close + "m"), 101)
    verbs = [i for i, p in enumerate(chosen) if p["pos"] == "Verb"]
    if low.count("ne") >= 2:
        for i in verbs:
            if has(chosen[i], "Neg"):
                better = low[i]
                for negated, plain in AFFIRMED.items():
                    better = better.replace(negated, plain)
                add(i, "CorrelativeConjunctionPolarity", better, 102)
    if verbs:
        last = verbs[-1]
        if NEGATIVE.intersection(low) and not has(chosen[last], "Neg"):
            add(last, "CorrelativeConjunctionPolarity", words[last], 103)
        if len(words) > 1 and chosen[0]["pos"] == "Noun" and has(chosen[0], "A3pl") and plural(low[last]):
            add(last, "SubjectVerbAgreement", words[last][:-3], 104)
    return out


def agreement_findings(held: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(_row, finding...) of the rules on number, possession, polarity and subjects, in the texts that hold a trigger of one."""
    quantity = F.rlike("before", F.lit("^[0-9]+$")) | L.lower("before").isin(sorted(QUANTITY))
    ends, first = _in("right(token, 3)", ["lar", "ler"]), (F.col("pos") == 0) & F.rlike(L.lower("token"), F.lit("l[ae]r"))
    word = _in("substring(token, 1, 4)", {w[:4] for w in ("benim", *NEGATIVE)}) & L.lower("token").isin(["benim", *sorted(NEGATIVE)])
    ne = _in("token", ["ne"])
    met = rows_before(held, text).where(ends | first | ne | word)
    flags = met.groupBy(ROW).agg(
        F.max((ends & (F.length("token") > 3) & F.coalesce(quantity, F.lit(False))) | word).alias("one"), F.max(first).alias("first"), F.max(ends).alias("last"), F.sum(ne.cast("int")).alias("ne")
    )
    asked = flags.where(F.col("one") | (F.col("first") & F.col("last")) | (F.col("ne") >= 2)).select(ROW)
    some = cut(held.join(asked, ROW, "left_semi"), ROW, text=text).where(F.size("_t") > 1).select(ROW, "_t", "_e")
    each = some.select(ROW, F.posexplode(F.arrays_zip("_t", "_e")).alias("pos", "r")).select(ROW, "pos", F.col("r._t").alias("token"), F.col("r._e").alias("end"))
    listed = parse_lists(each.select(F.col("token").alias("word")), lexicon)
    met = each.join(listed, each["token"] == listed["word"], "left").select(ROW, F.struct("pos", "token", "end", "parses").alias("t"))
    grouped = met.groupBy(ROW).agg(F.array_sort(F.collect_list("t")).alias("t"))
    names = ["start", "end", "category", "original", "replacement", "ord"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, ts in enumerate(batch.column("t").to_pylist()):
                found = agreements([t["token"] for t in ts], [t["end"] for t in ts], [t["parses"] or [] for t in ts])
                at += [i] * len(found)
                out += found
            cols = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(ROW).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [ROW, *names])

    return grouped.mapInArrow(run, f"{ROW} long, {FINDING}")


def _listed(held: DataFrame, lexicon: DataFrame | None, text: str) -> DataFrame:
    """(_row, f): all findings of each row that has some, by start, then rule; one for each run of equal spans."""
    every = token_findings(held, text).union(apostrophe_findings(held, text)).union(tautologies(held, text))
    if lexicon is not None:
        every = every.union(word_findings(held, lexicon, text)).union(agreement_findings(held, lexicon, text))
    one = F.struct("start", "ord", "end", "category", "original", "replacement")
    listed = every.groupBy(ROW).agg(F.array_sort(F.collect_list(one)).alias("_f"))
    before = lambda i, c: F.get("_f", i - 1)[c]
    new = F.filter("_f", lambda f, i: (i == 0) | (before(i, "start") != f["start"]) | (before(i, "end") != f["end"]))
    return listed.select(ROW, new.alias("f"))


def findings(docs: DataFrame, lexicon: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, category, original, replacement) of all rules; those on parses only with a lexicon."""
    held = rowed(docs, key, text)
    rows = held.select(ROW, key).join(_listed(held, lexicon, text), ROW).select(key, F.explode("f").alias("f"))
    return rows.select(key, *[f"f.{c}" for c in ("start", "end", "category", "original", "replacement")])


def corrected(docs: DataFrame, lexicon: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_findings, corrected): one row for each of ``docs``, replacements spliced into its text from the end."""
    held = rowed(docs, key, text)
    out = held.join(_listed(held, lexicon, text), ROW, "left")
    splice = lambda s, f: F.concat(F.substring(s, F.lit(1), f["start"].cast("int")), f["replacement"], F.substring(s, (f["end"] + 1).cast("int"), F.lit(2**31 - 1)))
    whole = F.when(F.col("f").isNull(), F.col(text)).otherwise(F.aggregate(F.reverse("f"), F.col(text), splice))
    return out.select(key, F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("n_findings"), whole.alias("corrected"))
