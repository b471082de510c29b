"""Tokens and sentences of Turkish text as Column expressions.

One ordered alternation consumes every place of a text that isn't white space, so the first alternative that fits at a
place names the token there. Offsets are in code points; :func:`byte_offset` turns them into UTF-8 offsets.
Null in, null out; the empty text has no tokens and no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .letters import _col, bound, lower

# Abbreviations whose full stop belongs to them.
ABBREVIATIONS = (
    "prof. dr. doç. yrd. av. alb. bknz. bkz. cad. co. corp. çev. dak. der. dz. ecz. fak. gen. haz. hrk. hz. iö. is. ist. "
    "itb. ith. kd. kr. kur. kuv. ltd. mah. madr. mak. müh. müteh. no. num. öğr. ör. pa. par. ped. pk. s. say. sf. sn. "
    "soc. sok. st. şb. şer. şrk. tbmm. tc. tck. tel. ter. tes. tic. tl. tug. tüm. üniv. uzm. vb. vd. vol. vs. yy. yard. "
    "yön. yük. yur. zool. km. m. cm. mm. kg. gr. mad. madde. volüm. bk. sy. krş."
).split()
# Words that carry little meaning.
STOPWORDS = (
    "ve veya ile ama ancak fakat lakin çünkü oysa oysaki halbuki madem mademki meğer nitekim zira bu şu o bunlar şunlar "
    "onlar buna şuna ona bunu şunu onu bunda şunda onda bundan şundan ondan ben sen biz siz bana sana bize size beni seni "
    "bizi sizi bende sende bizde sizde benden senden bizden sizden benim senin onun bizim sizin onların gibi kadar için "
    "göre doğru karşı rağmen karşın dolayı ötürü de da ki mi mı mu mü misin mısın musun müsün ya hem ne gerek ister ha "
    "daha en pek çok az fazla gayet oldukça biraz her bazı bütün tüm kimi birçok çoğu hiçbiri herkes kimse şey şeyler biri "
    "birisi başkası diğeri öteki hiç nasıl neden niçin niye kim kime kimde kimden nerede nereye nereden neresi neresini "
    "hangisi kaç kaçı var yok olan olarak eden ederek yapan yapılan edilmiş edilen olduğu olduğunu oldukları olmak etmek "
    "yapmak ise iken idi imiş yine tekrar artık zaten henüz şimdi"
).split()

TAG = "[a-zA-Z0-9_çğıöşüÇĞİÖŞÜ]+"
URL = r"https?://[^{S}/$.?#].[^{S}]*|www\.[^{S}/$.?#].[^{S}]*"
DATE = "[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"
TIME = "[0-9]{1,2}[:.][0-9]{2}(?:[:.][0-9]{2})?"
NUMBER = "[-+]?[0-9]+(?:[.,][0-9]+)*%?"
MAIL = r"[a-zA-Z][a-zA-Z0-9._%+-]*@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: White space and letters in the regular expressions of Spark, and of RE2 for the SQL that DuckDB runs.
SPARK = {"S": r"\p{IsWhite_Space}", "L": r"\p{IsAlphabetic}"}
RE2 = {"S": r"\s\x{a0}\x{85}\x{2000}-\x{200a}\x{3000}\x0b", "L": r"\p{L}"}
_PUNCTUATION = r"""[!-/:-@\[-`{-~…“”‘’—–]"""


def any_case(word: str) -> str:
    """A pattern for a Turkish word in either case: no flag, so i and ı stay apart."""
    pairs = {"i": "[iİ]", "ı": "[ıI]", ".": r"\."}
    return "".join(pairs.get(c, f"[{c}{c.upper()}]" if c.isalpha() else c) for c in word)


def _classes(pattern: str, dialect: dict[str, str]) -> str:
    return pattern.replace("{S}", dialect["S"]).replace("{L}", dialect["L"])


def token_pattern(dialect: dict[str, str] = SPARK) -> str:
    short = "|".join(map(any_case, sorted(ABBREVIATIONS, key=lambda a: (-len(a), a))))
    whole = f"#{TAG}|@{TAG}|{URL}|{DATE}|{TIME}|{NUMBER}|{MAIL}|(?:{short})|{{L}}+(?:['’]{{L}}+)*|[^{{S}}]"
    return _classes(whole, dialect)


#: What Unicode calls white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def quick_pattern() -> str:
    """A pattern with the matches of :func:`token_pattern` in Spark's dialect, found sooner.

    Letters before a space, a line feed or a comma are a word, whatever the other alternatives say. An abbreviation is five
    letters or fewer and a dot, and no other begins it, so the list is looked through only there, in any order.
    """
    short = "|".join(map(any_case, ABBREVIATIONS))
    mail = MAIL.replace("%+-]*@", "%+-]*+@")
    whole = rf"{{L}}++(?=[ \n,])|#{TAG}|@{TAG}|(?=[hw])(?:{URL})|(?=[-+0-9])(?:{DATE}|{TIME}|{NUMBER})|{mail}|(?=[^{{S}}.]{{1,5}}+\.)(?:{short})|{{L}}+(?:['’]{{L}}+)*|[^{{S}}]"
    return _classes(whole, SPARK)


def words(text: Column | str) -> Column:
    """The texts of all tokens, marks included."""
    return F.regexp_extract_all(_col(text), F.lit(quick_pattern()), 0)


def pieces(text: Column | str) -> Column:
    """All tokens, each with the white space before it: nothing else stands between them."""
    return F.regexp_extract_all(_col(text), F.lit(_classes("{S}*+", SPARK) + f"(?:{quick_pattern()})"), 0)


def bare(piece: Column) -> Column:
    """The token of a piece."""
    return F.ltrim(piece, F.lit(SPACES))


def kind(token: Column | str) -> Column:
    """The type of a token's text."""
    t, fits = _col(token), lambda p: F.rlike(_col(token), F.lit(r"\A(?:" + _classes(p, SPARK) + r")\z"))
    return (
        F.when(fits(f"#{TAG}"), "Hashtag")
        .when(fits(f"@{TAG}"), "Mention")
        .when(fits("(?s:" + URL + ")"), "Url")
        .when(fits(DATE), "Date")
        .when(fits(TIME), "Time")
        .when(fits(NUMBER), "Number")
        .when(fits(MAIL), "Email")
        .when(fits(r"{L}+\."), "Abbreviation")
        .when(fits("{L}+"), "Word")
        .when(fits("{L}.*"), "ProperNounWithApostrophe")
        .when(fits(_PUNCTUATION), "Punctuation")
        .when(t.isNotNull(), "Symbol")
    )


#: Sizes are added up in blocks of so many, so that no array is built up one by one over a whole text.
_BLOCK = 32


def running(sizes: Column) -> Column:
    """The running sums of an array of integers."""
    grow = lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))
    zero = F.array(F.lit(0))

    def summed(xs: Column, levels: int) -> Column:
        if not levels:
            return F.slice(F.aggregate(xs, zero, grow), F.lit(2), F.size(xs))
        block = lambda b: F.aggregate(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)), zero, grow)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), block)
        more = lambda b, before: F.transform(F.slice(b, F.lit(2), F.lit(_BLOCK)), lambda x: x + before)

        def placed(bs: Column) -> Column:
            totals = bound(F.transform(bs, lambda b: F.element_at(b, -1)), lambda t: summed(t, levels - 1))
            return F.flatten(F.zip_with(bs, F.slice(F.concat(zero, totals), F.lit(1), F.size(bs)), more))

        return bound(blocks, placed)

    return bound(sizes, lambda xs: F.when(F.size(xs) > 0, summed(xs, 2)).when(xs.isNotNull(), F.array().cast("array<int>")))


def match_ends(text: Column, pattern: str) -> Column:
    """Where each match of a pattern ends, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    return running(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g)))


def ends(text: Column | str) -> Column:
    """Where each token ends, in code points."""
    return running(F.transform(pieces(text), lambda p: F.length(p)))


def tokens(text: Column | str) -> Column:
    """Tokens as (text, token_type, start, end), in code points from 0."""
    both = F.arrays_zip(words(text).alias("t"), ends(text).alias("e"))
    return F.transform(both, lambda x: F.struct(x["t"].alias("text"), kind(x["t"]).alias("token_type"), (x["e"] - F.length(x["t"])).alias("start"), x["e"].alias("end")))


def is_wordlike(token: Column) -> Column:
    """Whether a token is neither Punctuation nor Symbol: these have one character, no letter and no digit."""
    return (F.length(token) > 1) | F.rlike(token, F.lit(r"^[\p{IsAlphabetic}0-9]"))


def byte_offset(text: Column | str, at: Column) -> Column:
    """The UTF-8 offset of a code-point offset."""
    return F.octet_length(F.substring(_col(text), F.lit(1), at))


def sentence_codes(tokens_: Column) -> Column:
    """A letter for each token: E ends a sentence, D is a further dot, Q closes, x is anything else."""
    before = lambda i: F.when(i > 0, F.get(tokens_, i - 1))

    def code(t: Column, i: Column) -> Column:
        last, after = before(i), F.get(tokens_, i + 1)
        short = F.coalesce(F.rlike(last, F.lit(_classes(r"^{L}.*\.$", SPARK))) & ~F.rlike(last, F.lit(r"^(?:https?://|www\.)")), F.lit(False))
        number = F.coalesce(F.rlike(last, F.lit(f"^(?:{NUMBER})$")) & ~F.rlike(last, F.lit(f"^(?:{DATE}|{TIME})$")) & F.rlike(after, F.lit(r"^\p{IsLowercase}\p{IsAlphabetic}*$")), F.lit(False))
        return (
            F.when(F.octet_length(t) > 3, "x")
            .when(t.isin(*"!?…"), "E")
            .when((t == ".") & (short | number), "D")
            .when(t == ".", "E")
            .when(t.isin(*"\"”’')]»"), "Q")
            .otherwise("x")
        )

    return F.array_join(F.transform(tokens_, code), "")


def sentence_sizes(tokens_: Column) -> Column:
    """The number of tokens of each sentence."""
    return F.transform(F.regexp_extract_all(sentence_codes(tokens_), F.lit("[^E]*E[ED]*Q*|.+$"), 0), lambda s: F.length(s))


def is_stopword(word: Column | str) -> Column:
    return lower(word).isin(sorted(set(STOPWORDS)))


def without_stopwords(tokens_: Column, more: tuple[str, ...] = ()) -> Column:
    """Tokens that are no stopwords, in their own case; ``more`` are added to the list."""
    held = F.array(*map(F.lit, sorted({*STOPWORDS, *more})))
    return F.filter(tokens_, lambda t: ~F.array_contains(held, lower(t)))
