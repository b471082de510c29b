"""Queries on letters, sounds, case and number words, over the distinct words of ``documents`` and numbers of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import numerals as N

SPACE = r"[\x20\x09-\x0D]+"
#: DuckDB: distinct words. Turkish case there, where upper('ß') is not SS.
WORDS = r"(SELECT DISTINCT unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS word FROM documents)"


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.split("text", SPACE)).alias("word")).where("word != ''").distinct()


def sql_lower(x: str) -> str:
    return f"lower(translate({x}, 'Iİ', 'ıi'))"


def sql_upper(x: str) -> str:
    return f"upper(translate(replace({x}, 'ß', 'SS'), 'ıi', 'Iİ'))"


def sql_title(x: str) -> str:
    part = r"regexp_extract_all({}, '[\s\x{{a0}}\-/(\"'']|[^\s\x{{a0}}\-/(\"'']+')".format(x)
    return f"array_to_string(list_transform({part}, lambda p: {sql_upper('p[1:1]')} || {sql_lower('p[2:]')}), '')"


def sql_vowels(x: str) -> str:
    return f"regexp_replace({x}, '[^{L.VOWELS}]', '', 'g')"


def sql_last_vowel(x: str) -> str:
    return f"nullif({sql_vowels(x)}[-1:], '')"


def sql_harmony_i(x: str) -> str:
    v = sql_last_vowel(x)
    return f"CASE WHEN {v} IS NULL THEN 'i' WHEN regexp_matches({v}, '[öüÖÜ]') THEN 'ü' WHEN regexp_matches({v}, '[{L.FRONT}]') THEN 'i' WHEN regexp_matches({v}, '[{L.ROUNDED}]') THEN 'u' ELSE 'ı' END"


def sql_cuts(x: str) -> str:
    """The places behind which a syllable ends: max(v1 + 1, v2 - 1) of neighbouring vowels, counted from 1."""
    at = f"list_filter(range(1, length({x}) + 1), lambda i: contains('{L.VOWELS}', {x}[i:i]))"
    return f"list_transform(range(1, len({at})), lambda k: greatest(({at})[k], ({at})[k + 1] - 2))"


def sql_syllables(x: str, mark: str) -> str:
    cuts = sql_cuts(x)
    return f"array_to_string(list_transform(range(1, length({x}) + 1), lambda j: {x}[j:j] || CASE WHEN list_contains({cuts}, j) THEN '{mark}' ELSE '' END), '')"


def letter_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words_of(spark, sf_dir).select("word", L.lower(w).alias("low"), L.upper(w).alias("up"), L.title(w).alias("title"), L.fold(w).alias("folded"))


def letter_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(L.title("text")).alias("title_md5"))


def letter_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    rows = words_of(spark, sf_dir).select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").agg(F.count("*").alias("n"))
    flags = {"vowel": L.is_vowel, "back": L.is_back, "front": L.is_front, "rounded": L.is_rounded, "unrounded": L.is_unrounded, "hard": L.is_hard, "soft": L.is_soft}
    return rows.select("c", "n", *[f(c).alias(k) for k, f in flags.items()], L.lower_letter(c).alias("low"), L.upper_letter(c).alias("up"), L.harden(c).alias("hardened"), L.soften(c, F.lit(False)).alias("softened"), L.soften(c, F.lit(True)).alias("softened_nk"), L.harmony_a(c).alias("a_type"), L.harmony_i(c).alias("i_type"))


def harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words_of(spark, sf_dir).select("word", L.syllable_count(w).alias("vowels"), L.first_vowel(w).alias("first"), L.last_vowel(w).alias("last"), L.suffix_a(w).alias("a_vowel"), L.suffix_i(w).alias("i_vowel"), L.major_harmony(w).alias("major"), L.minor_harmony(w).alias("minor"))


def stem_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words_of(spark, sf_dir).select("word", L.soften_stem(w).alias("softened"), L.drop_vowel(w).alias("dropped"), L.double_last(w).alias("doubled"), L.needs_buffer(w, F.lit("ım")).alias("buffer"), L.hardens(w).alias("hardens"))


def syllabify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return words_of(spark, sf_dir).select("word", F.size(L.syllables(w)).cast("long").alias("n"), L.hyphenate(w).alias("hyphenated"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey") * F.when(F.col("o_orderkey") % 3 == 0, -1_000_003).otherwise(7_919_000_017)
    return orders.select("o_orderkey", N.number_words("o_orderkey").alias("words"), N.number_words(n).alias("large"), N.ordinal_words("o_orderkey").alias("ordinal"))


def currency_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", N.currency_words("o_totalprice").alias("lira"), N.currency_words("o_totalprice", "USD").alias("dollar"))


def words_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    words = N.number_words("o_orderkey")
    return orders.select("o_orderkey", N.words_number(words).alias("back"), N.words_number(F.concat(words, F.lit(" elma"))).alias("none"))


def _sql_number(n: str) -> str:
    digits = "[" + ", ".join(f"'{w}'" for w in N.DIGITS) + "]"
    tens = "[" + ", ".join(f"'{w}'" for w in N.TENS) + "]"
    size, parts = f"abs({n})", []
    for k in reversed(range(len(N.SCALES))):
        g = f"(({size} // {1000**k}) % 1000)"
        three = [
            f"CASE WHEN {g} // 100 > 1 THEN {digits}[{g} // 100 + 1] END",
            f"CASE WHEN {g} // 100 > 0 THEN 'yüz' END",
            f"CASE WHEN {g} % 100 // 10 > 0 THEN {tens}[{g} % 100 // 10 + 1] END",
            f"CASE WHEN {g} % 10 > 0 {'AND ' + g + ' <> 1' if k == 1 else ''} THEN {digits}[{g} % 10 + 1] END",
        ]
        parts += three + ([f"CASE WHEN {g} > 0 THEN '{N.SCALES[k]}' END"] if k else [])
    return f"CASE WHEN {n} = 0 THEN 'sıfır' WHEN {n} < 0 THEN 'eksi ' || concat_ws(' ', {', '.join(parts)}) ELSE concat_ws(' ', {', '.join(parts)}) END"


def _sql_ordinal(words: str) -> str:
    ends = " ".join(f"WHEN '{w}' THEN '{e}'" for w, e in N.ORDINALS.items())
    last = f"list_last(string_split({words}, ' '))"
    return f"CASE WHEN {last} = 'dört' THEN {words}[:-2] || 'd' ELSE {words} END || CASE {last} {ends} ELSE 'inci' END"


_C = f"CASE WHEN regexp_matches(c, '^[{L.FRONT}]$') "
QUERIES = {
    "letter_case": (letter_case, f"SELECT word, {sql_lower('word')} AS low, {sql_upper('word')} AS up, {sql_title('word')} AS title, translate(word, '{L.FOLDED[0]}', '{L.FOLDED[1]}') AS folded FROM {WORDS} WHERE word <> ''"),
    "letter_title": (letter_title, f"SELECT doc_id, md5({sql_title('text')}) AS title_md5 FROM documents"),
    "letter_classes": (
        letter_classes,
        f"""SELECT c, count(*) AS n, {', '.join(f"regexp_matches(c, '^[{s}]$') AS {k}" for k, s in (('vowel', L.VOWELS), ('back', L.BACK), ('front', L.FRONT), ('rounded', L.ROUNDED), ('unrounded', L.UNROUNDED), ('hard', L.HARD), ('soft', L.SOFT)))},
        translate(c, 'ABCDEFGHJKLMNOPQRSTUVWXYZIİ', 'abcdefghjklmnopqrstuvwxyzıi') AS low, translate(c, 'abcdefghjklmnopqrstuvwxyzıi', 'ABCDEFGHJKLMNOPQRSTUVWXYZIİ') AS up,
        translate(c, 'dcgDCG', 'tçkTÇK') AS hardened, translate(c, 'pçtkPÇTK', 'bcdğBCDĞ') AS softened, translate(c, 'pçtkPÇTK', 'bcdgBCDG') AS softened_nk,
        {_C} THEN 'e' ELSE 'a' END AS a_type, {_C} AND regexp_matches(c, '^[{L.ROUNDED}]$') THEN 'ü' WHEN regexp_matches(c, '^[{L.FRONT}]$') THEN 'i' WHEN regexp_matches(c, '^[{L.ROUNDED}]$') THEN 'u' ELSE 'ı' END AS i_type
        FROM (SELECT unnest(list_transform(range(1, length(word) + 1), lambda i: word[i:i])) AS c FROM {WORDS} WHERE word <> '') GROUP BY c""",
    ),
    "harmony": (
        harmony,
        f"""SELECT word, length({sql_vowels('word')}) AS vowels, nullif({sql_vowels('word')}[1:1], '') AS first, {sql_last_vowel('word')} AS last,
        CASE WHEN {sql_last_vowel('word')} IS NULL OR regexp_matches({sql_last_vowel('word')}, '[{L.FRONT}]') THEN 'e' ELSE 'a' END AS a_vowel, {sql_harmony_i('word')} AS i_vowel,
        NOT (regexp_matches(word, '[{L.BACK}]') AND regexp_matches(word, '[{L.FRONT}]')) AS major,
        NOT regexp_matches({sql_vowels('word')}, '[{L.UNROUNDED}][^{L.UNROUNDED}]|[{L.ROUNDED}][^aeuü]') AS minor FROM {WORDS} WHERE word <> ''""",
    ),
    "stem_changes": (
        stem_changes,
        f"""SELECT word, word[:-2] || CASE WHEN regexp_matches(word, '[nN][kK]$') THEN translate(word[-1:], 'kK', 'gG') ELSE translate(word[-1:], 'pçtkPÇTK', 'bcdğBCDĞ') END AS softened,
        CASE WHEN length(word) >= 3 AND regexp_matches(word[-2:-2], '[ıiuü]') THEN word[:-3] || word[-1:] END AS dropped, word || word[-1:] AS doubled,
        regexp_matches(word, '[{L.VOWELS}]$') AS buffer, regexp_matches(word, '[{L.HARD}]$') AS hardens FROM {WORDS} WHERE word <> ''""",
    ),
    "syllabify": (syllabify, f"SELECT word, greatest(1, len({sql_cuts('word')}) + 1)::BIGINT AS n, {sql_syllables('word', '-')} AS hyphenated FROM {WORDS} WHERE word <> ''"),
    "number_words": (
        number_words,
        f"""WITH w AS (SELECT o_orderkey, {_sql_number('o_orderkey')} AS words, {_sql_number('big')} AS large
        FROM (SELECT o_orderkey, o_orderkey * CASE WHEN o_orderkey % 3 = 0 THEN -1000003 ELSE 7919000017 END AS big FROM orders))
        SELECT *, {_sql_ordinal('words')} AS ordinal FROM w""",
    ),
    "currency_words": (
        currency_words,
        f"""WITH p AS (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, floor((o_totalprice - trunc(o_totalprice)) * 100 + 0.5)::BIGINT AS cents FROM orders),
        w AS (SELECT o_orderkey, {_sql_number('whole')} AS a, CASE WHEN cents > 0 THEN {_sql_number('cents')} END AS b FROM p)
        SELECT o_orderkey, concat_ws(' ', a, 'lira', b, CASE WHEN b IS NOT NULL THEN 'kuruş' END) AS lira, concat_ws(' ', a, 'dolar', b, CASE WHEN b IS NOT NULL THEN 'sent' END) AS dollar FROM w""",
    ),
    "words_number": (words_number, "SELECT o_orderkey, o_orderkey AS back, NULL::BIGINT AS none FROM orders"),
}
