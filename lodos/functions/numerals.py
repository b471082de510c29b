"""Turkish number words as Column expressions. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .letters import _col, lower

# Number words, scales, ordinal endings, currencies.
DIGITS = ("sıfır", "bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz")
TENS = ("", "on", "yirmi", "otuz", "kırk", "elli", "altmış", "yetmiş", "seksen", "doksan")
SCALES = ("", "bin", "milyon", "milyar", "trilyon", "katrilyon", "kentilyon")
ORDINALS = {
    "bir": "inci", "iki": "nci", "üç": "üncü", "dört": "üncü", "beş": "inci", "altı": "ncı", "yedi": "nci", "sekiz": "inci",
    "dokuz": "uncu", "on": "uncu", "yirmi": "nci", "otuz": "uncu", "kırk": "ıncı", "elli": "nci", "altmış": "ıncı",
    "yetmiş": "inci", "seksen": "inci", "doksan": "ıncı", "yüz": "üncü", "bin": "inci", "milyon": "uncu", "milyar": "ıncı",
    "trilyon": "uncu", "sıfır": "ıncı",
}
CURRENCIES = {"TL": ("lira", "kuruş"), "TRY": ("lira", "kuruş"), "USD": ("dolar", "sent"), "$": ("dolar", "sent"), "EUR": ("avro", "sent"), "€": ("avro", "sent"), "GBP": ("sterlin", "peni"), "£": ("sterlin", "peni")}
#: Words that parsing knows; scales beyond these it doesn't.
VALUES = {w: i for i, w in enumerate(DIGITS)} | {w: 10 * i for i, w in enumerate(TENS) if w} | {"yüz": 100, "bin": 1000, "milyon": 10**6, "milyar": 10**9, "trilyon": 10**12}


def _group(group: Column, k: Column) -> Column:
    """The words of one group of three digits with its scale; null where a place is silent."""
    digits, tens = F.array(*map(F.lit, DIGITS)), F.array(*map(F.lit, TENS))
    hundred, ten, one = F.floor(group / 100), F.floor(group % 100 / 10), group % 10
    return F.array(
        F.when(hundred > 1, F.get(digits, hundred.cast("int"))),
        F.when(hundred > 0, F.lit("yüz")),
        F.when(ten > 0, F.get(tens, ten.cast("int"))),
        F.when((one > 0) & ~((k == 1) & (group == 1)), F.get(digits, one.cast("int"))),
        F.when((k > 0) & (group > 0), F.get(F.array(*map(F.lit, SCALES)), k)),
    )


def number_words(n: Column | str) -> Column:
    """1923 -> bin dokuz yüz yirmi üç. The least 64-bit integer, which has no positive counterpart, gives null."""
    n = _col(n).cast("long")
    powers = F.array(*[F.lit(1000**k).cast("long") for k in range(len(SCALES))])

    def words(k: Column) -> Column:
        # differences of remainders stay exact as doubles, and so do their quotients below 1000
        power, above = F.get(powers, k), F.coalesce(n % F.get(powers, k + 1), n)
        return _group(F.round(F.abs(above - n % power) / power).cast("long"), k)

    parts = F.flatten(F.transform(F.sequence(F.lit(len(SCALES) - 1), F.lit(0), F.lit(-1)), words))
    sign = F.array(F.when(n < 0, F.lit("eksi")), F.when(n == 0, F.lit(DIGITS[0])))
    return F.when(n.isNotNull() & (n != F.lit(-(2**63))), F.array_join(F.concat(sign, parts), " "))


def ordinal_words(n: Column | str) -> Column:
    """4 -> dördüncü."""
    words = number_words(n)
    last = F.substring_index(words, " ", -1)
    ending = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])
    stem = F.when(last == "dört", F.concat(F.substring(words, F.lit(1), F.length(words) - 1), F.lit("d"))).otherwise(words)
    return F.concat(stem, F.coalesce(ending[last], F.lit("inci")))


def currency_words(amount: Column | str, currency: str = "TL") -> Column:
    """1250.50 -> bin iki yüz elli lira elli kuruş. Hundredths are left out where they are none or negative."""
    amount = _col(amount).cast("double")
    whole = amount.cast("long")
    rest = (amount - whole.cast("double")) * 100
    cents = F.when(rest >= 0, F.floor(rest + 0.5)).otherwise(-F.floor(-rest + 0.5)).cast("long")
    name, part = CURRENCIES.get(currency.upper(), CURRENCIES["TL"])
    words = F.concat_ws(" ", number_words(whole), F.lit(name), F.when(cents > 0, number_words(cents)), F.when(cents > 0, F.lit(part)))
    return F.when(amount.isNotNull(), words)


def words_number(text: Column | str, strict: bool = False) -> Column:
    """bin dokuz yüz yirmi üç -> 1923. Null, or with ``strict`` an error, for unknown words and empty texts."""
    words = F.filter(F.split(lower(text), r"\p{IsWhite_Space}+"), lambda w: w != "")
    values = F.create_map(*[x for w, v in VALUES.items() for x in (F.lit(w), F.lit(v).cast("long"))])
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(s: Column, v: Column) -> Column:
        some = F.when(s["now"] == 0, 1).otherwise(s["now"]).cast("long")
        return F.struct(
            F.when(v >= 1000, s["total"] + some * v).otherwise(s["total"]).alias("total"),
            F.when(v >= 1000, 0).when(v == 100, some * 100).otherwise(s["now"] + v).cast("long").alias("now"),
        )

    got = F.transform(words, lambda w: F.get(F.array(values[w]), F.lit(0)))
    number = F.aggregate(got, zero, step, lambda s: s["total"] + s["now"])
    number = F.when((F.size(words) > 0) & ~F.exists(got, lambda v: v.isNull()), number)
    if strict:
        number = F.when(number.isNull() & _col(text).isNotNull(), F.raise_error(F.lit("not a number in words")).cast("long")).otherwise(number)
    return number
