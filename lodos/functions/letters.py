"""Turkish letters and sounds as Column expressions: case, vowel harmony, consonant change, syllables.

Null in, null out. Upper and lower case follow ``ı/I`` and ``i/İ``; other letters follow Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Turkish alphabet and its classes.
LOWER = "abcçdefgğhıijklmnoöprsştuüvyz"
UPPER = "ABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ"
VOWELS = "aeıioöuüAEIİOÖUÜâîûÂÎÛ"
BACK = "aıouAIOUâûÂÛ"
FRONT = "eiöüEİÖÜîÎ"
ROUNDED = "oöuüOÖUÜûÛ"
UNROUNDED = "aeıiAEIİâîÂÎ"
HARD = "fstkçşhpFSTKÇŞHP"
SOFT = "bcdgğjlmnrvyzBCDGĞJLMNRVYZ"
BUFFERS = ("y", "s", "n", "ş")
FOLDED = ("çÇğĞıİöÖşŞüÜâÂîÎûÛ", "cCgGiIoOsSuUaAiIuU")
_TITLE = r"[\p{IsWhite_Space}\-/(\"']|[^\p{IsWhite_Space}\-/(\"']+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there, and not anew for each element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lower(text: Column | str) -> Column:
    return F.lower(F.translate(_col(text), "Iİ", "ıi"))


def upper(text: Column | str) -> Column:
    return F.upper(F.translate(_col(text), "ıi", "Iİ"))


def lower_letter(char: Column | str) -> Column:
    """Lower case of one letter: Turkish I, İ and A-Z; every other letter is left."""
    return F.translate(_col(char), "ABCDEFGHJKLMNOPQRSTUVWXYZIİ", "abcdefghjklmnopqrstuvwxyzıi")


def upper_letter(char: Column | str) -> Column:
    """Upper case of one letter: Turkish ı, i and a-z; every other letter is left."""
    return F.translate(_col(char), "abcdefghjklmnopqrstuvwxyzıi", "ABCDEFGHJKLMNOPQRSTUVWXYZIİ")


def title(text: Column | str) -> Column:
    """Upper case at the start and behind white space and ``- / ( " '``; lower case elsewhere."""
    parts = F.regexp_extract_all(_col(text), F.lit(_TITLE), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(upper(F.substring(p, 1, 1)), lower(F.substring(p, 2, 2_000_000_000)))), "")


def fold(text: Column | str) -> Column:
    """Turkish letters as their ASCII look-alikes."""
    return F.translate(_col(text), *FOLDED)


def has_only(char: Column | str, letters: str) -> Column:
    """Whether a one-letter text belongs to a class of letters."""
    return F.rlike(_col(char), F.lit(f"^[{letters}]$"))


def is_vowel(char: Column | str) -> Column:
    return has_only(char, VOWELS)


def is_back(char: Column | str) -> Column:
    return has_only(char, BACK)


def is_front(char: Column | str) -> Column:
    return has_only(char, FRONT)


def is_rounded(char: Column | str) -> Column:
    return has_only(char, ROUNDED)


def is_unrounded(char: Column | str) -> Column:
    return has_only(char, UNROUNDED)


def is_hard(char: Column | str) -> Column:
    return has_only(char, HARD)


def is_soft(char: Column | str) -> Column:
    return has_only(char, SOFT)


def vowels(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"[^{VOWELS}]", "")


def syllable_count(text: Column | str) -> Column:
    return F.length(vowels(text)).cast("long")


def first_vowel(text: Column | str) -> Column:
    return F.nullif(F.substring(vowels(text), 1, 1), F.lit(""))


def last_vowel(text: Column | str) -> Column:
    return F.nullif(F.right(vowels(text), F.lit(1)), F.lit(""))


def harmony_a(vowel: Column | str) -> Column:
    return F.when(is_front(vowel), "e").when(_col(vowel).isNotNull(), "a")


def harmony_i(vowel: Column | str) -> Column:
    front, rounded = is_front(vowel), is_rounded(vowel)
    return F.when(front & rounded, "ü").when(front, "i").when(rounded, "u").when(_col(vowel).isNotNull(), "ı")


def suffix_a(stem: Column | str) -> Column:
    """The two-way vowel of a suffix on ``stem``; e without any vowel."""
    return F.when(_col(stem).isNotNull(), F.coalesce(harmony_a(last_vowel(stem)), F.lit("e")))


def suffix_i(stem: Column | str) -> Column:
    """The four-way vowel of a suffix on ``stem``; i without any vowel."""
    return F.when(_col(stem).isNotNull(), F.coalesce(harmony_i(last_vowel(stem)), F.lit("i")))


def major_harmony(word: Column | str) -> Column:
    """No back vowel beside a front vowel."""
    return ~(F.rlike(_col(word), F.lit(f"[{BACK}]")) & F.rlike(_col(word), F.lit(f"[{FRONT}]")))


def minor_harmony(word: Column | str) -> Column:
    """Unrounded vowels are followed by unrounded ones, rounded by a, e, u, ü (in lower case)."""
    return ~F.rlike(vowels(word), F.lit(f"[{UNROUNDED}][^{UNROUNDED}]|[{ROUNDED}][^aeuü]"))


def soften(char: Column | str, after_n: Column) -> Column:
    c = _col(char)
    return F.when(after_n, F.translate(c, "pçtkPÇTK", "bcdgBCDG")).otherwise(F.translate(c, "pçtkPÇTK", "bcdğBCDĞ"))


def harden(char: Column | str) -> Column:
    return F.translate(_col(char), "dcgDCG", "tçkTÇK")


def soften_stem(stem: Column | str) -> Column:
    s = _col(stem)
    return F.concat(F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0))), soften(F.right(s, F.lit(1)), F.rlike(s, F.lit("[nN][kK]$"))))


def drop_vowel(stem: Column | str) -> Column:
    """Without the close vowel before its last letter; null where there is none."""
    return F.when(F.rlike(_col(stem), F.lit(r"(?s).[ıiuü].$")), F.regexp_replace(_col(stem), r"(?s)[ıiuü](.)$", "$1"))


def double_last(stem: Column | str) -> Column:
    return F.concat(_col(stem), F.right(_col(stem), F.lit(1)))


def needs_buffer(stem: Column | str, suffix: Column | str) -> Column:
    """Whether a vowel would meet a vowel."""
    return F.rlike(_col(stem), F.lit(f"[{VOWELS}]$")) & F.rlike(_col(suffix), F.lit(f"^[{VOWELS}]"))


def hardens(stem: Column | str) -> Column:
    """Whether a suffix's first consonant hardens behind ``stem``."""
    return F.rlike(_col(stem), F.lit(f"[{HARD}]$"))


def syllables(word: Column | str) -> Column:
    """Cuts behind a vowel, one letter before the next one where letters stand between; no syllable in the empty word."""
    cut = F.regexp_replace(_col(word), f"(?s)([{VOWELS}][^{VOWELS}]*?)(?=[^{VOWELS}]?[{VOWELS}])", "$1\u0001")
    return F.when(_col(word) == "", F.array().cast("array<string>")).otherwise(F.split(cut, "\u0001", -1))


def hyphenate(word: Column | str, mark: str = "-") -> Column:
    return F.array_join(syllables(word), mark)
