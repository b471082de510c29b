"""Readability of Turkish texts: counts by grouped aggregation, formulas as arithmetic.

A word is a token with a letter. Familiar words, lemmas and verbal nouns come from tables; without them every word is
unfamiliar, its own lemma, and no verbal noun. A text without sentences counts as one of no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import letters as L
from .text_tables import ROW, rowed, token_rows

# Conjunctions that make a sentence complex, and the formulas' coefficients and grades.
CONJUNCTIONS = "ve veya yahut ki de da ama fakat lakin ancak çünkü oysa oysaki halbuki ise madem ile".split()
GRADES = ["3. Sınıf Öncesi", "3 ve 4. Sınıf", "5 ve 6. Sınıf", "7 ve 8. Sınıf", "9 ve 10. Sınıf", "11 ve 12. Sınıf", "Lisans", "Lisansüstü"]
#: constant; weights of unfamiliar words, hapax ratio, complex sentences, sentence length, clauses; bounds of the grades
FORMULAS = {
    "f1": (-29.829, {"unfamiliar_ratio": 0.508, "hapax_ratio": 1.191, "complex_ratio": 0.733, "words_per_sentence": -0.660}, (30, 40, 50, 60, 70, 76, 85)),
    "f2": (25.457, {"unfamiliar_ratio": 0.877, "hapax_ratio": 0.668, "words_per_sentence": 0.333}, (35, 45, 55, 60, 64, 70, 85)),
    "f3": (25.153, {"unfamiliar_ratio": 0.834, "hapax_ratio": 0.686, "clause_ratio": 0.226}, (35, 45, 55, 60, 65, 70, 85)),
    "f4": (43.368, {"unfamiliar_ratio": 1.008, "words_per_sentence": 0.624}, (40, 50, 55, 59, 65, 72, 85)),
}
CLASSIC = {
    "atesman": ((90.0, "Çok Kolay (4. Sınıf ve Altı)"), (70.0, "Kolay (5 ve 6. Sınıf)"), (50.0, "Orta Güçlükte (7 ve 8. Sınıf)"), (30.0, "Zor (9 ve 10. Sınıf)"), (None, "Çok Zor (Lisans ve Lisansüstü)")),
    "cetinkaya": ((51.0, "Bağımsız Okuma Düzeyi (8. Sınıf ve Altı)"), (38.0, "Öğretim Düzeyi (9 ve 12. Sınıf)"), (None, "Endişe / Zorluk Düzeyi (Lisans ve Üstü)")),
    "bezirci": ((8.0, "İlkokul Düzeyi"), (12.0, "Ortaokul Düzeyi"), (16.0, "Lise Düzeyi"), (None, "Üniversite ve Akademik Düzey")),
}


def hundredths(x: Column) -> Column:
    """Rounded to two places, halves away from zero, as a product is."""
    return F.when(x >= 0, F.floor(x * 100 + 0.5)).otherwise(-F.floor(-x * 100 + 0.5)) / 100


def statistics(docs: DataFrame, familiar: DataFrame | None = None, parses: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and ratios of each document.

    ``familiar``: (word). ``parses``: (word, lemma, verbal, known): of a word in lower case its lemma, whether it is a
    verbal noun, and whether it is a proper noun or a number; from :mod:`lodos.operators.morphology`.
    """
    word = F.col("word")
    # one key for each row: ids may repeat or be null, and grouping by it needs no further exchange
    held = rowed(docs, key, text)
    rows = token_rows(held, ROW, text=text).select(ROW, "sentence", L.lower("token").alias("word"))
    rows = rows.withColumn("is_word", F.rlike(word, F.lit(r"\p{IsAlphabetic}")))
    if parses is not None:
        rows = rows.join(parses.select("word", "lemma", "verbal", "known"), "word", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("string").alias("lemma"), F.lit(False).alias("verbal"), F.lit(False).alias("known"))
    rows = rows.withColumn("lemma", F.coalesce("lemma", "word")).fillna(False, ["verbal", "known"])
    if familiar is not None:
        known = familiar.select(L.lower("word").alias("f")).distinct()
        forms = [F.col("word"), F.col("lemma"), F.concat("lemma", F.lit("mak")), F.concat("lemma", F.lit("mek"))]
        if parses is None:
            # without lemmas a word is familiar if it, or it less -mak or -mek, is listed: a list of words, however many the tokens
            infinitive = F.when(F.rlike("f", F.lit("m[ae]k$")), F.substring("f", F.lit(1), F.length("f") - 3))
            listed = known.select(F.explode(F.array_compact(F.array(F.col("f"), infinitive))).alias("word")).distinct()
        else:
            each = rows.where("not known").select("word", "lemma").distinct()
            each = each.select("word", "lemma", F.explode(F.array(*forms)).alias("f"))
            listed = each.join(known, "f", "left_semi").select("word").distinct()
        rows = rows.join(listed.withColumn("listed", F.lit(True)), "word", "left").fillna(False, ["listed"])
    else:
        rows = rows.withColumn("listed", F.lit(False))
    syllables = F.when(F.col("is_word"), L.syllable_count(word)).otherwise(0)
    one = lambda c: F.sum(F.when(F.col("is_word") & c, 1).otherwise(0))
    by_sentence = rows.groupBy(ROW, "sentence").agg(
        one(F.lit(True)).alias("words"),
        F.sum(syllables).alias("syllables"),
        one(syllables >= 3).alias("polysyllabic"),
        one(~(F.col("known") | F.col("listed"))).alias("unfamiliar"),
        one(F.col("verbal")).alias("verbals"),
        one(word.isin(CONJUNCTIONS)).alias("links"),
    )
    complex_ = ((F.col("verbals") > 0) | (F.col("links") > 0) | (F.col("words") > 10)).cast("long")
    counts = by_sentence.groupBy(ROW).agg(F.count("*").alias("sentences"), *[F.sum(c).alias(c) for c in ("words", "syllables", "polysyllabic", "unfamiliar", "verbals")], F.sum(complex_).alias("complex"))
    once = rows.where("is_word").groupBy(ROW, "lemma").agg(F.count("*").alias("n")).groupBy(ROW).agg(F.sum((F.col("n") == 1).cast("long")).alias("hapax"))
    sums = ["sentences", "words", "syllables", "polysyllabic", "unfamiliar", "verbals", "complex", "hapax"]
    whole = held.select(ROW, key).join(counts, ROW, "left").join(once, ROW, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    s, w = F.greatest(F.col("sentences"), F.lit(1)), F.greatest(F.col("words"), F.lit(1))
    return whole.select(
        "*",
        (F.col("words") / s).alias("words_per_sentence"),
        (F.col("syllables") / w).alias("syllables_per_word"),
        (F.col("unfamiliar") / w * 100).alias("unfamiliar_ratio"),
        (F.col("hapax") / w * 100).alias("hapax_ratio"),
        (F.col("complex") / s * 100).alias("complex_ratio"),
        (F.col("verbals") / s * 10).alias("clause_ratio"),
        (F.col("polysyllabic") / w * 100).alias("polysyllabic_ratio"),
    )


def _graded(score: Column, bounds: tuple[float, ...]) -> Column:
    out = F.when(score < bounds[0], GRADES[0])
    for b, g in zip(bounds[1:], GRADES[1:-1], strict=True):
        out = out.when(score <= b, g)
    return out.otherwise(GRADES[-1])


def evaluated(stats: DataFrame) -> DataFrame:
    """``stats`` with the score and grade of each formula."""
    out = stats
    for name, (constant, weights, bounds) in FORMULAS.items():
        score = F.lit(constant)
        for c, k in weights.items():
            score = score + F.lit(k) * F.col(c)
        out = out.withColumn(name, hundredths(score)).withColumn(f"{name}_grade", _graded(score, bounds))
    classic = {
        "atesman": F.lit(198.825) - 40.175 * F.col("syllables_per_word") - 2.610 * F.col("words_per_sentence"),
        "cetinkaya": F.lit(118.823) - 25.987 * F.col("syllables_per_word") - 0.971 * F.col("words_per_sentence"),
        "bezirci": F.sqrt(F.col("words_per_sentence") * F.col("polysyllabic_ratio")),
    }
    for name, score in classic.items():
        grade = F
        for bound, label in CLASSIC[name]:
            grade = grade.otherwise(label) if bound is None else grade.when(score <= bound if name == "bezirci" else score >= bound, label)
        out = out.withColumn(name, hundredths(score)).withColumn(f"{name}_grade", grade)
    return out
