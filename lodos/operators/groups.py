"""Inflectional groups: a parse as a root's group and one more for each derivation, each with its features.

A word that is a root gets a group with the features that its class has by default, and one for each further class that
the root may have without a suffix. Every parse of :mod:`lodos.operators.morphology` is cut at its derivations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .morphology import analyses

# Names of the classes, and the further classes of roots that change theirs without a suffix.
CLASSES = {"Verb": "VB", "Adj": "ADJ", "Adv": "ADV", "Pron": "PRON", "Num": "NUM", "Conj": "CONJ", "Postp": "POSTP", "Interj": "INTERJ"}
DUAL = {
    "güzel": "ADJ ADV NN", "iyi": "ADJ ADV NN", "kötü": "ADJ ADV NN", "hızlı": "ADJ ADV", "yavaş": "ADJ ADV",
    "doğru": "ADJ ADV POSTP NN", "yalnız": "ADJ ADV CONJ", "rahat": "ADJ ADV NN", "soğuk": "ADJ NN", "sıcak": "ADJ NN",
    "kolay": "ADJ ADV", "zor": "ADJ ADV NN", "erken": "ADV ADJ", "geç": "ADV ADJ", "açık": "ADJ ADV NN", "kapalı": "ADJ ADV",
}
NOMINAL = {"PersonNumber": "A3sg", "Possessive": "Pnon", "Case": "Nom"}
#: Tags that begin a group: its class, its name, the features it begins with.
DERIVED = {
    "PastNom": ("NOMP", "PastNom", NOMINAL), "PastPart": ("NOMP", "PastNom", NOMINAL), "PresPart": ("ADJP", "PresPart", {}),
    "FutPart": ("ADJP", "FutPart", {}), "NarrPart": ("ADJP", "NarrPart", {}), "Inf": ("NOMP", "Inf", NOMINAL),
    "Agt": ("NN", "Agt", NOMINAL), "Dim": ("NN", "Dim", {}), "With": ("ADJP", "With", {}), "Without": ("ADJP", "Without", {}),
    "Become": ("VB", "Become", {"Polarity": "Pos"}),
}
#: Tags that set a feature, by feature, in the order in which features are written; a value that isn't the tag's own behind =.
FEATURES = {
    "Aspect": "Prog1=Prog Prog2=Prog", "Case": "Nom Acc Dat Loc Abl Gen Ins", "Copula": "Cop=PresCop", "Mood": "Des Nec",
    "PersonNumber": "A1sg A2sg A3sg A1pl A2pl A3pl", "Polarity": "Neg", "Possessive": "Pnon P1sg P2sg P3sg P1pl P2pl P3pl",
    "Tense": "Past Narr Fut Aor", "Voice": "Caus Pass",
}


def _group(pos: Column, name: Column, features: dict[str, Column]) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(pos.alias("pos"), name.alias("derivation"), *[features.get(f, none).alias(f) for f in FEATURES])


def groups_of(pos: Column, tags: Column) -> Column:
    """The groups of a parse with class ``pos`` (as the lexicon has it) and its tags."""
    none = F.lit(None).cast("string")
    noun, verb = pos == "Noun", pos == "Verb"
    first = {f: F.when(noun, v) for f, v in NOMINAL.items()} | {"Polarity": F.when(verb, "Pos")}
    start = F.struct(F.array().cast(f"array<struct<pos: string, derivation: string, {', '.join(f'{f}: string' for f in FEATURES)}>>").alias("done"), _group(class_of(pos), none, first).alias("now"))

    def step(state: Column, tag: Column) -> Column:
        now, opens = state["now"], tag.isin(list(DERIVED))
        of = lambda pick: F.coalesce(*[F.when(tag.isin([t for t, d in DERIVED.items() if pick(d) == v]), F.lit(v)) for v in dict.fromkeys(map(pick, DERIVED.values())) if v is not None])
        features = {}
        for f, values in FEATURES.items():
            set_ = {t: v or t for t, _, v in (x.partition("=") for x in values.split())}
            value = F.when(tag.isin(list(set_)), F.create_map(*[F.lit(x) for kv in set_.items() for x in kv])[tag])
            begun = [t for t, d in DERIVED.items() if f in d[2]]
            default = F.when(tag.isin(begun), F.lit(NOMINAL.get(f, "Pos"))) if begun else none
            features[f] = F.when(opens, default).otherwise(F.coalesce(value, now[f]))
        after = _group(F.when(opens, of(lambda d: d[0])).otherwise(now["pos"]), F.when(opens, of(lambda d: d[1])).otherwise(now["derivation"]), features)
        return F.struct(F.when(opens, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), after.alias("now"))

    return F.aggregate(tags, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def class_of(pos: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])[pos], F.lit("NN"))


def formatted(root: Column, groups: Column, proper: Column) -> Column:
    """(root[class]+[feature=value]...)([class]-name+...)...+[Proper=True or False]."""
    marks = lambda g: F.concat_ws("", *[F.concat(F.lit(f"+[{f}="), g[f], F.lit("]")) for f in FEATURES])
    each = F.transform(groups, lambda g, i: F.concat(F.lit("("), F.when(i == 0, F.concat(root, F.lit("["), g["pos"], F.lit("]"))).otherwise(F.concat(F.lit("["), g["pos"], F.lit("]-"), g["derivation"])), marks(g), F.lit(")")))
    return F.concat(F.array_join(each, ""), F.lit("+[Proper="), F.when(proper, "True").otherwise("False"), F.lit("]"))


def group_parses(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, root, root_pos, groups, proper, formatted): the parses of each distinct word as inflectional groups."""
    found = analyses(words, lexicon, word)
    proper = F.col("secondary") == "ProperNoun"
    none = F.lit(None).cast("string")
    cut = found.select("word", "root", class_of(F.col("pos")).alias("root_pos"), groups_of(F.col("pos"), F.col("tags")).alias("groups"), proper.alias("proper"))
    # words that are roots: the class by default, and each further class
    whole = found.where("score = 1.0").select("word", "root", "pos", proper.alias("proper")).distinct()
    by_default = F.array(F.struct(F.when(F.col("proper"), "PROP").otherwise(class_of(F.col("pos"))).alias("c"), F.col("proper").alias("p")))
    dual = F.create_map(*[x for k, v in DUAL.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])[F.col("root")]
    every = F.concat(by_default, F.coalesce(F.transform(dual, lambda c: F.struct(c.alias("c"), F.lit(False).alias("p"))), F.array().cast("array<struct<c: string, p: boolean>>")))
    each = whole.select("word", "root", F.explode(every).alias("x")).select("word", "root", F.col("x.c").alias("root_pos"), F.col("x.p").alias("proper"))
    noun, verb = F.col("root_pos") == "NN", F.col("root_pos") == "VB"
    features = {"Case": F.when(noun, "Nom"), "Possessive": F.when(noun, "Pnon"), "PersonNumber": F.when(noun | verb, "A3sg"), "Polarity": F.when(verb, "Pos")}
    direct = each.select("word", "root", "root_pos", F.array(_group(F.col("root_pos"), none, features)).alias("groups"), "proper")
    both = cut.unionByName(direct).withColumn("formatted", formatted(F.col("root"), F.col("groups"), F.col("proper")))
    return both.dropDuplicates(["word", "formatted"])
