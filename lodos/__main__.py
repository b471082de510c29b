"""Command line: python -m lodos COMMAND [TEXT] [--file PATH], on a local session. Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import letters as L
from .functions import numerals as N
from .functions import tokens as T
from .operators import analysis, entities, grammar, groups, keywords, morphology, readability, spelling, style
from .sources.files import in_memory, text_files


def _words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").alias("word"))


def commands(lexicon: DataFrame, args: argparse.Namespace) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Each command as a function of a table of texts."""
    names = lexicon.where("secondary = 'ProperNoun'").select(F.col("root").alias("word"))
    vocabulary = spelling.vocabulary(lexicon, "root", "ord")
    return {
        "tokenize": lambda d: d.select(F.explode(T.tokens("text")).alias("t")).select("t.*"),
        "analyze": lambda d: morphology.analyses(_words(d), lexicon).orderBy("rank"),
        "syntactic-analyze": lambda d: groups.group_parses(_words(d), lexicon).orderBy("formatted"),
        "generate": lambda d: morphology.generated(d.select(F.col("text").alias("lemma"), F.split(F.lit(args.tags), ",").alias("tags")), lexicon),
        "deasciify": lambda d: spelling.replaced(d, spelling.restorations(spelling.word_runs(d), lexicon)).select("changed"),
        "asciify": lambda d: d.select(L.fold("text").alias("folded")),
        "normalize": lambda d: spelling.replaced(d, spelling.normalizations(spelling.word_runs(d), lexicon)).select("changed"),
        "spellcheck": lambda d: spelling.suggestions(_words(d), vocabulary).orderBy("rank"),
        "parse": lambda d: analysis.analyzed(d, lexicon).orderBy("row", "sentence"),
        "readability": lambda d: readability.evaluated(readability.statistics(d)),
        "syllabify": lambda d: d.select(L.syllables("text").alias("syllables")),
        "number": lambda d: d.select(N.number_words(F.col("text").cast("long")).alias("words")),
        "ner": lambda d: entities.entities(d, names).orderBy("start"),
        "keywords": lambda d: keywords.keywords(d, args.top).orderBy("rank"),
        "summarize": lambda d: keywords.summaries(d, args.sentences),
        "stem": lambda d: morphology.first_parses(_words(d), lexicon).select("word", "stem"),
        "ai-audit": lambda d: style.audit(d),
        "humanize-prompt": lambda d: style.rewriting_prompt(d, args.register),
        "grammar": lambda d: grammar.findings(d, lexicon).orderBy("start"),
        "correct": lambda d: grammar.corrected(d, lexicon),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:  # noqa: ANN001
    parser = argparse.ArgumentParser(prog="lodos")
    parser.add_argument("command")
    parser.add_argument("text", nargs="?")
    parser.add_argument("-f", "--file", help="a text file, or a folder of them, instead of TEXT")
    parser.add_argument("--lexicon", help="a file of lexicon lines to go behind the built-in ones")
    parser.add_argument("--tags", default="", help="generate: tags, with commas between")
    parser.add_argument("--top", type=int, default=10)
    parser.add_argument("--sentences", type=int, default=3)
    parser.add_argument("--register", default="blog")
    args = parser.parse_args(argv)
    if (args.text is None) == (args.file is None):
        parser.error("give a text or a file")
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    lexicon = morphology.seed_lexicon(spark)
    if args.lexicon:
        lexicon = morphology.extended(lexicon, morphology.lexicon_lines(spark, args.lexicon))
    known = commands(lexicon, args)
    if args.command not in known:
        parser.error(f"no such command: {args.command}; there are {', '.join(known)}")
    docs = text_files(spark, args.file).select("doc_id", "text") if args.file else in_memory(spark, [args.text])
    for row in known[args.command](docs).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
