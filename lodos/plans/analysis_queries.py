"""Queries on spelling, style, grammar, morphology, entities over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import entities as E
from ..operators import grammar as G
from ..operators import groups as GR
from ..operators import morphology as M
from ..operators import spelling as S
from ..operators import style as Y
from . import rule_sql
from .letter_queries import sql_lower
from .token_queries import _SENT, PATTERN, _kind, sql_rows


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, items = S.token_words(_docs(spark, sf_dir, "conversations")), S.token_words(_docs(spark, sf_dir, "benchmark"))
    return S.known(words, S.vocabulary(items))


def spell_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, items = S.token_words(_docs(spark, sf_dir, "benchmark")), S.token_words(_docs(spark, sf_dir, "conversations"))
    return S.suggestions(words, S.vocabulary(items)).select("word", F.col("rank").cast("long").alias("rank"), "suggestion", F.col("distance").cast("long").alias("distance"), F.col("score").cast("double").alias("score"))


def informal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select("doc_id", F.md5(S.each_word("text", S.shortened)).alias("short_md5"), F.md5(S.each_word("text", S.informal)).alias("informal_md5"), F.md5(S.each_word("text", S.restored)).alias("restored_md5"))


def punct_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.marks(_docs(spark, sf_dir))


def rhythm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.rhythm(_docs(spark, sf_dir))
    return out.select("doc_id", "sentences", "words", "short", "long", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "monotonous")


def cliche_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.categories(_docs(spark, sf_dir))


def style_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.audit(_docs(spark, sf_dir)).select("doc_id", "sentences", "predicates", "mektedir", "score", "verdict")


def grammar_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.findings(_docs(spark, sf_dir))


def grammar_by_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.findings(_docs(spark, sf_dir), M.seed_lexicon(spark))


def corrected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.corrected(_docs(spark, sf_dir))


def morph_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.analyses(S.token_words(_docs(spark, sf_dir)), M.seed_lexicon(spark))
    return found.select("word", F.col("rank").cast("long").alias("rank"), "formatted", "score")


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_parses(S.token_words(_docs(spark, sf_dir)), M.seed_lexicon(spark)).select("word", "stem", "verbal", "known")


def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.compounds(S.token_words(_docs(spark, sf_dir)), M.seed_lexicon(spark))


def dependency_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conllu_texts(_docs(spark, sf_dir), M.seed_lexicon(spark)).drop("row")


def named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = M.seed_lexicon(spark).where("secondary = 'ProperNoun'").select(F.col("root").alias("word"))
    return E.entities(_docs(spark, sf_dir), names)


def lexicon_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.seed_lexicon(spark).select("lemma", "root", "pos", "secondary", F.array_join("attrs", ",").alias("attrs"), "ord")


def generated_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = M.seed_lexicon(spark)
    tags = ["A3pl", "P1sg", "P2sg", "P3sg", "Dat", "Acc", "Loc", "Abl", "Gen", "Past"]
    asked = lexicon.select(F.col("root").alias("lemma")).distinct().select("lemma", F.explode(F.array(*map(F.lit, tags))).alias("tag"))
    return M.generated(asked.withColumn("tags", F.array("tag")), lexicon).select("lemma", "tag", "surface")


def vocab_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, items = S.token_words(_docs(spark, sf_dir, "conversations")), S.token_words(_docs(spark, sf_dir, "benchmark"))
    return S.extended(S.vocabulary(items), words)


def inflectional_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GR.group_parses(S.token_words(_docs(spark, sf_dir)), M.seed_lexicon(spark)).select("word", "root", "root_pos", F.size("groups").cast("long").alias("groups"), "proper", "formatted")


def normal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.normalizations(S.word_runs(_docs(spark, sf_dir)), M.seed_lexicon(spark))


def restored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.restorations(S.word_runs(_docs(spark, sf_dir)), M.seed_lexicon(spark))


def cliche_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.cliches(_docs(spark, sf_dir))


def rewriting_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.rewriting_prompt(_docs(spark, sf_dir)).select("doc_id", F.md5("prompt").alias("prompt_md5"))


def whole_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.analyzed(_docs(spark, sf_dir), M.seed_lexicon(spark))
    return found.select("doc_id", F.col("sentence").cast("long").alias("sentence"), "start", "end", F.size("tokens").cast("long").alias("n"), F.md5(F.to_json("tokens")).alias("tokens_md5"))


_WORDS = "(SELECT DISTINCT {low} AS word FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS t FROM {table}) WHERE regexp_matches(t, '^\\p{{L}}+$'))"
_words = lambda table: _WORDS.format(low=sql_lower("t"), p=PATTERN, table=table)
QUERIES = {
    "vocab_membership": (vocab_membership, f"SELECT w.word, v.word IS NOT NULL AS correct FROM {_words('conversations')} w LEFT JOIN {_words('benchmark')} v ON v.word = w.word"),
    "spell_suggest": (
        spell_suggest,
        f"""WITH w AS {_words('benchmark')}, v AS {_words('conversations')},
        near AS (SELECT w.word, v.word AS suggestion, levenshtein(w.word, v.word) AS distance FROM w JOIN v ON abs(strlen(w.word) - strlen(v.word)) <= 2 WHERE levenshtein(w.word, v.word) <= 2),
        kept AS (SELECT * FROM near WHERE distance = 0 OR word NOT IN (SELECT word FROM v))
        SELECT word, rank, suggestion, distance, round(1.0 / (1 + distance), 6)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, suggestion) AS rank FROM kept) WHERE rank <= 5""",
    ),
    "informal_words": (informal_words, rule_sql.informal_words()),
    "punct_metrics": (
        punct_metrics,
        f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{PATTERN}') AS t FROM documents)
        SELECT doc_id, (length(text) - length(replace(text, '—', '')) + (length(text) - length(replace(text, ' -- ', ''))) // 4)::BIGINT AS em_dashes,
        (length(text) - length(replace(text, ';', '')))::BIGINT AS semicolons, CASE WHEN len(t) > 2 THEN len(list_filter(t[2:-2], lambda w: w = ':')) ELSE 0 END::BIGINT AS inline_colons FROM t""",
    ),
    "rhythm_metrics": (
        rhythm_metrics,
        f"""WITH {sql_rows('documents', 'doc_id')},{_SENT.format(key='doc_id')},
        n AS (SELECT doc_id, sentence, count(*) FILTER ({_kind('t')} NOT IN ('Punctuation', 'Symbol')) AS n FROM sent GROUP BY ALL),
        r AS (SELECT doc_id, count(*) AS sentences, sum(n)::BIGINT AS words, count(*) FILTER (n < 5) AS short, count(*) FILTER (n > 28) AS long, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS deviation FROM n GROUP BY doc_id)
        SELECT d.doc_id, coalesce(sentences, 0) AS sentences, coalesce(words, 0) AS words, coalesce(short, 0) AS short, coalesce(long, 0) AS long, round(coalesce(mean, 0), 6) AS mean,
        round(coalesce(deviation, 0), 6) AS deviation, coalesce(sentences >= 3 AND mean >= 16 AND deviation / mean < 0.30, false) AS monotonous FROM documents d LEFT JOIN r USING (doc_id)""",
    ),
    "lexicon_entries": (lexicon_entries, rule_sql.lexicon_entries()),
    "generated_forms": (generated_forms, rule_sql.generated_forms()),
    "vocab_growth": (
        vocab_growth,
        f"SELECT word, CASE WHEN word IN (SELECT word FROM {_words('benchmark')}) THEN 0 ELSE 1099511627776 END::BIGINT AS ord FROM (SELECT word FROM {_words('benchmark')} UNION SELECT word FROM {_words('conversations')})",
    ),
    "inflectional_groups": (inflectional_groups, None),
    "normal_words": (normal_words, None),
    "restored_words": (restored_words, None),
    "cliche_findings": (cliche_findings, None),
    "rewriting_prompts": (rewriting_prompts, None),
    "whole_analysis": (whole_analysis, None),
    "cliche_hits": (cliche_hits, rule_sql.cliche_hits()),
    "style_audit": (style_audit, rule_sql.style_audit()),
    "grammar_by_parses": (grammar_by_parses, None),
    "grammar_findings": (grammar_findings, rule_sql.grammar_findings()),
    "corrected_text": (corrected_text, rule_sql.corrected_text()),
    "morph_analysis": (morph_analysis, rule_sql.morph_analysis()),
    "word_stems": (word_stems, rule_sql.word_stems()),
    "compound_words": (compound_words, rule_sql.compound_words()),
    "dependency_trees": (dependency_trees, None),
    "named_entities": (named_entities, None),
}
