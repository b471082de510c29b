"""Queries on tokens, sentences, readability, keywords over ``documents``, ``benchmark`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import letters as L
from ..functions import tokens as T
from ..operators import keywords as K
from ..operators import readability as R
from ..operators import text_tables as X
from .letter_queries import sql_lower, sql_vowels

PATTERN = T.token_pattern(T.RE2).replace("'", "''")


def _full(pattern: str) -> str:
    return "'^(?:" + T._classes(pattern, T.RE2).replace("'", "''") + ")$'"


def _kind(t: str) -> str:
    each = [(f"#{T.TAG}", "Hashtag"), (f"@{T.TAG}", "Mention"), (f"(?s:{T.URL})", "Url"), (T.DATE, "Date"), (T.TIME, "Time"), (T.NUMBER, "Number"), (T.MAIL, "Email"), (r"{L}+\.", "Abbreviation"), ("{L}+", "Word"), ("{L}.*", "ProperNounWithApostrophe"), (T._PUNCTUATION, "Punctuation")]
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, {_full(p)}) THEN '{k}'" for p, k in each) + " ELSE 'Symbol' END"


def sql_rows(table: str, key: str) -> str:
    """CTEs tok (key, pos, t) and sent (key, pos, sentence, t) of a table's texts; pos from 1."""
    return f"""
tok AS (SELECT {key}, unnest(regexp_extract_all(text, '{PATTERN}')) AS t, unnest(range(1, 1 + len(regexp_extract_all(text, '{PATTERN}')))) AS pos FROM {table}),
near AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS a FROM tok WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
code AS (SELECT *, CASE WHEN t IN ('!', '?', '…') THEN 'E'
  WHEN t = '.' AND (coalesce(regexp_matches(b, '^\\p{{L}}.*\\.$') AND NOT regexp_matches(b, '^(https?://|www\\.)'), false)
    OR coalesce({_kind('b')} = 'Number' AND regexp_matches(a, '^\\p{{Ll}}\\p{{L}}*$'), false)) THEN 'D'
  WHEN t = '.' THEN 'E' WHEN regexp_matches(t, '^["”’'')\\]»]$') THEN 'Q' ELSE 'x' END AS c FROM near),
state AS (SELECT *, lag(c) OVER w AS bc,
  max(CASE WHEN c IN ('x') THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_x,
  max(CASE WHEN c = 'E' THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_e,
  max(CASE WHEN c = 'Q' THEN pos END) OVER (w ROWS UNBOUNDED PRECEDING) AS last_q FROM code WINDOW w AS (PARTITION BY {key} ORDER BY pos))"""


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.words("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


def token_types_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # types are judged on distinct tokens of a language, counts come with them
    rows = docs.select("lang", F.explode(T.words("text")).alias("t")).groupBy("lang", "t").agg(F.count("*").alias("k"))
    return rows.withColumn("token_type", T.kind("t")).groupBy("lang", "token_type").agg(F.sum("k").alias("n"), F.count("*").alias("distinct_tokens"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.placed_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "token", "token_type", "start", "end")


def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.size(T.words("html")).cast("long").alias("n"), F.md5(F.array_join(T.words("html"), "|")).alias("tokens_md5"))


def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.words("text").alias("t"))
    sized = docs.select("doc_id", T.sentence_sizes(F.col("t")).alias("n"))
    return sized.select("doc_id", F.size("n").cast("long").alias("sentences"), F.array_join("n", ",").alias("sizes"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", F.array_join(T.without_stopwords(T.words("text"), ("the", "de", "la")), " ").alias("kept"))


_READ = ["sentences", "words", "syllables", "polysyllabic", "unfamiliar", "hapax", "complex"]


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(T.words("text")).alias("word"))
    return R.evaluated(R.statistics(docs, items))


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _readable(spark, sf_dir).select("doc_id", *_READ, *[c for n in (*R.FORMULAS, *R.CLASSIC) for c in (n, f"{n}_grade")])


def readability_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = R.evaluated(R.statistics(spark.read.parquet(f"{sf_dir}/documents.parquet"))).join(docs, "doc_id")
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 100).cast("long")) / F.count("*") / 100, 6)
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("sentences").alias("sentences"), mean("atesman").alias("atesman"), mean("bezirci").alias("bezirci"))


def rake_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.keywords(spark.read.parquet(f"{sf_dir}/documents.parquet"), 10)
    return found.select("doc_id", F.col("rank").cast("long").alias("rank"), "keyword", "score")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.summaries(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("summary").cast("long").alias("n"), F.array_join("summary", "\n").alias("summary"))


# A sentence starts where the code before it closes one: behind E, D or Q that follow an E without an x between.
_SENT = """
sent AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos) - 1 AS sentence FROM (
  SELECT *, pos = 1 OR (coalesce(be, 0) > 0 AND be > coalesce(bx, 0)
     AND NOT (c IN ('E', 'D') AND coalesce(bq, 0) < be) AND NOT (c = 'Q')) AS starts
  FROM (SELECT *, lag(last_x) OVER w AS bx, lag(last_e) OVER w AS be, lag(last_q) OVER w AS bq FROM state WINDOW w AS (PARTITION BY {key} ORDER BY pos))))"""
_STOP = ", ".join(f"'{w}'" for w in sorted(set(T.STOPWORDS)))


def _sql_graded(x: str, bounds: tuple[float, ...]) -> str:
    return f"CASE WHEN {x} < {bounds[0]} THEN '{R.GRADES[0]}' " + " ".join(f"WHEN {x} <= {b} THEN '{g}'" for b, g in zip(bounds[1:], R.GRADES[1:-1], strict=True)) + f" ELSE '{R.GRADES[-1]}' END"


def _round(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN floor(({x}) * 100 + 0.5) ELSE -floor(-({x}) * 100 + 0.5) END / 100)"


def _sql_scores() -> str:
    out = []
    for n, (k, ws, bounds) in R.FORMULAS.items():
        x = f"({k}::DOUBLE" + "".join(f" + {w}::DOUBLE * {c}" for c, w in ws.items()) + ")"
        out += [f"{_round(x)} AS {n}", f"{_sql_graded(x, bounds)} AS {n}_grade"]
    classic = {"atesman": "(198.825::DOUBLE - 40.175::DOUBLE * syllables_per_word - 2.610::DOUBLE * words_per_sentence)", "cetinkaya": "(118.823::DOUBLE - 25.987::DOUBLE * syllables_per_word - 0.971::DOUBLE * words_per_sentence)", "bezirci": "sqrt(words_per_sentence * polysyllabic_ratio)"}
    for n, x in classic.items():
        grade = "CASE " + " ".join(f"ELSE '{g}'" if b is None else f"WHEN {x} {'<=' if n == 'bezirci' else '>='} {b} THEN '{g}'" for b, g in R.CLASSIC[n]) + " END"
        out += [f"{_round(x)} AS {n}", f"{grade} AS {n}_grade"]
    return ", ".join(out)


def _sql_stats(known: str) -> str:
    word = sql_lower("t")
    return f"""{sql_rows('documents', 'doc_id')},{_SENT.format(key='doc_id')},
w AS (SELECT doc_id, sentence, {word} AS word, regexp_matches(t, '\\p{{L}}') AS is_word FROM sent),
listed AS ({known}),
ws AS (SELECT w.*, length({sql_vowels('word')}) AS syl, (word IN (FROM listed) OR word || 'mak' IN (FROM listed) OR word || 'mek' IN (FROM listed)) AS familiar FROM w),
by_sent AS (SELECT doc_id, sentence, count(*) FILTER (is_word) AS words, coalesce(sum(syl) FILTER (is_word), 0) AS syllables, count(*) FILTER (is_word AND syl >= 3) AS poly,
  count(*) FILTER (is_word AND NOT familiar) AS unfam, bool_or(is_word AND word IN ({', '.join(f"'{c}'" for c in R.CONJUNCTIONS)})) AS linked
  FROM ws GROUP BY ALL),
agg AS (SELECT doc_id, count(*) AS sentences, sum(words)::BIGINT AS words, sum(syllables)::BIGINT AS syllables, sum(poly)::BIGINT AS polysyllabic, sum(unfam)::BIGINT AS unfamiliar,
  count(*) FILTER (linked OR words > 10) AS complex FROM by_sent GROUP BY doc_id),
hap AS (SELECT doc_id, count(*) FILTER (n = 1) AS hapax FROM (SELECT doc_id, word, count(*) AS n FROM w WHERE is_word GROUP BY ALL) GROUP BY doc_id),
stats AS (SELECT d.doc_id, d.lang, coalesce(sentences, 0) AS sentences, coalesce(words, 0) AS words, coalesce(syllables, 0) AS syllables, coalesce(polysyllabic, 0) AS polysyllabic,
  coalesce(unfamiliar, 0) AS unfamiliar, coalesce(hapax, 0) AS hapax, coalesce(complex, 0) AS complex FROM documents d LEFT JOIN agg USING (doc_id) LEFT JOIN hap USING (doc_id)),
ratios AS (SELECT *, words / greatest(sentences, 1) AS words_per_sentence, syllables / greatest(words, 1) AS syllables_per_word, unfamiliar / greatest(words, 1) * 100 AS unfamiliar_ratio,
  hapax / greatest(words, 1) * 100 AS hapax_ratio, complex / greatest(sentences, 1) * 100 AS complex_ratio, 0.0::DOUBLE AS clause_ratio, polysyllabic / greatest(words, 1) * 100 AS polysyllabic_ratio FROM stats),
scores AS (SELECT *, {_sql_scores()} FROM ratios)"""


_FAMILIAR = f"SELECT DISTINCT {sql_lower('x')} AS f FROM (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS x FROM benchmark)"
_STRIP = sql_lower(r"regexp_replace(t, '^\P{L}+|\P{L}+$', '', 'g')")
QUERIES = {
    "token_counts": (token_counts, f"SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{PATTERN}') AS t FROM documents)"),
    "token_types_by_lang": (token_types_by_lang, f"SELECT lang, {_kind('t')} AS token_type, count(*) AS n, count(DISTINCT t) AS distinct_tokens FROM (SELECT lang, unnest(regexp_extract_all(text, '{PATTERN}')) AS t FROM documents) GROUP BY ALL"),
    "token_offsets": (
        token_offsets,
        f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{PATTERN}')) AS token, unnest(string_split_regex(text, '{PATTERN}')[1:len(regexp_extract_all(text, '{PATTERN}'))]) AS gap,
        unnest(range(len(regexp_extract_all(text, '{PATTERN}')))) AS pos FROM documents),
        e AS (SELECT *, sum(length(gap) + length(token)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS "end" FROM r)
        SELECT doc_id, pos, token, {_kind('token')} AS token_type, "end" - length(token) AS start, "end" FROM e""",
    ),
    "page_tokens": (page_tokens, f"SELECT page_id, len(t)::BIGINT AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM (SELECT page_id, regexp_extract_all(html, '{PATTERN}') AS t FROM pages)"),
    "sentence_count": (
        sentence_count,
        f"""WITH {sql_rows('documents', 'doc_id')},{_SENT.format(key='doc_id')},
        n AS (SELECT doc_id, sentence, count(*) AS n FROM sent GROUP BY ALL)
        SELECT d.doc_id, count(n)::BIGINT AS sentences, coalesce(string_agg(n::VARCHAR, ',' ORDER BY sentence), '') AS sizes FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
    ),
    "stopword_filter": (
        stopword_filter,
        f"SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '{PATTERN}'), lambda t: {sql_lower('t')} NOT IN ({_STOP}, 'the', 'la')), ' ') AS kept FROM conversations",
    ),
    "readability": (readability, f"WITH {_sql_stats(_FAMILIAR)} SELECT doc_id, {', '.join(_READ)}, {', '.join(c for n in (*R.FORMULAS, *R.CLASSIC) for c in (n, f'{n}_grade'))} FROM scores"),
    "readability_by_lang": (
        readability_by_lang,
        f"WITH {_sql_stats('SELECT NULL::VARCHAR AS f WHERE false')} SELECT lang, count(*) AS docs, sum(words)::BIGINT AS words, sum(sentences)::BIGINT AS sentences, round(sum(round(atesman * 100)::BIGINT) / count(*) / 100, 6) AS atesman, round(sum(round(bezirci * 100)::BIGINT) / count(*) / 100, 6) AS bezirci FROM scores GROUP BY lang",
    ),
    "rake_topk": (
        rake_topk,
        f"""WITH {sql_rows('documents', 'doc_id')},
        w AS (SELECT doc_id, pos, {_STRIP} AS word FROM tok),
        f AS (SELECT *, word = '' OR word IN ({_STOP}) AS breaks FROM w),
        p AS (SELECT doc_id, pos, word, phrase, count(*) OVER (PARTITION BY doc_id, phrase) AS n FROM (SELECT *, sum(breaks::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS phrase FROM f) WHERE NOT breaks),
        s AS (SELECT doc_id, word, sum(n) / count(*) AS s FROM p GROUP BY ALL),
        k AS (SELECT doc_id, phrase, string_agg(word, ' ' ORDER BY pos) AS keyword, sum(s) AS score FROM p JOIN s USING (doc_id, word) GROUP BY ALL),
        b AS (SELECT doc_id, keyword, round(max(score), 4) AS score FROM k GROUP BY ALL)
        SELECT doc_id, rank, keyword, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, keyword) AS rank FROM b) WHERE rank <= 10""",
    ),
    "summaries": (summaries, None),
}
