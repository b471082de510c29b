"""Line deduplication by winnowing over line hashes. Native DataFrame code throughout.

Units are the lines (split at \\n) that hold a word; others are never hashed and never deleted. A window begins at each
unit and ends with the unit that gives it ``least_words`` words, or else with its ``least_lines``-th unit; units too near
the end of the text to fill a window begin none. The smallest hash in a window is its fingerprint (winnowing), so two
texts that share a window share its fingerprint, and neighbouring windows mostly share theirs.

1. Fingerprints met at two or more positions in the corpus are kept; the others end here, with their windows.
2. The windows around shared positions are joined by their content (two 64-bit hashes over their line hashes) to the first
   position of that content by (doc_id, line). Groups are never listed: a group is one row with its smallest position.
3. With ``extend``, each later position grows both ways from its window, unit by unit, as long as its text and the text of
   the first position agree, to the ends of the texts too, and the whole repeated run goes: a run's last short lines, which
   fill no window of their own, go with it. Without, only the lines of later windows go.

Every line deleted still has an equal one earlier in that order: doc_id, null last, then the text's hash, then the line.

Defined results for odd input: null and empty texts have no units and stay as they are; equal rows (same id, same text)
count as one document, and all get the same result; a text whose lines all go becomes the empty text; an empty table
gives an empty table; every other column is passed through unless it begins with ``_ld_``, a name kept for this operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, text_of, written

LEAST_WORDS = 50
LEAST_LINES = 3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_ld_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))).withColumn(
        "_ld_text", F.xxhash64(text_of())
    )


def _units(docs: DataFrame) -> DataFrame:
    """The units of keyed documents: id, text hash, and of each unit its line, two hashes and words."""
    lines = F.split("text", "\n", -1)
    units = F.filter(
        F.transform(
            lines,
            lambda x, i: F.struct(
                i.alias("line"), F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.size(F.split(F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")), " ")).alias("words"), F.rlike(x, F.lit(WORD)).alias("is")
            ),
        ),
        lambda u: u["is"],
    )
    return docs.select("_ld_id", "_ld_text", units.alias("u")).where(F.size("u") > 0).distinct()


def windows(rows: DataFrame, least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES) -> DataFrame:
    """All windows of ``_units``: id, text hash, line and unit of the window's start, its lines, fingerprint, two content hashes."""
    one = rows.select("_ld_id", "_ld_text", "u", F.posexplode("u").alias("at", "first"))
    at = lambda k: F.get("u", F.col("at") + k)
    words: Column = F.lit(0)
    size: Column = F.lit(None).cast("int")
    reached = []
    for k in range(least_lines):
        words = words + F.coalesce(at(k)["words"], F.lit(0))
        full = at(k).isNotNull() & ((words >= least_words) | F.lit(k == least_lines - 1))
        reached.append((full, k + 1))
    for full, k in reversed(reached):
        size = F.when(full, F.lit(k)).otherwise(size)
    held = one.withColumn("n", size).where(F.col("n").isNotNull()).withColumn("w", F.slice(F.col("u"), F.col("at") + 1, F.col("n")))
    return held.select(
        "_ld_id",
        "_ld_text",
        F.col("first.line").alias("line"),
        "at",
        F.transform("w", lambda x: x["line"]).alias("lines"),
        F.array_min(F.transform("w", lambda x: F.struct(x["h"].alias("h"), x["line"].alias("line")))).alias("print"),
        F.xxhash64(F.transform("w", lambda x: x["h"])).alias("c1"),
        F.xxhash64(F.transform("w", lambda x: x["g"]), F.lit(1)).alias("c2"),
    )


def _extended(later: DataFrame, units: DataFrame) -> DataFrame:
    """(id, text hash, lines) of the maximal runs that hold windows of ``later``, which have their contents' ``origin``."""
    shift = (F.col("origin.at") - F.col("at")).alias("_shift")
    runs = later.groupBy("_ld_id", "_ld_text", F.col("origin._ld_id").alias("_oid"), F.col("origin._ld_text").alias("_otext"), shift).agg(F.collect_set("at").alias("ats"))
    # windows that begin at neighbouring units are of one run
    runs = runs.withColumn("ats", F.array_except("ats", F.transform("ats", lambda a: a + 1)))
    hashes = F.transform("u", lambda x: F.struct(x["h"], x["g"]))
    own = units.select("_ld_id", "_ld_text", hashes.alias("x"), F.transform("u", lambda x: x["line"]).alias("at_line"))
    other = units.select(F.col("_ld_id").alias("_oid"), F.col("_ld_text").alias("_otext"), hashes.alias("y"))
    both = runs.join(own, ["_ld_id", "_ld_text"]).join(other, ["_oid", "_otext"])
    agree = lambda i: (i + F.col("_shift") >= 0) & F.get("x", i).eqNullSafe(F.get("y", i + F.col("_shift")))
    ends = F.filter(F.sequence(F.lit(0), F.size("x") - 1), lambda i: ~agree(i))
    both = both.withColumn("ends", F.concat(F.array(F.lit(-1)), ends, F.array(F.size("x"))))
    after = lambda a: F.array_max(F.filter("ends", lambda e: e < a)) + 1
    until = lambda a: F.array_min(F.filter("ends", lambda e: e > a))
    found = F.flatten(F.transform("ats", lambda a: F.slice("at_line", after(a) + 1, until(a) - after(a))))
    return both.select("_ld_id", "_ld_text", found.alias("lines"))


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES, extend: bool = False) -> DataFrame:
    """For each keyed document with later repeats: the numbers of the lines to delete (``_ld_lines``)."""
    units = _units(docs)
    if extend:
        units = written(units, "units")
    found = windows(units, least_words, least_lines)
    here = F.struct("_ld_id", "_ld_text", "print.line")
    shared = (
        found.groupBy(F.col("print.h").alias("h"))
        .agg(F.min(here).alias("a"), F.max(here).alias("b"), F.count("*").alias("n"))
        # one position is the minimum of several windows; a window may be the only one of a position
        .where("a != b")
        .select("h")
    )
    near = found.join(shared, F.col("print.h") == F.col("h"), "left_semi")
    place = F.struct("_ld_id", "_ld_text", "line")
    first = near.groupBy("c1", "c2").agg(F.min(F.struct("_ld_id", "_ld_text", "line", "at")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = near.join(first, ["c1", "c2"]).where(place != F.struct("origin._ld_id", "origin._ld_text", "origin.line"))
    if extend:
        later = _extended(later, units)
    return later.groupBy("_ld_id", "_ld_text").agg(F.flatten(F.collect_set("lines")).alias("_ld_lines"))


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES, extend: bool = False) -> DataFrame:
    """``docs`` without the lines of later repeated runs; adds n_lines and n_deleted."""
    keyed = _keyed(docs)
    cut = repeats(keyed.select("_ld_id", "_ld_text", text_of().alias("text")), least_words, least_lines, extend)
    parted = keyed.withColumn("_ld_parts", F.split("text", "\n", -1)).drop("text")
    joined = parted.join(cut, ["_ld_id", "_ld_text"], "left")
    every = F.sequence(F.lit(0), F.size("_ld_parts") - 1)
    left = F.array_except(every, F.col("_ld_lines"))
    text = F.when(F.col("_ld_lines").isNull(), F.array_join("_ld_parts", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("_ld_parts", i)), "\n")
    )
    out = joined.withColumn("text", text).withColumn("n_lines", F.when(F.col("_ld_parts").isNotNull(), F.size("_ld_parts")).otherwise(0).cast("long"))
    out = out.withColumn("n_deleted", F.coalesce(F.size(F.array_distinct("_ld_lines")), F.lit(0)).cast("long"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return out.select(*[f"`{c}`" for c in names], "n_lines", "n_deleted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of all ``documents``: for each, its lines, the lines deleted and the text left."""
    out = line_dedup(documents(spark, sf_dir), extend=True)
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(text_of(), 256).alias("kept_sha256"), F.length(text_of()).cast("long").alias("kept_chars"))


def oracle_sql(table: str = "documents", columns: str | None = None, least_words: int = LEAST_WORDS, least_lines: int = LEAST_LINES, extend: bool = True) -> str:
    """Deletion judged window by window on the lines themselves, without fingerprints or hashes.

    With ``extend``, each later window stands for the diagonal on which it meets the first window of its content; of the
    places that are equal along a diagonal, the runs that hold such a window go.
    """
    ends = " ".join(
        f"WHEN {' + '.join(f'coalesce(lead(words, {j}) OVER d, 0)' if j else 'words' for j in range(k + 1))} >= {least_words} AND lead(words, {k}) OVER d IS NOT NULL THEN {k + 1}"
        if k < least_lines - 1
        else f"WHEN lead(words, {k}) OVER d IS NOT NULL THEN {k + 1}"
        for k in range(least_lines)
    ).replace("lead(words, 0) OVER d", "words")
    content = ", ".join(f"CASE WHEN n > {k} THEN coalesce(lead(x, {k}) OVER d, '') END" for k in range(least_lines))
    lines = ", ".join(f"CASE WHEN n > {k} THEN lead(line, {k}) OVER d END" for k in range(least_lines))
    out = columns or "doc_id, n_lines, n_deleted, sha256(coalesce(text, '')) AS kept_sha256, length(coalesce(text, ''))::BIGINT AS kept_chars"
    whole_windows = "gone AS (SELECT DISTINCT id, t, unnest(ls) AS line FROM later)"
    whole_runs = """diagonals AS (SELECT DISTINCT id, t, oid, ot, ok - k AS shift FROM later),
equal AS (SELECT d.*, u.k, u.line FROM diagonals d JOIN units u ON u.id = d.id AND u.t = d.t JOIN units o ON o.id = d.oid AND o.t = d.ot AND o.k = u.k + d.shift AND o.x = u.x),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY id, t, oid, ot, shift ORDER BY k) AS run FROM equal),
hit AS (SELECT DISTINCT r.id, r.t, r.oid, r.ot, r.shift, r.run FROM runs r JOIN later w ON w.id = r.id AND w.t = r.t AND w.oid = r.oid AND w.ot = r.ot AND w.ok - w.k = r.shift AND w.k = r.k),
gone AS (SELECT DISTINCT r.id, r.t, r.line FROM runs r JOIN hit h ON h.id = r.id AND h.t = r.t AND h.oid = r.oid AND h.ot = r.ot AND h.shift = r.shift AND h.run = r.run)"""
    return f"""
WITH RECURSIVE src AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS ld_row FROM {table}),
texts AS (SELECT DISTINCT coalesce(doc_id, 9223372036854775807) AS id, coalesce(text, '') AS t FROM src),
parts AS (SELECT id, t, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS line FROM texts),
units AS (SELECT *, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY id, t ORDER BY line) AS k FROM parts WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
sized AS (SELECT *, CASE {ends} END AS n FROM units WINDOW d AS (PARTITION BY id, t ORDER BY line)),
windows AS (SELECT id, t, line, k, n, ({content}) AS content, [{lines}] AS ls FROM sized WINDOW d AS (PARTITION BY id, t ORDER BY line)),
ranked AS (SELECT *, row_number() OVER o AS r, first_value(id) OVER o AS oid, first_value(t) OVER o AS ot, first_value(k) OVER o AS ok FROM windows WHERE n IS NOT NULL WINDOW o AS (PARTITION BY content, n ORDER BY id, t, line)),
later AS (SELECT * FROM ranked WHERE r > 1),
{whole_runs if extend else whole_windows},
cut AS (SELECT p.id, p.t, string_agg(p.x, chr(10) ORDER BY p.line) FILTER (g.line IS NULL) AS kept, count(g.line) AS n_deleted, count(*) AS n_lines
        FROM parts p LEFT JOIN gone g ON g.id = p.id AND g.t = p.t AND g.line = p.line GROUP BY p.id, p.t),
done AS (SELECT s.* REPLACE (CASE WHEN s.text IS NOT NULL THEN coalesce(c.kept, '') END AS text), CASE WHEN s.text IS NULL THEN 0 ELSE c.n_lines END::BIGINT AS n_lines, c.n_deleted::BIGINT AS n_deleted
         FROM src s JOIN cut c ON c.id = coalesce(s.doc_id, 9223372036854775807) AND c.t = coalesce(s.text, ''))
SELECT {out} FROM done
"""
