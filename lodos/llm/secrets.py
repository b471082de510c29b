"""Secret scans with an incremental ledger of content-addressed blobs. Native DataFrame code throughout.

Every text is a blob, addressed by the SHA-256 of its UTF-8 bytes. A ledger remembers which blob was scanned
under which version of which rule. A scan hashes all given versions of all paths, keeps one text for each blob,
asks the ledger which (blob, rule version) pairs are unseen, runs just those rules, writes their findings and
then the pairs, and joins the findings of all blobs back to every path and version that holds them.

Defined results for odd input: a null text is the empty text; a blob held by thousands of rows is scanned once
and its findings are joined to each of them; equal rows give equal rows; an empty table gives an empty table and
an empty ledger; other columns of the input are left alone (the scan carries only the ones named).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, text_of, work_path, written


#: Unseen blobs that are sent to every task: 32 bytes of hash, a path and the keys of rules each, some tens of MB at most.
FEW = 100_000


@dataclass(frozen=True)
class Rule:
    """One kind of secret: matches of ``pattern``, leftmost and non-overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES

SEEN = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rules", T.ArrayType(T.StringType()))])
FOUND = T.StructType(
    [
        T.StructField("blob", T.BinaryType()),
        T.StructField("rule", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("secret_sha256", T.StringType()),
    ]
)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _matches(rule: Rule, todo: Column) -> Column:
    """For one rule: an array of (rule, kind, i, gap before the match, its length, its text, whether it counts)."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    kind = T.ArrayType(
        T.StructType(
            [
                T.StructField("rule", T.StringType()),
                T.StructField("kind", T.StringType()),
                T.StructField("i", T.IntegerType()),
                T.StructField("gap", T.LongType()),
                T.StructField("n", T.LongType()),
                T.StructField("match", T.StringType()),
                T.StructField("counts", T.BooleanType()),
            ]
        )
    )
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, 0).alias("match"))
    part = lambda m: m if rule.group == 0 else F.regexp_extract(m, rule.pattern, rule.group)
    found = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.lit(rule.key).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            i.cast("int").alias("i"),
            F.length(p["before"]).cast("long").alias("gap"),
            F.length(p["match"]).cast("long").alias("n"),
            p["match"].alias("match"),
            (F.length(part(p["match"])) >= rule.least).alias("counts"),
        ),
    )
    none = F.array().cast(kind)
    return F.when(F.array_contains(todo, rule.key) & F.rlike(text, pattern), found.cast(kind)).otherwise(none)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of blobs (blob, text, todo: keys of the rules to run), one row each; offsets are in code points.

    A match begins after all gaps and matches before it, so its place is a running sum over the blob's matches.
    """
    each = F.concat(*[_matches(r, F.col("todo")) for r in rules])
    rows = blobs.select("blob", F.explode(each).alias("m")).select("blob", "m.*").where(F.col("n").isNotNull())
    rows = rows.dropDuplicates(["blob", "rule", "i"])  # the same version of the same path given twice
    before = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    return (
        rows.withColumn("end", end)
        .where("counts")
        .select("blob", "rule", "kind", (F.col("end") - F.col("n")).alias("start"), "end", F.sha2("match", 256).alias("secret_sha256"))
    )


class Ledger:
    """Two Parquet tables below ``path``: ``seen`` (blob, keys of the rules run on it) and ``found`` (findings).

    Findings are written before the pairs they belong to. A job lost between the two scans those pairs again, and
    its findings are read once, since equal findings count once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def seen(self) -> DataFrame:
        return self._read("seen", SEEN).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))

    def found(self) -> DataFrame:
        return self._read("found", FOUND).dropDuplicates(["blob", "rule", "start", "end"])

    def scan(self, versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scans what is unseen among ``versions``: any number of rows (path, text), all history included."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        rows = versions.select(F.col(path).alias("path"), text_of(text).alias("text")).withColumn("blob", blob_id(F.col("text")))
        # one row for each blob; the text of that row alone travels on
        blobs = rows.groupBy("blob").agg(F.min("path").alias("path"))
        unseen = (
            blobs.join(self.seen(), "blob", "left")
            .select("blob", "path", F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
        # written once: it is counted, joined, and becomes part of the ledger
        unseen = written(unseen, "unseen")
        # where nearly all is seen, the few unseen blobs go to the texts, so that no seen text is moved; else they meet in an exchange
        few = (n := unseen.count()) <= FEW and 20 * n <= blobs.count()
        side = F.broadcast(unseen) if few else unseen.hint("shuffle_hash")
        scanned = rows.alias("t").join(
            side.alias("u"),
            (F.col("t.blob") == F.col("u.blob")) & F.col("t.path").eqNullSafe(F.col("u.path")),
        ).select("u.blob", "t.text", "u.todo")
        find(scanned, rules).write.mode("append").parquet(f"{self.path}/found")
        unseen.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{self.path}/seen")

    def report(self, versions: DataFrame, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Every row of ``versions`` as (path, blob, spans): its blob's findings under ``rules``, by start, then rule order.

        spans is null where a blob has none.
        """
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
        spans = (
            self.found()
            .where(F.col("rule").isin([r.key for r in rules]))
            .groupBy("blob")
            .agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("rule")].alias("ord"), "kind", "end"))).alias("spans"))
        )
        rows = versions.select(F.col(path).alias("path"), blob_id(text_of(text)).alias("blob"))
        return rows.join(spans, "blob", "left")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of ``documents``: a first scan, with an empty ledger."""
    docs = documents(spark, sf_dir)
    ledger = Ledger(spark, work_path(spark, "secrets"))
    ledger.scan(docs)
    base = [r.kind for r in BASE_RULES]
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rows = ledger.report(docs).select(F.col("path").alias("doc_id"), spans.alias("s"))
    return rows.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(listed(F.filter("s", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("s")).alias("spans"),
    )


def oracle_sql() -> str:
    """The same result from DuckDB: gaps and matches of each rule, places by running sums."""
    each = " UNION ALL ".join(
        f"""SELECT text, {i} AS ord, '{r.kind}' AS kind, {r.group} AS grp, {r.least} AS least,
        unnest(regexp_extract_all(text, {_sql(r.pattern)}, 0)) AS m,
        unnest(string_split_regex(text, {_sql(r.pattern)})[1:len(regexp_extract_all(text, {_sql(r.pattern)}, 0))]) AS gap,
        unnest(regexp_extract_all(text, {_sql(r.pattern)}, {r.group})) AS part,
        unnest(range(len(regexp_extract_all(text, {_sql(r.pattern)}, 0)))) AS i
        FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)"""
        for i, r in enumerate(RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    return f"""
WITH each_match AS ({each}),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY text, ord ORDER BY i)::BIGINT AS stop FROM each_match),
kept AS (SELECT text, ord, kind, stop - length(m) AS start, kind || ':' || (stop - length(m)) || ':' || stop AS span
         FROM placed WHERE length(part) >= least),
by_text AS (SELECT text, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b,
            count(*) FILTER (kind = 'hex') AS c, string_agg(span, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base,
            string_agg(span, ',' ORDER BY start, ord) AS spans FROM kept GROUP BY text)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN by_text t ON t.text = coalesce(d.text, '')
"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"
