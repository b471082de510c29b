"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells of (source, language, topic); a cell's size is its tokens (words). Cell weights are raked: scaled
to each dimension's target share in turn until all three marginals fit. A document of a cell is drawn with probability
min(1, c * weight / size): c is as large as lets no cell exceed 1 (every marginal is then met exactly in expectation), or
is set by ``budget``, the expected share of tokens to draw, with cells that reach 1 filled first. The draw compares a hash
of the seed, the id and the text with the probability, so it is the same on every run and grows with the probability.

Targets not given are the data's own shares, tempered: share ** alpha, made to sum to 1.

The cell table has a row for each met combination, not for each document. Up to ``MOST_CELLS`` of them are raked on the
driver; more are raked by joins and grouped sums on the cluster, to the same budget and by the same stopping rule.

Defined results for odd input: a null source, language or topic is a value of its own; null and empty texts have 0
tokens, and cells without tokens have weight 0 and probability 1 (they don't move the mixture); targets for values that
no document has are left out and the rest made to sum to 1; values without a target get weight 0; equal rows are drawn
alike; an empty table gives an empty table. Columns pass through; names that begin with ``_mx_`` are kept for this
operator, and the columns it adds replace the input's of the same names.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, text_of, written

MOST_CELLS = 200_000
ROUNDS, CLOSE = 500, 1e-13
#: Exponent of the data's own shares, by dimension, where no target is given.
ALPHA = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def tokens_of(text: Column) -> Column:
    """The number of words of a text."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form, where the data have none: table, contact, verse (short lines) or prose."""
    size = F.octet_length(text)
    count = lambda c: size - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return (
        F.when(count("|") * 50 > size, "table").when(F.contains(text, F.lit("@")), "contact").when(count("\n") * 60 > size, "verse").otherwise("prose")
    )


def tempered(shares: Mapping[str, float], alpha: float) -> dict[str, float]:
    """share ** alpha, to the sum 1."""
    raised = {k: v**alpha if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()} if total else raised


def rake(sizes: np.ndarray, dims: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights (sum 1) of cells with ``sizes``: cell i has value dims[d][i] in dimension d, whose shares are to be targets[d].

    Starts from the sizes, so the data's own dependence between dimensions stays. Stops when no marginal is off by more
    than ``close``; where targets contradict the empty cells, it stops after ``rounds``.
    """
    w = sizes.astype(float) / max(sizes.sum(), 1e-300)
    if not len(w):
        return w
    for _ in range(rounds):
        off = 0.0
        for at, want in zip(dims, targets, strict=True):
            have = np.bincount(at, w, minlength=len(want))
            off = max(off, float(np.abs(have - want)[have > 0].max(initial=0.0)))
            w = w * np.divide(want, have, out=np.zeros_like(have), where=have > 0)[at]
        if off <= close:
            break
    return w / w.sum() if w.sum() > 0 else w


def scale(sizes: np.ndarray, weights: np.ndarray, budget: float | None = None) -> np.ndarray:
    """Probabilities min(1, c * weight / size) of cells; see the module's text for c. Cells without size: 1."""
    rate = np.divide(weights, sizes, out=np.zeros(len(weights)), where=sizes > 0)
    c = 1 / rate.max() if rate.max(initial=0.0) > 0 else 0.0
    if budget is not None and rate.max(initial=0.0) > 0:
        want, order = budget * sizes.sum(), np.argsort(-rate, kind="stable")
        full, left, c = 0.0, float((weights[sizes > 0]).sum()), 0.0
        for i in order:
            if rate[i] <= 0 or left <= 0 or (want - full) / left * rate[i] <= 1:
                break
            full, left, c = full + sizes[i], left - weights[i], 1 / rate[i]
        c = max(c, (want - full) / left if left > 1e-15 else 1 / rate[rate > 0].min())
    return np.where(sizes > 0, np.minimum(1.0, c * rate), 1.0)


def cells_of(docs: DataFrame, dims: list[str]) -> DataFrame:
    """(dims, docs, tokens) of the cells of documents with a column _mx_tokens."""
    return docs.groupBy(*dims).agg(F.count("*").alias("docs"), F.sum("_mx_tokens").alias("tokens"))


def _on_driver(rows: list, dims: list[str], targets: Mapping[str, Mapping[str, float]], alpha: Mapping[str, float], budget: float | None) -> list[tuple]:
    sizes = np.array([r["tokens"] or 0 for r in rows], float)
    at, want = [], []
    for d in dims:
        values = sorted({r[d] for r in rows}, key=lambda v: (v is not None, v))
        index = {v: i for i, v in enumerate(values)}
        at.append(np.array([index[r[d]] for r in rows], np.int64))
        have = np.bincount(at[-1], sizes, minlength=len(values))
        goal = targets.get(d) or tempered({v: have[index[v]] / max(sizes.sum(), 1) for v in values}, alpha.get(d, 1.0))
        goal = np.array([goal.get(v, 0.0) if have[index[v]] > 0 else 0.0 for v in values])
        want.append(goal / goal.sum() if goal.sum() > 0 else goal)
    w = rake(sizes, at, want)
    p = scale(sizes, w, budget)
    return [(*[r[d] for d in dims], float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)]


def _scaled(now: DataFrame, budget: float | None) -> DataFrame:
    """``scale`` by grouped sums: cells with ``w`` get ``probability``."""
    rate = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    most, least, total, left = now.agg(F.max(rate), F.min(F.when(rate > 0, rate)), F.sum("tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("w")))).first()
    c = 1 / most if most else 0.0
    if budget is not None and most:
        c, want, full, n, before = 0.0, budget * total, 0.0, 0, -1
        # c of the cells that are not full only grows as more become full, so this ends at the driver's c
        while n != before and left > 1e-15:
            c, before = max(c, (want - full) / left), n
            over = rate * F.lit(c) > 1
            n, full, left = now.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~over & (rate > 0), F.col("w"))), F.lit(0.0))).first()
        if left <= 1e-15:
            c = 1 / least
    return now.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), rate * F.lit(c))).otherwise(1.0))


def _on_cluster(cells: DataFrame, dims: list[str], targets: Mapping[str, Mapping[str, float]], alpha: Mapping[str, float], budget: float | None, rounds: int) -> DataFrame:
    """The same by grouped sums and joins; each round is written."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    wants = {}
    for d in dims:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0")
        if targets.get(d):
            goal = have.join(spark.createDataFrame(list(targets[d].items()), f"`{d}` string, x double"), d, "left").select(d, F.coalesce("x", F.lit(0.0)).alias("x"))
        else:
            goal = have.select(d, F.pow(F.col("t") / float(total), F.lit(alpha.get(d, 1.0))).alias("x"))
        whole = goal.agg(F.sum("x")).first()[0] or 1.0
        wants[d] = written(goal.select(F.col(d).alias("v"), (F.col("x") / F.lit(whole)).alias("x")), "targets")
    for _ in range(rounds):
        off = 0.0
        for d in dims:
            have = now.groupBy(F.col(d).alias("v")).agg(F.sum("w").alias("h"))
            want = F.coalesce("x", F.lit(0.0))
            step = have.join(wants[d], have["v"].eqNullSafe(wants[d]["v"]), "left").select(have["v"], "h", F.when(F.col("h") > 0, want / F.col("h")).otherwise(0.0).alias("f"), F.when(F.col("h") > 0, F.abs(F.col("h") - want)).alias("off"))
            step = written(step, "steps")
            off = max(off, step.agg(F.max("off")).first()[0] or 0.0)
            now = now.join(step.drop("h", "off"), now[d].eqNullSafe(step["v"])).withColumn("w", F.col("w") * F.col("f")).drop("v", "f")
        now = written(now, "raked")
        if off <= CLOSE:
            break
    whole = now.agg(F.sum("w")).first()[0] or 1.0
    now = _scaled(written(now.withColumn("w", F.col("w") / F.lit(whole)), "raked"), budget)
    return now.select(*dims, F.col("w").alias("weight"), "probability")


def mixed(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float | None = None,
    alpha: Mapping[str, float] = ALPHA,
    seed: int = 42,
    most_cells: int = MOST_CELLS,
    cluster_rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` (doc_id, text, source, lang; topic if they have one) with topic, tokens, weight (of the cell), probability, drawn."""
    spark, dims = docs.sparkSession, ["source", "lang", "topic"]
    base = docs if "topic" in docs.columns else docs.withColumn("topic", topic_of(text_of()))
    for d in dims:
        base = base.withColumn(d, F.col(d).cast("string"))
    base = base.withColumn("_mx_tokens", tokens_of(text_of()))
    cells = written(cells_of(base, dims), "cells")
    n = cells.count()
    if n <= most_cells:
        rows = _on_driver(cells.orderBy(*dims).collect(), dims, targets or {}, alpha, budget)
        fitted = spark.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double")
    else:
        fitted = _on_cluster(cells, dims, targets or {}, alpha, budget, cluster_rounds)
    fitted = fitted.select(*[F.col(d).alias(f"_mx_{d}") for d in dims], F.col("weight").alias("_mx_weight"), F.col("probability").alias("_mx_probability"))
    same = [F.col(d).eqNullSafe(F.col(f"_mx_{d}")) for d in dims]
    joined = base.join(F.broadcast(fitted) if n <= most_cells else fitted, same[0] & same[1] & same[2], "left")
    own = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_of()))
    chance = F.conv(F.substring(own, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    added = {"tokens": F.col("_mx_tokens"), "weight": F.col("_mx_weight"), "probability": F.col("_mx_probability"), "drawn": chance < F.col("_mx_probability")}
    names = [c for c in base.columns if c not in added and not c.startswith("_mx_")]
    return joined.select(*[f"`{c}`" for c in names], *[v.alias(k) for k, v in added.items()])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, weight, probability and draw of every row of ``documents``, to tempered targets."""
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "drawn")


def oracle_sql(rounds: int = 40) -> str:
    """The cells, raked by so many rounds of window sums written out one after another, and the draw."""
    words = r"len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))"
    count = lambda c: f"(strlen(t) - strlen(replace(t, {c}, '')))"
    topic = f"CASE WHEN {count(chr(39) + '|' + chr(39))} * 50 > strlen(t) THEN 'table' WHEN contains(t, '@') THEN 'contact' WHEN {count('chr(10)')} * 60 > strlen(t) THEN 'verse' ELSE 'prose' END"
    goals, steps, now = [], [], "w0"
    for d, alpha in ALPHA.items():
        goals.append(f"goal_{d} AS (SELECT v, CASE WHEN n > 0 THEN pow(n / (SELECT sum(tokens) FROM cells), {alpha}) ELSE 0 END AS x FROM (SELECT {d} AS v, sum(tokens) AS n FROM cells GROUP BY {d}))")
        goals.append(f"share_{d} AS (SELECT v, x / (SELECT sum(x) FROM goal_{d}) AS x FROM goal_{d})")
    for i in range(rounds):
        for d in ALPHA:
            steps.append(f"w{i}_{d} AS MATERIALIZED (SELECT c.* REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * x / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM {now} c JOIN share_{d} s ON s.v IS NOT DISTINCT FROM c.{d})")
            now = f"w{i}_{d}"
    return f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
docs AS (SELECT *, {topic} AS topic, {words}::BIGINT AS tokens FROM texts),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL),
{', '.join(goals)},
w0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS w FROM cells),
{', '.join(steps)},
raked AS (SELECT source, lang, topic, tokens AS size, w / (SELECT sum(w) FROM {now}) AS weight FROM {now}),
rated AS (SELECT *, CASE WHEN size > 0 THEN weight / size ELSE 0 END AS rate FROM raked),
fitted AS (SELECT *, CASE WHEN size > 0 THEN least(1, rate / (SELECT max(rate) FROM rated)) ELSE 1 END AS probability FROM rated)
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
       ('0x' || md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || t)[1:13])::BIGINT / 4503599627370496.0::DOUBLE < probability AS drawn
FROM docs d JOIN fitted f ON f.source IS NOT DISTINCT FROM d.source AND f.lang IS NOT DISTINCT FROM d.lang AND f.topic = d.topic
"""
