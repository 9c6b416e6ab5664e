"""Scores of found documents against hand-checked ones.

Relations: ``found`` (scope.., ident[, page_no]), ``expected`` and ``decoys``
(scope.., ident).  All sets are joined on (scope, ident) and counted, so a scope
of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _marked(scope: list[str], **sets: DataFrame) -> DataFrame:
    """Distinct (scope.., ident) with one flag per set."""
    out = None
    for name, df in sets.items():
        part = df.select(*scope, "ident").withColumn("set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    flags = [F.max((F.col("set") == n).cast("int")).alias(n) for n in sets]
    return out.groupBy(*scope, "ident").agg(*flags)


def score(found: DataFrame, expected: DataFrame, decoys: DataFrame, scope: list[str]) -> DataFrame:
    """Counts, recall (1 where nothing is expected), precision (0 or 1 where nothing is found), f1 and decoy share."""
    m = _marked(scope, found=found, expected=expected, decoy=decoys).withColumn("decoy", F.col("decoy") * (1 - F.col("expected")))
    s = m.groupBy(*scope).agg(
        F.sum("found").alias("found_count"), F.sum("expected").alias("expected_count"), F.sum(F.col("found") * F.col("expected")).alias("true_positives"),
        F.sum("decoy").alias("decoys_total"), F.sum(F.col("decoy") * F.col("found")).alias("decoys_returned"),
    )
    n, e, tp = F.col("found_count"), F.col("expected_count"), F.col("true_positives")
    s = s.withColumn("recall", F.when(e > 0, tp / e).otherwise(1.0))
    s = s.withColumn("precision", F.when(n > 0, tp / n).otherwise(F.when(e > 0, 0.0).otherwise(1.0)))
    r, p = F.col("recall"), F.col("precision")
    return s.withColumns({
        "false_accepts": n - tp, "f1": F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0),
        "decoy_share": F.when(F.col("decoys_total") > 0, F.col("decoys_returned") / F.col("decoys_total")),
    })


def recall_at(found: DataFrame, expected: DataFrame, scope: list[str], pages: tuple[int, ...] = (10, 20, 40)) -> DataFrame:
    """Recall within the first pages, and the page of the first hit; documents of sitemaps and APIs have page 0."""
    first = found.groupBy(*scope, "ident").agg(F.min("page_no").alias("page_no"))
    joined = expected.select(*scope, "ident").distinct().join(first, [*scope, "ident"], "left")
    within = [F.round(F.count_if(F.col("page_no") <= n) / F.count("*"), 3).alias(f"recall_at_{n}") for n in pages]
    return joined.groupBy(*scope).agg(*within, F.min("page_no").alias("pages_to_first_hit"))


def candidate_pages(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """``found`` (source_page, source) with ``page_no``: the number of the page each was found on (``numbers``: source_page,
    page_no); 0 for those of sitemaps and APIs, which are known before the first page, and for unknown pages."""
    first = numbers.groupBy("source_page").agg(F.min("page_no").alias("__no"))
    d = found.join(first, "source_page", "left")
    return d.withColumn("page_no", F.when(F.col("source").isin("sitemap", "api"), 0).otherwise(F.coalesce("__no", F.lit(0)))).drop("__no")


def missed(found: DataFrame, expected: DataFrame, scope: list[str]) -> DataFrame:
    return expected.select(*scope, "ident").distinct().join(found, [*scope, "ident"], "left_anti")


def summary(runs: DataFrame, scope: list[str], metrics: list[str]) -> DataFrame:
    """Mean, population deviation, least and most of each metric over the runs that count (no error, not discarded)."""
    d = runs.where(F.col("error").isNull() & ~F.coalesce("discarded", F.lit(False)))
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", lambda c: F.round(F.avg(c), 3)), ("stdev", lambda c: F.round(F.stddev_pop(c), 3)), ("min", F.min), ("max", F.max))]
    return d.groupBy(*scope).agg(F.count("*").alias("runs"), *aggs)


def pooled(judged: DataFrame, by: str, accepted: Column, wanted: Column) -> DataFrame:
    """Precision and recall per group and pooled (group null), null where undefined."""
    d = judged.select(by, accepted.cast("int").alias("a"), wanted.cast("int").alias("w"))
    s = d.rollup(by).agg(F.sum("a").alias("accepted"), F.sum("w").alias("wanted"), F.sum(F.col("a") * F.col("w")).alias("hits"))
    return s.withColumns({"precision": F.when(F.col("accepted") > 0, F.col("hits") / F.col("accepted")), "recall": F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted"))})


def checkpoints(trace: DataFrame, scope: list[str], order: str, gain: str, at: tuple[int, ...] = (10, 20, 30, 40)) -> DataFrame:
    """Accumulated gain after the first pages of each run."""
    d = trace.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy(order)))
    return d.groupBy(*scope).agg(*[F.sum(F.when(F.col("__n") <= n, F.col(gain)).otherwise(0)).alias(f"acc_at_{n}") for n in at])


def arm_shift(scores: DataFrame, key: list[str], base: str, other: str) -> DataFrame:
    """Mean change of a score between two arms, over what both scored."""
    a, b = (scores.where(F.col("arm") == arm).select(*key, F.col("score").alias(n)) for arm, n in ((base, "x"), (other, "y")))
    return a.join(b, key).agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("shift"))


def repeated_shift(scores: DataFrame, key: list[str], base: str, other: str, again: str) -> DataFrame:
    """Mean change of a score from a base arm to another, over what all three arms scored, against the base's mean of two runs,
    and the base's own mean change between its runs (what a change must exceed)."""
    arm = lambda name, out: scores.where(F.col("arm") == name).select(*key, F.col("score").alias(out))
    d = arm(base, "x").join(arm(other, "y"), key).join(arm(again, "z"), key)
    return d.agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("y") - (F.col("x") + F.col("z")) / 2), 6).alias("shift"), F.round(F.avg(F.abs(F.col("z") - F.col("x"))), 6).alias("noise"))
