"""Which document of a series is the newest.

A series may hold any share of the rows: what decides a series (its shapes, its
newest key, whether every date is shown) are aggregates of fixed size, combined
before the shuffle and joined back; no series is collected or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import periods
from gleaner.functions.texts import SUPERSEDED_AT

#: A doubtful group larger than this is kept whole; groups asked about per crawl.
MAX_GROUP, MAX_GROUPS = 40, 25


def with_series(docs: DataFrame, url: str = "url", name: str = "name") -> DataFrame:
    """``docs`` and their period, series, skeleton, order shape and order values."""
    d = periods.with_names(docs, url, name)
    return d.withColumn("period", periods.period_of(F.concat_ws(" ", name, url))).drop("ident_text", "ident_ext")


def mark_latest(docs: DataFrame, scope: list[str], published: str = "published") -> DataFrame:
    """``docs`` (with :func:`with_series`) and ``latest``: true, false, or null where nothing trustworthy orders them.

    Within ``scope`` and series: one common shape orders by the numbers, else the
    dates shown order, if all are shown and there are two documents.  Rejected
    documents are never compared.  Ties are all latest.
    """
    live = F.coalesce(F.col("verdict"), F.lit("")) != "rejected"
    keys = [*scope, "series_key"]
    facts = docs.where(live).groupBy(*keys).agg(
        F.min("shape").alias("__low"), F.max("shape").alias("__high"), F.max("order_values").alias("__top"),
        F.count("*").alias("__n"), F.count(F.nullif(published, F.lit(""))).alias("__dated"), F.max(published).alias("__newest"),
    )
    by_number = (F.col("__low") == F.col("__high")) & (F.col("__low") != "")
    by_date = (F.col("__n") >= 2) & (F.col("__dated") == F.col("__n"))
    joined = docs.join(facts, keys, "left")
    latest = F.when(live & by_number, F.col("order_values") == F.col("__top")).when(live & by_date, F.col(published) == F.col("__newest"))
    return joined.withColumn("latest", latest).drop("__low", "__high", "__top", "__n", "__dated", "__newest")


def doubtful_groups(docs: DataFrame, scope: list[str], order: str, limit: int = MAX_GROUPS) -> DataFrame:
    """(scope.., skeleton, size, first, rank): look-alikes that code did not order as one series, the first ``limit`` per scope to appear."""
    open_ = docs.where((F.coalesce("verdict", F.lit("")) != "rejected") & (F.coalesce("latest", F.lit(True))))
    g = open_.groupBy(*scope, "skeleton").agg(
        F.count("*").alias("size"), F.min(order).alias("first"), F.min("series_key").alias("__a"), F.max("series_key").alias("__b"), F.count_if(F.col("latest")).alias("__sure"),
    )
    settled = (F.col("__a") == F.col("__b")) & (F.col("__sure") == F.col("size"))
    g = g.where(F.col("size").between(2, MAX_GROUP) & ~settled).drop("__a", "__b", "__sure")
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy("first", "skeleton"))  # the limit is pushed before the shuffle
    return g.withColumn("rank", rank).where(F.col("rank") <= limit)


def refine_latest(docs: DataFrame, scope: list[str], key: str, group_answers: DataFrame, older_answers: DataFrame, at: float = SUPERSEDED_AT) -> DataFrame:
    """``docs`` with ``latest`` false where recorded answers are sure of an older edition.

    ``group_answers``: scope.., skeleton, same, newest (key of the newest), sure.
    ``older_answers``: scope.., key, p_older; asked where the group answer is unsure.
    """
    g = group_answers.select(*scope, "skeleton", F.col("same").alias("__same"), F.col("newest").alias("__newest"), F.col("sure").alias("__sure"))
    d = docs.join(g, [*scope, "skeleton"], "left").join(older_answers.select(*scope, key, F.col("p_older").alias("__p")), [*scope, key], "left")
    whole = F.coalesce((F.col("__same") >= at) & F.col("__newest").isNotNull() & (F.col("__sure") >= at), F.lit(False))
    gone = F.when(whole, F.col(key) != F.col("__newest")).otherwise(F.coalesce(F.col("__p") >= at, F.lit(False)))
    gone = gone & (F.coalesce("verdict", F.lit("")) != "rejected") & F.coalesce("latest", F.lit(True))
    return d.withColumn("latest", F.when(gone, False).otherwise(F.col("latest"))).drop("__same", "__newest", "__sure", "__p")


def apply_latest(docs: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Documents that no other supersedes; all of them, marked, where rejected ones were asked for."""
    return docs if include_rejected else docs.where(F.coalesce("latest", F.lit(True)))
