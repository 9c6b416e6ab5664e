"""The surviving record of each group of duplicates, chosen field by field.

Fields are unpivoted to long rows, every row votes for its value, votes for one
value are combined (summed, or the strongest taken), winners are chosen by
``max_by`` and pivoted back (:func:`elect`).  All groups but the largest travel
once, by their key, and are decided where they arrive.  Groups of more than
:data:`HOT` rows, or of a 20,000th of all rows where that is more, are told by
their counts first (so at most 20,000 keys are broadcast) and decided in several
combined steps instead, so one group may hold any share of the rows.

Groups are keyed by 128 bits of the canonical url's hash: a chance collision
among 10**12 urls has a probability of about 10**-15.

Defined results: null urls belong to no group; null and empty values, and names
or contexts without letters and digits, get no vote, and a field without votes
has no winner; equal votes go to the smallest id; null times count as the
oldest; unknown sources are trusted least; rows repeated with one id vote each;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.canonical import with_link_key
from gleaner.operators.timestamps import read_stamps
from gleaner.session import written

#: Fixed value: sources by trust, the most trusted first.
TRUST = ("page", "api", "sitemap", "program", "agent")
FIELDS = ("name", "context", "dated", "source")
#: A vote loses half its weight in so many days.
HALF_LIFE_DAYS = 180
#: Rows that a group may have to be decided by one task, and the most keys of larger ones.
HOT, HOT_KEYS = 100_000, 20_000
KEY = ["k1", "k2"]


def richness(c: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def trust(source: Column) -> Column:
    """5 for the most trusted source down to 1, 0 for unknown ones, null for null."""
    rank = F.when(source.isNotNull(), F.lit(0))
    for i, name in enumerate(reversed(TRUST), 1):
        rank = F.when(source == name, F.lit(i)).otherwise(rank)
    return rank


def keyed(candidates: DataFrame) -> DataFrame:
    """Candidates with a url and the key of their group."""
    rows = candidates.where("url is not null").select("cand_id", "site", "url", "name", "context", "dated", "source", "found_at")
    return with_link_key(rows, "url", None).drop("url")


def hot_keys(rows: DataFrame, least: int = HOT) -> DataFrame:
    """The keys of groups too large for one task: at most :data:`HOT_KEYS` of them."""
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("__n") > F.greatest(F.lit(least), F.col("__all") / HOT_KEYS)).select(*KEY)  # one row


def elect(rows: DataFrame, ballot: Callable[[DataFrame], DataFrame], combine: Callable[[str], Column], least: int = HOT) -> DataFrame:
    """One row per group of two or more: first_cand_id, copies, and (id, value) of the winner of each field.

    ``ballot`` gives k1, k2, cand_id and an array ``votes`` of struct(field, agree, vote, value); votes for one ``agree``
    are combined, the highest wins, and ties go to the value with the smallest id.  The winner's id is the smallest that
    gave it the strongest single vote.
    """
    hot = written(hot_keys(rows.select(*KEY), least))
    if hot.isEmpty():
        return _counted(ballot(rows).repartition(*KEY), combine)
    cold = ballot(rows.join(F.broadcast(hot), KEY, "left_anti"))
    large = ballot(rows.join(F.broadcast(hot), KEY, "left_semi"))
    return _counted(cold.repartition(*KEY), combine).unionByName(_counted(large, combine))


def _counted(cast: DataFrame, combine: Callable[[str], Column]) -> DataFrame:
    none = F.struct(F.lit("").alias("field"), F.lit(0).cast("long").alias("agree"), F.lit(0.0).alias("vote"), F.lit(None).cast("string").alias("value"))
    votes = F.concat(F.filter("votes", lambda v: v["agree"].isNotNull() & v["vote"].isNotNull()), F.array(none))  # the group itself
    long = cast.select(*KEY, "cand_id", F.explode(votes).alias("v")).select(*KEY, "cand_id", "v.field", "v.agree", "v.vote", "v.value")
    summed = long.groupBy(*KEY, "field", "agree").agg(
        combine("vote").alias("vote"), F.count("*").alias("n"), F.min("cand_id").alias("low"),
        F.max(F.struct("vote", (-F.col("cand_id")).alias("minus"), "value")).alias("best"),
    )
    won = summed.groupBy(*KEY, "field").agg(F.max(F.struct("vote", (-F.col("low")).alias("minus"), "low", "n", "best")).alias("b"))
    of = lambda f, c: F.max(F.when(F.col("field") == f, c))
    winner = F.struct((-F.col("b.best.minus")).alias("id"), F.col("b.best.value").alias("value"))
    wide = won.groupBy(*KEY).agg(of("", F.col("b.low")).alias("first_cand_id"), of("", F.col("b.n")).alias("copies"), *[of(f, winner).alias(f) for f in FIELDS])
    return wide.where("copies > 1").drop(*KEY)


def _vote(field: str, agree: Column, vote: Column, value: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if value is None else value
    return F.struct(F.lit(field).alias("field"), agree.cast("long").alias("agree"), vote.cast("double").alias("vote"), value.alias("value"))


def best_fields(rows: DataFrame, patterns: DataFrame, least: int = HOT) -> DataFrame:
    """(first_cand_id, field, cand_id) of groups of two or more (``rows`` with :func:`keyed`): whose value survives.

    Each record is a value of its own here, and the strongest vote wins: letters and digits of name and context, the time
    found of a readable date, the trust in the source.
    """

    def ballot(some: DataFrame) -> DataFrame:
        d = read_stamps(some, "dated", patterns)
        age = F.unix_micros(F.coalesce("found_at", F.lit(0).cast("timestamp")))
        none = lambda c: F.nullif(richness(F.col(c)), F.lit(0))
        same = F.col("cand_id")
        votes = [_vote("name", same, none("name")), _vote("context", same, none("context")), _vote("dated", same, F.when(F.col("norm").isNotNull(), age)), _vote("source", same, trust(F.col("source")))]
        return d.select(*KEY, "cand_id", F.array(*votes).alias("votes"))

    wide = elect(rows, ballot, F.max, least)
    out = wide.select("first_cand_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["id"].alias("cand_id")) for f in FIELDS])).alias("x"))
    return out.select("first_cand_id", "x.field", "x.cand_id").where("cand_id is not null")


def vote_records(rows: DataFrame, patterns: DataFrame, half_life_days: float = HALF_LIFE_DAYS, least: int = HOT, newest: DataFrame | None = None) -> DataFrame:
    """One built record per group of two or more (``rows`` with :func:`keyed`): (first_cand_id, copies, name, context, dated, source).

    Each value gets the sum of trust times recency decay over the rows that
    agree on it (names and contexts apart from case and punctuation, dates by
    their reading); the winning value is written as its strongest voter has it.
    Decay is counted back from the newest row of all, so a rerun gives the same; ``newest`` is one row with that time where
    the caller has it without the keys.
    """
    newest = (rows.agg(F.max("found_at")) if newest is None else newest).toDF("__now")

    def ballot(some: DataFrame) -> DataFrame:
        d = read_stamps(some, "dated", patterns).crossJoin(F.broadcast(newest))  # one row
        days = F.coalesce((F.unix_seconds("__now") - F.unix_seconds("found_at")) / 86400.0, F.lit(36500.0))
        weight = F.coalesce(trust(F.col("source")), F.lit(0)) * F.pow(F.lit(0.5), days / half_life_days)
        text = lambda c: F.nullif(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")), F.lit(""))
        agree = {"name": text(F.col("name")), "context": text(F.col("context")), "dated": F.col("norm"), "source": F.nullif(F.col("source"), F.lit(""))}
        votes = [_vote(f, F.when(a.isNotNull(), F.xxhash64(a)), weight, F.col(f)) for f, a in agree.items()]
        return d.select(*KEY, "cand_id", F.array(*votes).alias("votes"))

    wide = elect(rows, ballot, lambda c: F.round(F.sum(c), 9), least)
    return wide.select("first_cand_id", "copies", *[F.col(f)["value"].alias(f) for f in FIELDS])
