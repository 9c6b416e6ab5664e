"""What changed between consecutive full snapshots, by gaps and islands.

Each delivered record is reduced to a key and a hash of its content.  Runs of
consecutive snapshots in which a key keeps one hash are its validity intervals
(islands).  An interval that starts after a gap is an addition, one that ends
before a gap a removal, and two adjacent intervals of one key a change.

Defined results
---------------
* a record is the row delivered last in its snapshot; of rows delivered at the
  same instant the greatest content wins, so repeated rows give one record;
* rows with a null key or a null snapshot number are no records and are left out;
* null meta is a value of its own, equal to itself; malformed JSON is compared as text;
* a null url array is an empty one, null urls in it are left out, repeated urls count once;
* empty tables and a single snapshot give no rows;
* "the snapshot before" is the next lower snapshot number that was delivered at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_identity(c: Column) -> Column:
    """Hash of a JSON text as a value: key order, spacing and escapes do not count.

    A variant keeps object keys sorted, so its text is canonical.  Text that is
    no JSON is hashed as it stands; null has its own mark.
    """
    value = F.to_json(F.try_parse_json(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.coalesce(F.concat(F.lit("j"), F.sha2(value, 256)), F.concat(F.lit("t"), F.sha2(F.trim(c), 256)))
    )


def latest_records(rows: DataFrame, ordinal: str, key: str, at: str, payload: list[str]) -> DataFrame:
    """One row per (ordinal, key): the payload delivered last.  Partial aggregation absorbs hot keys."""
    packed = F.struct(*[F.col(c) for c in payload])
    # arrays and strings order; nulls order first
    best = rows.groupBy(ordinal, key).agg(F.max(F.struct(F.col(at).alias("at"), packed.alias("p"))).alias("b"))
    return best.select(ordinal, key, *[F.col(f"b.p.{c}").alias(c) for c in payload])


def with_ordinal(rows: DataFrame, number: str) -> DataFrame:
    """``rows`` with ``__n``, the rank of its snapshot number among the numbers delivered.

    There is one number a delivery period, so the list of numbers is tiny
    whatever the rows are; the optimizer may broadcast it.
    """
    numbers = rows.select(number).where(F.col(number).isNotNull()).distinct()
    ranked = numbers.select(F.col(number).alias("__no"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(number)).alias("__n"))
    return rows.join(ranked, F.col(number) == F.col("__no")).drop("__no")


def validity_intervals(records: DataFrame, key: list[str], ordinal: str, digest: str, carry_first: list[Column] = (), carry_last: list[Column] = ()) -> DataFrame:
    """Islands (key.., digest, first, last) of consecutive ordinals with one digest.

    ``carry_first`` and ``carry_last`` are columns kept as they stand in the
    first and in the last record of each interval.
    """
    w = Window.partitionBy(*key).orderBy(ordinal)
    before = F.lag(F.struct(F.col(ordinal).alias("n"), F.col(digest).alias("d"))).over(w)
    starts = F.when((before["n"] == F.col(ordinal) - 1) & (before["d"] == F.col(digest)), 0).otherwise(1)
    marked = records.withColumn("__new", starts)
    marked = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "__island").agg(
        F.first(digest).alias(digest), F.min(ordinal).alias("first"), F.max(ordinal).alias("last"),
        *[F.min_by(c, ordinal).alias(f"first_{c}") for c in carry_first], *[F.max_by(c, ordinal).alias(f"last_{c}") for c in carry_last],
    ).drop("__island")


def record_events(intervals: DataFrame, key: str, last_ordinal: DataFrame) -> DataFrame:
    """(ordinal, key, what) from the intervals of whole records."""
    w = Window.partitionBy(key).orderBy("first")
    d = intervals.withColumn("__before", F.lag("last").over(w)).withColumn("__after", F.lead("first").over(w))
    d = d.crossJoin(F.broadcast(last_ordinal))  # one row: the number of snapshots
    events = F.array_compact(
        F.array(
            F.when(F.col("__before") == F.col("first") - 1, F.struct(F.col("first").alias("n"), F.lit("changed").alias("what"))),
            F.when((F.col("first") > 1) & (F.coalesce("__before", F.lit(0)) < F.col("first") - 1), F.struct(F.col("first").alias("n"), F.lit("added").alias("what"))),
            F.when(
                (F.col("last") < F.col("__ends")) & (F.col("__after").isNull() | (F.col("__after") > F.col("last") + 1)),
                F.struct((F.col("last") + 1).alias("n"), F.lit("removed").alias("what")),
            ),
        )
    )
    return d.select(key, F.explode(events).alias("e")).select(key, F.col("e.n").alias("__n"), F.col("e.what").alias("what"))


def snapshot_changes(snapshots: DataFrame, number: str = "snapshot_no", at: str = "delivered_at", key: str = "program_key", value: str = "meta", items: str = "urls") -> DataFrame:
    """Rows (number, key, url, what): what was added, removed or changed from each snapshot to the next."""
    rows = snapshots.select(number, at, key, value, items).where(F.col(key).isNotNull() & F.col(number).isNotNull())
    rows = rows.select(number, at, key, json_identity(F.col(value)).alias("__digest"), F.coalesce(F.array_sort(F.array_distinct(F.array_compact(items))), F.array().cast("array<string>")).alias("__items"))
    best = latest_records(rows, number, key, at, ["__digest", "__items"])
    best = with_ordinal(best, number)
    numbers = best.select("__n", number).distinct()
    ends = numbers.agg(F.max("__n").alias("__ends"))

    programs = record_events(validity_intervals(best.select(key, "__n", "__digest"), [key], "__n", "__digest"), key, ends).withColumn("url", F.lit(""))

    # an item's interval counts where its program stands on both sides of the edge
    w = Window.partitionBy(key).orderBy("__n")
    sided = best.withColumn("__had", F.coalesce(F.lag("__n").over(w) == F.col("__n") - 1, F.lit(False))).withColumn("__has", F.coalesce(F.lead("__n").over(w) == F.col("__n") + 1, F.lit(False)))
    each = sided.select(key, "__n", "__had", "__has", F.explode("__items").alias("url")).withColumn("__digest", F.lit(""))
    runs = validity_intervals(each, [key, "url"], "__n", "__digest", ["__had"], ["__has"])
    edges = F.array_compact(
        F.array(
            F.when(F.col("first___had"), F.struct(F.col("first").alias("n"), F.lit("added").alias("what"))),
            F.when(F.col("last___has"), F.struct((F.col("last") + 1).alias("n"), F.lit("removed").alias("what"))),
        )
    )
    urls = runs.select(key, "url", F.explode(edges).alias("e")).select(key, F.col("e.n").alias("__n"), F.col("e.what").alias("what"), "url")
    return programs.unionByName(urls).join(numbers, "__n").select(number, key, "url", "what")
