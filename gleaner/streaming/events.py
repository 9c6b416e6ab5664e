"""Crawl events as a stream: first seen, windows, budgets, health, frontier state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DEFAULT_DELAY = "1 hour"


def read_events(spark, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_seen(events: DataFrame, keys: list[str], at: str, within: str | None = None) -> DataFrame:
    """The first event of each key of the whole crawl; state is kept by the query as long as it lives.

    With ``within`` a stream forgets keys that long after their time (a bound on state, for keys that do not come again).
    """
    if events.isStreaming:
        return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys) if within else events.dropDuplicates(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("__r")).select(*keys, "__r.*")


def windowed_counts(events: DataFrame, at: str, by: str, size: str = "1 hour", slide: str | None = None, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Events per window and kind (tumbling, or sliding where ``slide`` is given)."""
    d = events.withWatermark(at, delay) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return d.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", delay: str = DEFAULT_DELAY) -> DataFrame:
    d = events.withWatermark(at, delay) if events.isStreaming else events
    return d.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def stale_pages(events: DataFrame, key: str = "crawl_id", at: str | None = None) -> DataFrame:
    """Running state per crawl over its page events (crawl_id, accepted[, at]): pages, accepted, pages since the last accepted one.

    Events of a batch count in the order of ``at``; those of an earlier batch come before.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, accepted, stale = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches))
        if at:
            rows = rows.sort_values(at, kind="stable")
        gains = rows["accepted"].fillna(0).to_numpy()
        paid = gains.nonzero()[0]
        stale = len(gains) - 1 - int(paid[-1]) if len(paid) else stale + len(gains)
        pages, accepted = pages + len(gains), accepted + int(gains.sum())
        state.update((pages, accepted, stale))
        yield pd.DataFrame([(k[0], pages, accepted, stale)], columns=[key, "pages", "accepted", "stale"])

    out = f"{key} string, pages long, accepted long, stale long"
    return events.groupBy(key).applyInPandasWithState(step, out, "pages long, accepted long, stale long", "update", GroupStateTimeout.NoTimeout)


def to_store(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed each micro-batch to ``merge``; the store is updated once per batch id."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).start()


def upsert_batches(folder: str, keys: list[str], schema: str) -> Callable[[DataFrame, int], None]:
    """What feeds micro-batches into a store: rows replace those with their keys, and a batch that comes again after a failure
    is known by its id and left out, as the id is written with the rows in one step."""
    from gleaner.operators.stores import upsert
    from gleaner.sources.sinks import read_store, write_store

    def feed(batch: DataFrame, number: int) -> None:
        held = read_store(batch.sparkSession, folder, f"{schema}, __batch long")
        if held.where(F.col("__batch") >= number).limit(1).count():
            return
        marked = upsert(held.drop("__batch"), batch, keys).withColumn("__batch", F.lit(number).cast("long"))
        write_store(marked, folder)

    return feed


def server_events(events: DataFrame) -> DataFrame:
    """Events as server-sent text, in order; element dumps are not sent."""
    return events.where("type <> 'page_elements'").select(F.concat(F.lit("event: "), "type", F.lit("\ndata: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("text"))


def framed_events(events: DataFrame, config: str, idle_ms: int = 1000) -> DataFrame:
    """(crawl_id, ord, text): what a client of each crawl is sent: the configuration, each event, a heartbeat for each full
    ``idle_ms`` without one, and the end.  ``events``: crawl_id, ord, at_ms, type, data (JSON)."""
    from pyspark.sql import Window

    say = lambda kind, data: F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))
    w = Window.partitionBy("crawl_id").orderBy("ord")
    d = events.where("type <> 'page_elements'")
    beats = F.greatest(F.floor((F.col("at_ms") - F.lag("at_ms").over(w)) / idle_ms), F.lit(0))
    d = d.withColumn("__beats", F.coalesce(beats, F.lit(0)))
    told = d.select("crawl_id", "ord", F.lit(1).alias("__k"), say(F.col("type"), F.col("data")).alias("text"))
    idle = d.where("__beats > 0").select("crawl_id", "ord", F.lit(0).alias("__k"), F.explode(F.array_repeat(say(F.lit("heartbeat"), F.lit("{}")), F.col("__beats").cast("int"))).alias("text"))
    ends = events.groupBy("crawl_id").agg(F.min("ord").alias("a"), F.max("ord").alias("b"))
    head = ends.select("crawl_id", (F.col("a") - 1).alias("ord"), F.lit(0).alias("__k"), say(F.lit("config"), F.lit(config)).alias("text"))
    tail = ends.select("crawl_id", (F.col("b") + 1).alias("ord"), F.lit(0).alias("__k"), say(F.lit("done"), F.lit("{}")).alias("text"))
    every = told.unionByName(idle).unionByName(head).unionByName(tail)
    return every.select("crawl_id", F.row_number().over(Window.partitionBy("crawl_id").orderBy("ord", "__k")).alias("ord"), "text")
