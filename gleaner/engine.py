"""One object for callers: discovery, site search, stores of patterns and programs, their runs and checks.

Stores are folders of versions (:mod:`gleaner.sources.sinks`) below one root,
which may be on any file system Spark reaches.  Settings come from the
constructor, else from the session's ``spark.gleaner.*`` configuration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import profiles
from gleaner.functions import texts, urls
from gleaner.operators import stores
from gleaner.operators.judging import Judge
from gleaner.plans import discover as plan
from gleaner.plans import goals
from gleaner.plans import programs as running
from gleaner.sources import sinks, structured

_GATES = "array<struct<description:string,steps:array<struct<tool:string,hint:string,value:string>>>>"
PATTERNS = f"domain string, updated_at timestamp, successful_crawl_count int, last_goal string, url_patterns_prefer array<string>, url_patterns_skip array<string>, gate_sequences {_GATES}, memory_snapshot map<string,string>, navigation_hints string, challenge_seen timestamp, challenge_passed_with string"
PROGRAMS = "program_key string, site string, start_url string, goal string, code string, saved_at timestamp"
SNAPSHOTS = "program_key string, urls array<string>"
RESULTS = "program_key string, url string, name string, context string, error string"


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None, api_key: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get("spark.gleaner.store", "")).rstrip("/")
        self.api_key = api_key or spark.conf.get("spark.gleaner.key", None)

    # --- service ---------------------------------------------------------------------------------
    def health(self) -> dict[str, str]:
        return {"status": "ok", "spark": self.spark.version}

    def profiles(self) -> list[str]:
        return profiles.available()

    def may_call(self, given: str | None) -> bool:
        """Whether a caller's key passes; every caller does where none is set."""
        return self.api_key is None or given == self.api_key

    # --- discovery -------------------------------------------------------------------------------
    def discover(self, pages: DataFrame, terms: Column, judge: Judge | None = None, latest: bool = False, include_rejected: bool = False, sitemap: DataFrame | None = None) -> DataFrame:
        return plan.discover(pages, terms, judge, latest, include_rejected, sitemap)

    def discover_goal(self, goal: str, answer: str, pages: DataFrame, sitemap: DataFrame | None = None, **options) -> DataFrame:
        """Discovery for a goal with a model's recorded answer on it: its key terms judge, and the years the goal names keep
        documents of those years and undated ones."""
        one = self.spark.createDataFrame([(goal, answer)], "goal string, answer string")
        row = goals.crawl_plans(one).select("key_terms", texts.goal_years(F.col("goal")).alias("years")).first()
        docs = self.discover(pages, F.array(*[F.lit(t) for t in row["key_terms"]]).cast("array<string>"), sitemap=sitemap, **options)
        return docs.where(F.col("year").isNull() | F.col("year").isin(row["years"])) if row["years"] else docs

    def search_sites(self, blocks: DataFrame, snippets: DataFrame, n: int = 10) -> DataFrame:
        """The first ``n`` sites of recorded results, each site once."""
        from pyspark.sql import Window

        d = structured.merged_search(blocks, snippets).withColumn("site_key", urls.search_key(F.col("url")))
        first = d.groupBy("site_key").agg(F.min_by(F.struct("url", "title", "snippet", "ord"), "ord").alias("r")).select("r.*")
        return first.withColumn("rank", F.row_number().over(Window.orderBy("ord"))).where(F.col("rank") <= n).drop("ord")  # recorded results of one search

    # --- patterns --------------------------------------------------------------------------------
    def _store(self, name: str) -> str:
        if not self.root:
            raise ValueError("no store folder: give one, or set spark.gleaner.store")
        return f"{self.root}/{name}"

    def patterns(self, domain: str | None = None) -> DataFrame:
        d = sinks.read_store(self.spark, self._store("patterns"), PATTERNS)
        return d if domain is None else d.where(F.col("domain") == urls.pattern_domain(F.lit(domain)))

    def learn(self, new: DataFrame) -> None:
        """Merge what crawls learned into the store."""
        known = new.withColumn("domain", urls.pattern_domain(F.col("domain"))).where("domain is not null")
        sinks.write_store(stores.merge_patterns(self.patterns(), known, F.current_timestamp()), self._store("patterns"))

    def forget(self, domain: str) -> None:
        sinks.write_store(self.patterns().where(F.col("domain") != urls.pattern_domain(F.lit(domain))), self._store("patterns"))

    # --- programs --------------------------------------------------------------------------------
    def programs(self, key: str | None = None) -> DataFrame:
        d = sinks.read_store(self.spark, self._store("programs"), PROGRAMS)
        return d if key is None else d.where(F.col("program_key") == key)

    def save_program(self, start_url: str, goal: str, code: str) -> str:
        """Keep a program under its key; what an older one of that key returned goes with it."""
        if (why := running.refused(code)) is not None:
            raise ValueError(why)
        start = F.lit(start_url)
        new = self.spark.range(1).select(urls.program_key(start, F.lit(goal)).alias("program_key"), urls.domain(start).alias("site"), start.alias("start_url"), F.lit(goal).alias("goal"), F.lit(code).alias("code"), F.current_timestamp().alias("saved_at"))
        all_, snapshots, results = sinks.save_program(self.programs(), self._snapshots(), self.results(), new)
        key = new.first()["program_key"]
        for name, d in (("programs", all_), ("snapshots", snapshots), ("results", results)):
            sinks.write_store(d, self._store(name))
        return key

    def delete_program(self, key: str) -> None:
        for name, d in (("programs", self.programs()), ("snapshots", self._snapshots()), ("results", self.results())):
            sinks.write_store(d.where(F.col("program_key") != key), self._store(name))

    def _snapshots(self) -> DataFrame:
        return sinks.read_store(self.spark, self._store("snapshots"), SNAPSHOTS)

    def results(self, key: str | None = None) -> DataFrame:
        d = sinks.read_store(self.spark, self._store("results"), RESULTS)
        return d if key is None else d.where(F.col("program_key") == key)

    def run_programs(self, pages: DataFrame, keep: bool = True, seconds: float = running.SECONDS) -> DataFrame:
        """Run all saved programs over recorded pages (site, url, html, page_links); with ``keep`` store their results and, for
        programs without one, a snapshot to check later runs against."""
        held = pages.select("site", "url", "html", F.col("page_links.url").alias("to"))
        saved = self.programs().select("program_key", "site", F.col("start_url").alias("start"), "code")
        out = running.run_programs(*running.split(saved, held), seconds)
        if keep:
            sinks.write_store(out, self._store("results"))
            out = self.results()
            fresh = _urls_of(out).join(self._snapshots(), "program_key", "left_anti")
            sinks.write_store(self._snapshots().unionByName(fresh), self._store("snapshots"))
        return out

    def check(self, pages: DataFrame | None = None) -> DataFrame:
        """(program_key, status, kept_share) of each program's last results, or of a run over ``pages``, against its snapshot."""
        now = self.results() if pages is None else self.run_programs(pages, keep=False)
        errors = now.groupBy("program_key").agg(F.min("error").alias("error"))
        return stores.drift(_urls_of(now).join(errors, "program_key"), self._snapshots())

    def on_events(self, events: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str):
        """Feed a stream of crawl events to a callback, batch by batch."""
        from gleaner.streaming.events import to_store

        return to_store(events, call, checkpoint)


def _urls_of(results: DataFrame) -> DataFrame:
    return results.groupBy("program_key").agg(F.array_sort(F.collect_set("url")).alias("urls"))  # at most MAX_DOCUMENTS a program
