"""State kept between crawls: patterns, programs, recipes, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of merged patterns, drift and health.
MAX_PATTERNS, MAX_GATES = 20, 5
KEEP_SHARE, MIN_KEPT_SHARE, HOLD_BACK_HOURS = 0.8, 0.5, 24


def merge_patterns(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The pattern store after one crawl each of ``new``: ordered unions, gates by description, later memory wins."""
    o, n = old.alias("o"), new.alias("n")
    both = lambda c: F.slice(F.array_distinct(F.concat(F.coalesce(f"o.{c}", F.array().cast("array<string>")), F.coalesce(f"n.{c}", F.array().cast("array<string>")))), 1, MAX_PATTERNS)
    text = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}"), F.lit(""))
    seen = F.transform(F.coalesce("o.gate_sequences", F.slice("n.gate_sequences", 1, 0)), lambda g: g["description"])
    fresh = F.filter(F.coalesce("n.gate_sequences", F.slice("o.gate_sequences", 1, 0)), lambda g: ~F.array_contains(seen, g["description"]))
    gates = F.slice(F.concat(F.coalesce("o.gate_sequences", F.slice("n.gate_sequences", 1, 0)), fresh), 1, MAX_GATES)
    kept = F.map_filter("o.memory_snapshot", lambda k, v: ~F.coalesce(F.map_contains_key("n.memory_snapshot", k), F.lit(False)))
    memory = F.when(F.col("o.memory_snapshot").isNull(), F.col("n.memory_snapshot")).when(F.col("n.memory_snapshot").isNull(), F.col("o.memory_snapshot")).otherwise(F.map_concat(kept, F.col("n.memory_snapshot")))
    touched = F.col("n.domain").isNotNull()
    return o.join(n, F.col("o.domain") == F.col("n.domain"), "full").select(
        F.coalesce("o.domain", "n.domain").alias("domain"), F.when(touched, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        (F.coalesce("o.successful_crawl_count", F.lit(0)) + touched.cast("int")).alias("successful_crawl_count"), text("last_goal").alias("last_goal"),
        F.when(touched, both("url_patterns_prefer")).otherwise(F.col("o.url_patterns_prefer")).alias("url_patterns_prefer"),
        F.when(touched, both("url_patterns_skip")).otherwise(F.col("o.url_patterns_skip")).alias("url_patterns_skip"),
        F.when(F.col("o.domain").isNotNull() & touched, gates).otherwise(F.coalesce("o.gate_sequences", "n.gate_sequences")).alias("gate_sequences"), memory.alias("memory_snapshot"),
        text("navigation_hints").alias("navigation_hints"), F.coalesce("o.challenge_seen", "n.challenge_seen").alias("challenge_seen"),
        F.coalesce("o.challenge_passed_with", "n.challenge_passed_with").alias("challenge_passed_with"),
    )


def path_plan(crawls: DataFrame, patterns: DataFrame) -> DataFrame:
    """``crawls`` (domain, goal) with the stored plan, where domain and goal match and it is not empty."""
    known = patterns.where((F.size("url_patterns_prefer") > 0) | (F.size("url_patterns_skip") > 0)).select("domain", F.col("last_goal").alias("goal"), "url_patterns_prefer", "url_patterns_skip")
    return crawls.join(known, ["domain", "goal"], "left")


def learned_patterns(plans: DataFrame, visited: DataFrame) -> DataFrame:
    """(crawl_id, pattern): preferred patterns that stand in some URL the crawl visited."""
    each = plans.select("crawl_id", F.explode("prefer").alias("pattern"))
    return each.join(visited, "crawl_id").where(F.lower("url").contains(F.lower("pattern"))).select("crawl_id", "pattern").distinct()


def drift(now: DataFrame, then: DataFrame, key: str = "program_key") -> DataFrame:
    """(key, status, kept_share) of each program against its snapshot; both hold ``urls`` (distinct) and ``now`` an error.

    ok, grew (more than then), shrank (under KEEP_SHARE kept) or broken.
    """
    d = now.select(key, F.col("urls").alias("__now"), "error").join(then.select(key, F.col("urls").alias("__then")), key)
    had, has = F.size("__then"), F.size("__now")
    broken = F.col("error").isNotNull() | ((has == 0) & (had > 0))
    share = F.when(broken, 0.0).when(had > 0, F.size(F.array_intersect("__now", "__then")) / had).otherwise(1.0)
    status = F.when(broken, "broken").when(share < KEEP_SHARE, "shrank").when(has > had, "grew").otherwise("ok")
    return d.select(key, status.alias("status"), share.alias("kept_share"))


def health(runs: DataFrame, key: str = "program_key", order: str = "run_no") -> DataFrame:
    """``runs`` (error, kept) with ``health`` against the run before: error, empty, dropped or healthy."""
    last = F.lag("kept").over(Window.partitionBy(key).orderBy(order))
    state = (
        F.when(F.col("error").isNotNull() & (F.col("error") != ""), "error")
        .when(F.col("kept") == 0, F.when(last == 0, "healthy").otherwise("empty"))
        .when((last > 0) & (F.col("kept") < MIN_KEPT_SHARE * last), "dropped")
        .otherwise("healthy")
    )
    return runs.withColumn("health", state)


def may_retry(attempts: DataFrame, key: str, at: str, hours: float = HOLD_BACK_HOURS, tie: str | None = None) -> DataFrame:
    """``attempts`` with whether each comes long enough after the one before; ``tie`` orders attempts of one time."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, *([tie] if tie else [])))
    gap = F.unix_micros(at) - F.unix_micros(before)
    return attempts.withColumn("allowed", F.coalesce(gap >= hours * 3_600_000_000, F.lit(True)))


def upsert(store: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` with the rows of ``rows`` in place of those with the same key."""
    return store.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def clearance(hosts: DataFrame, cookies: DataFrame, now: Column) -> DataFrame:
    """(host, cookie) by cookie domain: an equi-join on the suffixes of a host's labels."""
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 100), "."))).alias("domain"))
    live = cookies.where(F.col("expires") > now).select(F.regexp_replace("domain", r"^\.", "").alias("domain"), "cookie")
    return ends.join(live, "domain").select("host", "cookie").distinct()
