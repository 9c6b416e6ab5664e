"""From a goal to a plan for a site: terms, path plans grounded in the site's own sections, learned patterns, hidden pages.

Model answers are recorded rows of JSON text; everything else is reckoned from tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import texts, urls
from gleaner.operators.ranking import path_sample, rank_by_paths

# Patterns of a plan at most, pages from which a site is worth a plan, sitemap pages that are scored.
MAX_PATTERNS, MIN_PAGES, PAGES_SCORED = 12, 50, 1000
GATE_TOOLS = ("select_option", "fill_input", "click")


def crawl_plans(answers: DataFrame) -> DataFrame:
    """``answers`` (goal, answer: a model's text) with the plan it holds: doc_types, key_terms, url_patterns_prefer and
    url_patterns_skip, empty where it holds none."""
    kind = "doc_types array<string>, key_terms array<string>, url_patterns_prefer array<string>, url_patterns_skip array<string>"
    p = F.from_json(texts.json_object(F.col("answer")), kind)
    none = F.array().cast("array<string>")
    return answers.select("goal", *[F.coalesce(p[c], none).alias(c) for c in ("doc_types", "key_terms", "url_patterns_prefer", "url_patterns_skip")])


def path_plans(pages: DataFrame, answers: DataFrame, scope: list[str], order: str) -> DataFrame:
    """(scope.., prefer, skip): a model's answer (scope.., prefer, skip) as far as it stands on the site: parts of the site's
    most populated sections, the first :data:`MAX_PATTERNS`, skipped ones not preferred; nothing for small sites.

    ``pages``: scope.., url.
    """
    sizes = pages.groupBy(*scope).agg(F.count("*").alias("__n"))
    sections = path_sample(pages, scope, order).groupBy(*scope).agg(F.collect_list("prefix").alias("__known"))  # at most 80 a site
    d = answers.join(sizes, scope).join(sections, scope)
    clean = lambda c: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: (v != "") & F.exists("__known", lambda k: k.contains(v))), 1, MAX_PATTERNS)
    none = F.array().cast("array<string>")
    big = F.col("__n") >= MIN_PAGES
    d = d.withColumns({"prefer": F.when(big, clean("prefer")).otherwise(none), "skip": F.when(big, clean("skip")).otherwise(none)})
    return d.select(*scope, "prefer", F.filter("skip", lambda v: ~F.array_contains("prefer", v)).alias("skip"))


def combined_patterns(plan: Column, learned: Column) -> Column:
    """A plan's patterns and then those learned before, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(plan, none), F.coalesce(learned, none)))


def learned_gates(steps: DataFrame) -> DataFrame:
    """(crawl_id, ord, tool, hint, value) of the steps that open gates, for a model to put in words."""
    return steps.where(F.col("tool").isin(*GATE_TOOLS)).select("crawl_id", "ord", "tool", F.coalesce("hint", F.lit("")).alias("hint"), F.coalesce("value", F.lit("")).alias("value"))


def sitemap_queue(entries: DataFrame, plans: DataFrame, scope: list[str], order: str, limit: int = PAGES_SCORED) -> DataFrame:
    """(scope.., url, rank): content pages of sitemaps, the plan's paths first, ``limit`` per site (what a crawl scores).

    ``plans``: scope.., prefer, skip, years.
    """
    none = F.array().cast("array<string>")
    d = entries.where(urls.sitemap_page(F.col("url"))).join(plans, scope, "left").withColumns({c: F.coalesce(c, none) for c in ("prefer", "skip", "years")})
    return rank_by_paths(d, scope, order, "prefer", "skip", "years").where(F.col("rank") <= limit).select(*scope, "url", "rank")


def union_prefixes(memory: DataFrame, learned: DataFrame, scope: list[str]) -> DataFrame:
    """What a crawl knows of prefixes after a page."""
    return memory.select(*scope, "prefix").unionByName(learned.select(*scope, "prefix")).distinct()


def counted(events: DataFrame, scope: list[str], kind: str) -> DataFrame:
    """(scope.., counts map): how often each kind of event came, as one map."""
    n = events.where(F.col(kind).isNotNull()).groupBy(*scope, kind).agg(F.count("*").alias("n"))
    return n.groupBy(*scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))  # a few kinds


def latencies(requests: DataFrame, scope: list[str], value: str) -> DataFrame:
    """(scope.., n, p50, p95): exact quantiles of each scope's values."""
    return requests.groupBy(*scope).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def first_in_window(rows: DataFrame, scope: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each scope, a report of the head."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(order))).where(F.col("place") <= n)
