"""Operators over traces of crawls, programs and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls


def page_numbers(visits: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``visits`` with their number in order of completion."""
    return visits.withColumn("page_no", F.row_number().over(Window.partitionBy(*scope).orderBy(order)))


def last_steps(steps: DataFrame, scope: list[str], order: str, n: int = 10) -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(F.desc(order))
    return steps.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def revealed_since(now: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """Links that are there now and were not shown before."""
    return now.join(shown.select(*keys).distinct(), keys, "left_anti")


def take_revealed(links: DataFrame, listing: str, known: DataFrame) -> DataFrame:
    """Revealed links of a listing: other pages always, its next pages only where the others brought something new.

    ``listing`` holds the listing's url; ``known`` the urls (listing, url) seen before.
    """
    d = links.withColumn("next_page", urls.paging_identity(F.col("url")) == urls.paging_identity(F.col(listing)))
    fresh = d.where("not next_page").join(known, [listing, "url"], "left_anti").select(listing).distinct().withColumn("__new", F.lit(True))
    return d.join(fresh, listing, "left").where(~F.col("next_page") | F.coalesce("__new", F.lit(False))).drop("__new")


def repeated_calls(calls: DataFrame, scope: list[str], signature: list[str], order: str) -> DataFrame:
    """``calls`` with the place of the first identical call before each, or null."""
    first = F.min(order).over(Window.partitionBy(*scope, *signature))
    return calls.withColumn("same_as", F.when(first < F.col(order), first))


def stalled_runs(runs: DataFrame, scope: list[str], order: str, facts: list[str]) -> DataFrame:
    """``runs`` with whether each gave the same as the one before."""
    w = Window.partitionBy(*scope).orderBy(order)
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return runs.withColumn("stalled", same & (F.row_number().over(w) > 1))


def best_so_far(runs: DataFrame, scope: list[str], order: str, value: str, error: Column) -> DataFrame:
    """``runs`` with the order of the best run up to each, the first on ties, errors left out."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max(F.when(~error, F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o")))).over(w)
    return runs.withColumn("best", -pick["o"])


def learned_hosts(calls: DataFrame, scope: list[str]) -> DataFrame:
    """(scope.., kind, value): data hosts of JSON calls and endpoints that were posted to."""
    d = calls.where(F.lower("content_type").contains("json"))
    host = d.select(*scope, F.lit("host").alias("kind"), urls.domain(F.col("url")).alias("value"))
    post = d.where("method = 'POST'").select(*scope, F.lit("post").alias("kind"), urls.endpoint(F.col("url")).alias("value"))
    return host.unionByName(post).distinct()


def outcome_matrix(checks: DataFrame, key: str, way: str, outcome: str, ways: list[str]) -> DataFrame:
    return checks.groupBy(key).pivot(way, ways).agg(F.min(outcome))


def usage(requests: DataFrame, scope: list[str], price_in: float, price_out: float) -> DataFrame:
    """Requests, tokens and cost per scope."""
    cost = (F.sum("input_tokens") * price_in + F.sum("output_tokens") * price_out) / 1_000_000
    return requests.groupBy(*scope).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(cost, 6).alias("cost"))


def url_groups(links: DataFrame, scope: list[str], order: str, cap: int = 8) -> DataFrame:
    """One sample per group of links whose host and path agree but for the last two segments, ``cap`` groups per scope."""
    d = links.withColumn("grp", F.concat(urls.netloc(F.col("url")), F.regexp_replace(urls.path(F.col("url")), "(/[^/]*){1,2}$", "")))
    g = d.groupBy(*scope, "grp").agg(F.min_by("url", order).alias("sample"), F.min(order).alias("__first"), F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy("__first"))).where(F.col("rank") <= cap).drop("__first")


def hold_open(queue: DataFrame, scope: list[str]) -> DataFrame:
    """Per crawl: whether an untried first-tier group, a page of the goal's year, or a menu's listing still waits."""
    return queue.groupBy(*scope).agg(
        F.bool_or((F.col("tier") <= 1) & ~F.col("picked")).alias("untried_tier1"), F.bool_or((F.col("tier") <= 1) & F.col("goal_year")).alias("goal_year_page"),
        F.bool_or((F.col("kind") == "document_listing") & F.col("chrome")).alias("menu_listing"),
    )


def for_year(docs: DataFrame, year: str, wanted: str) -> DataFrame:
    """Documents of the year asked for, and those without a year."""
    return docs.where(F.coalesce(F.col(year) == wanted, F.lit(True)))


def zipped(items: DataFrame, answers: DataFrame, scope: list[str]) -> DataFrame:
    """``items`` with the answer of the same batch and place; none where the answers ran out."""
    return items.join(answers, [*scope, "ord"], "left")


def within_fetch_budget(calls: DataFrame, scope: list[str], order: str, requests: int = 400, renders: int = 40, most_bytes: int = 4_000_000) -> DataFrame:
    """``calls`` (kind: fetch, post, render or interact; url; body) of programs with ``answer``: ``cached`` where the same fetch came
    before, ``spent`` beyond ``requests`` new calls or ``renders`` pages, ``cut`` for a body longer than ``most_bytes``, else ``new``."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    again = (F.col("kind") == "fetch") & (F.row_number().over(Window.partitionBy(*scope, "kind", "url").orderBy(order)) > 1)
    d = calls.withColumn("__new", (~again).cast("int"))
    page = F.col("kind").isin("render", "interact")
    d = d.withColumns({"__calls": F.sum("__new").over(w), "__pages": F.sum(page.cast("int")).over(w)})
    answer = F.when(F.col("__new") == 0, "cached").when((F.col("__calls") > requests) | (page & (F.col("__pages") > renders)), "spent").when(F.octet_length("body") > most_bytes, "cut").otherwise("new")
    return d.withColumn("answer", answer).drop("__new", "__calls", "__pages")
