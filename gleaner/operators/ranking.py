"""What to visit next: path statistics, tier order, bandit replay, stop rules."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.session import written

# Tiers of page kinds (others 2), bandit and stop parameters.
TIERS = {"seed": 0, "document_listing": 1, "listing": 1, "fund_or_product": 1, "category": 2, "category_or_overview": 2, "other": 2, "news": 3, "legal": 3, "news_or_article": 3, "company_or_legal": 3}
PRIOR_MEAN, PRIOR_PULLS, EXPLORE, NEW_GROUP_CREDIT, DRY_PAGES = 0.7, 1, 0.3, 0.5, 7
STALE_STOP, STALE_SHARE = 12, 0.5


def path_sample(pages: DataFrame, scope: list[str], order: str, limit: int = 80) -> DataFrame:
    """(scope.., prefix, n, rank): sections, and subsections of two pages or more, the most populated first.

    One pass explodes both levels; ties go to the first to appear, sections before subsections.
    """
    segments = F.filter(F.split(F.lower(urls.unquote(urls.path(F.col("url")))), "/"), lambda s: s != "")
    d = pages.select(*scope, order, segments.alias("s"))
    levels = F.array_compact(F.array(
        F.when(F.size("s") > 0, F.struct(F.lit(1).alias("level"), F.concat(F.lit("/"), F.get("s", 0), F.lit("/")).alias("prefix"))),
        F.when(F.size("s") > 1, F.struct(F.lit(2).alias("level"), F.concat(F.lit("/"), F.get("s", 0), F.lit("/"), F.get("s", 1), F.lit("/")).alias("prefix"))),
    ))
    g = d.select(*scope, order, F.explode(levels).alias("x")).groupBy(*scope, "x.level", "x.prefix").agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    g = g.where("level = 1 or n > 1")
    w = Window.partitionBy(*scope).orderBy(F.desc("n"), "level", "__first", "prefix")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("__first")


def numbered(rows: DataFrame, scope: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` numbered from 1 in order within each scope, a scope of any size spread over all tasks.

    Rows are sorted into ranges over all of (scope, order), each range is numbered by itself, and the numbers of a scope's
    earlier ranges are added: a scope has one count per range it touches.  Equal rows are numbered in any order.
    """
    names = [f"__o{i}" for i in range(len(order))]
    d = rows.withColumns(dict(zip(names, order, strict=True))).repartitionByRange(*scope, *names)
    d = written(d.withColumn("__part", F.spark_partition_id()))
    sizes = d.groupBy(*scope, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*scope).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(scope)], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    on = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(scope)] + [F.col("__part") == F.col("__p")]
    d = d.withColumn("__rn", F.row_number().over(Window.partitionBy(*scope, "__part").orderBy(*names))).join(sizes, on)
    return d.withColumn(out, (F.col("__rn") + F.col("__before")).cast("int")).drop("__rn", "__before", "__part", "__p", *names, *[f"__s{i}" for i in range(len(scope))])


def rank_by_paths(pages: DataFrame, scope: list[str], order: str, prefer: str, skip: str, years: str) -> DataFrame:
    """``pages`` with ``rank``: preferred paths in plan order, then goal years, then the rest, skipped ones last."""
    p = F.lower(urls.unquote(urls.path(F.col("url"))))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(prefer) - 1, F.lit(0))), lambda i: p.contains(F.get(F.col(prefer), i)))
    inside = lambda c: F.exists(c, lambda x: p.contains(x))
    band = F.when(F.size(hits) > 0, F.struct(F.lit(0).alias("a"), F.array_min(hits).alias("b"))).when(inside(years), F.struct(F.lit(0).alias("a"), F.size(prefer).alias("b")))
    band = band.when(inside(skip), F.struct(F.lit(2).alias("a"), F.lit(0).alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")))
    return numbered(pages, scope, [band["a"], band["b"], F.col(order)], "rank")


def tier(kind: Column, revealed: Column, goal_year: Column) -> Column:
    t = F.coalesce(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])[kind], F.lit(2))
    return F.when(revealed | (goal_year & (t == 2)), 1).otherwise(t)


def order_key(d: dict[str, Column]) -> list[Column]:
    """The nine parts of the tier order; d holds kind, probability, depth, order and the flags."""
    flag = lambda c: F.when(d[c], 1).otherwise(0)
    band = F.when(d["revealed"], 0).when(d["goal_year"], 1).when(d["planned"], 2).otherwise(3)
    return [flag("other_language"), tier(d["kind"], d["revealed"], d["goal_year"]), band, F.lit(0), flag("chrome"), flag("path_seen"), -d["probability"], d["depth"], d["order"]]


def tier_order(queue: DataFrame, scope: list[str]) -> DataFrame:
    """``queue`` with ``position`` in tier order."""
    cols = {c: F.col(c) for c in ("kind", "probability", "depth", "order", "other_language", "revealed", "goal_year", "planned", "chrome", "path_seen")}
    return queue.withColumn("position", F.row_number().over(Window.partitionBy(*scope).orderBy(*order_key(cols))))


def replay(pages: DataFrame, policy: str, budget: int, explore: float = EXPLORE, dry: int = DRY_PAGES) -> DataFrame:
    """(crawl_id, step, url, accepted): each recorded crawl's queue visited in a policy's order.

    ``pages``: crawl_id, url, grp, outer (comparable array), inner (array), accepted.
    Policies: ``tier``, ``bandit`` and ``rescue`` (tier until ``dry`` pages without
    an accepted document, then bandit).  Crawls are independent and run in
    parallel; one crawl's queue is bounded by the crawl's own caps.  Within the
    best outer class each group offers its best link; group heads live in heaps,
    so a step costs the number of groups, not of links.
    """

    def visit(queue) -> list[tuple[int, str, int]]:
        heaps: dict[tuple, dict[str, list]] = {}
        for r in queue:
            heapq.heappush(heaps.setdefault(tuple(r["outer"]), {}).setdefault(r["grp"], []), (tuple(r["inner"]), r["url"], int(r["accepted"])))
        stats: dict[str, list[float]] = {}
        out, pulls, stale, rescued = [], 0, 0, policy == "bandit"
        while heaps and len(out) < budget:
            groups = heaps[best := min(heaps)]
            rescued = rescued or (policy == "rescue" and stale >= dry)

            def worth(g: str) -> tuple:
                n, reward = stats.get(g, (0, 0.0))
                mean = (PRIOR_MEAN * PRIOR_PULLS + reward) / (PRIOR_PULLS + n)
                score = mean + explore * math.sqrt(math.log(pulls + 2) / (PRIOR_PULLS + n)) if rescued else 0.0
                return score, [-x for x in groups[g][0][0]]

            pick = max(sorted(groups), key=worth)
            _, url, accepted = heapq.heappop(groups[pick])
            if not groups[pick]:
                del groups[pick]
                if not groups:
                    del heaps[best]
            s = stats.setdefault(pick, [0, 0.0])
            s[0], s[1], pulls, stale = s[0] + 1, s[1] + math.log1p(accepted), pulls + 1, 0 if accepted else stale + 1
            out.append((pulls, url, accepted))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(crawl, *step) for crawl, queue in zip(pdf["crawl_id"], pdf["queue"], strict=True) for step in visit(queue)]
            yield pd.DataFrame(rows, columns=["crawl_id", "step", "url", "accepted"])

    queues = pages.groupBy("crawl_id").agg(F.collect_list(F.struct("url", "grp", "outer", "inner", "accepted")).alias("queue"))
    return queues.mapInPandas(run, "crawl_id string, step int, url string, accepted int")


def stale_runs(trace: DataFrame, scope: list[str], order: str, paid: Column) -> DataFrame:
    """``trace`` with ``stale``: how many rows up to this one, without a break, paid nothing (gaps and islands)."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = trace.withColumn("__paid", paid.cast("int")).withColumn("__island", F.sum("__paid").over(w))
    inner = Window.partitionBy(*scope, "__island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("stale", F.sum(1 - F.col("__paid")).over(inner)).drop("__paid", "__island")


def should_stop(stale: Column, pages_done: Column, max_pages: Column, elapsed: Column, max_seconds: Column) -> Column:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return (stale >= STALE_STOP) & (F.greatest(share(pages_done, max_pages), share(elapsed, max_seconds)) >= STALE_SHARE)


def within_budget(rows: DataFrame, scope: list[str], order: str, cost: str, budget: float) -> DataFrame:
    """Rows in order while the running sum of their cost stays within the budget."""
    w = Window.partitionBy(*scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def batches(rows: DataFrame, scope: list[str], order: str, size: int = 20) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*scope).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))


def escalation_trigger(typed_form: Column, has_filter: Column, kind: Column, docs: Column, new_pages: Column, accepted: Column, hidden: Column, crawl_accepted: Column, canvas: Column | None = None) -> Column:
    """Why a page is worth an agent's look, or null: a canvas, a form to type in while nothing is found, a listing behind a
    filter, an empty page of a kind that lists documents."""
    listing = (kind == "document_listing") & has_filter
    nothing = docs == 0
    drawn = F.lit(False) if canvas is None else F.coalesce(canvas, F.lit(False))
    return (
        F.when(drawn, "canvas")
        .when(typed_form & nothing & (crawl_accepted == 0), "typed_form")
        .when(~listing & ~(nothing & (new_pages < 5)) & (accepted > 0), None)
        .when(listing & (hidden >= 0.7) & (docs <= 5), "filtered_listing")
        .when(nothing & (hidden >= 0.9) & kind.isin("document_listing", "fund_or_product") & (crawl_accepted == 0), "empty_page")
    )


def escalation_skip(now: Column, deadline: Column, spent: Column, cap: Column) -> Column:
    return F.when(now > deadline - 30, "time").when(spent >= cap, "tokens")

