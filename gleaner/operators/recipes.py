"""Recipes: the steps that revealed documents on a page, kept, looked up, located again and forgotten.

``steps``: page_url, goal, ord, tool, value, role, name, html_tag, attributes map<string,string>, outcome;
a recipe is one row: host, path, goal, steps array, revealed, replays, last_revealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls

# Tools that can be replayed, the most steps, attributes that are kept, ids that are made on each load.
REPLAYABLE, MAX_STEPS = ("click", "select_option"), 12
KEPT = ("id", "name", "aria-label", "data-testid", "title", "class")
GENERATED_ID = r"[0-9a-f]{8}-[0-9a-f]{4}-|\d{6,}|^(ember|react|radix|mui|headlessui|:r)"


def place_of(url: Column) -> tuple[Column, Column]:
    """(host, path) under which a page's recipe is kept."""
    path = F.regexp_replace(urls.path(url), "/+$", "")
    return urls.bare_host(urls.netloc(url)), F.when(path == "", "/").otherwise(path)


def make_recipes(steps: DataFrame, revealed: DataFrame) -> DataFrame:
    """Recipes of pages (``revealed``: page_url, goal, revealed): steps that worked up to the last one before the last recording.

    A click on what a select addresses, or on another dropdown's button, is no step; pages that revealed nothing have none.
    A page's steps are bounded by its agent's turns.
    """
    per_page = Window.partitionBy("page_url", "goal")
    last = F.coalesce(F.max(F.when(F.col("outcome") == "recorded", F.col("ord"))).over(per_page), F.max("ord").over(per_page))
    d = steps.withColumn("__last", last).where((F.col("ord") <= F.col("__last")) & F.col("tool").isin(*REPLAYABLE) & F.col("role").isNotNull() & (F.coalesce("outcome", F.lit("ok")) != "failed"))
    kept = F.map_filter(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*KEPT) & (F.coalesce(v, F.lit("")) != "") & ~((k == "id") & v.rlike(GENERATED_ID)))
    action = F.when(F.col("tool") == "select_option", "select").otherwise("click")
    d = d.withColumns({"action": action, "attrs": F.map_concat(kept, F.create_map(F.lit("tag"), F.coalesce("html_tag", F.lit("")))), "__who": F.struct("role", "name")})
    selected = F.collect_set(F.when(F.col("action") == "select", F.col("__who"))).over(per_page)
    opens = (F.col("action") == "click") & (F.array_contains(selected, F.col("__who")) | F.coalesce(F.col("attrs")["class"], F.lit("")).contains("select"))
    d = d.withColumn("__opens", opens).where("not __opens")
    step = F.struct("action", "role", "name", F.col("attrs").alias("attributes"), F.when(F.col("action") == "select", F.col("value")).alias("value"))
    host, path = place_of(F.col("page_url"))
    listed = F.array_sort(F.collect_list(F.struct("ord", F.to_json(step).alias("step"))))
    out = d.groupBy("page_url", "goal").agg(F.slice(F.transform(listed, lambda x: x["step"]), 1, MAX_STEPS).alias("steps"))
    return out.join(revealed, ["page_url", "goal"]).where("revealed > 0").select(host.alias("host"), path.alias("path"), "goal", "steps", "revealed", F.lit(0).alias("replays"), F.lit(None).cast("int").alias("last_revealed"))


def look_up(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """``pages`` (page_url) with the recipe of their host and path."""
    host, path = place_of(F.col("page_url"))
    return pages.withColumns({"host": host, "path": path}).join(recipes, ["host", "path"], "left")


def after_replays(recipes: DataFrame, replays: DataFrame) -> DataFrame:
    """The store after replays (host, path, at, revealed): counted and kept where the last one revealed something, else forgotten."""
    r = replays.groupBy("host", "path").agg(F.count("*").alias("__n"), F.max_by("revealed", "at").alias("__last"), F.min("revealed").alias("__least"))
    d = recipes.join(r, ["host", "path"], "left").where(F.col("__least").isNull() | (F.col("__least") > 0))
    return d.withColumns({"replays": F.col("replays") + F.coalesce("__n", F.lit(0)), "last_revealed": F.coalesce("__last", "last_revealed")}).drop("__n", "__last", "__least")


def locate(steps: DataFrame, elements: DataFrame, scope: list[str]) -> DataFrame:
    """(scope.., ord, element): the element each step means on the page as it is now, null from the first miss on.

    ``steps``: scope.., ord, role, name, attributes; ``elements``: scope.., element (place on the page), role, name, html_tag,
    attributes.  The ways are tried in turn: id, test id, role and name, role and part of the name, name alone, then the
    name, label and title attributes; of several alike the one with the recorded tag and class, then the first.
    """
    s, e = steps.alias("s"), elements.alias("e")
    a, b = F.col("s.attributes"), F.col("e.attributes")
    same = lambda k: (F.coalesce(a[k], F.lit("")) != "") & (a[k] == b[k])
    role = (F.coalesce("s.role", F.lit("")) != "") & (F.coalesce("s.name", F.lit("")) != "") & (F.col("s.role") == F.col("e.role"))
    way = (
        F.when(same("id"), 0).when(same("data-testid"), 1).when(role & (F.col("s.name") == F.col("e.name")), 2)
        .when(role & F.lower("e.name").contains(F.lower("s.name")), 3).when((F.coalesce("s.name", F.lit("")) != "") & (F.col("s.name") == F.col("e.name")), 4)
        .when(same("name"), 5).when(same("aria-label"), 6).when(same("title"), 7)
    )
    other = F.when(((F.coalesce(a["tag"], F.lit("")) == "") | (F.lower(a["tag"]) == F.lower("e.html_tag"))) & ((F.coalesce(a["class"], F.lit("")) == "") | a["class"].eqNullSafe(b["class"])), 0).otherwise(1)
    pairs = s.join(e, [F.col(f"s.{c}") == F.col(f"e.{c}") for c in scope]).select(*[F.col(f"s.{c}").alias(c) for c in scope], F.col("s.ord").alias("ord"), F.col("e.element").alias("element"), way.alias("way"), other.alias("other"))
    best = pairs.where("way is not null").groupBy(*scope, "ord").agg(F.min_by("element", F.struct("way", "other", "element")).alias("element"))
    d = steps.select(*scope, "ord").distinct().join(best, [*scope, "ord"], "left")
    missed = F.max(F.col("element").isNull().cast("int")).over(Window.partitionBy(*scope).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__miss", missed).select(*scope, "ord", F.when(F.col("__miss") == 0, F.col("element")).alias("element"))
