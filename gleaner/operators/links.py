"""Links of pages: merging, first-wins, facets, variants, dates handed down, prefixes.

"First wins" is always by an explicit order column, through aggregates of fixed
size (``min_by``) that combine before the shuffle, so a hot url costs nothing more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.functions.texts import is_chrome_path


def merge_links(links: DataFrame, scope: list[str], order: str) -> DataFrame:
    """One row per (scope.., url): the longest name, the shortest context that is not empty, the first section and
    column that are not empty, path and date of the first row even if empty, chrome only if every row is."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    first = lambda c: F.coalesce(F.min_by(F.when(text(c) != "", F.col(c)), F.when(text(c) != "", F.col(order))), F.lit(""))
    context = F.when(text("context") != "", F.struct(F.length("context").alias("n"), F.col(order).alias("o")))
    return links.groupBy(*scope, "url").agg(
        F.max_by(text("name"), F.struct(F.length(text("name")).alias("n"), (-F.col(order)).alias("o"))).alias("name"),
        F.coalesce(F.min_by("context", context), F.lit("")).alias("context"),
        first("section").alias("section"), first("col_label").alias("col_label"),
        F.min_by(text("path"), order).alias("path"), F.min_by(text("dated"), order).alias("dated"),
        F.bool_and(F.coalesce("chrome", F.lit(False))).alias("chrome"), F.min(order).alias("first_ord"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__r")).select(*keys, "__r.*")


def union_sources(parts: list[tuple[int, DataFrame]], keys: list[str], order: str) -> DataFrame:
    """Rows of several sources, the first source and then the first row winning per key."""
    all_ = None
    for rank, df in parts:
        df = df.withColumn("source_rank", F.lit(rank))
        all_ = df if all_ is None else all_.unionByName(df, allowMissingColumns=True)
    return first_wins(all_, keys, [F.col("source_rank"), F.col(order)])


def facet_groups(links: DataFrame, page_url: str, order: str) -> DataFrame:
    """(page_url, facet, n, urls) of the links that differ from their page by one facet pair, three or more under one key."""
    pairs = lambda c: F.transform(urls.pairs(F.col(c)), lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    d = links.withColumns({"__own": pairs("url"), "__base": pairs(page_url)})
    same = lambda a, b: F.regexp_replace(a, "/+$", "") == F.regexp_replace(b, "/+$", "")
    d = d.where((urls.netloc(F.col("url")) == urls.netloc(F.col(page_url))) & same(urls.path(F.col("url")), urls.path(F.col(page_url))))
    minus = lambda a, b: F.filter(F.array_distinct(a), lambda x: count(a, x) > count(b, x))
    excess = lambda a, b: F.aggregate(F.transform(F.array_distinct(a), lambda x: F.greatest(count(a, x) - count(b, x), F.lit(0))), F.lit(0), lambda s, x: s + x)
    d = d.withColumns({"__added": minus(F.col("__own"), F.col("__base")), "__gone": minus(F.col("__base"), F.col("__own")), "__n": excess(F.col("__own"), F.col("__base")), "__m": excess(F.col("__base"), F.col("__own"))})
    k = F.substring_index(F.get("__added", F.lit(0)), "=", 1)
    v = F.expr("substr(get(__added, 0), instr(get(__added, 0), '=') + 1)")
    d = d.where("__n = 1 and __m <= 1").withColumns({"__k": k, "__v": v, "__g": F.substring_index(F.try_element_at("__gone", F.lit(1)), "=", 1)})
    d = d.where((F.col("__v") != "") & (F.col("__g").isNull() | (F.col("__g") == F.col("__k"))))
    d = d.where(~F.col("__k").rlike(urls.PAGING) & (F.col("__k").contains("[") | F.col("__k").rlike(urls.FACET)))
    g = d.groupBy(page_url, urls.facet_key(F.col("__k")).alias("facet")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("url")).alias("urls"))
    return g.where("n >= 3")


def cap_variants(queue: DataFrame, scope: list[str], order: str, cap: int = 3) -> DataFrame:
    """Rows in order, at most ``cap`` of one paging identity; a first-page variant of a queued path takes no place."""
    d = queue.withColumn("identity", urls.paging_identity(F.col("url"))).withColumn("__p", urls.is_first_page(F.col("url")))
    w = Window.partitionBy(*scope, "identity").orderBy(order)
    d = d.withColumn("__rn", F.row_number().over(w)).where("__rn = 1 or not __p")
    return d.withColumn("variant", F.row_number().over(w)).where(F.col("variant") <= cap).drop("__p", "__rn")


def hand_down_dates(docs: DataFrame, links: DataFrame, pages: DataFrame, page_key: str = "url") -> DataFrame:
    """``docs`` with ``dated_by``: their own date, else the date beside the link that led to their page.

    Not for pages of kinds seed, listing or category.  ``links``: to_url, dated, ord.
    """
    led = links.where("dated is not null and dated <> ''").groupBy("to_url").agg(F.min_by("dated", "ord").alias("__led"))
    kinds = pages.select(F.col(page_key).alias("__page"), F.col("page_kind").alias("__kind")).groupBy("__page").agg(F.min("__kind").alias("__kind"))
    d = docs.join(led, docs["source_page"] == led["to_url"], "left").drop("to_url").join(kinds, F.col("source_page") == F.col("__page"), "left").drop("__page")
    given = F.when(~F.coalesce("__kind", F.lit("other")).isin("seed", "listing", "category", "document_listing"), F.col("__led"))
    return d.withColumn("dated_by", F.coalesce(F.nullif("dated", F.lit("")), given)).drop("__led", "__kind")


def learn_prefixes(hrefs: DataFrame, paths: DataFrame, scope: list[str]) -> DataFrame:
    """(scope.., prefix): what rendered links put before paths that JSON gives relatively.

    The suffix join is an equi-join on the suffixes of each href's path at its
    slashes, so it hashes; a path has few segments, so the fan-out is small.
    """
    p = hrefs.select(*scope, urls.path(F.col("href")).alias("__path")).distinct()
    cuts = F.sequence(F.lit(2), F.greatest(F.length("__path"), F.lit(2)))
    ends = p.select(*scope, "__path", F.explode(F.filter(cuts, lambda i: F.substr("__path", i, F.lit(1)) == "/")).alias("__at"))
    ends = ends.select(*scope, F.expr("substr(__path, __at)").alias("path"), F.expr("substr(__path, 1, __at - 1)").alias("prefix"))
    return ends.join(paths.where(F.col("path").startswith("/")).select(*scope, "path").distinct(), [*scope, "path"]).select(*scope, "prefix").distinct()


def json_urls(records: DataFrame, prefixes: DataFrame, scope: list[str], origin: str, order: str) -> DataFrame:
    """(scope.., url, name): records' URLs; relative ones behind each known prefix, or bare where none is known."""
    known = prefixes.groupBy(*scope).agg(F.array_sort(F.collect_set("prefix")).alias("__known"))  # a site's prefixes are few
    d = records.join(known, scope, "left")
    made = F.when(F.col("path").startswith("http"), F.array("path")).otherwise(
        F.transform(F.coalesce("__known", F.array(F.lit(""))), lambda x: F.concat(F.regexp_extract(origin, r"^([a-zA-Z]+://[^/]+)", 1), x, F.col("path")))
    )
    return first_wins(d.select(*scope, F.explode(made).alias("url"), "name", order), [*scope, "url"], [F.col(order)])


def probe_samples(links: DataFrame, scope: list[str], order: str, cap: int = 8) -> DataFrame:
    """First and last link of each sibling group (one tag path outside the frame, two or more links), ``cap`` per scope."""
    d = links.where((F.coalesce("path", F.lit("")) != "") & ~is_chrome_path(F.col("path")))
    g = d.groupBy(*scope, "path").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.min_by("url", order).alias("first"), F.max_by("url", order).alias("last"), F.count("*").alias("n")).where("n > 1")
    both = g.select(*scope, "path", "lo", F.posexplode(F.array("first", "last")).alias("side", "url"))
    w = Window.partitionBy(*scope).orderBy("lo", "side")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("lo")


def spread_answers(links: DataFrame, samples: DataFrame, answers: DataFrame, scope: list[str]) -> DataFrame:
    """``links`` with ``is_document``: a group all of whose probed links answered yes is documents as a whole."""
    probed = samples.join(answers, "url", "left").select(*scope, "path", "url", F.coalesce("is_document", F.lit(False)).alias("__yes"))
    whole = probed.groupBy(*scope, "path").agg(F.bool_and("__yes").alias("__all"))
    own = probed.groupBy(*scope, "path", "url").agg(F.bool_or("__yes").alias("__own"))
    d = links.join(whole, [*scope, "path"], "left").join(own, [*scope, "path", "url"], "left")
    return d.withColumn("is_document", F.coalesce("__all", F.lit(False)) | F.coalesce("__own", F.lit(False))).drop("__all", "__own")


def crossed_hosts(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(crawl_id, host) a crawl may visit: the seed's own and those the seed page links."""
    own = seeds.select("crawl_id", urls.domain(F.col("seed_url")).alias("host"))
    far = links.join(seeds, (links["page_url"] == seeds["seed_url"]) & (links["crawl_id"] == seeds["crawl_id"])).select(seeds["crawl_id"], urls.domain(links["url"]).alias("host"))
    return own.unionByName(far).where("host <> ''").distinct()
