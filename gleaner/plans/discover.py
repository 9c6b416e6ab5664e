"""Discovery over recorded pages: links, split, dedupe, judgement, series, result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import periods, urls
from gleaner.operators.judging import Judge, judged, rule_judge
from gleaner.operators.links import first_wins, hand_down_dates, merge_links
from gleaner.operators.series import apply_latest, mark_latest, with_series
from gleaner.sources.sinks import RESULT


def page_links(pages: DataFrame) -> DataFrame:
    """Recorded links of pages, one row each, in order."""
    d = pages.select("page_id", "site", F.col("url").alias("page_url"), "page_kind", "crawl_id", F.posexplode("page_links").alias("ord", "l"))
    return d.select("page_id", "site", "page_url", "page_kind", "crawl_id", "ord", "l.*")


def returned(docs: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Documents that a caller gets: all but the rejected ones, unless asked for; a null verdict is not rejected."""
    return docs if include_rejected else docs.where(F.coalesce("verdict", F.lit("")) != "rejected")


def rejected_counts(docs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope.., returned, rejected): what :func:`returned` keeps and leaves out."""
    gone = F.coalesce("verdict", F.lit("")) == "rejected"
    return docs.groupBy(*scope).agg(F.count_if(~gone).alias("returned"), F.count_if(gone).alias("rejected"))


def sitemap_documents(entries: DataFrame) -> DataFrame:
    """Documents that sitemaps name (crawl_id, url, lastmod): known before the first page is read."""
    d = entries.where(urls.is_document(F.col("url"))).select("crawl_id", "url", F.coalesce("lastmod", F.lit("")).alias("dated"))
    name = F.element_at(F.split(F.regexp_replace(urls.path(F.col("url")), "/+$", ""), "/"), -1)
    return d.withColumns({"name": urls.unquote(name), "context": F.lit(""), "section": F.lit(""), "col_label": F.lit(""), "path": F.lit(""), "chrome": F.lit(False), "source_page": F.lit(None).cast("string"), "source": F.lit("sitemap")})


def discover(pages: DataFrame, terms: Column, judge: Judge | None = None, latest: bool = False, include_rejected: bool = False, sitemap: DataFrame | None = None) -> DataFrame:
    """The documents of recorded pages in result form, per crawl.

    Links are merged per page, split into documents and pages, documents taken
    once per crawl, those of sitemaps first, then in order of page and place,
    judged, given their date, year, period and series; rejected ones are left out
    unless asked for, and with ``latest`` superseded ones too.
    """
    links = merge_links(page_links(pages), ["crawl_id", "page_id", "page_url"], "ord")
    docs = links.where(urls.is_document(F.col("url"))).withColumnRenamed("page_url", "source_page").withColumns({"source": F.lit("page"), "__rank": F.lit(1)})
    if sitemap is not None:
        early = sitemap_documents(sitemap).withColumns({"page_id": F.lit(None).cast("long"), "first_ord": F.lit(0), "__rank": F.lit(0)})
        docs = docs.unionByName(early)
    docs = docs.withColumn("url_key", urls.canonical(F.col("url")))
    docs = first_wins(docs, ["crawl_id", "url_key"], [F.col("__rank"), F.col("page_id"), F.col("first_ord"), F.col("url")]).drop("__rank")
    led = links.where(~urls.is_document(F.col("url"))).select(F.col("url").alias("to_url"), "dated", F.col("page_id").alias("ord"))
    docs = hand_down_dates(docs, led, pages.select("url", "page_kind"))
    docs = judged(docs, judge or rule_judge(terms))
    docs = with_series(docs).withColumn("published", periods.date_of(F.concat_ws(" ", "dated_by", "context")))
    docs = mark_latest(docs, ["crawl_id"])
    docs = docs.withColumn("year", periods.year_of(F.concat_ws(" ", "dated_by", "name", "context", "url")))
    docs = docs.withColumns({"series": F.col("series_key"), "latest_in_series": F.col("latest"), "reason": F.lit("")})
    docs = returned(docs, include_rejected)
    return (apply_latest(docs, include_rejected) if latest else docs).select("crawl_id", *RESULT)
