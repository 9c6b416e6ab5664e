"""Documents told by what servers answer: recorded header answers, budgets, spread over sibling groups.

``headers`` holds one row per asked url: crawl_id, ord (order of asking), url,
page_url, status, content_type, disposition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import texts, urls

# Probes per page and crawl, statuses of a refusal.
PER_PAGE, PER_CRAWL, REFUSED = 8, 120, (403, 429, 503)


def origin(u: Column) -> Column:
    return F.concat_ws("://", urls.scheme(u), urls.netloc(u))


def answer_kind(status: Column, content_type: Column, disposition: Column) -> Column:
    """document, page, refused, error, or none without an answer."""
    document = texts.is_document_response(content_type, disposition)
    return F.when(status.isNull(), "none").when(status.isin(*REFUSED), "refused").when(status >= 400, "error").when(document, "document").otherwise("page")


def probe_answers(headers: DataFrame, cap: int = PER_CRAWL) -> DataFrame:
    """(crawl_id, ord, url, way, kind, is_document) of the first ``cap`` probes of each crawl.

    Once a probe of the crawl was refused, urls of the page's own origin are asked from the page (way ``page``), others
    over http still; only a document or a page is an answer, all else is null.
    """
    w = Window.partitionBy("crawl_id").orderBy("ord")
    d = headers.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap)
    refused = F.col("status").isin(*REFUSED).cast("int")
    before = F.coalesce(F.max(refused).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    way = F.when(before & (origin(F.col("url")) == origin(F.col("page_url"))), "page").otherwise("http")
    kind = answer_kind(F.col("status"), F.col("content_type"), F.col("disposition"))
    told = F.when(kind == "document", True).when(kind == "page", False)
    return d.select("crawl_id", "ord", "url", way.alias("way"), kind.alias("kind"), told.alias("is_document"))


def answer_counts(answers: DataFrame) -> DataFrame:
    """(crawl_id, kind, n) of the answers given from the page."""
    return answers.where("way = 'page'").groupBy("crawl_id", "kind").agg(F.count("*").alias("n"))


def sorted_listing(links: DataFrame, answers: DataFrame, scope: list[str], order: str, cap: int = PER_PAGE) -> DataFrame:
    """Links without sibling structure with ``is_document``: one probe per group of urls alike but for the last two
    segments, ``cap`` groups per scope, its answer for the whole group."""
    d = links.withColumn("__g", F.concat(urls.netloc(F.col("url")), F.regexp_replace(urls.path(F.col("url")), "(/[^/]*){1,2}$", "")))
    g = d.groupBy(*scope, "__g").agg(F.min_by("url", order).alias("url"), F.min(order).alias("__o"))
    g = g.withColumn("__n", F.row_number().over(Window.partitionBy(*scope).orderBy("__o"))).where(F.col("__n") <= cap)
    told = g.join(answers.where("is_document").select("url").distinct(), "url", "left_semi").select(*scope, "__g", F.lit(True).alias("__yes"))
    return d.join(told, [*scope, "__g"], "left").withColumn("is_document", F.coalesce("__yes", F.lit(False))).drop("__g", "__yes")
