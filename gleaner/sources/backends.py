"""Documents of application backends: configuration in script bundles, collections, listed records.

Bundles and list answers are recorded tables (``bundles``: page_url, ord, url,
body; ``answers``: project, collection, page_no, status, body), so mining is a
join; who fetches them is not this module's matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import texts, urls

# Collections that are tried besides those found, bundles that are tried first, pages of a list at most.
COLLECTIONS = ("Documents", "documents", "Reports", "reports", "Funds", "funds", "Files", "files")
FIRST_BUNDLES = ("main.dart.js", "flutter_bootstrap.js")
MAX_COLLECTIONS, MAX_LIST_PAGES = 8, 50


def app_config(text: Column) -> Column:
    """struct(api_key, project, bucket) of a bundle, or null without key or project.

    The key falls back to one of the well-known form, the bucket to a host of the well-known form and then to the
    project's, the project to the bucket's first label.
    """
    get = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    named = lambda f: get(rf"{f}[\"']?\s*[:=]\s*[\"']([^\"']+)[\"']")
    key = F.coalesce(named("apiKey"), get(r"(AIza[0-9A-Za-z_\-]{35})"))
    bucket = F.coalesce(named("storageBucket"), get(r"([a-z0-9-]+\.appspot\.com)"))
    project = F.coalesce(named("projectId"), F.substring_index(bucket, ".", 1))
    return F.when(key.isNotNull() & project.isNotNull(), F.struct(key.alias("api_key"), project.alias("project"), F.coalesce(bucket, F.concat(project, F.lit(".appspot.com"))).alias("bucket")))


def collections_of(bundle: Column) -> Column:
    """The first names of collections: those a bundle names, then the usual ones."""
    found = F.regexp_extract_all(bundle, F.lit(r"collection\([\"']([A-Za-z0-9_]+)[\"']\)"), 1)
    return F.slice(F.array_distinct(F.concat(found, F.array(*[F.lit(c) for c in COLLECTIONS]))), 1, MAX_COLLECTIONS)


def bundle_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, ord, bundle): the usual bundles beside a page, then the scripts it names."""
    from gleaner.sources.html import resolve

    named = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<script[^>]+src=[\"']([^\"']+)[\"']"), 1)
    d = pages.select(F.col(url).alias("page_url"), F.posexplode(F.concat(F.array(*[F.lit(b) for b in FIRST_BUNDLES]), named)).alias("ord", "src"))
    return d.select("page_url", "ord", resolve(F.col("page_url"), F.col("src")).alias("bundle")).where(F.col("bundle").endswith(".js"))


def useful_bundles(bundles: DataFrame) -> DataFrame:
    """Bundles worth reading: the usual ones, and others that hold a key."""
    usual = F.element_at(F.split("url", "/"), -1).isin(*FIRST_BUNDLES)
    return bundles.where((F.coalesce("body", F.lit("")) != "") & (usual | F.contains("body", F.lit("AIza"))))


def listed_records(answers: DataFrame) -> DataFrame:
    """(project, collection, ord, name, path): records of list answers, page by page, up to the first that is missing, not
    answered or the last; at most :data:`MAX_LIST_PAGES` pages."""
    w = Window.partitionBy("project", "collection").orderBy("page_no")
    good = (F.col("status") == 200) & (F.col("page_no") == F.row_number().over(w) - 1)
    d = answers.withColumn("__good", good).where(F.col("page_no") < MAX_LIST_PAGES)
    d = d.withColumn("__all", F.min(F.col("__good").cast("int")).over(w)).where(F.col("__all") == 1)
    field = "struct<stringValue:string>"
    kind = f"struct<documents:array<struct<fields:struct<filePath:{field},name:{field}>>>,nextPageToken:string>"
    r = d.withColumn("__j", F.from_json("body", kind))
    more = F.lag(F.coalesce(F.col("__j.nextPageToken"), F.lit("")) != "", 1, True).over(w)
    r = r.withColumn("__m", more.cast("int"))
    r = r.withColumn("__m", F.min("__m").over(w)).where("__m = 1")
    each = r.select("project", "collection", "page_no", F.posexplode("__j.documents.fields").alias("n", "f"))
    path = F.col("f.filePath.stringValue")
    name = F.coalesce(F.nullif(F.col("f.name.stringValue"), F.lit("")), F.element_at(F.split(path, "/"), -1))
    return each.where(F.coalesce(path, F.lit("")) != "").select("project", "collection", (F.col("page_no") * 100_000 + F.col("n")).alias("ord"), name.alias("name"), path.alias("path"))


def mined_documents(bundles: DataFrame, answers: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(page_url, url, name): documents of a page's backend: the first bundle with a configuration, its first collection with
    records, names that match the plan, each url once.  ``terms``: page_url, key_terms array<string>."""
    conf = useful_bundles(bundles).withColumn("c", app_config(F.col("body"))).where("c is not null")
    first = conf.groupBy("page_url").agg(F.min_by(F.struct("c", collections_of(F.col("body")).alias("names")), "ord").alias("b")).select("page_url", "b.c.project", "b.c.bucket", F.posexplode("b.names").alias("rank", "collection"))
    records = listed_records(answers)
    have = first.join(records.select("project", "collection").distinct(), ["project", "collection"], "left_semi").groupBy("page_url").agg(F.min_by(F.struct("project", "bucket", "collection"), "rank").alias("h")).select("page_url", "h.*")
    d = have.join(records, ["project", "collection"])
    if terms is not None:
        d = d.join(terms, "page_url", "left").where(texts.keeps_name(F.col("name"), F.coalesce("key_terms", F.array().cast("array<string>"))))
    d = d.withColumn("url", urls.storage_url(F.col("bucket"), F.col("path")))
    return d.groupBy("page_url", "url").agg(F.min_by("name", "ord").alias("name"))
