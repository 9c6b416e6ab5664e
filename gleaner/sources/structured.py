"""Sitemaps, llms.txt, JSON bodies, app bundles and pattern stores as sources."""

from __future__ import annotations

import gzip
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.session import checkpointed

# Keys of JSON records.
URL_KEY = re.compile(r"href|url|path|file|link|download|document", re.I)
TITLE_KEY = re.compile(r"title|name|label|caption|description", re.I)
SKIP_KEY = re.compile(r"thumb|image|icon|logo|avatar|preview|css|script", re.I)
MEDIA = re.compile(r"\.(jpe?g|png|gif|svg|webp|ico|css|js|json|xml|html?|woff2?|ttf|mp4|mp3)(\?|$)", re.I)
MAX_BYTES, MAX_RECORDS, MAX_FILES = 4_000_000, 2_000, 25
# Names under which sitemaps are looked for.
SITEMAP_NAMES = ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap/sitemap.xml", "sitemap.xml.gz")


def sitemap_text(body: bytes | str | None) -> str:
    """A sitemap's text: unpacked where packed, bad bytes replaced."""
    if body is None:
        return ""
    if isinstance(body, str):
        return body
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            return ""
    return body.decode("utf-8", "replace")


def parse_sitemap(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, loc, lastmod) of a sitemap (``entry``) or a sitemap index (``child``); nothing of broken XML."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    kind = "child" if local(root) == "sitemapindex" else "entry"
    out = []
    for item in root:
        parts = {local(c): (c.text or "").strip() for c in item}
        if parts.get("loc"):
            out.append((kind, parts["loc"], parts.get("lastmod") or None))
    return out


def sitemap_rows(files: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """(file_url, ord, kind, loc, lastmod) of every sitemap file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(u, i, *r) for u, b in zip(pdf[url], pdf[body], strict=True) for i, r in enumerate(parse_sitemap(sitemap_text(b)))]
            yield pd.DataFrame(rows, columns=["file_url", "ord", "kind", "loc", "lastmod"])

    return files.select(url, body).mapInPandas(run, "file_url string, ord int, kind string, loc string, lastmod string")


def walk_sitemaps(files: DataFrame, roots: DataFrame, cap: int = MAX_FILES) -> DataFrame:
    """(root, url, lastmod, ord): entries of the files reached from each root, breadth first, at most ``cap`` files a root.

    One join per level of the index (sitemaps nest once or twice); a file reached
    twice counts once; the first entry of a URL wins.
    """
    rows = checkpointed(sitemap_rows(files))
    have = files.select("url").distinct()
    seen = roots.select(F.col("url").alias("root"), F.col("url").alias("file_url")).join(have, F.col("file_url") == F.col("url")).select("root", "file_url", F.array(F.lit(0)).alias("at"))
    level = seen
    while True:
        step = level.join(rows.where("kind = 'child'"), "file_url").select("root", F.col("loc").alias("file_url"), F.concat("at", F.array("ord")).alias("at"))
        step = step.join(have, F.col("file_url") == F.col("url")).drop("url").groupBy("root", "file_url").agg(F.min("at").alias("at"))
        step = checkpointed(step.join(seen.select("root", "file_url"), ["root", "file_url"], "left_anti"))
        if step.isEmpty():
            break
        seen, level = checkpointed(seen.unionByName(step)), step
    from pyspark.sql import Window

    order = Window.partitionBy("root").orderBy(F.size("at"), "at")
    read = seen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    entries = read.join(rows.where("kind = 'entry'"), "file_url")
    at = F.struct("n", "ord")
    return entries.groupBy("root", F.col("loc").alias("url")).agg(F.min_by("lastmod", at).alias("lastmod"), F.min(F.col("n").cast("long") * 1_000_000_000 + F.col("ord")).alias("ord"))


def discovered_sitemaps(seeds: DataFrame, files: DataFrame) -> DataFrame:
    """(seed_url, url, lastmod): every url that the sitemaps of each seed list, the first entry of a url.

    The roots are tried in turn until one has entries: those of the host's robots file together, then the usual names one by
    one, then the first two usual names on the domain above, bare and with www; urls of the host's llms.txt come last.
    ``files``: url, body (robots.txt, sitemaps and llms.txt as recorded).
    """
    base = F.regexp_extract("seed_url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    s = seeds.select("seed_url", base.alias("base")).distinct()
    text = files.select("url", F.col("body").cast("string").alias("text"))
    robots = s.join(text, F.concat("base", F.lit("/robots.txt")) == F.col("url")).select("seed_url", F.posexplode(robots_sitemaps(F.col("text"))).alias("place", "file_url")).select("seed_url", F.lit(0).alias("turn"), "file_url", "place")
    usual = s.select("seed_url", F.posexplode(F.array(*[F.lit(n) for n in SITEMAP_NAMES])).alias("k", "n"), "base").select("seed_url", (F.col("k") + 1).alias("turn"), F.concat("base", F.lit("/"), "n").alias("file_url"), F.lit(0).alias("place"))
    above = urls.parent_domain(urls.host(F.col("seed_url")))
    up = s.where(above.isNotNull()).select("seed_url", F.posexplode(F.array(*[F.lit(n) for n in SITEMAP_NAMES[:2]])).alias("k", "n"), urls.scheme(F.col("seed_url")).alias("scheme"), above.alias("above"))
    up = up.select("seed_url", (F.col("k") + 10).alias("turn"), F.posexplode(F.array(F.concat("scheme", F.lit("://"), "above", F.lit("/"), "n"), F.concat("scheme", F.lit("://www."), "above", F.lit("/"), "n"))).alias("place", "file_url"))
    roots = robots.unionByName(usual).unionByName(up.select("seed_url", "turn", "file_url", "place"))
    walked = walk_sitemaps(files, roots.select(F.col("file_url").alias("url")).distinct())
    entries = roots.join(walked, F.col("file_url") == F.col("root"))
    first = entries.groupBy("seed_url").agg(F.min("turn").alias("turn"))
    found = entries.join(first, ["seed_url", "turn"]).select("seed_url", "url", "lastmod", F.struct(F.lit(0), "place", "ord").alias("at"))
    llms = s.join(text, F.concat("base", F.lit("/llms.txt")) == F.col("url")).select("seed_url", F.posexplode(llms_links(F.col("text"))).alias("ord", "url"))
    last = llms.select("seed_url", "url", F.lit(None).cast("string").alias("lastmod"), F.struct(F.lit(1), F.lit(0), F.col("ord").cast("long")).alias("at"))
    return _first_entries(found, last)


def _first_entries(found: DataFrame, last: DataFrame) -> DataFrame:
    both = found.select("seed_url", "url", "lastmod", F.col("at.*")).toDF("seed_url", "url", "lastmod", "a", "b", "c").unionByName(last.select("seed_url", "url", "lastmod", F.col("at.*")).toDF("seed_url", "url", "lastmod", "a", "b", "c"))
    return both.groupBy("seed_url", "url").agg(F.min_by("lastmod", F.struct("a", "b", "c")).alias("lastmod"))


def sitemap_urls(entries: DataFrame) -> DataFrame:
    """The urls of sitemap entries without their dates."""
    return entries.select("seed_url", "url")


def llms_links(text: Column) -> Column:
    """URLs of an llms.txt: Markdown links first, then bare lines, each once."""
    marked = F.regexp_extract_all(text, F.lit(r"\[.*?\]\((https?://[^)\s]+)\)"), 1)
    bare = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^https?://"))
    return F.array_distinct(F.concat(marked, bare))


def robots_sitemaps(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1))


def _best_title(fields: dict[str, str]) -> str:
    """The text that names a record: a title before a name before anything else, the longest of each, the first on ties."""
    best, how = "", (3, 0)
    for key, value in fields.items():
        if value.strip() and TITLE_KEY.search(key) and not URL_KEY.search(key):
            low = key.lower()
            rank = (0 if "title" in low else 1 if "name" in low else 2, -len(value))
            if rank < how:
                best, how = value, rank
    return best.strip()[:200]


def _objects(data) -> Iterator[dict]:
    """All objects of a JSON value in document order, an object before what it holds; no recursion."""
    held = [iter((data,))]
    while held:
        node = next(held[-1], None)
        if node is None:
            held.pop()
            continue
        if isinstance(node, dict):
            yield node
        held.append(iter([x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, (dict, list))]))


def json_walk(body: str | None) -> list[tuple[str, str]]:
    """(path, name) of every record of a JSON body, in document order: objects with a text that looks like a document's path
    under a key that says so.  The first :data:`MAX_RECORDS` of a body; nothing of a body that is no JSON or too long."""
    if not body or len(body) > MAX_BYTES:
        return []
    try:
        data = json.loads(body)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str]] = []
    for node in _objects(data) if isinstance(data, (dict, list)) else ():
        fields = {k: v for k, v in node.items() if isinstance(v, str)}
        places = [v.strip() for k, v in fields.items() if URL_KEY.search(k) and not SKIP_KEY.search(k) and _place(v.strip())]
        if places:
            name = _best_title(fields)
            out += [(p, name) for p in places]
        if len(out) >= MAX_RECORDS:
            break
    return out[:MAX_RECORDS]


def _place(v: str) -> bool:
    return 8 <= len(v) <= 2000 and " " not in v[:8] and not MEDIA.search(v) and v.startswith(("http://", "https://", "/"))


def json_records(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, ord, path, name) of every record of every JSON body."""
    kind = bodies.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *r) for k, b in zip(pdf[key], pdf[body], strict=True) for i, r in enumerate(json_walk(b))]
            yield pd.DataFrame(rows, columns=[key, "ord", "path", "name"])

    return bodies.select(key, body).mapInPandas(run, f"{key} {kind}, ord int, path string, name string")


def first_party_json(responses: DataFrame, hosts: DataFrame) -> DataFrame:
    """Recorded JSON responses of a crawl's own hosts, of a bounded size."""
    d = responses.where(F.col("resource_type").isin("xhr", "fetch") & F.lower("content_type").contains("json") & (F.octet_length("body") <= MAX_BYTES))
    return d.join(hosts, ["crawl_id", "host"], "left_semi")


def merged_search(blocks: DataFrame, snippets: DataFrame) -> DataFrame:
    """Result blocks and a model's snippets by URL: the block's title wins, blocks come first."""
    b, s = blocks.alias("b"), snippets.alias("s")
    order = F.coalesce(F.col("b.ord"), F.lit(1_000_000) + F.col("s.ord"))
    return b.join(s, "url", "full").select("url", F.coalesce("b.title", "s.title").alias("title"), F.col("s.snippet").alias("snippet"), order.alias("ord"))
