"""URL functions as JVM expressions (no UDF, no exception on malformed input)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters and paths that tell listings, documents and languages.
FIRST_PAGE = "^(?i)(start|offset|page|pagina|seite|oldal|cur|limitstart)$"
PAGING = r"(?i)(^|_)(cur|delta|page|pagina|seite|oldal|start|offset|limit|sort|order|orderby|resetcur|redirect|p_p_\w+|__c\w+|__canz|__cselect)$"
FACET = r"(?i)issuer|filter|facet|categor|kategor|type|typ\b|datefrom|dateto|date_from|date_to|\bsearch\b|query|\bq\b|keyword|lang\b|locale|view\b"
DOCUMENT = r"\.(pdf|xlsx|xls|docx|doc|csv|pptx|ppt|zip)$|/wp-content/uploads/|/documents/|/download"
BINARY = r"\.(zip|rar|7z|tar|gz|xlsx|xls|docx|doc|pptx|ppt|exe|dmg|pkg|msi|mp4|mp3|avi|mov|jpg|jpeg|png|gif|svg)$"
LANGUAGES = ("en", "de", "hu", "fr", "it", "es", "sk", "ro", "pl", "cs", "hr", "sl", "sr", "ru", "uk")
SITEMAP_SKIP = "/tag/|/category/|/author/|/archive/|/feed|/wp-json|/comment|/page/|/cikk/|/hir/|/news/|/blog/"
URL_SAFE = r"A-Za-z0-9!$&'()*+,/:;=?#@\[\]%._~-"


def scheme(u: Column) -> Column:
    return F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[^:/?#]+:)?//([^/?#]*)", 1)


def host(u: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(u), "^.*@", ""), r":\d*$", ""))


def path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def unquote(c: Column) -> Column:
    """Percent-decoded; a plus stays a plus, malformed escapes stay as they are."""
    return F.when(F.instr(c, "%") > 0, F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def pairs(u: Column) -> Column:
    """The query's parameters in order, as array<struct<k, v>>, decoded, blanks kept."""
    clean = lambda c: F.coalesce(F.try_url_decode(c), c)
    each = lambda p: F.struct(clean(F.substring_index(p, "=", 1)).alias("k"), clean(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"))
    return F.transform(F.filter(F.split(query(u), "&"), lambda p: p != ""), each)


def encode_pairs(p: Column) -> Column:
    code = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(p, lambda x: F.concat(code(x["k"]), F.lit("="), code(x["v"]))), "&")


def strip_fragment(u: Column) -> Column:
    return F.substring_index(u, "#", 1)


def _first_page(x: Column) -> Column:
    return x["k"].rlike(FIRST_PAGE) & x["v"].isin("0", "1")


def is_first_page(u: Column) -> Column:
    return F.exists(pairs(u), _first_page)


def canonical(u: Column) -> Column:
    """A page's identity: without fragment and first-page parameters, lower case, no slash at the end."""
    rest = encode_pairs(F.filter(pairs(u), lambda x: ~_first_page(x)))
    base = F.substring_index(strip_fragment(u), "?", 1)
    return F.lower(F.regexp_replace(F.when(rest != "", F.concat(base, F.lit("?"), rest)).otherwise(base), "/+$", ""))


def facet_key(k: Column) -> Column:
    return F.regexp_replace(k, r"\[\d*\]", "[]")


def bracket_facets(u: Column) -> Column:
    kept = F.filter(pairs(u), lambda x: F.instr(x["k"], "[") > 0)
    return F.array_distinct(F.transform(kept, lambda x: F.struct(facet_key(x["k"]).alias("k"), x["v"].alias("v"))))


def listing_facets(u: Column) -> Column:
    kept = F.filter(pairs(u), lambda x: x["k"].rlike(FACET) & (x["v"] != ""))
    return F.array_distinct(F.transform(kept, lambda x: F.struct(facet_key(x["k"]).alias("k"), x["v"].alias("v"))))


def keeps_parent_facets(u: Column, parent: Column) -> Column:
    own = bracket_facets(u)
    return parent.isNotNull() & (F.size(own) > 0) & (F.size(F.array_except(own, bracket_facets(parent))) == 0)


def paging_identity(u: Column, keep: Column | None = None) -> Column:
    """What is left of a URL without host, paging and facet parameters; those left are sorted.

    ``keep``: facets (array<struct<k, v>>, keys as :func:`facet_key` has them) that stay, as a crawl set them itself.
    """
    own = lambda x: F.struct(facet_key(x["k"]).alias("k"), x["v"].alias("v"))
    free = lambda x: ~x["k"].rlike(PAGING) & ~x["k"].rlike(FACET)
    kept = F.filter(pairs(u), free if keep is None else lambda x: free(x) | F.array_contains(keep, own(x)))
    stable = encode_pairs(F.array_sort(F.transform(kept, own)))
    base = F.lower(F.regexp_replace(path(u), "/+$", ""))
    return F.when(stable != "", F.concat(base, F.lit("?"), stable)).otherwise(base)


def is_document(u: Column) -> Column:
    return F.lower(path(u)).rlike(DOCUMENT)


def is_binary(u: Column) -> Column:
    return F.lower(F.substring_index(u, "?", 1)).rlike(BINARY)


def language(u: Column) -> Column:
    first = F.lower(F.substring_index(F.regexp_replace(path(u), "^/+", ""), "/", 1))
    return F.when(first.isin(*LANGUAGES), first)


def bare_host(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def domain(u: Column) -> Column:
    return F.regexp_replace(host(u), r"^www\.", "")


def site_of(h: Column) -> Column:
    labels = F.split(bare_host(h), r"\.")
    n = F.size(labels)
    long = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & (F.length(F.try_element_at(labels, F.lit(-2))) <= 3)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), n - F.when(long, 2).otherwise(1)), 3), ".")


def endpoint(u: Column) -> Column:
    return F.concat(bare_host(netloc(u)), path(u))


def parent_domain(h: Column) -> Column:
    return F.when(F.size(F.split(h, r"\.")) > 2, F.regexp_replace(h, r"^[^.]*\.", ""))


def template(u: Column) -> Column:
    """Group of a link without tag path: its path with the last segment open."""
    segments = F.filter(F.split(path(u), "/"), lambda s: s != "")
    return F.concat(F.lit("url:/"), F.array_join(F.concat(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("*"))), "/"))


def normalize(u: Column, keep_query: bool = False) -> Column:
    """Comparison key: scheme, host and port in lower case, decoded path without slash at the end."""
    t = F.trim(u)
    port = F.regexp_extract(netloc(t), r":(\d+)$", 1)
    where = F.concat(F.lower(scheme(t)), F.lit("://"), host(t), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""))
    p = F.regexp_replace(unquote(path(t)), "/+$", "")
    out = F.concat(where, F.when(p == "", "/").otherwise(p))
    return F.when(query(t) != "", F.concat(out, F.lit("?"), query(t))).otherwise(out) if keep_query else out


def identity(u: Column, pattern: Column, keep_query: bool = False) -> Column:
    """The part a row's own pattern names, letters and digits only after '#'; else the comparison key."""
    part = F.when(pattern.isNotNull(), F.call_function("regexp_extract", u, pattern, F.lit(1)))
    return F.when(part != "", F.concat(F.lit("#"), F.regexp_replace(F.lower(part), "[^a-z0-9]", ""))).otherwise(normalize(u, keep_query))


def as_url(u: Column) -> Column:
    """Characters that may not stand in a URL percent-encoded, the rest as it is."""
    unsafe = f"[^{URL_SAFE}]"
    each = F.transform(F.split(F.trim(u), ""), lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c))
    return F.when(F.trim(u).rlike(unsafe), F.array_join(each, "")).otherwise(F.trim(u))


def storage_url(bucket: Column, file: Column) -> Column:
    return F.concat(F.lit("https://firebasestorage.googleapis.com/v0/b/"), bucket, F.lit("/o/"), F.replace(F.url_encode(file), F.lit("+"), F.lit("%20")), F.lit("?alt=media"))


def program_key(start_url: Column, goal: Column) -> Column:
    return F.concat(F.regexp_replace(domain(start_url), "[^a-z0-9.-]", "_"), F.lit("__"), F.substring(F.sha2(goal, 256), 1, 8))


def start_url(site: Column) -> Column:
    return F.concat(F.lit("https://"), F.when(site.startswith("www."), site).otherwise(F.concat(F.lit("www."), site)), F.lit("/"))


def search_key(u: Column) -> Column:
    return F.concat(F.lower(scheme(u)), F.lit("://"), domain(u), path(u))


def pattern_domain(d: Column) -> Column:
    """A store's key of a domain, or null where it would not be a safe file name."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), r"^www\.", ""), r":\d+$", "")
    return F.when(key.rlike("^[a-zA-Z0-9.-]+$") & ~key.contains(".."), key)


def recipe_key(host_: Column, path_: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.concat(host_, path_)), "[^a-z0-9._-]+", "_"), "^_+|_+$", ""), 1, 150)


def sitemap_page(u: Column) -> Column:
    """Whether a sitemap URL is a content page worth a look."""
    return ~is_document(u) & ~is_binary(u) & ~F.lower(path(u)).rlike(SITEMAP_SKIP)


def url_score(u: Column, depth: Column, terms: Column, prefer: Column, skip: Column) -> Column:
    p = F.lower(path(u))
    inside = lambda a: F.exists(a, lambda x: p.contains(F.lower(x)))
    share = F.size(F.filter(terms, lambda x: p.contains(F.lower(x)))) / F.greatest(F.size(terms), F.lit(1))
    ends = p.rlike(r"\.(pdf|xlsx|xls|docx|doc|csv|pptx|zip)$")
    return 0.4 * share + F.when(ends, 0.5).otherwise(0.0) + F.when(inside(prefer), 0.3).otherwise(0.0) - F.when(inside(skip), 1.0).otherwise(0.0) - 0.05 * depth


def is_planned(u: Column, prefer: Column) -> Column:
    p = F.lower(unquote(path(u)))
    return F.exists(prefer, lambda x: p.contains(x))


def looks_like_path(v: Column) -> Column:
    """Whether a JSON string may be a document's path."""
    t = F.trim(v)
    media = r"(?i)\.(jpe?g|png|gif|svg|webp|ico|css|js|json|xml|html?|woff2?|ttf|mp4|mp3)(\?|$)"
    return F.length(t).between(8, 2000) & ~F.substring(t, 1, 8).contains(" ") & ~t.rlike(media) & t.rlike("^(https?://|/)")
