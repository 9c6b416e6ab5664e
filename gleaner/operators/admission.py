"""What a crawl may fetch, queue and return: addresses, robots files, hosts, facets, candidates and pages.

Everything is a predicate or an anti join over recorded tables.  Robots files
are parsed once per host and carried as one short list; decisions on an address
are JVM expressions over the recorded addresses of its host.

Defined results: null urls are never admitted; a host without recorded
addresses is not safe, one without a robots file allows everything; ties of
first-seen rows go to the smallest order; repeated rows are admitted once.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import urls

# Networks and host names no crawl may reach.
BLOCKED = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 ::1/128 fc00::/7 fe80::/10 ff00::/8 2002::/16".split()
LOCAL_HOST = r"^localhost$|\.(local|internal|localhost)$"
_NETWORKS = [ipaddress.ip_network(n) for n in BLOCKED]


def public(address: str | None) -> bool | None:
    """Whether an address may be reached; None for what is no address."""
    try:
        a = ipaddress.ip_address((address or "").strip("[]").split("%")[0])
    except ValueError:
        return None
    if isinstance(a, ipaddress.IPv6Address) and a.ipv4_mapped:
        a = a.ipv4_mapped
    return not any(a in n for n in _NETWORKS)


def all_public(addresses: Column) -> Column:
    """True for a list of one address or more, all of them public."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: x is not None and len(x) > 0 and all(public(a) is True for a in x)).astype(bool)

    return F.pandas_udf(run, "boolean")(addresses)


def with_safety(links: DataFrame, resolved: DataFrame, url: str = "url") -> DataFrame:
    """``links`` with ``safe``: http(s), not a local name, and every address of the host public.  ``resolved``: host, addrs."""
    known = resolved.groupBy("host").agg(all_public(F.array_distinct(F.flatten(F.collect_list("addrs")))).alias("__public"))  # a host has few addresses
    d = links.withColumn("__host", urls.host(F.col(url)))
    literal = all_public(F.array("__host"))
    numbers = F.col("__host").rlike(r"^[0-9.]+$|^\[?[0-9a-f:.]*:[0-9a-f:.%]*\]?$")
    ok = F.col(url).rlike("^(?i)https?://") & (F.col("__host") != "") & ~F.col("__host").rlike(LOCAL_HOST)
    d = d.join(known.withColumnRenamed("host", "__known"), F.col("__host") == F.col("__known"), "left")
    return d.withColumn("safe", F.coalesce(ok & F.when(numbers, literal).otherwise(F.coalesce("__public", F.lit(False))), F.lit(False))).drop("__host", "__known", "__public")


def parse_robots(text: str | None) -> list[tuple[bool, str]]:
    """(allow, path) rules for any agent, in order.  A rule without path is left out, an empty Disallow allows all."""
    groups: list[tuple[set[str], list]] = []
    open_ = False
    for line in (text or "").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not open_:
                groups.append((set(), []))
            groups[-1][0].add(value.lower())
            open_ = True
        elif name in ("allow", "disallow") and groups:
            open_ = False
            if value:
                groups[-1][1].append((name == "allow", value))
            elif name == "disallow":
                groups[-1][1].append((True, "/"))
        else:
            open_ = False
    return next((rules for agents, rules in groups if "*" in agents), [])


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, rules): the rules of each robots file (host, body) for any agent; hosts without a file have no row."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [{"allow": a, "path": p} for a, p in parse_robots(t)])

    parsed = F.pandas_udf(run, "array<struct<allow boolean, path string>>")("body")
    return files.groupBy("host").agg(F.min("body").alias("body")).select("host", parsed.alias("rules"))


def with_robots(links: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``links`` with ``allowed``: what the first rule that matches the start of the path says; everything where none does."""
    d = links.withColumn("__host", urls.netloc(F.col(url))).join(rules.select(F.col("host").alias("__h"), "rules"), F.col("__host") == F.col("__h"), "left")
    path = F.when(urls.path(F.col(url)) == "", "/").otherwise(urls.path(F.col(url)))
    whole = F.when(urls.query(F.col(url)) != "", F.concat(path, F.lit("?"), urls.query(F.col(url)))).otherwise(path)
    first = F.try_element_at(F.filter(F.coalesce("rules", F.array().cast("array<struct<allow:boolean,path:string>>")), lambda r: F.startswith(whole, r["path"])), F.lit(1))
    return d.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("__host", "__h", "rules")


def may_return(url: Column, seed_host: Column, same_domain_only: Column) -> Column:
    return (urls.bare_host(urls.netloc(url)) == urls.bare_host(seed_host)) | ~same_domain_only


def may_visit(links: DataFrame, seeds: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``links`` (crawl_id, page_url, url) with ``visitable``: the seed's host, hosts listed for the crawl, and hosts that the
    seed's own pages link to; nothing but the seed's host where the crawl is locked.  ``seeds``: crawl_id, seed_host, same_domain_only.
    """
    of = lambda c: urls.bare_host(urls.netloc(F.col(c)))
    d = links.join(seeds.select("crawl_id", urls.bare_host(F.col("seed_host")).alias("__seed"), "same_domain_only"), "crawl_id").withColumn("__host", of("url"))
    open_ = d.where((of("page_url") == F.col("__seed"))).select("crawl_id", "__host")
    if allowed is not None:
        open_ = open_.unionByName(allowed.select("crawl_id", urls.bare_host(F.col("host")).alias("__host")))
    d = d.join(open_.distinct().withColumn("__open", F.lit(True)), ["crawl_id", "__host"], "left")
    ok = (F.col("__host") == F.col("__seed")) | (~F.col("same_domain_only") & F.coalesce("__open", F.lit(False)))
    return d.withColumn("visitable", ok).drop("__seed", "__host", "__open", "same_domain_only")


def admit_candidates(links: DataFrame, known: DataFrame, resolved: DataFrame, seeds: DataFrame) -> DataFrame:
    """Links (crawl_id, url, ord, ...) that become candidates: safe, returnable, not known yet, the first of each url."""
    d = with_safety(links.where("url is not null"), resolved).where("safe").drop("safe")
    d = d.join(seeds.select("crawl_id", "seed_host", "same_domain_only"), "crawl_id").where(may_return(F.col("url"), F.col("seed_host"), F.col("same_domain_only"))).drop("seed_host", "same_domain_only")
    d = d.join(known.select("crawl_id", "url").distinct(), ["crawl_id", "url"], "left_anti")
    rest = [c for c in d.columns if c not in ("crawl_id", "url")]
    return d.groupBy("crawl_id", "url").agg(F.min_by(F.struct(*rest), "ord").alias("__r")).select("crawl_id", "url", "__r.*")


def admit_pages(links: DataFrame, seen: DataFrame, resolved: DataFrame, rules: DataFrame) -> DataFrame:
    """Links (crawl_id, url, ord, found_on, chosen) that may be queued: pages not classified or visited (by identity), no new
    facet unless it was chosen, safe, allowed by robots; the first link of each page.  ``seen``: crawl_id, url.
    """
    d = links.where("url is not null").withColumn("key", urls.canonical(F.col("url")))
    bracket = F.instr(urls.unquote(F.col("url")), "[") > 0
    d = d.where(~bracket | F.coalesce("chosen", F.lit(False)) | urls.keeps_parent_facets(F.col("url"), F.col("found_on")))
    d = with_robots(with_safety(d, resolved), rules).where("safe and allowed").drop("safe", "allowed")
    d = d.join(seen.select("crawl_id", urls.canonical(F.col("url")).alias("key")).distinct(), ["crawl_id", "key"], "left_anti")
    rest = [c for c in d.columns if c not in ("crawl_id", "key")]
    return d.groupBy("crawl_id", "key").agg(F.min_by(F.struct(*rest), "ord").alias("__r")).select("crawl_id", "key", "__r.*")


def passes_screen(score: Column, allowed: Column, least: float) -> Column:
    """Whether a url passes: robots first, then the score, where one is asked for."""
    return allowed & (F.lit(least <= 0) | (score >= least))


def navigation_guard(url: Column, visited: Column, same_host: Column, same_domain_only: Column) -> Column:
    """Why a navigation is refused: visited, off_domain or binary; null where it may go on."""
    return F.when(F.coalesce(url, F.lit("")) == "", "no_url").when(visited, "visited").when(same_domain_only & ~same_host, "off_domain").when(urls.is_binary(url), "binary")


def fetch_allowed(url: Column, hosts: Column, safe: Column, allowed: Column) -> Column:
    """Whether a saved program may fetch a url: on its site or a data host, safe, allowed by robots."""
    return (F.array_contains(hosts, urls.domain(url)) | F.array_contains(hosts, urls.site_of(urls.host(url)))) & safe & allowed


def behind_own_form(url: Column, forms: Column) -> Column:
    """Whether the facets of some form that the crawl has set all stand in ``url``.  ``forms``: array of facet arrays."""
    facets = urls.listing_facets(url)
    return F.exists(forms, lambda own: (F.size(own) > 0) & (F.size(F.array_except(own, facets)) == 0))


def blocked_resource(kind: Column, host: Column, first_party: Column) -> Column:
    """Whether a page's request is not let through: fonts, media and images always, scripts of other hosts."""
    return kind.isin("font", "media", "image") | ((kind == "script") & ~F.array_contains(first_party, host))


def key_gate(given: Column, wanted: str | None) -> Column:
    """Whether a caller may pass: always where no key is set, else with the same key."""
    return F.lit(True) if not wanted else F.coalesce(given == wanted, F.lit(False))
