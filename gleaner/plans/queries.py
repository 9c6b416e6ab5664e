"""The query catalogue over the test tables, and the same results in DuckDB SQL.

Names carry the operator's inventory id; predicates are named ``fp<N>_``, as
``p<N>_`` names the training-data problems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import periods, texts, urls
from gleaner.operators import evaluation, judging, links, ranking, series, stores, traces
from gleaner.plans import discover as plan
from gleaner.plans import goals, programs
from gleaner.session import table
from gleaner.sources import html, structured
from gleaner.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "candidates").withColumn("u", F.regexp_replace("url", r"\s+", ""))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).where("url is not null")


_B = r"(SELECT *, regexp_replace(url, '\s+', '', 'g') AS u FROM candidates WHERE url IS NOT NULL) b"
_PATH = "regexp_extract(u, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_NET = "regexp_extract(u, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"
_SCHEME = "regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)"
_QUERY = r"regexp_extract(u, '^[^?#]*\?([^#]*)', 1)"
_HOST = rf"lower(regexp_replace(regexp_replace({_NET}, '^.*@', ''), ':\d*$', ''))"
_DOMAIN = rf"regexp_replace({_HOST}, '^www\.', '')"
_STABLE = f"array_to_string(list_sort([x for x in string_split({_QUERY}, '&') if x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '{urls.PAGING}') AND NOT regexp_matches(split_part(x, '=', 1), '{urls.FACET}')]), '&')"
_CANON_Q = f"array_to_string([x for x in string_split({_QUERY}, '&') if x <> '' AND NOT (regexp_matches(split_part(x, '=', 1), '(?i)^(start|offset|page|pagina|seite|oldal|cur|limitstart)$') AND split_part(x, '=', 2) IN ('0', '1'))], '&')"
_WEAK = r"len([x for x in string_split_regex(coalesce(name, ''), '[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]+') if x <> '']) < 4 AND NOT regexp_matches(coalesce(name, ''), '\p{Nd}')"
_DECODED = f"[{{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': CASE WHEN contains(x, '=') THEN url_decode(replace(x[strpos(x, '=') + 1:], '+', ' ')) ELSE '' END}} for x in string_split({_QUERY}, '&') if x <> '']"
_KEPT = f"[p for p in {_DECODED} if NOT (lower(p.k) IN ('start', 'offset', 'page', 'pagina', 'seite', 'oldal', 'cur', 'limitstart') AND p.v IN ('0', '1'))]"
_CODE = "replace(url_encode({}), '%20', '+')"
_LANGS = ", ".join(f"'{x}'" for x in urls.LANGUAGES)
_FIRST = f"lower(split_part(regexp_replace({_PATH}, '^/+', ''), '/', 1))"

# name -> (expression over u, name, context; the same in SQL)
_SCALARS: dict[str, tuple[Callable[[], Column], str | None]] = {
    "u1_strip_fragment": (lambda: urls.strip_fragment(F.col("u")), "split_part(u, '#', 1)"),
    "u2_canonical": (lambda: urls.canonical(F.col("u")), f"lower(regexp_replace(split_part(split_part(u, '#', 1), '?', 1) || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string([{_CODE.format('p.k')} || '=' || {_CODE.format('p.v')} for p in {_KEPT}], '&') ELSE '' END, '/+$', ''))"),
    "u3_first_page": (lambda: urls.is_first_page(F.col("u")), f"len([x for x in string_split({_QUERY}, '&') if regexp_matches(split_part(x, '=', 1), '(?i)^(start|offset|page|pagina|seite|oldal|cur|limitstart)$') AND split_part(x, '=', 2) IN ('0', '1')]) > 0"),
    "u4_paging_identity": (lambda: urls.paging_identity(F.col("u")), f"lower(regexp_replace({_PATH}, '/+$', '')) || CASE WHEN {_STABLE} <> '' THEN '?' || {_STABLE} ELSE '' END"),
    "u7_document_split": (lambda: urls.is_document(F.col("u")), f"regexp_matches(lower({_PATH}), '{urls.DOCUMENT}')"),
    "u8_binary": (lambda: urls.is_binary(F.col("u")), f"regexp_matches(lower(split_part(u, '?', 1)), '{urls.BINARY}')"),
    "u9_url_language": (lambda: urls.language(F.col("u")), f"CASE WHEN {_FIRST} IN ({_LANGS}) THEN {_FIRST} END"),
    "u10_bare_host": (lambda: urls.bare_host(urls.netloc(F.col("u"))), rf"regexp_replace(lower({_NET}), '^www\.', '')"),
    "u11_domain": (lambda: urls.domain(F.col("u")), _DOMAIN),
    "u12_site_of": (lambda: urls.site_of(urls.host(F.col("u"))), f"CASE WHEN len(string_split({_DOMAIN}, '.')) > 2 AND length(string_split({_DOMAIN}, '.')[-1]) = 2 AND length(string_split({_DOMAIN}, '.')[-2]) <= 3 THEN array_to_string(string_split({_DOMAIN}, '.')[-3:], '.') ELSE array_to_string(string_split({_DOMAIN}, '.')[-2:], '.') END"),
    "u13_endpoint": (lambda: urls.endpoint(F.col("u")), rf"regexp_replace(lower({_NET}), '^www\.', '') || {_PATH}"),
    "u14_parent_domain": (lambda: urls.parent_domain(urls.host(F.col("u"))), rf"CASE WHEN len(string_split({_HOST}, '.')) > 2 THEN regexp_replace({_HOST}, '^[^.]*\.', '') END"),
    "u15_url_template": (lambda: urls.template(F.col("u")), f"'url:/' || array_to_string(list_concat([x for x in string_split({_PATH}, '/') if x <> ''][:-2], ['*']), '/')"),
    "u20_program_key": (lambda: urls.program_key(F.col("u"), F.coalesce("name", F.lit(""))), f"regexp_replace({_DOMAIN}, '[^a-z0-9.-]', '_', 'g') || '__' || substr(sha256(coalesce(name, '')), 1, 8)"),
    "u21_start_url": (lambda: urls.start_url(F.col("site")), "'https://' || CASE WHEN starts_with(site, 'www.') THEN site ELSE 'www.' || site END || '/'"),
    "u22_search_key": (lambda: urls.search_key(F.col("u")), f"lower({_SCHEME}) || '://' || {_DOMAIN} || {_PATH}"),
    "u23_pattern_domain": (lambda: urls.pattern_domain(F.col("site")), r"CASE WHEN regexp_matches(regexp_replace(lower(trim(site)), '^www\.', ''), '^[a-zA-Z0-9.-]+$') AND NOT contains(site, '..') THEN regexp_replace(lower(trim(site)), '^www\.', '') END"),
    "u24_recipe_key": (lambda: urls.recipe_key(urls.host(F.col("u")), urls.path(F.col("u"))), f"substr(regexp_replace(regexp_replace(lower({_HOST} || {_PATH}), '[^a-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 150)"),
    "u16_normalize": (lambda: urls.normalize(F.col("u")), f"lower({_SCHEME}) || '://' || {_HOST} || CASE WHEN regexp_matches({_NET}, ':[0-9]+$') THEN ':' || regexp_extract({_NET}, ':([0-9]+)$', 1) ELSE '' END || coalesce(nullif(regexp_replace(url_decode({_PATH}), '/+$', ''), ''), '/')"),
    "u18_as_url": (lambda: urls.as_url(F.col("u")), r"array_to_string([CASE WHEN regexp_matches(c, '[^A-Za-z0-9!$&''()*+,/:;=?#@\[\]%._~-]') THEN url_encode(c) ELSE c END for c in string_split(trim(u), '')], '')"),
    "fp7_sitemap_page": (lambda: urls.sitemap_page(F.col("u")), f"NOT regexp_matches(lower({_PATH}), '{urls.DOCUMENT}') AND NOT regexp_matches(lower(split_part(u, '?', 1)), '{urls.BINARY}') AND NOT regexp_matches(lower({_PATH}), '{urls.SITEMAP_SKIP}')"),
    "t20_looks_like_path": (lambda: urls.looks_like_path(urls.path(F.col("u"))), f"length({_PATH}) BETWEEN 8 AND 2000 AND NOT contains(substr({_PATH}, 1, 8), ' ') AND NOT regexp_matches({_PATH}, '(?i)\\.(jpe?g|png|gif|svg|webp|ico|css|js|json|xml|html?|woff2?|ttf|mp4|mp3)(\\?|$)') AND starts_with({_PATH}, '/')"),
    "t22_url_score": (
        lambda: F.round(urls.url_score(F.col("u"), F.lit(2), F.array(F.lit("report"), F.lit("fee"), F.lit("2024")), F.array(F.lit("/documents/")), F.array(F.lit("/dl/"))), 6),
        f"round(0.4 * (contains(lower({_PATH}), 'report')::INT + contains(lower({_PATH}), 'fee')::INT + contains(lower({_PATH}), '2024')::INT) / 3 + CASE WHEN regexp_matches(lower({_PATH}), '\\.(pdf|xlsx|xls|docx|doc|csv|pptx|zip)$') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower({_PATH}), '/documents/') THEN 0.3 ELSE 0 END - CASE WHEN contains(lower({_PATH}), '/dl/') THEN 1.0 ELSE 0 END - 0.1, 6)",
    ),
    "t7_clean_text": (lambda: texts.clean(F.col("context")), r"regexp_replace(context, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"),
    "t8_injection_flag": (lambda: texts.is_instruction(F.col("context")), f"regexp_matches(coalesce(context, ''), '{texts.INJECTION}')"),
    "t9_weakly_named": (lambda: texts.is_weakly_named(F.col("name")), _WEAK),
    "t17_verdict": (lambda: texts.verdict(F.col("relevance")), "CASE WHEN relevance IS NULL THEN 'unscored' WHEN relevance >= 0.75 THEN 'accepted' WHEN relevance < 0.4 THEN 'rejected' ELSE 'unsure' END"),
    "t2_date": (lambda: periods.date_of(F.concat_ws(" ", "dated", "context")), None),
    "t5_names_goal_year": (lambda: texts.names_goal_year(F.col("name"), F.col("u"), texts.goal_years(F.lit("reports 2020 to 2023"))), "len(list_intersect(regexp_split_to_array(concat_ws(' ', name, u), '[^0-9]+'), ['2020', '2021', '2022', '2023'])) > 0"),
    "t10_link_state": (
        lambda: texts.link_state(F.col("cand_id").cast("string"), F.col("name"), F.col("u"), F.col("context"), F.col("section"), F.col("col_label")),
        f"""'{{"id":"' || cand_id || '","text":' || to_json(coalesce(nullif(left(coalesce(name, ''), 200), ''), '(no link text)')) || ',"url":' || to_json(u) || CASE WHEN context <> '' AND {_WEAK} THEN ',"surrounding_text":' || to_json(left(context, 200)) ELSE '' END
  || CASE WHEN left(section, 160) <> '' THEN ',"section_heading":' || to_json(left(section, 160)) ELSE '' END || CASE WHEN left(col_label, 80) <> '' THEN ',"column_header":' || to_json(left(col_label, 80)) ELSE '' END || '}}'""",
    ),
}
# Those that take no url: they have a value for candidates without one, too.
_NO_URL = {"t2_date", "t7_clean_text", "t8_injection_flag", "t9_weakly_named", "t17_verdict", "u21_start_url", "u23_pattern_domain"}
for _name, (_f, _sql) in _SCALARS.items():

    def _scalar(spark: SparkSession, folder: str, f=_f, read=_rows if _name in _NO_URL else _candidates) -> DataFrame:
        return read(spark, folder).select("cand_id", f().alias("value"))

    QUERIES[_name] = _scalar
    if _sql:
        SQL[_name] = f"SELECT cand_id, {_sql} AS value FROM {_B if _name not in _NO_URL else 'candidates'}"


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return periods.with_names(_candidates(spark, folder).select("cand_id", "u", "name"), "u", "name")


@query()
def t1_period(spark, folder):
    return _candidates(spark, folder).select("cand_id", periods.period_of(F.concat_ws(" ", "name", "u")).alias("value"))


@query()
def t3_year(spark, folder):
    return _rows(spark, folder).select("cand_id", periods.year_of(F.concat_ws(" ", "dated", "name", "context", "u")).alias("value"))


@query()
def t12_identity(spark, folder):
    return _named(spark, folder).select("cand_id", F.col("ident_text").alias("value"), "ident_ext")


@query()
def t14_series_key(spark, folder):
    return _named(spark, folder).select("cand_id", F.col("series_key").alias("value"))


@query()
def t15_order_of(spark, folder):
    return _named(spark, folder).select("cand_id", "shape", F.to_json("order_values").alias("value"))


@query()
def t16_skeleton(spark, folder):
    return _named(spark, folder).select("cand_id", F.col("skeleton").alias("value"))


@query("SELECT domain, list_sort(list_distinct([x for x in regexp_split_to_array(coalesce(last_goal, ''), '[^0-9]+') if length(x) = 4 AND x BETWEEN '1980' AND '2099'])) AS years FROM domain_patterns")
def t4_goal_years(spark, folder):
    return table(spark, folder, "domain_patterns").select("domain", texts.goal_years(F.col("last_goal")).alias("years"))


@query()
def t6_goal_language(spark, folder):
    return table(spark, folder, "domain_patterns").select("domain", texts.goal_language(F.col("last_goal")).alias("language"))


@query("SELECT crawl_id, coalesce(verdict, 'none') AS verdict, count(*) AS n FROM candidates GROUP BY 1, 2")
def a12_verdict_counts(spark, folder):
    return table(spark, folder, "candidates").groupBy("crawl_id", F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


_LINKS = "(SELECT page_id, crawl_id, url AS page_url, generate_subscripts(page_links, 1) - 1 AS ord, unnest(page_links) AS l FROM pages)"


@query(f"""
WITH x AS (SELECT page_id, ord, l.url AS url, coalesce(l.name, '') AS name, coalesce(l.context, '') AS context, coalesce(l.section, '') AS section,
  coalesce(l.col_label, '') AS col_label, coalesce(l.path, '') AS path, coalesce(l.dated, '') AS dated, coalesce(l.chrome, false) AS chrome FROM {_LINKS})
SELECT page_id, url, first(name ORDER BY length(name) DESC, ord) AS name,
  coalesce(first(context ORDER BY length(context), ord) FILTER (context <> ''), '') AS context,
  coalesce(first(section ORDER BY ord) FILTER (section <> ''), '') AS section, coalesce(first(col_label ORDER BY ord) FILTER (col_label <> ''), '') AS col_label,
  first(path ORDER BY ord) AS path, first(dated ORDER BY ord) AS dated, bool_and(chrome) AS chrome, min(ord)::INT AS first_ord
FROM x GROUP BY page_id, url""")
def a1_merge_links(spark, folder):
    return links.merge_links(plan.page_links(table(spark, folder, "pages")).drop("crawl_id"), ["page_id"], "ord")


@query(f"SELECT site, u, cand_id, name, source FROM (SELECT *, row_number() OVER (PARTITION BY site, u ORDER BY found_at, cand_id) AS rn FROM {_B}) WHERE rn = 1")
def a17_first_wins(spark, folder):
    d = _candidates(spark, folder).select("site", "u", "cand_id", "name", "source", "found_at")
    return links.first_wins(d, ["site", "u"], [F.col("found_at"), F.col("cand_id")]).select("site", "u", "cand_id", "name", "source")


@query(f"""SELECT site, u, cand_id, source FROM (SELECT *, row_number() OVER (PARTITION BY site, u ORDER BY
  CASE source WHEN 'api' THEN 0 WHEN 'sitemap' THEN 1 ELSE 2 END, cand_id) AS rn FROM {_B}) WHERE rn = 1""")
def s3_union_sources(spark, folder):
    d = _candidates(spark, folder).select("site", "u", "cand_id", "source")
    parts = [(0, d.where("source = 'api'")), (1, d.where("source = 'sitemap'")), (2, d.where("source not in ('api', 'sitemap')"))]
    return links.union_sources(parts, ["site", "u"], "cand_id").select("site", "u", "cand_id", "source")


_SEG = r"[x for x in string_split(lower(regexp_extract(regexp_replace(url, '\s+', '', 'g'), '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)), '/') if x <> '']"


@query(f"""
WITH e AS (SELECT site, entry_id, {_SEG} AS s FROM sitemap_entries),
l AS (SELECT site, entry_id, 1 AS level, '/' || s[1] || '/' AS prefix FROM e WHERE len(s) > 0 UNION ALL
  SELECT site, entry_id, 2, '/' || s[1] || '/' || s[2] || '/' FROM e WHERE len(s) > 1),
g AS (SELECT site, level, prefix, count(*) AS n, min(entry_id) AS f FROM l GROUP BY 1, 2, 3 HAVING level = 1 OR count(*) > 1)
SELECT site, level, prefix, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, level, f, prefix)::INT AS rank FROM g) WHERE rank <= 80""")
def a2_path_sample(spark, folder):
    d = table(spark, folder, "sitemap_entries").withColumn("url", F.regexp_replace("url", r"\s+", ""))
    return ranking.path_sample(d, ["site"], "entry_id")


@query(rf"""
WITH q AS (SELECT cand_id, u, split_part(u, '?', 1) AS page_url, [x for x in string_split({_QUERY}, '&') if x <> ''] AS pairs FROM {_B} WHERE contains(u, '?') AND NOT contains(u, '#')),
o AS (SELECT *, split_part(pairs[1], '=', 1) AS k, pairs[1][strpos(pairs[1], '=') + 1:] AS v FROM q WHERE len(pairs) = 1 AND contains(pairs[1], '='))
SELECT page_url, regexp_replace(k, '\[\d*\]', '[]') AS facet, count(*) AS n FROM o
WHERE v <> '' AND (contains(k, '[') OR regexp_matches(lower(k), 'issuer|filter|facet|categor|kategor|type|typ\b|date_?from|date_?to|\bsearch\b|query|\bq\b|keyword|lang\b|locale|view\b'))
  AND NOT regexp_matches(lower(k), '(^|_)(cur|delta|page|pagina|seite|oldal|start|offset|limit|sort|order|orderby|resetcur|redirect|p_p_\w+|__c\w+|__canz|__cselect)$')
GROUP BY 1, 2 HAVING count(*) >= 3""")
def a3_facet_groups(spark, folder):
    # every candidate stands on the listing that its url is without its query
    d = _candidates(spark, folder).where("instr(u, '?') > 0 and instr(u, '#') = 0").select("cand_id", F.col("u").alias("url"), F.substring_index("u", "?", 1).alias("page_url"))
    return links.facet_groups(d, "page_url", "cand_id").drop("urls")


@query(f"SELECT page_id, ord::INT AS ord, coalesce(regexp_matches(l.path, '(^|[/>])(nav|header|footer|aside)([./>]|$)'), false) AS value FROM {_LINKS}")
def t28_chrome_path(spark, folder):
    return plan.page_links(table(spark, folder, "pages")).select("page_id", "ord", texts.is_chrome_path(F.col("path")).alias("value"))


@query(f"""
WITH x AS (SELECT page_id, ord, l.url AS url, l.path AS path FROM {_LINKS} WHERE coalesce(l.path, '') <> '' AND NOT regexp_matches(l.path, '(^|[/>])(nav|header|footer|aside)([./>]|$)')),
g AS (SELECT page_id, path, min(ord) AS lo, arg_min(url, ord) AS a, arg_max(url, ord) AS b FROM x GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT page_id, path, lo, 0 AS side, a AS url FROM g UNION ALL SELECT page_id, path, lo, 1, b FROM g)
SELECT page_id, path, side, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lo, side)::INT AS rank FROM s) WHERE rank <= 8""")
def w7_probe_samples(spark, folder):
    return links.probe_samples(plan.page_links(table(spark, folder, "pages")), ["page_id"], "ord")


@query(f"""
WITH x AS (SELECT page_id, ord, l.url AS url, coalesce(l.path, '') AS path FROM {_LINKS}),
k AS (SELECT * FROM x WHERE path <> '' AND NOT regexp_matches(path, '(^|[/>])(nav|header|footer|aside)([./>]|$)')),
g AS (SELECT page_id, path, min(ord) AS lo, arg_min(url, ord) AS a, arg_max(url, ord) AS b FROM k GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT page_id, path, lo, 0 AS side, a AS url FROM g UNION ALL SELECT page_id, path, lo, 1, b FROM g),
q AS (SELECT page_id, path, url, regexp_matches(lower(url), '\\.pdf$') AS yes FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY lo, side) AS rank FROM s) WHERE rank <= 8),
w AS (SELECT page_id, path, bool_and(yes) AS whole FROM q GROUP BY 1, 2), o AS (SELECT page_id, path, url, bool_or(yes) AS own FROM q GROUP BY 1, 2, 3)
SELECT x.page_id, x.ord::INT AS ord, x.url, coalesce(whole, false) OR coalesce(own, false) AS is_document FROM x
LEFT JOIN w ON w.page_id = x.page_id AND w.path = x.path LEFT JOIN o ON o.page_id = x.page_id AND o.path = x.path AND o.url = x.url""")
def j9_spread_answers(spark, folder):
    d = plan.page_links(table(spark, folder, "pages")).select("page_id", "ord", "url", F.coalesce("path", F.lit("")).alias("path"))
    samples = links.probe_samples(d, ["page_id"], "ord")
    answers = samples.select("url").distinct().withColumn("is_document", F.lower("url").rlike(r"\.pdf$"))
    return links.spread_answers(d, samples, answers, ["page_id"]).select("page_id", "ord", "url", "is_document")


@query(f"""
WITH n AS (SELECT *, lower(regexp_replace({_PATH}, '/+$', '')) || CASE WHEN {_STABLE} <> '' THEN '?' || {_STABLE} ELSE '' END AS identity FROM {_B}),
a AS (SELECT *, row_number() OVER (PARTITION BY site, identity ORDER BY cand_id) AS rn FROM n)
SELECT cand_id, site, identity, variant FROM (SELECT *, row_number() OVER (PARTITION BY site, identity ORDER BY cand_id)::INT AS variant FROM a
  WHERE rn = 1 OR NOT regexp_matches({_QUERY}, '(?i)(^|&)(start|offset|page|pagina|seite|oldal|cur|limitstart)=[01](&|$)')) WHERE variant <= 3""")
def fp9_variant_cap(spark, folder):
    d = _candidates(spark, folder).select("cand_id", "site", F.col("u").alias("url"))
    return links.cap_variants(d, ["site"], "cand_id").select("cand_id", "site", "identity", "variant")


@query(f"""
WITH led AS (SELECT l.url AS to_url, arg_min(l.dated, page_id * 1000 + ord) AS led FROM {_LINKS} WHERE l.dated IS NOT NULL AND l.dated <> '' GROUP BY 1),
k AS (SELECT url, min(page_kind) AS kind FROM pages GROUP BY 1)
SELECT c.cand_id, coalesce(nullif(c.dated, ''), CASE WHEN coalesce(k.kind, 'other') NOT IN ('seed', 'listing', 'category', 'document_listing') THEN led.led END) AS dated_by
FROM candidates c LEFT JOIN led ON led.to_url = c.source_page LEFT JOIN k ON k.url = c.source_page""")
def j5_handed_down_date(spark, folder):
    pages = table(spark, folder, "pages")
    led = plan.page_links(pages).select(F.col("url").alias("to_url"), "dated", (F.col("page_id") * 1000 + F.col("ord")).alias("ord"))
    docs = table(spark, folder, "candidates").select("cand_id", "source_page", "dated")
    return links.hand_down_dates(docs, led, pages).select("cand_id", "dated_by")


@query(f"""
WITH h AS (SELECT DISTINCT site, {_PATH} AS path FROM {_B}), p AS (SELECT DISTINCT site, '/' || string_split(path, '/')[-1] AS path FROM h WHERE string_split(path, '/')[-1] <> '')
SELECT DISTINCT h.site, left(h.path, length(h.path) - length(p.path)) AS prefix FROM h JOIN p ON h.site = p.site AND ends_with(h.path, p.path) AND h.path <> p.path""")
def j3_prefix_suffix_join(spark, folder):
    c = _candidates(spark, folder)
    last = F.element_at(F.split(urls.path(F.col("u")), "/"), -1)
    paths = c.select("site", F.concat(F.lit("/"), last).alias("path")).where("path <> '/'")
    return links.learn_prefixes(c.select("site", F.col("u").alias("href")), paths, ["site"])


_IDENT = f"lower({_SCHEME}) || '://' || {_HOST} || lower(regexp_replace({_PATH}, '/+$', ''))"
_FOUND = f"(SELECT DISTINCT site, {_IDENT} AS ident FROM {_B} WHERE verdict = 'accepted')"
_EXPECTED = f"(SELECT DISTINCT site, {_IDENT} AS ident FROM {_B} WHERE source IN ('page', 'api'))"
_DECOYS = f"(SELECT DISTINCT site, {_IDENT} AS ident FROM {_B} WHERE chrome)"


def _idents(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("u")
    ident = F.concat(F.lower(urls.scheme(u)), F.lit("://"), urls.host(u), F.lower(F.regexp_replace(urls.path(u), "/+$", "")))
    return _candidates(spark, folder).withColumn("ident", ident)


@query(f"""
WITH f AS {_FOUND}, e AS {_EXPECTED}, d AS (SELECT * FROM {_DECOYS} EXCEPT SELECT * FROM {_EXPECTED}),
m AS (SELECT site, ident, max(f) AS f, max(e) AS e, max(d) AS d FROM (SELECT *, 1 AS f, 0 AS e, 0 AS d FROM f UNION ALL SELECT *, 0, 1, 0 FROM e UNION ALL SELECT *, 0, 0, 1 FROM d) GROUP BY 1, 2),
s AS (SELECT site, sum(f)::BIGINT AS found_count, sum(e)::BIGINT AS expected_count, sum(f * e)::BIGINT AS true_positives, sum(d)::BIGINT AS decoys_total, sum(d * f)::BIGINT AS decoys_returned FROM m GROUP BY 1),
r AS (SELECT *, CASE WHEN expected_count > 0 THEN true_positives / expected_count ELSE 1 END AS recall, CASE WHEN found_count > 0 THEN true_positives / found_count WHEN expected_count > 0 THEN 0 ELSE 1 END AS precision FROM s)
SELECT site, found_count, true_positives, found_count - true_positives AS false_accepts, round(recall, 6) AS recall, round(precision, 6) AS precision,
  round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1, decoys_total, decoys_returned,
  round(CASE WHEN decoys_total > 0 THEN decoys_returned / decoys_total END, 6) AS decoy_share FROM r""")
def a8_score(spark, folder):
    d = _idents(spark, folder)
    s = evaluation.score(d.where("verdict = 'accepted'"), d.where("source in ('page', 'api')"), d.where("chrome"), ["site"])
    real = ["recall", "precision", "f1", "decoy_share"]
    return s.select("site", "found_count", "true_positives", "false_accepts", "decoys_total", "decoys_returned", *[F.round(c, 6).alias(c) for c in real])


@query(f"SELECT e.site, e.ident FROM {_EXPECTED} e ANTI JOIN {_FOUND} f ON e.site = f.site AND e.ident = f.ident")
def j6_missed(spark, folder):
    d = _idents(spark, folder)
    return evaluation.missed(d.where("verdict = 'accepted'"), d.where("source in ('page', 'api')"), ["site"])


@query(f"""
WITH p AS (SELECT url, row_number() OVER (PARTITION BY site ORDER BY page_id) AS page_no FROM pages),
k AS (SELECT url, min(page_no) AS page_no FROM p GROUP BY 1),
f AS (SELECT site, {_IDENT} AS ident, min(CASE WHEN source IN ('sitemap', 'api') THEN 0 ELSE coalesce(k.page_no, 0) END) AS page_no FROM {_B} LEFT JOIN k ON k.url = b.source_page WHERE verdict = 'accepted' GROUP BY 1, 2)
SELECT e.site, round(count(*) FILTER (page_no <= 10) / count(*), 3) AS recall_at_10, round(count(*) FILTER (page_no <= 20) / count(*), 3) AS recall_at_20,
  round(count(*) FILTER (page_no <= 40) / count(*), 3) AS recall_at_40, min(page_no)::INT AS pages_to_first_hit
FROM {_EXPECTED} e LEFT JOIN f ON f.site = e.site AND f.ident = e.ident GROUP BY 1""")
def a9_recall_at(spark, folder):
    d = _idents(spark, folder)
    pages = table(spark, folder, "pages").select("site", "url", "page_id")
    numbers = ranking.numbered(pages, ["site"], [F.col("page_id")], "page_no").select(F.col("url").alias("source_page"), "page_no")
    found = evaluation.candidate_pages(d.where("verdict = 'accepted'"), numbers)
    return evaluation.recall_at(found, d.where("source in ('page', 'api')"), ["site"])


@query("""
SELECT site, sum(a)::BIGINT AS accepted, sum(w)::BIGINT AS wanted, sum(a * w)::BIGINT AS hits, round(CASE WHEN sum(a) > 0 THEN sum(a * w) / sum(a) END, 6) AS precision, round(CASE WHEN sum(w) > 0 THEN sum(a * w) / sum(w) END, 6) AS recall
FROM (SELECT site, (verdict = 'accepted')::INT AS a, (source = 'page')::INT AS w FROM candidates) GROUP BY ROLLUP (site)""")
def a11_pooled_rollup(spark, folder):
    s = evaluation.pooled(table(spark, folder, "candidates"), "site", F.col("verdict") == "accepted", F.col("source") == "page")
    return s.select("site", "accepted", "wanted", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("""
SELECT event_type, count(*) AS runs, round(avg(value), 3) AS value_mean, round(stddev_pop(value), 3) AS value_stdev, min(value) AS value_min, max(value) AS value_max
FROM events WHERE event_type <> 'error' GROUP BY 1""")
def a10_summary(spark, folder):
    d = table(spark, folder, "events").select("event_type", "value", F.when(F.col("event_type") == "error", "x").alias("error"), F.lit(False).alias("discarded"))
    return evaluation.summary(d, ["event_type"], ["value"])


@query("""
SELECT user_id, count(*) FILTER (p AND n <= 10) AS acc_at_10, count(*) FILTER (p AND n <= 20) AS acc_at_20, count(*) FILTER (p AND n <= 30) AS acc_at_30, count(*) FILTER (p AND n <= 40) AS acc_at_40
FROM (SELECT user_id, event_type = 'purchase' AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1""")
def w14_checkpoints(spark, folder):
    d = table(spark, folder, "events").withColumn("gain", (F.col("event_type") == "purchase").cast("long")).withColumn("o", F.struct("ts", "event_id"))
    return evaluation.checkpoints(d, ["user_id"], "o", "gain")


@query("""
WITH d AS (SELECT cand_id, crawl_id, coalesce(series, '') AS s, coalesce(period_label, '') AS p, CASE WHEN period_label IS NULL THEN '' ELSE 'p' END AS shape, verdict, dated FROM candidates),
f AS (SELECT crawl_id, s, min(shape) AS lo, max(shape) AS hi, max(p) AS top, count(*) AS n, count(nullif(dated, '')) AS k, max(dated) AS newest FROM d WHERE coalesce(verdict, '') <> 'rejected' GROUP BY 1, 2)
SELECT cand_id, CASE WHEN coalesce(verdict, '') = 'rejected' THEN NULL WHEN lo = hi AND lo <> '' THEN p = top WHEN n >= 2 AND k = n THEN dated = newest END AS latest FROM d LEFT JOIN f USING (crawl_id, s)""")
def w1_latest_in_series(spark, folder):
    d = table(spark, folder, "candidates").select(
        "cand_id", "crawl_id", F.coalesce("series", F.lit("")).alias("series_key"), F.array(F.coalesce("period_label", F.lit(""))).alias("order_values"),
        F.when(F.col("period_label").isNull(), "").otherwise("p").alias("shape"), "verdict", F.col("dated").alias("published"),
    )
    return series.mark_latest(d, ["crawl_id"]).select("cand_id", "latest")


@query()
def w3_superseded(spark, folder):
    d = _candidates(spark, folder).select("cand_id", "crawl_id", F.col("u").alias("url"), "name", "verdict", periods.date_of(F.col("dated")).alias("published"))
    return series.mark_latest(series.with_series(d), ["crawl_id"]).where("latest = false").select("cand_id", "series_key", "period")


@query()
def a7_doubtful_groups(spark, folder):
    d = _candidates(spark, folder).select("cand_id", "crawl_id", F.col("u").alias("url"), "name", "verdict", F.lit(None).cast("string").alias("published"))
    return series.doubtful_groups(series.mark_latest(series.with_series(d), ["crawl_id"]), ["crawl_id"], "cand_id")


_KINDS = ["document_listing", "fund_or_product", "category", "other", "news", "legal"]


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.array(*[F.lit(k) for k in _KINDS])
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("crawl_id"), F.concat(F.lit("https://x.example/"), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("url"),
        F.get(kind, (F.col("l_partkey") % 6).cast("int")).alias("kind"), (F.round(F.col("l_discount") * 1000) / 100).alias("probability"), (F.col("l_suppkey") % 4).cast("int").alias("depth"),
        (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("order"), (F.col("l_partkey") % 11 == 0).alias("other_language"), (F.col("l_partkey") % 13 == 0).alias("revealed"), (F.col("l_partkey") % 7 == 0).alias("goal_year"),
        (F.col("l_partkey") % 5 == 0).alias("planned"), (F.col("l_returnflag") == "R").alias("chrome"), (F.col("l_linestatus") == "O").alias("path_seen"), F.col("l_quantity").alias("q"),
    )


@query("""
WITH q AS (SELECT l_orderkey::VARCHAR AS crawl_id, 'https://x.example/' || l_partkey || '/' || l_linenumber AS url, l_linenumber * 1000000 + l_partkey AS o, l_partkey % 6 AS k, round(l_discount * 1000) / 100 AS pr, l_suppkey % 4 AS depth, l_partkey AS p,
  l_returnflag = 'R' AS chrome, l_linestatus = 'O' AS seen FROM lineitem),
t AS (SELECT *, CASE WHEN k <= 1 THEN 1 WHEN k <= 3 THEN 2 ELSE 3 END AS t0 FROM q)
SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY (p % 11 = 0)::INT, CASE WHEN p % 13 = 0 OR (p % 7 = 0 AND t0 = 2) THEN 1 ELSE t0 END,
  CASE WHEN p % 13 = 0 THEN 0 WHEN p % 7 = 0 THEN 1 WHEN p % 5 = 0 THEN 2 ELSE 3 END, chrome::INT, seen::INT, -pr, depth, o)::INT AS position FROM t""")
def w4_tier_order(spark, folder):
    return ranking.tier_order(_queue(spark, folder), ["crawl_id"]).select("crawl_id", "url", "position")


@query()
def w5_bandit_replay(spark, folder):
    q = _queue(spark, folder)
    cols = {c: F.col(c) for c in ("kind", "probability", "depth", "order", "other_language", "revealed", "goal_year", "planned", "chrome", "path_seen")}
    key = ranking.order_key(cols)
    outer, inner = F.array(*[c.cast("double") for c in key[:6]]), F.array(*[c.cast("double") for c in key[6:]])
    pages = q.select("crawl_id", "url", F.col("kind").alias("grp"), outer.alias("outer"), inner.alias("inner"), (F.col("q") > 25).cast("int").alias("accepted"))
    return ranking.replay(pages, "bandit", 40)


@query("""
WITH e AS (SELECT user_id, event_id, ts, (event_type = 'purchase')::INT AS p FROM events), i AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM e)
SELECT user_id, event_id, sum(1 - p) OVER (PARTITION BY user_id, g ORDER BY ts, event_id)::BIGINT AS stale FROM i""")
def w6_stale_runs(spark, folder):
    d = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return ranking.stale_runs(d, ["user_id"], "o", F.col("event_type") == "purchase").select("user_id", "event_id", "stale")


@query(rf"""
WITH e AS (SELECT s.site, entry_id, lower(regexp_extract(regexp_replace(url, '\s+', '', 'g'), '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)) AS p, url_patterns_prefer AS pre, url_patterns_skip AS skip FROM sitemap_entries s JOIN domain_patterns d ON d.domain = s.site),
b AS (SELECT *, list_min([i - 1 for i in range(1, len(pre) + 1) if contains(p, pre[i])]) AS hit FROM e)
SELECT entry_id, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN hit IS NOT NULL THEN 0 WHEN contains(p, '2024') THEN 0 WHEN len([x for x in skip if contains(p, x)]) > 0 THEN 2 ELSE 1 END,
  CASE WHEN hit IS NOT NULL THEN hit WHEN contains(p, '2024') THEN len(pre) ELSE 0 END, entry_id)::INT AS rank FROM b""")
def w8_rank_by_paths(spark, folder):
    known = table(spark, folder, "domain_patterns").select(F.col("domain").alias("site"), "url_patterns_prefer", "url_patterns_skip")
    d = table(spark, folder, "sitemap_entries").withColumn("url", F.regexp_replace("url", r"\s+", "")).join(known, "site").withColumn("years", F.array(F.lit("2024")))
    return ranking.rank_by_paths(d, ["site"], "entry_id", "url_patterns_prefer", "url_patterns_skip", "years").select("entry_id", "rank")


@query("SELECT cand_id, floor((row_number() OVER (PARTITION BY crawl_id ORDER BY cand_id) - 1) / 20)::INT AS batch FROM candidates")
def w12_batches(spark, folder):
    return ranking.batches(table(spark, folder, "candidates"), ["crawl_id"], "cand_id").select("cand_id", "batch")


@query("SELECT crawl_id, user, event_id, spent FROM (SELECT user_id AS user, event_id, 'c' AS crawl_id, sum(1) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS spent FROM events) WHERE spent <= 40")
def st7_budget(spark, folder):
    d = table(spark, folder, "events").select(F.lit("c").alias("crawl_id"), F.col("user_id").alias("user"), "event_id", F.struct("ts", "event_id").alias("o"), F.lit(1).cast("long").alias("cost"))
    return ranking.within_budget(d, ["user"], "o", "cost", 40).select("crawl_id", "user", "event_id", "spent")


@query(f"SELECT crawl_id, u, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id, u ORDER BY found_at, cand_id) AS rn FROM {_B}) WHERE rn = 1")
def st3_first_seen(spark, folder):
    d = _candidates(spark, folder).select("crawl_id", "u", "cand_id", F.struct("found_at", "cand_id").alias("at"))
    return stream.first_seen(d, ["crawl_id", "u"], "at").select("crawl_id", "u", "cand_id")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st2_windowed_counts(spark, folder):
    d = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.windowed_counts(d, "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def st2_sessions(spark, folder):
    d = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stream.sessions(d, "ts", "user_id")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


_LAST = "(SELECT snapshot_no, program_key, meta, list_distinct(urls) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, program_key ORDER BY delivered_at DESC, meta DESC) AS rn FROM program_snapshots) WHERE rn = 1)"


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "program_snapshots")
    best = d.groupBy("snapshot_no", "program_key").agg(F.max_by(F.struct("meta", "urls"), F.struct("delivered_at", "meta")).alias("r"))
    return best.select("snapshot_no", "program_key", "r.meta", F.array_distinct("r.urls").alias("urls"))


@query(f"""
WITH n AS (SELECT * FROM {_LAST} WHERE snapshot_no = (SELECT max(snapshot_no) FROM program_snapshots)), t AS (SELECT * FROM {_LAST} WHERE snapshot_no = (SELECT min(snapshot_no) FROM program_snapshots)),
j AS (SELECT program_key, len(n.urls) AS a, len(t.urls) AS b, len(list_intersect(n.urls, t.urls)) AS k FROM n JOIN t USING (program_key)),
s AS (SELECT *, CASE WHEN a = 0 AND b > 0 THEN 0.0 WHEN b > 0 THEN k / b ELSE 1.0 END AS share FROM j)
SELECT program_key, CASE WHEN a = 0 AND b > 0 THEN 'broken' WHEN share < 0.8 THEN 'shrank' WHEN a > b THEN 'grew' ELSE 'ok' END AS status, round(share, 6) AS kept_share FROM s""")
def s5_drift(spark, folder):
    d = _snapshots(spark, folder)
    ends = table(spark, folder, "program_snapshots").agg(F.min("snapshot_no").alias("lo"), F.max("snapshot_no").alias("hi"))
    d = d.crossJoin(F.broadcast(ends))  # one row
    now = d.where("snapshot_no = hi").withColumn("error", F.lit(None).cast("string"))
    return stores.drift(now, d.where("snapshot_no = lo")).withColumn("kept_share", F.round("kept_share", 6))


@query(f"""
WITH r AS (SELECT program_key, snapshot_no, (meta->>'last_kept')::INT AS kept FROM {_LAST}), l AS (SELECT *, lag(kept) OVER (PARTITION BY program_key ORDER BY snapshot_no) AS last FROM r)
SELECT program_key, snapshot_no, CASE WHEN kept = 0 THEN CASE WHEN last = 0 THEN 'healthy' ELSE 'empty' END WHEN last > 0 AND kept < 0.5 * last THEN 'dropped' ELSE 'healthy' END AS health FROM l""")
def st5_health_fsm(spark, folder):
    d = _snapshots(spark, folder).select("program_key", "snapshot_no", F.get_json_object("meta", "$.last_kept").cast("int").alias("kept"), F.lit(None).cast("string").alias("error"))
    return stores.health(d, "program_key", "snapshot_no").select("program_key", "snapshot_no", "health")


@query("SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000, true) AS allowed FROM events")
def st6_holdback(spark, folder):
    d = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stores.may_retry(d, "user_id", "ts", tie="event_id").select("event_id", "allowed")


def _learned(spark: SparkSession, folder: str) -> DataFrame:
    """What the crawls in ``candidates`` teach of each host and of the site it belongs to, in the form of ``domain_patterns``.

    Preferred are the first one and two path segments of accepted links, the most frequent first, skipped those of rejected
    links only; gates are those the store has of the domain, passed again, and the sections an agent's accepted links stood in.
    """
    known = table(spark, folder, "domain_patterns")
    host = urls.domain(F.col("u"))
    c = _candidates(spark, folder).where("verdict in ('accepted', 'rejected')")
    c = c.select(F.explode(F.array_distinct(F.array(host, urls.site_of(urls.host(F.col("u")))))).alias("domain"), urls.path(F.col("u")).alias("path"), "verdict", "source", "section", "found_at").where("domain <> ''")
    prefix = F.explode(F.array_distinct(F.array(*[F.regexp_extract("path", p, 1) for p in ("^(/[^/]+)/", "^(/[^/]+/[^/]+)/")])))
    good = F.count_if(F.col("verdict") == "accepted")
    each = c.select("domain", "verdict", prefix.alias("prefix")).where("prefix <> ''").groupBy("domain", "prefix").agg(good.alias("good"), F.count("*").alias("n"))
    top = F.row_number().over(Window.partitionBy("domain", F.col("good") > 0).orderBy(F.desc("good"), F.desc("n"), "prefix"))
    each = each.withColumn("rank", top).where(F.col("rank") <= stores.MAX_PATTERNS)
    lists = lambda keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("rank", "prefix")))), lambda x: x["prefix"])
    paths = each.groupBy("domain").agg(lists(F.col("good") > 0).alias("url_patterns_prefer"), lists(F.col("good") == 0).alias("url_patterns_skip"))
    opened = c.where("verdict = 'accepted' and source = 'agent' and section <> ''").groupBy("domain", "section").agg(F.min("found_at").alias("at"))
    opened = opened.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("at", "section"))).where(F.col("rank") <= stores.MAX_GATES)
    step = F.struct(F.lit("click").alias("tool"), F.col("section").alias("hint"), F.lit("").alias("value"))
    gate = F.struct("rank", F.col("section").alias("description"), F.array(step).alias("steps"))
    gates = opened.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(gate)), lambda g: F.struct(g["description"].alias("description"), g["steps"].alias("steps"))).alias("opened"))
    both = F.concat(F.coalesce("gate_sequences", F.slice("opened", 1, 0), F.array().cast(known.schema["gate_sequences"].dataType)), F.coalesce("opened", F.slice("gate_sequences", 1, 0), F.array().cast(known.schema["gate_sequences"].dataType)))
    learned = paths.join(gates, "domain", "left").join(known.select("domain", "gate_sequences"), "domain", "left").withColumn("gate_sequences", both).drop("opened")
    return known.limit(0).unionByName(learned, allowMissingColumns=True)


@query()
def a16_pattern_merge(spark, folder):
    return stores.merge_patterns(table(spark, folder, "domain_patterns"), _learned(spark, folder), F.lit("2027-01-01").cast("timestamp"))


@query("""
SELECT c.cand_id, coalesce(c.relevance, r.p) AS relevance, CASE WHEN coalesce(c.relevance, r.p) >= 0.75 THEN 'accepted' WHEN coalesce(c.relevance, r.p) < 0.4 THEN 'rejected' WHEN coalesce(c.relevance, r.p) IS NULL THEN 'unscored' ELSE 'unsure' END AS verdict
FROM candidates c LEFT JOIN (SELECT source, round(avg(relevance), 6) AS p FROM candidates GROUP BY 1) r USING (source)""")
def m6_fallback(spark, folder):
    c = table(spark, folder, "candidates").select("cand_id", "source", "relevance")
    means = c.groupBy("source").agg(F.round(F.avg("relevance"), 6).alias("relevance"))
    judge = judging.fallback_judge(judging.recorded_judge(c, ["cand_id"]), judging.recorded_judge(means, ["source"]))
    return judging.judged(c.drop("relevance"), judge).select("cand_id", "relevance", "verdict")


@query("""
WITH r AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status FROM events),
i AS (SELECT *, sum((status < 400)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM r),
n AS (SELECT *, sum((status >= 400)::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS run FROM i)
SELECT user_id, event_id, max((run >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS open FROM n""")
def m7_breaker(spark, folder):
    d = table(spark, folder, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return judging.breaker(d, ["user_id"], "o").select("user_id", "event_id", "open")


@query(r"""
WITH a AS (SELECT page_id, generate_subscripts(m, 1) - 1 AS ord, unnest(m) AS x FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>') AS m FROM pages)),
h AS (SELECT page_id, ord, split_part(trim(regexp_extract(x, '(?is)href="([^"]*)"', 1)), '#', 1) AS h, trim(regexp_replace(regexp_replace(regexp_extract(x, '(?is)>(.*)</a>$', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM a)
SELECT page_id, ord::INT AS ord, h AS url, CASE WHEN t <> '' THEN t ELSE split_part(string_split(h, '/')[-1], '?', 1) END AS name,
  regexp_matches(regexp_extract(h, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '(?i)\.(pdf|xlsx|xls|docx|doc|csv|pptx|zip)$') AS is_document FROM h WHERE h <> '' AND NOT starts_with(lower(h), 'javascript:')""")
def sc9_static_links(spark, folder):
    return html.static_links(table(spark, folder, "pages"))


@query()
def sc7_harvest(spark, folder):
    return html.harvest_links(table(spark, folder, "pages"))


@query()
def sc10_elements(spark, folder):
    return html.harvest_elements(table(spark, folder, "pages"))


def _sitemap_files(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "sitemap_entries")
    escape = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<url><loc>"), escape("url"), F.lit("</loc><lastmod>"), escape("lastmod"), F.lit("</lastmod></url>"))
    part = F.concat("sitemap_url", F.lit("?part="), F.floor(F.col("entry_id") / 1000).cast("string"))  # at most 1000 entries a file
    files = d.groupBy(part.alias("url")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    return files.select("url", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "rows", F.lit("</urlset>")).alias("body"))


@query(r"""
SELECT sitemap_url || '?part=' || floor(entry_id / 1000)::BIGINT AS file_url, regexp_replace(url, '^\s+|\s+$', '', 'g') AS loc, nullif(regexp_replace(lastmod, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), '') AS lastmod
FROM sitemap_entries WHERE regexp_replace(url, '\s+', '', 'g') <> ''""")
def sc2_sitemap_parse(spark, folder):
    return structured.sitemap_rows(_sitemap_files(spark, folder)).select("file_url", "loc", "lastmod")


@query(rf"""
SELECT page_id, l.url AS path, CASE WHEN coalesce(trim(l.name), '') <> '' THEN left(trim(l.name), 200) ELSE left(trim(coalesce(l.col_label, '')), 200) END AS name FROM {_LINKS}
WHERE l.url IS NOT NULL AND length(trim(l.url)) BETWEEN 8 AND 2000 AND NOT contains(left(l.url, 8), ' ') AND NOT regexp_matches(l.url, '(?i)\.(jpe?g|png|gif|svg|webp|ico|css|js|json|xml|html?|woff2?|ttf|mp4|mp3)(\?|$)') AND regexp_matches(l.url, '^(https?://|/)')""")
def sc12_json_records(spark, folder):
    # the recorded links of each page as one JSON body
    d = table(spark, folder, "pages").select("page_id", F.to_json(F.struct(F.col("page_links").alias("items"))).alias("body"))
    return structured.json_records(d, "page_id").select("page_id", "path", "name")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a total order per user."""
    return table(spark, folder, "events").withColumn("o", F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000)


_E = "(SELECT *, epoch_us(ts) * 1000 + event_id % 1000 AS o FROM events)"


@query(f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY o)::INT AS page_no FROM {_E}")
def w9_page_numbers(spark, folder):
    return traces.page_numbers(_events(spark, folder), ["user_id"], "o").select("event_id", "page_no")


@query(f"SELECT event_id, back FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY o DESC)::INT AS back FROM {_E}) WHERE back <= 10")
def w15_last_steps(spark, folder):
    return traces.last_steps(_events(spark, folder), ["user_id"], "o").select("event_id", "back")


@query("SELECT DISTINCT site, url FROM candidates c WHERE url IS NOT NULL AND source = 'agent' AND NOT EXISTS (SELECT 1 FROM candidates s WHERE s.site = c.site AND s.url = c.url AND s.source <> 'agent')")
def j10_revealed_since(spark, folder):
    c = table(spark, folder, "candidates").where("url is not null").select("site", "url", "source")
    return traces.revealed_since(c.where("source = 'agent'"), c.where("source <> 'agent'"), ["site", "url"]).select("site", "url").distinct()


@query("SELECT cand_id, CASE WHEN min(cand_id) OVER w < cand_id THEN min(cand_id) OVER w END AS same_as FROM candidates WINDOW w AS (PARTITION BY crawl_id, source, url)")
def j17_repeated_calls(spark, folder):
    return traces.repeated_calls(table(spark, folder, "candidates"), ["crawl_id"], ["source", "url"], "cand_id").select("cand_id", "same_as")


@query(f"SELECT event_id, coalesce(event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1, false) AS stalled FROM {_E} WINDOW w AS (PARTITION BY user_id ORDER BY o)")
def a18_stalled_runs(spark, folder):
    return traces.stalled_runs(_events(spark, folder), ["user_id"], "o", ["event_type"]).select("event_id", "stalled")


@query(f"SELECT event_id, arg_max(n, struct_pack(v := value, o := -n)) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY n)::INT AS best FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n FROM {_E})")
def a19_best_so_far(spark, folder):
    d = traces.page_numbers(_events(spark, folder), ["user_id"], "o")
    return traces.best_so_far(d, ["user_id"], "page_no", "value", F.col("event_type") == "error").select("event_id", "best")


@query("SELECT site, min(verdict) FILTER (source = 'page') AS page, min(verdict) FILTER (source = 'api') AS api, min(verdict) FILTER (source = 'agent') AS agent FROM candidates GROUP BY 1")
def a22_outcome_matrix(spark, folder):
    return traces.outcome_matrix(table(spark, folder, "candidates"), "site", "source", "verdict", ["page", "api", "agent"])


@query("SELECT program_key, count(*) AS requests, sum((meta->'usage'->>'prompt')::BIGINT)::BIGINT AS input_tokens, sum((meta->'usage'->>'completion')::BIGINT)::BIGINT AS output_tokens, round((sum((meta->'usage'->>'prompt')::BIGINT) * 3.0 + sum((meta->'usage'->>'completion')::BIGINT) * 15.0) / 1000000, 6)::DOUBLE AS cost FROM program_snapshots GROUP BY 1")
def a14_usage(spark, folder):
    get = lambda p: F.get_json_object("meta", f"$.usage.{p}").cast("long")
    d = table(spark, folder, "program_snapshots").select("program_key", get("prompt").alias("input_tokens"), get("completion").alias("output_tokens"))
    return traces.usage(d, ["program_key"], 3.0, 15.0)


@query(f"""
WITH g AS (SELECT site, {_NET} || regexp_replace({_PATH}, '(/[^/]*){{1,2}}$', '') AS grp, arg_min(u, cand_id) AS sample, min(cand_id) AS f, count(*) AS n FROM {_B} GROUP BY 1, 2)
SELECT site, grp, sample, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY f)::INT AS rank FROM g) WHERE rank <= 8""")
def a5_url_groups(spark, folder):
    d = _candidates(spark, folder).select("site", "cand_id", F.col("u").alias("url"))
    return traces.url_groups(d, ["site"], "cand_id")


@query("SELECT cand_id FROM candidates WHERE period_label IS NULL OR left(period_label, 4) = '2024'")
def fp11_goal_year_filter(spark, folder):
    d = table(spark, folder, "candidates").withColumn("year", F.substring("period_label", 1, 4))
    return traces.for_year(d, "year", "2024").select("cand_id")


@query("SELECT crawl_id, count(*) FILTER (coalesce(verdict, '') <> 'rejected') AS returned, count(*) FILTER (verdict = 'rejected') AS rejected FROM candidates GROUP BY 1")
def fp12_returned(spark, folder):
    c = table(spark, folder, "candidates")
    kept = plan.returned(c).groupBy("crawl_id").agg(F.count("*").alias("__kept"))
    return plan.rejected_counts(c, ["crawl_id"]).join(kept, "crawl_id", "left").select("crawl_id", F.coalesce("__kept", F.lit(0)).alias("returned"), "rejected")


@query("""
SELECT l_orderkey::VARCHAR AS crawl_id, bool_or(l_partkey % 6 <= 1 AND l_quantity <= 25) AS untried_tier1, bool_or(l_partkey % 6 <= 1 AND l_partkey % 7 = 0) AS goal_year_page, bool_or(l_partkey % 6 = 0 AND l_returnflag = 'R') AS menu_listing FROM lineitem GROUP BY 1""")
def w13_hold_open(spark, folder):
    q = _queue(spark, folder).withColumn("tier", ranking.tier(F.col("kind"), F.lit(False), F.lit(False))).withColumn("picked", F.col("q") > 25)
    return traces.hold_open(q, ["crawl_id"])


@query("""
WITH i AS (SELECT cand_id, crawl_id, row_number() OVER (PARTITION BY crawl_id ORDER BY cand_id)::INT AS ord FROM candidates),
a AS (SELECT crawl_id, relevance, row_number() OVER (PARTITION BY crawl_id ORDER BY found_at, cand_id)::INT AS ord FROM candidates WHERE verdict = 'accepted')
SELECT cand_id, i.ord, relevance FROM i LEFT JOIN a ON a.crawl_id = i.crawl_id AND a.ord = i.ord""")
def j1_zip_answers(spark, folder):
    # answers came in the order of finding, and only for accepted ones: the last items of a crawl have none
    c = table(spark, folder, "candidates")
    items = traces.page_numbers(c.select("crawl_id", "cand_id"), ["crawl_id"], "cand_id").withColumnRenamed("page_no", "ord")
    said = c.where("verdict = 'accepted'").select("crawl_id", "relevance", F.struct("found_at", "cand_id").alias("o"))
    answers = traces.page_numbers(said, ["crawl_id"], "o").select("crawl_id", "relevance", F.col("page_no").alias("ord"))
    return traces.zipped(items, answers, ["crawl_id"]).select("cand_id", "ord", "relevance")


@query("""
WITH e AS (SELECT *, epoch_us(ts) * 1000 + event_id % 1000 AS o, (event_type = 'purchase')::INT AS p, epoch(ts) AS t FROM events), n AS (SELECT *, row_number() OVER w AS n, sum(p) OVER w AS g, t - min(t) OVER (PARTITION BY user_id) AS spent FROM e WINDOW w AS (PARTITION BY user_id ORDER BY o)),
s AS (SELECT *, sum(1 - p) OVER (PARTITION BY user_id, g ORDER BY o) AS stale FROM n)
SELECT user_id, event_id, stale >= 12 AND greatest(n / 40, spent / 1728000) >= 0.5 AS stop FROM s""")
def fp19_no_progress(spark, folder):
    d = traces.page_numbers(_events(spark, folder), ["user_id"], "o")
    d = ranking.stale_runs(d, ["user_id"], "o", F.col("event_type") == "purchase")
    second = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    d = d.withColumn("spent", second - F.min(second).over(Window.partitionBy("user_id")))
    return d.select("user_id", "event_id", ranking.should_stop(F.col("stale"), F.col("page_no"), F.lit(40), F.col("spent"), F.lit(1_728_000)).alias("stop"))


@query("""
WITH l AS (SELECT DISTINCT site, url FROM candidates WHERE source = 'page' AND url IS NOT NULL), s AS (SELECT DISTINCT site, url FROM candidates WHERE source = 'sitemap' AND url IS NOT NULL)
SELECT site, url FROM l INTERSECT SELECT site, url FROM s""")
def s1_intersection(spark, folder):
    c = table(spark, folder, "candidates").where("url is not null")
    return c.where("source = 'page'").select("site", "url").intersect(c.where("source = 'sitemap'").select("site", "url"))


_PROGRAM = '''
import re
def discover(fetch, render):
    links = re.findall(r'href="([^"]+)"', fetch(START))
    for u in list(links):
        links += re.findall(r'href="([^"]+)"', fetch(u))
    return [{"url": u, "name": u.rsplit("/", 1)[-1]} for u in dict.fromkeys(links) if ".pdf" in u]
'''


@query()
def x1_program_udtf(spark, folder):
    # a program for every recorded page, over the last recording of the pages it can reach
    pages = table(spark, folder, "pages").where("url is not null").groupBy("site", "url").agg(F.max_by(F.struct("html", F.col("page_links.url").alias("to")), "page_id").alias("p")).select("site", "url", "p.*")
    key = urls.program_key(F.col("url"), F.concat(F.lit("reports of "), "url"))
    quoted = F.replace(F.replace(F.col("url"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    code = F.concat(F.lit("START = '"), quoted, F.lit("'\n"), F.lit(_PROGRAM))
    saved, held = programs.split(pages.select("site", F.col("url").alias("start"), key.alias("program_key"), code.alias("code")), pages)
    return programs.run_programs(saved, held).select("program_key", "url", "name", F.col("error").isNotNull().alias("failed"))


@query()
def discover_documents(spark, folder):
    return plan.discover(table(spark, folder, "pages"), F.array(*[F.lit(t) for t in ("report", "2024", "jelent")]))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def sc28_visible_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", html.visible_text("html").alias("text"))


@query(r"""
WITH t AS (SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n, length(array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), '')) AS k FROM pages)
SELECT page_id, n < 300 OR (k > 3 * n AND n < 1000) AS shell FROM t""")
def t24_shell_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", texts.script_shell(F.col("html")).alias("shell"))


@query(f"""
WITH k AS (SELECT crawl_id, url, min(page_kind) AS kind FROM pages WHERE page_kind IS NOT NULL GROUP BY 1, 2)
SELECT p.page_id, p.ord::INT AS ord, coalesce(k.kind, 'other') AS kind, (CASE WHEN k.kind IS NULL THEN 0 ELSE 1 END)::DOUBLE AS probability FROM {_LINKS} p LEFT JOIN k ON k.crawl_id = p.crawl_id AND k.url = p.l.url""")
def j2_link_kinds(spark, folder):
    pages = table(spark, folder, "pages")
    kinds = pages.where("page_kind is not null").groupBy(F.concat_ws("|", "crawl_id", "url").alias("k")).agg(F.min("page_kind").alias("kind")).withColumn("probability", F.lit(1.0))
    d = plan.page_links(pages).select("page_id", "ord", F.concat_ws("|", "crawl_id", "url").alias("k"))
    return judging.known_kinds(d, kinds, "k").select("page_id", "ord", "kind", "probability")


@query("""
SELECT c.domain, c.goal, p.url_patterns_prefer AS prefer, p.url_patterns_skip AS skip FROM (SELECT domain, CASE WHEN hash_even THEN last_goal ELSE 'another goal' END AS goal FROM (SELECT *, length(domain) % 2 = 0 AS hash_even FROM domain_patterns)) c
LEFT JOIN (SELECT * FROM domain_patterns WHERE len(url_patterns_prefer) > 0 OR len(url_patterns_skip) > 0) p ON p.domain = c.domain AND p.last_goal = c.goal""")
def j15_path_plan(spark, folder):
    known = table(spark, folder, "domain_patterns")
    crawls = known.select("domain", F.when(F.length("domain") % 2 == 0, F.col("last_goal")).otherwise("another goal").alias("goal"))
    return stores.path_plan(crawls, known).select("domain", "goal", F.col("url_patterns_prefer").alias("prefer"), F.col("url_patterns_skip").alias("skip"))


@query("SELECT domain, len(list_distinct(list_concat(coalesce(url_patterns_prefer, []), ['/reports/'], coalesce(url_patterns_skip, [])))) AS n FROM domain_patterns")
def s7_combined_patterns(spark, folder):
    both = goals.combined_patterns(F.concat(F.coalesce("url_patterns_prefer", F.array().cast("array<string>")), F.array(F.lit("/reports/"))), F.col("url_patterns_skip"))
    return table(spark, folder, "domain_patterns").select("domain", F.size(both).alias("n"))


@query(f"""
WITH h AS (SELECT DISTINCT site, {_PATH} AS path, source FROM {_B})
SELECT DISTINCT site, '/' || split_part(path, '/', 2) AS prefix FROM h WHERE source IN ('page', 'api')""")
def s4_prefix_memory(spark, folder):
    c = _candidates(spark, folder).select("site", "source", F.concat(F.lit("/"), F.get(F.split(urls.path(F.col("u")), "/"), 1)).alias("prefix"))
    c = c.withColumn("prefix", F.coalesce("prefix", F.lit("/")))
    return goals.union_prefixes(c.where("source = 'page'"), c.where("source = 'api'"), ["site"])


@query("SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def a21_latencies(spark, folder):
    return goals.latencies(table(spark, folder, "events"), ["event_type"], "value")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def a13_event_counts(spark, folder):
    d = goals.counted(table(spark, folder, "events"), ["user_id"], "event_type")
    of = lambda k: F.coalesce(F.col("counts")[k], F.lit(0)).alias(f"{k}s")
    return d.select("user_id", of("click"), of("error"))


@query("""
WITH a AS (SELECT site, source, avg(relevance) AS s FROM candidates GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(y.s - x.s), 6) AS shift FROM a x JOIN a y ON x.site = y.site WHERE x.source = 'page' AND y.source = 'agent' AND x.s IS NOT NULL AND y.s IS NOT NULL""")
def m13_arm_shift(spark, folder):
    d = table(spark, folder, "candidates").groupBy("site", F.col("source").alias("arm")).agg(F.avg("relevance").alias("score")).where("score is not null")
    return evaluation.arm_shift(d, ["site"], "page", "agent")


@query(f"SELECT cand_id, regexp_replace(split_part(x, '=', 1), '\\[\\d*\\]', '[]') AS facet FROM (SELECT cand_id, unnest(string_split({_QUERY}, '&')) AS x FROM {_B}) WHERE x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '[%+]')")
def u5_facet_keys(spark, folder):
    d = _candidates(spark, folder).select("cand_id", F.explode(urls.pairs(F.col("u"))).alias("p"))
    return d.where(~F.col("p.k").rlike("[%+ ]")).select("cand_id", urls.facet_key(F.col("p.k")).alias("facet"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY found_at DESC, cand_id DESC) AS back FROM candidates WHERE site IS NOT NULL)
SELECT crawl_id, count(*) AS requests, sum(length(coalesce(context, '')))::BIGINT AS tokens, round(sum(length(coalesce(context, ''))) * 4.0 / 1000000, 6)::DOUBLE AS cost FROM r GROUP BY 1""")
def m15_crawl_cost(spark, folder):
    d = table(spark, folder, "candidates").where("site is not null").groupBy("crawl_id").agg(F.count("*").alias("requests"), F.sum(F.length(F.coalesce("context", F.lit("")))).alias("tokens"))
    return d.withColumn("cost", texts.cost_usd(F.col("tokens"), 4.0).cast("double"))
