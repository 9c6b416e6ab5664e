from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.operators import evaluation, judging, links, ranking, series, stores
from gleaner.plans import programs
from gleaner.sources import html, structured

LINK = "page_id long, ord int, url string, name string, context string, section string, col_label string, path string, dated string, chrome boolean"


def test_merge_links(spark):
    d = spark.createDataFrame([(1, 0, "u", "a", "long ctx", None, "", "p", "", True), (1, 1, "u", "abc", "c", "s", "k", "q", "d", None), (1, 2, "u", "xyz", "", "t", None, "r", "e", True)], LINK)
    r = links.merge_links(d, ["page_id"], "ord").collect()[0]
    assert (r["name"], r["context"], r["section"], r["col_label"], r["path"], r["dated"], r["chrome"]) == ("abc", "c", "s", "k", "p", "", False)


def test_facets_and_variants(spark):
    d = spark.createDataFrame([("https://a/l", i, f"https://a/l?f%5B{i}%5D=v{i}") for i in range(3)] + [("https://a/l", 9, "https://a/l?page=2")], "page string, ord int, url string")
    r = links.facet_groups(d, "page", "ord").collect()
    assert [(x["facet"], x["n"]) for x in r] == [("f[]", 3)]
    q = spark.createDataFrame([("s", i, f"https://a/l?page={i}") for i in range(6)], "site string, ord int, url string")
    assert [x["ord"] for x in links.cap_variants(q, ["site"], "ord").orderBy("ord").collect()] == [0, 2, 3]


def test_prefixes(spark, rows):
    h = spark.createDataFrame([("s", "https://a/download/hu-hu/x/X.PDF"), ("s", "https://a/hu-hu/x/X.PDF")], "site string, href string")
    p = spark.createDataFrame([("s", "/hu-hu/x/X.PDF")], "site string, path string")
    assert rows(links.learn_prefixes(h, p, ["site"])) == [("s", "/download")]


def test_latest(spark):
    docs = [("f", "fund-a", "y", [2], None, "accepted"), ("f", "fund-a", "y", [3], None, "accepted"), ("f", "p", "", [], None, "accepted"), ("f", "m", "yq", [1], None, "unsure"), ("f", "m", "yn", [9], None, "unsure"), ("f", "fund-a", "y", [9], None, "rejected")]
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(docs)], "i int, crawl_id string, series_key string, shape string, order_values array<int>, published string, verdict string")
    got = [r["latest"] for r in series.mark_latest(d, ["crawl_id"]).orderBy("i").collect()]
    assert got == [False, True, None, None, None, None]


def test_scores(spark):
    s = "site string, ident string"
    found, expected, decoys = spark.createDataFrame([("a", "x"), ("a", "y")], s), spark.createDataFrame([("a", "x"), ("a", "z"), ("b", "q")], s), spark.createDataFrame([("a", "y"), ("a", "z")], s)
    r = {x["site"]: x for x in evaluation.score(found, expected, decoys, ["site"]).collect()}
    assert (r["a"]["recall"], r["a"]["precision"], r["a"]["decoys_total"], r["a"]["decoy_share"]) == (0.5, 0.5, 1, 1.0)
    assert (r["b"]["recall"], r["b"]["precision"], r["b"]["f1"], r["b"]["decoy_share"]) == (0.0, 0.0, 0.0, None)
    pages = spark.createDataFrame([("a", "x", 5), ("a", "z", 25)], "site string, ident string, page_no int")
    three = spark.createDataFrame([("a", "x"), ("a", "z"), ("a", "w")], s)
    r = evaluation.recall_at(pages, three, ["site"]).collect()[0]
    assert (r["recall_at_10"], r["recall_at_20"], r["recall_at_40"], r["pages_to_first_hit"]) == (0.333, 0.333, 0.667, 5)


def test_bandit_prefers_paying_group(spark):
    pages = [("c", f"menu{i}", "menu", [0.0], [0.0, 0.0, float(i)], 0) for i in range(6)] + [("c", f"t{i}", "table", [0.0], [1.0, 0.0, float(i)], 1) for i in range(6)]
    d = spark.createDataFrame(pages, "crawl_id string, url string, grp string, outer array<double>, inner array<double>, accepted int")
    got = {p: ranking.replay(d, p, 8).where("url like 't%'").count() for p in ("tier", "bandit")}
    assert got["tier"] == 2 and got["bandit"] >= 5


def test_numbers_of_a_scope_in_several_ranges(spark):
    rows = [("hot" if i % 10 else None, (i * 7919) % 1000, "clash") for i in range(1000)]
    d = spark.createDataFrame(rows, "site string, o int, __n string").repartition(5)
    got = sorted((r["site"] or "", r["n"], r["o"]) for r in ranking.numbered(d, ["site"], [F.col("o")], "n").collect())
    want = []
    for site in (None, "hot"):
        want += [(site or "", n, o) for n, o in enumerate(sorted(o for s, o, _ in rows if s == site), 1)]
    assert got == sorted(want) and ranking.numbered(d.limit(0), ["site"], [F.col("o")], "n").count() == 0


def test_stores(spark):
    run = spark.createDataFrame([("k", 1, None, 10), ("k", 2, None, 4), ("k", 3, None, 0), ("k", 4, None, 0), ("k", 5, "boom", 9)], "program_key string, run_no int, error string, kept int")
    assert [r["health"] for r in stores.health(run).orderBy("run_no").collect()] == ["healthy", "dropped", "empty", "healthy", "error"]
    a = spark.createDataFrame([("p", ["a", "b"], None), ("q", ["a"], None), ("r", [], None), ("s", ["a", "b", "c"], None)], "program_key string, urls array<string>, error string")
    b = spark.createDataFrame([("p", ["a", "b"]), ("q", ["a", "b"]), ("r", ["a"]), ("s", ["a", "b"])], "program_key string, urls array<string>")
    assert {r["program_key"]: r["status"] for r in stores.drift(a, b).collect()} == {"p": "ok", "q": "shrank", "r": "broken", "s": "grew"}
    gate = "array<struct<description:string,steps:array<string>>>"
    schema = f"domain string, updated_at timestamp, successful_crawl_count int, last_goal string, url_patterns_prefer array<string>, url_patterns_skip array<string>, gate_sequences {gate}, memory_snapshot map<string,string>, navigation_hints string, challenge_seen timestamp, challenge_passed_with string"
    old = spark.createDataFrame([("d", None, 3, "g", ["/a", "/b"], [], [("x", [])], {"k": "1", "l": "2"}, "hint", None, None)], schema)
    new = spark.createDataFrame([("d", None, 0, "", ["/b", "/c"], [], [("x", []), ("y", [])], {"k": "9"}, "", None, None), ("e", None, 0, "h", ["/z"], None, None, None, None, None, None)], schema)
    r = {x["domain"]: x for x in stores.merge_patterns(old, new, F.lit(datetime(2026, 1, 1))).collect()}
    assert r["d"]["url_patterns_prefer"] == ["/a", "/b", "/c"] and r["d"]["successful_crawl_count"] == 4 and r["d"]["last_goal"] == "g"
    assert [g["description"] for g in r["d"]["gate_sequences"]] == ["x", "y"] and r["d"]["memory_snapshot"] == {"k": "9", "l": "2"} and r["e"]["successful_crawl_count"] == 1
    hosts = spark.createDataFrame([("www.a.example",)], "host string")
    cookies = spark.createDataFrame([(".a.example", "c1", 10), ("b.example", "c2", 10), ("example", "c3", 1)], "domain string, cookie string, expires int")
    assert [r["cookie"] for r in stores.clearance(hosts, cookies, F.lit(5)).collect()] == ["c1"]


def test_breaker_and_plans(spark):
    d = spark.createDataFrame([("a", i, s) for i, s in enumerate([200, 500, 500, 200, 500, 500, 500, 200])] + [("b", 0, 401)], "k string, o int, status int")
    got = judging.breaker(d, ["k"], "o").orderBy("k", "o").collect()
    assert [r["open"] for r in got] == [False] * 6 + [True, True, True]


@pytest.mark.parametrize("body,want", [('{"items":[{"title":"T","name":"n","href":"/docs/aaa/b.pdf"},{"url":"https://x/y.png"}]}', [("/docs/aaa/b.pdf", "T")]), ("{bad", []), ("", []), (None, [])])
def test_json_walk(body, want):
    assert structured.json_walk(body) == want


def test_sitemap_walk(spark, rows):
    index = "<sitemapindex xmlns='x'><sitemap><loc>b</loc></sitemap><sitemap><loc>c</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>"
    page = "<urlset><url><loc> https://p/{} </loc><lastmod>2026</lastmod></url><url><loc></loc></url></urlset>"
    f = spark.createDataFrame([("a", index), ("b", page.format(1)), ("c", page.format(1).replace("2026", "")), ("d", "<broken")], "url string, body string")
    assert rows(structured.walk_sitemaps(f, spark.createDataFrame([("a",), ("zz",)], "url string")), "root", "url", "lastmod") == [("a", "https://p/1", "2026")]


def test_harvest(spark):
    page = '<nav><a href="/home">Home</a></nav><h2>Reports</h2><table><tr><th>Fund</th><th>File</th></tr><tr><td>A</td><td><a href="x.pdf">Get</a> 2026-03-01</td></tr></table><a href="javascript:x">no</a>'
    d = spark.createDataFrame([(1, "https://s/p/", page), (2, "https://s/", None)], "page_id long, url string, html string")
    r = html.harvest_links(d).orderBy("ord").collect()
    assert [(x["url"], x["chrome"]) for x in r] == [("https://s/home", True), ("https://s/p/x.pdf", False)]
    assert (r[1]["section"], r[1]["col_label"], r[1]["dated"], r[1]["context"]) == ("Reports", "File", "2026-03-01", "A Get 2026-03-01".replace("A Get", "AGet"))


def test_programs(spark, rows):
    code = "import re\ndef discover(fetch, render):\n    return [{'url': u} for u in re.findall('href=\"(.*?)\"', fetch('https://s/'))]"
    p = spark.createDataFrame([("s", "ok", code), ("s", "os", "import os\ndef discover(f, r): return []"), ("t", "none", "def discover(f, r): return [{'url': 1/0}]")], "site string, program_key string, code string")
    pages = spark.createDataFrame([("s", "https://s/", '<a href="/x.pdf">')], "site string, url string, html string")
    got = {r["program_key"]: (r["url"], bool(r["error"])) for r in programs.run_programs(p, pages).collect()}
    assert got == {"ok": ("/x.pdf", False), "os": (None, True), "none": (None, True)}
