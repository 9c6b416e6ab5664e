import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner import profiles, session
from gleaner.engine import PATTERNS, Engine
from gleaner.operators import traces
from gleaner.plans import programs, queries
from gleaner.plans.discover import discover
from gleaner.sources import runs, sinks

LINK = "array<struct<url:string,name:string,context:string,section:string,col_label:string,path:string,dated:string,chrome:boolean>>"


def pages(spark):
    link = lambda url, name, dated=None: (url, name, "", "", "", "ul>li>a", dated, False)
    rows = [
        (1, "c", "s", "https://s/a", "news", [link("https://s/f/report-2024-03.pdf", "Report March 2024", "2024-04-01"), link("https://s/f/report-2024-02.pdf", "Report"), link("https://s/home", "Home")]),
        (2, "c", "s", "https://s/b", None, [link("https://S/f/report-2024-03.pdf#x", "again"), link("https://s/x/menu.pdf", "Menu")]),
        (3, "d", "s", "https://s/c", "other", None), (4, "d", "s", "https://s/d", "other", []),
    ]
    return spark.createDataFrame(rows, f"page_id long, crawl_id string, site string, url string, page_kind string, page_links {LINK}")


def test_discover(spark):
    terms = F.array(F.lit("report"))
    docs = {r["url"]: r for r in discover(pages(spark), terms).collect()}
    assert set(docs) == {"https://s/f/report-2024-03.pdf", "https://s/f/report-2024-02.pdf"}
    top = docs["https://s/f/report-2024-03.pdf"]
    assert (top["verdict"], top["period"], top["published"], top["latest_in_series"], top["year"]) == ("accepted", "2024-03", "2024-04-01", True, "2024")
    assert [r["url"] for r in discover(pages(spark), terms, latest=True).collect()] == ["https://s/f/report-2024-03.pdf"]
    assert discover(pages(spark), terms, include_rejected=True).count() == 3
    assert discover(pages(spark).limit(0), terms).count() == 0


def test_discover_with_sitemap_and_goal(spark):
    entries = spark.createDataFrame([("c", "https://s/f/report-2024-03.pdf", "2024-05-06"), ("c", "https://s/f/report-2021.pdf", None), ("d", "https://s/page", None)], "crawl_id string, url string, lastmod string")
    docs = {r["url"]: r for r in discover(pages(spark), F.array(F.lit("report")), sitemap=entries).collect()}
    assert (docs["https://s/f/report-2024-03.pdf"]["source"], docs["https://s/f/report-2024-03.pdf"]["published"]) == ("sitemap", "2024-05-06")
    assert docs["https://s/f/report-2024-02.pdf"]["source"] == "page" and "https://s/f/report-2021.pdf" in docs
    got = Engine(spark).discover_goal("Find the reports of 2024", 'x {"key_terms": ["report"]}', pages(spark), entries)
    assert sorted(r["url"] for r in got.collect()) == ["https://s/f/report-2024-02.pdf", "https://s/f/report-2024-03.pdf"]


def test_sinks(spark, tmp_path):
    docs = discover(pages(spark), F.array(F.lit("report")))
    sinks.write_csv(docs, str(tmp_path / "csv"))
    lines = [x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()]
    assert lines[0] == ",".join(sinks.RESULT) and sum("report-2024" in x for x in lines) == 2
    assert sinks.as_json(docs).count() == 2


def test_store_is_replaced_in_one_step(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert sinks.read_store(spark, folder, "k int, v string").count() == 0
    store = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_store(store, folder)
    held = sinks.read_store(spark, folder)
    sinks.write_store(sinks.read_store(spark, folder).unionByName(store), folder)
    assert sinks.read_store(spark, folder).count() == 2 and held.count() == 1  # who reads the version before still can
    broken = store.selectExpr("k", "raise_error('lost') as v")
    with pytest.raises(Exception):
        sinks.write_store(broken, folder)
    assert sinks.read_store(spark, folder).count() == 2
    sinks.write_store(store, folder)
    sinks.write_store(store, folder)
    assert len([p for p in (tmp_path / "store").iterdir() if p.is_dir()]) <= 3 and sinks.write_report(store, str(tmp_path / "reports"), "one").endswith("/one")
    with pytest.raises(Exception):
        sinks.write_report(store, str(tmp_path / "reports"), "one")


def test_shared_folder(spark, tmp_path, monkeypatch):
    d = session.written(spark.createDataFrame([(1, None)], "k int, v string"))
    assert d.collect() == [(1, None)] and session.checkpointed(d).count() == 1

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Elsewhere:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_folder(Elsewhere())


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), api_key="k")
    assert e.may_call("k") and not e.may_call(None) and "generic" in e.profiles() and e.health()["status"] == "ok"
    code = "import re\ndef discover(fetch, render):\n    return [{'url': u} for u in re.findall('href=\"(.*?)\"', fetch('https://www.s.example/'))]"
    key = e.save_program("https://www.s.example/", "reports", code)
    assert key.startswith("s.example__")
    link = "array<struct<url:string>>"
    pages = lambda *files: spark.createDataFrame([("s.example", "https://www.s.example/", "".join(f'<a href="{f}">' for f in files), [])], f"site string, url string, html string, page_links {link}")
    assert sorted(r["url"] for r in e.run_programs(pages("/1.pdf", "/2.pdf")).collect()) == ["/1.pdf", "/2.pdf"]
    assert [(r["status"], r["kept_share"]) for r in e.check(pages("/1.pdf")).collect()] == [("shrank", 0.5)]
    assert [r["status"] for r in e.check().collect()] == ["ok"] and e.results(key).count() == 2
    with pytest.raises(ValueError, match="may not"):
        e.save_program("https://s.example/", "g", "x = ().__class__")
    gate = PATTERNS
    e.learn(spark.createDataFrame([("WWW.s.example:443", None, 0, "g", ["/r/"], [], [], {}, "", None, None), ("../x", None, 0, "g", [], [], [], {}, "", None, None)], gate))
    assert [r["domain"] for r in e.patterns().collect()] == ["s.example"] and e.patterns("www.S.example").count() == 1
    e.forget("s.example")
    e.delete_program(key)
    assert e.patterns().count() == e.programs().count() == e.results().count() == 0
    blocks = spark.createDataFrame([("https://www.a.example/x?1", "A", 0), ("https://a.example/x", "again", 1), ("https://b.example/", "B", 2)], "url string, title string, ord int")
    assert [r["title"] for r in e.search_sites(blocks, blocks.limit(0).selectExpr("url", "title", "'' as snippet", "ord")).collect()] == ["A", "B"]


def test_profiles(tmp_path):
    assert profiles.load().name == "generic" and sorted(profiles.load().page_kinds) == sorted(profiles.PAGE_KINDS)
    good = profiles.load()
    for relevance, kinds in (({"true": "x"}, good.page_kinds), (good.relevance, {**good.page_kinds, "more": "x"})):
        with pytest.raises(profiles.UnknownProfile):
            profiles.checked("p", json.dumps({"relevance": relevance, "page_kinds": kinds}))
    (tmp_path / "own.json").write_text(json.dumps({"relevance": good.relevance, "page_kinds": good.page_kinds}))
    assert profiles.load(str(tmp_path / "own.json")).name == "own" and profiles.available(tmp_path) == ["own"]
    with pytest.raises(profiles.UnknownProfile, match="generic"):
        profiles.load("nowhere")


def test_run_loaders(spark, tmp_path):
    doc = {"url": "https://a.example/d.pdf"}
    truth = [{"site": "a", "goal": "g", "expected_documents": [doc], "decoy_documents": [doc, {"url": "https://a.example/x.pdf", "why": "old"}]}]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "a.json").write_text(json.dumps(truth[0]))
    (tmp_path / "truth" / "example.json").write_text(json.dumps({"site": "example", "expected_documents": [doc]}))
    entries, expected, decoys = runs.ground_truth(spark, str(tmp_path / "truth"))
    assert [r["profile"] for r in entries.collect()] == ["generic"] and [tuple(r) for r in decoys.collect()] == [("a", "https://a.example/x.pdf")] and expected.count() == 1
    folder = tmp_path / "runs" / "r1"
    folder.mkdir(parents=True)
    (folder / "run.json").write_text(json.dumps({"site": "a", "goal": "g", "pages": [], "page_kinds": [{"url": "https://a.example/l?start=0", "kind": "document_listing", "probability": 0.9}, {"url": "https://a.example/l", "kind": "other", "probability": 0.1}], "candidates": [{"url": "d", "verdict": "accepted", "source": "page"}]}))
    for n in (0, 1, 3):
        (folder / f"harvest_{n:03}.json").write_text(json.dumps({"url": f"https://a.example/{n}", "documents": [{"url": "d"}], "page_links": []}))
    r, h = runs.recorded_runs(spark, str(tmp_path / "runs"))
    assert sorted(x["n"] for x in h.collect()) == [0, 1] and [x["recording"] for x in r.collect()] == ["r1"]
    kinds, verdicts = runs.recorded_answers(r)
    assert [(x["kind"], x["key"]) for x in kinds.collect()] == [("document_listing", "https://a.example/l")]
    assert sorted(x["accepted"] for x in runs.joined_recording(h, kinds, verdicts).collect()) == [1, 1]
    (tmp_path / "set.json").write_text(json.dumps([{"site": "a", "url": "u", "label": 1}]))
    assert runs.labelled_set(spark, str(tmp_path / "set.json")).first()["label"] == 1


def test_programs_are_bounded():
    assert programs.run_program("def discover(f, r):\n    while True: pass", {}, 1)[1].startswith("stopped after")
    assert "MemoryError" in programs.run_program("def discover(f, r):\n    x = [0] * 10**9\n    return []", {}, 30)[1]
    assert "_sys" in programs.run_program("import collections\ndef discover(f, r):\n    return collections._sys", {})[1]
    assert "ZeroDivisionError" in programs.run_program("def discover(f, r):\n    return 1 / 0", {})[1]
    docs, error = programs.run_program("def discover(f, r):\n    return [{'url': str(i), 'name': 'n' * 999} for i in range(9000)]", {})
    assert error is None and len(docs) == programs.MAX_DOCUMENTS and len(docs[0][1]) == programs.MAX_NAME


def test_traces(spark):
    d = spark.createDataFrame([("a", i, v, e) for i, (v, e) in enumerate([(1, 0), (5, 1), (3, 0), (3, 0)])], "k string, o int, v int, e int")
    assert [r["best"] for r in traces.best_so_far(d, ["k"], "o", "v", F.col("e") == 1).orderBy("o").collect()] == [0, 0, 2, 2]
    assert [r["stalled"] for r in traces.stalled_runs(d, ["k"], "o", ["v", "e"]).orderBy("o").collect()] == [False, False, False, True]
    links = spark.createDataFrame([("https://s/l", "https://s/l?page=2"), ("https://s/l", "https://s/new"), ("https://s/m", "https://s/m?page=2"), ("https://s/m", "https://s/old")], "listing string, url string")
    known = spark.createDataFrame([("https://s/m", "https://s/old")], "listing string, url string")
    assert sorted(r["url"] for r in traces.take_revealed(links, "listing", known).collect()) == ["https://s/l?page=2", "https://s/new", "https://s/old"]
    calls = spark.createDataFrame([(datetime(2026, 1, 1), "https://www.api.s/x", "application/json", "POST", "c")], "at timestamp, url string, content_type string, method string, crawl_id string")
    assert sorted((r["kind"], r["value"]) for r in traces.learned_hosts(calls, ["crawl_id"]).collect()) == [("host", "api.s"), ("post", "api.s/x")]


def test_pattern_merge_brings_new_patterns_gates_and_domains(spark, tmp_path):
    gate = "array<struct<description:string,steps:array<struct<tool:string,hint:string,value:string>>>>"
    schema = f"domain string, updated_at timestamp, successful_crawl_count int, last_goal string, url_patterns_prefer array<string>, url_patterns_skip array<string>, gate_sequences {gate}, memory_snapshot map<string,string>, navigation_hints string, challenge_seen timestamp, challenge_passed_with string"
    g = [(x, [("click", x, None)]) for x in ("terms", "country", "type")]
    spark.createDataFrame([("docs.s.example", None, 3, "g", ["/old", "/b"], [], g, {"time_zone": "UTC"}, "hint", None, None)], schema).write.parquet(str(tmp_path / "domain_patterns.parquet"))
    at = datetime(2026, 1, 1)
    rows = [("https://docs.s.example/b/c/x.pdf", "accepted", "page", "", at)] * 2 + [(f"https://docs.s.example/p{i:02}/x.pdf", "accepted", "agent", f"S{i % 4}", at) for i in range(30)] + [("https://docs.s.example/no/x.pdf", "rejected", "page", "", at)]
    spark.createDataFrame(rows, "url string, verdict string, source string, section string, found_at timestamp").write.parquet(str(tmp_path / "candidates.parquet"))
    r = {x["domain"]: x for x in queries.QUERIES["a16_pattern_merge"](spark, str(tmp_path)).collect()}
    known, new = r["docs.s.example"], r["s.example"]
    assert known["url_patterns_prefer"] == ["/old", "/b", "/b/c", *[f"/p{i:02}" for i in range(17)]] and known["url_patterns_skip"] == ["/no"]
    assert [x["description"] for x in known["gate_sequences"]] == ["terms", "country", "type", "S0", "S1"] and known["memory_snapshot"] == {"time_zone": "UTC"}
    assert new["url_patterns_prefer"][:2] == ["/b", "/b/c"] and len(new["url_patterns_prefer"]) == 20 and new["successful_crawl_count"] == 1


def test_programs_cover_every_page_and_follow_links(spark, rows, tmp_path):
    link = lambda *to: "".join(f'<a href="{u}">x</a>' for u in to)
    pages = [(1, "s", "https://s/a", link("https://s/b", "https://s/1.pdf"), ["https://s/b", "https://s/1.pdf"]), (2, "s", "https://s/b", "old", []), (3, "s", "https://s/b", link("https://s/2.pdf"), ["https://s/2.pdf"]), (4, "s", "https://s/o'c", link("https://s/3.pdf"), None), (5, "t", "https://t/", None, [])]
    d = spark.createDataFrame([(i, s, u, h, None if to is None else [(x,) for x in to]) for i, s, u, h, to in pages], "page_id long, site string, url string, html string, page_links array<struct<url:string>>")
    d.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["x1_program_udtf"](spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["program_key"], []).append(r["url"])
    assert sorted(map(str, by.values())) == sorted(map(str, [["https://s/1.pdf", "https://s/2.pdf"], ["https://s/2.pdf"], ["https://s/3.pdf"], [None]]))
