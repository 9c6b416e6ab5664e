import re

from pyspark.sql import functions as F

from gleaner.functions import periods, texts, urls
from gleaner.plans import queries


def values(spark, expr, data, kind="string"):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {kind}")
    return [r["v"] for r in d.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_periods(spark):
    cases = {"pelda_Egyensuly_A_202603.pdf": "2026-03", "2026. március havi jelentés": "2026-03", "III. negyedév 2025": "2025-Q3", "Half-year report 2025": "2025-H1",
             "Annual report 2025 - March 2026 update": "2026-03", "HAT-450-7/2026. (HAT-15402/2025.)": None, "Oktober_K501672_2021": "2021-10", "2025-H2 x": "2025-H2", "x%202024": "2024", "": None}
    assert values(spark, periods.period_of, list(cases)) == list(cases.values())


def test_dates_and_years(spark):
    cases = {"publicado el 12 de marzo de 2026": "2026-03-12", "31.02.2026": None, "03/12/2026": None, "x 31.02.2026 3.4.2026": "2026-04-03", "March 12, 2026": "2026-03-12"}
    assert values(spark, periods.date_of, list(cases)) == list(cases.values())
    d = spark.createDataFrame([("2022. május 12. HAT-450-7/2026.",), (None,)], "t string")
    assert [r["year"] for r in d.select(periods.year_of(F.col("t")).alias("year")).collect()] == ["2022", None]


def test_periods_by_tokens():
    """The left side of a year is read the longest first, numbers of any script count, ranks decide before places."""
    assert periods.period("25 March 2022 2017") == "2017-03" and periods.period("2024-05 and Q1 2023") == "2024-05"
    assert periods.period("march 2020 to 2021-02") == "2021-02" and periods.period("x 2016/05") is None and periods.period("20260315") == "2026-03"
    assert periods.without_periods("a 2026-03 b q1 2025 c") == "a   b   c" and periods.without_periods("") == ""
    assert periods.read_name("https://x/", "Bericht ２０２４") == ("bericht ２０２４", "", "bericht-２０２４", "bericht", "y", ["2024"])
    long = "word " * 50_000 + "march 2024"
    assert periods.period(long) == "2024-03" and periods.date(long + " and 3. 4. 2025") == "2025-04-03"


def test_series(spark):
    d = spark.createDataFrame([(1, "https://x/f/fund-a-factsheet-2026-03.pdf", ""), (2, "https://x/getfile.aspx?id=12", "Rapport 2025"), (3, "https://x/cm4-datasheet.pdf", None), (4, "", None)], "i int, u string, n string")
    out = periods.with_names(d, "u", "n").orderBy("i").collect()
    assert [r["series_key"] for r in out] == ["fund-a-factsheet.pdf", "rapport", "cm4-datasheet.pdf", ""]
    assert [r["shape"] for r in out] == ["yn", "y", "n", ""]


def test_urls(spark):
    assert values(spark, urls.canonical, ["https://a/B?view=docs&start=0#top", "https://a/B/?page=2", None]) == ["https://a/b?view=docs", "https://a/b/?page=2", None]
    same = values(spark, urls.paging_identity, ["https://a/list?page=2", "https://b/list?page=7&sort=date", "https://a/list?id=3"])
    assert same[0] == same[1] == "/list" and same[2] == "/list?id=3"
    assert values(spark, urls.as_url, ["https://a/é b%20c"]) == ["https://a/%C3%A9%20b%20c".replace("%20b", "%20b")]
    assert values(spark, urls.template, ["https://a/x/y/z.pdf", "https://a/"]) == ["url:/x/y/*", "url:/*"]
    assert values(spark, urls.site_of, ["www.a.co.uk", "x.b.example"]) == ["a.co.uk", "b.example"]


def test_texts(spark):
    assert values(spark, texts.verdict, [None, 0.75, 0.4, 0.39], "double") == ["unscored", "accepted", "unsure", "rejected"]
    assert values(spark, texts.goal_language, ["Find the annual report of the fund", "éves jelentés és minden őű", "xyz", None]) == ["en", "hu", None, None]
    assert values(spark, texts.goal_years, ["2020 bis 2022 und 1999"]) == [["1999", "2020", "2021", "2022"]]
    assert values(spark, texts.disposition_name, ['attachment; filename="a b.pdf"', "inline; filename*=UTF-8''%C3%A9.pdf", None]) == ["a b.pdf", "é.pdf", None]
    assert values(spark, texts.json_object, ['```json\n{"a":1}\n```', 'so: {"b": 2} ok', "no", None]) == ['{"a":1}', '{"b":2}', None, None]


def test_weakly_named_reads_the_raw_name(spark, tmp_path):
    names = ["Wenra: Tender notice, ２０２２", "Lettre à tous", "Un mot à deux", "Jelentés ٣", "a\u00a0b\u2003c\u3000d", "a\x1cb\x1fc\x85d", "– – – –", "Éves", "", None]
    spark.createDataFrame([(i, "https://s/", n) for i, n in enumerate(names)], "cand_id long, url string, name string").write.parquet(str(tmp_path / "candidates.parquet"))
    got = {r["cand_id"]: r["value"] for r in queries.QUERIES["t9_weakly_named"](spark, str(tmp_path)).collect()}
    assert got == {i: len((n or "").split()) < 4 and not re.search(r"\d", n or "") for i, n in enumerate(names)}
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame([(c, f"a{c}b{c}c{c}d") for c in every], "c string, name string").select("c", texts.is_weakly_named(F.col("name")).alias("weak"))
    assert {r["c"] for r in d.where("not weak").collect()} == {c for c in every if c.isspace() or re.match(r"\d", c)}


def test_queries_without_url_keep_candidates_without_url(spark, tmp_path):
    row = "cand_id long, site string, url string, name string, context string, section string, dated string, relevance double"
    spark.createDataFrame([(1, "a.example", None, "Report", "read 3 May 2024", "body>nav>a", "2024-05-03", 0.8)], row).write.parquet(str(tmp_path / "candidates.parquet"))
    want = {"t7_clean_text": "read 3 May 2024", "t8_injection_flag": False, "t9_weakly_named": True, "t17_verdict": "accepted", "u21_start_url": "https://www.a.example/", "u23_pattern_domain": "a.example"}
    got = {n: [r["value"] for r in queries.QUERIES[n](spark, str(tmp_path)).collect()] for n in [*want, "t2_date", "t3_year", "u11_domain"]}
    assert got.pop("u11_domain") == [] and all(v != [None] and len(v) == 1 for v in (got.pop("t2_date"), got.pop("t3_year")))
    assert got == {n: [v] for n, v in want.items()}
