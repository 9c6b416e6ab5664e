from datetime import datetime

import pytest

from gleaner.operators.timestamps import found_stamps, read_stamps, zone_intervals

PATTERNS = "domain string, updated_at timestamp, memory_snapshot map<string,string>"
SITES = [
    ("bp", datetime(2026, 1, 1), {"time_zone": "Europe/Budapest", "date_order": "dmy"}),
    ("ny", datetime(2026, 1, 1), {"time_zone": "America/New_York", "date_order": "mdy"}),
    ("no", None, {}),
    ("bad", None, {"time_zone": "Mars/Base"}),
    ("null", None, None),
]
CASES = [
    ("bp", "2019-03-31T02:30", None),  # skipped by the clock change
    ("bp", "2019-10-27 02:30", None),  # repeated by it
    ("bp", "2019-10-27 02:30 CEST", "2019-10-27T00:30:00.000000Z"),
    ("bp", "2019-10-27T03:00", "2019-10-27T02:00:00.000000Z"),
    ("bp", "03/04/2020", "2020-04-03"),
    ("ny", "03/04/2020", "2020-03-04"),
    ("ny", "23/04/2020", None),
    ("no", "03/04/2020", None),
    ("no", "23/04/20", "2020-04-23"),
    ("no", "04/04/2020", "2020-04-04"),
    ("no", "2020-01-01 10:00", None),
    ("bad", "2020-01-01 10:00", None),
    ("unknown", "2020-01-01T10:00:00.1234567+05:30", "2020-01-01T04:30:00.123456Z"),
    ("null", "20200101T100000Z", "2020-01-01T10:00:00.000000Z"),
    (None, "1600000000", "2020-09-13T12:26:40.000000Z"),
    ("bp", "  Közzétéve: 2020. március 5. ", "2020-03-05"),
    ("bp", "Mis à jour : 5 août 2020 à 14h05", "2020-08-05T12:05:00.000000Z"),
    ("bp", "12:30 am", None),
    ("ny", "March 3rd, 2021 12:30 AM", "2021-03-03T05:30:00.000000Z"),
    ("ny", "March 3rd, 2021 13:30 pm", None),
    ("bp", "1600000000123", "2020-09-13T12:26:40.123000Z"),
    ("bp", "30 February 2023", None),
    ("bp", "0000-00-00", None),
    ("bp", "2020-01-01 25:00", None),
    ("bp", "yesterday 14:30", None),
    ("bp", "Q2 2026", None),
    ("bp", "2026-03", None),
    ("bp", "", None),
    ("bp", None, None),
    ("bp", "2020-01-01 " * 5000, None),
]


@pytest.fixture(scope="module")
def patterns(spark):
    return spark.createDataFrame(SITES, PATTERNS)


def test_readings(spark, patterns):
    d = spark.createDataFrame([(i, s, v) for i, (s, v, _) in enumerate(CASES)], "id long, site string, v string")
    got = {r["id"]: r["norm"] for r in read_stamps(d, "v", patterns).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, _, want) in enumerate(CASES)}


def test_found_repeats_extra_columns_and_empty(spark, patterns, rows):
    c = spark.createDataFrame([(1, "bp", "2020-01-01", "x"), (1, "bp", "2020-01-01", "y")], "cand_id long, site string, dated string, norm string")
    s = spark.createDataFrame([(7, "no", "2021"), (8, "no", "2021-13"), (9, "no", "2021-02")], "entry_id long, site string, lastmod string")
    assert rows(found_stamps(c, s, patterns)) == [("candidate", 1, "2020-01-01"), ("sitemap", 7, "2021"), ("sitemap", 9, "2021-02")]
    assert found_stamps(c.limit(0), s.limit(0), patterns.limit(0)).count() == 0


def test_intervals_cover_every_hour_once_but_for_changes(spark):
    z = zone_intervals(spark.createDataFrame([("Europe/Budapest",), (None,), ("x",)], "zone string"))
    spans = z.where("year = 2021").collect()[0]["spans"]
    start = int((datetime(2021, 1, 1) - datetime(1970, 1, 1)).total_seconds())
    hits = [sum(s["lo"] <= start + h * 3600 < s["hi"] for s in spans) for h in range(365 * 24)]
    assert hits.count(0) == 1 and hits.count(2) == 1 and set(hits) == {0, 1, 2}
