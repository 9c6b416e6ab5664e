from datetime import datetime, timedelta

from gleaner.streaming import events as ev

SCHEMA = "crawl_id string, at timestamp, type string, accepted long"


def write(spark, folder):
    t = datetime(2026, 1, 1)
    rows = [("a" if i % 3 else "b", t + timedelta(minutes=20 * i), ["page", "done"][i % 2], i % 4 // 3) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder))
    return rows


def run(stream, mode, name, folder):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, rows, tmp_path):
    data = write(spark, tmp_path / "in")
    s = ev.read_events(spark, str(tmp_path / "in"), SCHEMA)
    batch = spark.read.parquet(str(tmp_path / "in"))
    counts = run(ev.windowed_counts(s, "at", "type"), "complete", "counts", tmp_path / "c1")
    assert rows(counts) == rows(ev.windowed_counts(batch, "at", "type"))
    first = run(ev.first_seen(s, ["crawl_id", "type"], "at"), "append", "first", tmp_path / "c2")
    assert rows(first.select("crawl_id", "type")) == rows(ev.first_seen(batch, ["crawl_id", "type"], "at").select("crawl_id", "type"))
    state = run(ev.stale_pages(s, at="at"), "update", "stale", tmp_path / "c3")
    want = {}
    for crawl, _, _, n in data:
        pages, accepted, stale = want.get(crawl, (0, 0, 0))
        want[crawl] = (pages + 1, accepted + n, 0 if n else stale + 1)
    assert {r["crawl_id"]: (r["pages"], r["accepted"], r["stale"]) for r in state.collect()} == want


def test_store_is_fed(spark, tmp_path):
    write(spark, tmp_path / "in")
    seen = []
    q = ev.to_store(ev.windowed_counts(ev.read_events(spark, str(tmp_path / "in"), SCHEMA), "at", "type"), lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) > 0


def test_queue_lives_in_the_stream(spark, tmp_path):
    """Pops of a stream in two batches are those of one queue, and state is whole after a round trip."""
    from gleaner.operators import frontier as fr

    kind = "crawl_id string, seq long, what string, url string, kind string, probability double, depth int, grp string, parent string, accepted int"
    rows = [("c", 0, "seed", "s", None, None, None, None, None, None)]
    rows += [("c", 1 + i, "add", u, k, p, 0, g, "s", None) for i, (u, k, p, g) in enumerate([("m0", "fund_or_product", 0.99, "nav"), ("m1", "fund_or_product", 0.98, "nav"), ("t0", "document_listing", 0.8, "table"), ("n", "news_or_article", 1.0, "x")])]
    rows += [("c", 10 + 2 * i, "pop", None, None, None, None, None, None, None) for i in range(6)]
    later = [r for r in rows if r[1] >= 13]
    first = [r for r in rows if r[1] < 13]
    for n, part in enumerate((first, later)):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    s = ev.read_events(spark, str(tmp_path / "in" / "*"), kind, 1)
    got = [r["url"] for r in run(fr.frontier_stream(s), "append", "pops", tmp_path / "q").orderBy("seq").collect()]
    assert got == ["s", "m0", "m1", "t0", "n"]
    q = fr.Queue("bandit")
    for r in rows[1:5]:
        q.add(r[3], r[4], r[5], 0, r[7], "s")
    q.add("m0", "other", 0.1)  # queued again: the later entry counts
    q.record("m1", 3)
    again = fr.Queue.from_json(q.to_json())
    pops = lambda x: [x.pop() for _ in range(6)]
    assert pops(again) == pops(q) and q.pop() is None


def test_a_page_that_opens_groups_is_credited():
    from gleaner.operators.frontier import Queue

    q = Queue("bandit")
    q.add("hub", "category_or_overview", 0.9, 0, "cards/a", "seed")
    hub, _, _ = q.pop()
    q.add("fund", "fund_or_product", 0.9, 0, "grid/a", hub)
    q.add("legal", "company_or_legal", 0.9, 0, "footer/a", hub)
    q.record(hub, 0)
    assert q.stats["cards/a"][1] > 0 and q.opened == {} and q.untried_first_tier()
    q.add_seed("start")
    q.add("start", "news", 0.1)
    assert q.pop()[0] == "start"


def test_batches_are_upserted_once(spark, tmp_path):
    from gleaner.sources.sinks import read_store

    feed = ev.upsert_batches(str(tmp_path / "store"), ["k"], "k string, v long")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v long")
    feed(batch(("a", 1), ("b", 1)), 0)
    feed(batch(("a", 2)), 1)
    feed(batch(("a", 9)), 1)  # the same batch after a failure
    assert {r["k"]: r["v"] for r in read_store(spark, str(tmp_path / "store")).collect()} == {"a": 2, "b": 1}
