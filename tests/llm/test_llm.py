import random
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import boilerplate, canonical, contexts, crf, leakage, pages, residue, spans, survivors, tokens

RANKS = pytest.mark.skipif(not __import__("os").path.exists(tokens.RANKS), reason="no tokenizer files")


# --- pages, boilerplate, residue -----------------------------------------------------------------

MENU = '<ul><li><a href="https://s/home">Home</a></li><li><a href="https://s/fees">Fees</a></li></ul>'
FOOT = "<div><p>© 2020 Corp. All rights reserved.</p></div>"


def page(n, body, side=""):
    return f'<html><head><title>t</title></head><body><div>{MENU}</div><div><a href="https://s/home">Home</a> › Fees</div><div><div><h1>Title {n}</h1>{body}</div><div>{side}</div></div>{FOOT}</body></html>'


def content(n):
    return f'<p>The <b>board</b> of Unit {n} approved&nbsp;a reserve of {n * 7919}\n for the year.</p><p><a href="https://s/files/a{n}.pdf">Report {n}</a> (PDF)</p>'


SIDE = '<h4>Most read</h4><li><a href="https://s/files/other.pdf">Other report</a></li><p>The issuer reviewed its stake in a quarry.</p>'


def test_blocks_rules():
    b = pages.blocks("<p>a <b>b</b>&amp;c<script>x</script> d</p><td>&#160; e\n f</td></div><noscript>n</noscript>z<br>y<!-- q -->w")
    assert [x.text for x in b] == ["a b&c", "d", "e f", "z", "yw"]
    assert pages.blocks(None) == pages.blocks("") == pages.blocks("<p> </p>") == []
    assert len(pages.blocks("<div>" * 3000 + "x")) == 1


@pytest.fixture(scope="module")
def site(spark):
    link = "array<struct<url:string,name:string>>"
    rows = [(i, "s", page(i, content(i), SIDE if i % 2 else ""), [(f"https://s/files/a{i}.pdf", "x"), ("https://s/home", "h"), ("https://s/files/other.pdf", "o")]) for i in range(40)]
    rows += [(100, "s", page(100, "<p>Please enable JavaScript to view this page.</p>", SIDE), None), (101, "s", page(101, "<p>{{ doc.text }}</p><p>${summary" + "x" * 200 + "}</p>"), []), (102, None, page(102, "<p>Lorem ipsum dolor sit amet velor massa</p>"), [])]
    rows += [(103, "s", page(103, content(103) + "<p>Visitors met the text access denied in the year 2019 and asked why the portal said so.</p>"), []), (104, "s", None, None), (105, None, "", []), (None, "s", "x", [])]
    d = spark.createDataFrame(rows, f"page_id long, site string, html string, page_links {link}").selectExpr("*", "concat('https://s/', page_id) as url", "1 as h", "'n' as n")
    return boilerplate.with_repeated(d, boilerplate.repeated_blocks(d))


def test_repeated_blocks(spark):
    block = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    rows = [(f"u{i}", "a", block("every page has this", f"own words {i}", "same" if i < 2 else "other")) for i in range(20)]
    rows += [("u1", "b", block("stored again")), ("u1", "b", block("stored again")), ("u1", "b", block("stored again")), ("u2", None, None)]
    d = spark.createDataFrame(rows, "url string, site string, html string")
    got = {r["site"]: set(r["common"]) for r in boilerplate.repeated_blocks(d).collect()}
    assert got == {"a": {boilerplate.block_hash("every page has this"), boilerplate.block_hash("other")}}


def test_main_bodies_and_residue(site, rows):
    model = boilerplate.fitted(site)
    assert rows(residue.residue_pages(site, model)) == [(100,), (101,), (102,)]
    got = {r for r in rows(boilerplate.main_bodies(site, model, residue.is_residue), "kind", "id", "block_md5")}
    md5 = boilerplate._md5
    for i in range(40):
        mine = {(k, h) for k, n, h in got if n == i}
        assert mine == {("page", md5(f"Title {i}")), ("page", md5(f"The board of Unit {i} approved a reserve of {i * 7919} for the year.")), ("page", md5(f"Report {i} (PDF)")), ("link", md5(f"https://s/files/a{i}.pdf"))}
    assert {n for _, n, _ in got} == {*range(40), 103}


def test_no_pages(site, rows):
    none = site.limit(0)
    model = boilerplate.fitted(none)
    assert rows(boilerplate.main_bodies(none, model)) == [] and rows(residue.residue_pages(none, model)) == []


def test_other_words_than_those_trained_on():
    """A banner, a teaser and a footer in words that no training page and no list has."""
    more = "<p>It was filed in the spring.</p>"
    known = [(pages.blocks(page(i, (more if i % 2 else "") + content(i) + (more if i % 4 < 2 else ""), SIDE if i % 3 else "")), frozenset()) for i in range(60)]
    model = boilerplate.fit(known)
    side = '<h5>Popular posts</h5><li><a href="https://t/posts/spring.html">How the spring went</a></li><p>The gardeners counted their tulips in the rain.</p>'
    text = (
        '<body><div><p>We value your choices. Pick what we may keep.</p><button>Fine</button></div><ul><li><a href="https://t/start">Start</a></li><li><a href="https://t/shop">Shop</a></li></ul>'
        f"<div><h1>Tulips</h1><p>Tulips were planted along the canal by the town in the year 1910, and they are still there.</p><p>The town counts them each May.</p></div><div>{side}</div>"
        '<footer><p>Gardens of the town, since 1910</p><a href="https://t/legal">Legal</a></footer></body>'
    )
    assert [b.text for b in model.body_of(pages.blocks(text))] == ["Tulips", "Tulips were planted along the canal by the town in the year 1910, and they are still there.", "The town counts them each May."]


def test_held_out_accuracy():
    known = [(pages.blocks(page(i, content(i), SIDE if i % 3 else "")), frozenset()) for i in range(60)]
    model = boilerplate.fit(known[:30])
    for i, (p, _) in enumerate(known[30:], 30):
        assert [b.text for b in model.body_of(p)] == [f"Title {i}", f"The board of Unit {i} approved a reserve of {i * 7919} for the year.", f"Report {i} (PDF)"]


def _worth(field, path):
    return sum(w * y for w, y in zip(field.weights, path, strict=True)) + sum(field.moves[a, b] for a, b in zip(path, path[1:], strict=False))


def test_viterbi_is_best_path():
    rnd = random.Random(1)
    for _ in range(40):
        n = rnd.randint(1, 7)
        field = crf.Field({str(i): i for i in range(n)}, np.array([rnd.uniform(-2, 1) for _ in range(n)]), np.array([[rnd.uniform(-2, 2) for _ in "ab"] for _ in "ab"]))
        paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
        scores = field.weights.tolist()
        assert _worth(field, field.decode(scores)) == pytest.approx(max(_worth(field, p) for p in paths))
        assert _worth(field, field.decode(scores, least_one=True)) == pytest.approx(max(_worth(field, p) for p in paths if any(p)))
        again = crf.Field.from_json(field.to_json())
        assert again.decode([again.score([str(i)]) for i in range(n)]) == field.decode(scores)


def test_posteriors_sum_over_all_paths():
    rnd = random.Random(2)
    n = 5
    field = crf.Field({str(i): i for i in range(n)}, np.array([rnd.uniform(-2, 2) for _ in range(n)]), np.array([[0.3, -0.2], [0.1, 0.7]]))
    x = np.stack([np.zeros(n), field.weights], axis=1)[None]
    single, _ = crf.posteriors(x, field.moves, np.ones((1, n), dtype=bool))
    paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
    odds = np.exp([_worth(field, p) for p in paths])
    assert single[0, :, 1] == pytest.approx((odds[:, None] * np.array(paths)).sum(axis=0) / odds.sum())


def test_unknown_labels_are_filled_by_their_neighbours():
    rows = [[["a"], ["b"], ["a"]], [["b"], ["b"], ["b"]], [["a"], ["a"], ["a"]]]
    field = crf.Field.train([(r, y) for r, y in zip(rows, ([1, None, 1], [0, 0, 0], [1, None, 1]), strict=True)] * 20)
    assert [field.decode([field.score(f) for f in r]) for r in rows] == [[1, 1, 1], [0, 0, 0], [1, 1, 1]] and field.decode([]) == []


def test_contexts(spark, rows):
    known = [(pages.blocks(page(i, content(i), SIDE if i % 3 else "")), frozenset()) for i in range(120)]
    words = contexts.fit_words(known, boilerplate.fit(known))
    cases = {"Home › Fees Report 7": 1, "Fees Home Fees Report 2": 1, "Report 5 (PDF) © 2020 Corp. All rights reserved.": 1, "© 2020 Corp. All rights reserved.": 1, "Report 9 (PDF)": 0, "Report 3": 0, "": 0, " ": 0, None: 0}
    d = spark.createDataFrame([(i, c, "x") for i, c in enumerate(cases)] + [(None, "Home › Fees", "x"), (0, "Home › Fees Report 7", "y")], "cand_id long, context string, id string")
    assert [r[1] for r in rows(contexts.framed_contexts(d, words))] == [i for i, v in enumerate(cases.values()) if v]
    assert rows(contexts.framed_contexts(d.limit(0), words)) == []


def test_words_decode_as_the_plain_field():
    rnd = random.Random(4)
    letters = "abcd"
    field = crf.Field({n: i for i, n in enumerate(["bias", *(f"{d}={w}" for d in contexts.AROUND for w in ["", *letters])])}, np.array([rnd.uniform(-1, 1) for _ in range(1 + len(contexts.AROUND) * 5)]), np.array([[0.5, -0.5], [-0.4, 0.6]]))
    words = contexts.WordField(field, set(letters))
    texts = [" ".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(60)]

    def plain(text):
        w = text.split()
        at = lambda k: w[k] if 0 <= k < len(w) else ""
        return field.decode([field.score(["bias", *(f"{d}={at(k + d)}" for d in contexts.AROUND)]) for k in range(len(w))])

    want = [sum(p) >= 2 or sum(p) == len(p) for p in map(plain, texts)]
    assert words.framed(texts).tolist() == want and 0 < sum(want) < 60


def test_residue_of_bodies():
    b = lambda *texts: pages.blocks("".join(f"<p>{t}</p>" for t in texts))
    yes = ["404 Not Found", "Oops! That page can't be found.", "Enable JavaScript in your browser to use this site.", "Loading…", "Verify you are human to continue.", "Zugriff verweigert.", "xxx xxxx xx", "veldor ipsa quam turbo lenti", "Coming soon", "<% title %>"]
    no = ["The board met in the spring and left the fee as it was.", "Visitors met the text access denied in the year 2019 and asked why the portal of the issuer said so again.", "Report 2020"]
    assert all(residue.is_residue(b(t)) for t in yes) and not any(residue.is_residue(b(t)) for t in no)
    assert not residue.is_residue([]) and not residue.is_residue(b(yes[0], no[0] * 2))
    short = b("Request held for a moment of check")
    assert residue.is_residue(short, challenged=True) and not residue.is_residue(short)


# --- copies and survivors ------------------------------------------------------------------------

CANDS = "cand_id long, site string, url string, name string, context string, dated string, source string, found_at timestamp, norm string"


def candidate(i, url, name=None, context=None, dated=None, source="agent", day=1):
    return (i, "s", url, name, context, dated, source, datetime(2026, 1, day), "clash")


def test_copies(spark, rows):
    data = [candidate(5, "https://A.example/x%20y.pdf?b=2&a=1#", "B | A"), candidate(3, " https://a.example/X-Y.PDF?a=1&&b=2", "a|b"), candidate(9, "https://a.example/x-y.pdf?a=1&b=2", "ab２"), candidate(7, "https://a.example/x-y.pdf?a=1&b=2", None), candidate(8, "https://a.example/x-y.pdf?a=1&b=2", ""), candidate(1, None, "a|b"), candidate(2, "", "q"), candidate(4, "", "Q!")]
    d = spark.createDataFrame(data, CANDS)
    assert rows(canonical.link_copies(d)) == [(2, 4), (3, 5), (7, 8)]
    records = {r["first_cand_id"]: r["copies"] for r in canonical.link_records(d).collect()}
    assert records == {2: 2, 3: 2, 7: 2, 9: 1}
    again = spark.createDataFrame([*data, data[0], data[5], candidate(20, data[0][2], "B | A"), candidate(20, data[0][2], "B | A")], CANDS)
    assert sorted(rows(canonical.link_copies(again))) == [(2, 4), (3, 5), (3, 20), (7, 8)]
    assert rows(canonical.link_copies(d.limit(0))) == []


def test_best_fields(spark, rows):
    data = [candidate(4, "https://a/x", "ab", None, "2020-01-01", "api", 3), candidate(2, "https://A/X", "abc", "", "soon", "page", 9), candidate(3, "https://a/x/", "a-b-c", "zz", "2021-01-01", "page", 3), candidate(6, "https://a/y", "n"), candidate(7, None, "n")]
    patterns = spark.createDataFrame([], "domain string, updated_at timestamp, memory_snapshot map<string,string>")
    g = survivors.keyed(spark.createDataFrame(data, CANDS))
    for least in (100, 1):  # decided by one task, and as groups too large for one
        assert rows(survivors.best_fields(g, patterns, least)) == [(2, "context", 3), (2, "dated", 3), (2, "name", 2), (2, "source", 2)]
        v = survivors.vote_records(g, patterns, least=least).collect()
        assert [(r["first_cand_id"], r["copies"], r["name"], r["context"], r["dated"], r["source"]) for r in v] == [(2, 3, "abc", "zz", "2021-01-01", "page")]
    assert rows(survivors.best_fields(g.limit(0), patterns)) == [] == rows(survivors.vote_records(g.limit(0), patterns))


def test_votes_are_summed_and_decay(spark):
    """Against a plain reckoning of sums of trust times decay."""
    rnd = random.Random(6)
    data = [candidate(i, f"https://a/{rnd.randint(0, 5)}", rnd.choice(["Ann", "a-nn", "Bob", "", None]), rnd.choice(["x 1", "X1", "y"]), None, rnd.choice([*survivors.TRUST, "odd"]), rnd.randint(1, 28)) for i in range(120)]
    want = {}
    for r in data:
        g = want.setdefault(r[2], {"n": 0, "first": r[0], "votes": {}})
        g["n"] += 1
        w = (5 - survivors.TRUST.index(r[6]) if r[6] in survivors.TRUST else 0) * 0.5 ** ((max(x[7] for x in data) - r[7]).days / survivors.HALF_LIFE_DAYS)
        for f, v in (("name", r[3]), ("context", r[4]), ("source", r[6])):
            if v:
                t = g["votes"].setdefault((f, v.lower().replace("-", "").replace(" ", "") if f != "source" else v), [0.0, 1 << 60])
                t[0] += w
                t[1] = min(t[1], r[0])
    patterns = spark.createDataFrame([], "domain string, updated_at timestamp, memory_snapshot map<string,string>")
    for least in (1000, 3):
        got = {r["first_cand_id"]: r for r in survivors.vote_records(survivors.keyed(spark.createDataFrame(data, CANDS)), patterns, least=least).collect()}
        assert len(got) == len(want)
        for g in want.values():
            r = got[g["first"]]
            assert r["copies"] == g["n"]
            for f in ("name", "context", "source"):
                value = max(((round(v, 9), -low, k[1]) for k, (v, low) in g["votes"].items() if k[0] == f))[2]
                assert (r[f] if f == "source" else r[f].lower().replace("-", "").replace(" ", "")) == value


def test_python_stands_behind_the_first_shuffle(spark, tmp_path):
    """No canonical form of a raw row: nothing pushes the Python step below the collapse of byte-identical rows."""
    data = [candidate(i, f"https://a/{i % 3}", "n") for i in range(9)]
    spark.createDataFrame(data, CANDS).write.parquet(str(tmp_path / "c"))
    d = spark.read.parquet(str(tmp_path / "c"))
    plan = canonical.link_survivors(d, "cand_id", "url", "name").where("k1 is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.index("MapInArrow") < plan.index("Exchange") < plan.index("Scan")
    assert "ArrowEvalPython" not in canonical.link_records(d)._jdf.queryExecution().executedPlan().toString()


def test_canonical_form_keeps_parts_apart():
    assert canonical.plain_url("https://a/x?ab&c") != canonical.plain_url("https://a/x?a&bc")
    assert canonical.plain_name("ab|c") != canonical.plain_name("a|bc") and canonical.plain_name("b | a||") == canonical.plain_name("A|B")
    assert canonical.plain("caf%E9") == canonical.plain("caf%C3%A9") != canonical.plain("caf%E8")
    assert canonical.plain_url("https://a/x?b=2&a=1&") == canonical.plain_url("HTTPS://A/X?a=1&&b=2")


# --- tokens --------------------------------------------------------------------------------------


@RANKS
def test_exact_ids(spark):
    rnd = random.Random(1)
    letters = "ab 1,'s\n\t .é中—   't’X9\x1c\x85"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(400)]
    texts += [None, "", "a  b", "x   ", "it's 'same don't('s 12a3", "<|endoftext|>", "a b " * 5000, "中" * 5000, *texts[:20]]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(d).collect()}
    bpe = tokens.Encoder().bpe
    assert got == {i: bpe.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.encode_corpus(d.limit(0)).count() == 0


@RANKS
def test_chunks_are_encoded_once_for_the_corpus(spark):
    """Texts that share long passages: their chunks are encoded by one document and given to the others; null and repeated keys too."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghé中 ,.1") for _ in range(rnd.randint(2, 9)))
    passages = [" ".join(word() for _ in range(600)) for _ in range(4)]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 40))) + rnd.choice(passages) + " ".join(word() for _ in range(40)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[1]), (None, texts[2]), (None, None), (99, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    plain = d.select(d.doc_id.alias("__doc"), d.text.alias("__text"))
    given = tokens.shared_ids(plain, tokens.RANKS, tokens.PATTERN).collect()
    assert len(given) > 20 and all(len(r["given"]) for r in given)
    bpe = tokens.Encoder().bpe
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in tokens.encode_corpus(d).collect())
    assert got == sorted((k or -1, bpe.encode_ordinary(t or "")) for k, t in rows)
    # what is given is used, not encoded again
    encoder = tokens.Encoder()
    held = {np.array([x["h1"], x["h2"]], dtype=np.int64).tobytes(): np.array([7] * len(x["ids"]), dtype=np.int32) for r in given for x in r["given"]}
    ids, _ = tokens.encode_buffer(encoder, np.frombuffer(texts[0].encode(), dtype=np.uint8), np.array([0, len(texts[0].encode())]), held)
    assert (ids == 7).sum() > 100 and len(ids) == len(bpe.encode_ordinary(texts[0]))


@RANKS
def test_pieces_are_encoded_once():
    e = tokens.Encoder()
    tokens.encode_batch(e, pa.array(["some words here"] * 3, pa.string()))
    n = len(e)
    tokens.encode_batch(e, pa.array(["here some words", None], pa.string()))
    assert len(e) <= n + 2


@RANKS
def test_every_hit_cuts_and_joins_are_repaired():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("éőűáñ中") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", ",", "7x"]) for _ in range(6000)).encode()
    data, offsets = np.frombuffer(text + text, dtype=np.uint8), np.array([0, len(text), 2 * len(text)])
    hits, ends, bounds = np.flatnonzero(tokens.hash_hits(data)), np.flatnonzero(tokens.token_ends(data)), tokens.chunk_bounds(data, offsets).tolist()
    assert sum(h not in set(ends) for h in hits) > 50
    for h in hits.tolist():  # a cut there, or the nearest sure places around as the ends of the join
        assert h in bounds or {max(e for e in [0, *offsets, *ends] if e < h), min(e for e in [*offsets, *ends] if e > h)} <= set(bounds)
    e = tokens.Encoder()
    ids, sizes = tokens.encode_buffer(e, data, offsets)
    want = e.bpe.encode_ordinary(text.decode())
    assert ids.tolist() == want * 2 and sizes.tolist() == [len(want)] * 2


# --- leaks ---------------------------------------------------------------------------------------


def test_leaks(spark, rows):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    item = [word() for _ in range(40)]
    noise = [word() for _ in range(400)]
    changed = [w if i % 9 else "other" for i, w in enumerate(item)]
    docs = {
        1: noise[:100] + item + noise[100:120], 2: [w.upper() + "," for w in item], 3: noise[:50] + changed + noise[60:90], 4: noise[:30] + item[:24], 5: item[:20] + noise[:30] + item[20:],
        6: noise[:200] + item[:8], 7: noise, 8: item[::-1], 9: [w for i in range(0, 40, 4) for w in [*item[i : i + 4], *noise[i * 5 : i * 5 + 60]]],
    }
    d = spark.createDataFrame([(k, "\n".join(v), 0) for k, v in docs.items()] + [(10, None, 0), (11, "", 0), (1, " ".join(docs[1]), 0)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(70, " ".join(item)), (71, None), (72, ""), (73, "two words")], "item_id long, text string")
    want = [(k, 70) for k in (1, 2, 3, 4, 5)]
    assert rows(leakage.find_leaks(d, b)) == want == rows(leakage.find_leaks(d, b, block_bytes=100))
    assert rows(leakage.remove_leaks(d, b), "doc_id") == [(k,) for k in (10, 11, 6, 7, 8, 9)]
    place = {r[0]: r[2:] for r in rows(leakage.leak_matches(d, b))}
    assert place[1] == (100, 0, 40) and place[2] == (0, 0, 40) and place[4] == (30, 0, 24) and place[5] == (0, 0, 20)
    assert rows(leakage.find_leaks(d.limit(0), b)) == [] == rows(leakage.find_leaks(d, b.limit(0)))


def test_alignment_counts_matches():
    best = leakage.align([np.arange(10)], [np.array([7, 0, 1, 2, 99, 4, 5, 6, 7, 8, 9])])
    score, hits = divmod(int(best[0]), leakage._UNIT)
    assert (score, hits) == (8, 9)


def _word(rnd):
    return "".join(rnd.choice("abcdefgh") for _ in range(6))


def test_gate_lets_through_what_the_alignment_accepts():
    rnd = random.Random(8)
    item, noise = [_word(rnd) for _ in range(40)], [_word(rnd) for _ in range(9000)]
    sixth = [w if i % 6 else "other" for i, w in enumerate(item)]
    added = [x for i, w in enumerate(item) for x in ([w, "more"] if i % 2 else [w])]  # runs of two words
    far = [*item[:20], *noise[:45], *item[20:]]
    long = [*item[:20], *noise[:20], noise[20] + ".", *noise[21:400], noise[400] + ".", *item[20:]]  # a sentence of any length
    two = [*item[:20], noise[0] + ".", *noise[1:300], noise[300] + ".", *noise[301:500], noise[500] + ".", *noise[501:800], noise[800] + ".", *item[20:]]
    docs = [noise[:50] + sixth + noise[50:60], added, noise[:7000] + far + noise[7000:], noise, item[:19], item[::2], noise[:4000] + long + noise[4000:], item[:12] + two[20:-20] + item[28:]]  # the last: several sentences in between
    p = leakage.Passages([(7, " ".join(item)), (8, "no such words here")])
    assert leakage.search_shard(p, [" ".join(d) for d in docs]) == [(0, 0), (1, 0), (2, 0), (6, 0)]
    other = leakage.Passages([(7, " ".join(item)), (8, " ".join(_word(rnd) for _ in range(900)))])  # an unrelated long passage changes nothing
    assert leakage.search_shard(other, [" ".join(d) for d in docs]) == [(0, 0), (1, 0), (2, 0), (6, 0)]


def test_gate_equals_aligning_everything():
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(4, 20))] for _ in range(40)]
    docs = [[rnd.choice(vocabulary) + rnd.choice(["", "", "", "."]) for _ in range(rnd.randint(0, 60))] for _ in range(60)]
    p = leakage.Passages([(i, " ".join(x)) for i, x in enumerate(items)])
    want = []
    for t, d in enumerate(docs):
        for o, x in enumerate(p.texts):
            need = max(leakage.SEED, leakage.SHARE * len(x))
            place = np.array([p.ids[w.rstrip(".")] for w in d] + [-1])
            ends = np.array([*leakage.sentences(" ".join(d)), 99])
            best = leakage.align([x], [place], np.array([need]), [ends])[0]
            assert leakage.upper_scores([x], [place])[0] >= leakage.align([x], [place], None, [ends])[0] // leakage._UNIT
            want += [(t, o)] if best and best // leakage._UNIT >= leakage.SCORE * len(x) else []
    assert 0 < len(want) < 2400 and leakage.search_shard(p, [" ".join(d) for d in docs]) == want


def test_suffix_array_is_in_order_and_finds_longest_matches():
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items, docs = [text(rnd.randint(4, 30)) for _ in range(6)], [text(rnd.randint(0, 80)) + ["zz"] * (i % 2) for i in range(8)]
    p = leakage.Passages([(i, " ".join(x)) for i, x in enumerate(items)])
    shard = leakage.Shard(p, [" ".join(d) for d in docs])
    array = shard.suffixes()
    joint = np.concatenate([shard.row, p.row]).tolist()

    def suffix(i):  # as far as every pair of it stands in some passage
        out = [(joint[i], joint[i + 1])]
        while i + len(out) * 1 + 1 < len(joint) and array.levels[0][i + len(out)] > 0:
            out.append((joint[i + len(out)], joint[i + len(out) + 1]))
        return out

    longest = max(len(x) for x in items)
    order = [suffix(int(i))[: longest] for i in array.places]
    for k in range(len(array.levels)):  # equal ranks are equal words
        seen = {}
        for i in array.places.tolist():
            if r := array.levels[k][i]:
                assert seen.setdefault(r, joint[i : i + (2 << k)]) == joint[i : i + (2 << k)]
    assert len(order) == len(array.places) == len(set(array.places.tolist()))
    for t, d in enumerate(docs):
        for o, x in enumerate(items):
            n = max((k for i in range(len(d)) for j in range(len(x)) for k in range(2, len(x) - j + 1) if d[i : i + k] == x[j : j + k] and i + k <= len(d)), default=0)
            a, b, m = shard.longest(t, o)
            assert m == n and (not n or d[a : a + n] == x[b : b + n])


def test_words_and_sentences():
    assert leakage.words("It’s 1,000 a_b — ﬁne. STRASSE Straße") == ["its", "1000", "ab", "fine", "strasse", "strasse"]
    assert leakage.words("It's 1,000 a_b - fine.") == ["its", "1000", "ab", "fine"]
    assert leakage.sentences("One two. – Three! “Four.” five") == [0, 0, 1, 2, 3] and leakage.words(None) == leakage.words("") == []


# --- spans ---------------------------------------------------------------------------------------


def shared_brute(texts, length):
    where = {}
    for k, t in texts:
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], set()).add(k)
    out = {}
    for k, t in texts:
        covered = {j for i in range(len(t) - length + 1) if len(where[t[i : i + length]]) > 1 for j in range(i, i + length)}
        if covered:
            out[k] = out.get(k, set()) | covered
    return {k: len(v) for k, v in out.items()}


def test_spans_match_brute_force(spark):
    rnd = random.Random(9)
    text = lambda n, a="abcdé😀 ": "".join(rnd.choice(a) for _ in range(n))
    notice, other = text(150), text(120)
    docs = [(i, text(rnd.randint(0, 80)) + notice[rnd.randint(0, 30) : rnd.randint(110, 150)] + text(rnd.randint(0, 80))) for i in range(30)]
    docs += [(40, other + text(30)), (41, text(20) + other + notice), (42, other + "x" + other), (43, "ab" * 200), (44, "ab" * 120), (45, "z" * 90), (46, "z" * 300), (47, text(200)), (48, other)]
    docs += [(50, None), (51, ""), (48, other)]
    for length in (64, 80):
        d = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, begin int")
        got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_spans(d, length=length).collect()}
        assert got == shared_brute([(k, t) for k, t in docs if t], length)
    assert spans.shared_spans(d.limit(0)).count() == 0


def test_spans_are_checked_on_the_texts(spark):
    """Intervals that hashes alone would count are dropped where the texts differ."""
    texts = spark.createDataFrame([(1, "abcdé😀fgh"), (2, "xxabcdé😀fgx"), (3, "abcdE😀fgh")], "__doc long, __text string")
    d = spark.createDataFrame([(1, 0, 8, 2, 2), (3, 0, 8, 2, 2), (3, 5, 2, 2, 7)], "__doc long, begin int, size int, wdoc long, wbegin int")
    assert sorted(map(tuple, spans.verified(d, texts).collect())) == [(1, 0, 8), (3, 5, 7)]
