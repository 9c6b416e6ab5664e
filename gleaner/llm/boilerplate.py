"""Main bodies of pages, by a linear-chain conditional random field over leaf blocks.

The model labels every block of a page as body or frame and decodes the page by
Viterbi.  Its features are ancestor tags, links, shape, words and place of the
block, of its neighbours, and on how many pages of its site the same block
stands (:func:`repeated_blocks`, counted over all pages).  It is trained on a
bounded sample of pages (:data:`SAMPLE`), labelled where :func:`teach` is
certain; blocks without a certain label are summed over in training.  The words
that speak for a frame are learned, not listed.

Everything after training is narrow: the blocks that repeat on a site are few
(their number is at most the mean number of blocks a page divided by
:data:`REPEATED`), so each page gets its site's as one short list.

Defined results: null, empty and blockless pages have no body; a page has a body
as soon as it has a block; a block or link that stands several times in a body
is given once; a url that stands in body and frame is of the body; pages stored
again under another id are pages of their own; a null site is a site of its own;
long pages are used whole; without pages there is no model and no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import phrases
from gleaner.llm.crf import Field
from gleaner.llm.pages import Block, block_texts, blocks

#: Pages the model is trained on, at most.
SAMPLE = 600
#: A block repeats where it stands on this share of its site's pages, and on three at least.
REPEATED, LEAST = 0.05, 3
#: A word is a feature from so many blocks of the sample on.
WORD_BLOCKS = 4

_SHARE = re.compile(r"\b(?:" + "|".join(map(re.escape, phrases.listed(phrases.SHARE))) + ")")
_COOKIE = re.compile("|".join(map(re.escape, phrases.listed(phrases.COOKIE))))
_FOOTER = re.compile("|".join(map(re.escape, phrases.listed(phrases.FOOTER))))
_SHALLOW = re.compile(r"^(?:https?://[^/?#]+)?/?[^/.?#]*/?(?:#.*)?$", re.I)
_FILE = re.compile(r"\.[a-z0-9]{2,5}(?:[?#]|$)", re.I)
_STEP = re.compile(r"[›»>/|·]")
_FRAMES = ("nav", "header", "footer", "aside")
_PARTS = ("nav", "header", "footer", "aside", "main", "article", "table", "form")
_WORD = re.compile(r"\w+|[^\w\s]")
_HEADS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _repeats(b: Block, common: frozenset[int]) -> bool:
    return bool(common) and len(b.text) >= 4 and block_hash(b.text) in common


def teach(page: list[Block], common: frozenset[int] = frozenset()) -> list[int | None]:
    """Labels of a training page where they are certain: 1 body, 0 frame, None unknown.

    Frame: parts that say so by their tag, buttons and what is said just before them, menus of section links, trails,
    stock phrases, blocks that repeat on the site outside tables, teasers under a small heading, and what stands before a
    first-level heading.  Body: from the main heading, or where there is none from the first sentence or file, to the next
    block of the frame.
    """
    main = next((i for t in ("h1", "h2") for i, b in enumerate(page) if b.tags[-1] == t), None)
    before = main if main is not None and page[main].tags[-1] == "h1" else 0
    frame: list[bool] = []
    scope = None
    for i, b in enumerate(page):
        tag, low = b.tags[-1], b.text.casefold()
        words = low.count(" ") + 1
        whole = bool(b.hrefs) and b.linked >= 0.8 * len(b.text)
        menu = whole and all(map(_SHALLOW.match, b.hrefs))
        trail = bool(b.hrefs) and len(b.text) < 300 and bool(_STEP.search(b.text)) and all(map(_SHALLOW.match, b.hrefs))
        said = words <= 5 and bool(_SHARE.search(low)) and not any(map(_FILE.search, b.hrefs)) or words <= 20 and bool(_FOOTER.search(low))
        again = tag not in ("td", "th", "dt", "dd", "h1") and _repeats(b, common)
        asked = i + 1 < len(page) and page[i + 1].tags[-1] == "button" and page[i + 1].holder == b.holder
        if scope is not None and (scope not in (b.holder, b.parent) or menu):
            scope = None
        if _HEADS.get(tag, 0) >= 4:
            scope = b.holder
        named = any(t in b.tags for t in _FRAMES) or tag in ("button", "label")
        frame.append(named or menu or trail or said or again or asked or scope is not None or i < before)
    out: list[int | None] = [0 if f else None for f in frame]
    if main is None:
        told = (i for i, b in enumerate(page) if not frame[i] and (b.text.count(" ") >= 11 and b.text[-1] in ".!?" or any(map(_FILE.search, b.hrefs))))
        main = next(told, len(page))
    for i in range(main, len(page)):
        if frame[i] and i > main:
            break
        if i == main or len(page[i].text) > 300 or not _COOKIE.search(page[i].text.casefold()):
            out[i] = 1
    return out


def _own(b: Block, common: frozenset[int]) -> tuple:
    tags, text = b.tags, b.text
    words = text.count(" ") + 1
    if b.hrefs:
        share = b.linked / max(1, len(text))
        link = "all" if share >= 0.8 else "most" if share >= 0.4 else "some"
        shallow = sum(1 for h in b.hrefs if _SHALLOW.match(h))
        href = "top" if shallow == len(b.hrefs) else "file" if not shallow and all(_FILE.search(h) for h in b.hrefs) else "mixed" if shallow else "deep"
        many = min(len(b.hrefs), 3)
    else:
        link, href, many = "no", "no", 0
    size = 1 if words == 1 else 2 if words == 2 else 3 if words < 6 else 6 if words < 12 else 12 if words < 24 else 24
    last = text[-1]
    end = "." if last in ".!?…" else ":" if last == ":" else "a" if last.isalpha() else "0" if last.isdigit() else "-"
    step = "step" if b.hrefs and _STEP.search(text) else ""
    digit = any(c.isdigit() for c in text)
    return (tags[-1], tags[-2] if len(tags) > 1 else "#", tags[-3] if len(tags) > 2 else "#", link, href, many, size, end, step, digit, _repeats(b, common), tuple(p for p in _PARTS if p in tags))


def _spell(own: tuple) -> list[str]:
    """Names of the features of a block alone."""
    tag, above, over, link, href, many, size, end, step, digit, again, parts = own
    out = ["bias", f"tag={tag}", f"above={above}", f"over={over}", f"link={link}", f"href={href}", f"many={many}", f"size={size}", f"end={end}", f"digit={digit}", f"again={again}"]
    out += [f"tag,link,href={tag},{link},{href}", f"tag,above={tag},{above}", f"tag,size={tag},{size}", f"again,tag={again},{tag}", f"size,end={size},{end}", f"above,tag,href={above},{tag},{href}"]
    out += [f"in={p}" for p in parts]
    if step:
        out.append(f"step,{link}")
    return out


def _near(own: tuple, side: str) -> list[str]:
    tag, _, _, link, href, _, size, _, _, _, again, _ = own
    return [f"{side}:tag={tag}", f"{side}:link,href={link},{href}", f"{side}:again={again}", f"{side}:size={size}"]


def _place(i: int, page: list[Block], level: int, held: bool, headed: bool, own: tuple) -> tuple:
    b = page[i]
    beside = "parent" if i and page[i - 1].parent == b.parent else "holder" if i and page[i - 1].holder == b.holder else "far"
    edge = "alone" if len(page) == 1 else "first" if i == 0 else "last" if i == len(page) - 1 else ""
    return (level, held, headed, beside, edge, own[0], own[1], own[3], own[4])


def _spell_place(place: tuple) -> list[str]:
    level, held, headed, beside, edge, tag, above, link, href = place
    out = [f"level={level}", f"headed={headed}", f"beside={beside}", f"level,held={level},{held}", f"level,held,tag={level},{held},{tag}", f"level,above,tag={level},{above},{tag}"]
    out += [f"headed,tag={headed},{tag}", f"headed,link,href={headed},{link},{href}", f"level,link,href={level},{link},{href}"]
    if edge:
        out.append(f"edge={edge}")
    return out


def _words(text: str) -> set[str]:
    return {w if not w.isdigit() else "#" for w in _WORD.findall(text.casefold())}


def _signatures(page: list[Block], common: frozenset[int]) -> list[tuple[tuple, tuple | None, tuple | None, tuple, str]]:
    """What the features of each block are spelled from: itself, the one before, the one after, its place, its text."""
    owns = [_own(b, common) for b in page]
    out = []
    level, holder, headed = 0, None, False
    for i, b in enumerate(page):
        if (n := _HEADS.get(b.tags[-1], 0)) > 0:
            level, holder = n, b.holder
            headed = headed or n <= 2
        held = holder is None or holder in (b.holder, b.parent)
        out.append((owns[i], owns[i - 1] if i else None, owns[i + 1] if i + 1 < len(page) else None, _place(i, page, level, held, headed, owns[i]), b.text))
    return out


def features(page: list[Block], common: frozenset[int] = frozenset()) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for own, before, after, place, text in _signatures(page, common):
        row = _spell(own) + _spell_place(place) + [f"w={w}" for w in _words(text)]
        row += _near(before, "-1") if before else ["-1:none"]
        row += _near(after, "+1") if after else ["+1:none"]
        out.append(row)
    return out


class Model:
    """The trained field, with the scores of what comes again and again kept by the worker."""

    def __init__(self, field: Field):
        self.field = field
        self.words = {name[2:]: w for name, w in field.table.items() if name.startswith("w=")}
        self.known: dict[tuple, float] = {}

    def __reduce__(self):
        return Model, (self.field,)

    def _of(self, kind: str, what: tuple | None, spell) -> float:
        key = (kind, what)
        if (x := self.known.get(key)) is None:
            if len(self.known) > 200_000:  # a memory bound without effect on results
                self.known.clear()
            x = self.known[key] = self.field.score(spell())
        return x

    def scores(self, page: list[Block], common: frozenset[int]) -> list[float]:
        out = []
        get = self.words.get
        for own, before, after, place, text in _signatures(page, common):
            s = self._of("o", own, lambda: _spell(own)) + self._of("p", place, lambda: _spell_place(place))  # noqa: B023
            s += self._of("-1", before, lambda: _near(before, "-1") if before else ["-1:none"])  # noqa: B023
            s += self._of("+1", after, lambda: _near(after, "+1") if after else ["+1:none"])  # noqa: B023
            out.append(s + sum([get(w, 0.0) for w in _words(text)]))
        return out

    def body_of(self, page: list[Block], common: frozenset[int] = frozenset()) -> list[Block]:
        """The blocks labelled body: the best labelling, or, where it has none, the best one that has."""
        return self.parts(page, common)[0]

    def parts(self, page: list[Block], common: frozenset[int] = frozenset()) -> tuple[list[Block], list[Block]]:
        """(body, what may stand in for it): where the best labelling has no body, also the blocks without links that do not repeat."""
        scores = self.scores(page, common)
        labels, rest = self.field.decode(scores), []
        if not any(labels):
            labels = self.field.decode(scores, least_one=True)
            rest = [b for b in page if not b.hrefs and not _repeats(b, common)]
        return [b for b, label in zip(page, labels, strict=True) if label], rest


def repeated_blocks(pages: DataFrame, share: float = REPEATED, least: int = LEAST) -> DataFrame:
    """(site, common): hashes of the blocks that stand on ``share`` of the site's pages, and on ``least`` at least.

    All pages count.  The counts are combined before the shuffle, so a menu of a
    site with a third of all pages is one row a task; two pages with one url are
    told by least and greatest url, so a page stored again does not repeat itself.
    """
    site = F.coalesce("site", F.lit(""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owners, hashes = [], []
            for k, text in enumerate(pdf["html"]):
                seen = {block_hash(t) for t in block_texts(text) if len(t) >= 4}
                hashes += seen
                owners += [k] * len(seen)
            owners = np.array(owners, dtype=np.int64)
            yield pd.DataFrame({"site": pdf["site"].to_numpy()[owners], "u": pdf["u"].to_numpy()[owners], "h": np.array(hashes, dtype=np.int64)})

    rows = pages.where("html is not null").select(site.alias("site"), F.xxhash64("url").alias("u"), "html").mapInPandas(run, "site string, u long, h long")
    sizes = pages.where("html is not null").groupBy(site.alias("site")).agg(F.count("*").alias("pages"))
    counted = rows.groupBy("site", "h").agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi")).where((F.col("n") >= least) & (F.col("lo") < F.col("hi")))
    kept = counted.join(sizes, "site").where(F.col("n") >= share * F.col("pages"))
    return kept.groupBy("site").agg(F.collect_list("h").alias("common"))  # at most the mean number of blocks a page, divided by the share


def with_repeated(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """``pages`` with their site's repeated blocks (a list of bounded length; a site with many pages is split by AQE)."""
    return pages.withColumn("site", F.coalesce("site", F.lit(""))).join(repeated, "site", "left")


def sampled(pages: DataFrame, sample: int = SAMPLE) -> list[tuple[list[Block], frozenset[int]]]:
    """The blocks of at most ``sample`` pages (with ``common``), the same for the same pages: picked by the hash of their id."""
    keyed = pages.where("html is not null and page_id is not null")
    # the keys are picked without the texts; only the picked texts travel
    picked = keyed.select("page_id", F.xxhash64("page_id").alias("__h")).distinct().orderBy("__h").limit(sample)
    some = keyed.select("page_id", "html", "common").join(F.broadcast(picked), "page_id").groupBy("__h").agg(F.min(F.struct("html", "common")).alias("r")).orderBy("__h")
    return [(blocks(row[0]), frozenset(row[1] or ())) for row in some.select("r.html", "r.common").collect()]  # a bounded sample


def fit(known: list[tuple[list[Block], frozenset[int]]]) -> Model:
    """A model of the pages given, the same for the same pages."""
    rows = [(features(p, c), teach(p, c)) for p, c in known]
    return Model(Field.train(rows, least=WORD_BLOCKS))


_MODELS: OrderedDict[tuple, Model] = OrderedDict()


def model_key(pages: DataFrame) -> tuple[str, tuple[str, ...]]:
    """What a model of ``pages`` is kept under: the session and the files they are read from."""
    files = tuple(sorted(f for f in pages.inputFiles() if "/gleaner-" not in f))  # not the tables written on the way
    return pages.sparkSession.sparkContext.applicationId, files


def fitted(pages: DataFrame, known: list[tuple[list[Block], frozenset[int]]] | None = None) -> Model:
    """A model of ``pages`` (with ``common``), fitted once for the files they are read from and kept by the driver.

    ``known``: the sampled pages where the caller has them already; the first :data:`SAMPLE` train the model.
    """
    key = model_key(pages)
    if not key[1] or key not in _MODELS:
        _MODELS[key] = fit((sampled(pages) if known is None else known)[:SAMPLE])
        while len(_MODELS) > 4:
            _MODELS.popitem(last=False)
    return _MODELS[key]


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def common_of(value) -> frozenset[int]:
    return frozenset(value.tolist()) if value is not None else frozenset()


def main_bodies(pages: DataFrame, model: Model, residue=None) -> DataFrame:
    """(kind, id, block_md5) of the distinct body blocks (``page``) and body links (``link``) of each page (with ``common``).

    ``residue(body, challenged, rest, common)`` tells the pages without content, which are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, ids, sums = [], [], []
            for key, text, links, common, challenged in zip(pdf["page_id"], pdf["html"], pdf["links"], pdf["common"], pdf["challenged"], strict=True):
                common = common_of(common)
                body, rest = model.parts(blocks(text), common)
                if not body or residue is not None and residue(body, bool(challenged), rest, common):
                    continue
                inside = {h for b in body for h in b.hrefs}
                for kind, values in (("page", {b.text for b in body}), ("link", {u for u in links if u in inside} if links is not None else ())):
                    kinds += [kind] * len(values)
                    ids += [key] * len(values)
                    sums += map(_md5, values)
            yield pd.DataFrame({"kind": kinds, "id": ids, "block_md5": sums})

    challenged = F.col("challenged") if "challenged" in pages.columns else F.lit(False)
    rows = pages.where("page_id is not null").select("page_id", "html", F.transform("page_links", lambda x: x["url"]).alias("links"), "common", challenged.alias("challenged"))
    return rows.mapInPandas(run, "kind string, id long, block_md5 string")
