"""Links, elements and controls of recorded HTML, as Arrow-batched table functions over pages.

One forward scan per page.  Text is kept once, in one buffer; an open element
remembers where its text begins, so nothing is copied into ancestors, and links
wait at the few rows that may give their context.  The work is linear in the
page (a row's text is read up to a bound), also for unclosed and stray tags.

Visibility is taken from what HTML itself says (``hidden``, ``aria-hidden``,
``display:none``, ``visibility:hidden``); style sheets are not applied.

Defined results: null and empty pages give no rows; relative references are
resolved against the page's url; repeated rows give their rows again.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import texts, urls

LINK_SCHEMA = "ord int, url string, name string, context string, section string, col_label string, path string, dated string, chrome boolean"
ELEMENT_SCHEMA = "ord int, role string, name string, html_tag string, attributes map<string,string>, url string"
CONTROL_SCHEMA = "ord int, kind string, label string, current string, options array<string>, form int, in_frame boolean"
# Elements that take part in interaction, and their roles.
ROLES = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "summary": "button"}
INPUTS = {"submit": "button", "button": "button", "checkbox": "checkbox", "radio": "radio"}
_HEADINGS = {f"h{n}": n for n in range(1, 7)}
_ROWS = frozenset("tr li dd dt article p".split())
_FRAMES = frozenset("nav header footer aside".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template".split())
_DATE = re.compile(r"(?<![\w/-])(?:\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{4}\. ?\w+ \d{1,2}\.|\d{1,2}\.? (?:de )?[^\W\d_]{3,} (?:de )?\d{4}|[A-Z][a-z]{2,} \d{1,2}(?:st|nd|rd|th)?, \d{4})(?![\w-]*\.[a-z]{2,4}\b)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Characters of a row's text, of a text that a date is looked for in, and tags of a path.
ROW_TEXT, DATED_TEXT, PATH_TAGS = 160, 400, 8


class _Node:
    __slots__ = ("tag", "attrs", "begin", "size", "cell", "heads", "link", "element", "waiting", "frame", "unseen")

    def __init__(self, tag: str, attrs: dict, begin: int, size: int):
        self.tag, self.attrs, self.begin, self.size = tag, attrs, begin, size
        self.cell, self.heads, self.link, self.element, self.waiting, self.frame, self.unseen = 0, None, None, None, None, False, False


class Harvest(HTMLParser):
    """Open elements, headings in force, table heads, links with their row's text."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.open: list[_Node] = []
        self.counts: dict[str, int] = {}
        self.near: list[_Node] = []  # open elements that may give a link its row
        self.tables: list[_Node] = []
        self.rows: list[_Node] = []
        self.cells: list[_Node] = []
        self.trail: list[tuple[int, str]] = []
        self.pieces: list[str] = []
        self.size = 0
        self.frames = self.unseen = self.silent = 0
        self.links: list[dict] = []
        self.elements: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        node = _Node(tag, a, len(self.pieces), self.size)
        if tag in ("td", "th") and self.rows:
            row = self.rows[-1]
            node.cell = row.cell
            row.cell += int(a["colspan"]) if a.get("colspan", "").isdigit() else 1
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_UNSEEN.search(a.get("style", "")))
        if not self.unseen and not hidden:
            href = a.get("href") if tag == "a" else None
            if href or "data-href" in a:
                self.start_link(node, href or a["data-href"])
            role = a.get("role") or ROLES.get(tag) or (INPUTS.get(a.get("type", "text").lower(), "textbox") if tag == "input" and a.get("type") != "hidden" else None)
            if role:
                node.element = {"role": role, "html_tag": tag, "attributes": a, "url": registry_url(self.base, a), "name": ""}
                self.elements.append(node.element)
                if tag in _VOID:
                    self.name_element(node, "")
        if tag in _VOID:
            return
        self.open.append(node)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in _SILENT
        if hidden:
            node.unseen = True
            self.unseen += 1
        if tag in _FRAMES and "pag" not in a.get("class", ""):
            node.frame = True
            self.frames += 1
        if tag == "table":
            node.heads = {}
            self.tables.append(node)
        elif tag == "tr":
            self.rows.append(node)
        elif tag in ("td", "th"):
            self.cells.append(node)
        if tag in _ROWS or tag in ("td", "div"):
            self.near.append(node)

    def start_link(self, node: _Node, href: str) -> None:
        href = href.strip()
        if not href or href.startswith(("#", "javascript:", "mailto:", "tel:")):
            return
        label = self.tables[-1].heads.get(self.cells[-1].cell, "") if self.tables and self.cells else ""
        path = [n.tag for n in self.open[-(PATH_TAGS - 1) :]] + [node.tag]
        link = {"url": urljoin(self.base, href), "section": " > ".join(t for _, t in self.trail[-2:]), "path": ">".join(path), "chrome": self.frames > 0, "col_label": label, "context": "", "dated": "", "name": node.attrs.get("aria-label") or node.attrs.get("title", "")}
        node.link = link
        self.links.append(link)
        for row in self.near[-4:]:
            row.waiting = [link] if row.waiting is None else row.waiting
            if row.waiting[-1] is not link:
                row.waiting.append(link)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts.get(tag):
            return
        while True:
            node = self.open.pop()
            self.close_node(node)
            if node.tag == tag:
                return

    def text_of(self, node: _Node, most: int) -> str:
        """The text of an open element, up to about ``most`` characters."""
        out, size = [], 0
        for piece in self.pieces[node.begin :] if self.size - node.size <= most else self._some(node.begin, most):
            out.append(piece)
            size += len(piece)
        return " ".join("".join(out).split())

    def _some(self, begin: int, most: int) -> Iterator[str]:
        size, k = 0, begin
        while k < len(self.pieces) and size <= 4 * most:  # white space may fall away
            yield self.pieces[k]
            size += len(self.pieces[k])
            k += 1

    def close_node(self, node: _Node) -> None:
        tag = node.tag
        self.counts[tag] -= 1
        self.silent -= tag in _SILENT
        self.frames -= node.frame
        self.unseen -= node.unseen
        for stack in (self.near, self.tables, self.rows, self.cells):
            if stack and stack[-1] is node:
                stack.pop()
        if node.link is not None or node.element is not None or tag in _HEADINGS or tag == "th":
            text = self.text_of(node, 2000)
            if node.link is not None and text:
                node.link["name"] = text
            if node.element is not None:
                self.name_element(node, text)
            if tag in _HEADINGS and text:
                level = _HEADINGS[tag]
                self.trail = [(n, t) for n, t in self.trail if n < level] + [(level, text)]
            if tag == "th" and self.tables:
                span = node.attrs.get("colspan", "")
                for k in range(min(int(span), 100) if span.isdigit() else 1):
                    self.tables[-1].heads.setdefault(node.cell + k, text)
        if node.waiting:
            row = tag in _ROWS
            short = self.size - node.size <= 4 * DATED_TEXT
            text = self.text_of(node, DATED_TEXT) if row or short else ""
            for link in node.waiting:
                if row and not link["context"] and text and text != link["name"]:
                    link["context"] = text[:ROW_TEXT]
                if short and not link["dated"] and len(text) <= DATED_TEXT and (m := _DATE.search(text.replace(link["name"], " ", 1))):
                    link["dated"] = m.group(0)

    def name_element(self, node: _Node, text: str) -> None:
        a = node.attrs
        node.element["name"] = a.get("aria-label") or text or a.get("title") or a.get("placeholder") or a.get("alt") or a.get("value") or a.get("name", "")

    def handle_data(self, data: str) -> None:
        if not self.silent and not self.unseen:
            self.pieces.append(data)
            self.size += len(data)

    def finish(self) -> Harvest:
        self.close()
        while self.open:
            self.close_node(self.open.pop())
        return self


def registry_url(base: str, attrs: dict) -> str | None:
    """The url of an element: what its reference resolves to, or the reference as recorded, or None."""
    if attrs.get("resolved_href"):
        return attrs["resolved_href"]
    return urljoin(base, attrs["href"]) if attrs.get("href") else None


class Controls(HTMLParser):
    """Selects, groups of boxes and text fields of a page's forms, and their buttons."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.controls: list[dict] = []
        self.buttons: list[tuple[str, int]] = []
        self.labels: dict[str, str] = {}
        self.form = self.forms = 0
        self.private: set[int] = set()
        self.frame = 0
        self.aside = False
        self.select: dict | None = None
        self.option: list[str] | None = None
        self.picked = False
        self.label: tuple[str, list[str], list] | None = None
        self.button: list[str] | None = None

    def add(self, kind: str, a: dict, label: str, current: str, options: list[str] | None) -> dict:
        c = {"kind": kind, "label": label, "current": current, "options": options, "form": self.form, "in_frame": self.frame > 0 or self.aside, "id": a.get("id", ""), "name": a.get("name", "")}
        self.controls.append(c)
        return c

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in ("header", "nav", "footer"):
            self.frame += 1
        if tag == "form":
            self.forms += 1
            self.form = self.forms
            self.aside = a.get("role") in ("search", "dialog")
        elif tag == "label":
            self.label = (a.get("for", ""), [], [])
        elif tag == "select":
            self.select = self.add("select", a, a.get("aria-label") or a.get("title") or a.get("name", ""), "", [])
        elif tag == "option" and self.select is not None:
            self.close_option()
            self.option, self.picked = [], "selected" in a
        elif tag == "textarea":
            self.private.add(self.form)
        elif tag == "button":
            self.button = []
        elif tag == "input" and "disabled" not in a:
            kind = a.get("type", "text").lower()
            if kind in ("password", "email"):
                self.private.add(self.form)
            elif kind in ("checkbox", "radio"):
                c = self.add("radios" if kind == "radio" else "checkboxes", a, a.get("name", ""), "checked" if "checked" in a else "", [a.get("aria-label") or a.get("value", "")])
                if self.label:
                    self.label[2].append(c)
            elif kind in ("text", "search", "date", "month", "number") and "readonly" not in a:
                self.add(kind if kind in ("date", "month") else "text", a, a.get("aria-label") or a.get("placeholder") or a.get("title") or a.get("name", ""), a.get("value", ""), None)
            elif kind in ("submit", "button") and (a.get("value") or a.get("aria-label")):
                self.buttons.append((a.get("value") or a["aria-label"], self.form))

    def close_option(self) -> None:
        if self.option is not None and self.select is not None:
            text = " ".join("".join(self.option).split())
            if text:
                self.select["options"].append(text)
                if self.picked or not self.select["current"]:
                    self.select["current"] = text
        self.option = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("header", "nav", "footer"):
            self.frame = max(0, self.frame - 1)
        if tag == "form":
            self.form, self.aside = 0, False
        elif tag == "option":
            self.close_option()
        elif tag == "select":
            self.close_option()
            self.select = None
        elif tag == "label" and self.label:
            text = " ".join("".join(self.label[1]).split())
            if self.label[0]:
                self.labels[self.label[0]] = text
            for c in self.label[2]:
                c["options"] = [text]
            self.label = None
        elif tag == "button" and self.button is not None:
            text = " ".join("".join(self.button).split())
            if text:
                self.buttons.append((text, self.form))
            self.button = None

    def handle_data(self, data: str) -> None:
        for held in (self.option, self.button, self.label[1] if self.label else None):
            if held is not None:
                held.append(data)

    def found(self) -> list[dict]:
        """Controls in order: boxes of one name are one control, forms for logins and messages are left out."""
        out: list[dict] = []
        groups: dict[tuple, dict] = {}
        for c in self.controls:
            if c["form"] in self.private and c["form"]:
                continue
            label = self.labels.get(c["id"]) if c["id"] else None
            if c["kind"] in ("radios", "checkboxes"):
                text = (label or c["options"][0])[:80]
                if not text:
                    continue
                key = (c["kind"], c["name"] or text, c["form"])
                if key not in groups:
                    groups[key] = {**c, "options": [], "current": "", "label": c["name"]}
                    out.append(groups[key])
                groups[key]["options"].append(text)
                if c["current"]:
                    groups[key]["current"] = ", ".join(filter(None, [groups[key]["current"], text]))
            elif c["kind"] != "select" or len(c["options"]) >= 2:
                out.append({**c, "label": (label or c["label"])[:80]})
        return out


def _table(pages: DataFrame, key: str, base: str, html: str, schema: str, rows) -> DataFrame:
    kind = pages.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in re.split(r", (?=\w+ \w)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, *r) for k, b, text in zip(pdf["__key"], pdf["__base"], pdf["__html"], strict=True) if text for i, r in enumerate(rows(text, b or ""))]
            yield pd.DataFrame(out, columns=["__key", *names])

    d = pages.select(F.col(key).alias("__key"), F.col(base).alias("__base"), F.col(html).alias("__html"))
    return d.mapInPandas(run, f"__key {kind}, {schema}").withColumnRenamed("__key", key)


def harvest_links(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html") -> DataFrame:
    """Every link of each page, ``data-href`` rows too: text, row text, heading trail, column label, tag path, dated line, frame flag."""
    order = ("url", "name", "context", "section", "col_label", "path", "dated", "chrome")

    def rows(text: str, b: str):
        h = Harvest(b)
        h.feed(text)
        return [tuple(link[c] for c in order) for link in h.finish().links]

    return _table(pages, key, base, html, LINK_SCHEMA, rows)


def raw_links(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html") -> DataFrame:
    """(key, ord, url, name, heading): links as they stand, with the last heading above each; rows with ``data-href`` too."""
    d = harvest_links(pages, key, base, html)
    return d.select(key, "ord", "url", F.substring(texts.clean(F.col("name")), 1, 100).alias("name"), F.substring(F.element_at(F.split("section", " > "), -1), 1, 80).alias("heading"))


def harvest_elements(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html") -> DataFrame:
    """Interactive elements: role, accessible name, attributes, url."""

    def rows(text: str, b: str):
        h = Harvest(b)
        h.feed(text)
        return [(e["role"], e["name"], e["html_tag"], e["attributes"], e["url"]) for e in h.finish().elements]

    return _table(pages, key, base, html, ELEMENT_SCHEMA, rows)


def registry(elements: DataFrame) -> DataFrame:
    """Recorded elements with their ``url``: the resolved reference, else the reference, else null."""
    at = lambda k: F.nullif(F.col("attributes")[k], F.lit(""))
    return elements.withColumn("url", F.coalesce(at("resolved_href"), at("href")))


def harvest_controls(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html", cap: int = 25) -> DataFrame:
    """The first ``cap`` controls of each page's forms, with 60 options of each at most (what a form plan is shown)."""

    def rows(text: str, b: str):
        c = Controls()
        c.feed(text)
        c.close()
        return [(x["kind"], x["label"][:80], x["current"][:80], [o[:80] for o in x["options"][:60]] if x["options"] is not None else None, x["form"], x["in_frame"]) for x in c.found()[:cap]]

    return _table(pages, key, base, html, CONTROL_SCHEMA, rows)


def control_facts(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html") -> DataFrame:
    """(key, has_filter, typed_form, text): whether a page has a filter, and a text field that is no site search; 1,500 characters of its text."""

    def rows(text: str, b: str):
        c = Controls()
        c.feed(text)
        c.close()
        search = re.compile(r"search|keres|suche|query|^s$|\bq\b")
        typed = any(x["kind"] == "text" and not x["in_frame"] and not search.search(f"{x['name']} {x['label']} {x['id']}".lower()) for x in c.controls)
        return [(any(x["kind"] == "select" for x in c.controls), typed)]

    facts = _table(pages, key, base, html, "ord int, has_filter boolean, typed_form boolean", rows).drop("ord")
    return facts.join(pages.select(key, F.substring(visible_text(html), 1, 1500).alias("text")), key)


STATIC_DOCUMENT = r"(?i)\.(pdf|xlsx|xls|docx|doc|csv|pptx|zip)$"


def resolve(base: Column, href: Column) -> Column:
    """A reference resolved against its page: absolute, scheme-relative, root-relative, query-only and relative with ``.`` and ``..``."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.when(urls.path(base) == "", "/").otherwise(urls.path(base)), "[^/]*$", "")
    mark = F.regexp_extract(href, "^([^?#]*)", 1)
    segments = F.split(F.concat(folder, mark), "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(s))),
    )
    tail = F.when(mark.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    joined = F.concat(origin, F.array_join(kept, "/"), tail, F.regexp_extract(href, "^[^?#]*(.*)$", 1))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(urls.scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href.startswith("?"), F.concat(origin, urls.path(base), href)).otherwise(joined)
    )


def static_links(pages: DataFrame, key: str = "page_id", base: str = "url", html: str = "html") -> DataFrame:
    """(key, ord, url, name, is_document) of every anchor by pattern alone, JVM side: the cheap harvest of static pages.

    Fragment links, scripts and other schemes than http are skipped, fragments cut; the name is the anchor's text, or the
    last path segment.
    """
    anchors = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'), 0)
    d = pages.select(key, F.col(base).alias("__base"), F.posexplode(anchors).alias("ord", "__a"))
    href = F.trim(F.regexp_extract("__a", r'(?is)href="([^"]*)"', 1))
    d = d.withColumn("__h", href).where((F.col("__h") != "") & ~F.lower("__h").startswith("javascript:") & ~F.col("__h").startswith("#"))
    d = d.withColumn("url", urls.strip_fragment(resolve(F.col("__base"), F.col("__h")))).where(F.lower("url").startswith("http"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("__a", r"(?is)>(.*)</a>$", 1), "<[^>]*>", ""), r"\s+", " "))
    last = F.substring_index(F.element_at(F.split("url", "/"), -1), "?", 1)
    return d.select(key, "ord", "url", F.when(text != "", text).otherwise(last).alias("name"), urls.path(F.col("url")).rlike(STATIC_DOCUMENT).alias("is_document"))


def static_harvest(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id", base: str = "url", html: str = "html", site: str = "site") -> DataFrame:
    """(key, needs_browser, documents, queued) of each page's cheap harvest: a page needs a browser where it is a shell of
    scripts, shows signs of a framework, has no documents, or leads on to other pages of its site that robots allow."""
    from gleaner.operators.admission import with_robots

    d = static_links(pages, key, base, html).join(pages.select(key, F.col(site).alias("__site")), key)
    d = d.where(urls.domain(F.col("url")) == urls.bare_host(F.col("__site")))
    d = with_robots(d, rules) if rules is not None else d.withColumn("allowed", F.lit(True))
    n = d.groupBy(key).agg(F.count_distinct(F.when(F.col("is_document"), F.col("url"))).alias("documents"), F.count_distinct(F.when(~F.col("is_document") & F.col("allowed"), F.col("url"))).alias("queued"))
    signs = F.lit(False)
    for s in ("__NEXT_DATA__", "data-reactroot", "ng-app", "data-v-app", "window.__nuxt__"):
        signs = signs | F.contains(F.coalesce(html, F.lit("")), F.lit(s))
    facts = pages.select(key, (texts.script_shell(F.coalesce(html, F.lit(""))) | signs).alias("__shell"))
    out = facts.join(n, key, "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "queued": F.coalesce("queued", F.lit(0))})
    return out.select(key, (F.col("__shell") | (F.col("documents") == 0) | (F.col("queued") > 0)).alias("needs_browser"), "documents", "queued")


def canvas(html: Column) -> Column:
    """Whether a page draws on a canvas instead of holding elements."""
    return F.coalesce(F.contains(html, F.lit("flt-glass-pane")), F.lit(False))


def visible_text(html: str) -> Column:
    """A page's text without markup."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " "))


def grep(pages: DataFrame, pattern: str, key: str = "page_id", html: str = "html", around: int = 200, cap: int = 40) -> DataFrame:
    """(key, n, window): the first ``cap`` matches of a pattern per page with the text around each."""

    def rows(text: str, b: str):
        out = []
        for m in re.finditer(pattern, text):
            out.append((" ".join(text[max(0, m.start() - around) : m.end() + around].split()),))
            if len(out) == cap:  # a report of the first matches
                break
        return out

    return _table(pages, key, key, html, "n int, window string", rows)


def unescape(text: str) -> str:
    return _html.unescape(text)
