"""Pages that show a template, filler, an error, a challenge or a demand for scripts where content should be.

All phrases of all languages are matched at once by one automaton, placeholders
by their delimiters, filler by words without any function word.  What is matched
counts by its share: a block counts where phrases cover enough of its words, a
page where such blocks are enough of its main body.  So a text that speaks about
an error is no case, and frames, scripts and noscript parts never count.  On
sites that were seen to show a challenge (``DomainPatterns.challenge_seen``) a
short body needs less of a block to be covered.

Defined results: null, empty and blockless pages, and bodies of headings alone
that match nothing, are no cases; rows repeated with one id give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import phrases
from gleaner.llm.boilerplate import Model, block_hash, common_of
from gleaner.llm.pages import Block, blocks

#: Share of a block's words that phrases cover for the block to count (the second where the site showed challenges and the body has at most SHORT words), and share of the body's characters in such blocks.
BLOCK_SHARE, CHALLENGED_SHARE, SHORT, BODY_SHARE = 0.4, 0.2, 60, 0.5

# The delimiters of template languages' placeholders.
_HOLES = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^{}%]*%\}|\$\{[^{}]*\}|#\{[^{}]*\}|<%[^<>%]*%>|\[\[[^\[\]]*\]\]|\[(?:insert|your|enter) [^\[\]]*\]"
    r"|\[[A-Za-z]+(?:[._][A-Za-z]+)*\]|__[A-Za-z]+(?:[._][A-Za-z]+)*__|@Model\.[\w.]+|%[A-Za-z]+(?:[._][A-Za-z]+)*%"
)
_TOKEN = re.compile(r"[^\W_]+(?:['’.:/-][^\W_]+)*")
_CODE = re.compile(r"[A-Z]{1,4}-?\d")
_FUNCTION = frozenset(phrases.FUNCTION.split())
_HEADS = ("h1", "h2", "h3")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p in phrases.listed(phrases.ERROR + phrases.SCRIPT + phrases.FILLER):
        a.add_word(p, len(p))
    a.make_automaton()
    return a


def covered(text: str) -> float:
    """Share of the words, function words and codes apart, that stand under a phrase."""
    low = text.casefold()
    if len(low) != len(text):  # letters that fold to several
        text = low
    size = len(low)
    spans = []
    for end, n in automaton().iter(low):
        begin, end = end + 1 - n, end + 1
        if begin and low[begin - 1].isalnum() or end < size and low[end].isalnum() and n < 5:
            continue  # inside a word; a short phrase must be a word, a longer one may be a stem
        spans.append((begin, end))
    if not spans:
        return 0.0
    spans.sort()
    hit = total = k = 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        under = any(x < b and y > a for x, y in spans[k : k + 8])
        word = low[a:b]
        if not under and (word in _FUNCTION or any(c.isdigit() for c in word) or "." in word or _CODE.match(m.group())):
            continue
        total += 1
        hit += under
    return hit / max(1, total)


def is_filler(text: str) -> bool:
    """Words without any function word of the languages known, or of one letter each, as no sentence has them."""
    words = [w for w in _TOKEN.findall(text) if not any(c.isdigit() for c in w)]
    plain = [w for w in words if w.islower() and "." not in w]
    if len(words) >= 2 and all(len(set(w.casefold())) == 1 and len(w) > 1 for w in words):
        return True
    return len(plain) >= 4 and len(plain) >= 0.7 * len(words) and not any(w in _FUNCTION or w.partition("'")[0] in _FUNCTION or w.partition("’")[0] in _FUNCTION for w in plain)


def holes(text: str) -> float:
    """Share of the characters in placeholders."""
    if not any(c in text for c in "{[<_@%"):
        return 0.0
    return sum(b - a for a, b in (m.span() for m in _HOLES.finditer(text))) / len(text)


def is_residue(body: list[Block], challenged: bool = False, rest: list[Block] | tuple = (), common: frozenset[int] = frozenset()) -> bool:
    """Whether a page shows something else instead of content.  ``rest``: what may stand in for a body that was not found."""
    if any(holes(b.text) >= 0.5 or covered(b.text) >= BLOCK_SHARE for b in rest):
        return True
    bad = good = 0
    words = sum(b.text.count(" ") + 1 for b in body)
    least = CHALLENGED_SHARE if challenged and words <= SHORT else BLOCK_SHARE
    for b in body:
        head = b.tags[-1] in _HEADS
        hole = holes(b.text)
        if hole >= 0.5 or head and hole or covered(b.text) >= least or not b.hrefs and not head and is_filler(b.text):
            bad += len(b.text)
        elif not head and not all(block_hash(x.strip()) in common for x in b.text.split(":")):  # headings and labels of the site's menus alone are no content
            good += len(b.text)
    return bad > 0 and bad >= BODY_SHARE * (bad + good)


def with_challenged(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pages`` with whether their site was ever seen to show a challenge; ``patterns`` has one row a domain."""
    seen = patterns.where("challenge_seen is not null").select(F.col("domain").alias("site")).distinct().withColumn("challenged", F.lit(True))
    return pages.join(seen, "site", "left").withColumn("challenged", F.coalesce("challenged", F.lit(False)))


def residue_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id) of the pages (with ``common`` and, where known, ``challenged``) without content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for key, text, common, seen in zip(pdf["page_id"], pdf["html"], pdf["common"], pdf["challenged"], strict=True):
                common = common_of(common)
                body, rest = model.parts(blocks(text), common)
                if is_residue(body, bool(seen), rest, common):
                    found.append(key)
            yield pd.DataFrame({"page_id": found}, dtype="int64")

    challenged = F.col("challenged") if "challenged" in pages.columns else F.lit(False)
    return pages.where("page_id is not null").select("page_id", "html", "common", challenged.alias("challenged")).mapInPandas(run, "page_id long").distinct()
