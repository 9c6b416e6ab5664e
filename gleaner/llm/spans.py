"""Long spans that stand verbatim in more than one document, and how much of each document they cover.

A span of at least ``length`` code points is made of windows of exactly that
length, and a code point is shared when some window over it stands in another
document.  The tokens of a text are its overlapping grams of a quarter of that
length, each with a random hash.  The Cartesian tree over the hashes has a node
for each gram that is the minimum of some range; its compact window is all
ranges in which it is the minimum.  A window of the fixed length has exactly one
such node, so the part of a node's compact window at that length is a run of
window starts, and the runs of all nodes are the longest runs of starts with one
minimum: these are found by sliding minima, without building the tree.  Equal
windows have equal minima under every hash, so for verbatim spans one hash finds
all (several are needed where windows only resemble each other).

Documents can only share windows in groups of equal minimum.  Within them a whole
run is settled by one hash of its text where it stands elsewhere too.  The rest
(the ends of shared passages) is grouped again by the minima of longer grams,
settled the same way, and what is open then is compared window by window.  The
intervals found so each name a witness, the same interval of another document,
and are joined to the texts of both: only what is equal there, character by
character, counts.

All comparisons are joins and aggregations on hashes, with partial aggregation
before each shuffle; no group is collected and no pair of documents is made, so
a text that stands in a third of all documents costs each of them the same as
one that stands twice.  The shared folder holds ids and ranges only; texts are
read again where they are needed.

Defined results: null, empty and short texts have no spans; a span repeated
only inside its own document is not shared; rows repeated with one key are one
document; ``shared`` counts code points; should two texts have one hash (64 bits
of minimum and 64 of text, or 128 bits), the check on the texts drops the interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpointed

#: Code points of the shortest span.
LENGTH = 400

#: A gram is this part of the length: long enough not to be a stock phrase.
GRAM = 4
#: Where a group is still open, it is cut again by grams shorter than the length by this much.
FINE = 31

_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_B_INVERSE = pow(_B, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of all substrings of a row of code points, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, seed: int):
        self.seed = np.uint64(seed)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up), 1 << 14)
            steps = np.full(n, _B, dtype=np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps = np.full(n, _B_INVERSE, dtype=np.uint64)
            steps[0] = 1
            self.down = np.multiply.accumulate(steps)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        self.grow(len(codes))
        terms = _mix(codes.astype(np.uint64) + self.seed) * self.up[: len(codes)]
        out = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(terms, out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each substring [begin, end)."""
        return _mix((sums[end] - sums[begin]) * self.down[begin])


def compact_windows(codes: np.ndarray, length: int, gram: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimum, first start, number of starts, prefix sums) of the groups of windows of ``length``.

    A group is a longest run of window starts with one minimum over their grams:
    the part of a Cartesian-tree node's compact window that has the full width.
    """
    sums = hasher.sums(codes)
    at = np.arange(len(codes) - gram + 1)
    low = hasher.of(sums, at, at + gram)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:  # sliding minimum by doubling
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[first], first, np.diff(np.append(first, len(low))), sums


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_groups(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(__doc, low, whole, begin, n): compact window groups, with a hash of all the text a group's windows cover.

    Where ``texts`` has a list ``__open`` of window ranges, only groups that touch one.
    """
    partly = "__open" in texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(1)
        for pdf in batches:
            docs, parts = [], [[], [], [], []]
            for k, (doc, text) in enumerate(zip(pdf["__doc"], pdf["__text"], strict=True)):
                codes = _codes(text)
                if len(codes) < length:
                    continue
                low, begin, n, sums = compact_windows(codes, length, gram, hasher)
                if partly:
                    steps = np.zeros(len(codes) + 2, dtype=np.int64)
                    for x in pdf["__open"].iloc[k]:
                        steps[x["begin"]] += 1
                        steps[x["begin"] + x["n"]] -= 1
                    opened = np.concatenate([[0], np.cumsum(np.cumsum(steps) > 0)])
                    keep = opened[begin + n] > opened[begin]
                    low, begin, n = low[keep], begin[keep], n[keep]
                whole = hasher.of(sums, begin, begin + n - 1 + length)
                docs.append(np.full(len(low), doc, dtype=np.int64))
                for part, x in zip(parts, (_signed(low), _signed(whole), begin, n), strict=True):
                    part.append(x)
            if docs:
                low, whole, begin, n = map(np.concatenate, parts)
                yield pd.DataFrame({"__doc": np.concatenate(docs), "low": low, "whole": whole, "begin": begin.astype(np.int32), "n": n.astype(np.int32)})

    return texts.select("__doc", "__text", *["__open"] * partly).mapInPandas(run, "__doc long, low long, whole long, begin int, n int")


def single_windows(texts: DataFrame, length: int) -> DataFrame:
    """(__doc, one, two, at): 128 bits of hash of every window in the ranges listed per text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two = Hasher(1), Hasher(0x51ED270B9F3C62A7)
        for pdf in batches:
            for doc, text, lists in zip(pdf["__doc"], pdf["__text"], pdf["__open"], strict=True):
                codes = _codes(text)
                at = np.unique(np.concatenate([np.arange(x["begin"], x["begin"] + x["n"]) for x in lists]))
                at = at[at + length <= len(codes)]
                a, b = one.of(one.sums(codes), at, at + length), two.of(two.sums(codes), at, at + length)
                yield pd.DataFrame({"__doc": doc, "one": _signed(a), "two": _signed(b), "at": at.astype(np.int32)})

    return texts.select("__doc", "__text", "__open").mapInPandas(run, "__doc long, one long, two long, at int")


def _elsewhere(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand in two different documents, and a place in each of two such: an aggregate of fixed size, combined before the shuffle."""
    place = F.struct("__doc", "begin")
    return rows.groupBy(*keys).agg(F.min(place).alias("__a"), F.max(place).alias("__b")).where("__a.__doc <> __b.__doc")


def _witnessed(rows: DataFrame, size) -> DataFrame:
    """(__doc, begin, size, wdoc, wbegin): rows with their key's two places, each with the one in another document."""
    other = F.when(F.col("__a.__doc") != F.col("__doc"), F.col("__a")).otherwise(F.col("__b"))
    return rows.select("__doc", "begin", size.cast("int").alias("size"), other["__doc"].alias("wdoc"), other["begin"].alias("wbegin"))


def settle(groups: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(intervals of the groups that stand elsewhere as a whole, groups still open per document)."""
    # few groups share their minimum: those are kept in the shared folder, as they are read several times
    live = checkpointed(groups.join(_elsewhere(groups, "low").select("low"), "low", "left_semi"))
    marked = live.join(_elsewhere(live, "low", "whole"), ["low", "whole"], "left")
    whole = _witnessed(marked.where("__a is not null"), F.col("n") - 1 + length)
    # the rest is compared with two of each settled kind of the same minimum; a document's groups are bounded by its own text
    unsettled = marked.where("__a is null")
    stand_in = marked.where("__doc in (__a.__doc, __b.__doc)").join(unsettled.select("low").distinct(), "low", "left_semi")
    rest = unsettled.unionByName(stand_in).groupBy("__doc").agg(F.collect_set(F.struct("begin", "n")).alias("__open"))
    return whole, rest


def joined_runs(windows: DataFrame, length: int) -> DataFrame:
    """Witnessed windows of one document, side by side in both texts, as one interval each."""
    shift = F.col("wbegin") - F.col("begin")
    w = Window.partitionBy("__doc", "wdoc", "shift").orderBy("begin")  # windows of one document
    d = windows.withColumn("shift", shift).withColumn("run", F.col("begin") - F.row_number().over(w))
    return d.groupBy("__doc", "wdoc", "shift", "run").agg(F.min("begin").alias("begin"), F.max("begin").alias("__last")).select("__doc", "begin", (F.col("__last") - F.col("begin") + length).cast("int").alias("size"), "wdoc", (F.col("begin") + F.col("shift")).cast("int").alias("wbegin"))


def verified(intervals: DataFrame, texts: DataFrame) -> DataFrame:
    """The intervals whose text is that of their witness, character by character."""
    there = texts.select(F.col("__doc").alias("wdoc"), F.col("__text").alias("__there"))
    d = intervals.join(there, "wdoc").withColumn("__said", F.substring("__there", F.col("wbegin") + 1, F.col("size"))).drop("__there")
    return d.join(texts, "__doc").where(F.substring("__text", F.col("begin") + 1, F.col("size")) == F.col("__said")).select("__doc", "begin", (F.col("begin") + F.col("size")).alias("end"))


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, shared_chars) of the documents with a span of ``length`` code points or more that another holds too."""
    texts = documents.select(F.col(key).cast("long").alias("__doc"), F.col(text).alias("__text")).where("__doc is not null").where(F.length("__text") >= length)
    wide, rest = settle(window_groups(texts, length, max(1, length // GRAM)), length)
    narrow, rest = settle(window_groups(texts.join(rest, "__doc"), length, max(1, length - FINE)), length)
    singles = checkpointed(single_windows(texts.join(rest, "__doc"), length).withColumnRenamed("at", "begin"))
    single = joined_runs(_witnessed(singles.join(_elsewhere(singles, "one", "two"), ["one", "two"]), F.lit(length)), length)
    covered = verified(wide.unionByName(narrow).unionByName(single), texts)
    w = Window.partitionBy("__doc").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.coalesce(F.max("end").over(w), F.lit(0)), F.col("begin")))
    out = covered.select("__doc", fresh.alias("__fresh")).groupBy("__doc").agg(F.sum("__fresh").cast("long").alias("shared_chars"))
    return out.select(F.col("__doc").alias(key), "shared_chars")
