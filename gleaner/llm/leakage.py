"""Find held-out passages that stand, wholly or partly, in corpus documents, say where, and remove the documents.

Each portion of documents is a shard with a suffix array over its words: words
become ids of the passages' vocabulary, positions whose word pair stands in no
passage are left out (no suffix of a passage can match there), and the suffixes
of the others are sorted by doubling, together with those of the passages.
Every passage suffix is binary-searched in that order: equal ranks at each
doubled length give the documents' ranges that share 2, 4, 8, ... words with it,
and so the longest verbatim matches and their places.

A verbatim match alone is no leak, as words may be changed: an alignment of
score s has at most one break for each word of its price, so at least s - 1 of
its matched words follow the one before on both sides.  Where a document has
fewer common word pairs with a passage than the least score asks for, there is
none.  For all others an exact local alignment decides: it counts the passage's
words found in order, pays for changed, missing and added words, and takes a
put-in sentence at a fixed price, however long it is (what ends no sentence may
have :data:`INSERT` words).  Long documents are aligned
in overlapping stretches, wide enough for the widest place that an alignment can
have given the document's own longest sentence.

The passages are the small side (held-out sets do not grow with the corpus);
they are sent to the executors once if they have at most :data:`BLOCK_BYTES`,
else in blocks of that size, each checked against all documents, so the bound
holds for any number of passages.

Defined results: null, empty and wordless texts, on either side, match nothing;
fewer than ``SEED`` words, in a passage or found of it, are no leak; repeated rows give one pair; ties of
alignments do not matter, as only the best score counts; of longest matches the
first in the document and then in the passage is given.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewest words of a passage that is looked for, and of it that must be found.
SEED = 4
#: Share of the passage's words that must stand in order, and least alignment score as a share of them.
SHARE, SCORE = 0.5, 0.4
#: Price of a put-in sentence, in words; what is put in need not end a sentence if it has at most INSERT words.
INSERT, PRICE = 45, 2
#: Entries of the lists of common pairs, and of their counts, held at once.
ENTRIES = 1 << 21
#: Bytes of passages sent to the executors at once, and about characters of documents in a shard (one document is not cut).
BLOCK_BYTES, SHARD_CHARS = 64 << 20, 4 << 20

_DROP = re.compile(r"[^\w\s]+|_+")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*$")
_ASCII_DROP = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
_UNIT = 4096  # an alignment cell is score * _UNIT + matched words


def words(text: str | None) -> list[str]:
    """Words apart from case, compatibility form and punctuation (which is dropped, also inside numbers)."""
    if not text:
        return []
    if text.isascii():
        return text.encode().lower().translate(None, _ASCII_DROP).decode().split()
    return _DROP.sub("", unicodedata.normalize("NFKC", text).casefold()).split()


def sentences(text: str) -> list[int]:
    """The number of sentence ends before each word of :func:`words`."""
    out, n = [], 0
    for token in (text if text.isascii() else unicodedata.normalize("NFKC", text)).split():
        if _DROP.sub("", token.casefold()):
            out.append(n)
        n += bool(_END.search(token))
    return out


class Passages:
    """A block of passages, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        kept = [(key, w) for key, w in ((key, words(text)) for key, text in rows) if len(w) >= SEED]
        self.keys = [key for key, _ in kept]
        self.ids: dict[str, int] = {}
        self.texts = [np.array([self.ids.setdefault(x, len(self.ids)) for x in w], dtype=np.int64) for _, w in kept]
        self.base = len(self.ids) + 2
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        # all passages in one row, -1 between them; for each distinct pair its passages
        self.row = np.concatenate([np.append(t, -1) for t in self.texts]) if self.texts else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        key, at = self.pairs(self.row)
        owner = np.repeat(np.arange(len(self.texts)), self.sizes + 1)[at]
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        self.unique, self.lists = np.unique(key[order], return_index=True)
        self.lists = np.append(self.lists, len(order))
        # each passage's distinct pairs as one sorted list
        self.members = np.unique(self.owner * max(1, len(self.unique)) + np.repeat(np.arange(len(self.unique)), np.diff(self.lists)))

    def pairs(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of adjacent known words as numbers, and where they stand."""
        at = np.flatnonzero((row[:-1] >= 0) & (row[1:] >= 0))
        return row[at] * self.base + row[at + 1], at


class SuffixArray:
    """The suffixes of a shard's row that begin with a word pair of some passage, in order, beside those of the passages.

    ``levels[k]`` holds, for each place of the joint row (shard, then passages), the rank of its first 2**(k+1) words among
    all live ones, 0 where a passage cannot match that far.
    """

    def __init__(self, p: Passages, row: np.ndarray, live: np.ndarray):
        self.size = len(row)
        joint = np.concatenate([row, p.row])
        _, own = p.pairs(p.row)
        at = np.concatenate([live, own + self.size])
        key = joint[at] * p.base + joint[at + 1]
        full = np.zeros(len(joint) + 1, dtype=np.int64)  # ranks by as many words as can match
        full[at] = np.unique(key, return_inverse=True)[1] + 1
        self.levels, step, longest = [full], 2, int(p.sizes.max(initial=0))
        while step < longest:
            far = np.minimum(at + step, len(joint))
            both = full[at] * (int(full.max(initial=0)) + 1) + full[far]
            full = np.zeros_like(full)
            full[at] = np.unique(both, return_inverse=True)[1] + 1
            whole = (self.levels[-1][at] > 0) & (self.levels[-1][far] > 0)
            if not whole.any():
                break
            rank = np.zeros_like(full)
            rank[at[whole]] = full[at[whole]]
            self.levels.append(rank)
            step *= 2
        self.places = at[np.argsort(full[at], kind="stable")]  # the suffix array, passages included
        self.docs = self.places[self.places < self.size]

    def search(self, places: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document places by rank, lo, hi): where the passage suffixes at ``places`` of the joint row stand among the
        documents' suffixes, by binary search on the ranks of their first 2**(level+1) words."""
        ranks = self.levels[level]
        own = ranks[self.docs]
        order = np.argsort(own, kind="stable")
        held, ranked = self.docs[order], own[order]
        wanted = ranks[places]
        lo, hi = np.searchsorted(ranked, wanted, "left"), np.searchsorted(ranked, wanted, "right")
        return held, np.where(wanted > 0, lo, 0), np.where(wanted > 0, hi, 0)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at ``a`` and ``b`` of the joint row share, by the ranks from the longest length down."""
        n = np.zeros(len(a), dtype=np.int64)
        end = len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            x, y = rank[np.minimum(a + n, end)], rank[np.minimum(b + n, end)]
            n += np.where((x == y) & (x > 0), 2 << k, 0)
        # an odd word at the end: the pair that begins one word before the end of what is shared
        rank = self.levels[0]
        x, y = rank[np.minimum(a + n - 1, end)], rank[np.minimum(b + n - 1, end)]
        return n + ((n > 0) & (x == y) & (x > 0))


class _Sentences:
    """The sentences of the rows of a table of cells: for each cell its own, the last and the one before that."""

    def __init__(self, number: np.ndarray):
        new = np.ones_like(number, dtype=bool)
        new[:, 1:] = number[:, 1:] != number[:, :-1]
        self.begin = np.flatnonzero(new)
        self.own = (np.cumsum(new) - 1).reshape(number.shape)
        row = self.begin // number.shape[1]
        none = len(self.begin)  # what stands for no sentence
        seg = np.arange(none)
        back = [np.where((seg >= k) & (row[np.maximum(seg - k, 0)] == row), seg - k, none) for k in (1, 2)]
        self.last, self.before = back[0][self.own], back[1][self.own]

    def jumps(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the best of the two sentences before its own, or of the last INSERT words."""
        far, reach = cells.copy(), 1
        while reach * 2 <= INSERT:
            far[:, reach:] = np.maximum(far[:, reach:], far[:, :-reach])
            reach *= 2
        rest = INSERT - reach
        far[:, rest:] = np.maximum(far[:, rest:], far[:, : max(0, far.shape[1] - rest)])
        best = np.append(np.maximum.reduceat(cells.ravel(), self.begin), 0)
        return np.maximum(far, np.maximum(best[self.last], best[self.before])).astype(cells.dtype)


def align(passages: list[np.ndarray], places: list[np.ndarray], least: np.ndarray | None = None, ends: list[np.ndarray] | None = None) -> np.ndarray:
    """The best local alignment of each passage with its place, of those with ``least`` matched words, as score * _UNIT + matched words.

    ``ends``: the sentence of each word of a place; without it all is one sentence.
    """
    height, width = max(map(len, passages)), max(map(len, places))
    a = np.full((len(passages), height), -3, dtype=np.int32)
    w = np.full((len(places), width), -4, dtype=np.int32)
    s = np.zeros((len(places), width + 1), dtype=np.int64)
    for i, (x, y) in enumerate(zip(passages, places, strict=True)):
        a[i, : len(x)], w[i, : len(y)] = x, y
        if ends is not None and len(y):
            s[i, 0], s[i, 1 : len(y) + 1], s[i, len(y) + 1 :] = ends[i][0], ends[i], ends[i][-1]
    sentences_ = _Sentences(s)
    cells = np.zeros((len(a), width + 1), dtype=np.int32)
    best = np.zeros(len(a), dtype=np.int32)
    for k in range(height):
        step = np.where(w == a[:, k : k + 1], _UNIT + 1, -_UNIT)
        now = np.zeros_like(cells)
        np.maximum(cells[:, :-1] + step, cells[:, 1:] - _UNIT, out=now[:, 1:])
        now[now < _UNIT] = 0
        # words added in the place: one at a time, or a sentence at once
        far = sentences_.jumps(now)
        now[:, 1:] = np.maximum(now[:, 1:], now[:, :-1] - _UNIT)
        now[:, 1:] = np.maximum(now[:, 1:], far[:, :-1] - PRICE * _UNIT)
        now[now < _UNIT] = 0
        cells = now
        good = now if least is None else np.where(now % _UNIT >= least[:, None], now, 0)
        np.maximum(best, good.max(axis=1), out=best)
    return best


def upper_scores(passages: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """No less than the score of ``align``'s best alignments, in a fraction of the time: here any stretch may be put in at the price of a sentence."""
    height, width = max(map(len, passages)), max(map(len, places))
    kind = np.int8 if height < 120 else np.int16 if height < 30_000 else np.int32
    ids = np.int16 if max(int(x.max(initial=0)) for x in passages) < 30_000 else np.int32
    a = np.full((height, len(passages)), -3, dtype=ids)
    w = np.full((width, len(places)), -4, dtype=ids)
    for i, (x, y) in enumerate(zip(passages, places, strict=True)):
        a[: len(x), i], w[: len(y), i] = x, np.minimum(y, np.iinfo(ids).max)
    # places lie down the first axis, so that a running maximum works on whole rows
    cells, now = np.zeros((2, width + 1, len(passages)), dtype=kind)
    best = np.zeros_like(cells)
    one, far = kind(1), np.empty_like(cells)
    for k in range(height):
        same = (w == a[k]).view(np.int8)
        np.add(cells[:-1], same, out=now[1:])
        now[1:] += same
        now[1:] -= one
        now[0] = 0
        np.subtract(cells, one, out=cells)
        np.maximum(now, cells, out=now)
        np.maximum(now, 0, out=now)
        np.subtract(now, kind(PRICE), out=far)
        reach = 1
        while reach <= width:  # the running maximum by doubling
            far[reach:] = np.maximum(far[reach:], far[:-reach])
            reach *= 2
        np.maximum(far[:-1], now[:-1] - one, out=far[:-1])
        np.maximum(now[1:], far[:-1], out=now[1:])
        np.maximum(best, now, out=best)
        cells, now = now, cells
    return best.max(axis=0)


class Shard:
    """A portion of documents: their words as ids, the stretches they are searched in, and the suffix array over them."""

    def __init__(self, p: Passages, texts: list[str | None]):
        get = p.ids.get
        self.p, self.texts = p, texts
        self.rows = [np.array([get(w, -1) for w in words(text)], dtype=np.int64) for text in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in self.rows])]).astype(np.int64)
        self.row = np.concatenate([np.append(x, -1) for x in self.rows]) if self.rows else np.zeros(0, np.int64)
        key, at = p.pairs(self.row)
        which = np.searchsorted(p.unique, key)
        live = p.unique[np.minimum(which, max(0, len(p.unique) - 1))] == key if len(p.unique) else np.zeros(0, bool)
        self.live = at[live]
        self.known = np.searchsorted(self.offsets, self.live, "right") - 1  # the document of each live place
        self.array: SuffixArray | None = None

    def suffixes(self) -> SuffixArray:
        if self.array is None:
            self.array = SuffixArray(self.p, self.row, self.live)
        return self.array

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, begin, end) of overlapping stretches of the row, of documents with live places."""
        p = self.p
        docs, begins, ends = [], [], []
        for t in np.unique(self.known).tolist():
            n = len(self.rows[t])
            # an alignment loses at most 1 - SCORE of its passage, and for two words lost may take a put-in sentence
            longest = INSERT
            size = int(p.sizes.max())
            if n > 2 * size * (1 + (1 - SCORE) * max(1, INSERT / PRICE)):
                longest = max(INSERT, int(np.bincount(sentences(self.texts[t])).max(initial=0)) * 3)
            wide = int(size * (1 + (1 - SCORE) * max(1, longest / PRICE))) + 1
            for b in range(0, max(1, n - wide), wide):
                docs.append(t)
                begins.append(self.offsets[t] + b)
                ends.append(self.offsets[t] + min(n, b + 2 * wide))
        return np.array(docs, dtype=np.int64), np.array(begins, dtype=np.int64), np.array(ends, dtype=np.int64)

    def candidates(self) -> list[tuple[int, int, int, int]]:
        """(document, begin, end, passage) of stretches that share as many word pairs with a passage as the least score asks for."""
        p = self.p
        if not len(self.live) or not len(p.sizes):
            return []
        array = self.suffixes()
        own = np.unique(array.levels[0][array.size :], return_index=True)  # one suffix of the passages for each distinct pair
        own = own[1][own[0] > 0] + array.size
        held, lo, hi = array.search(own)
        size = hi - lo
        pair = np.searchsorted(p.unique, p.row[own - array.size] * p.base + p.row[own - array.size + 1])
        place = held[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        pair = np.repeat(pair, size)
        doc, begin, end = self.stretches()
        order = np.lexsort((pair, place))
        place, pair = place[order], pair[order]
        self.place, self.pair = place, pair
        first, last = np.searchsorted(place, begin, "left"), np.searchsorted(place, end - 1, "left")
        n = np.maximum(last - first, 0)
        part = np.repeat(np.arange(len(doc)), n)
        inside = pair[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.unique(part * len(p.unique) + inside)  # each distinct pair of each stretch once
        part, which = both // len(p.unique), both % len(p.unique)
        count = p.lists[which + 1] - p.lists[which]
        total = np.concatenate([[0], np.cumsum(count)])
        start = np.searchsorted(part, np.arange(len(doc) + 1))
        out: list[tuple[int, int, int, int]] = []
        i, most = 0, max(1, ENTRIES // len(p.sizes))
        while i < len(doc):  # some stretches at once, so that common pairs do not fill the memory
            j = min(i + most, max(i + 1, int(np.searchsorted(total[start], total[start[i]] + ENTRIES, "right")) - 1), len(doc))
            a, b = start[i], start[j]
            m = count[a:b]
            owner = p.owner[np.repeat(p.lists[which[a:b]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
            common = np.bincount(np.repeat(part[a:b] - i, m) * len(p.sizes) + owner, minlength=(j - i) * len(p.sizes)).reshape(j - i, -1)
            out += [(int(doc[i + x]), int(begin[i + x]), int(end[i + x]), int(o)) for x, o in np.argwhere((common > 0) & (common + 1 >= SCORE * p.sizes))]
            i = j
        return out

    def squeezed(self, tasks: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
        """The stretch of each task with only the words of pairs that it shares with the passage, one -5 for what is left out
        between two: an alignment scores no less in it, as leaving out costs a word at least."""
        p = self.p
        b, e, o = (np.array([t[i] for t in tasks], dtype=np.int64) for i in (1, 2, 3))
        first, last = np.searchsorted(self.place, b, "left"), np.searchsorted(self.place, e - 1, "left")
        n = np.maximum(last - first, 0)
        task = np.repeat(np.arange(len(tasks)), n)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        wanted = o[task] * len(p.unique) + self.pair[at]
        found = np.searchsorted(p.members, wanted)
        keep = p.members[np.minimum(found, len(p.members) - 1)] == wanted
        task, at = task[keep], self.place[at[keep]]
        gap = np.full(len(at), 1 << 30, dtype=np.int64)  # to the next pair of the same task
        same = task[1:] == task[:-1]
        gap[:-1][same] = (at[1:] - at[:-1])[same]
        size = 1 + (gap > 1) + (gap > 2)
        total = np.concatenate([[0], np.cumsum(size)])
        out = np.full(total[-1], -5, dtype=np.int64)
        out[total[:-1]] = self.row[at]
        loose = gap > 1
        out[total[:-1][loose] + 1] = self.row[at[loose] + 1]
        cuts = total[np.searchsorted(task, np.arange(len(tasks) + 1))]
        return [out[cuts[i] : cuts[i + 1]] for i in range(len(tasks))]

    def leaks(self) -> list[tuple[int, int]]:
        """(document, passage) of every leak, in order."""
        p = self.p
        tasks = sorted(self.candidates(), key=lambda x: (p.sizes[x[3]] // 8, x[2] - x[1]))  # of like sizes together
        left: list[tuple[int, int, int, int]] = []
        for k in range(0, len(tasks), 1024):
            some = tasks[k : k + 1024]
            short = self.squeezed(some)
            order = sorted(range(len(some)), key=lambda i: len(short[i]))
            while order:
                most = max(1, ENTRIES // (len(short[order[-1]]) + 2))
                part, order = order[-most:], order[: max(0, len(order) - most)]
                scores = upper_scores([p.texts[some[i][3]] for i in part], [short[i] for i in part])
                left += [some[i] for i, v in zip(part, scores.tolist(), strict=True) if v >= SCORE * p.sizes[some[i][3]]]
        ends: dict[int, np.ndarray] = {}
        found: set[tuple[int, int]] = set()
        left.sort(key=lambda x: x[2] - x[1])
        k = 0
        while k < len(left):
            some = left[k : k + 128]
            some = some[: max(1, ENTRIES // (int(some[-1][2] - some[-1][1]) + 2))]
            k += len(some)
            for t, *_ in some:
                if t not in ends:
                    ends[t] = np.array(sentences(self.texts[t]), dtype=np.int64)
            need = np.array([max(SEED, SHARE * p.sizes[o]) for *_, o in some])
            inside = [ends[t][b - self.offsets[t] : e - self.offsets[t]] for t, b, e, _ in some]
            best = align([p.texts[o] for *_, o in some], [self.row[b:e] for _, b, e, _ in some], need, inside)
            found |= {(t, o) for (t, _, _, o), v in zip(some, best.tolist(), strict=True) if v and v // _UNIT >= SCORE * p.sizes[o]}
        return sorted(found)

    def longest(self, t: int, o: int) -> tuple[int, int, int]:
        """(word of the document, word of the passage, words) of the longest verbatim match of a document and a passage."""
        array, p = self.suffixes(), self.p
        docs = self.live[self.known == t]
        own = np.arange(p.starts[o], p.starts[o] + p.sizes[o] - 1) + array.size
        rank = array.levels[0]
        order = np.argsort(rank[docs], kind="stable")
        held = docs[order]
        lo, hi = np.searchsorted(rank[held], rank[own], "left"), np.searchsorted(rank[held], rank[own], "right")
        n = hi - lo
        a = held[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        b = np.repeat(own, n)
        if not len(a):
            return 0, 0, 0
        m = array.common(a, b)
        k = min(range(len(a)), key=lambda i: (-m[i], a[i], b[i])) if len(a) < 1 << 12 else int(np.lexsort((b, a, -m))[0])
        return int(a[k] - self.offsets[t]), int(b[k] - array.size - p.starts[o]), int(m[k])


def search_shard(p: Passages, texts: list[str | None]) -> list[tuple[int, int]]:
    """(index of text, index of passage) of every leak in the shard."""
    return Shard(p, texts).leaks() if len(p.unique) else []


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most SHARD_CHARS characters, or of one text."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and held + n > SHARD_CHARS:
            yield begin, i
            begin, held = i, 0
        held += n
    if len(texts) > begin:
        yield begin, len(texts)


def leak_matches(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_key, item_key, doc_word, item_word, words): every leak, with its longest verbatim match: where it begins in the
    document and in the passage, counted in words, and how long it is."""
    spark = documents.sparkSession
    rows = items.select(item_key, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    kinds = [documents.schema[doc_key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    out = None
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(f"pmod(xxhash64(`{item_key}`), {blocks}) = {k}")
        held = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # about block_bytes

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            p = Passages(held.value)
            for pdf in batches:
                texts = [t if isinstance(t, str) else None for t in pdf["__text"]]
                keys = pdf["__doc"].to_numpy()
                for begin, end in _portions(texts):
                    if not len(p.unique):
                        continue
                    shard = Shard(p, texts[begin:end])
                    hits = [(keys[begin + t], p.keys[o], *shard.longest(t, o)) for t, o in shard.leaks()]
                    yield pd.DataFrame(hits, columns=["__doc", "__item", "doc_word", "item_word", "words"])

        found = documents.select(F.col(doc_key).alias("__doc"), F.col(text).alias("__text")).mapInPandas(run, f"__doc {kinds[0]}, __item {kinds[1]}, doc_word long, item_word long, words long")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("__doc", "__item").agg(F.max(F.struct("words", -F.col("doc_word"), -F.col("item_word"))).alias("b"))
    return best.select(F.col("__doc").alias(doc_key), F.col("__item").alias(item_key), (-F.col("b.col2")).alias("doc_word"), (-F.col("b.col3")).alias("item_word"), "b.words")


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_key, item_key) of every document that holds at least SHARE of a passage as one passage."""
    return leak_matches(documents, items, doc_key, item_key, text, block_bytes).select(doc_key, item_key)


def remove_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """``documents`` without those that hold a passage; rows with a null key stay unless their text holds one that is keyed elsewhere."""
    bad = find_leaks(documents, items, doc_key, item_key, text).select(doc_key).distinct()
    return documents.join(bad, doc_key, "left_anti")
