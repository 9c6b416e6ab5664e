"""Row texts that hold text of a page's frame, by a linear-chain conditional random field over their words.

A row text has no DOM blocks left, so its words are the chain: labels frame and
row, features the words around each place.  The training rows are made from the
training pages of the main-body field: what it labels frame (menus, trails,
notices, sharing, footers; not teasers, which are links and sentences as any)
is put before, after or in place of what it labels body, and cut as row texts
are.  Decoding runs in numpy over whole batches.

Defined results: null and empty texts hold nothing; one word of the frame counts
where it is the whole text; ties go to the row; rows repeated with one id give
one row.
"""

from __future__ import annotations

import random
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.boilerplate import Model, block_hash, fitted, model_key, sampled
from gleaner.llm.crf import Field
from gleaner.llm.pages import Block

#: Longest row text, in characters (as crawls record it), made training rows per page, and places around a word that count.
WIDTH, ROWS, AROUND = 160, 3, (-3, -2, -1, 0, 1, 2, 3)
#: Pages they are made from, at most.
SAMPLE = 1500
#: A word is known from so many training places on.
OFTEN = 3
STEPS, RATE, DECAY = 90, 0.25, 2e-5
_STEPS = ("›", "»", ">", "/", "|", "·")
_TRIM = re.compile(r"^\W+|\W+$")


def _shape(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "#." if word[-1] in ".,;:" else "#"
    bare = _TRIM.sub("", word)
    if not bare:
        return word if len(word) == 1 else "--"
    kind = "AA" if bare.isupper() and len(bare) > 1 else "Aa" if bare[0].isupper() else "aa"
    return kind + (word[-1] if word[-1] in ".,;:" else "")


def _known(word: str) -> str:
    return word if not any(c.isdigit() for c in word) else _shape(word)


def made_rows(known: list[tuple[list[Block], frozenset[int]]], model: Model, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Training rows: (words, 1 for those of the frame)."""
    rng = random.Random(seed)
    out = []
    for page, common in known:
        body = {id(b) for b in model.body_of(page, common)}
        level, frames, menu = 0, [], []
        for b in page:
            if b.tags[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                level = int(b.tags[-1][1])
            if id(b) in body or b.tags[-1] == "button":
                continue
            links = b.hrefs and b.linked >= 0.8 * len(b.text)
            if level >= 4 and not (links and all(h.rstrip("/").count("/") <= 3 for h in b.hrefs)) and block_hash(b.text) not in common:
                continue  # a teaser
            (menu if links and b.text.count(" ") < 4 else frames).append(b.text)
        rows = [b.text for b in page if id(b) in body and b.tags[-1] not in ("h1", "h2", "h3")]
        if not rows:
            continue
        linked = [b.text for b in page if b.hrefs and b.tags[-1] in ("li", "td", "p") and b.text not in menu and b.text not in frames]
        sentences = [t for t in rows if t.count(" ") > 8]

        def frame() -> list[str]:
            if menu and (not frames or rng.random() < 0.5):  # noqa: B023
                some = [rng.choice(menu) for _ in range(rng.randint(2, 5))]  # noqa: B023
                if rng.random() < 0.5:
                    return " ".join(some).split()
                return [w for k, x in enumerate(some) for w in [*([rng.choice(_STEPS)] if k else []), *x.split()]]
            return " ".join(rng.choice(frames) for _ in range(rng.randint(1, 2))).split()  # noqa: B023

        for _ in range(ROWS):
            row = rng.choice(linked or rows).split()  # noqa: B023
            if rng.random() < 0.5:  # names are written with all kinds of marks between their parts, and are cut
                mark = rng.choice([*_STEPS, "-", "–", ":"])
                for _ in range(rng.randint(1, 2)):
                    row.insert(rng.randint(1, len(row)), mark)
                row = row[: rng.randint(1, len(row))] if rng.random() < 0.3 else row
            if sentences and rng.random() < 0.4:
                row += rng.choice(sentences).split()
            kind = rng.random() if menu or frames else 1.0
            before = frame() if kind < 0.25 or 0.45 <= kind < 0.55 else []
            after = frame() if 0.25 <= kind < 0.45 else []
            if 0.45 <= kind < 0.55:
                row = []
            words, labels = [*before, *row, *after], [1] * len(before) + [0] * len(row) + [1] * len(after)
            size = 0
            for k, w in enumerate(words):
                size += len(w) + 1
                if size > WIDTH:
                    words, labels = words[: k + 1], labels[: k + 1]
                    break
            if words:
                out.append((words, labels))
    return out


class WordField:
    """The trained field as tables over words: one row per known word or shape, one column per place around."""

    def __init__(self, field: Field, vocabulary: set[str]):
        self.field, self.vocabulary = field, vocabulary
        self.codes: dict[str, int] = {w: i + 1 for i, w in enumerate(sorted(vocabulary))}  # 0: outside the text
        self.cache: dict[str, int] = {}
        get = field.table.get
        self.weights = np.zeros((len(AROUND), len(self.codes) + 2))
        for j, d in enumerate(AROUND):
            for w, k in self.codes.items():
                self.weights[j, k] = get(f"{d}={w}", 0.0)
            self.weights[j, 0] = get(f"{d}=", 0.0)
        self.bias = get("bias", 0.0)

    def __reduce__(self):
        return WordField, (self.field, self.vocabulary)

    def code(self, word: str) -> int:
        if (k := self.cache.get(word)) is None:
            if len(self.cache) > 500_000:  # a memory bound without effect on results
                self.cache.clear()
            k = self.cache[word] = self.codes.get(_known(word)) or self.codes.get(_shape(word)) or len(self.codes) + 1
        return k

    def framed(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text holds words of a frame."""
        out = np.zeros(len(texts), dtype=bool)
        rows = [(i, list(map(self.code, w))) for i, t in enumerate(texts) if t and (w := t.split())]
        if not rows:
            return out
        rows.sort(key=lambda r: len(r[1]))
        for begin in range(0, len(rows), 4096):  # texts of like lengths together
            part = rows[begin : begin + 4096]
            sizes = np.array([len(r[1]) for r in part])
            wide, pad = int(sizes[-1]), max(map(abs, AROUND))
            codes = np.zeros((len(part), wide + 2 * pad), dtype=np.int64)
            for k, (_, c) in enumerate(part):
                codes[k, pad : pad + len(c)] = c
            x = np.full((len(part), wide), self.bias)
            for j, d in enumerate(AROUND):
                x += self.weights[j][codes[:, pad + d : pad + d + wide]]
            labels = self._decode(x, sizes)
            count = labels.sum(axis=1)
            out[[i for i, _ in part]] = (count >= 2) | ((count == sizes) & (count > 0))
        return out

    def _decode(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        (m00, m01), (m10, m11) = self.field.moves
        n, wide = x.shape
        zero, one = np.zeros(n), x[:, 0].copy()
        back = np.zeros((2, n, wide), dtype=bool)
        live = np.arange(wide) < sizes[:, None]
        for k in range(1, wide):
            to0, to1 = one + m10 > zero + m00, one + m11 > zero + m01
            back[0, :, k], back[1, :, k] = to0, to1
            nz, no = np.where(to0, one + m10, zero + m00), np.where(to1, one + m11, zero + m01) + x[:, k]
            on = live[:, k]
            zero, one = np.where(on, nz, zero), np.where(on, no, one)
        labels = np.zeros((n, wide), dtype=bool)
        now = one > zero
        for k in range(wide - 1, -1, -1):
            on = live[:, k]
            labels[:, k] = now & on
            now = np.where(on, np.where(now, back[1, :, k], back[0, :, k]), now) if k else now
        return labels


def fit_words(known: list[tuple[list[Block], frozenset[int]]], model: Model) -> WordField:
    """A word field of the training pages of ``model``."""
    rows = made_rows(known, model)
    often: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            often[_known(w)] = often.get(_known(w), 0) + 1
    shapes = {"#", "#.", "--", "AA", "Aa", "aa", *(k + e for k in ("AA", "Aa", "aa") for e in ".,;:")}
    vocabulary = {w for w, n in often.items() if n >= OFTEN} | shapes
    sequences = []
    for words, labels in rows:
        names = [w if (w := _known(x)) in vocabulary else _shape(x) for x in words]
        at = lambda k, names=names: names[k] if 0 <= k < len(names) else ""
        sequences.append(([["bias", *(f"{d}={at(k + d)}" for d in AROUND)] for k in range(len(names))], labels))
    return WordField(Field.train(sequences, steps=STEPS, rate=RATE, decay=DECAY), vocabulary)


_WORDS: OrderedDict[tuple, WordField] = OrderedDict()


def fitted_both(pages: DataFrame) -> tuple[Model, WordField]:
    """The block and word fields of ``pages`` (with ``common``), fitted once for the files they are read from and kept by the driver."""
    key = model_key(pages)
    if not key[1] or key not in _WORDS:
        known = sampled(pages, SAMPLE)
        _WORDS[key] = fit_words(known, fitted(pages, known))
        while len(_WORDS) > 4:
            _WORDS.popitem(last=False)
    return fitted(pages), _WORDS[key]


def framed_contexts(candidates: DataFrame, words: WordField, key: str = "cand_id", context: str = "context") -> DataFrame:
    """(kind, id, block_md5): the rows whose text holds text of a page's frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[words.framed(pdf["text"].tolist())]}, dtype="int64")

    rows = candidates.where(F.col(key).isNotNull() & (F.col(context) != "")).select(F.col(key).cast("long").alias("id"), F.col(context).alias("text"))
    found = rows.mapInPandas(run, "id long").distinct()
    return found.select(F.lit("context").alias("kind"), "id", F.lit("").alias("block_md5"))
