"""Links that differ only in how they are written, and the number of copies of each.

Byte-identical rows are collapsed first, with their counts, so that only distinct
survivors are brought to canonical form, once (Python stands behind the first
shuffle, where no filter can pass it); these are then grouped on their full
canonical text, of whose hash 128 bits travel in its stead (a chance collision
among 10**12 links has a probability of about 10**-15), and their counts summed.
Both steps aggregate partially before their shuffle, and members find their group
by a join, never by collecting it; a link of which a third of all rows are copies
costs each row one probe.

Canonical form: percent-decoded (escapes that are no UTF-8 as Latin-1),
compatibility-composed, case-folded, letters and digits only; query parameters of
a url and ``|`` parts of a name in sorted order, empty ones left out.

Defined results: rows with a null url name no link and are left out; a null name
equals an empty one; an empty url is a link of its own; ties do not arise, as the
smallest id stands first; rows repeated with one id are one row; empty tables
give no rows; long texts are used whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.session import written

_OTHER = re.compile(r"[\W_]+")


def decoded(text: str) -> str:
    raw = unquote_to_bytes(text)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def plain(text: str) -> str:
    """Letters and digits of ``text``, decoded, composed and folded."""
    if "%" in text:
        text = decoded(text)
    if text.isascii():
        return _OTHER.sub("", text.lower())
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return _OTHER.sub("", text)


def _sorted(parts: list[str]) -> str:
    return "&".join(sorted(filter(None, map(plain, parts))))


def plain_url(url: str) -> str:
    head, _, query = url.partition("?")
    return f"{plain(head)}?{_sorted(query.split('&'))}" if query else f"{plain(head)}?"


def plain_name(name: str | None) -> str:
    if not name:
        return ""
    return _sorted(name.split("|")) if "|" in name else plain(name)


def canonical_url(url: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else plain_url(x))

    return F.pandas_udf(run, StringType())(url)


def with_link_key(rows: DataFrame, url: str, name: str | None) -> DataFrame:
    """``rows`` with ``k1`` and ``k2``: 128 bits of hash of the canonical url, and of the canonical name where one is given."""
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column(batch.schema.get_field_index(url)).to_pylist()
            names = batch.column(batch.schema.get_field_index(name)).to_pylist() if name else [None] * len(links)
            digests = [xxhash.xxh3_128_digest(f"{plain_url(u or '')}|{plain_name(c)}".encode("utf-8", "surrogatepass")) for u, c in zip(links, names, strict=True)]
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both[:, 0]), pa.array(both[:, 1])], names=[*batch.schema.names, "k1", "k2"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{out}, k1 long, k2 long")


def link_survivors(rows: DataFrame, key: str, url: str, name: str) -> DataFrame:
    """One row per byte-identical url and name: (__url, __name, __n, __first, r1, r2, k1, k2), r1 and r2 a hash of the raw texts."""
    raw = _raw(rows, key, url, name)
    survivors = raw.groupBy("__url", "__name").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"), F.first("r1").alias("r1"), F.first("r2").alias("r2"))
    return with_link_key(survivors, "__url", "__name")


def _raw(rows: DataFrame, key: str, url: str, name: str) -> DataFrame:
    d = rows.where(F.col(url).isNotNull()).select(F.col(key).alias("__id"), F.col(url).alias("__url"), F.coalesce(name, F.lit("")).alias("__name"))
    return d.withColumns({"r1": F.xxhash64("__url", "__name"), "r2": F.xxhash64("__name", F.lit("|"), "__url")})


def link_records(rows: DataFrame, key: str = "cand_id", url: str = "url", name: str = "name") -> DataFrame:
    """One record per link: (first_<key>, url, name, copies), written as the first row has them."""
    survivors = link_survivors(rows, key, url, name)
    groups = survivors.groupBy("k1", "k2").agg(F.sum("__n").alias("copies"), F.min(F.struct("__first", "__url", "__name")).alias("f"))
    return groups.select(F.col("f.__first").alias(f"first_{key}"), F.col("f.__url").alias("url"), F.col("f.__name").alias("name"), "copies")


def link_copies(rows: DataFrame, key: str = "cand_id", url: str = "url", name: str = "name") -> DataFrame:
    """(first_<key>, <key>): every copy after the first of its link."""
    survivors = written(link_survivors(rows, key, url, name).select("k1", "k2", "r1", "r2", "__first", "__n"))
    groups = survivors.groupBy("k1", "k2").agg(F.min("__first").alias("first_id"), F.sum("__n").alias("copies")).where("copies > 1")
    place = survivors.join(groups.select("k1", "k2", "first_id"), ["k1", "k2"])
    own = place.where("__first <> first_id").select("first_id", F.col("__first").alias("__id"))
    # rows that are byte-identical to a survivor, other than its first
    again = place.where("__n > 1").select("r1", "r2", "first_id", "__first")
    more = _raw(rows, key, url, name).select("__id", "r1", "r2").join(again, ["r1", "r2"]).where("__id <> __first").select("first_id", "__id").distinct()
    return own.unionByName(more).select(F.col("first_id").alias(f"first_{key}"), F.col("__id").alias(key))
