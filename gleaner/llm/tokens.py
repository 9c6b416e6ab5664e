"""Encode a whole corpus with a public byte-level BPE, reusing content-defined chunks.

Texts are cut where a rolling hash of the last 16 bytes hits.  A cut stands as it
is where encoding its two sides apart gives exactly the ids of encoding them
together: between a visible character and white space, or where letters, digits
and punctuation meet, a token always ends.  Elsewhere the join is repaired: what
stands between the last such place before the cut and the first after it is
taken out of both chunks and encoded as one.

Chunks that stand in several documents are encoded once for the whole corpus:
their hashes are counted (combined before the shuffle), the first document that
has one encodes it, and its ids travel to the others that have it, as one list
per document, bounded by the document's own chunks.  All other chunks are encoded
where they stand, those that come again in the batch once, and the pieces of
chunks once as long as the Python worker lives.  Chunks, pieces and ids are
handled as Arrow dictionaries and numpy gathers; Python sees new pieces only.

Defined results: null and empty texts give an empty list; special tokens'
strings in a text are ordinary text; repeated rows give repeated rows; rows with
a null key are encoded by themselves; other columns are not passed through.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import written

#: The public pattern that splits text before the merges of the rank file (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: About one byte in CUT_EVERY ends a chunk.
CUT_EVERY = 512
#: Bytes from which a chunk is worth sharing; shorter ones are encoded where they stand.
SHARED_BYTES = 96
#: Pieces a worker keeps; beyond, it starts again (a memory bound without effect on results).
KEEP_PIECES = 1 << 19
#: Rows, and about bytes of text, handled at once.
ROWS, BYTES = 4000, 1 << 23

_TABLE = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_OPEN, _SPACE, _LETTER, _DIGIT, _PUNCT = range(5)  # next to an open byte nothing is known
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = _SPACE
_CLASS[list(range(65, 91)) + list(range(97, 123))] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = _PUNCT
_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder(dict):
    """Bytes of a piece -> its ids, int32 as bytes."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN):
        import tiktoken

        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._encode = self.bpe._core_bpe.encode_ordinary

    def __missing__(self, piece: bytes) -> bytes:
        ids = self[piece] = array("i", self._encode(piece.decode("utf-8"))).tobytes()
        return ids


def token_ends(data: np.ndarray) -> np.ndarray:
    """Whether a token surely ends before each byte, whatever stands around."""
    kind = _CLASS[data]
    a, c = kind[:-1], kind[1:]
    ends = np.zeros(len(data), dtype=bool)
    ends[1:] = (a > _SPACE) & (c != _OPEN) & (a != c) & ~((data[:-1] == 39) & (c == _LETTER))
    return ends


def hash_hits(data: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the 16 bytes before hits."""
    h, step, power = _TABLE[data], 1, 0x9E3779B1
    for _ in range(4):  # windows of 2, 4, 8, 16 bytes by doubling
        g = h.copy()
        g[step:] += h[:-step] * np.uint32(power)
        h, step, power = g, step * 2, power * power & 0xFFFFFFFF
    hits = np.zeros(len(data), dtype=bool)
    hits[1:] = ((h[:-1] >> np.uint32(9)) & np.uint32(CUT_EVERY - 1)) == 0
    return hits


def chunk_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin and end: at the texts' ends and at every hit, or on both sides of the join that a hit needs."""
    ends = np.zeros(len(data) + 1, dtype=bool)
    ends[:-1] = token_ends(data)
    ends[offsets] = True
    places, hits = np.flatnonzero(ends), np.flatnonzero(hash_hits(data))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[places[np.searchsorted(places, hits)]] = edge[places[np.searchsorted(places, hits, "right") - 1]] = True
    return np.flatnonzero(edge)


def _slices(data: np.ndarray, bounds: np.ndarray) -> pa.DictionaryArray:
    """The distinct byte strings between ``bounds``, and which one each is."""
    array_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return array_.dictionary_encode()


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after another, and their sizes."""
    n = sizes[which]
    ends = np.cumsum(n)
    places = np.arange(ends[-1] if len(ends) else 0)
    places += np.repeat(starts[which] - (ends - n), n)
    return values[places], n


def _parts(d: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = d.dictionary
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[: len(raw) + 1]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[: bounds[-1]] if buffer else np.zeros(0, np.uint8)
    return data, bounds, d.indices.to_numpy()


def _digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def encode_pieces(encoder: Encoder, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chunks data[bounds[i]:bounds[i+1]] one after another, and where each begins."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[:-1] = token_ends(data)
    edge[bounds] = True
    piece_bounds = np.flatnonzero(edge)
    distinct = _slices(data, piece_bounds)
    if len(encoder) > KEEP_PIECES:
        encoder.clear()
    ids = list(map(encoder.__getitem__, distinct.dictionary.to_pylist()))
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    values = np.frombuffer(b"".join(ids), dtype=np.int32)
    values, n = _gather(values, np.cumsum(sizes) - sizes, sizes, distinct.indices.to_numpy())
    total = np.concatenate([[0], np.cumsum(n)])
    return values, total[np.searchsorted(piece_bounds, bounds)]


def encode_buffer(encoder: Encoder, data: np.ndarray, offsets: np.ndarray, given: dict[bytes, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts data[offsets[i]:offsets[i+1]] one after another, and how many each has.  ``given``: ids of chunks by their digest."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    bounds = chunk_bounds(data, offsets)
    chunks = _slices(data, bounds)
    chunk_data, own_bounds, chunk_of = _parts(chunks)
    held: dict[int, np.ndarray] = {}
    if given:
        for i in np.flatnonzero(np.diff(own_bounds) >= SHARED_BYTES).tolist():
            if (ids := given.get(_digest(chunk_data[own_bounds[i] : own_bounds[i + 1]].tobytes()))) is not None:
                held[i] = ids
    if held:
        fresh = np.setdiff1d(np.arange(len(own_bounds) - 1), np.fromiter(held, dtype=np.int64))
        part, n = _gather(chunk_data, own_bounds[:-1], np.diff(own_bounds), fresh)
        values, starts = encode_pieces(encoder, part, np.concatenate([[0], np.cumsum(n)]))
        begin, size = np.zeros(len(own_bounds) - 1, np.int64), np.zeros(len(own_bounds) - 1, np.int64)
        begin[fresh], size[fresh] = starts[:-1], np.diff(starts)
        lengths = np.array([len(x) for x in held.values()], dtype=np.int64)
        at = list(held)
        begin[at], size[at] = len(values) + np.cumsum(lengths) - lengths, lengths
        values = np.concatenate([values, *held.values()])
    else:
        values, starts = encode_pieces(encoder, chunk_data, own_bounds)
        begin, size = starts[:-1], np.diff(starts)
    values, n = _gather(values, begin, size, chunk_of)
    total = np.concatenate([[0], np.cumsum(n)])
    return values, np.diff(total[np.searchsorted(bounds, offsets)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and where each begins."""
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def encode_batch(encoder: Encoder, texts: pa.Array, given: dict[bytes, np.ndarray] | None = None) -> pa.ListArray:
    data, offsets = _bytes(texts)
    values, sizes = encode_buffer(encoder, data, offsets, given)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ROWS rows, and of BYTES of text unless one row has more."""
    sizes = np.fromiter((n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()), dtype=np.int64, count=batch.num_rows)
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (i - begin >= ROWS or held + n > BYTES):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _encoder(ranks: str, pattern: str) -> Encoder:
    if (encoder := _ENCODERS.get((ranks, pattern))) is None:
        encoder = _ENCODERS[ranks, pattern] = Encoder(ranks, pattern)
    return encoder


def _chunk_digests(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(digests of all chunks worth sharing, the text of each), each once a text."""
    data, offsets = _bytes(texts)
    if not len(data):
        return [], np.zeros(0, np.int64)
    bounds = chunk_bounds(data, offsets)
    long = np.flatnonzero(np.diff(bounds) >= SHARED_BYTES)
    raw = data.tobytes()
    digests = [_digest(raw[bounds[i] : bounds[i + 1]]) for i in long.tolist()]
    return digests, np.searchsorted(offsets, bounds[long], "right") - 1


def chunk_places(rows: DataFrame) -> DataFrame:
    """(__doc, h1, h2): the digest of every chunk worth sharing, once a text.  ``rows``: __doc, __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch):
                digests, owner = _chunk_digests(part.column(1))
                h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                _, first = np.unique(np.column_stack([owner, h]), axis=0, return_index=True) if len(h) else (None, np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[first])), pa.array(h[first, 0]), pa.array(h[first, 1])], names=["__doc", "h1", "h2"])

    return rows.mapInArrow(run, f"__doc {rows.schema['__doc'].dataType.simpleString()}, h1 long, h2 long")


def owned_ids(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(h1, h2, ids) of the chunks that each text owns.  ``rows``: __doc, __text, wanted array<struct<h1, h2>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in _portions(batch):
                flat = part.column(2).flatten()
                wanted = set(map(bytes, np.column_stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()]).view("V16").ravel())) if len(flat) else set()
                data, offsets = _bytes(part.column(1))
                bounds = chunk_bounds(data, offsets) if len(data) else np.zeros(1, np.int64)
                raw, held = data.tobytes(), {}
                for i in np.flatnonzero(np.diff(bounds) >= SHARED_BYTES).tolist():
                    chunk = raw[bounds[i] : bounds[i + 1]]
                    d = _digest(chunk)
                    if d in wanted and d not in held:
                        held[d] = chunk
                sizes = np.array([len(c) for c in held.values()], dtype=np.int64)
                values, starts = encode_pieces(encoder, np.frombuffer(b"".join(held.values()), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
                h = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))], names=["h1", "h2", "ids"])

    return rows.mapInArrow(run, "h1 long, h2 long, ids array<int>")


def shared_ids(rows: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(__doc, given): for each document that has chunks of others, their ids, encoded once in the corpus."""
    places = written(chunk_places(rows).where("__doc is not null"))
    shared = places.groupBy("h1", "h2").agg(F.min("__doc").alias("owner"), F.max("__doc").alias("__other")).where("owner <> __other").drop("__other")
    both = written(places.join(shared, ["h1", "h2"]))  # the chunks that stand in several documents, a fraction of all
    wanted = both.where("owner = __doc").groupBy("__doc").agg(F.collect_set(F.struct("h1", "h2")).alias("wanted"))  # a document's own chunks
    ids = owned_ids(rows.join(wanted, "__doc"), ranks, pattern).groupBy("h1", "h2").agg(F.first("ids").alias("ids"))
    return both.join(ids, ["h1", "h2"]).groupBy("__doc").agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("given"))


def _given(column: pa.Array) -> dict[bytes, np.ndarray]:
    flat = column.flatten()
    if not len(flat):
        return {}
    h = np.column_stack([flat.field("h1").to_numpy(), flat.field("h2").to_numpy()])
    lists = flat.field("ids")
    values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
    return {h[i].tobytes(): values[offsets[i] : offsets[i + 1]] for i in range(len(h))}


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(key, ids) of every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in _portions(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), encode_batch(encoder, part.column(1), _given(part.column(2)))], names=["__doc", "ids"])

    rows = documents.select(F.col(key).alias("__doc"), F.col(text).alias("__text"))
    kind = documents.schema[key].dataType.simpleString()
    out = rows.join(shared_ids(rows, ranks, pattern), "__doc", "left").mapInArrow(run, f"__doc {kind}, ids array<int>")
    return out.withColumnRenamed("__doc", key)
