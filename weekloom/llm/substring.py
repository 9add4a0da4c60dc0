"""Exact substring deduplication on words by fixed-block anchors.

A window of ``width`` words that stands in two places covers, in either place, a whole block of
``(width + 1) // 2`` words whose start is a multiple of that length. So the non-overlapping blocks of
every document are the index, and every rolling window of block length is a probe:

1. documents are dealt into chunks of bounded size by a hash of their row and its place in the input, so that
   copies of one row are spread as well; per chunk the distinct rolling-block hashes, marked as indexed
   blocks and as repeated in the chunk, are packed and shuffled by hash bucket;
2. a bucket returns to each chunk the anchors: hashes of an indexed block with two or more places;
3. chunks extend their anchors to all windows around them and shuffle 95-bit digests of those windows
   by bucket; a digest with two or more places is a repeated window;
4. adjoining repeated windows merge into maximal exact repeats, whose words are removed.

A passage in a third of all documents is one hash per chunk, not one per place, so no bucket outgrows the
others and no pairs of places are made. The shuffled chunks of texts are one exchange that all steps
reuse. Buckets and chunks grow in number with the input, not in size.

Cases: a null text has no words; a text shorter than the window is kept whole; a text of any length is one
row and is read whole; equal ids and repeated rows are rows of their own, whose windows count as
standing elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import WordCache, byte_texts

CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)
_BUCKET_MIX = np.uint64(0xFF51AFD7ED558CCD)
_word_hashes = WordCache(xxhash.xxh3_64_intdigest)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _BUCKET_MIX
    return values ^ (values >> np.uint64(29))


class _Chunk:
    """The words of a chunk's documents in one row of hashes."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.begins = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        flat = map(_word_hashes.__getitem__, chain.from_iterable(self.words))
        self.hashes = np.fromiter(flat, np.uint64, total)

    def starts(self, width: int) -> np.ndarray:
        """Places where a window of ``width`` words begins and stays in its document."""
        room = np.maximum(0, self.sizes - width + 1)
        first = np.cumsum(room) - room
        return np.repeat(self.begins - first, room) + np.arange(int(room.sum()))

    def rolling(self, width: int, base: np.uint64) -> np.ndarray:
        """Hash of the ``width`` words from every place (those near the end of the row left out).

        By doubling: the hash of 2k words is that of k words and, scaled, of the k words behind.
        """
        # Arrays of one entry, since they wrap round silently.
        hashes, power = self.hashes, np.array([base])
        done: np.ndarray | None = None
        covered, step, scale = 0, 1, power
        while True:
            if width & step:
                part = hashes[covered:] if covered else hashes
                if done is None:
                    done, scale = part.copy(), power
                else:
                    n = min(len(done), len(part))
                    done = done[:n] + scale * part[:n]
                    scale = scale * power
                covered += step
            step *= 2
            if step > width:
                return _mixed(done)
            half = step // 2
            if len(hashes) <= half:
                hashes = hashes[:0]
            else:
                hashes = hashes[:-half] + power * hashes[half:]
            power = power * power


def _packed(buckets: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows of ``values`` per bucket; ``buckets`` ascending."""
    if not len(buckets):
        return [], []
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    return buckets[edges[:-1]].tolist(), [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values ascending, and whether each comes more than once."""
    ordered = np.sort(hashes)
    if not len(ordered):
        return ordered, np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered))) > 1


def _is_in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


_BLOCK, _MANY = np.uint32(2), np.uint32(1)


class _Plan:
    def __init__(self, width: int, bits: int):
        self.width, self.block, self.bits = width, (width + 1) // 2, bits

    def probes(self, chunk: _Chunk) -> tuple[list[int], list[bytes]]:
        starts = chunk.starts(self.block)
        hashes = chunk.rolling(self.block, _BASE)[starts] if len(starts) else np.zeros(0, np.uint64)
        # What is shuffled are the bucket and 30 bits: equal ones are made one here.
        kept = np.uint64(64 - self.bits - 30)
        begins = np.repeat(chunk.begins, np.maximum(0, chunk.sizes - self.block + 1))
        indexed = (starts - begins) % self.block == 0
        shorts = hashes >> kept
        distinct, many = _distinct(shorts)
        entry = (distinct & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2)
        entry |= np.where(_is_in(distinct, np.unique(shorts[indexed])), _BLOCK, 0).astype(np.uint32)
        entry |= np.where(many, _MANY, 0).astype(np.uint32)
        return _packed((distinct >> np.uint64(30)).astype(np.int64), entry)

    def candidates(self, chunk: _Chunk, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and digests of the windows that cover an anchor."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        starts = chunk.starts(self.width)
        if not len(starts) or not len(anchors):
            return none
        block_starts = chunk.starts(self.block)
        shorts = chunk.rolling(self.block, _BASE)[block_starts] >> np.uint64(64 - self.bits - 30)
        hit = np.zeros(len(chunk.hashes) + 1, np.int64)
        hit[block_starts[_is_in(shorts, anchors)] + 1] = 1
        seen = np.cumsum(hit)
        places = starts[seen[starts + self.width - self.block + 1] > seen[starts]]
        return places, *self.digests(chunk, places)

    def digests(self, chunk: _Chunk, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(places):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        second = chunk.rolling(self.width, _BASE2)[places] >> np.uint64(33)
        return chunk.rolling(self.width, _BASE)[places], second.astype(np.uint32)


_DIGEST = np.dtype([("a", np.uint64), ("b", np.uint32)])


def _digest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct digests in order, and whether each comes more than once."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    if not len(a):
        return a, b, np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[first], b[first], np.diff(np.append(first, len(a))) > 1


def _joined(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) for v in column]


def _rows(chunk: int, buckets: list[int], blobs: list[bytes]) -> pa.Table:
    columns = {"bucket": pa.array(buckets, pa.int64()), "chunk": pa.array([chunk] * len(blobs), pa.int64())}
    return pa.table(columns | {"blob": pa.array(blobs, pa.binary())})


def _returned(chunks: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "blob": pa.array(blobs, pa.binary())})


_ROWS, _BACK = "bucket long, chunk long, blob binary", "chunk long, blob binary"


def _dealt(rows: DataFrame, n_chunks: int) -> DataFrame:
    """``rows(_id, _text)`` with their chunk."""
    # The row's place in its partition: the same whenever the partition is read, different for equal rows.
    place = F.monotonically_increasing_id()
    return rows.withColumn("chunk", F.pmod(F.xxhash64("_id", F.length("_text"), place), F.lit(n_chunks)))


def remove_repeats(
    docs: DataFrame,
    width: int = 35,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    bucket_words: int = BUCKET_WORDS,
    with_text: bool = True,
) -> DataFrame:
    """``(id, n_words, n_removed, kept, kept_sha256)`` per row: every word in a repeated window is removed.

    ``kept`` are the words left, joined by one blank; null without ``with_text``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    n_bytes = size[0] or 0
    n_chunks = max(1, math.ceil(n_bytes / chunk_bytes))
    # Words are a sixth of the bytes or fewer in most prose; a power of two of buckets.
    bits = max(0, math.ceil(math.log2(max(1, n_bytes / 6 / bucket_words))))
    plan = _Plan(width, bits)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    texts = _dealt(rows, n_chunks).repartition("chunk")

    def probe(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        return _rows(chunk, *plan.probes(_Chunk(byte_texts(table.column("_text")))))

    def find_anchors(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        parts = _joined(table.column("blob"), np.uint32)
        entries = np.concatenate(parts)
        order = np.argsort(entries, kind="stable")
        values = entries[order] >> np.uint32(2)
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        flags = np.bitwise_or.reduceat(entries[order] & np.uint32(3), first)
        places = np.diff(np.append(first, len(values)))
        good = ((flags & _BLOCK) > 0) & ((places > 1) | ((flags & _MANY) > 0))
        anchors = values[first[good]].astype(np.uint64)
        high = np.uint64(bucket) << np.uint64(30)
        own = [p[_is_in((p >> np.uint32(2)).astype(np.uint64), anchors)] for p in parts]
        back = [(c, ((p >> np.uint32(2)).astype(np.uint64) | high).tobytes()) for c, p in zip(chunks, own) if len(p)]
        return _returned([c for c, _ in back], [b for _, b in back])

    def extend(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows or not found.num_rows:
            return _rows(0, [], [])
        anchors = np.sort(np.concatenate(_joined(found.column("blob"), np.uint64)))
        chunk = _Chunk(byte_texts(table.column("_text")))
        _, a, b = plan.candidates(chunk, anchors)
        a, b, many = _digest_rows(a, b)
        entries = np.empty(len(a), _DIGEST)
        entries["a"], entries["b"] = a, b << np.uint32(1) | many
        return _rows(table.column("chunk")[0].as_py(), *_packed(_bucket_of(a, bits), entries))

    def find_windows(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = _joined(table.column("blob"), _DIGEST)
        entries = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        a, b = entries["a"], entries["b"] >> np.uint32(1)
        order = np.lexsort((b, a))
        a, b, of, many = a[order], b[order], of[order], (entries["b"] & np.uint32(1))[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        places = np.diff(np.append(first, len(a)))
        twice = np.repeat((places > 1) | (np.bitwise_or.reduceat(many, first) > 0), places)
        out = np.empty(int(twice.sum()), _DIGEST)
        out["a"], out["b"] = a[twice], b[twice]
        order = np.argsort(of[twice], kind="stable")
        return _returned(*(lambda at, blobs: ([chunks[i] for i in at], blobs))(*_packed(of[twice][order], out[order])))

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        chunk = _Chunk(byte_texts(table.column("_text")))
        gone = np.zeros(len(chunk.hashes), bool)
        if found.num_rows:
            repeated = np.concatenate(_joined(found.column("blob"), _DIGEST))
            order = np.lexsort((repeated["b"], repeated["a"]))
            repeated = repeated[order]
            starts = chunk.starts(width)
            a = chunk.rolling(width, _BASE)[starts]
            near = _is_in(a, repeated["a"])
            starts, a = starts[near], a[near]
            b = (chunk.rolling(width, _BASE2)[starts] >> np.uint64(33)).astype(np.uint32)
            known = repeated.view(np.uint8).reshape(-1, _DIGEST.itemsize)
            both = np.empty(len(a), _DIGEST)
            both["a"], both["b"] = a, b
            exact = _digests_in(both, np.ascontiguousarray(known).view(_DIGEST).ravel())
            edge = np.zeros(len(gone) + 1, np.int64)
            np.add.at(edge, starts[exact], 1)
            np.subtract.at(edge, starts[exact] + width, 1)
            gone = np.cumsum(edge[:-1]) > 0
        removed, kept, digests = [], [], []
        for words, begin in zip(chunk.words, chunk.begins.tolist()):
            mine = gone[begin : begin + len(words)]
            n = int(mine.sum())
            text = b" ".join(words if not n else [w for w, g in zip(words, mine.tolist()) if not g])
            removed.append(n)
            kept.append(text if with_text else None)
            digests.append(hashlib.sha256(text).hexdigest())
        return pa.table(
            {
                "_id": table.column("_id"),
                "n_words": pa.array(chunk.sizes),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "kept_sha256": pa.array(digests, pa.string()),
            }
        )

    probes = texts.groupBy("chunk").applyInArrow(probe, _ROWS)
    anchors = probes.groupBy("bucket").applyInArrow(find_anchors, _BACK)
    by_chunk = texts.groupBy("chunk").cogroup(anchors.groupBy("chunk"))
    windows = by_chunk.applyInArrow(extend, _ROWS)
    repeats = windows.groupBy("bucket").applyInArrow(find_windows, _BACK)
    result = texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(
        remove, f"_id {kind}, n_words long, n_removed long, kept string, kept_sha256 string"
    )
    return result.withColumnRenamed("_id", id_col)


def _digests_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership of 95-bit digests in ``known``, sorted by both parts."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    # Equal first parts are nearly always one entry; further ones are tried while any are left.
    at = np.searchsorted(known["a"], values["a"])
    found = np.zeros(len(values), bool)
    open_ = np.arange(len(values))
    while len(open_):
        open_ = open_[at[open_] < len(known)]
        same = known["a"][at[open_]] == values["a"][open_]
        open_ = open_[same]
        found[open_] |= known["b"][at[open_]] == values["b"][open_]
        at[open_] += 1
        open_ = open_[~found[open_]]
    return found
