"""Jaccard self-join of word-shingle sets by parity sketches.

A set's sketch is a row of 64-bit words. Each element flips one bit of one word, so the bits in which two
sketches differ are at most the elements in which the sets differ. Sets of sizes a and b with a Jaccard
similarity of ``least`` differ in at most (1 - least) / (1 + least) * (a + b) elements.

Sizes are cut into bands so that a partner is in the same band or the next. Of a band with at most D
differing elements the sketch has D + 1 words. By the pigeonhole principle, taken round the row of words
(Qin and Xiao, 2018), a linked pair has a word where both are equal and from which on any l words differ in
l - 1 bits at most. Equal words are an equi-join in Spark; the ``CHAIN`` words that follow, folded to eight bits
each, decide inside the join. A word of one bit or none is common, so it is joined together with the next one,
with each of its bits left out in turn: two words that differ in one bit share such a variant. A set sends its
own band's words and, as a smaller partner, those of the next band.

What this finds are candidates, kept as star edges: a hot word costs an edge a set, not all pairs. Tasks fold
what is equal before the shuffle. One text of each set in a candidate component is then shipped (where a
component's sets are over ``SET_BYTES``, to the pairs of its parts) and links are decided by the exact similarity.

Cases: null, empty and blank texts have an empty set, which links with nothing; a text with fewer words
than a shingle is one element; equal sets are one entry and link at any size; a null id takes part like any
other and names a component only where no other id is in it; rows that share an id stay rows of their own; a
very long text is one row, at some 100 bytes a word in memory; an empty table gives an empty result; extra
columns play no part. Elements are 64-bit hashes, sets are named by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import WordCache, byte_texts, map_batches, slices
from weekloom.llm.components import connected_components
from weekloom.llm.simhash import _components
from weekloom.session import write_table

SIZE = 4
LEAST = 85  # of 100
SET_BYTES = 1 << 24
# Elements sketched at once, entries folded before they are handed on, names of sets a task remembers.
AT_ONCE = 1 << 19
HELD_ENTRIES = 1 << 20
SEEN_SETS = 1 << 18
# Digests of chosen texts have at most 2 ** 26 bits.
MOST_BITS = 26
# Entries of a bucket that one task joins, on average.
BUCKET_ENTRIES = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
_MIX, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_NAME_BITS = np.uint64((1 << 48) - 1)
_word_hashes = WordCache(xxhash.xxh3_64_intdigest)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _MIX2
    return values ^ (values >> np.uint64(32))


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Hashes of the distinct shingles in ascending order; of the whole sequence where there are fewer words."""
    words = text.translate(_LOWER).split()
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    if not n:
        return hashes
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total + hashes[k : len(words) - n + 1 + k]) * _BASE
    # Sequences shorter than a shingle never equal one.
    return np.unique(_mixed(total + np.uint64(n)))


def name_of(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed longs."""
    value = xxhash.xxh3_128_intdigest(elements.tobytes())
    return tuple(h - (1 << 64) if h >> 63 else h for h in (value >> 64, value & ((1 << 64) - 1)))


class Bands:
    """Size bands for a similarity of ``least`` percent: the partner of a set is in its band or the next."""

    def __init__(self, least: int):
        self.least = least
        self.edges = [1]

    def high(self, band: int) -> int:
        while len(self.edges) <= band + 1:
            self.edges.append(self.edges[-1] * 100 // self.least + 1)
        return self.edges[band + 1] - 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        band = len(self.edges)
        while sizes.size and self.high(band) < sizes.max():
            band += 1
        return np.searchsorted(np.array(self.edges), sizes, side="right") - 1

    def words(self, band: int) -> int:
        """One more than the elements in which linked sets of the band, or of it and the one below, can differ."""
        return (100 - self.least) * 2 * self.high(band) // (100 + self.least) + 1


def sketches(elements: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The sketch words of many sets in a row; set i has ``sizes[i]`` elements and ``widths[i]`` words."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(widths) - widths
    # High bits choose the word, so that ascending elements give ascending words; low bits the bit.
    word = ((elements >> np.uint64(32)) * widths.astype(np.uint64)[of]) >> np.uint64(32)
    at = first[of] + word.astype(np.int64)
    out = np.zeros(int(widths.sum()), np.uint64)
    if len(at):
        runs = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[runs]] = np.bitwise_xor.reduceat(np.uint64(1) << (elements & np.uint64(63)), runs)
    return out


# An entry: what is joined on beyond the bucket, the words that follow, the name of the set.
_ENTRY = np.dtype([("key", "<u4"), ("chain", "<u8"), ("low", "<u4"), ("high", "<u2")])
# Words that follow in an entry, one byte each.
CHAIN = 8
# Groups of this many entries or fewer are compared pair by pair.
_FEW = 16
_BYTES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
# Byte j, counted from 0: the j + 2 words from the equal one differ in j + 1 bits at most.
_LIMITS = np.uint64(0x0807060504030201)


def _folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Words folded to their lowest ``bits``: differing bits can only get fewer."""
    shift = 32
    while shift >= bits:
        words = words ^ (words >> np.uint64(shift))
        shift //= 2
    return words & np.uint64((1 << bits) - 1)


def chain_fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether every run of words from the equal one differs in fewer bits than it has words."""
    x = a ^ b
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    bits = (x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    # The product's byte j is the sum of the bytes up to j, at most 64.
    return (((_LIMITS | _TOPS) - bits * _BYTES) & _TOPS) == _TOPS


def _entries(bands: Bands, sets: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit key, the words that follow, name) of every word of every set, in both its bands."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands.of(sizes)
    out = []
    for shift in (0, 1):
        widths = np.array([bands.words(b + shift) for b in own.tolist()], np.int64)
        # With one word in its band a set links with equal sets only.
        some = np.flatnonzero(widths > 1)
        if not len(some):
            continue
        picked, width, band = [sets[i] for i in some], widths[some], (own[some] + shift).astype(np.uint64)
        words = sketches(np.concatenate(picked), sizes[some], width)
        of = np.repeat(np.arange(len(some)), width)
        first = (np.cumsum(width) - width)[of]
        wide, place = width[of], np.arange(len(words)) - first
        small = _folded(words, 8)
        chain = np.zeros(len(words), np.uint64)
        for k in range(1, CHAIN + 1):
            # A row of fewer words is gone round once, without the word itself.
            following = small[first + (place + k) % wide]
            chain |= np.where(k < wide, following, np.uint64(0)) << np.uint64(8 * (k - 1))
        key = _mixed(words + _mixed((band[of] << np.uint64(40)) + place.astype(np.uint64)))
        name = names[some][of]
        light = np.bitwise_count(words) <= 1
        out.append((key[~light], chain[~light], name[~light]))
        following = _folded(words[first + (place + 1) % wide], 32)[light]
        key, chain, name = key[light], chain[light], name[light]
        # The next word as it is, and with each of its bits left out.
        variants = [(np.arange(len(key)), following)]
        for bit in range(32):
            has = np.flatnonzero((following >> np.uint64(bit)) & np.uint64(1))
            variants.append((has, following[has] ^ np.uint64(1 << bit)))
        at, value = np.concatenate([v[0] for v in variants]), np.concatenate([v[1] for v in variants])
        out.append((_mixed(key[at] + _mixed(value + np.uint64(1))), chain[at], name[at]))
    if not out:
        return (np.zeros(0, np.uint64),) * 3
    return tuple(np.concatenate(column) for column in zip(*out))


def _reached(chain: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (index, index) that join what fits in one large group, each entry looked at until it is reached."""
    open_, x, y = np.arange(len(chain)), [], []
    while len(open_):
        waiting, open_ = [open_[0]], open_[1:]
        while waiting and len(open_):
            at = waiting.pop()
            fits = chain_fits(chain[at], chain[open_])
            if fits.any():
                near, open_ = open_[fits], open_[~fits]
                x.append(near)
                y.append(np.full(len(near), at))
                waiting += near.tolist()
    return x, y


def _joined(key: np.ndarray, chain: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (name, name) of entries with one key whose chains fit."""
    order = np.lexsort((chain, key))
    key, chain, name = key[order], chain[order], name[order]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (chain[1:] == chain[:-1])
    # Entries equal in both join the first of them, which stands for all.
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
    x, y = [name[again]], [name[head[again]]]
    key, chain, name = key[~again], chain[~again], name[~again]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    few = first[(size > 1) & (size <= _FEW)]
    extent = size[(size > 1) & (size <= _FEW)]
    for step in range(1, _FEW):
        for start in range(_FEW - step):
            mine = few[extent > start + step] + start
            if not len(mine):
                break
            fits = chain_fits(chain[mine], chain[mine + step])
            x.append(name[mine[fits]])
            y.append(name[mine[fits] + step])
    for begin, n in zip(first[size > _FEW].tolist(), size[size > _FEW].tolist()):
        a, b = _reached(chain[begin : begin + n])
        x += [name[begin + part] for part in a]
        y += [name[begin + part] for part in b]
    x, y = np.concatenate(x), np.concatenate(y)
    apart = x != y
    return _star(x[apart], y[apart])


def _star(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as join what the given ones join."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = _components(len(nodes), at[: len(x)], at[len(x) :])
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _packed(key: np.ndarray, chain: np.ndarray, name: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """Entries per bucket; the bucket are the key's upper ``bits``, the entry keeps 32 more."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.argsort(bucket, kind="stable")
    entries = np.empty(len(key), _ENTRY)
    entries["key"] = (key[order] >> np.uint64(32 - bits)).astype(np.uint32)
    entries["chain"] = chain[order]
    entries["low"] = name[order].astype(np.uint32)
    entries["high"] = (name[order] >> np.uint64(32)).astype(np.uint16)
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
    return bucket[edges[:-1]].tolist(), [entries[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]


def _unpacked(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    entries = np.concatenate([np.frombuffer(b.as_buffer(), _ENTRY) for b in blobs])
    name = entries["low"].astype(np.uint64) | entries["high"].astype(np.uint64) << np.uint64(32)
    return entries["key"], entries["chain"], name


class _Folder:
    """Entries of a task: those with equal key and chain become one and an edge."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.held = bits, [], 0

    def add(self, entries: tuple) -> None:
        self.parts.append(entries)
        self.held += len(entries[0])

    def flush(self) -> pa.RecordBatch:
        if not self.parts:
            return _batch([], [], *(np.zeros(0, np.uint64),) * 2)
        key, chain, name = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((chain, key))
        key, chain, name = key[order], chain[order], name[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (chain[1:] == chain[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
        x, y = name[again], name[head[again]]
        u, v = _star(x[x != y], y[x != y])
        buckets, blobs = _packed(key[~again], chain[~again], name[~again], self.bits)
        return _batch(buckets, blobs, u, v)


def _batch(buckets: list[int], blobs: list[bytes], u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Blobs for the buckets, and one row of edges, which any bucket may take along."""
    if len(u):
        buckets = [*buckets, int(u[0]) & 0x7FFFFFFF if not buckets else buckets[0]]
        blobs = [*blobs, None]
    edges = [None] * (len(blobs) - (1 if len(u) else 0)) + ([np.column_stack([u, v]).tobytes()] if len(u) else [])
    return pa.record_batch(
        {"bucket": pa.array(buckets, pa.int64()), "blob": pa.array(blobs, pa.binary()), "edges": pa.array(edges, pa.binary())}
    )


def candidate_edges(docs: DataFrame, n_words: int, size: int = SIZE, least: int = LEAST) -> DataFrame:
    """``(u, v)``: stars over the 48-bit names of sets that may link; ``docs(_text)``, some ``n_words`` in all."""
    bands = Bands(least)
    share = 2.5 * (100 - least) * 2 / (100 + least)  # entries a word, two bands and variants
    bits = max(0, min(24, int(np.ceil(np.log2(max(1.0, n_words * share / BUCKET_ENTRIES))))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, seen = _Folder(bits), set()
        held: list[np.ndarray] = []

        def sketch() -> None:
            names = np.array([name_of(s)[0] & int(_NAME_BITS) for s in held], np.uint64)
            folder.add(_entries(bands, held, names))
            held.clear()

        waiting = 0
        for part in slices(batches):
            for text in byte_texts(part.column("_text")):
                elements = shingle_set(text, size)
                name = name_of(elements)
                if not len(elements) or name in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(name)
                held.append(elements)
                waiting += len(elements)
                if waiting >= AT_ONCE:
                    sketch()
                    waiting = 0
                if folder.held >= HELD_ENTRIES:
                    yield folder.flush()
        if held:
            sketch()
        yield folder.flush()

    def join(table: pa.Table) -> pa.Table:
        blobs = table.column("blob").drop_null()
        x, y = _joined(*_unpacked(blobs)) if len(blobs) else (np.zeros(0, np.uint64),) * 2
        edges = [np.frombuffer(b.as_buffer(), np.uint64).reshape(-1, 2) for b in table.column("edges").drop_null()]
        u = np.concatenate([x, *(e[:, 0] for e in edges)]).view(np.int64)
        v = np.concatenate([y, *(e[:, 1] for e in edges)]).view(np.int64)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    sent = docs.select("_text").mapInArrow(emit, "bucket long, blob binary, edges binary")
    return sent.groupBy("bucket").applyInArrow(join, "u long, v long")


def exact_links(sets: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int]]:
    """A spanning forest (index, index) of the pairs with ``100 * shared >= least * union``."""
    sizes = np.array([len(s) for s in sets])
    open_ = np.ones(len(sets), bool)
    found = []
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        reached = [start]
        while reached:
            at = reached.pop()
            fits = 100 * np.minimum(sizes, sizes[at]) >= least * np.maximum(sizes, sizes[at])
            other = np.flatnonzero(open_ & fits)
            if not len(other) or not sizes[at]:
                continue
            flat = np.concatenate([sets[k] for k in other])
            place = np.minimum(np.searchsorted(sets[at], flat), sizes[at] - 1)
            begins = np.cumsum(sizes[other]) - sizes[other]
            shared = np.add.reduceat((sets[at][place] == flat).astype(np.int64), begins)
            near = other[100 * shared >= least * (sizes[other] + sizes[at] - shared)]
            open_[near] = False
            found += [(at, k) for k in near.tolist()]
            reached += near.tolist()
    return found


def _verified(texts: DataFrame, size: int, least: int) -> DataFrame:
    """Exact edges ``(u, v)`` inside the candidate components of ``texts(root, parts, node, _text)``.

    A component in several parts is dealt to the pairs of its parts.
    """
    dealt = texts.withColumn("s", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "node", "_text")

    def check(table: pa.Table) -> pa.Table:
        # A set comes once for each task that met its text.
        node, first = np.unique(table.column("node").to_numpy(), return_index=True)
        column = table.column("_text").combine_chunks().take(pa.array(first))
        links = exact_links([shingle_set(t, size) for t in byte_texts(column)], least)
        x, y = (np.array([link[k] for link in links], np.int64) for k in (0, 1))
        return pa.table({"u": pa.array(node[x], pa.int64()), "v": pa.array(node[y], pa.int64())})

    return dealt.groupBy("root", "i", "j").applyInArrow(check, "u long, v long")


def _named(docs: DataFrame, size: int) -> DataFrame:
    """``(_id, _t, _s, n, a, b)``: digests of the text, size and name of the set, for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in byte_texts(batch.column("_text"))]
        names = [name_of(s) for s in sets]
        columns = {c: batch.column(c) for c in ("_id", "_t", "_s")}
        columns["n"] = pa.array([len(s) for s in sets], pa.int64())
        return pa.record_batch(columns | {c: pa.array([x[k] for x in names], pa.int64()) for k, c in enumerate("ab")})

    kind = docs.schema["_id"].dataType.simpleString()
    return map_batches(docs, run, f"_id {kind}, _t long, _s long, n long, a long, b long")


def _bitmap(chosen: DataFrame) -> bytes:
    """A bit for each ``_t`` of ``chosen``: at most 2 ** ``MOST_BITS`` of them, 8 MB, whatever the table's size."""
    n = chosen.count()
    bits = min(MOST_BITS, max(15, (16 * n).bit_length()))
    place = F.col("_t").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = chosen.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = bytearray((1 << bits) // 8)
    for r in parts.collect():
        start = (r["part"] - 1) * 4096
        out[start : start + 4096] = r["bits"]
    return bytes(out)


def _wanted(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """``texts(_t, _s, _text)`` that may be in ``chosen``, each once for every task that meets it.

    The bits only spare texts the shuffle of the join that follows: where they are all set, all texts go on.
    A task remembers ``SEEN_SETS`` digests; a text it has forgotten goes on again.
    """
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        seen: set = set()
        for part in batches:
            place = part.column("_t").to_numpy() & (len(bits) * 8 - 1)
            near = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
            digests = (part.column(c).to_numpy()[near].tolist() for c in ("_t", "_s"))
            new = []
            for at, key in zip(near.tolist(), zip(*digests)):
                if key not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(key)
                    new.append(at)
            yield part.take(pa.array(new, pa.int64()))

    return texts.mapInArrow(run, "_t long, _s long, _text string")


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: int = LEAST
) -> DataFrame:
    """``(id, n_shingles, component_id)`` per row; a component is named by its smallest id."""
    text = F.col(text_col)
    # Two digests name a text, so that equal texts are shipped once.
    digests = F.xxhash64(text).alias("_t"), F.xxhash64(F.lit(1), text).alias("_s")
    own = docs.select(F.col(id_col).alias("_id"), *digests, text.alias("_text"))
    rows = write_table(_named(own, size), "sets")
    n_words = rows.agg(F.sum("n")).first()[0] or 0
    edges = candidate_edges(own, n_words, size, least)
    members = write_table(connected_components(edges), "candidates")
    # One entry per set, numbered, with one of its texts.
    distinct = rows.where("n > 0").groupBy("a", "b").agg(
        F.min("_id").alias("_id"), F.min(F.struct("_t", "_s")).alias("_text"), F.first("n").alias("n")
    )
    distinct = write_table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    short = F.col("a").bitwiseAND(F.lit(int(_NAME_BITS)))
    members = members.withColumnRenamed("node", "name")
    chosen = distinct.join(members, short == F.col("name")).select("root", "node", "n", "_text._t", "_text._s")
    chosen = write_table(chosen, "candidate-sets")
    volume = chosen.groupBy("root").agg(F.ceil(F.sum("n") * 8 / SET_BYTES).alias("parts"), F.count(F.lit(1)).alias("sets"))
    chosen = chosen.join(volume.where("sets > 1"), "root").select("root", "parts", "node", "_t", "_s")
    chosen = write_table(chosen, "chosen-texts")
    texts = _wanted(own.select("_t", "_s", "_text"), chosen).join(chosen, ["_t", "_s"])
    linked = connected_components(_verified(texts.drop("_t", "_s"), size, least))
    grouped = distinct.join(linked, "node", "left").select("a", "b", "_id", "root")
    grouped = write_table(grouped, "grouped-sets")
    # A set without links is its own component.
    least_id = grouped.where("root IS NOT NULL").groupBy("root").agg(F.min("_id").alias("_least"))
    named = grouped.join(least_id, "root", "left").select(
        "a", "b", F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id")
    )
    full = rows.where("n > 0").join(named, ["a", "b"]).select("_id", "n", "component_id")
    empty = rows.where("n = 0").select("_id", "n", F.col("_id").alias("component_id"))
    return full.union(empty).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
