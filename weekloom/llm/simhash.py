"""SimHash fingerprints and their near-duplicate groups by a self-join of a binary trie.

Fingerprints are 64 bits of the word shingles of a text. Two link at ``max_bits`` or fewer differing
bits. Equal fingerprints are one entry of the trie, so copies cost nothing and are never paired.

The join walks pairs of trie nodes together: a node pair has the differing bits of its two prefixes,
its children are the four pairs of child nodes, and a pair is dropped as soon as its bits exceed the
budget. To spread the walk, the bits are read in ``max_bits + 1`` orders, each starting with another
block of the fingerprint. Of two linked fingerprints at least one block is equal, so each order may
start at the pairs of equal leading blocks, which are the units Spark shuffles. A unit larger than
``UNIT_ROWS`` is split by taking the walk ``SPLIT_BITS`` further down as a join of node tables; this
is repeated until all units are small. Inside a unit the walk is vectorised, and a unit returns a star
per connected set of fingerprints rather than all pairs; components across units follow in Spark.

Cases: null, empty and blank texts have fingerprint zero and link like any other; texts of one or two
words have one shingle; repeated rows share a component and keep a row each; a null id takes part
but never names a component unless no other id is in it; an empty table gives an empty result. A very
long text is one row whose words and hashes are in memory at once, some 100 bytes a word. Extra columns play
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import byte_texts, map_batches
from weekloom.llm.components import connected_components
from weekloom.session import write_table

BITS = 64
UNIT_ROWS = 8192
SPLIT_BITS = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COLUMNS = np.arange(8) * 256


def shingle_hashes(text: bytes, size: int, seed: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; the whole sequence where there are fewer words."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit b is set where over half of the hashes have it."""
    if not len(hashes):
        return 0
    bytes_ = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.bincount((bytes_ + _COLUMNS).ravel(), minlength=2048).reshape(8, 256)
    votes = (counts @ _BIT_OF_BYTE.astype(np.int64)).ravel()
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp long)``: the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array(
            [fingerprint(shingle_hashes(t, size, seed)) for t in byte_texts(batch.column("_text"))], np.uint64
        )
        return pa.record_batch({"_id": batch.column("_id"), "fp": pa.array(fps.view(np.int64))})

    return map_batches(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), run, f"_id {kind}, fp long"
    )


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index each of ``n`` entries reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return label


def _spread(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every range its number, and the positions inside it."""
    of = np.repeat(np.arange(len(lo)), size)
    first = np.cumsum(size) - size
    return of, lo[of] + np.arange(len(of)) - first[of]


# Node pairs with this many entry pairs or fewer are compared directly.
_LEAF_PAIRS = 16
# Entry pairs compared at once; bounds memory.
_AT_ONCE = 1 << 21


def trie_links(keys: np.ndarray, pairs: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` within ``max_bits``, walking node pairs of the trie.

    ``keys`` are unsigned and ascending within every range named by ``pairs``, whose rows are
    (low, high, low, high) of two nodes that share all bits above their own first differing one.
    """
    ones = []
    for depth in range(BITS):
        bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
        ones.append(np.concatenate([[0], np.cumsum(bit.astype(np.int64))]))
    stack = [(0, pairs)]
    while stack:
        depth, at = stack.pop()
        if len(at) > 1 and ((at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2])).sum() > _AT_ONCE:
            half = len(at) // 2
            stack += [(depth, at[half:]), (depth, at[:half])]
            continue
        a, b = at[:, 1] - at[:, 0], at[:, 3] - at[:, 2]
        small = (a * b <= _LEAF_PAIRS) | (depth == BITS)
        leaf, at = at[small], at[~small]
        if len(leaf):
            of, x = _spread(leaf[:, 0], leaf[:, 1] - leaf[:, 0])
            of, y_at = _spread(leaf[of, 2], (leaf[:, 3] - leaf[:, 2])[of])
            x = x[of]
            keep = x < y_at
            x, y_at = x[keep], y_at[keep]
            near = np.bitwise_count(keys[x] ^ keys[y_at]) <= max_bits
            yield x[near], y_at[near]
        if not len(at):
            continue
        split = [hi - (ones[depth][hi] - ones[depth][lo]) for lo, hi in ((at[:, 0], at[:, 1]), (at[:, 2], at[:, 3]))]
        a0, a1 = (at[:, 0], split[0]), (split[0], at[:, 1])
        b0, b1 = (at[:, 2], split[1]), (split[1], at[:, 3])
        self_pair = (at[:, 0] == at[:, 2]) & (at[:, 1] == at[:, 3])
        children = []
        for left, right, twice in ((a0, b0, False), (a1, b1, False), (a0, b1, False), (a1, b0, True)):
            rows = np.column_stack([*left, *right])
            full = (rows[:, 1] > rows[:, 0]) & (rows[:, 3] > rows[:, 2])
            if twice:  # the mirror image of the third pair
                full &= ~self_pair
            children.append(rows[full])
        below = np.concatenate(children)
        # Bits in which the two prefixes differ so far.
        shift = np.uint64(BITS - 1 - depth)
        differ = np.bitwise_count((keys[below[:, 0]] ^ keys[below[:, 2]]) >> shift)
        stack.append((depth + 1, below[differ <= max_bits]))


def _unit_edges(unit: np.ndarray, side: np.ndarray, key: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (index, index) of the links inside each unit; rows come sorted by unit, side, key."""
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    last = np.append(first[1:], len(unit))
    right = np.concatenate([[0], np.cumsum(side)])
    middle = last - (right[last] - right[first])
    own = middle == last
    pairs = np.column_stack([first, middle, np.where(own, first, middle), last])
    found = list(trie_links(key, pairs, max_bits))
    x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    if not len(x):
        return x, y
    label = _components(len(unit), x, y)
    member = np.flatnonzero(label != np.arange(len(unit)))
    return member, label[member]


def _rotated(fp, order: int, orders: int):
    """The fingerprint with block ``order`` first, as a column."""
    shift = BITS // orders * order
    if not shift:
        return fp
    return F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, BITS - shift))


def _prefix(key, depth: int):
    return F.shiftrightunsigned(key, BITS - depth)


def _units(entries: DataFrame, max_bits: int) -> DataFrame:
    """``(unit, side, key, fp)``: work units of at most ``UNIT_ROWS`` rows where the trie can be split."""
    orders = max_bits + 1
    block = BITS // orders
    views = [F.struct(F.lit(o).alias("o"), _rotated(F.col("fp"), o, orders).alias("key")) for o in range(orders)]
    rows = entries.select("fp", F.explode(F.array(*views)).alias("_v")).select(
        F.concat_ws(":", F.col("_v.o"), _prefix(F.col("_v.key"), block)).alias("unit"),
        F.lit(0).alias("side"),
        F.col("_v.key").alias("key"),
        "fp",
    )
    done: DataFrame | None = None
    for depth in range(block, BITS, SPLIT_BITS):
        large = rows.groupBy("unit").count().where(F.col("count") > UNIT_ROWS).select("unit")
        large = write_table(large, "large-units")
        if not large.take(1):
            break
        small = rows.join(large, "unit", "left_anti")
        done = small if done is None else done.union(small)
        rows = write_table(_descend(rows.join(large, "unit", "left_semi"), depth, max_bits), "split-units")
    return rows if done is None else done.union(rows)


def _descend(rows: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """Replace every unit by the pairs of its nodes ``SPLIT_BITS`` further down within the budget."""
    rows = rows.withColumn("node", _prefix(F.col("key"), min(BITS, depth + SPLIT_BITS)))
    nodes = rows.select("unit", "side", "node").distinct()
    two_sided = nodes.groupBy("unit").agg((F.max("side") == 1).alias("two"))
    nodes = nodes.join(two_sided, "unit")
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= max_bits]
    # A node of the left side meets the nodes that differ from it in the bits of a mask: an equi-join
    # on the expected partner, for the units whose sides are one node, and against side 1 otherwise.
    left = nodes.where("side = 0")
    same = left.where("NOT two").select("unit", "node", F.explode(F.array(*map(F.lit, masks))).alias("_m"))
    same = same.select("unit", F.col("node").alias("a"), F.col("node").bitwiseXOR(F.col("_m").cast("long")).alias("b"))
    pairs = same.where("a <= b").join(
        left.where("NOT two").select("unit", F.col("node").alias("b")), ["unit", "b"]
    )
    # The two prefixes of a two-sided unit differ already; both sides have at most 2^SPLIT_BITS nodes.
    right = nodes.where("side = 1").select("unit", F.col("node").alias("b"))
    across = left.where("two").select("unit", F.col("node").alias("a")).join(right, "unit")
    across = across.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    pairs = pairs.select("unit", "a", "b").union(across.select("unit", "a", "b"))
    named = pairs.withColumn("new", F.concat_ws("/", "unit", "a", "b"))
    as_left = named.select("unit", F.lit(None).cast("int").alias("only"), F.col("a").alias("node"), "new", F.lit(0).alias("s"))
    as_right = named.where("a <> b").select("unit", F.lit(None).cast("int").alias("only"), F.col("b").alias("node"), "new", F.lit(1).alias("s"))
    places = as_left.union(as_right).drop("only")
    moved = rows.join(places, ["unit", "node"])
    return moved.select(F.col("new").alias("unit"), F.col("s").alias("side"), "key", "fp")


def near_links(entries: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints; those within ``max_bits`` end in one component."""
    rows = _units(entries, max_bits)
    sorted_rows = rows.repartition("unit").sortWithinPartitions("unit", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> pa.RecordBatch:
            unit = table.column("unit").combine_chunks().dictionary_encode()
            unit = unit.combine_chunks() if isinstance(unit, pa.ChunkedArray) else unit
            fp = table.column("fp").to_numpy()
            x, y = _unit_edges(
                unit.indices.to_numpy(),
                table.column("side").to_numpy(),
                table.column("key").to_numpy().view(np.uint64),
                max_bits,
            )
            return pa.record_batch({"u": pa.array(fp[x], pa.int64()), "v": pa.array(fp[y], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = table.column("unit")[-1]
            cut = pa.compute.index(table.column("unit"), last).as_py()
            if cut:  # the last unit may go on in the next batch
                yield edges(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    return sorted_rows.mapInArrow(run, "u long, v long")


def component_names(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``(fp, component_id)`` per fingerprint of ``fps(_id, fp)``: the smallest ``_id`` of its component."""
    edges = near_links(fps.select("fp").distinct(), max_bits)
    roots = write_table(connected_components(edges), "components")
    least = fps.groupBy("fp").agg(F.min("_id").alias("_id"))
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.select("fp", "_id", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("_id").alias("component_id"))
    return grouped.join(named, "root").select("fp", "component_id")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    max_bits: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per row; the component is named by its smallest id."""
    fps = write_table(fingerprints(docs, id_col, text_col, size, seed), "fingerprints")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    named = fps.join(component_names(fps, max_bits), "fp")
    return named.select(F.col("_id").alias(id_col), text.alias("fingerprint"), "component_id")


def keep_one_row_per_group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    max_bits: int = 3,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs``, one per component: smallest id, nulls last, then the smaller text digest.

    Rows are chosen by their place in a stored copy of ``docs``, never by their id, so rows with a null id
    or an id that other texts have too are chosen or left on their own; columns may have any name and type.
    """
    place = "_place"
    while place in docs.columns:
        place += "_"
    stored = write_table(docs.withColumn(place, F.monotonically_increasing_id()), "documents")
    own, text = F.col(id_col), F.col(text_col)
    first = F.struct(own.isNull().alias("missing"), own.alias("id"), F.xxhash64(text).alias("t"), F.col(place).alias("p"))
    fps = fingerprints(stored.select(first.alias("_first"), text.alias("_text")), "_first", "_text", size, seed)
    kept = component_names(write_table(fps, "fingerprints"), max_bits)
    kept = kept.select(F.col("component_id.p").alias(place)).distinct()
    return stored.join(kept, place, "left_semi").select(*docs.columns)
