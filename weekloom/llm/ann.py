"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by three rounds of random signs and a fast Hadamard transform and hashes it
to the nearest signed axis. A table has several such hashes, each by its own rotation: the first ones name
the cell of a vector, the others its bucket within the cell, and a hash may use fewer axes, so that cells
and buckets keep about one size however many rows there are (``layout``).

Multiprobe: the value of a bucket for a query is the sum, over the table's hashes, of the turned query's
coordinates at the bucket's signed axes. A query probes the buckets whose value reaches a threshold; it is
sent to the cells that can hold such a bucket. Rows of probed buckets are candidates and are ranked by
their exact inner products with the original vectors in double precision.

Norms: vectors are dealt into at most ``BANDS`` bands by norm, a factor of ``BAND`` each counted down from the
longest, with a threshold each. The thresholds and the number of tables are measured: the ``k`` nearest of
``SAMPLE_QUERIES`` queries are found in all rows by brute force, a threshold keeps ``SAMPLE_RECALL`` of them in
probed buckets of some table, and of 1 to ``tables`` tables that number is taken which scores the fewest
rows of a sample of about ``SAMPLE_ROWS`` rows. Both samples are drawn by a hash; every row is indexed.

Equal (id, vector) rows are one. A cell larger than ``BLOCK_ROWS`` is dealt by a hash of id and vector into
blocks of about that size, and its queries visit each, so neither a vector nor an id that a third of all
rows repeat makes a larger block. A task holds the rows of one block and streams the queries past it. What
comes to the driver is bounded: the samples with their neighbours, and the sizes of at most ``CELLS`` cells
per table and band. A query that finds fewer than it could is searched again in all rows, which is exact.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those with
a null id or with another length than most; rows that share an id are one candidate with the best of
their scores; ties go to the smaller id; an empty table gives an empty result; other columns, whatever
their names, are not read; texts play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import map_batches, slices
from weekloom.session import write_table

BLOCK_ROWS = 4096
BUCKET_ROWS = 32
CELLS = 1 << 14
BAND = 1.25
BANDS = 16
SAMPLE_ROWS = 2048
SAMPLE_QUERIES = 128
SAMPLE_RECALL = 0.95
# Candidate rows merged in one group.
_MERGED_ROWS = 200_000
# Scores by matrix product may differ from exact ones by this; candidates so near to the last are kept.
_SLACK = 1e-9
# A band with fewer sampled neighbours takes the threshold of all.
_LEAST_PAIRS = 50


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of every row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the rows, none of which is zero; squares neither overflow nor vanish."""
    most = np.abs(vectors).max(axis=1)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


def bands_of(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Number of the norm band of every row; rows about as long as the longest are in the middle of band 0."""
    down = np.log(longest) - np.log(norms_of(vectors))
    return np.clip(np.rint(down / math.log(BAND)), 0, BANDS - 1).astype(np.int64)


def mixed_hash(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """31 bits of id and vector."""
    odd = np.random.default_rng(7).integers(1 << 62, size=vectors.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(vectors).view(np.uint64)
    bits = (bits ^ (bits >> np.uint64(32))) * odd
    mixed = bits.sum(axis=1, dtype=np.uint64) ^ (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(33)).astype(np.int64)


def layout(rows: int, size: int) -> tuple[list[int], list[int]]:
    """Axes of the hashes that name the cell and of those that name the bucket within a cell."""

    def hashes(buckets: float) -> list[int]:
        axes = []
        while buckets > 2:
            axes.append(min(size, 1 << math.ceil(math.log2(buckets / 2))))
            buckets /= 2 * axes[-1]
        return axes

    cell = hashes(min(CELLS / 2, rows / BLOCK_ROWS))
    buckets = rows / BUCKET_ROWS / math.prod(2 * a for a in cell)
    return cell, [size, *hashes(buckets / (2 * size))]


class CrossPolytope:
    """Rotations of all tables, of vectors scaled to length one."""

    def __init__(self, dim: int, tables: int, seed: int, cell: list[int], bucket: list[int]):
        self.tables = tables
        self.cell, self.axes = len(cell), [*cell, *bucket]
        self.cells = math.prod(2 * a for a in cell)
        self.size = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, len(self.axes), 3, self.size))

    def turned(self, vectors: np.ndarray, table: int) -> list[np.ndarray]:
        """Per hash of the table: the coordinates of the rows at all its signed axes."""
        x = np.zeros((len(vectors), self.size))
        x[:, : vectors.shape[1]] = vectors / norms_of(vectors)[:, None]
        out = []
        for rounds, axes in zip(self.signs[table], self.axes):
            y = x
            for signs in rounds:
                y = hadamard(y * signs)
            out.append(np.concatenate([y[:, :axes], -y[:, :axes]], axis=1))
        return out

    def places(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """(n,) cells and (n, hashes within a cell) signed axes that name the buckets."""
        at = [np.argmax(y, axis=1) for y in self.turned(vectors, table)]
        cell = np.zeros(len(vectors), np.int64)
        for axis, axes in zip(at, self.axes[: self.cell]):
            cell = cell * 2 * axes + axis
        return cell, np.column_stack(at[self.cell :])

    def values(self, queries: np.ndarray, vectors: np.ndarray, table: int) -> np.ndarray:
        """(queries, vectors): the value for each query of each vector's bucket."""
        return sum(q[:, np.argmax(y, axis=1)] for q, y in zip(self.turned(queries, table), self.turned(vectors, table)))

    def cells_of(self, queries: np.ndarray, table: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query row, cell) of the cells that may hold a bucket whose value reaches the query's ``least``."""
        turned = self.turned(queries, table)
        most = np.array([y.max(axis=1) for y in turned])
        row, cell, value = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries))
        for i, (y, axes) in enumerate(zip(turned[: self.cell], self.axes)):
            sums = value[:, None] + y[row]
            at, axis = np.nonzero(sums + most[i + 1 :].sum(axis=0)[row, None] >= least[row, None] - _SLACK)
            row, cell, value = row[at], cell[at] * 2 * axes + axis, sums[at, axis]
        return row, cell


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order whatever the batch."""
    return (queries * candidates).sum(axis=1)


def bucket_scores(lsh: CrossPolytope, table: int, cell: int, least: float, queries, vectors, axes) -> np.ndarray:
    """Inner products of the queries with the rows of the buckets they probe, -inf for the other rows."""
    turned = lsh.turned(queries, table)
    value = np.zeros(len(queries))
    for y, n in reversed(list(zip(turned[: lsh.cell], lsh.axes))):
        value += y[:, cell % (2 * n)]
        cell //= 2 * n
    buckets, of = np.unique(axes, axis=0, return_inverse=True)
    rows = np.split(np.argsort(of.ravel(), kind="stable"), np.cumsum(np.bincount(of.ravel()))[:-1])
    rough = np.full((len(queries), len(vectors)), -np.inf)
    for bucket, at in zip(buckets, rows):
        reached = value + sum(y[:, axis] for y, axis in zip(turned[lsh.cell :], bucket))
        asks = np.flatnonzero(reached >= least - _SLACK)
        if len(asks):
            rough[asks[:, None], at[None, :]] = queries[asks] @ vectors[at].T
    return rough


def top_of_block(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int, rough=None):
    """(query row, id, score) of the best ``k`` of a block for each query, the query's own id left out.

    ``rough`` holds the inner products where not all rows are candidates.
    """
    rough = queries @ vectors.T if rough is None else rough
    rough[q_ids[:, None] == v_ids[None, :]] = -np.inf
    # The k-th best is counted over ids, each by its best row.
    order = np.argsort(v_ids, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], v_ids[order][1:] != v_ids[order][:-1]]))
    if len(begin) > k:
        best = rough if len(begin) == len(v_ids) else np.maximum.reduceat(rough[:, order], begin, axis=1)
        least = np.partition(best, -k, axis=1)[:, -k]
        scale = np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 1.0)))
        near = rough >= (least - _SLACK * scale)[:, None]
    else:
        near = np.ones_like(rough, bool)
    row, at = np.nonzero(near & (rough > -np.inf))
    scores = np.empty(len(row))
    step = 1 << 16
    for a in range(0, len(row), step):
        scores[a : a + step] = exact_scores(queries[row[a : a + step]], vectors[at[a : a + step]])
    return first_of_each(row, v_ids[at], scores, k)


def first_of_each(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The best ``k`` per row, by score and then smaller id, an id counted once with its best score."""
    order = np.lexsort((-scores, ids, row))
    row, ids, scores = row[order], ids[order], scores[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, scores = row[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    keep = rank < k
    return row[keep], ids[keep], scores[keep], rank[keep]


def _usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.col(id_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.where(sound)
    return rows.select(
        F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )


_BLOCK = "band int, table int, cell int, salt int, asks boolean, id long, axes array<int>"
_FOUND = "part int, query_id long, ids array<long>, scores array<double>"
_RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Plan:
    """Tables in use, the longest norm, and per band the value that a probed bucket reaches."""

    tables: int
    longest: float
    least: np.ndarray


def _neighbour_values(rows: DataFrame, asked: pa.Table, lsh: CrossPolytope, longest: float, k: int) -> DataFrame:
    """``(q, band, values)`` of the ``k`` nearest rows of every sampled query: their buckets' values per table."""
    q_ids, queries = asked.column("id").to_numpy(), _matrix(asked.column("vector").combine_chunks())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.full((len(queries), k), -1)
        scores = np.full((len(queries), k), -np.inf)
        held = np.zeros((len(queries), k, queries.shape[1]))
        for batch in batches:
            vectors, v_ids = _matrix(batch.column("vector")), batch.column("id").to_numpy()
            found = queries @ vectors.T
            found[q_ids[:, None] == v_ids[None, :]] = -np.inf
            both = np.concatenate([scores, found], axis=1)
            at = np.argsort(-both, axis=1, kind="stable")[:, :k]
            old, row = at < k, np.arange(len(queries))[:, None]
            new = np.where(old, 0, at - k)
            held = np.where(old[:, :, None], held[row, np.where(old, at, 0)], vectors[new])
            ids = np.where(old, ids[row, np.where(old, at, 0)], v_ids[new])
            scores = np.take_along_axis(both, at, axis=1)
        q, at = np.nonzero(scores > -np.inf)
        near = held[q, at]
        values = np.zeros((len(q), lsh.tables))
        for t in range(lsh.tables):
            for y, z in zip(lsh.turned(queries, t), lsh.turned(near, t) if len(q) else []):
                values[:, t] += y[q, np.argmax(z, axis=1)]
        band = bands_of(near, longest) if len(q) else q
        yield pa.record_batch(
            {
                "q": pa.array(q, pa.int32()),
                "id": pa.array(ids[q, at], pa.int64()),
                "score": pa.array(scores[q, at], pa.float64()),
                "band": pa.array(band, pa.int32()),
                "values": pa.array(list(values), pa.list_(pa.float64())),
            }
        )

    schema = "q int, id long, score double, band int, values array<double>"
    near = rows.select("id", "vector").mapInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return near.withColumn("place", place).where(F.col("place") <= k).select("q", "band", "values")


def _plan(rows: DataFrame, queries: DataFrame, lsh: CrossPolytope, n: int, k: int) -> Plan | None:
    """The thresholds and the tables that score the fewest rows; None where no query has a neighbour."""

    def longest(batch: pa.RecordBatch) -> pa.RecordBatch:
        norms = norms_of(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros(1)
        return pa.record_batch({"norm": pa.array([norms.max()])})

    most = map_batches(rows.select("vector"), longest, "norm double").agg(F.max("norm")).first()[0]
    asked = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).select("id", "vector").toArrow()
    if most is None or not asked.num_rows:
        return None
    pairs = _neighbour_values(rows, asked, lsh, most, k).toArrow()
    if not pairs.num_rows:
        return None
    band, values = pairs.column("band").to_numpy(), _matrix(pairs.column("values").combine_chunks())
    share = min(1.0, SAMPLE_ROWS / n)

    def draw(batch: pa.RecordBatch) -> pa.RecordBatch:
        drawn = mixed_hash(batch.column("id").to_numpy(), _matrix(batch.column("vector"))) < share * (1 << 31)
        return batch.filter(pa.array(drawn))

    vector_type = rows.schema["vector"].dataType.simpleString()
    drawn = map_batches(rows.select("id", "vector"), draw, f"id long, vector {vector_type}").toArrow()
    asked = _matrix(asked.column("vector").combine_chunks())
    sample = _matrix(drawn.column("vector").combine_chunks()) if drawn.num_rows else asked
    sampled = bands_of(sample, most)
    of_rows = [lsh.values(asked, sample, t) for t in range(lsh.tables)]
    plans = []
    for t in range(1, lsh.tables + 1):
        reached = values[:, :t].max(axis=1)
        least = np.full(BANDS, np.quantile(reached, 1 - SAMPLE_RECALL, method="lower"))
        for b in range(BANDS):
            if (band == b).sum() >= _LEAST_PAIRS:
                least[b] = np.quantile(reached[band == b], 1 - SAMPLE_RECALL, method="lower")
        scored = sum((v >= least[sampled]).mean() for v in of_rows[:t])
        plans.append((scored, t, Plan(t, most, least)))
    return min(plans, key=lambda p: p[:2])[2]


def _block_streams(batches: Iterator[pa.RecordBatch]):
    """(key, rows, queries) of sorted batches: the rows of a block, with one batch of its queries at a time."""
    key, rows, block = None, [], None
    for batch in batches:
        names = np.column_stack([batch.column(c).to_numpy() for c in ("band", "table", "cell", "salt")])
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        change = (names[1:] != names[:-1]).any(axis=1) | (asks[1:] != asks[:-1])
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(names)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if key != tuple(names[a].tolist()):
                key, rows, block = tuple(names[a].tolist()), [], None
            if not asks[a]:
                rows.append(batch.slice(a, b - a))
            elif rows:
                block = block or pa.Table.from_batches(rows).combine_chunks()
                yield key, block, batch.slice(a, b - a)


def _search(rows: DataFrame, queries: DataFrame, lsh: CrossPolytope, plan: Plan | None, k: int, n_queries: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the best of the probed buckets; without a plan, of all rows."""
    vector_type = rows.schema["vector"].dataType.simpleString()
    tables = plan.tables if plan else 1

    def places(vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if plan is None:
            zeros = np.zeros(len(vectors), np.int64)
            return zeros, zeros, np.zeros((len(vectors), 1), np.int64)
        return bands_of(vectors, plan.longest), *lsh.places(vectors, table)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = _matrix(batch.column("vector"))
        out = []
        for t in range(tables):
            band, cell, _ = places(vectors, t)
            out.append(np.column_stack([band, np.full(len(band), t), cell]))
        place, n = np.unique(np.concatenate(out), axis=0, return_counts=True)
        return pa.record_batch({c: pa.array(v) for c, v in zip("ptcn", (*place.T, n))})

    sizes = map_batches(rows.select("vector"), count, "p long, t long, c long, n long")
    blocks = np.zeros((BANDS, tables, lsh.cells if plan else 1), np.int32)
    for r in sizes.groupBy("p", "t", "c").agg(F.sum("n").alias("n")).collect():
        blocks[r["p"], r["t"], r["c"]] = -(-r["n"] // BLOCK_ROWS)
    parts = max(1, math.ceil(n_queries * int(blocks.sum()) * k / _MERGED_ROWS))

    def pack(batch: pa.RecordBatch, of, band, table: int, cell, salt, asks: bool, axes) -> pa.RecordBatch:
        taken = batch.take(pa.array(of))
        return pa.record_batch(
            {
                "band": pa.array(band, pa.int32()),
                "table": pa.array(np.full(len(of), table), pa.int32()),
                "cell": pa.array(cell, pa.int32()),
                "salt": pa.array(salt, pa.int32()),
                "asks": pa.array(np.full(len(of), asks)),
                "id": taken.column("id"),
                "axes": pa.array(axes, pa.list_(pa.int32())),
                "vector": taken.column("vector"),
            }
        )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = _matrix(batch.column("vector"))
            mixed = mixed_hash(batch.column("id").to_numpy(), vectors)
            for t in range(tables):
                band, cell, axes = places(vectors, t)
                yield pack(batch, np.arange(len(band)), band, t, cell, mixed % blocks[band, t, cell], False, list(axes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = _matrix(batch.column("vector"))
            n = len(vectors)
            for t in range(tables):
                for b in np.flatnonzero(blocks[:, t].any(axis=1)).tolist():
                    if plan is None:
                        of, cell = np.arange(n), np.zeros(n, np.int64)
                    else:
                        of, cell = lsh.cells_of(vectors, t, np.full(n, plan.least[b]))
                    times = blocks[b, t, cell]
                    which = np.repeat(np.arange(len(of)), times)
                    salt = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    band = np.full(len(which), b)
                    yield pack(batch, of[which], band, t, cell[which], salt, True, [None] * len(which))

    schema = f"{_BLOCK}, vector {vector_type}"
    placed = rows.select("id", "vector").mapInArrow(place, schema)
    asked = queries.select("id", "vector").mapInArrow(ask, schema)
    kinds = {"part": pa.int32(), "query_id": pa.int64()}
    kinds |= {"ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, table, cell, _), block, asking in _block_streams(batches):
            vectors, v_ids = _matrix(block.column("vector").combine_chunks()), block.column("id").to_numpy()
            axes = _matrix(block.column("axes").combine_chunks()).astype(np.int64)
            for a in range(0, asking.num_rows, 1024):
                mine = asking.slice(a, 1024)
                q, q_ids = _matrix(mine.column("vector")), mine.column("id").to_numpy()
                rough = bucket_scores(lsh, table, cell, plan.least[band], q, vectors, axes) if plan else None
                row, ids, scores, _ = top_of_block(q, q_ids, vectors, v_ids, k, rough)
                some, begin = np.unique(row, return_index=True)
                begin = np.append(begin, len(row)).astype(np.int32)
                out = {
                    "part": q_ids[some] % parts,
                    "query_id": q_ids[some],
                    "ids": pa.ListArray.from_arrays(begin, pa.array(ids, pa.int64())),
                    "scores": pa.ListArray.from_arrays(begin, pa.array(scores, pa.float64())),
                }
                yield pa.record_batch({c: pa.array(v, kinds[c]) if c in ("part", "query_id") else v for c, v in out.items()})

    def merge(group: pa.Table) -> pa.Table:
        ids, scores = group.column("ids").combine_chunks(), group.column("scores").combine_chunks()
        row = np.repeat(group.column("query_id").to_numpy(), pa.compute.list_value_length(ids).to_numpy())
        flat = ids.flatten().to_numpy(), scores.flatten().to_numpy()
        row, ids, scores, rank = first_of_each(row, *flat, k)
        return pa.table(
            {
                "query_id": pa.array(row, pa.int64()),
                "rank": pa.array(rank + 1, pa.int32()),
                "vec_id": pa.array(ids, pa.int64()),
                "score": pa.array(scores, pa.float64()),
            }
        )

    key = ["band", "table", "cell", "salt"]
    met = placed.union(asked).repartition(*key).sortWithinPartitions(*key, "asks")
    return met.mapInArrow(meet, _FOUND).groupBy("part").applyInArrow(merge, _RESULT)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    tables: int = 4,
    seed: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` others of every row for which ``is_query`` holds.

    ``tables`` is the most that may be used; the number in use is measured.
    """
    rows = _usable(vectors, is_query, id_col, vector_col)
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], _RESULT)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return empty
    dim = common["d"]
    rows = rows.where(F.size("vector") == dim)
    # Equal rows are one, and so are copies of an id's vector of which only some ask.
    rows = write_table(rows.groupBy("id", "vector").agg(F.max("asks").alias("asks")), "distinct-vectors")
    queries = rows.where("asks")
    n, n_queries = rows.count(), queries.count()
    size = 1 << max(1, (dim - 1).bit_length())
    lsh = CrossPolytope(dim, tables, seed, *layout(n, size))
    plan = _plan(rows, queries, lsh, n, k)
    if plan is None:
        return empty
    found = write_table(_search(rows, queries, lsh, plan, k, n_queries), "neighbours")
    # A query with fewer than k of its probed buckets is searched in all rows.
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = write_table(queries.join(full, "id", "left_anti"), "short-queries")
    n_short = short.count()
    if not n_short:
        return found
    again = _search(rows, short, lsh, None, k, n_short)
    return found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi").select(*found.columns).union(again)
