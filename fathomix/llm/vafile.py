"""Exact nearest neighbours by vector-approximation files.

Each component is quantised to ``2 ** bits`` cells between the table's bounds; the file of cell
numbers is a small part of the vectors. A query's distance to a vector lies between bounds
that come from the vector's cells alone. Step 1 scans the cells: the distance to the cells' centre, less or more
half their diagonal, is a bound that a matrix product gives for all; what that leaves gets the exact bounds,
component by component (to the nearest and to the farthest edge of each cell). It keeps, for each query, whatever has a
lower bound within the kth smallest upper bound. Step 2 reads exact vectors in lower-bound
order: first those of the k lowest bounds, whose greatest exact distance then says which
of the others must still be read; past it the kth result is certain.

Layout. Queries are cut in blocks, cells in stripes, and a task scans one stripe for one block, a part of the
stripe at a time: what it has seen bounds what it keeps of the rest, so that a stripe gives little more than k
candidates a query. Only cell numbers travel to the blocks (a byte a component where vectors have four), queries with their vectors
to the stripes. Both sides of a task are bounded in rows whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, map_batches

K = 10
BITS = 8
#: Queries of a block, and the most cells of a stripe.
QUERIES, CELLS = 32_768, 1 << 20
#: Cells and queries of one matrix product.
_PART = 2048


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def quantise(x: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers (n, dim)."""
    width = np.where(high > low, (high - low) / (1 << bits), 1.0)
    return np.clip(np.floor((x - low) / width), 0, (1 << bits) - 1).astype(np.uint8)


def centres(cells: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of cells, and half the widths of a cell."""
    half = np.where(high > low, (high - low) / (1 << bits), 0.0) / 2
    return low + (2 * cells + 1) * half, half


def slack(queries: np.ndarray, middle: np.ndarray, half: np.ndarray) -> float:
    """How far a distance by the matrix product to a cell's centre may be from the distance to a vector in the cell: half the diagonal and the product's rounding."""
    far = float((queries**2).sum(axis=1).max(initial=0.0) + (middle**2).sum(axis=1).max(initial=0.0))
    # sqrt(v + e) - sqrt(v) <= sqrt(e): the product's cancellation is at most about dim * eps of the squares
    return float(np.sqrt((half**2).sum()) + math.sqrt(4 * queries.shape[1] * np.finfo(float).eps * max(far, 1e-300)))


def cell_bounds(queries: np.ndarray, middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row: the least and the greatest distance of a query to a vector in a cell with that centre."""
    off = np.abs(queries - middle)
    # a little wider than the cell, so that rounding can't put a vector outside of its bounds
    edge = half * (1 + 1e-9) + 1e-12 * (np.abs(middle) + np.abs(queries))
    return np.sqrt((np.maximum(off - edge, 0) ** 2).sum(axis=1)), np.sqrt(((off + edge) ** 2).sum(axis=1))


def scan_cells(queries: np.ndarray, q_ids: np.ndarray, cells: np.ndarray, c_ids: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, ...]:
    """(query index, cell id, lower, upper) of what a query may have among its k nearest in these cells; a row is no neighbour of its own id."""
    parts: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(queries), _PART):
        q, own = queries[a : a + _PART], q_ids[a : a + _PART]
        q2 = (q**2).sum(axis=1)
        held: list[tuple[np.ndarray, ...]] = []
        limit = np.full(len(q), np.inf)  # kth smallest upper bound so far
        best = np.full((len(q), k), np.inf)
        for b in range(0, len(cells), _PART):
            middle, half = centres(cells[b : b + _PART].astype(np.float64), low, high, bits)
            ids = c_ids[b : b + _PART]
            square = q @ middle.T
            square *= -2.0
            square += q2[:, None]
            square += (middle**2).sum(axis=1)[None, :]
            wide = slack(q, middle, half)
            # of this part alone, and of what was before
            reach = limit
            if square.shape[1] > k + 1:
                # the row itself may be among them
                kth = np.sqrt(np.maximum(np.partition(square, k, axis=1)[:, k], 0)) + wide
                reach = np.minimum(limit, kth)
            i, j = np.nonzero(square <= ((reach + wide) ** 2)[:, None])
            other = own[i] != ids[j]
            i, j = i[other], j[other]
            lower, upper = cell_bounds(q[i], middle[j], half)
            keep = lower <= limit[i]
            i, j, lower, upper = i[keep], j[keep], lower[keep], upper[keep]
            held.append((i, ids[j], lower, upper))
            # k smallest upper bounds of each query
            order = np.lexsort((upper, i))
            row, up = i[order], upper[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            new = np.full((len(q), k), np.inf)
            new[row[place < k], place[place < k]] = up[place < k]
            best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
            limit = best[:, k - 1]
        i, ids, lower, upper = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        keep = lower <= limit[i]
        parts.append((i[keep] + a, ids[keep], lower[keep], upper[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def nearest(
    table: DataFrame, k: int = K, bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding", asks: Column | None = None, queries_of_block: int = QUERIES, cells_of_stripe: int = CELLS,
) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): for each query row, the k other rows nearest by Euclidean distance.

    ``asks``: a condition on ``id_col`` (and other columns of the table) that tells the query rows; all by default.
    Exact; equal distances go by id. Rows with a null id or vector, with another length than most vectors (the
    most frequent length; of equals the greater), or with a null or non-finite component take no part. An id counts as a row: of rows that repeat
    an id the first vector in order stays, and it is a query if one of them is. With fewer than k other rows, all are given; one row gives none.
    An empty table gives no rows. Other columns, of whatever names, are read only by ``asks``.
    """
    ask = F.coalesce(asks if asks is not None else F.lit(True), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), ask.alias("ask"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = cut(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("ask").alias("ask")))
    schema = "query_id long, neighbour_id long, distance double, rank int"
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("ask").alias("asked")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None or not sizes["asked"]:
        return table.sparkSession.createDataFrame([], schema)
    dim, n, asked = sizes["dim"], sizes["n"], sizes["asked"]
    rows = rows.where(F.size("v") == dim)

    def ends_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(0), dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["pos", "low", "high"])

    ends = map_batches(rows.select("v"), ends_of, "pos long, low double, high double").groupBy("pos").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    low, high = np.array([r.low for r in ends]), np.array([r.high for r in ends])
    blocks = max(1, math.ceil(asked / queries_of_block))
    cores = table.sparkSession.sparkContext.defaultParallelism
    stripes = max(math.ceil(n / cells_of_stripe), min(math.ceil(2 * cores / blocks), math.ceil(n / (4 * _PART))), 1)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = quantise(_matrix(batch.column(1), dim), low, high, bits)
        ends = np.arange(0, codes.size + 1, dim, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])], names=["id", "cell"])

    place = lambda many, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    queries = rows.where("ask").select("id", "v", place(blocks, 1).alias("qb"), every(stripes).alias("cs"))
    cells = map_batches(rows.select("id", "v"), pack, "id long, cell binary").select("id", "cell", place(stripes, 2).alias("cs"), every(blocks).alias("qb"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, c_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        x = _matrix(left.column("v").combine_chunks(), dim) if left.num_rows else np.zeros((0, dim))
        c = np.frombuffer(b"".join(right.column("cell").to_pylist()), np.uint8).reshape(-1, dim)
        i, ids, lower, upper = scan_cells(x, q_ids, c, c_ids, low, high, bits, k)
        return pa.table({"q": pa.array(q_ids[i]), "id": pa.array(ids), "lower": pa.array(lower), "upper": pa.array(upper)})

    pairs = queries.groupBy("qb", "cs").cogroup(cells.groupBy("qb", "cs")).applyInArrow(scan, "q long, id long, lower double, upper double")
    # over all stripes: the kth smallest upper bound of each query
    best = pairs.withColumn("u", F.row_number().over(Window.partitionBy("q").orderBy("upper", "id")))
    limit = F.min(F.when(F.col("u") == k, F.col("upper"))).over(Window.partitionBy("q"))
    few = best.withColumn("limit", limit).where("limit is null or lower <= limit").select("q", "id", "lower")
    few = cut(few.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("lower", "id"))))
    square = F.aggregate(F.zip_with("v", "w", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)

    def exact(some: DataFrame) -> DataFrame:
        read = some.join(rows.select("id", "v"), "id").join(rows.where("ask").select(F.col("id").alias("q"), F.col("v").alias("w")), "q")
        return read.select("q", "id", F.sqrt(square).alias("distance"))

    first = cut(exact(few.where(F.col("place") <= k)))
    reach = first.groupBy("q").agg(F.max("distance").alias("reach"))
    rest = exact(few.where(F.col("place") > k).join(reach, "q").where("lower <= reach"))
    ranked = first.unionAll(rest).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("id").alias("neighbour_id"), F.round("distance", 6).alias("distance"), F.col("rank").cast("int").alias("rank"))
