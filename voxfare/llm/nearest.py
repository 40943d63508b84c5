"""Approximate nearest neighbours by several shifted Hilbert orderings.

Vectors are projected to a few dimensions, differently for each ordering, shifted and put on a grid; the Hilbert key of
the cell orders them. The grid is as fine as the projections are exact, so a tight group is ordered by its own shape too. Rows are ranked in each ordering and dealt to blocks of neighbouring ranks; a query
visits the blocks that its window of ranks touches, and candidates inside the window are measured on the
original vectors. The best of all orderings are merged.

Equal vectors are searched once: a distinct vector carries its smallest ids, so many copies of one vector neither
fill a window nor change which ids win ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.llm.common import class_ranks, slices, stored

#: Projected dimensions, and bits of each: a double resolves no more.
DIMS, BITS = 8, 48
#: Bound of the relative error of a squared distance from products.
ROUNDING = 1e-12
#: Ranges of keys, by which rows are dealt to tasks.
BANDS = 1_024
BLOCK_ROWS = 8_192
#: Rows from which the grid's limits are estimated.
FIT_ROWS = 10_000


@dataclass(frozen=True)
class Ordering:
    """A projection, and the limits and shift of its grid."""

    basis: np.ndarray
    low: np.ndarray
    width: np.ndarray


def fit_orderings(sample: np.ndarray, size: int, orderings: int, seed: int = 11) -> list[Ordering]:
    """Random orthonormal projections; limits from the sample, each grid shifted by up to a fifth of its width."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(orderings):
        basis = np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(DIMS, size)]
        at = sample @ basis
        low, high = np.quantile(at, 0.005, axis=0), np.quantile(at, 0.995, axis=0)
        width = np.where(high > low, (high - low) * 1.2, 1.0)
        found.append(Ordering(basis, low - rng.uniform(0, 1, len(low)) * width / 6, width))
    return found


def hilbert_bits(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of grid cells (rows of integers) along the Hilbert curve through their grid, highest bit first.

    Reflections and exchanges of axes are undone from the highest bit down, then the Gray code is read off.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        high, below = 1 << bit, (1 << bit) - 1
        for i in range(len(axes)):
            flip = (axes[i] & high) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(flip, axes[0] ^ below, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << bit), turn ^ ((1 << bit) - 1), turn)
    return np.stack([(((axis ^ turn) >> bit) & 1).astype(np.uint8) for bit in range(bits - 1, -1, -1) for axis in axes], axis=1)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places as numbers, for grids of less than 64 bits in all."""
    places = hilbert_bits(cells, bits).astype(np.int64)
    return places @ (1 << np.arange(places.shape[1] - 1, -1, -1, dtype=np.int64))


def keys_of(vectors: np.ndarray, order: Ordering) -> np.ndarray:
    """The places as byte strings, which compare from the left."""
    cells = (vectors @ order.basis - order.low) / order.width * (1 << BITS)
    packed = np.packbits(hilbert_bits(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS), axis=1)
    return packed.view(f"S{packed.shape[1]}").ravel()


def band_limits(sample: np.ndarray, order: Ordering) -> np.ndarray:
    """Keys that part the sample into BANDS ranges of about equal size."""
    keys = np.sort(keys_of(sample, order))
    return keys[np.arange(1, BANDS) * len(keys) // BANDS]


def _as_binary(keys: np.ndarray) -> pa.Array:
    size = keys.dtype.itemsize
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def sound_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (doubles) and print (a 128-bit digest) of rows whose vector takes part.

    Rows with a null id, and null, empty, zero, or not wholly finite vectors are left out.
    """
    read = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = read.filter(finite).filter(F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            prints = [xxhash.xxh3_128_hexdigest(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(prints, type=pa.string())], names=["vec_id", "v", "print"])

    return sound.mapInArrow(run, "vec_id long, v array<double>, print string")


def _block_search(k: int, window: int):
    def run(key: tuple, base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "print", "score"]
        if base.empty or asked.empty:
            return pd.DataFrame({c: [] for c in columns})
        x = np.stack(base["v"].to_numpy())
        ranks, prints, norms = base["rank"].to_numpy(), base["print"].to_numpy(), (x * x).sum(axis=1)
        out = []
        for at in range(0, len(asked), 64):
            part = asked.iloc[at : at + 64]
            y = np.stack(part["v"].to_numpy())
            rough = norms[None] - 2 * (y @ x.T)
            rough[np.abs(ranks[None] - part["rank"].to_numpy()[:, None]) > window] = np.inf
            most = min(k + 1, len(x))
            far = np.partition(rough, most - 1, axis=1)[:, most - 1]
            error = ROUNDING * (norms.max() + (y * y).sum(axis=1))  # in a tight group more than the distances
            for i, query in enumerate(part["print"]):
                rows = np.flatnonzero((rough[i] <= far[i] + error[i]) & np.isfinite(rough[i]))
                exact = np.sqrt(((x[rows] - y[i]) ** 2).sum(axis=1))
                for r, s in sorted(zip(rows.tolist(), exact.tolist()), key=lambda p: (p[1], prints[p[0]]))[: k + 1]:
                    out.append((query, prints[r], s))
        return pd.DataFrame(out, columns=columns)

    return run


def nearest(
    df: DataFrame, is_query: str, k: int = 10, orderings: int = 8, share: float = 1 / 12, least_window: int = 512,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row that meets the SQL condition ``is_query`` on ``vec_id``.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance in double precision), ties to the smaller
    vec_id; all candidates, if there are fewer than ``k``. A window reaches ``share`` of the distinct vectors, and at
    least ``least_window`` of them, to either side. Vectors that are null, zero or not wholly finite take no
    part, nor do rows with a null id. Repeated rows count as one. Vectors of another length than the most frequent one
    cannot be compared and take no part. An empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sound = stored(sound_vectors(df, key, vector), "vectors")
    sizes = sound.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    sound = sound.filter(F.size("v") == sizes["size"])
    ids = sound.select("print", "vec_id").distinct().withColumn("at", F.row_number().over(W.partitionBy("print").orderBy("vec_id")))
    members = ids.filter(F.col("at") <= k + 1).groupBy("print").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    queries = sound.filter(is_query).select(F.col("print").alias("query"), F.col("vec_id").alias("query_id")).distinct()
    distinct = sound.groupBy("print").agg(F.first("v").alias("v"), F.max(F.expr(is_query)).alias("asked"))
    distinct = stored(distinct, "distinct-vectors")
    n = distinct.count()
    sample = distinct.orderBy("print").limit(FIT_ROWS).select("v").toPandas()  # prints are digests: a fair sample
    orders = fit_orderings(np.stack(sample["v"].to_numpy()), sizes["size"], orderings)
    window = max(least_window, int(n * share))

    limits = [band_limits(np.stack(sample["v"].to_numpy()), order) for order in orders]

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2_048):
                x = np.stack(part.column("v").to_numpy(zero_copy_only=False)) if part.num_rows else np.zeros((0, sizes["size"]))
                for number, order in enumerate(orders):
                    if len(x):
                        keys = keys_of(x, order)
                        band = np.searchsorted(limits[number], keys, side="right").astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("print"), pa.array(np.full(len(x), number, dtype=np.int32)), pa.array(band), _as_binary(keys)],
                            names=["print", "ordering", "band", "key"],
                        )

    placed = distinct.select("print", "v").mapInArrow(with_keys, "print string, ordering int, band int, key binary")
    # equal keys, if any, are ordered otherwise in each ordering
    order = ["key", F.xxhash64("print", "ordering"), "print"]
    ranked = class_ranks(stored(placed, "hilbert-keys"), ["ordering"], "band", order, "rank").select("print", "ordering", "rank")
    rows = stored(ranked.join(distinct, "print"), "ranked-vectors")
    blocked = rows.select("ordering", F.floor(F.col("rank") / BLOCK_ROWS).alias("block"), "rank", "print", "v")
    first = F.floor(F.greatest(F.lit(0), F.col("rank") - window) / BLOCK_ROWS)
    last = F.floor(F.least(F.lit(n - 1), F.col("rank") + window) / BLOCK_ROWS)
    visits = rows.filter("asked").select("ordering", F.explode(F.sequence(first, last)).alias("block"), "rank", "print", "v")
    asked = visits.toDF("q_ordering", "q_block", "rank", "print", "v")
    found = blocked.groupBy("ordering", "block").cogroup(asked.groupBy("q_ordering", "q_block")).applyInPandas(
        _block_search(k, window), "query string, print string, score double"
    )
    found = found.groupBy("query", "print").agg(F.min("score").alias("score"))
    best = found.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy("score", "print"))).filter(F.col("at") <= 2 * k)
    pairs = best.join(members, "print").select("query", "score", F.explode("ids").alias("vec_id"))
    answers = pairs.join(queries, "query").filter("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
