"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.session import checkpointed

SALTS = 64


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps survive lost executors."""
    return checkpointed(df, purpose)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings; null reads as the empty text."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of a batch, so that Python objects of few rows are alive at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_texts(
    df: DataFrame, keep: Sequence[str], text: str, ddl: str, make: Callable[[list[str]], Iterable[pa.Array]]
) -> DataFrame:
    """Columns computed from a text column in Arrow batches, beside the columns ``keep``.

    ``ddl`` names and types the new columns; ``make`` returns their arrays for a list of texts.
    """
    kept = df.select(*keep, F.col(text).alias("__text"))
    names = [*keep, *[c.strip().split()[0] for c in ddl.split(",")]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [ddl])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = list(make(texts_of(part, "__text")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *made], names=names)

    return kept.mapInArrow(run, schema)


def class_ranks(df: DataFrame, by: Sequence[str], salt: str, order: Sequence[Column | str], name: str) -> DataFrame:
    """Number the rows of each class from 0 without gathering a class in one task.

    ``salt`` is a stored column that spreads each class over many groups: rows are numbered inside
    (class, salt), and a table of at most classes x salts counts gives each group its first number.
    """
    by = list(by)
    sizes = df.groupBy(*by, salt).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*by).orderBy(salt).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, salt, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = df.withColumn("__rn", F.row_number().over(W.partitionBy(*by, salt).orderBy(*order)))
    ranked = inside.join(starts, [*by, salt])
    return ranked.select(*df.columns, (F.col("__rn") - 1 + F.col("__start")).cast("long").alias(name))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """Connected components of an edge list (a long, b long): one row (node, root) per node with a link.

    ``root`` is the smallest node of the component. Alternating large-star and small-star rounds hang
    every node below smaller ones until all hang on their root; the number of rounds grows with the
    logarithm of the component size. Each round is written to the shared folder. A node with very many
    neighbours costs one partial minimum per task; the joins that follow are ones that AQE can split.
    Loops and repeated edges do no harm; an edge with a null end is left out.
    """
    current = stored(edges.filter("a is not null and b is not null and a <> b").select(*_ordered()).distinct(), purpose)
    seen = None
    while True:
        mark = current.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        low = low.select("n", F.least("m", "n").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        hung = large.join(down, F.col("b") == F.col("n"))
        small = hung.select(F.col("m").alias("a"), F.col("a").alias("b")).union(hung.select(F.col("m").alias("a"), "b"))
        current = stored(small.filter("a <> b").distinct(), purpose)
    nodes = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return nodes.union(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _ordered() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


GEAR_SEED = 20_260_101


def gear_table(seed: int = GEAR_SEED) -> np.ndarray:
    """One random 16-bit number per byte value, from a fixed seed."""
    return np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash after each byte: the sum of table[byte] << age over the last 16 bytes.

    The sum over 16 bytes is built by doubling: 2, 4, 8, 16 bytes.
    """
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        if len(h) > width:
            h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_ends(data: np.ndarray, least: int, normal: int, most: int) -> list[int]:
    """End positions of content-defined chunks with normalised sizes.

    A boundary lies after a byte where the top bits of the gear hash are zero: before ``normal`` bytes two
    bits more are asked for than after it, so sizes gather around ``normal``; ``least`` and ``most`` bound them.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    bits = max(1, int(normal - least).bit_length() - 1)
    h = gear_hashes(data)
    easy = np.flatnonzero(h < np.uint16(1 << (16 - bits + 1)))
    hard = (h[easy] < np.uint16(1 << (16 - bits - 1))).tolist()
    ends, start = [], 0
    for at, strict in zip((easy + 1).tolist(), hard):
        size = at - start
        while size > most:
            start += most
            ends.append(start)
            size = at - start
        if size >= least and (strict or size >= normal):
            ends.append(at)
            start = at
    while n - start > most:
        start += most
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends
