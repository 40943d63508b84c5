"""Ranks, top-k, running sums, exact quantiles and joins that stay distributed on skewed data.

An un-partitioned window sends every row to one task, and a window over a hot key sends that key's
rows to one task. The helpers here reduce first, then work on value ranges:

* ``prefix_sum`` - running sums over any number of distinct values, in ranges with even numbers of them;
* ``exact_quantiles`` - medians and quartiles: counts per range locate the ranks, only their ranges are sorted;
* ``take_lowest`` - exactly n rows per group by hash order, without sorting a group;
* ``salted_join`` - lookup join whose hot keys are spread over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, FloatType

from voxfare.session import checkpointed

SALTS = 16
MAX_LOCAL_ROWS = 20_000


# ---------------------------------------------------------------- joins and set operations

def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Add a costly column that later steps use many times.

    The one-element explode keeps the optimiser from copying its expression into every filter and column
    that refers to it.
    """
    return df.select("*", F.explode(F.array(c)).alias(name))

def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join ``left`` to a right side with one row per key, spreading each key over ``salts`` tasks.

    The right side is repeated ``salts`` times, so a key that holds a third of the left rows is read
    by ``salts`` tasks. The salt is a hash of the whole row, so a task that is run again deals its rows out
    in the same way. Only inner, left, semi and anti joins keep their meaning under repetition.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    salt = "__salt"
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    out = left.withColumn(salt, spread).join(
        right.withColumn(salt, copies), [*on, salt], how
    )
    return out.drop(salt)


def lookup_left(df: DataFrame, other: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join on differently named keys; the right key is dropped."""
    renamed = other.withColumnRenamed(right_key, left_key)
    return salted_join(df, renamed, [left_key], "left")


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return df.join(done.select(key), key, "left_anti")


def among_top(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose key is among the ``k`` most frequent (ties by key)."""
    top = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), key)
        .limit(k)
        .select(key)
    )
    return df.join(F.broadcast(top) if k <= MAX_LOCAL_ROWS else top, key, "left_semi")


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """First row per key by ``order``.

    A minimum over the row struct combines inside each task first, so a key whose copies are a third
    of the table costs one row per task in the shuffle and is never gathered.
    """
    others = [c for c in df.columns if c != order]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in others])).alias("__row")
    return df.groupBy(key.alias("__key")).agg(first).select(*[F.col("__row")[c].alias(c) for c in df.columns])


# ---------------------------------------------------------------- running sums

def bounded_rows(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``max_rows`` rows, else None.

    Never more than ``max_rows`` + 1 rows reach the driver. The size of the result is known to the
    optimiser, which then broadcasts it; callers keep a shuffled way for the other case.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def local_table(spark: SparkSession, ddl: str, rows: Sequence[tuple]) -> DataFrame:
    """A small table of constants that the optimiser knows to be small."""
    names = [c.split()[0] for c in ddl.split(", ")]
    return spark.createDataFrame(pa.table({n: list(v) for n, v in zip(names, zip(*rows))}), ddl)


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a one-row-per-key result table to many rows: broadcast when its checked size allows it,
    salted otherwise."""
    if not on:
        one = table.select(F.struct(*table.columns)).scalar()  # one row: a scalar subquery, not a join
        return df.withColumn("__one", one).select(*df.columns, *[F.col("__one")[c].alias(c) for c in table.columns])
    local = bounded_rows(table)
    if local is not None:
        return df.join(F.broadcast(local), list(on), how)  # size checked above
    return salted_join(df, table, on, how)


def range_buckets(counts: DataFrame, order: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``counts`` with ``__b``, the number of its range in the given order, written once to the shared folder.

    Spark's range exchange samples the rows of ``counts`` itself, one per distinct value, so a value that
    holds most rows of the table behind it weighs no more than any other, and neither does a large group.
    """
    n = buckets or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(n, *order).withColumn("__b", F.spark_partition_id())
    return checkpointed(dealt, "ranges")


def prefix_sum(
    counts: DataFrame,
    value: str,
    weights: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    few: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running totals ``cum_<w>`` and group totals ``total_<w>`` of each weight, in value order.

    ``counts`` holds one row per (by, value), without NULL keys. Each task sums inside one range of (by, value), and range
    totals, a small table, give the starting points. With ``few`` a group is summed in one task: right for
    values known to be few, such as a ten-point scale.
    """
    by = list(by)
    order = F.desc(value) if descending else F.asc(value)
    if few:
        run = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return counts.select(
            "*",
            *[F.sum(w).over(run).alias(f"cum_{w}") for w in weights],
            *[F.sum(w).over(W.partitionBy(*by)).alias(f"total_{w}") for w in weights],
        )
    keyed = range_buckets(counts, [*by, value], buckets)
    inside = W.partitionBy(*by, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = keyed.select("*", *[F.sum(w).over(inside).alias(f"cum_{w}") for w in weights])
    totals = keyed.groupBy(*by, "__b").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    before = W.partitionBy(*by).orderBy(F.desc("__b") if descending else F.asc("__b")).rowsBetween(
        W.unboundedPreceding, -1
    )
    starts = totals.select(
        *by,
        "__b",
        *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__s_{w}") for w in weights],
        *[F.sum(f"__t_{w}").over(W.partitionBy(*by)).alias(f"total_{w}") for w in weights],
    )
    return local.join(starts, [*by, "__b"]).select(
        *counts.columns,
        *[(F.col(f"cum_{w}") + F.col(f"__s_{w}")).alias(f"cum_{w}") for w in weights],
        *[f"total_{w}" for w in weights],
    )


def with_value(df: DataFrame, c: str) -> DataFrame:
    """Rows where a column holds a value: neither NULL nor, in a floating-point column, NaN."""
    kept = df.filter(F.col(c).isNotNull())
    return kept.filter(~F.isnan(c)) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else kept


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """One row per (by, value) with its number of rows; NULL keys and missing values are left out."""
    kept = with_value(df.select(*by, value), value)
    for c in by:
        kept = kept.filter(F.col(c).isNotNull())
    return kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias(name))


# Groups up to this size are one range; for larger ones the margin, as a share of the ranks around a wanted one, is ten times
# the error of the sketch and holds five ranks at least. Each such range is cut into equal widths.
SMALL_GROUP, MARGIN, SKETCH, WIDTHS = 5_000, 1e-3, 10_000, 64


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, plus ``n``, ``min`` and ``max``.

    A sketch brackets each wanted rank. A second pass counts the rows between the brackets, and the values inside them by
    narrow ranges; these counts show in which range a wanted rank lies, and only its values are sorted. NULL keys and missing
    values are left out. An empty table gives no group, or one row of NULLs and n = 0 where there are no keys.
    """
    by = list(by)
    rows = with_value(df.select(*by, F.col(value).cast("double").alias("__v")), "__v")
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    ends = [min(1.0, max(0.0, p + side)) for p in probs.values() for side in (-MARGIN, MARGIN)]
    shape = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", ends, SKETCH).alias("__q")
    )
    v, small = F.col("__v"), F.col("__n") <= SMALL_GROUP
    bounds = {}
    for k in range(len(probs)):
        bounds[f"__low{k}"] = F.when(small, F.col("__min")).otherwise(F.col("__q")[2 * k])
        bounds[f"__high{k}"] = F.when(small, F.col("__max")).otherwise(F.col("__q")[2 * k + 1])
    shape = shape.select(*by, "__min", "__max", *[c.alias(name) for name, c in bounds.items()])
    zone, width = F.lit(0), F.lit(-1).cast("bigint")
    for k in range(len(probs)):
        low, high = F.col(f"__low{k}"), F.col(f"__high{k}")
        zone = zone + (v >= low).cast("int") + (v > high).cast("int")
        part = F.when(high > low, F.floor((v - low) / (high - low) * WIDTHS)).otherwise(0)
        width = F.when((v >= low) & (v <= high), part).otherwise(width)
    place = ["__zone", "__width"]
    tagged = attach(rows, shape, by).select(*by, "__v", "__min", "__max", zone.alias("__zone"), width.alias("__width"))
    inside = F.when(F.col("__width") >= 0, v).alias("__v")
    limits = [F.max("__min").alias("__min"), F.max("__max").alias("__max")]
    counts = tagged.groupBy(*by, *place, inside).agg(F.count(F.lit(1)).alias("__c"), *limits)
    ranges = counts.groupBy(*by, *place).agg(F.sum("__c").alias("__size"), *limits)
    before = W.partitionBy(*by).orderBy(*place).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *by, *place, "__size", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(W.partitionBy(*by)).alias("__n"),
        *[F.max(c).over(W.partitionBy(*by)).alias(c) for c in ("__min", "__max")],
    )
    spot = {name: F.lit(float(p)) * (F.col("__n") - 1) for name, p in probs.items()}
    ranks = F.array(*[f(x) for x in spot.values() for f in (F.floor, F.ceil)])
    wanted = ranges.filter(F.exists(ranks, lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size")))).drop("__size")
    upto = W.partitionBy(*by, *place).orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    run = counts.drop("__min", "__max").join(wanted, [*by, *place]).withColumn("__cum", F.col("__start") + F.sum("__c").over(upto))
    aggs = [F.coalesce(F.max("__n"), F.lit(0)).alias("n"), F.max("__min").alias("min"), F.max("__max").alias("max")]
    for name, x in spot.items():
        low, high = F.floor(x), F.ceil(x)
        at_low, at_high = (F.max(F.when((r >= F.col("__cum") - F.col("__c")) & (r < F.col("__cum")), v)) for r in (low, high))
        exact = F.when(at_low == at_high, at_low).otherwise(at_low + F.max(x - low) * (at_high - at_low))
        missed = F.raise_error(F.lit(f"the sketch of {value} missed the rank of {name}")).cast("double")
        aggs.append(F.when(exact.isNotNull() | (F.count("__n") == 0), exact).otherwise(missed).alias(name))
    return run.groupBy(*by).agg(*aggs)


# ---------------------------------------------------------------- ranks and limits

def dense_ranks(freqs: DataFrame, measure: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the dense rank, from the largest frequency, to a table of frequencies.

    Only the distinct frequencies are ranked, and the ranks come back by a join. Frequencies of N rows take at most the
    square root of 2N distinct values (1.5 million for a trillion rows), so their table is small enough to rank in one place
    and to broadcast, whatever the table. For other measures use ``prefix_sum``.
    """
    levels = freqs.select(*by, measure).distinct()
    ranked = levels.withColumn(name, F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc(measure))))
    return freqs.join(F.broadcast(ranked), [*by, measure])  # size proven above


def row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Number the rows of a small finished table (feature lists, model tables)."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def top_k(df: DataFrame, measure: str, key: Sequence[str], k: int, descending: bool = True) -> DataFrame:
    """The k best rows; ties by key."""
    first = F.desc_nulls_last(measure) if descending else F.asc_nulls_last(measure)
    return df.orderBy(first, *key).limit(k)


def top_bottom(df: DataFrame, measure: str, key: Sequence[str], k: int) -> DataFrame:
    """The k best and the k worst rows; a key that is in both lists shows once.

    Both limits read the same reduced table; 2k rows reach the final de-duplication.
    """
    both = union_all(top_k(df, measure, key, k), top_k(df, measure, key, k, descending=False))
    return both.dropDuplicates(list(key))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group.

    ``row_number() <= k`` plans a partial group limit in every task before the shuffle, so a hot group
    sends at most k rows per task.
    """
    num = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", num).filter(F.col("__rn") <= k).drop("__rn")


def hash_order(key: str, seed: int) -> Column:
    """A fixed random order of rows: the hex digest of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def take_lowest(df: DataFrame, by: Sequence[str], key: str, seed: int, quota: Column) -> DataFrame:
    """Flag in ``__taken`` exactly ``quota`` rows of each group, the first in hash order of a unique key.

    ``quota`` may use ``__size``, the number of rows in the group. Counts per hash bucket show the bucket
    in which each quota runs out; only the rows of that bucket, one in 65,536, are ordered to find the
    last hash to take. The rows themselves are never shuffled: the flag is a comparison with one
    threshold per group.
    """
    by = list(by)
    by_key = [F.coalesce(F.col(b).cast("string"), F.lit("\\N")).alias(f"__k_{b}") for b in by]
    keys = [f"__k_{b}" for b in by]
    hashed = df.select("*", *by_key, hash_order(key, seed).alias("__h")).withColumn("__hb", F.substring("__h", 1, 4))
    sizes = hashed.groupBy(*keys, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(*keys).orderBy("__hb").rowsBetween(W.unboundedPreceding, 0)
    reached = F.col("__cum") >= F.col("__quota")
    edge = (
        sizes.withColumn("__cum", F.sum("__n").over(upto))
        .withColumn("__size", F.sum("__n").over(W.partitionBy(*keys)))
        .withColumn("__quota", F.least(quota.cast("bigint"), F.col("__size")))
        .groupBy(*keys)
        .agg(
            F.min(F.when(reached, F.col("__hb"))).alias("__edge"),
            F.min_by(F.col("__quota") - F.col("__cum") + F.col("__n"), F.when(reached, F.col("__hb"))).alias("__need"),
        )
    )
    on_edge = attach(hashed.select(*keys, "__h", "__hb"), edge, keys).filter(F.col("__hb") == F.col("__edge"))
    placed = on_edge.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy("__h")))
    last = placed.filter(F.col("__rn") <= F.col("__need")).groupBy(*keys).agg(F.max("__h").alias("__last"))
    flagged = attach(hashed, last, keys, "left")
    return flagged.select(*df.columns, F.coalesce(F.col("__h") <= F.col("__last"), F.lit(False)).alias("__taken"))


def deal_folds(df: DataFrame, by: Sequence[str], key: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Deal each group's rows, in hash order of a unique key, to folds of equal size: of n rows in a group, fold f (from 0)
    gets those of rank above floor(f n / folds) up to floor((f + 1) n / folds).

    As in ``take_lowest``, counts per hash bucket show where the folds part; only the rows of those buckets are ordered,
    and the fold of a row is the number of such limits below its hash. A NULL group is a group of its own.
    """
    by = list(by)
    keys = [f"__k_{b}" for b in by]
    by_key = [F.coalesce(F.col(b).cast("string"), F.lit("\\N")).alias(k) for b, k in zip(by, keys)]
    hashed = df.select("*", *by_key, hash_order(key, seed).alias("__h")).withColumn("__hb", F.substring("__h", 1, 4))
    sizes = hashed.groupBy(*keys, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    upto = W.partitionBy(*keys).orderBy("__hb").rowsBetween(W.unboundedPreceding, 0)
    told = sizes.withColumn("__cum", F.sum("__n").over(upto)).withColumn("__size", F.sum("__n").over(W.partitionBy(*keys)))
    limits = told.select("*", F.explode(F.sequence(F.lit(1), F.lit(folds - 1))).alias("__f")).withColumn("__rank", F.floor(F.col("__f") * F.col("__size") / folds))
    before = F.col("__cum") - F.col("__n")
    edges = limits.filter((F.col("__rank") > before) & (F.col("__rank") <= F.col("__cum"))).select(*keys, "__hb", "__f", (F.col("__rank") - before).alias("__need"))
    near = attach(hashed.select(*keys, "__h", "__hb"), edges.groupBy(*keys, "__hb").agg(F.collect_list(F.struct("__f", "__need")).alias("__e")), [*keys, "__hb"])
    placed = near.withColumn("__rn", F.row_number().over(W.partitionBy(*keys, "__hb").orderBy("__h")))
    last = placed.select(*keys, "__h", "__rn", F.explode("__e").alias("__x")).filter(F.col("__rn") == F.col("__x.__need"))
    ends = last.groupBy(*keys).agg(F.collect_list(F.struct("__h", F.col("__x.__f").alias("__f"))).alias("__ends"))
    totals = told.groupBy(*keys).agg(F.max("__size").alias("__size"))
    dealt = attach(hashed, totals.join(ends, keys, "left") if keys else totals.select("*", ends.scalar().alias("__ends")), keys)
    # limits at rank 0, of groups smaller than the number of folds, lie below every row
    empty = F.size(F.filter(F.sequence(F.lit(1), F.lit(folds - 1)), lambda f: f * F.col("__size") < folds))
    passed = F.size(F.filter(F.coalesce(F.col("__ends"), F.array()), lambda e: e["__h"] < F.col("__h")))
    return dealt.select(*[c for c in df.columns if c != name], (empty + passed).cast("int").alias(name))
