"""CSV, JSON and model stores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructType

from voxfare.session import checkpointed, shared_dir

# Texts that a CSV reader takes for a missing value. Lower-case "none" is text.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
BOM = "﻿"


def null_tokens(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """NULL instead of any missing-value token, in all text columns."""
    out = [
        F.when(~F.col(f.name).isin(*tokens), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*out)


WHOLE, HEAD, MIDDLE, TAIL = range(4)
_PIECES = "file bigint, block bigint, kind int, record string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block of a file from its lines in order, and the pieces of records that other blocks share.

    ``open`` tells whether the block starts inside quotes; ``quotes`` is a line's number of quotes.
    """
    at = None  # the block at hand
    held: list[str] = []  # lines of the record at hand
    odd, whole = 0, True  # inside quotes; the record at hand started in this block

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=["file", "block", "kind", "record"])

    def rest() -> list[tuple]:
        return [(*at, TAIL if whole else MIDDLE, "\n".join(held))] if held else []

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "open", "quotes", "line")]
        for file, block, opened, quotes, line in zip(*columns):
            if at != (file, block):
                if at:
                    out += rest()
                at, held, odd, whole = (file, block), [], opened, not opened
                if block == 0:
                    continue  # the header
            held.append(line)
            odd ^= quotes & 1
            if not odd:
                out.append((file, block, WHOLE if whole else HEAD, held[0] if len(held) == 1 else "\n".join(held)))
                held, whole = [], True
        yield pieces(out)
    if at:
        yield pieces(rest())


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as text (column record), without each file's first line, read in splits.

    A line break inside quotes belongs to its record. Whether a split starts inside quotes follows from the number of quotes before
    it in its file, so one pass counts quotes per split and the next joins lines into records; the few records that run over the
    end of a split are put together last. As in RFC 4180 a quote inside a cell is doubled and stands in quotes. Empty
    lines between records are left out. The counts, one row of 24 bytes per split (20 MB for 100 TB), are broadcast.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), quotes.alias("quotes"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    opened = counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).cast("int").alias("open"))
    pieces = lines.join(F.broadcast(opened), ["file", "block"]).select("file", "block", "open", "quotes", "line").mapInArrow(_pieces, _PIECES)
    pieces = checkpointed(pieces, "csv-pieces")
    order = W.partitionBy("file").orderBy("block", "kind")
    parts = pieces.filter(F.col("kind") != WHOLE).withColumn("chain", F.count_if(F.col("kind") == TAIL).over(order))
    sorted_parts = F.sort_array(F.collect_list(F.struct("block", "kind", "record")))  # the blocks of one record
    joined = parts.groupBy("file", "chain").agg(F.array_join(F.transform(sorted_parts, lambda p: p["record"]), "\n").alias("record"))
    every = pieces.filter(F.col("kind") == WHOLE).select("record").unionByName(joined.select("record"))
    return every.select(F.regexp_replace("record", "\r$", "").alias("record")).filter("record <> ''")


def read_reviews(spark: SparkSession, path: str, schema: StructType, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; missing-value tokens become NULL."""
    options = {"escape": '"', "multiLine": "true"}  # keep line breaks inside quotes as they are
    cells = csv_records(spark, path).select(F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), options).alias("cells"))
    return null_tokens(cells.select("cells.*"), tokens)


def write_csv(df: DataFrame, path: str, bom: bool = False, mode: str = "overwrite") -> None:
    """CSV folder with a header per part file; ``bom`` marks the parts as UTF-8 for spreadsheets.

    Arrays are joined with `` | `` first, as CSV cells hold text only.
    """
    from pyspark.sql.types import ArrayType

    cols = [
        F.array_join(F.col(f.name).cast("array<string>"), " | ").alias(f.name)
        if isinstance(f.dataType, ArrayType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    flat = df.select(*cols)
    if bom:
        flat = flat.withColumnRenamed(flat.columns[0], BOM + flat.columns[0])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_records(spark: SparkSession, path: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """JSON records: one object per line, or with ``multi_line`` one array of objects per file."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Add a batch to the record store; each batch is its own set of files."""
    df.write.mode("append").json(path)


def read_stage(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet between stages, by year where readers filter on it."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a freshly read table out to all cores if it comes in far fewer pieces than cores.

    For text work that costs more than the shuffle of a table of a few files. A table that keeps half the cores
    busy by itself is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() * 2 <= cores else scan


def compact(df: DataFrame, rows_per_part: int = 50_000, least: int = 2_000) -> DataFrame:
    """Cached rows in as few partitions as their number asks for, for fits that pass over them many times: up to one per core
    of at least ``least`` rows each, and more where a partition would hold more than ``rows_per_part``."""
    held = df.persist()
    n = held.count()
    parts = max(1, -(-n // rows_per_part), min(n // least, df.sparkSession.sparkContext.defaultParallelism))
    if parts >= held.rdd.getNumPartitions():
        return held
    small = held.coalesce(parts).persist()
    small.count()
    held.unpersist()
    return small


def gathered(held: DataFrame, rows_per_part: int = 20_000) -> DataFrame:
    """Cached rows in no more partitions than hold ``rows_per_part`` rows each, for fits of many passes that do little per row: starting
    and joining tasks takes most of their time."""
    parts = max(1, -(-held.count() // rows_per_part))
    return held.coalesce(parts) if parts < held.rdd.getNumPartitions() else held


def detached(held: DataFrame) -> DataFrame:
    """Cached rows without the plan that made them, in the same partitions and order, for fits of many short jobs.

    A cached table keeps its plan, and every task of a job over it is sent that plan whole. The rows are written once to
    the checkpoint folder, which all executors share, and cached again from there.
    """
    context = held.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(held.sparkSession, "checkpoints"))
    cut = held.checkpoint().persist()
    cut.count()
    held.unpersist()
    return cut


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Several sources under each other; columns one of them lacks are NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly the given columns, in order; absent ones as NULL text."""
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])


def save_models(path: str, **models: Transformer) -> None:
    """A bundle of fitted models, one pipeline folder per name."""
    for name, model in models.items():
        bundle = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
        bundle.write().overwrite().save(f"{path.rstrip('/')}/{name}")


def load_models(path: str, *names: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path.rstrip('/')}/{name}") for name in names}
