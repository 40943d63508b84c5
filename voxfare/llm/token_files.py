"""Token ids in ORC files, in ascending document order.

The files hold one row per document: id, number of tokens and the ids as an array of integers, which ORC
writes with run-length encoding inside stripes. Row indexes keep minima and maxima per 10,000 rows and Bloom
filters cover the document id, so a reader that wants some documents skips stripes by metadata, and a
reader that wants all of them takes a stripe per task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.llm.common import slices, texts_of
from voxfare.llm.encoding import Encoder
from voxfare.session import shared_dir

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "zstd",
}


def encoded(docs: DataFrame, encoder: Encoder, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (with ``end_id`` after the last) of each row of (doc_id, text), in the same order."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder.open()
        for batch in batches:
            for part in slices(batch):
                ids = [coder.encode(t) + tail for t in texts_of(part, "text")]
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends)), lists], names=["doc_id", "n_tokens", "ids"]
                )

    return docs.mapInArrow(run, "doc_id long, n_tokens int, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, encoder: Encoder, end_id: int = 0, text: str = "text", key: str = "doc_id"
) -> None:
    """Write the token ids of all rows below ``path``; file names ascend with the document id.

    Rows are dealt to ranges of (key, hash of the text), so one key that many rows share does not end in one task;
    rows with a null key come first. A null text is empty and has the end id alone.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = read.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    encoded(ordered.select("doc_id", "text"), encoder, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows: doc_id, n_tokens, ids. Filters on doc_id prune stripes."""
    return spark.read.schema("doc_id long, n_tokens int, ids array<int>").orc(path)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all rows before: the place in the row's file plus the tokens of earlier files.

    Expects ``file`` and ``at`` (place in the file: block and row). Files ascend by name; there are as many as write tasks,
    so the running sum over files is over a small table.
    """
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("__t"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = F.sum("n_tokens").over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("__in", F.coalesce(inside, F.lit(0)))
    return placed.join(bases, "file").withColumn("start", F.col("__base") + F.col("__in"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens and ids_crc32 of each row, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, type=pa.int64()), batch.column("file"), batch.column("at")],
                names=["doc_id", "n_tokens", "ids_crc32", "file", "at"],
            )

    stored = read_tokens(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    rows = stored.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, file string, at struct<block:bigint,row:bigint>")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, encoder: Encoder, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents to ORC files in the shared folder and read the index back.

    Every row of ``docs`` gives one row, in the order of (doc_id, hash of the text), null ids first; repeated rows are
    kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path, encoder, end_id)
    return token_index(spark, path)
