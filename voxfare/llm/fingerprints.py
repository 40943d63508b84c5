"""Document fingerprints from content-defined chunks.

The fingerprint of a text is the set of its chunks, each as a digest of 40 bits and a length of one byte,
written as hex in ascending order. Chunks end where the gear hash of the content says so, with normalised sizes, so an
insertion changes the chunks around it and no others. The likeness of a text to another is the share of its bytes
that lie in chunks which the other has too: containment weighted by length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.llm.common import chunk_ends, slices, texts_of

LEAST, NORMAL, MOST = 12, 32, 255
DIGEST_BYTES = 5

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def chunk_set(text: str) -> frozenset[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    ends = chunk_ends(np.frombuffer(data, dtype=np.uint8), LEAST, NORMAL, MOST)
    digest = xxhash.xxh3_64_digest
    return frozenset([digest(data[a:b])[:DIGEST_BYTES] + bytes([b - a]) for a, b in zip([0, *ends], ends)])


def fingerprint(chunks: frozenset[bytes]) -> bytes:
    return b"".join(sorted(chunks))


def weight(chunks: frozenset[bytes]) -> int:
    return sum(c[DIGEST_BYTES] for c in chunks)


def likeness(one: frozenset[bytes], other: frozenset[bytes]) -> float:
    """Share of the bytes of ``one`` in chunks that ``other`` has; two empty sets are alike, an empty and another not."""
    if not one:
        return float(not other)
    return weight(one & other) / weight(one)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def judged(doc: int, text: str, own: frozenset[bytes], following: str, next_set: frozenset[bytes]) -> tuple:
    new = edited(text, following)
    new_set = chunk_set(new)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc, len(text), sha, fingerprint(own), fingerprint(new_set), likeness(own, new_set), likeness(own, next_set))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=NAMES)


def _along_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge each row of a range by the one after it; the last row, which has none here, is left out."""
    held = None
    for batch in batches:
        for part in slices(batch, 64):
            out = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
                own = chunk_set(text)
                if held is not None:
                    out.append(judged(*held, text, own))
                held = (doc, text, own)
            yield _rows(out)


def _range_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the number of the range, its first text, and the id and text of its last row."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1)
    if last is not None:
        yield pa.RecordBatch.from_arrays([first.column("seg"), first.column("text"), last.column("doc_id"), last.column("text")], names=["seg", "opening", "doc_id", "closing"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 16):
            yield _rows([judged(d, t, chunk_set(t), n, chunk_set(n)) for d, t, n in zip(part.column("doc_id").to_pylist(), texts_of(part, "closing"), texts_of(part, "following"))])


def fingerprint_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and the likeness to the edited and the next text.

    The next text is that of the next row in ascending (``key``, hash of the text), nulls first; the first follows the
    last. A null text is empty: its fingerprint is the empty string. Repeated rows each give a row. A single row
    follows itself; an empty table gives an empty result. Other columns are not read.

    Texts cross the network once, dealt to ranges of the key. Two branches of one plan read this exchange: one judges all rows of
    a range but the last, the other finds the ends of the ranges, and only these few texts meet again.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ordered = read.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    inner = ordered.select("doc_id", "text").mapInArrow(_along_range, OUT)
    ends = ordered.select("doc_id", "text", F.spark_partition_id().alias("seg")).mapInArrow(_range_ends, "seg int, opening string, doc_id long, closing string")
    by_range = W.orderBy("seg")  # one row per range
    following = F.coalesce(F.lead(F.coalesce("opening", F.lit(""))).over(by_range), F.first(F.coalesce("opening", F.lit(""))).over(by_range))
    last = ends.select("doc_id", "closing", following.alias("following")).mapInArrow(_edges, OUT)
    written = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return inner.unionByName(last).withColumns(written).withColumnRenamed("doc_id", key)
