"""Repeated passages by content-defined chunks.

A gear rolling hash over the UTF-8 bytes cuts texts where their content says so, hence two texts that share a
passage share the chunks inside it, wherever the passage stands. Chunks are known by a 128-bit digest; the first place of
a digest, in order of document and position, is its holder. All other places are repeats, also those in the holder's own
document, and neighbouring repeats form a run. Runs of at least ``least_run`` bytes are cut out.

Chunks meet in one exchange, dealt to ranges of (digest, document, place), so a digest of very many places is spread over
several ranges. Each range streams past in order and gives its repeats. Where a digest runs over from one range
to the next, the two rows that describe a range's ends tell the later one its holder.

A row is known by its id and the hash of its text: rows that agree in both are one document and are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import chunk_ends, slices, stored

LEAST, NORMAL, MOST = 12, 32, 128
LEAST_RUN = 128
NO_ID = -(1 << 63)  # stands for a null id, and comes before all others


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for part in slices(batch):
            owner, ats, lengths, digests = [], [], [], []
            for i, t in enumerate(part.column("text").to_pylist()):
                data = t.encode()
                ends = chunk_ends(np.frombuffer(data, dtype=np.uint8), LEAST, NORMAL, MOST)
                starts = [0, *ends[:-1]] if ends else []
                digests += [digest(data[a:b]) for a, b in zip(starts, ends)]
                owner += [i] * len(ends)
                ats += starts
                lengths += [b - a for a, b in zip(starts, ends)]
            keys = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = pa.array(owner, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(at), part.column("tag").take(at), pa.array(ats, type=pa.int32()), pa.array(lengths, type=pa.int32()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())],
                names=["doc", "tag", "at", "length", "d1", "d2"],
            )


PLACES = ("doc", "tag", "at")
FIRST, LAST, REPEAT, EARLY = range(4)
_SCANNED = "part int, kind int, d1 bigint, d2 bigint, doc bigint, tag bigint, at int, length int, h_doc bigint, h_tag bigint, h_at int"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of one range, in order of digest and place, with the first place of their digest in the range.

    The range's first digest may have places in ranges before, so all its rows come out, as EARLY. Two rows
    tell the first and the last digest with the holders that this range knows.
    """
    number = TaskContext.get().partitionId()
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in _SCANNED.split(", ")]

    def rows(kind: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip([np.full(len(kind), number), kind, *columns], types)], names=names)

    first = last = None  # (digest, holder) of the range's first digest and of the digest at hand
    before = None  # digest and place of the row before
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2, doc, tag, at, length = (batch.column(c).to_numpy() for c in ("d1", "d2", *PLACES, "length"))
        old = before or (~d1[0], d2[0], doc[0], tag[0], at[0])
        same = np.ones(len(d1), dtype=bool)
        for column, value in zip((d1, d2), old):
            same &= np.concatenate([[value], column[:-1]]) == column
        again = same.copy()  # the same place of the same document: a row that came twice
        for column, value in zip((doc, tag, at), old[2:]):
            again &= np.concatenate([[value], column[:-1]]) == column
        before = tuple(c[-1] for c in (d1, d2, doc, tag, at))
        heads = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1  # -1: the digest of the batch before goes on
        holders = [np.concatenate([[last[1][k] if last else 0], c[heads]])[group + 1] for k, c in enumerate((doc, tag, at))]
        if first is None:
            first = ((d1[0], d2[0]), (doc[0], tag[0], at[0]))
        early = (d1 == first[0][0]) & (d2 == first[0][1])
        out = np.where(early, ~again, same & ~again)
        kind = np.where(early, EARLY, REPEAT)
        yield rows(kind[out], d1[out], d2[out], doc[out], tag[out], at[out], length[out], *[h[out] for h in holders])
        last = ((d1[-1], d2[-1]), tuple(h[-1] for h in holders))
    if first is not None:
        ends = [np.array([f, g]) for f, g in zip((*first[0], *first[1]), (*last[0], *last[1]))]
        yield rows(np.array([FIRST, LAST]), *ends, np.zeros(2), *ends[2:])


def carried(ends: list) -> list[tuple[int, int, int, int]]:
    """(range, holder) of the ranges whose first digest has its holder in a range before."""
    out, before = [], None
    by_part: dict[int, dict] = {}
    for r in ends:
        by_part.setdefault(r["part"], {})[r["kind"]] = ((r["d1"], r["d2"]), (r["h_doc"], r["h_tag"], r["h_at"]))
    for part, told in sorted(by_part.items()):
        first, last = told[FIRST], told[LAST]
        if before and before[0] == first[0]:
            out.append((part, *before[1]))
            if last[0] == first[0]:
                last = before  # the whole range is one digest
        before = last
    return out


def runs(found: list[dict], least_run: int) -> list[tuple[int, int, int]]:
    """(start, end, first document) of runs of adjacent repeats with at least ``least_run`` bytes."""
    out: list[tuple[int, int, int]] = []
    for c in sorted(found, key=lambda c: c["at"]):
        if out and out[-1][1] == c["at"]:
            out[-1] = (out[-1][0], c["at"] + c["length"], out[-1][2])
        else:
            out.append((c["at"], c["at"] + c["length"], c["first"]))
    return [r for r in out if r[1] - r[0] >= least_run]


def on_characters(data: bytes, start: int, end: int) -> tuple[int, int]:
    """The widest span inside [start, end) that splits no character."""
    while start < end and data[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def cut_out(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without the byte spans, and the spans as code points."""
    data, kept, said, before, chars = text.encode(), [], [], 0, 0
    for start, end, first in spans:
        start, end = on_characters(data, start, end)
        piece = data[before:start].decode()
        kept.append(piece)
        chars += len(piece)
        length = len(data[start:end].decode())
        said.append((chars, chars + length, first))
        chars += length
        before = end
    kept.append(data[before:].decode())
    return "".join(kept), said


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, tag, at, length, h_doc): the repeated chunks of a table of doc, tag and text, with the holder's document."""
    spark = docs.sparkSession
    chunks = docs.filter("text is not null").mapInArrow(_chunks, "doc long, tag long, at int, length int, d1 long, d2 long")
    order = ["d1", "d2", *PLACES]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = stored(chunks.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_scan, _SCANNED), "repeats")
    ends = scanned.filter(F.col("kind") <= LAST).collect()  # two rows per range
    over = spark.createDataFrame(carried(ends), "part int, c_doc bigint, c_tag bigint, c_at int")
    early = scanned.filter(F.col("kind") == EARLY).join(F.broadcast(over), "part", "left")  # a row per range at most
    own = (F.col("doc") == F.col("h_doc")) & (F.col("tag") == F.col("h_tag")) & (F.col("at") == F.col("h_at"))
    early = early.filter(F.col("c_doc").isNotNull() | ~own).withColumn("h_doc", F.coalesce("c_doc", "h_doc"))
    columns = [*PLACES, "length", "h_doc"]
    return scanned.filter(F.col("kind") == REPEAT).select(*columns).unionByName(early.select(*columns))


def _with_repeats(docs: DataFrame, text: str, key: str) -> DataFrame:
    """All columns of ``docs`` and ``__found``, the repeated chunks of each row (null: none)."""
    doc, tag = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), F.xxhash64(text)
    first = F.when(F.col("h_doc") != NO_ID, F.col("h_doc")).alias("first")
    found = repeats(docs.select(doc.alias("doc"), tag.alias("tag"), F.col(text).alias("text")))
    found = found.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("at", "length", first)).alias("__found"))
    return docs.withColumns({"__doc": doc, "__tag": tag}).join(found, ["__doc", "__tag"], "left").drop("__doc", "__tag")


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", least_run: int = LEAST_RUN) -> DataFrame:
    """All rows and columns of ``docs``; runs that a document with a smaller id holds already are cut from ``text``.

    Runs that the same document holds further up are cut as well. A column ``n_chars`` is set to the new number of code points of
    texts that were cut. Null texts stay null. A null id comes before all others; of rows with one id and different texts the
    hashes of the texts decide. An empty table gives an empty result. Columns named __doc, __tag or __found are not allowed.
    """
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, found = part.column(text).to_pylist(), part.column("__found").to_pylist()
                spans = [runs(f, least_run) if f else [] for f in found]
                new = [cut_out(t, s)[0] if s else t for t, s in zip(texts, spans)]
                columns = {c: part.column(c) for c in names}
                columns[text] = pa.array(new, type=pa.string())
                if "n_chars" in names:
                    sizes = part.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(new, spans, sizes)], type=part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return _with_repeats(docs, text, key).select(*names, "__found").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", least_run: int = LEAST_RUN) -> DataFrame:
    """One row per run that is cut: ``key``, start and end (code points), and first_doc_id, the holder of its first chunk.

    Nulls, repeated rows and empty tables as in ``without_repeats``; rows that are one document each give its runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, t, f in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("__found").to_pylist()):
                    spans = runs(f, least_run)
                    rows += [(doc, *s) for s in cut_out(t, spans)[1]] if spans else []
                made = [pa.array([r[i] for r in rows], type=pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "end", "first_doc_id"])

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = _with_repeats(read, "text", "doc_id").filter("__found is not null")
    return out.mapInArrow(run, "doc_id long, start long, end long, first_doc_id long").withColumnRenamed("doc_id", key)
