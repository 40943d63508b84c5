"""Lines that several documents share, found through sharded minimal perfect hashes.

A line is known by the 128-bit digest of its key: the line without ASCII white space at both ends, A-Z in lower case.
Spark counts the distinct digests; those of at least two documents are dealt to shards of bounded size, and each
shard becomes a minimal perfect hash: a cascade of bit arrays in which a digest sits at the first level where
it alone has hit its bit, so that the number of set bits before it is its place. The place indexes compact arrays: a
64-bit fingerprint that tells strangers apart, the number of documents, and the smallest document id. Documents probe
these arrays; neither lines nor digests are joined with one another.

Probes travel to the shard of their digest, 24 bytes each, and stream past its arrays, so a task holds one shard at a
time. Digests that make up 1/4096 of all probes or more are at most 4,096; their arrays travel with the function instead, and
their probes are spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import slices, stored, texts_of

LEAST_POINTS = 10
SHARD_KEYS = 32_768
HOT_KEYS = 4_096
NO_ID = -(1 << 63)  # stands for a null id, and comes before all others
ARRAYS = ("sizes", "bits", "prints", "counts", "holders")
PROBES = "shard int, kind int, doc bigint, h1 bigint, h2 bigint"
_STEP, _MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and A-Z only


def countable(key: bytes, least: int = LEAST_POINTS) -> bool:
    """Whether a key has enough code points; a code point takes up to four bytes."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


# ---------------------------------------------------------------- minimal perfect hashes


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each digest at a level."""
    x = (h1 ^ np.uint64((level + 1) * _STEP % (1 << 64))) * _MIX[0]
    x = (x ^ (x >> np.uint64(31)) ^ h2) * _MIX[1]
    x ^= x >> np.uint64(29)
    return (x * _MIX[0] >> np.uint64(32)) % np.uint64(size)


@dataclass
class Shard:
    """Minimal perfect hash over distinct digests, with the arrays it indexes."""

    sizes: np.ndarray  # bits per level
    bits: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    holders: np.ndarray

    def __post_init__(self):
        self.before = np.cumsum(self.bits, dtype=np.int64) - self.bits

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, holders: np.ndarray) -> Shard:
        left = np.arange(len(h1))
        sizes, parts, places = [], [], np.zeros(len(h1), dtype=np.int64)
        done = 0
        while len(left):
            size = 2 * len(left)
            slot = _slots(h1[left], h2[left], len(sizes), size).astype(np.int64)
            hits = np.bincount(slot, minlength=size)
            alone = hits[slot] == 1
            level = hits == 1
            places[left[alone]] = done + (np.cumsum(level) - level)[slot[alone]]
            done += int(alone.sum())
            sizes.append(size)
            parts.append(level)
            left = left[~alone]
        order = np.empty(len(h1), dtype=np.int64)
        order[places] = np.arange(len(h1))
        bits = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
        return cls(np.array(sizes, dtype=np.int32), bits, h2[order], counts[order], holders[order])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The place of each digest, or -1 for strangers."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left, offset = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _slots(h1[left], h2[left], level, size).astype(np.int64) + offset
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
            offset += size
            if not len(left):
                break
        known = out >= 0
        out[known] = np.where(self.prints[out[known]] == h2[known], out[known], -1)
        return out

    def dump(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "bits": np.packbits(self.bits).tobytes(), "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "holders": self.holders.tobytes()}

    @classmethod
    def load(cls, raw: dict[str, bytes]) -> Shard:
        sizes = np.frombuffer(raw["sizes"], dtype=np.int32)
        bits = np.unpackbits(np.frombuffer(raw["bits"], dtype=np.uint8))[: int(sizes.sum())].astype(bool)
        return cls(sizes, bits, np.frombuffer(raw["prints"], dtype=np.uint64), np.frombuffer(raw["counts"], dtype=np.uint32), np.frombuffer(raw["holders"], dtype=np.int64))


def _digests(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (batch.column("h1").to_numpy().view(np.uint64), batch.column("h2").to_numpy().view(np.uint64))


def _build(h1: np.ndarray, h2: np.ndarray, n: np.ndarray, first: np.ndarray) -> Shard:
    return Shard.build(h1, h2, np.minimum(n, np.iinfo(np.uint32).max).astype(np.uint32), first)


# ---------------------------------------------------------------- Spark steps


def line_digests(docs: DataFrame, text: str, doc: Column) -> DataFrame:
    """(doc, h1, h2): the distinct digests of each row's lines with enough code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, found = [], []
                for i, t in enumerate(texts_of(part, "text")):
                    keys = {k for k in map(line_key, t.encode().split(b"\n")) if countable(k)}
                    found += map(xxhash.xxh3_128_digest, keys)
                    owner += [i] * len(keys)
                both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                docs_ = part.column("doc").take(pa.array(owner, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([docs_, pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc", "h1", "h2"])

    return docs.select(doc.alias("doc"), F.col(text).alias("text")).mapInArrow(run, "doc bigint, h1 bigint, h2 bigint")


def shared_digests(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, first): digests of at least two documents, their number of rows and smallest id."""
    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    return counts.filter("first <> last").drop("last")


def build_shards(shared: DataFrame, shards: int) -> DataFrame:
    """One row per shard that holds digests: its number and its arrays as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def built() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            made = _build(*_digests(table), table.column("n").to_numpy(), table.column("first").to_numpy()).dump()
            arrays = [table.column("shard").slice(0, 1), *[pa.array([made[c]], type=pa.binary()) for c in ARRAYS]]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", *ARRAYS])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if held and held[0].column("shard")[0].as_py() != int(shard[low]):
                    yield built()
                    held.clear()
                held.append(batch.slice(low, high - low))
        if held:
            yield built()

    keyed = shared.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    return keyed.mapInArrow(run, "shard int, " + ", ".join(f"{c} binary" for c in ARRAYS))


def _send(lines: DataFrame, shards: int, hot: Shard) -> DataFrame:
    """Probes with their shard. Those of hot digests are decided here: repeats get a negative shard, firsts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = _digests(batch)
            doc = batch.column("doc").to_numpy()
            at = hot.find(h1, h2)
            known = at >= 0
            # one remainder of the digest for all shards, one of the document for hot repeats
            shard = np.mod(h1.view(np.int64), shards)
            shard[known] = -1 - np.mod(doc[known] ^ (doc[known] >> 7), HOT_KEYS)
            stay = ~known
            stay[known] = hot.holders[at[known]] != doc[known]
            arrays = [pa.array(shard.astype(np.int32)), pa.array(np.ones(len(doc), dtype=np.int32)), *[batch.column(c) for c in ("doc", "h1", "h2")]]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "kind", "doc", "h1", "h2"]).filter(pa.array(stay))

    return lines.mapInArrow(run, PROBES)


def repeats(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, h1, h2): the probes whose digest another document holds first. A task keeps one shard's arrays at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, arrays = None, None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.union1d(np.flatnonzero(kind == 0), np.flatnonzero(np.diff(shard)) + 1)
            edges = np.union1d(edges, [0, batch.num_rows]).astype(int).tolist()
            for low, high in zip(edges[:-1], edges[1:]):
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    number, arrays = int(shard[low]), Shard.load({c: part.column(c)[0].as_py() for c in ARRAYS})
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                out = part.select(["doc", "h1", "h2"])
                if shard[low] >= 0:
                    if number != int(shard[low]):
                        continue  # no digest of this shard is shared
                    at = arrays.find(*_digests(part))
                    known = at >= 0
                    known[known] = arrays.holders[at[known]] != part.column("doc").to_numpy()[known]
                    out = out.filter(pa.array(known))
                yield out

    rows = index.withColumn("kind", F.lit(0)).unionByName(probes, allowMissingColumns=True).select("shard", "kind", "doc", "h1", "h2", *ARRAYS)
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "doc bigint, h1 bigint, h2 bigint")


def dropped_digests(docs: DataFrame, text: str, doc: Column) -> DataFrame:
    """(doc, h1, h2): per document the digests of lines that it loses."""
    spark = docs.sparkSession
    lines = stored(line_digests(docs, text, doc), "line-digests")
    shared = stored(shared_digests(lines), "shared-lines")
    total = lines.count()
    limit = max(2, -(-total // HOT_KEYS))
    hot = shared.filter(F.col("n") >= limit).toArrow()  # at most HOT_KEYS rows, as their counts add up to no more than total
    h1, h2, n, first = (hot.column(c).to_numpy() for c in ("h1", "h2", "n", "first"))
    cold = shared.filter(F.col("n") < limit)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * tasks, -(-shared.count() // SHARD_KEYS))
    index = stored(build_shards(cold, shards), "line-shards")
    probes = _send(lines, shards, _build(h1.view(np.uint64), h2.view(np.uint64), n, first))
    return repeats(probes, index)


def dedupe_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs``; ``text`` loses the lines that a document with a smaller id holds already.

    Lines count by their keys, and only keys of at least ten code points found in at least two documents count. All
    lines with such a key go, except in the document with the smallest id; the others stay as they are. ``n_lines`` (before) and
    ``n_dropped`` are added; columns of these names are replaced. A null text stays null and is one empty line. Rows with the
    same id are one document, and a null id is an id before all others. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    doc = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    gone = dropped_digests(docs, text, doc).groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))
    joined = docs.select(*names, doc.alias("__doc")).join(gone.withColumnRenamed("doc", "__doc"), "__doc", "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in slices(batch):
                texts, sizes, lost = part.column(text).to_pylist(), [], []
                for i, (t, gone_) in enumerate(zip(texts, part.column("__gone").to_pylist())):
                    data = (t or "").encode()
                    sizes.append(data.count(b"\n") + 1)
                    lost.append(0)
                    if gone_:
                        away = set(np.array([(g["h1"], g["h2"]) for g in gone_], dtype="<i8").view("V16").ravel().tolist())
                        lines = data.split(b"\n")
                        kept = [x for x in lines if digest(line_key(x)) not in away]
                        texts[i] = b"\n".join(kept).decode()
                        lost[-1] = len(lines) - len(kept)
                columns = [pa.array(texts, type=part.column(text).type) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, type=pa.int64()), pa.array(lost, type=pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.select(*names, "__gone").mapInArrow(run, schema + ", n_lines bigint, n_dropped bigint")


def line_digest_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_lines``, ``n_dropped`` and ``kept_sha256`` of each row, by ``dedupe_lines``; a null text counts as empty."""
    out = dedupe_lines(docs.select(key, text), text, key)
    return out.select(key, "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))
