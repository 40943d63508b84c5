"""SimHash near-duplicates: an inverted index over sets of byte positions.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of their eight bytes,
so they share at least five positional bytes. The index therefore keeps one posting list for each choice
of five byte positions and their values (56 lists per fingerprint): a pair with m equal bytes meets in C(m, 5)
lists, hence exactly the pairs that reach the guaranteed minimum of five meet at all. This stands in for a tally of
shared bytes per pair: lists of single bytes would hold 1/256 of all fingerprints each. Within a list the differing bits of a pair are verified.

Only distinct fingerprints are indexed, so exact copies cost nothing. A list fixes 40 of 64 bits and thus holds
at most 2**24 fingerprints; short lists compare all pairs, long ones look up flipped bits in a table of
2**24 cells, which takes time in proportion to the list. Each list gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import components, map_texts, stored

HASH_SEED = 42
MAX_BITS = 3
POSITION_SETS = list(combinations(range(8), 8 - MAX_BITS))
SHORT_LIST = 64


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash of the lower-cased word shingles, repeats included, as an unsigned number.

    Only A-Z are lower-cased and only ASCII white space parts words. A text of fewer words is one shingle;
    a text without words has fingerprint zero.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), HASH_SEED)
    line = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 65_536):
        ones += np.unpackbits(raw[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``fp`` (the SimHash as a signed long) of each row; null reads as the empty text."""
    return map_texts(
        docs, keep, text, "fp long",
        lambda texts: [pa.array(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))],
    )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint and set of five positions: the list's key and the three other bytes."""
    for batch in batches:
        fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False)).astype("<i8")
        octets = fps.view(np.uint8).reshape(-1, 8)
        for number, chosen in enumerate(POSITION_SETS):
            key = np.full(len(fps), number, dtype=np.int64)
            for at in chosen:
                key = (key << 8) | octets[:, at]
            rest = np.zeros(len(fps), dtype=np.int32)
            for at in (x for x in range(8) if x not in chosen):
                rest = (rest << 8) | octets[:, at]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rest)], names=["key", "rest"])


def _rebuild(keys: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """Fingerprints from list keys and other bytes."""
    out = np.zeros((len(keys), 8), dtype=np.uint8)
    sets = keys >> 40
    for number in np.unique(sets):
        rows, chosen = sets == number, POSITION_SETS[number]
        for place, at in enumerate(reversed(chosen)):
            out[rows, at] = (keys[rows] >> (8 * place)) & 255
        for place, at in enumerate(reversed([x for x in range(8) if x not in chosen])):
            out[rows, at] = (rests[rows] >> (8 * place)) & 255
    return out.view("<i8").ravel()


def _short_links(keys: np.ndarray, rests: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (smaller first) of rows of equal key whose rests differ in few bits; runs are short and sorted."""
    left, right = [], []
    rows, lag = np.arange(len(keys)), 1
    while True:
        rows = rows[rows + lag < len(keys)]
        rows = rows[keys[rows] == keys[rows + lag]]
        if not len(rows):
            break
        near = rows[np.bitwise_count(rests[rows] ^ rests[rows + lag]) <= max_bits]
        left.append(near)
        right.append(near + lag)
        lag += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def long_links(rests: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one long list, in time and output proportional to its length.

    ``best[v]`` is a member at distance one or less of the 24-bit value v. Two members within three bits have a
    value between them, one bit from the one and two bits from the other: the second finds a member near
    that value and links to it. A link found this way is itself verified, so no link is wrong and none that
    joins two members is lost.
    """
    if max_bits != 3:
        raise ValueError("long lists are linked at three bits")
    best = np.full(1 << 24, -1, dtype=np.int32)
    number = np.arange(len(rests), dtype=np.int32)
    ones = [0, *[1 << i for i in range(24)]]
    for mask in ones:
        best[rests ^ mask] = number
    labels = number.astype(np.int64)
    masks = [*ones, *[(1 << i) | (1 << j) for i in range(24) for j in range(i)]]
    while True:  # minimum labels along the links, with pointer jumps
        before = labels.copy()
        for mask in masks:
            other = best[rests ^ mask]
            has = np.flatnonzero((other >= 0) & (np.bitwise_count(rests ^ rests[other]) <= max_bits))
            low = np.minimum(labels[has], labels[other[has]])
            np.minimum.at(labels, other[has], low)
            np.minimum.at(labels, has, low)
        labels = labels[labels]
        if (labels == before).all():
            break
    own = np.flatnonzero(labels != number)
    return labels[own], own


def _link_lists(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(k: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[first, len(k)])
            short = np.repeat((size <= SHORT_LIST) & (size > 1), size)
            pairs = []
            if short.any():
                a, b = _short_links(k[short], r[short], max_bits)
                pairs.append((_rebuild(k[short][a], r[short][a]), _rebuild(k[short][b], r[short][b])))
            for at in np.flatnonzero(size > SHORT_LIST):
                mine = slice(first[at], first[at] + size[at])
                a, b = long_links(r[mine], max_bits)
                pairs.append((_rebuild(k[mine][a], r[mine][a]), _rebuild(k[mine][b], r[mine][b])))
            a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
            b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held_k, held_r = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for batch in batches:
            k = batch.column("key").to_numpy(zero_copy_only=False)
            r = batch.column("rest").to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            if k[0] == k[-1]:  # a single list, which may go on
                if len(held_k[-1]) and held_k[-1][-1] != k[0]:
                    yield linked(np.concatenate(held_k), np.concatenate(held_r))
                    held_k, held_r = [], []
                held_k.append(k)
                held_r.append(r)
                continue
            cut = int(np.searchsorted(k, k[-1]))  # the last list may go on in the next batch
            yield linked(np.concatenate([*held_k, k[:cut]]), np.concatenate([*held_r, r[:cut]]))
            held_k, held_r = [k[cut:]], [r[cut:]]
        last = np.concatenate(held_k)
        if len(last):
            yield linked(last, np.concatenate(held_r))

    return run


def links(distinct: DataFrame, fp: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between different fingerprints at ``max_bits`` or fewer differing bits.

    The links span all components that the full set of links has; long lists give no more than a forest. The
    lists are made for three bits; other values are refused.
    """
    if max_bits != MAX_BITS:
        raise ValueError(f"lists of five bytes find pairs of up to {MAX_BITS} bits, not {max_bits}")
    lists = distinct.select(F.col(fp).alias("fp")).mapInArrow(_postings, "key long, rest int")
    dealt = lists.repartition("key").sortWithinPartitions("key", "rest")
    return dealt.mapInArrow(_link_lists(max_bits), "a long, b long")


def _judged(docs: DataFrame, keep: list[str], text: str, words: int, max_bits: int) -> DataFrame:
    """``keep`` (doc_id among them), fp, root and component_id of each row."""
    prints = stored(fingerprints(docs, text, words, tuple(keep)), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct, "fp", max_bits), "simhash-links")
    classed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classed = stored(classed, "simhash-classes")
    lowest = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classed.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select(*keep, "fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, max_bits: int = MAX_BITS
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key reachable over links) per row.

    Equal fingerprints are linked. A null text counts as empty. Rows with a null key are members like any other and
    never name a component unless it has no other key (then null). Repeated rows come out as often
    as they came in; an empty table gives an empty result. Other columns are not read.
    """
    out = _judged(docs.select(F.col(key).alias("doc_id"), text), ["doc_id"], text, words, max_bits)
    return out.select(
        F.col("doc_id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each near-duplicate component does: the smallest key, and of
    several texts with that key the one with the smallest hash.

    Rows with equal keys and texts are copies, whatever their other columns say, and one of them stays. Rows with a null key
    cannot be told apart and all stay. All columns are returned unchanged. Columns named __text_hash are not allowed.
    """
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    known = hashed.filter(F.col(key).isNotNull())
    judged = _judged(known.select(F.col(key).alias("doc_id"), "__text_hash", text), ["doc_id", "__text_hash"], text, words, max_bits)
    stay = judged.groupBy("root").agg(F.min(F.struct("doc_id", "__text_hash")).alias("row"))
    stay = stay.select(F.col("row.doc_id").alias(key), F.col("row.__text_hash").alias("__text_hash"))
    kept = known.join(stay, [key, "__text_hash"], "left_semi").dropDuplicates([key, "__text_hash"]).select(*docs.columns)
    return kept.unionByName(docs.filter(F.col(key).isNull()))
