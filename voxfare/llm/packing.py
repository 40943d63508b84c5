"""Packing by non-negative least squares over shallow length combinations.

Every document is cut into full windows and one rest, so only lengths 1..window occur and one histogram of
``window`` numbers describes the corpus, whatever its size. Combinations of up to three lengths that fill a
window (or nearly so) are the columns of a non-negative least-squares problem whose solution says how often each
is used. The counts are rounded down, and the lengths left over are packed greedily, largest first. The plan gives
each length a list of rank intervals; pieces find their sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import SALTS, class_ranks, slices, stored, texts_of
from voxfare.llm.encoding import Encoder

WINDOW = 2048


def combinations_filling(lengths: Sequence[int], counts: np.ndarray, window: int, near: int = 2) -> list[tuple[int, ...]]:
    """Multisets of up to three present lengths whose sum is the window, or short of it by less than ``near``.

    For each length, taken as the largest part: itself alone if it fills, the partners that fill with one more, and
    for two more the partners nearest to halves, thirds and the extremes of what is left, so the number of columns
    stays a small multiple of the number of lengths.
    """
    present = set(lengths)
    ordered = np.array(sorted(present))
    out: set[tuple[int, ...]] = set()
    for big in ordered.tolist():
        for short in range(near):
            rest = window - short - big
            if rest == 0:
                out.add((big,))
            if rest in present:
                out.add(tuple(sorted((big, rest), reverse=True)))
            for aim in (rest // 2, rest // 3, rest // 5, rest // 9):
                at = int(np.searchsorted(ordered, aim))
                for second in ordered[max(0, at - 2) : at + 3].tolist():
                    if rest - second in present:
                        out.add(tuple(sorted((big, second, rest - second), reverse=True)))
    return sorted(out)


def nonnegative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the summed columns close to ``target``.

    Accelerated projected gradient on ||A x - h||^2: A has at most three entries a column, so a round is two sparse
    products. Rows are scaled by the square root of their count so that rare lengths weigh as much as common ones.
    """
    if not columns:
        return np.zeros(0)
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    length = np.concatenate([np.array(c) for c in columns])
    scale = 1 / np.sqrt(np.maximum(target, 1.0))
    goal = target * scale
    weight = scale[length]

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(length, weights=x[owner] * weight, minlength=len(target))

    def backward(r: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=r[length] * weight, minlength=len(columns))

    probe = np.ones(len(columns))
    for _ in range(30):
        probe = backward(forward(probe))
        bound = float(np.linalg.norm(probe))
        probe /= bound or 1.0
    step = 1 / (1.05 * bound)
    x = y = np.zeros(len(columns))
    momentum = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * backward(forward(y) - goal))
        grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / grown * (new - x)
        x, momentum = new, grown
    return x


def greedy_rest(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left, largest first: each pattern takes the longest lengths that still fit and repeats while
    its lengths last, so the number of patterns is bounded by the lengths, not by the pieces."""
    left = left.copy()
    out = []
    while True:
        present = np.flatnonzero(left)
        if not len(present):
            return out
        part, room = [], window
        need: dict[int, int] = {}
        while True:
            fits = present[: int(np.searchsorted(present, room, side="right"))]
            pick = next((int(v) for v in fits[::-1] if need.get(int(v), 0) < left[v]), None)
            if pick is None:
                break
            part.append(pick)
            need[pick] = need.get(pick, 0) + 1
            room -= pick
        times = int(min(left[v] // n for v, n in need.items()))
        for v, n in need.items():
            left[v] -= n * times
        out.append((tuple(part), times))


def pack_plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they hold every piece exactly once."""
    target = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        target[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if target[window]:
        plan.append(((window,), int(target[window])))
        target[window] = 0
    columns = combinations_filling(np.flatnonzero(target).tolist(), target, window)
    solved = nonnegative_least_squares(columns, target.astype(float))
    left = target.copy()
    for at in np.argsort(-solved, kind="stable").tolist():
        times = int(round(solved[at]))
        for v in set(columns[at]):
            times = min(times, int(left[v]) // columns[at].count(v))
        if times > 0:
            for v in columns[at]:
                left[v] -= times
            plan.append((columns[at], times))
    return plan + greedy_rest(left, window)


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each part of each pattern."""
    rows, used, sequence = [], {}, 0
    for part, times in plan:
        offset = 0
        for v in part:
            first = used.get(v, 0)
            rows.append((v, first, first + times, sequence, offset))
            used[v] = first + times
            offset += v
        sequence += times
    return rows


def pieces(docs: DataFrame, encoder: Encoder, end_id: int, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents as token ids with ``end_id`` after the last, cut into windows and a rest."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder.open()
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, t in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
                    ids = coder.encode(t) + tail
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(own) // 4, zlib.crc32(own), total))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=names)

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pack_documents(
    docs: DataFrame, encoder: Encoder, end_id: int = 1, window: int = WINDOW, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """One row per piece: its document, start, length, crc of its ids, the document's tokens, sequence and offset.

    A null text is empty and still has its end id; keys may be null or repeated, each row of ``docs`` is packed
    once. An empty table gives an empty result. Other columns are not read.
    """
    cut = pieces(docs, encoder, end_id, window, text, key)
    cut = stored(cut.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int")), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    table = interval_table(places(pack_plan(histogram, window)))
    ordered = class_ranks(cut, ["length"], "__salt", ["doc_id", "start", "ids_crc32"], "__rank")
    return _placed(ordered, table)


def interval_table(rows: list[tuple[int, int, int, int, int]]) -> dict[int, np.ndarray]:
    """Per length the columns first rank, first sequence and offset, by first rank.

    One entry per part of a pattern: the number of patterns is bounded by the window, not by the corpus.
    """
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in rows:
        parts.setdefault(length, []).append((first, sequence, offset))
    return {v: np.array(sorted(p), dtype=np.int64).T for v, p in parts.items()}


def _placed(ordered: DataFrame, table: dict[int, np.ndarray]) -> DataFrame:
    """Find the interval of each rank in the sorted interval list of its length."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for v in np.unique(length):
                rows = np.flatnonzero(length == v)
                firsts, sequences, offsets = table[int(v)]
                at = np.searchsorted(firsts, rank[rows], side="right") - 1
                sequence[rows] = sequences[at] + rank[rows] - firsts[at]
                offset[rows] = offsets[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names[:5]], pa.array(sequence), pa.array(offset)], names=names
            )

    return ordered.select(*names[:5], "__rank").mapInArrow(run, ", ".join(f"{n} long" for n in names))
