"""Periodic runs of words, by longest common extensions from suffix trees.

A run is a stretch with smallest period q that is at least 4 q (and 6) words long and that no neighbouring word
extends. Every run holds a Lyndon root: the longest Lyndon word at some position, in the order of the alphabet or in
its reverse, and its length is the period. So two candidates per position suffice: the distance to the next smaller
and to the next greater suffix. Each candidate is extended to both sides by longest common extensions: forward from
the suffix tree of the document, backward from that of its reversal. Both trees are built by Ukkonen's algorithm; an
Euler tour lists the leaves with the depth of the lowest common ancestor of neighbours, and a sparse table of range
minima over these depths answers the ancestor of any two leaves in constant time.

All words of a run stand in it four times or more. Words rarer than that inside their stretch of the document
separate it first, which loses no run and leaves most prose without any tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import slices, texts_of

LEAST_LENGTH, LEAST_TURNS = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """The suffix tree of a list of symbols from 1 on, closed by the symbol 0, built by Ukkonen's algorithm.

    Node 0 is the root. ``starts`` and ``ends`` give each node's edge as a span of the list; ``child`` maps
    node * width + first symbol to a node.
    """

    def __init__(self, symbols: list[int], width: int):
        self.text = s = [*symbols, 0]
        self.width = width
        n = len(s)
        self.starts, self.ends, links = [0], [0], [0]
        self.child = child = {}
        starts, ends = self.starts, self.ends
        node = edge = length = left = 0
        for i, c in enumerate(s):
            waiting = 0  # an inner node without its suffix link
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(starts)
                    starts.append(i)
                    ends.append(n)
                    links.append(0)
                    if waiting:
                        links[waiting] = node
                        waiting = 0
                else:
                    at = starts[below]
                    end = ends[below]
                    size = (end if end <= i else i + 1) - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if s[at + length] == c:
                        length += 1
                        if waiting:
                            links[waiting] = node
                        break
                    inner = len(starts)
                    child[key] = inner
                    child[inner * width + c] = inner + 1
                    child[inner * width + s[at + length]] = below
                    starts += (at, i)
                    ends += (at + length, n)
                    links += (0, 0)
                    starts[below] = at + length
                    if waiting:
                        links[waiting] = inner
                    waiting = inner
                left -= 1
                if node:
                    node = links[node]
                elif length:
                    length -= 1
                    edge = i - left + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in the order of an Euler tour over sorted children, and for each the least depth (in symbols)
        that the tour has passed since the leaf before: the depth of their lowest common ancestor."""
        keys = np.fromiter(self.child, dtype=np.int64, count=len(self.child))
        order = np.argsort(keys)
        below = np.fromiter(self.child.values(), dtype=np.int64, count=len(keys))[order].tolist()
        first = np.searchsorted(keys[order], np.arange(len(self.starts) + 1, dtype=np.int64) * self.width).tolist()
        starts, ends = self.starts, self.ends
        suffixes, depths = [], []
        todo = [(0, 0, 0)]  # node, depth above its edge, least depth since the last leaf
        while todo:
            node, above, least = todo.pop()
            low, high = first[node], first[node + 1]
            if low == high:
                suffixes.append(starts[node] - above)
                depths.append(least)
                continue
            depth = above + ends[node] - starts[node]
            todo += [(below[k], depth, depth) for k in range(high - 1, low, -1)]
            todo.append((below[low], depth, least))
        return np.array(suffixes), np.array(depths)


class Extensions:
    """Longest common extensions of any two positions in constant time, for whole arrays of positions at once."""

    def __init__(self, symbols: list[int], width: int):
        suffixes, depths = SuffixTree(symbols, width).tour()
        n = len(suffixes)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[suffixes] = np.arange(n)
        levels = [depths.astype(np.int32)]
        step = 1
        while 2 * step < n:
            last = levels[-1]
            longer = last.copy()
            np.minimum(last[:-step], last[step:], out=longer[:-step])
            levels.append(longer)
            step *= 2
        self.table = np.stack(levels)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal symbols from positions ``a`` and ``b`` on; the two differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level)])


def next_beyond(rank: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each position the next one with a smaller rank, and the next one with a greater (none: the length)."""
    n = len(rank)
    smaller, greater = [n] * n, [n] * n
    rising, falling = [], []
    for i, r in enumerate(rank):
        while rising and rank[rising[-1]] > r:
            smaller[rising.pop()] = i
        rising.append(i)
        while falling and rank[falling[-1]] < r:
            greater[falling.pop()] = i
        falling.append(i)
    return np.array(smaller), np.array(greater)


def runs_of_stretch(ids: np.ndarray, least: int = LEAST_LENGTH, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of symbols, by start and period. ``turns`` is at least 3."""
    n = len(ids)
    names, symbols = np.unique(ids, return_inverse=True)
    symbols = symbols + 1
    width = len(names) + 1
    forward = Extensions(symbols.tolist(), width)
    smaller, greater = next_beyond(forward.rank[:n].tolist())
    at = np.tile(np.arange(n), 2)
    other = np.concatenate([smaller, greater])
    inside = other < n
    at, other = at[inside], other[inside]
    period = other - at
    right = forward.common(at, other)
    # the leftmost root of a run starts within its first period, so all but two periods lie to the right of it
    likely = right > (turns - 2) * period
    if not likely.any():
        return []
    at, other, period, right = at[likely], other[likely], period[likely], right[likely]
    backward = Extensions(symbols[::-1].tolist(), width)
    left = np.zeros(len(at), dtype=np.int64)
    back = at > 0  # position i stands at n - 1 - i in the reversal
    left[back] = backward.common(n - at[back], n - other[back])
    start, end = at - left, other + right
    long = end - start >= np.maximum(least, turns * period)
    best: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[long].tolist(), end[long].tolist(), period[long].tolist()):
        best[s, e] = min(p, best.get((s, e), p))
    return sorted((s, e - s, p) for (s, e), p in best.items())


def stretches(ids: np.ndarray, least: int = LEAST_LENGTH, turns: int = LEAST_TURNS) -> Iterator[tuple[int, int]]:
    """Spans whose words all stand ``turns`` times or more in their span; every run lies inside one of them."""
    todo = [(0, len(ids))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = ids[low:high]
        counts = np.bincount(part)
        rare = np.flatnonzero(counts[part] < turns)
        if not len(rare):
            yield low, high
            continue
        edges = np.concatenate([[-1], rare, [high - low]])
        for k in np.flatnonzero(np.diff(edges) > least).tolist():
            todo.append((low + int(edges[k]) + 1, low + int(edges[k + 1])))


def runs_of(ids: np.ndarray, least: int = LEAST_LENGTH, turns: int = LEAST_TURNS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's words, by start and period."""
    found = []
    for low, high in stretches(ids, least, turns):
        found += [(low + s, length, p) for s, length, p in runs_of_stretch(ids[low:high], least, turns)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: no run holds it after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_words``, ``runs`` (start, length, period in words, by start and period) and ``collapsed``, the words
    outside the repeated parts of runs, joined by one space.

    Words are the stretches between ASCII white space. A null or empty text has no words, no runs and an empty
    ``collapsed``. Each row stands for itself, whatever its id: null ids and repeated rows stay as they are. Other
    columns are not read, an empty table gives an empty result, and a text is worked on as a whole in one task.
    """

    kept = docs.select(key, F.col(text).alias("__text"))
    names = [key, "n_words", "runs", "collapsed"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, found, rest = [], [], []
                for t in texts_of(part, "__text"):
                    words = t.encode().split()
                    number: dict[bytes, int] = {}
                    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
                    runs = runs_of(ids)
                    if runs:
                        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                    sizes.append(len(ids))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    rest.append(b" ".join(words).decode())
                made = [pa.array(sizes, type=pa.int64()), pa.array(found, type=_RUNS_ARROW), pa.array(rest, type=pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(key), *made], names=names)

    return kept.mapInArrow(find, f"`{key}` {kept.schema[key].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")


def words_column(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")


def with_periods(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text``; a tenth of the texts, by crc32 of the id, gets a periodic end, the others stay.

    With h = crc32 of the decimal id, g = h // 10 and n words, a text with h % 10 = 0 repeats from word a = g % n on
    with period 1 + (n - a) // (3 + g % 8). Texts with a null id and texts without words stay as they are.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.greatest(F.size("words"), F.lit(1)).cast("long")
    chosen = docs.select(key, F.col(text).alias("text"), g.alias("g"), F.when(h % 10 == 0, words_column(F.col(text))).alias("words"))
    a = F.col("g") % n
    p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
    turned = F.concat(
        F.slice("words", 1, a.cast("int")),
        F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get("words", (a + i % p).cast("int"))),
    )
    return chosen.select(key, F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias(text))


def run_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` with periodic ends: the number of runs, the longest run and digests of runs and kept words.

    Nulls, repeats and empty tables as in ``periodic_runs`` and ``with_periods``.
    """
    found = periodic_runs(with_periods(docs, text, key), text, key)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), F.array_max(ranked).alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("top.length"), -F.col("top.period")
    return out.select(
        key, "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
