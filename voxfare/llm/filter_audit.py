"""Audit of how filters interact, by decision diagrams of failure masks.

Spark reduces the documents to one row per part and failure mask, at most 2^k masks for k filters. Each part's masks
become a decision diagram: a level per filter, an edge for passing and one for failing it, equal subgraphs shared, and on
each node the weights of the documents below it. In a given order of filters the path of passed filters from the root
shows every step: what hangs on a node of that path passed all filters before it, and its failing side is what the
next filter removes. From one order to the next only two adjacent levels are swapped, so k! orders cost k! swaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.llm.periodic_runs import words_column

MOST_FILTERS = 8


class Diagram:
    """Weighted diagram of failure masks. ``order`` lists the filters from the root down; bit i of a mask is filter i.

    A node is its number; node 0 holds nothing, whatever its level. ``passed``, ``failed`` and ``weight`` give a
    node's sides and the sums of the weights below it; leaves have no sides.
    """

    def __init__(self, filters: int, weights: Mapping[int, Sequence[int]], width: int):
        self.order = list(range(filters))
        self.width = width
        self.passed, self.failed, self.weight = [0], [0], [(0,) * width]
        self._known: dict[tuple, int] = {}
        self.root = self._build(0, 0, weights)

    def _node(self, name: int, passed: int, failed: int, weight: tuple[int, ...] | None = None) -> int:
        """The node of a filter with these sides, made once; leaves go by their weights."""
        if weight is None:
            weight = tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed]))
            key: tuple = (name, passed, failed)
        else:
            key = (name, weight)
        if not passed and not failed and not any(weight):
            return 0
        if key not in self._known:
            self._known[key] = len(self.weight)
            self.passed.append(passed)
            self.failed.append(failed)
            self.weight.append(weight)
        return self._known[key]

    def _build(self, level: int, mask: int, weights: Mapping[int, Sequence[int]]) -> int:
        if level == len(self.order):
            return self._node(-1, 0, 0, tuple(weights.get(mask, self.weight[0])))
        name = self.order[level]
        return self._node(name, self._build(level + 1, mask, weights), self._build(level + 1, mask | 1 << name, weights))

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the next; nodes below stay, nodes above get their new sides."""
        above, below = self.order[level], self.order[level + 1]
        self.order[level], self.order[level + 1] = below, above

        def turned(node: int, depth: int) -> int:
            if not node:
                return 0
            one, two = self.passed[node], self.failed[node]
            if depth < level:
                return self._node(self.order[depth], turned(one, depth + 1), turned(two, depth + 1))
            both = self._node(above, self.passed[one], self.passed[two])
            rest = self._node(above, self.failed[one], self.failed[two])
            return self._node(below, both, rest)

        self.root = turned(self.root, 0)

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) along the path of passed filters."""
        node = self.root
        for name in self.order:
            removed = self.weight[self.failed[node]]
            node = self.passed[node]
            yield name, self.weight[node], removed

    def at(self, mask: int) -> tuple[int, ...]:
        """The weights of one mask."""
        node = self.root
        for name in self.order:
            node = self.failed[node] if mask >> name & 1 else self.passed[node]
        return self.weight[node]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions to swap with the next one, one after another, so that all n! orders are met once: the last element
    sweeps through the others, to and fro, and between sweeps the others take one step of their own."""
    if n < 2:
        return
    inner = adjacent_swaps(n - 1)
    down = True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # after a sweep down the swept element stands in front of the others
        down = not down


def audit_orders(letters: Sequence[str], weights: Mapping[int, Sequence[int]], width: int) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, other weights removed ..., total removed in all orders) for
    every order of the filters. The first weight of a mask is its number of documents."""
    k = len(letters)
    diagram = Diagram(k, weights, width)
    fails = [sum(w[0] for mask, w in weights.items() if mask >> f & 1) for f in range(k)]
    alone = [diagram.at(1 << f)[0] for f in range(k)]
    total = [0] * k
    rows = []

    def note() -> None:
        order = "".join(letters[f] for f in diagram.order)
        for step, (f, kept, removed) in enumerate(diagram.steps(), 1):
            total[f] += removed[0]
            rows.append((order, step, f, kept[0], removed[0], fails[f] - removed[0], alone[f], *removed[1:]))

    note()
    for level in adjacent_swaps(k):
        diagram.swap(level)
        note()
    return [(*r[:2], *r[3:], total[r[2]]) for r in rows]


def failure_mask(conditions: Sequence[Column]) -> Column:
    """Bit i is set where the i-th failure condition holds; a null condition counts as passed."""
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def audit(tally: DataFrame, letters: Sequence[str], lost: Sequence[str], part: str = "part") -> DataFrame:
    """One row per part, order of the filters and step, from a table of one row per part and failure mask.

    ``tally`` has the columns ``part``, mask (int), n and the names ``lost``, sums to report among the removed. A null
    part is a part like others, rows of the same part and mask add up, and an empty table gives an empty result. All orders of
    more than eight filters (8! = 40,320) are refused.
    """
    letters, lost = list(letters), list(lost)
    if len(letters) > MOST_FILTERS:
        raise ValueError(f"{len(letters)} filters have too many orders; audit at most {MOST_FILTERS}")
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{c}_lost" for c in lost], "shapley"]
    schema = f"`{part}` {tally.schema[part].dataType.simpleString()}, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in names[2:])
    once = tally.groupBy(part, "mask").agg(*[F.sum(c).alias(c) for c in ("n", *lost)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # at most 2^k rows
        weights = {int(m): tuple(map(int, w)) for m, *w in pdf[["mask", "n", *lost]].itertuples(index=False)}
        out = pd.DataFrame(audit_orders(letters, weights, 1 + len(lost)), columns=names)
        out.insert(0, part, pdf[part].iloc[0])
        return out

    return once.groupBy(part).applyInPandas(run, schema)


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: few words, repeated words, capitals, odd signs."""
    words = words_column(text)
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """The audit of the filters A to D and E, copy of a text with a smaller id, per part of ``docs``.

    A null text is the empty text, a null part the empty string. Rows with a null id pass E and make no copy of
    others; rows that share the smallest id of a text all pass E. Several labels of an id count as good (toxic) if one
    says so. Other columns are not read; an empty table gives an empty result.

    Copies share their text's mask, so no document is joined to another: rows are counted per digest, mask, part and
    labels with the smallest id among them, and only these counts meet per digest.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    fails = text_conditions(t)
    e = 1 << len(fails)
    read = docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(t, 256)).alias("digest"), failure_mask(list(fails.values())).alias("mask"),
    )
    marks = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    rows = read.groupBy("digest", "part", "mask", "id").agg(F.count(F.lit(1)).alias("n")).join(marks, "id", "left")
    kind = ["digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    groups = rows.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(W.partitionBy("digest"))
    firsts = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = groups.withColumn("firsts", firsts).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("mask", F.col("firsts").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("firsts")).alias("n")))).alias("side"),
    )
    tally = split.groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum("side.n").alias("n"), F.sum(F.col("side.n") * F.col("good")).alias("good"), F.sum(F.col("side.n") * F.col("toxic")).alias("toxic")
    )
    return audit(tally, [*fails, "E"], ["good", "toxic"])
