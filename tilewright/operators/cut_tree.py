"""Owners of cells under layouts of very many rectangles, by walking the tree of their cuts.

A layout made by cuts can be taken apart by lines that cross no rectangle. The tree of these lines is
one flat table, with an entry per rectangle, so it goes into the plan as a literal where a
table of bands and strips would be too large; a row walks it from the root in as many steps as the tree
is deep.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.session import literal_array

Box = tuple[int, int, int, int, int]


@dataclass(frozen=True)
class CutTree:
    """Node k divides at ``line[k]`` of its axis (0: columns, 1: rows) into ``low[k]`` and ``high[k]``.

    A child below zero is the leaf -child - 1, an entry of ``boxes`` (pid, c0, c1, r0, r1).
    """

    axis: list[int]
    line: list[int]
    low: list[int]
    high: list[int]
    depth: int
    boxes: list[Box]

    def _node(self, table: list[int], k: Column) -> Column:
        return F.get(literal_array(table, "int"), k)

    def _box(self, part: int, leaf: Column) -> Column:
        return F.get(literal_array([b[part] for b in self.boxes], "int"), leaf)

    def _start(self) -> Column:
        return F.lit(0 if self.axis else -1)

    def _steps(self) -> Column:
        return F.sequence(F.lit(1), F.lit(max(self.depth, 1)))

    def owner(self, i: Column, j: Column) -> Column:
        """Pid of the rectangle that holds the cell, -1 for none and for a null cell."""

        def step(k: Column, _: Column) -> Column:
            at = F.when(self._node(self.axis, k) == 0, j).otherwise(i)
            below = at < self._node(self.line, k)
            return F.when(k < 0, k).when(below, self._node(self.low, k)).otherwise(self._node(self.high, k))

        leaf = -F.aggregate(self._steps(), self._start(), step) - 1
        inside = (j >= self._box(1, leaf)) & (j < self._box(2, leaf)) & (i >= self._box(3, leaf)) & (i < self._box(4, leaf))
        return F.coalesce(F.when(inside, self._box(0, leaf)), F.lit(-1))

    def owners(self, i0: Column, i1: Column, j0: Column, j1: Column) -> Column:
        """Pids of the rectangles that a block of cells meets."""

        def step(nodes: Column, _: Column) -> Column:
            def below(k: Column) -> Column:
                first = F.when(self._node(self.axis, k) == 0, j0).otherwise(i0)
                last = F.when(self._node(self.axis, k) == 0, j1).otherwise(i1)
                line, low, high = (self._node(t, k) for t in (self.line, self.low, self.high))
                both = F.when(last < line, F.array(low)).when(first >= line, F.array(high)).otherwise(F.array(low, high))
                return F.when(k < 0, F.array(k)).otherwise(both)

            return F.flatten(F.transform(nodes, below))

        def meets(k: Column) -> Column:
            leaf = -k - 1
            return (j1 >= self._box(1, leaf)) & (j0 < self._box(2, leaf)) & (i1 >= self._box(3, leaf)) & (i0 < self._box(4, leaf))

        leaves = F.aggregate(self._steps(), F.array(self._start()), step)
        return F.transform(F.filter(leaves, meets), lambda k: self._box(0, -k - 1))


def cut_tree(boxes: Sequence[Box]) -> CutTree | None:
    """The tree of (pid, c0, c1, r0, r1); None if no line parts some of them without crossing a rectangle."""
    axis, line, low, high, leaves = [], [], [], [], []
    depth = 0
    open_: list[tuple[list[Box], int, int, list[int] | None]] = [(list(boxes), 1, 0, None)]
    while open_:
        rows, level, parent, side = open_.pop()
        if len(rows) == 1:
            leaves.append(rows[0])
            child = -len(leaves)
        else:
            found = None
            for way in (0, 1):
                a, b = 1 + 2 * way, 2 + 2 * way
                ordered = sorted(rows, key=lambda r: r[a])
                reach = ordered[0][b]
                for n, r in enumerate(ordered[1:], 1):
                    if r[a] >= reach and (found is None or abs(2 * n - len(rows)) < found[0]):
                        found = (abs(2 * n - len(rows)), way, r[a], ordered[:n], ordered[n:])
                    reach = max(reach, r[b])
            if found is None:
                return None
            child, depth = len(axis), max(depth, level)
            axis.append(found[1])
            line.append(found[2])
            low.append(0)
            high.append(0)
            open_ += (found[3], level + 1, child, low), (found[4], level + 1, child, high)
        if side is not None:
            side[parent] = child
    return CutTree(axis, line, low, high, depth, leaves)
