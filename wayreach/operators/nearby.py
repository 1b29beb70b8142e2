"""The pairs of points that a search by distance needs, found by a tree instead of by trying all pairs.

Nothing is sampled or capped: a pair is left out only where its distance says that
it can't be in the result.  The tree only proposes pairs, with some slack; distances,
times and ties are settled by the expressions that follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.geo import EARTH_KM

#: Points of a leaf, queries searched at once, and the pairs that a search may hold before its queries are halved.
LEAF, QUERIES, MOST_PAIRS = 16, 4096, 2_000_000
#: Slack for rounding, as a part and in the tree's unit.
SLACK, LEAST_SLACK = 1e-9, 1e-9


class _TooMany(Exception):
    pass


class Tree:
    """A balanced tree of boxes over points (one array a dimension), searched for many queries at once, level by level."""

    def __init__(self, points: list[np.ndarray]):
        n = len(points[0])
        levels = max(0, math.ceil(math.log2(max(1.0, n / LEAF))))
        order, cuts = np.arange(n), [0, n]
        for _ in range(levels):
            halves = [0]
            for a, b in zip(cuts, cuts[1:]):
                parts = [p[order[a:b]] for p in points]
                widest = max(parts, key=np.ptp)
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(widest, middle)]
                halves += [a + middle, b]
            cuts = halves
        self.order, self.points, self.size = order, [p[order] for p in points], n
        self.starts, self.counts = np.array(cuts[:-1]), np.diff(cuts)
        lo, hi, count = [np.minimum.reduceat(p, self.starts) for p in self.points], [np.maximum.reduceat(p, self.starts) for p in self.points], self.counts
        self.boxes = [(lo, hi, count)]
        for _ in range(levels):
            lo, hi = [np.minimum(x[::2], x[1::2]) for x in lo], [np.maximum(x[::2], x[1::2]) for x in hi]
            count = count[::2] + count[1::2]
            self.boxes.insert(0, (lo, hi, count))

    @classmethod
    def of(cls, state: dict) -> Tree:
        """From ``vars`` of a tree: what is broadcast must not need this package on the workers."""
        tree = cls.__new__(cls)
        vars(tree).update(state)
        return tree

    def _descend(self, at: list[np.ndarray], bound: np.ndarray, k: int = 0):
        """Queries and positions of the points in leaves within ``bound`` (squared); with ``k``, bounds fall to what k points are within."""
        query, node = np.arange(len(bound)), np.zeros(len(bound), int)
        for level, (lo, hi, count) in enumerate(self.boxes):
            if level:
                query, node = np.repeat(query, 2), np.repeat(2 * node, 2)
                node[1::2] += 1
            if len(query) > MOST_PAIRS and len(bound) > 1:
                raise _TooMany
            least, most = np.zeros(len(query)), np.zeros(len(query))
            for x, a, b in zip(at, lo, hi):
                below, above = a[node] - x[query], x[query] - b[node]
                least += np.maximum(np.maximum(below, above), 0) ** 2
                if k:
                    most += np.minimum(below, above) ** 2  # both negative within the box: the farther side is the lesser
            if k:
                most[count[node] < k] = np.inf
                np.minimum.at(bound, query, most * (1 + SLACK))
            keep = least <= bound[query]
            query, node = query[keep], node[keep]
        sizes = self.counts[node]
        if sizes.sum() > MOST_PAIRS and len(bound) > 1:
            raise _TooMany
        first = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(self.starts[node] - first, sizes)
        query = np.repeat(query, sizes)
        return query, place, sum((p[place] - x[query]) ** 2 for p, x in zip(self.points, at))

    def kth(self, at: list[np.ndarray], k: int) -> np.ndarray:
        """Each query's distance to its k-th nearest point, to the last where there are fewer."""
        k = min(k, self.size)
        query, _, square = self._descend(at, np.full(len(at[0]), np.inf), k)
        order = np.lexsort((square, query))
        return np.sqrt(square[order][np.searchsorted(query, np.arange(len(at[0]))) + k - 1])

    def within(self, at: list[np.ndarray], radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and point of every pair no farther than the query's radius, in order of the queries."""
        bound = radius**2
        query, place, square = self._descend(at, bound)
        keep = square <= bound[query]
        return query[keep], self.order[place[keep]]


def _on_sphere(lon: np.ndarray, lat: np.ndarray) -> list[np.ndarray]:
    lon, lat = np.radians(lon), np.radians(lat)
    return [np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)]


def _chord(angle):
    return 2 * np.sin(np.minimum(angle / 2, np.pi / 2))


def _searches(tree: Tree, anchors: Tree, at: list[np.ndarray], k: int, stretch: float, reach: float | None, sphere: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points by number, how many each query has) for runs of queries in order."""
    todo = [(i, min(i + QUERIES, len(at[0]))) for i in range(0, len(at[0]), QUERIES)][::-1]
    while todo:
        i, j = todo.pop()
        here = [x[i:j] for x in at]
        try:
            if reach is not None:
                radius = np.full(j - i, _chord(reach) if sphere else reach)
            elif sphere:
                radius = _chord(stretch * 2 * np.arcsin(np.minimum(anchors.kth(here, k) / 2, 1.0)))
            else:
                radius = stretch * anchors.kth(here, k)
            query, point = tree.within(here, radius * (1 + SLACK) + LEAST_SLACK)
        except _TooMany:
            todo += [((i + j) // 2, j), (i, (i + j) // 2)]  # the earlier half first
            continue
        yield point, np.bincount(query, minlength=j - i)


def nearby(places: DataFrame, lon: Column, lat: Column, k: int = 1, stretch: float = 1.0, reach: float | None = None, sphere: bool = True, anchor: str | None = None) -> Column | None:
    """Array of the rows of ``places`` near (lon, lat): those within ``stretch`` times the distance of the k-th nearest, or within ``reach``.

    ``places`` has lon, lat and the columns to come back; it is brought to the driver
    and sent to every task once, so its size has to be checked before.  None where it
    has no rows.  Distances are great-circle ones (``reach`` in km), or in degrees as
    in a plane with ``sphere=False``.  A point without coordinates gets the row of the
    least first column: no distance prefers any.
    """
    columns = [c for c in places.columns if c not in ("lon", "lat", anchor)]
    table = places.toArrow()
    if not table.num_rows:
        return None
    table = table.combine_chunks().sort_by(columns[0])
    xy = [table[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lon", "lat")]
    placed = np.flatnonzero(np.isfinite(xy[0]) & np.isfinite(xy[1]))
    rows = pa.StructArray.from_arrays([table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in columns], columns)
    to = (lambda x, y: _on_sphere(x, y)) if sphere else (lambda x, y: [x, y])
    tree = Tree(to(xy[0][placed], xy[1][placed])) if len(placed) else None
    chosen = placed[table[anchor].to_numpy(zero_copy_only=False)[placed].astype(bool)] if anchor else placed
    anchors = Tree(to(xy[0][chosen], xy[1][chosen])) if 0 < len(chosen) < len(placed) else None
    angle = None if reach is None else reach / EARTH_KM if sphere else reach
    spark = places.sparkSession
    shared = spark.sparkContext.broadcast((tree and vars(tree), anchors and vars(anchors), placed, rows))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        *states, placed, rows = shared.value
        tree, anchors = (state and Tree.of(state) for state in states)
        for lon, lat in batches:
            x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (lon, lat))
            known = np.isfinite(x) & np.isfinite(y) & (tree is not None)
            counts, offset = np.where(known, 0, 1), 0
            at, places_of = np.flatnonzero(known), []
            for point, found in _searches(tree, anchors or tree, to(x[at], y[at]), k, stretch, angle, sphere) if len(at) else ():
                upto = at[offset + len(found)] if offset + len(found) < len(at) else len(x)
                start = at[offset] if offset else 0
                counts[at[offset : offset + len(found)]] = found
                part = counts[start:upto]
                numbers = np.zeros(part.sum(), int)
                numbers[np.repeat(known[start:upto], part)] = placed[point]
                offset += len(found)
                yield _lists(rows, numbers, part)
            if not len(at):
                yield _lists(rows, np.zeros(len(x), int), counts)

    shape = ArrayType(places.select(*columns).schema)
    return F.arrow_udf(run, shape)(lon, lat)


def _lists(rows: pa.StructArray, numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rows.take(pa.array(numbers)))
