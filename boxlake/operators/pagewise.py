"""Pages of ordinary size, settled whole inside a task.

A page with at most `PAGE_ROWS` rows of each table is cheaper compared row by row than sent
about in cells: its rows are shuffled once, by page. Larger groups take the ways by cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.operators.ranking import hot_groups, same
from boxlake.session import cut_lineage

# Rows of one group that may be compared with each other.
PAGE_ROWS = 1000
# Rows that a task compares at a time.
CHUNK_ROWS = 20_000


def large_groups(tables: Sequence[DataFrame], keys: Sequence[str], limit: int = PAGE_ROWS) -> DataFrame | None:
    """Keys of the groups with more than `limit` rows in one of the tables, written; nothing is
    written if there are none."""
    found = reduce(DataFrame.unionByName, [hot_groups(t, keys, limit) for t in tables]).distinct()
    return cut_lineage(found) if found.limit(1).count() else None


def in_two_ways(
    tables: Sequence[DataFrame], keys: Sequence[str], large: DataFrame | None,
    small_way: Callable[..., DataFrame], large_way: Callable[..., DataFrame],
) -> DataFrame:
    """`small_way` of the tables' rows outside the groups `large`, and `large_way` of those in
    them; both give the same columns."""
    if large is None:
        return small_way(*tables)
    rest = [t.join(large, same(t, large, keys), "left_anti") for t in tables]
    held = [t.join(large, same(t, large, keys), "left_semi") for t in tables]
    return small_way(*rest).unionByName(large_way(*held))


def pages_of(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row per group, with its rows as the array `name`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias(name))


def together(keys: Sequence[str], **tables: DataFrame) -> DataFrame:
    """One row per group of any of the tables, with the rows of each as the array of its name:
    `pages_of` for several tables in one shuffle."""
    named = [t.select(*keys, F.struct(*[c for c in t.columns if c not in keys]).alias(n)) for n, t in tables.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
    return rows.groupBy(*keys).agg(*[F.collect_list(n).alias(n) for n in tables])


def rows_of(pages: DataFrame, keys: Sequence[str], name: str, **added: Column) -> DataFrame:
    """The rows of `pages_of` again, each with its element of the arrays `added`."""
    fields = pages.schema[name].dataType.elementType.names
    zipped = pages.select(*keys, F.col(name).alias("_rows"), *[c.alias(n) for n, c in added.items()])
    flat = zipped.select(*keys, F.inline(F.arrays_zip("_rows", *added)))
    return flat.select(*keys, *[F.col(f"_rows.{f}").alias(f) for f in fields], *added)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _ends(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _linked(page: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """For each point the first one of its chain. Points come by page and `x`: each is held
    against the next ones until they are too far in `x`."""
    found = []
    at, step = np.arange(len(x)), 1
    while at.size:
        at = at[at + step < len(x)]
        other = at + step
        reach = (page[other] == page[at]) & (x[other] - x[at] <= radius)
        at, other = at[reach], other[reach]
        dx, dy = x[other] - x[at], y[other] - y[at]
        met = np.sqrt(dx * dx + dy * dy) <= radius
        found.append((at[met], other[met]))
        step += 1
    a, b = (np.concatenate([f[i] for f in found]) if found else np.arange(0) for i in (0, 1))
    root = np.arange(len(x))
    while a.size:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def chain_ids(radius: float):
    """Arrow function of the boxes (four lists) and ids of each page's rows: for each row the
    smallest id of those linked to it by steps of at most `radius` between centers."""

    @F.arrow_udf("array<bigint>")
    def ids(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, own: pa.Array) -> pa.Array:
        ends = _ends(own)
        xs, ys = (_flat(x1) + _flat(x2)) / 2, (_flat(y1) + _flat(y2)) / 2
        names, pages = _flat(own), np.repeat(np.arange(len(own)), np.diff(ends))
        out = np.empty(len(names), dtype=np.int64)
        first = 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_ROWS, "right")) - 1)
            part = np.arange(ends[first], ends[last])
            part = part[np.lexsort((xs[part], pages[part]))]
            root = _linked(pages[part], xs[part], ys[part], radius)
            least = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(least, root, names[part])
            out[part] = least[root]
            first = last
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    return ids


def closest(radius: float, inclusive: bool):
    """Arrow function of the boxes (four lists) of each page's rows and the places (two lists)
    of its targets: for each row the number of the first of its closest targets within
    `radius`, and the distance; -1 if there is none."""

    @F.arrow_udf("struct<at:array<int>,dist:array<double>>")
    def find(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, tx: pa.Array, ty: pa.Array) -> pa.Array:
        ends, stops = _ends(x1), _ends(tx)
        xs, ys = (_flat(x1) + _flat(x2)) / 2, (_flat(y1) + _flat(y2)) / 2
        us, vs = _flat(tx), _flat(ty)
        at, dist = np.full(len(xs), -1, dtype=np.int32), np.full(len(xs), np.inf)
        for i in range(len(x1)):
            mine, its = slice(ends[i], ends[i + 1]), slice(stops[i], stops[i + 1])
            if its.start == its.stop or mine.start == mine.stop:
                continue
            dx, dy = xs[mine, None] - us[None, its], ys[mine, None] - vs[None, its]
            d = np.sqrt(dx * dx + dy * dy)
            d = np.where(d <= radius if inclusive else d < radius, d, np.inf)
            best = d.argmin(axis=1)
            dist[mine] = d[np.arange(len(best)), best]
            at[mine] = np.where(np.isfinite(dist[mine]), best, -1)
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at, dist)]
        return pa.StructArray.from_arrays(lists, ["at", "dist"])

    return find


def centered_in():
    """Arrow function: for each of a page's boxes (four lists) whether its center lies in any of the areas (four
    lists)."""

    @F.arrow_udf("array<boolean>")
    def find(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, a1: pa.Array, b1: pa.Array, a2: pa.Array, b2: pa.Array) -> pa.Array:
        ends, stops = _ends(x1), _ends(a1)
        xs, ys = (_flat(x1) + _flat(x2)) / 2, (_flat(y1) + _flat(y2)) / 2
        left, top, right, bottom = (_flat(v) for v in (a1, b1, a2, b2))
        held = np.zeros(len(xs), dtype=bool)
        for i in range(len(x1)):
            mine, its = slice(ends[i], ends[i + 1]), slice(stops[i], stops[i + 1])
            x, y = xs[mine, None], ys[mine, None]
            held[mine] = ((left[its] <= x) & (x <= right[its]) & (top[its] <= y) & (y <= bottom[its])).any(axis=1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held))

    return find


def overlapping(share: float):
    """Arrow function of the boxes of each page's rows and of its other rows (four lists each):
    for each row the numbers of the others that overlap by more than `share` of the smaller."""

    @F.arrow_udf("array<array<int>>")
    def find(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, o1: pa.Array, p1: pa.Array, o2: pa.Array, p2: pa.Array) -> pa.Array:
        ends, stops = _ends(x1), _ends(o1)
        mine, its = ([_flat(v) for v in side] for side in ((x1, y1, x2, y2), (o1, p1, o2, p2)))
        counts, met = np.zeros(ends[-1], dtype=np.int64), []
        for i in range(len(x1)):
            a = [v[ends[i]:ends[i + 1], None] for v in mine]
            b = [v[None, stops[i]:stops[i + 1]] for v in its]
            # like Spark's least and greatest, which pass over what is missing
            w = np.fmin(a[2], b[2]) - np.fmax(a[0], b[0])
            h = np.fmin(a[3], b[3]) - np.fmax(a[1], b[1])
            smaller = np.fmin((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
            with np.errstate(all="ignore"):
                hits = (w > 0) & (h > 0) & (smaller > 0) & (w * h / smaller > share)
            counts[ends[i]:ends[i + 1]] = hits.sum(axis=1)
            met.append(np.nonzero(hits)[1])
        numbers = np.concatenate(met) if met else np.arange(0)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    return find


def places():
    """Arrow function: for each id a page's rows ask for, its number among the page's `ids`, which ascend; -1 if
    it isn't there."""

    @F.arrow_udf("array<int>")
    def find(wanted: pa.Array, ids: pa.Array) -> pa.Array:
        ends, stops = _ends(wanted), _ends(ids)
        names = wanted.flatten()
        known, names = names.is_valid().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy(zero_copy_only=False)
        there = _flat(ids)
        at = np.full(len(names), -1, dtype=np.int32)
        for i in range(len(wanted)):
            mine, its = slice(ends[i], ends[i + 1]), there[stops[i]:stops[i + 1]]
            if len(its):
                spot = np.minimum(np.searchsorted(its, names[mine]), len(its) - 1)
                at[mine] = np.where(known[mine] & (its[spot] == names[mine]), spot, -1)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at))

    return find
