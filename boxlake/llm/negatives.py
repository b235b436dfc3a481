"""Hard negatives by bounds along spanning trees of anchors.

Vectors are integers, scores their inner products. Anchors are packed into blocks of
`TREE` near each other (same nearest pivot), and each block gets a minimum spanning tree.
A task holds the trees of up to about `ANCHORS_AT_ONCE` anchors and streams a group of
candidates past them: all candidates are scored at a tree's root; for a child, the score
at its parent plus or minus edge length times candidate norm bounds the score, and only
candidates whose bounds meet the child's window are scored again. Bounds that weren't
tightened pass on to the next child, wider.

Two passes run this way. The first keeps each anchor's best candidates of its own label,
its window open above and closing from below. Their scores make the windows of the second,
which keeps, for each positive, the best candidates of other labels within its window.
Each group of candidates sends a few rows for each anchor; they are ranked by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.llm.common import bounded_sample, ranked
from boxlake.operators.ranking import first_n
from boxlake.session import cut_lineage

TREE = 128  # anchors of a tree
PIVOTS = 64  # anchors, in hash order, that others are grouped around
ANCHORS_AT_ONCE = 16_384
# Candidates that share one list of results: more at a time make fewer rows to rank.
GROUP_ROWS = 65_536
LEAST_ROWS = 512  # of a group, where more groups would only use idle cores
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
EXACT = float(1 << 52)  # products up to here add up exactly in doubles


# ------------------------------------------------------------------ numpy pieces

def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as int64, shorter ones filled up with zeros."""
    lengths = np.asarray(pc.list_value_length(column))
    flat = np.asarray(pc.list_flatten(column)).astype(np.int64, copy=False)
    most = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == most).all():
        return flat.reshape(len(lengths), most)
    out = np.zeros((len(lengths), most), dtype=np.int64)
    out[np.arange(most) < lengths[:, None]] = flat
    return out


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def dots(vectors: np.ndarray, one: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products; `largest` bounds their size and that of all partial sums."""
    if largest < EXACT:
        return (vectors.astype(np.float64, copy=False) @ one.astype(np.float64)).astype(np.int64)
    if largest < 2**62:
        return vectors.astype(np.int64) @ one.astype(np.int64)
    exact = vectors.astype(object) @ one.astype(object)  # beyond 64 bits this raises
    return np.array(exact.tolist(), dtype=np.int64)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prim's tree from the vector nearest the mean: the order in which vectors join it, the
    place in that order of each one's parent (-1 for the root), and the edge lengths."""
    x = vectors.astype(np.float64)
    n = len(x)
    order, parents, edges = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    at = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    near, via = np.full(n, np.inf), np.full(n, -1)
    inside = np.zeros(n, bool)
    order[0], inside[at] = at, True
    for k in range(1, n):
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = d < near
        near[closer], via[closer] = d[closer], k - 1
        at = int(np.where(inside, np.inf, near).argmin())
        order[k], inside[at] = at, True
        parents[k], edges[k] = via[at], near[at]
    return order, parents, edges


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` first by score, higher first, then by id; a repeated id counts once."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        if len(np.unique(ids[scores >= least])) >= k:
            scores, ids = scores[scores >= least], ids[scores >= least]
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return scores[first], ids[first]


# ------------------------------------------------------------------ trees of anchors

def _nearest_pivot(pivots: np.ndarray):
    def nearest(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vec"), pivots.shape[1]).astype(np.float64)
            p = np.pad(pivots.astype(np.float64), ((0, 0), (0, x.shape[1] - pivots.shape[1])))
            to = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to)], [*batch.schema.names, "pivot"])

    return nearest


def _grow(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("vec_id")
    order, parents, edges = spanning_tree(matrix(rows["vec"].combine_chunks()))
    rows = rows.take(pa.array(order))
    return rows.append_column("place", pa.array(np.arange(len(order)))).append_column("parent", pa.array(parents)).append_column("edge", pa.array(edges))


def anchor_trees(anchors: DataFrame) -> DataFrame:
    """`vec_id, label, vec, pivot, block, place, parent, edge`: the anchors in blocks of up
    to `TREE` around the same pivot, each block a spanning tree."""
    n = anchors.count()
    first = bounded_sample(anchors, PIVOTS, n, 5, "vec_id").select("vec").toArrow()
    pivots = matrix(first["vec"].combine_chunks()) if first.num_rows else np.zeros((1, 0), np.int64)
    schema = "vec_id long, label int, vec array<long>"
    met = anchors.mapInArrow(_nearest_pivot(pivots), f"{schema}, pivot long")
    placed = ranked(met, ["pivot"], [F.col("vec_id")], "pos", "n").withColumn("block", F.expr(f"pos div {TREE}"))
    placed = placed.select("vec_id", "label", "vec", "pivot", "block")
    trees = placed.groupBy("pivot", "block").applyInArrow(
        lambda rows: _grow(rows), f"{schema}, pivot long, block long, place long, parent long, edge double"
    )
    return cut_lineage(trees)


# ------------------------------------------------------------------ search

class _Search:
    """The trees of one share of the anchors, and what they have found so far."""

    def __init__(self, anchors: pa.Table, same: bool, k: int):
        anchors = anchors.sort_by([("pivot", "ascending"), ("block", "ascending"), ("place", "ascending")])
        self.ids, self.labels = np.asarray(anchors["vec_id"]), np.asarray(anchors["label"])
        self.vectors = matrix(anchors["vec"].combine_chunks())
        self.norms = norms(self.vectors)
        self.edges, self.parents = np.asarray(anchors["edge"]), np.asarray(anchors["parent"])
        self.starts = [*np.flatnonzero(self.parents < 0).tolist(), len(self.ids)]
        self.same, self.k = same, k
        floors, tops = anchors["floors"].to_pylist(), anchors["tops"].to_pylist()
        # For each window of an anchor: least and greatest score, and the best in it.
        self.windows = [list(zip(f, t)) for f, t in zip(floors, tops)]
        none = np.zeros(0, np.int64)
        self.found = [[(none, none) for _ in w] for w in self.windows]
        self.scored = self.met = 0

    def floor(self, a: int, w: int) -> int:
        scores = self.found[a][w][0]
        low = self.windows[a][w][0]
        return max(low, int(scores[-1])) if len(scores) == self.k else low

    def add(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.vectors.shape[1])
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        own = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
        size = norms(vectors)
        largest = float(size.max(initial=0)) * float(self.norms.max(initial=0)) * 1.01 + 1
        x = vectors.astype(np.float64) if largest < EXACT else vectors
        slack = 0.0 if largest < EXACT else largest * 1e-14  # of bounds, which are doubles
        for begin, end in zip(self.starts, self.starts[1:]):
            low, high = (np.zeros((end - begin, len(ids))) for _ in "lh")
            for a in range(begin, end):
                at = a - begin
                if at:
                    reach = np.ceil(self.edges[a] * size * (1 + 1e-9)) + 1 + slack
                    low[at], high[at] = low[self.parents[a]] - reach, high[self.parents[a]] + reach
                else:
                    scores = dots(x, own[a], largest)
                    low[0], high[0] = scores - slack, scores + slack
                self.met += len(ids)
                if not self.windows[a]:
                    self.scored += 0 if at else len(ids)
                    continue
                floors = [self.floor(a, w) for w in range(len(self.windows[a]))]
                right = (labels == self.labels[a]) & (ids != self.ids[a]) if self.same else labels != self.labels[a]
                right &= (high[at] >= min(floors)) & (low[at] <= max(t for _, t in self.windows[a]))
                chosen = np.flatnonzero(right)
                if at:
                    scores = dots(x[chosen], own[a], largest)
                    low[at, chosen], high[at, chosen] = scores - slack, scores + slack
                else:
                    scores = scores[chosen]
                self.scored += len(chosen) if at else len(ids)
                self.keep(a, scores, ids[chosen], floors)

    def keep(self, a: int, scores: np.ndarray, ids: np.ndarray, floors: list[int]) -> None:
        for w, least in enumerate(floors):
            inside = (scores >= least) & (scores <= self.windows[a][w][1])
            if inside.any():
                old = self.found[a][w]
                self.found[a][w] = best(np.concatenate([old[0], scores[inside]]), np.concatenate([old[1], ids[inside]]), self.k)

    def rows(self) -> pa.RecordBatch:
        lists = [(a, w, s, i) for a, f in enumerate(self.found) for w, (s, i) in enumerate(f) if len(s)]
        n = [len(s) for _, _, s, _ in lists]
        joined = [np.concatenate(c) if lists else np.zeros(0, np.int64) for c in ([x[2] for x in lists], [x[3] for x in lists])]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(self.ids[[a for a, _, _, _ in lists]] if lists else np.zeros(0, np.int64), n)),
                pa.array(np.repeat(np.array([w for _, w, _, _ in lists], np.int32), n)),
                pa.array(joined[1]),
                pa.array(joined[0]),
            ],
            ["anchor_id", "w", "vec_id", "score"],
        )


def _search(same: bool, k: int):
    def search(batches) -> Iterator[pa.RecordBatch]:
        task, anchors, state = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            marks = np.asarray(rows["share"]).astype(np.int64) * (1 << 31) + np.asarray(rows["group"])
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if marks[lo] != task:
                    if state:
                        yield state.rows()
                    task, anchors, state = marks[lo], [], None
                part = rows.slice(lo, hi - lo)
                n = int(np.asarray(part["parent"].is_valid()).sum())  # anchors come first
                if n:
                    anchors.append(part.slice(0, n))
                if n < part.num_rows and anchors:
                    state = state or _Search(pa.concat_tables(anchors), same, k)
                    rest = part.slice(n)
                    state.add(np.asarray(rest["vec_id"]), np.asarray(rest["label"]), matrix(rest["vec"].combine_chunks()))
        if state:
            yield state.rows()

    return search


def search(trees: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, same: bool, k: int) -> DataFrame:
    """`anchor_id, w, vec_id, score`: for each window of each anchor of `trees` (with arrays
    `floors, tops` of its windows) the first `k` of `rows` (`vec_id, label, vec`) whose score
    lies in it, of the anchor's label (but for itself) or of others."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    shares = max(1, -(-n_anchors // ANCHORS_AT_ONCE))
    groups = max(-(-n_rows // GROUP_ROWS), min(2 * cores, -(-n_rows // LEAST_ROWS)), 1)
    share = F.pmod(F.xxhash64("pivot", "block"), F.lit(shares)).cast("int")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    tree = ["pivot", "block", "place", "parent", "edge", "floors", "tops"]
    asking = trees.select("vec_id", "label", "vec", *tree, share.alias("share"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = rows.select(
        "vec_id", "label", "vec", *[F.lit(None).cast(trees.schema[c].dataType).alias(c) for c in tree],
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), group.alias("group"),
    )
    tasks = min(shares * groups, max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    met = asking.unionByName(asked).repartition(tasks, "share", "group").sortWithinPartitions("share", "group", F.col("parent").isNull())
    found = met.mapInArrow(_search(same, k), "anchor_id long, w int, vec_id long, score long")
    return first_n(found, ["anchor_id", "w"], [F.desc("score"), F.col("vec_id")], k)


# ------------------------------------------------------------------ mining

def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id, label, vec` of the rows with an id, a label and a vector of finite components,
    each component x as floor(256 x)."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256)))


def window(score: Column) -> tuple[Column, Column]:
    """The least and the greatest integer between `LOW` and `HIGH` per cent of a score."""
    exact = score.cast("decimal(20,0)")
    return F.ceil(exact * LOW / 100).cast("long"), F.floor(exact * HIGH / 100).cast("long")


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    `vectors` has `vec_id, label, vec`; rows without id, label or vector, or with a null or
    non-finite component, take no part; other columns don't count. Anchors are the rows that `is_anchor` says. An anchor's
    positives are its first `POSITIVES` other rows of the same label by score, ties by smaller
    id; each positive gets the first `NEGATIVES` rows of other labels whose score is 50 to 95 %
    of its own. Shorter vectors count as filled up with zeros. In a list, a repeated id counts
    once, with its best score; as an anchor, the repeated id's first row by label and vector
    counts. Scores have to fit 64 bits. An anchor without positives or negatives, or an
    empty table, has no rows."""
    rows = cut_lineage(usable(vectors))
    chosen = rows.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    chosen = cut_lineage(chosen.select("vec_id", "r.label", "r.vec"))
    n_anchors, n_rows = chosen.count(), rows.count()
    trees = anchor_trees(chosen)

    least, most = -(1 << 63), (1 << 63) - 1
    open_ = trees.withColumns({"floors": F.array(F.lit(least).cast("long")), "tops": F.array(F.lit(most).cast("long"))})
    positives = search(open_, rows, n_anchors, n_rows, True, POSITIVES)
    positives = cut_lineage(positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    listed = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("p"))
    listed = listed.select(
        F.col("anchor_id").alias("vec_id"),
        F.transform("p", lambda p: window(p["positive_score"])[0]).alias("floors"),
        F.transform("p", lambda p: window(p["positive_score"])[1]).alias("tops"),
    )
    closed = trees.join(listed, "vec_id", "left")
    none = F.array().cast("array<long>")
    closed = closed.withColumns({c: F.coalesce(c, none) for c in ("floors", "tops")})
    negatives = search(closed, rows, n_anchors, n_rows, False, NEGATIVES)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
    negatives = negatives.withColumn("rank", rank.cast("int"))

    place = Window.partitionBy("anchor_id").orderBy("positive_id")
    named = positives.withColumn("w", (F.row_number().over(place) - 1).cast("int"))
    return negatives.join(named, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
