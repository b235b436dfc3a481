"""Greedy duplicate suppression and overlap analysis.

Groups up to `FOLD_LIMIT` boxes are folded in one pass inside a single array; one
shuffle, all JVM. Larger groups (a page holding a third of the data is possible)
take `_suppress_distributed`, which gives the same answer with joins on grid cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions import cells as C
from boxlake.functions import geometry as G
from boxlake.operators.celltree import PAIR_LIMIT, inside, lattice, slightly_larger, tier
from boxlake.operators.pagewise import PAGE_ROWS, in_two_ways, large_groups
from boxlake.operators.ranking import first_n, hot_groups, numbered
from boxlake.schemas import PAGE_KEYS
from boxlake.session import cut_lineage

# Boxes of one group that are folded in one array.
FOLD_LIMIT = 512
# Growth of the blocks of boxes whose pairs are looked for.
NEXT_BLOCK = 8
# Boxes of one grid cell that may be compared pairwise.
CELL_LIMIT = 1000

TAG_CLASS = "Tag-ID"
NO_CLASS = "\x00"  # stands for a missing class name while boxes are compared


def suppress(
    df: DataFrame,
    iou_threshold: float = 0.5,
    class_specific: bool = True,
    *,
    inclusive: bool = False,
    unboxed: str = "keep",
    keys: Sequence[str] = PAGE_KEYS,
    fold_limit: int = FOLD_LIMIT,
    cell_limit: int = CELL_LIMIT,
) -> DataFrame:
    """Non-maximum suppression per page, and per class when `class_specific`.

    Boxes are visited by confidence, highest first, equal ones by `det_idx`. A box
    falls when its IoU with a kept box is over the threshold (`inclusive`: at or
    over it). Boxes without coordinates neither suppress nor fall; `unboxed='drop'`
    removes them from groups that hold more than one row.
    """
    if not 0.0 < iou_threshold <= 1.0:
        raise ValueError("iou_threshold must lie in (0, 1]")
    if class_specific:  # a missing class is one class
        df = df.withColumn("class_name", F.coalesce("class_name", F.lit(NO_CLASS)))
    out = _suppress(df, iou_threshold, class_specific, inclusive, unboxed, keys, fold_limit, cell_limit)
    return out.withColumn("class_name", F.nullif("class_name", F.lit(NO_CLASS))) if class_specific else out


def _suppress(df, iou_threshold, class_specific, inclusive, unboxed, keys, fold_limit, cell_limit) -> DataFrame:
    group = [*keys, "class_name"] if class_specific else list(keys)
    df = cut_lineage(df)  # read for the sizes of groups and by both ways
    large = hot_groups(df, group, fold_limit)
    if not large.limit(1).count():
        return _suppress_folded(df, group, iou_threshold, inclusive, unboxed)
    large = cut_lineage(large)
    small_rows = df.join(large, group, "left_anti")
    large_rows = df.join(large, group, "left_semi").select(*df.columns)
    return _suppress_folded(small_rows, group, iou_threshold, inclusive, unboxed).unionByName(
        _suppress_distributed(large_rows, group, iou_threshold, inclusive, unboxed, cell_limit)
    )


def _boxes_of(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group, with its boxes in order of rank as `_boxes`."""
    rest = [c for c in df.columns if c not in group]
    ranked = F.struct((-F.col("confidence")).alias("_rank"), "det_idx", *[c for c in rest if c != "det_idx"])
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(ranked)).alias("_boxes"))


def _fold(boxes: Column, threshold: float, inclusive: bool, unboxed: str) -> Column:
    def step(kept: Column, candidate: Column) -> Column:
        b = G.field_box(candidate)
        hit = F.exists(kept, lambda k: G.exceeds_iou(G.field_box(k), b, threshold, inclusive))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(candidate)))

    kept = F.aggregate(boxes, F.slice(boxes, 1, 0), step)
    if unboxed == "drop":
        kept = F.filter(kept, lambda k: G.has_box(G.field_box(k)) | (F.size(boxes) == 1))
    return kept


def _suppress_folded(df, group, threshold, inclusive, unboxed) -> DataFrame:
    kept = _fold(F.col("_boxes"), threshold, inclusive, unboxed)
    return _unfolded(_boxes_of(df, group), kept, df.columns, group)


def _unfolded(groups: DataFrame, kept: Column, columns: Sequence[str], group: Sequence[str]) -> DataFrame:
    flat = groups.select(*group, F.explode(kept).alias("_k"))
    return flat.select(*[F.col(c) if c in group else F.col(f"_k.{c}").alias(c) for c in columns])


def _paired(df: DataFrame, group: Sequence[str], threshold: float, inclusive: bool) -> DataFrame:
    """Pairs of one group over the IoU threshold, as `group, hi, lo` (ranks)."""
    left = C.spread_octaves(df, threshold)
    right = left.select(
        *group, "tier", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("rank", "own", "x1", "y1", "x2", "y2")]
    )
    side = F.pow(F.lit(2.0), F.col("tier"))
    a, b = G.box(), G.box("o_")
    return (
        left.join(right, [*group, "tier", "cx", "cy"])
        .filter(F.col("rank") < F.col("o_rank"))
        .filter(F.col("own") | F.col("o_own"))
        # both boxes may share several cells: count them in the one that holds the
        # top-left corner of their intersection
        .filter(C.cell(F.greatest(a.x1, b.x1), side) == F.col("cx"))
        .filter(C.cell(F.greatest(a.y1, b.y1), side) == F.col("cy"))
        .filter(G.exceeds_iou(a, b, threshold, inclusive))
        .select(*group, F.col("rank").alias("hi"), F.col("o_rank").alias("lo"))
    )


def _suppress_distributed(df, group, threshold, inclusive, unboxed, cell_limit) -> DataFrame:
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("det_idx").alias("i")).alias("rank")
    b = G.box()
    solid = (G.width(b) > 0) & (G.height(b) > 0)
    # Boxes without area have IoU 0 with everything.
    free = df.filter(~F.coalesce(solid, F.lit(False)))
    if unboxed == "drop":
        # the group is large, so it has more than one row
        free = free.filter(G.has_box(b))
    boxes = df.filter(solid).select(*group, rank, "x1", "y1", "x2", "y2")
    if threshold < 1.0 or inclusive:
        # Of equal boxes only the first ranked can stay, and whatever fells it
        # fells its copies.
        boxes = boxes.groupBy(*group, "x1", "y1", "x2", "y2").agg(F.min("rank").alias("rank"))
    open_ = cut_lineage(boxes.withColumn("octave", C.octave_of(b)))

    kept: list[DataFrame] = []
    node = [*group, "rank"]
    open_, peeled = _peel(open_, group, threshold, inclusive, cell_limit)
    kept += peeled

    edges = cut_lineage(_paired(open_, group, threshold, inclusive))
    nodes = open_.select(*node)
    while edges.limit(1).count():
        beaten = edges.select(*group, F.col("lo").alias("rank")).distinct()
        winners = cut_lineage(nodes.join(beaten, node, "left_anti").select(*node))
        kept.append(winners)
        losers = (
            edges.join(winners.withColumnRenamed("rank", "hi"), [*group, "hi"], "left_semi")
            .select(*group, F.col("lo").alias("rank"))
            .distinct()
        )
        nodes = cut_lineage(
            nodes.join(winners, node, "left_anti").join(losers, node, "left_anti").select(*node)
        )
        edges = cut_lineage(
            edges.join(nodes.withColumnRenamed("rank", "hi"), [*group, "hi"], "left_semi")
            .join(nodes.withColumnRenamed("rank", "lo"), [*group, "lo"], "left_semi")
            .select(*group, "hi", "lo")
        )
    kept.append(nodes)

    survivors = reduce(DataFrame.unionByName, kept)
    chosen = df.filter(solid).withColumn("rank", rank).join(survivors, node, "left_semi")
    return chosen.select(*df.columns).unionByName(free)


def _peel(open_, group, threshold, inclusive, cell_limit):
    """Thin out crowded cells without comparing their boxes pairwise.

    Each round keeps the boxes that rank first in every cell they touch and drops
    what they overlap. A cell has at most one such box, so each open box meets at
    most one row per cell. Stops when no cell holds more than `cell_limit` boxes.
    """
    kept: list[DataFrame] = []
    at = [*group, "tier", "cx", "cy"]
    node = [*group, "rank"]
    while True:
        spread = C.spread_octaves(open_, threshold)
        tops = cut_lineage(spread.groupBy(*at).agg(F.min("rank").alias("top"), F.count(F.lit(1)).alias("n")))
        if not tops.filter(F.col("n") > cell_limit).limit(1).count():
            return open_, kept
        winners = (
            spread.join(tops, at)
            .groupBy(*node)
            .agg(F.bool_and(F.col("rank") == F.col("top")).alias("first"))
            .filter("first")
            .select(*node)
        )
        winners = cut_lineage(open_.join(winners, node, "left_semi"))
        kept.append(winners.select(*node))
        rest = open_.join(winners.select(*node), node, "left_anti").select(*open_.columns)
        near = C.spread_octaves(winners, threshold).select(
            *at, *[F.col(c).alias(f"w_{c}") for c in ("rank", "x1", "y1", "x2", "y2")]
        )
        fallen = (
            C.spread_octaves(rest, threshold)
            .join(near, at)
            .filter(F.col("w_rank") < F.col("rank"))
            .filter(G.exceeds_iou(G.box("w_"), G.box(), threshold, inclusive))
            .select(*node)
            .distinct()
        )
        open_ = cut_lineage(rest.join(fallen, node, "left_anti").select(*open_.columns))


def dedup_tags(
    df: DataFrame,
    iou_threshold: float = 0.7,
    classes: Sequence[str] = (TAG_CLASS,),
    **kwargs,
) -> DataFrame:
    """Suppress duplicates within the tag classes only; other rows pass through."""
    tagged = F.coalesce(F.col("class_name").isin(*classes), F.lit(False))
    tags = suppress(df.filter(tagged), iou_threshold, unboxed="drop", **kwargs)
    return df.filter(~tagged).unionByName(tags)


def cleaned(
    df: DataFrame, tag_iou: float = 0.7, iou: float | None = 0.5, classes: Sequence[str] = (TAG_CLASS,), fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """`dedup_tags`, then class-wise `suppress` (`iou=None` leaves it out). Groups of up to
    `fold_limit` boxes are folded for both at once, so that rows are shuffled once and not
    written in between. The input is read for the sizes of groups and for its rows."""
    group = [*PAGE_KEYS, "class_name"]
    for threshold in (tag_iou, iou):
        if threshold is not None and not 0.0 < threshold <= 1.0:
            raise ValueError("iou_threshold must lie in (0, 1]")

    def folded(df: DataFrame) -> DataFrame:
        tagged = F.coalesce(F.col("class_name").isin(*classes), F.lit(False))
        first = F.when(tagged, _fold(F.col("_boxes"), tag_iou, False, "drop")).otherwise(F.col("_boxes"))
        groups = _boxes_of(df, group).withColumn("_boxes", first)
        kept = F.col("_boxes") if iou is None else _fold(F.col("_boxes"), iou, False, "keep")
        return _unfolded(groups, kept, df.columns, group)

    def apart(df: DataFrame) -> DataFrame:
        out = dedup_tags(df, tag_iou, classes, fold_limit=fold_limit)
        return out if iou is None else suppress(out, iou, fold_limit=fold_limit)

    return in_two_ways([df], group, large_groups([df], group, fold_limit), folded, apart)


def preprocess(
    df: DataFrame, iou_threshold: float = 0.5, confidence_threshold: float = 0.25, **kwargs
) -> DataFrame:
    """Confidence filter, then class-wise suppression that also removes boxes at the
    threshold. Rows without a box are dropped."""
    boxed = df.filter(G.has_box(G.box())).filter(F.col("confidence") >= confidence_threshold)
    return suppress(boxed, iou_threshold, inclusive=True, **kwargs)


def reduction_by_page(before: DataFrame, after: DataFrame, keys: Sequence[str] = PAGE_KEYS) -> DataFrame:
    """Counts before and after per page; pages that lost every row stay."""
    tagged = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return tagged.groupBy(*keys).agg(
        F.sum("b").alias("original_detection_count"), F.sum("a").alias("processed_detection_count")
    )


def reduction_summary(by_page: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    total, left = F.sum("original_detection_count"), F.sum("processed_detection_count")
    return by_page.groupBy(*keys).agg(
        total.alias("total_original_detections"),
        left.alias("total_processed_detections"),
        F.coalesce(F.try_divide(total - left, total) * 100, F.lit(0.0)).alias("reduction_percentage"),
    )


def _copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal boxes of a page as one row with their number."""
    b = G.box()
    return (
        df.filter((G.width(b) > 0) & (G.height(b) > 0))
        .groupBy(*keys, "x1", "y1", "x2", "y2")
        .agg(F.count(F.lit(1)).alias("n"), F.min("det_idx").alias("rank"))
    )


def overlapping(smaller: DataFrame, larger: DataFrame, keys: Sequence[str], iou_threshold: float, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs of a box of `smaller` and a larger one of `larger` whose IoU exceeds the threshold,
    each once: the columns of the first, and those of the second as `o_...`. Of boxes with
    equal areas the one of the smaller `rank` counts as smaller. The larger box holds one of
    a few points of the smaller, and is at most `1 / iou_threshold` times as long."""
    keys = list(keys)
    a, b = G.box(), G.box("o_")
    points, per_axis = lattice(a, iou_threshold)
    longest = F.greatest(G.width(a), G.height(a))
    asking = smaller.withColumns({"_lo": tier(longest * iou_threshold * 0.999), "_hi": tier(longest / iou_threshold * 1.001)})
    asking = asking.withColumn("_p", F.explode(points)).select("*", "_p.*").drop("_p")
    others = [F.col(c).alias(f"o_{c}") for c in larger.columns if c not in keys]
    pairs = inside(asking, larger.select(*keys, *slightly_larger(a), *others), keys, ("_lo", "_hi"), pair_limit)
    small, large = G.area(a), G.area(b)
    pairs = pairs.filter((small < large) | ((small == large) & (F.col("rank") < F.col("o_rank"))))
    for axis, i in (("x", "i"), ("y", "j")):  # count the pair at the first point held
        low, high = F.col(f"{axis}1"), F.col(f"{axis}2")
        before = low + (high - low) * ((F.col(i) - 1) / (per_axis + 1))
        pairs = pairs.filter((F.col(i) == 1) | (before < F.col(f"b{axis}1")))
    kept = [*smaller.columns, *[f"o_{c}" for c in larger.columns if c not in keys]]
    return pairs.filter(G.exceeds_iou(a, b, iou_threshold)).select(*kept)


def overlap_summary(
    df: DataFrame, iou_threshold: float = 0.5, keys: Sequence[str] = PAGE_KEYS, pair_limit: int | None = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Detections and overlapping pairs (IoU over the threshold) per page. Copies of
    a box are counted by multiplication, not by pairing them. Pages of up to `page_rows`
    detections are compared whole, larger ones by cells (with `pair_limit` all by `celltree`)."""
    keys = list(keys)
    if pair_limit is not None:
        return _counted(df, iou_threshold, keys, pair_limit)

    def on_pages(df: DataFrame) -> DataFrame:
        # brought together by page once, for copies, pairs and counts
        boxes = df.select(*keys, "det_idx", *G.Box._fields).repartition(*keys)
        distinct = _copies(boxes, keys)
        right = distinct.select(*[F.col(c).alias(f"o_{c}") for c in distinct.columns])
        met = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"o_{k}") for k in keys]) & (F.col("rank") < F.col("o_rank"))
        pairs = distinct.join(right, met & G.exceeds_iou(G.box(), G.box("o_"), iou_threshold))
        across = pairs.groupBy(*keys).agg(F.sum(F.col("n") * F.col("o_n")).alias("_across"))
        n = F.col("n")
        within = F.sum(F.floor(n * (n - 1) / 2)) if iou_threshold < 1.0 else F.lit(0).cast("long")
        copies = distinct.groupBy(*keys).agg(within.alias("_within"))
        rows = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_detections"))
        counted = rows.join(copies, keys, "left").join(across, keys, "left")
        zero = F.lit(0).cast("long")
        return counted.select(*keys, "total_detections", (F.coalesce("_within", zero) + F.coalesce("_across", zero)).alias("overlapping_pairs"))

    large = large_groups([df], keys, page_rows)
    return in_two_ways([df], keys, large, on_pages, lambda rows: _counted(rows, iou_threshold, keys, None))


def _counted(df: DataFrame, iou_threshold: float, keys: list[str], pair_limit: int | None) -> DataFrame:
    distinct = _copies(df, keys)
    if pair_limit is not None:
        met = overlapping(distinct, distinct, keys, iou_threshold, pair_limit)
        across = met.select(*keys, (F.col("n") * F.col("o_n")).alias("pairs"), F.lit(0).alias("rows"))
    else:
        distinct = distinct.withColumn("octave", C.octave_of(G.box()))
        left = C.spread_octaves(distinct, iou_threshold)
        right = left.select(
            *keys, "tier", "cx", "cy",
            *[F.col(c).alias(f"o_{c}") for c in ("rank", "own", "n", "x1", "y1", "x2", "y2")],
        )
        side = F.pow(F.lit(2.0), F.col("tier"))
        a, b = G.box(), G.box("o_")
        across = (
            left.join(right, [*keys, "tier", "cx", "cy"])
            .filter(F.col("rank") < F.col("o_rank"))
            .filter(F.col("own") | F.col("o_own"))
            .filter(C.cell(F.greatest(a.x1, b.x1), side) == F.col("cx"))
            .filter(C.cell(F.greatest(a.y1, b.y1), side) == F.col("cy"))
            .filter(G.exceeds_iou(a, b, iou_threshold))
            .select(*keys, (F.col("n") * F.col("o_n")).alias("pairs"), F.lit(0).alias("rows"))
        )
    n = F.col("n")
    within = distinct.select(*keys, F.floor(n * (n - 1) / 2).alias("pairs"), F.lit(0).alias("rows"))
    if iou_threshold >= 1.0:
        within = within.withColumn("pairs", F.lit(0).cast("long"))
    rows = df.select(*keys, F.lit(0).cast("long").alias("pairs"), F.lit(1).alias("rows"))
    return (
        across.unionByName(within)
        .unionByName(rows)
        .groupBy(*keys)
        .agg(F.sum("rows").alias("total_detections"), F.sum("pairs").alias("overlapping_pairs"))
    )


def _walked(thin: DataFrame, keys: list[str], iou_threshold: float, n: int, block: int) -> DataFrame:
    """The first `n` pairs `hi, lo` of each page of `thin`, block after block."""
    open_ = cut_lineage(numbered(thin, keys, [F.col("rank")], "_k"))
    start, found, left = 0, [], None
    while True:
        end = start + block
        mine = open_.filter((F.col("_k") > start) & (F.col("_k") <= end)).drop("_k")
        rest = open_.filter(F.col("_k") > start).drop("_k")
        up = overlapping(mine, rest, keys, iou_threshold).filter("rank < o_rank").select(*keys, F.col("rank").alias("hi"), F.col("o_rank").alias("lo"))
        down = overlapping(rest, mine, keys, iou_threshold).filter("o_rank < rank").select(*keys, F.col("o_rank").alias("hi"), F.col("rank").alias("lo"))
        left_n = F.lit(n) if left is None else F.col("_left")
        met = up.unionByName(down)
        met = met if left is None else met.join(left, keys)
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("hi", "lo"))
        pairs = cut_lineage(met.withColumn("_n", place).filter(F.col("_n") <= left_n).select(*keys, "hi", "lo"))
        found.append(pairs)
        # pages with boxes beyond the block that still lack pairs
        more = open_.filter(F.col("_k") > end).select(*keys).distinct()
        more = more.withColumn("_left", F.lit(n)) if left is None else more.join(left, keys)
        got = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_got"))
        left = more.join(got, keys, "left").select(*keys, (F.col("_left") - F.coalesce("_got", F.lit(0))).alias("_left"))
        left = cut_lineage(left.filter("_left > 0"))
        if not left.limit(1).count():
            break
        open_ = cut_lineage(open_.filter(F.col("_k") > end).join(left.select(*keys), keys, "left_semi"))
        start, block = end, block * NEXT_BLOCK
    return reduce(DataFrame.unionByName, found)


def overlap_sample(
    df: DataFrame, iou_threshold: float = 0.5, n: int = 10, keys: Sequence[str] = PAGE_KEYS, block: int | None = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """The first `n` overlapping pairs of each page in list order. Pages of up to `page_rows`
    detections are compared whole, larger ones by cells.

    With `block` (for dense pages) a page's boxes are walked in blocks in list order, the first
    of `block` boxes, each following one `NEXT_BLOCK` times as long: the pairs whose first box
    lies in the block are found, and the page is done once it has `n`. A box that is the k-th copy of its kind
    pairs with the k-1 copies before it, so pairs with later copies than the n+1-th cannot
    be among the first n.
    """
    keys = list(keys)
    if block is not None:
        return _sampled(df, iou_threshold, n, keys, block)
    b = G.box()

    def on_pages(df: DataFrame) -> DataFrame:
        solid = df.filter((G.width(b) > 0) & (G.height(b) > 0))
        # brought together by page once, for copies, pairs and their order
        solid = solid.select(*keys, "det_idx", "class_name", "confidence", *G.Box._fields).repartition(*keys)
        thin = first_n(solid, [*keys, *G.Box._fields], [F.col("det_idx")], n + 1) if iou_threshold < 1.0 else solid
        first, second = (thin.select(*[F.col(c).alias(f"{p}_{c}") for c in thin.columns]) for p in ("a", "b"))
        met = reduce(lambda x, y: x & y, [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys]) & (F.col("a_det_idx") < F.col("b_det_idx"))
        pairs = first.join(second, met & G.exceeds_iou(G.box("a_"), G.box("b_"), iou_threshold))
        pairs = first_n(pairs.withColumnsRenamed({f"a_{k}": k for k in keys}), keys, [F.col("a_det_idx"), F.col("b_det_idx")], n)
        described = [c for c in thin.columns if c not in keys]
        return pairs.select(
            *keys, *[f"{p}_{c}" for p in ("a", "b") for c in described], G.iou(G.box("a_"), G.box("b_")).alias("iou")
        )

    large = large_groups([df], keys, page_rows)
    return in_two_ways([df], keys, large, on_pages, lambda rows: _sampled(rows, iou_threshold, n, keys, None))


def _sampled(df: DataFrame, iou_threshold: float, n: int, keys: list[str], block: int | None) -> DataFrame:
    b = G.box()
    solid = df.filter((G.width(b) > 0) & (G.height(b) > 0))
    copies = [*keys, "x1", "y1", "x2", "y2"]
    thin = first_n(solid, copies, [F.col("det_idx")], n + 1) if iou_threshold < 1.0 else solid
    thin = thin.select(*copies, F.col("det_idx").alias("rank"))
    if block is None:
        pairs = first_n(_paired(thin.withColumn("octave", C.octave_of(b)), keys, iou_threshold, False), keys, [F.col("hi"), F.col("lo")], n)
    else:
        pairs = _walked(thin, keys, iou_threshold, n, block)
    described = df.select(*keys, "det_idx", "class_name", "confidence", *G.Box._fields)
    first, second = (
        described.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in described.columns if c not in keys])
        for p in ("a", "b")
    )
    described = [c for c in described.columns if c not in keys]
    return (
        pairs.withColumnsRenamed({"hi": "a_det_idx", "lo": "b_det_idx"})
        .join(first, [*keys, "a_det_idx"])
        .join(second, [*keys, "b_det_idx"])
        .select(*keys, *[f"{p}_{c}" for p in ("a", "b") for c in described], G.iou(G.box("a_"), G.box("b_")).alias("iou"))
    )
