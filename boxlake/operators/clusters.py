"""Connected components of nearby texts, and the areas they form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import cells as C
from boxlake.functions import geometry as G
from boxlake.functions.text import strip
from boxlake.operators import pagewise
from boxlake.operators.areas import AREA_TYPES, area_id, area_type
from boxlake.operators.spatial import CELL_LIMIT, attach, symbol_places
from boxlake.session import cut_lineage, cut_sized

# A cell is small enough that all its points are within the radius of each other;
# it is divided into FINE x FINE parts whose occupancy fits the bits of a long.
CELLS_PER_RADIUS = 1.5
REACH = 2
FINE = 8


def _to_roots(parent: DataFrame, keys: list[str]) -> DataFrame:
    """Pointer jumping: `node, root` where `root` was the parent and becomes the top of
    the chain. Every pass shortens chains to a quarter."""

    def hop(low: DataFrame, high: DataFrame) -> DataFrame:
        above = high.select(*keys, F.col("node").alias("root"), F.col("root").alias("_above"))
        return low.join(above, [*keys, "root"]).drop("root").withColumnRenamed("_above", "root")

    while True:
        twice = hop(parent, parent)
        moved = hop(twice.withColumn("_half", F.col("root")), twice)
        moved = cut_sized(moved.select(*keys, "node", "root", "_half"))
        parent = moved.drop("_half")
        # chains of one step do not move in the second half of a pass
        if not moved.filter("root <> _half").limit(1).count():
            return parent


def _simple(edges: DataFrame, keys: list[str]) -> DataFrame:
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return cut_sized(edges.filter("a <> b").select(*keys, *ends).distinct())


def connected_components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of an undirected graph given as `keys, a, b`: columns `keys, node,
    root`. Nodes hang themselves under their smallest neighbour, chains are followed to
    their top by pointer jumping, and the graph shrinks to the tops until no edge is
    left; rounds grow with the logarithm of the component size."""
    keys = list(keys)
    rest = _simple(edges, keys)
    labels = None
    while labels is None or rest.limit(1).count():
        both = rest.select(*keys, F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            rest.select(*keys, F.col("b").alias("node"), F.col("a").alias("other"))
        )
        smallest = both.groupBy(*keys, "node").agg(F.min("other").alias("m"))
        parent = _to_roots(cut_sized(smallest.select(*keys, "node", F.least("node", "m").alias("root"))), keys)
        if labels is None:
            labels = parent
        else:
            moved = parent.select(*keys, F.col("node").alias("root"), F.col("root").alias("_up"))
            labels = cut_sized(
                labels.join(moved, [*keys, "root"], "left").select(
                    *keys, "node", F.coalesce("_up", "root").alias("root")
                )
            )
        for end in ("a", "b"):
            to = parent.select(*keys, F.col("node").alias(end), F.col("root").alias("_r"))
            rest = rest.join(to, [*keys, end]).drop(end).withColumnRenamed("_r", end)
        rest = _simple(rest, keys)
    return labels


def _offsets() -> list[tuple[int, int]]:
    """Forward neighbours of a cell that may hold points within the radius."""
    span = range(-REACH, REACH + 1)
    return [(dx, dy) for dx in span for dy in span if (dx, dy) > (0, 0)]


def _masks(dx: int, dy: int) -> tuple[list[int], list[int]]:
    """For each part of a cell, the parts of the neighbour at (dx, dy) that are surely
    and possibly within the radius, as bits."""
    unit = 1.0 / (CELLS_PER_RADIUS * FINE)  # side of a part over the radius
    sure, maybe = [], []
    for i in range(FINE * FINE):
        s = m = 0
        for j in range(FINE * FINE):
            ax, ay = abs(dx * FINE + j % FINE - i % FINE), abs(dy * FINE + j // FINE - i // FINE)
            far = unit * ((ax + 1) ** 2 + (ay + 1) ** 2) ** 0.5
            near = unit * (max(0, ax - 1) ** 2 + max(0, ay - 1) ** 2) ** 0.5
            s |= (far <= 1.0 - 1e-9) << j
            m |= (near <= 1.0 + 1e-9) << j
        sure.append(s)
        maybe.append(m)
    return sure, maybe


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _touching(kind: int):
    """Whether the occupied parts `mask` and `o_mask` of two cells at `dx, dy` come
    within the radius: surely (0) or possibly (1)."""
    branches = []
    for dx, dy in _offsets():
        masks = _masks(dx, dy)[kind]
        if any(masks):
            reach = ", ".join(f"{_signed(m)}L" if _signed(m) > -(1 << 63) else "(-9223372036854775807L - 1L)" for m in masks)
            branches.append(f"WHEN dx = {dx} AND dy = {dy} THEN array({reach})")
    table = f"CASE {' '.join(branches)} END"
    return F.coalesce(
        F.expr(
            f"exists(sequence(0, {FINE * FINE - 1}), i -> (shiftright(mask, i) & 1L) = 1L"
            f" AND (o_mask & element_at({table}, i + 1)) <> 0L)"
        ),
        F.lit(False),
    )


def clusters(texts: DataFrame, radius: float = 100.0, by_page: bool = True, page_rows: int = pagewise.PAGE_ROWS) -> DataFrame:
    """Adds `cluster_id`: texts belong together when a chain of texts with center
    distances up to `radius` links them. The id is the smallest `text_idx` inside, so
    with `by_page=False` ordinals must be unique in the document. Pages of up to `page_rows`
    texts are settled whole, larger ones by cells."""
    keys = ["doc", "page"] if by_page else ["doc"]
    boxed = texts.filter(G.has_box(G.box()))
    return _clusters(boxed, radius, keys, pagewise.large_groups([boxed], keys, page_rows))


def _page_ids(radius: float) -> Column:
    """Cluster ids of the array `_texts` of a page."""
    return pagewise.chain_ids(radius)(*[F.col(f"_texts.{n}") for n in (*G.Box._fields, "text_idx")])


def _clusters(boxed: DataFrame, radius: float, keys: list[str], large: DataFrame | None) -> DataFrame:
    def on_pages(boxed: DataFrame) -> DataFrame:
        pages = pagewise.pages_of(boxed, keys, "_texts")
        return pagewise.rows_of(pages, keys, "_texts", cluster_id=_page_ids(radius)).select(*boxed.columns, "cluster_id")

    return pagewise.in_two_ways([boxed], keys, large, on_pages, lambda rows: _clusters_by_cells(rows, radius, keys))


def _clusters_by_cells(texts: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    part = radius / (CELLS_PER_RADIUS * FINE)
    b = G.box()
    boxed = texts.withColumns({"_px": G.center_x(b), "_py": G.center_y(b)})
    fx, fy = C.cell(F.col("_px"), part), C.cell(F.col("_py"), part)
    cell_x, cell_y = F.floor(fx / FINE), F.floor(fy / FINE)
    placed = boxed.withColumns({"cx": cell_x, "cy": cell_y})
    bit = (F.pmod(fx, F.lit(FINE)) + F.pmod(fy, F.lit(FINE)) * FINE).cast("int")
    at = [*keys, "cx", "cy"]
    extent = [f(c).alias(f"{p}{c}") for c in ("_px", "_py") for p, f in (("lo", F.min), ("hi", F.max))]
    sides = [f"{p}{c}" for c in ("_px", "_py") for p in ("lo", "hi")]
    occupied = cut_sized(
        placed.groupBy(*at).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"),
            F.min("text_idx").alias("first"),
            *extent,
        )
    )
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _offsets()])
    around = occupied.select(*at, "mask", *sides, F.explode(steps).alias("_s")).select(
        *keys, F.col("cx").alias("ax"), F.col("cy").alias("ay"), "mask", *sides, "_s.dx", "_s.dy",
        (F.col("cx") + F.col("_s.dx")).alias("cx"), (F.col("cy") + F.col("_s.dy")).alias("cy"),
    )
    pairs = around.join(occupied.select(*at, *[F.col(c).alias(f"o_{c}") for c in ("mask", *sides)]), at)
    gap = [F.greatest(F.col(f"o_lo{c}") - F.col(f"hi{c}"), F.col(f"lo{c}") - F.col(f"o_hi{c}"), F.lit(0.0)) for c in ("_px", "_py")]
    far = [F.greatest(F.col(f"o_hi{c}") - F.col(f"lo{c}"), F.col(f"hi{c}") - F.col(f"o_lo{c}")) for c in ("_px", "_py")]
    near, most = (F.sqrt(x * x + y * y) for x, y in (gap, far))
    # the extents of the points settle most pairs, the occupied parts most of the rest
    sure = F.when(most <= radius, True).when(near > radius, False).otherwise(_touching(0))
    maybe = F.when(near > radius, False).otherwise(F.col("sure") | _touching(1))
    judged = cut_sized(
        pairs.withColumn("sure", sure).withColumn("maybe", maybe).filter("maybe").select(*keys, "ax", "ay", "cx", "cy", "sure")
    )
    # neighbours whose occupied parts do not settle it: look at the points
    unsettled = judged.filter(~F.col("sure")).drop("sure")
    points = placed.select(*at, "_px", "_py").distinct()
    here = unsettled.join(
        points.select(*keys, F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("_px").alias("px"), F.col("_py").alias("py")),
        [*keys, "ax", "ay"],
    )
    met = here.alias("h").join(
        points.alias("p"),
        _all_equal([*keys, "cx", "cy"], "h", "p")
        & (G.point_distance(F.col("px"), F.col("py"), F.col("_px"), F.col("_py")) <= radius),
        "left_semi",
    )
    links = judged.filter("sure").drop("sure").unionByName(met.select(*keys, "ax", "ay", "cx", "cy").distinct())
    edges = links.select(
        *keys,
        F.struct(F.col("ax").alias("cx"), F.col("ay").alias("cy")).alias("a"),
        F.struct("cx", "cy").alias("b"),
    )
    roots = connected_components(edges, keys).select(*keys, "node.cx", "node.cy", "root")
    own = F.struct("cx", "cy")
    labelled = occupied.join(roots, at, "left").select(*at, F.coalesce("root", own).alias("root"), "first")
    ids = labelled.groupBy(*keys, "root").agg(F.min("first").alias("cluster_id"))
    named = labelled.join(ids, [*keys, "root"]).select(*at, "cluster_id")
    return placed.join(named, at).select(*texts.columns, "cluster_id")


def _all_equal(names, left, right):
    cond = F.lit(True)
    for n in names:
        cond = cond & (F.col(f"{left}.{n}") == F.col(f"{right}.{n}"))
    return cond


def cluster_areas(
    texts: DataFrame,
    symbols: DataFrame,
    radius: float = 100.0,
    symbol_radius: float = 200.0,
    size: float = 100.0,
    by_page: bool = True,
    types: Mapping[str, str] = AREA_TYPES,
) -> tuple[DataFrame, DataFrame]:
    """`(areas, members)`. An area is a cluster with its box, text and symbol counts and
    a type from the class most texts are attached to (the class seen first on ties).
    Members are the texts with `cluster_id` and their symbol within `symbol_radius`. Both are
    found anew when they are read, so write members that are read again."""
    keys = ["doc", "page"] if by_page else ["doc"]
    boxed = texts.filter(G.has_box(G.box()))
    targets = cut_lineage(symbol_places(symbols, by_page, ("class_name",)))
    large = pagewise.large_groups([boxed, targets], keys)

    def on_pages(boxed: DataFrame, targets: DataFrame) -> DataFrame:
        ids = {"cluster_id": _page_ids(radius)}
        return attach(boxed, targets, symbol_radius, True, by_page, False, CELL_LIMIT, None, ("class_name",), ids)

    def by_cells(boxed: DataFrame, targets: DataFrame) -> DataFrame:
        grouped = _clusters_by_cells(boxed, radius, keys)
        return attach(grouped, targets, symbol_radius, True, by_page, False, CELL_LIMIT, large, ("class_name",))

    members = pagewise.in_two_ways([boxed, targets], keys, large, on_pages, by_cells)
    area = [*keys, "cluster_id"]
    # without large groups an area has few rows: they are brought together once for all steps
    rows = members.repartition(*area) if large is None else members
    linked = F.col("sym_idx").isNotNull()
    sides = [f(c).alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))]
    per_symbol = rows.groupBy(*area, *([] if by_page else ["sym_page"]), "sym_idx", "sym_class_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("text_idx").alias("first"), *sides,
        F.count_if(F.length(strip(F.col("text"))) > 0).alias("text_count"),
    )
    per_class = per_symbol.groupBy(*area, "sym_class_name").agg(
        F.sum(F.when(linked, F.col("n"))).alias("n"), F.min(F.when(linked, F.col("first"))).alias("first"),
        F.count("sym_idx").alias("symbols"), *sides, F.sum("text_count").alias("text_count"),
    )
    rank = F.when(F.col("symbols") > 0, F.struct(F.col("n"), (-F.col("first")).alias("f")))
    boxes = per_class.groupBy(*area).agg(
        F.max_by("sym_class_name", rank).alias("main_class"), F.sum("symbols").alias("symbol_count"),
        *sides, F.sum("text_count").alias("text_count"),
    )
    kind = area_type(F.col("main_class"), types)
    areas = boxes.select(
        *area,
        area_id(kind, F.col("x1"), F.col("y1"), size).alias("area_id"),
        kind.alias("area_type"),
        "x1", "y1", "x2", "y2",
        "text_count",
        "symbol_count",
    )
    return areas, members
