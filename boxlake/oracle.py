"""DuckDB SQL for each query of `boxlake.queries`, over the same tables.

The derived tables of `boxlake.fixtures` are restated here as CTEs.
"""

from __future__ import annotations

ORDINAL = "(l_orderkey * 8 + l_linenumber) * 262144 + (l_partkey * 7919 + round(l_extendedprice * 100)::bigint) % 262144"
PAGE = "(1 + l_orderkey % 4)::int"
CLASS = "case l_returnflag when 'A' then 'Tag-ID' when 'N' then 'resistor' else 'connector' end"
X1 = "((l_partkey % 20) * 140 + l_orderkey % 23)::double"
Y1 = "((l_orderkey % 16) * 140 + l_partkey % 19)::double"
Q = "l_quantity::int"
TEXT = f"""case l_linenumber
  when 1 then 'I' || (l_partkey % 10) || '.' || {Q}
  when 2 then ' Q' || (l_orderkey % 10) || '.' || {Q} || ' '
  when 3 then 'DB' || l_partkey
  when 4 then 'Motor_' || (l_orderkey % 7)
  when 5 then 'T' || (l_partkey % 50)
  when 6 then 'Valve ' || (l_orderkey % 100)
  else case when l_partkey % 2 = 0 then '  ' else 'C' || (l_partkey % 90) end end"""

BASE = f"""base as materialized (
  select *, {X1} + 40 + {Q} as x2, {Y1} + 30 + l_linenumber * 5 as y2,
    x1 + (l_partkey % 7) * 30 - 60 as sx1, y1 + (l_orderkey % 5) * 40 - 80 as sy1
  from (select l_suppkey as doc, {PAGE} as page, {ORDINAL} as idx, {CLASS} as class_name,
    case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as class_id,
    (28 + round(l_discount * 1000)::int) / 128.0::double as confidence,
    {X1} as x1, {Y1} as y1, {TEXT} as text, {Q} as q, lineitem.* from lineitem))"""

DET = """det as materialized (
  select *, x1 - ox as tx1, y1 - oy as ty1, x2 - ox as tx2, y2 - oy as ty2,
    doc || '_p' || page || '_r' || "row" || '_c' || col || '.png' as tile
  from (select *, case col when 2 then page_w - 1500 else col * 1000 end as ox,
      case "row" when 2 then page_h - 1200 else "row" * 700 end as oy
    from (select doc, page, idx as det_idx, class_id, class_name, confidence, x1, y1, x2, y2,
        (2700 + (doc % 5) * 25)::int as page_w, 2150 + page * 10 as page_h,
        least(2, floor(x1 / 1000))::int as col, least(2, floor(y1 / 700))::int as "row"
      from base)))"""

PAGES = """pages5 as materialized (
  select s_suppkey as doc, p::int as page, (2700 + (s_suppkey % 5) * 25)::int as page_w, (2150 + p * 10)::int as page_h
  from supplier, range(1, 6) r(p))"""

TEXTS = """txt as materialized (
  select doc, page, idx as text_idx, text, 1.0::double as confidence, sx1 as x1, sy1 as y1,
    sx1 + 10 * length(text) as x2, sy1 + 12 as y2, 'pdf' as source from base)"""

OCR = """ocr as materialized (
  select *, x1 + 10 * length(otext) as x2_unused from (
  select doc, page, idx as text_idx,
    case q % 3 when 0 then lower(text) when 1 then text || 'X' else 'N' || l_partkey end as otext,
    (64 + l_partkey % 64) / 128.0::double as confidence,
    sx1 + (q % 4) * 8 as x1, sy1 as y1, sx1 + 10 * length(text) + (q % 4) * 8 as x2, sy1 + 12 as y2,
    'ocr' as source, case when q % 2 = 0 then idx end as sym_idx,
    case when q % 2 = 0 then class_name end as sym_class_name,
    case when q % 2 = 0 then base.x1 end as sym_x1, case when q % 2 = 0 then base.y1 end as sym_y1,
    case when q % 2 = 0 then base.x2 end as sym_x2, case when q % 2 = 0 then base.y2 end as sym_y2,
    case when q % 2 = 0 then least(2, floor(base.y1 / 700))::int end as "row",
    case when q % 2 = 0 then least(2, floor(base.x1 / 1000))::int end as col
  from base))"""

GRID = """grid as materialized (
  select doc, page, page_w, page_h, nr as "rows", nc as cols,
    doc || '_p' || page || '_r' || r || '_c' || c || '.png' as tile, r::int as "row", c::int as col,
    greatest(0, least(c * ({w} - {o}), page_w - {w}))::int as x1, greatest(0, least(r * ({h} - {o}), page_h - {h}))::int as y1
  from (select *, (wc + case when page_w > wc * ({w} - {o}) then 1 else 0 end)::int as nc,
      (wr + case when page_h > wr * ({h} - {o}) then 1 else 0 end)::int as nr
    from (select *, greatest(1, floor((page_w - {o}) / ({w} - {o})::double)) as wc,
      greatest(1, floor((page_h - {o}) / ({h} - {o})::double)) as wr from {pages})) g,
    range(0, 40) a(r), range(0, 40) b(c) where r < nr and c < nc),
tiles as (select *, least(x1 + {w}, page_w)::int as x2, least(y1 + {h}, page_h)::int as y2,
  x2 - x1 as width, y2 - y1 as height from grid)"""

ORDER_PAGES = """opages as materialized (
  select o_custkey as doc, o_orderkey::int as page, (900 + (o_orderkey * 37) % 4100)::int as page_w,
    (700 + (o_orderkey * 53) % 3300)::int as page_h from orders)"""


def grid(pages: str, w: int = 1500, h: int = 1200, o: int = 500) -> str:
    return GRID.format(pages=pages, w=w, h=h, o=o)


def inter(a: str, b: str) -> str:
    return (
        f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
        f" * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    )


def area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"({i} / ({area(a)} + {area(b)} - {i}))"


def nms(name: str, source: str, threshold: float, keys: str = "doc, page, class_name", op: str = ">") -> str:
    """Greedy suppression as a fold; `name` has the key columns and `det_idx`."""
    return f"""{name}_fold as materialized (
  select {keys}, list_reduce(a, lambda acc, e: case when len(list_filter(acc, lambda k: {iou('k', 'e')} {op} {threshold})) > 0
      then acc else list_append(acc, e) end, list_filter(a, lambda z: false)) as kept
  from (select {keys}, list({{'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} order by confidence desc, det_idx) as a
    from {source} group by {keys})),
{name} as materialized (select {keys}, unnest(kept).det_idx as det_idx from {name}_fold)"""


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def clean(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^\\w]', '', 'g')"


# The default patterns with their priorities.
PATTERNS = {
    "input": (r"I\d+\.\d+", 10), "output": (r"Q\d+\.\d+", 10), "memory": (r"M\d+\.\d+", 9), "timer": (r"T\d+", 8),
    "counter": (r"C\d+", 8), "function_block": (r"FB\d+", 7), "data_block": (r"DB\d+", 7),
    "analog_input": (r"AI\d+", 6), "analog_output": (r"AO\d+", 6), "variable": (r"[A-Z][A-Z0-9_]{2,}", 5),
    "numeric": (r"\d+\.?\d*", 3), "label": (r"[A-Za-z][A-Za-z0-9_]{1,}", 2),
}


def hit(t: str, name: str) -> str:
    return f"regexp_matches({t}, '(?i){PATTERNS[name][0]}')"


def patterns(t: str) -> str:
    return "concat_ws(','" + "".join(f", case when {hit(t, n)} then '{n}' end" for n in PATTERNS) + ")"


def relevance(t: str) -> str:
    bonus = " + ".join(f"case when {hit(t, n)} then {PATTERNS[n][1]} else 0 end" for n in PATTERNS)
    return f"round(1.0::double + {bonus} + least(2.0, length({t}) / 5.0::double) + case when regexp_matches({t}, '\\d') then 1 else 0 end, 2)"


def tagged(name: str, source: str) -> str:
    return f"{name} as materialized (select *, {patterns('text')} as patterns, {relevance('text')}::double as relevance from (select * replace (trim(text) as text) from {source}) where text <> '')"


def near(name: str, spans: str, boxes: str) -> str:
    """Spans whose center lies in a box grown by its own size."""
    return f"""{name} as materialized (select s.* replace (trim(s.text) as text) from {spans} s where trim(s.text) <> '' and exists (
  select 1 from {boxes} b where b.doc = s.doc and b.page = s.page
    and (s.x1 + s.x2) / 2 between greatest(0, b.x1 - (b.x2 - b.x1)) and b.x2 + (b.x2 - b.x1)
    and (s.y1 + s.y2) / 2 between greatest(0, b.y1 - (b.y2 - b.y1)) and b.y2 + (b.y2 - b.y1)))"""


def fused(name: str, pdf: str, ratio: bool = False) -> str:
    """PDF texts and the recognised texts that repeat none."""
    strict = (
        "and (ca = cb or least(length(ca), length(cb)) / greatest(length(ca), length(cb))::double > 0.8)" if ratio else ""
    )
    return f"""{name}_p as materialized (select *, {clean('text')} as ca from {pdf}),
{name}_o as materialized (select *, {clean('otext')} as cb from ocr),
{name}_dup as materialized (select distinct o.doc, o.page, o.text_idx from {name}_o o join {name}_p p on o.doc = p.doc and o.page = p.page
  where ca <> '' and cb <> '' and (contains(ca, cb) or contains(cb, ca)) {strict}
    and least({area('o')}, {area('p')}) > 0 and {inter('o', 'p')} / least({area('o')}, {area('p')}) > 0.5),
{name} as materialized (
  select doc, page, text_idx, text, confidence, x1, y1, x2, y2, source, null::bigint as sym_idx from {pdf}
  union all
  select doc, page, text_idx + 4611686018427387904, otext, confidence, x1, y1, x2, y2, source, sym_idx
  from ocr anti join {name}_dup using (doc, page, text_idx))"""


def distance(a: str, b: str) -> str:
    dx = f"(({a}.x1 + {a}.x2) / 2 - ({b}.x1 + {b}.x2) / 2)"
    dy = f"(({a}.y1 + {a}.y2) / 2 - ({b}.y1 + {b}.y2) / 2)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def nearest(name: str, texts: str, symbols: str, cond: str, keys: str = "doc, page", sid: str = "s.det_idx") -> str:
    return f"""{name} as materialized (select doc, page, text_idx, min(struct_pack(d := d, i := i)) as best from (
  select t.doc, t.page, t.text_idx, {distance('t', 's')} as d, {sid} as i from {texts} t join {symbols} s on
    {' and '.join(f't.{k} = s.{k}' for k in keys.split(', '))}) where d {cond} group by doc, page, text_idx)"""


RANKED_REGIONS = """reg as materialized (
  select doc as document, page, text_idx, trim(otext) as text_content, confidence, x1, y1, x2, y2, source,
    printf('area_%s_%03d_%03d', coalesce(sym_class_name, 'text'), floor(coalesce(sym_x1, x1) / 100)::bigint,
      floor(coalesce(sym_y1, y1) / 100)::bigint) as area_id,
    case when sym_class_name is null then 'text' when sym_class_name = 'resistor' then 'component'
      when sym_class_name = 'connector' then 'connection' else 'symbol' end as area_type,
    least(x1, x2) as x, least(y1, y2) as y, abs(x2 - x1) as width, abs(y2 - y1) as height
  from ocr where trim(otext) <> ''),
keyed as materialized (select *, list_append(list_transform(regexp_extract_all(upper(text_content), '[A-Z]+|\\d+'), lambda p:
    case when regexp_matches(p, '^\\d') then {'r': 0, 'n': p::bigint, 's': '', 'x': 0::double, 'y': 0::double}
    else {'r': 1, 'n': 0::bigint, 's': p, 'x': 0::double, 'y': 0::double} end),
    {'r': 2, 'n': 0::bigint, 's': '', 'x': x, 'y': y}) as k from reg)"""

CORE = with_(BASE, DET)
ORACLE: dict[str, str] = {}

# ------------------------------------------------------------ duplicates

ORACLE["nms_by_class"] = with_(BASE, DET, nms("kept", "det", 0.5)) + """
select doc, class_name, count(*) as kept, sum(confidence) as confidence, min(det_idx) as first_idx
from kept join det using (doc, page, class_name, det_idx) group by doc, class_name"""
ORACLE["nms_survivors"] = with_(BASE, DET, nms("kept", "det", 0.5)) + """
select doc, page, det_idx, class_name, confidence, x1, y1, x2, y2 from kept join det using (doc, page, class_name, det_idx)"""
ORACLE["nms_any_class"] = with_(BASE, DET, nms("kept", "det", 0.3, "doc, page")) + """
select doc, page, det_idx, class_name from kept join det using (doc, page, det_idx)"""
PRE = with_(BASE, DET, "sure as (select * from det where confidence >= 0.25)", nms("kept", "sure", 0.5, op=">="))
ORACLE["preprocessed_detections"] = PRE + """
select doc, page, det_idx, class_name, confidence from kept join det using (doc, page, class_name, det_idx)"""
ORACLE["reduction_by_page"] = PRE + """
select doc, page, a as original_detection_count, coalesce(b, 0) as processed_detection_count
from (select doc, page, count(*) as a from det group by doc, page)
left join (select doc, page, count(*) as b from kept group by doc, page) using (doc, page)"""
ORACLE["reduction_by_document"] = PRE + f"""
select doc, a as total_original_detections, coalesce(b, 0) as total_processed_detections,
  {r6('(a - coalesce(b, 0)) / a::double * 100')} as reduction_percentage
from (select doc, count(*) as a from det group by doc) left join (select doc, count(*) as b from kept group by doc) using (doc)"""
ORACLE["tag_duplicates"] = with_(
    BASE, DET, "tags as (select * from det where class_name = 'Tag-ID')", nms("kept", "tags", 0.7)
) + """
select doc, page, det_idx, class_name from kept
union all select doc, page, det_idx, class_name from det where class_name <> 'Tag-ID'"""
PAIRS = with_(BASE, DET, f"""pairs as materialized (select a.doc, a.page, a.det_idx as a_det_idx, b.det_idx as b_det_idx,
  a.class_name as a_class_name, b.class_name as b_class_name, a.confidence as a_confidence, b.confidence as b_confidence,
  {iou('a', 'b')} as iou from det a join det b on a.doc = b.doc and a.page = b.page and a.det_idx < b.det_idx
  where {inter('a', 'b')} > 0 and {iou('a', 'b')} > 0.5)""")
ORACLE["overlap_pairs"] = PAIRS + """
select doc, page, n as total_detections, coalesce(p, 0) as overlapping_pairs
from (select doc, page, count(*) as n from det group by doc, page)
left join (select doc, page, count(*) as p from pairs group by doc, page) using (doc, page)"""
ORACLE["overlap_examples"] = PAIRS + """
select * from pairs qualify row_number() over (partition by doc, page order by a_det_idx, b_det_idx) <= 10"""

# ------------------------------------------------------------ tiles and pages

TILES = with_(ORDER_PAGES, grid("opages"))
ORACLE["tile_grid"] = TILES + "select * from tiles"
ORACLE["tile_grid_plain"] = with_(ORDER_PAGES, grid("opages", 800, 600, 0)) + """
select doc, page, count(*) as tiles, sum(width * height)::bigint as pixels, max(x2) as "right", max(y2) as bottom
from tiles group by doc, page"""
ORACLE["tiles_to_page"] = with_(BASE, DET, PAGES, grid("pages5")) + """
select t.doc, t.page, d.det_idx, t.x1 + d.tx1 as x1, t.y1 + d.ty1 as y1, t.x1 + d.tx2 as x2, t.y1 + d.ty2 as y2,
  d.tx1, d.ty1, t.tile, t."row", t.col from det d join tiles t using (tile)"""
ORACLE["tiles_to_page_numbered"] = with_(BASE, DET, PAGES, grid("pages5")) + """
select t.doc, t.page, row_number() over (partition by t.doc, t.page order by t."row", t.col, d.det_idx) - 1 as det_idx,
  t.x1 + d.tx1 as x1, t.y1 + d.ty1 as y1, t.x1 + d.tx2 as x2, t.y1 + d.ty2 as y2, t.tile from det d join tiles t using (tile)"""
ORACLE["pages_with_detections"] = with_(BASE, DET, PAGES) + """
select doc, page, p.page_w, p.page_h, count(det_idx) as detections
from pages5 p left join det using (doc, page) group by all"""
ORACLE["bounds_check"] = CORE + """
select doc, count(*) as detections, count(*) filter (o) as outside, not bool_or(o) as valid
from (select *, x1 < 0 or y1 < 0 or x2 > page_w or y2 > page_h as o from det) group by doc"""
ORACLE["out_of_bounds_boxes"] = CORE + """
select doc, page, det_idx, x1, y1, x2, y2 from det where x1 < 0 or y1 < 0 or x2 > page_w or y2 > page_h"""
ORACLE["confidence_filter"] = CORE + "select doc, page, det_idx, confidence from det where confidence >= 0.8"
ORACLE["confidence_counts"] = CORE + """
select doc, count(*) as "before", count(*) filter (confidence >= 0.8) as "after" from det group by doc"""
ORACLE["tile_completeness"] = TILES + """,
n as (select *, page + "row" * 3 + col as n from tiles),
files as (select tile, width - case n % 5 when 0 then 13 when 1 then -9 else 0 end as fw,
  height - case when n % 17 = 0 then 1 else 0 end as fh from n where not ("row" = 1 and col = 2)),
judged as (select t.*, fw, case when fw is null then 'missing' when fh <> height then 'height_mismatch'
  when fw <> width then 'width_adjusted' else 'ok' end as status, x1 + floor((width - fw) / 2.0)::int as c
  from tiles t left join files using (tile))
select tile, status, case when status = 'ok' then x1 when status = 'width_adjusted' then p end as place_x1,
  case when status = 'ok' then x2 when status = 'width_adjusted' then p + fw end as place_x2
from (select *, case when c + fw > page_w then page_w - fw else c end as p from judged)""".replace("\n,", ",", 1)
ROI = with_(BASE, DET, """roi as materialized (
  select * from (select *, greatest(0, trunc(x1 * cw / page_w * 2 - 20)::int) as roi_x1, greatest(0, trunc(y1 * ch / page_h * 2 - 20)::int) as roi_y1,
    least(iw, trunc(x2 * cw / page_w * 2 + 20)::int) as roi_x2, least(ih, trunc(y2 * ch / page_h * 2 + 20)::int) as roi_y2
  from (select *, floor(iw / 2.0)::bigint as current_w, floor(ih / 2.0)::bigint as current_h, current_w / page_w::double as sx, current_h / page_h::double as sy
    from (select *, page_w * 2 - 200 as iw, page_h - page * 7 as ih from det))) where roi_x1 < roi_x2 and roi_y1 < roi_y2)""")
ROI = ROI.replace("x1 * cw / page_w", "x1 * sx").replace("y1 * ch / page_h", "y1 * sy").replace("x2 * cw / page_w", "x2 * sx").replace("y2 * ch / page_h", "y2 * sy")
ORACLE["regions_of_interest"] = ROI + "select doc, page, det_idx, roi_x1, roi_y1, roi_x2, roi_y2, current_w, current_h from roi"
ORACLE["expanded_boxes"] = CORE + """
select doc, page, det_idx, greatest(0, x1 - w) as n_x1, greatest(0, y1 - h) as n_y1, x2 + w as n_x2, y2 + h as n_y2,
  greatest(0, x1 - trunc(w * 0.1::double)) as i_x1, greatest(0, y1 - trunc(h * 0.1::double)) as i_y1,
  least(page_w, x2 + trunc(w * 0.1::double))::double as i_x2, least(page_h, y2 + trunc(h * 0.1::double))::double as i_y2,
  w * h as area, (x1 + x2) / 2 as center_x, (y1 + y2) / 2 as center_y
from (select *, x2 - x1 as w, y2 - y1 as h from det)"""
READ = ROI.rstrip() + """,
rd as materialized (select doc, page, det_idx, 0 as rec_idx, 'T' || roi_x1 as text, confidence, page_w, page_h, current_w, current_h,
  x1 as gx, y1 as gy, tx1 as hx, ty1 as hy, "row", col,
  (least(2, roi_x2 - roi_x1 - 4) + roi_x1) / 2.0::double as x1, (least(2, roi_y2 - roi_y1 - 6) + roi_y1) / 2.0::double as y1,
  (greatest(2, roi_x2 - roi_x1 - 4) + roi_x1) / 2.0::double as x2, (greatest(2, roi_y2 - roi_y1 - 6) + roi_y1) / 2.0::double as y2
  from roi where confidence >= 0.5)
"""
ORACLE["recognised_regions"] = READ + "select doc, page, det_idx, rec_idx::int as rec_idx, text, confidence, x1, y1, x2, y2 from rd"

ORACLE["recognised_with_failures"] = ROI + """
select doc, page, det_idx, case when det_idx % 7 = 3 then 0 else 2 end::int as texts,
  case when det_idx % 7 = 3 then 'ValueError: unreadable' end as error from roi"""


def _moved(dx: str, dy: str) -> str:
    sx, sy = "(page_w / current_w::double)", "(page_h / current_h::double)"
    return f"""select doc, page, det_idx, text, {r6(f'x1 * {sx} + {dx}')} as x1, {r6(f'y1 * {sy} + {dy}')} as y1,
  {r6(f'x2 * {sx} + {dx}')} as x2, {r6(f'y2 * {sy} + {dy}')} as y2 from rd"""


ORACLE["recognised_on_page"] = READ + _moved("0", "0")
ORACLE["recognised_with_tile_offset"] = READ + _moved("gx - hx", "gy - hy")
ORACLE["recognised_from_grid_position"] = READ + _moved(
    "case col when 2 then greatest(2000, page_w - 1500) else col * 1000 end",
    'case "row" when 2 then greatest(1400, page_h - 1200) else "row" * 700 end',
)
ORACLE["scored_tiles"] = TILES + """
select tile, count(*) as boxes, sum(10.0 * k + 40)::double as "right", sum(5.0 * n)::double as top, max((k + 1) / 4.0)::double as best
from (select tile, "row" * 3 + col as n from tiles), range(0, 4) r(k)
where k <= n % 4 and (k + 1) / 4.0 >= 0.5 group by tile"""

# ------------------------------------------------------------ texts and symbols

ORACLE["spans_near_boxes"] = with_(BASE, DET, TEXTS, near("hits", "txt", "det")) + """
select doc, page, text_idx, text, 1.0::double as confidence, 'pdf' as source from hits"""
ORACLE["nearest_symbol"] = with_(
    BASE, DET, TEXTS, nms("kept", "det", 0.5), "sym as (select det.* from det semi join kept using (doc, page, det_idx))",
    nearest("nn", "txt", "sym", "< 300"),
) + """
select doc, page, text_idx, best.i as sym_idx, best.d as sym_dist from txt left join nn using (doc, page, text_idx)"""
ORACLE["nearest_symbol_kept"] = with_(BASE, DET, OCR, nearest("nn", "ocr", "det", "< 60")) + """
select doc, page, text_idx, coalesce(sym_idx, best.i) as sym_idx from ocr left join nn using (doc, page, text_idx)"""
ORACLE["nearest_symbol_in_document"] = with_(
    BASE, DET, TEXTS, nearest("nn", "txt", "det", "<= 20", "doc", "struct_pack(p := s.page, i := s.det_idx)")
) + """
select doc, page, text_idx, best.i.p as sym_page, best.i.i as sym_idx, best.d as sym_dist
from txt left join nn using (doc, page, text_idx)"""
FUSED = with_(BASE, TEXTS, OCR, fused("fus", "txt"))
ORACLE["fused_texts"] = FUSED + "select doc, page, text_idx, text, source, sym_idx from fus"
ORACLE["fused_texts_strict"] = with_(BASE, TEXTS, OCR, fused("fus", "txt", True)) + "select doc, page, text_idx, source from fus"
ORACLE["symbols_of_texts"] = with_(BASE, OCR) + """
select doc, page, text_idx, sym_class_name, sym_x1, sym_y1, sym_x2, sym_y2 from ocr"""
TAGGED = with_(BASE, TEXTS, tagged("tg", "txt"))
ORACLE["tagged_texts"] = TAGGED + "select doc, page, text_idx, text, patterns, relevance from tg"
ORACLE["tagged_words"] = f"""
with words as (select unnest(regexp_split_to_array(text, '\\s+')) as text from documents),
plain as (select text, count(*) as n from words where text <> '' group by text),
{tagged('tg', 'plain')} select text, n, patterns, relevance from tg"""
ORACLE["relevance_order"] = TAGGED + """
select doc, page, text_idx, row_number() over (partition by doc order by relevance desc, page, text_idx) as position from tg"""
ORACLE["pattern_counts"] = TAGGED + """
select doc, pattern, count(*) as n from (select doc, unnest(string_split(patterns, ',')) as pattern from tg) where pattern <> '' group by doc, pattern"""
ORACLE["extraction_statistics"] = FUSED.rstrip() + ",\n" + tagged("tg", "fus") + f"""
select doc, count(*) as total_texts, count(*) filter (source = 'pdf') as pdf_extracted, count(*) filter (source = 'ocr') as ocr_extracted,
  {r6('avg(confidence)')} as average_confidence, {r6('avg(relevance)')} as average_relevance_score,
  count(sym_idx) as texts_with_associated_symbols, {r6('count(sym_idx) / count(*)::double * 100')} as association_rate
from tg group by doc"""
ORACLE["extraction_summary"] = with_(BASE, OCR) + f"""
select count(*) as total_files, count(n) as processed_files, sum(n)::bigint as total_text_regions,
  {r6('sum(n) / count(n)::double')} as average_text_regions_per_file, {r6('count(n) * 100.0::double / count(*)')} as success_rate
from (select c_custkey as doc from customer) left join
  (select s_suppkey as doc, coalesce(c, 0) as n from supplier left join
    (select doc, count(*) as c from ocr where trim(otext) <> '' and doc % 5 > 0 group by doc) on doc = s_suppkey) using (doc)"""
ORACLE["extraction_statistics_of_all"] = with_(BASE, OCR) + """
select s_suppkey as doc, coalesce(c, 0) as total_texts, coalesce(l, 0) as texts_with_associated_symbols from supplier left join
  (select doc, count(*) as c, count(sym_idx) as l from ocr where trim(otext) <> '' and doc % 5 > 0 group by doc) on doc = s_suppkey"""


def clean_boxes(source: str) -> str:
    """Tag duplicates out, then class-wise suppression: `sym`."""
    return ",\n".join([
        f"tags as (select * from {source} where class_name = 'Tag-ID')",
        nms("tagkept", "tags", 0.7),
        f"""step1 as materialized (select d.* from {source} d where class_name <> 'Tag-ID' union all
  select d.* from {source} d semi join tagkept using (doc, page, det_idx) where class_name = 'Tag-ID')""",
        nms("kept", "step1", 0.5),
        "sym as materialized (select step1.* from step1 semi join kept using (doc, page, det_idx))",
    ])


def extraction(source: str) -> str:
    """The chain up to tagged texts with symbols: `ext`."""
    return with_(
        BASE, DET, TEXTS, OCR, f"src as (select * from {source})", clean_boxes("src"), near("hits", "txt", "sym"),
        fused("fus", "hits"), nearest("nn", "fus", "sym", "< 300"),
        "joined as (select fus.* replace (coalesce(sym_idx, best.i) as sym_idx) from fus left join nn using (doc, page, text_idx))",
        tagged("ext", "joined"),
    )


ORACLE["extracted_texts"] = extraction("det") + "select doc, page, text_idx, text, source, sym_idx, patterns, relevance from ext"

# ------------------------------------------------------------ calibration, relative boxes

OFF = with_(BASE, OCR, """off as materialized (select *, x1 - sym_x1 as ox, y1 - sym_y1 as oy from ocr where sym_idx is not null)""")
STATS = """select doc, count(*) as sample_count, avg(ox) as mean_x, stddev_pop(ox) as std_x, min(ox) as min_x, max(ox) as max_x,
  avg(oy) as mean_y, stddev_pop(oy) as std_y, min(oy) as min_y, max(oy) as max_y, median(ox) as median_x, median(oy) as median_y
  from off group by doc"""
NEEDED = "abs(mean_x) > 1000 or abs(mean_y) > 500 or std_x / (abs(mean_x) + 1e-6) > 0.5 or std_y / (abs(mean_y) + 1e-6) > 0.5"
ORACLE["offset_statistics"] = OFF + f"""
select doc, sample_count, {r6('mean_x')} as mean_x, {r6('std_x')} as std_x, min_x, max_x, {r6('mean_y')} as mean_y, {r6('std_y')} as std_y,
  min_y, max_y, {r6('median_x')} as median_x, {r6('median_y')} as median_y, {NEEDED} as correction_needed from ({STATS})"""
ORACLE["tile_offsets"] = OFF + f"""
select doc, page, "row", col, {r6('avg(ox)')} as avg_off_x, {r6('avg(oy)')} as avg_off_y, count(*) as n from off group by doc, page, "row", col"""
ORACLE["tile_offsets_in_document"] = OFF + f"""
select doc, "row", col, {r6('avg(ox)')} as avg_off_x, {r6('avg(oy)')} as avg_off_y, count(*) as n from off group by doc, "row", col"""


def calibrated(texts: str, columns: str) -> str:
    """Correction of `texts` by tile or document offset, given `off`."""
    def by(c, o):
        return r6(f"{c} - case kind when 'tile' then coalesce(t{o}, 0) when 'offset' then m{o} else 0 end")

    return f"""
select doc, page, text_idx, {columns} {by('x1', 'x')} as x1, {by('y1', 'y')} as y1, {by('x2', 'x')} as x2, {by('y2', 'y')} as y2,
  coalesce(kind, 'none') as correction
from {texts} left join (select doc, mean_x as mx, mean_y as my, case when not ({NEEDED}) then 'none'
    when doc in (select doc from off where "row" is not null) then 'tile' else 'offset' end as kind from ({STATS})) using (doc)
  left join (select doc, page, "row", col, avg(ox) as tx, avg(oy) as ty from off group by doc, page, "row", col) using (doc, page, "row", col)"""


ORACLE["calibrated_texts"] = OFF + calibrated("ocr", "")
ORACLE["calibrated_extraction"] = extraction("det where confidence >= 0.5").rstrip() + """,
wide as materialized (select e.*, s."row", s.col, s.x1 as gx, s.y1 as gy from ext e left join sym s on e.doc = s.doc and e.page = s.page and e.sym_idx = s.det_idx),
off as materialized (select *, x1 - gx as ox, y1 - gy as oy from wide where gx is not null)
""" + calibrated("wide", "sym_idx,")
REL = with_(BASE, OCR, """rel as materialized (select *, sym_idx is not null as k, sym_x2 - sym_x1 as sw, sym_y2 - sym_y1 as sh,
  case when k then x1 - sym_x1 else x1 end as a, case when k then y1 - sym_y1 else y1 end as b,
  case when k then x2 - sym_x1 else x2 end as c, case when k then y2 - sym_y1 else y2 end as d from ocr)""")


def _pct(v: str, s: str, n: str) -> str:
    return f"case when k then {r6(f'{v} / {s} * 100')} end as {n}_percent"


ORACLE["relative_texts"] = REL + f"""
select doc, page, text_idx, a as x1, b as y1, c as x2, d as y2, case when k then x1 end as abs_x1, case when k then y1 end as abs_y1,
  sw as symbol_width, sh as symbol_height, {_pct('a', 'sw', 'x1')}, {_pct('b', 'sh', 'y1')}, {_pct('c', 'sw', 'x2')}, {_pct('d', 'sh', 'y2')},
  case when k then 'relative_to_symbol' else 'absolute' end as coordinate_system from (select * from rel)"""
ORACLE["relative_texts"] = ORACLE["relative_texts"].replace("case when k then x1 end as abs_x1, case when k then y1 end as abs_y1", "case when k then rel.x1 end as abs_x1, case when k then rel.y1 end as abs_y1").replace("from (select * from rel)", "from rel")
ORACLE["relative_round_trip"] = REL + """
select doc, page, text_idx, rel.x1 as x1, rel.y1 as y1, rel.x2 as x2, rel.y2 as y2, case when k then a end as rel_x1, case when k then d end as rel_y2,
  'absolute' as coordinate_system from rel"""
ORACLE["relative_counts"] = REL + """
select doc, count(*) as total_regions, count(*) filter (k) as regions_with_relative_coords from rel group by doc"""
ORACLE["anchored_texts"] = REL + """
select doc, page, text_idx, rel.x1 + 100 as abs_x1, rel.y1 + 50 as abs_y1, rel.x2 + 100 as abs_x2, rel.y2 + 50 as abs_y2 from rel where k"""
LAYOUT = with_(BASE, OCR, """lay as (select *, sym_class_name || '_' || doc || '_p' || page || '_r' || "row" || '_c' || col || '.png' as symbol_id
  from ocr where sym_idx is not null)""")
ORACLE["layout_symbols"] = LAYOUT + """
select doc, symbol_id, count(*) as text_count, f.i as sym_idx, f.a as sym_x1, f.b as sym_y1, f.c as sym_x2, f.d as sym_y2
from (select doc, symbol_id, arg_min(struct_pack(i := sym_idx, a := sym_x1, b := sym_y1, c := sym_x2, d := sym_y2), text_idx) as f, count(*) as n
  from lay group by doc, symbol_id) group by all"""
ORACLE["layout_symbols"] = LAYOUT + """
select doc, symbol_id, n as text_count, f.i as sym_idx, f.a as sym_x1, f.b as sym_y1, f.c as sym_x2, f.d as sym_y2
from (select doc, symbol_id, count(*) as n,
  arg_min(struct_pack(i := sym_idx, a := sym_x1, b := sym_y1, c := sym_x2, d := sym_y2), text_idx) as f from lay group by doc, symbol_id)"""
ORACLE["layout_texts"] = LAYOUT + "select doc, page, text_idx, symbol_id, otext as text from lay"

# ------------------------------------------------------------ areas

REGIONS = with_(BASE, OCR, RANKED_REGIONS)
ORACLE["output_regions"] = REGIONS + """
select document, page, area_id, area_type, text_content, confidence, x, y, width, height, source, text_idx from reg"""
ORACLE["output_regions_signed"] = REGIONS + """
select document, page, text_idx, x2 as x, y1 as y, x1 - x2 as width, y2 - y1 as height from reg"""
ORACLE["area_groups"] = REGIONS + """
select document, page, area_id, area_type, count(*) as n, min(text_idx) as first_text from reg group by all"""
SEQ = "printf('%03d', row_number() over (partition by {keys} order by k, page, text_idx)) as sequence from keyed"
ORACLE["sequenced_regions"] = REGIONS + "select document, page, text_idx, area_id, " + SEQ.format(keys="document, page, area_id")
ORACLE["sequenced_regions_in_document"] = REGIONS + "select document, page, text_idx, area_id, " + SEQ.format(keys="document, area_id")
ORACLE["sequenced_without_areas"] = REGIONS + "select document, page, text_idx, " + SEQ.format(keys="document")


def tag_sql(keys: str, page: str) -> str:
    return REGIONS.rstrip() + f""",
tags as materialized (select {keys}{page}, string_agg(text_content, ' ' order by y, x, k, page, text_idx) as tag_text,
  min(x) as bbox_x1, min(y) as bbox_y1, max(x + width) as bbox_x2, max(y + height) as bbox_y2
  from keyed where starts_with(area_id, 'area_Tag-ID_') group by {keys})
"""


TAG_COLUMNS = """document, page, area_id, tag_text, bbox_x1, bbox_y1, bbox_x2, bbox_y2,
  bbox_x2 - bbox_x1 as bbox_width, bbox_y2 - bbox_y1 as bbox_height, 0.95::double as confidence"""
TAGS = tag_sql("document, page, area_id", "")
ORACLE["tag_rows"] = TAGS + f"select {TAG_COLUMNS} from tags"
FIRST_PAGE = ", first(page order by y, x, k, page, text_idx) as page"
ORACLE["tag_rows_in_document"] = tag_sql("document, area_id", FIRST_PAGE) + f"select {TAG_COLUMNS} from tags"
ORACLE["tag_list_csv"] = TAGS + """
select document, tag_text as "TAG_TEXT", printf('%.1f', bbox_x1) as "BBOX_X1", printf('%.1f', bbox_y1) as "BBOX_Y1",
  printf('%.1f', bbox_x2) as "BBOX_X2", printf('%.1f', bbox_y2) as "BBOX_Y2", printf('%.1f', bbox_x2 - bbox_x1) as "BBOX_WIDTH",
  printf('%.1f', bbox_y2 - bbox_y1) as "BBOX_HEIGHT", '0.950' as "CONFIDENCE", page as "PAGE" from tags"""
ORACLE["region_summary"] = REGIONS + """
select 'documents' as dimension, document::varchar as value, count(*) as n from reg group by 2
union all select 'areas', area_id, count(*) from reg group by 2
union all select 'area_types', area_type, count(*) from reg group by 2
union all select 'sources', source, count(*) from reg group by 2
union all select 'total', null, count(*) from reg"""


def components(radius: int) -> str:
    """Connected components of texts by smallest reachable ordinal: `comp`."""
    return f"""edges as materialized (select a.doc, a.page, a.text_idx as a, b.text_idx as b from txt a join txt b
  on a.doc = b.doc and a.page = b.page and a.text_idx <> b.text_idx where {distance('a', 'b')} <= {radius}),
walk as (select doc, page, text_idx as a, text_idx as b from txt union
  select w.doc, w.page, w.a, e.b from walk w join edges e on w.doc = e.doc and w.page = e.page and w.b = e.a),
comp as materialized (select doc, page, a as text_idx, min(b) as cluster_id from walk group by doc, page, a)"""


def recursive(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


ORACLE["text_clusters"] = recursive(BASE, TEXTS, components(60)) + "select * from comp"
ORACLE["cluster_areas"] = recursive(BASE, DET, TEXTS, components(60), nearest("nn", "txt", "det", "<= 90")) + """,
mem as materialized (select txt.*, cluster_id, best.i as sym_idx, det.class_name as sym_class from txt join comp using (doc, page, text_idx)
  left join nn using (doc, page, text_idx) left join det on det.doc = txt.doc and det.page = txt.page and det.det_idx = best.i),
main as (select doc, page, cluster_id, arg_max(sym_class, struct_pack(n := n, f := -f)) as c from (
  select doc, page, cluster_id, sym_class, count(*) as n, min(text_idx) as f from mem where sym_class is not null group by all) group by all),
ar as (select doc, page, cluster_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2,
  count(*) filter (trim(text) <> '') as text_count, count(distinct sym_idx) as symbol_count from mem group by all)
select doc, page, cluster_id, printf('area_%s_%03d_%03d', area_type, floor(x1 / 100)::bigint, floor(y1 / 100)::bigint) as area_id, area_type,
  x1, y1, x2, y2, text_count, symbol_count
from (select ar.*, case when c is null then 'text' when c = 'resistor' then 'component' when c = 'connector' then 'connection' else 'symbol' end as area_type
  from ar left join main using (doc, page, cluster_id))""".lstrip("\n")
ORACLE["grid_areas"] = with_(BASE, TEXTS) + """
select doc, page, printf('grid_%03d_%03d', gx, gy) as area_id, 'grid' as area_type, gx as grid_x, gy as grid_y, gx * 100.0::double as x1,
  gy * 100.0::double as y1, (gx + 1) * 100.0::double as x2, (gy + 1) * 100.0::double as y2, count(*) as text_count
from (select *, floor(x1 / 100)::bigint as gx, floor(y1 / 100)::bigint as gy from txt) group by doc, page, gx, gy"""
ORACLE["grid_members"] = with_(BASE, TEXTS) + """
select doc, page, text_idx, floor(x1 / 100)::bigint as grid_x, floor(y1 / 100)::bigint as grid_y from txt"""

# ------------------------------------------------------------ overlays

SIZED = with_(BASE, DET, """sized as materialized (select *, page_w as iw, page_h as ih, page_w / 2.0::double as ow, page_h / 2.0::double as oh,
  (page % 4) * 90 as rot from det)""")


def _boxes(x1: str, y1: str, x2: str, y2: str, source: str = "sized") -> str:
    return f"select doc, page, det_idx, {r6(x1)} as x1, {r6(y1)} as y1, {r6(x2)} as x2, {r6(y2)} as y2 from {source}"


def _rot(a: str, b: str, c: str, d: str) -> str:
    return f"case rot when 90 then {a} when 180 then {b} when 270 then {c} else {d} end"


ORACLE["projected_scaled"] = SIZED + _boxes("x1 * (ow / iw)", "y1 * (oh / ih)", "x2 * (ow / iw)", "y2 * (oh / ih)")
ORACLE["projected_rotated"] = SIZED + _boxes(
    _rot("least(y1, y2)", "ow - x2", "ow - y2", "x1"), _rot("least(oh - x2, oh - x1)", "oh - y2", "x1", "y1"),
    _rot("greatest(y1, y2)", "ow - x1", "ow - y1", "x2"), _rot("greatest(oh - x2, oh - x1)", "oh - y1", "x2", "y2"),
)
ORACLE["projected_rotated_scaled"] = SIZED + _boxes(
    "case rot when 90 then y1 * (ow / ih) else x1 * (ow / iw) end", "case rot when 90 then (iw - x2) * (oh / iw) else y1 * (oh / ih) end",
    "case rot when 90 then y2 * (ow / ih) else x2 * (ow / iw) end", "case rot when 90 then (iw - x1) * (oh / iw) else y2 * (oh / ih) end",
)
ORACLE["projected_counterclockwise"] = SIZED + _boxes("y1 * (oh / ih)", "ow - x2 * (ow / iw)", "y2 * (oh / ih)", "ow - x1 * (ow / iw)")
CELL = """cells as (select *, (col - 1) * 1400.0::double + tx1 as a, "row" * 700.0::double + ty1 as b, (col - 1) * 1400.0::double + tx2 as c,
  "row" * 700.0::double + ty2 as d from sized where col - 1 between 0 and 1 and "row" between 0 and 2)"""
ORACLE["projected_grid"] = SIZED.rstrip() + ",\n" + CELL + f""",
placed as (select *, a * (ow / 2800) as px1, b * (oh / 2100) as py1, c * (ow / 2800) as px2, d * (oh / 2100) as py2 from cells)
select doc, page, det_idx, {r6('px1')} as x1, {r6('py1')} as y1, {r6('px2')} as x2, {r6('py2')} as y2 from placed
where px1 >= 0 and py1 >= 0 and px2 <= ow and py2 <= oh and px1 < px2 and py1 < py2"""
ORACLE["projected_grid_turned"] = SIZED.rstrip() + ",\n" + CELL + "\n" + _boxes(
    "case rot when 90 then b * (ow / 2100) else a * (ow / 2800) end", "case rot when 90 then (2800 - c) * (oh / 2800) else b * (oh / 2100) end",
    "case rot when 90 then d * (ow / 2100) else c * (ow / 2800) end", "case rot when 90 then (2800 - a) * (oh / 2800) else d * (oh / 2100) end", "cells",
)
BAND = "case when confidence >= 0.95 then 'high' when confidence >= 0.85 then 'medium' else 'normal' end as band"
ORACLE["detection_labels"] = CORE + f"""
select doc, page, det_idx as idx, printf('%s %.0f%%', class_name, confidence * 100) as label, {BAND}, x1 as label_x, greatest(0, y1 - 20) as label_y
from det where confidence >= 0.3"""
ORACLE["detection_labels_decimal"] = CORE + f"""
select doc, page, det_idx as idx, printf('%s (%.2f)', class_name, confidence) as label, {BAND} from det where confidence >= 0.3"""
ORACLE["markers"] = SIZED + f"""
select doc, page, 'marker' as kind, det_idx as idx, greatest(0, x1 - 5) as x1, greatest(0, y1 - 5) as y1, least(ow, x2 + 5) as x2, least(oh, y2 + 5) as y2,
  class_name as label, {BAND} from sized where confidence >= 0.5"""
ORACLE["text_boxes"] = with_(BASE, OCR) + f"""
select doc, page, 'text' as kind, text_idx as idx, x1, y1, x2, y2, left(trim(otext), 5) as label, {BAND} from ocr where confidence >= 0.75"""
LINKED_SIZED = with_(BASE, OCR, """ls as materialized (select *, (2700 + (doc % 5) * 25) / 2.0::double as ow, (2150 + page * 10) / 2.0::double as oh,
  length(otext) * 7.0::double * 0.6::double as tw from ocr)""")
ORACLE["symbol_texts"] = LINKED_SIZED + f"""
select doc, page, 'symbol_text' as kind, text_idx as idx, {r6('a')} as x1, {r6('b')} as y1, {r6('a + tw')} as x2, {r6('b + 12')} as y2, otext as label, {BAND}
from (select *, case when sym_x1 + tw > ow then ow - tw - 10 else sym_x1 end as a, case when sym_y2 + 17 > oh then sym_y1 - 17 else sym_y2 + 5 end as b
  from ls where confidence >= 0.75 and sym_idx is not null)"""
ORACLE["layout_labels"] = with_(BASE, OCR) + """
select doc, page, case when sym_idx is not null then 'layout_text' else 'fallback_text' end as kind, text_idx as idx,
  case when sym_idx is not null then printf('%s (%.2f)', otext, confidence) else otext || ' [fallback]' end as label from ocr where otext <> ''"""
ORACLE["scaled_unlinked_texts"] = LINKED_SIZED + """
select doc, page, text_idx, x1 * 3 as x1, y1 * 3 as y1, x2 * 3 as x2, y2 * 3 as y2 from ls
where sym_idx is null and x1 >= 0 and y1 >= 0 and x2 * 3 <= ow and y2 * 3 <= oh"""
ORACLE["text_connectors"] = with_(BASE, OCR) + """
select doc, page, text_idx as idx, (x1 + ocr.x2) / 2 as x1, (y1 + ocr.y2) / 2 as y1, (sym_x1 + sym_x2) / 2 as x2, (sym_y1 + sym_y2) / 2 as y2
from ocr where sym_idx is not null"""
ORACLE["page_legend"] = with_(BASE, DET, TEXTS, OCR, fused("fus", "txt")) + """
select doc, page, coalesce(a, 0) as detections_shown, coalesce(b, 0) as detections_total, coalesce(c, 0) as texts_shown, coalesce(d, 0) as texts_total,
  coalesce(e, 0) as pdf_texts, coalesce(f, 0) as ocr_texts
from (select doc, page, count(*) filter (confidence >= 0.8) as a, count(*) as b from det group by doc, page)
full join (select doc, page, count(*) filter (confidence >= 0.75) as c, count(*) as d, count(*) filter (source = 'pdf') as e,
  count(*) filter (source = 'ocr') as f from fus group by doc, page) using (doc, page)"""
ORACLE["overlay_counts"] = with_(BASE, DET, OCR, """proj as materialized (select *, page_w / 2.0::double as ow, page_h / 2.0::double as oh,
  x1 / 2 as px1, y1 / 2 as py1, x2 / 2 as px2, y2 / 2 as py2 from det)""",
  """lk as materialized (select o.*, p.ow, p.oh, p.px1, p.py1, p.px2, p.py2, length(otext) * 7.0::double * 0.6::double as tw from ocr o
  join proj p on o.doc = p.doc and o.page = p.page and o.sym_idx = p.det_idx where o.confidence >= 0.5)""",
  """prim as (select doc, page, 'detection' as kind, px1 as x1, py2 as y2 from proj where confidence >= 0.25
  union all select doc, page, 'marker', greatest(0, px1 - 5), least(oh, py2 + 5) from proj where confidence >= 0.25
  union all select doc, page, 'text', x1, y2 from ocr where confidence >= 0.5
  union all select doc, page, 'symbol_text', case when px1 + tw > ow then ow - tw - 10 else px1 end,
    case when py2 + 17 > oh then py1 - 17 else py2 + 5 end + 12 from lk
  union all select doc, page, 'connector', (x1 + x2) / 2, (py1 + py2) / 2 from lk)""") + f"""
select doc, page, kind, count(*) as n, {r6('sum(x1)')} as x1, {r6('sum(y2)')} as y2 from prim group by doc, page, kind"""

# ------------------------------------------------------------ statistics, logs, catalogues

DSTATS = f"""select doc, count(distinct p.page) as total_pages, count(det_idx) as total_detections, coalesce(min(confidence), 0) as min_confidence,
  coalesce(max(confidence), 0) as max_confidence, coalesce({r6('avg(confidence)')}, 0) as avg_confidence
from pages5 p left join det d using (doc, page) group by doc"""
ORACLE["detection_statistics"] = with_(BASE, DET, PAGES) + DSTATS
ORACLE["page_counts"] = with_(BASE, DET, PAGES) + "select doc, page, count(det_idx) as detections from pages5 left join det using (doc, page) group by doc, page"
ORACLE["class_counts"] = CORE + "select doc, class_name, count(*) as n from det group by doc, class_name"
ORACLE["globalised_statistics"] = with_(BASE, DET, PAGES) + f"""
select * from ({DSTATS}) left join (select doc, count(*) filter (x1 < 0 or y1 < 0 or x2 > page_w or y2 > page_h) as outside,
  not bool_or(x1 < 0 or y1 < 0 or x2 > page_w or y2 > page_h) as valid from det group by doc) using (doc)"""
TR = """with tr as (select 'tile_' || user_id || '.png' as tile, case when event_type = 'error' then props end as error,
  case when event_type = 'error' then 0 else floor(value)::bigint end as detection_count, event_id as batch_id from events)
"""
ORACLE["tile_result_summary"] = TR + f"""
select count(*) as total_images, count(*) filter (error is null) as successful, count(error) as failed, sum(detection_count)::bigint as total_detections,
  {r6('sum(detection_count) / (count(*) filter (error is null))::double')} as average_detections from tr"""
ORACLE["latest_tile_results"] = TR + "select * from tr qualify row_number() over (partition by tile order by batch_id desc) = 1"
ORACLE["run_log_summary"] = f"""
select user_id as run, count(*) filter (event_id % 7 <> 0) as stages_run, count(*) filter (event_id % 7 = 0) as stages_skipped,
  {r6('(max(epoch_us(ts)) - min(epoch_us(ts) - round(value * 1e6)::bigint)) / 1e6::double')} as total_duration,
  bool_and(event_type <> 'error') as success, count(*) filter (event_type <> 'error') as completed_stages, count(*) as total_stages,
  {r6("count(*) filter (event_type <> 'error') / count(*)::double")} as overall_progress from events group by user_id"""
RUNS = """with runs as (select event_type as pipeline, (8 * pow(2, user_id % 4))::int as batch_size, count(*) as items,
  sum(round(value * 100)::bigint)::bigint / 100.0::double as seconds, case when seconds > 0 then items / seconds else 0 end as speed
  from events where event_type <> 'error' group by 1, 2)
"""
ORACLE["benchmark_comparison"] = RUNS + f"""
select r.batch_size, r.pipeline, r.items, r.seconds, {r6('r.speed')} as speed, {r6('b.speed')} as baseline_speed, {r6('r.speed / b.speed')} as speedup,
  {r6('(r.speed / b.speed - 1) * 100')} as improvement_percent from runs r join runs b on r.batch_size = b.batch_size and b.pipeline = 'view' and b.speed > 0"""
ORACLE["benchmark_best"] = RUNS + f"""
select pipeline, batch_size, items, seconds, {r6('speed')} as speed from runs order by runs.speed desc, pipeline, batch_size limit 1"""
ORACLE["timing_breakdown"] = f"""
select event_type as component, {r6('avg(value) * 1000')} as avg_ms,
  case when event_type = 'purchase' then 100 else {r6("sum(value) / (select sum(value) from events where event_type = 'purchase') * 100")} end::double as percent
from events group by event_type"""
FILES = """with files as (select *, '/in/' || name as path from (select c_name || case c_custkey % 4 when 0 then '_detections.json'
  when 1 then '_detections_converted.json' when 2 then '_converted.json' else '__detections.json' end as name, c_name as doc, c_acctbal, c_mktsegment from customer))
"""
ORACLE["document_names"] = FILES + "select path, name, doc from files"
ORACLE["paired_documents"] = FILES + "select doc, c_acctbal > 0 as has_source, c_mktsegment <> 'FURNITURE' as has_texts from files"
ORACLE["documents_with_source"] = FILES + "select doc from files where c_acctbal > 0"
ORACLE["documents_without_texts"] = FILES + "select doc from files where c_mktsegment = 'FURNITURE'"
ORACLE["pairing_report"] = FILES + f"""
select count(*) as documents, count(*) filter (c_acctbal > 0) as with_source, count(*) filter (c_mktsegment <> 'FURNITURE') as with_texts,
  {r6('count(*) filter (c_acctbal > 0) * 100.0::double / count(*)')} as success_rate from files"""
SETS = """with sets as (select *, '/sets/' || k || '/' || name as path from (select o_orderkey as k, o_custkey as owner, o_orderdate as modified, o_totalprice,
  case when o_orderkey % 10 = 0 then '20231399' else strftime(o_orderdate, '%Y%m%d') end as day,
  'set_' || o_custkey || '_' || day || lpad((o_orderkey % 100)::varchar, 2, '0') || case when o_orderkey % 4 = 0 then '.tar' else '.zip' end as name from orders)),
cat as (select *, regexp_extract(name, '(\\d{10})', 1) as date_version,
  case when substr(date_version, 1, 8) = '20231399' then '20231399' else substr(date_version, 1, 4) || '-' || substr(date_version, 5, 2) || '-' || substr(date_version, 7, 2) end as date,
  substr(date_version, 9, 2) as version from sets where name like '%.zip')
"""
ORACLE["dataset_catalog"] = SETS + f"""
select name, path, date, version, date_version, {r6('floor(o_totalprice)::bigint / (1024 * 1024)::double')} as size_mb from cat"""
ORACLE["latest_dataset"] = SETS + "select date_version, name, date, version from cat order by date_version desc, name desc limit 1"
ORACLE["retained_datasets"] = SETS + """
select owner, path, case when row_number() over (partition by owner order by modified desc, name desc) <= 3 then 'keep' else 'expire' end as action from sets"""
ORACLE["retained_overall"] = SETS + """
select path, r as age_rank, case when r <= 1000 then 'keep' else 'expire' end as action
from (select path, row_number() over (order by modified desc, path desc) as r from sets)"""
ORACLE["dataset_splits"] = """
with f as (select 'set' || l_suppkey as dataset, case when l_linenumber <= 4 then 'train' when l_linenumber <= 6 then 'valid' else 'test' end as s,
  case when l_orderkey % 3 = 0 then 'labels' else 'images' end as k from lineitem),
c as (select dataset, """ + ", ".join(
    f"count(*) filter (s = '{s}' and k = '{k}') as {s}_{k}" for s in ("train", "valid", "test") for k in ("images", "labels")
) + """ from f group by dataset)
select *, train_images > 0 and train_labels > 0 and valid_images > 0 and valid_labels > 0 as valid_structure from c"""

# ------------------------------------------------------------ documents

POS = "(row_number() over (partition by doc, page order by det_idx) - 1)"
ORACLE["detection_documents"] = CORE + """
select doc, page, page_w, page_h, det_idx, class_id, class_name, confidence, x1, y1, x2, y2, tx1, ty1, tile, "row", col
from (select * replace (POS as det_idx) from det)""".replace("POS", POS)
ORACLE["converted_documents"] = CORE + f"""
select doc, page, {POS} as det_idx, class_name, confidence, x1, y1, x2, y2, tile from det"""
ORACLE["document_pages"] = with_(PAGES) + "select doc, page, page_w, page_h from pages5"
ORACLE["structure_check"] = CORE + """
select s_suppkey::varchar as path, s_suppkey % 2 = 1 or first is null as compatible,
  case when s_suppkey % 2 = 0 and first is not null then 'no global_bbox, needs conversion' end as reason
from supplier left join (select doc, true as first from det where page = 1 group by doc) on doc = s_suppkey"""
ORACLE["tile_manifests"] = TILES + "select * replace (doc::varchar as doc) from tiles"
ORACLE["tile_result_documents"] = CORE + """
select tile, count(*) filter (confidence < 0.25) as errors, case when count(*) filter (confidence >= 0.25) > 0 then count(*) filter (confidence >= 0.25) end as detections,
  case when count(*) filter (confidence >= 0.25) > 0 then count(*) filter (confidence >= 0.25) end as boxes, sum(tx1) filter (confidence >= 0.25) as bx1
from det group by tile"""
ORACLE["text_documents"] = with_(BASE, DET, OCR, "src as (select * exclude (otext), otext as text from ocr)", tagged("tg", "src")) + """
select doc, page, row_number() over (partition by doc order by relevance desc, page, text_idx) - 1 as text_idx, text, confidence,
  x1, y1, x2, y2, patterns, relevance, sym_idx, sym_class_name, sym_x1,
  case when sym_idx is not null then doc || '_p' || page || '_r' || "row" || '_c' || col || '.png' end as sym_tile, "row", col from tg"""
ORACLE["coordinate_report"] = with_(BASE, DET, PAGES) + """,
cnt as (select doc, page, p.page_w, p.page_h, count(det_idx) as n from pages5 p left join det using (doc, page) group by all)
select doc, page, o as ord, printf(E'Detection %d:\\n  Class: %s (confidence: %.3f)\\n  Global coordinates: (%.1f, %.1f) -> (%.1f, %.1f)\\n'
  || E'  Snippet coordinates: (%.1f, %.1f) -> (%.1f, %.1f)\\n  Source snippet: %s (row %d, col %d)\\n', o, class_name, confidence,
  x1, y1, x2, y2, tx1, ty1, tx2, ty2, tile, "row", col) as line
from (select *, row_number() over (partition by doc, page order by det_idx) as o from det)
union all select doc, page, 0, printf(E'Page %d (%dx%d)\\n', page, page_w, page_h) || repeat('-', 30)
  || case when n = 0 then E'\\nNo detections found\\n' else '' end from cnt
union all select doc, page, 9223372036854775807, printf(E'Page %d total: %d detections\\n', page, n) from cnt where n > 0
union all select distinct doc, -1, 0, E'PLC Detection Coordinate Mapping\\nPDF: ' || doc || E'.pdf\\n' || repeat('=', 50) || E'\\n' from cnt
union all select doc, 2147483647, 9223372036854775807, printf('Total detections across all pages: %d', sum(n)::bigint) from cnt group by doc""".lstrip("\n")
ORACLE["detection_numbers"] = CORE + "select doc, page, det_idx, row_number() over (partition by doc, page order by det_idx) as number from det"
ORACLE["streamed_detections"] = CORE + """
select doc::varchar as doc, page, count(*) as detections, sum(x1) as x1, count(*) - 1 as "last" from det group by doc, page"""

ORACLE["streamed_reload"] = CORE + """
select doc::varchar as doc, page, count(*) as detections, sum(x1) as x1 from det where doc % 2 = 1 or page <= 2 group by doc, page"""
ORACLE["streamed_skip"] = CORE + "select doc::varchar as doc, page, count(*) as detections, sum(x1) as x1 from det group by doc, page"
ORACLE["streamed_tile_results"] = CORE + "select tile, 2 * count(*) as detection_count from det group by tile"

# ------------------------------------------------------------ callers' own parts, tables

ORACLE["own_patterns"] = with_(BASE, TEXTS) + r"""
select doc, page, text_idx, concat_ws(',', case when regexp_matches(trim(text), '(?i)Motor_\d') then 'motor' end,
  case when regexp_matches(trim(text), '[02468]$') then 'even' end) as patterns from txt where trim(text) <> ''"""
ORACLE["own_area_types"] = with_(BASE, OCR) + """
select doc as document, page, text_idx, case when sym_class_name is null then 'text' when sym_class_name = 'Tag-ID' then 'tag'
  when sym_class_name = 'resistor' then 'part' else 'symbol' end as area_type from ocr where trim(otext) <> ''"""
ORACLE["area_tables"] = with_(BASE, TEXTS) + """
select doc, page, count(*) as members, count(distinct (floor(x1 / 100), floor(y1 / 100))) as cells, count(*) as texts from txt group by all"""
ORACLE["scored_with_failures"] = TILES + "select tile, 0::int as detection_count, 'ValueError: no model' as error from tiles"
ORACLE["recognised_in_one_call"] = READ + """,
placed as (select rd.*, row_number() over (partition by doc, page order by det_idx, rec_idx) - 1 as text_idx from rd)
select text_idx, det_idx as sym_idx, page, doc, text, """ + _moved("0", "0").split("text,")[1].replace(" from rd", " from placed")
ORACLE["table_round_trip"] = CORE + "select doc, page, det_idx, class_name, x1, y1, x2, y2 from det"
