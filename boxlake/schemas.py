"""Column layout of the flat tables, as DDL strings.

Ordinals (`det_idx`, `text_idx`) keep the order of the source lists. They only
have to be unique and ordered within a page, not dense.
"""

DETECTIONS = (
    "doc string, page int, page_w int, page_h int, det_idx bigint, class_id int, "
    "class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, "
    "tx1 double, ty1 double, tx2 double, ty2 double, tile string, row int, col int"
)

# Texts recognised from images follow all texts of the PDF layer. Their ordinals
# are shifted by this much when both lists become one.
OCR_ORDINAL_SHIFT = 1 << 62

PAGE_KEYS = ("doc", "page")
