"""Random boxes and plain Python versions of the geometry, for checks by brute force."""

import random


def iou(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def center(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def distance(a, b):
    (ax, ay), (bx, by) = center(a), center(b)
    return ((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) ** 0.5


def greedy(rows, threshold, inclusive=False):
    """rows: (idx, confidence, box); returns kept indices."""
    kept = []
    for idx, conf, box in sorted(rows, key=lambda r: (-r[1], r[0])):
        hits = (iou(k, box) for _, k in kept)
        if not any(v >= threshold if inclusive else v > threshold for v in hits):
            kept.append((idx, box))
    return {i for i, _ in kept}


def random_boxes(n, seed, page=600, sizes=(10, 90), grid=1.0, copies=0.2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < copies:
            box = rnd.choice(out)[2]
        else:
            x, y = rnd.randrange(page) * grid, rnd.randrange(page) * grid
            box = (x, y, x + rnd.randint(*sizes) * grid, y + rnd.randint(*sizes) * grid)
        out.append((i, rnd.randrange(1, 20) / 20, box))
    return out


DET_SCHEMA = (
    "doc string, page int, det_idx bigint, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
)
TEXT_SCHEMA = (
    "doc string, page int, text_idx bigint, text string, confidence double, "
    "x1 double, y1 double, x2 double, y2 double, source string"
)


def detections(spark, rows, doc="d", page=1, cls="A"):
    return spark.createDataFrame([(doc, page, i, cls, c, *map(float, b)) for i, c, b in rows], DET_SCHEMA)


def texts(spark, rows, doc="d", page=1, source="pdf"):
    return spark.createDataFrame(
        [(doc, page, i, t, 1.0, *map(float, b), source) for i, t, b in rows], TEXT_SCHEMA
    )


def moved(spark, make):
    """Bytes that running `make` and reading its rows shuffles and writes."""

    def total():
        no_quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, no_quantiles, spark._jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    make().write.format("noop").mode("overwrite").save()
    return sum(v for k, v in total().items() if k not in before)
