import random

from quire.operators.geometry import overlaps


def test_overlaps_of_crowded_pages(spark):
    """All pairs of a page of over 200 boxes, against brute force."""
    rng = random.Random(2)
    boxes = [(1, k, (x, y, x + rng.uniform(1, 40), y + rng.uniform(1, 40))) for k in range(320) for x, y in [(rng.uniform(-30, 30), rng.uniform(0, 30))]]
    boxes += [(1, 400 + k, (0.0, 0.0, w, 5.0)) for k, w in enumerate((3.0, 5.0, 6.0, 10.0))] + [(2, 500, (0.0, 0.0, 3.0, 5.0))]

    def iou(a, b):
        w, h = max(min(a[2], b[2]) - max(a[0], b[0]), 0), max(min(a[3], b[3]) - max(a[1], b[1]), 0)
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    some = [b for b in boxes if (b[2][2] - b[2][0]) * (b[2][3] - b[2][1]) >= 1]
    want = sorted((p, a, b) for p, a, x in some for q, b, y in some if p == q and a < b and iou(x, y) >= 0.6)
    frame = spark.createDataFrame(boxes, "page long, block_id long, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    assert sorted((r.page, r.a, r.b) for r in overlaps(frame).collect()) == want and any(b >= 200 for _, _, b in want)
