import random

import numpy as np

from brieflake.operators import layout as L


def plain(boxes):
    """Recursive cuts at the widest gap, every place between boxes tried; boxes are (y0, x0, x1, y1, place)."""
    best = None
    for low, high, first in ((0, 3, 1), (1, 2, 0)):
        for b in boxes:
            at = b[high]
            if any(o[low] <= at < o[high] for o in boxes) or not any(o[low] > at for o in boxes):
                continue
            width = min(o[low] for o in boxes if o[low] > at) - at
            if width > 0 and (best is None or (width, first, -at) > best[0]):
                best = ((width, first, -at), high, at)
    if best is None:
        return [b[4] for b in sorted(boxes, key=lambda b: (b[0], b[1], b[4]))]
    _, high, at = best
    return plain([b for b in boxes if b[high] <= at]) + plain([b for b in boxes if b[high] > at])


def test_cuts_against_plain_recursion():
    rng = random.Random(5)
    for size in [1, 2, 3, 5, 9, 14] * 60:
        span = rng.choice([6, 12, 30])
        boxes = []
        for i in range(size):
            y, x = rng.randrange(span), rng.randrange(span)
            boxes.append((y, x, x + rng.randrange(1, 6), y + rng.randrange(1, 4), i))
        sides = [np.array(c, dtype=float) for c in list(zip(*boxes))[:4]]
        assert L.cut_order(*sides) == plain(boxes), boxes


def test_pages_read_by_columns_and_odd_boxes(spark):
    rows = [("p", 0.0, 0.0, 300.0, 10.0, "head")]
    rows += [("p", 160.0 * (i // 3), 20.0 + 12 * (i % 3), 160.0 * (i // 3) + 140, 30.0 + 12 * (i % 3), f"c{i}") for i in range(6)]
    rows += [("p", None, 1.0, 2.0, 3.0, "lost"), ("p", float("nan"), 1.0, 2.0, 3.0, "nan"), ("p", 5.0, 1.0, 2.0, 3.0, "inverted"), ("p", 0.0, 0.0, 1.0, 1.0, None)]
    rows += [("same", 1.0, 1.0, 2.0, 2.0, t) for t in ("b", "a", "a")] + [("none", 0.0, 0.0, 1.0, 1.0, None), ("loose", None, None, None, None, "x"), (None, 0.0, 0.0, 1.0, 1.0, "nokey")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "page string, x0 double, y0 double, x1 double, y1 double, text string").repartition(4)
    got = {r.page: (r.boxes, r.text) for r in L.pages_in_order(df, ["page"]).collect()}
    assert got == {"p": (10, "head c0 c1 c2 c3 c4 c5 inverted lost nan"), "same": (3, "a a b"), "loose": (1, "x"), None: (1, "nokey")}
    assert L.pages_in_order(df.limit(0), ["page"]).count() == 0
