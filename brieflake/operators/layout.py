"""Reading order of text boxes: recursive cuts at the widest gaps of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ("y0", "x0", "x1", "y1")


def widest_gap(low: np.ndarray, high: np.ndarray) -> tuple[float, float]:
    """(width, place) of the widest stretch that no interval covers, the lowest of equal ones; width 0 if there is none."""
    order = np.argsort(low, kind="stable")
    reach = np.maximum.accumulate(high[order])[:-1]
    gaps = low[order][1:] - reach
    if not len(gaps) or gaps.max() <= 0:
        return 0.0, 0.0
    at = int(np.argmax(gaps))
    return float(gaps[at]), float(reach[at])


def cut_order(y0: np.ndarray, x0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[int]:
    """Places of the boxes in reading order. A block is cut in two at its widest gap, between lines where a gap between
    columns is only as wide; blocks without a gap are read by (y0, x0, place).

    Boxes that all cross one vertical line (a column) or one horizontal line (a row) can only be cut the other way, so
    they are sorted at once: the same order as cutting them one by one.
    """
    done: list[int] = []
    blocks = [np.arange(len(y0))]
    while blocks:
        b = blocks.pop()
        column, row = x0[b].max() < x1[b].min(), y0[b].max() < y1[b].min()
        if len(b) == 1 or (column and not _crossing(y0[b], y1[b])):
            done.extend(b[np.lexsort((b, x0[b], y0[b]))].tolist())
            continue
        if row and not _crossing(x0[b], x1[b]):
            done.extend(b[np.lexsort((b, y0[b], x0[b]))].tolist())
            continue
        (down, y), (across, x) = widest_gap(y0[b], y1[b]), widest_gap(x0[b], x1[b])
        if not max(down, across) > 0:
            done.extend(b[np.lexsort((b, x0[b], y0[b]))].tolist())
        else:
            first = y1[b] <= y if down >= across else x1[b] <= x
            blocks += [b[~first], b[first]]
    return done


def _crossing(low: np.ndarray, high: np.ndarray) -> bool:
    """Whether two of the intervals meet."""
    order = np.argsort(low, kind="stable")
    return bool((low[order][1:] <= np.maximum.accumulate(high[order])[:-1]).any())


def pages_in_order(boxes: DataFrame, keys: list[str], joiner: str = " ") -> DataFrame:
    """boxes (keys, x0, y0, x1, y1, text) -> one row a page: keys, boxes (how many), text in reading order.

    A page's boxes meet in one row: a page is what is bounded here. Boxes without a place (a null, non-finite or inverted
    side) follow the others, by text; boxes without text count nothing. Boxes with equal places are read by text. Only
    numbers go through Python; texts are put together by Spark.
    """
    sides = [F.col(c).cast("double").alias(c) for c in BOX]
    whole = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in BOX)
    given = boxes.filter("text is not null").select(*keys, *sides, "text").withColumn("placed", F.expr(f"{whole} and x0 <= x1 and y0 <= y1"))
    pages = given.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("placed"), F.struct(*BOX, "text")))).alias("placed"),
        F.array_sort(F.collect_list(F.when(~F.col("placed"), F.col("text")))).alias("loose"),
    )

    @F.pandas_udf("array<int>")
    def order(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sides in frames:
            yield pd.Series([cut_order(*(np.asarray(side, dtype=float) for side in page)) if len(page[0]) else [] for page in zip(*sides)])

    pages = pages.withColumn("order", order(*[F.col(f"placed.{c}") for c in BOX]))
    read = F.concat(F.transform("order", lambda i: F.get(F.col("placed"), i)["text"]), F.col("loose"))
    return pages.select(*keys, F.size(read).alias("boxes"), F.array_join(read, joiner).alias("text"))
