"""Reading order of boxes on a page, and text with places joined from parts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _widest(spans: list[tuple[float, float]]) -> tuple[float, float]:
    """(width, middle) of the widest gap between intervals; the last of equal ones; width 0 if there is none."""
    best, reach = (0.0, 0.0), None
    for a, b in sorted(spans):
        if reach is not None and a > reach and a - reach >= best[0]:
            best = (a - reach, (a + reach) / 2)
        reach = b if reach is None else max(reach, b)
    return best


def reading_order(boxes: list[tuple], column_gap: float = 0.015, row_gap: float = 0.015, deepest: int = 32, right_to_left: bool = False) -> list[int]:
    """Indices of (index, left, top, right, bottom) in reading order.

    A region is cut at its widest gap between columns if that is wide enough against the page, else at its widest gap
    between rows, and its halves are read one after the other; where neither cuts, boxes go by top, side and index. The
    page is what all boxes take up. Repeated indices, and boxes that are not finite or inside out, are refused.
    """
    if len({b[0] for b in boxes}) != len(boxes):
        raise ValueError("an index is repeated")
    if any(not all(map(math.isfinite, b[1:])) or b[3] < b[1] or b[4] < b[2] for b in boxes):
        raise ValueError("a box is broken")
    width = max((b[3] for b in boxes), default=0) - min((b[1] for b in boxes), default=0)
    height = max((b[4] for b in boxes), default=0) - min((b[2] for b in boxes), default=0)
    side = (lambda b: -b[3]) if right_to_left else (lambda b: b[1])
    out: list[int] = []
    todo = [(boxes, 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) > 1 and depth < deepest:
            gap, at = _widest([(b[1], b[3]) for b in part])
            if gap > 0 and gap >= column_gap * width:
                halves = [[b for b in part if b[3] < at], [b for b in part if b[1] > at]]
                if right_to_left:
                    halves.reverse()
            else:
                gap, at = _widest([(b[2], b[4]) for b in part])
                halves = [[b for b in part if b[4] < at], [b for b in part if b[2] > at]] if gap > 0 and gap >= row_gap * height else []
            if halves and all(halves):
                todo += [(h, depth + 1) for h in reversed(halves)]
                continue
        out += [b[0] for b in sorted(part, key=lambda b: (b[2], side(b), b[0]))]
    return out


def ordered_boxes(boxes: DataFrame, page: str, **options) -> DataFrame:
    """page, index, place: a page's boxes (index, left, top, right, bottom) in reading order.

    The boxes of a page, which are few, are gathered by Spark; Python sees batches of whole pages. A page with a repeated
    index or a broken box has no order and no rows.
    """
    box = ("index", "left", "top", "right", "bottom")
    lists = boxes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col("index").cast("bigint").alias("index"), *(F.col(c).cast("double").alias(c) for c in box[1:])))).alias("_b"))
    kind = boxes.schema[page].dataType.simpleString()

    def order_or_none(found: list[tuple]) -> list[int] | None:
        try:
            return reading_order(found, **options)
        except (TypeError, ValueError):
            return None

    def fold(batches):
        for batch in batches:
            got = [order_or_none([tuple(b[c] for c in box) for b in x]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int64()))], names=[page, "_o"])

    return lists.mapInArrow(fold, f"{page} {kind}, _o array<bigint>").select(page, F.posexplode("_o").alias("place", "index")).select(page, "index", F.col("place").cast("bigint").alias("place"))
