"""Detector boxes to vehicles: threshold, non-maximum suppression, ground area, position. Rejects stay as rows with their reason."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import DEFAULT, Config
from driftline.functions.groups import whole

CLASSES = ("car", "van", "truck", "bus")


def greedy(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, threshold: float) -> np.ndarray:
    """For each box, in order of precedence, the place of the keeper that it falls to, -1 if it stays. Boxes without area overlap nothing."""
    area, right, low = w * h, x + w, y + h
    fell = np.full(len(x), -1)
    for k in range(len(x)):
        if fell[k] >= 0:
            continue
        rest = slice(k + 1, None)
        both = np.maximum(0, np.minimum(right[k], right[rest]) - np.maximum(x[k], x[rest])) * np.maximum(0, np.minimum(low[k], low[rest]) - np.maximum(y[k], y[rest]))
        union = area[k] + area[rest] - both
        share = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        later = fell[rest]
        later[(share >= threshold) & (later < 0)] = k
    return fell


#: Pairs of boxes that may overlap and are compared at a time. A frame with more of them is compared keeper by keeper.
PAIRS = 1 << 20


def fallen(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, threshold: float) -> np.ndarray:
    """As greedy, for the boxes of many frames at once, frame by frame (group, ascending) and in order of precedence.

    A sweep along x lists the boxes of a frame whose extents there overlap; only those pairs are measured.
    """
    fell = np.full(len(x), -1)
    starts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    ends = np.append(starts[1:], len(x))
    if threshold <= 0:  # then boxes apart fall to each other too
        alone = list(zip(starts, ends, strict=True))
        after = np.zeros(len(x), np.int64)
        order = np.arange(len(x))
    else:
        order = np.lexsort((x, group))
        edges = np.unique(x)
        place = lambda v: np.searchsorted(edges, v)
        key = group[order] * (len(edges) + 1) + place(x[order])
        after = np.searchsorted(key, group[order] * (len(edges) + 1) + place((x + w)[order])) - np.arange(1, len(x) + 1)
        after = np.maximum(after, 0)
        many = np.add.reduceat(after, starts) > PAIRS if len(starts) else np.zeros(0, bool)
        alone = list(zip(starts[many], ends[many], strict=True))
    for s, e in alone:
        own = greedy(x[s:e], y[s:e], w[s:e], h[s:e], threshold)
        fell[s:e] = np.where(own < 0, -1, own + s)
        after[s:e] = 0  # order keeps frames where they are
    area, right, low = w * h, x + w, y + h
    upto = np.cumsum(after)
    at, found = 0, []
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = after[at:end]
        first = np.repeat(np.arange(at, end), n)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[first], order[second]
        tall = np.minimum(low[i], low[j]) - np.maximum(y[i], y[j])
        i, j, tall = i[tall > 0], j[tall > 0], tall[tall > 0]
        both = np.maximum(0, np.minimum(right[i], right[j]) - np.maximum(x[i], x[j])) * tall
        union = area[i] + area[j] - both
        share = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
        i, j = i[share >= threshold], j[share >= threshold]
        found.append((np.minimum(i, j), np.maximum(i, j)))
        at = end
    if found:
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        by = np.lexsort((j, i))
        lost = fell.tolist()
        for a, b in zip(i[by].tolist(), j[by].tolist(), strict=True):
            if lost[a] < 0 and lost[b] < 0:
                lost[b] = a
        fell = np.array(lost)
    return fell


def marked(boxes: DataFrame, score_min: float | None = None, threshold: float = DEFAULT.detection.nms_iou, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Boxes with suppressed_by; those below score_min, and without a score if there is one, neither suppress nor are suppressed.

    A frame's boxes come one after another and are judged with those of other whole frames of a batch; only a frame that runs on is held over.
    """
    schema = T.StructType([*boxes.schema.fields, T.StructField("suppressed_by", T.LongType())])

    def judged(table: pa.Table, group: np.ndarray) -> pa.Table:
        number = lambda c: table.column(c).cast(pa.float64()).to_numpy()
        score, idx = number("score"), table.column("idx").cast(pa.int64()).to_numpy()
        seen = np.arange(len(score)) if score_min is None else np.flatnonzero((score >= score_min) | np.isnan(score) & ~table.column("score").is_null().to_numpy())
        at = seen[np.lexsort((idx[seen], -score[seen], group[seen]))]
        fell = fallen(group[at], *(number(c)[at] for c in "xywh"), threshold)
        keeper, free = np.zeros(len(score), np.int64), np.ones(len(score), bool)
        down = at[fell >= 0]
        keeper[down], free[down] = idx[at[fell[fell >= 0]]], False
        return table.append_column("suppressed_by", pa.array(keeper, mask=free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole(batches, by):
            yield from judged(table, group).combine_chunks().to_batches()

    return boxes.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, schema)


def suppress(boxes: DataFrame, threshold: float = DEFAULT.detection.nms_iou, by: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Boxes with suppressed_by (null for those that stay), greedily by score, then by index.

    by: ("image_id",) or, to keep classes apart, ("image_id", "cls"). A group is one camera frame's boxes, which bounds its
    size; within it the boxes that overlap meet as arrays.
    """
    return marked(boxes.select(*by, F.col("idx").cast("long").alias("idx"), "score", "x", "y", "w", "h"), None, threshold, by).select(*by, "idx", "suppressed_by")


def detections(boxes: DataFrame, frames: DataFrame, cfg: Config = DEFAULT, per_class: bool = False) -> DataFrame:
    """Every box with area_m2, kept, drop_reason (score, nms, area, in this order of tests) and suppressed_by. frames: image_id, gsd_x, gsd_y."""
    d = cfg.detection
    rows = marked(boxes, d.score_min, d.nms_iou, ("image_id", "cls") if per_class else ("image_id",)).join(frames.select("image_id", "gsd_x", "gsd_y"), "image_id", "left")
    area = F.col("w") * F.col("h") * F.col("gsd_x") * F.col("gsd_y")
    reason = F.when(F.coalesce(F.col("score") < d.score_min, F.lit(True)), "score").when(F.col("suppressed_by").isNotNull(), "nms").when(area < d.min_area_m2, "area")
    return rows.withColumns({"area_m2": area, "drop_reason": reason, "kept": reason.isNull()}).drop("gsd_x", "gsd_y")


def funnel(rows: DataFrame) -> DataFrame:
    """Per image: raw, after the score, after suppression, kept, and how many of the kept are of each class."""
    gone = lambda *why: F.count_if(F.coalesce(F.col("drop_reason").isin(*why), F.lit(False)))
    n = F.count("*")
    return rows.groupBy("image_id").agg(n.alias("raw"), (n - gone("score")).alias("after_score"), (n - gone("score", "nms")).alias("after_nms"), F.count_if("kept").alias("kept"), *(F.count_if(F.col("kept") & (F.col("cls") == c)).alias(f"n_{c}") for c in CLASSES))


def parse_predictions(rows: DataFrame, text: str = "prediction") -> DataFrame:
    """image_id, groups and the first fault of a string of six-token groups (class score x y w h).

    A row with a bad group is refused whole; the tests go by group: token count, class, number, score, size.
    """
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    n = F.size("tokens")
    group = lambda i: F.slice("tokens", i * 6 + 1, 6)
    number = lambda g, k: F.get(g, F.lit(k)).try_cast("double")

    def fault(i: Column) -> Column:
        g = group(i)
        nums = [number(g, k) for k in range(1, 6)]
        bad = nums[0].isNull() | nums[1].isNull() | nums[2].isNull() | nums[3].isNull() | nums[4].isNull()
        rule = F.when(F.size(g) < 6, "token_count").when(~F.get(g, F.lit(0)).isin(*CLASSES), "class").when(bad, "number_parse").when(~nums[0].between(0, 1), "score_range").when((nums[3] <= 0) | (nums[4] <= 0), "size")
        return F.when(rule.isNotNull(), F.struct(i.alias("group"), rule.alias("rule")))

    numbered = rows.withColumn("tokens", tokens).withColumn("at", F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 6).cast("int"))).otherwise(F.array().cast("array<int>")))
    checked = numbered.withColumn("fault", F.get(F.filter(F.transform("at", fault), lambda x: x.isNotNull()), F.lit(0)))
    box = lambda i: F.struct(F.get(group(i), F.lit(0)).alias("cls"), *(number(group(i), k).alias(c) for k, c in enumerate(("score", "x", "y", "w", "h"), 1)))
    return checked.withColumn("boxes", F.when(F.col("fault").isNull(), F.transform("at", box))).drop("tokens", "at")
