"""Boxes and masks that a detector found in images: anchors, units, suppression of overlaps, matches with the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anchors(cells: DataFrame, scales: list[float], ratios: list[float], cell: float) -> DataFrame:
    """(row, col, scale, ratio, y0, x0, y1, x1): boxes of each scale and ratio (width to height) around each cell
    (row, col) of a map whose cells are `cell` pixels wide."""
    rows = cells.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    h, w = F.col("scale") / F.sqrt("ratio") / 2, F.col("scale") * F.sqrt("ratio") / 2
    y, x = F.col("row") * cell, F.col("col") * cell
    return rows.select("row", "col", "scale", "ratio", (y - h).alias("y0"), (x - w).alias("x0"), (y + h).alias("y1"), (x + w).alias("x1"))


def pyramid(levels: list[tuple[DataFrame, float, float]], ratios: list[float]) -> DataFrame:
    """anchors() of all levels (cells, scale, cell) of a pyramid, with their level."""
    each = [anchors(cells, [scale], ratios, cell).withColumn("level", F.lit(i)) for i, (cells, scale, cell) in enumerate(levels)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def shares(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes in pixels (ends exclusive) as shares of an image's last row and column (ends inclusive)."""
    size = {"y0": (0, height), "x0": (0, width), "y1": (1, height), "x1": (1, width)}
    return boxes.withColumns({c: (F.col(c) - less) / F.lit(float(n - 1)) for c, (less, n) in size.items()})


def in_pixels(boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Boxes in shares of an image as whole pixels: the inverse of shares()."""
    size = {"y0": (0, height), "x0": (0, width), "y1": (1, height), "x1": (1, width)}
    return boxes.withColumns({c: F.round(F.col(c) * (n - 1) + less).cast("int") for c, (less, n) in size.items()})


def _folded(rows: DataFrame, item: Column, clash) -> DataFrame:
    """(image, x): each image's items in their order, without those that clash with one before them that stays."""
    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: clash(x, y)), kept).otherwise(F.concat(kept, F.array(x)))

    each = rows.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return each.select("image", F.explode(F.aggregate("all", F.filter("all", lambda x: F.lit(False)), add)).alias("x"))


def suppressed(boxes: DataFrame, most: float) -> DataFrame:
    """(image, id): of boxes (image, id, score, y0, x0, y1, x1) those that no better one that stays overlaps by more than
    `most` (over the union). Better is the larger score, then the smaller id. One image's boxes are one array."""
    def area(x: Column) -> Column:
        return (x["y1"] - x["y0"]) * (x["x1"] - x["x0"])

    def clash(x: Column, y: Column) -> Column:
        h = F.greatest(F.lit(0), F.least(x["y1"], y["y1"]) - F.greatest(x["y0"], y["y0"]))
        w = F.greatest(F.lit(0), F.least(x["x1"], y["x1"]) - F.greatest(x["x0"], y["x0"]))
        return h * w > most * (area(x) + area(y) - h * w)

    return _folded(boxes, F.struct((-F.col("score")).alias("rank"), "id", "y0", "x0", "y1", "x1"), clash).select("image", "x.id")


def matched(pairs: DataFrame, least: float) -> DataFrame:
    """(image, id, truth, iou): found objects, best score first (ties: the smaller id), each take the truth that they overlap
    most and that is still free (ties: the smaller name), among pairs (image, id, score, truth, iou) of at least `least`.
    Pairs of unlike classes don't belong in pairs. Only pairs over the threshold reach an image's array."""
    item = F.struct((-F.col("score")).alias("rank"), "id", (-F.col("iou")).alias("far"), "truth")
    found = _folded(pairs.where(F.col("iou") >= least), item, lambda x, y: (x["id"] == y["id"]) | (x["truth"] == y["truth"]))
    return found.select("image", "x.id", "x.truth", (-F.col("x.far")).alias("iou"))


def recall(pairs: DataFrame, truths: DataFrame, least: float) -> DataFrame:
    """(image, recall): the share of each image's truths (image, truth) that some found object overlaps at least so far."""
    met = pairs.where(F.col("iou") >= least).select("image", "truth", F.lit(1).alias("met")).distinct()
    return truths.distinct().join(met, ["image", "truth"], "left").groupBy("image").agg(F.avg(F.coalesce("met", F.lit(0))).alias("recall"))


def precision_range(hits: DataFrame, levels: list[float]) -> DataFrame:
    """(image, ap): average precision, meant over levels of overlap; hits (image, score, id, iou, truth) holds each found
    object's overlap with its truth (0: none) and how many truths the image has. One window serves all levels."""
    rows = hits.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("hit", F.col("iou") >= F.col("level"))
    by = Window.partitionBy("image", "level").orderBy(F.col("score").desc(), "id")
    back = Window.partitionBy("image", "level").orderBy(F.col("n").desc())  # a frame that ends with the rows is summed anew for each row
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("tp", F.sum(F.col("hit").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("precision", F.max(F.col("tp") / F.col("n")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy("image", "level").agg((F.sum(F.when(F.col("hit"), F.col("precision")).otherwise(0.0)) / F.max("truth")).alias("ap"))
    return each.groupBy("image").agg(F.avg("ap").alias("ap"))
